"""Queries over outcome scoring, rewards and agent traces."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from assayer import vocabulary as v
from assayer.functions.text import format_evidence
from assayer.operators import features, scoring, trace
from assayer.plans import retrieval_plans, roles
from assayer.plans.registry import plan
from assayer.session import join_small, stored
from assayer.sources.tables import table

KEYS = ("question_id", "action_id")
_DIMS = list(scoring.DIMENSIONS)


def _rounded(names):
    return [F.round(n, 6).alias(n) for n in names]


_TALL = " UNION ALL ".join(
    f"SELECT question_id, action_id, '{s}' AS scorer_name, '{d}' AS dimension, {d} AS raw_metric FROM scored WHERE {d} IS NOT NULL"
    for d, s in scoring.DIMENSIONS.items()
)


@plan(
    "outcome_scores",
    f"""WITH {roles.SCORED_SQL} SELECT question_id, action_id, scorer_name, dimension,
      round(raw_metric, 6) AS raw_metric FROM ({_TALL})""",
)
def outcome_scores(spark, folder):
    tall = scoring.score_tall(roles.scored(spark, folder), *KEYS)
    return tall.select(*KEYS, "scorer_name", "dimension", *_rounded(["raw_metric"]))


@plan(
    "score_summary",
    f"""WITH {roles.SCORED_SQL} SELECT action_id, dimension, count(*) AS n, round(avg(raw_metric), 6) AS mean_score
    FROM ({_TALL}) GROUP BY ALL""",
)
def score_summary(spark, folder):
    tall = scoring.score_tall(roles.scored(spark, folder), *KEYS)
    return tall.groupBy("action_id", "dimension").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("raw_metric"), 6).alias("mean_score")
    )


@plan(
    "dimension_pivot",
    f"""WITH {roles.SCORED_SQL} SELECT question_id, action_id, {", ".join(f"round({d}, 6) AS {d}" for d in _DIMS)} FROM scored""",
)
def dimension_pivot(spark, folder):
    tall = scoring.score_tall(roles.scored(spark, folder), *KEYS)
    return scoring.pivot_dimensions(tall, *KEYS).select(*KEYS, *_rounded(_DIMS))


ISSUES_SQL = f"""{roles.SCORED_SQL},
    issues AS (SELECT question_id, action_id, issue.category AS category, issue.severity AS severity FROM (
      SELECT question_id, action_id, unnest(list_filter([
        CASE WHEN n_gold > 0 AND n_found = 0 THEN {{'category': 'retrieval_failure', 'severity': 'error'}} END,
        CASE WHEN n_hall > 0 THEN {{'category': 'hallucinated_citation', 'severity': 'critical'}} END,
        CASE WHEN NOT abstained AND coalesce(answer, '') <> '' AND action_id <> 'A0_direct' AND n_cited = 0 THEN {{'category': 'uncited_answer', 'severity': 'error'}} END,
        CASE WHEN numeric_correctness = 0 THEN {{'category': 'incorrect_numeric_answer', 'severity': 'error'}} END,
        CASE WHEN n_gold > 0 AND abstained AND n_found > 0 THEN {{'category': 'over_cautious_abstention', 'severity': 'warning'}} END,
        CASE WHEN n_gold > 0 AND NOT abstained AND n_found = 0 AND coalesce(answer, '') <> '' THEN {{'category': 'unsupported_answer', 'severity': 'critical'}} END,
        CASE WHEN NOT pricing_known THEN {{'category': 'cost_unmeasured', 'severity': 'info'}} END,
        CASE WHEN latency_ms > 30000 THEN {{'category': 'slow_response', 'severity': 'warning'}} END,
        CASE WHEN error_status <> 'ok' THEN {{'category': 'workflow_' || error_status,
          'severity': CASE WHEN error_status IN ('rate_limited', 'timeout') THEN 'warning' ELSE 'error' END}} END],
        lambda i: i IS NOT NULL)) AS issue FROM scored))"""


@plan("outcome_issues", f"WITH {ISSUES_SQL} SELECT * FROM issues")
def outcome_issues(spark, folder):
    return scoring.detect_issues(roles.outcomes(spark, folder), *KEYS)


@plan(
    "issue_counts",
    f"WITH {ISSUES_SQL} SELECT category, severity, count(*) AS n FROM issues GROUP BY ALL",
)
def issue_counts(spark, folder):
    issues = scoring.detect_issues(roles.outcomes(spark, folder), *KEYS)
    return issues.groupBy("category", "severity").agg(F.count(F.lit(1)).alias("n"))


_FAMILY = "CASE category " + " ".join(
    f"WHEN '{c}' THEN '{f}'" for c, f in scoring.TAXONOMY.items()
) + " ELSE 'operational' END"


@plan(
    "failure_taxonomy",
    f"""WITH {ISSUES_SQL} SELECT action_id, {_FAMILY} AS family, count(*) AS n_issues,
      count(DISTINCT question_id) AS n_questions FROM issues GROUP BY ALL""",
)
def failure_taxonomy(spark, folder):
    issues = scoring.taxonomy(scoring.detect_issues(roles.outcomes(spark, folder), *KEYS))
    # Distinct questions per (action, family) in two plain aggregates.
    return (
        issues.groupBy("action_id", "family", "question_id")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("action_id", "family")
        .agg(F.sum("n").alias("n_issues"), F.count(F.lit(1)).alias("n_questions"))
    )


@plan(
    "outcome_violations",
    f"""WITH {roles.OUTCOMES_SQL}, damaged AS (
      SELECT question_id, action_id, CASE WHEN question_key % 7 = 0 THEN NULL ELSE abstention_reason END AS reason,
        CASE WHEN question_key % 5 = 0 THEN 'x' ELSE answer END AS answer, CASE WHEN question_key % 11 = 0 THEN 1.5::DOUBLE ELSE confidence END AS confidence,
        CASE WHEN question_key % 13 = 0 THEN 'lost' ELSE error_status END AS status FROM outcomes)
    SELECT question_id, action_id, unnest(list_filter([
      CASE WHEN action_id = 'A6_abstain' AND reason IS NULL THEN 'abstain_without_reason' END,
      CASE WHEN reason IS NOT NULL AND coalesce(answer, '') <> '' THEN 'answer_and_abstain' END,
      CASE WHEN status = 'lost' THEN 'unknown_status' END,
      CASE WHEN confidence > 1 THEN 'confidence_range' END], lambda x: x IS NOT NULL)) AS violation FROM damaged""",
)
def outcome_violations(spark, folder):
    """Outcomes with some fields damaged by rule, then checked."""
    key = F.col("question_key")
    damaged = roles.outcomes(spark, folder).withColumns(
        {
            "abstention_reason": F.when(key % 7 != 0, F.col("abstention_reason")),
            "answer": F.when(key % 5 == 0, "x").otherwise(F.col("answer")),
            "confidence": F.when(key % 11 == 0, 1.5).otherwise(F.col("confidence")),
            "error_status": F.when(key % 13 == 0, "lost").otherwise(F.col("error_status")),
        }
    )
    return scoring.outcome_violations(damaged, *KEYS)


@plan(
    "cost_estimates",
    f"""WITH {roles.OUTCOMES_SQL} SELECT action_id, model, count(*) AS n, count(*) FILTER (pricing_known) AS n_priced,
      round(sum(estimated_cost_usd), 6) AS total_cost_usd,
      CAST(sum(input_tokens + output_tokens + retry_input_tokens + retry_output_tokens) AS BIGINT) AS total_tokens
    FROM outcomes GROUP BY ALL""",
)
def cost_estimates(spark, folder):
    tokens = (
        F.col("input_tokens")
        + F.col("output_tokens")
        + F.col("retry_input_tokens")
        + F.col("retry_output_tokens")
    )
    return (
        roles.outcomes(spark, folder)
        .groupBy("action_id", "model")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.count_if("pricing_known").alias("n_priced"),
            F.round(F.sum("estimated_cost_usd"), 6).alias("total_cost_usd"),
            F.sum(tokens).cast("bigint").alias("total_tokens"),
        )
    )


_PROFILES = ", ".join(
    f"('{n}:{v.PROFILE_VERSION}', {', '.join(f'{w}::DOUBLE' for w in ws)})"
    for n, ws in v.REWARD_PROFILES.items()
)


@plan(
    "rewards_by_profile",
    f"""WITH {roles.SCORED_SQL} SELECT question_id, action_id, profile, round(quality, 9) AS quality,
      round(wc * normalized_cost, 9) AS cost_penalty, round(wl * normalized_latency, 9) AS latency_penalty,
      round(wh * hallucination, 9) AS hallucination_penalty, round(wv * violation, 9) AS violation_penalty,
      round(quality - wc * normalized_cost - wl * normalized_latency - wh * hallucination - wv * violation, 9) AS reward
    FROM inputs, (VALUES {_PROFILES}) p(profile, wc, wl, wh, wv)""",
)
def rewards_by_profile(spark, folder):
    return scoring.rewards_by_profile(scoring.reward_inputs(roles.scored(spark, folder)), *KEYS)


@plan(
    "reward_summary",
    f"""WITH {roles.SCORED_SQL}, r AS (SELECT action_id, profile,
      round(quality - wc * normalized_cost - wl * normalized_latency - wh * hallucination - wv * violation, 9) AS reward
      FROM inputs, (VALUES {_PROFILES}) p(profile, wc, wl, wh, wv)),
    m AS (SELECT action_id, profile, round(avg(reward), 6) AS mean_reward FROM r GROUP BY ALL)
    SELECT *, CAST(row_number() OVER (PARTITION BY profile ORDER BY mean_reward DESC, action_id) AS INTEGER) AS place FROM m""",
)
def reward_summary(spark, folder):
    each = scoring.rewards_by_profile(scoring.reward_inputs(roles.scored(spark, folder)), *KEYS)
    means = each.groupBy("action_id", "profile").agg(
        F.round(F.avg("reward"), 6).alias("mean_reward")
    )
    place = Window.partitionBy("profile").orderBy(F.col("mean_reward").desc(), "action_id")
    return means.withColumn("place", F.row_number().over(place))


@plan(
    "strict_rewards",
    f"""WITH {roles.SCORED_SQL}, s AS (SELECT action_id,
      CASE WHEN abstained THEN coalesce(abstention_precision, 0) ELSE quality END AS q,
      CASE WHEN cost_score IS NULL THEN 1 ELSE normalized_cost END AS c, normalized_latency, hallucination, violation FROM inputs)
    SELECT action_id, round(avg(round(q - 0.25::DOUBLE * c - 0.2::DOUBLE * normalized_latency - 0.4::DOUBLE * hallucination - violation, 9)), 6) AS mean_reward
    FROM s GROUP BY ALL""",
)
def strict_rewards(spark, folder):
    inputs = scoring.reward_inputs_strict(roles.scored(spark, folder))
    value = F.round(scoring.reward(v.REWARD_PROFILES[v.PRIMARY_PROFILE]), 9)
    return inputs.groupBy("action_id").agg(F.round(F.avg(value), 6).alias("mean_reward"))


@plan(
    "episode_steps",
    f"""WITH {roles.OUTCOMES_SQL}, s AS (SELECT experiment_id || '::' || question_id || '::' || action_id AS episode_id,
      list_filter([{{'kind': 'message', 'phase': 'query_received', 'detail': question_id}},
        CASE WHEN len(retrieved_chunk_ids) > 0 THEN {{'kind': 'tool_call', 'phase': 'retrieval_request', 'detail': 'retrieve'}} END,
        CASE WHEN len(retrieved_chunk_ids) > 0 THEN {{'kind': 'tool_result', 'phase': 'retrieval_response', 'detail': len(retrieved_chunk_ids)::VARCHAR}} END,
        {{'kind': 'llm_call', 'phase': 'answer_generation', 'detail': answer}},
        CASE WHEN abstained THEN {{'kind': 'custom', 'phase': 'abstention', 'detail': abstention_reason}}
             WHEN len(cited_chunk_ids) > 0 THEN {{'kind': 'custom', 'phase': 'citation', 'detail': len(cited_chunk_ids)::VARCHAR}} END], lambda x: x IS NOT NULL) AS steps FROM outcomes),
    e AS (SELECT episode_id, i, steps[i + 1] AS s FROM (SELECT *, unnest(range(0, len(steps))) AS i FROM s))
    SELECT episode_id, CAST(i AS INTEGER) AS step, s.kind AS kind, s.phase AS phase, s.detail AS detail FROM e""",
)
def episode_steps(spark, folder):
    return scoring.episode_steps(roles.outcomes(spark, folder))


@plan(
    "evidence_prompts",
    f"""WITH {roles.BM25_SQL} SELECT question_id, sha256(string_agg('[' || chunk_id || ']' || chr(10) ||
      regexp_replace(text, '^\\s+|\\s+$', '', 'g'), chr(10) || chr(10) ORDER BY rank)) AS prompt_digest
    FROM bm25_all JOIN doc_rows USING (chunk_id) WHERE rank <= 5 GROUP BY ALL""",
)
def evidence_prompts(spark, folder):
    """Prompt evidence of the five best chunks: a list bounded by k."""
    shown = join_small(
        roles.corpus(spark, folder).select("chunk_id", "text"),
        stored(retrieval_plans.lexical(spark, folder, 5), "lexical"),
        "chunk_id",
    )
    items = F.sort_array(F.collect_list(F.struct("rank", "chunk_id", "text")))
    return (
        shown.groupBy("question_id")
        .agg(items.alias("items"))
        .select("question_id", F.sha2(format_evidence(F.col("items")), 256).alias("prompt_digest"))
    )


# ------------------------------------------------------------- agent traces
def steps(spark, folder):
    """Events as agent steps: one run per user and hour."""
    key = F.from_json("props", "k int")["k"]
    hour = F.date_trunc("hour", "ts")
    call = F.when(F.col("event_type") != "error", F.concat_ws(":", "event_type", key % 20))
    return table(spark, folder, "events").select(
        F.concat_ws("-", "user_id", F.date_format(hour, "yyyyMMddHH")).alias("run_id"),
        F.col("event_id").alias("step"),
        F.col("event_type").alias("tool"),
        call.alias("signature"),
        (key % 10 != 0).alias("ok"),
        F.when(F.col("event_type") == "error", "unreadable").alias("parse_error"),
        F.when(
            F.col("event_type").isin("view", "click"),
            F.array(F.concat(F.lit("k"), key % 7), F.concat(F.lit("k"), key % 11)),
        )
        .otherwise(F.array().cast("array<string>"))
        .alias("chunk_ids"),
        F.floor(F.col("value") * 100).cast("bigint").alias("tokens"),
        F.when(F.col("event_type") != "error", 1).otherwise(0).alias("calls"),
        (F.minute("ts") * 2.0).alias("elapsed_seconds"),
        (F.col("event_type") == "purchase").alias("submitted"),
    )


STEPS_SQL = """
    steps AS (SELECT user_id || '-' || strftime(ts, '%Y%m%d%H') AS run_id, event_id AS step, event_type, k,
        CASE WHEN event_type <> 'error' THEN event_type || ':' || (k % 20) END AS signature,
        k % 10 <> 0 AS ok, event_type = 'error' AS parse_error, CAST(floor(value * 100) AS BIGINT) AS tokens,
        CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END AS calls, minute(ts) * 2 AS elapsed
      FROM (SELECT *, CAST(regexp_extract(props, '"k": ([0-9]+)', 1) AS INTEGER) AS k FROM events)),
    seen AS (SELECT run_id, step, unnest(['k' || (k % 7), 'k' || (k % 11)]) AS chunk_id FROM steps WHERE event_type IN ('view', 'click'))"""


@plan(
    "agent_run_metrics",
    f"""WITH {STEPS_SQL}, c AS (SELECT run_id, count(DISTINCT chunk_id) AS n_chunks FROM seen GROUP BY ALL)
    SELECT run_id, count(*) AS n_steps, CAST(sum(calls) AS BIGINT) AS n_tool_calls, CAST(sum(tokens) AS BIGINT) AS total_tokens,
      round(sum(CASE WHEN calls = 1 AND ok THEN 1 ELSE 0 END) / count(*), 6) AS valid_tool_call_rate,
      round(coalesce((sum(calls) - count(DISTINCT signature)) / nullif(sum(calls), 0), 0), 6) AS repeated_call_rate,
      round(coalesce(coalesce(any_value(n_chunks), 0) / nullif(sum(calls), 0), 0), 6) AS evidence_per_call
    FROM steps LEFT JOIN c USING (run_id) GROUP BY run_id""",
)
def agent_run_metrics(spark, folder):
    return trace.run_metrics(steps(spark, folder))


@plan(
    "agent_step_repeats",
    f"""WITH {STEPS_SQL} SELECT run_id, step, signature,
      signature IS NOT NULL AND row_number() OVER (PARTITION BY run_id, signature ORDER BY step) > 1 AS is_repeat FROM steps""",
)
def agent_step_repeats(spark, folder):
    return trace.flag_repeats(steps(spark, folder)).select(
        "run_id", "step", "signature", "is_repeat"
    )


@plan(
    "agent_chunks_seen",
    f"WITH {STEPS_SQL} SELECT run_id, chunk_id, min(step) AS first_step FROM seen GROUP BY ALL",
)
def agent_chunks_seen(spark, folder):
    return trace.chunks_seen(steps(spark, folder))


@plan(
    "agent_terminations",
    f"""WITH {STEPS_SQL}, b AS (SELECT *, coalesce(sum(tokens) OVER w, 0) AS tokens_before, coalesce(sum(calls) OVER w, 0) AS calls_before,
        row_number() OVER (PARTITION BY run_id ORDER BY step) - 1 AS n_before FROM steps
      WINDOW w AS (PARTITION BY run_id ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    r AS (SELECT *, CASE WHEN n_before >= 8 THEN 'step_limit_exceeded' WHEN elapsed > 120 THEN 'time_limit_exceeded'
      WHEN tokens_before >= 20000 THEN 'token_limit_exceeded' WHEN calls_before >= 12 THEN 'tool_call_limit_exceeded'
      WHEN event_type = 'purchase' THEN 'submitted' END AS reason FROM b)
    SELECT run_id, coalesce(min_by(reason, n_before) FILTER (reason IS NOT NULL), 'invalid_termination') AS termination_reason,
      coalesce(min(n_before) FILTER (reason IS NOT NULL), -1) AS steps_before FROM r GROUP BY run_id""",
)
def agent_terminations(spark, folder):
    return trace.terminations(steps(spark, folder)).withColumn(
        "steps_before", F.coalesce("steps_before", F.lit(-1).cast("bigint"))
    )


@plan(
    "router_confidence",
    """WITH p AS (SELECT event_id, list_transform([1.0, value + 1, event_id % 5 + 1, user_id % 7 + 1], lambda x: x::DOUBLE) AS w FROM events),
    q AS (SELECT event_id, list_transform(w, lambda x: x / list_sum(w)) AS p FROM p)
    SELECT event_id, round(list_max(p), 6) AS max_probability, round(list_reverse_sort(p)[1] - list_reverse_sort(p)[2], 6) AS probability_margin,
      round(-list_sum(list_transform(p, lambda x: x * ln(x))), 6) AS prediction_entropy FROM q""",
)
def router_confidence(spark, folder):
    """Confidence features of a preference vector derived from each event."""
    weights = F.array(
        F.lit(1.0),
        F.col("value") + 1,
        (F.col("event_id") % 5 + 1).cast("double"),
        (F.col("user_id") % 7 + 1).cast("double"),
    )
    total = F.aggregate(weights, F.lit(0.0), lambda a, w: a + w)
    rows = table(spark, folder, "events").select(
        "event_id", F.transform(weights, lambda w: w / total).alias("p")
    )
    named = features.router_confidence(F.col("p"))
    return rows.select("event_id", *[c.alias(n) for n, c in named.items()])
