"""Queries over policies, logged feedback, off-policy estimates and bandits."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayer import vocabulary as v
from assayer.functions.hashing import POISSON_ONE_CDF, uniform_sql
from assayer.operators import bandits, datasets, features, ope, policies, routers, scoring
from assayer.operators import running as run
from assayer.plans import roles
from assayer.plans.registry import plan
from assayer.session import stored

_A = v.ACTIONS


@plan(
    "outcome_matrix",
    f"""WITH {roles.REWARDS_SQL} SELECT question_id, split, {", ".join(f"max(reward) FILTER (action_id = '{a}') AS {a}" for a in _A)}
    FROM rewards GROUP BY question_id, split""",
)
def outcome_matrix(spark, folder):
    return policies.reward_matrix(roles.rewards(spark, folder), "split")


@plan(
    "action_summary",
    f"""WITH {roles.REWARDS_SQL} SELECT split, action_id, count(*) AS n, round(avg(reward), 6) AS mean_reward,
      round(avg(estimated_cost_usd), 9) AS mean_cost_usd, round(avg(latency_ms), 6) AS mean_latency_ms,
      round(avg(CASE WHEN abstained THEN 0 ELSE 1 END), 6) AS answer_coverage FROM rewards GROUP BY split, action_id""",
)
def action_summary(spark, folder):
    return policies.action_summary(roles.rewards(spark, folder), "split")


FIXED_SQL = f"""{roles.REWARDS_SQL},
    means AS (SELECT action_id, round(avg(reward), 6) AS reward, round(avg(estimated_cost_usd), 9) AS cost
              FROM rewards WHERE split = 'validation' GROUP BY action_id),
    chosen AS (
      SELECT 'always_' || substr(action_id, 4) AS policy, action_id FROM means WHERE action_id <> 'A6_abstain'
      UNION ALL (SELECT 'cheapest_answering', action_id FROM means WHERE action_id <> 'A6_abstain' AND cost IS NOT NULL ORDER BY cost, action_id LIMIT 1)
      UNION ALL (SELECT 'strongest_validation', action_id FROM means ORDER BY reward DESC, action_id LIMIT 1))"""


@plan(
    "fixed_policies",
    f"""WITH {FIXED_SQL}, s AS (SELECT action_id, count(*) AS n, round(avg(reward), 6) AS policy_value FROM rewards WHERE split = 'test' GROUP BY ALL)
    SELECT policy, action_id, n, policy_value FROM chosen JOIN s USING (action_id)""",
)
def fixed_policies(spark, folder):
    rewards = roles.rewards(spark, folder)
    values = policies.fixed_policy_values(rewards, policies.fixed_policies(rewards), "test")
    return values.select("policy", "action_id", "n", "policy_value")


ORACLE_SQL = f"""{roles.REWARDS_SQL},
    best AS (SELECT question_id, split, action_id AS best_action, reward AS best_reward FROM (
      SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY reward DESC, action_id) AS rn FROM rewards) WHERE rn = 1)"""


@plan(
    "oracle_policy",
    f"WITH {ORACLE_SQL} SELECT question_id, split, best_action, best_reward FROM best",
)
def oracle_policy(spark, folder):
    return policies.oracle(roles.rewards(spark, folder), "split")


@plan(
    "policy_regret",
    f"""WITH {ORACLE_SQL} SELECT r.split, r.action_id, round(avg(reward), 6) AS policy_value, round(avg(best_reward), 6) AS oracle_value,
      round(avg(best_reward - reward), 6) AS mean_regret FROM rewards r JOIN best USING (question_id) GROUP BY r.split, r.action_id""",
)
def policy_regret(spark, folder):
    # Read by the oracle and beside it: outcomes are scored once.
    scored = roles.rewards(spark, folder).select("question_id", "split", "action_id", "reward")
    rewards = stored(scored, "rewards")
    return policies.regret(rewards, policies.oracle(rewards), "split", "action_id")


METRICS_SQL = f"""{roles.SCORED_SQL},
    metrics AS (SELECT action_id, round(avg(numeric_correctness), 6) AS answer_correctness, round(avg(coalesce(estimated_cost_usd, 0)), 9) AS mean_cost_usd,
      round(avg(CASE WHEN numeric_correctness IS NOT NULL THEN CASE WHEN numeric_correctness = 1 AND retrieval_hit = 1 THEN 1 ELSE 0 END END), 6) AS supported_answer_accuracy,
      round(avg(CASE WHEN abstained THEN 0 ELSE 1 END), 6) AS answer_coverage,
      round(avg(CASE WHEN citation_precision < 1 THEN 1 ELSE 0 END), 6) AS hallucination_rate FROM scored GROUP BY action_id)"""


@plan("constraint_metrics", f"WITH {METRICS_SQL} SELECT * FROM metrics")
def constraint_metrics(spark, folder):
    return policies.constraint_metrics(roles.scored(spark, folder))


# The declared floors are out of reach of the derived outcomes, so a second set
# of bounds exercises the feasible branch.
LOOSE = tuple(
    (f"loose_{name}", sense, objective, metric, op, bound)
    for (name, sense, objective, metric, op, _), bound in zip(
        policies.CONSTRAINTS, (0.05, 0.10, 0.30), strict=True
    )
)


def _constraint_sql(c) -> str:
    name, sense, objective, metric, op, bound = c
    order = f"{objective} {'DESC' if sense == 'max' else 'ASC'}, action_id"
    return f"""SELECT '{name}' AS "constraint", (SELECT action_id FROM metrics WHERE {metric} {op} {bound}::DOUBLE AND {objective} IS NOT NULL ORDER BY {order} LIMIT 1) AS action_id,
      (SELECT count(*) FROM metrics WHERE {metric} {op} {bound}::DOUBLE) AS n_feasible"""


@plan(
    "constrained_selection",
    f"WITH {METRICS_SQL} {' UNION ALL '.join(_constraint_sql(c) for c in policies.CONSTRAINTS + LOOSE)}",
)
def constrained_selection(spark, folder):
    metrics = policies.constraint_metrics(roles.scored(spark, folder))
    return policies.constrained_selection(metrics, policies.CONSTRAINTS + LOOSE)


_GRID = policies.SENSITIVITY_GRID


@plan(
    "weight_sensitivity",
    f"""WITH {roles.SCORED_SQL}, m AS (SELECT action_id, avg(quality) AS q, avg(normalized_cost) AS c, avg(normalized_latency) AS l, avg(hallucination) AS h, avg(violation) AS vi FROM inputs GROUP BY ALL),
    g AS (SELECT * FROM {", ".join(f"(VALUES {', '.join(f'({x}::DOUBLE)' for x in xs)}) {n}_t({n})" for n, xs in _GRID.items())}),
    p AS (SELECT g.*, action_id, round(q - lambda_cost * c - lambda_latency * l - lambda_hallucination * h - vi, 6) AS value FROM m, g)
    SELECT lambda_cost, lambda_latency, lambda_hallucination, action_id AS winner, value AS winner_value FROM (
      SELECT *, row_number() OVER (PARTITION BY lambda_cost, lambda_latency, lambda_hallucination ORDER BY value DESC, action_id) AS rn FROM p) WHERE rn = 1""",
)
def weight_sensitivity(spark, folder):
    return policies.weight_sensitivity(scoring.reward_inputs(roles.scored(spark, folder)))


@plan(
    "pareto_front",
    f"""WITH {roles.SCORED_SQL}, p AS (SELECT context, action_id, round(avg(quality), 6) AS quality, round(avg(normalized_cost), 6) AS cost FROM inputs GROUP BY ALL)
    SELECT * FROM p WHERE NOT EXISTS (SELECT 1 FROM p o WHERE o.context = p.context AND o.cost <= p.cost AND o.quality >= p.quality
      AND (o.cost < p.cost OR o.quality > p.quality))""",
)
def pareto_front(spark, folder):
    rewards = roles.rewards(spark, folder)
    points = rewards.groupBy("context", "action_id").agg(
        F.round(F.avg("quality"), 6).alias("quality"),
        F.round(F.avg("normalized_cost"), 6).alias("cost"),
    )
    return policies.pareto_front(points, ["context"], "cost", "quality").select(
        "context", "action_id", "quality", "cost"
    )


@plan(
    "budget_guard",
    f"""WITH {roles.OUTCOMES_SQL}, r AS (SELECT action_id, question_key, coalesce(estimated_cost_usd, 0) AS cost,
        sum(coalesce(estimated_cost_usd, 0)) OVER (PARTITION BY action_id ORDER BY question_key) AS spent FROM outcomes),
    f AS (SELECT action_id, min(question_key) FILTER (round(spent, 6) > 25) AS first_over, round(sum(cost), 2) AS total FROM r GROUP BY ALL)
    SELECT action_id, coalesce(first_over, -1) AS first_over, total FROM f""",
)
def budget_guard(spark, folder):
    """First question at which each action's spend would pass the ceiling."""
    spend = roles.outcomes(spark, folder).select(
        "action_id",
        "question_key",
        F.coalesce("estimated_cost_usd", F.lit(0.0)).alias("cost"),
    )
    totals = run.running_totals(spend, ["action_id"], ["question_key"], ["cost"])
    over = F.when(F.round("cost_through", 6) > 25.0, F.col("question_key"))
    return totals.groupBy("action_id").agg(
        F.coalesce(F.min(over), F.lit(-1)).alias("first_over"),
        F.round(F.sum("cost"), 2).alias("total"),
    )


_SEED = str(v.DEFAULT_SEED % 10_000)


#: Declared size and strata of the sample for human review.
REVIEW_SIZE = 60
REVIEW_STRATA = {
    "correctness": "coalesce(numeric_correctness, CAST(-1 AS DOUBLE))",
    "action_id": "action_id",
    "confidence_band": "CAST(coalesce(floor(confidence * 4), -1) AS BIGINT)",
    "abstained": "abstained",
    "is_numerical": "numeric_correctness IS NOT NULL",
    # The numbers agree where no citation backs them, or the other way round.
    "scorers_disagree": "coalesce(numeric_correctness <> citation_coverage, false)",
}


@plan(
    "review_sample",
    f"""WITH {roles.SCORED_SQL}, s AS (SELECT question_id, question_key, {", ".join(f"{sql} AS {name}" for name, sql in REVIEW_STRATA.items())},
        {uniform_sql("question_key", _SEED)} AS draw FROM scored),
    r AS (SELECT *, row_number() OVER (PARTITION BY {", ".join(REVIEW_STRATA)} ORDER BY draw, question_key) AS pick FROM s)
    SELECT question_id, {", ".join(REVIEW_STRATA)}, CAST(pick AS INTEGER) AS pick FROM r
    ORDER BY pick, draw, question_key, {", ".join(REVIEW_STRATA)} LIMIT {REVIEW_SIZE}""",
)
def review_sample(spark, folder):
    rows = roles.scored(spark, folder).select(
        "question_id", "question_key", *[F.expr(sql).alias(name) for name, sql in REVIEW_STRATA.items()]
    )
    return datasets.spread_sample(rows, "question_key", list(REVIEW_STRATA), REVIEW_SIZE).drop("question_key")


@plan(
    "budget_estimate",
    f"""WITH {roles.OUTCOMES_SQL}, r AS (SELECT action_id, coalesce(estimated_cost_usd, 0) AS cost,
        row_number() OVER (PARTITION BY action_id ORDER BY {uniform_sql("question_key", _SEED)}, question_key) AS pick FROM outcomes)
    SELECT action_id, round(avg(cost) FILTER (pick <= 20) * count(*), 2) AS estimated_total FROM r GROUP BY ALL""",
)
def budget_estimate(spark, folder):
    """Projected spend per action from a dry run on 20 questions."""
    spend = roles.outcomes(spark, folder).select(
        "action_id", "question_key", F.coalesce("estimated_cost_usd", F.lit(0.0)).alias("cost")
    )
    sampled = datasets.stratified_sample(spend, "question_key", ["action_id"], 20)
    means = sampled.groupBy("action_id").agg(F.avg("cost").alias("mean"))
    counts = spend.groupBy("action_id").agg(F.count(F.lit(1)).alias("n"))
    return means.join(counts, "action_id").select(
        "action_id", F.round(F.col("mean") * F.col("n"), 2).alias("estimated_total")
    )


# ------------------------------------------------------- logged feedback, OPE
SEEDS = tuple(range(1, 11))


def _policy_rows_sql() -> str:
    k = len(_A)

    def eps(e):
        return "[" + ", ".join(f"{e / k + (1 - e) * (i == 1)!r}::DOUBLE" for i in range(k)) + "]"

    def soft(values, sign):
        w = f"list_transform({values}, lambda x: exp({sign} * x / 0.5::DOUBLE))"
        return f"list_transform({w}, lambda y: y / list_sum({w}))"

    def means(expression):
        return "[" + ", ".join(
            f"coalesce(round(avg({expression}) FILTER (action_id = '{a}'), 6), 0)" for a in _A
        ) + "]"

    rows = [
        "[" + ", ".join([f"{1 / k!r}::DOUBLE"] * k) + "]",
        eps(0.2),
        soft("costs", "-1"),
        soft("vals", "1"),
        eps(0.02),
    ]
    union = " UNION ALL ".join(
        f"SELECT {i + 1} AS policy_no, '{n}' AS policy, list_transform({rows[i]}, lambda p: round(p, 9)) AS p FROM means"
        for i, n in enumerate(ope.BEHAVIOURS)
    )
    return f"""
    means AS (SELECT {means("normalized_cost")} AS costs, {means("CASE WHEN split = 'validation' THEN reward END")} AS vals FROM rewards),
    pol AS (SELECT *, list_transform(range(1, {k + 1}), lambda i: list_sum(p[1:i])) AS cum FROM ({union}))"""


def _poisson_sql(u: str) -> str:
    return "(" + " + ".join(
        f"CASE WHEN {u} >= {t!r}::DOUBLE THEN 1 ELSE 0 END" for t in POISSON_ONE_CDF
    ) + ")"


LOG_SQL = f"""{roles.REWARDS_SQL}, {_policy_rows_sql()},
    matrix AS (SELECT question_key, context, split, [{", ".join(f"max(reward) FILTER (action_id = '{a}')" for a in _A)}] AS rewards
               FROM rewards GROUP BY question_key, context, split),
    rounds AS (
      SELECT *, {uniform_sql("question_key", "stream + draw_no")} AS u FROM (
        SELECT *, unnest(range(1, m + 1)) AS draw_no FROM (
          SELECT *, {_poisson_sql("u0")} AS m FROM (
            SELECT matrix.*, policy, policy_no, p, cum, seed, seed * 1000 + policy_no * 100 AS stream,
                   {uniform_sql("question_key", "seed * 1000 + policy_no * 100")} AS u0
            FROM matrix, pol, (VALUES {", ".join(f"({s})" for s in SEEDS)}) s(seed))) WHERE m > 0)),
    log AS (
      SELECT policy AS behavior_policy, seed AS simulation_seed, question_key, draw_no, context, split, arm,
             p[arm + 1] AS action_propensity, rewards[arm + 1] AS observed_reward
      FROM (SELECT *, least(6, len(list_filter(cum, lambda c: u >= c))) AS arm FROM rounds))"""


def log(spark, folder):
    matrix = roles.reward_vectors(spark, folder)
    return ope.replay_log(matrix, ope.behaviour_policies(matrix), SEEDS)


@plan(
    "behaviour_propensities",
    f"""WITH {roles.REWARDS_SQL}, {_policy_rows_sql()}
    SELECT policy, [{", ".join(f"'{a}'" for a in _A)}][i] AS action_id, p[i] AS propensity FROM (SELECT *, unnest(range(1, 8)) AS i FROM pol)""",
)
def behaviour_propensities(spark, folder):
    return ope.propensity_rows(ope.behaviour_policies(roles.reward_vectors(spark, folder)))


@plan("bandit_log", f"WITH {LOG_SQL} SELECT * FROM log")
def bandit_log(spark, folder):
    return log(spark, folder)


@plan(
    "log_violations",
    f"""WITH {LOG_SQL}, d AS (SELECT question_key, draw_no, behavior_policy, simulation_seed,
        CASE WHEN question_key % 17 = 0 THEN 0 WHEN question_key % 19 = 0 THEN 1.5 WHEN question_key % 23 = 0 THEN 0.0000001 ELSE action_propensity END AS p,
        CASE WHEN question_key % 29 = 0 THEN NULL ELSE observed_reward END AS r FROM log)
    SELECT behavior_policy, simulation_seed, violation, count(*) AS n FROM (
      SELECT behavior_policy, simulation_seed, unnest(list_filter([CASE WHEN p <= 0 OR p > 1 THEN 'propensity_range' END,
        CASE WHEN p > 0 AND p < 0.000001 THEN 'propensity_floor' END, CASE WHEN r IS NULL THEN 'missing_reward' END], lambda x: x IS NOT NULL)) AS violation FROM d)
    GROUP BY ALL""",
)
def log_violations(spark, folder):
    """A log with some rounds damaged by rule, then checked."""
    key = F.col("question_key")
    damaged = log(spark, folder).withColumns(
        {
            "action_propensity": F.when(key % 17 == 0, 0.0)
            .when(key % 19 == 0, 1.5)
            .when(key % 23 == 0, 1e-7)
            .otherwise(F.col("action_propensity")),
            "observed_reward": F.when(key % 29 != 0, F.col("observed_reward")),
        }
    )
    return (
        ope.log_violations(damaged, "behavior_policy", "simulation_seed")
        .groupBy("behavior_policy", "simulation_seed", "violation")
        .agg(F.count(F.lit(1)).alias("n"))
    )


@plan(
    "coverage_diagnostics",
    f"""WITH {LOG_SQL}, w AS (SELECT *, CASE WHEN arm = 3 THEN 1 / action_propensity ELSE 0 END AS w FROM log)
    SELECT behavior_policy, simulation_seed, count(*) AS n_rounds, round(min(action_propensity), 6) AS min_propensity, round(avg(action_propensity), 6) AS mean_propensity,
      round(max(action_propensity), 6) AS max_propensity, round(quantile_cont(action_propensity, 0.05), 6) AS propensity_p05,
      round(quantile_cont(action_propensity, 0.5), 6) AS propensity_p50, round(quantile_cont(action_propensity, 0.95), 6) AS propensity_p95, round(sum(w) * sum(w) / nullif(sum(w * w), 0), 4) AS effective_sample_size, count(DISTINCT arm) AS n_actions
    FROM w GROUP BY ALL""",
)
def coverage_diagnostics(spark, folder):
    return ope.coverage_diagnostics(log(spark, folder), F.lit(3))


@plan(
    "regret_curve",
    f"""WITH {LOG_SQL}, b AS (SELECT question_key, list_max(rewards) AS best FROM matrix)
    SELECT behavior_policy, simulation_seed, question_key, draw_no, count(*) OVER w AS n_rounds,
      (sum(reward) OVER w)::DOUBLE / 1e9::DOUBLE AS cumulative_reward, (sum(regret) OVER w)::DOUBLE / 1e9::DOUBLE AS cumulative_regret
    FROM (SELECT *, CAST(round(observed_reward * 1e9) AS BIGINT) AS reward, CAST(round((best - observed_reward) * 1e9) AS BIGINT) AS regret
      FROM log JOIN b USING (question_key))
    WINDOW w AS (PARTITION BY behavior_policy, simulation_seed ORDER BY question_key, draw_no)""",
)
def regret_curve(spark, folder):
    """Cumulative reward, and regret against the question's best arm, over every log."""
    matrix = roles.reward_vectors(spark, folder)
    ranged = ope.in_ranges(matrix.select("question_key", "context", "split", "rewards"))
    return ope.replayed_regret_curve(ranged, ope.behaviour_policies(matrix), SEEDS)


TARGET_NAMES = ["always_bm25", "always_hybrid", "always_hybrid_rerank", "context_best"]


def targets(matrix):
    """Three constant policies and the best arm per context on the dev split."""
    arms = matrix.filter("split = 'dev'").select(
        "context", F.posexplode("rewards").alias("arm", "reward")
    )
    means = arms.groupBy("context", "arm").agg(F.round(F.avg("reward"), 6).alias("mean"))
    best = means.groupBy("context").agg(
        F.max_by("arm", F.struct("mean", -F.col("arm"))).alias("arm")
    )
    # One entry per context bin.
    lookup = best.agg(F.map_from_entries(F.collect_list(F.struct("context", "arm")))).scalar()
    chosen = F.coalesce(F.try_element_at(lookup, F.col("context")), F.lit(0))
    return dict(zip(TARGET_NAMES, (F.lit(1), F.lit(3), F.lit(4), chosen), strict=True))


TARGETS_SQL = """
    best AS (SELECT context, arm AS best_arm FROM (SELECT *, row_number() OVER (PARTITION BY context ORDER BY mean DESC, arm) AS rn FROM (
      SELECT context, arm, round(avg(rewards[arm + 1]), 6) AS mean FROM (SELECT *, unnest(range(0, 7)) AS arm FROM matrix WHERE split = 'dev') GROUP BY ALL)) WHERE rn = 1),
    tgt AS (SELECT context, target, CASE target WHEN 'always_bm25' THEN 1 WHEN 'always_hybrid' THEN 3 WHEN 'always_hybrid_rerank' THEN 4 ELSE coalesce(best_arm, 0) END AS target_arm
      FROM (SELECT DISTINCT context FROM matrix) c LEFT JOIN best USING (context)
      CROSS JOIN (VALUES ('always_bm25'), ('always_hybrid'), ('always_hybrid_rerank'), ('context_best')) t(target))"""

_ESTIMATORS = (
    {"dm": "avg(q)", "ips": "avg(w * r)"}
    | {f"ips_clip_{c:g}": f"avg(least(w, {c}::DOUBLE) * r)" for c in ope.CLIPS}
    | {"snips": "sum(w * r) / nullif(sum(w), 0)", "dr": "avg(q + w * (r - ql))"}
    | {f"dr_clip_{c:g}": f"avg(q + least(w, {c}::DOUBLE) * (r - ql))" for c in ope.DR_CLIPS}
    | {
        f"switch_dr_{t:g}": f"avg(q + CASE WHEN w <= {t}::DOUBLE THEN w ELSE 0 END * (r - ql))"
        for t in ope.SWITCH_TAUS
    }
)
ESTIMATES_SQL = f"""{LOG_SQL}, {TARGETS_SQL},
    cell AS (SELECT behavior_policy, simulation_seed, context, arm, avg(observed_reward) AS m FROM log WHERE split = 'dev' GROUP BY ALL),
    fb AS (SELECT behavior_policy, simulation_seed, avg(observed_reward) AS f FROM log WHERE split = 'dev' GROUP BY ALL),
    est_rows AS (
      SELECT l.behavior_policy, l.simulation_seed, target, observed_reward AS r,
             CASE WHEN l.arm = target_arm THEN 1 / action_propensity ELSE 0 END AS w,
             coalesce(a.m, f, 0) AS q, coalesce(b.m, f, 0) AS ql
      FROM log l JOIN tgt USING (context)
      LEFT JOIN fb ON fb.behavior_policy = l.behavior_policy AND fb.simulation_seed = l.simulation_seed
      LEFT JOIN cell a ON a.behavior_policy = l.behavior_policy AND a.simulation_seed = l.simulation_seed AND a.context = l.context AND a.arm = target_arm
      LEFT JOIN cell b ON b.behavior_policy = l.behavior_policy AND b.simulation_seed = l.simulation_seed AND b.context = l.context AND b.arm = l.arm
      WHERE l.split <> 'dev'),
    wide AS (SELECT behavior_policy, simulation_seed, target, count(*) AS n, {", ".join(f'{e} AS "{n}"' for n, e in _ESTIMATORS.items())} FROM est_rows GROUP BY ALL),
    estimates AS ({" UNION ALL ".join(f"SELECT behavior_policy, simulation_seed, target, n, '{n}' AS estimator, " + chr(34) + n + chr(34) + " AS estimate FROM wide" for n in _ESTIMATORS)}),
    truth AS (SELECT target, avg(rewards[target_arm + 1]) AS true_value FROM matrix JOIN tgt USING (context) WHERE split <> 'dev' GROUP BY ALL)"""


def estimates(spark, folder):
    matrix = roles.reward_vectors(spark, folder)
    fit, held_out = F.col("split") == "dev", F.col("split") != "dev"
    return ope.estimate_values(log(spark, folder), targets(matrix), fit, held_out)


def truth(spark, folder):
    matrix = roles.reward_vectors(spark, folder)
    return ope.true_values(matrix, targets(matrix), F.col("split") != "dev")


def _estimates_of(prefix: str):
    def build(spark, folder):
        return (
            estimates(spark, folder)
            .filter(F.col("estimator").rlike(prefix))
            .withColumn("estimate", F.round("estimate", 6))
        )

    return build


for _name, _pattern in {
    "ope_dm": "^dm$",
    "ope_ips": "^ips",
    "ope_snips": "^snips$",
    "ope_dr": "^dr",
    "ope_switch": "^switch",
}.items():
    plan(
        _name,
        f"""WITH {ESTIMATES_SQL} SELECT behavior_policy, simulation_seed, target, n, estimator, round(estimate, 6) AS estimate
        FROM estimates WHERE regexp_matches(estimator, '{_pattern}')""",
    )(_estimates_of(_pattern))


@plan(
    "policy_true_values",
    f"WITH {LOG_SQL}, {TARGETS_SQL} SELECT target, round(avg(rewards[target_arm + 1]), 6) AS true_value FROM matrix JOIN tgt USING (context) WHERE split <> 'dev' GROUP BY ALL",
)
def policy_true_values(spark, folder):
    return truth(spark, folder).withColumn("true_value", F.round("true_value", 6))


@plan(
    "ope_errors",
    f"""WITH {ESTIMATES_SQL} SELECT behavior_policy, target, estimator, round(avg(estimate - true_value), 6) AS bias, round(var_pop(estimate), 6) AS variance,
      round(avg((estimate - true_value) * (estimate - true_value)), 6) AS mse, round(avg(abs(estimate - true_value)), 6) AS absolute_error,
      round(avg(abs((estimate - true_value) / nullif(true_value, 0))), 6) AS relative_error
    FROM estimates JOIN truth USING (target) GROUP BY ALL""",
)
def ope_errors(spark, folder):
    return ope.estimator_errors(estimates(spark, folder), truth(spark, folder))


#: The log cut into nested samples, each a log of its own whose seed carries the size.
_SAMPLED_SQL = LOG_SQL.replace("    log AS (", "    whole_log AS (") + f""",
    placed AS (SELECT *, row_number() OVER (PARTITION BY behavior_policy, simulation_seed
      ORDER BY {uniform_sql("question_key", f"{ope.SAMPLE_STREAM} + draw_no")}, question_key, draw_no) AS place FROM whole_log),
    log AS (SELECT placed.* REPLACE (simulation_seed * 10000 + size AS simulation_seed) FROM placed
      JOIN (VALUES {", ".join(f"({n})" for n in ope.SAMPLE_SIZES)}) z(size) ON place <= size)"""


@plan(
    "ope_sample_sizes",
    f"""WITH {ESTIMATES_SQL.replace(LOG_SQL, _SAMPLED_SQL)} SELECT behavior_policy, target, estimator, simulation_seed % 10000 AS sample_size,
      round(avg(estimate - true_value), 6) AS bias, round(var_pop(estimate), 6) AS variance,
      round(avg((estimate - true_value) * (estimate - true_value)), 6) AS mse, round(avg(abs(estimate - true_value)), 6) AS absolute_error,
      round(avg(abs((estimate - true_value) / nullif(true_value, 0))), 6) AS relative_error
    FROM estimates JOIN truth USING (target) GROUP BY ALL""",
)
def ope_sample_sizes(spark, folder):
    """Errors of every estimator on nested samples of the declared sizes."""
    matrix = roles.reward_vectors(spark, folder)
    fit, held_out = F.col("split") == "dev", F.col("split") != "dev"
    found = ope.estimate_values(
        ope.nested_samples(log(spark, folder)), targets(matrix), fit, held_out, (*ope.LOG_KEYS, "sample_size")
    )
    return ope.estimator_errors(found, truth(spark, folder), "sample_size")


#: Rounds of the samples whose intervals are held against the truth: a declared size.
COVERAGE_SIZE = 500


@plan(
    "ope_coverage",
    f"""WITH {ESTIMATES_SQL.replace(LOG_SQL, _SAMPLED_SQL).replace("SELECT l.behavior_policy, l.simulation_seed, target,", "SELECT l.behavior_policy, l.simulation_seed, place, target,", 1)},
    drawn AS (SELECT behavior_policy, simulation_seed, replicate, target, q, ql, w, r, {_poisson_sql("u")} AS m FROM (
      SELECT *, {uniform_sql("place", f"(simulation_seed // 10000 * 10 + list_position({list(ope.BEHAVIOURS)!r}, behavior_policy)) * 100000 + replicate")} AS u
      FROM est_rows, range(1, {ope.RESAMPLES + 1}) t(replicate) WHERE simulation_seed % 10000 = {COVERAGE_SIZE} AND r IS NOT NULL)),
    sums AS (SELECT behavior_policy, simulation_seed, replicate, target, sum(m * w * r) / nullif(sum(m), 0) AS ips, sum(m * w * r) / nullif(sum(m * w), 0) AS snips,
      sum(m * (q + w * (r - ql))) / nullif(sum(m), 0) AS dr FROM drawn GROUP BY ALL),
    tall AS (SELECT behavior_policy, simulation_seed, target, 'ips' AS estimator, ips AS e FROM sums UNION ALL SELECT behavior_policy, simulation_seed, target, 'snips', snips FROM sums
      UNION ALL SELECT behavior_policy, simulation_seed, target, 'dr', dr FROM sums),
    bounds AS (SELECT behavior_policy, simulation_seed, target, estimator, quantile_cont(e, 0.025) AS low, quantile_cont(e, 0.975) AS high FROM tall GROUP BY ALL)
    SELECT behavior_policy, target, estimator, count(low) AS n_intervals, round(avg(CASE WHEN round(true_value, 6) BETWEEN round(low, 6) AND round(high, 6) THEN 1 WHEN low IS NOT NULL THEN 0 END), 6) AS coverage,
      round(avg(high - low), 6) AS mean_width FROM bounds JOIN truth USING (target) GROUP BY ALL""",
)
def ope_coverage(spark, folder):
    """Coverage of bootstrap intervals on samples of one declared size."""
    matrix = roles.reward_vectors(spark, folder)
    fit, held_out = F.col("split") == "dev", F.col("split") != "dev"
    sample = ope.nested_samples(log(spark, folder), (COVERAGE_SIZE,))
    return ope.interval_coverage(sample, targets(matrix), truth(spark, folder), fit, held_out)


@plan(
    "ope_ranking",
    f"""WITH {ESTIMATES_SQL}, k AS (SELECT * FROM estimates JOIN truth USING (target)),
    p AS (SELECT a.behavior_policy, a.estimator, sign(a.estimate - b.estimate) = sign(a.true_value - b.true_value) AS same, abs(a.true_value - b.true_value) AS gap
      FROM k a JOIN k b ON a.behavior_policy = b.behavior_policy AND a.simulation_seed = b.simulation_seed AND a.estimator = b.estimator AND a.target < b.target)
    SELECT behavior_policy, estimator, round(avg(same::INT), 6) AS ranking_accuracy, round(avg(CASE WHEN gap <= 0.05 THEN same::INT END), 6) AS close_pair_accuracy
    FROM p GROUP BY ALL""",
)
def ope_ranking(spark, folder):
    return ope.ranking_accuracy(estimates(spark, folder), truth(spark, folder), TARGET_NAMES)


# ------------------------------------------------------------ learned policies
CONTEXTS = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
FEATURES = ["magnitude", "period", *[f"is_{i}" for i in range(len(CONTEXTS))]]


def featured(spark, folder):
    """Reward vectors with features known before any action is taken."""
    key = F.col("question_key")
    named = {
        "magnitude": (key % 97) / 97.0,
        "period": (key % 4) / 3.0,
        **{f"is_{i}": (F.col("context") == c).cast("double") for i, c in enumerate(CONTEXTS)},
    }
    rows = roles.reward_vectors(spark, folder).withColumns(named)
    return rows.withColumn("x", F.array(F.lit(1.0), *FEATURES))


@plan(
    "scaled_features",
    f"""WITH {roles.OUTCOMES_SQL}, q AS (SELECT DISTINCT question_key, split, (question_key % 97) / 97 AS magnitude, (question_key % 4) / 3 AS period FROM outcomes),
    s AS (SELECT avg(magnitude) AS m1, stddev_samp(magnitude) AS s1, avg(period) AS m2, stddev_samp(period) AS s2 FROM q WHERE split = 'dev')
    SELECT question_key, split, round((magnitude - m1) / s1, 6) AS magnitude, round((period - m2) / s2, 6) AS period FROM q, s""",
)
def scaled_features(spark, folder):
    rows = featured(spark, folder).select("question_key", "split", "magnitude", "period")
    scaled = features.standardize(rows, ["magnitude", "period"])
    return scaled.select(
        "question_key",
        "split",
        F.round(F.get("scaled", F.lit(0)), 6).alias("magnitude"),
        F.round(F.get("scaled", F.lit(1)), 6).alias("period"),
    )


def _bandit(algorithm: str, parameter: float):
    def build(spark, folder):
        return bandits.learn_in_batches(featured(spark, folder), algorithm, parameter)

    return build


for _algorithm, _parameter in {"linucb": 1.0, "thompson": 0.25, "epsilon_greedy": 0.1}.items():
    plan(f"{_algorithm}_batches")(_bandit(_algorithm, _parameter))


def _router_rows(spark, folder):
    rows = featured(spark, folder)
    best = rows.select(
        "question_id",
        policies.arm_name(bandits.first_argmax(F.col("rewards"))).alias("best_action"),
    )
    return routers.labelled(rows, best)


@plan("supervised_router")
def supervised_router(spark, folder):
    """Tree and logistic candidates picked on validation, reported on test."""
    rows = _router_rows(spark, folder).persist()
    n_rows = rows.filter("split = 'dev'").count()
    grid = [
        c
        for c in routers.candidates(n_rows, ("multinomial_logistic", "decision_tree"))
        if "C=" in c[0] or "min_leaf=10" in c[0]
    ]
    name, model = routers.select_router(rows, FEATURES, grid)
    return routers.router_report(name, routers.routed(model, rows), "split")


@plan("calibrated_confidence")
def calibrated_confidence(spark, folder):
    """Isotonic calibration of answer confidence, fitted on validation."""
    rows = roles.scored(spark, folder).select(
        "question_id", "action_id", "split", "confidence", "numeric_correctness"
    ).filter("numeric_correctness is not null")
    return routers.calibrate(rows, "confidence", "numeric_correctness").select(
        "question_id", "action_id", "split", "confidence", F.round("calibrated", 6).alias("calibrated")
    )
