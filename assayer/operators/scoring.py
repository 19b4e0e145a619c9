"""Scoring outcomes on every dimension, and the rewards built from them.

An outcome row carries bounded arrays (retrieved, gold and cited chunk ids), so
every scorer is a Column expression and scoring a table is one narrow pass. A
dimension that cannot be measured is NULL, never zero.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer import vocabulary as v
from assayer.functions import text as tx
from assayer.functions.once import with_once

RETRIEVAL_K = 10
RELATIVE_TOLERANCE = 0.01
SCORER_VERSION = "0.1.0"

# Scorer that owns each dimension, in evaluation order.
DIMENSIONS = {
    "retrieval_recall": "RetrievalRecallScorer",
    "retrieval_hit": "RetrievalRecallScorer",
    "retrieval_precision": "RetrievalRecallScorer",
    "citation_precision": "CitationSupportScorer",
    "citation_coverage": "CitationSupportScorer",
    "numeric_correctness": "NumericalAnswerScorer",
    "abstention_precision": "AbstentionScorer",
    "cost_score": "CostScorer",
    "latency_score": "LatencyScorer",
    "policy_compliance": "WorkflowViolationScorer",
}


def is_answered() -> Column:
    return F.coalesce(F.col("answer"), F.lit("")) != ""


def estimate_cost(prices: Mapping[str, tuple[float, float]]) -> tuple[Column, Column]:
    """USD cost (NULL when unpriced) and whether the price is known.

    ``prices`` maps a lower-case model name to USD per million input and output
    tokens. Retries are billed like first attempts.
    """
    table = F.create_map(
        *[
            part
            for name, (cost_in, cost_out) in prices.items()
            for part in (
                F.lit(name.strip().lower()),
                F.struct(F.lit(float(cost_in)).alias("i"), F.lit(float(cost_out)).alias("o")),
            )
        ]
    )
    price = F.try_element_at(table, F.lower(F.trim(F.coalesce("model", F.lit("")))))
    usd = (
        (F.col("input_tokens") + F.col("retry_input_tokens")) * price["i"]
        + (F.col("output_tokens") + F.col("retry_output_tokens")) * price["o"]
    ) / 1_000_000
    return usd, price.isNotNull()


def prepare(outcomes: DataFrame) -> DataFrame:
    """Add the quantities several scorers share, each computed once."""
    top = F.array_distinct(F.slice("retrieved_chunk_ids", 1, RETRIEVAL_K))
    gold = F.array_distinct("gold_chunk_ids")
    figures = F.struct(
        tx.numbers(F.col("reference_answer")).alias("expected"),
        tx.numbers(F.col("answer")).alias("actual"),
        top.alias("top"),
        gold.alias("gold"),
    )
    return with_once(outcomes, "__once", figures).select(
        *outcomes.columns,
        F.col("__once.top").alias("top"),
        F.col("__once.gold").alias("gold"),
        F.col("__once.expected").alias("expected_numbers"),
        F.col("__once.actual").alias("answer_numbers"),
    ).select(
        "*",
        F.size("gold").alias("n_gold"),
        F.size("top").alias("n_top"),
        F.size(F.array_intersect("gold", "top")).alias("n_found"),
        F.size("cited_chunk_ids").alias("n_cited"),
        F.size("hallucinated_citations").alias("n_hallucinated"),
    )


def _matches(target: Column, actual: Column) -> Column:
    near = F.abs(actual - target) / F.nullif(F.abs(target), F.lit(0.0)) <= RELATIVE_TOLERANCE
    return F.when(target == 0, F.abs(actual) <= RELATIVE_TOLERANCE).otherwise(near)


def dimension_columns(
    cost_reference: float = v.COST_REFERENCE_USD,
    latency_reference: float = v.LATENCY_REFERENCE_MS,
) -> dict[str, Column]:
    """Every dimension as a Column over a prepared outcome table."""
    measurable = F.col("n_gold") > 0
    found = F.col("n_found") > 0
    abstained = F.col("abstained")
    cited_total = F.col("n_cited") + F.col("n_hallucinated")
    target = F.get("expected_numbers", F.lit(0))
    has_reference = F.coalesce(F.col("reference_answer"), F.lit("")) != ""
    numeric = has_reference & ~abstained & (F.size("expected_numbers") > 0)
    matched = F.exists("answer_numbers", lambda actual: _matches(target, actual))

    def scaled(value: Column, reference: float) -> Column:
        share = F.least(value / reference, F.lit(1.0)) if reference else F.lit(0.0)
        return 1.0 - share

    return {
        "retrieval_recall": F.when(measurable, F.col("n_found") / F.col("n_gold")),
        "retrieval_hit": F.when(measurable, found.cast("double")),
        "retrieval_precision": F.when(
            measurable, F.coalesce(F.try_divide(F.col("n_found"), F.col("n_top")), F.lit(0.0))
        ),
        "citation_precision": F.when(
            ~abstained & (cited_total > 0), F.try_divide(F.col("n_cited"), cited_total)
        ),
        "citation_coverage": F.when(~abstained, (cited_total > 0).cast("double")),
        "numeric_correctness": F.when(numeric, matched.cast("double")),
        "abstention_precision": F.when(abstained & measurable, (~found).cast("double")),
        "cost_score": F.when(
            F.coalesce("pricing_known", F.lit(False)),
            scaled(F.coalesce("estimated_cost_usd", F.lit(0.0)), cost_reference),
        ),
        "latency_score": F.when(
            F.col("latency_ms").isNotNull(), scaled(F.col("latency_ms"), latency_reference)
        ),
        "policy_compliance": (F.col("error_status") == "ok").cast("double"),
    }


def score_wide(outcomes: DataFrame) -> DataFrame:
    """One row per outcome with a column per dimension (NULL = not measurable)."""
    columns = dimension_columns()
    return prepare(outcomes).select(
        *outcomes.columns, *[columns[name].alias(name) for name in DIMENSIONS]
    )


def score_tall(scored: DataFrame, *keys: str) -> DataFrame:
    """One row per outcome and measured dimension."""
    cells = F.array(
        *[
            F.struct(
                F.lit(scorer).alias("scorer_name"),
                F.lit(name).alias("dimension"),
                F.col(name).alias("raw_metric"),
            )
            for name, scorer in DIMENSIONS.items()
        ]
    )
    return (
        scored.select(*keys, F.explode(cells).alias("cell"))
        .select(*keys, "cell.*")
        .filter(F.col("raw_metric").isNotNull())
        .withColumn("normalized_score", F.col("raw_metric"))
        .withColumn("scorer_version", F.lit(SCORER_VERSION))
    )


def pivot_dimensions(tall: DataFrame, *keys: str) -> DataFrame:
    """Tall evaluation rows back to one row per outcome."""
    return tall.groupBy(*keys).agg(
        *[
            F.max(F.when(F.col("dimension") == name, F.col("normalized_score"))).alias(name)
            for name in DIMENSIONS
        ]
    )


def issue_array(latency_reference: float = v.LATENCY_REFERENCE_MS) -> Column:
    """Issues of a prepared outcome as ARRAY<STRUCT<category, severity>>."""
    measurable = F.col("n_gold") > 0
    found = F.col("n_found") > 0
    abstained, answered = F.col("abstained"), is_answered()
    wrong = dimension_columns()["numeric_correctness"] == 0.0
    status = F.col("error_status")

    def issue(condition: Column, category: Column | str, severity: Column | str) -> Column:
        category = F.lit(category) if isinstance(category, str) else category
        severity = F.lit(severity) if isinstance(severity, str) else severity
        return F.when(condition, F.struct(category.alias("category"), severity.alias("severity")))

    return F.array_compact(
        F.array(
            issue(measurable & ~found, "retrieval_failure", "error"),
            issue(F.col("n_hallucinated") > 0, "hallucinated_citation", "critical"),
            issue(
                ~abstained
                & answered
                & (F.col("action_id") != v.DIRECT)
                & (F.col("n_cited") == 0),
                "uncited_answer",
                "error",
            ),
            issue(wrong, "incorrect_numeric_answer", "error"),
            issue(measurable & abstained & found, "over_cautious_abstention", "warning"),
            issue(measurable & ~abstained & ~found & answered, "unsupported_answer", "critical"),
            issue(~F.coalesce("pricing_known", F.lit(False)), "cost_unmeasured", "info"),
            issue(F.col("latency_ms") > latency_reference, "slow_response", "warning"),
            issue(
                status != "ok",
                F.concat(F.lit("workflow_"), status),
                F.when(status.isin("rate_limited", "timeout"), "warning").otherwise("error"),
            ),
        )
    )


def detect_issues(outcomes: DataFrame, *keys: str) -> DataFrame:
    return (
        prepare(outcomes)
        .select(*keys, F.explode(issue_array()).alias("issue"))
        .select(*keys, "issue.*")
    )


# Taxonomy family of every issue category.
TAXONOMY = {
    "retrieval_failure": "retrieval",
    "hallucinated_citation": "generation",
    "uncited_answer": "generation",
    "incorrect_numeric_answer": "generation",
    "unsupported_answer": "routing",
    "over_cautious_abstention": "routing",
    "workflow_step_limit_exceeded": "agent",
}


def taxonomy(issues: DataFrame) -> DataFrame:
    """Attach the failure family; execution faults fall under ``operational``."""
    table = F.create_map(*[F.lit(x) for pair in TAXONOMY.items() for x in pair])
    family = F.coalesce(F.try_element_at(table, F.col("category")), F.lit("operational"))
    return issues.withColumn("family", family)


def outcome_violations(outcomes: DataFrame, *keys: str) -> DataFrame:
    """Rows breaking the record contract, one per broken rule."""
    answered = is_answered()
    reason = F.col("abstention_reason")
    rules = {
        "abstain_without_reason": (F.col("action_id") == v.ABSTAIN) & reason.isNull(),
        "answer_and_abstain": reason.isNotNull() & answered,
        "unknown_action": ~F.col("action_id").isin(*v.ACTIONS),
        "unknown_status": ~F.col("error_status").isin(*v.ERROR_STATUSES),
        "unknown_reason": ~reason.isin(*v.ABSTENTION_REASONS),
        "confidence_range": ~F.col("confidence").between(0.0, 1.0),
        "negative_cost": F.col("estimated_cost_usd") < 0,
        "negative_latency": F.col("latency_ms") < 0,
    }
    broken = F.array_compact(F.array(*[F.when(rule, name) for name, rule in rules.items()]))
    return outcomes.select(*keys, F.explode(broken).alias("violation"))


def reward_inputs(scored: DataFrame) -> DataFrame:
    """Quality, normalized cost and latency, hallucination and violation.

    Judge dimensions win where present. Unpriced cost counts as 0 and quality
    renormalizes over whatever was measured, so an abstention is judged on its
    retrieval alone; ``reward_inputs_strict`` offers the corrected reading.
    """

    def judged(name: str, fallback: str) -> Column:
        present = [F.col(c) for c in (name, fallback) if c in scored.columns]
        return F.coalesce(*present)

    correctness = judged("answer_correctness", "numeric_correctness")
    support = judged("evidence_support", "retrieval_recall")
    zero = F.lit(0.0)
    return scored.withColumns(
        {
            "quality": quality(correctness, support),
            "normalized_cost": F.coalesce(1.0 - F.col("cost_score"), zero),
            "normalized_latency": F.coalesce(1.0 - F.col("latency_score"), zero),
            "hallucination": F.coalesce(1.0 - F.col("citation_precision"), zero),
            "violation": F.coalesce(1.0 - F.col("policy_compliance"), zero),
        }
    )


def quality(correctness: Column, support: Column) -> Column:
    """Weighted mean over the parts that were measured; 0 when none was."""
    zero = F.lit(0.0)
    weight_c = F.when(correctness.isNotNull(), v.CORRECTNESS_WEIGHT).otherwise(zero)
    weight_s = F.when(support.isNotNull(), v.SUPPORT_WEIGHT).otherwise(zero)
    total = F.coalesce(correctness, zero) * weight_c + F.coalesce(support, zero) * weight_s
    return F.coalesce(F.try_divide(total, weight_c + weight_s), zero)


def reward_inputs_strict(scored: DataFrame) -> DataFrame:
    """Corrected variant: abstentions use their own precision as quality, and
    an unpriced outcome pays the full cost term."""
    base = reward_inputs(scored)
    return base.withColumns(
        {
            "quality": F.when(
                F.col("abstained"), F.coalesce("abstention_precision", F.lit(0.0))
            ).otherwise(F.col("quality")),
            "normalized_cost": F.when(F.col("cost_score").isNull(), 1.0).otherwise(
                F.col("normalized_cost")
            ),
        }
    )


def reward(weights: tuple[Column | float, ...]) -> Column:
    cost, latency, hallucination, violation = weights
    return (
        F.col("quality")
        - F.col("normalized_cost") * cost
        - F.col("normalized_latency") * latency
        - F.col("hallucination") * hallucination
        - F.col("violation") * violation
    )


def rewards_by_profile(
    inputs: DataFrame,
    *keys: str,
    profiles: Mapping[str, tuple[float, float, float, float]] = v.REWARD_PROFILES,
) -> DataFrame:
    """Reward with its penalty terms under every profile, profiles exploded in-row."""
    entries = F.array(
        *[
            F.struct(
                F.lit(f"{name}:{v.PROFILE_VERSION}").alias("profile"),
                *[
                    F.lit(float(w)).alias(part)
                    for part, w in zip(("wc", "wl", "wh", "wv"), weights, strict=True)
                ],
            )
            for name, weights in profiles.items()
        ]
    )
    terms = {
        "cost_penalty": F.col("normalized_cost") * F.col("p.wc"),
        "latency_penalty": F.col("normalized_latency") * F.col("p.wl"),
        "hallucination_penalty": F.col("hallucination") * F.col("p.wh"),
        "violation_penalty": F.col("violation") * F.col("p.wv"),
    }
    weights = tuple(F.col(f"p.{w}") for w in ("wc", "wl", "wh", "wv"))
    return inputs.withColumn("p", F.explode(entries)).select(
        *keys,
        F.col("p.profile").alias("profile"),
        F.round("quality", 9).alias("quality"),
        *[F.round(term, 9).alias(name) for name, term in terms.items()],
        F.round(reward(weights), 9).alias("reward"),
    )


def episode_steps(outcomes: DataFrame) -> DataFrame:
    """Canonical trace of an outcome: message, retrieval, generation, closing."""
    retrieved = F.size("retrieved_chunk_ids") > 0

    def step(kind: str, phase: str, detail: Column) -> Column:
        return F.struct(
            F.lit(kind).alias("kind"),
            F.lit(phase).alias("phase"),
            detail.cast("string").alias("detail"),
        )

    steps = F.array_compact(
        F.array(
            step("message", "query_received", F.col("question_id")),
            F.when(retrieved, step("tool_call", "retrieval_request", F.lit("retrieve"))),
            F.when(
                retrieved,
                step("tool_result", "retrieval_response", F.size("retrieved_chunk_ids")),
            ),
            step("llm_call", "answer_generation", F.col("answer")),
            F.when(
                F.col("abstained"), step("custom", "abstention", F.col("abstention_reason"))
            ).when(
                F.size("cited_chunk_ids") > 0, step("custom", "citation", F.size("cited_chunk_ids"))
            ),
        )
    )
    return outcomes.select(
        F.concat_ws("::", "experiment_id", "question_id", "action_id").alias("episode_id"),
        F.posexplode(steps).alias("step", "s"),
    ).select("episode_id", "step", "s.*")


def episodes(outcomes: DataFrame, questions: DataFrame, gold: DataFrame) -> DataFrame:
    """Outcome, question and gold side by side; orphan outcomes are dropped."""
    return outcomes.join(questions, "question_id").join(gold, "question_id", "left")
