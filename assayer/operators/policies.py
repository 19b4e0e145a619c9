"""Fixed, rule-based, oracle and constrained policies over outcome rewards.

Rewards are (question_id, action_id, split, reward, ...). Choices are ordered
maxima over structs, which combine map-side, so no group is ever sorted whole.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayer import vocabulary as v

DIGITS = 6


def action_index(action: Column) -> Column:
    return (F.array_position(F.array(*map(F.lit, v.ACTIONS)), action) - 1).cast("int")


def arm_name(index: Column) -> Column:
    return F.get(F.array(*map(F.lit, v.ACTIONS)), index)


def reward_matrix(rewards: DataFrame, *carry: str) -> DataFrame:
    """One row per question with a column per action."""
    return rewards.groupBy("question_id", *carry).agg(
        *[F.max(F.when(F.col("action_id") == a, F.col("reward"))).alias(a) for a in v.ACTIONS]
    )


def action_summary(rewards: DataFrame, *by: str) -> DataFrame:
    """Mean reward, cost, latency and answer coverage per action."""
    return rewards.groupBy(*by, "action_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.avg("reward"), DIGITS).alias("mean_reward"),
        F.round(F.avg("estimated_cost_usd"), 9).alias("mean_cost_usd"),
        F.round(F.avg("latency_ms"), DIGITS).alias("mean_latency_ms"),
        F.round(F.avg((~F.col("abstained")).cast("int")), DIGITS).alias("answer_coverage"),
    )


def fixed_policies(rewards: DataFrame, fit_split: str = "validation") -> DataFrame:
    """(policy, action_id): constants plus the two derived from a fitting split."""
    index = action_index(F.col("action_id"))
    means = (
        rewards.filter(F.col("split") == fit_split)
        .groupBy("action_id")
        .agg(
            F.round(F.avg("reward"), DIGITS).alias("reward"),
            F.round(F.avg("estimated_cost_usd"), 9).alias("cost"),
        )
    )
    derived = means.agg(
        F.min_by(
            "action_id",
            F.when(
                # An unknown cost is not the least one.
                F.col("action_id").isin(*v.ANSWERING_ACTIONS) & F.col("cost").isNotNull(),
                F.struct("cost", index),
            ),
        ).alias("cheapest_answering"),
        F.max_by("action_id", F.struct("reward", -index)).alias("strongest_validation"),
    ).select(
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(name).alias("policy"), F.col(name).alias("action_id"))
                    for name in ("cheapest_answering", "strongest_validation")
                ]
            )
        ).alias("p")
    )
    constant = rewards.select("action_id").distinct().filter(F.col("action_id") != v.ABSTAIN)
    return constant.select(
        F.concat(F.lit("always_"), F.regexp_replace("action_id", r"^A\d_", "")).alias("policy"),
        "action_id",
    ).unionByName(derived.select("p.*"))


def fixed_policy_values(
    rewards: DataFrame, policies: DataFrame, split: str | None = None
) -> DataFrame:
    """Value of each fixed policy: the mean of its action's rewards."""
    scope = rewards if split is None else rewards.filter(F.col("split") == split)
    return policies.join(action_summary(scope), "action_id").withColumnRenamed(
        "mean_reward", "policy_value"
    )


def oracle(rewards: DataFrame, *carry: str) -> DataFrame:
    """Best action per question; equal rewards go to the lower arm."""
    index = action_index(F.col("action_id"))
    return rewards.groupBy("question_id", *carry).agg(
        F.max_by("action_id", F.struct("reward", -index)).alias("best_action"),
        F.max("reward").alias("best_reward"),
    )


def regret(chosen: DataFrame, best: DataFrame, *by: str) -> DataFrame:
    """Mean regret of (question_id, reward, by...) against the oracle."""
    return (
        chosen.join(best.select("question_id", "best_reward"), "question_id")
        .groupBy(*by)
        .agg(
            F.round(F.avg("reward"), DIGITS).alias("policy_value"),
            F.round(F.avg("best_reward"), DIGITS).alias("oracle_value"),
            F.round(F.avg(F.col("best_reward") - F.col("reward")), DIGITS).alias("mean_regret"),
        )
    )


def fit_thresholds(features: DataFrame) -> dict[str, float]:
    """Thresholds one standard deviation around the mean (our choice).

    Means and deviations merge across partitions; one row reaches the driver.
    """
    names = {
        "min_bm25_score": ("bm25_top1_score", -1),
        "min_dense_similarity": ("dense_top1_similarity", -1),
        "min_agreement": ("lexical_dense_agreement", -1),
        "min_margin": ("bm25_top1_top2_margin", -1),
        "strong_margin": ("bm25_top1_top2_margin", 1),
    }
    row = features.agg(
        *[
            F.round(F.avg(c) + side * F.coalesce(F.stddev_samp(c), F.lit(0.0)), DIGITS).alias(n)
            for n, (c, side) in names.items()
        ]
    ).first()
    return row.asDict()


def rule_route(features: DataFrame, thresholds: Mapping[str, float | None]) -> DataFrame:
    """First matching rule decides; an unfitted (NULL) threshold never matches."""
    t = {k: F.lit(x).cast("double") for k, x in thresholds.items()}
    weak = (F.col("bm25_top1_score") < t["min_bm25_score"]) & (
        F.col("dense_top1_similarity") < t["min_dense_similarity"]
    )
    conflict = F.col("lexical_dense_agreement") < t["min_agreement"]
    close = F.col("bm25_top1_top2_margin") < t["min_margin"]
    strong = F.col("bm25_top1_top2_margin") >= t["strong_margin"]
    multi_step = F.col("predicted_question_type").isin("synthesis", "comparison", "arithmetic")
    rules: list[tuple[Column, str, str, str | None]] = [
        (weak, "abstain_on_weak_retrieval", v.ABSTAIN, "insufficient_evidence"),
        (conflict & close, "abstain_on_conflicting_retrieval", v.ABSTAIN, "retrieval_disagreement"),
        (strong, "bm25_for_high_lexical_overlap", "A1_bm25", None),
        (conflict, "hybrid_on_retriever_disagreement", "A3_hybrid", None),
        (multi_step, "agentic_for_multi_step_questions", "A5_agentic", None),
    ]

    def decision(rule: str, action: str, reason: str | None) -> Column:
        return F.struct(
            F.lit(rule).alias("rule"),
            F.lit(action).alias("action_id"),
            F.lit(reason).cast("string").alias("abstention_reason"),
        )

    chain = F
    for condition, *outcome in rules:
        chain = chain.when(condition, decision(*outcome))
    chosen = chain.otherwise(decision("default", "A3_hybrid", None))
    return features.withColumn("d", chosen).select("*", "d.*").drop("d")


# Declared constrained-selection problems
# (name, sense, objective, constrained metric, operator, bound).
CONSTRAINTS = (
    ("quality_under_budget", "max", "answer_correctness", "mean_cost_usd", "<=", 0.02),
    ("cost_above_quality_floor", "min", "mean_cost_usd", "supported_answer_accuracy", ">=", 0.70),
    ("coverage_under_hallucination_cap", "max", "answer_coverage", "hallucination_rate", "<=", 0.05),
)


def constraint_metrics(scored: DataFrame) -> DataFrame:
    """Per-action metrics the declared constraints refer to."""
    supported = (F.col("numeric_correctness") == 1.0) & (
        F.coalesce("retrieval_hit", F.lit(0.0)) == 1.0
    )
    return scored.groupBy("action_id").agg(
        F.round(F.avg("numeric_correctness"), DIGITS).alias("answer_correctness"),
        F.round(F.avg(F.coalesce("estimated_cost_usd", F.lit(0.0))), 9).alias("mean_cost_usd"),
        F.round(
            F.avg(F.when(F.col("numeric_correctness").isNotNull(), supported.cast("int"))), DIGITS
        ).alias("supported_answer_accuracy"),
        F.round(F.avg((~F.col("abstained")).cast("int")), DIGITS).alias("answer_coverage"),
        F.round(
            F.avg((F.coalesce("citation_precision", F.lit(1.0)) < 1.0).cast("int")), DIGITS
        ).alias("hallucination_rate"),
    )


def constrained_selection(
    metrics: DataFrame, constraints: Sequence[tuple] = CONSTRAINTS
) -> DataFrame:
    """Best feasible action per constraint; NULL when none is feasible."""
    index = action_index(F.col("action_id"))
    picks = []
    for name, sense, objective, metric, comparison, bound in constraints:
        feasible = F.col(metric) <= bound if comparison == "<=" else F.col(metric) >= bound
        sign = 1 if sense == "max" else -1
        order = F.when(
            feasible & F.col(objective).isNotNull(), F.struct(F.col(objective) * sign, -index)
        )
        picks.append(
            F.struct(
                F.lit(name).alias("constraint"),
                F.max_by("action_id", order).alias("action_id"),
                F.count_if(feasible).alias("n_feasible"),
            ).alias(name)
        )
    return (
        metrics.agg(*picks)
        .select(F.explode(F.array(*[F.col(c[0]) for c in constraints])).alias("p"))
        .select("p.*")
    )


# Declared sensitivity grid.
SENSITIVITY_GRID = {
    "lambda_cost": (0.05, 0.15, 0.25, 0.40, 0.60),
    "lambda_latency": (0.05, 0.20, 0.35),
    "lambda_hallucination": (0.30, 0.40, 0.60, 1.00),
}


def weight_sensitivity(inputs: DataFrame, lambda_violation: float = 1.0) -> DataFrame:
    """Winning action at every point of the weight grid.

    A reward is linear in its weights, so its mean is too: the outcome table is
    averaged to one row per action and only those rows meet the grid.
    """
    parts = ("quality", "normalized_cost", "normalized_latency", "hallucination", "violation")
    means = inputs.groupBy("action_id").agg(*[F.avg(p).alias(p) for p in parts])
    points = means
    for name, values in SENSITIVITY_GRID.items():
        points = points.withColumn(name, F.explode(F.array(*map(F.lit, values))))
    value = F.round(
        F.col("quality")
        - F.col("lambda_cost") * F.col("normalized_cost")
        - F.col("lambda_latency") * F.col("normalized_latency")
        - F.col("lambda_hallucination") * F.col("hallucination")
        - lambda_violation * F.col("violation"),
        DIGITS,
    )
    index = action_index(F.col("action_id"))
    return (
        points.withColumn("value", value)
        .groupBy(*SENSITIVITY_GRID)
        .agg(
            F.max_by("action_id", F.struct("value", -index)).alias("winner"),
            F.max("value").alias("winner_value"),
        )
    )


def pareto_front(points: DataFrame, keys: list[str], cost: str, quality: str) -> DataFrame:
    """Rows no other row of the key beats on both cost and quality.

    A sort replaces the dominance self-join: a point stays when its quality
    exceeds the best seen at any lower cost.
    """
    best = points.groupBy(*keys, cost).agg(F.max(quality).alias("__best"))
    cheaper = Window.partitionBy(*keys).orderBy(cost).rowsBetween(Window.unboundedPreceding, -1)
    front = best.withColumn("__cheaper", F.max("__best").over(cheaper)).filter(
        F.col("__cheaper").isNull() | (F.col("__best") > F.col("__cheaper"))
    )
    return points.join(front, [*keys, cost]).filter(F.col(quality) == F.col("__best")).drop(
        "__best", "__cheaper"
    )
