"""Behaviour policies, logged feedback and off-policy value estimates."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayer import vocabulary as v
from assayer.functions.hashing import POISSON_ONE_CDF, poisson_one, uniform, uniform_array
from assayer.functions.once import with_once
from assayer.operators.policies import arm_name
from assayer.operators.running import carried, running_totals, running_totals_in_parts
from assayer.session import stored

K = len(v.ACTIONS)
MIN_PROPENSITY = 1e-6
BASE_ARM = 1
# Declared behaviour policies, clips and switch thresholds.
BEHAVIOURS = (
    "uniform_random",
    "epsilon_greedy_bm25",
    "cost_biased",
    "quality_biased",
    "poor_coverage",
)
EPSILONS = {"epsilon_greedy_bm25": 0.2, "poor_coverage": 0.02}
TEMPERATURE = 0.5
CLIPS = (1.0, 5.0, 10.0, 50.0, 100.0)
DR_CLIPS = (10.0, 100.0)
SWITCH_TAUS = (1.0, 10.0, 100.0)
PROPENSITY_QUANTILES = {"p05": 0.05, "p50": 0.5, "p95": 0.95}
DIGITS = 6
#: Declared sizes of the log samples, resamples of an interval, and the stream of the samples' draws.
SAMPLE_SIZES = (100, 250, 500, 1000, 2500, 5000)
RESAMPLES = 2000
SAMPLE_STREAM = 7_000_000
#: Questions of a range that a task replays, at most, about.
RANGE_QUESTIONS = 50_000
#: Rounds below the first bound of their draws, as multiples of the largest sample.
SAMPLE_SLACK = 2


def _epsilon_greedy(epsilon: float) -> Column:
    spread = epsilon / K
    return F.array(*[F.lit(spread + (1.0 - epsilon) * (i == BASE_ARM)) for i in range(K)])


def _softmax(values: Column, sign: int) -> Column:
    weights = F.transform(values, lambda x: F.exp(x * sign / TEMPERATURE))
    total = F.aggregate(weights, F.lit(0.0), lambda s, w: s + w)
    return F.transform(weights, lambda w: w / total)


def behaviour_policies(matrix: DataFrame, fit_split: str = "validation") -> DataFrame:
    """One row holding ``policies``: ARRAY<STRUCT<policy, probabilities>>.

    The softmax policies need per-arm means of normalized cost (whole matrix)
    and of reward (fitting split): one aggregate over ``rewards`` and ``costs``.
    """

    def means(name: str, scope: Column) -> Column:
        parts = [F.avg(F.when(scope, F.get(name, F.lit(arm)))) for arm in range(K)]
        return F.array(*[F.coalesce(F.round(m, DIGITS), F.lit(0.0)) for m in parts])

    summary = matrix.agg(
        means("costs", F.lit(True)).alias("costs"),
        means("rewards", F.col("split") == fit_split).alias("values"),
    )
    probabilities = {
        "uniform_random": F.array(*[F.lit(1.0 / K)] * K),
        "epsilon_greedy_bm25": _epsilon_greedy(EPSILONS["epsilon_greedy_bm25"]),
        "cost_biased": _softmax(F.col("costs"), -1),
        "quality_biased": _softmax(F.col("values"), 1),
        "poor_coverage": _epsilon_greedy(EPSILONS["poor_coverage"]),
    }
    return summary.select(
        F.array(
            *[
                F.struct(
                    F.lit(name).alias("policy"),
                    F.transform(p, lambda x: F.round(x, 9)).alias("probabilities"),
                )
                for name, p in probabilities.items()
            ]
        ).alias("policies")
    )


def propensity_rows(policies: DataFrame) -> DataFrame:
    """(policy, action_id, propensity)."""
    return (
        policies.select(F.inline("policies"))
        .select("policy", F.posexplode("probabilities").alias("arm", "propensity"))
        .select("policy", arm_name(F.col("arm")).alias("action_id"), "propensity")
    )


def replay_log(
    matrix: DataFrame,
    policies: DataFrame,
    seeds: tuple[int, ...] = tuple(range(1, 11)),
    kept: tuple[Column, ...] = (),
) -> DataFrame:
    """Log every behaviour policy over the whole outcome matrix, once per seed.

    ``matrix`` is (question_key BIGINT, context, split, rewards ARRAY<DOUBLE>).
    Rounds are drawn with replacement by giving each question a Poisson(1)
    number of rounds; the arm of a round is where its draw falls among the
    cumulative propensities. Everything is computed within the row. ``kept`` are
    further columns, expressions over the matrix, found once for a question.
    """
    cumulated = policies.select(
        F.transform(
            "policies", lambda p: F.struct(p["policy"], p["probabilities"], _running(p["probabilities"]).alias("cumulative"))
        )
    )
    asked = matrix.select("question_key", "context", "split", "rewards", *kept)
    plans = asked.withColumn("p", F.explode(cumulated.scalar()))
    numbered = plans.select(
        *asked.columns,
        F.col("p.policy").alias("behavior_policy"),
        F.col("p.probabilities").alias("probabilities"),
        F.col("p.cumulative").alias("cumulative"),
        F.array_position(F.array(*map(F.lit, BEHAVIOURS)), F.col("p.policy")).alias("policy_no"),
        F.explode(F.array(*map(F.lit, seeds))).alias("simulation_seed"),
    )
    stream = F.col("simulation_seed") * 1000 + F.col("policy_no") * 100
    counted = numbered.withColumn("stream", stream).withColumn(
        "luck", uniform(F.col("question_key"), F.col("stream"))
    )
    counted = counted.withColumn("n_rounds", poisson_one(F.col("luck")))
    # A question that draws no round explodes to nothing.
    most = len(POISSON_ONE_CDF)
    drawn = F.slice(F.array(*map(F.lit, range(1, most + 1))), F.lit(1), F.col("n_rounds"))
    rounds = counted.withColumn("draw_no", F.explode(drawn))
    draw = uniform(F.col("question_key"), F.col("stream") + F.col("draw_no"))
    arm = pick_arm(F.col("cumulative"), F.col("draw"))
    return (
        rounds.withColumn("draw", draw)
        .withColumn("arm", arm)
        .select(
            "behavior_policy",
            "simulation_seed",
            "question_key",
            "draw_no",
            "context",
            "split",
            "arm",
            F.get("probabilities", F.col("arm")).alias("action_propensity"),
            F.get("rewards", F.col("arm")).alias("observed_reward"),
            *asked.columns[4:],
        )
    )


def pick_arm(cumulative: Column, draw: Column) -> Column:
    """Index of the cumulative interval holding the draw, without a loop over the array."""
    passed = F.lit(0)
    for arm in range(K - 1):
        passed = passed + (draw >= F.get(cumulative, F.lit(arm))).cast("int")
    return passed


def _running(probabilities: Column) -> Column:
    grown = F.aggregate(
        probabilities,
        F.array().cast("array<double>"),
        lambda done, p: F.concat(done, F.array(F.coalesce(F.try_element_at(done, F.lit(-1)), F.lit(0.0)) + p)),
    )
    return F.when(F.size(probabilities) > 0, grown)


def in_ranges(matrix: DataFrame) -> DataFrame:
    """The matrix with ``__part``, its range of questions; a task has whole ranges.

    Logs that are replayed from it run by question within their task: they are as
    large as the matrix times policies and seeds, and are neither exchanged nor stored.
    """
    spark = matrix.sparkSession
    rows = matrix.count()
    parallel = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    parts = max(parallel, -(-rows // RANGE_QUESTIONS))
    # Ranges are drawn from a sample: a second reading must see the same ones.
    ranged = stored(
        matrix.repartitionByRange(parts, "question_key").withColumn("__part", F.spark_partition_id()),
        "regret-questions",
    )
    return ranged.repartitionById(parts, "__part")


def regret_curve(log: DataFrame, best_reward: Column) -> DataFrame:
    """Cumulative reward and regret after every round of each log.

    Rounds run by (question_key, draw_no), in ranges, so no log is one task's work: in those
    that ``in_ranges`` gave the log's matrix, or in ranges of the log's own rounds. Sums
    run over billionths, the digits of a reward, and are therefore exact.
    """

    ranged = "__part" in log.columns
    rounds = log.select(
        "behavior_policy",
        "simulation_seed",
        "question_key",
        "draw_no",
        F.lit(1).alias("round"),
        _billionths(F.col("observed_reward")).alias("reward"),
        _billionths(best_reward - F.col("observed_reward")).alias("regret"),
        *(["__part"] if ranged else []),
    )
    keys = ["behavior_policy", "simulation_seed"]
    run = running_totals_in_parts if ranged else running_totals
    totals = run(rounds, keys, ["question_key", "draw_no"], ["round", "reward", "regret"])
    return totals.select(
        *keys,
        "question_key",
        "draw_no",
        F.col("round_through").alias("n_rounds"),
        (F.col("reward_through") / 1e9).alias("cumulative_reward"),
        (F.col("regret_through") / 1e9).alias("cumulative_regret"),
    )


def replayed_regret_curve(
    ranged: DataFrame, policies: DataFrame, seeds: tuple[int, ...] = tuple(range(1, 11))
) -> DataFrame:
    """``regret_curve`` of the log that ``replay_log`` draws from a matrix in ranges, by arrays.

    The rounds are those of ``replay_log``, drawn for a batch of questions and one log at once;
    they come in the order of questions, so that they need not be sorted. A first reading
    finds the ranges' totals, a second one the sums from what stands before a range on.
    """
    probabilities = {p["policy"]: p["probabilities"] for p in policies.first()[0]}
    logs = [
        (policy, seed, seed * 1000 + (BEHAVIOURS.index(policy) + 1) * 100, np.cumsum(chances)[: K - 1])
        for policy, chances in probabilities.items()
        for seed in seeds
    ]
    rows = _amounts(ranged)
    sums = ["rounds", "reward", "regret"]

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[int, int], np.ndarray] = {}
        for part, *questions in _whole_keys(batches):
            for log, (_, _, stream, bounds) in enumerate(logs):
                _, _, amounts = _rounds(*questions, stream, bounds)
                found[part, log] = found.get((part, log), 0) + amounts.sum(axis=0)
        listed = [(part, log, *values.tolist()) for (part, log), values in found.items()]
        columns = list(zip(*listed, strict=True)) or [()] * 5
        types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["__part", "log", *sums]
        )

    totals = stored(
        rows.mapInArrow(total, "__part int, log int, rounds bigint, reward bigint, regret bigint"), "regret-totals"
    )
    parts = (totals.agg(F.max("__part")).first()[0] or 0) + 1
    # One row for each range and log, a thousandth of the questions.
    before: dict[int, np.ndarray] = {}
    for row in carried(totals, ["log"], "__part", sums, parts).collect():
        before.setdefault(row["__part"], np.zeros((len(logs), 3), dtype=np.int64))[row["log"]] = [row[s] for s in sums]
    shared = ranged.sparkSession.sparkContext.broadcast(before)

    def cumulate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        through: dict[int, np.ndarray] = {}
        for part, *questions in _whole_keys(batches):
            reached = through.setdefault(part, shared.value[part].copy())
            for log, (policy, seed, stream, bounds) in enumerate(logs):
                keys, draws, amounts = _rounds(*questions, stream, bounds)
                if not len(keys):
                    continue
                running = reached[log] + np.cumsum(amounts, axis=0)
                reached[log] = running[-1]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.repeat(np.array([policy], dtype=object), len(keys)), pa.string()),
                        pa.array(np.full(len(keys), seed, dtype=np.int32)),
                        pa.array(keys),
                        pa.array(draws.astype(np.int32)),
                        pa.array(running[:, 0]),
                        pa.array(running[:, 1] / 1e9),
                        pa.array(running[:, 2] / 1e9),
                    ],
                    names=names,
                )

    kinds = (
        "behavior_policy string, simulation_seed int, question_key bigint, draw_no int, n_rounds bigint, "
        "cumulative_reward double, cumulative_regret double"
    )
    names = [kind.split(" ")[0] for kind in kinds.split(", ")]
    return rows.mapInArrow(cumulate, kinds)


def _billionths(amount: Column) -> Column:
    return F.coalesce(F.round(amount * 1e9).cast("bigint"), F.lit(0).cast("bigint"))


def _amounts(ranged: DataFrame) -> DataFrame:
    """(__part, question_key, rewards, regrets) in order: billionths of every arm of a question."""
    arms = [F.get("rewards", F.lit(arm)) for arm in range(K)]
    best = ranged.filter("question_key is not null").withColumn("__best", F.array_max("rewards"))
    return best.select(
        "__part",
        "question_key",
        F.array(*[_billionths(r) for r in arms]).alias("rewards"),
        F.array(*[_billionths(F.col("__best") - r) for r in arms]).alias("regrets"),
    ).sortWithinPartitions("__part", "question_key")


def _whole_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(part, keys, rewards, regrets) of ordered rows; all rows of a key come together."""
    held: list[np.ndarray] = []

    def split(rows: np.ndarray) -> Iterator[tuple]:
        cuts = np.flatnonzero(rows[1:, 0] != rows[:-1, 0]) + 1
        for some in np.split(rows, cuts):
            yield int(some[0, 0]), some[:, 1], some[:, 2 : 2 + K], some[:, 2 + K :]

    for batch in batches:
        if not batch.num_rows:
            continue
        flat = [batch.column(i).flatten().to_numpy().reshape(batch.num_rows, K) for i in (2, 3)]
        ends = [batch.column(i).to_numpy()[:, None].astype(np.int64) for i in (0, 1)]
        rows = np.concatenate([*held, np.concatenate([*ends, *flat], axis=1)])
        # The last key may go on in the next batch.
        others = np.flatnonzero((rows[:, :2] != rows[-1, :2]).any(axis=1))
        last = int(others[-1]) + 1 if len(others) else 0
        held = [rows[last:]]
        if last:
            yield from split(rows[:last])
    if held:
        yield from split(held[0])


def _rounds(keys: np.ndarray, rewards: np.ndarray, regrets: np.ndarray, stream: int, bounds: np.ndarray):
    """(keys, draw numbers, (1, reward, regret)) of the rounds of one log, by key and draw number."""
    times = np.searchsorted(POISSON_ONE_CDF, uniform_array(keys, stream), side="right")
    at = np.repeat(np.arange(len(keys)), times)
    draws = np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times) + 1
    if (keys[1:] == keys[:-1]).any():
        order = np.lexsort((draws, keys[at]))
        at, draws = at[order], draws[order]
    arm = np.searchsorted(bounds, uniform_array(keys[at], stream + draws), side="right")
    return keys[at], draws, np.stack([np.ones(len(at), dtype=np.int64), rewards[at, arm], regrets[at, arm]], axis=1)


def log_violations(log: DataFrame, *keys: str) -> DataFrame:
    """Rounds unusable for importance weighting, one row per broken rule."""
    p = F.col("action_propensity")
    rules = {
        "propensity_range": p.isNull() | (p <= 0) | (p > 1),
        "propensity_floor": (p > 0) & (p < MIN_PROPENSITY),
        "missing_reward": F.col("observed_reward").isNull(),
    }
    if {"context_vector", "context_feature_names"} <= set(log.columns):
        names, vector = F.size("context_feature_names"), F.size("context_vector")
        rules["context_length"] = (names > 0) & (names != vector)
    broken = F.array_compact(F.array(*[F.when(r, n) for n, r in rules.items()]))
    return log.select(*keys, F.explode(broken).alias("violation"))


def coverage_diagnostics(log: DataFrame, target_arm: Column) -> DataFrame:
    """Propensity range, effective sample size and arm coverage per log."""
    weight = F.when(F.col("arm") == target_arm, 1.0 / F.col("action_propensity")).otherwise(0.0)
    return (
        log.withColumn("w", weight)
        .groupBy("behavior_policy", "simulation_seed")
        .agg(
            F.count(F.lit(1)).alias("n_rounds"),
            F.round(F.min("action_propensity"), DIGITS).alias("min_propensity"),
            F.round(F.avg("action_propensity"), DIGITS).alias("mean_propensity"),
            F.round(F.max("action_propensity"), DIGITS).alias("max_propensity"),
            # A log has a handful of propensities, so exact quantiles hold little.
            *[
                F.round(F.percentile("action_propensity", F.lit(q)), DIGITS).alias(f"propensity_{name}")
                for name, q in PROPENSITY_QUANTILES.items()
            ],
            F.round(
                F.try_divide(F.pow(F.sum("w"), F.lit(2.0)), F.sum(F.col("w") * F.col("w"))), 4
            ).alias("effective_sample_size"),
            F.count_distinct("arm").alias("n_actions"),
        )
    )


#: What tells one log from another.
LOG_KEYS = ("behavior_policy", "simulation_seed")


def log_cells(
    log: DataFrame,
    targets: dict[str, Column],
    fit: Column,
    evaluation: Column | None = None,
    keys: tuple[str, ...] = LOG_KEYS,
) -> DataFrame:
    """The log as sums per (policy, seed, context, arm taken, arms of the targets).

    A propensity depends on policy and arm alone, so these sums are all that the
    reward model and every estimator need. Rounds without a reward count in ``n``
    and not in ``n_rewarded``.
    """
    kept = F.lit(True) if evaluation is None else evaluation
    rewarded = F.col("observed_reward").isNotNull()
    arms = F.array(*[arm.cast("int") for arm in targets.values()])
    return log.groupBy(
        *keys,
        "context",
        "arm",
        "action_propensity",
        arms.alias("target_arms"),
    ).agg(
        F.count_if(fit & rewarded).alias("n_fit"),
        F.sum(F.when(fit, F.col("observed_reward"))).alias("sum_fit"),
        F.count_if(kept).alias("n"),
        F.count_if(kept & rewarded).alias("n_rewarded"),
        F.sum(F.when(kept, F.col("observed_reward"))).alias("sum_rewards"),
    )


def tabular_rewards(cells: DataFrame, keys: tuple[str, ...] = LOG_KEYS) -> DataFrame:
    """Reward model: mean logged reward per (log, context, arm) on the fitting rounds.

    Our choice where a boosted regressor is named: it has an exact SQL twin and
    is one mergeable aggregate. Adds ``model``, the means of the context's arms, and
    ``fallback``, the log's mean, which unseen cells and contexts take.
    """
    by_context = Window.partitionBy(*keys, "context")
    by_arm = Window.partitionBy(*keys, "context", "arm")
    mean = F.try_divide(F.sum("sum_fit").over(by_arm), F.sum("n_fit").over(by_arm))
    # A context has no more cells than arms times combinations of target arms.
    seen = F.when(F.col("mean").isNotNull(), F.struct("arm", "mean"))
    listed = F.array_distinct(F.collect_list(seen).over(by_context))
    known = cells.withColumn("mean", mean).withColumn("model", F.map_from_entries(listed))
    whole = cells.groupBy(*keys).agg(
        F.try_divide(F.sum("sum_fit"), F.sum("n_fit")).alias("fallback")
    )
    return known.drop("mean").join(whole, list(keys), "left")


def estimate_values(
    log: DataFrame,
    targets: dict[str, Column],
    fit: Column,
    evaluation: Column | None = None,
    keys: tuple[str, ...] = LOG_KEYS,
) -> DataFrame:
    """(keys, target, n, estimator, estimate) for every estimator.

    ``targets`` maps a policy name to the arm it takes, an expression over the
    log; ``fit`` marks the rounds of the reward model. The log is read once.
    """
    known = tabular_rewards(log_cells(log, targets, fit, evaluation, keys), keys)
    named = F.arrays_zip(F.array(*map(F.lit, targets)).alias("target"), F.col("target_arms").alias("target_arm"))
    cells = known.filter("n > 0").withColumn("t", F.explode(named))

    def predicted(arm: Column) -> Column:
        return F.coalesce(F.try_element_at("model", arm), F.col("fallback"), F.lit(0.0))

    weight = F.when(
        F.col("arm") == F.col("t.target_arm"), 1.0 / F.col("action_propensity")
    ).otherwise(0.0)
    base = cells.select(
        *keys,
        F.col("t.target").alias("target"),
        "n",
        "n_rewarded",
        F.coalesce("sum_rewards", F.lit(0.0)).alias("r"),
        weight.alias("w"),
        predicted(F.col("t.target_arm")).alias("q"),
        predicted(F.col("arm")).alias("q_logged"),
    )
    w, r, q = F.col("w"), F.col("r"), F.col("q")
    residual = r - F.col("n_rewarded") * F.col("q_logged")

    def weighted(used: Column) -> Column:
        return F.try_divide(F.sum(used * r), F.sum("n_rewarded"))

    def robust(used: Column) -> Column:
        return F.try_divide(F.sum(F.col("n_rewarded") * q + used * residual), F.sum("n_rewarded"))

    estimators: dict[str, Column] = {
        "dm": F.sum(F.col("n") * q) / F.sum("n"),
        "ips": weighted(w),
    }
    for clip in CLIPS:
        estimators[f"ips_clip_{clip:g}"] = weighted(F.least(w, F.lit(clip)))
    estimators["snips"] = F.try_divide(F.sum(w * r), F.sum(F.col("n") * w))
    estimators["dr"] = robust(w)
    for clip in DR_CLIPS:
        estimators[f"dr_clip_{clip:g}"] = robust(F.least(w, F.lit(clip)))
    for tau in SWITCH_TAUS:
        estimators[f"switch_dr_{tau:g}"] = robust(F.when(w <= tau, w).otherwise(0.0))
    wide = base.groupBy(*keys, "target").agg(
        F.sum("n").alias("n"), *[e.alias(n) for n, e in estimators.items()]
    )
    listed = F.array(
        *[F.struct(F.lit(n).alias("estimator"), F.col(n).alias("estimate")) for n in estimators]
    )
    return wide.select(*keys, "target", "n", F.inline(listed))


def true_values(
    matrix: DataFrame, targets: dict[str, Column], evaluation: Column | None = None
) -> DataFrame:
    """Full-information value of each target policy."""
    rows = matrix if evaluation is None else matrix.filter(evaluation)
    return (
        rows.agg(
            *[F.avg(F.get("rewards", arm.cast("int"))).alias(n) for n, arm in targets.items()]
        )
        .select(
            F.inline(
                F.array(
                    *[
                        F.struct(F.lit(n).alias("target"), F.col(n).alias("true_value"))
                        for n in targets
                    ]
                )
            )
        )
    )


def nested_samples(log: DataFrame, sizes: tuple[int, ...] = SAMPLE_SIZES) -> DataFrame:
    """Samples of each log, the smaller inside the larger: adds ``sample_size`` and ``place``.

    Rounds take their places by one draw each. Only rounds with draws below a bound are
    stored and ordered; the bound follows from a log's rounds, and grows until no log has
    fewer below it than the largest size wants.
    """
    draw = uniform(F.col("question_key"), F.lit(SAMPLE_STREAM) + F.col("draw_no"))
    most, keys, u = max(sizes), list(LOG_KEYS), F.col("__draw")
    # One row per log, whose keys may be null.
    counts = stored(log.groupBy(*keys).agg(F.count(F.lit(1)).alias("__rounds")), "log-rounds")
    rounds = F.broadcast(counts.select(*[F.col(k).alias(f"__{k}") for k in keys], "__rounds"))
    least = counts.agg(F.min("__rounds")).first()[0] or 1
    slack = SAMPLE_SLACK
    while True:
        wanted = float(slack * most)
        # Most rounds go before they meet the bound of their log.
        low = with_once(log, "__draw", draw).filter(u.isNull() | (u < wanted / least))
        below = u.isNull() | (u < F.lit(wanted) / F.col("__rounds"))
        same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys])
        kept = stored(low.join(rounds, same).filter(below).drop(*[f"__{k}" for k in keys]), "log-samples")
        full = kept.groupBy(*keys).agg(
            (F.count(F.lit(1)) >= F.least(F.lit(most), F.max("__rounds"))).alias("full")
        )
        if full.filter("full").count() == counts.count():
            break
        slack *= 4
    order = Window.partitionBy(*keys).orderBy(u, "question_key", "draw_no")
    placed = kept.drop("__rounds").withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most)
    listed = F.array(*map(F.lit, sizes))
    return placed.drop("__draw").withColumn("sample_size", F.explode(F.filter(listed, lambda s: s >= F.col("place"))))


def interval_coverage(
    sample: DataFrame,
    targets: dict[str, Column],
    truth: DataFrame,
    fit: Column,
    evaluation: Column,
    resamples: int = RESAMPLES,
    level: float = 0.95,
) -> DataFrame:
    """How often the bootstrap interval of an estimate holds the true value, and its mean width.

    ``sample`` is one sample of each log, of a declared size. A replicate weighs every
    round by a Poisson(1) draw of its place, so rounds fan out inside their task and are
    summed there: one row of sums per log, replicate and task is exchanged.
    """
    keys = list(LOG_KEYS)
    fitted = tabular_rewards(log_cells(sample, targets, fit, evaluation))
    models = fitted.groupBy(*keys, "context").agg(
        F.first("model").alias("model"), F.first("fallback").alias("fallback")
    )
    r, arm = F.col("observed_reward"), F.col("arm")

    def predicted(taken: Column) -> Column:
        return F.coalesce(F.try_element_at("model", taken.cast("int")), F.col("fallback"), F.lit(0.0))

    rows = sample.filter(evaluation & r.isNotNull()).join(models, [*keys, "context"])
    columns, names = [], []
    for number, taken in enumerate(targets.values()):
        w = F.when(arm == taken, 1.0 / F.col("action_propensity")).otherwise(0.0)
        columns += [
            w.alias(f"w{number}"),
            (w * r).alias(f"wr{number}"),
            (predicted(taken) + w * (r - predicted(arm))).alias(f"dr{number}"),
        ]
        names += [f"w{number}", f"wr{number}", f"dr{number}"]
    policy = F.array_position(F.array(*map(F.lit, BEHAVIOURS)), F.col("behavior_policy"))
    stream = (F.col("simulation_seed") * 10 + policy) * 100_000 + F.col("replicate")
    fanned = (
        rows.select(*keys, "place", *columns)
        .withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(resamples))))
        .withColumn("u", uniform(F.col("place"), stream))
        .withColumn("m", poisson_one(F.col("u")))
    )
    sums = fanned.groupBy(*keys, "replicate").agg(
        F.sum("m").alias("m"), *[F.sum(F.col("m") * F.col(n)).alias(n) for n in names]
    )
    estimates = F.array(
        *[
            F.struct(F.lit(t).alias("target"), F.lit(e).alias("estimator"), F.try_divide(F.col(a), F.col(b)).alias("estimate"))
            for i, t in enumerate(targets)
            for e, a, b in (("ips", f"wr{i}", "m"), ("snips", f"wr{i}", f"w{i}"), ("dr", f"dr{i}", "m"))
        ]
    )
    tail = (1.0 - level) / 2.0
    bounds = (
        sums.select(*keys, F.inline(estimates))
        .groupBy(*keys, "target", "estimator")
        .agg(
            F.percentile("estimate", F.lit(tail)).alias("low"),
            F.percentile("estimate", F.lit(1.0 - tail)).alias("high"),
        )
    )
    held = F.col("true_value").between(F.round("low", DIGITS), F.round("high", DIGITS))
    return (
        bounds.join(F.broadcast(truth.withColumn("true_value", F.round("true_value", DIGITS))), "target")
        .groupBy("behavior_policy", "target", "estimator")
        .agg(
            F.count(held).alias("n_intervals"),
            F.round(F.avg(held.cast("int")), DIGITS).alias("coverage"),
            F.round(F.avg(F.col("high") - F.col("low")), DIGITS).alias("mean_width"),
        )
    )


def estimator_errors(estimates: DataFrame, truth: DataFrame, *by: str) -> DataFrame:
    """Bias, variance, MSE and mean absolute and relative error over seeds, also by ``by``."""
    error = F.col("estimate") - F.col("true_value")
    return (
        estimates.join(F.broadcast(truth), "target")
        .groupBy("behavior_policy", "target", "estimator", *by)
        .agg(
            F.round(F.avg(error), DIGITS).alias("bias"),
            F.round(F.var_pop("estimate"), DIGITS).alias("variance"),
            F.round(F.avg(error * error), DIGITS).alias("mse"),
            F.round(F.avg(F.abs(error)), DIGITS).alias("absolute_error"),
            F.round(F.avg(F.abs(F.try_divide(error, F.col("true_value")))), DIGITS).alias(
                "relative_error"
            ),
        )
    )


def ranking_accuracy(
    estimates: DataFrame, truth: DataFrame, targets: list[str], close: float = 0.05
) -> DataFrame:
    """Share of policy pairs ordered as in truth, over all and close pairs.

    Target policies are few, so pairs are formed inside a row per log.
    """
    known = estimates.join(F.broadcast(truth), "target")
    keys = ["behavior_policy", "simulation_seed", "estimator"]
    wide = known.groupBy(*keys).agg(
        *[
            F.max(F.when(F.col("target") == t, F.struct("estimate", "true_value"))).alias(f"t{i}")
            for i, t in enumerate(targets)
        ]
    )
    pairs = F.explode(
        F.array(
            *[
                F.struct(F.col(f"t{i}").alias("a"), F.col(f"t{j}").alias("b"))
                for i in range(len(targets))
                for j in range(i + 1, len(targets))
            ]
        )
    )
    gap = F.col("p.a.true_value") - F.col("p.b.true_value")
    same = F.signum(F.col("p.a.estimate") - F.col("p.b.estimate")) == F.signum(gap)
    return (
        wide.select("behavior_policy", "estimator", pairs.alias("p"))
        .groupBy("behavior_policy", "estimator")
        .agg(
            F.round(F.avg(same.cast("int")), DIGITS).alias("ranking_accuracy"),
            F.round(F.avg(F.when(F.abs(gap) <= close, same.cast("int"))), DIGITS).alias(
                "close_pair_accuracy"
            ),
        )
    )
