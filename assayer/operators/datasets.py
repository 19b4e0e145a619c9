"""Validation, leak-free splits, frozen-split checks and sampling."""

from __future__ import annotations

from collections.abc import Mapping
from fractions import Fraction
from math import ceil

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assayer import vocabulary as v
from assayer.functions.hashing import stable_long, uniform
from assayer.operators.running import running_totals
from assayer.session import join_small

#: Groups of one size that are ranked together.


def validation_issues(
    questions: DataFrame, require_answer: bool = True, require_evidence: bool = True
) -> DataFrame:
    """(question_id, code), one row per failed check and question copy."""
    copies = questions.groupBy("question_id").agg(F.count(F.lit(1)).alias("copies"))
    repeated = copies.filter("copies > 1")
    counted = questions.join(repeated, "question_id", "left")

    def blank(name: str) -> F.Column:
        return F.trim(F.coalesce(F.col(name), F.lit(""))) == ""

    checks = {
        "duplicate_question_id": F.col("copies").isNotNull(),
        "empty_question_text": blank("question_text"),
        "missing_group_key": blank("group_key"),
        "no_document_ids": F.size("document_ids") == 0,
    }
    if require_answer:
        checks["missing_reference_answer"] = blank("reference_answer")
    if require_evidence:
        checks["missing_reference_evidence"] = F.size("reference_evidence") == 0
    codes = F.array_compact(F.array(*[F.when(c, code) for code, c in checks.items()]))
    return counted.select("question_id", F.explode(codes).alias("code"))


def valid_questions(questions: DataFrame, issues: DataFrame) -> DataFrame:
    return questions.join(issues.select("question_id").distinct(), "question_id", "left_anti")


def excluded_count(issues: DataFrame) -> DataFrame:
    """How many distinct questions validation leaves out."""
    return issues.agg(F.count_distinct("question_id").alias("n_excluded"))


def validation_counts(issues: DataFrame) -> DataFrame:
    """Issues and distinct questions per code."""
    return issues.groupBy("code").agg(
        F.count(F.lit(1)).alias("n_issues"), F.count_distinct("question_id").alias("n_questions")
    )


def deal_sizes(
    counts: list[tuple[int, int]], fractions: Mapping[str, float], total: int
) -> dict[int, dict[str, int]]:
    """How many groups of each size each split takes, largest size first.

    Every group goes to the split furthest below target, ties to the last name.
    For equal groups these choices are the highest of the splits' falling levels,
    so a whole run of them is counted by one threshold instead of step by step.
    """
    room = {split: Fraction(str(share)) * total for split, share in fractions.items()}
    dealt: dict[int, dict[str, int]] = {}
    for size, groups in sorted(counts, reverse=True):
        # The level to which filling the emptiest splits alone would use all groups up.
        ordered = sorted(room.values(), reverse=True)
        for n in range(len(ordered), 0, -1):
            level = (sum(ordered[:n]) - size * groups) / n
            if ordered[n - 1] >= level:
                break
        # What lies a group above it is surely taken; the last few are dealt singly.
        taken = {s: max(0, ceil((r - level - size) / size)) for s, r in room.items()}
        room = {s: r - size * taken[s] for s, r in room.items()}
        for _ in range(groups - sum(taken.values())):
            split = max(room, key=lambda name: (room[name], name))
            room[split] -= size
            taken[split] += 1
        dealt[size] = taken
    return dealt


def grouped_split(
    questions: DataFrame,
    fractions: Mapping[str, float] = v.SPLIT_FRACTIONS,
    seed: int = v.DEFAULT_SEED,
) -> DataFrame:
    """Assign whole groups to splits; adds ``split``.

    The deal depends on sizes alone, so (size, number of groups) pairs are all
    the driver sees: at most about the root of twice the rows. Groups of one size
    take their places in the order of a seeded hash of their key, counted in
    blocks; the first of them go to the first split by name, and so on.
    """
    if abs(sum(fractions.values()) - 1.0) > 1e-6 or any(f <= 0 for f in fractions.values()):
        raise ValueError(f"fractions must be positive and sum to 1, got {dict(fractions)}")
    groups = questions.groupBy("group_key").agg(F.count(F.lit(1)).alias("n"))
    counts = [(r["n"], r["groups"]) for r in groups.groupBy("n").agg(F.count(F.lit(1)).alias("groups")).collect()]
    n_groups = sum(c for _, c in counts)
    if n_groups < len(fractions):
        raise ValueError(f"{n_groups} group(s) cannot fill {len(fractions)} splits")
    copies = questions.groupBy("question_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    if copies.limit(1).count():
        raise ValueError("duplicate question ids cannot be split")
    dealt = deal_sizes(counts, fractions, sum(n * c for n, c in counts))
    rows = []
    for size, taken in dealt.items():
        last, bounds = 0, []
        for split in sorted(taken):
            last += taken[split]
            bounds.append((last, split))
        rows.append((size, bounds))
    bounds = questions.sparkSession.createDataFrame(
        rows, "n bigint, bounds array<struct<last:bigint,split:string>>"
    )
    key = F.coalesce("group_key", F.lit(""))
    placed = groups.withColumn("draw", uniform(stable_long(key), seed % 10_000)).select(
        "group_key",
        "n",
        "draw",
        key.alias("tie"),
        F.lit(1).alias("one"),
    )
    ranked = running_totals(placed, ["n"], ["draw", "tie"], ["one"])
    assigned = join_small(ranked, bounds, "n").select(
        F.col("group_key").alias("__group"),
        F.get(
            F.filter("bounds", lambda b: b["last"] >= F.col("one_through")), F.lit(0)
        )["split"].alias("split"),
    )
    keyed = questions.withColumn("__key", F.struct("group_key"))
    named = assigned.select(F.struct(F.col("__group").alias("group_key")).alias("__key"), "split")
    return join_small(keyed, named, "__key").drop("__key")


def leaking_groups(assignment: DataFrame) -> DataFrame:
    """Groups that appear in more than one split."""
    return (
        assignment.groupBy("group_key")
        .agg(
            F.count_distinct("split").alias("n_splits"),
            F.array_join(F.sort_array(F.collect_set("split")), ",").alias("splits"),
        )
        .filter("n_splits > 1")
    )


def split_counts(assignment: DataFrame) -> DataFrame:
    return assignment.groupBy("split").agg(
        F.count(F.lit(1)).alias("n_questions"), F.count_distinct("group_key").alias("n_groups")
    )


def reconcile(current: DataFrame, frozen: DataFrame) -> DataFrame:
    """(question_id, problem): ids missing from, or stale in, a frozen split."""
    now = current.select("question_id").distinct().withColumn("now", F.lit(True))
    then = frozen.select("question_id").distinct().withColumn("then", F.lit(True))
    return (
        now.join(then, "question_id", "full")
        .filter("now is null or then is null")
        .select("question_id", F.expr("if(then is null, 'missing', 'stale')").alias("problem"))
    )


def hash_sample(rows: DataFrame, key: str, n: int, seed: int = v.DEFAULT_SEED) -> DataFrame:
    """A fixed-size sample: the n smallest draws, a distributed top-n."""
    draw = uniform(F.col(key), seed % 10_000)
    return rows.withColumn("draw", draw).orderBy("draw", key).limit(n).drop("draw")


def spread_sample(
    rows: DataFrame, key: str, strata: list[str], size: int, seed: int = v.DEFAULT_SEED
) -> DataFrame:
    """``size`` rows over all strata, one from each in turn; adds ``pick``, the turn.

    No stratum can give more than ``size`` rows, which bounds what is exchanged; of
    the last turn, the strata with the smallest draws are taken.
    """
    picked = stratified_sample(rows.withColumn("__draw", uniform(F.col(key), seed % 10_000)), key, strata, size, seed)
    return picked.orderBy("pick", "__draw", key, *strata).limit(size).drop("__draw")


def stratified_sample(
    rows: DataFrame, key: str, strata: list[str], per_stratum: int, seed: int = v.DEFAULT_SEED
) -> DataFrame:
    """The ``per_stratum`` smallest draws of every stratum."""
    window = Window.partitionBy(*strata).orderBy("draw", key)
    return (
        rows.withColumn("draw", uniform(F.col(key), seed % 10_000))
        .withColumn("pick", F.row_number().over(window))
        .filter(F.col("pick") <= per_stratum)
        .drop("draw")
    )
