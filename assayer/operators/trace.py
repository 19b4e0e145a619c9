"""Analytics over agent step tables.

Steps are (run_id, step, tool, signature, ok, parse_error, chunk_ids, tokens).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer import vocabulary as v
from assayer.operators.running import running_totals


def flag_repeats(steps: DataFrame) -> DataFrame:
    """Add ``is_repeat``: the run made the same call at an earlier step."""
    calls = steps.filter(F.col("signature").isNotNull())
    first = calls.groupBy("run_id", "signature").agg(F.min("step").alias("first_step"))
    return steps.join(first, ["run_id", "signature"], "left").withColumn(
        "is_repeat", F.coalesce(F.col("step") > F.col("first_step"), F.lit(False))
    )


def run_metrics(steps: DataFrame) -> DataFrame:
    """Call validity, repetition and evidence yield per run.

    Repeats are calls minus distinct calls, so no ordering is needed and every
    aggregate combines before its shuffle.
    """
    called = F.col("signature").isNotNull()
    attempted = called | F.col("parse_error").isNotNull()
    valid = called & F.col("parse_error").isNull() & F.col("ok")
    totals = steps.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("n_steps"),
        F.count_if(called).alias("n_tool_calls"),
        F.sum("tokens").cast("bigint").alias("total_tokens"),
        F.count_if(attempted).alias("n_attempted"),
        F.count_if(valid).alias("n_valid"),
    )
    distinct_calls = (
        steps.filter(called)
        .groupBy("run_id", "signature")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("run_id")
        .agg(F.sum(F.col("n") - 1).alias("n_repeats"))
    )
    chunks = (
        steps.select("run_id", F.explode("chunk_ids").alias("chunk_id"))
        .distinct()
        .groupBy("run_id")
        .agg(F.count(F.lit(1)).alias("n_chunks"))
    )

    def rate(part: str, whole: str) -> F.Column:
        share = F.try_divide(F.coalesce(F.col(part), F.lit(0)), F.col(whole))
        return F.round(F.coalesce(share, F.lit(0.0)), 6)

    return (
        totals.join(distinct_calls, "run_id", "left")
        .join(chunks, "run_id", "left")
        .select(
            "run_id",
            "n_steps",
            "n_tool_calls",
            "total_tokens",
            rate("n_valid", "n_attempted").alias("valid_tool_call_rate"),
            rate("n_repeats", "n_tool_calls").alias("repeated_call_rate"),
            rate("n_chunks", "n_tool_calls").alias("evidence_per_call"),
        )
    )


def chunks_seen(steps: DataFrame) -> DataFrame:
    """Chunks of a run with the step that first showed them."""
    return (
        steps.select("run_id", "step", F.explode("chunk_ids").alias("chunk_id"))
        .groupBy("run_id", "chunk_id")
        .agg(F.min("step").alias("first_step"))
    )


def terminations(steps: DataFrame, limits: dict = v.AGENT_LIMITS) -> DataFrame:
    """Where the execution limits would have stopped each run.

    Limits are tested before a step, on totals of the steps preceding it, in the
    order time, tokens, calls; running past the last allowed step is the step
    limit. ``steps`` needs ``elapsed_seconds``, ``tokens`` and ``calls``.
    """
    running = running_totals(
        steps.withColumn("one", F.lit(1)), ["run_id"], ["step"], ["tokens", "calls", "one"]
    )
    reason = (
        F.when(F.col("one_before") >= limits["max_steps"], "step_limit_exceeded")
        .when(F.col("elapsed_seconds") > limits["max_wall_clock_seconds"], "time_limit_exceeded")
        .when(F.col("tokens_before") >= limits["max_total_tokens"], "token_limit_exceeded")
        .when(F.col("calls_before") >= limits["max_tool_calls"], "tool_call_limit_exceeded")
        .when(F.col("submitted"), "submitted")
    )
    stopped = running.withColumn("reason", reason).filter(F.col("reason").isNotNull())
    first = stopped.groupBy("run_id").agg(
        F.min_by("reason", "one_before").alias("termination_reason"),
        F.min("one_before").alias("steps_before"),
    )
    runs = steps.select("run_id").distinct()
    return runs.join(first, "run_id", "left").select(
        "run_id",
        F.coalesce("termination_reason", F.lit("invalid_termination")).alias("termination_reason"),
        F.col("steps_before"),
    )
