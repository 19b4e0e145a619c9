"""Streaming forms of the row-wise operators.

Scoring an outcome and checking a logged round need one record at a time, so
the batch Column expressions apply unchanged to ``readStream`` sources. State
is kept only for windowed monitoring of logged feedback, bounded by a watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from assayer.operators import ope, scoring


def record_stream(spark: SparkSession, path: str, schema: StructType, per_trigger: int = 1000):
    """New Parquet record files as a stream."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger)
    return reader.parquet(path)


def evaluations(outcomes: DataFrame, *keys: str) -> DataFrame:
    """Tall evaluation rows of an outcome stream."""
    return scoring.score_tall(scoring.score_wide(outcomes), *keys)


def feedback_monitor(
    log: DataFrame, event_time: str, lateness: str = "10 minutes", every: str = "5 minutes"
) -> DataFrame:
    """Windowed reward, propensity floor and invalid rounds of a feedback stream."""
    timed = log.withColumn(event_time, F.col(event_time).cast("timestamp"))
    p = F.col("action_propensity")
    invalid = p.isNull() | (p < ope.MIN_PROPENSITY) | (p > 1)
    return (
        timed.withWatermark(event_time, lateness)
        .groupBy(F.window(event_time, every), "behavior_policy")
        .agg(
            F.count(F.lit(1)).alias("n_rounds"),
            F.avg("observed_reward").alias("mean_reward"),
            F.min("action_propensity").alias("min_propensity"),
            F.count_if(invalid).alias("n_invalid"),
        )
        .select("window.start", "window.end", "behavior_policy", "n_rounds", "mean_reward",
                "min_propensity", "n_invalid")
    )


def append_records(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append a record stream to Parquet exactly once, in one catch-up run."""
    return (
        stream.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
