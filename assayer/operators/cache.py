"""A response cache as a keyed table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def lookup(requests: DataFrame, cached: DataFrame) -> DataFrame:
    """Requests with their cached response and a ``from_cache`` flag."""
    hits = cached.withColumn("from_cache", F.lit(True))
    return requests.join(hits, "cache_key", "left").withColumn(
        "from_cache", F.coalesce("from_cache", F.lit(False))
    )


def misses(requests: DataFrame, cached: DataFrame) -> DataFrame:
    return requests.join(cached, "cache_key", "left_anti")


def storable(responses: DataFrame) -> DataFrame:
    """New responses worth keeping; a truncated one would be wrong for ever."""
    return responses.filter(F.coalesce("finish_reason", F.lit("")) != "length").withColumn(
        "shard", F.substring("cache_key", 1, 2)
    )


def stats(looked_up: DataFrame) -> DataFrame:
    return looked_up.agg(
        F.count_if("from_cache").alias("hits"),
        F.count_if(~F.col("from_cache")).alias("misses"),
        F.round(F.coalesce(F.avg(F.col("from_cache").cast("int")), F.lit(0.0)), 4).alias(
            "hit_rate"
        ),
    )
