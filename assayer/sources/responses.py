"""A content-addressed store of responses: insert-only, sharded, visible on commit.

A store is a folder. ``data`` holds one folder per insert and below it one per
shard, the first two hex digits of the key; ``commits`` holds one row per finished
insert. Readers look up the committed inserts first, so an insert that died, or
is still running, is not seen. Nothing is ever changed or deleted.

Keys stand for the content of a request, so the first response to a key is as good
as any later one, and later ones are not stored. One writer at a time.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.operators import cache
from assayer.session import join_small


def _commits(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.schema("batch string, sequence bigint").parquet(f"{path}/commits")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def read(spark: SparkSession, path: str) -> DataFrame | None:
    """All committed responses with ``shard`` and ``sequence``, the number of their insert; None if there are none."""
    commits = _commits(spark, path)
    if commits is None:
        return None
    stored = spark.read.parquet(f"{path}/data")
    # Names of shards are texts, also those that look like numbers.
    stored = stored.withColumn("shard", F.substring("cache_key", 1, 2))
    return stored.join(F.broadcast(commits), "batch").drop("batch")


def insert(responses: DataFrame, path: str, *order: str | Column) -> int:
    """Store what is new and whole, and return how many rows that was.

    Of several responses to one key, the first by ``order`` is taken. Only the
    shards that the new keys fall into are read to leave out what is there.
    """
    spark = responses.sparkSession
    whole = cache.storable(responses)
    columns = [c for c in responses.columns if c != "cache_key"]
    place = F.struct(*(order or [F.xxhash64(*columns)]), *columns)
    first = whole.groupBy("cache_key").agg(F.min_by(F.struct(*columns), place).alias("row"))
    new = first.select("cache_key", "row.*").withColumn("shard", F.substring("cache_key", 1, 2))
    commits = _commits(spark, path)
    sequence = 1 if commits is None else commits.count() + 1
    if commits is not None:
        touched = [r[0] for r in new.select("shard").distinct().collect()]  # 256 at most
        held = spark.read.parquet(f"{path}/data").join(F.broadcast(commits), "batch")
        held = held.where(F.col("shard_of").isin([f"x{s}" for s in touched])).select("cache_key")
        new = new.join(held, "cache_key", "left_anti")
    batch = uuid.uuid4().hex
    (
        new.withColumn("shard_of", F.concat(F.lit("x"), "shard"))
        .withColumn("batch", F.lit(batch))
        .drop("shard")
        .repartition("shard_of")
        .write.mode("append")
        .partitionBy("batch", "shard_of")
        .parquet(f"{path}/data")
    )
    written = spark.read.parquet(f"{path}/data").where(F.col("batch") == batch).count() if _wrote(spark, path, batch) else 0
    commit = spark.createDataFrame([(batch, sequence)], "batch string, sequence bigint").coalesce(1)
    commit.write.mode("append").parquet(f"{path}/commits")
    return written


def _wrote(spark: SparkSession, path: str, batch: str) -> bool:
    """Whether the insert left any file: one without new rows leaves none."""
    try:
        spark.read.parquet(f"{path}/data/batch={batch}")
    except AnalysisException as missing:
        if missing.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return False
    return True


def look_up(requests: DataFrame, path: str) -> DataFrame:
    """Requests with their stored response and ``from_cache``."""
    held = read(requests.sparkSession, path)
    if held is None:
        return requests.withColumn("from_cache", F.lit(False))
    return join_small(
        requests, held.drop("shard", "sequence").withColumn("from_cache", F.lit(True)), "cache_key", "left"
    ).withColumn("from_cache", F.coalesce("from_cache", F.lit(False)))
