"""Frozen split files: nested documents, written in shards and read back.

A frozen split is a folder with ``header``, one document of counts and settings,
and ``shards``: documents that map every split to a run of its sorted question ids
and groups. Each shard holds ``SHARD_ROWS`` entries at most, and shards are ranges of
the ids, so that the ids of a split are sorted from shard to shard as well. A
single nested document of the same fields is read in the same way.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SHARD_ROWS = 50_000
SHARD_SCHEMA = "splits map<string,array<string>>, groups map<string,array<string>>"
HEADER_SCHEMA = (
    "dataset string, dataset_version string, group_by string, seed bigint, "
    "counts map<string,bigint>, group_counts map<string,bigint>"
)


def _counts(rows: DataFrame, name: str):
    """One row: a map from each split to its number of rows. Splits are few."""
    counted = rows.groupBy("split").agg(F.count(F.lit(1)).alias("n"))
    entries = F.array_sort(F.collect_list(F.struct("split", "n")))
    return counted.agg(F.map_from_entries(entries).alias(name))


def _shards(rows: DataFrame, key: str, name: str) -> DataFrame:
    """One row per range of keys: {split: sorted keys}."""
    shards = max(1, -(-rows.count() // SHARD_ROWS))
    ranged = rows.repartitionByRange(shards, key).withColumn("shard", F.spark_partition_id())
    lists = ranged.groupBy("shard", "split").agg(F.array_sort(F.collect_list(key)).alias("keys"))
    entries = F.array_sort(F.collect_list(F.struct("split", "keys")))
    return lists.groupBy("shard").agg(F.map_from_entries(entries).alias(name))


def write_frozen(
    assignment: DataFrame,
    path: str,
    dataset: str,
    dataset_version: str,
    group_by: str,
    seed: int,
) -> None:
    """Freeze (question_id, group_key, split). The driver sees numbers of rows alone.

    A folder that holds a frozen split already is not written to again.
    """
    questions = assignment.select("split", "question_id")
    groups = assignment.select("split", "group_key").distinct()
    header = _counts(questions, "counts").join(_counts(groups, "group_counts"), how="cross").select(
        F.lit(dataset).alias("dataset"),
        F.lit(dataset_version).alias("dataset_version"),
        F.lit(group_by).alias("group_by"),
        F.lit(seed).cast("bigint").alias("seed"),
        "counts",
        "group_counts",
    )
    named = _shards(questions, "question_id", "splits").withColumn(
        "groups", F.lit(None).cast("map<string,array<string>>")
    )
    grouped = _shards(groups, "group_key", "groups").withColumn(
        "splits", F.lit(None).cast("map<string,array<string>>")
    )
    shards = named.select("splits", "groups").unionByName(grouped.select("splits", "groups"))
    # One document to a file, as a single nested document is.
    shards.write.option("maxRecordsPerFile", 1).json(f"{path}/shards")
    header.coalesce(1).write.json(f"{path}/header")


def read_header(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(HEADER_SCHEMA).json(f"{path}/header")


def _entries(spark: SparkSession, path: str, name: str, key: str) -> DataFrame:
    frozen = spark.read.schema(SHARD_SCHEMA).json(path, multiLine=True)
    listed = frozen.where(F.col(name).isNotNull()).select(F.explode(name).alias("split", "keys"))
    return listed.select(F.explode("keys").alias(key), "split")


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """(question_id, split) of a frozen split's shards, or of one nested document."""
    return _entries(spark, path, "splits", "question_id")


def read_groups(spark: SparkSession, path: str) -> DataFrame:
    """(group_key, split)."""
    return _entries(spark, path, "groups", "group_key")
