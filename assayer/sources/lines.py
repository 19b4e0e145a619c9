"""Lines of text files with their true numbers, however the files are cut into tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.session import join_small
from assayer.sources.tables import parse_questions


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, file, line_number and any partition columns); numbers count from 1 in each file.

    A large file is read in blocks. One count per block gives, summed up along the
    file, the lines before it; inside a block the reader's own order counts on. No
    task reads a whole file, and no line is moved. Blank lines are counted.
    """
    read = spark.read.text(path)
    lines = read.select(
        "*",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("__block"),
        F.monotonically_increasing_id().alias("__id"),
    )
    blocks = lines.groupBy("file", "__block").agg(
        F.count(F.lit(1)).alias("__lines"), F.min("__id").alias("__first")
    )
    # The blocks of one file, a row each; found by their place, so without a window.
    listed = blocks.groupBy("file").agg(
        F.array_sort(F.collect_list(F.struct("__block", "__lines", "__first"))).alias("__all")
    )
    before = F.aggregate(
        F.slice("__all", F.lit(1), F.col("__at")), F.lit(0).cast("bigint"), lambda n, b: n + b["__lines"]
    )
    placed = listed.select("file", "__all", F.posexplode("__all").alias("__at", "__own")).select(
        "file",
        F.col("__own.__block").alias("__block"),
        F.col("__own.__lines").alias("__lines"),
        F.col("__own.__first").alias("__first"),
        before.alias("__before"),
    )
    joined = join_small(lines, placed, ["file", "__block"])
    local = F.col("__id") - F.col("__first")
    # Both readings of the file must have been cut alike.
    sound = F.assert_true((local >= 0) & (local < F.col("__lines")), F.lit("files changed while they were read"))
    return joined.withColumn(
        "line_number", F.when(sound.isNull(), F.col("__before") + local + 1)
    ).select(
        F.col("value").alias("line"), "file", "line_number", *[c for c in read.columns if c != "value"]
    )


def load_questions(
    spark: SparkSession, path: str, dataset: str = "benchmark"
) -> tuple[DataFrame, DataFrame]:
    """Questions of JSON-lines files, and what could not be read: file, line number and reason.

    Failures are returned, neither raised nor dropped; ``message`` names the line.
    """
    lines = numbered_lines(spark, path)
    questions, failures = parse_questions(lines, dataset)
    located = failures.withColumn(
        "message", F.concat(F.lit("line "), "line_number", F.lit(": "), "reason")
    )
    return questions, located
