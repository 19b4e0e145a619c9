"""Exact duplicates by deterministic block naming, with built-in functions alone.

A text is cut into blocks of ``BLOCK_CHARS`` characters. Distinct blocks are
sorted and named by integers, then adjacent names are paired and the distinct
pairs are sorted and named again, until one name is left for each document.
Names are places in a sorted list of distinct contents and cannot collide: two
texts get the same name after the same number of levels exactly if they are equal.

Blocks are sorted by (64-bit key, content). Where a key occurs once, the content
cannot decide anything and is not moved; where it recurs, blocks are compared as
they are. Names are written before they are used, so that a rerun task cannot
number them anew. A level is one aggregate and one equality join; names that
many documents share are aggregated before the shuffle, and the joins are those
that adaptive execution can split. Levels grow with the logarithm of the longest text.

Null counts as empty; equal rows with the same doc_id are reported once each and
all count in group_size. Rows with a null doc_id take part; the largest id of a
group ignores nulls.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayer.llm.common import ids_and_texts, stored, text_digest, without

BLOCK_CHARS = 4096
MISSING = -1


def block_list(text: Column) -> Column:
    """The text cut into pieces of BLOCK_CHARS characters; an empty text is one empty piece."""
    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK_CHARS}}}"), F.lit(0))
    return F.when(F.length(text) <= BLOCK_CHARS, F.array(text)).otherwise(pieces)


def named(distinct: DataFrame, keys: list[str], label: str) -> DataFrame:
    """Distinct rows with ``name``, their place in the sorted order of ``keys``.

    Ranges are cut by the first key alone: what the driver samples to cut them
    are numbers, never contents.
    """
    ordered = distinct.repartitionByRange(keys[0]).sortWithinPartitions(*keys)
    return stored(ordered.withColumn("name", F.monotonically_increasing_id()), label)


def identities(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Names (doc_id, digest, level, name), and rows (doc_id, digest, copies).

    (level, name) is equal if and only if the text is. Both have one row for each
    distinct (doc_id, digest); the digest only tells apart rows that repeat an id
    and plays no part in the names.
    """
    texts = ids_and_texts(docs)
    pieces = texts.select(
        "doc_id",
        text_digest(F.col("text")).alias("digest"),
        F.posexplode(block_list(F.col("text"))).alias("pos", "block"),
    ).withColumn("key", F.xxhash64("block"))
    rows = stored(pieces.select("doc_id", "digest", "pos", "key"), "naming-blocks")
    recurring = rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    compared = stored(pieces.join(recurring, "key", "left_semi"), "naming-contents")

    # A key without content stands for its only block.
    lone = rows.groupBy("key").agg(F.count("*").alias("n")).where("n = 1")
    names = named(
        lone.select("key", F.lit(None).cast("string").alias("block")).unionByName(
            compared.select("key", "block").distinct()
        ),
        ["key", "block"],
        "naming-level-0",
    )
    by_key = names.where("block is null").select("key", "name")
    by_block = names.where("block is not null")
    state = stored(
        rows.join(by_key, "key")
        .select("doc_id", "digest", "pos", "name")
        .unionByName(
            compared.join(by_block, ["key", "block"]).select("doc_id", "digest", "pos", "name")
        ),
        "naming-state-0",
    )

    longest = state.agg(F.max("pos")).first()[0] or 0
    finished, level = None, 0
    while True:
        # A document is named when its row at place 0 has no neighbour left.
        done = state.groupBy("doc_id", "digest").agg(
            F.max("pos").alias("last"), F.max("name").alias("name")
        )
        done = done.where("last = 0").select("doc_id", "digest", F.lit(level).alias("level"), "name")
        finished = done if finished is None else finished.unionByName(done)
        if longest == 0:
            counted = rows.where("pos = 0").groupBy("doc_id", "digest")
            return finished, counted.agg(F.count("*").alias("copies"))
        state = _paired(state, level + 1)
        longest //= 2
        level += 1


def _paired(state: DataFrame, level: int) -> DataFrame:
    """One level up: adjacent names become one name; finished documents leave."""
    halves = state.groupBy("doc_id", "digest", F.expr("pos div 2").cast("int").alias("pair")).agg(
        F.max(F.when(F.expr("pos % 2 = 0"), F.col("name"))).alias("l"),
        F.coalesce(F.max(F.when(F.expr("pos % 2 = 1"), F.col("name"))), F.lit(MISSING)).alias("r"),
    )
    # A lone first name without a partner belongs to a document of one block.
    single = F.col("r").eqNullSafe(MISSING) & (F.col("pair") == 0)
    halves = stored(halves.where(~single), f"naming-pairs-{level}")
    names = named(halves.select("l", "r").distinct(), ["l", "r"], f"naming-level-{level}")
    return stored(
        halves.join(names, ["l", "r"]).select("doc_id", "digest", F.col("pair").alias("pos"), "name"),
        f"naming-state-{level}",
    )


def duplicate_groups(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256."""
    names, rows = identities(docs)
    found = names.select(
        F.col("doc_id").alias("named_id"), F.col("digest").alias("named_digest"), "level", "name"
    )
    whole = stored(
        rows.join(
            found,
            rows["doc_id"].eqNullSafe(found["named_id"]) & (rows["digest"] == found["named_digest"]),
        ).select("doc_id", "digest", "copies", "level", "name"),
        "naming-identities",
    )
    groups = whole.groupBy("level", "name").agg(
        F.max("doc_id").alias("keep_id"), F.sum("copies").alias("group_size")
    )
    return whole.join(groups, ["level", "name"]).select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.col("digest").alias("text_sha256"),
        F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))).alias("copy"),
    ).drop("copy")


def keep_last_of_equals(docs: DataFrame) -> DataFrame:
    """One row of each group of equal texts stays, that with the largest doc_id; all columns stay."""
    groups = duplicate_groups(docs).where("not kept").select("doc_id", "text_sha256").distinct()
    keys = {"doc_id": docs["doc_id"].cast("bigint"), "text_sha256": text_digest(docs["text"])}
    left = without(docs, groups, keys)
    # Rows that repeat both id and text: one of them is enough.
    order = Window.partitionBy(F.col("doc_id"), text_digest(F.col("text"))).orderBy(F.lit(0))
    mark = "__copy_of_row"
    return left.withColumn(mark, F.row_number().over(order)).where(F.col(mark) == 1).drop(mark)
