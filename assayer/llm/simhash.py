"""SimHash near-duplicates, found by an index of one-wildcard segment variants.

A fingerprint has one bit per position, set where more than half of the
document's shingle hashes have it. Two fingerprints link when they differ in
``MAX_BITS`` = 2 bits at most. Cut into two segments, one segment then differs
by at most one bit, so that the pair shares a key "segment with bit i left out".

Groups of equal fingerprints are one entry of the index. A bucket of two is a
candidate pair, which is verified. Larger buckets are never expanded into pairs:
their members meet again at the fingerprints that are one flipped bit away from
them. Two fingerprints are within two bits exactly if they share such a point,
so hooking each to the least fingerprint at a point loses no link of a class,
costs 65 rows a member and has no bound on the size of a bucket.

Null and empty texts have fingerprint zero and link like any other. Repeated
rows are reported once each; rows with a null id never name a class but of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.llm.common import ids_and_texts, stored, text_digest, without
from assayer.llm.graph import components

BITS = 64
SEGMENTS = 2
MAX_BITS = 2
SHINGLE_WORDS = 3
HASH_SEED = 42
#: Shingle hashes whose bits are counted at once.
BLOCK = 1 << 16
#: Variants that one task makes.
TASK_VARIANTS = 1 << 20


def fingerprint_of(text: str | None, width: int = SHINGLE_WORDS) -> int:
    """The signed 64-bit fingerprint of one text."""
    import numpy as np
    import xxhash

    # Bytes split on exactly 0x20 and 0x09-0x0D, and lower() changes A-Z alone.
    words = (text or "").encode("utf-8").lower().split()
    if not words:
        return 0
    count = max(1, len(words) - width + 1)
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(BITS, dtype=np.int64)
    for start in range(0, count, BLOCK):
        stop = min(count, start + BLOCK)
        hashes = np.fromiter(
            (digest(b" ".join(words[i : i + width]), HASH_SEED) for i in range(start, stop)),
            dtype="<u8",
            count=stop - start,
        )
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    packed = np.packbits(2 * ones > count, bitorder="little")
    return int(packed.view("<i8")[0])


def fingerprints(docs: DataFrame, digests: bool = False) -> DataFrame:
    """(doc_id, fp) and, if asked for, the text's digest for every row, in one pass without a shuffle."""

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for batch in batches:
            found = {"doc_id": batch["doc_id"].astype("Int64"), "fp": [fingerprint_of(t) for t in batch["text"]]}
            yield pd.DataFrame(found | ({"digest": batch["digest"].astype(object)} if digests else {}))

    texts = ids_and_texts(docs)
    if digests:
        texts = texts.withColumn("digest", text_digest(F.col("text")))
    return texts.mapInPandas(run, "doc_id bigint, fp bigint" + (", digest string" if digests else ""))


def variants(entries: DataFrame) -> DataFrame:
    """Every fingerprint under its 64 keys: a segment with one bit left out."""
    width = BITS // SEGMENTS
    exploded = entries.select("fp", F.explode(F.sequence(F.lit(0), F.lit(BITS - 1))).alias("w"))
    segment = f"shiftrightunsigned(fp, cast(w div {width} as int) * {width}) & {(1 << width) - 1}L"
    wildcard = f"shiftleft(1L, cast(w % {width} as int))"
    return exploded.select(
        "fp",
        F.expr(f"(({segment}) & ~{wildcard}) | shiftleft(cast(w as bigint), {width})").alias("key"),
    )


def distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def links(entries: DataFrame) -> DataFrame:
    """Links (a, b) between distinct fingerprints whose components are those of all links."""
    # By the variants that an entry makes, not by the size of the entry.
    tasks = -(-entries.count() * BITS // TASK_VARIANTS)
    keyed = variants(entries.repartition(max(1, tasks), "fp"))
    buckets = keyed.groupBy("key").agg(
        F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")
    )
    buckets = stored(buckets.where("n > 1"), "simhash-buckets")
    pairs = buckets.where("n = 2").select("a", "b").distinct()
    crowded = buckets.where("n > 2").select("key")
    members = keyed.join(crowded, "key", "left_semi").select("fp").distinct()
    points = members.select(
        "fp",
        F.explode(
            F.expr(f"concat(array(fp), transform(sequence(0, {BITS - 1}), i -> fp ^ shiftleft(1L, i)))")
        ).alias("point"),
    )
    hubs = points.groupBy("point").agg(F.min("fp").alias("b"), F.count("*").alias("n")).where("n > 1")
    hooked = points.join(hubs, "point").where("fp <> b").select(F.col("fp").alias("a"), "b")
    return pairs.unionByName(hooked).where(distance(F.col("a"), F.col("b")) <= MAX_BITS).distinct()


def near_duplicates(docs: DataFrame, digests: bool = False) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs``, and ``digest`` if asked for.

    component_id is the smallest doc_id that links reach, its own included.
    """
    prints = stored(fingerprints(docs, digests), "simhash-fingerprints")
    entries = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-entries")
    joined = components(links(entries.select("fp")))
    linked = joined.join(entries, joined["node"] == entries["fp"]).select("node", "component", "least")
    classes = linked.groupBy("component").agg(F.min("least").alias("class_id"))
    named = linked.join(classes, "component").select(F.col("node").alias("fp"), "class_id")
    ids = entries.join(named, "fp", "left").select(
        F.col("fp").alias("print"), F.coalesce("class_id", "least").alias("component_id")
    )
    return prints.join(ids, prints["fp"] == ids["print"]).select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
        *(["digest"] if digests else []),
    )


def keep_one_per_class(docs: DataFrame) -> DataFrame:
    """Drop every document that another one of its class with a smaller id stands for."""
    found = near_duplicates(docs, digests=True).where("doc_id <> component_id").select("doc_id", "digest").distinct()
    return without(docs, found, {"doc_id": docs["doc_id"].cast("bigint"), "digest": text_digest(docs["text"])})
