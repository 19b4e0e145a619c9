"""Near copies by the Jaccard similarity of five-word shingles, for the pipeline.

Two documents are near copies if their sets of ``SHINGLE_WORDS``-word shingles
have a Jaccard similarity of at least 4/5. Only documents that share all ``ROWS``
least hashes of one of ``BANDS`` bands with another one are looked at; a pair at
exactly 0.8 misses all bands with probability (1 - 0.8 ** 5) ** 32 = 3e-6.

Among those, candidates come from their rarest shingles. If every set is ordered by how
many sets hold a shingle, rarest first, two sets at 0.8 or more share one of the first
n - ceil(0.8 n) + 1, and neither is smaller than 0.8 of the other. What many
documents have in common, such as a template, stands last and makes no candidates.
A shingle that is alone in its set's first ones makes none either. Every candidate
is verified on the whole sets, so nothing below the bound is dropped.

First, every set is compared with the least entry of each of its bands, and what is linked
is a class. From then on only sets of different classes have to meet, so that a large
group of copies costs a few comparisons for each of its members. Sets of different
classes that share a rare shingle are all compared; in a bucket of more than ``BUCKET``
sets, those of them that also share a band, which near copies do as said above. No pair
is left out because another one was found. Of a bucket's largest class, no two members
meet; the others meet all members, in parts of ``BUCKET`` by ``BUCKET`` rows.

Documents with equal sets are one entry. The row of a class with the least
doc_id stays, rows without an id only where no row of the class has one; rows
are told apart by (doc_id, digest of the text). Null and blank texts are equal. An
empty table has no near copies.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm.common import ids_and_texts, stored, text_digest, without
from assayer.llm.graph import components

SHINGLE_WORDS = 5
BANDS, ROWS = 32, 5
HASH_SEED = 43
#: Shingle hashes whose least values are taken at once.
BLOCK = 1 << 10
#: Sets that share a rare shingle and meet by it alone, at most; members that meet in one group.
BUCKET = 32
#: Texts whose sets are handed on at once.
SETS_AT_ONCE = 200


def shingles(text: str | None):
    """Sorted distinct 64-bit hashes of the text's shingles; a shorter text is one shingle."""
    import numpy as np
    import xxhash

    words = (text or "").encode("utf-8").lower().split()
    count = max(1, len(words) - SHINGLE_WORDS + 1)
    digest = xxhash.xxh64_intdigest
    return np.unique(
        np.fromiter(
            (digest(b" ".join(words[i : i + SHINGLE_WORDS]), HASH_SEED) for i in range(count)),
            dtype="<u8",
            count=count,
        )
    )


def _mixers():
    import numpy as np

    draw = np.random.Generator(np.random.PCG64(HASH_SEED))
    flips = draw.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)
    factors = draw.integers(0, 1 << 31, BANDS * ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    return flips, factors


def band_keys(values, mixers) -> list[int]:
    """One signed 64-bit key for each band of least hashes."""
    import numpy as np
    import xxhash

    folded = (values >> np.uint64(32)).astype(np.uint32)
    least = np.full(BANDS * ROWS, 0xFFFFFFFF, dtype=np.uint32)
    flips, factors = mixers
    for start in range(0, len(folded), BLOCK):
        mixed = folded[None, start : start + BLOCK] ^ flips[:, None]
        mixed *= factors[:, None]
        np.minimum(least, mixed.min(axis=1), out=least)
    return [
        xxhash.xxh64_intdigest(least[i * ROWS : (i + 1) * ROWS].tobytes(), i) - (1 << 63)
        for i in range(BANDS)
    ]


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, node, bands) for every row; equal nodes have equal sets."""

    def run(batches: Iterator) -> Iterator:
        import pandas as pd
        import xxhash

        mixers = _mixers()
        for batch in batches:
            nodes, bands = [], []
            for text in batch["text"]:
                values = shingles(text)
                nodes.append(xxhash.xxh3_128_hexdigest(values.tobytes()))
                bands.append(band_keys(values, mixers))
            yield pd.DataFrame(
                {
                    "doc_id": batch["doc_id"].astype("Int64"),
                    "digest": batch["digest"],
                    "node": nodes,
                    "bands": bands,
                }
            )

    return (
        ids_and_texts(docs)
        .withColumn("digest", text_digest(F.col("text")))
        .mapInPandas(run, "doc_id bigint, digest string, node string, bands array<bigint>")
    )


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(entry, size, values): the shingle sets of the wanted entries, read from one row of each."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            # A few texts at a time: sets are as large as their texts.
            for start in range(0, batch.num_rows, SETS_AT_ONCE):
                part = [shingles(t).view(np.int64) for t in texts.slice(start, SETS_AT_ONCE).to_pylist()]
                sizes = np.array([len(v) for v in part], dtype=np.int32)
                bounds = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                values = pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate(part)))
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(start, SETS_AT_ONCE), pa.array(sizes), values], ["entry", "size", "values"]
                )

    texts = ids_and_texts(docs).withColumn("digest", text_digest(F.col("text")))
    rows = wanted.select("entry", F.col("at.doc_id").alias("at_doc"), F.col("at.digest").alias("at_digest"))
    return (
        texts.join(rows, texts["doc_id"].eqNullSafe(rows["at_doc"]) & (texts["digest"] == rows["at_digest"]))
        .dropDuplicates(["entry"])
        .select("entry", "text")
        .mapInArrow(run, "entry bigint, size int, values array<bigint>")
    )


def shared_bands(entries: DataFrame) -> DataFrame:
    """(band, key, entry, hub) of the bands that entries share; ``hub`` is the least entry."""
    keyed = entries.select("entry", F.posexplode("bands").alias("band", "key"))
    met = keyed.groupBy("band", "key").agg(F.count("*").alias("n"), F.min("entry").alias("hub"))
    return keyed.join(met.where("n > 1").drop("n"), ["band", "key"])


def rarest(sets: DataFrame) -> DataFrame:
    """(shingle, entry, size, rest, together): the rarest shingles of each set that other sets share.

    ``rest`` counts the set's shingles from this one on, ``together`` the sets that have
    the shingle among their rarest.
    """
    rows = sets.select("entry", "size", F.explode("values").alias("shingle"))
    shared = rows.groupBy("shingle").agg(F.count("*").alias("n")).where("n > 1")
    listed = rows.join(shared, "shingle").groupBy("entry", "size").agg(
        F.array_sort(F.collect_list(F.struct("n", "shingle"))).alias("shared")
    )
    # Shingles of one set alone are the rarest and come first.
    first = F.expr("size - (4 * size + 4) div 5 + 1 - (size - size(shared))").cast("int")
    taken = stored(
        listed.withColumn("first", first)
        .where("first > 0")
        .select(
            "entry", "size", F.size("shared").alias("from_first"),
            F.posexplode(F.slice("shared", F.lit(1), F.col("first"))).alias("at", "s"),
        )
        .select(F.col("s.shingle").alias("shingle"), "entry", "size", F.expr("from_first - at").alias("rest")),
        "near-rarest",
    )
    together = taken.groupBy("shingle").agg(F.count("*").alias("together")).where("together > 1")
    return taken.join(together, "shingle")


def pairs_of_classes(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The pairs (a, b) of entries that share a key, are of different classes and may be near copies.

    ``rows`` has the keys, entry, size, rest, class. If two sets are near copies, the first
    shingle that they share leaves enough of both.
    """
    classes = rows.groupBy(*keys, "class").agg(F.count("*").alias("n"))
    buckets = (
        classes.groupBy(*keys)
        .agg(F.max(F.struct("n", "class"))["class"].alias("main"), F.max("n").alias("most"), F.sum("n").alias("n"))
        .where("n > most")
        .select(
            *keys, "main",
            F.expr(f"cast(ceil((n - most) / {BUCKET}) as int)").alias("rows_in"),
            F.expr(f"cast(ceil(n / {BUCKET}) as int)").alias("columns_in"),
        )
    )
    dealt = rows.join(buckets, keys)
    part = lambda count: F.pmod(F.xxhash64("entry"), F.col(count)).cast("int")
    every = lambda count: F.explode(F.sequence(F.lit(0), F.col(count) - 1))
    side = lambda name: [F.col(c).alias(f"{c}_{name}") for c in ("entry", "size", "rest", "class")]
    some = dealt.where("class <> main").withColumn("row", part("rows_in")).select(
        *keys, "row", every("columns_in").alias("column"), *side("a")
    )
    others = dealt.withColumn("column", part("columns_in")).select(
        *keys, "column", every("rows_in").alias("row"), *side("b"), (F.col("class") == F.col("main")).alias("of_main")
    )
    return (
        some.join(others, [*keys, "row", "column"])
        .where("class_a <> class_b and (of_main or entry_a < entry_b)")
        .where("5 * size_a >= 4 * size_b and 5 * size_b >= 4 * size_a")
        .where("9 * least(rest_a, rest_b) >= 4 * (size_a + size_b)")
        .select(F.least("entry_a", "entry_b").alias("a"), F.greatest("entry_a", "entry_b").alias("b"))
        .distinct()
    )


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of entries whose sets are 4/5 alike or more."""
    side = lambda name: sets.select(
        F.col("entry").alias(name), F.col("size").alias(f"size_{name}"), F.col("values").alias(f"values_{name}")
    )
    common = F.size(F.array_intersect("values_a", "values_b"))
    return (
        pairs.join(side("a"), "a").join(side("b"), "b").where(9 * common >= 4 * (F.col("size_a") + F.col("size_b")))
        .select("a", "b")
    )


def links(docs: DataFrame, entries: DataFrame) -> DataFrame:
    """Links (a, b) that join the entries of each class; ``entries`` has entry, at, bands."""
    bands = stored(shared_bands(entries), "near-bands")
    sets = stored(_sets(docs, entries.join(bands.select("entry").distinct(), "entry", "left_semi")), "near-sets")
    first = bands.where("entry <> hub").select(F.col("hub").alias("a"), F.col("entry").alias("b")).distinct()
    known = components(stored(verified(first, sets), "near-links"))
    known = stored(known.select(F.col("component").alias("class"), F.col("node").alias("entry")), "near-classes")
    classed = lambda rows: rows.join(known, "entry", "left").withColumn("class", F.coalesce("class", "entry"))
    buckets = stored(classed(rarest(sets)), "near-buckets")
    few = pairs_of_classes(buckets.where(F.col("together") <= BUCKET).drop("together"), ["shingle"])
    # Entries of larger buckets that hold several classes.
    large = buckets.where(F.col("together") > BUCKET)
    mixed = large.groupBy("shingle").agg(F.min("class").alias("least"), F.max("class").alias("most"))
    crowded = large.join(mixed.where("least < most"), "shingle", "left_semi").select("entry", "size", "class").distinct()
    banded = bands.join(crowded, "entry").select("band", "key", "entry", "size", F.col("size").alias("rest"), "class")
    pairs = stored(few.unionByName(pairs_of_classes(banded, ["band", "key"])).distinct(), "near-pairs")
    return known.select(F.col("class").alias("a"), F.col("entry").alias("b")).unionByName(
        stored(verified(pairs, sets), "near-links")
    )


def near_copies(docs: DataFrame) -> DataFrame:
    """(doc_id, digest) of the rows that another row of their class stands for."""
    rows = stored(signatures(docs), "near-signatures")
    # Ids come first, the least of them first.
    place = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "digest")
    entries = stored(
        rows.groupBy("node")
        .agg(F.min(place).alias("at"), F.first("bands").alias("bands"))
        .withColumn("entry", F.monotonically_increasing_id()),
        "near-entries",
    )
    joined = components(links(docs, entries)).withColumnRenamed("node", "entry")
    linked = entries.select("entry", "node", "at").join(joined, "entry")
    classes = linked.groupBy("component").agg(F.min("at").alias("stands"))
    named = linked.join(classes, "component").select("node", "stands")
    whole = entries.select("node", "at").join(named, "node", "left")
    stands = whole.select("node", F.coalesce("stands", "at").alias("stands"))
    return rows.join(stands, "node").where(~place.eqNullSafe(F.col("stands"))).select("doc_id", "digest").distinct()


def keep_one_of_near_copies(docs: DataFrame) -> DataFrame:
    """One row of each class of near copies stays, that with the least doc_id; all columns stay."""
    keys = {"doc_id": docs["doc_id"].cast("bigint"), "digest": text_digest(docs["text"])}
    return without(docs, near_copies(docs), keys)
