"""Repeated passages, found by hashing runs of consecutive sentences and of words.

A text is cut into sentences at line breaks and after ``.``, ``!`` or ``?``
followed by white space; a sentence of more than ``SENTENCE_WORDS`` words is cut
into pieces of that length. A run is the fewest sentences from each one on, and
the fewest up to each one, that are at least ``RUN_SENTENCES`` and have at least
``RUN_WORDS`` words together. Every sentence of a repeated stretch that holds a
run is in such a run that the stretch holds too. Passages that do not sit on
sentence bounds are found by the windows of ``WINDOW_WORDS`` words from every
word on. Runs and windows are equal when their words are; they are compared by a
128-bit hash over all documents.

Only what can recur is hashed: of every ``SEED_SPREAD`` successive grams of
``SEED_WORDS`` words, the least by hash are seeds, so that any repeat of
``RUN_WORDS`` words shares a seed with its other occurrence. Runs and windows are
made where the seeds of all the ``RUN_WORDS`` words in them occur twice. That filter
loses nothing.

The first occurrence in the document with the smallest doc_id stays. Words
that any other occurrence covers are removed, within one document as well as
across. A very frequent run is aggregated before the shuffle, and the join back
is one that adaptive execution can split.

Null texts count as empty, which have no runs. Rows with a null doc_id take no
part. Rows that repeat a doc_id are one document.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm.common import ids_and_texts, stored

RUN_SENTENCES = 2
RUN_WORDS = 30
SENTENCE_WORDS = 20
#: A repeat of so many words goes wherever it starts.
WINDOW_WORDS = 50
#: Words of a seed (a power of two), and successive grams of which one is a seed.
SEED_WORDS = 16
SEED_SPREAD = RUN_WORDS - SEED_WORDS + 1
#: Runs that a task holds before it hands them on.
ROWS_HELD = 200_000
HALF, MASK = 1 << 63, (1 << 64) - 1
BREAK = re.compile(r"(?<=[.!?])\s+|\n\s*")
WORD = re.compile(r"\S+")


def sentences(text: str) -> list[tuple[int, int, list[str]]]:
    """(start, end, words) of each sentence or piece of one, in order."""
    found = []
    start = 0
    bounds = [(m.start(), m.end()) for m in BREAK.finditer(text)]
    for end, following in [*bounds, (len(text), len(text))]:
        words = text[start:end].split()
        if len(words) <= SENTENCE_WORDS:
            if words:
                found.append((start, end, words))
        else:
            marks = list(WORD.finditer(text, start, end))
            for i in range(0, len(marks), SENTENCE_WORDS):
                piece = marks[i : i + SENTENCE_WORDS]
                found.append((piece[0].start(), piece[-1].end(), [m.group() for m in piece]))
        start = following
    return found


def _grams(words: list[str]):
    """Hashes of the grams of at least ``RUN_WORDS`` words, and the least of every ``SEED_SPREAD`` successive ones."""
    import numpy as np
    import xxhash

    digest = xxhash.xxh64_intdigest
    values = np.fromiter((digest(w) for w in words), dtype=np.uint64, count=len(words))
    width, factor = 1, 0x9E3779B97F4A7C15
    while width < SEED_WORDS:
        values = values[:-width] * np.uint64(factor) + values[width:]
        factor = factor * factor % (1 << 64)
        width *= 2
    values = (values ^ (values >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    values ^= values >> np.uint64(32)
    return values, np.lib.stride_tricks.sliding_window_view(values, SEED_SPREAD).min(axis=1)


def seeds(words: list[str]):
    """(hashes, places) of the seeds among the grams of these words."""
    import numpy as np

    if len(words) < RUN_WORDS:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    values, least = _grams(words)
    window = np.lib.stride_tricks.sliding_window_view
    # A gram is a seed if it is the least of some window that holds it.
    edge = np.zeros(SEED_SPREAD - 1, dtype=np.uint64)
    most = window(np.concatenate([edge, least, edge]), SEED_SPREAD).max(axis=1)
    places = np.flatnonzero(values == most)
    return values[places].view(np.int64), places


def sentence_runs(counts: list[int]) -> list[tuple[int, int]]:
    """(first, last) sentence of the shortest runs that start and that end at each sentence."""
    found = set()
    for step in (1, -1):
        sizes = counts[::step]
        last, total = -1, 0
        for first in range(len(sizes)):
            while last + 1 < len(sizes) and (last - first + 1 < RUN_SENTENCES or total < RUN_WORDS):
                last += 1
                total += sizes[last]
            if last - first + 1 < RUN_SENTENCES or total < RUN_WORDS:
                break
            found.add((first, last) if step == 1 else (len(sizes) - 1 - last, len(sizes) - 1 - first))
            total -= sizes[first]
    return sorted(found)


def runs(text: str, recurring=None) -> list[tuple[int, int, int]]:
    """(128-bit hash, start, end) of runs and windows whose seeds all recur, or of all, in order.

    A stretch of ``RUN_WORDS`` words has a seed that it has wherever it stands, the least of its
    grams. A run or window that recurs does so with every such stretch in it.
    """
    import numpy as np
    import xxhash

    words = text.split()
    if len(words) < RUN_WORDS:
        return []
    alone = np.zeros(len(words) - RUN_WORDS + 1, dtype=np.int64)
    if recurring is not None:
        alone[:] = ~np.isin(_grams(words)[1].view(np.int64), recurring)
    # Stretches of RUN_WORDS words, before each place, whose seed does not recur.
    before = np.concatenate([[0], np.cumsum(alone)])
    raw = [w.encode("utf-8") for w in words]
    joined = b" ".join(raw)
    # Word i is joined[at[i] : at[i + 1] - 1].
    at = np.concatenate([[0], np.cumsum([len(w) + 1 for w in raw])]).tolist()
    marks = [(m.start(), m.end()) for m in WORD.finditer(text)]
    counts = [len(part) for _, _, part in sentences(text)]
    starts = np.concatenate([[0], np.cumsum(counts)]).tolist()
    digest = xxhash.xxh3_128_intdigest
    found = []
    for first, last in sentence_runs(counts):
        i, j = starts[first], starts[last + 1]
        if before[j - RUN_WORDS + 1] == before[i]:
            found.append((digest(joined[at[i] : at[j] - 1]), marks[i][0], marks[j - 1][1]))
    held = WINDOW_WORDS - RUN_WORDS + 1
    for i in np.flatnonzero(before[held:] == before[:-held]).tolist():
        j = i + WINDOW_WORDS
        found.append((digest(joined[at[i] : at[j] - 1], WINDOW_WORDS), marks[i][0], marks[j - 1][1]))
    return sorted(found, key=lambda r: r[1:])


def recurring_seeds(docs: DataFrame) -> DataFrame:
    """(seeded_id, recurring): the seeds of a document that occur twice, in it or over all."""

    def scan(batches: Iterator) -> Iterator:
        import numpy as np
        import pandas as pd

        for batch in batches:
            parts = []
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                values, times = np.unique(seeds(text.split())[0], return_counts=True)
                parts.append(pd.DataFrame({"seed": values, "doc_id": doc_id, "again": times > 1}))
            if parts:
                yield pd.concat(parts)

    found = stored(
        ids_and_texts(docs)
        .where("doc_id is not null")
        .mapInPandas(scan, "seed bigint, doc_id bigint, again boolean"),
        "span-seeds",
    )
    twice = (
        found.groupBy("seed")
        .agg(F.count("*").alias("n"), F.max("again").alias("again"))
        .where("n > 1 or again")
        .select("seed")
    )
    listed = found.join(twice, "seed").groupBy("doc_id").agg(F.collect_set("seed").alias("recurring"))
    return stored(listed.withColumnRenamed("doc_id", "seeded_id"), "span-recurring")


def document_runs(docs: DataFrame) -> DataFrame:
    """Runs that may recur: hash in two halves, place, and whether the document has had it before."""
    columns = ["high", "low", "doc_id", "start", "end", "again"]

    def scan(batches: Iterator) -> Iterator:
        import pandas as pd

        for batch in batches:
            rows = []
            for doc_id, text, recurring in zip(batch["doc_id"], batch["text"], batch["recurring"], strict=True):
                seen = set()
                for h, start, end in runs(text, recurring):
                    rows.append(((h >> 64) - HALF, (h & MASK) - HALF, doc_id, start, end, h in seen))
                    seen.add(h)
                    if len(rows) >= ROWS_HELD:
                        yield pd.DataFrame(rows, columns=columns)
                        rows = []
            yield pd.DataFrame(rows, columns=columns)

    texts, marked = ids_and_texts(docs), recurring_seeds(docs)
    return (
        texts.join(marked, texts["doc_id"] == marked["seeded_id"])
        .select("doc_id", "text", "recurring")
        .mapInPandas(scan, "high bigint, low bigint, doc_id bigint, start int, end int, again boolean")
    )


def repeated_spans(docs: DataFrame) -> DataFrame:
    """Per document with repeats: doc_id, spans to remove, and where their text stands first.

    ``spans`` are merged character ranges [start, end) in order; ``first_doc_ids``
    are the distinct documents in which the removed runs occur first. What a
    document repeats within itself is known in the scan; only its first
    occurrences meet those of other documents. A document's own list is as long
    as the document at most.
    """
    found = stored(document_runs(docs), "span-runs")
    hashes = ["high", "low"]
    alone = found.where("not again").drop("again")
    repeated = (
        alone.groupBy(*hashes)
        .agg(F.min("doc_id").alias("first_doc_id"), F.max("doc_id").alias("last_doc_id"))
        .where("first_doc_id <> last_doc_id")
        .drop("last_doc_id")
    )
    columns = ["doc_id", "start", "end", "first_doc_id"]
    across = alone.join(repeated, hashes).where("doc_id <> first_doc_id").select(*columns)
    within = found.where("again").withColumn("first_doc_id", F.col("doc_id")).select(*columns)
    listed = across.unionByName(within).groupBy("doc_id").agg(
        F.array_sort(F.collect_set(F.struct("start", "end"))).alias("covered"),
        F.array_sort(F.collect_set("first_doc_id")).alias("first_doc_ids"),
    )

    @F.pandas_udf("array<struct<start:int,end:int>>")
    def merged(covered):
        import pandas as pd

        return pd.Series([_disjoint(ranges) for ranges in covered], dtype=object)

    return listed.select("doc_id", merged("covered").alias("spans"), "first_doc_ids")


def _disjoint(ranges) -> list[dict]:
    """Sorted ranges folded into disjoint ones."""
    folded: list[dict] = []
    for r in ranges:
        if folded and r["start"] <= folded[-1]["end"]:
            folded[-1]["end"] = max(folded[-1]["end"], int(r["end"]))
        else:
            folded.append({"start": int(r["start"]), "end": int(r["end"])})
    return folded


def remove_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """Texts of the documents in ``spans`` with those ranges cut out: doc_id, spans, first_doc_ids, text."""
    texts = ids_and_texts(docs).select(F.col("doc_id").alias("text_id"), "text")

    @F.pandas_udf("string")
    def cut(text, ranges):
        import pandas as pd

        return pd.Series([_cut(t, r) for t, r in zip(text, ranges, strict=True)], dtype=object)

    joined = texts.join(spans, texts["text_id"] == spans["doc_id"])
    return joined.select("doc_id", "spans", "first_doc_ids", cut("text", "spans").alias("text"))


def _cut(text: str, ranges) -> str:
    kept, at = [], 0
    for r in ranges:
        kept.append(text[at : r["start"]])
        at = r["end"]
    return "".join([*kept, text[at:]]).strip()
