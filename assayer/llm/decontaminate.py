"""Benchmark passages in documents: q-gram lemma filter and banded alignment.

Texts are compared in lower case with white space runs as one space. A document
holds an item if some stretch of it is within ``k`` character edits of the whole
item, where k is ``ERROR`` of the item's length. Such a stretch shares at least
``m + 1 - q * (k + 1)`` q-grams with an item of m characters (q-gram lemma), all
on diagonals at most k apart. Diagonals are gathered in bands of width 2(k + 1)
that overlap by half, so that one band holds them all; bands that reach the
bound are regions, and each region is verified by alignment within the band.

k is lowered where an item is so short that the bound would be under one gram;
an item of fewer than q characters cannot be told from chance and matches nothing.

Items are a query set that goes to the documents in blocks of ``BLOCK_CHARS``
characters: each block is a broadcast of fixed size and one pass over all
documents, whole. Nothing is shuffled but the matches. Long texts are read in
stretches that overlap by more than a match can be long.

Null texts are empty and match nothing. Rows with a null doc_id are searched and
reported with it. Rows that repeat an id are each searched; equal matches are one row.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm.common import ids_and_texts, text_digest, without

Q = 8
ERROR = 0.1
#: Characters of items in one broadcast.
BLOCK_CHARS = 8_000_000
#: Characters of documents that are filtered at once.
STRETCH = 1_000_000
TABLE_BITS = 20
MULTIPLIER = 0x9E3779B97F4A7C15
SEPARATOR = 0


def normalized(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def budget(length: int, q: int = Q, error: float = ERROR) -> int:
    """Edits allowed for an item of ``length`` characters: at least one shared q-gram is left."""
    return max(0, min(int(error * length), length // q - 1))


def least_grams(length: int, q: int = Q, error: float = ERROR) -> int:
    """q-grams that any stretch within the budget shares with the item."""
    return length + 1 - q * (budget(length, q, error) + 1)


def _codes(text: str):
    import numpy as np

    return np.frombuffer(text.encode("utf-32-le"), dtype="<u4")


def grams(codes, q: int = Q):
    """A 64-bit hash of the q characters from each place on (q a power of two)."""
    import numpy as np

    values, width, factor = codes.astype(np.uint64) + np.uint64(1), 1, MULTIPLIER
    while width < q:
        n = len(values) - width
        if n <= 0:
            return np.zeros(0, dtype=np.uint64)
        values = values[:n] * np.uint64(factor) + values[width:]
        factor = factor * factor % (1 << 64)
        width *= 2
    return values * np.uint64(MULTIPLIER)


class Items:
    """A block of items with the index of their q-grams."""

    def __init__(self, rows: list[tuple[int, str]]) -> None:
        import numpy as np

        texts = [(item_id, normalized(text)) for item_id, text in rows]
        texts = [(item_id, text) for item_id, text in texts if len(text) >= Q]
        self.ids = [item_id for item_id, _ in texts]
        self.texts = [text for _, text in texts]
        self.codes = [_codes(text) for text in self.texts]
        self.budgets = np.array([budget(len(t)) for t in self.texts], dtype=np.int64)
        self.least = np.array([least_grams(len(t)) for t in self.texts], dtype=np.int64)
        found = [grams(c) for c in self.codes]
        hashes = np.concatenate(found) if found else np.zeros(0, dtype=np.uint64)
        owners = np.repeat(np.arange(len(found)), [len(g) for g in found])
        places = np.concatenate([np.arange(len(g)) for g in found]) if found else np.zeros(0, dtype=np.int64)
        order = np.argsort(hashes, kind="stable")
        self.owners, self.places = owners[order], places[order]
        self.hashes, self.starts = np.unique(hashes[order], return_index=True)
        self.ends = np.append(self.starts[1:], len(hashes))
        self.table = np.zeros(1 << TABLE_BITS, dtype=bool)
        self.table[(self.hashes >> np.uint64(64 - TABLE_BITS)).astype(np.int64)] = True
        self.longest = max(map(len, self.texts), default=0)

    def regions(self, codes):
        """(item, first diagonal, last diagonal) of bands that reach the item's bound."""
        import numpy as np

        values = grams(codes)
        at = np.flatnonzero(self.table[(values >> np.uint64(64 - TABLE_BITS)).astype(np.int64)])
        index = np.searchsorted(self.hashes, values[at])
        index[index == len(self.hashes)] = 0
        hit = self.hashes[index] == values[at]
        at, index = at[hit], index[hit]
        times = self.ends[index] - self.starts[index]
        rank = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        entry = np.repeat(self.starts[index], times) + rank
        item = self.owners[entry]
        # Diagonals are shifted so that none is negative.
        diagonal = np.repeat(at, times) - self.places[entry] + self.longest
        step = self.budgets[item] + 1
        found = []
        for shift in (0, 1):
            band = (diagonal + shift * step) // (2 * step)
            keys, counts = np.unique(item << 40 | band, return_counts=True)
            items, bands = keys >> 40, keys & ((1 << 40) - 1)
            enough = counts >= self.least[items]
            items, bands = items[enough], bands[enough]
            width = self.budgets[items] + 1
            first = (2 * bands - shift) * width - self.longest
            found.append(np.stack([items, first, first + 2 * width - 1], axis=1))
        return np.concatenate(found)

    def verify(self, codes, item: int, firsts, lasts):
        """Least edits of the item against each region, and where that stretch ends.

        Alignments stay on the region's diagonals; both ends of the region are
        free. One row of the band for all regions of the item is one array step.
        """
        import numpy as np

        own = self.codes[item]
        width = int(lasts[0] - firsts[0]) + 1
        padded = np.concatenate(
            [np.zeros(len(own) + width, np.uint32), codes, np.zeros(len(own) + width, np.uint32)]
        )
        base = firsts[:, None] + np.arange(width)[None, :] + len(own) + width
        slope = np.arange(width)
        # Row i holds costs of own[:i] against stretches that end before place diagonal + i.
        costs = np.zeros((len(firsts), width), dtype=np.int64)
        for i, code in enumerate(own):
            same = padded[np.clip(base + i, 0, len(padded) - 1)] == code
            along = costs + ~same
            above = np.full_like(costs, 1 << 30)
            above[:, :-1] = costs[:, 1:] + 1
            best = np.minimum(along, above)
            costs = np.minimum.accumulate(best - slope, axis=1) + slope
        end = costs.argmin(axis=1)
        return costs[np.arange(len(firsts)), end], firsts + end + len(own)

    def matches(self, codes) -> list[tuple[int, int, int]]:
        """(item, edits, end) of verified regions in one array of characters."""
        import numpy as np

        found = self.regions(codes)
        kept = []
        for item in np.unique(found[:, 0]):
            rows = found[found[:, 0] == item]
            for start in range(0, len(rows), 512):
                part = rows[start : start + 512]
                edits, ends = self.verify(codes, int(item), part[:, 1], part[:, 2])
                good = edits <= self.budgets[item]
                kept.extend(zip([int(item)] * int(good.sum()), edits[good].tolist(), ends[good].tolist(), strict=True))
        return kept


def find(items: Items, ids: list, texts: list[str]) -> list[tuple]:
    """(doc_id, item_id, edits, end, length) of the best match of each pair."""
    import numpy as np

    best: dict[tuple[int, int], tuple[int, int]] = {}
    if not items.texts:
        return []
    gap = np.full(items.longest + Q, SEPARATOR, dtype="<u4")

    def search(parts: list, rows: list[int], offsets: list[int]) -> None:
        # Texts stand apart by more than an item, so that a match lies in one of them.
        starts = np.cumsum([0] + [len(p) + len(gap) for p in parts])
        codes = np.concatenate([x for p in parts for x in (p, gap)])
        for item, edits, end in items.matches(codes):
            part = int(np.searchsorted(starts, end - 1, side="right")) - 1
            key = (rows[part], item)
            value = (edits, offsets[part] + end - int(starts[part]))
            if key not in best or value < best[key]:
                best[key] = value

    parts, rows, offsets, size = [], [], [], 0
    overlap = 3 * items.longest + Q
    for row, text in enumerate(texts):
        codes = _codes(normalized(text))
        for offset in range(0, max(1, len(codes)), STRETCH):
            part = codes[offset : offset + STRETCH + overlap]
            if len(part) < Q:
                continue
            if size + len(part) > STRETCH and parts:
                search(parts, rows, offsets)
                parts, rows, offsets, size = [], [], [], 0
            parts.append(part)
            rows.append(row)
            offsets.append(offset)
            size += len(part)
    if parts:
        search(parts, rows, offsets)
    return [
        (ids[row], items.ids[item], edits, end, len(items.texts[item]))
        for (row, item), (edits, end) in sorted(best.items())
    ]


def _blocks(benchmark: DataFrame) -> list[list[tuple[int, str]]]:
    """Items in blocks of bounded size. One block at a time reaches the driver."""
    items = benchmark.select(
        F.col("item_id").cast("bigint").alias("item_id"), F.coalesce("text", F.lit("")).alias("text")
    ).distinct()
    total = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    count = -(-total // (BLOCK_CHARS // 2)) or 1
    number = F.pmod(F.xxhash64("item_id", "text"), F.lit(count))
    for block in range(count):
        yield [(r["item_id"], r["text"]) for r in items.where(number == block).orderBy("item_id", "text").collect()]


def _found(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, digest, item_id, edits, end, item_chars); the digest tells apart rows that share an id."""
    schema = "doc_id bigint, digest string, item_id bigint, edits int, end bigint, item_chars int"
    texts = ids_and_texts(docs).withColumn("digest", text_digest(F.col("text")))
    context = docs.sparkSession.sparkContext
    whole = None
    for block in _blocks(benchmark):
        sent = context.broadcast(block)

        def run(batches: Iterator, sent=sent) -> Iterator:
            import pandas as pd

            items = Items(sent.value)
            for batch in batches:
                ids = [
                    (None if pd.isna(i) else int(i), digest)
                    for i, digest in zip(batch["doc_id"], batch["digest"], strict=True)
                ]
                rows = [(*row[0], *row[1:]) for row in find(items, ids, batch["text"].tolist())]
                columns = ["doc_id", "digest", "item_id", "edits", "end", "item_chars"]
                yield pd.DataFrame(rows, columns=columns).astype({"doc_id": "Int64"})

        found = texts.mapInPandas(run, schema)
        whole = found if whole is None else whole.unionByName(found)
    return whole


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, edits, end, item_chars, similarity) for each document that holds an item.

    ``end`` is where the closest stretch ends in the normalised text.
    """
    found = _found(docs, benchmark).drop("digest").distinct()
    return found.withColumn("similarity", 1 - F.col("edits") / F.col("item_chars"))


def keep_uncontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose texts hold no benchmark item; all columns stay."""
    found = _found(docs, benchmark).select("doc_id", "digest").distinct()
    keys = {"doc_id": docs["doc_id"].cast("bigint"), "digest": text_digest(docs["text"])}
    return without(docs, found, keys)
