"""Bytes that a document shares with an earlier one, found in suffix arrays.

Every stretch of ``MATCH_BYTES`` bytes that also starts in a document with a smaller
doc_id is removed from the later ones. Texts are bytes in UTF-8; matches never cross
documents.

*Where equal stretches meet.* Of the ``GRAM_BYTES``-byte grams of a stretch, the
first one with the least hash is its anchor. Stretches that follow one another and
have the same anchor make up a segment, so each stretch lies in one segment, and
equal stretches have equal anchors in the same place. Texts are held in stored
blocks; only (anchor, segment, least doc_id) moves at first, once for each block.
From that, equal segments are one, and all of them but those of the least document
are removed. What is left to compare are the different segments of one anchor.

*Suffix arrays.* They are cut into letters of ``LETTER_BYTES`` bytes from their
anchor on, and a task sorts the suffixes of many segments at once
(``suffix_array``): suffixes are grouped by their first letter, and the groups by what
follows, which doubles the letters that a group shares each time. Only groups of several
are sorted again, and none shares more letters than a segment has, so that a few rounds
are enough. Neighbours in the array that share all letters of a stretch are compared by
the few bytes at its edges that the letters do not cover; the least document of each
keeps it.

*Hot anchors.* An anchor with more than ``BLOCK_SEGMENTS`` different segments in one
block, or ``SEED_SEGMENTS`` in all, does not go to one task: its stretches are dealt
by 128-bit hashes of their own, each once for a block.

Null texts are empty. A null doc_id counts as larger than any other: such a row
loses what others have and takes nothing from them. Rows that repeat a doc_id are no
earlier than one another and each is a row of the result. Texts shorter than a stretch
stay whole. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm.common import stored
from assayer.llm.words import Ragged

MATCH_BYTES = 50
GRAM_BYTES = 16
GRAMS = MATCH_BYTES - GRAM_BYTES + 1
#: Bytes of a letter. A stretch covers so many whole letters wherever it starts.
LETTER_BYTES = 8
LETTERS = (MATCH_BYTES - LETTER_BYTES + 1) // LETTER_BYTES
EDGE_BYTES = MATCH_BYTES - LETTERS * LETTER_BYTES
#: Text of a block, unless one document is longer, and positions worked on at once.
BLOCK_BYTES = 2 << 20
SCAN_BYTES = 1 << 18
#: Text whose anchors one task compares, and segments that are sorted at once.
SEED_BYTES = 24 << 20
SORT_SEGMENTS = 12_000
#: Segments of a sorting task, which sorts them in parts, and stretches around hot anchors of
#: a task. Every block has a row for every task, so tasks are no more than needed.
TASK_SEGMENTS, HOT_STRETCHES = 16 * SORT_SEGMENTS, 1_000_000
#: Tasks for every core, if there is work for them.
CORE_TASKS = 4
#: Different segments of one anchor, beyond which its stretches are dealt by hash.
BLOCK_SEGMENTS, SEED_SEGMENTS = 64, 20_000
NO_ID = (1 << 63) - 1
#: What is known of a segment: an earlier document has it; it must be sorted; its
#: anchor is hot.
EARLIER, SORT, HOT = 1, 2, 4
BLOCK_SCHEMA = "block bigint, ids array<bigint>, sizes array<bigint>, data binary"
# Odd multipliers and a table of random values for the rolling hashes.
_DRAW = np.random.Generator(np.random.PCG64(1729))
_TABLE = _DRAW.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = int(_DRAW.integers(1 << 61, 1 << 62)) * 2 + 1
_UNBASE = pow(_BASE, -1, 1 << 64)


def _mix(values):
    """SplitMix64 finalizer over an array of unsigned 64-bit integers."""
    z = values + np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def _runs(values: np.ndarray) -> list[tuple[int, int]]:
    """(from, until) of the runs of equal values."""
    if not len(values):
        return []
    cuts = [0, *(np.flatnonzero(values[1:] != values[:-1]) + 1).tolist(), len(values)]
    return list(zip(cuts[:-1], cuts[1:], strict=True))


# --- suffix arrays -------------------------------------------------------------------


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Starts of the suffixes of ``text`` in order; its last letter is its only least one."""
    order = np.argsort(text, kind="stable")
    letters = text[order]
    # A suffix has the place of its group's first one; groups share their first ``span`` letters.
    first = np.concatenate([[True], letters[1:] != letters[:-1]])
    place = np.empty(len(text), dtype=np.int64)
    place[order] = np.flatnonzero(first)[np.cumsum(first) - 1]
    span = 1
    while not first.all():
        at = np.flatnonzero(~first | ~np.concatenate([first[1:], [True]]))
        some = order[at]
        # The last letter is in no group of several, so what follows a member's letters is a suffix.
        key = place[some] * len(text) + place[some + span]
        by_key = np.argsort(key)
        some, key = some[by_key], key[by_key]
        order[at] = some
        first[at] = new = np.concatenate([[True], key[1:] != key[:-1]])
        place[some] = at[np.flatnonzero(new)][np.cumsum(new) - 1]
        span *= 2
    return order


def earlier_stretches(data: np.ndarray, sizes: np.ndarray, anchors: np.ndarray, docs: np.ndarray):
    """(segment, offset) of the stretches that a segment of a smaller document also has.

    ``data`` holds the segments in a row, ``anchors`` the place of each one's anchor.
    """
    ends = np.cumsum(sizes)
    starts = ends - sizes
    lead = anchors % LETTER_BYTES
    counts = (sizes - lead) // LETTER_BYTES
    segment = np.repeat(np.arange(len(sizes)), counts)
    within = np.arange(len(segment)) - np.repeat(np.cumsum(counts) - counts, counts)
    at = (starts + lead)[segment] + LETTER_BYTES * within
    letters = np.zeros(len(at), dtype=np.uint64)
    for k in range(LETTER_BYTES):
        letters = letters << np.uint64(8) | data[at + k]
    # Every segment ends with a sign of its own, the less the later.
    m = len(sizes)
    ranks = np.unique(letters, return_inverse=True)[1] + m
    slots = np.arange(len(at)) + segment
    text = np.empty(len(at) + m, dtype=np.int64)
    text[slots] = ranks
    text[np.cumsum(counts + 1) - 1] = np.arange(m)[::-1]
    letter_at = np.full(len(text), -1, dtype=np.int64)
    letter_at[slots] = np.arange(len(at))
    left = np.zeros(len(text), dtype=np.int64)
    left[slots] = counts[segment] - within
    order = suffix_array(text)
    order = order[left[order] >= LETTERS]
    if len(order) < 2:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    alike = np.ones(len(order) - 1, dtype=bool)
    for k in range(LETTERS):
        alike &= text[order[1:] + k] == text[order[:-1] + k]
    run = np.concatenate([[0], np.cumsum(~alike)])
    shared = np.zeros(len(order), dtype=bool)
    shared[1:] |= alike
    shared[:-1] |= alike
    run, letter = run[shared], letter_at[order[shared]]
    # A stretch starts up to LETTER_BYTES - 1 bytes before its first whole letter.
    parts = []
    for before in range(LETTER_BYTES):
        first = at[letter] - before
        s = segment[letter]
        fits = (first >= starts[s]) & (first + MATCH_BYTES <= ends[s])
        first, s = first[fits], s[fits]
        edges = np.full((2, len(first)), before, dtype=np.uint64)
        tail = first + before + LETTERS * LETTER_BYTES
        for k in range(EDGE_BYTES):
            half = edges[2 * k // EDGE_BYTES]
            half[:] = half << np.uint64(8) | data[first + k if k < before else tail + k - before]
        parts.append((run[fits], edges[0], edges[1], s, first - starts[s]))
    run, head, tail, s, offset = (np.concatenate(x) for x in zip(*parts, strict=True))
    if not len(run):
        return run, run
    order = np.lexsort((tail, head, run))
    new = np.ones(len(order), dtype=bool)
    new[1:] = False
    for key in (run, head, tail):
        new[1:] |= key[order][1:] != key[order][:-1]
    least = np.minimum.reduceat(docs[s[order]], np.flatnonzero(new))[np.cumsum(new) - 1]
    late = order[docs[s[order]] > least]
    return s[late], offset[late]


# --- segments of a block ------------------------------------------------------------------


def _sliding_least(values, width: int):
    """Least of every ``width`` successive values."""
    span = 1
    while 2 * span <= width:
        values = np.minimum(values[:-span], values[span:])
        span *= 2
    rest = width - span
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def _gram_hashes(data):
    """A 32-bit hash of the gram at every place."""
    values = (_TABLE[data] >> np.uint64(32)).astype(np.uint32)
    span, factor = 1, 0x9E3779B1
    while span < GRAM_BYTES:
        values = values[:-span] * np.uint32(factor) + values[span:]
        factor = factor * factor % (1 << 32)
        span *= 2
    values = (values ^ (values >> np.uint32(16))) * np.uint32(0x7FEB352D)
    return values ^ (values >> np.uint32(15))


def segments(data: np.ndarray, sizes: np.ndarray):
    """(start, end, anchor, document, anchor's hash, segment's hash) of a block's segments."""
    ends = np.cumsum(sizes)
    found = []
    for lo in range(0, max(0, len(data) - MATCH_BYTES + 1), SCAN_BYTES):
        part = data[lo : lo + SCAN_BYTES + MATCH_BYTES - 1]
        count = len(part) - MATCH_BYTES + 1
        keys = (_gram_hashes(part).astype(np.uint64) << np.uint64(32)) | np.arange(
            len(part) - GRAM_BYTES + 1, dtype=np.uint64
        )
        anchor = (_sliding_least(keys, GRAMS) & np.uint64(0xFFFFFFFF)).astype(np.int64)
        # Stretches of two documents are none.
        cut = ends[np.searchsorted(ends, lo, side="right") : np.searchsorted(ends, lo + len(part), side="left")] - lo
        for end in cut.tolist():
            anchor[max(0, end - MATCH_BYTES + 1) : end] = -1
        bound = np.flatnonzero(anchor[1:] != anchor[:-1]) + 1
        first = np.concatenate([[0], bound])
        last = np.concatenate([bound, [count]]) - 1
        keep = anchor[first] >= 0
        first, last = first[keep], last[keep]
        own = anchor[first]
        end = last + MATCH_BYTES
        grams = np.lib.stride_tricks.sliding_window_view(part, GRAM_BYTES)[own].view(np.uint64)
        seed = _mix(grams[:, 0] ^ _mix(grams[:, 1]))
        with np.errstate(over="ignore"):
            sums = np.concatenate([[np.uint64(0)], np.cumsum(_TABLE[part] * _powers(_BASE)[: len(part)])])
            inner = (sums[end] - sums[first]) * _powers(_UNBASE)[first]
        segment = _mix(inner + (end - first).astype(np.uint64))
        segment[segment == 0] = 1
        found.append((first + lo, end + lo, own + lo, seed, segment))
    if not found:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    start, end, anchor, seed, segment = (np.concatenate(x) for x in zip(*found, strict=True))
    return start, end, anchor, np.searchsorted(ends, start, side="right"), seed, segment


_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int) -> np.ndarray:
    if base not in _POWERS:
        values = np.ones(1, dtype=np.uint64)
        factor = base
        while len(values) < SCAN_BYTES + MATCH_BYTES:
            values = np.concatenate([values, values * np.uint64(factor)])
            factor = factor * factor % (1 << 64)
        _POWERS[base] = values
    return _POWERS[base]


class Block:
    """A block's segments, and its different ones in the order in which buckets list them."""

    def __init__(self, ids, sizes, data: bytes, buckets: int) -> None:
        self.data = np.frombuffer(data, dtype=np.uint8)
        self.sizes = np.asarray(sizes, dtype=np.int64)
        self.docs = np.array([NO_ID if i is None else i for i in ids], dtype=np.int64)
        self.start, self.end, self.anchor, doc, seed, segment = segments(self.data, self.sizes)
        self.doc = self.docs[doc]
        order = np.lexsort((self.doc, segment, seed))
        same_seed = seed[order][1:] == seed[order][:-1]
        new = np.ones(len(order), dtype=bool)
        new[1:] = ~same_seed | (segment[order][1:] != segment[order][:-1])
        new_seed = np.ones(len(order), dtype=bool)
        new_seed[1:] = ~same_seed
        # The segments that are different, first met in the least document.
        first = order[new]
        self.entry = np.empty(len(order), dtype=np.int64)
        self.entry[order] = np.cumsum(new) - 1
        number = np.cumsum(new_seed)[new] - 1
        hot = np.bincount(number, minlength=1)[number] > BLOCK_SEGMENTS
        listed = np.ones(len(first), dtype=bool)
        listed[1:] = ~hot[1:] | (number[1:] != number[:-1])
        self.seeds, self.segments = seed[first], np.where(hot, np.uint64(0), segment[first])
        self.least, self.hot = self.doc[first], hot
        #: Only one entry stands for the segments of an anchor that is hot in this block.
        self.listed_as = np.cumsum(listed) - 1
        entries = np.flatnonzero(listed)
        bucket = (self.seeds[entries] % np.uint64(buckets)).astype(np.int64)
        by_bucket = np.lexsort((self.least[entries], bucket))
        self.listed, self.bucket = entries[by_bucket], bucket[by_bucket]
        own = hot * (self.end[first] - self.start[first] - MATCH_BYTES + 1)
        #: Stretches of the segments that an entry of a hot anchor stands for.
        self.stretches = np.bincount(self.listed_as, weights=own, minlength=len(entries))[by_bucket].astype(np.int64)
        self.place = np.empty(len(entries), dtype=np.int64)
        self.place[by_bucket] = np.arange(len(entries))

    def buckets(self) -> Iterator[tuple]:
        """(bucket, anchors, segments, steps between least documents) of its entries."""
        for lo, hi in _runs(self.bucket):
            at = self.listed[lo:hi]
            # The low bits of an anchor's hash are the bucket's.
            seeds = (self.seeds[at] >> np.uint64(32)).astype(np.uint32).view(np.int32)
            steps = np.diff(self.least[at], prepend=0)
            yield int(self.bucket[lo]), seeds, self.segments[at].view(np.int64), steps

    def hot_stretches(self) -> list[int]:
        """By bucket, in the order of ``buckets``: stretches around anchors that are hot in this block."""
        return [int(self.stretches[lo:hi].sum()) for lo, hi in _runs(self.bucket)]

    def marks(self, flags: dict[int, bytes]) -> np.ndarray:
        """What is known of each segment of the block, from the buckets' flags."""
        listed = np.frombuffer(b"".join(flags[b] for b in sorted(flags)), dtype=np.uint8)
        of_entry = listed[self.place[self.listed_as]] if len(listed) else np.zeros(0, dtype=np.uint8)
        return of_entry[self.entry]


# --- stages ---------------------------------------------------------------------------------


def text_blocks(docs: DataFrame) -> DataFrame:
    """(block, ids, sizes, data): texts in blocks, compressed; a block has a number of its own."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import zstandard
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        packer = zstandard.ZstdCompressor(level=3)
        ids, texts, size = [], [], 0

        def block():
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([number]),
                    pa.array([ids], pa.list_(pa.int64())),
                    pa.array([[len(t) for t in texts]], pa.list_(pa.int64())),
                    pa.array([packer.compress(b"".join(texts))], pa.binary()),
                ],
                ["block", "ids", "sizes", "data"],
            )

        for batch in batches:
            column = batch.column(1).cast(pa.binary())
            for i, doc_id in enumerate(batch.column(0).to_pylist()):
                text = column[i].as_py()
                if texts and size + len(text) > BLOCK_BYTES:
                    yield block()
                    number += 1
                    ids, texts, size = [], [], 0
                ids.append(doc_id)
                texts.append(text)
                size += len(text)
        if texts:
            yield block()

    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    )
    return rows.mapInArrow(run, BLOCK_SCHEMA)


def _opened(batch, buckets: int) -> Iterator[tuple[int, Block]]:
    import zstandard

    unpacker = zstandard.ZstdDecompressor()
    for i in range(batch.num_rows):
        row = [batch.column(k)[i].as_py() for k in range(4)]
        yield row[0], Block(row[1], row[2], unpacker.decompress(row[3]), buckets)


def segment_flags(blocks: DataFrame, buckets: int) -> DataFrame:
    """(block, bucket, flags, to_sort, hot, hot_stretches): what is known of a block's segments in a bucket."""

    def scan(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for number, block in _opened(batch, buckets):
                listed = list(block.buckets())
                if not listed:
                    continue
                columns = [pa.array([number] * len(listed)), pa.array([b for b, *_ in listed], pa.int32())]
                for k, kind in ((1, pa.int32()), (2, pa.int64()), (3, pa.int64())):
                    columns.append(pa.array([row[k] for row in listed], pa.list_(kind)))
                columns.append(pa.array(block.hot_stretches(), pa.int64()))
                yield pa.RecordBatch.from_arrays(columns, ["block", "bucket", "seeds", "segments", "steps", "stretches"])

    def compare(rows):
        import pandas as pd

        counts = rows["seeds"].map(len).to_numpy()
        seed = np.concatenate(rows["seeds"].tolist()).astype(np.int32)
        segment = np.concatenate(rows["segments"].tolist()).astype(np.int64)
        least = np.concatenate([np.cumsum(np.asarray(s)) for s in rows["steps"]]).astype(np.int64)
        order = np.lexsort((least, segment, seed))
        seed, segment, least = seed[order], segment[order], least[order]
        new_seed = np.concatenate([[True], seed[1:] != seed[:-1]])
        new = new_seed | np.concatenate([[True], segment[1:] != segment[:-1]])
        of_segment, of_seed = np.cumsum(new) - 1, np.cumsum(new_seed) - 1
        # Entries are in the order of their documents: the first of a segment has the least.
        first = least[new]
        seed_of = of_seed[new]
        bound = np.flatnonzero(np.concatenate([[True], seed_of[1:] != seed_of[:-1]]))
        several = np.minimum.reduceat(first, bound) != np.maximum.reduceat(first, bound)
        hot = (np.bincount(seed_of) > SEED_SEGMENTS) | (np.bincount(seed_of, weights=segment[new] == 0) > 0)
        earlier = (least > first[of_segment]) & (segment != 0)
        flags = np.empty(len(order), dtype=np.uint8)
        flags[order] = (
            EARLIER * earlier + SORT * (~earlier & (several & ~hot)[of_seed]) + HOT * hot[of_seed]
        ).astype(np.uint8)
        # An entry that only its anchor's other blocks make hot is one segment.
        wide = np.empty(len(order), dtype=bool)
        wide[order] = hot[of_seed] & ~earlier & (segment != 0)
        cut, wide = (np.split(x, np.cumsum(counts)[:-1]) for x in (flags, wide))
        return pd.DataFrame(
            {
                "block": rows["block"],
                "bucket": rows["bucket"],
                "flags": [c.tobytes() for c in cut],
                "to_sort": [int(np.count_nonzero(c & SORT)) for c in cut],
                "hot": [bool(np.any(c & HOT)) for c in cut],
                "hot_stretches": [int(n + GRAMS * np.count_nonzero(w)) for n, w in zip(rows["stretches"], wide, strict=True)],
            }
        )

    return (
        blocks.mapInArrow(
            scan, "block bigint, bucket int, seeds array<int>, segments array<bigint>, steps array<bigint>, stretches bigint"
        )
        .groupBy("bucket")
        .applyInPandas(
            compare, "block bigint, bucket int, flags binary, to_sort bigint, hot boolean, hot_stretches bigint"
        )
    )


def _marked(batch, buckets: int) -> Iterator[tuple[int, Block, np.ndarray]]:
    """Blocks with what is known of their segments; the fifth column has the buckets' flags."""
    for i, (number, block) in enumerate(_opened(batch, buckets)):
        flags = {f["bucket"]: f["flags"] for f in batch.column(4)[i].as_py() or []}
        yield number, block, block.marks(flags)


def _merged(block: np.ndarray, start: np.ndarray, end: np.ndarray):
    """Ranges that touch or overlap in one block, as one; in order."""
    order = np.lexsort((start, block))
    block, start, end = block[order], start[order], end[order]
    # Blocks apart, the running end never reaches into the next block.
    shift = np.concatenate([[0], np.cumsum(block[1:] != block[:-1])]) if len(block) else block
    far = (end.max() + 1 if len(end) else 0) * shift
    reach = np.maximum.accumulate(end + far)
    new = np.ones(len(block), dtype=bool)
    new[1:] = (start + far)[1:] > reach[:-1]
    last = np.flatnonzero(np.concatenate([new[1:], [True]])) if len(new) else new
    return block[new], start[new], (reach - far)[last]


SORT_SCHEMA = (
    "task int, block bigint, data binary, parts array<int>, sizes array<int>, anchors array<int>, docs array<bigint>, "
    "times array<int>, starts array<int>, from array<int>, until array<int>"
)


def _to_sort(number: int, block: Block, marks: np.ndarray, tasks: int, parts: int) -> Iterator[tuple]:
    """Rows for the sorting tasks: first what is removed already, then segments by task."""
    own = block.doc == block.least[block.entry]
    cold = (marks & HOT) == 0
    gone = ((marks & EARLIER) > 0) | (cold & ~own)
    _, start, end = _merged(np.zeros(int(gone.sum()), dtype=np.int64), block.start[gone], block.end[gone])
    none = np.zeros(0, dtype=np.int64)
    yield (-1 - number % tasks, number, b"", none, none, none, none, none, none, start, end)
    at = np.flatnonzero(((marks & SORT) > 0) & own)
    # One for all places where the least document has this segment.
    at = at[np.argsort(block.entry[at], kind="stable")]
    new = np.concatenate([[True], block.entry[at][1:] != block.entry[at][:-1]]) if len(at) else none.astype(bool)
    first = at[new]
    places = Ragged(block.start[at], np.diff(np.concatenate([np.flatnonzero(new), [len(at)]])))
    part = (_mix(block.seeds[block.entry[first]]) % np.uint64(tasks * parts)).astype(np.int64)
    task, part = part // parts, part % parts
    order = np.lexsort((part, task))
    for lo, hi in _runs(task[order]):
        some = order[lo:hi]
        s = first[some]
        data = b"".join([block.data[a:b].tobytes() for a, b in zip(block.start[s].tolist(), block.end[s].tolist(), strict=True)])
        here = places.take(some)
        yield (
            int(task[some[0]]), number, data, part[some], block.end[s] - block.start[s],
            block.anchor[s] - block.start[s], block.doc[s], here.counts, here.values, none, none,
        )


def _sorted_spans(rows):
    """Ranges to remove by block, from one task's segments or from what was known."""
    flat = lambda name: np.concatenate([np.asarray(x, dtype=np.int64) for x in rows[name]])
    counts = rows["sizes"].map(len).to_numpy()
    start, end = flat("from"), flat("until")
    block = np.repeat(rows["block"].to_numpy(), rows["from"].map(len).to_numpy())
    if counts.sum():
        data = Ragged(np.frombuffer(b"".join(rows["data"]), dtype=np.uint8), flat("sizes"))
        anchors, docs, places = flat("anchors"), flat("docs"), Ragged(flat("starts"), flat("times"))
        blocks = np.repeat(rows["block"].to_numpy(), counts)
        part = flat("parts")
        order = np.argsort(part, kind="stable")
        found = []
        for lo, hi in _runs(part[order]):
            some = order[lo:hi]
            piece = data.take(some)
            s, offset = earlier_stretches(piece.values, piece.counts, anchors[some], docs[some])
            here = places.take(some[s])
            first = here.values + np.repeat(offset, here.counts)
            found.append(_merged(np.repeat(blocks[some[s]], here.counts), first, first + MATCH_BYTES))
        block, start, end = _merged(*(np.concatenate(x) for x in zip(*found, strict=True)))
    return _spans_by_block(block, start, end)


def _spans_by_block(block: np.ndarray, start: np.ndarray, end: np.ndarray):
    """One row for each block, with its ranges in two lists."""
    import pandas as pd

    pairs = _runs(block)
    lists = lambda values: pd.Series([values[lo:hi].astype(np.int32) for lo, hi in pairs], dtype=object)
    blocks = np.array([block[lo] for lo, _ in pairs], dtype=np.int64)
    return pd.DataFrame({"block": blocks, "from": lists(start), "until": lists(end)})


HOT_SCHEMA = (
    "task int, block bigint, high array<bigint>, low array<bigint>, docs array<bigint>, "
    "times array<int>, starts array<int>"
)


def _hot_rows(number: int, block: Block, marks: np.ndarray, tasks: int) -> Iterator[tuple]:
    """Rows by task of a block's different stretches around hot anchors, with the places where
    the least document of the block has them; first the places where others have them."""
    import xxhash

    met: dict[bytes, tuple[int, list[int]]] = {}
    raw, late = block.data.tobytes(), []
    # Documents in ascending order: the first one to have a stretch is its least.
    at_hot = np.flatnonzero((marks & (HOT | EARLIER)) == HOT)
    for k in at_hot[np.argsort(block.doc[at_hot], kind="stable")].tolist():
        doc = int(block.doc[k])
        for at in range(int(block.start[k]), int(block.end[k]) - MATCH_BYTES + 1):
            least, places = met.setdefault(xxhash.xxh3_128_digest(raw[at : at + MATCH_BYTES]), (doc, []))
            (places if least == doc else late).append(at)
    none: list[int] = []
    yield (-1 - number % tasks, number, none, none, none, none, late)
    halves = np.frombuffer(b"".join(met), dtype=">u8").reshape(-1, 2)
    task = (halves[:, 0] % np.uint64(tasks)).astype(np.int64)
    order = np.argsort(task, kind="stable")
    docs = np.array([d for d, _ in met.values()], dtype=np.int64)
    places = [p for _, p in met.values()]
    for lo, hi in _runs(task[order]):
        some = order[lo:hi]
        here = [places[i] for i in some.tolist()]
        high, low = halves[some].astype(np.uint64).view(np.int64).T
        yield (
            int(task[some[0]]), number, high, low, docs[some], [len(p) for p in here], [x for p in here for x in p],
        )


def _hot_compared(rows):
    """Ranges of the stretches that an earlier document has, by block."""
    flat = lambda name: np.concatenate([np.asarray(x, dtype=np.int64) for x in rows[name]])
    counts = rows["high"].map(len).to_numpy()
    start, block = flat("starts"), np.repeat(rows["block"].to_numpy(), rows["starts"].map(len).to_numpy())
    if counts.sum():
        high, low, docs = flat("high"), flat("low"), flat("docs")
        order = np.lexsort((docs, low, high))
        new = np.ones(len(order), dtype=bool)
        new[1:] = (high[order][1:] != high[order][:-1]) | (low[order][1:] != low[order][:-1])
        least = docs[order][np.flatnonzero(new)[np.cumsum(new) - 1]]
        late = order[docs[order] > least]
        here = Ragged(start, flat("times")).take(late)
        start, block = here.values, np.repeat(np.repeat(rows["block"].to_numpy(), counts)[late], here.counts)
    block, start, end = _merged(block, start, start + MATCH_BYTES)
    return _spans_by_block(block, start, end)


def _hot_spans(marked: DataFrame, buckets: int, tasks: int) -> DataFrame:
    """(block, from, until) of stretches around hot anchors that an earlier document has.

    A stretch is one entry of its block, however often it stands there, so that no
    task gets more of a frequent one than there are blocks.
    """
    def stretches(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32())
        for batch in batches:
            for number, block, marks in _marked(batch, buckets):
                columns = list(zip(*_hot_rows(number, block, marks, tasks), strict=True))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int64())]
                    + [pa.array(list(c), pa.list_(kind)) for c, kind in zip(columns[2:], kinds, strict=True)],
                    [c.split(" ")[0] for c in HOT_SCHEMA.split(", ")],
                )

    return (
        marked.mapInArrow(stretches, HOT_SCHEMA)
        .groupBy("task")
        .applyInPandas(lambda rows: _hot_compared(rows), "block bigint, `from` array<int>, until array<int>")
    )


def sorting_tasks(segments: int, least: int) -> tuple[int, int]:
    """(tasks, parts of a task) to sort so many segments, about ``SORT_SEGMENTS`` in a part."""
    wanted = max(1, -(-segments // SORT_SEGMENTS))
    tasks = min(wanted, max(least, -(-segments // TASK_SEGMENTS)))
    return tasks, -(-wanted // tasks)


def repeated_ranges(blocks: DataFrame) -> DataFrame:
    """(block, from, until): byte ranges of each stored block that earlier documents have."""
    size = blocks.select(F.sum(F.aggregate("sizes", F.lit(0).cast("bigint"), lambda a, x: a + x))).first()[0] or 0
    buckets = max(1, -(-size // SEED_BYTES))
    flags = stored(segment_flags(blocks, buckets), "suffix-flags")
    totals = flags.agg(F.sum("to_sort"), F.max("hot"), F.sum("hot_stretches")).first()
    least = CORE_TASKS * blocks.sparkSession.sparkContext.defaultParallelism
    tasks, parts = sorting_tasks(totals[0] or 0, least)
    by_block = flags.groupBy("block").agg(F.collect_list(F.struct("bucket", "flags")).alias("flags"))
    marked = blocks.join(by_block, "block").select("block", "ids", "sizes", "data", "flags")

    def scan(batches: Iterator) -> Iterator:
        import pyarrow as pa

        lists = (*[pa.int32()] * 3, pa.int64(), *[pa.int32()] * 4)
        for batch in batches:
            for number, block, marks in _marked(batch, buckets):
                columns = list(zip(*_to_sort(number, block, marks, tasks, parts), strict=True))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.binary())]
                    + [pa.array(list(c), pa.list_(kind)) for c, kind in zip(columns[3:], lists, strict=True)],
                    [c.split(" ")[0] for c in SORT_SCHEMA.split(", ")],
                )

    schema = "block bigint, from array<int>, until array<int>"
    found = (
        marked.mapInArrow(scan, SORT_SCHEMA.replace("from ", "`from` "))
        .groupBy("task")
        .applyInPandas(lambda rows: _sorted_spans(rows), schema.replace("from ", "`from` "))
    )
    if totals[1]:
        hot = marked.join(flags.where("hot").select("block").distinct(), "block", "left_semi")
        found = found.unionByName(_hot_spans(hot, buckets, max(least, -(-totals[2] // HOT_STRETCHES))))
    return found


def deduplicated(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256; on request the bytes that
    stay, and the removed ranges of bytes."""
    blocks = stored(text_blocks(docs), "suffix-blocks")
    ranges = repeated_ranges(blocks).groupBy("block").agg(
        F.flatten(F.collect_list("from")).alias("from"), F.flatten(F.collect_list("until")).alias("until")
    )

    def cut(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import zstandard

        unpacker = zstandard.ZstdDecompressor()
        for batch in batches:
            for i in range(batch.num_rows):
                ids, sizes, packed, first, until = (batch.column(k)[i].as_py() for k in range(1, 6))
                data = np.frombuffer(unpacker.decompress(packed), dtype=np.uint8)
                step = np.zeros(len(data) + 1, dtype=np.int32)
                np.add.at(step, np.array(first or [], dtype=np.int64), 1)
                np.add.at(step, np.array(until or [], dtype=np.int64), -1)
                gone = np.cumsum(step[:-1]) > 0
                ends = np.cumsum(np.array(sizes, dtype=np.int64))
                starts = ends - sizes
                opens = gone.copy()
                opens[1:] &= ~gone[:-1]
                inner = starts[(starts > 0) & (starts < len(data))]
                opens[inner] = gone[inner]
                upto = lambda x: np.concatenate([[0], np.cumsum(x, dtype=np.int64)])
                removed, runs = upto(gone), upto(opens)
                kept = data[~gone].tobytes()
                bounds = (np.arange(len(data) + 1) - removed)[np.concatenate([starts, [len(data)]])].tolist()
                stays = [kept[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                arrays = [
                    pa.array(ids, pa.int64()),
                    pa.array(sizes, pa.int64()),
                    pa.array(removed[ends] - removed[starts]),
                    pa.array(runs[ends] - runs[starts]),
                    pa.array([hashlib.sha256(s).hexdigest() for s in stays]),
                ]
                if with_text:
                    closes = np.flatnonzero(gone & ~np.concatenate([gone[1:], [False]]) | _ends_inside(gone, ends))
                    spans = np.searchsorted(ends, np.flatnonzero(opens), side="right")
                    listed = [[] for _ in ids]
                    for d, a, b in zip(spans.tolist(), np.flatnonzero(opens).tolist(), closes.tolist(), strict=True):
                        listed[d].append({"start": a - int(starts[d]), "end": b + 1 - int(starts[d])})
                    arrays += [
                        pa.array(stays, pa.binary()),
                        pa.array(listed, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                    ]
                yield pa.RecordBatch.from_arrays(arrays, names)

    kinds = ["doc_id bigint", "n_bytes bigint", "n_removed bigint", "n_spans bigint", "kept_sha256 string"]
    if with_text:
        kinds += ["kept binary", "spans array<struct<start:bigint,end:bigint>>"]
    names = [k.split(" ")[0] for k in kinds]
    return (
        blocks.join(ranges, "block", "left")
        .select("block", "ids", "sizes", "data", "from", "until")
        .mapInArrow(cut, ", ".join(kinds))
    )


def _ends_inside(gone: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Last bytes of documents that are removed."""
    found = np.zeros(len(gone), dtype=bool)
    last = ends[ends > 0] - 1
    found[last] = gone[last]
    return found
