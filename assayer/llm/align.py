"""Alignment of two tokenizers over the same bytes, and how often ids meet.

Both tokenizers read the same bytes: a space and the text. Their tokens are
intervals over these bytes. All intervals, of both sides, are sorted by start;
with the running maximum of their ends, a group begins where a start reaches all
ends before it. Inside a group, every token is expanded to the tokens of the other
side that it overlaps; two that end together are a link.

No token of either side goes over the start of a word (``words``), so a distinct
word is aligned once for a block of texts, all words of a block in one sort.

How often two ids are linked is counted over all documents. The counts are as many
as pairs of ids that meet, which the vocabularies bound, not the documents. Up to
``PAIRS_HELD`` of them are sent to the workers; beyond, the documents' distinct
pairs are joined to them.

Null and empty texts have no tokens. Neither has a text whose bytes one side
does not give back (U+2581, which the second one reads as a space). Rows are
counted one by one: repeated rows, ids and null ids as often as they stand there.
Texts of any length are taken in blocks and never cut short. An empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm.bpe import default_path
from assayer.llm.common import stored
from assayer.session import join_small

#: Pairs of ids, with their counts, that workers hold at most; 17 bytes each.
PAIRS_HELD = 3_000_000
PIECE_SPACE = "▁"
#: Bytes of text aligned at once.
BLOCK_BYTES = 5 << 20
B_BITS = 32


def default_piece_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def coalesced(starts_a, ends_a, starts_b, ends_b):
    """(group of each A token, group of each B token, number of groups)."""
    import numpy as np

    starts, ends = np.concatenate([starts_a, starts_b]), np.concatenate([ends_a, ends_b])
    order = np.lexsort((ends, starts))
    reached = np.maximum.accumulate(ends[order])
    opens = np.ones(len(order), dtype=bool)
    opens[1:] = starts[order][1:] >= reached[:-1]
    groups = np.empty(len(order), dtype=np.int64)
    groups[order] = np.cumsum(opens) - 1
    return groups[: len(starts_a)], groups[len(starts_a) :], int(opens.sum())


def overlaps(starts_a, ends_a, starts_b, ends_b):
    """(A token, B token) of all pairs that share a byte; both sides in order and without gaps."""
    import numpy as np

    first = np.searchsorted(ends_b, starts_a, side="right")
    counts = np.searchsorted(starts_b, ends_a, side="left") - first
    before = np.cumsum(counts) - counts
    a = np.repeat(np.arange(len(starts_a)), counts)
    return a, np.arange(len(a)) - np.repeat(before - first, counts)


class Aligner:
    """The two tokenizers, and the alignment of lists of words."""

    def __init__(self, path_a: str, path_b: str) -> None:
        import numpy as np
        import sentencepiece

        from assayer.llm.token_store import LibraryEncoder
        from assayer.llm.words import Ragged, WordMemory

        self.a = LibraryEncoder(path_a, special_as_text=True)
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        spelled = []
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            if self.b.is_byte(i):
                spelled.append(bytes([int(piece[3:-1], 16)]))
            else:
                spelled.append(piece.replace(PIECE_SPACE, " ").encode("utf-8"))
        sizes = lambda parts: np.array([len(p) for p in parts], dtype=np.int64)
        flat = lambda parts: np.frombuffer(b"".join(parts), dtype=np.uint8)
        self.spelled_b = Ragged(flat(spelled), sizes(spelled))
        # Ids in decimal, with room for the sign that follows.
        decimal = [b"%d;" % i for i in range(max(len(spelled), len(self.a.lengths)))]
        self.decimal = Ragged(flat(decimal), sizes(decimal))
        self.memory = WordMemory(self.align)

    def align(self, words: list[bytes]):
        """Columns of words that start with a space: ``figures`` (whole, A tokens, B tokens,
        groups), ``links`` (codes of linked ids) and ``text`` (the groups' ids)."""
        import numpy as np

        from assayer.llm.words import Items, Ragged

        n = len(words)
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=n)
        a = self.a.encode_words(words)["ids"]
        listed = self.b.encode([w[1:].decode("utf-8") for w in words], num_threads=1)
        b = Ragged(
            np.array([i for ids in listed for i in ids], dtype=np.int64),
            np.fromiter(map(len, listed), dtype=np.int64, count=n),
        )
        whole = self._given_back(words, sizes, b)
        keep = np.flatnonzero(whole)
        a, b = a.take(keep), b.take(keep)
        ids_a, ids_b = a.values.astype(np.int64), b.values
        # Words in a row, without those that are not whole: both sides cover every byte.
        ends_a, ends_b = np.cumsum(self.a.lengths[ids_a]), np.cumsum(self.spelled_b.counts[ids_b])
        starts_a, starts_b = ends_a - self.a.lengths[ids_a], ends_b - self.spelled_b.counts[ids_b]
        groups_a, groups_b, groups = coalesced(starts_a, ends_a, starts_b, ends_b)
        word_a = np.repeat(keep, a.counts)
        word_b = np.repeat(keep, b.counts)
        word_of_group = np.empty(groups, dtype=np.int64)
        word_of_group[groups_a] = word_a
        left, right = overlaps(starts_a, ends_a, starts_b, ends_b)
        linked = ends_a[left] == ends_b[right]
        left, right = left[linked], right[linked]
        codes = (ids_a[left] << B_BITS) | ids_b[right]
        per_word = lambda x: np.bincount(x, minlength=n)
        figures = np.stack([whole, per_word(word_a), per_word(word_b), per_word(word_of_group)], axis=1)
        # Within a group A's ids, then B's; both sides are in the order of the bytes.
        side = np.concatenate([2 * groups_a, 2 * groups_b + 1])
        order = np.argsort(side, kind="stable")
        side = side[order]
        text = self.decimal.take(np.concatenate([ids_a, ids_b])[order])
        last = np.ones(len(side), dtype=bool)
        last[:-1] = side[1:] != side[:-1]
        signs = np.where(last, np.where(side % 2 == 0, ord("|"), ord(";")), ord(","))
        text.values[text.bounds()[1:] - 1] = signs
        word_of_text = np.concatenate([word_a, word_b])[order]
        lengths = np.bincount(word_of_text, weights=text.counts, minlength=n).astype(np.int64)
        cut, raw = [0, *np.cumsum(lengths).tolist()], text.values.tobytes()
        spelled = np.empty(n, dtype=object)
        spelled[:] = [raw[i:j] for i, j in zip(cut[:-1], cut[1:], strict=True)]
        return {
            "figures": Ragged(figures.astype(np.int64).ravel(), np.full(n, 4)),
            "links": Ragged(codes, per_word(word_a[left])),
            "text": Items(spelled),
        }

    def _given_back(self, words: list[bytes], sizes, b):
        """Whether the second side's pieces spell each word."""
        import numpy as np

        spelled = self.spelled_b.take(b.values)
        ends = np.concatenate([[0], np.cumsum(spelled.counts)])[b.bounds()]
        whole = np.diff(ends) == sizes
        some = np.flatnonzero(whole)
        data = np.frombuffer(b"".join([words[i] for i in some.tolist()]), dtype=np.uint8)
        from assayer.llm.words import Ragged

        differs = Ragged(spelled.values, np.diff(ends)).take(some).values != data
        wrong = np.add.reduceat(differs, np.cumsum(sizes[some]) - sizes[some]) > 0 if len(some) else differs
        whole[some[wrong]] = False
        return whole


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def aligner(path_a: str, path_b: str) -> Aligner:
    if (path_a, path_b) not in _ALIGNERS:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        _ALIGNERS[path_a, path_b] = Aligner(path_a, path_b)
    return _ALIGNERS[path_a, path_b]


@dataclass
class Aligned:
    """Alignments of some texts: figures by text, linked pairs with their number, groups' texts."""

    figures: object
    pairs: list
    times: list
    pair_counts: object
    digests: list[str]
    groups: list[str | None]


def align_texts(texts, known: Aligner, with_groups: bool = False) -> Aligned:
    """Align an Arrow array of texts."""
    import numpy as np

    from assayer.llm.words import blocks

    n = len(texts)
    figures = np.zeros((n, 4), dtype=np.int64)
    figures[:, 0] = 1
    pairs, times, pair_counts = [], [], np.zeros(n, dtype=np.int64)
    digests, spelled, last = [hashlib.sha256() for _ in range(n)], [b""] * n, [b""] * n
    for block in blocks(texts, space_first=True, block_bytes=BLOCK_BYTES):
        rows, columns = known.memory.columns(block)
        if columns is None:
            continue
        bounds = np.concatenate([[0], np.cumsum(block.words_of)])
        table = columns["figures"].values.reshape(-1, 4)[rows]
        sums = np.concatenate([np.zeros((1, 4), dtype=np.int64), np.cumsum(table, axis=0)])
        sums = sums[bounds[1:]] - sums[bounds[:-1]]
        whole = sums[:, 0] == block.words_of
        np.add.at(figures, (block.owners, slice(1, 4)), sums[:, 1:])
        figures[block.owners[~whole], 0] = 0
        links = columns["links"].take(rows)
        link_bounds = links.bounds()[bounds]
        part = np.repeat(np.arange(len(block.owners)), np.diff(link_bounds))
        order = np.lexsort((links.values, part))
        codes, part = links.values[order], part[order]
        first = np.ones(len(codes), dtype=bool)
        first[1:] = (codes[1:] != codes[:-1]) | (part[1:] != part[:-1])
        at = np.flatnonzero(first)
        pairs.append(codes[at])
        times.append(np.diff(np.concatenate([at, [len(codes)]])).astype(np.int32))
        np.add.at(pair_counts, block.owners, np.bincount(part[at], minlength=len(block.owners)))
        text, cut = columns["text"].take(rows).values.tolist(), bounds.tolist()
        for k, owner in enumerate(block.owners.tolist()):
            joined = b"".join(text[cut[k] : cut[k + 1]])
            if joined:
                digests[owner].update(last[owner] + joined[:-1])
                last[owner] = b";"
                if with_groups:
                    spelled[owner] += joined
    flat = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
    pairs, times = flat(pairs, np.int64), flat(times, np.int32)
    # Texts that are not given back, and those without words, have no tokens.
    none = (figures[:, 0] == 0) | (figures[:, 1] == 0)
    keep = np.repeat(~none, pair_counts)
    pair_counts[none] = 0
    figures[none] = 0
    return Aligned(
        figures,
        pairs[keep],
        times[keep],
        pair_counts,
        ["" if empty else d.hexdigest() for d, empty in zip(digests, none.tolist(), strict=True)],
        [None if empty or not with_groups else g[:-1].decode() for g, empty in zip(spelled, none.tolist(), strict=True)],
    )


def alignments(
    docs: DataFrame, path_a: str | None = None, path_b: str | None = None, with_groups: bool = False
) -> DataFrame:
    """Per row: a number of its own, doc_id, figures, the groups' digest (and on request their
    ids as text), and its distinct linked ``pairs`` with how often each is linked.

    Runs inside the scan. A row's number is its partition and its place in it, so the
    result is stored before it is read twice.
    """
    path_a, path_b = path_a or default_path(), path_b or default_piece_path()

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        at = TaskContext.get().partitionId() << 40
        known = aligner(path_a, path_b)
        for batch in batches:
            done = align_texts(batch.column(1), known, with_groups)
            bounds = pa.array(np.concatenate([[0], np.cumsum(done.pair_counts)]).astype(np.int32))
            n = len(done.digests)
            arrays = [
                pa.array(at + np.arange(n)),
                batch.column(0),
                *(pa.array(done.figures[:, k]) for k in (1, 2, 3)),
                pa.array(done.digests),
                pa.ListArray.from_arrays(bounds, pa.array(done.pairs)),
                pa.ListArray.from_arrays(bounds, pa.array(done.times)),
            ]
            at += n
            yield pa.RecordBatch.from_arrays(
                arrays + [pa.array(done.groups, pa.string())] * with_groups, names + ["groups"] * with_groups
            )

    kinds = "row bigint, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, groups_sha256 string, pairs array<bigint>, times array<int>"
    names = [column.split(" ")[0] for column in kinds.split(", ")]
    texts = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    )
    return texts.mapInArrow(run, kinds + ", groups string" * with_groups)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, n, best): links of each pair of ids in all documents; whether no other pair
    of its B id has more."""
    counted = (
        aligned.select(F.explode(F.arrays_zip("pairs", "times")).alias("p"))
        .groupBy(F.col("p.pairs").alias("pair"))
        .agg(F.sum("p.times").alias("n"))
        .withColumn("b", F.col("pair").bitwiseAND(F.lit((1 << B_BITS) - 1)))
    )
    counted = stored(counted, "align-counts")
    most = counted.groupBy("b").agg(F.max("n").alias("most"))
    return counted.join(most, "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def _summed_in_workers(aligned: DataFrame, counts: DataFrame) -> DataFrame:
    import numpy as np

    rows = counts.orderBy("pair").toArrow()
    sent = aligned.sparkSession.sparkContext.broadcast(
        tuple(np.asarray(rows.column(name).combine_chunks()) if rows.num_rows else np.zeros(0, np.int64) for name in ("pair", "n"))
        + (rows.column("best").to_numpy().astype(bool),)
    )
    figures = ["doc_id", "n_a", "n_b", "n_groups", "groups_sha256"]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        pair, n, best = sent.value
        for batch in batches:
            pairs, times = (batch.column(k).flatten().to_numpy() for k in (5, 6))
            bounds = np.concatenate([[0], np.cumsum(batch.column(5).value_lengths().to_numpy())])
            at = np.searchsorted(pair, pairs)
            sums = []
            for values in (times, times * best[at] if len(at) else times, times * n[at] if len(at) else times):
                total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
                sums.append(pa.array(total[bounds[1:]] - total[bounds[:-1]]))
            yield pa.RecordBatch.from_arrays(batch.columns[:5] + sums, [*figures, "n_links", "n_best", "count_sum"])

    return aligned.select(*figures, "pairs", "times").mapInArrow(
        run,
        "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, groups_sha256 string, "
        "n_links bigint, n_best bigint, count_sum bigint",
    )


def _summed_by_join(aligned: DataFrame, counts: DataFrame) -> DataFrame:
    listed = aligned.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("p")).select(
        "row", F.col("p.pairs").alias("pair"), F.col("p.times").cast("bigint").alias("times")
    )
    sums = (
        join_small(listed, counts, "pair")
        .groupBy("row")
        .agg(
            F.sum("times").alias("n_links"),
            F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"),
            F.sum(F.col("times") * F.col("n")).alias("count_sum"),
        )
    )
    zero = lambda name: F.coalesce(name, F.lit(0)).alias(name)
    return aligned.drop("pairs", "times").join(sums, "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "groups_sha256", zero("n_links"), zero("n_best"), zero("count_sum")
    )


def link_figures(docs: DataFrame, path_a: str | None = None, path_b: str | None = None, held: int = PAIRS_HELD) -> DataFrame:
    """Per row: tokens of both sides, groups, links, and the links' counts over all documents."""
    aligned = stored(alignments(docs, path_a, path_b), "align-rows")
    counts = stored(pair_counts(aligned), "align-pairs")
    if counts.limit(held + 1).count() <= held:
        return _summed_in_workers(aligned, counts)
    return _summed_by_join(aligned, counts)
