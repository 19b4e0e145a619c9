"""Splitting documents into overlapping, page-tagged chunks.

Packing is sequential within a document, but each chunk is a contiguous run of
segments, found from the segments' weights alone. Where a document is one row, only
those weights go to Python and nothing is shuffled. Documents whose pages are separate
rows are packed while streaming over sorted partitions, with one chunk held open.
"""

from __future__ import annotations

import itertools
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.functions import text as tx


@dataclass(frozen=True)
class ChunkSettings:
    size_tokens: int = 512
    overlap_tokens: int = 64

    def __post_init__(self) -> None:
        if self.size_tokens <= 0 or not 0 <= self.overlap_tokens < self.size_tokens:
            raise ValueError("need 0 <= overlap_tokens < size_tokens and size_tokens > 0")


def fit_segment(segment: Column, size_tokens: int) -> Column:
    """One segment as is, or its sentences, the longest of them sliced."""
    width = size_tokens * tx.CHARS_PER_TOKEN

    def slices(sentence: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.length(sentence) - 1, F.lit(0)), F.lit(width))
        cut = F.transform(starts, lambda s: F.substring(sentence, s + 1, F.lit(width)))
        return F.when(tx.estimate_tokens(sentence) <= size_tokens, F.array(sentence)).otherwise(cut)

    pieces = F.flatten(F.transform(tx.sentences(segment), slices))
    return F.when(tx.estimate_tokens(segment) <= size_tokens, F.array(segment)).otherwise(pieces)


def sized_segments(text: Column, size_tokens: int) -> Column:
    """Paragraphs of a text, broken up where oversized."""
    return F.flatten(F.transform(tx.paragraphs(text), lambda p: fit_segment(p, size_tokens)))


def page_segments(pages: Column, size_tokens: int) -> Column:
    """Segments of ARRAY<STRUCT<page_number, text>>, each tagged with its page."""
    return F.flatten(
        F.transform(
            pages,
            lambda page: F.transform(
                sized_segments(page["text"], size_tokens),
                lambda s: F.struct(
                    s.alias("text"),
                    page["page_number"].cast("int").alias("page_number"),
                    F.lit(False).alias("is_table"),
                ),
            ),
        )
    )


def pack(weights, settings: ChunkSettings, due: int = 0) -> tuple[list[int], list[int], int]:
    """First and last place of every chunk of a run of segments, from their token weights.

    The last result is the place that the last chunk must reach; ``due`` is that of the
    first chunk, where a run goes on from it.

    A chunk takes segments while they fit, and one in any case. On overflow the next
    chunk restarts at the earliest trailing segment within the overlap budget,
    carries at least the last segment, and never carries the whole chunk; the segment
    that overflowed follows in any case. Places are found in the running sum, so
    the work grows with the number of chunks, not with what they hold.
    """
    limit, overlap = settings.size_tokens, settings.overlap_tokens
    sums = [0, *itertools.accumulate(weights)]
    count = len(sums) - 1
    firsts, lasts = [], []
    start = reached = 0
    while due < count:
        reached = due - start
        last = max(due, bisect_right(sums, sums[start] + limit) - 2)
        firsts.append(start)
        lasts.append(last)
        due = last + 1
        if overlap == 0 or last == start:
            start = due
        else:
            # At least the last segment, at most all but the first.
            start = min(max(bisect_left(sums, sums[due] - overlap), start + 1), last)
    return firsts, lasts, reached


def chunk_bounds(weights: Column, settings: ChunkSettings) -> Column:
    """First and last segment (1-based) of every chunk; only the weights leave the JVM."""

    @F.arrow_udf("array<struct<first:int,last:int>>")
    def bounds(column: pa.Array) -> pa.Array:
        sizes, firsts, lasts = [], [], []
        for row in column:
            first, last, _ = pack(row.values.to_pylist() if row.is_valid else [], settings)
            sizes.append(len(first))
            firsts += first
            lasts += last
        pairs = pa.StructArray.from_arrays(
            [pa.array(np.array(x, dtype=np.int32) + 1) for x in (firsts, lasts)], names=["first", "last"]
        )
        offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
        return pa.ListArray.from_arrays(offsets, pairs)

    return bounds(weights)


def chunk_id(document_id: Column, ordinal: Column, text: Column) -> Column:
    """Identifier from document, position and whitespace-normalized content."""
    shown = ordinal.cast("string")
    padded = F.when(F.length(shown) < 4, F.lpad(shown, 4, "0")).otherwise(shown)
    nul = F.lit("\x00")
    digest = F.sha2(F.concat(document_id, nul, shown, nul, tx.squeeze_space(text)), 256)
    return F.concat(document_id, F.lit("::c"), padded, F.lit("::"), F.substring(digest, 1, 12))


def chunk_documents(
    documents: DataFrame, settings: ChunkSettings = ChunkSettings(), carry: tuple[str, ...] = ()
) -> DataFrame:
    """Chunk documents given as (document_id, pages ARRAY<STRUCT<page_number, text>>)."""
    segmented = documents.select(
        "document_id", *carry, page_segments(F.col("pages"), settings.size_tokens).alias("segments")
    )
    weighed = segmented.withColumn(
        "weights", F.transform("segments", lambda s: tx.estimate_tokens(s["text"]))
    )
    bounded = weighed.withColumn("bounds", chunk_bounds(F.col("weights"), settings))
    # Slicing inside the array keeps each exploded row as small as its chunk.
    members = F.transform(
        "bounds", lambda b: F.slice("segments", b["first"], b["last"] - b["first"] + 1)
    )
    placed = bounded.select(
        "document_id", *carry, F.posexplode(members).alias("ordinal", "members")
    )
    return _finish_chunks(placed, carry)


def _finish_chunks(placed: DataFrame, carry: tuple[str, ...]) -> DataFrame:
    texts = placed.select(
        "document_id",
        *carry,
        "ordinal",
        F.array_join(F.transform("members", lambda s: s["text"]), "\n\n").alias("text"),
        F.array_sort(F.array_distinct(F.transform("members", lambda s: s["page_number"])))
        .alias("page_numbers"),
        F.exists("members", lambda s: s["is_table"]).alias("contains_table"),
        F.size("members").alias("n_segments"),
    )
    return texts.select(
        chunk_id(F.col("document_id"), F.col("ordinal"), F.col("text")).alias("chunk_id"),
        "document_id",
        *carry,
        "ordinal",
        "text",
        "page_numbers",
        tx.estimate_tokens(F.col("text")).alias("token_estimate"),
        "contains_table",
        "n_segments",
    )


def chunk_pages(pages: DataFrame, settings: ChunkSettings = ChunkSettings()) -> DataFrame:
    """Chunk documents whose pages are separate rows.

    Input is (document_id, page_number, text, tables ARRAY<ARRAY<ARRAY<STRING>>>).
    Pages are hashed by document and sorted, then packed while streaming, so a
    document with very many pages costs time in one task but not memory.
    """
    size = settings.size_tokens
    prose = F.transform(
        sized_segments(F.col("text"), size),
        lambda s: F.struct(s.alias("text"), F.lit(False).alias("is_table")),
    )
    tabular = F.transform(
        F.flatten(F.transform("tables", lambda t: fit_segment(tx.render_table(t), size))),
        lambda s: F.struct(s.alias("text"), F.lit(True).alias("is_table")),
    )
    segments = pages.select(
        "document_id",
        F.col("page_number").cast("int").alias("page_number"),
        F.posexplode(F.concat(prose, tabular)).alias("position", "segment"),
    ).select("document_id", "page_number", "position", "segment.text", "segment.is_table")
    ordered = segments.repartition("document_id").sortWithinPartitions(
        "document_id", "page_number", "position"
    )
    weighed = ordered.select(
        "document_id",
        tx.estimate_tokens(F.col("text")).alias("weight"),
        F.struct("text", "page_number", "is_table").alias("member"),
    )
    packed = weighed.mapInArrow(
        lambda batches: _pack_stream(batches, settings),
        "document_id string, ordinal int, "
        "members array<struct<text:string,page_number:int,is_table:boolean>>",
    )
    return _finish_chunks(packed, ())


def _pack_stream(
    batches: Iterator[pa.RecordBatch], settings: ChunkSettings
) -> Iterator[pa.RecordBatch]:
    """Chunks of sorted segments; only the open chunk is held between batches.

    Packing goes on from a chunk's start without knowing what came before it, so the
    open chunk's segments are packed again together with the next batch.
    """
    open_rows: pa.RecordBatch | None = None
    ordinal = due = 0
    for batch in itertools.chain(batches, [None]):
        if batch is not None and not batch.num_rows:
            continue
        held = [b for b in (open_rows, batch) if b is not None]
        if not held:
            return
        rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        keys = rows.column("document_id").dictionary_encode().indices.to_numpy()
        weights = rows.column("weight").to_numpy()
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        firsts, lasts, ordinals = [], [], []
        open_rows = None
        for lo, hi in itertools.pairwise(cuts):
            first, last, reached = pack(weights[lo:hi].tolist(), settings, due)
            due = 0
            if hi == len(keys) and batch is not None:
                # The last chunk may go on in the next batch.
                open_rows, due = rows.slice(lo + first[-1]), reached
                first, last = first[:-1], last[:-1]
            firsts += [lo + i for i in first]
            lasts += [lo + i for i in last]
            ordinals += range(ordinal, ordinal + len(first))
            ordinal = ordinal + len(first) if hi == len(keys) else 0
        if firsts:
            start, size = np.array(firsts), np.array(lasts) - np.array(firsts) + 1
            offsets = np.concatenate([[0], np.cumsum(size)])
            at = np.arange(offsets[-1]) + np.repeat(start - offsets[:-1], size)
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column("document_id").take(pa.array(start)),
                    pa.array(np.array(ordinals, dtype=np.int32)),
                    pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), rows.column("member").take(pa.array(at))),
                ],
                names=["document_id", "ordinal", "members"],
            )


def neighbours(chunks: DataFrame, before: int = 1, after: int = 1) -> DataFrame:
    """Every chunk paired with the chunks around it in the same document.

    The band join becomes an equi-join by exploding the few wanted offsets.
    Offsets clamp to 0..3, and 0 means the default of 1.
    """
    back, ahead = (max(0, min(n or 1, 3)) for n in (before, after))
    wanted = chunks.select(
        F.col("chunk_id"),
        "document_id",
        F.explode(F.sequence(F.col("ordinal") - back, F.col("ordinal") + ahead)).alias("ordinal"),
    )
    near = chunks.select("document_id", "ordinal", F.col("chunk_id").alias("neighbour_id"))
    return wanted.join(near, ["document_id", "ordinal"]).select(
        "chunk_id", "document_id", "neighbour_id", F.col("ordinal").alias("neighbour_ordinal")
    )


def corpus_stats(chunks: DataFrame) -> DataFrame:
    return chunks.agg(
        F.count(F.lit(1)).alias("n_chunks"),
        F.count_distinct("document_id").alias("n_documents"),
        F.sum("token_estimate").cast("bigint").alias("total_tokens"),
    )


def require_reportable(chunks: DataFrame) -> DataFrame:
    """Fail the job on any chunk whose provenance cannot back a reported result."""
    ok = F.col("provenance") == "full_documents"
    return chunks.filter(F.assert_true(ok, F.lit("corpus is not reportable")).isNull())


def parse_health(pages: DataFrame, max_empty_fraction: float = 0.1) -> DataFrame:
    """Per-document parse checks over (document_id, page_number, text, n_tables)."""
    empty = (tx.strip(F.col("text")) == "") & (F.col("n_tables") == 0)
    facts = pages.groupBy("document_id").agg(
        F.count("page_number").alias("n_pages"),
        F.sum(F.col("n_tables")).cast("bigint").alias("n_tables"),
        F.count_if(F.col("page_number").isNotNull() & empty).alias("n_empty"),
        F.sum(F.length("text")).cast("bigint").alias("total_characters"),
    )
    warnings = F.array_compact(
        F.array(
            F.when(F.col("n_pages") == 0, "zero_pages"),
            F.when(F.col("n_empty") > max_empty_fraction * F.col("n_pages"), "empty_pages"),
            F.when((F.col("n_tables") == 0) & (F.col("n_pages") > 0), "no_tables"),
        )
    )
    return facts.select(
        "*", F.array_join(warnings, ",").alias("warnings"), (F.size(warnings) == 0).alias("healthy")
    )
