"""BM25: term statistics, weighted postings, block-wise scores, top-k.

Term frequencies are counted inside each row, so the corpus is tokenized and
turned into postings without a shuffle. Only postings whose term occurs in some
query survive, and text never travels with scores. A search scores blocks of
chunks against all questions inside a task and exchanges only the best.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, StructField, StructType

from assayer.functions import text as tx
from assayer.functions import tokens
from assayer.operators.heaps import TopRows
from assayer.session import fits_broadcast, join_small, stored

SCORE_DIGITS = 6
#: Scores held at once, chunks times questions: 4 MB.
SCORE_CELLS = 500_000
#: Pairs of a posting and a question that hold the same term, scored at once (40 bytes each).
MATCHES = 1_000_000
#: Chunks whose tokens are counted at once.
HIT_ROWS = 500


@dataclass(frozen=True)
class Bm25Settings:
    k1: float = 1.2
    b: float = 0.75


def term_counts(sorted_terms: Column) -> Column:
    """ARRAY<STRUCT<term, tf>> from a sorted token array, by run length."""
    size = F.size(sorted_terms)
    starts = F.filter(
        F.sequence(F.lit(0), size - 1),
        lambda i: (i == 0) | (F.get(sorted_terms, i) != F.get(sorted_terms, i - 1)),
    )
    ends = F.concat(F.slice(starts, F.lit(2), size), F.array(size))
    runs = F.zip_with(
        starts,
        ends,
        lambda start, end: F.struct(
            F.get(sorted_terms, start).alias("term"), (end - start).alias("tf")
        ),
    )
    return F.when(size > 0, runs).otherwise(F.array().cast("array<struct<term:string,tf:int>>"))


def index_terms(chunks: DataFrame, *keys: str) -> DataFrame:
    """One row per chunk: keys, ``doc_len`` and sorted ``terms``."""
    return chunks.select(*keys, F.sort_array(tx.tokens(F.col("text"))).alias("terms")).withColumn(
        "doc_len", F.size("terms")
    )


def postings(indexed: DataFrame, *keys: str) -> DataFrame:
    """(keys, doc_len, term, tf), one row per distinct term of a chunk."""
    return indexed.select(*keys, "doc_len", F.inline(term_counts(F.col("terms"))))


def query_terms(queries: DataFrame, *keys: str) -> DataFrame:
    """(question_id, keys, term, qtf): every occurrence in the query counts."""
    exploded = queries.select(
        "question_id", *keys, F.sort_array(tx.tokens(F.col("question_text"))).alias("terms")
    )
    return exploded.select(
        "question_id", *keys, F.inline(term_counts(F.col("terms")))
    ).withColumnRenamed("tf", "qtf")


def index_stats(indexed: DataFrame) -> DataFrame:
    """Chunk count, vocabulary size and mean length."""
    vocabulary = (
        indexed.select(F.explode(F.array_distinct("terms")).alias("term"))
        .agg(F.count_distinct("term"))
        .scalar()
    )
    return indexed.agg(
        F.count(F.lit(1)).alias("n_chunks"),
        F.round(F.avg("doc_len"), 2).alias("average_length"),
    ).select("n_chunks", vocabulary.alias("vocabulary_size"), "average_length")


def idf(n: Column, df: Column) -> Column:
    return F.log(1.0 + (n - df + 0.5) / (df + 0.5))


def saturation(tf: Column, length: Column, mean: Column, settings: Bm25Settings) -> Column:
    norm = 1.0 - settings.b + settings.b * length / mean
    return tf * (settings.k1 + 1.0) / (tf + settings.k1 * norm)


def score(
    chunks: DataFrame, queries: DataFrame, settings: Bm25Settings = Bm25Settings()
) -> DataFrame:
    """(question_id, chunk_id, document_id, ordinal, score), every positive score.

    Statistics cover the whole corpus. The result is as large as the number of
    matching pairs: ``search`` finds the best of a question without listing them.
    """
    keys = ("chunk_id", "document_id", "ordinal")
    indexed = index_terms(chunks, *keys)
    totals = indexed.agg(F.count(F.lit(1)).alias("n"), F.avg("doc_len").alias("mean_len"))
    wanted = query_terms(queries)
    kept = join_small(postings(indexed, *keys), wanted.select("term").distinct(), "term", "left_semi")
    frequencies = kept.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    n, mean_len = totals.select("n").scalar(), totals.select("mean_len").scalar()
    weights = wanted.join(frequencies, "term").select(
        "question_id", "term", (F.col("qtf") * idf(n, F.col("df"))).alias("weight")
    )
    saturated = kept.withColumn(
        "saturated", saturation(F.col("tf"), F.col("doc_len"), mean_len, settings)
    )
    summed = (
        join_small(saturated, weights, "term")
        .groupBy("chunk_id", "question_id")
        .agg(
            F.first("document_id").alias("document_id"),
            F.first("ordinal").alias("ordinal"),
            F.round(F.sum(F.col("weight") * F.col("saturated")), SCORE_DIGITS).alias("score"),
        )
    )
    return summed.filter(F.col("score") > 0)


def score_scoped(
    chunks: DataFrame,
    queries: DataFrame,
    scope: DataFrame,
    settings: Bm25Settings = Bm25Settings(),
) -> DataFrame:
    """Score every question against its own documents only.

    ``scope`` is (question_id, document_id); chunk count, document frequencies
    and mean length are those of each question's scope, as if an index had been
    built per question.
    """
    wanted = query_terms(queries)
    in_scope = scope.distinct()
    # Only documents inside some scope are tokenized at all.
    scoped = join_small(
        chunks, in_scope.select("document_id").distinct(), "document_id", "left_semi"
    )
    indexed = index_terms(scoped, "chunk_id", "document_id", "ordinal")
    lengths = indexed.groupBy("document_id").agg(
        F.count(F.lit(1)).alias("n_doc"), F.sum("doc_len").alias("len_doc")
    )
    totals = (
        in_scope.join(lengths, "document_id")
        .groupBy("question_id")
        .agg(F.sum("n_doc").alias("n"), (F.sum("len_doc") / F.sum("n_doc")).alias("mean_len"))
    )
    needed = in_scope.join(wanted, "question_id")
    hits = postings(indexed, "chunk_id", "document_id", "ordinal").join(
        needed, ["document_id", "term"]
    )
    frequencies = hits.groupBy("question_id", "term").agg(F.count(F.lit(1)).alias("df"))
    gain = (
        F.col("qtf")
        * idf(F.col("n"), F.col("df"))
        * saturation(F.col("tf"), F.col("doc_len"), F.col("mean_len"), settings)
    )
    return (
        hits.join(frequencies, ["question_id", "term"])
        .join(totals, "question_id")
        .groupBy("question_id", "chunk_id", "document_id", "ordinal")
        .agg(F.round(F.sum(gain), SCORE_DIGITS).alias("score"))
        .filter(F.col("score") > 0)
    )


def top_k(scored: DataFrame, k: int = 10, *ties: str) -> DataFrame:
    """Rank per question on (score desc, ties) and keep k.

    The rank filter becomes a per-partition limit before the shuffle, so at most
    k rows per question and partition are exchanged.
    """
    if k <= 0:
        raise ValueError(f"k must be positive, got {k}")
    order = [F.col("score").desc(), *[F.col(t) for t in ties or ("ordinal", "chunk_id")]]
    window = Window.partitionBy("question_id").orderBy(*order)
    return scored.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= k)


class QueryBlock:
    """Questions as a sparse matrix by term: a term's weights are those of the questions that hold it."""

    def __init__(self, questions, terms: int, question_of, term_of, weights) -> None:
        order = np.argsort(term_of, kind="stable")
        self.questions = questions
        self.question_of, self.weights = question_of[order], weights[order]
        self.counts = np.bincount(term_of, minlength=terms)
        self.starts = np.cumsum(self.counts) - self.counts

    def parts(self, batch: pa.RecordBatch, step: int) -> Iterator[pa.RecordBatch]:
        """Slices of at most ``step`` chunks and about ``MATCHES`` pairs of a posting and a question."""
        lengths = batch.column("term_ids").value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        matches = self.counts[batch.column("term_ids").flatten().to_numpy()]
        through = np.concatenate([[0], np.cumsum(matches)])[np.cumsum(lengths)]
        start, done = 0, 0
        while start < batch.num_rows:
            stop = int(np.searchsorted(through, done + MATCHES, side="right"))
            stop = max(start + 1, min(start + step, stop))
            yield batch.slice(start, stop - start)
            start, done = stop, through[stop - 1]

    def scores(self, row, term, gain, rows: int):
        """(rows, questions) of rounded scores from a chunk block's postings."""
        counts = self.counts[term]
        before = np.cumsum(counts) - counts
        at = np.arange(int(counts.sum())) + np.repeat(self.starts[term] - before, counts)
        cells = np.repeat(row, counts) * len(self.questions) + self.question_of[at]
        sums = np.bincount(
            cells, weights=np.repeat(gain, counts) * self.weights[at], minlength=rows * len(self.questions)
        )
        return np.round(sums.reshape(rows, -1), SCORE_DIGITS)


def _hits(chunks: DataFrame, vocabulary: np.ndarray) -> DataFrame:
    """One narrow row per chunk: keys, ``doc_len``, and the query terms in it with counts."""
    known = chunks.sparkSession.sparkContext.broadcast({term: i for i, term in enumerate(vocabulary)})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = known.value
        for batch in (b.slice(start, HIT_ROWS) for b in batches for start in range(0, b.num_rows, HIT_ROWS)):
            lengths, bounds, terms, times = [], [0], [], []
            for lowered in pc.ascii_lower(batch.column(3)):
                counts = tokens.term_counts(lowered.as_py() or "")
                lengths.append(counts.total())
                found = sorted((wanted[t], counts[t]) for t in counts.keys() & wanted.keys())
                terms += [term for term, _ in found]
                times += [n for _, n in found]
                bounds.append(len(terms))
            bounds = pa.array(bounds, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[:3],
                    pa.array(lengths, pa.int32()),
                    pa.ListArray.from_arrays(bounds, pa.array(terms, pa.int32())),
                    pa.ListArray.from_arrays(bounds, pa.array(times, pa.int32())),
                ],
                names=["chunk_id", "document_id", "ordinal", "doc_len", "term_ids", "tfs"],
            )

    rows = chunks.select("chunk_id", "document_id", "ordinal", "text")
    keys = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:3])
    return rows.mapInArrow(count, f"{keys}, doc_len int, term_ids array<int>, tfs array<int>")


def _block_search(
    chunks: DataFrame, wanted: DataFrame, k: int, settings: Bm25Settings
) -> DataFrame:
    asked = wanted.toPandas()
    vocabulary, term_of = np.unique(asked["term"].to_numpy(dtype=str), return_inverse=True)
    questions, question_of = np.unique(asked["question_id"].to_numpy(), return_inverse=True)
    hits = stored(_hits(chunks, vocabulary.astype(object)), "bm25-hits")
    n, mean_len = hits.agg(F.count(F.lit(1)), F.avg("doc_len")).first()
    df = np.zeros(len(vocabulary))
    for term, times in (
        hits.select(F.explode("term_ids").alias("term")).groupBy("term").count().toPandas().to_numpy()
    ):
        df[term] = times
    weights = asked["qtf"].to_numpy() * np.log(1.0 + (n - df + 0.5) / (df + 0.5))[term_of]
    block = QueryBlock(questions, len(vocabulary), question_of, term_of, weights)
    shared = chunks.sparkSession.sparkContext.broadcast(block)
    mean_len = mean_len or 1.0
    columns = ["question_id", "chunk_id", "document_id", "ordinal", "score"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        block = shared.value
        best_rows = TopRows(len(block.questions), k, np.nextafter(0.0, 1.0))
        step = max(1, SCORE_CELLS // max(1, len(block.questions)))
        for batch in batches:
            for part in block.parts(batch, step):
                keys = part.select(["chunk_id", "document_id", "ordinal"]).to_pandas()
                length = part.column("doc_len").to_numpy()
                term = part.column("term_ids").flatten().to_numpy()
                tf = part.column("tfs").flatten().to_numpy()
                row = np.repeat(np.arange(part.num_rows), part.column("term_ids").value_lengths().to_numpy())
                norm = 1.0 - settings.b + settings.b * length[row] / mean_len
                gain = tf * (settings.k1 + 1.0) / (tf + settings.k1 * norm)
                best_rows.take(block.scores(row, term, gain, part.num_rows), keys)
        best = best_rows.cut()
        if best is not None:
            best = best.assign(question_id=block.questions[best["question"].to_numpy()])
            yield pa.RecordBatch.from_pandas(best[columns], schema=out_schema, preserve_index=False)

    kinds = {f.name: f.dataType for f in [*hits.schema.fields, *wanted.schema.fields]}
    out_schema = to_arrow_schema(
        StructType([StructField(c, kinds.get(c, DoubleType())) for c in columns])
    )
    schema = ", ".join(f"{c} {kinds[c].simpleString() if c in kinds else 'double'}" for c in columns)
    return top_k(hits.mapInArrow(scan, schema), k)


def search(
    chunks: DataFrame,
    queries: DataFrame,
    k: int = 10,
    settings: Bm25Settings = Bm25Settings(),
) -> DataFrame:
    """The k best chunks of every question, with their ranks.

    The corpus is tokenized once, into a narrow stored table of the query terms
    that each chunk holds. A task then scores blocks of chunks against all
    questions, a sparse matrix that is sent to it, and keeps k rows for each
    question; only these are exchanged. Questions over the limits of a broadcast
    are joined to the postings instead.
    """
    if k <= 0:
        raise ValueError(f"k must be positive, got {k}")
    wanted = query_terms(queries)
    if fits_broadcast(wanted):
        return _block_search(chunks, wanted, k, settings)
    return top_k(score(chunks, queries, settings), k)
