"""Exact dense retrieval by blocked matrix products.

Spark partitions the corpus; each task forms blocks of rows that are close to one
another, multiplies a block with the questions it can matter to, and keeps only the k
best rows per question. A query side under the size limits is broadcast; a larger
one is dealt in groups over the tasks, and the corpus goes past every group.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.functions import tokens
from assayer.operators.bm25 import top_k
from assayer.operators.heaps import TopRows
from assayer.session import broadcast_row_limit, stored

SCORE_DIGITS = 6
#: Query vectors broadcast as one matrix stay under this many cells (64 MB).
MATRIX_CELLS = 8_000_000
BLOCK_ROWS = 4096
#: Scores held at once (32 MB).
PRODUCT_CELLS = 4_000_000
#: Questions that every task answers, with k rows exchanged for each question and task.
SHARED_QUESTIONS = 8192
#: Rows of a result handed on at once.
RESULT_ROWS = 100_000
#: Corpus rows that blocks are formed around: a sample of this many by hash.
PIVOTS = 256
#: Bounds are compared with scores that were rounded to SCORE_DIGITS.
SLACK = 1e-5


def hashed_sums(
    texts: DataFrame, key: str, text: str, dimensions: int = 256, seed: int = 0
) -> DataFrame:
    """(key, sums ARRAY<INT>): the tokens of a text by hashed place, some taken off.

    Of a token's SHA-256 the first four bytes pick the place and the parity of the fifth
    picks the sign. A worker remembers the places of the tokens it has met.
    """

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = tokens.HashedPlaces(dimensions, seed)
        for batch in batches:
            rows = batch.num_rows
            found, times, lengths = [], [], []
            for lowered in batch.column(1):
                counts = Counter(tokens.embed_words(lowered.as_py() or ""))
                found += [places[token] for token in counts]
                times += counts.values()
                lengths.append(len(counts))
            place, times = np.array(found, dtype=np.int64), np.array(times, dtype=np.int64)
            minus = place < 0
            cells = np.repeat(np.arange(rows), lengths) * dimensions + np.where(minus, ~place, place)
            sums = np.bincount(cells, weights=np.where(minus, -times, times), minlength=rows * dimensions)
            bounds = pa.array(np.arange(rows + 1, dtype=np.int32) * dimensions)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.ListArray.from_arrays(bounds, pa.array(sums.astype(np.int32)))],
                names=[key, "sums"],
            )

    kind = texts.schema[key].dataType.simpleString()
    lowered = texts.select(key, F.lower(F.col(text)).alias("lowered"))
    return lowered.mapInArrow(add_up, f"`{key}` {kind}, sums array<int>")


def unit_vectors(sums: DataFrame, key: str, dimensions: int = 256, seed: int = 0) -> DataFrame:
    """``hashed_sums`` as unit vectors: (key, vector ARRAY<DOUBLE>, model_version)."""

    def to_unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.num_rows
            matrix = batch.column(1).flatten().to_numpy().astype(float).reshape(rows, dimensions)
            norms = np.linalg.norm(matrix, axis=1, keepdims=True)
            unit = np.divide(matrix, norms, out=matrix, where=norms > 0)
            bounds = pa.array(np.arange(rows + 1, dtype=np.int32) * dimensions)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.ListArray.from_arrays(bounds, pa.array(unit.ravel()))],
                names=[key, "vector"],
            )

    kind = sums.schema[key].dataType.simpleString()
    vectors = sums.select(key, "sums").mapInArrow(to_unit, f"`{key}` {kind}, vector array<double>")
    return vectors.withColumn("model_version", F.lit(f"hashing-{dimensions}d-seed{seed}"))


def hashed_vectors(
    texts: DataFrame, key: str, text: str, dimensions: int = 256, seed: int = 0
) -> DataFrame:
    """Feature-hashed unit vectors: (key, vector ARRAY<DOUBLE>, model_version)."""
    return unit_vectors(hashed_sums(texts, key, text, dimensions, seed), key, dimensions, seed)


def require_same_model(corpus: DataFrame, queries: DataFrame) -> None:
    """Refuse to compare vectors of different models."""
    found = {
        row[0]
        for side in (corpus, queries)
        for row in side.select("model_version").distinct().limit(2).collect()
    }
    if len(found) > 1:
        raise ValueError(f"vectors come from different models: {sorted(found)}")


class Search:
    """Blocks of corpus rows against a block of questions, with what cannot matter left out.

    A row x of a block with centroid c and radius r scores at most q.c + |q| r
    for a question q. A question whose k-th best score is above that bound
    skips the block. ``pairs`` and ``skipped`` count (question, row) pairs.
    """

    def __init__(self, questions: np.ndarray, matrix: np.ndarray, floor: np.ndarray, k: int) -> None:
        self.questions, self.matrix = questions, matrix
        self.norms = np.linalg.norm(matrix, axis=1)
        self.best = TopRows(len(questions), k, floor)
        self.pairs = self.skipped = 0

    def block(self, keys: pd.DataFrame, rows: np.ndarray) -> None:
        centroid, radius = center(rows)
        bound = self.matrix @ centroid + self.norms * radius
        near = np.flatnonzero(bound + SLACK >= self.best.floor)
        self.pairs += len(rows) * len(self.questions)
        self.skipped += len(rows) * (len(self.questions) - len(near))
        if not len(near):
            return
        step = max(1, PRODUCT_CELLS // len(near))
        for start in range(0, len(rows), step):
            part = rows[start : start + step]
            scores = np.round(part @ self.matrix[near].T, SCORE_DIGITS)
            self.best.take(scores, keys.iloc[start : start + step], near)

    def results(self) -> Iterator[pd.DataFrame]:
        """The result in parts, or nothing: columns without rows have no type that Arrow can tell."""
        found = self.result()
        for start in range(0, len(found), RESULT_ROWS):
            yield found.iloc[start : start + RESULT_ROWS]

    def result(self) -> pd.DataFrame:
        best = self.best.cut()
        if best is None:
            return pd.DataFrame({"question_id": [], "chunk_id": [], "ordinal": [], "score": []})
        # Texts of several blocks would be Arrow arrays in pieces; plain objects are not.
        plain = lambda values: pd.Series(list(values), dtype=object)
        return pd.DataFrame(
            {
                "question_id": plain(self.questions[best["question"].to_numpy()]),
                "chunk_id": plain(best["chunk_id"]),
                "ordinal": best["ordinal"].to_numpy(),
                "score": best["score"].to_numpy(),
            }
        )


def center(rows: np.ndarray) -> tuple[np.ndarray, float]:
    """Centroid of the rows, and the distance of the row farthest from it."""
    centroid = rows.mean(axis=0)
    return centroid, float(np.sqrt(((rows - centroid) ** 2).sum(axis=1).max()))


def stacked(vectors) -> np.ndarray:
    return np.vstack(vectors.to_numpy()).astype(float)


def floors(matrix: np.ndarray, pivots: np.ndarray, k: int, least: float) -> np.ndarray:
    """A score that each question's k-th best reaches: that among ``pivots``, which are corpus rows."""
    floor = np.full(len(matrix), np.nextafter(least, np.inf))
    if len(pivots) >= k:
        for start in range(0, len(matrix), BLOCK_ROWS):
            scores = np.round(matrix[start : start + BLOCK_ROWS] @ pivots.T, SCORE_DIGITS)
            reached = np.partition(scores, len(pivots) - k, axis=1)[:, -k]
            floor[start : start + BLOCK_ROWS] = np.maximum(floor[start : start + BLOCK_ROWS], reached)
    return floor


def _clustered(rows: DataFrame, pivots) -> DataFrame:
    """Rows with ``near``, neighbours together within a partition.

    Nothing is exchanged, so a pivot that most rows are close to is spread as they are.
    """
    return _near(rows, pivots).sortWithinPartitions("near")


def _near(rows: DataFrame, pivots) -> DataFrame:
    """Rows with ``near``, the pivot closest to them."""
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        points = pivots.value
        half = (points**2).sum(axis=1) / 2
        for batch in batches:
            near = np.zeros(batch.num_rows, dtype=np.int32)
            if batch.num_rows and len(points):
                vectors = batch.column("vector").flatten().to_numpy().reshape(batch.num_rows, -1)
                near[:] = np.argmax(vectors @ points.T - half, axis=1)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(near)], names=[*batch.schema.names, "near"]
            )

    return rows.mapInArrow(assign, f"{kinds}, near int")


def _blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of one pivot, ``BLOCK_ROWS`` at most."""
    held: list[pd.DataFrame] = []
    size, near = 0, None
    for batch in batches:
        for pivot, part in batch.groupby("near", sort=True):
            for start in range(0, len(part), BLOCK_ROWS):
                some = part.iloc[start : start + BLOCK_ROWS]
                if held and (pivot != near or size + len(some) > BLOCK_ROWS):
                    yield pd.concat(held)
                    held, size = [], 0
                held.append(some)
                size, near = size + len(some), pivot
    if held:
        yield pd.concat(held)


def nearest(
    corpus: DataFrame,
    queries: DataFrame,
    k: int = 10,
    min_similarity: float = 0.0,
    exclude_self: bool = False,
    dimensions: int = 256,
) -> DataFrame:
    """Top-k by dot product: (question_id, chunk_id, score, rank).

    ``corpus`` is (chunk_id, vector[, ordinal]), ``queries`` is (question_id,
    vector). Similarities must exceed the floor; ties order by ordinal, chunk id.
    Sides that carry a ``model_version`` must carry the same one.

    Every task puts its rows in blocks around pivots, a bounded sample of the
    corpus, and leaves out the blocks that cannot reach a question's k-th best;
    the pivots' own scores give the first such floor.
    """
    if k <= 0:
        raise ValueError(f"k must be positive, got {k}")
    if "model_version" in corpus.columns and "model_version" in queries.columns:
        require_same_model(corpus, queries)
    if "ordinal" not in corpus.columns:
        corpus = corpus.withColumn("ordinal", F.lit(0))
    # One extra candidate per block covers the row that is the query itself.
    wanted = k + 1 if exclude_self else k
    types = (
        queries.schema["question_id"].dataType.simpleString(),
        corpus.schema["chunk_id"].dataType.simpleString(),
    )
    schema = f"question_id {types[0]}, chunk_id {types[1]}, ordinal int, score double"
    rows = corpus.select("chunk_id", F.col("ordinal").cast("int").alias("ordinal"), "vector")
    asked = queries.select("question_id", "vector")
    drawn = rows.orderBy(F.xxhash64("chunk_id"), "chunk_id").limit(PIVOTS).select("vector").toPandas()
    points = stacked(drawn["vector"]) if len(drawn) else np.zeros((0, dimensions))
    limit = min(broadcast_row_limit(corpus.sparkSession), SHARED_QUESTIONS, max(1, MATRIX_CELLS // dimensions))
    # The fetch stops at the limit, so an oversized query side never arrives.
    fetched = asked.limit(limit + 1).toPandas()
    if len(fetched) <= limit:
        candidates = _broadcast_product(rows, fetched, points, wanted, min_similarity, schema)
    else:
        candidates = _grouped_product(rows, asked, points, wanted, min_similarity, schema)
    if exclude_self:
        candidates = candidates.filter(F.col("question_id") != F.col("chunk_id"))
    return top_k(candidates, k, "ordinal", "chunk_id").drop("ordinal")


def _broadcast_product(
    corpus: DataFrame, queries: pd.DataFrame, points: np.ndarray, k: int, least: float, schema: str
) -> DataFrame:
    context = corpus.sparkSession.sparkContext
    matrix = stacked(queries["vector"]) if len(queries) else np.zeros((0, 1))
    shared = context.broadcast((queries["question_id"].to_numpy(), matrix, floors(matrix, points, k, least) if len(queries) else np.zeros(0)))
    pivots = context.broadcast(points)

    def multiply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        questions, matrix, floor = shared.value
        if len(questions):
            search = Search(questions, matrix, floor, k)
            for block in _blocks(batches):
                search.block(block[["chunk_id", "ordinal"]], stacked(block["vector"]))
            yield from search.results()

    return _clustered(corpus, pivots).mapInPandas(multiply, schema)


def _grouped_product(
    corpus: DataFrame, queries: DataFrame, points: np.ndarray, k: int, least: float, schema: str
) -> DataFrame:
    """Products by groups of questions, for query sides too large to send to every task.

    A task has one group and reads the whole corpus past it, by pivots: it knows the best of
    its questions at the end, so no candidates are exchanged. A row of the corpus moves once
    for each group.
    """
    spark = corpus.sparkSession
    pivots = spark.sparkContext.broadcast(points)
    asked = stored(queries, "dense-questions")
    size = max(1, MATRIX_CELLS // max(1, points.shape[1]))
    many, parallel = asked.count(), spark.sparkContext.defaultParallelism
    groups = max(1, -(-many // size), min(parallel, -(-many // BLOCK_ROWS)))
    kinds = {f.name: f.dataType for f in [*corpus.schema.fields, *asked.schema.fields]}
    place = F.pmod(F.xxhash64("question_id", "vector"), F.lit(groups)).cast("int")
    questions = asked.select(
        place.alias("group"),
        F.lit(-1).alias("near"),
        "question_id",
        F.lit(None).cast(kinds["chunk_id"]).alias("chunk_id"),
        F.lit(None).cast("int").alias("ordinal"),
        "vector",
    )
    rows = _near(corpus, pivots).select(
        F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"),
        "near",
        F.lit(None).cast(kinds["question_id"]).alias("question_id"),
        "chunk_id",
        "ordinal",
        "vector",
    )
    # A task's questions come before its rows.
    dealt = questions.unionByName(rows).repartitionById(groups, "group").sortWithinPartitions("near")

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        asked: list[pd.DataFrame] = []

        def held() -> Iterator[pd.DataFrame]:
            for batch in batches:
                first = int(np.searchsorted(batch["near"].to_numpy(), 0))
                if first:
                    asked.append(batch.iloc[:first][["question_id", "vector"]])
                if first < len(batch):
                    yield batch.iloc[first:]

        search = None
        for block in _blocks(held()):
            if search is None:
                if not asked:
                    return
                every = pd.concat(asked)
                matrix = stacked(every["vector"])
                search = Search(every["question_id"].to_numpy(), matrix, floors(matrix, pivots.value, k, least), k)
            search.block(block[["chunk_id", "ordinal"]].astype({"ordinal": "int32"}), stacked(block["vector"]))
        if search is not None:
            yield from search.results()

    return dealt.mapInPandas(multiply, schema)
