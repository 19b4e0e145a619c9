"""Hand-computed scores, tie-breaks and the large-side code paths."""

from __future__ import annotations

import math
import re

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from assayer import session
from assayer.operators import bm25, dense, fusion, running
from assayer.plans import retrieval_plans
from assayer.session import join_small, spread

LIMIT = "spark.assayer.broadcast.maxRows"


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set(LIMIT, "0")
    yield
    spark.conf.unset(LIMIT)


def chunks(spark, texts):
    return spark.createDataFrame(
        [(f"c{i}", "D", i, t) for i, t in enumerate(texts)],
        "chunk_id string, document_id string, ordinal int, text string",
    )


def questions(spark, *texts):
    return spark.createDataFrame(
        [(f"q{i}", t) for i, t in enumerate(texts)], "question_id string, question_text string"
    )


def test_bm25_formula(spark):
    found = bm25.search(chunks(spark, ["alpha beta", "gamma delta", "beta gamma"]), questions(spark, "alpha"))
    row = found.first()
    assert row["chunk_id"] == "c0" and row["score"] == pytest.approx(math.log(1 + 2.5 / 1.5), abs=1e-6)
    assert found.count() == 1


def brute_bm25(texts, query):
    docs = [t.split() for t in texts]
    n, mean = len(docs), sum(map(len, docs)) / len(docs)
    scores = {}
    for i, doc in enumerate(docs):
        total = 0.0
        for term in query.split():
            df = sum(term in d for d in docs)
            tf = doc.count(term)
            if tf:
                idf = math.log(1 + (n - df + 0.5) / (df + 0.5))
                total += idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(doc) / mean))
        if total > 0:
            scores[f"c{i}"] = round(total, 6)
    return scores


TEXTS = ["x y y z", "", "y w", "x x x", "z z w y x", "w"]


def test_bm25_paths_agree_with_brute_force(spark, no_broadcast):
    expected = brute_bm25(TEXTS, "x y y")
    large = bm25.score(chunks(spark, TEXTS), questions(spark, "x y y"))
    assert {r.chunk_id: r.score for r in large.collect()} == pytest.approx(expected, abs=1e-6)
    spark.conf.set(LIMIT, "1000")
    small = bm25.score(chunks(spark, TEXTS), questions(spark, "x y y"))
    assert {r.chunk_id: r.score for r in small.collect()} == pytest.approx(expected, abs=1e-6)
    scope = spark.createDataFrame([("q0", "D")], "question_id string, document_id string")
    scoped = bm25.score_scoped(chunks(spark, TEXTS), questions(spark, "x y y"), scope)
    assert {r.chunk_id: r.score for r in scoped.collect()} == pytest.approx(expected, abs=1e-6)


def test_bm25_ties_order_by_ordinal(spark):
    found = bm25.search(chunks(spark, ["same"] * 12), questions(spark, "same"), k=3)
    assert [r.chunk_id for r in found.orderBy("rank").collect()] == ["c0", "c1", "c2"]


@pytest.mark.parametrize("k", [0, -1])
def test_k_must_be_positive(spark, k):
    with pytest.raises(ValueError):
        bm25.search(chunks(spark, ["a"]), questions(spark, "a"), k=k)


def test_dense_paths_agree_with_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(1)
    vectors = rng.integers(-2, 3, size=(60, 4)).astype(float)  # many ties
    corpus = spark.createDataFrame(
        [(f"c{i:02d}", 0, v.tolist()) for i, v in enumerate(vectors)],
        "chunk_id string, ordinal int, vector array<double>",
    ).repartition(3)
    asked = corpus.select(F.col("chunk_id").alias("question_id"), "vector")
    expected = {}
    for i, v in enumerate(vectors):
        ranked = sorted(
            ((-float(v @ w), f"c{j:02d}") for j, w in enumerate(vectors) if j != i and v @ w > 0)
        )
        expected |= {(f"c{i:02d}", r + 1): (c, -s) for r, (s, c) in enumerate(ranked[:5])}

    def check():
        found = dense.nearest(corpus, asked, 5, exclude_self=True, dimensions=4).collect()
        assert {(r.question_id, r.rank): (r.chunk_id, r.score) for r in found} == expected

    check()
    monkeypatch.setattr(dense, "MATRIX_CELLS", 40)
    monkeypatch.setattr(dense, "PIVOTS", 8)
    check()
    spark.conf.set(LIMIT, "1")  # the questions' blocks are met slice by slice
    check()
    spark.conf.unset(LIMIT)


@pytest.mark.parametrize("asked", [2, 0])
def test_tasks_without_rows_have_no_best(spark, asked):
    """Rows of one task only, keys that are texts: the other tasks hand on nothing."""
    corpus = spark.createDataFrame([("c0", [1.0, 0.0])], "chunk_id string, vector array<double>").repartition(4)
    questions = spark.createDataFrame(
        [(f"q{i}", [0.5, i - 1.0]) for i in range(asked)], "question_id string, vector array<double>"
    )
    found = dense.nearest(corpus, questions, 3, dimensions=2).collect()
    assert sorted((r.question_id, r.chunk_id, r.score, r.rank) for r in found) == [
        (f"q{i}", "c0", 0.5, 1) for i in range(asked)
    ]


def test_large_query_sides_exchange_no_candidates(spark, monkeypatch):
    """Each question is answered by one task, so the k best are final before they are ranked."""
    monkeypatch.setattr(dense, "SHARED_QUESTIONS", 50)
    monkeypatch.setattr(dense, "BLOCK_ROWS", 64)
    rng = np.random.default_rng(5)
    vectors = rng.normal(size=(400, 8)).astype("float32")
    rows = spark.createDataFrame(
        [(i, v.tolist()) for i, v in enumerate(vectors)], "chunk_id bigint, vector array<float>"
    ).repartition(7)
    asked = rows.select(F.col("chunk_id").alias("question_id"), "vector")
    kept = []
    ranked = dense.top_k
    monkeypatch.setattr(dense, "top_k", lambda found, *rest: kept.append(found) or ranked(found, *rest))
    found = dense.nearest(rows, asked, 5, exclude_self=True, dimensions=8).collect()
    scores = np.round(vectors.astype(float) @ vectors.astype(float).T, dense.SCORE_DIGITS)
    np.fill_diagonal(scores, -1.0)
    for question in range(400):
        best = sorted(range(400), key=lambda j: (-scores[question, j], j))[:5]
        best = [j for j in best if scores[question, j] > 0]
        got = sorted((r for r in found if r.question_id == question), key=lambda r: r.rank)
        assert [(r.chunk_id, r.score) for r in got] == [(j, scores[question, j]) for j in best]
    assert kept[0].count() <= 400 * 6


def test_rows_of_one_row_group_reach_every_task(spark, tmp_path):
    """A table of a single row group fills one split, however many there are; half the keys are null."""
    path = str(tmp_path / "rows")
    spark.range(20_000).selectExpr("if(id % 2 = 0, id, null) AS key", "uuid() AS text").coalesce(1).write.parquet(path)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    try:
        read = spark.read.parquet(path)
        assert read.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
        sizes = spread(read, "key", "text").groupBy(F.spark_partition_id().alias("task")).count().collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert sum(r["count"] for r in sizes) == 20_000
    assert max(r["count"] for r in sizes) < 20_000 / spark.sparkContext.defaultParallelism


def test_a_task_of_a_larger_table_gets_no_more_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "TASK_ROWS", 100)
    path = str(tmp_path / "rows")
    spark.range(20_000).write.parquet(path)
    sizes = spread(spark.read.parquet(path), "id").groupBy(F.spark_partition_id().alias("task")).count().collect()
    assert sum(r["count"] for r in sizes) == 20_000
    assert max(r["count"] for r in sizes) < 200


def test_fused_lists_of_few_chunks_over_many_tasks(spark, tmp_path):
    """Tasks without rows, and lists shorter than the candidates wanted, still fuse."""
    folder = str(tmp_path)
    spark.createDataFrame([(1, "cash flow of a bank"), (2, "net income"), (3, None)], "doc_id bigint, text string").write.parquet(
        f"{folder}/documents.parquet"
    )
    spark.createDataFrame([(7, "cash flow"), (8, "")], "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    found = retrieval_plans.rrf_hybrid(spark, folder).collect()
    assert [(r.question_id, r.chunk_id, r["rank"], r.bm25_rank, r.dense_rank) for r in found] == [("q7", "d1", 1, 1, 1)]


def test_chunks_listed_twice_by_a_source_fuse(spark):
    """Copies of a key stand twice in a list: both places count, the last one is shown."""
    ranked = spark.createDataFrame(
        [("q", "bm25", "c", 1), ("q", "bm25", "c", 2), ("q", "dense", "c", 3), ("q", "bm25", "d", 3)],
        "question_id string, source string, chunk_id string, rank int",
    )
    found = fusion.reciprocal_rank_fusion(ranked).collect()
    assert [(r.chunk_id, r["rank"], r.component_ranks) for r in found] == [
        ("c", 1, {"bm25": 2, "dense": 3}), ("d", 2, {"bm25": 3})
    ]
    assert found[0].score == round(1 / 61 + 1 / 62 + 1 / 63, 9)


def test_dense_blocks_out_of_reach_are_skipped():
    """Clustered vectors: most pairs are left out, and the result is that of all pairs."""
    rng = np.random.default_rng(3)
    middles = rng.normal(size=(12, 16))
    middles /= np.linalg.norm(middles, axis=1, keepdims=True)
    rows = np.repeat(middles, 200, axis=0) + rng.normal(scale=0.02, size=(2400, 16))
    asked = middles + rng.normal(scale=0.02, size=(12, 16))
    pivots = rows[::25]
    floor = dense.floors(asked, pivots, 5, 0.0)
    search = dense.Search(np.arange(12), asked, floor, 5)
    near = np.argmax(rows @ pivots.T - (pivots**2).sum(axis=1) / 2, axis=1)
    for pivot in range(len(pivots)):
        at = np.flatnonzero(near == pivot)
        if len(at):
            search.block(pd.DataFrame({"chunk_id": at, "ordinal": 0}), rows[at])
    share = search.skipped / search.pairs
    print(f"pairs skipped: {share:.3f}")
    assert search.pairs == 2400 * 12 and share > 0.8
    scores = np.round(rows @ asked.T, dense.SCORE_DIGITS)
    for q, found in search.result().groupby("question_id"):
        order = sorted(range(2400), key=lambda i: (-scores[i, q], i))[:5]
        assert found["chunk_id"].tolist() == order and found["score"].tolist() == scores[order, q].tolist()


def test_search_exchanges_only_the_best(spark):
    """No exchange holds pairs of chunk and question but the final top-k, none holds text."""
    found = bm25.search(chunks(spark, TEXTS * 3), questions(spark, "x y y", "z w"), k=2)
    plan = found._jdf.queryExecution().executedPlan().toString()
    exchanges = [line for line in plan.splitlines() if "Exchange" in line]
    assert len(exchanges) == 1 and "hashpartitioning(question_id" in exchanges[0]
    assert "text" not in plan.split("Exchange", 1)[1].split("MapInArrow")[0]
    assert "WindowGroupLimit" in plan
    kept = fusion.lexical_overlap(found, questions(spark, "x y y", "z w"), chunks(spark, TEXTS * 3), 2)
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan or "text" not in plan.split("SortMergeJoin", 1)[1].split("\n")[0]


def test_block_scores_keep_every_tie(spark, monkeypatch):
    texts = ["x y", "x", "y x", "z"] * 40
    monkeypatch.setattr(bm25, "SCORE_CELLS", 7)
    got = bm25.search(chunks(spark, texts).repartition(3), questions(spark, "x", "", "nothing", "y z"), k=5)
    listed = bm25.top_k(bm25.score(chunks(spark, texts), questions(spark, "x", "", "nothing", "y z")), 5)
    key = lambda r: (r.question_id, r.rank, r.chunk_id, r.score)
    assert sorted(map(key, got.collect())) == sorted(map(key, listed.collect()))


def test_frequent_terms_are_scored_in_bounded_parts(spark, monkeypatch):
    """Every chunk and question holds the same word: parts go by their matches, none is lost."""
    texts = ["x y", "x x", "", "y x", "x"] * 20
    asked = ["x", "x y", "x x z"]
    listed = bm25.top_k(bm25.score(chunks(spark, texts), questions(spark, *asked)), 5)
    monkeypatch.setattr(bm25, "MATCHES", 7)
    monkeypatch.setattr(bm25, "HIT_ROWS", 3)
    got = bm25.search(chunks(spark, texts).coalesce(1), questions(spark, *asked), k=5)
    key = lambda r: (r.question_id, r.rank, r.chunk_id, r.score)
    assert sorted(map(key, got.collect())) == sorted(map(key, listed.collect()))
    block = bm25.QueryBlock(np.array(["a", "b", "c"]), 1, np.array([0, 1, 2]), np.zeros(3, int), np.ones(3))
    batch = pa.RecordBatch.from_pydict({"term_ids": pa.array([[0], [], [0, 0, 0], [0], [0]], pa.list_(pa.int32()))})
    assert [p.num_rows for p in block.parts(batch, 100)] == [2, 1, 2]
    assert [p.num_rows for p in block.parts(batch, 1)] == [1] * 5


def test_hashed_vectors_are_unit_or_zero(spark):
    rows = dense.hashed_vectors(questions(spark, "Revenue grew, revenue fell", "  "), "question_id", "question_text")
    norms = {r.question_id: float(np.linalg.norm(r.vector)) for r in rows.collect()}
    assert norms["q0"] == pytest.approx(1.0) and norms["q1"] == 0.0
    assert rows.first()["model_version"] == "hashing-256d-seed0"


def test_different_models_are_refused(spark):
    a = dense.hashed_vectors(questions(spark, "a"), "question_id", "question_text")
    b = dense.hashed_vectors(questions(spark, "a"), "question_id", "question_text", seed=1)
    with pytest.raises(ValueError, match="different models"):
        dense.require_same_model(a, b)


def test_fusion_weights_ties_and_component_ranks(spark):
    lists = spark.createDataFrame(
        [("q", "a", "x", 1), ("q", "a", "y", 2), ("q", "b", "y", 1), ("q", "b", "x", 2), ("q", "b", "z", 3)],
        "question_id string, source string, chunk_id string, rank int",
    )
    rows = fusion.reciprocal_rank_fusion(lists, 2).orderBy("rank").collect()
    assert [r.chunk_id for r in rows] == ["x", "y"] and rows[0].component_ranks == {"a": 1, "b": 2}
    heavy = fusion.reciprocal_rank_fusion(lists, 1, weights={"b": 3.0}).first()
    assert heavy["chunk_id"] == "y" and heavy["score"] == pytest.approx(1 / 62 + 3 / 61)


def test_listwise_falls_back_to_retrieval_order(spark):
    lists = spark.createDataFrame(
        [("q", "x", 1), ("q", "y", 2), ("r", "x", 1), ("r", "y", 2)],
        "question_id string, chunk_id string, rank int",
    )
    judged = spark.createDataFrame([("q", 2, 9.0), ("q", 7, 10.0)], "question_id string, position int, judged_score double")
    rows = fusion.listwise_scores(lists, judged).orderBy("question_id", "rank").collect()
    assert [(r.question_id, r.chunk_id, r.score) for r in rows] == [
        ("q", "y", 9.0), ("q", "x", 5.0), ("r", "x", -1.0), ("r", "y", -2.0),
    ]


def test_salted_join_keeps_every_row(spark, no_broadcast):
    big = spark.range(300).select((F.col("id") % 3 * 0).alias("k"), F.col("id").alias("v"))
    small = spark.createDataFrame([(0, "a"), (1, "b")], "k bigint, name string")
    assert join_small(big, small, "k").count() == 300
    assert join_small(big, small, "k", "left_semi").count() == 300
    assert join_small(big.withColumn("k", F.lit(9).cast("bigint")), small, "k", "left_anti").count() == 300


@pytest.mark.parametrize("fanout", [1024, 2])
def test_running_totals_over_ranges(spark, monkeypatch, fanout):
    """One key with most rows, offsets carried in one level and in several."""
    monkeypatch.setattr(running, "FANOUT", fanout)
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    rows = spark.range(300).select(
        F.when(F.col("id") % 10 == 0, "small").otherwise("hot").alias("key"), (-F.col("id")).alias("down"), "id"
    )
    got = running.running_totals(rows, ["key"], ["down"], ["id"]).collect()
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len(got) == 300
    for r in got:
        later = [i for i in range(r.id, 300) if (i % 10 == 0) == (r.key == "small")]
        assert r.id_through == sum(later) and r.id_before == sum(later) - r.id


def test_no_window_of_a_running_total_sees_a_whole_key(spark):
    rows = spark.range(3000).select(F.lit("k").alias("key"), "id", F.lit(1).alias("x"))
    plan = running.running_totals(rows, ["key"], ["id"], ["x"])._jdf.queryExecution().optimizedPlan().toString()
    whole = [w for w in re.findall(r"Window \[sum\((\w+)#.*?\], \[([^\]]*)\]", plan) if "__part" not in w[1]]
    # Only the ranges' totals, one row each, run over a key as such.
    assert [name for name, _ in whole] == ["__x"]
