"""Scans that read a text once and count its tokens in the worker."""

from __future__ import annotations

from collections import Counter

import pytest
from pyspark.sql import functions as F

from assayer.functions import text as tx
from assayer.functions import tokens
from assayer.operators import dense, evidence, ope, policies
from assayer.plans import policy_plans, retrieval_plans, roles

ODD = [
    "Total revenues 66,608 and (1,577) or $1,577.00 at 23.40% in 2018, 0.0 or (0)",
    "The company's revenues' o'er a'b'c KELVIN Kelvin ١٢ Été €5.10 £7",
    "",
    "a (( )) 5) (6 %7% 8,9,.0 x.y,z$ .5 $",
    None,
]


def test_counts_in_the_worker_are_those_of_the_columns(spark):
    rows = spark.createDataFrame(list(enumerate(ODD)), "i int, text string").select(
        "i", "text", tx.tokens(F.col("text")).alias("terms"),
        tx.tokens(F.col("text"), expand_numbers=False, remove_stopwords=False).alias("words"),
        F.lower("text").alias("lowered"),
        F.regexp_extract_all(F.lower("text"), F.lit(tokens.EMBED_PATTERN), F.lit(0)).alias("embed"),
    )
    for row in rows.collect():
        lowered = "".join(c.lower() if c.isascii() else c for c in row.text or "")
        assert +tokens.term_counts(lowered) == Counter(row.terms or [])
        assert tokens.words(lowered) == (row.words or [])
        assert tokens.embed_words(row.lowered or "") == (row.embed or [])


def test_hashed_sums_follow_the_digests(spark, monkeypatch):
    import hashlib

    monkeypatch.setattr(tokens, "REMEMBERED", 2)
    rows = spark.createDataFrame([(1, "b a a c"), (2, None)], "k int, text string")
    expected = [0] * 256
    for token, times in Counter("baac").items():
        digest = hashlib.sha256(b"0\x00" + token.encode()).digest()
        expected[int.from_bytes(digest[:4], "big") % 256] += -times if digest[4] % 2 else times
    found = {r.k: list(r.sums) for r in dense.hashed_sums(rows, "k", "text").collect()}
    assert found == {1: expected, 2: [0] * 256}


@pytest.fixture
def folder(spark, tmp_path):
    words = [f"w{chr(97 + i)}" for i in range(12)]
    documents = [
        (1, " ".join(words)),
        (1, " ".join(words[2:9])),
        (2, "x " + " ".join(words[:5]) + " y " + " ".join(words[5:])),
        (3, " ".join(words[:5])),
        (4, None),
        (None, " ".join(words).upper()),
    ]
    benchmark = [(7, "Wa wb wc wd, we wf!"), (7, "nothing here"), (8, " ".join(words[5:])), (9, None), (None, "wg wh wi wj wk wl")]
    spark.createDataFrame(documents, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(benchmark, "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def test_gold_is_the_same_in_the_worker_and_by_digests(spark, folder):
    expected = {
        ("q7", "d1"), ("q8", "d1"), ("q8", "d2"), (None, "d1"), (None, "d2"),
        ("q7", None), ("q8", None), (None, None),
    }
    found = [tuple(r) for r in roles.gold_documents(spark, folder).collect()]
    assert len(found) == len(expected) and set(found) == expected
    spark.conf.set("spark.assayer.broadcast.maxRows", "0")
    try:
        dealt = {tuple(r) for r in roles.gold_documents(spark, folder).collect()}
    finally:
        spark.conf.unset("spark.assayer.broadcast.maxRows")
    assert dealt == expected


def test_vectors_of_the_corpus_come_from_a_stored_table(spark, folder, monkeypatch):
    """The model check, the pivots and the search each read vectors; none reads texts for it."""
    met = []
    whole = dense.nearest
    monkeypatch.setattr(dense, "nearest", lambda corpus, *rest: met.append(corpus) or whole(corpus, *rest))
    retrieval_plans.hashed(spark, folder, 5).collect()
    files = met[0].inputFiles()
    assert files and all("hashed-sums" in f for f in files)


def test_only_listed_chunks_are_tokenized(spark, monkeypatch):
    """Gold chunks are as many as documents hold a passage, and only their documents are asked for."""
    kept = {}
    whole = evidence.stored
    monkeypatch.setattr(evidence, "stored", lambda df, name: kept.setdefault(name, whole(df, name)))
    chunks = spark.createDataFrame([(f"c{i}", f"c{i}", f"w{i} x x") for i in range(6)], "chunk_id string, document_id string, text string")
    ranked = spark.createDataFrame([("q", "a", "c0", 1), ("q", "a", "c1", 2)], "question_id string, retriever string, chunk_id string, rank int")
    gold = spark.createDataFrame([("q", f"c{i}") for i in range(1, 6)], "question_id string, chunk_id string")
    row = evidence.list_quality(gold, ranked, chunks, 10).first()
    assert (row.redundancy, row.context_tokens, row.document_recall) == (0.833333, 2, 0.2)
    assert sorted(r.chunk_id for r in kept["listed-terms"].collect()) == ["c0", "c1"]
    assert "norm" in kept["listed-counts"].columns


@pytest.fixture
def orders(spark, tmp_path):
    """Repeated and null keys, and every kind of customer that a split or an answer goes by."""
    rows = [(i // 2 if i % 7 else None, i, 1000.0 + 37 * i, f"{i % 5}-P") for i in range(80)]
    spark.createDataFrame(
        rows, "o_orderkey bigint, o_custkey bigint, o_totalprice double, o_orderpriority string"
    ).write.parquet(f"{tmp_path}/orders.parquet")
    return str(tmp_path)


def test_policy_regret_scores_outcomes_once(spark, orders, monkeypatch):
    """The oracle and the rewards beside it are read from one stored table."""
    met = []
    whole = policies.regret
    monkeypatch.setattr(policies, "regret", lambda *given: met.extend(given[:2]) or whole(*given))
    found = {(r.split, r.action_id): r for r in policy_plans.policy_regret(spark, orders).collect()}
    rewards = [r for r in roles.rewards(spark, orders).collect() if r.question_id is not None]
    best = {}
    for r in rewards:
        best[r.question_id] = max(best.get(r.question_id, r.reward), r.reward)
    for key, row in found.items():
        gaps = [best[r.question_id] - r.reward for r in rewards if (r.split, r.action_id) == key]
        assert row.mean_regret == pytest.approx(sum(gaps) / len(gaps), abs=1e-6)
    assert set(found) == {(r.split, r.action_id) for r in rewards}
    assert all("/rewards-" in f for part in met for f in part.inputFiles())


def test_curve_by_arrays_is_that_of_the_replayed_log(spark, monkeypatch):
    """Repeated and null keys, null rewards, several ranges, and keys that go on in the next batch."""
    arms = len(ope.BEHAVIOURS) + 2
    rows = []
    for i in range(120):
        rewards = [None if (i + a) % 11 == 0 else round(((i * 7 + a * 13) % 17) / 9 - 0.7, 9) for a in range(arms)]
        key = None if i == 60 else 2**40 + i if i % 10 == 0 else -i if i % 10 == 1 else i // 3
        rows.append((key, f"c{i % 3}", "validation" if i % 4 else "dev", rewards, [0.1 * a for a in range(arms)]))
    schema = "question_key bigint, context string, split string, rewards array<double>, costs array<double>"
    matrix = spark.createDataFrame(rows, schema)
    monkeypatch.setattr(ope, "RANGE_QUESTIONS", 20)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        policies_of = ope.behaviour_policies(matrix)
        ranged = ope.in_ranges(matrix.drop("costs"))
        got = ope.replayed_regret_curve(ranged, policies_of, (1, 2))
        log = ope.replay_log(matrix, policies_of, (1, 2), (F.array_max("rewards").alias("best"),))
        want = ope.regret_curve(log, F.col("best"))
        assert got.dtypes == want.dtypes
        last = lambda rows: Counter(
            (r.behavior_policy, r.simulation_seed, r.question_key, r.draw_no, r.n_rounds) for r in rows
        )
        got, want = got.collect(), want.collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert last(got) == last(want) and len(got) > 500
    # Rounds of one key and draw run in any order; the sums after the last of them are the same.
    through = lambda rows: {
        (r.behavior_policy, r.simulation_seed, r.question_key, r.draw_no): (r.n_rounds, r.cumulative_reward, r.cumulative_regret)
        for r in sorted(rows, key=lambda r: r.n_rounds)
    }
    assert through(got) == through(want)


def test_curve_exchanges_questions_alone(spark, orders):
    """No round of a log is sorted or exchanged: 50 logs of a question are drawn where it is."""
    found = policy_plans.regret_curve(spark, orders)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "Window" not in plan and plan.count("Sort ") == 1
    assert found.count() > 0
