"""The stages one after another, and each against what it is to drop."""

from __future__ import annotations

import corpus_pipeline
from assayer.llm import decontaminate, exact, near, simhash, toxicity
from assayer.llm.queries import ORACLES, QUERIES

SMALL = "/root/testdata/sf0.001"


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, SMALL).cache()
        assert after.columns == columns, name
        assert after.count() <= docs.count()
        docs = after
    assert exact.duplicate_groups(docs).where("not kept").count() == 0
    assert simhash.near_duplicates(docs).where("doc_id <> component_id").count() == 0
    benchmark = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    assert decontaminate.contaminated(docs, benchmark).count() == 0
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    whole = spark.read.parquet(f"{SMALL}/documents.parquet")
    rejected = {r.doc_id for r in toxicity.scored(whole, labels).where("predicted = 1").collect()}
    kept = {r.doc_id for r in docs.select("doc_id").collect()}
    assert not rejected & kept
    final = corpus_pipeline.run(spark, SMALL)
    assert {r.doc_id for r in final.collect()} == kept


def test_near_copies_go_by_fingerprints_first(spark, monkeypatch):
    """Rows within two bits of a smaller id go before any sets are compared; an id's other text stays."""
    prints = {"a": 0, "b": 3, "c": 7, "d": 255 << 40}
    monkeypatch.setattr(simhash, "fingerprint_of", lambda text, known=prints: known[text])
    seen = []
    whole = near.keep_one_of_near_copies
    monkeypatch.setattr(near, "keep_one_of_near_copies", lambda docs: seen.append(docs) or whole(docs))
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (2, "d"), (3, "c"), (None, "b")], "doc_id bigint, text string")
    kept = corpus_pipeline.one_of_near_copies(spark, docs, SMALL)
    rows = lambda df: sorted(((r.doc_id or 0, r.text) for r in df.collect()))
    assert rows(seen[0]) == [(0, "b"), (1, "a"), (2, "d")]
    assert rows(kept) == [(0, "b"), (1, "a"), (2, "d")]


def test_every_operator_has_one_query():
    numbers = sorted(int(name[2:].split("_")[0]) for name in QUERIES)
    assert numbers == list(range(1, 14))
    assert set(ORACLES) <= set(QUERIES)


def test_sql_twins(spark):
    from compare import difference, duck

    for name, sql in ORACLES.items():
        theirs = duck(SMALL).execute(sql).df()
        assert difference(QUERIES[name](spark, SMALL).toPandas(), theirs) is None, name
