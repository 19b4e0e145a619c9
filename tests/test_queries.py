"""Registered queries: SQL twins on the smallest tables, plans, streaming."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from assayer.operators import scoring
from assayer.plans import roles
from assayer.streaming import records
from compare import difference, duck

QUICK = (
    "token_stats number_variants parsed_references document_names chunk_documents chunk_neighbours "
    "evidence_resolution structured_answers bm25_topk bm25_scoped dense_topk rrf_hybrid recall_hit_at_k "
    "question_scan validation_issues grouped_split filing_selection outcome_scores outcome_issues "
    "rewards_by_profile oracle_policy pareto_front bandit_log ope_errors mcnemar_test risk_coverage "
    "agent_terminations regret_curve older_filing_pages filing_blocks storable_responses excluded_questions "
    "question_file_failures source_checksums frozen_split frozen_split_header stored_responses page_corpus "
    "ope_sample_sizes review_sample list_quality"
).split()


@pytest.fixture(scope="module")
def oracle(folder):
    return duck(folder)


@pytest.mark.parametrize("name", QUICK)
def test_twin(spark, folder, oracle, name):
    mine = contract.queries()[name](spark, folder).toPandas()
    theirs = oracle.execute(contract.oracle_sql()[name]).df()
    assert len(mine) > 0
    assert difference(mine, theirs) is None


def test_contract(spark):
    queries, twins = contract.queries(), contract.oracle_sql()
    assert set(twins) <= set(queries) and len(queries) > 100
    assert contract.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["bm25_topk", "dense_topk", "outcome_scores", "retriever_disagreement", "pareto_front"])
def test_no_nested_loop_or_cartesian_plan(spark, folder, name):
    plan = contract.queries()[name](spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("CartesianProduct|BroadcastNestedLoopJoin", plan)


def test_scan_reads_only_needed_columns(spark, folder):
    plan = roles.outcomes(spark, folder).select("question_id", "error_status")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "o_totalprice" not in re.search(r"ReadSchema: (\S+)", text).group(1)


def test_streamed_scores_equal_batch_scores(spark, folder, tmp_path):
    source, sink = str(tmp_path / "in"), str(tmp_path / "out")
    batch = roles.outcomes(spark, folder).limit(500)
    batch.repartition(3).write.parquet(source)
    stored = spark.read.parquet(source)
    stream = records.record_stream(spark, source, stored.schema, per_trigger=1)
    keys = ("question_id", "action_id")
    records.append_records(records.evaluations(stream, *keys), sink, str(tmp_path / "cp")).awaitTermination()
    expected = scoring.score_tall(scoring.score_wide(stored), *keys)
    got = spark.read.parquet(sink)
    assert got.count() == expected.count() and got.exceptAll(expected).count() == 0


def test_feedback_monitor_counts_invalid_rounds(spark, tmp_path):
    rows = spark.range(100).select(
        F.timestamp_seconds(F.col("id") * 30).alias("ts"),
        F.lit("uniform_random").alias("behavior_policy"),
        F.when(F.col("id") % 10 == 0, 0.0).otherwise(0.5).alias("action_propensity"),
        F.lit(1.0).alias("observed_reward"),
    )
    rows.write.parquet(str(tmp_path / "log"))
    stream = records.record_stream(spark, str(tmp_path / "log"), rows.schema)
    query = (
        records.feedback_monitor(stream, "ts")
        .writeStream.format("memory").queryName("monitor").outputMode("complete").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    total = spark.table("monitor").agg(F.sum("n_rounds"), F.sum("n_invalid")).first()
    assert tuple(total) == (100, 10)
