"""Scores, rewards, splits, filings, statistics, bandits and estimators."""

from __future__ import annotations

import random
import re
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from assayer import vocabulary as v
from assayer.functions import answers
from assayer.functions.hashing import PRIME, poisson_one, uniform
from assayer.operators import (
    bandits,
    cache,
    datasets,
    filings,
    ope,
    policies,
    routers,
    scoring,
    statistics,
    trace,
    workflows,
)

OUTCOME = {
    "experiment_id": "e", "question_id": "q", "action_id": "A1_bm25", "retrieved_chunk_ids": ["a", "b"],
    "gold_chunk_ids": ["a", "c"], "cited_chunk_ids": ["a", "a"], "hallucinated_citations": ["z"],
    "reference_answer": "66,608", "answer": "66000", "abstained": False, "abstention_reason": None,
    "error_status": "ok", "confidence": 0.5, "latency_ms": 1500.0, "estimated_cost_usd": 0.01,
    "pricing_known": True,
}
SCHEMA = (
    "experiment_id string, question_id string, action_id string, retrieved_chunk_ids array<string>, "
    "gold_chunk_ids array<string>, cited_chunk_ids array<string>, hallucinated_citations array<string>, "
    "reference_answer string, answer string, abstained boolean, abstention_reason string, error_status string, "
    "confidence double, latency_ms double, estimated_cost_usd double, pricing_known boolean"
)


def outcomes(spark, *changes):
    return spark.createDataFrame([tuple((OUTCOME | c).values()) for c in changes], SCHEMA)


def score(spark, **change):
    return scoring.score_wide(outcomes(spark, change)).first()


def test_scores_of_an_answer(spark):
    row = score(spark)
    assert (row.retrieval_recall, row.retrieval_precision, row.retrieval_hit) == (0.5, 0.5, 1.0)
    assert row.citation_precision == pytest.approx(2 / 3) and row.citation_coverage == 1.0
    assert row.numeric_correctness == 1.0 and row.cost_score == pytest.approx(0.8)
    assert row.latency_score == pytest.approx(0.95) and row.policy_compliance == 1.0


def test_missing_measurements_stay_missing(spark):
    row = score(spark, gold_chunk_ids=[], reference_answer="n/a", pricing_known=False, latency_ms=None)
    names = ("retrieval_recall", "numeric_correctness", "cost_score", "latency_score")
    assert all(row[n] is None for n in names)
    assert score(spark, answer="65900").numeric_correctness == 0.0
    assert score(spark, answer=None).numeric_correctness == 0.0
    assert score(spark, reference_answer="0", answer="0.005").numeric_correctness == 1.0


def test_abstentions(spark):
    gone = dict(abstained=True, answer=None, abstention_reason="insufficient_evidence")
    assert score(spark, **gone).abstention_precision == 0.0
    assert score(spark, **gone, retrieved_chunk_ids=["x"]).abstention_precision == 1.0
    assert score(spark, **gone).citation_coverage is None


def test_issues(spark):
    rows = outcomes(
        spark,
        dict(retrieved_chunk_ids=["x"], cited_chunk_ids=[], answer="1", error_status="timeout",
             latency_ms=40000.0, pricing_known=None),
    )
    got = {(r.category, r.severity) for r in scoring.detect_issues(rows, "question_id").collect()}
    assert got == {
        ("retrieval_failure", "error"), ("hallucinated_citation", "critical"), ("uncited_answer", "error"),
        ("incorrect_numeric_answer", "error"), ("unsupported_answer", "critical"), ("cost_unmeasured", "info"),
        ("slow_response", "warning"), ("workflow_timeout", "warning"),
    }


def test_quality_renormalizes(spark):
    def q(c, s):
        lit = lambda x: F.lit(x).cast("double")
        return spark.range(1).select(scoring.quality(lit(c), lit(s)).alias("x")).first()["x"]

    assert [q(1, 0), q(0.9, None), q(None, 0.3), q(None, None)] == pytest.approx([0.6, 0.9, 0.3, 0.0])


def test_profiles_reorder_actions(spark):
    rows = spark.createDataFrame(
        [("strong", 0.9, 1.0, 0.8, 0.0, 0.0), ("cheap", 0.5, 0.02, 0.05, 0.0, 0.0)],
        "action_id string, quality double, normalized_cost double, normalized_latency double, "
        "hallucination double, violation double",
    )
    rewards = {(r.profile, r.action_id): r.reward for r in scoring.rewards_by_profile(rows, "action_id").collect()}
    assert rewards["quality_first:v1", "strong"] > rewards["quality_first:v1", "cheap"]
    assert rewards["cost_sensitive:v1", "strong"] < rewards["cost_sensitive:v1", "cheap"]


def test_tall_and_pivot_round_trip(spark):
    wide = scoring.score_wide(outcomes(spark, {}, {"question_id": "p", "gold_chunk_ids": []}))
    back = scoring.pivot_dimensions(scoring.score_tall(wide, "question_id"), "question_id")
    columns = ["question_id", *scoring.DIMENSIONS]
    assert sorted(back.select(columns).collect()) == sorted(wide.select(columns).collect(), key=lambda r: r[0])


def test_grouped_split_rules(spark):
    sizes = {f"g{i}": 1 + (i * 7) % 5 for i in range(14)}
    rows = [(f"{g}-{i}", g) for g, n in sizes.items() for i in range(n)]
    questions = spark.createDataFrame(rows, "question_id string, group_key string")
    got = datasets.grouped_split(questions, seed=3)
    assert got.count() == len(rows) and datasets.leaking_groups(got).count() == 0
    left, expected = {s: f * len(rows) for s, f in v.SPLIT_FRACTIONS.items()}, {}
    for size in sorted(sizes.values(), reverse=True):
        split = sorted(left, key=lambda s: (round(left[s], 9), s))[-1]
        left[split] -= size
        expected[size, split] = expected.get((size, split), 0) + 1
    found = {r.group_key: r.split for r in got.collect()}
    assert Counter((sizes[g], split) for g, split in found.items()) == expected
    other = {r.group_key: r.split for r in datasets.grouped_split(questions, seed=4).collect()}
    assert other != found
    with pytest.raises(ValueError):
        datasets.grouped_split(questions, {"a": 0.5, "b": 0.6})
    with pytest.raises(ValueError):
        datasets.grouped_split(questions.union(questions.limit(1)))


def test_deal_by_threshold_equals_deal_one_by_one():
    rng = random.Random(2)
    for _ in range(300):
        counts = [(n, rng.randint(1, 40)) for n in rng.sample(range(1, 30), rng.randint(1, 6))]
        total = sum(n * c for n, c in counts)
        room = {s: Fraction(str(f)) * total for s, f in v.SPLIT_FRACTIONS.items()}
        expected = {}
        for n, c in sorted(counts, reverse=True):
            expected[n] = dict.fromkeys(room, 0)
            for _ in range(c):
                split = max(room, key=lambda s: (room[s], s))
                room[split] -= n
                expected[n][split] += 1
        assert datasets.deal_sizes(counts, v.SPLIT_FRACTIONS, total) == expected
    many = datasets.deal_sizes([(1, 10**12), (3, 10**11)], v.SPLIT_FRACTIONS, 13 * 10**11)
    assert sum(sum(t.values()) for t in many.values()) == 11 * 10**11


def test_ranks_over_ranges_deal_every_group(spark, monkeypatch):
    questions = spark.range(3000).selectExpr("concat('q', id) as question_id", "concat('g', id % 900) as group_key")
    whole = {tuple(r) for r in datasets.grouped_split(questions).collect()}
    monkeypatch.setattr("assayer.operators.running.FANOUT", 2)
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    again = {tuple(r) for r in datasets.grouped_split(questions).collect()}
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert again == whole and len(whole) == 3000


@pytest.mark.parametrize(
    "name, expected",
    [
        ("3M_2018_10K", ("3M", 2018, None, "10-K")),
        ("3M_2023Q2_10Q", ("3M", 2023, "Q2", "10-Q")),
        ("AMCOR_2022_8K_dated-2022-07-01", ("AMCOR", 2022, None, "8-K")),
        ("A_B_2020_EARNINGS", ("A_B", 2020, None, None)),
        ("X_Y", None),
        ("A_b_10K", None),
    ],
)
def test_document_names(spark, name, expected):
    got = spark.range(1).select(filings.parse_document_name(F.lit(name)).alias("x")).first()["x"]
    assert (tuple(got) if got else None) == expected


def test_filing_preference(spark):
    index = spark.createDataFrame(
        [
            (1, "10-Q", "a", "2020-05-30", "m", True), (1, "10-Q", "b", "2020-09-30", "m", True),
            (1, "10-Q", "c", "2020-06-30", "m", False), (1, "10-K", "d", "2020-12-31", "m", False),
        ],
        "cik int, form string, accession_number string, report_date string, primary_document string, is_recent boolean",
    )
    asked = spark.createDataFrame(
        [("q2", 1, "10-Q", 2020, "Q2"), ("q1", 1, "10-Q", 2020, "Q1"), ("k", 1, "10-K", 2020, None), ("no", 2, "10-K", 2020, None)],
        "request_id string, cik int, form string, fiscal_year int, quarter string",
    )
    got = {r.request_id: r.accession_number for r in filings.select_filings(asked, index).collect()}
    assert got == {"q2": "a", "q1": "b", "k": "d"}


def test_cache(spark):
    asked = spark.createDataFrame([("k1",), ("k2",)], "cache_key string")
    held = spark.createDataFrame([("k1", "stop"), ("k3", "length")], "cache_key string, finish_reason string")
    assert cache.stats(cache.lookup(asked, held)).first()["hit_rate"] == 0.5
    assert [r.cache_key for r in cache.misses(asked, held).collect()] == ["k2"]
    assert [r.cache_key for r in cache.storable(held).collect()] == ["k1"]


def test_request_key_tells_all_fields_apart(spark):
    questions = spark.createDataFrame([("q1", "Why?")], "question_id string, question_text string")
    ways = [{}, {"deployment_ref": "small"}, {"system": "Be brief."}, {"seed": 1}, {"temperature": 0.5}, {"max_output_tokens": 9}]
    keys = {workflows.requests(questions, "A0_direct", **way).first().cache_key for way in ways}
    assert len(keys) == len(ways)


def test_call_signature_tells_numbers_from_texts(spark):
    values = [answers.json_literal(F.lit(1)), answers.json_literal(F.lit("1"))]
    row = spark.range(1).select(*[answers.call_signature(F.lit("f"), F.create_map(F.lit("k"), x)).alias(f"s{i}") for i, x in enumerate(values)]).first()
    assert tuple(row) == ("f(k=1)", 'f(k="1")')


def test_trace_rates(spark):
    steps = spark.createDataFrame(
        [
            ("r", 0, "s(q=a)", True, None, ["x", "y"], 10), ("r", 1, "s(q=a)", True, None, ["y"], 10),
            ("r", 2, None, None, "bad", [], 5), ("r", 3, "read(z)", False, None, [], 5),
        ],
        "run_id string, step int, signature string, ok boolean, parse_error string, chunk_ids array<string>, tokens int",
    )
    row = trace.run_metrics(steps).first()
    assert (row.n_tool_calls, row.total_tokens, row.valid_tool_call_rate) == (3, 30, 0.5)
    assert (row.repeated_call_rate, row.evidence_per_call) == (0.333333, 0.666667)
    assert [r.is_repeat for r in trace.flag_repeats(steps).orderBy("step").collect()] == [False, True, False, False]


def test_draws_are_uniform_and_poisson_has_mean_one(spark):
    rows = spark.range(20000).withColumn("u", uniform(F.col("id"), 3))
    stats = rows.agg(F.avg("u"), F.stddev("u"), F.avg(poisson_one(F.col("u"))), F.min("u"), F.max("u")).first()
    assert stats[0] == pytest.approx(0.5, abs=0.01) and stats[1] == pytest.approx(0.2887, abs=0.01)
    assert stats[2] == pytest.approx(1.0, abs=0.03) and 0 <= stats[3] and stats[4] < 1


def test_mcnemar_and_holm(spark):
    pairs = spark.createDataFrame([(1, 8), (0, 0), (5, 5)], "a_only bigint, b_only bigint")
    got = {(r.a_only, r.b_only): r.p_exact for r in statistics.mcnemar(pairs).collect()}
    assert got == {(1, 8): 0.039063, (0, 0): 1.0, (5, 5): 1.0}
    large = [(1_200_000, 1_202_000), (10, 5_000_000), (700, 801)]
    got = {r.a_only: r.p_exact for r in statistics.mcnemar(spark.createDataFrame(large, "a_only bigint, b_only bigint")).collect()}
    for a, b in large:
        i = np.arange(0, min(a, b) + 1)
        logs = np.concatenate([[0.0], np.cumsum(np.log((a + b - i[1:] + 1) / i[1:]))]) - (a + b) * np.log(2)
        assert got[a] == pytest.approx(min(1.0, 2 * np.exp(logs).sum()), abs=2e-6)
    missing = spark.createDataFrame([(None, 3)], "a_only bigint, b_only bigint")
    assert statistics.mcnemar(missing).first().p_exact is None
    tests = spark.createDataFrame([("f", "a", 0.01), ("f", "b", 0.04), ("f", "c", 0.03)], "f string, t string, p double")
    adjusted = {r.t: r.p_holm for r in statistics.holm(tests, ["f"], "t", "p").collect()}
    assert adjusted == {"a": 0.03, "c": 0.06, "b": 0.06}


def test_bootstrap_covers_the_mean(spark):
    rows = spark.range(400).select(F.lit("x").alias("g"), F.col("id").alias("k"), (F.col("id") % 10).cast("double").alias("d"))
    row = statistics.bootstrap_interval(rows, ["g"], "k", "d", resamples=500).first()
    assert row.ci_low < 4.5 < row.ci_high and row.ci_high - row.ci_low == pytest.approx(0.563, abs=0.12)
    shifted = statistics.permutation_test(rows, ["g"], "k", "d", 500).first()
    assert shifted.p_value < 0.01


def test_calibration_ignores_unjudged_rows(spark):
    rows = spark.createDataFrame([("g", 1.0, 1.0), ("g", 0.0, 1.0), ("g", 0.5, None), ("g", None, 1.0)], "g string, c double, y double")
    row = statistics.calibration(rows, ["g"], "c", "y").first()
    assert (row.n, row.brier, row.ece) == (2, 0.5, 0.5)
    curve = statistics.risk_coverage(rows, ["g"], "c", "y").orderBy("coverage").collect()
    assert [(r.threshold, r.coverage, r.risk) for r in curve] == [(1.0, 0.5, 0.0), (0.0, 1.0, 0.0)]


def test_unfitted_rules_fall_through(spark):
    row = spark.createDataFrame(
        [(1.0, 0.1, 0.2, 0.3, "synthesis")],
        "bm25_top1_score double, dense_top1_similarity double, lexical_dense_agreement double, "
        "bm25_top1_top2_margin double, predicted_question_type string",
    )
    unfitted = dict.fromkeys(("min_bm25_score", "min_dense_similarity", "min_agreement", "min_margin", "strong_margin"))
    assert policies.rule_route(row, unfitted).first()["action_id"] == "A5_agentic"
    fitted = unfitted | {"min_bm25_score": 2.0, "min_dense_similarity": 0.5}
    got = policies.rule_route(row, fitted).first()
    assert (got["action_id"], got["abstention_reason"]) == ("A6_abstain", "insufficient_evidence")


@pytest.fixture(scope="module")
def matrix(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(3000):
        context = i % 2
        rewards = rng.normal(0.2, 0.05, 7)
        rewards[1 + 2 * context] += 0.5
        split = ("dev", "validation", "test")[i % 3]
        rows.append((i, str(context), split, rewards.tolist(), [0.1] * 7, [1.0, float(context)]))
    return spark.createDataFrame(
        rows,
        "question_key bigint, context string, split string, rewards array<double>, costs array<double>, x array<double>",
    ).cache()


def test_estimators_recover_the_truth(spark, matrix):
    log = ope.replay_log(matrix, ope.behaviour_policies(matrix), seeds=(1, 2, 3)).filter(
        "behavior_policy = 'uniform_random'"
    )
    targets = {"fixed": F.lit(1), "routed": F.when(F.col("context") == "1", 3).otherwise(1)}
    truth = ope.true_values(matrix, targets)
    estimates = ope.estimate_values(log, targets, F.col("split") == "dev")
    errors = ope.estimator_errors(estimates, truth).collect()
    limits = {"dm": 0.02, "dr": 0.02, "snips": 0.04, "ips": 0.06}
    assert all(e.absolute_error < limits[e.estimator] for e in errors if e.estimator in limits)
    ranking = ope.ranking_accuracy(estimates, truth, list(targets))
    assert ranking.filter("estimator = 'dr'").first()["ranking_accuracy"] == 1.0
    assert ope.log_violations(log, "question_key").count() == 0
    sums = ope.propensity_rows(ope.behaviour_policies(matrix)).groupBy("policy").agg(F.sum("propensity").alias("s"))
    assert all(r.s == pytest.approx(1.0, abs=1e-6) for r in sums.collect())


@pytest.mark.parametrize("algorithm, parameter", [("linucb", 0.5), ("thompson", 0.1), ("epsilon_greedy", 0.1)])
def test_bandits_learn(spark, matrix, algorithm, parameter):
    report = bandits.learn_in_batches(matrix, algorithm, parameter, batches=6)
    regret = {
        r.batch: r.regret
        for r in report.groupBy("batch").agg(((F.sum("oracle_reward") - F.sum("reward")) / F.sum("n_rounds")).alias("regret")).collect()
    }
    assert report.agg(F.sum("n_rounds")).first()[0] == 3000
    assert regret[5] < 0.15 < regret[0]


def test_unknown_cost_is_not_the_cheapest(spark):
    rows = [("q", "validation", "A0_direct", 0.5, None), ("q", "validation", "A1_bm25", 0.4, 0.02), ("q", "validation", "A3_hybrid", 0.6, 0.01)]


    known = list(v.ANSWERING_ACTIONS)[:3]
    rows = [(q, s, known[i], r, c) for i, (q, s, _, r, c) in enumerate(rows)]
    frame = spark.createDataFrame(rows, "question_id string, split string, action_id string, reward double, estimated_cost_usd double")
    chosen = {r.policy: r.action_id for r in policies.fixed_policies(frame).collect()}
    assert chosen["cheapest_answering"] == known[2]


def test_unseen_context_falls_back_to_the_mean_of_the_log(spark):
    schema = "behavior_policy string, simulation_seed int, split string, context string, arm int, action_propensity double, observed_reward double"
    log = [("p", 1, "dev", "a", 1, 0.5, 4.0), ("p", 1, "dev", "a", 1, 0.5, 6.0), ("p", 1, "test", "new", 2, 0.5, 1.0)]
    frame = spark.createDataFrame(log, schema)
    found = ope.estimate_values(frame, {"one": F.lit(1)}, F.col("split") == "dev", F.col("split") == "test")
    assert found.filter("estimator = 'dm'").first()["estimate"] == 5.0


def test_draws_tell_keys_a_prime_apart(spark):


    keys = spark.createDataFrame([(1,), (1 + PRIME,), (1 + 2 * PRIME,), (1 + PRIME * PRIME // 2,)], "k bigint")
    assert keys.select(uniform(F.col("k"), 3).alias("u")).distinct().count() == 4


def test_supervised_router_finds_the_context(spark, matrix):
    rows = matrix.withColumn("question_id", F.col("question_key").cast("string")).withColumn("is_one", F.get("x", F.lit(1)))
    best = rows.select("question_id", policies.arm_name(bandits.first_argmax(F.col("rewards"))).alias("best_action"))
    labelled = routers.labelled(rows, best)
    grid = [c for c in routers.candidates(1000, ("decision_tree",)) if "max_depth=3,min_leaf=5" in c[0]]
    name, model = routers.select_router(labelled, ["is_one"], grid)
    report = routers.router_report(name, routers.routed(model, labelled), "split")
    assert report.filter("split = 'test'").first()["accuracy"] > 0.95


def test_pareto_front_matches_dominance(spark):
    rng = random.Random(2)
    points = [(i % 3, i, rng.randint(0, 9), rng.randint(0, 9)) for i in range(90)]
    frame = spark.createDataFrame(points, "g int, id int, cost int, quality int")
    front = {r.id for r in policies.pareto_front(frame, ["g"], "cost", "quality").collect()}
    beaten = lambda p, o: o[0] == p[0] and o[2] <= p[2] and o[3] >= p[3] and (o[2] < p[2] or o[3] > p[3])
    assert front == {p[1] for p in points if not any(beaten(p, o) for o in points)}


def test_regret_curve_runs_over_blocks(spark):
    rows = [("p", 1, k, d, 0.25) for k in range(40) for d in (1, 2)] + [("p", 1, 40, 1, None)]
    log = spark.createDataFrame(
        rows, "behavior_policy string, simulation_seed int, question_key bigint, draw_no int, observed_reward double"
    )
    curve = ope.regret_curve(log, F.lit(1.0)).orderBy("n_rounds").collect()
    assert [r.n_rounds for r in curve] == list(range(1, 82))
    assert [r.cumulative_regret for r in curve[:80]] == [0.75 * n for n in range(1, 81)]
    assert curve[80].cumulative_reward == 20.0 and curve[80].cumulative_regret == 60.0


def test_regret_curve_exchanges_questions_and_no_rounds(spark, matrix, monkeypatch):
    """Logs of a matrix in ranges give the curve of the plain log, by no exchange of their rounds."""
    monkeypatch.setattr(ope, "RANGE_QUESTIONS", 300)
    policies_of = ope.behaviour_policies(matrix)
    plain = ope.replay_log(matrix, policies_of, (1, 2), (F.array_max("rewards").alias("best"),))
    ranged = ope.in_ranges(matrix)
    assert ranged.select("__part").distinct().count() > 1
    kept = (F.array_max("rewards").alias("best"), F.col("__part"))
    rounds = ope.replay_log(ranged, policies_of, (1, 2), kept)
    found = ope.regret_curve(rounds, F.col("best"))
    expected = ope.regret_curve(plain, F.col("best"))
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, expected.collect()))
    executed = found._jdf.queryExecution().executedPlan().toString()
    # Totals of ranges are exchanged, by log; rounds would be, by log and range.
    assert "Window" in executed and not re.search(r"hashpartitioning\([^)]*__part", executed)


@pytest.mark.parametrize("slack", [2, 0.01])
def test_nested_samples_order_few_rounds(spark, monkeypatch, slack):
    """The places of all rounds' order, of logs of any length; only low draws are stored."""
    monkeypatch.setattr(ope, "SAMPLE_SLACK", slack)
    held = []
    keep = ope.stored
    monkeypatch.setattr(ope, "stored", lambda rows, name: held.append(keep(rows, name)) or held[-1])
    log = spark.range(6_000).selectExpr(
        "if(id < 5500, 'p', if(id < 5990, 'short', null)) AS behavior_policy", "1 AS simulation_seed",
        "id div 2 AS question_key", "cast(id % 2 AS int) AS draw_no",
    )
    got = {
        (r.behavior_policy, r.question_key, r.draw_no, r.place, r.sample_size)
        for r in ope.nested_samples(log, (5, 20)).collect()
    }
    draw = ope.uniform(F.col("question_key"), F.lit(ope.SAMPLE_STREAM) + F.col("draw_no"))
    rows = log.withColumn("u", draw).collect()
    expected = set()
    for policy in ("p", "short", None):
        ordered = sorted((r.u, r.question_key, r.draw_no) for r in rows if r.behavior_policy == policy)
        for place, (_, key, number) in enumerate(ordered[:20], 1):
            expected |= {(policy, key, number, place, size) for size in (5, 20) if size >= place}
    assert got == expected
    assert held[-1].count() < 600


def test_older_pages_by_year_and_undated(spark):
    pages = spark.createDataFrame(
        [(1, "old", "2010-01-01", "2014-12-31"), (1, "new", "2018-01-01", "2020-12-31"), (1, "undated", None, None), (2, "other", None, None)],
        "cik int, page_name string, filed_from string, filed_to string",
    )
    asked = spark.createDataFrame([("d", 1, 2016), ("e", 1, 2015), ("f", 1, 0)], "document_name string, cik int, fiscal_year int")
    got = {tuple(r) for r in filings.pages_to_read(asked, pages).collect()}
    assert got == {("d", "new"), ("d", "undated"), ("e", "undated"), ("f", "undated")}
