"""Goldens for tokens, numbers, references, answers and arithmetic."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from assayer.functions import answers, calculator
from assayer.functions import text as tx


def one(spark, value, build):
    return spark.createDataFrame([(value,)], "t string").select(build(F.col("t")).alias("x")).first()["x"]


def test_tokens_keep_surface_and_variant(spark):
    found = one(spark, "Total revenues 66,608 and (1,577) or $1,577.00 at 23.40%", tx.tokens)
    assert found == [
        "total", "revenues", "66,608", "66608", "(1,577)", "-1577", "$1,577.00", "1577", "23.40%", "23.4",
    ]


def test_plain_number_is_not_repeated(spark):
    assert one(spark, "in 2018", tx.tokens) == ["2018"]


def test_words_are_not_stemmed_and_possessives_stay_whole(spark):
    assert one(spark, "The company's revenues", tx.tokens) == ["company's", "revenues"]


def test_letters_outside_ascii_never_become_tokens(spark):
    assert one(spark, "Kelvin Été", tx.tokens) == ["elvin", "t"]


@pytest.mark.parametrize(
    "surface, expected",
    [("(1,577)", "-1577"), ("$1,577.00", "1577"), ("23.40%", "23.4"), ("(1,234)%", "1234)"), ("100", "100")],
)
def test_normalize_number(spark, surface, expected):
    assert one(spark, surface, tx.normalize_number) == expected


@pytest.mark.parametrize(
    "text, expected",
    [
        ("$1,577 million", [1577e6]),
        ("66,608", [66608.0]),
        ("23.4%", [23.4]),
        ("(3,547)", [-3547.0]),
        ("2017-2018", [2017.0, -2018.0]),
        ("5 trillions", [5.0]),
        ("2 BN and 3mm", [2e9, 3e6]),
        ("none", []),
        (None, []),
    ],
)
def test_numbers(spark, text, expected):
    assert one(spark, text, tx.numbers) == expected


def test_token_estimate_floors_and_is_at_least_one(spark):
    assert [one(spark, t, tx.estimate_tokens) for t in ("", "abcdefg", "abcdefgh")] == [1, 1, 2]


def test_references(spark):
    parsed = [one(spark, r, tx.parse_reference) for r in ("A::p3", " A::x::p? ", "A::q3", None)]
    assert [(p["document_id"], p["page_number"], p["malformed"]) for p in parsed] == [
        ("A", 3, False), ("A::x", None, False), (None, None, True), (None, None, True),
    ]
    assert one(spark, "", lambda t: tx.evidence_reference(F.lit("A"), t)) == "A::p?"


def test_table_rendering(spark):
    rows = F.array(F.array(F.lit(" a "), F.lit("b")), F.array(F.lit("1"), F.lit("2")))
    assert one(spark, "", lambda t: tx.render_table(rows)) == "a | b\n1 | 2"


def test_answers(spark):
    raws = [
        '{"answer": "5", "citations": ["c1", {"chunk_id": "c2", "quoted_text": "q"}], "confidence": 0.4}',
        'Sure: ```json\n{"abstention_reason": "insufficient_evidence"}\n```',
        'text {"answer": ""} text',
        "no object",
        '["a"]',
        '{"answer": "x", "abstention_reason": "ambiguous_question"}',
        '{"answer": "x", "confidence": 1.5}',
    ]
    rows = spark.createDataFrame(list(enumerate(raws)), "i int, raw string")
    got = [r["p"] for r in answers.parse_answers(rows, "raw", "p").orderBy("i").collect()]
    assert [p["parsed"] for p in got] == [True, True, False, False, False, False, False]
    assert [(c["chunk_id"], c["quoted_text"]) for c in got[0]["citations"]] == [("c1", None), ("c2", "q")]
    assert got[1]["abstained"] and got[1]["abstention_reason"] == "insufficient_evidence"


def test_citations_split_into_bag_and_set(spark):
    cited = F.array(*map(F.lit, ("a", "z", "a", "y", "z")))
    got = one(spark, "", lambda t: answers.split_citations(cited, F.array(F.lit("a"), F.lit("b"))))
    assert (got["cited"], got["hallucinated"]) == (["a", "a"], ["y", "z"])


@pytest.mark.parametrize(
    "text, expected",
    [
        ("(1,000 + 2) * 3", (3006.0, None)),
        ("-2 ** 2", (-4.0, None)),
        ("7 // 2 + 7 % 4", (6.0, None)),
        ("1 / 0", (None, "division_by_zero")),
        ("2 ** 101", (None, "overflow")),
        ("__import__('os')", (None, "not_arithmetic")),
        ("True + 1", (None, "not_arithmetic")),
        ("", (None, "empty")),
        ("1+" * 300 + "1", (None, "too_long")),
    ],
)
def test_calculator(text, expected):
    assert calculator.evaluate(text) == expected


def test_unicode_spaces_count_as_space(spark):
    assert one(spark, "5 million", tx.numbers) == [5e6]
    assert one(spark, " a ", tx.strip) == "a"
    assert one(spark, "a. b", tx.sentences) == ["a.", "b"]
    assert one(spark, " a \n b ", tx.squeeze_space) == "a b"
