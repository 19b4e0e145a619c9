"""A corpus from raw documents to tokens, in stages that each see what the one before kept.

Every stage's result is written to the shared folder and read again, so that a
lost executor never reaches back across a stage, and all decisions of a stage are
made once. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from assayer.llm import bpe, decontaminate, exact, near, simhash, toxicity
from assayer.llm.common import shared_folder, stored, table
from assayer.session import ship_package

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _prepared(spark: SparkSession) -> None:
    ship_package(spark)
    shared_folder(spark)


def clean_of_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _prepared(spark)
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def one_of_equals(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _prepared(spark)
    return exact.keep_last_of_equals(docs)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """By fingerprints first; what these leave is compared by whole sets of shingles."""
    _prepared(spark)
    left = stored(simhash.keep_one_per_class(docs), "pipeline-fingerprints")
    return near.keep_one_of_near_copies(left)


def clean_of_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _prepared(spark)
    return decontaminate.keep_uncontaminated(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _prepared(spark)
    return bpe.encoded(docs, with_ids=True)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", clean_of_toxicity),
    ("exact dedup", one_of_equals),
    ("near-dedup", one_of_near_copies),
    ("benchmark decontamination", clean_of_benchmarks),
    ("bpe encoding and decoding", tokens),
]

#: SQL cannot express the trained classifier or the tokenizer.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    _prepared(spark)
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{number}")
    return docs
