"""Routing features: of the question, of a retrieval probe, of the router."""

from __future__ import annotations

from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.functions import text as tx
from assayer.operators.bm25 import term_counts

DIGITS = 6
PROBE_K = 10

# Our choice, as the feature list names these signals without rules.
COMPARISON_WORDS = ("compare", "versus", "vs", "than", "difference", "between")
ARITHMETIC_WORDS = ("ratio", "margin", "growth", "percent", "average", "sum", "calculate")
SYNTHESIS_WORDS = ("why", "how", "explain", "summarise", "summarize", "describe", "drivers")
YEAR_PATTERN = r"\b(?:19|20)\d{2}\b"


def query_features(questions: DataFrame) -> DataFrame:
    """Surface features of ``question_text``."""
    text = F.col("question_text")
    terms = tx.tokens(text, expand_numbers=False, remove_stopwords=False)
    with_terms = questions.select("question_id", "question_text", terms.alias("terms"))

    def has(words: tuple[str, ...]) -> Column:
        return F.arrays_overlap("terms", F.array(*map(F.lit, words)))

    kind = (
        F.when(has(COMPARISON_WORDS), "comparison")
        .when(has(ARITHMETIC_WORDS), "arithmetic")
        .when(has(SYNTHESIS_WORDS), "synthesis")
        .otherwise("extraction")
    )
    return with_terms.select(
        "question_id",
        F.length("question_text").alias("n_chars"),
        F.size("terms").alias("n_tokens"),
        F.size(F.array_distinct("terms")).alias("n_distinct_tokens"),
        F.size(tx.sentences(text)).alias("n_sentences"),
        F.size(tx.numbers(text)).alias("n_numbers"),
        text.rlike(YEAR_PATTERN).alias("has_year"),
        F.contains(text, F.lit("%")).alias("has_percent"),
        text.rlike(r"[$€£]").alias("has_currency"),
        kind.alias("predicted_question_type"),
    )


def list_features(ranked: DataFrame, prefix: str, k: int = PROBE_K) -> DataFrame:
    """Top score, margin, entropy and document spread of a ranked list.

    Scores are shares of the list's total; entropy is in nats.
    """
    top = ranked.filter(F.col("rank") <= k)
    score = F.col("score")
    # -sum(p ln p) with p = s/S equals ln S - sum(s ln s)/S: one aggregate.
    total, weighted = F.sum(score), F.sum(score * F.log(score))
    return top.groupBy("question_id").agg(
        F.max(F.when(F.col("rank") == 1, score)).alias(f"{prefix}_top1"),
        F.round(
            F.max(F.when(F.col("rank") == 1, score))
            - F.coalesce(F.max(F.when(F.col("rank") == 2, score)), F.lit(0.0)),
            DIGITS,
        ).alias(f"{prefix}_margin"),
        F.round(F.log(total) - weighted / total, DIGITS).alias(f"{prefix}_entropy"),
        F.count_distinct("document_id").alias(f"{prefix}_documents"),
    )


def agreement(left: DataFrame, right: DataFrame, k: int = PROBE_K) -> DataFrame:
    """Overlap of two top-k lists and their reciprocal-rank overlap."""
    a = left.filter(F.col("rank") <= k).select("question_id", "chunk_id", "rank")
    b = right.filter(F.col("rank") <= k).select(
        "question_id", "chunk_id", F.col("rank").alias("other_rank")
    )
    return (
        a.join(b, ["question_id", "chunk_id"])
        .groupBy("question_id")
        .agg(
            F.round(F.count(F.lit(1)) / k, DIGITS).alias("lexical_dense_agreement"),
            F.round(F.sum(1.0 / (F.col("rank") * F.col("other_rank"))), DIGITS).alias(
                "reciprocal_rank_overlap"
            ),
        )
    )


def probe_features(
    questions: DataFrame, lexical: DataFrame, dense: DataFrame, k: int = PROBE_K
) -> DataFrame:
    """Features of a cheap first-stage probe, one row per question."""
    return (
        questions.select("question_id")
        .join(list_features(lexical, "lexical", k), "question_id", "left")
        .join(list_features(dense, "dense", k), "question_id", "left")
        .join(agreement(lexical, dense, k), "question_id", "left")
        .select(
            "question_id",
            F.coalesce("lexical_top1", F.lit(0.0)).alias("bm25_top1_score"),
            F.coalesce("lexical_margin", F.lit(0.0)).alias("bm25_top1_top2_margin"),
            F.coalesce("lexical_entropy", F.lit(0.0)).alias("bm25_entropy"),
            F.coalesce("dense_top1", F.lit(0.0)).alias("dense_top1_similarity"),
            F.coalesce("dense_margin", F.lit(0.0)).alias("dense_top1_top2_margin"),
            F.coalesce("lexical_dense_agreement", F.lit(0.0)).alias("lexical_dense_agreement"),
            F.coalesce("reciprocal_rank_overlap", F.lit(0.0)).alias("reciprocal_rank_overlap"),
            F.coalesce("lexical_documents", F.lit(0)).alias("distinct_documents_in_top_k"),
        )
    )


def router_confidence(probabilities: Column) -> dict[str, Column]:
    """Top probability, margin and entropy of an action distribution."""
    ordered = F.sort_array(probabilities, asc=False)
    entropy = F.aggregate(
        probabilities,
        F.lit(0.0),
        lambda total, p: total - F.when(p > 0, p * F.log(p)).otherwise(0.0),
    )
    return {
        "max_probability": F.round(F.get(ordered, F.lit(0)), DIGITS),
        "probability_margin": F.round(F.get(ordered, F.lit(0)) - F.get(ordered, F.lit(1)), DIGITS),
        "prediction_entropy": F.round(entropy, DIGITS),
    }


def standardize(
    features: DataFrame, columns: list[str], fit_split: str = "dev", output: str = "scaled"
) -> DataFrame:
    """Standardize with the mean and deviation of the fitting split only."""
    assembled = VectorAssembler(inputCols=columns, outputCol="__raw").transform(features)
    scaler = StandardScaler(inputCol="__raw", outputCol="__std", withMean=True, withStd=True)
    model = scaler.fit(assembled.filter(F.col("split") == fit_split))
    return (
        model.transform(assembled)
        .withColumn(output, vector_to_array("__std"))
        .drop("__raw", "__std")
    )


def answer_overlap(answer: Column, reference: Column) -> dict[str, Column]:
    """Exact match after normalization, and token F1 on token multisets."""
    left = F.sort_array(tx.tokens(F.coalesce(answer, F.lit(""))))
    right = F.sort_array(tx.tokens(F.coalesce(reference, F.lit(""))))
    return {"answer_terms": left, "reference_terms": right}


def answer_metrics(pairs: DataFrame, *keys: str) -> DataFrame:
    """Exact match and token F1 of (answer, reference_answer) rows.

    The multiset intersection is taken on run-length counts inside the row:
    both count lists are turned into maps and the smaller counts are summed.
    """
    terms = answer_overlap(F.col("answer"), F.col("reference_answer"))
    counted = (
        pairs.select(
            *keys,
            tx.squeeze_space(tx.ascii_lower(F.coalesce("answer", F.lit("")))).alias("a"),
            tx.squeeze_space(tx.ascii_lower(F.coalesce("reference_answer", F.lit("")))).alias("b"),
            *[c.alias(n) for n, c in terms.items()],
        )
        .withColumn("answer_counts", term_counts(F.col("answer_terms")))
        .withColumn("reference_counts", F.map_from_entries(term_counts(F.col("reference_terms"))))
    )
    common = F.aggregate(
        "answer_counts",
        F.lit(0),
        lambda total, c: total
        + F.least(
            c["tf"], F.coalesce(F.try_element_at(F.col("reference_counts"), c["term"]), F.lit(0))
        ),
    )
    sizes = F.size("answer_terms") + F.size("reference_terms")
    f1 = F.coalesce(F.try_divide(2.0 * common, sizes), F.lit(0.0))
    return counted.select(
        *keys,
        ((F.col("a") == F.col("b")) & (F.col("a") != "")).cast("int").alias("exact_match"),
        F.round(f1, DIGITS).alias("token_f1"),
    )
