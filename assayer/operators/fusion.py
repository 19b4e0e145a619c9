"""Fusing and reranking ranked lists.

A ranked list is (question_id, source, chunk_id, rank). All operators keep the
lists tall; text is joined only where a scorer reads it.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.functions import text as tx
from assayer.operators.bm25 import top_k
from assayer.session import join_small

RRF_K = 60
CANDIDATE_K = 50
NEUTRAL_SCORE = 5.0
SCORE_DIGITS = 6


def reciprocal_rank_fusion(
    rankings: DataFrame,
    k: int = 10,
    rrf_k: int = RRF_K,
    weights: Mapping[str, float] | None = None,
) -> DataFrame:
    """Fuse lists by summed weight/(rrf_k + rank); ties break on chunk id.

    ``component_ranks`` keeps the place each source gave the chunk, the last of several.
    """
    weight = F.lit(1.0)
    if weights:
        table = F.create_map(*[x for s, w in weights.items() for x in (F.lit(s), F.lit(float(w)))])
        weight = F.coalesce(F.try_element_at(table, F.col("source")), F.lit(1.0))
    listed = F.col("__listed")
    # A chunk that is listed twice by a source, as copies of a key are, keeps its last place there.
    last = F.filter(
        listed,
        lambda e, i: (i == F.size(listed) - 1) | (F.get(listed, i + 1)["source"] != e["source"]),
    )
    fused = (
        rankings.groupBy("question_id", "chunk_id")
        .agg(
            F.round(F.sum(weight / (rrf_k + F.col("rank"))), 9).alias("score"),
            # As many entries as the lists have places for the chunk.
            F.sort_array(F.collect_list(F.struct("source", "rank"))).alias("__listed"),
        )
        .select("question_id", "chunk_id", "score", F.map_from_entries(last).alias("component_ranks"))
    )
    return top_k(fused, k, "chunk_id")


def as_source(ranked: DataFrame, name: str) -> DataFrame:
    return ranked.select("question_id", F.lit(name).alias("source"), "chunk_id", "rank")


def reorder(candidates: DataFrame, k: int) -> DataFrame:
    """New ranks on (score desc, old rank, chunk id); the old rank is kept."""
    moved = candidates.withColumnRenamed("rank", "retrieval_rank")
    return top_k(moved, k, "retrieval_rank", "chunk_id")


def lexical_overlap(
    candidates: DataFrame, queries: DataFrame, chunks: DataFrame, k: int = 10
) -> DataFrame:
    """Rerank by the share of distinct query terms found in the chunk."""
    asked = queries.select(
        "question_id", F.array_distinct(tx.tokens(F.col("question_text"))).alias("asked")
    )
    # Candidates are few per question: only their chunks' text is tokenized.
    listed = candidates.select("chunk_id").distinct()
    shown = join_small(chunks.select("chunk_id", "text"), listed, "chunk_id", "left_semi").select(
        "chunk_id", F.array_distinct(tx.tokens(F.col("text"))).alias("shown")
    )
    overlap = F.size(F.array_intersect("asked", "shown")) / F.size("asked")
    scored = (
        candidates.select("question_id", "chunk_id", "rank")
        .join(asked, "question_id")
        .join(shown, "chunk_id")
        .select(
            "question_id",
            "chunk_id",
            "rank",
            F.round(
                F.when(F.size("asked") > 0, overlap).otherwise(F.lit(0.0)), SCORE_DIGITS
            ).alias("score"),
        )
    )
    return reorder(scored, k)


def listwise_scores(candidates: DataFrame, judged: DataFrame, k: int = 10) -> DataFrame:
    """Rerank by externally supplied (question_id, position, judged_score).

    Positions outside the list are ignored, passages left out keep a neutral
    score, and a question with no usable score keeps its retrieval order.
    """
    usable = judged.select("question_id", F.col("position").alias("rank"), "judged_score")
    matched = candidates.select("question_id", "chunk_id", "rank").join(
        usable, ["question_id", "rank"], "left"
    )
    answered = matched.groupBy("question_id").agg(
        F.bool_or(F.col("judged_score").isNotNull()).alias("answered")
    )
    scored = matched.join(answered, "question_id").withColumn(
        "score",
        F.when(
            F.col("answered"), F.coalesce("judged_score", F.lit(NEUTRAL_SCORE))
        ).otherwise(-F.col("rank").cast("double")),
    )
    return reorder(scored.select("question_id", "chunk_id", "rank", "score"), k)
