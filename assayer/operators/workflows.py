"""Turning ranked evidence and recorded responses into outcome rows.

A workflow is retrieve, prompt, respond, parse, record. Retrieval and recording
are joins; the response is looked up by request key, so a run is replayable and
a live model only has to fill the response table beforehand.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.functions import answers
from assayer.functions.text import format_evidence
from assayer.operators import scoring

# Prompt versions and their user templates.
DIRECT_VERSION = "direct_v1"
GROUNDED_VERSION = "grounded_v1"
DIRECT_PREFIX = "Question: "
GROUNDED_PARTS = ("Evidence:\n\n", "\n\n---\n\nQuestion: ")


def requests(
    questions: DataFrame,
    action: str,
    evidence: DataFrame | None = None,
    temperature: float = 0.0,
    max_output_tokens: int = 512,
    system: str = "",
    deployment_ref: str = "chat",
    seed: int | None = None,
) -> DataFrame:
    """One request per question: shown chunks, prompt and request key.

    ``evidence`` is (question_id, chunk_id, rank, text) already cut to the
    action's top-k, so a question's list is bounded by k. Without it the direct
    template is used. All seven fields that decide a response are in the key.
    """
    if evidence is None:
        none = F.array().cast("array<string>")
        shown = questions.withColumn("retrieved_chunk_ids", none).withColumn(
            "prompt", F.concat(F.lit(DIRECT_PREFIX), "question_text")
        )
        version = DIRECT_VERSION
    else:
        items = F.sort_array(F.collect_list(F.struct("rank", "chunk_id", "text")))
        lists = evidence.groupBy("question_id").agg(items.alias("items"))
        before, after = map(F.lit, GROUNDED_PARTS)
        shown = (
            questions.join(lists, "question_id", "left")
            .withColumn(
                "retrieved_chunk_ids",
                F.coalesce(
                    F.transform("items", lambda i: i["chunk_id"]), F.array().cast("array<string>")
                ),
            )
            .withColumn(
                "prompt",
                F.concat(before, format_evidence(F.col("items")), after, F.col("question_text")),
            )
            .drop("items")
        )
        version = GROUNDED_VERSION
    key = answers.request_key(
        system=F.lit(system),
        user=F.col("prompt"),
        deployment_ref=F.lit(deployment_ref),
        prompt_version=F.lit(version),
        temperature=F.lit(temperature),
        max_output_tokens=F.lit(max_output_tokens),
        seed=F.lit(seed).cast("bigint"),
    )
    return shown.select(
        "question_id",
        F.lit(action).alias("action_id"),
        F.lit(version).alias("prompt_version"),
        "retrieved_chunk_ids",
        "prompt",
        key.alias("cache_key"),
    )


def record(
    asked: DataFrame,
    responses: DataFrame,
    prices: Mapping[str, tuple[float, float]],
    experiment_id: str,
) -> DataFrame:
    """Outcome rows from requests and (cache_key, text, model, tokens...) rows.

    A request without a response is a ``provider_error``, an unreadable one a
    ``parse_error``; both stay in the table, and a billed failure keeps its cost.
    """
    joined = asked.join(responses, "cache_key", "left")
    tokens = ("input_tokens", "output_tokens", "retry_input_tokens", "retry_output_tokens")
    counted = joined.withColumns(
        {
            name: F.coalesce(F.col(name), F.lit(0)) if name in responses.columns else F.lit(0)
            for name in tokens
        }
    )
    parsed = answers.parse_answers(counted, "text", "a")
    ok = F.coalesce(F.col("a.parsed"), F.lit(False))
    cited = F.when(ok, F.transform("a.citations", lambda c: c["chunk_id"])).otherwise(
        F.array().cast("array<string>")
    )
    split = parsed.withColumn("c", answers.split_citations(cited, F.col("retrieved_chunk_ids")))
    cost, known = scoring.estimate_cost(prices)
    return split.select(
        F.lit(experiment_id).alias("experiment_id"),
        "question_id",
        "action_id",
        "prompt_version",
        "retrieved_chunk_ids",
        F.when(ok, F.col("a.answer")).alias("answer"),
        (ok & F.col("a.abstained")).alias("abstained"),
        F.when(ok, F.col("a.abstention_reason")).alias("abstention_reason"),
        F.when(ok, F.col("a.confidence")).alias("confidence"),
        F.col("c.cited").alias("cited_chunk_ids"),
        F.col("c.hallucinated").alias("hallucinated_citations"),
        F.when(F.col("text").isNull(), "provider_error")
        .when(~ok, "parse_error")
        .otherwise("ok")
        .alias("error_status"),
        "model",
        *tokens,
        F.coalesce(cost, F.lit(0.0)).alias("estimated_cost_usd"),
        known.alias("pricing_known"),
    )


def abstain_always(questions: DataFrame, experiment_id: str, reason: str) -> DataFrame:
    """The abstaining action: one reasoned non-answer per question."""
    return questions.select(
        F.lit(experiment_id).alias("experiment_id"),
        "question_id",
        F.lit("A6_abstain").alias("action_id"),
        F.lit(True).alias("abstained"),
        F.lit(reason).alias("abstention_reason"),
        F.lit("ok").alias("error_status"),
    )
