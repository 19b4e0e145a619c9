"""Grounded workflow outcomes over recorded responses."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayer.operators import workflows
from assayer.plans import retrieval_plans, roles
from assayer.plans.registry import plan
from assayer.session import join_small, stored

TOP = 5


def recorded(asked):
    """Responses an earlier run would have left, derived from each request.

    By question number: every fifth has none, every fourth is unreadable, every
    third abstains, and the others cite their first chunk and an unseen one.
    """
    item = F.substring("question_id", 2, 20).cast("bigint")
    first = F.coalesce(F.get("retrieved_chunk_ids", F.lit(0)), F.lit("none"))
    text = (
        F.when(item % 4 == 1, "cannot answer in the asked form")
        .when(item % 3 == 0, '{"abstained": true, "abstention_reason": "insufficient_evidence"}')
        .otherwise(
            F.concat(
                F.lit('Answer: {"answer": "see '), first,
                F.lit('", "confidence": 0.5, "citations": ["'), first,
                F.lit('", {"chunk_id": "unseen"}]}'),
            )
        )
    )
    return asked.filter(item % 5 != 2).select(
        "cache_key",
        text.alias("text"),
        F.when(item % 2 == 0, "Large-B").otherwise("other").alias("model"),
        F.size("retrieved_chunk_ids").cast("bigint").alias("input_tokens"),
        F.lit(100).cast("bigint").alias("output_tokens"),
    )


@plan(
    "workflow_outcomes",
    f"""WITH {roles.BM25_SQL}, t AS (SELECT question_id, list(chunk_id ORDER BY rank) AS ids FROM bm25_all WHERE rank <= {TOP} GROUP BY ALL),
    q AS (SELECT question_id, CAST(substr(question_id, 2) AS BIGINT) AS item, coalesce(ids, CAST([] AS VARCHAR[])) AS ids FROM item_rows LEFT JOIN t USING (question_id)),
    s AS (SELECT *, CASE WHEN item % 5 = 2 THEN 'provider_error' WHEN item % 4 = 1 THEN 'parse_error' ELSE 'ok' END AS error_status FROM q),
    k AS (SELECT *, error_status = 'ok' AND item % 3 = 0 AS abstained, error_status = 'ok' AND item % 3 <> 0 AS answered,
      coalesce(ids[1], 'none') AS first FROM s)
    SELECT question_id, array_to_string(ids, ',') AS retrieved, CASE WHEN answered THEN 'see ' || first END AS answer, abstained,
      CASE WHEN answered THEN first ELSE '' END AS cited, CASE WHEN answered THEN 'unseen' ELSE '' END AS hallucinated, error_status,
      CASE WHEN error_status <> 'provider_error' AND item % 2 = 0 THEN (len(ids) * 30.0::DOUBLE + 100 * 90.0::DOUBLE) / 1000000 ELSE 0 END AS estimated_cost_usd,
      error_status <> 'provider_error' AND item % 2 = 0 AS pricing_known
    FROM k""",
)
def workflow_outcomes(spark, folder):
    questions = roles.questions(spark, folder)
    shown = join_small(
        roles.corpus(spark, folder).select("chunk_id", "text"),
        stored(retrieval_plans.lexical(spark, folder, TOP), "lexical"),
        "chunk_id",
    )
    asked = workflows.requests(questions, "A1_bm25", shown)
    rows = workflows.record(asked, recorded(asked), roles.PRICES, roles.EXPERIMENT)
    return rows.select(
        "question_id",
        F.array_join("retrieved_chunk_ids", ",").alias("retrieved"),
        "answer",
        "abstained",
        F.array_join("cited_chunk_ids", ",").alias("cited"),
        F.array_join("hallucinated_citations", ",").alias("hallucinated"),
        "error_status",
        "estimated_cost_usd",
        "pricing_known",
    )
