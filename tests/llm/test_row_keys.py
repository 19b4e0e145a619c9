"""Rows with null or repeated ids go by their own texts."""

from __future__ import annotations

from assayer.llm import decontaminate


def test_only_contaminated_rows_go(spark, docs):
    item = "what was the net revenue of the northern harbor company in the year before"
    benchmark = spark.createDataFrame([(1, item)], "item_id bigint, text string")
    clean = "quiet rivers run under the old bridge and nobody counts the boats"
    held = f"once more {item} and so on"
    rows = [(None, held), (None, clean), (7, held), (7, clean), (8, clean), (9, held)]
    kept = decontaminate.keep_uncontaminated(docs(rows), benchmark)
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == [(7, clean), (8, clean), (None, clean)]
