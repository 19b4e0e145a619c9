from __future__ import annotations

import pytest


@pytest.fixture(scope="session")
def docs(spark):
    """Awkward documents: null and empty texts, ties, repeated rows, a clashing column."""
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, fingerprint string"

    def make(rows):
        full = [(i, t, "en", "s", len(t or ""), "own") for i, t in rows]
        return spark.createDataFrame(full, schema)

    from assayer.session import ship_package

    ship_package(spark)
    return make


@pytest.fixture(scope="session")
def awkward(docs):
    long_text = " ".join(f"word{i % 977} runs on." for i in range(20_000))
    return docs(
        [
            (1, None),
            (2, ""),
            (3, "  \n\t "),
            (4, "One short line."),
            (5, "One short line."),
            (5, "One short line."),
            (6, long_text),
            (7, long_text + "!"),
            (None, "One short line."),
            (8, "Grüße 🙂 <|endoftext|> don't  stop\n\nit's 12,5 ½"),
            (9, long_text),
        ]
    )
