"""Each operator applied to its whole table, and SQL twins where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from assayer.llm import (
    align,
    bpe,
    decontaminate,
    exact,
    html_text,
    lines,
    manifest,
    simhash,
    spans,
    suffixes,
    token_store,
    toxicity,
    twins,
    warc,
)
from assayer.llm.common import shared_folder, table
from assayer.session import ship_package

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def prepared(function: Query) -> Query:
    """The query with the package on the workers and the shared folder known."""

    @wraps(function)
    def run(spark: SparkSession, folder: str) -> DataFrame:
        ship_package(spark)
        shared_folder(spark)
        return function(spark, folder)

    return run


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        QUERIES[name] = prepared(function)
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


@query("op1_decontamination")
def op1(spark, folder):
    return decontaminate.contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query("op2_html_extraction")
def op2(spark, folder):
    return html_text.extracted(table(spark, folder, "pages"))


@query("op3_toxicity")
def op3(spark, folder):
    return toxicity.scored(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op4_simhash")
def op4(spark, folder):
    return simhash.near_duplicates(table(spark, folder, "documents"))


@query(
    "op5_exact_dedup",
    """SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
           doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
    FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))""",
)
def op5(spark, folder):
    return exact.duplicate_groups(table(spark, folder, "documents"))


@query("op6_line_dedup")
def op6(spark, folder):
    return lines.duplicate_lines(table(spark, folder, "documents"))


@query("op7_substring_dedup")
def op7(spark, folder):
    docs = table(spark, folder, "documents")
    return spans.remove_spans(docs, spans.repeated_spans(docs))


@query("op8_bpe")
def op8(spark, folder):
    return bpe.encoded(table(spark, folder, "documents"))


@query("op9_token_store")
def op9(spark, folder):
    docs = table(spark, folder, "documents")
    return token_store.TokenStore.write(docs).read(token_store.keys_of(docs))


@query(
    "op10_warc",
    """WITH p AS (SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS n
                  FROM pages),
    q AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS last FROM p)
    SELECT page_id, n AS payload_bytes, sha1(html) AS payload_digest,
           CASE WHEN n >= 1000 AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN n >= 1000 AND page_id <> last THEN last END AS refers_to
    FROM q""",
)
def op10(spark, folder):
    index, bundles = warc.archive(table(spark, folder, "pages"))
    return warc.read_records(index, bundles)


@query("op11_tokenizer_alignment")
def op11(spark, folder):
    return align.link_figures(table(spark, folder, "documents"))


@query("op12_merkle_manifest", twins.MANIFEST)
def op12(spark, folder):
    return manifest.tamper_checks(table(spark, folder, "documents"))


@query("op13_suffix_dedup")
def op13(spark, folder):
    return suffixes.deduplicated(table(spark, folder, "documents"))
