"""Reading and writing the tables the operators exchange."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.functions import text as tx
from assayer.functions.once import with_once

# Page separator of plain-text documents.
PAGE_DELIMITER = "\n<<<PAGE>>>\n"

EVIDENCE_SCHEMA = (
    "array<struct<evidence_text:string,doc_name:string,evidence_page_num:bigint,"
    "evidence_text_full_page:string>>"
)
#: Fields of one benchmark question line.
QUESTION_SCHEMA = (
    "financebench_id string, company string, doc_name string, doc_period bigint, "
    "doc_type string, question_type string, question string, answer string, "
    f"evidence {EVIDENCE_SCHEMA}, doc_link string, justification string"
)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def parse_questions(lines: DataFrame, dataset: str = "benchmark") -> tuple[DataFrame, DataFrame]:
    """Questions and parse failures from a ``line`` column; blank lines skipped."""
    rows = with_once(
        lines.filter(tx.strip(F.col("line")) != ""),
        "row",
        F.from_json(
            "line", QUESTION_SCHEMA + ", _bad string", {"columnNameOfCorruptRecord": "_bad"}
        ),
    )
    identifier = tx.strip(F.coalesce("row.financebench_id", F.lit("")))
    invalid = F.col("row").isNull() | F.col("row._bad").isNotNull()
    reason = F.when(invalid, "invalid JSON").when(identifier == "", "row has no identifier")
    tagged = rows.withColumn("reason", reason)
    failures = tagged.filter(F.col("reason").isNotNull()).drop("row")

    company = tx.strip(F.coalesce("row.company", F.lit("")))
    document = tx.strip(F.coalesce("row.doc_name", F.lit("")))
    # An entry without a document of its own belongs to the question's document.
    entry_document = lambda e: tx.strip(F.coalesce(F.nullif(e["doc_name"], F.lit("")), document))
    references = F.transform(
        F.filter(
            F.coalesce("row.evidence", F.array().cast(EVIDENCE_SCHEMA)),
            lambda e: e.isNotNull() & (entry_document(e) != ""),
        ),
        lambda e: tx.evidence_reference(entry_document(e), e["evidence_page_num"]),
    )
    blank = F.lit("")
    questions = tagged.filter(F.col("reason").isNull()).select(
        identifier.alias("question_id"),
        F.lit(dataset).alias("dataset"),
        tx.strip(F.coalesce("row.question", blank)).alias("question_text"),
        F.coalesce(F.nullif(company, blank), F.nullif(document, blank), identifier).alias(
            "group_key"
        ),
        F.when(document != "", F.array(document))
        .otherwise(F.array().cast("array<string>"))
        .alias("document_ids"),
        F.when(F.coalesce("row.answer", blank) != "", tx.strip(F.col("row.answer"))).alias(
            "reference_answer"
        ),
        F.array_distinct(references).alias("reference_evidence"),
        F.lit(None).cast("string").alias("question_type"),
        company.alias("company"),
        F.col("row.doc_link").alias("doc_link"),
        F.col("row.evidence").alias("evidence"),
        document.alias("doc_name"),
    )
    return questions, failures


def evidence_pages(questions: DataFrame, *order: str) -> DataFrame:
    """Cited pages as (document_id, page_number, text); the first citation wins.

    ``order`` names the columns that put questions in file order. The first
    occurrence is taken by an ordered minimum, which combines map-side.
    """
    cited = questions.select(*order, "doc_name", F.posexplode("evidence").alias("pos", "e"))
    page = cited.select(
        *order,
        "pos",
        tx.strip(F.coalesce(F.nullif("e.doc_name", F.lit("")), "doc_name", F.lit(""))).alias(
            "document_id"
        ),
        F.col("e.evidence_page_num").cast("int").alias("page_number"),
        F.coalesce(
            F.nullif("e.evidence_text_full_page", F.lit("")), F.nullif("e.evidence_text", F.lit(""))
        ).alias("text"),
    ).filter("document_id <> '' and page_number is not null and text is not null")
    return page.groupBy("document_id", "page_number").agg(
        F.min_by("text", F.struct(*order, "pos")).alias("text")
    )


def delimited_documents(spark: SparkSession, path: str, first_page: int = 1) -> DataFrame:
    """Plain-text files split into pages at the page delimiter."""
    files = spark.read.text(path, wholetext=True).select(
        "value", F.col("_metadata.file_name").alias("file_name")
    )
    return split_pages(
        files.select(
            F.regexp_replace("file_name", r"\.[^.]*$", "").alias("document_id"),
            F.col("value").alias("text"),
        ),
        first_page,
    )


def split_pages(texts: DataFrame, first_page: int = 1) -> DataFrame:
    """(document_id, text) to (document_id, page_number, text)."""
    parts = F.split("text", rf"\Q{PAGE_DELIMITER}\E")
    return texts.select("document_id", F.posexplode(parts).alias("index", "page")).select(
        "document_id",
        (F.col("index") + first_page).alias("page_number"),
        tx.strip(F.col("page")).alias("text"),
    )


def file_checksums(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").load(path)
    return files.select(
        "path", "length", F.concat(F.lit("sha256:"), F.sha2("content", 256)).alias("checksum")
    )


def write_records(records: DataFrame, path: str, *partition_by: str) -> None:
    """Append a record table, partitioned by experiment unless told otherwise."""
    columns = partition_by or ("experiment_id",)
    records.write.mode("append").partitionBy(*columns).parquet(path)


def write_splits(assignment: DataFrame, path: str) -> None:
    """Persist (split, group_key, question_id) rows as JSON lines, one per question.

    Rows instead of one nested document, so that no split is gathered anywhere.
    """
    assignment.select("split", "group_key", "question_id").write.mode("overwrite").json(path)


def read_splits(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("split string, group_key string, question_id string").json(path)
