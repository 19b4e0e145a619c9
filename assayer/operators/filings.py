"""Reading document names, choosing filings and reporting corpus coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.session import join_small

# Form labels, and the report months accepted for each quarter.
FORM_TYPES = {"10k": "10-K", "10q": "10-Q", "8k": "8-K"}
QUARTER_MONTHS = {
    "Q1": (1, 2, 3, 4),
    "Q2": (4, 5, 6, 7),
    "Q3": (7, 8, 9, 10),
    "Q4": (10, 11, 12, 1),
}


def parse_document_name(name: Column) -> Column:
    """Struct of company, fiscal_year, quarter, form; NULL when unreadable.

    The form is the right-most known token; without one, the last token takes
    its place and the form is NULL.
    """
    parts = F.split(name, "_")
    n = F.size(parts)
    known = F.transform(parts, lambda p, i: F.lower(p).isin(*FORM_TYPES) & (i > 0))
    from_right = F.array_position(F.reverse(known), True)
    at = F.when(from_right > 0, (n - from_right).cast("int")).otherwise(n - 1)
    period = F.upper(F.get(parts, at - 1))
    has_quarter = F.contains(period, F.lit("Q"))
    year = F.when(has_quarter, F.substring_index(period, "Q", 1)).otherwise(period)
    quarter = F.regexp_extract(period, r"(?s)Q(.*)$", 1)
    forms = F.create_map(*[F.lit(x) for pair in FORM_TYPES.items() for x in pair])
    fiscal_year = year.try_cast("int")
    parsed = F.struct(
        F.array_join(F.slice(parts, F.lit(1), F.greatest(at - 1, F.lit(0))), "_").alias("company"),
        fiscal_year.alias("fiscal_year"),
        F.when(has_quarter & (quarter != ""), F.concat(F.lit("Q"), quarter)).alias("quarter"),
        F.try_element_at(forms, F.lower(F.get(parts, at))).alias("form"),
    )
    return F.when((n >= 3) & fiscal_year.isNotNull(), parsed)


def fetch_plan(questions: DataFrame, *order: str) -> DataFrame:
    """One request per referenced document; an unreadable name keeps year 0."""
    first = (
        questions.filter(F.coalesce("doc_name", F.lit("")) != "")
        .groupBy("doc_name")
        .agg(F.min_by(F.struct("company", "doc_link"), F.struct(*order)).alias("row"))
    )
    parsed = first.withColumn("p", parse_document_name(F.col("doc_name")))
    return parsed.select(
        F.col("doc_name").alias("document_name"),
        F.col("row.company").alias("company"),
        F.coalesce("p.fiscal_year", F.lit(0)).alias("fiscal_year"),
        F.col("p.quarter").alias("quarter"),
        F.col("p.form").alias("form"),
        F.col("row.doc_link").alias("doc_link"),
    )


def filings_from_blocks(blocks: DataFrame) -> DataFrame:
    """Parallel arrays of a submissions block to one row per filing."""
    zipped = F.arrays_zip(
        "form", "accession_number", "filing_date", "report_date", "primary_document"
    )
    return blocks.select("cik", "is_recent", F.inline(zipped))


def page_could_cover(filed_from: Column, filed_to: Column, fiscal_year: Column) -> Column:
    """Whether an older index page may hold a fiscal year; undated pages may."""
    start = F.substring(filed_from, 1, 4).try_cast("int")
    end = F.substring(filed_to, 1, 4).try_cast("int")
    inside = (start <= fiscal_year + 2) & (end >= fiscal_year)
    return start.isNull() | end.isNull() | F.coalesce(inside, F.lit(True))


def pages_to_read(requests: DataFrame, pages: DataFrame) -> DataFrame:
    """(document_name, page_name): older index pages that may list a request's filing.

    A report is filed up to two years after its fiscal year, so a page counts if its
    dates meet [year, year + 2]. Year 0, of an unreadable name, meets undated pages only.
    """
    met = join_small(requests, pages, "cik")
    covers = page_could_cover(F.col("filed_from"), F.col("filed_to"), F.col("fiscal_year"))
    return met.filter(covers).select("document_name", "page_name")


def select_filings(requests: DataFrame, filings: DataFrame) -> DataFrame:
    """The filing answering each (request_id, cik, form, fiscal_year, quarter).

    Preference: recent index before older pages, then report months of the
    quarter where any match, then the latest report date. One ordered maximum
    per request combines map-side and needs no window.
    """
    months = F.create_map(
        *[x for q, m in QUARTER_MONTHS.items() for x in (F.lit(q), F.array(*map(F.lit, m)))]
    )
    dated = filings.withColumn(
        "fiscal_year", F.substring("report_date", 1, 4).try_cast("int")
    ).withColumn("month", F.substring("report_date", 6, 2).try_cast("int"))
    in_quarter = F.coalesce(
        F.array_contains(F.try_element_at(months, F.upper("quarter")), F.col("month")),
        F.lit(False),
    )
    candidates = requests.join(dated, ["cik", "form", "fiscal_year"])
    preference = F.struct(
        F.col("is_recent").alias("recent"),
        in_quarter.alias("narrowed"),
        F.col("report_date").alias("latest"),
        F.col("accession_number").alias("tie"),
    )
    chosen = F.struct("accession_number", "report_date", "primary_document")
    return (
        candidates.groupBy("request_id")
        .agg(F.max_by(chosen, preference).alias("filing"))
        .select("request_id", "filing.*")
    )


def fetch_results(requests: DataFrame, companies: DataFrame, filings: DataFrame) -> DataFrame:
    """Outcome of every request: success, or the reason it failed."""
    known = requests.join(companies, "company", "left")
    found = select_filings(
        known.filter("form is not null and cik is not null").select(
            F.col("document_name").alias("request_id"), "cik", "form", "fiscal_year", "quarter"
        ),
        filings,
    ).withColumnRenamed("request_id", "document_name")
    reason = (
        F.when(F.col("form").isNull(), "not_an_sec_filing: no such form")
        .when(F.col("cik").isNull(), F.concat(F.lit("unknown_company: "), F.col("company")))
        .when(
            F.col("accession_number").isNull(),
            F.concat_ws(" ", F.lit("filing_not_found:"), "form", "fiscal_year"),
        )
        .when(
            F.coalesce("primary_document", F.lit("")) == "",
            F.concat(F.lit("no_primary_document: "), F.col("accession_number")),
        )
    )
    return known.join(found, "document_name", "left").select(
        "document_name", reason.isNull().alias("succeeded"), reason.alias("reason")
    )


def coverage(results: DataFrame) -> DataFrame:
    return results.agg(
        F.count(F.lit(1)).alias("n_requested"),
        F.count_if("succeeded").alias("n_obtained"),
        F.round(F.coalesce(F.avg(F.col("succeeded").cast("int")), F.lit(0.0)), 4).alias("coverage"),
    )


def failure_reasons(results: DataFrame) -> DataFrame:
    prefix = F.substring_index(F.coalesce("reason", F.lit("unknown")), ":", 1)
    return (
        results.filter("not succeeded")
        .groupBy(prefix.alias("reason"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
