"""Queries over text functions, chunks and evidence references."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayer.functions import answers
from assayer.functions import text as tx
from assayer.operators import chunking, features, filings
from assayer.operators.evidence import resolve
from assayer.plans import roles
from assayer.plans.registry import plan
from assayer.sources import tables
from assayer.sources.tables import table

SETTINGS = chunking.ChunkSettings(size_tokens=128, overlap_tokens=32)


@plan(
    "token_stats",
    f"""WITH {roles.DOC_ROWS_SQL}, {roles.terms_sql("t", "doc_rows", "chunk_id", "text")}
    SELECT chunk_id, coalesce(n_terms, 0) AS n_terms, coalesce(n_distinct, 0) AS n_distinct,
           coalesce(n_numeric, 0) AS n_numeric
    FROM doc_rows LEFT JOIN (
      SELECT id AS chunk_id, count(*) AS n_terms, count(DISTINCT term) AS n_distinct,
             count(*) FILTER (regexp_matches(term, '[0-9]')) AS n_numeric
      FROM t GROUP BY ALL) USING (chunk_id)""",
)
def token_stats(spark, folder):
    terms = roles.corpus(spark, folder).select("chunk_id", tx.tokens(F.col("text")).alias("terms"))
    return terms.select(
        "chunk_id",
        F.size("terms").cast("bigint").alias("n_terms"),
        F.size(F.array_distinct("terms")).cast("bigint").alias("n_distinct"),
        F.size(F.filter("terms", tx.has_digits)).cast("bigint").alias("n_numeric"),
    )


@plan(
    "text_profile",
    r"""SELECT doc_id, greatest(1, length(text) // 4) AS token_estimate,
       regexp_matches(text, '[0-9]') AS has_digits,
       len(list_filter(string_split_regex(text, '\n\s*\n'), lambda p: trim(p, E' \n\t\r') <> '')) AS n_paragraphs,
       len(list_filter(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(31), 'g'), chr(31)),
           lambda s: trim(s, E' \n\t\r') <> '')) AS n_sentences
    FROM documents""",
)
def text_profile(spark, folder):
    text = F.col("text")
    return table(spark, folder, "documents").select(
        "doc_id",
        tx.estimate_tokens(text).cast("bigint").alias("token_estimate"),
        tx.has_digits(text).alias("has_digits"),
        F.size(tx.paragraphs(text)).cast("bigint").alias("n_paragraphs"),
        F.size(tx.sentences(text)).cast("bigint").alias("n_sentences"),
    )


_FORMS = {
    "plain": "CAST(v AS {t})",
    "accounting": "concat('(', CAST(v % 10000 AS {t}), ')')",
    "currency": "concat('$', CAST(v % 10000 AS {t}), '.', CAST(v % 7 AS {t}), '0')",
    "percent": "concat(CAST(v % 100 AS {t}), '.50%')",
}


@plan(
    "number_variants",
    f"""WITH s AS (SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) AS v FROM orders),
    f AS ({" UNION ALL ".join(f"SELECT o_orderkey, '{n}' AS form, {e.format(t='VARCHAR')} AS surface FROM s" for n, e in _FORMS.items())})
    SELECT o_orderkey, form, surface, {roles.number_sql("surface")} AS normalized FROM f""",
)
def number_variants(spark, folder):
    rows = table(spark, folder, "orders").select(
        "o_orderkey", F.floor("o_totalprice").cast("bigint").alias("v")
    )
    forms = F.array(
        *[
            F.struct(F.lit(n).alias("form"), F.expr(e.format(t="string")).alias("surface"))
            for n, e in _FORMS.items()
        ]
    )
    return rows.select("o_orderkey", F.inline(forms)).select(
        "o_orderkey", "form", "surface", tx.normalize_number(F.col("surface")).alias("normalized")
    )


@plan(
    "extracted_numbers",
    f"""WITH {roles.OUTCOMES_SQL}, n AS (
      SELECT question_id, action_id, {roles.numbers_sql("reference_answer")} AS expected,
             {roles.numbers_sql("answer")} AS actual FROM outcomes)
    SELECT question_id, action_id, len(expected) AS n_expected, expected[1] AS first_expected,
           len(actual) AS n_actual, round(coalesce(list_sum(actual), 0), 2) AS actual_sum FROM n""",
)
def extracted_numbers(spark, folder):
    rows = roles.outcomes(spark, folder).select(
        "question_id",
        "action_id",
        tx.numbers(F.col("reference_answer")).alias("expected"),
        tx.numbers(F.col("answer")).alias("actual"),
    )
    total = F.aggregate("actual", F.lit(0.0), lambda a, b: a + b)
    return rows.select(
        "question_id",
        "action_id",
        F.size("expected").cast("bigint").alias("n_expected"),
        F.get("expected", F.lit(0)).alias("first_expected"),
        F.size("actual").cast("bigint").alias("n_actual"),
        F.round(total, 2).alias("actual_sum"),
    )


@plan(
    "parsed_references",
    """WITH r AS (
      SELECT l_orderkey, l_linenumber, CASE l_linenumber % 4
        WHEN 0 THEN 'DOC' || l_partkey || '::p' || l_suppkey WHEN 1 THEN ' DOC::x' || l_partkey || '::p? '
        WHEN 2 THEN 'DOC' || l_partkey || '::q' || l_suppkey ELSE 'DOC' || l_partkey || 'p' || l_suppkey END AS reference
      FROM lineitem)
    SELECT l_orderkey, l_linenumber,
      CASE WHEN l_linenumber % 4 < 2 THEN regexp_extract(trim(reference), '^(.+)::p([0-9]+|[?])$', 1) END AS document_id,
      CASE WHEN l_linenumber % 4 = 0 THEN CAST(regexp_extract(trim(reference), '^(.+)::p([0-9]+|[?])$', 2) AS INTEGER) ELSE -1 END AS page_number,
      l_linenumber % 4 >= 2 AS malformed FROM r""",
)
def parsed_references(spark, folder):
    kind = F.col("l_linenumber") % 4
    doc = F.concat(F.lit("DOC"), F.col("l_partkey"))
    reference = (
        F.when(kind == 0, tx.evidence_reference(doc, F.col("l_suppkey")))
        .when(
            kind == 1,
            F.concat(
                F.lit(" "),
                tx.evidence_reference(F.concat(F.lit("DOC::x"), F.col("l_partkey")), F.lit(None)),
                F.lit(" "),
            ),
        )
        .when(kind == 2, F.concat(doc, F.lit("::q"), F.col("l_suppkey")))
        .otherwise(F.concat(doc, F.lit("p"), F.col("l_suppkey")))
    )
    return table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", tx.parse_reference(reference).alias("p")
    ).select(
        "l_orderkey",
        "l_linenumber",
        "p.document_id",
        F.coalesce("p.page_number", F.lit(-1)).alias("page_number"),
        "p.malformed",
    )


@plan(
    "document_names",
    f"""WITH {roles.FILING_SQL}
    SELECT o_orderkey, doc_name,
      CASE WHEN doc_name <> '' THEN 'CO' || (o_custkey % 50) END AS company,
      CASE WHEN doc_name <> '' THEN CAST(year(o_orderdate) AS INTEGER) ELSE 0 END AS fiscal_year,
      CASE WHEN doc_name <> '' AND o_orderkey % 4 = 1 THEN 'Q' || quarter(o_orderdate) END AS quarter,
      CASE WHEN doc_name <> '' THEN CASE o_orderkey % 4 WHEN 0 THEN '10-K' WHEN 1 THEN '10-Q' WHEN 2 THEN '8-K' END END AS form
    FROM filing_rows""",
)
def document_names(spark, folder):
    name = F.expr(roles._FILING["doc_name"].format(t="string"))
    return (
        table(spark, folder, "orders")
        .select("o_orderkey", name.alias("doc_name"))
        .withColumn("p", filings.parse_document_name(F.col("doc_name")))
        .select(
            "o_orderkey",
            "doc_name",
            "p.company",
            F.coalesce("p.fiscal_year", F.lit(0)).alias("fiscal_year"),
            "p.quarter",
            "p.form",
        )
    )


def chunks(spark, folder, only=None):
    return chunking.chunk_documents(roles.paged_documents(spark, folder, only), SETTINGS)


_SIZE, _OVERLAP, _WIDTH = SETTINGS.size_tokens, SETTINGS.overlap_tokens, SETTINGS.size_tokens * 4
_TRIM = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
CHUNK_SQL = rf"""
    lines AS (
      SELECT 'd' || doc_id AS document_id, i AS page_number, {_TRIM.format("pages[i]")} AS p
      FROM (SELECT doc_id, pages, unnest(range(1, len(pages) + 1)) AS i
            FROM (SELECT doc_id, string_split(text, chr(10)) AS pages FROM documents))),
    sents AS (
      SELECT document_id, page_number, j, {_TRIM.format("parts[j]")} AS s
      FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS j FROM (
        SELECT document_id, page_number,
               CASE WHEN greatest(1, length(p) // 4) <= {_SIZE} THEN [p]
                    ELSE string_split(regexp_replace(p, '([.!?])\s+', '\1' || chr(31), 'g'), chr(31)) END AS parts
        FROM lines WHERE p <> ''))),
    cuts AS (
      SELECT document_id, page_number, j, k, substr(s, k + 1, w) AS text
      FROM (SELECT *, unnest(range(0, length(s), w)) AS k FROM (
        SELECT *, CASE WHEN greatest(1, length(s) // 4) <= {_SIZE} THEN length(s) ELSE {_WIDTH} END AS w
        FROM sents WHERE s <> ''))),
    segs AS (
      SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY page_number, j, k) AS i,
             greatest(1, length(text) // 4) AS tok FROM cuts),
    sums AS (
      SELECT document_id, count(*) AS n, list_prepend(0, list(ps ORDER BY i)) AS ps
      FROM (SELECT document_id, i, sum(tok) OVER (PARTITION BY document_id ORDER BY i)::BIGINT AS ps FROM segs)
      GROUP BY document_id),
    packed AS (
      SELECT document_id, 0 AS ordinal, 1 AS first,
             1 + len(list_filter(ps[3:n + 1], lambda x: x <= {_SIZE})) AS last, n, ps FROM sums
      UNION ALL
      SELECT document_id, ordinal + 1, first2,
             last + 1 + len(list_filter(ps[last + 3:n + 1], lambda x: x - ps[first2] <= {_SIZE})), n, ps
      FROM (SELECT document_id, ordinal, last, n, ps,
              greatest(least(first + len(list_filter(ps[first:last], lambda x: ps[last + 1] - x > {_OVERLAP})), last), first + 1) AS first2
            FROM packed WHERE last < n)),
    chunk_text AS (
      SELECT p.document_id, ordinal, string_agg(text, chr(10) || chr(10) ORDER BY i) AS text,
             list_sort(list_distinct(list(page_number))) AS page_numbers, count(*) AS n_segments
      FROM packed p JOIN segs s ON s.document_id = p.document_id AND s.i BETWEEN p.first AND p.last
      GROUP BY p.document_id, ordinal),
    chunks AS (
      SELECT *, greatest(1, length(text) // 4) AS token_estimate,
        document_id || '::c' || lpad(ordinal::VARCHAR, 4, '0') || '::' ||
        substr(sha256(document_id || chr(0) || ordinal::VARCHAR || chr(0) || trim(regexp_replace(text, '\s+', ' ', 'g'))), 1, 12) AS chunk_id
      FROM chunk_text)"""


@plan(
    "chunk_documents",
    f"""WITH RECURSIVE {CHUNK_SQL}
    SELECT chunk_id, document_id, ordinal, token_estimate, n_segments,
           array_to_string(page_numbers, ',') AS pages FROM chunks""",
)
def chunk_documents(spark, folder):
    return chunks(spark, folder).select(
        "chunk_id",
        "document_id",
        "ordinal",
        "token_estimate",
        F.col("n_segments").cast("bigint").alias("n_segments"),
        F.array_join(F.transform("page_numbers", lambda p: p.cast("string")), ",").alias("pages"),
    )


#: Pages of a document with a table of its facts on the first one, packed after its prose.
_PAGE_CHUNK_SQL = CHUNK_SQL.replace(
    "FROM cuts)",
    """FROM (SELECT * FROM cuts UNION ALL
        SELECT 'd' || doc_id, 1, 1000000, 0, 'field | value' || chr(10) || 'lang | ' || lang || chr(10) || 'n_chars | ' || n_chars FROM documents))""",
)


@plan(
    "page_corpus",
    f"""WITH RECURSIVE {_PAGE_CHUNK_SQL},
    tabled AS (SELECT p.document_id, ordinal, max(CASE WHEN j = 1000000 THEN 1 ELSE 0 END) = 1 AS contains_table
      FROM packed p JOIN segs s ON s.document_id = p.document_id AND s.i BETWEEN p.first AND p.last GROUP BY ALL)
    SELECT chunk_id, document_id, ordinal, token_estimate, n_segments, array_to_string(page_numbers, ',') AS pages,
      contains_table, 'full_documents' AS provenance FROM chunks JOIN tabled USING (document_id, ordinal)""",
)
def page_corpus(spark, folder):
    """Delimited texts to pages with rendered tables, to chunks, past the provenance guard."""
    rows = table(spark, folder, "documents")
    name = F.concat(F.lit("d"), "doc_id").alias("document_id")
    delimited = rows.select(name, F.replace("text", F.lit("\n"), F.lit(tables.PAGE_DELIMITER)).alias("text"))
    facts = F.array(
        F.array(F.lit("field"), F.lit("value")),
        F.array(F.lit("lang"), F.col("lang")),
        F.array(F.lit("n_chars"), F.col("n_chars").cast("string")),
    )
    pages = tables.split_pages(delimited).join(
        rows.select(name, F.lit(1).alias("page_number"), F.array(facts).alias("tables")),
        ["document_id", "page_number"],
        "left",
    )
    none = F.array().cast("array<array<array<string>>>")
    packed = chunking.chunk_pages(pages.withColumn("tables", F.coalesce("tables", none)), SETTINGS)
    stamped = packed.withColumn("provenance", F.lit("full_documents"))
    return chunking.require_reportable(stamped).select(
        "chunk_id",
        "document_id",
        "ordinal",
        "token_estimate",
        F.col("n_segments").cast("bigint").alias("n_segments"),
        F.array_join(F.transform("page_numbers", lambda p: p.cast("string")), ",").alias("pages"),
        "contains_table",
        "provenance",
    )


@plan(
    "corpus_stats",
    f"""WITH RECURSIVE {CHUNK_SQL}
    SELECT count(*) AS n_chunks, count(DISTINCT document_id) AS n_documents,
           CAST(sum(token_estimate) AS BIGINT) AS total_tokens FROM chunks""",
)
def corpus_stats(spark, folder):
    return chunking.corpus_stats(chunks(spark, folder))


@plan(
    "chunk_neighbours",
    f"""WITH RECURSIVE {CHUNK_SQL}
    SELECT a.chunk_id, a.document_id, b.chunk_id AS neighbour_id, b.ordinal AS neighbour_ordinal
    FROM chunks a JOIN chunks b ON a.document_id = b.document_id AND b.ordinal BETWEEN a.ordinal - 2 AND a.ordinal + 1""",
)
def chunk_neighbours(spark, folder):
    return chunking.neighbours(chunks(spark, folder), before=2, after=0)


_REFS_SQL = f"""
    {roles.ITEM_ROWS_SQL},
    {roles.shingle_sql("held", "lines", "document_id, page_number", "p")},
    {roles.shingle_sql("asked", "item_rows", "question_id", "text")},
    refs AS (
      SELECT DISTINCT question_id, document_id, page_number,
             document_id || '::p' || page_number::VARCHAR AS reference
      FROM held JOIN asked USING (shingle))"""


def evidence_references(found):
    """Page references plus, per question, damaged, unknown and open ones."""
    other = F.array(
        F.concat("document_id", F.lit("::p?")),
        F.concat(F.lit("missing-"), "document_id", F.lit("::p1")),
        F.concat("document_id", F.lit("::p999999")),
        F.concat("document_id", F.lit(":p1")),
    )
    extra = found.select("question_id", F.explode(other).alias("reference")).distinct()
    return found.select("question_id", "reference").unionByName(extra)


@plan(
    "evidence_resolution",
    f"""WITH RECURSIVE {CHUNK_SQL}, {_REFS_SQL},
    docs AS (SELECT DISTINCT question_id, document_id FROM refs),
    covering AS (SELECT DISTINCT document_id, unnest(page_numbers) AS page_number, chunk_id FROM chunks)
    SELECT question_id, reference, chunk_id, 'resolved' AS status FROM refs JOIN covering USING (document_id, page_number)
    UNION ALL SELECT question_id, document_id || '::p?', chunk_id, 'unknown_page' FROM docs JOIN chunks USING (document_id)
    UNION ALL SELECT question_id, 'missing-' || document_id || '::p1', NULL, 'unknown_document' FROM docs
    UNION ALL SELECT question_id, document_id || '::p999999', NULL, 'unresolved' FROM docs
    UNION ALL SELECT question_id, document_id || ':p1', NULL, 'unresolved' FROM docs""",
)
def evidence_resolution(spark, folder):
    found = roles.gold_references(spark, folder)
    existing = roles.corpus(spark, folder).select("document_id")
    return resolve(evidence_references(found), chunks(spark, folder, found), existing)


@plan(
    "parse_health",
    """WITH f AS (
      SELECT 'c' || conv_id AS document_id, count(*) AS n_pages,
             CAST(sum(CASE WHEN contains(text, '|') THEN 1 ELSE 0 END) AS BIGINT) AS n_tables,
             count(*) FILTER (trim(text, E' \n\t\r') = '' AND NOT contains(text, '|')) AS n_empty,
             CAST(sum(length(text)) AS BIGINT) AS total_characters
      FROM conversations GROUP BY ALL)
    SELECT *, array_to_string(list_filter([CASE WHEN n_pages = 0 THEN 'zero_pages' END,
        CASE WHEN n_empty > 0.1 * n_pages THEN 'empty_pages' END,
        CASE WHEN n_tables = 0 AND n_pages > 0 THEN 'no_tables' END], lambda w: w IS NOT NULL), ',') AS warnings,
      NOT (n_pages = 0 OR n_empty > 0.1 * n_pages OR (n_tables = 0 AND n_pages > 0)) AS healthy FROM f""",
)
def parse_health(spark, folder):
    pages = table(spark, folder, "conversations").select(
        F.concat(F.lit("c"), "conv_id").alias("document_id"),
        F.col("turn").alias("page_number"),
        "text",
        F.contains("text", F.lit("|")).cast("int").alias("n_tables"),
    )
    return chunking.parse_health(pages)


@plan(
    "answer_overlap",
    f"""WITH pairs AS (
      SELECT a.conv_id, a.turn, a.text AS answer, u.text AS reference FROM conversations a
      JOIN conversations u ON u.conv_id = a.conv_id AND u.turn = a.turn - 1
      WHERE a.role = 'assistant' AND u.role = 'user'),
    k AS (SELECT conv_id * 1000000 + turn AS id, * FROM pairs),
    {roles.terms_sql("ans", "k", "id", "answer")}, {roles.terms_sql("ref", "k", "id", "reference")},
    ac AS (SELECT id, term, count(*) AS n FROM ans GROUP BY ALL), rc AS (SELECT id, term, count(*) AS n FROM ref GROUP BY ALL),
    sizes AS (SELECT id, sum(n) AS n FROM (SELECT * FROM ac UNION ALL SELECT * FROM rc) GROUP BY ALL),
    common AS (SELECT id, sum(least(ac.n, rc.n)) AS c FROM ac JOIN rc USING (id, term) GROUP BY ALL)
    SELECT conv_id, turn,
      CASE WHEN trim(regexp_replace(translate(answer, {roles.AZ}), '\\s+', ' ', 'g')) <> ''
        AND trim(regexp_replace(translate(answer, {roles.AZ}), '\\s+', ' ', 'g'))
          = trim(regexp_replace(translate(reference, {roles.AZ}), '\\s+', ' ', 'g')) THEN 1 ELSE 0 END AS exact_match,
      round(coalesce(2.0::DOUBLE * coalesce(c, 0) / n, 0), 6) AS token_f1
    FROM k LEFT JOIN sizes USING (id) LEFT JOIN common USING (id)""",
)
def answer_overlap(spark, folder):
    turns = table(spark, folder, "conversations")
    answers_ = turns.filter("role = 'assistant'").select(
        "conv_id", "turn", F.col("text").alias("answer")
    )
    asked = turns.filter("role = 'user'").select(
        "conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("reference_answer")
    )
    return features.answer_metrics(answers_.join(asked, ["conv_id", "turn"]), "conv_id", "turn")


@plan(
    "structured_answers",
    f"""WITH {roles.OUTCOMES_SQL}
    SELECT question_id, action_id,
      coalesce(NOT failed, false) AS parsed,
      CASE WHEN NOT failed THEN answer END AS answer,
      CASE WHEN failed THEN 0 ELSE len(cited_chunk_ids) + len(hallucinated_citations) END AS n_citations,
      CASE WHEN NOT failed THEN confidence END AS confidence,
      CASE WHEN failed THEN false ELSE abstained END AS abstained,
      CASE WHEN NOT failed THEN abstention_reason END AS abstention_reason
    FROM outcomes""",
)
def structured_answers(spark, folder):
    """Responses rendered as JSON in three wrappings, then parsed again."""
    rows = roles.outcomes(spark, folder)
    cited = F.concat("cited_chunk_ids", "hallucinated_citations")
    body = F.to_json(
        F.struct("answer", "abstention_reason", "confidence", cited.alias("citations"))
    )
    fenced = F.concat(F.lit("Sure:\n```json\n"), body, F.lit("\n```"))
    prose = F.concat(F.lit("The answer is "), body, F.lit(" as asked."))
    kind = F.col("question_key") % 3
    raw = (
        F.when(F.col("error_status") != "ok", F.lit("no object here"))
        .when(kind == 0, body)
        .when(kind == 1, fenced)
        .otherwise(prose)
    )
    responses = rows.select("question_id", "action_id", raw.alias("raw"))
    return answers.parse_answers(responses, "raw", "a").select(
        "question_id",
        "action_id",
        "a.parsed",
        "a.answer",
        F.size("a.citations").cast("bigint").alias("n_citations"),
        "a.confidence",
        "a.abstained",
        "a.abstention_reason",
    )


@plan(
    "computed_expressions",
    """SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 5 = 4 THEN NULL ELSE
        round(CASE l_linenumber % 5 WHEN 0 THEN (l_quantity + 1000) * 2 WHEN 1 THEN l_quantity / (1 + l_linenumber)
          WHEN 2 THEN -(l_quantity ** 2) ELSE floor(l_quantity / 7) + l_quantity % 7 END, 6) END AS value,
      CASE WHEN l_linenumber % 5 = 4 THEN 'division_by_zero' END AS error FROM lineitem""",
)
def computed_expressions(spark, folder):
    q = F.col("l_quantity").cast("int").cast("string")
    n = F.col("l_linenumber").cast("string")
    kind = F.col("l_linenumber") % 5
    text = (
        F.when(kind == 0, F.concat(F.lit("("), q, F.lit(" + $1,000) * 2")))
        .when(kind == 1, F.concat(q, F.lit(" / (1 + "), n, F.lit(")")))
        .when(kind == 2, F.concat(F.lit("-("), q, F.lit(" ** 2)")))
        .when(kind == 3, F.concat(q, F.lit(" // 7 + "), q, F.lit(" % 7")))
        .otherwise(F.concat(q, F.lit(" / (1 - 1)")))
    )
    return (
        table(spark, folder, "lineitem")
        .select("l_orderkey", "l_linenumber", answers.arithmetic(text).alias("a"))
        .select("l_orderkey", "l_linenumber", F.round("a.value", 6).alias("value"), "a.error")
    )


@plan(
    "tool_signatures",
    """SELECT event_id, event_type || '(k=' || regexp_extract(props, '"k": ([0-9]+)', 1) || ', label="' || user_id || '", user=' || user_id || ')' AS signature
    FROM events""",
)
def tool_signatures(spark, folder):
    arguments = F.map_concat(
        F.create_map(
            F.lit("user"),
            answers.json_literal(F.col("user_id")),
            F.lit("label"),
            answers.json_literal(F.col("user_id").cast("string")),
        ),
        F.transform_values(F.from_json("props", "map<string,variant>"), lambda _, v: F.to_json(v)),
    )
    return table(spark, folder, "events").select(
        "event_id", answers.call_signature(F.col("event_type"), arguments).alias("signature")
    )

