"""Queries over question loading, validation, splits, filings and sampling."""

from __future__ import annotations


from pyspark.sql import functions as F

from assayer import vocabulary as v
from assayer.functions.hashing import uniform_sql
from assayer.operators import cache, datasets, filings
from assayer.plans import roles
from assayer.plans.registry import plan
from assayer.functions import answers
from assayer.session import new_folder
from assayer.sources import lines, responses, splits
from assayer.sources.tables import evidence_pages, file_checksums, parse_questions, table


#: Declared sizes of the subset of documents and of queries.
SUBSET_DOCUMENTS, SUBSET_QUERIES = 20_000, 1_000


def questions(spark, folder):
    return parse_questions(roles.filing_lines(spark, folder))[0]


@plan(
    "question_scan",
    f"""WITH {roles.FILING_SQL}
    SELECT line_no, question_id, question_text, group_key, reference_answer,
           array_to_string(reference_evidence, ',') AS reference_evidence, CASE WHEN doc_name = '' THEN 0 ELSE 1 END AS n_documents
    FROM filing_questions""",
)
def question_scan(spark, folder):
    parsed, _ = parse_questions(roles.filing_lines(spark, folder))
    # The line number is not part of a question; it is read back from the link.
    return parsed.select(
        F.regexp_extract("doc_link", r"(\d+)$", 1).cast("bigint").alias("line_no"),
        "question_id",
        "question_text",
        "group_key",
        "reference_answer",
        F.array_join("reference_evidence", ",").alias("reference_evidence"),
        F.size("document_ids").alias("n_documents"),
    )


@plan(
    "question_failures",
    f"""WITH {roles.FILING_SQL}
    SELECT o_orderkey AS line_no, CASE WHEN broken THEN 'invalid JSON' ELSE 'row has no identifier' END AS reason
    FROM filing_rows WHERE broken OR identifier IS NULL""",
)
def question_failures(spark, folder):
    return parse_questions(roles.filing_lines(spark, folder))[1].select("line_no", "reason")


@plan(
    "question_file_failures",
    f"""WITH {roles.FILING_SQL},
    numbered AS (SELECT *, o_orderkey // 4096 AS part, row_number() OVER (PARTITION BY o_orderkey // 4096 ORDER BY o_orderkey) AS line_number FROM filing_rows)
    SELECT CAST(part AS INTEGER) AS part, line_number, 'line ' || line_number || ': ' ||
      CASE WHEN broken THEN 'invalid JSON' ELSE 'row has no identifier' END AS message
    FROM numbered WHERE broken OR identifier IS NULL""",
)
def question_file_failures(spark, folder):
    """Question lines written to files, read back, and what cannot be parsed with its line."""
    path = new_folder(spark, "question-lines")
    rows = roles.filing_lines(spark, folder).withColumn("part", F.expr("line_no div 4096"))
    rows.repartition("part").sortWithinPartitions("part", "line_no").select("part", "line").write.partitionBy(
        "part"
    ).text(path)
    failures = lines.load_questions(spark, path)[1]
    return failures.select(F.col("part").cast("int").alias("part"), "line_number", "message")


@plan(
    "source_checksums",
    """WITH f AS (SELECT c_nationkey, string_agg(c_name, chr(10) ORDER BY c_custkey) || chr(10) AS content FROM customer GROUP BY ALL)
    SELECT c_nationkey AS part, strlen(content) AS length, 'sha256:' || sha256(content) AS checksum FROM f""",
)
def source_checksums(spark, folder):
    """Checksums of files that hold each nation's customers."""
    path = new_folder(spark, "checksummed")
    names = table(spark, folder, "customer").select("c_nationkey", "c_custkey", "c_name")
    names.repartition("c_nationkey").sortWithinPartitions("c_nationkey", "c_custkey").select(
        F.col("c_nationkey").alias("part"), "c_name"
    ).write.partitionBy("part").text(path)
    part = F.regexp_extract("path", r"part=(\d+)/", 1).cast("int")
    return file_checksums(spark, path).select(part.alias("part"), "length", "checksum")


@plan(
    "evidence_pages",
    f"""WITH {roles.FILING_SQL},
    cited AS (SELECT line_no, doc_name AS document_id, CAST(line_no % 40 AS INTEGER) AS page_number
              FROM filing_questions WHERE line_no % 13 <> 0 AND doc_name <> '')
    SELECT document_id, page_number, 'Page text of order ' || min(line_no) AS text FROM cited GROUP BY ALL""",
)
def evidence_pages_plan(spark, folder):
    ordered = questions(spark, folder).withColumn(
        "line_no", F.regexp_extract("doc_link", r"(\d+)$", 1).cast("bigint")
    )
    return evidence_pages(ordered, "line_no")


ISSUES_SQL = f"""{roles.FILING_SQL},
    copies AS (SELECT question_id, count(*) AS n FROM filing_questions GROUP BY ALL),
    issues AS (
      SELECT question_id, unnest(list_filter([CASE WHEN n > 1 THEN 'duplicate_question_id' END,
        CASE WHEN question_text = '' THEN 'empty_question_text' END,
        CASE WHEN coalesce(group_key, '') = '' THEN 'missing_group_key' END,
        CASE WHEN doc_name = '' THEN 'no_document_ids' END,
        CASE WHEN reference_answer IS NULL THEN 'missing_reference_answer' END,
        CASE WHEN len(reference_evidence) = 0 THEN 'missing_reference_evidence' END], lambda c: c IS NOT NULL)) AS code
      FROM filing_questions JOIN copies USING (question_id))"""


@plan("validation_issues", f"WITH {ISSUES_SQL} SELECT question_id, code FROM issues")
def validation_issues(spark, folder):
    return datasets.validation_issues(questions(spark, folder))


@plan(
    "validation_counts",
    f"""WITH {ISSUES_SQL} SELECT code, count(*) AS n_issues, count(DISTINCT question_id) AS n_questions FROM issues GROUP BY ALL""",
)
def validation_counts(spark, folder):
    return datasets.validation_counts(datasets.validation_issues(questions(spark, folder)))


@plan(
    "valid_questions",
    f"""WITH {ISSUES_SQL} SELECT question_id, group_key FROM filing_questions
    WHERE question_id NOT IN (SELECT question_id FROM issues)""",
)
def valid_questions(spark, folder):
    parsed = questions(spark, folder)
    return datasets.valid_questions(parsed, datasets.validation_issues(parsed)).select(
        "question_id", "group_key"
    )


@plan(
    "excluded_questions",
    f"WITH {ISSUES_SQL} SELECT count(DISTINCT question_id) AS n_excluded FROM issues",
)
def excluded_questions(spark, folder):
    return datasets.excluded_count(datasets.validation_issues(questions(spark, folder)))


def customers(spark, folder):
    return table(spark, folder, "customer").select(
        F.concat(F.lit("c"), "c_custkey").alias("question_id"),
        F.concat(F.lit("NATION_"), "c_nationkey").alias("group_key"),
    )


def _split_sql() -> str:
    place = uniform_sql("CAST('0x' || substr(md5(group_key), 1, 15) AS BIGINT)", str(v.DEFAULT_SEED % 10_000))
    room = {s: f"{f}::DOUBLE * (SELECT count(*) FROM customer)" for s, f in v.SPLIT_FRACTIONS.items()}
    pick = (
        "CASE WHEN validation >= test AND validation >= dev THEN 'validation'"
        " WHEN test >= dev THEN 'test' ELSE 'dev' END"
    )
    return f"""
    sizes AS (SELECT 'NATION_' || c_nationkey AS group_key, count(*) AS n FROM customer GROUP BY ALL),
    ordered AS (SELECT group_key, n, row_number() OVER (ORDER BY n DESC, {place}, group_key) AS i,
                row_number() OVER (PARTITION BY n ORDER BY {place}, group_key) AS rank FROM sizes),
    steps AS (
      SELECT 0::BIGINT AS i, CAST(NULL AS VARCHAR) AS group_key, CAST(NULL AS VARCHAR) AS split,
             {room["dev"]} AS dev, {room["test"]} AS test, {room["validation"]} AS validation
      UNION ALL
      SELECT o.i, o.group_key, {pick},
             dev - CASE WHEN {pick} = 'dev' THEN n ELSE 0 END, test - CASE WHEN {pick} = 'test' THEN n ELSE 0 END,
             validation - CASE WHEN {pick} = 'validation' THEN n ELSE 0 END
      FROM steps JOIN ordered o ON o.i = steps.i + 1),
    taken AS (SELECT n, split, sum(count(*)) OVER (PARTITION BY n ORDER BY split) AS last, count(*) AS m
              FROM steps JOIN ordered USING (group_key) GROUP BY n, split),
    dealt AS (SELECT group_key, split FROM ordered o JOIN taken t ON o.n = t.n AND o.rank <= t.last AND o.rank > t.last - t.m)"""


@plan(
    "grouped_split",
    f"""WITH RECURSIVE {_split_sql()}
    SELECT 'c' || c_custkey AS question_id, group_key, split FROM customer
    JOIN dealt ON group_key = 'NATION_' || c_nationkey""",
)
def grouped_split(spark, folder):
    return datasets.grouped_split(customers(spark, folder)).select(
        "question_id", "group_key", "split"
    )


@plan(
    "split_counts",
    f"""WITH RECURSIVE {_split_sql()}
    SELECT split, count(*) AS n_questions, count(DISTINCT group_key) AS n_groups FROM customer
    JOIN dealt ON group_key = 'NATION_' || c_nationkey GROUP BY split""",
)
def split_counts(spark, folder):
    return datasets.split_counts(datasets.grouped_split(customers(spark, folder)))


def frozen(spark, folder):
    """A split frozen to files, by its folder."""
    path = new_folder(spark, "frozen-split")
    dealt = datasets.grouped_split(customers(spark, folder))
    splits.write_frozen(dealt, path, "customers", "1", "group_key", v.DEFAULT_SEED)
    return path


@plan(
    "frozen_split",
    f"""WITH RECURSIVE {_split_sql()}
    SELECT 'question' AS kind, 'c' || c_custkey AS name, split FROM customer JOIN dealt ON group_key = 'NATION_' || c_nationkey
    UNION ALL SELECT DISTINCT 'group', group_key, split FROM customer JOIN dealt ON group_key = 'NATION_' || c_nationkey""",
)
def frozen_split(spark, folder):
    path = f"{frozen(spark, folder)}/shards"
    asked = splits.read_questions(spark, path).select(
        F.lit("question").alias("kind"), F.col("question_id").alias("name"), "split"
    )
    groups = splits.read_groups(spark, path)
    return asked.unionByName(groups.select(F.lit("group").alias("kind"), F.col("group_key").alias("name"), "split"))


@plan(
    "frozen_split_header",
    f"""WITH RECURSIVE {_split_sql()}
    SELECT 'customers' AS dataset, CAST({v.DEFAULT_SEED} AS BIGINT) AS seed, split, count(*) AS n_questions, count(DISTINCT group_key) AS n_groups
    FROM customer JOIN dealt ON group_key = 'NATION_' || c_nationkey GROUP BY split""",
)
def frozen_split_header(spark, folder):
    header = splits.read_header(spark, frozen(spark, folder))
    return header.select("dataset", "seed", "group_counts", F.explode("counts").alias("split", "n_questions")).select(
        "dataset", "seed", "split", "n_questions", F.try_element_at("group_counts", F.col("split")).alias("n_groups")
    )


@plan(
    "leaking_groups",
    """WITH a AS (SELECT 'NATION_' || c_nationkey AS group_key,
        CASE WHEN c_nationkey % 3 = 0 AND c_custkey % 2 = 0 THEN 'test' WHEN c_nationkey % 3 = 0 THEN 'validation' ELSE 'dev' END AS split FROM customer)
    SELECT group_key, count(DISTINCT split) AS n_splits, string_agg(DISTINCT split, ',' ORDER BY split) AS splits
    FROM a GROUP BY group_key HAVING count(DISTINCT split) > 1""",
)
def leaking_groups(spark, folder):
    """Checks an assignment that splits every third nation by customer parity."""
    nation, key = F.col("c_nationkey"), F.col("c_custkey")
    split = (
        F.when((nation % 3 == 0) & (key % 2 == 0), "test")
        .when(nation % 3 == 0, "validation")
        .otherwise("dev")
    )
    assigned = table(spark, folder, "customer").select(
        F.concat(F.lit("NATION_"), nation).alias("group_key"), split.alias("split")
    )
    return datasets.leaking_groups(assigned)


@plan(
    "split_reconcile",
    """WITH cur AS (SELECT 'c' || c_custkey AS id FROM customer),
    frozen AS (SELECT 'c' || (c_custkey + CASE WHEN c_acctbal < 0 THEN 1000000 ELSE 0 END) AS id FROM customer WHERE c_custkey % 10 <> 3)
    SELECT id AS question_id, 'missing' AS problem FROM cur WHERE id NOT IN (SELECT id FROM frozen)
    UNION ALL SELECT id, 'stale' FROM frozen WHERE id NOT IN (SELECT id FROM cur)""",
)
def split_reconcile(spark, folder):
    rows = table(spark, folder, "customer")
    moved = F.col("c_custkey") + F.when(F.col("c_acctbal") < 0, 1000000).otherwise(0)
    frozen = rows.filter(F.col("c_custkey") % 10 != 3).select(
        F.concat(F.lit("c"), moved).alias("question_id")
    )
    return datasets.reconcile(customers(spark, folder), frozen)


PLAN_SQL = f"""{roles.FILING_SQL},
    requests AS (
      SELECT doc_name AS document_name, min_by(company, line_no) AS company,
             CAST(any_value(substr(split_part(doc_name, '_', 2), 1, 4)) AS INTEGER) AS fiscal_year,
             any_value(CASE WHEN contains(split_part(doc_name, '_', 2), 'Q') THEN 'Q' || split_part(split_part(doc_name, '_', 2), 'Q', 2) END) AS quarter,
             any_value(CASE split_part(doc_name, '_', 3) WHEN '10K' THEN '10-K' WHEN '10Q' THEN '10-Q' WHEN '8K' THEN '8-K' END) AS form
      FROM filing_questions WHERE doc_name <> '' GROUP BY doc_name)"""


def fetch_requests(spark, folder):
    rows = questions(spark, folder).withColumn(
        "line_no", F.regexp_extract("doc_link", r"(\d+)$", 1).cast("bigint")
    )
    return filings.fetch_plan(rows, "line_no")


@plan("fetch_plan", f"WITH {PLAN_SQL} SELECT document_name, company, fiscal_year, quarter, form FROM requests")
def fetch_plan(spark, folder):
    return fetch_requests(spark, folder).drop("doc_link")


def companies(spark, folder):
    """Reviewed company map: suppliers below 40 name the known companies."""
    key = F.col("s_suppkey") % 50
    return (
        table(spark, folder, "supplier")
        .select(F.concat(F.lit("CO"), key).alias("company"), key.alias("cik"))
        .distinct()
        .filter(F.col("cik") < 40)
    )


RESULTS_SQL = f"""{PLAN_SQL},
    ciks AS (SELECT DISTINCT 'CO' || (s_suppkey % 50) AS company, s_suppkey % 50 AS cik FROM supplier WHERE s_suppkey % 50 < 40),
    idx AS (
      SELECT l_suppkey % 50 AS cik, CASE l_linenumber % 3 WHEN 0 THEN '10-K' WHEN 1 THEN '10-Q' ELSE '8-K' END AS form,
             l_orderkey || '-' || l_linenumber || '-' || l_partkey AS accession_number, strftime(l_shipdate, '%Y-%m-%d') AS report_date,
             CASE WHEN l_quantity = 1 THEN '' ELSE 'main.htm' END AS primary_document, l_returnflag = 'N' AS is_recent,
             CAST(year(l_shipdate) AS INTEGER) AS fiscal_year, month(l_shipdate) AS m FROM lineitem),
    known AS (SELECT r.*, cik FROM requests r LEFT JOIN ciks USING (company)),
    candidates AS (
      SELECT document_name, idx.*, CASE WHEN (quarter = 'Q1' AND m IN (1, 2, 3, 4)) OR (quarter = 'Q2' AND m IN (4, 5, 6, 7))
          OR (quarter = 'Q3' AND m IN (7, 8, 9, 10)) OR (quarter = 'Q4' AND m IN (10, 11, 12, 1)) THEN 1 ELSE 0 END AS narrowed
      FROM known JOIN idx ON known.cik = idx.cik AND known.form = idx.form AND known.fiscal_year = idx.fiscal_year),
    chosen AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY document_name
        ORDER BY is_recent DESC, narrowed DESC, report_date DESC, accession_number DESC) AS rn FROM candidates) WHERE rn = 1),
    results AS (
      SELECT k.document_name, CASE WHEN k.form IS NULL THEN 'not_an_sec_filing' WHEN k.cik IS NULL THEN 'unknown_company'
        WHEN accession_number IS NULL THEN 'filing_not_found' WHEN primary_document = '' THEN 'no_primary_document' END AS reason
      FROM known k LEFT JOIN chosen c ON c.document_name = k.document_name)"""


@plan(
    "filing_selection",
    f"WITH {RESULTS_SQL} SELECT document_name AS request_id, accession_number, report_date, primary_document FROM chosen",
)
def filing_selection(spark, folder):
    known = fetch_requests(spark, folder).join(companies(spark, folder), "company")
    return filings.select_filings(
        known.filter("form is not null").select(
            F.col("document_name").alias("request_id"), "cik", "form", "fiscal_year", "quarter"
        ),
        roles.filing_index(spark, folder),
    )


def older_pages(spark, folder):
    """Two-year pages of what the recent index no longer lists; every seventh is undated."""
    year = F.year("report_date")
    index = roles.filing_index(spark, folder).filter("not is_recent")
    pages = index.groupBy("cik", F.floor(year / 2).alias("number")).agg(
        F.min("report_date").alias("filed_from"), F.max("report_date").alias("filed_to")
    )
    dated = F.col("cik") % 7 != 0
    return pages.select(
        "cik",
        F.concat_ws("-", F.lit("page"), "cik", "number").alias("page_name"),
        F.when(dated, F.col("filed_from")).alias("filed_from"),
        F.col("filed_to"),
    )


@plan(
    "older_filing_pages",
    f"""WITH {RESULTS_SQL}, pages AS (SELECT cik, fiscal_year // 2 AS number, CASE WHEN cik % 7 <> 0 THEN min(fiscal_year) END AS first, max(fiscal_year) AS last
      FROM idx WHERE NOT is_recent GROUP BY cik, fiscal_year // 2)
    SELECT document_name, 'page-' || p.cik || '-' || number AS page_name FROM known k JOIN pages p ON p.cik = k.cik
    WHERE first IS NULL OR (last >= fiscal_year AND first <= fiscal_year + 2)""",
)
def older_filing_pages(spark, folder):
    known = fetch_requests(spark, folder).join(companies(spark, folder), "company")
    return filings.pages_to_read(known, older_pages(spark, folder))


@plan(
    "filing_blocks",
    """SELECT l_suppkey % 50 AS cik, l_orderkey % 2 = 0 AS is_recent, CASE l_linenumber % 3 WHEN 0 THEN '10-K' WHEN 1 THEN '10-Q' ELSE '8-K' END AS form,
      l_orderkey || '-' || l_linenumber AS accession_number, strftime(l_shipdate + INTERVAL 30 DAY, '%Y-%m-%d') AS filing_date,
      strftime(l_shipdate, '%Y-%m-%d') AS report_date, 'main.htm' AS primary_document FROM lineitem""",
)
def filing_blocks(spark, folder):
    """Parallel arrays, as index files hold them, read into rows; an order's lines are a block."""
    forms = F.array(*map(F.lit, ("10-K", "10-Q", "8-K")))
    line = F.struct(
        F.col("l_linenumber"),
        F.get(forms, F.col("l_linenumber") % 3).alias("form"),
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("accession_number"),
        F.date_format(F.date_add("l_shipdate", 30), "yyyy-MM-dd").alias("filing_date"),
        F.date_format("l_shipdate", "yyyy-MM-dd").alias("report_date"),
        F.lit("main.htm").alias("primary_document"),
    )
    columns = ("form", "accession_number", "filing_date", "report_date", "primary_document")
    blocks = (
        table(spark, folder, "lineitem")
        .groupBy("l_orderkey", (F.col("l_suppkey") % 50).alias("cik"))
        .agg(F.sort_array(F.collect_list(line)).alias("lines"))
        .select(
            "cik",
            (F.col("l_orderkey") % 2 == 0).alias("is_recent"),
            *[F.col(f"lines.{c}").alias(c) for c in columns],
        )
    )
    return filings.filings_from_blocks(blocks)


def fetch_results(spark, folder):
    return filings.fetch_results(
        fetch_requests(spark, folder), companies(spark, folder), roles.filing_index(spark, folder)
    )


@plan(
    "corpus_coverage",
    f"""WITH {RESULTS_SQL} SELECT count(*) AS n_requested, count(*) FILTER (reason IS NULL) AS n_obtained,
      round(avg(CASE WHEN reason IS NULL THEN 1 ELSE 0 END), 4) AS coverage FROM results""",
)
def corpus_coverage(spark, folder):
    return filings.coverage(fetch_results(spark, folder))


@plan(
    "failure_reasons",
    f"WITH {RESULTS_SQL} SELECT reason, count(*) AS n FROM results WHERE reason IS NOT NULL GROUP BY ALL",
)
def failure_reasons(spark, folder):
    return filings.failure_reasons(fetch_results(spark, folder))


_SEED = str(v.DEFAULT_SEED % 10_000)


@plan(
    "stratified_sample",
    f"""WITH r AS (SELECT l.doc_id, quality, toxic, lang, row_number() OVER (PARTITION BY quality, toxic, lang
        ORDER BY {uniform_sql("l.doc_id", _SEED)}, l.doc_id) AS pick FROM labels l JOIN documents USING (doc_id))
    SELECT doc_id, quality, toxic, lang, CAST(pick AS INTEGER) AS pick FROM r WHERE pick <= 10""",
)
def stratified_sample(spark, folder):
    rows = table(spark, folder, "labels").join(
        table(spark, folder, "documents").select("doc_id", "lang"), "doc_id"
    )
    return datasets.stratified_sample(rows, "doc_id", ["quality", "toxic", "lang"], 10)


@plan(
    "subset_sample",
    f"SELECT doc_id FROM documents ORDER BY {uniform_sql('doc_id', _SEED)}, doc_id LIMIT {SUBSET_DOCUMENTS}",
)
def subset_sample(spark, folder):
    return datasets.hash_sample(
        table(spark, folder, "documents").select("doc_id"), "doc_id", SUBSET_DOCUMENTS
    )


@plan(
    "subset_queries",
    f"SELECT item_id FROM benchmark ORDER BY {uniform_sql('item_id', _SEED)}, item_id LIMIT {SUBSET_QUERIES}",
)
def subset_queries(spark, folder):
    return datasets.hash_sample(
        table(spark, folder, "benchmark").select("item_id"), "item_id", SUBSET_QUERIES
    )


def requests(spark, folder):
    """Generation requests of conversations, keyed by their content."""
    turns = table(spark, folder, "conversations")
    key = answers.request_key(
        system=F.col("role"),
        user=F.col("text"),
        deployment_ref=F.lit("chat"),
        prompt_version=F.lit("direct_v1"),
        temperature=F.lit(0.0),
        max_output_tokens=F.lit(512),
        seed=F.lit(None).cast("bigint"),
    )
    return turns.select("conv_id", "turn", "role", key.alias("cache_key"))


@plan(
    "cache_stats",
    """WITH cached AS (SELECT DISTINCT role, text FROM conversations WHERE turn < 2)
    SELECT count(*) FILTER (c.role IS NOT NULL) AS hits, count(*) FILTER (c.role IS NULL) AS misses,
      round(avg(CASE WHEN c.role IS NULL THEN 0 ELSE 1 END), 4) AS hit_rate
    FROM conversations v LEFT JOIN cached c ON c.role = v.role AND c.text = v.text""",
)
def cache_stats(spark, folder):
    """Opening turns were cached by an earlier run."""
    asked = requests(spark, folder)
    cached = asked.filter("turn < 2").select("cache_key").distinct()
    return cache.stats(cache.lookup(asked, cached))


@plan(
    "cache_misses",
    """SELECT conv_id, turn FROM conversations v WHERE NOT EXISTS (
      SELECT 1 FROM conversations c WHERE c.turn < 2 AND c.role = v.role AND c.text = v.text)""",
)
def cache_misses(spark, folder):
    asked = requests(spark, folder)
    cached = asked.filter("turn < 2").select("cache_key").distinct()
    return cache.misses(asked, cached).select("conv_id", "turn")


@plan(
    "storable_responses",
    """SELECT conv_id, turn, finish_reason, substr(sha256(text), 1, 2) AS shard FROM (
      SELECT *, CASE turn % 4 WHEN 0 THEN 'stop' WHEN 1 THEN 'length' WHEN 2 THEN NULL ELSE 'tool' END AS finish_reason FROM conversations)
    WHERE finish_reason IS NULL OR finish_reason <> 'length'""",
)
def storable_responses(spark, folder):
    """Responses that may be cached; those cut at the token limit may not."""
    reasons = F.array(F.lit("stop"), F.lit("length"), F.lit(None), F.lit("tool"))
    responses = table(spark, folder, "conversations").select(
        "conv_id",
        "turn",
        F.get(reasons, F.col("turn") % 4).alias("finish_reason"),
        F.sha2("text", 256).alias("cache_key"),
    )
    return cache.storable(responses).select("conv_id", "turn", "finish_reason", "shard")


def _responses(spark, folder):
    reasons = F.array(F.lit("stop"), F.lit("length"), F.lit(None), F.lit("tool"))
    return table(spark, folder, "conversations").select(
        F.sha2("text", 256).alias("cache_key"),
        "conv_id",
        "turn",
        F.get(reasons, F.col("turn") % 4).alias("finish_reason"),
    )


@plan(
    "stored_responses",
    """WITH r AS (SELECT sha256(text) AS cache_key, conv_id, turn, CASE WHEN turn < 2 THEN 1 ELSE 2 END AS seq FROM conversations WHERE turn % 4 <> 1),
    f AS (SELECT *, row_number() OVER (PARTITION BY cache_key ORDER BY seq, conv_id, turn) AS pick FROM r)
    SELECT cache_key, substr(cache_key, 1, 2) AS shard, CAST(seq AS BIGINT) AS sequence, conv_id, turn,
      CASE turn % 4 WHEN 0 THEN 'stop' WHEN 3 THEN 'tool' END AS finish_reason FROM f WHERE pick = 1""",
)
def stored_responses(spark, folder):
    """Opening turns are stored first, then all turns; a third insert finds nothing new."""
    path = new_folder(spark, "responses")
    given = _responses(spark, folder)
    responses.insert(given.where("turn < 2"), path, "conv_id", "turn")
    responses.insert(given, path, "conv_id", "turn")
    responses.insert(given, path, "conv_id", "turn")
    return responses.read(spark, path).select(
        "cache_key", "shard", "sequence", "conv_id", "turn", "finish_reason"
    )
