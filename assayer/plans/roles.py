"""The roles of the evaluation data model, played by the given tables.

Documents are the corpus and benchmark items the questions; orders carry the
outcome matrix and the filing questions, with every derived value an arithmetic
function of the row. Each role is a narrow transform, so it scales with its
table. The ``*_SQL`` strings state the same roles for the SQL twins.
"""

from __future__ import annotations

import itertools
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from assayer import vocabulary as v
from assayer.functions import answers
from assayer.functions.once import with_once
from assayer.functions import text as tx
from assayer.functions import tokens
from assayer.operators import scoring
from assayer.session import fits_broadcast, join_small, spread, stored
from assayer.sources.tables import table

# ---------------------------------------------------------------- text corpus
SHINGLE = 6
SHINGLE_KEY = ["shingle", "shingle_check"]


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spread(table(spark, folder, "documents").select("doc_id", "text"), "doc_id", "text")


def corpus(spark: SparkSession, folder: str) -> DataFrame:
    """One chunk per document."""
    identifier = F.concat(F.lit("d"), F.col("doc_id"))
    return documents(spark, folder).select(
        identifier.alias("chunk_id"),
        identifier.alias("document_id"),
        F.lit(0).alias("ordinal"),
        "text",
    )


def questions(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "benchmark").select(
        F.concat(F.lit("q"), F.col("item_id")).alias("question_id"),
        F.col("text").alias("question_text"),
    )


def paged_documents(
    spark: SparkSession, folder: str, only: DataFrame | None = None
) -> DataFrame:
    """Documents with their lines as numbered pages.

    ``only`` (document_id) restricts the scan before any text is processed.
    """
    pages = F.transform(
        F.split("text", "\n"),
        lambda t, i: F.struct((i + 1).alias("page_number"), t.alias("text")),
    )
    named = documents(spark, folder).select(
        F.concat(F.lit("d"), F.col("doc_id")).alias("document_id"), "text"
    )
    if only is not None:
        named = join_small(named, only.select("document_id").distinct(), "document_id", "left_semi")
    return named.select("document_id", pages.alias("pages"))


def shingled(rows: DataFrame, keys: list[str], text: str) -> DataFrame:
    """Word runs of every row as 96-bit digests; short rows have none."""
    words = tx.tokens(F.col(text), expand_numbers=False, remove_stopwords=False)
    tokenized = with_once(rows.select(*keys, text), "words", words)
    starts = F.when(
        F.size("words") >= SHINGLE, F.sequence(F.lit(1), F.size("words") - SHINGLE + 1)
    ).otherwise(F.array().cast("array<int>"))

    def digest(start: F.Column) -> F.Column:
        run = F.slice("words", start, F.lit(SHINGLE))
        return F.struct(F.xxhash64(run).alias("shingle"), F.hash(run).alias("shingle_check"))

    return tokenized.select(*keys, F.inline(F.transform(starts, digest)))


def gold_documents(spark: SparkSession, folder: str, held: DataFrame | None = None) -> DataFrame:
    """(question_id, chunk_id): documents sharing a run of words with an item.

    Items under the limits of a broadcast are sent to the tasks that read the documents;
    others meet them by digests. The result is read more than once. ``held`` is the corpus,
    if it is at hand.
    """
    held = corpus(spark, folder) if held is None else held
    words = tx.tokens(F.col("question_text"), expand_numbers=False, remove_stopwords=False)
    asked = questions(spark, folder).select("question_id", words.alias("words"))
    if fits_broadcast(asked):
        found = _sharing_runs(held, asked)
    else:
        asked = shingled(questions(spark, folder), ["question_id"], "question_text").distinct()
        found = join_small(shingled(held, ["chunk_id"], "text"), asked, SHINGLE_KEY)
    return stored(found.select("question_id", "chunk_id").distinct(), "gold")


def _sharing_runs(held: DataFrame, asked: DataFrame) -> DataFrame:
    """(question_id, chunk_id) of rows that share a run of ``SHINGLE`` words, which are compared as such."""
    vocabulary: dict[str, int] = {}
    runs: dict[tuple[int, int], set] = {}
    half = SHINGLE // 2
    for question, words in asked.where("words is not null").toPandas().itertuples(index=False):
        first = _packed([vocabulary.setdefault(w, len(vocabulary) + 1) for w in words], half)
        for run in zip(first[:-half].tolist(), first[half:].tolist(), strict=True):
            runs.setdefault(run, set()).add(question)
    heads = np.unique(np.array([head for head, _ in runs], dtype=np.int64))
    shared = held.sparkSession.sparkContext.broadcast((vocabulary, runs, heads))
    kinds = [held.schema["chunk_id"].dataType, asked.schema["question_id"].dataType]
    types = [to_arrow_type(k) for k in kinds]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, runs, heads = shared.value
        unknown = itertools.repeat(0)
        for batch in batches:
            chunks, found = [], []
            for chunk, lowered in zip(batch.column(0), pc.ascii_lower(batch.column(1)), strict=True):
                listed = tokens.words(lowered.as_py() or "")
                first = _packed(list(map(vocabulary.get, listed, unknown)), half)
                # Zero stands for a word that no item has; no run of an item has one.
                head = first[:-half]
                at = np.searchsorted(heads, head)
                at = np.flatnonzero(heads[np.minimum(at, len(heads) - 1)] == head) if len(heads) else at[:0]
                met = {q for run in zip(head[at].tolist(), first[half:][at].tolist(), strict=True) for q in runs.get(run, ())}
                chunks += [chunk.as_py()] * len(met)
                found += met
            yield pa.RecordBatch.from_arrays(
                [pa.array(chunks, types[0]), pa.array(found, types[1])], names=["chunk_id", "question_id"]
            )

    schema = f"chunk_id {kinds[0].simpleString()}, question_id {kinds[1].simpleString()}"
    return held.select("chunk_id", "text").mapInArrow(scan, schema)


def _packed(words: list[int], half: int) -> np.ndarray:
    """Every ``half`` successive word numbers, below 2 ** 21, as one number."""
    numbers = np.array(words, dtype=np.int64)
    starts = max(0, len(numbers) - half + 1)
    packed = np.zeros(starts, dtype=np.int64)
    for i in range(half):
        packed = packed << 21 | numbers[i : i + starts]
    return packed


def gold_references(spark: SparkSession, folder: str) -> DataFrame:
    """(question_id, reference): page references of the passages of every item."""
    pages = paged_documents(spark, folder).select("document_id", F.inline("pages"))
    asked = shingled(questions(spark, folder), ["question_id"], "question_text").distinct()
    held = shingled(pages, ["document_id", "page_number"], "text")
    found = join_small(held, asked, SHINGLE_KEY).select(
        "question_id", "document_id", "page_number"
    ).distinct()
    # A few rows per question, read for the scope and for the references.
    return found.select(
        "question_id",
        "document_id",
        tx.evidence_reference(F.col("document_id"), F.col("page_number")).alias("reference"),
    ).persist(StorageLevel.MEMORY_AND_DISK)


AZ = f"'{string.ascii_uppercase}', '{string.ascii_lowercase}'"
TOKEN_SQL = tx.TOKEN_PATTERN_LOWER.replace("'", "''")
STOP_SQL = ", ".join(f"'{w}'" for w in tx.STOPWORDS)


def number_sql(t: str) -> str:
    inner = (
        f"replace(regexp_replace(regexp_replace({t}, '^[()]+|[()]+$', '', 'g'),"
        f" '^[$€£]+|%+$', '', 'g'), ',', '')"
    )
    plain = f"(CASE WHEN contains({inner}, '.') THEN regexp_replace({inner}, '\\.?0*$', '') ELSE {inner} END)"
    return (
        f"(CASE WHEN starts_with({t}, '(') AND ends_with({t}, ')') AND {plain} <> ''"
        f" THEN '-' || {plain} ELSE {plain} END)"
    )


def terms_sql(name: str, source: str, key: str, text: str) -> str:
    """CTEs ``name`` (id, term) of retrieval terms, number variants included."""
    return f"""
    {name}_raw AS (
      SELECT {key} AS id,
             unnest(regexp_extract_all(translate({text}, {AZ}), '{TOKEN_SQL}')) AS t
      FROM {source}),
    {name}_num AS (
      SELECT id, t, {number_sql("t")} AS nt FROM {name}_raw WHERE regexp_matches(t, '[0-9]')),
    {name} AS (
      SELECT id, t AS term FROM {name}_raw WHERE t NOT IN ({STOP_SQL})
      UNION ALL SELECT id, nt FROM {name}_num WHERE nt <> '' AND nt <> t)"""


DOC_ROWS_SQL = "doc_rows AS (SELECT 'd' || doc_id AS chunk_id, text FROM documents)"
ITEM_ROWS_SQL = "item_rows AS (SELECT 'q' || item_id AS question_id, text FROM benchmark)"


def shingle_sql(name: str, source: str, keys: str, text: str) -> str:
    n = SHINGLE
    return f"""
    {name}_w AS (
      SELECT {keys}, regexp_extract_all(translate({text}, {AZ}), '{TOKEN_SQL}') AS w FROM {source}),
    {name} AS (
      SELECT DISTINCT {keys}, array_to_string(w[i:i+{n - 1}], ' ') AS shingle
      FROM (SELECT {keys}, w, unnest(range(1, len(w) - {n - 2})) AS i FROM {name}_w
            WHERE len(w) >= {n}))"""


GOLD_SQL = f"""
    {DOC_ROWS_SQL}, {ITEM_ROWS_SQL},
    {shingle_sql("held", "doc_rows", "chunk_id", "text")},
    {shingle_sql("asked", "item_rows", "question_id", "text")},
    gold AS (SELECT DISTINCT question_id, chunk_id FROM held JOIN asked USING (shingle))"""

BM25_SQL = f"""
    {DOC_ROWS_SQL}, {ITEM_ROWS_SQL},
    {terms_sql("dt", "doc_rows", "chunk_id", "text")},
    {terms_sql("qt", "item_rows", "question_id", "text")},
    stats AS (
      SELECT (SELECT count(*) FROM doc_rows) AS n,
             (SELECT count(*) FROM dt) / (SELECT count(*) FROM doc_rows) AS mean_len),
    tf AS (SELECT id AS chunk_id, term, count(*) AS tf FROM dt GROUP BY ALL),
    lens AS (SELECT id AS chunk_id, count(*) AS len FROM dt GROUP BY ALL),
    dfs AS (SELECT term, count(*) AS df FROM tf GROUP BY ALL),
    qtf AS (SELECT id AS question_id, term, count(*) AS qtf FROM qt GROUP BY ALL),
    bm25_scores AS (
      SELECT question_id, tf.chunk_id,
             round(sum(qtf * ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE))
                   * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / mean_len))), 6) AS score
      FROM qtf JOIN tf USING (term) JOIN dfs USING (term) JOIN lens ON lens.chunk_id = tf.chunk_id, stats
      GROUP BY ALL),
    bm25_all AS (
      SELECT *, CAST(row_number() OVER (PARTITION BY question_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rank
      FROM bm25_scores WHERE score > 0)"""


# ----------------------------------------------------------- outcome matrix
PRICES = {"small-a": (0.5, 1.5), "large-b": (30.0, 90.0)}
EXPERIMENT = "exp1"

# Row arithmetic shared by Spark and the twins (plain BIGINT expressions).
_X = "(o_orderkey * 7919 + idx * 104729 + o_custkey * 613)"
_SPLIT = (
    "CASE WHEN o_custkey % 20 < 6 THEN 'dev' WHEN o_custkey % 20 < 11 THEN 'validation'"
    " ELSE 'test' END"
)


def _thousands(value: str, duck: bool) -> str:
    if duck:
        return f"((({value}) // 1000)::VARCHAR || ',' || lpad((({value}) % 1000)::VARCHAR, 3, '0'))"
    return (
        f"concat(cast(({value}) div 1000 as string), ',',"
        f" lpad(cast(({value}) % 1000 as string), 3, '0'))"
    )


def _outcome_steps(duck: bool) -> list[dict[str, str]]:
    """Column expressions, each step using the columns of the steps before."""
    text = "VARCHAR" if duck else "string"

    def s(expression: str) -> str:
        return f"CAST({expression} AS {text})"

    def items(count: str, body: str) -> str:
        if duck:
            return f"list_transform(range({count}), lambda j: {body})"
        return f"transform(slice(sequence(0L, 16L), 1, cast({count} as int)), j -> {body})"

    none = "CAST([] AS VARCHAR[])" if duck else "cast(array() as array<string>)"
    answer_value = "CASE WHEN d2 % 2 = 0 THEN v WHEN d2 % 3 = 0 THEN v + v {q} 200 ELSE v + v {q} 10 END".replace(
        "{q}", "//" if duck else "div"
    )
    percent = "concat({0}, '.', {1}, '%')"
    return [
        {"x": _X, "v": "CAST(floor(o_totalprice) AS BIGINT)"},
        {"d1": "x % 101", "d2": "x % 103", "d3": "x % 107", "d4": "x % 109", "d5": "x % 113"},
        {"failed": "idx < 6 AND d1 < 5", "grounded": "idx BETWEEN 1 AND 5"},
        {"abstained": "idx = 6 OR (NOT failed AND d2 < 8)", "av": answer_value},
        {
            "question_id": f"concat('q', {s('o_orderkey')})",
            "split": _SPLIT,
            "error_status": "CASE WHEN NOT failed THEN 'ok' WHEN d1 < 2 THEN 'timeout'"
            " WHEN d1 < 4 THEN 'parse_error' ELSE 'rate_limited' END",
            "abstention_reason": "CASE WHEN idx = 6 OR (abstained AND d2 % 3 = 0) THEN 'insufficient_evidence'"
            " WHEN abstained AND d2 % 3 = 1 THEN 'policy_low_confidence'"
            " WHEN abstained THEN 'calculation_unverified' END",
            "retrieved_chunk_ids": f"CASE WHEN grounded THEN "
            f"{items('3 + d3 % 8', 'concat(' + repr('k') + ', ' + s('(o_orderkey * 3 + j * j + j * idx) % 29') + ')')}"
            f" ELSE {none} END",
            "gold_chunk_ids": items(
                "o_custkey % 4", "concat('k', " + s("(o_orderkey * 3 + j * 5) % 29") + ")"
            ),
            "raw_citations": f"CASE WHEN grounded AND NOT failed AND NOT abstained THEN "
            + items(
                "d4 % 4",
                "CASE WHEN (d5 + j) % 6 = 0 THEN concat('h', "
                + s("j")
                + ") ELSE concat('k', "
                + s("(o_orderkey * 3 + j * j + j * idx) % 29")
                + ") END",
            )
            + f" ELSE {none} END",
            "reference_answer": "CASE o_custkey % 5 WHEN 0 THEN 'not disclosed'"
            f" WHEN 1 THEN concat('$', {_thousands('v', duck)}, ' million')"
            f" WHEN 2 THEN {_thousands('v', duck)}"
            f" WHEN 3 THEN concat('(', {_thousands('v', duck)}, ')')"
            f" ELSE {percent.format(s('v % 1000'), s('v % 10'))} END",
            "answer": "CASE WHEN failed OR abstained THEN NULL ELSE CASE o_custkey % 5"
            f" WHEN 1 THEN concat('about ', {s('av')}, ' million')"
            f" WHEN 3 THEN concat('a loss of -', {s('av')})"
            f" WHEN 4 THEN {percent.format(s('av % 1000'), s('v % 10'))}"
            f" ELSE concat('the total is ', {s('av')}) END END",
            "confidence": "CASE WHEN failed OR idx = 6 THEN NULL"
            " ELSE round(CAST(d3 * 3 + d2 % 7 AS DOUBLE) / 330, 4) END",
            "latency_ms": "CAST(CASE WHEN idx = 6 THEN 1 ELSE 200 + idx * 1500 + d4 * 400 END AS DOUBLE)",
            "input_tokens": "CASE WHEN idx = 6 THEN 0 ELSE 400 * (1 + idx) + d1 * 10 END",
            "output_tokens": "CASE WHEN idx = 6 THEN 0 ELSE 50 + d2 END",
            "retry_input_tokens": "CASE WHEN idx < 6 AND d5 < 10 THEN 400 ELSE 0 END",
            "retry_output_tokens": "CASE WHEN idx < 6 AND d5 < 10 THEN 20 ELSE 0 END",
            "model": "CASE WHEN idx >= 5 THEN NULL WHEN d4 % 3 = 0 THEN 'Small-A'"
            " WHEN d4 % 3 = 1 THEN 'large-b' ELSE 'unlisted-c' END",
        },
    ]


def outcomes(spark: SparkSession, folder: str) -> DataFrame:
    """Every order as a question, every action as an outcome of it."""
    arms = F.explode(
        F.array(
            *[
                F.struct(F.lit(i).cast("bigint").alias("idx"), F.lit(a).alias("action_id"))
                for i, a in enumerate(v.ACTIONS)
            ]
        )
    )
    orders = table(spark, folder, "orders").select(
        "o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority"
    )
    rows = (
        spread(orders, "o_orderkey", "o_custkey")
        .withColumn("arm", arms)
        .select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority", "arm.*")
    )
    for step in _outcome_steps(duck=False):
        rows = rows.withColumns({name: F.expr(e) for name, e in step.items()})
    cost, known = scoring.estimate_cost(PRICES)
    split = answers.split_citations(F.col("raw_citations"), F.col("retrieved_chunk_ids"))
    return rows.withColumn("c", split).select(
        F.lit(EXPERIMENT).alias("experiment_id"),
        "question_id",
        F.col("o_orderkey").alias("question_key"),
        F.col("o_orderpriority").alias("context"),
        "split",
        "action_id",
        "retrieved_chunk_ids",
        "gold_chunk_ids",
        F.col("c.cited").alias("cited_chunk_ids"),
        F.col("c.hallucinated").alias("hallucinated_citations"),
        "reference_answer",
        "answer",
        "abstained",
        "abstention_reason",
        "error_status",
        "confidence",
        "latency_ms",
        "input_tokens",
        "output_tokens",
        "retry_input_tokens",
        "retry_output_tokens",
        "model",
        cost.alias("estimated_cost_usd"),
        known.alias("pricing_known"),
    )


def _outcomes_sql() -> str:
    arms = ", ".join(f"({i}, '{a}')" for i, a in enumerate(v.ACTIONS))
    steps = _outcome_steps(duck=True)
    parts = [
        f"o_0 AS (SELECT o_orderkey, o_custkey, o_totalprice, o_orderpriority, CAST(idx AS BIGINT) AS idx, action_id"
        f" FROM orders, (VALUES {arms}) a(idx, action_id))"
    ]
    for i, step in enumerate(steps):
        columns = ", ".join(f"{e} AS {name}" for name, e in step.items())
        parts.append(f"o_{i + 1} AS (SELECT *, {columns} FROM o_{i})")
    price = " ".join(
        f"WHEN '{m}' THEN ((input_tokens + retry_input_tokens) * {i}::DOUBLE"
        f" + (output_tokens + retry_output_tokens) * {o}::DOUBLE) / 1000000"
        for m, (i, o) in PRICES.items()
    )
    parts.append(
        f"""outcomes AS (
      SELECT '{EXPERIMENT}' AS experiment_id, o_orderkey AS question_key, o_orderpriority AS context,
             * EXCLUDE (o_orderkey, o_orderpriority),
             list_filter(raw_citations, lambda c: list_contains(retrieved_chunk_ids, c)) AS cited_chunk_ids,
             list_sort(list_distinct(list_filter(raw_citations, lambda c: NOT list_contains(retrieved_chunk_ids, c)))) AS hallucinated_citations,
             CASE lower(model) {price} END AS estimated_cost_usd,
             coalesce(lower(model) IN ({", ".join(f"'{m}'" for m in PRICES)}), false) AS pricing_known
      FROM o_{len(steps)})"""
    )
    return ",\n".join(parts)


OUTCOMES_SQL = _outcomes_sql()
NUMBER_SQL = tx.NUMBER_PATTERN.replace("'", "''")
_SCALE_SQL = " ".join(f"WHEN '{k}' THEN {s:.1f}::DOUBLE" for k, s in tx.SCALES.items())


def numbers_sql(text: str) -> str:
    return (
        f"list_transform(regexp_extract_all(coalesce({text}, ''), '{NUMBER_SQL}'), lambda m:"
        f" replace(regexp_extract(m, '{NUMBER_SQL}', 2), ',', '')::DOUBLE"
        f" * (CASE lower(regexp_extract(m, '{NUMBER_SQL}', 3)) {_SCALE_SQL} ELSE 1.0::DOUBLE END)"
        f" * (CASE WHEN regexp_extract(m, '{NUMBER_SQL}', 1) <> '' THEN -1 ELSE 1 END))"
    )


SCORED_SQL = f"""
    {OUTCOMES_SQL},
    prepared AS (
      SELECT *, list_distinct(retrieved_chunk_ids[1:10]) AS top, list_distinct(gold_chunk_ids) AS gold,
             {numbers_sql("reference_answer")} AS expected, {numbers_sql("answer")} AS actual
      FROM outcomes),
    counted AS (
      SELECT *, len(gold) AS n_gold, len(top) AS n_top, len(list_intersect(gold, top)) AS n_found,
             len(cited_chunk_ids) AS n_cited, len(hallucinated_citations) AS n_hall,
             expected[1] AS target
      FROM prepared),
    scored AS (
      SELECT *,
        CASE WHEN n_gold > 0 THEN n_found / n_gold END AS retrieval_recall,
        CASE WHEN n_gold > 0 THEN CASE WHEN n_found > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END END AS retrieval_hit,
        CASE WHEN n_gold > 0 THEN CASE WHEN n_top = 0 THEN 0.0::DOUBLE ELSE n_found / n_top END END AS retrieval_precision,
        CASE WHEN NOT abstained AND n_cited + n_hall > 0 THEN n_cited / (n_cited + n_hall) END AS citation_precision,
        CASE WHEN NOT abstained THEN CASE WHEN n_cited + n_hall > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END END AS citation_coverage,
        CASE WHEN NOT abstained AND len(expected) > 0 THEN
          CASE WHEN len(list_filter(actual, lambda a: CASE WHEN target = 0 THEN abs(a) <= 0.01::DOUBLE
               ELSE abs(a - target) / abs(target) <= 0.01::DOUBLE END)) > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END
          END AS numeric_correctness,
        CASE WHEN abstained AND n_gold > 0 THEN CASE WHEN n_found > 0 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END END AS abstention_precision,
        CASE WHEN pricing_known THEN 1 - least(estimated_cost_usd / 0.05::DOUBLE, 1) END AS cost_score,
        1 - least(latency_ms / 30000::DOUBLE, 1) AS latency_score,
        CASE WHEN error_status = 'ok' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS policy_compliance
      FROM counted),
    inputs AS (
      SELECT *,
        CASE WHEN numeric_correctness IS NOT NULL AND retrieval_recall IS NOT NULL
               THEN (0.6::DOUBLE * numeric_correctness + 0.4::DOUBLE * retrieval_recall) / (0.6::DOUBLE + 0.4::DOUBLE)
             ELSE coalesce(numeric_correctness, retrieval_recall, 0) END AS quality,
        coalesce(1 - cost_score, 0) AS normalized_cost,
        coalesce(1 - latency_score, 0) AS normalized_latency,
        coalesce(1 - citation_precision, 0) AS hallucination,
        1 - policy_compliance AS violation
      FROM scored)"""

_W = v.REWARD_PROFILES[v.PRIMARY_PROFILE]
REWARD_EXPR_SQL = (
    f"round(quality - {_W[0]}::DOUBLE * normalized_cost - {_W[1]}::DOUBLE * normalized_latency"
    f" - {_W[2]}::DOUBLE * hallucination - {_W[3]}::DOUBLE * violation, 9)"
)
REWARDS_SQL = f"""
    {SCORED_SQL},
    rewards AS (SELECT *, {REWARD_EXPR_SQL} AS reward FROM inputs)"""


def scored(spark: SparkSession, folder: str) -> DataFrame:
    return scoring.score_wide(outcomes(spark, folder))


def rewards(spark: SparkSession, folder: str) -> DataFrame:
    """Outcomes with reward inputs and the reward under the primary profile."""
    inputs = scoring.reward_inputs(scored(spark, folder))
    weights = v.REWARD_PROFILES[v.PRIMARY_PROFILE]
    return inputs.withColumn("reward", F.round(scoring.reward(weights), 9))


def reward_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """(question_key, question_id, context, split, rewards, costs), arrays by arm.

    One aggregate over narrow columns. The matrix is read several times by the
    policy queries, so it is kept; a lost block is recomputed from the table.
    """

    def by_arm(value: str) -> F.Column:
        return F.array(*[F.max(F.when(F.col("action_id") == a, F.col(value))) for a in v.ACTIONS])

    keys = ("question_key", "question_id", "context", "split")
    flat = rewards(spark, folder).select(*keys, "action_id", "reward", "normalized_cost")
    return (
        flat.groupBy(*keys)
        .agg(by_arm("reward").alias("rewards"), by_arm("normalized_cost").alias("costs"))
        .persist(StorageLevel.MEMORY_AND_DISK)
    )


# ---------------------------------------------------------- filing questions
_FILING = {
    "company": "CASE WHEN o_custkey % 10 = 0 THEN '' ELSE concat('CO', CAST(o_custkey % 50 AS {t})) END",
    "doc_name": "CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE concat('CO', CAST(o_custkey % 50 AS {t}), '_', CAST(year(o_orderdate) AS {t}),"
    " CASE o_orderkey % 4 WHEN 0 THEN '_10K' WHEN 1 THEN concat('Q', CAST(quarter(o_orderdate) AS {t}), '_10Q')"
    " WHEN 2 THEN concat('_8K_dated-', CAST(year(o_orderdate) AS {t}), '-07-01') ELSE '_EARNINGS' END) END",
    "question": "CASE WHEN o_orderkey % 23 = 0 THEN '  ' ELSE concat('What was the total of order ', CAST(o_orderkey AS {t}), '?') END",
    "answer": "CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE concat('$', CAST(CAST(floor(o_totalprice) AS BIGINT) AS {t}), ' million') END",
    "identifier": "CASE WHEN o_orderkey % 101 = 0 THEN NULL WHEN o_orderkey % 31 = 0 THEN concat('id_', CAST(o_orderkey - 1 AS {t}))"
    " ELSE concat('id_', CAST(o_orderkey AS {t})) END",
    "has_evidence": "o_orderkey % 13 <> 0",
    "broken": "o_orderkey % 97 = 0",
}


def filing_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Orders rendered as JSON question lines, some of them damaged."""
    orders = table(spark, folder, "orders").drop("o_orderstatus", "o_orderpriority")
    rows = spread(orders, "o_orderkey", "o_custkey").withColumns(
        {name: F.expr(e.format(t="string")) for name, e in _FILING.items()}
    )
    entry = lambda doc, page: F.struct(
        F.concat(F.lit("Total "), F.col("o_orderkey")).alias("evidence_text"),
        doc.cast("string").alias("doc_name"),
        page.cast("bigint").alias("evidence_page_num"),
        F.concat(F.lit("Page text of order "), F.col("o_orderkey")).alias("evidence_text_full_page"),
    )
    own = entry(F.lit(None), F.col("o_orderkey") % 40)
    other = entry(F.lit("CO9_2000_10K"), F.lit(None))
    row = F.struct(
        F.col("identifier").alias("financebench_id"),
        "company",
        "doc_name",
        "question",
        "answer",
        F.when(F.col("has_evidence"), F.array(own, other, own)).alias("evidence"),
        F.concat(F.lit("https://example.invalid/"), F.col("o_orderkey")).alias("doc_link"),
    )
    line = F.when(F.col("broken"), F.concat(F.lit("{broken "), F.col("o_orderkey"))).otherwise(
        F.to_json(row)
    )
    return rows.select(F.col("o_orderkey").alias("line_no"), line.alias("line"))


FILING_SQL = f"""
    filing_rows AS (SELECT o_orderkey, o_custkey, o_orderdate, {", ".join(f"{e.format(t='VARCHAR')} AS {n}" for n, e in _FILING.items())} FROM orders),
    filing_questions AS (
      SELECT o_orderkey AS line_no, identifier AS question_id, trim(question) AS question_text, company, doc_name,
             coalesce(nullif(company, ''), nullif(doc_name, ''), identifier) AS group_key,
             answer AS reference_answer,
             CASE WHEN NOT has_evidence THEN CAST([] AS VARCHAR[])
                  WHEN doc_name = '' THEN ['CO9_2000_10K::p?']
                  ELSE [doc_name || '::p' || (o_orderkey % 40)::VARCHAR, 'CO9_2000_10K::p?'] END AS reference_evidence
      FROM filing_rows WHERE NOT broken AND identifier IS NOT NULL)"""


def filing_index(spark: SparkSession, folder: str) -> DataFrame:
    """Line items standing in for a filing index."""
    return table(spark, folder, "lineitem").select(
        (F.col("l_suppkey") % 50).alias("cik"),
        F.get(F.array(*map(F.lit, ("10-K", "10-Q", "8-K"))), F.col("l_linenumber") % 3).alias(
            "form"
        ),
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey").alias("accession_number"),
        F.date_format("l_shipdate", "yyyy-MM-dd").alias("report_date"),
        F.when(F.col("l_quantity") == 1, "").otherwise("main.htm").alias("primary_document"),
        (F.col("l_returnflag") == "N").alias("is_recent"),
    )
