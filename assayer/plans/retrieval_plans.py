"""Queries over lexical, dense and fused retrieval, and its evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayer.operators import bm25, dense, evidence, features, fusion, policies
from assayer.plans import roles, text_plans
from assayer.plans.registry import plan
from assayer.session import spread, stored
from assayer.sources.tables import table

K = 10
RETRIEVERS = ["bm25", "hashed", "hybrid"]


def lexical(spark, folder, k=fusion.CANDIDATE_K, corpus=None):
    corpus = roles.corpus(spark, folder) if corpus is None else corpus
    return bm25.search(corpus, roles.questions(spark, folder), k)


@plan(
    "bm25_topk",
    f"WITH {roles.BM25_SQL} SELECT question_id, chunk_id, score, rank FROM bm25_all WHERE rank <= {K}",
)
def bm25_topk(spark, folder):
    return lexical(spark, folder, K).select("question_id", "chunk_id", "score", "rank")


@plan(
    "bm25_stats",
    f"""WITH {roles.DOC_ROWS_SQL}, {roles.terms_sql("t", "doc_rows", "chunk_id", "text")}
    SELECT (SELECT count(*) FROM doc_rows) AS n_chunks, count(DISTINCT term) AS vocabulary_size,
           round(count(*) / (SELECT count(*) FROM doc_rows), 2) AS average_length FROM t""",
)
def bm25_stats(spark, folder):
    return bm25.index_stats(bm25.index_terms(roles.corpus(spark, folder), "chunk_id"))


@plan(
    "bm25_scoped",
    f"""WITH RECURSIVE {text_plans.CHUNK_SQL}, {text_plans._REFS_SQL},
    {roles.terms_sql("dt", "chunks", "chunk_id", "text")}, {roles.terms_sql("qt", "item_rows", "question_id", "text")},
    scope AS (SELECT DISTINCT question_id, document_id FROM refs),
    pool AS (SELECT question_id, chunk_id, ordinal FROM scope JOIN chunks USING (document_id)),
    tf AS (SELECT id AS chunk_id, term, count(*) AS tf FROM dt GROUP BY ALL),
    lens AS (SELECT chunk_id, coalesce(len, 0) AS len FROM chunks LEFT JOIN
             (SELECT id AS chunk_id, count(*) AS len FROM dt GROUP BY ALL) USING (chunk_id)),
    totals AS (SELECT question_id, count(*) AS n, sum(len) / count(*) AS mean_len FROM pool JOIN lens USING (chunk_id) GROUP BY ALL),
    qtf AS (SELECT id AS question_id, term, count(*) AS qtf FROM qt GROUP BY ALL),
    hits AS (SELECT * FROM pool JOIN tf USING (chunk_id) JOIN qtf USING (question_id, term)),
    dfs AS (SELECT question_id, term, count(*) AS df FROM hits GROUP BY ALL),
    s AS (SELECT question_id, chunk_id, ordinal, round(sum(qtf * ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE))
            * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / mean_len))), 6) AS score
          FROM hits JOIN dfs USING (question_id, term) JOIN totals USING (question_id) JOIN lens USING (chunk_id) GROUP BY ALL),
    r AS (SELECT *, CAST(row_number() OVER (PARTITION BY question_id ORDER BY score DESC, ordinal, chunk_id) AS INTEGER) AS rank FROM s WHERE score > 0)
    SELECT question_id, chunk_id, score, rank FROM r WHERE rank <= {K}""",
)
def bm25_scoped(spark, folder):
    scope = roles.gold_references(spark, folder).select("question_id", "document_id")
    scored = bm25.score_scoped(
        text_plans.chunks(spark, folder, scope), roles.questions(spark, folder), scope
    )
    return bm25.top_k(scored, K).select("question_id", "chunk_id", "score", "rank")


def hashed(spark, folder, k=fusion.CANDIDATE_K, corpus=None):
    corpus = roles.corpus(spark, folder) if corpus is None else corpus
    # Vectors are read for their model, for the pivots and by the search: texts are read once.
    sums = stored(dense.hashed_sums(corpus, "chunk_id", "text"), "hashed-sums")
    corpus = dense.unit_vectors(sums, "chunk_id")
    asked = dense.hashed_vectors(roles.questions(spark, folder), "question_id", "question_text")
    return dense.nearest(corpus, asked, k)


def _vector_sql(name: str, source: str, key: str) -> str:
    return f"""
    {name}_t AS (SELECT id, '0' || chr(0) || tok AS tok, count(*) AS n FROM (
        SELECT {key} AS id, unnest(regexp_extract_all(lower(text), '[a-z0-9][a-z0-9,.%$]*')) AS tok FROM {source}) GROUP BY ALL),
    {name}_h AS (SELECT tok, sha256(tok) AS h FROM (SELECT DISTINCT tok FROM {name}_t)),
    {name}_v AS (SELECT id, ('0x' || substr(h, 1, 8))::BIGINT % 256 AS dim,
        sum(n * (CASE WHEN ('0x' || substr(h, 9, 2))::BIGINT % 2 = 0 THEN 1 ELSE -1 END))::DOUBLE AS val
      FROM {name}_t JOIN {name}_h USING (tok) GROUP BY ALL),
    {name}_n AS (SELECT id, sqrt(sum(val * val)) AS norm FROM {name}_v GROUP BY ALL),
    {name} AS (SELECT id, dim, val / norm AS val FROM {name}_v JOIN {name}_n USING (id) WHERE norm > 0)"""


HASHED_SQL = f"""
    {_vector_sql("hd", "doc_rows", "chunk_id")}, {_vector_sql("hq", "item_rows", "question_id")},
    hashed_scores AS (SELECT hq.id AS question_id, hd.id AS chunk_id, round(sum(hq.val * hd.val), 6) AS score
      FROM hq JOIN hd USING (dim) GROUP BY ALL),
    hashed_all AS (SELECT *, CAST(row_number() OVER (PARTITION BY question_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rank
      FROM hashed_scores WHERE score > 0)"""


@plan(
    "hash_embed_topk",
    f"""WITH {roles.DOC_ROWS_SQL}, {roles.ITEM_ROWS_SQL}, {HASHED_SQL}
    SELECT question_id, chunk_id, score, rank FROM hashed_all WHERE rank <= {K}""",
)
def hash_embed_topk(spark, folder):
    return hashed(spark, folder, K).select("question_id", "chunk_id", "score", "rank")


def vectors(spark, folder):
    return table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("chunk_id"),
        F.col("embedding").alias("vector"),
        "label",
    )


DENSE_SQL = """
    e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v, label FROM embeddings),
    dense_all AS (
      SELECT a.vec_id AS question_id, b.vec_id AS chunk_id, a.label AS asked, b.label AS found,
             round(list_dot_product(a.v, b.v), 6) AS score
      FROM e a JOIN e b ON a.vec_id <> b.vec_id),
    dense_ranked AS (
      SELECT *, CAST(row_number() OVER (PARTITION BY question_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rank
      FROM dense_all WHERE score > 0)"""


def neighbours(spark, folder):
    corpus = vectors(spark, folder)
    asked = corpus.select(F.col("chunk_id").alias("question_id"), "vector")
    rows = spread(corpus.select("chunk_id", "vector"), "chunk_id", "vector")
    return dense.nearest(rows, asked, K, exclude_self=True, dimensions=64)


@plan(
    "dense_topk",
    f"WITH {DENSE_SQL} SELECT question_id, chunk_id, score, rank FROM dense_ranked WHERE rank <= {K}",
)
def dense_topk(spark, folder):
    return neighbours(spark, folder).select("question_id", "chunk_id", "score", "rank")


@plan(
    "dense_label_recall",
    f"""WITH {DENSE_SQL}, sizes AS (SELECT label, count(*) - 1 AS n_gold FROM embeddings GROUP BY ALL),
    f AS (SELECT question_id, count(*) FILTER (asked = found) AS n_found, count(*) AS n_top FROM dense_ranked WHERE rank <= {K} GROUP BY ALL)
    SELECT label, count(*) AS n_questions, round(avg(CASE WHEN n_gold > 0 THEN coalesce(n_found, 0) / n_gold END), 6) AS mean_recall,
           round(avg(coalesce(n_found, 0) / coalesce(n_top, 1)), 6) AS mean_precision
    FROM e JOIN sizes USING (label) LEFT JOIN f ON f.question_id = e.vec_id GROUP BY ALL""",
)
def dense_label_recall(spark, folder):
    labels = vectors(spark, folder).select("chunk_id", "label")
    # Gold is "same label": its size comes from label counts, so the pairs of a
    # label are never listed.
    sizes = labels.groupBy("label").agg((F.count(F.lit(1)) - 1).alias("n_gold"))
    asked = labels.select(F.col("chunk_id").alias("question_id"), F.col("label").alias("asked"))
    found = (
        neighbours(spark, folder)
        .join(asked, "question_id")
        .join(labels, "chunk_id")
        .groupBy("question_id")
        .agg(
            F.count_if(F.col("asked") == F.col("label")).alias("n_found"),
            F.count(F.lit(1)).alias("n_top"),
        )
    )
    zero = F.lit(0)
    return (
        labels.join(sizes, "label")
        .join(found.withColumnRenamed("question_id", "chunk_id"), "chunk_id", "left")
        .groupBy("label")
        .agg(
            F.count(F.lit(1)).alias("n_questions"),
            F.round(F.avg(F.try_divide(F.coalesce("n_found", zero), F.col("n_gold"))), 6).alias(
                "mean_recall"
            ),
            F.round(
                F.avg(F.coalesce("n_found", zero) / F.coalesce("n_top", F.lit(1))), 6
            ).alias("mean_precision"),
        )
    )


def dealt_corpus(spark, folder):
    """The corpus, dealt evenly once for the scans that read it."""
    return stored(roles.corpus(spark, folder), "corpus")


def rankings(spark, folder, corpus=None):
    """Candidate lists of both retrievers: a bounded table that is read twice."""
    corpus = dealt_corpus(spark, folder) if corpus is None else corpus
    both = fusion.as_source(lexical(spark, folder, corpus=corpus), "bm25").unionByName(
        fusion.as_source(hashed(spark, folder, corpus=corpus), "dense")
    )
    return stored(both, "rankings")


def _rrf_sql(bm25_weight: str, dense_weight: str) -> str:
    return f"""
    candidates AS (
      SELECT question_id, chunk_id, rank, 'bm25' AS source, {bm25_weight}::DOUBLE AS w FROM bm25_all WHERE rank <= 50
      UNION ALL SELECT question_id, chunk_id, rank, 'dense', {dense_weight}::DOUBLE FROM hashed_all WHERE rank <= 50),
    fused AS (SELECT question_id, chunk_id, round(sum(w / (60 + rank)), 9) AS score,
        max(CASE WHEN source = 'bm25' THEN rank END) AS bm25_rank, max(CASE WHEN source = 'dense' THEN rank END) AS dense_rank
      FROM candidates GROUP BY ALL),
    fused_all AS (SELECT *, CAST(row_number() OVER (PARTITION BY question_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rank FROM fused)"""


_RRF_OUT = f"""SELECT question_id, chunk_id, score, rank, coalesce(bm25_rank, 0) AS bm25_rank,
    coalesce(dense_rank, 0) AS dense_rank FROM fused_all WHERE rank <= {K}"""


def _fused_columns(fused):
    def place(source):
        return F.coalesce(F.try_element_at("component_ranks", F.lit(source)), F.lit(0))

    return fused.select(
        "question_id",
        "chunk_id",
        "score",
        "rank",
        place("bm25").alias("bm25_rank"),
        place("dense").alias("dense_rank"),
    )


@plan("rrf_hybrid", f"WITH {roles.BM25_SQL}, {HASHED_SQL}, {_rrf_sql('1', '1')} {_RRF_OUT}")
def rrf_hybrid(spark, folder):
    return _fused_columns(fusion.reciprocal_rank_fusion(rankings(spark, folder), K))


@plan("rrf_weighted", f"WITH {roles.BM25_SQL}, {HASHED_SQL}, {_rrf_sql('2', '0.5')} {_RRF_OUT}")
def rrf_weighted(spark, folder):
    fused = fusion.reciprocal_rank_fusion(
        rankings(spark, folder), K, weights={"bm25": 2.0, "dense": 0.5}
    )
    return _fused_columns(fused)


@plan(
    "lexical_rerank",
    f"""WITH {roles.BM25_SQL}, c AS (SELECT question_id, chunk_id, rank FROM bm25_all WHERE rank <= 30),
    sizes AS (SELECT question_id, count(*) AS n FROM qtf GROUP BY ALL),
    shared AS (SELECT question_id, chunk_id, count(*) AS common FROM c JOIN qtf USING (question_id) JOIN tf USING (chunk_id, term) GROUP BY ALL),
    s AS (SELECT question_id, chunk_id, rank AS retrieval_rank, round(coalesce(common, 0) / n, 6) AS score
          FROM c JOIN sizes USING (question_id) LEFT JOIN shared USING (question_id, chunk_id)),
    r AS (SELECT *, CAST(row_number() OVER (PARTITION BY question_id ORDER BY score DESC, retrieval_rank, chunk_id) AS INTEGER) AS rank FROM s)
    SELECT question_id, chunk_id, score, retrieval_rank, rank FROM r WHERE rank <= {K}""",
)
def lexical_rerank(spark, folder):
    return fusion.lexical_overlap(
        stored(lexical(spark, folder, 30), "lexical"), roles.questions(spark, folder), roles.corpus(spark, folder), K
    ).select("question_id", "chunk_id", "score", "retrieval_rank", "rank")


@plan(
    "listwise_rerank",
    f"""WITH {roles.BM25_SQL}, c AS (SELECT question_id, chunk_id, rank, CAST(substr(question_id, 2) AS BIGINT) AS item FROM bm25_all WHERE rank <= 30),
    s AS (SELECT question_id, chunk_id, rank AS retrieval_rank,
           CASE WHEN item % 3 = 0 THEN -rank::DOUBLE WHEN (rank + item) % 3 = 0 THEN ((rank * 7 + item) % 11)::DOUBLE ELSE 5.0::DOUBLE END AS score FROM c),
    r AS (SELECT *, CAST(row_number() OVER (PARTITION BY question_id ORDER BY score DESC, retrieval_rank, chunk_id) AS INTEGER) AS rank FROM s)
    SELECT question_id, chunk_id, score, retrieval_rank, rank FROM r WHERE rank <= {K}""",
)
def listwise_rerank(spark, folder):
    """Judged scores cover a third of each list; every third question has none."""
    item = F.col("item_id")
    judged = (
        table(spark, folder, "benchmark")
        .withColumn("position", F.explode(F.sequence(F.lit(1), F.lit(40))))
        .filter((item % 3 != 0) & ((F.col("position") + item) % 3 == 0))
        .select(
            F.concat(F.lit("q"), item).alias("question_id"),
            "position",
            ((F.col("position") * 7 + item) % 11).cast("double").alias("judged_score"),
        )
    )
    return fusion.listwise_scores(lexical(spark, folder, 30), judged, K).select(
        "question_id", "chunk_id", "score", "retrieval_rank", "rank"
    )


@plan("evidence_gold", f"WITH {roles.GOLD_SQL} SELECT question_id, chunk_id FROM gold")
def evidence_gold(spark, folder):
    return roles.gold_documents(spark, folder)


def ranked_lists(spark, folder, corpus=None):
    """The best K of each retriever; a list's head is the head of its candidates."""
    candidates = rankings(spark, folder, corpus)
    fused = fusion.as_source(fusion.reciprocal_rank_fusion(candidates, K), "hybrid")
    retriever = F.when(F.col("source") == "dense", "hashed").otherwise(F.col("source"))
    return (
        candidates.filter(F.col("rank") <= K)
        .unionByName(fused)
        .select("question_id", retriever.alias("retriever"), "chunk_id", "rank")
    )


def results(spark, folder):
    corpus = dealt_corpus(spark, folder)
    return evidence.recall_hit(
        roles.questions(spark, folder),
        roles.gold_documents(spark, folder, corpus),
        ranked_lists(spark, folder, corpus),
        RETRIEVERS,
        K,
    )


RESULTS_SQL = f"""
    {roles.BM25_SQL}, {HASHED_SQL}, {_rrf_sql("1", "1")},
    {roles.shingle_sql("held", "doc_rows", "chunk_id", "text")},
    {roles.shingle_sql("asked", "item_rows", "question_id", "text")},
    gold AS (SELECT DISTINCT question_id, chunk_id FROM held JOIN asked USING (shingle)),
    lists AS (
      SELECT question_id, 'bm25' AS retriever, chunk_id, rank FROM bm25_all WHERE rank <= {K}
      UNION ALL SELECT question_id, 'hashed', chunk_id, rank FROM hashed_all WHERE rank <= {K}
      UNION ALL SELECT question_id, 'hybrid', chunk_id, rank FROM fused_all WHERE rank <= {K}),
    sizes AS (SELECT question_id, count(*) AS n_gold FROM gold GROUP BY ALL),
    finds AS (SELECT question_id, retriever, count(*) AS n_found FROM lists JOIN gold USING (question_id, chunk_id) GROUP BY ALL),
    results AS (
      SELECT question_id, retriever, coalesce(coalesce(n_found, 0) / n_gold, 0) AS recall, coalesce(n_found, 0) > 0 AS hit,
             coalesce(n_gold, 0) AS n_gold, n_gold IS NOT NULL AS measurable
      FROM (SELECT question_id, retriever FROM item_rows CROSS JOIN (VALUES ('bm25'), ('hashed'), ('hybrid')) r(retriever)) cells
      LEFT JOIN sizes USING (question_id) LEFT JOIN finds USING (question_id, retriever))"""


@plan(
    "recall_hit_at_k",
    f"""WITH {RESULTS_SQL} SELECT question_id, retriever, round(recall, 6) AS recall, hit, n_gold, measurable FROM results""",
)
def recall_hit_at_k(spark, folder):
    return results(spark, folder).withColumn("recall", F.round("recall", 6))


@plan(
    "mrr_ndcg",
    f"""WITH {RESULTS_SQL},
    marked AS (SELECT l.*, CASE WHEN g.chunk_id IS NULL THEN 0 ELSE 1 END AS rel FROM lists l LEFT JOIN gold g USING (question_id, chunk_id)),
    ideal AS (SELECT question_id, list_sum(list_transform(range(1, least(n_gold, {K}) + 1), lambda i: 1 / log2(i + 1))) AS ideal FROM sizes)
    SELECT question_id, retriever, round(max(rel / rank), 6) AS reciprocal_rank, round(sum(rel / log2(rank + 1)) / any_value(ideal), 6) AS ndcg,
           round(sum(rel) / count(*), 6) AS precision
    FROM marked JOIN ideal USING (question_id) GROUP BY question_id, retriever""",
)
def mrr_ndcg(spark, folder):
    corpus = dealt_corpus(spark, folder)
    return evidence.rank_quality(
        roles.gold_documents(spark, folder, corpus), ranked_lists(spark, folder, corpus), K
    )


@plan(
    "list_quality",
    f"""WITH {RESULTS_SQL}, {roles.terms_sql("vt", "doc_rows", "chunk_id", "text")},
    vc AS (SELECT id AS chunk_id, term, count(*)::DOUBLE AS tf FROM vt GROUP BY ALL),
    vn AS (SELECT chunk_id, sqrt(sum(tf * tf)) AS norm FROM vc GROUP BY ALL),
    sq AS (SELECT question_id, retriever, sum(v * v) AS square FROM (
      SELECT question_id, retriever, term, sum(tf / norm) AS v FROM lists JOIN vc USING (chunk_id) JOIN vn USING (chunk_id) GROUP BY ALL) GROUP BY ALL),
    sz AS (SELECT question_id, retriever, CAST(sum(greatest(1, length(text) // 4)) AS BIGINT) AS context_tokens, count(norm) AS n
      FROM lists JOIN doc_rows USING (chunk_id) LEFT JOIN vn USING (chunk_id) GROUP BY ALL)
    SELECT question_id, retriever, CASE WHEN n > 1 THEN round((square - n) / (n * (n - 1)), 6) END AS redundancy, context_tokens,
      round(coalesce(n_found, 0) / n_gold, 6) AS document_recall
    FROM sz LEFT JOIN sq USING (question_id, retriever) LEFT JOIN finds USING (question_id, retriever) LEFT JOIN sizes USING (question_id)""",
)
def list_quality(spark, folder):
    """Redundancy, context length and document recall; a document here is one chunk."""
    corpus = dealt_corpus(spark, folder)
    return evidence.list_quality(
        roles.gold_documents(spark, folder, corpus), ranked_lists(spark, folder, corpus), corpus, K
    )


@plan(
    "retriever_summary",
    f"""WITH {RESULTS_SQL} SELECT retriever, round(avg(recall) FILTER (measurable), 6) AS mean_recall,
      round(avg(hit::INT) FILTER (measurable), 6) AS hit_rate, count(*) FILTER (measurable) AS n_measurable
    FROM results GROUP BY ALL""",
)
def retriever_summary(spark, folder):
    return evidence.retriever_summary(results(spark, folder))


@plan(
    "oracle_hit_rate",
    f"""WITH {RESULTS_SQL}, q AS (SELECT question_id, max(hit::INT) AS hit FROM results WHERE measurable GROUP BY ALL)
    SELECT count(*) AS n_measurable, round(coalesce(avg(hit), 0), 4) AS oracle_hit_rate FROM q""",
)
def oracle_hit_rate(spark, folder):
    return evidence.oracle_hit_rate(results(spark, folder))


DISAGREEMENT_SQL = f"""{RESULTS_SQL},
    pairs AS (
      SELECT a.retriever AS a, b.retriever AS b, count(*) FILTER (a.hit AND b.hit) AS "both",
             count(*) FILTER (a.hit AND NOT b.hit) AS a_only, count(*) FILTER (NOT a.hit AND b.hit) AS b_only,
             count(*) FILTER (NOT a.hit AND NOT b.hit) AS neither
      FROM results a JOIN results b ON a.question_id = b.question_id AND a.retriever < b.retriever
      WHERE a.measurable AND b.measurable GROUP BY ALL)"""


@plan(
    "retriever_disagreement",
    f"""WITH {DISAGREEMENT_SQL} SELECT *, round((a_only + b_only) / ("both" + a_only + b_only + neither), 4) AS disagreement_rate,
      round(("both" + a_only + b_only - greatest("both" + a_only, "both" + b_only)) / ("both" + a_only + b_only + neither), 4) AS complementarity
    FROM pairs""",
)
def retriever_disagreement(spark, folder):
    return evidence.disagreement(results(spark, folder), RETRIEVERS)


@plan(
    "query_features",
    rf"""WITH {roles.ITEM_ROWS_SQL}, w AS (SELECT question_id, text, regexp_extract_all(translate(text, {roles.AZ}), '{roles.TOKEN_SQL}') AS w FROM item_rows)
    SELECT question_id, length(text) AS n_chars, len(w) AS n_tokens, len(list_distinct(w)) AS n_distinct_tokens,
      len(list_filter(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(31), 'g'), chr(31)), lambda s: trim(s, E' \n\t\r') <> '')) AS n_sentences,
      len({roles.numbers_sql("text")}) AS n_numbers, regexp_matches(text, '\b(?:19|20)[0-9][0-9]\b') AS has_year,
      contains(text, '%') AS has_percent, regexp_matches(text, '[$€£]') AS has_currency,
      CASE {" ".join(f"WHEN list_has_any(w, [{', '.join(repr(x) for x in words)}]) THEN '{kind}'" for kind, words in (("comparison", features.COMPARISON_WORDS), ("arithmetic", features.ARITHMETIC_WORDS), ("synthesis", features.SYNTHESIS_WORDS)))} ELSE 'extraction' END AS predicted_question_type
    FROM w""",
)
def query_features(spark, folder):
    return features.query_features(roles.questions(spark, folder))


PROBE_SQL = f"""
    lx AS (SELECT question_id, chunk_id, score, rank FROM bm25_all WHERE rank <= {K}),
    dx AS (SELECT question_id, chunk_id, score, rank FROM hashed_all WHERE rank <= {K}),
    lf AS (SELECT question_id, max(score) FILTER (rank = 1) AS top1, max(score) FILTER (rank = 1) - coalesce(max(score) FILTER (rank = 2), 0) AS margin,
             ln(sum(score)) - sum(score * ln(score)) / sum(score) AS entropy, count(DISTINCT chunk_id) AS docs FROM lx GROUP BY ALL),
    df AS (SELECT question_id, max(score) FILTER (rank = 1) AS top1, max(score) FILTER (rank = 1) - coalesce(max(score) FILTER (rank = 2), 0) AS margin FROM dx GROUP BY ALL),
    ag AS (SELECT question_id, count(*) / {K} AS agreement, sum(1.0::DOUBLE / (lx.rank * dx.rank)) AS overlap FROM lx JOIN dx USING (question_id, chunk_id) GROUP BY ALL),
    probe AS (SELECT question_id, coalesce(lf.top1, 0) AS bm25_top1_score, round(coalesce(lf.margin, 0), 6) AS bm25_top1_top2_margin,
      round(coalesce(entropy, 0), 6) AS bm25_entropy, coalesce(df.top1, 0) AS dense_top1_similarity,
      round(coalesce(df.margin, 0), 6) AS dense_top1_top2_margin, round(coalesce(agreement, 0), 6) AS lexical_dense_agreement,
      round(coalesce(overlap, 0), 6) AS reciprocal_rank_overlap, coalesce(docs, 0) AS distinct_documents_in_top_k
    FROM item_rows LEFT JOIN lf USING (question_id) LEFT JOIN df USING (question_id) LEFT JOIN ag USING (question_id))"""


def probe(spark, folder):
    document = F.col("chunk_id").alias("document_id")
    return features.probe_features(
        roles.questions(spark, folder),
        lexical(spark, folder, K).select("question_id", "chunk_id", "score", "rank", document),
        hashed(spark, folder, K).select("question_id", "chunk_id", "score", "rank", document),
        K,
    )


@plan("probe_features", f"WITH {roles.BM25_SQL}, {HASHED_SQL}, {PROBE_SQL} SELECT * FROM probe")
def probe_features(spark, folder):
    return probe(spark, folder)


@plan(
    "rule_router",
    f"""WITH {roles.BM25_SQL}, {HASHED_SQL}, {PROBE_SQL},
    t AS (SELECT round(avg(bm25_top1_score) - stddev_samp(bm25_top1_score), 6) AS min_bm25, round(avg(dense_top1_similarity) - stddev_samp(dense_top1_similarity), 6) AS min_dense,
      round(avg(lexical_dense_agreement) - stddev_samp(lexical_dense_agreement), 6) AS min_agree,
      round(avg(bm25_top1_top2_margin) - stddev_samp(bm25_top1_top2_margin), 6) AS min_margin,
      round(avg(bm25_top1_top2_margin) + stddev_samp(bm25_top1_top2_margin), 6) AS strong FROM probe),
    kinds AS (SELECT question_id, regexp_extract_all(translate(text, {roles.AZ}), '{roles.TOKEN_SQL}') AS w FROM item_rows),
    r AS (SELECT question_id, CASE WHEN bm25_top1_score < min_bm25 AND dense_top1_similarity < min_dense THEN 'abstain_on_weak_retrieval'
      WHEN lexical_dense_agreement < min_agree AND bm25_top1_top2_margin < min_margin THEN 'abstain_on_conflicting_retrieval'
      WHEN bm25_top1_top2_margin >= strong THEN 'bm25_for_high_lexical_overlap'
      WHEN lexical_dense_agreement < min_agree THEN 'hybrid_on_retriever_disagreement'
      WHEN list_has_any(w, [{', '.join(repr(x) for x in features.COMPARISON_WORDS + features.ARITHMETIC_WORDS + features.SYNTHESIS_WORDS)}]) THEN 'agentic_for_multi_step_questions'
      ELSE 'default' END AS rule FROM probe JOIN kinds USING (question_id), t)
    SELECT question_id, rule, CASE WHEN rule LIKE 'abstain%' THEN 'A6_abstain' WHEN rule LIKE 'bm25%' THEN 'A1_bm25'
      WHEN rule LIKE 'agentic%' THEN 'A5_agentic' ELSE 'A3_hybrid' END AS action_id FROM r""",
)
def rule_router(spark, folder):
    known = probe(spark, folder).join(
        features.query_features(roles.questions(spark, folder)), "question_id"
    )
    thresholds = policies.fit_thresholds(known)
    return policies.rule_route(known, thresholds).select("question_id", "rule", "action_id")
