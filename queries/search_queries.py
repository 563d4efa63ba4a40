"""Retrieval: tokens, BM25, vectors, fusion."""

from __future__ import annotations

from pyspark.sql import functions as F

from clausewise import fixed_values as fv
from clausewise.functions import scoring
from clausewise.functions import text as X
from clausewise.operators import bm25, fusion, vector_cells, vectors
from clausewise.plans import retrieval
from queries.base import (
    KB_CTE, KB_TYPES, QUERY_CTE, ROWS_PER_TASK, benchmark_queries, kb, query, sql_map, table,
)

POOL = 20
_TYPES = ", ".join(f"'{t}'" for t in KB_TYPES)
_WORDS = "'[가-힣a-zA-Z0-9]{2,}'"
_STEM = "regexp_replace(w, '^(.{2,}?)(?:" + "|".join(sorted(fv.PARTICLES, key=len, reverse=True)) + r")$', '\1')"

INDEX_CTE = f"""
tokens AS (SELECT id, contract_type, list_distinct(regexp_extract_all(text, {_WORDS})) AS ws FROM kb),
placed AS (
  SELECT id, ws, len(ws) AS dl, contract_type AS ct FROM tokens WHERE contract_type IN ({_TYPES})
  UNION ALL SELECT id, ws, len(ws), t.ct FROM tokens, (SELECT unnest([{_TYPES}]) AS ct) t WHERE contract_type = 'common'
  UNION ALL SELECT id, ws, len(ws), '*' FROM tokens),
stats AS (SELECT ct, count(*) AS n, avg(dl) AS avgdl FROM placed GROUP BY ct),
postings AS (SELECT ct, unnest(ws) AS term, id, dl FROM placed),
dfs AS (SELECT ct, term, count(*) AS df FROM postings GROUP BY ct, term),
raws AS (SELECT ct, term, df, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM dfs JOIN stats USING (ct)),
terms AS (SELECT ct, term, df, CASE WHEN raw < 0 THEN 0.25::DOUBLE * avg(raw) OVER (PARTITION BY ct) ELSE raw END AS idf FROM raws)"""
ASKED_CTE = f"""
asked AS (SELECT query_id, coalesce(contract_type, '*') AS ct,
  unnest(list_distinct(regexp_extract_all(text, {_WORDS}))) AS term FROM q)"""
SCORE_CTE = """
scores AS (
  SELECT query_id, id, round(sum(idf * 2.5::DOUBLE / (1 + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))), 6) AS score
  FROM asked JOIN postings USING (ct, term) JOIN terms USING (ct, term) JOIN stats USING (ct) GROUP BY query_id, id),
bm AS (SELECT query_id, id, score, round(least(0.92::DOUBLE, score / (score + 8)), 4) AS similarity,
  row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS pos FROM scores WHERE score > 0)"""
BM25_CTES = f"{KB_CTE}, {QUERY_CTE}, {INDEX_CTE}, {ASKED_CTE}, {SCORE_CTE}"


def _index(spark, sf, blocks=False):
    return bm25.build_index(kb(spark, sf, deal=True), types=KB_TYPES, blocks=blocks)


@query(
    "x8_x9_tokenize",
    f"""WITH {KB_CTE}, w AS (SELECT id, unnest(list_distinct(regexp_extract_all(text, {_WORDS}))) AS w FROM kb),
    both_forms AS (SELECT id, w AS term FROM w UNION SELECT id, {_STEM} FROM w)
    SELECT id, count(*) AS n_terms, CAST(sum(length(term)) AS BIGINT) AS n_chars, min(term) AS first_term, max(term) AS last_term
    FROM both_forms GROUP BY id""",
)
def tokenize(spark, sf):
    words = kb(spark, sf).select("id", X.tokenize(F.col("text")).alias("t")).filter(F.size("t") > 0)
    chars = F.aggregate("t", F.lit(0).cast("long"), lambda a, w: a + F.length(w))
    return words.select(
        "id", F.size("t").cast("long").alias("n_terms"), chars.alias("n_chars"),
        F.array_min("t").alias("first_term"), F.array_max("t").alias("last_term"),
    )


@query("x9_strip_particle", f"""WITH w AS (
    SELECT unnest([regexp_extract(p_name, '^[a-z]+', 0) || p, substring(p_name, 1, 1) || p]) AS w FROM part,
      (SELECT unnest([{", ".join(f"'{p}'" for p in fv.PARTICLES)}]) AS p))
    SELECT w AS word, {_STEM} AS stem, count(*) AS n FROM w GROUP BY 1, 2""")
def strip_particle(spark, sf):
    """Every particle behind the first word and behind the first letter of each part name."""
    stems = (F.regexp_extract("p_name", "^[a-z]+", 0), F.substring("p_name", 1, 1))
    forms = F.array(*[F.concat(stem, F.lit(p)) for p in fv.PARTICLES for stem in stems])
    words = table(spark, sf, "part", deal=True, rows_per_task=ROWS_PER_TASK).select(F.explode(forms).alias("word"))
    counted = words.groupBy("word").agg(F.count("*").alias("n"))
    # the stem follows from the word, so each word is cut once
    return counted.select("word", X.strip_particles(F.col("word")).alias("stem"), "n")


@query("a5_a23_term_statistics", f"""WITH {KB_CTE}, {INDEX_CTE}
    SELECT ct AS contract_type, term, df, round(idf, 6) AS idf FROM terms""")
def term_statistics(spark, sf):
    return _index(spark, sf).terms.select("contract_type", "term", "df", F.round("idf", 6).alias("idf"))


@query("a5_corpus_statistics", f"""WITH {KB_CTE}, {INDEX_CTE}
    SELECT ct AS contract_type, n AS n_docs, round(avgdl, 6) AS avgdl FROM stats""")
def corpus_statistics(spark, sf):
    return _index(spark, sf).stats.select("contract_type", "n_docs", F.round("avgdl", 6).alias("avgdl"))


@query("so6_common_rows", f"""WITH {KB_CTE} SELECT contract_type, count(*) AS n, count(DISTINCT id) AS n_ids FROM (
    SELECT id, contract_type FROM kb WHERE contract_type <> 'common'
    UNION ALL SELECT id, t.ct FROM kb, (SELECT unnest([{_TYPES}]) AS ct) t WHERE contract_type = 'common') GROUP BY 1""")
def common_rows(spark, sf):
    rows = bm25.replicate_common(kb(spark, sf).select("id", "contract_type"), KB_TYPES)
    return rows.groupBy("contract_type").agg(F.count("*").alias("n"), F.countDistinct("id").alias("n_ids"))


@query("so5_index_types", f"WITH {KB_CTE} SELECT DISTINCT contract_type FROM kb WHERE contract_type <> 'common'")
def index_types(spark, sf):
    return bm25.kb_types(kb(spark, sf))


@query("j6_query_postings", f"""WITH {KB_CTE}, {QUERY_CTE}, {INDEX_CTE}, {ASKED_CTE}
    SELECT query_id, count(DISTINCT term) AS n_terms, count(*) AS n_postings
    FROM asked JOIN postings USING (ct, term) GROUP BY query_id""")
def query_postings(spark, sf):
    lists = bm25.query_postings(benchmark_queries(spark, sf), _index(spark, sf))
    return lists.groupBy("query_id").agg(F.count_distinct("term").alias("n_terms"), F.count("*").alias("n_postings"))


@query("h1_a7_bm25_top5", f"WITH {BM25_CTES} SELECT query_id, id, score, similarity, CAST(pos AS INT) AS pos FROM bm WHERE pos <= 5")
def bm25_top5(spark, sf):
    return bm25.search(benchmark_queries(spark, sf), _index(spark, sf), 5)


@query("h1_bm25_pruned", f"WITH {BM25_CTES} SELECT query_id, id, score, similarity, CAST(pos AS INT) AS pos FROM bm WHERE pos <= {POOL}")
def bm25_pruned(spark, sf):
    """The same search through the plan for query sets too large to broadcast."""
    return bm25.search(benchmark_queries(spark, sf), _index(spark, sf, True), POOL, strategy="pruned")


@query("m1_p12_bm25_similarity", """WITH s AS (SELECT o_orderkey, o_totalprice / 10000 - 10 AS score FROM orders)
    SELECT o_orderkey, round(CASE WHEN score > 0 THEN least(0.92::DOUBLE, score / (score + 8)) ELSE 0 END, 4) AS similarity,
    score > 0 AS is_hit FROM s""")
def bm25_similarity(spark, sf):
    scored = table(spark, sf, "orders").select("o_orderkey", (F.col("o_totalprice") / 10000 - 10).alias("score"))
    return scored.select(
        "o_orderkey", scoring.bm25_similarity(F.col("score")).alias("similarity"), (F.col("score") > 0).alias("is_hit")
    )


_VECTOR_PART = """
vec AS (SELECT CAST(vec_id AS STRING) AS id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
near0 AS (SELECT q.query_id, kb.id, round(list_inner_product(qv.e, kv.e), 6) AS cosine
  FROM q JOIN vec qv ON qv.id = q.query_id, kb JOIN vec kv ON kv.id = kb.id
  WHERE (q.contract_type IS NULL OR kb.contract_type IN (q.contract_type, 'common')) AND q.query_id <> kb.id),
near AS (SELECT query_id, id, cosine, CASE WHEN abs(round(1 - (2 - 2 * cosine) / sqrt(2), 4)) = 0 THEN 0 ELSE round(1 - (2 - 2 * cosine) / sqrt(2), 4) END AS similarity,
  row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, id) AS pos FROM near0)"""
VECTOR_CTES = f"{KB_CTE}, {QUERY_CTE}, {_VECTOR_PART}"


def _vectors(spark, sf):
    return table(spark, sf, "embeddings").selectExpr("CAST(vec_id AS STRING) AS id", "embedding")


@query("h2_j7_vector_top5", f"WITH {VECTOR_CTES} SELECT query_id, id, cosine, similarity, CAST(pos AS INT) AS pos FROM near WHERE pos <= 5")
def vector_top5(spark, sf):
    vec = _vectors(spark, sf)
    asked = benchmark_queries(spark, sf).join(vec.withColumnRenamed("id", "query_id"), "query_id")
    return vectors.search(asked, kb(spark, sf).join(vec, "id"), 5, KB_TYPES, exclude_self=True)


@query("h2_j7_vector_cells_complete", f"WITH {VECTOR_CTES} SELECT query_id, id, cosine, similarity, CAST(pos AS INT) AS pos FROM near WHERE pos <= 5")
def vector_cells_complete(spark, sf):
    """The same hits from an index of cells, completed by the bounds of the cells left out."""
    vec = _vectors(spark, sf)
    asked = benchmark_queries(spark, sf).join(vec.withColumnRenamed("id", "query_id"), "query_id")
    index = vector_cells.build(kb(spark, sf).join(vec, "id"), 5, types=KB_TYPES)
    return vector_cells.search(asked, index, 5, exact=True, exclude_self=True)


@query("j7_vector_cells_recall", """WITH v AS (SELECT vec_id FROM embeddings)
    SELECT count(*) FILTER (vec_id % 50 = 0) AS n_queries, 20 * count(*) FILTER (vec_id % 50 = 0) AS n_true, true AS recall_reached FROM v""")
def vector_cells_recall(spark, sf):
    """Search through the nearest cells only: every 50th vector against all, recall at 20 held against exact search."""
    rows = _vectors(spark, sf).withColumn("contract_type", F.lit("common"))
    asked = rows.filter(F.col("id").cast("long") % 50 == 0).withColumnRenamed("id", "query_id")
    truth = vectors.search(asked, rows, POOL, KB_TYPES, exclude_self=True)
    found = vector_cells.search(asked, vector_cells.build(rows, POOL, types=KB_TYPES), POOL, exclude_self=True)
    both = truth.join(found.select("query_id", "id", F.lit(1).alias("hit")), ["query_id", "id"], "left")
    return both.agg(
        F.count_distinct("query_id").alias("n_queries"),
        F.count("*").alias("n_true"),
        (F.count("hit") >= 0.9 * F.count("*")).alias("recall_reached"),
    )


@query("m2_vector_relevance", """WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)
    SELECT vec_id, round(1 - (2 - 2 * list_inner_product(e, e)) / sqrt(2), 4) AS relevance FROM v""")
def vector_relevance(spark, sf):
    v = table(spark, sf, "embeddings")
    return v.select("vec_id", scoring.vector_relevance(scoring.dot(F.col("embedding"), F.col("embedding"))).alias("relevance"))


COMBINED_CTES = f"""{KB_CTE}, {QUERY_CTE}, {INDEX_CTE}, {ASKED_CTE}, {SCORE_CTE},
{_VECTOR_PART},
sides AS (SELECT query_id, id, similarity, pos, 1 AS side FROM near WHERE pos <= {POOL}
  UNION ALL SELECT query_id, id, similarity, pos, 0 FROM bm WHERE pos <= {POOL}),
fused AS (SELECT query_id, id, sum(1::DOUBLE / (60 + pos)) AS rrf, arg_max(similarity, side) AS similarity FROM sides GROUP BY query_id, id)"""
# first header line and first inline heading are cut before the text is squeezed
_KEY = (
    r"md5(lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, "
    r"'(?m)^\[[^\]]+\]\s*[^\n]+\n', ''), "
    r"'(?m)^[가-힣A-Za-z·\s]+\s*제\s*\d+\s*조(?:의\s*\d+)?\s*\([^)]*\)\s*:?\s*', ''), "
    r"'\*+|#+|`+|[①-⑳㈀-㈎]', ' ', 'g'), '\s+', '', 'g')))"
)
_CATEGORY = sql_map("source", fv.RANK_CATEGORY, "'other'")
DESCRIBED_CTES = f"""{COMBINED_CTES},
hits AS (SELECT query_id, id, source, similarity, {_CATEGORY} AS category,
  round(rrf * CASE {_CATEGORY} WHEN 'law' THEN 3.0::DOUBLE WHEN 'clause' THEN 0.6::DOUBLE ELSE 1 END, 6) AS rrf_score,
  CASE WHEN source = 'law' THEN law_name || '-' || article_no || '-' || sub_no ELSE {_KEY} END AS dedup_key
  FROM fused JOIN kb USING (id))"""


def _stage(name: str, where: str, taken: list[str], limit: str) -> str:
    """Rows of one selection stage: best per key not taken earlier, then the quota."""
    earlier = " UNION ALL ".join(f"SELECT query_id, dedup_key, id FROM {t}" for t in taken)
    blocked = f"WHERE (query_id, dedup_key) NOT IN (SELECT query_id, dedup_key FROM ({earlier}))" if taken else ""
    return f"""{name}_open AS (SELECT * FROM (SELECT * FROM hits WHERE {where}) h {blocked}),
{name}_best AS (SELECT *, row_number() OVER (PARTITION BY query_id, dedup_key ORDER BY rrf_score DESC, id DESC) AS d FROM {name}_open),
{name}_rank AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, id DESC) AS r FROM {name}_best WHERE d = 1),
{name} AS (SELECT * EXCLUDE (d, r) FROM {name}_rank WHERE r <= {limit})"""


_QUOTA = ",\n".join(
    [
        _stage("s_law", "category = 'law'", [], "2"),
        _stage("s_jud", "category = 'judgment'", ["s_law"], "2"),
        _stage("s_cla", "category = 'clause'", ["s_law", "s_jud"], "1"),
        "n_taken AS (SELECT query_id, count(*) AS n FROM (SELECT * FROM s_law UNION ALL SELECT * FROM s_jud UNION ALL SELECT * FROM s_cla) GROUP BY query_id)",
    ]
)
QUOTA_CTES = f"{DESCRIBED_CTES},\n{_QUOTA}"
_REST = ",\n".join(
    [
        _stage("s_fill", "TRUE", ["s_law", "s_jud", "s_cla"], "5 - coalesce((SELECT n FROM n_taken WHERE n_taken.query_id = s_fill_rank.query_id), 0)"),
        "chosen AS (SELECT * FROM s_law UNION ALL SELECT * FROM s_jud UNION ALL SELECT * FROM s_cla UNION ALL SELECT * FROM s_fill)",
        "final AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CASE category WHEN 'law' THEN 0 WHEN 'judgment' THEN 1 WHEN 'clause' THEN 2 ELSE 3 END, rrf_score DESC, id) AS pos FROM chosen)",
    ]
)


SELECTED_CTES = f"{QUOTA_CTES},\n{_REST}"
# the same selection when judgments and clauses are missing, so places stay free
SCARCE_CTES = f"{DESCRIBED_CTES.replace('hits AS (', 'all_hits AS (')},\nhits AS (SELECT * FROM all_hits WHERE category IN ('law', 'other')),\n{_QUOTA},\n{_REST}"


def _pools(spark, sf):
    base = kb(spark, sf)
    asked = benchmark_queries(spark, sf)
    vec = _vectors(spark, sf)
    near = vectors.search(
        asked.join(vec.withColumnRenamed("id", "query_id"), "query_id"), base.join(vec, "id"), POOL, KB_TYPES, exclude_self=True
    )
    return base, near, bm25.search(asked, _index(spark, sf), POOL)


@query("a6_j8_rrf_scores", f"WITH {COMBINED_CTES} SELECT query_id, id, round(rrf, 6) AS rrf, similarity FROM fused")
def rrf_scores(spark, sf):
    _, near, words = _pools(spark, sf)
    return fusion.combine(near, words).select("query_id", "id", F.round("rrf", 6).alias("rrf"), "similarity")


@query("j9_m3_x18_weighted_hits", f"WITH {DESCRIBED_CTES} SELECT query_id, id, source, category, similarity, rrf_score, dedup_key FROM hits")
def weighted_hits(spark, sf):
    base, near, words = _pools(spark, sf)
    return fusion.describe(fusion.combine(near, words), base)


@query("w3_quota_only", f"""WITH {QUOTA_CTES}
    SELECT query_id, id, category, rrf_score FROM (SELECT * FROM s_law UNION ALL SELECT * FROM s_jud UNION ALL SELECT * FROM s_cla)""")
def quota_only(spark, sf):
    base, near, words = _pools(spark, sf)
    hits = fusion.describe(fusion.combine(near, words), base).filter(F.col("category") != "other")
    # without the fill stage: at most the quota per category
    full = fusion.select_by_quota(hits, sum(n for _, n in fv.CATEGORY_QUOTA), fill=False)
    return full.select("query_id", "id", "category", "rrf_score")


@query("w4_dedup_hits", f"""WITH {DESCRIBED_CTES} SELECT query_id, dedup_key, id FROM (SELECT *, row_number() OVER
    (PARTITION BY query_id, dedup_key ORDER BY rrf_score DESC, id DESC) AS d FROM hits) WHERE d = 1""")
def dedup_hits(spark, sf):
    base, near, words = _pools(spark, sf)
    hits = fusion.describe(fusion.combine(near, words), base)
    return hits.groupBy("query_id", "dedup_key").agg(F.max(F.struct("rrf_score", "id")).alias("best")).select(
        "query_id", "dedup_key", "best.id"
    )


@query("so7_w8_fill", f"WITH {SCARCE_CTES} SELECT query_id, id, category, rrf_score FROM s_fill")
def fill(spark, sf):
    base, near, words = _pools(spark, sf)
    hits = fusion.describe(fusion.combine(near, words), base)
    scarce = hits.filter(F.col("category").isin("law", "other"))
    return fusion.select_by_quota(scarce, 5).filter("filled").select("query_id", "id", "category", "rrf_score")


@query("h4_h3_t1_hybrid_top5", f"WITH {SELECTED_CTES} SELECT query_id, CAST(pos AS INT) AS pos, id, source, category, similarity, rrf_score FROM final WHERE pos <= 5")
def hybrid_top5(spark, sf):
    asked = benchmark_queries(spark, sf)
    vec = _vectors(spark, sf)
    return retrieval.hybrid_search(
        asked, vec.withColumnRenamed("id", "query_id"), kb(spark, sf), vec, _index(spark, sf), 5,
        types=KB_TYPES, exclude_self=True,
    ).select("query_id", "pos", "id", "source", "category", "similarity", "rrf_score")


@query("u3_vectorised_texts", """SELECT CAST(doc_id AS VARCHAR) AS id, CAST(length(text) - length(replace(text, 'e', '')) AS DOUBLE) AS n_e,
    CAST(length(text) - length(replace(text, 'n', '')) AS DOUBLE) AS n_n, CAST(length(text) AS DOUBLE) AS n FROM documents""")
def vectorised_texts(spark, sf):
    """A caller's vectoriser run in batches over all texts."""

    def letters(texts):
        return [[text.count("e"), text.count("n"), len(text)] for text in texts]

    rows = kb(spark, sf).select("id", "text").mapInPandas(vectors.as_batches(letters), "id string, embedding array<float>")
    return rows.select("id", *[F.col("embedding")[i].cast("double").alias(name) for i, name in enumerate(("n_e", "n_n", "n"))])
