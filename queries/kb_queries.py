"""Knowledge-base build: routing, caps, deduplication, counts, upsert."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from clausewise import fixed_values as fv
from clausewise.functions import text as X
from clausewise.operators import bm25, fusion, rollups
from clausewise.operators.dedup import dedup_corpus, source_priority
from clausewise.operators.skew import top_n
from clausewise.plans import kb_build
from clausewise.session import scratch_dir, write_shared
from clausewise.sources import index_store, kb_files, stores
from queries.base import KB_CTE, KB_TYPES, QUERY_CTE, benchmark_queries, kb, query, sql_map, table
from queries.search_queries import BM25_CTES

LAW_MAP = {"Brand#1": ["lease", "sales"], "Brand#2": ["service"], "Brand#3": ["loan", "lease", "employment"], "민법": ["lease", "sales", "service", "loan"]}
RANGES = {"lease": (1, 20), "sales": (15, 30), "service": (31, 40), "loan": (41, 50)}
_LAW_ROWS = ", ".join(f"('{law}', '{ct}')" for law, types in LAW_MAP.items() for ct in types)
_RANGE_ROWS = ", ".join(f"('{ct}', {lo}, {hi})" for ct, (lo, hi) in RANGES.items())
# parts as statute articles; one brand in five stands for the civil code
_ARTICLES = [
    "p_partkey",
    "CASE WHEN p_partkey % 5 = 0 THEN '민법' ELSE p_brand END AS law_name",
    "CASE WHEN p_partkey % 3 = 0 THEN '시행령' ELSE '법률' END AS law_kind",
    "p_size AS article_no",
]


@query("j1_law_fan_out", f"""WITH a AS (SELECT {', '.join(_ARTICLES)} FROM part), m(law_name, contract_type) AS (VALUES {_LAW_ROWS})
    SELECT p_partkey, law_name, contract_type FROM a JOIN m USING (law_name)""")
def law_fan_out(spark, sf):
    everywhere = {ct: (0, 10**6) for types in LAW_MAP.values() for ct in types}
    articles = table(spark, sf, "part").selectExpr(*_ARTICLES)
    return kb_files.route_articles(articles, LAW_MAP, everywhere).select("p_partkey", "law_name", "contract_type")


@query("j2_p14_range_routing", f"""WITH a AS (SELECT {', '.join(_ARTICLES)} FROM part), m(law_name, contract_type) AS (VALUES {_LAW_ROWS}),
    r(contract_type, lo, hi) AS (VALUES {_RANGE_ROWS})
    SELECT p_partkey, law_name, law_kind, article_no, contract_type FROM a JOIN m USING (law_name) LEFT JOIN r USING (contract_type)
    WHERE NOT (law_name = '민법' AND law_kind = '법률') OR article_no BETWEEN lo AND hi""")
def range_routing(spark, sf):
    articles = table(spark, sf, "part").selectExpr(*_ARTICLES)
    return kb_files.route_articles(articles, LAW_MAP, RANGES).select(
        "p_partkey", "law_name", "law_kind", "article_no", "contract_type"
    )


@query("w6_cap_per_type", f"""WITH {KB_CTE} SELECT id, contract_type, CAST(pos AS INT) AS pos FROM (SELECT id, contract_type,
    row_number() OVER (PARTITION BY contract_type ORDER BY id) AS pos FROM kb) WHERE pos <= 1500""")
def cap_per_type(spark, sf):
    rows = kb(spark, sf).select("id", "contract_type")
    return top_n(rows, ["contract_type"], [F.asc("id")], 1500, spread_by=["id"])


@query("w6_cap_bites", f"""WITH {KB_CTE} SELECT id, contract_type, CAST(pos AS INT) AS pos FROM (SELECT id, contract_type,
    row_number() OVER (PARTITION BY contract_type ORDER BY id) AS pos FROM kb) WHERE pos <= 50""")
def cap_bites(spark, sf):
    """The same cap at a number that every contract type exceeds."""
    rows = kb(spark, sf).select("id", "contract_type")
    return top_n(rows, ["contract_type"], [F.asc("id")], 50, spread_by=["id"])


_PRIORITY = "CASE WHEN source = 'law' THEN 1 WHEN source = 'precedent_kr' THEN 2 WHEN source LIKE 'aihub%' THEN 3 ELSE 0 END"
_NORM = r"lower(trim(regexp_replace(regexp_replace(text, '(?m)^\[(?:법률|판례)\][^\n]*\n', ''), '\s+', ' ', 'g')))"


def _dedup_sql(scope: str) -> str:
    part = "norm, contract_type" if scope else "norm"
    return f"""WITH {KB_CTE}, n AS (SELECT *, {_PRIORITY} AS p, {_NORM} AS norm FROM kb),
    r AS (SELECT *, row_number() OVER (PARTITION BY {part} ORDER BY p, id) AS d FROM n)
    SELECT id, source, contract_type FROM r WHERE d = 1 OR length(norm) < 50"""


@query("w7_a22_corpus_dedup", _dedup_sql(""))
def corpus_dedup(spark, sf):
    return dedup_corpus(kb(spark, sf, deal=True), ["id"]).select("id", "source", "contract_type")


@query("w7_corpus_dedup_per_type", _dedup_sql("type"))
def corpus_dedup_per_type(spark, sf):
    return dedup_corpus(kb(spark, sf, deal=True), ["id"], scope="per_type").select("id", "source", "contract_type")


@query("so1_h6_united_build", f"""WITH {KB_CTE}, u AS (SELECT id, text, source, contract_type, 0 AS src_ord FROM kb
      UNION ALL SELECT 'page-' || CAST(page_id AS STRING), html, '실무', 'common', 1 FROM pages
      UNION ALL SELECT 'again-' || id, text, '기타', contract_type, 2 FROM kb),
    n AS (SELECT *, {_PRIORITY} AS p, {_NORM} AS norm FROM u),
    r AS (SELECT *, row_number() OVER (PARTITION BY norm ORDER BY p, src_ord, id) AS d FROM n)
    SELECT id, source, contract_type FROM r WHERE d = 1 OR length(norm) < 50""")
def united_build(spark, sf):
    """Three sources united, the last a copy of the first with other ids."""
    first = kb(spark, sf).select("id", "text", "source", "contract_type")
    pages = table(spark, sf, "pages").selectExpr(
        "'page-' || CAST(page_id AS STRING) AS id", "html AS text", "'실무' AS source", "'common' AS contract_type"
    )
    again = first.select(F.concat(F.lit("again-"), "id").alias("id"), "text", F.lit("기타").alias("source"), "contract_type")
    return dedup_corpus(kb_build.unite([first, pages, again]), ["src_ord", "id"]).select("id", "source", "contract_type")


@query("so2_judgment_sections", """WITH s AS (SELECT doc_id, trim(text, e' \\t\\n\\r') AS t, text FROM documents WHERE contains(text, 'the') OR contains(text, 'la')),
    c AS (SELECT doc_id, t, length(t) AS n FROM s WHERE length(t) > 0)
    SELECT doc_id, 'dcss' AS section, count(*) AS n_rows FROM (SELECT doc_id, unnest(range(0, CASE WHEN n <= 1500 THEN 1 ELSE CAST(ceil((n - 1500) / 1350.0) AS BIGINT) + 1 END)) FROM c) GROUP BY 1
    UNION ALL SELECT doc_id, 'facts', 1 FROM c""")
def judgment_sections(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    routed = docs.filter(X.contains_any(F.col("text"), ["the", "la"]))
    chunked = routed.select("doc_id", F.explode(X.chunk(F.col("text"))).alias("body"))
    reasoning = chunked.groupBy("doc_id").agg(F.count("*").alias("n_rows")).withColumn("section", F.lit("dcss"))
    facts = routed.filter(~X.is_blank(F.col("text"))).select("doc_id", F.lit(1).cast("long").alias("n_rows"), F.lit("facts").alias("section"))
    return reasoning.unionByName(facts)


_SEED = ["id", "text", "source", "contract_type", "law_name AS topic"]


@query("s1_seed_rows", f"WITH {KB_CTE} SELECT id, source, contract_type, law_name AS topic, length(text) AS n FROM kb")
def seed_rows(spark, sf):
    rows = kb_files.kb_rows(kb(spark, sf).selectExpr(*_SEED))
    return rows.select("id", "source", "contract_type", "topic", F.length("text").cast("long").alias("n"))


@query("s6_a11_build_counts", f"""WITH {KB_CTE} SELECT NULL AS law_kind, NULL AS law_name, contract_type, count(*) AS n, 1 AS is_type_total FROM kb GROUP BY contract_type
    UNION ALL SELECT law_kind, law_name, contract_type, count(*), 0 FROM kb GROUP BY ALL""")
def build_counts(spark, sf):
    return rollups.build_counts(kb(spark, sf)).withColumn("is_type_total", F.col("is_type_total").cast("int"))


@query("a8_count_by_source", f"WITH {KB_CTE} SELECT coalesce(source, 'unknown') AS source, count(*) AS n FROM kb GROUP BY 1")
def count_by_source(spark, sf):
    return rollups.count_by_source(kb(spark, sf))


@query("a9_collection_status", f"WITH {KB_CTE} SELECT count(*) AS document_count, CASE WHEN count(*) > 0 THEN 'ready' ELSE 'empty' END AS status FROM kb")
def collection_status(spark, sf):
    return rollups.collection_status(kb(spark, sf))


_REPORT = sql_map("source", fv.REPORT_CATEGORY, "'law'")


@query("a10_category_totals", f"""WITH {KB_CTE} SELECT count(*) AS total, count(*) FILTER (WHERE {_REPORT} = 'law') AS laws,
    count(*) FILTER (WHERE {_REPORT} = 'judgment') AS judgments, count(*) FILTER (WHERE {_REPORT} = 'clause') AS clauses FROM kb""")
def category_totals(spark, sf):
    return rollups.category_totals(kb(spark, sf))


@query("j10_report_category", f"WITH {KB_CTE} SELECT id, {_REPORT} AS category FROM kb")
def report_category(spark, sf):
    return kb(spark, sf).select("id", fusion.report_category(F.col("source")).alias("category"))


@query("source_priority", f"WITH {KB_CTE} SELECT id, {_PRIORITY} AS priority FROM kb")
def priority(spark, sf):
    return kb(spark, sf).select("id", source_priority(F.col("source")).alias("priority"))


@query("s8_upsert", f"""WITH {KB_CTE}, batch AS (SELECT id, CASE WHEN id LIKE '%3' THEN 'lease' ELSE contract_type END AS contract_type, upper(text) AS text, 2 AS version FROM kb WHERE contract_type = 'sales'
      UNION ALL SELECT 'new-' || id, contract_type, text, 2 FROM kb WHERE contract_type = 'employment')
    SELECT id, contract_type, version, length(text) AS n FROM batch UNION ALL
    SELECT id, contract_type, 1, length(text) FROM kb WHERE id NOT IN (SELECT id FROM batch)""")
def upsert(spark, sf):
    """A stored KB, merged with a batch that holds changed rows, rows that move to another type, and new ones twice."""
    base = kb(spark, sf).select("id", "contract_type", "text")
    path = f"{scratch_dir(spark)}/kb-{uuid.uuid4().hex}"
    stores.write_kb(base.withColumn("version", F.lit(1)), path)
    moved = F.when(F.col("id").like("%3"), "lease").otherwise(F.col("contract_type"))
    changed = base.filter("contract_type = 'sales'").select("id", moved.alias("contract_type"), F.upper("text").alias("text"))
    fresh = base.filter("contract_type = 'employment'").withColumn("id", F.concat(F.lit("new-"), "id"))
    older = fresh.withColumn("text", F.lit("old")).withColumn("version", F.lit(1))
    batch = changed.unionByName(fresh).withColumn("version", F.lit(2)).unionByName(older)
    stores.upsert_kb(spark, path, batch, version="version")
    return spark.read.parquet(path).select("id", "contract_type", "version", F.length("text").cast("long").alias("n"))


@query("s9_clear_and_rebuild", f"WITH {KB_CTE} SELECT id, contract_type FROM kb WHERE contract_type <> 'sales'")
def clear_and_rebuild(spark, sf):
    """A stored KB written anew without one of its types: nothing of the first build is left."""
    rows = kb(spark, sf).select("id", "contract_type", "text")
    path = f"{scratch_dir(spark)}/kb-{uuid.uuid4().hex}"
    stores.write_kb(rows, path)
    stores.write_kb(rows.filter("contract_type <> 'sales'"), path)
    return spark.read.parquet(path).select("id", "contract_type")


# a small file costs milliseconds, whatever it holds
FILES_PER_TASK = 1_000


@query("s6_p7_labelled_counts", """WITH c AS (SELECT CASE s_nationkey % 3 WHEN 0 THEN 'lease' WHEN 1 THEN 'sales' END AS contract_type FROM supplier WHERE s_suppkey % 2 = 0)
    SELECT contract_type, 2 * count(*) AS n FROM c WHERE contract_type IS NOT NULL GROUP BY 1""")
def labelled_counts(spark, sf):
    """The combined source over one JSON file for each supplier, counted by type.

    Half of the files lie in the civil folder, the others are not read; of those a third names no contract type. A
    case has a row for its facts and one for its reasons.
    """
    place = f"{scratch_dir(spark)}/labelled-{uuid.uuid4().hex}"
    name = "CASE s_nationkey % 3 WHEN 0 THEN '임대차 분쟁' WHEN 1 THEN '매매 분쟁' ELSE '기타' END"
    cases = table(spark, sf, "supplier").select(
        F.struct(
            F.expr(name).alias("caseNm"), F.col("s_suppkey").cast("string").alias("caseNo"),
            F.col("s_name").alias("courtNm"), F.array(F.lit("상법")).alias("relateLaword"),
        ).alias("info"),
        F.col("s_name").alias("facts"),
        F.struct(F.array("s_name").alias("a")).alias("dcss"),
        F.when(F.col("s_suppkey") % 2 == 0, fv.CIVIL_DIR).otherwise("형사").alias("kind"),
        F.col("s_suppkey").alias("file"),
    )
    # a file holds one object, so a key that repeats has one
    files = cases.groupBy("kind", "file").agg(F.min(F.struct("info", "facts", "dcss")).alias("case")).select("kind", "case.*")
    pieces = files.repartition(max(spark.sparkContext.defaultParallelism, -(-cases.count() // FILES_PER_TASK)))
    # the rows of a task go to a file each in two folders, and tasks put them in place: the driver would move one after another
    writer = pieces.write.partitionBy("kind").option("maxRecordsPerFile", 1)
    writer.option("mapreduce.fileoutputcommitter.algorithm.version", "2").json(place)
    rows = kb_build.collect_sources(spark, labelled=place)
    return rows.groupBy("contract_type").agg(F.count("*").alias("n"))


@query("s10_indexed_types", f"WITH {KB_CTE} SELECT contract_type, count(*) AS n FROM kb WHERE contract_type IN ('lease', 'none') GROUP BY 1")
def indexed_types(spark, sf):
    """A stored index, read for two types; one that was never stored is an empty scan, not an error."""
    path = f"{scratch_dir(spark)}/index-{uuid.uuid4().hex}"
    stores.write_index(bm25.build_index(kb(spark, sf), types=KB_TYPES), path)
    found = stores.read_index(spark, path, ["lease", "none"], KB_TYPES).postings.filter("shelf <> 'common'")
    return found.groupBy(F.col("shelf").alias("contract_type")).agg(F.count_distinct("id").alias("n"))


CHANGED = "CASE WHEN CAST(id AS INT) % 20 = 7 THEN 'lease' ELSE contract_type END"
_CHANGED_SQL = f"""after AS (
  SELECT id, contract_type, text FROM kb WHERE CAST(id AS INT) % 10 <> 7 AND CAST(id AS INT) % 25 <> 3
  UNION ALL SELECT id, {CHANGED}, text || ' ' || source || ' amended' FROM kb WHERE CAST(id AS INT) % 10 = 7
  UNION ALL SELECT 'new-' || id, contract_type, text FROM kb WHERE CAST(id AS INT) % 50 = 1)"""


@query("s8_s10_index_follows_upserts", f"""WITH {BM25_CTES.replace("kb AS (", "kb_before AS (", 1).replace(QUERY_CTE, _CHANGED_SQL.replace("FROM kb", "FROM kb_before") + ", kb AS (SELECT * FROM after), " + QUERY_CTE)}
    SELECT query_id, id, score, CAST(pos AS INT) AS pos FROM bm WHERE pos <= 20""")
def index_follows_upserts(spark, sf):
    """A stored index after three batches: changed rows (half of them under another type), removed rows, new rows.

    Its hits are those of an index built over the final rows.
    """
    rows = kb(spark, sf, deal=True).select("id", "contract_type", "text", "source")
    number = F.col("id").cast("int")
    path = f"{scratch_dir(spark)}/index-{uuid.uuid4().hex}"
    index_store.create(rows, path, KB_TYPES)
    changed = rows.filter(number % 10 == 7).select(
        "id", F.expr(CHANGED).alias("contract_type"), F.concat("text", F.lit(" "), "source", F.lit(" amended")).alias("text")
    )
    passing = changed.withColumn("text", F.lit("a text that is replaced again"))
    index_store.upsert(spark, path, passing, types=KB_TYPES)
    gone = rows.filter((number % 25 == 3) & (number % 10 != 7)).select("id")
    index_store.upsert(spark, path, changed, removed=gone, types=KB_TYPES)
    fresh = rows.filter(number % 50 == 1).withColumn("id", F.concat(F.lit("new-"), "id"))
    index_store.upsert(spark, path, fresh, types=KB_TYPES)
    found = bm25.search(benchmark_queries(spark, sf), index_store.read(spark, path, types=KB_TYPES), 20)
    return found.select("query_id", "id", "score", "pos")


@query("t9_path_order", "SELECT page_id, row_number() OVER (ORDER BY url, page_id) AS ord FROM pages")
def path_order(spark, sf):
    """Rank in path order from range-partitioned pieces: no single task sees all rows."""
    pages = table(spark, sf, "pages").select("page_id", "url")
    parts = pages.repartitionByRange("url", "page_id").withColumn("_part", F.spark_partition_id())
    tagged = write_shared(parts, "path-order")  # fixes which piece a row belongs to
    sizes = tagged.groupBy("_part").agg(F.count("*").alias("_n"))
    # one row per piece
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    local = F.row_number().over(Window.partitionBy("_part").orderBy("url", "page_id"))
    return tagged.withColumn("_local", local).join(F.broadcast(before), "_part").select(
        "page_id", (F.col("_before") + F.col("_local")).alias("ord")
    )
