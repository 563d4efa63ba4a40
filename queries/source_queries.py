"""Knowledge-base sources parsed from files written out of the driver's tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from clausewise import fixed_values as fv
from clausewise.functions import markdown as M
from clausewise.session import scratch_dir
from clausewise.sources import index_store, kb_files, stores
from clausewise.streaming import flows
from queries.base import CLAUSES_CTE, CONTRACTS_CTE, KB_TYPES, QUERY_CTE, ROWS_PER_TASK, RULED_CTE, contracts, kb, query, table
from queries.search_queries import SELECTED_CTES
from queries.text_queries import best_label_sql

_TRIM = r"trim(text, e' \t\n\r')"
_FILE = "CASE doc_id % 3 WHEN 0 THEN '임대차_' WHEN 1 THEN '매매계약_' ELSE '기타_' END || CAST(doc_id AS STRING) || '.json'"


@query("s2_standard_clauses", f"""WITH c AS (SELECT doc_id, {_FILE} AS filename, CASE WHEN doc_id % 2 = 0 THEN '불리' ELSE '유리' END AS advantage,
      CASE doc_id % 3 WHEN 0 THEN 'lease' ELSE 'sales' END AS contract_type, {_TRIM} AS t, source FROM documents WHERE doc_id % 3 < 2),
    r AS (SELECT *, ('[약관-' || advantage || '] ' || t || chr(10) || '판단근거: ' || source || chr(10) || '둘째' || chr(10) || '관련법령: ' || source) AS text FROM c WHERE length(t) >= 10)
    SELECT 'clause-' || substring(sha1(text), 1, 16) AS id, text, filename, advantage, contract_type, CAST(0 AS INT) AS article_idx FROM r""")
def standard_clauses(spark, sf):
    """Lists and scalars alike; files whose name says nothing are left out by the reader."""
    files = table(spark, sf, "documents", deal=True).select(
        F.expr(_FILE).alias("filename"),
        F.col("doc_id").cast("string").alias("src_path"),
        F.when(F.col("doc_id") % 3 == 0, F.to_json(F.array("text", F.lit("짧음")))).otherwise(F.to_json(F.array("text"))).alias("clauseArticle"),
        F.to_json(F.array("source", F.lit("둘째"))).alias("illdcssBasiss"),
        F.col("source").alias("relateLaword"),
        F.when(F.col("doc_id") % 2 == 0, "2").otherwise("1").alias("dvAntageous"),
    )
    return kb_files.clause_rows(files).select("id", "text", "filename", "advantage", "contract_type", "article_idx")


@query("s3_judgments", f"""WITH c AS (SELECT doc_id, CASE lang WHEN 'en' THEN '임대차 분쟁' ELSE '매매 분쟁' END AS case_name, source AS court,
      CASE lang WHEN 'en' THEN 'lease' ELSE 'sales' END AS contract_type, {_TRIM} AS t FROM documents WHERE lang IN ('en', 'fr')),
    s AS (SELECT *, unnest(range(0, CASE WHEN length(t) <= 1500 THEN 1 ELSE CAST(ceil((length(t) - 1500) / 1350.0) AS BIGINT) + 1 END)) AS i FROM c WHERE length(t) > 0),
    r AS (SELECT 'judgment-dcss' AS p, '판단' AS section, CAST(i AS INT) AS chunk_idx, contract_type, '[판결문] ' || court || ' ' || doc_id || ' - ' || case_name || chr(10) || '판단: ' || substring(t, i * 1350 + 1, 1500) || chr(10) || '관련법령: 민법 상법' AS text FROM s
      UNION ALL SELECT 'judgment-facts', '기초사실', CAST(i AS INT), contract_type, '[판결문] ' || court || ' ' || doc_id || ' - ' || case_name || chr(10) || '기초사실: ' || substring(t, i * 1350 + 1, 1500) || chr(10) || '관련법령: 민법 상법' FROM s)
    SELECT p || '-' || substring(sha1(text), 1, 16) AS id, text, section, chunk_idx, contract_type FROM r""")
def judgments(spark, sf):
    name = "CASE lang WHEN 'en' THEN '임대차 분쟁' WHEN 'fr' THEN '매매 분쟁' ELSE '기타' END"
    cases = table(spark, sf, "documents", deal=True).select(
        F.col("doc_id").cast("string").alias("src_path"),
        F.struct(
            F.expr(name).alias("caseNm"), F.col("doc_id").cast("string").alias("caseNo"), F.col("source").alias("courtNm"),
            F.lit('["민법","상법"]').alias("relateLaword"),
        ).alias("info"),
        F.col("text").alias("facts"),
        F.to_json(F.create_map(F.lit("a"), F.array("text"))).alias("dcss"),
    )
    return kb_files.judgment_rows(cases).select("id", "text", "section", "chunk_idx", "contract_type")


_LAW = "CASE p_partkey % 3 WHEN 0 THEN '민법' WHEN 1 THEN '이자제한법' ELSE '약관의규제에관한법률' END"
_KIND = "CASE WHEN p_partkey % 2 = 0 THEN '법률' ELSE '시행령' END"
_NO = "p_partkey % 700"
_BODY = "p_name || ' 에 관하여 필요한 사항을 정하는 조문이다.'"
_TYPES = ", ".join(f"('{law}', '{ct}')" for law in ("민법", "이자제한법", "약관의규제에관한법률") for ct in fv.LAW_CONTRACT_TYPES[law])
_RANGES = " OR ".join(f"(contract_type = '{ct}' AND no BETWEEN {lo} AND {hi})" for ct, (lo, hi) in fv.CIVIL_CODE_RANGES.items())


@query("s4_x11_statutes", f"""WITH a AS (SELECT p_partkey, {_LAW} AS law_name, {_KIND} AS law_kind, {_NO} AS no, p_type, {_BODY} AS body FROM part WHERE p_partkey % 7 <> 0),
    m(law_name, contract_type) AS (VALUES {_TYPES}), r AS (SELECT * FROM a JOIN m USING (law_name) WHERE NOT (law_name = '민법' AND law_kind = '법률') OR {_RANGES}),
    t AS (SELECT *, '[' || law_kind || '] ' || law_name || CASE WHEN law_kind = '법률' THEN '' ELSE ' ' || law_kind END || ' 제' || no || '조의2 (' || p_type || ')' || chr(10) || body AS text FROM r)
    SELECT 'law-' || contract_type || '-' || law_kind || '-' || substring(sha1(text), 1, 16) AS id, text, law_name, law_kind, CAST(no AS INT) AS article_no, CAST(2 AS INT) AS sub_no, contract_type FROM t""")
def statutes(spark, sf):
    """One statute file per part: front matter, a chapter line, one article, an appendix."""
    status = "CASE WHEN p_partkey % 7 = 0 THEN '폐지' ELSE '시행' END"
    md = (
        f"'---' || chr(10) || '상태: ' || {status} || chr(10) || '시행일자: 2024-01-01' || chr(10) || '---' || chr(10) || '# 머리' || chr(10) || "
        f"'##### 제' || CAST({_NO} AS STRING) || '조의2 (' || p_type || ') 남은 글' || chr(10) || {_BODY} || chr(10) || '## 부칙' || chr(10) || '버리는 글'"
    )
    files = table(spark, sf, "part", deal=True, rows_per_task=ROWS_PER_TASK).selectExpr(
        f"{md} AS md", f"{_LAW} AS law_name", f"{_KIND} AS law_kind", "CAST(p_partkey AS STRING) AS src_path"
    )
    return kb_files.law_rows(files).select("id", "text", "law_name", "law_kind", "article_no", "sub_no", "contract_type")


@query("s5_precedents", f"""WITH c AS (SELECT doc_id, lang, source, CASE lang WHEN 'en' THEN 'lease' WHEN 'fr' THEN 'sales' ELSE 'loan' END AS contract_type, {_TRIM} AS t FROM documents WHERE lang <> 'es'),
    w AS (SELECT *, CASE lang WHEN 'en' THEN '임대차 보증금 차임' WHEN 'fr' THEN '매매 매도인 잔금' ELSE '대여금 소비대차 보증채무' END AS words FROM c),
    k AS (SELECT * FROM w WHERE length(words || chr(10) || trim(t || ' 요지의 끝을 알리는 문장으로 길이를 채운다') || chr(10) || '민법 제1조') >= 50),
    r AS (SELECT *, ('[판례] ' || source || ' ' || doc_id || ' (2020-01-01) - 사건' || chr(10) || '판시사항: ' || words || chr(10) || '판결요지: ' || trim(t || ' 요지의 끝을 알리는 문장으로 길이를 채운다') || chr(10) || '참조조문: 민법 제1조') AS text FROM k)
    SELECT 'prec-' || contract_type || '-' || substring(sha1(text), 1, 16) AS id, text, contract_type, CAST(doc_id AS STRING) AS case_no FROM r""")
def precedents(spark, sf):
    words = "CASE lang WHEN 'en' THEN '임대차 보증금 차임' WHEN 'fr' THEN '매매 매도인 잔금' WHEN 'de' THEN '대여금 소비대차 보증채무' ELSE '무관' END"
    head = "'---' || chr(10) || '사건명: 사건' || chr(10) || '사건번호: ' || CAST(doc_id AS STRING) || chr(10) || '법원명: ' || source || chr(10) || '선고일자: 2020-01-01' || chr(10) || '---' || chr(10)"
    text = r"trim(BOTH ' \t\n\r' FROM text)"
    md = (
        f"{head} || '## 판시사항' || chr(10) || {words} || chr(10) || '## 판결요지' || chr(10) || {text} || ' 요지의 끝을 알리는 문장으로 길이를 채운다' || chr(10) || "
        "'## 참조조문' || chr(10) || '민법 제1조' || chr(10) || '## 판례내용' || chr(10) || '버리는 글'"
    )
    files = table(spark, sf, "documents", deal=True).selectExpr(f"{md} AS md", "CAST(doc_id AS STRING) AS src_path")
    return kb_files.precedent_rows(files, 0).select("id", "text", "contract_type", "case_no")


@query("x11_x13_front_matter", "SELECT p_partkey, '값 ' || p_brand AS title, p_partkey % 700 AS article_no FROM part")
def front_matter(spark, sf):
    md = f"'---' || chr(10) || '제목: ''값 ' || p_brand || '''' || chr(10) || '---' || chr(10) || '##### 제' || CAST({_NO} AS STRING) || '조 (가)' || chr(10) || p_name"
    files = table(spark, sf, "part", deal=True, rows_per_task=ROWS_PER_TASK).selectExpr("p_partkey", f"{md} AS md")
    articles = M.law_articles(M.after_front_matter(F.col("md")))
    return files.select(
        "p_partkey", M.value(M.front_matter(F.col("md")), "제목").alias("title"),
        F.element_at(articles, 1)["article_no"].cast("long").alias("article_no"),
    )


# --- stored tables and streams, written from the driver's tables and read back ---------------------------


def _place(spark, label):
    return f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"


# the stream goes by the type it detects
_DETECTED_CTE = f"""types AS (SELECT document_id, {best_label_sql('text', fv.CONTRACT_TYPE_KEYWORDS)} AS contract_type FROM contracts),
{CLAUSES_CTE.replace("clauses AS (", "written AS (", 1)},
clauses AS (SELECT w.* EXCLUDE (contract_type), t.contract_type FROM written w JOIN types t USING (document_id))"""


@query("st1_review_stream", f"""WITH {CONTRACTS_CTE}, {_DETECTED_CTE}, {RULED_CTE}
    SELECT CAST(document_id AS VARCHAR) AS document_id, clause_pos, clause_index, title, content, safe_reason, high_reason, high_risk_type, verdict_source FROM verdicts""")
def review_stream(spark, sf):
    """Contracts that arrive as files, split and judged by the stream until all are read."""
    place = _place(spark, "st1")
    arriving = contracts(spark, sf, typed=False).select(
        F.col("document_id").cast("string").alias("document_id"), F.lit("a.pdf").alias("filename"), "text"
    )
    arriving.write.parquet(f"{place}/in")
    flows.start_review(flows.contract_stream(spark, f"{place}/in"), f"{place}/out", f"{place}/state", once=True).awaitTermination()
    return spark.read.parquet(f"{place}/out").select(
        "document_id", "clause_pos", "clause_index", "title", "content", "safe_reason", "high_reason", "high_risk_type", "verdict_source"
    )


_LEASES = "(SELECT item_id, text, CASE WHEN item_id % 2 = 0 THEN 'lease' ELSE 'none' END AS contract_type FROM benchmark WHERE item_id % 2 = 0)"
_STREAM_HITS = SELECTED_CTES.replace(
    QUERY_CTE, f"q AS (SELECT CAST(item_id AS STRING) AS query_id, text, contract_type FROM {_LEASES})"
).replace("FROM near0)", "FROM near0 WHERE false)")


@query("st1_retrieval_stream", f"""WITH {_STREAM_HITS} SELECT query_id AS document_id, id, category, rrf_score, CAST(pos AS INT) AS pos, 'model' AS verdict_source
    FROM final WHERE pos <= 5""")
def retrieval_stream(spark, sf):
    """Leases whose only clause is a benchmark text, arriving in two batches, searched in a stored index as they come."""
    place = _place(spark, "st1-hits")
    rows = kb(spark, sf, deal=True)
    stores.write_kb(rows, f"{place}/kb")
    index_store.create(rows, f"{place}/index", KB_TYPES)
    head = "'주택 임대차 계약서' || chr(10) || '임대인(갑)과 임차인(을)은 아래와 같이 임대차 계약한다.' || chr(10) || '제1조 (목적)' || chr(10)"
    arriving = table(spark, sf, "benchmark").filter("item_id % 2 = 0").selectExpr(
        "CAST(item_id AS STRING) AS document_id", "'a.pdf' AS filename", f"{head} || text AS text"
    )
    arriving.repartition(2, "document_id").write.parquet(f"{place}/in")
    stream = flows.contract_stream(spark, f"{place}/in", files_per_batch=1)
    flows.start_retrieval(stream, f"{place}/kb", f"{place}/index", f"{place}/out", f"{place}/state", types=KB_TYPES, once=True).awaitTermination()
    clauses = spark.read.parquet(f"{place}/out/clauses").select("document_id", "clause_pos", "verdict_source")
    hits = spark.read.parquet(f"{place}/out/hits").join(clauses, ["document_id", "clause_pos"])
    return hits.select("document_id", "id", "category", "rrf_score", F.col("merged_pos").alias("pos"), "verdict_source")


@query("st2_override_stream", """WITH e AS (SELECT CAST(user_id AS VARCHAR) AS document_id, CAST(floor(value) AS INT) % 5 AS clause_pos, event_type, ts FROM events),
    l AS (SELECT document_id, clause_pos, max(ts) AS ts, arg_max(event_type, struct_pack(ts := ts, t := CASE event_type WHEN 'view' THEN ' ' ELSE event_type END)) AS event_type FROM e GROUP BY 1, 2)
    SELECT document_id, clause_pos, CASE event_type WHEN 'view' THEN NULL ELSE event_type END AS user_override,
      CASE WHEN event_type <> 'view' THEN strftime(ts, '%Y-%m-%dT%H:%M:%S+00:00') END AS user_override_at FROM l""")
def override_stream(spark, sf):
    """User edits that arrive as files, appended to the log by batches and folded with last write wins."""
    place = _place(spark, "st2")
    edits = table(spark, sf, "events").selectExpr(
        "CAST(user_id AS STRING) AS document_id", "CAST(value AS INT) % 5 AS clause_pos",
        "CASE event_type WHEN 'view' THEN ' ' ELSE event_type END AS text", "CAST(ts AS TIMESTAMP) AS edited_at",
    )
    edits.repartition(4, "document_id").write.parquet(f"{place}/in")
    stream = flows.edit_stream(spark, f"{place}/in", "parquet", files_per_batch=1)
    flows.start_overrides(stream, f"{place}/log", f"{place}/state", once=True, fold_every=3).awaitTermination()
    return stores.read_overrides(spark, f"{place}/log")


@query("s11_stored_analyses", """WITH d AS (SELECT o_orderkey AS document_id, o_custkey, o_orderstatus FROM orders)
    SELECT document_id, CASE WHEN o_custkey % 3 = 0 THEN '2024-02-01' ELSE '2024-01-01' END AS run, CASE WHEN o_custkey % 3 = 0 THEN 'second' ELSE 'first' END AS verdict FROM d WHERE o_custkey % 3 = 0 OR o_orderstatus <> 'P'""")
def stored_analyses(spark, sf):
    """Two runs over different contracts, the second stored before the first: of each contract the later run counts."""
    place = _place(spark, "analyses")
    orders = table(spark, sf, "orders")
    second = orders.filter("o_custkey % 3 = 0").select(F.col("o_orderkey").alias("document_id"), F.lit("second").alias("verdict"))
    first = orders.filter("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("document_id"), F.lit("first").alias("verdict"))
    stores.write_analyses(second, place, "2024-02-01")
    stores.write_analyses(first, place, "2024-01-01")
    stores.write_analyses(first, place, "2024-01-01")  # the same run again replaces itself
    return stores.read_analyses(spark, place).select("document_id", "run", "verdict")


@query("s12_stored_lookup", """SELECT o_orderkey AS document_id, 'second' AS verdict FROM orders WHERE o_custkey % 3 = 0 AND o_orderkey % 1000 = 1
    UNION ALL SELECT o_orderkey, 'first' FROM orders WHERE o_custkey % 3 <> 0 AND o_orderkey % 1000 = 1""")
def stored_lookup(spark, sf):
    """Some documents looked up in a store of two runs: their shards alone are read, and the later run counts."""
    place = _place(spark, "lookup")
    orders = table(spark, sf, "orders").withColumnRenamed("o_orderkey", "document_id")
    stores.write_analyses(orders.select("document_id", F.lit("first").alias("verdict")), place, "2024-01-01", shards=16)
    second = orders.filter("o_custkey % 3 = 0").select("document_id", F.lit("second").alias("verdict"))
    stores.write_analyses(second, place, "2024-02-01T10:00", shards=16)
    ids = orders.filter("document_id % 1000 = 1").select("document_id")
    return stores.lookup_analyses(spark, place, ids, shards=16).select("document_id", "verdict")


@query("s15_report", "SELECT 'metrics' AS part, quality, NULL::BIGINT AS doc_id, count(*) AS n FROM labels GROUP BY quality UNION ALL SELECT 'details', quality, doc_id, 1 FROM labels")
def report(spark, sf):
    """Metrics and details written as JSON and read again."""
    place = _place(spark, "report")
    details = table(spark, sf, "labels")
    stores.write_report(details.groupBy("quality").agg(F.count("*").alias("n")), details, place)
    metrics = spark.read.schema("quality int, n long").json(f"{place}/metrics")
    told = spark.read.schema("doc_id long, quality int").json(f"{place}/details")
    return metrics.select(F.lit("metrics").alias("part"), "quality", F.lit(None).cast("long").alias("doc_id"), "n").unionByName(
        told.select(F.lit("details").alias("part"), "quality", "doc_id", F.lit(1).cast("long").alias("n"))
    )
