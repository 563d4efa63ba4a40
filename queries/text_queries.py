"""Projections, predicates and text functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from clausewise import fixed_values as fv
from clausewise.functions import markdown as M
from clausewise.functions import responses as R
from clausewise.functions import scoring
from clausewise.functions import text as X
from clausewise.functions.udfs import nfc
from clausewise.operators import clauses as C
from clausewise.operators import keywords as K
from clausewise.operators import parties as P
from clausewise.sources import contracts as door
from queries.base import CONTRACTS_CTE, KB_CTE, contracts, kb, query, sql_map, table

# one routing vocabulary for the driver's four languages: words, then label
LATIN_ROUTES = [(["ung", "sch"], "german"), (["ción", "ento"], "spanish"), (["eau", "é"], "french")]
LATIN_KEYWORDS = {"the_words": ["the", "th", "and"], "la_words": ["la", "le", "eau"], "der_words": ["der", "sch", "ung"]}


def _count(column: str, word: str) -> str:
    return f"CAST((length({column}) - length(replace({column}, '{word}', ''))) / {len(word)} AS INT)"


def _score(column: str, words: list[str]) -> str:
    return "(" + " + ".join(_count(column, w) for w in words) + ")"


def best_label_sql(column: str, keywords: dict[str, list[str]], minimum: int = 0) -> str:
    """First declared label among the highest scores."""
    scores = [f"({_score(column, words)} * 1000 - {i})" for i, words in enumerate(keywords.values())]
    top = f"greatest({', '.join(scores)})"
    cases = " ".join(f"WHEN {s} = {top} THEN '{label}'" for s, label in zip(scores, keywords))
    return f"CASE WHEN {top} < {minimum * 1000 - len(keywords) + 1} THEN NULL ELSE CASE {cases} END END"


@query("p1_supported_extension", f"""WITH {CONTRACTS_CTE} SELECT document_id,
    lower(regexp_extract(filename, '\\.[^.]*$', 0)) IN ('.pdf', '.docx', '.hwp', '.hwpx') AS supported FROM contracts""")
def supported_extension(spark, sf):
    return contracts(spark, sf).select("document_id", X.supported_file(F.col("filename")).alias("supported"))


@query("p2_s7_accepted_contracts", f"""WITH {CONTRACTS_CTE} SELECT document_id, length(text) AS n FROM contracts
    WHERE lower(regexp_extract(filename, '\\.[^.]*$', 0)) IN ('.pdf', '.docx', '.hwp', '.hwpx') AND length(trim(text)) > 0""")
def accepted_contracts(spark, sf):
    return door.accepted(contracts(spark, sf)).select("document_id", F.length("text").cast("long").alias("n"))


@query("p2_rejected_contracts", f"""WITH {CONTRACTS_CTE} SELECT document_id, 'unsupported_extension' AS reason FROM contracts
    WHERE lower(regexp_extract(filename, '\\.[^.]*$', 0)) NOT IN ('.pdf', '.docx', '.hwp', '.hwpx')""")
def rejected_contracts(spark, sf):
    return door.rejected(contracts(spark, sf)).select("document_id", "reason")


@query("p3_type_or_common", f"WITH {KB_CTE} SELECT id, contract_type FROM kb WHERE contract_type IN ('sales', 'common')")
def type_or_common(spark, sf):
    return kb(spark, sf).filter(F.col("contract_type").isin("sales", "common")).select("id", "contract_type")


@query("p4_keyword_any", f"""SELECT doc_id, contains(text, 'sch') OR contains(text, 'ung') AS is_german,
    contains(text, 'eau') OR contains(text, 'é') AS is_french FROM documents""")
def keyword_any(spark, sf):
    text = F.col("text")
    return table(spark, sf, "documents").select(
        "doc_id", X.contains_any(text, ["sch", "ung"]).alias("is_german"), X.contains_any(text, ["eau", "é"]).alias("is_french")
    )


@query("p5_first_match_routing", """SELECT doc_id, CASE WHEN contains(text, 'ung') OR contains(text, 'sch') THEN 'german'
    WHEN contains(text, 'ción') OR contains(text, 'ento') THEN 'spanish'
    WHEN contains(text, 'eau') OR contains(text, 'é') THEN 'french' END AS route FROM documents
    WHERE contains(text, 'ung') OR contains(text, 'sch') OR contains(text, 'ción') OR contains(text, 'ento') OR contains(text, 'eau') OR contains(text, 'é')""")
def first_match_routing(spark, sf):
    routed = table(spark, sf, "documents").select("doc_id", K.first_match(F.col("text"), LATIN_ROUTES).alias("route"))
    return routed.filter(F.col("route").isNotNull())


_FILE = "CASE o_custkey % 4 WHEN 0 THEN '표준임대차_' WHEN 1 THEN '매매계약_' WHEN 2 THEN '임대차매매계약_' ELSE '기타_' END || CAST(o_orderkey AS STRING) || '.json'"


@query("p6_file_topic", f"""WITH f AS (SELECT o_orderkey, {_FILE} AS filename FROM orders)
    SELECT o_orderkey, CASE WHEN contains(filename, '임대차') THEN 'lease' WHEN contains(filename, '매매계약') THEN 'sales' END AS contract_type,
    CASE WHEN contains(filename, '임대차') THEN '임대차_약관' WHEN contains(filename, '매매계약') THEN '매매_약관' END AS topic FROM f""")
def file_topic(spark, sf):
    files = table(spark, sf, "orders").selectExpr("o_orderkey", f"{_FILE} AS filename")
    topic = K.file_topic(F.col("filename"))
    return files.select("o_orderkey", topic["contract_type"].alias("contract_type"), topic["topic"].alias("topic"))


@query("p8_minimum_length", """SELECT doc_id, length(text) >= 10 AS min_10, length(text) >= 20 AS min_20, length(text) >= 50 AS min_50,
    length(text) >= 5 AS min_5 FROM documents""")
def minimum_length(spark, sf):
    n = F.length("text")
    return table(spark, sf, "documents").select(
        "doc_id", *[(n >= size).alias(f"min_{size}") for size in (10, 20, 50, 5)]
    )


@query("p13_truncations", """SELECT doc_id, substring(text, 1, 1500) AS t1500, substring(text, 1, 300) AS t300, substring(text, 1, 200) AS t200,
    substring(text, 1, 80) AS t80, substring(text, 1, 500) AS t500 FROM documents""")
def truncations(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", *[X.head(F.col("text"), n).alias(f"t{n}") for n in (1500, 300, 200, 80, 500)]
    )


@query("p16_unsupported_types", f"""WITH {KB_CTE} SELECT id, contract_type FROM kb
    WHERE contract_type NOT IN ('lease', 'sales', 'employment', 'service', 'loan')""")
def unsupported_types(spark, sf):
    return door.unsupported_types(kb(spark, sf)).select("id", "contract_type")


_PARTS = r"""parts AS (SELECT doc_id, list_filter([trim(p, e' \t\n\r') FOR p IN string_split(text, chr(10))], lambda p: length(p) > 0) AS ps FROM documents)"""


@query("x3_paragraph_clauses", f"""WITH {_PARTS}, numbered AS (SELECT doc_id, unnest(ps) AS content, unnest(range(1, len(ps) + 1)) AS clause_index FROM parts)
    SELECT doc_id, CAST(clause_index AS INT) AS clause_index, substring(content, 1, 50) AS title, content FROM numbered WHERE length(content) >= 20""")
def paragraph_clauses(spark, sf):
    split = C.paragraph_clauses(F.col("text"), separator=r"\n")
    return table(spark, sf, "documents").select("doc_id", F.inline(split))


@query("p17_contracts_without_clauses", f"""WITH {_PARTS} SELECT doc_id FROM parts WHERE len(list_filter(ps, lambda p: length(p) >= 20)) = 0""")
def contracts_without_clauses(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    split = C.split_clauses(docs, "doc_id", separator=r"\n")
    return C.contracts_without_clauses(docs, split, "doc_id").select("doc_id")


_LIST = (
    "'제목 ' || CAST(o_orderkey AS STRING) || CASE o_custkey % 4 WHEN 0 THEN chr(10) || '① 첫째 항목' || chr(10) || '② 둘째 항목' || chr(10) || '③ 셋째' "
    "WHEN 1 THEN chr(10) || '1. 첫째 항목' || chr(10) || '2) 둘째 항목' || chr(10) || '(10) 열째' "
    "WHEN 2 THEN chr(10) || '1. 하나뿐인 항목' ELSE ' 항목 없음' END"
)


@query("x5_clause_items", f"""WITH c AS (SELECT o_orderkey, o_custkey % 4 AS kind, 'x' AS x FROM orders)
    SELECT o_orderkey, CAST(0 AS INT) AS item_pos, '제목 ' || o_orderkey AS item FROM c WHERE kind = 0
    UNION ALL SELECT o_orderkey, 1, '첫째 항목' FROM c WHERE kind = 0 UNION ALL SELECT o_orderkey, 2, '둘째 항목' FROM c WHERE kind = 0
    UNION ALL SELECT o_orderkey, 3, '셋째' FROM c WHERE kind = 0
    UNION ALL SELECT o_orderkey, 0, '1. 첫째 항목' FROM c WHERE kind = 1 UNION ALL SELECT o_orderkey, 1, '2) 둘째 항목' FROM c WHERE kind = 1
    UNION ALL SELECT o_orderkey, 2, '(10) 열째' FROM c WHERE kind = 1""")
def clause_items(spark, sf):
    lists = table(spark, sf, "orders").selectExpr("o_orderkey", f"{_LIST} AS content")
    return lists.select("o_orderkey", F.posexplode(X.clause_items(F.col("content"))).alias("item_pos", "item"))


_ROLES = {"user": "customer", "assistant": "agent"}


@query("x7_role_synonyms", f"SELECT {sql_map('role', _ROLES, 'role')} AS role, count(*) AS n FROM conversations GROUP BY 1")
def role_synonyms(spark, sf):
    turns = table(spark, sf, "conversations").select(P.role(F.col("role"), _ROLES).alias("role"))
    return turns.groupBy("role").agg(F.count("*").alias("n"))


_PAIR = (
    f"CASE WHEN o_custkey % 3 = 0 THEN '임대인' WHEN o_custkey % 3 = 1 THEN '발주자' ELSE '차주' END AS party_a, "
    f"CASE WHEN o_custkey % 3 = 0 THEN '임차인' WHEN o_custkey % 3 = 1 THEN '수급인' ELSE '대주' END AS party_b"
)


@query("x6_parties", f"SELECT o_orderkey AS document_id, {_PAIR} FROM orders")
def parties(spark, sf):
    typed = contracts(spark, sf, typed=True)
    return typed.select("document_id", P.parties(F.col("text"), F.col("contract_type")).alias("p")).select("document_id", "p.*")


@query("a1_keyword_scores", "SELECT doc_id, label, CAST(score AS INT) AS score FROM (" + " UNION ALL ".join(
    f"SELECT doc_id, '{label}' AS label, {_score('text', words)} AS score FROM documents" for label, words in LATIN_KEYWORDS.items()) + ")")
def keyword_scores(spark, sf):
    return K.scores_table(table(spark, sf, "documents"), "doc_id", "text", LATIN_KEYWORDS)


@query("a2_contract_type", f"WITH {CONTRACTS_CTE} SELECT document_id, {best_label_sql('text', fv.CONTRACT_TYPE_KEYWORDS)} AS contract_type FROM contracts")
def contract_type(spark, sf):
    return contracts(spark, sf).select("document_id", K.contract_type(F.col("text")).alias("contract_type"))


@query("a2_j5_document_label", f"SELECT doc_id, {best_label_sql('text', LATIN_KEYWORDS)} AS label FROM documents")
def document_label(spark, sf):
    return table(spark, sf, "documents").select("doc_id", K.best_label(F.col("text"), LATIN_KEYWORDS).alias("label"))


@query("a3_precedent_type", f"WITH {CONTRACTS_CTE} SELECT document_id, {best_label_sql('text', fv.PRECEDENT_KEYWORDS, 2)} AS contract_type FROM contracts")
def precedent_type(spark, sf):
    return contracts(spark, sf).select("document_id", K.precedent_type(F.col("text")).alias("contract_type"))


_RES, _COM = _score("text", fv.RESIDENTIAL_KEYWORDS), _score("text", fv.COMMERCIAL_KEYWORDS)
_USE = "text || CASE o_orderkey % 4 WHEN 0 THEN '상가 점포' WHEN 1 THEN '점포' WHEN 2 THEN '사업장 영업용 사무실 상가' ELSE '' END"


@query("a4_lease_subtype", f"""WITH {CONTRACTS_CTE}, used AS (SELECT document_id, {_USE.replace('o_orderkey', 'document_id')} AS text FROM contracts),
    s AS (SELECT document_id, {_RES} AS a, {_COM} AS b FROM used)
    SELECT document_id, CASE WHEN a = 0 AND b = 0 THEN NULL WHEN a >= b * 2 THEN 'residential' WHEN b >= a * 2 THEN 'commercial' END AS sub_type FROM s""")
def lease_subtype(spark, sf):
    used = contracts(spark, sf).selectExpr("document_id", _USE.replace("o_orderkey", "document_id") + " AS text")
    return used.select("document_id", K.lease_subtype(F.col("text")).alias("sub_type"))


@query("x10_chunks", r"""WITH d AS (SELECT doc_id, trim(text, e' \t\n\r') AS t FROM documents), n AS (SELECT doc_id, t, length(t) AS n FROM d WHERE length(t) > 0),
    s AS (SELECT doc_id, t, n, unnest(range(0, CASE WHEN n <= 1500 THEN 1 ELSE CAST(ceil((n - 1500) / 1350.0) AS BIGINT) + 1 END)) AS chunk_idx FROM n)
    SELECT doc_id, CAST(chunk_idx AS INT) AS chunk_idx, substring(t, chunk_idx * 1350 + 1, 1500) AS chunk FROM s""")
def chunks(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.posexplode(X.chunk(F.col("text"))).alias("chunk_idx", "chunk"))


@query("x12_x23_sections_by_heading", r"""WITH p AS (SELECT page_id, string_split_regex(html, '<(?:title|h1|p|b)>') AS bodies,
      regexp_extract_all(html, '<(title|h1|p|b)>', 1) AS labels FROM pages)
    SELECT page_id, CAST(i AS INT) AS pos, CASE WHEN i > 0 THEN labels[i] END AS label, bodies[i + 1] AS body
    FROM (SELECT page_id, bodies, labels, unnest(range(0, len(bodies))) AS i FROM p)""")
def sections_by_heading(spark, sf):
    sections = X.headed_sections(F.col("html"), "<(title|h1|p|b)>", X.UNI)
    pages = table(spark, sf, "pages").select("page_id", F.posexplode(sections).alias("pos", "s"))
    return pages.select("page_id", "pos", "s.label", "s.body")


@query("x13_flat_fields", """SELECT event_id, CAST(regexp_extract(props, '"k": ([0-9]+)', 1) AS STRING) AS k FROM events""")
def flat_fields(spark, sf):
    lines = F.regexp_replace("props", r'[{}"]', "")
    return table(spark, sf, "events").select("event_id", F.try_element_at(M.flat_map(lines, ", "), F.lit("k")).alias("k"))


@query("x14_content_id", "SELECT doc_id, 'doc-' || substring(sha1(text), 1, 16) AS content_id FROM documents")
def content_id(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.content_id(F.lit("doc"), F.col("text")).alias("content_id"))


@query("x15_labelled_text", f"""SELECT p_partkey, '[법률] ' || p_brand || ' 제' || p_size || '조' ||
    CASE WHEN p_partkey % 5 > 0 THEN '의' || p_partkey % 5 ELSE '' END || ' (' || p_type || ')' || chr(10) || p_name AS text FROM part""")
def labelled_text(spark, sf):
    parts = table(spark, sf, "part").withColumn("sub", F.col("p_partkey") % 5)
    label = X.article_label(F.col("p_size"), F.col("sub"))
    return parts.select(
        "p_partkey",
        F.concat(
            F.lit("[법률] "), "p_brand", F.lit(" "), label, F.lit(" ("), "p_type", F.lit(")\n"), "p_name"
        ).alias("text"),
    )


@query("x16_collapse", r"SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS text FROM documents")
def collapse(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.collapse(F.col("text")).alias("text"))


@query("x17_corpus_norm", r"""WITH d AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '[법률] 머리' || chr(10) || text ELSE text END AS text FROM documents)
    SELECT doc_id, lower(trim(regexp_replace(regexp_replace(text, '(?m)^\[(?:법률|판례)\][^\n]*\n', ''), '\s+', ' ', 'g'))) AS norm FROM d""")
def corpus_norm(spark, sf):
    labelled = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("[법률] 머리\n"), "text")).otherwise(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", X.corpus_norm(labelled).alias("norm"))


_CITE = "CASE o_custkey % 3 WHEN 0 THEN '제 ' || CAST(o_orderkey % 700 AS STRING) || ' 조의' || CAST(o_custkey % 9 AS STRING) WHEN 1 THEN '민법 제' || CAST(o_orderkey % 700 AS STRING) || '조' ELSE '조문 없음' END"


@query("x19_x20_article_numbers", f"""WITH a AS (SELECT o_orderkey, {_CITE} AS article FROM orders), n AS (SELECT o_orderkey,
      TRY_CAST(regexp_extract(article, '제\\s*(\\d+)\\s*조(?:의\\s*(\\d+))?', 1) AS INT) AS no,
      coalesce(TRY_CAST(regexp_extract(article, '제\\s*(\\d+)\\s*조(?:의\\s*(\\d+))?', 2) AS INT), 0) AS sub FROM a)
    SELECT o_orderkey, no, sub, '제' || no || '조' || CASE WHEN sub > 0 THEN '의' || sub ELSE '' END AS label FROM n""")
def article_numbers(spark, sf):
    cited = table(spark, sf, "orders").selectExpr("o_orderkey", f"{_CITE} AS article")
    numbered = cited.select(
        "o_orderkey", X.article_number(F.col("article")).alias("no"), X.article_sub_number(F.col("article")).alias("sub")
    )
    return numbered.withColumn("label", X.article_label(F.col("no"), F.col("sub")))


_REF = "CASE o_custkey % 4 WHEN 0 THEN '[판례] ' WHEN 1 THEN ' [약관-불리] ' WHEN 2 THEN '[이 태그는 열두 글자보다 깁니다] ' ELSE '' END || '본문 ' || CAST(o_orderkey AS STRING) || chr(10) || '판시사항: 쟁점 ' || CAST(o_custkey AS STRING) || chr(10) || '판결요지 : 요지' || chr(10) || '참조조문:  '"


@query("x22_reference_tag", f"""SELECT o_orderkey, CASE o_custkey % 4 WHEN 0 THEN '판례' WHEN 1 THEN '약관-불리' END AS tag,
    length(CASE WHEN o_custkey % 4 IN (0, 1) THEN substring({_REF}, CASE o_custkey % 4 WHEN 0 THEN 6 ELSE 10 END) ELSE {_REF} END) AS n_rest FROM orders""")
def reference_tag(spark, sf):
    refs = table(spark, sf, "orders").selectExpr("o_orderkey", f"{_REF} AS text")
    tag = X.reference_tag(F.col("text"))
    return refs.select("o_orderkey", tag["tag"].alias("tag"), F.length(tag["rest"]).cast("long").alias("n_rest"))


@query("x23_reference_sections", f"""SELECT o_orderkey, 0 AS pos, NULL AS label, trim(CASE o_custkey % 4 WHEN 0 THEN '[판례] ' WHEN 1 THEN ' [약관-불리] '
      WHEN 2 THEN '[이 태그는 열두 글자보다 깁니다] ' ELSE '' END || '본문 ' || o_orderkey) AS body FROM orders
    UNION ALL SELECT o_orderkey, 1, '판시사항', '쟁점 ' || o_custkey FROM orders UNION ALL SELECT o_orderkey, 2, '판결요지', '요지' FROM orders""")
def reference_sections(spark, sf):
    refs = table(spark, sf, "orders").selectExpr("o_orderkey", f"{_REF} AS text")
    return refs.select("o_orderkey", F.posexplode(X.reference_sections(F.col("text"))).alias("pos", "s")).select(
        "o_orderkey", "pos", "s.label", "s.body"
    )


_SUM = "'머리말' || chr(10) || chr(10) || '둘째 줄' || chr(10) || '■ 전반 평가' || chr(10) || '평가 ' || CAST(o_orderkey AS STRING) || chr(10) || ' ■ 핵심 쟁점 ' || chr(10) || '쟁점' || chr(10) || chr(10) || '이어서' || chr(10) || '■ 빈 항목' || chr(10)"


@query("x24_summary_sections", """SELECT o_orderkey, 0 AS pos, NULL AS label, '머리말' || chr(10) || '둘째 줄' AS body FROM orders
    UNION ALL SELECT o_orderkey, 1, '전반 평가', '평가 ' || o_orderkey FROM orders
    UNION ALL SELECT o_orderkey, 2, '핵심 쟁점', '쟁점' || chr(10) || chr(10) || '이어서' FROM orders""")
def summary_sections(spark, sf):
    said = table(spark, sf, "orders").selectExpr("o_orderkey", f"{_SUM} AS text")
    return said.select("o_orderkey", F.posexplode(X.summary_sections(F.col("text"))).alias("pos", "s")).select(
        "o_orderkey", "pos", "s.label", "s.body"
    )


@query("x29_x35_reference_display", r"""SELECT doc_id, substring(text, 1, 80) || '... (유사도: ' || printf('%.2f', (n_chars % 101) / 100.0) || ')' AS line,
    length(text) > 280 AS is_long, CASE WHEN length(text) > 280 THEN trim(substring(text, 1, 280), e' \t\n\r') || '…' END AS preview,
    CAST(round(greatest(0, least(1, (n_chars % 101) / 100.0)) * 100) AS INT) AS percent FROM documents""")
def reference_display(spark, sf):
    similarity = (F.col("n_chars") % 101) / 100.0
    text = F.col("text")
    return table(spark, sf, "documents").select(
        "doc_id", X.reference_line(text, similarity).alias("line"), X.is_long(text).alias("is_long"),
        X.preview(text).alias("preview"), scoring.percent(similarity).alias("percent"),
    )


@query("x33_u1_nfc", "SELECT doc_id, length(nfc_normalize(nfd)) AS n_nfc, nfc_normalize(nfd) = text AS same FROM (SELECT doc_id, text, replace(replace(text, 'é', 'e' || chr(769)), 'ü', 'u' || chr(776)) AS nfd FROM documents)")
def nfc_form(spark, sf):
    docs = table(spark, sf, "documents").select(
        "doc_id", "text", F.replace(F.replace("text", F.lit("é"), F.lit("é")), F.lit("ü"), F.lit("ü")).alias("nfd")
    )
    done = docs.withColumn("nfc", nfc("nfd"))
    return done.select("doc_id", F.length("nfc").cast("long").alias("n_nfc"), (F.col("nfc") == F.col("text")).alias("same"))


_SCALAR = "CASE o_custkey % 3 WHEN 0 THEN '[\"가\",\"나' || CAST(o_orderkey AS STRING) || '\"]' WHEN 1 THEN '홑값' END"
_NESTED = "CASE o_custkey % 3 WHEN 0 THEN '{\"a\":[\"가\",\"나\"],\"b\":\"홑\",\"c\":[\"다' || CAST(o_orderkey AS STRING) || '\"]}' WHEN 1 THEN '홑값' END"


@query("x34_list_or_scalar", """SELECT o_orderkey, CASE o_custkey % 3 WHEN 0 THEN '가|나' || o_orderkey WHEN 1 THEN '홑값' ELSE '' END AS listed,
    CASE o_custkey % 3 WHEN 0 THEN '가|나|다' || o_orderkey WHEN 1 THEN '홑값' ELSE '' END AS nested FROM orders""")
def list_or_scalar(spark, sf):
    rows = table(spark, sf, "orders").selectExpr("o_orderkey", f"{_SCALAR} AS a", f"{_NESTED} AS b")
    return rows.select(
        "o_orderkey",
        F.array_join(R.string_list(F.col("a")), "|").alias("listed"),
        F.array_join(R.nested_lists(F.col("b")), "|").alias("nested"),
    )


_LEVEL = "CASE o_custkey % 6 WHEN 0 THEN ' HIGH ' WHEN 1 THEN 'Medium' WHEN 2 THEN 'low' WHEN 3 THEN 'safe' WHEN 4 THEN 'severe' ELSE '' END"


@query("x27_x28_risk_level", f"""SELECT o_orderkey, CASE o_custkey % 6 WHEN 0 THEN 'high' WHEN 2 THEN 'low' WHEN 3 THEN 'safe' ELSE 'medium' END AS level,
    CASE o_custkey % 6 WHEN 0 THEN '고위험' WHEN 2 THEN '저위험' WHEN 3 THEN '안전' ELSE '중위험' END AS label,
    CASE o_custkey % 6 WHEN 2 THEN '저위험' ELSE '안전' END AS badge FROM orders""")
def risk_level(spark, sf):
    from clausewise.operators.analysis import badge_label, risk_label

    said = table(spark, sf, "orders").selectExpr("o_orderkey", f"{_LEVEL} AS raw")
    level = R.risk_level(F.col("raw"))
    return said.select(
        "o_orderkey", level.alias("level"), risk_label(level).alias("label"), badge_label(F.col("raw")).alias("badge")
    )


@query("m4_rounding", """SELECT l_orderkey, l_partkey, l_linenumber, round(l_discount * l_tax * 7, 4) AS r4, round(l_discount * l_tax * 7, 6) AS r6,
    CAST(round(greatest(0, least(1, l_discount * 15)) * 100) AS INT) AS percent FROM lineitem""")
def rounding(spark, sf):
    product = F.col("l_discount") * F.col("l_tax") * 7
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_partkey", "l_linenumber", F.round(product, 4).alias("r4"), F.round(product, 6).alias("r6"),
        scoring.percent(F.col("l_discount") * 15).alias("percent"),
    )


@query("dates_edit_stamp", """SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S+00:00') AS edited, strftime(ts, '%Y-%m-%d %H:%M') AS built FROM events""")
def edit_stamp(spark, sf):
    return table(spark, sf, "events").select(
        "event_id",
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'+00:00'").alias("edited"),
        F.date_format("ts", "yyyy-MM-dd HH:mm").alias("built"),
    )


@query("s17_export_name", f"""WITH {CONTRACTS_CTE} SELECT document_id, regexp_replace(filename, '\\.[^.]*$', '') || '_권고수정안.docx' AS name FROM contracts""")
def export_name(spark, sf):
    return contracts(spark, sf).select("document_id", X.export_name(F.col("filename"), "docx").alias("name"))


@query("p9_in_force", """SELECT o_orderkey, o_custkey % 4 IN (0, 2) AS in_force FROM orders""")
def in_force(spark, sf):
    status = "CASE o_custkey % 4 WHEN 0 THEN '상태: 시행' || chr(10) WHEN 1 THEN '상태: 폐지' || chr(10) WHEN 2 THEN '' ELSE '상태:' || chr(10) END"
    files = table(spark, sf, "orders").selectExpr("o_orderkey", f"'---' || chr(10) || {status} || '시행일자: 2024-01-01' || chr(10) || '---' || chr(10) AS md")
    return files.select("o_orderkey", M.is_in_force(M.front_matter(F.col("md"))).alias("in_force"))


