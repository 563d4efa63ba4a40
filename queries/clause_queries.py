"""Clause splitting, rules, search queries and request texts on contracts written from orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from clausewise import dims
from clausewise import fixed_values as fv
from clausewise.functions import text as X
from clausewise.operators import clauses as C
from clausewise.operators import exchange, expansion, rules
from clausewise.plans import retrieval
from clausewise.session import write_shared
from queries.base import (
    CLAUSES_CTE, CONTRACT_TYPE, HIGH_REASON_SQL, HIGH_TYPE_SQL, KB_TYPES, QUERY_CTE, RULED_CTE, SAFE_SQL, VETO_SQL,
    BODY_SQL, contracts, kb, query, quote, sql_map, table,
)
from clausewise.operators import bm25
from queries.search_queries import SELECTED_CTES


def split(spark, sf):
    return C.split_clauses(contracts(spark, sf, typed=True), keep=["contract_type"])


def ruled(spark, sf):
    return rules.apply_rules(split(spark, sf))


@query("x1_x2_x4_split_clauses", f"WITH {CLAUSES_CTE} SELECT document_id, clause_pos, clause_index, title, content FROM clauses")
def split_clauses(spark, sf):
    return split(spark, sf).drop("contract_type")


@query("a21_so8_special_term_index", f"""WITH {CLAUSES_CTE}, m AS (SELECT document_id, max(clause_index) AS last_article FROM clauses WHERE clause_pos <= 4 GROUP BY 1)
    SELECT document_id, title, clause_index, CAST(last_article + row_number() OVER (PARTITION BY document_id ORDER BY clause_pos) AS INT) AS expected_index
    FROM clauses JOIN m USING (document_id) WHERE clause_pos > 4""")
def special_term_index(spark, sf):
    special = split(spark, sf).filter(F.col("title").startswith(fv.SPECIAL_TITLE))
    return special.select("document_id", "title", "clause_index", F.col("clause_index").alias("expected_index"))


@query("w11_section_lengths", f"WITH {CLAUSES_CTE} SELECT document_id, count(*) AS n_clauses, CAST(sum(length(content)) AS BIGINT) AS n_chars FROM clauses GROUP BY 1")
def section_lengths(spark, sf):
    return split(spark, sf).groupBy("document_id").agg(
        F.count("*").alias("n_clauses"), F.sum(F.length("content")).alias("n_chars")
    )


@query("r1_safe_rule", f"WITH {CLAUSES_CTE}, {RULED_CTE} SELECT document_id, clause_pos, safe_reason FROM ruled")
def safe_rule(spark, sf):
    return ruled(spark, sf).select("document_id", "clause_pos", "safe_reason")


@query("r2_high_rule", f"WITH {CLAUSES_CTE}, {RULED_CTE} SELECT document_id, clause_pos, high_reason, high_risk_type FROM ruled")
def high_rule(spark, sf):
    return ruled(spark, sf).select("document_id", "clause_pos", "high_reason", "high_risk_type")


@query("r3_j3_prefilter", f"WITH {CLAUSES_CTE}, {RULED_CTE} SELECT document_id, clause_pos, verdict_source FROM verdicts")
def prefilter(spark, sf):
    return ruled(spark, sf).select("document_id", "clause_pos", "verdict_source")


@query("a16_rule_counts", f"WITH {CLAUSES_CTE}, {RULED_CTE} SELECT verdict_source, count(*) AS n_clauses FROM verdicts GROUP BY 1")
def rule_counts(spark, sf):
    return rules.rule_counts(ruled(spark, sf))


@query("j16_unresolved", f"WITH {CLAUSES_CTE}, {RULED_CTE} SELECT document_id, clause_pos, title FROM verdicts WHERE verdict_source = 'model'")
def unresolved(spark, sf):
    return rules.unresolved(ruled(spark, sf)).select("document_id", "clause_pos", "title")


@query("p11_j4_veto", f"WITH {CLAUSES_CTE}, bodies AS (SELECT *, {BODY_SQL} AS body FROM clauses) SELECT document_id, clause_pos, {VETO_SQL} AS vetoed FROM bodies")
def veto(spark, sf):
    body = X.collapse(F.col("content"))
    return split(spark, sf).select(
        "document_id", "clause_pos", rules.vetoed(body, F.col("contract_type"), dims.vetoes()).alias("vetoed")
    )


# every rule against text that names its subject: one clause per line item, all five types
_TYPE_OF_LINE = "CASE l_suppkey % 5 WHEN 0 THEN 'lease' WHEN 1 THEN 'sales' WHEN 2 THEN 'employment' WHEN 3 THEN 'service' ELSE 'loan' END"
_Q, _P = "CAST(CAST(l_quantity AS INT) AS STRING)", "CAST(l_partkey % 90 AS STRING)"
_TEXTS = [
    f"'보증금: 금 ' || {_Q} || '만원, 월 차임: ' || {_P} || '만원을 매월 지급한다'",
    f"'연체 이자는 연 ' || {_Q} || '%로 하며 월 ' || {_P} || '%를 넘지 않는다'",
    f"'용역 대금은 검수 후 ' || {_P} || '일 이내 지급하고 하자담보 책임은 ' || {_Q} || '개월로 한다'",
    f"'사용자는 해고 30일 전에 예고하고 연장 근로에는 ' || {_Q} || '% 이상 가산하여 지급한다'",
    f"'매수인은 잔금 지급과 소유권 이전 등기를 동시 이행하며 계약금의 배액을 상환하고 해제할 수 있다. ' || {_Q}",
    f"'임차인은 선관 주의 의무를 지고  모든 수리 비용은 임차인이 부담한다. ' || {_P}",
    f"'기한의 이익은 통지 없이 상실한다. 보증은 서면으로 하고 근보증 최고액을 명시한다. ' || {_P}",
    f"'묵시적 갱신은 적용하지 않으며 관리비 금액은 갑이 단독으로 정한다. ' || {_Q}",
]
_TEXT_OF_LINE = "CASE l_linenumber + l_partkey % 2 " + " ".join(f"WHEN {i + 1} THEN {t}" for i, t in enumerate(_TEXTS)) + " ELSE '기타 ' || l_returnflag END"
_LINE_CLAUSES = f"SELECT l_orderkey, l_partkey, l_linenumber, {_TYPE_OF_LINE} AS contract_type, {_TEXT_OF_LINE} AS content FROM lineitem"


@query("r1_r2_rules_all_types", f"""WITH clauses AS ({_LINE_CLAUSES}), bodies AS (SELECT *, {BODY_SQL} AS body FROM clauses)
    SELECT l_orderkey, l_partkey, l_linenumber, {SAFE_SQL} AS safe_reason, {HIGH_REASON_SQL} AS high_reason, {HIGH_TYPE_SQL} AS high_risk_type FROM bodies""")
def rules_all_types(spark, sf):
    lines = table(spark, sf, "lineitem", deal=True).selectExpr(
        "l_orderkey", "l_partkey", "l_linenumber", f"{_TYPE_OF_LINE} AS contract_type", f"{_TEXT_OF_LINE} AS content"
    )
    return rules.apply_rules(lines).select(
        "l_orderkey", "l_partkey", "l_linenumber", "safe_reason", "high_reason", "high_risk_type"
    )


_SAFE_TEXT = sql_map("safe_reason", fv.SAFE_EXPLANATIONS, quote(fv.SAFE_DEFAULT_EXPLANATION))
_HIGH_TEXT = sql_map("high_risk_type", fv.HIGH_EXPLANATIONS, "high_reason")


@query("x32_rule_explanations", f"""WITH {CLAUSES_CTE}, {RULED_CTE}
    SELECT document_id, clause_pos, 'safe' AS risk_level, 0.95::DOUBLE AS confidence, {_SAFE_TEXT} AS explanation, '' AS suggestion FROM verdicts WHERE verdict_source = 'rule_safe'
    UNION ALL SELECT document_id, clause_pos, 'high', 0.95::DOUBLE, {_HIGH_TEXT}, {quote(fv.HIGH_SUGGESTION)} FROM verdicts WHERE verdict_source = 'rule_high'""")
def rule_explanations(spark, sf):
    decided = rules.rule_verdicts(ruled(spark, sf))
    first = F.try_element_at("risks", F.lit(1))
    return decided.select(
        "document_id", "clause_pos", "risk_level", "confidence", "explanation",
        F.coalesce(first["suggestion"], F.lit("")).alias("suggestion"),
    )


_EXTRA = ", ".join(
    f"CASE WHEN contract_type = '{ct}' AND contains(content, '{trigger}') THEN '{extra}' END" for ct, trigger, extra in fv.QUERY_EXPANSIONS
)
# first occurrence of each distinct text, in declared order
_WORDS = f"list_filter([{_EXTRA}], lambda w: w IS NOT NULL)"
_DISTINCT = "list_filter(ws, lambda w, i: list_position(ws, w) = i)"


@query("x21_j15_p15_expanded_query", f"""WITH {CLAUSES_CTE}, w AS (SELECT *, {_WORDS} AS ws FROM clauses)
    SELECT document_id, clause_pos, CASE WHEN (length(content) < 100 OR contains(title, '특약')) AND len(ws) > 0
      THEN content || chr(10) || '[검색키워드] ' || array_to_string({_DISTINCT}, ' ') ELSE content END AS query_text FROM w""")
def expanded_query(spark, sf):
    return split(spark, sf).select(
        "document_id", "clause_pos",
        expansion.expanded_query(F.col("title"), F.col("content"), F.col("contract_type")).alias("query_text"),
    )


@query("h5_clause_queries", f"""WITH {CLAUSES_CTE}, w AS (SELECT *, {_WORDS} AS ws FROM clauses)
    SELECT document_id, clause_pos, 0 AS item_pos, CASE WHEN len(ws) > 0
      THEN content || chr(10) || '[검색키워드] ' || array_to_string({_DISTINCT}, ' ') ELSE content END AS text FROM w""")
def clause_queries(spark, sf):
    return expansion.clause_queries(split(spark, sf), exchange.KEYS).drop("contract_type")


# every sentence of a benchmark text is an item of a clause; item vectors are borrowed from the table
_VECTOR_OF = "(document_id * 5 + item_pos) % 200"
_ITEMS_CTE = """c AS (SELECT item_id AS document_id, CASE item_id % 4 WHEN 0 THEN 'lease' WHEN 1 THEN 'sales' WHEN 2 THEN 'employment' END AS contract_type,
    '① ' || replace(text, '. ', '. ② ') AS content FROM benchmark),
cut AS (SELECT *, list_filter(list_transform(regexp_split_to_array(content, '[①②]'), lambda p: trim(p, e' \\t\\n\\r')), lambda p: p <> '') AS parts FROM c),
items AS (SELECT document_id, contract_type, CASE WHEN contains(content, '②') AND len(parts) >= 2 THEN parts ELSE [content] END AS ts FROM cut),
q AS (SELECT document_id, item_pos, document_id || '/1/' || item_pos AS query_id, ts[item_pos + 1] AS text, contract_type
  FROM (SELECT *, unnest(range(0, len(ts))) AS item_pos FROM items))"""
_ITEM_HITS = (
    SELECTED_CTES.replace(QUERY_CTE, _ITEMS_CTE)
    .replace("near0 AS (", f"qvec AS (SELECT query_id AS id, e FROM q JOIN vec ON vec.id = CAST({_VECTOR_OF} AS VARCHAR)),\nnear0 AS (", 1)
    .replace("JOIN vec qv", "JOIN qvec qv")
)


@query("h5_w15_so4_clause_hits", f"""WITH {_ITEM_HITS},
    first AS (SELECT document_id, item_pos, f.* FROM final f JOIN q USING (query_id) WHERE pos <= 5
      QUALIFY row_number() OVER (PARTITION BY document_id, id ORDER BY item_pos, pos) = 1)
    SELECT document_id, CAST(1 AS INT) AS clause_pos, id, CAST(item_pos AS INT) AS item_pos, CAST(pos AS INT) AS pos, category, similarity, rrf_score,
      CAST(row_number() OVER (PARTITION BY document_id ORDER BY item_pos, pos) AS INT) AS merged_pos FROM first""")
def clause_hits(spark, sf):
    """Hybrid search of the benchmark texts as clauses, their sentences as items, hits merged first-seen."""
    clauses = table(spark, sf, "benchmark").selectExpr(
        "item_id AS document_id", "1 AS clause_pos",
        "CASE item_id % 4 WHEN 0 THEN 'lease' WHEN 1 THEN 'sales' WHEN 2 THEN 'employment' END AS contract_type",
        "'' AS title",
        "concat('① ', regexp_replace(text, '\\\\. ', '. ② ')) AS content",
    )
    vec = table(spark, sf, "embeddings").selectExpr("CAST(vec_id AS STRING) AS id", "embedding")
    asked = retrieval.item_queries(clauses, exchange.KEYS).selectExpr("query_id", f"CAST({_VECTOR_OF} AS STRING) AS id")
    index = bm25.build_index(kb(spark, sf, deal=True), types=KB_TYPES)
    hits = retrieval.clause_retrieval(
        clauses, exchange.KEYS, kb(spark, sf), index, item_vectors=asked.join(vec, "id").select("query_id", "embedding"), kb_vectors=vec, types=KB_TYPES
    )
    return hits.select(*exchange.KEYS, "id", "item_pos", "pos", "category", "similarity", "rrf_score", "merged_pos")


_PARTY = ("CASE contract_type WHEN 'lease' THEN '임대인' WHEN 'service' THEN '발주자' ELSE '차주' END",
          "CASE contract_type WHEN 'lease' THEN '임차인' WHEN 'service' THEN '수급인' ELSE '대주' END")
_PARTIES_SQL = quote(fv.PARTIES_TEXT).replace("{a}", f"' || {_PARTY[0]} || '").replace("{b}", f"' || {_PARTY[1]} || '").replace("\n", "' || chr(10) || '")
_HINTS = sql_map("sub_type", fv.SUBTYPE_HINTS, "''")
_SUB = "CASE document_id % 3 WHEN 0 THEN 'residential' WHEN 1 THEN 'commercial' END"
_REFS = "CASE WHEN document_id % 2 = 0 THEN " + quote(fv.REFERENCE_LABEL_GUIDE) + " || chr(10) || '[참고1] 참고 ' || clause_pos || chr(10) || '[참고2] 둘째' END"


@query("x30_j17_model_requests", f"""WITH {CLAUSES_CTE}, {RULED_CTE}, r AS (SELECT *, {_SUB} AS sub_type, {_REFS} AS refs FROM verdicts WHERE verdict_source = 'model'),
    c AS (SELECT *, coalesce(refs, {sql_map('contract_type', fv.NO_REFERENCE_TEXT, "''")}) AS ctx, CASE WHEN contract_type = 'lease' THEN {_HINTS} ELSE '' END AS hint FROM r)
    SELECT document_id, clause_pos, contract_type, {_PARTIES_SQL} AS parties_text,
      chr(10) || '[' || clause_index || '] ' || title || ': ' || content || chr(10) AS clause_text,
      CASE WHEN hint <> '' THEN hint || chr(10) || ctx ELSE ctx END AS reference_context FROM c""")
def model_requests(spark, sf):
    from clausewise.operators.parties import parties

    texts = contracts(spark, sf, typed=True).withColumn("_p", parties(F.col("text"), F.col("contract_type"))).select("*", "_p.*")
    texts = texts.withColumn("sub_type", F.expr(_SUB))
    facts = ["contract_type", "sub_type", "party_a", "party_b"]
    open_clauses = write_shared(
        rules.unresolved(rules.apply_rules(C.split_clauses(texts, keep=facts))), "open-clauses"
    )
    hits = open_clauses.filter(F.col("document_id") % 2 == 0).select(
        *exchange.KEYS,
        F.inline(
            F.array(
                F.struct(F.lit(2).alias("pos"), F.lit("둘째").alias("text")),
                F.struct(F.lit(1).alias("pos"), F.concat(F.lit("참고 "), F.col("clause_pos")).alias("text")),
            )
        ),
    )
    return exchange.model_requests(open_clauses, exchange.reference_texts(hits))


@query("j17_subtype_hint", f"""WITH d AS (SELECT o_orderkey AS document_id, {CONTRACT_TYPE} AS contract_type, {_SUB.replace('document_id', 'o_orderkey')} AS sub_type FROM orders)
    SELECT document_id, CASE WHEN contract_type = 'lease' THEN {_HINTS} ELSE '' END AS hint FROM d""")
def subtype_hint(spark, sf):
    typed = contracts(spark, sf, typed=True).withColumn("sub_type", F.expr(_SUB))
    return typed.select("document_id", exchange.subtype_hint(F.col("contract_type"), F.col("sub_type")).alias("hint"))


