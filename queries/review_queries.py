"""Responses, merged analyses, roll-ups, exports and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from clausewise import fixed_values as fv
from clausewise.functions import responses as R
from clausewise.operators import analysis, evaluation, exchange, rollups, rules
from clausewise.plans import accuracy
from clausewise.session import write_shared
from clausewise.sources import stores
from queries.base import CLAUSES_CTE, ROWS_PER_TASK, RULED_CTE, query, quote, sql_map, table
from queries.clause_queries import ruled, split

# --- responses: two attempts per order, ten kinds of answer --------------------------------

_KIND = "(o_orderkey + attempt * 3) % 10"
_CONF = "'0.' || CAST(10 + o_custkey % 90 AS STRING)"
_HIGH = f"""'[{{"clause_index":2,"risk_level":"high","confidence":' || {_CONF} || ',"risks":[{{"risk_type":"권리 제한","description":"d","suggestion":"s"}}],"explanation":"e"}}]'"""
_FENCED = f"""'답변' || chr(10) || '```json' || chr(10) || '{{"clause_index":2,"risk_level":"MEDIUM","confidence":' || {_CONF} || ',}}' || chr(10) || '```'"""
_CUT = """'[{"clause_index":2,"risk_level":"low","confidence":0.9,"risks":[{"risk_type":"x","desc'"""
_THINK = f"""'<think>[생각]</think>{{"clause_index":2,"risk_level":"safe","confidence":' || {_CONF} || ',"risks":[],"explanation":"ok"}}'"""
_ODD_QUOTE = f"""'관 5" 규격: {{"clause_index":2,"risk_level":"high","confidence":' || {_CONF} || ',"risks":[],"explanation":"q"}}'"""
_ODD_BRACE = f"""'set {{a: [{{"clause_index":2,"risk_level":"low","confidence":' || {_CONF} || ',"risks":[],"explanation":"b"}}]'"""
RESPONSES = [
    "o_orderkey AS document_id", "2 AS clause_pos", "CAST(attempt AS INT) AS attempt",
    f"CASE {_KIND} WHEN 0 THEN {_HIGH} WHEN 1 THEN {_FENCED} WHEN 3 THEN '' WHEN 4 THEN '분석할 수 없습니다.' WHEN 5 THEN {_CUT} WHEN 6 THEN {_THINK} WHEN 8 THEN {_ODD_QUOTE} WHEN 9 THEN {_ODD_BRACE} END AS raw_text",
    f"CASE {_KIND} WHEN 2 THEN 'timeout' WHEN 7 THEN 'llm_error' ELSE 'ok' END AS status",
]


def responses(spark, sf):
    twice = table(spark, sf, "orders", deal=True, rows_per_task=ROWS_PER_TASK).select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("attempt"))
    return twice.selectExpr(*RESPONSES)


_PARSED_CTE = f"""tries AS (SELECT o_orderkey AS document_id, attempt, {_KIND} AS kind, CAST({_CONF} AS DOUBLE) AS conf
    FROM orders, (SELECT unnest([0, 1]) AS attempt)),
parsed AS (SELECT *, CASE kind WHEN 0 THEN 'ok' WHEN 1 THEN 'ok' WHEN 2 THEN 'timeout' WHEN 3 THEN 'empty' WHEN 4 THEN 'parse_failed' WHEN 7 THEN 'llm_error' ELSE 'ok' END AS outcome,
  CASE kind WHEN 0 THEN 'high' WHEN 1 THEN 'MEDIUM' WHEN 5 THEN 'low' WHEN 6 THEN 'safe' WHEN 8 THEN 'high' WHEN 9 THEN 'low' END AS risk_level,
  CASE kind WHEN 0 THEN conf WHEN 1 THEN conf WHEN 5 THEN 0.7::DOUBLE WHEN 6 THEN conf WHEN 8 THEN conf WHEN 9 THEN conf END AS confidence,
  CASE kind WHEN 0 THEN 'e' WHEN 1 THEN '' WHEN 5 THEN {quote(fv.HEAD_ONLY_EXPLANATION)} WHEN 6 THEN 'ok' WHEN 8 THEN 'q' WHEN 9 THEN 'b' END AS explanation FROM tries)"""
_BEST_CTE = """best AS (SELECT a.document_id, CASE WHEN a.outcome = 'ok' THEN 0 WHEN b.outcome = 'ok' THEN 1 END AS used, b.outcome AS last_outcome,
  CASE WHEN a.outcome = 'ok' OR b.outcome = 'ok' THEN 'ok' ELSE b.outcome END AS analysis_status,
  CASE WHEN b.outcome = 'parse_failed' OR a.outcome = 'parse_failed' THEN '분석할 수 없습니다.' END AS last_text,
  CASE WHEN a.outcome = 'ok' THEN a.risk_level ELSE b.risk_level END AS model_level,
  CASE WHEN a.outcome = 'ok' THEN a.confidence ELSE b.confidence END AS model_confidence,
  CASE WHEN a.outcome = 'ok' THEN a.explanation ELSE b.explanation END AS model_explanation
  FROM parsed a JOIN parsed b ON a.document_id = b.document_id AND a.attempt = 0 AND b.attempt = 1)"""


@query("x26_parse_responses", f"WITH {_PARSED_CTE} SELECT document_id, attempt, outcome, risk_level, confidence, explanation FROM parsed")
def parse_responses(spark, sf):
    parsed = exchange.parse_responses(responses(spark, sf))
    said = F.col("verdict").isNotNull()
    return parsed.select(
        "document_id", "attempt", "outcome", "verdict.risk_level", "verdict.confidence",
        F.when(said, F.coalesce("verdict.explanation", F.lit(""))).alias("explanation"),
    )


@query("r6_best_attempt", f"WITH {_PARSED_CTE}, {_BEST_CTE} SELECT document_id, analysis_status, CASE WHEN analysis_status = 'ok' THEN model_level END AS risk_level FROM best")
def best_attempt(spark, sf):
    best = exchange.best_attempts(exchange.parse_responses(responses(spark, sf)))
    return best.select("document_id", "analysis_status", "verdict.risk_level")


@query("s18_quarantine", f"WITH {_PARSED_CTE}, {_BEST_CTE} SELECT document_id, analysis_status, coalesce(last_text, '<EMPTY>') AS raw_text FROM best WHERE analysis_status <> 'ok'")
def quarantine(spark, sf):
    best = exchange.best_attempts(exchange.parse_responses(responses(spark, sf)))
    return exchange.quarantine(best).select("document_id", "analysis_status", "raw_text")


_FAIL_TEXT = sql_map("b.analysis_status", {**fv.FAILURE_EXPLANATIONS, "llm_error": fv.MODEL_ERROR_EXPLANATION.replace("{error}", "Exception")}, "''")
_SAFE_TEXT = sql_map("v.safe_reason", fv.SAFE_EXPLANATIONS, quote(fv.SAFE_DEFAULT_EXPLANATION))
_HIGH_TEXT = sql_map("v.high_risk_type", fv.HIGH_EXPLANATIONS, "v.high_reason")
_FOLDED_CTE = f"""{CLAUSES_CTE}, {RULED_CTE}, {_PARSED_CTE}, {_BEST_CTE},
cases AS (SELECT v.*, b.*, CASE WHEN b.analysis_status = 'llm_error' THEN 'failed' WHEN b.analysis_status <> 'ok' AND v.high_reason IS NOT NULL THEN 'high'
    WHEN b.analysis_status <> 'ok' AND v.safe_reason IS NOT NULL THEN 'safe' WHEN b.analysis_status <> 'ok' THEN 'failed'
    WHEN v.high_reason IS NOT NULL AND b.model_level = 'safe' THEN 'high' ELSE 'model' END AS decided,
    {_FAIL_TEXT} AS fail_text, {_SAFE_TEXT} AS safe_text, {_HIGH_TEXT} AS high_text
  FROM verdicts v JOIN best b ON v.document_id = b.document_id WHERE v.clause_pos = 2),
folded AS (SELECT document_id, clause_pos, CASE decided WHEN 'high' THEN 'high' WHEN 'safe' THEN 'safe' WHEN 'failed' THEN 'medium' ELSE model_level END AS risk_level,
  CASE decided WHEN 'high' THEN 0.95::DOUBLE WHEN 'safe' THEN 0.95::DOUBLE WHEN 'failed' THEN 0.3::DOUBLE ELSE model_confidence END AS confidence,
  CASE decided WHEN 'high' THEN high_text WHEN 'safe' THEN safe_text WHEN 'failed' THEN fail_text ELSE model_explanation END AS explanation,
  CASE decided WHEN 'failed' THEN analysis_status ELSE 'ok' END AS analysis_status FROM cases)"""


@query("r4_r5_fold_responses", f"WITH {_FOLDED_CTE} SELECT document_id, clause_pos, risk_level, confidence, explanation, analysis_status FROM folded")
def fold_responses(spark, sf):
    best = exchange.best_attempts(exchange.parse_responses(responses(spark, sf)))
    second = rules.apply_rules(split(spark, sf).filter(F.col("clause_pos") == 2))
    return exchange.fold_responses(second, best).select(
        "document_id", "clause_pos", "risk_level", "confidence", "explanation", "analysis_status"
    )


@query("j11_so3_attach_verdicts", f"""WITH {_FOLDED_CTE}, said AS (SELECT document_id, clause_pos, risk_level, confidence, explanation, analysis_status FROM folded f
      WHERE (SELECT verdict_source FROM verdicts v WHERE v.document_id = f.document_id AND v.clause_pos = 2) = 'model'
    UNION ALL SELECT v.document_id, v.clause_pos, 'safe', 0.95::DOUBLE, {_SAFE_TEXT}, 'ok' FROM verdicts v WHERE verdict_source = 'rule_safe'
    UNION ALL SELECT v.document_id, v.clause_pos, 'high', 0.95::DOUBLE, {_HIGH_TEXT}, 'ok' FROM verdicts v WHERE verdict_source = 'rule_high')
    SELECT document_id, clause_pos, lower(coalesce(risk_level, 'medium')) AS risk_level, coalesce(confidence, 0.3::DOUBLE) AS confidence,
      coalesce(explanation, {quote(fv.MISSING_EXPLANATION)}) AS explanation, coalesce(analysis_status, 'missing') AS analysis_status
    FROM clauses LEFT JOIN said USING (document_id, clause_pos)""")
def attach_verdicts(spark, sf):
    from clausewise.plans.review import verdicts

    clauses = write_shared(ruled(spark, sf), "ruled-clauses")
    return analysis.attach_verdicts(
        clauses.select("document_id", "clause_pos", "title"), verdicts(clauses, exchange.best_attempts(exchange.parse_responses(responses(spark, sf))))
    ).select("document_id", "clause_pos", "risk_level", "confidence", "explanation", "analysis_status")


_RAW_TYPES = "CASE o_custkey % 6 WHEN 0 THEN '권리제한' WHEN 1 THEN '권리 제한' WHEN 2 THEN ' 위약금_과다 ' WHEN 3 THEN '보증금 미반환' WHEN 4 THEN 'unknown' ELSE '수선 의무 전가' END"


@query("j14_u2_risk_types", f"""WITH raw AS (SELECT DISTINCT 'lease' AS contract_type, {_RAW_TYPES} AS raw FROM orders),
    known(raw, risk_type) AS (VALUES ('권리제한', '권리제한'), ('권리 제한', '권리제한'), (' 위약금_과다 ', '위약금_과다'), ('보증금 미반환', '보증금_미반환_위험'), ('unknown', 'unknown'), ('수선 의무 전가', '수선의무_전가'))
    SELECT contract_type, raw, risk_type FROM raw JOIN known USING (raw)""")
def risk_types(spark, sf):
    """Fuzzy match of raw risk types; the twin lists the targets, tests compare the ratio with a loop."""
    raw = table(spark, sf, "orders").selectExpr("'lease' AS contract_type", f"{_RAW_TYPES} AS raw")
    return analysis.risk_type_map(raw)


@query("j14_listed_risk_types")
def listed_risk_types(spark, sf):
    """Names of a listed vocabulary, cut, turned around and misspelt, matched by candidates; the ratio is not SQL's, a test compares a loop."""
    parts = table(spark, sf, "part")
    listed = parts.groupBy(F.col("p_brand").alias("contract_type"), F.col("p_name").alias("risk_type")).agg(F.min("p_partkey").alias("ord"))
    said = "CASE p_partkey % 4 WHEN 0 THEN substring(p_name, 2) WHEN 1 THEN reverse(p_name) WHEN 2 THEN replace(p_name, ' ', '_x') ELSE p_type || ' ' || p_name END"
    return analysis.risk_type_map(parts.selectExpr("p_brand AS contract_type", f"{said} AS raw"), listed)


_RAW_CLEAN = "CASE o_custkey % 3 WHEN 0 THEN '<think>생각</think>' ELSE '' END || CASE o_custkey % 2 WHEN 0 THEN '수정 조항: ' ELSE '' END || '본문 ' || CAST(o_orderkey AS STRING) || CASE o_custkey % 5 WHEN 0 THEN '</think>' ELSE '' END"


@query("x25_r7_clean_rewrites", "SELECT o_orderkey AS document_id, 1 AS clause_pos, '본문 ' || o_orderkey AS suggested_rewrite FROM orders WHERE o_orderstatus <> 'P' AND o_custkey % 7 <> 0")
def clean_rewrites(spark, sf):
    said = table(spark, sf, "orders", deal=True).selectExpr(
        "o_orderkey AS document_id", "1 AS clause_pos", f"CASE WHEN o_custkey % 7 = 0 THEN '  ' ELSE {_RAW_CLEAN} END AS raw_text",
        "CASE o_orderstatus WHEN 'P' THEN 'timeout' ELSE 'ok' END AS status",
    )
    return exchange.rewrites(said)


# --- analyses for roll-ups: one clause per line item -----------------------------------------------

ANALYSES = [
    "l_orderkey AS document_id",
    "(l_partkey * 10 + l_linenumber) * 10000 + l_suppkey AS clause_pos",
    "l_linenumber AS clause_index",
    "CASE WHEN l_suppkey % 3 = 0 THEN '' ELSE '조항 ' || CAST(l_partkey AS STRING) END AS title",
    "CASE WHEN l_quantity < 10 THEN 'high' WHEN l_quantity < 20 THEN 'medium' WHEN l_quantity < 30 THEN 'low' ELSE 'safe' END AS risk_level",
    "l_discount AS confidence",
    "CASE WHEN l_returnflag = 'N' THEN '' ELSE '설명 ' || l_returnflag END AS explanation",
]
ANALYSES_CTE = f"a AS (SELECT {', '.join(ANALYSES)}, l_linestatus FROM lineitem)"
LEVEL_CTE = "d AS (SELECT document_id, " + ", ".join(f"count(*) FILTER (WHERE risk_level = '{l}') AS {l}" for l in fv.SEVERITY) + " FROM a GROUP BY document_id)"


def analyses(spark, sf):
    risk = f"struct({{0}} AS risk_type, '' AS description, '' AS suggestion)"
    lines = table(spark, sf, "lineitem").selectExpr(*ANALYSES, "l_linestatus")
    risks = F.when(
        F.col("l_linestatus") == "F", F.expr(f"array({risk.format(quote('권리제한'))}, {risk.format(quote('위약금_과다'))})")
    ).otherwise(F.array().cast(f"array<{R.RISK.simpleString()}>"))
    return lines.withColumn("risks", risks).drop("l_linestatus")


@query("a12_contract_totals", f"WITH {ANALYSES_CTE} SELECT document_id, count(*) AS total_clauses, count(*) FILTER (WHERE risk_level <> 'safe') AS risky_clauses FROM a GROUP BY 1")
def contract_totals(spark, sf):
    return rollups.contract_totals(analyses(spark, sf))


@query("a13_risk_distribution", f"WITH {ANALYSES_CTE}, {LEVEL_CTE} SELECT * FROM d")
def risk_distribution(spark, sf):
    return rollups.risk_distribution(analyses(spark, sf))


@query("a14_w10_risk_shares", f"""WITH {ANALYSES_CTE}, c AS (SELECT document_id, risk_level, CASE risk_level WHEN 'high' THEN 0 WHEN 'medium' THEN 1 WHEN 'low' THEN 2 ELSE 3 END AS severity, count(*) AS n FROM a GROUP BY 1, 2)
    SELECT document_id, CAST(severity AS INT) AS severity, risk_level, n, round(n / sum(n) OVER (PARTITION BY document_id), 6) AS share,
      round(coalesce(sum(n) OVER (PARTITION BY document_id ORDER BY severity ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / sum(n) OVER (PARTITION BY document_id), 6) AS cumulative_before FROM c""")
def risk_shares(spark, sf):
    shares = rollups.risk_shares(rollups.risk_distribution(analyses(spark, sf)))
    return shares.withColumn("share", F.round("share", 6)).withColumn("cumulative_before", F.round("cumulative_before", 6))


_ORDER = "CASE risk_level WHEN 'high' THEN 0 WHEN 'medium' THEN 1 WHEN 'low' THEN 2 ELSE 3 END, confidence DESC, clause_pos"


def _top(n: int, levels: str) -> str:
    return f"SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY {_ORDER}) AS pos FROM a WHERE risk_level IN ({levels}) QUALIFY pos <= {n}"


@query("t3_top3_risky", f"WITH {ANALYSES_CTE} SELECT document_id, clause_pos, risk_level, confidence, CAST(pos AS INT) AS pos FROM ({_top(3, quote('high') + ', ' + quote('medium'))})")
def top3_risky(spark, sf):
    return rollups.top_risky(analyses(spark, sf), 3, ["high", "medium"]).select("document_id", "clause_pos", "risk_level", "confidence", "pos")


_EIGHT = _top(8, "'high', 'medium', 'low'")


@query("t4_a19_risky_summary", f"""WITH {ANALYSES_CTE}, t AS ({_EIGHT})
    SELECT document_id, string_agg('- [' || CASE risk_level WHEN 'high' THEN '고위험' WHEN 'medium' THEN '중위험' ELSE '저위험' END || '] ' || CASE WHEN title = '' THEN '제' || clause_index || '조' ELSE title END
      || CASE WHEN explanation <> '' THEN chr(10) || '  · 분석: ' || explanation ELSE '' END
      || CASE WHEN l_linestatus = 'F' THEN chr(10) || '  · 위험유형: 권리제한, 위약금_과다' ELSE '' END, chr(10) ORDER BY pos) AS risky_summary FROM t GROUP BY document_id""")
def risky_summary(spark, sf):
    return rollups.risky_summary(analyses(spark, sf))


@query("t5_safe_overview", f"""WITH {ANALYSES_CTE}, s AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY clause_pos) AS pos, count(*) OVER (PARTITION BY document_id) AS n FROM a WHERE risk_level = 'safe'),
    g AS (SELECT document_id, any_value(n) AS n, string_agg(CASE WHEN title = '' THEN '제' || clause_index || '조' ELSE title END, ', ' ORDER BY pos) AS titles FROM s WHERE pos <= 5 GROUP BY 1)
    SELECT document_id, CASE WHEN n > 5 THEN n || '개 조항이 안전으로 분석됨 (예: ' || titles || ' 외 ' || (n - 5) || '건)' ELSE n || '개 조항이 안전으로 분석됨 (' || titles || ')' END AS safe_overview FROM g""")
def safe_overview(spark, sf):
    return rollups.safe_overview(analyses(spark, sf))


_FALLBACK = """CASE WHEN high + medium + low = 0 THEN '총 ' || safe || '개 조항을 분석한 결과, 특별히 불리한 조항이 발견되지 않았습니다.'
  ELSE '총 ' || (high + medium + low + safe) || '개 조항 중 ' || (high + medium + low) || '개 조항에서 위험 요소가 발견되었습니다 (' ||
  concat_ws(', ', CASE WHEN high > 0 THEN '고위험 ' || high || '개' END, CASE WHEN medium > 0 THEN '중위험 ' || medium || '개' END, CASE WHEN low > 0 THEN '저위험 ' || low || '개' END)
  || '). 세부 내용을 확인하고 계약 전 수정을 요청하세요.' END"""


@query("a20_r8_summary", f"""WITH {ANALYSES_CTE}, {LEVEL_CTE} SELECT document_id, CASE WHEN document_id % 3 = 0 THEN '■ 전반 평가' || chr(10) || '균형 ' || document_id || chr(10) || chr(10) || '■ 분석 통계' || chr(10) || '전체 ' || (high + medium + low + safe)
      || '개 조항 중 고위험 ' || high || '개, 중위험 ' || medium || '개, 저위험 ' || low || '개로 분석되었습니다.' ELSE {_FALLBACK} END AS summary FROM d""")
def summary(spark, sf):
    said = table(spark, sf, "orders").selectExpr(
        "o_orderkey AS document_id",
        "'종합 평가:' || chr(10) || '**■ 전반 평가**' || chr(10) || '균형 ' || CAST(o_orderkey AS STRING) AS raw_text",
        "CASE o_orderkey % 3 WHEN 0 THEN 'ok' WHEN 1 THEN 'timeout' ELSE 'empty' END AS status",
    )
    return rollups.choose_summary(rollups.risk_distribution(analyses(spark, sf)), said)


@query("w14_first_risky", f"WITH {ANALYSES_CTE} SELECT document_id, min(clause_pos) FILTER (WHERE risk_level <> 'safe') AS first_risky FROM a GROUP BY 1")
def first_risky(spark, sf):
    return rollups.first_risky(analyses(spark, sf))


@query("p10_t2_risky_in_order", f"WITH {ANALYSES_CTE} SELECT document_id, clause_pos, risk_level IN ('high', 'medium') AS to_rewrite FROM a WHERE risk_level <> 'safe'")
def risky_in_order(spark, sf):
    level = F.col("risk_level")
    return rollups.clause_order(analyses(spark, sf).filter(R.is_risky(level))).select(
        "document_id", "clause_pos", R.needs_rewrite(level).alias("to_rewrite")
    )


@query("x31_rewrite_requests", f"""WITH {ANALYSES_CTE} SELECT document_id, clause_pos, '[' || clause_index || '] ' || title || chr(10) || '원문 ' || clause_pos AS clause_text,
    CASE WHEN explanation = '' AND l_linestatus <> 'F' THEN {quote(fv.NO_RISK_DETAIL)} ELSE concat_ws(chr(10), CASE WHEN explanation <> '' THEN '- 종합 평가: ' || explanation END,
      CASE WHEN l_linestatus = 'F' THEN '- 위험유형: 권리제한' || chr(10) || '- 위험유형: 위약금_과다' END) END AS risk_summary, {quote(fv.NO_REWRITE_REFERENCES)} AS reference_context
    FROM a WHERE risk_level IN ('high', 'medium')""")
def rewrite_requests(spark, sf):
    rows = analyses(spark, sf).withColumn("content", F.concat(F.lit("원문 "), "clause_pos"))
    none = rows.select("document_id", "clause_pos", F.lit("").alias("reference_text")).filter("false")
    return exchange.rewrite_requests(rows, none)


# --- references ---------------------------------------------------------------------------------------

_SOURCE = "CASE p_size % 4 WHEN 0 THEN 'law' WHEN 1 THEN 'precedent_kr' WHEN 2 THEN 'aihub_약관' ELSE '민법' END"
DETAILS_CTE = f"""hits AS (SELECT l_suppkey AS document_id, l_linenumber AS clause_pos, 1 AS pos, p_name || ' ' || p_brand AS text, {_SOURCE} AS source,
    round(l_discount * 10, 4) AS similarity, p_type AS article FROM lineitem JOIN part ON l_partkey = p_partkey),
details AS (SELECT *, {sql_map('source', fv.REPORT_CATEGORY, "'law'")} AS category FROM hits)"""


def details(spark, sf):
    joined = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return analysis.reference_details(
        joined.selectExpr(
            "l_suppkey AS document_id", "l_linenumber AS clause_pos", "1 AS pos", "p_name || ' ' || p_brand AS text",
            f"{_SOURCE} AS source", "round(l_discount * 10, 4) AS similarity", "p_type AS article",
        )
    )


@query("a15_aggregate_references", f"""WITH {DETAILS_CTE}, g AS (SELECT document_id, category, text AS ref_key, max(similarity) AS similarity, count(DISTINCT clause_pos) AS n_cited_by, min(clause_pos) AS first_cited_by FROM details GROUP BY 1, 2, 3),
    f AS (SELECT document_id, category, text AS ref_key, source, article, row_number() OVER (PARTITION BY document_id, category, text ORDER BY clause_pos, source, article) AS r FROM details)
    SELECT g.*, f.source, f.article FROM g JOIN f USING (document_id, category, ref_key) WHERE r = 1""")
def aggregate_references(spark, sf):
    return rollups.aggregate_references(details(spark, sf)).drop("text")


@query("a15_citations", f"WITH {DETAILS_CTE} SELECT DISTINCT document_id, category, text AS ref_key, clause_pos FROM details")
def citations(spark, sf):
    return rollups.citations(details(spark, sf))


@query("t6_top_references", f"""WITH {DETAILS_CTE}, g AS (SELECT document_id, category, text AS ref_key, max(similarity) AS similarity, min(clause_pos) AS first_cited_by FROM details GROUP BY 1, 2, 3)
    SELECT document_id, category, ref_key, CAST(row_number() OVER (PARTITION BY document_id, category ORDER BY similarity DESC, first_cited_by, ref_key) AS INT) AS pos FROM g QUALIFY pos <= 10""")
def top_references(spark, sf):
    best = rollups.reference_order(rollups.aggregate_references(details(spark, sf)), 10)
    return best.select("document_id", "category", "ref_key", "pos")


@query("j12_t6_attach_references", f"""WITH {CLAUSES_CTE}, r AS (SELECT document_id, clause_pos, unnest([1, 2, 3]) AS pos FROM clauses WHERE clause_pos <> 3),
    s AS (SELECT *, (document_id % 7 + pos * 3) % 11 / 10.0::DOUBLE AS similarity FROM r)
    SELECT c.document_id, c.clause_pos, coalesce(string_agg('글 ' || s.pos || '... (유사도: ' || printf('%.2f', similarity) || ')', '|' ORDER BY similarity DESC, s.pos), '') AS refs
    FROM clauses c LEFT JOIN s ON s.document_id = c.document_id AND s.clause_pos = c.clause_pos GROUP BY 1, 2""")
def attach_references(spark, sf):
    clauses = write_shared(split(spark, sf).select("document_id", "clause_pos"), "clause-keys")
    hits = clauses.filter(F.col("clause_pos") != 3).select(
        "document_id", "clause_pos", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("pos")
    )
    hits = hits.select(
        "*", F.concat(F.lit("글 "), "pos").alias("text"), F.lit("law").alias("source"), F.lit("").alias("article"),
        (((F.col("document_id") % 7 + F.col("pos") * 3) % 11) / 10.0).alias("similarity"),
    )
    joined = analysis.attach_references(clauses, analysis.reference_details(hits))
    return joined.select("document_id", "clause_pos", F.array_join("similar_references", "|").alias("refs"))


# --- overrides, rewrites, exports ------------------------------------------------------------------------

_EDIT = ["user_id AS document_id", "CAST(value AS INT) % 5 AS clause_pos", "CASE event_type WHEN 'view' THEN ' ' ELSE event_type END AS text", "ts AS edited_at", "event_id"]


@query("s13_w9_st2_overrides", f"""WITH e AS (SELECT user_id AS document_id, CAST(floor(value) AS INT) % 5 AS clause_pos, event_type, ts, event_id FROM events),
    l AS (SELECT *, row_number() OVER (PARTITION BY document_id, clause_pos ORDER BY ts DESC, event_id DESC) AS r FROM e)
    SELECT document_id, clause_pos, CASE event_type WHEN 'view' THEN NULL ELSE event_type END AS user_override,
      CASE WHEN event_type <> 'view' THEN strftime(ts, '%Y-%m-%dT%H:%M:%S+00:00') END AS user_override_at FROM l WHERE r = 1""")
def overrides(spark, sf):
    return analysis.latest_overrides(table(spark, sf, "events").selectExpr(*_EDIT), tie="event_id")


_REWRITE = "CASE document_id % 3 WHEN 0 THEN '수정 조항' || chr(10) || '둘째 줄' WHEN 1 THEN '  ' END"
_OVERRIDE = "CASE document_id % 5 WHEN 0 THEN '사용자 문안' END"
_FINAL = f"coalesce({_OVERRIDE}, CASE document_id % 3 WHEN 0 THEN '수정 조항' || chr(10) || '둘째 줄' END)"
_LEVELS = "CASE document_id % 4 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' WHEN 2 THEN 'low' ELSE 'safe' END"


def _revised(spark, sf):
    return split(spark, sf).selectExpr(
        "document_id", "clause_pos", "clause_index", "title", "content", f"{_LEVELS} AS risk_level", "'설명' AS explanation",
        f"{_REWRITE} AS suggested_rewrite", f"{_OVERRIDE} AS user_override",
    )


@query("j13_final_text", f"""WITH {CLAUSES_CTE} SELECT document_id, clause_pos, {_FINAL} AS text, CASE WHEN document_id % 5 = 0 THEN '[수정안 (사용자)]' WHEN document_id % 3 = 0 THEN '[권고 수정안]' ELSE '' END AS label FROM clauses""")
def final_text(spark, sf):
    rows = _revised(spark, sf)
    base = rows.select("document_id", "clause_pos")
    written = rows.filter(F.col("suggested_rewrite").isNotNull()).select("document_id", "clause_pos", "suggested_rewrite")
    edited = rows.filter(F.col("user_override").isNotNull()).select("document_id", "clause_pos", "user_override")
    joined = analysis.attach_rewrites(base, written, edited)
    return joined.select(
        "document_id", "clause_pos", analysis.final_text(F.col("suggested_rewrite"), F.col("user_override")).alias("f")
    ).select("document_id", "clause_pos", "f.text", "f.label")


@query("s16_revised_lines", f"""WITH {CLAUSES_CTE}, f AS (SELECT *, {_LEVELS} AS lv, {_FINAL} AS fin FROM clauses),
    l AS (SELECT document_id, clause_pos, list_concat(['제' || clause_index || '조 ' || title, '[' || CASE lv WHEN 'high' THEN '고위험' WHEN 'medium' THEN '중위험' WHEN 'low' THEN '저위험' ELSE '안전' END || '] 설명', '[원문]'],
      string_split(content, chr(10)), CASE WHEN lv IN ('high', 'medium') AND fin IS NOT NULL THEN list_concat([CASE WHEN document_id % 5 = 0 THEN '[수정안 (사용자)]' ELSE '[권고 수정안]' END], string_split(fin, chr(10))) ELSE [] END, ['']) AS ls FROM f)
    SELECT document_id, clause_pos, CAST(i AS INT) AS line_no, ls[i] AS text FROM (SELECT *, unnest(range(1, len(ls) + 1)) AS i FROM l)""")
def revised_lines(spark, sf):
    return analysis.revised_lines(_revised(spark, sf)).drop("kind")


@query("s12_find_analysis", "SELECT o_orderkey AS id, o_custkey FROM orders WHERE o_orderkey = 4711")
def find_analysis(spark, sf):
    results = table(spark, sf, "orders").selectExpr("o_orderkey AS id", "o_custkey")
    return stores.find_analysis(results, 4711, "id")


@query("s11_nested_result", f"""WITH {ANALYSES_CTE} SELECT document_id, count(*) AS n_clauses, string_agg(risk_level, ',' ORDER BY clause_pos, clause_index, title, risk_level) AS levels FROM a GROUP BY 1""")
def nested_result(spark, sf):
    rows = analyses(spark, sf)
    nested = rollups.nested_result(rows, rollups.contract_totals(rows))
    return nested.select(
        "document_id", F.size("clause_analyses").cast("long").alias("n_clauses"),
        F.array_join(F.transform("clause_analyses", lambda c: c["risk_level"]), ",").alias("levels"),
    )


# --- evaluation --------------------------------------------------------------------------------------------

_PRED = """pred AS (SELECT doc_id, CASE WHEN quality = 0 THEN 'risky' ELSE 'safe' END AS ground_truth,
    CASE n_chars % 5 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' WHEN 2 THEN 'low' WHEN 3 THEN 'safe' ELSE 'error' END AS prediction FROM labels JOIN documents USING (doc_id))"""
_HIT = "((ground_truth = 'safe' AND prediction IN ('safe', 'low')) OR (ground_truth = 'risky' AND prediction IN ('high', 'medium')))"


def predictions(spark, sf):
    labelled = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id")
    return labelled.selectExpr(
        "doc_id", "CASE WHEN quality = 0 THEN 'risky' ELSE 'safe' END AS ground_truth",
        "CASE n_chars % 5 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' WHEN 2 THEN 'low' WHEN 3 THEN 'safe' ELSE 'error' END AS prediction",
    )


_METRICS = f"""SELECT round(avg(CAST({_HIT} AS INT)), 6) AS accuracy, coalesce(round(avg(CAST({_HIT} AS INT)) FILTER (WHERE ground_truth = 'safe'), 6), 0) AS safe_accuracy,
    coalesce(round(avg(CAST({_HIT} AS INT)) FILTER (WHERE ground_truth = 'risky'), 6), 0) AS risky_accuracy, count(*) AS total, count(*) FILTER (WHERE {_HIT}) AS correct,
    count(*) FILTER (WHERE ground_truth = 'risky' AND prediction IN ('safe', 'low')) AS false_safe_count,
    count(*) FILTER (WHERE ground_truth = 'safe' AND prediction IN ('high', 'medium')) AS false_risky_count FROM pred"""


def _rounded(metrics):
    rates = ("accuracy", "safe_accuracy", "risky_accuracy")
    return metrics.select(*[F.round(c, 6).alias(c) if c in rates else c for c in metrics.columns])


@query("a17_a18_metrics", f"WITH {_PRED} {_METRICS}")
def metrics(spark, sf):
    return _rounded(evaluation.metrics(predictions(spark, sf)))


@query("a18_confusion", f"WITH {_PRED} SELECT ground_truth, prediction, count(*) AS n FROM pred GROUP BY 1, 2")
def confusion(spark, sf):
    return evaluation.confusion(predictions(spark, sf))


@query("t8_worst_cases", f"""WITH {_PRED}, k AS (SELECT *, CASE WHEN ground_truth = 'risky' AND prediction IN ('safe', 'low') THEN 'missed_risk'
    WHEN ground_truth = 'safe' AND prediction IN ('high', 'medium') THEN 'false_alarm' END AS kind FROM pred)
    SELECT doc_id, ground_truth, prediction, kind, CAST(row_number() OVER (PARTITION BY kind ORDER BY doc_id) AS INT) AS pos FROM k WHERE kind IS NOT NULL QUALIFY pos <= 5""")
def worst_cases(spark, sf):
    return evaluation.worst_cases(predictions(spark, sf), ["doc_id"])


@query("w13_balanced_sample", f"""WITH {_PRED} SELECT doc_id, ground_truth, prediction FROM (SELECT *, row_number() OVER (PARTITION BY ground_truth ORDER BY doc_id) AS r FROM pred)
    WHERE r <= CASE ground_truth WHEN 'safe' THEN 30 ELSE 31 END""")
def balanced_sample(spark, sf):
    return evaluation.balanced_sample(predictions(spark, sf), 61, ["doc_id"])


@query("s14_validation_rows", "SELECT doc_id, text AS clause_text, CAST(2 - quality AS STRING) AS dv, CASE WHEN quality = 0 THEN 'risky' ELSE 'safe' END AS ground_truth FROM labels JOIN documents USING (doc_id) WHERE length(trim(text)) > 0")
def validation_rows(spark, sf):
    from clausewise.sources.kb_files import label_truth

    rows = table(spark, sf, "labels").join(table(spark, sf, "documents"), "doc_id").selectExpr(
        "doc_id", "text AS clause_text", "CAST(2 - quality AS STRING) AS dv"
    )
    return label_truth(rows)


@query("h7_evaluation", f"""WITH {CLAUSES_CTE}, {RULED_CTE}, pred AS (SELECT CASE WHEN document_id % 2 = 0 THEN 'risky' ELSE 'safe' END AS ground_truth,
    CASE verdict_source WHEN 'rule_safe' THEN 'safe' WHEN 'rule_high' THEN 'high' ELSE 'medium' END AS prediction FROM verdicts) {_METRICS}""")
def evaluate(spark, sf):
    """Rules applied to the clauses of all contracts, then the accuracy roll-up."""
    items = split(spark, sf).select(
        "document_id", "clause_pos", "contract_type", F.col("content").alias("clause_text"),
        F.when(F.col("document_id") % 2 == 0, "risky").otherwise("safe").alias("ground_truth"),
    )
    return _rounded(accuracy.evaluate(items))


@query("summary_requests", f"""WITH {ANALYSES_CTE}, {LEVEL_CTE} SELECT document_id, '임대차계약' AS contract_type_label, high + medium + low + safe AS total_clauses, high, medium, low,
    CAST(least(high + medium + low, 8) AS BIGINT) AS top_n FROM d""")
def summary_requests(spark, sf):
    rows = analyses(spark, sf)
    typed = rows.select("document_id", F.lit("lease").alias("contract_type")).distinct()
    return rollups.summary_requests(rows, typed).drop("risky_summary", "safe_overview")


