"""Tables, derived inputs and the query registry.

Derived inputs are lists of expressions valid in Spark SQL and DuckDB alike, so both sides
start from the same rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from clausewise import fixed_values as fv
from clausewise.session import spread

REGISTRY: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def query(name: str, sql: str | None = None):
    """Register a query; ``sql`` is the equivalent DuckDB statement."""

    def register(fn):
        if name in REGISTRY:
            raise ValueError(f"query registered twice: {name}")
        REGISTRY[name] = (fn, sql)
        return fn

    return register


# rows of orders and parts are short and each becomes a text to work on: no task takes more of them
ROWS_PER_TASK = 50_000


def table(spark: SparkSession, sf: str, name: str, deal: bool = False, rows_per_task: int | None = None) -> DataFrame:
    """A driver table; ``deal`` spreads a single-split file over the cores, in pieces of ``rows_per_task`` where given."""
    df = spark.read.parquet(f"{sf}/{name}.parquet")
    return spread(df, rows_per_task) if deal else df


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def select(columns: list[str], source: str) -> str:
    return f"SELECT {', '.join(columns)} FROM {source}"


# --- knowledge base rows from documents ------------------------------------------------------

KB_TYPES = ["lease", "sales", "employment"]
KB = [
    "CAST(doc_id AS STRING) AS id",
    "text",
    "CASE CAST(substring(source, 4) AS INT) % 4 WHEN 0 THEN 'law' WHEN 1 THEN 'precedent_kr' "
    "WHEN 2 THEN 'aihub_약관' ELSE '기타' END AS source",
    "CASE lang WHEN 'en' THEN 'lease' WHEN 'fr' THEN 'sales' WHEN 'de' THEN 'employment' ELSE 'common' END AS contract_type",
    "source AS law_name",
    "'법률' AS law_kind",
    "CAST(n_chars % 97 AS INT) AS article_no",
    "0 AS sub_no",
    "'' AS article",
]
QUERIES = [
    "CAST(item_id AS STRING) AS query_id",
    "text",
    "CASE item_id % 4 WHEN 0 THEN 'lease' WHEN 1 THEN 'sales' WHEN 2 THEN 'employment' END AS contract_type",
]


def kb(spark: SparkSession, sf: str, deal: bool = False) -> DataFrame:
    return table(spark, sf, "documents", deal).selectExpr(*KB)


def benchmark_queries(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").selectExpr(*QUERIES)


KB_CTE = f"kb AS ({select(KB, 'documents')})"
QUERY_CTE = f"q AS ({select(QUERIES, 'benchmark')})"

# --- contracts written from orders --------------------------------------------------------------

NL = "chr(10)"
_KIND = "o_custkey % 3"
_TITLE = f"CASE {_KIND} WHEN 0 THEN '주택 임대차 계약서' WHEN 1 THEN '용역 도급 계약서' ELSE '금전소비대차 계약서' END"
_PARTIES = (
    f"CASE {_KIND} WHEN 0 THEN '임대인(갑)과 임차인(을)은 아래와 같이 임대차 계약한다.' "
    "WHEN 1 THEN '원사업자( 갑 )와 을 (수급사업자)은 용역 도급 계약한다.' "
    "ELSE '갑(채무자)과 을( 채권자 )은 아래와 같이 대여 계약한다.' END"
)
_SECOND = (
    f"CASE {_KIND} WHEN 0 THEN '차임은 연 ' || CAST(o_orderkey % 40 AS STRING) || '% 이내에서 증액한다.' "
    "WHEN 1 THEN '대금은 ' || CAST(30 + o_orderkey % 70 AS STRING) || '일 이내 지급한다.' "
    "ELSE '약정 이자율은 연 ' || CAST(1 + o_orderkey % 30 AS STRING) || '%로 한다.' END"
)
_THIRD = (
    "CASE o_orderstatus WHEN 'F' THEN '사전 통보 없이 임대인은 출입할 수 있다.' "
    "WHEN 'O' THEN '임차인은 임대인의 동의 없이 임차권을 양도하지 못한다.' "
    "ELSE '쌍방 합의로 계약 조건을 조정할 수 있다.' END"
)
_FOURTH = "'보증금 ' || CAST(CAST(floor(o_totalprice) AS BIGINT) AS STRING) || '원은 종료 시 반환한다.' || chr(10) || '2024년 1월 5일'"
_ITEM1 = "'1. 청소비 ' || CAST(o_custkey % 50 AS STRING) || '만원은 임차인 부담으로 한다.'"
_ITEM2 = "'2) 반려동물은 금지한다.'"
_FOURTH_LINE = "'보증금 ' || CAST(CAST(floor(o_totalprice) AS BIGINT) AS STRING) || '원은 종료 시 반환한다.'"
_HAS_SPECIAL = "o_orderkey % 2 = 0"

CONTRACTS = [
    "o_orderkey AS document_id",
    "'order-' || CAST(o_orderkey AS STRING) || CASE o_custkey % 5 WHEN 0 THEN '.txt' WHEN 1 THEN '.PDF' ELSE '.docx' END AS filename",
    f"{_TITLE} || {NL} || {_PARTIES} || {NL} || '제1조 (목적)' || {NL} || '본 계약의 목적을 정한다.' || {NL} || "
    f"'제2조 (금액)' || {NL} || {_SECOND} || {NL} || '제 3 조 (조건)' || {NL} || {_THIRD} || {NL} || "
    f"'제3조의2 [반환]' || {NL} || {_FOURTH_LINE} || {NL} || "
    f"CASE WHEN {_HAS_SPECIAL} THEN '■ 특약 사항 :' || {NL} || {_ITEM1} || {NL} || {_ITEM2} || {NL} ELSE '' END || "
    "'2024년 1월 5일' AS text",
]
CONTRACT_TYPE = f"CASE {_KIND} WHEN 0 THEN 'lease' WHEN 1 THEN 'service' ELSE 'loan' END"


def contracts(spark: SparkSession, sf: str, typed: bool = False) -> DataFrame:
    """Contract texts; ``typed`` adds the type the text was written for."""
    extra = [f"{CONTRACT_TYPE} AS contract_type"] if typed else []
    return table(spark, sf, "orders", deal=True, rows_per_task=ROWS_PER_TASK).selectExpr(*CONTRACTS, *extra)


def _clause(pos: int, index: int, title: str, body: str, where: str = "") -> str:
    return (
        f"SELECT o_orderkey AS document_id, {pos} AS clause_pos, {index} AS clause_index, '{title}' AS title, "
        f"'{title}' || {NL} || {body} AS content, {CONTRACT_TYPE} AS contract_type FROM orders {where}"
    )


# the clauses the contracts above must split into
CLAUSES_CTE = "clauses AS (" + " UNION ALL ".join(
    [
        _clause(1, 1, "제1조 (목적)", "'본 계약의 목적을 정한다.'"),
        _clause(2, 2, "제2조 (금액)", _SECOND),
        _clause(3, 3, "제 3 조 (조건)", _THIRD),
        _clause(4, 3, "제3조의2 [반환]", _FOURTH),
        _clause(5, 4, "특약사항 1", _ITEM1, f"WHERE {_HAS_SPECIAL}"),
        _clause(6, 5, "특약사항 2", _ITEM2, f"WHERE {_HAS_SPECIAL}"),
    ]
) + ")"
CONTRACTS_CTE = f"contracts AS ({select(CONTRACTS, 'orders')})"


# --- rule verdicts in SQL ---------------------------------------------------------------------------


def _re2(pattern: str) -> str:
    """RE2 has no look-ahead; the one pattern that uses it ends in a digit test."""
    return quote(pattern.replace(r"(?!\d)", r"(?:\D|$)"))


def _any(column: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({column}, {quote(w)})" for w in words) + ")"


VETO_SQL = f"({_any('body', fv.COMMON_VETOES)} OR (contract_type = 'lease' AND {_any('body', fv.LEASE_VETOES)}))"


def _case(rules: list[tuple], field: int) -> str:
    branches = " ".join(
        f"WHEN contract_type = {quote(r[0])} AND regexp_matches(body, {_re2(r[1])}) THEN {quote(r[field])}" for r in rules
    )
    return f"CASE {branches} END"


SAFE_SQL = f"CASE WHEN NOT {VETO_SQL} THEN {_case(fv.SAFE_RULES, 2)} END"
HIGH_TYPE_SQL = _case(fv.HIGH_RULES, 2)
HIGH_REASON_SQL = _case(fv.HIGH_RULES, 3)
BODY_SQL = r"trim(regexp_replace(content, '\s+', ' ', 'g'))"
RULED_CTE = (
    f"bodies AS (SELECT *, {BODY_SQL} AS body FROM clauses), "
    f"ruled AS (SELECT * EXCLUDE (body), {SAFE_SQL} AS safe_reason, {HIGH_REASON_SQL} AS high_reason, "
    f"{HIGH_TYPE_SQL} AS high_risk_type FROM bodies), "
    "verdicts AS (SELECT *, CASE WHEN safe_reason IS NOT NULL THEN 'rule_safe' WHEN high_reason IS NOT NULL "
    "THEN 'rule_high' ELSE 'model' END AS verdict_source FROM ruled)"
)


def sql_map(column: str, values: dict[str, str], default: str) -> str:
    whens = " ".join(f"WHEN {quote(k)} THEN {quote(v)}" for k, v in values.items())
    return f"CASE {column} {whens} ELSE {default} END"
