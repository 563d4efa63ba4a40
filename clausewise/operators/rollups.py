"""Roll-ups over clause analyses and the knowledge base."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausewise import fixed_values as fv
from clausewise.functions import responses as R
from clausewise.functions.text import head, lookup, strip
from clausewise.operators.exchange import ordered_text
from clausewise.operators.fusion import report_category
from clausewise.operators.skew import top_n

# --- knowledge base ------------------------------------------------------------------


def count_by_source(kb: DataFrame) -> DataFrame:
    return kb.groupBy(F.coalesce("source", F.lit("unknown")).alias("source")).agg(F.count("*").alias("n"))


def collection_status(kb: DataFrame) -> DataFrame:
    counted = kb.agg(F.count("*").alias("document_count"))
    return counted.select("document_count", F.when(F.col("document_count") > 0, "ready").otherwise("empty").alias("status"))


def category_totals(kb: DataFrame) -> DataFrame:
    """One row: total, laws, judgments, clauses."""
    by_source = count_by_source(kb)
    category = report_category(F.col("source"))

    def total(name: str):
        return F.coalesce(F.sum(F.when(category == name, F.col("n")).otherwise(0)), F.lit(0))

    return by_source.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total"),
        total("law").alias("laws"),
        total("judgment").alias("judgments"),
        total("clause").alias("clauses"),
    )


def build_counts(kb: DataFrame) -> DataFrame:
    """Rows per contract type, and per law kind, law and type, in one pass."""
    sets = kb.groupingSets(
        [[F.col("contract_type")], [F.col("law_kind"), F.col("law_name"), F.col("contract_type")]],
        "law_kind", "law_name", "contract_type",
    )
    return sets.agg(F.count("*").alias("n"), F.grouping("law_name").alias("is_type_total"))


# --- contracts -------------------------------------------------------------------------


def contract_totals(analyses: DataFrame) -> DataFrame:
    return analyses.groupBy("document_id").agg(
        F.count("*").alias("total_clauses"),
        F.count_if(R.is_risky(F.col("risk_level"))).alias("risky_clauses"),
    )


def risk_distribution(analyses: DataFrame) -> DataFrame:
    """One column per level, zero when a contract has none."""
    return analyses.groupBy("document_id").agg(
        *[F.count_if(F.col("risk_level") == level).alias(level) for level in fv.SEVERITY]
    )


def risk_shares(distribution: DataFrame) -> DataFrame:
    """(document_id, level, n, share, cumulative_before) of the levels that occur.

    Four fixed levels per contract, so shares and running totals are plain column sums.
    """
    total = sum((F.col(level) for level in fv.SEVERITY[1:]), F.col(fv.SEVERITY[0]))
    rows = []
    before = F.lit(0)
    for rank, level in enumerate(fv.SEVERITY):
        rows.append(
            F.struct(
                F.lit(rank).alias("severity"),
                F.lit(level).alias("risk_level"),
                F.col(level).alias("n"),
                (F.col(level) / F.col("_total")).alias("share"),
                (before / F.col("_total")).alias("cumulative_before"),
            )
        )
        before = before + F.col(level)
    return (
        distribution.withColumn("_total", total)
        .filter(F.col("_total") > 0)
        .select("document_id", F.inline(F.array(*rows)))
        .filter(F.col("n") > 0)
    )


def _reference_key(size: int | None) -> Column:
    return strip(F.col("text")) if size is None else head(strip(F.col("text")), size)


def aggregate_references(details: DataFrame, size: int | None = None) -> DataFrame:
    """References of a contract grouped by category and text, or its first ``size`` characters.

    Highest similarity, number of distinct citing clauses, and source and text of the
    first citation.  Citations are counted after a distinct, never gathered.
    """
    key = _reference_key(size)
    category = F.when(F.col("category").isin("law", "judgment", "clause"), F.col("category")).otherwise("law")
    keyed = details.withColumn("ref_key", key).withColumn("category", category).filter(F.col("ref_key") != "")
    per_clause = keyed.groupBy("document_id", "category", "ref_key", "clause_pos").agg(
        F.max("similarity").alias("similarity"),
        F.min(F.struct("pos", "source", "article", "text")).alias("first"),
    )
    return (
        per_clause.groupBy("document_id", "category", "ref_key")
        .agg(
            F.max("similarity").alias("similarity"),
            F.count("*").alias("n_cited_by"),
            F.min(F.struct("clause_pos", "first")).alias("seen"),
        )
        .select(
            "document_id", "category", "ref_key", "similarity", "n_cited_by",
            F.col("seen.clause_pos").alias("first_cited_by"),
            F.col("seen.first.source").alias("source"),
            F.col("seen.first.article").alias("article"),
            F.col("seen.first.text").alias("text"),
        )
    )


def citations(details: DataFrame, size: int | None = None) -> DataFrame:
    """Distinct (document, category, reference, citing clause) rows behind the roll-up."""
    keyed = details.withColumn("ref_key", _reference_key(size)).filter(F.col("ref_key") != "")
    return keyed.select("document_id", "category", "ref_key", "clause_pos").distinct()


def reference_order(aggregated: DataFrame, n: int | None = None) -> DataFrame:
    """References of each category by falling similarity.

    With ``n`` the best per category and their ``pos``; without it a range-partitioned
    sort of everything, which no single contract can overload.
    """
    order = [F.desc("similarity"), F.asc("first_cited_by"), F.asc("ref_key")]
    if n is None:
        return aggregated.orderBy("document_id", "category", *order)
    return top_n(aggregated, ["document_id", "category"], order, n)


def top_risky(analyses: DataFrame, n: int, levels: list[str]) -> DataFrame:
    """Most severe clauses per contract: severity, then confidence, then position."""
    order = [F.asc(R.severity_rank(F.col("risk_level"))), F.desc("confidence"), F.asc("clause_pos")]
    return top_n(analyses.filter(F.col("risk_level").isin(levels)), ["document_id"], order, n)


def first_risky(analyses: DataFrame) -> DataFrame:
    return analyses.groupBy("document_id").agg(
        F.min(F.when(R.is_risky(F.col("risk_level")), F.col("clause_pos"))).alias("first_risky")
    )


def clause_order(analyses: DataFrame) -> DataFrame:
    return analyses.orderBy("document_id", "clause_pos")


# --- summaries -----------------------------------------------------------------------------


def _clause_title() -> Column:
    return F.coalesce(
        F.nullif("title", F.lit("")), F.concat(F.lit("제"), F.col("clause_index"), F.lit("조"))
    )


def risky_summary(
    analyses: DataFrame, n: int = 8, explanation_size: int | None = None, max_types: int | None = None
) -> DataFrame:
    """(document_id, risky_summary): the ``n`` most severe clauses as text, explanations and types whole by default."""
    said = F.col("explanation") if explanation_size is None else head(F.col("explanation"), explanation_size)
    label = F.coalesce(
        F.when(F.col("risk_level") == "high", fv.RISK_LABELS["high"])
        .when(F.col("risk_level") == "medium", fv.RISK_LABELS["medium"])
        .when(F.col("risk_level") == "low", fv.RISK_LABELS["low"]),
        F.lit("위험"),
    )
    types = F.filter(F.transform("risks", lambda r: r["risk_type"]), lambda t: t != "")
    lines = F.concat_ws(
        "\n",
        F.concat(F.lit("- ["), label, F.lit("] "), _clause_title()),
        F.when(F.col("explanation") != "", F.concat(F.lit("  · 분석: "), said)),
        F.when(F.size(types) > 0, F.concat(F.lit("  · 위험유형: "), F.array_join(types if max_types is None else F.slice(types, 1, max_types), ", "))),
    )
    best = top_risky(analyses, n, ["high", "medium", "low"])
    return (
        best.select("document_id", F.struct("pos", lines.alias("line")).alias("row"))
        .groupBy("document_id")
        .agg(F.collect_list("row").alias("rows"))
        .select("document_id", ordered_text(F.col("rows"), "\n").alias("risky_summary"))
    )


def safe_overview(analyses: DataFrame, n: int = 5) -> DataFrame:
    """(document_id, safe_overview): first ``n`` safe titles and how many more there are."""
    safe = analyses.filter(F.col("risk_level") == "safe")
    total = safe.groupBy("document_id").agg(F.count("*").alias("n_safe"))
    first = (
        top_n(safe, ["document_id"], [F.asc("clause_pos")], n)
        .select("document_id", F.struct("pos", _clause_title().alias("line")).alias("row"))
        .groupBy("document_id")
        .agg(F.collect_list("row").alias("rows"))
    )
    more = F.col("n_safe") - F.size("rows")
    titles = ordered_text(F.col("rows"), ", ")
    text = F.when(
        more > 0,
        F.concat(
            F.col("n_safe"), F.lit("개 조항이 안전으로 분석됨 (예: "), titles, F.lit(" 외 "), more, F.lit("건)")
        ),
    ).otherwise(F.concat(F.col("n_safe"), F.lit("개 조항이 안전으로 분석됨 ("), titles, F.lit(")")))
    return total.join(first, "document_id").select("document_id", text.alias("safe_overview"))


def fallback_summary(high, medium, low, safe):
    """Sentence built from the level counts; levels that do not occur are left out."""
    risky = high + medium + low
    total = risky + safe

    def part(label: str, n):
        return F.when(n > 0, F.concat(F.lit(label + " "), n, F.lit("개")))

    parts = F.concat_ws(", ", part("고위험", high), part("중위험", medium), part("저위험", low))
    return F.when(
        risky == 0,
        F.concat(F.lit("총 "), total, F.lit("개 조항을 분석한 결과, 특별히 불리한 조항이 발견되지 않았습니다.")),
    ).otherwise(
        F.concat(
            F.lit("총 "), total, F.lit("개 조항 중 "), risky, F.lit("개 조항에서 위험 요소가 발견되었습니다 ("), parts,
            F.lit("). 세부 내용을 확인하고 계약 전 수정을 요청하세요."),
        )
    )


def statistic_line(high, medium, low, safe):
    return F.concat(
        F.lit("■ 분석 통계\n전체 "), high + medium + low + safe, F.lit("개 조항 중 고위험 "), high,
        F.lit("개, 중위험 "), medium, F.lit("개, 저위험 "), low, F.lit("개로 분석되었습니다."),
    )


def choose_summary(distribution: DataFrame, responses: DataFrame) -> DataFrame:
    """Model summary with the statistic line, else the sentence built from counts.

    ``responses(document_id, raw_text, status)``.
    """
    levels = [F.col(level) for level in fv.SEVERITY]
    said = responses.select(
        "document_id",
        F.when(F.col("status") == "ok", R.clean_summary(F.coalesce("raw_text", F.lit("")))).alias("_said"),
    )
    text = F.when(
        F.coalesce("_said", F.lit("")) != "", F.concat(F.col("_said"), F.lit("\n\n"), statistic_line(*levels))
    ).otherwise(fallback_summary(*levels))
    return distribution.join(said, "document_id", "left").select("document_id", text.alias("summary"))


def summary_requests(analyses: DataFrame, contracts: DataFrame, n: int = 8) -> DataFrame:
    """Request table of contract summaries.  ``contracts(document_id, contract_type)``."""
    counts = risk_distribution(analyses)
    label = lookup(F.col("contract_type"), fv.SUMMARY_TYPE_LABELS, F.col("contract_type"))
    risky = F.col("high") + F.col("medium") + F.col("low")
    return (
        counts.join(contracts.select("document_id", "contract_type"), "document_id")
        .join(risky_summary(analyses, n), "document_id", "left")
        .join(safe_overview(analyses), "document_id", "left")
        .select(
            "document_id",
            label.alias("contract_type_label"),
            (risky + F.col("safe")).alias("total_clauses"),
            "high", "medium", "low",
            F.least(risky, F.lit(n)).alias("top_n"),
            F.coalesce("risky_summary", F.lit(fv.NO_RISKY_CLAUSES)).alias("risky_summary"),
            F.coalesce("safe_overview", F.lit(fv.NO_SAFE_CLAUSES)).alias("safe_overview"),
        )
    )


def nested_result(analyses: DataFrame, headers: DataFrame) -> DataFrame:
    """One row per contract with its clauses nested, for the result sink only.

    A contract's clauses come from one text row, so the group is bounded by that text.
    """
    fields = [c for c in analyses.columns if c not in ("document_id", "contract_type")]
    nested = analyses.groupBy("document_id").agg(
        F.array_sort(F.collect_list(F.struct("clause_pos", *[c for c in fields if c != "clause_pos"]))).alias("clause_analyses")
    )
    return headers.join(nested, "document_id")


