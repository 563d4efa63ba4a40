"""Tables handed to and taken from the external model.

Requests are plain text rows; responses come back as ``(keys, attempt, raw_text, status)``
and are folded into one verdict per clause.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausewise import fixed_values as fv
from clausewise.functions import responses as R
from clausewise.functions.text import computed, head, is_blank, lookup
from clausewise.operators import rules

KEYS = ["document_id", "clause_pos"]


def ordered_text(rows: Column, separator: str) -> Column:
    """Join ``array<struct<ord.., text>>`` by its sort order, never by arrival."""
    return F.array_join(F.transform(F.array_sort(rows), lambda r: r["line"]), separator)


# --- requests ------------------------------------------------------------------------------


def parties_text(party_a: Column, party_b: Column) -> Column:
    start, middle, end = fv.PARTIES_TEXT.replace("{b}", "{a}").split("{a}")
    return F.concat(F.lit(start), party_a, F.lit(middle), party_b, F.lit(end))


def reference_texts(hits: DataFrame, keys: list[str] | None = None, top: int = 5, size: int | None = None) -> DataFrame:
    """(keys, reference_text): the first ``top`` hits of a clause as labelled lines, whole or cut at ``size``.

    The position filter bounds each group before anything is gathered.
    """
    keys = keys or KEYS
    lines = hits.filter(F.col("pos") <= top).select(
        *keys,
        F.struct(
            F.col("pos"),
            F.concat(F.lit("[참고"), F.col("pos"), F.lit("] "), F.col("text") if size is None else head(F.col("text"), size)).alias("line"),
        ).alias("row"),
    )
    joined = lines.groupBy(*keys).agg(F.collect_list("row").alias("rows"))
    return joined.select(
        *keys,
        F.concat(F.lit(fv.REFERENCE_LABEL_GUIDE + "\n"), ordered_text(F.col("rows"), "\n")).alias("reference_text"),
    )


def subtype_hint(contract_type: Column, sub_type: Column) -> Column:
    """Hint placed in front of the references of a lease, '' when there is none."""
    return F.when(contract_type == "lease", lookup(sub_type, fv.SUBTYPE_HINTS, F.lit(""))).otherwise("")


def model_requests(clauses: DataFrame, references: DataFrame) -> DataFrame:
    """Request table for unresolved clauses.

    ``clauses`` carry contract_type, sub_type, party_a, party_b; ``references`` is the
    output of :func:`reference_texts`, as long as the clauses: stored texts are far larger than
    their files, so Spark must not judge by those that they fit the driver.
    """
    hint = subtype_hint(F.col("contract_type"), F.col("sub_type"))
    context = F.coalesce(F.col("reference_text"), lookup(F.col("contract_type"), fv.NO_REFERENCE_TEXT, F.lit("")))
    clause = F.concat(
        F.lit("\n["), F.col("clause_index"), F.lit("] "), F.col("title"), F.lit(": "), F.col("content"), F.lit("\n")
    )
    return clauses.join(references.hint("merge"), KEYS, "left").select(
        *KEYS,
        "contract_type",
        parties_text(F.col("party_a"), F.col("party_b")).alias("parties_text"),
        clause.alias("clause_text"),
        F.when(hint != "", F.concat(hint, F.lit("\n"), context)).otherwise(context).alias("reference_context"),
    )


def risk_summary(risks: Column, explanation: Column) -> Column:
    """Risks of one clause as lines of text."""

    def line(label: str, value: Column) -> Column:
        return F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(label), value))

    lines = F.transform(
        F.coalesce(risks, F.array().cast(f"array<{R.RISK.simpleString()}>")),
        lambda r: F.concat_ws(
            "\n",
            F.concat(F.lit("- 위험유형: "), F.coalesce(F.nullif(r["risk_type"], F.lit("")), F.lit("unknown"))),
            line("  설명: ", r["description"]),
            line("  권고: ", r["suggestion"]),
        ),
    )
    text = F.concat_ws("\n", line("- 종합 평가: ", explanation), F.nullif(F.array_join(lines, "\n"), F.lit("")))
    return F.when(text == "", F.lit(fv.NO_RISK_DETAIL)).otherwise(text)


def rewrite_requests(analyses: DataFrame, references: DataFrame) -> DataFrame:
    """Request table for the high and medium clauses."""
    return (
        analyses.filter(R.needs_rewrite(F.col("risk_level")))
        .join(references.hint("merge"), KEYS, "left")
        .select(
            *KEYS,
            F.concat(
                F.lit("["), F.col("clause_index"), F.lit("] "), F.col("title"), F.lit("\n"), F.col("content")
            ).alias("clause_text"),
            risk_summary(F.col("risks"), F.col("explanation")).alias("risk_summary"),
            F.coalesce("reference_text", F.lit(fv.NO_REWRITE_REFERENCES)).alias("reference_context"),
        )
    )


# --- responses ---------------------------------------------------------------------------


def parse_responses(responses: DataFrame) -> DataFrame:
    """Add ``verdict`` (first object, or null) and the status each attempt really had."""
    said = responses.withColumn("_said", R.strip_reasoning(F.coalesce("raw_text", F.lit(""))))
    parsed = said.select(
        *responses.columns,
        computed(
            _list=F.when(F.col("status") == "ok", R.parse_verdicts(F.col("_said"))),
            _blank=is_blank(F.col("_said")),
        ),
    )
    return parsed.select(
        *responses.columns,
        F.try_element_at("_list", F.lit(1)).alias("verdict"),
        F.when(F.col("status") != "ok", F.col("status"))
        .when(F.col("_blank"), "empty")
        .when(F.col("_list").isNull(), "parse_failed")
        .otherwise("ok")
        .alias("outcome"),
    )


def best_attempts(parsed: DataFrame, keys: list[str] | None = None, max_attempts: int | None = None) -> DataFrame:
    """One row per clause: the first usable attempt, else the state of the last one.

    All attempts count unless ``max_attempts`` is given.  ``last_text`` is the text of the latest unparseable
    attempt, kept for quarantine.
    """
    keys = keys or KEYS
    usable = F.col("outcome") == "ok"
    tried = parsed if max_attempts is None else parsed.filter(F.col("attempt") < max_attempts)
    return (
        tried.groupBy(*keys)
        .agg(
            F.min(F.when(usable, F.struct("attempt", "verdict"))).alias("_first"),
            F.max(F.struct("attempt", "outcome")).alias("_last"),
            F.max(F.when(F.col("outcome") == "parse_failed", F.struct("attempt", "raw_text"))).alias("_failed"),
        )
        .select(
            *keys,
            F.col("_first.verdict").alias("verdict"),
            F.when(F.col("_first").isNotNull(), "ok").otherwise(F.col("_last.outcome")).alias("analysis_status"),
            F.when(F.col("_first").isNull(), F.col("_failed.raw_text")).alias("last_text"),
        )
    )


def quarantine(best: DataFrame) -> DataFrame:
    """Clauses no attempt could be read for."""
    return best.filter(F.col("analysis_status") != "ok").select(
        *[c for c in best.columns if c not in ("verdict", "last_text")],
        F.coalesce(F.nullif("last_text", F.lit("")), F.lit("<EMPTY>")).alias("raw_text"),
    )


def failure_verdict(status: Column, error: Column | None = None) -> Column:
    message = F.when(
        status == "llm_error",
        F.replace(F.lit(fv.MODEL_ERROR_EXPLANATION), F.lit("{error}"), error if error is not None else F.lit("Exception")),
    ).otherwise(lookup(
        status, {**fv.FAILURE_EXPLANATIONS, "missing": fv.MISSING_EXPLANATION}, F.lit(fv.FAILURE_EXPLANATIONS["parse_failed"])
    ))
    return F.struct(
        F.lit("medium").alias("risk_level"),
        F.lit(fv.FAILURE_CONFIDENCE).alias("confidence"),
        F.array().cast(f"array<{R.RISK.simpleString()}>").alias("risks"),
        message.alias("explanation"),
    )


def _model_verdict(verdict: Column) -> Column:
    return F.struct(
        F.coalesce(verdict["risk_level"], F.lit("safe")).alias("risk_level"),
        F.coalesce(verdict["confidence"], F.lit(fv.DEFAULT_CONFIDENCE)).alias("confidence"),
        F.coalesce(verdict["risks"], F.array().cast(f"array<{R.RISK.simpleString()}>")).alias("risks"),
        F.coalesce(verdict["explanation"], F.lit("")).alias("explanation"),
    )


def fold_responses(ruled: DataFrame, best: DataFrame) -> DataFrame:
    """Verdict of every clause sent to the model.

    A model 'safe' is raised to high when a high rule fires; medium is left alone.  When no
    attempt could be read the rules decide (high before safe), and otherwise the clause is
    medium with an explicit status.  An error from the model is never replaced by a rule,
    nor is a clause that no response names (status 'missing').
    """
    answered = ruled.join(best.select(*KEYS, "verdict", "analysis_status").hint("merge"), KEYS, "left")
    joined = answered.withColumn("analysis_status", F.coalesce("analysis_status", F.lit("missing")))
    high = rules.high_verdict(F.col("high_risk_type"), F.col("high_reason"))
    fires = F.col("high_reason").isNotNull()
    said_safe = F.lower(F.trim(F.coalesce("verdict.risk_level", F.lit("")))) == "safe"
    failed = F.col("analysis_status") != "ok"
    errored = F.col("analysis_status") == "llm_error"
    missing = F.col("analysis_status") == "missing"
    by_rule = failed & ~errored & ~missing & (fires | F.col("safe_reason").isNotNull())
    final = (
        F.when(errored | missing, failure_verdict(F.col("analysis_status")))
        .when(failed & fires, high)
        .when(failed & F.col("safe_reason").isNotNull(), rules.safe_verdict(F.col("safe_reason")))
        .when(failed, failure_verdict(F.col("analysis_status")))
        .when(fires & said_safe, high)
        .otherwise(_model_verdict(F.col("verdict")))
    )
    return (
        joined.withColumn("_v", final)
        .withColumn("analysis_status", F.when(by_rule, "ok").otherwise(F.col("analysis_status")))
        .drop("verdict")
        .select("*", "_v.*")
        .drop("_v")
    )


def rewrites(responses: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Cleaned rewrites; failed and empty ones are dropped."""
    keys = keys or KEYS
    return (
        responses.filter(F.col("status") == "ok")
        .select(*keys, computed(suggested_rewrite=R.clean_rewrite(F.coalesce("raw_text", F.lit("")))))
        .filter(F.col("suggested_rewrite") != "")
    )


def all_verdicts(*parts: DataFrame) -> DataFrame:
    """Union of rule, model and error verdicts."""
    columns = [*KEYS, "verdict_source", "risk_level", "confidence", "risks", "explanation", "analysis_status"]
    out = parts[0].select(*columns)
    for part in parts[1:]:
        out = out.unionByName(part.select(*columns))
    return out
