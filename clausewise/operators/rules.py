"""Deterministic safe / high rules.

A rule set is compiled into one CASE expression per kind: the JVM stops at the first
match, patterns are literals (compiled once per task), and clauses never multiply by
rules the way a join on RLIKE would make them.  A pattern is tried only on texts that
contain the literals it cannot do without.
"""

from __future__ import annotations

import re
from functools import reduce
from re import _parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausewise import dims
from clausewise import fixed_values as fv
from clausewise.functions.responses import RISK
from clausewise.functions.text import UNI, collapse, computed, contains_any, let, lookup


def _flags(pattern: str) -> str:
    """Unicode classes cost time, and collapsed text has no blank but the plain one."""
    return UNI if re.search(r"\\[dDwWbB]", pattern) else "(?d)"


def needed(pattern: str) -> list[list[str]]:
    """What a matching text must contain: one string at least of each list, the longest strings first.

    Literals that the pattern cannot do without, read off its parse tree; of alternatives the longest literal of each.
    """

    def walk(items) -> list[list[str]]:
        found: list[list[str]] = []
        run = ""
        for op, arg in items:
            if op is _parser.LITERAL:
                run += chr(arg)
                continue
            if run:
                found.append([run])
                run = ""
            if op is _parser.SUBPATTERN:
                found += walk(arg[-1])
            elif op is _parser.MAX_REPEAT and arg[0] > 0:
                found += walk(arg[2])
            elif op is _parser.BRANCH:
                sides = [walk(side) for side in arg[1]]
                if all(sides):
                    found.append([word for side in sides for word in max(side, key=_worth)])
        return found + [[run]] if run else found

    return sorted(walk(_parser.parse(pattern)), key=_worth, reverse=True)


def _worth(words: list[str]) -> tuple[int, int]:
    return min(map(len, words)), -len(words)


# the first byte of a Hangul syllable in UTF-8 is nearly always the same and tells nothing; here it is the telling one
_UNITS = "UTF-16LE"


def _guard(units: Column, pattern: str) -> Column | None:
    """Cheap test that a text which matches always passes: two of the needed literals of two characters or more.

    ``units`` is the text in ``_UNITS``, searched as bytes.
    """
    wanted = [words for words in needed(pattern) if min(map(len, words)) > 1 and len(words) <= 4][:2]
    out = None
    for words in wanted:
        hit = reduce(lambda a, b: a | b, [F.contains(units, F.lit(w.encode(_UNITS))) for w in words])
        out = hit if out is None else out & hit
    return out


def any_needed(patterns: list[str]) -> str | None:
    """A pattern for every text that one of ``patterns`` can match: one needed literal of each, or None where one has none.

    Literals are grouped by their first character, so most places of a text are left after a look at it.
    """
    lists = [needed(p) for p in patterns]
    if not all(lists):
        return None
    words = {w for found in lists for w in found[0]}
    words = sorted(w for w in words if not any(w.startswith(v) for v in words if v != w))
    groups = [(first, [re.escape(w[1:]) for w in words if w[0] == first]) for first in dict.fromkeys(w[0] for w in words)]
    return "|".join(re.escape(first) + f"(?:{'|'.join(rest)})" for first, rest in groups)


def vetoed(body: Column, contract_type: Column, vetoes: list[tuple[str, str]]) -> Column:
    """True when a phrase in scope appears; it cancels any safe verdict."""
    out = F.lit(False)
    for scope in dict.fromkeys(s for s, _ in vetoes):
        hit = contains_any(body, [w for s, w in vetoes if s == scope])
        out = out | (hit if scope == "*" else ((contract_type == scope) & hit))
    return out


def first_rule(body: Column, contract_type: Column, rules: list[dims.Rule]) -> Column:
    """``struct<reason, risk_type>`` of the first rule of the type that matches, or null."""
    none = F.lit(None).cast("struct<reason:string,risk_type:string>")

    def tried(own: list[dims.Rule]) -> Column:
        def chained(units: Column) -> Column:
            chain = none
            for rule in reversed(own):
                hit = F.struct(
                    F.lit(rule.reason).alias("reason"),
                    F.lit(rule.risk_type).cast("string").alias("risk_type"),
                )
                matches = body.rlike(_flags(rule.pattern) + rule.pattern)
                guard = _guard(units, rule.pattern)
                chain = F.when(matches if guard is None else guard & matches, hit).otherwise(chain)
            return chain

        return let(F.encode(body, _UNITS), chained)

    out = none
    for ct in dict.fromkeys(r.contract_type for r in rules):
        own = [r for r in rules if r.contract_type == ct]
        chain = tried(own)
        # one pass sets most clauses aside, before the rules are tried one by one
        possible = any_needed([r.pattern for r in own])
        chain = chain if possible is None else F.when(body.rlike(possible), chain)
        out = F.when(contract_type == ct, chain).otherwise(out)
    return out


def safe_rule(
    body: Column,
    contract_type: Column,
    rules: list[dims.Rule] | None = None,
    vetoes: list[tuple[str, str]] | None = None,
) -> Column:
    """``struct<reason, risk_type>`` of the safe verdict, or null.  ``body`` is collapsed."""
    rules = dims.safe_rules() if rules is None else rules
    vetoes = dims.vetoes() if vetoes is None else vetoes
    # few clauses match a rule, and a veto counts for those alone
    return let(
        first_rule(body, contract_type, rules),
        lambda found: F.when(found.isNotNull() & ~vetoed(body, contract_type, vetoes), found),
    )


def high_rule(body: Column, contract_type: Column, rules: list[dims.Rule] | None = None) -> Column:
    rules = dims.high_rules() if rules is None else rules
    return first_rule(body, contract_type, rules)


def apply_rules(
    clauses: DataFrame,
    content_col: str = "content",
    type_col: str = "contract_type",
    safe: list[dims.Rule] | None = None,
    high: list[dims.Rule] | None = None,
    vetoes: list[tuple[str, str]] | None = None,
) -> DataFrame:
    """Add ``safe_reason``, ``high_reason``, ``high_risk_type`` and ``verdict_source``.

    Safe is tried before high, so a clause that matches both is safe; a clause that
    matches neither is left for the model.
    """

    clause = F.struct(collapse(F.col(content_col)).alias("body"), F.col(type_col).alias("kind"))

    def judge(c: Column) -> Column:
        return F.struct(
            safe_rule(c["body"], c["kind"], safe, vetoes).alias("safe"), high_rule(c["body"], c["kind"], high).alias("high")
        )

    # inside ``let`` the rules stay out of the generated code, where their number makes methods too large to be compiled
    matched = clauses.select(*clauses.columns, computed(_rules=let(clause, judge)))
    return matched.select(
        *clauses.columns,
        F.col("_rules.safe.reason").alias("safe_reason"),
        F.col("_rules.high.reason").alias("high_reason"),
        F.col("_rules.high.risk_type").alias("high_risk_type"),
        F.when(F.col("_rules.safe.reason").isNotNull(), "rule_safe")
        .when(F.col("_rules.high.reason").isNotNull(), "rule_high")
        .otherwise("model")
        .alias("verdict_source"),
    )


def safe_verdict(reason: Column) -> Column:
    """Verdict fields of a safe rule."""
    return F.struct(
        F.lit("safe").alias("risk_level"),
        F.lit(fv.RULE_CONFIDENCE).alias("confidence"),
        F.array().cast(f"array<{RISK.simpleString()}>").alias("risks"),
        lookup(reason, fv.SAFE_EXPLANATIONS, F.lit(fv.SAFE_DEFAULT_EXPLANATION)).alias("explanation"),
    )


def high_verdict(risk_type: Column, reason: Column) -> Column:
    """Verdict fields of a high rule."""
    risk = F.struct(
        risk_type.alias("risk_type"),
        reason.alias("description"),
        F.lit(fv.HIGH_SUGGESTION).alias("suggestion"),
    )
    return F.struct(
        F.lit("high").alias("risk_level"),
        F.lit(fv.RULE_CONFIDENCE).alias("confidence"),
        F.array(risk).alias("risks"),
        lookup(risk_type, fv.HIGH_EXPLANATIONS, reason).alias("explanation"),
    )


def rule_verdicts(ruled: DataFrame) -> DataFrame:
    """Clauses the rules decide, with verdict columns (the rest is left out)."""
    verdict = F.when(F.col("verdict_source") == "rule_safe", safe_verdict(F.col("safe_reason"))).otherwise(
        high_verdict(F.col("high_risk_type"), F.col("high_reason"))
    )
    return (
        ruled.filter(F.col("verdict_source") != "model")
        .withColumn("_v", verdict)
        .select("*", "_v.*")
        .withColumn("analysis_status", F.lit("ok"))
        .drop("_v")
    )


def unresolved(ruled: DataFrame) -> DataFrame:
    """Clauses neither rule decides; these go to the request table."""
    return ruled.filter(F.col("verdict_source") == "model")


def rule_counts(ruled: DataFrame) -> DataFrame:
    return ruled.groupBy("verdict_source").agg(F.count("*").alias("n_clauses"))
