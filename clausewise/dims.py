"""Dimension tables: small, fixed-size data that operators take as parameters.

``*_rows`` are plain lists for operators that compile a dimension into expressions;
``*_dim`` are DataFrames for joins.  All of them have a size fixed in advance, which is
what makes broadcasting them safe.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from clausewise import fixed_values as fv


@dataclass(frozen=True)
class Rule:
    kind: str
    contract_type: str
    pattern: str
    reason: str
    risk_type: str | None = None


def safe_rules() -> list[Rule]:
    return [Rule("safe", ct, p, reason) for ct, p, reason in fv.SAFE_RULES]


def high_rules() -> list[Rule]:
    return [Rule("high", ct, p, reason, risk) for ct, p, risk, reason in fv.HIGH_RULES]


def vetoes() -> list[tuple[str, str]]:
    """(scope, phrase): scope '*' holds for every contract type."""
    return [("*", w) for w in fv.COMMON_VETOES] + [("lease", w) for w in fv.LEASE_VETOES]


def rules_from_table(table: DataFrame) -> list[Rule]:
    """Rules kept in a table (kind, contract_type, ord, pattern, risk_type, reason).

    A rule set is configuration: every rule becomes a branch of one expression.
    """
    rows = table.orderBy("kind", "contract_type", "ord").collect()
    return [Rule(r["kind"], r["contract_type"], r["pattern"], r["reason"], r["risk_type"]) for r in rows]


def contract_types() -> list[str]:
    return [key for key, _, _ in fv.CONTRACT_TYPES]


def risk_type_dim(spark: SparkSession) -> DataFrame:
    rows = [(ct, i, r) for ct, types in fv.RISK_TYPES.items() for i, r in enumerate(types)]
    return spark.createDataFrame(rows, "contract_type string, ord int, risk_type string")
