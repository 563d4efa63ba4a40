"""Accuracy evaluation of the classification on labelled clauses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausewise.operators import evaluation, exchange, rules
from clausewise.session import write_shared


def predict(items: DataFrame, responses: DataFrame | None = None, contract_type: str = "lease", size: int | None = None) -> DataFrame:
    """Predicted level of each labelled clause.

    The whole text is judged, or its first ``size`` characters.

    ``items(document_id, clause_pos, clause_text, ground_truth[, contract_type])``; without a type column all
    are of ``contract_type``.  Without responses a clause no rule decides counts as 'medium', the level
    of an unread answer.  With responses an item that none answers counts as missing (medium), one
    whose attempts all ended in an error of the model as 'error'.
    """
    judged = F.col("clause_text") if size is None else F.substring("clause_text", 1, size)
    clauses = items.withColumn("content", judged)
    if "contract_type" not in items.columns:
        clauses = clauses.withColumn("contract_type", F.lit(contract_type))
    ruled = rules.apply_rules(clauses)
    if responses is None:
        decided = ruled.withColumn(
            "risk_level",
            F.when(F.col("verdict_source") == "rule_safe", "safe")
            .when(F.col("verdict_source") == "rule_high", "high")
            .otherwise("medium"),
        )
        return decided.withColumn("prediction", F.col("risk_level"))
    ruled = write_shared(ruled, "ruled-clauses")  # read twice below
    by_rule = rules.rule_verdicts(ruled).select(*exchange.KEYS, "risk_level", "explanation")
    best = exchange.best_attempts(exchange.parse_responses(responses))
    by_model = exchange.fold_responses(rules.unresolved(ruled), best).select(
        *exchange.KEYS,
        F.when(F.col("analysis_status") == "llm_error", "error").otherwise(F.col("risk_level")).alias("risk_level"),
        "explanation",
    )
    return items.join(by_rule.unionByName(by_model), exchange.KEYS, "left").withColumn(
        "prediction", F.lower(F.trim("risk_level"))
    )


def evaluate(
    items: DataFrame, responses: DataFrame | None = None, contract_type: str = "lease", size: int | None = None
) -> DataFrame:
    """One row of metrics."""
    return evaluation.metrics(predict(items, responses, contract_type, size))


