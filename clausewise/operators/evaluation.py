"""Accuracy of predicted risk levels against labelled clauses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausewise.operators.skew import top_n


def matches(level: Column, truth: Column) -> Column:
    """safe/low count as safe, high/medium as risky."""
    return F.when(truth == "safe", level.isin("safe", "low")).otherwise(level.isin("high", "medium"))


def missed_risk(level: Column, truth: Column) -> Column:
    return (truth == "risky") & level.isin("safe", "low")


def false_alarm(level: Column, truth: Column) -> Column:
    return (truth == "safe") & level.isin("high", "medium")


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(0.0)


def metrics(predictions: DataFrame) -> DataFrame:
    """One row of overall and per-class accuracy and error counts.

    ``predictions(ground_truth, prediction)``; one pre-aggregated pass.
    """
    level, truth = F.col("prediction"), F.col("ground_truth")
    hit = matches(level, truth)
    is_safe, is_risky = truth == "safe", truth != "safe"
    counts = predictions.agg(
        F.count("*").alias("total"),
        F.count_if(hit).alias("correct"),
        F.count_if(is_safe).alias("n_safe"),
        F.count_if(is_safe & hit).alias("safe_correct"),
        F.count_if(is_risky).alias("n_risky"),
        F.count_if(is_risky & hit).alias("risky_correct"),
        F.count_if(missed_risk(level, truth)).alias("false_safe_count"),
        F.count_if(false_alarm(level, truth)).alias("false_risky_count"),
    )
    return counts.select(
        _ratio(F.col("correct"), F.col("total")).alias("accuracy"),
        _ratio(F.col("safe_correct"), F.col("n_safe")).alias("safe_accuracy"),
        _ratio(F.col("risky_correct"), F.col("n_risky")).alias("risky_accuracy"),
        "total", "correct", "false_safe_count", "false_risky_count",
    )


def confusion(predictions: DataFrame) -> DataFrame:
    return predictions.groupBy("ground_truth", "prediction").agg(F.count("*").alias("n"))


def worst_cases(predictions: DataFrame, order: list[str], n: int = 5) -> DataFrame:
    """First ``n`` missed risks and false alarms, in the given order."""
    level, truth = F.col("prediction"), F.col("ground_truth")
    kind = F.when(missed_risk(level, truth), "missed_risk").when(false_alarm(level, truth), "false_alarm")
    wrong = predictions.withColumn("kind", kind).filter(F.col("kind").isNotNull())
    return top_n(wrong, ["kind"], [F.asc(c) for c in order], n)


def balanced_sample(items: DataFrame, limit: int, order: list[str]) -> DataFrame:
    """First half of the limit from safe rows, the rest from risky rows."""
    half = limit // 2
    quota = F.when(F.col("ground_truth") == "safe", half).otherwise(limit - half)
    best = top_n(items, ["ground_truth"], [F.asc(c) for c in order], max(half, limit - half))
    return best.filter(F.col("pos") <= quota).drop("pos")
