"""Keyword scoring and routing.  Row-local: no join, no shuffle, no row blow-up."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausewise import fixed_values as fv
from clausewise.functions.text import contains_any, count_literal, let


def keyword_score(text: Column, words: list[str]) -> Column:
    """Sum of non-overlapping counts; overlapping keywords all count."""
    return reduce(lambda a, b: a + b, [count_literal(text, w) for w in words])


def label_scores(text: Column, keywords: dict[str, list[str]]) -> Column:
    """``array<struct<score, rank, label>>`` in declared order (rank 0, -1, -2 ...)."""
    return F.array(
        *[
            F.struct(
                keyword_score(text, words).alias("score"),
                F.lit(-i).alias("rank"),
                F.lit(label).alias("label"),
            )
            for i, (label, words) in enumerate(keywords.items())
        ]
    )


def best_label(text: Column, keywords: dict[str, list[str]], min_score: int = 0) -> Column:
    """Highest-scoring label; the first declared wins ties; null below ``min_score``."""
    best = F.array_max(label_scores(text, keywords))
    if min_score <= 0:
        return best["label"]
    return let(best, lambda b: F.when(b["score"] >= min_score, b["label"]))


def contract_type(text: Column, keywords: dict[str, list[str]] | None = None) -> Column:
    return best_label(text, keywords or fv.CONTRACT_TYPE_KEYWORDS)


def precedent_type(text: Column, keywords: dict[str, list[str]] | None = None) -> Column:
    return best_label(text, keywords or fv.PRECEDENT_KEYWORDS, min_score=2)


def dominant_label(
    text: Column, first: tuple[str, list[str]], second: tuple[str, list[str]], ratio: int = 2
) -> Column:
    """Label whose score is at least ``ratio`` times the other's; null if close or both 0."""
    scores = F.struct(keyword_score(text, first[1]).alias("a"), keyword_score(text, second[1]).alias("b"))
    return let(
        scores,
        lambda s: F.when((s["a"] == 0) & (s["b"] == 0), F.lit(None).cast("string"))
        .when(s["a"] >= s["b"] * ratio, first[0])
        .when(s["b"] >= s["a"] * ratio, second[0]),
    )


def lease_subtype(text: Column) -> Column:
    return dominant_label(
        text, ("residential", fv.RESIDENTIAL_KEYWORDS), ("commercial", fv.COMMERCIAL_KEYWORDS)
    )


def first_match(text: Column, routes: list[tuple[list[str], str]]) -> Column:
    """Label of the first route with any keyword in the text, else null."""
    out = F.lit(None).cast("string")
    for words, label in reversed(routes):
        out = F.when(contains_any(text, words), F.lit(label)).otherwise(out)
    return out


def judgment_type(text: Column) -> Column:
    return first_match(text, [(fv.LEASE_KEYWORDS, "lease"), (fv.SALES_KEYWORDS, "sales")])


def file_topic(filename: Column) -> Column:
    """``struct<contract_type, topic>`` of a standard-clause file, null if unmatched."""
    out = F.lit(None).cast("struct<contract_type:string,topic:string>")
    for part, ct, topic in reversed(fv.CLAUSE_FILE_TOPICS):
        hit = F.struct(F.lit(ct).alias("contract_type"), F.lit(topic).alias("topic"))
        out = F.when(F.contains(filename, F.lit(part)), hit).otherwise(out)
    return out


def scores_table(df: DataFrame, id_col: str, text_col: str, keywords: dict[str, list[str]]) -> DataFrame:
    """Long form (id, label, score), one row per label."""
    return df.select(id_col, F.inline(label_scores(F.col(text_col), keywords))).select(
        id_col, "label", "score"
    )
