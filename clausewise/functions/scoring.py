"""Numeric expressions of the retrieval scores."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from clausewise import fixed_values as fv


def bm25_similarity(score: Column, scale: float = fv.BM25_SCALE, cap: float = fv.BM25_CAP) -> Column:
    """Map an unbounded BM25 score into [0, cap] for display."""
    value = F.when(score > 0, F.least(F.lit(cap), score / (score + F.lit(scale)))).otherwise(0.0)
    return F.round(value, 4)


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def vector_relevance(cosine: Column) -> Column:
    """Relevance of unit vectors from squared distance; may be negative."""
    return F.round(1.0 - (2.0 - 2.0 * cosine) / F.lit(math.sqrt(2.0)), 4)


def reciprocal_rank(rank: Column, k: int = fv.RRF_K) -> Column:
    return 1.0 / (rank + k)


def category_weight(category: Column, weights: dict[str, float] | None = None) -> Column:
    table = fv.CATEGORY_WEIGHT if weights is None else weights
    out = F.lit(1.0)
    for name, weight in table.items():
        out = F.when(category == name, F.lit(weight)).otherwise(out)
    return out


def length_norm(length: Column, avg: Column, k1: float = fv.BM25_K1, b: float = fv.BM25_B) -> Column:
    """Weight of one occurrence in a document of ``length`` distinct terms."""
    return (k1 + 1.0) / (1.0 + k1 * (1.0 - b + b * length / avg))


def percent(similarity: Column) -> Column:
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(similarity, F.lit(0.0)))) * 100, 0).cast("int")
