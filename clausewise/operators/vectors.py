"""Exact nearest neighbours of unit vectors, computed tile by tile.

Query and KB vectors are dealt into blocks of bounded size.  One task multiplies one
query block with one KB block and emits only the best k per query, so neither a pair per
comparison nor a whole side ever sits in one place.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausewise import dims
from clausewise import fixed_values as fv
from clausewise.functions.scoring import vector_relevance
from clausewise.operators.bm25 import COMMON, OTHER, shelf_of
from clausewise.operators.skew import top_n

KB_BLOCK = 16_384
QUERY_BLOCK = 4_096
_SLICE = 256  # queries multiplied at once inside a task


def _best_of_tile(k: int):
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        query_ids: list = []
        kb_ids: list = []
        cosines: list = []
        if not left.empty and not right.empty:
            kb = np.stack(right["embedding"].to_numpy()).astype(np.float64)
            ids = right["id"].to_numpy(dtype=object)
            by_id = np.argsort(ids.astype(str), kind="stable")
            kb, ids = kb[by_id], ids[by_id]
            asked = np.stack(left["embedding"].to_numpy()).astype(np.float64)
            names = left["query_id"].to_numpy(dtype=object)
            # one more than k, because a query may meet itself and drop that pair later
            keep = min(k + 1, len(ids))
            for start in range(0, len(asked), _SLICE):
                scores = np.round(asked[start : start + _SLICE] @ kb.T, 6) + 0.0
                # columns are in id order, so a column's place breaks ties within one sort key
                key = scores - np.arange(len(ids)) * (4e-7 / len(ids))
                best = np.argpartition(-key, keep - 1, axis=1)[:, :keep]
                best = np.take_along_axis(best, np.argsort(-np.take_along_axis(key, best, axis=1), axis=1), axis=1)
                query_ids.extend(np.repeat(names[start : start + _SLICE], keep))
                kb_ids.extend(ids[best].ravel())
                cosines.extend(np.take_along_axis(scores, best, axis=1).ravel())
        # plain object columns: concatenated string columns reach Arrow in several chunks
        return pd.DataFrame(
            {
                "query_id": pd.Series(query_ids, dtype=object),
                "id": pd.Series(kb_ids, dtype=object),
                "cosine": pd.Series(cosines, dtype=np.float64),
            }
        )

    return run


def _numbers(n: int) -> Column:
    return F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))


def search(
    queries: DataFrame,
    kb: DataFrame,
    k: int = fv.TOP_K,
    types: list[str] | None = None,
    exclude_self: bool = False,
    kb_block: int = KB_BLOCK,
    query_block: int = QUERY_BLOCK,
    sizes: tuple[int, int] | None = None,
) -> DataFrame:
    """Top-k KB rows per query: (query_id, id, cosine, similarity, pos).

    ``queries(query_id, contract_type, embedding)``; a query with a type sees that type
    and common rows, one without sees everything.  ``exclude_self`` drops the pair where
    query and KB row are the same vector.  ``sizes`` are upper limits of both row counts
    (queries, KB), for callers that know them without running the inputs.
    """
    known = dims.contract_types() if types is None else types
    n_queries, n_kb = sizes or (queries.count(), kb.count())
    kb_blocks = max(1, math.ceil(n_kb / kb_block))
    query_blocks = max(1, math.ceil(n_queries / query_block))
    shelves = [*known, COMMON, OTHER]
    seen = F.when(F.col("contract_type").isNull(), F.array(*[F.lit(t) for t in shelves])).otherwise(
        F.array_distinct(F.array("contract_type", F.lit(COMMON)))
    )
    asked = (
        queries.select("query_id", F.col("embedding").alias("embedding"), F.explode(seen).alias("shelf"))
        .withColumn("_q", F.pmod(F.xxhash64("query_id"), F.lit(query_blocks)))
        .withColumn("_b", F.explode(_numbers(kb_blocks)))
    )
    stored = (
        kb.select(
            F.col("id").alias("id"),
            F.col("embedding").alias("embedding"),
            shelf_of(F.col("contract_type"), known).alias("shelf"),
        )
        .withColumn("_b", F.pmod(F.xxhash64("id"), F.lit(kb_blocks)))
        .withColumn("_q", F.explode(_numbers(query_blocks)))
    )
    tile = ["shelf", "_q", "_b"]
    schema = (
        f"query_id {queries.schema['query_id'].dataType.simpleString()}, "
        f"id {kb.schema['id'].dataType.simpleString()}, cosine double"
    )
    found = asked.groupBy(*tile).cogroup(stored.groupBy(*tile)).applyInPandas(_best_of_tile(k), schema)
    if exclude_self:
        found = found.filter(F.col("query_id").cast("string") != F.col("id").cast("string"))
    ranked = top_n(found, ["query_id"], [F.desc("cosine"), F.asc("id")], k)
    return ranked.withColumn("similarity", vector_relevance(F.col("cosine")))


def as_batches(fn) -> callable:
    """Adapter for a caller's own vectoriser: ``fn(list of texts) -> 2-d array``.

    Use as ``df.mapInPandas(as_batches(fn), "id string, embedding array<float>")``.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            vectors = np.asarray(fn(batch["text"].tolist()), dtype=np.float32)
            yield pd.DataFrame({"id": batch["id"], "embedding": list(vectors)})

    return run
