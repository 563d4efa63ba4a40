"""Hybrid search of queries and of whole clauses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausewise import fixed_values as fv
from clausewise.operators import bm25, fusion, vector_cells, vectors
from clausewise.operators.expansion import clause_queries


def pool_size(k: int) -> int:
    return max(fv.POOL_MIN, 4 * k)


def hybrid_search(
    queries: DataFrame,
    query_vectors: DataFrame | None,
    kb: DataFrame,
    kb_vectors: DataFrame | None,
    index: bm25.Bm25Index,
    k: int = fv.TOP_K,
    types: list[str] | None = None,
    min_score: float | None = None,
    exclude_self: bool = False,
    cells: vector_cells.CellIndex | None = None,
    **options,
) -> DataFrame:
    """Top-k KB rows per query: BM25 and vector pools, fused with category quotas.

    Vectors may be missing on either side; the other retriever then fills the pool alone.
    With ``cells`` in place of ``kb_vectors`` a query meets the nearest cells of the KB only.
    ``min_score`` drops hits with a lower similarity (off by default).
    """
    pool = pool_size(k)
    words = bm25.search(queries, index, pool, **options)
    if query_vectors is not None and cells is not None:
        typed_queries = query_vectors.join(queries.select("query_id", "contract_type"), "query_id")
        near = vector_cells.search(typed_queries, cells, pool, exclude_self=exclude_self)
    elif query_vectors is None or kb_vectors is None:
        near = words.select("query_id", "id", "similarity", "pos").limit(0)
    else:
        typed_queries = query_vectors.join(queries.select("query_id", "contract_type"), "query_id")
        typed_kb = kb_vectors.join(kb.select("id", "contract_type"), "id")
        # counting the vector tables reads file footers only; the joins are not run for it
        sizes = (query_vectors.count(), kb_vectors.count())
        near = vectors.search(typed_queries, typed_kb, pool, types, exclude_self, sizes=sizes)
    hits = fusion.fuse(near, words, kb, k)
    return hits if min_score is None else hits.filter(F.col("similarity") >= min_score)


def item_queries(clauses: DataFrame, keys: list[str]) -> DataFrame:
    """The items of each clause as queries; a query id is ``keys..., item_pos`` joined by '/'."""
    return clause_queries(clauses, keys).withColumn(
        "query_id", F.concat_ws("/", *[F.col(c).cast("string") for c in keys], F.col("item_pos").cast("string"))
    )


def clause_retrieval(
    clauses: DataFrame,
    keys: list[str],
    kb: DataFrame,
    index: bm25.Bm25Index,
    k: int = fv.TOP_K,
    item_vectors: DataFrame | None = None,
    kb_vectors: DataFrame | None = None,
    **options,
) -> DataFrame:
    """Hits of each clause: items searched one by one, merged first-seen.

    ``item_vectors(query_id, embedding)`` is keyed as in ``item_queries``.
    """
    asked = item_queries(clauses, keys)
    hits = hybrid_search(
        asked.select("query_id", "text", "contract_type"), item_vectors, kb, kb_vectors, index, k, **options
    )
    named = hits.join(asked.select("query_id", *keys, "item_pos"), "query_id").drop("query_id")
    return fusion.merge_items(named, keys)
