"""Nearest neighbours by cells: k-means cells hold the KB vectors, a query meets its nearest cells only.

Every row is indexed; the centroids are fitted on a bounded sample. How many cells a query probes
is measured when the index is built: the least number that finds the wanted share of the true
neighbours of sample rows. A search can also be completed: a cell of which the farthest row lies
within an angle ``r`` of its centroid holds nothing better than the cosine of (angle to the
centroid - r), so cells that cannot reach the k-th hit so far are left out, and the result is exact.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clausewise import dims
from clausewise import fixed_values as fv
from clausewise.functions.scoring import vector_relevance
from clausewise.operators import vectors
from clausewise.operators.bm25 import COMMON, OTHER, shelf_of
from clausewise.operators.skew import top_n
from clausewise.session import write_shared

# what is sent to every executor: centroids of at most so many bytes, and no more cells than this
CENTROID_BYTES, MAX_CELLS = 64 << 20, 16_384
# rows for each cell in the sample that fits them, and rows of which the neighbours are looked up to choose the probes
FIT_ROWS, TUNE_ROWS = 256, 256
# asked cells that are named in a filter of the stored rows; more are joined without one
NAMED_CELLS = 1_000
_SLACK = 2e-6  # covers rounding of cosines and of float32 centroids


@dataclass(frozen=True)
class CellIndex:
    """``rows(id, shelf, cell, embedding)``, ``lists(shelf, cell, n, angle, most, least)`` and the centroids.

    ``angle`` is the widest between a row of the list and the centroid, ``most`` and ``least`` are
    the norms of the rows; ``probes`` of ``len(centroids)`` cells are asked by default.
    """

    rows: DataFrame
    lists: DataFrame
    centroids: np.ndarray
    probes: int
    types: tuple[str, ...]


def _unit(matrix: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    return matrix / np.where(norms > 0, norms, 1)


def cell_count(rows: int, dim: int) -> int:
    """About the square root of the rows, within what may be sent to every executor."""
    return max(1, min(math.isqrt(max(0, rows)), MAX_CELLS, CENTROID_BYTES // (4 * max(1, dim))))


def fit(kb: DataFrame, rows: int, cells: int, seed: int = 42) -> np.ndarray:
    """Unit centroids of ``cells`` cells at most, fitted on about ``FIT_ROWS`` rows for each, chosen by the hash of their ids."""
    share = min(1.0, FIT_ROWS * cells / max(1, rows))
    nonzero = F.exists("embedding", lambda x: x != 0)
    sample = kb.filter(nonzero & (F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < share * 1_000_000))
    found = write_shared(sample.select(array_to_vector(F.col("embedding").cast("array<double>")).alias("features")), "cell-sample")
    if found.isEmpty():
        return np.zeros((1, 0), np.float32)  # no direction known: one cell for all
    model = KMeans(k=max(2, cells), seed=seed, maxIter=8, distanceMeasure="cosine").fit(found)
    return _unit(np.asarray(model.clusterCenters())).astype(np.float32)


def _nearest(spark: SparkSession, centroids: np.ndarray, n: int) -> Callable[[Column], Column]:
    """Column function: the ``n`` nearest cells of a vector, nearest first."""
    shared = spark.sparkContext.broadcast(centroids)

    @F.pandas_udf("array<int>")
    def cells(embedding: pd.Series) -> pd.Series:
        if embedding.empty:
            return pd.Series([], dtype=object)
        if shared.value.shape[1] == 0:
            return pd.Series([np.zeros(1, np.int32)] * len(embedding))
        score = np.stack(embedding.to_numpy()).astype(np.float32) @ shared.value.T
        keep = min(n, score.shape[1])
        best = np.argpartition(-score, keep - 1, axis=1)[:, :keep]
        order = np.argsort(-np.take_along_axis(score, best, axis=1), axis=1, kind="stable")
        return pd.Series(list(np.take_along_axis(best, order, axis=1).astype(np.int32)))

    return cells


def _placed(kb: DataFrame, centroids: np.ndarray, known: list[str]) -> DataFrame:
    """KB rows with their shelf and nearest cell."""
    near = _nearest(kb.sparkSession, centroids, 1)
    return kb.select(
        "id", shelf_of(F.col("contract_type"), known).alias("shelf"), near(F.col("embedding"))[0].alias("cell"), "embedding"
    )


def _lists(rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(centroids)

    @F.pandas_udf("struct<norm: double, angle: double>")
    def measured(embedding: pd.Series, cell: pd.Series) -> pd.DataFrame:
        if embedding.empty:
            return pd.DataFrame({"norm": [], "angle": []}, dtype=float)
        v = np.stack(embedding.to_numpy()).astype(np.float64)
        norm = np.linalg.norm(v, axis=1)
        middle = shared.value[cell.to_numpy()].astype(np.float64)
        cosine = np.einsum("ij,ij->i", v[:, : middle.shape[1]], middle) / np.where(norm > 0, norm, 1)
        # a zero vector has no direction: it may be anywhere
        return pd.DataFrame({"norm": norm, "angle": np.where((norm > 0) & (middle.shape[1] > 0), np.arccos(np.clip(cosine, -1, 1)), np.pi)})

    return (
        rows.select("shelf", "cell", measured("embedding", "cell").alias("m"))
        .groupBy("shelf", "cell")
        .agg(F.count("*").alias("n"), F.max("m.angle").alias("angle"), F.max("m.norm").alias("most"), F.min("m.norm").alias("least"))
    )


def build(
    kb: DataFrame,
    k: int = fv.POOL_MIN,
    recall: float = 0.95,
    types: list[str] | None = None,
    cells: int | None = None,
) -> CellIndex:
    """Cell index of ``kb(id, contract_type, embedding)``, probing enough cells for ``recall`` at ``k``.

    The share is measured on ``TUNE_ROWS`` rows against exact search over all rows.
    """
    known = dims.contract_types() if types is None else types
    kb = write_shared(kb.select("id", "contract_type", "embedding"), "cell-kb")
    n, dim = kb.agg(F.count("*"), F.max(F.size("embedding"))).first()
    centroids = fit(kb, n, cells or cell_count(n, dim or 1))
    rows = write_shared(_placed(kb, centroids, known), "cell-rows")
    lists = write_shared(_lists(rows, centroids), "cell-lists")
    return CellIndex(rows, lists, centroids, _probes(kb, rows, centroids, k, recall, known, n), tuple(known))


def _probes(kb: DataFrame, rows: DataFrame, centroids: np.ndarray, k: int, recall: float, known: list[str], n: int) -> int:
    """Least number of probes that finds ``recall`` of the true neighbours of the sample."""
    untyped = F.lit(None).cast("string").alias("contract_type")
    sample = kb.orderBy(F.xxhash64("id"), "id").limit(TUNE_ROWS).select(F.col("id").alias("query_id"), untyped, "embedding")
    sample = write_shared(sample, "cell-tune")
    truth = vectors.search(sample, kb, k, known, exclude_self=True, sizes=(TUNE_ROWS, n))
    # at most TUNE_ROWS * k rows and TUNE_ROWS vectors come to the driver
    where = truth.select("query_id", "id").join(rows.select("id", "cell"), "id").select("query_id", "cell").collect()
    asked = {r["query_id"]: r["embedding"] for r in sample.collect()}
    if not where or centroids.size == 0:
        return 1
    order = {q: np.argsort(np.argsort(-(centroids @ np.asarray(v, np.float32)), kind="stable")) for q, v in asked.items()}
    ranks = np.sort([order[r["query_id"]][r["cell"]] for r in where])
    return int(ranks[max(0, math.ceil(recall * len(ranks)) - 1)]) + 1


def _beyond(index: CellIndex, lists: list) -> Callable[..., Column]:
    """Column function: (shelf, cell) of the lists that may still hold one of the best, less the probed ones."""
    shelves: dict[str, tuple] = {}
    for shelf in {r["shelf"] for r in lists}:
        mine = [r for r in lists if r["shelf"] == shelf]
        shelves[shelf] = tuple(np.array([r[c] for r in mine]) for c in ("cell", "angle", "most", "least"))
    shared = index.rows.sparkSession.sparkContext.broadcast((index.centroids.astype(np.float64), shelves))

    @F.pandas_udf("array<struct<shelf: string, cell: int>>")
    def cells(embedding: pd.Series, seen: pd.Series, probed: pd.Series, kth: pd.Series) -> pd.Series:
        centroids, shelves = shared.value
        out = []
        for v, names, done, least_hit in zip(embedding, seen, probed, kth):
            v = np.asarray(v, np.float64)
            norm = np.linalg.norm(v)
            away = np.arccos(np.clip(centroids @ v / (norm or 1), -1, 1)) if norm and centroids.size else np.zeros(len(centroids))
            asked = []
            for name in names:
                if name not in shelves:
                    continue
                cell, angle, most, least = shelves[name]
                cosine = np.cos(np.maximum(0, away[cell] - angle - 1e-5))
                bound = norm * np.where(cosine > 0, most, least) * cosine
                open_ = (bound >= least_hit - _SLACK) & ~np.isin(cell, done)
                asked += [{"shelf": name, "cell": int(c)} for c in cell[open_]]
            out.append(asked)
        return pd.Series(out, dtype=object)

    return cells


def _compare(asked: DataFrame, index: CellIndex, k: int, kb_block: int, query_block: int) -> DataFrame:
    """Best ``k`` + 1 of each asked list: ``asked(query_id, embedding, shelf, cell)``; long lists and crowds are cut into blocks."""
    load = (
        asked.groupBy("shelf", "cell")
        .agg(F.count("*").alias("asked"))
        .join(index.lists, ["shelf", "cell"])
        .select(
            "shelf", "cell",
            F.ceil(F.col("n") / kb_block).alias("kb_blocks"), F.ceil(F.col("asked") / query_block).alias("query_blocks"),
        )
    )
    load = write_shared(load, "cell-load")
    named = load.select("cell").distinct().limit(NAMED_CELLS + 1).collect()
    rows = index.rows if len(named) > NAMED_CELLS else index.rows.filter(F.col("cell").isin([r["cell"] for r in named]))

    def numbers(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))

    tile = ["shelf", "cell", "_q", "_b"]
    left = (
        asked.join(load, ["shelf", "cell"])
        .withColumn("_q", F.pmod(F.xxhash64("query_id"), F.col("query_blocks")))
        .withColumn("_b", numbers("kb_blocks"))
        .select("query_id", "embedding", *tile)
    )
    right = (
        rows.join(load, ["shelf", "cell"])
        .withColumn("_b", F.pmod(F.xxhash64("id"), F.col("kb_blocks")))
        .withColumn("_q", numbers("query_blocks"))
        .select("id", "embedding", *[F.col(c).alias(c) for c in tile])
    )
    kinds = (asked.schema["query_id"].dataType.simpleString(), index.rows.schema["id"].dataType.simpleString())
    schema = f"query_id {kinds[0]}, id {kinds[1]}, cosine double"
    return left.groupBy(*tile).cogroup(right.groupBy(*tile)).applyInPandas(vectors._best_of_tile(k), schema)


def search(
    queries: DataFrame,
    index: CellIndex,
    k: int = fv.TOP_K,
    exact: bool = False,
    exclude_self: bool = False,
    probes: int | None = None,
    kb_block: int = vectors.KB_BLOCK,
    query_block: int = vectors.QUERY_BLOCK,
) -> DataFrame:
    """Top-k KB rows per query as ``vectors.search`` gives them, from the nearest cells or, with ``exact``, certified complete."""
    shelves = F.array(*[F.lit(t) for t in (*index.types, COMMON, OTHER)])
    seen = F.when(F.col("contract_type").isNull(), shelves).otherwise(F.array_distinct(F.array("contract_type", F.lit(COMMON))))
    near = _nearest(queries.sparkSession, index.centroids, probes or index.probes)
    asked = queries.select("query_id", "embedding", seen.alias("seen"), near(F.col("embedding")).alias("cells"))
    asked = write_shared(asked, "cell-queries")
    first = asked.select("query_id", "embedding", F.explode("seen").alias("shelf"), "cells").select(
        "query_id", "embedding", "shelf", F.explode("cells").alias("cell")
    )

    def ranked(found: DataFrame) -> DataFrame:
        if exclude_self:
            found = found.filter(F.col("query_id").cast("string") != F.col("id").cast("string"))
        return top_n(found, ["query_id"], [F.desc("cosine"), F.asc("id")], k)

    hits = ranked(_compare(first, index, k, kb_block, query_block))
    if exact:
        hits = write_shared(hits, "cell-hits")
        kth = hits.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("cosine")).alias("kth"))
        # one row for each list, at most MAX_CELLS for each contract type
        beyond = _beyond(index, index.lists.collect())
        rest = (
            asked.join(kth, "query_id", "left")
            .withColumn("kth", F.coalesce("kth", F.lit(float("-inf"))))
            .select("query_id", "embedding", F.inline(beyond("embedding", "seen", "cells", "kth")))
        )
        more = _compare(write_shared(rest, "cell-rest"), index, k, kb_block, query_block)
        hits = ranked(hits.drop("pos").unionByName(more))
    return hits.withColumn("similarity", vector_relevance(F.col("cosine")))


def recall(found: DataFrame, truth: DataFrame) -> float:
    """Share of the true hits (query_id, id) that were found."""
    right = truth.join(found.select("query_id", "id"), ["query_id", "id"], "left_semi").count()
    return right / max(1, truth.count())


def extend(index: CellIndex, batch: DataFrame) -> CellIndex:
    """The index with the rows of ``batch(id, contract_type, embedding)`` in their cells, in place of rows with the same ids.

    Bounds of a list only widen, so completed searches stay exact; centroids and probes stay.
    """
    fresh = write_shared(_placed(batch, index.centroids, list(index.types)), "cell-batch")
    kept = index.rows.join(fresh.select("id"), "id", "left_anti").select(*index.rows.columns)
    gone = index.rows.join(fresh.select("id"), "id", "left_semi").groupBy("shelf", "cell").agg((-F.count("*")).alias("n"))
    unknown = [F.lit(None).cast("double").alias(c) for c in ("angle", "most", "least")]
    lists = (
        index.lists.unionByName(_lists(fresh, index.centroids))
        .unionByName(gone.select("shelf", "cell", "n", *unknown))
        .groupBy("shelf", "cell")
        .agg(F.sum("n").alias("n"), F.max("angle").alias("angle"), F.max("most").alias("most"), F.min("least").alias("least"))
        .filter("n > 0")
    )
    return CellIndex(kept.unionByName(fresh), lists, index.centroids, index.probes, index.types)


def write(index: CellIndex, path: str) -> None:
    """Rows in cell order, so a search reads the asked cells only; centroids as a table of one row a cell."""
    spark = index.rows.sparkSession
    ordered = index.rows.repartitionByRange("shelf", "cell", "id").sortWithinPartitions("shelf", "cell", "id")
    ordered.write.mode("overwrite").partitionBy("shelf").parquet(f"{path}/rows")
    index.lists.write.mode("overwrite").parquet(f"{path}/lists")
    cells = [(i, [float(x) for x in c], index.probes) for i, c in enumerate(index.centroids)]
    spark.createDataFrame(cells, "cell int, centroid array<float>, probes int").coalesce(1).write.mode("overwrite").parquet(f"{path}/cells")


def read(spark: SparkSession, path: str, types: list[str] | None = None) -> CellIndex:
    known = dims.contract_types() if types is None else types
    cells = spark.read.parquet(f"{path}/cells").orderBy("cell").collect()  # at most MAX_CELLS
    centroids = np.array([c["centroid"] for c in cells], np.float32)
    rows = spark.read.parquet(f"{path}/rows").withColumn("shelf", F.col("shelf").cast("string"))
    return CellIndex(rows, spark.read.parquet(f"{path}/lists"), centroids, cells[0]["probes"], tuple(known))
