"""Knowledge-base build: unite sources, deduplicate, store, index."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausewise import fixed_values as fv
from clausewise.operators.dedup import dedup_corpus
from clausewise.operators.vectors import as_batches
from clausewise.sources import index_store, kb_files, stores

# order of rows with equal priority: source list, then folder and kind of statute, file, place in the
# file, and last the contract types in the order in which the row's law lists them
ORDER = ["src_ord", "src_group", "kind_ord", "src_path", "src_pos", "type_ord", "contract_type", "id"]
PLACES = ["src_ord", "src_group", "kind_ord", "type_ord"]


def placed(rows: DataFrame) -> DataFrame:
    """Add the declared order of statute kinds and contract types; other rows go by their path."""
    kinds = F.array(*[F.lit(kind) for _, kind in fv.LAW_FILES])
    types = F.create_map(
        *[x for law, names in fv.LAW_CONTRACT_TYPES.items() for x in (F.lit(law), F.array(*[F.lit(n) for n in names]))]
    )
    is_law = F.col("source") == "law"
    listed = F.try_element_at(types, F.col("law_name"))
    return (
        rows.withColumn("src_group", F.when(is_law, F.regexp_replace("src_path", "/[^/]*$", "")).otherwise(F.col("src_path")))
        .withColumn("kind_ord", F.when(is_law, F.array_position(kinds, F.col("law_kind"))))
        .withColumn("type_ord", F.when(is_law, F.array_position(listed, F.col("contract_type"))))
    )


def unite(parts: list[DataFrame]) -> DataFrame:
    """Bag union of sources, remembering which one came first."""
    out = None
    for i, part in enumerate(parts):
        rows = part.withColumn("src_ord", F.lit(i))
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out


def collect_sources(
    spark: SparkSession,
    seeds: str | None = None,
    labelled: str | None = None,
    laws: str | None = None,
    precedents: str | None = None,
    precedent_cap: int = 0,
) -> DataFrame:
    parts = []
    if seeds:
        parts.append(kb_files.seed_rows(spark, seeds))
    if labelled:
        parts.append(kb_files.read_clauses(spark, labelled))
        parts.append(kb_files.read_judgments(spark, labelled))
    if laws:
        parts.append(kb_files.read_laws(spark, laws))
    if precedents:
        parts.append(kb_files.read_precedents(spark, precedents, precedent_cap))
    if not parts:
        raise ValueError("name at least one knowledge-base source")
    return unite(parts)


def build(
    spark: SparkSession,
    out: str,
    dedup_scope: str = "global",
    seeds: str | None = None,
    labelled: str | None = None,
    laws: str | None = None,
    precedents: str | None = None,
    precedent_cap: int = 0,
    vectoriser: Callable | None = None,
    vectors: DataFrame | None = None,
) -> DataFrame:
    """Clear and rebuild ``out/kb`` and ``out/index``, with vectors where they can be had; returns the stored KB.

    Vectors come from ``vectoriser(list of texts) -> 2-d array``, run in batches on the executors, or from a table
    ``vectors(id, embedding)`` of which the rows of this KB are kept.
    """
    rows = collect_sources(spark, seeds, labelled, laws, precedents, precedent_cap)
    kept = dedup_corpus(placed(rows), ORDER, scope=dedup_scope)
    stores.write_kb(kept.drop(*PLACES), f"{out}/kb")
    kb = spark.read.parquet(f"{out}/kb")
    index_store.create(kb, f"{out}/index", vectors=made_vectors(kb, vectoriser, vectors))
    return kb


def made_vectors(rows: DataFrame, vectoriser: Callable | None, vectors: DataFrame | None) -> DataFrame | None:
    """(id, embedding) of ``rows`` by the caller's vectoriser, or the caller's own."""
    if vectoriser is None:
        return vectors
    return rows.select("id", "text").mapInPandas(as_batches(vectoriser), "id string, embedding array<float>")


def upsert(
    spark: SparkSession,
    out: str,
    batch: DataFrame,
    version: str | None = None,
    vectoriser: Callable | None = None,
    vectors: DataFrame | None = None,
) -> DataFrame:
    """Merge a batch of KB rows into ``out``: the KB, its index and its vectors follow together; returns the stored KB.

    The index is written first, and again if a failed batch is repeated: neither step depends on the other's old state.
    """
    fresh = stores.newest(batch, version)
    index_store.upsert(spark, f"{out}/index", batch, version, vectors=made_vectors(fresh, vectoriser, vectors))
    stores.upsert_kb(spark, f"{out}/kb", batch, version)
    return spark.read.parquet(f"{out}/kb")
