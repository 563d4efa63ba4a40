"""A stored search index that follows its knowledge base by batches.

Every batch writes one generation beside the earlier ones: the terms and postings of its rows, the
ids it replaces or removes, and what it adds to (or takes from) the counts by shelf, term and block
and the sizes by shelf. A row is live while no later generation names its id. Statistics are sums,
so an index after any number of batches is the index of a rebuild. They are written anew for each
generation, the size of the vocabulary; postings are written for the batch alone. A generation
counts once its statistics are there, the last table written, and a batch that fails half-way may
be written again.

Folder: ``documents``, ``postings``, ``dropped``, ``counts``, ``sizes``, ``vectors`` by generation, and
``terms``, ``blocks``, ``stats`` as of each generation.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausewise import dims
from clausewise.operators import bm25
from clausewise.session import write_shared
from clausewise.sources.stores import STATS_SCHEMA, TERMS_SCHEMA, newest

_GENERATION = ", generation int"
SCHEMAS = {
    "documents": "id string, tokens array<string>, dl int, shelf string" + _GENERATION,
    "postings": "term string, step int, id string, dl int, shelf string" + _GENERATION,
    "dropped": "id string" + _GENERATION,
    "counts": "shelf string, term string, step int, n long, min_dl int, max_dl int" + _GENERATION,
    "sizes": "shelf string, n long, length long" + _GENERATION,
    "vectors": "id string, embedding array<float>" + _GENERATION,
    "terms": TERMS_SCHEMA + _GENERATION,
    "blocks": "term string, step int, n long, min_dl int, max_dl int, contract_type string" + _GENERATION,
    "stats": STATS_SCHEMA + ", base int" + _GENERATION,
}
_FOLDERS = {"postings": ["shelf"], "terms": ["contract_type"], "blocks": ["contract_type"]}
_ORDER = {
    "documents": ["id"],
    "postings": ["shelf", "term", "step", "id"],
    "terms": ["contract_type", "term"],
    "blocks": ["contract_type", "term", "step"],
}


def _write(df: DataFrame, path: str, table: str, generation: int, tasks: int | None = None) -> None:
    order = _ORDER.get(table)
    pieces = [] if tasks is None or tasks <= int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else [tasks]
    placed = df.repartitionByRange(*pieces, *order).sortWithinPartitions(*order) if order else df
    writer = placed.write.mode("overwrite")
    writer.partitionBy(*_FOLDERS.get(table, [])).parquet(f"{path}/{table}/generation={generation}")


def _table(spark: SparkSession, path: str, table: str, base: int, last: int) -> DataFrame:
    stored = spark.read.schema(SCHEMAS[table]).parquet(f"{path}/{table}")
    return stored.filter(F.col("generation").between(base, last))


def generations(spark: SparkSession, path: str) -> tuple[int, int]:
    """First generation that is read and the last one that is complete."""
    stats = spark.read.schema(SCHEMAS["stats"]).parquet(f"{path}/stats")
    base, last = stats.agg(F.max(F.struct("generation", "base")).alias("m")).select("m.base", "m.generation").first()
    return base, last


def _next(spark: SparkSession, path: str) -> int:
    try:
        return generations(spark, path)[1] + 1
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return 0


def live(spark: SparkSession, path: str, table: str) -> DataFrame:
    """Rows of ``documents``, ``postings`` or ``vectors`` whose ids no later generation has dropped."""
    base, last = generations(spark, path)
    rows = _table(spark, path, table, base, last)
    if base == last:
        return rows.drop("generation")
    gone = (
        _table(spark, path, "dropped", base + 1, last)
        .groupBy(F.col("id").alias("gone_id"))
        .agg(F.max("generation").alias("gone_at"))
    )
    void = (F.col("id") == F.col("gone_id")) & (F.col("generation") < F.col("gone_at"))
    return rows.join(gone, void, "left_anti").drop("generation")


def _publish(spark: SparkSession, path: str, base: int, last: int, known: list[str]) -> None:
    """Statistics as of ``last`` from the sums of all generations, which completes it."""
    sizes = _table(spark, path, "sizes", base, last).groupBy("shelf").agg(F.sum("n").alias("n"), F.sum("length").alias("length"))
    stats = write_shared(bm25.statistics(sizes.filter("n > 0"), known), "index-stats")
    counts = (
        _table(spark, path, "counts", base, last)
        .groupBy("shelf", "term", "step")
        .agg(F.sum("n").alias("n"), F.min("min_dl").alias("min_dl"), F.max("max_dl").alias("max_dl"))
        .filter("n > 0")
    )
    _write(bm25.index_blocks(counts, known), path, "blocks", last)
    blocks = _table(spark, path, "blocks", last, last)
    frequencies = blocks.groupBy("contract_type", "term").agg(F.sum("n").alias("df"))
    _write(bm25.weigh(frequencies, stats), path, "terms", last)
    # a row of its own says that the generation is complete, even where no document is left
    mark = spark.range(1).select(F.lit(None).cast("string").alias("contract_type"), F.lit(0).cast("long").alias("n_docs"), F.lit(0.0).alias("avgdl"))
    told = stats.unionByName(mark).withColumn("base", F.lit(base))
    _write(told.coalesce(1), path, "stats", last)


def _add(spark: SparkSession, path: str, fresh: DataFrame, old: DataFrame | None, vectors: DataFrame | None, base: int, last: int, known: list[str]) -> None:
    _write(fresh, path, "documents", last)
    pieces = bm25.dealt(fresh)
    _write(bm25.postings_of(pieces), path, "postings", last, bm25.tasks_for(fresh))
    counts, sizes = bm25.block_counts(pieces), bm25.shelf_sizes(fresh)
    dropped = fresh.select("id").limit(0)
    if old is not None:
        # least and greatest lengths stay: bounds only widen until the index is compacted
        counts = counts.unionByName(bm25.block_counts(bm25.dealt(old)).withColumn("n", -F.col("n")))
        sizes = sizes.unionByName(bm25.shelf_sizes(old).select("shelf", (-F.col("n")).alias("n"), (-F.col("length")).alias("length")))
        dropped = old.select("id")
    _write(counts, path, "counts", last)
    _write(sizes, path, "sizes", last)
    _write(dropped, path, "dropped", last)
    made = fresh.select("id", F.lit(None).cast("array<float>").alias("embedding")).limit(0) if vectors is None else vectors
    _write(made.select("id", F.col("embedding").cast("array<float>").alias("embedding")), path, "vectors", last)
    _publish(spark, path, base, last, known)


def create(
    kb: DataFrame, path: str, types: list[str] | None = None, particles: list[str] | None = None, vectors: DataFrame | None = None
) -> None:
    """Index ``kb(id, text, contract_type)``, ids unique, as the first generation; ``vectors(id, embedding)`` lie beside it.

    Where a folder holds an index, the new one takes its place once it is complete.
    """
    known = dims.contract_types() if types is None else types
    spark = kb.sparkSession
    docs = write_shared(bm25.document_terms(kb, particles, known), "index-documents")
    held = None if vectors is None else vectors.join(docs.select("id"), "id", "left_semi")
    first = _next(spark, path)
    _add(spark, path, docs, None, held, first, first, known)


def upsert(
    spark: SparkSession,
    path: str,
    batch: DataFrame,
    version: str | None = None,
    removed: DataFrame | None = None,
    types: list[str] | None = None,
    particles: list[str] | None = None,
    vectors: DataFrame | None = None,
) -> int:
    """Add a generation with the rows of ``batch`` in place of those with the same ids, and without the ids of ``removed``.

    Of several rows with one id the newest counts, as in ``stores.upsert_kb``. A replaced row loses its
    vector; ``vectors`` of rows that stay as they are are ignored. Returns the generation.
    """
    known = dims.contract_types() if types is None else types
    base, last = generations(spark, path)
    kept = newest(batch.select("id", "text", "contract_type", *([version] if version else [])), version)
    fresh = write_shared(bm25.document_terms(kept, particles, known), "index-batch")
    ids = fresh.select("id")
    if removed is not None:
        ids = ids.unionByName(removed.select("id")).distinct()
    old = write_shared(live(spark, path, "documents").join(ids, "id", "left_semi"), "index-replaced")
    held = None if vectors is None else vectors.join(fresh.select("id"), "id", "left_semi")
    _add(spark, path, fresh, old, held, base, last + 1, known)
    return last + 1


def compact(spark: SparkSession, path: str, types: list[str] | None = None) -> int:
    """Write all live rows as one generation, from which readers start anew; earlier files stay for readers under way."""
    known = dims.contract_types() if types is None else types
    _, last = generations(spark, path)
    docs, vectors = live(spark, path, "documents"), live(spark, path, "vectors")
    _add(spark, path, docs, None, vectors, last + 1, last + 1, known)
    return last + 1


def read(spark: SparkSession, path: str, only: list[str] | None = None, types: list[str] | None = None) -> bm25.Bm25Index:
    """The index as of the last complete generation; ``only`` prunes to the shelves of these types and the common one."""
    known = dims.contract_types() if types is None else types
    _, last = generations(spark, path)
    postings, docs = live(spark, path, "postings"), live(spark, path, "documents")
    facts = [_table(spark, path, name, last, last).drop("generation", "base") for name in ("terms", "stats", "blocks")]
    facts[1] = facts[1].filter(F.col("contract_type").isNotNull())
    if only is not None:
        postings, docs = (t.filter(F.col("shelf").isin([*only, bm25.COMMON])) for t in (postings, docs))
        facts = [t.filter(F.col("contract_type").isin(only)) for t in facts]
    terms, stats, blocks = facts
    return bm25.Bm25Index(postings, terms, stats, tuple(known), blocks, stored=True, docs=docs)


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """(id, embedding) of the live rows that have a vector."""
    return live(spark, path, "vectors")
