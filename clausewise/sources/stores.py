"""Stored tables: knowledge base, BM25 index, analyses, overrides, reports."""

from __future__ import annotations

from urllib.parse import quote

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clausewise import dims
from clausewise.operators.analysis import latest_overrides, revised_header, revised_lines
from clausewise.operators.bm25 import COMMON, Bm25Index
from clausewise.operators.exchange import KEYS
from clausewise.session import write_shared

POSTINGS_SCHEMA = "term string, step int, id string, dl int, shelf string"
TERMS_SCHEMA = "term string, df long, idf double, contract_type string"
# folders of a run, by the hash of the document id
SHARDS = 64
STATS_SCHEMA = "contract_type string, n_docs long, avgdl double"


# --- knowledge base ---------------------------------------------------------------------


def write_kb(kb: DataFrame, path: str) -> None:
    """Clear and rebuild."""
    kb.write.mode("overwrite").partitionBy("contract_type").parquet(path)


def newest(batch: DataFrame, version: str | None = None) -> DataFrame:
    """One row per id: the highest ``version``; equal ones, or all without versions, by their content."""
    rest = [c for c in batch.columns if c != "id" and c != version]
    order = F.struct(*([F.col(version)] if version else []), *[F.col(c) for c in rest])
    kept = batch.groupBy("id").agg(F.max(order).alias("_last"))
    return kept.select(*[F.col("id") if c == "id" else F.col(f"_last.{c}").alias(c) for c in batch.columns])


def upsert_kb(spark: SparkSession, path: str, batch: DataFrame, version: str | None = None) -> None:
    """Merge a batch into the stored KB, one row per id, rewriting only the types it touches.

    An id may move to another type: the types that hold an id of the batch are touched as well as
    those the batch names.  A type that loses its last row becomes an empty partition.  The
    result is first written beside the table, because Spark cannot overwrite files it is still reading.
    """
    known = spark.read.parquet(path)
    fresh = write_shared(newest(batch, version), "kb-batch")
    ids = fresh.select("id")
    holding = known.join(ids, "id", "left_semi").select("contract_type")
    # one row per contract type, so its size is that of the type list
    touched = [r[0] for r in holding.unionByName(fresh.select("contract_type")).distinct().collect()]
    inside = F.col("contract_type").isin([t for t in touched if t is not None])
    if None in touched:
        inside = F.coalesce(inside, F.lit(False)) | F.col("contract_type").isNull()
    same = known.filter(inside)
    merged = write_shared(
        same.join(ids, "id", "left_anti").unionByName(fresh, allowMissingColumns=True), "kb-upsert"
    )
    left = {r[0] for r in merged.select("contract_type").distinct().collect()}
    emptied = [t for t in touched if t not in left]
    if emptied:
        # dynamic overwrite leaves partitions without new rows as they are, so the table is written anew
        others = known.filter(~F.coalesce(inside, F.lit(False)))
        whole = write_shared(others.unionByName(merged, allowMissingColumns=True), "kb-upsert")
        write_kb(whole, path)
        return
    (
        merged.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("contract_type")
        .parquet(path)
    )


# --- BM25 index ---------------------------------------------------------------------------


def write_index(index: Bm25Index, path: str) -> None:
    """Partitioned by shelf and type, and in term order inside, so a search reads only what it asks for.

    Ranges of terms go to their own files and lie sorted there: a filter on terms skips files and row groups.
    """
    keys = ["shelf", "term", "step", "id"]
    ordered = index.postings.repartitionByRange(*keys).sortWithinPartitions(*keys)
    ordered.write.mode("overwrite").partitionBy("shelf").parquet(f"{path}/postings")
    terms = index.terms.repartitionByRange("contract_type", "term").sortWithinPartitions("contract_type", "term")
    terms.write.mode("overwrite").partitionBy("contract_type").parquet(f"{path}/terms")
    index.stats.write.mode("overwrite").parquet(f"{path}/stats")


def read_index(spark: SparkSession, path: str, only: list[str] | None = None, types: list[str] | None = None) -> Bm25Index:
    """``only`` prunes partitions; a type that was never indexed is an empty scan.

    ``types`` are the types the index was built for.
    """
    known = dims.contract_types() if types is None else types
    tables = []
    for name, key, schema in (
        ("postings", "shelf", POSTINGS_SCHEMA), ("terms", "contract_type", TERMS_SCHEMA), ("stats", "contract_type", STATS_SCHEMA)
    ):
        table = spark.read.schema(schema).parquet(f"{path}/{name}")
        wanted = only if only is None or key == "contract_type" else [*only, COMMON]
        tables.append(table if wanted is None else table.filter(F.col(key).isin(wanted)))
    return Bm25Index(*tables, tuple(known), stored=True)


# --- analyses --------------------------------------------------------------------------------


def shard_of(document_id: Column, shards: int) -> Column:
    return F.pmod(F.xxhash64(document_id.cast("string")), F.lit(shards)).cast("int")


def write_analyses(results: DataFrame, path: str, run: str, fmt: str = "parquet", shards: int = SHARDS) -> None:
    """Store the analyses of one run beside those of all others; the same run again replaces itself.

    ``run`` is a key of the caller that sorts by age (a timestamp, say). Documents lie in ``shards`` folders by the
    hash of their id and in id order inside, so one of them is found in one folder of each run; keep the number of
    shards for the life of the store.
    """
    placed = results.withColumn("shard", shard_of(F.col("document_id"), shards))
    (
        placed.repartitionByRange("shard", "document_id")
        .sortWithinPartitions("shard", "document_id")
        .write.mode("overwrite")
        .option("parquet.bloom.filter.enabled#document_id", "true")
        .partitionBy("shard")
        .format(fmt)
        .save(f"{path}/run={quote(run, safe='')}")
    )


def read_analyses(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Every document's analysis of the latest run that has one."""
    stored = spark.read.format(fmt).load(path).withColumn("run", F.col("run").cast("string"))
    last = stored.groupBy("document_id").agg(F.max("run").alias("run"))
    return stored.drop("shard").join(last, ["document_id", "run"], "left_semi")


def lookup_analyses(
    spark: SparkSession, path: str, document_ids: list | DataFrame, fmt: str = "parquet", shards: int = SHARDS
) -> DataFrame:
    """The latest analyses of some documents: only their shards are listed and read, in any number of runs.

    A few ids may be a list, which reaches the scan; any number of them are a table with a column ``document_id``.
    """
    stored = spark.read.format(fmt).load(path).withColumn("run", F.col("run").cast("string"))
    if isinstance(document_ids, DataFrame):
        ids = document_ids.select("document_id")
        # one row per shard
        places = [r[0] for r in ids.select(shard_of(F.col("document_id"), shards)).distinct().collect()]
        found = stored.filter(F.col("shard").isin(places)).join(ids, "document_id", "left_semi")
    else:
        asked = [F.lit(d) for d in document_ids]
        found = stored.filter(F.col("shard").isin([shard_of(d, shards) for d in asked]) & F.col("document_id").isin(asked))
    newest_run = F.max("run").over(Window.partitionBy("document_id"))
    return found.withColumn("_last", newest_run).filter(F.col("run") == F.col("_last")).drop("_last", "shard")


def find_analysis(results: DataFrame, analysis_id, id_col: str = "document_id") -> DataFrame:
    """Filter that reaches the parquet scan; an analysis goes by the id of its document."""
    return results.filter(F.col(id_col) == F.lit(analysis_id))


def append_overrides(edits: DataFrame, path: str, batch_id: int) -> None:
    """Append one batch of edits; writing the same batch again replaces it."""
    (
        latest_batch(edits)
        .withColumn("batch_id", F.lit(batch_id))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("batch_id")
        .parquet(path)
    )


def latest_batch(edits: DataFrame) -> DataFrame:
    """The last edit per clause of one batch, blank ones included."""
    last = edits.groupBy(*KEYS).agg(F.max(F.struct("edited_at", "text")).alias("last"))
    return last.select(*KEYS, "last.text", "last.edited_at")


def _folded(path: str) -> str:
    return f"{path.rstrip('/')}-folded"


def _edits(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    """The folded edits, if any, with the batches since, and the last batch that is folded (-1: none)."""
    log = spark.read.parquet(path)
    try:
        folded = spark.read.parquet(_folded(path))
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return log, -1
    upto = folded.agg(F.max("upto")).first()[0]
    return folded.filter(F.col("upto") == upto).drop("upto").unionByName(log.filter(F.col("batch_id") > upto)), upto


def read_overrides(spark: SparkSession, path: str) -> DataFrame:
    """Current overrides: the folded state with the batches written since, so a read grows with clauses, not with edits."""
    return latest_overrides(_edits(spark, path)[0], tie="batch_id")


def fold_overrides(spark: SparkSession, path: str) -> int:
    """Write the last edit of each clause, blank ones included, as one table; returns the last batch it covers.

    The log stays as it is, and the fold of a batch that was folded before gives the same table again. A folded batch
    that is replayed is not read any more; a late edit of a new batch still loses to a later one.
    """
    edits, upto = _edits(spark, path)
    last_batch = spark.read.parquet(path).agg(F.max("batch_id")).first()[0]
    if last_batch is None or last_batch <= upto:
        return upto
    last = edits.groupBy(*KEYS).agg(F.max(F.struct("edited_at", "batch_id", "text")).alias("last"))
    kept = last.select(*KEYS, "last.text", "last.edited_at", "last.batch_id")
    kept.write.mode("overwrite").parquet(f"{_folded(path)}/upto={last_batch}")
    return last_batch


def write_report(metrics: DataFrame, details: DataFrame, path: str) -> None:
    metrics.write.mode("overwrite").json(f"{path}/metrics")
    details.write.mode("overwrite").json(f"{path}/details")


def write_quarantine(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def write_revised(
    analyses: DataFrame, path: str, per_document: bool = False, documents: DataFrame | None = None, built_at: Column | None = None
) -> None:
    """Revised contracts as lines in reading order, below their front lines where ``documents`` are given.

    ``documents(document_id, filename, total_clauses, risky_clauses)`` are the headers of the review.

    Contracts are spread over tasks by range and each task sorts only its own lines.  The
    default is one parquet table; ``per_document`` writes a text folder per contract, which
    suits the export of a few contracts, not of millions.
    """
    lines = revised_lines(analyses)
    if documents is not None:
        front = revised_header(documents, F.current_timestamp() if built_at is None else built_at)
        lines = lines.unionByName(
            front.select(
                "document_id", F.lit(-1).alias("clause_pos"), "line_no", F.lit("header").alias("kind"), "text"
            )
        )
    order = ["document_id", "clause_pos", "line_no"]
    if per_document:
        placed = lines.repartitionByRange("document_id").sortWithinPartitions(*order)
        placed.select(F.col("text").alias("value"), "document_id").write.mode("overwrite").partitionBy("document_id").text(path)
    else:
        lines.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").parquet(path)
