"""The two unbounded inputs: arriving contracts and user edits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausewise import fixed_values as fv
from clausewise.operators import exchange, rules
from clausewise.plans import review
from clausewise.plans.retrieval import clause_retrieval
from clausewise.session import write_shared
from clausewise.sources import contracts as door
from clausewise.sources import index_store, stores

EDIT_SCHEMA = "document_id string, clause_pos int, text string, edited_at timestamp"


def contract_stream(spark: SparkSession, path: str, fmt: str = "parquet", files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.format(fmt).schema(door.CONTRACT_SCHEMA)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def review_stream(contracts: DataFrame) -> DataFrame:
    """Clauses with rule verdicts; the same row-local functions as the batch job."""
    return review.split_and_rule(review.detect(door.accepted(contracts)))


def start_review(contracts: DataFrame, out: str, checkpoint: str, once: bool = False):
    """Append ruled clauses to ``out`` (exactly once through the file sink's log)."""
    writer = review_stream(contracts).writeStream.format("parquet").outputMode("append")
    writer = writer.option("path", out).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def _put(rows: DataFrame, path: str, batch_id: int) -> None:
    """Write the rows of one batch; the same batch again replaces them."""
    (
        rows.withColumn("batch_id", F.lit(batch_id))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("batch_id")
        .parquet(path)
    )


def start_retrieval(
    contracts: DataFrame,
    kb_path: str,
    index_path: str,
    out: str,
    checkpoint: str,
    k: int = fv.TOP_K,
    types: list[str] | None = None,
    once: bool = False,
    **options,
):
    """Review and search arriving contracts: ``out/clauses`` with rule verdicts, ``out/hits`` of the clauses left open.

    Each batch meets the stored KB and its index as they are when it runs, so upserts between batches count; the terms
    of a small batch are named in the scan of the postings. A batch that is replayed after a failure overwrites its
    own partitions.
    """

    def search(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        ruled = write_shared(review_stream(batch), "stream-clauses")
        _put(ruled, f"{out}/clauses", batch_id)
        index = index_store.read(spark, index_path, types=types)
        hits = clause_retrieval(
            rules.unresolved(ruled), exchange.KEYS, spark.read.parquet(kb_path), index, k, types=types, **options
        )
        _put(hits, f"{out}/hits", batch_id)

    writer = contracts.writeStream.foreachBatch(search).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def edit_stream(spark: SparkSession, path: str, fmt: str = "json", files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.format(fmt).schema(EDIT_SCHEMA)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def start_overrides(edits: DataFrame, log: str, checkpoint: str, once: bool = False, fold_every: int = 0):
    """Append edits to the override log, one partition per batch.

    A batch that is replayed after a failure overwrites its own partition, so the log ends
    up the same; readers fold it with last-write-wins.  ``fold_every`` batches the edits so
    far are folded to one row for each clause, from which readers start.
    """

    def keep(batch: DataFrame, batch_id: int) -> None:
        stores.append_overrides(batch, log, batch_id)
        if fold_every and (batch_id + 1) % fold_every == 0:
            stores.fold_overrides(batch.sparkSession, log)

    writer = edits.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
