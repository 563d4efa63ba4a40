"""Session defaults and the shared scratch area used to cut lineage."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.parquet.aggregatePushdown": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def get_spark(app: str = "clausewise", master: str | None = None, conf: dict[str, str] | None = None):
    """Build (or fetch) a session; the cluster's own settings win over our defaults."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **(conf or {})}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir``.

    Only a local session, whose executors are the driver itself, may do without the setting; it
    gets a folder of its own beneath its warehouse.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    warehouse = spark.conf.get("spark.sql.warehouse.dir")
    return f"{warehouse.rstrip('/')}/clausewise-scratch-{spark.sparkContext.applicationId}"


def write_shared(df: DataFrame, label: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` once as a parquet table in the shared folder and read it back.

    Cuts lineage without pinning blocks to executors: losing an executor later costs
    a re-read, not a recomputation of the upstream plan.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, rows_per_task: int | None = None) -> DataFrame:
    """Deal the rows of a table just read over all cores when it has fewer splits than that.

    A small file arrives as one split and would keep one core busy; tables with enough
    splits are returned as they are, without a shuffle.  Only for plain scans: asking a
    plan with shuffles for its partitions would run them.

    ``rows_per_task`` is for tables of short rows that each cost much: few bytes make few splits, so tasks would grow
    with the table. Their rows are counted (from the footers of a parquet table) and dealt over as many tasks as that asks for.
    """
    wanted = df.sparkSession.sparkContext.defaultParallelism
    if rows_per_task is not None:
        wanted = max(wanted, -(-df.count() // rows_per_task))
    return df.repartition(wanted) if df.rdd.getNumPartitions() < wanted else df
