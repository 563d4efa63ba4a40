"""The corpus pipeline: stages over ``documents``, each written as Parquet and read again before the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausewise.llm import decontaminate, line_dedup, near_dedup, packing, quality_classifier
from clausewise.llm.common import free_name, staged, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn by importance resampling; no documents stay no documents."""
    _, key, cut = quality_classifier.resample(docs, table(spark, sf_dir, "labels"))
    return docs.filter(F.lit(False) if cut is None else key >= cut)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that resemble an earlier one; a document that loses its last line with a word goes."""
    found, _, has_lines = line_dedup.deduplicate(docs)
    return found.filter(has_lines).select(*docs.columns)


def _without(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``docs`` less the (doc_id, text_key) of ``found``; a null id is an id of its own."""
    out_id, out_text = free_name("out_id", docs.columns), free_name("out_text", docs.columns)
    out = found.select(F.col("doc_id").alias(out_id), F.col("text_key").alias(out_text)).distinct()
    same = F.col("doc_id").eqNullSafe(F.col(out_id)) & (F.xxhash64("text") == F.col(out_text))
    return docs.join(out, same, "left_anti").select(*docs.columns)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of every group of near duplicates."""
    return _without(docs, near_dedup.groups(docs).filter("not kept"))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    found = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"))
    return _without(docs, found.filter(F.size("hits") > 0))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences with their length bucket and batch."""
    return packing.pack(spark, docs)


STAGES = [
    ("quality classifier", quality),
    ("line dedup", lines),
    ("MinHash near-dedup", near),
    ("benchmark decontamination", decontaminated),
    ("packing", packed),
]

# tokenizers and the sampled models are not expressible in SQL; tests compare run() with a plain version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
