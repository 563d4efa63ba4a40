"""Contract texts (already extracted) and the checks at the door."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausewise import dims
from clausewise.functions.text import is_blank, supported_file

CONTRACT_SCHEMA = "document_id string, filename string, text string"


def read_contracts(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return spark.read.format(fmt).schema(CONTRACT_SCHEMA).load(path)


def read_text_files(spark: SparkSession, path: str, extension: str = "*.txt") -> DataFrame:
    """One contract per text file."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", extension)
    return files.text(path, wholetext=True).select(
        F.sha1(F.col("_metadata.file_path").cast("binary")).alias("document_id"),
        F.col("_metadata.file_name").alias("filename"),
        F.col("value").alias("text"),
    )


def accepted(contracts: DataFrame, extensions: list[str] | None = None) -> DataFrame:
    """Supported file type and some text."""
    return contracts.filter(supported_file(F.col("filename"), extensions) & ~is_blank(F.coalesce("text", F.lit(""))))


def rejected(contracts: DataFrame, extensions: list[str] | None = None) -> DataFrame:
    """Contracts turned away, with the reason."""
    reason = F.when(
        ~F.coalesce(supported_file(F.col("filename"), extensions), F.lit(False)), "unsupported_extension"
    ).when(is_blank(F.coalesce("text", F.lit(""))), "empty_text")
    return contracts.withColumn("reason", reason).filter(F.col("reason").isNotNull())


def unsupported_types(contracts: DataFrame, types: list[str] | None = None) -> DataFrame:
    """Contracts whose type has no configuration."""
    known = dims.contract_types() if types is None else types
    return contracts.filter(F.col("contract_type").isNull() | ~F.col("contract_type").isin(known))


def require_supported_type(contracts: DataFrame, types: list[str] | None = None) -> DataFrame:
    """Strict form: the job fails on the first unsupported type."""
    known = dims.contract_types() if types is None else types
    ct = F.col("contract_type")
    checked = F.when(ct.isin(known), ct).otherwise(
        F.raise_error(F.concat(F.lit("unsupported contract type: "), F.coalesce(ct, F.lit("null"))))
    )
    return contracts.withColumn("contract_type", checked)
