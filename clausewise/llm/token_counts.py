"""Token counts of a corpus from its exact length histogram.

Every question about lengths (totals, quantiles, what a context limit would keep) is answered
from the histogram and its suffix sums; texts are encoded once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clausewise.llm.common import staged
from clausewise.llm.tokenizer import VOCABULARY, token_count

# lengths of one block of the histogram are summed together; blocks are then summed among themselves
BLOCK = 1024


def histogram(spark: SparkSession, documents: DataFrame, text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(n_tokens, n_docs): documents by encoded length. Null and empty texts have length 0; repeated rows count again.

    The histogram, one row for each length, is written to the shared folder, as its readers use it more than once.
    """
    lengths = documents.select(token_count(spark, F.col(text), vocabulary).alias("n_tokens"))
    return staged(lengths.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n_docs")), "token-histogram")


def limits(counts: DataFrame) -> DataFrame:
    """For every length L that occurs, with L as the context limit:

    ``n_docs`` of just that length, ``tokens`` in them, ``docs_at_least`` and ``tokens_at_least`` (suffix
    sums), ``docs_below``, ``truncated_tokens`` (all that is left when every document is cut at L) and
    ``lost_tokens``. An empty histogram gives no rows.

    Sums run within blocks of ``BLOCK`` lengths and over the blocks' totals, so no task sees
    more than a block or one row per block.
    """
    rows = counts.select(
        "n_tokens",
        "n_docs",
        (F.col("n_tokens") * F.col("n_docs")).alias("tokens"),
        F.floor(F.col("n_tokens") / BLOCK).alias("block"),
    )
    totals = rows.groupBy("block").agg(F.sum("n_docs").alias("block_docs"), F.sum("tokens").alias("block_tokens"))
    over = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    under = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)

    def summed(name: str, window: Window) -> Column:
        return F.coalesce(F.sum(name).over(window), F.lit(0))

    blocks = totals.select(
        "block",
        summed("block_docs", over).alias("docs_over"),
        summed("block_tokens", over).alias("tokens_over"),
        summed("block_docs", under).alias("docs_under"),
        summed("block_tokens", under).alias("tokens_under"),
    )
    up = Window.partitionBy("block").orderBy("n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    down = Window.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, 0)
    joined = rows.join(blocks, "block").select(
        "n_tokens",
        "n_docs",
        "tokens",
        (summed("n_docs", down) + F.col("docs_over")).alias("docs_at_least"),
        (summed("tokens", down) + F.col("tokens_over")).alias("tokens_at_least"),
        (summed("n_docs", up) + F.col("docs_under")).alias("docs_below"),
        (summed("tokens", up) + F.col("tokens_under")).alias("tokens_below"),
    )
    return joined.select(
        "n_tokens",
        "n_docs",
        "tokens",
        "docs_at_least",
        "tokens_at_least",
        "docs_below",
        (F.col("tokens_below") + F.col("n_tokens") * F.col("docs_at_least")).alias("truncated_tokens"),
        (F.col("tokens_at_least") - F.col("n_tokens") * F.col("docs_at_least")).alias("lost_tokens"),
    )


def total_tokens(counts: DataFrame) -> DataFrame:
    """One row: documents and tokens of the corpus."""
    return counts.agg(
        F.coalesce(F.sum("n_docs"), F.lit(0)).alias("n_docs"),
        F.coalesce(F.sum(F.col("n_docs") * F.col("n_tokens")), F.lit(0)).alias("tokens"),
    )


def quantiles(counts: DataFrame, shares: list[float]) -> DataFrame:
    """(share, n_tokens): the smallest length that at least ``share`` of the documents do not exceed."""
    asked = counts.sparkSession.createDataFrame([(float(s),) for s in shares], "share double")
    sized = limits(counts).select("n_tokens", (F.col("docs_below") + F.col("n_docs")).alias("docs_up_to"))
    all_docs = counts.agg(F.sum("n_docs").alias("n"))
    need = asked.select("share", F.ceil(F.col("share") * all_docs.scalar()).alias("need"))
    # the asked shares are a handful of literals from the caller
    return (
        sized.join(F.broadcast(need), F.col("docs_up_to") >= F.col("need"))
        .groupBy("share")
        .agg(F.min("n_tokens").alias("n_tokens"))
    )


def truncated_total(counts: DataFrame, limit: int) -> DataFrame:
    """One row: tokens left when every document is cut at ``limit``, which need not occur as a length."""
    return counts.agg(
        F.coalesce(F.sum(F.least(F.col("n_tokens"), F.lit(limit)) * F.col("n_docs")), F.lit(0)).alias("tokens")
    )
