"""Joins and top-n that survive one key holding a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_HOT_KEYS = 500
# above this n Spark no longer prunes a ranking before its shuffle
GROUP_LIMIT = 1000


def hot_keys(counts: DataFrame, keys: list[str], count_col: str, max_hot: int = MAX_HOT_KEYS) -> DataFrame:
    """Keys above 1/max_hot of all rows, with the number of salts each one needs.

    At most ``max_hot`` keys can pass that test, so the result is always safe to broadcast.
    """
    total = counts.agg(F.sum(count_col)).scalar()
    share = F.col(count_col) * F.lit(max_hot) / total
    return counts.filter(share > 1).select(*keys, F.ceil(share).cast("int").alias("_salts"))


def salted_join(
    big: DataFrame, small: DataFrame, on: list[str], hot: DataFrame, spread_by: list[str]
) -> DataFrame:
    """Inner equi-join where rows of hot keys in ``big`` are spread over salted copies.

    Only the matching rows of ``small`` are repeated, once per salt of their own key.
    """
    salts = F.coalesce(F.col("_salts"), F.lit(1))
    left = (
        big.join(F.broadcast(hot), on, "left")
        .withColumn("_salt", F.pmod(F.xxhash64(*spread_by), salts).cast("int"))
        .drop("_salts")
    )
    right = (
        small.join(F.broadcast(hot), on, "left")
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1)))
        .drop("_salts")
    )
    return left.join(right, [*on, "_salt"]).drop("_salt")


def top_n(
    df: DataFrame,
    by: list[str],
    order: list[Column],
    n: int,
    pos: str = "pos",
    spread_by: list[str] | None = None,
    salts: int = 64,
) -> DataFrame:
    """First ``n`` rows per group with their 1-based position.

    For small n the ranking is pruned on the map side, so no task ever holds a whole
    group.  For large n the same is done by hand: rank within salted parts first, then
    rank the few survivors.
    """
    if n > GROUP_LIMIT:
        spread = spread_by or [c for c in df.columns if c not in by]
        part = Window.partitionBy(*by, "_part").orderBy(*order)
        df = (
            df.withColumn("_part", F.pmod(F.xxhash64(*spread), F.lit(salts)))
            .withColumn("_rank", F.row_number().over(part))
            .filter(F.col("_rank") <= n)
            .drop("_rank", "_part")
        )
    window = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(pos, F.row_number().over(window)).filter(F.col(pos) <= n)
