"""Connected components of a link table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausewise.llm.common import staged


def _large_star(links: DataFrame) -> DataFrame:
    """Every neighbour above a node is linked to the least node around that node."""
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.join(least, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(links: DataFrame) -> DataFrame:
    """A node and its lower neighbours are linked to the least of them."""
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    lower = links.join(least, "u").filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return lower.unionByName(least.select("u", F.col("m").alias("v")))


def components(links: DataFrame) -> DataFrame:
    """(u, v) links of long ids to (id, component), component being the least id; only linked ids have a row.

    Both steps are a grouped minimum and an equi-join, so no node's links meet in one row; each
    round is written to the shared folder. It ends when the links no longer change, which is
    when all of them are stars.
    """
    links = staged(
        links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct(),
        "components",
    )
    mark = None
    while True:
        now = links.agg(F.count("u"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == mark or not now[0]:
            break
        mark = tuple(now)
        links = staged(_small_star(_large_star(links).distinct()).distinct(), "components")
    return links.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(
        links.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    )
