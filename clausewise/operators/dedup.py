"""Corpus deduplication by id and by normalised text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clausewise import fixed_values as fv
from clausewise.functions.text import computed, corpus_norm
from clausewise.session import write_shared


def source_priority(source: Column) -> Column:
    """0 built-in, 1 statutes, 2 precedents, 3 labelled data sets."""
    out = F.lit(fv.DEFAULT_PRIORITY)
    for name, rank in fv.SOURCE_PRIORITY.items():
        out = F.when(source == name, F.lit(rank)).otherwise(out)
    return F.when(source.startswith(fv.AIHUB_PREFIX), F.lit(fv.AIHUB_PRIORITY)).otherwise(out)


def dedup_corpus(
    items: DataFrame,
    order: list[str],
    scope: str = "global",
    min_chars: int = 50,
) -> DataFrame:
    """Keep an item unless an earlier *kept* item has its id or its normalised text.

    ``order`` are columns of ``items`` that, after the source priority, order it totally.
    Texts shorter than ``min_chars`` after normalisation are compared by id only.
    ``scope="per_type"`` compares within one contract type, so a statute shared by several
    types stays in each.

    Works on (id, text hash, rank) only.  Copies collapse in pre-aggregated group-bys, so a
    text that makes up a third of the corpus never meets in one task.
    """
    scoped = [F.col("contract_type")] if scope == "per_type" else []
    ranked = items.withColumn("_rank", F.struct(source_priority(F.col("source")).alias("p"), *order))
    norm = F.col("_norm")
    normed = ranked.select("_rank", "id", *scoped, computed(_norm=corpus_norm(F.col("text"))))
    keyed = normed.select(
        "_rank",
        F.sha2(F.concat_ws("\u0001", *scoped, "id"), 256).alias("i"),
        F.when(F.length(norm) >= min_chars, F.sha2(F.concat_ws("\u0001", *scoped, norm), 256)).alias("t"),
    )
    # of equal (id, text) pairs only the first can ever be kept
    pairs = write_shared(keyed.groupBy("i", "t").agg(F.min("_rank").alias("_rank")), "dedup-pairs")
    # ids with several texts, and whatever shares a text with them, wait for each other; all else is settled at once:
    # the first of each text, and every short text
    several = pairs.groupBy("i").agg(F.count("*").alias("n")).filter("n > 1").select("i")
    crossing = write_shared(pairs.join(several, "i", "left_semi"), "dedup-crossing")
    texts = crossing.filter("t is not null").select("t").distinct()
    single = pairs.join(several, "i", "left_anti")
    calm = single.join(texts, "t", "left_anti").select("i", "t", "_rank")
    kept = _first_texts(calm).unionByName(calm.filter("t is null"))
    if not crossing.isEmpty():
        sharing = single.join(texts, "t", "left_semi").select("i", "t", "_rank")
        kept = kept.unionByName(_greedy(crossing.select("i", "t", "_rank").unionByName(sharing))[0])
    return ranked.join(kept.select("_rank"), "_rank", "left_semi").drop("_rank")


def _first_texts(pairs: DataFrame) -> DataFrame:
    first = pairs.filter("t is not null").groupBy("t").agg(F.min(F.struct("_rank", "i")).alias("f"))
    return first.select(F.col("f.i").alias("i"), "t", F.col("f._rank").alias("_rank"))


# a literal is 0 (false), 1 (true), or four times a row's number plus 2 or 4, plus 1 where it is negated:
# whether the row's id, or its text, is still free after the row
_FALSE, _TRUE = 0, 1


def _negated(literal: Column) -> Column:
    return literal.bitwiseXOR(F.lit(1).cast("long"))


def _row_before(rows: DataFrame, key: str) -> DataFrame:
    """(n, before): the row that stands before each row of a key, null for the first.

    Rows are dealt by range, so a key of any size is spread over tasks; what crosses from one range to the
    next is one row for each key and range.
    """
    dealt = write_shared(
        rows.filter(F.col(key).isNotNull())
        .select("n", "_rank", F.col(key).alias("key"))
        .repartitionByRange("key", "_rank")
        .withColumn("part", F.spark_partition_id()),
        "dedup-dealt",
    )
    inside = dealt.select(
        "n", "key", "part", F.lag("n").over(Window.partitionBy("key", "part").orderBy("_rank")).alias("before")
    )
    ends = dealt.groupBy("key", "part").agg(F.max(F.struct("_rank", "n"))["n"].alias("last"))
    ends = ends.select(
        "key", "part", F.lag("last").over(Window.partitionBy("key").orderBy("part")).alias("earlier")
    ).filter("earlier is not null")
    return inside.join(ends, ["key", "part"], "left").select("n", F.coalesce("before", "earlier").alias("before"))


def _greedy(pairs: DataFrame) -> tuple[DataFrame, int]:
    """First-come selection when ids and texts cross, and the number of rounds it took.

    A row is kept if its id and its text are both still free. Whether the id is free after it depends on these
    two alone (``id and not text``), and likewise for the text, so a row has two inputs, each an output of the row
    before it with that id or that text. As soon as one input is known, the outputs equal a constant, the other input or its
    negation. Every round replaces inputs by what they equal, which doubles the reach of chains: they end
    in a logarithmic number of rounds. Only rows that wait for two open rows at once take turns.
    """
    numbered = write_shared(pairs.withColumn("n", F.monotonically_increasing_id()), "dedup-numbered")
    by_id = _row_before(numbered, "i").withColumnRenamed("before", "by_id")
    by_text = _row_before(numbered, "t").withColumnRenamed("before", "by_text")
    rows = numbered.join(by_id, "n").join(by_text, "n", "left").select(
        "n", "i", "t", "_rank",
        F.coalesce(F.col("by_id") * 4 + 2, F.lit(_TRUE).cast("long")).alias("a"),
        F.coalesce(F.col("by_text") * 4 + 4, F.lit(_TRUE).cast("long")).alias("b"),
    )
    state = write_shared(rows, "dedup-open")
    done = (F.col("a") <= _TRUE) & (F.col("b") <= _TRUE)
    chosen = done & (F.col("a") == _TRUE) & (F.col("b") == _TRUE)
    rounds = 0
    while not state.filter(~done).isEmpty():
        rounds += 1
        outputs = state.select("n", F.inline(F.array(
            F.struct((F.col("n") * 2 + 1).alias("output"), _after("a", "b", F.col("n") * 4 + 2).alias("equals")),
            F.struct((F.col("n") * 2 + 2).alias("output"), _after("b", "a", F.col("n") * 4 + 4).alias("equals")),
        ))).select("output", "equals")
        waiting = state.filter(~done)
        for side in "ab":
            waiting = _followed(waiting, side, outputs)
        # rows that are known stay: an open row may have come to point at any of them
        state = write_shared(waiting.unionByName(state.filter(done)), "dedup-open")
    return state.filter(chosen).select("i", "t", "_rank"), rounds


def _after(own: str, other: str, output: Column) -> Column:
    """What ``own and not other`` equals: a literal of the inputs where one rule applies, else the output itself."""
    x, y = F.col(own), F.col(other)
    false = F.lit(_FALSE).cast("long")
    return (
        F.when((x == _FALSE) | (y == _TRUE) | (x == y), false)
        .when(x == _TRUE, _negated(y))
        .when((y == _FALSE) | (x == _negated(y)), x)
        .otherwise(output)
    )


def _followed(rows: DataFrame, side: str, outputs: DataFrame) -> DataFrame:
    """``rows`` with the literal of one side replaced by what it equals; known ones find no partner."""
    literal = F.col(side)
    keyed = rows.withColumn("output", F.when(literal > _TRUE, F.shiftright(literal, 1)).otherwise(-1 - F.col("n")))
    found = F.col("equals").bitwiseXOR(literal.bitwiseAND(F.lit(1).cast("long")))
    return (
        keyed.join(outputs, "output", "left")
        .withColumn(side, F.when(F.col("equals").isNull(), literal).otherwise(found))
        .select(*rows.columns)
    )
