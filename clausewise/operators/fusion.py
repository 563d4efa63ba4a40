"""Reciprocal-rank fusion with per-category quotas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clausewise import fixed_values as fv
from clausewise.functions import text as X
from clausewise.functions.scoring import category_weight, reciprocal_rank
from clausewise.functions.text import lookup


def rank_category(source: Column, mapping: dict[str, str] | None = None) -> Column:
    return lookup(source, mapping or fv.RANK_CATEGORY, F.lit("other"))


def report_category(source: Column, mapping: dict[str, str] | None = None) -> Column:
    return lookup(source, mapping or fv.REPORT_CATEGORY, F.lit("law"))


def combine(vector_hits: DataFrame, bm25_hits: DataFrame, rrf_k: int = fv.RRF_K) -> DataFrame:
    """(query_id, id, rrf, similarity) over both lists of ``(query_id, id, similarity, pos)``.

    A missing side adds nothing; where both exist the vector similarity is shown.
    """
    sides = vector_hits.select("query_id", "id", "similarity", "pos", F.lit(1).alias("side")).unionByName(
        bm25_hits.select("query_id", "id", "similarity", "pos", F.lit(0).alias("side"))
    )
    return sides.groupBy("query_id", "id").agg(
        F.sum(reciprocal_rank(F.col("pos"), rrf_k)).alias("rrf"),
        F.max_by("similarity", "side").alias("similarity"),
    )


def describe(pool: DataFrame, kb: DataFrame, law_kind: bool = False) -> DataFrame:
    """Attach category and duplicate key to fused hits from the KB rows they point at."""
    optional = {c: F.col(c) if c in kb.columns else F.lit(None) for c in ("law_name", "article_no", "sub_no", "article", "law_kind")}
    facts = kb.select("id", "source", "text", *[c.alias(n) for n, c in optional.items()])
    key = X.hit_key(
        F.col("text"),
        source=F.col("source"),
        law_name=F.col("law_name").cast("string"),
        article_no=F.col("article_no").cast("int"),
        sub_no=F.col("sub_no").cast("int"),
        article=F.coalesce(F.col("article").cast("string"), F.lit("")),
        law_kind=F.col("law_kind").cast("string") if law_kind else None,
    )
    return (
        pool.join(facts, "id")
        .withColumn("category", rank_category(F.col("source")))
        .withColumn("dedup_key", key)
        .withColumn("rrf_score", F.round(F.col("rrf") * category_weight(F.col("category")), 6))
        .select("query_id", "id", "source", "category", "similarity", "rrf_score", "dedup_key")
    )


def _category_rank(category: Column) -> Column:
    out = F.lit(len(fv.CATEGORY_ORDER))
    for name, rank in fv.CATEGORY_ORDER.items():
        out = F.when(category == name, F.lit(rank)).otherwise(out)
    return out


def select_by_quota(
    hits: DataFrame, k: int = fv.TOP_K, quota: list[tuple[str, int]] | None = None, fill: bool = True
) -> DataFrame:
    """Quota selection, then fill to ``k``: adds ``pos`` in output order and ``filled``.

    The pool of one query is bounded (two retriever pools), so it is gathered into one
    sorted array and folded once: a row is taken when its category still has room and its
    key is new; afterwards free places go to the best remaining rows of any category.
    One shuffle by query, no self-joins.
    """
    quota = fv.CATEGORY_QUOTA if quota is None else quota
    row = F.struct(
        _category_rank(F.col("category")).alias("cat_rank"),
        F.col("rrf_score"), F.col("id"), F.col("dedup_key"), F.col("category"), F.col("source"), F.col("similarity"),
    )
    strings = F.array().cast("array<string>")
    ids = F.array().cast(f"array<{hits.schema['id'].dataType.simpleString()}>")
    counters = [F.lit(0).alias(name) for name, _ in quota]
    start = F.struct(strings.alias("keys"), ids.alias("ids"), *counters)

    def take(state: Column, item: Column, wanted: Column, category_counts: bool) -> Column:
        new = wanted & ~F.array_contains(state["keys"], item["dedup_key"])
        grown = [
            (state[name] + (F.when(item["category"] == name, 1).otherwise(0) if category_counts else 0)).alias(name)
            for name, _ in quota
        ]
        taken = F.struct(
            F.array_append(state["keys"], item["dedup_key"]).alias("keys"),
            F.array_append(state["ids"], item["id"]).alias("ids"),
            *grown,
        )
        return F.when(new, taken).otherwise(state)

    def by_quota(state: Column, item: Column) -> Column:
        room = F.lit(False)
        for name, n in quota:
            room = room | ((item["category"] == name) & (state[name] < n))
        return take(state, item, room, True)

    def by_score(state: Column, item: Column) -> Column:
        free = (F.size(state["ids"]) < k) & ~F.array_contains(state["ids"], item["id"])
        return take(state, item, free, False)

    def best_first(a: Column, b: Column) -> Column:
        return (
            F.when(a["rrf_score"] > b["rrf_score"], -1)
            .when(a["rrf_score"] < b["rrf_score"], 1)
            .when(a["id"] > b["id"], -1)
            .when(a["id"] < b["id"], 1)
            .otherwise(0)
        )

    def by_category(a: Column, b: Column) -> Column:
        return (
            F.when(a["cat_rank"] < b["cat_rank"], -1)
            .when(a["cat_rank"] > b["cat_rank"], 1)
            .otherwise(best_first(a, b))
        )

    def output_order(a: Column, b: Column) -> Column:
        return (
            F.when(a["cat_rank"] < b["cat_rank"], -1)
            .when(a["cat_rank"] > b["cat_rank"], 1)
            .when(a["rrf_score"] > b["rrf_score"], -1)
            .when(a["rrf_score"] < b["rrf_score"], 1)
            .when(a["id"] < b["id"], -1)
            .when(a["id"] > b["id"], 1)
            .otherwise(0)
        )

    pools = hits.groupBy("query_id").agg(F.collect_list(row).alias("pool"))
    quoted = pools.withColumn("quoted", F.aggregate(F.array_sort("pool", by_category), start, by_quota))
    state = F.aggregate(F.array_sort("pool", best_first), F.col("quoted"), by_score) if fill else F.col("quoted")
    filled = quoted.withColumn("state", state)
    chosen = filled.select(
        "query_id",
        F.col("quoted.ids").alias("by_quota"),
        F.posexplode(
            F.array_sort(
                F.filter("pool", lambda x: F.array_contains(F.col("state.ids"), x["id"])), output_order
            )
        ).alias("at", "hit"),
    )
    return chosen.filter(F.col("at") < k).select(
        "query_id",
        (F.col("at") + 1).alias("pos"),
        "hit.id", "hit.source", "hit.category", "hit.similarity", "hit.rrf_score",
        (~F.array_contains("by_quota", F.col("hit.id"))).alias("filled"),
    )


def fuse(
    vector_hits: DataFrame,
    bm25_hits: DataFrame,
    kb: DataFrame,
    k: int = fv.TOP_K,
    quota: list[tuple[str, int]] | None = None,
    law_kind: bool = False,
) -> DataFrame:
    """Stratified reciprocal-rank fusion of two hit lists."""
    return select_by_quota(describe(combine(vector_hits, bm25_hits), kb, law_kind), k, quota)


def merge_items(hits: DataFrame, clause_keys: list[str]) -> DataFrame:
    """Union of the hits of one clause's items: first seen wins, order kept in ``pos``.

    ``hits(clause keys, item_pos, pos, id, ...)``; not re-ranked and not cut.
    """
    others = [c for c in hits.columns if c not in (*clause_keys, "item_pos", "pos", "id")]
    first = hits.groupBy(*clause_keys, "id").agg(
        F.min(F.struct("item_pos", "pos", *others)).alias("first")
    )
    flat = first.select(*clause_keys, "id", "first.*")
    order = [F.asc("item_pos"), F.asc("pos")]
    return flat.withColumn("merged_pos", F.row_number().over(Window.partitionBy(*clause_keys).orderBy(*order)))
