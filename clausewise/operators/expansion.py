"""Search queries of a clause: items, or the clause expanded with related words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausewise import fixed_values as fv
from clausewise.functions.text import clause_items, let


def extra_words(
    body: Column, contract_type: Column, expansions: list[tuple[str, str, str]] | None = None
) -> Column:
    """Distinct extra search words of the triggers found in the body, in declared order."""
    rows = fv.QUERY_EXPANSIONS if expansions is None else expansions
    found = F.array(
        *[F.when((contract_type == ct) & F.contains(body, F.lit(trigger)), F.lit(extra)) for ct, trigger, extra in rows]
    )
    return F.array_distinct(F.array_compact(found))


def needs_expansion(title: Column, body: Column, threshold: int = fv.EXPANSION_THRESHOLD) -> Column:
    return (F.length(body) < threshold) | F.contains(title, F.lit(fv.SPECIAL_MARK))


def expanded_query(
    title: Column, body: Column, contract_type: Column, expansions: list[tuple[str, str, str]] | None = None
) -> Column:
    def joined(words: Column) -> Column:
        return F.when(F.size(words) > 0, F.concat(body, F.lit(fv.EXPANSION_LABEL), F.array_join(words, " "))).otherwise(body)

    return F.when(needs_expansion(title, body), let(extra_words(body, contract_type, expansions), joined)).otherwise(body)


def clause_queries(
    clauses: DataFrame, keys: list[str], expansions: list[tuple[str, str, str]] | None = None
) -> DataFrame:
    """(keys, contract_type, item_pos, text): one row per item, or one for the whole clause."""
    whole = F.array(expanded_query(F.col("title"), F.col("content"), F.col("contract_type"), expansions))
    found = let(clause_items(F.col("content")), lambda items: F.when(F.size(items) > 0, items).otherwise(whole))
    return clauses.select(*keys, "contract_type", F.posexplode(found).alias("item_pos", "text"))
