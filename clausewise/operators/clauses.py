"""Contracts to clauses.  One row in, its clauses out; nothing is shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausewise import fixed_values as fv
from clausewise.functions.text import (
    MARK,
    MARK_END,
    UNI,
    UNI_LINES,
    after_first,
    let,
    mark,
    non_blank_parts,
    paragraphs,
    pieces_from_matches,
    strip,
)

CLAUSE_TYPE = "array<struct<clause_index:int,title:string,content:string>>"


def _none(type_name: str) -> Column:
    return F.array().cast(type_name)


def special_items(section: Column, min_chars: int = 5) -> Column:
    """Items of a special-terms section: marked items, else paragraphs, else the whole."""

    def long_enough(parts: Column) -> Column:
        return F.filter(parts, lambda p: F.length(p) >= min_chars)

    marked = long_enough(F.transform(pieces_from_matches(section, fv.SPECIAL_ITEM, UNI_LINES), strip))
    whole = F.when(F.length(section) >= min_chars, F.array(section)).otherwise(_none("array<string>"))
    blocks = let(paragraphs(section), lambda found: F.when(F.size(found) > 1, long_enough(found)).otherwise(whole))
    return let(marked, lambda found: F.when(F.size(found) > 0, found).otherwise(blocks))


def special_terms(
    text: Column, header: str = fv.SPECIAL_HEADER, end_pattern: str = fv.SPECIAL_END
) -> Column:
    """``struct<main_text, items>``: the special-terms section cut out of the contract.

    The section runs from its header line to the first signature or date line; the text
    after it returns to the main text.  Without usable items the text stays whole.
    """
    whole = F.struct(text.alias("main_text"), _none("array<string>").alias("items"))

    def cut(parts: Column) -> Column:
        before, rest = parts[0], parts[1]
        # the section and what follows it; without an end line the rest is all section
        ended = mark(rest, r"\A((?s:.)*?)(" + end_pattern + ")", "$1" + MARK + "$2", UNI_LINES)
        return let(F.split(ended, MARK, 2), lambda pieces: with_items(before, pieces))

    def with_items(before: Column, pieces: Column) -> Column:
        tail = F.coalesce(F.get(pieces, F.lit(1)), F.lit(""))

        def result(items: Column) -> Column:
            found = F.struct(F.concat(before, tail).alias("main_text"), items.alias("items"))
            return F.when(F.size(items) > 0, found).otherwise(whole)

        return let(strip(pieces[0]), lambda section: let(special_items(section), result))

    # most contracts have no such section and pay for one search only
    marked = mark(text, r"\A((?s:.)*?)(?:" + header + ")", "$1" + MARK, UNI_LINES)
    return F.when(text.rlike(UNI_LINES + header), let(F.split(marked, MARK, 2), cut)).otherwise(whole)


def headed_clauses(text: Column, header_pattern: str = fv.CLAUSE_HEADER) -> Column:
    """Clauses that start with an article header line; text before the first is dropped."""
    marked = mark(text, header_pattern, MARK + "$1" + MARK_END, UNI_LINES)

    def clause(part: Column) -> Column:
        title = strip(F.substring_index(part, MARK_END, 1))
        body = strip(F.substring_index(part, MARK_END, -1))
        return let(F.struct(title.alias("title"), body.alias("body")), lambda c: named(c["title"], c["body"]))

    def named(title: Column, body: Column) -> Column:
        return F.struct(
            F.regexp_extract(title, UNI + fv.CLAUSE_NUMBER, 1).try_cast("int").alias("clause_index"),
            title.alias("title"),
            F.when(F.length(body) > 0, F.concat(title, F.lit("\n"), body)).otherwise(title).alias("content"),
        )

    # the text is named once: inside a transform Spark evaluates it as often as it is named
    return F.transform(after_first(F.split(marked, MARK)), clause)


def paragraph_clauses(text: Column, separator: str = r"\n\s*\n", min_chars: int = 20) -> Column:
    """Fallback: non-blank paragraphs, numbered before short ones are dropped."""
    blocks = non_blank_parts(F.split(text, UNI + separator))
    numbered = F.transform(
        blocks,
        lambda p, i: F.struct(
            (i + 1).cast("int").alias("clause_index"),
            F.substring(F.substring_index(p, "\n", 1), 1, 50).alias("title"),
            p.alias("content"),
        ),
    )
    return F.filter(numbered, lambda c: F.length(c["content"]) >= min_chars)


def _with_special(main: Column, items: Column) -> Column:
    """Append special terms, numbered after the highest article."""
    highest = F.aggregate(main, F.lit(0), lambda m, c: F.greatest(m, c["clause_index"]))
    extra = F.transform(
        items,
        lambda text, i: F.struct(
            (highest + 1 + i).cast("int").alias("clause_index"),
            F.concat(F.lit(fv.SPECIAL_TITLE + " "), (i + 1).cast("string")).alias("title"),
            F.concat(
                F.lit(fv.SPECIAL_TITLE + " "), (i + 1).cast("string"), F.lit("\n"), text
            ).alias("content"),
        ),
    )
    return F.concat(main, extra)


def split_clauses(
    contracts: DataFrame,
    id_col: str = "document_id",
    text_col: str = "text",
    keep: list[str] | None = None,
    header_pattern: str = fv.CLAUSE_HEADER,
    separator: str = r"\n\s*\n",
) -> DataFrame:
    """(id, clause_pos, clause_index, title, content), one row per clause.

    ``clause_pos`` (1-based position) is the key; ``clause_index`` is the article number
    shown to the reader and repeats for '제3조' and '제3조의2'.  Stages are separate
    projections so that each regex pass runs once per contract.
    """
    keep = keep or []
    cut = contracts.select(id_col, *keep, special_terms(F.col(text_col)).alias("_cut"))
    headed = cut.select(
        id_col,
        *keep,
        F.col("_cut.items").alias("_items"),
        F.col("_cut.main_text").alias("_main"),
        headed_clauses(F.col("_cut.main_text"), header_pattern).alias("_headed"),
    )
    main = F.when(F.size("_headed") > 0, F.col("_headed")).otherwise(
        paragraph_clauses(F.col("_main"), separator)
    )
    whole = headed.select(id_col, *keep, "_items", main.cast(CLAUSE_TYPE).alias("_clauses"))
    return (
        whole.select(id_col, *keep, F.posexplode(_with_special(F.col("_clauses"), F.col("_items"))))
        .select(
            id_col,
            *keep,
            (F.col("pos") + 1).alias("clause_pos"),
            "col.clause_index",
            "col.title",
            "col.content",
        )
    )


def contracts_without_clauses(contracts: DataFrame, clauses: DataFrame, id_col: str = "document_id") -> DataFrame:
    """Contracts the splitter found nothing in (rejects)."""
    return contracts.join(clauses.select(id_col).distinct(), id_col, "left_anti")
