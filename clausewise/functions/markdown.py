"""Front matter and sections of statute and precedent files, row-local."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from clausewise import fixed_values as fv
from clausewise.functions.text import MARK, UNI_LINES, headed_sections, mark, strip


def front_matter(text: Column) -> Column:
    """Block between the first two '---', or null when the file does not start with one."""
    return F.when(text.rlike(r"(?s)\A---.*?---"), F.regexp_extract(text, r"(?s)\A---(.*?)---(.*)\z", 1))


def after_front_matter(text: Column) -> Column:
    return F.when(text.rlike(r"(?s)\A---.*?---"), F.regexp_extract(text, r"(?s)\A---(.*?)---(.*)\z", 2))


def raw_value(block: Column, key: str) -> Column:
    """Value of a flat ``key: value`` line as written, null when the key is absent."""
    pattern = rf"^\Q{key}\E[^\S\n]*:(?:[^\S\n]+([^\n]*?))?[^\S\n]*$"
    return F.when(block.rlike(UNI_LINES + pattern), strip(F.regexp_extract(block, UNI_LINES + pattern, 1)))


def unquote(value: Column) -> Column:
    return F.regexp_replace(value, r"""(?s)\A(['"])(.*)\1\z""", "$2")


def value(block: Column, key: str) -> Column:
    return unquote(raw_value(block, key))


def flat_map(text: Column, line_end: str = "\n", separator: str = ": ") -> Column:
    """Flat ``key: value`` lines as a map; of repeated keys the last wins."""
    lines = F.filter(F.split(text, line_end), lambda line: F.contains(line, F.lit(separator)))
    pairs = F.transform(
        lines,
        lambda line: F.struct(
            F.substring_index(line, separator, 1).alias("key"),
            strip(F.substring(line, F.instr(line, separator) + len(separator), F.length(line))).alias("value"),
        ),
    )
    last = F.filter(
        pairs,
        lambda p, i: ~F.exists(
            F.slice(pairs, i + 2, F.greatest(F.size(pairs) - i - 1, F.lit(0))), lambda q: q["key"] == p["key"]
        ),
    )
    return F.map_from_entries(last)


def is_in_force(block: Column, key: str = "상태") -> Column:
    """A missing or quoted-empty status counts as in force, a bare empty one does not."""
    raw = raw_value(block, key)
    status = strip(unquote(raw))
    return raw.isNull() | (status == fv.IN_FORCE) | ((status == "") & (raw != ""))


def law_articles(body: Column) -> Column:
    """``array<struct<article_no, sub_no, title, body>>`` of '##### 제N조' headers.

    A '#' or '##' line ends the article before it; deeper chapter lines stay in the body,
    and what follows the closing bracket on the header line is dropped.
    """
    header = r"^#####[^\S\n]+제\d+조(?:의\d+)?[^\S\n]*\("
    marked = mark(body, f"({header}|^##?\\x20)", MARK + "$1", UNI_LINES)
    fields = fv.LAW_ARTICLE_HEADER

    def article(part: Column) -> Column:
        line = F.substring_index(part, "\n", 1)
        return F.struct(
            F.regexp_extract(line, fields, 1).try_cast("int").alias("article_no"),
            F.coalesce(F.regexp_extract(line, fields, 2).try_cast("int"), F.lit(0)).alias("sub_no"),
            strip(F.regexp_extract(line, fields, 3)).alias("title"),
            strip(F.substring(part, F.length(line) + 2, F.length(part))).alias("body"),
        )

    parts = F.filter(F.split(marked, MARK), lambda p: p.rlike(r"\A#####\s+제\d+조"))
    return F.filter(F.transform(parts, article), lambda a: F.length(a["body"]) > 0)


def named_sections(body: Column, names: list[str] | None = None) -> Column:
    """``array<struct<label, body>>`` of '## name' headings from a fixed list."""
    listed = "|".join(names or fv.PRECEDENT_SECTIONS)
    found = headed_sections(body, rf"^##\s+({listed})\s*$", UNI_LINES)
    return F.transform(
        F.filter(found, lambda s: s["label"].isNotNull()),
        lambda s: F.struct(s["label"].alias("label"), strip(s["body"]).alias("body")),
    )


def section(sections: Column, name: str) -> Column:
    """Body of a section; the last one wins, '' when there is none."""
    hits = F.filter(sections, lambda s: s["label"] == name)
    return F.coalesce(F.try_element_at(hits, F.lit(-1))["body"], F.lit(""))


