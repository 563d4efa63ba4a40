"""Text expressions: cleaning, tokens, keys, splitting.  All JVM-side."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from clausewise import fixed_values as fv

# Unicode-aware classes, and only "\n" ends a line
UNI = "(?dU)"
UNI_LINES = "(?mdU)"
WHITESPACE = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# private markers put in front of / behind a header before splitting on them
MARK, MARK_END = "\u0001", "\u0002"

_WORD = "가-힣a-zA-Z0-9"


def strip(col: Column) -> Column:
    """Trim every Unicode whitespace character from both ends.

    Spark's trim looks each end up in the whole list byte by byte, so it runs only where there is something to trim.
    """

    def trimmed(c: Column) -> Column:
        at_edge = F.substring(c, 1, 1).isin(*WHITESPACE) | F.substring(c, -1, 1).isin(*WHITESPACE)
        return F.when(at_edge, F.trim(c, F.lit(WHITESPACE))).otherwise(c)

    return let(col, trimmed)


def is_blank(col: Column) -> Column:
    return F.length(strip(col)) == 0


def blank_to_null(col: Column) -> Column:
    return F.when(~is_blank(col), col)


def collapse(col: Column) -> Column:
    """Every whitespace run becomes one space; ends trimmed."""
    # of all that ``strip`` trims, the pattern leaves the plain space and the four separators
    return F.trim(F.regexp_replace(col, UNI + r"\s+", " "), F.lit(" \x1c\x1d\x1e\x1f"))


def head(col: Column, n: int) -> Column:
    return F.substring(col, 1, n)


def count_literal(col: Column, word: str) -> Column:
    """Non-overlapping occurrences of a literal, without a regex engine."""
    gone = F.length(F.replace(col, F.lit(word), F.lit("")))
    counted = ((F.length(col) - gone) / F.lit(len(word))).cast("int")
    # replacing costs several times the search, and most words of a list are in few texts
    return F.when(~F.contains(col, F.lit(word)), F.lit(0)).otherwise(counted)


def contains_any(col: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(col, F.lit(w)) for w in words])


def lookup(key: Column, values: dict[str, str], default: Column | None = None) -> Column:
    """Constant map lookup; ``default`` (or null) when the key is absent."""
    entries = [F.lit(x) for pair in values.items() for x in pair]
    found = F.try_element_at(F.create_map(*entries), key)
    return found if default is None else F.coalesce(found, default)


def let(value: Column, use) -> Column:
    """Evaluate ``value`` once and hand it to ``use``, which may refer to it many times."""
    return F.element_at(F.transform(F.array(value), use), 1)


def computed(**columns: Column) -> Column:
    """Columns worked out once per row, for use as the last item of a ``select``.

    They pass through a generator of one row, which later filters are not pushed through;
    otherwise a filter on an expensive column would evaluate it a second time.
    """
    return F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()])))


def drop_first_match(col: Column, pattern: str, flags: str = UNI_LINES) -> Column:
    """Remove only the first match of ``pattern`` (which may use line anchors)."""
    return F.regexp_replace(col, flags + r"\A((?s:.)*?)(?:" + pattern + ")", "$1")


# --- tokens ------------------------------------------------------------------------


def strip_particles(col: Column, particles: list[str] | None = None) -> Column:
    """Cut one trailing particle from every word, longest first, stem of two or more.

    Works on the whole text at once: the lazy stem makes the longest suffix win.
    """
    words = particles if particles is not None else fv.PARTICLES
    if not words:
        return col
    endings = "|".join(sorted(words, key=len, reverse=True))
    last = "".join(sorted({w[-1] for w in words}))
    pattern = (
        f"(?<![{_WORD}])(?=[{_WORD}]++(?<=[{last}]))"
        f"([{_WORD}]{{2,}}?)(?:{endings})(?![{_WORD}])"
    )
    return F.regexp_replace(col, pattern, "$1")


def tokenize(col: Column, particles: list[str] | None = None) -> Column:
    """Distinct words of two or more characters together with their stems."""
    words = F.lit(f"[{_WORD}]{{2,}}")
    plain = F.regexp_extract_all(col, words, F.lit(0))
    known = fv.PARTICLES if particles is None else particles
    if not known:
        return F.array_distinct(plain)
    # a text without any particle's last character has no stems to look for
    last = "".join(sorted({p[-1] for p in known}))
    stems = F.regexp_extract_all(strip_particles(col, known), words, F.lit(0))
    # plain searches: a class of so many characters takes several times as long as cutting the words
    return F.when(contains_any(col, list(last)), F.array_union(plain, stems)).otherwise(F.array_distinct(plain))


# --- splitting -----------------------------------------------------------------------


def non_blank_parts(parts: Column) -> Column:
    return F.filter(F.transform(parts, strip), lambda p: F.length(p) > 0)


def paragraphs(col: Column, separator: str = r"\n\s*\n") -> Column:
    return non_blank_parts(F.split(col, UNI + separator))


def mark(col: Column, pattern: str, replacement: str, flags: str) -> Column:
    """Insert the private markers around every match of ``pattern``."""

    def clean(c: Column) -> Column:
        bare = F.replace(F.replace(c, F.lit(MARK), F.lit("")), F.lit(MARK_END), F.lit(""))
        return F.when(contains_any(c, [MARK, MARK_END]), bare).otherwise(c)

    return F.regexp_replace(let(col, clean), flags + pattern, replacement)


def after_first(parts: Column) -> Column:
    """All elements but the first; ``parts`` is named once, so it is worked out once."""
    return F.filter(parts, lambda _, i: i > 0)


def pieces_from_matches(col: Column, pattern: str, flags: str) -> Column:
    """Pieces that start at each match and run to the next; text before is dropped."""
    return after_first(F.split(mark(col, f"({pattern})", MARK + "$1", flags), MARK))


def headed_sections(col: Column, pattern: str, flags: str) -> Column:
    """``array<struct<label, body>>`` for headers whose group 1 is the label.

    The text before the first header is the first element, with a null label.
    """
    marked = mark(col, pattern, MARK + "$1" + MARK_END, flags)
    return F.transform(
        F.split(marked, MARK),
        lambda p, i: F.struct(
            F.when(i > 0, F.substring_index(p, MARK_END, 1)).alias("label"),
            F.when(i > 0, F.substring_index(p, MARK_END, -1)).otherwise(p).alias("body"),
        ),
    )


def chunk(col: Column, size: int = 1500, overlap: int = 150) -> Column:
    """Fixed-size chunks that overlap; the last one ends with the text."""
    step = size - overlap
    text = strip(col)
    n = F.length(text)
    last = (F.ceil((n - size) / F.lit(step)) * step).cast("int")
    starts = F.when(n > size, F.sequence(F.lit(0), last, F.lit(step))).when(n > 0, F.array(F.lit(0)))
    return F.coalesce(
        F.transform(starts, lambda s: F.substring(text, s + 1, F.lit(size))),
        F.array().cast("array<string>"),
    )


def clause_items(col: Column) -> Column:
    """Numbered items of one clause; empty when there are fewer than two.

    Circled digits keep the text before the first one as an item, numbered lists drop it.
    """
    circled = non_blank_parts(F.split(col, fv.CIRCLED))
    numbered = non_blank_parts(pieces_from_matches(col, fv.NUMBERED_ITEM, UNI))
    empty = F.array().cast("array<string>")
    return (
        F.when(
            F.regexp_count(col, F.lit(fv.CIRCLED)) >= 2,
            F.when(F.size(circled) >= 2, circled).otherwise(empty),
        )
        .when(
            F.regexp_count(col, F.lit(UNI + fv.NUMBERED_ITEM)) >= 2,
            F.when(F.size(numbered) >= 2, numbered).otherwise(empty),
        )
        .otherwise(empty)
    )


# --- keys and labels --------------------------------------------------------------------


def content_id(prefix: Column, text: Column) -> Column:
    return F.concat(prefix, F.lit("-"), F.substring(F.sha1(text.cast("binary")), 1, 16))


def article_label(no: Column, sub: Column) -> Column:
    tail = F.when(F.coalesce(sub, F.lit(0)) > 0, F.concat(F.lit("의"), sub)).otherwise("")
    return F.concat(F.lit("제"), no, F.lit("조"), tail)


def article_number(col: Column) -> Column:
    """Article number in '제N조(의M)', null when the text has none."""
    return F.regexp_extract(col, UNI + fv.ARTICLE_NUMBER, 1).try_cast("int")


def article_sub_number(col: Column) -> Column:
    return F.coalesce(F.regexp_extract(col, UNI + fv.ARTICLE_NUMBER, 2).try_cast("int"), F.lit(0))


def corpus_norm(col: Column) -> Column:
    """Form compared when the whole corpus is deduplicated."""
    return F.lower(collapse(drop_first_match(col, fv.CORPUS_HEADER_LABEL)))


def content_key(col: Column, size: int | None = None) -> Column:
    """Form compared when hits of one query are deduplicated: digest of the whole, or the first ``size`` characters."""
    text = drop_first_match(col, fv.HIT_HEADER_LABEL)
    text = drop_first_match(text, fv.HIT_INLINE_HEADER)
    text = F.regexp_replace(text, fv.HIT_MARKDOWN, " ")
    norm = F.lower(F.regexp_replace(text, UNI + r"\s+", ""))
    return F.md5(norm) if size is None else head(norm, size)


def law_key(
    source: Column,
    law_name: Column,
    article_no: Column,
    sub_no: Column,
    article: Column,
    law_kind: Column | None = None,
    law_sources: list[str] | None = None,
) -> Column:
    """Statute-article key, or null when the row is not an identifiable article.

    ``law_kind`` keeps an act and its decree apart (off by default).
    """
    names = law_sources or [s for s, c in fv.RANK_CATEGORY.items() if c == "law"]
    name = blank_to_null(strip(law_name))
    kind = [] if law_kind is None else [law_kind]
    listed = F.when(
        (source == "law") & name.isNotNull() & article_no.isNotNull(),
        F.concat_ws("-", name, *kind, article_no, F.coalesce(sub_no, F.lit(0))),
    )
    cited = F.when(
        source.isin([n for n in names if n != "law"]) & article_number(article).isNotNull(),
        F.concat_ws("-", source, article_number(article), article_sub_number(article)),
    )
    return F.coalesce(listed, cited)


def hit_key(text: Column, **law_fields) -> Column:
    return F.coalesce(law_key(**law_fields), content_key(text))


# --- display ------------------------------------------------------------------------------


def reference_tag(col: Column) -> Column:
    """``struct<tag, rest>``: a leading '[tag]' of 1-12 characters, or null and the text."""
    tag = F.regexp_extract(col, UNI + fv.REFERENCE_TAG, 1)
    return F.struct(
        F.when(tag != "", tag).alias("tag"),
        F.regexp_replace(col, UNI + fv.REFERENCE_TAG, "").alias("rest"),
    )


def reference_sections(col: Column, labels: list[str] | None = None) -> Column:
    """Known headings of a reference as ``array<struct<label, body>>``, blank bodies dropped.

    A text without any heading is one section without a label, blank or not.
    """
    names = "|".join(labels or fv.REFERENCE_SECTIONS)
    found = headed_sections(col, rf"(?:^|\n)\s*({names})\s*[:：]", UNI)
    trimmed = F.transform(found, lambda s: F.struct(s["label"].alias("label"), strip(s["body"]).alias("body")))
    return F.when(F.size(found) == 1, trimmed).otherwise(
        F.filter(trimmed, lambda s: F.length(s["body"]) > 0)
    )


def summary_sections(col: Column) -> Column:
    """Sections headed by a '■ label' line as ``array<struct<label, body>>``."""
    # a label never spans lines, so only horizontal space may surround it
    pattern = r"^[^\S\n]*■[^\S\n]*([^\n]*?\S)[^\S\n]*$"


    def body(section):
        # blank lines are dropped only before the first label
        lines = F.filter(F.split(section["body"], "\n"), lambda line: ~is_blank(line))
        return F.when(section["label"].isNull(), F.array_join(lines, "\n")).otherwise(section["body"])

    trimmed = F.transform(
        headed_sections(col, pattern, UNI_LINES),
        lambda s: F.struct(s["label"].alias("label"), strip(body(s)).alias("body")),
    )
    return F.filter(trimmed, lambda s: F.length(s["body"]) > 0)


def preview(col: Column, size: int = 280) -> Column:
    return F.when(F.length(col) > size, F.concat(strip(head(col, size)), F.lit("…")))


def is_long(col: Column, size: int = 280) -> Column:
    return F.length(col) > size


def reference_line(text: Column, similarity: Column) -> Column:
    return F.concat(head(text, 80), F.lit("... (유사도: "), F.format_string("%.2f", similarity), F.lit(")"))


def file_stem(filename: Column) -> Column:
    """File name without directories and last extension (a leading dot is kept)."""
    base = F.regexp_replace(filename, r"(?s)^.*/", "")
    return F.regexp_replace(base, r"(?<=.)\.[^.]+\z", "")


def export_name(filename: Column, fmt: str) -> Column:
    stem = file_stem(filename)
    return F.concat(F.coalesce(F.nullif(stem, F.lit("")), F.lit("contract")), F.lit(fv.EXPORT_SUFFIX + fmt))


def supported_file(filename: Column, extensions: list[str] | None = None) -> Column:
    suffix = F.lower(F.regexp_extract(filename, r"(?<=[^/])\.[^./]+\z", 0))
    return suffix.isin(extensions or fv.SUPPORTED_EXTENSIONS)
