"""Quality rules: text statistics and a learned decision list, in DataFrame functions only.

Sequential covering: a rule is grown one threshold condition at a time on two thirds of the
labelled rows, pruned on the rest, kept while it is right more often than not there, and the
rows it covers are set aside for the next. The list becomes one conditional expression. Each step
reads counts by (feature, bin), made by Spark; rows never leave the executors.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausewise.llm.common import once, space_words, staged

REPEAT = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
COUNTS = (*BASE, "n_chars", "n_lines", "n_distinct_words", "n_upper", "n_marks", "n_digits")

# grow and prune
CUTS = 24
MAX_RULES = 8
MAX_CONDITIONS = 4
MIN_COVERED = 5


def runs(words: Column, hashes: Column, width: int = REPEAT) -> Column:
    """64-bit hashes of all runs of ``width`` words."""
    return F.when(
        F.size(words) >= width,
        F.transform(
            F.sequence(F.lit(1), F.size(words) - (width - 1)),
            lambda i: F.xxhash64(*[F.element_at(hashes, (i + j).cast("int")) for j in range(width)]),
        ),
    ).otherwise(F.array().cast("array<bigint>"))


def by_hash(windows: Column) -> Column:
    """The hashes in order, each with its place (from 0): equal ones stand side by side."""
    return F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))


def statistics(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and ``COUNTS`` (long) per row, over the whole text; null counts as empty.

    ``n_repeat_words`` counts words inside runs of ``REPEAT`` words that the text holds at least twice,
    the first time included; only a text that has such runs sorts its runs. Repeated rows give
    repeated rows, other columns are ignored.
    """
    value = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = documents.select(F.col(doc_id).alias("doc_id"), value.alias("text")).select(
        "doc_id", "text", once(words=space_words(F.col("text")))
    )
    hashed = rows.select(
        "doc_id", "text", "words", once(hashes=F.transform("words", lambda w: F.xxhash64(w)))
    ).select("doc_id", "text", "words", once(windows=runs(F.col("words"), F.col("hashes"))))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    repeats = F.size("windows") > F.size(F.array_distinct("windows"))
    placed = hashed.select(
        "doc_id",
        "text",
        "words",
        once(lines=lines, placed=F.when(repeats, by_hash(F.col("windows")))),
    )

    def beside(x: Column, i: Column) -> Column:
        near = [F.get(F.col("placed"), i + step)["h"] for step in (-1, 1)]
        return reduce(lambda a, b: a | b, [F.coalesce(h == x["h"], F.lit(False)) for h in near])

    starts = F.sort_array(F.transform(F.filter("placed", beside), lambda x: x["i"]))
    under = F.aggregate(
        starts,
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda acc, s: F.struct(
            (acc["n"] + s + REPEAT - F.greatest(acc["end"], s)).alias("n"), (s + REPEAT).alias("end")
        ),
    )["n"]

    def long(c: Column) -> Column:
        return c.cast("long")

    return placed.select(
        "doc_id",
        once(
            n_words=long(F.size("words")),
            word_chars=long(F.char_length(F.array_join("words", ""))),
            n_symbols=long(F.regexp_count("text", F.lit(r"[#*$%&|<>]"))),
            n_dup_lines=long(F.size("lines") - F.size(F.array_distinct("lines"))),
            n_repeat_words=long(F.when(F.col("placed").isNull(), F.lit(0)).otherwise(under)),
            n_chars=long(F.char_length("text")),
            n_lines=long(F.size("lines")),
            n_distinct_words=long(F.size(F.array_distinct("words"))),
            n_upper=long(F.regexp_count("text", F.lit("[A-Z]"))),
            n_marks=long(F.regexp_count("text", F.lit("[!?]"))),
            n_digits=long(F.regexp_count("text", F.lit("[0-9]"))),
        ),
    )


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (
        F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT
    )


def features() -> dict[str, Column]:
    """What conditions may ask for; all are ratios, so that they mean the same at every length, but the first."""

    def per(name: str, of: str) -> Column:
        return F.col(name) / F.greatest(F.col(of), F.lit(1))

    return {
        "words": F.col("n_words").cast("double"),
        "word_length": per("word_chars", "n_words"),
        "symbols_per_word": per("n_symbols", "n_words"),
        "marks_per_word": per("n_marks", "n_words"),
        "digits_per_word": per("n_digits", "n_words"),
        "upper_per_char": per("n_upper", "n_chars"),
        "duplicate_lines": per("n_dup_lines", "n_lines"),
        "words_per_line": per("n_words", "n_lines"),
        "distinct_words": per("n_distinct_words", "n_words"),
        "repeated_words": per("n_repeat_words", "n_words"),
    }


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        value = features()[self.feature]
        return value > self.threshold if self.above else value <= self.threshold


Rule = tuple[Condition, ...]


def covers(rule: Rule) -> Column:
    return reduce(lambda a, b: a & b, [c.column() for c in rule])


def verdict(rules: list[Rule]) -> Column:
    """The list as one conditional: false where a rule applies, in order, else true."""
    return reduce(lambda later, rule: F.when(covers(rule), False).otherwise(later), reversed(rules), F.lit(True))


def which(rules: list[Rule]) -> Column:
    """1-based number of the first rule that applies; 0 where none does."""
    numbered = list(enumerate(rules, 1))
    return reduce(lambda later, r: F.when(covers(r[1]), F.lit(r[0])).otherwise(later), reversed(numbered), F.lit(0))


def _gain(bad: int, all_: int, bad_before: int, all_before: int) -> float:
    """FOIL's information gain of narrowing a rule."""
    if not bad:
        return 0.0
    return bad * (math.log2(bad / all_) - math.log2(bad_before / all_before))


def learn(
    labelled: DataFrame,
    cuts: int = CUTS,
    max_rules: int = MAX_RULES,
    max_conditions: int = MAX_CONDITIONS,
    min_covered: int = MIN_COVERED,
) -> list[Rule]:
    """Rules for rejecting, from rows with ``COUNTS``, a boolean ``bad`` and a number ``deal``.

    Every labelled row is used. Thresholds are quantiles; ties between conditions go to the one named
    first. Without rows, or without bad ones, the list is empty. What reaches the driver is one row per
    feature, bin and fold.
    """
    names = list(features())
    asked = [(i + 0.5) / cuts for i in range(cuts)]
    wide = labelled.select("bad", "deal", *[v.alias(n) for n, v in features().items()])
    found = wide.agg(*[F.percentile_approx(n, asked, 10_000).alias(n) for n in names]).first()
    points = {n: sorted(set(found[n] or [])) for n in names}

    def bin_of(name: str) -> Column:
        return F.size(F.filter(F.array(*[F.lit(p) for p in points[name]]), lambda p: F.col(name) > p)) if points[
            name
        ] else F.lit(0)

    binned = staged(
        wide.select(
            "bad", (F.pmod(F.col("deal"), F.lit(3)) == 0).alias("prune"), *[bin_of(n).alias(n) for n in names]
        ),
        "rules-binned",
    )

    def holds(rule: Rule) -> Column:
        tests = []
        for c in rule:
            cut = points[c.feature].index(c.threshold)
            tests.append(F.col(c.feature) > cut if c.above else F.col(c.feature) <= cut)
        return reduce(lambda a, b: a & b, tests, F.lit(True))

    def grow(left: DataFrame) -> Rule:
        rule: Rule = ()
        while len(rule) < max_conditions:
            inside = left.filter(~F.col("prune") & holds(rule))
            cells = F.explode(F.array(*[F.struct(F.lit(n).alias("f"), F.col(n).alias("b")) for n in names])).alias("c")
            rows = (
                inside.select("bad", cells)
                .groupBy("c.f", "c.b")
                .agg(F.count(F.lit(1)).alias("n"), F.count_if("bad").alias("k"))
                .collect()
            )
            table = {n: {r["b"]: (r["k"], r["n"]) for r in rows if r["f"] == n} for n in names}
            bad, total = (sum(v[i] for v in table[names[0]].values()) for i in (0, 1))
            if not bad or bad == total:
                break
            best, choice = 0.0, None
            for name in names:
                low_bad = low_all = 0
                for cut, threshold in enumerate(points[name]):
                    k, n = table[name].get(cut, (0, 0))
                    low_bad, low_all = low_bad + k, low_all + n
                    for above, b, a in ((True, bad - low_bad, total - low_all), (False, low_bad, low_all)):
                        if b >= min_covered and a < total:
                            gain = _gain(b, a, bad, total)
                            if gain > best:
                                best, choice = gain, Condition(name, above, threshold)
            if choice is None:
                break
            rule += (choice,)
        return rule

    def prune(rule: Rule, left: DataFrame) -> tuple[Rule, float]:
        """The prefix with the best (bad - good) / covered on the pruning rows, the shortest of equals."""
        held = left.filter("prune")
        aggs = []
        for i in range(1, len(rule) + 1):
            inside = holds(rule[:i])
            aggs += [F.count_if(inside & F.col("bad")).alias(f"k{i}"), F.count_if(inside).alias(f"n{i}")]
        row = held.agg(*aggs).first()
        worth = [(2 * row[f"k{i}"] - row[f"n{i}"]) / row[f"n{i}"] if row[f"n{i}"] else 0.0 for i in range(1, len(rule) + 1)]
        top = max(worth)
        size = worth.index(top) + 1
        return rule[:size], top

    rules: list[Rule] = []
    left = binned
    while len(rules) < max_rules:
        rule = grow(left)
        if not rule:
            break
        rule, worth = prune(rule, left)
        if worth <= 0:
            break
        rules.append(rule)
        left = left.filter(~holds(rule))
    return rules


def judge(
    documents: DataFrame,
    labels: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
) -> tuple[DataFrame, list[Rule]]:
    """Per row of ``documents``: doc_id, ``COUNTS``, base_failed, rule and kept; and the learned list.

    ``labels`` has doc_id and quality (1 good, 0 bad; null is ignored). A row that fails the base is not
    kept and not learned from; else the list decides. An empty text fails the base (no words).
    """
    stats = staged(statistics(documents, doc_id, text), "rules-statistics")
    known = labels.select(F.col("doc_id").alias("label_id"), F.col("quality").alias("quality")).filter(
        F.col("quality").isNotNull()
    )
    labelled = (
        stats.filter(~base_failed())
        .join(known, F.col("doc_id") == F.col("label_id"))
        .select(*COUNTS, (F.col("quality") == 0).alias("bad"), F.xxhash64("doc_id").alias("deal"))
    )
    rules = learn(labelled)
    failed = base_failed()
    told = stats.select("*", failed.alias("base_failed"), which(rules).alias("rule"), (~failed & verdict(rules)).alias("kept"))
    return told, rules
