"""Licence scan: notice phrases and identifier tags by Aho-Corasick, expressions by a shunting-yard parser."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import ahocorasick
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from clausewise.llm.common import alnum_words_of

# fixed values: notice phrases of the base and their labels
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
# phrases of our own
MORE = {
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "boost software license": "bsl",
    "bsd license": "bsd",
    "isc license": "isc",
    "creative commons attribution": "cc-by",
    "cc by nc": "cc-by-nc",
    "cc by nd": "cc-by-nd",
    "cc by sa": "cc-by-sa",
    "cc0": "cc0",
    "released into the public domain": "public-domain",
    "all rights reserved": "reserved",
}
TAG = "spdx license identifier"
_TAG_LINE = re.compile(rb"spdx-license-identifier:[ \t]*([^\r\n]*)", re.IGNORECASE)
# first letters of a licence identifier and the label of its family; the first that fits counts
FAMILIES = {
    "gpl": "gpl",
    "lgpl": "lgpl",
    "agpl": "agpl",
    "apache": "apache",
    "cc-by-nc": "cc-by-nc",
    "cc-by-nd": "cc-by-nd",
    "cc-by-sa": "cc-by-sa",
    "cc-by": "cc-by",
    "cc0": "cc0",
    "mit": "mit",
    "bsd": "bsd",
    "isc": "isc",
    "mpl": "mpl",
    "epl": "epl",
    "bsl": "bsl",
}
PERMISSIVE = {"apache", "bsd", "bsl", "cc-by", "cc0", "isc", "mit", "public-domain", "unlicense"}

_TOKEN = re.compile(r"[()]|[^\s()]+")
_RANK = {"or": 1, "and": 2, "with": 3}
_ATOM = re.compile(r"[a-z0-9][a-z0-9.:+-]*$")


def family(identifier: str) -> str:
    return next((label for start, label in FAMILIES.items() if identifier.startswith(start)), identifier)


def postfix(expression: str) -> list[str] | None:
    """Operands and operators in evaluation order, lower-cased; None where the expression is malformed."""
    out: list[str] = []
    held: list[str] = []
    operand_next = True
    for token in _TOKEN.findall(expression.lower()):
        if token == "(":
            if not operand_next:
                return None
            held.append(token)
        elif token == ")":
            if operand_next:
                return None
            while held and held[-1] != "(":
                out.append(held.pop())
            if not held:
                return None
            held.pop()
        elif token in _RANK:
            if operand_next:
                return None
            while held and held[-1] != "(" and _RANK[held[-1]] >= _RANK[token]:
                out.append(held.pop())
            held.append(token)
            operand_next = True
        else:
            if not operand_next or not _ATOM.match(token):
                return None
            out.append(token)
            operand_next = False
    if operand_next or "(" in held:
        return None
    return out + held[::-1]


def evaluate(steps: list[str]) -> tuple[set[str], bool]:
    """Labels named by an expression, and whether its choices leave a permissive way to use the text.

    ``or`` needs one permissive side, ``and`` both; an exception (``with``) keeps its licence's standing.
    """
    stack: list[tuple[set[str], bool]] = []
    for step in steps:
        if step in _RANK:
            right, left = stack.pop(), stack.pop()
            if step == "with":
                stack.append(left)
            elif step == "or":
                stack.append((left[0] | right[0], left[1] or right[1]))
            else:
                stack.append((left[0] | right[0], left[1] and right[1]))
        else:
            label = family(step)
            stack.append(({label}, label in PERMISSIVE))
    return stack[0]


@cache
def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for phrase in [*BASE, *MORE, TAG]:
        found.add_word(f" {phrase} ", phrase)
    found.make_automaton()
    return found


def scan(text: bytes | None) -> tuple:
    """Fields of ``scan_column`` for one text."""
    words = alnum_words_of(text)
    # words are cut at ASCII bytes only, so latin-1 gives one character per byte and loses nothing
    line = b" ".join([b"", *words, b""]).decode("latin-1")
    base, own, places, tagged, n_base, starts = set(), set(), 0, False, 0, []
    for end, phrase in _automaton().iter(line):
        if phrase == TAG:
            tagged = True
            continue
        places += 1
        if phrase in BASE:
            n_base += 1
            base.add(BASE[phrase])
            starts.append(end - len(phrase) - 1)
        else:
            own.add(MORE[phrase])
    expressions, permissive = [], None
    if tagged:
        for found in _TAG_LINE.findall(text):
            told = found.decode("utf-8", "replace").strip().removesuffix("*/").removesuffix("-->").strip()
            steps = postfix(told)
            if steps:
                labels, allowed = evaluate(steps)
                own |= labels
                permissive = allowed if permissive is None else permissive and allowed
                expressions.append(told)
    first = line.count(" ", 0, min(starts)) if starts else None
    last = line.count(" ", 0, max(starts)) if starts else None
    score = 1.0 if expressions else 1.0 - 0.5**places
    labels = ",".join(sorted(base | own))
    return len(words), n_base, first, last, ",".join(sorted(base)), labels, score, expressions, permissive


FIELDS = (
    "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
    "score double, expressions array<string>, permissive boolean"
)
_NAMES = [field.split()[0] for field in FIELDS.split(", ")]


def _scan(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for texts in batches:
        found = pd.DataFrame([scan(t) for t in texts], columns=_NAMES, dtype=object)
        for name in ("n_words", "n_base"):
            found[name] = found[name].astype("int64")
        for name in ("first_word", "last_word"):
            found[name] = found[name].astype("Int64")
        found["score"] = found["score"].astype("float64")
        yield found


def scan_column(text: Column) -> Column:
    """Struct of ``FIELDS`` for a text of any length; null counts as empty: no words, no labels, score 0.

    ``n_base`` counts all places of base phrases, overlapping ones too; ``labels`` adds our phrases
    and well-formed identifier expressions; a malformed expression is ignored. ``permissive`` is
    null without an expression. ``score`` is 1 with an expression, else 1 - 2 ** -places.
    """
    return F.pandas_udf(_scan, FIELDS)(text.cast("binary"))
