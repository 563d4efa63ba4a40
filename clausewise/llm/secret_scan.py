"""Secret scan: known shapes of credentials, and strings that pass for random.

Every long string over an encoding's alphabet is put to three tests of randomness: chi-squared for
uniform letters, runs above and below the middle of the alphabet, and serial correlation. Ordinary
words fail them. Which strings of a text have failed is decided over all its strings at once by
weighted Benjamini-Hochberg, long strings weighing more because the tests see more of them; of the
strings set aside as ordinary, at most the share ``RATE`` is expected to be random. A string is
judged only where it is long enough for ordinary letters to fail, see ``ENCODINGS``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from math import erfc, sqrt

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: shapes of the base, in their order, and the least characters of what must be long
BASE = {
    "assign": (rb"""(?i:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""", 2, 6),
    "access": (rb"AKIA[A-Z0-9]+", 0, 20),
    # a shorter run fails whole, so asking for the length in the pattern finds the same runs
    "hex": (rb"[0-9a-f]{24,}", 0, 24),
}
_SHAPES = {kind: (re.compile(pattern), group, least) for kind, (pattern, group, least) in BASE.items()}

# alphabets from narrow to wide, each with the least length at which it is judged: for letters that
# recur as in ordinary text (two drawn are equal 65 times in 1000) the chi-squared statistic is then
# at least 40 above that of random ones; hexadecimal text, which words don't form, from 24 on
_DIGITS, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ENCODINGS = {
    "hex": (_DIGITS + _LOWER[:6], 24),
    "upper_hex": (_DIGITS + _UPPER[:6], 24),
    "base32": (_UPPER + _DIGITS[2:8], 37),
    "base36": (_DIGITS + _LOWER, 30),
    "upper_base36": (_DIGITS + _UPPER, 30),
    "base62": (_DIGITS + _UPPER + _LOWER, 20),
    "base64": (_UPPER + _LOWER + _DIGITS + "+/", 20),
    "base64url": (_UPPER + _LOWER + _DIGITS + "-_", 20),
}
_CODES = {name: {ord(c): i for i, c in enumerate(alphabet)} for name, (alphabet, _) in ENCODINGS.items()}
_CANDIDATE = re.compile(rb"[A-Za-z0-9+/_-]{20,}={0,2}")
_CLASSES = [re.compile(c) for c in (rb"[0-9]", rb"[a-z]", rb"[A-Z]")]
RATE = 0.01


def _tail(z: float) -> float:
    """Share of a normal distribution beyond ``z``."""
    return erfc(z / sqrt(2)) / 2


def infer(string: bytes) -> str | None:
    """Narrowest encoding whose alphabet holds the string and all whose kinds of letters it uses; None without one."""
    used = set(string)
    for name, codes in _CODES.items():
        if used <= codes.keys():
            kinds = [c for c in _CLASSES if c.search(bytes(codes))]
            return name if all(c.search(string) for c in kinds) else None
    return None


def battery(string: bytes, encoding: str) -> tuple[float, float, float]:
    """Chances that a random string of this length has less uniform letters, stranger runs, stronger correlation.

    The moments of the chi-squared statistic are those of short strings; its tail is the cube-root
    approximation of the gamma distribution that has them.
    """
    codes = _CODES[encoding]
    n, k = len(string), len(codes)
    counts = [0] * k
    values = [codes[b] for b in string]
    for v in values:
        counts[v] += 1
    statistic = sum(c * c for c in counts) * k / n - n
    shape = (k - 1) * n / (2 * (n - 1))
    cube = (max(statistic, 0.0) / (k - 1)) ** (1 / 3)
    uniform = _tail((cube - 1 + 1 / (9 * shape)) * 3 * sqrt(shape))

    high = [2 * v >= k for v in values]
    ups = sum(high)
    downs = n - ups
    if ups == 0 or downs == 0:
        runs = 2.0 ** (1 - n)
    else:
        seen = 1 + sum(a != b for a, b in zip(high, high[1:]))
        mean = 1 + 2 * ups * downs / n
        spread = (mean - 1) * (mean - 2) / (n - 1)
        runs = 2 * _tail(abs(seen - mean) / sqrt(spread)) if spread > 0 else 1.0

    middle = sum(values) / n
    apart = [v - middle for v in values]
    square = sum(a * a for a in apart)
    if square == 0:
        serial = 0.0
    else:
        correlation = sum(a * b for a, b in zip(apart, apart[1:])) / square
        serial = 2 * _tail(abs(correlation + 1 / n) * sqrt(n))
    return uniform, min(1.0, runs), min(1.0, serial)


def together(chances: tuple[float, ...]) -> float:
    """One chance of several, by Simes: the least of m * p_(i) / i."""
    m = len(chances)
    return min(1.0, min(m * p / i for i, p in enumerate(sorted(chances), 1)))


def ordinary(strings: list[tuple[int, float]], rate: float = RATE) -> list[bool]:
    """Which of (length, chance) are set aside as not random: Benjamini-Hochberg with weights by length."""
    if not strings:
        return []
    mean = sum(length for length, _ in strings) / len(strings)
    weighted = [chance * mean / length for length, chance in strings]
    limit = -1.0
    for i, p in enumerate(sorted(weighted), 1):
        if p <= rate * i / len(strings):
            limit = p
    return [p <= limit for p in weighted]


def base_spans(text: bytes) -> dict[str, list[tuple[int, int]]]:
    """Byte spans of the base, by kind."""
    found = {}
    for kind, (shape, group, least) in _SHAPES.items():
        found[kind] = [m.span() for m in shape.finditer(text) if m.end(group) - m.start(group) >= least]
    return found


def random_spans(text: bytes, covered: list[tuple[int, int]]) -> list[tuple[int, int, str, float]]:
    """Byte spans outside ``covered`` (sorted) of strings that pass for random: (start, end, encoding, chance)."""
    judged = []
    ends = -1
    at = 0
    for match in _CANDIDATE.finditer(text):
        start, end = match.span()
        while at < len(covered) and covered[at][0] < end:
            ends = max(ends, covered[at][1])
            at += 1
        if ends > start:
            continue
        string = match.group().rstrip(b"=")
        encoding = infer(string)
        if encoding and len(string) >= ENCODINGS[encoding][1]:
            judged.append((start, end, encoding, len(string), together(battery(string, encoding))))
    aside = ordinary([(length, chance) for *_, length, chance in judged])
    return [(start, end, encoding, chance) for (start, end, encoding, _, chance), out in zip(judged, aside) if not out]


def _points(text: bytes, spans: list[tuple]) -> list[tuple]:
    """(start, end, ...) in bytes to code points."""
    if text.isascii():
        return spans
    places = sorted({x for span in spans for x in span[:2]})
    known, at, points = {}, 0, 0
    for place in places:
        points += len(text[at:place].decode("utf-8", "surrogatepass"))
        known[place] = points
        at = place
    return [(known[s[0]], known[s[1]], *s[2:]) for s in spans]


def scan(text: bytes | None) -> tuple:
    """Fields of ``scan_column`` for one text."""
    text = text or b""
    base = base_spans(text)
    found = [(start, end, i, kind) for i, (kind, spans) in enumerate(base.items()) for start, end in spans]
    found.sort()
    own = random_spans(text, [s[:2] for s in found])
    own = [(start, end, len(base), "random", encoding, chance) for start, end, encoding, chance in own]
    found, own = _points(text, found), _points(text, own)
    told = [(start, i, f"{kind}:{start}:{end}") for start, end, i, kind in found]
    told.sort()
    every = sorted(told + [(start, i, f"{kind}:{start}:{end}") for start, end, i, kind, *_ in own])
    return (
        *(len(spans) for spans in base.values()),
        ",".join(t[2] for t in told),
        ",".join(t[2] for t in every),
        len(own),
        [encoding for *_, encoding, _ in own],
        [chance for *_, chance in own],
    )


FIELDS = (
    "n_assign long, n_access long, n_hex long, base_spans string, spans string, n_random long, "
    "encodings array<string>, chances array<double>"
)
_NAMES = [field.split()[0] for field in FIELDS.split(", ")]


def _scan(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for texts in batches:
        found = pd.DataFrame([scan(t) for t in texts], columns=_NAMES, dtype=object)
        for name in ("n_assign", "n_access", "n_hex", "n_random"):
            found[name] = found[name].astype("int64")
        yield found


def scan_column(text: Column) -> Column:
    """Struct of ``FIELDS`` for a text of any length; null counts as empty and holds nothing.

    Spans are kind:start:end in code points, end exclusive, by start and then by kind. A string that
    meets a span of the base is not judged again. ``encodings`` and ``chances`` go with the spans of
    kind ``random``, in their order. Texts are judged one by one, so repeated rows give equal results.
    """
    return F.pandas_udf(_scan, FIELDS)(text.cast("binary"))
