"""Source divergence against plain Python with whole numbers."""

import random
import re
from collections import Counter

import pandas as pd

from clausewise.llm import source_divergence as divergence

DOC = "text string, lang string, source string, p long, tile int, term string, n long"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 1, "clash", 1) for r in rows], DOC)


def plain(rows):
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(fold))) for text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        having = Counter(t for d in mine for t in set(d[2]))
        kept = sorted(t for t, n in having.items() if n >= 10)
        counts = {s: Counter(t for d in mine if d[1] == s for t in d[2] if having[t] >= 10) for s in {d[1] for d in mine}}
        counts[None] = sum(counts.values(), Counter())
        p = {s: {t: 1 + 10**9 * (c[t] + 2) // (sum(c.values()) + 2 * len(kept)) for t in kept} for s, c in counts.items()}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in counts:
            if s is None:
                continue
            pairs = [(o, sum(f(p[s][t], p[o][t]) for t in kept)) for o in counts if o not in (None, s)]
            terms = [(t, f(p[s][t], p[None][t])) for t in kept if counts[s][t] and p[s][t] > p[None][t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, 10)):
                ranked = sorted(found, key=lambda x: (-x[1], x[0].encode()))[:most]
                out += [(lang, s, part, item, value, i) for i, (item, value) in enumerate(ranked, 1)]
    return sorted(out)


def corpus(seed, n, vocabulary=60):
    rng = random.Random(seed)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(vocabulary)] + ["É", "é", "ünïtS", "ÀB"]
    rows = []
    for i in range(n):
        source = rng.choice(["a", "a", "a", "b", "c", "", None, "é", "z"])
        few = words if source != "b" else words[: vocabulary // 3]
        text = rng.choice([" ", "\n", "1", "-"]).join(rng.choices(few, k=rng.randrange(0, 30)))
        rows.append((rng.choice([text, text.upper(), text, None if i % 17 == 0 else text]), rng.choice(["en", "en", "de", None]), source))
    return rows


def test_equals_plain(spark):
    rows = corpus(1, 400) + [("", "xx", "empty"), (None, "xx", "nothing"), ("once", "yy", "alone")]
    got = sorted(tuple(r) for r in divergence.divergence(frame(spark, rows)).collect())
    assert got == plain(rows) and len(got) > 60


def test_tiles_slices_and_flushes_change_nothing(spark, monkeypatch):
    rows = [(t, "en", f"s{i % 7}") for i, (t, _, _) in enumerate(corpus(2, 300))]
    for name, value in (("TILE", 2), ("SLICE", 5), ("_HELD", 9), ("_SPLIT", 16), ("_AT_ONCE", 7)):
        monkeypatch.setattr(divergence, name, value)
    got = sorted(tuple(r) for r in divergence.divergence(frame(spark, rows)).collect())
    assert got == plain(rows)


def test_small_tiles_in_python(monkeypatch):
    monkeypatch.setattr(divergence, "_AT_ONCE", 3)
    rng = random.Random(4)
    shares = {(s, t): rng.randrange(1, 10**9) for s in "abcd" for t in "klmno" if rng.random() < 0.6}
    zero = {s: rng.randrange(1, 10**6) for s in "abcd"}
    rows = [("en", 0, 0, 0, 0, s, 5, None, z) for s, z in zero.items()] + [("en", 0, 0, 0, 0, s, 5, t, p) for (s, t), p in shares.items()]
    got = divergence.tile_sums(pd.DataFrame(rows, columns=["lang", "here", "there", "piece", "tile", "source", "kept", "term", "p"]))
    for _, a, b, value in got.itertuples(index=False):
        p = [(shares.get((a, t), zero[a]), shares.get((b, t), zero[b])) for t in "klmno"]
        assert value == sum((x - y) ** 2 // (x + y) for x, y in p)
    assert len(got) == 6


def test_terms_of_long_texts_with_and_without_blanks(monkeypatch):
    monkeypatch.setattr(divergence, "_SPLIT", 8)
    for text in ("", "   ", "abcdefghijklmnopqrstuvwxyz", "ab cd ef gh ij kl", "abcdefghijkl mn", " lead and trail ", "A1b2C3 dé-É"):
        words = re.findall(rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text.encode().lower())
        assert divergence.term_counts(text.encode()) == Counter(words)


def test_no_rows_and_counts_beyond_64_bits(spark):
    assert divergence.divergence(frame(spark, [])).count() == 0
    big = spark.createDataFrame([(9_300_000_000, 20_000_000_000, 3)], "n long, total long, terms long")
    got = big.select(divergence._share(big.n, big.total, big.terms).alias("p")).first()["p"]
    assert got == 1 + 10**9 * (9_300_000_000 + 2) // (20_000_000_000 + 6)
