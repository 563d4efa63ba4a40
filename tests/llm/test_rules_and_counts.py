"""Quality rules, token counts and packing against plain Python."""

import re
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from clausewise.llm import packing, quality_rules, token_counts, tokenizer

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_statistics(text):
    text = text or ""
    words = WORD.findall(text)
    runs = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    under = {i + j for i in range(len(words) - 4) if runs[tuple(words[i : i + 5])] > 1 for j in range(5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    n = len(words)
    return {
        "n_words": n,
        "word_chars": sum(map(len, words)),
        "n_symbols": len(re.findall(r"[#*$%&|<>]", text)),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(under),
        "base_failed": n < 10 or 100 * len(under) > 20 * n,
    }


TEXTS = [
    None,
    "",
    " \n\t ",
    "one",
    "a b c d e a b c d e",
    "a b c d e f a b c d e f a b c d e f",
    "x " * 5000,
    "alpha beta\ngamma\nalpha beta\n\n  \ngamma",
    "é ü 😀 #*$%&|<> ##",
    "a\x0bb\x0cc\x1cd\x85e\xa0f g",
    "a a a a a a a a b a a a a a",
    " ".join(str(i) for i in range(3000)) + " " + " ".join(str(i) for i in range(700)),
]


@pytest.mark.parametrize("extra", [False, True])
def test_statistics(spark, docs, extra):
    rows = quality_rules.statistics(docs(list(enumerate(TEXTS)) + [(0, None)], extra))
    rows = rows.withColumn("base_failed", quality_rules.base_failed()).collect()
    assert len(rows) == len(TEXTS) + 1
    for row in rows:
        want = plain_statistics(TEXTS[row["doc_id"]])
        assert {k: row[k] for k in want} == want, row["doc_id"]


def test_rules_are_learned_and_explain_their_verdict(spark, docs, words):
    good = [(i, " ".join(words(i * 40, 40))) for i in range(60)]
    bad = [(100 + i, " ".join(w + "###" for w in words(9000 + i * 40, 40))) for i in range(60)]
    labels = spark.createDataFrame([(i, 1) for i, _ in good] + [(i, 0) for i, _ in bad] + [(7, None)], "doc_id long, quality int")
    told, rules = quality_rules.judge(docs(good + bad + [(500, None), (None, "a b")]), labels)
    assert rules and all(c.feature in quality_rules.features() for rule in rules for c in rule)
    kept = {r["doc_id"]: r["kept"] for r in told.collect()}
    assert all(kept[i] for i, _ in good) and not any(kept[i] for i, _ in bad)
    assert kept[500] is False and kept[None] is False


def test_rules_without_labels_or_documents(spark, docs):
    none = spark.createDataFrame([], "doc_id long, quality int")
    told, rules = quality_rules.judge(docs([(1, " ".join("abcdefghijkl"))]), none)
    assert rules == [] and told.first()["kept"]
    told, rules = quality_rules.judge(docs([]), none)
    assert rules == [] and told.count() == 0


RANKS = open(tokenizer.VOCABULARY, "rb").read()


def whole_count(text):
    import base64

    import tiktoken

    if not hasattr(whole_count, "encode"):
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, RANKS.splitlines())}
        whole_count.encode = tiktoken.Encoding(
            "t", pat_str=tokenizer.PATTERN, mergeable_ranks=ranks, special_tokens={}
        ).encode_ordinary
    return len(whole_count.encode(text))


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from(list("ab1' \n\t\r\x0b\x1c\x85\xa0　é😀.,'s|")), max_size=40))
def test_counts_by_stretch_equal_whole_encoding(text):
    assert tokenizer.counter(RANKS)(text) == whole_count(text)


@pytest.mark.parametrize("white", [" ", "\t", "\n", "\u3000"])
def test_very_long_white_space(white):
    """Runs on which the pattern itself would overflow; shorter ones equal the whole encoding."""
    count = tokenizer.counter(RANKS)
    for long, tail in ((2_000_000, "next"), (2_000_000, "")):
        n = count("word" + white * long + tail)
        assert count("word" + white * (long - 1) + tail) <= n <= 1 + 3 * long
    for runs in ((10_000, 30_000), (9_999, 50_000), (99_990, 1)):
        text = "a" + white * runs[0] + " b\x1c" + white * runs[1] + "c" + " d" * 40_000 + white * 20_000
        assert count(text) == whole_count(text)


def test_one_page_of_white_space_does_not_stop_the_count(spark, docs):
    rows = [(1, "a" + " \t\n"[i] * 2_000_000 + "b") for i in range(3)] + [(2, "x")]
    counts = token_counts.histogram(spark, docs(rows))
    assert token_counts.total_tokens(counts).first()["n_docs"] == 4
    assert packing.pack(spark, docs(rows)).select("doc_id").distinct().count() == 2


def test_histogram_and_limits(spark, docs):
    texts = ["", None, "hello", "hello world", "hello world", "x y z " * 900, "a" * 3000]
    table = docs(list(enumerate(texts)), True)
    counts = token_counts.histogram(spark, table)
    lengths = [whole_count(t or "") for t in texts]
    assert {(r["n_tokens"], r["n_docs"]) for r in counts.collect()} == set(Counter(lengths).items())
    for row in token_counts.limits(counts).collect():
        limit = row["n_tokens"]
        assert row["docs_at_least"] == sum(x >= limit for x in lengths)
        assert row["tokens_at_least"] == sum(x for x in lengths if x >= limit)
        assert row["docs_below"] == sum(x < limit for x in lengths)
        assert row["truncated_tokens"] == sum(min(x, limit) for x in lengths)
        assert row["lost_tokens"] == sum(lengths) - row["truncated_tokens"]
    assert token_counts.total_tokens(counts).first()["tokens"] == sum(lengths)
    assert token_counts.truncated_total(counts, 7).first()["tokens"] == sum(min(x, 7) for x in lengths)
    found = {r["share"]: r["n_tokens"] for r in token_counts.quantiles(counts, [0.5, 1.0]).collect()}
    assert found == {0.5: sorted(lengths)[3], 1.0: max(lengths)}


def test_counts_of_nothing(spark, docs):
    counts = token_counts.histogram(spark, docs([]))
    assert token_counts.limits(counts).count() == 0
    assert token_counts.total_tokens(counts).first()["tokens"] == 0


def padding(lengths, counts, ends):
    return sum(n * (min(e for e in ends if e >= x) - x) for x, n in zip(lengths, counts))


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 9), min_size=1, max_size=8), st.integers(1, 4))
def test_bucket_lengths_are_optimal(histogram, buckets):
    from itertools import combinations

    lengths = sorted(histogram)
    counts = [histogram[x] for x in lengths]
    ends = packing.bucket_lengths(lengths, counts, buckets)
    assert len(ends) <= buckets and ends[-1] == lengths[-1]
    best = min(
        padding(lengths, counts, [*some, lengths[-1]])
        for k in range(min(buckets, len(lengths)))
        for some in combinations(lengths[:-1], k)
    )
    assert padding(lengths, counts, ends) == best


def test_pack_keeps_every_token_within_budget(spark, docs, words):
    rows = [(i, " ".join(words(i, 1 + i * 7 % 90))) for i in range(80)] + [(80, None), (81, ""), (None, "null id"), (3, "again")]
    rows += [(90, " ".join(words(0, 700)))]
    packed = packing.pack(spark, docs(rows, True), context=64, buckets=4, batch_tokens=256, shard_rows=16).collect()
    want = Counter()
    for i, text in rows:
        want[i] += whole_count(text or "")
    got = Counter()
    for r in packed:
        got[r["doc_id"]] += r["n_tokens"]
        assert 0 < r["n_tokens"] <= r["bucket_tokens"] <= 64 and r["start"] == 64 * r["piece"]
    assert {k: v for k, v in want.items() if v} == dict(got)
    batches = Counter(r["batch_id"] for r in packed)
    size = {r["batch_id"]: r["bucket_tokens"] for r in packed}
    assert len(set(size.values())) <= 4
    assert all(n * size[b] <= 256 for b, n in batches.items())


def test_pack_nothing(spark, docs):
    assert packing.pack(spark, docs([(1, None)])).count() == 0
