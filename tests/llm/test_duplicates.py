"""Line dedup, near duplicates, components and decontamination against plain Python."""

import hashlib
import os
import random
import re

import numpy as np
import pytest

from clausewise.llm import components, decontaminate, line_dedup, near_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def ascii_lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def plain_removals(rows, percent=80, min_words=1):
    lines = []
    for i, text in sorted((i, t) for i, t in rows if i is not None and t is not None):
        for n, line in enumerate(text.split("\n")):
            found = WORD.findall(line.lower())
            if len(found) >= min_words:
                lines.append((i, n, frozenset(found)))
    gone = {}
    for k, (i, n, own) in enumerate(lines):
        if any(100 * len(own & other) >= percent * len(own | other) for _, _, other in lines[:k]):
            gone.setdefault(i, []).append(n)
    return gone


def noisy(rng, words, rate):
    return [w if rng.random() > rate else f"new{rng.randrange(10**9)}" for w in words]


@pytest.fixture(scope="module")
def line_rows(words):
    rng = random.Random(3)
    base = [words(100 * k, 6 + 5 * k) for k in range(9)]
    rows = []
    for i in range(160):
        lines = []
        for _ in range(rng.randrange(1, 6)):
            kind = rng.random()
            chosen = list(rng.choice(base))
            if kind < 0.5:
                chosen = noisy(rng, chosen, rng.choice([0.02, 0.05, 0.1, 0.2]))
            elif kind < 0.6:
                rng.shuffle(chosen)
            elif kind < 0.7:
                chosen = chosen[: rng.randrange(1, 5)]
            elif kind < 0.85:
                chosen = [f"own{rng.randrange(10**9)}" for _ in range(12)]
            lines.append(("  " if kind < 0.1 else "") + " ".join(chosen).capitalize())
        rows.append((i, "\n".join(lines)))
    return [*rows, (200, None), (201, ""), (202, "\n\n \n"), (203, "ha ha\nHa\n ho\nHO"), (None, rows[0][1])]


@pytest.mark.parametrize("split_lines", [1 << 20, 4])
def test_line_removals(spark, docs, line_rows, split_lines):
    """With a small ``split_lines`` common tokens are dealt over several tasks; nothing changes."""
    found = line_dedup.removals(docs(line_rows, True), slots=1 << 15, split_lines=split_lines).collect()
    assert {r["doc_id"]: r["lines"] for r in found} == plain_removals(line_rows)


@pytest.mark.parametrize("percent", [50, 76, 95])
def test_line_removals_at_other_thresholds(spark, docs, line_rows, percent):
    rows = [*line_rows, (300, "Tab\there and\r there\n\t\n\x0b \r\n\ttab here there and"), (301, "tab HERE and there\n\t")]
    found = line_dedup.removals(docs(rows), percent=percent, slots=1 << 15).collect()
    assert {r["doc_id"]: r["lines"] for r in found} == plain_removals(rows, percent)


def test_lines_of_common_words_are_not_joined(spark, docs):
    """Nearly all words are in several lines, few neighbours of the ordered sets are."""
    rng = random.Random(8)
    vocabulary = [f"w{'o' * (i % 7)}{i}" for i in range(2000)]
    rows = [(i, "\n".join(" ".join(rng.sample(vocabulary, 25)) for _ in range(5))) for i in range(60)]
    lines = line_dedup._lines(docs(rows), 1)
    keyed = line_dedup._keyed_rows(lines, 80)
    assert keyed.count() == 300 * (2 * 25 * 20 // 100 + 1)
    name = line_dedup._stored_rows(line_dedup._met(keyed, 80), 80, 1 << 20)
    assert spark.table(name).count() < keyed.count() / 10
    spark.sql(f"DROP TABLE {name}")


def test_long_lines_that_share_neighbours_are_ruled_out(spark, docs):
    """Any two share their longest words and little else: one word of bitmap is as full for them as for similar sets."""
    rng = random.Random(9)
    common = [f"{'long' * 5}{i}" for i in range(8)]
    rows = [(i, " ".join(common + [f"w{rng.randrange(10**6)}" for _ in range(90 + 12 * i)])) for i in range(20)]
    lines = line_dedup._lines(docs(rows), 1)
    name = line_dedup._stored_rows(line_dedup._met(line_dedup._keyed_rows(lines, 80), 80), 80, 1 << 20)
    stored = spark.table(name)
    assert stored.count() >= 20 and stored.filter("best is not null").count() == 0
    assert line_dedup._pairs(stored, stored, 80, False).count() == 0
    spark.sql(f"DROP TABLE {name}")


def test_bitmaps_never_rule_out_similar_sets(spark, docs):
    """Bitmaps differ in no more bits than the sets do in words, whatever the widths of the two."""
    rows = []
    for size in (30, 71, 72, 159, 160, 400):
        own = [f"w{size}o{i}{'x' * (i % 5)}" for i in range(size)]
        changed = own[: size - size // 9] + [f"new{size}o{i}" for i in range(size // 9)]
        longer = own + [f"more{size}o{i}" for i in range(size // 4)]
        rows += [(1000 * size + k, " ".join(x)) for k, x in enumerate([own, changed, own[: -(-size * 8 // 10)], longer])]
    found = {r["doc_id"]: r["lines"] for r in line_dedup.removals(docs(rows)).collect()}
    assert found == {i: [0] for i, _ in rows if i % 1000}


def test_keys_dealt_out_in_passes(spark, docs, line_rows, monkeypatch):
    """Four passes find what one finds, and leave none of the rows that they stored."""
    monkeypatch.setattr(line_dedup, "PASS_KEYS", 100)
    folder = spark.conf.get("spark.checkpoint.dir")
    before = set(os.listdir(folder))
    found = line_dedup.removals(docs(line_rows, True), slots=1 << 15).collect()
    assert {r["doc_id"]: r["lines"] for r in found} == plain_removals(line_rows)
    kept = [x.rsplit("-", 1)[0] for x in set(os.listdir(folder)) - before]
    assert kept.count("llm-lines-offers") == line_dedup.PASSES
    assert not [x for x in kept if x.startswith(("llm-lines_", "llm-lines-sets")) or x == "llm"]


def test_deduplicated_texts(spark, docs, line_rows):
    table = docs(line_rows, True)
    found, n_removed, has_lines = line_dedup.deduplicate(table, slots=1 << 15)
    gone = plain_removals(line_rows)
    got = {r["doc_id"]: r for r in found.collect()}
    assert found.columns[: len(table.columns)] == table.columns and n_removed not in table.columns
    for i, text in line_rows:
        lost = gone.get(i, [])
        want = text if not lost else "\n".join(x for n, x in enumerate(text.split("\n")) if n not in lost)
        assert got[i]["text"] == want and got[i][n_removed] == len(lost) and got[i]["lang"] == "en"
        if lost:
            assert got[i][has_lines] == any(WORD.findall(x) for x in want.split("\n"))


def test_line_dedup_of_nothing(spark, docs):
    found, n_removed, _ = line_dedup.deduplicate(docs([]), slots=1 << 15)
    assert found.count() == 0
    found, n_removed, _ = line_dedup.deduplicate(docs([(1, "a b c d"), (1, "a b c d")]), slots=1 << 15)
    assert [r[n_removed] for r in found.collect()] == [0, 0]


def test_components(spark):
    rng = random.Random(5)
    links = [(i, i + 1) for i in range(0, 60)] + [(100, x) for x in range(101, 140)] + [(200, 201), (201, 200), (300, 300)]
    links += [(rng.randrange(400, 460), rng.randrange(400, 460)) for _ in range(50)]
    found = {r["id"]: r["component"] for r in components.components(spark.createDataFrame(links, "u long, v long")).collect()}
    group = {x: {x} for pair in links for x in pair}
    for a, b in links:
        if group[a] is not group[b]:
            group[a] |= group[b]
            for x in group[b]:
                group[x] = group[a]
    assert found == {x: min(g) for x, g in group.items() if len(g) > 1}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def plain_groups(rows, k, percent=80):
    sets = []
    for _, text in rows:
        w = WORD.findall(ascii_lower(text))
        n = min(k, len(w))
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set())
    group = list(range(len(rows)))

    def top(x):
        while group[x] != x:
            x = group[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                group[top(a)] = top(b)
    ids = {}
    for x, (i, _) in enumerate(rows):
        if i is not None:
            ids[top(x)] = min(ids.get(top(x), i), i)
    return [(i, len(s), ids.get(top(x)) if s else i) for x, ((i, _), s) in enumerate(zip(rows, sets))]


@pytest.fixture(scope="module")
def near_rows(words):
    rng = random.Random(11)
    rows = []
    for i in range(150):
        base = words(1000 * rng.randrange(6), rng.choice([30, 80, 150]))
        kind = rng.random()
        chosen = noisy(rng, base, rng.choice([0.0, 0.005, 0.02, 0.04])) if kind < 0.7 else [f"w{rng.randrange(10**9)}" for _ in range(40)]
        rows.append((i, " ".join(chosen)))
    rows += [(500, None), (501, " \n"), (502, "One two"), (503, "one  TWO"), (504, "two one"), (505, ""), (None, rows[0][1])]
    return [*rows, (0, rows[0][1])]


@pytest.mark.parametrize(("k", "leaf"), [(4, 2048), (5, 2048), (4, 12)])
def test_near_groups(spark, docs, near_rows, k, leaf):
    """A small ``leaf`` makes nodes branch; groups stay whole."""
    found = near_dedup.groups(docs(near_rows, True), words=k, leaf=leaf).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in found), key=key)
    assert got == sorted(plain_groups(near_rows, k), key=key)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in found)


def test_leaf_finds_links_that_the_forest_misses(spark, docs, words):
    """Parts left unconnected by unconfirmed likely pairs are joined by the pairs across them."""
    rng = np.random.default_rng(1)
    a = np.sort(rng.integers(0, 1 << 60, 100, dtype=np.uint64))
    sets = [a, np.sort(np.r_[a[:90], a[:10] + np.uint64(1)]), np.sort(np.r_[a[:88], a[:12] + np.uint64(2)])]
    signs = np.stack([near_dedup.signature(s) for s in sets])
    sizes = np.array([100, 100, 100])
    links = near_dedup._rest(signs, sizes, np.array([0, 0, 1]), sets, 75)
    assert len(links) == 1 and 2 in links[0]


@pytest.fixture(scope="module")
def template_rows(words):
    """A passage that all texts share makes them alike below the threshold; every third text has one partner above it."""
    rng = random.Random(8)
    rows = []
    for i in range(90):
        own = [f"own{i}x{n}" for n in range(26)]
        rows.append(words(0, 100) + own)
        if i % 3 == 0:
            rows.append(words(0, 100) + own[: rng.randrange(14, 20)] + [f"other{i}x{n}" for n in range(8)])
    rng.shuffle(rows)
    return [(i, " ".join(row)) for i, row in enumerate(rows)]


@pytest.mark.parametrize("cell", [1024, 16])
def test_near_groups_of_nodes_that_stay_large(spark, docs, template_rows, monkeypatch, cell):
    """Pairs that fall into different blocks of a large node are found; small cells change nothing."""
    monkeypatch.setattr(near_dedup, "CELL", cell)
    found = near_dedup.groups(docs(template_rows), words=4, leaf=6, rounds=1).collect()
    want = sorted(plain_groups(template_rows, 4))
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in found) == want
    assert sum(i != component for i, _, component in want) == 30


@pytest.mark.parametrize("rounds", [1, 16])
def test_near_groups_do_not_depend_on_node_size(spark, docs, template_rows, rounds):
    """Three trees find all pairs of a crowd, although every round of branching parts some of them."""
    found = near_dedup.groups(docs(template_rows), words=4, trees=3, leaf=6, rounds=rounds).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in found) == sorted(plain_groups(template_rows, 4))


def test_near_groups_with_unlucky_signatures(spark, docs):
    """A pair at the threshold is found although few places of its signatures are equal."""
    for turn in range(20_000):
        texts = [" ".join(f"t{turn}x{n}" for n in [*range(80), *range(at, at + 10)]) for at in (100, 200)]
        a, b = (near_dedup.signature(near_dedup.shingles(t.encode(), 1)) for t in texts)
        if (a == b).sum() < 87:
            break
    found = near_dedup.groups(docs([(1, texts[0]), (2, texts[1])]), words=1).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in found) == [(1, 1), (2, 1)]


def test_near_groups_of_nothing(spark, docs):
    assert near_dedup.groups(docs([])).count() == 0
    assert [r["kept"] for r in near_dedup.groups(docs([(1, None)])).collect()] == [True]


def plain_contamination(docs, items, width=10):
    windows = {}
    for i, text in items:
        w = ALNUM.findall(ascii_lower(text))
        n = min(width, len(w))
        for at in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[at : at + n]), set()).add("" if i is None else str(i))
    sizes = {len(x) for x in windows}
    out = []
    for i, text in docs:
        w = ALNUM.findall(ascii_lower(text))
        hit, found = set(), set()
        for n in sizes:
            for at in range(len(w) - n + 1):
                ids = windows.get(tuple(w[at : at + n]))
                if ids:
                    hit.update(range(at, at + n))
                    found |= ids
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()))
    return out


@pytest.mark.parametrize("map_bits", [1 << 23, 64])
def test_contamination(spark, docs, words, map_bits):
    """A tiny map lets every hash through; the result is the same."""
    rng = random.Random(2)
    items = [(i, " ".join(words(50 * i, 10 + i))) for i in range(8)]
    items += [(20, "Short item"), (21, None), (22, "..."), (23, " ".join(words(0, 11))), (None, "null id item here"), (24, "the the the the the the the the the the the the")]
    rows = []
    for i in range(60):
        chosen = [f"w{rng.randrange(40)}" for _ in range(rng.randrange(0, 60))]
        for _ in range(rng.randrange(3)):
            piece = ALNUM.findall(ascii_lower(rng.choice(items)[1]))
            start = rng.randrange(4)
            at = rng.randrange(len(chosen) + 1)
            chosen[at:at] = piece[start : start + rng.randrange(6, 30)]
        rows.append((i, " ".join(chosen).upper() if i % 2 else ", ".join(chosen)))
    rows += [(90, None), (91, ""), (92, "the " * 30), (93, "ünï SHORT, item é"), (5, rows[5][1]), (None, "short item")]
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id long")
    found = decontaminate.contamination(docs(rows, True), bench, map_bits=map_bits)
    got = [
        (r["doc_id"], r["n_words"], r["n"], len(r["items"]), hashlib.sha256(",".join(r["items"]).encode()).hexdigest())
        for r in found.withColumn("n", decontaminate.words_under(found.hits)).collect()
    ]
    key = lambda r: (r[0] is None, r[0] or 0, r)
    assert sorted(got, key=key) == sorted(plain_contamination(rows, items), key=key)
    assert any(r[2] for r in got)


def test_winnowing_shares_a_hash_in_every_span():
    rng = np.random.default_rng(4)
    long = rng.integers(0, 50, 400).astype(np.uint64)
    for at in range(0, 380, 7):
        span = long[at : at + 10]
        a = near_dedup.gram_hashes(long, 6)
        b = near_dedup.gram_hashes(span, 6)
        kept = {int(a[i]) for i in decontaminate.winnow(a, 5) if at <= i <= at + 4}
        assert kept & {int(b[i]) for i in decontaminate.winnow(b, 5)}


def test_contamination_of_nothing(spark, docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contamination(docs([]), none).count() == 0
    row = decontaminate.contamination(docs([(1, "a b")]), none).first()
    assert row["hits"] == [] and row["items"] == [] and row["n_words"] == 2
