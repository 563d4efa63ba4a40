"""Conversation repair against all edit sequences tried one by one."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from clausewise.llm import conversation_repair as repair

TURN = "conv_id long, turn long, role string, text string, fault int, n int, audit string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 9, 9, "clash") for r in rows], TURN)


def faults_of(rows):
    seen, out = set(), []
    for _, role, text in rows:
        said = re.sub(r"[\x20\x09-\x0D]", "", text)
        out.append("blank" if not said else "duplicate" if (role, text) in seen else "truncated" if said[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows, faults):
    """Least (cost, audit, repaired) over every edit of every row and up to two inserts in every place."""
    choices = []
    for (_, role, text), fault in zip(rows, faults):
        late = 3 if fault == "truncated" else 0
        choices.append([(4, "D", [])])
        if fault not in ("blank", "duplicate"):
            choices[-1] += [(late, "K", [(role, text)])] + [(3 + late, "R", [(r, text)]) for r in ("user", "assistant")]
    gap = [(3 * k, "I" * k, [(r, "") for r in roles]) for k in range(3) for roles in itertools.product(("user", "assistant"), repeat=k)]
    slots = [gap]
    for c in choices:
        slots += [c, gap]
    best = None
    for picked in itertools.product(*slots):
        out = [x for p in picked for x in p[2]]
        if re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "-" for r, _ in out)):
            found = (sum(p[0] for p in picked), "".join(p[1] for p in picked), "\n".join(f"{r}:{t}" for r, t in out))
            best = min(best, found) if best else found
    return best


def plain(rows):
    rows = sorted(((t, r if r is not None else " ", x if x is not None else " ") for t, r, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    faults = faults_of(rows)
    turns = {t for t, _, _ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    cost, audit, text = cheapest(rows, faults) if rows else (0, "", "")
    told = hashlib.sha256(text.encode()).hexdigest()
    return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, told)


def judged(spark, turns):
    found = repair.digests(turns, repair.verdicts(turns)).collect()
    out = {r["conv_id"]: tuple(r)[1:] for r in found}
    assert len(out) == len(found)
    return out


def test_equals_all_edits_tried(spark):
    rng = random.Random(3)
    rows = []
    for conv in range(40):
        for _ in range(rng.choice([1, 2, 3, 3])):
            rows.append((conv, rng.choice([None, 0, 1, 2, 3, 7]), rng.choice(["system", "user", "assistant", "assistant", "tool", "", None]), rng.choice(["a.", "b", "c!", " \t", "", None, "é?", "a."])))
    got = judged(spark, frame(spark, rows))
    want = {c: plain([r[1:] for r in rows if r[0] == c]) for c in range(40)}
    assert got == want


def test_null_ids_repeated_rows_and_long_texts(spark):
    long = "word " * 100_000 + "."
    rows = [(None, 0, "user", "q."), (None, 1, "assistant", "a."), (5, 0, "user", long), (5, 1, "assistant", long), (5, 1, "assistant", long)]
    got = judged(spark, frame(spark, rows))
    assert got[None] == plain([r[1:] for r in rows[:2]])
    assert got[5] == plain([r[1:] for r in rows[2:]]) and got[5][6] == "KKD"
    assert judged(spark, frame(spark, [])) == {}


def test_long_conversation_is_cut_and_joined(spark, monkeypatch):
    rng = random.Random(8)
    rows = [(rng.choice([1, 1, 1, 2]), t, rng.choice(["user", "assistant", "tool", "system"]), f"{t}" + rng.choice([".", "", "!"])) for t in range(900)]
    got = judged(spark, frame(spark, rows))
    monkeypatch.setattr(repair, "BLOCK", 10**9)
    for conv in (1, 2):
        mine = [r[1:] for r in rows if r[0] == conv]
        whole = repair.Tally()
        for (turn, role, _), fault in zip(mine, faults_of(mine)):
            whole.add(turn, role[:1], {"": 0, "truncated": 3}[fault])
        assert got[conv][:7] == whole.verdict()


def test_agenda_joins_like_one_piece():
    rng = random.Random(1)
    for _ in range(60):
        rows = tuple((rng.choice("suat"), rng.choice([0, 0, 1, 3])) for _ in range(rng.randrange(1, 12)))
        cut = rng.randrange(len(rows) + 1)
        assert repair.join([repair.solve(rows[:cut]), repair.solve(rows[cut:])]) == repair.solve(rows)


def test_copies_stand_for_rows(spark):
    rows = [(1, 0, "user", "q.", 2), (1, 1, "assistant", "a.", 1), (2, 0, "user", "q.", 0), (3, 0, "user", " ", 300)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, copies int")
    got = judged(spark, turns)
    assert got[1] == plain([(0, "user", "q."), (0, "user", "q."), (1, "assistant", "a.")])
    assert got[2] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert got[3][1] == 300 and got[3][6] == "D" * 300


def test_repaired_rows(spark):
    rows = [(1, 0, "assistant", "a."), (1, 1, "user", "q"), (2, 0, "user", "q."), (2, 1, "assistant", "a.")]
    turns = frame(spark, rows)
    got = sorted(tuple(r) for r in repair.repaired(turns, repair.verdicts(turns)).collect())
    assert got[-2:] == [(2, 0, "user", "q."), (2, 1, "assistant", "a.")]
    assert "\n".join(f"{r}:{t}" for c, _, r, t in got if c == 1) == cheapest([r[1:] for r in rows[:2]], ["", "truncated"])[2]


@pytest.mark.parametrize("conv,turn", [(1, 2), (None, 0), (7, None)])
def test_damage(spark, conv, turn):
    rows = [(conv, turn, "assistant", "One. Two!"), (conv, turn, None, None)]
    kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
    got = sorted(tuple(r) for r in repair.damaged(frame(spark, rows)).select("role", "text", "copies").collect())
    text = {1: "", 2: "One Two"}.get(kind, "One. Two!")
    role = "user" if kind == 4 else "assistant"
    copies = {0: 0, 3: 2}.get(kind, 1)
    assert got == sorted([(role, text, copies), ("user" if kind == 4 else " ", "" if kind == 1 else " ", copies)])
