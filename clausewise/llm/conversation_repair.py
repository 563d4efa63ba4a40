"""Conversation repair: the lightest edit of every conversation whose turns break the role grammar.

Items are (rows read, initial of the last role); each edit is a deduction that appends its letter
and adds its cost. Costs never fall and no audit is less than its own beginning, so the function is
superior, and Knuth's agenda pops every item first with its least (cost, audit). It is monotone
too: of two equally dear audits of one item neither begins the other (what follows could only be
inserts, and those cost). Hence a conversation may be cut anywhere: blocks of rows are solved from
every entry state and joined by the same agenda, so no task has to hold a whole conversation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from heapq import heappop, heappush

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausewise.llm.common import SPACE

# fixed values: costs of the edits, by their letters
KEEP, REROLE, DELETE, INSERT, LEFT_TRUNCATED = 0, 3, 4, 3, 3
# the role that may follow the last one ('' before the first row, where a system turn may come too), by initials
FOLLOWS = {"": "u", "s": "u", "u": "a", "a": "u"}
ROLES = {"u": "user", "a": "assistant"}
COMPLETE = ("", "a")
LEGAL = {"su", "ua", "au"}
FINE, BLANK, DUPLICATE, TRUNCATED = range(4)
# rows solved by one agenda; only the work depends on it
BLOCK = 64
# rows of one turn stand by role, the first characters of the text, and its digest
TIE_CHARS = 64

Weight = tuple[int, str]
Item = tuple[int, str]
Span = dict[tuple[str, str], Weight]


def lightest(start: Item, deduce: Callable[[Item], Iterable], goals: Iterable[Item]) -> dict[Item, Weight]:
    """Least (cost, audit) of every item up to the last goal; ``deduce`` yields (cost, letters, conclusion)."""
    agenda: list = [(0, "", start)]
    final: dict[Item, Weight] = {}
    waiting = set(goals)
    while agenda and waiting:
        cost, audit, item = heappop(agenda)
        if item in final:
            continue
        final[item] = cost, audit
        waiting.discard(item)
        for more, letters, conclusion in deduce(item):
            if conclusion not in final:
                heappush(agenda, (cost + more, audit + letters, conclusion))
    return final


@lru_cache(maxsize=50_000)
def solve(rows: tuple[tuple[str, int], ...], entries: tuple[str, ...] = ("", "s", "u", "a")) -> Span:
    """Lightest edits of ``rows`` (role initial, fault) between any two states."""

    def deduce(item: Item):
        at, state = item
        follows = FOLLOWS[state]
        yield INSERT, "I", (at, follows)
        if at == len(rows):
            return
        initial, fault = rows[at]
        yield DELETE, "D", (at + 1, state)
        if fault in (BLANK, DUPLICATE):
            return
        extra = LEFT_TRUNCATED if fault == TRUNCATED else 0
        if initial == follows or (state == "" and initial == "s"):
            yield KEEP + extra, "K", (at + 1, initial)
        yield REROLE + extra, "R", (at + 1, follows)

    found: Span = {}
    for entry in entries:
        final = lightest((0, entry), deduce, [(len(rows), state) for state in FOLLOWS])
        found |= {(entry, state): final[len(rows), state] for state in FOLLOWS if (len(rows), state) in final}
    return found


def join(spans: list[Span]) -> Span:
    """Lightest edits through consecutive spans, between any two states."""

    def deduce(item: Item):
        at, state = item
        if at < len(spans):
            for leave in FOLLOWS:
                if (state, leave) in spans[at]:
                    cost, audit = spans[at][state, leave]
                    yield cost, audit, (at + 1, leave)

    found: Span = {}
    for entry in {enter for enter, _ in spans[0]}:
        final = lightest((0, entry), deduce, [(len(spans), state) for state in FOLLOWS])
        found |= {(entry, state): final[len(spans), state] for state in FOLLOWS if (len(spans), state) in final}
    return found


class Tally:
    """What is known of consecutive rows of one conversation; tallies of neighbours can be joined."""

    COUNTS = ("blank", "duplicate", "truncated")

    def __init__(self, entries: tuple[str, ...] = ("",)):
        self.entries, self.held = entries, []
        self.faults = [0, 0, 0, 0]
        self.rows = self.illegal = self.turns = 0
        self.least = self.most = None
        self.first = self.last = ""
        self.stack: list[tuple[int, Span]] = []

    def add(self, turn: int | None, initial: str, fault: int) -> None:
        if self.rows == 0:
            self.first = initial
        else:
            self.illegal += self.last + initial not in LEGAL
        self.last = initial
        self.rows += 1
        self.faults[fault] += 1
        if turn is not None and turn != self.most:
            self.turns += 1
            self.least = turn if self.least is None else self.least
            self.most = turn
        self.held.append((initial, fault))
        if len(self.held) == BLOCK:
            self._close()

    def _close(self) -> None:
        if self.held:
            every = self.stack or len(self.entries) > 1
            self._push(0, solve(tuple(self.held), tuple(FOLLOWS) if every else self.entries))
            self.held = []

    def _push(self, level: int, span: Span) -> None:
        # equal lengths are joined first, so that an audit is copied once a level
        while self.stack and self.stack[-1][0] == level:
            level, span = level + 1, join([self.stack.pop()[1], span])
        self.stack.append((level, span))

    def span(self) -> Span:
        self._close()
        if not self.stack:
            return solve((), self.entries)
        return join([s for _, s in self.stack])

    def fields(self) -> dict:
        spans = [(enter, leave, cost, audit) for (enter, leave), (cost, audit) in self.span().items()]
        return {
            "rows": self.rows,
            "faults": self.faults,
            "illegal": self.illegal,
            "turns": self.turns,
            "least": self.least,
            "most": self.most,
            "first": self.first,
            "last": self.last,
            "spans": [dict(zip(("enter", "leave", "cost", "audit"), s)) for s in spans],
        }

    def extend(self, part: dict) -> None:
        """Join the fields of the rows that follow."""
        if part["rows"] == 0:
            return
        if self.rows == 0:
            self.first, self.illegal = part["first"], part["illegal"]
        else:
            self.illegal += part["illegal"] + (self.last + part["first"] not in LEGAL)
        self.last = part["last"]
        self.rows += part["rows"]
        self.faults = [a + b for a, b in zip(self.faults, part["faults"])]
        if part["turns"]:
            self.turns += part["turns"] - (self.most is not None and self.most == part["least"])
            self.least = part["least"] if self.least is None else self.least
            self.most = part["most"]
        self._push(0, {(s["enter"], s["leave"]): (s["cost"], s["audit"]) for s in part["spans"]})

    def verdict(self) -> tuple:
        span = self.span()
        cost, audit = min(span["", state] for state in COMPLETE if ("", state) in span)
        gaps = self.most - self.least + 1 - self.turns if self.turns else 0
        return gaps, *self.faults[1:], self.illegal, cost, audit


PART = (
    "rows long, faults array<long>, illegal long, turns long, least long, most long, first string, last string, "
    "spans array<struct<enter string, leave string, cost long, audit string>>"
)
VERDICT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
_NAMES = [field.split()[0] for field in VERDICT.split(", ")]
_ARROW = {"long": pa.int64(), "string": pa.string(), "array<long>": pa.list_(pa.int64())}
_PART_TYPES = {
    **{f.split()[0]: _ARROW[f.split()[1]] for f in PART.split("spans")[0].split(", ") if f},
    "spans": pa.list_(
        pa.struct([("enter", pa.string()), ("leave", pa.string()), ("cost", pa.int64()), ("audit", pa.large_string())])
    ),
}


def _runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[bool, object, dict]]:
    """(begins, key, row) of sorted batches; ``begins`` where the key differs from the row before."""
    last: object = object()
    for batch in batches:
        for row in batch.to_pylist():
            yield row[key] != last, row[key], row
            last = row[key]


def _batches(rows: Iterator[dict], schema: pa.Schema, size: int = 1000) -> Iterator[pa.RecordBatch]:
    held: list[dict] = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_pylist(held, schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _parts(key_type: pa.DataType) -> Callable:
    """Rows in order to one row for each conversation and partition."""
    schema = pa.schema([("conv_id", key_type), ("part", pa.int32()), *_PART_TYPES.items()])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        part, tally, conv = TaskContext.get().partitionId(), None, None
        for begins, key, row in _runs(batches, "conv_id"):
            if begins:
                if tally:
                    yield {"conv_id": conv, "part": part, **tally.fields()}
                # the first conversation of a partition may have begun in the one before
                tally, conv = Tally(("",) if tally else tuple(FOLLOWS)), key
            for copy in range(row["n"]):
                tally.add(row["turn"], row["initial"], DUPLICATE if copy and row["fault"] != BLANK else row["fault"])
        if tally:
            yield {"conv_id": conv, "part": part, **tally.fields()}

    return lambda batches: _batches(rows(batches), schema)


def _verdicts(key_type: pa.DataType) -> Callable:
    """Parts in order to one row for each conversation."""
    types = [(f.split()[0], _ARROW[f.split()[1]]) for f in VERDICT.split(", ")]
    schema = pa.schema([("conv_id", key_type), *types])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        tally, conv = None, None
        for begins, key, part in _runs(batches, "conv_id"):
            if begins:
                if tally:
                    yield {"conv_id": conv, **dict(zip(_NAMES, tally.verdict()))}
                tally, conv = Tally(), key
            tally.extend(part)
        if tally:
            yield {"conv_id": conv, **dict(zip(_NAMES, tally.verdict()))}

    return lambda batches: _batches(rows(batches), schema)


def _key_type(turns: DataFrame) -> tuple[str, pa.DataType]:
    kind = dict(turns.dtypes)["conv_id"]
    return kind, {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]


def _plain(turns: DataFrame) -> DataFrame:
    """Rows as they are judged: null roles and texts one space, the sort columns of ties, and how often the row stands."""
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    copies = F.col("copies") if "copies" in turns.columns else F.lit(1)
    return turns.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), copies.cast("long").alias("copies")).select(
        "*",
        F.substring("text", 1, TIE_CHARS).alias("tie"),
        F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256).alias("digest"),
    )


_ORDER = ("conv_id", "turn", "role", "tie", "digest")


def _judged(turns: DataFrame) -> DataFrame:
    """One light row, without its text, for each different row, with its fault and number of copies."""
    trimmed = F.btrim("text", F.lit(SPACE))
    fault = (
        F.when(F.length(trimmed) == 0, BLANK)
        .when(~F.substring(trimmed, -1, 1).isin(".", "!", "?"), TRUNCATED)
        .otherwise(FINE)
    )
    light = (
        _plain(turns)
        .withColumn("fault", fault)
        .groupBy(*_ORDER, "fault")
        .agg(F.sum("copies").alias("n"))
    )
    again = (
        light.filter("n > 0")
        .groupBy(F.col("conv_id").alias("again_id"), F.col("digest").alias("again_digest"))
        .agg(F.count("*").alias("places"), F.min("turn").alias("first_turn"), F.max(F.col("turn").isNull()).alias("no_turn"))
        .filter("places > 1")
    )
    same = F.col("conv_id").eqNullSafe(F.col("again_id")) & (F.col("digest") == F.col("again_digest"))
    later = F.coalesce(F.when(F.col("no_turn"), F.col("turn").isNotNull()).otherwise(F.col("turn") > F.col("first_turn")), F.lit(False))
    return light.join(again, same, "left").select(
        *_ORDER,
        F.substring("role", 1, 1).alias("initial"),
        F.when(later & (F.col("fault") != BLANK), DUPLICATE).otherwise(F.col("fault")).alias("fault"),
        "n",
    )


def verdicts(turns: DataFrame) -> DataFrame:
    """Faults and the lightest repair of every conversation of ``turns`` (conv_id, turn, role, text and, where
    present, ``copies``, the number of times the row stands; 0: not at all).

    Rows stand by turn (nulls first), role and text; a null role or text is one space. A role's
    initial counts, and a row with an empty role can't be kept. Repeated rows are duplicates of the
    first. A null ``conv_id`` is an id of its own; a conversation without rows gets zeros and an
    empty audit; no rows give no rows. Rows are dealt by range, so a long conversation is spread
    over many tasks; only its audit, one letter a row, comes together.
    """
    kind, key_type = _key_type(turns)
    parts = (
        _judged(turns)
        .repartitionByRange(*_ORDER)
        .sortWithinPartitions(*_ORDER)
        .select("conv_id", "turn", "initial", "fault", "n")
        .mapInArrow(_parts(key_type), f"conv_id {kind}, part int, {PART}")
    )
    return (
        parts.repartition("conv_id")
        .sortWithinPartitions("conv_id", "part")
        .mapInArrow(_verdicts(key_type), f"conv_id {kind}, {VERDICT}")
    )


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict | None, str, str | None]]:
    """(verdict, '', None) where a conversation begins, then (None, role, text) for each repaired row."""
    letters: Iterator[str] = iter("")
    state = ""

    def inserted(until_row: bool):
        nonlocal state
        for letter in letters:
            if letter != "I":
                assert until_row, "an audit has more letters than its conversation has rows"
                return letter
            state = FOLLOWS[state]
            held.append((None, ROLES[state], ""))
        assert not until_row, "an audit has fewer letters than its conversation has rows"

    held: list[tuple[dict | None, str, str | None]] = []
    for batch in batches:
        for row in batch.to_pylist():
            if row["audit"] is not None:
                inserted(until_row=False)
                letters, state = iter(row["audit"]), ""
                held.append((row, "", None))
            else:
                for _ in range(row["copies"]):
                    letter = inserted(until_row=True)
                    if letter != "D":
                        state = FOLLOWS[state] if letter == "R" else row["role"][:1]
                        held.append((None, ROLES[state] if letter == "R" else row["role"], row["text"]))
            yield from held
            held.clear()
    inserted(until_row=False)
    yield from held


def _with_audits(turns: DataFrame, found: DataFrame) -> DataFrame:
    """Every verdict before the rows of its conversation, in order within partitions."""
    rows = _plain(turns).filter("copies > 0")
    return (
        found.withColumn("copies", F.lit(0).cast("long"))
        .unionByName(rows, allowMissingColumns=True)
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", F.col("audit").isNull(), *_ORDER[1:])
        .select(*found.columns, "role", "text", "copies")
    )


def repaired(turns: DataFrame, found: DataFrame) -> DataFrame:
    """Repaired rows (conv_id, position, role, text) under the ``verdicts`` of the same ``turns``.

    Rows stream through their task in order: one row and the audit of its conversation are held.
    """
    kind, key_type = _key_type(turns)
    schema = pa.schema([("conv_id", key_type), ("position", pa.int64()), ("role", pa.string()), ("text", pa.string())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        conv, position = None, 0
        for verdict, role, text in _edited(batches):
            if verdict:
                conv, position = verdict["conv_id"], 0
            else:
                yield {"conv_id": conv, "position": position, "role": role, "text": text}
                position += 1

    return _with_audits(turns, found).mapInArrow(
        lambda batches: _batches(rows(batches), schema), f"conv_id {kind}, position long, role string, text string"
    )


def digests(turns: DataFrame, found: DataFrame) -> DataFrame:
    """``found`` with repaired_sha256, the hash of the repaired rows as role:text, joined by line feeds.

    A hash is sequential, so the texts of one conversation stream through one task; none are held.
    """
    kind, key_type = _key_type(turns)
    types = [(f.split()[0], _ARROW[f.split()[1]]) for f in VERDICT.split(", ")]
    schema = pa.schema([("conv_id", key_type), *types, ("repaired_sha256", pa.string())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        open_row, told, sep = None, hashlib.sha256(), b""
        for verdict, role, text in _edited(batches):
            if verdict:
                if open_row:
                    yield {**open_row, "repaired_sha256": told.hexdigest()}
                open_row = {name: verdict[name] for name in ("conv_id", *_NAMES)}
                told, sep = hashlib.sha256(), b""
            else:
                told.update(sep + f"{role}:{text}".encode())
                sep = b"\n"
        if open_row:
            yield {**open_row, "repaired_sha256": told.hexdigest()}

    return _with_audits(turns, found).mapInArrow(
        lambda batches: _batches(rows(batches), schema), f"conv_id {kind}, {VERDICT}, repaired_sha256 string"
    )


def damaged(turns: DataFrame) -> DataFrame:
    """``turns`` with faults put in by a hash of their ids: rows lost, emptied, cut, said twice or under a wrong role."""
    name = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    kind: Column = F.crc32(name.cast("binary")) % 20
    text = F.coalesce("text", F.lit(" "))
    return turns.select(
        "conv_id",
        "turn",
        F.when(kind == 4, "user").otherwise(F.coalesce("role", F.lit(" "))).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"),
    )
