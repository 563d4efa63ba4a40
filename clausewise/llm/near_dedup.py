"""Near-duplicate documents by a chosen-path set similarity join over minwise tokens.

Documents are sets of word shingles; equal sets are one class. In each of several independent
trees a class follows the shingles that are least under the tree's hash functions: classes that
agree on one share a node. A node with many classes branches on by functions chosen by the node
itself, 1 / threshold of them on average, so that a pair at the threshold is expected to stay
together in one child. Small nodes are compared exhaustively, by signature; what looks similar is
confirmed on the full sets.

A node hands on a spanning forest of its most similar pairs rather than all pairs. Where a
confirmed forest leaves parts of a node unconnected, every similar pair across the parts is
tried on the full sets, so nothing is lost to the shorter way.

Branching parts some pairs in every round, and nodes that stay large are only tied together in
blocks. All classes of a tree's first nodes that have to branch therefore also meet in an exact
join, so that a pair's chance does not depend on how many other texts share its passages: shingles are ordered from rare to common, two similar sets share one of their first
few, and length and position rule pairs out before the full sets are compared.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausewise.llm.common import gram_hashes, mix, space_words_of, staged, word_hashes
from clausewise.llm.components import components

WORDS = 5
PERCENT = 80
TREES = 10
SIGNATURE = 128
LEAF = 2048
ROUNDS = 16
# places of the frequency sketch of the exact join, whatever the input; a power of two
SLOTS = 1 << 18
# rows on either side of a cell of the exact join
CELL = 1024

_rng = np.random.default_rng(20_240)
# odd multipliers, one per hash function
_FACTORS = (_rng.integers(0, 1 << 63, SIGNATURE, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)


def shingles(text: bytes | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of all runs of ``words`` words; a shorter text is one run; no words, none."""
    hashes = word_hashes(space_words_of(text))
    return np.unique(gram_hashes(hashes, min(words, len(hashes)))) if len(hashes) else np.empty(0, np.uint64)


def signature(items: np.ndarray) -> np.ndarray:
    """The least shingle under each function, as 32 bits; long sets are taken in blocks."""
    least = np.full(SIGNATURE, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(items), 1024):
        least = np.minimum(least, (items[None, at : at + 1024] * _FACTORS[:, None]).min(axis=1))
    return (least >> np.uint64(32)).astype(np.uint32)


def set_key(items: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(items.tobytes())


def alike(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * shared >= percent * (len(a) + len(b) - shared)


def least_matches(percent: int) -> int:
    """Equal signature places that a pair at the threshold falls short of less than once in a million times at 80%."""
    p = percent / 100
    return math.floor(SIGNATURE * p - 5.5 * math.sqrt(SIGNATURE * p * (1 - p)))


def _sketched(documents: DataFrame, doc_id: str, text: str, words: int) -> DataFrame:
    id_type = documents.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, keys, signatures = [], [], []
            for value in batch.column("text"):
                items = shingles(value.as_py(), words)
                counts.append(len(items))
                keys.append(set_key(items) if len(items) else None)
                signatures.append(signature(items).tobytes() if len(items) else None)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("text_key"),
                    pa.array(counts, pa.int64()),
                    pa.array(keys, pa.binary()),
                    pa.array(signatures, pa.binary()),
                ],
                names=["doc_id", "text_key", "n_shingles", "set_key", "signature"],
            )

    rows = documents.select(
        F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("text_key"), F.col(text).cast("binary").alias("text")
    )
    made = rows.mapInArrow(run, f"doc_id {id_type}, text_key long, n_shingles long, set_key binary, signature binary")
    return made.withColumn("row", F.monotonically_increasing_id())


def _child(nodes: np.ndarray, places: np.ndarray, values: np.ndarray) -> np.ndarray:
    return mix(mix(nodes + places.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ values.astype(np.uint64)).astype(np.int64)


def _first_nodes(classes: DataFrame, trees: int) -> DataFrame:
    """(node, class_id) of every tree's first branch; the trees start at different functions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            signs = _matrix(batch.column("signature"))
            for tree in range(trees):
                place = np.full(len(signs), tree * (SIGNATURE // trees))
                nodes = _child(np.full(len(signs), tree, np.uint64), place, signs[:, place[0]] if len(signs) else place)
                yield pa.RecordBatch.from_arrays([pa.array(nodes), batch.column("class_id")], names=["node", "class_id"])

    return classes.select("class_id", "signature").mapInArrow(run, "node long, class_id long")


def _branched(members: DataFrame, percent: int) -> DataFrame:
    """(node, class_id, signature) to the (node, class_id) of the children.

    A node chooses its functions by its own number: one, and a second one as often as makes
    1 / threshold on average.
    """
    second = np.uint64(int(min(1.0, 100 / percent - 1) * (2**64 - 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            signs = _matrix(batch.column("signature"))
            nodes = batch.column("node").to_numpy(zero_copy_only=False).astype(np.uint64)
            rows = np.arange(len(nodes))
            for turn, chosen in ((1, rows), (2, rows[mix(nodes ^ np.uint64(3)) < second])):
                place = (mix(nodes[chosen] ^ np.uint64(turn)) % np.uint64(SIGNATURE)).astype(np.int64)
                children = _child(nodes[chosen], place, signs[chosen, place])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(children), batch.column("class_id").take(pa.array(chosen))], names=["node", "class_id"]
                )

    return members.select("node", "class_id", "signature").mapInArrow(run, "node long, class_id long")


def _matrix(column: pa.Array) -> np.ndarray:
    joined = b"".join(x.as_py() for x in column)
    return np.frombuffer(joined, np.uint32).reshape(len(column), SIGNATURE)


def _leaves(classes: DataFrame, trees: int, percent: int, leaf: int, rounds: int) -> tuple[DataFrame, DataFrame | None]:
    """(node, class_id) of all nodes with 2 to ``leaf`` classes, of nodes with the same classes one; and the crowd.

    The crowd is the class_id of all classes in first nodes that were larger; None without such.
    """
    rows = staged(_first_nodes(classes, trees), "near-nodes")
    parts: list[DataFrame] = []
    crowd = None
    for turn in range(rounds + 1):
        sizes = staged(
            rows.groupBy("node")
            .agg(
                F.count(F.lit(1)).alias("n"),
                F.sum(F.xxhash64("class_id").cast("decimal(38,0)")).alias("mark"),
                F.min("class_id").alias("pivot"),
            )
            .filter("n > 1"),
            "near-sizes",
        )
        small = sizes.filter(F.col("n") <= leaf).groupBy("n", "mark").agg(F.min("node").alias("node"))
        parts.append(rows.join(small.select("node"), "node"))
        large = sizes.filter(F.col("n") > leaf)
        if large.isEmpty():
            break
        if turn == 0:
            crowd = staged(rows.join(large.select("node"), "node").select("class_id").distinct(), "near-crowd")
        if turn == rounds:
            # what no function tells apart: blocks by hash, tied together by the node's least class
            blocks = F.ceil(F.col("n") / (leaf // 2)).cast("int")
            dealt = rows.join(large, "node").select(
                F.xxhash64("node", F.pmod(F.xxhash64("class_id", "node"), blocks)).alias("node"), "class_id"
            )
            tied = large.select("node", "pivot", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("b")).select(
                F.xxhash64("node", F.col("b").cast("bigint")).alias("node"), F.col("pivot").alias("class_id")
            )
            parts.append(dealt.unionByName(tied).distinct())
            break
        members = rows.join(large.select("node"), "node").join(classes.select("class_id", "signature"), "class_id")
        rows = staged(_branched(members, percent), "near-nodes").distinct()
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part)
    return staged(merged, "near-leaves"), crowd


def _forest(signs: np.ndarray, sizes: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Edges of a maximum spanning forest of the pairs that look similar (Prim, one row of matches at a time)."""
    cut, n = least_matches(percent), len(signs)
    best, source, outside = np.full(n, -1), np.zeros(n, np.int64), np.ones(n, bool)
    edges, now = [], 0
    for _ in range(n - 1):
        outside[now] = False
        matches = (signs == signs[now]).sum(axis=1)
        matches[100 * np.minimum(sizes, sizes[now]) < percent * np.maximum(sizes, sizes[now])] = 0
        closer = matches > best
        best[closer], source[closer] = matches[closer], now
        now = int(np.argmax(np.where(outside, best, -2)))
        if best[now] >= cut:
            edges.append((int(source[now]), now))
    return edges


def _rest(
    signs: np.ndarray, sizes: np.ndarray, parts: np.ndarray, sets: list[np.ndarray], percent: int
) -> list[tuple[int, int]]:
    """Confirmed links between parts of a node: all similar pairs across parts, likeliest first, until joined."""
    cut, n = least_matches(percent), len(signs)
    found = []
    for i in range(n - 1):
        matches = (signs[i + 1 :] == signs[i]).sum(axis=1)
        fits = 100 * np.minimum(sizes[i + 1 :], sizes[i]) >= percent * np.maximum(sizes[i + 1 :], sizes[i])
        at = np.flatnonzero((matches >= cut) & fits & (parts[i + 1 :] != parts[i]))
        found.append(np.stack([np.full(len(at), i), at + i + 1, matches[at]]))
    pairs = np.concatenate(found, axis=1)
    pairs = pairs[:, np.argsort(-pairs[2], kind="stable")]
    root = {p: p for p in parts.tolist()}

    def top(p: int) -> int:
        while root[p] != p:
            root[p] = root[root[p]]
            p = root[p]
        return p

    links = []
    for i, j in zip(pairs[0].tolist(), pairs[1].tolist()):
        a, b = top(int(parts[i])), top(int(parts[j]))
        if a != b and alike(sets[i], sets[j], percent):
            root[a] = b
            links.append((i, j))
    return links


def _by_node(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows of whole nodes, from a partition that is ordered by node; a table holds at most a batch and one node."""
    held: pa.Table | None = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rows = rows if held is None else pa.concat_tables([held, rows])
        nodes = rows.column("node").to_numpy()
        if not len(nodes):
            continue
        last = int(np.searchsorted(nodes, nodes[-1]))
        if last:
            yield rows.slice(0, last)
        held = rows.slice(last)
    if held is not None and held.num_rows:
        yield held


def _spans(nodes: np.ndarray) -> list[tuple[int, int]]:
    starts = np.flatnonzero(np.r_[True, nodes[1:] != nodes[:-1]])
    return list(zip(starts.tolist(), [*starts[1:].tolist(), len(nodes)]))


def _likely(leaves: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """(u, v): forest edges of every node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _by_node(batches):
            ids = rows.column("class_id").to_numpy()
            sizes = rows.column("n_shingles").to_numpy()
            signs = _matrix(rows.column("signature").combine_chunks())
            left, right = [], []
            for start, end in _spans(rows.column("node").to_numpy()):
                for a, b in _forest(signs[start:end], sizes[start:end], percent):
                    left.append(ids[start + a])
                    right.append(ids[start + b])
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["u", "v"])

    rows = leaves.join(classes.select("class_id", "n_shingles", "signature"), "class_id")
    return (
        rows.select("node", "class_id", "n_shingles", "signature")
        .repartition("node")
        .sortWithinPartitions("node")
        .mapInArrow(run, "u long, v long")
    )


def _sets(documents: DataFrame, classes: DataFrame, ids: DataFrame, doc_id: str, text: str, words: int) -> DataFrame:
    """(class_id, items) of the asked classes, from the text of each class's first document."""
    wanted = classes.join(ids, "class_id").select("class_id", "set_key", F.col("first_id").alias("wanted_id"))
    rows = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("binary").alias("text"))
    held = rows.join(wanted, F.col("doc_id").eqNullSafe(F.col("wanted_id"))).select("class_id", "set_key", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, items = [], []
            for class_id, key, value in zip(batch.column("class_id"), batch.column("set_key"), batch.column("text")):
                found = shingles(value.as_py(), words)
                if len(found) and set_key(found) == key.as_py():
                    ids.append(class_id.as_py())
                    items.append(found.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(items, pa.binary())], names=["class_id", "items"])

    # rows that repeat a document give its set more than once
    return held.mapInArrow(run, "class_id long, items binary").dropDuplicates(["class_id"])


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The (u, v) whose full sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [
                alike(np.frombuffer(a.as_py(), np.uint64), np.frombuffer(b.as_py(), np.uint64), percent)
                for a, b in zip(batch.column("a"), batch.column("b"))
            ]
            yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    one = sets.select(F.col("class_id").alias("u"), F.col("items").alias("a"))
    other = sets.select(F.col("class_id").alias("v"), F.col("items").alias("b"))
    return pairs.join(one, "u").join(other, "v").select("u", "v", "a", "b").mapInArrow(run, "u long, v long")


def _remaining(leaves: DataFrame, classes: DataFrame, sets: DataFrame, parts: DataFrame, percent: int) -> DataFrame:
    """Confirmed (u, v) across parts that the forests left unconnected within a node."""
    rows = leaves.join(sets.select("class_id"), "class_id", "left_semi").join(
        parts.select(F.col("id").alias("class_id"), "component"), "class_id", "left"
    ).select("node", "class_id", F.coalesce("component", "class_id").alias("part"))
    rows = staged(rows, "near-parts")
    # a node of two classes has no pair but the one that was tried
    split = (
        rows.groupBy("node")
        .agg(F.count(F.lit(1)).alias("n"), F.min("part").alias("low"), F.max("part").alias("high"))
        .filter("n > 2 and low <> high")
        .select("node")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _by_node(batches):
            ids = table.column("class_id").to_numpy()
            part = table.column("part").to_numpy()
            sizes = table.column("n_shingles").to_numpy()
            signs = _matrix(table.column("signature").combine_chunks())
            left, right = [], []
            for start, end in _spans(table.column("node").to_numpy()):
                items = [np.frombuffer(x.as_py(), np.uint64) for x in table.column("items")[start:end]]
                for a, b in _rest(signs[start:end], sizes[start:end], part[start:end], items, percent):
                    left.append(ids[start + a])
                    right.append(ids[start + b])
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["u", "v"])

    return (
        rows.join(split, "node")
        .join(classes.select("class_id", "n_shingles", "signature"), "class_id")
        .join(sets, "class_id")
        .select("node", "class_id", "part", "n_shingles", "signature", "items")
        .repartition("node")
        .sortWithinPartitions("node")
        .mapInArrow(run, "u long, v long")
    )


def _levels(sets: DataFrame) -> np.ndarray:
    """Frequency class of the shingles of ``sets`` by place of the sketch; shingles of one place count together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items = np.frombuffer(b"".join(x.as_py() for x in batch.column("items")), np.uint64)
            slots, counts = np.unique(items & np.uint64(SLOTS - 1), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(slots.astype(np.int64)), pa.array(counts)], names=["slot", "n"])

    counted = sets.select("items").mapInArrow(run, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    levels = np.zeros(SLOTS, np.uint8)
    levels[counted.column("slot").to_numpy()] = np.round(4 * np.log2(counted.column("n").to_numpy() + 1.0))
    return levels


def _prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """(token, class_id, part, size, pos, low): the rarest shingles of every set.

    ``low`` tells whether a set of the same size or a longer one may be met by the shingle.
    """
    levels = _levels(sets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens, sizes, places = [np.empty(0, np.uint64)], [], [np.empty(0, np.int64)]
            for value in batch.column("items"):
                items = np.frombuffer(value.as_py(), np.uint64)
                order = np.lexsort((items, levels[items & np.uint64(SLOTS - 1)]))
                length = len(items) - -(-percent * len(items) // 100) + 1
                tokens.append(items[order[:length]])
                places.append(np.arange(length))
                sizes.append(len(items))
            size = np.array(sizes, np.int64)
            row = np.repeat(np.arange(len(size)), [len(t) for t in tokens[1:]])
            pos = np.concatenate(places)
            low = size[row] - pos >= _least_shared(size[row], size[row], percent)
            ids, parts = (batch.column(name).take(pa.array(row, pa.int64())) for name in ("class_id", "part"))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(tokens).astype(np.int64)), ids, parts, pa.array(size[row]), pa.array(pos), pa.array(low)],
                names=["token", "class_id", "part", "size", "pos", "low"],
            )

    return sets.select("class_id", "part", "items").mapInArrow(
        run, "token long, class_id long, part long, size long, pos long, low boolean"
    )


def _least_shared(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Shingles that sets of these sizes share at least where they are similar enough."""
    return -(-percent * (a + b) // (100 + percent))


def _across(crowd: DataFrame, sets: DataFrame, parts: DataFrame, percent: int) -> DataFrame:
    """All (u, v) of ``crowd`` in different parts that may be similar, by an exact prefix join.

    A shingle's rows are dealt over cells of ``CELL`` by ``CELL`` rows; rows of its commonest part meet
    those of other parts only.
    """
    known = sets.join(crowd, "class_id").join(parts.select(F.col("id").alias("class_id"), "component"), "class_id", "left")
    rows = staged(
        _prefixes(known.select("class_id", F.coalesce("component", "class_id").alias("part"), "items"), percent),
        "near-rare",
    )
    told = (
        rows.groupBy("token", "part")
        .agg(F.count(F.lit(1)).alias("n"), F.max("low").alias("low"))
        .groupBy("token")
        .agg(
            F.sum("n").alias("n"),
            F.max("n").alias("most"),
            F.max_by("part", F.struct("n", "part")).alias("main"),
            F.max("low").alias("low"),
            F.count(F.lit(1)).alias("n_parts"),
        )
        .filter("n_parts > 1 and low")
        .select(
            "token",
            "main",
            F.ceil(F.col("n") / CELL).cast("int").alias("wide"),
            F.ceil((F.col("n") - F.col("most")) / CELL).cast("int").alias("high"),
        )
    )
    met = rows.drop("low").join(told, "token")
    row = ["class_id", "part", "size", "pos"]

    def dealt(side: DataFrame, own: str, visited: str, is_other: bool) -> DataFrame:
        home = F.pmod(F.xxhash64("class_id", "token", F.lit(is_other)), own).cast("int").alias("home")
        cells = side.select("token", *row, home, F.explode(F.sequence(F.lit(0), F.col(visited) - 1)).alias("away"))
        at = ("home", "away") if is_other else ("away", "home")
        return cells.select(F.xxhash64("token", *at).alias("node"), *row, F.lit(is_other).alias("other"))

    cells = dealt(met, "wide", "high", False).unionByName(dealt(met.filter("part <> main"), "high", "wide", True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _by_node(batches):
            ids, part, size, pos, other = (table.column(n).to_numpy() for n in ("class_id", "part", "size", "pos", "other"))
            left, right = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for start, end in _spans(table.column("node").to_numpy()):
                a = start + np.flatnonzero(other[start:end])[:, None]
                b = start + np.flatnonzero(~other[start:end])[None, :]
                reach = np.minimum(size[a] - pos[a], size[b] - pos[b])
                i, j = np.nonzero((part[a] != part[b]) & (reach >= _least_shared(size[a], size[b], percent)))
                left.append(ids[a[i, 0]])
                right.append(ids[b[0, j]])
            u, v = np.concatenate(left), np.concatenate(right)
            yield pa.RecordBatch.from_arrays([pa.array(np.maximum(u, v)), pa.array(np.minimum(u, v))], names=["u", "v"])

    return cells.repartition("node").sortWithinPartitions("node").mapInArrow(run, "u long, v long").distinct()


def groups(
    documents: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    words: int = WORDS,
    percent: int = PERCENT,
    trees: int = TREES,
    leaf: int = LEAF,
    rounds: int = ROUNDS,
) -> DataFrame:
    """Per row: doc_id, text_key (xxhash64 of the text), n_shingles, component_id, kept.

    Two documents are linked when 100 * shared shingles >= ``percent`` * all shingles of both; a group is
    what links connect, and component_id the smallest doc_id in it. Rows with an empty set (null
    or blank text) are groups of their own. Rows that repeat a document share its group and are
    all kept or all dropped; a null doc_id is the smallest of none but a group of nulls. No
    documents give no rows. Other columns are ignored.

    Links are confirmed on full sets, so none is wrong; a pair right at the threshold is missed
    in all trees with a chance of about 0.2 ** trees, however large the nodes: among the classes of
    first nodes with more than ``leaf`` classes no pair is missed.
    """
    rows = staged(_sketched(documents, doc_id, text, words), "near-sketches")
    classes = staged(
        rows.filter("n_shingles > 0")
        .groupBy("set_key")
        .agg(
            F.min("row").alias("class_id"),
            F.min("doc_id").alias("first_id"),
            F.first("n_shingles").alias("n_shingles"),
            F.first("signature").alias("signature"),
        ),
        "near-classes",
    )
    leaves, crowd = _leaves(classes, trees, percent, leaf, rounds)
    pairs = staged(
        _likely(leaves, classes, percent).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(),
        "near-pairs",
    )
    ends = pairs.select(F.col("u").alias("class_id")).unionByName(pairs.select(F.col("v").alias("class_id"))).distinct()
    asked = ends if crowd is None else ends.unionByName(crowd).distinct()
    sets = staged(_sets(documents, classes, asked, doc_id, text, words), "near-sets")
    links = staged(_confirmed(pairs, sets, percent), "near-links")
    parts = components(links)
    tried = sets if crowd is None else sets.join(ends, "class_id", "left_semi")
    more = staged(_remaining(leaves, classes, tried, parts, percent), "near-links")
    parts = components(links.unionByName(more))
    if crowd is not None:
        crossing = staged(_across(crowd, sets, parts, percent), "near-pairs")
        late = staged(_confirmed(crossing, sets, percent), "near-links")
        if not late.isEmpty():
            parts = components(links.unionByName(more).unionByName(late))
    placed = classes.join(parts.withColumnRenamed("id", "class_id"), "class_id", "left").select(
        "set_key", "first_id", F.coalesce("component", "class_id").alias("component")
    )
    heads = placed.groupBy("component").agg(F.min("first_id").alias("component_id"))
    named = placed.join(heads, "component").select("set_key", "component_id")
    told = rows.select("doc_id", "text_key", "n_shingles", "set_key").join(named, "set_key", "left")
    component_id = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return told.select("doc_id", "text_key", "n_shingles", component_id.alias("component_id")).withColumn(
        "kept", F.col("doc_id").eqNullSafe(F.col("component_id"))
    )
