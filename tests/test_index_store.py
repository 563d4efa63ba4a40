"""The stored index after batches against a rebuild, and blocks that a search leaves out."""

import random

import pytest
from pyspark.sql import functions as F

from clausewise.operators import bm25
from clausewise.sources import index_store

TYPES = ["lease", "sales"]
KB = "id string, text string, contract_type string"
WORDS = ["the", "law", "rent", "임대인", "보증금을"] + [f"w{i}" for i in range(50)]


def corpus(seed, n, longest=40):
    rng = random.Random(seed)
    return [(f"d{i:03d}", " ".join(rng.choices(WORDS, k=rng.randint(0, longest))), rng.choice(["lease", "sales", "common", "other"])) for i in range(n)]


@pytest.fixture(scope="module")
def asked(spark):
    rng = random.Random(6)
    rows = [(f"q{i}", " ".join(rng.choices(WORDS, k=rng.randint(1, 9))), rng.choice(["lease", "sales", None])) for i in range(12)]
    return spark.createDataFrame(rows, "query_id string, text string, contract_type string")


def hits(asked, index, strategy="auto"):
    return sorted((r.query_id, r.id, round(r.score, 5), r.pos) for r in bm25.search(asked, index, 6, strategy=strategy).collect())


def same_index(index, rebuilt):
    for table, keys in (("terms", ["contract_type", "term", "df"]), ("stats", ["contract_type", "n_docs", "avgdl"]), ("postings", ["shelf", "term", "id", "dl"])):
        got, want = (sorted(map(tuple, getattr(i, table).select(*keys).collect())) for i in (index, rebuilt))
        assert got == want, table


def test_batches_equal_a_rebuild(spark, asked, tmp_path):
    path, rows = str(tmp_path / "index"), {r[0]: r for r in corpus(1, 80)}
    index_store.create(spark.createDataFrame(list(rows.values()), KB), path, TYPES)
    for seed in (2, 3):
        batch = [(i, t + " amended", c) for i, t, c in random.Random(seed).sample(corpus(seed, 80), 12)] + [(f"n{seed}", "rent law", "lease")]
        gone = [f"d{i:03d}" for i in range(seed, 80, 17)] + ["unknown"]
        for i in gone:
            rows.pop(i, None)
        rows |= {b[0]: b for b in batch}
        removed = spark.createDataFrame([(i,) for i in gone], "id string")
        assert index_store.upsert(spark, path, spark.createDataFrame(batch, KB), removed=removed, types=TYPES) == seed - 1
        index, rebuilt = index_store.read(spark, path, types=TYPES), bm25.build_index(spark.createDataFrame(list(rows.values()), KB), types=TYPES)
        same_index(index, rebuilt)
        want = hits(asked, rebuilt)
        assert hits(asked, index) == hits(asked, index, "pruned") == want
    assert index_store.compact(spark, path, TYPES) == 3
    compacted = index_store.read(spark, path, types=TYPES)
    same_index(compacted, rebuilt)
    assert hits(asked, compacted, "pruned") == want
    # a batch of which only some tables were written does not count, and may be written again
    half = spark.createDataFrame([("d000", "half", "lease")], KB)
    index_store._write(bm25.document_terms(half, None, TYPES), path, "documents", 4)
    same_index(index_store.read(spark, path, types=TYPES), rebuilt)
    index_store.upsert(spark, path, half, types=TYPES)
    rows["d000"] = ("d000", "half", "lease")
    same_index(index_store.read(spark, path, types=TYPES), bm25.build_index(spark.createDataFrame(list(rows.values()), KB), types=TYPES))


def test_vectors_follow(spark, tmp_path):
    path = str(tmp_path / "index")
    vector = "id string, embedding array<float>"
    rows = spark.createDataFrame([("a", "one", "lease"), ("b", "two", "lease"), ("c", "three", "sales")], KB)
    index_store.create(rows, path, TYPES, vectors=spark.createDataFrame([("a", [1.0]), ("b", [2.0]), ("x", [9.0])], vector))
    batch = spark.createDataFrame([("b", "new", "sales"), ("c", "new", "sales")], KB)
    index_store.upsert(spark, path, batch, types=TYPES, vectors=spark.createDataFrame([("c", [3.0]), ("a", [8.0])], vector))
    assert sorted((r.id, r.embedding[0]) for r in index_store.read_vectors(spark, path).collect()) == [("a", 1.0), ("c", 3.0)]


def test_everything_removed_and_added_again(spark, asked, tmp_path):
    path, rows = str(tmp_path / "index"), corpus(4, 20)
    kb = spark.createDataFrame(rows, KB)
    index_store.create(kb, path, TYPES)
    index_store.upsert(spark, path, kb.limit(0), removed=kb.select("id"), types=TYPES)
    assert index_store.read(spark, path, types=TYPES).postings.count() == 0
    assert hits(asked, index_store.read(spark, path, types=TYPES)) == []
    index_store.upsert(spark, path, kb, types=TYPES)
    same_index(index_store.read(spark, path, types=TYPES), bm25.build_index(kb, types=TYPES))
    # a new index over the same folder takes the place of the old one
    index_store.create(kb.limit(5), path, TYPES)
    same_index(index_store.read(spark, path, types=TYPES), bm25.build_index(kb.limit(5), types=TYPES))


def test_versions_of_one_batch(spark, tmp_path):
    path = str(tmp_path / "index")
    kb = spark.createDataFrame([("a", "old", "lease", 1)], KB + ", version int")
    index_store.create(kb, path, TYPES)
    batch = spark.createDataFrame([("a", "second", "lease", 2), ("a", "third", "sales", 3), ("a", "third", "sales", 3)], KB + ", version int")
    index_store.upsert(spark, path, batch, "version", types=TYPES)
    assert [(r.shelf, r.term) for r in index_store.read(spark, path, types=TYPES).postings.collect()] == [("sales", "third")]


def test_blocks_are_left_out(spark, asked):
    """Long documents cannot win against short ones with the same words: their blocks are not read, hits stay the same."""
    rows = corpus(7, 200, longest=6) + [(f"long{i}", " ".join([*WORDS[:4], *(f"x{i}y{j}" for j in range(300))]), "common") for i in range(60)]
    kb = spark.createDataFrame(rows, KB)
    index, plain = bm25.build_index(kb, types=TYPES, blocks=True), bm25.build_index(kb, types=TYPES)
    for strategy in ("broadcast", "pruned"):
        assert hits(asked, index, strategy) == hits(asked, plain, strategy)
    weighted = bm25._weights(index, bm25.query_terms(asked), False)
    bounds = bm25.block_bounds(index, weighted, 6)
    whole = bm25._lists(index, weighted, False).count()
    read = bm25._lists(index, bounds.filter(~F.col("optional")), False).count()
    assert bounds.agg(F.sum("n")).first()[0] == whole
    assert read < 0.7 * whole


@pytest.mark.parametrize("length,step", [(0, 0), (8, 0), (9, 1), (64, 3), (65, 4), (1024, 7), (4096, 8), (4097, 9)])
def test_steps(spark, length, step):
    assert spark.range(1).select(bm25.step_of(F.lit(length))).first()[0] == step


def test_postings_are_written_in_bounded_pieces(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(bm25, "POSTINGS_PER_TASK", 40, raising=False)
    path = str(tmp_path / "index")
    index_store.create(spark.createDataFrame(corpus(4, 80), KB), path, TYPES)
    written = spark.read.parquet(f"{path}/postings")
    pieces = [r["count"] for r in written.groupBy(F.input_file_name()).count().collect()]
    assert sum(pieces) > 1000 and max(pieces) <= 120
