"""Search by cells against exact search."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from clausewise.operators import vector_cells as cells
from clausewise.operators import vectors

TYPES = ["lease", "sales"]
KB = "id string, contract_type string, embedding array<float>"


def clustered(n, seed=5, dim=12, centres=15):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(centres, dim))
    v = middle[rng.integers(0, centres, n)] + 0.35 * rng.normal(size=(n, dim))
    return v / np.linalg.norm(v, axis=1, keepdims=True), rng


@pytest.fixture(scope="module")
def kb(spark):
    v, rng = clustered(600)
    types = rng.choice(["lease", "sales", "common", "other"], 600)
    rows = [(f"d{i}", str(t), [float(x) for x in e]) for i, (t, e) in enumerate(zip(types, v))]
    rows += [("zero", "common", [0.0] * 12), ("twin", "common", rows[0][2]), ("long", "lease", [3 * x for x in rows[5][2]])]
    return spark.createDataFrame(rows, KB).repartition(3)


@pytest.fixture(scope="module")
def index(kb):
    return cells.build(kb, 10, types=TYPES)


@pytest.fixture(scope="module")
def asked(spark, kb):
    some = kb.filter(F.pmod(F.xxhash64("id"), F.lit(12)) == 0)
    ct = F.element_at(F.array(F.lit("lease"), F.lit("sales"), F.lit(None).cast("string")), F.pmod(F.hash("id"), F.lit(3)) + 1)
    return some.select(F.col("id").alias("query_id"), ct.alias("contract_type"), "embedding")


def told(hits):
    return {(r["query_id"], r["id"], round(r["cosine"], 5), r["pos"]) for r in hits.collect()}


def test_completed_search_is_exact(spark, kb, index, asked):
    truth = told(vectors.search(asked, kb, 5, TYPES, exclude_self=True))
    assert told(cells.search(asked, index, 5, exact=True, exclude_self=True)) == truth
    assert told(cells.search(asked, index, 5, exact=True, exclude_self=True, probes=1, kb_block=7, query_block=3)) == truth
    # more hits asked for than rows
    few = asked.limit(3)
    assert told(cells.search(few, index, 900, exact=True)) == told(vectors.search(few, kb, 900, TYPES))


def test_recall_with_few_probes(spark, kb, index, asked):
    truth = vectors.search(asked, kb, 10, TYPES, exclude_self=True)
    found = cells.search(asked, index, 10, exclude_self=True)
    assert cells.recall(found, truth) >= 0.9
    assert len(index.centroids) == 24 and index.probes < 12
    assert index.lists.agg(F.sum("n")).first()[0] == kb.count()


def test_stored_index_and_extension(spark, kb, index, asked, tmp_path):
    cells.write(index, str(tmp_path / "cells"))
    stored = cells.read(spark, str(tmp_path / "cells"), TYPES)
    assert stored.probes == index.probes
    v, _ = clustered(40, seed=9)
    batch = spark.createDataFrame([(f"d{i * 3}" if i % 2 else f"n{i}", "lease", [float(x) for x in e]) for i, e in enumerate(v)], KB)
    whole = kb.join(batch.select("id"), "id", "left_anti").unionByName(batch)
    got = cells.search(asked, cells.extend(stored, batch), 5, exact=True, exclude_self=True)
    assert told(got) == told(vectors.search(asked, whole, 5, TYPES, exclude_self=True))


def test_no_rows(spark, kb, index, asked):
    empty = cells.build(kb.limit(0), 5, types=TYPES)
    assert cells.search(asked, empty, 5, exact=True).count() == 0
    assert cells.search(asked.limit(0), index, 5, exact=True).count() == 0


def test_number_of_cells():
    assert cells.cell_count(0, 0) == 1 and cells.cell_count(10_000, 64) == 100
    assert cells.cell_count(10**12, 64) == cells.MAX_CELLS
    assert cells.cell_count(10**12, 8192) == cells.CENTROID_BYTES // (4 * 8192)
