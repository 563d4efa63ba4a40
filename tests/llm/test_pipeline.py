"""Quality classifier, registered queries and the pipeline."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from check import TABLES, compare
from clausewise.llm import quality_classifier
from clausewise.llm.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"
there = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="driver tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return con


@there
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    ok, note, _ = compare(spark, duck, name, *QUERIES[name], SF_DIR)
    assert ok, note


@there
def test_classifier_on_held_out_labels(spark):
    """Trained on labels of even ids, judged on those of odd ids."""
    base = "/root/testdata/sf0.01"
    documents, labels = spark.read.parquet(f"{base}/documents.parquet"), spark.read.parquet(f"{base}/labels.parquet")
    scores, _, cut = quality_classifier.resample(documents, labels.filter("doc_id % 2 = 0"))
    told = scores.join(labels.filter("doc_id % 2 = 1"), "doc_id").groupBy("quality").agg(
        F.avg((F.col("sample_key") >= cut).cast("int")).alias("kept"), F.avg("log_weight").alias("weight")
    )
    by = {r["quality"]: r for r in told.collect()}
    assert by[1]["kept"] > 0.9 and by[0]["kept"] < 0.4 and by[1]["weight"] > by[0]["weight"]


def test_classifier_edge_cases(spark, docs):
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, None), (None, 1)], "doc_id long, quality int")
    rows = [(1, "good words here"), (2, "### ###"), (3, None), (4, ""), (None, "x"), (1, "good words here")]
    scores, key, cut = quality_classifier.resample(docs(rows, True), labels, keep_share=0.5)
    got = scores.collect()
    assert len(got) == 6 and sum(r["sample_key"] >= cut for r in got) >= 3
    assert {r["doc_id"]: r["log_weight"] for r in got}[3] == 0.0
    assert docs(rows, True).filter(key >= cut).count() == sum(r["sample_key"] >= cut for r in got)
    scores, _, cut = quality_classifier.resample(docs([]), labels)
    assert cut is None and scores.count() == 0
    scores, _, cut = quality_classifier.resample(docs(rows), labels.filter("false"))
    assert all(r["sample_key"] >= cut and r["log_weight"] == 0 for r in scores.collect())


@pytest.mark.parametrize("ranked", [3, 50_000])
def test_kth_largest(spark, monkeypatch, ranked):
    monkeypatch.setattr(quality_classifier, "RANKED_ROWS", ranked)
    values = [float(i * i % 97) for i in range(200)] + [1e6, -1e6]
    rows = spark.createDataFrame([(v,) for v in values], "v double")
    for k in (1, 2, 50, 202, 500):
        assert quality_classifier.kth_largest(rows, "v", k) == sorted(values, reverse=True)[min(k, 202) - 1]
    assert quality_classifier.kth_largest(rows, "v", 0) is None


@there
def test_stages_keep_columns_and_take_effect(spark):
    documents = spark.read.parquet(f"{SF_DIR}/documents.parquet").withColumn("n_removed", F.lit(1)).withColumn("row", F.lit("x"))
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    now, before = documents, documents.count()
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = corpus_pipeline.staged(stage(spark, now, SF_DIR), "test")
        assert now.columns == documents.columns
        assert 0 < now.count() <= before
        before = now.count()
    # nothing that a stage removes is left for it
    from clausewise.llm import decontaminate, near_dedup

    assert near_dedup.groups(now).filter("not kept").count() == 0
    bench = spark.read.parquet(f"{SF_DIR}/benchmark.parquet")
    assert decontaminate.contamination(now, bench).filter("size(hits) > 0").count() == 0
    packed = corpus_pipeline.STAGES[-1][1](spark, now, SF_DIR)
    assert packed.select("doc_id").distinct().count() == now.filter("text <> ''").count()


@there
def test_stages_on_no_documents(spark):
    now = spark.read.parquet(f"{SF_DIR}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        now = corpus_pipeline.staged(stage(spark, now, SF_DIR), "test")
        assert now.count() == 0


@there
def test_stages_equal_a_plain_version(spark):
    """All stages after the classifier, on its result, against loops in plain Python."""
    from test_duplicates import WORD, plain_contamination, plain_groups, plain_removals

    documents = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    now = corpus_pipeline.staged(stages["quality classifier"](spark, documents, SF_DIR), "test")
    rows = [(r["doc_id"], r["text"]) for r in now.collect()]
    gone = plain_removals(rows)
    plain = {}
    for i, text in rows:
        left = "\n".join(x for n, x in enumerate(text.split("\n")) if n not in gone.get(i, []))
        if i not in gone or any(WORD.findall(x) for x in left.split("\n")):
            plain[i] = left
    now = corpus_pipeline.staged(stages["line dedup"](spark, now, SF_DIR), "test")
    assert {r["doc_id"]: r["text"] for r in now.collect()} == plain
    kept = {i for i, _, component in plain_groups(list(plain.items()), 5) if i == component}
    now = corpus_pipeline.staged(stages["MinHash near-dedup"](spark, now, SF_DIR), "test")
    assert {r["doc_id"] for r in now.collect()} == kept
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
    clean = {r[0] for r in plain_contamination([(i, plain[i]) for i in sorted(kept)], items) if r[2] == 0}
    now = corpus_pipeline.staged(stages["benchmark decontamination"](spark, now, SF_DIR), "test")
    assert {r["doc_id"] for r in now.collect()} == clean
