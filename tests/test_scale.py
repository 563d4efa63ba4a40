"""Work that must be dealt over more tasks, or done once, as tables grow."""

import glob
import re

import pytest
from pyspark.sql import functions as F

from clausewise.llm import warc
from clausewise.operators import expansion, rules
from clausewise.plans import kb_build
from clausewise.session import spread
from clausewise.sources import stores
from queries import base, clause_queries, kb_queries, review_queries, search_queries, source_queries

ORDERS = "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double"
PARTS = "p_partkey long, p_name string, p_brand string, p_type string"
SUPPLIERS = "s_suppkey long, s_name string, s_nationkey int"


@pytest.fixture
def tables(spark, tmp_path, monkeypatch):
    """A folder of small one-split tables; no task is to take more than five rows."""
    orders = [(i, i % 7, "FOP"[i % 3], 1000.0 + i) for i in range(1, 41)]
    parts = [(i, f"red{'ab'[i % 2]} {i}", f"Brand#{i % 5}", "TIN") for i in range(1, 41)]
    suppliers = [(i, f"Supplier {i}", i % 25) for i in range(40)]
    for name, rows, schema in (("orders", orders, ORDERS), ("part", parts, PARTS), ("supplier", suppliers, SUPPLIERS)):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    for module in (base, review_queries, search_queries, source_queries):
        monkeypatch.setattr(module, "ROWS_PER_TASK", 5, raising=False)
    return str(tmp_path)


def test_spread_by_rows(spark):
    cores = spark.sparkContext.defaultParallelism
    assert spread(spark.range(0, 100, 1, 1), 10).rdd.getNumPartitions() == 10
    assert spread(spark.range(0, 100, 1, 1), 1000).rdd.getNumPartitions() == cores
    wide = spark.range(0, 100, 1, 32)
    assert spread(wide, 10) is wide


def test_tasks_of_contracts_and_parts_do_not_grow_with_the_table(spark, tables):
    assert base.contracts(spark, tables, typed=True).rdd.getNumPartitions() == 8
    assert source_queries.statutes(spark, tables).rdd.getNumPartitions() == 8
    assert source_queries.front_matter(spark, tables).rdd.getNumPartitions() == 8


def test_words_are_cut_once_each(spark, tables):
    found = {(r.word, r.stem): r.n for r in search_queries.strip_particle(spark, tables).collect()}
    assert found[("reda는", "reda")] == found[("redb는", "redb")] == 20
    plan = search_queries.strip_particle(spark, tables)._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"Aggregate \[word#\d+\], ", plan)  # counted by word alone


def test_labelled_files_lie_in_two_folders(spark, tables, monkeypatch):
    places = []
    collect = kb_build.collect_sources
    monkeypatch.setattr(kb_build, "collect_sources", lambda session, labelled: places.append(labelled) or collect(session, labelled=labelled))
    counted = {r.contract_type: r.n for r in kb_queries.labelled_counts(spark, tables).collect()}
    civil = [i % 25 % 3 for i in range(0, 40, 2)]
    assert counted == {"lease": 2 * civil.count(0), "sales": 2 * civil.count(1)}
    assert len(glob.glob(f"{places[0]}/*/")) == 2
    assert len(glob.glob(f"{places[0]}/*/*.json")) == 40


def _largest_method(df):
    told = df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "codegen")
    return max(map(int, re.findall(r"maxMethodCodeSize:(\d+)", told)))


def test_rules_stay_out_of_generated_methods(spark, tables):
    """The JVM compiles no method of more than 8,000 bytes."""
    ruled = rules.apply_rules(clause_queries.split(spark, tables))
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert _largest_method(ruled.select("document_id", "safe_reason", "high_reason")) < 8000
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)


def test_items_and_extra_words_are_looked_for_once(spark):
    clauses = spark.createDataFrame(
        [(1, "제1조", "수선 ① 하나 ② 둘", "lease"), (2, "제2조", "보증금을 반환한다", "lease"), (3, None, None, None)],
        "document_id int, title string, content string, contract_type string",
    )
    asked = expansion.clause_queries(clauses, ["document_id"])
    assert [r.text for r in asked.filter("document_id = 1").orderBy("item_pos").collect()] == ["수선", "하나", "둘"]
    assert [r.text for r in asked.filter("document_id = 3").collect()] == [None]
    plan = asked._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("size(regexp_extract_all(") == 2


def test_payloads_are_digested_once(spark):
    pages = spark.createDataFrame([(b"abc",), (None,)], "payload binary").select(warc.base32_sha1(F.col("payload")).alias("d"))
    # RFC 4648 letters of the SHA-1 of "abc"
    assert [r.d for r in pages.collect()] == ["VGMT4NSHA2AWVOR6EVYXQUGCNSONBWE5", None]
    plan = pages._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("sha1(") == 1 and plan.index("array(sha1(") > 0


def test_any_number_of_analyses_is_looked_up(spark, tmp_path):
    place = str(tmp_path / "store")
    rows = spark.range(1, 2001).withColumnRenamed("id", "document_id")
    stores.write_analyses(rows.withColumn("verdict", F.lit("first")), place, "1", shards=4)
    stores.write_analyses(rows.filter("document_id % 2 = 0").withColumn("verdict", F.lit("second")), place, "2", shards=4)
    asked = rows.filter("document_id % 3 = 0").unionByName(rows.filter("document_id = 3"))
    found = stores.lookup_analyses(spark, place, asked, shards=4)
    assert {r.document_id: r.verdict for r in found.collect()} == {i: "second" if i % 2 == 0 else "first" for i in range(3, 2001, 3)}
    assert found.count() == len(range(3, 2001, 3))


def test_tables_as_long_as_the_clauses_are_not_sent_to_the_driver(spark, tables):
    requests = clause_queries.model_requests(spark, tables)
    assert "Broadcast" not in requests._jdf.queryExecution().executedPlan().toString()
    attached = review_queries.attach_references(spark, tables)
    assert "Broadcast" not in attached._jdf.queryExecution().executedPlan().toString()


def test_only_the_answered_clause_is_judged(spark, tables):
    plan = review_queries.fold_responses(spark, tables)._jdf.queryExecution().optimizedPlan().toString()
    rules_at, filter_at = plan.index("_rules"), [m.start() for m in re.finditer(r"Filter \(+\w*clause_pos#\d+ = 2|Filter .*\+ 1\) = 2", plan)]
    assert filter_at and max(filter_at) > rules_at
