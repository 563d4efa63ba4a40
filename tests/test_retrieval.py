"""Retrieval against plain loops."""

import math
import random
import re
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from clausewise import fixed_values as fv
from clausewise.operators import bm25, fusion, vectors
from clausewise.operators.expansion import clause_queries, expanded_query
from clausewise.operators.skew import hot_keys, salted_join, top_n
from clausewise.plans.retrieval import clause_retrieval, hybrid_search

TYPES = ["lease", "sales"]
WORDS = ["the", "law", "rent", "임대인", "보증금을", "해지는"] + [f"w{i}" for i in range(60)]


def make_corpus(n=120, seed=1):
    rng = random.Random(seed)
    kb = []
    for i in range(n):
        words = [w for w in WORDS[:6] if rng.random() < 0.7] + rng.choices(WORDS, k=rng.randint(0, 30))
        kb.append((f"d{i:03d}", " ".join(words), rng.choice(["lease", "lease", "sales", "common", "other"])))
    asked = [(f"q{i}", " ".join(rng.choices(WORDS, k=rng.randint(1, 12))), rng.choice(["lease", "sales", None])) for i in range(15)]
    return kb, asked


def tokens(text):
    out = set()
    for w in re.findall("[가-힣a-zA-Z0-9]+", text):
        if len(w) < 2:
            continue
        out.add(w)
        for p in sorted(fv.PARTICLES, key=len, reverse=True):
            if w.endswith(p) and len(w) > len(p) + 1:
                out.add(w[: -len(p)])
                break
    return out


def loop_bm25(kb, asked, k):
    found = set()
    for name, text, ct in asked:
        docs = [(i, tokens(t)) for i, t, c in kb if ct is None or c in (ct, "common")]
        n, avg = len(docs), sum(len(t) for _, t in docs) / len(docs)
        df = {}
        for _, ts in docs:
            for t in ts:
                df[t] = df.get(t, 0) + 1
        idf = {t: math.log(n - d + 0.5) - math.log(d + 0.5) for t, d in df.items()}
        floor = 0.25 * sum(idf.values()) / len(idf)
        idf = {t: v if v >= 0 else floor for t, v in idf.items()}
        scores = []
        for i, ts in docs:
            s = sum(idf[t] * 2.5 / (1 + 1.5 * (0.25 + 0.75 * len(ts) / avg)) for t in tokens(text) & ts)
            if round(s, 6) > 0:
                scores.append((-round(s, 6), i))
        for pos, (s, i) in enumerate(sorted(scores)[:k], 1):
            found.add((name, i, round(-s, 5), pos))
    return found


@pytest.fixture(scope="module")
def corpus(spark):
    kb, asked = make_corpus()
    kb_df = spark.createDataFrame(kb, "id string, text string, contract_type string").repartition(3)
    asked_df = spark.createDataFrame(asked, "query_id string, text string, contract_type string")
    return kb, asked, kb_df, asked_df, bm25.build_index(kb_df, types=TYPES, blocks=True)


@pytest.mark.parametrize("strategy", ["auto", "broadcast", "pruned"])
def test_bm25_equals_a_loop(spark, corpus, strategy):
    kb, asked, _, asked_df, index = corpus
    rows = bm25.search(asked_df, index, 5, strategy=strategy).collect()
    assert {(r.query_id, r.id, round(r.score, 5), r.pos) for r in rows} == loop_bm25(kb, asked, 5)


def test_pruned_search_without_bounds(spark, corpus):
    kb, asked, kb_df, asked_df, _ = corpus
    rows = bm25.search(asked_df, bm25.build_index(kb_df, types=TYPES), 5, strategy="pruned").collect()
    assert {(r.query_id, r.id, round(r.score, 5), r.pos) for r in rows} == loop_bm25(kb, asked, 5)


def plan(df):
    return df._jdf.queryExecution().toString()


def test_scores_are_added_up_where_a_document_lies(spark, corpus, monkeypatch):
    kb, asked, kb_df, asked_df, _ = corpus
    monkeypatch.setattr(bm25, "MATCHES_PER_TASK", 40, raising=False)
    found = bm25.search(asked_df, bm25.build_index(kb_df, types=TYPES), 5)
    # a task holds the scores of its documents, not those of a common term in all of them
    assert not re.search(r"hashpartitioning\(query_id#\d+, id#\d+", plan(found))
    tasks = [int(n) for n in re.findall(r"hashpartitioning\(id#\d+, (\d+)\)", plan(found))]
    assert tasks and min(tasks) > spark.sparkContext.defaultParallelism
    assert {(r.query_id, r.id, round(r.score, 5), r.pos) for r in found.collect()} == loop_bm25(kb, asked, 5)


@pytest.mark.parametrize("strategy", ["broadcast", "pruned"])
def test_candidates_are_completed_from_their_documents(spark, corpus, strategy, monkeypatch):
    kb, asked, _, asked_df, index = corpus
    rows = bm25.search(asked_df, replace(index, postings=None), 5, strategy=strategy).collect()
    assert {(r.query_id, r.id, round(r.score, 5), r.pos) for r in rows} == loop_bm25(kb, asked, 5)
    # without documents, and with more candidates than are sent to every task
    rows = bm25.search(asked_df, replace(index, docs=None), 5, strategy=strategy).collect()
    assert {(r.query_id, r.id, round(r.score, 5), r.pos) for r in rows} == loop_bm25(kb, asked, 5)
    monkeypatch.setattr(bm25, "BROADCAST_ROWS", 3)
    rows = bm25.search(asked_df, index, 5, strategy=strategy).collect()
    assert {(r.query_id, r.id, round(r.score, 5), r.pos) for r in rows} == loop_bm25(kb, asked, 5)


def test_repeated_rows_count_as_often_whichever_way_candidates_are_completed(spark, corpus):
    _, _, kb_df, asked_df, _ = corpus
    index = bm25.build_index(kb_df.unionByName(kb_df.filter("id < 'd040'")), types=TYPES, blocks=True)
    twice = asked_df.unionByName(asked_df.filter("query_id < 'q12'")).unionByName(
        asked_df.filter("query_id = 'q1'").withColumn("contract_type", F.lit("sales"))
    )
    both = [
        sorted((r.query_id, r.id, round(r.score, 5), r.pos) for r in bm25.search(twice, i, 5).collect())
        for i in (index, replace(index, docs=None))
    ]
    assert both[0] == both[1]


def test_frequencies_are_counted_once(spark, corpus):
    _, _, kb_df, _, _ = corpus
    assert "Generate" not in plan(bm25.build_index(kb_df, types=TYPES).terms)


def test_bm25_batch_equals_single(spark, corpus):
    _, asked, _, asked_df, index = corpus
    batch = {(r.query_id, r.id, r.pos) for r in bm25.search(asked_df, index, 3).collect()}
    name = asked[0][0]
    alone = bm25.search(asked_df.filter(F.col("query_id") == name), index, 3).collect()
    assert {(r.query_id, r.id, r.pos) for r in alone} == {b for b in batch if b[0] == name}


def test_query_without_tokens_or_type(spark, corpus):
    index = corpus[4]
    asked = spark.createDataFrame([("a", "! ?", "lease"), ("b", "law", "loan")], "query_id string, text string, contract_type string")
    assert bm25.search(asked, index, 3).count() == 0


@pytest.mark.parametrize("blocks", [(16_384, 4_096), (7, 3)])
def test_vectors_equal_a_loop(spark, blocks):
    rng = np.random.default_rng(3)
    unit = lambda n: [v / np.linalg.norm(v) for v in rng.normal(size=(n, 6))]
    kb = [(f"d{i}", t, [float(x) for x in v]) for i, (t, v) in enumerate(zip(rng.choice(["lease", "sales", "common"], 40), unit(40)))]
    kb = [(i, str(t), v) for i, t, v in kb] + [("e1", "common", kb[0][2])]  # an exact tie
    asked = [(f"q{i}", t, [float(x) for x in v]) for i, (t, v) in enumerate(zip(["lease", None, "sales", "loan"], unit(4)))]
    asked.append(("d0", None, kb[0][2]))
    schema = "contract_type string, embedding array<float>"
    got = vectors.search(
        spark.createDataFrame(asked, "query_id string, " + schema), spark.createDataFrame(kb, "id string, " + schema),
        4, TYPES, exclude_self=True, kb_block=blocks[0], query_block=blocks[1],
    ).collect()
    want = set()
    f32 = lambda v: np.asarray(v, dtype=np.float32).astype(float)
    for name, ct, v in asked:
        seen = [(-round(float(f32(v) @ f32(e)), 6), i) for i, t, e in kb if i != name and (ct is None or t in (ct, "common"))]
        want |= {(name, i, p) for p, (_, i) in enumerate(sorted(seen)[:4], 1)}
    assert {(r.query_id, r.id, r.pos) for r in got} == want


def loop_select(rows, k):
    """rows: (id, category, score, key)"""
    best = sorted(rows, key=lambda r: (r[2], r[0]), reverse=True)
    keys, chosen = set(), []
    for cat, quota in fv.CATEGORY_QUOTA:
        for r in best:
            if quota and r[1] == cat and r[3] not in keys:
                keys.add(r[3])
                chosen.append(r)
                quota -= 1
    for r in best:
        if len(chosen) < k and r not in chosen and r[3] not in keys:
            keys.add(r[3])
            chosen.append(r)
    order = sorted(chosen, key=lambda r: (fv.CATEGORY_ORDER[r[1]], -r[2], r[0]))
    return [r[0] for r in order][:k]


@pytest.mark.parametrize("partitions", [1, 7])
def test_quota_selection_equals_a_loop(spark, partitions):
    rng = random.Random(5)
    rows, want = [], {}
    for q in range(150):
        pool = [
            (f"i{j:02d}", rng.choice(["law", "judgment", "clause", "other"][: rng.randint(1, 4)]), rng.randint(1, 6) / 10, f"k{rng.randint(0, 9)}")
            for j in range(rng.randint(1, 25))
        ]
        want[f"q{q}"] = loop_select(pool, 5)
        rows += [(f"q{q}", i, "s", c, 0.5, s, key) for i, c, s, key in pool]
    hits = spark.createDataFrame(rows, "query_id string, id string, source string, category string, similarity double, rrf_score double, dedup_key string")
    got = {}
    for r in fusion.select_by_quota(hits.repartition(partitions), 5).orderBy("query_id", "pos").collect():
        got.setdefault(r.query_id, []).append(r.id)
    assert got == want


def test_fusion_of_one_sided_lists(spark):
    hit = "query_id string, id string, similarity double, pos int"
    near = spark.createDataFrame([("q", "a", 0.9, 1), ("q", "b", 0.8, 2)], hit)
    words = spark.createDataFrame([("q", "b", 0.3, 1)], hit)
    none = words.filter("false")
    got = {r.id: (round(r.rrf, 6), r.similarity) for r in fusion.combine(near, words).collect()}
    assert got == {"a": (round(1 / 61, 6), 0.9), "b": (round(1 / 62 + 1 / 61, 6), 0.8)}
    kb = spark.createDataFrame([("a", "law", "x"), ("b", "실무", "y")], "id string, source string, text string")
    assert [(r.id, r.category, r.rrf_score) for r in fusion.fuse(near, none, kb).orderBy("pos").collect()] == [
        ("a", "law", round(3 / 61, 6)), ("b", "clause", round(0.6 / 62, 6)),
    ]
    assert fusion.fuse(none, none, kb).count() == 0


def test_hybrid_without_vectors_and_small_k(spark, corpus):
    _, _, kb_df, asked_df, index = corpus
    kb = kb_df.withColumn("source", F.lit("law"))
    hits = hybrid_search(asked_df, None, kb, None, index, k=2)
    assert hits.groupBy("query_id").count().agg(F.max("count")).first()[0] == 2


def test_clause_queries_and_merge(spark, corpus):
    long = "가" * 120
    rows = [(1, 1, "lease", "제1조", "청소비와 관리비, 해지"), (1, 2, "lease", "제2조", long + "청소비"), (1, 3, "lease", "특약사항 1", long + "청소비"),
            (1, 4, "lease", "제4조", "제4조 ①law ②rent w1"), (1, 5, "none", "x", "청소비")]
    clauses = spark.createDataFrame(rows, "document_id int, clause_pos int, contract_type string, title string, content string")
    asked = clause_queries(clauses, ["document_id", "clause_pos"]).collect()
    assert [r.item_pos for r in asked if r.clause_pos == 4] == [0, 1, 2]
    texts = {r.clause_pos: r.text for r in asked if r.clause_pos != 4}
    assert texts[1] == "청소비와 관리비, 해지\n[검색키워드] " + " ".join(
        e for _, t, e in fv.QUERY_EXPANSIONS if t in ("청소비", "관리비") or e == "차임연체 해지 주임법 제6조의2 민법 제640조")
    assert texts[2] == long + "청소비" and "[검색키워드]" in texts[3] and texts[5] == "청소비"
    same = spark.createDataFrame([("t", "전대 양도", "lease")], "t string, b string, c string")
    assert same.select(expanded_query(F.col("t"), F.col("b"), F.col("c"))).first()[0].count("제629조") == 1
    kb = corpus[2].withColumn("source", F.lit("law"))
    merged = clause_retrieval(clauses.filter("clause_pos = 4"), ["document_id", "clause_pos"], kb, corpus[4]).collect()
    assert len({r.id for r in merged}) == len(merged)
    assert [r.merged_pos for r in sorted(merged, key=lambda r: (r.item_pos, r.pos))] == list(range(1, len(merged) + 1))


def test_salted_join_and_top_n(spark):
    big = spark.createDataFrame([("hot", i) for i in range(300)] + [(f"k{i}", i) for i in range(50)], "k string, v int")
    small = spark.createDataFrame([("hot", "a"), ("hot", "b"), ("k1", "c")], "k string, w string")
    hot = hot_keys(big.groupBy("k").agg(F.count("*").alias("n")), ["k"], "n", max_hot=10)
    assert [(r.k, r._salts) for r in hot.collect()] == [("hot", 9)]
    got = salted_join(big, small, ["k"], hot, ["v"])
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, big.join(small, "k").collect()))
    for n in (3, 1500):
        best = top_n(big, ["k"], [F.desc("v")], n).filter("k = 'hot'").orderBy("pos").collect()
        assert [r.v for r in best] == list(range(299, 299 - min(n, 300), -1))
