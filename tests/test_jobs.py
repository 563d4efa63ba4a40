"""Sources, build, review, stores and streams end to end on a generated directory."""

import json
import os
import re

import pytest
from pyspark.sql import functions as F

from clausewise.operators import bm25, dedup
from clausewise.operators.dedup import dedup_corpus
from clausewise.operators.vectors import as_batches
from clausewise.plans import accuracy, kb_build, review
from clausewise.sources import contracts as door
from clausewise.sources import index_store, kb_files, stores
from clausewise.streaming import flows

BODY = "이 법은 임대차에 관하여 필요한 사항을 정함을 목적으로 한다. 임차인의 보증금을 보호하며 당사자의 권리를 정하는 조문의 예시 본문이다."


def put(root, name, text):
    path = os.path.join(root, name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text if isinstance(text, str) else json.dumps(text, ensure_ascii=False))


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    root = str(tmp_path_factory.mktemp("sources"))
    put(root, "seeds/seed.jsonl", json.dumps({"id": "s1", "text": "민법 제629조: " + BODY, "contract_type": "lease", "source": "민법", "article": "제629조", "topic": "전대"}, ensure_ascii=False))
    labelled = os.path.join(root, "labelled")
    put(labelled, "약관/표준임대차+1.json", {"clauseArticle": ["  임차인은 보증금을 지급한다. ", "짧다", ""], "illdcssBasiss": ["근거 하나", "근거 둘"], "relateLaword": "민법", "dvAntageous": 2})
    put(labelled, "약관/매매계약.json", {"clauseArticle": "매도인은 소유권을 이전하여야 한다.", "dvAntageous": "1"})
    put(labelled, "약관/기타.json", {"clauseArticle": "대상이 아닌 파일의 조항입니다."})
    put(labelled, "약관/임대차_깨짐.json", '{"clauseArticle": ["열린')
    put(labelled, "판결문/민사/a.json", {"info": {"caseNm": "보증금반환", "caseNo": "2020가1", "courtNm": "법원", "relateLaword": ["민법 제1조", "상법"]}, "facts": {"f": ["사실 하나", "사실 둘"], "g": "무시"}, "dcss": {"d": ["가" * 1600]}})
    put(labelled, "판결문/민사/b.json", {"info": {"caseNm": "매매대금"}, "facts": "사실", "dcss": {}})
    put(labelled, "판결문/민사/c.json", {"info": {"caseNm": "기타"}, "facts": "무관", "dcss": "무관"})
    put(labelled, "판결문/형사/d.json", {"info": {"caseNm": "보증금"}, "facts": "사실", "dcss": "판단"})
    act = f"---\n상태: 시행\n시행일자: 2024-01-01\n---\n##### 제3조 (대항력)\n{BODY}\n\n\n\n끝\n##### 제4조의2 (짧음)\n짧다\n##### 제620조 (범위)\n{BODY}\n"
    put(root, "laws/주택임대차보호법/법률.md", act)
    put(root, "laws/주택임대차보호법/시행령.md", act.replace("시행\n시행", "폐지\n시행"))
    put(root, "laws/민법/법률.md", act)
    put(root, "laws/약관의규제에관한법률/법률.md", act)
    put(root, "laws/없는법/법률.md", act)
    for i in range(4):
        put(root, f"precedents/민사/{i}.md", f"---\n사건명: 사건{i}\n사건번호: 2020다{i}\n법원명: 대법원\n선고일자: 2020-01-0{i + 1}\n---\n## 판시사항\n임대차 보증금 {i} 반환과 임차인의 차임 지급 의무에 관한 판시사항 예시입니다.\n## 판결요지\n요지 {i} 임대인\n## 참조조문\n민법 제1조\n")
    put(root, "precedents/형사/9.md", "---\n사건명: x\n---\n## 판시사항\n임대차 보증금 임차인 임대인 차임에 관한 충분히 긴 판시사항 예시입니다 네네 정말로\n")
    put(root, "precedents/민사/short.md", "---\n사건명: x\n---\n## 판시사항\n임대차 임차인\n")
    return root


def test_clause_files(spark, files):
    rows = {r.article_idx: r for r in kb_files.read_clauses(spark, f"{files}/labelled").filter("contract_type = 'lease'").collect()}
    assert list(rows) == [0]
    assert rows[0].text == "[약관-불리] 임차인은 보증금을 지급한다.\n판단근거: 근거 하나\n근거 둘\n관련법령: 민법"
    assert rows[0].filename == "표준임대차+1.json" and rows[0].topic == "임대차_약관"
    sales = kb_files.read_clauses(spark, f"{files}/labelled").filter("contract_type = 'sales'").collect()
    assert [(r.advantage, r.text) for r in sales] == [("유리", "[약관-유리] 매도인은 소유권을 이전하여야 한다.")]


def test_judgment_files(spark, files):
    rows = kb_files.read_judgments(spark, f"{files}/labelled").orderBy("contract_type", "src_pos").collect()
    assert [(r.contract_type, r.section, r.chunk_idx) for r in rows] == [("lease", "판단", 0), ("lease", "판단", 1), ("lease", "기초사실", 0), ("sales", "기초사실", 0)]
    assert rows[1].text == "[판결문] 법원 2020가1 - 보증금반환\n판단: " + "가" * 250 + "\n관련법령: 민법 제1조 상법"
    assert rows[2].text.endswith("기초사실: 사실 하나\n사실 둘\n관련법령: 민법 제1조 상법")
    assert rows[3].text == "[판결문]   - 매매대금\n기초사실: 사실"


def test_law_files(spark, files):
    rows = kb_files.read_laws(spark, f"{files}/laws").collect()
    got = sorted((r.law_name, r.contract_type, r.article_no) for r in rows)
    shared = [("약관의규제에관한법률", ct, n) for ct in ("employment", "lease", "loan", "sales", "service") for n in (3, 620)]
    assert got == sorted([("민법", "lease", 620), ("주택임대차보호법", "lease", 3), ("주택임대차보호법", "lease", 620), *shared])
    text = next(r.text for r in rows if r.law_name == "주택임대차보호법" and r.article_no == 3)
    assert text == f"[법률] 주택임대차보호법 제3조 (대항력)\n{BODY}\n\n끝"


def test_precedents_and_cap(spark, files):
    rows = kb_files.read_precedents(spark, f"{files}/precedents", 0).orderBy("src_path").collect()
    assert len(rows) == 4 and {r.contract_type for r in rows} == {"lease"}
    assert rows[0].text.startswith("[판례] 대법원 2020다0 (2020-01-01) - 사건0\n판시사항: 임대차 보증금 0")
    assert rows[0].text.endswith("\n참조조문: 민법 제1조")
    capped = kb_files.read_precedents(spark, f"{files}/precedents", 2).collect()
    assert sorted(r.case_no for r in capped) == ["2020다0", "2020다1"]


@pytest.fixture(scope="module")
def built(spark, files, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("kb"))
    args = dict(seeds=f"{files}/seeds", labelled=f"{files}/labelled", laws=f"{files}/laws", precedents=f"{files}/precedents")
    kb_build.build(spark, out, **args)
    return out, args


def test_build_and_dedup_scopes(spark, built):
    out, args = built
    kb = spark.read.parquet(f"{out}/kb")
    united = kb_build.collect_sources(spark, **args)
    assert united.count() == 1 + 2 + 4 + 13 + 4
    # equal bodies of different statutes collapse to the first one in a global pass
    laws = kb.filter("source = 'law'")
    assert laws.count() == 2
    per_type = dedup_corpus(kb_build.placed(united), kb_build.ORDER, scope="per_type").filter("source = 'law'")
    assert per_type.groupBy("contract_type").count().count() == 5
    assert kb.select("id").distinct().count() == kb.count()


def test_index_is_stored_and_pruned(spark, built):
    out, _ = built
    kb = spark.read.parquet(f"{out}/kb")
    asked = spark.createDataFrame([("q", "임차인의 보증금 반환", "lease")], "query_id string, text string, contract_type string")
    stored = index_store.read(spark, f"{out}/index", ["lease"])
    fresh = bm25.build_index(kb)
    want = {(r.id, r.score) for r in bm25.search(asked, fresh, 5).collect()}
    assert want and {(r.id, r.score) for r in bm25.search(asked, stored, 5).collect()} == want
    assert index_store.read(spark, f"{out}/index", ["none"]).postings.count() == 0
    plan = stored.postings._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: .*shelf#\d+ IN", plan)
    # the asked terms reach the scan of the sorted postings
    plan = bm25.search(asked, stored, 5)._jdf.queryExecution().executedPlan().toString()
    assert "In(term, [" in plan


def test_kb_upsert(spark, built, tmp_path):
    out, _ = built
    path = str(tmp_path / "kb")
    stores.write_kb(spark.read.parquet(f"{out}/kb"), path)
    before = spark.read.parquet(path).count()
    old = spark.read.parquet(path).filter("contract_type = 'lease'").limit(1)
    batch = old.withColumn("text", F.lit("새 글")).unionByName(old.withColumn("id", F.lit("brand-new")))
    stores.upsert_kb(spark, path, batch)
    after = spark.read.parquet(path)
    assert after.count() == before + 1 and after.filter("text = '새 글'").count() == 1
    # an id that moves to another type leaves its old one
    moved = after.filter("text = '새 글'").withColumn("contract_type", F.lit("sales"))
    stores.upsert_kb(spark, path, moved)
    assert [r.contract_type for r in spark.read.parquet(path).filter("text = '새 글'").collect()] == ["sales"]
    assert spark.read.parquet(path).count() == before + 1
    # of two versions in one batch the higher stays; a type that loses its last row is gone
    alone = spark.createDataFrame([("x", "only", 1, "a"), ("x", "only", 2, "b")], "id string, contract_type string, version int, text string")
    stores.write_kb(alone.limit(0), str(tmp_path / "v"))
    stores.write_kb(stores.newest(alone, "version"), str(tmp_path / "v"))
    stores.upsert_kb(spark, str(tmp_path / "v"), alone.withColumn("contract_type", F.lit("other")).withColumn("version", F.col("version") + 5), "version")
    assert [(r.contract_type, r.version, r.text) for r in spark.read.parquet(str(tmp_path / "v")).collect()] == [("other", 7, "b")]


def test_index_and_vectors_follow_the_kb(spark, files, tmp_path):
    out = str(tmp_path / "kb")
    kb_build.build(spark, out, seeds=f"{files}/seeds", labelled=f"{files}/labelled", vectoriser=lambda texts: [[float(len(t))] for t in texts])
    old = spark.read.parquet(f"{out}/kb").filter("contract_type = 'lease'").limit(1)
    batch = old.withColumn("text", F.lit("보증금 새글")).unionByName(old.withColumn("id", F.lit("brand-new")))
    kb = kb_build.upsert(spark, out, batch, vectoriser=lambda texts: [[float(len(t))] for t in texts])
    index = index_store.read(spark, f"{out}/index")
    want = bm25.build_index(kb)
    assert sorted(map(tuple, index.postings.collect())) == sorted(map(tuple, want.postings.select(index.postings.columns).collect()))
    assert {(r.id, r.embedding[0]) for r in index_store.read_vectors(spark, f"{out}/index").collect()} == {(r.id, float(len(r.text))) for r in kb.collect()}


def test_vectors_are_stored_and_searched(spark, built, tmp_path):
    """The caller's vectoriser is run over the KB and over clause items; review then uses both retrievers."""

    def letter_vectors(texts):
        import numpy as np

        out = np.array([[1.0 + t.count(c) for c in "가임차권"] for t in texts])
        return out / np.linalg.norm(out, axis=1, keepdims=True)

    out, _ = built
    kb = spark.read.parquet(f"{out}/kb")
    vectors = kb.select("id", "text").mapInPandas(as_batches(letter_vectors), "id string, embedding array<float>")
    done = review.prepare(
        lease_contracts(spark), kb, index_store.read(spark, f"{out}/index"), kb_vectors=vectors, vectoriser=letter_vectors
    )
    plain = review.prepare(lease_contracts(spark), kb, index_store.read(spark, f"{out}/index"))
    assert done.hits.select("id").distinct().count() >= plain.hits.select("id").distinct().count() > 0


def test_evaluation_counts_every_item(spark):
    items = spark.createDataFrame(
        [(f"d{i}", 1, "아무 말이나 적은 조항", "risky", "lease") for i in range(4)],
        "document_id string, clause_pos int, clause_text string, ground_truth string, contract_type string",
    )
    responses = spark.createDataFrame(
        [("d0", 1, 0, '{"clause_index":1,"risk_level":"low"}', "ok"), ("d1", 1, 0, "", "llm_error")],
        "document_id string, clause_pos int, attempt int, raw_text string, status string",
    )
    found = accuracy.predict(items, responses).collect()
    assert {r.document_id: r.prediction for r in found} == {"d0": "low", "d1": "error", "d2": "medium", "d3": "medium"}
    assert accuracy.evaluate(items, responses).first().total == 4


def brute_dedup(rows):
    seen_i, seen_t, kept = set(), set(), []
    for i, t, _ in sorted(rows, key=lambda r: r[2]):
        if i in seen_i or (len(t) >= 50 and t in seen_t):
            continue
        seen_i.add(i)
        if len(t) >= 50:
            seen_t.add(t)
        kept.append((i, t))
    return sorted(kept)


def test_dedup_equals_a_loop_when_ids_and_texts_cross(spark):
    import random

    rng = random.Random(7)
    for _ in range(2):
        rows = [(f"i{rng.randint(0, 25)}", str(rng.randint(0, 20)) * rng.choice([5, 60]), n) for n in range(80)]
        df = spark.createDataFrame(rows, "id string, text string, n int").withColumn("source", F.lit("x")).withColumn("contract_type", F.lit("lease"))
        got = dedup_corpus(df, ["n"]).select("id", "text").collect()
        assert sorted(map(tuple, got)) == brute_dedup(rows)


@pytest.mark.parametrize("shuffled", [False, True])
def test_dedup_of_a_long_chain_takes_few_rounds(spark, shuffled):
    """Each row shares its id with the row before and its text with the row after."""
    import random

    n = 10_000
    ranks = list(range(n))
    if shuffled:
        random.Random(3).shuffle(ranks)
    rows = [(f"i{k // 2}", f"t{(k + 1) // 2}", ranks[k]) for k in range(n)]
    pairs = spark.createDataFrame(rows, "i string, t string, r int").select("i", "t", F.struct("r").alias("_rank"))
    kept, rounds = dedup._greedy(pairs)
    taken, want = set(), []
    for i, t, r in sorted(rows, key=lambda x: x[2]):
        if i not in taken and t not in taken:
            taken |= {i, t}
            want.append(r)
    assert sorted(x[0] for x in kept.select("_rank.r").collect()) == want
    assert rounds < 20


def test_dedup_of_crossing_rows_equals_a_loop(spark):
    """One text in a third of all rows, rows without a text, and long dependencies."""
    import random

    rng = random.Random(11)
    rows = set()
    while len(rows) < 600:
        text = "hot" if rng.random() < 0.33 else None if rng.random() < 0.1 else f"t{rng.randint(0, 90)}"
        rows.add((f"i{rng.randint(0, 150)}", text))
    rows = [(*pair, r) for r, pair in enumerate(sorted(rows, key=lambda _: rng.random()))]
    pairs = spark.createDataFrame(rows, "i string, t string, r int").select("i", "t", F.struct("r").alias("_rank"))
    kept, _ = dedup._greedy(pairs.repartition(7))
    ids, texts, want = set(), set(), []
    for i, t, r in rows:
        if i not in ids and (t is None or t not in texts):
            ids.add(i)
            texts.add(t)
            want.append(r)
    assert sorted(x[0] for x in kept.select("_rank.r").collect()) == want


LEASE = (
    "주택 임대차 계약서\n임대인(갑) 임차인(을)\n제1조 (목적)\n임대차 보증금 반환\n제2조 (차임)\n차임은 연 20% 증액\n"
    "제3조 (양도)\n임대인의 동의 없이 양도 못한다\n특약사항\n1. 청소비는 임차인 부담\n2024년 1월 1일"
)


def lease_contracts(spark):
    rows = [("c1", "a.pdf", LEASE), ("c2", "b.txt", LEASE), ("c3", "c.docx", "  \n"), ("c4", "d.hwp", "짧다")]
    return spark.createDataFrame(rows, door.CONTRACT_SCHEMA)


def test_review_end_to_end(spark, built, tmp_path):
    out, _ = built
    kb = spark.read.parquet(f"{out}/kb")
    done = review.prepare(lease_contracts(spark), kb, index_store.read(spark, f"{out}/index"))
    asked = {r.clause_pos: r for r in done.requests.collect()}
    assert sorted(asked) == [1, 4]
    assert "[참고1]" in asked[1].reference_context and asked[1].reference_context.startswith("## 적용 법령 힌트")
    assert asked[1].clause_text == "\n[1] 제1조 (목적): 제1조 (목적)\n임대차 보증금 반환\n"
    responses = spark.createDataFrame(
        [("c1", 1, 0, '[{"clause_index":1,"risk_level":"medium","confidence":0.6,"risks":[{"risk_type":"권리 제한"}],"explanation":"e"}]', "ok")],
        "document_id string, clause_pos int, attempt int, raw_text string, status string",
    )
    fixes = spark.createDataFrame([("c1", 1, "수정안: 새 조항", "ok"), ("c1", 3, "쓰이지 않음", "ok")], "document_id string, clause_pos int, raw_text string, status string")
    edits = spark.createDataFrame([("c1", 2, "사용자 글", None)], "document_id string, clause_pos int, user_override string, user_override_at string")
    rows = {r.clause_pos: r for r in review.finish(done, responses, fixes, edits).collect()}
    assert [(rows[i].risk_level, rows[i].analysis_status) for i in (1, 2, 3, 4)] == [("medium", "ok"), ("high", "ok"), ("safe", "ok"), ("medium", "missing")]
    assert rows[1].risks[0].risk_type == "권리제한" and rows[1].suggested_rewrite == "새 조항"
    assert rows[3].suggested_rewrite is None and rows[2].user_override == "사용자 글"
    assert len(rows[1].references_detail) >= 1 and rows[2].references_detail == []
    analyses = review.finish(done, responses, fixes, edits)
    head = review.headers(done, analyses).first()
    assert (head.total_clauses, head.risky_clauses, head.filename) == (4, 3, "a.pdf") and head.summary.startswith("총 4개 조항 중 3개")
    stores.write_analyses(analyses, str(tmp_path / "a"), "2024-01-01")
    # a second run stands beside the first; of a document both analysed the later one counts
    again = analyses.withColumn("explanation", F.lit("again"))
    stores.write_analyses(again.unionByName(again.withColumn("document_id", F.lit("c9"))), str(tmp_path / "a"), "2024-01-02")
    stores.write_analyses(analyses.withColumn("document_id", F.lit("c8")), str(tmp_path / "a"), "2023-12-31")
    stored = stores.read_analyses(spark, str(tmp_path / "a"))
    assert stores.find_analysis(stored, "c1").count() == 4
    assert {r.document_id: r.explanation for r in stored.filter("clause_pos = 1").collect()} == {"c1": "again", "c9": "again", "c8": "e"}
    stores.write_revised(analyses, str(tmp_path / "h"), documents=review.headers(done, analyses))
    front = spark.read.parquet(str(tmp_path / "h")).filter("kind = 'header'").orderBy("line_no")
    assert [r.text for r in front.collect()][1] == "원본 파일: a.pdf"
    stores.write_revised(analyses.withColumn("document_id", F.lit("c1")), str(tmp_path / "r"), per_document=True)
    stores.write_revised(analyses, str(tmp_path / "lines"))
    assert spark.read.parquet(str(tmp_path / "lines")).filter("kind = 'original_label'").count() == 4
    text = [line for name in sorted(os.listdir(tmp_path / "r" / "document_id=c1")) if name.startswith("part") for line in open(tmp_path / "r" / "document_id=c1" / name, encoding="utf-8").read().split("\n")]
    assert text[:3] == ["제1조 제1조 (목적)", "[중위험] e", "[원문]"] and "[수정안 (사용자)]" in text


def test_rejects_and_strict_types(spark):
    df = lease_contracts(spark)
    assert {r.document_id: r.reason for r in door.rejected(df).collect()} == {"c2": "unsupported_extension", "c3": "empty_text"}
    typed = df.withColumn("contract_type", F.lit("barter"))
    assert door.unsupported_types(typed).count() == 4
    with pytest.raises(Exception, match="barter"):
        door.require_supported_type(typed).select("contract_type").collect()


def test_validation_files(spark, files):
    rows = kb_files.read_validation(spark, f"{files}/labelled", "validation").collect()
    assert [(r.ground_truth, r.dv, r.split) for r in rows] == [("risky", "2", "validation")]
    items = spark.createDataFrame([("v", 1, "차임을 20% 증액", "risky"), ("v", 2, "임대인의 동의 없이 양도", "risky"), ("v", 3, "글", "safe")], "document_id string, clause_pos int, clause_text string, ground_truth string")
    row = accuracy.evaluate(items).first()
    assert (row.total, row.correct, row.false_safe_count, row.false_risky_count) == (3, 1, 1, 1)


def test_contract_stream_equals_batch(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    df = lease_contracts(spark)
    df.filter("document_id = 'c1'").coalesce(1).write.parquet(source)
    for _ in range(2):  # the second run only finds what is new
        flows.start_review(flows.contract_stream(spark, source), out, str(tmp_path / "cp"), once=True).awaitTermination()
        df.filter("document_id = 'c4'").withColumn("text", F.lit(LEASE)).coalesce(1).write.mode("append").parquet(source)
    batch = flows.review_stream(spark.read.schema(door.CONTRACT_SCHEMA).parquet(source)).filter("document_id in ('c1', 'c4')")
    got = spark.read.parquet(out)
    assert got.count() == 8
    assert got.select(batch.columns).exceptAll(batch).isEmpty()


def test_override_stream(spark, tmp_path):
    source, log, cp = str(tmp_path / "in"), str(tmp_path / "log"), str(tmp_path / "cp")
    steps = [[("d", 1, "하나", "2024-01-01T00:00:01"), ("d", 2, "둘", "2024-01-01T00:00:01")], [("d", 1, " ", "2024-01-01T00:00:02"), ("d", 2, "늦음", "2023-01-01T00:00:00")]]
    for n, rows in enumerate(steps):
        put(source, f"{n}.json", "\n".join(json.dumps(dict(zip(("document_id", "clause_pos", "text", "edited_at"), r)), ensure_ascii=False) for r in rows))
        flows.start_overrides(flows.edit_stream(spark, source), log, cp, once=True).awaitTermination()
    got = {r.clause_pos: r.user_override for r in stores.read_overrides(spark, log).collect()}
    assert got == {1: None, 2: "둘"}
    stores.append_overrides(flows.edit_stream and spark.read.schema(flows.EDIT_SCHEMA).json(f"{source}/1.json"), log, 1)
    again = {r.clause_pos: r.user_override for r in stores.read_overrides(spark, log).collect()}
    assert again == got


def test_folded_overrides_equal_the_log(spark, tmp_path):
    log = str(tmp_path / "log")

    def append(batch, rows):
        edits = spark.createDataFrame(rows, "document_id string, clause_pos int, text string, edited_at string")
        stores.append_overrides(edits.withColumn("edited_at", F.col("edited_at").cast("timestamp")), log, batch)

    def current():
        return sorted((r.clause_pos, r.user_override, r.user_override_at) for r in stores.read_overrides(spark, log).collect())

    append(0, [("d", 1, "a", "2024-01-01"), ("d", 2, "b", "2024-01-02"), ("d", 3, " ", "2024-01-05")])
    append(1, [("d", 1, "c", "2024-01-03"), ("d", 4, "e", "2024-01-01")])
    want = current()
    assert stores.fold_overrides(spark, log) == 1 and current() == want
    assert stores.fold_overrides(spark, log) == 1 and current() == want
    # a replay of a folded batch changes nothing; late edits lose, later and equally late ones win
    append(1, [("d", 1, "c", "2024-01-03"), ("d", 4, "e", "2024-01-01")])
    append(2, [("d", 1, "late", "2024-01-02"), ("d", 2, "tie", "2024-01-02"), ("d", 3, "back", "2024-01-06")])
    assert [(p, t) for p, t, _ in current()] == [(1, "c"), (2, "tie"), (3, "back"), (4, "e")]
    want = current()
    assert stores.fold_overrides(spark, log) == 2 and current() == want
    # what is read is one row for each clause
    assert stores._edits(spark, log)[0].count() == 4


def test_lookup_reads_one_shard_of_each_run(spark, tmp_path):
    path = str(tmp_path / "store")
    rows = spark.range(3000).select(F.concat(F.lit("d"), "id").alias("document_id"), F.col("id").alias("n"))
    for run, kept in (("2024-01-01T10:00", rows), ("2024-02-01T10:00", rows.filter("n % 2 = 0"))):
        stores.write_analyses(kept, path, run, shards=16)
    found = stores.lookup_analyses(spark, path, ["d7", "d8", "nobody"], shards=16)
    assert sorted((r.document_id, r.run) for r in found.collect()) == [("d7", "2024-01-01T10:00"), ("d8", "2024-02-01T10:00")]
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        read = []
        for part in (stores.lookup_analyses(spark, path, ["d8"], shards=16), stores.read_analyses(spark, path)):
            part.collect()
            plan = part._jdf.queryExecution().executedPlan()
            read.append(plan.collectLeaves().apply(0).metrics().apply("numFiles").value())
            if len(read) == 1:
                assert re.search(r"PushedFilters: \[[^\]]*(EqualTo\(document_id,d8|In\(document_id)", plan.toString())
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert read[0] <= 4 and read[1] >= 32  # one shard of each of two runs
    # the same run again with fewer documents replaces itself in every shard
    stores.write_analyses(rows.filter("n < 5"), path, "2024-02-01T10:00", shards=16)
    assert stores.lookup_analyses(spark, path, ["d8"], shards=16).first().run == "2024-01-01T10:00"


def test_vectoriser_hook(spark):
    from clausewise.operators.vectors import as_batches

    df = spark.createDataFrame([("a", "xx"), ("b", "y")], "id string, text string")
    got = df.mapInPandas(as_batches(lambda texts: [[len(t), 1.0] for t in texts]), "id string, embedding array<float>")
    assert {r.id: r.embedding for r in got.collect()} == {"a": [2.0, 1.0], "b": [1.0, 1.0]}


def test_report_files(spark, tmp_path):
    rows = spark.createDataFrame([("safe", "safe")], "ground_truth string, prediction string")
    stores.write_report(rows.limit(1), rows, str(tmp_path / "rep"))
    assert spark.read.json(str(tmp_path / "rep" / "details")).count() == 1
