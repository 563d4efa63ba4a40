import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from clausewise.functions import markdown as M
from clausewise.functions import responses as R
from clausewise.functions import text as X
from clausewise.functions.udfs import match_ratio, nfc
from clausewise.operators import keywords as K
from clausewise.operators import parties as P


def values(spark, texts, expr):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[0] for r in df.select("i", expr(F.col("t")).alias("v")).orderBy("i").select("v").collect()]


def test_tokens_keep_word_and_stem_once(spark):
    got = values(spark, ["근로자는 근로자 사용자에게 a bb bb 을 으로", "", "은는"], X.tokenize)
    assert sorted(got[0]) == sorted(["근로자는", "근로자", "사용자에게", "사용자", "bb", "으로"])
    assert got[1] == []
    assert got[2] == ["은는"]  # the stem would be one character


def test_particles_are_looked_for_by_plain_searches(spark):
    df = spark.createDataFrame([("법은 the law",)], "t string").select(X.tokenize(F.col("t")).alias("v"))
    assert "rlike" not in df._jdf.queryExecution().toString().lower()
    assert sorted(df.first().v) == sorted(["법은", "the", "law"])


def test_longest_particle_wins(spark):
    assert values(spark, ["학교에서는 물건이", "보증금으로써", "나에게"], X.strip_particles) == ["학교 물건", "보증금", "나에게"]


def reference_chunks(text, size, overlap):
    text = text.strip()
    if len(text) <= size:
        return [text] if text else []
    out, start = [], 0
    while True:
        end = min(start + size, len(text))
        out.append(text[start:end])
        if end == len(text):
            return out
        start = end - overlap


def test_chunks_match_a_plain_loop(spark):
    texts = ["가" * n + "x" for n in (0, 8, 9, 10, 15, 16, 17, 30, 31)] + ["   "]
    got = values(spark, texts, lambda c: X.chunk(c, 10, 3))
    assert got == [reference_chunks(t, 10, 3) for t in texts]


@settings(max_examples=3, deadline=None)
@given(st.lists(st.text(alphabet="ab 가나", max_size=60), min_size=20, max_size=20))
def test_chunks_reassemble(spark, texts):
    for text, parts in zip(texts, values(spark, texts, lambda c: X.chunk(c, 7, 2))):
        joined = parts[0] + "".join(p[2:] for p in parts[1:]) if parts else ""
        assert joined == text.strip()


def test_unicode_whitespace(spark):
    assert values(spark, [" 　a \n b　"], X.strip) == ["a \n b"]
    assert values(spark, [" 　a \n b　"], X.collapse) == ["a b"]


def test_clause_items(spark):
    texts = ["제1조 ①가 ②나", "제목\n1. 하나\n2) 둘\n(3) 셋", "1. 하나뿐", "① 하나", "①②", "1. a 2. b"]
    assert values(spark, texts, X.clause_items) == [
        ["제1조", "가", "나"], ["1. 하나", "2) 둘", "(3) 셋"], [], [], [], [],
    ]


def test_only_the_first_header_is_removed(spark):
    text = "서문\n[법률] 민법\n본문  하나\n[판례] 둘\n끝"
    assert values(spark, [text], X.corpus_norm) == ["서문 본문 하나 [판례] 둘 끝"]


def test_content_key(spark):
    text = "[판례] 대법원 2020다1\n민법 제 3 조의2 (대항력): **동의** 없이 ①양도"
    assert values(spark, [text, "동의 없이\n양도", "A" * 200], lambda c: X.content_key(c, 120)) == ["동의없이양도", "동의없이양도", "a" * 120]


def test_law_key(spark):
    rows = [
        ("law", "민법", 629, None, None), ("law", " ", 1, 0, None), ("민법", None, None, None, "제629조의2"),
        ("민법", None, None, None, "전문"), ("실무", "민법", 1, 0, "제1조"), ("약관규제법/판례", None, None, None, "제6조,제10조"),
    ]
    df = spark.createDataFrame(rows, "source string, law_name string, article_no int, sub_no int, article string")
    key = X.law_key(*[F.col(c) for c in ("source", "law_name", "article_no", "sub_no", "article")])
    assert [r[0] for r in df.select(key).collect()] == ["민법-629-0", None, "민법-629-2", None, None, "약관규제법/판례-6-0"]


def test_reference_display(spark):
    text = "[판례] 머리\n판시사항: 가\n판결요지 : 나\n관련 조문:  \n이유：다"
    (tag,) = values(spark, [text], X.reference_tag)
    assert tag["tag"] == "판례" and tag["rest"].startswith("머리")
    (sections,) = values(spark, [text], X.reference_sections)
    assert [(s["label"], s["body"]) for s in sections] == [(None, "[판례] 머리"), ("판시사항", "가"), ("판결요지", "나"), ("이유", "다")]
    assert values(spark, ["그냥 본문 "], X.reference_sections)[0][0]["body"] == "그냥 본문"


def test_file_names(spark):
    assert values(spark, ["a.b.pdf", "noext", ".pdf", "d/x.HWP"], lambda c: X.export_name(c, "docx")) == [
        "a.b_권고수정안.docx", "noext_권고수정안.docx", ".pdf_권고수정안.docx", "x_권고수정안.docx",
    ]
    assert values(spark, ["a.pdf", "a.HWPX", "a.txt", "a"], X.supported_file) == [True, True, False, False]


def test_keyword_scores_and_ties(spark):
    words = {"a": ["xx"], "b": ["yy", "y"]}
    assert values(spark, ["xxxx", "yy", "", "xxx y"], lambda c: K.best_label(c, words)) == ["a", "b", "a", "a"]
    assert values(spark, ["xx", "xxxx"], lambda c: K.best_label(c, words, 2)) == [None, "a"]


def test_lease_subtype(spark):
    texts = ["주택", "상가 점포", "", "주택 상가", "주택 주거 상가"]
    # '주거' and '주택' against one commercial word is a clear two to one
    assert values(spark, texts, K.lease_subtype) == ["residential", "commercial", None, None, "residential"]


@pytest.mark.parametrize(
    "text, kind, expected",
    [
        ("임대인(갑) 임차인 ( 을 )", "lease", ("임대인", "임차인")),
        ("임차인(갑)과 을(임대인)", "lease", ("임차인", "임대인")),
        ("고용주(갑)", "employment", ("사용자", "근로자")),
        ("없음", "sales", ("매도인", "매수인")),
        ("임대인(을)", "other", ("갑", "을")),
    ],
)
def test_parties(spark, text, kind, expected):
    (got,) = values(spark, [text], lambda c: P.parties(c, F.lit(kind)))
    assert tuple(got) == expected


def test_front_matter_and_articles(spark):
    md = (
        "---\n상태: '시행'\n시행일자: 2024-01-01\n---\n# 법\n##### 제1조 (목적) 남은 글\n이 법은\n### 절\n더\n"
        "##### 제1조의2 (정의)\n뜻\n## 부칙\n##### 제9조(빈 조)\n\n"
    )
    articles = values(spark, [md], lambda c: M.law_articles(M.after_front_matter(c)))[0]
    assert [(a["article_no"], a["sub_no"], a["title"], a["body"]) for a in articles] == [
        (1, 0, "목적", "이 법은\n### 절\n더"), (1, 2, "정의", "뜻"),
    ]
    blocks = [md, "---\n상태: 폐지\n---\n", "---\nx: y\n---\n", "---\n상태: ''\n---\n", "---\n상태:\n---\n"]
    assert values(spark, blocks, lambda c: M.is_in_force(M.front_matter(c))) == [True, False, True, True, False]
    assert values(spark, [md, "no"], lambda c: M.value(M.front_matter(c), "시행일자")) == ["2024-01-01", None]


def test_sections_last_duplicate_wins(spark):
    md = "---\na: b\n---\n## 판시사항\n가\n## 판결요지 \n나\n## 판시사항\n다\n### 소제목\n라"
    got = values(spark, [md], lambda c: M.section(M.named_sections(M.after_front_matter(c)), "판시사항"))
    assert got == ["다\n### 소제목\n라"]


def test_flat_map_last_wins(spark):
    assert values(spark, ["a: 1\nb: x: y\n\na: 2"], M.flat_map) == [{"a": "2", "b": "x: y"}]


def test_python_functions(spark):
    assert values(spark, ["é", None], nfc) == ["é", None]
    from difflib import SequenceMatcher

    want = SequenceMatcher(None, "권리 제한", "권리제한").ratio()
    assert values(spark, ["권리 제한"], lambda c: match_ratio(c, F.lit("권리제한"))) == [want]


def test_cleaning(spark):
    assert values(spark, ["<think>a</think>```text\n수정안: 본문\n```", "</think> 수정된 조항 본문"], R.clean_rewrite) == ["수정안: 본문".split(": ")[1], "본문"]
    assert values(spark, ["## 종합 평가:\n**■ 전반 평가**\n가\n\n\n\n나"], R.clean_summary) == ["■ 전반 평가\n가\n\n나"]
    said = ["<think>x</think>[1]", "<think>{\"risk_level\":1}</think>ok", "a</think>{b", "<think>열림 {\"clause_index\"", "plain", "<think></think>"]
    assert values(spark, said, R.strip_reasoning) == ["[1]", '{"risk_level":1}', "{b", '열림 {"clause_index"', "plain", ""]
