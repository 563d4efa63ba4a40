from clausewise.operators.clauses import contracts_without_clauses, split_clauses


def split(spark, *texts, **options):
    df = spark.createDataFrame(list(enumerate(texts)), "document_id int, text string")
    rows = split_clauses(df, **options).orderBy("document_id", "clause_pos").collect()
    return [(r.document_id, r.clause_pos, r.clause_index, r.title, r.content) for r in rows]


def test_sub_articles_keep_their_own_row(spark):
    got = split(spark, "머리\n제3조 (가)\n본문\n제3조의2 [나]\n다른 글\n제 4 조\n")
    assert got == [
        (0, 1, 3, "제3조 (가)", "제3조 (가)\n본문"), (0, 2, 3, "제3조의2 [나]", "제3조의2 [나]\n다른 글"), (0, 3, 4, "제 4 조", "제 4 조"),
    ]


def test_particle_after_header_is_a_reference(spark):
    # the title is given back to the body, and a bare header before a particle is no header
    got = split(spark, "제1조 (목적)\n이 계약은\n제3조\n을은 한다\n제2조를 위반\n제5조 끝")
    assert [(g[2], g[3], g[4]) for g in got] == [
        (1, "제1조", "제1조\n(목적)\n이 계약은\n제3조\n을은 한다\n제2조를 위반"), (5, "제5조", "제5조\n끝"),
    ]


def test_special_terms_end_at_a_party_line(spark):
    text = "제1조 (가)\n본문\n[특약사항]\n1. 첫째 항목\n가. 둘째 항목\n- 셋째 항목\n임차인은 끝을 낸다\n나머지"
    got = split(spark, text)
    assert [(g[2], g[3], g[4]) for g in got] == [
        (1, "제1조 (가)", "제1조 (가)\n본문\n임차인은 끝을 낸다\n나머지"),
        (2, "특약사항 1", "특약사항 1\n1. 첫째 항목"), (3, "특약사항 2", "특약사항 2\n가. 둘째 항목"), (4, "특약사항 3", "특약사항 3\n- 셋째 항목"),
    ]


def test_special_terms_fallbacks(spark):
    paragraphs = "제1조 글\n특약\n첫 단락 글\n\n둘째 단락 글\n\n짧음"
    assert [g[4] for g in split(spark, paragraphs)][1:] == ["특약사항 1\n첫 단락 글", "특약사항 2\n둘째 단락 글"]
    whole = "제1조 글\n특약사항:\n한 덩어리 글"
    assert [g[4] for g in split(spark, whole)][1:] == ["특약사항 1\n한 덩어리 글"]
    short = "제1조 글\n특약사항\n짧음"
    assert [g[4] for g in split(spark, short)] == ["제1조\n글\n특약사항\n짧음"]
    inline = "제1조 글\n특약은 없다"
    assert len(split(spark, inline)) == 1


def test_only_special_terms(spark):
    got = split(spark, "특약사항\n1. 하나뿐인 항목")
    assert [(g[1], g[2], g[3]) for g in got] == [(1, 1, "특약사항 1")]


def test_paragraph_fallback_numbers_before_dropping(spark):
    text = "첫 단락은 스무 글자보다 길어야 남습니다 정말로\n\n짧다\n\n셋째 단락도 스무 글자보다 길어야 남습니다 네"
    assert [g[2] for g in split(spark, text)] == [1, 3]
    assert [g[2] for g in split(spark, text.replace("\n\n", "\n"), separator=r"\n")] == [1, 3]


def test_rejects(spark):
    df = spark.createDataFrame([(0, "짧다"), (1, ""), (2, "제1조 글")], "document_id int, text string")
    left = contracts_without_clauses(df, split_clauses(df)).select("document_id").collect()
    assert sorted(r[0] for r in left) == [0, 1]


def test_markers_in_the_text_do_no_harm(spark):
    assert [g[3] for g in split(spark, "제1조 (가)\n\u0001본\u0002문\n제2조 나")] == ["제1조 (가)", "제2조"]


def test_split_names_a_text_once(spark):
    """Inside a transform a text that is named twice is searched twice: one marking and one splitting for each pass."""
    from pyspark.sql import functions as F
    from clausewise.operators import clauses as C

    df = spark.createDataFrame([("제1조 (가)\n나",)], "text string")
    plan = df.select(C.headed_clauses(F.col("text")).alias("c"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("regexp_replace(") == 1 and plan.count("regexp_extract(") == 1


def test_strip_trims_every_kind_of_white_space(spark):
    from pyspark.sql import functions as F
    from clausewise.functions import text as X

    texts = ["", " ", "가", *[w + "가" + w + "나" + w for w in X.WHITESPACE], X.WHITESPACE + "가", "가" + X.WHITESPACE, X.WHITESPACE, None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = df.select("i", X.strip(F.col("t")).alias("s"), X.collapse(F.col("t")).alias("c")).orderBy("i").collect()
    old = F.trim(F.regexp_replace("t", X.UNI + r"\s+", " "), F.lit(X.WHITESPACE))
    plain = df.select("i", F.trim(F.col("t"), F.lit(X.WHITESPACE)).alias("s"), old.alias("c")).orderBy("i").collect()
    assert got == plain
