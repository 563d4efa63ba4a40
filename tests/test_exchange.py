from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from clausewise import fixed_values as fv
from clausewise.functions import responses as R
from clausewise.operators import analysis, evaluation, exchange, rollups, rules

GOOD = '[{"clause_index":1,"risk_level":"high","confidence":0.8,"risks":[{"risk_type":"a","description":"b","suggestion":"c"}],"explanation":"e"}]'
LADDER = [
    (GOOD, (1, "high", 0.8, 1)),
    ("```json\n" + GOOD + "\n```", (1, "high", 0.8, 1)),
    ("말 " + GOOD + " 끝", (1, "high", 0.8, 1)),
    ('{"clause_index":2,"risk_level":"low"}', (2, "low", None, None)),
    ('[{"clause_index":3,"risk_level":"low",},]', (3, "low", None, None)),
    ('{"clause_index":4,"risk_level":"high","risks":[{"risk_type":"a" "b"}],"explanation":"z"}', (4, "high", None, 0)),
    ('[{"clause_index":5,"risk_level":"high","risks":[],"explanation":"a"},{"clause_index":6,"ris', (5, "high", None, 0)),
    ('[{"clause_index":7,"risk_level":"safe","risks":[{"risk_type":"x","desc', (7, "safe", 0.7, 0)),
    ('[{"clause_index":8,"risk_level":"low","risks":[],"explanation":"줄\n바꿈"}]', (8, "low", None, 0)),
    ("[]", None), ("글뿐", None), ("", None), ('{"other":1}', (None, None, None, None)),
]


def test_json_ladder(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(LADDER)], "i int, t string")
    rows = df.select("i", R.parse_verdicts(F.col("t")).alias("v")).orderBy("i").collect()
    for row, (text, want) in zip(rows, LADDER):
        got = None
        if row.v:
            v = row.v[0]
            got = (v.clause_index, v.risk_level, v.confidence, None if v.risks is None else len(v.risks))
        assert got == want, text


RESPONSES = [
    # (clause, attempt, text, status)
    (1, 0, None, "timeout"), (1, 1, GOOD, "ok"),
    (2, 0, "글", "ok"), (2, 1, "", "ok"),
    (3, 0, "글", "ok"), (3, 1, None, "timeout"),
    (4, 0, None, "llm_error"),
    (5, 0, GOOD, "ok"), (5, 1, '{"risk_level":"safe"}', "ok"),
    (6, 0, "글", "ok"), (6, 1, "글2", "ok"), (6, 2, GOOD, "ok"),
    (7, 0, '{"risk_level":"safe"}', "ok"),
    (8, 0, "글", "ok"), (9, 0, "글", "ok"), (10, 0, '{"risk_level":"medium"}', "ok"),
]
SCHEMA = "clause_pos int, attempt int, raw_text string, status string"


def test_attempts_and_fold(spark):
    responses = spark.createDataFrame(RESPONSES, SCHEMA).withColumn("document_id", F.lit("d"))
    best = exchange.best_attempts(exchange.parse_responses(responses))
    state = {r.clause_pos: (r.analysis_status, r.last_text) for r in best.collect()}
    assert state == {
        1: ("ok", None), 2: ("empty", "글"), 3: ("timeout", "글"), 4: ("llm_error", None), 5: ("ok", None), 6: ("ok", None),
        7: ("ok", None), 8: ("parse_failed", "글"), 9: ("parse_failed", "글"), 10: ("ok", None),
    }
    two = exchange.best_attempts(exchange.parse_responses(responses), max_attempts=2)
    assert [(r.analysis_status, r.last_text) for r in two.filter("clause_pos = 6").collect()] == [("parse_failed", "글2")]
    content = {7: "차임을 20% 증액", 8: "차임을 20% 증액", 9: "임대인의 동의 없이 양도", 10: "차임을 20% 증액", 4: "차임을 20% 증액"}
    clauses = spark.createDataFrame(
        [("d", i, i, f"제{i}조", content.get(i, "본문"), "lease") for i in range(1, 12)],
        "document_id string, clause_pos int, clause_index int, title string, content string, contract_type string",
    )
    ruled = rules.apply_rules(clauses)
    folded = exchange.fold_responses(ruled, best)
    got = {r.clause_pos: (r.risk_level, r.confidence, r.analysis_status) for r in folded.collect()}
    assert got == {
        1: ("high", 0.8, "ok"), 2: ("medium", 0.3, "empty"), 3: ("medium", 0.3, "timeout"), 4: ("medium", 0.3, "llm_error"),
        5: ("high", 0.8, "ok"), 6: ("high", 0.8, "ok"), 11: ("medium", 0.3, "missing"), 7: ("high", 0.95, "ok"), 8: ("high", 0.95, "ok"),
        9: ("safe", 0.95, "ok"), 10: ("medium", 0.5, "ok"),
    }
    whole = analysis.attach_verdicts(clauses, folded).filter("clause_pos = 11").first()
    assert (whole.risk_level, whole.confidence, whole.analysis_status, whole.explanation) == ("medium", 0.3, "missing", fv.MISSING_EXPLANATION)
    kept = {r.clause_pos: r.raw_text for r in exchange.quarantine(best).collect()}
    assert kept == {2: "글", 3: "글", 4: "<EMPTY>", 8: "글", 9: "글"}


def test_risk_type_mapping(spark):
    raw = ["권리제한", " 권리 제한 ", "보증금 미반환", "전혀다름zz", "위약금"]
    df = spark.createDataFrame([("lease", r) for r in raw] + [("none", " x ")], "contract_type string, raw string")
    got = {(r.contract_type, r.raw): r.risk_type for r in analysis.risk_type_map(df).collect()}

    def loop(name):
        name = name.strip()
        valid = fv.RISK_TYPES["lease"]
        if name in valid:
            return name
        best = max(valid, key=lambda v: SequenceMatcher(None, name, v).ratio())
        return best if SequenceMatcher(None, name, best).ratio() >= 0.4 else name

    assert got == {**{("lease", r): loop(r) for r in raw}, ("none", " x "): " x "}


@pytest.mark.parametrize("ratio", [0.4, 0.75])
def test_risk_types_of_a_vocabulary_equal_a_loop(spark, ratio):
    """A listed vocabulary of any size: ties, anagrams, blanks, names beyond the plane of two bytes, unknown types."""
    import random

    rng = random.Random(5)
    letters = "가나다라마바사아자차카타파하_ ab😀"
    listed = [("lease", k, "".join(rng.choice(letters) for _ in range(rng.randint(1, 9)))) for k in range(120)]
    listed += [("sales", 0, "위약금"), ("sales", 1, "금약위"), ("sales", 2, "위약금"), ("empty", 0, "")]

    def misspelt(name):
        chars = list(name)
        for _ in range(rng.randint(0, 3)):
            at = rng.randrange(len(chars) + 1)
            chars[at:at + rng.randint(0, 1)] = rng.choice([[], [rng.choice(letters)]])
        return "".join(chars)

    raw = [(ct, misspelt(name)) for ct, _, name in listed for _ in range(2)]
    raw += [("lease", "z" * 400), ("lease", "  "), ("lease", " "), ("none", " x "), ("sales", "약위금"), ("sales", None), (None, "a"), ("empty", "x")]

    def loop(ct, name):
        valid = [v for t, _, v in listed if t == ct]
        if not valid or name is None:
            return name
        name = name.strip(" \t\n\r")
        if name in valid:
            return name
        best = max(valid, key=lambda v: SequenceMatcher(None, name, v).ratio())
        return best if SequenceMatcher(None, name, best).ratio() >= ratio else name

    names = spark.createDataFrame(raw, "contract_type string, raw string").repartition(3)
    valid = spark.createDataFrame(listed, "contract_type string, ord int, risk_type string")
    got = {(r.contract_type, r.raw): r.risk_type for r in analysis.risk_type_map(names, valid, ratio).collect()}
    assert got == {pair: loop(*pair) for pair in raw}
    nothing = analysis.risk_type_map(names.limit(0), valid, ratio).unionByName(analysis.risk_type_map(names.limit(0), valid.limit(0), ratio))
    assert nothing.count() == 0


def test_risks_keep_their_order(spark):
    df = spark.sql(
        "SELECT 'd' AS document_id, 1 AS clause_pos, 'lease' AS contract_type, "
        "array(named_struct('risk_type','권리 제한','description',null,'suggestion','s'), named_struct('risk_type','위약금 과다','description','d','suggestion','')) AS risks "
        "UNION ALL SELECT 'd', 2, 'lease', array()"
    )
    rows = {r.clause_pos: [tuple(x) for x in r.risks] for r in analysis.normalize_risk_types(df).collect()}
    assert rows == {1: [("권리제한", "", "s"), ("위약금_과다", "d", "")], 2: []}


def test_overrides(spark):
    log = spark.createDataFrame(
        [("d", 1, " a ", "2024-01-01 00:00:01"), ("d", 1, "b", "2024-01-01 00:00:02"), ("d", 2, "x", "2024-01-01 00:00:01"), ("d", 2, "  ", "2024-01-01 00:00:03"), ("d", 3, None, "2024-01-01 00:00:03")],
        "document_id string, clause_pos int, text string, at string",
    ).withColumn("edited_at", F.to_timestamp("at")).drop("at")
    got = {r.clause_pos: (r.user_override, r.user_override_at) for r in analysis.latest_overrides(log).collect()}
    assert got == {1: ("b", "2024-01-01T00:00:02+00:00"), 2: (None, None), 3: (None, None)}


@pytest.mark.parametrize("counts, text", [
    ((0, 0, 0, 2), "총 2개 조항을 분석한 결과, 특별히 불리한 조항이 발견되지 않았습니다."),
    ((1, 0, 2, 1), "총 4개 조항 중 3개 조항에서 위험 요소가 발견되었습니다 (고위험 1개, 저위험 2개). 세부 내용을 확인하고 계약 전 수정을 요청하세요."),
])
def test_fallback_summary(spark, counts, text):
    df = spark.createDataFrame([counts], "h int, m int, l int, s int")
    assert df.select(rollups.fallback_summary(*[F.col(c) for c in "hmls"])).first()[0] == text


def test_empty_evaluation(spark):
    empty = spark.createDataFrame([], "ground_truth string, prediction string")
    row = evaluation.metrics(empty).first()
    assert (row.accuracy, row.safe_accuracy, row.total) == (0.0, 0.0, 0)


@pytest.mark.parametrize(
    ("text", "levels", "confidence"),
    [
        ('{"clause_index":1,"risk_level":"low",} {"clause_index":2,"risk_level":"high"}', ["low", "high"], None),
        ('{"clause_index":1,"risk_level":"low","a":{"b":{"c":{"d":[{}]}}},"confidence":0.5}', ["low"], 0.5),
        ('[{"clause_index":1,"risk_level":"safe","confidence":"0.9"}]', ["safe"], 0.9),
        ('[{"clause_index":1,"risk_level":"low","risks":[{"risk_type":"a"],["risk_type":"b"}],"confidence":0.4}]', ["low"], 0.4),
        ('글 ```json\n[{"clause_index":3,"risk_level":"medium","explanation":"}{ \\" ]"}]\n``` 글', ["medium"], None),
        ('[{"clause_index":4,"risk_level":"low","confidence":0.9,"risks":[{"risk_type":"cut', ["low"], 0.7),
        ('[{"confidence":0.2}]', [None], 0.2),
        ("{}", [None], None),
        ("", None, None),
        # quotes and brackets of the prose mean nothing
        ('a 5" pipe: {"clause_index":1,"risk_level":"high","confidence":0.9,"risks":[]}', ["high"], 0.9),
        ('set {a: [{"clause_index":1,"risk_level":"low","confidence":0.9,"risks":[]}]', ["low"], 0.9),
        ('{ [ " \' } ] 5" {"clause_index":1,"risk_level":"low","confidence":0.8} and " more', ["low"], 0.8),
        # an object that is never closed does not hide the complete ones behind it
        ('{"note": "see", [{"clause_index":2,"risk_level":"low","confidence":0.6,"risks":[{"risk_type":"a"}]}', ["low"], 0.6),
        ('{"clause_index":3,"risk_level":"low","confidence":0.6,"explanation":"a {\\"b\\": 1} } c"}', ["low"], 0.6),
    ],
)
def test_objects_are_found_and_mended(spark, text, levels, confidence):
    found = spark.createDataFrame([(text,)], "t string").select(R.parse_verdicts(F.col("t")).alias("v")).first().v
    assert (None if found is None else [v.risk_level for v in found]) == levels
    if found:
        assert found[0].confidence == confidence


def test_long_answers_are_read_whole(spark):
    item = '{"clause_index":%d,"risk_level":"low","confidence":0.5,"risks":[{"risk_type":"a","description":"' + "w " * 40 + '"}],"explanation":"e"},'
    text = '5" {x [' + "".join(item % i for i in range(1500)) + "]"
    rows = spark.createDataFrame([(text,)], "t string").select(F.size(R.parse_verdicts(F.col("t"))).alias("n"))
    assert rows.first()["n"] == 1500
