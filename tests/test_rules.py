"""One clause that fires and one that does not for every rule, in the order of the rules."""

import pytest
from pyspark.sql import functions as F

from clausewise import dims
from clausewise import fixed_values as fv
from clausewise.operators import rules

SAFE_HITS = [
    "소재지: 서울시 면적: 84㎡", "보증금 일억원, 월 차임 오십만원에 임대한다", "보증금 사억원정에 임대하며", "보증금: 일억원 차임: 오십만원 매월 지급",
    "차임은 연 5% 이내로 올린다", "주택임대차보호법에 따라 연 5 %", "통상적인 사용에 따른 마모는 제외", "임대인은 보일러를 수선하고 임차인은 소모품을 맡는다",
    "임대인의 동의 없이 양도", "임차권을 제삼자에게 전대할 수 없다", "임차인은 선량한 관리자의 주의로", "임차물의 수리를 요할 때 임대인에게 통지",
    "쌍방의 합의로 조건을 변경", "다음 각 호에 해당하는 경우 차임을 조정할 수 있다", "시설을 변경하려면 임대인의 동의 없이 할 수 없다",
    "잔금 지급과 소유권 이전 등기를 동시에", "동시이행으로 잔금을", "계약금의 배액을 상환하고 해제", "매도인은 을에게 매도한다",
    "해고는 30일 전에 예고", "30일분 이상의 통상임금을 지급", "주 40시간 이내", "1일 8시간 이내", "연장 근로에는 통상의 50% 이상 가산",
    "1년간 80% 이상이면 15일의 유급", "계속근로 1년에 30일분의 평균임금",
    "대금은 60일 이내 지급", "60일 이내에 대금을 지급", "하자담보 기간은 1년 이내", "인도와 동시에 보수 지급",
    "이자율은 연 12%로", "보증은 서면으로", "근보증의 한도를 명시", "차주는 대주에게 원금을 상환",
]
HIGH_HITS = [
    "차임을 20% 증액", "증액에는 상한의 제한이 없", "보증금 반환을 무기한 연기", "새로운 임차인이 올 때까지 반환을 연기",
    "반환을 연기하며 이자는 발생하지 않는다", "모든 수리는 임차인 부담", "원인 불문 임차인이 부담", "사전 통보 없이 출입",
    "본 계약에 정하지 않은 사항은 임대인의 결정", "묵시적 갱신은 적용하지 않는다", "갱신요구권을 포기", "관리비 금액은 갑이 단독으로",
    "관리비 세부 내역을 공개할 의무가 없다", "확정일자는 임대인의 서면 동의",
    "대금은 90일 이내에 지급", "대금 지급은 검수 후 90일", "검수는 무기한", "단가는 갑이 일방적으로 변경",
    "이자율은 연 24%로", "월 2%", "보증은 구두로", "기한의 이익은 상실하며 통지 없이".replace("기한의 이익은", "기한 이익은"), "1회 연체하면 기한이익을 상실",
]


def decide(spark, rows, kind):
    df = spark.createDataFrame(rows, "i int, contract_type string, body string")
    rule = rules.first_rule(F.col("body"), F.col("contract_type"), dims.safe_rules() if kind == "safe" else dims.high_rules())
    return [(r["i"], r["r"]) for r in df.select("i", rule.alias("r")).orderBy("i").collect()]


@pytest.mark.parametrize("kind", ["safe", "high"])
def test_every_rule_fires_alone(spark, kind):
    """Each pattern is tried as the only rule, so an earlier one cannot hide it."""
    listed = dims.safe_rules() if kind == "safe" else dims.high_rules()
    hits = SAFE_HITS if kind == "safe" else HIGH_HITS
    assert len(listed) == len(hits)
    df = spark.createDataFrame([(t,) for t in [*hits, "아무 관계도 없는 글"]], "body string")
    alone = [
        F.col("body").rlike("(?dU)" + rule.pattern).alias(f"r{i}") for i, rule in enumerate(listed)
    ]
    rows = df.select("body", *alone).collect()
    for i, text in enumerate(hits):
        assert rows[i][f"r{i}"], (listed[i].pattern, text)
    assert not any(rows[-1][f"r{i}"] for i in range(len(listed)))


def test_counts():
    assert (len(fv.SAFE_RULES), len(fv.HIGH_RULES), len(fv.COMMON_VETOES), len(fv.LEASE_VETOES)) == (34, 23, 35, 18)


def test_first_rule_in_order_and_only_of_its_type(spark):
    rows = [(0, "lease", "보증금 일억, 차임 오십만에 임대한다"), (1, "service", "보증금 일억에 임대한다"), (2, "none", "대금은 60일 이내 지급")]
    got = decide(spark, rows, "safe")
    assert got[0][1]["reason"] == "단순 임대 조건 기재" and got[1][1] is None and got[2][1] is None


def test_vetoes_and_precedence(spark):
    rows = [
        (0, "service", "대금은 60일 이내 지급한다"), (1, "service", "대금은 60일 이내 지급하되 위약금을 물린다"),
        (2, "lease", "임대인의 동의 없이 양도하면 6개월 안에"), (3, "sales", "매도인은 을에게 매도한다. 6개월"),
        (4, "service", "대금은 60일 이내 지급하고 검수는 무기한"), (5, "lease", "임대인의\n동의 없이\t양도. 차임을 20% 증액"),
    ]
    df = spark.createDataFrame(rows, "i int, contract_type string, content string")
    got = {r.i: r.verdict_source for r in rules.apply_rules(df).collect()}
    # 4: vetoed as safe by 무기한, so the high rule decides; 5: safe is tried before high
    assert got == {0: "rule_safe", 1: "model", 2: "model", 3: "rule_safe", 4: "rule_high", 5: "rule_safe"}


def test_rules_from_a_table(spark):
    table = spark.createDataFrame(
        [("safe", "x", 1, "b+", None, "second"), ("safe", "x", 0, "a+", None, "first")],
        "kind string, contract_type string, ord int, pattern string, risk_type string, reason string",
    )
    df = spark.createDataFrame([("x", "ab"), ("x", "b"), ("y", "a")], "contract_type string, content string")
    got = rules.apply_rules(df, safe=dims.rules_from_table(table), high=[], vetoes=[]).collect()
    assert [r.safe_reason for r in got] == ["first", "second", None]


def test_verdict_texts(spark):
    df = spark.createDataFrame([(1, 1, "lease", "차임을 20% 증액"), (1, 2, "service", "대금은 60일 이내 지급")], "document_id int, clause_pos int, contract_type string, content string")
    rows = {r.clause_pos: r for r in rules.rule_verdicts(rules.apply_rules(df)).collect()}
    assert rows[1].risk_level == "high" and rows[1].explanation == fv.HIGH_EXPLANATIONS["차임증액_무제한"]
    assert rows[1].risks[0].suggestion == fv.HIGH_SUGGESTION
    assert rows[2].explanation == fv.SAFE_DEFAULT_EXPLANATION and rows[2].risks == []


def test_needed_literals():
    assert rules.needed(r"소재지\s*:.*면적\s*:") == [["소재지"], ["면적"], [":"], [":"]]
    assert rules.needed("ab(?:cd|e?fg)x?") == [["ab"], ["cd", "fg"]]
    assert rules.needed("a?b*|c") == [] and rules.needed("(?:xy){2,3}(?:q|)") == [["xy"]]


@pytest.mark.parametrize("rule", fv.SAFE_RULES + fv.HIGH_RULES, ids=lambda r: r[1])
def test_a_match_holds_what_its_pattern_needs(rule):
    """Texts spun out of the pattern's own parse tree: each that matches must contain the needed literals."""
    import random
    import re
    from re import _parser as P

    rng = random.Random(rule[1])

    def spin(items):
        out = ""
        for op, arg in items:
            if op is P.LITERAL:
                out += chr(arg)
            elif op is P.SUBPATTERN:
                out += spin(arg[-1])
            elif op is P.BRANCH:
                out += spin(rng.choice(arg[1]))
            elif op in (P.MAX_REPEAT, P.MIN_REPEAT):
                out += "".join(spin(arg[2]) for _ in range(rng.randint(arg[0], min(int(arg[1]), arg[0] + 2))))
            elif op is P.IN and arg[0][0] is P.NEGATE:
                out += "가"
            elif op is P.IN:
                kind, value = rng.choice(arg)
                out += chr(value) if kind is P.LITERAL else chr(value[0]) if kind is P.RANGE else {P.CATEGORY_SPACE: " ", P.CATEGORY_DIGIT: "7"}.get(value, "가")
            elif op is P.ANY:
                out += "나"
        return out

    matched = 0
    for _ in range(60):
        text = spin(P.parse(rule[1]))
        if re.search(rule[1], text):
            matched += 1
            assert all(any(w in text for w in words) for words in rules.needed(rule[1])), text
    assert matched


def test_first_look_passes_every_text_that_matches_and_sets_others_aside():
    import re

    for listed, hits in ((dims.safe_rules(), SAFE_HITS), (dims.high_rules(), HIGH_HITS)):
        for rule, text in zip(listed, hits):
            look = rules.any_needed([r.pattern for r in listed if r.contract_type == rule.contract_type])
            assert re.search(look, text)
            assert not re.search(look, "아무 관계도 없는 글")
    assert rules.any_needed(["갑을", r"\d+"]) is None


def test_vetoes_are_looked_for_after_a_rule_matched(spark):
    """A clause without a match is settled by one pattern: neither rules nor vetoes are tried on it."""
    df = spark.createDataFrame([("lease", "글")], "contract_type string, body string")
    text = df.select(rules.safe_rule(F.col("body"), F.col("contract_type")))._jdf.queryExecution().analyzed().toString()
    assert 0 < text.index("RLIKE") < text.index("CONTAINS" if "CONTAINS" in text else "Contains(")
