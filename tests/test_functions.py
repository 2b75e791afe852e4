"""Golden vectors of the text functions and rule sets (ids of the survey in the names)."""

import pytest
from pyspark.sql import functions as F

from lexweave.functions import rules as R
from lexweave.functions import text as X


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first()["y"]


def test_s1_nfkc_r1_r2_queries(spark):
    assert one(spark, "ＳＮＳ ①", X.nfkc) == "SNS 1"
    assert one(spark, None, X.nfkc) is None
    q = lambda c: X.normalize_query(X.nfkc(c))
    assert one(spark, "  게임   채팅 성적 욕설  ", q) == "게임 채팅 성적 욕설"
    assert one(spark, "a\r\r\r\rb\t\tc", q) == "a\n\nb c"
    assert one(spark, "게임 채팅 성적 욕설 a 게임", lambda c: F.array_join(X.query_terms(c), " OR ")) == "게임 OR 채팅 OR 성적 OR 욕설"
    assert one(spark, "  ", X.query_terms) == []
    once = one(spark, "x \t y\n\n\n\nz ", q)
    assert one(spark, once, q) == once


def test_s2_w1_paragraphs(spark):
    assert one(spark, "<p>첫 문단</p><p>둘째&nbsp;문단</p><br>셋째", X.split_paragraphs) == ["첫 문단", "둘째 문단", "셋째"]
    assert one(spark, None, X.split_paragraphs) == []
    assert one(spark, "a &amp;lt; b", X.split_paragraphs) == ["a &lt; b"]
    assert one(spark, 7, X.paragraph_id, "int") == "p007"


@pytest.mark.parametrize(
    "given, text, n",
    [
        ("연락처 010-1234-5678, @case_user, a@b.kr", "연락처 [가림], [가림], [가림]", 3),
        ("주민 900101-1234567, https://example.com/@person, 서울로 12번지", "주민 [가림], [가림], [가림]", 3),
        ("", "", 0),
        (None, "", 0),
    ],
)
def test_s4_redaction(spark, given, text, n):
    assert tuple(one(spark, given, X.redact)) == (text, n)


def test_src_functions(spark):
    assert [one(spark, a, X.article_parameter) for a in ("13", "13-2", "2")] == ["001300", "001302", "000200"]
    assert [one(spark, a, X.flexible_date) for a in ("2026.03.12", "20260312", "2026.03.12.", "x", None)] == ["2026-03-12"] * 3 + ["", ""]
    assert one(spark, "2026-13-40", X.as_date) is None
    assert [one(spark, a, X.body_state) for a in ("  ", "<!DOCTYPE html><p>", '{"a":1}')] == ["empty", "html", None]
    assert one(spark, "https://x/y?OC=abc&target=prec", X.mask_secrets) == "https://x/y?OC=***&target=prec"
    inside = lambda c: X.host_within(c, "law.go.kr")
    assert [one(spark, f"https://{h}/a", inside) for h in ("law.go.kr", "www.law.go.kr", "law.go.kr.evil.test")] == [True, True, False]
    assert one(spark, "not a url", inside) is False
    assert one(spark, "가 나", X.encode_component) == "%EA%B0%80%20%EB%82%98"


def test_s10_s11_rounding(spark):
    d = spark.sql("SELECT -0.5D AS a, 0.5D AS b, 2.5D AS c, 1L AS p, 3L AS w, 0L AS z")
    assert tuple(d.select(*[X.half_up(F.col(c)) for c in "abc"]).first()) == (0, 1, 3)
    assert tuple(d.select(X.percent(F.col("p"), F.col("w")), X.percent(F.col("p"), F.col("z"))).first()) == (33.33, 0.0)


def facts_of(spark, text):
    return one(spark, text, R.facts).asDict()


def test_x1_x9_fact_tags(spark):
    f = facts_of(spark, "온라인 게임에서 처음 만난 상대가 채팅창으로 성적인 욕설을 한 번 보냈습니다.")
    assert (f["medium"], f["relationship"], f["context"], f["messageForm"], f["expressionType"], f["repetition"], f["reachedRecipient"]) == (
        "game_chat", "game_user", "conflict", "text", "insult_with_sexual_terms", "once", "yes",
    )
    f = facts_of(spark, "카카오톡과 인스타 DM으로 나체 사진을 여러 번 받았습니다.")
    assert (f["medium"], f["messageForm"], f["expressionType"], f["repetition"], f["recipientIdentification"], f["additionalChannels"]) == (
        "kakao", "image", "sexual_image", "repeated", "direct_account", ["sns_mention"],
    )
    assert {facts_of(spark, t)["medium"] for t in ("컨트롤과 스크롤", "롤케이크", "트롤", "롤러스케이트")} == {"unknown"}
    assert facts_of(spark, "롤 하다가")["medium"] == "game_chat"
    assert facts_of(spark, "고추장을 사왔습니다.")["expressionType"] == "other"
    assert facts_of(spark, "메시지가 도달하지 않았다")["reachedRecipient"] == "no"
    f = facts_of(spark, None)
    assert {k: f[k] for k in R.SCALARS} == R.DEFAULTS and f["issueTags"] == []


def test_r8_r9_comparison(spark):
    rich = facts_of(spark, "카카오톡과 인스타 DM으로 나체 사진을 여러 번 받았습니다.")
    row = lambda **k: spark.createDataFrame([({**R.DEFAULTS, "issueTags": [], **k}, {**rich})], "a struct<" + ",".join(f"{s}:string" for s in R.SCALARS) + ",issueTags:array<string>>, b struct<" + ",".join(f"{s}:string" for s in R.SCALARS) + ",issueTags:array<string>>")
    get = lambda **k: row(**k).select(R.compare_facts(F.col("b"), F.col("a")).alias("c")).first()["c"]
    c = get(messageForm="image")
    assert (c["comparableCount"], c["factScore"], c["issueScore"]) == (1, 0, 0)
    assert get(messageForm="image", medium="kakao")["factScore"] == 100
    assert get(messageForm="text", medium="kakao")["factScore"] == 50


def test_r12_r13_focus_f10(spark):
    names = ["성폭력범죄의처벌등에관한특례법위반(통신매체이용음란)", "통신매체이용음란·모욕", "통신매체이용음란, 13세미만미성년자강간", "모욕", None]
    assert [one(spark, n, R.focus) for n in names] == ["focused", "mixed", "peripheral", "focused", "focused"]
    assert [one(spark, n, lambda c: R.focus_penalty(R.focus(c))) for n in names[:3]] == [0, 15, 30]
    assert [one(spark, n, R.is_target_case) for n in ("통신매체이용음란", "통신매체 이용 음란")] == [True, False]


@pytest.mark.parametrize(
    "text, kind",
    [
        ("원심판결을 파기하고, 사건을 가온지방법원에 환송한다.", "remand"), ("상고를 기각한다.", "final_appeal_dismissed"), ("검사의 항소를 기각한다.", "appeal_dismissed"), ("피고인은 무죄.", "acquitted"),
        ("피고인을 징역 6월에 처한다.", "sentenced"), ("원심판결을 파기한다. 피고인을 벌금 300만 원에 처한다.", "reversed_and_sentenced"), ("피고인을 징역 1년에 처한다. 나머지는 무죄.", "multiple"), ("원고의 청구를 기각한다.", "civil"),
        ("이 사건 공소를 기각한다.", "other"), ("", "other"), (None, "other"),
    ],
)
def test_x13_orders(spark, text, kind):
    assert one(spark, text, R.order_kind) == kind


def test_x11_enumeration(spark):
    assert one(spark, "성폭력처벌법 제13조는 말, 음향, 글, 그림, 영상 또는 물건을", R.is_enumeration) is True
    assert one(spark, "피고인은 글을 보냈다", R.is_enumeration) is False
