"""Sections, retrieval, merge, verification, grounding, intake, quality, sources and streams on small fixtures."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from lexweave.functions import rules as R
from lexweave.operators import embedding, grounding, intake, merge, quality, search, sections, verify
from lexweave.schema import SCHEMAS
from lexweave.sources import paged, payloads
from lexweave.streaming import sessions

DAY = dt.datetime(2026, 1, 1)
FACTS = "struct<" + ",".join(f"{s}:string" for s in R.SCALARS) + ",additionalChannels:array<string>,issueTags:array<string>>"


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def paragraphs(spark, *bodies):
    return spark.createDataFrame([("d", i + 1, f"p{i + 1:03d}", b) for i, b in enumerate(bodies)], "doc string, ordinal int, paragraph_id string, body string")


def test_w2_w3_relevant_paragraphs(spark):
    p = paragraphs(spark, "하나", "통신매체이용음란", "셋", "넷", "성적 욕망", "여섯")
    assert [r.paragraph_id for r in sections.select_relevant(p, "doc").orderBy("ordinal").collect()] == [f"p00{i}" for i in range(1, 7)]
    assert sections.select_relevant(paragraphs(spark, "통신매체", "둘"), "doc").count() == 0
    got = sections.select_relevant(p, "doc", budget=12).orderBy("ordinal").collect()
    assert [r.body for r in got] == ["하나", "통신매체이용음란", "셋", "넷"][:3] + ["넷"]
    assert sections.select_relevant(p, "doc", budget=5).count() == 0  # fewer than three are left


def test_w4_order_section(spark):
    get = lambda *b: rows(sections.extract_orders(paragraphs(spark, *b), "doc").select("order_text", "paragraph_ids", "kind"))
    assert get("판결", "【주 문】", "피고인은  무죄.", "【이 유】", "x") == [("피고인은 무죄.", ["p002"[:3] + "3"], "acquitted")]
    assert get("【주문】 상고를 기각한다.", "둘째", "【이유】")[0][:2] == ("상고를 기각한다. 둘째", ["p001", "p002"])
    assert get("주문 없음") == [] and get("【주문】", "【이유】") == [] and get("【주문】", "가" * 1201) == []


def test_x12_document_facts(spark):
    p = paragraphs(spark, "카카오톡으로 통신매체를 이용하여", "성적인 욕설을 한 번 보냈다", "성폭력처벌법 제13조 통신매체 말 음향 글 그림 영상", "끝", "x", "y")
    r = sections.document_facts(p, "doc").first()
    assert (r.facts.medium, r.facts.expressionType, r.facts.repetition) == ("kakao", "insult_with_sexual_terms", "once")
    assert "p003" not in r.evidence.paragraphIds
    r = sections.document_facts(paragraphs(spark, "하나"), "doc").first()
    assert r.facts.medium == "unknown" and r.evidence.paragraphIds == []


def corpus(spark, *records):
    """records: id, case_name, text, day, facts, embedding"""
    data = [(i, "법원", "1", name, d, text, True, {**R.DEFAULTS, "additionalChannels": [], "issueTags": [], **f}, DAY, DAY, 200, v) for i, name, text, d, f, v in records]
    kind = f"id string, court string, case_number string, case_name string, decision_date date, source_text string, searchable boolean, facts {FACTS}, verified_at timestamp, link_checked_at timestamp, link_status int, embedding array<float>"
    return search.Corpus(spark.createDataFrame(data, kind))


QUERY = "게임 채팅창으로 성적인 욕설을 한 번 보냈습니다"
FULL = {"medium": "game_chat", "messageForm": "text", "recipientIdentification": "direct_account", "reachedRecipient": "yes", "relationship": "game_user", "context": "conflict", "expressionType": "insult_with_sexual_terms", "repetition": "once", "issueTags": ["통신매체", "도달", "성적표현", "분노", "단발성"]}
NAME = "통신매체이용음란"


class Unit:
    model, size = "unit", 2

    def embed(self, texts):
        return [[1.0, 0.0]]


class Broken(Unit):
    def embed(self, texts):
        raise RuntimeError("no")


def test_r5_r10_t3_lexical_path(spark):
    day = dt.date(2025, 1, 1)
    c = corpus(spark, ("a", NAME, "게임", day, FULL, None), ("b", NAME, "게임 게임 게임 게임 게임", day, FULL, None), ("c", NAME + "·모욕", "게임 " * 9, day, FULL, None), ("d", NAME + ", 강간", "게임 " * 9, day, FULL, None), ("e", "사기", "게임", day, FULL, None))
    got = c.search(QUERY)
    assert got.mode == "provisional_without_embeddings" and got.available.first()[0] == 4
    assert [(r.id, r.score) for r in got.rows.collect()] == [("b", 100), ("c", 85), ("d", 70), ("a", 64)]
    assert "normalizedText" not in got.query_facts
    assert c.search("주차장 이야기입니다").mode == "query_out_of_scope"
    with pytest.raises(ValueError, match="SEARCH_QUERY_REQUIRED"):
        c.search("  ")
    batch = spark.createDataFrame([("q1", QUERY), ("q2", "주차장 이야기")], "query_id string, text string")
    assert [(r.query_id, r.id) for r in search.search_batch(c.records, batch).orderBy(F.desc("score")).collect()] == [("q1", x) for x in "bcda"]


def test_r11_r15_t4_hybrid_path(spark):
    day = dt.date(2025, 1, 1)
    c = corpus(spark, ("a", NAME, "x", day, FULL, [0.8, 0.6]), ("b", NAME, "x", day, {}, [0.0, 1.0]))
    got = c.search(QUERY, F.lit(DAY), Unit())
    assert got.mode == "hybrid_embeddings" and [(r.id, r.score, r.semantic_score) for r in got.rows.collect()] == [("a", 91, 80)]
    assert c.search(QUERY, F.lit(DAY), Broken()).fallback_code == "EMBEDDING_FAILED"
    assert c.search(QUERY, F.lit(DAY + dt.timedelta(days=9)), Unit()).fallback_code == "NO_EMBEDDED_CANDIDATES"
    assert [search.clamp_limit(x) for x in (20, 0, None, "x", 3, -4)] == [5, 5, 5, 5, 3, 1]


def test_x14_x15_r7_f13_embedding(spark):
    a, b = "게임에서 욕설을 보냈다. 피고인은 유죄로 본다. 끝이다.", "게임에서 욕설을 보냈다. 피고인은 무죄로 본다. 끝이다."
    d = spark.createDataFrame([("a", a), ("b", b), ("c", None)], "id string, t string")
    got = {r[0]: r[1] for r in d.select("id", embedding.embedding_input(R.facts(F.col("t")), embedding.without_outcomes(F.col("t")))).collect()}
    assert got["a"] == got["b"] and got["a"].startswith(embedding.DOCUMENT_HEAD + "\nmedium: game_chat") and "유죄" not in got["a"]
    e = embedding.HashingEmbedder(8)
    out = {r.id: r for r in embedding.backfill(d, "id", "t", e).collect()}
    assert len(out["a"].embedding) == 8 and out["a"].error_code is None
    with pytest.raises(PermissionError):
        embedding.backfill(d, "id", "t", Unit())
    assert embedding.backfill(d, "id", "t", Broken(), allow_external=True).where("error_code = 'EMBEDDING_FAILED'").count() == 3
    v = spark.createDataFrame([([1.0],), ([1.0, float("nan")],), ([1.0, None],), (None,), ([1.0, 2.0],)], "v array<float>")
    assert [r[0] for r in v.select(embedding.is_vector(F.col("v"), 2)).collect()] == [False] * 4 + [True]
    s = spark.createDataFrame([("m", "h", "s", "h", "s", [1.0]), ("m", "h", "s", "h2", "s", [1.0])], "embedding_model string, embedding_input_hash string, embedding_source_hash string, input_hash string, source_hash string, embedding array<float>")
    assert embedding.stale(s, "m").count() == 1


def test_x18_j9_states_dml1_dml4(spark):
    kind = "id string, provider string, provider_record_id string, court string, case_number string, decision_date string, source_hash string"
    old = spark.createDataFrame([("o1", "p", "1", "c", "n", "d", "h1"), ("o2", "p", "2", "c", "m", "d", "h2")], kind)
    new = spark.createDataFrame([("n1", "p", "1", "c", "n", "d", "h1"), ("n2", "p", "2", "c", "m", "d", "h9"), ("n3", "q", "7", "c", "n", "d", "h1"), ("n4", "q", "8", "c", None, "d", "h")], kind)
    got = merge.existing_matches(new, old)
    assert rows(got.select("id", "state", "existing_id")) == [("n1", "unchanged", "o1"), ("n2", "changed", "o2"), ("n3", "duplicate", "o1"), ("n4", "new", None)]
    assert tuple(merge.state_counts(got).first()) == (4, 1, 1, 1, 1)
    t = spark.createDataFrame([("1", "h1", 200, True), ("2", "h2", 200, True), ("3", "h3", None, False)], "k string, source_hash string, link_status int, searchable boolean")
    s = spark.createDataFrame([("1", "h1"), ("2", "h9"), ("4", "h4")], "k string, source_hash string")
    assert rows(merge.upsert_records(t, s, ["k"])) == [("1", "h1", 200, True), ("2", "h9", None, False), ("3", "h3", None, False), ("4", "h4", None, False)]
    src = spark.createDataFrame([("o1", "s1", "u", True)], "precedent_id string, source_document_id string, official_url string, is_primary boolean")
    arr = spark.createDataFrame([("o1", "s2", "u", "changed"), ("o1", "s3", "u", "duplicate")], "precedent_id string, source_document_id string, official_url string, state string")
    assert rows(merge.rotate_primary(src, arr).select("source_document_id", "is_primary")) == [("s1", False), ("s2", True), ("s3", False)]


def test_dml5_to_dml11(spark, tmp_path):
    t = spark.createDataFrame([("1", "a"), ("2", "b")], "k string, v string")
    assert rows(merge.insert_missing(t, spark.createDataFrame([("1", "x"), ("3", "c")], "k string, v string"), ["k"])) == [("1", "a"), ("2", "b"), ("3", "c")]
    assert rows(merge.replace_children(t, spark.createDataFrame([("2", "z")], "k string, v string"), "k", t.select("k"))) == [("2", "z")]
    ids = spark.createDataFrame([("2",), ("2",)], "id string")
    kept, report = merge.delete_cascade({"t": (t, "k")}, ids)
    assert kept["t"].count() == 2 and rows(report) == [("t", 2, 1, 0)]
    kept, report = merge.delete_cascade({"t": (t, "k")}, ids, confirm=True)
    assert rows(kept["t"]) == [("1", "a")] and rows(report) == [("t", 2, 1, 1)]
    log = merge.run_row(spark, "r", "s", "q", "running", DAY).unionByName(merge.run_row(spark, "r", "s", "q", "succeeded", DAY, DAY, 3, 1))
    assert [r.status for r in merge.current_runs(log).collect()] == ["succeeded"]
    root = f"file://{tmp_path}/w"
    for v, df in (("1", t), ("2", kept["t"])):
        merge.publish(spark, {"t": df}, root, v)
    assert rows(merge.published(spark, root, ["t"])["t"]) == [("1", "a")]


def test_f7_f8_f9_verification(spark):
    url, text = "https://www.law.go.kr/x", "<p>본문</p>"
    import hashlib

    h = hashlib.sha256(text.encode()).hexdigest()
    data = [("ok", "p", url, text, h, 200), ("host", "p", "https://law.go.kr.evil.test/x", text, h, 200), ("hash", "p", url, text, "0", 200), ("link", "p", url, text, h, 404), ("rights", "q", url, text, h, 200), ("meta", "p", url, None, h, 200), ("null", "p", url, text, h, None)]
    r = spark.createDataFrame([(i, p, "c", "n", DAY.date(), u, t, x, s) for i, p, u, t, x, s in data], "id string, provider string, court string, case_number string, decision_date date, official_url string, source_text string, source_hash string, link_status int")
    rights = verify.rights_record(spark, "p", "https://x", approved=True, key="k", reviewed_at=DAY)
    v = verify.verify(r, rights)
    assert rows(v.select("id", "error_code", "searchable")) == [
        ("hash", "SOURCE_HASH_MISMATCH", False), ("host", "SOURCE_URL_INVALID", False), ("link", "SOURCE_LINK_INVALID", False), ("meta", "SOURCE_METADATA_MISSING", False), ("null", "SOURCE_LINK_INVALID", False),
        ("ok", None, True), ("rights", "SOURCE_RIGHTS_REQUIRED", False),
    ]
    assert tuple(verify.verification_counts(v).first()) == (7, 2, 1, 5, 1)
    assert rows(verify.verified_paragraphs(r, v).select("precedent_id", "paragraph_id", "body")) == [("ok", "p001", "본문"), ("rights", "p001", "본문")]
    with pytest.raises(ValueError):
        verify.rights_record(spark, "p", "u", approved=False, key="k", reviewed_at=DAY)


@pytest.mark.parametrize(
    "payload, error",
    [
        ({"sentences": [{"text": "피고인이 글을 보냈다.", "paragraphIds": ["p001", "p001"]}]}, None), ({"sentences": []}, "SENTENCE_COUNT"), ({"sentences": [{"text": "x", "paragraphIds": ["p001"]}], "more": 1}, "FORM"),
        ({"sentences": [{"text": "x"}]}, "SENTENCE_FORM"), ({"sentences": [{"text": "처벌이 가능합니다", "paragraphIds": ["p001"]}]}, "NOT_NEUTRAL"), ({"sentences": [{"text": "x", "paragraphIds": []}]}, "CITATION_COUNT"),
        ({"sentences": [{"text": "x", "paragraphIds": ["p009"]}]}, "UNKNOWN_PARAGRAPH"), ({"sentences": [{"text": "가" * 501, "paragraphIds": ["p001"]}]}, "NOT_NEUTRAL"), ("{broken", "FORM"), (None, "FORM"),
    ],
)
def test_v1_summaries(spark, payload, error):
    text = payload if payload is None or isinstance(payload, str) else json.dumps(payload, ensure_ascii=False)
    d = spark.createDataFrame([(text, ["p001", "p002"])], "j string, ok array<string>").select(grounding.validate_summary(F.col("j"), F.col("ok")).alias("v")).first()["v"]
    assert d["error"] == error and (d["sentences"] is None) == (error is not None)
    if error is None:
        assert d["sentences"][0]["paragraphIds"] == ["p001"]


def test_v2_w6_analysis(spark):
    j = {
        "overview": ["사실이 비슷하다", "구성요건에 해당합니다", ""], "elementNotes": [{"id": "medium", "text": "성립합니다"}, {"id": "medium", "text": "게임 채팅"}, {"id": "medium", "text": "둘째"}, {"id": "other", "text": "x"}],
        "precedentNotes": [{"caseNumber": "1", "text": "법원은 유죄로 성립한다고 보았다"}, {"caseNumber": "9", "text": "x"}, {"caseNumber": "1", "text": "귀하의 사건은 성립"}], "nextSteps": ["기록을 모은다"],
    }
    f = lambda x: spark.createDataFrame([(x, ["1"])], "j string, ok array<string>").select(grounding.validate_analysis(F.col("j"), F.col("ok")).alias("v")).first()["v"]
    v = f(json.dumps(j, ensure_ascii=False))
    assert v["overview"] == ["사실이 비슷하다"] and [tuple(x) for x in v["elementNotes"]] == [("medium", "게임 채팅")]
    assert [tuple(x) for x in v["precedentNotes"]] == [("1", "법원은 유죄로 성립한다고 보았다")] and v["nextSteps"] == ["기록을 모은다"]
    assert sorted(v["dropped"]) == ["elementNote"] * 3 + ["overview"] + ["precedentNote"] * 2
    assert f("no object")["dropped"] == ["payload"] and f(None)["dropped"] == ["payload"]


def test_x16_x17_v6_st_intake(spark):
    q = [{"id": "q1", "field": "medium", "prompt": "?"}, {"id": "q2", "field": "x", "prompt": "?"}]
    s = spark.createDataFrame([(1, q, {"q1": " 네 ", "q2": "둘", "q9": "x"}), (2, q, {"q1": "네", "q2": " "}), (3, q, None)], "id int, questions array<struct<id:string,field:string,prompt:string>>, answers map<string,string>")
    got = {r.id: r.a for r in s.select("id", intake.accepted_answers(F.col("questions"), F.col("answers")).alias("a")).collect()}
    assert got[1].answers == {"q1": "네", "q2": "둘"} and got[1].error is None
    assert got[2].error == got[3].error == "INTAKE_ANSWER_REQUIRED"
    f = spark.createDataFrame([({**R.DEFAULTS, "medium": "kakao", "reachedRecipient": "no", "additionalChannels": [], "issueTags": []},)], f"f {FACTS}")
    assert [x.field for x in f.select(intake.questions(F.col("f")).alias("q")).first().q] == ["expressionType", "recipientIdentification", "relationship"]
    assert [x.mention for x in f.select(grounding.element_mentions(F.col("f")).alias("e")).first().e] == ["unclear", "present", "unclear", "absent"]
    o = intake.open_session(spark.createDataFrame([("a",)], "id string"), F.lit(DAY))
    at = F.lit(DAY + dt.timedelta(hours=1))
    kept, gone = intake.purge(o, at)
    assert (kept.count(), gone.first()[0], intake.unexpired(o, at).count(), intake.unexpired(o, F.lit(DAY)).count()) == (0, 1, 0, 1)


def test_a7_a10_src13_r21_r22_quality(spark):
    cases = [(["a"], ["a"], [], False), (["b", "a", "x"], ["a"], ["x"], False), ([], [], [], True)]
    m = quality.quality_metrics(spark.createDataFrame(cases, "found array<string>, expected array<string>, forbidden array<string>, expect_empty boolean")).first()
    assert tuple(m) == (3, 50.0, 100.0, 33.33, 100.0, 1)
    assert tuple(quality.quality_metrics(spark.createDataFrame([], "found array<string>, expected array<string>, forbidden array<string>, expect_empty boolean")).first()) == (0, 0.0, 0.0, 0.0, 0.0, 0)
    runs = spark.createDataFrame([("m", None, 10.0, 5, 0), ("m", "E", 30.0, 7, 2)], "model string, error_code string, latency_ms double, tokens int, n_dropped int")
    assert rows(quality.model_comparison(runs)) == [("m", 1, 1, 20.0, 12, 2)]
    kind = f"ordinal int, id string, provider_record_id string, court string, case_number string, case_name string, decision_date string, official_url string, verified_at string, verified boolean, summary array<struct<text:string,sourceAnchor:string>>, facts {FACTS}, keywords array<string>, issue_tags array<string>"
    base = lambda i, n, url="https://www.law.go.kr/a", ok=True, **f: (i, f"r{i}", "1", "c", n, "x", "d", url, "v", ok, [("t", "a")], {**R.DEFAULTS, "additionalChannels": [], "issueTags": [], **f}, ["게임", "욕설"], ["통신매체"])
    c = spark.createDataFrame([base(1, "n1", **{k: v for k, v in FULL.items() if k != "issueTags"}), base(2, "n2", medium="bank_transfer"), base(3, "n2", "http://x/", False)], kind)
    assert rows(quality.static_violations(c)) == [("r3", "duplicate"), ("r3", "not-verified"), ("r3", "untrusted-url")]
    assert [r.id for r in quality.static_rank(c, F.lit(QUERY), most=1).collect()] == ["r1"]
    assert quality.static_rank(c, F.lit("주차장 이야기")).count() == 0
    pairs = spark.createDataFrame([([("medium", "a", "kakao"), ("context", "a", "zzz")],)], "p array<struct<field:string,queryValue:string,precedentValue:string>>")
    assert pairs.select(quality.fact_labels(F.col("p"), {("medium", "kakao"): "카카오톡"})).first()[0] == ["카카오톡"]
    d = spark.createDataFrame([("a", "kakao"), ("b", "fax"), ("c", None)], "id string, medium string")
    assert rows(quality.domain_violations(d, "id")) == [("b", "medium", "fax"), ("c", "medium", None)]


def test_r17_r18_stored(spark):
    kind = "n string, v string, s array<struct<text:string,paragraph_ids:array<string>>>"
    good = [(" t ", ["p001", "p002"])]
    d = spark.createDataFrame([(NAME, "grounded-v2", good), (NAME, "grounded-v1", good), (NAME + "·모욕", "grounded-v2", good), (NAME, "grounded-v2", [("t", [None])]), (NAME, "grounded-v2", []), (NAME, "grounded-v2", None)], kind)
    got = [r[0] for r in d.select(search.stored_summary(F.col("n"), F.col("v"), F.col("s"))).collect()]
    assert tuple(got[0][0]) == ("t", "판결문 문단 p001, 판결문 문단 p002") and got[1:] == [None] * 5
    o = spark.createDataFrame([(" x ", "remand"), ("x", "odd"), (" ", "remand")], "t string, k string")
    assert [r[0] is not None for r in o.select(search.stored_order(F.col("t"), F.col("k"))).collect()] == [True, False, False]


def test_src1_src2_src4_to_src8_sources(spark, tmp_path):
    rec = lambda i: {"판례일련번호": str(i), "사건번호": "n", "사건명": "x", "법원명": "c", "선고일자": "20260312"}
    d = spark.createDataFrame([(json.dumps({"PrecSearch": {"totalCnt": 2, "prec": [rec(1), {"사건명": "x"}]}}),), (json.dumps({"PrecSearch": {"prec": {"ID": 7, "선고일": "2026.03.12"}}}),), ("{}",)], "p string")
    assert rows(payloads.parse_list(d, "p").select("provider_record_id", "decision_date")) == [("1", "2026-03-12"), ("7", "2026-03-12")]
    full = {"PrecService": {"판례정보일련번호": "5", "사건번호": "n", "사건명": "x", "법원명": "c", "선고일자": "20260312", "판례내용": "본문"}}
    d = spark.createDataFrame([(json.dumps(full),), (json.dumps({"판례": {"본문": "b"}}),)], "p string")
    got = payloads.parse_detail(d, "p").collect()
    assert got[0].missing == [] and got[0].official_url.endswith("precSeq=5") and len(got[0].source_hash) == 64
    assert got[1].missing == ["providerRecordId", "court", "caseNumber", "caseName", "decisionDate"]
    law = {"법령": {"기본정보": {"법령명_한글": "특례법", "시행일자": "20260101"}, "조문": {"조문단위": [{"조문번호": "12", "조문제목": "가", "조문내용": "x"}, {"조문번호": "13", "조문제목": "나", "조문내용": "<b>제13조</b>  본문"}]}}}
    a = payloads.parse_statute(spark.createDataFrame([(json.dumps(law),)], "p string"), "p", "L", "13").first()
    assert (a.article_title, a.body, a.enforced_on, a.missing) == ("나", "제13조 본문", "2026-01-01", [])
    for n in (1, 2):
        (tmp_path / f"page-{n}.json").write_text(json.dumps({"PrecSearch": {"totalCnt": 3, "prec": [rec(n * 10), rec(n * 10 + 1)] if n == 1 else rec(20)}}), encoding="utf-8")
    spark.dataSource.register(paged.PagedSource)
    pages = spark.read.format("paged_records").option("root", str(tmp_path)).load()
    assert [r.page for r in pages.orderBy("page", "payload").collect()] == [1, 1, 2]
    asked = []
    read_page = lambda total: lambda page, size: (asked.append(page), ([0] * min(size, max(0, 230 - (page - 1) * size)), total))[1]
    assert len(paged.walk(read_page(230), 1000)) == 230 and asked == [1, 2, 3]
    asked.clear()
    assert len(paged.walk(read_page(230), 40)) == 40 and asked == [1]
    assert paged.walk(lambda p, s: ([], 999), 50) == []
    answers = iter([(503, "", {"Retry-After": "2"}), (200, "<html>", {}), (200, '{"a":1}', {})])
    waited = []
    assert paged.fetch(lambda: next(answers), sleep=waited.append) == '{"a":1}' and waited[0] == 2.0
    with pytest.raises(paged.FetchError, match="HTTP_404"):
        paged.fetch(lambda: (404, "", {}), sleep=waited.append)


def test_st4_st5_streams(spark, tmp_path):
    src = spark.createDataFrame([("a", DAY), ("a", DAY + dt.timedelta(minutes=5)), ("b", DAY + dt.timedelta(hours=3)), ("c", DAY + dt.timedelta(hours=9))], "id string, created_at timestamp")
    src.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(src.schema).parquet(f"{tmp_path}/in")
    q = sessions.expiring_sessions(stream).writeStream.format("memory").queryName("sess").outputMode("append").option("checkpointLocation", f"{tmp_path}/c1").start()
    try:
        q.processAllAvailable()
        got = {(r.id, r.state) for r in spark.sql("SELECT * FROM sess").collect()}
    finally:
        q.stop()
    assert {("a", "open"), ("b", "open"), ("c", "open")} <= got
    stored = {}
    table = spark.createDataFrame([("a", DAY), ("z", DAY)], "id string, created_at timestamp")
    q = sessions.upsert_batches(stream, lambda: table, lambda df, n: stored.setdefault(n, rows(df)), ["id"], "created_at").option("checkpointLocation", f"{tmp_path}/c2").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert [r[0] for r in stored[0]] == ["a", "b", "c", "z"] and stored[0][0][1] == DAY + dt.timedelta(minutes=5)


def test_schemas_parse(spark):
    for name, ddl in SCHEMAS.items():
        assert spark.createDataFrame([], ddl).count() == 0, name


def fake_client(method, url, headers):
    if "boom" in url:
        raise OSError
    if "away" in url:
        return 200, "https://evil.test/"
    return (405 if method == "HEAD" and "get" in url else 404 if "gone" in url else 206 if headers else 200), url


def test_src11_links(spark):
    from lexweave.sources import links

    urls = ["https://a.kr/ok", "https://a.kr/get", "https://a.kr/gone", "https://a.kr/away", "https://a.kr/boom", "http://a.kr/ok", "https://b.kr/", "x", None]
    assert [links.link_status(u, fake_client, {"a.kr"}) for u in urls] == [200, 206, 404, 0, 0, 0, 0, 0, 0]
    df = spark.createDataFrame([(u,) for u in urls[:2] * 2], "u string")
    assert rows(links.probe(df, "u", fake_client, {"a.kr"})) == [("https://a.kr/get", 206), ("https://a.kr/ok", 200)]


def test_v7_f12_r23(spark):
    d = spark.createDataFrame([("a", "c", "n", "x", DAY.date(), "https://law.go.kr/1"), ("b", "c", " ", "x", DAY.date(), "https://law.go.kr/1"), ("c", "c", "n", "x", None, "https://law.go.kr/1"), ("d", "c", "n", "x", DAY.date(), "ftp://law.go.kr/1")], "id string, court string, case_number string, case_name string, decision_date date, official_url string")
    assert [r.id for r in search.identified(d, verify.OFFICIAL_HOSTS).collect()] == ["a"]
    j = d.limit(1).select(grounding.analysis_input(F.lit("s"), F.array(F.lit("e")), F.lit("t"), F.array(F.struct("id"))).alias("j")).first().j
    assert json.loads(j) == {"statute": "s", "elements": ["e"], "description": "t", "precedents": [{"id": "a"}]}


def test_w3_registered_with_the_own_bounds(spark, tmp_path):
    import oracle
    from lexweave.plans import retrieval

    docs = {"long": ["가" * 700, "통신매체", "나" * 39_000, "통신매체", "다" * 900, "통신매체"], "two": ["통신매체", "둘"], "three": ["하나", "통신매체", "셋"]}
    p = [(d, f"p{i:03d}", i, b) for d, bodies in docs.items() for i, b in enumerate(bodies, 1)]
    spark.createDataFrame(p, "precedent_id string, paragraph_id string, ordinal int, body string").write.parquet(f"{tmp_path}/precedent_paragraphs.parquet")
    con = oracle.connect(str(tmp_path))
    for name in ("relevant_paragraphs_whole", "summary_estimate_whole"):
        assert oracle.compare(retrieval.QUERIES[name](spark, str(tmp_path)), con, retrieval.ORACLE[name]) == ""
    got = rows(retrieval.QUERIES["relevant_paragraphs_whole"](spark, str(tmp_path)))
    assert got == [("long", "p001", 700), ("long", "p002", 4), ("long", "p003", 39_000), ("long", "p004", 4), ("long", "p005", 292), ("three", "p001", 2), ("three", "p002", 4), ("three", "p003", 1)]


def test_vector_queries_are_every_hundredth_vector(spark, tmp_path):
    import random

    import oracle
    from lexweave.plans import retrieval

    rng = random.Random(3)
    vectors = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(701)]
    spark.createDataFrame(list(enumerate(vectors)), "vec_id bigint, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    spark.read.parquet("/root/testdata/sf0.001/precedents.parquet").write.parquet(f"{tmp_path}/precedents.parquet")
    con = oracle.connect(str(tmp_path))
    for name in ("semantic_topk_batch", "hybrid_rank_batch"):
        got = retrieval.QUERIES[name](spark, str(tmp_path))
        assert oracle.compare(got, con, retrieval.ORACLE[name]) == ""
        assert {r.query_id for r in got.collect()} == set(range(0, 701, 100)), name
    norm = lambda v: sum(x * x for x in v) ** 0.5
    near = sorted(range(701), key=lambda i: -sum(x * y for x, y in zip(vectors[600], vectors[i])) / norm(vectors[i]))[:20]
    assert {r.vec_id for r in retrieval.semantic_topk_batch(spark, str(tmp_path)).where("query_id = 600").collect()} == set(near)
