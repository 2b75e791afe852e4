"""Stored tags, backfill of summaries, sync of arrivals; validators over items of every type; pointers of versions."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from lexweave import session
from lexweave.operators import grounding, merge, workflows
from lexweave.schema import SCHEMAS

T0, T1 = dt.datetime(2026, 1, 1), dt.datetime(2026, 1, 2)
PRECEDENT = "id string, provider string, provider_record_id string, court string, case_number string, case_name string, decision_date date, official_url string, source_text string, source_hash string, collected_at timestamp, verified_at timestamp, link_checked_at timestamp, link_status int, searchable boolean"
ARRIVAL = "provider string, provider_record_id string, court string, case_number string, case_name string, decision_date date, official_url string, source_text string, source_hash string, raw_hash string, raw_payload string"
NAME, DAY = "성폭력범죄의처벌등에관한특례법위반(통신매체이용음란)", dt.date(2020, 1, 2)


def test_tags_are_made_where_text_or_rules_changed(spark):
    d = spark.createDataFrame([("a", "카카오톡 메시지"), ("b", None), ("c", "게임 채팅")], "id string, source_text string")
    tags, states = workflows.backfill_tags(d)
    assert {r.state for r in states.collect()} == {"new"} and {r.id: r.facts.medium for r in tags.collect()} == {"a": "kakao", "b": "unknown", "c": "game_chat"}
    old = tags.withColumn("extraction_version", F.when(F.col("id") == "c", "older").otherwise(F.col("extraction_version"))).withColumn("facts", F.col("facts").withField("medium", F.lit("kept")))
    more = d.where("id <> 'b'").withColumn("source_text", F.when(F.col("id") == "a", "카카오톡 메시지").otherwise(F.col("source_text"))).unionByName(spark.createDataFrame([("z", "")], "id string, source_text string"))
    tags, states = workflows.backfill_tags(more, old)
    assert dict(map(tuple, states.collect())) == {"a": "kept", "c": "renewed", "z": "new"}
    assert {r.id: r.facts.medium for r in tags.collect()} == {"a": "kept", "b": "kept", "c": "game_chat", "z": "unknown"}
    assert workflows.backfill_tags(d.limit(0), old)[1].count() == 0


class Adapter:
    model = "m"

    def summarize(self, paragraphs):
        if "넘어진다" in paragraphs[0]["body"]:
            raise RuntimeError("down")
        return json.dumps({"sentences": [{"text": " 짧은 요약 ", "paragraphIds": [paragraphs[0]["paragraph_id"]] if "인용" in paragraphs[0]["body"] else ["x"]}]})


def test_summaries_fail_one_by_one(spark):
    row = lambda i, **k: (i, "p", i, "법원", "1", k.get("name", NAME), DAY, "u", "t", k.get("hash", "h" + i), T0, k.get("verified", T0), T0, k.get("link", 200), k.get("searchable", True))
    rows = [row("ok"), row("down"), row("wild"), row("old"), row("done"), row("mixed", name=NAME + ", 협박"), row("bare"), row("off", searchable=False), row("gone", link=404), row("new", verified=None)]
    p = spark.createDataFrame(rows, PRECEDENT)
    body = {"ok": "인용한다", "down": "넘어진다", "old": "인용한다"}
    par = spark.createDataFrame([(r[0], f"p{k}", k, f"{body.get(r[0], '다른')} 통신매체 메시지 {k}") for r in rows if r[0] != "bare" for k in range(1, 4)] + [("bare", "p1", 1, "x")], "precedent_id string, paragraph_id string, ordinal int, body string")
    rights = spark.createDataFrame([("p", True, True)], "provider string, summary_allowed boolean, display_allowed boolean")
    kind = "precedent_id string, source_hash string, summary_version string, model string, sentences array<struct<text:string,paragraph_ids:array<string>>>, generated_at timestamp"
    stored = spark.createDataFrame([("done", "hdone", "grounded-v2", "m", [("s", ["p1"])], T0), ("old", "other", "grounded-v2", "m", [("s", ["p1"])], T0), ("off", "hoff", "grounded-v2", "m", [], T0)], kind)
    with pytest.raises(PermissionError):
        workflows.backfill_summaries(p, rights, par, stored, Adapter(), F.lit(T1))
    table, out = workflows.backfill_summaries(p, rights, par, stored, Adapter(), F.lit(T1), allow_external=True)
    assert {r.id: (r.state, r.error_code) for r in out.collect()} == {
        "ok": ("generated", None), "old": ("generated", None), "down": ("failed", "SUMMARY_FAILED"), "wild": ("failed", "UNKNOWN_PARAGRAPH"), "done": ("skipped", None), "mixed": ("skipped", None), "bare": ("failed", "SUMMARY_INPUT_REQUIRED"),
    }
    got = {r.precedent_id: r for r in table.collect()}
    assert set(got) == {"ok", "old", "done", "off"} and got["old"].source_hash == "hold" and got["ok"].sentences[0].text == "짧은 요약" and got["done"].generated_at == T0
    assert workflows.outcome_counts(out).first().asDict() == {"selected": 7, "generated": 2, "skipped": 2, "failed": 3}
    assert workflows.backfill_summaries(p, rights, par, stored, workflows.ExtractiveSummariser(), F.lit(T1))[1].where("state = 'generated'").count() == 5


def test_sync_publishes_all_or_nothing(spark, tmp_path):
    root = f"file://{tmp_path}/store"
    old = [("i1", "p", "1", "법원", "2020고단1", NAME, DAY, "u1", "t1", "h1", T0, T0, T0, 200, True), ("i2", "p", "2", "법원", "2020고단2", NAME, DAY, "u2", "t2", "h2", T0, T0, T0, 200, True)]
    docs = spark.createDataFrame([("d1", "s", "r0", "1", "h1", "{}", T0)], SCHEMAS["source_documents"])
    links = spark.createDataFrame([("i1", "d1", "u1", True)], "precedent_id string, source_document_id string, official_url string, is_primary boolean")
    merge.publish(spark, {"precedents": spark.createDataFrame(old, PRECEDENT), "source_documents": docs, "precedent_sources": links}, root, "v0")
    row = lambda r, n, h, **k: (k.get("provider", "p"), r, "법원", n, k.get("name", NAME), DAY, "u" + r, "t", h, h, "{}")
    rows = [row("1", "2020고단1", "h1"), row("2", "2020고단2", "other"), row("3", "2020고단3", "h3"), row("9", "2020고단1", "h9", provider="q"), row("4", "2020고단4", "h4", name="절도")]
    counts = workflows.run_sync(spark, root, spark.createDataFrame(rows, ARRIVAL), "s", "r1", "q", T0, T1)
    assert counts == {"fetched": 4, "n_new": 1, "n_changed": 1, "n_unchanged": 1, "n_duplicate": 1, "skipped": 1}
    t = merge.published(spark, root, ["precedents", "source_documents", "precedent_sources"])
    got = {r.provider_record_id: r for r in t["precedents"].collect()}
    assert set(got) == {"1", "2", "3"} and got["1"].verified_at == T0 and got["1"].searchable and got["2"].id == "i2" and got["2"].verified_at is None and not got["2"].searchable and got["3"].id
    d = {(r.external_id, r.raw_hash): r for r in t["source_documents"].collect()}
    assert len(d) == 4 and d["1", "h1"].id == "d1" and d["1", "h1"].sync_run_id == "r1" and d["1", "h1"].fetched_at == T1
    s = [(r.precedent_id, r.is_primary) for r in t["precedent_sources"].collect()]
    assert sorted(s) == sorted([("i1", True), ("i1", False), ("i2", True), (got["3"].id, True)])
    with pytest.raises(Exception):  # noqa: B017
        workflows.run_sync(spark, root, spark.createDataFrame([("p",)], "provider string"), "s", "r2", "q", T0, T1)
    assert merge.published(spark, root, ["precedents"])["precedents"].count() == 3
    runs = {r.id: (r.status, r.fetched_count, r.changed_count) for r in merge.published(spark, f"{root}/runs", ["sync_runs"])["sync_runs"].collect()}
    assert runs["r1"] == ("succeeded", 4, 2) and runs["r2"][0] == "failed"


def test_readers_always_find_a_version(spark, tmp_path):
    root = f"file://{tmp_path}/v"
    with pytest.raises(FileNotFoundError):
        merge.published(spark, root, ["t"])
    for n in range(12):
        merge.publish(spark, {"t": spark.range(n + 1)}, root, f"v{n}")
        assert merge.published(spark, root, ["t"])["t"].count() == n + 1
    (tmp_path / "v" / "_new-left").write_text("{")
    assert merge.published(spark, root, ["t"])["t"].count() == 12


@pytest.mark.parametrize(
    "payload, kept, dropped",
    [
        ('{"elementNotes": ["bad", {"id": "medium", "text": "카카오톡으로 보냈다"}]}', ["medium"], ["elementNote"]), ('{"elementNotes": [{"id": "medium", "text": 5}, null, 7, {"id": "medium", "text": "a"}, {"id": "medium", "text": "b"}]}', ["medium"], ["elementNote"] * 4),
        ('{"elementNotes": "x", "overview": ["123", 123, {"a": 1}, [1], "해당합니다"]}', [], ["overview"]), ("[]", [], ["payload"]), ("{", [], ["payload"]), (None, [], ["payload"]),
    ],
)
def test_v2_judges_item_by_item(spark, payload, kept, dropped):
    v = spark.createDataFrame([(payload,)], "p string").select(grounding.validate_analysis(F.col("p"), F.array(F.lit("x"))).alias("v")).first().v
    assert [n.id for n in v.elementNotes] == kept and sorted(v.dropped) == sorted(dropped) and all(t == "123" for t in v.overview)


def test_no_machine_local_folder_on_a_cluster():
    class Conf(dict):
        def get(self, k, d=None):
            return dict.get(self, k, d)

    class Context:
        master = "spark://host:7077"

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError):
        session.shared_dir(Session())
    Session.conf["spark.checkpoint.dir"] = "hdfs:///x"
    assert session.shared_dir(Session()) == "hdfs:///x"


def test_paged_source_asks_a_service_again(spark):
    """A service that is busy at first, lists its records in pages, and fails for good where it says so."""
    import http.server
    import threading

    from lexweave.sources.paged import PagedSource

    seen: dict[str, int] = {}

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):  # noqa: N802
            n = seen[self.path] = seen.get(self.path, 0) + 1
            page = int(self.path.split("page=")[1].split("&")[0]) if "page=" in self.path else 0
            status = 404 if self.path.startswith("/gone") else 503 if n == 1 else 200
            body = "" if n == 2 else json.dumps({"PrecSearch": {"totalCnt": "23", "prec": [{"n": (page - 1) * 10 + i} for i in range(10 if page < 3 else 3)]}})
            self.send_response(status)
            self.send_header("Retry-After", "0.01")
            self.end_headers()
            self.wfile.write(body.encode())

        def log_message(self, *a):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        at = f"http://127.0.0.1:{server.server_port}"
        spark.dataSource.register(PagedSource)
        load = lambda path, **o: spark.read.format("paged_records").options(url=at + path + "?page={page}&size={size}", page_size="10", wait="0.01", **o).load()
        got = sorted(json.loads(r.payload)["n"] for r in load("/list").collect())
        assert got == list(range(23)) and min(seen.values()) >= 3
        assert load("/few", limit="12").count() == 12
        with pytest.raises(Exception, match="HTTP_404"):
            load("/gone").collect()
    finally:
        server.shutdown()


def test_lookups_fail_one_by_one(spark):
    from lexweave.sources.paged import FetchError, lookup

    def get(i):
        if i == "b":
            raise FetchError("HTTP_404", terminal=True)
        return "{}"

    got = lookup(spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "id string"), "id", get).collect()
    assert {(r.id, r.payload, r.error_code) for r in got} == {("a", "{}", None), ("b", None, "HTTP_404")} and len(got) == 2


def test_verification_renews_what_hangs_on_records(spark):
    import hashlib

    text = "【주문】<br>피고인을 벌금 100만 원에 처한다.<br>【이유】<br>카카오톡 메시지를 보냈다. 통신매체를 이용하였다."
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    row = lambda i, **k: (i, k.get("provider", "p"), i, "법원", "1", NAME, DAY, k.get("url", "https://a.example/1"), text, k.get("hash", sha(text)), T0, T0, T0, k.get("link", 200), True)
    p = spark.createDataFrame([row("ok"), row("link", link=404), row("hash", hash="x"), row("rights", provider="q")], PRECEDENT)
    rights = spark.createDataFrame([("p", True, True, True, True)], "provider string, storage_allowed boolean, indexing_allowed boolean, summary_allowed boolean, display_allowed boolean")
    par = spark.createDataFrame([("hash", 1, "p009", "old"), ("ok", 1, "p009", "old"), ("away", 1, "p001", "stays")], "precedent_id string, ordinal int, paragraph_id string, body string")
    orders = spark.createDataFrame([("link", "old", ["p1"], "other", "order-v0"), ("ok", "old", ["p1"], "other", "order-v0")], "precedent_id string, order_text string, paragraph_ids array<string>, kind string, extraction_version string")
    tables = {"precedents": p, "precedent_paragraphs": par, "precedent_dispositions": orders}
    t, out = workflows.verify_stored(tables, rights, F.lit(T1), ["a.example"])
    got = {r.id: (r.verified_at, r.link_status, r.searchable) for r in t["precedents"].collect()}
    assert got == {"ok": (T1, 200, True), "link": (None, 404, False), "hash": (None, None, False), "rights": (T1, 200, False)}
    per = {r.precedent_id: r["count"] for r in t["precedent_paragraphs"].groupBy("precedent_id").count().collect()}
    assert set(per) == {"ok", "link", "rights", "away"} and per["ok"] == per["link"] == 4
    assert {(r.precedent_id, r.kind) for r in t["precedent_dispositions"].collect()} == {("ok", "sentenced"), ("rights", "sentenced")}
    assert {r.id: r.error_code for r in out.collect()} == {"ok": None, "link": "SOURCE_LINK_INVALID", "hash": "SOURCE_HASH_MISMATCH", "rights": "SOURCE_RIGHTS_REQUIRED"}
    t, _ = workflows.verify_stored({"precedents": p.limit(0), "precedent_paragraphs": par}, rights, F.lit(T1), ["a.example"])
    assert t["precedents"].count() == 0 and t["precedent_paragraphs"].count() == 3


def test_embeddings_in_batches_fail_one_by_one(spark):
    from lexweave.operators import embedding

    class Picky:
        model, size = "picky", 2

        def embed(self, texts):
            if any("x" in t for t in texts):
                raise RuntimeError
            return [[1.0, float("nan") if t == "n" else 2.0] for t in texts]

    d = spark.createDataFrame([(i, t) for i, t in enumerate(["a", "x", "n", None, "b"] * 40)], "id int, t string")
    got = embedding.backfill(d, "id", "t", Picky(), allow_external=True).collect()
    assert len(got) == 200
    for r in got:
        want = {1: "EMBEDDING_FAILED", 2: "EMBEDDING_VECTOR_INVALID"}.get(r.id % 5)
        assert r.error_code == want and (r.embedding is None) == (want is not None)
    one = embedding.HashingEmbedder(16)
    assert one.embed(["가나다라가나다", ""])[0] == one.embed(["가나다라가나다"])[0]
