"""Queries of validators over malformed payloads, stored tags, backfills, sync and the smaller functions, and their SQL."""

from __future__ import annotations

import datetime as dt
import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions import text as X
from ..operators import embedding, grounding, merge, quality, search, verify, workflows
from ..operators.sections import MAX_ORDER
from ..schema import ORDER_KINDS
from ..session import read, stage_path
from ..sources import payloads
from ..sources.links import probe
from ..sources.paged import FetchError, PagedSource, lookup
from ..streaming.sessions import upsert_batches
from .oracle_parts import SPACE, compare_sql, facts_sql, focus_sql, paragraphs_sql, quoted
from .records import _BATCH, _OFFICIAL, _VERIFY, HOSTS, _batches, _rights
from .retrieval import _picked
from .stored import stored_tags, with_stored_facts

AS_OF = "2026-02-01 00:00:00"
NOTE = "기록에 나타난 사실만 적는다."


# --- payloads of models -------------------------------------------------------------------------------------------------


def _sessions(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "intake_sessions").select("id", F.coalesce("redacted_text", F.lit("")).alias("t")).distinct()


def _json(c: str) -> str:
    """SQL of both engines for a text as a JSON string."""
    for code, to in ((92, "/"), (34, "~"), *((k, " ") for k in (9, 10, 11, 12, 13))):
        c = f"replace({c}, chr({code}), '{to}')"
    return f"concat('\"', {c}, '\"')"


def _analysis_json() -> str:
    t, i = _json("t"), _json("substr(id, 1, 4)")
    note = f'"{NOTE}"'
    return (
        f"""concat('{{"overview": [', {t}, ', 5, {{"a": 1}}, "해당합니다", null, "  ", {note}], "elementNotes": ["bad", {{"id": "medium", "text": ', {t}, '}}, {{"id": "medium", "text": {note}}}, {{"id": "purpose", "text": 7}},"""
        f""" {{"id": "nope", "text": {note}}}, {{"id": "reached", "text": "  {note[1:-1]} "}}], "precedentNotes": [{{"caseNumber": ', {i}, ', "text": ', {t}, '}}, 3, {{"caseNumber": 12, "text": "{NOTE}"}}, {{"text": "x"}}],"""
        f""" "nextSteps": ', CASE WHEN substr(id, 1, 1) < '8' THEN concat('[', {t}, ', ["x"], {note}]') ELSE '"none"' END, CASE WHEN substr(id, 2, 1) = '0' THEN '' ELSE '}}' END)"""
    )


def _analyses(spark: SparkSession, sf: str) -> DataFrame:
    return _sessions(spark, sf).select("id", F.expr(_analysis_json()).alias("payload"), F.array(F.substring("id", 1, 4), F.lit("12")).alias("allowed"))


def _shown(v: Column, dropped: bool) -> list[Column]:
    join = lambda c: F.coalesce(F.array_join(c, "|"), F.lit(""))
    notes = lambda c, k: join(F.transform(c, lambda n: F.concat(n[k], F.lit(":"), F.length(n["text"]).cast("string"))))
    out = [
        join(F.transform(v["overview"], lambda t: F.length(t).cast("string"))).alias("overview"), notes(v["elementNotes"], "id").alias("element_notes"),
        notes(v["precedentNotes"], "caseNumber").alias("precedent_notes"), join(F.transform(v["nextSteps"], lambda t: F.length(t).cast("string"))).alias("next_steps"),
    ]
    return [*out, join(v["dropped"]).alias("dropped")] if dropped else out


def malformed_analyses(spark: SparkSession, sf: str) -> DataFrame:
    """V2, W6. Every session's text in payloads with items of wrong types, strange ids, repeated elements, and broken ones."""
    return _analyses(spark, sf).select("id", grounding.validate_analysis(F.col("payload"), F.col("allowed")).alias("v")).select("id", *_shown(F.col("v"), True))


def client_analyses(spark: SparkSession, sf: str) -> DataFrame:
    """V5. The same payloads as a client reads them again."""
    return _analyses(spark, sf).select("id", grounding.client_analysis(F.col("payload"), F.col("allowed")).alias("v")).select("id", *_shown(F.col("v"), False))


def _summary_json() -> str:
    t, p = _json("t"), _json("substr(id, 1, 2)")
    text = f"CASE substr(id, 3, 1) WHEN '0' THEN '5' WHEN '1' THEN '{{}}' WHEN '2' THEN '\"\"' ELSE {t} END"
    ids = f"CASE substr(id, 4, 1) WHEN '0' THEN '[]' WHEN '1' THEN '[1]' WHEN '2' THEN '\"p\"' WHEN '3' THEN '[\"strange\"]' ELSE concat('[', {p}, ', \"p\", \"p\"]') END"
    item = f"CASE substr(id, 5, 1) WHEN '0' THEN '\"x\"' WHEN '1' THEN '{{\"text\": \"x\"}}' ELSE concat('{{\"text\": ', {text}, ', \"paragraphIds\": ', {ids}, '}}') END"
    return f"CASE substr(id, 6, 1) WHEN '0' THEN '[]' WHEN '1' THEN '{{\"sentences\": []}}' WHEN '2' THEN '{{\"sentences\": [1, ' ELSE concat('{{\"sentences\": [', {item}, ']}}') END"


def malformed_summaries(spark: SparkSession, sf: str) -> DataFrame:
    """V1. Every session's text as a sentence, in payloads that are wrong in many ways."""
    d = _sessions(spark, sf).select("id", F.expr(_summary_json()).alias("payload"), F.array(F.substring("id", 1, 2), F.lit("p")).alias("allowed"))
    v = grounding.validate_summary(F.col("payload"), F.col("allowed"))
    return d.select("id", v.alias("v")).select("id", F.coalesce("v.error", F.lit("")).alias("error"), F.coalesce(F.length(F.get("v.sentences", F.lit(0))["text"]), F.lit(0)).cast("bigint").alias("n"))


def neutral_texts(spark: SparkSession, sf: str) -> DataFrame:
    """V3."""
    c = F.col("body")
    return read(spark, sf, "precedent_paragraphs").where(c.isNotNull()).groupBy(grounding.is_neutral(c).alias("neutral"), grounding.is_neutral(c, True).alias("about_precedent")).agg(F.count(F.lit(1)).alias("n"))


def analysis_inputs(spark: SparkSession, sf: str) -> DataFrame:
    """V7. The document for the adapter, as its hash: the record's name and number with its description."""
    row = F.struct(F.coalesce("case_number", F.lit("")).alias("caseNumber"), F.coalesce("case_name", F.lit("")).alias("caseName"))
    doc = grounding.analysis_input(F.lit("13"), F.array(*[F.lit(e) for e in grounding.ELEMENTS]), F.coalesce("court", F.lit("")), F.array(row))
    return read(spark, sf, "precedents").select("id", X.sha256(doc).alias("input_hash"))


# --- stored tags, backfills, sync ---------------------------------------------------------------------------------------


def tag_backfill(spark: SparkSession, sf: str) -> DataFrame:
    """Tags of batch 0, some of another text or version of the rules, renewed for all records: what became of each."""
    p = read(spark, sf, "precedents")
    old = workflows.backfill_tags(p.where("batch_no = 0"), normalize=False)[0]
    old = old.withColumn("text_hash", F.when(F.col("id") < "2", "stale").otherwise(F.col("text_hash"))).withColumn("extraction_version", F.when(F.col("id") >= "e", "rule-v0").otherwise(F.col("extraction_version")))
    tags, states = workflows.backfill_tags(p, old, normalize=False)
    current = tags.where(F.col("extraction_version") == workflows.VERSION).select("id", F.col("facts.medium").alias("medium"))
    return states.join(current, "id")


def tagged_dispositions(spark: SparkSession, sf: str) -> DataFrame:
    """J1. Records with their stored tags and the kinds of their stored orders."""
    kinds = read(spark, sf, "precedent_dispositions").groupBy(F.col("precedent_id").alias("id")).agg(F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kinds"))  # kinds are a closed domain
    d = with_stored_facts(read(spark, sf, "precedents").select("id"), spark, sf).join(kinds, "id", "left")
    return d.select("id", F.col("facts.medium").alias("medium"), F.col("facts.context").alias("context"), F.coalesce("kinds", F.lit("")).alias("kinds"))


def summary_backfill(spark: SparkSession, sf: str) -> DataFrame:
    """F13, U2, U4. Summaries of all eligible records by the offline adapter: what became of each, and the sentences stored after it."""
    s = merge.latest(read(spark, sf, "precedent_summaries"), ["precedent_id"], [F.desc("generated_at"), F.asc("source_hash"), F.asc("summary_version"), F.asc("model")])
    par = read(spark, sf, "precedent_paragraphs").select("precedent_id", "paragraph_id", "ordinal", "body").distinct()
    adapter = workflows.ExtractiveSummariser()
    adapter.model = "model-small"
    p = read(spark, sf, "precedents").withColumn("searchable", F.col("verified_at").isNotNull())
    table, out = workflows.backfill_summaries(p, _rights(spark, sf), par, s, adapter, F.lit(AS_OF).cast("timestamp_ntz"), normalize=False)
    n = table.select(F.col("precedent_id").alias("id"), F.when(F.col("generated_at") == F.lit(AS_OF).cast("timestamp_ntz"), F.size("sentences")).otherwise(0).cast("bigint").alias("n_sentences"))
    return out.join(n, "id", "left").select("id", "state", F.coalesce("error_code", F.lit("")).alias("error_code"), F.coalesce("n_sentences", F.lit(0)).alias("n_sentences"))


def _synced(spark: SparkSession, sf: str) -> workflows.Synced:
    stored, later = _batches(spark, sf)
    raw = [F.col("source_hash").alias("raw_hash"), F.lit("{}").alias("raw_payload")]
    docs = stored.select(F.concat(F.lit("d-"), "id").alias("id"), F.lit("s1").alias("source_id"), F.lit("r0").alias("sync_run_id"), F.col("provider_record_id").alias("external_id"), *raw, F.col("collected_at").alias("fetched_at"))
    docs = merge.latest(docs, ["source_id", "external_id", "raw_hash"], [F.asc("id")])
    links = stored.select(F.col("id").alias("precedent_id"), F.concat(F.lit("d-"), "id").alias("source_document_id"), "official_url", F.lit(True).alias("is_primary"))
    arrivals = merge.latest(later.drop("id", "batch_no"), ["provider_record_id"], [F.asc("provider")]).withColumn("raw_hash", F.coalesce("source_hash", F.lit(""))).withColumn("raw_payload", F.lit("{}"))
    tables = {"precedents": stored.drop("batch_no"), "source_documents": docs, "precedent_sources": links}
    return workflows.sync(tables, arrivals, "s1", "r1", F.lit(AS_OF).cast("timestamp_ntz"), normalize=False)


def sync_summary(spark: SparkSession, sf: str) -> DataFrame:
    """DML1-DML4. The counts of a sync of all later batches into the first."""
    return _synced(spark, sf).counts()


def synced_records(spark: SparkSession, sf: str) -> DataFrame:
    """DML1. The records after it: which kept their verification."""
    d = _synced(spark, sf).tables["precedents"]
    return d.select("provider", "provider_record_id", "source_hash", F.col("verified_at").isNotNull().alias("verified"), "searchable", (F.col("collected_at") == F.lit(AS_OF).cast("timestamp_ntz")).alias("touched"))


def synced_sources(spark: SparkSession, sf: str) -> DataFrame:
    """DML3, DML4. Documents and sources after it."""
    t = _synced(spark, sf).tables
    d = t["source_documents"].groupBy("sync_run_id").agg(F.count(F.lit(1)).alias("n")).select(F.concat(F.lit("documents "), "sync_run_id").alias("what"), "n")
    s = t["precedent_sources"].groupBy("is_primary").agg(F.count(F.lit(1)).alias("n")).select(F.concat(F.lit("sources "), F.col("is_primary").cast("string")).alias("what"), "n")
    return d.unionByName(s)


def overwritten_summaries(spark: SparkSession, sf: str) -> DataFrame:
    """DML2, DML12. The last summary of each record over the first: every column is the newer one's."""
    s, order = read(spark, sf, "precedent_summaries").where("precedent_id <> ''"), [F.asc("source_hash"), F.asc("summary_version"), F.asc("model")]
    old = merge.latest(s, ["precedent_id"], [F.asc("generated_at"), *order])
    new = merge.latest(s, ["precedent_id"], [F.desc("generated_at"), *order])
    return merge.merge_upsert(old, new, ["precedent_id"]).select("precedent_id", "source_hash", "summary_version", "model", F.size("sentences").cast("bigint").alias("n_sentences"))


def verified_tables(spark: SparkSession, sf: str) -> DataFrame:
    """The verification of all records: how many rows each table has after it."""
    p = read(spark, sf, "precedents")
    par = read(spark, sf, "precedent_paragraphs").select("precedent_id", "ordinal", "paragraph_id", "body")
    old = read(spark, sf, "precedent_dispositions").select("precedent_id", "order_text", "paragraph_ids", "kind", "extraction_version")
    tables = {"precedents": p, "precedent_paragraphs": par, "precedent_dispositions": old}
    t, _ = workflows.verify_stored(tables, _rights(spark, sf), F.lit(AS_OF).cast("timestamp_ntz"), HOSTS, normalize=False)
    n = lambda d, what: d.agg(F.count(F.lit(1)).alias("n")).select(F.lit(what).alias("what"), "n")
    d = t["precedents"]
    parts = [n(d.where("verified_at IS NOT NULL"), "verified"), n(d.where("searchable"), "searchable"), n(d.where("link_status IS NOT NULL"), "link_status"), n(t["precedent_paragraphs"], "paragraphs"), n(t["precedent_dispositions"], "orders")]
    return reduce(DataFrame.unionByName, parts)


def pruned_tables(spark: SparkSession, sf: str) -> DataFrame:
    """DML8. The tables after the records outside the target are deleted with all that hangs on them."""
    p = read(spark, sf, "precedents")
    gone = p.where(~F.coalesce(F.col("case_name").contains(R.TARGET), F.lit(False))).select("id")
    tables = {"precedents": (p, "id")} | {t: (read(spark, sf, t), "precedent_id") for t in ("precedent_paragraphs", "precedent_dispositions", "precedent_summaries")}
    left, report = merge.delete_cascade(tables, gone, confirm=True)
    n = reduce(DataFrame.unionByName, [d.agg(F.count(F.lit(1)).alias("n_left")).select(F.lit(t).alias("table_name"), "n_left") for t, d in left.items()])
    return report.select("table_name", "deleted").join(n, "table_name")


def run_log(spark: SparkSession, sf: str) -> DataFrame:
    """DML10. Each delivery as a run that began and ended: the last row of a run stands for it."""
    d = read(spark, sf, "source_documents").where(F.col("sync_run_id").isNotNull()).groupBy("sync_run_id", "source_id").agg(F.min("fetched_at").alias("a"), F.max("fetched_at").alias("b"), F.count(F.lit(1)).cast("int").alias("n"))
    rows = lambda status, end, n: d.select(F.concat_ws("/", "sync_run_id", "source_id").alias("id"), F.lit(status).alias("status"), n.alias("fetched_count"), end.alias("completed_at"))
    log = rows("running", F.lit(None).cast("timestamp_ntz"), F.lit(0)).unionByName(rows("succeeded", F.col("b"), F.col("n")))
    return merge.current_runs(log).select("id", "status", F.col("fetched_count").cast("bigint").alias("fetched_count"))


# --- smaller functions ----------------------------------------------------------------------------------------------------


def article_parameters(spark: SparkSession, sf: str) -> DataFrame:
    """SRC3. Dates of orders read as article numbers: month and branch day."""
    o = read(spark, sf, "orders")
    c = F.concat(F.month("o_orderdate").cast("string"), F.when(F.dayofmonth("o_orderdate") > 9, F.concat(F.lit("-"), F.dayofmonth("o_orderdate").cast("string"))).otherwise(""))
    return o.select(c.alias("article"), X.article_parameter(c).alias("parameter")).distinct()


def _list_payload() -> str:
    return """concat('{"PrecSearch": {"totalCnt": "', cast(length(id) as string), '", "prec": [{"판례일련번호": "', provider_record_id, '", "사건번호": "x", "선고일자": "', replace(cast(decision_date as string), '-', '.'), '."}, {"사건명": "n"}]}}')"""


def list_records(spark: SparkSession, sf: str) -> DataFrame:
    """SRC1, SRC4. Records as list answers: entries without id are left out."""
    p = read(spark, sf, "precedents").where("decision_date IS NOT NULL AND provider_record_id <> ''").select(F.expr(_list_payload()).alias("payload"))
    out = payloads.parse_list(p, "payload")
    return out.groupBy("decision_date").agg(F.count(F.lit(1)).alias("n"), F.min("provider_record_id").alias("first_id"))


def statute_records(spark: SparkSession, sf: str) -> DataFrame:
    """SRC6, SRC14. Parts as statutes whose second article is asked for."""
    p = read(spark, sf, "part").select("p_partkey", F.expr("""concat('{"법령": {"기본정보": {"법령명_한글": "법 ', p_partkey, '", "시행일자": "20240', 1 + p_partkey % 9, '01"}, "조문": {"조문단위": [{"조문번호": "1", "조문내용": "a"}, {"조문번호": "', 12 + p_partkey % 2, '", "조문제목": "t", "조문내용": "<b>제 ', p_partkey, '</b> 조"}]}}}')""").alias("j"))
    d = payloads.parse_statute(p, "j", "L", "13")
    return d.select("law_name", "article_title", "body", "enforced_on", F.array_join("missing", ",").alias("missing"))


def body_states(spark: SparkSession, sf: str) -> DataFrame:
    """SRC9."""
    t = F.col("source_text")
    html = F.when(F.col("id") < "4", F.concat(F.lit(" \n<HTML lang=ko>"), t)).when(F.col("id") > "f", F.lit("  ")).otherwise(t)
    return read(spark, sf, "precedents").select(F.coalesce(X.body_state(html), F.lit("")).alias("state")).groupBy("state").agg(F.count(F.lit(1)).alias("n"))


def stable_ids(spark: SparkSession, sf: str) -> DataFrame:
    """S16."""
    return read(spark, sf, "nation").select("n_nationkey", X.stable_id(F.col("n_name"), F.col("n_nationkey").cast("string")).alias("stable_id"))


def clamped_limits(spark: SparkSession, sf: str) -> DataFrame:
    """T6. Of every nation's key as an asked limit."""
    n = F.col("n_nationkey").cast("int") - 5
    return read(spark, sf, "nation").select("n_nationkey", search.clamp_limit_column(n).cast("bigint").alias("used_limit"))


def shown_orders(spark: SparkSession, sf: str) -> DataFrame:
    """R18. Orders that may be shown: with text and a known kind."""
    d = read(spark, sf, "precedent_dispositions").select(search.stored_order(F.col("order_text"), F.when(F.col("kind") == "sentenced", "strange").otherwise(F.col("kind"))).alias("o"))
    return d.groupBy(F.col("o").isNotNull().alias("shown"), F.col("o.kind").alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("o.orderText")).alias("n_chars"))


def mapped_results(spark: SparkSession, sf: str) -> DataFrame:
    """R23, F12. Records as client results: a whole identity, an official address, clamped scores, a default focus."""
    p = read(spark, sf, "precedents").withColumns({"semantic_score": (F.length("source_text") - 500) / 7.0, "fact_score": F.length("case_name") * 11, "issue_score": F.lit(None).cast("double"), "score": F.lit(50), "focus": F.when(F.col("batch_no") > 0, "mixed").when(F.col("id") < "3", "odd")})
    d = search.client_results(p, [f"cases.{x}.example" for x in ("law-open-data", "court-archive", "bar-digest", "case-commons")])
    return d.select("id", "focus", "similarity.semantic", "similarity.facts", "similarity.issues", "similarity.total")


def gated_counts(spark: SparkSession, sf: str) -> DataFrame:
    """A1, R20. How many records the gate lets through."""
    return search.Corpus(read(spark, sf, "precedents"), normalize=False).gated().agg(F.count(F.lit(1)).alias("available_count"))


def shown_facts(spark: SparkSession, sf: str) -> DataFrame:
    """R24, R22. Stored facts without their text, and the labels of known media."""
    labels = {("medium", "kakao"): "카카오톡", ("medium", "game_chat"): "게임 채팅", ("context", "conflict"): "다툼"}
    f = R.public_facts(F.col("facts"))
    pairs = F.array(*[F.struct(F.lit(k).alias("field"), f[k].alias("precedentValue")) for k in ("medium", "context")])
    return stored_tags(spark, sf).select("id", F.array_join(quality.fact_labels(pairs, labels), ",").alias("labels"), F.to_json(f).contains("normalizedText").alias("has_text"))


def model_rollup(spark: SparkSession, sf: str) -> DataFrame:
    """A10. Events as runs of models."""
    e = read(spark, sf, "events").select(F.col("event_type").alias("model"), F.when(F.col("value") < 5, "E").alias("error_code"), F.col("value").alias("latency_ms"), (F.col("event_id") % 100).alias("tokens"), (F.col("event_id") % 3).alias("n_dropped"))
    return quality.model_comparison(e).withColumn("mean_latency_ms", F.round("mean_latency_ms", 4))


def curated_violations(spark: SparkSession, sf: str) -> DataFrame:
    """SRC13. Records read as a curated table."""
    p = read(spark, sf, "precedents")
    d = p.withColumns({"verified": F.col("searchable"), "summary": F.array(F.struct(F.when(F.col("id") > "8", "문단 1").otherwise("").alias("sourceAnchor")))})
    return quality.static_violations(d).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


def element_evidence(spark: SparkSession, sf: str) -> DataFrame:
    """X16. What every session says of each element, with its definition."""
    names = {"medium": "medium", "reachedRecipient": "reached_recipient", "expressionType": "expression_type"}
    f = F.struct(*[F.col(f"facts.{v}").alias(k) for k, v in names.items()])
    d = read(spark, sf, "intake_sessions").select("id", F.explode(grounding.mapped_elements(f)).alias("e")).distinct()
    return d.select("id", F.col("e.id").alias("element"), "e.mention", "e.evidence", F.length("e.statuteQuote").cast("bigint").alias("n"))


class _Analyst:
    """A stand-in for a model: it fails, answers with nonsense, or cites what it was given and what it was not."""

    def analyze(self, document: str, schema: dict) -> str:
        cases = schema["properties"]["precedentNotes"]["items"]["properties"]["caseNumber"].get("enum", [])
        kind = len(json.loads(document)["description"]) % 4
        if kind == 0:
            raise RuntimeError("down")
        if kind == 1:
            return "[]"
        return json.dumps({"overview": ["기록을 견주었다."], "precedentNotes": [{"caseNumber": c, "text": "법원이 살폈다."} for c in [*cases, "없는 번호"]]})


def adapter_analyses(spark: SparkSession, sf: str) -> DataFrame:
    """U3, U4, V2. Every record's case as a request to an adapter."""
    p = read(spark, sf, "precedents").select("id", F.coalesce("court", F.lit("")).alias("court"), F.array_compact(F.array("case_number")).alias("case_numbers"))
    row = F.struct(F.lit("x").alias("caseNumber"))
    d = p.select("id", "case_numbers", grounding.analysis_input(F.lit("13"), F.array(F.lit("purpose")), F.col("court"), F.array(row)).alias("document"))
    a = workflows.analyses(d, _Analyst(), allow_external=True)
    return a.select("id", F.coalesce("error_code", F.lit("")).alias("error_code"), F.coalesce(F.size("analysis.precedentNotes"), F.lit(0)).cast("bigint").alias("n_notes"), F.coalesce(F.size("analysis.dropped"), F.lit(0)).cast("bigint").alias("n_dropped"))


def paged_list(spark: SparkSession, sf: str) -> DataFrame:
    """SRC1, SRC8. The nations as a provider's pages in the shared folder, read by the data source."""
    root = stage_path(spark, "pages")
    rows = [r["n_name"] for r in read(spark, sf, "nation").orderBy("n_nationkey").collect()]  # 25 rows, as many as there are nations
    path, fs = merge._files(spark, root)
    for n in range(-(-len(rows) // 10)):
        out = fs.create(path(f"{root}/page-{n + 1}.json"), True)
        out.write(bytearray(json.dumps({"PrecSearch": {"totalCnt": len(rows), "prec": [{"사건명": x} for x in rows[n * 10 : n * 10 + 10]]}}).encode()))
        out.close()
    spark.dataSource.register(PagedSource)
    d = spark.read.format("paged_records").option("root", root).load()
    return d.select("page", F.get_json_object("payload", "$.사건명").alias("n_name"))


def _detail(record_id: str) -> str:
    if record_id.endswith("7"):
        raise FetchError("HTTP_404", terminal=True)
    return json.dumps({"PrecService": {"판례정보일련번호": record_id, "법원명": "법원 " + record_id[-2:]}}, ensure_ascii=False)


def looked_up_details(spark: SparkSession, sf: str) -> DataFrame:
    """SRC2. The detail of each listed record by id."""
    p = read(spark, sf, "precedents").select(F.trim("provider_record_id").alias("provider_record_id")).where("provider_record_id <> ''")
    got = lookup(p, "provider_record_id", _detail).withColumnRenamed("provider_record_id", "asked")
    d = payloads.parse_detail(got, "payload", F.col("asked"))
    return d.select("asked", F.coalesce("error_code", F.lit("")).alias("error_code"), "court")


def _answer(method: str, url: str, headers: dict) -> tuple[int, str]:
    kind = len(url) % 5
    if kind == 0:
        raise OSError
    if kind == 1:
        return 302, "https://elsewhere.example/"
    return (405 if method == "HEAD" and kind == 2 else 206 if headers else 200), url


def link_probes(spark: SparkSession, sf: str) -> DataFrame:
    """SRC11. Every distinct address, by a client that refuses HEAD, fails or leads away for some."""
    hosts = {f"cases.{x}.example" for x in ("law-open-data", "court-archive", "bar-digest", "case-commons")}
    return probe(read(spark, sf, "precedents"), "official_url", _answer, hosts)


def rights_records(spark: SparkSession, sf: str) -> DataFrame:
    """SRC15. A record of rights for each source."""
    names = [r["provider"] for r in read(spark, sf, "data_sources").select("provider").collect()]  # a configuration table
    rows = [verify.rights_record(spark, n, f"https://{n}.example/terms", approved=True, key="k", reviewed_at=dt.datetime(2026, 1, 2)) for n in names]
    d = reduce(DataFrame.unionByName, rows)
    return d.select("provider", "summary_allowed", "redistribution_allowed", "terms_version")


def published_tables(spark: SparkSession, sf: str) -> DataFrame:
    """DML11. Two versions published one after the other: the last one counts, with all of its tables."""
    root = stage_path(spark, "published")
    c, n = read(spark, sf, "customer"), read(spark, sf, "nation")
    merge.publish(spark, {"c": c.limit(0), "n": n}, root, "v1")
    merge.publish(spark, {"c": c, "n": n}, root, "v2")
    t = merge.published(spark, root, ["c", "n"])
    return t["c"].join(t["n"], F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.count(F.lit(1)).alias("n"))


def json_report(spark: SparkSession, sf: str) -> DataFrame:
    """DML13. A report as JSON."""
    d = read(spark, sf, "orders").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.max("o_orderdate").cast("date").cast("string").alias("last"))
    return d.select("o_orderstatus", F.to_json(F.struct("n", "last")).alias("report"))


DESCRIPTION = "카카오톡 메시지로 성적인 사진을 보냈다"
# The facts of DESCRIPTION, as ``facts`` gives them.
DESCRIBED = {
    "medium": "kakao", "messageForm": "image", "recipientIdentification": "direct_account", "reachedRecipient": "yes", "relationship": "unknown", "context": "unknown",
    "expressionType": "sexual_image", "repetition": "unknown", "issueTags": ["통신매체", "도달", "성적표현"],
}


def static_ranks(spark: SparkSession, sf: str) -> DataFrame:
    """R21, T5. Records as a curated table, ranked for one description."""
    p = with_stored_facts(read(spark, sf, "precedents").select("id", "court"), spark, sf)
    d = p.select("id", F.col("id").alias("ordinal"), "facts", F.array(F.when(F.col("id") < "8", "카카오톡").otherwise("게임"), F.lit("사진")).alias("keywords"), F.col("facts.issueTags").alias("issue_tags"))
    return quality.static_rank(d, F.lit(DESCRIPTION), 20, 50)


def search_modes(spark: SparkSession, sf: str) -> DataFrame:
    """R15, F6. The path each search takes: without vectors, with an adapter that fails, without candidates, out of scope."""

    class Down:
        def embed(self, texts):
            raise FetchError("EMBEDDING_DOWN")

    p = with_stored_facts(read(spark, sf, "precedents").withColumn("embedding", F.lit(None).cast("array<float>")), spark, sf)
    c, now = search.Corpus(p, normalize=False), F.lit(AS_OF).cast("timestamp_ntz")
    asked = [("lexical", DESCRIPTION, None), ("down", DESCRIPTION, Down()), ("empty", DESCRIPTION, embedding.HashingEmbedder(64)), ("outside", "날씨가 맑은 산책", None)]
    rows = [(name, r.mode, r.fallback_code or "", r.available is not None) for name, q, e in asked for r in [c.search(q, now, e)]]
    return spark.createDataFrame(rows, "name string, mode string, fallback_code string, has_count boolean")


def full_width_texts(spark: SparkSession, sf: str) -> DataFrame:
    """S1. Addresses in full-width letters come back as they were."""
    plain = "".join(map(chr, range(0x21, 0x7F)))
    wide = "".join(chr(ord(c) + 0xFEE0) for c in plain)
    return read(spark, sf, "documents").where("url IS NOT NULL").select("doc_id", X.nfkc(F.translate("url", plain, wide)).alias("url"))


def full_width_facts(spark: SparkSession, sf: str) -> DataFrame:
    """X1. Tags of words in full-width letters and combining forms."""
    words = F.when(F.col("event_type") == "click", "ＳＮＳ 멘션").when(F.col("event_type") == "view", "카카오톡").otherwise("ｘ")
    return read(spark, sf, "events").select("event_type", R.facts(words)["medium"].alias("medium")).groupBy("event_type", "medium").agg(F.count(F.lit(1)).alias("n"))


def streamed_upserts(spark: SparkSession, sf: str) -> DataFrame:
    """ST5. Events as a stream worked into a table of users by micro-batch: the last event of each stays."""
    root = stage_path(spark, "streamed")
    e = read(spark, sf, "events").select("event_id", "user_id", "event_type")
    versions: list[str] = []

    def load() -> DataFrame:
        return spark.read.parquet(versions[-1]) if versions else e.limit(0)

    def store(table: DataFrame, number: int) -> None:
        at = f"{root}/{number}"
        table.write.mode("overwrite").parquet(at)
        versions.append(at)

    path, fs = merge._files(spark, sf)
    source = spark.readStream.schema(read(spark, sf, "events").schema)
    whole = fs.getFileStatus(path(f"{sf}/events.parquet")).isDirectory()
    stream = (source.parquet(f"{sf}/events.parquet") if whole else source.option("pathGlobFilter", "events.parquet").parquet(sf)).select(*e.columns)
    upsert_batches(stream, load, store, ["user_id"], "event_id").option("checkpointLocation", f"{root}/log").trigger(availableNow=True).start().awaitTermination()
    return load().select("user_id", "event_id", "event_type")


def stale_embeddings(spark: SparkSession, sf: str) -> DataFrame:
    """F13. Vectors of another model, input or source."""
    e = read(spark, sf, "embeddings").select("vec_id", "embedding", F.lit("m").alias("source_hash"), F.col("label").cast("string").alias("input_hash"), F.when(F.col("vec_id") % 3 > 0, "a").otherwise("b").alias("embedding_model"))
    e = e.withColumns({"embedding_input_hash": F.when(F.col("vec_id") % 5 > 0, F.col("input_hash")), "embedding_source_hash": F.when(F.col("vec_id") % 7 > 0, "m").otherwise("n")})
    return embedding.stale(e, "a").select("vec_id")


QUERIES = {f.__name__: f for f in (
    malformed_analyses, client_analyses, malformed_summaries, neutral_texts, analysis_inputs, tag_backfill, tagged_dispositions, summary_backfill, sync_summary, synced_records, synced_sources, overwritten_summaries,
    run_log, verified_tables, pruned_tables, article_parameters, list_records, statute_records, body_states, stable_ids, clamped_limits, shown_orders, mapped_results, gated_counts, shown_facts, model_rollup, curated_violations,
    element_evidence, adapter_analyses, paged_list, looked_up_details, link_probes, rights_records, published_tables, json_report, static_ranks, search_modes, full_width_texts, full_width_facts, streamed_upserts, stale_embeddings,
)}

_TRIM = lambda c: f"regexp_replace({c}, '^{SPACE}+|{SPACE}+$', '', 'g')"
_VERDICT = lambda c: " OR ".join(f"regexp_matches({c}, {quoted(p)})" for p in grounding.VERDICTS)
_READER = lambda c: f"regexp_matches({c}, {quoted(grounding.READER)})"
_S = "s AS (SELECT DISTINCT id, coalesce(redacted_text, '') AS t FROM intake_sessions)"
_STR = lambda x, at: f"CASE WHEN json_type({x}, '{at}') = 'VARCHAR' THEN {_TRIM(f'json_extract_string({x}, {quoted(at)})')} END"
_LIST = lambda key: f"coalesce(json_extract(v, '$.{key}[*]'), []::JSON[])"
_NUMBERS = "('VARCHAR', 'BIGINT', 'UBIGINT', 'DOUBLE', 'BOOLEAN')"
_JOINED = lambda c, one: f"coalesce(array_to_string(list_transform({c}, lambda n: {one}), '|'), '')"
_ELEMENTS = ", ".join(quoted(e) for e in grounding.ELEMENTS)


def _analyses_sql(client: bool) -> str:
    texts = lambda key, most: f"list_filter(list_transform({_LIST(key)}, lambda x: {_STR('x', '$')}), lambda x: x IS NOT NULL AND length(x) > 0 AND length(x) <= {most})"
    kinds = "('VARCHAR')" if client else _NUMBERS
    notes = lambda key, name: f"list_transform({_LIST(key)}, lambda x: {{'k': CASE WHEN json_type(x, '$.{name}') IN {kinds} THEN json_extract_string(x, '$.{name}') END, 'x': {_STR('x', '$.text')}}})"
    most = (10**9, 10**9, 10**9) if client else (400, 200, 400)
    fits = f"n.x IS NOT NULL AND length(n.x) > 0 AND length(n.x) <= {most[2]}"
    neutral = "TRUE" if client else f"NOT ({_VERDICT('n.x')} OR {_READER('n.x')})"
    about = "TRUE" if client else f"NOT {_READER('n.x')}"
    plain = "TRUE" if client else f"NOT ({_VERDICT('x')} OR {_READER('x')})"
    first = "el" if client else "list_filter(el, lambda n, i: list_position(list_transform(el, lambda m: m.k), n.k) = i)"
    pr = "pr" if client else "list_slice(pr, 1, 6)"
    lengths = lambda c, n: _JOINED(f"list_slice(list_filter({c}, lambda x: {plain}), 1, {n})", "length(n)::VARCHAR")
    empty = lambda c: f"CASE WHEN v IS NULL THEN '' ELSE {c} END" if client else c
    dropped = (
        ", CASE WHEN v IS NULL THEN 'payload' ELSE rtrim(repeat('overview|', len(ov) - len(list_filter(ov, lambda x: " + plain + "))) || repeat('elementNote|', len(el_all) - len(el_kept)) "
        "|| repeat('precedentNote|', len(pr_all) - len(pr)) || repeat('nextStep|', len(st) - len(list_filter(st, lambda x: " + plain + "))), '|') END AS dropped"
    )
    return f"""WITH {_S}, p AS (SELECT id, {_analysis_json()} AS p, [substr(id, 1, 4), '12'] AS allowed FROM s),
      v AS (SELECT id, allowed, CASE WHEN json_valid(p) THEN p::JSON END AS v FROM p),
      l AS (SELECT id, allowed, v, {texts('overview', most[0])} AS ov, {texts('nextSteps', most[1])} AS st, {notes('elementNotes', 'id')} AS el_all, {notes('precedentNotes', 'caseNumber')} AS pr_all FROM v),
      f AS (SELECT *, list_filter(el_all, lambda n: n.k IN ({_ELEMENTS}) AND {fits} AND {neutral}) AS el, list_filter(pr_all, lambda n: list_contains(allowed, n.k) AND {fits} AND {about}) AS pr FROM l),
      k AS (SELECT *, {first} AS el_kept FROM f)
      SELECT id, {empty(lengths('ov', 4))} AS overview, {empty(_JOINED('el_kept', "n.k || ':' || length(n.x)"))} AS element_notes, {empty(_JOINED(pr, "n.k || ':' || length(n.x)"))} AS precedent_notes,
        {empty(lengths('st', 5))} AS next_steps{'' if client else dropped} FROM k"""


_PREDICTED = lambda c: " OR ".join(f"regexp_matches({c}, {quoted(p)})" for p in grounding.PREDICTIONS)
_TARGET = f"contains(coalesce(case_name, ''), '{R.TARGET}')"
_SYNC = f"""{_BATCH},
  canon AS (SELECT court, case_number, decision_date, min(id) AS cid FROM stored WHERE court IS NOT NULL AND case_number IS NOT NULL AND decision_date IS NOT NULL GROUP BY 1, 2, 3),
  arrivals AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY provider_record_id ORDER BY provider NULLS FIRST) AS r2 FROM later) WHERE r2 = 1),
  taken AS (SELECT l.*, s.id AS sid, coalesce(s.id, c.cid, 'new-' || l.id) AS pid, CASE WHEN s.id IS NULL AND c.cid IS NULL THEN 'new' WHEN s.id IS NULL THEN 'duplicate' WHEN s.source_hash IS NOT DISTINCT FROM l.source_hash THEN 'unchanged' ELSE 'changed' END AS state
    FROM arrivals l LEFT JOIN stored s ON s.provider = l.provider AND s.provider_record_id = l.provider_record_id LEFT JOIN canon c ON c.court = l.court AND c.case_number = l.case_number AND c.decision_date = l.decision_date
    WHERE contains(coalesce(l.case_name, ''), '{R.TARGET}')),
  docs AS (SELECT provider_record_id AS e, source_hash AS h, min(id) AS d FROM stored GROUP BY 1, 2)"""
_SUMMARY_EXPECTED = f"""
  old AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY precedent_id ORDER BY generated_at DESC NULLS LAST, source_hash NULLS FIRST, summary_version NULLS FIRST, model NULLS FIRST) AS rn FROM precedent_summaries) WHERE rn = 1),
  sel AS (SELECT p.id, ({focus_sql('p.case_name')}) <> 'focused' OR coalesce(o.source_hash = p.source_hash AND o.summary_version = 'grounded-v2' AND o.model = 'model-small', false) AS skip
    FROM precedents p JOIN data_sources r ON r.provider = p.provider AND r.enabled LEFT JOIN old o ON o.precedent_id = p.id
    WHERE p.verified_at IS NOT NULL AND p.link_status BETWEEN 200 AND 399 AND contains(p.case_name, '{R.TARGET}') AND EXISTS (SELECT 1 FROM precedent_paragraphs q WHERE q.precedent_id = p.id)),
  short AS (SELECT precedent_id, body, row_number() OVER (PARTITION BY precedent_id ORDER BY ordinal, paragraph_id, body) AS k FROM picked WHERE body <> '' AND length(body) <= 500),
  made AS (SELECT i.precedent_id AS id, count(s.body) AS n, bool_or({_PREDICTED('s.body')}) AS bad FROM (SELECT DISTINCT precedent_id FROM picked) i LEFT JOIN short s ON s.precedent_id = i.precedent_id AND s.k <= 3 GROUP BY 1),
  out AS (SELECT sel.id, skip, n, CASE WHEN skip THEN '' WHEN n IS NULL THEN 'SUMMARY_INPUT_REQUIRED' WHEN n = 0 THEN 'SENTENCE_COUNT' WHEN bad THEN 'NOT_NEUTRAL' ELSE '' END AS error_code FROM sel LEFT JOIN made ON made.id = sel.id)"""
_LABEL = lambda c, labels: "CASE " + c + " " + " ".join(f"WHEN {quoted(k)} THEN {quoted(v)}" for k, v in labels.items()) + f" ELSE {c} END"
_CURATED = ["id", "provider_record_id", "court", "case_number", "case_name", "decision_date", "official_url", "verified_at"]

ORACLE = {
    "malformed_analyses": _analyses_sql(False),
    "client_analyses": _analyses_sql(True),
    "malformed_summaries": f"""WITH {_S}, p AS (SELECT id, {_summary_json()} AS p FROM s), v AS (SELECT id, CASE WHEN json_valid(p) THEN p::JSON END AS v FROM p),
      i AS (SELECT id, v, json_extract(v, '$.sentences[0]') AS i FROM v), e AS (SELECT id, v, i, {_STR('i', '$.text')} AS x, json_extract(i, '$.paragraphIds[*]') AS ids FROM i),
      c AS (SELECT *, CASE WHEN v IS NULL OR json_type(v) <> 'OBJECT' OR json_keys(v) <> ['sentences'] THEN 'FORM' WHEN i IS NULL THEN 'SENTENCE_COUNT'
        WHEN json_type(i) <> 'OBJECT' OR list_sort(json_keys(i)) <> ['paragraphIds', 'text'] THEN 'SENTENCE_FORM' WHEN x IS NULL OR length(x) NOT BETWEEN 1 AND 500 OR {_PREDICTED('x')} THEN 'NOT_NEUTRAL'
        WHEN json_type(i, '$.paragraphIds') <> 'ARRAY' OR len(list_distinct(ids)) NOT BETWEEN 1 AND 5 THEN 'CITATION_COUNT'
        WHEN len(list_filter(ids, lambda y: json_type(y) <> 'VARCHAR' OR json_extract_string(y, '$') NOT IN (substr(id, 1, 2), 'p'))) > 0 THEN 'UNKNOWN_PARAGRAPH' ELSE '' END AS error FROM e)
      SELECT id, error, CASE WHEN error = '' THEN length(x) ELSE 0 END AS n FROM c""",
    "neutral_texts": f"SELECT NOT ({_VERDICT('body')} OR {_READER('body')}) AS neutral, NOT {_READER('body')} AS about_precedent, count(*) AS n FROM precedent_paragraphs WHERE body IS NOT NULL GROUP BY 1, 2",
    "analysis_inputs": f"""SELECT id, sha256(concat('{{"statute":"13","elements":[', '{", ".join(grounding.ELEMENTS).replace(", ", chr(34) + "," + chr(34)).join([chr(34)] * 2)}', '],"description":', to_json(coalesce(court, ''))::VARCHAR,
      ',"precedents":[{{"caseNumber":', to_json(coalesce(case_number, ''))::VARCHAR, ',"caseName":', to_json(coalesce(case_name, ''))::VARCHAR, '}}]}}')) AS input_hash FROM precedents""",
    "tag_backfill": f"""SELECT id, CASE WHEN batch_no > 0 THEN 'new' WHEN id < '2' OR id >= 'e' THEN 'renewed' ELSE 'kept' END AS state, medium FROM ({facts_sql('SELECT id, batch_no, source_text AS txt FROM precedents')})""",
    "tagged_dispositions": f"""SELECT f.id, medium, context, coalesce(k, '') AS kinds FROM ({facts_sql('SELECT id, source_text AS txt FROM precedents')}) f
      LEFT JOIN (SELECT precedent_id, string_agg(kind, ',' ORDER BY kind) AS k FROM (SELECT DISTINCT precedent_id, kind FROM precedent_dispositions WHERE kind IS NOT NULL) GROUP BY 1) d ON d.precedent_id = f.id""",
    "summary_backfill": f"""WITH {_picked(3, 40_000)}, {_SUMMARY_EXPECTED}
      SELECT id, CASE WHEN skip THEN 'skipped' WHEN error_code = '' THEN 'generated' ELSE 'failed' END AS state, error_code, CASE WHEN NOT skip AND error_code = '' THEN n ELSE 0 END AS n_sentences FROM out""",
    "sync_summary": f"""WITH {_SYNC} SELECT count(*) AS fetched, count(*) FILTER (state = 'new') AS n_new, count(*) FILTER (state = 'changed') AS n_changed, count(*) FILTER (state = 'unchanged') AS n_unchanged,
      count(*) FILTER (state = 'duplicate') AS n_duplicate, (SELECT count(*) FROM arrivals WHERE NOT {_TARGET}) AS skipped FROM taken""",
    "synced_records": f"""WITH {_SYNC}, t AS (SELECT * FROM taken WHERE state <> 'duplicate')
      SELECT coalesce(s.provider, t.provider) AS provider, coalesce(s.provider_record_id, t.provider_record_id) AS provider_record_id, CASE WHEN t.id IS NULL THEN s.source_hash ELSE t.source_hash END AS source_hash,
        s.verified_at IS NOT NULL AND (t.id IS NULL OR t.state = 'unchanged') AS verified, CASE WHEN s.id IS NULL THEN false WHEN t.id IS NULL OR t.state = 'unchanged' THEN s.searchable ELSE false END AS searchable,
        CASE WHEN t.id IS NOT NULL THEN true ELSE s.collected_at = TIMESTAMP '{AS_OF}' END AS touched
      FROM stored s FULL JOIN t ON s.provider = t.provider AND s.provider_record_id = t.provider_record_id""",
    "synced_sources": f"""WITH {_SYNC}, new AS (SELECT t.pid, coalesce(d.d, 'n') AS doc, t.state, d.d IS NULL AS fresh FROM taken t LEFT JOIN docs d ON d.e = t.provider_record_id AND d.h IS NOT DISTINCT FROM coalesce(t.source_hash, '')),
      lead AS (SELECT DISTINCT pid FROM new WHERE state <> 'duplicate'), kept AS (SELECT id FROM stored WHERE NOT EXISTS (SELECT 1 FROM new WHERE new.pid = stored.id AND new.doc = stored.id)),
      flags AS (SELECT id NOT IN (SELECT pid FROM lead) AS p FROM kept UNION ALL SELECT state <> 'duplicate' FROM new)
      SELECT * FROM (SELECT 'documents r1' AS what, (SELECT count(*) FROM new) AS n UNION ALL SELECT 'documents r0', (SELECT count(*) FROM docs) - (SELECT count(*) FROM new WHERE NOT fresh)
        UNION ALL SELECT 'sources ' || p::VARCHAR, count(*) FROM flags GROUP BY p) WHERE n > 0""",
    "overwritten_summaries": """SELECT precedent_id, source_hash, summary_version, model, len(sentences) AS n_sentences FROM (
      SELECT *, row_number() OVER (PARTITION BY precedent_id ORDER BY generated_at DESC NULLS LAST, source_hash NULLS FIRST, summary_version NULLS FIRST, model NULLS FIRST) AS rn FROM precedent_summaries WHERE precedent_id <> '') WHERE rn = 1""",
    "verified_tables": f"""WITH {_VERIFY}, l AS (SELECT b.id, e0, k, {paragraphs_sql('source_text')} AS p, g.verified AS ok, b.link_status FROM base b JOIN gate g ON g.id = b.id),
      h AS (SELECT *, list_position(list_transform(p, lambda x: regexp_matches(x, '^【\\s*주\\s*문\\s*】')), true) AS i FROM l WHERE ok),
      r AS (SELECT *, list_slice(p, i + 1, len(p)) AS rest FROM h WHERE i > 0), j AS (SELECT *, list_position(list_transform(rest, lambda x: regexp_matches(x, '^【[^】]*】')), true) AS j FROM r),
      o AS (SELECT array_to_string(list_filter(list_concat([trim(regexp_replace(p[i], '^【\\s*주\\s*문\\s*】', ''))], CASE WHEN j > 0 THEN list_slice(rest, 1, j - 1) ELSE rest END), lambda x: x <> ''), ' ') AS t FROM j)
      SELECT 'verified' AS what, count(*) FILTER (verified) AS n FROM gate UNION ALL SELECT 'searchable', count(*) FILTER (verified AND rights) FROM gate
      UNION ALL SELECT 'link_status', count(*) FROM l WHERE e0 IS NULL AND link_status IS NOT NULL
      UNION ALL SELECT 'paragraphs', (SELECT sum(CASE WHEN e0 IS NULL THEN k ELSE 0 END) FROM l) + (SELECT count(*) FROM precedent_paragraphs c WHERE NOT EXISTS (SELECT 1 FROM precedents p WHERE p.id = c.precedent_id))
      UNION ALL SELECT 'orders', (SELECT count(*) FROM o WHERE t <> '' AND length(t) <= {MAX_ORDER}) + (SELECT count(*) FROM precedent_dispositions c WHERE NOT EXISTS (SELECT 1 FROM precedents p WHERE p.id = c.precedent_id))""",
    "pruned_tables": f"""WITH gone AS (SELECT DISTINCT id FROM precedents WHERE NOT {_TARGET}), c AS (SELECT 'precedents' AS table_name, id FROM precedents UNION ALL SELECT 'precedent_paragraphs', precedent_id FROM precedent_paragraphs
      UNION ALL SELECT 'precedent_dispositions', precedent_id FROM precedent_dispositions UNION ALL SELECT 'precedent_summaries', precedent_id FROM precedent_summaries)
      SELECT table_name, count(gone.id) AS deleted, count(*) - count(gone.id) AS n_left FROM c LEFT JOIN gone ON gone.id = c.id GROUP BY 1""",
    "run_log": "SELECT concat_ws('/', sync_run_id, source_id) AS id, 'succeeded' AS status, count(*) AS fetched_count FROM source_documents WHERE sync_run_id IS NOT NULL GROUP BY sync_run_id, source_id",
    "article_parameters": """SELECT DISTINCT month(o_orderdate)::VARCHAR || CASE WHEN day(o_orderdate) > 9 THEN '-' || day(o_orderdate) ELSE '' END AS article,
      lpad(month(o_orderdate)::VARCHAR, 4, '0') || lpad(CASE WHEN day(o_orderdate) > 9 THEN day(o_orderdate)::VARCHAR ELSE '0' END, 2, '0') AS parameter FROM orders""",
    "list_records": "SELECT decision_date::VARCHAR AS decision_date, count(*) AS n, min(trim(provider_record_id)) AS first_id FROM precedents WHERE decision_date IS NOT NULL AND trim(provider_record_id) <> '' GROUP BY 1",
    "statute_records": """SELECT '법 ' || p_partkey AS law_name, CASE WHEN p_partkey % 2 = 1 THEN 't' ELSE '' END AS article_title, CASE WHEN p_partkey % 2 = 1 THEN '제 ' || p_partkey || ' 조' ELSE 'a' END AS body,
      '2024-0' || (1 + p_partkey % 9) || '-01' AS enforced_on, CASE WHEN p_partkey % 2 = 1 THEN '' ELSE 'articleTitle' END AS missing FROM part""",
    "body_states": f"""SELECT CASE WHEN id > 'f' OR coalesce(x, '') = '' THEN 'empty' WHEN id < '4' THEN 'html' ELSE '' END AS state, count(*) AS n FROM (
      SELECT id, CASE WHEN id < '4' THEN source_text || '!' ELSE regexp_replace(source_text, '{SPACE}+', '', 'g') END AS x FROM precedents) GROUP BY 1""",
    "stable_ids": "SELECT n_nationkey, sha256(n_name || chr(1) || n_nationkey) AS stable_id FROM nation",
    "clamped_limits": "SELECT n_nationkey, CASE WHEN n_nationkey = 5 THEN 5 ELSE greatest(1, least(5, n_nationkey - 5)) END AS used_limit FROM nation",
    "shown_orders": f"""SELECT s AS shown, CASE WHEN s THEN kind END AS kind, count(*) AS n, sum(CASE WHEN s THEN length(trim(order_text)) END) AS n_chars FROM (
      SELECT *, coalesce(trim(order_text) <> '' AND kind <> 'sentenced' AND kind IN ({', '.join(quoted(k) for k in ORDER_KINDS)}), false) AS s FROM precedent_dispositions) GROUP BY 1, 2""",
    "mapped_results": f"""SELECT id, CASE WHEN batch_no > 0 THEN 'mixed' ELSE 'focused' END AS focus, floor(greatest(0, least(coalesce((length(source_text) - 500) / 7.0::DOUBLE, 0), 100)) + 0.5)::BIGINT AS semantic,
      greatest(0, least(length(case_name) * 11, 100))::BIGINT AS facts, 0::BIGINT AS issues, 50::BIGINT AS total FROM precedents
      WHERE trim(id) <> '' AND trim(court) <> '' AND trim(case_number) <> '' AND trim(case_name) <> '' AND decision_date IS NOT NULL AND {_OFFICIAL}""",
    "gated_counts": f"SELECT count(*) AS available_count FROM precedents WHERE searchable AND {_TARGET}",
    "shown_facts": f"""SELECT id, concat_ws(',', CASE medium WHEN 'kakao' THEN '카카오톡' WHEN 'game_chat' THEN '게임 채팅' END, CASE context WHEN 'conflict' THEN '다툼' END) AS labels, false AS has_text
      FROM ({facts_sql('SELECT id, source_text AS txt FROM precedents')})""",
    "model_rollup": """SELECT event_type AS model, count(*) FILTER (value >= 5 OR value IS NULL) AS n_ok, count(*) FILTER (value < 5) AS n_failed, round(avg(value), 4) AS mean_latency_ms, sum(event_id % 100)::BIGINT AS n_tokens,
      sum(event_id % 3)::BIGINT AS n_dropped FROM events GROUP BY 1""",
    "curated_violations": "SELECT rule, count(*) AS n FROM (" + " UNION ALL ".join(
        [f"SELECT '{c}' AS rule FROM precedents WHERE coalesce(trim({c}::VARCHAR), '') = ''" for c in _CURATED]
        + ["SELECT 'not-verified' FROM precedents WHERE NOT coalesce(searchable, false)", "SELECT 'untrusted-url' FROM precedents",
           "SELECT 'missing-source-anchor' FROM precedents WHERE id <= '8'",
           "SELECT 'duplicate' FROM (SELECT unnest(range(count(*) - 1)) FROM precedents GROUP BY court, case_number, decision_date)"]) + ") GROUP BY 1",
    "element_evidence": f"""SELECT DISTINCT id, e.k AS element, e.m AS mention, e.v AS evidence, e.n::BIGINT AS n FROM (SELECT id, unnest([
      {{'k': 'purpose', 'm': 'unclear', 'v': {quoted(grounding.PURPOSE_EVIDENCE)}, 'n': {len(grounding.ELEMENT_TEXTS['purpose'][1])}}},
      {{'k': 'medium', 'm': CASE WHEN m IS NULL THEN 'unclear' ELSE 'present' END, 'v': CASE WHEN m IS NULL THEN {quoted(grounding.MEDIUM_UNKNOWN)} ELSE '입력에서 ' || {_LABEL('m', grounding.MEDIUM_LABELS)} || '을 확인했습니다.' END, 'n': {len(grounding.ELEMENT_TEXTS['medium'][1])}}},
      {{'k': 'expression', 'm': CASE WHEN x IS NULL THEN 'unclear' ELSE 'present' END, 'v': CASE WHEN x IS NULL THEN {quoted(grounding.EXPRESSION_UNKNOWN)} ELSE '입력에서 ' || {_LABEL('x', grounding.EXPRESSION_LABELS)} || '을 확인했습니다.' END, 'n': {len(grounding.ELEMENT_TEXTS['expression'][1])}}},
      {{'k': 'reached', 'm': CASE r WHEN 'yes' THEN 'present' WHEN 'no' THEN 'absent' ELSE 'unclear' END, 'v': CASE r WHEN 'yes' THEN {quoted(grounding.REACHED['yes'])} WHEN 'no' THEN {quoted(grounding.REACHED['no'])} ELSE {quoted(grounding.REACHED[''])} END, 'n': {len(grounding.ELEMENT_TEXTS['reached'][1])}}}]) AS e
      FROM (SELECT id, CASE WHEN coalesce(facts.medium, '') NOT IN ('', 'unknown') THEN facts.medium END AS m, CASE WHEN coalesce(facts.expression_type, '') NOT IN ('', 'other') THEN facts.expression_type END AS x, coalesce(facts.reached_recipient, '') AS r FROM intake_sessions))""",
    "adapter_analyses": """SELECT id, CASE k WHEN 0 THEN 'ANALYSIS_API_UNAVAILABLE' WHEN 1 THEN 'ANALYSIS_RESPONSE_INVALID' ELSE '' END AS error_code, CASE WHEN k > 1 AND case_number IS NOT NULL THEN 1 ELSE 0 END AS n_notes, CASE WHEN k > 1 THEN 1 ELSE 0 END AS n_dropped
      FROM (SELECT id, case_number, length(coalesce(court, '')) % 4 AS k FROM precedents)""",
    "paged_list": "SELECT 1 + n_nationkey // 10 AS page, n_name FROM nation",
    "looked_up_details": "SELECT DISTINCT r AS asked, CASE WHEN r LIKE '%7' THEN 'HTTP_404' ELSE '' END AS error_code, CASE WHEN r LIKE '%7' THEN '' ELSE trim('법원 ' || right(r, 2)) END AS court FROM (SELECT trim(provider_record_id) AS r FROM precedents) WHERE r <> ''",
    "link_probes": f"""SELECT DISTINCT official_url, CASE WHEN NOT coalesce({_OFFICIAL}, false) THEN 0 WHEN length(official_url) % 5 < 2 THEN 0 WHEN length(official_url) % 5 = 2 THEN 206 ELSE 200 END AS link_status FROM precedents WHERE official_url IS NOT NULL""",
    "rights_records": "SELECT provider, true AS summary_allowed, false AS redistribution_allowed, 'reviewed-2026-01-02' AS terms_version FROM data_sources",
    "published_tables": "SELECT n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1",
    "json_report": """SELECT o_orderstatus, '{"n":' || count(*) || ',"last":"' || max(o_orderdate)::DATE::VARCHAR || '"}' AS report FROM orders GROUP BY 1""",
    "static_ranks": f"""SELECT id, semantic, fact_score, issue_score, total FROM (SELECT *, floor(semantic * 0.45 + fact_score * 0.45 + issue_score * 0.1 + 0.5)::BIGINT AS total FROM (
      SELECT id, least(100, (CASE WHEN id < '8' THEN 2 ELSE 1 END) * 14 + CASE WHEN medium = 'kakao' THEN 26 ELSE 0 END + CASE WHEN expression = 'sexual_image' THEN 18 ELSE 0 END) AS semantic, {compare_sql(DESCRIBED)[0]} AS fact_score, {compare_sql(DESCRIBED)[1]} AS issue_score
      FROM ({facts_sql('SELECT id, source_text AS txt FROM precedents')}))) ORDER BY total DESC, id LIMIT 50""",
    "search_modes": """SELECT 'lexical' AS name, 'provisional_without_embeddings' AS mode, '' AS fallback_code, true AS has_count UNION ALL SELECT 'down', 'fallback_without_embeddings', 'EMBEDDING_DOWN', true
      UNION ALL SELECT 'empty', 'fallback_without_embeddings', 'NO_EMBEDDED_CANDIDATES', true UNION ALL SELECT 'outside', 'query_out_of_scope', '', false""",
    "full_width_texts": "SELECT doc_id, url FROM documents WHERE url IS NOT NULL",
    "full_width_facts": "SELECT event_type, CASE event_type WHEN 'click' THEN 'sns_mention' WHEN 'view' THEN 'kakao' ELSE 'unknown' END AS medium, count(*) AS n FROM events GROUP BY 1, 2",
    "streamed_upserts": "SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY 1",
    "stale_embeddings": "SELECT vec_id FROM embeddings WHERE vec_id % 3 = 0 OR vec_id % 5 = 0 OR vec_id % 7 = 0 OR embedding IS NULL",
}
