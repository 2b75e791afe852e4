"""Queries of the ingest, merge, verification, grounding, intake and quality operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import grounding, intake, merge, quality, search, verify
from ..session import read
from ..sources import payloads
from .oracle_parts import focus_sql, paragraphs_sql, quoted

AS_OF = "2026-01-20 00:00:00"
SESSIONS_AS_OF = "2025-07-01 00:00:00"
# The invented hosts of the test tables stand where the official hosts do.
HOSTS = [f"cases.{p}.example" for p in ("law-open-data", "court-archive", "bar-digest", "case-commons")]


def _p(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "precedents")


def _rights(spark: SparkSession, sf: str) -> DataFrame:
    flags = ["storage_allowed", "indexing_allowed", "summary_allowed", "display_allowed"]
    return read(spark, sf, "data_sources").select("provider", *[F.col("enabled").alias(f) for f in flags])


def _batches(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Accepted records, one a provider key, and the later deliveries, the last of each key."""
    p = _p(spark, sf)
    stored = merge.latest(p.where("batch_no = 0"), ["provider", "provider_record_id"], [F.asc("id")])
    later = merge.latest(p.where("batch_no > 0"), ["provider", "provider_record_id"], [F.desc("batch_no"), F.asc("id")])
    return stored, later


def detail_records(spark: SparkSession, sf: str) -> DataFrame:
    d = payloads.parse_detail(read(spark, sf, "source_documents").select("id", "raw_payload"), "raw_payload")
    return d.select("id", "provider_record_id", "court", "case_number", "decision_date", "official_url", "source_hash", F.array_join("missing", ",").alias("missing")).distinct()


def bronze_documents(spark: SparkSession, sf: str) -> DataFrame:
    """DML3. One row for each content of a record, touched by every delivery of the same content."""
    d = read(spark, sf, "source_documents")
    seen = lambda x: x.groupBy("source_id", "external_id", "raw_hash").agg(F.min("fetched_at").alias("first_seen"), F.max("fetched_at").alias("last_seen"))
    first = {"first_seen": (F.lit(True), F.col("s.first_seen"))}  # what is there was seen before
    half = F.col("fetched_at") < F.lit("2025-06-01").cast("timestamp_ntz")
    return merge.merge_upsert(seen(d.where(half)), seen(d.where(~F.coalesce(half, F.lit(False)))), ["source_id", "external_id", "raw_hash"], first)


def sync_states(spark: SparkSession, sf: str) -> DataFrame:
    stored, later = _batches(spark, sf)
    return merge.existing_matches(later.select("id", "provider", "provider_record_id", "court", "case_number", "decision_date", "source_hash"), stored).select("id", "state", "existing_id")


def sync_counts(spark: SparkSession, sf: str) -> DataFrame:
    return merge.state_counts(sync_states(spark, sf))


def conditional_upsert(spark: SparkSession, sf: str) -> DataFrame:
    stored, later = _batches(spark, sf)
    keys = ["provider", "provider_record_id"]
    cols = [*keys, "court", "source_hash", "verified_at", "link_status", "searchable"]
    return merge.upsert_records(stored.select(cols), later.select(cols), keys)


def insert_missing(spark: SparkSession, sf: str) -> DataFrame:
    stored, later = _batches(spark, sf)
    cols = ["provider", "provider_record_id", "source_hash"]
    return merge.insert_missing(stored.select(cols), later.select(cols), cols[:2])


def replaced_paragraphs(spark: SparkSession, sf: str) -> DataFrame:
    """DML6, DML7. The paragraphs of verified records made again from their texts; unverified records lose theirs."""
    p = _p(spark, sf)
    old = read(spark, sf, "precedent_paragraphs").select("precedent_id", "paragraph_id", F.length("body").cast("bigint").alias("n"))
    v = p.select("id", F.col("verified_at").isNotNull().alias("verified"))
    fresh = verify.verified_paragraphs(p, v).select("precedent_id", "paragraph_id", F.length("body").cast("bigint").alias("n"))
    return merge.replace_children(old, fresh, "precedent_id", p.select(F.col("id").alias("precedent_id")))


def prune_preview(spark: SparkSession, sf: str) -> DataFrame:
    """DML8. What pruning the records outside the target offence would delete (a dry run)."""
    p = _p(spark, sf)
    gone = p.where(~F.coalesce(F.col("case_name").contains("통신매체이용음란"), F.lit(False))).select("id")
    tables = {"precedents": (p, "id")} | {t: (read(spark, sf, t), "precedent_id") for t in ("precedent_paragraphs", "precedent_dispositions", "precedent_summaries")}
    return merge.delete_cascade(tables, gone)[1]


def primary_sources(spark: SparkSession, sf: str) -> DataFrame:
    """DML4. Deliveries of the first batch as sources, the later ones worked in."""
    stored, later = _batches(spark, sf)
    old = stored.select(F.col("id").alias("precedent_id"), F.col("id").alias("source_document_id"), "official_url", F.lit(True).alias("is_primary"))
    states = merge.existing_matches(later.select("id", "provider", "provider_record_id", "court", "case_number", "decision_date", "source_hash", "official_url"), stored)
    new = states.select(F.coalesce("existing_id", "id").alias("precedent_id"), F.col("id").alias("source_document_id"), "official_url", "state")
    return merge.rotate_primary(old, new).select("precedent_id", "source_document_id", "is_primary")


def latest_per_key(spark: SparkSession, sf: str) -> DataFrame:
    d = read(spark, sf, "source_documents").select("source_id", "external_id", "raw_hash", "fetched_at", "id")
    return merge.latest(d, ["source_id", "external_id"], [F.desc("fetched_at"), F.asc("id"), F.asc("raw_hash")]).select("source_id", "external_id", "raw_hash")


def canonical_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    return _p(spark, sf).groupBy("court", "case_number", "decision_date").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n")).where("n > 1")


def official_urls(spark: SparkSession, sf: str) -> DataFrame:
    u = F.col("official_url")
    return _p(spark, sf).select("id", verify.is_official(u, HOSTS).alias("official"), X.host_within(u, "law-open-data.example").alias("within"))


def url_masking(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "documents").where(F.col("url").isNotNull()).select("doc_id", X.mask_secrets(F.concat("url", F.lit("?OC=abc&p=1&key=zz"))).alias("masked"))


def _verified(spark: SparkSession, sf: str) -> DataFrame:
    return verify.verify(_p(spark, sf), _rights(spark, sf), HOSTS)


def verify_gate(spark: SparkSession, sf: str) -> DataFrame:
    return _verified(spark, sf).select("id", F.coalesce("error_code", F.lit("")).alias("error_code"), F.col("paragraph_count").cast("bigint").alias("paragraph_count"), "verified", "searchable")


def verify_counts(spark: SparkSession, sf: str) -> DataFrame:
    return verify.verification_counts(_verified(spark, sf))


def verification_reviews(spark: SparkSession, sf: str) -> DataFrame:
    d = verify.reviews(_p(spark, sf), _verified(spark, sf), F.lit(AS_OF).cast("timestamp"))
    return d.groupBy("status", "metadata_match", "content_match").agg(F.count(F.lit(1)).alias("n"))


def fresh_records(spark: SparkSession, sf: str) -> DataFrame:
    d = _p(spark, sf).withColumn("embedding", F.lit(1))
    return d.where(search.fresh(F.lit(AS_OF).cast("timestamp_ntz"), 24 * 30)).select("id", "link_status")


def stored_summaries(spark: SparkSession, sf: str) -> DataFrame:
    """J2, R17. Summaries of the current text only; stale ones come out as null."""
    s = merge.latest(read(spark, sf, "precedent_summaries"), ["precedent_id", "source_hash"], [F.desc("generated_at"), F.desc("summary_version")])
    j = _p(spark, sf).join(s.withColumnRenamed("precedent_id", "id").drop("model"), ["id", "source_hash"], "left")
    shown = search.stored_summary(F.col("case_name"), F.col("summary_version"), F.col("sentences"), False)
    return j.select("id", F.to_json(F.transform(shown, lambda x: x["sourceAnchor"])).alias("anchors"))


def ordered_collect(spark: SparkSession, sf: str) -> DataFrame:
    """A2, A8. One document's paragraphs in order, as one text's hash."""
    d = read(spark, sf, "precedent_paragraphs").select("precedent_id", "ordinal", "paragraph_id", "body").distinct()
    g = d.groupBy("precedent_id").agg(F.array_sort(F.collect_list(F.struct("ordinal", "paragraph_id", "body"))).alias("p"), F.max("ordinal").alias("last"))
    return g.select("precedent_id", X.sha256(F.array_join(F.col("p.body"), "\n")).alias("text_hash"), F.col("last").cast("bigint").alias("last_ordinal"))


def integrity_report(spark: SparkSession, sf: str) -> DataFrame:
    return quality.integrity_report(_p(spark, sf), *(read(spark, sf, t) for t in ("precedent_dispositions", "precedent_summaries", "precedent_paragraphs")))


def unknown_citations(spark: SparkSession, sf: str) -> DataFrame:
    return grounding.unknown_citations(read(spark, sf, "precedent_summaries"), read(spark, sf, "precedent_paragraphs")).groupBy("precedent_id", "paragraph_id").agg(F.count(F.lit(1)).alias("n"))


def key_violations(spark: SparkSession, sf: str) -> DataFrame:
    return quality.key_violations(_p(spark, sf), "precedents").unionByName(quality.key_violations(read(spark, sf, "precedent_paragraphs"), "precedent_paragraphs"))


def searchable_violations(spark: SparkSession, sf: str) -> DataFrame:
    """The invariants of searchable records, here read the other way round for records that claim a link."""
    return quality.searchable_violations(_p(spark, sf).withColumn("searchable", F.col("link_checked_at").isNotNull()))


def domain_violations(spark: SparkSession, sf: str) -> DataFrame:
    d = read(spark, sf, "intake_sessions").select("id", "facts.*").distinct()
    return quality.domain_violations(d, "id").groupBy("field", "value").agg(F.count(F.lit(1)).alias("n"))


def grounded_summaries(spark: SparkSession, sf: str) -> DataFrame:
    """V1 over the stored summaries: each as a payload, against the paragraphs of its record."""
    ids = read(spark, sf, "precedent_paragraphs").groupBy("precedent_id").agg(F.collect_set("paragraph_id").alias("allowed"))  # ids of one document
    s = read(spark, sf, "precedent_summaries")
    shaped = F.transform("sentences", lambda x: F.struct(F.coalesce(x["paragraph_ids"], F.array().cast("array<string>")).alias("paragraphIds"), F.coalesce(x["text"], F.lit("")).alias("text")))
    d = s.join(ids, "precedent_id", "left").withColumn("v", grounding.validate_summary(F.to_json(F.struct(shaped.alias("sentences"))), F.coalesce("allowed", F.array().cast("array<string>"))))
    return d.groupBy(F.coalesce("v.error", F.lit("")).alias("error")).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.size("v.sentences")), F.lit(0)).alias("n_sentences"))


def session_answers(spark: SparkSession, sf: str) -> DataFrame:
    s = read(spark, sf, "intake_sessions").select("id", "questions", "answers")
    d = s.select("id", intake.accepted_answers(F.col("questions"), F.col("answers")).alias("a"))
    return d.select("id", F.coalesce("a.error", F.lit("")).alias("error"), F.coalesce(F.array_size(F.map_keys("a.answers")), F.lit(0)).cast("bigint").alias("n_answers")).distinct()


def session_text(spark: SparkSession, sf: str) -> DataFrame:
    s = read(spark, sf, "intake_sessions")
    return s.select("id", X.sha256(intake.session_query(F.col("redacted_text"), F.col("questions"), F.coalesce("answers", F.create_map().cast("map<string,string>")))).alias("query_hash")).distinct()


def _camel(f: str):
    names = {"medium": "medium", "messageForm": "message_form", "recipientIdentification": "recipient_identification", "reachedRecipient": "reached_recipient", "relationship": "relationship", "context": "context", "expressionType": "expression_type", "repetition": "repetition"}
    return F.struct(*[F.col(f"{f}.{v}").alias(k) for k, v in names.items()])


def intake_questions(spark: SparkSession, sf: str) -> DataFrame:
    d = read(spark, sf, "intake_sessions").select("id", intake.questions(_camel("facts")).alias("q"), grounding.element_mentions(_camel("facts")).alias("e"))
    return d.select("id", F.array_join(F.transform("q", lambda x: x["field"]), ",").alias("fields"), F.array_join(F.transform("e", lambda x: x["mention"]), ",").alias("mentions")).distinct()


def session_purge(spark: SparkSession, sf: str) -> DataFrame:
    kept, gone = intake.purge(read(spark, sf, "intake_sessions"), F.lit(SESSIONS_AS_OF).cast("timestamp_ntz"))
    return gone.crossJoin(kept.agg(F.count(F.lit(1)).alias("kept")))  # both sides are one row


def session_expiry(spark: SparkSession, sf: str) -> DataFrame:
    e = read(spark, sf, "events").select("event_id", "user_id", F.col("ts"))
    d = intake.open_session(e, F.col("ts"))
    live = intake.unexpired(d, F.lit("2024-01-15 12:00:00").cast("timestamp_ntz"))
    return live.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.min("expires_at").alias("next_expiry"))


def json_field(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "events").groupBy(F.get_json_object("props", "$.k").alias("k"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))


def quality_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """A7 over one case a court: found are its newest records, expected the last id, forbidden the first."""
    p = _p(spark, sf).where(F.col("decision_date").isNotNull())
    ranked = merge.latest(p.select("court", "id", "decision_date", "searchable"), ["court", "id"], [F.asc("id")])
    from pyspark.sql.window import Window

    top = ranked.where("searchable").withColumn("n", F.row_number().over(Window.partitionBy("court").orderBy(F.desc("decision_date"), F.asc("id")))).where("n <= 3")
    found = top.groupBy("court").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "id"))), lambda x: x["id"]).alias("found"))
    cases = p.groupBy("court").agg(F.array(F.max_by("id", F.struct("decision_date", "id"))).alias("expected"), F.array(F.min("id")).alias("forbidden"), F.col("court").endswith("지원").alias("expect_empty"))
    empty = F.array().cast("array<string>")
    return quality.quality_metrics(cases.join(found, "court", "left").withColumn("found", F.coalesce("found", empty)))


def customers_without_orders(spark: SparkSession, sf: str) -> DataFrame:
    """J6."""
    return read(spark, sf, "customer").join(read(spark, sf, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_mktsegment")


def last_orders(spark: SparkSession, sf: str) -> DataFrame:
    """A3, J4. Customers by the day of their last order."""
    o = read(spark, sf, "orders").groupBy("o_custkey").agg(F.max("o_orderdate").alias("last"), F.count(F.lit(1)).alias("n"))
    return read(spark, sf, "customer").join(o, F.col("c_custkey") == F.col("o_custkey")).select("c_custkey", "last", "n")


def gated_rights_join(spark: SparkSession, sf: str) -> DataFrame:
    """J3. Records whose provider may be summarised and shown: the condition is part of the join."""
    r = _rights(spark, sf).where("summary_allowed AND display_allowed").select("provider")
    return _p(spark, sf).join(r, "provider").groupBy("provider").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("source_text")).alias("n_chars"))


QUERIES = {f.__name__: f for f in (
    detail_records, bronze_documents, sync_states, sync_counts, conditional_upsert, insert_missing, replaced_paragraphs, prune_preview, primary_sources, latest_per_key, canonical_duplicates, official_urls,
    url_masking, verify_gate, verify_counts, verification_reviews, fresh_records, stored_summaries, ordered_collect, integrity_report, unknown_citations, key_violations, searchable_violations, domain_violations,
    grounded_summaries, session_answers, session_text, intake_questions, session_purge, session_expiry, json_field, quality_metrics, customers_without_orders, last_orders, gated_rights_join,
)}

_HOST = "lower(regexp_extract(official_url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]+)', 1))"
_OFFICIAL = f"(regexp_matches(official_url, '^(?i)https://') AND {_HOST} IN ({', '.join(quoted(h) for h in HOSTS)}))"
_BATCH = """stored AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY provider, provider_record_id ORDER BY id) AS rn FROM precedents WHERE batch_no = 0) WHERE rn = 1),
 later AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY provider, provider_record_id ORDER BY batch_no DESC, id) AS rn FROM precedents WHERE batch_no > 0) WHERE rn = 1)"""
_STATES = f"""{_BATCH},
 canon AS (SELECT court, case_number, decision_date, min(id) AS cid FROM stored WHERE court IS NOT NULL AND case_number IS NOT NULL AND decision_date IS NOT NULL GROUP BY 1, 2, 3),
 states AS (SELECT l.id, CASE WHEN s.id IS NULL AND c.cid IS NULL THEN 'new' WHEN s.id IS NULL THEN 'duplicate' WHEN s.source_hash IS NOT DISTINCT FROM l.source_hash THEN 'unchanged' ELSE 'changed' END AS state, coalesce(s.id, c.cid) AS existing_id
   FROM later l LEFT JOIN stored s ON s.provider = l.provider AND s.provider_record_id = l.provider_record_id LEFT JOIN canon c ON c.court = l.court AND c.case_number = l.case_number AND c.decision_date = l.decision_date)"""
_J = lambda n: f"coalesce(json_extract_string(raw_payload, '$.PrecService.\"{n}\"'), '')"
_VERIFY = f"""base AS (SELECT p.*, coalesce(d.enabled, false) AS rights, len({paragraphs_sql('source_text')}) AS k,
   CASE WHEN coalesce(court, '') = '' OR coalesce(case_number, '') = '' OR decision_date IS NULL OR coalesce(official_url, '') = '' OR coalesce(source_text, '') = '' OR coalesce(source_hash, '') = '' THEN 'SOURCE_METADATA_MISSING'
     WHEN NOT coalesce({_OFFICIAL}, false) THEN 'SOURCE_URL_INVALID' WHEN sha256(source_text) <> source_hash THEN 'SOURCE_HASH_MISMATCH' END AS e0 FROM precedents p LEFT JOIN data_sources d ON d.provider = p.provider),
 gate AS (SELECT id, link_status, coalesce(e0, CASE WHEN k = 0 THEN 'SOURCE_PARAGRAPHS_MISSING' WHEN NOT coalesce(link_status BETWEEN 200 AND 399, false) THEN 'SOURCE_LINK_INVALID' WHEN NOT rights THEN 'SOURCE_RIGHTS_REQUIRED' END) AS error_code,
   k AS paragraph_count, e0 IS NULL AND k > 0 AND coalesce(link_status BETWEEN 200 AND 399, false) AS verified, rights FROM base)"""
_PRED = " OR ".join(f"regexp_matches(trim(x.text), {quoted(p)})" for p in grounding.PREDICTIONS)

ORACLE = {
    "detail_records": f"""SELECT DISTINCT id, r AS provider_record_id, court, case_number, d AS decision_date, 'https://www.law.go.kr/LSW/precInfoP.do?precSeq=' || r AS official_url, sha256(t) AS source_hash,
      array_to_string(list_filter([CASE WHEN r = '' THEN 'providerRecordId' END, CASE WHEN court = '' THEN 'court' END, CASE WHEN case_number = '' THEN 'caseNumber' END, CASE WHEN n = '' THEN 'caseName' END, CASE WHEN d = '' THEN 'decisionDate' END, CASE WHEN t = '' THEN 'sourceText' END], lambda x: x IS NOT NULL), ',') AS missing
      FROM (SELECT *, CASE WHEN regexp_matches(q, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$') THEN q ELSE '' END AS d FROM (SELECT *, CASE WHEN regexp_matches(w, '^[0-9]{{8}}$') THEN substr(w, 1, 4) || '-' || substr(w, 5, 2) || '-' || substr(w, 7, 2) ELSE regexp_replace(replace(w, '.', '-'), '-+$', '') END AS q
      FROM (SELECT id, coalesce(nullif(trim({_J('판례정보일련번호')}), ''), trim({_J('판례일련번호')})) AS r, trim({_J('법원명')}) AS court, trim({_J('사건번호')}) AS case_number, trim({_J('사건명')}) AS n, coalesce(nullif(trim({_J('선고일자')}), ''), trim({_J('선고일')})) AS w,
        coalesce(nullif(trim({_J('판례내용')}), ''), nullif(trim({_J('판결내용')}), ''), trim({_J('본문')})) AS t FROM source_documents)))""",
    "bronze_documents": "SELECT source_id, external_id, raw_hash, min(fetched_at) AS first_seen, max(fetched_at) AS last_seen FROM source_documents GROUP BY 1, 2, 3",
    "sync_states": f"WITH {_STATES} SELECT id, state, existing_id FROM states",
    "sync_counts": f"WITH {_STATES} SELECT count(*) AS fetched, {', '.join(f'count_if(state = {quoted(s)})::BIGINT AS n_{s}' for s in ('new', 'changed', 'unchanged', 'duplicate'))} FROM states",
    "conditional_upsert": f"""WITH {_BATCH} SELECT coalesce(l.provider, s.provider) AS provider, coalesce(l.provider_record_id, s.provider_record_id) AS provider_record_id, CASE WHEN l.id IS NULL THEN s.court ELSE l.court END AS court, CASE WHEN l.id IS NULL THEN s.source_hash ELSE l.source_hash END AS source_hash,
      {', '.join(f'CASE WHEN l.id IS NULL OR (s.id IS NOT NULL AND s.source_hash IS NOT DISTINCT FROM l.source_hash) THEN s.{c} END AS {c}' for c in ('verified_at', 'link_status'))},
      CASE WHEN l.id IS NULL OR (s.id IS NOT NULL AND s.source_hash IS NOT DISTINCT FROM l.source_hash) THEN s.searchable ELSE false END AS searchable
      FROM stored s FULL JOIN later l ON l.provider = s.provider AND l.provider_record_id = s.provider_record_id""",
    "insert_missing": f"""WITH {_BATCH} SELECT provider, provider_record_id, source_hash FROM stored UNION ALL
      SELECT provider, provider_record_id, source_hash FROM later l WHERE NOT EXISTS (SELECT 1 FROM stored s WHERE s.provider = l.provider AND s.provider_record_id = l.provider_record_id)""",
    "replaced_paragraphs": f"""SELECT precedent_id, paragraph_id, length(body) AS n FROM precedent_paragraphs WHERE precedent_id NOT IN (SELECT id FROM precedents) UNION ALL
      SELECT id, 'p' || lpad(i::VARCHAR, greatest(3, length(i::VARCHAR))::INT, '0'), length(ps[i]) FROM (SELECT id, ps, unnest(range(1, len(ps) + 1)) AS i FROM (SELECT id, {paragraphs_sql('source_text')} AS ps FROM precedents WHERE verified_at IS NOT NULL))""",
    "prune_preview": "WITH gone AS (SELECT id FROM precedents WHERE NOT coalesce(contains(case_name, '통신매체이용음란'), false)) SELECT 'precedents' AS table_name, count(*) AS stored, count_if(id IN (SELECT id FROM gone))::BIGINT AS unrelated, 0::BIGINT AS deleted FROM precedents UNION ALL "
    + " UNION ALL ".join(f"SELECT '{t}', count(*), count_if(coalesce(precedent_id IN (SELECT id FROM gone), false))::BIGINT, 0::BIGINT FROM {t}" for t in ("precedent_paragraphs", "precedent_dispositions", "precedent_summaries")),
    "primary_sources": f"""WITH {_STATES}, arr AS (SELECT coalesce(existing_id, id) AS precedent_id, id AS source_document_id, state FROM states)
      SELECT id AS precedent_id, id AS source_document_id, NOT EXISTS (SELECT 1 FROM arr a WHERE a.precedent_id = s.id AND a.state <> 'duplicate') AS is_primary FROM stored s UNION ALL SELECT precedent_id, source_document_id, state <> 'duplicate' FROM arr""",
    "latest_per_key": "SELECT source_id, external_id, raw_hash FROM (SELECT *, row_number() OVER (PARTITION BY source_id, external_id ORDER BY fetched_at DESC, id, raw_hash) AS rn FROM source_documents) WHERE rn = 1",
    "canonical_duplicates": "SELECT court, case_number, decision_date, min(id) AS id, count(*) AS n FROM precedents GROUP BY 1, 2, 3 HAVING count(*) > 1",
    "official_urls": f"SELECT id, coalesce({_OFFICIAL}, false) AS official, coalesce({_HOST} = 'law-open-data.example' OR ends_with({_HOST}, '.law-open-data.example'), false) AS within FROM precedents",
    "url_masking": "SELECT doc_id, regexp_replace(url || '?OC=abc&p=1&key=zz', '(?i)([?&](?:oc|apikey|api_key|authkey|key)=)[^&]+', '\\1***', 'g') AS masked FROM documents WHERE url IS NOT NULL",
    "verify_gate": f"WITH {_VERIFY} SELECT id, coalesce(error_code, '') AS error_code, paragraph_count, verified, verified AND rights AS searchable FROM gate",
    "verify_counts": f"WITH {_VERIFY} SELECT count(*) AS checked, count_if(verified)::BIGINT AS verified, count_if(verified AND rights)::BIGINT AS searchable, count_if(NOT verified)::BIGINT AS rejected, count_if(verified AND NOT rights)::BIGINT AS rights_blocked FROM gate",
    "verification_reviews": f"""WITH {_VERIFY} SELECT CASE WHEN verified AND rights THEN 'searchable' WHEN verified THEN 'verified' ELSE 'rejected' END AS status, coalesce(error_code, '') <> 'SOURCE_METADATA_MISSING' AS metadata_match,
      coalesce(error_code, '') <> 'SOURCE_HASH_MISMATCH' AS content_match, count(*) AS n FROM gate GROUP BY 1, 2, 3""",
    "fresh_records": f"SELECT id, link_status FROM precedents WHERE verified_at IS NOT NULL AND link_checked_at >= TIMESTAMP '{AS_OF}' - INTERVAL 720 HOUR AND link_status BETWEEN 200 AND 399",
    "stored_summaries": f"""WITH s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY precedent_id, source_hash ORDER BY generated_at DESC, summary_version DESC) AS rn FROM precedent_summaries) WHERE rn = 1),
      j AS (SELECT p.id, p.case_name, s.summary_version AS v, s.sentences AS z, regexp_replace(p.case_name, '\\s+', '', 'g') AS c FROM precedents p LEFT JOIN s ON s.precedent_id = p.id AND s.source_hash = p.source_hash)
      SELECT id, CASE WHEN contains(c, '통신매체이용음란') AND {focus_sql('case_name')} = 'focused' AND v = 'grounded-v2' AND len(z) BETWEEN 1 AND 3
        AND len(list_filter(z, lambda x: coalesce(trim(x.text) <> '' AND len(x.paragraph_ids) > 0 AND len(list_filter(x.paragraph_ids, lambda q: q IS NULL OR q = '')) = 0, false))) = len(z)
        THEN to_json(list_transform(z, lambda x: array_to_string(list_transform(x.paragraph_ids, lambda q: '판결문 문단 ' || q), ', ')))::VARCHAR END AS anchors FROM j""",
    "ordered_collect": "SELECT precedent_id, sha256(string_agg(body, chr(10) ORDER BY ordinal, paragraph_id, body)) AS text_hash, max(ordinal)::BIGINT AS last_ordinal FROM (SELECT DISTINCT precedent_id, ordinal, paragraph_id, body FROM precedent_paragraphs) GROUP BY 1",
    "integrity_report": """SELECT (SELECT count(*) FROM precedent_dispositions WHERE extraction_version = 'order-v1') AS orders_v1, (SELECT count(*) FROM precedent_summaries WHERE summary_version = 'grounded-v2') AS summaries_v2,
      (SELECT count(*) FROM precedents p WHERE searchable AND NOT EXISTS (SELECT 1 FROM precedent_dispositions d WHERE d.precedent_id = p.id)) AS searchable_without_order,
      (SELECT count(*) FROM precedent_summaries s JOIN precedents p ON p.id = s.precedent_id WHERE s.source_hash <> p.source_hash) AS stale_hashes,
      (SELECT count(*) FROM (SELECT precedent_id, unnest(s.paragraph_ids) AS q FROM (SELECT precedent_id, unnest(sentences) AS s FROM precedent_summaries)) c WHERE q IS NOT NULL AND NOT EXISTS (SELECT 1 FROM precedent_paragraphs p WHERE p.precedent_id = c.precedent_id AND p.paragraph_id = c.q)) AS unknown_citations""",
    "unknown_citations": """SELECT precedent_id, q AS paragraph_id, count(*) AS n FROM (SELECT precedent_id, unnest(s.paragraph_ids) AS q FROM (SELECT precedent_id, unnest(sentences) AS s FROM precedent_summaries)) c
      WHERE q IS NOT NULL AND NOT EXISTS (SELECT 1 FROM precedent_paragraphs p WHERE p.precedent_id = c.precedent_id AND p.paragraph_id = c.q) GROUP BY 1, 2""",
    "key_violations": " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, '{','.join(k)}' AS key_columns, count(*) AS n_keys FROM (SELECT 1 FROM {t} WHERE {' AND '.join(c + ' IS NOT NULL' for c in k)} GROUP BY {', '.join(k)} HAVING count(*) > 1)"
        for t in ("precedents", "precedent_paragraphs") for k in quality.KEYS[t]
    ),
    "searchable_violations": "SELECT id, 'not_verified' AS rule FROM precedents WHERE link_checked_at IS NOT NULL AND verified_at IS NULL UNION ALL SELECT id, 'link_status' FROM precedents WHERE link_checked_at IS NOT NULL AND NOT coalesce(link_status BETWEEN 200 AND 399, false)",
    "domain_violations": "WITH d AS (SELECT DISTINCT id, facts FROM intake_sessions), v AS ("
    + " UNION ALL ".join(f"SELECT '{f}' AS field, facts.{f} AS value FROM d WHERE NOT coalesce(facts.{f} IN ({', '.join(quoted(x) for x in xs)}), false)" for f, xs in quality.DOMAINS.items())
    + ") SELECT field, value, count(*) AS n FROM v GROUP BY 1, 2",
    "grounded_summaries": f"""WITH a AS (SELECT precedent_id, list(DISTINCT paragraph_id) AS ids FROM precedent_paragraphs WHERE paragraph_id IS NOT NULL GROUP BY 1),
      v AS (SELECT s.sentences AS z, CASE WHEN z IS NULL THEN 'FORM' WHEN NOT len(z) BETWEEN 1 AND 3 THEN 'SENTENCE_COUNT' WHEN coalesce(len(a.ids), 0) = 0 THEN 'NO_PARAGRAPHS'
        WHEN len(list_filter(z, lambda x: NOT length(trim(coalesce(x.text, ''))) BETWEEN 1 AND 500 OR {_PRED})) > 0 THEN 'NOT_NEUTRAL'
        WHEN len(list_filter(z, lambda x: NOT len(list_distinct(coalesce(x.paragraph_ids, []))) + (len(list_filter(x.paragraph_ids, lambda q: q IS NULL)) > 0)::INT BETWEEN 1 AND 5)) > 0 THEN 'CITATION_COUNT'
        WHEN len(list_filter(z, lambda x: len(list_filter(x.paragraph_ids, lambda q: NOT coalesce(list_contains(a.ids, q), false))) > 0)) > 0 THEN 'UNKNOWN_PARAGRAPH' ELSE '' END AS error
        FROM precedent_summaries s LEFT JOIN a ON a.precedent_id = s.precedent_id)
      SELECT error, count(*) AS n, coalesce(sum(CASE WHEN error = '' THEN len(z) END), 0)::BIGINT AS n_sentences FROM v GROUP BY 1""",
    "session_answers": """SELECT DISTINCT id, CASE WHEN len(list_filter(q, lambda x: NOT list_contains(kept, x))) > 0 THEN 'INTAKE_ANSWER_REQUIRED' ELSE '' END AS error, CASE WHEN len(list_filter(q, lambda x: NOT list_contains(kept, x))) > 0 THEN 0 ELSE len(kept) END::BIGINT AS n_answers
      FROM (SELECT id, q, list_filter(coalesce(map_keys(answers), []), lambda k: list_contains(q, k) AND coalesce(trim(answers[k]), '') <> '') AS kept FROM (SELECT id, answers, list_transform(questions, lambda x: x.id) AS q FROM intake_sessions))""",
    "session_text": "SELECT DISTINCT id, sha256(array_to_string(list_concat([redacted_text], list_filter(list_transform(questions, lambda x: trim(answers[x.id])), lambda x: coalesce(x <> '', false))), chr(10))) AS query_hash FROM intake_sessions",
    "intake_questions": f"""SELECT DISTINCT id, array_to_string(list_filter([{', '.join(f"CASE WHEN coalesce(facts.{c}, '') IN ('', 'unknown', 'other') THEN '{f}' END" for f, c in (('expressionType', 'expression_type'), ('medium', 'medium'), ('recipientIdentification', 'recipient_identification'), ('reachedRecipient', 'reached_recipient'), ('relationship', 'relationship'), ('repetition', 'repetition')))}], lambda x: x IS NOT NULL)[1:3], ',') AS fields,
      'unclear,' || CASE WHEN coalesce(facts.medium, '') NOT IN ('', 'unknown') THEN 'present' ELSE 'unclear' END || ',' || CASE WHEN coalesce(facts.expression_type, '') NOT IN ('', 'other') THEN 'present' ELSE 'unclear' END || ',' ||
      CASE facts.reached_recipient WHEN 'yes' THEN 'present' WHEN 'no' THEN 'absent' ELSE 'unclear' END AS mentions FROM intake_sessions""",
    "session_purge": f"SELECT count_if(expires_at <= TIMESTAMP '{SESSIONS_AS_OF}')::BIGINT AS deleted, count_if(expires_at > TIMESTAMP '{SESSIONS_AS_OF}')::BIGINT AS kept FROM intake_sessions",
    "session_expiry": "SELECT user_id, count(*) AS n, min(ts + INTERVAL 1 HOUR) AS next_expiry FROM events WHERE ts + INTERVAL 1 HOUR > TIMESTAMP '2024-01-15 12:00:00' GROUP BY 1",
    "json_field": "SELECT json_extract_string(props, '$.k') AS k, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2",
    "quality_metrics": """WITH p AS (SELECT * FROM precedents WHERE decision_date IS NOT NULL), t AS (SELECT court, id, row_number() OVER (PARTITION BY court ORDER BY decision_date DESC, id) AS n FROM p WHERE searchable),
      f AS (SELECT court, list(id ORDER BY n) AS found FROM t WHERE n <= 3 GROUP BY 1),
      c AS (SELECT court, first(id ORDER BY decision_date DESC, id DESC) AS e, min(id) AS b, ends_with(court, '지원') AS none FROM p GROUP BY 1),
      x AS (SELECT c.*, coalesce(f.found, []) AS found FROM c LEFT JOIN f ON f.court = c.court),
      y AS (SELECT none, coalesce(found[1] = e, false) AS top1, list_contains(found, e) AS top3, list_contains(found, b) AS bad, len(found) = 0 AS empty FROM x)
      SELECT count(*) AS case_count, floor(count_if(NOT none AND top1)::DOUBLE / count_if(NOT none) * 10000 + 0.5) / 100 AS top1_accuracy, floor(count_if(NOT none AND top3)::DOUBLE / count_if(NOT none) * 10000 + 0.5) / 100 AS top3_recall,
        floor(count_if(bad)::DOUBLE / count(*) * 10000 + 0.5) / 100 AS forbidden_exposure, CASE WHEN count_if(none) = 0 THEN 0 ELSE floor(count_if(none AND empty)::DOUBLE / count_if(none) * 10000 + 0.5) / 100 END AS empty_accuracy,
        count_if(CASE WHEN none THEN NOT empty OR bad ELSE NOT top1 OR NOT top3 OR bad END)::BIGINT AS failures FROM y""",
    "customers_without_orders": "SELECT c_custkey, c_mktsegment FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)",
    "last_orders": 'SELECT c_custkey, max(o_orderdate) AS "last", count(*) AS n FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1',
    "gated_rights_join": "SELECT p.provider, count(*) AS n, sum(length(source_text))::BIGINT AS n_chars FROM precedents p JOIN data_sources d ON d.provider = p.provider AND d.enabled GROUP BY 1",
}
