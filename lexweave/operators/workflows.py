"""Workflows over the operators: stored tags, backfill of summaries, analyses, verification, sync of arrivals (DML1-DML4, DML10-DML12, F13, J1, U2-U4).

Each returns whole new tables and what became of every record; ``run_sync`` publishes all of its tables or none.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.rules import KOREAN, TARGET, facts, focus, is_target_case
from ..functions.text import sha256, stable_id
from ..session import durable
from .embedding import extractive_summary
from .grounding import analysis_schema, validate_analysis, validate_summary
from .merge import current_runs, existing_matches, merge_upsert, publish, published, replace_children, rotate_primary, run_row, state_counts, upsert_records
from .search import SUMMARY_VERSION
from .sections import document_facts, extract_orders, paragraphs_of, select_relevant
from .verify import verify

VERSION = KOREAN.version


# --- stored fact tags -------------------------------------------------------------------------------------------------


def backfill_tags(records: DataFrame, stored: DataFrame | None = None, *, text: str = "source_text", normalize: bool = True) -> tuple[DataFrame, DataFrame]:
    """(tags, states). Tags (id, text_hash, extraction_version, facts) of all ``records``, made anew only where the text or the
    version of the rules has changed; states (id, state): new, renewed or kept. Tags of records that are gone stay.
    """
    now = records.select("id", F.col(text).alias("_text"), sha256(F.coalesce(F.col(text), F.lit(""))).alias("text_hash"))
    if stored is None:
        states = now.withColumn("state", F.lit("new"))
    else:
        old = stored.select("id", F.col("text_hash").alias("_h"), F.col("extraction_version").alias("_v"))
        same = F.col("_h").eqNullSafe(F.col("text_hash")) & F.col("_v").eqNullSafe(F.lit(VERSION))
        states = now.join(old, "id", "left").withColumn("state", F.when(F.col("_h").isNull(), "new").when(same, "kept").otherwise("renewed"))
    made = states.where("state <> 'kept'").select("id", "text_hash", F.lit(VERSION).alias("extraction_version"), facts(F.col("_text"), normalize=normalize).alias("facts"))
    return made if stored is None else merge_upsert(stored, made, ["id"]), states.select("id", "state")


# --- summaries --------------------------------------------------------------------------------------------------------


class Summariser(Protocol):
    """U2. An adapter: paragraphs (paragraph_id, body) to the JSON text of {"sentences": [{"text", "paragraphIds"}]}."""

    model: str

    def summarize(self, paragraphs: list[dict]) -> str: ...


class ExtractiveSummariser:
    """The offline adapter: the first sentences as they stand; it has a Column form and never leaves the JVM."""

    model = "extractive"

    def column(self, paragraphs: Column) -> Column:
        return F.to_json(extractive_summary(paragraphs))


def _payloads(paragraphs: Column, summariser: Summariser) -> Column:
    """STRUCT<payload, error_code>: an adapter that fails on a record leaves an error there and nowhere else."""
    if hasattr(summariser, "column"):
        return F.struct(summariser.column(paragraphs).alias("payload"), F.lit(None).cast("string").alias("error_code"))
    schema = T.StructType([T.StructField("payload", T.StringType()), T.StructField("error_code", T.StringType())])

    def run(s: pd.Series) -> pd.DataFrame:
        rows = []
        for p in s:
            try:
                rows.append((summariser.summarize([dict(x) for x in p]), None))
            except Exception as e:  # noqa: BLE001
                rows.append((None, getattr(e, "code", "SUMMARY_FAILED")))
        return pd.DataFrame(rows, columns=["payload", "error_code"])

    return F.pandas_udf(run, schema)(paragraphs)


def backfill_summaries(
    records: DataFrame, rights: DataFrame, paragraphs: DataFrame, stored: DataFrame, summariser: Summariser, as_of: Column, *, normalize: bool = True, allow_external: bool = False
) -> tuple[DataFrame, DataFrame]:
    """(summaries, outcomes): F13, J2, J3, U2, U4, U5.

    Selected are searchable, verified records of the target with a working link, paragraphs and the right to summarise
    and show them. Unfocused ones and those whose summary is of this text, version and model are skipped; the others go
    to the adapter, and what passes V1 takes the place of the old summary. Outcomes: id, state (generated, skipped,
    failed) and error_code. Paragraphs are unique by id; ``stored`` holds a record once.
    """
    if not allow_external and not hasattr(summariser, "column"):
        raise PermissionError("EXTERNAL_ADAPTER_NOT_ALLOWED")
    may = rights.where("summary_allowed AND display_allowed").select("provider")
    link = F.coalesce(F.col("link_status").between(200, 399), F.lit(False))
    has = paragraphs.select(F.col("precedent_id").alias("id")).distinct()
    selected = records.where(F.col("searchable") & F.col("verified_at").isNotNull() & link & F.col("case_name").contains(TARGET)).join(may, "provider", "left_semi").join(has, "id", "left_semi")
    old = stored.select(F.col("precedent_id").alias("id"), F.col("source_hash").alias("_h"), F.col("summary_version").alias("_v"), F.col("model").alias("_m"))
    current = (F.col("_h") == F.col("source_hash")) & (F.col("_v") == SUMMARY_VERSION) & (F.col("_m") == summariser.model)
    skip = (focus(F.col("case_name"), normalize) != "focused") | F.coalesce(current, F.lit(False))
    d = selected.select("id", "source_hash", "case_name").join(old, "id", "left").select("id", "source_hash", skip.alias("skip"))
    todo = paragraphs.join(d.where(~F.col("skip")).select(F.col("id").alias("precedent_id")), "precedent_id", "left_semi")
    parts = select_relevant(todo, "precedent_id", normalize=normalize)
    inputs = parts.groupBy(F.col("precedent_id").alias("id")).agg(  # bounded by the budget of characters of one document
        F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "paragraph_id", "body"))), lambda p: F.struct(p["paragraph_id"].alias("paragraph_id"), p["body"].alias("body"))).alias("p")
    )
    made = inputs.select("id", F.transform("p", lambda x: x["paragraph_id"]).alias("ids"), _payloads(F.col("p"), summariser).alias("a"))
    made = made.select("id", "a.error_code", validate_summary(F.col("a.payload"), F.col("ids")).alias("v"))
    j = d.join(made, "id", "left")
    error = F.when(~F.col("skip"), F.when(F.col("v").isNull(), "SUMMARY_INPUT_REQUIRED").otherwise(F.coalesce("error_code", "v.error")))
    outcomes = j.select("id", F.when(F.col("skip"), "skipped").when(error.isNull(), "generated").otherwise("failed").alias("state"), error.alias("error_code"), "source_hash", "v.sentences")
    fresh = outcomes.where("state = 'generated'").select(
        F.col("id").alias("precedent_id"), "source_hash", F.lit(SUMMARY_VERSION).alias("summary_version"), F.lit(summariser.model).alias("model"),
        F.transform("sentences", lambda s: F.struct(s["text"].alias("text"), s["paragraphIds"].alias("paragraph_ids"))).alias("sentences"), as_of.alias("generated_at"),
    )
    return merge_upsert(stored, fresh, ["precedent_id"]), outcomes.select("id", "state", "error_code")


def outcome_counts(outcomes: DataFrame) -> DataFrame:
    """One row: selected, generated, skipped, failed."""
    return outcomes.agg(F.count(F.lit(1)).alias("selected"), *[F.count_if(F.col("state") == s).alias(s) for s in ("generated", "skipped", "failed")])


# --- analyses ---------------------------------------------------------------------------------------------------------


class Analyst(Protocol):
    """U3. An adapter: a document (``grounding.analysis_input``) and the schema of the answer, to the answer's JSON text."""

    def analyze(self, document: str, schema: dict) -> str: ...


def analyses(requests: DataFrame, analyst: Analyst, *, allow_external: bool = False) -> DataFrame:
    """id, analysis (V2) and error_code of each request (id, document, case_numbers ARRAY).

    A request without consent has no business here: adapters are asked only with ``allow_external``. One that fails, or
    answers with no JSON object, leaves an error on its row; whatever it says is judged by V2 against the given numbers.
    """
    if not allow_external:
        raise PermissionError("EXTERNAL_ADAPTER_NOT_ALLOWED")
    schema = T.StructType([T.StructField("payload", T.StringType()), T.StructField("error_code", T.StringType())])

    def run(documents: pd.Series, numbers: pd.Series) -> pd.DataFrame:
        rows = []
        for d, n in zip(documents, numbers):
            try:
                rows.append((analyst.analyze(d, analysis_schema([] if n is None else list(n))), None))
            except Exception as e:  # noqa: BLE001
                rows.append((None, getattr(e, "code", "ANALYSIS_API_UNAVAILABLE")))
        return pd.DataFrame(rows, columns=["payload", "error_code"])

    d = requests.select("id", "case_numbers", F.pandas_udf(run, schema)("document", "case_numbers").alias("a"))
    v = d.select("id", F.col("a.error_code").alias("_e"), validate_analysis(F.col("a.payload"), F.coalesce("case_numbers", F.array().cast("array<string>"))).alias("v"))
    error = F.coalesce("_e", F.when(F.array_contains("v.dropped", "payload"), "ANALYSIS_RESPONSE_INVALID"))
    return v.select("id", F.when(error.isNull(), F.col("v")).alias("analysis"), error.alias("error_code"))


# --- verification -----------------------------------------------------------------------------------------------------

def verify_stored(tables: dict[str, DataFrame], rights: DataFrame, as_of: Column, hosts: list[str], *, normalize: bool = True) -> tuple[dict[str, DataFrame], DataFrame]:
    """(tables, outcome): F8, F9, DML6, DML7, DML12. Verifies all ``precedents`` and renews what hangs on them.

    Records that are valid in themselves get their paragraphs anew, others lose them; tags and orders are made anew for
    records that are verified (their link answers too) and go with the verification of the others. Children of records
    that are not in ``precedents`` stay. Tags have precedent_id, facts, evidence; orders precedent_id, order_text,
    paragraph_ids, kind, extraction_version. ``outcome`` is that of ``verify``.
    """
    records = tables["precedents"]
    outcome = durable(verify(records, rights, hosts))
    later = ["SOURCE_PARAGRAPHS_MISSING", "SOURCE_LINK_INVALID", "SOURCE_RIGHTS_REQUIRED"]  # what is found once a record is valid in itself
    valid = outcome.select("id", "verified", "searchable", (F.col("error_code").isNull() | F.col("error_code").isin(later)).alias("valid"))
    good = lambda c: records.join(valid.where(c).select("id"), "id", "left_semi").select(F.col("id").alias("precedent_id"), "source_text")
    paragraphs = paragraphs_of(good("valid"), "precedent_id", "source_text")
    checked = paragraphs_of(good("verified"), "precedent_id", "source_text")
    ids = records.select(F.col("id").alias("precedent_id"))
    fresh = {
        "precedent_paragraphs": paragraphs, "precedent_fact_tags": document_facts(checked, "precedent_id", normalize=normalize),
        "precedent_dispositions": extract_orders(checked, "precedent_id", normalize=normalize),
    }
    out = {name: replace_children(tables[name], fresh[name], "precedent_id", ids) for name in fresh if name in tables}
    renewed = {
        "verified_at": F.when(F.col("_verified"), as_of), "link_checked_at": as_of, "link_status": F.when(F.col("_valid"), F.col("link_status")), "searchable": F.col("_searchable"),
    }
    j = records.join(valid.select("id", *[F.col(c).alias(f"_{c}") for c in ("valid", "verified", "searchable")]), "id")
    return {**tables, **out, "precedents": j.withColumns(renewed).select(records.columns)}, outcome


# --- sync -------------------------------------------------------------------------------------------------------------


@dataclass
class Synced:
    """The new tables of a sync, and the state of each arrival (with skipped for those outside the target)."""

    tables: dict[str, DataFrame]
    states: DataFrame

    def counts(self) -> DataFrame:
        """One row: fetched, n_new, n_changed, n_unchanged, n_duplicate, skipped."""
        done = state_counts(self.states.where("state <> 'skipped'"))
        return done.crossJoin(self.states.agg(F.count_if(F.col("state") == "skipped").alias("skipped")))  # both sides are one row


def sync(tables: dict[str, DataFrame], arrivals: DataFrame, source_id: str, run_id: str, as_of: Column, *, normalize: bool = True) -> Synced:
    """Works arrivals into precedents, source_documents and precedent_sources.

    ``arrivals``: one decoded record each of provider, provider_record_id, court, case_number, case_name, decision_date,
    official_url, source_text, source_hash, raw_hash, raw_payload. Records outside the target are skipped. A raw document
    is stored once for its content; later deliveries of the same content touch it. A record of a known provider key
    overwrites the stored one, which keeps its verification only while the text is the same; one known by court, number
    and day alone is a duplicate and adds a source only.
    """
    pre, docs, sources = tables["precedents"], tables["source_documents"], tables["precedent_sources"]
    inside = is_target_case(F.col("case_name"), normalize)
    taken = existing_matches(arrivals.where(inside), pre)
    taken = taken.withColumn("id", F.coalesce("existing_id", stable_id(F.col("provider"), F.col("provider_record_id"))))
    taken = taken.withColumn("document_id", stable_id(F.lit(source_id), F.col("provider_record_id"), F.col("raw_hash")))
    seen = taken.select(
        F.col("document_id").alias("id"), F.lit(source_id).alias("source_id"), F.lit(run_id).alias("sync_run_id"), F.col("provider_record_id").alias("external_id"), "raw_hash", "raw_payload",
        as_of.alias("fetched_at"),
    )
    keep = lambda c: (F.lit(True), F.col(f"s.{c}"))
    docs = merge_upsert(docs, seen, ["source_id", "external_id", "raw_hash"], {"id": keep("id"), "raw_payload": keep("raw_payload")})
    ids = docs.select(F.col("id").alias("source_document_id"), F.col("external_id").alias("provider_record_id"), "raw_hash").where(F.col("source_id") == source_id)
    columns = ["id", "provider", "provider_record_id", "court", "case_number", "case_name", "decision_date", "official_url", "source_text", "source_hash"]
    records = taken.where("state <> 'duplicate'").select(*columns, as_of.alias("collected_at"))
    linked = taken.join(ids, ["provider_record_id", "raw_hash"]).select(F.col("id").alias("precedent_id"), "source_document_id", "official_url", "state")
    states = taken.select("provider_record_id", "id", "state").unionByName(arrivals.where(~inside).select("provider_record_id", F.lit(None).cast("string").alias("id"), F.lit("skipped").alias("state")))
    new = {"precedents": upsert_records(pre, records, ["provider", "provider_record_id"]), "source_documents": docs, "precedent_sources": rotate_primary(sources, linked)}
    return Synced(new, states)


def run_sync(spark: SparkSession, root: str, arrivals: DataFrame, source_id: str, run_id: str, query: str, started_at, completed_at, *, normalize: bool = True) -> dict:
    """DML10, DML11. One sync over the published tables: all new tables are published, or none; the run log has its outcome either way."""
    names = ["precedents", "source_documents", "precedent_sources"]

    def log(row: DataFrame) -> None:
        try:
            row = published(spark, f"{root}/runs", ["sync_runs"])["sync_runs"].unionByName(row)
        except FileNotFoundError:  # the first run
            pass
        publish(spark, {"sync_runs": current_runs(row)}, f"{root}/runs", run_id)

    try:
        done = sync(published(spark, root, names), arrivals, source_id, run_id, F.lit(completed_at).cast("timestamp"), normalize=normalize)
        counts = done.counts().first().asDict()
        publish(spark, done.tables, root, run_id)
    except Exception as e:
        log(run_row(spark, run_id, source_id, query, "failed", started_at, completed_at, error_code=getattr(e, "code", "SYNC_FAILED")))
        raise
    log(run_row(spark, run_id, source_id, query, "succeeded", started_at, completed_at, counts["fetched"], counts["n_new"] + counts["n_changed"]))
    return counts
