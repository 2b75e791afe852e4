"""Integrity, metrics, constraints and reports (A4, A6, A7, A10, J3, J6, J7, R21, R22, SRC13, T5; section 1.3)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rules import compare_facts, facts
from ..functions.text import half_up, percent, url_part
from ..schema import DOMAINS, KEYS
from .grounding import unknown_citations


def domain_violations(df: DataFrame, key: str) -> DataFrame:
    """(key, field, value) of each value outside its closed domain; nulls count."""
    fields = [f for f in DOMAINS if f in df.columns]
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value"), F.coalesce(F.col(f).isin(DOMAINS[f]), F.lit(False)).alias("ok")) for f in fields]))
    return df.select(key, pairs.alias("p")).where(~F.col("p.ok")).select(key, "p.field", "p.value")


def key_violations(df: DataFrame, table: str) -> DataFrame:
    """(table_name, key_columns, n_keys) of each key that several rows hold; keys with a null part are no keys."""
    parts = []
    for cols in KEYS[table]:
        whole = reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in cols))
        again = df.where(whole).groupBy(*cols).count().where(F.col("count") > 1)
        parts.append(again.agg(F.count(F.lit(1)).alias("n_keys")).select(F.lit(table).alias("table_name"), F.lit(",".join(cols)).alias("key_columns"), "n_keys"))
    return reduce(DataFrame.unionByName, parts)


def searchable_violations(records: DataFrame) -> DataFrame:
    """(id, rule) of searchable records that aren't verified or whose link doesn't answer."""
    link = F.coalesce(F.col("link_status").between(200, 399), F.lit(False))
    rules = F.array_compact(F.array(F.when(F.col("verified_at").isNull(), "not_verified"), F.when(~link, "link_status")))
    return records.where("searchable").select("id", F.explode(rules).alias("rule"))


def integrity_report(records: DataFrame, orders: DataFrame, summaries: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """A4, J6, J7, V4. One row of counts."""
    without = records.where("searchable").join(orders.where(F.col("precedent_id").isNotNull()).select(F.col("precedent_id").alias("id")).distinct(), "id", "left_anti")
    stale = summaries.join(records.select(F.col("id").alias("precedent_id"), F.col("source_hash").alias("_h")), "precedent_id").where(F.col("source_hash") != F.col("_h"))
    one = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    parts = [
        one(orders.where(F.col("extraction_version") == "order-v1"), "orders_v1"), one(summaries.where(F.col("summary_version") == "grounded-v2"), "summaries_v2"),
        one(without, "searchable_without_order"), one(stale, "stale_hashes"), one(unknown_citations(summaries, paragraphs), "unknown_citations"),
    ]
    return reduce(lambda a, b: a.crossJoin(b), parts)  # each side is one row


def quality_metrics(cases: DataFrame) -> DataFrame:
    """A7. One row of case_count, top1, top3, forbidden, empty (percent) and failures.

    ``cases``: found ARRAY (best first), expected ARRAY, forbidden ARRAY, expect_empty BOOLEAN.
    """
    top = F.slice("found", 1, 3)
    d = cases.select(
        F.col("expect_empty").alias("e"), F.coalesce(F.array_contains("expected", F.get("found", F.lit(0))), F.lit(False)).alias("top1"), F.arrays_overlap(top, "expected").alias("top3"),
        F.arrays_overlap(top, "forbidden").alias("bad"), (F.size(top) == 0).alias("none"),
    )
    fails = F.when(F.col("e"), ~F.col("none") | F.col("bad")).otherwise(~F.col("top1") | ~F.col("top3") | F.col("bad"))
    n, ranked, empty = F.count(F.lit(1)), F.count_if(~F.col("e")), F.count_if("e")
    return d.agg(
        n.alias("case_count"), percent(F.count_if(~F.col("e") & F.col("top1")), ranked).alias("top1_accuracy"), percent(F.count_if(~F.col("e") & F.col("top3")), ranked).alias("top3_recall"),
        percent(F.count_if("bad"), n).alias("forbidden_exposure"), percent(F.count_if(F.col("e") & F.col("none")), empty).alias("empty_accuracy"), F.count_if(fails).alias("failures"),
    )


def model_comparison(runs: DataFrame) -> DataFrame:
    """A10. Per model: ok, failed, mean latency, tokens, dropped items."""
    return runs.groupBy("model").agg(
        F.count_if(F.col("error_code").isNull()).alias("n_ok"), F.count_if(F.col("error_code").isNotNull()).alias("n_failed"), F.avg("latency_ms").alias("mean_latency_ms"),
        F.sum("tokens").alias("n_tokens"), F.sum("n_dropped").alias("n_dropped"),
    )


def static_violations(curated: DataFrame) -> DataFrame:
    """SRC13. (id, rule) of each fault of a curated table: blank fields, unverified, address, anchors, repeated keys."""
    fields = ["id", "provider_record_id", "court", "case_number", "case_name", "decision_date", "official_url", "verified_at"]
    blank = lambda c: F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == ""
    host = F.coalesce(url_part(F.col("official_url"), "HOST").isin("law.go.kr", "www.law.go.kr") & (url_part(F.col("official_url"), "PROTOCOL") == "https"), F.lit(False))
    anchored = F.coalesce(F.forall("summary", lambda s: F.coalesce(s["sourceAnchor"] != "", F.lit(False))), F.lit(False))
    rules = [F.when(blank(f), f) for f in fields] + [F.when(~F.coalesce(F.col("verified"), F.lit(False)), "not-verified"), F.when(~host, "untrusted-url"), F.when(~anchored, "missing-source-anchor")]
    single = curated.select("id", F.explode(F.array_compact(F.array(*rules))).alias("rule"))
    key = ["court", "case_number", "decision_date"]
    again = curated.groupBy(*key).agg(F.array_sort(F.collect_list("id")).alias("ids")).where(F.size("ids") > 1)  # a curated table of few rows
    return single.unionByName(again.select(F.explode(F.slice("ids", 2, 1_000_000)).alias("id"), F.lit("duplicate").alias("rule")))


def static_rank(curated: DataFrame, description: Column, threshold: int = 55, most: int = 5) -> DataFrame:
    """R21, T5. id, semantic, fact_score, issue_score, total of the curated records, best first, or none at all if the
    best is below the threshold. ``curated`` has ordinal (its order breaks ties), facts STRUCT, keywords, issue_tags."""
    d = curated.withColumn("q", facts(description))
    hits = F.size(F.filter("keywords", lambda k: F.col("q.normalizedText").contains(F.lower(k))))
    bonus = lambda f, none, n: F.when((F.col(f"q.{f}") != none) & (F.col(f"q.{f}") == F.col(f"facts.{f}")), n).otherwise(0)
    semantic = F.least(F.lit(100), hits * 14 + bonus("medium", "unknown", 26) + bonus("expressionType", "other", 18))
    full = F.col("facts").withField("issueTags", F.col("issue_tags"))
    d = d.withColumn("semantic", semantic).withColumn("c", compare_facts(F.col("q"), full))
    d = d.withColumn("total", half_up(F.col("semantic") * 0.45 + F.col("c.factScore") * 0.45 + F.col("c.issueScore") * 0.1))
    top = d.agg(F.max("total").alias("_top"))
    out = d.crossJoin(top).where(F.col("_top") >= threshold)  # the other side is one row
    return out.orderBy(F.desc("total"), F.asc("ordinal")).limit(most).select("id", "semantic", F.col("c.factScore").alias("fact_score"), F.col("c.issueScore").alias("issue_score"), "total")


def fact_labels(pairs: Column, labels: dict[tuple[str, str], str], most: int = 4) -> Column:
    """R22. The labels of (field, precedentValue) pairs by a dictionary; pairs without one are left out."""
    table = F.create_map(*[F.lit(x) for (f, v), text in labels.items() for x in (f"{f}={v}", text)])
    named = F.transform(pairs, lambda p: F.try_element_at(table, F.concat(p["field"], F.lit("="), p["precedentValue"])))
    return F.slice(F.array_compact(named), 1, most)


def summary_estimate(paragraphs: DataFrame, doc: str, least: int = 3, normalize: bool = True) -> DataFrame:
    """A6. One row: documents with enough relevant paragraphs, and their characters."""
    from .sections import select_relevant

    one = select_relevant(paragraphs, doc, least=least, normalize=normalize).groupBy(doc).agg(F.sum(F.length("body")).alias("n"))
    return one.agg(F.count(F.lit(1)).alias("eligible"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_chars"))
