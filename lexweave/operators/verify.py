"""Verification of records and what may be searched (F7-F9, J5, DML6, DML7, DML9, SRC11, SRC15)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import url_part
from ..schema import SCHEMAS
from .sections import paragraphs_of

# Hosts of official texts.
OFFICIAL_HOSTS = ["law.go.kr", "www.law.go.kr", "open.law.go.kr", "scourt.go.kr", "www.scourt.go.kr"]
RIGHTS = ["storage_allowed", "indexing_allowed", "summary_allowed", "display_allowed"]
REQUIRED = ["court", "case_number", "decision_date", "official_url", "source_text", "source_hash"]


def is_official(c: Column, hosts: list[str] = OFFICIAL_HOSTS) -> Column:
    """F7. https and a listed host; anything that is no URL is not."""
    return F.coalesce((F.lower(url_part(c, "PROTOCOL")) == "https") & F.lower(url_part(c, "HOST")).isin(hosts), F.lit(False))


def record_error(hosts: list[str] = OFFICIAL_HOSTS) -> Column:
    """F8. The first of: missing metadata, URL, hash; null if the record is valid."""
    missing = F.lit(False)
    for c in REQUIRED:
        missing |= F.coalesce(F.col(c).cast("string"), F.lit("")) == ""
    return (
        F.when(missing, "SOURCE_METADATA_MISSING").when(~is_official(F.col("official_url"), hosts), "SOURCE_URL_INVALID")
        .when(F.sha2("source_text", 256) != F.col("source_hash"), "SOURCE_HASH_MISMATCH")
    )


def link_ok(c: Column) -> Column:
    """F5."""
    return F.coalesce(c.between(200, 399), F.lit(False))


def verify(records: DataFrame, rights: DataFrame, hosts: list[str] = OFFICIAL_HOSTS) -> DataFrame:
    """F8, F9, J5. id, error_code, paragraph_count, verified, searchable, rights_blocked of each record.

    The link's status is a column of ``records`` (probed by an adapter). A provider without reviewed rights has none;
    the right to pass on isn't needed.
    """
    allowed = F.lit(True)
    for r in RIGHTS:
        allowed &= F.coalesce(F.col(r), F.lit(False))
    d = records.join(rights.select("provider", *RIGHTS), "provider", "left").withColumn("_error", record_error(hosts))
    from ..functions.text import split_paragraphs

    d = d.withColumn("paragraph_count", F.size(split_paragraphs(F.col("source_text")))).withColumn("_rights", allowed)
    valid = F.col("_error").isNull() & (F.col("paragraph_count") > 0)
    verified = valid & link_ok(F.col("link_status"))
    error = F.coalesce("_error", F.when(F.col("paragraph_count") == 0, "SOURCE_PARAGRAPHS_MISSING"), F.when(~link_ok(F.col("link_status")), "SOURCE_LINK_INVALID"), F.when(~F.col("_rights"), "SOURCE_RIGHTS_REQUIRED"))
    return d.select(
        "id", error.alias("error_code"), "paragraph_count", verified.alias("verified"), (verified & F.col("_rights")).alias("searchable"), (verified & ~F.col("_rights")).alias("rights_blocked")
    )


def verification_counts(v: DataFrame) -> DataFrame:
    """A5. checked, verified, searchable, rejected, rights_blocked in one row."""
    return v.agg(
        F.count(F.lit(1)).alias("checked"), F.count_if("verified").alias("verified"), F.count_if("searchable").alias("searchable"), F.count_if(~F.col("verified")).alias("rejected"),
        F.count_if("rights_blocked").alias("rights_blocked"),
    )


def apply_verification(records: DataFrame, v: DataFrame, as_of: Column) -> DataFrame:
    """The records with their verification columns renewed."""
    j = records.drop("verified_at", "searchable", "link_checked_at").join(v.select("id", "verified", F.col("searchable")), "id")
    return j.withColumn("verified_at", F.when(F.col("verified"), as_of)).withColumn("link_checked_at", as_of).drop("verified")


def verified_paragraphs(records: DataFrame, v: DataFrame) -> DataFrame:
    """DML6, DML7. Paragraphs of the verified records; the others have none."""
    return paragraphs_of(records.join(v.where("verified").select("id"), "id", "left_semi").withColumnRenamed("id", "precedent_id"), "precedent_id", "source_text")


def reviews(records: DataFrame, v: DataFrame, as_of: Column) -> DataFrame:
    """DML9. One row of the history for each record."""
    j = records.select("id", "link_status").join(v, "id")
    status = F.when(F.col("searchable"), "searchable").when(F.col("verified"), "verified").otherwise("rejected")
    code = F.coalesce("error_code", F.lit(""))
    return j.select(
        F.col("id").alias("precedent_id"), status.alias("status"), (code != "SOURCE_METADATA_MISSING").alias("metadata_match"), (code != "SOURCE_HASH_MISMATCH").alias("content_match"),
        "link_status", "error_code", as_of.alias("reviewed_at"),
    )


def rights_record(spark: SparkSession, provider: str, evidence_url: str, *, approved: bool, key: str, reviewed_at: dt.datetime) -> DataFrame:
    """SRC15. One row of source_rights; needs the operator's approval and a key."""
    if not approved:
        raise ValueError("SOURCE_APPROVAL_REQUIRED")
    if not key:
        raise ValueError("SOURCE_KEY_REQUIRED")
    row = (provider, True, True, True, True, False, f"reviewed-{reviewed_at:%Y-%m-%d}", evidence_url, reviewed_at)
    return spark.createDataFrame([row], SCHEMAS["source_rights"])
