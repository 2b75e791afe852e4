"""Stored fact tags that queries share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import workflows
from ..session import read, stage_path

_STORED: dict[tuple[str, str], str] = {}


def stored_tags(spark: SparkSession, sf: str) -> DataFrame:
    """The stored tags of all precedents (id, text_hash, extraction_version, facts), made once a session by the backfill."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _STORED:
        path = stage_path(spark, "tags")
        workflows.backfill_tags(read(spark, sf, "precedents"), normalize=False)[0].write.parquet(path)
        _STORED[key] = path
    return spark.read.parquet(_STORED[key])


def with_stored_facts(records: DataFrame, spark: SparkSession, sf: str) -> DataFrame:
    """J1. Records with their stored ``facts``."""
    return records.join(stored_tags(spark, sf).select("id", "facts"), "id", "left")
