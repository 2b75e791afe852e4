"""Upserts, deletes and logs as new snapshots of a table (DML1-DML13, J9, X18, A5, W5).

Parquet tables have no row-level writes: each function returns the whole new table, and ``publish`` swaps it in.
"""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """W5. One row a key: the first in ``order`` (give a total order)."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def merge_upsert(target: DataFrame, source: DataFrame, keys: list[str], keep: dict[str, tuple[Column, Column]] | None = None) -> DataFrame:
    """DML1-DML3, DML12. New rows are added; of matched keys the source's columns win.

    ``keep`` names columns of the target that stay under a condition: {column: (condition, otherwise)}; the condition
    reads the target as t and the source as s. Columns the source lacks stay as they are. Keys are null-safe; both
    sides hold a key once.
    """
    keep = keep or {}
    t, s = target.withColumn("_t", F.lit(True)).alias("t"), source.withColumn("_s", F.lit(True)).alias("s")
    on = [F.col(f"t.{k}").eqNullSafe(F.col(f"s.{k}")) for k in keys]
    cond = on[0]
    for c in on[1:]:
        cond &= c
    j = t.join(s, cond, "full_outer")
    out = []
    for c in target.columns:
        old = F.col(f"t.{c}")
        if c in keep:
            ok, other = keep[c]
            new = F.when(F.col("t._t").isNull(), F.col(f"s.{c}") if c in source.columns else other).when(F.col("s._s").isNull(), old).when(ok, old).otherwise(other)
        elif c in source.columns:
            new = F.when(F.col("s._s"), F.col(f"s.{c}")).otherwise(old)
        else:
            new = old
        out.append(new.alias(c))
    return j.select(*out)


def upsert_records(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """DML1. Metadata is overwritten; verification columns stay only while the text's hash is the same."""
    same = F.col("t.source_hash").eqNullSafe(F.col("s.source_hash"))
    reset = {c: (same, F.lit(None)) for c in ("verified_at", "link_checked_at", "link_status") if c in target.columns}
    if "searchable" in target.columns:
        reset["searchable"] = (same, F.lit(False))
    source = source.drop(*reset)
    if "id" in target.columns and "id" in source.columns:
        reset["id"] = (F.lit(True), F.col("s.id"))  # a known record keeps its id
    return merge_upsert(target, source, keys, reset)


def insert_missing(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """DML5. Rows of known keys are ignored."""
    return target.unionByName(source.join(target.select(*keys), keys, "left_anti").select(*target.columns))


def replace_children(children: DataFrame, fresh: DataFrame, parent: str, parents: DataFrame) -> DataFrame:
    """DML6, DML7. Children of ``parents`` (one column ``parent``) are replaced by ``fresh``; none there deletes them."""
    return children.join(parents.select(parent), parent, "left_anti").unionByName(fresh.select(*children.columns))


def delete_cascade(tables: dict[str, tuple[DataFrame, str]], ids: DataFrame, confirm: bool = False) -> tuple[dict[str, DataFrame], DataFrame]:
    """DML8. Rows of the ids leave every table (DataFrame, key column); without ``confirm`` tables stay as they are.

    Also returns what a run would delete: table_name, stored, unrelated, deleted.
    """
    ids = ids.toDF("_id").distinct()
    out, report = {}, None
    for name, (df, key) in tables.items():
        marked = df.join(ids.withColumn("_gone", F.lit(True)), df[key] == F.col("_id"), "left")
        n = marked.agg(F.count(F.lit(1)).alias("stored"), F.count("_gone").alias("unrelated"))
        n = n.select(F.lit(name).alias("table_name"), "stored", "unrelated", (F.col("unrelated") if confirm else F.lit(0).cast("bigint")).alias("deleted"))
        report = n if report is None else report.unionByName(n)
        out[name] = df.join(ids, df[key] == F.col("_id"), "left_anti") if confirm else df
    return out, report


def existing_matches(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """J9, X18. Each incoming record with ``existing_id`` and ``state``: new, duplicate, unchanged or changed.

    By provider and record id, else by court, case number and day: two joins on equality, as one on either would be a
    nested loop. The stored side holds each provider key once; of a canonical key the least id counts.
    """
    a = stored.select("provider", "provider_record_id", F.col("id").alias("_a_id"), F.col("source_hash").alias("_a_hash"))
    b = stored.where(F.col("court").isNotNull() & F.col("case_number").isNotNull() & F.col("decision_date").isNotNull())
    b = b.groupBy("court", "case_number", "decision_date").agg(F.min("id").alias("_b_id"))
    j = incoming.join(a, ["provider", "provider_record_id"], "left").join(b, ["court", "case_number", "decision_date"], "left")
    state = (
        F.when(F.col("_a_id").isNull() & F.col("_b_id").isNull(), "new").when(F.col("_a_id").isNull(), "duplicate")
        .when(F.col("_a_hash").eqNullSafe(F.col("source_hash")), "unchanged").otherwise("changed")
    )
    return j.withColumn("state", state).withColumn("existing_id", F.coalesce("_a_id", "_b_id")).select(*incoming.columns, "existing_id", "state")


def state_counts(states: DataFrame) -> DataFrame:
    """A5. One row: fetched, and how many in each state."""
    return states.agg(F.count(F.lit(1)).alias("fetched"), *[F.count_if(F.col("state") == s).alias(f"n_{s}") for s in ("new", "changed", "unchanged", "duplicate")])


def rotate_primary(sources: DataFrame, arrivals: DataFrame) -> DataFrame:
    """DML4, Q10. ``sources`` with ``arrivals`` (precedent_id, source_document_id, official_url, state) worked in.

    A record that isn't a duplicate becomes the only primary source of its precedent; duplicates are added beside it.
    """
    lead = arrivals.where("state <> 'duplicate'").select("precedent_id").distinct().withColumn("_new", F.lit(True))
    old = sources.join(arrivals.select("precedent_id", "source_document_id"), ["precedent_id", "source_document_id"], "left_anti").join(lead, "precedent_id", "left")
    old = old.withColumn("is_primary", F.col("is_primary") & F.col("_new").isNull()).select("precedent_id", "source_document_id", "official_url", "is_primary")
    new = arrivals.select("precedent_id", "source_document_id", "official_url", (F.col("state") != "duplicate").alias("is_primary"))
    return old.unionByName(new)


def run_row(spark: SparkSession, run_id: str, source_id: str, query: str, status: str, started_at, completed_at=None, fetched: int = 0, changed: int = 0, error_code: str | None = None) -> DataFrame:
    """DML10. One row of the run log; the row last in completed_at stands for the run (``current_runs``)."""
    from ..schema import SCHEMAS

    return spark.createDataFrame([(run_id, source_id, query, status, fetched, changed, error_code, started_at, completed_at)], SCHEMAS["sync_runs"])


def current_runs(log: DataFrame) -> DataFrame:
    return latest(log, ["id"], [F.col("completed_at").desc_nulls_last(), F.col("status").desc()])


def _files(spark: SparkSession, root: str):
    jvm = spark._jvm
    path = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    return path, path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _pointers(spark: SparkSession, root: str) -> list[str]:
    path, fs = _files(spark, root)
    if not fs.exists(path(root)):
        return []
    return sorted(n for n in (f.getPath().getName() for f in fs.listStatus(path(root))) if n.startswith("current-"))


def publish(spark: SparkSession, tables: dict[str, DataFrame], root: str, version: str) -> None:
    """DML11. All tables are written under a new version, then a pointer is added; the last pointer counts.

    A pointer is written aside and renamed to a name that is new, and none is ever deleted, so readers always find a
    version and see all of its tables or none. A run that fails before the rename changes nothing for them.
    """
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{root}/{version}/{name}")
    path, fs = _files(spark, root)
    last = _pointers(spark, root)
    number = int(last[-1].split("-")[1]) + 1 if last else 0
    aside = path(f"{root}/_new-{version}")
    out = fs.create(aside, True)
    out.write(bytearray(json.dumps({"version": version, "tables": sorted(tables)}).encode()))
    out.close()
    if not fs.rename(aside, path(f"{root}/current-{number:012d}")):
        raise RuntimeError("another run has published at the same time")


def published(spark: SparkSession, root: str, names: Iterable[str]) -> dict[str, DataFrame]:
    """The tables of the last version that was published."""
    last = _pointers(spark, root)
    if not last:
        raise FileNotFoundError(f"nothing is published in {root}")
    version = json.loads(spark.read.text(f"{root}/{last[-1]}").first()[0])["version"]
    return {n: spark.read.parquet(f"{root}/{version}/{n}") for n in names}
