"""Queries of the table-hygiene operators (snapshot differences, orphan references) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.orphans import OrphanCascade, references, targets
from ..operators.snapshot_diff import snapshot_changes
from ..session import read


def _changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = [
        ("precedent_snapshots", ["provider", "provider_record_id"], "source_hash", "delivered_at"),
        ("source_documents", ["source_id", "external_id"], "raw_hash", "fetched_at"),
    ]
    both = [
        snapshot_changes(read(spark, sf_dir, t), snapshot="snapshot_no", keys=k, digest=h, order=o).select(
            F.lit(t).alias("table_name"), "snapshot_no", F.col("key_0").alias("source_key"), F.col("key_1").alias("record_key"), "change_kind"
        )
        for t, k, h, o in kinds
    ]
    return both[0].unionByName(both[1])


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _changes(spark, sf_dir)


def p1_change_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _changes(spark, sf_dir).groupBy("table_name", "snapshot_no", "change_kind").agg(F.count(F.lit(1)).alias("n_records"))


def _cascade(spark: SparkSession, sf_dir: str) -> OrphanCascade:
    pre, par = read(spark, sf_dir, "precedents"), read(spark, sf_dir, "precedent_paragraphs")
    dis, summ = read(spark, sf_dir, "precedent_dispositions"), read(spark, sf_dir, "precedent_summaries")
    pid, own = F.col("precedent_id"), (F.col("precedent_id"), F.lit(""))
    cited = dis.select("precedent_id", "extracted_at", F.explode("paragraph_ids").alias("paragraph_id"))
    quoted = summ.select("precedent_id", "generated_at", F.explode("sentences").alias("s")).select(
        "precedent_id", "generated_at", F.explode("s.paragraph_ids").alias("paragraph_id")
    )
    key = (pid, F.col("paragraph_id"))
    return OrphanCascade(
        [
            references(par, "precedent_paragraphs", key, "precedents", (pid, None), "loaded_at"),
            references(dis, "precedent_dispositions", own, "precedents", (pid, None), "extracted_at"),
            references(summ, "precedent_summaries", own, "precedents", (pid, None), "generated_at"),
            references(cited, "precedent_dispositions", own, "precedent_paragraphs", key, "extracted_at"),
            references(quoted, "precedent_summaries", own, "precedent_paragraphs", key, "generated_at"),
        ],
        [targets(pre, "precedents", (F.col("id"), None), "collected_at"), targets(par, "precedent_paragraphs", key, "loaded_at")],
    )


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cascade(spark, sf_dir).direct().select("ref_table", F.col("k1").alias("precedent_id"), F.col("k2").alias("paragraph_id"))


def p4_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct orphan references per table and month of the referring row, direct and inherited."""
    return _cascade(spark, sf_dir).report()


QUERIES = {"p1_found": p1_found, "p1_change_counts": p1_change_counts, "p4_found": p4_found, "p4_report": p4_report}

_CHANGES = """
WITH raw AS (
  SELECT 'precedent_snapshots' AS table_name, snapshot_no, provider AS source_key, provider_record_id AS record_key,
         regexp_replace(lower(trim(source_hash)), '^(0x)?0*', '') AS h, delivered_at AS t FROM precedent_snapshots
  UNION ALL
  SELECT 'source_documents', snapshot_no, source_id, external_id, regexp_replace(lower(trim(raw_hash)), '^(0x)?0*', ''), fetched_at FROM source_documents),
one AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY table_name, snapshot_no, source_key, record_key ORDER BY t DESC, h DESC NULLS LAST) AS rn FROM raw) WHERE rn = 1),
nums AS (
  SELECT table_name, snapshot_no, lag(snapshot_no) OVER (PARTITION BY table_name ORDER BY snapshot_no) AS before,
         lead(snapshot_no) OVER (PARTITION BY table_name ORDER BY snapshot_no) AS after
  FROM (SELECT DISTINCT table_name, snapshot_no FROM raw)),
found AS (
  SELECT n.table_name, n.snapshot_no, l.source_key, l.record_key, CASE WHEN e.table_name IS NULL THEN 'added' ELSE 'changed' END AS change_kind
  FROM nums n JOIN one l ON l.table_name = n.table_name AND l.snapshot_no = n.snapshot_no
  LEFT JOIN one e ON e.table_name = n.table_name AND e.snapshot_no = n.before AND e.source_key = l.source_key AND e.record_key = l.record_key
  WHERE n.before IS NOT NULL AND (e.table_name IS NULL OR e.h IS DISTINCT FROM l.h)
  UNION ALL
  SELECT n.table_name, n.snapshot_no, e.source_key, e.record_key, 'removed'
  FROM nums n JOIN one e ON e.table_name = n.table_name AND e.snapshot_no = n.before
  WHERE NOT EXISTS (SELECT 1 FROM one l WHERE l.table_name = n.table_name AND l.snapshot_no = n.snapshot_no AND l.source_key = e.source_key AND l.record_key = e.record_key))
"""

_ORPHANS = """
WITH cited AS (SELECT precedent_id, unnest(paragraph_ids) AS paragraph_id, extracted_at AS t FROM precedent_dispositions),
sent AS (SELECT precedent_id, unnest(sentences) AS s, generated_at AS t FROM precedent_summaries),
quoted AS (SELECT precedent_id, unnest(s.paragraph_ids) AS paragraph_id, t FROM sent),
refs AS (
  SELECT 'precedent_paragraphs' AS ref_table, precedent_id, '' AS paragraph_id, loaded_at AS t, precedent_id AS own_1, paragraph_id AS own_2 FROM precedent_paragraphs WHERE precedent_id <> ''
  UNION ALL SELECT 'precedent_dispositions', precedent_id, '', extracted_at, precedent_id, '' FROM precedent_dispositions WHERE precedent_id <> ''
  UNION ALL SELECT 'precedent_summaries', precedent_id, '', generated_at, precedent_id, '' FROM precedent_summaries WHERE precedent_id <> ''
  UNION ALL SELECT 'precedent_dispositions', precedent_id, paragraph_id, t, precedent_id, '' FROM cited WHERE paragraph_id <> '' AND precedent_id <> ''
  UNION ALL SELECT 'precedent_summaries', precedent_id, paragraph_id, t, precedent_id, '' FROM quoted WHERE paragraph_id <> '' AND precedent_id <> ''),
tgt AS (
  SELECT id AS precedent_id, '' AS paragraph_id, min(collected_at) AS a FROM precedents GROUP BY 1
  UNION ALL SELECT precedent_id, paragraph_id, min(loaded_at) FROM precedent_paragraphs WHERE paragraph_id <> '' GROUP BY 1, 2),
judged AS (
  SELECT r.*, g.precedent_id IS NULL OR coalesce(g.a > r.t, false) AS direct
  FROM refs r LEFT JOIN tgt g ON g.precedent_id = r.precedent_id AND g.paragraph_id = r.paragraph_id)
"""

ORACLE = {
    "p1_found": _CHANGES + "SELECT * FROM found",
    "p1_change_counts": _CHANGES + "SELECT table_name, snapshot_no, change_kind, count(*) AS n_records FROM found GROUP BY 1, 2, 3",
    "p4_found": _ORPHANS + "SELECT DISTINCT ref_table, precedent_id, paragraph_id FROM judged WHERE direct",
    "p4_report": _ORPHANS
    + """, bad AS (SELECT DISTINCT own_1, own_2 FROM judged WHERE direct AND ref_table = 'precedent_paragraphs'),
    monthly AS (
      SELECT j.ref_table, j.precedent_id, j.paragraph_id, strftime(j.t, '%Y-%m') AS month, bool_or(direct) AS direct, bool_or(b.own_1 IS NOT NULL) AS bad
      FROM judged j LEFT JOIN bad b ON j.paragraph_id <> '' AND b.own_1 = j.precedent_id AND b.own_2 = j.paragraph_id GROUP BY 1, 2, 3, 4)
    SELECT ref_table, month, CASE WHEN direct THEN 'direct' ELSE 'inherited' END AS orphan_kind, count(*) AS n_references
    FROM monthly WHERE direct OR bad GROUP BY 1, 2, 3""",
}
