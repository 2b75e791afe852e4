"""Queries of the operators for training text, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import read
from .charforms import normalized
from .history import classes, repeated_decisions
from .mixing import Mix
from .packing import pack, piece_texts
from .splitting import split_oversized
from .stuffing import stuffing


def _limits(spark: SparkSession, sf_dir: str, unit: str) -> list:
    """size_limits is a configuration table of a few rows that does not grow."""
    return read(spark, sf_dir, "size_limits").where(F.col("unit") == unit).orderBy("limit_name").collect()


_TEXT_KEYS = {"precedents": ["id"], "precedent_paragraphs": ["precedent_id", "paragraph_id"]}


def p2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """table_name, precedent_id, paragraph_id, piece_no, piece_start, piece_end, piece of every oversized text."""
    out = None
    for l in _limits(spark, sf_dir, "chars"):  # noqa: E741
        keys = _TEXT_KEYS[l["table_name"]]
        got = split_oversized(read(spark, sf_dir, l["table_name"]), keys, l["column_name"], l["max_size"], l["overlap_size"])
        got = got.select(
            F.lit(l["table_name"]).alias("table_name"), F.col(keys[0]).alias("precedent_id"), (F.col(keys[1]) if len(keys) > 1 else F.lit("")).alias("paragraph_id"),
            "piece_no", "piece_start", "piece_end", "piece",
        )
        out = got if out is None else out.unionByName(got)
    return out


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p2_pieces(spark, sf_dir).select("table_name", "precedent_id", "paragraph_id").distinct()


def _forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    par = read(spark, sf_dir, "precedent_paragraphs").select(F.lit("precedent_paragraphs").alias("table_name"), F.col("precedent_id").alias("record_id"), "paragraph_id", F.col("body").alias("text"))
    ses = read(spark, sf_dir, "intake_sessions").select(F.lit("intake_sessions").alias("table_name"), F.col("id").alias("record_id"), F.lit("").alias("paragraph_id"), F.col("redacted_text").alias("text"))
    return par.unionByName(ses).withColumn("normal_text", normalized(F.col("text")))


def p3_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The consistent form of every text (all rows, as delivered)."""
    return _forms(spark, sf_dir).drop("text")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _forms(spark, sf_dir).where(F.col("normal_text") != F.col("text")).select("table_name", "record_id", "paragraph_id").distinct()


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_decisions(read(spark, sf_dir, "precedents"))


def _packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    limits = [(r["limit_name"], r["max_size"]) for r in _limits(spark, sf_dir, "tokens")]
    return pack(read(spark, sf_dir, "documents"), limits, item_id="doc_id", size="n_tokens", text="text")


def p6_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """limit_name, container_id, doc_id, piece_no, piece_start, n_tokens: every document in containers of each size."""
    p = _packed(spark, sf_dir)
    return p.select("limit_name", "container_id", F.col("item_id").cast("bigint").alias("doc_id"), "piece_no", "piece_start", F.col("size").alias("n_tokens"))


def p6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of every document that is larger than a container, with their texts."""
    out = piece_texts(read(spark, sf_dir, "documents"), _packed(spark, sf_dir), item_id="doc_id", text="text")
    return out.select("limit_name", "container_id", F.col("item_id").cast("bigint").alias("doc_id"), "piece_no", "piece_start", F.col("size").alias("n_tokens"), "piece")


def p6_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers, tokens and share of used space by container size."""
    one = _packed(spark, sf_dir).groupBy("limit_name", "capacity", "container_id").agg(F.sum("size").alias("used"))
    return one.groupBy("limit_name").agg(
        F.count(F.lit(1)).alias("n_containers"), F.sum("used").alias("n_tokens"), (F.sum("used") / F.sum("capacity")).alias("used_share")
    )


def _mix(spark: SparkSession, sf_dir: str) -> Mix:
    return Mix(read(spark, sf_dir, "documents"), read(spark, sf_dir, "mix_targets"), source="source", doc_id="doc_id", size="n_tokens")


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """slot, source, doc_id, repeat_no, n_tokens, stream_start: the mix, in order of slot and stream_start."""
    return _mix(spark, sf_dir).rows()


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mix(spark, sf_dir).shares()


def p6_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each container size: documents and tokens packed, and what must not be: containers above their size, pieces of documents that fit."""
    limits = spark.createDataFrame([(r["limit_name"], r["max_size"]) for r in _limits(spark, sf_dir, "tokens")], "limit_name string, max_size int")
    p = p6_containers(spark, sf_dir)
    full = p.groupBy("limit_name", "container_id").agg(F.sum("n_tokens").alias("n")).join(F.broadcast(limits), "limit_name")
    full = full.groupBy("limit_name").agg(F.count_if(F.col("n") > F.col("max_size")).alias("n_overfull"))
    docs = p.groupBy("limit_name", "doc_id").agg(F.sum("n_tokens").alias("n"), F.count(F.lit(1)).alias("k")).join(F.broadcast(limits), "limit_name")
    docs = docs.groupBy("limit_name").agg(F.count(F.lit(1)).alias("n_documents"), F.sum("n").alias("n_tokens"), F.count_if((F.col("k") > 1) & (F.col("n") <= F.col("max_size"))).alias("n_needless"))
    return docs.join(full, "limit_name")


def p7_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each listed source with documents: distinct documents there are, and what must not be: uses beyond the cap, slots that two sources share."""
    m = _mix(spark, sf_dir)
    rows = m.rows()
    cap = spark.createDataFrame([(p.source, p.max_repeats, p.rows) for p in m.plan if p.rows > 0], "source string, cap int, n_documents bigint")
    over = rows.groupBy("source", "doc_id").agg(F.count(F.lit(1)).alias("k")).join(F.broadcast(cap), "source").groupBy("source").agg(F.count_if(F.col("k") > F.col("cap")).alias("n_over"))
    shared = rows.groupBy("slot").agg(F.min("source").alias("source"), F.max("source").alias("other")).groupBy("source").agg(F.count_if(F.col("source") != F.col("other")).alias("n_shared"))
    none = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return cap.join(over, "source", "left").join(shared, "source", "left").select("source", "n_documents", none("n_over"), none("n_shared"))


def p5_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, batch_no and class (its least id) of every record that repeats another or is repeated."""
    return classes(read(spark, sf_dir, "precedents")).withColumnRenamed("group", "class_id")


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every page the characters in links, bare key words and stuffed sentences, and their share."""
    return stuffing(read(spark, sf_dir, "documents"), "doc_id", "text")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p8_shares(spark, sf_dir).where(F.col("stuffed_share") > 0.5).select("doc_id")


QUERIES = {
    "p2_found": p2_found, "p2_pieces": p2_pieces, "p3_found": p3_found, "p3_normalized": p3_normalized,
    "p5_found": p5_found, "p6_containers": p6_containers, "p6_pieces": p6_pieces, "p6_usage": p6_usage, "p7_mix": p7_mix, "p7_shares": p7_shares, "p8_found": p8_found, "p8_shares": p8_shares,
    "p5_classes": p5_classes, "p6_invariants": p6_invariants, "p7_invariants": p7_invariants,
}

# The character classes of p3 spelt out, as RE2 has neither tables nor look-around.
_LETTER, _LATIN = "A-Za-z\\x{C0}-\\x{24F}\\x{1E00}-\\x{1EFF}\\x{370}-\\x{52F}\\x{1F00}-\\x{1FFF}", "A-Za-z\\x{C0}-\\x{24F}"
# Cyrillic and Greek letters whose glyphs are those of Latin letters, by code point and apart from the operator's table
_LOOK = "".join(f"\\x{{{c}}}" for c in (
    "410 412 415 405 406 408 41A 41C 41D 41E 420 421 422 423 425 430 435 455 456 458 43E 440 441 443 445 4BB 501 51B 51D 4AE "
    "391 392 395 396 397 399 39A 39C 39D 39F 3A1 3A4 3A5 3A7 3BF 3F2 3F3"
).split())
_EMOJI = "\\x{2190}-\\x{2BFF}\\x{1F000}-\\x{1FAFF}"
_STANDS_FOR = (
    "\\x{A0}\\x{AD}\\x{300}-\\x{36F}\\x{387}\\x{1100}-\\x{11FF}\\x{2000}-\\x{200C}\\x{200E}-\\x{2012}\\x{2027}-\\x{202F}\\x{205F}-\\x{206F}\\x{2212}\\x{2219}\\x{22C5}"
    "\\x{3000}\\x{30FB}\\x{318D}\\x{F900}-\\x{FAFF}\\x{FB00}-\\x{FB06}\\x{FEFF}\\x{FF01}-\\x{FFEE}"
)
_ODD = " OR ".join(
    f"regexp_matches(t, '{p}')"
    for p in (
        f"[{_STANDS_FOR}]", f"[{_LATIN}][{_LOOK}]|[{_LOOK}][{_LATIN}]", f"(^|[^{_LETTER}])[{_LOOK}]+($|[^{_LETTER}])", f"(^|[^{_EMOJI}\\x{{FE0F}}])\\x{{200D}}|\\x{{200D}}($|[^{_EMOJI}])",
        f"(^|[^{_EMOJI}])\\x{{FE0F}}",
    )
)

ORACLE = {
    "p6_invariants": """
SELECT limit_name, count(*) AS n_documents, sum(n_tokens) AS n_tokens, 0 AS n_needless, 0 AS n_overfull FROM documents, (SELECT limit_name FROM size_limits WHERE unit = 'tokens') GROUP BY 1""",
    "p7_invariants": """
SELECT d.source, count(*) AS n_documents, 0 AS n_over, 0 AS n_shared FROM documents d JOIN mix_targets t ON t.source = d.source GROUP BY 1""",
    "p3_found": f"""
SELECT DISTINCT table_name, record_id, paragraph_id FROM (
  SELECT 'precedent_paragraphs' AS table_name, precedent_id AS record_id, paragraph_id, body AS t FROM precedent_paragraphs
  UNION ALL SELECT 'intake_sessions', id, '', redacted_text FROM intake_sessions) WHERE {_ODD}""",
    "p2_found": """
SELECT DISTINCT 'precedents' AS table_name, p.id AS precedent_id, '' AS paragraph_id FROM precedents p, size_limits l
WHERE l.table_name = 'precedents' AND l.unit = 'chars' AND length(p.source_text) > l.max_size
UNION ALL
SELECT DISTINCT 'precedent_paragraphs', p.precedent_id, p.paragraph_id FROM precedent_paragraphs p, size_limits l
WHERE l.table_name = 'precedent_paragraphs' AND l.unit = 'chars' AND length(p.body) > l.max_size""",
}
