"""Ordered-sequence operators over paragraph tables (W1-W4, X12): windows per document, never a collected corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.rules import SCALARS, facts, is_enumeration, is_known, is_relevant, order_kind
from ..functions.text import nfkc, paragraph_id, split_paragraphs, squeeze

ORDER_VERSION = "order-v1"
MAX_ORDER = 1200


def paragraphs_of(df: DataFrame, doc: str, text: str) -> DataFrame:
    """W1, S2. (doc, ordinal, paragraph_id, body) of each text."""
    p = df.select(F.col(doc), F.posexplode(split_paragraphs(F.col(text))).alias("pos", "body"))
    return p.select(doc, (F.col("pos") + 1).alias("ordinal"), paragraph_id(F.col("pos") + 1).alias("paragraph_id"), "body")


def select_relevant(df: DataFrame, doc: str, *, least: int = 3, budget: int = 40_000, normalize: bool = True) -> DataFrame:
    """W2, W3. Paragraphs next to a relevant one, in order, until ``budget`` characters; the crossing one is cut.

    ``df`` has doc, ordinal, paragraph_id, body. Rows without id or text don't count. A document with fewer than
    ``least`` paragraphs before or after the budget gives none. Ties in ordinal go by paragraph_id.
    """
    order = [F.col("ordinal"), F.col("paragraph_id")]
    by_doc = Window.partitionBy(doc)
    near = by_doc.orderBy(*order).rowsBetween(-1, 1)
    before = by_doc.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    d = df.withColumn("body", F.regexp_replace("body", r"^[\s\x{00A0}\x{3000}]+|[\s\x{00A0}\x{3000}]+$", ""))
    d = d.where((F.col("paragraph_id") != "") & (F.col("body") != "")).withColumn("_hit", is_relevant(F.col("body"), normalize).cast("int"))
    d = d.withColumn("_near", F.max("_hit").over(near)).where("_near = 1").withColumn("_n", F.count(F.lit(1)).over(by_doc)).where(F.col("_n") >= least)
    d = d.withColumn("_prior", F.coalesce(F.sum(F.length("body")).over(before), F.lit(0))).where(F.col("_prior") < budget)
    d = d.withColumn("body", F.expr(f"substring(body, 1, cast({budget} - _prior as int))")).withColumn("_n", F.count(F.lit(1)).over(by_doc))
    return d.where(F.col("_n") >= least).drop("_hit", "_near", "_n", "_prior")


def extract_orders(df: DataFrame, doc: str, *, normalize: bool = True) -> DataFrame:
    """W4, X13. The section of the first order heading of each document: order_text, paragraph_ids, kind, version.

    Text on the heading's own line counts. No heading, an empty section or more than MAX_ORDER characters give no row.
    """
    by_doc = Window.partitionBy(doc)
    text = F.coalesce(F.col("body"), F.lit(""))
    d = df.withColumn("_t", squeeze(nfkc(text) if normalize else text)).where((F.col("paragraph_id") != "") & (F.col("_t") != ""))
    pos = F.row_number().over(by_doc.orderBy("ordinal", "paragraph_id"))
    d = d.withColumn("_pos", pos).withColumn("_order", F.col("_t").rlike(r"^【\s*주\s*문\s*】")).withColumn("_head", F.col("_t").rlike("^【[^】]*】"))
    d = d.withColumn("_start", F.min(F.when(F.col("_order"), F.col("_pos"))).over(by_doc)).where(F.col("_pos") >= F.col("_start"))
    d = d.withColumn("_end", F.min(F.when(F.col("_head") & (F.col("_pos") > F.col("_start")), F.col("_pos"))).over(by_doc))
    d = d.where(F.col("_end").isNull() | (F.col("_pos") < F.col("_end")))
    part = F.when(F.col("_pos") == F.col("_start"), F.trim(F.regexp_replace("_t", r"^【\s*주\s*문\s*】", ""))).otherwise(F.col("_t"))
    d = d.withColumn("_part", part).where("_part <> ''")
    parts = d.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct("_pos", "paragraph_id", "_part"))).alias("p"))  # one document's order section
    out = parts.select(doc, F.array_join(F.col("p._part"), " ").alias("order_text"), F.col("p.paragraph_id").alias("paragraph_ids"))
    return out.where(F.length("order_text") <= MAX_ORDER).select(
        doc, "order_text", "paragraph_ids", order_kind(F.col("order_text"), normalize).alias("kind"), F.lit(ORDER_VERSION).alias("extraction_version")
    )


def document_facts(df: DataFrame, doc: str, *, normalize: bool = True) -> DataFrame:
    """X12. Facts of each document's relevant paragraphs but the statute's own lists, with their evidence.

    Documents without relevant paragraphs get the default values and no evidence.
    """
    picked = select_relevant(df, doc, normalize=normalize).where(~is_enumeration(F.col("body"), normalize))
    text = picked.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct("ordinal", "paragraph_id", "body"))).alias("p"))  # bounded by the budget
    every = df.select(doc).distinct().join(text, doc, "left")
    ids = F.coalesce(F.col("p.paragraph_id"), F.array().cast("array<string>"))
    out = every.withColumn("facts", facts(F.array_join(F.coalesce(F.col("p.body"), F.array().cast("array<string>")), "\n"), normalize=normalize))
    known = F.array_compact(F.array(*[F.when(is_known(F.col("facts")[f]), F.lit(f)) for f in SCALARS]))
    evidence = F.struct(F.lit("deterministic_rules").alias("method"), known.alias("knownFields"), ids.alias("paragraphIds"))
    return out.select(doc, "facts", evidence.alias("evidence"))
