"""Retrieval (F1-F6, F12, J1, J2, J10, R4-R6, R10-R20, R23, T1-T6): gates, candidates, scores, fusion, threshold.

The corpus is scanned once, gates first and texts last; ranks are counts of hits inside each document, so no token table
is shuffled. Candidates are cut before they are scored again: the two phases are part of the meaning.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.rules import compare_facts, facts, focus, focus_penalty, is_known, is_target_case, let, with_defaults
from ..functions.text import clamp, half_up, normalize_query, query_terms, tokens
from ..session import durable
from .embedding import cosine, is_vector

# Fixed values.
THRESHOLD, LEXICAL_CAP, LEXICAL_LIMIT, VECTOR_LIMIT = 55, 0.5, 50, 20
HIT_RANK = 0.1
SUMMARY_VERSION = "grounded-v2"


def clamp_limit(n: Any, most: int = 5, default: int = 5) -> int:
    """T6. 1 to ``most``; 0, nothing and no number give the default."""
    try:
        n = int(n)
    except (TypeError, ValueError):
        return default
    return default if n == 0 else max(1, min(most, n))


def clamp_limit_column(n: Column, most: int = 5, default: int = 5) -> Column:
    """T6 over a column."""
    return F.when(F.coalesce(n, F.lit(0)) == 0, default).otherwise(F.greatest(F.lit(1), F.least(F.lit(most), n)))


def hit_count(text: Column, terms: list[str]) -> Column:
    """R4. Positions of the text's words that equal a term (any case); a word is a whole run of letters and digits.

    Counted by one pattern over the text: no array of words is made.
    """
    edge = r"[\p{L}\p{N}]"
    wanted = "|".join(rf"\Q{t.lower()}\E" for t in terms)
    return F.regexp_count(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"(?<!{edge})(?:{wanted})(?!{edge})"))


def lexical_score(rank: Column) -> Column:
    """R5. Of a fixed cap, so it doesn't depend on the other candidates."""
    return half_up(clamp(F.coalesce(rank, F.lit(0.0)) / F.lit(LEXICAL_CAP), 0.0, 1.0) * 100)


def fresh(as_of: Column, hours: int = 24) -> Column:
    """F2. Verified, link checked in time and answering, vector there."""
    checked = F.col("link_checked_at") >= as_of - F.make_dt_interval(hours=F.lit(hours))
    return F.coalesce(F.col("verified_at").isNotNull() & checked & F.col("link_status").between(200, 399) & F.col("embedding").isNotNull(), F.lit(False))


def tag_overlap(row: Column, query: Column, hits: Column) -> Column:
    """F3, F4. A word hit, an equal known tag, or issue tags in common; arms of unknown values are never true."""
    arms = [hits > 0] + [is_known(query[f]) & (row[f] == query[f]) for f in ("medium", "recipientIdentification", "relationship", "context", "expressionType", "repetition")]
    empty = F.array().cast("array<string>")
    arms.append(F.arrays_overlap(F.coalesce(row["issueTags"], empty), F.coalesce(query["issueTags"], empty)))
    return reduce(lambda a, b: a | b, [F.coalesce(a, F.lit(False)) for a in arms])


def in_scope(query_facts: dict) -> bool:
    """F6. Whether a described case can match anything: an expression, or the tag of one."""
    return query_facts.get("expressionType", "other") != "other" or "성적표현" in (query_facts.get("issueTags") or [])


def fused(first: Column, comparison: Column) -> Column:
    """R10, R11."""
    return F.lit(0.45) * first + F.lit(0.45) * comparison["factScore"] + F.lit(0.10) * comparison["issueScore"]


def retrieval_score(base: Column, penalty: Column) -> Column:
    """R13."""
    return F.greatest(F.lit(0).cast("bigint"), half_up(base - penalty))


def rank_tagged(candidates: DataFrame, limit: int = 5, threshold: int = THRESHOLD) -> DataFrame:
    """T3, R10, R14. ``candidates``: id, decision_date, rank, comparison, focus; a batch has query_id."""
    d = candidates.withColumn("lexical_score", lexical_score(F.col("rank"))).withColumn("_base", fused(F.col("lexical_score"), F.col("comparison")))
    d = d.withColumn("score", retrieval_score(F.col("_base"), focus_penalty(F.col("focus")))).withColumn("tag_score", F.col("comparison.factScore"))
    return _cut(d, [F.desc("score"), F.desc("tag_score"), F.desc_nulls_last("decision_date"), F.asc("id")], limit, threshold)


def rank_hybrid(candidates: DataFrame, limit: int = 5, threshold: int = THRESHOLD) -> DataFrame:
    """T4, R11, R14. ``candidates``: id, decision_date, similarity, comparison, focus; a batch has query_id."""
    s = clamp(F.coalesce(F.col("similarity"), F.lit(0.0)), 0.0, 1.0) * 100
    d = candidates.withColumn("semantic_score", half_up(s)).withColumn("_base", fused(s, F.col("comparison")))
    d = d.withColumn("score", retrieval_score(F.col("_base"), focus_penalty(F.col("focus"))))
    return _cut(d, [F.desc("score"), F.desc_nulls_last("decision_date"), F.asc("id")], limit, threshold)


def _cut(d: DataFrame, order: list[Column], limit: int, threshold: int) -> DataFrame:
    d = d.where(F.col("score") >= threshold).drop("_base")
    if "query_id" in d.columns:
        n = F.row_number().over(Window.partitionBy("query_id").orderBy(*order))
        return d.withColumn("_n", n).where(F.col("_n") <= limit).drop("_n")
    return d.orderBy(*order).limit(limit)


def stored_summary(case_name: Column, version: Column, sentences: Column, normalize: bool = True) -> Column:
    """R17. Shown only of focused cases, in the current version, with one to three well-formed sentences; else null."""
    good = F.forall(sentences, lambda s: (F.trim(s["text"]) != "") & (F.size(s["paragraph_ids"]) > 0) & F.forall(s["paragraph_ids"], lambda p: F.coalesce(p != "", F.lit(False))))
    shown = F.transform(
        sentences,
        lambda s: F.struct(F.trim(s["text"]).alias("text"), F.array_join(F.transform(s["paragraph_ids"], lambda p: F.concat(F.lit("판결문 문단 "), p)), ", ").alias("sourceAnchor")),
    )
    ok = is_target_case(F.regexp_replace(case_name, r"(?U)\s+", ""), normalize) & (focus(case_name, normalize) == "focused") & (version == SUMMARY_VERSION)
    return F.when(ok & F.size(sentences).between(1, 3) & F.coalesce(good, F.lit(False)), shown)


def stored_order(text: Column, kind: Column) -> Column:
    """R18."""
    from ..schema import ORDER_KINDS

    return F.when((F.trim(text) != "") & kind.isin(ORDER_KINDS), F.struct(F.trim(text).alias("orderText"), kind.alias("kind")))


def identified(df: DataFrame, hosts: list[str]) -> DataFrame:
    """F12, R23. Results with a whole identity and an official address."""
    from .verify import is_official

    whole = reduce(lambda a, b: a & b, [F.coalesce(F.trim(F.col(c).cast("string")) != "", F.lit(False)) for c in ("id", "court", "case_number", "case_name", "decision_date")])
    return df.where(whole & is_official(F.col("official_url"), hosts))


def client_results(df: DataFrame, hosts: list[str]) -> DataFrame:
    """R23. Results as a client shows them: those with a whole identity and an official address, each score between 0 and
    100 (0 for none), focused unless said otherwise. Reads semantic_score, fact_score, issue_score, score and focus."""

    def safe(c: str) -> Column:
        return half_up(clamp(F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)), 0.0, 100.0))

    names = {"semantic": "semantic_score", "facts": "fact_score", "issues": "issue_score", "total": "score"}
    d = identified(df, hosts).withColumn("focus", F.when(F.col("focus").isin("mixed", "peripheral"), F.col("focus")).otherwise("focused"))
    return d.withColumn("similarity", F.struct(*[safe(c).alias(n) for n, c in names.items()]))


@dataclass
class SearchResult:
    """R20. Rows, the mode in which they were found, why another one wasn't used, and what was compared."""

    rows: DataFrame
    mode: str
    available: DataFrame | None = None
    fallback_code: str | None = None
    query_facts: dict = field(default_factory=dict)


class Corpus:
    """Searchable records: id, court, case_number, case_name, decision_date, source_text, searchable, facts (STRUCT),
    and for the hybrid path verified_at, link_checked_at, link_status, embedding."""

    def __init__(self, records: DataFrame, normalize: bool = True, hours: int = 24):
        self.records, self.spark, self.normalize, self.hours = records, records.sparkSession, normalize, hours

    def gated(self) -> DataFrame:
        """F1."""
        return self.records.where(F.col("searchable") & is_target_case(F.col("case_name"), self.normalize))

    def lexical_candidates(self, terms: list[str], query_facts: Column, limit: int = LEXICAL_LIMIT) -> DataFrame:
        """T1."""
        words = F.concat_ws(" ", "court", "case_number", "case_name", "source_text")
        d = self.gated().withColumn("hits", hit_count(words, terms)).withColumn("rank", F.col("hits") * F.lit(HIT_RANK)).withColumn("_f", with_defaults(F.col("facts")))
        d = d.where(tag_overlap(F.col("_f"), query_facts, F.col("hits"))).drop("source_text")
        return d.orderBy(F.desc("rank"), F.desc_nulls_last("decision_date"), F.asc("id")).limit(limit)

    def vector_candidates(self, vector: list[float], as_of: Column, limit: int = VECTOR_LIMIT) -> DataFrame:
        """T2, R6. Exact, not an approximate index; similarities that differ beyond the sixth place are ties."""
        v = F.array(*[F.lit(float(x)) for x in vector])
        d = self.gated().where(fresh(as_of, self.hours) & is_vector(F.col("embedding"), len(vector))).withColumn("similarity", F.round(cosine(F.col("embedding"), v), 6))
        # facts are made of the rows that are left only
        d = d.drop("embedding").orderBy(F.desc("similarity"), F.desc_nulls_last("decision_date"), F.asc("id")).limit(limit)
        return d.withColumn("_f", with_defaults(F.col("facts"))).drop("source_text")

    def search(self, query: str, as_of: Column | None = None, embedder=None, limit: int = 5) -> SearchResult:
        """R15. Out of scope, lexical, hybrid, or lexical again where the vectors fail."""
        one = self.spark.createDataFrame([(query,)], "q string").select(normalize_query(F.col("q")).alias("q"))
        row = one.select(query_terms(F.col("q")).alias("terms"), "q", facts(F.col("q")).alias("f")).first()  # the one query
        if not row["terms"]:
            raise ValueError("SEARCH_QUERY_REQUIRED")
        qf, limit = row["f"].asDict(), clamp_limit(limit)
        shown = {k: v for k, v in qf.items() if k != "normalizedText"}
        literal = F.struct(*[(F.array(*[F.lit(x) for x in v]).cast("array<string>") if isinstance(v, list) else F.lit(v)).alias(k) for k, v in qf.items()])
        if not in_scope(qf):
            return SearchResult(self.records.limit(0), "query_out_of_scope", query_facts=shown)
        scored = lambda d: d.withColumn("comparison", compare_facts(literal, F.col("_f"))).withColumn("focus", focus(F.col("case_name"), self.normalize)).drop("_f")
        lexical = lambda: rank_tagged(scored(self.lexical_candidates(row["terms"], literal)), limit)
        available = self.gated().agg(F.count(F.lit(1)).alias("available_count"))
        if embedder is None or as_of is None:
            return SearchResult(lexical(), "provisional_without_embeddings", available, query_facts=shown)
        try:
            (vector,) = embedder.embed([row["q"]])
        except Exception as e:  # noqa: BLE001
            return SearchResult(lexical(), "fallback_without_embeddings", available, getattr(e, "code", "EMBEDDING_FAILED"), shown)
        near = durable(self.vector_candidates(vector, as_of))  # at most VECTOR_LIMIT rows, ranked once
        if near.isEmpty():
            return SearchResult(lexical(), "fallback_without_embeddings", available, "NO_EMBEDDED_CANDIDATES", shown)
        current = self.gated().where(fresh(as_of, self.hours)).agg(F.count(F.lit(1)).alias("available_count"))
        return SearchResult(rank_hybrid(scored(near), limit), "hybrid_embeddings", current, query_facts=shown)


def search_batch(corpus: DataFrame, queries: DataFrame, limit: int = 5, max_queries: int = 10_000, normalize: bool = True) -> DataFrame:
    """J10, T3. Many described cases (query_id, text) against the corpus in one plan.

    The queries are the small side, checked against ``max_queries``; they are met with every gated record, in blocks
    of the corpus, and hits are counted by a lookup of the record's asked words in the query's terms.
    """
    q = queries.select("query_id", query_terms(normalize_query(F.col("text"))).alias("terms"), facts(F.col("text"), normalize=normalize).alias("qf"))
    if q.limit(max_queries + 1).count() > max_queries:
        raise ValueError("more queries than max_queries: search them in parts")
    q = q.where((F.col("qf.expressionType") != "other") | F.array_contains("qf.issueTags", "성적표현")).withColumn("terms", F.transform("terms", F.lower))
    # of each record only the words that any query asks for go on, spread over all tasks, to the pairs
    asked = q.agg(F.array_distinct(F.flatten(F.collect_list("terms"))).alias("asked"))  # one row, bounded by max_queries
    words = tokens(F.concat_ws(" ", "court", "case_number", "case_name", "source_text"))
    kept = let(words, lambda ws: let(F.array_intersect(ws, F.col("asked")), lambda some: F.filter(ws, lambda w: F.array_contains(some, w))))
    d = corpus.where(F.col("searchable") & is_target_case(F.col("case_name"), normalize)).crossJoin(F.broadcast(asked))
    d = d.select("id", "case_name", "decision_date", kept.alias("words"), with_defaults(F.col("facts")).alias("_f")).repartition("id")
    d = d.crossJoin(F.broadcast(q)).withColumn("hits", F.size(F.filter("words", lambda w: F.array_contains(F.col("terms"), w)))).drop("words")
    d = d.where(tag_overlap(F.col("_f"), F.col("qf"), F.col("hits"))).withColumn("rank", F.col("hits") * F.lit(HIT_RANK))
    n = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("rank"), F.desc_nulls_last("decision_date"), F.asc("id")))
    d = d.withColumn("_n", n).where(F.col("_n") <= LEXICAL_LIMIT).drop("_n")
    d = d.withColumn("comparison", compare_facts(F.col("qf"), F.col("_f"))).withColumn("focus", focus(F.col("case_name"), normalize))
    return rank_tagged(d.drop("_f", "qf", "terms"), limit)
