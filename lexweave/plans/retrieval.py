"""Queries of the retrieval, text and tagging operators, and their SQL.

The SQL engine has no NFKC, so these queries take texts as they are (``normalize=False``); NFKC is covered by tests.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import rules as R
from ..functions import text as X
from ..operators import embedding, quality, search, sections
from ..session import read
from .oracle_parts import SPACE, any_of, compare_sql, facts_sql, focus_sql, paragraphs_sql, penalty_sql, quoted
from .stored import stored_tags, with_stored_facts

TERMS = ["피해자", "피고인", "게임", "카카오톡", "메시지", "url", "sns"]
AS_OF = "2026-02-01 00:00:00"
HOURS = 24 * 800
# The facts of one described case, as ``facts`` gives them.
CASE = {
    "medium": "game_chat", "messageForm": "text", "recipientIdentification": "direct_account", "reachedRecipient": "yes", "relationship": "game_user", "context": "conflict",
    "expressionType": "insult_with_sexual_terms", "repetition": "repeated", "issueTags": ["통신매체", "도달", "성적표현", "분노", "반복성"],
}


def _case():
    return F.struct(*[(F.array(*[F.lit(x) for x in v]) if isinstance(v, list) else F.lit(v)).alias(k) for k, v in CASE.items()])


def _flat(f, *cols: str) -> list:
    names = {"medium": "medium", "form": "messageForm", "recipient": "recipientIdentification", "reached": "reachedRecipient", "relationship": "relationship", "context": "context", "expression": "expressionType", "repetition": "repetition"}
    return [F.col(f"{f}.{v}").alias(k) for k, v in names.items() if not cols or k in cols]


def _precedents(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "precedents")


def _paragraphs(spark: SparkSession, sf: str) -> DataFrame:
    """Re-delivered paragraphs once."""
    return read(spark, sf, "precedent_paragraphs").select("precedent_id", "paragraph_id", "ordinal", "body").distinct()


def lexical_rank_topk(spark: SparkSession, sf: str) -> DataFrame:
    words = F.concat_ws(" ", "court", "case_number", "case_name", "source_text")
    d = _precedents(spark, sf).select("id", "decision_date", search.hit_count(words, TERMS).cast("bigint").alias("hits"))
    d = d.where("hits > 0").orderBy(F.desc("hits"), F.desc_nulls_last("decision_date"), F.asc("id")).limit(search.LEXICAL_LIMIT)
    return d.select("id", "hits", search.lexical_score(F.col("hits") * F.lit(search.HIT_RANK)).alias("score"))


def semantic_topk(spark: SparkSession, sf: str) -> DataFrame:
    e = read(spark, sf, "embeddings")
    v = e.where("vec_id = 0").first()["embedding"]
    d = e.where(embedding.is_vector(F.col("embedding"), len(v))).withColumn("s", embedding.cosine(F.col("embedding"), F.array(*[F.lit(x) for x in v])))
    return d.orderBy(F.desc("s"), F.asc("vec_id")).limit(search.VECTOR_LIMIT).select("vec_id", F.round("s", 5).alias("similarity"))


def vector_validity(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "embeddings").select("label", embedding.is_vector(F.col("embedding"), 64).alias("ok")).groupBy("label", "ok").agg(F.count(F.lit(1)).alias("n"))


def fact_tags(spark: SparkSession, sf: str) -> DataFrame:
    d = stored_tags(spark, sf).select("id", F.col("facts").alias("f"))
    return d.select("id", *_flat("f"), F.array_join("f.additionalChannels", ",").alias("more"), F.array_join("f.issueTags", ",").alias("tags"))


def session_fact_tags(spark: SparkSession, sf: str) -> DataFrame:
    d = read(spark, sf, "intake_sessions").select("id", R.facts(F.col("redacted_text"), normalize=False).alias("f"))
    return d.groupBy(*_flat("f", "medium", "expression", "repetition")).agg(F.count(F.lit(1)).alias("n"))


def issue_jaccard(spark: SparkSession, sf: str) -> DataFrame:
    d = stored_tags(spark, sf).select("id", R.compare_facts(_case(), F.col("facts")).alias("c"))
    return d.select("id", F.col("c.factScore").alias("fact_score"), F.col("c.issueScore").alias("issue_score"))


def tagged_rank(spark: SparkSession, sf: str) -> DataFrame:
    c = search.Corpus(with_stored_facts(_precedents(spark, sf), spark, sf), normalize=False)
    d = c.lexical_candidates(TERMS, _case()).withColumn("comparison", R.compare_facts(_case(), F.col("_f"))).withColumn("focus", R.focus(F.col("case_name"), False))
    return search.rank_tagged(d, 50, 30).select("id", "score", "tag_score", "lexical_score", "focus")


def hybrid_rank(spark: SparkSession, sf: str) -> DataFrame:
    e = read(spark, sf, "embeddings")
    v = e.where("vec_id = 7").first()["embedding"]
    p = with_stored_facts(_precedents(spark, sf), spark, sf).withColumn("vec_id", F.conv(F.substring("id", 1, 7), 16, 10).cast("bigint") % 500)
    c = search.Corpus(p.join(e.select("vec_id", "embedding"), "vec_id"), normalize=False, hours=HOURS)
    d = c.vector_candidates(v, F.lit(AS_OF).cast("timestamp_ntz"))
    d = d.withColumn("comparison", R.compare_facts(_case(), F.col("_f"))).withColumn("focus", R.focus(F.col("case_name"), False))
    return search.rank_hybrid(d, 20, 20).select("id", "score", "semantic_score")


def _vector_queries(e: DataFrame) -> DataFrame:
    """Vectors whose id is divisible by 100: a hundredth of the table, the side that is broadcast."""
    return F.broadcast(e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("asked")))


def _first(d: DataFrame, order: list) -> DataFrame:
    """VECTOR_LIMIT rows of each query."""
    n = F.row_number().over(Window.partitionBy("query_id").orderBy(*order))
    return d.withColumn("_n", n).where(F.col("_n") <= search.VECTOR_LIMIT).drop("_n")


def semantic_topk_batch(spark: SparkSession, sf: str) -> DataFrame:
    """All vectors whose id is divisible by 100, each against all rows."""
    e = read(spark, sf, "embeddings")
    d = e.crossJoin(_vector_queries(e)).where(F.size("embedding") == F.size("asked")).withColumn("s", embedding.cosine(F.col("embedding"), F.col("asked")))
    d = d.select("query_id", "vec_id", "s").where(F.col("s").isNotNull() & ~F.isnan("s"))
    return _first(d, [F.desc("s"), F.asc("vec_id")]).select("query_id", "vec_id", F.round("s", 5).alias("similarity"))


def hybrid_rank_batch(spark: SparkSession, sf: str) -> DataFrame:
    """The described case with all vectors whose id is divisible by 100; records take any vector of the table."""
    e = read(spark, sf, "embeddings")
    n = e.count()
    p = with_stored_facts(_precedents(spark, sf), spark, sf).withColumn("vec_id", F.conv(F.substring("id", 1, 7), 16, 10).cast("bigint") % F.lit(n))
    c = search.Corpus(p.join(e.select("vec_id", "embedding"), "vec_id"), normalize=False).gated().where(search.fresh(F.lit(AS_OF).cast("timestamp_ntz"), HOURS))
    c = c.withColumn("comparison", R.compare_facts(_case(), R.with_defaults(F.col("facts")))).withColumn("focus", R.focus(F.col("case_name"), False))
    c = c.select("id", "decision_date", "embedding", "comparison", "focus").crossJoin(_vector_queries(e)).where(F.size("embedding") == F.size("asked"))
    d = c.withColumn("similarity", embedding.cosine(F.col("embedding"), F.col("asked"))).drop("embedding", "asked").withColumn("s6", F.round("similarity", 6))
    d = _first(d, [F.desc("s6"), F.desc_nulls_last("decision_date"), F.asc("id")])
    return search.rank_hybrid(d, 20, 20).select("query_id", "id", "score", "semantic_score")


def batch_search(spark: SparkSession, sf: str) -> DataFrame:
    """Sessions whose id (its first digits as a number) is divisible by 100, against all records."""
    q = read(spark, sf, "intake_sessions").where(F.conv(F.substring("id", 1, 7), 16, 10).cast("bigint") % 100 == 0).select(F.col("id").alias("query_id"), F.col("redacted_text").alias("text")).distinct()
    c = with_stored_facts(_precedents(spark, sf), spark, sf)
    return search.search_batch(c, q, normalize=False).select("query_id", "id", "score", "tag_score")


def paragraph_split(spark: SparkSession, sf: str) -> DataFrame:
    p = sections.paragraphs_of(_precedents(spark, sf), "id", "source_text")
    return p.select("id", F.col("ordinal").cast("bigint").alias("ordinal"), "paragraph_id", X.sha256(F.col("body")).alias("body_hash"))


def html_strip_hash(spark: SparkSession, sf: str) -> DataFrame:
    return _precedents(spark, sf).select("id", X.sha256(X.clean_text(F.col("source_text"))).alias("clean_hash"))


def redact_pii(spark: SparkSession, sf: str) -> DataFrame:
    d = read(spark, sf, "documents").select("doc_id", X.redact(F.col("text")).alias("r"))
    return d.select("doc_id", X.sha256(F.col("r.text")).alias("redacted_hash"), F.col("r.redaction_count").cast("bigint").alias("redaction_count"))


def relevant_paragraphs(spark: SparkSession, sf: str) -> DataFrame:
    d = sections.select_relevant(_paragraphs(spark, sf), "precedent_id", least=2, budget=600, normalize=False)
    return d.select("precedent_id", "paragraph_id", F.length("body").cast("bigint").alias("n"))


def relevant_paragraphs_whole(spark: SparkSession, sf: str) -> DataFrame:
    """With the operator's own bounds; ``relevant_paragraphs`` is bound by its SQL to two paragraphs and 600 characters."""
    d = sections.select_relevant(_paragraphs(spark, sf), "precedent_id", normalize=False)
    return d.select("precedent_id", "paragraph_id", F.length("body").cast("bigint").alias("n"))


def order_sections(spark: SparkSession, sf: str) -> DataFrame:
    d = sections.extract_orders(_paragraphs(spark, sf), "precedent_id", normalize=False)
    return d.select("precedent_id", "order_text", F.array_join("paragraph_ids", ",").alias("ids"), "kind")


def document_facts(spark: SparkSession, sf: str) -> DataFrame:
    d = sections.document_facts(_paragraphs(spark, sf), "precedent_id", normalize=False)
    return d.select("precedent_id", *_flat("facts"), F.array_join("facts.issueTags", ",").alias("tags"), F.size("evidence.paragraphIds").cast("bigint").alias("n_paragraphs"))


def enumerations(spark: SparkSession, sf: str) -> DataFrame:
    return _paragraphs(spark, sf).select(R.is_enumeration(F.col("body"), False).alias("is_list"), R.is_relevant(F.col("body"), False).alias("is_relevant")).groupBy("is_list", "is_relevant").agg(F.count(F.lit(1)).alias("n"))


def focus_penalty(spark: SparkSession, sf: str) -> DataFrame:
    f = R.focus(F.col("case_name"), False)
    return _precedents(spark, sf).select("id", f.alias("focus"), R.focus_penalty(f).alias("penalty"), R.is_target_case(F.col("case_name"), False).alias("is_target"))


def order_kinds(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "precedent_dispositions").groupBy(R.order_kind(F.col("order_text"), False).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def embedding_input_hash(spark: SparkSession, sf: str) -> DataFrame:
    body = embedding.without_outcomes(F.col("source_text"), normalize=False)
    return with_stored_facts(_precedents(spark, sf), spark, sf).select("id", X.sha256(embedding.embedding_input(F.col("facts"), body)).alias("input_hash"))


def embedding_backfill(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors of the offline adapter for every session's text; SQL knows their inputs and that they are valid, not their values."""
    out = embedding.backfill(read(spark, sf, "intake_sessions").select("id", "redacted_text").distinct(), "id", "redacted_text", embedding.HashingEmbedder(64))
    return out.select("id", "input_hash", embedding.is_vector(F.col("embedding"), 64).alias("ok"))





def _estimate(spark: SparkSession, sf: str) -> DataFrame:
    return quality.summary_estimate(_paragraphs(spark, sf), "precedent_id", least=2, normalize=False)


def _estimate_whole(spark: SparkSession, sf: str) -> DataFrame:
    """With the operator's own bounds."""
    return quality.summary_estimate(_paragraphs(spark, sf), "precedent_id", normalize=False)


def query_normalization(spark: SparkSession, sf: str) -> DataFrame:
    q = X.normalize_query(F.col("redacted_text"))
    d = read(spark, sf, "intake_sessions").select("id", X.sha256(q).alias("query_hash"), F.array_join(X.query_terms(q), " OR ").alias("expression"))
    return d.distinct()


def snippets(spark: SparkSession, sf: str) -> DataFrame:
    return _precedents(spark, sf).select("id", X.snippet(F.col("source_text")).alias("snippet"))


QUERIES = {f.__name__: f for f in (
    lexical_rank_topk, semantic_topk, vector_validity, fact_tags, session_fact_tags, issue_jaccard, tagged_rank, hybrid_rank, semantic_topk_batch, hybrid_rank_batch, batch_search, paragraph_split, html_strip_hash, redact_pii, relevant_paragraphs, relevant_paragraphs_whole,
    order_sections, document_facts, enumerations, focus_penalty, order_kinds, embedding_input_hash, embedding_backfill, query_normalization, snippets,
)}
QUERIES["summary_estimate"], QUERIES["summary_estimate_whole"] = _estimate, _estimate_whole

_FS, _IS = compare_sql(CASE)
_WORDS = "concat_ws(' ', court, case_number, case_name, source_text)"
_HITS = f"len(list_filter(regexp_extract_all(lower({_WORDS}), '[\\p{{L}}\\p{{N}}]+'), lambda w: w IN ({', '.join(quoted(t) for t in TERMS)})))"
_PAR = "(SELECT DISTINCT precedent_id, paragraph_id, ordinal, body FROM precedent_paragraphs)"
_TRIMMED = r"regexp_replace(body, '^[\s\x{0B}\x{A0}\x{3000}]+|[\s\x{0B}\x{A0}\x{3000}]+$', '', 'g')"
_COMPACT = f"regexp_replace(body, '{SPACE}+', '', 'g')"


def _picked(least: int, budget: int) -> str:
    return f"""
    a AS (SELECT precedent_id, paragraph_id, ordinal, {_TRIMMED} AS body FROM {_PAR}),
    b AS (SELECT *, max({any_of(_COMPACT, R.RELEVANCE)}::INT) OVER (PARTITION BY precedent_id ORDER BY ordinal, paragraph_id ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS near FROM a WHERE paragraph_id <> '' AND body <> ''),
    c AS (SELECT *, count(*) OVER (PARTITION BY precedent_id) AS n, coalesce(sum(length(body)) OVER (PARTITION BY precedent_id ORDER BY ordinal, paragraph_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prior FROM b WHERE near = 1),
    d AS (SELECT precedent_id, paragraph_id, ordinal, substr(body, 1, ({budget} - prior)::BIGINT) AS body, count(*) OVER (PARTITION BY precedent_id) AS m FROM c WHERE n >= {least} AND prior < {budget}),
    picked AS (SELECT precedent_id, paragraph_id, ordinal, body FROM d WHERE m >= {least})"""


_FACT_COLS = "medium, form, recipient, reached, relationship, context, expression, repetition"
_KIND = r"""CASE WHEN contains(t, '원고') THEN 'civil' WHEN regexp_matches(t, '(환송|이송)한다')::INT + (regexp_matches(t, '상고를?\s*(모두\s*)?기각') OR regexp_matches(t, '항소를?\s*(모두\s*)?기각'))::INT
  + regexp_matches(t, '공소를?\s*(모두\s*)?기각')::INT + contains(t, '무죄')::INT + regexp_matches(t, '(징역|금고|벌금|구류|과료|몰수|추징)')::INT > 1 THEN 'multiple'
  WHEN regexp_matches(t, '(환송|이송)한다') THEN 'remand' WHEN regexp_matches(t, '상고를?\s*(모두\s*)?기각') THEN 'final_appeal_dismissed' WHEN regexp_matches(t, '항소를?\s*(모두\s*)?기각') THEN 'appeal_dismissed'
  WHEN contains(t, '무죄') THEN 'acquitted' WHEN regexp_matches(t, '(징역|금고|벌금|구류|과료|몰수|추징)') AND contains(t, '파기') THEN 'reversed_and_sentenced'
  WHEN regexp_matches(t, '(징역|금고|벌금|구류|과료|몰수|추징)') THEN 'sentenced' ELSE 'other' END"""
_CLEAN = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(source_text, '<[^>]+>', ' ', 'g'), '(?i)&nbsp;|&#160;', ' ', 'g'), '\r', chr(10), 'g'), '[\t ]+', ' ', 'g'),
  '\n{3,}', chr(10) || chr(10), 'g'), '^[\s\x{0B}\x{FEFF}\x{A0}]+|[\s\x{0B}\x{FEFF}\x{A0}]+$', '', 'g')"""
_REDACT = [r"\b[0-9]{6}[-\s]?[0-9]{7}\b", r"(?i)https?://[^\s,]+", r"[A-Za-z0-9_.+-]+@[A-Za-z0-9_-]+(?:\.[A-Za-z0-9_-]+)+", r"(?i)@[a-z0-9_.-]{2,}", r"(?:0[0-9]{1,2}[-\s]?)?[0-9]{3,4}[-\s]?[0-9]{4}", r"[가-힣]+(?:로|길)\s*[0-9]+(?:-[0-9]+)?(?:번지)?"]


def _redact_sql() -> str:
    ctes, prev = [], "SELECT doc_id, coalesce(text, '') AS x, 0::BIGINT AS n FROM documents"
    for p in _REDACT:
        prev = f"SELECT doc_id, regexp_replace(x, {quoted(p)}, '[가림]', 'g') AS x, n + len(regexp_extract_all(x, {quoted(p)})) AS n FROM ({prev})"
    del ctes
    return f"SELECT doc_id, sha256(x) AS redacted_hash, n AS redaction_count FROM ({prev})"


_NORMAL = r"substr(regexp_replace(regexp_replace(regexp_replace(regexp_replace(redacted_text, '\r', chr(10), 'g'), '[\t ]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^[\s\x{0B}]+|[\s\x{0B}]+$', '', 'g'), 1, 4000)"

ORACLE = {
    "embedding_backfill": "SELECT DISTINCT id, sha256(redacted_text) AS input_hash, true AS ok FROM (SELECT DISTINCT id, redacted_text FROM intake_sessions)",
    "lexical_rank_topk": f"""SELECT id, hits, floor(least(hits * 0.1 / 0.5, 1.0) * 100 + 0.5)::BIGINT AS score FROM (SELECT id, decision_date, {_HITS}::BIGINT AS hits FROM precedents)
      WHERE hits > 0 ORDER BY hits DESC, decision_date DESC NULLS LAST, id LIMIT 50""",
    "semantic_topk": """SELECT vec_id, round(s, 5) AS similarity FROM (SELECT e.vec_id, list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS s FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q)
      ORDER BY s DESC, vec_id LIMIT 20""",
    "vector_validity": "SELECT label, (len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0) AS ok, count(*) AS n FROM embeddings GROUP BY 1, 2",
    "fact_tags": f"SELECT id, {_FACT_COLS}, array_to_string(media[2:], ',') AS more, array_to_string(tags, ',') AS tags FROM ({facts_sql('SELECT id, source_text AS txt FROM precedents')})",
    "session_fact_tags": f"SELECT medium, expression, repetition, count(*) AS n FROM ({facts_sql('SELECT id, redacted_text AS txt FROM intake_sessions')}) GROUP BY 1, 2, 3",
    "issue_jaccard": f"SELECT id, {_FS} AS fact_score, {_IS} AS issue_score FROM ({facts_sql('SELECT id, source_text AS txt FROM precedents')})",
    "tagged_rank": f"""WITH f AS ({facts_sql("SELECT *, source_text AS txt FROM precedents WHERE searchable AND contains(case_name, '통신매체이용음란')")}),
      c AS (SELECT *, {_HITS}::BIGINT AS hits FROM f),
      k AS (SELECT * FROM c WHERE hits > 0 OR medium = 'game_chat' OR recipient = 'direct_account' OR relationship = 'game_user' OR context = 'conflict' OR expression = 'insult_with_sexual_terms' OR repetition = 'repeated'
            OR len(list_intersect(tags, [{', '.join(quoted(t) for t in CASE['issueTags'])}])) > 0 ORDER BY hits DESC, decision_date DESC NULLS LAST, id LIMIT 50),
      s AS (SELECT id, decision_date, floor(least(hits * 0.1 / 0.5, 1.0) * 100 + 0.5)::BIGINT AS lexical_score, {_FS} AS tag_score, {_IS} AS issue, {focus_sql('case_name')} AS focus FROM k),
      t AS (SELECT *, greatest(0, floor(0.45::DOUBLE * lexical_score + 0.45::DOUBLE * tag_score + 0.10::DOUBLE * issue - {penalty_sql('focus')} + 0.5))::BIGINT AS score FROM s)
      SELECT id, score, tag_score, lexical_score, focus FROM t WHERE score >= 30 ORDER BY score DESC, tag_score DESC, decision_date DESC NULLS LAST, id LIMIT 50""",
    "hybrid_rank": f"""WITH f AS ({facts_sql("SELECT *, source_text AS txt FROM precedents WHERE searchable AND contains(case_name, '통신매체이용음란')")}),
      q AS (SELECT embedding FROM embeddings WHERE vec_id = 7),
      c AS (SELECT f.*, list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS sim FROM f JOIN embeddings e ON e.vec_id = ('0x' || substr(f.id, 1, 7))::BIGINT % 500, q
            WHERE verified_at IS NOT NULL AND link_checked_at >= TIMESTAMP '{AS_OF}' - INTERVAL {HOURS} HOUR AND link_status BETWEEN 200 AND 399),
      k AS (SELECT * FROM c ORDER BY round(sim, 6) DESC, decision_date DESC NULLS LAST, id LIMIT 20),
      s AS (SELECT id, decision_date, greatest(least(sim, 1.0), 0.0) * 100 AS p, {_FS} AS fs, {_IS} AS iss, {focus_sql('case_name')} AS focus FROM k)
      SELECT id, score, semantic_score FROM (SELECT id, decision_date, floor(p + 0.5)::BIGINT AS semantic_score, greatest(0, floor(0.45::DOUBLE * p + 0.45::DOUBLE * fs + 0.10::DOUBLE * iss - {penalty_sql('focus')} + 0.5))::BIGINT AS score FROM s)
      WHERE score >= 20 ORDER BY score DESC, decision_date DESC NULLS LAST, id LIMIT 20""",
    "semantic_topk_batch": """SELECT query_id, vec_id, round(s, 5) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS n FROM (
      SELECT q.vec_id AS query_id, e.vec_id, list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS s FROM embeddings e, embeddings q WHERE q.vec_id % 100 = 0)) WHERE n <= 20""",
    "hybrid_rank_batch": f"""WITH f AS ({facts_sql("SELECT *, source_text AS txt FROM precedents WHERE searchable AND contains(case_name, '통신매체이용음란')")}),
      q AS (SELECT vec_id AS query_id, embedding FROM embeddings WHERE vec_id % 100 = 0),
      c AS (SELECT f.*, q.query_id, list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS sim FROM f JOIN embeddings e ON e.vec_id = ('0x' || substr(f.id, 1, 7))::BIGINT % (SELECT count(*) FROM embeddings), q
            WHERE verified_at IS NOT NULL AND link_checked_at >= TIMESTAMP '{AS_OF}' - INTERVAL {HOURS} HOUR AND link_status BETWEEN 200 AND 399),
      k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(sim, 6) DESC, decision_date DESC NULLS LAST, id) AS kn FROM c) WHERE kn <= 20),
      s AS (SELECT query_id, id, decision_date, greatest(least(sim, 1.0), 0.0) * 100 AS p, {_FS} AS fs, {_IS} AS iss, {focus_sql('case_name')} AS focus FROM k),
      t AS (SELECT query_id, id, decision_date, floor(p + 0.5)::BIGINT AS semantic_score, greatest(0, floor(0.45::DOUBLE * p + 0.45::DOUBLE * fs + 0.10::DOUBLE * iss - {penalty_sql('focus')} + 0.5))::BIGINT AS score FROM s)
      SELECT query_id, id, score, semantic_score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, decision_date DESC NULLS LAST, id) AS m FROM t WHERE score >= 20) WHERE m <= 20""",
    "paragraph_split": f"""SELECT id, i AS ordinal, 'p' || lpad(i::VARCHAR, greatest(3, length(i::VARCHAR))::INT, '0') AS paragraph_id, sha256(ps[i]) AS body_hash
      FROM (SELECT id, ps, unnest(range(1, len(ps) + 1)) AS i FROM (SELECT id, {paragraphs_sql('source_text')} AS ps FROM precedents))""",
    "html_strip_hash": f"SELECT id, sha256({_CLEAN}) AS clean_hash FROM precedents",
    "redact_pii": _redact_sql(),
    "relevant_paragraphs": f"WITH {_picked(2, 600)} SELECT precedent_id, paragraph_id, length(body)::BIGINT AS n FROM picked",
    "summary_estimate": f"WITH {_picked(2, 40000)} SELECT count(*) AS eligible, sum(n)::BIGINT AS n_chars FROM (SELECT precedent_id, sum(length(body)) AS n FROM picked GROUP BY 1)",
    "relevant_paragraphs_whole": f"WITH {_picked(3, 40000)} SELECT precedent_id, paragraph_id, length(body)::BIGINT AS n FROM picked",
    "summary_estimate_whole": f"WITH {_picked(3, 40000)} SELECT count(*) AS eligible, sum(n)::BIGINT AS n_chars FROM (SELECT precedent_id, sum(length(body)) AS n FROM picked GROUP BY 1)",
    "document_facts": f"""WITH {_picked(3, 40000)},
      g AS (SELECT precedent_id, string_agg(body, chr(10) ORDER BY ordinal, paragraph_id) AS txt, count(*) AS k FROM picked
        WHERE NOT ({any_of(_COMPACT, R.STATUTE_CONTEXT)} AND {' + '.join(f"contains({_COMPACT}, {quoted(t)})::INT" for t in R.LISTED_FORMS)} >= 4) GROUP BY 1),
      e AS (SELECT p.precedent_id, g.txt, coalesce(g.k, 0) AS n_paragraphs FROM (SELECT DISTINCT precedent_id FROM precedent_paragraphs) p LEFT JOIN g ON g.precedent_id = p.precedent_id)
      SELECT precedent_id, {_FACT_COLS}, array_to_string(tags, ',') AS tags, n_paragraphs FROM ({facts_sql('SELECT * FROM e')})""",
    "order_sections": f"""WITH a AS (SELECT precedent_id, paragraph_id, ordinal, trim(regexp_replace(coalesce(body, ''), '{SPACE}+', ' ', 'g')) AS t FROM {_PAR}),
      b AS (SELECT *, row_number() OVER (PARTITION BY precedent_id ORDER BY ordinal, paragraph_id) AS pos FROM a WHERE paragraph_id <> '' AND t <> ''),
      c AS (SELECT *, min(CASE WHEN regexp_matches(t, '^【\\s*주\\s*문\\s*】') THEN pos END) OVER (PARTITION BY precedent_id) AS s FROM b),
      d AS (SELECT *, min(CASE WHEN pos > s AND regexp_matches(t, '^【[^】]*】') THEN pos END) OVER (PARTITION BY precedent_id) AS e FROM c WHERE pos >= s),
      f AS (SELECT precedent_id, paragraph_id, pos, CASE WHEN pos = s THEN trim(regexp_replace(t, '^【\\s*주\\s*문\\s*】', '')) ELSE t END AS part FROM d WHERE e IS NULL OR pos < e),
      g AS (SELECT precedent_id, string_agg(part, ' ' ORDER BY pos) AS t, string_agg(paragraph_id, ',' ORDER BY pos) AS ids FROM f WHERE part <> '' GROUP BY 1)
      SELECT precedent_id, t AS order_text, ids, {_KIND} AS kind FROM g WHERE length(t) <= 1200""",
    "enumerations": f"""SELECT {any_of(_COMPACT, R.STATUTE_CONTEXT)} AND {' + '.join(f"contains({_COMPACT}, {quoted(t)})::INT" for t in R.LISTED_FORMS)} >= 4 AS is_list, {any_of(_COMPACT, R.RELEVANCE)} AS is_relevant, count(*) AS n
      FROM {_PAR} GROUP BY 1, 2""",
    "focus_penalty": f"SELECT id, focus, ({penalty_sql('focus')})::BIGINT AS penalty, is_target FROM (SELECT id, {focus_sql('case_name')} AS focus, contains(coalesce(case_name, ''), '{R.TARGET}') AS is_target FROM precedents)",
    "order_kinds": f"SELECT {_KIND} AS kind, count(*) AS n FROM (SELECT trim(regexp_replace(coalesce(order_text, ''), '{SPACE}+', ' ', 'g')) AS t FROM precedent_dispositions) GROUP BY 1",
    "embedding_input_hash": f"""WITH f AS ({facts_sql('SELECT id, source_text, source_text AS txt FROM precedents')}),
      b AS (SELECT *, substr(array_to_string(list_filter(list_transform(string_split_regex(regexp_replace({_CLEAN}, '([.!?。])[\\s\\x{{0B}}]+', '\\1' || chr(10), 'g'), '\\n+'), lambda p: trim(p)),
        lambda p: p <> '' AND NOT regexp_matches(p, {quoted(embedding.OUTCOME)})), chr(10)), 1, 6000) AS body FROM f)
      SELECT id, sha256(array_to_string(list_filter(list_concat([{quoted(embedding.DOCUMENT_HEAD)},
        {', '.join(f"CASE WHEN {c} NOT IN ('unknown', 'other') THEN '{f}: ' || {c} END" for f, c in (('medium', 'medium'), ('messageForm', 'form'), ('recipientIdentification', 'recipient'), ('reachedRecipient', 'reached'), ('relationship', 'relationship'), ('context', 'context'), ('expressionType', 'expression'), ('repetition', 'repetition')))}],
        list_transform(tags, lambda t: 'issue: ' || t), [nullif(body, '')]), lambda x: x IS NOT NULL), chr(10))) AS input_hash FROM b""",
    "query_normalization": f"""SELECT DISTINCT id, sha256(q) AS query_hash, array_to_string(list_filter(w, lambda x, i: list_position(w, x) = i)[1:24], ' OR ') AS expression
      FROM (SELECT id, q, list_filter(list_transform(string_split_regex(q, '{SPACE.replace(chr(92) + 'x{FEFF}', '')}+'), lambda w: regexp_replace(w, '[^\\p{{L}}\\p{{N}}]+', '', 'g')), lambda w: length(w) >= 2) AS w FROM (SELECT id, {_NORMAL} AS q FROM intake_sessions))""",
    "snippets": "SELECT id, substr(regexp_replace(source_text, '<[^>]+>', ' ', 'g'), 1, 360) AS snippet FROM precedents",
}

_PAIRS = [("medium", "medium"), ("form", "form"), ("recipient", "recipient"), ("reached", "reached"), ("relationship", "relationship"), ("context", "context"), ("expression", "expression"), ("repetition", "repetition")]
_BOTH = " + ".join(f"(d.{c} NOT IN ('unknown', 'other') AND q.{c} NOT IN ('unknown', 'other'))::INT" for c, _ in _PAIRS)
_SAME = " + ".join(f"(d.{c} NOT IN ('unknown', 'other') AND d.{c} = q.{c})::INT" for c, _ in _PAIRS)
_ARMS = " OR ".join(f"(q.{c} NOT IN ('unknown', 'other') AND d.{c} = q.{c})" for c in ("medium", "recipient", "relationship", "context", "expression", "repetition"))
_UNION = "len(list_distinct(list_concat(d.tags, q.tags)))"
ORACLE["batch_search"] = f"""WITH q AS (SELECT *, list_transform(list_filter(w, lambda x, i: list_position(w, x) = i)[1:24], lambda x: lower(x)) AS terms FROM (
    SELECT *, list_filter(list_transform(string_split_regex(n, '{SPACE.replace(chr(92) + 'x{FEFF}', '')}+'), lambda w: regexp_replace(w, '[^\\p{{L}}\\p{{N}}]+', '', 'g')), lambda w: length(w) >= 2) AS w
    FROM ({facts_sql(f"SELECT DISTINCT id AS query_id, redacted_text AS txt, {_NORMAL} AS n FROM intake_sessions WHERE ('0x' || substr(id, 1, 7))::BIGINT % 100 = 0")}))
    WHERE expression <> 'other' OR list_contains(tags, '성적표현')),
  d AS (SELECT *, regexp_extract_all(lower({_WORDS}), '[\\p{{L}}\\p{{N}}]+') AS words FROM ({facts_sql("SELECT *, source_text AS txt FROM precedents WHERE searchable AND contains(case_name, '통신매체이용음란')")})),
  x AS (SELECT q.query_id, d.id, d.decision_date, {focus_sql('d.case_name')} AS focus, len(list_filter(d.words, lambda w: list_contains(q.terms, w))) AS hits, ({_ARMS} OR len(list_intersect(d.tags, q.tags)) > 0) AS tagged,
      CASE WHEN ({_BOTH}) <= 1 THEN 0 ELSE floor(({_SAME}) * 100.0::DOUBLE / ({_BOTH}) + 0.5) END::BIGINT AS tag_score,
      CASE WHEN {_UNION} = 0 THEN 0 ELSE floor(len(list_intersect(d.tags, q.tags)) * 100.0::DOUBLE / {_UNION} + 0.5) END::BIGINT AS issue FROM d, q),
  k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY hits DESC, decision_date DESC NULLS LAST, id) AS n FROM x WHERE hits > 0 OR tagged),
  s AS (SELECT *, greatest(0, floor(0.45::DOUBLE * floor(least(hits * 0.1 / 0.5, 1.0) * 100 + 0.5) + 0.45::DOUBLE * tag_score + 0.10::DOUBLE * issue - {penalty_sql('focus')} + 0.5))::BIGINT AS score FROM k WHERE n <= 50)
  SELECT query_id, id, score, tag_score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, tag_score DESC, decision_date DESC NULLS LAST, id) AS m FROM s WHERE score >= 55) WHERE m <= 5"""
