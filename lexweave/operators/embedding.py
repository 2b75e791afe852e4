"""Embedding inputs, vectors and adapters."""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Callable
from functools import lru_cache
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.rules import SCALARS, is_known, let
from ..functions.text import clean_text, nfkc, sha256

# Fixed values.
OUTCOME = "(유죄|무죄|징역|금고|벌금|집행유예|선고유예|양형|형량|처벌|상고.{0,8}(기각|인용)|원심판결|파기환송|파기자판|공소기각)"
MAX_INPUT = 6000
BATCH_TEXTS = 64  # texts of one call of an adapter
DOCUMENT_HEAD, QUERY_HEAD = "검증된 공개 판례의 중립적 사실관계", "사용자가 입력한 중립적 사실관계"


def without_outcomes(c: Column, limit: int = MAX_INPUT, normalize: bool = True) -> Column:
    """X14. The sentences that tell no outcome, a line each, at most ``limit`` characters."""
    base = F.coalesce(c, F.lit(""))
    parts = F.split(clean_text(nfkc(base) if normalize else base), r"(?<=[.!?。])\s+|(?<=다\.)\s+|\n+")
    kept = F.filter(F.transform(parts, lambda p: F.trim(p)), lambda p: (p != "") & ~p.rlike(OUTCOME))
    return F.substring(F.array_join(kept, "\n"), 1, limit)


def embedding_input(facts: Column, body: Column, head: str = DOCUMENT_HEAD) -> Column:
    """X15. Head, a line for each known fact, a line for each issue, the body."""

    def joined(x: Column) -> Column:
        f = x["f"]
        lines = [F.when(is_known(f[n]), F.concat(F.lit(n + ": "), f[n])) for n in SCALARS]
        issues = F.transform(F.coalesce(f["issueTags"], F.array().cast("array<string>")), lambda t: F.concat(F.lit("issue: "), t))
        rest = F.array_compact(F.array(F.nullif(x["b"], F.lit(""))))
        return F.array_join(F.concat(F.array(F.lit(head)), F.array_compact(F.array(*lines)), issues, rest), "\n")

    return let(F.struct(facts.alias("f"), body.alias("b")), joined)


def is_vector(c: Column, size: int) -> Column:
    """R7. Exactly ``size`` finite numbers."""
    finite = F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(c) == size) & finite, F.lit(False))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """R6. Cosine similarity; null for a zero vector."""
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


class Embedder(Protocol):
    model: str
    size: int

    def embed(self, texts: list[str]) -> list[list[float]]: ...


class HashingEmbedder:
    """U1. The offline adapter: signed counts of character trigrams, normalised; the same text gives the same vector."""

    def __init__(self, size: int = 64):
        self.model, self.size = f"hashing-{size}", size

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), self.size))
        for v, t in zip(out, texts):
            for gram, n in Counter(t[i : i + 3] for i in range(max(1, len(t) - 2))).items():  # a hash for each kind of trigram
                h = _gram_hash(gram)
                v[h % self.size] += n if h >> 63 else -n
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return (out / np.where(norm > 0, norm, 1)).tolist()


@lru_cache(200_000)
def _gram_hash(gram: str) -> int:
    return int.from_bytes(hashlib.blake2b(gram.encode(), digest_size=8).digest(), "big")


def stale(df: DataFrame, model: str) -> DataFrame:
    """F13. Rows whose vector isn't of this model, input and source (columns input_hash, source_hash)."""
    current = F.col("embedding_model").eqNullSafe(F.lit(model)) & F.col("embedding_input_hash").eqNullSafe(F.col("input_hash"))
    current &= F.col("embedding_source_hash").eqNullSafe(F.col("source_hash")) & F.col("embedding").isNotNull()
    return df.where(~current)


def backfill(df: DataFrame, key: str, text: str, embedder: Embedder, allow_external: bool = False) -> DataFrame:
    """U1, U4, U5. key, embedding, input_hash, error_code. A text that fails has an error and no vector; the rest goes on.

    Adapters other than the offline one are used only with ``allow_external``.
    """
    if not allow_external and not isinstance(embedder, HashingEmbedder):
        raise PermissionError("EXTERNAL_ADAPTER_NOT_ALLOWED")
    schema = T.StructType([T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("error_code", T.StringType())])

    def run(s: pd.Series) -> pd.DataFrame:
        texts, rows = [t or "" for t in s], []
        for i in range(0, len(texts), BATCH_TEXTS):
            part = texts[i : i + BATCH_TEXTS]
            try:
                got = embedder.embed(part)
                if len(got) != len(part):
                    raise ValueError
                rows += [judged(v) for v in got]
            except Exception:  # noqa: BLE001
                rows += [alone(t) for t in part]  # the one that fails costs no other
        return pd.DataFrame(rows, columns=["embedding", "error_code"])

    def judged(v) -> tuple:
        good = len(v) == embedder.size and all(np.isfinite(v))
        return v if good else None, None if good else "EMBEDDING_VECTOR_INVALID"

    def alone(t: str) -> tuple:
        try:
            (v,) = embedder.embed([t])
            return judged(v)
        except Exception as e:  # noqa: BLE001
            return None, getattr(e, "code", "EMBEDDING_FAILED")

    got = df.select(key, F.col(text).alias("_t"), F.pandas_udf(run, schema)(F.col(text)).alias("_e"))
    return got.select(key, "_e.embedding", sha256(F.col("_t")).alias("input_hash"), "_e.error_code")


def extractive_summary(paragraphs: Column, most: int = 3) -> Column:
    """U2. The offline stand-in for a summariser: the first sentences of the first paragraphs, each with its source."""
    short = F.filter(paragraphs, lambda p: (p["body"] != "") & (F.length(p["body"]) <= 500))
    pick = F.transform(F.slice(short, 1, most), lambda p: F.struct(p["body"].alias("text"), F.array(p["paragraph_id"]).alias("paragraphIds")))
    return F.struct(pick.alias("sentences"))


def isolated(f: Callable, code: str) -> Callable:
    """U4. ``f`` of one record as (result, error code)."""

    def run(x):
        try:
            return f(x), None
        except Exception as e:  # noqa: BLE001
            return None, getattr(e, "code", code)

    return run
