"""Decoding of provider payloads (SRC4-SRC6, SRC14, S13): JSON text in, typed rows out.

A list may come as an object or an array and fields under several names. Rows without an id are dropped, as in the
provider's protocol; rows with missing fields are kept with the names of what is missing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import article_parameter, encode_component, flexible_date, sha256, squeeze

# Names of the provider's fields and addresses.
PAGE = "https://www.law.go.kr/LSW/precInfoP.do"
STATUTE_PAGE = "https://www.law.go.kr/법령"
LIST_IDS, DATES = ["판례일련번호", "ID", "id"], ["선고일자", "선고일"]
DETAIL_IDS, BODIES = ["판례정보일련번호", "판례일련번호"], ["판례내용", "판결내용", "본문"]
ENVELOPES = ["PrecService", "판례"]


def _field(json: Column, names: list[str]) -> Column:
    """The first field that isn't blank, trimmed; '' if there is none."""
    found = [F.nullif(F.trim(F.get_json_object(json, f"$['{n}']")), F.lit("")) for n in names]
    return F.coalesce(*found, F.lit(""))


def _items(json: Column, path: str) -> Column:
    """An array of JSON texts from an object or an array at ``path``."""
    at = F.get_json_object(json, path)
    return F.when(at.startswith("["), F.from_json(at, "array<string>")).when(at.startswith("{"), F.array(at)).otherwise(F.array().cast("array<string>"))


def parse_list(df: DataFrame, payload: str) -> DataFrame:
    """SRC4. provider_record_id, case_number, case_name, court, decision_date (text) of each listed record."""
    row = df.select(F.explode(_items(F.col(payload), "$.PrecSearch.prec")).alias("r"))
    r = F.col("r")
    return row.select(
        _field(r, LIST_IDS).alias("provider_record_id"), _field(r, ["사건번호"]).alias("case_number"), _field(r, ["사건명"]).alias("case_name"), _field(r, ["법원명"]).alias("court"),
        flexible_date(_field(r, DATES)).alias("decision_date"),
    ).where("provider_record_id <> ''")


def total_count(payload: Column) -> Column:
    """SRC1. How many records the provider says there are."""
    return F.coalesce(F.get_json_object(payload, "$.PrecSearch.totalCnt").try_cast("int"), F.lit(0))


def parse_detail(df: DataFrame, payload: str, requested_id: Column | None = None, provider: str = "law_open_data") -> DataFrame:
    """SRC5. The record of each payload, its hash and address, and ``missing``: the names of absent fields, in order."""
    body = F.coalesce(*[F.get_json_object(F.col(payload), f"$['{e}']") for e in ENVELOPES], F.col(payload))
    d = df.withColumn("_r", body)
    r = F.col("_r")
    record = F.coalesce(F.nullif(_field(r, DETAIL_IDS), F.lit("")), requested_id if requested_id is not None else F.lit(""))
    d = d.select(
        *df.columns, F.lit(provider).alias("provider"), record.alias("provider_record_id"), _field(r, ["법원명"]).alias("court"), _field(r, ["사건번호"]).alias("case_number"),
        _field(r, ["사건명"]).alias("case_name"), flexible_date(_field(r, DATES)).alias("decision_date"), _field(r, BODIES).alias("source_text"),
    )
    need = {"providerRecordId": "provider_record_id", "court": "court", "caseNumber": "case_number", "caseName": "case_name", "decisionDate": "decision_date", "sourceText": "source_text"}
    missing = F.array_compact(F.array(*[F.when(F.col(c) == "", F.lit(n)) for n, c in need.items()]))
    url = F.concat(F.lit(PAGE + "?precSeq="), encode_component(F.col("provider_record_id")))
    return d.withColumns({"official_url": url, "source_hash": sha256(F.col("source_text")), "missing": missing})


def parse_statute(df: DataFrame, payload: str, law_id: str, article_no: str) -> DataFrame:
    """SRC6. The wanted article, else the first; law_id, article_no, law_name, article_title, body, enforced_on, official_url, missing."""
    law = F.coalesce(F.get_json_object(F.col(payload), "$['법령']"), F.col(payload))
    units = _items(law, "$['조문']['조문단위']")
    unit = F.coalesce(F.get(F.filter(units, lambda u: _field(u, ["조문번호"]) == article_no), F.lit(0)), F.get(units, F.lit(0)))
    info = F.get_json_object(law, "$['기본정보']")
    name = _field(info, ["법령명_한글"])
    d = df.select(
        F.lit(law_id).alias("law_id"), F.lit(article_no).alias("article_no"), name.alias("law_name"), _field(unit, ["조문제목"]).alias("article_title"),
        squeeze(F.regexp_replace(_field(unit, ["조문내용"]), "<[^>]+>", " ")).alias("body"), flexible_date(_field(info, ["시행일자"])).alias("enforced_on"),
    )
    url = F.concat(F.lit(STATUTE_PAGE + "/"), encode_component(F.regexp_replace("law_name", r"\s+", "")), F.lit(f"/제{article_no}조"))
    need = {"lawName": "law_name", "articleTitle": "article_title", "body": "body", "enforcedOn": "enforced_on"}
    return d.withColumn("official_url", url).withColumn("missing", F.array_compact(F.array(*[F.when(F.coalesce(F.col(c), F.lit("")) == "", F.lit(n)) for n, c in need.items()])))


def statute_article(statutes: DataFrame, law_id: str, article_no: str) -> DataFrame:
    """SRC14. The article by its key, no row if absent."""
    return statutes.where((F.col("law_id") == law_id) & (F.col("article_no") == article_no)).limit(1)


__all__ = ["article_parameter", "parse_detail", "parse_list", "parse_statute", "statute_article", "total_count"]
