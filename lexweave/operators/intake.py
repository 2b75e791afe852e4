"""Intake sessions: questions, answers and expiry (X17, V6, F11, ST1-ST4, section 3.3)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rules import is_known

# Fields in the order in which they are asked for, and their prompts.
QUESTIONS = [
    ("expressionType", "상대방이 보낸 내용은 어떤 것이었나요? 받은 말을 그대로 적으셔도 됩니다."),
    ("medium", "어떤 매체로 전달되었나요? (예: 카카오톡, 게임 채팅, SNS, 문자)"),
    ("recipientIdentification", "상대방이 누구에게 보이도록 보냈는지 적어주세요. (예: 내 계정으로 직접, 멘션, 공개 게시글)"),
    ("reachedRecipient", "해당 내용이 실제로 상대방에게 전달되었거나 확인되었나요?"),
    ("relationship", "상대방과의 관계는 무엇인가요? (예: 모르는 사람, 지인, 게임 이용자)"),
    ("repetition", "이런 전달은 한 차례였나요, 여러 차례였나요?"),
]
TTL_HOURS = 1


def questions(facts: Column, most: int = 3) -> Column:
    """X17. The first unknown fields as ARRAY<STRUCT<id, field, prompt>>."""
    items = [F.when(~is_known(facts[f]), F.struct(F.lit(f).alias("id"), F.lit(f).alias("field"), F.lit(p).alias("prompt"))) for f, p in QUESTIONS]
    return F.slice(F.array_compact(F.array(*items)), 1, most)


def open_session(df: DataFrame, created_at: Column) -> DataFrame:
    """ST1. Expiry is fixed at creation and doesn't slide."""
    return df.withColumn("created_at", created_at).withColumn("expires_at", F.col("created_at") + F.make_dt_interval(hours=F.lit(TTL_HOURS)))


def unexpired(sessions: DataFrame, as_of: Column) -> DataFrame:
    """F11, ST2."""
    return sessions.where(F.col("expires_at") > as_of)


def purge(sessions: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """ST3, ST4. The sessions that stay, and one row with the number deleted. Running it again deletes nothing."""
    gone = F.col("expires_at") <= as_of
    return sessions.where(~gone), sessions.agg(F.count_if(gone).alias("deleted"))


def accepted_answers(questions: Column, answers: Column) -> Column:
    """V6. STRUCT<answers, error>: asked ids only, trimmed, none blank; INTAKE_ANSWER_REQUIRED if one is missing."""
    ids = F.transform(questions, lambda q: q["id"])
    given = F.coalesce(answers, F.create_map().cast("map<string,string>"))
    kept = F.transform_values(F.map_filter(given, lambda k, v: F.array_contains(ids, k) & (F.coalesce(F.trim(v), F.lit("")) != "")), lambda k, v: F.trim(v))
    missing = F.size(F.array_except(ids, F.map_keys(kept))) > 0
    return F.struct(F.when(~missing, kept).alias("answers"), F.when(missing, "INTAKE_ANSWER_REQUIRED").alias("error"))


def session_query(text: Column, questions: Column, answers: Column) -> Column:
    """The text of a completed session: what was described and the answers, a line each, in order of the questions."""
    lines = F.transform(questions, lambda q: F.trim(F.element_at(answers, q["id"])))
    return F.array_join(F.concat(F.array(text), F.filter(lines, lambda x: F.coalesce(x != "", F.lit(False)))), "\n")
