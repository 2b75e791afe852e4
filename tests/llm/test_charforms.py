"""Character forms against the standard's own composition, on look-alikes, ordinary signs and edge cases."""

import random
import unicodedata

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexweave.llm.charforms import LEADS, TAILS, VOWELS, code_points, normalize_array, normalized, slices, to_strings


def form(*texts):
    return normalize_array(pa.array(texts, pa.string())).to_pylist()


@pytest.mark.parametrize(
    "odd, plain",
    [
        ("ＳｏｍｉＣｈａｔ으로", "SomiChat으로"), ("РоlarCаst", "PolarCast"), ("А는 ΙΡ РС", "A는 IP PC"), ("résumé ca‍fé", "résumé café"), ("ｒｅ́ｓ", "rés"),
        ("각 한글", "각 한글"), ("a b c　d e", "a b c d e"), ("﻿t­e​x⁠t‎", "text"), ("나이ㆍ직업・전화⋅문자‧등･끝", "나이·직업·전화·문자·등·끝"),
        ("K−814 Chat‑Log‐x－y", "K-814 Chat-Log-x-y"), ("金某 不知", "金某 不知"), ("со", "co"), ("mooοn", "mooon"), ("ﬁx", "fix"), ("ᄀ", "ㄱ"), ("a‍b", "ab"), ("\U0001d400b", "Ab"),
        ("дружбa", "дружба"), ("pαypαl νisa", "paypal visa"), ("РС 사건", "PC 사건"), ("РС АТ", "PC AT"), ("Ԍood", "Good"),
    ],
)
def test_one_form(odd, plain):
    assert form(odd, plain) == [plain, plain]


@pytest.mark.parametrize(
    "text",
    ["한글 ㅋㅋ ㅠㅠ abc 1·2 【주문】 金某 résumé", "θάλασσα дружба спасибо λόγος Ελπίδα привет", "👩‍💻 🏳️‍🌈 ❤️ 👨‍👩‍👧 1️⃣", "ドラ・エモン", "СТАРТ СССР РОСА", "он сказал: СТОП, РОСА тут", "Ο ΑΝΗΡ έφυγε", "α값 ρ", "① ™ … – “x” ㈜", "", "\n\t a  b\r\n"],
)
def test_ordinary_signs_stay(text):
    assert form(text) == [text]


def test_composition_is_the_standard_one():
    rng = random.Random(1)
    pool = "abcdȩ̣̀́̂ṣé각가힝ạ"
    jamo = {chr(b + i): c for b, g in ((0x1100, LEADS), (0x1161, VOWELS), (0x11A8, TAILS)) for i, c in enumerate(g)}
    texts = ["".join(rng.choice(pool) for _ in range(rng.randint(0, 9))) for _ in range(5000)]
    want = ["".join(jamo.get(c, c) for c in unicodedata.normalize("NFC", t)) for t in texts]
    got = form(*texts)
    assert got == want and form(*got) == got


def test_nulls_long_texts_and_slices(spark):
    long = "가나ａ​" * 60_000
    assert form(None, "", long, "​﻿") == [None, "", "가나a" * 60_000, ""]
    df = spark.createDataFrame([(1, "ａ"), (1, "ａ"), (2, None), (3, ""), (4, long)], "normal_text int, t string")
    got = {r[0]: r[1] for r in df.select("normal_text", normalized(F.col("t"))).collect()}
    assert got == {1: "a", 2: None, 3: "", 4: "가나a" * 60_000}
    assert df.limit(0).select(normalized(F.col("t"))).count() == 0
    batch = pa.RecordBatch.from_arrays([pa.array(["x" * 1_000_000] * 4 + [None, ""])], names=["t"])
    assert [len(b) for b in slices(batch, "t")] == [1, 1, 1, 3] and not list(slices(batch.slice(0, 0), "t"))


def test_code_points_round_trip():
    texts = ["", "a", "é가👩‍💻", "x" * 10]
    cp, bounds = code_points(pa.array(["skip", *texts]).slice(1))
    assert to_strings(cp, bounds).to_pylist() == texts
