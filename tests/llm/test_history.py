"""Repeated decisions against all-pairs brute force; the bound of the cells; the persisted index; identities, classes and edge cases."""

import datetime as dt
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexweave.llm import history as H

KIND = "id string, batch_no int, provider string, provider_record_id string, court string, case_number string, decision_date date, source_text string, cell int, views string"
DAY = dt.date(2020, 1, 2)
WORDS = ["피고인", "피해자", "메시지를", "보냈다", "계정", "원심은", "판단하였다", "기록에", "따르면", "주장은", "이유", "없다", "휴대전화", "증거", "접속", "회신"]


@pytest.fixture(autouse=True)
def few_folders(monkeypatch):
    monkeypatch.setattr(H, "PARTS", 2)


def text(rng, n=60):
    return " ".join(f"{rng.choice(WORDS)}{rng.randint(0, 999)}" for _ in range(n))


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], KIND)


def pairs(spark, rows):
    return sorted(map(tuple, H.repeated_decisions(table(spark, rows)).collect()))


def test_fields_as_they_are_in_fact(spark):
    d = spark.createDataFrame(
        [("다래지법 물길지원", "２０１８고단６５８"), ("다래지방법원물길지원 제1형사부", "(2018)고단 제658호"), (" 다래지방법원 물길지원 형사3단독", "2018-고단-000658"), ("다래지방법원 물길지원", "사건 18고단658, 2018고단700(병합)"), ("", None)],
        "court string, case_number string",
    ).withColumns({"provider": F.lit("p"), "provider_record_id": F.lit("No.7123"), "decision_date": F.lit(DAY)})
    got = H.with_identities(d).collect()
    assert {r._court for r in got[:4]} == {"다래지방법원물길지원"} and all(r._numbers[0] == "2018고단658" for r in got[:4])
    assert got[3]._numbers == ["2018고단658", "2018고단700"] and got[4]._court is None and got[4]._numbers == []
    assert {r._record for r in got} == {"p\x1f7123"} and {r._day for r in got} == {"2020-01-02"}


def test_pairs_equal_brute_force(spark):
    rng = random.Random(7)
    base = [(f"a{i:03d}", 0, "p", f"{100000 + i}", "누리중앙지방법원" if i % 3 else "새솔지방법원", f"2019고단{1000 + 3 * i}", DAY + dt.timedelta(i), text(rng)) for i in range(60)]
    rows, want = list(base), set()
    for n, (i, b) in enumerate(rng.sample(list(enumerate(base)), 24)):
        t, number, rid, day, batch = b[7], b[5], f"{200000 + n}", b[6], 1 + n % 3
        how = n % 8
        if how == 1:
            t = t[: len(t) * 2 // 3] + " 판사 가"  # the end is missing
        if how == 2:
            number = number[:-2] + number[-1] + number[-2]  # digits change places
        if how == 3:
            t = "<p>" + t.replace(" ", "&nbsp;") + "</p>"
        if how == 4:
            rid, day = b[3], None
        if how == 5:
            number = number.replace("2019", "19 ") + "호"
        if how == 6:  # a parallel case: the next number, some sentences replaced
            number, t = f"2019고단{1000 + 3 * i + 1}", t[: len(t) * 3 // 4] + text(rng, 15)
        if how == 7:  # another decision in the same case
            t = text(rng)
        rows.append((f"b{n:03d}", batch, "q" if how != 4 else "p", rid, b[4], number, day, t))
        if how < 6:
            want.add((b[0], f"b{n:03d}"))
    again = rows[-24]
    rows.append(("c000", 4, "r", "300000", again[4], again[5], again[6], again[7]))
    want |= {(a, "c000") for a, b in want if b == again[0]} | {(again[0], "c000")}
    assert pairs(spark, rows) == sorted(want)


def test_what_shares_no_cell_is_far():
    """Vectors within a distance of 7 share one of the 8 text cells; shared places are counted as they are."""
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**32, (300, H.PLACES), dtype=np.uint32)
    for d in range(8):
        other = base.copy()
        for r in other:
            r[rng.choice(H.PLACES, d, replace=False)] += 1
        cells = (other == base).reshape(300, -1, H.BAND).all(2)
        assert cells.any(1).all()


def test_vectors(spark):
    rng = random.Random(11)
    t = text(rng)
    d = spark.createDataFrame([(t,), (t + " 고침",), (text(rng),), ("",), ("<p></p>",), ("짧다",), (t.upper() + "!",)], "text string")
    rows = d.coalesce(1).mapInArrow(H._vectors, "text string, " + H._TEXT).collect()
    assert [r.n_grams > 0 for r in rows] == [True, True, True, False, False, True, True] and rows[3].bands == [] and len(rows[5].bands) == 8 and len(rows[0].days) == H.DAY_PLACES
    assert rows[0].bands == rows[6].bands and rows[0].digest == rows[6].digest != rows[1].digest
    assert len(set(rows[0].bands) & set(rows[1].bands)) >= 4 and not set(rows[0].bands) & set(rows[2].bands)
    words = lambda r: (r.s0, r.s1, r.s2, r.s3)
    two = spark.createDataFrame([(*words(x), *words(y)) for x in rows for y in rows], "a0 bigint, a1 bigint, a2 bigint, a3 bigint, b0 bigint, b1 bigint, b2 bigint, b3 bigint")
    got = [r[0] for r in two.select(H.shared_places(*[(F.col(f"a{i}"), F.col(f"b{i}")) for i in range(4)])).collect()]
    octets = lambda r: b"".join(w.to_bytes(8, "little", signed=True) for w in words(r))
    assert got == [sum(a == b for a, b in zip(octets(x), octets(y))) for x in rows for y in rows]


def test_records_without_identity_are_met_by_text(spark):
    """Fields of all later batches taken away: against all pairs of texts."""
    d = spark.read.parquet("/root/testdata/sf0.01/precedents.parquet")
    gone = lambda c: F.when(F.col("batch_no") == 0, F.col(c)).alias(c)
    d = d.select("id", "batch_no", gone("provider"), gone("provider_record_id"), gone("court"), gone("case_number"), gone("decision_date"), "source_text").toPandas()
    sets = []
    h, row, _ = H.grams(pa.array(d.source_text, pa.string()))
    at = np.searchsorted(row, np.arange(len(d) + 1))
    sets = [np.unique(h[a:b]) for a, b in zip(at, at[1:])]
    want = set()
    for j in np.flatnonzero(d.batch_no > 0):
        for i in range(len(d)):
            if i == j or not len(sets[i]) or not len(sets[j]) or (d.batch_no[i] > 0 and i > j):
                continue
            both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if both / min(len(sets[i]), len(sets[j])) >= 0.9 and min(len(sets[i]), len(sets[j])) - both <= 2 * H.GRAM:
                want.add(tuple(sorted((d.id[i], d.id[j]))))
    rows = [tuple(None if x != x else x for x in r) for r in d.itertuples(index=False)]
    got = set(map(tuple, H.repeated_decisions(spark.createDataFrame(rows, KIND.rsplit(", cell", 1)[0])).collect()))
    assert len(want) > 40 and len(got & want) >= 0.9 * len(want)


def test_index_goes_on_in_another_session(spark, tmp_path):
    rng = random.Random(12)
    texts = [text(rng) for _ in range(30)]
    row = lambda i, b, t, **k: (i, b, *{"provider": "p", "rid": "1000" + i[1:], "court": "새솔지방법원", "number": f"2019고단{i[1:]}00", "day": DAY, "text": t, **k}.values())
    path = f"file://{tmp_path}/index"
    H.HistoryIndex(spark, path).match(table(spark, [row(f"a{i}", 0, t) for i, t in enumerate(texts)]))
    index = H.HistoryIndex(spark, path)
    none = {"provider": None, "rid": None, "court": None, "number": None, "day": None}
    batch = [row("b1", 1, texts[3], number="2007고합9876", provider="q"), row("b2", 1, texts[4] + " 고침", **none), row("b3", 1, text(rng))]
    assert sorted(map(tuple, index.match(table(spark, batch)).collect())) == [("a3", "b1"), ("a4", "b2")]
    assert sorted(map(tuple, H.HistoryIndex(spark, path).match(table(spark, [row("c1", 2, batch[2][7], **none), row("c2", 2, texts[4])])).collect())) in ([("a4", "c2"), ("b2", "c2"), ("b3", "c1")], [("a4", "c2"), ("b3", "c1")])
    assert len(index.appends()) == 3 and index.match(table(spark, [])).count() == 0


def test_many_copies_share_entries(spark):
    """A third of all rows has one text: its copies have one entry a cell between them, and all come back."""
    t = text(random.Random(13))
    rows = [(f"a{i:03d}", 0 if i < 5 else 1 + i % 2, "p", f"{5000 + i}", "새솔지방법원" if i % 2 else None, f"2019고단{7 * i}", DAY, t) for i in range(60)]
    index = H.HistoryIndex(spark, H.stage_path(spark, "t"))
    edges = index.match(table(spark, rows))
    per = index._read("cells", index.appends()).groupBy("cell").count().agg(F.max("count")).collect()[0][0]
    assert per <= 4 and H.groups(edges).agg(F.countDistinct("group"), F.count("id")).collect()[0] == (1, 60)


def test_grams_know_texts_by_letters():
    h, row, digest = H.grams(pa.array(["<p>가나다라마바사아자 x</p>", "가나 다라,마바사&nbsp;아자X", "짧다", "", None, "가나다라마바사아차 x"]))
    assert digest[0] == digest[1] != digest[5] and digest[3] == digest[4] == 0
    sets = [set(h[row == i].tolist()) for i in range(6)]
    assert sets[0] == sets[1] and len(sets[2]) == 1 and not sets[3] and 0 < len(sets[0] & sets[5]) < len(sets[0])


def test_groups_are_components(spark):
    rng = random.Random(1)
    edges = [(f"n{i:04d}", f"n{i + 1:04d}") for i in range(0, 300) if i % 37] + [("hub", f"h{i}") for i in range(200)] + [("b", "a"), ("a", "b")]
    rng.shuffle(edges)
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    got = {r.id: r.group for r in H.groups(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert got == {x: find(x) for x in parent}


def test_edges(spark):
    t = text(random.Random(2))
    row = lambda i, b, **k: (i, b, *{"provider": "p" + i, "rid": "1" + i, "court": "새솔지방법원", "number": "2019고단7", "day": DAY, "text": t, **k}.values())
    assert pairs(spark, []) == [] and pairs(spark, [row("a", 0)]) == []
    assert pairs(spark, [row("a", 0), row("b", 0)]) == []  # batch 0 has none in itself
    assert pairs(spark, [row("b", 1), row("a", 1)]) == [("a", "b")]  # no history at all
    assert pairs(spark, [row("a", 0), row("c", 1), row("b", 2)]) == [("a", "b"), ("a", "c"), ("b", "c")]
    assert pairs(spark, [row("a", 0), row("b", 1, text=None), row("c", 1, text=""), row("d", 1, court="다른지방법원"), row("e", 1, number="2019고단8", text=t + " 끝이 다르다 아주 많이 다르다")]) == []
    none = {"provider": None, "rid": None, "court": None, "number": None, "day": None}
    assert pairs(spark, [row("a", 0, **none), row("b", 1, **none), row("c", 1, **none | {"text": text(random.Random(3))})]) == [("a", "b")]  # by text alone
    assert pairs(spark, [(None, 0, *row("a", 0)[2:]), (None, 1, *row("a", 0)[2:]), row("b", 1)]) == []
    assert pairs(spark, [row("a", 0, number=None), row("b", 1, number="")]) == [("a", "b")]  # by court and day
    long = text(random.Random(4), 30_000)
    assert pairs(spark, [row("a", 0, text=long), row("b", 1, text=long + ".")]) == [("a", "b")]


def test_empty_and_wrong_fields_from_another_provider(spark):
    t = text(random.Random(5))
    row = lambda i, b, rid, **k: (i, b, *{"provider": "p" + i, "rid": rid, "court": "새솔지방법원", "number": "2019고단7345", "day": DAY, "text": t, **k}.values())
    first, small = row("a", 0, "100001"), t + " 고침"
    for k in ({"number": ""}, {"number": None}, {"number": "2019고단9812"}, {"court": ""}, {"court": None, "day": None}, {"court": None, "number": "2019고단9812"}, {"court": "", "number": ""}):
        assert pairs(spark, [first, row("b", 1, "200002", **{"text": small, **k})]) == [("a", "b")], k
        assert pairs(spark, [row("a", 0, "100001", **k), row("b", 1, "200002", text=small)]) == [("a", "b")], k  # the history has the empty field
    other = text(random.Random(6))
    for k in ({"number": ""}, {"court": ""}, {"number": "2019고단9812", "court": None}):  # strangers of the same day stay apart
        assert pairs(spark, [first, row("b", 1, "200002", **{"text": other, **k})]) == []
    assert pairs(spark, [first, row("b", 1, "200002", court="누리중앙지방법원")]) == []


def test_identities_of_exact_copies_are_kept(spark):
    t = text(random.Random(8))
    row = lambda i, b, p, rid, **k: (i, b, *{"provider": p, "rid": rid, "court": "새솔지방법원", "number": "2019고단7345", "day": DAY, "text": t, **k}.values())
    a, b = row("a", 0, "x", "100001"), row("b", 1, "y", "200456")
    for k in ({"number": ""}, {"number": "2019고단9812"}):
        # C shares an identity with the copy B only
        assert pairs(spark, [a, b, row("c", 2, "y", "200456", day=DAY + dt.timedelta(9), text=t + " 고침", **k)]) == [("a", "b"), ("a", "c"), ("b", "c")]
