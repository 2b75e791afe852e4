"""Snapshot reconciliation and the orphan cascade against brute force and on edge cases."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexweave.operators import snapshot_diff as S
from lexweave.operators.orphans import OrphanCascade, References, Targets, references, targets

DAY = dt.datetime(2026, 1, 1)
KIND = "n int, a string, b string, h string, t timestamp, key_0 string, change_kind string, _h int"


def brute(rows):
    """rows: n, a, b, h, t -> differences, by dictionaries."""
    value = lambda h: None if h is None else h.strip().lower().removeprefix("0x").lstrip("0")
    last = {}
    for n, a, b, h, t in rows:
        if n is None:
            continue
        k, rank = (n, a, b), (t is not None, t or DAY)
        if k not in last or rank > last[k][0]:
            last[k] = (rank, value(h))
    out, numbers = [], sorted({k[0] for k in last})
    for before, now in zip(numbers, numbers[1:]):
        old = {k[1:]: v[1] for k, v in last.items() if k[0] == before}
        new = {k[1:]: v[1] for k, v in last.items() if k[0] == now}
        out += [(now, *k, "added") for k in new.keys() - old.keys()] + [(now, *k, "removed") for k in old.keys() - new.keys()]
        out += [(now, *k, "changed") for k in new.keys() & old.keys() if new[k] != old[k]]
    return sorted(out, key=repr)


def changes(spark, rows, **k):
    df = spark.createDataFrame([(*r, "x", "y", 1) for r in rows], KIND)
    got = S.snapshot_changes(df, snapshot="n", keys=["a", "b"], digest="h", order="t", **k)
    return sorted((tuple(r) for r in got.select("snapshot_no", "key_0", "key_1", "change_kind").collect()), key=repr)


def test_random_snapshots_with_a_hot_provider(spark):
    rng = random.Random(5)
    rows = []
    for n in (1, 2, 4, 9):
        for i in range(300):
            if rng.random() < 0.9:
                a = "hot" if i % 3 else rng.choice(["p", None, ""])
                h = rng.choice([None, "AB", "ab ", "0xab", "cd", f"{rng.random()}"[2:]])
                rows.append((n, a, f"{i}" if i else None, h, DAY + dt.timedelta(seconds=len(rows))))
                if rng.random() < 0.1:
                    rows.append((n, a, f"{i}" if i else None, rng.choice([h, "ee"]), DAY + dt.timedelta(seconds=len(rows))))
    rows.append((None, "p", "1", "h", DAY))
    want = brute(rows)
    assert len(want) > 200 and changes(spark, rows) == want
    assert changes(spark, rows, rows_per_bucket=50) == want


def test_edges(spark):
    t = DAY
    assert changes(spark, []) == [] and changes(spark, [(1, "a", "b", "h", t)]) == []
    # null and '' are keys and hashes of their own
    assert changes(spark, [(1, "a", None, None, t), (2, "a", "", None, t)]) == [(2, "a", "", "added"), (2, "a", None, "removed")]
    assert changes(spark, [(1, "a", "b", None, t), (2, "a", "b", "", t)]) == [(2, "a", "b", "changed")]
    assert changes(spark, [(1, "a", "b", "00AB", t), (2, "a", "b", " ab", t)]) == []
    # ('a', null) is not (null, 'a'); repeated rows; a tie in time goes by digest alike in both
    assert changes(spark, [(1, "a", None, "h", t), (2, None, "a", "h", t)]) == [(2, "a", None, "removed"), (2, None, "a", "added")]
    assert changes(spark, [(1, "a", "b", "x", t), (1, "a", "b", "y", t), (2, "a", "b", "y", t), (2, "a", "b", "x", t)]) == []
    # the same hashes in another order of time: only the last counts
    u = t + dt.timedelta(1)
    assert changes(spark, [(1, "a", "b", "x", t), (1, "a", "b", "y", u), (2, "a", "b", "y", t), (2, "a", "b", "x", u)]) == [(2, "a", "b", "changed")]
    long = "k" * 100_000
    assert changes(spark, [(1, long, "b", "x", t), (2, long, "b", "z", None)]) == [(2, long, "b", "changed")]


def pairs(rng, n):
    x = rng.integers(0, 2**63, (3, n)).astype(np.uint64)
    return np.concatenate([x, S._pair(*x, 101)[None]])


@pytest.mark.parametrize("extra", [0, 1, 30, 900])
def test_small_tables_grow_until_they_peel(extra):
    with np.errstate(over="ignore"):
        rng = np.random.default_rng(extra)
        common, a, b = pairs(rng, 500), pairs(rng, extra), pairs(rng, extra // 2)
        rows, sign, m = S.reconcile(np.concatenate([common, a], 1), np.concatenate([common, b], 1), 4)
        key = lambda x: sorted(map(tuple, x.T.tolist()))
        assert key(rows[:, sign > 0]) == key(b) and key(rows[:, sign < 0]) == key(a)
        assert m >= 4 and (extra < 30 or m > 4)


def test_a_damaged_table_does_not_pass():
    with np.errstate(over="ignore"):
        t = S.Iblt(8)
        t.add(pairs(np.random.default_rng(1), 3))
        t.words[0, 0] ^= np.uint64(1)
        assert t.peel() is None


def test_orphans_direct_and_inherited(spark):
    late, old = DAY + dt.timedelta(9), DAY - dt.timedelta(9)
    pre = spark.createDataFrame([("a", DAY), ("b", late), ("n", None)], "id string, at timestamp")
    par = spark.createDataFrame([("a", "p1", DAY), ("b", "p1", DAY), ("x", "p1", DAY), ("x", "p1", late), ("", "p1", DAY), (None, "p1", DAY), ("n", "p1", None), ("a", "p9", late)], "pid string, par string, at timestamp")
    dis = spark.createDataFrame(
        [("a", ["p1", None, "", "p7"], DAY), ("x", ["p1"], DAY), ("b", ["p1"], late), (None, ["p1"], DAY), ("a", ["p1"], old), ("n", None, DAY), ("a", [], DAY)], "pid string, ids array<string>, at timestamp"
    )
    cited = dis.select("pid", "at", F.explode("ids").alias("par"))
    key, own = (F.col("pid"), F.col("par")), (F.col("pid"), F.lit(""))
    c = OrphanCascade(
        [references(par, "par", key, "pre", (F.col("pid"), None), "at"), references(dis, "dis", own, "pre", (F.col("pid"), None), "at"), references(cited, "dis", own, "par", key, "at")],
        [targets(pre, "pre", (F.col("id"), None), "at"), targets(par, "par", key, "at")],
    )
    got = lambda df: sorted(tuple(r) for r in df.select("ref_table", "k1", "k2").collect())
    assert got(c.direct()) == [("dis", "a", ""), ("dis", "a", "p1"), ("dis", "a", "p7"), ("dis", "x", ""), ("par", "b", ""), ("par", "x", "")]
    assert got(c.inherited()) == [("dis", "b", "p1"), ("dis", "x", "p1")]
    rep = {(r.ref_table, r.month, r.orphan_kind): r.n_references for r in c.report().collect()}
    assert rep[("dis", "2026-01", "inherited")] == 2 and rep[("dis", "2025-12", "direct")] == 2 and rep[("par", "2026-01", "direct")] == 2


def test_orphans_chain_cycle_and_empty(spark):
    kind = "ref_table string, own_1 string, own_2 string, target string, k1 string, k2 string, written_at timestamp"
    edge = lambda a, b: ("t", a, "", "t", b, "", DAY)
    r = spark.createDataFrame([edge("1", "0"), edge("2", "1"), edge("3", "2"), edge("4", "3"), edge("3", "4"), edge("8", "9"), edge("9", "8")], kind)
    t = spark.createDataFrame([("t", str(i), "", DAY) for i in range(1, 10)], "target string, k1 string, k2 string, arrived_at timestamp")
    c = OrphanCascade([References(r)], [Targets(t)])
    assert [x.k1 for x in c.direct().collect()] == ["0"]
    assert sorted((x.k1, x.round) for x in c.orphan_records().collect()) == [("1", 0), ("2", 1), ("3", 2), ("4", 3)]
    none = OrphanCascade([References(r.limit(0))], [Targets(t.limit(0))])
    assert none.direct().count() == none.inherited().count() == none.report().count() == 0
