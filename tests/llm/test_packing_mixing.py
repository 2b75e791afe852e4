"""Containers: nothing lost, nothing split that fits, little unused space. Mixes: quotas, caps, Pfair deviation."""

import random

import numpy as np
import pytest

from lexweave.llm import mixing, packing
from lexweave.llm.mixing import Mix, frames_of, plan_quotas, schedule
from lexweave.llm.packing import best_fit, pack, piece_texts


def packed(spark, rows, limits, **k):
    df = spark.createDataFrame([(*r, "x", True) for r in rows], "d bigint, s int, bin string, open boolean")
    return pack(df, limits, item_id="d", size="s", **k).toPandas()


def whole(out, rows):
    """Every container within its capacity, every item there as often as it was given."""
    per = out.groupby(["limit_name", "container_id"])
    assert (per["size"].sum() <= per.capacity.first()).all() and (per["size"].sum() == per.container_fill.first()).all() and (per.container_fill.nunique() == 1).all()
    want = sorted((str(i), max(s or 0, 0)) for i, s in rows)
    for _, o in out.groupby("limit_name"):
        assert o["size"].sum() == sum(s for _, s in want)
        assert sorted(o[o.piece_no == 1].item_id.map(lambda x: "None" if x is None or x != x else x)) == sorted(i for i, _ in want)


@pytest.mark.parametrize("group_items", [10_000, 40])
def test_all_items_in_containers(spark, group_items):
    rng = random.Random(1)
    rows = [(i, int(rng.paretovariate(0.9) * 8)) for i in range(1500)] + [(-1, 100), (-2, 200), (-3, 1000), (-4, 99)]
    out = packed(spark, rows, [("s", 100), ("l", 900)], group_items=group_items)
    whole(out, rows)
    for name, cap in (("s", 100), ("l", 900)):
        o = out[out.limit_name == name]
        n = o.groupby(o.item_id.astype(int)).size()
        assert all((n[i] == 1) == (s <= cap) and n[i] == -(-s // cap) for i, s in rows)
        for _, g in o[o.item_id.isin(o.item_id[o.piece_no > 1])].groupby("item_id"):
            g = g.sort_values("piece_no")
            assert (g.piece_start.values == np.r_[0, g["size"].cumsum().values[:-1]]).all() and (g["size"].values[:-1] == cap).all()
        used = sum(s for _, s in rows) / cap
        assert o.container_id.nunique() <= used * 1.01 + 1 + (group_items < 100) * 3


def test_same_result_in_any_order_and_tight_groups(spark):
    rows = [(i, 10 + i % 50) for i in range(300)]
    key = lambda o: sorted(map(tuple, o[["container_id", "item_id", "size"]].values.tolist()))
    assert key(packed(spark, rows, [("x", 100)], group_items=64)) == key(packed(spark, rows[::-1], [("x", 100)], group_items=64))
    o = packed(spark, [(i, 60) for i in range(500)], [("x", 100)], group_items=50)  # nothing can be merged
    assert o.container_id.nunique() == 500


def test_several_rounds_lose_no_place(spark):
    """Thousands of containers stay open; what can still move finds a place in later rounds."""
    rng = random.Random(9)
    rows = [(i, rng.randint(51, 70)) for i in range(3000)] + [(10_000 + i, rng.randint(1, 20)) for i in range(300)]
    one = packed(spark, rows, [("x", 100)], group_items=10**6)
    for group_items in (500, 60, 20):
        o = packed(spark, rows, [("x", 100)], group_items=group_items)
        whole(o, rows)
        assert o.container_id.nunique() == one.container_id.nunique() == 3000
    small = [(i, 3 + i % 7) for i in range(4000)]
    for group_items in (300, 25):
        o = packed(spark, small, [("x", 100)], group_items=group_items)
        whole(o, small)
        assert (o.groupby("container_id").container_fill.first() <= 50).sum() <= 1
        assert o.container_id.nunique() <= sum(s for _, s in small) / 100 * 1.06 + 1


@pytest.mark.parametrize("group_items", [10_000, 30])
def test_repeated_and_null_ids(spark, group_items, monkeypatch):
    monkeypatch.setattr(packing, "RUN", 7)
    rows = [(7, 10), (7, 10), (7, 9), (7, 25), (7, 25)] + [(None, 6)] * 200 + [(None, 33)] * 3 + [(1, 0)] * 50 + [(None, None)] * 20
    o = packed(spark, rows, [("x", 8), ("y", 16)], group_items=group_items)
    whole(o, rows)
    assert (o[(o.limit_name == "x") & o.container_id.str.startswith("full")].groupby("container_id").size() == 1).all()


def test_pack_edges(spark):
    assert len(packed(spark, [], [("x", 10)])) == 0
    o = packed(spark, [(1, None), (2, 0), (3, -5), (4, 10), (4, 10), (None, 3)], [("x", 10)])
    assert len(o) == 6 and o["size"].sum() == 23 and o.container_id.nunique() == 3 and o.item_id.isna().sum() == 1
    for bad in ([], [("x", 0)], [("x", 5), ("x", 6)]):
        with pytest.raises(ValueError):
            packed(spark, [], bad)


@pytest.mark.parametrize("cap", [5, 8, 20, 1000])
def test_pieces_give_the_text_back(spark, cap):
    rng = random.Random(4)
    texts = ["".join(rng.choice(["a", "é", "가", "👩", " "]) for _ in range(rng.randint(0, 120))) for _ in range(60)] + [None, "", "가" * 4000]
    rows = [(i, t, len((t or "").encode()) + (i == 3) * 50) for i, t in enumerate(texts)]
    df = spark.createDataFrame([(*r, "c") for r in rows], "d bigint, text string, s int, cuts string")
    out = pack(df, [("x", cap)], item_id="d", size="s", text="text")
    whole(out.toPandas(), [(i, s) for i, _, s in rows])
    got = piece_texts(df, out, item_id="d", text="text").toPandas()
    assert set(got.item_id.astype(int)) == {i for i, _, s in rows if s > cap}
    for i, g in got.groupby(got.item_id.astype(int)):
        if cap >= 8 and i != 3:
            assert "".join(g.sort_values("piece_no").piece) == texts[i] and (g["size"] == g.piece.map(lambda x: len(x.encode()))).all()


def test_best_fit_against_brute_force():
    rng = random.Random(2)
    for _ in range(50):
        sizes = np.array([rng.randint(1, 20) for _ in range(60)])
        free, want = [], {}
        for i in sorted(range(60), key=lambda i: (-sizes[i], i)):
            fits = [r for r in free if r >= sizes[i]]
            r = min(fits) if fits else None
            if r is not None:
                free.remove(r)
            free.append((20 if r is None else r) - sizes[i])
            want[i] = r
        assert best_fit(sizes, 20).max() + 1 == len(free)


def test_quotas():
    have = {"a": (1000, 9), "b": (100, 9), "c": (10, 9)}
    p = {x.source: x.quota for x in plan_quotas([("a", 0.5, 1), ("b", 0.3, 2), ("c", 0.1, 3), ("none", 0.1, 9)], have, 600)}
    assert p == {"a": 370, "b": 200, "c": 30, "none": 0}  # b and c at their caps, a has the rest
    p = {x.source: x.quota for x in plan_quotas([("a", 0.5, 1), ("b", 0.5, 1)], have, 100)}
    assert p == {"a": 50, "b": 50}
    assert [x.quota for x in plan_quotas([], {}, 5)] == [] and [x.quota for x in plan_quotas([("a", 0.0, 1)], have)] == [0]


@pytest.mark.parametrize("blocks", [{"a": 5, "b": 3, "c": 1}, {"a": 700, "b": 250, "c": 49, "d": 1}, {"a": 1}, {f"s{i}": 1 + i * i for i in range(20)}, {f"s{i}": 1 for i in range(50)} | {"big": 30}])
def test_no_source_is_a_block_off(blocks):
    n = sum(blocks.values())
    slots = list(schedule(blocks))
    assert [x[2] for x in slots] == list(range(n)) and len({x[:2] for x in slots}) == n
    done = dict.fromkeys(blocks, 0)
    for s, b, slot in slots:
        assert b == done[s]
        done[s] += 1
        assert all(abs(done[x] - blocks[x] * (slot + 1) / n) < 1 for x in blocks)


def test_blocks_never_grow():
    for scale in (1, 1000, 10**9):
        quotas = {"a": 70_001 * scale, "b": 9_999 * scale, "c": 1, "none": 0}
        n, blocks = frames_of(quotas, 500, 64)
        assert set(blocks) == {"a", "b", "c"} and all(quotas[s] / (n * b) <= 500 for s, b in blocks.items())
        assert sum(blocks.values()) <= 64 + 3


@pytest.mark.parametrize("frame", [4096, 30])
def test_mix_of_documents(spark, frame, monkeypatch):
    monkeypatch.setattr(mixing.frames_of, "__defaults__", (frame,))
    monkeypatch.setattr(mixing, "RUN", 3)
    rng = random.Random(3)
    docs = [(i, rng.choice(["big"] * 30 + ["mid"] * 15 + ["small", "unlisted", None]), rng.randint(0, 90)) for i in range(3000)] + [(9001, "mid", None), (9002, "mid", -4), (9003, "big", 5), (9003, "big", 5)] + [(None, "big", 7)] * 100
    df = spark.createDataFrame([(*d, 1, 2) for d in docs], "doc_id bigint, source string, n_tokens int, slot int, available int")
    t = spark.createDataFrame([("big", 0.5, 1), ("mid", 0.3, 2), ("small", 0.1, 3), ("gone", 0.1, 5), (None, 0.5, 1)], "source string, target_share double, max_repeats int")
    m = Mix(df, t, source="source", doc_id="doc_id", size="n_tokens", block_tokens=500)
    rows = m.rows().toPandas()
    have = {}
    for _, s, n in docs:
        have[s] = have.get(s, 0) + max(n or 0, 0)
    quota = {p.source: p.quota for p in m.plan}
    caps = {"big": 1, "mid": 2, "small": 3}
    assert set(rows.source) == {"big", "mid", "small"} and quota["small"] == 3 * have["small"]
    for s, g in rows.groupby("source"):
        assert g[g.doc_id.notna()].groupby(["doc_id", "repeat_no"]).size().max() <= 2 and g.repeat_no.max() <= caps[s] and abs(g.n_tokens.sum() - quota[s]) <= 90
    total = rows.n_tokens.sum()
    ordered = rows.sort_values(["slot", "stream_start"])
    run = {s: (ordered.n_tokens * (ordered.source == s)).groupby(ordered.slot).sum().cumsum() for s in caps}
    every = ordered.groupby("slot").n_tokens.sum().cumsum()
    for s in caps:
        assert (run[s] - every * quota[s] / total).abs().max() < 2 * 500
    sh = {r.source: r for r in m.shares().collect()}
    assert abs(sum(r.actual_share for r in sh.values()) - 1) < 1e-9 and sh["gone"].n_tokens == 0 and sh["small"].times_used == 3
    assert rows.slot.max() < m.frames * m.length and m.frames == (1 if frame > 1000 else m.frames) and (frame > 1000 or m.frames > 3)
    again = Mix(df.orderBy("n_tokens"), t, source="source", doc_id="doc_id", size="n_tokens", block_tokens=500).rows()
    key = lambda r: tuple((x is None, x or 0) if not isinstance(x, str) else (False, x) for x in r)
    assert sorted(map(key, again.collect())) == sorted(map(key, m.rows().collect()))


def test_mix_edges(spark):
    docs = spark.createDataFrame([], "doc_id bigint, source string, n_tokens int")
    t = spark.createDataFrame([("a", 1.0, 1)], "source string, target_share double, max_repeats int")
    m = Mix(docs, t, source="source", doc_id="doc_id", size="n_tokens")
    assert m.rows().count() == 0 and [tuple(r) for r in m.shares().collect()] == [("a", 1.0, 0.0, 0, 0, 0)]
    m = Mix(docs, t.limit(0), source="source", doc_id="doc_id", size="n_tokens")
    assert m.rows().count() == 0 and m.shares().count() == 0
