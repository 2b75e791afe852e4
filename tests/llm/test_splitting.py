"""Pieces against a step-by-step greedy walk, exact round trips and edge cases."""

import random

import pyarrow as pa
import pytest

from lexweave.llm.charforms import code_points
from lexweave.llm.splitting import boundaries, greedy_cuts, split_oversized

PARTS = ["a", "나", " ", ". ", "\n", "<p>", "</p>", "<br/>\n", "&nbsp;", "b", "c", "xyz", '"', "!", "👩", "<b class='x y'>"]


def walk(text, limit, overlap):
    """One cut after the other: the farthest boundary of the best level in the later half, else any, else the limit."""
    cp, bounds = code_points(pa.array([text]))
    levels = [x.tolist() for x in boundaries(cp, bounds)]
    natural, n, end, out = sorted(set(sum(levels, []))), len(text), 0, []
    while True:
        start = end - overlap if end else 0
        reach = start + limit
        if reach >= n:
            return [*out, n]
        least = end or overlap
        low = max(least, start + limit // 2)
        for level in levels:
            if inside := [x for x in level if low < x <= reach]:
                cut = max(inside)
                break
        else:
            inside = [x for x in natural if least < x <= reach]
            cut = max(inside) if inside else reach
        out.append(cut)
        end = cut


def test_all_cuts_at_once_equal_the_walk():
    rng = random.Random(3)
    for _ in range(400):
        limit = rng.randint(3, 30)
        overlap = rng.randint(0, limit - 1)
        texts = ["".join(rng.choice(PARTS) for _ in range(rng.randint(1, 90))) for _ in range(4)]
        texts = [t for t in texts if len(t) > limit]
        if texts:
            cp, bounds = code_points(pa.array(texts))
            ends, owner = greedy_cuts(cp, bounds, limit, overlap)
            for i, t in enumerate(texts):
                assert (ends[owner == i] - bounds[i]).tolist() == walk(t, limit, overlap), (t, limit, overlap)


@pytest.mark.parametrize("limit, overlap", [(50, 0), (50, 7), (10, 9), (1, 0)])
def test_round_trip_and_edges(spark, limit, overlap):
    rng = random.Random(limit)
    long = "".join(rng.choice(PARTS) for _ in range(9000))
    rows = [("a", long), ("a", long), ("b", "x" * 500), ("c", "short" if limit > 5 else ""), ("d", None), ("e", ""), (None, "한 문장이다. " * 40), ("f", "<" * 300), ("g", "가 " * 200)]
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], "k string, body string, piece_no int, piece string")
    got = {}
    for r in split_oversized(df, ["k"], "body", limit, overlap).orderBy("piece_no").collect():
        got.setdefault(r.k, []).append(r)
    texts = {k: t for k, t in rows if t and len(t) > limit}
    assert set(got) == set(texts)
    for k, pieces in got.items():
        assert [p.piece_no for p in pieces] == list(range(1, len(pieces) + 1))
        assert all(len(p.piece) <= limit and p.piece == texts[k][p.piece_start : p.piece_end] for p in pieces)
        assert all(b.piece_start == a.piece_end - overlap for a, b in zip(pieces, pieces[1:]))
        assert pieces[0].piece + "".join(p.piece[overlap:] for p in pieces[1:]) == texts[k]


def test_cuts_prefer_paragraphs_and_spare_tags(spark):
    text = "<p>" + "문장이다. " * 10 + "</p><p>" + "둘째 문단. " * 10 + "</p>"
    df = spark.createDataFrame([("a", text)], "k string, t string")
    pieces = [r.piece for r in split_oversized(df, ["k"], "t", 80).orderBy("piece_no").collect()]
    assert pieces[0].endswith("</p>") and pieces[1].startswith("<p>")
    df = spark.createDataFrame([("a", "가나다라 " * 3 + '<a href="x y z">' + "마바사아 " * 3)], "k string, t string")
    for n in range(17, 30):
        for r in split_oversized(df, ["k"], "t", n).collect():
            assert r.piece.count("<") == r.piece.count(">")


def test_empty_table_and_bad_parameters(spark):
    df = spark.createDataFrame([], "k string, t string")
    assert split_oversized(df, ["k"], "t", 5, 1).count() == 0
    with pytest.raises(ValueError):
        split_oversized(df, ["k"], "t", 5, 5)
