"""Splitting oversized texts at natural boundaries, all greedy cuts found in parallel by pointer doubling.

Per Arrow batch of oversized texts: boundaries of paragraphs, sentences and words are marked on the code-point array;
each boundary is joined (by binary search over all boundaries of the batch) to its farthest legal successor, the
overlap included; squaring that successor table log2(pieces) times yields every cut that a greedy walk from each
text's beginning would make. Texts within their limit never leave the JVM.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .charforms import code_points, slices

_SPACE = np.array([9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000], np.uint32)
_STOP = np.array([ord(c) for c in ".!?。！？…"], np.uint32)
_CLOSE = np.array([ord(c) for c in "\"')]}」』”’】"], np.uint32)
_BREAKING_TAGS = ("p", "br", "div", "li", "h1", "h2", "h3", "h4", "h5", "h6", "tr", "ul", "ol", "table", "blockquote")


def _last(flag: np.ndarray) -> np.ndarray:
    """Index of the last set position at or before each position, -1 where none."""
    return np.maximum.accumulate(np.where(flag, np.arange(len(flag)), -1))


def boundaries(cp: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cut positions (index of the first code point after the cut) of paragraphs, sentences and words.

    A cut never lies inside a tag, nor before a mark, joiner or selector. Each text's end is a cut of no level.
    """
    n = len(cp)
    at = np.arange(n)
    row_start = np.repeat(bounds[:-1], np.diff(bounds))
    nxt = np.append(cp[1:], np.uint32(0))
    opened = (cp == ord("<")) & (((nxt >= 65) & (nxt <= 90)) | ((nxt >= 97) & (nxt <= 122)) | (nxt == ord("/")))
    shut = cp == ord(">")
    last_open, last_shut = _last(opened), np.concatenate([[-1], _last(shut)[:-1]])
    inside = (last_open >= row_start) & (last_open > last_shut) & (last_open < at)  # strictly after a '<' not yet closed
    next_shut = np.minimum.accumulate(np.where(shut, at, n)[::-1])[::-1]
    row_end = np.repeat(bounds[1:], np.diff(bounds))
    inside &= next_shut < row_end  # a '<' that nothing closes is no tag
    tag_end = shut & inside
    # names of breaking tags
    breaking = np.zeros(n, bool)
    lower = np.where((cp >= 65) & (cp <= 90), cp + 32, cp)
    slash = nxt == ord("/")
    name_at = np.where(slash, at + 2, at + 1)
    ends = np.flatnonzero(tag_end)
    if len(ends):
        o = last_open[ends]
        for name in _BREAKING_TAGS:
            ok = np.ones(len(ends), bool)
            for i, ch in enumerate(name):
                ok &= lower[np.minimum(name_at[o] + i, n - 1)] == ord(ch)
            after = lower[np.minimum(name_at[o] + len(name), n - 1)]
            ok &= ~(((after >= 97) & (after <= 122)) | ((after >= 48) & (after <= 57)))
            if name != "br":
                ok &= slash[o]
            breaking[ends[ok]] = True
    space = np.isin(cp, _SPACE) & ~inside
    entity = np.zeros(n, bool)  # the end of &nbsp;
    if n >= 6:
        e = np.ones(n - 5, bool)
        for i, ch in enumerate("&nbsp;"):
            e &= cp[i : n - 5 + i] == ord(ch)
        entity[5:] = e
    gap = space | entity
    newline = (cp == 10) & ~inside
    # cut after the whole run of white space that follows
    first_of_run = np.concatenate([[True], ~space[:-1]]) | (at == row_start)
    run_start = _last(space & first_of_run)
    run_has_newline = space & (_last(newline) >= run_start)
    before_run = np.where(space, run_start - 1, at)
    has_before = before_run >= row_start
    b = np.maximum(before_run, 0)
    closer = np.isin(cp, _CLOSE)
    stop = np.isin(cp, _STOP)
    ended = stop | (closer & np.concatenate([[False], stop[:-1]]) & (at > row_start))
    space_end = space & ~np.append(space[1:] & (row_start[1:] == row_start[:-1]), False)
    para = breaking | (space_end & (run_has_newline | (breaking[b] & has_before)))
    para &= ~(breaking & np.append(space[1:] & (row_start[1:] == row_start[:-1]), False))
    sent = (space_end & ended[b] & has_before) | (entity & np.concatenate([np.zeros(6, bool), ended[:-6]])[:n] if n >= 6 else False)
    sent |= np.append(ended[:-1] & opened[1:], False) | (newline & False)
    wide_stop = np.isin(cp, _STOP[3:6])
    sent |= wide_stop
    word = space_end | gap & entity | tag_end
    inner_after = np.append(inside[1:], False) & ~np.append(opened[1:], False)  # the next code point still belongs to the tag
    ok = ~inner_after
    cut = lambda flag: np.flatnonzero(flag & ok) + 1
    return cut(para), cut(sent), cut(word)


def greedy_cuts(cp: np.ndarray, bounds: np.ndarray, limit: int, overlap: int) -> tuple[np.ndarray, np.ndarray]:
    """Ends of all pieces of all texts, sorted, and the text each belongs to. ``0 <= overlap < limit``."""
    rows, step = len(bounds) - 1, limit - overlap
    # one unused position between texts, so that no end is the next one's beginning
    shift = lambda x: x + np.searchsorted(bounds, x - 1, "right") - 1
    levels = [shift(np.unique(x)) for x in boundaries(cp, bounds)]
    starts, ends = bounds[:-1] + np.arange(rows), bounds[1:] + np.arange(rows)
    natural = np.unique(np.concatenate([*levels, starts, ends]))
    # where no boundary is in reach, cuts fall at the limit: nodes on a grid from the last boundary before the gap
    owner = np.searchsorted(ends, natural)
    is_start = natural == starts[owner]
    following = np.append(natural[1:], natural[-1])
    # a text's first piece is longer than the overlap, else the second would begin before it
    begins = np.flatnonzero(is_start)
    following[begins] = natural[np.minimum(np.searchsorted(natural, natural[begins] + overlap, "right"), len(natural) - 1)]
    first = np.where(is_start, limit, step)
    grid = np.where(natural == ends[owner], 0, np.maximum(0, -(-(following - natural - first) // step)))
    total = int(grid.sum())
    of = np.repeat(np.arange(len(natural)), grid)
    j = np.arange(total) - np.repeat(np.cumsum(grid) - grid, grid)
    hard = natural[of] + first[of] + j * step
    nodes = np.unique(np.concatenate([natural, hard]))
    owner = np.searchsorted(ends, nodes)
    end = ends[owner]
    at_start = nodes == starts[owner]
    reach = np.minimum(nodes + np.where(at_start, limit, step), end)
    # the farthest boundary of the highest level in the later half of the window, else the farthest of any level
    target = np.where(reach == end, end, -1)
    base = np.where(at_start, nodes, nodes - overlap)
    least = np.where(at_start, nodes + overlap, nodes)
    floor = np.maximum(least, base + limit // 2)
    for level, low in [(x, floor) for x in levels] + [(natural, least), (nodes, least)]:
        if not len(level):
            continue
        p = level[np.maximum(np.searchsorted(level, reach, "right") - 1, 0)]
        target = np.where((target < 0) & (p > low) & (p <= reach), p, target)
    target = np.where(target < 0, nodes, target)
    succ = np.searchsorted(nodes, target)
    succ = np.where(nodes >= end, np.arange(len(nodes)), succ)
    reached = np.zeros(len(nodes), bool)
    reached[np.searchsorted(nodes, starts)] = True
    while True:  # each round squares the successor table and doubles the reached steps
        before = int(reached.sum())
        reached[succ[np.flatnonzero(reached)]] = True
        succ = succ[succ]
        if int(reached.sum()) == before and (succ == succ[succ]).all():
            break
    cut = reached & ~at_start
    return nodes[cut] - owner[cut], owner[cut]


def _pieces(limit: int, overlap: int, keep: list[str], schema: pa.Schema):
    def run(batches):
        for batch in (part for b in batches for part in slices(b, "_text")):
            texts = batch.column("_text")
            cp, bounds = code_points(texts)
            ends, owner = greedy_cuts(cp, bounds, limit, overlap)
            first = np.concatenate([[True], owner[1:] != owner[:-1]])
            begin = np.where(first, bounds[owner], np.concatenate([[0], ends[:-1]]) - overlap)
            number = np.arange(len(owner)) - np.maximum.accumulate(np.where(first, np.arange(len(owner)), 0))
            lo, hi = begin - bounds[owner], ends - bounds[owner]
            rows = texts.to_pylist()
            text = pa.array([rows[o][a:b] for o, a, b in zip(owner.tolist(), lo.tolist(), hi.tolist())], pa.string())
            at = pa.array(owner)
            cols = [batch.column(k).take(at) for k in keep]
            cols += [pa.array(number + 1, pa.int32()), pa.array(lo, pa.int32()), pa.array(hi, pa.int32()), text]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(cols, schema)], schema=schema)

    return run


def split_oversized(df: DataFrame, keys: list[str], text: str, limit: int, overlap: int = 0) -> DataFrame:
    """Pieces of each text longer than ``limit`` code points.

    Returns the ``keys`` (as strings), piece_no (from 1), piece_start, piece_end (code points, end exclusive) and piece.
    Every piece has at most ``limit`` code points and all but a text's first begin ``overlap`` before the end of their
    predecessor, so the pieces give the text back exactly. Cuts fall after paragraphs, else sentences, else words in
    the later half of the piece, else at any such place, else at the limit.

    Defined cases: null, empty and short texts give no rows; repeated rows (equal keys and text) are split once;
    null keys are kept; an empty table gives no rows; other columns, whatever their names, are not read.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and less than limit")
    names = [f"key_{i}" for i in range(len(keys))]
    long = df.where(F.length(F.col(text)) > limit).select(*[F.col(k).cast("string").alias(n) for k, n in zip(keys, names)], F.col(text).alias("_text"))
    once = long.dropDuplicates()
    fields = [*((n, pa.string()) for n in names), ("piece_no", pa.int32()), ("piece_start", pa.int32()), ("piece_end", pa.int32()), ("piece", pa.string())]
    ddl = ", ".join(f"{n} {'int' if t == pa.int32() else 'string'}" for n, t in fields)
    out = once.mapInArrow(_pieces(limit, overlap, names, pa.schema(fields)), ddl)
    return out.select(*[F.col(n).alias(k) for n, k in zip(names, keys)], "piece_no", "piece_start", "piece_end", "piece")
