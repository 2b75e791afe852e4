"""What changed between full snapshots: set reconciliation by invertible Bloom lookup tables (IBLT).

Plan: rows are projected to key, 64-bit digest of the canonical hash and order; the last row of each key and snapshot is
taken with a map-side combine (a key may be repeated without bound), and what is left is grouped by key-hash bucket.
The number of buckets follows the row count, so a bucket is bounded whatever the key, provider or court distribution
(buckets are hashes of whole record keys: a hot provider spreads over all of them). Inside a bucket each snapshot
becomes an IBLT; the tables of consecutive deliveries are subtracted and peeled, which costs O(differences); a bucket
that fails to peel, or whose recovered pairs disagree with the digests of the snapshots, is enlarged. Only recovered
records are turned back into key strings.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROWS_PER_BUCKET = 24_000
_HASHES = 3
_U = np.uint64


def canonical_hex(c: Column) -> Column:
    """A hash as its hexadecimal value: case, blanks, a 0x mark and leading zeros don't count. Null stays null."""
    return F.regexp_replace(F.lower(F.trim(c)), r"^(0x)?0*|\s+", "")


def _mix(x: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit finaliser (xor-shift-multiply), vectorised."""
    x = x + _U((seed * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _pair(k1: np.ndarray, k2: np.ndarray, h: np.ndarray, seed: int) -> np.ndarray:
    return _mix(_mix(_mix(k1, seed) ^ k2, seed + 1) ^ h, seed + 2)


class Iblt:
    """Cells of count, and of xor of both key words, of the value digest and of a checksum."""

    __slots__ = ("m", "count", "words")

    def __init__(self, m: int):
        self.m = m  # cells in each of the _HASHES sub-tables
        self.count = np.zeros(m * _HASHES, np.int64)
        self.words = np.zeros((4, m * _HASHES), np.uint64)

    def cells(self, rows: np.ndarray) -> np.ndarray:
        return np.stack([_pair(*rows[:3], 11 + 7 * i) % _U(self.m) + _U(i * self.m) for i in range(_HASHES)]).astype(np.int64)

    def add(self, rows: np.ndarray, sign: np.ndarray | int = 1) -> None:
        at = self.cells(rows)
        for i in range(_HASHES):
            np.add.at(self.count, at[i], sign)
            for w in range(4):
                np.bitwise_xor.at(self.words[w], at[i], rows[w])

    def minus(self, other: Iblt) -> Iblt:
        out = Iblt(self.m)
        out.count, out.words = self.count - other.count, self.words ^ other.words
        return out

    def peel(self) -> tuple[np.ndarray, np.ndarray] | None:
        """The pairs of the difference with their signs; None if it doesn't peel to nothing."""
        found, signs = [], []
        while True:
            at = np.flatnonzero(np.abs(self.count) == 1)
            rows = self.words[:, at]
            pure = _pair(*rows[:3], 101) == rows[3]
            at, rows = at[pure], rows[:, pure]
            if not len(at):
                break
            _, first = np.unique(rows[3], return_index=True)  # a pair may be pure in several cells
            rows, sign = rows[:, first], self.count[at[first]]
            found.append(rows)
            signs.append(sign)
            self.add(rows, -sign)
            if sum(map(len, signs)) > 4 * self.m * _HASHES:
                return None
        if self.count.any() or self.words.any():
            return None
        return (np.concatenate(found, axis=1), np.concatenate(signs)) if found else (np.zeros((4, 0), np.uint64), np.zeros(0, np.int64))


def _digest(rows: np.ndarray) -> tuple[int, np.uint64, np.uint64]:
    x = _pair(*rows[:3], 211)
    return rows.shape[1], np.add.reduce(x, dtype=np.uint64), np.bitwise_xor.reduce(x) if len(x) else _U(0)


def reconcile(earlier: np.ndarray, later: np.ndarray, cells: int = 64, sketches: tuple[dict, dict] | None = None) -> tuple[np.ndarray, np.ndarray, int]:
    """Pairs only in ``later`` (sign 1) or only in ``earlier`` (sign -1), and the table size that peeled.

    ``earlier``/``later``: uint64 rows (key word 1, key word 2, digest, checksum) of distinct keys. A table that fails
    to peel or to match both digests is doubled; beyond four cells a pair the sets are compared directly.
    """
    a, b = sketches if sketches is not None else ({}, {})
    n0, s0, x0 = _digest(earlier)
    n1, s1, x1 = _digest(later)
    m = cells
    while m * _HASHES <= 4 * (n0 + n1) + 4 * cells * _HASHES:
        for cache, rows in ((a, earlier), (b, later)):
            if m not in cache:
                cache[m] = Iblt(m)
                cache[m].add(rows)
        got = b[m].minus(a[m]).peel()
        if got is not None:
            rows, sign = got
            x = _pair(*rows[:3], 211)
            same_sum = s0 + np.add.reduce(x[sign > 0], dtype=np.uint64) - np.add.reduce(x[sign < 0], dtype=np.uint64) == s1
            if same_sum and n0 + int(sign.sum()) == n1 and (x0 ^ (np.bitwise_xor.reduce(x) if len(x) else _U(0))) == x1:
                return rows, sign, m
        m *= 2
    ids = [list(map(tuple, r.T.tolist())) for r in (earlier, later)]
    sets = [set(x) for x in ids]
    rows = [x for x in ids[1] if x not in sets[0]] + [x for x in ids[0] if x not in sets[1]]
    n = len(sets[1] - sets[0])
    return np.array(rows, np.uint64).reshape(-1, 4).T, np.r_[np.ones(n, np.int64), -np.ones(len(rows) - n, np.int64)], m


def _bucket_changes(names: list[str], numbers: list[int], schema: pa.Schema):
    """Arrow function over one bucket: tables, subtraction, peeling, classification."""

    def run(t: pa.Table) -> pa.Table:
        with np.errstate(over="ignore"):
            col = lambda n: t.column(n).combine_chunks().to_numpy(zero_copy_only=False)
            snap, k1, k2, h = (col(n) for n in ("_snap", "_k1", "_k2", "_h"))
            order = np.lexsort((k2, k1, snap))
            words = np.stack([x[order].view(np.uint64) for x in (k1, k2, h)])
            words = np.concatenate([words, _pair(*words, 101)[None]])
            bounds = np.searchsorted(snap[order], np.array([[n, n + 1] for n in numbers]).ravel()).reshape(-1, 2)
            out_snap, out_row, out_kind = [], [], []
            before, sketch, cells = None, {}, 64
            for number, (lo, hi) in zip(numbers, bounds):
                now, mine = (words[:, lo:hi], lo), {}
                if before is not None:
                    rows, sign, used = reconcile(before[0], now[0], cells, (sketch, mine))
                    while cells * 2 * _HASHES < len(sign):  # the next delivery probably differs as much
                        cells *= 2
                    gone, came = rows[:, sign < 0], rows[:, sign > 0]
                    for side, other, base, kind in ((came, gone, now, "added"), (gone, came, before, "removed")):
                        both = {*zip(other[0].tolist(), other[1].tolist())}
                        at = base[1] + _locate(base[0], side)
                        is_changed = np.array([x in both for x in zip(side[0].tolist(), side[1].tolist())], bool)
                        if kind == "removed":
                            at, kinds = at[~is_changed], np.zeros((~is_changed).sum(), object)
                            kinds[:] = kind
                        else:
                            kinds = np.where(is_changed, "changed", kind).astype(object)
                        out_snap += [number] * len(at)
                        out_row.append(order[at])
                        out_kind += kinds.tolist()
                before, sketch = now, mine
            rows = pa.array(np.concatenate(out_row) if out_row else np.zeros(0, np.int64), pa.int64())
            got = [t.column(n).take(rows).combine_chunks() for n in names]
            return pa.Table.from_arrays([pa.array(out_snap, pa.int32()), *got, pa.array(out_kind, pa.string())], schema=schema)

    return run


def _locate(sorted_rows: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Columns of ``sorted_rows`` (in signed order of its key words) that hold the wanted keys."""
    keys = sorted_rows[:2].view(np.int64)
    k = np.empty(keys.shape[1], [("a", np.int64), ("b", np.int64)])
    k["a"], k["b"] = keys
    w = np.empty(wanted.shape[1], k.dtype)
    w["a"], w["b"] = np.ascontiguousarray(wanted[:2]).view(np.int64)
    return np.searchsorted(k, w)


def _combined(batches):
    """Of each batch the last row of a key and snapshot: a key repeated without bound crosses the network once a batch."""
    for b in batches:
        snap, k1, k2, ts, h = (b.column(n).to_numpy(zero_copy_only=False) for n in ("_snap", "_k1", "_k2", "_ts", "_h"))
        order = np.lexsort((h, ts, k2, k1, snap))
        same = [x[order][1:] == x[order][:-1] for x in (snap, k1, k2)]
        last = np.append(~(same[0] & same[1] & same[2]), True) if len(order) else np.zeros(0, bool)
        yield b if last.all() else b.take(pa.array(np.sort(order[last])))


def snapshot_changes(
    df: DataFrame, *, snapshot: str, keys: list[str], digest: str, order: str, rows_per_bucket: int = ROWS_PER_BUCKET
) -> DataFrame:
    """Differences between each delivered snapshot and the delivered one before it.

    Returns ``snapshot_no INT``, ``key_0 .. key_n`` (strings) and ``change_kind`` (added, removed, changed) under the
    later number. The first snapshot yields nothing; numbers never delivered are passed over.

    Defined cases: null hashes equal each other and nothing else; hashes compare as hexadecimal values; of a key that
    a snapshot holds more than once the row last in ``order`` counts (null order first; ties by digest); null key
    parts are a value of their own; rows without a snapshot number belong to no delivery; an empty table or a single
    snapshot gives no rows; other columns, whatever their names, are not read.
    """
    rows = df.where(F.col(snapshot).isNotNull())
    # one row a delivery: the number of deliveries, not of records
    counts = rows.groupBy(F.col(snapshot).cast("int").alias("n")).count().collect()
    numbers = sorted(r["n"] for r in counts)
    total = sum(r["count"] for r in counts)
    buckets = max(1, -(-total // rows_per_bucket))
    names = [f"key_{i}" for i in range(len(keys))]
    cols = [F.col(k).cast("string").alias(n) for k, n in zip(keys, names)]
    parts = [p for n in names for p in (F.col(n).isNull(), F.col(n))]
    slim = rows.select(
        F.col(snapshot).cast("int").alias("_snap"), *cols,
        F.xxhash64(F.col(digest).isNull(), canonical_hex(F.col(digest).cast("string"))).alias("_h"),
        F.coalesce(F.unix_micros(F.col(order).cast("timestamp")), F.lit(-(2**62))).alias("_ts"),
    )
    slim = slim.withColumn("_b", F.pmod(F.xxhash64(F.lit(0), *parts), F.lit(buckets)).cast("int"))
    slim = slim.withColumns({"_k1": F.xxhash64(F.lit(1), *parts), "_k2": F.xxhash64(F.lit(2), *parts)})
    slim = slim.mapInArrow(_combined, ", ".join(f"{n} {t}" for n, t in slim.dtypes))
    # one exchange, by bucket: the last row of a key and snapshot and the bucket's tables are both found where it puts them
    slim = slim.repartition("_b").groupBy("_b", "_snap", *names, "_k1", "_k2").agg(F.max(F.struct("_ts", "_h")).alias("_v")).select("_b", "_snap", *names, "_k1", "_k2", "_v.*")
    fields = [("snapshot_no", pa.int32()), *((n, pa.string()) for n in names), ("change_kind", pa.string())]
    ddl = ", ".join(f"{n} {'int' if t == pa.int32() else 'string'}" for n, t in fields)
    return slim.drop("_ts").groupBy("_b").applyInArrow(_bucket_changes(names, numbers, pa.schema(fields)), ddl)
