"""Filling fixed-capacity containers: hierarchical residual packing.

Round 0 spreads the items by hash over groups of bounded size and packs each best-fit decreasing. Nearly full containers
are final at once; the others become items of the next round. After best fit a group has at most one container that is
half full or less (two such would have been one), and only such a container can still move. So a round takes along these
movers and, of the others, as many as there are movers, those with most room: each mover needs one place at most, so what
stays behind could have taken none that these cannot take. Every round leaves at most one mover a group, so the number of
groups falls by thousands from round to round, with no bound on how many containers may stay open.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import durable

GROUP_ITEMS = 24_000
SALTS = 256
RUN = 10_000
_SCHEMA = pa.schema(
    [("limit_name", pa.string()), ("capacity", pa.int64()), ("item_id", pa.string()), ("piece_no", pa.int32()), ("piece_start", pa.int64()), ("size", pa.int64()), ("bin", pa.string()), ("fill", pa.int64()), ("head", pa.bool_())]
)
_DDL = "limit_name string, capacity bigint, item_id string, piece_no int, piece_start bigint, size bigint, bin string, fill bigint, head boolean"
_MOVED = pa.schema([("limit_name", pa.string()), ("capacity", pa.int64()), ("bin", pa.string()), ("target", pa.string()), ("fill", pa.int64()), ("head", pa.bool_())])
_MOVED_DDL = "limit_name string, capacity bigint, bin string, target string, fill bigint, head boolean"

def best_fit(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Bin number of each item by best fit in decreasing order (ties by position); every size is at most capacity."""
    order = np.lexsort((np.arange(len(sizes)), -sizes))
    out = np.empty(len(sizes), np.int64)
    free: list[int] = []  # residuals, sorted; bins of equal residual are interchangeable
    bins: dict[int, list[int]] = {}
    n = 0
    for i, s in zip(order.tolist(), sizes[order].tolist()):
        at = bisect_left(free, s)
        if at < len(free):
            r = free.pop(at)
            b = bins[r].pop()
        else:
            r, b, n = capacity, n, n + 1
        out[i] = b
        if r > s:
            insort(free, r - s)
            bins.setdefault(r - s, []).append(b)
    return out


def _heads(bin_of: np.ndarray) -> np.ndarray:
    """One row of each container."""
    head = np.zeros(len(bin_of), bool)
    head[np.unique(bin_of, return_index=True)[1]] = True
    return head


def _pack_items(t: pa.Table) -> pa.Table:
    grp, capacity = t.column("grp")[0].as_py(), t.column("capacity")[0].as_py()
    size = t.column("size").to_numpy()
    ids = t.column("item_id").to_numpy(zero_copy_only=False).astype(str)
    order = np.lexsort((t.column("piece_start").to_numpy(), ids))  # the same result in whatever order rows come
    bin_of = np.empty(len(size), np.int64)
    bin_of[order] = best_fit(size[order], capacity)
    fill = np.bincount(bin_of, weights=size).astype(np.int64)
    label = np.char.add(f"0-{grp}-", np.arange(len(fill)).astype(str))
    cols = [t.column(n) for n in _SCHEMA.names[:6]]
    cols += [pa.array(label[bin_of].tolist(), pa.string()), pa.array(fill[bin_of]), pa.array(_heads(bin_of))]
    return pa.Table.from_arrays(cols, schema=_SCHEMA)


def _pack_bins(round_no: int):
    def run(t: pa.Table) -> pa.Table:
        grp, capacity = t.column("grp")[0].as_py(), t.column("capacity")[0].as_py()
        fill = t.column("fill").to_numpy()
        order = np.argsort(t.column("bin").to_numpy(zero_copy_only=False).astype(str), kind="stable")
        bin_of = np.empty(len(fill), np.int64)
        bin_of[order] = best_fit(fill[order], capacity)
        full = np.bincount(bin_of, weights=fill).astype(np.int64)
        label = np.char.add(f"{round_no}-{grp}-", np.arange(len(full)).astype(str))
        cols = [t.column(n) for n in ("limit_name", "capacity", "bin")]
        cols += [pa.array(label[bin_of].tolist(), pa.string()), pa.array(full[bin_of]), pa.array(_heads(bin_of))]
        return pa.Table.from_arrays(cols, schema=_MOVED)

    return run


def _open(bins: DataFrame, nearly_full: float) -> tuple[DataFrame, int]:
    """The containers (limit_name, capacity, bin, fill) that go on, and how many at most.

    Movers are half full or less; of the others those that have room for the least mover, and by thousandths of the
    capacity no more than the fullest step needed to have as many as movers.
    """
    step = F.floor(F.col("fill") * 1000 / F.col("capacity")).cast("int")
    mover = F.col("fill") * 2 <= F.col("capacity")
    counts = bins.where(F.col("fill") < nearly_full * F.col("capacity")).groupBy("limit_name", mover.alias("mover"), step.alias("step")).agg(
        F.count(F.lit(1)).alias("n"), F.min("fill").alias("least")
    )
    rows = counts.collect()  # at most 1,000 rows a limit
    keep, total = F.lit(False), 0
    for name in {r["limit_name"] for r in rows}:
        movers = [r for r in rows if r["limit_name"] == name and r["mover"]]
        n, least = sum(r["n"] for r in movers), min((r["least"] for r in movers), default=0)
        if not n:
            continue
        have, top = 0, -1
        for r in sorted((r for r in rows if r["limit_name"] == name and not r["mover"]), key=lambda r: r["step"]):
            if have < n:
                have, top = have + r["n"], r["step"]
        if n > 1 or have:
            keep |= (F.col("limit_name") == name) & (mover | ((step <= top) & (F.col("capacity") - F.col("fill") >= least)))
            total = max(total, n + have)
    return bins.where(keep & (F.col("fill") < nearly_full * F.col("capacity"))), total


def _begins(data: Column, at: Column) -> Column:
    """``at`` moved back to the beginning of a UTF-8 character."""
    inside = lambda i: F.substring(F.hex(F.substring(data, i + 1, F.lit(1))), 1, 1).isin("8", "9", "A", "B")
    return F.when(~inside(at), at).when(~inside(at - 1), at - 1).when(~inside(at - 2), at - 2).otherwise(at - 3)


def _cuts(whole: Column, capacity: int, data: Column | None) -> Column:
    """Where the pieces of an item larger than ``capacity`` begin."""
    plain = F.transform(F.sequence(F.lit(0).cast("bigint"), F.floor((whole - 1) / capacity)), lambda k: k * capacity)
    if data is None or capacity < 8:
        return plain
    step = capacity - 3  # a cut moves back by three bytes at most
    cut = F.transform(F.sequence(F.lit(0).cast("bigint"), F.floor((whole - 1) / step)), lambda k: _begins(data, (k * step).cast("int")).cast("bigint"))
    return F.when(F.octet_length(data) == whole, cut).otherwise(plain)


def pack(
    df: DataFrame, limits: list[tuple[str, int]], *, item_id: str, size: str, text: str | None = None, nearly_full: float = 0.995, group_items: int = GROUP_ITEMS
) -> DataFrame:
    """An assignment of all items to containers, for each (name, capacity) of ``limits``.

    Returns limit_name, container_id, item_id, piece_no (from 1), piece_start, size, container_fill and capacity. Only
    items larger than the capacity are split; their pieces fill containers of their own, the last is packed as an item
    unless it nearly fills one. ``piece_start`` counts tokens. With ``text`` and sizes in UTF-8 bytes (a byte-level tokenizer) a cut lies
    at the last beginning of a character that is in reach, so pieces are texts themselves.

    Defined cases: null and negative sizes count as 0; an item of size 0 lies in some container; repeated rows are
    items of their own; a null id is kept as null; ties in size go by id; a text whose bytes are not its size is cut by
    token numbers alone; an empty table gives no rows; other columns, whatever their names, are not read.
    """
    if not limits or any(c < 1 for _, c in limits) or len({n for n, _ in limits}) < len(limits):
        raise ValueError("limits need at least one capacity of 1 or more and names of their own")
    whole = F.greatest(F.coalesce(F.col(size).cast("bigint"), F.lit(0)), F.lit(0))
    # the bytes are a column of their own, so that they are made once a text, not once a cut
    least = min(c for _, c in limits)
    sized = df.select(F.col(item_id).cast("string").alias("item_id"), whole.alias("whole"), *([F.when(whole > least, F.col(text).cast("binary")).alias("data")] if text else []))
    whole, data = F.col("whole"), F.col("data") if text else None
    cuts = F.array(*[F.struct(F.lit(n).alias("n"), F.lit(int(c)).cast("bigint").alias("c"), F.when(whole > c, _cuts(whole, int(c), data)).alias("cuts")) for n, c in limits])
    base = sized.select("item_id", "whole", F.when(whole > least, cuts).alias("cuts"), F.pmod(F.spark_partition_id(), F.lit(SALTS)).alias("salt"))
    # equal rows are counted before they move, and numbered; a key repeated without bound lies in as many parts as there are salts
    counted = base.groupBy("item_id", "whole", "cuts", "salt").agg(F.count(F.lit(1)).alias("n"))
    runs = counted.withColumn("run", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("n") - 1) / RUN)))).withColumn("last", F.least("n", (F.col("run") + 1) * RUN))
    one = runs.withColumn("copy", F.explode(F.sequence(F.col("run") * RUN + 1, F.col("last"))))  # in runs, so that no array holds them all
    plain = F.array(*[F.struct(F.lit(n).alias("n"), F.lit(int(c)).cast("bigint").alias("c"), F.lit(None).cast("array<bigint>").alias("cuts")) for n, c in limits])
    each = one.select("item_id", "whole", "salt", "copy", F.explode(F.coalesce("cuts", plain)).alias("l")).select("item_id", "whole", "salt", "copy", F.col("l.n").alias("limit_name"), F.col("l.c").alias("capacity"), "l.cuts")
    key = F.concat_ws("-", F.when(F.col("item_id").isNull(), "n").otherwise(F.concat(F.lit("i"), "item_id")), "whole", "salt", "copy")
    ends = lambda i: F.coalesce(F.get("cuts", i + 1), F.col("whole"))
    parts = F.coalesce(F.transform("cuts", lambda x, i: F.struct((i + 1).alias("no"), x.alias("start"), (ends(i) - x).alias("size"))), F.array(F.struct(F.lit(1).alias("no"), F.lit(0).cast("bigint").alias("start"), F.col("whole").alias("size"))))
    which = F.when(F.col("copy") > 1, F.hash("salt", "copy")).otherwise(0)
    pieces = each.select(
        "limit_name", "capacity", "item_id", key.alias("key"), which.alias("which"), "whole", F.explode(parts).alias("p"), F.coalesce(F.size("cuts"), F.lit(1)).alias("pieces")
    ).select("limit_name", "capacity", "item_id", "key", "which", "whole", "pieces", F.col("p.no").alias("piece_no"), F.col("p.start").alias("piece_start"), F.col("p.size").alias("size"))
    filled = (F.col("pieces") > 1) & ((F.col("piece_no") < F.col("pieces")) | (F.col("size") >= nearly_full * F.col("capacity")))
    done = [pieces.where(filled).select("limit_name", "capacity", "item_id", "piece_no", "piece_start", "size", F.concat_ws("-", F.lit("full"), "key", "piece_no").alias("bin"), F.col("size").alias("fill"))]
    groups = lambda n: max(1, -(-n // group_items))
    # the last piece of a split item is an item like others
    n0 = groups(df.count())
    items = pieces.where(~filled).select(
        "limit_name", "capacity", "item_id", "piece_no", "piece_start", "size", F.pmod(F.xxhash64("item_id", "whole", "piece_no", "which"), F.lit(n0)).cast("int").alias("grp")
    )
    packed = items.groupBy("limit_name", "grp").applyInArrow(_pack_items, _DDL)
    if n0 == 1:
        done.append(packed.drop("head"))
    else:
        packed = durable(packed)
        moved = _merge(packed.where("head").select("limit_name", "capacity", "bin", "fill"), nearly_full, groups)
        if moved is None:
            done.append(packed.drop("head"))
        else:
            is_open = F.col("fill") < nearly_full * F.col("capacity")
            done.append(packed.where(~is_open).drop("head"))
            again = packed.where(is_open).drop("head").join(moved.withColumnRenamed("fill", "new_fill").hint("merge"), ["limit_name", "bin"], "left")
            done.append(again.withColumn("bin", F.coalesce("target", "bin")).withColumn("fill", F.coalesce("new_fill", "fill")).drop("target", "new_fill"))
    out = reduce(DataFrame.unionByName, done)
    return out.select("limit_name", F.col("bin").alias("container_id"), "item_id", "piece_no", "piece_start", "size", F.col("fill").alias("container_fill"), "capacity")


def _merge(bins: DataFrame, nearly_full: float, groups) -> DataFrame | None:
    """Rounds of best fit over underfull containers: (limit_name, bin, target, fill) of those that went on."""
    moved, round_no, before = None, 0, None
    while True:
        bins, n = _open(bins, nearly_full)
        if not n or n == before:
            return moved
        round_no, k, before = round_no + 1, groups(n), n
        grp = F.pmod(F.xxhash64("bin", F.lit(round_no)), F.lit(k)).cast("int").alias("grp")
        got = durable(bins.select("limit_name", "capacity", "bin", "fill", grp).groupBy("limit_name", "grp").applyInArrow(_pack_bins(round_no), _MOVED_DDL))
        step = got.select("limit_name", "bin", "target", "fill")
        if moved is None:
            moved = step
        else:  # what has moved before moves on with its container
            on = step.select("limit_name", F.col("bin").alias("target"), F.col("target").alias("t2"), F.col("fill").alias("f2"))
            moved = durable(moved.join(on, ["limit_name", "target"], "left").select("limit_name", "bin", F.coalesce("t2", "target").alias("target"), F.coalesce("f2", "fill").alias("fill")))
        if k == 1:
            return moved
        bins = got.where("head").select("limit_name", "capacity", F.col("target").alias("bin"), "fill")


def piece_texts(df: DataFrame, packed: DataFrame, *, item_id: str, text: str) -> DataFrame:
    """``packed`` with the text of each piece of a split item (``piece``), cut from its bytes; items that are not split are left out.

    Only the texts of split items move. A character that a cut by token numbers alone divides comes out as U+FFFD. Rows that repeat an id with another text give pieces of each of the texts.
    """
    split = packed.join(packed.where("piece_no > 1").select("item_id").distinct(), "item_id", "left_semi")
    texts = df.select(F.col(item_id).cast("string").alias("item_id"), F.col(text).cast("binary").alias("_b")).join(split.select("item_id").distinct(), "item_id", "left_semi").distinct()
    return split.join(texts, "item_id").withColumn("piece", F.make_valid_utf8(F.substring("_b", (F.col("piece_start") + 1).cast("int"), F.col("size").cast("int")).cast("string"))).drop("_b")
