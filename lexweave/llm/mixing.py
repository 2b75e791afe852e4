"""Mixing sources to target weights by Pfair scheduling.

Each source's documents form one stream, pass after pass, cut into blocks. The whole mix is a number of equal frames; in
each a source has the same number of blocks, as many as it takes to keep them at ``block_tokens`` or less, so blocks never
grow with the data. Block j of a source with k of the P blocks of a frame has weight w = k / P; it is released at slot
floor(j/w) and due at ceil((j+1)/w), and the earliest deadline among the released blocks goes next. Every source is
exactly at its share when a frame ends, so the schedule of one frame is that of all (its state at frame f is f * k), and
inside no source is ever a whole block ahead or behind. Stream positions are two-level prefix sums over hash chunks, with
equal rows counted first, so a source or a document with a third of all rows is spread over many tasks.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BLOCK_TOKENS = 32_768
FRAME = 4096
CHUNK_ROWS = 20_000
RUN = 10_000
MAX_SOURCES = 10_000


@dataclass(frozen=True)
class SourcePlan:
    source: str
    target_share: float
    max_repeats: int
    available: int
    rows: int
    quota: int


def plan_quotas(wanted: list[tuple[str, float, int]], have: dict[str, tuple[int, int]], total: int | None = None) -> list[SourcePlan]:
    """Tokens each source gives. ``have``: tokens and rows by source.

    The quota is the target share of ``total`` (all tokens of the listed sources if None), at most ``max_repeats``
    times what the source has; what capped or missing sources can't give goes to the others in proportion, so that
    the mix reaches ``total`` if the caps let it.
    """
    cap = {s: have.get(s, (0, 0))[0] * max(0, r) for s, _, r in wanted}
    total = sum(have.get(s, (0, 0))[0] for s, _, _ in wanted) if total is None else total
    quota, free, left = {}, {s: w for s, w, _ in wanted if w > 0 and cap[s] > 0}, total
    while free:
        scale = left / sum(free.values())
        full = [s for s, w in free.items() if w * scale >= cap[s]]
        if not full:
            quota |= {s: int(w * scale) for s, w in free.items()}
            break
        for s in full:
            quota[s] = cap[s]
            left -= cap[s]
            del free[s]
    return [SourcePlan(s, w, r, *have.get(s, (0, 0)), quota.get(s, 0)) for s, w, r in wanted]


def schedule(blocks: dict[str, int]) -> Iterator[tuple[str, int, int]]:
    """(source, block, slot) of one frame: earliest deadline first among released blocks."""
    n = sum(blocks.values())
    waiting = []  # by release
    ready = [(-(-n // b), -b, s, 0) for s, b in blocks.items() if b > 0]  # by deadline
    heapq.heapify(ready)
    for slot in range(n):
        while waiting and waiting[0][0] <= slot:
            _, s, j = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(j + 1) * n // blocks[s]), -blocks[s], s, j))
        _, _, s, j = heapq.heappop(ready)
        yield s, j, slot
        if j + 1 < blocks[s]:
            heapq.heappush(waiting, ((j + 1) * n // blocks[s], s, j + 1))


def frames_of(quotas: dict[str, int], block_tokens: int, frame: int = FRAME) -> tuple[int, dict[str, int]]:
    """Number of frames, and the blocks that each source has in every one of them (none above ``block_tokens``)."""
    quotas = {s: q for s, q in quotas.items() if q > 0}
    n = max(1, -(-sum(quotas.values()) // (frame * block_tokens)))
    return n, {s: -(-q // (n * block_tokens)) for s, q in quotas.items()}


class Mix:
    """A mix of ``docs`` by ``targets`` (source, target_share, max_repeats).

    Defined cases: null sources and sources not listed give nothing; a listed source without documents gives nothing
    and its share goes to the others in proportion; null or negative sizes count as 0 tokens; repeated rows are
    documents of their own; repeated targets of one source: the shares add, the least cap holds; null shares or caps
    count as 0; an empty table gives an empty mix; other columns, whatever their names, are not read.
    """

    def __init__(self, docs: DataFrame, targets: DataFrame, *, source: str, doc_id: str, size: str, total: int | None = None, block_tokens: int = BLOCK_TOKENS):
        self.spark = docs.sparkSession
        t = targets.where(F.col("source").isNotNull()).groupBy("source").agg(
            F.sum(F.coalesce("target_share", F.lit(0.0))).alias("w"), F.min(F.coalesce("max_repeats", F.lit(0))).alias("r")
        )
        wanted = [(r["source"], float(r["w"]), int(r["r"])) for r in t.orderBy("source").limit(MAX_SOURCES + 1).collect()]
        if len(wanted) > MAX_SOURCES:
            raise ValueError(f"more than {MAX_SOURCES} sources")
        names = self.spark.createDataFrame([(s,) for s, _, _ in wanted], "source string")
        sized = docs.select(
            F.col(source).alias("source"), F.col(doc_id).alias("doc_id"), F.greatest(F.coalesce(F.col(size).cast("bigint"), F.lit(0)), F.lit(0)).alias("n_tokens")
        )
        self.docs = sized.join(F.broadcast(names), "source", "left_semi")  # at most MAX_SOURCES rows
        sums = self.docs.groupBy("source").agg(F.sum("n_tokens").alias("n"), F.count(F.lit(1)).alias("k")).collect()  # a row a listed source
        self.plan = plan_quotas(wanted, {r["source"]: (r["n"], r["k"]) for r in sums}, total)
        self.frames, self.blocks = frames_of({p.source: p.quota for p in self.plan}, block_tokens)
        self.length = sum(self.blocks.values())

    def _sources(self) -> DataFrame:
        """A row for each source that gives something (at most MAX_SOURCES)."""
        rows = [(p.source, p.max_repeats, p.available, p.quota, max(1, -(-p.rows // CHUNK_ROWS)), self.blocks[p.source]) for p in self.plan if p.quota > 0]
        return self.spark.createDataFrame(rows, "source string, max_repeats int, available bigint, quota bigint, chunks int, blocks bigint")

    def _positions(self) -> DataFrame:
        """source, doc_id, n_tokens, copies and the first copy's position in one pass of its source."""
        once = self.docs.groupBy("source", "doc_id", "n_tokens").agg(F.count(F.lit(1)).alias("n"))
        runs = once.withColumn("run", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("n") - 1) / RUN))))
        runs = runs.withColumn("copies", F.least(F.lit(RUN), F.col("n") - F.col("run") * RUN)).drop("n")
        h = F.xxhash64("source", "doc_id", "n_tokens", F.when(F.col("run") > 0, F.col("run")))
        d = runs.join(F.broadcast(self._sources()), "source").withColumn("h", h).withColumn("chunk", F.pmod("h", "chunks").cast("int"))
        weight = F.col("n_tokens") * F.col("copies")
        sums = d.groupBy("source", "chunk").agg(F.sum(weight).alias("s"))
        before = Window.partitionBy("source").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
        offsets = sums.select("source", "chunk", F.coalesce(F.sum("s").over(before), F.lit(0)).alias("offset"))
        inside = Window.partitionBy("source", "chunk").orderBy("h", "doc_id", "n_tokens", "run").rowsBetween(Window.unboundedPreceding, -1)
        d = d.withColumn("inner", F.coalesce(F.sum(weight).over(inside), F.lit(0)))
        return d.join(offsets, ["source", "chunk"]).withColumn("position", F.col("offset") + F.col("inner"))

    def _used(self) -> DataFrame:
        """One row for each use of a document: up to the quota, to the nearest document."""
        d = self._positions().withColumn("copy", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("copies") - 1)))
        d = d.withColumn("position", F.col("position") + F.col("copy") * F.col("n_tokens"))
        middle = F.col("position") + F.floor(F.col("n_tokens") / 2)
        uses = F.least("max_repeats", F.when(F.col("quota") > middle, F.floor((F.col("quota") - middle - 1) / F.greatest("available", F.lit(1))) + 1).otherwise(0)).cast("int")
        d = d.withColumn("uses", uses).where("uses > 0")
        return d.select(
            "source", "doc_id", "n_tokens", F.explode(F.sequence(F.lit(1), F.col("uses"))).alias("repeat_no"), "position", "available", "quota", "blocks"
        ).withColumn("stream_start", (F.col("repeat_no") - 1) * F.col("available") + F.col("position"))

    def slots(self) -> DataFrame:
        """source, place, slot: the schedule of one frame, of at most FRAME + MAX_SOURCES slots whatever the data."""
        return self.spark.createDataFrame(list(schedule(self.blocks)), "source string, place bigint, slot bigint")

    def rows(self) -> DataFrame:
        """slot, source, doc_id, repeat_no, n_tokens, stream_start; the mix is read by slot, then stream_start."""
        # a use may begin at most half a document beyond the quota: it belongs to the last block
        all_blocks = F.col("blocks") * self.frames
        block = F.least(F.floor(F.col("stream_start") * (all_blocks / F.col("quota"))), all_blocks - 1)
        used = self._used().withColumn("block", block).withColumn("place", F.pmod("block", "blocks")).withColumn("frame", F.floor(F.col("block") / F.col("blocks")))
        out = used.join(F.broadcast(self.slots()), ["source", "place"])
        return out.select((F.col("frame") * self.length + F.col("slot")).alias("slot"), "source", "doc_id", "repeat_no", "n_tokens", "stream_start")

    def shares(self) -> DataFrame:
        """source, target_share, actual_share, n_tokens, n_documents, times_used (the largest) of every listed source."""
        got = self._used().groupBy("source").agg(
            F.sum("n_tokens").alias("n_tokens"), F.count(F.lit(1)).alias("n_documents"), F.max("repeat_no").alias("times_used")
        )
        plan = self.spark.createDataFrame([(p.source, p.target_share) for p in self.plan], "source string, target_share double")
        total = got.agg(F.sum("n_tokens").alias("total"))
        return (
            F.broadcast(plan).join(got, "source", "left").crossJoin(total)  # total is one row
            .select("source", "target_share", F.coalesce(F.try_divide("n_tokens", "total"), F.lit(0.0)).alias("actual_share"), *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_tokens", "n_documents", "times_used")])
        )
