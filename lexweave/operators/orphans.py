"""References to records that do not exist: a fixpoint cascade down the foreign-key graph.

References are pre-aggregated to one row per referenced key (map-side combined, so a key that holds a third of all
rows is reduced before any shuffle) and met once with the arrival times of all targets. Records that hold an orphan
reference pass the state on: their children are found by semi-joins, round by round, until no record is added.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import durable

SMALL = 100_000  # rows of a side that is broadcast, by its count


@dataclass(frozen=True)
class References:
    """References of one table. ``rows`` has the columns ref_table, own_1, own_2 (the row's own key), target, k1, k2
    (the referenced key; k2 is '' where the key has one part) and written_at; ``target`` is the table it leads to."""

    rows: DataFrame
    target: str | None = None  # None: read from the rows


@dataclass(frozen=True)
class Targets:
    """Keys of one table: target, k1, k2, arrived_at (any number of rows a key; the earliest counts)."""

    rows: DataFrame


def references(df: DataFrame, ref_table: str, own: tuple[Column, Column], target: str, key: tuple[Column, Column | None], written_at: str) -> References:
    """References read from ``df``. A null or '' part is no reference; a one-part key has None as second part."""
    k1 = key[0].cast("string")
    k2 = F.lit("") if key[1] is None else key[1].cast("string")
    out = df.select(
        F.lit(ref_table).alias("ref_table"), own[0].cast("string").alias("own_1"), own[1].cast("string").alias("own_2"),
        F.lit(target).alias("target"), k1.alias("k1"), k2.alias("k2"), F.col(written_at).alias("written_at"),
    )
    real = (F.col("k1") != "") if key[1] is None else (F.col("k1") != "") & (F.col("k2") != "")
    return References(out.where(real), target)


def targets(df: DataFrame, target: str, key: tuple[Column, Column | None], arrived_at: str) -> Targets:
    k2 = F.lit("") if key[1] is None else key[1].cast("string")
    return Targets(df.select(F.lit(target).alias("target"), key[0].cast("string").alias("k1"), k2.alias("k2"), F.col(arrived_at).alias("arrived_at")))


def _sized(df: DataFrame) -> DataFrame:
    """Broadcast only what has been counted and is small."""
    return F.broadcast(df) if df.count() <= SMALL else df


class OrphanCascade:
    """Direct and inherited orphans of a foreign-key graph.

    Direct: the target is absent, or arrived after the referring row was written (equal times are no case). A target
    without arrival time counts as there; a row without time is an orphan only if the target is absent. Inherited: the
    target is there, but is itself a record with an orphan reference, direct or inherited. Graphs with cycles end too,
    as a record is added once. Empty tables give no rows.
    """

    def __init__(self, refs: list[References], tgts: list[Targets]):
        union = lambda xs: reduce(DataFrame.unionByName, [x.rows for x in xs])
        self._refs, self._raw_targets, self._parents = union(refs), union(tgts), [r.target for r in refs]

    def _arrivals(self) -> DataFrame:
        return self._raw_targets.where(F.col("k1").isNotNull() & F.col("k2").isNotNull()).groupBy("target", "k1", "k2").agg(
            F.min("arrived_at").alias("arrived_at"), F.lit(True).alias("there")
        )

    def _judged(self, *extra: Column) -> DataFrame:
        """One row per reference (and ``extra``) with ``direct``: the earliest referring row decides."""
        names = ["ref_table", "target", "k1", "k2"]
        once = self._refs.groupBy(*names, *extra).agg(F.min("written_at").alias("written_at"))
        late = F.coalesce(F.col("arrived_at") > F.col("written_at"), F.lit(False))
        return once.join(self._arrivals(), ["target", "k1", "k2"], "left").withColumn("direct", F.col("there").isNull() | late)

    def direct(self) -> DataFrame:
        """ref_table, target, k1, k2 of each reference that is an orphan in at least one referring row."""
        return self._judged().where("direct").select("ref_table", "target", "k1", "k2")

    def orphan_records(self) -> DataFrame:
        """The fixpoint: (target, k1, k2) of each record with an orphan reference, and its round (0 = direct)."""
        own = lambda df: df.select(F.col("ref_table").alias("target"), F.col("own_1").alias("k1"), F.coalesce("own_2", F.lit("")).alias("k2")).where(F.col("k1").isNotNull()).distinct()
        known = [t for t in self._parents if t] if all(self._parents) else [r[0] for r in self._refs.select("target").distinct().collect()]  # names of tables
        edges = self._refs.select("ref_table", "own_1", "own_2", "target", "k1", "k2")
        bad = durable(self.direct())
        frontier = durable(own(edges.join(_sized(bad), ["ref_table", "target", "k1", "k2"], "left_semi")).withColumn("round", F.lit(0)))
        every, n = frontier, 0
        while True:
            passing = frontier.where(F.col("target").isin(known))  # records nobody refers to can't pass anything on
            if passing.isEmpty():
                return every
            n += 1
            children = own(edges.join(_sized(passing.select("target", "k1", "k2")), ["target", "k1", "k2"], "left_semi"))
            frontier = durable(children.join(every, ["target", "k1", "k2"], "left_anti").withColumn("round", F.lit(n)))
            every = every.unionByName(frontier)

    def inherited(self) -> DataFrame:
        """ref_table, target, k1, k2 of each reference that isn't direct but leads to an orphaned record."""
        bad = self.orphan_records().select("target", "k1", "k2")  # first, so that the references are written once
        return self._judged().where(~F.col("direct")).join(bad, ["target", "k1", "k2"], "left_semi").select("ref_table", "target", "k1", "k2")

    def report(self) -> DataFrame:
        """ref_table, month (yyyy-MM of the referring row, '' if unknown), orphan_kind, n_references (distinct)."""
        month = F.coalesce(F.date_format("written_at", "yyyy-MM"), F.lit("")).alias("month")
        bad = self.orphan_records().select("target", "k1", "k2", F.lit(True).alias("bad"))
        judged = self._judged(month)
        kind = F.when(F.col("direct"), "direct").when(F.col("bad"), "inherited")
        return (
            judged.join(bad, ["target", "k1", "k2"], "left").withColumn("orphan_kind", kind).where(F.col("orphan_kind").isNotNull())
            .groupBy("ref_table", "month", "orphan_kind").agg(F.count(F.lit(1)).alias("n_references"))
        )
