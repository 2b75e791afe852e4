"""Deduplicating new batches against all history: a persisted inverted file of vector cells with full vectors.

The vector of a record has 32 text places (the least hash of its 8-grams under 32 orders, so two records agree in a place
as often as their sets of 8-grams overlap) and its identities (court with case number, court with day, provider with
record id, and the number alone between records with and without court). Its distance is the number of places that
differ. The vector is cut into cells: 8 text cells of four places, one cell for each identity; court with day is joined
with one text place at a time, as a court decides many cases a day. Cells are stored as an inverted file below a
named shared folder, and the full vectors with the records; new records are appended.

A query probes its own cells. The bound: a stored vector that shares no cell differs in a place of each of the 8 text
cells, so it is at a distance of 8 or more in the text and in every identity. So every record within a distance of 7 is
met, and what lies farther is met with a probability that grows with its nearness (README). There are as many cells as
there are distinct values, so their size doesn't follow the size of the history, and nothing is fitted.
What is met is tested by its full vector and reranked exactly on whole texts.
"""

from __future__ import annotations

import uuid
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import durable, stage_path
from .charforms import code_points, normalize_array, normalized, slices
from .splitting import _last

GRAM = 8
PLACES, BAND = 32, 4
DAY_PLACES = 3
NEAR = 4  # places that a candidate must share: a tenth of the 8-grams of both
PARTS = 8  # folders of the stored tables, by hash
_U = np.uint64
_ORDERS = np.random.default_rng(8).integers(1, 2**31, PLACES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


# --- fields, as they are written in fact -------------------------------------------------------------------------


def _plain(c: Column) -> Column:
    """Without white space; of a field already in its consistent form."""
    return F.regexp_replace(c, r"(?U)\s+", "")


def canonical_court(c: Column) -> Column:
    """Without division, spaces and short forms; null or '' gives null."""
    x = F.regexp_replace(_plain(c), r"(제?\d+[가-힣]{0,3}부|[가-힣]{2}\d+단독|제?\d+단독)$", "")
    x = F.regexp_replace(F.regexp_replace(x, "지법", "지방법원"), "고법", "고등법원")
    return F.when(x != "", x)


def case_numbers(c: Column) -> Column:
    """All case numbers in a text as year, kind and serial without leading zeros, e.g. 2019노593."""
    clean = F.regexp_replace(_plain(c), r"[()\[\]\-.제]", "")
    found = F.regexp_extract_all(clean, F.lit(r"(\d{2,4}[가-힣]{1,3}\d+)"), 1)
    year = lambda x: F.regexp_extract(x, r"^(\d+)", 1)

    def one(x: Column) -> Column:
        y = year(x)
        full = F.when(F.length(y) == 2, F.concat(F.when(y < "50", "20").otherwise("19"), y)).otherwise(y)
        return F.concat(full, F.regexp_extract(x, r"^\d+([가-힣]+)", 1), F.regexp_replace(F.regexp_extract(x, r"(\d+)$", 1), "^0+", ""))

    return F.coalesce(F.array_distinct(F.transform(found, one)), F.array().cast("array<string>"))


def _any_order(number: Column) -> Column:
    serial = F.regexp_extract(number, r"(\d+)$", 1)
    return F.concat(F.regexp_extract(number, r"^(\d+[가-힣]+)", 1), F.array_join(F.array_sort(F.split(serial, "")), ""))


def _hash(kind: str, *parts: Column) -> Column:
    """Null if a part is."""
    return F.when(reduce(lambda a, b: a & b, [p.isNotNull() for p in parts]), F.xxhash64(F.lit(kind), *parts))


def with_identities(df: DataFrame) -> DataFrame:
    """Adds _court, _numbers, _day and _record (provider with the digits of the record id) as they are in fact."""
    names = ("court", "case_number", "provider_record_id")
    d = df.withColumns({c: normalized(F.col(c).cast("string")) for c in names})
    rid = F.regexp_extract(_plain(F.col("provider_record_id")), r"(\d{3,})", 1)
    return d.withColumns(
        {
            "_court": canonical_court(F.col("court")),
            "_numbers": case_numbers(F.col("case_number")),
            "_day": F.col("decision_date").cast("string"),
            "_record": F.when((F.col("provider") != "") & (rid != ""), F.concat_ws("\x1f", "provider", rid)),
        }
    )


# --- texts ----------------------------------------------------------------------------------------------------------


_ALNUM: np.ndarray | None = None


def _alnum() -> np.ndarray:
    """Letters and digits, lower-cased; 0 for all else."""
    global _ALNUM
    if _ALNUM is None:
        t = np.zeros(0x110000, np.uint32)
        for cp in range(0x20000):
            ch = chr(cp)
            if ch.isalnum():
                low = ch.lower()
                t[cp] = ord(low) if len(low) == 1 else cp
        t[0x20000:0x32000] = np.arange(0x20000, 0x32000)
        _ALNUM = t
    return _ALNUM


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all 8-grams of letters and digits (tags, entities, marks and spaces left out), the row of each, and
    a digest of each whole text. A shorter text has one gram of what it has."""
    cp, bounds = code_points(normalize_array(texts))
    n, rows = len(cp), len(bounds) - 1
    digest = np.zeros(rows, np.uint64)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), digest
    start = np.repeat(bounds[:-1], np.diff(bounds))
    nxt = np.append(cp[1:], np.uint32(0))
    opened = (cp == 60) & (((nxt >= 65) & (nxt <= 90)) | ((nxt >= 97) & (nxt <= 122)) | (nxt == 47))
    last_open, last_shut = _last(opened), np.concatenate([[-1], _last(cp == 62)[:-1]])
    letters = _alnum()[cp]
    letters[(last_open >= start) & (last_open > last_shut)] = 0  # in a tag
    amp = np.flatnonzero(cp == 38)
    for name in ("&nbsp;", "&amp;", "&lt;", "&gt;", "&quot;"):
        at = amp[amp + len(name) <= n]
        for i, ch in enumerate(name):
            at = at[cp[at + i] == ord(ch)]
        for i in range(len(name)):
            letters[at + i] = 0
    keep = np.flatnonzero(letters)
    x = letters[keep].astype(np.uint64)
    row = np.searchsorted(bounds, keep, "right") - 1
    first = np.searchsorted(row, np.arange(rows))
    place = (np.arange(len(x)) - first[row]).astype(np.uint64)
    with np.errstate(over="ignore"):
        np.add.at(digest, row, _mix((x << _U(32)) + place + _U(1)))
        h = x.copy()
        for j in range(1, GRAM):  # at a text's end what is missing counts as 0
            step = np.zeros(len(x), np.uint64)
            step[:-j or None] = np.where(row[j:] == row[:-j], x[j:], _U(0))
            h = h * _U(0x9E3779B97F4A7C15) + step
        h = _mix(h)
    whole = np.ones(len(x), bool)
    m = GRAM - 1
    whole[-m:] = False
    whole[:-m] = row[m:] == row[:-m]
    whole |= np.isin(np.arange(len(x)), first[(np.diff(np.append(first, len(x))) > 0) & (np.diff(np.append(first, len(x))) < GRAM)])
    return h[whole], row[whole], digest


def signatures(h: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """The 32 text places of each row (without a gram: all 0), and which rows have grams."""
    out = np.zeros((rows, PLACES), np.uint32)
    start = np.searchsorted(row, np.arange(rows))
    has = np.diff(np.append(start, len(row))) > 0
    if has.any():
        low = (h >> _U(32)).astype(np.uint32) ^ h.astype(np.uint32)
        at = start[has]
        with np.errstate(over="ignore"):
            for k in range(PLACES):
                x = low * _ORDERS[k]
                x ^= x >> np.uint32(15)
                out[has, k] = np.minimum.reduceat(x * np.uint32(0x2C1B3C6D), at)
    return out, has


_TEXT = "digest bigint, n_grams int, s0 bigint, s1 bigint, s2 bigint, s3 bigint, bands array<bigint>, days array<int>"


def _vectors(batches):
    """Of each text: a digest, its number of 8-grams, the places at 8 bits each (four words), its text cells, the places for days."""
    for b in (part for whole in batches for part in slices(whole, "text")):
        h, row, digest = grams(b.column("text"))
        n = len(b)
        places, has = signatures(h, row, n)
        mixed = _mix(places.astype(np.uint64))
        low = (mixed & _U(0xFF)).reshape(n, 4, 8)
        words = (low << (_U(8) * np.arange(8, dtype=np.uint64))).sum(2, dtype=np.uint64).view(np.int64)
        bands = np.zeros((n, PLACES // BAND), np.uint64)
        with np.errstate(over="ignore"):
            for i in range(BAND):
                bands = _mix(bands * _U(0x9E3779B97F4A7C15) + mixed[:, i::BAND] + np.arange(PLACES // BAND, dtype=np.uint64)[None])
        lists = lambda x, width, kind: pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(has * width)]), pa.int32()), pa.array(x[has].ravel(), kind))
        count = np.bincount(row, minlength=n)
        cols = [b.column(c) for c in b.schema.names] + [pa.array(digest.view(np.int64)), pa.array(count, pa.int32()), *(pa.array(words[:, i]) for i in range(4))]
        cols += [lists(bands.view(np.int64), PLACES // BAND, pa.int64()), lists(places[:, :DAY_PLACES].view(np.int32), DAY_PLACES, pa.int32())]
        yield pa.RecordBatch.from_arrays(cols, names=[*b.schema.names, *(f.split()[0] for f in _TEXT.split(", "))])


def shared_places(*words: tuple[Column, Column]) -> Column:
    """How many bytes of the paired words agree."""

    def one(a: Column, b: Column) -> Column:
        x = a.bitwiseXOR(b)
        for k in (4, 2, 1):
            x = x.bitwiseOR(F.shiftrightunsigned(x, k))
        return 8 - F.bit_count(x.bitwiseAND(F.lit(0x0101010101010101)))

    return reduce(lambda x, y: x + y, [one(a, b) for a, b in words])


def _overlaps(batches):
    """Of each pair: share of the shorter text's grams in the other, and grams of each that the other lacks."""
    for b in (part for whole in batches for part in slices(whole, "text_a", "text_b")):
        ga, ra, _ = grams(b.column("text_a"))
        gb, rb, _ = grams(b.column("text_b"))
        fa, fb = np.searchsorted(ra, np.arange(len(b) + 1)), np.searchsorted(rb, np.arange(len(b) + 1))
        share, only_a, only_b = [], [], []
        for i in range(len(b)):
            x, y = np.unique(ga[fa[i] : fa[i + 1]]), np.unique(gb[fb[i] : fb[i + 1]])
            both = len(np.intersect1d(x, y, assume_unique=True))
            share.append(both / min(len(x), len(y)) if len(x) and len(y) else 0.0)
            only_a.append(len(x) - both)
            only_b.append(len(y) - both)
        cols = [b.column(c) for c in ("a", "b", "same", "swapped", "beside")] + [pa.array(share, pa.float64()), pa.array(only_a, pa.int32()), pa.array(only_b, pa.int32())]
        yield pa.RecordBatch.from_arrays(cols, names=["a", "b", "same", "swapped", "beside", "share", "only_a", "only_b"])


_WORDS = ["s0", "s1", "s2", "s3"]
_CELLS = "cell bigint, rid bigint, batch_no int, append string, block int"
SMALL = 100_000  # rows of a side that is broadcast, by its count
_FIELDS = "id string, batch_no int, court string, numbers array<string>, day string, record string, text string"
_RECORDS = f"{_FIELDS}, {_TEXT}, append string, part int"


def _folder(key: str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(PARTS)).cast("int")


def _cells_of(d: DataFrame, stored: bool) -> DataFrame:
    """An entry for each cell of each record: those it is stored in, or those it probes.

    The two differ only where a record has no court: its number alone meets records with a court and without.
    """
    court, none = F.col("court"), F.array().cast("array<bigint>")
    by_number = F.transform("numbers", lambda n: _hash("n", court, _any_order(n)))
    alone = lambda kind: F.transform("numbers", lambda n: F.xxhash64(F.lit(kind), _any_order(n)))
    if stored:
        loose = F.when(court.isNull(), alone("without")).otherwise(alone("with"))
    else:
        loose = F.when(court.isNull(), F.concat(alone("without"), alone("with"))).otherwise(alone("without"))
    by_day = F.transform("days", lambda x, i: _hash("d", court, F.col("day"), i, x))
    text = F.transform("bands", lambda x: F.xxhash64(F.lit("t"), x))
    record = F.array(_hash("r", F.col("record")))
    cells = F.array_distinct(F.array_compact(F.concat(*[F.coalesce(x, none) for x in (by_number, loose, by_day, text, record)])))
    return d.where("n_grams > 0").select(F.explode(cells).alias("cell"), _rid("id").alias("rid"), "batch_no", "first")


def _rid(c: str) -> Column:
    """Records go by a hash of their id in the cells; two that share one are only compared once more than needed."""
    return F.xxhash64(c)


def _sized(df: DataFrame) -> DataFrame:
    """Broadcast only what has been counted and is small."""
    return F.broadcast(df) if df.count() <= SMALL else df


class HistoryIndex:
    """The persisted index of everything accepted, below ``path`` (a folder all executors share).

    ``records``: fields and texts as compared, in PARTS folders by hash of id. ``cells``: the inverted file, in PARTS
    folders by hash of cell. ``done``: the appends that are whole; what a lost run has left is not read. A later session
    goes on with ``HistoryIndex(spark, path)``; ``match`` reads the folders of cells that its batch probes and the folders of
    records that it has met there, never the tables the history came from.

    Record tables have id, batch_no, provider, provider_record_id, court, case_number, decision_date, source_text.
    Defined cases: null or '' fields give no identity (such records are met by their text); null and empty texts, and
    texts without letters or digits, match nothing; of exact copies (court and text) one stands in the text cells for
    all, each is known by its own identities, and all come back as members of its class; ids are unique, rows with null
    id are left out; an empty history or batch gives no pairs; other columns are not read.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def appends(self) -> list[str]:
        """The names of all whole appends, one for each batch that was stored."""
        try:
            return [r["append"] for r in self.spark.read.schema("append string").parquet(f"{self.path}/done").collect()]
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return []

    def _read(self, name: str, appends: list[str]) -> DataFrame:
        schema = _RECORDS if name == "records" else _CELLS
        if not appends:
            return self.spark.createDataFrame([], schema)
        at = f"{self.path}/{name}"
        return self.spark.read.schema(schema).option("basePath", at).parquet(*[f"{at}/append={a}" for a in appends])

    def append(self, records: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Stores a batch; returns its records as stored, and its exact copies (a, b): b is the same as a, which came earlier."""
        d = with_identities(records.where(F.col("id").isNotNull())).select(
            "id", F.col("batch_no").cast("int").alias("batch_no"), F.col("_court").alias("court"), F.col("_numbers").alias("numbers"),
            F.col("_day").alias("day"), F.col("_record").alias("record"), F.coalesce("source_text", F.lit("")).alias("text"),
        )
        old, name = self.appends(), uuid.uuid4().hex
        d.mapInArrow(_vectors, f"{_FIELDS}, {_TEXT}").withColumn("part", _folder("id")).write.partitionBy("part").parquet(f"{self.path}/records/append={name}")
        fresh = self._read("records", [name])
        # of equal courts and texts the first stands for all; they are counted before rows move
        keys = ["court", "digest", "batch_no", "id"]
        both = self._read("records", old).select(*keys, F.lit(0).alias("new")).unionByName(fresh.select(*keys, F.lit(1).alias("new"))).where("digest != 0")
        first = both.groupBy("court", "digest").agg(F.min_by("id", F.struct("new", "batch_no", "id")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
        mine = fresh.select("id", F.col("court").alias("c"), F.col("digest").alias("d"))
        copies = mine.join(first, (F.col("d") == F.col("digest")) & F.col("c").eqNullSafe(F.col("court"))).where(F.col("id") != F.col("first"))
        copies = durable(copies.select(F.col("first").alias("a"), F.col("id").alias("b")))
        self._entries(fresh, copies, True).withColumn("block", _folder("cell")).write.partitionBy("block").parquet(f"{self.path}/cells/append={name}")
        self.spark.createDataFrame([(name,)], "append string").coalesce(1).write.mode("append").parquet(f"{self.path}/done")
        return fresh, copies

    def _entries(self, records: DataFrame, copies: DataFrame, stored: bool) -> DataFrame:
        """Entries (cell, rid, batch_no) of records; copies of one record have one entry a cell between them."""
        of_first = _sized(copies.select(F.col("b").alias("id"), F.col("a").alias("first")))
        all_of = _cells_of(records.drop("text").join(of_first, "id", "left"), stored)
        one = all_of.where(F.col("first").isNotNull()).groupBy("cell", "first").agg(F.min(F.struct("batch_no", "rid")).alias("e"))
        return all_of.where(F.col("first").isNull()).select("cell", "rid", "batch_no").unionByName(one.select("cell", "e.rid", "e.batch_no"))

    def candidates(self, batch: DataFrame, copies: DataFrame) -> DataFrame:
        """(a, b) that share a cell and NEAR text places; b of ``batch`` (stored records), a of an earlier batch or the same one."""
        probes = durable(self._entries(batch, copies, False).select("cell", F.col("rid").alias("q_rid"), F.col("batch_no").alias("q_batch_no")))
        blocks = [r["block"] for r in probes.select(_folder("cell").alias("block")).distinct().collect()]  # at most PARTS
        earlier = (F.col("batch_no") < F.col("q_batch_no")) | ((F.col("batch_no") == F.col("q_batch_no")) & (F.col("rid") < F.col("q_rid")))
        stored = self._read("cells", self.appends())
        stored = stored.where(F.col("block").isin(blocks)) if len(blocks) < PARTS else stored
        met = stored.join(probes, "cell").where(earlier)
        met = durable(met.select("rid", "q_rid").distinct())
        # the full vectors of what was met
        rids = met.select("rid").union(met.select("q_rid")).distinct()
        vectors = durable(self._read("records", self.appends()).select("id", _rid("id").alias("rid"), "court", *_WORDS).join(rids, "rid", "left_semi"))
        side = lambda x, key: vectors.select(F.col("id").alias(x), F.col("rid").alias(key), F.col("court").alias(f"court_{x}"), *[F.col(w).alias(f"{w}_{x}") for w in _WORDS])
        near = met.join(side("a", "rid"), "rid").join(side("b", "q_rid"), "q_rid").where(
            (F.col("court_a").isNull() | F.col("court_b").isNull() | (F.col("court_a") == F.col("court_b")))
            & (shared_places(*[(F.col(f"{w}_a"), F.col(f"{w}_b")) for w in _WORDS]) >= NEAR)
        )
        return near.select("a", "b")

    def rerank(self, candidates: DataFrame) -> DataFrame:
        """(a, b) that record the same decision, judged on whole texts.

        The courts agree where both are known. With a case number in common the shorter text must be in the other for
        the greater part (0.6 of its 8-grams), with the digits of the serial in another order nearly whole (0.8), with
        any other number whole but for slips (0.9); neighbouring serials are parallel cases unless both texts are equal.
        """
        c = durable(candidates)
        ids = c.select(F.col("a").alias("id")).union(c.select("b")).distinct().withColumn("part", _folder("id"))
        parts = [r["part"] for r in ids.select("part").distinct().collect()]  # at most PARTS
        stored = self._read("records", self.appends())
        needed = durable((stored.where(F.col("part").isin(parts)) if len(parts) < PARTS else stored).select("id", "numbers", "text").join(ids.select("id"), "id", "left_semi"))
        side = lambda x: needed.select(F.col("id").alias(x), F.col("numbers").alias(f"numbers_{x}"), F.col("text").alias(f"text_{x}"))
        same = F.arrays_overlap("numbers_a", "numbers_b")
        digits = lambda c: F.transform(c, _any_order)
        serial = lambda x: F.regexp_extract(x, r"(\d+)$", 1).try_cast("double")
        kind = lambda x: F.regexp_extract(x, r"^(\d+[가-힣]+)", 1)
        beside = F.exists("numbers_a", lambda x: F.exists("numbers_b", lambda y: (kind(x) == kind(y)) & (F.abs(serial(x) - serial(y)) == 1)))
        both = c.join(side("a"), "a").join(side("b"), "b").select(
            "a", "b", same.alias("same"), F.arrays_overlap(digits("numbers_a"), digits("numbers_b")).alias("swapped"), (beside & ~same).alias("beside"), "text_a", "text_b"
        )
        got = both.mapInArrow(_overlaps, "a string, b string, same boolean, swapped boolean, beside boolean, share double, only_a int, only_b int")
        slips = F.least("only_a", "only_b") <= 2 * GRAM  # one text has nothing of its own but a slip
        ok = F.when(F.col("beside"), (F.col("share") >= 0.9) & (F.greatest("only_a", "only_b") <= GRAM)).when(F.col("same"), F.col("share") >= 0.6)
        return got.where(ok.when(F.col("swapped"), F.col("share") >= 0.8).otherwise((F.col("share") >= 0.9) & slips)).select("a", "b")

    def match(self, batch: DataFrame) -> DataFrame:
        """Appends ``batch`` and returns (a, b): b of the batch repeats a, which was accepted before or comes in the same batch.

        Exact copies are linked to the first of them only; ``groups`` closes the chains.
        """
        fresh, copies = self.append(batch)
        return durable(self.rerank(self.candidates(fresh, copies)).union(copies).distinct())


def groups(edges: DataFrame) -> DataFrame:
    """(id, group): the least id that each record of ``edges`` (a, b) reaches.

    Every record takes the least label among itself and its neighbours, and labels jump to their own labels, so a
    chain of n takes about log n rounds.
    """
    both = durable(edges.union(edges.select("b", "a")).toDF("x", "y").distinct())
    label = durable(both.groupBy("x").agg(F.least(F.min("y"), F.min("x")).alias("l")))
    while True:
        best = both.join(label.withColumnRenamed("x", "y"), "y").groupBy("x").agg(F.min("l").alias("m"))
        new = label.join(best, "x", "left").select("x", F.least("l", F.coalesce("m", "l")).alias("n"), F.col("l").alias("old"))
        jump = label.select(F.col("x").alias("n"), F.col("l").alias("nn"))
        new = durable(new.join(jump, "n", "left").select("x", F.least("n", F.coalesce("nn", "n")).alias("l"), "old"))
        if new.where(F.col("l") != F.col("old")).isEmpty():
            return new.select(F.col("x").alias("id"), F.col("l").alias("group"))
        label = new.drop("old")


def repeated_decisions(records: DataFrame, path: str | None = None) -> DataFrame:
    """(id_a, id_b), id_a < id_b: all pairs of records of the same decision, of which at least one is in a batch > 0.

    Batch 0 becomes the index (at ``path``, by default a fresh folder in the shared one); the later batches are appended
    and matched against it and one another in order of arrival. Classes come from ``classes``, which is the smaller result;
    the pairs of a class are written out only here.
    """
    g = classes(records, path)
    left = g.select("group", F.col("id").alias("id_a"), F.col("batch_no").alias("n_a"))
    right = g.select("group", F.col("id").alias("id_b"), F.col("batch_no").alias("n_b"))
    return left.join(right, "group").where((F.col("id_a") < F.col("id_b")) & ((F.col("n_a") > 0) | (F.col("n_b") > 0))).select("id_a", "id_b")


def classes(records: DataFrame, path: str | None = None) -> DataFrame:
    """id, batch_no, group (the least id of the class) of every record that repeats another or is repeated."""
    spark = records.sparkSession
    slim = records.select("id", "batch_no", "provider", "provider_record_id", "court", "case_number", "decision_date", "source_text")
    index = HistoryIndex(spark, path or stage_path(spark, "history"))
    index.append(slim.where(F.col("batch_no") == 0))
    edges = index.match(slim.where(F.col("batch_no") > 0))
    return groups(edges).join(slim.select("id", "batch_no"), "id")
