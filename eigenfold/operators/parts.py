"""A square matrix beside its vectors: both dealt by rows to the same parts, so that a basis never leaves the executors.

A part owns a run of rows: those of the matrix and those of every vector. The exchange plan is made once: which entries of a vector each part
needs from which other, and, for rows with so many entries that no part should hold them, which part sends which partial sums. A step
then is one Spark job: a narrow pass over the part's own vectors, one small shuffle of the planned entries, the product, and one small matrix of inner products to the
driver. Parts are elements of RDDs with one element a partition, which ``zip`` keeps side by side; the state is persisted, and written to the checkpoint
folder every ``STEPS_KEPT`` steps, so that a lost executor costs that many steps at most.
"""

from __future__ import annotations

import gc
import math
import pickle
import tempfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.accumulators import AccumulatorParam
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..matrix import NotConverged, checkpointed
from . import basis

#: Entries of a part, rows of a part without entries, and entries of a row that one part holds at most; longer rows are summed where the vector's entries are.
PART_ENTRIES, PART_ROWS, HEAVY = 2_000_000, 100_000, 200_000
#: Entries of a piece that is sent nearly the whole short side: messages grow with the number of pieces.
PIECE_ENTRIES = 6_000_000
#: Runs of rows whose entries are counted to cut the rows into parts of equal work.
BINS = 16_384
#: Fewer entries than these are not worth a part of their own.
FEW = 20_000
#: Steps between two checkpoints of the state, and bytes of messages: until one is written, the shuffles of all steps since the last stay on disk.
STEPS_KEPT, BYTES_KEPT = 10, 1 << 29
#: More parts than these send their inner products through a tree.
PARTS_AT_ONCE = 64

State = dict[str, np.ndarray]


@dataclass
class Part:
    """What a part holds of the matrix and of the exchange plan. Columns from ``rows`` on are those that others send."""

    lo: int
    hi: int
    at: np.ndarray  # own rows with entries
    first: np.ndarray
    cols: np.ndarray
    vals: np.ndarray
    far_first: np.ndarray  # rows of others, summed here
    far_cols: np.ndarray
    far_vals: np.ndarray
    halo: dict[int, np.ndarray]  # source -> columns that it sends, from 0
    far: dict[int, np.ndarray]  # target -> sums that it gets, from 0
    send: dict[int, np.ndarray] = field(default_factory=dict)  # target -> own rows
    take: dict[int, np.ndarray] = field(default_factory=dict)  # source -> own rows that its sums are added to
    size: int = 0
    mirrored: bool = False  # what is sent comes back, as in ``Normal``

    @property
    def rows(self) -> int:
        return self.hi - self.lo

    def messages(self, p: int, x: np.ndarray) -> Iterator[tuple[int, tuple[int, np.ndarray | None, np.ndarray | None]]]:
        sums = _sums(self.far_vals, x, self.far_cols, self.far_first)
        for q in self.send.keys() | self.far.keys():
            yield q, (p, x[self.send[q]] if q in self.send else None, sums[self.far[q]] if q in self.far else None)

    def product(self, x: np.ndarray, got: list[tuple[int, np.ndarray | None, np.ndarray | None]]) -> np.ndarray:
        every = np.empty((self.rows + self.size, x.shape[1]), x.dtype)
        every[: self.rows] = x
        y = np.zeros_like(x)
        for q, values, _ in got:
            if values is not None:
                every[self.rows + self.halo[q]] = values
        if len(self.first):
            y[self.at] = _sums(self.vals, every, self.cols, self.first)
        for q, _, sums in got:
            if sums is not None:
                y[self.take[q]] += sums
        return y

    def diagonal_cells(self, cell: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The diagonal, and of the square blocks of ``cell`` rows on it those with entries beside it: their numbers and contents; the last is filled up with ones."""
        row = np.repeat(self.at, np.diff(np.append(self.first, len(self.vals))))
        own = (self.cols < self.rows) & (row // cell == self.cols // cell)
        row, col, v = row[own], self.cols[own].astype(np.int64), self.vals[own]
        on = row == col
        diagonal = np.bincount(row[on], v[on], self.rows)
        coupled = np.unique(row[~on & (v != 0)] // cell)
        out = np.zeros((len(coupled), cell, cell))
        some = np.isin(row // cell, coupled)
        np.add.at(out, (np.searchsorted(coupled, row[some] // cell), row[some] % cell, col[some] % cell), v[some])
        if len(coupled) and (coupled[-1] + 1) * cell > self.rows:
            rest = np.arange(self.rows % cell, cell)
            out[-1, rest, rest] = 1
        return diagonal, coupled, out


def _sums(v: np.ndarray, x: np.ndarray, cols: np.ndarray, first: np.ndarray) -> np.ndarray:
    if not len(first):
        return np.zeros((0, x.shape[1]), x.dtype)
    return np.stack([np.add.reduceat(v * c[cols], first) for c in x.T], 1)


def _by_owner(ids: np.ndarray, cuts: np.ndarray) -> dict[int, np.ndarray]:
    """Places of sorted ids by the part that owns them."""
    ends = np.searchsorted(ids, cuts)
    return {q: np.arange(lo, hi) for q, (lo, hi) in enumerate(zip(ends[:-1], ends[1:])) if lo < hi}


@dataclass
class Runs:
    """Rows cut into runs of about equal work: part p owns ``cuts``[p] to ``cuts``[p + 1]. Cuts are multiples of ``width``, so that a row's owner is told by a short table."""

    cuts: np.ndarray
    width: int

    @classmethod
    def equal(cls, n: int, count: int) -> Runs:
        """As many rows each, as far as ``width`` allows; more parts than rows leave some of them empty."""
        width = max(1, n // max(BINS, 4 * count))
        cuts = np.arange(count + 1) * -(-n // width) // count * width
        return cls(np.minimum(cuts, n), width)

    @classmethod
    def weighed(cls, n: int, count: int, weights: Callable[[str], DataFrame], row: float) -> Runs:
        """By ``weights``, given a run of rows' name as an expression of the row i: a frame (bin, w) of their entries' sums; each row itself weighs ``row``."""
        width = max(1, n // max(BINS, 4 * count))
        bins = -(-n // width)
        w = np.full(bins, row * width)
        t = weights(f"i div {width}").toArrow()  # a row a bin
        at = t.column("bin").to_numpy()
        if len(at) and (at.min() < 0 or at.max() >= bins):
            raise ValueError(f"entries outside of {n} rows and columns")
        np.add.at(w, at, t.column("w").to_numpy())
        total = np.concatenate([[0.0], np.cumsum(w)])
        cuts = np.searchsorted(total, np.arange(1, count) * total[-1] / count)
        cuts = np.concatenate([[0], cuts, [bins]])
        if bins >= count:  # none empty
            cuts = np.maximum.accumulate(cuts - np.arange(count + 1)) + np.arange(count + 1)
            cuts = np.minimum(cuts, bins - count + np.arange(count + 1))
        return cls(np.minimum(cuts * width, n), width)

    def owner(self, column: str) -> Column:
        """The part that owns the row; null outside of all."""
        bins = np.searchsorted(self.cuts, np.arange(0, self.cuts[-1], self.width), "right") - 1
        return F.split(F.lit(",".join(map(str, bins))), ",").cast("array<int>")[F.expr(f"cast({column} div {self.width} as int)")]


def _noise(rows: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Normal numbers that depend on the row, the column and the seed alone."""
    with np.errstate(over="ignore"):
        z = (rows.astype(np.uint64)[:, None] * np.uint64(2 * k) + np.arange(2 * k, dtype=np.uint64)[None, :] + np.uint64(seed) * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
            z = (z ^ (z >> np.uint64(shift))) * np.uint64(factor)
    u = ((z >> np.uint64(11)).astype(float) + 0.5) / 2.0**53
    return np.sqrt(-2 * np.log(u[:, :k])) * np.cos(2 * np.pi * u[:, k:])


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array([b.column(c).to_numpy().tobytes()], pa.binary()) for c in ("i", "j", "v")], ["i", "j", "v"])


def _unpacked(rows: Iterator) -> tuple[np.ndarray, ...]:
    got = [(np.frombuffer(r["i"], "<i8"), np.frombuffer(r["j"], "<i8"), np.frombuffer(r["v"], "<f8")) for r in rows]
    return tuple(np.concatenate([g[c] for g in got]) if got else np.zeros(0, t) for c, t in enumerate((np.int64, np.int64, np.float64)))


class Parts:
    """The real square matrix (i, j, v) of ``n`` rows, dealt to parts. Entries at one place add up; rows without entries are zero."""

    def __init__(self, df: DataFrame, n: int, parts: int | None = None, heavy: int | None = None):
        if "vi" in df.columns:
            raise ValueError("complex matrices have no parts; write them as real ones of twice the rows")
        self.spark: SparkSession = df.sparkSession
        df = checkpointed(df.select("i", "j", F.col("v").cast("double").alias("v")))
        entries = df.count()
        self.n = n
        self.count = max(1, min(n, parts or max(min(self.spark.sparkContext.defaultParallelism, math.ceil(entries / FEW)), math.ceil(entries / PART_ENTRIES + n / PART_ROWS))))
        self._begin()
        # a row summed where the vector's entries are costs one sum a part, any other one number an entry
        self.parts = self._deal(df, min(HEAVY, max(64, 2 * self.count)) if heavy is None else heavy)

    def _begin(self) -> None:
        self._kept, self._written, self._since, self._sent = [], [], 0, 0
        self._last = 0  # bytes of the last step's messages

    def _deal(self, df: DataFrame, heavy: int) -> RDD:
        """Parts of equal work: entries, rows, and for long rows the sums that come from all parts."""
        n, count = self.n, self.count
        bad = F.expr(f"i < 0 OR j < 0 OR i >= {n} OR j >= {n}")
        long_rows = checkpointed(df.groupBy("i").count().where(F.col("count") > heavy).select("i", F.lit(True).alias("long"), F.least("count", F.lit(4 * count)).alias("w")))
        dealt = df.join(long_rows.select("i", "long"), "i", "left")
        dealt = dealt.select("i", "j", F.when(bad, F.raise_error(F.lit(f"entries outside of {n} rows and columns"))).otherwise(F.col("v")).cast("double").alias("v"), F.expr("if(long, j, i)").alias("home"))
        weights = lambda bin: dealt.groupBy(F.expr(bin.replace("i ", "home ")).alias("bin")).agg(F.count("v").alias("w")).unionByName(long_rows.groupBy(F.expr(bin).alias("bin")).agg(F.sum("w").alias("w"))).groupBy("bin").agg(F.sum("w").cast("double").alias("w"))
        self.runs = Runs.weighed(n, count, weights, PART_ENTRIES / PART_ROWS)
        cuts = self.runs.cuts
        dealt = dealt.select("i", "j", "v", self.runs.owner("home").alias("home")).repartitionById(count, "home").select("i", "j", "v")

        def build(p: int, rows: Iterator) -> Iterator[Part]:
            i, j, v = _unpacked(rows)
            lo, hi = int(cuts[p]), int(cuts[p + 1])
            own = (i >= lo) & (i < hi)

            def compressed(i: np.ndarray, j: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, ...]:
                order = np.argsort(i, kind="stable")
                first = np.flatnonzero(np.diff(i[order], prepend=-1))
                return i[order][first], first, j[order], v[order]

            at, first, cols, vals = compressed(i[own], j[own], v[own])
            foreign = (cols < lo) | (cols >= hi)
            halo = np.unique(cols[foreign])
            local = np.where(foreign, hi - lo + np.searchsorted(halo, cols), cols - lo).astype(np.int32)
            far, far_first, far_cols, far_vals = compressed(i[~own], j[~own], v[~own])
            part = Part(lo, hi, at - lo, first, local, vals, far_first, (far_cols - lo).astype(np.int32), far_vals, _by_owner(halo, cuts), _by_owner(far, cuts), size=len(halo))
            yield part, halo, far

        def ask(p: int, built: Iterator) -> Iterator:
            for part, halo, far in built:
                for q, at in part.halo.items():
                    yield q, ("send", p, halo[at])
                for q, at in part.far.items():
                    yield q, ("take", p, far[at])

        def plan(both) -> Part:
            (part, _, _), asked = both
            for kind, p, ids in asked:
                getattr(part, kind)[p] = ids - part.lo
            return part

        built = dealt.mapInArrow(_packed, "i binary, j binary, v binary").rdd.mapPartitionsWithIndex(build).persist(StorageLevel.MEMORY_AND_DISK)
        asked = self._delivered(built.mapPartitionsWithIndex(ask))
        parts = built.zip(asked).map(plan).persist(StorageLevel.MEMORY_AND_DISK)
        parts.count()
        built.unpersist()
        return parts

    def _delivered(self, messages: RDD) -> RDD:
        """Messages (part, content) as one element a partition: the list of what that part was sent. The plan is made without adaptive execution, which would
        run the exchange as a job of its own and has nothing to adapt here."""
        rows = self.spark.createDataFrame(messages.map(lambda m: (m[0], pickle.dumps(m[1], 5))), "part int, content binary", verifySchema=False)
        conf, name = self.spark.conf, "spark.sql.adaptive.enabled"
        before = conf.get(name)
        conf.set(name, "false")
        try:
            dealt = rows.repartitionById(self.count, "part").rdd
            dealt.getNumPartitions()  # plans it
        finally:
            conf.set(name, before)
        return dealt.mapPartitions(lambda got: [[pickle.loads(r[1]) for r in got]])

    def unpersist(self) -> None:
        for rdd in [*self._kept, self.parts]:
            rdd.unpersist()
        self._kept = []

    # --- states: a dict of arrays a part ---------------------------------------------------------------

    def start(self, fn: Callable[[Part], State]) -> RDD:
        return self.parts.map(fn)

    def vectors(self, frame: DataFrame, k: int, name: str = "b") -> RDD:
        """(i, x array) as a state; rows that are not there are zero, repeated ones add up."""
        dealt = frame.select("i", "x", self.runs.owner("i").alias("home")).repartitionById(self.count, "home").select("i", "x")

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    x = basis.rows_of(b)
                    if x.shape[1] != k:
                        raise ValueError(f"vectors of {x.shape[1]} columns instead of {k}")
                    yield pa.RecordBatch.from_arrays([pa.array([b.column("i").to_numpy().tobytes()], pa.binary()), pa.array([x.tobytes()], pa.binary())], ["i", "x"])

        def build(rows: Iterator) -> Iterator[list]:
            yield [(np.frombuffer(r["i"], "<i8"), np.frombuffer(r["x"], "<f8").reshape(-1, k)) for r in rows]

        def fill(both) -> State:
            part, got = both
            x = np.zeros((part.rows, k))
            for i, rows in got:
                np.add.at(x, i - part.lo, rows)
            return {name: x}

        return self.parts.zip(dealt.mapInArrow(pack, "i binary, x binary").rdd.mapPartitions(build)).map(fill)

    def frame(self, state: RDD, pick: Callable[[State], np.ndarray]) -> DataFrame:
        """(i, x array<double>) of a block of the state."""

        def pack(both) -> tuple[int, bytes, int]:
            part, s = both
            x = np.ascontiguousarray(pick(s), float)
            return part.lo, x.tobytes(), x.shape[1]

        def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for lo, x, k in zip(b.column("lo").to_pylist(), b.column("x"), b.column("k").to_pylist()):
                    rows = np.frombuffer(x.as_buffer(), "<f8").reshape(-1, max(k, 1))
                    for at in range(0, len(rows), 10_000):
                        part = rows[at : at + 10_000]
                        yield pa.RecordBatch.from_arrays([pa.array(np.arange(lo + at, lo + at + len(part))), basis._arrays(part)], ["i", "x"])

        return self.spark.createDataFrame(self.parts.zip(state).map(pack), "lo long, x binary, k int").mapInArrow(unpack, "i long, x array<double>")

    def step(self, state: RDD, before: Callable[[Part, State], State], block: Callable[[State], np.ndarray], after: Callable[[Part, State, np.ndarray], State], told: Callable[[Part, State], np.ndarray]) -> tuple[RDD, np.ndarray]:
        """One job: ``before`` changes the state where it lies (on both sides of the shuffle, so that it is not kept twice), ``block`` of it is multiplied
        with the matrix, ``after`` puts the product in, and the sum of what each part has ``told`` is returned with the new state."""
        small = self.count <= PARTS_AT_ONCE
        heard = self.spark.sparkContext.accumulator({}, _ByPart()) if small else None  # by part, so that a task run twice counts once
        here = self.parts.zip(state)
        sent = self.spark.sparkContext.accumulator(0)

        def send(p: int, both: Iterator) -> Iterator:
            for part, s in both:
                for q, message in part.messages(p, block(before(part, s))):
                    sent.add(sum(2 * x.nbytes if part.mirrored else x.nbytes for x in message[1:] if x is not None))
                    yield q, message

        def work(both) -> State:
            (part, s), got = both
            s = before(part, s)
            s = after(part, s, part.product(block(s), got))
            if heard is not None:
                heard.add({(part.lo, part.hi): told(part, s)})
            return s

        new = here.zip(self._exchanged(here.mapPartitionsWithIndex(send))).map(work).persist(StorageLevel.MEMORY_AND_DISK)
        self._since += 1
        due = self._since >= STEPS_KEPT or self._sent + self._last > BYTES_KEPT
        if due:
            checkpoint_folder(self.spark)
            new.checkpoint()
        if heard is None:
            total = self.look(new, told)
        else:
            new._jrdd.count()  # fills the cache; the elements are not read by Python again
            total = sum(x for _, x in sorted(heard.value.items()))
        for old in self._kept:
            old.unpersist()
        kept = RDD(new._jrdd, self.spark.sparkContext, new._jrdd_deserializer)  # without Python's hold on what it was made of
        self._kept, self._last = [kept], sent.value
        self._sent += sent.value
        if due:
            del here, new
            self._since = self._sent = 0
            self._let_go(kept)
        return kept, total

    def _exchanged(self, messages: RDD) -> RDD:
        return self._delivered(messages)

    def _let_go(self, new: RDD) -> None:
        """After a checkpoint nothing before it is needed: its predecessor's file goes, and shuffles as soon as the driver collects its garbage."""
        jvm, sc = self.spark._jvm, self.spark.sparkContext
        for old in self._written:
            path = jvm.org.apache.hadoop.fs.Path(old)
            path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
        self._written = [f for f in [new.getCheckpointFile()] if f]
        let_go(self.spark)

    def look(self, state: RDD, told: Callable[[Part, State], np.ndarray]) -> np.ndarray:
        return self._sum(self.parts.zip(state).map(lambda both: told(*both)))

    def _sum(self, told: RDD) -> np.ndarray:
        if self.count > PARTS_AT_ONCE:
            return told.treeReduce(lambda a, b: a + b, depth=2)
        return sum(told.collect())


class Normal(Parts):
    """A'A for a tall real matrix A (i, j, v) of ``rows`` x ``n``, beside vectors as long as A's short side: no vector is as long as the tall one, and A'A is not made.

    A is read three times, so that its caller checkpoints it where it is costly. Pieces are runs of A's rows. A step sends them the entries of a vector that they touch, and each sends back its sums of A'(A x) for these: one job with two small shuffles."""

    def __init__(self, df: DataFrame, rows: int, n: int, parts: int | None = None):
        if "vi" in df.columns:
            raise ValueError("complex matrices have no parts; write them as real ones of twice the rows")
        self.spark, self.n = df.sparkSession, n
        entries = df.count()
        self.count = max(1, min(rows, parts or max(min(self.spark.sparkContext.defaultParallelism, math.ceil(entries / FEW)), math.ceil(entries / PIECE_ENTRIES))))
        self._begin()
        bad = F.expr(f"i < 0 OR j < 0 OR i >= {rows} OR j >= {n}")
        df = df.select("i", "j", F.when(bad, F.raise_error(F.lit(f"entries outside of {rows} rows and {n} columns"))).otherwise(F.col("v")).cast("double").alias("v"))
        tall = Runs.weighed(rows, self.count, lambda bin: df.groupBy(F.expr(bin).alias("bin")).agg(F.count("v").cast("double").alias("w")), 0.0)
        self.runs = Runs.equal(n, self.count)
        self.parts = self._deal(df, tall)

    def _deal(self, df: DataFrame, tall: Runs) -> RDD:
        cuts, count = self.runs.cuts, self.count
        dealt = df.select("i", "j", "v", tall.owner("i").alias("home")).repartitionById(count, "home").select("i", "j", "v")

        def build(rows: Iterator) -> Iterator[tuple]:
            i, j, v = _unpacked(rows)
            order = np.argsort(i, kind="stable")
            first = np.flatnonzero(np.diff(i[order], prepend=-1))
            touched, local = np.unique(j[order], return_inverse=True)
            yield first, local.astype(np.int32), v[order], touched, _by_owner(touched, cuts)

        def ask(q: int, built: Iterator) -> Iterator:
            for *_, touched, owners in built:
                for p, at in owners.items():
                    yield p, (q, touched[at])

        def plan(p: int, asked: Iterator) -> Iterator[Part]:
            lo, hi = int(cuts[p]), int(cuts[p + 1])
            none, ids = np.zeros(0), np.zeros(0, np.int64)
            for got in asked:
                shared = {q: touched - lo for q, touched in got}
                yield Part(lo, hi, ids, ids, ids, none, ids, ids, none, {}, {}, shared, shared, mirrored=True)

        self.pieces = dealt.mapInArrow(_packed, "i binary, j binary, v binary").rdd.mapPartitions(build).persist(StorageLevel.MEMORY_AND_DISK)
        parts = self._delivered(self.pieces.mapPartitionsWithIndex(ask)).mapPartitionsWithIndex(plan).persist(StorageLevel.MEMORY_AND_DISK)
        parts.count()
        return parts

    def _exchanged(self, messages: RDD) -> RDD:
        def multiply(q: int, both: Iterator) -> Iterator:
            for (first, cols, vals, touched, owners), got in both:
                if not len(first):
                    continue
                x = np.empty((len(touched), got[0][1].shape[1]))
                for p, values, _ in got:
                    x[owners[p]] = values
                size = np.diff(np.append(first, len(cols)))
                y = np.stack([np.bincount(cols, vals * np.repeat(np.add.reduceat(vals * c[cols], first), size), len(touched)) for c in x.T], 1)
                for p, at in owners.items():
                    yield p, (q, None, y[at])

        return self._delivered(self.pieces.zip(self._delivered(messages)).mapPartitionsWithIndex(multiply))

    def unpersist(self) -> None:
        super().unpersist()
        self.pieces.unpersist()


@dataclass
class Half(Part):
    """A part of ``Sides``: its entries serve their rows and, transposed, the sums that the short side's rows get. The matrix is diagonal + factor * scale K scale."""

    diagonal: np.ndarray | None = None
    scale: np.ndarray | None = None
    factor: float = 1.0

    def messages(self, p: int, x: np.ndarray) -> Iterator[tuple[int, tuple[int, np.ndarray | None, np.ndarray | None]]]:
        x = x if self.scale is None else self.scale[:, None] * x
        size, local = np.diff(np.append(self.first, len(self.vals))), self.cols - self.rows
        sums = np.stack([np.bincount(local, self.vals * np.repeat(c[self.at], size), self.size) for c in x.T], 1)
        for q in self.send.keys() | self.far.keys():
            yield q, (p, x[self.send[q]] if q in self.send else None, sums[self.far[q]] if q in self.far else None)

    def product(self, x: np.ndarray, got: list[tuple[int, np.ndarray | None, np.ndarray | None]]) -> np.ndarray:
        y = self.factor * super().product(x, got)
        if self.scale is not None:
            y *= self.scale[:, None]
        return y if self.diagonal is None else y + self.diagonal[:, None] * x

    def diagonal_cells(self, cell: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        diagonal = np.zeros(self.rows) if self.diagonal is None else self.diagonal
        return diagonal, np.zeros(0, np.int64), np.zeros((0, cell, cell))


class Sides(Parts):
    """The symmetric matrix K = [0 A'; A 0] of a tall real A (i, j, v) of ``rows`` x ``cols``: the ``cols`` short rows come first, A's row i is row ``cols`` + i.

    Each entry is shuffled and held once, with its row of A; the short side's rows are summed there. A is read three times, so that its caller checkpoints it where it is costly.
    ``weighted`` turns K into D - c K, ``normalised`` into D^-1/2 K D^-1/2, D the sums of K's rows: a product of K, so that no entry is joined or written anew."""

    def __init__(self, df: DataFrame, rows: int, cols: int, parts: int | None = None):
        if "vi" in df.columns:
            raise ValueError("complex matrices have no parts; write them as real ones of twice the rows")
        self.spark, self.n = df.sparkSession, rows + cols
        entries = df.count()
        self.count = max(1, min(rows, parts or max(min(self.spark.sparkContext.defaultParallelism, math.ceil(entries / FEW)), math.ceil(entries / PIECE_ENTRIES))))
        self._begin()
        bad = F.expr(f"i < 0 OR j < 0 OR i >= {rows} OR j >= {cols}")
        df = df.select((F.col("i") + cols).alias("i"), "j", F.when(bad, F.raise_error(F.lit(f"entries outside of {rows} rows and {cols} columns"))).otherwise(F.col("v")).cast("double").alias("v"))
        # a short row weighs the sums that come from all parts
        short = self.spark.range(cols).select(F.col("id").alias("i"), F.lit(4.0 * self.count).alias("w"))
        weights = lambda bin: df.groupBy(F.expr(bin).alias("bin")).agg(F.count("v").cast("double").alias("w")).unionByName(short.groupBy(F.expr(bin).alias("bin")).agg(F.sum("w").alias("w"))).groupBy("bin").agg(F.sum("w").alias("w"))
        self.runs = Runs.weighed(self.n, self.count, weights, PART_ENTRIES / PART_ROWS)
        self.parts = self._deal(df)

    def _deal(self, df: DataFrame) -> RDD:
        cuts = self.runs.cuts
        dealt = df.select("i", "j", "v", self.runs.owner("i").alias("home")).repartitionById(self.count, "home").select("i", "j", "v")

        def build(p: int, rows: Iterator) -> Iterator[tuple[Half, np.ndarray]]:
            i, j, v = _unpacked(rows)
            lo, hi = int(cuts[p]), int(cuts[p + 1])
            order = np.argsort(i, kind="stable")
            first = np.flatnonzero(np.diff(i[order], prepend=-1))
            touched, local = np.unique(j[order], return_inverse=True)
            none, owners = np.zeros(0, np.int64), _by_owner(touched, cuts)
            yield Half(lo, hi, i[order][first] - lo, first, (local + (hi - lo)).astype(np.int32), v[order], none, none, np.zeros(0), owners, owners, size=len(touched)), touched

        def ask(p: int, built: Iterator) -> Iterator:
            for part, touched in built:
                for q, at in part.halo.items():
                    yield q, (p, touched[at])

        def plan(both) -> Half:
            (part, _), asked = both
            part.send = part.take = {p: ids - part.lo for p, ids in asked}
            return part

        built = dealt.mapInArrow(_packed, "i binary, j binary, v binary").rdd.mapPartitionsWithIndex(build).persist(StorageLevel.MEMORY_AND_DISK)
        parts = built.zip(self._delivered(built.mapPartitionsWithIndex(ask))).map(plan).persist(StorageLevel.MEMORY_AND_DISK)
        parts.count()
        built.unpersist()
        return parts

    def _dressed(self, dress: Callable[[Half, np.ndarray], Half]) -> Sides:
        ones = self.start(lambda part: {"x": np.ones((part.rows, 1))})
        state, _ = self.step(ones, lambda part, s: s, lambda s: s["x"], lambda part, s, y: {"d": y[:, 0]}, lambda part, s: np.zeros(1))
        bare, self.parts = self.parts, self.parts.zip(state).map(lambda both: dress(both[0], both[1]["d"])).persist(StorageLevel.MEMORY_AND_DISK)
        self.parts.count()
        bare.unpersist()
        return self

    def weighted(self, c: float) -> Sides:
        return self._dressed(lambda part, d: replace(part, diagonal=d, factor=-c))

    def normalised(self) -> Sides:
        return self._dressed(lambda part, d: replace(part, scale=np.where(d > 0, 1 / np.sqrt(np.where(d > 0, d, 1)), 0.0)))


class _ByPart(AccumulatorParam):
    def zero(self, value: dict) -> dict:
        return {}

    def addInPlace(self, a: dict, b: dict) -> dict:
        a.update(b)
        return a


def let_go(spark: SparkSession) -> None:
    """Shuffles that nothing refers to leave the disk as soon as the driver collects its garbage."""
    gc.collect()
    spark._jvm.System.gc()


def checkpoint_folder(spark: SparkSession) -> None:
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not sc.master.startswith("local"):
            raise RuntimeError("a cluster needs a shared folder in spark.checkpoint.dir")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))


# --- eigenvalues ----------------------------------------------------------------------------------------


@dataclass
class Found:
    """Values, the residuals' norms measured at the end, vectors as a frame (i, x array), and whether all are within the tolerance."""

    values: np.ndarray
    residuals: np.ndarray
    vectors: DataFrame | None
    steps: int
    converged: bool
    nconv: int = 0

    def checked(self) -> Found:
        if not self.converged:
            raise NotConverged(f"{self.nconv} of {len(self.values)} values after {self.steps} steps, residuals up to {self.residuals.max():.2e}")
        return self


def _wanted(values: np.ndarray, which: str) -> np.ndarray:
    keys = {"largest_real": -values, "smallest_real": values, "largest_magnitude": -np.abs(values)}
    if which not in keys:
        raise ValueError(f"a basis beside the matrix finds {', '.join(keys)}, not {which}")
    return np.argsort(keys[which], kind="stable")


def _gram(part: Part, s: State) -> np.ndarray:
    every = np.hstack([s["v"], s["av"], s["u"]])
    return every.T @ every


def _independent(g: np.ndarray, least: float = 1e-9) -> np.ndarray:
    """M with M' G M the identity, of the directions that rounding leaves apart."""
    d = 1 / np.sqrt(np.maximum(np.diag(g), 1e-300))
    w, u = np.linalg.eigh(d[:, None] * g * d)
    some = w > least * max(w.max(initial=0), 1e-300)
    return (d[:, None] * u[:, some]) / np.sqrt(w[some])


def _new_columns(g: np.ndarray, old: int, least: float = 1e-9) -> np.ndarray:
    """Coefficients of orthonormal columns that the last columns add to the first ``old``, which are orthonormal, by all columns' inner products."""
    new = np.eye(len(g))[:, old:]
    new = new - np.eye(len(g))[:, :old] @ g[:old, old:]
    size = np.sqrt(np.maximum(np.diag(new.T @ g @ new), 0))
    new = new[:, size > 1e-11 * np.sqrt(np.diag(g)[old:])]
    return new @ _independent(new.T @ g @ new, least) if new.shape[1] else new


def eigenpairs(parts: Parts, nev: int = 1, which: str = "largest_real", tol: float = 1e-7, block: int | None = None, ncv: int | None = None, most: int = 200, seed: int = 0, low: tuple[RDD, np.ndarray] | None = None) -> Found:
    """Extreme eigenpairs of a symmetric matrix from a thick-restarted block Krylov space that stays beside it.

    A step takes the residuals of ``block`` wanted pairs, which span the next Krylov block, into the space: one job, whose inner products of the basis
    and its products give the projected problem, the metric that rounding has left, and all residuals. Beyond ``ncv``
    vectors the space is pressed together to the wanted ones and half the rest. ``tol`` is relative to the largest value met. A
    space that closes early goes on with random vectors, so that copies are found as far as the block reaches.

    ``low`` is a state with columns "u" and a small symmetric matrix S: the operator then is A + u S u', which is never written out. What a new block has
    in common with u follows from the inner products of the step before, so that a step remains one job."""
    n, b = parts.n, min(parts.n, block or max(nev, 4))
    nev = min(nev, n)
    m = min(n, max(ncv or max(2 * nev + 2 * b, nev + 8 * b), nev + 2 * b))
    zero = low if low is not None else (parts.start(lambda part: {"u": np.zeros((part.rows, 0))}), np.zeros((0, 0)))
    inner = np.asarray(zero[1], float)
    state = parts.parts.zip(zero[0]).map(lambda t: {"v": _noise(np.arange(t[0].lo, t[0].hi), b, seed), "av": np.zeros((t[0].rows, 0)), "u": t[1]["u"]})
    common = inner @ parts.look(state, lambda part, s: s["u"].T @ s["v"]) if len(inner) else np.zeros((0, b))  # S u' of the new block
    old, change = 0, None  # orthonormal columns, and what is to become of the state
    values, steps, top = np.zeros(0), 0, 0.0
    while True:
        steps += 1

        def before(part: Part, s: State, change=change, at=steps) -> State:
            if change is None:
                return s
            whole, lead, turn, y, theta, fresh = change
            v, av = s["v"] @ turn, s["av"] @ turn
            if not whole:  # only the last block changes
                v, av = np.hstack([s["v"][:, :lead], v]), np.hstack([s["av"][:, :lead], av])
            t = av @ y - v @ (y * theta)
            if fresh:
                t = np.hstack([t, _noise(np.arange(part.lo, part.hi), fresh, seed + at)])
            return {"v": np.hstack([v, t]), "av": av, "u": s["u"]}

        after = lambda part, s, y, common=common: {"v": s["v"], "av": np.hstack([s["av"], y + s["u"] @ common]), "u": s["u"]}
        state, g = parts.step(state, before, lambda s: s["v"][:, s["av"].shape[1] :], after, _gram)
        k = (len(g) - len(inner)) // 2
        shared, g = g[2 * k :, : 2 * k], g[: 2 * k, : 2 * k]
        basis_ = np.hstack([np.eye(k)[:, :old], own := _new_columns(g[:k, :k], old)])
        h = basis_.T @ g[:k, k:] @ basis_
        values, y = np.linalg.eigh((h + h.T) / 2)
        order = _wanted(values, which)
        values, y = values[order], y[:, order]
        c = basis_ @ y
        top = max(top, np.abs(values).max(initial=0))
        square = np.einsum("ij,ij->j", c, g[k:, k:] @ c) - 2 * values * np.einsum("ij,ij->j", c, g[:k, k:] @ c) + values**2 * np.einsum("ij,ij->j", c, g[:k, :k] @ c)
        r = np.sqrt(np.maximum(square, 0))
        bar = max(tol, 4e-8) * max(top, 1e-300)  # what the inner products tell; the last look measures
        if (len(values) >= nev and (r[:nev] <= bar).all()) or steps >= most:
            break
        size, room = len(values), m - b
        whole = size > room
        if whole:  # pressed together to the wanted ones and half the rest
            size = min(room, nev + max(b, (room - nev) // 2))
        pick = np.flatnonzero(r[:size] > bar)[:b]  # pairs behind the wanted ones fill the block up
        fresh = min(0 if len(pick) else b, max(n - size, 0))
        if not len(pick) and not fresh:
            break
        change = (whole, old, c[:, :size] if whole else own, np.eye(size)[:, pick] if whole else y[:, pick], values[pick], fresh)
        if len(inner):
            turned = [h if whole else np.hstack([g_[:, :old], h]) for g_, h in ((shared[:, :k], shared[:, :k] @ change[2]), (shared[:, k:], shared[:, k:] @ change[2]))]
            new = turned[1] @ change[3] - turned[0] @ (change[3] * change[4])
            if fresh:
                new = np.hstack([new, parts.look(state, lambda part, s, at=steps + 1, fresh=fresh: s["u"].T @ _noise(np.arange(part.lo, part.hi), fresh, seed + at))])
            common = inner @ new
        else:
            common = np.zeros((0, len(pick) + fresh))
        old = size
    nev = min(nev, len(values))
    q, lam = c[:, :nev], values[:nev]
    final = parts.parts.zip(state).map(lambda both: {"x": both[1]["v"] @ q, "r": both[1]["av"] @ q - both[1]["v"] @ (q * lam)}).persist(StorageLevel.MEMORY_AND_DISK)
    residuals = np.sqrt(parts.look(final, lambda part, s: (s["r"] ** 2).sum(0)))
    good = residuals <= 2 * max(tol, 1e-12) * max(top, 1e-300)
    parts._kept.append(final)
    return Found(lam, residuals, parts.frame(final, lambda s: s["x"]), steps, bool(good.all()) and len(lam) > 0, int(good.sum()))


# --- linear systems --------------------------------------------------------------------------------------


@dataclass
class Solved:
    """The solutions as a frame, relative residuals measured from b - A x at the end, and whether all are within the tolerance."""

    x: DataFrame
    residuals: np.ndarray
    steps: int
    converged: bool

    def checked(self) -> Solved:
        if not self.converged:
            raise NotConverged(f"relative residuals up to {self.residuals.max():.2e} after {self.steps} steps")
        return self


def solve(parts: Parts, b: DataFrame, k: int = 1, shift: float = 0.0, tol: float = 1e-10, most: int = 500, cell: int = 64) -> Solved:
    """(A + shift I) X = B for ``k`` right sides at once, A + shift I symmetric and positive definite, by conjugate gradients with one
    product and one sum of inner products a step. Each part inverts the ``cell`` x ``cell`` blocks on its diagonal as preconditioner. An indefinite matrix raises
    as soon as a direction shows it; ``checked`` raises where the tolerance was not met."""

    def apart(part: Part) -> State:
        diagonal, coupled, cells = part.diagonal_cells(cell)
        cells[:, np.arange(cell), np.arange(cell)] += shift
        diagonal = diagonal + shift
        definite = (not len(cells) or np.linalg.eigvalsh(cells).min() > 0) and diagonal.min(initial=1) > 0
        if not definite:  # the driver sees that nothing is positive
            return {"scale": np.full_like(diagonal, np.nan), "coupled": coupled[:0], "inverse": cells[:0]}
        return {"scale": 1 / diagonal, "coupled": coupled, "inverse": np.linalg.inv(cells)}

    def precondition(s: State, r: np.ndarray) -> np.ndarray:
        """Rows that no other of their block touches have their diagonal alone, so that the inverses do not outgrow the vectors."""
        u, coupled = s["scale"][:, None] * r, s["coupled"]
        if len(coupled):
            at = coupled[:, None] * cell + np.arange(cell)[None, :]
            real = at < len(r)
            some = np.where(real[:, :, None], r[np.minimum(at, len(r) - 1)], 0.0)
            u[at[real]] = (s["inverse"] @ some)[real]
        return u

    def begin(both) -> State:
        part, s = both
        inverse, zero = apart(part), np.zeros_like(s["b"])
        return inverse | {"b": s["b"], "x": zero, "r": s["b"], "p": zero, "q": zero, "u": precondition(inverse, s["b"])}

    def told(part: Part, s: State) -> np.ndarray:
        return np.stack([(s["r"] * s["u"]).sum(0), (s["w"] * s["u"]).sum(0), (s["r"] ** 2).sum(0)])

    state = parts.parts.zip(parts.vectors(b, k)).map(begin)
    size = alpha = beta = last = None
    steps = 0
    while True:

        def before(part: Part, s: State, alpha=alpha, beta=beta) -> State:
            if alpha is None:
                return s
            p, q = s["u"] + beta * s["p"], s["w"] + beta * s["q"]
            r = s["r"] - alpha * q
            return s | {"p": p, "q": q, "x": s["x"] + alpha * p, "r": r, "u": precondition(s, r)}

        state, sums = parts.step(state, before, lambda s: s["u"], lambda part, s, y: s | {"w": y + shift * s["u"]}, told)
        gamma, delta, square = sums
        if size is None:
            size = np.sqrt(square)
        done = np.sqrt(square) <= tol * size
        if done.all() or steps >= most:
            break
        if not (delta[~done] > 0).all() or not (gamma[~done] > 0).all():
            raise NotConverged("the matrix or its preconditioner is not positive definite")
        with np.errstate(divide="ignore", invalid="ignore"):
            beta = np.zeros(k) if last is None else gamma / last
            alpha = gamma / (delta if last is None else delta - beta * gamma / alpha)
        beta, alpha = (np.where(done, 0.0, np.nan_to_num(c, posinf=0.0, neginf=0.0)) for c in (beta, alpha))
        last = gamma
        steps += 1
    state, off = parts.step(state, lambda part, s: s, lambda s: s["x"], lambda part, s, y: {"x": s["x"], "off": s["b"] - y - shift * s["x"]}, lambda part, s: (s["off"] ** 2).sum(0))
    residuals = np.sqrt(off) / np.where(size > 0, size, 1)
    return Solved(parts.frame(state, lambda s: s["x"]), residuals, steps, bool((residuals <= 10 * tol).all()))


# --- functions and densities by Chebyshev polynomials -------------------------------------------------------


def chebyshev(parts: Parts, state: RDD, degree: int, span: tuple[float, float], coefficients: np.ndarray | None = None) -> tuple[RDD, np.ndarray]:
    """T_k of the matrix, whose spectrum ``span`` holds, times the state's block "b", step by step: one product a job.

    Gives the state with "y", the sum of ``coefficients`` times them, and the moments b' T_k b by column up to twice the degree, which follow
    from the products of two neighbours."""
    centre, half = (span[0] + span[1]) / 2, (span[1] - span[0]) / 2
    c = np.zeros(degree + 1) if coefficients is None else np.asarray(coefficients, float)
    told = lambda part, s: np.stack([(s["now"] ** 2).sum(0), (s["now"] * s["last"]).sum(0), (s["b"] ** 2).sum(0)])
    moments: dict[int, np.ndarray] = {}
    for k in range(1, degree + 1):

        def after(part: Part, s: State, y: np.ndarray, k=k) -> State:
            now = s["b"] if k == 1 else s["now"]
            scaled = (y - centre * now) / half
            new = scaled if k == 1 else 2 * scaled - s["last"]
            start = c[0] * s["b"] if k == 1 else s["y"]
            return {"b": s["b"], "last": now, "now": new, "y": start + c[k] * new}

        state, sums = parts.step(state, lambda part, s: s, lambda s, k=k: s["b"] if k == 1 else s["now"], after, told)
        moments[0] = sums[2]
        if k == 1:
            moments[1] = sums[1]
        moments[2 * k] = 2 * sums[0] - moments[0]
        moments[2 * k - 1] = 2 * sums[1] - moments[1]
    return state, np.array([moments[k] for k in range(2 * degree + 1)]) if degree else np.zeros((0, 0))


def series(f: Callable[[np.ndarray], np.ndarray], span: tuple[float, float], tol: float = 1e-12, most: int = 4096) -> np.ndarray:
    """Chebyshev coefficients of f over ``span``, cut where all that follow add up to less than ``tol``, so that the degree is set before the run."""
    size = 32
    while True:
        angle = (np.arange(2 * size) + 0.5) * np.pi / (2 * size)
        value = f((span[0] + span[1]) / 2 + (span[1] - span[0]) / 2 * np.cos(angle))
        c = np.array([2 / (2 * size) * (value * np.cos(k * angle)).sum() for k in range(2 * size)])
        c[0] /= 2
        tail = np.cumsum(np.abs(c)[::-1])[::-1]
        if tail[size:].sum() <= size * tol or size >= most:
            break
        size *= 2
    if tail[size] > max(tol, 1e-13 * np.abs(c).sum()):
        raise NotConverged(f"no polynomial of degree {size} comes within {tol} of the function")
    return c[: max(int(np.argmax(np.append(tail, 0) <= max(tol, 1e-15 * np.abs(c).sum()))), 2)]


def function_times(parts: Parts, f: Callable[[np.ndarray], np.ndarray], b: DataFrame, k: int, span: tuple[float, float], tol: float = 1e-12) -> tuple[DataFrame, int]:
    """f(A) B as a frame and the degree, for a symmetric A whose spectrum lies in ``span``: right sides are columns and never leave the executors.
    The error is at most ``tol`` times the norm of B."""
    c = series(f, span, tol)
    state, _ = chebyshev(parts, parts.vectors(b, k), len(c) - 1, span, c)
    return parts.frame(state, lambda s: s["y"]), len(c) - 1


@dataclass
class Density:
    """Moments of the spectrum, mean over ``probes`` random sign vectors, and their standard errors; all for the trace divided by n."""

    moments: np.ndarray
    errors: np.ndarray
    span: tuple[float, float]
    n: int

    def at(self, points: np.ndarray) -> np.ndarray:
        """The density by the kernel polynomial with Jackson's damping."""
        m = len(self.moments)
        k = np.arange(m)
        damp = ((m - k + 1) * np.cos(np.pi * k / (m + 1)) + np.sin(np.pi * k / (m + 1)) / np.tan(np.pi / (m + 1))) / (m + 1)
        half = (self.span[1] - self.span[0]) / 2
        x = (np.asarray(points, float) - (self.span[0] + self.span[1]) / 2) / half
        inside = np.clip(x, -1 + 1e-12, 1 - 1e-12)
        total = self.moments[0] + 2 * (damp[1:, None] * self.moments[1:, None] * np.cos(k[1:, None] * np.arccos(inside)[None, :])).sum(0)
        return np.where(np.abs(x) <= 1, total / (np.pi * np.sqrt(1 - inside**2) * half), 0.0)

    def power(self, p: int) -> tuple[float, float]:
        """The mean of the p-th powers of the eigenvalues and its standard error."""
        centre, half = (self.span[0] + self.span[1]) / 2, (self.span[1] - self.span[0]) / 2
        c = np.polynomial.chebyshev.poly2cheb(np.polynomial.polynomial.polypow([centre, half], p))
        if len(c) > len(self.moments):
            raise ValueError("a higher power than there are moments")
        return float(c @ self.moments[: len(c)]), float(np.sqrt((c**2) @ (self.errors[: len(c)] ** 2))) if p == 0 else float(np.abs(c) @ self.errors[: len(c)])


#: Sign vectors of one Chebyshev recurrence.
PROBES_AT_ONCE = 8


def density(parts: Parts, degree: int = 20, span: tuple[float, float] = (-1.0, 1.0), probes: int = 16, seed: int = 0) -> Density:
    """The spectral density of a symmetric matrix from Chebyshev moments of ``probes`` sign vectors, 2 ``degree`` of them."""
    m = []
    for at in range(0, probes, PROBES_AT_ONCE):  # as few as this, since a state holds four vectors of each
        signs = lambda part, at=at: {"b": np.where(_noise(np.arange(part.lo, part.hi), probes, seed)[:, at : at + PROBES_AT_ONCE] < 0, -1.0, 1.0)}
        m.append(chebyshev(parts, parts.start(signs), degree, span)[1])
    m = np.hstack(m) / parts.n
    return Density(m.mean(1), m.std(1, ddof=1) / math.sqrt(probes), span, parts.n)


#: Products of two entries of a row that one task sums, about, and at once; bytes of rows sent to runs of columns at once.
PAIRS, PAIRS_AT_ONCE, ROUND_BYTES = 32_000_000, 4_000_000, 2 << 30


def gram_squares(df: DataFrame, n: int) -> float:
    """The sum of the squares of all entries of A'A for a real sparse A (i, j, v) of ``n`` columns, which is the trace of (A'A)^2; entries at one place add up.

    The columns are cut into runs. A run gets each row that touches it once, from its first entry in the run on, packed; its task multiplies and sums there, so that neither A'A nor the
    products of pairs are shuffled. A long row is sent to many runs, so that the runs take turns: what is sent at once stays below ``ROUND_BYTES``, about."""
    spark = df.sparkSession
    entries, pairs = (x or 0 for x in df.groupBy("i").count().agg(F.sum("count"), F.sum(F.col("count") * (F.col("count") + 1) / 2)).first())
    count = max(1, min(n, max(min(spark.sparkContext.defaultParallelism, math.ceil(pairs / FEW)), math.ceil(pairs / PAIRS))))
    df = df.repartition(max(count, math.ceil(pairs / PAIRS), 1), "i").groupBy("i", "j").agg(F.sum("v").cast("double").alias("v"))
    df = checkpointed(df.sortWithinPartitions("i", "j"))
    let_go(spark)
    runs = Runs.weighed(n, count, lambda bin: df.groupBy(F.expr(bin.replace("i ", "j ")).alias("bin")).agg(F.count("v").cast("double").alias("w")), 0.0)
    cuts = runs.cuts
    turns = max(1, min(count, math.ceil(12 * min(pairs, entries * (count + 1) / 2) / ROUND_BYTES)))

    def flat(start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Runs of numbers from each start."""
        return np.arange(size.sum()) + np.repeat(start - (np.cumsum(size) - size), size)

    def routed(i: np.ndarray, j: np.ndarray, v: np.ndarray, turn: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        run = np.searchsorted(cuts, j, "right") - 1
        new_row = np.diff(i, prepend=i[0] - 1) != 0
        begin = np.flatnonzero(new_row | (np.diff(run, prepend=-1) != 0))  # a row's first entry in a run
        row_end = np.append(np.flatnonzero(new_row)[1:], len(i))
        size = row_end[np.cumsum(new_row)[begin] - 1] - begin
        order = np.argsort(run[begin], kind="stable")
        begin, size = begin[order], size[order]
        at = np.searchsorted(run[begin], np.arange(count + 1))
        for q in range(turn, count, turns):
            if at[q] < at[q + 1]:
                some = slice(at[q], at[q + 1])
                places = flat(begin[some], size[some])
                yield q, size[some].astype("<i4"), j[places].astype("<i8" if n > 2**31 else "<i4"), v[places]

    def route(batches: Iterator[pa.RecordBatch], turn: int) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def packed(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held
            i, j, v = (np.concatenate([h[c] for h in held]) for c in range(3))
            cut = len(i) if last else int(np.searchsorted(i, i[-1]))  # the last row may go on
            held = [(i[cut:], j[cut:], v[cut:])]
            if cut:
                for q, *rest in routed(i[:cut], j[:cut], v[:cut], turn):
                    yield pa.RecordBatch.from_arrays([pa.array([q], pa.int32()), *[pa.array([x.tobytes()], pa.binary()) for x in rest]], ["home", "size", "j", "v"])

        for b in batches:
            if b.num_rows:
                held.append(tuple(b.column(c).to_numpy() for c in ("i", "j", "v")))
                if sum(len(h[0]) for h in held) >= 1_000_000:
                    yield from packed(False)
        if held:
            yield from packed(True)

    def squares(lo: int, hi: int, size: np.ndarray, j: np.ndarray, v: np.ndarray) -> float:
        end = np.repeat(np.cumsum(size), size)
        lead = np.flatnonzero(j < hi)  # none is below lo
        lead = lead[np.argsort(j[lead], kind="stable")]
        todo = np.concatenate([[0], np.cumsum(end[lead] - lead)])
        total, at = 0.0, 0
        while at < len(lead):
            column = j[lead[at]]
            # whole columns: as many as fit, one at least
            stop = max(int(np.searchsorted(todo, todo[at] + PAIRS_AT_ONCE, "right")) - 1, at + 1)
            last = int(np.searchsorted(j[lead], j[lead[stop]])) if stop < len(lead) else stop
            if last <= at:
                last = int(np.searchsorted(j[lead], column, "right"))
            wide = int(j[lead[last - 1]] - column) + 1
            if wide * n <= 2 * PAIRS_AT_ONCE or todo[last] - todo[at] > 2 * PAIRS_AT_ONCE:
                sums = np.zeros(wide * n)
                while at < last:  # a long column in steps
                    till = min(max(int(np.searchsorted(todo, todo[at] + PAIRS_AT_ONCE, "right")) - 1, at + 1), last)
                    k = lead[at:till]
                    places = flat(k, end[k] - k)
                    sums += np.bincount(np.repeat((j[k].astype(np.int64) - column) * n, end[k] - k) + j[places], np.repeat(v[k], end[k] - k) * v[places], wide * n)
                    at = till
                diagonal = sums.reshape(wide, n)[np.arange(wide), column + np.arange(wide)]
            else:
                k = lead[at:last]
                places = flat(k, end[k] - k)
                key = np.repeat((j[k].astype(np.int64) - column) * n, end[k] - k) + j[places]
                order = np.argsort(key, kind="stable")
                key = key[order]
                first = np.flatnonzero(np.diff(key, prepend=-1))
                sums = np.add.reduceat((np.repeat(v[k], end[k] - k) * v[places])[order], first)
                diagonal = sums[key[first] // n + column == key[first] % n]
                at = last
            total += 2 * float(sums @ sums) - float(diagonal @ diagonal)
        return total

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got, home = [], None
        for b in batches:
            for r in range(b.num_rows):
                home = b.column("home")[r].as_py()
                got.append(tuple(np.frombuffer(b.column(c)[r].as_buffer(), t).copy() for c, t in (("size", "<i4"), ("j", "<i8" if n > 2**31 else "<i4"), ("v", "<f8"))))
        if got:
            size, j, v = (np.concatenate([g[c] for g in got]) for c in range(3))
            got.clear()
            yield pa.RecordBatch.from_arrays([pa.array([squares(int(cuts[home]), int(cuts[home + 1]), size.astype(np.int64), j, v)])], ["t"])

    total = 0.0
    for turn in range(turns):
        dealt = df.mapInArrow(lambda batches, turn=turn: route(batches, turn), "home int, size binary, j binary, v binary").repartitionById(count, "home")
        total += float(dealt.mapInArrow(summed, "t double").agg(F.sum("t")).first()[0] or 0.0)
        del dealt
        if turns > 1:
            let_go(spark)
    return total


# --- a space shared by all shifts ----------------------------------------------------------------------------


@dataclass
class Space:
    """An orthonormal basis v ``turn`` beside the matrix, the projected matrix ``h``, the first block's coefficients ``lead``, and the
    inner products of the basis' images."""

    state: RDD
    turn: np.ndarray
    h: np.ndarray
    lead: np.ndarray
    images: np.ndarray
    steps: int
    closed: bool

    def residuals(self, q: np.ndarray, theta: np.ndarray) -> np.ndarray:
        """Norms of A x - theta x for x = basis q with columns of norm 1, as far as inner products tell them."""
        square = np.einsum("ij,ij->j", q.conj(), self.images @ q).real - np.abs(theta) ** 2
        return np.sqrt(np.maximum(square, 0))


def shared_space(parts: Parts, b: RDD, k: int, most: int, enough: Callable[[Space], bool] = lambda space: False) -> Space:
    """The block Krylov space of the state's ``k`` columns "b", without restarts, for all functions and shifts of a symmetric matrix: a job a step, until
    ``enough``, ``most`` steps or the space closes."""
    state = b.map(lambda s: {"b": s["b"], "v": s["b"], "av": np.zeros((len(s["b"]), 0))})
    turn, first, h = None, 0, None

    def told(part: Part, s: State) -> np.ndarray:
        every = np.hstack([s["v"], s["av"], s["b"]])
        return every.T @ every

    for step in range(1, most + 1):

        def before(part: Part, s: State, turn=turn, first=first, h=h) -> State:
            if turn is None:
                return s
            v, av = np.hstack([s["v"][:, :first], s["v"] @ turn[:, first:]]), np.hstack([s["av"][:, :first], s["av"] @ turn[:, first:]])
            return s | {"v": np.hstack([v, av[:, first:] - v @ h[:, first:]]), "av": av}  # the last block's images, less what the basis has of them

        old = 0 if turn is None else turn.shape[1]
        state, g = parts.step(state, before, lambda s: s["v"][:, s["av"].shape[1] :], lambda part, s, y: s | {"av": np.hstack([s["av"], y])}, told)
        m = (len(g) - k) // 2
        # the columns before are orthonormal; of the new ones what they share with those goes
        lead, new = np.eye(m)[:, :old], np.eye(m)[:, old:]
        new = new - lead @ g[:old, old:m]
        size = np.sqrt(np.abs(np.diag(new.T @ g[:m, :m] @ new)))
        images = np.sqrt(np.abs(np.diag(g[m : 2 * m, m : 2 * m])).max(initial=0))
        new = new[:, size > 1e-11 * (images if old else 1e-300)]
        own = new @ _independent(new.T @ g[:m, :m] @ new, 1e-13) if new.shape[1] else new
        turn, first = np.hstack([lead, own]), old
        h = turn.T @ g[:m, m : 2 * m] @ turn
        h = (h + h.T) / 2
        space = Space(state, turn, h, turn.T @ g[:m, 2 * m :], turn.T @ g[m : 2 * m, m : 2 * m] @ turn, step, turn.shape[1] == old)
        if space.closed or enough(space):
            break
    return space


def contour_eigenpairs(parts: Parts, centre: float, radius: float, nodes: int = 32, block: int = 8, moments: int = 4, most: int = 60, tol: float = 1e-6, seed: int = 0) -> Found:
    """Eigenpairs of a symmetric matrix inside a circle around a real centre, by the moments of the resolvent over all nodes at once.

    The systems (z - A) X = B of all nodes share one block Krylov space, so that products with the matrix do not depend on the number of nodes; what each
    node asks for is a small system. The space grows until the pairs inside are found to ``tol``. A value with more copies than ``block`` shows that many."""
    b = parts.start(lambda part: {"b": _noise(np.arange(part.lo, part.hi), block, seed)})
    angle = 2 * np.pi * (np.arange(nodes) + 0.5) / nodes
    z, weight = centre + radius * np.exp(1j * angle), np.exp(1j * angle) / nodes

    def inside(space: Space) -> tuple[np.ndarray, np.ndarray]:
        eye = np.eye(len(space.h))
        x = np.linalg.solve(z[:, None, None] * eye - space.h, np.broadcast_to(space.lead.astype(complex), (nodes, *space.lead.shape)))
        s = np.hstack([np.einsum("j,jik->ik", weight * np.exp(1j * angle) ** p, x).real for p in range(moments)])
        u, size, _ = np.linalg.svd(s, full_matrices=False)
        q = u[:, size > 1e-10 * size.max(initial=1e-300)]
        theta, y = np.linalg.eigh(q.T @ space.h @ q)
        some = np.abs(theta - centre) <= radius
        return theta[some], q @ y[:, some]

    def enough(space: Space) -> bool:
        theta, q = inside(space)
        return space.steps > 2 and len(theta) > 0 and bool((space.residuals(q, theta) <= max(tol, 4e-8) * np.abs(space.h).sum(0).max()).all())

    space = shared_space(parts, b, block, most, enough)
    theta, q = inside(space)
    q = space.turn @ q
    final = parts.parts.zip(space.state).map(lambda both: {"x": both[1]["v"] @ q, "r": both[1]["av"] @ q - both[1]["v"] @ (q * theta)}).persist(StorageLevel.MEMORY_AND_DISK)
    residuals = np.sqrt(parts.look(final, lambda part, s: (s["r"] ** 2).sum(0)))
    parts._kept.append(final)
    good = residuals <= 2 * tol * np.abs(space.h).sum(0).max()
    return Found(theta, residuals, parts.frame(final, lambda s: s["x"]), space.steps, bool(good.all()), int(good.sum()))


def shifted_solutions(parts: Parts, b: DataFrame, k: int, shifts: list[float], tol: float = 1e-9, most: int = 200) -> Solved:
    """(A + s I) X = B for all ``shifts`` s from one Krylov space: the frame's arrays hold the solutions shift after shift. A may be indefinite with
    them; residuals are measured from B - (A + s I) X, relative to B."""
    eye = lambda space: np.eye(len(space.h))
    small = lambda space: np.stack([np.linalg.solve(space.h + s * eye(space), space.lead) for s in shifts])
    size = None

    def enough(space: Space) -> bool:
        y = small(space)
        # B - (A + s) X = B - images y - s X, from inner products
        off = 0.0
        for s, x in zip(shifts, y):
            hx = space.h @ x
            square = np.einsum("ij,ij->j", x, space.images @ x) - np.einsum("ij,ij->j", hx, hx)
            off = max(off, float(np.sqrt(np.maximum(square, 0) / np.maximum((space.lead**2).sum(0), 1e-300)).max()))
        return off <= max(tol / 10, 3e-8)

    space = shared_space(parts, parts.vectors(b, k), k, most, enough)
    y = np.hstack([space.turn @ x for x in small(space)])
    shift = np.repeat(np.asarray(shifts, float), k)
    count = len(shifts)

    def told(part: Part, s: State) -> np.ndarray:
        return np.stack([((np.tile(s["b"], count) - s["av"] @ y - (s["v"] @ y) * shift) ** 2).sum(0), np.tile((s["b"] ** 2).sum(0), count)])

    off, size = parts.look(space.state, told)
    residuals = np.sqrt(off / np.where(size > 0, size, 1))
    return Solved(parts.frame(space.state, lambda s: s["v"] @ y), residuals, space.steps, bool((residuals <= max(tol, 1e-7)).all()))


# --- Lyapunov equations ------------------------------------------------------------------------------------------


@dataclass
class Factor:
    """Z, a frame of ``rank`` columns, with X = Z Z'; the trace of X and the relative residual of the equation in the Frobenius norm."""

    z: DataFrame
    rank: int
    trace: float
    residual: float
    steps: int
    converged: bool

    def checked(self) -> Factor:
        if not self.converged:
            raise NotConverged(f"a relative residual of {self.residual:.2e} after {self.steps} steps")
        return self


def lyapunov(parts: Parts, b: DataFrame, k: int = 1, shift: float = 0.0, tol: float = 1e-7, most: int = 120) -> Factor:
    """A low-rank factor of X in M X + X M = B B', M = A + shift I symmetric and positive definite, for the ``k`` columns of B at once.

    The equation is solved in the block Krylov space of B, which stays beside the matrix; the residual has only the part of the last block's images outside of the
    space. Inner products tell it to the root of the rounding of the matrix' squared norm, so that where they can tell no more it is measured beside the matrix. The factor is
    cut to what the tolerance needs."""
    bar = max(tol, 1e-8)

    def small(space: Space) -> tuple[np.ndarray, float, float]:
        """The small solution, its residual by inner products, and how far rounding may put that off."""
        w, q = np.linalg.eigh(space.h)
        w = w + shift
        if w.min() <= 0:
            raise NotConverged("the matrix is not positive definite")
        c = q.T @ space.lead
        y = q @ ((c @ c.T) / (w[:, None] + w[None, :])) @ q.T
        outside = space.images - space.h @ space.h  # of the images, what the space does not hold
        off, doubt = max(2 * np.trace(y @ outside @ y), 0.0), 2 * len(y) * np.finfo(float).eps * np.trace(space.images) * np.linalg.norm(y) ** 2
        whole = max(np.linalg.norm(space.lead.T @ space.lead), 1e-300)
        return y, float(np.sqrt(off) / whole), float(np.sqrt(doubt) / whole)

    def measured(space: Space, y: np.ndarray) -> float:
        size, u = np.linalg.eigh((y + y.T) / 2)
        some = np.abs(size) > 1e-17 * np.abs(size).max(initial=0)
        f = u[:, some] * size[some]
        image, inside = space.turn @ f, space.turn @ (space.h @ f)
        off = parts.look(space.state, lambda part, s: ((s["av"] @ image - s["v"] @ inside) ** 2).sum())
        return float(np.sqrt(2 * off) / max(np.linalg.norm(space.lead.T @ space.lead), 1e-300))

    def enough(space: Space) -> bool:
        y, off, doubt = small(space)
        return off <= max(bar, doubt) and measured(space, y) <= bar

    space = shared_space(parts, parts.vectors(b, k), k, most, enough)
    y = small(space)[0]
    off = measured(space, y)
    size, u = np.linalg.eigh((y + y.T) / 2)
    some = size > max(tol, 1e-14) * 1e-2 * size.max(initial=1e-300)
    f = space.turn @ (u[:, some] * np.sqrt(size[some]))
    return Factor(parts.frame(space.state, lambda s: s["v"] @ f), int(some.sum()), float(np.trace(y)), off, space.steps, off <= 10 * bar)
