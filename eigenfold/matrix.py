"""Matrices as DataFrames of coordinates, and what Spark does with them.

A matrix is (i, j, v) or, if complex, (i, j, v, vi); entries at one place add up. A product with a block of vectors takes one of
two plans. While the vectors fit the driver's bound (``VECTOR_BYTES``), they are broadcast and every task multiplies its compressed
rows, all in one job without a shuffle; tasks own disjoint rows of the answer. Beyond that the vectors are a DataFrame (i, x array) too, and
the product is an equi-join on j with a partial and a final sum by i.
"""

from __future__ import annotations

import math
import tempfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Vectors are broadcast and gathered up to this size; more live in DataFrames.
VECTOR_BYTES = 256 << 20
#: Matrices up to this many rows may be gathered and treated as dense.
DENSE_ROWS = 2000
#: A task's share of a matrix: about this many entries (24 bytes each, 32 if complex), written in rows of ``CHUNK`` entries.
ENTRIES, CHUNK = 4_000_000, 500_000
#: Sparse matrices of up to this many entries (24 MB) are gathered too, for solvers that take thousands of products.
GATHERED = 1_000_000
#: Fewer entries than these are not worth a task of their own.
FEW = 200_000


class NotConverged(ArithmeticError):
    """An iteration ended before its tolerance, or met a matrix that it is not for."""


def _real(*frames: DataFrame) -> None:
    if any("vi" in df.columns for df in frames):
        raise ValueError("a product of frames with real vectors has no place for an imaginary part")


def _parts(df: DataFrame, v: str = "v", vi: str = "vi") -> tuple[Column, Column]:
    """Real and imaginary part; 0 where there is none."""
    return F.col(v).cast("double"), F.col(vi).cast("double") if vi in df.columns else F.lit(0.0)


def checkpointed(df: DataFrame) -> DataFrame:
    """Written to the session's ``spark.checkpoint.dir`` and read back; a temporary folder only where that is unset on one machine."""
    sc = df.sparkSession.sparkContext
    if not df.sparkSession.conf.get("spark.checkpoint.dir", None) and sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("a cluster needs a shared folder in spark.checkpoint.dir")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoint-"))
    return df.checkpoint()


def joined_sum(matrix: DataFrame, vector: DataFrame) -> DataFrame:
    """y = A x over frames (i, j, v) and (i, x double): join on the inner index, sum by the outer."""
    _real(matrix, vector)
    x = vector.select(F.col("i").alias("j"), "x")
    return matrix.join(x, "j").groupBy("i").agg(F.sum(F.col("v") * F.col("x")).alias("x"))


def joined_block(matrix: DataFrame, block: DataFrame, k: int) -> DataFrame:
    """Y = A X for a block (i, x array<double>) of k columns."""
    _real(matrix, block)
    x = block.select(F.col("i").alias("j"), "x")
    sums = [F.sum(F.col("v") * F.col("x")[c]).alias(f"s{c}") for c in range(k)]
    return matrix.join(x, "j").groupBy("i").agg(*sums).select("i", F.array(*[f"s{c}" for c in range(k)]).alias("x"))


def matmul(a: DataFrame, b: DataFrame) -> DataFrame:
    """The coordinates of A B: an equi-join on the inner index. Complex if one of them is."""
    if "vi" in a.columns or "vi" in b.columns:
        right = b.select(F.col("i").alias("m"), F.col("j").alias("q"), *[c.alias(n) for c, n in zip(_parts(b), ("w", "wi"))])
        left = a.select("i", F.col("j").alias("m"), *[c.alias(n) for c, n in zip(_parts(a), ("v", "vi"))])
        re, im = F.expr("v * w - vi * wi"), F.expr("v * wi + vi * w")
        return left.join(right, "m").groupBy("i", F.col("q").alias("j")).agg(F.sum(re).alias("v"), F.sum(im).alias("vi"))
    right = b.select(F.col("i").alias("m"), F.col("j").alias("q"), F.col("v").alias("w"))
    return a.withColumnRenamed("j", "m").join(right, "m").groupBy("i", F.col("q").alias("j")).agg(F.sum(F.col("v") * F.col("w")).alias("v"))


def combined(terms: list[tuple[float, DataFrame]]) -> DataFrame:
    """sum of c A: a union and one sum by place. Complex if a factor or a matrix is."""
    names = ["v", "vi"] if any(isinstance(c, complex) or "vi" in df.columns for c, df in terms) else ["v"]

    def scaled(c: complex, df: DataFrame) -> DataFrame:
        re, im = _parts(df)
        parts = [F.lit(float(c.real)) * re - F.lit(float(c.imag)) * im, F.lit(float(c.real)) * im + F.lit(float(c.imag)) * re] if len(names) > 1 else [F.lit(float(c)) * F.col("v")]
        return df.select("i", "j", *[x.alias(n) for x, n in zip(parts, names)])

    frames = [scaled(c, df) for c, df in terms]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out.groupBy("i", "j").agg(*[F.sum(n).alias(n) for n in names])


def transposed(df: DataFrame) -> DataFrame:
    rest = [c for c in df.columns if c not in ("i", "j")]
    return df.select(F.col("j").alias("i"), F.col("i").alias("j"), *rest)


def tiled(spark: SparkSession, blocks: list[list[tuple[float, DataFrame] | None]], rows: int, cols: int) -> DataFrame:
    """[a A, b B; c C, d D] and larger tilings of equal blocks of rows x cols. Complex if a block is."""
    out, cplx = None, any(cell is not None and "vi" in cell[1].columns for line in blocks for cell in line)
    for r, line in enumerate(blocks):
        for c, cell in enumerate(line):
            if cell is not None:
                scale, df = cell
                held = [(F.lit(float(scale)) * x).alias(n) for x, n in zip(_parts(df) if cplx else (F.col("v"),), ("v", "vi"))]
                part = df.select((F.col("i") + r * rows).alias("i"), (F.col("j") + c * cols).alias("j"), *held)
                out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], "i long, j long, v double")


def bse(r: DataFrame, c: DataFrame, n: int) -> DataFrame:
    """[R C; -C^H -R^T] of real or complex coordinates."""
    cplx = "vi" in r.columns or "vi" in c.columns

    def block(df: DataFrame, row: int, col: int, sign: float, swap: bool, conj: bool) -> DataFrame:
        i, j = (F.col("j"), F.col("i")) if swap else (F.col("i"), F.col("j"))
        cols = [(i + row * n).alias("i"), (j + col * n).alias("j"), (sign * F.col("v")).alias("v")]
        if cplx:
            vi = F.col("vi") if "vi" in df.columns else F.lit(0.0)
            cols.append(((-sign if conj else sign) * vi).alias("vi"))
        return df.select(*cols)

    return block(r, 0, 0, 1, False, False).unionByName(block(c, 0, 1, 1, False, False)).unionByName(block(c, 1, 0, -1, True, True)).unionByName(block(r, 1, 1, -1, True, False))


def gram_frame(df: DataFrame) -> DataFrame:
    """(i, j, v) of A^H A: a self-join on the row."""
    flip = transposed(df)
    return matmul(flip.withColumn("vi", -F.col("vi")) if "vi" in df.columns else flip, df)


def balanced_frame(df: DataFrame, tol: float = 1e-10, most: int = 100) -> tuple[DataFrame, DataFrame, int]:
    """D^-1 A D with rows and columns of equal sums of sizes off the diagonal, D as (i, d), and the rounds it took.

    A round is one aggregation: each entry gives its scaled size to its row and its column, and each place is moved by their ratio to the power of 3/8 (the square root would
    swing, since both ends of an entry move at once). Places without a row or a column off the diagonal stay. Raises if the ratios do not settle."""
    _real(df)
    off = checkpointed(df.where("i <> j AND v <> 0").select("i", "j", F.abs("v").alias("a")))
    d = None
    for rounds in range(1, most + 1):
        sized = off
        if d is not None:
            sized = off.join(d, "i", "left").join(d.select(F.col("i").alias("j"), F.col("d").alias("e")), "j", "left")
            sized = sized.select("i", "j", (F.col("a") * F.coalesce("e", F.lit(1.0)) / F.coalesce("d", F.lit(1.0))).alias("a"))
        ends = F.explode(F.array(F.struct(F.col("i").alias("i"), F.col("a").alias("r"), F.lit(0.0).alias("c")), F.struct(F.col("j").alias("i"), F.lit(0.0).alias("r"), F.col("a").alias("c")))).alias("e")
        sums = sized.select(ends).groupBy("e.i").agg(F.sum("e.r").alias("r"), F.sum("e.c").alias("c")).where("r > 0 AND c > 0")
        move = sums.select("i", F.pow(F.col("r") / F.col("c"), F.lit(0.375)).alias("f"))
        d = checkpointed((move if d is None else d.join(move, "i", "full")).select("i", (F.col("f") if d is None else F.coalesce("d", F.lit(1.0)) * F.coalesce("f", F.lit(1.0))).alias("d"), F.coalesce("f", F.lit(1.0)).alias("f")))
        if (d.agg(F.max(F.abs(F.log("f")))).first()[0] or 0.0) <= tol:
            break
        d = d.drop("f")
    else:
        raise NotConverged(f"balancing did not settle in {most} rounds")
    d = d.select("i", "d")
    right = d.select(F.col("i").alias("j"), F.col("d").alias("e"))
    scaled = df.join(d, "i", "left").join(right, "j", "left").select("i", "j", (F.col("v") * F.coalesce("e", F.lit(1.0)) / F.coalesce("d", F.lit(1.0))).alias("v"))
    return scaled, d, rounds


@dataclass
class Operator:
    """A linear map given by callables on blocks of vectors (rows by columns)."""

    n: int
    apply: Callable[[np.ndarray], np.ndarray]
    adjoint: Callable[[np.ndarray], np.ndarray] | None = None
    m: int | None = None
    complex: bool = False
    diagonal: np.ndarray | None = None
    norm: float | None = None
    symmetric: Callable[[], bool] | None = None

    @property
    def rows(self) -> int:
        return self.n if self.m is None else self.m

    def dense(self) -> np.ndarray:
        if self.n > DENSE_ROWS:
            raise ValueError(f"{self.n} columns are more than DENSE_ROWS = {DENSE_ROWS}")
        return self.apply(np.eye(self.n))


def of_array(a: np.ndarray) -> Operator:
    a = np.asarray(a)
    return Operator(a.shape[1], lambda x: a @ x, lambda x: a.conj().T @ x, a.shape[0], np.iscomplexobj(a), np.diagonal(a).copy(), float(np.abs(a).sum(1).max(initial=0)))


def of_entries(i: np.ndarray, j: np.ndarray, v: np.ndarray, rows: int, cols: int, symmetric: Callable[[], bool] | None = None) -> Operator:
    """The operator of coordinates in memory."""

    def product(to: np.ndarray, at: np.ndarray, v: np.ndarray, size: int) -> Callable[[np.ndarray], np.ndarray]:
        order = np.argsort(to, kind="stable")
        to, at, v = to[order], at[order], v[order]
        first = np.flatnonzero(np.diff(to, prepend=-1))
        lines = to[first]

        def apply(x: np.ndarray) -> np.ndarray:
            y = np.zeros((size, *x.shape[1:]), np.result_type(v, x))
            if len(first):
                y[lines] = np.add.reduceat(v * x[at], first) if x.ndim == 1 else np.add.reduceat(v[:, None] * x[at], first, axis=0)
            return y

        return apply

    d = np.zeros(min(rows, cols), v.dtype)
    np.add.at(d, i[i == j], v[i == j])
    apply = product(i, j, v, rows)
    norm = float(np.bincount(i, np.abs(v), rows).max(initial=0))
    return Operator(cols, apply, product(j, i, v.conj(), cols), rows, np.iscomplexobj(v), d if rows == cols else None, norm, symmetric)


@dataclass
class Matrix:
    """``df`` with its numbers of rows and columns."""

    df: DataFrame
    rows: int
    cols: int
    partitions: int | None = None
    gathered: int = GATHERED
    _packed: RDD | None = field(default=None, repr=False)
    _flipped: Matrix | None = field(default=None, repr=False)

    @property
    def complex(self) -> bool:
        return "vi" in self.df.columns

    @property
    def spark(self) -> SparkSession:
        return self.df.sparkSession

    @property
    def T(self) -> Matrix:
        return Matrix(transposed(self.df), self.cols, self.rows, self.partitions, self.gathered)

    def packed(self) -> RDD:
        """Compressed rows, kept by the executors (lost parts are made again): each element has some rows of the matrix, whose
        numbers, first entries, columns and values are arrays as bytes. A row of the matrix lies in one task. They are an RDD, since a product
        is nothing but work on partitions, and a frame would be planned, and its cache looked at by a job of its own, each time."""
        if self._packed is None:
            entries = self.df.count()
            n = self.partitions or max(math.ceil(entries / ENTRIES), min(self.spark.sparkContext.defaultParallelism, math.ceil(entries / FEW)), 1)
            width = max(1, -(-self.rows // (4 * n)))
            salted = F.pmod(F.xxhash64(F.floor(F.col("i") / width)), F.lit(n))
            dealt = self.df.select("i", "j", F.col("v").cast("double"), *(["vi"] if self.complex else [])).repartition(n, salted).sortWithinPartitions("i")
            cplx = self.complex

            def compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for b in batches:
                    for at in range(0, b.num_rows, CHUNK):
                        part = b.slice(at, CHUNK)
                        i, j, v = (part.column(c).to_numpy() for c in ("i", "j", "v"))
                        if cplx:
                            v = v + 1j * part.column("vi").to_numpy()
                        first = np.flatnonzero(np.diff(i, prepend=i[0] - 1))
                        yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (i[first].astype("<i8"), first.astype("<i8"), j.astype("<i8"), v)], ["i", "first", "j", "v"])

            self._packed = dealt.mapInArrow(compress, "i binary, first binary, j binary, v binary").rdd.map(tuple).persist(StorageLevel.MEMORY_AND_DISK)
        return self._packed

    def unpersist(self) -> None:
        if self._packed is not None:
            self._packed.unpersist()
            self._packed = None
        if self._flipped is not None:
            self._flipped.unpersist()
            self._flipped = None

    def apply(self, x: np.ndarray) -> np.ndarray:
        """A x for one or more columns: one job, in which each task gives its rows of the answer once."""
        if x.ndim == 1:
            return self.apply(x[:, None])[:, 0]
        x = np.ascontiguousarray(x, complex if np.iscomplexobj(x) else float)
        if max(x.nbytes, self.rows * x.shape[1] * 16) > VECTOR_BYTES:
            raise MemoryError("the vectors exceed VECTOR_BYTES; use frames (joined_block, basis.Frames)")
        # a short block travels with the job itself
        held, kind = self.spark.sparkContext.broadcast(x) if x.nbytes > 1 << 19 else None, "<c16" if self.complex else "<f8"
        small = x if held is None else None
        answer = np.dtype(complex if self.complex or np.iscomplexobj(x) else float)

        def run(pieces: Iterator[tuple]) -> Iterator[tuple[bytes, bytes]]:
            x, rows, parts = small if held is None else held.value, [], []
            for i, first, j, v in pieces:
                first, j, v = np.frombuffer(first, "<i8"), np.frombuffer(j, "<i8"), np.frombuffer(v, kind)
                rows.append(np.frombuffer(i, "<i8"))
                parts.append(np.stack([np.add.reduceat(v * c[j], first) for c in x.T], 1))
            if rows:
                i, y = np.concatenate(rows), np.concatenate(parts).astype(answer, copy=False)
                first = np.flatnonzero(np.diff(i, prepend=i[0] - 1))  # a row may go on in the next chunk
                yield i[first].tobytes(), np.ascontiguousarray(np.add.reduceat(y, first, axis=0)).tobytes()

        result = np.zeros((self.rows, x.shape[1]), answer)
        for to, y in self.packed().mapPartitions(run).collect():
            to = np.frombuffer(to, "<i8")
            result[to] = np.frombuffer(y, answer).reshape(len(to), -1)
        if held is not None:
            held.unpersist()
        return result

    def adjoint(self, x: np.ndarray) -> np.ndarray:
        """A^H x: the transpose has its own compressed rows, so that this is one job without a shuffle too."""
        if self._flipped is None:
            self._flipped = self.T
        return self._flipped.apply(x.conj()).conj() if self.complex else self._flipped.apply(x)

    def dense(self) -> np.ndarray:
        if max(self.rows, self.cols) > DENSE_ROWS:
            raise ValueError(f"{self.rows} x {self.cols} is more than DENSE_ROWS = {DENSE_ROWS}")
        # sums by place first, so that no more than rows * cols entries arrive
        vi = [F.sum("vi").alias("vi")] if self.complex else []
        t = self.df.groupBy("i", "j").agg(F.sum("v").alias("v"), *vi).toArrow()
        a = np.zeros((self.rows, self.cols), complex if self.complex else float)
        if t.num_rows:
            a[t.column("i").to_numpy(), t.column("j").to_numpy()] = t.column("v").to_numpy() + (1j * t.column("vi").to_numpy() if self.complex else 0)
        return a

    def diagonal(self) -> np.ndarray:
        d = np.zeros(min(self.rows, self.cols), complex if self.complex else float)
        vi = [F.sum("vi").alias("vi")] if self.complex else []
        for r in self.df.where("i = j").groupBy("i").agg(F.sum("v").alias("v"), *vi).toLocalIterator():
            d[r["i"]] = r["v"] + (1j * r["vi"] if self.complex else 0)
        return d

    def _size(self) -> Column:
        return F.hypot("v", "vi") if self.complex else F.abs("v")

    def _places(self) -> DataFrame:
        vi = [F.sum("vi").alias("vi")] if self.complex else []
        return self.df.groupBy("i", "j").agg(F.sum("v").alias("v"), *vi)

    def norm(self, kind: str = "inf") -> float:
        return self.norms(kind)[kind]

    def norms(self, *kinds: str) -> dict[str, float]:
        """Several norms ("frobenius", "inf", "one") from one reading of the coordinates."""
        places = self._places().select("i", "j", self._size().alias("a"))
        lines = places.select(F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("i").alias("at")), F.struct(F.lit(1).alias("side"), F.col("j").alias("at")))).alias("k"), "a")
        found = lines.groupBy("k").agg(F.sum("a").alias("s"), F.sum(F.col("a") * F.col("a")).alias("q")).groupBy("k.side").agg(F.max("s").alias("s"), F.sum("q").alias("q")).collect()
        by = {r["side"]: r for r in found}
        every = {"frobenius": math.sqrt(by[0]["q"]) if by else 0.0, "inf": by[0]["s"] if by else 0.0, "one": by[1]["s"] if by else 0.0}
        return {k: float(every[k]) for k in kinds}

    def norm_estimate(self, steps: int = 8, seed: int = 0) -> float:
        """A lower estimate of the 2-norm by the power iteration on A^H A."""
        x = np.random.default_rng(seed).standard_normal(self.cols)
        size = 0.0
        for _ in range(steps):
            x /= np.linalg.norm(x)
            y = self.apply(x)
            size, x = float(np.linalg.norm(y)), self.adjoint(y)
        return size

    def hermitian(self) -> bool:
        """Whether A - A^H vanishes."""
        places = self._places()
        cols = ["i", "j", "v"] + ["vi"] * self.complex
        flip = places.select(F.col("j").alias("i"), F.col("i").alias("j"), (-F.col("v")).alias("v"), *([F.col("vi")] if self.complex else []))
        both = places.select(*cols).unionByName(flip.select(*cols)).groupBy("i", "j").agg(F.sum("v").alias("v"), *([F.sum("vi").alias("vi")] if self.complex else []))
        worst = both.agg(F.max(self._size())).first()[0] or 0.0
        return worst <= 1e-12 * max(self.norm("inf"), 1e-300)

    def operator(self) -> Operator:
        """Up to DENSE_ROWS rows, or ``gathered`` entries, a matrix is gathered once and multiplied on the driver; a larger one stays with
        the executors."""
        if max(self.rows, self.cols) <= DENSE_ROWS:
            return of_array(self.dense())
        if self.gathered and self.df.limit(self.gathered + 1).count() <= self.gathered:
            t = self.df.toArrow()
            i, j, v = (t.column(c).to_numpy() for c in ("i", "j", "v"))
            return of_entries(i, j, v + 1j * t.column("vi").to_numpy() if self.complex else v.astype(float), self.rows, self.cols, self.hermitian)
        return Operator(self.cols, self.apply, self.adjoint, self.rows, self.complex, self.diagonal() if self.rows == self.cols else None, self.norm("inf"), self.hermitian)


def dense_rows(df: DataFrame, key: str, vector: str) -> DataFrame:
    """Coordinates of rows kept as arrays; keys are numbered as they are."""
    return df.select(F.col(key).cast("long").alias("i"), F.posexplode(vector).alias("j", "v")).select("i", F.col("j").cast("long").alias("j"), F.col("v").cast("double").alias("v"))


def as_operator(a) -> Operator:
    if isinstance(a, Operator):
        return a
    if isinstance(a, Matrix):
        return a.operator()
    return of_array(np.asarray(a))
