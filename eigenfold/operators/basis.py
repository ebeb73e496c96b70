"""Bases: tall blocks of vectors as DataFrames (i, x array<double>), rows anywhere, columns in the array.

Products with small matrices are narrow passes with the small matrix broadcast; Gram matrices, norms and
factors are partial results of the tasks, a small matrix each, added up or factored again on the driver.
The numpy forms at the end serve bases that fit the driver.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..matrix import checkpointed, joined_block

#: Partial results of more tasks than these do not go to the driver one by one.
TASKS_AT_ONCE = 64


def rows_of(batch: pa.RecordBatch, name: str = "x") -> np.ndarray:
    """The rows of an array column as one array. A null vector, a null component or rows of different lengths are an error: rows that take no
    part have to be left out before."""
    column = batch.column(name)
    if column.null_count:
        raise ValueError(f"{column.null_count} null vectors in column {name}")
    flat = column.flatten()
    if flat.null_count:
        raise ValueError(f"{flat.null_count} null components in column {name}")
    lengths = np.diff(column.offsets.to_numpy()) if hasattr(column, "offsets") else np.full(len(column), column.type.list_size)
    if len(lengths) and (lengths != lengths[0]).any():
        raise ValueError(f"vectors of {lengths.min()} to {lengths.max()} components in column {name}")
    return flat.to_numpy(zero_copy_only=False).astype(float, copy=False).reshape(len(column), -1 if len(column) and lengths[0] else 0)


def _arrays(x: np.ndarray) -> pa.Array:
    return pa.FixedSizeListArray.from_arrays(pa.array(np.ascontiguousarray(x).ravel()), max(x.shape[1], 1)).cast(pa.list_(pa.float64()))


def mapped(basis: DataFrame, fn: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """Each batch's rows, given (i, x), replaced."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b.column("i"), _arrays(fn(b.column("i").to_numpy(), rows_of(b)))], ["i", "x"])

    return basis.select("i", "x").mapInArrow(run, "i long, x array<double>")


def reduced(frame: DataFrame, fn: Callable[[pa.RecordBatch], np.ndarray], how: str | Callable = "sum") -> np.ndarray | None:
    """One small matrix from each task's batches, added up ("sum") or stacked and factored ("qr"); tasks send one
    matrix each, and beyond ``TASKS_AT_ONCE`` tasks those are merged in groups on the executors."""

    def fold(a: np.ndarray | None, b: np.ndarray) -> np.ndarray:
        if a is None:
            return b
        if callable(how):
            return how(a, b)
        return a + b if how == "sum" else np.maximum(a, b) if how == "max" else np.linalg.qr(np.vstack([a, b]), mode="r")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if b.num_rows:
                total = fold(total, fn(b))
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()], pa.list_(pa.float64())), pa.array([total.shape[0]])], ["m", "r"])

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        total = None
        for m, r in zip(group["m"], group["r"]):
            total = fold(total, np.asarray(m).reshape(r, -1))
        return pd.DataFrame({"m": [total.ravel()], "r": [total.shape[0]]})

    parts = frame.mapInArrow(run, "m array<double>, r long")
    tasks = frame.rdd.getNumPartitions()
    if tasks > TASKS_AT_ONCE:  # in a tree: groups of tasks first, so that the driver gets a few matrices
        groups = F.pmod(F.spark_partition_id(), F.lit(math.ceil(math.sqrt(tasks))))
        parts = parts.withColumn("g", groups).groupBy("g").applyInPandas(lambda g: merge(g), "m array<double>, r long")
    out = None
    for row in parts.collect():
        out = fold(out, np.array(row["m"]).reshape(row["r"], -1))
    return out


class Phase:
    """Reductions asked for one by one and made in one pass: ``begin`` gives a number, ``end`` all results in that order."""

    def __init__(self, frame: DataFrame):
        self.frame, self.asked = frame, []

    def begin(self, fn: Callable[[pa.RecordBatch], np.ndarray]) -> int:
        self.asked.append(fn)
        return len(self.asked) - 1

    def dot(self, at: list[int] | slice = slice(None), other: list[int] | slice = slice(None)) -> int:
        """Products of some columns with others."""
        return self.begin(lambda b: (x := rows_of(b))[:, at].T @ x[:, other])

    def norm(self, at: list[int] | slice = slice(None)) -> int:
        """Squares of the columns' norms."""
        return self.begin(lambda b: (rows_of(b)[:, at] ** 2).sum(0)[None, :])

    def end(self) -> list[np.ndarray]:
        asked, self.asked = self.asked, []

        def every(b: pa.RecordBatch) -> np.ndarray:
            parts = [np.atleast_2d(fn(b)) for fn in asked]
            shapes = np.array([p.shape for p in parts], float).ravel()
            return np.concatenate([shapes, *[p.ravel() for p in parts]])[None, :]

        k = 2 * len(asked)
        total = reduced(self.frame, every, lambda a, b: np.hstack([a[:, :k], a[:, k:] + b[:, k:]]))
        if total is None:
            return [np.zeros((0, 0)) for _ in asked]
        shapes, at, out = total[0, :k].astype(int).reshape(-1, 2), k, []
        for r, c in shapes:
            out.append(total[0, at : at + r * c].reshape(r, c))
            at += r * c
        return out


def multiply(basis: DataFrame, q: np.ndarray) -> DataFrame:
    """X Q: narrow."""
    held = basis.sparkSession.sparkContext.broadcast(np.asarray(q))
    return mapped(basis, lambda i, x: x @ held.value)


def updated(y: DataFrame, x: DataFrame, q: np.ndarray, alpha: float = 1.0, beta: float = 1.0) -> DataFrame:
    """beta Y + alpha X Q, matched by row."""
    both = y.select("i", F.col("x").alias("y")).join(x, "i")
    held = y.sparkSession.sparkContext.broadcast(np.asarray(q))

    def run(batches):
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b.column("i"), _arrays(beta * rows_of(b, "y") + alpha * rows_of(b) @ held.value)], ["i", "x"])

    return both.select("i", "y", "x").mapInArrow(run, "i long, x array<double>")


def gram(basis: DataFrame) -> np.ndarray:
    """X^T X."""
    return reduced(basis.select("x"), lambda b: (x := rows_of(b)).T @ x)


def dot(y: DataFrame, x: DataFrame) -> np.ndarray:
    """Y^T X, matched by row."""
    both = y.select("i", F.col("x").alias("y")).join(x, "i").select("y", "x")
    return reduced(both, lambda b: rows_of(b, "y").T @ rows_of(b))


def norms(basis: DataFrame) -> dict[str, float]:
    """frobenius, max, one and inf from one pass. Squares are scaled by the task's largest entry, so that they neither overflow nor vanish."""

    def part(b: pa.RecordBatch) -> np.ndarray:
        x = np.abs(rows_of(b))
        top = float(x.max(initial=0))
        return np.concatenate([[top, ((x / top) ** 2).sum() if top else 0.0, x.sum(1).max(initial=0)], x.sum(0)])[None, :]

    def fold(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        top = max(a[0, 0], b[0, 0])
        square = sum(z[0, 1] * (z[0, 0] / top) ** 2 for z in (a, b)) if top else 0.0
        return np.concatenate([[top, square, max(a[0, 2], b[0, 2])], a[0, 3:] + b[0, 3:]])[None, :]

    out = reduced(basis.select("x"), part, fold)
    if out is None:
        return dict.fromkeys(("frobenius", "max", "one", "inf"), 0.0)
    return {"frobenius": out[0, 0] * math.sqrt(out[0, 1]), "max": out[0, 0], "one": out[0, 3:].max(), "inf": out[0, 2]}


def norm(basis: DataFrame, kind: str = "frobenius") -> float:
    found = norms(basis)
    if kind not in found:
        raise ValueError(f"no such norm: {kind}")
    return float(found[kind])


def column_norms(basis: DataFrame) -> np.ndarray:
    return np.sqrt(reduced(basis.select("x"), lambda b: (rows_of(b) ** 2).sum(0)[None, :])[0])


def scaled(basis: DataFrame, factors) -> DataFrame:
    return multiply(basis, np.diag(np.atleast_1d(factors)))


def normalised(basis: DataFrame) -> DataFrame:
    return scaled(basis, 1 / np.maximum(column_norms(basis), 1e-300))


def orthogonalised(basis: DataFrame, method: str = "tsqr", block: int = 16) -> tuple[DataFrame, np.ndarray]:
    """Q, R with X = Q R: "tsqr" (R from a tree of QRs; X R^-1 twice), "chol" and "tsqrchol", "svqb", "gs" (Gram-Schmidt by ``block``
    columns, of which 1 is the classical one; three passes over the rows a block)."""
    if method in ("tsqr", "tsqrchol"):
        r = _upright(reduced(basis.select("x"), lambda b: np.linalg.qr(rows_of(b), mode="r"), "qr"))
        q = multiply(basis, np.linalg.pinv(r))
        if method == "tsqr":
            again = _upright(reduced(q.select("x"), lambda b: np.linalg.qr(rows_of(b), mode="r"), "qr"))
            return multiply(basis, np.linalg.pinv(again @ r)), again @ r
        return q, r
    if method == "chol":
        r = np.linalg.cholesky(gram(basis)).T
        return multiply(basis, np.linalg.inv(r)), r
    if method == "gs":
        t = _gram_schmidt(basis, block)
        return multiply(basis, t), np.linalg.inv(t)
    if method == "svqb":
        g = gram(basis)
        d = 1 / np.sqrt(np.maximum(np.diag(g), 1e-300))
        w, u = np.linalg.eigh(d[:, None] * g * d)
        s = (d[:, None] * u) / np.sqrt(np.maximum(w, w.max() * 1e-14))
        return multiply(basis, s), np.linalg.inv(s)
    raise ValueError(f"no such method: {method}")


def _gram_schmidt(basis: DataFrame, block: int) -> np.ndarray:
    """T upper triangular with X T orthonormal. A pass gives a block's products with all columns before it and its own Gram matrix, from
    the rows as they then are; the passes after the first take off what rounding has left."""
    k = len(basis.select("x").first()["x"])
    t = np.zeros((k, 0))
    for at in range(0, k, block):
        s = np.eye(k)[:, at : at + block]
        for _ in range(3):
            j, both = t.shape[1], np.hstack([t, s])

            def products(b: pa.RecordBatch, both=both, j=j) -> np.ndarray:
                y = rows_of(b) @ both
                return y.T @ y[:, j:]

            g = reduced(basis.select("x"), products)
            c, own = g[:j], g[j:]
            s = (s - t @ c) @ np.linalg.inv(np.linalg.cholesky(own - c.T @ c).T)
        t = np.hstack([t, s])
    return t


def _upright(r: np.ndarray) -> np.ndarray:
    """R with a nonnegative diagonal, square."""
    k = r.shape[1]
    if len(r) < k:
        r = np.vstack([r, np.zeros((k - len(r), k))])
    s = np.where(np.diag(r) < 0, -1.0, 1.0)
    return s[:, None] * r


def random(spark, n: int, k: int, kind: str = "normal", seed: int = 0, partitions: int | None = None) -> DataFrame:
    """n rows of k random entries, the same for a row whatever the partitions."""

    def draw(ids: np.ndarray) -> np.ndarray:
        out = np.empty((len(ids), k))
        for r, i in enumerate(ids):
            g = np.random.default_rng([seed, int(i)])
            out[r] = g.standard_normal(k) if kind == "normal" else g.uniform(-1, 1, k) if kind == "uniform" else np.sign(g.standard_normal(k))
        return out

    def run(batches):
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b.column(0), _arrays(draw(b.column(0).to_numpy()))], ["i", "x"])

    return spark.range(0, n, 1, partitions).select(F.col("id").alias("i")).mapInArrow(run, "i long, x array<double>")


def random_conditioned(n: int, k: int, cond: float, seed: int = 0) -> np.ndarray:
    """Random columns with a given condition number."""
    g = np.random.default_rng(seed)
    u, _ = np.linalg.qr(g.standard_normal((n, k)))
    v, _ = np.linalg.qr(g.standard_normal((k, k)))
    return u * np.geomspace(1, 1 / cond, k) @ v.T


def columns(basis: DataFrame, at: list[int]) -> DataFrame:
    return basis.select("i", F.array(*[F.col("x")[c] for c in at]).alias("x"))


def beside(left: DataFrame, right: DataFrame) -> DataFrame:
    """The columns of both."""
    return left.join(right.select("i", F.col("x").alias("y")), "i").select("i", F.concat("x", "y").alias("x"))


def split_rows(basis: DataFrame, at: int) -> tuple[DataFrame, DataFrame]:
    return basis.where(F.col("i") < at), basis.where(F.col("i") >= at).select((F.col("i") - at).alias("i"), "x")


def split_columns(basis: DataFrame, at: int, k: int) -> tuple[DataFrame, DataFrame]:
    return columns(basis, list(range(at))), columns(basis, list(range(at, k)))


def matmult(matrix: DataFrame, basis: DataFrame, k: int) -> DataFrame:
    """A X by a join; rows of A without entries give no row."""
    return joined_block(matrix, basis, k)


def projected(matrix: DataFrame, y: DataFrame, x: DataFrame, k: int) -> np.ndarray:
    """Y^T A X."""
    return dot(y, matmult(matrix, x, k))


def subspace_frames(matrix: DataFrame, n: int, k: int, steps: int = 30, tol: float = 1e-6, seed: int = 0, extra: int | None = None) -> tuple[np.ndarray, DataFrame, int]:
    """The k eigenvalues of largest magnitude of a symmetric matrix and their vectors, all in frames: block power steps,
    orthogonalisation by ``tsqr`` and a Rayleigh-Ritz step each round. For vectors beyond the driver's bound."""
    spark = matrix.sparkSession
    m = min(n, k + (extra if extra is not None else k + 4))
    every = spark.range(n).select(F.col("id").alias("i"))
    x, _ = orthogonalised(random(spark, n, m, seed=seed))
    w = np.zeros(k)
    for step in range(1, steps + 1):
        y = checkpointed(every.join(matmult(matrix, x, m), "i", "left").select("i", F.coalesce("x", F.array(*[F.lit(0.0)] * m)).alias("x")))
        h = dot(x, y)
        values, q = np.linalg.eigh((h + h.T) / 2)
        q = q[:, np.argsort(-np.abs(values), kind="stable")]
        values = values[np.argsort(-np.abs(values), kind="stable")]
        done = np.abs(values[:k] - w).max() <= tol * np.abs(values[:k]).max()
        w = values[:k]
        x, _ = orthogonalised(multiply(y, q))
        x = checkpointed(x)
        if done:
            break
    return w, columns(x, list(range(k))), step


# --- bases on the driver -----------------------------------------------------------------


def orthogonalise(v: np.ndarray, basis: np.ndarray, b: Callable | None = None, omega: np.ndarray | None = None, passes: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """v without its parts along ``basis`` and those coefficients: classical Gram-Schmidt, twice, in the inner
    product of ``b`` if given, with signs ``omega`` if that is indefinite."""
    h = 0
    for _ in range(passes):
        c = basis.conj().T @ (v if b is None else b(v))
        if omega is not None:
            c = c * (omega if c.ndim == 1 else omega[:, None])
        v = v - basis @ c
        h = h + c
    return v, h


def arnoldi(op, v: np.ndarray, h: np.ndarray, start: int, m: int, b: Callable | None = None, locked: np.ndarray | None = None) -> tuple[int, float, bool]:
    """Extends A V = V H + beta v e^T from ``start`` to ``m`` columns; v has m + 1 columns. Gives the columns
    reached, beta and whether the space closed."""
    for j in range(start, m):
        w = op(v[:, j])
        lead = 0 if locked is None else locked.shape[1]
        against = np.hstack([locked, v[:, : j + 1]]) if lead else v[:, : j + 1]
        before = np.linalg.norm(w)
        w, c = orthogonalise(w, against, b)
        h[: j + 1, j] = c[lead:]
        beta = float(np.sqrt(max(np.real(np.vdot(w, w if b is None else b(w))), 0)))
        if beta <= 1e-14 * max(before, 1e-300):
            return j + 1, 0.0, True
        h[j + 1, j] = beta
        v[:, j + 1] = w / beta
    return m, float(np.real(h[m, m - 1])), False


def biorthogonalise(v: np.ndarray, w: np.ndarray, j: int) -> float:
    """Makes column j of v and w orthogonal to the other's earlier columns and scales them to w^H v = 1; the product before
    scaling tells of breakdown."""
    for _ in range(2):
        d = np.einsum("ij,ij->j", w[:, :j].conj(), v[:, :j])
        v[:, j] -= v[:, :j] @ ((w[:, :j].conj().T @ v[:, j]) / d)
        w[:, j] -= w[:, :j] @ ((v[:, :j].conj().T @ w[:, j]) / d.conj())
    s = np.vdot(w[:, j], v[:, j])
    if abs(s) > 1e-14:
        v[:, j] /= np.sqrt(abs(s))
        w[:, j] /= np.sqrt(abs(s)) * np.conj(s / abs(s))
    return abs(s)


def orthonormality(v: np.ndarray, b: Callable | None = None) -> float:
    """The largest deviation of V^H B V from the identity."""
    return float(np.abs(v.conj().T @ (v if b is None else b(v)) - np.eye(v.shape[1])).max(initial=0))


def svd_and_rank(s: np.ndarray, delta: float = 1e-12, method: str = "refine") -> tuple[np.ndarray, np.ndarray, int]:
    """Left vectors, singular values and numerical rank: "refine" (Gram, twice), "qr", "qr_caa"."""
    if method == "refine":
        w, u = np.linalg.eigh(s.conj().T @ s)
        q, _ = np.linalg.qr(s @ u[:, ::-1])
        u2, sigma, _ = np.linalg.svd(q.conj().T @ s, full_matrices=False)
        left = q @ u2
    else:
        q, r = np.linalg.qr(s)
        u, sigma, _ = np.linalg.svd(r)
        left = q @ u
    return left, sigma, int((sigma > delta * sigma.max(initial=1e-300)).sum())
