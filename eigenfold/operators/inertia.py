"""Exact eigenvalue counts of sparse symmetric matrices: inertia by nested dissection.

A - s I = L D L' has as many negative values as A has eigenvalues below s. Rows are eliminated level by level in blocks that share no entry: each block, a group of
its own, gives its inertia and its Schur complement on the rows it touches, for all shifts at once, a column of values a shift; complements add up by place to the matrix
of the next level. What no level names at the end is the last separator, a dense matrix for each shift, whose inertias are taken side by side. No matrix but those blocks is
ever dense, and none is gathered."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..matrix import DENSE_ROWS, checkpointed

#: The place of a row that tells a count.
COUNT = -1
#: Entries of the blocks that are decomposed in one call, about.
TOGETHER = 100_000


def _inertia(w: np.ndarray) -> int:
    """Negative ones of the eigenvalues ``w``; one at zero leaves the count open."""
    if len(w) and np.abs(w).min() <= 1e-12 * np.abs(w).max():
        raise ArithmeticError("a shift is an eigenvalue of a block: move it a little")
    return int((w < 0).sum())


def _dense(i: np.ndarray, j: np.ndarray, v: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    a = np.zeros((len(rows), len(cols)))
    np.add.at(a, (np.searchsorted(rows, i), np.searchsorted(cols, j)), v)
    return a


def _starts(sorted_keys: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.diff(sorted_keys, prepend=sorted_keys[:1] - 1)) if len(sorted_keys) else np.zeros(0, int)


def _eliminated(group: pa.Table, shifts: list[float], names: list[str]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], list[int]]:
    """i, j of Schur complements, their values by shift, and negative values by shift, of a group of blocks; those of like shape are decomposed together.
    ``names``: the columns of values, one for all shifts or one for each. Of entries inside a block the lower triangle is given, ``other`` is the block of j."""
    out = group.column("other").is_null().to_numpy(zero_copy_only=False)
    block, i, j, other = (group.column(c).fill_null(0).to_numpy() for c in ("block", "i", "j", "other"))
    inside = (other == block) & ~out
    values = [group.column(c).to_numpy() for c in names]
    if len(across := np.flatnonzero(~inside & ~out)):
        pair = np.unique(np.stack([i[across], j[across]]), axis=1, return_inverse=True)[1].ravel()
        if any(np.bincount(pair, v[across]).any() for v in values):
            raise ValueError("an entry between two blocks of one level")
    rows, at = np.unique(np.concatenate([i, j[inside]]), return_index=True)
    of = np.concatenate([block, block[inside]])[at]  # a row is in one block of a level
    order = np.lexsort((rows, of))
    rank = np.empty(len(rows), int)
    rank[order] = np.arange(len(rows))
    blocks, first = of[order][starts := _starts(of[order])], starts
    size = np.diff(np.append(first, len(rows)))
    if len(size) and size.max() > DENSE_ROWS:
        raise ValueError(f"a block of {size.max()} rows is more than DENSE_ROWS = {DENSE_ROWS}: cut it into levels")
    place = lambda x, b: rank[np.searchsorted(rows, x)] - first[b]
    bi, bo = np.searchsorted(blocks, block[inside]), np.searchsorted(blocks, block[out])
    ii, ij, oi = place(i[inside], bi), place(j[inside], bi), place(i[out], bo)
    # the rows that a block touches, numbered within it
    turn = np.lexsort((j[out], bo))
    new = np.ones(len(turn), bool)
    new[1:] = (np.diff(bo[turn]) != 0) | (np.diff(j[out][turn]) != 0)
    touched, whose = j[out][turn][new], bo[turn][new]
    reach = np.bincount(whose, minlength=len(blocks))
    begin = np.cumsum(reach) - reach
    oj = np.empty(len(turn), int)
    oj[turn] = np.cumsum(new) - 1 - begin[bo[turn]]
    shape = size * (len(rows) + 1) + reach
    found: list[tuple[np.ndarray, np.ndarray, list[np.ndarray]]] = []
    below = [0] * len(shifts)
    for kind in np.unique(shape):
        n, t = int(size[shape == kind][0]), int(reach[shape == kind][0])
        for some in np.array_split(np.flatnonzero(shape == kind), max(1, int((shape == kind).sum() * (n + t) ** 2 // 4_000_000))):
            number = np.full(len(blocks), -1)
            number[some] = np.arange(len(some))
            mine, theirs = np.flatnonzero(number[bi] >= 0), np.flatnonzero(number[bo] >= 0)
            made = []
            for k, shift in enumerate(shifts):
                if k < len(values):
                    a, c = np.zeros((len(some), n, n)), np.zeros((len(some), n, t))
                    np.add.at(a, (number[bi[mine]], ii[mine], ij[mine]), values[k][inside][mine])
                    np.add.at(c, (number[bo[theirs]], oi[theirs], oj[theirs]), values[k][out][theirs])
                    w, q = np.linalg.eigh(a)  # reads the lower triangle
                    f = np.swapaxes(c, 1, 2) @ q
                d = w - shift
                if len(d) and (np.abs(d).min(1) <= 1e-12 * np.abs(d).max(1)).any():
                    raise ArithmeticError("a shift is an eigenvalue of a block: move it a little")
                made.append(-((f / d[:, None, :]) @ np.swapaxes(f, 1, 2)).ravel())
                below[k] += int((d < 0).sum())
            to = touched[begin[some][:, None] + np.arange(t)[None, :]] if t else np.zeros((len(some), 0), np.int64)
            found.append((np.repeat(to, t, axis=1).ravel(), np.tile(to, (1, t)).ravel(), made))
    join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
    return join([p[0] for p in found], np.int64), join([p[1] for p in found], np.int64), [join([p[2][k] for p in found], float) for k in range(len(shifts))], below


def _labelled(entries: DataFrame, blocks: DataFrame | Callable[[Column], Column]) -> DataFrame:
    """The entries with the blocks of both their rows, null for none."""
    if callable(blocks):
        return entries.withColumns({f"block_{side}": blocks(F.col(side)).cast("long") for side in "ij"})
    label = lambda side: blocks.select(F.col("i").alias(side), F.col("block").alias(f"block_{side}"))
    return checkpointed(entries.join(label("i"), "i", "left").join(label("j"), "j", "left"))


def _level(entries: DataFrame, blocks: DataFrame | Callable[[Column], Column], shifts: list[float], names: list[str], about: int | None) -> DataFrame:
    """(i, j, v0, v1, ...) after one level, a column of values a shift, with a row (COUNT, COUNT, negative values) for what it has eliminated. ``names``: the
    columns of values of ``entries``, one for all shifts or one for each. Entries at one place add up. Shifts are taken off a row when it is eliminated."""
    cut = _labelled(entries, blocks)
    upper = F.coalesce((F.col("block_i") == F.col("block_j")) & (F.col("i") < F.col("j")), F.lit(False))
    touched = cut.where(F.col("block_i").isNotNull() & ~upper)  # the other triangle says the same
    touched = touched.select(F.col("block_i").alias("block"), F.col("block_j").alias("other"), "i", "j", *names)
    values = [f"v{k}" for k in range(len(shifts))]
    rest = cut.where("block_i IS NULL AND block_j IS NULL").groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in names])
    rest = rest.select("i", "j", *[F.col(c).alias(v) for v, c in zip(values, names if len(names) > 1 else names * len(shifts))])
    schema = ", ".join(["i long", "j long", *[f"{v} double" for v in values]])

    def run(group: pa.Table) -> pa.Table:
        i, j, v, below = _eliminated(group, shifts, names)
        columns = [np.append(i, COUNT).astype(np.int64), np.append(j, COUNT).astype(np.int64), *(np.append(x, float(n)) for x, n in zip(v, below))]
        return pa.table([pa.array(c) for c in columns], ["i", "j", *values])

    # many blocks to a group, so that small ones do not cost a call each
    groups = max(1, (touched.count() if about is None else about) // TOGETHER)
    made = touched.withColumn("group", F.pmod(F.xxhash64("block"), F.lit(groups))).groupBy("group").applyInArrow(run, schema)
    return rest.unionByName(made).groupBy("i", "j").agg(*[F.sum(v).alias(v) for v in values])


def counts_below(matrix: DataFrame, shifts: list[float], levels: list[DataFrame | Callable[[Column], Column]], about: int | None = None) -> DataFrame:
    """(s, shift, below): how many eigenvalues of the symmetric matrix (i, j, v) lie below each of ``shifts``.

    ``levels`` tell the rows that are eliminated at each level and their blocks: frames (i, block), or functions that give the block of a column of row numbers, null for none,
    which need no join. Blocks of a level share no entry then, which is checked. Row numbers are any nonnegative integers; rows are those that a frame of a level names or
    that have an entry. Entries at one place add up; both triangles are given. The matrix is read twice, and once more to count its entries unless ``about`` says
    how many there are, about; it is written out only if the first level is a frame. A shift that is an eigenvalue of a block raises, since its count then is open. Between two shifts lie as many values as the counts differ by."""
    spark, shifts = matrix.sparkSession, [float(x) for x in shifts]
    frame, names = matrix.select("i", "j", F.col("v").cast("double").alias("v")), ["v"]
    for level in levels:
        if not callable(level):  # a row may be named that has no entry
            frame = frame.unionByName(level.select("i", F.col("i").alias("j"), F.lit(0.0).alias("v")))
    values, done = [f"v{k}" for k in range(len(shifts))], []
    for blocks in levels or [lambda i: F.lit(None)]:
        frame = checkpointed(_level(frame, blocks, shifts, names, about))
        names, about = values, None
        done.append(frame.where(F.col("i") == COUNT).select(*values))
        frame = frame.where(F.col("i") != COUNT)
    most = DENSE_ROWS
    by_shift = lambda df: df.select(*[c for c in df.columns if c not in values], F.posexplode(F.array(*values)).alias("s", "v"))

    def last(group: pa.Table) -> pa.Table:
        i, j, v = (group.column(c).to_numpy() for c in ("i", "j", "v"))
        rows, s = np.unique(i), group.column("s")[0].as_py()
        if len(rows) > most:
            raise ValueError(f"a last separator of {len(rows)} rows is more than DENSE_ROWS = {most}: cut it into levels")
        return pa.table({"s": pa.array([s], pa.int32()), "below": pa.array([_inertia(np.linalg.eigvalsh(_dense(i, j, v, rows, rows)) - shifts[s])], pa.int64())})

    every = by_shift(frame).groupBy("s").applyInArrow(last, "s int, below long")
    for counted in done:
        every = every.unionByName(by_shift(counted).select("s", F.col("v").cast("long").alias("below")))
    named = spark.createDataFrame(list(enumerate(shifts)), "s int, shift double")
    return named.join(every.groupBy("s").agg(F.sum("below").alias("below")), "s", "left").select("s", "shift", F.coalesce("below", F.lit(0)).cast("long").alias("below"))


def ranges(matrix: DataFrame, n: int, blocks: int) -> DataFrame:
    """One level for a matrix of ``n`` rows whose entries lie near the diagonal: runs of rows, less those with an entry in an earlier run, which separate them."""
    run = lambda c: F.expr(f"cast({c} * {blocks} div {n} as long)")
    earlier = matrix.where("v <> 0").groupBy("i").agg(F.min(run("j")).alias("least"))
    return earlier.select("i", run("i").alias("block"), "least").where(F.col("least") >= F.col("block")).select("i", "block")
