"""Which eigenvalues come first: sort criteria, as numpy keys and as Spark columns."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..matrix import checkpointed

CRITERIA = (
    "largest_magnitude", "smallest_magnitude", "largest_real", "smallest_real", "largest_imaginary", "smallest_imaginary",
    "target_magnitude", "target_real", "target_imaginary", "smallest_positive_real", "all",
)


def key(values: np.ndarray, which: str | Callable, target: complex = 0.0, real: bool = False) -> np.ndarray:
    """Ascending sort key of complex values. ``real``: values of a real matrix, whose
    imaginary parts come in pairs and are compared by size."""
    v = np.asarray(values, complex)
    if callable(which):
        return np.asarray([which(x) for x in v], float)
    im = np.abs(v.imag) if real else v.imag
    keys = {
        "largest_magnitude": lambda: -np.abs(v), "smallest_magnitude": lambda: np.abs(v), "largest_real": lambda: -v.real, "smallest_real": lambda: v.real,
        "largest_imaginary": lambda: -im, "smallest_imaginary": lambda: im, "target_magnitude": lambda: np.abs(v - target), "all": lambda: np.abs(v - target),
        "target_real": lambda: np.abs(v.real - np.real(target)), "target_imaginary": lambda: np.abs(v.imag - np.imag(target)),
        "smallest_positive_real": lambda: np.where(v.real > 0, np.abs(v), np.inf),
    }
    if which not in keys:
        raise ValueError(f"no such order: {which}")
    return keys[which]()


def order(values: np.ndarray, which="largest_magnitude", target: complex = 0.0, real: bool = False, region=None) -> np.ndarray:
    """Indices in order: values inside ``region`` first, then by key; of a conjugate pair the one
    with positive imaginary part comes first and the pair stays together."""
    v = np.asarray(values, complex)
    k = np.round(key(v, which, target, real), 12)
    outside = np.zeros(len(v)) if region is None else (region.inside(v) < 0).astype(float)
    return np.lexsort((-v.imag, np.round(np.abs(v.imag), 10), np.round(v.real, 10), k, outside))


def key_column(which: str, re: str = "re", im: str = "im", target: complex = 0.0, real: bool = False) -> Column:
    """The same key over columns of real and imaginary parts."""
    r, i = F.col(re), F.col(im)
    size = F.abs(i) if real else i
    t = complex(target)
    return {
        "largest_magnitude": -F.hypot(r, i), "smallest_magnitude": F.hypot(r, i), "largest_real": -r, "smallest_real": r,
        "largest_imaginary": -size, "smallest_imaginary": size, "target_magnitude": F.hypot(r - t.real, i - t.imag), "all": F.hypot(r - t.real, i - t.imag),
        "target_real": F.abs(r - t.real), "target_imaginary": F.abs(i - t.imag),
        "smallest_positive_real": F.when(r > 0, F.hypot(r, i)).otherwise(F.lit(float("inf"))),
    }[which]


def ranked(values: DataFrame, which: str, target: complex = 0.0, real: bool = False, region=None, nev: int | None = None) -> DataFrame:
    """``values`` (re, im, ...) with a rank ``k`` from 0, the first ``nev`` only if given. With a limit Spark keeps the best rows of
    each task; without one the rows are sorted by ranges, and a row's rank is its place in its range after the rows of the
    ranges before (a number a range reaches the driver). No task sorts all."""
    keys = [] if region is None else [(region.column("re", "im") < 0).cast("int")]
    keys += [key_column(which, target=target, real=real), F.col("re"), F.abs("im"), F.col("im").desc()]
    if nev is not None:
        return values.orderBy(*keys).limit(nev).withColumn("k", F.row_number().over(W.orderBy(*keys)) - 1)
    placed = checkpointed(values.orderBy(*keys).withColumn("k", F.monotonically_increasing_id()))
    part = F.shiftrightunsigned("k", 33)
    counts = sorted(map(tuple, placed.groupBy(part.alias("part")).count().collect()))
    starts, total = [], 0
    for at, n in counts:
        starts.append((at, total))
        total += n
    first = values.sparkSession.createDataFrame(starts, "part long, first long")
    place = F.col("k").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.withColumn("part", part).join(F.broadcast(first), "part").withColumn("k", (place + F.col("first")).cast("long")).select(*values.columns, "k")
