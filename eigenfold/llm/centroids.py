"""Centroid clustering in exact integers, with float32 products that only screen.

Vectors become integers, floor(scale x). A round screens each block of vectors against all centroids by one float32 matrix product.
Whatever the order of its sums, a float32 inner product of n terms is off by at most gamma |x| |c| with gamma = n u / (1 - n u), u = 2^-24, so
that every squared distance has an interval that holds it. Only centroids whose intervals reach down to the smallest upper end are measured again, in exact
integers, and the smallest number among the nearest wins. Sums, counts and distances are exact: the answer is the
same on any number of tasks. Vectors stay where they are read; a task sends one row of sums for each centroid.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release

#: Integers up to this size are float32 numbers, and their squared distances fit 64 bits with up to 2^12 components.
PLAIN = 1 << 24
#: Centroids go to every task; k * length is bounded by this.
MOST_COMPONENTS = 1 << 23
LONGEST = (1 << 63) - 1


def usable(frame: DataFrame, key: str, vector: str, length: int) -> DataFrame:
    """(id, v array<double>) of the vectors with ``length`` components, none of them null or non-finite; the key may be null."""
    v = F.col(vector).cast("array<double>")
    rows = frame.where(F.size(vector) == length).select(F.col(key).cast("long").alias("id"), v.alias("v"))
    return rows.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf))))


def integers(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale x), exactly: int64 where that holds all of them, else Python's integers."""
    if np.abs(x).max(initial=0.0) * scale < 2.0**52:
        return np.floor(x * float(scale)).astype(np.int64)  # a power of two scales without rounding
    out = np.empty(x.shape, object)
    for at, value in np.ndenumerate(x):
        p, q = float(value).as_integer_ratio()
        out[at] = p * scale // q
    return out


def squared(z: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows to rows; object arrays where 64 bits might not do."""
    d = z - c
    return (d * d).sum(-1)


def bounds(z: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """|c|^2 - 2 z.c from a float32 product, and how far each may be from the true value. Entries are at most ``PLAIN`` in size."""
    n, u = z.shape[1], 2.0**-24
    dot = (z.astype(np.float32) @ c.astype(np.float32).T).astype(np.float64)
    size_z = np.sqrt((z.astype(np.float64) ** 2).sum(1)) * (1 + 1e-12)
    square_c = (c.astype(np.int64) ** 2).sum(1).astype(np.float64)
    reach = size_z[:, None] * (np.sqrt(square_c) * (1 + 1e-12))[None, :]
    value = square_c[None, :] - 2 * dot
    error = 2 * n * u / (1 - n * u) * reach + 2.0**-50 * (square_c[None, :] + 2 * np.abs(dot))
    return value, error * (1 + 1e-12)


@dataclass
class Assigner:
    """Nearest of the centroids ``c`` (rows of integers), ties to the smallest number."""

    c: np.ndarray

    def __post_init__(self):
        self.plain = bool(np.abs(self.c).max(initial=0) <= PLAIN) and self.c.shape[1] <= 1 << 12
        self.exact = 0  # how many distances were measured again

    def nearest(self, z: np.ndarray) -> np.ndarray:
        if not len(z):
            return np.zeros(0, np.int64)
        if not self.plain or z.dtype == object or np.abs(z).max() > PLAIN:
            return self._wide(z)
        z32 = z.astype(np.int64)
        c = self.c.astype(np.int64)
        value, error = bounds(z32, c)
        short = value - error <= (value + error).min(1)[:, None]
        best = short.argmax(1)
        several = np.flatnonzero(short.sum(1) > 1)
        if len(several):
            at, k = np.nonzero(short[several])  # by row, then by number
            d = squared(z32[several[at]], c[k])
            self.exact += len(d)
            first = np.flatnonzero(np.diff(at, prepend=-1))
            low = np.repeat(np.minimum.reduceat(d, first), np.diff(np.append(first, len(d))))
            best[several] = np.minimum.reduceat(np.where(d == low, k, len(c)), first)
        return best

    def _wide(self, z: np.ndarray) -> np.ndarray:
        """Without screening, for integers that float32 does not hold; rows that it does hold are screened if the centroids are."""
        out = np.zeros(len(z), np.int64)
        if self.plain:
            small = np.array([max(map(abs, row)) <= PLAIN for row in z.tolist()])
            if small.any():
                out[small] = self.nearest(z[small].astype(np.int64))
        else:
            small = np.zeros(len(z), bool)
        c = self.c.astype(object)
        for i in np.flatnonzero(~small).tolist():
            d = squared(z[i].astype(object)[None, :], c)
            out[i] = min(range(len(d)), key=lambda k: (d[k], k))
        return out

    def distances(self, z: np.ndarray, best: np.ndarray) -> list[int]:
        if z.dtype != object and self.plain and np.abs(z).max(initial=0) <= PLAIN:
            return squared(z, self.c.astype(np.int64)[best]).tolist()
        return [int(d) for d in squared(z.astype(object), self.c.astype(object)[best])]


def _blocks(batch: pa.RecordBatch, length: int, scale: int, rows: int = 4096) -> Iterator[tuple[pa.Array, np.ndarray]]:
    for at in range(0, batch.num_rows, rows):
        part = batch.slice(at, rows)
        x = part.column("v").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, length)
        yield part.column("id"), integers(x, scale)


def starting(frame: DataFrame, k: int, seed: int, length: int, scale: int) -> np.ndarray:
    """The vectors with the ``k`` smallest sha256 of "seed:id"; equal ids by their components, null ids last."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")).cast("binary"), 256)
    rows = frame.select(h.alias("h"), "v").orderBy(F.col("h").asc_nulls_last(), "v").limit(k).collect()
    x = np.array([r["v"] for r in rows], float).reshape(len(rows), length)
    return integers(x, scale).astype(object)


def totals(frame: DataFrame, c: np.ndarray, length: int, scale: int) -> tuple[list[int], np.ndarray, list[int]]:
    """Exact counts, sums of components and sums of distances by nearest centroid. Tasks send a row a centroid; those are added in about
    as many groups as the square root of the tasks before they reach the driver."""
    assigner = Assigner(c)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total, far = [0] * len(c), np.zeros((len(c), length), object), [0] * len(c)
        for batch in batches:
            for _, z in _blocks(batch, length, scale):
                best = assigner.nearest(z)
                order = np.argsort(best, kind="stable")
                first = np.flatnonzero(np.diff(best[order], prepend=-1))
                # 4096 rows of 2^52 are beyond 64 bits only for wide integers, which are objects or fewer
                wide = z if z.dtype == object or np.abs(z).max(initial=0) < 1 << 50 else z.astype(object)
                sums = np.add.reduceat(wide[order], first, axis=0)
                d = np.array(assigner.distances(z, best), object)[order]
                for k, s, n, f in zip(best[order][first], sums, np.diff(np.append(first, len(z))), np.add.reduceat(d, first)):
                    count[k] += int(n)
                    total[k] += s
                    far[k] += int(f)
        hit = [k for k in range(len(c)) if count[k]]
        yield pa.RecordBatch.from_arrays(
            [pa.array(hit, pa.int32()), pa.array([count[k] for k in hit], pa.int64()), pa.array([[str(int(s)) for s in total[k]] for k in hit], pa.list_(pa.string())), pa.array([str(far[k]) for k in hit], pa.string())],
            ["k", "n", "s", "d"],
        )
        release()

    def merge(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, tuple] = {}
        for frame in frames:
            for k, n, s, d in zip(*(frame[x].tolist() for x in ("k", "n", "s", "d"))):
                count, total, far = held.get(k, (0, 0, 0))
                held[k] = (count + n, total + np.array(list(map(int, s)), object), far + int(d))
        if held:
            count, total, far = zip(*held.values())
            yield pd.DataFrame({"k": list(held), "n": count, "s": [list(map(str, t)) for t in total], "d": list(map(str, far))})

    schema = "k int, n long, s array<string>, d string"
    groups = math.isqrt(max(frame.rdd.getNumPartitions(), 1)) + 1
    # dealt by turns, not by a key: as many tasks as groups, since the driver's iterator runs a job for each, whatever the number of shuffle partitions
    parts = frame.mapInArrow(run, schema).repartition(groups).mapInPandas(merge, schema)
    count, total, far = [0] * len(c), np.zeros((len(c), length), object), [0] * len(c)
    for r in parts.toLocalIterator():
        count[r["k"]] += r["n"]
        total[r["k"]] += np.array(list(map(int, r["s"])), object)
        far[r["k"]] += int(r["d"])
    return count, total, far


def clusters(frame: DataFrame, key: str = "vec_id", vector: str = "embedding", length: int = 64, k: int = 40, rounds: int = 5, seed: int = 2, scale: int = 256) -> DataFrame:
    """(key, cluster, distance, cluster_inertia, inertia, centroid_sha256): each vector's nearest centroid after ``rounds`` rounds, a row a vector.

    Vectors that are null, of another length, or hold a null or non-finite component are left out. Rows with a null key are clustered but start
    no centroid while others do; repeated rows count as often as they occur, and copies may start several centroids, of which the
    first then takes all. With fewer vectors than ``k`` there are as many centroids; an empty table gives an empty one. Ties go to the
    smaller number. Components of any size are exact (beyond 2^24 without screening); a distance or a sum beyond 64 bits is null.
    """
    if k * length > MOST_COMPONENTS:
        raise ValueError(f"{k} centroids of {length} components are more than MOST_COMPONENTS = {MOST_COMPONENTS}")
    if scale & (scale - 1):
        raise ValueError("the scale is a power of two")
    rows = usable(frame, key, vector, length)
    c = starting(rows, k, seed, length, scale)
    for _ in range(rounds if len(c) else 0):
        count, total, _ = totals(rows, c, length, scale)
        c = np.array([[int(s) // n for s in t] if n else list(old) for t, n, old in zip(total, count, c)], object).reshape(c.shape)
    assigner, far = Assigner(c), totals(rows, c, length, scale)[2] if len(c) else []

    def long(x: int) -> int | None:
        return x if x <= LONGEST else None

    inertia, digests = long(sum(far)), [hashlib.sha256(",".join(str(int(x)) for x in row).encode()).hexdigest() for row in c]
    by_cluster = [long(x) for x in far]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, z in _blocks(batch, length, scale):
                best = assigner.nearest(z)
                at = best.tolist()
                columns = [
                    ids, pa.array(best.astype(np.int32)), pa.array([long(d) for d in assigner.distances(z, best)], pa.int64()), pa.array([by_cluster[j] for j in at], pa.int64()),
                    pa.array([inertia] * len(at), pa.int64()), pa.array([digests[j] for j in at], pa.string()),
                ]
                yield pa.RecordBatch.from_arrays(columns, [key, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"])
        release()

    return rows.mapInArrow(run, f"`{key}` long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")


def clusters_query(embeddings: DataFrame) -> DataFrame:
    return clusters(embeddings)


def _sql(k: int = 40, rounds: int = 5, length: int = 64) -> str:
    """The same with every distance measured."""
    near = lambda r: f"near{r} AS MATERIALIZED (SELECT id, min_by(k, (d, k)) AS k, min(d) AS d FROM (SELECT z.id, c.k, sum((z.z - c.z) * (z.z - c.z))::BIGINT AS d FROM z JOIN c{r} c ON z.p = c.p GROUP BY 1, 2) GROUP BY id)"
    parts = [
        f"kept AS (SELECT row_number() OVER () AS id, vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE len(embedding) = {length} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"z AS MATERIALIZED (SELECT id, vec_id, unnest(range({length})) AS p, floor(256 * unnest(v))::BIGINT AS z FROM kept)",
        f"first AS (SELECT id, row_number() OVER (ORDER BY sha256('2:' || vec_id) NULLS LAST, v) - 1 AS k FROM kept QUALIFY k < {k})",
        "c0 AS MATERIALIZED (SELECT first.k, p, z FROM first JOIN z ON first.id = z.id)",
    ]
    for r in range(rounds):
        parts.append(near(r))
        parts.append(f"m{r} AS (SELECT near{r}.k, p, sum(z)::BIGINT AS s, count(*) AS n FROM z JOIN near{r} ON z.id = near{r}.id GROUP BY 1, 2)")
        parts.append(f"c{r + 1} AS MATERIALIZED (SELECT c.k, c.p, CASE WHEN n IS NULL THEN z ELSE (s - ((s % n) + n) % n) // n END AS z FROM c{r} c LEFT JOIN m{r} m ON c.k = m.k AND c.p = m.p)")
    parts.append(near(rounds))
    parts.append(f"h AS (SELECT k, sha256(string_agg(z::VARCHAR, ',' ORDER BY p)) AS h FROM c{rounds} GROUP BY k)")
    return (
        f"WITH {', '.join(parts)} SELECT kept.vec_id, a.k::INTEGER AS cluster, a.d AS distance, (sum(a.d) OVER (PARTITION BY a.k))::BIGINT AS cluster_inertia, (sum(a.d) OVER ())::BIGINT AS inertia, h.h AS centroid_sha256 "
        f"FROM near{rounds} a JOIN kept ON a.id = kept.id JOIN h ON a.k = h.k"
    )


CLUSTERS_SQL = _sql()
