"""Nearest neighbours by randomly rotated one-bit codes, and near-duplicate vectors by
spherical k-means cells.

Both read ``key`` and an array column; vectors that are null, empty, zero, or hold a null or non-finite component take
no part. Vectors of different lengths have neither distance nor angle: each length is searched and compared by itself.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from .common import checkpointed, components


def usable(frame: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v array<double>) of the vectors that take part."""
    v = F.col(vector).cast("array<double>")
    rows = frame.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("id"), v.alias("v"))
    return rows.where((F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf))) & F.exists("v", lambda x: x != 0))


def lengths(base: DataFrame, most: int = 64) -> list[int]:
    """The vectors' different lengths; more than ``most`` of them is no table of embeddings."""
    found = [r[0] for r in base.select(F.size("v").alias("n")).distinct().limit(most + 1).collect()]
    if len(found) > most:
        raise ValueError(f"vectors of more than {most} lengths")
    return sorted(found)


# --- nearest neighbours -------------------------------------------------------------------


def rotation(dimension: int, seed: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dimension, dimension)))
    return q * np.sign(np.diag(r))


def encode(x: np.ndarray, centre: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed signs of the rotated residuals, the residuals' norms, and the inner products of each unit
    residual with its own code (the correction that makes estimates unbiased)."""
    d = turn.shape[0]
    r = np.zeros((len(x), d))
    r[:, : x.shape[1]] = x - centre
    norm = np.linalg.norm(r, axis=1)
    r = (r @ turn.T) / np.maximum(norm, 1e-300)[:, None]
    own = np.abs(r).sum(1) / math.sqrt(d)
    return np.packbits(r > 0, axis=1, bitorder="little").view(np.uint64), norm, np.where(own > 0, own, 1.0)


def squared_bounds(q: np.ndarray, codes: np.ndarray, norm: np.ndarray, own: np.ndarray, centre: np.ndarray, turn: np.ndarray, sigmas: float, levels: int = 6) -> tuple[np.ndarray, np.ndarray]:
    """Estimated squared distances of queries to coded vectors and their error bounds.

    The query's rotated residual is rounded to ``levels`` bits a component; its inner products with the
    codes then are bit counts. An estimate's standard error is that of the code's component
    across the query, plus the rounding's.
    """
    d = turn.shape[0]
    r = np.zeros((len(q), d))
    r[:, : q.shape[1]] = q - centre
    qn = np.linalg.norm(r, axis=1)
    r = (r @ turn.T) / np.maximum(qn, 1e-300)[:, None]
    low = r.min(1, keepdims=True)
    step = np.maximum((r.max(1, keepdims=True) - low) / (2**levels - 1), 1e-12)
    rounded = np.rint((r - low) / step).astype(np.int64)
    ones = np.bitwise_count(codes).sum(1, dtype=np.int64)
    dot = np.zeros((len(q), len(codes)), np.int32)
    for level in range(levels):
        plane = np.packbits((rounded >> level) & 1, axis=1, bitorder="little").view(np.uint64)
        for w in range(codes.shape[1]):
            dot += np.bitwise_count(plane[:, w, None] & codes[None, :, w]).astype(np.int32) << level
    # <rounded query, sign code> from bit counts; the code's components are +-1 / sqrt(d)
    inner = (2 * (step * dot + low * ones[None, :]) - (step * rounded.sum(1, keepdims=True) + low * d)) / math.sqrt(d)
    cosine = inner / own[None, :]
    error = sigmas * np.sqrt(np.maximum(1 - own**2, 0) / (own**2 * max(d - 1, 1)))[None, :] + step * math.sqrt(d) / (2 * math.sqrt(d)) / own[None, :]
    base = norm[None, :] ** 2 + qn[:, None] ** 2
    scale = 2 * norm[None, :] * qn[:, None]
    return base - scale * cosine, scale * error


NEIGHBOURS = T.StructType([T.StructField(n, t) for n, t in (("query_id", T.LongType()), ("query", T.LongType()), ("vec_id", T.LongType()), ("score", T.DoubleType()))])


class Nearest:
    """The ``k`` nearest vectors that one task has met, for each of the queries ``q``."""

    def __init__(self, q: np.ndarray, qid: np.ndarray, k: int, centre: np.ndarray, turn: np.ndarray, sigmas: float):
        self.q, self.qid, self.k, self.centre, self.turn, self.sigmas = q, qid, k, centre, turn, sigmas
        self.score, self.id = np.full((len(q), k), np.inf), np.zeros((len(q), k), np.int64)

    def meet(self, ids: np.ndarray, x: np.ndarray, queries: int = 64) -> None:
        """Codes the vectors, estimates all distances, and measures those that may be among the nearest."""
        codes, norm, own = encode(x, self.centre, self.turn)
        few = min(4 * self.k, len(x))
        for at in range(0, len(self.q), queries):
            part = slice(at, at + queries)
            estimate, error = squared_bounds(self.q[part], codes, norm, own, self.centre, self.turn, self.sigmas)
            estimate[ids[None, :] == self.qid[part, None]] = np.inf
            low = estimate - error
            for i, q in enumerate(self.q[part]):
                bar = self.score[at + i, -1] ** 2
                if not np.isfinite(bar):  # fewer than k so far: measured from the smallest estimates
                    best = np.argpartition(estimate[i], few - 1)[:few]
                    first = ((x[best] - q) ** 2).sum(1) + np.where(np.isfinite(estimate[i, best]), 0, np.inf)
                    bar = np.partition(first, min(self.k, few) - 1)[min(self.k, few) - 1]
                close = np.flatnonzero((low[i] <= bar) & np.isfinite(estimate[i]))
                if len(close):
                    self._merge(at + i, np.sqrt(((x[close] - q) ** 2).sum(1)), ids[close])

    def _merge(self, i: int, score: np.ndarray, ids: np.ndarray) -> None:
        score, ids = np.concatenate([self.score[i], score]), np.concatenate([self.id[i], ids])
        first = np.lexsort((ids, score))[: self.k]
        self.score[i], self.id[i] = score[first], ids[first]


def nearest(frame: DataFrame, queries: DataFrame, k: int = 10, key: str = "vec_id", vector: str = "embedding", sigmas: float = 3.5, bits: int = 4, candidates: int = 8192, block: int | None = None, query_bytes: int = 64 << 20, seed: int = 7) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's ``k`` nearest by Euclidean distance.

    The vectors stay where they are read: queries are broadcast in blocks of ``block`` rows (as many as ``query_bytes`` hold, if not
    given), each task runs over its vectors in batches of ``candidates``, and only its ``k`` nearest to each query are shuffled.
    A vector's code has ``bits`` bits for each of its components: it is padded with zeros before the rotation. The bar is
    the k-th distance measured so far (at first that of the ``4 k`` smallest estimates), and every vector whose lower bound (the
    estimate less ``sigmas`` standard errors) is not above it is measured by the original vectors.
    Ties go to the smaller id; a query is not its own neighbour; fewer candidates than ``k`` are all given; repeated
    rows of one id count as often as they occur, as candidates; equal query rows are one query, and a query id with several vectors is several.
    An empty table gives no rows.
    """
    base, asked = usable(frame, key, vector), usable(queries, key, vector).distinct().withColumn("query", F.xxhash64("v"))
    found = [_nearest(base.where(F.size("v") == n), asked.where(F.size("v") == n), n, k, sigmas, bits, candidates, block or max(1, query_bytes // (8 * n)), seed) for n in lengths(asked)]
    if not found:
        return frame.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return reduce(DataFrame.unionByName, found)


def _nearest(base: DataFrame, asked: DataFrame, dimension: int, k: int, sigmas: float, bits: int, candidates: int, block: int, seed: int) -> DataFrame:
    mean = _mean(base)
    turn = rotation(math.ceil(dimension * bits / 64) * 64, seed)
    blocks = math.ceil(asked.count() / block)
    out = []
    for part in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("id", "query"), F.lit(blocks)) == part).select("id", "query", "v").toArrow()
        if not rows.num_rows:
            continue
        ids, marks = rows.column("id").to_numpy(), rows.column("query").to_numpy()
        held = base.sparkSession.sparkContext.broadcast((matrix(rows.column("v").combine_chunks()), ids, marks, mean, turn))

        def search(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            q, ids, marks, centre, turn = held.value
            near = Nearest(q, ids, k, centre, turn, sigmas)
            for whole in batches:
                for at in range(0, whole.num_rows, candidates):
                    b = whole.slice(at, candidates)
                    near.meet(b.column(0).to_numpy(), matrix(b.column(1)))
            i, j = np.nonzero(np.isfinite(near.score))
            yield pa.RecordBatch.from_arrays([pa.array(ids[i]), pa.array(marks[i]), pa.array(near.id[i, j]), pa.array(near.score[i, j])], NEIGHBOURS.names)

        rank = F.row_number().over(W.partitionBy("query_id", "query").orderBy("score", "vec_id"))
        found = base.mapInArrow(search, NEIGHBOURS).withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
        if blocks > 1:  # a block's answer is written before the next block is broadcast
            found = checkpointed(found)
            held.destroy()
        out.append(found)
    return reduce(DataFrame.unionByName, out)


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column without nulls and of one length."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(np.float64, copy=False) if len(column) else np.zeros((0, 1))


def _mean(base: DataFrame) -> np.ndarray:
    """The mean vector: sums by task, added up by groups of tasks (about as many as their square root) and then on the driver."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, None
        for b in batches:
            if b.num_rows:
                x = matrix(b.column(0))
                n, total = n + len(x), x.sum(0) + (0 if total is None else total)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([total.tolist()], pa.list_(pa.float64()))], ["n", "s"])

    def added(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"n": [group["n"].sum()], "s": [np.stack(group["s"].to_numpy()).sum(0)]})

    sums = base.select("v").mapInArrow(part, "n long, s array<double>")
    tasks = sums.rdd.getNumPartitions()
    if tasks > 1000:
        sums = sums.groupBy(F.pmod(F.spark_partition_id(), F.lit(math.isqrt(tasks)))).applyInPandas(added, "n long, s array<double>")
    rows = sums.collect()
    return sum((np.array(r["s"]) for r in sorted(rows, key=lambda r: r["s"])), np.zeros(1)) / max(1, sum(r["n"] for r in rows))


def neighbours_query(frame: DataFrame) -> DataFrame:
    return nearest(frame, frame.where(F.col("vec_id") % 100 == 0))


# --- near-duplicate vectors ---------------------------------------------------------------


def spherical_kmeans(x: np.ndarray, cells: int, rounds: int = 8, seed: int = 3) -> np.ndarray:
    """Unit centres of the unit rows of ``x``. Many cells are found in two levels: about their square root first, then
    the rows of each of those are parted again, in proportion to their number."""
    rng = np.random.default_rng(seed)
    if cells > 256:
        top = spherical_kmeans(x, math.isqrt(cells), rounds, seed)
        own = (x @ top.T).argmax(1)
        parts = [x[own == c] for c in range(len(top))]
        return np.vstack([spherical_kmeans(p, max(1, round(cells * len(p) / len(x))), rounds, seed) for p in parts if len(p)])
    centres = x[rng.permutation(len(x))[:cells]].copy()
    for _ in range(rounds):
        own = (x @ centres.T).argmax(1)
        total = np.zeros_like(centres)
        np.add.at(total, own, x)
        length = np.linalg.norm(total, axis=1)
        centres[length > 0] = total[length > 0] / length[length > 0, None]
    return centres


def reach(threshold: float) -> float:
    """How near a cell border a row has to lie to be compared beyond it too: half the length of the longest difference
    that links, sqrt(2 - 2 threshold). The distances of two linked rows from the border between their homes add up to no more
    than their difference, so one of the two lies within; the rest is for rounding."""
    return math.sqrt(max(0.0, 2 - 2 * threshold)) / 2 + 1e-9


def near_cells(similarity: np.ndarray, home: np.ndarray, gap: np.ndarray, far: float) -> np.ndarray:
    """Whether each row (its similarities to the centres) is to be compared in each cell."""
    at = np.arange(len(home))
    near = (similarity[at, home][:, None] - similarity) <= far * gap[home]
    near[at, home] = True
    return near


def gaps(centres: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * centres @ centres.T, 1e-12))


#: Products of two rows that cost about as much as sending a row once.
PRODUCTS = 3000


def cost_of(x: np.ndarray, centres: np.ndarray, total: int, block: int, far: float) -> float:
    """What ``total`` rows like the sample ``x`` would cost in these cells, in rows sent: the copies that the blocks of
    crowded cells make, and the products within cells."""
    s = x @ centres.T
    home = s.argmax(1)
    near = near_cells(s, home, gaps(centres), far)
    scale = total / len(x)
    own, every = np.bincount(home, minlength=len(centres)) * scale, near.sum(0) * scale
    others = every - own
    whole = every <= block
    a, b = np.ceil(own / block), np.ceil(others / block)
    copies = np.where(whole, every, own * (a + b) + others * a)
    return float(copies.sum() + (own * (own / 2 + others)).sum() / PRODUCTS)


def fitted_cells(x: np.ndarray, total: int, block: int, far: float, measured: int = 8000) -> np.ndarray:
    """Centres of as many cells (a power of 4) as cost least for ``total`` rows. Where rows have no structure, more cells mean
    more visits across borders and no less work, and few are taken; where they have, cells grow with the rows."""
    best, least, cells = None, math.inf, 1
    probe = x[np.random.default_rng(0).permutation(len(x))[:measured]]
    while cells <= max(1, len(x) // 16):
        centres = spherical_kmeans(x, cells)
        cost = cost_of(probe, centres, total, block, far)
        if cost < least:
            best, least = centres, cost
        elif cost > 2 * least:
            break
        cells *= 4
    return best


def joined(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """``label`` (each index's root) after the pairs (i, j) have joined their groups."""
    while True:
        a, b = label[i], label[j]
        apart = np.flatnonzero(a != b)
        if not len(apart):
            return label
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (label != (deeper := label[label])).any():
            label = deeper


def near_vectors(frame: DataFrame, key: str = "vec_id", vector: str = "embedding", threshold: float = 0.95, cell_rows: int | None = None, block: int | None = None, block_bytes: int = 16 << 20, sample_rows: int = 64_000, heavy_rows: int = 10_000) -> DataFrame:
    """(key, n_links, component_id, kept) of every row.

    Equal vectors are one until the end. The rest lies in cells around centres fitted on a sample of about ``sample_rows`` (the bound
    on what reaches the driver), as many as cost least (``fitted_cells``), or of about ``cell_rows`` rows. Besides its home, a row visits
    the cells beyond whose border a linked vector may lie (``reach``), so that no link is missed. Rows at home in a crowded
    cell are cut into blocks (of ``block`` rows; if not given, a sixth of the table, but at least 2048 rows and at most
    ``block_bytes``) and meet each other's blocks and those of the visitors, and each pair of blocks is one group
    of products, so that the cell is spread over many tasks. A pair counts in one of the homes of its two rows. What leaves a group is
    each row's count of links and the first row it is joined with, not the pairs.

    A vector that takes no part has no links and is its own component; a null key has no links and a null
    component. Rows with equal vectors are linked with each other, also under one key; a key's different vectors are rows of their own. An empty table
    gives no rows. Vectors that more than ``heavy_rows`` rows and more than a thousandth of all share (a thousand at most) are
    told to their rows by broadcast, so that no task of the last join has to take a whole such group.
    """
    rows = usable(frame, key, vector)
    unique = rows.groupBy("v").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("w"))
    unique = checkpointed(unique.withColumn("u", F.monotonically_increasing_id()))
    found = [_links(unique.where(F.size("v") == n), threshold, cell_rows, block, block_bytes // (8 * n), sample_rows) for n in lengths(unique)]
    links = reduce(DataFrame.unionByName, found) if found else frame.sparkSession.createDataFrame([], LINKS)
    classes = components(links.select(F.col("u").alias("a"), F.col("root").alias("b")))
    linked = unique.join(links.groupBy("u").agg(F.sum("links").alias("links")), "u", "left").join(classes, F.col("u") == F.col("node"), "left")
    linked = checkpointed(linked.select("v", "least", "w", "links", "component"))
    smallest = linked.where("component IS NOT NULL").groupBy("component").agg(F.min("least").alias("c"))
    summary = linked.join(smallest, "component", "left").select("v", "w", F.struct((F.coalesce("links", F.lit(0)) + F.col("w") - 1).alias("n"), F.coalesce("c", "least").alias("c")).alias("s"))
    summary = checkpointed(summary)
    total = unique.agg(F.sum("w")).first()[0] or 0
    heavy = F.col("w") > max(heavy_rows, total // 1000)
    every = frame.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    many = summary.where(heavy).select("v", "s")
    if many.isEmpty():
        told = every.join(summary.select("v", "s"), "v", "left")
    else:
        told = every.join(F.broadcast(many), "v").unionByName(every.join(F.broadcast(many.select("v")), "v", "left_anti").join(summary.where(~heavy).select("v", "s"), "v", "left"))
    known = F.col("id").isNotNull()
    component = F.when(known, F.coalesce("s.c", "id"))
    return told.select(F.col("id").alias(key), F.when(known, F.coalesce("s.n", F.lit(0))).otherwise(F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))


LINKS = "u long, links long, root long"


def _links(unique: DataFrame, threshold: float, cell_rows: int | None, block: int | None, most: int, sample_rows: int) -> DataFrame:
    """Each vector's count of links and the first it is joined with, by group of products."""
    total = unique.count()
    block = block or max(1, min(most, max(2048, total // 6)))
    share = min(1.0, sample_rows / total)
    drawn = unique.where(F.pmod(F.xxhash64("v"), F.lit(1 << 20)) < F.lit(int(share * (1 << 20)) + 1)).select("u", "v").toArrow()
    x = unit_rows(matrix(drawn.column("v").combine_chunks())[np.argsort(drawn.column("u").to_numpy(), kind="stable")])
    far = reach(threshold)
    if cell_rows:
        centres = spherical_kmeans(x, max(1, min(round(total / cell_rows), len(x) // 4)))
    else:
        centres = fitted_cells(x, total, block, far) if len(x) else np.ones((1, 1))
    held = unique.sparkSession.sparkContext.broadcast((centres, gaps(centres)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, gap = held.value
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                b = whole.slice(at, 1024)
                unit = unit_rows(matrix(b.column(0)))
                s = unit @ centre.T
                home = s.argmax(1)
                near = near_cells(s, home, gap, far)
                row, cell = np.nonzero(near)
                take, raw = pa.array(row), [r.tobytes() for r in unit]
                visits = [np.flatnonzero(r).astype("<i4").tobytes() for r in near]
                also = [visits[i] if home[i] == c else None for i, c in zip(row, cell)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cell.astype(np.int32)), pa.array(home[row].astype(np.int32)), b.column(1).take(take), b.column(2).take(take), pa.array([raw[i] for i in row], pa.binary()), pa.array(also, pa.binary())],
                    ["cell", "home", "u", "w", "unit", "also"],
                )

    placed = checkpointed(unique.select("v", "u", "w").mapInArrow(place, "cell int, home int, u long, w long, unit binary, also binary"))
    # as many rows as there are centres, which the sample bounds
    own, every = F.sum((F.col("home") == F.col("cell")).cast("long")), F.count(F.lit(1))
    sizes = placed.groupBy("cell").agg(own.alias("own"), every.alias("every")).where("own > 0")
    whole = F.col("every") <= block
    sizes = sizes.select("cell", F.ceil(F.col("own") / block).cast("int").alias("a"), F.when(whole, 0).otherwise(F.ceil((F.col("every") - F.col("own")) / block)).cast("int").alias("b"))
    dealt = placed.join(F.broadcast(sizes), "cell")
    mark, at_home = F.xxhash64("u", "unit"), F.col("home") == F.col("cell")
    dealt = dealt.withColumn("blk", F.when(at_home | (F.col("b") == 0), F.pmod(mark, F.col("a"))).otherwise(F.col("a") + F.pmod(mark, F.greatest("b", F.lit(1)))).cast("int"))
    others = F.sequence(F.lit(0), F.when(F.col("blk") < F.col("a"), F.col("a") + F.col("b")).otherwise(F.col("a")) - 1)
    dealt = dealt.withColumn("p", F.explode(F.transform(others, lambda o: F.struct(F.least("blk", o).alias("x"), F.greatest("blk", o).alias("y")))))

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        cell, x, y = int(group["cell"].iloc[0]), int(group["x"].iloc[0]), int(group["y"].iloc[0])
        blk, home, u, w, also = (group[c].to_numpy() for c in ("blk", "home", "u", "w", "also"))
        unit = np.frombuffer(b"".join(group["unit"]), np.float64).reshape(len(group), -1)
        rough = unit.astype(np.float32)
        here, there = np.flatnonzero((blk == x) & (home == cell)), np.flatnonzero(blk == y)
        links, label = np.zeros(len(group), np.int64), np.arange(len(group))
        for at in range(0, len(here), 512):
            one = here[at : at + 512]
            i, j = np.nonzero(rough[one] @ rough[there].T >= threshold - 1e-4)  # single precision finds, double decides
            i, j = one[i], there[j]
            if x == y:
                once = (home[j] != cell) | (i < j)
                i, j = i[once], j[once]
            exact = np.concatenate([np.einsum("ij,ij->i", unit[i[k : k + 65536]], unit[j[k : k + 65536]]) for k in range(0, len(i), 65536)] or [np.zeros(0)])
            i, j = i[exact >= threshold], j[exact >= threshold]
            mine = home[j] >= cell
            later = np.flatnonzero(~mine)  # here only if the pair does not meet in the other home
            if len(later):
                who, back = np.unique(i[later], return_inverse=True)
                for k, r in enumerate(who):
                    pairs = later[back == k]
                    mine[pairs] = ~np.isin(home[j[pairs]], np.frombuffer(also[r], "<i4"))
            i, j = i[mine], j[mine]
            links += (np.bincount(i, w[j], len(group)) + np.bincount(j, w[i], len(group))).astype(np.int64)
            label = joined(label, i, j)
        out = np.flatnonzero(links)
        return pd.DataFrame({"u": u[out], "links": links[out], "root": u[label[out]]})

    dealt = dealt.select("cell", "p.x", "p.y", "blk", "home", "u", "w", "unit", "also")
    return checkpointed(dealt.groupBy("cell", "x", "y").applyInPandas(compare, LINKS))


def unit_rows(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, without overflow on the way."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def near_vectors_query(frame: DataFrame) -> DataFrame:
    return near_vectors(frame)
