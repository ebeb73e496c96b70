"""SimHash fingerprints of word shingles, linked through a generalised pigeonhole index.

Bits that go together share a partition; dynamic programming gives the partitions
unequal thresholds (-1: not probed) that sum to ``distance - partitions + 1``, so that any two
fingerprints within ``distance`` agree within its threshold on some partition. Values in a
partition are looked up within its threshold and verified on all bits. A crowded bucket is split
by the same principle once more over the remaining bits, and what is still crowded is linked
through the fingerprints one bit away, of which two fingerprints within two bits share one:
stars instead of pairs, nothing left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpointed, components, map_arrow, of_sized, slices

BITS = 64


def fingerprint(text: str | None, words: int = 3, seed: int = 42, block: int = 1 << 15) -> int:
    """The majority bits of the XXH64 of all shingles, repeats included."""
    parts = (text or "").encode("utf8", "surrogatepass").lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(parts) - words + 1)
    last = ends[words - 1 :] if len(parts) >= words else ends[-1:]
    counts = np.zeros(BITS, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, block):
        spans = zip(starts[at : min(n, at + block)].tolist(), last[at : at + block].tolist())
        h = np.array([digest(joined[a:b], seed) for a, b in spans], np.uint64)
        counts += np.unpackbits(h.view(np.uint8).reshape(len(h), 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 3) -> DataFrame:
    """(key, fp): the fingerprint as a signed long; a null or blank text has 0."""
    frame = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    schema = T.StructType([T.StructField(key, docs.schema[key].dataType), T.StructField("fp", T.LongType())])

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part in slices(batch):
            found = np.array([fingerprint(t, words) for t in part.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found.view(np.int64))], [key, "fp"])

    return map_arrow(frame, run, schema)


def partition_bits(sample: np.ndarray, parts: int) -> list[list[int]]:
    """Bits grouped by correlation: each group grows by the bit most correlated with it."""
    x = ((sample[:, None] >> np.arange(BITS, dtype=np.uint64)) & np.uint64(1)).astype(float)
    x -= x.mean(0) if len(x) else 0
    scale = np.sqrt((x * x).sum(0))
    corr = np.abs(x.T @ x) / np.maximum(np.outer(scale, scale), 1e-9)
    np.fill_diagonal(corr, 0)
    left, groups = set(range(BITS)), []
    for k in range(parts):
        size = BITS // parts + (k < BITS % parts)
        seed = max(left, key=lambda b: (max((corr[b, o] for o in left if o != b), default=0), -b))
        group = [seed]
        left.discard(seed)
        while len(group) < size:
            best = max(left, key=lambda b: (corr[b, group].sum(), -b))
            group.append(best)
            left.discard(best)
        groups.append(sorted(group))
    return groups


def allocate(cost: list[list[float]], distance: int, parts: int) -> list[int]:
    """Thresholds from -1 to ``distance`` that sum to ``distance - parts + 1`` at the least total cost;
    ``cost[k][t + 1]`` is that of threshold t in partition k."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}  # by the thresholds' sum so far
    for k in range(parts):
        new: dict[int, tuple[float, list[int]]] = {}
        for total, (c, ts) in best.items():
            for t in range(-1, distance + 1):
                x = (c + cost[k][t + 1], [*ts, t])
                if total + t not in new or x < new[total + t]:
                    new[total + t] = x
        best = new
    return best[distance - parts + 1][1]


def estimated_costs(sample: np.ndarray, groups: list[list[int]], distance: int, total: int, near: int = 12, key_cost: float = 4.0) -> list[list[float]]:
    """Candidates by threshold (from -1) in each partition: the pairs of the sample within it, scaled up to all
    fingerprints, plus ``key_cost`` for each value that is looked up. Pairs within ``near`` bits are
    left out: copies meet under any partition, and their number does not grow with the square."""
    found = np.zeros((len(groups), distance + 1))
    masks = [np.uint64(sum(1 << b for b in g)) for g in groups]
    for at in range(0, len(sample), 500):
        x = sample[at : at + 500, None] ^ sample[None, :]
        far = np.bitwise_count(x) > near
        for k, m in enumerate(masks):
            found[k] += np.bincount(np.bitwise_count(x & m)[far], minlength=distance + 1)[: distance + 1]
    scale = (total / max(len(sample), 1)) ** 2 / 2
    costs = []
    for g, n in zip(groups, found):
        row = [0.0]
        for t in range(distance + 1):
            probes = sum(math.comb(len(g), i) for i in range(t + 1)) + (t > 0)
            row.append(float(n[: t + 1].sum() * scale + total * probes * key_cost))
        costs.append(row)
    return costs


def plan(sample: np.ndarray, distance: int, total: int) -> tuple[list[list[int]], list[int]]:
    """Partitions and thresholds of the least estimated cost, over numbers of partitions up to ``distance + 1``:
    few fingerprints are told apart by short values, many need longer ones and more look-ups."""
    best = None
    for parts in range(2, distance + 2):
        groups = partition_bits(sample, parts)
        costs = estimated_costs(sample, groups, distance, total)
        thresholds = allocate(costs, distance, parts)
        cost = sum(c[t + 1] for c, t in zip(costs, thresholds))
        if best is None or cost < best[0]:
            best = (cost, groups, thresholds)
    return best[1], best[2]


def flips(bits: list[int], most: int) -> list[int]:
    """Masks of up to ``most`` of ``bits``, as signed longs."""
    masks = [sum(1 << b for b in c) for n in range(most + 1) for c in combinations(bits, n)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in masks]


def signed(mask: int) -> int:
    return mask - (1 << 64) if mask >= 1 << 63 else mask


def links(unique: DataFrame, distance: int = 2, crowd: int = 48, sample_rows: int = 8000) -> DataFrame:
    """Edges (a, b) between different fingerprints ``fp`` of ``unique``, as many as join all that
    are linked within ``distance`` bits (at most 2) into one component.

    ``sample_rows`` bounds the sample that the partitions and thresholds are fitted on;
    ``crowd`` is the bucket size from which a bucket is split further.
    """
    if distance > 2:
        raise ValueError("crowded buckets are split exactly for distances up to 2")
    total = unique.count()
    share = min(1.0, sample_rows / max(total, 1))
    drawn = unique.where(F.pmod(F.xxhash64("fp"), F.lit(1 << 20)) < F.lit(int(share * (1 << 20)) + 1))
    sample = np.array(sorted(r[0] for r in drawn.select("fp").collect()), np.int64).view(np.uint64)
    sample = np.random.default_rng(0).permutation(sample)
    groups, thresholds = plan(sample, distance, total)
    rows = []
    for k, (g, t) in enumerate(zip(groups, thresholds)):
        if t < 0:
            continue
        mask = F.lit(signed(sum(1 << b for b in g)))
        for m in flips(g, t):
            rows.append(F.struct(F.lit(k).alias("part"), F.col("fp").bitwiseXOR(F.lit(m)).bitwiseAND(mask).alias("value"), F.lit(m == 0).alias("own")))
    keys = unique.select("fp", F.explode(F.array(*rows)).alias("k")).select("fp", "k.part", "k.value", "k.own")
    return paired(keys, ["part", "value"], groups, distance, crowd)


def paired(keys: DataFrame, by: list[str], groups: list[list[int]], distance: int, crowd: int) -> DataFrame:
    """Verified edges of the rows that share ``by``; crowded ones go through ``split``."""
    keys = checkpointed(keys)
    sizes = keys.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.max("own").alias("indexed")).where("n > 1 AND indexed")
    sizes = checkpointed(sizes, keys.count())
    few = keys.join(sizes.where(F.col("n") <= crowd).select(*by), by)
    own = few.where("own").select(*by, F.col("fp").alias("a"))
    near = own.join(few.select(*by, F.col("fp").alias("b")), by).where("a <> b").where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance)
    edges = near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    hot = sizes.where(F.col("n") > crowd)
    if hot.isEmpty():
        return edges.distinct()
    crowded = of_sized(keys, hot, by)
    return edges.unionByName(split(crowded, by, groups, distance, crowd)).distinct()


def split(crowded: DataFrame, by: list[str], groups: list[list[int]], distance: int, crowd: int) -> DataFrame:
    """Edges inside crowded buckets. Two fingerprints within ``distance`` also agree exactly on one of
    ``distance + 1`` pieces of every partition's complement; buckets of the same
    pieces are small where the bucket is only common, and large only in a dense ball."""
    pieces = distance + 1
    choice = F.lit(None)
    for k, g in enumerate(groups):
        rest = [b for b in range(BITS) if b not in g]
        masks = [F.lit(signed(sum(1 << b for b in rest[p::pieces]))) for p in range(pieces)]
        subs = F.array(*[F.struct(F.lit(p).alias("piece"), F.col("fp").bitwiseAND(m).alias("sub")) for p, m in enumerate(masks)])
        choice = F.when(F.col("part") == k, subs).otherwise(choice)
    fine = crowded.select(*by, "fp", "own", F.explode(choice).alias("s")).select(*by, "fp", "own", "s.piece", "s.sub")
    fine = checkpointed(fine, crowded.count() * pieces)
    keys = [*by, "piece", "sub"]
    sizes = checkpointed(fine.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.max("own").alias("indexed")).where("n > 1 AND indexed"), fine.count())
    few = fine.join(sizes.where(F.col("n") <= crowd).select(*keys), keys)
    near = (
        few.where("own").select(*keys, F.col("fp").alias("a"))
        .join(few.select(*keys, F.col("fp").alias("b")), keys)
        .where("a <> b").where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance)
    )
    edges = near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    dense = of_sized(fine, sizes.where(F.col("n") > crowd), keys).select("fp").distinct()
    # two fingerprints within two bits share one that is at most one bit from each
    around = F.array(*[F.col("fp").bitwiseXOR(F.lit(m)) for m in flips(list(range(BITS)), 1)])
    balls = dense.select("fp", F.explode(around).alias("centre"))
    stars = balls.groupBy("centre").agg(F.collect_set("fp").alias("fps")).where(F.size("fps") > 1)  # at most 65 in each
    stars = stars.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).where("a <> b")
    return edges.unionByName(stars)


def simhash_components(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 3, distance: int = 2) -> DataFrame:
    """(key, fp, component_id) of every row: the smallest key reachable through links.

    Rows with equal fingerprints belong together; null and blank texts have fingerprint 0 and are
    linked like any other. A row with a null key takes part, and a component of nothing but
    null keys has a null component_id. Repeated rows give repeated results; an empty
    table gives none; other columns are not read.
    """
    marks = checkpointed(fingerprints(docs, key, text, words))
    unique = checkpointed(marks.groupBy("fp").agg(F.min(key).alias("least")), marks.count())
    total = unique.count()
    edges = links(unique.select("fp"), distance)
    found = components(edges, about=total)
    labelled = unique.join(found, unique.fp == found.node, "left").select("fp", "least", F.coalesce("component", "fp").alias("label"))
    smallest = labelled.groupBy("label").agg(F.min("least").alias("component_id"))
    classes = checkpointed(labelled.join(smallest, "label").select("fp", "component_id"), total)
    return marks.join(classes, "fp").select(key, "fp", "component_id")


def simhash_query(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint in hexadecimal, component_id."""
    return simhash_components(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def representatives(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each component, with all columns: the one with the smallest key. Rows with a null key
    stay. A key that occurs more than once in what is kept is kept once."""
    found = checkpointed(simhash_components(docs, key, text))
    kept = found.where(F.col(key) == F.col("component_id")).groupBy(key).count()
    rows = docs.where(F.col(key).isNotNull()).join(kept.select(key), key, "left_semi")
    if not kept.where("count > 1").isEmpty():
        rows = rows.dropDuplicates([key])
    return rows.unionByName(docs.where(F.col(key).isNull())).select(*docs.columns)
