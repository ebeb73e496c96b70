"""Centroid clustering, collocations and mixing against plain versions and their odd cases."""

import hashlib
import re
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from eigenfold.llm import centroids, collocations, mixing

# --- centroids ------------------------------------------------------------------------------

EMBEDDINGS = "vec_id long, embedding array<double>, id string, v int, k int, cluster string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, x, "a", 1, 2, "b") for i, x in rows], EMBEDDINGS)


def plain_clusters(rows, k, rounds, length, scale=256):
    kept = [(i, [p * scale // q for p, q in (float(c).as_integer_ratio() for c in x)]) for i, x in rows if x is not None and len(x) == length and all(c is not None and np.isfinite(c) for c in x)]
    kept.sort(key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1]))
    c = [z for _, z in kept[:k]]
    near = lambda z: min((sum((a - b) ** 2 for a, b in zip(z, m)), j) for j, m in enumerate(c))
    for _ in range(rounds):
        of = [near(z)[1] for _, z in kept]
        groups = [[z for (_, z), j in zip(kept, of) if j == at] for at in range(len(c))]
        c = [[sum(col) // len(g) for col in zip(*g)] if g else old for g, old in zip(groups, c)]
    out = [(i, *near(z)) for i, z in kept]
    return c, out


@pytest.mark.parametrize("kind", ["plain", "ties", "wide", "huge"])
def test_clusters_against_plain_version(spark, kind):
    rng = np.random.default_rng(3)
    x = {"plain": rng.standard_normal((120, 6)), "ties": rng.integers(-1, 2, (120, 6)) / 256, "wide": rng.standard_normal((40, 6)) * 1e6, "huge": rng.standard_normal((20, 6)) * 10.0 ** rng.integers(-3, 25, (20, 6))}[kind]
    rows = [(int(i), [float(c) for c in r]) for i, r in enumerate(x)]
    rows += [(500, None), (501, [1.0] * 5), (502, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (503, [float("nan")] * 6), (504, [float("inf")] * 6), (505, []), rows[3], (None, [0.1] * 6)]
    got = centroids.clusters(vectors(spark, rows).repartition(3), length=6, k=7, rounds=3).collect()
    c, want = plain_clusters(rows, 7, 3, 6)
    top = lambda d: d if d < 1 << 63 else None
    assert Counter((r["vec_id"], r["cluster"], r["distance"]) for r in got) == Counter((i, j, top(d)) for i, d, j in want)
    digests = [hashlib.sha256(",".join(map(str, m)).encode()).hexdigest() for m in c]
    for r in got:
        assert r["centroid_sha256"] == digests[r["cluster"]]
        assert r["cluster_inertia"] == top(sum(d for _, d, j in want if j == r["cluster"])) and r["inertia"] == top(sum(d for _, d, _ in want))


def test_few_or_no_vectors(spark):
    assert centroids.clusters(vectors(spark, []), length=6, k=7).collect() == []
    got = centroids.clusters(vectors(spark, [(1, [0.5] * 6), (2, [0.5] * 6)]), length=6, k=7).collect()
    assert [(r["cluster"], r["distance"]) for r in got] == [(0, 0), (0, 0)]


def test_jobs_do_not_follow_the_shuffle_partitions(spark):
    held = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    rows = vectors(spark, [(i, [float(i), 1.0]) for i in range(30)]).repartition(3)
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        spark.sparkContext.setJobGroup("centroids", "")
        assert len(centroids.clusters(rows, length=2, k=30, rounds=3).collect()) == 30
        assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("centroids")) < 40  # a round read its groups by one job a partition
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        for k, v in before.items():
            spark.conf.set(k, v)


def test_rounding_intervals_hold_and_screen():
    rng = np.random.default_rng(0)
    for size in (300, 1 << 20, centroids.PLAIN):
        z, c = rng.integers(-size, size + 1, (500, 64)), rng.integers(-size, size + 1, (30, 64))
        value, error = centroids.bounds(z, c)
        true = (c.astype(object) ** 2).sum(1)[None, :] - 2 * (z.astype(object) @ c.astype(object).T)
        assert all(abs(Fraction(float(v)) - t) <= Fraction(float(e)) for v, t, e in zip(value.ravel(), true.ravel(), error.ravel()))
    z = rng.integers(-256, 257, (2000, 64))
    a = centroids.Assigner(z[:40])
    best = a.nearest(z)
    d = ((z[:, None] - z[None, :40]) ** 2).sum(2)
    assert (best == d.argmin(1)).all() and a.exact < 0.01 * d.size


# --- collocations -----------------------------------------------------------------------------

DOCUMENTS = "doc_id long, text string, lang string, source string, word string, n long, id long, a int"


def documents(spark, rows):
    """Rows of (text, lang) or (text, lang, source)."""
    return spark.createDataFrame([(k, *r, *["s"] * (3 - len(r)), "w", 1, 2, 3) for k, r in enumerate(rows)], DOCUMENTS)


def plain_collocations(rows, least, most=2000):
    counts, totals = {}, Counter()
    for text, lang in rows:
        f = counts.setdefault(lang or "und" if lang is None else lang, Counter())
        small = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", small):
            w = re.findall(r"[^ \t]+", piece)
            totals["und" if lang is None else lang] += len(w)
            for g in range(1, 5):
                f.update(tuple(w[i : i + g]) for i in range(len(w) - g + 1))
    out = []
    for lang, f in counts.items():
        often = {p: a for p, a in f.items() if a >= least}
        found = []
        for p, a in often.items():
            if len(p) == 1 or any(len(q) > len(p) and 100 * b >= 80 * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in often.items()):
                continue
            score, k = min((2000000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(found)[:most], 1):
            out.append((lang, rank, p.decode(), -a, left, right, totals[lang], -s))
    return sorted(out)


@pytest.mark.parametrize("share,at_once,block", [(50_000, 200_000, 8 << 20), (3, 5, 64)])
def test_collocations_against_plain_version(spark, share, at_once, block):
    """With the usual bounds, and with ones that split nearly every pivot, block and batch."""
    rng = np.random.default_rng(1)
    names = np.array(["a", "B", "the", "of", "été", "zz", "\U0001f600", "x y", "Ä"] + [f"rare{k}" for k in range(40)])
    chance = np.r_[np.full(9, 0.1), np.full(40, 0.1 / 40)]
    rows = []
    for k in range(80):
        w = rng.choice(names, 30, p=chance)
        text = "".join(str(t) + str(rng.choice([" ", "  ", "\t", ". ", ",", "\n", "\r\n"], p=[0.7, 0.05, 0.05, 0.05, 0.05, 0.05, 0.05])) for t in w)
        rows.append((text, [None, "und", "en", "fr"][k % 4]))
    rows += [(None, "en"), ("", "en"), (" . , ", None), ("the of the of the", "en"), ("the " * 3000, "en"), ("A b A b", "")] + rows[:7]
    got = collocations.collocations(documents(spark, rows).repartition(3), least=6, share=share, at_once=at_once, block=block).collect()
    assert sorted(map(tuple, got)) == plain_collocations(rows, 6)


def test_collocations_of_nothing(spark):
    for rows in ([], [(None, None)], [("one two", "en")]):
        assert collocations.collocations(documents(spark, rows)).collect() == []


def test_exact_scores_beyond_64_bits(spark):
    """2000000 a passes 64 bits."""
    a, l, r = 7 * 10**12, 10**13 + 1, 9 * 10**12  # noqa: E741
    row = spark.createDataFrame([(a, l, r)], "a long, l long, r long").withColumn("wide", F.col("a").cast("decimal(20,0)") * F.lit(2_000_000).cast("decimal(10,0)"))
    assert row.select(F.expr("wide div (l + r)")).first()[0] == 2_000_000 * a // (l + r)


# --- mixing -------------------------------------------------------------------------------------


def plain_targets(sizes, weights=(5, 2, 1), epochs=3):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    total, clamped = sum(sizes.values()), set()
    while True:
        rest = total - sum(epochs * sizes[s] for s in clamped)
        parts = sum(w[s] for s in names if s not in clamped)
        new = {s for s in names if s not in clamped and w[s] * rest > epochs * sizes[s] * parts}
        if not new:
            return {s: Fraction(epochs * sizes[s]) if s in clamped else Fraction(w[s] * rest, parts) for s in names}
        clamped |= new


def test_mixing_against_plain_version(spark):
    rng = np.random.default_rng(2)
    rows = []
    for k in range(400):
        source = [None, "", "a", "b", "", "\U0001f600", "tiny", "huge"][int(rng.choice(8, p=[0.1, 0.1, 0.1, 0.1, 0.1, 0.02, 0.01, 0.47]))]
        rows.append(("w \x0b\x1f " * int(rng.integers(0, 30)), "en", source))
    rows += [(None, "en", "a"), ("", "en", "silent"), ("x " * 9000, "en", "b"), ("only", "en", "z")]
    docs = documents(spark, rows)
    docs = docs.unionByName(docs.where("doc_id % 40 = 0")).unionByName(docs.where("doc_id = 7").withColumn("doc_id", F.lit(None).cast("long"))).unionByName(docs.where("doc_id = 7"))
    got = mixing.mixed(docs.repartition(5)).collect()
    again = mixing.mixed(docs.repartition(2)).collect()
    assert Counter(got) == Counter(again)
    want = Counter((r["doc_id"], r["source"], len(re.findall(r"[^ \t-\r]+", r["text"] or ""))) for r in docs.collect())
    assert Counter((r["doc_id"], r["source"], r["size"]) for r in got) == want
    sizes = Counter()
    for (_, s, z), n in want.items():
        sizes[s] += z * n
    goals = plain_targets(sizes)
    taken = Counter()
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == float(goals[r["source"]]) and 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    assert all(taken[s] == int(goals[s]) for s in sizes) and sum(goals.values()) == sum(sizes.values())


def test_many_copies_of_one_row(spark):
    docs = spark.range(25_000).select(F.lit(1).alias("doc_id"), F.lit("a b c").alias("text"), F.when(F.col("id") < 24_000, "hot").otherwise("z").alias("source"))
    got = mixing.mixed(docs).groupBy("source").agg(F.count("*").alias("n"), F.sum("taken").alias("t"), F.max("target").alias("g")).collect()
    assert {r["source"]: (r["n"], r["t"], r["g"]) for r in got} == {"hot": (24_000, 66_000, 66_000.0), "z": (1_000, 9_000, 9_000.0)}


def test_mixing_without_words(spark):
    assert mixing.mixed(documents(spark, [])).collect() == []
    got = mixing.mixed(documents(spark, [(None, "en", "a"), ("", "en", None)])).collect()
    assert [(r["size"], r["source_size"], r["target"], r["taken"]) for r in got] == [(0, 0, 0.0, 0)] * 2
