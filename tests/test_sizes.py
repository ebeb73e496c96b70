"""Parts of equal work, products on the short side, and squares of a Gram matrix, against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from eigenfold.operators import parts as P
from eigenfold.operators import singular


@pytest.fixture(scope="module")
def tall(spark):
    """300 rows of up to nine entries in 12 columns, one place twice, as a frame and as an array."""
    ids = spark.range(300).select(F.col("id").alias("i"), F.explode(F.sequence(F.lit(0), (F.col("id") % 9).cast("int"))).alias("t"))
    df = ids.select("i", ((F.col("i") * 7 + F.col("t") * 5) % 12).alias("j"), (1.0 + (F.col("i") * 3 + F.col("t")) % 4).alias("v"))
    a = np.zeros((300, 12))
    for r in df.collect():
        a[r["i"], r["j"]] += r["v"]
    return df, a


def bipartite(df):
    half = df.select(F.col("j").alias("i"), (F.col("i") + 12).alias("j"), "v")
    return half.unionByName(half.select(F.col("j").alias("i"), F.col("i").alias("j"), "v"))


def test_parts_have_equal_work(spark, tall):
    """The short side's rows, which come first and have half of all entries, do not fall to the first part."""
    parts = P.Parts(bipartite(tall[0]), 312, parts=6)
    entries = parts.parts.map(lambda part: len(part.vals) + len(part.far_vals)).collect()
    assert sum(entries) == 2 * tall[0].count() and max(entries) <= 2 * sum(entries) / 6
    parts.unpersist()


def test_parts_are_bounded_by_rows(spark, monkeypatch):
    monkeypatch.setattr(P, "PART_ROWS", 50)
    df = spark.createDataFrame([(0, 399, 1.0), (399, 0, 1.0)], "i long, j long, v double")
    parts = P.Parts(df, 400)
    assert parts.count >= 8 and max(parts.parts.map(lambda part: part.rows).collect()) <= 75
    parts.unpersist()


def test_uncoupled_rows_keep_no_inverse(spark, tall):
    parts = P.Parts(bipartite(tall[0]), 312, parts=3)
    assert sum(len(c) for c in parts.parts.map(lambda part: part.diagonal_cells(4)[1]).collect()) <= 3
    parts.unpersist()


@pytest.mark.parametrize("count", [1, 5, 40])
def test_product_on_the_short_side(spark, tall, count):
    df, a = tall
    parts = P.Normal(df, 300, 12, parts=count)
    x = np.random.default_rng(1).standard_normal((12, 2))
    b = parts.vectors(spark.createDataFrame([(k, [float(c) for c in r]) for k, r in enumerate(x)], "i long, x array<double>"), 2)
    _, total = parts.step(b, lambda part, s: s, lambda s: s["b"], lambda part, s, y: {"y": y, "x": s["b"]}, lambda part, s: s["x"].T @ s["y"])
    assert np.allclose(total, x.T @ (a.T @ (a @ x)))
    parts.unpersist()


def test_values_of_a_tall_frame(spark, tall):
    df, a = tall
    want = np.linalg.svd(a, compute_uv=False)[:3]
    assert np.allclose(singular.tall_svd(df, 300, 12, nsv=3).values, want, rtol=1e-8)
    wide = df.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")
    assert np.allclose(singular.tall_svd(wide, 12, 300, nsv=3).values, want, rtol=1e-8)


@pytest.mark.parametrize("pairs,at_once", [(10**6, 10**6), (200, 30), (200, 2)])
def test_squares_of_the_gram_matrix(spark, tall, monkeypatch, pairs, at_once):
    monkeypatch.setattr(P, "PAIRS", pairs)
    monkeypatch.setattr(P, "PAIRS_AT_ONCE", at_once)
    df, a = tall
    assert np.isclose(P.gram_squares(df, 12), ((a.T @ a) ** 2).sum(), rtol=1e-12)


def test_values_at_the_edge_of_a_dense_spectrum(spark):
    """The second and third value are 3e-4 apart, as those of a long short side are; 200 steps of a narrow basis do not part them."""
    n = 3000
    square = np.append(18.0, 1.01 - np.arange(n - 1) / n)
    df = spark.createDataFrame([(k, k, float(np.sqrt(x))) for k, x in enumerate(square)], "i long, j long, v double")
    assert np.allclose(singular.tall_svd(df, n, n, nsv=3).values, np.sqrt(square[:3]), rtol=1e-8)
