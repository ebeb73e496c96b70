"""Iterations that do not converge say so; factors and frames that keep their digits and their imaginary parts."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from eigenfold import matrix
from eigenfold.matrix import NotConverged, of_array, of_entries
from eigenfold.operators import parts as P
from eigenfold.operators import singular
from eigenfold.operators.singular import svds
from eigenfold.operators.transform import conjugate_gradient, gmres
from eigenfold.sources import matrices as src


def line(n):
    i = np.r_[np.arange(n), np.arange(n - 1), np.arange(1, n)]
    j = np.r_[np.arange(n), np.arange(1, n), np.arange(n - 1)]
    return of_entries(i, j, np.r_[np.full(n, 2.0), np.full(2 * n - 2, -1.0)], n, n)


def test_smallest_singular_values_of_a_long_line():
    """The values that an unconverged Lanczos process once gave as converged."""
    known = 2 - 2 * np.cos(np.pi * np.array([1, 2]) / 1001)
    r = svds(line(1000), nsv=2, which="smallest", solver="trlanczos")
    assert r.nconv == 2 and r.reason == "tolerance" and np.allclose(r.values, known, rtol=1e-6)
    for solver in ("trlanczos", "cyclic"):
        r = svds(line(2200), nsv=2, which="smallest", solver=solver)
        assert (r.nconv == 2 and np.allclose(r.values, 2 - 2 * np.cos(np.pi * np.array([1, 2]) / 2201), rtol=1e-5)) or (r.nconv < 2 and r.reason == "iterations")
    a = np.random.default_rng(0).standard_normal((40, 12))
    r = svds(a, nsv=3, which="smallest", solver="trlanczos")
    assert np.allclose(r.values, np.linalg.svd(a)[1][::-1][:3]) and np.allclose(a @ r.v, r.u * r.values, atol=1e-8)
    assert np.allclose(svds(np.outer(a[0], a[1]), nsv=1, which="smallest", solver="trlanczos").values, 0, atol=1e-10)


def test_linear_solves_raise():
    rng = np.random.default_rng(0)
    a = rng.standard_normal((80, 80))
    b = rng.standard_normal(80)
    for m in (a + 10 * np.eye(80), a + 10 * np.eye(80) + 1j * rng.standard_normal((80, 80))):
        assert np.linalg.norm(m @ gmres(lambda x: m @ x, b) - b) < 1e-9
    assert not gmres(lambda x: a @ x, np.zeros(80)).any()
    with pytest.raises(NotConverged):
        gmres(lambda x: a @ x, b, restart=5, most=3)
    assert gmres(lambda x: a @ x, b, restart=5, most=3, strict=False).shape == (80,)
    spd = a @ a.T + np.eye(80)
    assert np.linalg.norm(spd @ conjugate_gradient(lambda x: spd @ x, b) - b) < 1e-8
    with pytest.raises(NotConverged, match="not positive"):
        conjugate_gradient(lambda x: (spd - 50 * np.eye(80)) @ x, b)
    with pytest.raises(NotConverged):
        conjugate_gradient(lambda x: spd @ x, b, most=3)


def test_imaginary_parts_are_carried(spark):
    rng = np.random.default_rng(1)
    a, b = (rng.standard_normal((4, 4)) + 1j * rng.standard_normal((4, 4)) for _ in range(2))
    frame = lambda m: spark.createDataFrame([(i, j, float(v.real), float(v.imag)) for (i, j), v in np.ndenumerate(m)], "i long, j long, v double, vi double")
    real = spark.createDataFrame([(i, j, float(v.real)) for (i, j), v in np.ndenumerate(b)], "i long, j long, v double")
    full = lambda df, n=4: matrix.Matrix(df, n, n).dense()
    assert np.allclose(full(matrix.matmul(frame(a), frame(b))), a @ b) and np.allclose(full(matrix.matmul(frame(a), real)), a @ b.real)
    assert np.allclose(full(matrix.combined([(2.0, frame(a)), (1 - 1j, real)])), 2 * a + (1 - 1j) * b.real)
    assert np.allclose(full(matrix.gram_frame(frame(a))), a.conj().T @ a)
    assert np.allclose(full(matrix.tiled(spark, [[(2.0, frame(a)), None], [None, (1.0, real)]], 4, 4), 8), np.block([[2 * a, np.zeros((4, 4))], [np.zeros((4, 4)), b.real]]))
    x = spark.createDataFrame([(0, 1.0)], "i long, x double")
    for use in (lambda: matrix.joined_sum(frame(a), x), lambda: matrix.joined_block(frame(a), x.select("i", F.array("x").alias("x")), 1), lambda: matrix.balanced_frame(frame(a))):
        with pytest.raises(ValueError, match="imaginary"):
            use()


def tall(spark, x, partitions=4):
    return spark.createDataFrame([(i, [float(c) for c in r]) for i, r in enumerate(x)], "i long, x array<double>").repartition(partitions)


@pytest.mark.parametrize("kind", ["plain", "graded", "dependent", "short"])
def test_joint_factor(spark, kind):
    rng = np.random.default_rng(2)
    a, b = rng.standard_normal((60, 5)), rng.standard_normal((45, 5))
    if kind == "graded":  # a Gram matrix would lose the small columns
        a, b = a * 10.0 ** -np.arange(0, 15, 3), b * 10.0 ** -np.arange(0, 15, 3)
    if kind == "dependent":
        a[:, 4], b[:, 4] = a[:, 0], b[:, 0]
    if kind == "short":
        a = a[:2]
    f = singular.joint_factor(tall(spark, a), tall(spark, b, 1))
    r = 4 if kind == "dependent" else 5
    assert len(f.c) == r and np.allclose(f.c**2 + f.s**2, 1, atol=1e-12) and (np.diff(f.c) <= 1e-12).all()
    assert np.allclose(np.linalg.norm(a @ f.x, axis=0), f.c, atol=1e-9) and np.allclose(np.linalg.norm(b @ f.x, axis=0), f.s, atol=1e-9)
    assert np.allclose(f.product(f.c**2), a.T @ a) and np.allclose(f.product(f.s**2), b.T @ b)
    if kind in ("plain", "short"):
        known = np.sqrt(np.maximum(np.sort(np.linalg.eigvals(np.linalg.solve(b.T @ b, a.T @ a)).real)[::-1], 0))
        assert np.allclose(singular.frame_gsvd(tall(spark, a), tall(spark, b), 3).values, known[:3], atol=1e-7)
        h = singular.frame_hsvd(tall(spark, a), tall(spark, b))
        assert np.allclose(np.sort(h.signature * h.values**2), np.linalg.eigvalsh(a.T @ a - b.T @ b))


def test_joint_factor_of_nothing(spark):
    none = spark.createDataFrame([], "i long, x array<double>")
    assert len(singular.joint_factor(none, none).c) == 0


def test_balanced_frame(spark):
    rng = np.random.default_rng(3)
    a = rng.random((9, 9)) * 10.0 ** rng.integers(-3, 4, (9, 1)) / 10.0 ** rng.integers(-3, 4, (1, 9))
    a[8, :8] = 0  # a place with a column, but no row off the diagonal, stays
    df = spark.createDataFrame([(i, j, float(v)) for (i, j), v in np.ndenumerate(a) if v], "i long, j long, v double")
    scaled, d, _ = matrix.balanced_frame(df.where("i < 8 AND j < 8"), 1e-9)
    b = matrix.Matrix(scaled, 9, 9).dense()
    off = b - np.diag(np.diag(b))
    assert np.allclose(off[:8, :8].sum(0), off[:8, :8].sum(1)) and np.allclose(np.sort_complex(np.linalg.eigvals(b[:8, :8])), np.sort_complex(np.linalg.eigvals(a[:8, :8])))
    assert {r["i"] for r in d.collect()} == set(range(8))
    with pytest.raises(NotConverged):
        matrix.balanced_frame(df.where("i < 8 AND j < 8"), 1e-12, most=2)
    assert matrix.balanced_frame(df.where("i = j"))[0].count() == 9


def test_low_rank_terms_beside_a_sparse_matrix(spark):
    n = 60
    df = src.stencil(spark, (10, 6))
    a = np.zeros((n, n))
    for r in df.collect():
        a[r["i"], r["j"]] += r["v"]
    u, s = np.random.default_rng(4).standard_normal((n, 2)), np.array([[0.5, -1.0], [-1.0, 0.0]])
    parts = P.Parts(df, n, parts=3)
    low = parts.vectors(spark.createDataFrame([(i, [float(c) for c in r]) for i, r in enumerate(u)], "i long, x array<double>"), 2, "u"), s
    w = np.linalg.eigvalsh(a + u @ s @ u.T)
    for which, want in (("largest_real", w[::-1][:3]), ("smallest_real", w[:3])):
        assert np.allclose(P.eigenpairs(parts, nev=3, which=which, ncv=15, block=3, low=low).checked().values, want, atol=1e-6)
