import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from eigenfold.functions import order, scalar
from eigenfold.functions.region import Ellipse, Interval, Polygon, Region, Ring
from eigenfold.matrix import Matrix, Operator, bse, combined, dense_rows, gram_frame, matmul, tiled
from eigenfold.operators import basis, singular
from eigenfold.operators.eigen import eigs
from eigenfold.plans import options
from eigenfold.sources import matrices as src
from eigenfold.streaming.running import RunningGram

rng = np.random.default_rng(0)


def coo(spark, a, parts=3):
    rows = [(i, j, float(v)) for (i, j), v in np.ndenumerate(a) if v]
    return spark.createDataFrame(rows, "i long, j long, v double").repartition(parts)


def block(spark, x, parts=3):
    return spark.createDataFrame([(i, [float(t) for t in r]) for i, r in enumerate(x)], "i long, x array<double>").repartition(parts)


def test_products(spark):
    a, b = rng.standard_normal((7, 5)), rng.standard_normal((5, 4))
    m = Matrix(coo(spark, a), 7, 5)
    assert np.allclose(m.apply(b), a @ b) and np.allclose(m.adjoint(a[:, 0]), a.T @ a[:, 0]) and np.allclose(m.dense(), a)
    m.unpersist()
    assert np.allclose(Matrix(matmul(coo(spark, a), coo(spark, b)), 7, 4).dense(), a @ b)
    assert np.allclose(Matrix(gram_frame(coo(spark, a)), 5, 5).dense(), a.T @ a)
    assert np.isclose(m.norm("inf"), np.abs(a).sum(1).max()) and np.isclose(m.norm("one"), np.abs(a).sum(0).max()) and np.isclose(m.norm("frobenius"), np.linalg.norm(a))
    assert m.norm_estimate(20) <= np.linalg.norm(a, 2) * 1.0001
    assert not Matrix(coo(spark, a[:5]), 5, 5).hermitian() and Matrix(coo(spark, a.T @ a), 5, 5).hermitian()


def test_complex_and_blocks(spark):
    rows = [(0, 1, 1.0, 2.0), (1, 0, 1.0, -2.0), (1, 1, 3.0, 0.0)]
    z = np.array([[0, 1 + 2j], [1 - 2j, 3]])
    m = Matrix(spark.createDataFrame(rows, "i long, j long, v double, vi double"), 2, 2)
    assert np.allclose(m.dense(), z) and np.allclose(m.apply(np.array([1.0, 1j])), z @ [1, 1j]) and m.hermitian()
    assert np.allclose(eigs(m, nev=2, solver="lapack", which="largest_real").values, np.linalg.eigvalsh(z)[::-1])
    h = Matrix(bse(m.df, m.df, 2), 4, 4).dense()
    assert np.allclose(h, np.block([[z, z], [-z.conj().T, -z.T]]))
    a = rng.standard_normal((2, 2))
    t = Matrix(tiled(spark, [[(2.0, coo(spark, a)), None], [None, (-1.0, coo(spark, a))]], 2, 2), 4, 4).dense()
    assert np.allclose(t, np.kron(np.diag([2.0, -1.0]), a))
    assert np.allclose(Matrix(combined([(2.0, coo(spark, a)), (3.0, coo(spark, a))]), 2, 2).dense(), 5 * a)
    assert dense_rows(block(spark, a).withColumnRenamed("i", "key"), "key", "x").count() == 4


def test_large_operator_stays_with_the_executors(spark):
    m = Matrix(src.stencil(spark, (2500,)), 2500, 2500)
    op = m.operator()
    assert isinstance(op, Operator) and np.isclose(op.norm, 4)
    r = eigs(op, nev=1, which="largest_real", problem="hep", tol=1e-4, copies=False)
    m.unpersist()
    assert abs(r.values[0] - 4) < 1e-2


@pytest.mark.parametrize("method", ["tsqr", "chol", "svqb", "gs", "tsqrchol"])
def test_orthogonalise(spark, method):
    x = rng.standard_normal((40, 6))
    q, r = basis.orthogonalised(block(spark, x), method)
    assert np.abs(basis.gram(q) - np.eye(6)).max() < 1e-10
    got = np.array([t["x"] for t in q.orderBy("i").collect()])
    assert np.allclose(got @ r, x)


@pytest.mark.parametrize("width", [1, 4, 16])
def test_gram_schmidt_by_blocks(spark, width):
    x = basis.random_conditioned(60, 6, 1e6, seed=3)
    q, r = basis.orthogonalised(block(spark, x), "gs", width)
    assert np.abs(basis.gram(q) - np.eye(6)).max() < 1e-10 and np.allclose(r, np.triu(r))
    assert np.allclose(np.array([t["x"] for t in q.orderBy("i").collect()]) @ r, x)


def test_basis(spark):
    x, y, q = rng.standard_normal((30, 3)), rng.standard_normal((30, 3)), rng.standard_normal((3, 3))
    fx, fy = block(spark, x), block(spark, y)
    rows = lambda f: np.array([t["x"] for t in f.orderBy("i").collect()])
    assert np.allclose(basis.dot(fy, fx), y.T @ x) and np.allclose(rows(basis.multiply(fx, q)), x @ q)
    assert np.allclose(rows(basis.updated(fy, fx, q, 2.0, -1.0)), -y + 2 * x @ q)
    assert np.isclose(basis.norm(fx), np.linalg.norm(x)) and np.isclose(basis.norm(fx, "max"), np.abs(x).max())
    assert np.allclose(np.linalg.norm(rows(basis.normalised(fx)), axis=0), 1)
    assert np.allclose(rows(basis.beside(fx, fy)), np.hstack([x, y])) and np.allclose(rows(basis.columns(fx, [2, 0])), x[:, [2, 0]])
    assert basis.split_rows(fx, 10)[1].count() == 20
    for kind in ("normal", "uniform", "sign"):
        a, b = (rows(basis.random(spark, 12, 2, kind, 1, p)) for p in (2, 5))
        assert np.array_equal(a, b)
    assert np.isclose(np.linalg.cond(basis.random_conditioned(20, 4, 1e3)), 1e3)
    for method in ("refine", "qr", "qr_caa"):
        u, s, rank = basis.svd_and_rank(x @ np.diag([1, 1, 0]), 1e-10, method)
        assert rank == 2


def test_frame_solvers(spark):
    x = rng.standard_normal((60, 8))
    exact = np.linalg.svd(x)[1]
    f = block(spark, x)
    for method in ("cross", "tsqr"):
        assert np.allclose(singular.frame_svd(f, 3, method)[0], exact[:3])
    assert np.allclose(singular.frame_randomized(f, 8, 2, extra=6)[0], exact[:2])
    a = src.stencil(spark, (12,))
    w, v, _ = basis.subspace_frames(a.coalesce(2), 12, 1, steps=3, extra=8)
    assert np.allclose(w, 2 + 2 * np.cos(np.pi / 13), atol=1e-3) and v.count() == 12


def test_empty_and_sparse(spark):
    empty = spark.createDataFrame([], "i long, j long, v double")
    m = Matrix(empty, 3, 3)
    assert np.allclose(m.apply(np.ones(3)), 0) and m.norm() == 0 and np.allclose(m.dense(), 0)
    repeated = spark.createDataFrame([(0, 0, 1.0), (0, 0, 2.0)], "i long, j long, v double")
    assert Matrix(repeated, 1, 1).dense()[0, 0] == 3 and Matrix(repeated, 1, 1).norm() == 3


def test_order_matches_columns(spark):
    z = np.round(rng.standard_normal(25) * 3, 3) + 1j * np.round(rng.standard_normal(25) * 3, 3)
    frame = spark.createDataFrame([(k, float(v.real), float(v.imag)) for k, v in enumerate(z)], "id int, re double, im double")
    for which in order.CRITERIA:
        got = [r["id"] for r in order.ranked(frame, which, 1 + 1j, region=Ellipse(radius=2.0)).orderBy("k").collect()]
        assert got == order.order(z, which, 1 + 1j, region=Ellipse(radius=2.0)).tolist(), which


@pytest.mark.parametrize(
    "region", [Interval(a=-1, b=2, c=-1, d=1), Ellipse(centre=1, radius=2, vscale=0.5), Ellipse(complement=True, scale=2.0), Ring(radius=2.5, start=0.1, end=0.6, width=0.7), Polygon(vertices=[-2 - 1j, 2 - 1j, 2 + 1j, 0.5 + 2.5j]), Region()]
)
def test_region_matches_columns(spark, region):
    z = rng.standard_normal(60) * 2 + 1j * rng.standard_normal(60) * 2
    frame = spark.createDataFrame([(k, float(v.real), float(v.imag)) for k, v in enumerate(z)], "id int, re double, im double")
    got = [r["s"] for r in frame.select("id", region.column("re", "im").alias("s")).orderBy("id").collect()]
    assert got == region.inside(z).tolist()


def test_contours_and_quadrature():
    for region in (Ellipse(centre=1, radius=2, vscale=0.5), Ring(radius=2, width=0.5, start=0, end=1), Polygon(vertices=[0, 1, 1 + 1j]), Interval(a=0, b=1, c=0, d=1)):
        c = region.contour(12)
        a, b, lo, hi = region.box()
        assert len(c) == 12 and (c.real >= a - 1e-9).all() and (c.real <= b + 1e-9).all()
    z, _, w = Ellipse(centre=0.3, radius=1.0).quadrature(64)
    assert np.isclose((w / (z - 0.5)).sum(), 1) and np.isclose((w / (z - 5)).sum(), 0)
    assert Ellipse(centre=0).can_use_conjugates(True) and not Ellipse(centre=1j).can_use_conjugates(True)


FUNCTIONS = [scalar.Exp(alpha=0.5), scalar.Log(), scalar.Sqrt(beta=2.0), scalar.InvSqrt(), scalar.Phi(k=3), scalar.Rational(p=[1.0, 2], q=[1.0, 3.0]), scalar.Combined(how="compose", first=scalar.Sqrt(), second=scalar.Exp()), scalar.Combined(how="divide", first=scalar.Exp(), second=scalar.Sqrt())]


@pytest.mark.parametrize("f", FUNCTIONS, ids=lambda f: type(f).__name__)
def test_functions(spark, f):
    for x in (0.3, 1.0, 4.2):
        h = 1e-6
        assert np.isclose(f.derivative(x), (f(x + h) - f(x - h)) / (2 * h), rtol=1e-5)
        row = spark.range(1).select(f.column(F.lit(x)).alias("y"), f.derivative_column(F.lit(x)).alias("d")).first()
        assert np.isclose(row["y"], f(x)) and np.isclose(row["d"], f.derivative(x))
    a = np.array([[2.0, 0.3, 0.1], [0.2, 1.5, 0.4], [0.0, 0.1, 3.0]])
    w, v = np.linalg.eig(a)
    assert np.allclose(f.matrix(a), (v * [f(float(t)) for t in w]) @ np.linalg.inv(v), atol=1e-8)
    assert np.allclose(f.first_column(a), f.matrix(a)[:, 0])


def test_function_guards(spark):
    with pytest.raises(ValueError):
        scalar.Log()(-1.0)
    assert scalar.Log()(0.0) == -math.inf
    with pytest.raises(ZeroDivisionError):
        scalar.InvSqrt()(0.0)
    with pytest.raises(Exception, match="negative"):
        spark.range(1).select(scalar.Sqrt().column(F.lit(-1.0))).collect()
    scalar.register("twice", lambda: scalar.Rational(p=[2.0, 0.0]))
    assert scalar.function("twice")(3.0) == 6.0


def test_sources(spark, tmp_path):
    walk = Matrix(src.random_walk(spark, 15), 120, 120).dense()
    assert np.allclose(eigs(walk.T, nev=2, which="largest_real").values[:2].real, [1, 0.97137], atol=1e-5)
    (tmp_path / "g.txt").write_text("% a comment\n1 2\n2 3\n2 3\n3 1 2.5\n\n")
    edges, n = src.read_graph(spark, str(tmp_path / "g.txt"))
    assert n == 3 and sorted(map(tuple, edges.collect())) == [(0, 1, 1.0), (1, 2, 1.0), (2, 0, 2.5)]
    lap = Matrix(src.graph_laplacian(edges.unionByName(edges.selectExpr("j as i", "i as j", "v"))), 3, 3).dense()
    assert np.allclose(lap.sum(1), 0)
    src.write_frame(edges, str(tmp_path / "out"))
    assert src.read_coordinates(spark, str(tmp_path / "out")).count() == 3


def test_options_and_views():
    p = options.parameters("-eps_nev 2 -eps_smallest_real -eps_tol 1e-9 -eps_type lobpcg -st_type sinvert -st_shift -0.5 -svd_nsv 3")
    assert p["nev"] == 2 and p["which"] == "smallest_real" and p["transform"].sigma == -0.5
    r = eigs(np.diag([1.0, 2, 3]), nev=2, which="smallest_real", solver="lapack")
    assert options.view(r) == "1.00000, 2.00000" and "2 converged" in options.view(r, "reason") and len(options.view(r, "errors").splitlines()) == 2
    with pytest.raises(ValueError):
        options.parameters("-eps_nothing 1")
    assert isinstance(options.parameters("-nep_type ciss -rg_type ring -rg_ring_radius 2", "nep")["region"], Ring)


def test_results_as_frames(spark):
    r = eigs(np.diag([1.0, 2, 3]), nev=2, solver="lapack", which="largest_real")
    assert [x["re"] for x in r.eigenvalues(spark).orderBy("k").collect()] == [3, 2]
    assert r.eigenvectors(spark).count() == 6 and r.summary(spark).first()["nconv"] == 2


def test_running_gram(spark, tmp_path):
    x = rng.standard_normal((40, 4))
    path = str(tmp_path / "rows")
    block(spark, x, 4).write.parquet(path)
    running = RunningGram()
    stream = spark.readStream.schema("i long, x array<double>").option("maxFilesPerTrigger", 1).parquet(path)
    q = stream.writeStream.foreachBatch(running.write).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert running.rows == 40 and np.allclose(running.singular_values(), np.linalg.svd(x)[1])


NUMBERS = itertools.count()


def jobs(spark, run):
    """What ``run`` gives, and how many Spark jobs it took."""
    tag = f"counted-{next(NUMBERS)}"
    sc = spark.sparkContext
    sc.setJobGroup(tag, tag)
    out = run()
    found = len(sc.statusTracker().getJobIdsForGroup(tag))
    sc.setJobGroup("", "")
    return out, found


def test_a_product_is_one_job(spark):
    g = np.random.default_rng(0)
    n = 300
    i, j = g.integers(0, n, 5000), g.integers(0, n, 5000)
    v, vi = g.standard_normal(5000), g.standard_normal(5000)
    dense = np.zeros((n, n), complex)
    np.add.at(dense, (i, j), v + 1j * vi)
    real = spark.createDataFrame([*zip(i.tolist(), j.tolist(), v.tolist())], "i long, j long, v double")
    cplx = spark.createDataFrame([*zip(i.tolist(), j.tolist(), v.tolist(), vi.tolist())], "i long, j long, v double, vi double")
    x = g.standard_normal((n, 3))
    for frame, a in ((real, dense.real), (cplx, dense)):
        m = Matrix(frame, n, n, partitions=5)
        assert np.allclose(m.apply(x), a @ x) and np.allclose(m.adjoint(x), a.conj().T @ x)
        for product, want in ((m.apply, a @ x), (m.adjoint, a.conj().T @ x)):
            got, count = jobs(spark, lambda product=product: product(x))
            assert np.allclose(got, want) and count == 1
        z = x + 1j * x[::-1]
        assert np.allclose(m.apply(z), a @ z) and np.allclose(m.adjoint(z), a.conj().T @ z)
        m.unpersist()
    assert np.allclose(list(Matrix(real, n, n).norms("one", "inf", "frobenius").values()), [np.abs(dense.real).sum(0).max(), np.abs(dense.real).sum(1).max(), np.linalg.norm(dense.real)])


def test_gathered_entries_multiply_alike(spark):
    m = Matrix(src.stencil(spark, (50, 45)), 2250, 2250)
    a, b = m.operator(), Matrix(m.df, 2250, 2250, gathered=0).operator()
    x = np.random.default_rng(1).standard_normal((2250, 2))
    assert np.allclose(a.apply(x), b.apply(x)) and np.allclose(a.adjoint(x[:, 0]), b.adjoint(x[:, 0])) and np.allclose(a.diagonal, b.diagonal) and a.norm == b.norm == 8.0
    assert a.symmetric() and b.symmetric()


def test_partial_results_are_merged_in_a_tree(spark, monkeypatch):
    frame = spark.createDataFrame([(k, [float(k), 1.0, float(k * k % 7)]) for k in range(200)], "i long, x array<double>").repartition(30)
    x = np.array([[k, 1.0, k * k % 7] for k in range(200)], float)
    monkeypatch.setattr(basis, "TASKS_AT_ONCE", 8)
    assert np.allclose(basis.gram(frame), x.T @ x)
    r = basis.reduced(frame.select("x"), lambda b: np.linalg.qr(basis.rows_of(b), mode="r"), "qr")
    assert np.allclose(r.T @ r, x.T @ x)
    found = basis.norms(frame)
    assert np.allclose([found[k] for k in ("frobenius", "max", "one", "inf")], [np.linalg.norm(x), x.max(), x.sum(0).max(), x.sum(1).max()])
    phase = basis.Phase(frame.select("x"))
    assert (phase.dot([0], [1, 2]), phase.norm([2])) == (0, 1)
    dot, squares = phase.end()
    assert np.allclose(dot, x[:, [0]].T @ x[:, [1, 2]]) and np.allclose(squares, (x[:, 2] ** 2).sum())


@pytest.mark.parametrize("fmt", ["csv", "json", "parquet", "orc"])
def test_coordinates_are_read_by_name(spark, tmp_path, fmt):
    rows = spark.createDataFrame([(0, 5, 6, 1.5, -2.0), (1, 0, 1, 3.0, 0.5)], "term int, i long, j long, v double, vi double")
    src.write_frame(rows.select("vi", "term", "j", "v", "i"), f"{tmp_path}/a", fmt)
    assert sorted(map(tuple, src.read_coordinates(spark, f"{tmp_path}/a", fmt).select("term", "i", "j", "v", "vi").collect())) == [(0, 5, 6, 1.5, -2.0), (1, 0, 1, 3.0, 0.5)]
    first, second = src.read_terms(spark, f"{tmp_path}/a", fmt)
    assert first.columns == ["i", "j", "v", "vi"] and first.first()["j"] == 6 and second.count() == 1
    src.write_frame(rows.withColumnRenamed("vi", "w"), f"{tmp_path}/b", fmt)
    with pytest.raises(ValueError):
        src.read_coordinates(spark, f"{tmp_path}/b", fmt)
