"""Vectors beside their matrix, and inertia by nested dissection, against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from eigenfold import matrix
from eigenfold.operators import basis, inertia
from eigenfold.operators import parts as P
from eigenfold.sources import matrices as src


def dense(df, n):
    a = np.zeros((n, n))
    for r in df.collect():
        a[r["i"], r["j"]] += r["v"]
    return a


def vectors(spark, b, ids=None):
    return spark.createDataFrame([(int(i), [float(c) for c in r]) for i, r in zip(range(len(b)) if ids is None else ids, b)], "i long, x array<double>")


def gathered(frame, n, k):
    x = np.zeros((n, k))
    for r in frame.collect():
        x[r["i"]] = r["x"]
    return x


@pytest.fixture(scope="module")
def hub(spark):
    """A grid with a vertex that touches every other, whose row is summed where the vector's entries are."""
    n = 120
    grid = src.stencil(spark, (12, 10))
    spokes = spark.range(1, n).select(F.lit(0).cast("long").alias("i"), F.col("id").alias("j"), (0.1 * (F.col("id") % 7)).alias("v"))
    df = grid.unionByName(spokes).unionByName(matrix.transposed(spokes)).unionByName(spark.createDataFrame([(5, 6, 0.25), (6, 5, 0.25)], "i long, j long, v double"))
    return df, dense(df, n), n


@pytest.mark.parametrize("count,heavy", [(1, 10**6), (5, 10**6), (5, 40), (7, 3)])
def test_products(spark, hub, count, heavy):
    df, a, n = hub
    parts = P.Parts(df, n, parts=count, heavy=heavy)
    b = np.random.default_rng(0).standard_normal((n, 3))
    state, total = parts.step(parts.vectors(vectors(spark, b), 3), lambda part, s: s, lambda s: s["b"], lambda part, s, y: {"y": y}, lambda part, s: s["y"].sum(0))
    assert np.allclose(gathered(parts.frame(state, lambda s: s["y"]), n, 3), a @ b, atol=1e-12) and np.allclose(total, (a @ b).sum(0))
    parts.unpersist()


def test_a_step_is_one_job(spark, hub):
    df, a, n = hub
    parts = P.Parts(df, n, parts=4)
    state = parts.start(lambda part: {"b": np.ones((part.rows, 2))})
    spark.sparkContext.setJobGroup("a step", "")
    parts.step(state, lambda part, s: s, lambda s: s["b"], lambda part, s, y: {"b": y}, lambda part, s: s["b"].sum(0))
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("a step")) == 1
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_absent_and_repeated_rows(spark):
    """Rows without entries are zero; absent rows of a vector are zero and repeated ones add up."""
    parts = P.Parts(spark.createDataFrame([(1, 3, 2.0), (3, 1, 2.0), (1, 3, 1.0)], "i long, j long, v double"), 6, parts=3)
    b = parts.vectors(vectors(spark, [[1.0], [4.0], [5.0]], [3, 1, 1]), 1)
    state, _ = parts.step(b, lambda part, s: s, lambda s: s["b"], lambda part, s, y: {"y": y}, lambda part, s: s["y"].sum(0))
    assert gathered(parts.frame(state, lambda s: s["y"]), 6, 1).ravel().tolist() == [0, 3, 0, 18, 0, 0]


def test_what_parts_refuse(spark):
    with pytest.raises(ValueError, match="complex"):
        P.Parts(spark.createDataFrame([(0, 0, 1.0, 1.0)], "i long, j long, v double, vi double"), 1)
    with pytest.raises(Exception, match="outside"):
        P.Parts(spark.createDataFrame([(0, 7, 1.0)], "i long, j long, v double"), 3)


def test_eigenpairs_without_a_vector_on_the_driver(spark, hub, monkeypatch):
    """The bound on the driver's vectors is lowered to less than one vector; the gathered product refuses, the parts do not mind."""
    df, a, n = hub
    monkeypatch.setattr(matrix, "VECTOR_BYTES", 512)
    with pytest.raises(MemoryError):
        matrix.Matrix(df, n, n).apply(np.ones(n))
    w, u = np.linalg.eigh(a)
    parts = P.Parts(df, n, parts=3, heavy=40)
    for which, want in (("largest_real", w[::-1][:3]), ("smallest_real", w[:3])):
        found = P.eigenpairs(parts, nev=3, which=which, tol=1e-7, ncv=24).checked()
        assert np.allclose(found.values, want, atol=1e-8)
        x = gathered(found.vectors, n, 3)
        assert np.allclose(x.T @ x, np.eye(3), atol=1e-8) and np.allclose(np.linalg.norm(a @ x - x * found.values, axis=0), found.residuals, atol=1e-9)
    magnitude = P.eigenpairs(parts, nev=1, which="largest_magnitude", tol=1e-7).checked().values
    assert np.isclose(magnitude[0], w[np.abs(w).argmax()])


def test_copies_and_closed_spaces(spark):
    """Six stars of four leaves: values 0, 1 and 5, with six copies of 5; the space closes long before it is full."""
    edges = spark.range(24).select((F.col("id") % 6).alias("i"), (F.col("id") + 6).alias("j"), F.lit(1.0).alias("v"))
    parts = P.Parts(src.graph_laplacian(edges.unionByName(matrix.transposed(edges))), 30, parts=3)
    assert np.allclose(P.eigenpairs(parts, nev=7, block=7).checked().values, [5.0] * 6 + [1.0])
    assert np.allclose(P.eigenpairs(parts, nev=30, block=4, most=60).checked().values, [5.0] * 6 + [1.0] * 18 + [0.0] * 6, atol=1e-7)


def test_unconverged_pairs_say_so(spark, hub):
    df, a, n = hub
    found = P.eigenpairs(P.Parts(df, n, parts=2), nev=3, which="smallest_real", most=3)
    assert not found.converged and found.residuals.max() > 1e-6
    with pytest.raises(P.NotConverged):
        found.checked()


def test_solutions(spark, hub):
    df, a, n = hub
    parts = P.Parts(df, n, parts=4, heavy=40)
    b = np.random.default_rng(1).standard_normal((n, 2))
    b[:, 1] = 0
    solved = P.solve(parts, vectors(spark, b), 2, shift=10.0, cell=8).checked()
    assert np.allclose(gathered(solved.x, n, 2), np.linalg.solve(a + 10 * np.eye(n), b), atol=1e-9)
    with pytest.raises(P.NotConverged, match="definite"):
        P.solve(parts, vectors(spark, b), 2, shift=-4.0)
    short = P.solve(parts, vectors(spark, b), 2, shift=6.0, most=2, cell=1)
    assert not short.converged
    with pytest.raises(P.NotConverged):
        short.checked()
    shifts = [10.0, -20.0, 3.0]
    many = P.shifted_solutions(parts, vectors(spark, b[:, :1]), 1, shifts).checked()
    x = gathered(many.x, n, 3)
    assert all(np.allclose(x[:, k], np.linalg.solve(a + s * np.eye(n), b[:, 0]), atol=1e-6) for k, s in enumerate(shifts))


def test_functions_and_density(spark, hub):
    df, a, n = hub
    w, u = np.linalg.eigh(a)
    span = (w[0] - 0.1, w[-1] + 0.1)
    parts = P.Parts(df, n, parts=3)
    b = np.random.default_rng(2).standard_normal((n, 2))
    y, degree = P.function_times(parts, lambda z: np.exp(-0.2 * z), vectors(spark, b), 2, span)
    assert degree < 30 and np.allclose(gathered(y, n, 2), u @ (np.exp(-0.2 * w)[:, None] * (u.T @ b)), atol=1e-10)
    with pytest.raises(P.NotConverged):
        P.series(lambda z: np.abs(z), (-1.0, 1.0), 1e-12)
    found = P.density(parts, degree=6, span=span, probes=40)
    assert all(abs(found.power(p)[0] - (w**p).mean()) <= 4 * found.power(p)[1] + 1e-9 for p in range(6))
    angle = (np.arange(4000) + 0.5) * np.pi / 4000
    points = (span[0] + span[1]) / 2 + (span[1] - span[0]) / 2 * np.cos(angle)
    assert np.isclose((found.at(points) * np.sin(angle)).sum() * np.pi / 4000 * (span[1] - span[0]) / 2, 1.0, atol=1e-6) and found.at(np.array([99.0]))[0] == 0


def test_lyapunov_factor(spark, hub):
    df, a, n = hub
    parts = P.Parts(df, n, parts=3, heavy=40)
    b = np.random.default_rng(3).standard_normal((n, 2))
    w, u = np.linalg.eigh(a + 12 * np.eye(n))
    c = u.T @ b
    x = u @ ((c @ c.T) / (w[:, None] + w[None, :])) @ u.T
    found = P.lyapunov(parts, vectors(spark, b), 2, shift=12.0, tol=1e-8).checked()
    z = gathered(found.z, n, found.rank)
    assert np.allclose(z @ z.T, x, atol=1e-5 * np.abs(x).max()) and np.isclose(found.trace, np.trace(x), rtol=1e-6) and found.rank < 30
    assert not P.lyapunov(parts, vectors(spark, b), 2, shift=6.0, most=2).converged
    with pytest.raises(P.NotConverged, match="definite"):
        P.lyapunov(parts, vectors(spark, b), 2, shift=-4.0)


def test_lyapunov_residual_below_the_rounding_of_the_squared_norm(spark):
    """Hubs of weight 4e6 and more, whose squares' rounding is more than the tolerance."""
    hubs, leaves = 25, 10
    n = hubs * (leaves + 1)
    a = np.diag(np.append(4e3 * (1000 + 37 * (np.arange(hubs) * 7 % hubs)), np.full(n - hubs, 30.0)))
    hub, leaf = np.arange(n - hubs) // leaves, np.arange(hubs, n)
    a[hub, leaf] = a[leaf, hub] = -5 * np.sqrt(4e3)
    df = spark.createDataFrame([(int(i), int(j), float(a[i, j])) for i, j in zip(*np.nonzero(a))], "i long, j long, v double")
    b = 1.0 + np.arange(n)[:, None] % 7
    found = P.lyapunov(P.Parts(df, n, parts=1), vectors(spark, b), 1, shift=1.0, tol=1e-6).checked()
    assert found.residual <= 1e-6 and np.isclose(found.trace, (b.T @ np.linalg.solve(a + np.eye(n), b)).item() / 2, rtol=1e-7)


def test_contour(spark, hub):
    df, a, n = hub
    w = np.linalg.eigvalsh(a)
    found = P.contour_eigenpairs(P.Parts(df, n, parts=3), 7.5, 0.7).checked()
    assert np.allclose(np.sort(found.values), w[np.abs(w - 7.5) <= 0.7], atol=1e-6)


# --- inertia ----------------------------------------------------------------------------------------------


def test_counts_by_ranges_and_levels(spark, hub):
    n = 143
    df = src.stencil(spark, (11, 13)).unionByName(spark.range(n).select(F.col("id").alias("i"), F.col("id").alias("j"), (0.01 * F.col("id")).alias("v")))
    w = np.linalg.eigvalsh(dense(df, n))
    shifts = [-1.0, 0.513, 2.227, 4.0123, 9.9]
    want = [int((w < s).sum()) for s in shifts]
    first = inertia.ranges(df, n, 5)
    rest = spark.range(n).select(F.col("id").alias("i")).join(first, "i", "left_anti")
    second = rest.select("i", F.lit(0).cast("long").alias("block")).where("i < 60")
    for levels in ([], [first], [first, second]):
        got = {r["s"]: r["below"] for r in inertia.counts_below(df, shifts, levels).collect()}
        assert [got[k] for k in range(len(shifts))] == want


def test_counts_of_entries_that_add_up(spark):
    """Levels as functions of the row number, a Laplacian that is not summed, edges given in pieces, and entries between blocks that cancel."""
    rng = np.random.default_rng(5)
    tree = [(3 * k, 3 * (k // 4) + 1, float(rng.integers(1, 9))) for k in range(60) for _ in range(2)] + [(3 * (k // 4) + 1, 2, 0.75) for k in range(0, 60, 4)]
    half = spark.createDataFrame(tree, "i long, j long, v double")
    n = 3 * 59 + 1
    a = np.zeros((n, n))
    for i, j, v in tree:
        for x, y, w in ((i, j, -v), (j, i, -v), (i, i, v), (j, j, v)):
            a[x, y] += w
    rows = sorted({x for t in tree for x in t[:2]})
    w = np.linalg.eigvalsh(a[np.ix_(rows, rows)])
    shifts = [0.31, 2.203, 7.77, 19.1]
    stray = spark.createDataFrame([(i, j, v) for v in (1.0, -1.0) for i, j in ((0, 12), (12, 0))], "i long, j long, v double")
    levels = [lambda i: F.when(i % 3 == 0, F.floor(i / 12)).when(i % 3 == 1, F.floor(i / 3))]
    for about in (None, 600_000):
        got = {r["shift"]: r["below"] for r in inertia.counts_below(src.laplacian_entries(half).unionByName(stray), shifts, levels, about).collect()}
        assert got == {s: int((w < s).sum()) for s in shifts}


def test_counts_beyond_the_dense_form(spark):
    """A line of 5000 points in two levels, against its closed form."""
    n = 5000
    df = src.stencil(spark, (n,))
    w = 2 - 2 * np.cos(np.pi * np.arange(1, n + 1) / (n + 1))
    shifts = [0.1, 0.10001, 1.9, 3.3]
    got = {r["shift"]: r["below"] for r in inertia.counts_below(df, shifts, [inertia.ranges(df, n, 40)]).collect()}
    assert got == {s: int((w < s).sum()) for s in shifts}


def test_what_counts_refuse(spark):
    df = src.stencil(spark, (6,))
    with pytest.raises(Exception, match="between two blocks"):
        inertia.counts_below(df, [0.5], [spark.createDataFrame([(i, i % 2) for i in range(6)], "i long, block long")]).collect()
    with pytest.raises(Exception, match="move it a little"):
        inertia.counts_below(df, [2.0], [spark.createDataFrame([(0, 0)], "i long, block long")]).collect()


# --- array columns -------------------------------------------------------------------------------------------


@pytest.mark.parametrize("rows,match", [([[1.0, 2.0, 3.0, 4.0], None], "null vectors"), ([[1.0, 2.0, 3.0], [4.0]], "1 to 3"), ([[1.0, None]], "null components")])
def test_misfit_vectors_are_refused(spark, rows, match):
    df = spark.createDataFrame([(k, r) for k, r in enumerate(rows)], "i long, x array<double>").coalesce(1)
    for use in (basis.gram, basis.norms, lambda f: basis.orthogonalised(f), lambda f: basis.multiply(f, np.eye(4)).collect()):
        with pytest.raises(Exception, match=match):
            use(df)


def test_sides_hold_each_entry_once(spark):
    """The products of K = [0 A'; A 0], D - K / 2 and D^-1/2 K D^-1/2 are those of the whole matrix, rows without entries and repeated places included."""
    rng = np.random.default_rng(11)
    rows, cols, n = 90, 14, 104
    entries = [(int(i), int(j), float(v)) for i, j, v in zip(rng.integers(0, rows - 3, 400), rng.integers(0, cols - 1, 400), rng.integers(1, 9, 400))]
    df = spark.createDataFrame(entries, "i long, j long, v double")
    k = np.zeros((n, n))
    for i, j, v in entries:
        k[cols + i, j] += v
        k[j, cols + i] += v
    d = k.sum(0)
    root = np.where(d > 0, 1 / np.sqrt(np.where(d > 0, d, 1)), 0)
    b = rng.standard_normal((n, 2))
    for dress, want in ((lambda p: p, k), (lambda p: p.weighted(0.5), np.diag(d) - k / 2), (lambda p: p.normalised(), root[:, None] * k * root)):
        parts = dress(P.Sides(df, rows, cols, parts=5))
        assert parts.parts.map(lambda p: len(p.vals) + len(p.far_vals)).sum() == len(entries)
        state, _ = parts.step(parts.vectors(vectors(spark, b), 2), lambda part, s: s, lambda s: s["b"], lambda part, s, y: {"y": y}, lambda part, s: np.zeros(1))
        assert np.allclose(gathered(parts.frame(state, lambda s: s["y"]), n, 2), want @ b, atol=1e-12)
        parts.unpersist()
    with pytest.raises(Exception, match="entries outside"):
        P.Sides(df, rows - 10, cols)


def test_state_is_checkpointed_before_messages_outgrow_the_disk(spark, hub, monkeypatch):
    df, a, n = hub
    monkeypatch.setattr(P, "BYTES_KEPT", 1)
    parts = P.Parts(df, n, parts=3)
    state = parts.start(lambda part: {"b": np.ones((part.rows, 1))})
    for _ in range(3):
        state, _ = parts.step(state, lambda part, s: s, lambda s: s["b"], lambda part, s, y: {"b": y}, lambda part, s: np.zeros(1))
        kept = state.isCheckpointed()
    assert kept and np.allclose(gathered(parts.frame(state, lambda s: s["b"]), n, 1), np.linalg.matrix_power(a, 3) @ np.ones((n, 1)))


def test_fourth_moment_in_turns(spark, monkeypatch):
    """Runs of columns take turns where their rows would outgrow the disk."""
    a = np.random.default_rng(12).integers(0, 3, (60, 25)).astype(float)
    df = spark.createDataFrame([(int(i), int(j), float(a[i, j])) for i, j in zip(*np.nonzero(a))], "i long, j long, v double")
    monkeypatch.setattr(P, "ROUND_BYTES", 20_000)
    monkeypatch.setattr(P, "PAIRS", 2_000)
    sent = []
    monkeypatch.setattr(P, "let_go", lambda spark: sent.append(1))
    assert np.isclose(P.gram_squares(df, 25), ((a.T @ a) ** 2).sum()) and len(sent) > 2
