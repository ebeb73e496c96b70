import numpy as np
import pytest

from eigenfold import dense
from eigenfold.functions import scalar
from eigenfold.functions.region import Ellipse, Interval
from eigenfold.functions.scalar import Exp, InvSqrt, Log, Phi, Rational, Sqrt
from eigenfold.operators import processes
from eigenfold.operators.action import Action, funm_multiply, register, register_equation, solve_equation
from eigenfold.operators.eigen import eigs, infer, two_sided_lanczos
from eigenfold.operators.nonlinear import Nonlinear, nleigs, resolvent
from eigenfold.operators.polynomial import definite_quadratic, diagonal_scaling, polyeigs
from eigenfold.operators.singular import SOLVERS as SVD_SOLVERS
from eigenfold.operators.singular import gsvds, hsvds, svds
from eigenfold.operators.transform import Transform, conjugate_gradient, gmres, spectral_range
from eigenfold.matrix import Operator, of_array


def line(n):
    return 2 * np.eye(n) - np.eye(n, k=1) - np.eye(n, k=-1)


GRID = np.kron(line(10), np.eye(10)) + np.kron(np.eye(10), line(10))
EXACT = np.sort(np.linalg.eigvalsh(GRID))
#: Known values of these model problems, to five digits.
LINE_LARGEST = [3.98974, 3.95906, 3.90828, 3.83792]
GRID_HALVED = [0.04051, 0.09963, 0.09963, 0.15875]
WALK = [1.00000, 0.97137, 0.90423, 0.85714]
SPRING = [-0.50512, -0.50517, -0.50525, -0.50537]


def walk(m):
    at = {(x, y): k for k, (x, y) in enumerate((x, y) for x in range(m) for y in range(m - x))}
    a = np.zeros((len(at),) * 2)
    for (x, y), k in at.items():
        if x + y < m - 1:
            p = 0.5 / (m - 1) * (x + y + 1)
            a[k, at[x, y + 1]] += 2 * p if x == 0 else p
            a[k, at[x + 1, y]] += 2 * p if y == 0 else p
        q = 0.5 - 0.5 / (m - 1) * (x + y - 1)
        if y:
            a[k, at[x, y - 1]] += q
        if x:
            a[k, at[x - 1, y]] += q
    return a


@pytest.mark.parametrize("solver", ["krylovschur", "arnoldi", "lanczos", "subspace", "lapack", "gd", "jd", "lobpcg", "rqcg"])
def test_all_solvers_agree(solver):
    r = eigs(line(30), nev=4, which="largest_real" if solver in ("gd", "jd", "lobpcg", "rqcg") else "largest_magnitude", solver=solver)
    assert np.allclose(r.values, LINE_LARGEST, atol=1e-5) and r.errors.max() < 1e-6


@pytest.mark.parametrize("solver", ["krylovschur", "lapack", "gd", "jd", "lobpcg"])
def test_generalised_with_copies(solver):
    r = eigs(GRID, 4 * np.eye(100), nev=4, which="smallest_magnitude", solver=solver)
    assert np.allclose(r.values[:4], GRID_HALVED, atol=1e-5)


@pytest.mark.parametrize("solver", ["krylovschur", "arnoldi", "lapack", "gd", "jd"])
def test_random_walk(solver):
    assert np.allclose(eigs(walk(15).T, nev=4, which="largest_real", solver=solver).values[:4].real, WALK, atol=1e-5)


def test_transformations():
    for t in (Transform("sinvert", 0.3), Transform("cayley", 0.3, nu=0.5)):
        r = eigs(GRID, nev=4, target=0.3, transform=t)
        assert np.allclose(np.sort(r.values[:4]), np.sort(EXACT[np.argsort(np.abs(EXACT - 0.3))[:4]]), atol=1e-7)
        theta = t.forward(np.array([0.7, 2.0]))
        assert np.allclose(t.eigenvalues(theta), [0.7, 2.0])
    lo, hi = spectral_range(of_array(GRID))
    assert lo <= EXACT[0] + 1e-2 and hi >= EXACT[-1] - 1e-2


@pytest.mark.parametrize("options", [{}, {"transform": "filter", "degree": 80}, {"solver": "evsl"}])
def test_interval(options):
    want = EXACT[(EXACT >= 0.4) & (EXACT <= 1.3)]
    assert np.allclose(np.sort(eigs(GRID, interval=(0.4, 1.3), which="all", **options).values), want, atol=1e-6)


@pytest.mark.parametrize("extraction", ["ritz", "hankel"])
def test_contour(extraction):
    r = eigs(GRID, solver="ciss", region=Ellipse(centre=0.5, radius=0.2), which="all", extraction=extraction)
    assert np.allclose(np.sort(r.values), EXACT[np.abs(EXACT - 0.5) <= 0.2], atol=1e-8)


def test_bse_deflation_two_sided_balance_complex():
    n = 24
    band = lambda b: sum(v * np.eye(n, k=k) for k, v in b.items())
    r, c = band({-2: -0.1, -1: 1, 0: 4.5, 1: 1, 2: -0.1}), band({-1: 1, 0: 2, 1: 1})
    w = eigs(np.block([[r, c], [-c, -r]]), nev=4, which="smallest_magnitude", problem="bse").values
    assert np.allclose(np.sort(w), np.sort([2.32173, -2.32173, 2.38567, -2.38567]), atol=1e-5)
    assert np.allclose(eigs(np.diag([1.0, 2, 3, 4]), nev=1, which="smallest_magnitude", deflation=np.eye(4)[:, :1]).values, [2])
    m = walk(15).T
    two = eigs(m, nev=3, which="largest_real", two_sided=True)
    assert np.allclose(two.left.conj().T @ m, two.values[:, None] * two.left.conj().T, atol=1e-6)
    assert np.allclose(eigs(m, nev=2, which="largest_real", balance=True).values[:2].real, WALK[:2], atol=1e-5)
    a = np.random.default_rng(0).standard_normal((40, 40))
    got, exact = eigs(a, nev=4).values, np.linalg.eigvals(a)
    assert np.allclose(np.sort(np.abs(got))[::-1][:4], np.sort(np.abs(exact))[::-1][:4], atol=1e-6)
    z = a + 1j * a.T
    assert np.allclose(np.abs(eigs(z, nev=2).values[0]), np.abs(np.linalg.eigvals(z)).max(), atol=1e-6)
    v, w, h = two_sided_lanczos(of_array(a), 10)
    assert np.abs(w.conj().T @ v - np.diag(np.diag(w.conj().T @ v))).max() < 1e-6


def test_callbacks():
    seen = []
    r = eigs(GRID, nev=2, which="smallest_real", monitor=lambda it, v, e: seen.append(it), stopping=lambda it, most, nconv, nev: "user" if it >= 2 else None, copies=False)
    assert r.reason == "user" and seen and r.history
    r = eigs(line(30), nev=2, which=lambda v: abs(v - 2.0), solver="lapack")
    assert np.abs(r.values - 2).max() < 0.2
    r = eigs(line(30), nev=3, solver="lapack", selection=lambda v, x: -abs(x[0]))
    assert len(r.values) == 3
    with pytest.raises(ValueError):
        eigs(line(5), solver="nothing")
    assert eigs(line(30), nev=1, solver="power", shift="wilkinson").errors.max() < 1e-6


@pytest.mark.parametrize("solver", sorted(SVD_SOLVERS))
def test_svd(solver):
    n = 30
    g = np.eye(n) + sum(np.eye(n, k=k) for k in (1, 2, 3)) - np.eye(n, k=-1)
    assert np.allclose(svds(g, nsv=2, solver=solver).values, np.linalg.svd(g)[1][:2], atol=1e-6)
    if solver != "randomized":
        assert np.allclose(svds(g, nsv=1, solver=solver, which="smallest").values, 0.9551, atol=1e-4)
    tall = np.random.default_rng(0).standard_normal((50, 8))
    for a in (tall, tall.T):
        r = svds(a, nsv=3, solver=solver, tol=1e-9)
        assert np.allclose(r.values, np.linalg.svd(a)[1][:3]) and np.allclose(a @ r.v, r.u * r.values, atol=1e-6)


def test_gsvd_golden():
    a, b = np.zeros((20, 10)), np.zeros((6, 10))
    for i in range(20):
        for j, v in ((i - 1, -1.0), (i + 1, -1.0), (i, 2.0)):
            if 0 <= j < 10:
                a[i, j] = v
        if i > 10:
            a[i, 9] = 1.0
    for i in range(6):
        b[i, 4 : 5 + min(i, 9)] = 1.0
    w = gsvds(a, b, 10).values
    assert np.allclose(w[np.isfinite(w) & (w < 1e8)], [7.616935, 6.168214, 3.973540, 1.873725, 0.536721, 0.045258], atol=1e-6)


def test_hsvd():
    a, omega = np.random.default_rng(3).standard_normal((12, 5)), np.where(np.arange(12) < 8, 1.0, -1.0)
    r = hsvds(of_array(a), omega, 5)
    assert np.allclose(np.sort(np.abs(np.linalg.eigvals(a.T @ (omega[:, None] * a)))), np.sort(r.values**2))


def spring():
    t = 3 * np.eye(24) - np.eye(24, k=1) - np.eye(24, k=-1)
    return [5 * t, 10 * t, np.eye(24)]


@pytest.mark.parametrize("solver", ["toar", "qarnoldi", "stoar", "linear", "lapack", "jd"])
def test_polynomial(solver):
    r = polyeigs(spring(), nev=4, target=-0.5, solver=solver)
    assert np.allclose(r.values.real, SPRING, atol=1e-5) and r.errors.max() < 1e-8


@pytest.mark.parametrize("basis", dense.BASES)
def test_polynomial_bases(basis):
    a = polyeigs([*spring(), 0.1 * np.eye(24)], basis=basis, nev=3, target=0.3, solver="toar")
    b = polyeigs([*spring(), 0.1 * np.eye(24)], basis=basis, nev=3, target=0.3, solver="lapack")
    assert np.allclose(np.abs(a.values[:3]), np.abs(b.values[:3]), atol=1e-6)


def test_polynomial_options():
    for scale in ("scalar", "diagonal", "both"):
        assert np.allclose(polyeigs(spring(), nev=2, target=-0.5, scale=scale).values.real, SPRING[:2], atol=1e-5)
    for how in ("none", "norm", "residual", "structured"):
        assert polyeigs(spring(), nev=2, target=-0.5, extraction=how).errors.max() < 1e-8
    assert polyeigs(spring(), nev=2, target=-0.5, refine_steps=1).errors.max() < 1e-12
    assert definite_quadratic(spring())
    left, right = diagonal_scaling(spring())
    assert (np.log2(left) % 1 == 0).all() and (np.log2(right) % 1 == 0).all()
    r = polyeigs(spring(), solver="ciss", region=Ellipse(centre=-0.5052, radius=0.0001))
    assert len(r.values) and r.errors.max() < 1e-8


def delay(n=64):
    h = np.pi / (n + 1)
    x = (np.arange(n) + 1) * h
    return [(np.eye(n), Rational(p=[-1.0, 0.0])), (-line(n) / h**2 + 20 * np.eye(n), Rational(p=[1.0])), (np.diag(-4.1 + x * (1 - np.exp(x - np.pi))), Exp(alpha=-0.001))]


@pytest.mark.parametrize("solver", ["rii", "slp", "narnoldi"])
def test_nonlinear_local(solver):
    r = nleigs(delay(128), target=0.8, solver=solver)
    assert np.allclose(r.values.real, 0.80889, atol=1e-5)


@pytest.mark.parametrize("solver", ["nleigs", "interpol", "ciss"])
def test_nonlinear_region(solver):
    region = Ellipse(centre=5, radius=15, vscale=0.2) if solver == "ciss" else Interval(a=-10, b=20, c=-1, d=1)
    r = nleigs(delay(), nev=3, target=5.0, solver=solver, region=region)
    assert len(r.values) == 3 and r.errors.max() < 1e-8


def test_nonlinear_callbacks_and_resolvent():
    t = Nonlinear.split(delay(20))
    r = nleigs(Nonlinear(function=lambda k: t.at(k).dense(), jacobian=lambda k: t.slope(k).dense()), target=0.8, solver="slp")
    assert abs(r.values[0] - nleigs(delay(20), target=0.8, solver="slp").values[0]) < 1e-7
    a = np.diag([1.0, 2.0, 3.0])
    lin = Nonlinear.split([(np.eye(3), Rational(p=[1.0, 0.0])), (a, Rational(p=[-1.0]))])
    v = np.array([1.0, 2.0, 3.0])
    assert np.allclose(resolvent(lin, np.array([1.0, 2, 3]), np.eye(3), np.eye(3), 5.0, v), np.linalg.solve(5 * np.eye(3) - a, v))


def test_matrix_functions():
    a, e1 = walk(15), np.eye(120)[:, 0]
    for solver in ("krylov", "expokit"):
        r = funm_multiply(a, Exp(alpha=2.0), e1, solver=solver)
        assert np.isclose(np.linalg.norm(r.y), 2.47328, atol=1e-5)
    v = np.random.default_rng(1).standard_normal(100)
    root = funm_multiply(GRID, Sqrt(), v, ncv=12).y
    assert np.abs(funm_multiply(GRID, Sqrt(), root).y - GRID @ v).max() < 1e-6
    assert np.abs(funm_multiply(GRID, InvSqrt(), root).y - v).max() < 1e-6
    assert np.abs(funm_multiply(GRID, Phi(k=1), v).y - dense.phim(GRID, 1) @ v).max() < 1e-4
    assert np.abs(funm_multiply(GRID, Log(), v).y - dense.logm(GRID) @ v).max() < 1e-6
    with pytest.raises(ValueError):
        funm_multiply(GRID, Exp(), np.zeros(100))


def test_equations():
    r = solve_equation(-GRID - np.eye(100), np.ones((100, 1)))
    assert r.error < 1e-7 and r.factor.shape[1] == r.rank
    with pytest.raises(NotImplementedError):
        solve_equation(GRID, np.ones((100, 1)), "sylvester")


def test_linear_solvers():
    b = np.random.default_rng(0).standard_normal(100)
    for solve in (gmres, conjugate_gradient):
        assert np.abs(GRID @ solve(lambda x: GRID @ x, b) - b).max() < 1e-8


def random_operator(n, seed=0, hermitian=False):
    a = np.random.default_rng(seed).standard_normal((n, n))
    return (a + a.T) / 2 if hermitian else a


@pytest.mark.parametrize("how", processes.REORTHOGONALISATIONS)
def test_lanczos_reorthogonalisations(how):
    a = random_operator(60, 1, True)
    w = np.linalg.eigvalsh(a)
    r = eigs(a, nev=3, which="largest_real", solver="lanczos", reorthogonalise=how, tol=1e-10, max_it=2000)
    assert np.allclose(r.values, w[::-1][:3]) and np.allclose(a @ r.vectors, r.vectors * r.values, atol=1e-7)
    v, t, beta, _ = processes.lanczos_process(lambda x: a @ x, np.ones(60), 40, how)
    loss = np.abs(v.T @ v - np.eye(v.shape[1])).max()
    assert loss < (1e-12 if how in ("full", "delayed") else 1e-6 if how in ("periodic", "partial", "selective") else 2)
    if how != "delayed":  # whose vectors move after their products are taken
        assert np.abs(a @ v - v @ t)[:, :-1].max() < 1e-6 * np.abs(w).max()


@pytest.mark.parametrize("delayed", [False, True])
def test_arnoldi_with_explicit_restarts(delayed):
    a = random_operator(50, 2)
    w = np.linalg.eigvals(a)
    r = eigs(a, nev=2, which="largest_magnitude", solver="arnoldi", delayed=delayed, tol=1e-9, max_it=3000, ncv=25)
    assert abs(abs(r.values[0]) - np.abs(w).max()) < 1e-6 and r.errors.max() < 1e-6


def test_rayleigh_quotient_conjugate_gradients():
    a = random_operator(80, 3, True) + np.diag(np.arange(80.0))
    r = eigs(a, nev=3, which="smallest_real", solver="rqcg", tol=1e-8, max_it=500)
    assert np.allclose(r.values, np.linalg.eigvalsh(a)[:3])


def test_bethe_salpeter_by_products():
    r, c = random_operator(15, 5, True) + 12 * np.eye(15), random_operator(15, 6, True) / 4
    h = np.block([[r, c], [-c, -r]])
    x = eigs(h, nev=4, problem="bse", bse="gruning", which="smallest_magnitude", tol=1e-10)
    w = np.linalg.eigvals(h).real
    assert np.allclose(np.sort(np.abs(x.values)), np.sort(np.abs(w))[:4]) and np.abs(h @ x.vectors - x.vectors * x.values).max() < 1e-6


def test_filter_counts_and_settles():
    a = random_operator(150, 7, True)
    a[:4, 4:] = a[4:, :4] = 0
    a[:4, :4] = 1.25 * np.eye(4)  # a value of multiplicity four
    w = np.linalg.eigvalsh(a)
    inside = w[(w >= 0.5) & (w <= 2.5)]
    for options in ({"transform": "filter", "degree": 100}, {"solver": "slice"}):
        r = eigs(a, interval=(0.5, 2.5), which="all", **options)
        assert np.allclose(np.sort(r.values), inside)
    assert len(eigs(a, interval=(100.0, 101.0), which="all", transform="filter").values) == 0


def test_transformation_adjoints_and_scaling():
    a, b = random_operator(12, 8), np.eye(12) + 0.1 * random_operator(12, 9, True)
    g = np.random.default_rng(10)
    x, y = g.standard_normal(12), g.standard_normal(12)
    for t in (Transform("shift", 0.4), Transform("sinvert", 0.4), Transform("cayley", 0.4, nu=0.7)):
        for pair in ((of_array(a), None), (of_array(a), of_array(b))):
            assert np.isclose(np.vdot(y, t.operator(*pair)(x)), np.vdot(t.adjoint(*pair)(y), x)) and np.allclose(t.transpose(*pair)(y), t.adjoint(*pair)(y))
            assert np.allclose(t.shell(*pair).apply(x), t.operator(*pair)(x))
    assert Transform("cayley", 0.5, nu=2.0).scaled(3).nu == 6.0 and np.isclose(Transform().bilinear(of_array(b), True)(x, y), x @ b @ y)


def test_results_tell_of_themselves(spark):
    r = eigs(random_operator(20, 11, True), nev=2)
    q = r.invariant_subspace()
    assert q.shape == (20, 2) and np.allclose(q.T @ q, np.eye(2))
    rows = {x["setting"]: x["value"] for x in r.view(spark).collect()}
    assert rows["problem"] == "hep" and rows["converged"] == "2"


def test_monitors_all_run():
    seen = []
    eigs(random_operator(20, 12, True), monitor=[lambda *x, k=k: seen.append(k) for k in range(7)])
    assert set(seen) == set(range(7))


def test_problem_type_beyond_the_dense_form():
    d = np.arange(1.0, 2502.0)
    a = Operator(2501, lambda x: d * x if x.ndim == 1 else d[:, None] * x, None, None, False, d, d.max())
    shifted = Operator(2501, lambda x: np.roll(x, 1, 0), None, None, False, None, 1.0)
    minus = Operator(2501, lambda x: -a.apply(x), None, None, False, -d, d.max())
    assert infer(a, None, None) == "hep" and infer(shifted, None, None) == "nhep" and infer(a, a, None) == "ghep" and infer(a, minus, None) == "gnhep"


def test_solvers_of_ones_own():
    register("doubled", lambda a, f, b, ncv, tol, max_it: Action(2 * b, 1, "tolerance"))
    assert (funm_multiply(np.eye(3), scalar.Exp(), np.ones(3), solver="doubled").y == 2).all()
    register_equation("stein", lambda a, c, ncv, tol, max_it: "answer")
    assert solve_equation(np.eye(3), np.ones(3), kind="stein") == "answer"


def test_indefinite_pairs():
    n = 80
    flip, signs = np.eye(n)[::-1], (-1.0) ** np.arange(n)
    known = signs * (2 - 2 * np.cos(np.pi * np.arange(1, n + 1) / (n + 1)))
    r = eigs(line(n), flip, nev=4, problem="ghiep", tol=1e-9)
    assert np.allclose(np.sort(r.values), np.sort(known[np.argsort(-np.abs(known))[:4]]), atol=1e-8) and r.errors.max() < 1e-7
    r = eigs(line(n), flip, nev=6, problem="ghiep", target=0.5, transform="sinvert")
    assert np.allclose(r.values, known[np.argsort(np.abs(known - 0.5))[:6]], atol=1e-8)
    a = np.random.default_rng(2).standard_normal((40, 40))
    a, b = a + a.T, np.diag(np.where(np.arange(40) % 3 == 0, -1.0, 2.0))
    r, w = eigs(a, b, nev=4, problem="ghiep", target=0.0, transform="sinvert"), np.linalg.eigvals(np.linalg.solve(b, a))
    assert np.allclose(np.sort(np.abs(r.values))[:4], np.sort(np.abs(w))[:4], atol=1e-7)  # some are complex pairs
    with pytest.raises(ValueError):
        eigs(a, b, problem="ghiep", target=1j, transform="sinvert")


@pytest.mark.parametrize("pair,options", [(False, {}), (False, {"target": 0.3, "transform": "sinvert"}), (True, {}), (True, {"target": 1.0, "transform": "sinvert"})])
def test_both_sides(pair, options):
    rng = np.random.default_rng(0)
    a, b = rng.standard_normal((120, 120)), 2 * np.eye(120) + 0.1 * rng.standard_normal((120, 120))
    b = b if pair else np.eye(120)
    r = eigs(a, b if pair else None, nev=4, two_sided=True, tol=1e-9, **options)
    left = r.left.conj().T
    assert r.nconv >= 4 and r.errors.max() < 1e-7
    assert np.abs(left @ a - r.values[:, None] * (left @ b)).max() < 1e-7 * np.abs(left).max()
    assert np.allclose(np.diag(left @ b @ r.vectors), 1)
    # left and right vectors of different values are orthogonal through B
    assert np.abs(left @ b @ r.vectors - np.eye(r.nconv)).max() < 1e-6


def test_power_on_both_sides():
    a = np.diag([1.0, 2, 3, 5, 9]) + np.triu(np.ones((5, 5)), 1)
    r = eigs(a, nev=2, solver="power", two_sided=True, tol=1e-10)
    assert np.allclose(r.values, [9, 5]) and np.allclose(r.left.conj().T @ a, r.values[:, None] * r.left.conj().T, atol=1e-6)


@pytest.mark.parametrize("basis", dense.BASES)
@pytest.mark.parametrize("target", [0.3, 0.3 + 0.1j, None])
def test_shared_basis_is_the_companion_process(basis, target):
    rng = np.random.default_rng(4)
    mats = [rng.standard_normal((20, 20)), 3 * rng.standard_normal((20, 20)), rng.standard_normal((20, 20)) + 9 * np.eye(20), 5 * np.eye(20)]
    a, b = (polyeigs(mats, basis=basis, nev=3, target=target, solver=s, tol=1e-9) for s in ("toar", "lapack"))
    key = (lambda v: v) if target is None else (lambda v: v - target)
    assert a.nconv >= 3 and np.allclose(np.abs(key(a.values[:3])), np.abs(key(b.values[:3])), atol=1e-7) and a.errors.max() < 1e-7


def test_shared_basis_stays_small():
    from eigenfold.operators import spaces

    rng = np.random.default_rng(4)
    space = spaces.Compact([of_array(rng.standard_normal((200, 200))) for _ in range(4)], "monomial", 0.1, rng.standard_normal(600), 12)
    h = np.zeros((13, 12))
    for j in range(12):
        h[: j + 1, j], h[j + 1, j], _ = space.expand(j)
    assert space.rank == 15  # d blocks and one more each step, not d times as many
    whole = space.vectors(np.eye(12))
    assert np.allclose(whole.T @ whole, np.eye(12), atol=1e-10)
    w, y = np.linalg.eig(h[:12])
    at = np.argsort(-np.abs(w))[: 4 if abs(np.sort(-np.abs(w))[3] - np.sort(-np.abs(w))[4]) > 1e-9 else 5]
    u, s, _ = np.linalg.svd(np.hstack([y[:, at].real, y[:, at].imag]), full_matrices=False)
    q = u[:, s > 1e-10]
    before, last = space.vectors(np.hstack([q, np.zeros((12, 1))])), space.vectors(np.eye(13)[:, 12:])
    space.restart(q, np.ones(q.shape[1]), 12)
    assert space.rank == q.shape[1] + 1 + 3 - 1
    assert np.allclose(space.vectors(np.eye(q.shape[1])), before[:, :-1], atol=1e-10)
    assert np.allclose(space.vectors(np.eye(q.shape[1] + 1)[:, -1:]), last, atol=1e-10)
    with pytest.raises(ValueError):
        polyeigs([rng.standard_normal((9, 9)), np.eye(9), np.eye(9)], target=0.1, solver="stoar")


@pytest.mark.parametrize("which", ["largest", "smallest"])
@pytest.mark.parametrize("how", ["upper", "single", "lower"])
def test_gsvd_by_lanczos(which, how):
    rng = np.random.default_rng(0)
    a, b = rng.standard_normal((60, 30)), rng.standard_normal((40, 30))
    r, known = (gsvds(a, b, 4, which=which, solver=s) for s in ("trlanczos", "lapack"))
    if how != "upper":
        r = svds(a, b, nsv=4, which=which, solver="trlanczos", bidiagonalisation=how)
    assert np.allclose(r.values, known.values, atol=1e-8) and r.errors.max() < 1e-6
    assert np.allclose(np.linalg.norm(a @ r.v, axis=0) ** 2 + np.linalg.norm(b @ r.v, axis=0) ** 2, 1)


@pytest.mark.parametrize("solver", ["trlanczos", "cross", "lapack"])
def test_hsvd_solvers(solver):
    a, omega = np.random.default_rng(3).standard_normal((80, 30)), np.where(np.arange(80) < 50, 1.0, -1.0)
    r = hsvds(of_array(a), omega, 5, solver=solver, tol=1e-9)
    assert np.allclose(r.values, hsvds(of_array(a), omega, 5).values) and r.errors.max() < 1e-6
    assert np.allclose(r.u.T @ (omega[:, None] * r.u), np.diag(r.signature), atol=1e-6)


@pytest.mark.parametrize("solver", ["toar", "stoar"])
def test_interval_of_a_polynomial_without_the_dense_form(solver):
    n = 150
    t = 3 * np.eye(n) - np.eye(n, k=1) - np.eye(n, k=-1)
    mats = [5 * t, 10 * t, np.eye(n)]
    a, b = (polyeigs(mats, interval=(-0.52, -0.51), solver=solver, which="all", krylov=k, tol=1e-9) for k in (True, False))
    assert len(b.values) > 10 and np.allclose(np.sort(a.values), np.sort(b.values), atol=1e-8) and a.errors.max() < 1e-7


@pytest.mark.parametrize("options", [{"krylov": True}, {"full_basis": True}, {"krylov": True, "poles": "aaa"}])
def test_rational_krylov(options):
    region = Interval(a=0.5, b=10.0)
    for n in (40, 150):
        known = nleigs(delay(n), nev=4, target=5.0, solver="interpol", region=region)
        for target in (5.0, 20.0):
            r = nleigs(delay(n), nev=4, target=target, solver="nleigs", region=region, **options)
            assert np.allclose(np.sort(r.values.real), np.sort(known.values.real), atol=1e-7) and len(r.values) == 2 and r.errors.max() < 1e-8


def test_pencil_is_the_dense_one():
    """The block-wise inverse against the pencil written out, with finite poles."""
    from eigenfold.operators import spaces

    rng = np.random.default_rng(5)
    mats, m, n = [of_array(rng.standard_normal((6, 6))) for _ in range(2)], 3, 6
    c, sigma, xi, beta, at = rng.standard_normal((m + 1, 2)), rng.standard_normal(m + 1), np.array([np.inf, 4.0, np.inf, -5.0]), 1 + rng.random(m + 1), 0.7
    d = [sum(w * a.dense() for w, a in zip(row, mats)) for row in c]
    l0, l1 = np.zeros((m * n, m * n)), np.zeros((m * n, m * n))
    cell = lambda i: slice(i * n, (i + 1) * n)
    inv = [0 if np.isinf(x) else 1 / x for x in xi]
    for j in range(1, m):
        l0[cell(j - 1), cell(j - 1)], l0[cell(j - 1), cell(j)] = sigma[j - 1] * np.eye(n), beta[j] * np.eye(n)
        l1[cell(j - 1), cell(j - 1)], l1[cell(j - 1), cell(j)] = np.eye(n), beta[j] * inv[j] * np.eye(n)
    for j in range(m):
        l0[cell(m - 1), cell(j)] += d[j]
        l1[cell(m - 1), cell(j)] += inv[m] * d[j]
    l0[cell(m - 1), cell(m - 1)] -= sigma[m - 1] / beta[m] * d[m]
    l1[cell(m - 1), cell(m - 1)] -= d[m] / beta[m]
    y, same = rng.standard_normal(m * n), lambda x: x
    pencil = spaces.Pencil(mats, c, sigma, xi, beta, at)
    assert np.allclose(pencil.apply(y.reshape(m, n), same, same).ravel(), np.linalg.solve(l0 - at * l1, l1 @ y))


def test_linear_problems_on_both_sides():
    r = nleigs(delay(60), target=0.8, solver="slp", two_sided=True)
    m = Nonlinear.split(delay(60)).at(r.values[0]).dense()
    assert abs(r.values[0] - nleigs(delay(60), target=0.8, solver="slp").values[0]) < 1e-8
    assert np.abs(r.left[:, 0].conj() @ m).max() < 1e-6 and r.errors.max() < 1e-8


def test_nonlinear_power_and_a_polynomial_solver_of_ones_own():
    n = 20
    at = lambda x: of_array(line(n) + np.diag(np.abs(x) ** 2) * 5)
    for shift in (None, 0.0):
        k, x, _, ok = processes.nonlinear_power(at, np.ones(n), shift=shift, tol=1e-8, most=5000)
        assert ok and np.linalg.norm(at(x).apply(x) - k * x) < 1e-6
    k, x, _, ok = processes.nonlinear_power(lambda x: of_array(line(n)), np.ones(n), lambda x: of_array(2 * np.eye(n)), shift=0.0)
    assert ok and np.isclose(k, np.linalg.eigvalsh(line(n))[0] / 2)
    from eigenfold.operators import polynomial

    polynomial.register("mine", lambda mats, basis, nev, which, target, tol, options: (*dense.polyeig([m.dense() for m in mats], basis), 1))
    try:
        assert np.allclose(polyeigs(spring(), nev=2, target=-0.5, solver="mine").values[:2], polyeigs(spring(), nev=2, target=-0.5, solver="lapack").values)
    finally:
        del polynomial.SOLVERS["mine"]


@pytest.mark.parametrize("b", [None, 4 * np.eye(100)])
def test_double_expansion(b):
    a = GRID + np.diag(np.linspace(0, 3, 100))
    known = np.linalg.eigvalsh(a)[:4] / (1 if b is None else 4)
    r = eigs(a, b, nev=4, which="smallest_real", solver="gd", double=True)
    assert np.allclose(r.values, known, atol=1e-7) and r.errors.max() < 1e-6


def test_indefinite_and_nonsymmetric_pairs_beyond_the_dense_form():
    """B is neither definite nor symmetric here, so that conjugate gradients would not solve with it."""
    n = 2100
    d, off = np.r_[50.0, 40, 30, np.linspace(0, 1, n - 3)], np.where(np.arange(n) % 2 == 0, 0.5, 0.0)[: n - 1]
    def banded(up, low):
        def product(x, u, l, main):
            y = main * x if x.ndim == 1 else main[:, None] * x
            uu, ll = (u, l) if x.ndim == 1 else (u[:, None], l[:, None])
            y[:-1] += uu * x[1:]
            y[1:] += ll * x[:-1]
            return y
        main = np.where(np.arange(n) % 2 == 0, 2.0, -1.0)
        return Operator(n, lambda x: product(x, up, low, main), lambda x: product(x, low, up, main), None, False, main, 3.0)
    a = Operator(n, lambda x: d * x if x.ndim == 1 else d[:, None] * x, lambda x: d * x if x.ndim == 1 else d[:, None] * x, None, False, d, 50.0)
    for b, kind in ((banded(off, off), "ghiep"), (banded(off, 0 * off), "gnhep")):
        r = eigs(a, b, nev=2, problem=kind, tol=1e-8)
        assert r.nconv >= 2 and r.errors.max() < 1e-6
        known = np.linalg.eigvals(np.linalg.solve(b.apply(np.eye(n)[:, :4])[:4], np.diag(d[:4])))
        assert np.allclose(np.sort(np.abs(r.values[:2])), np.sort(np.abs(known))[-2:], atol=1e-6)
