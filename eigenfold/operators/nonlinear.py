"""Nonlinear eigenproblems T(k) x = 0, in split form sum f_i(k) A_i or by callables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

from .. import dense
from ..functions.order import order
from ..functions.region import Interval, Region
from ..functions.scalar import Function
from ..matrix import DENSE_ROWS, Operator, as_operator, of_array
from . import eigen, polynomial, processes, spaces
from .eigen import EigenResult
from .transform import combination, solver_for


@dataclass
class Nonlinear:
    """T(k): terms (A_i, f_i), or ``function`` and ``jacobian`` that give a matrix for a number."""

    terms: list[tuple[Operator, Function]] | None = None
    function: Callable | None = None
    jacobian: Callable | None = None

    @classmethod
    def split(cls, terms: list) -> Nonlinear:
        return cls([(as_operator(a), f) for a, f in terms])

    @property
    def n(self) -> int:
        return self.terms[0][0].n if self.terms else as_operator(self.function(0.1)).n

    def at(self, k: complex) -> Operator:
        if self.terms:
            return combination([(f(k), a) for a, f in self.terms])
        return as_operator(self.function(k))

    def slope(self, k: complex) -> Operator:
        if self.terms:
            return combination([(f.derivative(k), a) for a, f in self.terms])
        if self.jacobian is not None:
            return as_operator(self.jacobian(k))
        h = 1e-6 * max(1.0, abs(k))
        return combination([(1 / (2 * h), self.at(k + h)), (-1 / (2 * h), self.at(k - h))])

    def projected(self, v: np.ndarray) -> Nonlinear:
        """V^H T(k) V."""
        if self.terms:
            return Nonlinear([(of_array(v.conj().T @ a.apply(v)), f) for a, f in self.terms])
        return Nonlinear(function=lambda k: v.conj().T @ self.at(k).apply(v), jacobian=lambda k: v.conj().T @ self.slope(k).apply(v))


def residuals(t: Nonlinear, values: np.ndarray, x: np.ndarray, kind: str = "relative") -> np.ndarray:
    out = []
    for k, v in enumerate(values):
        op = t.at(v)
        r = np.linalg.norm(op.apply(x[:, k])) / max(np.linalg.norm(x[:, k]), 1e-300)
        if kind == "relative":
            r /= max(abs(v), 1e-300)
        elif kind == "backward":
            r /= sum(abs(f(v)) * (a.norm or 1.0) for a, f in t.terms) if t.terms else (op.norm or 1.0)
        out.append(r)
    return np.array(out)


def refine(t: Nonlinear, value: complex, x: np.ndarray, steps: int = 3) -> tuple[complex, np.ndarray]:
    """Newton steps on a pair."""
    n = t.n
    c = x / np.vdot(x, x)
    for _ in range(steps):
        a, b = t.at(value), t.slope(value)
        big = np.zeros((n + 1, n + 1), complex)
        big[:n, :n], big[:n, n], big[n, :n] = a.dense(), b.apply(x), c.conj()
        s = np.linalg.solve(big, np.concatenate([-a.apply(x), [1 - np.vdot(c, x)]]))
        x, value = x + s[:n], value + s[n]
    return value, x / np.linalg.norm(x)


def _held_out(t: Nonlinear, found: list[tuple[complex, np.ndarray]], k: complex) -> np.ndarray:
    """T(k) bordered so that pairs found are no solutions any more: T(k) - sum T(k) x x^H / ... by a rank-one change
    that moves each found value away."""
    a = t.at(k).dense().astype(complex)
    for value, x in found:
        # (I - x x^H (k - value) ... ): x gets the value k - value removed from its direction
        a = a @ (np.eye(len(a)) + np.outer(x, x.conj()) * (1 / (k - value) - 1 if abs(k - value) > 1e-14 else 1e14))
    return a


def _deflated(t: Nonlinear, found: list[tuple[complex, np.ndarray]]) -> Nonlinear:
    if not found:
        return t

    def jac(k):
        h = 1e-6 * max(1.0, abs(k))
        return (_held_out(t, found, k + h) - _held_out(t, found, k - h)) / (2 * h)

    return Nonlinear(function=lambda k: _held_out(t, found, k), jacobian=jac)


def _back(found: list[tuple[complex, np.ndarray]], k: complex, y: np.ndarray) -> np.ndarray:
    for value, x in reversed(found):
        y = y + x * np.vdot(x, y) * (1 / (k - value) - 1)
    return y / np.linalg.norm(y)


def _rii(t: Nonlinear, k: complex, x: np.ndarray, tol: float, most: int) -> tuple[complex, np.ndarray, int, bool]:
    """Residual inverse iteration: corrections with T at a lagged value; the value from x^H T(sigma)^-1 T(k) x = 0."""
    sigma = k
    for it in range(1, most + 1):
        if (it - 1) % 4 == 0:
            sigma, solve = k, solver_for(t.at(k + 1e-10))
        for _ in range(6):  # scalar Newton for the value
            w = t.at(k).apply(x)
            dw = t.slope(k).apply(x)
            u = solve(np.stack([w, dw], 1))
            den = np.vdot(x, u[:, 1])
            step = np.vdot(x, u[:, 0]) / den if den != 0 else 0
            k = k - step
            if abs(step) <= 1e-14 * max(1, abs(k)):
                break
        r = t.at(k).apply(x)
        if np.linalg.norm(r) <= tol * max(abs(k), 1e-8):
            return k, x, it, True
        x = x - solve(r)
        x = x / np.linalg.norm(x)
    return k, x, most, False


def _slp(t: Nonlinear, k: complex, x: np.ndarray, tol: float, most: int) -> tuple[complex, np.ndarray, int, bool]:
    """Successive linear problems T(k) x = mu T'(k) x; k moves by the smallest mu."""
    for it in range(1, most + 1):
        a, b = t.at(k), t.slope(k)
        if t.n <= DENSE_ROWS:
            try:
                mu, y = np.linalg.eig(np.linalg.solve(a.dense() + 0j, b.dense()))
            except np.linalg.LinAlgError:  # k is a value to the last digit
                return k, np.linalg.svd(a.dense())[2][-1].conj(), it, True
            i = int(np.abs(mu).argmax())
            mu, x = 1 / mu[i], y[:, i]
        else:
            r = eigen.eigs(a, b, nev=1, target=0.0, transform="sinvert", problem="gnhep")
            mu, x = r.values[0], r.vectors[:, 0]
        k = k - mu
        x = x / np.linalg.norm(x)
        if np.linalg.norm(t.at(k).apply(x)) <= tol * max(abs(k), 1e-8):
            return k, x, it, True
    return k, x, most, False


def _narnoldi(t: Nonlinear, k: complex, x: np.ndarray, tol: float, most: int) -> tuple[complex, np.ndarray, int, bool]:
    """A space grown by residuals through T at the start; the small projected problem is solved by the linear ones."""
    v = x[:, None] / np.linalg.norm(x)
    solve, begin = solver_for(t.at(k + 1e-10)), k
    for it in range(1, most + 1):
        small = t.projected(v)
        k2, y, _, ok = _slp(small, begin, np.ones(v.shape[1]) + 0j, 1e-13, 60)
        if ok and abs(k2 - begin) <= 100 * (1 + abs(begin)):  # else the small space does not have a value near yet
            k = k2
        x = v @ y
        r = t.at(k).apply(x)
        if np.linalg.norm(r) <= tol * max(abs(k), 1e-8) * np.linalg.norm(x):
            return k, x / np.linalg.norm(x), it, True
        w = solve(r)
        for _ in range(2):
            w = w - v @ (v.conj().T @ w)
        v = np.hstack([v, (w / np.linalg.norm(w))[:, None]])
        if v.shape[1] > min(60, t.n):
            v, solve = x[:, None] / np.linalg.norm(x), solver_for(t.at(k + 1e-10))
    return k, x, most, False


def chebyshev_nodes(n: int, a: float, b: float) -> np.ndarray:
    return (a + b) / 2 + (b - a) / 2 * np.cos(np.pi * (np.arange(n) + 0.5) / n)


def _interpol(t: Nonlinear, region: Interval, degree: int):
    """The polynomial through T at Chebyshev nodes, and its eigenpairs inside."""
    a, b = region.a, region.b
    z = chebyshev_nodes(degree + 1, a, b)
    j = np.arange(degree + 1)
    c = 2 / (degree + 1) * np.cos(np.pi * np.outer(j, np.arange(degree + 1) + 0.5) / (degree + 1))
    c[0] /= 2
    if t.terms:
        f = np.array([[g(x) for x in z] for _, g in t.terms])
        mats = [combination([(c[i] @ f[s], m) for s, (m, _) in enumerate(t.terms)]).dense() for i in j]
    else:
        at = [t.at(x).dense() for x in z]
        mats = [sum(c[i, s] * at[s] for s in range(degree + 1)) for i in j]
    w, x = dense.polyeig(mats, "chebyshev1")
    ok = np.isfinite(w) & (np.abs(w.real) <= 1.0001) & (np.abs(w.imag) <= 0.1)
    return (a + b) / 2 + (b - a) / 2 * w[ok], x[:, ok]


def _interpolation(t: Nonlinear, region: Region, poles, degree: int):
    """Leja points of the region's border, poles, scalings of the rational nodes, and the nodes at the points.

    Without poles the nodes are those of Newton interpolation; ``poles`` may be "aaa", from approximations of the scalar functions."""
    border = region.contour(400) if not (isinstance(region, Interval) and not np.isfinite(region.c + region.d)) else None
    if border is None or isinstance(region, Interval) and region.c == region.d:
        border = np.linspace(region.a, region.b, 400).astype(complex)
    if isinstance(poles, str):
        sets = [dense.aaa_poles(*(lambda q: (q[0], q[2]))(dense.aaa(np.array([f(complex(z)) for z in border]), border))) for _, f in (t.terms or [])]
        poles = np.concatenate(sets) if sets else np.zeros(0)
        poles = poles[region.inside(poles) < 0] if len(poles) else poles
    poles = np.asarray(poles if poles is not None else [], complex)
    sigma, xi, beta = dense.leja_bagby(border, poles, degree + 1)

    def nodes(z: complex) -> np.ndarray:
        """b_0(z) ... b_degree(z)."""
        b = [1 / beta[0]]
        for j in range(1, degree + 1):
            den = 1 - z / xi[j] if np.isfinite(xi[j]) and xi[j] != 0 else 1.0
            b.append(b[-1] * (z - sigma[j - 1]) / (beta[j] * den))
        return np.array(b)

    return sigma, xi, beta, np.array([nodes(s) for s in sigma]), complex(border.mean())


def _nleigs(t: Nonlinear, region: Region, poles, degree: int):
    """Rational interpolation of T on the region, and all pairs of the linear pencil, dense."""
    sigma, xi, beta, table, _ = _interpolation(t, region, poles, degree)
    n = t.n
    at = [t.at(s).dense().astype(complex) for s in sigma]
    d: list[np.ndarray] = []
    for j in range(degree + 1):
        d.append((at[j] - sum(table[j, i] * d[i] for i in range(j))) / table[j, j])
        if j > 2 and np.linalg.norm(d[j]) <= 1e-13 * np.linalg.norm(d[0]):
            break
    m = len(d) - 1
    l0, l1 = np.zeros((m * n, m * n), complex), np.zeros((m * n, m * n), complex)
    block = lambda i: slice(i * n, (i + 1) * n)
    for j in range(1, m):  # beta_j (1 - z / xi_j) b_j = (z - sigma_{j-1}) b_{j-1}
        inv = 1 / xi[j] if np.isfinite(xi[j]) and xi[j] != 0 else 0.0
        r = block(j - 1)
        l0[r, block(j - 1)], l0[r, block(j)] = sigma[j - 1] * np.eye(n), beta[j] * np.eye(n)
        l1[r, block(j - 1)], l1[r, block(j)] = np.eye(n), beta[j] * inv * np.eye(n)
    inv = 1 / xi[m] if np.isfinite(xi[m]) and xi[m] != 0 else 0.0
    r = block(m - 1)
    for j in range(m):  # sum d_j b_j = 0 with b_m from the recurrence
        l0[r, block(j)] += d[j]
        l1[r, block(j)] += inv * d[j]
    l0[r, block(m - 1)] -= sigma[m - 1] / beta[m] * d[m]
    l1[r, block(m - 1)] -= d[m] / beta[m]
    w, y = dense.gnhep(l0, l1)
    x = y.reshape(m, n, -1)
    pick = np.linalg.norm(x, axis=1).argmax(0)
    return w, x[pick, :, np.arange(x.shape[2])].T


def _nleigs_krylov(t: Nonlinear, region: Region, poles, degree: int, nev: int, target: complex, tol: float, full: bool, seed: int, ncv: int | None = None, most: int = 200):
    """The same pencil about the target, never formed: a Krylov solve with a shared basis for its blocks, or with whole vectors (``full``).
    The values nearest the target come first; if the target lies outside, those about the region's middle, until one is outside."""
    sigma, xi, beta, table, middle = _interpolation(t, region, poles, degree)
    f = np.array([[complex(g(complex(z))) for _, g in t.terms] for z in sigma])
    c: list[np.ndarray] = []
    for j in range(degree + 1):
        c.append((f[j] - sum(table[j, i] * c[i] for i in range(j))) / table[j, j])
        if j > 2 and np.abs(c[j]).max() <= 1e-14 * np.abs(c[0]).max():
            break
    inside = region.inside(np.array([target]))[0] >= 0
    at = complex(target) if inside else middle
    pencil = spaces.Pencil([a for a, _ in t.terms], np.array(c), sigma, xi, beta, at)
    m, n, want = pencil.blocks, t.n, nev
    start = np.random.default_rng(seed).standard_normal(m * n) + 0j
    while True:
        size = min(ncv or max(2 * want, want + 20), m * n)
        same = lambda x: x
        space = spaces.Plain(lambda y: pencil.apply(y.reshape(m, n), same, same).ravel(), start, size) if full else spaces.Rational(pencil, start, size)
        stop = lambda it, nconv: "tolerance" if nconv >= want else "iterations" if it >= most else None
        theta, y, its, why = spaces.restarted(space, want, lambda th: np.argsort(-np.abs(th), kind="stable"), polynomial._Relative(tol), stop, lambda *a: None, False)
        w = 1 / theta + at
        held = region.inside(w) >= 0
        if inside and held.sum() >= nev or not held.all() or why != "tolerance" or size >= m * n:
            break
        want *= 2
    x = y.reshape(m, n, -1)
    pick = np.linalg.norm(x, axis=1).argmax(0)
    return w, x[pick, :, np.arange(x.shape[2])].T, its


def resolvent(t: Nonlinear, values: np.ndarray, x: np.ndarray, y: np.ndarray, omega: complex, v: np.ndarray) -> np.ndarray:
    """The part of T(omega)^-1 v that eigentriplets (value, x, y) make up: sum x y^H v / (omega - value), with y scaled to y^H T'(value) x = 1."""
    out = np.zeros(len(v), complex)
    for k, value in enumerate(values):
        c = np.vdot(y[:, k], t.slope(value).apply(x[:, k]))
        out += x[:, k] * (np.vdot(y[:, k], v) / c / (omega - value))
    return out


SOLVERS: dict[str, Callable] = {"rii": _rii, "slp": _slp, "narnoldi": _narnoldi}


def register(name: str, solver: Callable) -> None:
    SOLVERS[name] = solver


def nleigs(
    problem, nev: int = 1, target: complex = 0.0, which: str = "target_magnitude", solver: str = "rii", region: Region | None = None, tol: float = 1e-8, max_it: int = 200, degree: int | None = None, poles=None,
    refine_steps: int = 0, two_sided: bool = False, initial: np.ndarray | None = None, seed: int = 0, **options,
) -> EigenResult:
    """Eigenpairs of ``problem``: a ``Nonlinear`` or a list of terms (matrix, function)."""
    t = problem if isinstance(problem, Nonlinear) else Nonlinear.split(problem)
    n, its = t.n, 1
    if solver == "slp" and two_sided and nev == 1:
        value, x, y, its, ok = slp_two_sided(t, target, tol, max_it, seed)
        w, x = np.array([value]), x[:, None]
        return EigenResult(w, x, residuals(t, w, x), solver, its, "tolerance" if ok else "iterations", y[:, None])
    if solver in SOLVERS:
        found: list[tuple[complex, np.ndarray]] = []
        out: list[tuple[complex, np.ndarray]] = []
        rng = np.random.default_rng(seed)
        its = 0
        reason = "tolerance"
        for k in range(nev):
            work = _deflated(t, found)
            x = (initial if initial is not None and k == 0 else rng.standard_normal(n)) + 0j
            x /= np.linalg.norm(x)
            value, y, it, ok = SOLVERS[solver](work, target + (1e-3 * k if k else 0), x, tol, max_it)
            its += it
            if not ok:
                reason = "iterations"
                break
            z = _back(found, value, y)
            if found:
                value, z = refine(t, value, z, 2)
            found.append((value, z))
            out.append((value, z))
        w, x = np.array([v for v, _ in out]), np.stack([z for _, z in out], 1) if out else np.zeros((n, 0), complex)
    else:
        reason = "tolerance"
        if region is None:
            raise ValueError(f"{solver} needs a region")
        if solver == "interpol":
            w, x = _interpol(t, region, degree or 12)
        elif solver == "nleigs" and t.terms and (options.get("krylov") or options.get("full_basis") or n * (degree or 20) > DENSE_ROWS):
            w, x, its = _nleigs_krylov(t, region, poles, degree or 20, nev, target, tol, bool(options.get("full_basis")), seed, options.get("ncv"), max_it)
        elif solver == "nleigs":
            w, x = _nleigs(t, region, poles, degree or 20)
        elif solver == "ciss":
            w, x, _ = eigen.contour(n, lambda z, v: solver_for(t.at(z))(v), lambda q: _small(t.projected(q), region), region, False, **{k: options[k] for k in ("nodes", "block", "moments", "extraction") if k in options})
        else:
            raise ValueError(f"no such solver: {solver}")
        inside = np.isfinite(w) & (region.inside(np.where(np.isfinite(w), w, 0)) >= 0)
        if solver == "interpol":
            inside = np.isfinite(w) & (w.real >= region.a) & (w.real <= region.b)
        w, x = w[inside], x[:, inside]
        pairs = []
        for k in range(len(w)):  # polish, and drop what is no solution
            v, z = refine(t, w[k], x[:, k] / np.linalg.norm(x[:, k]), 2) if n <= DENSE_ROWS else (w[k], x[:, k] / np.linalg.norm(x[:, k]))
            if np.linalg.norm(t.at(v).apply(z)) <= 1e-6 * max(1.0, abs(v)) and all(abs(v - p) > 1e-8 * max(1, abs(p)) or abs(np.vdot(z, q)) < 0.99 for p, q in pairs):
                pairs.append((v, z))
        w, x = np.array([v for v, _ in pairs]), np.stack([z for _, z in pairs], 1) if pairs else np.zeros((n, 0), complex)
    if refine_steps and len(w):
        pairs = [refine(t, v, x[:, k], refine_steps) for k, v in enumerate(w)]
        w, x = np.array([v for v, _ in pairs]), np.stack([z for _, z in pairs], 1)
    at = order(w, which, target)[: nev if nev else None]
    w, x = w[at], x[:, at]
    result = EigenResult(w, x, residuals(t, w, x), solver, its, reason)
    if two_sided:
        result.left = np.stack([_left(t, v) for v in w], 1) if len(w) else x
    return result


def _left(t: Nonlinear, value: complex) -> np.ndarray:
    """y with y^H T(value) = 0: the dense form's, or by inverse iteration with the adjoint."""
    if t.n <= DENSE_ROWS:
        u, _, _ = np.linalg.svd(t.at(value).dense())
        return u[:, -1]
    solve = solver_for(processes.adjoint(t.at(value * (1 + 1e-8) + 1e-12)))
    y = np.random.default_rng(1).standard_normal(t.n) + 0j
    for _ in range(3):
        y = solve(y)
        y /= np.linalg.norm(y)
    return y


def slp_two_sided(t: Nonlinear, k: complex, tol: float = 1e-10, most: int = 60, seed: int = 0) -> tuple[complex, np.ndarray, np.ndarray, int, bool]:
    """Successive linear problems on both sides: from a pair of vectors, solves with T(k) and its adjoint give the next right and left
    vectors, and their two-sided quotient y^H T x / y^H T' x the step of k, which so converges cubically."""
    rng = np.random.default_rng(seed)
    x, y = rng.standard_normal(t.n) + 0j, rng.standard_normal(t.n) + 0j
    for it in range(1, most + 1):
        a, b = t.at(k), t.slope(k)
        forth, back = solver_for(a), solver_for(processes.adjoint(a))
        for _ in range(4 if it == 1 else 1):
            x, y = forth(b.apply(x)), back(b.adjoint(y))
            x, y = x / np.linalg.norm(x), y / np.linalg.norm(y)
        k = k - np.vdot(y, a.apply(x)) / np.vdot(y, b.apply(x))
        a = t.at(k)
        if max(np.linalg.norm(a.apply(x)), np.linalg.norm(a.adjoint(y))) <= tol * max(abs(k), 1e-8):
            return k, x, y, it, True
    return k, x, y, most, False


def _small(t: Nonlinear, region: Region) -> tuple[np.ndarray, np.ndarray]:
    """A projected problem, by rational interpolation on the region."""
    w, x = _nleigs(t, region, None, 24)
    return w, x / np.linalg.norm(x, axis=0)
