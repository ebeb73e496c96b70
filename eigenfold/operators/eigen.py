"""Linear eigenproblems A x = k B x.

``eigs`` is the entry: it infers the problem type, builds the transformed operator, runs the solver asked for and puts values in
order. The matrix may be an array, a ``Matrix`` (then every operator application is a Spark job over its cached partitions, unless it
is small enough to be gathered) or any ``Operator``.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from .. import dense
from ..functions.order import order
from ..functions.region import Interval, Region
from ..matrix import DENSE_ROWS, Operator, as_operator
from . import processes, spaces
from .basis import arnoldi, biorthogonalise, orthogonalise, svd_and_rank
from .transform import Transform, combination, conjugate_gradient, gmres, identity, solver_for, spectral_range

PROBLEMS = ("hep", "ghep", "nhep", "gnhep", "pgnhep", "ghiep", "bse")


@dataclass
class EigenResult:
    """Values in order, vectors by column, relative residuals, and how the solve went."""

    values: np.ndarray
    vectors: np.ndarray | None
    errors: np.ndarray
    solver: str
    iterations: int = 0
    reason: str = "tolerance"
    left: np.ndarray | None = None
    history: list[tuple[int, int, complex, float]] = field(default_factory=list)
    real: bool = False
    settings: dict = field(default_factory=dict)

    @property
    def nconv(self) -> int:
        return len(self.values)

    def eigenvalues(self, spark: SparkSession) -> DataFrame:
        rows = [(k, float(np.real(v)), float(np.imag(v)), float(e)) for k, (v, e) in enumerate(zip(self.values, self.errors))]
        return spark.createDataFrame(rows, "k int, re double, im double, errest double")

    def eigenvectors(self, spark: SparkSession) -> DataFrame:
        if self.vectors is None:
            return spark.createDataFrame([], "k int, i long, xr double, xi double")
        rows = [(k, i, float(np.real(x)), float(np.imag(x))) for k in range(self.nconv) for i, x in enumerate(self.vectors[:, k])]
        return spark.createDataFrame(rows, "k int, i long, xr double, xi double")

    def invariant_subspace(self) -> np.ndarray:
        """An orthonormal basis of the space that the vectors span; real if the problem is."""
        x = self.vectors
        if self.real and np.iscomplexobj(x):
            x = np.hstack([x.real, x.imag])
        u, s, _ = np.linalg.svd(x, full_matrices=False)
        return u[:, s > 1e-10 * s.max(initial=1e-300)]

    def view(self, spark: SparkSession) -> DataFrame:
        """What was asked and how it was solved, one row a setting."""
        return spark.createDataFrame([(k, str(v)) for k, v in [("solver", self.solver), *self.settings.items(), ("converged", self.nconv), ("iterations", self.iterations), ("reason", self.reason)]], "setting string, value string")

    def summary(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(self.nconv, self.iterations, self.reason, self.solver)], "nconv int, its int, reason string, solver string")

    def progress(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(i, k, float(np.real(v)), float(np.imag(v)), float(e)) for i, k, v, e in self.history], "it int, k int, re double, im double, errest double")


@dataclass
class Problem:
    a: Operator
    b: Operator | None
    kind: str
    nev: int
    ncv: int
    tol: float
    most: int
    which: str | Callable
    target: complex
    transform: Transform
    region: Region | None
    convergence: str | Callable
    stopping: Callable | None
    monitor: list[Callable]
    deflation: np.ndarray | None
    initial: np.ndarray | None
    rng: np.random.Generator
    options: dict
    history: list = field(default_factory=list)

    @property
    def n(self) -> int:
        return self.a.n

    @property
    def hermitian(self) -> bool:
        return self.kind in ("hep", "ghep")

    @property
    def complex(self) -> bool:
        t = self.transform
        return self.a.complex or (self.b is not None and self.b.complex) or complex(t.sigma).imag != 0 or complex(t.nu or 0).imag != 0

    def start(self, k: int = 1) -> np.ndarray:
        x = self.rng.standard_normal((self.n, k))
        if self.complex:
            x = x + 1j * self.rng.standard_normal((self.n, k))
        if self.initial is not None:
            given = np.atleast_2d(self.initial.T).T[:, :k]
            if np.iscomplexobj(given):
                x = x.astype(complex)
            x[:, : given.shape[1]] = given
        if self.deflation is not None:
            x, _ = orthogonalise(x, self.locked(), self.inner())
        return x

    def locked(self) -> np.ndarray | None:
        if self.deflation is None:
            return None
        if not hasattr(self, "_locked"):
            q, _ = np.linalg.qr(self.deflation.reshape(self.n, -1))
            if self.inner() is not None:
                l = np.linalg.cholesky(q.conj().T @ self.inner()(q))
                q = np.linalg.solve(l, q.conj().T).conj().T
            self._locked = q
        return self._locked

    def inner(self) -> Callable | None:
        """The inner product's matrix: B for a definite generalised problem."""
        return self.b.apply if self.kind in ("ghep",) and self.b is not None else None

    def bx(self, x: np.ndarray) -> np.ndarray:
        return x if self.b is None else self.b.apply(x)

    def wanted(self, theta: np.ndarray) -> np.ndarray:
        """Order of the transformed operator's eigenvalues."""
        t = self.transform
        if t.kind == "filter":
            return np.argsort(-np.abs(theta), kind="stable")
        values = t.eigenvalues(theta)
        return order(np.where(np.isfinite(values), values, 1e300), self.which, self.target, not self.complex, self.region)

    def error(self, residual: float, value: complex) -> float:
        """The residual norm in the measure that convergence is told by."""
        if callable(self.convergence):
            return self.convergence(value, residual)
        if self.convergence == "absolute":
            return residual
        if self.convergence == "norm":
            return residual / ((self.a.norm or 1.0) + abs(value) * ((self.b.norm or 1.0) if self.b is not None else 1.0))
        return residual / max(abs(value), 1e-300) if abs(value) > 0 else residual

    def tell(self, it: int, values, errors) -> None:
        for k, (v, e) in enumerate(zip(values, errors)):
            self.history.append((it, k, complex(v), float(e)))
        for m in self.monitor:
            m(it, values, errors)

    def stop(self, it: int, nconv: int) -> str | None:
        if self.stopping is not None:
            if (told := self.stopping(it, self.most, nconv, self.nev)) is not None:
                return told
        if nconv >= self.nev:
            return "tolerance"
        return "iterations" if it >= self.most else None


# --- solvers: each gives (theta or values, vectors, iterations, reason, whether they are values already) ---


def _lapack(p: Problem):
    a = p.a.dense()
    b = None if p.b is None else p.b.dense()
    if p.deflation is not None:
        q = p.locked()
        full, _ = np.linalg.qr(np.hstack([q, np.eye(p.n)]))
        z = full[:, q.shape[1] : p.n] if p.inner() is None else np.linalg.svd(q.conj().T @ b)[2][q.shape[1] :].conj().T
        a, b = z.conj().T @ a @ z, None if b is None else z.conj().T @ b @ z
    else:
        z = None
    if p.kind == "hep":
        w, x = dense.hep(a)
    elif p.kind == "ghep":
        w, x = dense.ghep(a, b)
    elif b is None:
        w, x = dense.nhep(a)
    else:
        w, x = dense.gnhep(a, b)
    return w, x if z is None else z @ x, 1, "tolerance", True


def _krylovschur(p: Problem, keep: float = 0.5, explicit: bool = False, harmonic: bool = False):
    """Thick restart: the wanted part of the projected problem's space is kept, the rest is spanned anew. ``explicit`` restarts with
    the wanted vectors' sum (Arnoldi, Lanczos)."""
    op, b = p.transform.operator(p.a, p.b, p.kind == "ghep"), p.inner()
    kind = complex if p.complex else float
    n, m = p.n, min(p.ncv, p.n - (0 if p.deflation is None else p.locked().shape[1]))
    sym = p.hermitian and (p.transform.kind not in ("shell",)) and not (p.b is not None and p.kind != "ghep")
    v, h = np.zeros((n, m + 1), kind), np.zeros((m + 1, m), kind)
    x = p.start()[:, 0].astype(kind)
    x /= math.sqrt(abs(np.vdot(x, x if b is None else b(x))))
    v[:, 0] = x
    have, it = 0, 0
    while True:
        it += 1
        j, beta, closed = arnoldi(op, v, h, have, m, b, p.locked())
        t = h[:j, :j]
        if harmonic and p.transform.kind == "shift":  # Ritz values harmonic about the target
            g = t - p.target * np.eye(j)
            e = np.zeros(j)
            e[-1] = 1
            f = np.linalg.solve(g.conj().T, e)
            t = t + beta**2 * np.outer(f, e)
            theta, y = np.linalg.eig(t)
        else:
            f = None
            theta, y = dense.hep(t) if sym else np.linalg.eig(t)
        at = p.wanted(theta)
        theta, y = theta[at], y[:, at]
        last = h[j, :j] if not closed and j < h.shape[0] else np.zeros(j)
        residual = np.abs(last @ y)
        if f is not None:  # harmonic vectors with their Rayleigh quotients
            y = y / np.linalg.norm(y, axis=0)
            plain = h[:j, :j]
            theta = np.einsum("ij,ij->j", y.conj(), plain @ y)
            residual = np.hypot(np.abs(last @ y), np.linalg.norm(plain @ y - y * theta, axis=0))
        value = p.transform.eigenvalues(theta)
        errors = np.array([p.error(r, th) for r, th in zip(residual, theta)])
        nconv = 0
        while nconv < j and (errors[nconv] < p.tol or closed):
            nconv += 1
        p.tell(it, value[: p.nev], errors[: p.nev])
        why = p.stop(it, nconv)
        if why is None and closed:
            why = "tolerance"
        if why is not None:
            k = min(max(nconv, 0), j)
            return theta[:k], v[:, :j] @ y[:, :k], it, why, False
        size = 1 if explicit else max(min(nconv + int((j - nconv) * keep), j - 1), 1)
        if explicit:
            size = max(1, min(nconv + p.nev, j - 1))
        sel = y[:, :size]
        if not p.complex:  # a conjugate pair spans two real directions and stays together
            if size < j and abs(theta[size - 1].imag) > 0 and abs(theta[size - 1] - np.conj(theta[size])) < 1e-8 * abs(theta[size]):
                size += 1
                sel = y[:, :size]
            if size >= j:
                size = j - 1
                sel = y[:, :size]
            sel = np.hstack([sel.real, sel.imag]) if np.iscomplexobj(sel) else sel
            u, s, _ = np.linalg.svd(sel, full_matrices=False)
            q = u[:, s > 1e-10 * s[0]]
        else:
            q, _ = np.linalg.qr(sel)
        if q.shape[1] >= m:
            q = q[:, : m - 1]
        size = q.shape[1]
        tq, row = q.conj().T @ t @ q, last @ q
        u = v[:, j].copy()
        if f is not None:  # what is left over has moved with the translation
            u = u - beta * (v[:, :j] @ f)
            c = -beta * (q.conj().T @ f)
            u = u - (v[:, :j] @ q) @ c
            tq, size_u = tq + np.outer(c, row), np.linalg.norm(u)
            u, row = u / size_u, row * size_u
        v[:, :size] = v[:, :j] @ q
        v[:, size] = u
        h[:] = 0
        h[:size, :size], h[size, :size] = tq, row
        have = size
        if explicit and size == 0:
            have = 0


def _power(p: Problem):
    """One pair after another by power steps; "constant", "rayleigh" and "wilkinson" shifts of the inverse operator."""
    shift = p.options.get("shift", "constant")
    op, b = p.transform.operator(p.a, p.b, p.kind == "ghep"), p.inner()
    locked = np.zeros((p.n, 0), complex if p.complex else float) if p.deflation is None else p.locked()
    found, vectors, it = [], [], 0
    unit = p.b if p.b is not None else identity(p.n)
    for k in range(p.nev):
        x = p.start()[:, 0]
        sigma, solve = None, op
        while it < p.most:
            it += 1
            if locked.shape[1]:
                x, _ = orthogonalise(x, locked, b)
            x = x / math.sqrt(abs(np.vdot(x, x if b is None else b(x))))
            if shift != "constant" and it > 3:
                ax = p.a.apply(x)
                rho = np.vdot(x, ax) / np.vdot(x, p.bx(x))
                if shift == "wilkinson":
                    r = ax - rho * p.bx(x)
                    beta = np.linalg.norm(r)
                    if beta > 0:
                        z = r / beta
                        w = np.linalg.eigvals(np.array([[rho, beta], [beta, np.vdot(z, p.a.apply(z))]]))
                        rho = w[np.abs(w - rho).argmin()]
                r = np.linalg.norm(ax - np.vdot(x, ax) / np.vdot(x, p.bx(x)) * p.bx(x))
                theta = np.vdot(x, ax) / np.vdot(x, p.bx(x))
                p.tell(it, [theta], [r])
                if p.error(r, theta) < p.tol:
                    break
                try:
                    x = solver_for(combination([(1.0, p.a), (-rho, unit)]))(p.bx(x))
                except np.linalg.LinAlgError:
                    break
                continue
            y = op(x)
            theta = np.vdot(x, y if b is None else b(y))
            r = np.linalg.norm(y - theta * x)
            p.tell(it, [p.transform.eigenvalues(np.array([theta]))[0]], [r])
            x = y
            if p.error(r, theta) < p.tol:
                break
        else:
            return np.array(found), np.stack(vectors, 1) if vectors else np.zeros((p.n, 0)), it, "iterations", True
        x = x / math.sqrt(abs(np.vdot(x, x if b is None else b(x))))
        value = theta if shift != "constant" else p.transform.eigenvalues(np.array([theta]))[0]
        found.append(value)
        vectors.append(x)
        locked = np.hstack([locked, _orthonormal_part(x, locked, b)])
    return np.array(found), np.stack(vectors, 1), it, "tolerance", True


def _orthonormal_part(x: np.ndarray, basis: np.ndarray, b: Callable | None) -> np.ndarray:
    y = orthogonalise(x, basis, b)[0] if basis.shape[1] else x
    return (y / math.sqrt(abs(np.vdot(y, y if b is None else b(y)))))[:, None]


def _subspace(p: Problem):
    """Block power steps with a Rayleigh-Ritz projection each round."""
    op, b = p.transform.operator(p.a, p.b, p.kind == "ghep"), p.inner()
    m = min(p.ncv, p.n)
    x = p.start(m)
    lead = p.locked()
    for it in range(1, p.most * 20 + 1):
        if lead is not None:
            x, _ = orthogonalise(x, lead, b)
        x = _orthonormal(x, b)
        y = op(x)
        t = x.conj().T @ (y if b is None else b(y))
        theta, q = dense.hep(t) if p.hermitian else np.linalg.eig(t)
        at = np.argsort(-np.abs(theta), kind="stable")
        theta, q = theta[at], q[:, at]
        z = x @ q
        residual = np.linalg.norm(y @ q - z * theta, axis=0) / np.maximum(np.linalg.norm(z, axis=0), 1e-300)
        errors = np.array([p.error(r, t) for r, t in zip(residual, theta)])
        nconv = int(np.argmin(np.append(errors < p.tol, False)))
        p.tell(it, p.transform.eigenvalues(theta[: p.nev]), errors[: p.nev])
        if nconv >= p.nev or it == p.most * 20:
            return theta[: max(nconv, 0)], z[:, : max(nconv, 0)], it, "tolerance" if nconv >= p.nev else "iterations", False
        x = y @ (q if not np.iscomplexobj(q) or np.iscomplexobj(x) else np.linalg.qr(np.hstack([q.real, q.imag]))[0][:, :m])
        for _ in range(2):
            x = op(_orthonormal(x, b))


def _orthonormal(x: np.ndarray, b: Callable | None) -> np.ndarray:
    q, _ = np.linalg.qr(x)
    if b is None:
        return q
    l = np.linalg.cholesky(_sym(q.conj().T @ b(q)))
    return np.linalg.solve(l, q.conj().T).conj().T


def _sym(a: np.ndarray) -> np.ndarray:
    return (a + a.conj().T) / 2


def _preconditioner(p: Problem) -> Callable[[np.ndarray], np.ndarray]:
    """About (A - sigma B)^-1: as given, exact for small problems, else its diagonal."""
    if "precondition" in p.options:
        return p.options["precondition"]
    s = p.transform.sigma if p.transform.kind != "shift" or p.transform.sigma != 0 else (p.target if str(p.which).startswith("target") else 0.0)
    unit = p.b if p.b is not None else identity(p.n)
    if p.transform.kind == "precond" and p.n <= DENSE_ROWS or p.options.get("exact"):
        return solver_for(combination([(1.0, p.a), (-s, unit)]))
    d = p.a.diagonal
    if d is None:
        return lambda x: x
    d = d - s * (unit.diagonal if unit.diagonal is not None else 1.0)
    d = np.where(np.abs(d) < 1e-8 * max(np.abs(d).max(initial=1), 1e-300), 1.0, d)
    return lambda x: x / (d if x.ndim == 1 else d[:, None])


def _davidson(p: Problem, correct: str):
    """Generalised and Jacobi-Davidson: the space grows by preconditioned residuals, or by approximate solutions of the
    correction equation. Option ``double`` of the first: by the preconditioned A x and B x, whose span has the residual's and more."""
    b = p.inner()
    pre = _preconditioner(p)
    m, kind = min(max(p.ncv, p.nev + 6), p.n), complex if p.complex or not p.hermitian else float
    block, double = min(max(1, p.options.get("block", 1)), m), bool(p.options.get("double")) and correct == "gd"
    v = _orthonormal(p.start(min(max(p.nev, block), m)).astype(kind), b)
    lead = p.locked()
    for it in range(1, p.most * 10 + 1):
        av, bv = p.a.apply(v), p.bx(v)
        h, g = v.conj().T @ av, v.conj().T @ bv
        if p.hermitian:
            w, y = dense.ghep(_sym(h), _sym(g))
        else:
            w, y = dense.gnhep(h, g)
        at = order(np.where(np.isfinite(w), w, 1e300), p.which, p.target, not p.complex, p.region)
        w, y = w[at], y[:, at] / np.linalg.norm(v @ y[:, at], axis=0)
        x = v @ y
        r = av @ y - (bv @ y) * w
        size = np.linalg.norm(r, axis=0)
        errors = np.array([p.error(s, t) for s, t in zip(size, w)])
        nconv = int(np.argmin(np.append(errors < p.tol, False)))
        p.tell(it, w[: p.nev], errors[: p.nev])
        if (nconv >= p.nev) or it == p.most * 10 or v.shape[1] >= p.n:
            k = nconv if v.shape[1] < p.n else min(p.nev, len(w))
            return w[:k], x[:, :k], it, "tolerance" if k >= p.nev else "iterations", True
        if v.shape[1] + block * (1 + double) > m:
            keep = min(max(p.nev + 2, m // 2), v.shape[1] - 1)
            v = _orthonormal(x[:, :keep].astype(kind), b)
        new = []
        for k in range(nconv, min(nconv + block, len(w))):
            if correct == "jd":
                u, bu = x[:, k], p.bx(x[:, k])
                bu = bu / np.vdot(u, bu).conj()
                project = lambda z, u=u, bu=bu: z - u * np.vdot(bu, z)
                shifted = lambda z, k=k: p.a.apply(z) - w[k] * p.bx(z)
                left = lambda z, u=u, bu=bu: z - bu * np.vdot(u, z)
                t = project(gmres(lambda z: left(shifted(project(z))), -r[:, k].astype(kind), tol=1e-2, restart=min(20, p.n), most=1, precondition=lambda z: project(pre(z)), strict=False))
            else:
                t = pre(r[:, k])
            if double:
                u = pre(p.bx(x[:, k]))
                u = u - t * (np.vdot(t, u) / max(np.vdot(t, t).real, 1e-300))
                new.append(u / max(np.linalg.norm(u), 1e-300))
            new.append(t)
        t = np.stack(new, 1).astype(kind)[:, -(p.n - v.shape[1]) :]
        for _ in range(2):
            t, _ = orthogonalise(t, v, b)
            if lead is not None:
                t, _ = orthogonalise(t, lead, b)
        if np.linalg.norm(t) < 1e-14:
            t = orthogonalise(p.start(block).astype(kind), v, b)[0]
        v = np.hstack([v, t / np.maximum(np.linalg.norm(t, axis=0), 1e-300)])
        v = _orthonormal(v, b) if b is not None else np.linalg.qr(v)[0]


def _lobpcg(p: Problem, conjugate: bool = True):
    """Blocks of vectors, preconditioned residuals and search directions; for smallest values of definite problems."""
    b, pre = p.inner(), _preconditioner(p)
    sign = -1.0 if p.which in ("largest_real", "largest_magnitude") else 1.0
    m = min(max(p.options.get("block", p.nev + min(p.nev, 4)), p.nev), p.n)
    lead = p.locked()
    x = _orthonormal(p.start(m), b)
    d = None
    for it in range(1, p.most * 10 + 1):
        if lead is not None:
            x = _orthonormal(orthogonalise(x, lead, b)[0], b)
        ax = p.a.apply(x)
        w, y = dense.hep(sign * _sym(x.conj().T @ ax))
        x, ax, w = x @ y, ax @ y, sign * w
        r = ax - p.bx(x) * w
        errors = np.array([p.error(s, t) for s, t in zip(np.linalg.norm(r, axis=0), w)])
        nconv = int(np.argmin(np.append(errors < p.tol, False)))
        p.tell(it, w[: p.nev], errors[: p.nev])
        if nconv >= p.nev or it == p.most * 10:
            return w[:nconv], x[:, :nconv], it, "tolerance" if nconv >= p.nev else "iterations", True
        soft = errors >= p.tol * 0.1
        z = pre(r[:, soft])
        parts = [x, z] if d is None or not conjugate else [x, z, d]
        s = np.hstack(parts)
        if lead is not None:
            s, _ = orthogonalise(s, lead, b)
        q, t, _ = np.linalg.svd(s / np.maximum(np.linalg.norm(s, axis=0), 1e-300), full_matrices=False)
        q = _orthonormal(q[:, t > 1e-10 * t[0]], b)
        _, y = dense.hep(sign * _sym(q.conj().T @ p.a.apply(q)))
        new = q @ y[:, :m]
        d = new - x @ (x.conj().T @ p.bx(new))
        d = d[:, np.linalg.norm(d, axis=0) > 1e-12]
        d = None if d.shape[1] == 0 else d
        x = new


def contour_nodes(region: Region, count: int, rule: str, real: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, bool]:
    z, zn, w = region.quadrature(count, rule)
    half = region.can_use_conjugates(real) and rule == "trapezoidal" and count % 2 == 0
    return (z[: count // 2], zn[: count // 2], w[: count // 2], True) if half else (z, zn, w, False)


def ghosts(x: np.ndarray, sigma: np.ndarray, threshold: float = 1e-6) -> np.ndarray:
    """Which columns of x weigh on small singular values only."""
    s2 = (np.abs(x) ** 2).sum(0)
    tau = s2 / np.maximum((np.abs(x) ** 2 / sigma[:, None]).sum(0), 1e-300)
    return tau < threshold * tau.max(initial=0)


def contour(n: int, resolve: Callable[[complex, np.ndarray], np.ndarray], project: Callable, region: Region, real: bool, nodes: int = 32, block: int = 8, moments: int = 8, rule: str = "trapezoidal", extraction: str = "ritz", delta: float = 1e-12, seed: int = 0, hankel_product: Callable | None = None):
    """Eigenvalues inside a region from moments of the resolvent: S_k = sum w z^k T(z)^-1 V. Each node's solves are
    independent of the others'. ``project``(Q) solves the projected problem in the space Q."""
    v = np.sign(np.random.default_rng(seed).standard_normal((n, block)))
    z, zn, w, half = contour_nodes(region, nodes, rule, real)
    s = np.zeros((n, block * moments), complex)
    for node, unit, weight in zip(z, zn, w):
        y = resolve(node, v.astype(complex))
        for k in range(moments):
            part = weight * unit**k * y
            s[:, k * block : (k + 1) * block] += 2 * part.real if half else part
    q, sigma, rank = svd_and_rank(s, delta, "qr")
    if extraction == "hankel":
        mu = np.zeros((2 * moments, block, block), complex)
        for node, unit, weight in zip(z, zn, w):
            y = v.T @ resolve(node, v.astype(complex))
            for k in range(2 * moments):
                mu[k] += (2 * (weight * unit**k * y).real) if half else weight * unit**k * y
        h0 = np.block([[mu[i + j] for j in range(moments)] for i in range(moments)])
        h1 = np.block([[mu[i + j + 1] for j in range(moments)] for i in range(moments)])
        u, sg, vh = np.linalg.svd(h0)
        r = int((sg > delta * sg[0]).sum())
        theta, y = np.linalg.eig((u[:, :r].conj().T @ h1 @ vh[:r].conj().T) / sg[:r, None])
        scale, centre = _circle(region)
        return centre + scale * theta, s @ (vh[:r].conj().T @ y), sg[:r]
    w2, x = project(q[:, :rank])
    return w2, q[:, :rank] @ x, sigma[:rank]


def _circle(region: Region) -> tuple[float, complex]:
    a, b, c, d = region.box()
    return (b - a) / 2, complex((a + b) / 2, 0 if not math.isfinite(c) else (c + d) / 2)


def _ciss(p: Problem):
    if p.region is None or p.region.trivial():
        raise ValueError("the contour solver needs a region")
    unit = p.b if p.b is not None else identity(p.n)
    solve = lambda z, v: solver_for(combination([(z, unit), (-1.0, p.a)]))(unit.apply(v))
    project = lambda q: dense.gnhep(q.conj().T @ p.a.apply(q), q.conj().T @ unit.apply(q))
    o = {k: p.options[k] for k in ("nodes", "block", "moments", "rule", "extraction", "delta") if k in p.options}
    w, x, _ = contour(p.n, solve, project, p.region, not p.complex, **o)
    inside = p.region.inside(w) >= 0
    w, x = w[inside], x[:, inside]
    r = np.linalg.norm(p.a.apply(x) - unit.apply(x) * w, axis=0) / np.maximum(np.linalg.norm(x, axis=0), 1e-300)
    good = np.array([p.error(s, t) < max(p.tol, 1e-6) for s, t in zip(r, w)], bool)
    if p.hermitian:
        w = w.real
    return w[good], x[:, good], 1, "tolerance", True


def _slice(p: Problem):
    """All eigenvalues in an interval, split until each part is small; the inertias at the ends say how many there are."""
    lo, hi = p.region.a, p.region.b
    if p.n > DENSE_ROWS:
        return _slice_filtered(p)
    a, b = p.a.dense(), np.eye(p.n) if p.b is None else p.b.dense()
    count = lambda s: dense.inertia(a - s * b)[0]
    values, vectors, its = [], [], 0
    todo = [(lo, hi, count(lo - 1e-12 * max(abs(lo), 1)), count(hi + 1e-12 * max(abs(hi), 1)))]
    while todo:
        x, y, below, upto = todo.pop()
        want = upto - below
        if want == 0:
            continue
        if want > p.options.get("part", 20) and y - x > 1e-8 * max(abs(x), abs(y)):
            mid = (x + y) / 2
            at = count(mid)
            todo += [(mid, y, at, upto), (x, mid, below, at)]
            continue
        sub = Problem(p.a, p.b, p.kind, want, min(2 * want + 20, p.n), p.tol, p.most, "target_magnitude", (x + y) / 2, Transform("sinvert", (x + y) / 2 + 1.234e-7 * (y - x)), None, p.convergence, None, [], None, None, p.rng, {})
        theta, z, it, _, _ = _krylovschur(sub)
        w = sub.transform.eigenvalues(theta).real
        its += it
        keep = np.flatnonzero((w >= x - 1e-9 * max(abs(x), 1)) & (w <= y + 1e-9 * max(abs(y), 1)))
        keep = keep[np.argsort(np.abs(w[keep] - (x + y) / 2))][:want]
        if len(keep) < want:  # copies that one start vector cannot see
            w, z = dense.ghep(_sym(a), _sym(b))
            keep = np.flatnonzero((w >= x) & (w <= y))[:want]
        values += w[keep].tolist()
        vectors += [z[:, k] for k in keep]
    return np.array(values), np.stack(vectors, 1) if vectors else np.zeros((p.n, 0)), its, "tolerance", True


def _slice_filtered(p: Problem):
    """The interval of a matrix that is not gathered: cut in halves until a part is expected to hold few values, each part by filtered
    blocks. What two parts both found at their common end counts once."""
    if p.b is not None:
        raise ValueError("spectrum slicing of a pair needs the dense form")
    lo, hi = p.region.a, p.region.b
    span = spectral_range(p.a)
    kind = complex if p.complex else float
    todo, values, vectors, its = [(max(lo, span[0]), min(hi, span[1]))], np.zeros(0), np.zeros((p.n, 0), kind), 0
    while todo:
        x, y = todo.pop()
        if x > y:
            continue
        # the filter is steep enough that little of it lies outside: its width is a few times the span over the degree
        degree = int(min(max(40, 2 * (span[1] - span[0]) / max(y - x, 1e-300)), 2000))
        filtered = Transform("filter", interval=(x, y), span=span, degree=degree)
        expected = stochastic_count(filtered.operator(p.a, None), p.n, kind)
        if expected > p.options.get("part", 60) and y - x > 1e-6 * (span[1] - span[0]):
            todo += [((x + y) / 2, y), (x, (x + y) / 2)]
            continue
        sub = Problem(p.a, None, "hep", 1, 1, p.tol, p.most, "all", 0, filtered, None, p.convergence, None, p.monitor, vectors if vectors.shape[1] else None, None, p.rng, {"expected": max(expected, 1e-9)})
        w, z, it, _, _ = _filtered(sub)
        values, vectors, its = np.concatenate([values, w]), np.hstack([vectors, z]), its + it
    return values, vectors, its, "tolerance", True


def _rqcg(p: Problem):
    return processes.rqcg(p, _preconditioner(p), p.options.get("reset", 20))


def _arnoldi(p: Problem):
    """Explicitly restarted; option ``delayed`` for the second pass of Gram-Schmidt a step later."""
    return processes.explicit(p, lambda op, x, m, **o: processes.arnoldi_process(op, x, m, p.options.get("delayed", False), **o), False)


def _lanczos(p: Problem):
    """Explicitly restarted; option ``reorthogonalise`` as in ``processes.lanczos_process``."""
    if not p.hermitian:
        raise ValueError("Lanczos is for Hermitian problems")
    return processes.explicit(p, lambda op, x, m, **o: processes.lanczos_process(op, x, m, p.options.get("reorthogonalise", "local"), **o), True)


def _lyapii(p: Problem):
    """Rightmost eigenvalues by inverse iteration with Lyapunov equations on the shifted inverse."""
    a = p.a.dense() if p.b is None else np.linalg.solve(p.b.dense(), p.a.dense())
    n = len(a)
    v = p.start()[:, 0]
    v /= np.linalg.norm(v)
    for it in range(1, p.most + 1):
        s = np.linalg.inv(a)
        x = dense.lyapunov(a, np.outer(s @ v, (s @ v).conj()))
        w, q = dense.hep(x if np.abs(w_ := np.linalg.eigvalsh(_sym(x))).max() == w_.max() else -x)
        basis = q[:, -min(n, max(2, p.nev + 2)) :]
        theta, y = np.linalg.eig(basis.conj().T @ a @ basis)
        at = order(theta, "largest_real", real=not p.complex)
        theta, z = theta[at], basis @ y[:, at]
        r = np.linalg.norm(a @ z - z * theta, axis=0)
        k = int(np.argmin(np.append(r[: p.nev] < 1e-6 * max(1, np.abs(theta).max()), False)))
        p.tell(it, theta[: p.nev], r[: p.nev])
        if k >= p.nev or it > 8:
            break
        v = z[:, 0].real + z[:, 0].imag
        v /= np.linalg.norm(v)
    # the space found starts a Krylov solve about the value found
    sub = Problem(p.a, p.b, p.kind, p.nev, p.ncv, p.tol, p.most, "largest_real", 0, Transform(), None, p.convergence, None, [], None, v, p.rng, {})
    return _krylovschur(sub)


def _bse(p: Problem):
    """H = [R C; -C^H -R^T] with its structure: (R + C)(R - C) for real blocks, values in pairs +-w."""
    h = p.a.dense()
    n = p.n // 2
    r, c = h[:n, :n], h[:n, n:]
    if not np.iscomplexobj(h) or np.abs(h.imag).max() == 0:
        r, c = r.real, c.real
        l = np.linalg.cholesky(_sym(r - c))
        w2, y = dense.hep(l.T @ (r + c) @ l)  # (R-C)(R+C) u = w^2 u
        w = np.sqrt(np.maximum(w2, 0))
        u = l @ y / np.sqrt(np.maximum(w, 1e-300))
        t = (r + c) @ u / np.maximum(w, 1e-300)
        x = np.vstack([(u + t) / 2, (u - t) / 2])  # x + y = u, x - y = (R + C) u / w
        other = np.vstack([x[n:], x[:n]])
        return np.concatenate([w, -w]), np.hstack([x, other]), 1, "tolerance", True
    w, x = np.linalg.eig(h)
    return w, x, 1, "tolerance", True


class _Measure:
    """A problem's measure of residuals, and its tolerance."""

    def __init__(self, p: Problem):
        self.p, self.tol = p, p.tol

    def __call__(self, residual: float, value: complex) -> float:
        return self.p.error(residual, value)


def _indefinite(p: Problem):
    """A Hermitian pair with an indefinite B: the basis is orthogonal in the form of B (pseudo-Lanczos), whose signs the projected
    problem keeps; the values are real or come in conjugate pairs. The shift has to be real."""
    if complex(p.transform.sigma).imag != 0 or p.transform.kind not in ("shift", "sinvert"):
        raise ValueError("indefinite problems take a real shift, plain or inverted")
    op = p.transform.operator(p.a, p.b, p.kind == "ghep")
    start = op(p.start()[:, 0].astype(complex if p.complex else float))
    space = spaces.Plain(op, start, min(p.ncv, p.n), p.bx)
    tell = lambda it, theta, e: p.tell(it, p.transform.eigenvalues(theta), e)
    return *spaces.restarted(space, p.nev, p.wanted, _Measure(p), p.stop, tell, not p.complex, p.options.get("keep", 0.5)), False


def _both_sides(p: Problem, power: bool = False):
    """Right and left vectors of one process; the left ones are kept in the options."""
    op, back = p.transform.operator(p.a, p.b, p.kind == "ghep"), p.transform.adjoint(p.a, p.b)
    kind = complex if p.complex else float
    x = p.start(p.nev if power else 1).astype(kind)
    tell = lambda it, theta, e: p.tell(it, p.transform.eigenvalues(np.asarray(theta)), e)
    if power:
        theta, v, w, it, why = spaces.two_sided_power(op, back, x, x, p.nev, p.most * 20, _Measure(p), tell)
    else:
        theta, v, w, it, why = spaces.two_sided(op, back, x[:, 0], x[:, 0], min(p.ncv, p.n), p.nev, p.wanted, _Measure(p), p.stop, tell, kind is float, p.options.get("keep", 0.5))
    if p.b is not None:  # y^H B^-1 A = k y^H for the plain shift, y^H (A - s B)^-1 B for the inverse: B^-H, or the adjoint solve, gives the pair's own
        adjoint = processes.adjoint(p.b) if p.transform.kind == "shift" else combination([(1.0, processes.adjoint(p.a)), (-np.conj(p.transform._number(p.transform.sigma)), processes.adjoint(p.b))])
        w = solver_for(adjoint)(w)
    p.options["left"] = (theta, w)
    return theta, v, it, why, False


def stochastic_count(apply: Callable, n: int, kind: type, samples: int = 12, seed: int = 3) -> float:
    """The trace of an operator by random signs: for a filter, about how many eigenvalues its interval has."""
    z = np.sign(np.random.default_rng(seed).standard_normal((n, samples))).astype(kind)
    return float(np.real(np.einsum("ij,ij->", z.conj(), apply(z))) / samples)


def _filtered(p: Problem):
    """All eigenvalues in the transformation's interval: blocks of vectors are filtered, made orthonormal and projected, with as many
    columns as the filter's trace says and some more. It ends when all Ritz values inside have settled, the block also holds some from
    outside, and a fresh block in the complement of what was found has nothing inside."""
    apply = p.transform.operator(p.a, None)
    lo, hi = p.transform.interval
    kind = complex if p.complex else float
    locked = np.zeros((p.n, 0), kind) if p.deflation is None else p.locked().astype(kind)
    values, vectors, its = [], [], 0
    expected = p.options.get("expected") or stochastic_count(apply, p.n, kind)
    while True:
        room = p.n - locked.shape[1]
        m = min(room, int(math.ceil(1.3 * max(expected, 0))) + 8)
        if m <= 0:
            break
        v = p.rng.standard_normal((p.n, m)).astype(kind)
        before, calm = -1, 0
        while True:
            its += 1
            v = v if not locked.shape[1] else orthogonalise(v, locked)[0]
            v = apply(np.linalg.qr(v)[0])
            v = v if not locked.shape[1] else orthogonalise(v, locked)[0]
            v, _ = np.linalg.qr(v)
            av = p.a.apply(v)
            w, y = dense.hep(_sym(v.conj().T @ av))
            v, av = v @ y, av @ y
            r = np.linalg.norm(av - v * w, axis=0)
            slack = 1e-9 * max(abs(lo), abs(hi), 1e-300)
            inside = (w >= lo - slack) & (w <= hi + slack)
            errors = np.array([p.error(s, t) for s, t in zip(r, w)])
            p.tell(its, w[inside], errors[inside])
            open_ = ~inside & (w >= lo - r) & (w <= hi + r) & (r < 0.02 * (hi - lo))  # may yet turn out to lie inside
            if inside.sum() > m - 3 and m < room:  # no room for all there may be
                fresh = p.rng.standard_normal((p.n, min(room, 2 * m) - m)).astype(kind)
                v, m = np.hstack([v, fresh]), min(room, 2 * m)
                continue
            calm = calm + 1 if inside.sum() == before else 0
            before = inside.sum()
            if (errors[inside] < p.tol).all() and (m == room or calm >= 2 and (not open_.any() or calm >= 12)):
                break
            if its >= 10 * p.most:
                return np.concatenate([values, w[inside]]), np.hstack([*vectors, v[:, inside]]), its, "iterations", True
        if not inside.any():
            break
        values = np.concatenate([values, w[inside]])
        vectors.append(v[:, inside])
        locked, _ = np.linalg.qr(np.hstack([locked, v[:, inside]]))
        expected = 0
    return np.asarray(values), np.hstack(vectors) if vectors else np.zeros((p.n, 0)), its, "tolerance", True


SOLVERS: dict[str, Callable[[Problem], tuple]] = {
    "krylovschur": lambda p: _krylovschur(p, p.options.get("keep", 0.5), harmonic=str(p.options.get("extraction", "ritz")).startswith("harmonic")),
    "arnoldi": _arnoldi, "lanczos": _lanczos, "power": _power, "subspace": _subspace,
    "gd": lambda p: _davidson(p, "gd"), "jd": lambda p: _davidson(p, "jd"), "lobpcg": _lobpcg, "rqcg": _rqcg, "ciss": _ciss, "lyapii": _lyapii, "lapack": _lapack,
}
#: Names of solvers of other libraries, and what answers for them here.
ALIASES = {"elemental": "lapack", "scalapack": "lapack", "elpa": "lapack", "arpack": "krylovschur", "trlan": "krylovschur", "primme": "gd", "blopex": "lobpcg", "feast": "ciss", "evsl": "slice"}


def register(name: str, solver: Callable[[Problem], tuple]) -> None:
    SOLVERS[name] = solver


def seems_hermitian(a: Operator, seed: int = 7) -> bool:
    """Whether <x, A y> = <A x, y>: known from the entries where there are any, else tried on random vectors."""
    if a.symmetric is not None:
        return a.symmetric()
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((a.n, 2)) + (1j * rng.standard_normal((a.n, 2)) if a.complex else 0)
    y = a.apply(x)
    left, right = np.vdot(x[:, 0], y[:, 1]), np.vdot(y[:, 0], x[:, 1])
    return bool(abs(left - right) <= 1e-10 * np.linalg.norm(x[:, 0]) * np.linalg.norm(y))


def infer(a: Operator, b: Operator | None, hermitian: bool | None) -> str:
    """The problem's type, whatever the size: Hermitian if A is, and B definite by the bounds of a few Lanczos steps."""
    if hermitian is None:
        if a.n <= DENSE_ROWS:
            x = a.dense()
            hermitian = bool(np.allclose(x, x.conj().T, rtol=0, atol=1e-13 * max(np.abs(x).max(initial=0), 1e-300)))
            if hermitian and b is not None:
                y = b.dense()
                hermitian = bool(np.allclose(y, y.conj().T) and np.linalg.eigvalsh(_sym(y))[0] > 0)
        else:
            hermitian = seems_hermitian(a) and (b is None or seems_hermitian(b) and smallest_ritz(b) > 0)
    return ("hep" if hermitian else "nhep") if b is None else ("ghep" if hermitian else "gnhep")


def smallest_ritz(b: Operator, steps: int = 40, seed: int = 0) -> float:
    """The smallest Ritz value of a few Lanczos steps, an upper bound on the smallest eigenvalue."""
    m = min(steps, b.n)
    v, h = np.zeros((b.n, m + 1), complex if b.complex else float), np.zeros((m + 1, m), complex if b.complex else float)
    v[:, 0] = np.random.default_rng(seed).standard_normal(b.n)
    v[:, 0] /= np.linalg.norm(v[:, 0])
    j, _, _ = arnoldi(b.apply, v, h, 0, m)
    return float(np.linalg.eigvalsh(_sym(h[:j, :j]))[0])


def eigs(
    A, B=None, nev: int = 1, which: str | Callable = "largest_magnitude", target: complex | None = None, problem: str | None = None, solver: str = "krylovschur", ncv: int | None = None, mpd: int | None = None,
    tol: float = 1e-8, max_it: int | None = None, transform: Transform | str | None = None, sigma: complex | None = None, region: Region | None = None, interval: tuple[float, float] | None = None, convergence: str | Callable = "relative",
    stopping: Callable | None = None, monitor: Callable | list | None = None, deflation: np.ndarray | None = None, initial: np.ndarray | None = None, selection: Callable | None = None, two_sided: bool = False, seed: int = 0, **options,
) -> EigenResult:
    """Some eigenpairs. The parameters, where they are not given, are inferred as follows: the problem from the matrices; the order from
    ``target``; ``ncv`` max(2 nev, nev + 15), twice that for left vectors too; ``max_it`` max(100, 2 n / ncv)."""
    a, b = as_operator(A), None if B is None else as_operator(B)
    kind = problem or infer(a, b, options.pop("hermitian", None))
    if kind not in PROBLEMS:
        raise ValueError(f"no such problem: {kind}")
    if b is None and kind in ("ghep", "gnhep", "pgnhep", "ghiep"):
        kind = "hep" if kind == "ghep" else "nhep"
    if target is not None and which == "largest_magnitude":
        which = "target_magnitude"
    if isinstance(transform, str):
        transform = Transform(transform, target if sigma is None and target is not None else sigma or 0.0, interval=interval, **{k: options.pop(k) for k in ("nu", "degree", "span") if k in options})
    transform = transform or Transform(sigma=0.0)
    name = ALIASES.get(solver, solver)
    if interval is not None and region is None:
        region = Interval(a=interval[0], b=interval[1])
    if kind == "bse" and name == "krylovschur":
        run: Callable = processes.bse_product if options.get("bse", "shao" if a.n <= DENSE_ROWS else "gruning") == "gruning" else _bse
    elif name == "slice" or (interval is not None and which == "all" and transform.kind != "filter" and name == "krylovschur"):
        run = _slice
        kind = "hep" if b is None else "ghep"
    elif transform.kind == "filter" and name == "krylovschur" and options.get("all_in_interval", True):
        run = _filtered
        if kind != "hep":
            raise ValueError("the filter is for standard Hermitian problems")
    elif kind == "ghiep" and name == "krylovschur":
        run = _indefinite
    elif two_sided and name in ("krylovschur", "power") and transform.kind in ("shift", "sinvert") and deflation is None and not options.get("balance"):
        run = lambda p: _both_sides(p, name == "power")
    elif name in SOLVERS:
        run = SOLVERS[name]
    else:
        raise ValueError(f"no such solver: {solver}")
    n = a.n
    nev = min(nev, n)
    ncv = min(ncv or (max(2 * nev, nev + 15) if nev < 500 else nev + (mpd or 500)) * (2 if two_sided else 1), n)
    p = Problem(
        a, b, kind, nev, ncv, tol, max_it or max(100, 2 * n // max(ncv, 1)), which, 0.0 if target is None else target, transform, region, convergence, stopping,
        [] if monitor is None else monitor if isinstance(monitor, list) else [monitor], deflation, initial, np.random.default_rng(seed), options,
    )
    if options.get("balance"):
        p.a, back = balanced(p.a, b)
    else:
        back = None
    theta, x, its, reason, direct = run(p)
    both = options.pop("left", None)
    if both is None and kind in ("hep", "ghep") and not direct and name in ("krylovschur", "arnoldi", "lanczos") and transform.kind != "filter" and options.get("copies", True):
        theta, x, its = with_copies(p, run, theta, x, its)
    if transform.kind == "filter" and not direct or transform.kind == "shell" and transform.back is None:
        x = x / np.linalg.norm(x, axis=0)
        w, y = dense.hep(_sym(x.conj().T @ a.apply(x))) if x.shape[1] and np.linalg.matrix_rank(x) == x.shape[1] else (np.zeros(0), np.zeros((0, 0)))
        if x.shape[1] and len(w):
            q, _ = np.linalg.qr(x)
            w, y = dense.hep(_sym(q.conj().T @ a.apply(q)))
            x = q @ y
        values = w
        if interval is not None and len(values):
            keep = (values >= interval[0]) & (values <= interval[1])
            values, x = values[keep], x[:, keep]
    else:
        values = np.asarray(theta) if direct else transform.eigenvalues(theta)
    if back is not None:
        x = back[:, None] * x
        p.a = a
    if kind in ("hep", "ghep") and len(values):
        values = values.real
    at = order(np.where(np.isfinite(values), values, 1e300), which, p.target, not p.complex, region) if len(values) else np.zeros(0, int)
    if which == "all" and kind in ("hep", "ghep"):
        at = np.argsort(values, kind="stable")
    if selection is not None and len(values):
        at = np.array(sorted(range(len(values)), key=lambda i: selection(values[i], x[:, i])))
    if direct and which != "all" and name not in ("ciss",):
        at = at[:nev]
    if not p.complex:  # a pair of conjugates is not parted
        at = at[: max(nev, 1) + (1 if which != "all" and len(at) > nev >= 1 and abs(np.imag(values[at[nev - 1]])) > 1e-10 and abs(values[at[nev - 1]] - np.conj(values[at[nev]])) < 1e-6 * abs(values[at[nev]]) else 0)] if which != "all" and name != "ciss" and transform.kind != "filter" else at
    values, x = values[at], x[:, at] if x.size else x
    x = x / np.maximum(np.linalg.norm(x, axis=0), 1e-300) if p.inner() is None else x / np.sqrt(np.abs(np.einsum("ij,ij->j", x.conj(), p.inner()(x))))
    errors = residuals(a, b, values, x, "relative")
    out = EigenResult(values, x, errors, solver, its, reason, None, p.history, not p.complex)
    out.settings = {"problem": kind, "nev": nev, "ncv": p.ncv, "tolerance": tol, "largest number of iterations": p.most, "which": which, "target": p.target, "transformation": transform.kind, "shift": transform.sigma, "convergence": convergence}
    if both is not None:
        found = transform.eigenvalues(both[0])
        y = both[1][:, [int(np.abs(found - v).argmin()) for v in values]]
        out.left = y / np.conj(np.einsum("ij,ij->j", y.conj(), p.bx(x)))
    elif two_sided:
        out.left = left_vectors(a, b, values, x)
    return out


def with_copies(p: Problem, run: Callable, theta: np.ndarray, x: np.ndarray, its: int) -> tuple[np.ndarray, np.ndarray, int]:
    """A Krylov space sees one copy of a multiple eigenvalue. The solve is repeated in the complement of what was found, until
    that has nothing that comes before the last value wanted."""
    given = p.deflation
    while len(theta) and x.shape[1] + (0 if given is None else np.atleast_2d(given.T).T.shape[1]) < p.n:
        p.deflation = x if given is None else np.hstack([np.atleast_2d(given.T).T, x])
        vars(p).pop("_locked", None)
        more, y, it, _, _ = run(p)
        its += it
        if not len(more):
            break
        every, z = np.concatenate([theta, more]), np.hstack([x, y])
        at = p.wanted(every)
        new = set(at[: p.nev].tolist()) - set(range(len(theta)))
        close = [len(theta) + k for k in range(len(more)) if len(theta) + k in new]
        if not close:
            break
        keep = list(range(len(theta))) + close
        theta, x = every[keep], z[:, keep]
    p.deflation = given
    vars(p).pop("_locked", None)
    return theta, x, its


def residuals(a: Operator, b: Operator | None, values: np.ndarray, x: np.ndarray, kind: str = "relative") -> np.ndarray:
    """||A x - k B x|| by column: absolute, over |k| ||x|| (relative), or over the matrices' norms (backward)."""
    if not len(values):
        return np.zeros(0)
    finite = np.where(np.isfinite(values), values, 0)
    bx = x if b is None else b.apply(x)
    r = np.linalg.norm(a.apply(x) - bx * finite, axis=0) / np.maximum(np.linalg.norm(x, axis=0), 1e-300)
    if kind == "absolute":
        return r
    if kind == "backward":
        return r / ((a.norm or 1.0) + np.abs(finite) * ((b.norm or 1.0) if b is not None else 1.0))
    return np.where(np.abs(finite) > 0, r / np.where(np.abs(finite) > 0, np.abs(finite), 1), r)


def left_vectors(a: Operator, b: Operator | None, values: np.ndarray, x: np.ndarray) -> np.ndarray:
    """y with y^H A = k y^H B, scaled to y^H B x = 1 in size: by inverse iteration with the adjoint, or, beyond the dense form, by a
    Krylov space of the adjoint, matched by values."""
    if a.n > DENSE_ROWS and b is None:
        sub = eigs(processes.adjoint(a), nev=len(values) + 2, which=lambda z: -np.abs(z), problem="nhep", ncv=max(40, 4 * len(values)))
        y = sub.vectors[:, [int(np.abs(sub.values.conj() - v).argmin()) for v in values]]
        return y / np.conj(np.einsum("ij,ij->j", y.conj(), x))
    out = np.zeros(x.shape, complex)
    unit = b if b is not None else identity(a.n)
    rng = np.random.default_rng(1)
    for k, v in enumerate(values):
        s = v * (1 + 1e-9) + 1e-12
        shifted = Operator(a.n, lambda z, s=s: a.adjoint(z) - np.conj(s) * unit.adjoint(z), None, None, True, None)
        solve = solver_for(shifted)
        y = rng.standard_normal(a.n) + 0j
        for _ in range(4):
            y = solve(unit.adjoint(y))
            y /= np.linalg.norm(y)
        out[:, k] = y / np.conj(np.vdot(y, unit.apply(x[:, k])))
    return out if np.abs(out.imag).max(initial=0) > 1e-8 * np.abs(out).max(initial=1) else out.real


def two_sided_lanczos(a: Operator, m: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Right and left bases with W^H V diagonal, and W^H A V."""
    rng = np.random.default_rng(seed)
    v, w = np.zeros((a.n, m), complex), np.zeros((a.n, m), complex)
    v[:, 0] = rng.standard_normal(a.n)
    w[:, 0] = v[:, 0]
    for j in range(m):
        if j:
            v[:, j], w[:, j] = a.apply(v[:, j - 1]), a.adjoint(w[:, j - 1])
        if biorthogonalise(v, w, j) < 1e-13:
            v, w = v[:, :j], w[:, :j]
            break
    return v, w, w.conj().T @ a.apply(v)


def balanced(a: Operator, b: Operator | None, steps: int = 5, seed: int = 0) -> tuple[Operator, np.ndarray]:
    """D^-1 A D with row and column norms estimated from random signs, and D."""
    d, rng = np.ones(a.n), np.random.default_rng(seed)
    for _ in range(steps):
        z = np.sign(rng.standard_normal(a.n))
        row, col = np.abs(a.apply(d * z) / d), np.abs(a.adjoint(z / d) * d)
        good = (row > 1e-12) & (col > 1e-12)
        d = np.where(good, d * np.sqrt(np.where(good, row / np.where(col == 0, 1, col), 1)), d)
    d = np.exp2(np.round(np.log2(d)))
    scale = lambda x: d if x.ndim == 1 else d[:, None]
    return Operator(a.n, lambda x: a.apply(scale(x) * x) / scale(x), lambda x: a.adjoint(x / scale(x)) * scale(x), None, a.complex, a.diagonal, None), d
