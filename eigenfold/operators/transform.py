"""Spectral transformations: the operator that a solver sees, and the way back to eigenvalues."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..matrix import DENSE_ROWS, NotConverged, Operator


#: A solve that ends with a larger relative residual than this, and than a thousand tolerances, is no solution.
UNSOLVED = 1e-7


def _accept(residual: float, tol: float, name: str) -> None:
    if not residual <= max(UNSOLVED, 1000 * tol):
        raise NotConverged(f"{name} ended with a relative residual of {residual:.1e}")


def gmres(op: Callable, b: np.ndarray, tol: float = 1e-12, restart: int = 60, most: int = 40, precondition: Callable | None = None, strict: bool = True) -> np.ndarray:
    """Solves op(x) = b; ``precondition`` is applied on the right. A solve that ends above the tolerance raises, unless it is not ``strict``, for
    corrections of which a few steps are enough."""
    m = precondition or (lambda y: y)
    x, size = np.zeros_like(b, dtype=np.result_type(b, float)), np.linalg.norm(b)
    if size == 0:
        return x
    best = np.inf
    for _ in range(most):
        r = b - op(x)
        beta = np.linalg.norm(r)
        if beta <= tol * size or beta > 0.999 * best:  # solved, or as far as rounding goes
            break
        best = beta
        v = np.zeros((len(b), restart + 1), np.result_type(r, op(r)) if restart else r.dtype)
        v[:, 0] = r / beta
        h = np.zeros((restart + 1, restart), v.dtype)
        turns, g = [], np.zeros(restart + 1, v.dtype)
        g[0] = beta
        for j in range(restart):
            w = op(m(v[:, j]))
            for _ in range(2):
                c = v[:, : j + 1].conj().T @ w
                h[: j + 1, j] += c
                w = w - v[:, : j + 1] @ c
            h[j + 1, j] = size_w = np.linalg.norm(w)
            if size_w > 0:
                v[:, j + 1] = w / size_w
            for i, (cos, sin) in enumerate(turns):  # rotations that keep h triangular
                h[i, j], h[i + 1, j] = cos * h[i, j] + sin * h[i + 1, j], -np.conj(sin) * h[i, j] + cos * h[i + 1, j]
            length = np.hypot(abs(h[j, j]), abs(h[j + 1, j]))
            if length == 0:
                break
            phase = h[j, j] / abs(h[j, j]) if h[j, j] != 0 else 1.0
            cos, sin = abs(h[j, j]) / length, phase * np.conj(h[j + 1, j]) / length
            turns.append((cos, sin))
            h[j, j], h[j + 1, j] = phase * length, 0
            g[j], g[j + 1] = cos * g[j], -np.conj(sin) * g[j]
            if abs(g[j + 1]) <= tol * size or size_w <= 1e-14 * beta:
                break
        k = len(turns)
        if k == 0:
            break
        x = x + m(v[:, :k] @ np.linalg.solve(h[:k, :k], g[:k]))
    if strict:
        _accept(float(np.linalg.norm(b - op(x)) / size), tol, "GMRES")
    return x


def conjugate_gradient(op: Callable, b: np.ndarray, tol: float = 1e-12, most: int = 1000, precondition: Callable | None = None, strict: bool = True) -> np.ndarray:
    """Solves op(x) = b for a positive definite op; a direction that shows another raises, and so does, if ``strict``, an end above the tolerance."""
    m = precondition or (lambda y: y)
    x, r = np.zeros_like(b), b.copy()
    z = m(r)
    p, rz, size = z, np.vdot(r, z), np.linalg.norm(b)
    for _ in range(most):
        if np.linalg.norm(r) <= tol * size:
            break
        ap = op(p)
        curve = np.vdot(p, ap).real
        if curve <= 0:
            if np.linalg.norm(r) <= UNSOLVED * size:  # rounding at the end of a solve
                break
            raise NotConverged("conjugate gradients met a direction in which the matrix is not positive")
        a = rz / curve
        x, r = x + a * p, r - a * ap
        z = m(r)
        rz, old = np.vdot(r, z), rz
        p = z + rz / old * p
    if strict and size > 0:
        _accept(float(np.linalg.norm(b - op(x)) / size), tol, "conjugate gradients")
    return x


def solver_for(op: Operator, positive: bool = False) -> Callable[[np.ndarray], np.ndarray]:
    """x -> op^-1 x: a dense inverse up to DENSE_ROWS rows, iterations preconditioned by the diagonal beyond."""
    if op.n <= DENSE_ROWS:
        a = op.dense()
        inverse = np.linalg.inv(a)

        def solve(b: np.ndarray) -> np.ndarray:
            x = inverse @ b
            return x + inverse @ (b - a @ x)  # one step of refinement

        return solve
    d = op.diagonal
    pre = (lambda y: y / np.where(d == 0, 1, d)) if d is not None else None
    one = (lambda b: conjugate_gradient(op.apply, b, precondition=pre)) if positive else (lambda b: gmres(op.apply, b, precondition=pre))
    return lambda b: one(b) if b.ndim == 1 else np.stack([one(c) for c in b.T], 1)


def combination(terms: list[tuple[complex, Operator]]) -> Operator:
    """sum of c A as an operator."""
    ops = [o for _, o in terms]
    diag = None if any(o.diagonal is None for o in ops) else sum(c * o.diagonal for c, o in terms)
    cplx = any(o.complex or isinstance(c, complex) and c.imag != 0 for c, o in terms)
    return Operator(ops[0].n, lambda x: sum(c * o.apply(x) for c, o in terms if c != 0), lambda x: sum(np.conj(c) * o.adjoint(x) for c, o in terms if c != 0), None, cplx, diag)


def identity(n: int) -> Operator:
    return Operator(n, lambda x: x, lambda x: x, None, False, np.ones(n), 1.0)


@dataclass
class Transform:
    """kind: "shift" (B^-1 A - sigma), "sinvert" ((A - sigma B)^-1 B), "cayley" ((A - sigma B)^-1 (A + nu B)), "filter" (a polynomial
    that is large in ``interval``), "precond" (no operator, only a preconditioner), "shell" (``apply`` and ``back`` given)."""

    kind: str = "shift"
    sigma: complex = 0.0
    nu: complex | None = None
    interval: tuple[float, float] | None = None
    span: tuple[float, float] | None = None
    degree: int = 60
    apply: Callable | None = None
    back: Callable | None = None
    injective: bool = True

    def operator(self, a: Operator, b: Operator | None, positive: bool = False) -> Callable[[np.ndarray], np.ndarray]:
        """``positive``: B is definite, so that conjugate gradients solve with it beyond the dense form."""
        unit = b if b is not None else identity(a.n)
        s = self._number(self.sigma)
        if self.kind == "shift":
            solve = solver_for(b, positive=positive) if b is not None else (lambda x: x)
            return lambda x: solve(a.apply(x)) - (s * x if s != 0 else 0)
        if self.kind in ("sinvert", "cayley"):
            solve = solver_for(combination([(1.0, a), (-s, unit)]))
            if self.kind == "sinvert":
                return lambda x: solve(unit.apply(x))
            nu = s if self.nu is None else self._number(self.nu)
            return lambda x: solve(a.apply(x) + nu * unit.apply(x))
        if self.kind == "filter":
            return self.filter(a)
        if self.kind == "shell":
            return self.apply
        raise ValueError(f"no such transformation: {self.kind}")

    def adjoint(self, a: Operator, b: Operator | None) -> Callable[[np.ndarray], np.ndarray]:
        """The adjoint of ``operator``, for shift, shift-and-invert and Cayley."""
        flip = lambda o: Operator(o.n, o.adjoint, o.apply, o.rows, o.complex, None if o.diagonal is None else np.conj(o.diagonal), o.norm)
        unit, s = flip(b if b is not None else identity(a.n)), np.conj(self._number(self.sigma))
        if self.kind == "shift":
            solve = solver_for(unit) if b is not None else (lambda x: x)
            return lambda x: flip(a).apply(solve(x)) - (s * x if s != 0 else 0)
        if self.kind in ("sinvert", "cayley"):
            solve = solver_for(combination([(1.0, flip(a)), (-s, unit)]))
            if self.kind == "sinvert":
                return lambda x: unit.apply(solve(x))
            nu = s if self.nu is None else np.conj(self._number(self.nu))
            return lambda x: flip(a).apply(y := solve(x)) + nu * unit.apply(y)
        raise ValueError(f"no adjoint of {self.kind}")

    def transpose(self, a: Operator, b: Operator | None) -> Callable[[np.ndarray], np.ndarray]:
        """The transpose, which is the conjugate of the adjoint at the conjugate."""
        flip = self.adjoint(a, b)
        return lambda x: np.conj(flip(np.conj(x)))

    def shell(self, a: Operator, b: Operator | None) -> Operator:
        """The transformed operator as a matrix of its own."""
        return Operator(a.n, self.operator(a, b), self.adjoint(a, b) if self.kind in ("shift", "sinvert", "cayley") else None, None, a.complex)

    def bilinear(self, b: Operator | None, hermitian: bool) -> Callable[[np.ndarray, np.ndarray], complex]:
        """The inner product that the transformed operator is symmetric in: B's for a definite pair, else the plain one."""
        return (lambda x, y: np.vdot(x, b.apply(y))) if b is not None and hermitian else (lambda x, y: np.vdot(x, y))

    def scaled(self, factor: float) -> Transform:
        """For the pair (factor A, B): shift and antishift scale too."""
        times = lambda z: None if z is None else z * factor
        return replace(self, sigma=self.sigma * factor, nu=times(self.nu), interval=None if self.interval is None else (self.interval[0] * factor, self.interval[1] * factor), span=None if self.span is None else (self.span[0] * factor, self.span[1] * factor))

    @staticmethod
    def _number(z):
        z = complex(z)
        return z.real if z.imag == 0 else z

    def filter(self, a: Operator) -> Callable[[np.ndarray], np.ndarray]:
        """A Chebyshev series of the interval's indicator with Jackson damping, by the three-term recurrence."""
        lo, hi = self.span if self.span is not None else spectral_range(a)
        centre, half = (lo + hi) / 2, (hi - lo) / 2 * 1.0001
        t = np.arccos(np.clip((np.array(self.interval) - centre) / half, -1, 1))
        m = self.degree
        k = np.arange(1, m + 1)
        c = np.concatenate([[(t[0] - t[1]) / math.pi], 2 * (np.sin(k * t[0]) - np.sin(k * t[1])) / (math.pi * k)])
        k = np.arange(m + 1)
        q = math.pi / (m + 2)
        c = c * ((m + 2 - k) * np.cos(k * q) + np.sin(k * q) / np.tan(q)) / (m + 2)
        step = lambda x: (a.apply(x) - centre * x) / half

        def apply(x: np.ndarray) -> np.ndarray:
            before, now = x, step(x)
            y = c[0] * before + c[1] * now
            for j in range(2, m + 1):
                before, now = now, 2 * step(now) - before
                y = y + c[j] * now
            return y

        return apply

    def eigenvalues(self, theta: np.ndarray) -> np.ndarray:
        """Back from the operator's eigenvalues; a filter's are read from Rayleigh quotients instead."""
        theta = np.asarray(theta)
        if self.kind == "shift":
            return theta + self._number(self.sigma)
        with np.errstate(divide="ignore", invalid="ignore"):
            if self.kind == "sinvert":
                return 1 / theta + self._number(self.sigma)
            if self.kind == "cayley":
                s = self._number(self.sigma)
                nu = s if self.nu is None else self._number(self.nu)
                return (nu + theta * s) / (theta - 1)
        if self.kind == "shell" and self.back is not None:
            return self.back(theta)
        return theta

    def forward(self, values: np.ndarray) -> np.ndarray:
        s = self._number(self.sigma)
        if self.kind == "sinvert":
            return 1 / (values - s)
        if self.kind == "cayley":
            return (values + (s if self.nu is None else self._number(self.nu))) / (values - s)
        return values - s if self.kind == "shift" else values

    def columns(self, re: str = "re", im: str = "im") -> tuple[Column, Column]:
        """The same way back over columns of real and imaginary parts."""
        r, i, s = F.col(re), F.col(im), complex(self.sigma)
        if self.kind == "shift":
            return r + s.real, i + s.imag
        if self.kind == "sinvert":
            d = r * r + i * i
            return r / d + s.real, -i / d + s.imag
        if self.kind == "cayley":
            nu = s if self.nu is None else complex(self.nu)
            top_r, top_i = nu.real + r * s.real - i * s.imag, nu.imag + r * s.imag + i * s.real
            d = (r - 1) * (r - 1) + i * i
            return (top_r * (r - 1) + top_i * i) / d, (top_i * (r - 1) - top_r * i) / d
        return r, i


def spectral_range(a: Operator, steps: int = 30, seed: int = 0) -> tuple[float, float]:
    """Bounds on a Hermitian operator's eigenvalues from a few Lanczos steps, widened by the residuals."""
    from .basis import arnoldi

    m = min(steps, a.n)
    v, h = np.zeros((a.n, m + 1), complex if a.complex else float), np.zeros((m + 1, m), complex if a.complex else float)
    v[:, 0] = np.random.default_rng(seed).standard_normal(a.n)
    v[:, 0] /= np.linalg.norm(v[:, 0])
    j, beta, _ = arnoldi(a.apply, v, h, 0, m)
    w, q = np.linalg.eigh((h[:j, :j] + h[:j, :j].conj().T) / 2)
    return float(w[0] - beta * abs(q[-1, 0])), float(w[-1] + beta * abs(q[-1, -1]))


def null_space_check(a: Operator, x: np.ndarray, tol: float = 1e-8) -> bool:
    """Whether every column of x is annihilated."""
    return bool(np.linalg.norm(a.apply(x), axis=0).max() <= tol * max(a.norm or 1.0, 1e-300))
