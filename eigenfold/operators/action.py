"""y = f(A) b by Krylov spaces, and Lyapunov equations A X + X A^H = -C with a low-rank C."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from .. import dense
from ..functions.scalar import Exp, Function
from ..matrix import Operator, as_operator
from .basis import arnoldi


@dataclass
class Action:
    y: np.ndarray
    iterations: int
    reason: str


ACTIONS: dict[str, object] = {}
EQUATION_SOLVERS: dict[str, object] = {}


def register(name: str, solver) -> None:
    """A solver of f(A) b of one's own: (operator, f, b, ncv, tol, max_it) to an ``Action``."""
    ACTIONS[name] = solver


def register_equation(kind: str, solver) -> None:
    """A solver for a kind of equation: (operator, C, ncv, tol, max_it) to a ``LowRank``."""
    EQUATION_SOLVERS[kind] = solver


def funm_multiply(A, f: Function, b: np.ndarray, ncv: int = 30, tol: float = 1e-8, max_it: int = 100, solver: str = "krylov", transpose: bool = False) -> Action:
    """f(A) b. "krylov": a restarted Arnoldi process, f on the growing Hessenberg matrix; "expokit": the exponential in adaptive steps."""
    a = as_operator(A)
    op = a.adjoint if transpose else a.apply
    if transpose and a.complex:
        op = lambda x: a.adjoint(x.conj()).conj()
    if np.linalg.norm(b) == 0:
        raise ValueError("the vector is zero")
    if solver in ACTIONS:
        return ACTIONS[solver](a, f, b, ncv, tol, max_it)
    if solver == "expokit":
        if not isinstance(f, Exp):
            raise ValueError("expokit is for the exponential")
        return _expokit(a, op, f, b, ncv, tol, max_it)
    if solver != "krylov":
        raise ValueError(f"no such solver: {solver}")
    n, m = a.n, min(ncv, a.n)
    kind = complex if a.complex or np.iscomplexobj(b) or isinstance(f.alpha, complex) else float
    beta = float(np.linalg.norm(b))
    y, start = np.zeros(n, kind), np.asarray(b, kind) / beta
    big = np.zeros((0, 0), kind)
    for it in range(1, max_it + 1):
        v, h = np.zeros((n, m + 1), kind), np.zeros((m + 1, m), kind)
        v[:, 0] = start
        j, last, closed = arnoldi(op, v, h, 0, m)
        size = len(big)
        grown = np.zeros((size + j, size + j), kind)
        grown[:size, :size], grown[size:, size:] = big, h[:j, :j]
        if size:
            grown[size, size - 1] = link
        big = grown
        g = f.matrix(big, None)[:, 0]
        update = beta * (v[:, :j] @ g[size:])
        y = y + update
        if closed or np.linalg.norm(update) <= tol * max(np.linalg.norm(y), 1e-300):
            return Action(y, it, "tolerance")
        start, link = v[:, j], last
    return Action(y, max_it, "iterations")


def _expokit(a: Operator, op, f: Exp, b: np.ndarray, ncv: int, tol: float, most: int) -> Action:
    t_end, m = f.alpha, min(ncv, a.n)
    kind = complex if a.complex or np.iscomplexobj(b) or isinstance(t_end, complex) else float
    w, done, it = np.asarray(b, kind), 0.0, 0
    norm = a.norm or float(np.linalg.norm(op(b)) / np.linalg.norm(b))
    total = abs(t_end)
    direction = t_end / total if total else 1.0
    step = min(total, 10 / max(norm, 1e-12))
    while done < total:
        it += 1
        if it > most * 50:
            return Action(w * f.beta, it, "iterations")
        beta = np.linalg.norm(w)
        v, h = np.zeros((a.n, m + 1), kind), np.zeros((m + 2, m + 2), kind)
        v[:, 0] = w / beta
        hh = np.zeros((m + 1, m), kind)
        j, last, closed = arnoldi(op, v, hh, 0, m)
        if closed:
            w = beta * (v[:, :j] @ dense.expm(direction * (total - done) * hh[:j, :j])[:, 0])
            break
        h[: m + 1, :m] = hh
        h[m + 1, m] = 1
        step = min(step, total - done)
        while True:
            e = dense.expm(direction * step * h)
            error = max(beta * abs(e[m, 0]), 1e-300)
            if error <= tol * max(step / total, 1e-3) * beta or step < 1e-14 * total:
                break
            step *= max(0.2, 0.9 * (tol * beta / error) ** (1 / m))
        w = beta * (v[:, : m + 1] @ e[: m + 1, 0])
        done += step
        step *= min(3.0, 0.9 * (tol * beta / error) ** (1 / m))
    return Action(w * f.beta, it, "tolerance")


EQUATIONS = ("lyapunov", "sylvester", "gen_lyapunov", "gen_sylvester", "dt_lyapunov", "stein")


@dataclass
class LowRank:
    """X = factor factor^H."""

    factor: np.ndarray
    rank: int
    iterations: int
    reason: str
    error: float


def solve_equation(A, C: np.ndarray, kind: str = "lyapunov", ncv: int = 30, tol: float = 1e-8, max_it: int = 100, rank: int | None = None) -> LowRank:
    """A X + X A^H = -C C^H with few columns C, in a Krylov space of A and C that grows until the residual is small. Of the kinds of
    equation only "lyapunov" has a solver."""
    if kind in EQUATION_SOLVERS:
        return EQUATION_SOLVERS[kind](as_operator(A), C, ncv, tol, max_it)
    if kind not in EQUATIONS:
        raise ValueError(f"no such equation: {kind}")
    if kind != "lyapunov":
        raise NotImplementedError(f"no solver for {kind}")
    a = as_operator(A)
    c = np.atleast_2d(np.asarray(C).T).T
    if np.linalg.norm(c) == 0:
        raise ValueError("the right-hand side is zero")
    n = a.n
    v, r = np.linalg.qr(c)
    new, size = v, float(np.linalg.norm(c @ c.conj().T)) if n <= 5000 else float(np.linalg.norm(r @ r.conj().T))
    reason = "iterations"
    for it in range(1, max_it + 1):
        for _ in range(max(1, ncv // max(1, new.shape[1]))):
            w = a.apply(new)
            for _ in range(2):
                w = w - v @ (v.conj().T @ w)
            q, t = np.linalg.qr(w)
            keep = np.abs(np.diag(t)) > 1e-12 * max(1.0, np.abs(t).max())
            new = q[:, keep]
            if not new.shape[1] or v.shape[1] >= n:
                break
            v = np.hstack([v, new])
            if v.shape[1] >= n:
                break
        av = a.apply(v)
        h = v.conj().T @ av
        cv = v.conj().T @ c
        y = dense.lyapunov(h, cv @ cv.conj().T)
        outside = (av - v @ h) @ y
        error = float(np.sqrt(2) * np.linalg.norm(outside)) / size
        if error <= tol or v.shape[1] >= n or not new.shape[1]:
            reason = "tolerance"
            break
    factor, found = dense.rank_svd(y)
    factor = v @ factor[:, ::-1]
    if rank is not None:
        factor = factor[:, :rank]
    return LowRank(factor, found, it, reason, equation_error(a, factor, c))


def equation_error(a: Operator, factor: np.ndarray, c: np.ndarray) -> float:
    """||A X + X A^H + C C^H|| from the factors alone."""
    z = np.hstack([a.apply(factor), factor, c])
    k = factor.shape[1]
    _, r = np.linalg.qr(z)
    mid = np.zeros((z.shape[1],) * 2)
    mid[:k, k : 2 * k] = mid[k : 2 * k, :k] = np.eye(k)
    mid[2 * k :, 2 * k :] = np.eye(c.shape[1])
    return float(np.linalg.norm(r @ mid @ r.conj().T))
