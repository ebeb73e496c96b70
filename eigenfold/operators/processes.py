"""Krylov processes with explicit restarts, Rayleigh quotient conjugate gradients, and the product form of Bethe-Salpeter problems."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np

from .. import dense
from ..matrix import Operator
from .basis import orthogonalise

EPS = np.finfo(float).eps
REORTHOGONALISATIONS = ("local", "full", "selective", "periodic", "partial", "delayed")


def _size(w: np.ndarray, b: Callable | None) -> float:
    return float(np.sqrt(max(np.real(np.vdot(w, w if b is None else b(w))), 0)))


def lanczos_process(op: Callable, start: np.ndarray, m: int, how: str = "full", b: Callable | None = None, locked: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, float, bool]:
    """V, T, the next off-diagonal and whether the space closed, after up to ``m`` steps with one of ``REORTHOGONALISATIONS``: against the
    last two vectors only; against all; against the Ritz vectors that have converged; against all ("periodic") or those that matter
    ("partial") once the estimated loss of orthogonality passes the root of the precision; or against all, the second pass a step later."""
    if how not in REORTHOGONALISATIONS:
        raise ValueError(f"no such reorthogonalisation: {how}")
    v = np.zeros((len(start), m), start.dtype)
    alpha, beta = np.zeros(m), np.zeros(m)
    v[:, 0] = start / _size(start, b)
    before, now, again = np.zeros(m + 1), np.zeros(m + 1), False
    now[0] = 1.0
    for j in range(m):
        if how == "delayed" and j:
            v[:, j], _ = orthogonalise(v[:, j], v[:, :j], b, passes=1)
            v[:, j] /= _size(v[:, j], b)
        w = op(v[:, j])
        length = np.linalg.norm(w)
        if j:
            w = w - beta[j - 1] * v[:, j - 1]
        alpha[j] = np.real(np.vdot(v[:, j], w if b is None else b(w)))
        w = w - alpha[j] * v[:, j]
        if locked is not None and locked.shape[1]:
            w, _ = orthogonalise(w, locked, b)
        if how == "full":
            w, _ = orthogonalise(w, v[:, : j + 1], b)
        elif how == "delayed":
            w, _ = orthogonalise(w, v[:, : j + 1], b, passes=1)
        else:
            w, _ = orthogonalise(w, v[:, max(0, j - 1) : j + 1], b, passes=1)
        size = _size(w, b)
        if how == "selective" and j:
            t = np.diag(alpha[: j + 1]) + np.diag(beta[:j], 1) + np.diag(beta[:j], -1)
            theta, y = np.linalg.eigh(t)
            settled = size * np.abs(y[-1]) <= math.sqrt(EPS) * np.abs(theta).max()
            if settled.any():
                w, _ = orthogonalise(w, v[:, : j + 1] @ y[:, settled], b)
                size = _size(w, b)
        elif how in ("periodic", "partial") and j and size > 0:
            after = np.zeros(m + 1)
            k = np.arange(j)
            after[:j] = beta[k] * now[k + 1] + (alpha[k] - alpha[j]) * now[k] - beta[j - 1] * before[k]
            after[1:j] += beta[: j - 1] * now[: j - 1]
            after[:j] = (after[:j] + np.sign(after[:j]) * 2 * EPS * length) / size
            after[j], after[j + 1] = EPS * math.sqrt(len(w)), 1.0
            if again or np.abs(after[: j + 1]).max() > math.sqrt(EPS):
                who = np.arange(j + 1) if how == "periodic" or again else np.flatnonzero(np.abs(after[: j + 1]) > EPS**0.75)
                w, _ = orthogonalise(w, v[:, who], b)
                after[who], size = EPS, _size(w, b)
                again = not again  # and the next vector as well
            before, now = now, after
        beta[j] = size
        if size <= 1e-14 * max(length, 1e-300) or j == m - 1:
            break
        v[:, j + 1] = w / size
    n = j + 1
    closed = bool(beta[j] <= 1e-14 * max(length, 1e-300))
    return v[:, :n], np.diag(alpha[:n]) + np.diag(beta[: n - 1], 1) + np.diag(beta[: n - 1], -1), 0.0 if closed else float(beta[j]), closed


def arnoldi_process(op: Callable, start: np.ndarray, m: int, delayed: bool = False, b: Callable | None = None, locked: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, float, bool]:
    """V, H, the last subdiagonal and whether the space closed. ``delayed``: each vector's second pass is made together with the next
    vector's first one, which is one reduction a step instead of two."""
    v, h = np.zeros((len(start), m + 1), start.dtype), np.zeros((m + 1, m), start.dtype)
    v[:, 0] = start / _size(start, b)
    for j in range(m):
        if delayed and j:
            fixed, c = orthogonalise(v[:, j], v[:, :j], b, passes=1)
            size = _size(fixed, b)
            h[:j, j - 1] += c * h[j, j - 1]
            h[j, j - 1] *= size
            v[:, j] = fixed / size
        w = op(v[:, j])
        length = np.linalg.norm(w)
        if locked is not None and locked.shape[1]:
            w, _ = orthogonalise(w, locked, b)
        w, c = orthogonalise(w, v[:, : j + 1], b, passes=1 if delayed else 2)
        h[: j + 1, j] = c
        size = _size(w, b)
        if size <= 1e-14 * max(length, 1e-300):
            return v[:, : j + 1], h[: j + 1, : j + 1], 0.0, True
        h[j + 1, j], v[:, j + 1] = size, w / size
    return v[:, :m], h[:m, :m], float(np.real(h[m, m - 1])), False


def explicit(p, process: Callable, symmetric: bool):
    """Explicit restarts: what has converged is locked, and the process starts anew with the first wanted vector that has not."""
    op, b = p.transform.operator(p.a, p.b, p.kind == "ghep"), p.inner()
    kind = complex if p.complex else float
    given = np.zeros((p.n, 0), kind) if p.deflation is None else p.locked().astype(kind)
    kept = np.zeros((p.n, 0), kind)
    x, why = p.start()[:, 0].astype(kind), "iterations"
    it = 0
    while True:
        it += 1
        locked = np.hstack([given, kept])
        m = min(max(p.ncv - kept.shape[1], 2), p.n - locked.shape[1])
        if m <= 0:
            why = "tolerance"
            break
        x = orthogonalise(x, locked, b)[0] if locked.shape[1] else x
        v, t, last, closed = process(op, x, m, b=b, locked=locked)
        theta, y = dense.hep(t) if symmetric else np.linalg.eig(t)
        at = p.wanted(theta)
        theta, y = theta[at], y[:, at]
        errors = np.array([p.error(abs(last * r), s) for r, s in zip(y[-1], theta)])
        done = 0
        while done < len(theta) and (errors[done] < p.tol or closed):
            done += 1
        new = v @ y[:, :done]
        if np.iscomplexobj(new) and kind is float:
            new = np.hstack([new.real, new.imag])
        for column in new.T:
            w, _ = orthogonalise(column, np.hstack([given, kept]), b) if given.shape[1] + kept.shape[1] else (column, 0)
            if (size := _size(w, b)) > 1e-6 * max(_size(column, b), 1e-300):
                kept = np.hstack([kept, (w / size)[:, None]])
        p.tell(it, p.transform.eigenvalues(theta[: p.nev]), errors[: p.nev])
        told = p.stop(it, kept.shape[1])
        if told is not None:
            why = told
            break
        rest = v @ y[:, min(done, len(theta) - 1)]
        x = rest if kind is complex else rest.real + rest.imag if np.iscomplexobj(rest) else rest
        if not np.linalg.norm(x) > 0 or closed:
            x = p.start()[:, 0].astype(kind)
    image = op(kept) if kept.shape[1] else kept
    small = kept.conj().T @ (image if b is None else b(image))
    theta, y = (dense.hep((small + small.conj().T) / 2) if symmetric else np.linalg.eig(small)) if kept.shape[1] else (np.zeros(0), np.zeros((0, 0)))
    at = p.wanted(theta) if len(theta) else np.zeros(0, int)
    return theta[at], kept @ y[:, at], it, why, False


def rqcg(p, precondition: Callable, reset: int = 20):
    """Rayleigh quotient conjugate gradients: each vector moves along its own conjugate direction to the best combination of both, and
    the block is projected and made orthonormal again; directions start anew every ``reset`` steps."""
    b, lead = p.inner(), p.locked()
    sign = -1.0 if p.which in ("largest_real", "largest_magnitude") else 1.0
    m = min(max(p.options.get("block", p.nev + min(p.nev, 4)), p.nev), p.n)
    unit = lambda x: _orthonormal(x if lead is None else orthogonalise(x, lead, b)[0], b)
    x, d, old, gradient = unit(p.start(m)), None, None, None
    for it in range(1, p.most * 20 + 1):
        ax = p.a.apply(x)
        w, y = dense.hep(sign * (x.conj().T @ ax + (x.conj().T @ ax).conj().T) / 2)
        x, ax, w = x @ y, ax @ y, sign * w
        r = ax - p.bx(x) * w
        errors = np.array([p.error(s, t) for s, t in zip(np.linalg.norm(r, axis=0), w)])
        done = int(np.argmin(np.append(errors < p.tol, False)))
        p.tell(it, w[: p.nev], errors[: p.nev])
        if done >= p.nev or it == p.most * 20:
            return w[:done], x[:, :done], it, "tolerance" if done >= p.nev else "iterations", True
        g = precondition(r)
        if d is None or it % reset == 0:
            d = g
        else:
            turned, kept = old @ y, gradient @ y
            ratio = np.real(np.einsum("ij,ij->j", g.conj(), r - turned)) / np.maximum(np.abs(np.einsum("ij,ij->j", kept.conj(), turned)), 1e-300)
            d = g + (d @ y) * np.maximum(ratio, 0)
        old, gradient = r, g
        d = d if lead is None else orthogonalise(d, lead, b)[0]
        ad, bx, bd = p.a.apply(d), p.bx(x), p.bx(d)
        new = np.empty_like(x)
        for k in range(m):
            s, ts, us = np.stack([x[:, k], d[:, k]], 1), np.stack([ax[:, k], ad[:, k]], 1), np.stack([bx[:, k], bd[:, k]], 1)
            size = 1 / np.maximum(np.linalg.norm(s, axis=0), 1e-300)
            h, f = size[:, None] * (s.conj().T @ ts) * size, size[:, None] * (s.conj().T @ us) * size
            try:
                _, c = dense.ghep(sign * (h + h.conj().T) / 2, (f + f.conj().T) / 2)
                new[:, k] = s @ (size * c[:, 0])
            except np.linalg.LinAlgError:  # the direction lies along the vector
                new[:, k] = x[:, k]
        x = unit(new)


def _orthonormal(x: np.ndarray, b: Callable | None) -> np.ndarray:
    q, _ = np.linalg.qr(x)
    if b is None:
        return q
    g = q.conj().T @ b(q)
    return np.linalg.solve(np.linalg.cholesky((g + g.conj().T) / 2), q.conj().T).conj().T


def bse_product(p, ncv: int | None = None):
    """Smallest positive values of [R C; -C -R] of real blocks, and their negatives, without its entries: (R - C)(R + C) is Hermitian in the
    inner product of R + C, and a Lanczos process in that product, restarted explicitly, finds its smallest values by their inverse."""
    from .transform import conjugate_gradient

    n = p.n // 2
    minus = lambda u: p.a.apply(np.concatenate([u, -u]))[:n]
    plus = lambda u: p.a.apply(np.concatenate([u, u]))[:n]
    solve = lambda f, y: conjugate_gradient(f, y, tol=1e-13)
    inverse = lambda u: solve(plus, solve(minus, u))
    want = math.ceil(p.nev / 2)
    values, vectors, it, start = [], np.zeros((n, 0)), 0, p.rng.standard_normal(n)
    while len(values) < want and it < p.most:
        it += 1
        start = orthogonalise(start, vectors, plus)[0] if vectors.shape[1] else start
        m = min(ncv or max(p.ncv, 2 * want + 10), n - vectors.shape[1])
        v, t, last, closed = lanczos_process(inverse, start, m, "full", plus, vectors)
        theta, y = np.linalg.eigh(t)
        theta, y = theta[::-1], y[:, ::-1]
        good = [k for k in range(len(theta)) if closed or abs(last * y[-1, k]) <= max(p.tol, 1e-10) * theta[k]]
        first = [k for i, k in enumerate(good) if i == k][: want - len(values)]
        for k in first:
            values.append(1 / math.sqrt(theta[k]))
            vectors = np.hstack([vectors, (v @ y[:, k])[:, None]])
        start = v @ y[:, len(first)] if len(first) < len(theta) else p.rng.standard_normal(n)
    w = np.array(values)
    # u = x + y, (R + C) u / w = x - y
    u = vectors
    t = np.stack([plus(c) for c in u.T], 1) / w if u.shape[1] else u
    x = np.vstack([(u + t) / 2, (u - t) / 2])
    return np.concatenate([w, -w]), np.hstack([x, np.vstack([x[n:], x[:n]])]), it, "tolerance" if len(values) >= want else "iterations", True


def adjoint(a: Operator) -> Operator:
    return Operator(a.n, a.adjoint, a.apply, a.rows, a.complex, None if a.diagonal is None else np.conj(a.diagonal), a.norm)


def nonlinear_power(at: Callable[[np.ndarray], Operator], start: np.ndarray, b_at: Callable[[np.ndarray], Operator] | None = None, shift: complex | None = None, tol: float = 1e-8, most: int = 1000) -> tuple[complex, np.ndarray, int, bool]:
    """A(x) x = k B(x) x, where the matrices depend on the vector: power steps with A(x), or with ``shift`` inverse steps
    with A(x) - shift B(x), each with the matrices at the last vector."""
    from .transform import combination, identity, solver_for

    x, k = start / np.linalg.norm(start), 0.0
    for it in range(1, most + 1):
        a, b = at(x), identity(len(x)) if b_at is None else b_at(x)
        ax, bx = a.apply(x), b.apply(x)
        k = np.vdot(bx, ax) / np.vdot(bx, bx)
        if np.linalg.norm(ax - k * bx) <= tol * max(abs(k), 1e-300) * np.linalg.norm(bx):
            return k, x, it, True
        if shift is not None:
            x = solver_for(combination([(1.0, a), (-shift, b)]))(bx)
        else:
            x = ax if b_at is None else solver_for(b)(ax)
        x = x / np.linalg.norm(x)
        x = x * np.conj(np.sign(x[np.abs(x).argmax()]))  # the sign is free, the matrices may see it
    return k, x, most, False
