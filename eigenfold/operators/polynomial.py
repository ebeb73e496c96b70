"""Polynomial eigenproblems sum p_j(k) A_j x = 0 in six bases."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from .. import dense
from ..functions.order import order
from ..functions.region import Region
from ..matrix import DENSE_ROWS, Matrix, Operator, as_operator, of_array
from . import eigen, spaces
from .eigen import EigenResult
from .transform import Transform, combination, solver_for


def evaluate(mats: list[Operator], basis: str, x: complex, slope: bool = False) -> Operator:
    d = len(mats) - 1
    p = dense.basis_slopes(basis, d, x) if slope else dense.basis_values(basis, d, x)
    return combination([(c, m) for c, m in zip(p, mats)])


def scale_factor(mats: list[Operator]) -> float:
    """For a parameter scaled as alpha * mu: the (norm A_0 / norm A_d) root that evens out the coefficients."""
    d = len(mats) - 1
    lo, hi = mats[0].norm or 1.0, mats[-1].norm or 1.0
    return (lo / hi) ** (1 / d) if hi > 0 and lo > 0 else 1.0


def diagonal_scaling(mats: list[np.ndarray], w: float = 1.0, steps: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Row and column scalings, powers of two, that even out the sums of squares over all coefficients."""
    total = sum(w ** (2 * j) * np.abs(m) ** 2 for j, m in enumerate(mats))
    n = len(total)
    left, right = np.ones(n), np.ones(n)
    for _ in range(steps):
        cols = (left[:, None] ** 2 * total * right**2).sum(0)
        right = right * np.exp2(-np.round(0.5 * np.log2(np.where(cols > 0, cols, 1))))
        rows = (left[:, None] ** 2 * total * right**2).sum(1)
        left = left * np.exp2(-np.round(0.5 * np.log2(np.where(rows > 0, rows, 1))))
    return left, right


def companion_operator(mats: list[Operator], basis: str) -> tuple[Callable, Callable, int]:
    """L0 y and L1 y of the companion pencil, block by block, without forming it."""
    d, n = len(mats) - 1, mats[0].n
    a, b, g = dense.recurrence(basis, d)

    def l0(y: np.ndarray) -> np.ndarray:
        z = y.reshape(d, n, *y.shape[1:])
        out = np.empty(z.shape, np.result_type(z, *[complex if m.complex else float for m in mats]))
        for j in range(d - 1):
            out[j] = a[j] * z[j + 1] + b[j] * z[j] + (g[j] * z[j - 1] if j else 0)
        k = d - 1
        last = -a[k] * sum(m.apply(z[j]) for j, m in enumerate(mats[:-1]))
        out[k] = last + mats[-1].apply(b[k] * z[k] + (g[k] * z[k - 1] if k else 0))
        return out.reshape(y.shape)

    def l1(y: np.ndarray) -> np.ndarray:
        z = y.reshape(d, n, *y.shape[1:]).copy()
        z[-1] = mats[-1].apply(z[-1])
        return z.reshape(y.shape)

    return l0, l1, d * n


def shifted_solve(mats: list[Operator], basis: str, sigma: complex) -> Callable[[np.ndarray], np.ndarray]:
    """(L0 - sigma L1)^-1 by the recurrence and one solve with P(sigma)."""
    d, n = len(mats) - 1, mats[0].n
    a, b, g = dense.recurrence(basis, d)
    p = dense.basis_values(basis, d, sigma)
    solve = solver_for(evaluate(mats, basis, sigma))

    def run(r: np.ndarray) -> np.ndarray:
        q = r.reshape(d, n, *r.shape[1:])
        # z_j = p_j z_0 + s_j with s from the first d - 1 rows
        kind = np.result_type(q, np.asarray(sigma), *[complex if m.complex else float for m in mats])
        s = np.zeros(q.shape, kind)
        for j in range(d - 1):
            s[j + 1] = (q[j] - (b[j] - sigma) * s[j] - (g[j] * s[j - 1] if j else 0)) / a[j]
        k = d - 1
        rest = q[k] + a[k] * sum(m.apply(s[j]) for j, m in enumerate(mats[:-1])) - mats[-1].apply((b[k] - sigma) * s[k] + (g[k] * s[k - 1] if k else 0))
        z0 = solve(-rest / a[k])
        out = np.stack([p[j] * z0 + s[j] for j in range(d)])
        return out.reshape(r.shape)

    return run


def extract(y: np.ndarray, mats: list[Operator], basis: str, values: np.ndarray, how: str) -> np.ndarray:
    """A vector of length n from each column of the stacked one: its first block ("none"), its largest ("norm"), the one of the least
    residual ("residual"), or their sum weighted by the basis values ("structured")."""
    d, n = len(mats) - 1, mats[0].n
    z = y.reshape(d, n, -1)
    out = np.zeros((n, z.shape[2]), y.dtype)
    for k in range(z.shape[2]):
        blocks = z[:, :, k]
        if how == "none":
            x = blocks[0]
        elif how == "norm":
            x = blocks[np.linalg.norm(blocks, axis=1).argmax()]
        elif how == "structured":
            p = np.array(dense.basis_values(basis, d, values[k])[:d])
            x = p.conj() @ blocks / np.vdot(p, p)
        else:
            sizes = [np.linalg.norm(evaluate(mats, basis, values[k]).apply(b)) / max(np.linalg.norm(b), 1e-300) for b in blocks]
            x = blocks[int(np.argmin(sizes))]
        out[:, k] = x / max(np.linalg.norm(x), 1e-300)
    return out


def residuals(mats: list[Operator], basis: str, values: np.ndarray, x: np.ndarray, kind: str = "backward") -> np.ndarray:
    out = []
    for k, v in enumerate(values):
        r = np.linalg.norm(evaluate(mats, basis, v).apply(x[:, k]))
        if kind == "relative":
            r /= max(abs(v), 1e-300)
        elif kind == "backward":
            r /= sum(abs(p) * (m.norm or 1.0) for p, m in zip(dense.basis_values(basis, len(mats) - 1, v), mats)) or 1.0
        out.append(r)
    return np.array(out)


def refine(mats: list[Operator], basis: str, value: complex, x: np.ndarray, steps: int = 3) -> tuple[complex, np.ndarray]:
    """Newton steps on one pair, with the vector's length held."""
    n = mats[0].n
    c = x / np.vdot(x, x)
    for _ in range(steps):
        t, dt = evaluate(mats, basis, value), evaluate(mats, basis, value, True)
        big = np.zeros((n + 1, n + 1), complex)
        big[:n, :n], big[:n, n], big[n, :n] = t.dense(), dt.apply(x), c.conj()
        step = np.linalg.solve(big, np.concatenate([-t.apply(x), [1 - np.vdot(c, x)]]))
        x, value = x + step[:n], value + step[n]
    return value, x / np.linalg.norm(x)


def definite_quadratic(mats: list[np.ndarray]) -> bool:
    """Whether a Hermitian quadratic with M > 0 is hyperbolic: (x'Cx)^2 > 4 (x'Mx)(x'Kx) for all x; its values are then real and part in two groups."""
    k, c, m = mats
    if np.linalg.eigvalsh(m)[0] <= 0:
        return False
    w, v = dense.polyeig(mats)
    if np.abs(w.imag).max() > 1e-8 * np.abs(w).max():
        return False
    signs = np.array([np.real(np.vdot(v[:, i], (2 * w[i] * m + c) @ v[:, i])) for i in range(len(w))])
    return bool((signs > 0).sum() == (signs < 0).sum() and w.real[signs > 0].min() > w.real[signs < 0].max())


def invariant_pair_refine(mats: list[Operator], basis: str, values: np.ndarray, x: np.ndarray, steps: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Newton steps on several pairs, each on its own (they are independent tasks)."""
    pairs = [refine(mats, basis, v, x[:, k], steps) for k, v in enumerate(values)]
    return np.array([v for v, _ in pairs]), np.stack([y for _, y in pairs], 1)


#: Solvers of one's own: (matrices, basis, nev, which, target, tol, options) -> values, vectors, iterations.
SOLVERS: dict[str, Callable] = {}


def register(name: str, solver: Callable) -> None:
    SOLVERS[name] = solver


def polyeigs(
    mats: list, basis: str = "monomial", nev: int = 1, which: str = "largest_magnitude", target: complex | None = None, solver: str = "toar", transform: str | None = None, ncv: int | None = None, tol: float = 1e-8,
    region: Region | None = None, extraction: str = "norm", scale: str = "none", refine_steps: int = 0, interval: tuple[float, float] | None = None, seed: int = 0, **options,
) -> EigenResult:
    """Eigenpairs of the polynomial with coefficients ``mats`` (lowest first).

    "toar", "stoar": a thick-restarted Krylov solve in a basis that all blocks of the companion pencil share, "stoar" in the indefinite form
    of a Hermitian quadratic; "linear" (and "qarnoldi"): the same pencil with whole vectors; "lapack": dense; "jd": Jacobi-Davidson
    with deflation; "ciss": contour integral."""
    ops = [as_operator(m) for m in mats]
    n, d = ops[0].n, len(ops) - 1
    if target is not None and which == "largest_magnitude":
        which = "target_magnitude"
    nev = min(nev, n * d)
    factor = scale_factor(ops) if scale in ("scalar", "both") and basis == "monomial" else 1.0
    left = right = None
    work = ops
    if factor != 1.0:
        work = [combination([(factor**j, m)]) for j, m in enumerate(ops)]
    if scale in ("diagonal", "both"):
        arrays = [m.dense() for m in work]
        left, right = diagonal_scaling(arrays)
        work = [of_array(left[:, None] * m * right) for m in arrays]
    tau = None if target is None else target / factor
    its, history = 1, []
    if solver == "lapack" or solver == "ciss" and region is None:
        w, x = dense.polyeig([m.dense() for m in work], basis)
    elif solver == "ciss":
        resolve = lambda z, v: solver_for(evaluate(work, basis, z))(v)
        project = lambda q: dense.polyeig([q.conj().T @ m.apply(q) for m in work], basis)
        real = not any(m.complex for m in ops)
        w, x, _ = eigen.contour(n, resolve, project, region, real, **{k: options[k] for k in ("nodes", "block", "moments", "extraction") if k in options})
        keep = region.inside(w) >= 0
        w, x = w[keep], x[:, keep]
        good = residuals(work, basis, w, x / np.linalg.norm(x, axis=0)) < 1e-6
        w, x, nev = w[good], x[:, good], int(good.sum())
    elif solver == "jd":
        w, x, its = _jd(work, basis, nev, which, tau, tol, seed)
    elif solver in ("toar", "stoar") and interval is not None and (n * d > DENSE_ROWS or options.get("krylov")):
        w, x, its, history = _swept(work, basis, tuple(e / factor for e in interval), solver == "stoar", tol, seed, extraction, options)
        nev = len(w)
    elif solver in ("toar", "stoar") and interval is None:
        w, x, its, history = _compact(work, basis, nev, which, tau, region, solver == "stoar", transform, ncv, tol, seed, extraction, options)
    elif solver in ("toar", "qarnoldi", "stoar", "linear"):
        l0, l1, size = companion_operator(work, basis)
        cplx = any(m.complex for m in work)
        if interval is not None:
            w, x = dense.polyeig([m.dense() for m in work], basis)
            keep = (np.abs(w.imag) < 1e-8 * max(1, np.abs(w).max())) & (w.real >= interval[0] / factor) & (w.real <= interval[1] / factor)
            w, x, nev = w[keep].real, x[:, keep], int(keep.sum())
        else:
            use = transform or ("sinvert" if target is not None else "shift")
            if use == "sinvert":
                s = 0.0 if tau is None else tau
                s = complex(s).real if complex(s).imag == 0 else s
                inverse = shifted_solve(work, basis, s)
                t = Transform("shell", s, apply=lambda y: inverse(l1(y)), back=lambda th: 1 / th + s)
            else:
                lead = solver_for(work[-1])

                def once(y):
                    z = l0(y).reshape(d, n, *y.shape[1:])
                    z[-1] = lead(z[-1])
                    return z.reshape(y.shape)

                t = Transform("shell", 0.0, apply=once, back=lambda th: th)
            op = Operator(size, t.apply, None, None, cplx or complex(t.sigma).imag != 0)
            r = eigen.eigs(op, nev=nev, which=which, target=tau, problem="nhep", transform=t, ncv=ncv, tol=tol, region=region, seed=seed)
            w, y, its, history = r.values, r.vectors, r.iterations, r.history
            x = extract(y, work, basis, w, extraction)
    elif solver in SOLVERS:
        w, x, its = SOLVERS[solver](work, basis, nev, which, tau, tol, options)
    else:
        raise ValueError(f"no such solver: {solver}")
    if left is not None:
        x = right[:, None] * x
    w = w * factor
    real = not any(m.complex for m in ops)
    at = order(np.where(np.isfinite(w), w, 1e300), which, 0.0 if target is None else target, real, region)
    if solver in ("lapack", "ciss"):
        at = at[np.isfinite(w[at])]
        keep = nev
        if real and 0 < keep < len(at) and abs(w[at[keep - 1]].imag) > 1e-10 and abs(w[at[keep - 1]] - np.conj(w[at[keep]])) < 1e-6 * abs(w[at[keep]]):
            keep += 1
        at = at[:keep]
    w, x = w[at], x[:, at]
    x = x / np.maximum(np.linalg.norm(x, axis=0), 1e-300)
    if refine_steps and len(w):
        w, x = invariant_pair_refine(ops, basis, w, x, refine_steps)
    return EigenResult(w, x, residuals(ops, basis, w, x), solver, its, "tolerance", None, history, real)


def _swept(mats: list[Operator], basis: str, interval: tuple[float, float], symmetric: bool, tol: float, seed: int, extraction: str, options: dict, first: int = 12, most: int = 96):
    """All real values in the interval, never dense: about the middle of each stretch as many pairs as it takes for one to lie outside the
    circle over the stretch; a stretch with more than ``most`` is halved."""
    todo, values, vectors, its, history = [interval], [], [], 0, []
    while todo:
        a, b = todo.pop()
        middle, half, want = (a + b) / 2, (b - a) / 2, first
        shift = middle + 1e-4 * half  # not on a value in the middle, as a symmetric problem may have one
        while True:
            w, x, it, told = _compact(mats, basis, want, "target_magnitude", shift, None, symmetric, "sinvert", None, tol, seed, extraction, {**options, "max_it": 300})
            its, history = its + it, history + told
            if len(w) < min(want, mats[0].n * (len(mats) - 1)) or np.abs(w - shift).max() > half * 1.001 or want >= mats[0].n * (len(mats) - 1):
                break
            want *= 2
            if want > most:
                break
        if want > most:
            todo += [(a, middle), (middle, b)]
            continue
        if len(w) and len(w) < want and np.abs(w - shift).max() <= half * 1.001 and len(w) < mats[0].n * (len(mats) - 1):
            raise ArithmeticError(f"the values between {a} and {b} did not converge")
        for v, z in zip(w, x.T):
            if abs(v.imag) <= 1e-8 * max(1, abs(v)) and interval[0] <= v.real <= interval[1] and a <= v.real <= b:
                if all(abs(v.real - u) > 1e-8 * max(1, abs(u)) or abs(np.vdot(z, y)) < 0.99 for u, y in zip(values, vectors)):
                    values.append(v.real)
                    vectors.append(z)
    return np.array(values), np.stack(vectors, 1) if vectors else np.zeros((mats[0].n, 0)), its, history


class _Relative:
    def __init__(self, tol: float):
        self.tol = tol

    def __call__(self, residual: float, value: complex) -> float:
        return residual / max(abs(value), 1e-300)


def _compact(mats: list[Operator], basis: str, nev: int, which: str, target, region, symmetric: bool, transform: str | None, ncv: int | None, tol: float, seed: int, extraction: str, options: dict):
    """Krylov with the shared basis; the whole vectors of d n entries are formed for the pairs wanted alone."""
    d, n = len(mats) - 1, mats[0].n
    if symmetric and (d != 2 or basis != "monomial" or target is not None and complex(target).imag != 0):
        raise ValueError("stoar is for Hermitian quadratics and a real target")
    if symmetric and not all(eigen.seems_hermitian(m) for m in mats):
        raise ValueError("stoar is for Hermitian coefficients")
    sigma = None
    if (transform or ("sinvert" if target is not None else "shift")) == "sinvert":
        sigma = 0.0 if target is None else complex(target).real if complex(target).imag == 0 else target
    cplx = any(m.complex for m in mats) or np.iscomplexobj(np.asarray(sigma or 0.0))
    m = min(ncv or max(2 * nev, nev + 15), d * n)
    rng = np.random.default_rng(seed)
    start = rng.standard_normal(d * n) + (1j * rng.standard_normal(d * n) if cplx else 0)
    space = spaces.Compact(mats, basis, sigma, start, m, symmetric)
    back = (lambda th: th) if sigma is None else (lambda th: 1 / th + sigma)
    most, history = options.get("max_it", max(100, 2 * d * n // m)), []

    def wanted(theta: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore", invalid="ignore"):
            v = back(theta)
        return order(np.where(np.isfinite(v), v, 1e300), which, 0.0 if target is None else target, not cplx, region)

    def tell(it, theta, errors) -> None:
        with np.errstate(divide="ignore", invalid="ignore"):
            history.extend((it, k, complex(v), float(e)) for k, (v, e) in enumerate(zip(back(theta), errors)))

    stop = lambda it, nconv: "tolerance" if nconv >= nev else "iterations" if it >= most else None
    theta, y, its, _ = spaces.restarted(space, nev, wanted, _Relative(tol), stop, tell, not cplx, options.get("keep", 0.5))
    w = back(theta)
    keep = nev
    if not cplx and 0 < keep < len(w) and abs(w[keep - 1].imag) > 1e-10 and abs(w[keep - 1] - np.conj(w[keep])) < 1e-6 * abs(w[keep]):
        keep += 1
    w, y = w[:keep], y[:, :keep]
    return w, extract(y, mats, basis, w, extraction), its, history


def _jd(mats: list[Operator], basis: str, nev: int, which: str, target, tol: float, seed: int, most: int = 400):
    """A search space grown by Newton corrections; pairs found are held out of the choice."""
    rng, n = np.random.default_rng(seed), mats[0].n
    v, _ = np.linalg.qr(rng.standard_normal((n, min(n, 4))) + 0j)
    found, vectors = [], []
    for it in range(1, most + 1):
        w, y = dense.polyeig([v.conj().T @ m.apply(v) for m in mats], basis)
        ok = np.isfinite(w)
        w, y = w[ok], y[:, ok]
        at = order(w, which, 0.0 if target is None else target)
        pick = None
        for i in at:
            x = v @ y[:, i]
            if all(abs(w[i] - f) > 1e-6 * max(1, abs(f)) or abs(np.vdot(x, z)) < 0.9 for f, z in zip(found, vectors)):
                pick = i
                break
        if pick is None:
            t = rng.standard_normal(n) + 0j
        else:
            value, x = w[pick], v @ y[:, pick]
            r = evaluate(mats, basis, value).apply(x)
            if np.linalg.norm(r) <= tol * sum((m.norm or 1.0) * abs(p) for m, p in zip(mats, dense.basis_values(basis, len(mats) - 1, value))):
                found.append(value)
                vectors.append(x)
                if len(found) >= nev or v.shape[1] >= n:
                    break
                continue
            if n <= DENSE_ROWS:
                new, z = refine(mats, basis, value, x, 1)
                t = z
            else:
                t = r
        if v.shape[1] >= min(n, 60):
            keep = [v @ y[:, i] for i in at[:15]]
            v, _ = np.linalg.qr(np.stack(vectors + keep, 1))
        for _ in range(2):
            t = t - v @ (v.conj().T @ t)
        if np.linalg.norm(t) < 1e-12:
            t = rng.standard_normal(n) + 0j
            t = t - v @ (v.conj().T @ t)
        v = np.hstack([v, (t / np.linalg.norm(t))[:, None]])
    return np.array(found), np.stack(vectors, 1) if vectors else np.zeros((n, 0), complex), it
