"""Singular values: standard, generalised (of a pair) and hyperbolic (with a signature).

Tall frames never come to the driver: a Gram matrix, or the R of a tree of QRs, is all that leaves the tasks.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import dense
from ..matrix import DENSE_ROWS, Matrix, Operator, as_operator, transposed
from . import basis
from .eigen import eigs
from .parts import Normal, eigenpairs
from .transform import conjugate_gradient


@dataclass
class SingularResult:
    values: np.ndarray
    u: np.ndarray | None
    v: np.ndarray | None
    errors: np.ndarray
    solver: str
    iterations: int = 1
    reason: str = "tolerance"
    signature: np.ndarray | None = None
    history: list = field(default_factory=list)

    asked: int | None = None

    @property
    def nconv(self) -> int:
        """How many values have converged: those that are returned."""
        return len(self.values)

    def __post_init__(self):
        if self.asked is not None and self.nconv < self.asked:
            self.reason = "iterations"

    def singular(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(k, float(s), float(e)) for k, (s, e) in enumerate(zip(self.values, self.errors))], "k int, sigma double, errest double")

    def vectors(self, spark: SparkSession, side: str = "v") -> DataFrame:
        x = self.v if side == "v" else self.u
        if x is None:
            return spark.createDataFrame([], "k int, i long, x double")
        return spark.createDataFrame([(k, i, float(np.real(t))) for k in range(x.shape[1]) for i, t in enumerate(x[:, k])], "k int, i long, x double")


def frame_svd(rows: DataFrame, nsv: int | None = None, method: str = "cross") -> tuple[np.ndarray, np.ndarray]:
    """Singular values and right vectors of a tall frame (i, x array<double>): through its Gram matrix ("cross", one pass) or the R of a
    tree of QRs ("tsqr", one pass, small values keep their digits)."""
    if method == "cross":
        w, v = dense.hep(basis.gram(rows))
        w, v = np.sqrt(np.maximum(w[::-1], 0)), v[:, ::-1]
    else:
        r = basis.reduced(rows.select("x"), lambda b: np.linalg.qr(basis.rows_of(b), mode="r"), "qr")
        _, w, vh = np.linalg.svd(r)
        v = vh.conj().T
    k = len(w) if nsv is None else nsv
    return w[:k], v[:, :k]


def frame_randomized(rows: DataFrame, width: int, nsv: int, extra: int = 10, power: int = 1, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The same by random projection: A G, its basis, and the small matrix of A in it, a fixed number of passes."""
    k = min(width, nsv + extra)
    g = np.random.default_rng(seed).standard_normal((width, k))
    for _ in range(power + 1):
        # A^T A G in one pass
        held = rows.sparkSession.sparkContext.broadcast(g)
        y = basis.reduced(rows.select("x"), lambda b: (x := basis.rows_of(b)).T @ (x @ held.value))
        g, _ = np.linalg.qr(y)
    r = basis.reduced(basis.multiply(rows, g).select("x"), lambda b: np.linalg.qr(basis.rows_of(b), mode="r"), "qr")
    _, s, wh = np.linalg.svd(r)
    return s[:nsv], (g @ wh.conj().T)[:, :nsv]


@dataclass
class JointFactor:
    """[A; B] = [U diag(c); V diag(s)] inverse(X) for two tall frames, c^2 + s^2 = 1, by decreasing c / s. ``back`` has the rows of inverse(X)."""

    c: np.ndarray
    s: np.ndarray
    x: np.ndarray
    back: np.ndarray

    @property
    def values(self) -> np.ndarray:
        with np.errstate(divide="ignore"):
            return np.where(self.s > 1e-14, self.c / np.where(self.s > 1e-14, self.s, 1), np.inf)

    def product(self, weights: np.ndarray) -> np.ndarray:
        """The sum of weights times products of rows of inverse(X): A'A for c^2, B'B for s^2, A'A - B'B for their difference."""
        return (self.back.T * weights) @ self.back


def joint_factor(a: DataFrame, b: DataFrame) -> JointFactor:
    """Generalised singular values and right vectors of two tall frames (i, x array<double>) without a Gram matrix, so that conditions are not squared: R of the
    stacked pair from a tree of QRs, then the two small factors of A K and B K, with K the inverse of R, and their common cosine-sine decomposition. Two passes over
    the rows, which stay where they are. Directions in which the pair vanishes are left out."""
    both = a.select("x", F.lit(True).alias("top")).unionByName(b.select("x", F.lit(False).alias("top")))
    r = basis.reduced(both.select("x"), lambda t: np.linalg.qr(basis.rows_of(t), mode="r"), "qr")
    if r is None:
        return JointFactor(*[np.zeros(0)] * 2, np.zeros((0, 0)), np.zeros((0, 0)))
    _, size, wh = np.linalg.svd(r)
    rank = int((size > 1e-13 * size.max(initial=0)).sum())
    k = wh[:rank].T / size[:rank]
    held = both.sparkSession.sparkContext.broadcast(k)

    def square(x: np.ndarray) -> np.ndarray:
        f = np.linalg.qr(x, mode="r")
        return np.vstack([f, np.zeros((rank - len(f), rank))])

    def part(t) -> np.ndarray:
        x, top = basis.rows_of(t) @ held.value, t.column("top").to_numpy(zero_copy_only=False)
        return np.vstack([square(x[top]), square(x[~top])])

    f = basis.reduced(both, part, lambda p, q: np.vstack([square(np.vstack([p[:rank], q[:rank]])), square(np.vstack([p[rank:], q[rank:]]))]))
    _, c, w = np.linalg.svd(f[:rank])
    s = np.linalg.norm(f[rank:] @ w.T, axis=0)
    return JointFactor(c, s, k @ w.T, w @ (wh[:rank] * size[:rank, None]))


def frame_gsvd(a: DataFrame, b: DataFrame, nsv: int | None = None, which: str = "largest") -> SingularResult:
    """Generalised values c / s of two tall frames and right vectors X, by ``joint_factor``."""
    f = joint_factor(a, b)
    at = np.argsort(-f.values if which == "largest" else f.values, kind="stable")[:nsv]
    return SingularResult(f.values[at], None, f.x[:, at], np.abs(f.c[at] ** 2 + f.s[at] ** 2 - 1), "joint")


def frame_hsvd(a: DataFrame, b: DataFrame, nsv: int | None = None) -> SingularResult:
    """Hyperbolic values of the rows of ``a``, which count positive, on those of ``b``, which count negative, with their signs."""
    f = joint_factor(a, b)
    w, v = np.linalg.eigh(f.product(f.c**2 - f.s**2))
    at = np.argsort(-np.abs(w), kind="stable")[:nsv]
    return SingularResult(np.sqrt(np.abs(w[at])), None, v[:, at], np.zeros(len(at)), "joint", signature=np.where(w[at] < 0, -1.0, 1.0))


# --- solvers on operators: (values, u, v, iterations) ---------------------------------------------------


def _by_eigen(a: Operator, nsv: int, which: str, tol: float, ncv, seed: int, **o):
    """Eigenvalues of A^H A on the shorter side."""
    flip = a.rows < a.n
    n = a.rows if flip else a.n
    nsv = min(nsv, n)
    op = Operator(n, (lambda x: a.apply(a.adjoint(x))) if flip else (lambda x: a.adjoint(a.apply(x))), None, None, a.complex)
    r = eigs(op, nev=nsv, which="largest_real" if which == "largest" else "smallest_real", problem="hep", tol=tol, ncv=ncv, seed=seed, solver=o.get("eps", "krylovschur"))
    s = np.sqrt(np.maximum(r.values, 0))
    one = r.vectors
    other = (a.adjoint(one) if flip else a.apply(one)) / np.where(s > 0, s, 1)
    return (s, one, other, r.iterations) if flip else (s, other, one, r.iterations)


def _cyclic(a: Operator, nsv: int, which: str, tol: float, ncv, seed: int, **o):
    """Eigenvalues of [0 A; A^H 0]: plus and minus the singular values."""
    m, n = a.rows, a.n
    op = Operator(m + n, lambda x: np.concatenate([a.apply(x[m:]), a.adjoint(x[:m])]), None, None, a.complex)
    op.adjoint = op.apply
    if which == "largest":
        r = eigs(op, nev=nsv, which="largest_real", problem="hep", tol=tol, ncv=ncv, seed=seed)
    elif m + n <= DENSE_ROWS:
        r = eigs(op, nev=2 * nsv + abs(m - n), which="smallest_magnitude", problem="hep", tol=tol, solver="lapack", seed=seed)
        keep = np.flatnonzero(r.values > 1e-12 * max(np.abs(r.values).max(initial=0), 1e-300))[:nsv]
        r.values, r.vectors = r.values[keep], r.vectors[:, keep]
    else:
        return _by_eigen(a, nsv, which, tol, ncv, seed)
    x = r.vectors * np.sqrt(2)
    return r.values, x[:m], x[m:], r.iterations


def _lanczos(a: Operator, nsv: int, which: str, tol: float, ncv, seed: int, one_side: bool = False, most: int = 300, omega: np.ndarray | None = None, inner: Callable | None = None, **o):
    """Golub-Kahan bidiagonalisation with a thick restart; ``one_side`` leaves the left vectors unorthogonalised. With ``omega`` (+-1) the
    left vectors are orthonormal in that form and the answer ends with their signs; with ``inner`` the right ones are in that inner
    product, in which ``a.adjoint`` has to be the adjoint."""
    if a.rows < a.n and omega is None and inner is None:
        flip = Operator(a.rows, a.adjoint, a.apply, a.n, a.complex)
        s, u, v, it = _lanczos(flip, nsv, which, tol, ncv, seed, one_side, most)
        return s, v, u, it
    if which == "smallest" and omega is None and inner is None and not one_side and max(a.n, a.rows) <= DENSE_ROWS:
        return _inverse(a, nsv, tol, ncv, seed, most)
    n = a.n
    k = min(ncv or max(2 * nsv, 10), n, a.rows)
    kind = complex if a.complex else float
    v, u, b, sign = np.zeros((n, k + 1), kind), np.zeros((a.rows, k), kind), np.zeros((k, k), kind), np.ones(k)
    weight = (lambda x: x) if omega is None else (lambda x: omega * x)
    size = (lambda x: np.linalg.norm(x)) if inner is None else (lambda x: np.sqrt(max(np.vdot(x, inner(x)).real, 0)))
    v[:, 0] = np.random.default_rng(seed).standard_normal(n)
    v[:, 0] /= size(v[:, 0])
    have = 0
    for it in range(1, most + 1):
        beta, j = 0.0, have
        while j < k:
            w = a.apply(v[:, j])
            c = sign[:j] * (u[:, :j].conj().T @ weight(w))
            w = w - u[:, :j] @ c
            if not one_side:
                again = sign[:j] * (u[:, :j].conj().T @ weight(w))
                w, c = w - u[:, :j] @ again, c + again
            b[:j, j] = c
            value = np.vdot(w, weight(w)).real
            if omega is not None and np.vdot(w, w).real > 0 and abs(value) <= 1e-13 * np.vdot(w, w).real:
                raise ArithmeticError("the signature's form vanishes on a new vector: another start is needed")
            sign[j] = -1.0 if value < 0 else 1.0
            b[j, j] = np.sqrt(abs(value))
            u[:, j] = w / b[j, j] if b[j, j] > 1e-14 else 0
            z = a.adjoint(weight(u[:, j]))
            before = size(z)
            z, _ = basis.orthogonalise(z, v[:, : j + 1], inner)
            beta, j = size(z), j + 1
            if beta <= 1e-13 * max(before, 1e-300) or b[j - 1, j - 1] <= 1e-14:  # the space is closed
                beta = 0.0
                break
            v[:, j] = z / beta
        small = b[:j, :j]
        if omega is None:
            p, s, qh = np.linalg.svd(small)
            q, turned = qh.conj().T, np.ones(j)
        else:
            s, p, q, turned = dense.hsvd(small, sign[:j])
        at = np.arange(j) if which == "largest" else np.arange(j)[::-1]
        p, s, q, turned = p[:, at], s[at], q[:, at], turned[at]
        r = beta * np.abs(p[-1])
        if omega is not None:  # relative to lengths, which the form leaves open
            r = r / np.maximum(np.linalg.norm(u[:, :j] @ p, axis=0), 1e-300)
        good = r <= tol * np.maximum(s, 1e-300)
        nconv = int(np.argmin(np.append(good, False)))
        if nconv >= nsv or beta == 0 or it == most:
            m = min(nsv, j if beta == 0 else nconv)  # what has not converged is no answer
            out = s[:m], u[:, :j] @ p[:, :m], v[:, :j] @ q[:, :m], it
            return out if omega is None else (*out, turned[:m])
        have = min(nsv + max(1, (k - nsv) // 2), k - 1)
        v[:, :have], u[:, :have], sign[:have] = v[:, :k] @ q[:, :have], u @ p[:, :have], turned[:have]
        v[:, have] = v[:, k]
        b[:] = 0
        b[np.arange(have), np.arange(have)] = s[:have]
    raise AssertionError


def _inverse(a: Operator, nsv: int, tol: float, ncv, seed: int, most: int):
    """Smallest values as the largest of the inverse of R, which has A's values and right vectors; singular matrices by the dense decomposition."""
    q, r = np.linalg.qr(a.dense())
    size = np.abs(np.diag(r))
    if size.min(initial=np.inf) <= 1e-14 * size.max(initial=0):
        u, s, vh = np.linalg.svd(r)
        at = np.arange(len(s))[::-1][:nsv]
        return s[at], q @ u[:, at], vh.conj().T[:, at], 1
    inverse = np.linalg.inv(r)
    s, u, v, it = _lanczos(Operator(a.n, lambda x: inverse @ x, lambda x: inverse.conj().T @ x, a.n, a.complex), nsv, "largest", tol, ncv, seed, most=most)
    return 1 / s, q @ v, u, it


def _randomized(a: Operator, nsv: int, which: str, tol: float, ncv, seed: int, power: int = 2, **o):
    if which != "largest":
        raise ValueError("the randomised solver gives largest values only")
    k = min(a.n, a.rows, ncv or max(2 * nsv, nsv + 10))
    q, _ = np.linalg.qr(a.apply(np.random.default_rng(seed).standard_normal((a.n, k))))
    for it in range(1, 200):
        p, _ = np.linalg.qr(a.adjoint(q))
        q, t = np.linalg.qr(a.apply(p))
        u, s, wh = np.linalg.svd(t)
        v = p @ wh.conj().T
        r = np.linalg.norm(a.adjoint(q @ u[:, :nsv]) - v[:, :nsv] * s[:nsv], axis=0)
        if it >= power and (r <= tol * s[0]).all() or o.get("passes") == it:
            break
    return s[:nsv], q @ u[:, :nsv], v[:, :nsv], it


def _lapack(a: Operator, nsv: int, which: str, *rest, **o):
    u, s, vh = np.linalg.svd(a.dense(), full_matrices=False)
    at = np.arange(nsv) if which == "largest" else np.arange(len(s))[::-1][:nsv]
    return s[at], u[:, at], vh.conj().T[:, at], 1


SOLVERS: dict[str, Callable] = {"cross": _by_eigen, "cyclic": _cyclic, "lanczos": _lanczos, "trlanczos": _lanczos, "randomized": _randomized, "lapack": _lapack}
ALIASES = {"elemental": "lapack", "scalapack": "lapack", "ksvd": "lapack", "primme": "cross"}


def register(name: str, solver: Callable) -> None:
    SOLVERS[name] = solver


def svds(A, B=None, omega: np.ndarray | None = None, nsv: int = 1, which: str = "largest", solver: str = "cross", ncv: int | None = None, tol: float = 1e-8, seed: int = 0, error: str = "relative", **options) -> SingularResult:
    """Singular triplets of A; with ``B`` those of the pair (ratios c / s); with ``omega`` (+-1) the hyperbolic ones."""
    if which not in ("largest", "smallest"):
        raise ValueError(f"no such order: {which}")
    name = ALIASES.get(solver, solver)
    if name == "cross" and B is None and omega is None and isinstance(A, Matrix) and not A.complex and max(A.rows, A.cols) > DENSE_ROWS >= min(A.rows, A.cols):
        return _by_gram(A, nsv, which, solver)
    a = as_operator(A)
    if name not in SOLVERS:
        raise ValueError(f"no such solver: {solver}")
    if B is not None:
        return gsvds(A, B, nsv, which, solver if solver in ("lapack", "trlanczos") else None, ncv, tol, seed, options.get("bidiagonalisation", "upper"))
    if omega is not None:
        return hsvds(a, omega, nsv, which, solver if solver in ("lapack", "trlanczos") else None, ncv, tol, seed)
    nsv = min(nsv, a.n, a.rows)
    s, u, v, it = SOLVERS[name](a, nsv, which, tol, ncv, seed, **options)
    e = np.hypot(np.linalg.norm(a.apply(v) - u * s, axis=0), np.linalg.norm(a.adjoint(u) - v * s, axis=0))
    if error == "relative":
        e = e / np.maximum(s, 1e-300) / np.sqrt(2)
    elif error == "norm":
        e = e / (a.norm or max(s.max(initial=0), 1e-300))
    return SingularResult(s, u, v, e, solver, it, asked=nsv)


def gsvds(A, B, nsv: int = 1, which: str = "largest", solver: str | None = None, ncv: int | None = None, tol: float = 1e-8, seed: int = 0, bidiagonalisation: str = "upper") -> SingularResult:
    """Generalised values c / s of a pair, and right vectors X with (A x)^2 + (B x)^2 = 1.

    "lapack": dense, or through Gram matrices where the parts are tall and have up to DENSE_ROWS columns; "trlanczos": a thick-restarted
    Lanczos process in the inner product of A'A + B'B, at any size; without a name, the first up to DENSE_ROWS columns.
    ``bidiagonalisation`` of the second: "upper" and "single" work on A, of which "single" gives no left vectors of B; "lower" on B."""
    solver = solver or ("lapack" if min(_columns(A), _columns(B)) <= DENSE_ROWS else "trlanczos")
    if solver == "trlanczos":
        return _gsvd_lanczos(as_operator(A), as_operator(B), nsv, which, ncv, tol, seed, bidiagonalisation)
    if isinstance(A, Matrix) and isinstance(B, Matrix) and max(A.rows, B.rows) > DENSE_ROWS:
        # Gram matrices stand for tall parts, which stay where they are
        fa, fb = _gram(A), _gram(B)
        w, x = dense.ghep(fa, fa + fb)
        c, s = np.sqrt(np.clip(w, 0, 1)), np.sqrt(np.clip(1 - w, 0, 1))
        at = np.argsort(-c, kind="stable")
        c, s, x, u, v = c[at], s[at], x[:, at], None, None
    else:
        c, s, u, v, x = dense.gsvd(as_operator(A).dense() if not isinstance(A, np.ndarray) else A, as_operator(B).dense() if not isinstance(B, np.ndarray) else B)
    with np.errstate(divide="ignore"):
        values = np.where(s > 1e-14, c / np.where(s > 1e-14, s, 1), np.inf)
    at = np.arange(len(values))[:nsv] if which == "largest" else np.arange(len(values))[::-1][:nsv]
    e = np.zeros(len(at))
    if u is not None:
        a, b = as_operator(A), as_operator(B)
        e = np.hypot(np.linalg.norm(a.apply(x[:, at]) - u[:, at] * c[at], axis=0), np.linalg.norm(b.apply(x[:, at]) - v[:, at] * s[at], axis=0))
    return SingularResult(values[at], None if u is None else u[:, at], x[:, at], e, solver)


def _columns(a) -> int:
    return a.cols if isinstance(a, Matrix) else a.n if isinstance(a, Operator) else np.asarray(a).shape[1]


def _gsvd_lanczos(a: Operator, b: Operator, nsv: int, which: str, ncv, tol: float, seed: int, bidiagonalisation: str) -> SingularResult:
    """With K = A'A + B'B, the map A from the inner product of K has the values c, and its adjoint is K^-1 A', by conjugate gradients."""
    if bidiagonalisation not in ("single", "upper", "lower"):
        raise ValueError(f"no such bidiagonalisation: {bidiagonalisation}")
    inner = lambda x: a.adjoint(a.apply(x)) + b.adjoint(b.apply(x))
    first = b if bidiagonalisation == "lower" else a
    pull = lambda y: conjugate_gradient(inner, first.adjoint(y), tol=1e-13, most=10 * a.n)
    flipped = {"largest": "smallest", "smallest": "largest"}[which] if first is b else which
    op = Operator(a.n, first.apply, pull, first.rows, a.complex or b.complex)
    nsv = min(nsv, a.n, first.rows)
    _, _, x, it = _lanczos(op, nsv, flipped, tol, ncv or max(2 * nsv, nsv + 15), seed, inner=inner)
    ax, bx = a.apply(x), b.apply(x)
    c, s = np.linalg.norm(ax, axis=0), np.linalg.norm(bx, axis=0)
    with np.errstate(divide="ignore"):
        values = np.where(s > 1e-14, c / np.where(s > 1e-14, s, 1), np.inf)
    # s^2 A'A x = c^2 B'B x
    e = np.linalg.norm(s**2 * a.adjoint(ax) - c**2 * b.adjoint(bx), axis=0) / np.maximum(np.linalg.norm(inner(x), axis=0), 1e-300)
    at = np.argsort(-values if which == "largest" else values, kind="stable")
    return SingularResult(values[at], (ax / np.where(c > 0, c, 1))[:, at], x[:, at], e[at], "trlanczos", it, asked=nsv)


def _gram(a: Matrix) -> np.ndarray:
    """A^T A of a matrix with few columns, by one join."""
    from ..matrix import gram_frame

    return Matrix(gram_frame(a.df), a.cols, a.cols).dense()


def _by_gram(A: Matrix, nsv: int, which: str, solver: str) -> SingularResult:
    """The explicit product on the short side: one join and one sum, instead of two jobs a Krylov step."""
    flip = A.rows < A.cols
    w, x = dense.hep(_gram(A.T if flip else A))
    at = np.arange(len(w))[::-1][:nsv] if which == "largest" else np.arange(len(w))[:nsv]
    s, x = np.sqrt(np.maximum(w[at], 0)), x[:, at]
    y = (A.adjoint(x) if flip else A.apply(x)) / np.where(s > 0, s, 1)
    back = A.apply(y) if flip else A.adjoint(y)
    A.unpersist()
    e = np.linalg.norm(back - x * s, axis=0) / np.maximum(s, 1e-300) / np.sqrt(2)
    return SingularResult(s, x if flip else y, y if flip else x, e, solver)


def tall_svd(df: DataFrame, rows: int, cols: int, nsv: int = 1, tol: float = 5e-8, block: int | None = None) -> SingularResult:
    """Largest singular values of a sparse real frame (i, j, v) of any length and width from a block Krylov space of A'A, or of AA' if that is smaller, that stays with
    the executors. The frame is read several times. Raises where they have not converged; ``tol`` is relative to the largest value's square."""
    parts = Normal(df, rows, cols) if rows >= cols else Normal(transposed(df), cols, rows)
    # values at the edge of a dense spectrum lie the closer, the longer the short side is: a wide basis, and as many steps as it takes
    found = eigenpairs(parts, nev=nsv, which="largest_real", tol=tol, block=block, ncv=max(96, 8 * nsv), most=4000).checked()
    parts.unpersist()
    s = np.sqrt(np.maximum(found.values, 0))
    return SingularResult(s, None, None, found.residuals / np.maximum(found.values, 1e-300), "tall", found.steps)


def hsvds(a: Operator, omega: np.ndarray, nsv: int = 1, which: str = "largest", solver: str | None = None, ncv: int | None = None, tol: float = 1e-8, seed: int = 0) -> SingularResult:
    """Values of A with left vectors orthonormal in the signature ``omega``, and their signs. "lapack": dense; "cross": eigenvalues of
    A' Omega A, product by product; "trlanczos": a thick-restarted bidiagonalisation (largest values converge first); without a name, the
    first up to DENSE_ROWS columns and the second beyond."""
    a, omega = as_operator(a), np.asarray(omega, float)
    solver = solver or ("lapack" if a.n <= DENSE_ROWS else "cross")
    weight = lambda x: x * (omega if x.ndim == 1 else omega[:, None])
    it, nsv = 1, min(nsv, a.n)
    if solver == "trlanczos":
        s, u, v, it, sign = _lanczos(a, nsv, which, tol, ncv, seed, omega=omega)
    elif solver == "cross":
        op = Operator(a.n, lambda x: a.adjoint(weight(a.apply(x))), None, None, a.complex)
        op.adjoint = op.apply
        r = eigs(op, nev=nsv, which="largest_magnitude" if which == "largest" else "smallest_magnitude", problem="hep", tol=tol, ncv=ncv, seed=seed)
        s, v, sign, it = np.sqrt(np.abs(r.values)), r.vectors, np.where(r.values < 0, -1.0, 1.0), r.iterations
        u = a.apply(v) / np.where(s > 0, s, 1)
    elif solver == "lapack":
        s, u, v, sign = dense.hsvd(a.dense(), omega)
        at = np.arange(len(s))[:nsv] if which == "largest" else np.arange(len(s))[::-1][:nsv]
        s, u, v, sign = s[at], u[:, at], v[:, at], sign[at]
    else:
        raise ValueError(f"no such solver: {solver}")
    e = np.hypot(np.linalg.norm(a.apply(v) - u * s, axis=0), np.linalg.norm(a.adjoint(weight(u)) - v * (s * sign), axis=0))
    return SingularResult(s, u, v, e / np.maximum(s, 1e-300), solver, it, signature=sign, asked=nsv)
