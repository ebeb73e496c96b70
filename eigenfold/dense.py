"""Small dense problems on the driver, with numpy only: the projected problems of all solvers."""

from __future__ import annotations

import math

import numpy as np

# --- matrix functions ---------------------------------------------------------------------

#: Padé degree and the 1-norm up to which it is accurate to double precision (fixed values of the scaling and squaring method).
PADE_LIMITS = {3: 1.495585217958292e-2, 5: 2.539398330063230e-1, 7: 9.504178996162932e-1, 9: 2.097847961257068e0, 13: 5.371920351148152e0}


def _pade(a: np.ndarray, m: int) -> np.ndarray:
    """The diagonal Padé approximant of exp of degree m."""
    c = [math.factorial(2 * m - j) * math.factorial(m) / (math.factorial(2 * m) * math.factorial(j) * math.factorial(m - j)) for j in range(m + 1)]
    n = len(a)
    a2, even, odd = a @ a, np.zeros_like(a), np.zeros_like(a)
    power = np.eye(n, dtype=a.dtype)
    for j in range(0, m + 1, 2):
        even = even + c[j] * power
        if j + 1 <= m:
            odd = odd + c[j + 1] * power
        power = power @ a2
    odd = a @ odd
    return np.linalg.solve(even - odd, even + odd)


def expm(a: np.ndarray, method: str = "higham") -> np.ndarray:
    """exp(A) by scaling and squaring: the cheapest adequate degree, degree 6 always ("pade"), or degrees 6 over 7 in partial
    fractions ("subdiagonal")."""
    a = np.asarray(a)
    a = a.astype(complex if np.iscomplexobj(a) else float)
    norm = np.abs(a).sum(0).max() if a.size else 0.0
    if method == "subdiagonal":
        return _subdiagonal(a, norm)
    if method == "higham":
        for m, limit in PADE_LIMITS.items():
            if norm <= limit:
                return _pade(a, m)
        squarings, m = max(0, math.ceil(math.log2(norm / PADE_LIMITS[13]))), 13
    else:
        squarings, m = max(0, math.ceil(math.log2(max(norm, 1e-300))) + 1), 6
    x = _pade(a / 2**squarings, m)
    for _ in range(squarings):
        x = x @ x
    return x


def _subdiagonal(a: np.ndarray, norm: float, k: int = 6, m: int = 7) -> np.ndarray:
    """The approximant of degrees k over m as a sum of resolvents at its poles."""
    f = math.factorial
    top = [f(k + m - j) * f(k) / (f(k + m) * f(j) * f(k - j)) for j in range(k, -1, -1)]
    below = [(-1) ** j * f(k + m - j) * f(m) / (f(k + m) * f(j) * f(m - j)) for j in range(m, -1, -1)]
    poles = np.roots(below)
    weights = np.polyval(top, poles) / np.polyval(np.polyder(below), poles)
    squarings = max(0, math.ceil(math.log2(max(norm, 1e-300))))
    eye, x = np.eye(len(a)), a / 2**squarings
    x = sum(w * np.linalg.solve(x - p * eye, eye) for w, p in zip(weights, poles))
    x = x if np.iscomplexobj(a) else x.real
    for _ in range(squarings):
        x = x @ x
    return x


def phim(a: np.ndarray, k: int) -> np.ndarray:
    """phi_k(A), read from the exponential of a block matrix."""
    n = len(a)
    if k == 0:
        return expm(a)
    big = np.zeros(((k + 1) * n,) * 2, np.asarray(a).dtype if np.iscomplexobj(a) else float)
    big[:n, :n] = a
    for j in range(k):
        big[j * n : (j + 1) * n, (j + 1) * n : (j + 2) * n] = np.eye(n)
    return expm(big)[:n, k * n :]


def schur(a: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Complex Schur form T and unitary Q with A = Q T Q^H, by the shifted QR iteration on the Hessenberg form."""
    t = np.array(a, complex)
    n = len(t)
    q = np.eye(n, dtype=complex)
    for k in range(n - 2):
        v = t[k + 1 :, k].copy()
        norm = np.linalg.norm(v)
        if norm == 0:
            continue
        v[0] += (v[0] / abs(v[0]) if v[0] != 0 else 1) * norm
        v /= np.linalg.norm(v)
        t[k + 1 :] -= 2 * np.outer(v, v.conj() @ t[k + 1 :])
        t[:, k + 1 :] -= 2 * np.outer(t[:, k + 1 :] @ v, v.conj())
        q[:, k + 1 :] -= 2 * np.outer(q[:, k + 1 :] @ v, v.conj())
    hi, count = n - 1, 0
    eps = np.finfo(float).eps
    while hi > 0:
        lo = hi
        while lo > 0 and abs(t[lo, lo - 1]) > eps * (abs(t[lo, lo]) + abs(t[lo - 1, lo - 1]) or np.abs(t).max()):
            lo -= 1
        if lo > 0:
            t[lo, lo - 1] = 0
        if lo == hi:
            hi, count = hi - 1, 0
            continue
        count += 1
        if count > sweeps:
            raise np.linalg.LinAlgError("the QR iteration did not settle")
        b = t[hi - 1 : hi + 1, hi - 1 : hi + 1]
        if count % 11 == 10:
            shift = abs(t[hi, hi - 1]) + abs(t[hi - 1, max(hi - 2, 0)])
        else:
            w = np.linalg.eigvals(b)
            shift = w[np.abs(w - t[hi, hi]).argmin()]
        x = t[lo, lo] - shift
        y = t[lo + 1, lo]
        for k in range(lo, hi):
            r = math.hypot(abs(x), abs(y))
            g = np.array([[np.conj(x), np.conj(y)], [-y, x]]) / r if r else np.eye(2)
            first = max(k - 1, lo)
            t[k : k + 2, first:] = g @ t[k : k + 2, first:]
            last = min(k + 3, hi + 1)
            t[:last, k : k + 2] = t[:last, k : k + 2] @ g.conj().T
            q[:, k : k + 2] = q[:, k : k + 2] @ g.conj().T
            if k < hi - 1:
                x, y = t[k + 1, k], t[k + 2, k]
    return np.triu(t), q


def reorder(t: np.ndarray, q: np.ndarray, selected: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Moves the selected eigenvalues of a complex Schur form to the front, by swapping neighbours."""
    t, q, wanted = t.copy(), q.copy(), np.array(selected, bool)
    place = 0
    for i in range(len(t)):
        if not wanted[i]:
            continue
        for k in range(i - 1, place - 1, -1):
            x = np.array([t[k, k + 1], t[k + 1, k + 1] - t[k, k]])
            r = np.linalg.norm(x)
            if r > 0:
                c, s = x / r
                g = np.array([[c, -np.conj(s)], [s, np.conj(c)]])
                t[:, k : k + 2] = t[:, k : k + 2] @ g
                t[k : k + 2] = g.conj().T @ t[k : k + 2]
                q[:, k : k + 2] = q[:, k : k + 2] @ g
                t[k + 1, k] = 0
            else:
                t[:, [k, k + 1]] = t[:, [k + 1, k]]
                t[[k, k + 1]] = t[[k + 1, k]]
                q[:, [k, k + 1]] = q[:, [k + 1, k]]
        place += 1
    return t, q


def _tidy(x: np.ndarray, like: np.ndarray) -> np.ndarray:
    """Real if what it came from is real and the imaginary part is noise."""
    if not np.iscomplexobj(like) and np.abs(x.imag).max(initial=0) <= 1e-10 * max(1.0, np.abs(x).max(initial=0)):
        return x.real.copy()
    return x


def sqrtm(a: np.ndarray, method: str = "schur", steps: int = 100) -> np.ndarray:
    """The principal square root: "schur", "db" (Denman-Beavers, product form), "ns" (Newton-Schulz) or "sadeghi"."""
    a = np.asarray(a)
    if method == "schur":
        t, q = schur(a)
        n = len(t)
        r = np.zeros_like(t)
        for j in range(n):
            r[j, j] = np.sqrt(t[j, j])
            for i in range(j - 1, -1, -1):
                bottom = r[i, i] + r[j, j]
                r[i, j] = (t[i, j] - r[i, i + 1 : j] @ r[i + 1 : j, j]) / bottom if bottom != 0 else 0
        return _tidy(q @ r @ q.conj().T, a)
    return _root_pair(a, method, steps)[0]


def invsqrtm(a: np.ndarray, method: str = "schur", steps: int = 100) -> np.ndarray:
    if method == "schur":
        return np.linalg.inv(sqrtm(a))
    return _root_pair(a, method, steps)[1]


def _root_pair(a: np.ndarray, method: str, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """The square root and its inverse by iterations."""
    n, eye = len(a), np.eye(len(a))
    if method == "db":
        m, x = np.array(a, complex if np.iscomplexobj(a) else float), np.array(a, complex if np.iscomplexobj(a) else float)
        y = eye.astype(m.dtype)
        for _ in range(steps):
            inverse = np.linalg.inv(m)
            g = abs(np.linalg.det(m)) ** (-1 / (2 * n)) if np.linalg.norm(m - eye) > 1e-2 else 1.0
            x, y = 0.5 * g * x @ (eye + inverse / g**2), 0.5 * g * y @ (eye + inverse / g**2)
            m = 0.5 * (eye + (g**2 * m + inverse / g**2) / 2)
            if np.linalg.norm(m - eye) <= 1e-14 * n:
                break
        return x, y
    scale = np.linalg.norm(a, 2) if method == "ns" else np.linalg.norm(a, "fro")
    y, z = np.asarray(a) / scale, eye.astype(np.asarray(a).dtype if np.iscomplexobj(a) else float)
    for _ in range(steps):
        if method == "ns":
            t = (3 * eye - z @ y) / 2
        elif method == "sadeghi":  # a third-order iteration of the same pair
            e = eye - z @ y
            t = eye + e / 2 + 3 / 8 * e @ e
        else:
            raise ValueError(f"no such method: {method}")
        y, z = y @ t, t @ z
        if np.linalg.norm(t - eye) <= 1e-15 * n:
            break
    return y * math.sqrt(scale), z / math.sqrt(scale)


def logm(a: np.ndarray) -> np.ndarray:
    """The principal logarithm: square roots of the Schur form until it is near the identity, then Gauss-Legendre
    quadrature of the integral form (a Padé approximant of log(1 + x))."""
    t, q = schur(a)
    n, roots = len(t), 0
    eye = np.eye(n)
    while np.abs(t - eye).sum(0).max() > 0.25 and roots < 60:
        t, roots = np.triu(sqrtm_upper(t)), roots + 1
    x, w = np.polynomial.legendre.leggauss(12)
    x, w = (x + 1) / 2, w / 2
    y = sum(wi * np.linalg.solve(eye + xi * (t - eye), t - eye) for xi, wi in zip(x, w))
    return _tidy(q @ (2**roots * y) @ q.conj().T, np.asarray(a))


def sqrtm_upper(t: np.ndarray) -> np.ndarray:
    r = np.zeros_like(t)
    for j in range(len(t)):
        r[j, j] = np.sqrt(t[j, j])
        for i in range(j - 1, -1, -1):
            r[i, j] = (t[i, j] - r[i, i + 1 : j] @ r[i + 1 : j, j]) / (r[i, i] + r[j, j])
    return r


# --- eigenvalue and singular value problems -------------------------------------------------


def hep(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.linalg.eigh((a + a.conj().T) / 2)


def ghep(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A x = w B x with B positive definite; vectors are B-orthonormal."""
    l = np.linalg.cholesky((b + b.conj().T) / 2)
    c = np.linalg.solve(l, np.linalg.solve(l, (a + a.conj().T).T.conj() / 2).conj().T)
    w, q = hep(c)
    return w, np.linalg.solve(l.conj().T, q)


def nhep(a: np.ndarray, left: bool = False):
    w, x = np.linalg.eig(a)
    return (w, x, np.linalg.inv(x).conj().T) if left else (w, x)


def gnhep(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A x = w B x. A singular B gives infinite eigenvalues: the pencil is solved about a shift."""
    n = len(a)
    rank = np.linalg.matrix_rank(b)
    if rank == n and np.linalg.cond(b) < 1e12:
        return np.linalg.eig(np.linalg.solve(b, a))
    rng = np.random.default_rng(1)
    scale = np.linalg.norm(a) / max(np.linalg.norm(b), 1e-300)
    sigma = scale * (0.7 + 0.4 * rng.random()) * np.exp(1j * rng.random())
    theta, x = np.linalg.eig(np.linalg.solve(a - sigma * b, b))
    with np.errstate(divide="ignore", invalid="ignore"):
        w = np.where(np.abs(theta) > 1e-13 * np.abs(theta).max(initial=1e-300), sigma + 1 / np.where(theta == 0, 1, theta), np.inf)
    return w, x


def _reflection(x: np.ndarray) -> tuple[np.ndarray, float]:
    """v and tau with (I - tau v v^H) x along the first unit vector."""
    v, size = x.astype(np.result_type(x, float)).copy(), np.linalg.norm(x)
    if size == 0 or not np.abs(x[1:]).any():
        return v, 0.0
    v[0] += size * (x[0] / abs(x[0]) if x[0] != 0 else 1.0)
    return v, 2.0 / np.vdot(v, v).real


def tridiagonalised(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """T, Q with A = Q T Q^H and T tridiagonal, for a Hermitian A such as the arrow that a thick restart leaves. Rows are taken from
    the last on, so that the last vector of Q is the unit vector and the residual's row stays alone."""
    t, n = a.astype(np.result_type(a, float)).copy(), len(a)
    q = np.eye(n, dtype=t.dtype)
    for k in range(n - 1, 1, -1):
        v, tau = _reflection(t[:k, k][::-1])
        v = v[::-1]
        if tau:
            t[:k] -= tau * np.outer(v, v.conj() @ t[:k])
            t[:, :k] -= tau * np.outer(t[:, :k] @ v, v.conj())
            q[:, :k] -= tau * np.outer(q[:, :k] @ v, v.conj())
    return np.triu(np.tril(t, 1), -1), q


def bidiagonalised(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """B, P, Q with A = P B Q^H and B upper bidiagonal, for a square A."""
    b, n = a.astype(np.result_type(a, float)).copy(), len(a)
    p, q = np.eye(n, dtype=b.dtype), np.eye(n, dtype=b.dtype)
    for k in range(n - 1):
        v, tau = _reflection(b[k:, k])
        if tau:
            b[k:] -= tau * np.outer(v, v.conj() @ b[k:])
            p[:, k:] -= tau * np.outer(p[:, k:] @ v, v.conj())
        v, tau = _reflection(b[k, k + 1 :].conj())
        if tau:
            b[:, k + 1 :] -= tau * np.outer(b[:, k + 1 :] @ v, v.conj())
            q[:, k + 1 :] -= tau * np.outer(q[:, k + 1 :] @ v, v.conj())
    return np.triu(np.tril(b, 1)), p, q


def ghiep(a: np.ndarray, omega: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A x = w Omega x with a signature Omega (its diagonal, or a matrix)."""
    b = np.diag(omega) if omega.ndim == 1 else omega
    return np.linalg.eig(np.linalg.solve(b, a))


def gsvd(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """c, s, U, V, X with A X = U diag(c), B X = V diag(s), c^2 + s^2 = 1, by decreasing c / s."""
    m = len(a)
    q, r = np.linalg.qr(np.vstack([a, b]))
    u, c, wh = np.linalg.svd(q[:m], full_matrices=False)
    vs = q[m:] @ wh.conj().T
    s = np.linalg.norm(vs, axis=0)
    v = vs / np.where(s > 1e-14, s, 1)
    return c, s, u, v, np.linalg.solve(r, wh.conj().T)


def hsvd(a: np.ndarray, omega: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """sigma, U, V and the new signature with A = U diag(sigma) V^H, U^H Omega U = signature."""
    w, v = hep(a.conj().T @ (omega[:, None] * a))
    sigma = np.sqrt(np.abs(w))
    at = np.argsort(-sigma, kind="stable")
    sigma, v, sign = sigma[at], v[:, at], np.where(w[at] < 0, -1.0, 1.0)
    return sigma, (a @ v) / np.where(sigma > 0, sigma, 1), v, sign


# --- polynomial and nonlinear -------------------------------------------------------------

BASES = ("monomial", "chebyshev1", "chebyshev2", "legendre", "laguerre", "hermite")


def recurrence(basis: str, degree: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """a, b, g with x p_j = a_j p_{j+1} + b_j p_j + g_j p_{j-1}."""
    j = np.arange(degree, dtype=float)
    if basis == "monomial":
        return np.ones(degree), np.zeros(degree), np.zeros(degree)
    if basis == "chebyshev1":
        return np.where(j == 0, 1.0, 0.5), np.zeros(degree), np.where(j == 0, 0.0, 0.5)
    if basis == "chebyshev2":
        return np.full(degree, 0.5), np.zeros(degree), np.where(j == 0, 0.0, 0.5)
    if basis == "legendre":
        return (j + 1) / (2 * j + 1), np.zeros(degree), j / (2 * j + 1)
    if basis == "laguerre":
        return -(j + 1), 2 * j + 1, -j
    if basis == "hermite":
        return np.full(degree, 0.5), np.zeros(degree), j
    raise ValueError(f"no such basis: {basis}")


def basis_values(basis: str, degree: int, x) -> list:
    """p_0(x) ... p_degree(x); x is a number or a square matrix."""
    a, b, g = recurrence(basis, degree)
    square = np.ndim(x) == 2
    one = np.eye(len(x)) if square else 1.0
    p = [one]
    for j in range(degree):
        step = (x @ p[j] if square else x * p[j]) - b[j] * p[j] - (g[j] * p[j - 1] if j else 0)
        p.append(step / a[j])
    return p


def basis_slopes(basis: str, degree: int, x) -> list:
    a, b, g = recurrence(basis, degree)
    p, d = basis_values(basis, degree, x), [0.0]
    for j in range(degree):
        d.append((p[j] + (x - b[j]) * d[j] - (g[j] * d[j - 1] if j else 0)) / a[j])
    return d


def companion(mats: list[np.ndarray], basis: str = "monomial") -> tuple[np.ndarray, np.ndarray]:
    """L0, L1 whose pencil L0 y = x L1 y has the eigenvalues of sum p_j(x) A_j; y stacks p_j(x) v."""
    d, n = len(mats) - 1, len(mats[0])
    a, b, g = recurrence(basis, d)
    kind = complex if any(map(np.iscomplexobj, mats)) else float
    l0, l1 = np.zeros((d * n, d * n), kind), np.eye(d * n, dtype=kind)
    block = lambda i: slice(i * n, (i + 1) * n)
    for j in range(d - 1):
        l0[block(j), block(j + 1)] = a[j] * np.eye(n)
        l0[block(j), block(j)] = b[j] * np.eye(n)
        if j:
            l0[block(j), block(j - 1)] = g[j] * np.eye(n)
    # the last row: p_d from the recurrence, with A_d p_d = -sum of the others
    k = d - 1
    l1[block(k), block(k)] = mats[d]
    for j in range(d):
        l0[block(k), block(j)] = -a[k] * mats[j]
    l0[block(k), block(k)] += b[k] * mats[d]
    if k:
        l0[block(k), block(k - 1)] += g[k] * mats[d]
    return l0, l1


def symmetric_linearisations(mats: list[np.ndarray], kind: str = "symmetric") -> tuple[np.ndarray, np.ndarray]:
    """Pencils of a quadratic (K, C, M) that keep symmetry or Hamiltonian structure."""
    k, c, m = mats
    o, i = np.zeros_like(k), np.eye(len(k))
    if kind == "symmetric":
        return np.block([[-k, o], [o, m]]), np.block([[c, m], [m, o]])
    if kind == "hamiltonian":
        return np.block([[o, -k], [m, o]]), np.block([[m, c], [o, m]])
    if kind == "nonsymmetric":
        return np.block([[o, i], [-k, -c]]), np.block([[i, o], [o, m]])
    raise ValueError(f"no such linearisation: {kind}")


def polyeig(mats: list[np.ndarray], basis: str = "monomial") -> tuple[np.ndarray, np.ndarray]:
    w, y = gnhep(*companion(mats, basis))
    n = len(mats[0])
    x = y.reshape(len(mats) - 1, n, -1)
    pick = np.linalg.norm(x, axis=1).argmax(0)
    v = x[pick, :, np.arange(x.shape[2])].T
    return w, v / np.linalg.norm(v, axis=0)


def lyapunov(a: np.ndarray, c: np.ndarray) -> np.ndarray:
    """X with A X + X A^H = -C, by the Schur form of A."""
    t, q = schur(a)
    f = -(q.conj().T @ c @ q)
    n = len(t)
    y = np.zeros((n, n), complex)
    for k in range(n - 1, -1, -1):
        rhs = f[:, k] - y[:, k + 1 :] @ t[k, k + 1 :].conj()
        y[:, k] = np.linalg.solve(t + np.conj(t[k, k]) * np.eye(n), rhs)
    x = q @ y @ q.conj().T
    return x if np.iscomplexobj(a) or np.iscomplexobj(c) else x.real


def rank_svd(x: np.ndarray, tol: float = 1e-12) -> tuple[np.ndarray, int]:
    """A factor L with X = L L^H of a positive semidefinite matrix, and its rank."""
    w, q = hep(x)
    keep = w > tol * max(w.max(initial=0), 1e-300)
    return q[:, keep] * np.sqrt(w[keep]), int(keep.sum())


def inertia(a: np.ndarray) -> tuple[int, int, int]:
    """Numbers of negative, zero and positive eigenvalues of a Hermitian matrix."""
    w = np.linalg.eigvalsh((a + a.conj().T) / 2)
    tol = 1e-12 * max(np.abs(w).max(initial=0), 1e-300)
    return int((w < -tol).sum()), int((np.abs(w) <= tol).sum()), int((w > tol).sum())


def aaa(f: np.ndarray, z: np.ndarray, tol: float = 1e-13, most: int = 100) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Support points, values and weights of a barycentric rational approximation, chosen greedily."""
    left = np.ones(len(z), bool)
    approx = np.full(len(z), f.mean(), complex)
    support: list[int] = []
    w = np.ones(1, complex)
    for _ in range(min(most, len(z) - 1)):
        j = int(np.where(left, np.abs(f - approx), -1).argmax())
        support.append(j)
        left[j] = False
        c = 1 / (z[left, None] - z[support][None, :])
        loewner = (f[left, None] - f[support][None, :]) * c
        w = np.linalg.svd(loewner)[2][-1].conj()
        approx = f.astype(complex).copy()
        approx[left] = (c @ (w * f[support])) / (c @ w)
        if np.abs(f - approx).max() <= tol * np.abs(f).max():
            break
    return z[support], f[support], w


def aaa_poles(z: np.ndarray, w: np.ndarray) -> np.ndarray:
    m = len(z)
    e = np.zeros((m + 1, m + 1), complex)
    e[0, 1:], e[1:, 0] = w, 1
    e[1:, 1:] = np.diag(z)
    b = np.eye(m + 1)
    b[0, 0] = 0
    poles, _ = gnhep(e, b)
    return poles[np.isfinite(poles) & (np.abs(poles) < 1e8 * max(1.0, np.abs(z).max()))]


def leja_bagby(targets: np.ndarray, poles: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Interpolation points from ``targets``, poles from ``poles`` and scalings, each pair the greedy maximum and minimum of the rational node function."""
    sigma, xi, beta = [targets[0]], [poles[0] if len(poles) else np.inf], [1.0]
    node_t, node_p = np.ones(len(targets), complex), np.zeros(max(len(poles), 1))  # the poles' as logarithms
    for _ in range(1, n):
        bottom = lambda x: 1 - x / xi[-1] if np.isfinite(xi[-1]) and xi[-1] != 0 else np.ones_like(x)
        node_t = node_t * (targets - sigma[-1]) / (beta[-1] * bottom(targets))
        i = int(np.abs(node_t).argmax())
        sigma.append(targets[i])
        if len(poles) and np.isfinite(poles).any():
            log = lambda x: np.log(np.maximum(np.abs(x), 1e-300))
            node_p = node_p + log(poles - sigma[-2]) - log(beta[-1]) - log(bottom(poles))
            xi.append(poles[int(node_p.argmin())])
        else:
            xi.append(np.inf)
        beta.append(float(max(np.abs(node_t).max(), 1e-300)))
    return np.array(sigma), np.array(xi), np.array(beta)
