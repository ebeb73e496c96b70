"""Krylov spaces with a thick restart over bases of several kinds.

A space holds its basis vectors in its own way and grows by one at a time: ``Plain`` as columns; ``Compact``, for polynomials of degree d, as
coordinates in one orthonormal basis that all d blocks share, which takes a d-th of the memory. Either is made orthonormal in the plain
inner product or in an indefinite form, whose signs are then kept beside the projected matrix.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from .. import dense
from ..matrix import Operator
from .basis import arnoldi
from .transform import combination, solver_for

BREAKDOWN = 1e-13


class Space:
    """Coordinates ``c`` (rows by columns) of the basis, and the form they are orthogonal in (None: the plain one)."""

    def __init__(self, m: int, indefinite: bool):
        self.m, self.indefinite, self.c = m, indefinite, np.zeros((0, 0))
        self.sign = np.ones(m + 1)

    def image(self, j: int) -> np.ndarray:
        """Coordinates of the operator's image of vector j; the basis under them may grow."""
        raise NotImplementedError

    def form(self, x: np.ndarray) -> np.ndarray:
        raise NotImplementedError

    def place(self, x: np.ndarray, j: int) -> bool:
        """Scales ``x`` to the form's value +-1 as vector j, unless it (all but) vanishes there."""
        value = float(np.real(np.vdot(x, self.form(x))))
        if abs(value) <= BREAKDOWN * np.vdot(x, x).real:
            return False
        self.sign[j] = np.sign(value)
        self.c[:, j] = x / np.sqrt(abs(value))
        return True

    def expand(self, j: int) -> tuple[np.ndarray, float, bool]:
        """Coefficients of the image of vector j, what is left over as vector j + 1, and whether nothing was."""
        w = self.image(j)
        size, v, sign = np.linalg.norm(w), self.c[:, : j + 1], self.sign[: j + 1]
        total = 0
        for _ in range(2):
            part = sign * (v.conj().T @ self.form(w))
            w, total = w - v @ part, total + part
        if np.linalg.norm(w) <= BREAKDOWN * max(size, 1e-300):
            return total, 0.0, True
        if not self.place(w, j + 1):
            raise ArithmeticError("the indefinite form vanishes on a new vector: another start or target is needed")
        return total, float(np.linalg.norm(w) / np.linalg.norm(self.c[:, j + 1])), False

    def restart(self, q: np.ndarray, sign: np.ndarray, j: int) -> None:
        """Keeps the basis' combinations ``q`` and the vector left over."""
        k = q.shape[1]
        kept, last, s = self.c[:, :j] @ q, self.c[:, j].copy(), self.sign[j]
        self.c[:] = 0
        self.c[:, :k], self.c[:, k] = kept, last
        self.sign[:k], self.sign[k] = sign, s


class Plain(Space):
    def __init__(self, op: Callable, start: np.ndarray, m: int, form: Callable | None = None):
        super().__init__(m, form is not None)
        self.op, self._form = op, form
        self.c = np.zeros((len(start), m + 1), start.dtype)
        if not self.place(start, 0):
            raise ArithmeticError("the indefinite form vanishes on the start")

    def image(self, j: int) -> np.ndarray:
        return self.op(self.c[:, j])

    def form(self, x: np.ndarray) -> np.ndarray:
        return x if self._form is None else self._form(x)

    def vectors(self, y: np.ndarray) -> np.ndarray:
        return self.c[:, : len(y)] @ y


class Shared(Space):
    """Vectors of d blocks of length n, whose blocks are all coordinates in one orthonormal basis ``u`` of ``rank`` columns."""

    def __init__(self, d: int, n: int, kind: type, start: np.ndarray, m: int, forms: list[Operator] = []):
        super().__init__(m, bool(forms))
        self.d, self.n, self.kind, self.forms = d, n, kind, forms
        self.u, self.rank = np.zeros((n, m + 2 * d + 2), kind), 0
        self.small = [np.zeros((self.u.shape[1],) * 2, kind) for _ in forms]
        self.c = np.zeros((d * self.u.shape[1], m + 1), kind)
        x = np.stack([self.into(block) for block in start.reshape(d, n).astype(kind)])
        if not self.place(x.ravel(), 0):
            raise ArithmeticError("the indefinite form vanishes on the start")

    def into(self, z: np.ndarray) -> np.ndarray:
        """Coordinates of a vector in the shared basis, which it joins if it lies outside."""
        out, size = np.zeros(self.u.shape[1], self.kind), np.linalg.norm(z)
        for _ in range(2):
            part = self.u[:, : self.rank].conj().T @ z
            z = z - self.u[:, : self.rank] @ part
            out[: self.rank] += part
        left = np.linalg.norm(z)
        if left > BREAKDOWN * max(size, 1e-300) and self.rank < self.n:
            r, self.rank = self.rank, self.rank + 1
            self.u[:, r], out[r] = z / left, left
            for g, a in zip(self.small, self.forms):
                column = self.u[:, : r + 1].conj().T @ a.apply(self.u[:, r])
                g[: r + 1, r], g[r, : r + 1] = column, column.conj()
        return out

    def out(self, x: np.ndarray) -> np.ndarray:
        return self.u[:, : self.rank] @ x[: self.rank]

    def form(self, x: np.ndarray) -> np.ndarray:
        if not self.indefinite:
            return x
        y = x.reshape(2, -1)
        return np.concatenate([self.small[0] @ y[0] + self.small[1] @ y[1], self.small[1] @ y[0]])

    def restart(self, q: np.ndarray, sign: np.ndarray, j: int) -> None:
        super().restart(q, sign, j)
        k = q.shape[1] + 1
        blocks = self.c[:, :k].reshape(self.d, -1, k)[:, : self.rank]  # the shared basis shrinks to what these vectors span
        p, s, _ = np.linalg.svd(blocks.transpose(1, 0, 2).reshape(self.rank, -1), full_matrices=False)
        # by theory k + d - 1 vectors; what rounding leaves beyond is dropped, at the latest where it would not fit
        p = p[:, s > 1e-14 * s[0]][:, : k + 2 * self.d]
        r, old = p.shape[1], self.rank
        u = self.u[:, :old] @ p
        self.u[:], self.rank = 0, r
        self.u[:, :r] = u
        for g in self.small:
            inner = p.conj().T @ g[:old, :old] @ p
            g[:] = 0
            g[:r, :r] = inner
        turned = np.einsum("ra,drk->dak", p.conj(), blocks)
        whole = self.c.reshape(self.d, -1, self.c.shape[1])
        whole[:] = 0
        whole[:, :r, :k] = turned

    def vectors(self, y: np.ndarray) -> np.ndarray:
        """The blocks of combinations of the basis, one below the other."""
        x = (self.c[:, : len(y)] @ y).reshape(self.d, self.u.shape[1], y.shape[1])[:, : self.rank]
        return np.einsum("nr,drk->dnk", self.u[:, : self.rank], x).reshape(self.d * self.n, y.shape[1])


class Compact(Shared):
    """The companion pencil's space for sum p_j(k) A_j, inverted about ``sigma`` (None: not inverted). ``indefinite``: orthogonal in the form
    [[A_1, A_2], [A_2, 0]] of a Hermitian quadratic, of which only the projections on the shared basis are kept."""

    def __init__(self, mats: list[Operator], basis: str, sigma: complex | None, start: np.ndarray, m: int, indefinite: bool = False):
        d = len(mats) - 1
        self.mats, self.sigma, self.rule = mats, sigma, dense.recurrence(basis, d)
        if sigma is None:
            self.solve = solver_for(mats[-1])
        else:
            self.at = np.array(dense.basis_values(basis, d, sigma))
            self.solve = solver_for(combination(list(zip(self.at, mats))))
        cplx = np.iscomplexobj(start) or any(o.complex for o in mats) or complex(sigma or 0).imag != 0
        super().__init__(d, mats[0].n, complex if cplx else float, start, m, mats[1:] if indefinite else [])

    def image(self, j: int) -> np.ndarray:
        a, b, g = self.rule
        d, k, y = self.d, self.d - 1, self.c[:, j].reshape(self.d, -1)
        z = np.zeros_like(y)
        if self.sigma is None:
            for i in range(d - 1):
                z[i] = a[i] * y[i + 1] + b[i] * y[i] + (g[i] * y[i - 1] if i else 0)
            z[k] = -a[k] * self.into(self.solve(sum(m.apply(self.out(y[i])) for i, m in enumerate(self.mats[:-1]))))
            z[k] += b[k] * y[k] + (g[k] * y[k - 1] if k else 0)
            return z.ravel()
        s = self.sigma
        for i in range(d - 1):  # the blocks' parts that do not hang on the solve
            z[i + 1] = (y[i] - (b[i] - s) * z[i] - (g[i] * z[i - 1] if i else 0)) / a[i]
        top = y[k] - (b[k] - s) * z[k] - (g[k] * z[k - 1] if k else 0)
        rest = self.mats[-1].apply(self.out(top)) + a[k] * sum(m.apply(self.out(z[i])) for i, m in enumerate(self.mats[:-1]) if z[i].any())
        return (z + self.at[:d, None] * self.into(self.solve(-rest / a[k]))).ravel()


class Pencil:
    """The linear pencil of sum_s A_s sum_j c[j, s] b_j(z), inverted about ``at``, for rational functions with
    beta_j (1 - z / xi_j) b_j = (z - sigma_{j-1}) b_{j-1}. Vectors are blocks of b_0 x ... b_{m-1} x."""

    def __init__(self, mats: list[Operator], c: np.ndarray, sigma: np.ndarray, xi: np.ndarray, beta: np.ndarray, at: complex):
        self.mats, self.c, self.at, self.blocks = mats, c, at, len(c) - 1
        m = self.blocks
        self.inv = np.array([1 / x if np.isfinite(x) and x != 0 else 0.0 for x in xi[: m + 1]])
        self.sigma, self.beta = sigma, beta
        p = [1.0 + 0j]
        for j in range(1, m + 1):
            p.append(p[-1] * (at - sigma[j - 1]) / (beta[j] * (1 - at * self.inv[j])))
        self.p = np.array(p)
        self.solve = solver_for(combination([(complex(w), a) for w, a in zip(self.p @ c, mats)]))

    def total(self, y: np.ndarray, out: Callable) -> np.ndarray:
        """sum_j D_j y_j, one product a term."""
        return sum(a.apply(out(self.c[: len(y), s] @ y)) for s, a in enumerate(self.mats))

    def apply(self, y: np.ndarray, out: Callable, into: Callable) -> np.ndarray:
        m, z = self.blocks, np.zeros(y.shape, complex)
        for j in range(1, m):
            right = y[j - 1] + self.beta[j] * self.inv[j] * y[j]
            z[j] = (right + (self.at - self.sigma[j - 1]) * z[j - 1]) / (self.beta[j] * (1 - self.at * self.inv[j]))
        # the last row: D_m comes in by its recurrence from block m - 1
        scale = 1 - self.at * self.inv[m]
        top = out((y[-1] + (self.at - self.sigma[m - 1]) * z[-1]) / self.beta[m])
        rest = self.total(self.inv[m] * y - scale * z, out) - sum(c * a.apply(top) for c, a in zip(self.c[m], self.mats))
        return z + self.p[:m, None] * into(self.solve(rest / scale))


class Rational(Shared):
    """The space of a ``Pencil`` with a shared basis."""

    def __init__(self, pencil: Pencil, start: np.ndarray, m: int):
        self.pencil = pencil
        super().__init__(pencil.blocks, pencil.mats[0].n, complex, start, m)

    def image(self, j: int) -> np.ndarray:
        return self.pencil.apply(self.c[:, j].reshape(self.d, -1), self.out, self.into).ravel()


def restarted(space: Space, nev: int, wanted: Callable, error: Callable, stop: Callable, tell: Callable, real: bool, keep: float = 0.5) -> tuple[np.ndarray, np.ndarray, int, str]:
    """Values of the operator and coordinates' combinations, by a thick restart. ``wanted`` orders values, ``error(residual, value)``
    measures, ``stop(it, nconv)`` gives a reason or None."""
    m = space.m
    h, have, it = np.zeros((m + 1, m), space.c.dtype), 0, 0
    while True:
        it += 1
        closed, j = False, m
        for i in range(have, m):
            h[: i + 1, i], beta, closed = space.expand(i)
            if closed:
                j = i + 1
                break
            h[i + 1, i] = beta
        t = h[:j, :j]
        last = np.zeros(j) if closed else h[j, :j]
        sign = space.sign[:j]
        if space.indefinite:  # sign t is Hermitian but for rounding
            t = sign[:, None] * t
            t = sign[:, None] * (t + t.conj().T) / 2
        theta, y = np.linalg.eig(t)
        at = wanted(theta)
        theta, y = theta[at], y[:, at]
        size = np.linalg.norm(space.c[:, :j] @ y, axis=0)
        left = 0.0 if closed else np.linalg.norm(space.c[:, j])
        errors = np.array([error(r, v) for r, v in zip(left * np.abs(last @ y) / np.maximum(size, 1e-300), theta)])
        nconv = 0
        while nconv < j and (closed or errors[nconv] >= 0 and errors[nconv] < error.tol):
            nconv += 1
        tell(it, theta[:nev], errors[:nev])
        why = "tolerance" if closed else stop(it, nconv)
        if why is not None:
            return theta[:nconv], space.vectors(y[:, :nconv]), it, why
        count = max(min(nconv + int((j - nconv) * keep), j - 1), 1)
        while True:
            sel = y[:, :count]
            if real:
                if count < j and abs(theta[count - 1].imag) > 0 and abs(theta[count - 1] - np.conj(theta[count])) < 1e-8 * abs(theta[count]):
                    sel = y[:, : count + 1]
                sel = np.hstack([sel.real, sel.imag])
            u, s, _ = np.linalg.svd(sel, full_matrices=False)
            q = u[:, s > 1e-10 * s[0]][:, : j - 1]
            if not space.indefinite:
                new = np.ones(q.shape[1])
                break
            values, turn = np.linalg.eigh(q.conj().T @ (sign[:, None] * q))
            if np.abs(values).min() > 1e-8:
                new, q = np.sign(values), (q @ turn) / np.sqrt(np.abs(values))
                break
            count -= 1  # the form is degenerate on what would be kept
            if count < 1:
                raise ArithmeticError("the indefinite form is degenerate on the wanted vectors")
        have = q.shape[1]
        small, row = new[:, None] * (q.conj().T @ (sign[:, None] * (t @ q))), last @ q
        space.restart(q, new, j)
        h[:] = 0
        h[:have, :have], h[have, :have] = small, row


def two_sided(op: Callable, back: Callable, x: np.ndarray, y: np.ndarray, m: int, nev: int, wanted: Callable, error: Callable, stop: Callable, tell: Callable, real: bool, keep: float = 0.5):
    """Right and left vectors together: an orthonormal basis for the operator and one for its adjoint ``back``, each projected along the
    complement of the other, restarted with the wanted right and left vectors."""
    n, kind = len(x), x.dtype
    sides = [(op, np.zeros((n, m + 1), kind), np.zeros((m + 1, m), kind)), (back, np.zeros((n, m + 1), kind), np.zeros((m + 1, m), kind))]
    for (_, v, _), start in zip(sides, (x, y)):
        v[:, 0] = start / np.linalg.norm(start)
    have, it = [0, 0], 0
    while True:
        it += 1
        ends = [arnoldi(f, v, h, k, m)[0::2] for (f, v, h), k in zip(sides, have)]
        j = min(e[0] for e in ends)
        closed = any(c and e == j for e, c in ends)
        bases, projected, rows, over = [], [], [], []
        for (_, v, h), (e, c) in zip(sides, ends):
            bases.append(v[:, :j])
            row = np.zeros(j, kind) if c and e == j else h[j, :j].copy()
            rows.append(row)
            over.append(v[:, j].copy() if row.any() else np.zeros(n, kind))
        cross = bases[1].conj().T @ bases[0]
        if np.linalg.cond(cross) > 1e14:
            raise ArithmeticError("the right and the left space are orthogonal: another start is needed")
        for k, g in enumerate((cross, cross.conj().T)):
            slant = np.linalg.solve(g, bases[1 - k].conj().T @ over[k])
            over[k] = over[k] - bases[k] @ slant
            projected.append(sides[k][2][:j, :j] + np.outer(slant, rows[k]))
        theta, right = np.linalg.eig(projected[0])
        at = wanted(theta)
        theta, right = theta[at], right[:, at]
        left = np.linalg.inv(cross @ right).conj().T  # the dual vectors: left^H cross right = 1
        errors = []
        for k, z in enumerate((right, left)):
            errors.append(np.linalg.norm(over[k]) * np.abs(rows[k] @ z) / np.maximum(np.linalg.norm(z, axis=0), 1e-300))
        errors = np.array([error(r, v) for r, v in zip(np.maximum(*errors), theta)])
        nconv = 0
        while nconv < j and (closed or errors[nconv] < error.tol):
            nconv += 1
        tell(it, theta[:nev], errors[:nev])
        why = "tolerance" if closed else stop(it, nconv)
        if why is not None:
            return theta[:nconv], bases[0] @ right[:, :nconv], bases[1] @ left[:, :nconv], it, why
        count = max(min(nconv + int((j - nconv) * keep), j - 2), 1)
        if real and abs(theta[count - 1].imag) > 0 and abs(theta[count - 1] - np.conj(theta[count])) < 1e-8 * abs(theta[count]):
            count += 1
        for k, z in enumerate((right[:, :count], left[:, :count])):
            z = np.hstack([z.real, z.imag]) if real else z
            u, s, _ = np.linalg.svd(z, full_matrices=False)
            q = u[:, s > 1e-10 * s[0]][:, : j - 1]
            v, h, size = sides[k][1], sides[k][2], q.shape[1]
            kept = bases[k] @ q
            part = kept.conj().T @ over[k]
            rest = over[k] - kept @ part
            again = kept.conj().T @ rest
            rest, part = rest - kept @ again, part + again
            length, row = np.linalg.norm(rest), rows[k] @ q
            small = q.conj().T @ projected[k] @ q + np.outer(part, row)
            v[:], h[:] = 0, 0
            v[:, :size], v[:, size] = kept, rest / max(length, 1e-300)
            h[:size, :size], h[size, :size] = small, length * row
            have[k] = size


def two_sided_power(op: Callable, back: Callable, x: np.ndarray, y: np.ndarray, nev: int, most: int, error: Callable, tell: Callable):
    """Power steps on both sides; pairs found are taken off by their oblique projections."""
    found, rights, lefts, it = [], [], [], 0
    for k in range(min(nev, x.shape[1])):
        v, w, theta = x[:, k], y[:, k], 0.0
        while it < most:
            it += 1
            for a, b in zip(rights, lefts):
                v, w = v - a * np.vdot(b, v), w - b * np.vdot(a, w)
            v, w = v / np.linalg.norm(v), w / np.linalg.norm(w)
            av, aw = op(v), back(w)
            theta = np.vdot(w, av) / np.vdot(w, v)
            e = error(max(np.linalg.norm(av - theta * v), np.linalg.norm(aw - np.conj(theta) * w)), theta)
            tell(it, [theta], [e])
            if e < error.tol:
                break
            v, w = av, aw
        else:
            break
        found.append(theta)
        rights.append(v)
        lefts.append(w / np.conj(np.vdot(w, v)))
    shape = (len(x), 0)
    return np.array(found), np.stack(rights, 1) if found else np.zeros(shape), np.stack(lefts, 1) if found else np.zeros(shape), it, "tolerance" if len(found) == nev else "iterations"
