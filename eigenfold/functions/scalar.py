"""Scalar functions f(x) = beta g(alpha x): values and derivatives as numbers and as columns, and
f of a small dense matrix."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import dense


def _guard(bad: Column, x: Column, what: str) -> Column:
    return F.when(bad, F.raise_error(F.lit(what)).cast("double")).otherwise(x)


@dataclass
class Function:
    alpha: complex = 1.0
    beta: complex = 1.0

    def g(self, x):
        raise NotImplementedError

    def dg(self, x):
        raise NotImplementedError

    def col(self, x: Column) -> Column:
        raise NotImplementedError

    def dcol(self, x: Column) -> Column:
        raise NotImplementedError

    def mat(self, a: np.ndarray, method: str | None) -> np.ndarray:
        raise NotImplementedError

    def __call__(self, x):
        return self.beta * self.g(self.alpha * x)

    def derivative(self, x):
        return self.alpha * self.beta * self.dg(self.alpha * x)

    def column(self, x: Column) -> Column:
        return F.lit(float(self.beta)) * self.col(F.lit(float(self.alpha)) * x)

    def derivative_column(self, x: Column) -> Column:
        return F.lit(float(self.alpha * self.beta)) * self.dcol(F.lit(float(self.alpha)) * x)

    def matrix(self, a: np.ndarray, method: str | None = None) -> np.ndarray:
        """f(A). Hermitian matrices go through their eigenvalues unless a method is named."""
        a = self.alpha * np.asarray(a)
        if method is None and np.allclose(a, a.conj().T, rtol=0, atol=1e-14 * max(1.0, np.abs(a).max())):
            w, q = np.linalg.eigh(a)
            return self.beta * ((q * np.array([self.g(x) for x in self._eigenvalues(w)])) @ q.conj().T)
        return self.beta * self.mat(a, method)

    def _eigenvalues(self, w):
        return w

    def first_column(self, a: np.ndarray) -> np.ndarray:
        return self.matrix(a)[:, 0]


def _real(x) -> bool:
    return not isinstance(x, (complex, np.complexfloating))


@dataclass
class Exp(Function):
    def g(self, x):
        return np.exp(x)

    dg = g

    def col(self, x):
        return F.exp(x)

    dcol = col

    def mat(self, a, method):
        return dense.expm(a, method or "higham")


@dataclass
class Log(Function):
    def g(self, x):
        if _real(x) and x < 0:
            raise ValueError("logarithm of a negative number")
        if x == 0:
            return -math.inf
        return np.log(x)

    def dg(self, x):
        if x == 0:
            raise ZeroDivisionError("derivative of the logarithm at zero")
        return 1 / x

    def col(self, x):
        return _guard(x < 0, F.when(x == 0, F.lit(-math.inf)).otherwise(F.log(x)), "logarithm of a negative number")

    def dcol(self, x):
        return _guard(x == 0, 1 / x, "derivative of the logarithm at zero")

    def mat(self, a, method):
        return dense.logm(a)


@dataclass
class Sqrt(Function):
    def g(self, x):
        if _real(x) and x < 0:
            raise ValueError("square root of a negative number")
        return np.sqrt(x)

    def dg(self, x):
        if x == 0:
            raise ZeroDivisionError("derivative of the square root at zero")
        return 1 / (2 * self.g(x))

    def col(self, x):
        return _guard(x < 0, F.sqrt(x), "square root of a negative number")

    def dcol(self, x):
        return _guard(x <= 0, 1 / (2 * F.sqrt(x)), "derivative of the square root at zero or below")

    def mat(self, a, method):
        return dense.sqrtm(a, method or "schur")


@dataclass
class InvSqrt(Function):
    def g(self, x):
        if x == 0:
            raise ZeroDivisionError("inverse square root of zero")
        if _real(x) and x < 0:
            raise ValueError("inverse square root of a negative number")
        return 1 / np.sqrt(x)

    def dg(self, x):
        return -self.g(x) / (2 * x)

    def col(self, x):
        return _guard(x <= 0, 1 / F.sqrt(x), "inverse square root of zero or below")

    def dcol(self, x):
        return _guard(x <= 0, -1 / (2 * x * F.sqrt(x)), "inverse square root of zero or below")

    def mat(self, a, method):
        return dense.invsqrtm(a, method or "schur")


@dataclass
class Phi(Function):
    """phi_0 = exp; phi_k = (phi_{k-1} - 1/(k-1)!) / x."""

    k: int = 1

    def __post_init__(self):
        if not 0 <= self.k <= 10:
            raise ValueError("k is 0 to 10")

    def g(self, x, k: int | None = None):
        k = self.k if k is None else k
        if abs(x) < 0.5:  # series: no cancellation
            return sum(x**i / math.factorial(i + k) for i in range(22))
        y = np.exp(x)
        for i in range(1, k + 1):
            y = (y - 1 / math.factorial(i - 1)) / x
        return y

    def dg(self, x):
        return self.g(x) - self.k * self.g(x, self.k + 1)

    def _phi(self, x, k):
        series = F.lit(0.0)
        for i in reversed(range(22)):
            series = series * x + F.lit(1 / math.factorial(i + k))
        y = F.exp(x)
        for i in range(1, k + 1):
            y = (y - F.lit(1 / math.factorial(i - 1))) / x
        return F.when(F.abs(x) < 0.5, series).otherwise(y)

    def col(self, x):
        return self._phi(x, self.k)

    def dcol(self, x):
        return self._phi(x, self.k) - self.k * self._phi(x, self.k + 1)

    def mat(self, a, method):
        return dense.phim(a, self.k)


@dataclass
class Rational(Function):
    """p/q with coefficients from the highest power down; no denominator is 1."""

    p: list = field(default_factory=lambda: [1.0])
    q: list = field(default_factory=list)

    def _at(self, c, x):
        y = 0 * x
        for a in c:
            y = y * x + a
        return y

    @staticmethod
    def _slope(c):
        n = len(c) - 1
        return [a * (n - i) for i, a in enumerate(c[:-1])] or [0.0]

    def g(self, x):
        bottom = self._at(self.q, x) if self.q else 1.0
        if bottom == 0:
            raise ZeroDivisionError("the denominator is zero")
        return self._at(self.p or [1.0], x) / bottom

    def dg(self, x):
        p, dp = self._at(self.p or [1.0], x), self._at(self._slope(self.p or [1.0]), x)
        if not self.q:
            return dp
        q, dq = self._at(self.q, x), self._at(self._slope(self.q), x)
        if q == 0:
            raise ZeroDivisionError("the denominator is zero")
        return (dp * q - p * dq) / q**2

    def _col(self, c, x):
        y = F.lit(0.0)
        for a in c:
            y = y * x + F.lit(float(a))
        return y

    def col(self, x):
        p = self._col(self.p or [1.0], x)
        if not self.q:
            return p
        q = self._col(self.q, x)
        return _guard(q == 0, p / q, "the denominator is zero")

    def dcol(self, x):
        p, dp = self._col(self.p or [1.0], x), self._col(self._slope(self.p or [1.0]), x)
        if not self.q:
            return dp
        q, dq = self._col(self.q, x), self._col(self._slope(self.q), x)
        return _guard(q == 0, (dp * q - p * dq) / (q * q), "the denominator is zero")

    def mat(self, a, method):
        def horner(c):
            y = np.zeros_like(a)
            for k in c:
                y = y @ a + k * np.eye(len(a))
            return y

        p = horner(self.p or [1.0])
        return np.linalg.solve(horner(self.q), p) if self.q else p


@dataclass
class Combined(Function):
    """f1 + f2, f1 * f2, f1 / f2, or f2(f1)."""

    how: str = "add"
    first: Function = None
    second: Function = None

    def __post_init__(self):
        if self.how not in ("add", "multiply", "divide", "compose"):
            raise ValueError(f"no such combination: {self.how}")

    def g(self, x):
        a = self.first(x)
        if self.how == "compose":
            return self.second(a)
        b = self.second(x)
        if self.how == "divide" and b == 0:
            raise ZeroDivisionError("division by a function that is zero here")
        return a + b if self.how == "add" else a * b if self.how == "multiply" else a / b

    def dg(self, x):
        a, da = self.first(x), self.first.derivative(x)
        if self.how == "compose":
            return da * self.second.derivative(a)
        b, db = self.second(x), self.second.derivative(x)
        return da + db if self.how == "add" else da * b + a * db if self.how == "multiply" else (da * b - a * db) / b**2

    def col(self, x):
        a = self.first.column(x)
        if self.how == "compose":
            return self.second.column(a)
        b = self.second.column(x)
        return a + b if self.how == "add" else a * b if self.how == "multiply" else _guard(b == 0, a / b, "division by a function that is zero here")

    def dcol(self, x):
        a, da = self.first.column(x), self.first.derivative_column(x)
        if self.how == "compose":
            return da * self.second.derivative_column(a)
        b, db = self.second.column(x), self.second.derivative_column(x)
        return da + db if self.how == "add" else da * b + a * db if self.how == "multiply" else (da * b - a * db) / (b * b)

    def matrix(self, a, method=None):
        a = self.alpha * np.asarray(a)
        x = self.first.matrix(a)
        if self.how == "compose":
            return self.beta * self.second.matrix(x)
        y = self.second.matrix(a)
        return self.beta * (x + y if self.how == "add" else x @ y if self.how == "multiply" else np.linalg.solve(y, x))


_kinds: dict[str, Callable[..., Function]] = {"exp": Exp, "log": Log, "sqrt": Sqrt, "invsqrt": InvSqrt, "phi": Phi, "rational": Rational, "combine": Combined}


def register(name: str, kind: Callable[..., Function]) -> None:
    """Adds a kind of function by name."""
    _kinds[name] = kind


def function(name: str, **parameters) -> Function:
    if name not in _kinds:
        raise ValueError(f"no such function: {name}")
    return _kinds[name](**parameters)
