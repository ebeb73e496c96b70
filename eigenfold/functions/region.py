"""Regions of the complex plane: inside tests as numpy and as columns, contours and quadrature."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass
class Region:
    """The whole plane unless a kind says otherwise. ``complement`` swaps inside and outside;
    ``scale`` divides points first."""

    complement: bool = False
    scale: float = 1.0

    def _sign(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return np.ones(len(x), int)

    def _column(self, x: Column, y: Column) -> Column:
        return F.lit(1)

    def inside(self, points) -> np.ndarray:
        """1 inside, 0 on the border, -1 outside."""
        z = np.atleast_1d(np.asarray(points, complex)) / self.scale
        s = self._sign(z.real, z.imag)
        return -s if self.complement else s

    def column(self, re: str, im: str) -> Column:
        s = self._column(F.col(re) / self.scale, F.col(im) / self.scale).cast("int")
        return -s if self.complement else s

    def trivial(self) -> bool:
        return type(self) is Region

    def axisymmetric(self, vertical: bool = False) -> bool:
        return True

    def can_use_conjugates(self, real: bool) -> bool:
        """Half of the quadrature points are enough: the problem is real and the region is its own mirror image."""
        return real and self.axisymmetric()

    def contour(self, n: int) -> np.ndarray:
        raise ValueError("this region has no contour")

    def box(self) -> tuple[float, float, float, float]:
        return (-math.inf, math.inf, -math.inf, math.inf)

    def quadrature(self, n: int, rule: str = "trapezoidal") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Nodes, nodes scaled to the unit circle, and weights of a contour integral."""
        raise ValueError("this region has no quadrature")

    def contour_frame(self, spark: SparkSession, n: int) -> DataFrame:
        return spark.createDataFrame([(k, float(z.real), float(z.imag)) for k, z in enumerate(self.contour(n))], "k int, re double, im double")


@dataclass
class Interval(Region):
    """[a, b] x [c, d]."""

    a: float = -math.inf
    b: float = math.inf
    c: float = -math.inf
    d: float = math.inf

    def _sign(self, x, y):
        out = (x < self.a) | (x > self.b) | (y < self.c) | (y > self.d)
        flat = self.a == self.b or self.c == self.d
        edge = (x == self.a) | (x == self.b) | (y == self.c) | (y == self.d)
        return np.where(out, -1, np.where(edge & (not flat), 0, 1))

    def _column(self, x, y):
        lit = lambda v: F.lit(float(v))
        out = (x < lit(self.a)) | (x > lit(self.b)) | (y < lit(self.c)) | (y > lit(self.d))
        edge = (x == lit(self.a)) | (x == lit(self.b)) | (y == lit(self.c)) | (y == lit(self.d))
        flat = self.a == self.b or self.c == self.d
        return F.when(out, -1).when(edge & F.lit(not flat), 0).otherwise(1)

    def axisymmetric(self, vertical=False):
        return self.a == -self.b if vertical else self.c == -self.d

    def box(self):
        return (self.a * self.scale, self.b * self.scale, self.c * self.scale, self.d * self.scale)

    def contour(self, n):
        sides = [(self.a, self.c), (self.b, self.c), (self.b, self.d), (self.a, self.d)]
        if not all(map(math.isfinite, (self.a, self.b, self.c, self.d))):
            raise ValueError("an unbounded interval has no contour")
        lengths = np.array([abs(sides[(i + 1) % 4][0] - sides[i][0]) + abs(sides[(i + 1) % 4][1] - sides[i][1]) for i in range(4)])
        along = np.arange(n) * lengths.sum() / n
        ends = np.cumsum(lengths)
        out = []
        for s in along:
            i = int(np.searchsorted(ends, s, "right"))
            f = (s - (ends[i] - lengths[i])) / lengths[i]
            (x0, y0), (x1, y1) = sides[i], sides[(i + 1) % 4]
            out.append(complex(x0 + f * (x1 - x0), y0 + f * (y1 - y0)))
        return np.array(out) * self.scale

    def quadrature(self, n, rule="trapezoidal"):
        a, b = self.a * self.scale, self.b * self.scale
        centre, radius = (a + b) / 2, (b - a) / 2
        if rule == "chebyshev":
            theta = math.pi * (np.arange(n) + 0.5) / n
            scaled = np.cos(theta).astype(complex)
            weights = np.array([(-1) ** i * math.sin(t) for i, t in enumerate(theta)], complex) / n
            return centre + radius * scaled, scaled, weights
        theta = 2 * math.pi * (np.arange(n) + 0.5) / n
        scaled = np.exp(1j * theta)
        return centre + radius * scaled, scaled, radius * scaled / n


@dataclass
class Ellipse(Region):
    centre: complex = 0.0
    radius: float = 1.0
    vscale: float = 1.0

    def _distance(self, x, y):
        dx, dy = (x - complex(self.centre).real) / self.radius, (y - complex(self.centre).imag) / self.radius
        return 1 - dx * dx - dy * dy / self.vscale**2

    def _sign(self, x, y):
        return np.sign(self._distance(x, y)).astype(int)

    def _column(self, x, y):
        return F.signum(self._distance(x, y))

    def axisymmetric(self, vertical=False):
        return (complex(self.centre).real if vertical else complex(self.centre).imag) == 0

    def box(self):
        c, r = complex(self.centre) * self.scale, self.radius * self.scale
        return (c.real - r, c.real + r, c.imag - r * self.vscale, c.imag + r * self.vscale)

    def contour(self, n):
        t = 2 * math.pi * (np.arange(n) + 0.5) / n
        return (self.centre + self.radius * (np.cos(t) + 1j * self.vscale * np.sin(t))) * self.scale

    def quadrature(self, n, rule="trapezoidal"):
        if rule == "chebyshev":
            t = math.pi * (np.arange(n) + 0.5) / n
            scaled = np.cos(t).astype(complex)
            weights = (-1.0) ** np.arange(n) * np.sin(t) / n
        else:
            t = 2 * math.pi * (np.arange(n) + 0.5) / n
            scaled = np.cos(t) + 1j * self.vscale * np.sin(t)
            weights = self.radius * self.scale * (self.vscale * np.cos(t) + 1j * np.sin(t)) / n
        return self.scale * (self.centre + self.radius * scaled), scaled, weights


@dataclass
class Ring(Region):
    """An elliptic band of relative ``width`` inside the outer ellipse, between two angles (in turns)."""

    centre: complex = 0.0
    radius: float = 1.0
    vscale: float = 1.0
    start: float = 0.0
    end: float = 1.0
    width: float = 0.1

    def _ellipse(self, radius: float) -> Ellipse:
        return Ellipse(centre=self.centre, radius=radius, vscale=self.vscale)

    def _sign(self, x, y):
        outer = self._ellipse(self.radius)._sign(x, y)
        inner = -self._ellipse(self.radius - self.width)._sign(x, y) if self.radius > self.width else np.ones(len(x), int)
        c = complex(self.centre)
        angle = np.arctan2((y - c.imag) / self.vscale, x - c.real) / (2 * math.pi) % 1.0
        within = (angle >= self.start) & (angle <= self.end) if self.start <= self.end else (angle >= self.start) | (angle <= self.end)
        return np.where(within, np.minimum(outer, inner), -1)

    def _column(self, x, y):
        c = complex(self.centre)
        outer = self._ellipse(self.radius)._column(x, y)
        inner = -self._ellipse(self.radius - self.width)._column(x, y) if self.radius > self.width else F.lit(1.0)
        turn = F.atan2((y - c.imag) / self.vscale, x - c.real) / (2 * math.pi)
        angle = F.when(turn < 0, turn + 1).otherwise(turn)
        within = (angle >= self.start) & (angle <= self.end) if self.start <= self.end else (angle >= self.start) | (angle <= self.end)
        return F.when(within, F.least(outer, inner)).otherwise(-1)

    def axisymmetric(self, vertical=False):
        c = complex(self.centre)
        return c.real == 0 and abs((self.start + self.end) % 1 - 0.5) < 1e-12 if vertical else c.imag == 0 and abs(self.start + self.end - 1) < 1e-12

    def box(self):
        return Ellipse(scale=self.scale, centre=self.centre, radius=self.radius, vscale=self.vscale).box()

    def _arc(self, n: int) -> np.ndarray:
        span = self.end - self.start if self.end > self.start else self.end - self.start + 1
        return 2 * math.pi * (self.start + span * (np.arange(n) + 0.5) / n)

    def contour(self, n):
        half = (n + 1) // 2
        out = self._arc(half)
        back = self._arc(n - half)[::-1]
        unit = lambda t: np.cos(t) + 1j * self.vscale * np.sin(t)
        return (self.centre + np.concatenate([self.radius * unit(out), (self.radius - self.width) * unit(back)])) * self.scale

    def quadrature(self, n, rule="trapezoidal"):
        t = self._arc(n)
        middle = self.radius - self.width / 2
        unit = np.cos(t) + 1j * self.vscale * np.sin(t)
        return self.scale * (self.centre + middle * unit), unit, self.scale * middle * (self.vscale * np.cos(t) + 1j * np.sin(t)) * (t[1] - t[0] if n > 1 else 1) / (2 * math.pi)


@dataclass
class Polygon(Region):
    vertices: list[complex] = field(default_factory=list)

    def _edges(self):
        return [(complex(p), complex(q)) for p, q in zip(self.vertices, self.vertices[1:] + self.vertices[:1])]

    def _sign(self, x, y):
        eps = 10 * np.finfo(float).eps
        inside, edge = np.zeros(len(x), bool), np.zeros(len(x), bool)
        for p, q in self._edges():
            cross = (q.real - p.real) * (y - p.imag) - (q.imag - p.imag) * (x - p.real)
            along = (min(p.real, q.real) - eps <= x) & (x <= max(p.real, q.real) + eps) & (min(p.imag, q.imag) - eps <= y) & (y <= max(p.imag, q.imag) + eps)
            edge |= (np.abs(cross) <= eps) & along
            if p.imag != q.imag:
                inside ^= ((p.imag > y) != (q.imag > y)) & (x < (q.real - p.real) * (y - p.imag) / (q.imag - p.imag) + p.real)
        return np.where(edge, 0, np.where(inside, 1, -1))

    def _column(self, x, y):
        eps = 10 * float(np.finfo(float).eps)
        crossings, edge = F.lit(0), F.lit(False)
        for p, q in self._edges():
            cross = (q.real - p.real) * (y - p.imag) - (q.imag - p.imag) * (x - p.real)
            edge = edge | ((F.abs(cross) <= eps) & x.between(min(p.real, q.real) - eps, max(p.real, q.real) + eps) & y.between(min(p.imag, q.imag) - eps, max(p.imag, q.imag) + eps))
            if p.imag != q.imag:
                meets = ((F.lit(p.imag) > y) != (F.lit(q.imag) > y)) & (x < (q.real - p.real) * (y - p.imag) / (q.imag - p.imag) + p.real)
                crossings = crossings + meets.cast("int")
        return F.when(edge, 0).when(crossings % 2 == 1, 1).otherwise(-1)

    def axisymmetric(self, vertical=False):
        points = {(round(complex(v).real, 12), round(complex(v).imag, 12)) for v in self.vertices}
        return {(-a, b) if vertical else (a, -b) for a, b in points} == points

    def box(self):
        v = np.array(self.vertices, complex) * self.scale
        return (v.real.min(), v.real.max(), v.imag.min(), v.imag.max())

    def contour(self, n):
        edges = self._edges()
        lengths = np.array([abs(q - p) for p, q in edges])
        ends = np.cumsum(lengths)
        out = []
        for s in np.arange(n) * lengths.sum() / n:
            i = int(np.searchsorted(ends, s, "right"))
            p, q = edges[i]
            out.append(p + (q - p) * (s - (ends[i] - lengths[i])) / lengths[i])
        return np.array(out) * self.scale
