"""Options as strings ("-eps_nev 4 -eps_type lobpcg"), turned into parameters of the solvers."""

from __future__ import annotations

import shlex
from collections.abc import Callable
from typing import Any

from ..functions.region import Ellipse, Interval, Polygon, Region, Ring
from ..operators.transform import Transform

FLAGS = {"largest_magnitude", "smallest_magnitude", "largest_real", "smallest_real", "largest_imaginary", "smallest_imaginary", "target_magnitude", "target_real", "target_imaginary", "all"}


def split(text: str) -> dict[str, str]:
    """Names and values; a name without a value is "true"."""
    out: dict[str, str] = {}
    words = shlex.split(text)
    k = 0
    while k < len(words):
        if not words[k].startswith("-"):
            raise ValueError(f"not an option: {words[k]}")
        name = words[k].lstrip("-")
        follows = k + 1 < len(words) and (not words[k + 1].startswith("-") or words[k + 1][1:2].isdigit() or words[k + 1][1:2] == ".")
        out[name] = words[k + 1] if follows else "true"
        k += 1 + follows
    return out


def number(text: str) -> complex | float:
    """3, -0.5 or 1+2i."""
    z = complex(text.replace("i", "j"))
    return z.real if z.imag == 0 else z


def numbers(text: str) -> list:
    return [number(x) for x in text.split(",")]


def region(given: dict[str, str]) -> Region | None:
    kind = given.get("rg_type")
    if kind is None:
        return None
    inverse, scale = given.get("rg_complement", "false") == "true", float(given.get("rg_scale", 1))
    if kind == "interval":
        a, b, c, d = numbers(given["rg_interval_endpoints"])
        return Interval(inverse, scale, a, b, c, d)
    if kind == "ellipse":
        return Ellipse(inverse, scale, number(given.get("rg_ellipse_center", "0")), float(given.get("rg_ellipse_radius", 1)), float(given.get("rg_ellipse_vscale", 1)))
    if kind == "ring":
        return Ring(
            inverse, scale, number(given.get("rg_ring_center", "0")), float(given.get("rg_ring_radius", 1)), float(given.get("rg_ring_vscale", 1)),
            float(given.get("rg_ring_startangle", 0)), float(given.get("rg_ring_endangle", 1)), float(given.get("rg_ring_width", 0.1)),
        )
    if kind == "polygon":
        return Polygon(inverse, scale, numbers(given["rg_polygon_vertices"]))
    raise ValueError(f"no such region: {kind}")


def transform(given: dict[str, str]) -> Transform | None:
    if "st_type" not in given and "st_shift" not in given:
        return None
    interval = tuple(numbers(given["st_filter_interval"])) if "st_filter_interval" in given else None
    return Transform(given.get("st_type", "shift"), number(given.get("st_shift", given.get("eps_target", "0"))), number(given["st_cayley_antishift"]) if "st_cayley_antishift" in given else None, interval, degree=int(given.get("st_filter_degree", 60)))


#: option key behind the prefix: parameter and how its text is read.
READERS: dict[str, tuple[str, Callable[[str], Any]]] = {
    "type": ("solver", str), "nev": ("nev", int), "nsv": ("nsv", int), "ncv": ("ncv", int), "mpd": ("mpd", int), "tol": ("tol", float), "max_it": ("max_it", int), "target": ("target", number), "basis": ("basis", str),
    "scale": ("scale", str), "extract": ("extraction", str), "extraction": ("extraction", str), "balance": ("balance", lambda x: x != "none"), "interval": ("interval", lambda x: tuple(numbers(x))), "two_sided": ("two_sided", lambda x: x == "true"),
    "harmonic": ("extraction", lambda x: "harmonic"), "refine_its": ("refine_steps", int),
    "hermitian": ("problem", lambda x: "hep"), "gen_hermitian": ("problem", lambda x: "ghep"), "non_hermitian": ("problem", lambda x: "nhep"), "gen_non_hermitian": ("problem", lambda x: "gnhep"),
    "pos_gen_non_hermitian": ("problem", lambda x: "pgnhep"), "gen_indefinite": ("problem", lambda x: "ghiep"), "bse": ("problem", lambda x: "bse"),
    "conv_abs": ("convergence", lambda x: "absolute"), "conv_rel": ("convergence", lambda x: "relative"), "conv_norm": ("convergence", lambda x: "norm"),
    "largest": ("which", lambda x: "largest"), "smallest": ("which", lambda x: "smallest"),
}
#: Solver-specific keys, read as they are.
EXTRA = {"power_shift_type": ("shift", str), "krylovschur_restart": ("keep", float), "gd_blocksize": ("block", int), "jd_blocksize": ("block", int), "lobpcg_blocksize": ("block", int), "ciss_integration_points": ("nodes", int), "ciss_blocksize": ("block", int), "ciss_moments": ("moments", int), "ciss_extraction": ("extraction", str), "ciss_delta": ("delta", float), "interpol_interpolation_degree": ("degree", int), "nleigs_interpolation_degree": ("degree", int)}


def parameters(text: str, prefix: str = "eps") -> dict[str, Any]:
    """Keyword arguments for ``eigs``, ``svds``, ``polyeigs`` or ``nleigs`` (prefixes eps, svd, pep, nep). Unknown options of the
    prefix are errors; those of other prefixes are left alone."""
    given, out = split(text), {}
    for name, value in given.items():
        if not name.startswith(f"{prefix}_"):
            continue
        key = name[len(prefix) + 1 :]
        if key in FLAGS:
            out["which"] = key
        elif key in READERS:
            out[READERS[key][0]] = READERS[key][1](value)
        elif key in EXTRA:
            out[EXTRA[key][0]] = EXTRA[key][1](value)
        elif not key.startswith(("view", "monitor", "error", "converged_reason")):
            raise ValueError(f"no such option: {name}")
    if (r := region(given)) is not None:
        out["region"] = r
    if prefix == "eps" and (t := transform(given)) is not None:
        out["transform"] = t
    if prefix == "pep" and "st_type" in given:
        out["transform"] = given["st_type"]
    return out


def view(result, kind: str = "values") -> str:
    """Results as text: "values", "errors" (one line each), "reason"."""
    if kind == "reason":
        return f"{result.solver}: {result.nconv} converged after {result.iterations} iterations ({result.reason})"
    show = lambda v: f"{v.real:.5f}" if abs(complex(v).imag) < 1e-12 * max(1, abs(v)) else f"{v.real:.5f}{complex(v).imag:+.5f}i"
    if kind == "values":
        return ", ".join(show(complex(v)) for v in result.values)
    return "\n".join(f"{show(complex(v)):>24} {e:.3e}" for v, e in zip(result.values, result.errors))
