"""Problem catalogs: exact solutions with sources that agree with them, as Column functions.

Where the usual catalog entry and its source contradict each other, the source here is the
one that follows from the solution; the names stay.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from math import exp, pi

from pyspark.sql import Column
from pyspark.sql import functions as F

sin, cos, e_to = F.sin, F.cos, F.exp
PI = pi


@dataclass(frozen=True)
class Poisson:
    """-Laplacian u = f on the unit square."""

    name: str
    exact: Callable[[Column, Column], Column]
    source: Callable[[Column, Column], Column]
    zero_boundary: bool = True
    smooth: bool = True


@dataclass(frozen=True)
class Heat:
    """u_t = alpha Laplacian u + f on the unit square."""

    name: str
    exact: Callable[[Column, Column, Column], Column]
    source: Callable[[Column, Column, Column], Column]
    alpha: float = 1.0


def _waves(a: float, b: float) -> tuple[Callable, Callable]:
    u = lambda x, y: sin(a * PI * x) * sin(b * PI * y)
    return u, lambda x, y: (a * a + b * b) * PI * PI * u(x, y)


def _bump(x: Column) -> Column:
    return x * x * (1 - x) * (1 - x)


def _bump2(x: Column) -> Column:
    """Second derivative of _bump."""
    return 2 - 12 * x + 12 * x * x


_LAYER = exp(20.0) - 1.0


def _corner(x: Column, y: Column) -> Column:
    r = F.greatest(F.sqrt(x * x + y * y), F.lit(1e-10))
    return F.pow(r, F.lit(2.0 / 3.0)) * sin(F.lit(2.0 / 3.0) * F.atan2(y, x))


_ZERO = lambda x, y: F.lit(0.0) * x
# The catalog's solutions, and the sources that follow from them.
_LIST = [
    Poisson("trigonometric", *_waves(1, 1)),
    Poisson("polynomial", lambda x, y: _bump(x) * _bump(y), lambda x, y: -(_bump2(x) * _bump(y) + _bump(x) * _bump2(y))),
    Poisson("exponential", lambda x, y: e_to(x + y), lambda x, y: -2 * e_to(x + y), False),
    Poisson("mixed", lambda x, y: x * x * y + sin(PI * x) * cos(PI * y), lambda x, y: -2 * y + 2 * PI * PI * sin(PI * x) * cos(PI * y), False),
    Poisson("high_frequency", *_waves(4, 4)),
    Poisson("boundary_layer", lambda x, y: (e_to(20 * x) - 1) / _LAYER * sin(PI * y), lambda x, y: (-400 * e_to(20 * x) + PI * PI * (e_to(20 * x) - 1)) / _LAYER * sin(PI * y), False),
    Poisson("anisotropic", *_waves(1, 2)),
    Poisson("corner_singularity", _corner, _ZERO, False, False),
    Poisson("l_shaped", _corner, _ZERO, False, False),
    Poisson("neumann_test", lambda x, y: x * x + y * y, lambda x, y: F.lit(-4.0) + 0 * x, False),
    Poisson("linear", lambda x, y: x + 2 * y, _ZERO, False),
    Poisson("quadratic", lambda x, y: x * x + y * y + x * y, lambda x, y: F.lit(-4.0) + 0 * x, False),
    Poisson("cubic", lambda x, y: x * x * x + y * y * y, lambda x, y: -6 * x - 6 * y, False),
    Poisson("quartic", lambda x, y: F.pow(x, 4) + F.pow(y, 4), lambda x, y: -12 * x * x - 12 * y * y, False),
    Poisson("mixed_polynomial", lambda x, y: x * x * x * y * y + x * y * y * y, lambda x, y: -(6 * x * y * y + 2 * x * x * x + 6 * x * y), False),
    Poisson("trig_multi", lambda x, y: sin(2 * PI * x) * sin(PI * y) + sin(PI * x) * sin(3 * PI * y), lambda x, y: 5 * PI * PI * sin(2 * PI * x) * sin(PI * y) + 10 * PI * PI * sin(PI * x) * sin(3 * PI * y)),
]
POISSON = {p.name: p for p in _LIST}
SELECTIONS = {"scalability": ["trigonometric", "polynomial"], "accuracy": ["trigonometric", "polynomial", "anisotropic", "boundary_layer"], "convergence": ["trigonometric", "high_frequency", "polynomial"]}


def _mode(a: float, b: float, alpha: float = 1.0) -> Callable:
    return lambda x, y, t: e_to(-(a * a + b * b) * PI * PI * alpha * t) * sin(a * PI * x) * sin(b * PI * y)


_still = lambda x, y, t: F.lit(0.0) * x
_S0 = 0.1


def _gauss(x: Column, y: Column, t: Column) -> Column:
    spread = F.lit(_S0 * _S0) + 2 * t
    return F.lit(_S0 * _S0) / spread * e_to(-((x - 0.5) * (x - 0.5) + (y - 0.5) * (y - 0.5)) / (2 * spread))


def _moving(x: Column, y: Column, t: Column) -> Column:
    return sin(PI * (x - t)) * sin(PI * y) * e_to(-t)


# Likewise for the heat equation.
_HEAT = [
    Heat("pure_diffusion", _mode(1, 1), _still),
    Heat("heat_source", lambda x, y, t: (1 - e_to(-t)) * sin(PI * x) * sin(PI * y), lambda x, y, t: (e_to(-t) + 2 * PI * PI * (1 - e_to(-t))) * sin(PI * x) * sin(PI * y)),
    Heat("gaussian_diffusion", _gauss, _still),
    Heat("separable", lambda x, y, t: e_to(-t) * sin(PI * x) * sin(PI * y), lambda x, y, t: (2 * PI * PI - 1) * e_to(-t) * sin(PI * x) * sin(PI * y)),
    Heat("time_dependent_bc", lambda x, y, t: t * (x + y), lambda x, y, t: x + y + 0 * t),
    Heat("multiple_frequencies", lambda x, y, t: _mode(1, 1)(x, y, t) + 0.5 * _mode(2, 3)(x, y, t), _still),
    Heat("traveling_wave", _moving, lambda x, y, t: (2 * PI * PI - 1) * _moving(x, y, t) - PI * cos(PI * (x - t)) * sin(PI * y) * e_to(-t)),
    Heat("polynomial_time", lambda x, y, t: t * t * sin(PI * x) * sin(PI * y), lambda x, y, t: (2 * t + 2 * PI * PI * t * t) * sin(PI * x) * sin(PI * y)),
    Heat("oscillating", lambda x, y, t: cos(2 * PI * t) * sin(PI * x) * sin(PI * y), lambda x, y, t: (-2 * PI * sin(2 * PI * t) + 2 * PI * PI * cos(2 * PI * t)) * sin(PI * x) * sin(PI * y)),
]
HEAT = {h.name: h for h in _HEAT}


def _modes(amplitudes: tuple[float, float]) -> Callable:
    """Two modes of the unit cube, each with a factor."""
    a, b = amplitudes
    return lambda x, y, z: a * sin(PI * x) * cos(2 * PI * y) * sin(3 * PI * z) + b * cos(2 * PI * x) * sin(PI * y) * cos(PI * z)


def _cube(amplitude: float) -> Callable:
    return lambda x, y, z: amplitude * sin(PI * x) * sin(PI * y) * sin(PI * z)


#: Solution and source on the unit cube, functions of x, y, z; no 3-D solver exists.
POISSON_3D = {"trigonometric_3d": (_cube(1.0), _cube(3 * PI * PI)), "trigonometric_3d_mixed": (_modes((1.0, 1.0)), _modes((14 * PI * PI, 6 * PI * PI)))}


def gaussian(center: tuple[float, float], width: float, amplitude: float) -> Callable[[Column, Column], Column]:
    """An initial condition amplitude exp(-r^2 / (2 width^2))."""
    return lambda x, y: F.lit(amplitude) * e_to(-((x - center[0]) * (x - center[0]) + (y - center[1]) * (y - center[1])) / (2 * width * width))
