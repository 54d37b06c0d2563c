"""Student's t distribution as column expressions, from the incomplete beta function.

Degrees of freedom are whole or not, from 1 up; beyond ``MOST_FREEDOM`` the distribution stays as it is
there, which differs from the normal one by less than 1e-5 of a quantile.
"""

from __future__ import annotations

from math import pi
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

MOST_FREEDOM = 100_000
#: Steps of the continued fraction, and of Newton's method for quantiles.
FRACTION_STEPS, NEWTON_STEPS = 300, 12
TINY = 1e-300


def log_gamma(z: Column) -> Column:
    """Stirling's series eight places up, for positive z."""
    w = z + 8.0
    series = 1 / (12 * w) - 1 / (360 * w * w * w) + 1 / (1260 * F.pow(w, F.lit(5.0))) - 1 / (1680 * F.pow(w, F.lit(7.0)))
    product = z
    for k in range(1, 8):
        product = product * (z + float(k))
    return (w - 0.5) * F.log(w) - w + 0.5 * F.log(F.lit(2 * pi)) + series - F.log(product)


def _once(f, *values: Column) -> Column:
    """f of values that are worked out before, through a one-element array; a lambda works out a column anew at each use."""
    given = F.array(F.struct(*[v.alias(f"v{n}") for n, v in enumerate(values)]))
    return F.transform(given, lambda s: f(*[s[f"v{n}"] for n in range(len(values))]))[0]


def _fraction(a: Column, b: Column, x: Column) -> Column:
    """The continued fraction of the incomplete beta function, by the modified Lentz method."""
    apart = lambda v: F.when(F.abs(v) < TINY, TINY).otherwise(v)
    d0 = 1 / apart(1 - (a + b) * x / (a + 1))
    start = F.struct(F.lit(1.0).alias("c"), d0.alias("d"), d0.alias("h"))

    def half(s: Column, term: Column) -> Column:
        next_ = lambda h, c, d: F.struct(c.alias("c"), d.alias("d"), (h * d * c).alias("h"))
        return _once(lambda h, c, d: next_(h, apart(c), 1 / apart(d)), s["h"], 1 + term / s["c"], 1 + term * s["d"])

    def step(s: Column, m: Column) -> Column:
        even = half(s, m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)))
        return _once(lambda e: half(e, -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))), even)

    steps = F.transform(F.sequence(F.lit(1), F.lit(FRACTION_STEPS)), lambda m: m.cast("double"))
    return F.aggregate(steps, start, step, lambda s: s["h"])


def incomplete_beta(a: Column, b: Column, x: Column) -> Column:
    """The regularised incomplete beta function of x in [0, 1]."""
    return _once(_incomplete_beta, a, b, x)


def _incomplete_beta(a: Column, b: Column, x: Column) -> Column:
    front = F.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * F.log(x) + b * F.log(1 - x))
    direct = front * _fraction(a, b, x) / a
    mirrored = 1 - front * _fraction(b, a, 1 - x) / b
    return F.when(x <= 0, 0.0).when(x >= 1, 1.0).when(x < (a + 1) / (a + b + 2), direct).otherwise(mirrored)


def two_sided(t: Column, freedom: Column) -> Column:
    """P(|T| >= |t|); null for a null or NaN t, and for fewer than one degree of freedom."""
    v = F.least(freedom.cast("double"), F.lit(float(MOST_FREEDOM)))
    t = t.cast("double")
    p = F.when(F.abs(t) == float("inf"), 0.0).otherwise(incomplete_beta(v / 2, F.lit(0.5), v / (v + t * t)))
    return F.when((v >= 1) & ~F.isnan(t), p)


def quantile(freedom: Column, confidence: float = 0.95) -> Column:
    """The t that |T| stays below with this probability; null for fewer than one degree of freedom.

    One and two degrees have closed forms; above, Newton's method starts at the usual expansion around the normal quantile.
    """
    if not 0 < confidence < 1:
        raise ValueError("a confidence between 0 and 1")
    z, tail = NormalDist().inv_cdf((1 + confidence) / 2), 1 - confidence
    v = F.least(freedom.cast("double"), F.lit(float(MOST_FREEDOM)))
    start = z + (z**3 + z) / (4 * v) + (5 * z**5 + 16 * z**3 + 3 * z) / (96 * v * v) + (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / (384 * v * v * v)
    scale = F.exp(log_gamma((v + 1) / 2) - log_gamma(v / 2)) / F.sqrt(v * pi)

    def newton(t: Column, _: Column) -> Column:
        density = scale * F.pow(1 + t * t / v, -(v + 1) / 2)
        return t + (incomplete_beta(v / 2, F.lit(0.5), v / (v + t * t)) - tail) / (2 * density)

    found = F.aggregate(F.sequence(F.lit(1), F.lit(NEWTON_STEPS)), start, newton)
    one = F.tan(F.lit(pi / 2 * confidence))
    two = F.lit(2 * confidence * (1 / (2 * (1 - confidence * confidence))) ** 0.5)
    return F.when(v < 1, None).when(v == 1, one).when(v == 2, two).otherwise(found)
