"""Ramps, clamps and sign helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lattica.functions.keys import col


def _lit(v) -> Column:
    return F.lit(float(v)) if isinstance(v, (int, float)) else v


def linstep(a, b, x) -> Column:
    """0 below a, 1 from b on, straight in between."""
    a, b, x = _lit(a), _lit(b), col(x)
    return F.when(x < a, 0.0).when(x >= b, 1.0).otherwise((x - a) / (b - a))


def smoothstep(a, b, x) -> Column:
    t = linstep(a, b, x)
    return t * t * (F.lit(3.0) - t * 2.0)


def linfit(x, x0, y0, x1, y1) -> Column:
    return _lit(y0) + (_lit(y1) - _lit(y0)) * linstep(x0, x1, x)


def almost_identity(m: float, n: float, x) -> Column:
    """Identity above m; below it a cubic that reaches n at zero."""
    x = col(x)
    t = x / m
    cubic = (t * (2.0 * n - m) + (2.0 * m - 3.0 * n)) * t * t + n
    return F.when(x > m, x).otherwise(cubic)


def soft_clamp_to_zero(m1: float, m2: float, x) -> Column:
    x = col(x)
    return F.when(x < m1, 0.0).otherwise(almost_identity(m2 - m1, -m1, x - m1) + m1)


def sign_or_one(x) -> Column:
    """-1 for negatives, +1 otherwise, zero included."""
    return F.when(col(x) < 0, -1.0).otherwise(1.0)


def signum(x) -> Column:
    return F.signum(col(x))


def abs_pow(x, p: float) -> Column:
    """Power of the magnitude, carrying the sign."""
    x = col(x)
    return F.signum(x) * F.pow(F.abs(x), F.lit(p))


def rel_diff(a, b, tiny: float = 1e-12) -> Column:
    """(larger - smaller) / smaller of the magnitudes; the other one if one is ~0."""
    p, q = F.abs(col(a)), F.abs(col(b))
    lo, hi = F.least(p, q), F.greatest(p, q)
    return F.when(lo < tiny, hi).otherwise((hi - lo) / F.greatest(lo, F.lit(tiny)))
