"""Distribution functions: closed forms as columns, quantiles as batch functions."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from lattica.functions.keys import col

SQRT_2PI = math.sqrt(2.0 * math.pi)

# Five-term polynomial of the normal distribution function,
# its argument factor and its density factor.
NORM_TERMS = (0.3193815, -0.356538, 1.781478, -1.821256, 1.330274)
NORM_ARG = 0.2316419
NORM_FACTOR = 0.3989423

# Rational approximation of the normal quantile, highest power
# first (central numerator and denominator, tail numerator and denominator).
QUANTILE_CENTRE_NUM = (-39.69683028665376, 220.9460984245205, -275.9285104469687, 138.3577518672690, -30.66479806614716, 2.506628277459239)
QUANTILE_CENTRE_DEN = (-54.47609879822406, 161.5858368580409, -155.6989798598866, 66.80131188771972, -13.28068155288572, 1.0)
QUANTILE_TAIL_NUM = (-0.007784894002430293, -0.3223964580411365, -2.400758277161838, -2.549732539343734, 4.374664141464968, 2.938163982698783)
QUANTILE_TAIL_DEN = (0.007784695709041462, 0.3224671290700398, 2.445134137142996, 3.754408661907416, 1.0)
QUANTILE_TAIL = 0.02425


def horner(x: Column, highest_first) -> Column:
    acc = F.lit(float(highest_first[0]))
    for c in highest_first[1:]:
        acc = acc * x + c
    return acc


def norm_cdf(x) -> Column:
    x = col(x)
    y = F.lit(1.0) / (F.lit(1.0) + F.abs(x) * NORM_ARG)
    tail = F.exp(-(x * x) / 2.0) * NORM_FACTOR * y * horner(y, NORM_TERMS[::-1])
    return F.when(x > 0, F.lit(1.0) - tail).otherwise(tail)


def norm_quantile(p) -> Column:
    p = col(p)

    def tail(q: Column) -> Column:
        s = F.sqrt(F.ln(q) * -2.0)
        return horner(s, QUANTILE_TAIL_NUM) / horner(s, QUANTILE_TAIL_DEN)

    s = p - 0.5
    r = s * s
    centre = s * horner(r, QUANTILE_CENTRE_NUM) / horner(r, QUANTILE_CENTRE_DEN)
    return F.when(p < QUANTILE_TAIL, tail(p)).when(p > 1.0 - QUANTILE_TAIL, -tail(F.lit(1.0) - p)).otherwise(centre)


def norm_density(x, mu: float, sigma: float) -> Column:
    d = col(x) - mu
    return F.exp(-(d * d) / (2.0 * sigma * sigma)) / (sigma * SQRT_2PI)


def gauss_kernel(u: Column) -> Column:
    return F.exp(-(u * u) / 2.0) / SQRT_2PI


def option_price(call: bool, strike, years, price, vola, rate) -> Column:
    """Price of a European option on a lognormal asset."""
    s, t, p, v, r = (col(c) for c in (strike, years, price, vola, rate))
    spread = v * F.sqrt(t)
    due = s * F.exp(-(r * t))
    flat = (p - due) if call else (due - p)
    safe = F.when(v > 1e-20, spread)
    up = (F.ln(p / s) + (r + v * v / 2.0) * t) / safe
    down = up - spread
    if call:
        priced = p * norm_cdf(up) - due * norm_cdf(down)
    else:
        priced = due * norm_cdf(-down) - p * norm_cdf(-up)
    return F.coalesce(priced, flat)


def student_two_sided(t: float, m: float) -> float:
    """Probability that a t variable with m degrees of freedom exceeds |t| in magnitude."""
    x = m / (m + t * t)
    return _beta_inc(m / 2.0, 0.5, x)


def _beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x > (a + 1.0) / (a + b + 2.0):
        return 1.0 - _beta_inc(b, a, 1.0 - x)
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for k in range(1, 500):
        even = k * (b - k) * x / ((a + 2 * k - 1) * (a + 2 * k))
        odd = -(a + k) * (a + b + k) * x / ((a + 2 * k) * (a + 2 * k + 1))
        for step in (even, odd):
            d = 1.0 + step * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + step / c
            c = c if abs(c) > tiny else tiny
            h *= c * d
        if abs(c * d - 1.0) < 1e-15:
            break
    return front * h / a


def student_two_sided_values(t: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Two-sided exceedance of t with m degrees of freedom, a batch at a time.

    The regularised beta function at m / (m + t^2) by its continued fraction, evaluated from the
    last term on; where that converges badly its mirror image is used.
    """
    from math import lgamma

    with np.errstate(all="ignore"):
        x, a, b = m / (m + t * t), m / 2, np.full(len(m), 0.5)
        swap = x > (a + 1) / (a + b + 2)
        p, q, y = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - x, x)
        log_gamma = np.vectorize(lgamma, otypes=[float])
        ok = (m > 0) & np.isfinite(t)
        pg, qg = np.where(ok, p, 1.0), np.where(ok, q, 1.0)
        front = np.exp(log_gamma(pg + qg) - log_gamma(pg) - log_gamma(qg) + pg * np.log(y) + qg * np.log1p(-y)) / pg
        tail = np.ones(len(m))
        for k in range(300, 0, -1):
            odd = -(pg + k) * (pg + qg + k) * y / ((pg + 2 * k) * (pg + 2 * k + 1))
            even = k * (qg - k) * y / ((pg + 2 * k - 1) * (pg + 2 * k))
            tail = 1 + even / (1 + odd / tail)
        value = front / (1 - (pg + qg) * y / (pg + 1) / tail)
        value = np.where(y <= 0, 0.0, value)
        return np.where(ok, np.where(swap, 1 - value, value), np.nan)


def student_quantile(alpha: float, m: float) -> float:
    """t with two-sided exceedance alpha, by bisection."""
    lo, hi = 0.0, 10.0
    while student_two_sided(hi, m) > alpha:
        hi *= 2.0
    for _ in range(200):
        mid = 0.5 * (lo + hi)
        if student_two_sided(mid, m) > alpha:
            lo = mid
        else:
            hi = mid
    return 0.5 * (lo + hi)


def student_t(alpha, m) -> Column:
    """Quantile column; a batch computes each distinct (alpha, m) once."""
    def run(alpha: pd.Series, m: pd.Series) -> pd.Series:
        pairs = list(zip(alpha, m))
        known = {p: student_quantile(*p) if p[0] is not None and p[1] > 0 else np.nan for p in set(pairs)}
        return pd.Series([known[p] for p in pairs])
    return F.pandas_udf(run, DoubleType())(alpha, m)


def student_prob(t, m) -> Column:
    def run(t: pd.Series, m: pd.Series) -> pd.Series:
        return pd.Series(student_two_sided_values(np.abs(t.to_numpy(float)), m.to_numpy(float)))
    return F.pandas_udf(run, DoubleType())(t, m)


def corr_confidence(r, n, alpha: float) -> Column:
    """Above 1 the correlation is significant at level alpha."""
    m = (col(n) - 2).cast("double")
    stat = F.abs(col(r) * F.sqrt(m) / F.sqrt(F.lit(1.0) - col(r) * col(r)))
    return stat / student_t(F.lit(float(alpha)), m)
