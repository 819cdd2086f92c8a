"""Roots and polynomials; closed forms as columns, the rest as batch functions."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from lattica.functions.keys import col


def horner(coefs: list, x) -> Column:
    """Value of a polynomial, highest power first."""
    acc = col(coefs[0]) if not isinstance(coefs[0], (int, float)) else F.lit(float(coefs[0]))
    for c in coefs[1:]:
        acc = acc * col(x) + (col(c) if not isinstance(c, (int, float)) else F.lit(float(c)))
    return acc


def quadratic_roots(a, b, c) -> Column:
    """Real roots in ascending order (0 to 2 of them)."""
    a, b, c = col(a), col(b), col(c)
    disc = b * b - a * c * 4.0
    root = F.sqrt(F.greatest(disc, F.lit(0.0)))
    safe = F.when(a != 0, a)
    two = F.sort_array(F.array((-b - root) / (safe * 2.0), (-b + root) / (safe * 2.0)))
    line = F.when(b != 0, F.array(-c / F.when(b != 0, b))).otherwise(F.array().cast("array<double>"))
    return (F.when(a == 0, line).when(disc < 0, F.array().cast("array<double>"))
            .when(disc == 0, F.array(-b / (safe * 2.0))).otherwise(two))


SAME = 1e-13
"""A polynomial counts as zero where its value is this share of the sum of its terms' sizes."""


def _value(c: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Polynomials c (rows, highest power first) at several places each."""
    out = np.broadcast_to(c[:, :1], x.shape).copy()
    for k in range(1, c.shape[1]):
        out = out * x + c[:, k, None]
    return out


def roots_with_multiplicity(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Real roots in ascending order, NaN behind them, and how often each occurs, of polynomials of one degree.

    From the last derivative up, every derivative's roots part the line into pieces on which the
    polynomial above it is monotone.  Where it vanishes on one of them, both have that root (it is a root
    of their common divisor), once more often than below; a change of sign between two of them
    encloses one simple root, which is bisected.
    """
    n = c.shape[1] - 1
    ladder = [c / c[:, :1]]
    for k in range(n, 1, -1):
        ladder.append(ladder[-1][:, :-1] * (np.arange(k, 0, -1) / k))
    ladder.reverse()
    roots, times = -ladder[0][:, 1:2], np.ones((len(c), 1), np.int64)
    for p in ladder[1:]:
        k = p.shape[1] - 1
        # no root is larger than twice the largest i-th root of a coefficient
        bound = 2 * (np.abs(p[:, 1:]) ** (1 / np.arange(1, k + 1))).max(axis=1, keepdims=True) + np.finfo(float).tiny
        inner = np.where(np.isnan(roots), bound, roots)
        x = np.concatenate([-bound, inner, bound], axis=1)
        f = _value(p, x)
        # sizes are taken a little further out, so that they do not vanish with x
        f[np.abs(f) <= SAME * k * _value(np.abs(p), np.abs(x) + 1e-9 * bound)] = 0.0
        double = (f[:, 1:-1] == 0) & ~np.isnan(roots)
        f[:, 0], f[:, -1] = (-1) ** k, 1  # beyond all roots
        lo, hi = x[:, :-1].copy(), x[:, 1:].copy()
        crossed = f[:, :-1] * f[:, 1:] < 0
        rising = f[:, 1:] > 0
        for _ in range(80):
            mid = (lo + hi) / 2
            below = (_value(p, mid) < 0) == rising
            lo, hi = np.where(below, mid, lo), np.where(below, hi, mid)
        # pieces and the points between them in order: at most k of them are roots
        both = np.full((len(c), x.shape[1] + inner.shape[1] - 1), np.nan)
        count = np.ones(both.shape, np.int64)
        both[:, ::2] = np.where(crossed, (lo + hi) / 2, np.nan)
        both[:, 1::2] = np.where(double, roots, np.nan)
        count[:, 1::2] = times + 1
        order = np.argsort(np.isnan(both), axis=1, kind="stable")[:, :k]
        roots, times = np.take_along_axis(both, order, 1), np.take_along_axis(count, order, 1)
    return roots, np.where(np.isnan(roots), 0, times)


def real_roots_values(coefs: pd.Series) -> pd.Series:
    """Rows of equal degree are solved together; a root stands as often as it occurs."""
    out: list = [None] * len(coefs)
    by_size: dict[int, list[int]] = {}
    rows = [None if c is None else np.trim_zeros(np.asarray(c, float), "f") for c in coefs]
    for i, c in enumerate(rows):
        if c is not None and np.isfinite(c).all():
            by_size.setdefault(len(c), []).append(i)
    for n, idx in by_size.items():
        if n < 2:
            for i in idx:
                out[i] = []
            continue
        roots, times = roots_with_multiplicity(np.stack([rows[i] for i in idx]))
        for i, r, t in zip(idx, roots, times):
            out[i] = (np.repeat(r, t) + 0.0).tolist()
    return pd.Series(out, dtype=object)


def real_roots(coefs) -> Column:
    """Ascending real roots of polynomials of any degree, given as arrays, highest power first.

    A multiple root stands as often as it occurs; constants have none; null or non-finite coefficients give null.
    """
    def run(c: pd.Series) -> pd.Series:
        return real_roots_values(c)
    return F.pandas_udf(run, ArrayType(DoubleType()))(coefs)


def bisect(fn: Callable[..., np.ndarray], lo: float, hi: float, steps: int = 80):
    """Batch root of fn(x, *params) for params given as columns.

    The upper end of [lo, hi] doubles its distance until the sign changes; null where it never does.
    """
    @F.pandas_udf(DoubleType())
    def solve(params: pd.DataFrame) -> pd.Series:
        p = [params[c].to_numpy(float) for c in params]
        a, b = np.full(len(params), lo), np.full(len(params), hi)
        with np.errstate(all="ignore"):
            fa, fb = fn(a, *p), fn(b, *p)
            for _ in range(200):
                same = np.sign(fa) * np.sign(fb) > 0
                if not same.any():
                    break
                b = np.where(same, lo + 2 * (b - lo), b)
                fb = fn(b, *p)
            none = ~(np.sign(fa) * np.sign(fb) <= 0)
        for _ in range(steps):
            m = 0.5 * (a + b)
            fm = fn(m, *p)
            left = np.sign(fm) == np.sign(fa)
            a, b = np.where(left, m, a), np.where(left, b, m)
        return pd.Series(np.where(none, np.nan, 0.5 * (a + b))).astype("Float64").mask(none)
    return solve


def newton(fn: Callable[..., np.ndarray], x0: float, eps: float, max_iter: int):
    """Batch root by finite-difference Newton steps; rows stop when |f| <= eps."""
    @F.pandas_udf(DoubleType())
    def solve(params: pd.DataFrame) -> pd.Series:
        p = [params[c].to_numpy(float) for c in params]
        x = np.full(len(params), x0)
        for _ in range(max_iter):
            y = fn(x, *p)
            go = np.abs(y) > eps
            if not go.any():
                break
            slope = (fn(x + eps, *p) - y) / eps
            x = np.where(go, x - y / np.where(slope != 0, slope, 1.0), x)
        return pd.Series(x)
    return solve


def geometric_ratio():
    """Ratio x >= 0 with 1 + x + ... + x^(n-1) = c, for columns (n, c); null where there is none or any will do."""
    def gap(x: np.ndarray, n: np.ndarray, c: np.ndarray) -> np.ndarray:
        near = np.abs(x - 1) < 1e-6  # the closed form loses its digits there
        total = np.where(near, n + n * (n - 1) / 2 * (x - 1), (x**n - 1) / np.where(near, 1.0, x - 1))
        return np.where(n > 1, total - c, np.nan)
    return bisect(gap, 0.0, 1.0)


def poly2d_terms(order: int) -> list[tuple[int, int]]:
    """Exponents (of x, of y) of a full bivariate polynomial, degree by degree."""
    return [(d - j, j) for d in range(order + 1) for j in range(d + 1)]


def poly2d(coefs: list[float], order: int, x, y) -> Column:
    x, y = col(x), col(y)
    return sum((F.pow(x, F.lit(i)) * F.pow(y, F.lit(j)) * float(c) for c, (i, j) in zip(coefs, poly2d_terms(order))), F.lit(0.0))


def poly2d_derivative(coefs: list[float], order: int, wrt: str) -> list[float]:
    """Coefficients of the derivative, a polynomial one order lower."""
    low = {t: 0.0 for t in poly2d_terms(order - 1)}
    for c, (i, j) in zip(coefs, poly2d_terms(order)):
        if wrt == "x" and i:
            low[(i - 1, j)] += i * c
        if wrt == "y" and j:
            low[(i, j - 1)] += j * c
    return list(low.values())


def clip_interval(x, a: float, b: float, c: float, linear: bool = False) -> Column:
    """Identity to a, then a bend that reaches b at c and stays there."""
    x = col(x)
    if linear:
        bend = (x - a) * ((b - a) / (c - a)) + a
    else:
        p = (c - a) / (b - a)
        bend = F.lit(b) - F.pow(F.greatest(F.lit(c) - x, F.lit(0.0)), F.lit(p)) * ((b - a) / (c - a) ** p)
    return F.when(x >= c, b).when(x > a, bend).otherwise(x)
