"""Gradient noise, fractal sums and divergence-free fields, in Arrow batches.

Lattice gradients come from hashing the lattice point with a seed, so there is no
table to ship and any point can be evaluated anywhere.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from lattica.functions.keys import COORD_PRIMES, mix32_values


def _lattice(cells: list[np.ndarray], seed: int) -> np.ndarray:
    h = np.full(cells[0].shape, np.uint32(seed * 2654435761 & 0xFFFFFFFF))
    with np.errstate(over="ignore"):
        for c, p in zip(cells, COORD_PRIMES):
            h = h ^ (c.astype(np.int64) * p).astype(np.uint32)
    return mix32_values(h)


def _gradient(h: np.ndarray, d: list[np.ndarray]) -> np.ndarray:
    """Dot product of offsets with a hashed direction, one signed unit per axis less one."""
    n = len(d)
    if n == 1:
        return np.where(h & 1, d[0], -d[0]) * ((h >> 1) % 8 + 1) / 8.0
    out = np.zeros_like(d[0])
    skip = (h >> np.uint32(8)) % np.uint32(n) if n > 2 else np.full(h.shape, n, np.uint32)
    for k in range(n):
        sign = np.where((h >> np.uint32(k)) & np.uint32(1), 1.0, -1.0)
        out += np.where(skip == k, 0.0, sign * d[k])
    return out


def noise_values(pos: list[np.ndarray], seed: int = 0) -> np.ndarray:
    """Smooth noise near [-1, 1], zero on lattice points, in 1 to 4 dimensions."""
    n = len(pos)
    base = [np.floor(p) for p in pos]
    frac = [p - b for p, b in zip(pos, base)]
    fade = [t**3 * (t * (t * 6 - 15) + 10) for t in frac]
    out = np.zeros_like(pos[0])
    for corner in range(1 << n):
        bits = [(corner >> k) & 1 for k in range(n)]
        w = np.ones_like(pos[0])
        for t, b in zip(fade, bits):
            w = w * (t if b else 1 - t)
        g = _gradient(_lattice([b + o for b, o in zip(base, bits)], seed), [t - o for t, o in zip(frac, bits)])
        out += w * g
    return out


def fractal_values(pos: list[np.ndarray], octaves: float, alpha: float, beta: float, turbulence: bool = False, seed: int = 0) -> np.ndarray:
    """Octaves of noise: frequency times beta and amplitude over alpha each; the last one fades in."""
    out, amp, freq = np.zeros_like(pos[0]), 1.0, 1.0
    for k in range(int(np.ceil(octaves))):
        share = min(1.0, octaves - k)
        v = noise_values([p * freq for p in pos], seed + k)
        out += amp * share * (np.abs(v) if turbulence else v)
        amp, freq = amp / alpha, freq * beta
    return out


def curl_values(pos: list[np.ndarray], seed: int = 0, eps: float = 1e-4, octaves: float = 1.0, alpha: float = 2.0, beta: float = 2.0) -> list[np.ndarray]:
    """Curl of three noise potentials over the first three coordinates; divergence-free."""
    def slope(which: int, axis: int) -> np.ndarray:
        hi = [p + eps * (k == axis) for k, p in enumerate(pos)]
        lo = [p - eps * (k == axis) for k, p in enumerate(pos)]
        s = seed + 101 * which
        return (fractal_values(hi, octaves, alpha, beta, seed=s) - fractal_values(lo, octaves, alpha, beta, seed=s)) / (2 * eps)
    return [slope(2, 1) - slope(1, 2), slope(0, 2) - slope(2, 0), slope(1, 0) - slope(0, 1)]


def _arrays(df: pd.DataFrame) -> list[np.ndarray]:
    return [df[c].to_numpy(np.float64) for c in df]


def _packed(coords) -> Column:
    return F.struct(*[(F.col(c) if isinstance(c, str) else c).cast("double").alias(f"c{i}") for i, c in enumerate(coords)])


def noise(*coords, seed: int = 0) -> Column:
    @F.pandas_udf(DoubleType())
    def run(df: pd.DataFrame) -> pd.Series:
        return pd.Series(noise_values(_arrays(df), seed))
    return run(_packed(coords))


def fractal(*coords, octaves: float = 4.0, alpha: float = 1.5, beta: float = 1.97, turbulence: bool = False, seed: int = 0) -> Column:
    @F.pandas_udf(DoubleType())
    def run(df: pd.DataFrame) -> pd.Series:
        return pd.Series(fractal_values(_arrays(df), octaves, alpha, beta, turbulence, seed))
    return run(_packed(coords))


def curl(*coords, seed: int = 0, octaves: float = 1.0) -> Column:
    @F.pandas_udf(StructType([StructField(c, DoubleType()) for c in "xyz"]))
    def run(df: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(dict(zip("xyz", curl_values(_arrays(df), seed, octaves=octaves))))
    return run(_packed(coords))
