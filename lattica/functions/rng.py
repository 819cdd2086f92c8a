"""Reproducible draws: every value is a function of a row key and a seed.

Draws do not depend on partitioning or on which attempt of a task made them.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from lattica.functions import keys as K
from lattica.functions.dist import norm_cdf, norm_quantile
from lattica.operators import order as O

STRIDE = 1_000_003  # fixed value: spreads seeds over the key space


def stream_key(key, seed: int, draw: int = 0) -> Column:
    return K.big(key) * STRIDE + (seed * 131 + draw)


def uniform(key, seed: int, draw: int = 0) -> Column:
    """In (0, 1): 52 hash bits plus a half step."""
    bits = F.shiftrightunsigned(K.mix64(stream_key(key, seed, draw)), 12)
    return (bits + 0.5) * 2.0**-52


def normal(key, seed: int, mu: float = 0.0, sigma: float = 1.0, draw: int = 0) -> Column:
    return norm_quantile(uniform(key, seed, draw)) * sigma + mu


def truncated_normal(key, seed: int, mu: float, sigma: float, lo: float, hi: float, draw: int = 0) -> Column:
    """Normal restricted to [lo, hi], by inverting the restricted distribution."""
    a, b = norm_cdf(F.lit((lo - mu) / sigma)), norm_cdf(F.lit((hi - mu) / sigma))
    z = norm_quantile(a + (b - a) * uniform(key, seed, draw)) * sigma + mu
    return F.greatest(F.least(z, F.lit(hi)), F.lit(lo))


def gamma_like(key, seed: int, shape: float, scale: float = 1.0, draw: int = 0) -> Column:
    """Approximate gamma draw: cube of a shifted normal."""
    c = 1.0 / (9.0 * shape)
    t = normal(key, seed, draw=draw) * c**0.5 + (1.0 - c)
    return F.greatest(t, F.lit(0.0)) * t * t * (shape * scale)


def correlated_normals(key, seed: int, mean: list[float], cov: list[list[float]]) -> Column:
    """Array of normals with a given covariance: a triangular factor times plain normals."""
    low = np.linalg.cholesky(np.asarray(cov, float))
    m = np.asarray(mean, float)

    @F.pandas_udf(ArrayType(DoubleType()))
    def mix(z: pd.DataFrame) -> pd.Series:
        return pd.Series(list(z.to_numpy(float) @ low.T + m))

    return mix(F.struct(*[normal(key, seed, draw=i).alias(f"z{i}") for i in range(len(mean))]))


def shuffled(df: DataFrame, key: str, seed: int, group_rows: int | None = None) -> DataFrame:
    """Position of each row in a random order of the whole table."""
    return O.indexed(df.withColumn("__u", K.mix64(stream_key(key, seed))), [], ["__u", key], group_rows).drop("__u")
