"""Fixed-point storage codecs and half-away rounding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lattica.functions.keys import col

FULL16 = 65535
FULL8 = 255
MASS_SCALE = 2048.0


def round_half_away(c) -> Column:
    c = col(c)
    return F.signum(c) * F.floor(F.abs(c) + 0.5)


def encode_unit(c, full: int = FULL16, sqrt_compress: bool = False) -> Column:
    c = F.greatest(F.least(col(c), F.lit(1.0)), F.lit(0.0))
    if sqrt_compress:
        c = F.sqrt(c)
    return F.floor(c * float(full) + 0.5).cast("int")


def decode_unit(c, full: int = FULL16, sqrt_compress: bool = False) -> Column:
    v = col(c) / float(full)
    return v * v if sqrt_compress else v


def encode_mass(c) -> Column:
    v = round_half_away(col(c) * MASS_SCALE)
    return F.greatest(F.least(v, F.lit(float(FULL16))), F.lit(0.0)).cast("int")


def decode_mass(c) -> Column:
    return col(c) / MASS_SCALE


def stochastic_round(c, draw) -> Column:
    """Round up with probability equal to the fractional part; ``draw`` is uniform."""
    lo = F.floor(col(c))
    return (lo + F.when(col(draw) < col(c) - lo, 1).otherwise(0)).cast("int")


def scale_offset(c, scale: float, offset: float) -> Column:
    return col(c) * scale + offset
