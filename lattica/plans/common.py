"""Pieces the query modules share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lattica.functions.keys import col


def _nudge(digits: int) -> float:
    """Far below the last digit kept: decimal inputs make exact halves, which must not
    round by the last bit of a sum."""
    return 3.7 * 10.0 ** -(digits + 4)


def rnd(c, digits: int = 6) -> Column:
    """Rounded double without negative zero, so results print alike on any engine."""
    return F.round(col(c).cast("double") + _nudge(digits), digits) + F.lit(0.0)


def rsql(expr: str, digits: int = 6) -> str:
    return f"(round(CAST({expr} AS DOUBLE) + {_nudge(digits):.6e}, {digits}) + 0e0)"


BID = lambda s, nbx="nbx", nby="nby": f"((x >> {s}) + (y >> {s}) * {nbx} + (z >> {s}) * {nbx} * {nby})"
OFF26 = """off AS (SELECT dx, dy, dz FROM (SELECT unnest([-1, 0, 1]) AS dx) a, (SELECT unnest([-1, 0, 1]) AS dy) b,
      (SELECT unnest([-1, 0, 1]) AS dz) c WHERE NOT (dx = 0 AND dy = 0 AND dz = 0))"""
