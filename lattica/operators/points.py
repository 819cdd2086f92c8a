"""Points on a grid: binning, radius scatter and density."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.functions import codec, keys as K
from lattica.functions.ramp import linstep
from lattica.schema import Grid


def bin_points(points: DataFrame, grid: Grid) -> DataFrame:
    """Owning block of each point: a computed key, no join."""
    cell = [F.floor(p).cast("bigint") for p in ("px", "py", "pz")]
    return points.withColumn("bid", K.cell_block_id(*cell, grid))


def voxel_hits(points: DataFrame, grid: Grid, radius: float) -> DataFrame:
    """Radius join of points to voxel centres (distance at most ``radius``).

    x is expanded first, y only inside the circle x leaves, z only inside the
    chord: about half the rows of the full box ever exist.  The chord is widened
    by a hair and the exact test decides.
    """
    r2 = radius * radius
    slack = 1e-9
    df = points.withColumn("left", F.lit(r2))
    for p, c, s in zip(("px", "py", "pz"), ("x", "y", "z"), grid.dims):
        half = F.sqrt(F.greatest(F.col("left"), F.lit(0.0))) + slack
        lo = F.greatest(F.ceil(F.col(p) - half - 0.5), F.lit(0))
        hi = F.least(F.floor(F.col(p) + half - 0.5), F.lit(s - 1))
        df = df.withColumn(c, F.explode(F.when(lo <= hi, F.sequence(lo, hi))))
        d = F.col(c) - (F.col(p) - 0.5)
        df = df.withColumn("left", F.col("left") - d * d)
    d = [F.col(c) - (F.col(p) - 0.5) for p, c in zip(("px", "py", "pz"), ("x", "y", "z"))]
    d2 = d[2] * d[2] + d[1] * d[1] + d[0] * d[0]
    return df.withColumn("d2", d2).where(F.col("d2") <= r2).drop("left")


def scatter(hits: DataFrame, value: Column, how: str, name: str) -> DataFrame:
    """Combine what lands on one voxel; partial results combine before the shuffle."""
    fn = {"min": F.min, "max": F.max, "add": F.sum}[how]
    return hits.groupBy("x", "y", "z").agg(fn(value).alias(name))


def gathered(points: DataFrame, edge: int = 32) -> DataFrame:
    """Near points in the same task, so that what they scatter combines before it is shuffled.

    Cubes of ``edge`` cells lie in order and a crowded one is cut by the points' own positions.
    """
    at = ("px", "py", "pz")
    return points.repartitionByRange(*[F.floor(F.col(p) / edge) for p in reversed(at)], *at)


def splat_min_distance(points: DataFrame, grid: Grid, r_particle: float, band: float) -> DataFrame:
    """Least squared distance to any point, relative to the cut-off, as 16 bit."""
    d_max = r_particle + band
    # a point without a whole position is near nothing; equal points give equal distances: collapse them before they fan out
    distinct = gathered(points.select("px", "py", "pz").dropna().distinct())
    near = scatter(voxel_hits(distinct, grid, d_max), F.col("d2"), "min", "d2")
    return near.select("x", "y", "z", codec.encode_unit(F.col("d2") * (1.0 / (d_max * d_max))).alias("q"))


def finalise_density(splat: DataFrame, r_particle: float, band: float) -> DataFrame:
    """Turn stored distance into density: 1 well inside, falling to 0 at the cut-off."""
    d_max = r_particle + band
    rel = codec.decode_unit("q")
    dist = F.sqrt(rel * (d_max * d_max)) - r_particle
    dens = F.lit(1.0) - linstep(-r_particle, r_particle + band, dist)
    return splat.select("x", "y", "z", F.when(rel < 0.999, codec.encode_unit(dens)).otherwise(0).cast("int").alias("dens"))


def bounding_box(points: DataFrame) -> DataFrame:
    return points.agg(*[f(c).alias(f"{n}_{c}") for c in ("px", "py", "pz") for n, f in (("min", F.min), ("max", F.max))],
                      F.count("*").alias("n"))


def instantiate(base: DataFrame, spots: DataFrame, scale: float, centre=(0.0, 0.0, 0.0), chunk: int = 4096) -> DataFrame:
    """A scaled copy of the base shape, a set of points, at every spot.

    The result has |base| x |spots| rows by definition.  The shape is cut into
    hashed chunks of about ``chunk`` points; every spot visits each chunk by an
    equi-join, so neither side is ever held whole by a task.
    """
    names = ("px", "py", "pz")
    shape = base.select(*names).distinct()
    n_chunks = max(1, -(-shape.count() // chunk))
    parts = shape.select(
        F.pmod(F.xxhash64(*names), F.lit(n_chunks)).alias("part"),
        F.struct(*[((F.col(p) - c) * scale).alias(p) for p, c in zip(names, centre)]).alias("m"),
    ).groupBy("part").agg(F.collect_list("m").alias("ms"))
    visits = spots.select(*names, F.explode(F.sequence(F.lit(0), F.lit(n_chunks - 1)).cast("array<bigint>")).alias("part"))
    return visits.join(parts, "part").select(*names, F.explode("ms").alias("m")).select(
        *[(F.col(p) + F.col(f"m.{p}")).alias(p) for p in names])
