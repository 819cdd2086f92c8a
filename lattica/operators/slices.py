"""Planes, colour maps, projections and depth along an axis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.functions import keys as K
from lattica.operators import order as O
from lattica.operators.interp import restore_copies
from lattica.schema import Grid

PLANE = {"x": ("y", "z"), "y": ("x", "z"), "z": ("x", "y")}


def slices(cells: DataFrame, at: tuple[int, int, int], value: str) -> DataFrame:
    """The three axis planes through a cell, in one pass over the cells."""
    hit = F.array(*[F.when(F.col(a) == p, F.struct(F.lit(a).alias("axis"), F.col(PLANE[a][0]).alias("u"), F.col(PLANE[a][1]).alias("w")))
                    for a, p in zip("xyz", at)])
    near = O.any_of([F.col(a) == p for a, p in zip("xyz", at)])
    return cells.where(near).select(F.explode(F.array_compact(hit)).alias("h"), F.col(value).alias("v")).select("h.*", "v")


def plane_pixels(spark, grid: Grid, axis: str, at: float, zoom: int, roi: tuple[int, int, int, int] | None = None) -> DataFrame:
    """Pixel centres of a plane at ``zoom`` pixels per cell as sampling points."""
    size = dict(zip("xyz", grid.dims))
    a, b = PLANE[axis]
    u0, w0, u1, w1 = roi or (0, 0, size[a] * zoom, size[b] * zoom)
    width = u1 - u0
    df = spark.range(width * (w1 - w0))
    u = (F.col("id") % width + u0).cast("bigint")
    w = (F.floor(F.col("id") / width) + w0).cast("bigint")
    pos = {a: (u + 0.5) / zoom, b: (w + 0.5) / zoom, axis: F.lit(float(at))}
    return df.select(u.alias("u"), w.alias("w"), *[pos[c].alias(f"p{c}") for c in "xyz"])


def block_plane(blocks: DataFrame, grid: Grid, axis: str, at: int) -> DataFrame:
    """Blocks cut by a plane, with their position in it."""
    xyz = dict(zip("xyz", K.block_coords("bid", grid)))
    a, b = PLANE[axis]
    return blocks.where(xyz[axis] == at).withColumns({"u": xyz[a], "w": xyz[b]})


def colour_map(df: DataFrame, value: str, lo: float, hi: float) -> DataFrame:
    """Blue to green to red over [lo, hi] as bytes."""
    t = F.greatest(F.least((F.col(value) - lo) / (hi - lo), F.lit(1.0)), F.lit(0.0))
    byte = lambda c: F.floor(c * 255.0 + 0.5).cast("int")
    return df.withColumns({"r": byte(t), "g": byte(F.lit(1.0) - F.abs(t * 2.0 - 1.0)), "b": byte(F.lit(1.0) - t)})


def accumulate(cells: DataFrame, value: str, axis: str, group_rows: int | None = None) -> DataFrame:
    """Inclusive running sum along an axis; a line is at most one domain edge long, longer
    ones are cut by range like any other running total."""
    keys = [c for c in "xyz" if c != axis]
    run = O.running(cells, keys, [axis], {"__before": F.col(value)}, group_rows=group_rows)
    return run.withColumn("depth", F.col("__before") + F.col(value)).drop("__before")


def depth_at(points: DataFrame, cells: DataFrame, value: str, grid: Grid) -> DataFrame:
    """Accumulated value from the low-x side up to each point's cell.

    The depth of a cell without data is that of the last stored one before it:
    points and cells share one running order, so no range join is needed.
    """
    cell = [F.floor(p).cast("bigint") for p in ("px", "py", "pz")]
    names = points.columns
    pts = points.select(*[c.alias(a) for c, a in zip(cell, "xyz")], F.struct(*names).alias("pt"))
    # copies of a point in one cell collapse before the ordering
    pts = pts.groupBy("x", "y", "z", "pt").agg(F.count("*").alias("copies"))
    src = cells.select("x", "y", "z", F.lit(0).alias("kind"), F.col(value).alias("v"), F.lit(None).cast(pts.schema["pt"].dataType).alias("pt"), F.lit(1).cast("bigint").alias("copies"))
    ask = pts.select("x", "y", "z", F.lit(1).alias("kind"), F.lit(0.0).alias("v"), "pt", "copies")
    run = O.running(src.unionByName(ask), ["y", "z"], ["x", "kind", "pt"], {"depth": F.col("v")})
    return restore_copies(run.where("kind = 1").select("pt", "depth", "copies")).select("pt.*", "depth")

