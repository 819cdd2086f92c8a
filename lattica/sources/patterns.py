"""Deterministic cell patterns over a whole domain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.functions import keys as K
from lattica.schema import Grid


def all_cells(spark, grid: Grid) -> DataFrame:
    """Every finest-level cell with block and voxel ids."""
    df = spark.range(grid.sx * grid.sy * grid.sz)
    i = F.col("id")
    z = F.floor(i / (grid.sx * grid.sy)).cast("bigint")
    rest = i - z * (grid.sx * grid.sy)
    y = F.floor(rest / grid.sx).cast("bigint")
    df = df.select((rest - y * grid.sx).alias("x"), y.alias("y"), z.alias("z"))
    return df.withColumns({"bid": K.cell_block_id("x", "y", "z", grid), "vid": K.voxel_id("x", "y", "z", grid.bsx)})


def at_cells(cells: DataFrame, grid: Grid) -> DataFrame:
    """Stored finest-level cells with block and voxel ids."""
    return cells.select("x", "y", "z", K.cell_block_id("x", "y", "z", grid).alias("bid"), K.voxel_id("x", "y", "z", grid.bsx).alias("vid"))


def pattern(kind: int, grid: Grid, level: int = 0) -> Column:
    """Value of a test pattern at a cell; kinds 0/1 index, 2 hash, 4 rings, 5 sphere."""
    if kind in (0, 1):
        return (F.col("bid") * 1000 + F.col("vid")).cast("double")
    if kind == 2:
        return K.hash_unit_float(F.col("bid") * 1000 + F.col("vid"))
    up = float(1 << level)
    if kind == 4:
        r = F.sqrt(sum((F.col(c) * up / min(grid.dims)) * (F.col(c) * up / min(grid.dims)) for c in "xyz"))
        return F.sin(r * 20.0) * 0.5
    if kind == 5:
        size = float(max(grid.dims))
        d2 = sum(((F.col(c) + 0.5) * up / size - m) * ((F.col(c) + 0.5) * up / size - m) for c, m in zip("xyz", (0.3, 0.3, 0.5)))
        return F.sqrt(d2) - 0.2
    raise ValueError(f"no pattern {kind}")
