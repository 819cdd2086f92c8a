"""Block topology: neighbourhoods, refinement levels, flags, transition distance.

A block tells its neighbours about itself and one aggregation per receiver
reduces what arrived, so neighbour questions cost one combinable shuffle and no
self-join.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.functions import keys as K
from lattica.schema import BLOCK_FLAGS, Grid

OFFSETS26 = [(dx, dy, dz) for dz in (-1, 0, 1) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if (dx, dy, dz) != (0, 0, 0)]
OFFSETS6 = [o for o in OFFSETS26 if sum(map(abs, o)) == 1]


def offset_array(offsets) -> Column:
    return F.array(*[
        F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy"), F.lit(dz).alias("dz")) for dx, dy, dz in offsets
    ])


def all_blocks(spark, grid: Grid) -> DataFrame:
    """Every block of the domain with its coordinates."""
    df = spark.range(grid.n_blocks).withColumnRenamed("id", "bid")
    bx, by, bz = K.block_coords("bid", grid)
    return df.select("bid", bx.alias("bx"), by.alias("by"), bz.alias("bz"))


def with_coords(blocks: DataFrame, grid: Grid) -> DataFrame:
    bx, by, bz = K.block_coords("bid", grid)
    return blocks.withColumns({"bx": bx, "by": by, "bz": bz})


def tell_neighbours(blocks: DataFrame, grid: Grid, payload: list[str], offsets=OFFSETS26) -> DataFrame:
    """One row per (block, in-range neighbour): receiver ``bid``, sender ``src``, payload.

    ``dx, dy, dz`` point from the receiver to the sender.
    """
    src = with_coords(blocks.select("bid", *payload), grid)
    fan = src.select("*", F.explode(offset_array(offsets)).alias("o"))
    rx, ry, rz = (F.col("bx") - F.col("o.dx"), F.col("by") - F.col("o.dy"), F.col("bz") - F.col("o.dz"))
    return fan.where(K.block_in_range(rx, ry, rz, grid)).select(
        K.block_id(rx, ry, rz, grid).alias("bid"),
        F.col("bid").alias("src"),
        F.col("o.dx").alias("dx"),
        F.col("o.dy").alias("dy"),
        F.col("o.dz").alias("dz"),
        *payload,
    )


def neighbour_reduce(blocks: DataFrame, grid: Grid, keep: list[str], aggs: dict[str, Column],
                     payload: list[str], offsets=OFFSETS26) -> DataFrame:
    """Aggregate the neighbours of each block beside its own ``keep`` columns.

    ``aggs`` are aggregates over ``n_<payload>`` columns, null on the block's own row.
    """
    own = blocks.select(
        "bid", F.lit(True).alias("own"), *keep, *[F.lit(None).cast(blocks.schema[p].dataType).alias(f"n_{p}") for p in payload]
    )
    heard = tell_neighbours(blocks, grid, payload, offsets).select(
        "bid", F.lit(False).alias("own"),
        *[F.lit(None).cast(blocks.schema[k].dataType).alias(k) for k in keep],
        *[F.col(p).alias(f"n_{p}") for p in payload],
    )
    reduced = own.unionByName(heard).groupBy("bid").agg(
        F.bool_or("own").alias("own"), *[F.max(k).alias(k) for k in keep], *[c.alias(n) for n, c in aggs.items()]
    )
    return reduced.where("own").drop("own")


def active_blocks(points: DataFrame, grid: Grid, radius: float, least: int = 1) -> DataFrame:
    """Blocks that the boxes of half-width ``radius`` around at least so many points touch."""
    hits = block_hits(points, grid, radius).groupBy("bid").agg(F.count("*").alias("n"))
    return hits.where(F.col("n") >= least).select("bid")


def block_hits(points: DataFrame, grid: Grid, radius: float) -> DataFrame:
    """Range join of points to blocks: one row per touched block."""
    edge = float(grid.bsx)
    df = points
    for p, b, n in zip(("px", "py", "pz"), ("bx", "by", "bz"), grid.block_dims):
        lo = F.greatest(F.floor((F.col(p) - radius) / edge), F.lit(0))
        hi = F.least(F.floor((F.col(p) + radius) / edge), F.lit(n - 1))
        df = df.withColumn(b, F.explode(F.when(lo <= hi, F.sequence(lo, hi))))
    return df.withColumn("bid", K.block_id("bx", "by", "bz", grid))


def assign_levels(all_: DataFrame, active: DataFrame, grid: Grid) -> DataFrame:
    """Finest level where active, coarsest elsewhere."""
    marked = active.select("bid").withColumn("hit", F.lit(1))
    return all_.join(marked, "bid", "left").select(
        *all_.columns, F.when(F.col("hit").isNotNull(), 0).otherwise(grid.n_levels - 1).alias("level")
    )


def regularize_levels(levels: DataFrame, grid: Grid) -> DataFrame:
    """Insert intermediate levels until neighbours differ by at most one."""
    out = levels.select("bid", "level")
    for ll in range(1, grid.n_levels - 1):
        out = neighbour_reduce(out, grid, ["level"], {"finest": F.min("n_level")}, ["level"]).select(
            "bid",
            F.when((F.col("level") >= ll) & (F.coalesce("finest", F.lit(grid.n_levels - 1)) == ll - 1), ll)
            .otherwise(F.col("level")).alias("level"),
        )
    return out


def block_flags(levels: DataFrame, grid: Grid, level_mg: int = 0) -> DataFrame:
    """Flag word of each block; input columns are bid, level and ``exists``."""
    src = levels.select("bid", F.greatest(F.col("level"), F.lit(level_mg)).alias("level"), "exists")
    red = neighbour_reduce(
        src, grid, ["level", "exists"],
        {"nmax": F.max("n_level"), "nmin": F.min("n_level")}, ["level"],
    )
    bx, by, bz = K.block_coords("bid", grid)
    border = reduce(lambda a, b: a | b, [(c == 0) | (c == n - 1) for c, n in zip((bx, by, bz), grid.block_dims)])
    finer = F.coalesce(F.col("nmin") < F.col("level"), F.lit(False))
    coarser = F.coalesce(F.col("nmax") > F.col("level"), F.lit(False))
    bit = lambda cond, name: F.when(cond, BLOCK_FLAGS[name]).otherwise(0)
    empty = ~F.col("exists") & ~finer & ~coarser
    flags = (
        bit(F.col("exists"), "EXISTS") + bit(border, "DOM_BORDER") + bit(coarser, "FINE_COARSE")
        + bit(finer, "COARSE_FINE") + bit(empty, "UNIFORM_EMPTY")
    )
    return red.select("bid", "level", flags.cast("int").alias("flags"))


def transition_distance(levels: DataFrame, grid: Grid, d_max: float = 6.0) -> DataFrame:
    """Distance of each cell to the nearest coarser neighbour block, in 1/1024 cells.

    Only blocks that have a coarser neighbour produce rows; elsewhere the
    distance is ``d_max``.
    """
    heard = tell_neighbours(levels, grid, ["level"]).withColumnRenamed("level", "n_level")
    box = F.struct(*[F.col(c).alias(c) for c in ("dx", "dy", "dz")])
    own = levels.select("bid", "level", F.lit(None).cast("int").alias("n_level"), F.lit(None).cast(
        "struct<dx:int,dy:int,dz:int>").alias("o"))
    both = own.unionByName(heard.select("bid", F.lit(None).cast("int").alias("level"), "n_level", box.alias("o")))
    per_block = both.groupBy("bid").agg(
        F.max("level").alias("level"),
        F.collect_list(F.when(F.col("o").isNotNull(), F.struct("n_level", "o"))).alias("nb"),
    )
    near = per_block.select(
        "bid", "level", F.expr("transform(filter(nb, n -> n.n_level > level), n -> n.o)").alias("coarse")
    ).where(F.size("coarse") > 0)
    edge = K.shr(F.lit(grid.bsx), "level")
    cells_ = near.select("*", edge.alias("e")).select(
        "*", F.explode(F.sequence(F.lit(0), F.col("e") * F.col("e") * F.col("e") - 1)).alias("vid")
    )
    v = {
        "vx": F.col("vid") % F.col("e"),
        "vy": F.floor(F.col("vid") / F.col("e")) % F.col("e"),
        "vz": F.floor(F.col("vid") / (F.col("e") * F.col("e"))),
    }
    cells_ = cells_.withColumns(v)
    # distance from the cell centre to the box one block away along each offset
    d2 = F.expr(
        """array_min(transform(coarse, o ->
             pow(greatest(o.dx * e - (vx + 0.5D), 0.0D, (vx + 0.5D) - (o.dx + 1) * e), 2)
           + pow(greatest(o.dy * e - (vy + 0.5D), 0.0D, (vy + 0.5D) - (o.dy + 1) * e), 2)
           + pow(greatest(o.dz * e - (vz + 0.5D), 0.0D, (vz + 0.5D) - (o.dz + 1) * e), 2)))"""
    )
    return cells_.select(
        "bid", "level", F.col("vid").cast("bigint").alias("vid"),
        F.floor(F.least(F.sqrt(d2), F.lit(d_max)) * 1024.0).cast("int").alias("dist"),
    )


def refinement_map(blocks: DataFrame, grid: Grid, kind: int, centre=(0.0, 0.0, 0.0)) -> DataFrame:
    """Synthetic level maps: all fine, or spheres of three sizes, plus two lone fine blocks."""
    scale = float(min(grid.block_dims))
    coarse = grid.n_levels - 1
    if kind == 0:
        level = F.lit(0)
    else:
        radius, c = {1: (1 / 2.5, centre), 2: (0.8, (0.2,) * 3), 3: (0.4, (0.2,) * 3)}[kind]
        r = F.sqrt(sum(((F.col(b) + 0.5) / scale - F.lit(float(m))) * ((F.col(b) + 0.5) / scale - F.lit(float(m)))
                       for b, m in zip(("bx", "by", "bz"), c)))
        fine = r < radius
        if kind == 1:
            fine = fine | ((F.col("bx") == grid.nbx // 2) & (F.col("bz") == grid.nbz // 2))
        level = F.when(fine, 0).otherwise(coarse)
    lone = (grid.nbx - 3, grid.nby - 3, grid.nbz // 2)
    at = lambda p: reduce(lambda a, b: a & b, [F.col(n) == v for n, v in zip(("bx", "by", "bz"), p)])
    alone = at(lone) | at(tuple(v - 1 for v in lone))
    return blocks.withColumn("level", F.when(alone, 0).otherwise(level).cast("int"))


def level_census(levels: DataFrame, grid: Grid) -> DataFrame:
    """Blocks and cells per level, with the share of the domain they fill."""
    edge = K.shr(F.lit(grid.bsx), "level").cast("bigint")
    return levels.groupBy("level").agg(F.count("*").alias("n_blocks")).select(
        "level", "n_blocks", (F.col("n_blocks") * edge * edge * edge).alias("n_cells"),
        (F.col("n_blocks") / float(grid.n_blocks)).alias("fill"),
    )


def const_blocks(cells: DataFrame, grid: Grid, value: str, eps: float) -> DataFrame:
    """Blocks whose values span at most ``eps`` collapse to one constant."""
    bid = K.cell_block_id("x", "y", "z", grid)
    return cells.groupBy(bid.alias("bid")).agg(
        F.min(value).alias("vmin"), F.max(value).alias("vmax"), F.count("*").alias("n")
    ).select("bid", "vmin", "vmax", ((F.col("vmax") - F.col("vmin") <= eps) & (F.col("n") == grid.bsx**3)).alias("is_const"))


def set_flags(c, mask: int) -> Column:
    return K.col(c).bitwiseOR(F.lit(mask))


def clear_flags(c, mask: int) -> Column:
    return K.col(c).bitwiseAND(F.lit(~mask))
