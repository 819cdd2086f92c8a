"""Channel algebra and reductions over co-keyed cell tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.functions import keys as K
from lattica.schema import CELL_FLAGS, Grid

XYZ = ("x", "y", "z")
FLUID_MASK = CELL_FLAGS["SOLID"] | CELL_FLAGS["VOID"]


# --- flags ---------------------------------------------------------------

def is_fluid(flags) -> Column:
    return K.col(flags).bitwiseAND(F.lit(FLUID_MASK)) == 0


def is_liquid(flags) -> Column:
    return K.col(flags).bitwiseAND(F.lit(FLUID_MASK | CELL_FLAGS["AIR"])) == 0


def is_air(flags) -> Column:
    return K.col(flags).bitwiseAND(F.lit(CELL_FLAGS["AIR"])) != 0


# --- joins ---------------------------------------------------------------

def zip_channels(a: DataFrame, b: DataFrame, keys=XYZ, how: str = "inner") -> DataFrame:
    """Pair two channels cell by cell."""
    return a.join(b, list(keys), how)


def select_blocks(cells: DataFrame, block_list: DataFrame, key: str = "bid") -> DataFrame:
    """Only the cells of listed blocks."""
    return cells.join(block_list.select(key), key, "left_semi")


def lookup(probe: DataFrame, cells: DataFrame, value: str, empty: float, keys=XYZ) -> DataFrame:
    """Value at each probe; where no cell is stored, the empty value."""
    return probe.join(cells.select(*keys, value), list(keys), "left").withColumn(value, F.coalesce(value, F.lit(empty)))


def upsert(cells: DataFrame, new: DataFrame, value: str, keys=XYZ) -> DataFrame:
    """Write cells: new values win, others stay."""
    fresh = new.select(*keys, F.col(value).alias("__new"))
    return cells.join(fresh, list(keys), "full_outer").withColumn(value, F.coalesce("__new", value)).drop("__new")


def densify(cells: DataFrame, grid: Grid, value: str, empty: float) -> DataFrame:
    """All cells of the domain; those not stored take the empty value.

    Runs as an aggregation of the stored cells and a generated range: one
    shuffle on the cell index, no outer join.
    """
    plane = grid.sx * grid.sy
    stored = cells.select(K.grid_index(*XYZ, grid).alias("idx"), F.col(value).alias("v"))
    full = cells.sparkSession.range(plane * grid.sz).select(F.col("id").alias("idx"), F.lit(None).cast("double").alias("v"))
    out = stored.unionByName(full).groupBy("idx").agg(F.coalesce(F.max("v"), F.lit(empty)).alias(value))
    i = F.col("idx")
    z = F.floor(i / plane).cast("bigint")
    rest = i - z * plane
    y = F.floor(rest / grid.sx).cast("bigint")
    return out.select((rest - y * grid.sx).alias("x"), y.alias("y"), z.alias("z"), value)


def sparsify(cells: DataFrame, grid: Grid, value: str, threshold: float) -> DataFrame:
    """Drop whole blocks whose largest magnitude stays below the threshold."""
    keyed = cells.withColumn("bid", K.cell_block_id(*XYZ, grid))
    kept = keyed.groupBy("bid").agg(F.max(F.abs(value)).alias("m")).where(F.col("m") >= threshold).select("bid")
    return keyed.join(kept, "bid", "left_semi")


# --- element-wise ---------------------------------------------------------

def set_where(value, a: float, mask: Column) -> Column:
    return F.when(mask, F.lit(a)).otherwise(K.col(value))


def axpby(a: float, x, b: float, y) -> Column:
    return K.col(x) * a + K.col(y) * b


def sqrt_clipped(x) -> Column:
    return F.sqrt(F.greatest(K.col(x), F.lit(0.0)))


def by_cell_volume(x, level, dx0: float = 1.0) -> Column:
    h = F.pow(F.lit(2.0), K.col(level)) * dx0
    return K.col(x) / (h * h * h)


def update_pair(x, p, q, a: float, b: float) -> dict[str, Column]:
    """x + a p and q + b p, both from the old p."""
    return {"x": K.col(x) + K.col(p) * a, "p": K.col(q) + K.col(p) * b}


def normalise(cells: DataFrame, value: str) -> DataFrame:
    """Stretch to [0,1]; a flat channel becomes 0."""
    span = cells.agg(F.min(value).alias("__lo"), F.max(value).alias("__hi"))
    width = F.col("__hi") - F.col("__lo")
    # one row by construction
    return cells.join(F.broadcast(span)).withColumn(
        value, F.when(width > 1e-12, (F.col(value) - F.col("__lo")) / width).otherwise(0.0)
    ).drop("__lo", "__hi")


def apply_function(cells: DataFrame, value: str, fn) -> DataFrame:
    """``fn(value, x, y, z)`` over every stored cell."""
    return cells.withColumn(value, fn(F.col(value), *[F.col(c) for c in XYZ]))


def move_component(vec, i: str) -> Column:
    return K.col(vec).getField(i)


# --- reductions -----------------------------------------------------------

def moments(v: Column) -> dict[str, Column]:
    """Count, mean, population deviation, extremes, span and square sum of one column."""
    return {
        "n": F.count(v), "avg": F.avg(v), "var": F.stddev_pop(v), "min": F.min(v), "max": F.max(v),
        "span": F.max(v) - F.min(v), "sum_sqr": F.sum(v * v),
    }


def channel_stat(cells: DataFrame, values: list[str], by: list[str] = (), mask: Column | None = None,
                 zero_eps: float | None = None) -> DataFrame:
    """Statistics over cells; several columns count as one pool of samples."""
    df = cells if mask is None else cells.where(mask)
    if len(values) == 1:
        df = df.withColumn("__v", F.col(values[0]))
    else:
        df = df.withColumn("__v", F.explode(F.array(*values)))
    if zero_eps is not None:
        df = df.where(F.abs("__v") > zero_eps)
    return df.groupBy(*by).agg(*[c.alias(n) for n, c in moments(F.col("__v")).items()])


def merge_moments(parts: DataFrame, by: list[str]) -> DataFrame:
    """Combine partial accumulators (n, sum, sum_sqr, min, max) into final statistics."""
    m = parts.groupBy(*by).agg(*[F.sum(c).alias(c) for c in ("n", "sum", "sum_sqr")], F.min("min").alias("min"), F.max("max").alias("max"))
    avg = F.col("sum") / F.col("n")
    return m.select(*by, "n", avg.alias("avg"), F.sqrt(F.greatest(F.col("sum_sqr") / F.col("n") - avg * avg, F.lit(0.0))).alias("var"), "min", "max")


def max_abs(cells: DataFrame, value: str, scale: float = 1.0, by: list[str] = ()) -> DataFrame:
    """Largest magnitude and where it sits; the least position wins ties."""
    v = F.abs(F.col(value) * scale)
    place = F.struct(v.alias("v"), *[(-F.col(c)).alias(c) for c in ("z", "y", "x")])
    top = cells.groupBy(*by).agg(F.max(place).alias("m"))
    return top.select(*by, F.col("m.v").alias("max_abs"), *[(-F.col(f"m.{c}")).alias(c) for c in XYZ])


def dot(a, b) -> Column:
    return F.sum(K.col(a).cast("double") * K.col(b).cast("double"))


def compare(pairs: DataFrame, a: list[str], b: list[str], err: float) -> DataFrame:
    """Largest difference (summed over components), its place, and how many exceed ``err``."""
    diff = reduce(lambda p, q: p + q, [F.abs(F.col(i) - F.col(j)) for i, j in zip(a, b)])
    df = pairs.withColumn("__d", diff)
    place = F.struct(F.col("__d").alias("d"), *[(-F.col(c)).alias(c) for c in ("z", "y", "x")])
    out = df.agg(F.max(place).alias("m"), F.count_if(F.col("__d") > err).alias("n_over"), F.count("*").alias("n"))
    return out.select(F.col("m.d").alias("max_diff"), *[(-F.col(f"m.{c}")).alias(c) for c in XYZ], "n_over", "n")


def check_finite(cells: DataFrame, value: str, flags: str | None = None) -> DataFrame:
    """Counts of non-finite cells and of non-zero cells outside the fluid."""
    v = F.col(value)
    bad = v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    aggs = [F.count("*").alias("n"), F.count_if(bad).alias("n_bad")]
    if flags:
        outside = ~is_fluid(flags)
        held = outside | (F.col(flags).bitwiseAND(F.lit(CELL_FLAGS["FIXED"])) != 0)
        aggs += [F.count_if(outside & (v != 0)).alias("n_solid_nonzero"), F.count_if(held & (v != 0)).alias("n_held_nonzero")]
    return cells.agg(*aggs)


def sum_slices(cells: DataFrame, value: str) -> DataFrame:
    """Sums along each axis in one pass: rows are tagged by the axis summed away."""
    out = cells.groupingSets(
        [[F.col("y"), F.col("z")], [F.col("x"), F.col("z")], [F.col("x"), F.col("y")]], F.col("x"), F.col("y"), F.col("z")
    ).agg(F.sum(value).alias("total"), F.grouping("x").alias("gx"), F.grouping("y").alias("gy"))
    axis = F.when(F.col("gx") == 1, "x").when(F.col("gy") == 1, "y").otherwise("z")
    return out.select(axis.alias("axis"), F.when(axis == "x", F.col("y")).otherwise(F.col("x")).alias("u"),
                      F.when(axis == "z", F.col("y")).otherwise(F.col("z")).alias("w"), "total")


# --- reads across the domain border ------------------------------------------

def boundary_lookup(probe: DataFrame, at: tuple[str, str, str], cells: DataFrame, value: str, grid: Grid, kind: str,
                    empty: float, component: int | None = None) -> DataFrame:
    """Read cells at positions that may lie outside the domain.

    DIRICHLET reads the empty value there, NEUMANN the nearest inside cell, PERIODIC
    the wrapped one, FREESLIP the nearest one with the component across the face
    (``component`` says which one this channel is) set to zero.
    """
    clip = K.clip_report(*at, grid)
    if kind == "PERIODIC":
        where = [F.pmod(K.big(c), F.lit(s)) for c, s in zip(at, grid.dims)]
    else:
        where = [clip[f"c{a}"] for a in XYZ]
    outside = clip["clip_dir"] >= 0
    p = probe.withColumns({f"__{a}": w for a, w in zip(XYZ, where)} | {"__out": outside, "__dir": clip["clip_dir"]})
    found = p.join(cells.select(*[F.col(a).alias(f"__{a}") for a in XYZ], value), ["__x", "__y", "__z"], "left")
    v = F.coalesce(value, F.lit(empty))
    if kind == "DIRICHLET":
        v = F.when(F.col("__out"), F.lit(empty)).otherwise(v)
    if kind == "FREESLIP" and component is not None:
        v = F.when(F.col("__out") & (F.col("__dir") == component), 0.0).otherwise(v)
    return found.withColumn(value, v).drop("__x", "__y", "__z", "__out", "__dir")
