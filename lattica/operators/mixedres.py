"""Neighbours and sampling across resolution changes."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types

from lattica.functions import keys as K
from lattica.operators import halo as H, interp as I, topology as T
from lattica.operators.solver import FACES
from lattica.schema import BLOCK_FLAGS, Grid

SAME, FROM_FINE, FROM_COARSE = 0, 1, 2
"""How a face neighbour relates: equal level, four finer cells, one coarser cell."""
REGION = 32  # finest cells along a region that is looked through at once


def face_neighbours(cells: DataFrame, values: list[str], grid: Grid) -> DataFrame:
    """Each cell with its six face neighbours on whatever level they live.

    ``cells`` hold (level, x, y, z, values) in level units; neighbouring levels differ
    by at most one.  A cell goes to the regions of REGION finest cells that it or a cell
    behind its faces lies in; there it reaches the same-level, coarser and finer cells behind
    its faces, levels being told apart by who exists.  Columns per face i: ``kind_i`` and
    ``<value>_i`` (the mean where the neighbour is finer).
    """
    axes = ("x", "y", "z")
    types_ = {f.name: f.dataType for f in cells.schema}
    sent = cells.select(F.col("level").cast("int").alias("level"), *[K.big(a).alias(a) for a in axes], *[F.col(v).cast("double").alias(v) for v in values])
    for a in axes:
        # no cell behind a face begins more than two cells away
        lo, hi = (F.floor((F.col(a) + d) * F.pow(F.lit(2.0), F.col("level")) / REGION).cast("bigint") for d in (-2, 2))
        sent = sent.where(F.col(a).isNotNull()).withColumn(f"__{a}", F.explode(F.sequence(lo, hi)))
    n_levels, bsx, faces = grid.n_levels, grid.bsx, list(FACES)
    schema = types.StructType([types.StructField("level", types.IntegerType()), *[types.StructField(a, types.LongType()) for a in axes],
                               *[types.StructField(v, types.DoubleType()) for v in values],
                               *[f for i in range(6) for f in (types.StructField(f"kind_{i}", types.IntegerType()),
                                                               *[types.StructField(f"{v}_{i}", types.DoubleType()) for v in values])]])

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        base = [k.as_py() * REGION for k in key]
        level, at = rows["level"].to_numpy(), [rows[a].to_numpy() for a in axes]
        value = {v: rows[v].to_numpy() for v in values}
        known = {v: rows[v].is_valid().to_numpy() for v in values}

        def place(lv: np.ndarray, c: list[np.ndarray]) -> np.ndarray:
            """Where a cell that begins in this region stands in the index, else -1."""
            rel, ok = [], (lv >= 0) & (lv < n_levels)
            up = np.clip(lv, 0, n_levels)
            for p, b in zip(c, base):
                r = p - (b >> up)
                ok &= (r >= 0) & (r < REGION >> up)
                rel.append(r)
            return np.where(ok, ((lv * REGION + rel[2]) * REGION + rel[1]) * REGION + rel[0], -1)

        here = place(level, at)
        own, first, slot = np.unique(here[here >= 0], return_index=True, return_inverse=True)
        first, mine = np.flatnonzero(here >= 0)[first], here >= 0
        index = np.full(n_levels * REGION**3 + 1, -1, np.int64)  # the last place stands for none
        index[own] = np.arange(len(own))
        n = len(own)
        kind = np.full((6, n), -1, np.int32)
        total, count = ({v: np.zeros((6, n)) for v in values} for _ in range(2))

        def tell(some: np.ndarray, face: int, k: int, lv: np.ndarray, c: list[np.ndarray]) -> None:
            to = index[place(lv, c)]
            some, to = some[to >= 0], to[to >= 0]
            np.maximum.at(kind[face], to, k)
            for v in values:
                there = known[v][some]
                total[v][face] += np.bincount(to[there], value[v][some[there]], n)
                count[v][face] += np.bincount(to[there], minlength=n)

        everyone = np.arange(len(level))
        for i, o in enumerate(faces if n else ()):
            back = i ^ 1  # the receiver sees the sender through the opposite face
            axis = [abs(d) for d in o].index(1)
            tell(everyone, back, SAME, level, [c + d for c, d in zip(at, o)])
            edge = bsx >> level
            some = np.flatnonzero((edge > 0) & (np.fmod(at[axis], np.maximum(edge, 1)) == (edge - 1 if sum(o) > 0 else 0)))
            lv, c = level[some], [p[some] for p in at]
            tell(some, back, FROM_FINE, lv + 1, [(p + d) // 2 for p, d in zip(c, o)])
            for p in (0, 1):
                for q in (0, 1):
                    sub = iter((p, q))
                    tell(some, back, FROM_COARSE, lv - 1, [(w * 2 + (2 if sum(o) > 0 else -1)) if k == axis else w * 2 + next(sub) for k, w in enumerate(c)])
        out = [pa.array(level[first], pa.int32()), *[pa.array(c[first]) for c in at]]
        for v in values:
            best, some = np.full(n, np.nan), known[v][mine]
            np.fmax.at(best, slot[some], value[v][mine][some])
            out.append(pa.array(best, mask=np.bincount(slot[some], minlength=n) == 0))
        for i in range(6):
            out.append(pa.array(kind[i], mask=kind[i] < 0))
            out += [pa.array(total[v][i] / np.maximum(count[v][i], 1), mask=count[v][i] == 0) for v in values]
        return pa.table(out, names=[f.name for f in schema])

    got = sent.groupBy(*[f"__{a}" for a in axes]).applyInArrow(run, schema)
    return got.withColumns({v: F.col(v).cast(types_[v]) for v in values})


def scalar_derivatives(faces: DataFrame, value: str, fluid: str | None = None, h0: float = 1.0) -> dict[str, Column]:
    """Central differences; a missing or non-fluid neighbour mirrors the opposite one."""
    def side(i: int) -> Column:
        ok = F.col(f"{value}_{i}").isNotNull()
        if fluid:
            ok = ok & (F.coalesce(F.col(f"{fluid}_{i}"), F.lit(0.0)) > 0)
        mirror = F.col(value) * 2 - F.col(f"{value}_{i ^ 1}")
        return F.when(ok, F.col(f"{value}_{i}")).otherwise(mirror)
    scale = F.lit(0.5 / h0) / F.pow(F.lit(2.0), F.col("level"))
    return {f"d{a}": (side(2 * k + 1) - side(2 * k)) * scale for k, a in enumerate("xyz")}


def cell_at(points: DataFrame, levels: DataFrame, grid: Grid) -> DataFrame:
    """The cell that holds each point, at the level of its own block."""
    cell = [F.floor(p).cast("bigint") for p in ("px", "py", "pz")]
    pts = points.withColumn("bid", K.cell_block_id(*cell, grid)).join(levels.select("bid", "level"), "bid")
    return pts.withColumns({c: K.shr(e, "level") for c, e in zip("xyz", cell)})


def sample_levels(points: DataFrame, cells: DataFrame, ghosts: DataFrame, levels: DataFrame, grid: Grid, value: str, *,
                  kind: str = "linear", d_max: float = 6.0, empty: float = 0.0, dtype: str = "float64",
                  share: int = I.SHARE, edge: int = 16) -> DataFrame:
    """Sample a channel stored at several levels, blending where the level changes.

    ``cells`` and ``ghosts`` hold (level, x, y, z, value); ``levels`` hold (bid, level,
    flags).  A point reads its block's level; inside a fine block beside a coarser one
    the coarser level is mixed in by distance.  All levels of one work block of
    ``edge`` finest cells, and the distance field, meet the points in one grouping.
    """
    taps, h = (2 if kind in ("linear", "nearest") else 4), 2
    work = Grid.covering(*grid.dims, bsx=edge, n_levels=grid.n_levels)
    names = I.sampler(kind, grid)[1]
    cell = [F.floor(p).cast("bigint") for p in ("px", "py", "pz")]
    border = F.col("flags").bitwiseAND(F.lit(BLOCK_FLAGS["FINE_COARSE"])) != 0
    owner = points.withColumn("own", K.cell_block_id(*cell, grid)).join(
        levels.select(F.col("bid").alias("own"), F.col("level").alias("lv"), border.alias("mix")), "own").drop("own")
    pts, load = I.split_crowded(owner.withColumn("bid", K.cell_block_id(*cell, work)), share)

    stored = cells.select("level", "x", "y", "z", F.col(value).alias("v")).unionByName(
        ghosts.select("level", "x", "y", "z", F.col(value).alias("v")))
    dist = T.transition_distance(levels.select("bid", "level"), grid, d_max)
    fields = []
    for lv in range(grid.n_levels):
        g = work.coarsened(lv)
        p = H.pack(stored.where(F.col("level") == lv), g, "v", empty, dtype)
        fields.append(I.halo_blocks(p, g, h, dtype, "clamp", empty).withColumn("tag", F.lit(lv)))
        if lv < grid.n_levels - 1:
            e = grid.bsx >> lv
            vox, blk = K.voxel_coords("vid", e), K.block_coords("bid", grid)
            near = dist.where(F.col("level") == lv).select("bid", "vid", (F.col("dist") / 1024.0).alias("v"))
            # beyond the border of the level the distance is 0, elsewhere it is the largest
            beyond = levels.where((F.col("level") == lv + 1) & (F.col("flags").bitwiseAND(F.lit(BLOCK_FLAGS["COARSE_FINE"])) != 0)).select(
                "bid", F.explode(F.sequence(F.lit(0), F.lit(e**3 - 1)).cast("array<bigint>")).alias("vid"), F.lit(0.0).alias("v"))
            d = near.unionByName(beyond).select(*[(b * e + v).alias(a) for a, b, v in zip("xyz", blk, vox)], "v")
            fields.append(I.halo_blocks(H.pack(d, g, "v", d_max, dtype), g, h, dtype, "clamp", d_max).withColumn("tag", F.lit(100 + lv)))
    ready = I.spread_blocks(reduce(DataFrame.unionByName, fields), load)
    out_schema = types.StructType([*points.schema.fields, types.StructField("copies", types.LongType()), *[types.StructField(n, types.DoubleType()) for n in names]])
    top = grid.n_levels - 1
    grids = [work.coarsened(lv) for lv in range(grid.n_levels)]
    fns = [I.sampler(kind, g)[2] for g in grids]
    line = I.sampler("linear", work)[2]
    r3 = 3.0**0.5
    lo, hi = (taps / 2 - 0.5) * r3 * 1.01, 0.99 * (d_max + 2) / r3

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty:
            return pd.DataFrame({f.name: [] for f in out_schema})
        data = dict(zip(right["tag"], right["halo"]))
        at0 = H.block_xyz(left["bid"].to_numpy()[:1], work)

        def halo(tag: int, lv: int, blank: float) -> np.ndarray:
            m = grids[lv].bsx + 2 * h
            return np.frombuffer(data[tag], dtype).reshape(m, m, m).astype(np.float64) if tag in data else np.full((m, m, m), blank)

        level, mix = left["lv"].to_numpy(), left["mix"].to_numpy(bool)
        pos = [np.clip(left[p].to_numpy(np.float64), 0.0, s) for p, s in zip(("px", "py", "pz"), work.dims)]
        out = {n: np.zeros(len(left)) for n in names}

        def read(lv: int, rows: np.ndarray) -> dict[str, np.ndarray]:
            base = [int(c[0]) * grids[lv].bsx for c in at0]
            got = fns[lv](halo(lv, lv, empty), [p[rows] / (1 << lv) for p in pos], base, h)
            return {n: got[n] * (0.5**lv if n.startswith("g") else 1.0) for n in names}  # slopes per finest cell

        for lv in range(top + 1):
            rows = np.flatnonzero(level == lv)
            if not len(rows):
                continue
            fine = read(lv, rows)
            for n in names:
                out[n][rows] = fine[n]
            blend = rows[mix[rows]]
            if lv == top or not len(blend):
                continue
            base = [int(c[0]) * grids[lv].bsx for c in at0]
            d = line(halo(100 + lv, lv, d_max), [p[blend] / (1 << lv) for p in pos], base, h)["value"]
            alpha = np.where(d < lo, 0.0, np.where(d >= hi, 1.0, (d - lo) / (hi - lo)))
            coarse = read(lv + 1, blend)
            for n in names:
                out[n][blend] = out[n][blend] * alpha + coarse[n] * (1.0 - alpha)
        return left.drop(columns=["bid", "share", "lv", "mix"]).assign(**out)

    got = pts.groupBy("bid", "share").cogroup(ready.groupBy("bid", "share")).applyInPandas(run, out_schema)
    return I.restore_copies(got)
