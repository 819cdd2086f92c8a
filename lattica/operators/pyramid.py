"""Resampling between resolutions as weighted scatter.

Every source cell knows which target cells read it and with what weight, border
clamping included; it travels to the blocks they lie in, and a block is summed at once.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.functions import keys as K
from lattica.schema import Grid

XYZ = ("x", "y", "z")

MEAN2 = {0: 0.5, 1: 0.5}
SMOOTH4 = {-1: 1 / 8, 0: 3 / 8, 1: 3 / 8, 2: 1 / 8}
STAGGERED4 = {-1: 0.25, 0: 0.5, 1: 0.25}


def gauss5(a: float = 0.4) -> dict[int, float]:
    """Five taps from one shape parameter; they sum to 1."""
    side = 0.25 - a / 2.0
    return {-2: side, -1: 0.25, 0: a, 1: 0.25, 2: side}


EDGE = 16  # target cells along a block that is computed at once


def down_taps(c: np.ndarray, n_src: int, n_dst: int, w: dict[int, float]) -> tuple[np.ndarray, np.ndarray]:
    """Targets t that read source c at 2t + d, reads beyond the border clamped (|d| <= 2): (sources, taps) of t and weight."""
    t = ((c - max(w)) // 2)[:, None] + np.arange((max(w) - min(w) + 1) // 2 + 1)
    c = c[:, None]
    weight = sum(np.where(c - t * 2 == d, v, 0.0) for d, v in w.items())
    low = sum(v for d, v in w.items() if d < 0)
    last = n_src - 1 - 2 * (n_dst - 1)  # source read by the last target at the border
    high = sum(v for d, v in w.items() if d > last)
    weight = weight + np.where((c == 0) & (t == 0), low, 0.0) + np.where((c == n_src - 1) & (t == n_dst - 1), high, 0.0)
    return t, np.where((t >= 0) & (t < n_dst), weight, 0.0)


def up_taps(c: np.ndarray, n_src: int, n_dst: int, w: dict[int, float]) -> tuple[np.ndarray, np.ndarray]:
    """Targets x that read coarse source c at (x + d)/2 for even x + d, clamped (|d| <= 2)."""
    k = np.arange(-max(w), -min(w) + 1)
    x = c[:, None] * 2 + k
    beyond = lambda side: np.array([2.0 * sum(v for d, v in w.items() if (j + d) % 2 == 0 and (j + d) * side > 0) for j in k])
    weight = np.array([2.0 * w.get(-int(j), 0.0) for j in k]) + np.where(c[:, None] == 0, beyond(-1), 0.0) + np.where(c[:, None] == n_src - 1, beyond(1), 0.0)
    return x, np.where((x >= 0) & (x < n_dst), weight, 0.0)


def _same(c: np.ndarray, *_) -> tuple[np.ndarray, np.ndarray]:
    return c[:, None], np.ones((len(c), 1))


def _reach(kind: str, c: Column, w: dict[int, float]) -> tuple[Column, Column]:
    """First and last target that a source may touch."""
    if kind == "same":
        return c, c
    if kind == "up":
        return c * 2 - max(w), c * 2 - min(w)
    first = F.floor((c - max(w)) / 2)
    return first, first + (max(w) - min(w) + 1) // 2


@dataclass(frozen=True)
class Part:
    """Cells that are summed into a level: ``kind`` is down, up or same; ``w`` holds the weights along each axis."""

    cells: DataFrame
    kind: str
    values: list[str]
    w: dict[str, dict[int, float]]
    src: tuple[int, int, int] = (0, 0, 0)
    dst: tuple[int, int, int] = (0, 0, 0)
    sign: float = 1.0


def _sum(parts: list[Part], values: list[str]) -> DataFrame:
    """Weighted sum of all parts at their targets.

    A cell travels to the blocks of ``EDGE`` targets that it touches, mostly one, and a block is summed at once:
    copies of a cell for its single targets never leave the task.  Null adds nothing; a sum of nulls is null,
    and so a part without a value adds 0 to it.  Only parts of kind same keep cells without a whole position.
    """
    sent = []
    for i, p in enumerate(parts):
        df = p.cells.select(*[F.col(a).cast("bigint").alias(a) for a in XYZ], *[
            (F.col(v).cast("double") if v in p.values else F.lit(0.0)).alias(v) for v in values], F.lit(i).alias("part"))
        for a, n in zip(XYZ, p.dst):
            lo, hi = _reach(p.kind, F.col(a), p.w.get(a, {}))
            if p.kind == "same":
                df = df.withColumn(f"__{a}", F.floor(lo / EDGE).cast("bigint"))
            else:
                lo, hi = F.greatest(lo, F.lit(0)), F.least(hi, F.lit(n - 1))
                blocks = F.sequence(F.floor(lo / EDGE).cast("bigint"), F.floor(hi / EDGE).cast("bigint"))
                df = df.where(F.col(a).isNotNull()).withColumn(f"__{a}", F.explode(F.when(lo <= hi, blocks)))
        sent.append(df)
    plans = [(p.kind, p.w, p.src, p.dst, p.sign) for p in parts]
    taps = {"down": down_taps, "up": up_taps, "same": _same}

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        block = [k.as_py() for k in key]
        if None in block:
            lost = rows.group_by(list(XYZ)).aggregate([(v, "sum") for v in values])
            return lost.select([*XYZ, *[f"{v}_sum" for v in values]]).rename_columns([*XYZ, *values])
        n = EDGE**3
        hits, known, total = np.zeros(n), {v: np.zeros(n) for v in values}, {v: np.zeros(n) for v in values}
        of = rows["part"].to_numpy()
        for i, (kind, w, src, dst, sign) in enumerate(plans):
            mine = np.flatnonzero(of == i)
            for at in range(0, len(mine), 4096):
                some = rows.take(pa.array(mine[at:at + 4096]))
                (tx, wx), (ty, wy), (tz, wz) = (taps[kind](some[a].to_numpy(), n0, n1, w.get(a)) for a, n0, n1 in zip(XYZ, src, dst))
                tx, ty, tz = (t - b * EDGE for t, b in zip((tx, ty, tz), block))
                wx, wy, wz = (np.where((t >= 0) & (t < EDGE), f, 0.0) for t, f in zip((tx, ty, tz), (wx, wy, wz)))
                weight = wx[:, None, None, :] * wy[:, None, :, None] * wz[:, :, None, None]
                row, k, j, h = np.nonzero(weight)
                weight = weight[row, k, j, h] * sign
                cell = (tz[row, k] * EDGE + ty[row, j]) * EDGE + tx[row, h]
                hits += np.bincount(cell, minlength=n)
                for v in values:
                    c = some[v].combine_chunks()
                    there = c.is_valid().to_numpy(zero_copy_only=False)[row]
                    known[v] += np.bincount(cell[there], minlength=n)
                    total[v] += np.bincount(cell[there], (c.to_numpy(zero_copy_only=False)[row] * weight)[there], n)
        cell = np.flatnonzero(hits)
        xyz = [b * EDGE + c for b, c in zip(block, (cell % EDGE, cell // EDGE % EDGE, cell // EDGE**2))]
        return pa.table([*xyz, *[pa.array(total[v][cell], mask=known[v][cell] == 0) for v in values]], names=[*XYZ, *values])

    schema = ", ".join([*[f"{a} bigint" for a in XYZ], *[f"{v} double" for v in values]])
    return reduce(DataFrame.unionByName, sent).groupBy(*[f"__{a}" for a in XYZ]).applyInArrow(run, schema)


def downsample(cells: DataFrame, dims: tuple[int, int, int], values: list[str], w: dict[int, float] | dict[str, dict[int, float]]) -> DataFrame:
    """One level coarser. Cells not stored read 0."""
    per_axis = w if "x" in w else dict.fromkeys(XYZ, w)
    return _sum([Part(cells, "down", values, per_axis, dims, tuple((n + 1) // 2 for n in dims))], values)


def upsample(cells: DataFrame, coarse: tuple[int, int, int], fine: tuple[int, int, int], values: list[str], w: dict[int, float]) -> DataFrame:
    return _sum([Part(cells, "up", values, dict.fromkeys(XYZ, w), coarse, fine)], values)


def _with_upsampled(fine: DataFrame, coarse: DataFrame, dims: tuple[int, int, int], value: str, w: dict[int, float], sign: float) -> DataFrame:
    half = tuple((n + 1) // 2 for n in dims)
    return _sum([Part(fine, "same", [value], {}), Part(coarse, "up", [value], dict.fromkeys(XYZ, w), half, dims, sign)], [value])


def laplacian(fine: DataFrame, coarse: DataFrame, dims: tuple[int, int, int], value: str, w: dict[int, float]) -> DataFrame:
    """Fine level minus the upsampled coarse one: one sum over both."""
    return _with_upsampled(fine, coarse, dims, value, w, -1.0)


def reconstruct(lap: DataFrame, coarse: DataFrame, dims: tuple[int, int, int], value: str, w: dict[int, float]) -> DataFrame:
    """Inverse of ``laplacian``."""
    return _with_upsampled(lap, coarse, dims, value, w, 1.0)


def build(cells: DataFrame, dims: tuple[int, int, int], value: str, w: dict[int, float], levels: int) -> list[DataFrame]:
    """Level 0 and ``levels`` coarser ones; each is one aggregation of the one before."""
    out, d = [cells.select(*XYZ, value)], dims
    for _ in range(levels):
        out.append(downsample(out[-1], d, [value], w))
        d = tuple((n + 1) // 2 for n in d)
    return out


def stack(levels: list[DataFrame]) -> DataFrame:
    tagged = [df.withColumn("level", F.lit(i)) for i, df in enumerate(levels)]
    return reduce(DataFrame.unionByName, tagged)


def downsample_masked(cells: DataFrame, dims, value: str, w, flags: DataFrame, solid_mask: int) -> DataFrame:
    """Coarser level with flagged target cells set to 0; ``flags`` belongs to the coarse level."""
    low = downsample(cells, dims, [value], w)
    off = F.coalesce(F.col("flags").bitwiseAND(F.lit(solid_mask)) != 0, F.lit(False))
    return low.join(flags.select(*XYZ, "flags"), list(XYZ), "left").select(*XYZ, F.when(off, 0.0).otherwise(F.col(value)).alias(value))


def downsample_faces(cells: DataFrame, values: list[str]) -> DataFrame:
    """Staggered components: the four fine faces lying on the coarse face, averaged."""
    on_face = lambda a, v: F.sum(F.when(F.col(a) % 2 == 0, F.col(v))) / 4.0
    return cells.groupBy(*[F.shiftright(a, 1).alias(a) for a in XYZ]).agg(
        *[F.coalesce(on_face(a, v), F.lit(0.0)).alias(v) for a, v in zip(XYZ, values)])


def downsample_staggered(cells: DataFrame, dims, values: list[str]) -> DataFrame:
    """Staggered components with a four-wide kernel: component k is centred on its own faces."""
    half = tuple((n + 1) // 2 for n in dims)
    parts = [Part(cells, "down", [v], {a: (STAGGERED4 if a == own else SMOOTH4) for a in XYZ}, dims, half) for own, v in zip(XYZ, values)]
    return _sum(parts, values)


# --- levels that coexist ---------------------------------------------------------

def repeat_children(cells: DataFrame, value: str) -> DataFrame:
    """Each coarse cell as its eight fine children of the same value."""
    two = F.array(F.lit(0), F.lit(1))
    df = cells
    for a in XYZ:
        df = df.withColumn(f"__{a}", F.explode(two))
    return df.select(*[(F.col(a) * 2 + F.col(f"__{a}")).alias(a) for a in XYZ], value)


def ghost_cells(cells: DataFrame, levels: DataFrame, grid: Grid, level: int, value: str) -> DataFrame:
    """Coarser copies of the blocks at ``level`` that touch a coarser block.

    ``cells`` hold (level, bid, x, y, z, value) in level units; ``levels`` hold
    (bid, level, flags).  Where a fine neighbour is missing, the coarser cell
    covering it is read instead.
    """
    from lattica.schema import BLOCK_FLAGS

    dims = tuple(n >> level for n in grid.dims)
    has = lambda name: F.col("flags").bitwiseAND(F.lit(BLOCK_FLAGS[name])) != 0
    border = levels.where((F.col("level") == level) & has("FINE_COARSE")).select("bid")
    fine = cells.where(F.col("level") == level)
    # only coarse blocks beside finer ones are looked at
    beside = levels.where((F.col("level") == level + 1) & has("COARSE_FINE")).select("bid")
    coarse = cells.where(F.col("level") == level + 1).join(beside, "bid", "left_semi")
    view = fine.select(*XYZ, value).unionByName(repeat_children(coarse, value))
    low = downsample(view, dims, [value], SMOOTH4)
    g = grid.coarsened(level + 1)
    return low.withColumn("bid", K.cell_block_id(*XYZ, g)).join(border, "bid", "left_semi").select(
        F.lit(level + 1).alias("level"), "bid", *XYZ, value)


def all_ghosts(cells: DataFrame, levels: DataFrame, grid: Grid, value: str) -> DataFrame:
    """Ghost copies for every level change, finest first: later ones read earlier ones."""
    have = cells.select("level", "bid", *XYZ, value)
    out = []
    for lv in range(grid.n_levels - 1):
        g = ghost_cells(have, levels, grid, lv, value)
        out.append(g)
        have = have.unionByName(g)
    return reduce(DataFrame.unionByName, out)
