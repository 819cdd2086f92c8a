"""Variable-coefficient Laplacian: application, residual, damped relaxation."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.functions import keys as K
from lattica.operators import halo as H
from lattica.schema import Grid
from lattica.session import cut_lineage

FACES = [(-1, 0, 0), (1, 0, 0), (0, -1, 0), (0, 1, 0), (0, 0, -1), (0, 0, 1)]


def face_weights(cells: DataFrame, x: str, areas: tuple[str, str, str], keep: tuple[str, ...] = ()) -> DataFrame:
    """Six face weights and neighbour values per cell.

    ``areas`` hold the open share of a cell's lower faces; the upper ones belong to
    the next cell, and are 1 where there is none.  ``keep`` columns stay with their cell.
    """
    nb = H.neighbour_values(cells, FACES, x, *areas, keep=keep)
    w, v = [], []
    for k, a in enumerate(areas):
        w += [F.col(a), F.coalesce(F.col(f"{a}_{2 * k + 1}"), F.lit(1.0))]
    for i in range(6):
        v.append(F.coalesce(F.col(f"{x}_{i}"), F.lit(0.0)))
    return nb.select("x", "y", "z", x, *keep, *[c.alias(f"w{i}") for i, c in enumerate(w)], *[c.alias(f"x{i}") for i, c in enumerate(v)])


def _flow(h: float) -> Column:
    return reduce(lambda a, b: a + b, [F.col(f"w{i}") * F.col(f"x{i}") for i in range(6)]) * h


def inverse_diagonal() -> Column:
    total = reduce(lambda a, b: a + b, [F.col(f"w{i}") for i in range(6)])
    return F.when(total > 0, F.lit(1.0) / total).otherwise(1.0)


def apply_laplacian(faces: DataFrame, x: str, h: float, mask: Column) -> Column:
    """h x / D - h (weighted neighbours); 0 outside the mask."""
    y = F.col(x) * h / inverse_diagonal() - _flow(h)
    return F.when(mask, y).otherwise(0.0)


def jacobi(x: str, b: Column, h: float, omega: float, mask: Column) -> Column:
    """One damped update from the previous values."""
    y = (b + _flow(h)) * inverse_diagonal() * (omega / h) + F.col(x) * (1.0 - omega)
    return F.when(mask, y).otherwise(0.0)


# --- iterated on packed blocks ---------------------------------------------------------

SYSTEM = ("rhs", "inv", "fluid", "w0", "w1", "w2", "w3", "w4", "w5")


def pack_system(faces: DataFrame, grid: Grid, dtype: str = "float64") -> DataFrame:
    """The constant part of the system, one row per block.

    ``faces`` need x, y, z, rhs, fluid and w0..w5; cells not stored are outside.
    """
    n = grid.bsx
    cols = faces.withColumns({"inv": inverse_diagonal(), "fluid": F.col("fluid").cast("double")})
    keyed = cols.select(K.cell_block_id("x", "y", "z", grid).alias("bid"), K.voxel_id("x", "y", "z", n).cast("int").alias("vid"),
                        *[F.col(c).cast("double").alias(c) for c in SYSTEM])

    def run(rows: pa.Table) -> pa.Table:
        bid, at = np.unique(rows["bid"].to_numpy(), return_inverse=True)
        out = np.zeros((len(bid), len(SYSTEM), n**3), dtype)
        vid = rows["vid"].to_numpy()
        for k, c in enumerate(SYSTEM):
            out[at, k, vid] = rows[c].to_numpy()
        return pa.table([pa.array(bid), H.bytes_column(out)], names=["bid", "system"])

    return H.in_runs(keyed).applyInArrow(run, "bid bigint, system binary")


def relax(x: DataFrame, system: DataFrame, grid: Grid, *, h: float = 1.0, omega: float = 0.8, iterations: int = 1,
          inner: int = 1, reverse: bool = False, dtype: str = "float64", block_filter: DataFrame | None = None) -> DataFrame:
    """Red/black block relaxation; each block runs ``inner`` sweeps against a fixed border.

    Blocks outside ``block_filter`` keep their values.
    """
    n = grid.bsx

    def sweep(pieces: pa.Table, systems: pa.Table) -> pa.Table:
        held = systems["bid"].to_numpy()
        bid, *parts = H.receivers(pieces.filter(pa.array(np.isin(pieces["bid"].to_numpy(), held))))
        if not len(bid):
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.binary())], names=["bid", "data"])
        halo = H.assemble(bid, *parts, grid, 1, dtype, "empty", 0.0)
        order = np.argsort(held)
        s = H.stack_column(systems["system"].take(pa.array(order[np.searchsorted(held[order], bid)])), (len(SYSTEM), n, n, n), dtype)
        rhs, inv, fluid, w = s[:, 0], s[:, 1], s[:, 2], s[:, 3:]
        for _ in range(inner):
            old = halo[:, 1:-1, 1:-1, 1:-1]
            flow = h * sum(w[:, i] * H.shifted(halo, 1, *o) for i, o in enumerate(FACES))
            new = ((rhs + flow) * inv * (omega / h) + (1.0 - omega) * old) * (fluid > 0)
            halo[:, 1:-1, 1:-1, 1:-1] = new
        return pa.table([pa.array(bid), H.bytes_column(halo[:, 1:-1, 1:-1, 1:-1].astype(dtype))], names=["bid", "data"])

    bx, by, bz = K.block_coords("bid", grid)
    parity = (bx + by + bz).bitwiseAND(F.lit(1))
    for _ in range(iterations):
        for turn in (0, 1):
            # odd blocks first, or even ones in reverse order
            active = parity == (1 - turn if not reverse else turn)
            if block_filter is not None:
                x = x.join(block_filter.select("bid", F.lit(True).alias("sel")), "bid", "left")
                active = active & F.coalesce("sel", F.lit(False))
            todo = x.where(active).select("bid")
            pieces = H.slabs(x.select("bid", "data"), grid, 1, dtype)
            pieces = pieces.where(parity == (1 - turn if not reverse else turn)) if block_filter is None else pieces.join(todo, "bid", "left_semi")
            fresh = H.in_runs(pieces).cogroup(H.in_runs(system)).applyInArrow(sweep, H.PACKED)
            x = cut_lineage(fresh.unionByName(x.where(~active).select("bid", "data")))
    return x


# --- interface helpers ---------------------------------------------------------------

def line_fraction(a: Column, b: Column) -> Column:
    """Share of a segment that lies inside, from signed distances at its ends."""
    return (F.when((a < 0) & (b < 0), 1.0).when((a < 0) & (b >= 0), a / (a - b))
            .when((a >= 0) & (b < 0), b / (b - a)).otherwise(0.0))


def area_fraction(bl: Column, br: Column, tl: Column, tr: Column) -> Column:
    """Share of a square that lies inside, from signed distances at its corners.

    Corners are walked round the square; the area is the polygon left by the edge
    crossings, with the mean value settling the two-diagonal case.
    """
    ring = [bl, br, tr, tl]
    inside = sum(F.when(c < 0, 1).otherwise(0) for c in ring)

    def corner(i: int, out: bool) -> Column:
        """Triangle cut off at corner i: the outside part or the inside part."""
        here, nxt, prv = ring[i], ring[(i + 1) % 4], ring[(i - 1) % 4]
        s, t = line_fraction(here, prv), line_fraction(here, nxt)
        return (F.lit(1.0) - s) * (F.lit(1.0) - t) / 2 if out else s * t / 2

    def band(i: int) -> Column:
        """Two neighbouring inside corners i and i+1."""
        return (line_fraction(ring[i], ring[(i - 1) % 4]) + line_fraction(ring[(i + 1) % 4], ring[(i + 2) % 4])) / 2

    neg = [c < 0 for c in ring]
    result = F.when(inside == 4, 1.0).when(inside == 0, 0.0)
    for i in range(4):
        result = result.when((inside == 3) & ~neg[i], F.lit(1.0) - corner(i, True))
        result = result.when((inside == 1) & neg[i], corner(i, False))
        result = result.when((inside == 2) & neg[i] & neg[(i + 1) % 4], band(i))
    middle = (bl + br + tl + tr) / 4
    for i in (0, 1):
        both = corner(i, False) + corner((i + 2) % 4, False)
        gaps = F.lit(1.0) - corner((i + 1) % 4, True) - corner((i + 3) % 4, True)
        result = result.when((inside == 2) & neg[i] & neg[(i + 2) % 4], F.when(middle < 0, gaps).otherwise(both))
    return result


def ghost_pressure(p: Column, phi: Column, phi2: Column, threshold: float, min_theta: float, coarsest: bool = False) -> dict[str, Column]:
    """Interface position between a fluid cell and an open neighbour, and the mirrored pressure."""
    a, b = F.lit(threshold) - phi, F.lit(threshold) - phi2
    gap = a - b
    theta = (F.when((a < 0) & (b > 0), F.when(F.abs(gap) < 1e-5, 0.5).otherwise(a / F.when(F.abs(gap) >= 1e-5, gap)))
             .when((a < 0) & (b < 0) & (b > a + 1e-5), 1.0).otherwise(0.5))
    if coarsest:
        theta = F.lit(0.5)
    theta = F.greatest(theta, F.lit(min_theta))
    return {"theta": theta, "pressure": -p * (F.lit(1.0) - theta) / theta}
