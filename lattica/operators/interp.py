"""Sampling a block grid at arbitrary points.

Points travel once, to the halo block that holds their whole stencil window.  A
block crowded with points is split into bounded shares and its halo, a few
kilobytes, goes to each share; shares of many blocks are evaluated together, some
points at a time.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattica.functions import keys as K
from lattica.operators import halo as H
from lattica.schema import Grid

SHARE = 16_384  # about the most points of one row
TALL = 32  # blocks of a call
STEP = 1 << 14  # values that are sampled at once
SALTS = 64


# --- one-dimensional rules ---------------------------------------------------------

def bspline2(t: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Quadratic B-spline weights and slopes; t counts down from the upper cell edge."""
    w = [t * t / 2, 0.5 + t * (1 - t), (1 - t) ** 2 / 2]
    return w, [-t, 2 * t - 1, 1 - t]


def bspline3(t: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray], list[np.ndarray]]:
    """Cubic B-spline weights, slopes and curvatures."""
    s = 1 - t
    w = [s**3 / 6, 2 / 3 - t * t * (2 - t) / 2, 2 / 3 - s * s * (2 - s) / 2, t**3 / 6]
    d = [-s * s / 2, 1.5 * t * t - 2 * t, 2 * s - 1.5 * s * s, t * t / 2]
    return w, d, [s, 3 * t - 2, 1 - 3 * t, t]


def line_linear(p, t):
    return p[0] * (1 - t) + p[1] * t


def line_cubic(p, t):
    """Hermite cubic with central differences as slopes."""
    return _hermite(p[1], p[2], (p[2] - p[0]) / 2, (p[3] - p[1]) / 2, t)


def _hermite(p1, p2, m1, m2, t):
    d = p2 - p1
    return p1 + t * (m1 + t * ((3 * d - 2 * m1 - m2) + t * (m1 + m2 - 2 * d)))


def line_mono(p, t):
    """Hermite cubic; both slopes drop to 0 unless they agree in sign."""
    m1, m2 = (p[2] - p[0]) / 2, (p[3] - p[1]) / 2
    agree = m1 * m2 > 0
    return _hermite(p[1], p[2], np.where(agree, m1, 0.0), np.where(agree, m2, 0.0), t)


def line_mono2(p, t):
    """Hermite cubic; slopes are harmonic means of the steps on either side."""
    d0, d1, d2 = p[1] - p[0], p[2] - p[1], p[3] - p[2]
    return _hermite(p[1], p[2], _harmonic(d0, d1), _harmonic(d1, d2), t)


def _harmonic(a, b):
    same = a * b > 1e-12
    return np.where(same, 2 * a * b / np.where(same, a + b, 1.0), 0.0)


def line_weno(p, t):
    """The parabolas through the first and the last three values, each with its linear weight over
    the square of its roughness: squared slope and curvature, integrated over the cell."""
    total, norm = 0.0, 0.0
    for first, linear in ((0, 2 - t), (1, 1 + t)):
        f0, f1, f2 = p[first:first + 3]
        bend, middle = f0 - 2 * f1 + f2, (f2 - f0) / 2
        slope = [middle + bend * (x - first) for x in (0.0, 0.5, 1.0)]
        rough = (slope[0] ** 2 + 4 * slope[1] ** 2 + slope[2] ** 2) / 6 + bend**2  # Simpson's rule is exact here
        x, w = t - first, linear / (1e-6 + rough) ** 2
        total, norm = total + w * (f1 + x * (middle + bend * x / 2)), norm + w
    return total / norm


RULES = {"linear": (2, line_linear), "cubic": (4, line_cubic), "mono": (4, line_mono), "mono2": (4, line_mono2), "weno": (4, line_weno)}


def fade(t: np.ndarray) -> np.ndarray:
    return np.clip(t**3 * (t * (t * 6 - 15) + 10), 0.0, 1.0)


# --- windows -------------------------------------------------------------------------

def windows(halo: np.ndarray, i0: list[np.ndarray], n: int) -> np.ndarray:
    """Gather n^3 windows starting at halo indices (x, y, z): shape (points, z, y, x)."""
    k = np.arange(n)
    x, y, z = (i[:, None] + k[None, :] for i in i0)
    return halo[z[:, :, None, None], y[:, None, :, None], x[:, None, None, :]]


def tensor(win: np.ndarray, rule, u, v, w) -> np.ndarray:
    """Apply a line rule along x, then y, then z."""
    n = win.shape[1]
    over_x = rule([win[..., i] for i in range(n)], u[:, None, None])
    over_y = rule([over_x[..., j] for j in range(n)], v[:, None])
    return rule([over_y[..., k] for k in range(n)], w)


def weighted(win: np.ndarray, wx, wy, wz) -> np.ndarray:
    return np.einsum("pzyx,px,py,pz->p", win, np.stack(wx, 1), np.stack(wy, 1), np.stack(wz, 1), optimize=True)


Sampler = Callable[[np.ndarray, list[np.ndarray], "tuple[int, int, int]"], dict[str, np.ndarray]]


def sampler(kind: str, grid: Grid, *, corner: bool = False, fade_weights: bool = False) -> tuple[int, list[str], Sampler]:
    """Halo width, output columns and evaluation of one kind of sampling.

    Kinds: nearest, the line rules, ``gradient`` (trilinear value and slope between
    cell corners), ``bspline2``/``bspline3`` (value and slope) and ``hessian``.
    """
    if kind == "nearest":
        def nearest(halo, pos, base, h):
            i = [np.floor(p).astype(np.int64) - b + h for p, b in zip(pos, base)]
            return {"value": halo[i[2], i[1], i[0]]}
        return 1, ["value"], nearest
    if kind in RULES:
        n, rule = RULES[kind]

        def lines(halo, pos, base, h):
            q = [p - (0.0 if corner else 0.5) for p in pos]
            f = [np.floor(a) for a in q]
            t = [a - b for a, b in zip(q, f)]
            if fade_weights:
                t = [fade(a) for a in t]
            i0 = [a.astype(np.int64) - b + h - (n - 1) // 2 for a, b in zip(f, base)]
            return {"value": tensor(windows(halo, i0, n), rule, *t)}
        return (n // 2 + (1 if corner else 0)), ["value"], lines
    if kind == "gradient":
        top = [np.nextafter(s - 1.0, 0.0) for s in grid.dims]  # below the last corner

        def slope(halo, pos, base, h):
            q = [np.clip(p, 0.0, m) for p, m in zip(pos, top)]
            f = [np.floor(a) for a in q]
            u, v, w = (a - b for a, b in zip(q, f))
            win = windows(halo, [a.astype(np.int64) - b + h for a, b in zip(f, base)], 2)
            pair = lambda t: ([1 - t, t], [-np.ones_like(t), np.ones_like(t)])
            (wx, dx), (wy, dy), (wz, dz) = pair(u), pair(v), pair(w)
            return {"value": weighted(win, wx, wy, wz), "gx": weighted(win, dx, wy, wz), "gy": weighted(win, wx, dy, wz), "gz": weighted(win, wx, wy, dz)}
        return 2, ["value", "gx", "gy", "gz"], slope
    if kind == "bspline2":
        def spline2(halo, pos, base, h):
            f = [np.floor(p) for p in pos]
            (wx, dx), (wy, dy), (wz, dz) = (bspline2(np.ceil(p) - p) for p in pos)
            win = windows(halo, [a.astype(np.int64) - b + h - 1 for a, b in zip(f, base)], 3)
            return {"value": weighted(win, wx, wy, wz), "gx": weighted(win, dx, wy, wz), "gy": weighted(win, wx, dy, wz), "gz": weighted(win, wx, wy, dz)}
        return 2, ["value", "gx", "gy", "gz"], spline2
    if kind in ("bspline3", "hessian"):
        def spline3(halo, pos, base, h):
            q = [p - 0.5 for p in pos]
            f = [np.floor(a) for a in q]
            (wx, dx, cx), (wy, dy, cy), (wz, dz, cz) = (bspline3(a - b) for a, b in zip(q, f))
            win = windows(halo, [a.astype(np.int64) - b + h - 1 for a, b in zip(f, base)], 4)
            out = {"value": weighted(win, wx, wy, wz), "gx": weighted(win, dx, wy, wz), "gy": weighted(win, wx, dy, wz), "gz": weighted(win, wx, wy, dz)}
            if kind == "hessian":
                out |= {"hxx": weighted(win, cx, wy, wz), "hyy": weighted(win, wx, cy, wz), "hzz": weighted(win, wx, wy, cz),
                        "hxy": weighted(win, dx, dy, wz), "hxz": weighted(win, dx, wy, dz), "hyz": weighted(win, wx, dy, dz)}
            return out
        names = ["value", "gx", "gy", "gz"] + (["hxx", "hyy", "hzz", "hxy", "hxz", "hyz"] if kind == "hessian" else [])
        return 2, names, spline3
    raise ValueError(f"unknown sampling kind {kind}")


# --- distribution ----------------------------------------------------------------------

def halo_blocks(packed: DataFrame, grid: Grid, h: int, dtype: str, outside: str, empty, periodic=(False,) * 3) -> DataFrame:
    """Rows (bid, halo): blocks with their border cells, including blocks that only have
    neighbours."""
    def run(rows: pa.Table) -> pa.Table:
        bid, *pieces = H.receivers(rows, existing_only=False)
        out = H.assemble(bid, *pieces, grid, h, dtype, outside, empty, periodic)
        return pa.table([pa.array(bid), H.bytes_column(out)], names=["bid", "halo"])

    return H.in_runs(H.slabs(packed, grid, h, dtype, periodic=periodic)).applyInArrow(run, "bid bigint, halo binary")


def split_crowded(points: DataFrame, share: int) -> tuple[DataFrame, DataFrame]:
    """Points with a share number beside their ``bid``, and the shares of each block.

    Copies of a point are kept once with their count.  A crowded block gets several
    shares; a point picks one by its own content, so a rerun picks the same.  The number
    of shares reaches the points of a crowded block over SALTS join keys, not one.
    """
    names = points.columns
    once = points.groupBy(*names).agg(F.count("*").alias("copies")).withColumn("__h", F.xxhash64(*names))
    load = once.groupBy("bid").agg(F.ceil(F.count("*") / share).cast("int").alias("k"))
    crowded = load.where("k > 1").withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = once.withColumn("__salt", F.pmod(F.shiftright("__h", 32), F.lit(SALTS)).cast("int")).join(crowded, ["bid", "__salt"], "left")
    salt = F.pmod("__h", F.coalesce(F.col("k"), F.lit(1))).cast("int")
    return salted.withColumn("share", salt).select(*names, "copies", "share"), load


def spread_blocks(blocks: DataFrame, load: DataFrame) -> DataFrame:
    """One copy of each needed block per share."""
    return blocks.join(load, "bid").withColumn("share", F.explode(F.sequence(F.lit(0), F.col("k") - 1))).drop("k")


def restore_copies(df: DataFrame, step: int = 1 << 16) -> DataFrame:
    """Each row as often as ``copies`` says, by two short arrays."""
    left = F.sequence(F.lit(0).cast("bigint"), F.col("copies") - 1, F.lit(step).cast("bigint"))
    runs = df.withColumn("__from", F.explode(left))
    return runs.withColumn("copies", F.explode(F.sequence(F.lit(1).cast("bigint"), F.least(F.col("copies") - F.col("__from"), F.lit(step))))).drop("copies", "__from")


def sample(points: DataFrame, packed: DataFrame, grid: Grid, kind: str, *, dtype: str = "float32", outside: str = "clamp",
           empty: float | list[float] = 0.0, channels: list[str] | None = None, corner: bool = False, fade_weights: bool = False,
           periodic=(False,) * 3, at: tuple[str, str, str] = ("px", "py", "pz"), share: int = SHARE) -> DataFrame:
    """Add the sampled columns to points whose position is given in cells of ``grid``.

    ``channels`` names the components of blocks packed from several values: all travel in the same slabs,
    and a sampled value is called like its channel, a slope ``<channel>_gx``.  Points without a whole position get null.
    """
    h, names, fn = sampler(kind, grid, corner=corner, fade_weights=fade_weights)
    k = len(channels) if channels else 1
    out_names = [c if n == "value" else f"{c}_{n}" for c in channels for n in names] if channels else names
    cell = [F.greatest(F.least(F.floor(p), F.lit(s - 1)), F.lit(0)).cast("bigint") for p, s in zip(at, grid.dims)]
    pts, load = split_crowded(points.withColumn("bid", F.coalesce(K.cell_block_id(*cell, grid), F.lit(0).cast("bigint"))), share)
    fill = H.record(empty, k, dtype)
    blocks = halo_blocks(packed, grid, h, fill.dtype.str if k > 1 else dtype, outside, fill, periodic)
    fields = [*points.schema.fields, T.StructField("copies", T.LongType())]
    asked = pts.groupBy("bid", "share").agg(F.collect_list(F.struct(*[f.name for f in fields])).alias("pts"))
    ready = asked.join(spread_blocks(blocks, load), ["bid", "share"], "left").select("bid", "pts", "halo")
    edge, m, dims = grid.bsx, grid.bsx + 2 * h, grid.dims
    no_halo = np.full((m, m, m), fill).tobytes()

    def run(b):
        raw = b"".join(no_halo if x is None else x for x in b.column(2).to_pylist())
        # blocks and their channels one above the other: cell z of channel c of block i is z + (i k + c) m
        tall = np.moveaxis(np.frombuffer(raw, dtype).reshape(b.num_rows, m, m, m, k), 4, 1).reshape(-1, m, m).astype(np.float64)
        base = [c * edge for c in H.block_xyz(b.column(0).to_numpy(), grid)]
        of = np.repeat(np.arange(b.num_rows), b.column(1).value_lengths().to_numpy())
        rows = b.column(1).flatten()
        for lo in range(0, len(of), max(1, STEP // k)):
            some, block = rows.slice(lo, max(1, STEP // k)), of[lo:lo + max(1, STEP // k)]
            pos = [some.field(a).to_numpy(zero_copy_only=False).astype(np.float64) for a in at]
            lost = ~np.isfinite(pos[0] + pos[1] + pos[2])
            pos = [np.clip(np.where(lost, s0[block] + 0.5, p), 0.0, s) for p, s0, s in zip(pos, base, dims)]
            start = [s0[block] for s0 in base]
            floor = np.concatenate([start[2] - (block * k + c) * m for c in range(k)])
            got = fn(tall, [np.tile(p, k) for p in pos], [np.tile(start[0], k), np.tile(start[1], k), floor], h)
            values = [got[n].reshape(k, -1)[c] for c in range(k) for n in names]
            yield pa.RecordBatch.from_arrays([*[some.field(f.name) for f in fields], *[pa.array(v, mask=lost) for v in values]],
                                             names=[*[f.name for f in fields], *out_names])

    return restore_copies(ready.mapInArrow(H.stacks(run, TALL), T.StructType([*fields, *[T.StructField(n, T.DoubleType()) for n in out_names]])))
