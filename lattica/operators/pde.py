"""Smoothing and diffusion steps on packed blocks."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.functions import keys as K
from lattica.operators import halo as H
from lattica.schema import Grid
from lattica.session import cut_lineage

LIMIT = 0.1  # largest change of one curvature step
FLAT = 1e-7  # squared slope below which curvature is undefined
AXES = ((1, 0, 0), (0, 1, 0), (0, 0, 1))


@dataclass(frozen=True)
class Step:
    """One kind of step.

    kind: 1 Laplacian times slope, 2 bi-Laplacian times slope, 3 diffusion,
    4 mean curvature, 14 edge-preserving diffusion, 15 and 17 the implicit-weight
    forms of 14 and 3.
    """

    kind: int
    dt: float = 0.1
    alpha: float = 0.2  # edge threshold; negative selects the exponential form
    taubin: float = 0.0  # >0: alternate shrinking with inflation of this strength
    clamp01: bool = True
    keep_inside: float = 0.0  # margin kept free at 0 and 1
    band: tuple[float, float] | None = None  # largest drop and rise against the start

    @property
    def width(self) -> int:
        return 2 if self.kind == 2 else 1


def _pairs(a: np.ndarray, h: int, axis: int, r: int = 1) -> tuple[np.ndarray, np.ndarray]:
    o = [r * t for t in AXES[axis]]
    return H.shifted(a, h, *[-t for t in o]), H.shifted(a, h, *o)


def _edge_weight(f: np.ndarray, alpha: float) -> np.ndarray:
    q = (f / abs(alpha)) ** 2
    return np.exp(-q) if alpha < 0 else 1.0 / (1.0 + q)


def change(a: np.ndarray, step: Step) -> np.ndarray:
    """Value after one plain step (before sign alternation and clamping), minus the value."""
    h, dt = step.width, step.dt
    f0 = H.shifted(a, h, 0, 0, 0)
    sides = [_pairs(a, h, k) for k in range(3)]
    slope = [0.5 * (hi - lo) for lo, hi in sides]
    grad_sq = slope[0] ** 2 + slope[1] ** 2 + slope[2] ** 2
    ring = sum(lo + hi for lo, hi in sides)
    if step.kind == 1:
        return dt * (ring - 6.0 * f0) * np.sqrt(grad_sq)
    if step.kind == 2:
        far = sum(lo + hi for lo, hi in (_pairs(a, h, k, 2) for k in range(3)))
        diag = sum(H.shifted(a, h, *o) for o in _DIAGONALS)
        bi = 42.0 * f0 - 12.0 * ring + far + 2.0 * diag
        return np.clip(-dt * bi * np.sqrt(grad_sq), -LIMIT, LIMIT)
    if step.kind == 3:
        return dt * (ring / 6.0 - f0)
    if step.kind == 4:
        second = [lo + hi - 2.0 * f0 for lo, hi in sides]
        bend = sum((grad_sq - slope[k] ** 2) * second[k] for k in range(3))
        for p, q in ((0, 1), (0, 2), (1, 2)):
            plus = [s + t for s, t in zip(AXES[p], AXES[q])]
            minus = [s - t for s, t in zip(AXES[p], AXES[q])]
            neg = lambda o: [-t for t in o]
            mixed = 0.25 * (H.shifted(a, h, *plus) - H.shifted(a, h, *minus) - H.shifted(a, h, *neg(minus)) + H.shifted(a, h, *neg(plus)))
            bend = bend - 2.0 * slope[p] * slope[q] * mixed
        curv = np.where(grad_sq > FLAT, bend / np.where(grad_sq > FLAT, grad_sq, 1.0), 0.0)
        return np.clip(dt * curv, -LIMIT, LIMIT)
    if step.kind == 17:
        return (f0 + dt * ring) / (1.0 + 6.0 * dt) - f0
    near = [s for pair in sides for s in pair]
    w = [_edge_weight(s - f0, step.alpha) for s in near]
    if step.kind == 14:
        return dt * sum(g * (s - f0) for g, s in zip(w, near))
    if step.kind == 15:
        return (f0 + dt * sum(g * s for g, s in zip(w, near))) / (1.0 + dt * sum(w)) - f0
    raise ValueError(f"unknown step kind {step.kind}")


_DIAGONALS = [(x, y, z) for x in (-1, 0, 1) for y in (-1, 0, 1) for z in (-1, 0, 1) if abs(x) + abs(y) + abs(z) == 2]


def kernel(step: Step, iteration: int) -> H.Kernel:
    def run(halo: np.ndarray, _bid: np.ndarray) -> np.ndarray:
        a = halo.astype(np.float64)
        f0 = H.shifted(a, step.width, 0, 0, 0)
        d = change(a, step)
        if step.taubin and step.kind in (1, 4) and iteration % 2 == 0:
            d = -step.taubin * d
        out = f0 + d
        if step.clamp01 and step.band is None:
            out = np.clip(out, step.keep_inside, 1.0 - step.keep_inside)
        return out
    return run


def sweeps(n: int) -> int:
    """Odd iteration counts are rounded up."""
    return n + n % 2


def smooth(packed: DataFrame, grid: Grid, step: Step, iterations: int, *, order: str = "jacobi", dtype: str = "float32",
           empty: float = 0.0, checkpoint_every: int = 4) -> DataFrame:
    """Repeat a step.

    ``jacobi`` updates all blocks from the previous state: one exchange per
    iteration.  ``redblack`` and ``color8`` let later colours see earlier ones of the
    same iteration: one exchange per colour, restricted to its receivers.
    """
    start = packed
    state = packed
    done = 0
    for it in range(sweeps(iterations)):
        k = kernel(step, it)
        if order == "jacobi":
            state = _bounded(H.stencil(state, grid, step.width, k, dtype=dtype, empty=empty), start, step, dtype)
            done += 1
        else:
            for c in range(8 if order == "color8" else 2):
                state = _one_color(state, start, grid, step, k, c, order, dtype, empty)
                done += 1
                # both the updated and the untouched part read the state: settle it
                state = cut_lineage(state)
                done = 0
        if done >= checkpoint_every:
            state, done = cut_lineage(state), 0
    return state


def _one_color(state, start, grid, step, k, c, order, dtype, empty) -> DataFrame:
    bx, by, bz = K.block_coords("bid", grid)
    if order == "color8":
        mine = K.color8(bx, by, bz) == c
        fresh = H.stencil(state, grid, step.width, k, dtype=dtype, empty=empty, to_color=c)
    else:
        mine = (bx + by + bz).bitwiseAND(F.lit(1)) == c
        fresh = H.stencil(state, grid, step.width, k, dtype=dtype, empty=empty).where(mine)
    return _bounded(fresh, start, step, dtype).unionByName(state.where(~mine))


def _bounded(new: DataFrame, start: DataFrame, step: Step, dtype: str) -> DataFrame:
    """Hold values within a band around the start, where one is asked for."""
    if step.band is None:
        return new
    down, up = step.band
    both = new.join(start.select("bid", F.col("data").alias("ref")), "bid")

    def hold(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        v, s = (np.frombuffer(b"".join(b.column(i).to_pylist()), dtype).reshape(b.num_rows, -1) for i in (1, 2))
        yield pa.RecordBatch.from_arrays([b.column(0), H.bytes_column(np.clip(v, np.maximum(s - down, 0.0), np.minimum(s + up, 1.0)).astype(dtype))], names=["bid", "data"])

    return both.select("bid", "data", "ref").mapInArrow(H.stacks(hold), H.PACKED)


# --- 3x3x3 blur and sharpen -------------------------------------------------------

def gauss3(radius: float, sharpness: float) -> np.ndarray:
    """Normalised 3x3x3 weights (dz, dy, dx); positive sharpness subtracts the blur."""
    r, s = 0.75 * radius, 2.0 * sharpness
    sigma = 2.0 * r * (s / 3.0 if s > 0 else 1.0)
    t = np.arange(-1, 2)
    d2 = t[:, None, None] ** 2 + t[None, :, None] ** 2 + t[None, None, :] ** 2
    w = np.exp(-d2 / (2.0 * sigma * sigma))
    w /= w.sum()
    if s > 0:
        w = -s * w
        w[1, 1, 1] += s + 1.0
    return w


def convolve3(packed: DataFrame, grid: Grid, weights: np.ndarray, dtype: str = "float32", zero_border: bool = False) -> DataFrame:
    """3x3x3 weighted sum; the domain border repeats, missing blocks read 0."""
    def run(halo: np.ndarray, bid: np.ndarray) -> np.ndarray:
        a = halo.astype(np.float64)
        out = sum(weights[dz + 1, dy + 1, dx + 1] * H.shifted(a, 1, dx, dy, dz)
                  for dz in (-1, 0, 1) for dy in (-1, 0, 1) for dx in (-1, 0, 1))
        if zero_border:
            for axis, (p, size) in enumerate(zip(H.block_xyz(bid, grid), grid.block_dims)):
                view = np.moveaxis(out, 3 - axis, 1)
                view[np.flatnonzero(p == 0), 0] = 0.0
                view[np.flatnonzero(p == size - 1), -1] = 0.0
        return out
    return H.stencil(packed, grid, 1, run, dtype=dtype, outside="clamp")
