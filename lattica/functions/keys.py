"""Addressing as column expressions: blocks, voxels, levels, Morton keys, hashes."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType

from lattica.schema import Grid


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def big(c) -> Column:
    return col(c).cast("bigint")


def shl(c, n) -> Column:
    return F.call_function("shiftleft", col(c), col(n).cast("int"))


def shr(c, n) -> Column:
    return F.call_function("shiftright", col(c), col(n).cast("int"))


def block_coord(c, grid: Grid) -> Column:
    return F.shiftright(big(c), grid.shift)


def block_id(bx, by, bz, grid: Grid) -> Column:
    return big(bx) + big(by) * grid.nbx + big(bz) * (grid.nbx * grid.nby)


def cell_block_id(x, y, z, grid: Grid) -> Column:
    return block_id(block_coord(x, grid), block_coord(y, grid), block_coord(z, grid), grid)


def block_coords(bid, grid: Grid) -> tuple[Column, Column, Column]:
    b = big(bid)
    plane = grid.nbx * grid.nby
    bz = F.floor(b / plane).cast("bigint")
    rest = b - bz * plane
    by = F.floor(rest / grid.nbx).cast("bigint")
    return rest - by * grid.nbx, by, bz


def voxel_id(x, y, z, edge: int) -> Column:
    m = edge - 1
    vx, vy, vz = (big(c).bitwiseAND(F.lit(m)) for c in (x, y, z))
    return vx + vy * edge + vz * (edge * edge)


def voxel_coords(vid, edge: int) -> tuple[Column, Column, Column]:
    v = big(vid)
    s = edge.bit_length() - 1
    m = F.lit(edge - 1)
    return v.bitwiseAND(m), F.shiftright(v, s).bitwiseAND(m), F.shiftright(v, 2 * s)


def grid_index(x, y, z, grid: Grid) -> Column:
    """Index of a cell in the whole finest-level grid."""
    return big(x) + big(y) * grid.sx + big(z) * (grid.sx * grid.sy)


def virtual_cell_index(x, y, z, level, grid: Grid) -> Column:
    """Grid-wide unique id of a cell on any level: its lower corner, finest units."""
    up = lambda c: shl(big(c), level)
    return grid_index(up(x), up(y), up(z), grid)


def cell_centre(c, level) -> Column:
    return (col(c) + 0.5) * F.pow(F.lit(2.0), col(level))


def color8(bx, by, bz) -> Column:
    """Parity colour; equal colours never touch."""
    odd = lambda c: big(c).bitwiseAND(F.lit(1))
    return odd(bx) + odd(by) * 2 + odd(bz) * 4


def in_range(x, y, z, grid: Grid) -> Column:
    ok = F.lit(True)
    for c, s in zip((x, y, z), grid.dims):
        ok = ok & (col(c) >= 0) & (col(c) < s)
    return ok


def block_in_range(bx, by, bz, grid: Grid) -> Column:
    ok = F.lit(True)
    for c, s in zip((bx, by, bz), grid.block_dims):
        ok = ok & (col(c) >= 0) & (col(c) < s)
    return ok


def block_intersects_box(bx, by, bz, lo, hi, edge: int) -> Column:
    ok = F.lit(True)
    for c, a, b in zip((bx, by, bz), lo, hi):
        ok = ok & ((col(c) + 1) * edge > a) & (col(c) * edge < b)
    return ok


def dist_to_box_sq(p, lo, hi) -> Column:
    total = F.lit(0.0)
    for c, a, b in zip(p, lo, hi):
        a, b = (F.lit(float(v)) if isinstance(v, (int, float)) else v for v in (a, b))
        d = F.greatest(a - col(c), F.lit(0.0), col(c) - b)
        total = total + d * d
    return total


def dist_to_border(x, y, z, grid: Grid) -> Column:
    near = [F.least(big(c), F.lit(s - 1) - big(c)) for c, s in zip((x, y, z), grid.dims)]
    return F.least(*near)


def clip(c, lo: int, hi: int) -> Column:
    return F.greatest(F.least(big(c), F.lit(hi)), F.lit(lo)).cast("bigint")


def clip_report(x, y, z, grid: Grid) -> dict[str, Column]:
    """Clipped coordinates with the face that did it; x outranks y outranks z."""
    axes = list(zip((x, y, z), grid.dims))
    out = {f"c{a}": clip(c, 0, s - 1) for a, (c, s) in zip("xyz", axes)}
    direction = F.lit(-1)
    face = F.lit(-1)
    for i in (2, 1, 0):
        c, s = axes[i]
        below, above = col(c) < 0, col(c) >= s
        direction = F.when(below | above, F.lit(i)).otherwise(direction)
        face = F.when(below, F.lit(0)).when(above, F.lit(1)).otherwise(face)
    out["clip_dir"] = direction
    out["clip_face"] = face
    return out


# Spread masks of the 21-bit-per-axis Morton key.
MORTON_SPREAD = (
    (32, 0x1F00000000FFFF),
    (16, 0x1F0000FF0000FF),
    (8, 0x100F00F00F00F00F),
    (4, 0x10C30C30C30C30C3),
    (2, 0x1249249249249249),
)


def _spread3(c) -> Column:
    v = big(c)
    for shift, mask in MORTON_SPREAD:
        v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask))
    return v


def _gather3(key: Column) -> Column:
    """Inverse of the spread: walk the same masks from narrow to wide."""
    masks = [m for _, m in MORTON_SPREAD]
    v = key.bitwiseAND(F.lit(masks[-1]))
    for (shift, _), mask in zip(reversed(MORTON_SPREAD), masks[-2::-1] + [0x1FFFFF]):
        v = v.bitwiseOR(F.shiftrightunsigned(v, shift)).bitwiseAND(F.lit(mask))
    return v


def morton_key(x, y, z) -> Column:
    sx, sy, sz = _spread3(x), _spread3(y), _spread3(z)
    return sx.bitwiseOR(F.shiftleft(sy, 1)).bitwiseOR(F.shiftleft(sz, 2))


def morton_coords(key) -> tuple[Column, Column, Column]:
    k = big(key)
    return _gather3(k), _gather3(F.shiftrightunsigned(k, 1)), _gather3(F.shiftrightunsigned(k, 2))


def morton32_key(x, y, z) -> Column:
    """The lowest ten bits of three coordinates interleaved: 30 bits, as a 32-bit key has them."""
    low = lambda c: big(c).bitwiseAND(F.lit(0x3FF))
    return morton_key(low(x), low(y), low(z)).cast("int")


def exponent2(c) -> Column:
    """Binary exponent of a positive double: the whole e with 2^e <= x < 2^(e+1), exact at powers of two."""
    x = col(c).cast("double")
    e = F.floor(F.log2(x))
    two = F.lit(2.0)
    return F.when(F.pow(two, e) > x, e - 1).when(F.pow(two, e + 1) <= x, e + 1).otherwise(e).cast("int")


def int_log2(c) -> Column:
    """Position of the highest set bit of a positive integer."""
    return (F.length(F.bin(big(c))) - 1).cast("int")


_U64 = np.uint64


def mix64_values(k: np.ndarray) -> np.ndarray:
    """Invertible 64-bit finaliser with fixed multipliers."""
    with np.errstate(over="ignore"):
        k = k.astype(np.uint64)
        for m in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
            k = (k ^ (k >> _U64(33))) * _U64(m)
        return k ^ (k >> _U64(33))


def mix32_values(k: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = k.astype(np.uint32)
        for s, m in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
            h = (h ^ (h >> np.uint32(s))) * np.uint32(m)
        return h ^ (h >> np.uint32(16))


def fold64_values(k: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        k = k.astype(np.uint64)
        k = ~k + (k << _U64(18))
        k = (k ^ (k >> _U64(31))) * _U64(21)
        k = k ^ (k >> _U64(11))
        k = k + (k << _U64(6))
        return (k ^ (k >> _U64(22))).astype(np.uint32)


def unit_float_values(h32: np.ndarray) -> np.ndarray:
    """Top 23 bits of a 32-bit hash read as a fraction in [0, 1)."""
    return (mix32_values(h32) >> np.uint32(9)).astype(np.float64) / float(1 << 23)


# Batch functions are wrapped at each call: a wrapper kept at module level would hold
# session objects that cannot travel to executors.

def _batch(fn: Callable[..., np.ndarray], kind: pa.DataType, columns: list) -> Column:
    """``fn`` over int64 values as Arrow holds them: large keys stay whole beside a null, and null stays null."""
    def values(a: pa.Array) -> np.ndarray:
        return a.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)

    def one(a: pa.Array) -> pa.Array:
        return pa.array(fn(values(a)), kind, mask=np.asarray(a.is_null()))

    def five(a: pa.Array, b: pa.Array, c: pa.Array, d: pa.Array, e: pa.Array) -> pa.Array:
        all_ = (a, b, c, d, e)
        return pa.array(fn(*map(values, all_)), kind, mask=np.logical_or.reduce([np.asarray(x.is_null()) for x in all_]))

    out = LongType() if pa.types.is_integer(kind) else DoubleType()
    return F.arrow_udf(one if len(columns) == 1 else five, out)(*[col(c).cast("bigint") for c in columns])


def _words(k: np.ndarray) -> np.ndarray:
    return k.view(np.uint64)


def mix64(c) -> Column:
    return _batch(lambda k: mix64_values(_words(k)).view(np.int64), pa.int64(), [c])


def mix32(c) -> Column:
    return _batch(lambda k: mix32_values(k & 0xFFFFFFFF).astype(np.int64), pa.int64(), [c])


def fold64(c) -> Column:
    return _batch(lambda k: fold64_values(_words(k)).astype(np.int64), pa.int64(), [c])


def hash_unit_float(c) -> Column:
    return _batch(lambda k: unit_float_values(k & 0xFFFFFFFF), pa.float64(), [c])


def fold_unit_float(c) -> Column:
    return _batch(lambda k: unit_float_values(fold64_values(_words(k))), pa.float64(), [c])


def coord_hash8(seed, x, y, z, w) -> Column:
    """Hash of four coordinates, each taken modulo 256."""
    def run(seed, x, y, z, w):
        word = (z & 255) << 24 | (y & 255) << 16 | (x & 255) << 8 | (w & 255)
        return mix32_values((word ^ seed) & 0xFFFFFFFF).astype(np.int64)
    return _batch(run, pa.int64(), [seed, x, y, z, w])


# One multiplier per coordinate.
COORD_PRIMES = (73856093, 19349663, 83492791, 56598313)


def coord_hash16(x, y, z, w) -> Column:
    """Xor of the coordinates times fixed primes, kept to 32 bits."""
    h = F.lit(0).cast("bigint")
    for c, p in zip((x, y, z, w), COORD_PRIMES):
        h = h.bitwiseXOR((big(c) * p).bitwiseAND(F.lit(0xFFFFFFFF)))
    return h
