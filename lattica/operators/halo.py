"""Packed blocks and the border exchange behind every dense stencil.

A packed block is one row: ``bid`` and its cells as bytes in (z, y, x) order.  For a
stencil, each block sends to its neighbours just the slab they need and one
shuffle by receiver brings the at most 27 pieces of a halo together.  Kernels then
run over stacks of whole blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattica.functions import keys as K
from lattica.schema import Grid

SELF = 13  # the block itself among its 27 neighbours
STACK = 256  # blocks per kernel call
RUN = 64  # consecutive block ids that meet in one group
PACKED = "bid bigint, data binary"


def offset_of(code: int) -> tuple[int, int, int]:
    """(dx, dy, dz) of a neighbour code, x fastest."""
    return code % 3 - 1, code // 3 % 3 - 1, code // 9 - 1


def bytes_column(a: np.ndarray) -> pa.Array:
    """One binary value per leading index."""
    n = len(a)
    flat = np.ascontiguousarray(a)
    width = flat.nbytes // n if n else 0
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), n, [None, pa.py_buffer(flat)]).cast(pa.binary()) if n else pa.array([], pa.binary())


def stack_column(col: pa.Array, shape: tuple[int, ...], dtype) -> np.ndarray:
    if len(col) == 0:
        return np.zeros((0, *shape), dtype)
    return np.frombuffer(b"".join(col.to_pylist()), dtype).reshape(len(col), *shape)


def stacks(fn: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], rows: int = STACK):
    """A batch function that hands ``fn`` a few rows at a time and holds no batch while it waits for the next."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, rows):
                yield from fn(whole.slice(at, rows))
            del whole
    return run


def in_runs(df: DataFrame):
    """Group rows by short runs of blocks: a group, not a batch of thousands of blocks, is what a worker holds."""
    return df.groupBy(F.floor(F.col("bid") / RUN).cast("bigint").alias("__run"))


def block_xyz(bid: np.ndarray, grid: Grid) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return bid % grid.nbx, bid // grid.nbx % grid.nby, bid // (grid.nbx * grid.nby)


# --- packing ----------------------------------------------------------------

def record(empty: float | list[float], k: int, dtype: str) -> np.ndarray:
    """What a cell without data reads: a number, or the bytes of ``k`` of them as one value of their own type.

    Slabs are only cut and laid together, so a cell of several channels passes through the exchange as one opaque value.
    """
    values = np.array(empty if isinstance(empty, (list, tuple)) else [empty] * k, dtype)
    if len(values) != k:
        raise ValueError("one empty value per channel")
    return values[0] if k == 1 else values.view(f"V{values.nbytes}")[0]


def pack(cells: DataFrame, grid: Grid, value: str | list[str], empty: float | list[float] = 0.0, dtype: str = "float32") -> DataFrame:
    """Cells to packed blocks; a block with any cell stores all, the rest ``empty``.

    Several values share a block: their bytes lie side by side, cell by cell.
    """
    n = grid.bsx
    values = value if isinstance(value, list) else [value]
    fill = np.array(empty if isinstance(empty, (list, tuple)) else [empty] * len(values), dtype)
    keyed = cells.select(
        K.cell_block_id("x", "y", "z", grid).alias("bid"), K.voxel_id("x", "y", "z", n).cast("int").alias("vid"),
        *[F.col(v).cast("double").alias(f"v{i}") for i, v in enumerate(values)])

    def run(rows: pa.Table) -> pa.Table:
        bid, at = np.unique(rows["bid"].to_numpy(), return_inverse=True)
        out = np.empty((len(bid), n**3, len(fill)), dtype)
        out[:] = fill
        vid = rows["vid"].to_numpy()
        for i in range(len(fill)):
            out[at, vid, i] = rows[f"v{i}"].to_numpy()
        return pa.table([pa.array(bid), bytes_column(out)], names=["bid", "data"])

    return in_runs(keyed).applyInArrow(run, PACKED)


def unpack(packed: DataFrame, grid: Grid, value: str, dtype: str = "float32", drop: float | None = None) -> DataFrame:
    """Packed blocks back to cells; cells equal to ``drop`` are left out."""
    n = grid.bsx

    vid = np.arange(n**3)
    off = (vid % n, vid // n % n, vid // (n * n))

    def run(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        data = stack_column(b.column(1), (n**3,), dtype)
        base = block_xyz(b.column(0).to_numpy(), grid)
        xyz = [(c[:, None] * n + o[None, :]).ravel() for c, o in zip(base, off)]
        v = data.ravel().astype(np.float64)
        keep = slice(None) if drop is None else v != drop
        yield pa.RecordBatch.from_arrays([*[pa.array(c[keep].astype(np.int64)) for c in xyz], pa.array(v[keep])], names=["x", "y", "z", value])

    return packed.mapInArrow(stacks(run), f"x bigint, y bigint, z bigint, {value} double")


# --- exchange ---------------------------------------------------------------

def slabs(packed: DataFrame, grid: Grid, h: int, dtype: str, *, periodic: tuple[bool, bool, bool] = (False,) * 3,
          to_color: int | None = None) -> DataFrame:
    """Rows (bid, code, slab): the at most 27 pieces each receiver needs for a halo of width h."""
    n = grid.bsx
    if h > n:
        raise ValueError("halo wider than a block")
    cut = {0: slice(None), 1: slice(n - h, n), -1: slice(0, h)}

    def run(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        bid = b.column(0).to_numpy()
        data = stack_column(b.column(1), (n, n, n), dtype)
        pos = block_xyz(bid, grid)
        for code in range(27):
            # the receiver sees this block at offset o, so it sits at -o
            o = offset_of(code)
            recv, ok = [], np.ones(len(bid), bool)
            for p, d, size, wrap in zip(pos, o, grid.block_dims, periodic):
                r = p - d
                if wrap:
                    r = r % size
                ok &= (r >= 0) & (r < size)
                recv.append(r)
            if to_color is not None:
                ok &= (recv[0] & 1) + (recv[1] & 1) * 2 + (recv[2] & 1) * 4 == to_color
            if not ok.any():
                continue
            rb = (recv[0] + grid.nbx * (recv[1] + grid.nby * recv[2]))[ok]
            slab = data[ok][:, cut[-o[2]], cut[-o[1]], cut[-o[0]]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(rb.astype(np.int64)), pa.array(np.full(len(rb), code, np.int32)), bytes_column(slab)],
                names=["bid", "code", "slab"])

    return packed.mapInArrow(stacks(run), "bid bigint, code int, slab binary")


def receivers(rows: pa.Table, existing_only: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """The blocks that a group of slabs belongs to, and for each slab its block's place, code and bytes.

    Blocks that store nothing themselves appear only without ``existing_only``.
    """
    bid, code = rows["bid"].to_numpy(), rows["code"].to_numpy()
    own = np.unique(bid[code == SELF] if existing_only else bid)
    mine = np.flatnonzero(np.isin(bid, own))
    return own, np.searchsorted(own, bid[mine]), code[mine], rows["slab"].take(pa.array(mine)).to_pylist()


def assemble(bid: np.ndarray, at: np.ndarray, code: np.ndarray, slab: list[bytes], grid: Grid, h: int, dtype: str, outside: str, empty,
             periodic=(False,) * 3) -> np.ndarray:
    """Stack of halo blocks.

    ``outside``: ``own`` repeats the block's own border wherever no block exists;
    ``clamp`` repeats the domain border and reads ``empty`` in missing blocks;
    ``empty`` reads ``empty`` everywhere.
    """
    n, m = grid.bsx, grid.bsx + 2 * h
    out = np.full((len(bid), m, m, m), empty, dtype)
    place = {0: slice(h, h + n), 1: slice(h + n, m), -1: slice(0, h)}
    span = {0: n, 1: h, -1: h}
    pieces = {int(c): np.flatnonzero(code == c) for c in np.unique(code)}

    def put(c: int) -> None:
        o, some = offset_of(c), pieces[c]
        shape = tuple(span[d] for d in reversed(o))
        out[at[some], place[o[2]], place[o[1]], place[o[0]]] = np.frombuffer(b"".join(slab[i] for i in some), dtype).reshape(len(some), *shape)

    if SELF in pieces:
        put(SELF)
    if outside == "own" and h:
        core = out[:, h:h + n, h:h + n, h:h + n]
        out = np.pad(core, ((0, 0), (h, h), (h, h), (h, h)), mode="edge")
    for c in pieces:
        if c != SELF and h:
            put(c)
    if outside == "clamp" and h:
        for axis, (p, size, wrap) in enumerate(zip(block_xyz(bid, grid), grid.block_dims, periodic)):
            if wrap:
                continue
            view = np.moveaxis(out, 3 - axis, 1)
            first, last = np.flatnonzero(p == 0), np.flatnonzero(p == size - 1)
            view[first, :h] = view[first, h:h + 1]
            view[last, h + n:] = view[last, h + n - 1:h + n]
    return out


Kernel = Callable[[np.ndarray, np.ndarray], np.ndarray]


def stencil(packed: DataFrame, grid: Grid, h: int, kernel: Kernel, *, dtype: str = "float32", outside: str = "own",
            empty: float = 0.0, periodic=(False,) * 3, to_color: int | None = None) -> DataFrame:
    """Apply ``kernel(halo_stack, bid) -> block_stack`` to every existing block."""
    def run(rows: pa.Table) -> pa.Table:
        bid, *pieces = receivers(rows)
        if not len(bid):
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.binary())], names=["bid", "data"])
        out = kernel(assemble(bid, *pieces, grid, h, dtype, outside, empty, periodic), bid).astype(dtype)
        return pa.table([pa.array(bid), bytes_column(out)], names=["bid", "data"])

    return in_runs(slabs(packed, grid, h, dtype, periodic=periodic, to_color=to_color)).applyInArrow(run, PACKED)


def shifted(a: np.ndarray, h: int, dx: int, dy: int, dz: int) -> np.ndarray:
    """View of the core moved by an offset."""
    n = a.shape[1] - 2 * h
    return a[:, h + dz:h + dz + n, h + dy:h + dy + n, h + dx:h + dx + n]


# --- the same neighbourhood in long form, for sparse cells ---------------------

def neighbour_values(cells: DataFrame, offsets: list[tuple[int, int, int]], *values: str, keep: tuple[str, ...] = (), edge: int = 32) -> DataFrame:
    """For every cell, the stored values at the given offsets and how many there are.

    Each cell goes to its cube of ``edge`` cells and, near a face, to the cubes that look at it; a cube is looked
    through at once.  Columns ``<value>_0, <value>_1, ...`` are null where nothing is stored.  ``keep`` names
    columns of the cell itself to carry along.  A missing coordinate stays missing under every offset.
    """
    names, axes = [*values, *keep], ("x", "y", "z")
    merged = cells.groupBy(*[K.big(a).alias(a) for a in axes]).agg(*[F.max(n).alias(n) for n in names], F.count("*").alias("__n"))
    looks = F.array(*[F.struct(*[F.floor((F.col(a) - d) / edge).cast("bigint").alias(f"b{a}") for a, d in zip(axes, o)]) for o in [(0, 0, 0), *offsets]])
    sent = merged.withColumn("__to", F.explode(F.array_distinct(looks))).select("*", *[F.col(f"__to.b{a}").alias(f"__b{a}") for a in axes]).drop("__to")
    far = max(abs(t) for o in offsets for t in o)
    side = edge + 2 * far
    fields = {f.name: f.dataType for f in merged.schema}
    schema = T.StructType([*[T.StructField(a, T.LongType()) for a in axes], T.StructField("active", T.LongType()), *[T.StructField(n, fields[n]) for n in names],
                           *[T.StructField(f"{v}_{i}", fields[v]) for v in values for i in range(len(offsets))]])

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        base = [k.as_py() for k in key]
        rows = rows.combine_chunks()
        at = [np.zeros(rows.num_rows, np.int64) if b is None else rows[a].to_numpy() - b * edge for a, b in zip(axes, base)]
        own = np.flatnonzero(np.all([(c >= 0) & (c < edge) for c in at], axis=0))
        place = lambda c: ((c[2] + far) * side + c[1] + far) * side + c[0] + far
        index = np.full(side**3, -1, np.int64)
        index[place(at)] = np.arange(rows.num_rows)
        found = [index[place([c[own] + (0 if b is None else d) for c, b, d in zip(at, base, o)])] for o in offsets]
        times = rows["__n"].to_numpy()
        active = sum(np.where(f >= 0, times[f], 0) for f in found)
        there = [pa.array(f, mask=f < 0) for f in found]
        self = rows.take(pa.array(own))
        return pa.table([*[self[a] for a in axes], pa.array(active, pa.int64()), *[self[n] for n in names], *[rows[v].take(f) for v in values for f in there]],
                        names=[f.name for f in schema])

    return sent.groupBy(*[f"__b{a}" for a in axes]).applyInArrow(run, schema).select(*axes, "active", *names, *[
        f"{v}_{i}" for v in values for i in range(len(offsets))])


def wrap_coordinate(c, size: int) -> Column:
    """Periodic image of a coordinate inside [0, size)."""
    return F.pmod(K.big(c), F.lit(size))
