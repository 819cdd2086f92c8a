"""Matrices, transforms and regressions.

Large matrices are long tables (i, j, v) and multiply by a join and a sum.  Small
ones, one per row, are flat arrays: two rows are closed formulas over columns, larger
ones are eliminated or rotated in step, a whole batch of matrices at a time.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from lattica.operators import order as O, stats as S


def multiply(a: DataFrame, b: DataFrame) -> DataFrame:
    """Product of two long matrices."""
    p = a.select("i", F.col("j").alias("k"), F.col("v").alias("va")).join(b.select(F.col("i").alias("k"), "j", F.col("v").alias("vb")), "k")
    return p.groupBy("i", "j").agg(F.sum(F.col("va") * F.col("vb")).alias("v"))


def transpose(a: DataFrame) -> DataFrame:
    return a.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")


def _stack(s: pd.Series, *shape: int) -> np.ndarray:
    return np.stack([np.asarray(r, float) for r in s]).reshape(-1, *shape) if len(s) else np.zeros((0, *shape))


def _column(values: np.ndarray) -> pd.Series:
    """One array per matrix; null where any entry is not finite."""
    flat = values.reshape(len(values), -1)
    fine = np.isfinite(flat).all(axis=1)
    return pd.Series([r.tolist() if ok else None for r, ok in zip(flat, fine)], dtype=object)


def _many(n: int, fn):
    @F.pandas_udf(ArrayType(DoubleType()))
    def run(m: pd.Series) -> pd.Series:
        with np.errstate(all="ignore"):
            return _column(fn(_stack(m, n, n)))
    return run


# --- stacks of matrices, eliminated in step -----------------------------------------

def lu_stack(a: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Upper triangles, right sides carried along and the sign of the row swaps, by partial pivoting."""
    a, right, sign, at = a.copy(), right.copy(), np.ones(len(a)), np.arange(len(a))
    for k in range(a.shape[1]):
        best = np.abs(a[:, k:, k]).argmax(axis=1) + k if len(a) else np.zeros(0, int)
        for m in (a, right):
            m[at, k], m[at, best] = m[at, best].copy(), m[at, k].copy()
        sign = np.where(best != k, -sign, sign)
        pivot = a[:, k, k]
        f = np.where(pivot[:, None] != 0, a[:, k + 1:, k] / pivot[:, None], 0.0)
        a[:, k + 1:, k:] -= f[:, :, None] * a[:, k, None, k:]
        right[:, k + 1:] -= f[:, :, None] * right[:, k, None]
    return a, right, sign


def solve_stack(a: np.ndarray, right: np.ndarray) -> np.ndarray:
    """X of A X = right for every matrix; not finite where rows depend on each other."""
    u, x, _ = lu_stack(a, right)
    for k in range(a.shape[1] - 1, -1, -1):
        x[:, k] = (x[:, k] - np.einsum("bj,bjc->bc", u[:, k, k + 1:], x[:, k + 1:])) / u[:, k, k, None]
    return x


def inverse_stack(a: np.ndarray) -> np.ndarray:
    return solve_stack(a, np.broadcast_to(np.eye(a.shape[1]), a.shape))


def determinant_stack(a: np.ndarray) -> np.ndarray:
    u, _, sign = lu_stack(a, np.zeros((*a.shape[:2], 0)))
    return sign * np.prod(np.einsum("bkk->bk", u), axis=1)


def cholesky_stack(a: np.ndarray) -> np.ndarray:
    """Lower triangular factors; not finite where a matrix is not positive definite."""
    low = np.zeros_like(a)
    for k in range(a.shape[1]):
        rest = a[:, k:, k] - np.einsum("bij,bj->bi", low[:, k:, :k], low[:, k, :k])
        low[:, k:, k] = rest / np.sqrt(np.where(rest[:, :1] > 0, rest[:, :1], np.nan))
    return low


def jacobi_stack(a: np.ndarray, sweeps: int = 40) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(U S, S, V) of every matrix: columns are rotated in pairs until all are orthogonal; S descends."""
    u, n = a.copy(), a.shape[2]
    v = np.broadcast_to(np.eye(n), (len(a), n, n)).copy()
    for _ in range(sweeps):
        moved = False
        for p in range(n - 1):
            for q in range(p + 1, n):
                x, y = u[:, :, p], u[:, :, q]
                xx, yy, xy = (x * x).sum(axis=1), (y * y).sum(axis=1), (x * y).sum(axis=1)
                turn = np.abs(xy) > 1e-15 * np.sqrt(xx * yy)
                if not turn.any():
                    continue
                moved = True
                z = (yy - xx) / np.where(turn, 2 * xy, 1.0)
                t = np.where(turn, np.where(z >= 0, 1.0, -1.0) / (np.abs(z) + np.hypot(1.0, z)), 0.0)
                c = 1 / np.hypot(1.0, t)
                c, s = c[:, None], (c * t)[:, None]
                for m in (u, v):
                    m[:, :, p], m[:, :, q] = c * m[:, :, p] - s * m[:, :, q], s * m[:, :, p] + c * m[:, :, q]
        if not moved:
            break
    size = np.sqrt((u * u).sum(axis=1))
    order = np.argsort(-size, axis=1, kind="stable")
    pick = lambda m: np.take_along_axis(m, order[:, None, :], 2)
    return pick(u), np.take_along_axis(size, order, 1), pick(v)


def pseudo_inverse_stack(a: np.ndarray) -> np.ndarray:
    """Directions below 1e-15 of the largest singular value count as none."""
    us, size, v = jacobi_stack(a)
    keep = size > 1e-15 * size.max(axis=1, initial=0.0)[:, None]
    over = np.where(keep, 1 / np.where(keep, size, 1.0) ** 2, 0.0)
    return np.einsum("bik,bk,bjk->bij", v, over, us)


# --- columns of flat arrays ------------------------------------------------------------

def _four(m: Column) -> list[Column]:
    return [F.element_at(m, i + 1) for i in range(4)]


def cholesky(m: Column, n: int) -> Column:
    """Lower triangular factor, row by row; null beyond two rows where the matrix is not positive definite."""
    if n != 2:
        return _many(n, cholesky_stack)(m)
    a, _, c, d = _four(m)
    low = c / F.sqrt(a)
    return F.array(F.sqrt(a), F.lit(0.0), low, F.sqrt(d - low * low))


def inverse(m: Column, n: int) -> Column:
    if n != 2:
        return _many(n, inverse_stack)(m)
    a, b, c, d = _four(m)
    det = determinant(m, 2)
    return F.array(*[F.try_divide(v, det) for v in (d, -b, -c, a)])


def pseudo_inverse(m: Column, n: int) -> Column:
    if n != 2:
        return _many(n, pseudo_inverse_stack)(m)
    a, b, c, d = _four(m)
    size = a * a + b * b + c * c + d * d
    flat = F.abs(determinant(m, 2)) <= size * 1e-15  # one direction at most: the transpose over its size
    thin = F.array(*[F.coalesce(F.try_divide(v, size), F.lit(0.0)) for v in (a, c, b, d)])
    return F.when(flat, thin).otherwise(inverse(m, 2))


def singular_values(m: Column, n: int) -> Column:
    """From the largest down."""
    if n != 2:
        return _many(n, lambda a: jacobi_stack(a)[1])(m)
    a, b, c, d = _four(m)
    total, det = a * a + b * b + c * c + d * d, F.abs(determinant(m, 2))
    both, gap = F.sqrt(total + det * 2), F.sqrt(F.greatest(total - det * 2, F.lit(0.0)))  # sum and difference of the two
    return F.array((both + gap) / 2, (both - gap) / 2)


def determinant(m: Column, n: int) -> Column:
    if n == 2:
        a, b, c, d = _four(m)
        return a * d - b * c

    @F.pandas_udf(DoubleType())
    def run(s: pd.Series) -> pd.Series:
        with np.errstate(all="ignore"):
            return pd.Series(determinant_stack(_stack(s, n, n)))
    return run(m)


def solve(m: Column, rhs: Column, n: int) -> Column:
    """Solution of n equations per row; null where they do not determine it (with two rows, null components)."""
    if n == 2:
        a, b, c, d = _four(m)
        p, q = F.element_at(rhs, 1), F.element_at(rhs, 2)
        det = determinant(m, 2)
        return F.array(F.try_divide(d * p - b * q, det), F.try_divide(a * q - c * p, det))

    @F.pandas_udf(ArrayType(DoubleType()))
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        with np.errstate(all="ignore"):
            return _column(solve_stack(_stack(a, n, n), _stack(b, n, 1)))
    return run(m, rhs)


def normal_equations(df: DataFrame, keys: list[str], xs: list[str], y: str) -> DataFrame:
    """Per group the matrix and right side of least squares: plain combinable sums."""
    n = len(xs)
    sums = {(i, j): F.sum(F.col(xs[i]) * F.col(xs[j])) for i in range(n) for j in range(i, n)}
    mat = F.array(*[sums[min(i, j), max(i, j)] for i in range(n) for j in range(n)])
    rhs = F.array(*[F.sum(F.col(x) * F.col(y)) for x in xs])
    return df.groupBy(*keys).agg(mat.alias("m"), rhs.alias("r"), F.count("*").alias("n"))


def least_squares(df: DataFrame, keys: list[str], xs: list[str], y: str) -> DataFrame:
    eq = normal_equations(df, keys, xs, y)
    return eq.withColumn("w", solve(F.col("m"), F.col("r"), len(xs)))


# --- stepwise adaptation -----------------------------------------------------------

def compose_maps(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """w -> a[-1] (... (a[0] w + b[0]) ...) + b[-1] as one map: neighbours are merged until one is left."""
    while len(a) > 1:
        if len(a) % 2:
            a, b = np.concatenate([a, np.eye(a.shape[1])[None]]), np.concatenate([b, np.zeros((1, b.shape[1]))])
        b = (a[1::2] @ b[0::2, :, None])[..., 0] + b[1::2]
        a = a[1::2] @ a[0::2]
    return a[0], b[0]


def adapt(df: DataFrame, keys: list[str], order: list[str], xs: list[str], y: str, alpha: float, passes: int = 1,
          w0: list[float] | None = None, steps: int | None = None, group_rows: int | None = None, chunk: int = 50_000) -> DataFrame:
    """Weights after stepping w += eta (y - w.x) x through the samples in order, over and over.

    It stops after ``passes`` over a series or, if given, after ``steps`` samples, which may end
    inside a pass.  ``w0`` are the weights before the first step.  Each step is an affine map of
    w, so a chunk of samples boils down to one small matrix and vector and chunks compose: no
    series has to pass through one task.  A pass that is cut composes only the samples before
    the cut.
    """
    m = len(xs)
    power = sum((F.sum(F.col(x) * F.col(x)) for x in xs), F.lit(0.0))
    eta = df.groupBy(*keys).agg((power / F.count("*")).alias("__p")).select(
        *keys, (F.lit(2.0 * alpha) / F.when(F.col("__p") < 1e-20, 0.001).otherwise(F.col("__p"))).alias("__eta"))
    at = O.indexed(df.select(*keys, *order, *xs, y), keys, order, group_rows)
    at = O.join_on(at, eta, keys)
    size = min(chunk, group_rows) if group_rows else chunk
    at = at.withColumn("__c", F.floor(F.col("i") / size).cast("bigint"))
    if steps is not None:
        count = df.groupBy(*keys).agg(F.count("*").alias("__n"))
        at = O.join_on(at, count.withColumn("__cut", F.lit(steps) % F.col("__n")), keys)
    else:
        at = at.withColumns({"__n": F.lit(1).cast("bigint"), "__cut": F.lit(0).cast("bigint")})
    key_fields = [df.schema[k] for k in keys]
    # ``part`` is the map of the chunk's samples before the cut
    mid = StructType([*key_fields, StructField("__c", LongType()), StructField("__n", LongType()), StructField("map", ArrayType(DoubleType())),
                      StructField("part", ArrayType(DoubleType()))])

    def through(x: np.ndarray, t: np.ndarray, e: float) -> tuple[np.ndarray, np.ndarray]:
        a, b = np.eye(m), np.zeros(m)
        for k in range(0, len(x), 4096):
            p, q = x[k:k + 4096], t[k:k + 4096]
            ca, cb = compose_maps(np.eye(m) - e * p[:, :, None] * p[:, None, :], e * q[:, None] * p)
            a, b = ca @ a, ca @ b + cb
        return a, b

    def shrink(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i", kind="stable")
        e, x, t = float(pdf["__eta"].iloc[0]), pdf[xs].to_numpy(float), pdf[y].to_numpy(float)
        k = int(np.searchsorted(pdf["i"].to_numpy(), int(pdf["__cut"].iloc[0])))
        head = through(x[:k], t[:k], e)
        rest = through(x[k:], t[k:], e)
        whole = rest[0] @ head[0], rest[0] @ head[1] + rest[1]
        return pd.DataFrame({**{k: [pdf[k].iloc[0]] for k in keys}, "__c": [pdf["__c"].iloc[0]], "__n": [int(pdf["__n"].iloc[0])],
                             "map": [np.r_[whole[0].ravel(), whole[1]].tolist()], "part": [np.r_[head[0].ravel(), head[1]].tolist()]})

    maps = at.groupBy(*keys, "__c").applyInPandas(shrink, mid)
    start = np.asarray(w0 if w0 is not None else np.zeros(m), float)
    out = StructType([*key_fields, StructField("w", ArrayType(DoubleType()))])

    def compose(pdf: pd.DataFrame) -> pd.DataFrame:
        # one row per chunk of the series
        pdf = pdf.sort_values("__c")

        def composed(name: str) -> tuple[np.ndarray, np.ndarray]:
            r = np.stack(pdf[name].to_list()).astype(float)
            return compose_maps(r[:, :m * m].reshape(-1, m, m), r[:, m * m:])
        a, b = composed("map")
        w = start
        for _ in range(passes if steps is None else steps // int(pdf["__n"].iloc[0])):
            w = a @ w + b
        if steps is not None:
            a, b = composed("part")
            w = a @ w + b
        return pd.DataFrame({**{k: [pdf[k].iloc[0]] for k in keys}, "w": [w.tolist()]})

    return maps.groupBy(*keys).applyInPandas(compose, out)


def forecast_by_neighbours(df: DataFrame, vec: str, ids: list[str], y: str, at: list[list[float]], k: int = 20) -> DataFrame:
    """Mean of y over the k samples nearest to each query vector."""
    near = S.nearest(df, vec, [*ids, y], at, k)
    return near.groupBy("q").agg(F.avg(y).alias("forecast"))


# --- Fourier -------------------------------------------------------------------------

LINES = 1 << 20
"""Values of lines that are transformed at once."""


def _line_fft(df: DataFrame, keys: list[str], pos: str, n: int | str, back: bool) -> DataFrame:
    """FFT along ``pos`` (0..n-1) of each group, absent positions 0; a group is one line of n, a number or a key.

    Lines are rows of arrays, so many short ones are transformed in one call.
    """
    size = F.col(n) if isinstance(n, str) else F.lit(n)
    lines = df.groupBy(*keys).agg(F.collect_list(F.struct(F.col(pos).cast("bigint").alias("p"), "re", "im")).alias("cells")).select(*keys, size.cast("bigint").alias("__n"), "cells")
    pair = ArrayType(StructType([StructField("re", DoubleType()), StructField("im", DoubleType())]))
    out = StructType([*[df.schema[k] for k in keys], StructField("z", pair)])

    def run(batches):
        for whole in batches:
            sizes = whole.column(len(keys)).to_numpy()
            step = max(1, LINES // int(sizes.max(initial=1)))
            for first in range(0, whole.num_rows, step):
                b, own = whole.slice(first, step), sizes[first:first + step]
                cells = b.column(len(keys) + 1)
                row = np.repeat(np.arange(b.num_rows), cells.value_lengths().to_numpy())
                at, re, im = (cells.flatten().field(i).to_numpy() for i in range(3))
                start = np.r_[0, np.cumsum(own)]
                flat = np.zeros(start[-1], complex)
                flat[start[row] + at] = re + 1j * im
                for m in np.unique(own):
                    mine = start[:-1][own == m][:, None] + np.arange(m)
                    flat[mine] = np.fft.ifft(flat[mine], axis=1) * m if back else np.fft.fft(flat[mine], axis=1)
                z = pa.StructArray.from_arrays([pa.array(flat.real), pa.array(flat.imag)], names=["re", "im"])
                yield pa.RecordBatch.from_arrays([*b.columns[:len(keys)], pa.ListArray.from_arrays(pa.array(start, pa.int32()), z)], names=[*keys, "z"])

    done = lines.mapInArrow(run, out).select(*keys, F.posexplode("z").alias(pos, "z"))
    return done.select(*keys, F.col(pos).cast("bigint").alias(pos), "z.re", "z.im")


def fft_long(df: DataFrame, keys: list[str], n1: int, n2: int, back: bool = False) -> DataFrame:
    """Transform of a long series (i, re, im) of length n1*n2 by its two factors.

    Columns of n1, a phase factor, rows of n2: groups hold about the square root of
    the series, however long it is.
    """
    n = n1 * n2
    a = df.select(*keys, F.floor(F.col("i") / n2).cast("bigint").alias("p"), (F.col("i") % n2).cast("bigint").alias("q"), "re", "im")
    f = _line_fft(a, [*keys, "q"], "p", n1, back)
    t = F.col("p") * F.col("q") * (2.0 * np.pi / n * (1 if back else -1))
    c, s = F.cos(t), F.sin(t)
    f = f.select(*keys, "p", "q", (F.col("re") * c - F.col("im") * s).alias("re"), (F.col("re") * s + F.col("im") * c).alias("im"))
    g = _line_fft(f, [*keys, "p"], "q", n2, back)
    k = 1.0 / n if back else 1.0
    return g.select(*keys, (F.col("q") * n1 + F.col("p")).alias("i"), (F.col("re") * k).alias("re"), (F.col("im") * k).alias("im"))


def fft_any(df: DataFrame, keys: list[str], n: int, back: bool = False) -> DataFrame:
    """Transform of series (i, re, im) of any one length n, prime ones included; the inverse divides by n.

    With ik = (i² + k² - (k - i)²) / 2 the sum is a convolution with a chirp, which three long transforms
    of a power of two carry out.  The chirp's own transform is a table of its length, shared by all series.
    """
    bits = max(2, (2 * n - 2).bit_length())
    size = 1 << bits
    n1, n2 = 1 << bits // 2, 1 << (bits - bits // 2)
    sign = 1.0 if back else -1.0

    def chirp(i: Column, s: float) -> tuple[Column, Column]:
        t = F.pmod(i * i, F.lit(2 * n)) * (s * np.pi / n)  # the phase repeats every 2n
        return F.cos(t), F.sin(t)

    def times(re: Column, im: Column, c: Column, s: Column) -> list[Column]:
        return [(re * c - im * s).alias("re"), (re * s + im * c).alias("im")]

    i = F.col("i")
    a = df.select(*keys, "i", *times(F.col("re"), F.col("im"), *chirp(i, sign)))
    # the chirp runs both ways around zero: position size - i stands for -i
    j = F.least(F.col("id"), F.lit(size) - F.col("id"))
    c, s = chirp(j, -sign)
    wave = df.sparkSession.range(size).where(j < n).select(F.col("id").alias("i"), c.alias("re"), s.alias("im"))
    table = fft_long(wave, [], n1, n2).select("i", F.col("re").alias("c"), F.col("im").alias("s"))
    both = fft_long(a, keys, n1, n2).join(table, "i").select(*keys, "i", *times(F.col("re"), F.col("im"), F.col("c"), F.col("s")))
    out = fft_long(both, keys, n1, n2, back=True).where(i < n)
    scale = 1.0 / n if back else 1.0
    return out.select(*keys, "i", *[(x * scale).alias(k) for x, k in zip(times(F.col("re"), F.col("im"), *chirp(i, sign)), ("re", "im"))])


def fft_series(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Transform of whole series (re, im), each padded to the power of two its own length needs.

    The four steps of ``fft_long``, with the factors as columns of the group: a group of a task is a
    line of about the square root of its own series, whatever other series there are.
    """
    at = O.running(df, keys, order, {"i": F.lit(1).cast("bigint")}, totals={"n": F.lit(1).cast("bigint")})
    bits = F.greatest(F.ceil(F.log2(F.col("n"))), F.lit(2)).cast("int")
    at = at.withColumn("bits", bits).withColumn("low", F.floor(F.col("bits") / 2).cast("int")).withColumns(
        {"n1": F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("low")), "n2": F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("bits") - F.col("low"))})
    size = ["n1", "n2"]
    a = at.select(*keys, *size, F.floor(F.col("i") / F.col("n2")).cast("bigint").alias("p"), (F.col("i") % F.col("n2")).alias("q"), "re", "im")
    f = _line_fft(a, [*keys, *size, "q"], "p", "n1", False)
    t = F.col("p") * F.col("q") * (-2.0 * np.pi / (F.col("n1") * F.col("n2")))
    c, s = F.cos(t), F.sin(t)
    f = f.select(*keys, *size, "p", "q", (F.col("re") * c - F.col("im") * s).alias("re"), (F.col("re") * s + F.col("im") * c).alias("im"))
    g = _line_fft(f, [*keys, *size, "p"], "q", "n2", False)
    return g.select(*keys, (F.col("q") * F.col("n1") + F.col("p")).alias("i"), "re", "im")


def fft_plane(df: DataFrame, nx: int, ny: int, back: bool = False) -> DataFrame:
    """Transform of pixels (x, y, re, im): lines one way, then the other."""
    rows = _line_fft(df, ["y"], "x", nx, back)
    cols = _line_fft(rows, ["x"], "y", ny, back)
    k = 1.0 / (nx * ny) if back else 1.0
    return cols.select("x", "y", (F.col("re") * k).alias("re"), (F.col("im") * k).alias("im"))


def filter_plane(df: DataFrame, nx: int, ny: int, gain) -> DataFrame:
    """Multiply the spectrum by ``gain(frequency)`` in cycles per pixel and transform back."""
    f = fft_plane(df, nx, ny)
    fold = lambda c, n: F.least(F.col(c), F.lit(n) - F.col(c)) / float(n)
    r = F.sqrt(fold("x", nx) * fold("x", nx) + fold("y", ny) * fold("y", ny))
    return fft_plane(f.select("x", "y", (F.col("re") * gain(r)).alias("re"), (F.col("im") * gain(r)).alias("im")), nx, ny, back=True)
