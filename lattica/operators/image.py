"""Pixel tables (x, y, value): slopes, smoothing kernels, resizing, pyramids, differences."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.operators import channels as C, halo as H, pyramid as Y

CARTESIAN = [(1, 0), (-1, 0), (0, 1), (0, -1)]
RING = [(dx, dy) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if (dx, dy) != (0, 0)]


def taps(pixels: DataFrame, value: str, offsets: list[tuple[int, int]], size: tuple[int, int]) -> DataFrame:
    """Each pixel with its neighbours as ``t<dx>_<dy>``; reads beyond the border repeat it.

    A border pixel stands in for the outside ones, so it sends itself to every reader
    whose clamped read lands on it.
    """
    sx, sy = size
    src = pixels.select("x", "y", value)

    def readers(c: str, d: int, n: int) -> Column:
        """Positions whose read at +d, clamped, is c."""
        direct = F.col(c) - d
        hits = [F.when((direct >= 0) & (direct < n), direct)]
        if d > 0:
            hits += [F.when((F.col(c) == n - 1), F.lit(n - 1 - k).cast("bigint")) for k in range(d) if n - 1 - k >= 0]
        if d < 0:
            hits += [F.when(F.col(c) == 0, F.lit(k).cast("bigint")) for k in range(-d) if k < n]
        return F.array_distinct(F.array_compact(F.array(*hits)))

    looks = F.array(*[F.struct(F.lit(i).alias("s"), readers("x", dx, sx).alias("xs"), readers("y", dy, sy).alias("ys"))
                      for i, (dx, dy) in enumerate([(0, 0), *offsets])])
    sent = src.select(value, F.explode(looks).alias("o")).select(
        value, "o.s", F.explode("o.xs").alias("x"), F.col("o.ys").alias("ys")).select(value, "s", "x", F.explode("ys").alias("y"))
    pick = lambda i: F.max(F.when(F.col("s") == i, F.col(value)))
    got = sent.groupBy("x", "y").agg(F.max((F.col("s") == 0)).alias("own"), pick(0).alias(value),
                                     *[F.coalesce(pick(i + 1), F.lit(0.0)).alias(tap(o)) for i, o in enumerate(offsets)])
    return got.where("own").drop("own")


def tap(o: tuple[int, int]) -> str:
    sign = lambda d: f"m{-d}" if d < 0 else f"p{d}"
    return f"t{sign(o[0])}{sign(o[1])}"


def gradients(pixels: DataFrame, value: str, size: tuple[int, int], kinds: tuple[str, ...], h: float = 1.0) -> DataFrame:
    """One struct (gx, gy) per kind, all from one exchange of neighbours."""
    t = taps(pixels, value, RING if "rotation" in kinds else CARTESIAN, size)
    return t.select("x", "y", *[F.struct(*[c.alias(n) for n, c in zip(("gx", "gy"), _slopes(value, k, h))]).alias(k) for k in kinds])


def gradient(pixels: DataFrame, value: str, size: tuple[int, int], kind: str = "central", h: float = 1.0) -> DataFrame:
    """Slopes gx, gy; kinds central, forward, backward and rotation (diagonals included)."""
    return gradients(pixels, value, size, (kind,), h).select("x", "y", f"{kind}.gx", f"{kind}.gy")


def _slopes(value: str, kind: str, h: float) -> tuple[Column, Column]:
    at = lambda dx, dy: F.col(value) if (dx, dy) == (0, 0) else F.col(tap((dx, dy)))
    if kind == "central":
        gx, gy = (at(1, 0) - at(-1, 0)) * 0.5, (at(0, 1) - at(0, -1)) * 0.5
    elif kind == "forward":
        gx, gy = at(1, 0) - at(0, 0), at(0, 1) - at(0, 0)
    elif kind == "backward":
        gx, gy = at(0, 0) - at(-1, 0), at(0, 0) - at(0, -1)
    elif kind == "rotation":
        # weights that keep the response equal for all directions
        diag, axis = 0.25 * (2 - math.sqrt(2)), 0.5 * (math.sqrt(2) - 1)
        main, anti = (at(1, 1) - at(-1, -1)) * diag, (at(1, -1) - at(-1, 1)) * diag
        gx, gy = main + anti + (at(1, 0) - at(-1, 0)) * axis, main - anti + (at(0, 1) - at(0, -1)) * axis
    else:
        raise ValueError(f"no gradient {kind}")
    return gx / h, gy / h


# 3x3 and 5x5 Sobel kernels along x (rows by y).
SOBEL3 = [[-1, 0, 1], [-2, 0, 2], [-1, 0, 1]]
SOBEL5 = [[1, 2, 0, -2, -1], [4, 8, 0, -8, -4], [6, 12, 0, -12, -6], [4, 8, 0, -8, -4], [1, 2, 0, -2, -1]]


def window(pixels: DataFrame, value: str, size: tuple[int, int], kernels: dict[str, list[list[float]]]) -> DataFrame:
    """Weighted sums over square windows, several kernels in one pass."""
    r = len(next(iter(kernels.values()))) // 2
    offsets = [(dx, dy) for dy in range(-r, r + 1) for dx in range(-r, r + 1) if (dx, dy) != (0, 0)]
    t = taps(pixels, value, offsets, size)
    def total(k):
        terms = [(F.col(value) if (dx, dy) == (0, 0) else F.col(tap((dx, dy)))) * float(k[dy + r][dx + r])
                 for dy in range(-r, r + 1) for dx in range(-r, r + 1) if k[dy + r][dx + r]]
        return sum(terms[1:], terms[0])
    return t.select("x", "y", *[total(k).alias(n) for n, k in kernels.items()])


def sobel(pixels: DataFrame, value: str, size: tuple[int, int], width: int = 3) -> DataFrame:
    """Raw responses gx, gy and their length."""
    kx = SOBEL3 if width == 3 else SOBEL5
    ky = [[-kx[x][y] if width == 3 else -kx[x][y] for x in range(width)] for y in range(width)]
    return window(pixels, value, size, {"gx": kx, "gy": ky}).withColumn("gm", F.sqrt(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy")))


def sobel_standardised(pixels: DataFrame, value: str, size: tuple[int, int], width: int = 3) -> DataFrame:
    """Slopes centred and scaled to unit deviation, length scaled to a maximum of 1."""
    g = sobel(pixels, value, size, width)
    st = g.agg(*[f(c).alias(f"{c}_{n}") for c in ("gx", "gy") for n, f in (("a", F.avg), ("s", F.stddev_pop))], F.max("gm").alias("gm_x"))
    div = lambda c: F.when(F.col(c) < 1e-20, 1.0).otherwise(F.col(c))
    return g.join(F.broadcast(st)).select(
        "x", "y", *[((F.col(c) - F.col(f"{c}_a")) / div(f"{c}_s")).alias(c) for c in ("gx", "gy")], (F.col("gm") / div("gm_x")).alias("gm"))


def kernel(kind: str, r: int, s: float = 1.0, sharpen: float = 0.0) -> list[list[float]]:
    """Normalised r x r weights: gauss, flat, cone, or hat (negative ring, positive centre)."""
    c = r // 2
    dist = [[math.hypot(j - c, i - c) for j in range(r)] for i in range(r)]
    bell = [[math.exp(-((s * 4 * d / r) ** 2) / 2) for d in row] for row in dist]
    if kind == "gauss":
        k = bell
    elif kind == "flat":
        k = [[1.0] * r for _ in range(r)]
    elif kind == "cone":
        k = [[1 - d / r**s for d in row] for row in dist]
    elif kind == "hat":
        k = [[-g for g in row] for row in bell]
        k[c][c] = sum(map(sum, bell)) * sharpen + bell[c][c]
    else:
        raise ValueError(f"no kernel {kind}")
    total = sum(map(sum, k))
    return [[v / total for v in row] for row in k]


def resize(pixels: DataFrame, value: str, size: tuple[int, int], new: tuple[int, int]) -> DataFrame:
    """Bilinear resize; each source pixel sends its share to the targets that read it."""
    def readers(c: str, n: int, m: int) -> Column:
        scale = n / m
        lo = F.greatest(F.floor((F.col(c) - 1) / scale - 1), F.lit(0))
        hi = F.least(F.ceil((F.col(c) + 1.5) / scale + 1), F.lit(m - 1))
        # every target near the source: its two taps are clamped to the image
        def weight(t):
            p = F.greatest(F.least((t + 0.5) * scale - 0.5, F.lit(float(n - 1))), F.lit(0.0))
            f = F.floor(p)
            return F.when(f == F.col(c), F.lit(1.0) - (p - f)).when(f + 1 == F.col(c), p - f).otherwise(0.0)
        all_ = F.transform(F.sequence(lo, hi), lambda t: F.struct(t.alias("t"), weight(t).alias("w")))
        return F.filter(all_, lambda s: s["w"] > 0)
    df = pixels.select("x", "y", value, F.explode(readers("x", size[0], new[0])).alias("a")).select(
        "a", value, F.explode(readers("y", size[1], new[1])).alias("b"))
    return df.groupBy(F.col("a.t").alias("x"), F.col("b.t").alias("y")).agg(F.sum(F.col(value) * F.col("a.w") * F.col("b.w")).alias(value))


def pyramid(pixels: DataFrame, size: tuple[int, int], value: str, levels: int, a: float = 0.4) -> list[DataFrame]:
    """Gaussian levels of an image: the plane z = 0 of the grid pyramid without its z taps."""
    flat = pixels.select("x", "y", F.lit(0).cast("bigint").alias("z"), value)
    out, d = [flat], (*size, 1)
    w = {"x": Y.gauss5(a), "y": Y.gauss5(a), "z": {0: 1.0}}
    for _ in range(levels):
        out.append(Y.downsample(out[-1], d, [value], w))
        d = tuple((n + 1) // 2 for n in d)
    return [p.drop("z") for p in out]


# Fixed value: what Laplacian levels are multiplied by.
LAPLACIAN_SCALE = 1000.0


def _up_taps(c: Column, n_src: int, n_dst: int, w: dict[int, float]) -> Column:
    """Targets x that read coarse source c at (x + d)/2 for even x + d, clamped (|d| <= 2): array of (t, w)."""
    out = []
    for k in range(-max(w), -min(w) + 1):
        x = c * 2 + k
        low = 2.0 * sum(v for d, v in w.items() if (k + d) % 2 == 0 and k + d < 0)
        high = 2.0 * sum(v for d, v in w.items() if (k + d) % 2 == 0 and k + d > 0)
        weight = F.lit(2.0 * w.get(-k, 0.0))
        if low:
            weight = weight + F.when(c == 0, low).otherwise(0.0)
        if high:
            weight = weight + F.when(c == n_src - 1, high).otherwise(0.0)
        out.append(F.struct(x.alias("t"), F.when((x >= 0) & (x < n_dst), weight).otherwise(0.0).alias("w")))
    return F.array(*out)


def _expanded(coarse: DataFrame, value: str, size: tuple[int, int], a: float) -> DataFrame:
    """Weighted copies of a coarse level at the finer pixels that read it, not yet summed.

    A finer pixel reads a tap only where it lands on a coarse one, so the taps of a pixel sum to 1; reads
    beyond the border repeat it.
    """
    w = Y.gauss5(a)
    half = tuple((n + 1) // 2 for n in size)
    df = coarse.select("x", "y", value)
    for c, m, n in zip("xy", half, size):
        df = df.withColumn(f"__{c}", F.explode(_up_taps(F.col(c), m, n, w))).where(F.col(f"__{c}.w") != 0)
    return df.select(F.col("__x.t").alias("x"), F.col("__y.t").alias("y"), (F.col(value) * F.col("__x.w") * F.col("__y.w")).alias(value))


def expand(coarse: DataFrame, value: str, size: tuple[int, int], a: float = 0.4) -> DataFrame:
    """A pyramid level at the resolution of the next finer one, whose size is given."""
    return _expanded(coarse, value, size, a).groupBy("x", "y").agg(F.sum(value).alias(value))


def laplacian_pyramid(levels: list[DataFrame], size: tuple[int, int], value: str, a: float = 0.4, scale: float = LAPLACIAN_SCALE) -> list[DataFrame]:
    """Per level of a Gaussian pyramid what expanding the next coarser one misses, scaled; the coarsest itself, scaled."""
    out, n = [], size
    for fine, coarse in zip(levels, [*levels[1:], None]):
        own = fine.select("x", "y", (F.col(value) * scale).alias(value))
        if coarse is not None:
            less = _expanded(coarse, value, n, a).withColumn(value, F.col(value) * -scale)
            own = own.unionByName(less).groupBy("x", "y").agg(F.sum(value).alias(value))
        out.append(own)
        n = tuple((k + 1) // 2 for k in n)
    return out


def reconstruct(laplacians: list[DataFrame], size: tuple[int, int], value: str, a: float = 0.4, scale: float = LAPLACIAN_SCALE) -> DataFrame:
    """The image whose Laplacian pyramid this is: one expansion and sum per level, from the coarsest."""
    sizes = [size]
    for _ in laplacians[1:]:
        sizes.append(tuple((k + 1) // 2 for k in sizes[-1]))
    parts = [p.select("x", "y", (F.col(value) / scale).alias(value)) for p in laplacians]
    out = parts[-1]
    for own, n in zip(reversed(parts[:-1]), reversed(sizes[:-1])):
        out = own.unionByName(_expanded(out, value, n, a)).groupBy("x", "y").agg(F.sum(value).alias(value))
    return out


# --- moving windows -------------------------------------------------------------------

TILE = 128
"""Pixels along the edge of a tile."""
ROWS_AT_ONCE = 1 << 22
"""Window values that are laid out at once."""


def _sliding(kind: str) -> Callable[[np.ndarray, int], np.ndarray]:
    """Least or greatest value of every d x d window, one axis after the other."""
    pick = np.minimum if kind == "min" else np.maximum

    def run(a: np.ndarray, d: int) -> np.ndarray:
        for axis in (0, 1):
            n = a.shape[axis] - d + 1
            out = a.take(range(n), axis)
            for k in range(1, d):
                out = pick(out, a.take(range(k, k + n), axis))
            a = out
        return a
    return run


def _laid_out(fn: Callable[[np.ndarray], np.ndarray]) -> Callable[[np.ndarray, int], np.ndarray]:
    """``fn`` of every d x d window, given as rows of d * d values, some image rows at a time."""
    def run(a: np.ndarray, d: int) -> np.ndarray:
        view = np.lib.stride_tricks.sliding_window_view(a, (d, d))
        step = max(1, ROWS_AT_ONCE // (view.shape[1] * d * d))
        return np.concatenate([fn(view[i:i + step].reshape(-1, d * d)).reshape(-1, view.shape[1]) for i in range(0, len(view), step)])
    return run


def _ranked(share: float) -> Callable[[np.ndarray], np.ndarray]:
    """The value at a share of the sorted window; the mean of the two around it where it falls between."""
    def run(w: np.ndarray) -> np.ndarray:
        at = share * (w.shape[1] - 1)
        lo, hi = math.floor(at), math.ceil(at)
        part = np.partition(w, sorted({lo, hi}), axis=1)
        return part[:, lo] + (part[:, hi] - part[:, lo]) * (at - lo)
    return run


WINDOWS = {
    "min": _sliding("min"), "max": _sliding("max"), "median": _laid_out(_ranked(0.5)), "mean": _laid_out(lambda w: w.mean(axis=1)),
    "deviation": _laid_out(lambda w: w.std(axis=1)),
}


def rank_window(share: float) -> Callable[[np.ndarray, int], np.ndarray]:
    """Order statistic of a window: 0 the least, 1 the greatest value."""
    return _laid_out(_ranked(share))


def window_function(fn: Callable[[np.ndarray], np.ndarray]) -> Callable[[np.ndarray, int], np.ndarray]:
    """Any function of windows: (windows, d * d) values, row by row, to one value each."""
    return _laid_out(fn)


def moving(pixels: DataFrame, value: str, size: tuple[int, int], d: int, filters: dict[str, Callable[[np.ndarray, int], np.ndarray] | str], tile: int = TILE) -> DataFrame:
    """(x, y, one column per filter): each function of the d x d window around every stored pixel.

    The window starts d // 2 before the pixel and is moved, not cut, where it would leave the image, which
    must hold one.  Pixels that are not stored count as 0.  An image is dealt out in tiles; a pixel goes to the
    tiles whose windows reach it, so one exchange carries all filters and a task holds one tile.
    """
    nx, ny = size
    if d < 1 or d > min(nx, ny) or d > tile:
        raise ValueError("the window must fit the image and a tile")
    work = {n: WINDOWS[f] if isinstance(f, str) else f for n, f in filters.items()}

    def reach(k: Column, n: int) -> tuple[Column, Column]:
        start = lambda x: F.greatest(F.least(x - d // 2, F.lit(n - d)), F.lit(0))
        return start(k * tile), start(F.least((k + 1) * tile, F.lit(n)) - 1) + (d - 1)

    def tiles(c: str, n: int) -> Column:
        last = (n - 1) // tile
        own = F.floor(F.col(c) / tile).cast("int")
        near = F.sequence(F.greatest(own - 1, F.lit(0)), F.least(own + 1, F.lit(last)))
        return F.filter(near, lambda k: (reach(k, n)[0] <= F.col(c)) & (F.col(c) <= reach(k, n)[1]))

    sent = pixels.select("x", "y", F.col(value).cast("double").alias("v")).withColumn("tx", F.explode(tiles("x", nx))).withColumn("ty", F.explode(tiles("y", ny)))

    def bounds(t: int, n: int) -> tuple[int, int, int, np.ndarray]:
        lo, hi = t * tile, min((t + 1) * tile, n)
        first = np.clip(np.arange(lo, hi) - d // 2, 0, n - d)
        return lo, hi, int(first[0]), first - first[0]

    def run(t: pa.Table) -> pa.Table:
        x, y, v = (t.column(c).to_numpy() for c in ("x", "y", "v"))
        x0, x1, ax, ix = bounds(int(t.column("tx")[0].as_py()), nx)
        y0, y1, ay, iy = bounds(int(t.column("ty")[0].as_py()), ny)
        a = np.zeros((int(iy[-1]) + d, int(ix[-1]) + d))
        a[y - ay, x - ax] = v
        own = (x >= x0) & (x < x1) & (y >= y0) & (y < y1)
        at = iy[y[own] - y0], ix[x[own] - x0]
        return pa.table({"x": pa.array(x[own]), "y": pa.array(y[own]), **{n: pa.array(f(a, d)[at].astype(np.float64)) for n, f in work.items()}})

    cast = sent.select(F.col("x").cast("bigint").alias("x"), F.col("y").cast("bigint").alias("y"), "v", "tx", "ty")
    return cast.groupBy("tx", "ty").applyInArrow(run, "x bigint, y bigint, " + ", ".join(f"{n} double" for n in work))


def difference(a: DataFrame, b: DataFrame, values: list[str]) -> DataFrame:
    """Statistics of the summed component differences of two images."""
    other = b.select("x", "y", *[F.col(v).alias(f"__{v}") for v in values])
    d = sum((F.abs(F.col(v) - F.col(f"__{v}")) for v in values), F.lit(0.0))
    return a.join(other, ["x", "y"]).agg(*[e.alias(n) for n, e in C.moments(d).items()])
