"""Moving-window and recursive operators on ordered series.

A series is cut into chunks by position, a short one into a single chunk; each chunk
also receives the few rows before it that its first windows reach back to, so
chunks are independent tasks with exact results.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattica.operators import order as O


class Frame:
    """What a window formula may use: position, series head, row frames."""

    def __init__(self, parts: list[str], order: list[str], v: str, i: Column, resumed: bool = False):
        self._w = Window.partitionBy(*parts).orderBy(*order)
        self._all = Window.partitionBy(*parts)
        self.v = F.col(v)
        self.i = i + F.coalesce(F.col("__skip"), F.lit(0)) if resumed else i
        # only windows that reach before the series need the head, and those sit in its first chunk
        self.first = F.first(v).over(self._w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
        if resumed:
            self.first = F.coalesce(F.col("__head"), self.first)
        self.n = F.count("*").over(self._all)

    def back(self, d: int, upto: int = 0):
        return self._w.rowsBetween(-d, upto)

    def lag(self, k: int, c: Column | None = None) -> Column:
        return F.lag(self.v if c is None else c, k).over(self._w)


def moving(df: DataFrame, keys: list[str], order: list[str], v: str, reach: int,
           build: Callable[[Frame], dict[str, Column]], group_rows: int | None = None) -> DataFrame:
    """Add columns whose value at a row depends on it and at most ``reach`` rows before.

    Columns ``__skip`` and ``__head``, where present, say how many rows came before the
    first one given and what the very first value was.
    """
    resumed = "__skip" in df.columns
    limit = max(group_rows or O.GROUP_ROWS, reach + 1)
    cut = chunked(O.indexed(df, keys, order, group_rows), limit, reach)
    out = cut.withColumns(build(Frame([*keys, "__chunk"], ["i"], v, F.col("i"), resumed)))
    return out.where("__own").drop("__own", "__chunk")


def chunked(df: DataFrame, size: int, overlap: int) -> DataFrame:
    """Send each row to its chunk of ``size`` positions, and a chunk's tail to the next one too."""
    mine = F.floor(F.col("i") / size).cast("bigint")
    spill = F.lit(overlap > 0) & ((F.col("i") % size) >= size - overlap)
    fan = F.when(spill, F.array(mine, mine + 1)).otherwise(F.array(mine))
    return df.withColumn("__chunk", F.explode(fan)).withColumn("__own", F.col("__chunk") == mine)


def _padded_sum(f: Frame, c: Column, head: Column, d: Column | int, width: int) -> Column:
    """Sum of the last d values, the missing ones replaced by the head."""
    d = F.lit(d) if isinstance(d, int) else d
    missing = F.greatest(d - (f.i + 1), F.lit(0))
    return F.sum(c).over(f.back(width - 1)) + missing * head


def moving_average(d: int, fixed: bool = False):
    """Mean of the last d values; unless ``fixed``, a shorter series lowers d to its length."""
    def build(f: Frame) -> dict[str, Column]:
        w = F.lit(d) if fixed else F.least(f.n, F.lit(d))
        return {"ma": _padded_sum(f, f.v, f.first, w, d) / w}
    return d - 1, build


def moving_deviation(d: int):
    def build(f: Frame) -> dict[str, Column]:
        m = _padded_sum(f, f.v, f.first, d, d) / d
        q = _padded_sum(f, f.v * f.v, f.first * f.first, d, d) / d
        return {"dev": F.sqrt(F.abs(q - m * m))}
    return d - 1, build


def moving_median(d: int):
    def build(f: Frame) -> dict[str, Column]:
        s = F.array_sort(F.collect_list(f.v).over(f.back(d - 1)))
        k = F.size(s)
        at = lambda p: F.element_at(s, (F.floor(p) + 1).cast("int"))
        return {"med": (at((k - 1) / 2) + at(k / 2)) / 2}
    return d - 1, build


def moving_rise(d: int, sign: int):
    """Sum of the rises (sign=1) or falls (sign=-1) over the last d steps."""
    def build(f: Frame) -> dict[str, Column]:
        # d + 1 values hold the last d steps; each step pairs a value with its predecessor
        vs = F.collect_list(f.v).over(f.back(d))
        k = F.size(vs)
        steps = F.zip_with(F.slice(vs, F.lit(2), k - 1), F.slice(vs, F.lit(1), k - 1),
                           lambda now, was: F.greatest((now - was) * sign, F.lit(0.0)))
        return {"rise": F.aggregate(steps, F.lit(0.0), lambda a, x: a + x)}
    return d, build


def momentum(d: int, log: bool):
    """Difference to the value d rows back, or the logarithm of the ratio; a ratio that is none or not positive has null."""
    def build(f: Frame) -> dict[str, Column]:
        past = F.coalesce(f.lag(d), f.first)
        return {"mom": F.ln(F.try_divide(f.v, past)) if log else f.v - past}
    return d, build


def trend_strength(d: int):
    """Share of later-above-earlier pairs minus the rest, over the last d values."""
    def build(f: Frame) -> dict[str, Column]:
        vs = F.collect_list(f.v).over(f.back(d - 1))
        k = F.size(vs)
        above = F.transform(vs, lambda x, j: F.size(F.filter(vs, lambda y, q: (q > j) & (y > x))))
        up = F.aggregate(above, F.lit(0), lambda a, x: a + x)
        pairs = k * (k - 1) / 2
        return {"tau": F.try_divide(up * 2 - pairs, pairs)}
    return d - 1, build


def windowed_decay(d: int, beta: float):
    """Decaying mean over the last d values, padded by the head, weights normalised."""
    norm = sum(beta**k for k in range(d))

    def build(f: Frame) -> dict[str, Column]:
        vs = F.collect_list(f.v).over(f.back(d - 1))
        known = F.aggregate(vs, F.lit(0.0), lambda a, x: a * beta + x)
        weights = F.array(*[F.lit(sum(beta**k for k in range(m, d))) for m in range(1, d + 1)])
        pad = F.element_at(weights, F.size(vs))
        return {"dma": (known + pad * f.first) / norm}
    return d - 1, build


def detrended(df: DataFrame, keys: list[str], order: list[str], v: str, d: int,
              group_rows: int | None = None) -> DataFrame:
    """Value over its mean magnitude; a zero mean borrows the next non-zero one, wrapping round."""
    src = df.withColumn("__abs", F.abs(v))
    reach, build = moving_average(d)
    ma = moving(src, keys, order, "__abs", reach, build, group_rows)
    usable = F.col("ma") >= 1e-20
    # walking backwards, the latest usable mean seen is the next one going forwards
    rev = ma.withColumn("__r", -F.col("i"))
    seen = F.when(usable, F.struct(F.col("__r").alias("r"), F.col("ma").alias("m")))
    rev = O.running(rev, keys, ["__r"], {}, maxima={"__next": seen}, group_rows=group_rows)
    heads = ma.where(usable).groupBy(*keys).agg(F.min_by("ma", "i").alias("__wrap"))
    out = O.join_on(rev, heads, keys, "left")
    scale = F.when(usable, F.col("ma")).otherwise(F.coalesce(F.col("__next.m"), F.col("__wrap")))
    return out.withColumn("det", F.try_divide(F.col(v), scale)).drop("__abs", "__r", "__next", "__wrap")


# --- exponential average: a linear recursion, cut into chunks and stitched ---------

def decay_scan(b: np.ndarray, beta: float) -> np.ndarray:
    """y[i] = beta*y[i-1] + b[i] by doubling: log2(n) vector passes."""
    y = b.astype(np.float64).copy()
    step, f = 1, beta
    while step < len(y) and f != 0.0:
        y[step:] += f * y[:-step].copy()
        step, f = step * 2, f * f
    return y


def exponential_average(df: DataFrame, keys: list[str], order: list[str], v: str, beta: float,
                        group_rows: int | None = None) -> DataFrame:
    """y0 = x0, then beta*y + (1-beta)*x; a negative beta gives a span instead, 1 keeps the first value."""
    if beta < 0:
        beta = 1.0 - 2.0 / (-beta + 1.0)
    if beta > 1:
        raise ValueError("beta must not exceed 1")
    chunk = min(group_rows or 65536, 65536)
    at = O.indexed(df, keys, order, group_rows=group_rows)
    at = at.withColumn("__chunk", F.floor(F.col("i") / chunk).cast("bigint"))
    laid = at.repartition(*keys, "__chunk").sortWithinPartitions(*keys, "__chunk", "i")
    fields = T.StructType([*laid.schema.fields, T.StructField("__y", T.DoubleType())])
    local = laid.mapInPandas(_scan_partition(keys, v, beta), fields)
    ends = local.groupBy(*keys, "__chunk").agg(F.max_by("__y", "i").alias("__end"))
    # what enters a chunk: a scan over the ends of earlier ones, each faded by the chunks between
    fields = T.StructType([*[ends.schema[k] for k in keys], T.StructField("__chunk", T.LongType()), T.StructField("__carry", T.DoubleType())])
    several = ends.withColumn("__last", F.max("__chunk").over(Window.partitionBy(*keys))).where("__last > 0").drop("__last")
    carry = several.groupBy(*keys).applyInPandas(_carry_over(keys, beta**chunk), fields)
    out = O.join_on(local, carry, [*keys, "__chunk"], "left").fillna(0.0, ["__carry"])
    k = (F.col("i") % chunk) + 1
    return out.withColumn("ema", F.col("__y") + F.col("__carry") * F.pow(F.lit(beta), k)).drop("__y", "__carry", "__chunk")


def _carry_over(keys: list[str], fade: float):
    """One row per 65,536 values of a series comes in."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("__chunk")
        y = decay_scan(pdf["__end"].to_numpy(np.float64), fade)
        return pdf[[*keys, "__chunk"]].assign(__carry=np.r_[0.0, y[:-1]])
    return run


def _scan_partition(keys: list[str], v: str, beta: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, y_last = None, 0.0
        for pdf in batches:
            if pdf.empty:
                continue
            tag = pdf[[*keys, "__chunk"]]
            past = tag.shift()
            change = ~((tag == past) | (tag.isna() & past.isna())).all(axis=1).to_numpy()
            change[0] = True
            x = pdf[v].to_numpy(np.float64)
            b = np.where(pdf["i"].to_numpy() == 0, x, (1.0 - beta) * x)
            y = np.empty(len(x))
            starts = np.flatnonzero(change)
            for s, e in zip(starts, [*starts[1:], len(x)]):
                seg = b[s:e].copy()
                if s == 0 and last is not None and all(a == b or (pd.isna(a) and pd.isna(b)) for a, b in zip(last, tag.iloc[0])):
                    seg[0] += beta * y_last
                y[s:e] = decay_scan(seg, beta)
            last, y_last = tuple(tag.iloc[-1]), y[-1]
            yield pdf.assign(__y=y)
    return run


# --- whole-series measures -----------------------------------------------------------

def monotony(df: DataFrame, keys: list[str], order: list[str], v: str, group_rows: int | None = None) -> DataFrame:
    """Share of the total that lies below the running peak, and its valleys."""
    one = F.lit(1).cast("bigint")
    at = O.running(df, keys, order, {"i": one}, maxima={"peak": F.col(v)}, totals={"n": one}, group_rows=group_rows)
    low = F.coalesce((F.col(v) < F.col("peak")) & (F.col("i") < F.col("n") - 1), F.lit(False))
    at = at.withColumn("low", low)
    isl = O.running(at, keys, ["i"], {"isle": (~F.col("low")).cast("bigint")}, group_rows=group_rows)
    # one row per valley, one for all the rest; partial sums combine before the shuffle
    valley = isl.groupBy(*keys, F.when(F.col("low"), F.col("isle")).alias("isle")).agg(
        F.sum(v).alias("s"), F.bool_or("low").alias("low"))
    below = F.when(F.col("low"), F.col("s"))
    return valley.groupBy(*keys).agg(
        F.sum("s").alias("total"), F.coalesce(F.sum(below), F.lit(0.0)).alias("below"),
        F.count(below).alias("n_valleys"), F.max(below).alias("deepest"),
    ).select(*keys, (F.col("below") / F.col("total")).alias("monotony"), "n_valleys",
             (F.col("deepest") / F.col("total")).alias("max_share"))


def thin(df: DataFrame, keys: list[str], order: list[str], d: int, group_rows: int | None = None) -> DataFrame:
    """Every d-th row, the last of each full stretch of d."""
    at = O.indexed(df, keys, order, group_rows)
    return at.where(F.col("i") % d == d - 1).withColumn("i", F.floor(F.col("i") / d).cast("bigint"))


def rising_pairs(v: np.ndarray, group: np.ndarray | None = None, n_groups: int = 1) -> np.ndarray:
    """Per group 0..n_groups-1, the pairs i<j inside it with v[i] < v[j]; rows of a group lie in order.

    Ranks are split bit by bit, n log n vector work for all groups together: later groups rank lower,
    so a pair across groups never rises.
    """
    if group is None:
        group = np.zeros(len(v), np.int64)
    total = np.zeros(n_groups)
    if len(v) < 2:
        return total
    place = np.argsort(group, kind="stable")
    v, group = np.asarray(v)[place], group[place]
    order = np.lexsort((v, -group))
    new = np.r_[False, (v[order[1:]] != v[order[:-1]]) | (group[order[1:]] != group[order[:-1]])]
    rank = np.empty(len(v), np.int64)
    rank[order] = np.cumsum(new)
    at = np.arange(len(rank))
    for b in range(int(rank.max()).bit_length() - 1, -1, -1):
        r = rank[at]
        high, one = r >> (b + 1), (r >> b) & 1
        zeros = np.cumsum(1 - one)
        start = np.r_[True, high[1:] != high[:-1]]
        base = np.maximum.accumulate(np.where(start, zeros - (1 - one), 0))
        total += np.bincount(group[at], (zeros - base) * one, n_groups)
        at = at[np.argsort(high * 2 + one, kind="stable")]
    return total


def trend(df: DataFrame, keys: list[str], order: list[str], v: str, group_rows: int | None = None,
          chunk: int = 1 << 18) -> DataFrame:
    """Share of pairs that rise minus the share that does not, over each whole series.

    Pairs are never formed.  Rows get a time chunk and a value bin, both of bounded
    size.  Pairs inside one chunk or one bin are counted by sorting that small
    group; all others follow from counts on the (chunk, bin) lattice.
    """
    if group_rows:
        chunk = min(chunk, group_rows)
    one = F.lit(1).cast("bigint")
    at = O.running(df.select(*keys, *order, F.col(v).alias("v")), keys, order, {"i": one}, totals={"n": one}, group_rows=group_rows)
    at = at.withColumn("c", F.floor(F.col("i") / chunk).cast("bigint"))
    sizes = at.groupBy(*keys).agg(F.max("n").alias("n"))
    up = _count_rising(at, keys, ["c"], split=None)
    at = at.where(F.col("n") > chunk)  # pairs across chunks exist only where there are several
    heavy = (F.col("c") >= chunk).cast("bigint")
    # a value with a whole chunk of copies gets a bin of its own, next in order
    bins = O.ranked_values(at.drop("c", "n"), keys, "v", group_rows).select(
        *keys, "v", (F.floor(F.col("start") / chunk) * 2 + heavy).cast("bigint").alias("b"), (heavy == 1).alias("single"))
    binned = O.join_on(at, bins, [*keys, "v"])
    up = up.unionByName(_count_rising(binned.where("not single"), keys, ["b"], split="c"))
    up = up.unionByName(_lattice_rising(binned, keys))
    pairs = F.col("n").cast("double") * (F.col("n") - 1) / 2
    total = up.groupBy(*keys).agg(F.sum("up").alias("up"))
    return O.join_on(sizes, total, keys).select(*keys, "n", F.try_divide(F.col("up") * 2 - pairs, pairs).alias("tau"))


AT_ONCE = 1 << 20
"""Rows whose pairs are counted in one call."""


def _count_rising(rows: DataFrame, keys: list[str], by: list[str], split: str | None) -> DataFrame:
    """Rising pairs inside each bounded group, many groups a call; with ``split``, only pairs across its values."""
    cells = F.collect_list(F.struct("i", F.col("v").cast("double").alias("v"), *([F.col(split).alias("split")] if split else [])))
    lists = rows.groupBy(*keys, *by).agg(cells.alias("cells")).select(*keys, "cells")
    out = T.StructType([*[rows.schema[k] for k in keys], T.StructField("up", T.DoubleType())])

    def run(batches):
        for whole in batches:
            ends = np.cumsum(whole.column(len(keys)).value_lengths().to_numpy())
            first = 0
            while first < whole.num_rows:
                done = int(ends[first - 1]) if first else 0
                last = max(first + 1, int(np.searchsorted(ends, done + AT_ONCE, "right")))
                b = whole.slice(first, last - first)
                col = b.column(len(keys))
                group = np.repeat(np.arange(b.num_rows), col.value_lengths().to_numpy())
                flat = col.flatten()
                i, v = (flat.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
                order = np.lexsort((i, group))
                up = rising_pairs(v[order], group[order], b.num_rows)
                if split:
                    both = np.unique(np.stack([group, flat.field(2).to_numpy()]), axis=1, return_inverse=True)
                    inside = rising_pairs(v[order], both[1].reshape(-1)[order], both[0].shape[1])
                    up -= np.bincount(both[0][0], inside, b.num_rows)
                yield pa.RecordBatch.from_arrays([*b.columns[:len(keys)], pa.array(up)], names=[*keys, "up"])
                first = last

    return lists.mapInArrow(run, out)


def _lattice_rising(binned: DataFrame, keys: list[str]) -> DataFrame:
    """Rising pairs that differ in both chunk and bin, from lattice counts alone."""
    counts = binned.groupBy(*keys, "c", "b").agg(F.count("*").cast("double").alias("m"))
    axis = lambda a: counts.select(*keys, a).distinct()
    full = O.join_on(axis("c"), axis("b"), keys) if keys else axis("c").crossJoin(axis("b"))  # per key: chunks x bins, no more than rows
    full = O.join_on(full, counts, [*keys, "c", "b"], "left").fillna(0.0, ["m"])
    earlier = lambda part, o: Window.partitionBy(*keys, part).orderBy(o).rowsBetween(Window.unboundedPreceding, -1)
    below = full.withColumn("p", F.coalesce(F.sum("m").over(earlier("c", "b")), F.lit(0.0)))
    both = below.withColumn("d", F.coalesce(F.sum("p").over(earlier("b", "c")), F.lit(0.0)))
    return both.groupBy(*keys).agg(F.sum(F.col("m") * F.col("d")).alias("up"))
