"""Statistics of samples: moments, histograms, empirical distributions, covariances."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.functions.dist import SQRT_2PI, gauss_kernel
from lattica.operators import order as O
from lattica.operators.channels import moments

HIST_EPS = 1e-20


def join_groups(df: DataFrame, per_group: DataFrame, keys: list[str]) -> DataFrame:
    """Attach per-group values, null groups included; without keys there is exactly one row to attach."""
    return O.join_on(df, per_group, keys)


def sample_stat(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    return df.groupBy(*keys).agg(*[c.alias(n) for n, c in moments(F.col(value)).items()])


def correlation(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Pearson correlation with the line y = alpha1 + alpha2 * x."""
    return df.groupBy(*keys).agg(
        F.count("*").alias("n"), F.corr(x, y).alias("r"), F.regr_intercept(y, x).alias("alpha1"), F.regr_slope(y, x).alias("alpha2"))


def semi_deviation(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Root mean square distance below the mean, over the values below it."""
    mean = df.groupBy(*keys).agg(F.avg(value).alias("__m"))
    d = F.col(value) - F.col("__m")
    return join_groups(df, mean, keys).where(d < 0).groupBy(*keys).agg(F.sqrt(F.sum(d * d) / F.count("*")).alias("semidev"))


# --- histograms --------------------------------------------------------------

def histogram(df: DataFrame, keys: list[str], value: str, nb: int, lo: float, hi: float, standardise: bool = False,
              eps: float = 0.0) -> DataFrame:
    """Density per bin; values outside fall into the end bins. All ``nb`` bins appear."""
    x = F.col(value).cast("double")
    if standardise:
        m = df.groupBy(*keys).agg(F.avg(value).alias("__m"), F.stddev_pop(value).alias("__s"))
        df = join_groups(df, m, keys)
        x = (x - F.col("__m")) / F.col("__s")
    dx = (hi - lo) / nb
    b = F.greatest(F.least(F.floor((x - lo) / dx), F.lit(nb - 1)), F.lit(0)).cast("int")
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, b.alias("bin")).agg(F.count("*").alias("c"))
    # nb is a parameter, so a group's histogram is one small row
    packed = counts.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("bin", "c"))).alias("m"), F.sum("c").alias("n"))
    dens = F.transform(F.sequence(F.lit(0), F.lit(nb - 1)),
                       lambda i: (F.coalesce(F.try_element_at(F.col("m"), i), F.lit(0)) + F.lit(eps)) / (F.col("n") * dx))
    return packed.select(*keys, "n", dens.alias("bins"))


def explode_bins(hist: DataFrame, keys: list[str], lo: float, dx: float) -> DataFrame:
    return hist.select(*keys, F.posexplode("bins").alias("bin", "density")).withColumn("left", F.col("bin") * dx + lo)


def hist_percentile(bins: Column, perc: float, lo: float, hi: float, nb: int) -> Column:
    """Left edge of the first bin whose running density passes perc * nb."""
    dx = (hi - lo) / nb
    run = F.aggregate(
        bins, F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("i"), F.lit(False).alias("done")),
        lambda a, d: F.struct((a["s"] + d).alias("s"),
                              F.when(a["done"] | (a["s"] + d > perc * nb), a["i"]).otherwise(a["i"] + 1).alias("i"),
                              (a["done"] | (a["s"] + d > perc * nb)).alias("done")),
        lambda a: a["i"])
    return run * dx + lo


def smooth_in_place(r: int, sigma: float) -> Callable[[Column], Column]:
    """Kernel smoothing left to right; bins already passed enter smoothed, outside is zero."""
    w = np.exp(-((np.abs(np.arange(2 * r + 1) - r) / r) ** 2) / (2 * sigma * sigma))
    w = w / w.sum()

    @F.pandas_udf("array<double>")
    def smooth(bins: pd.Series) -> pd.Series:
        m = np.stack([np.asarray(b, dtype=np.float64) for b in bins]) if len(bins) else np.zeros((0, 0))
        nb = m.shape[1]
        rr = min(r, nb // 2)
        pad = np.pad(m, ((0, 0), (rr, rr)))
        for i in range(nb):
            pad[:, i + rr] = pad[:, i:i + 2 * rr + 1] @ w
        return pd.Series(list(pad[:, rr:rr + nb]))

    return smooth


def hist_distances(p: Column, q: Column, eps: float) -> dict[str, Column]:
    """Symmetric divergence, squared and largest differences of the running sums."""
    fill = lambda c: F.when(c < HIST_EPS, F.lit(eps)).otherwise(c)
    div = F.aggregate(F.zip_with(p, q, lambda f, g: fill(f) * F.ln(fill(f) / fill(g)) + fill(g) * F.ln(fill(g) / fill(f))),
                      F.lit(0.0), lambda a, x: a + x)
    diff = F.zip_with(p, q, lambda f, g: f - g)
    acc = F.aggregate(diff, F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("sq"), F.lit(0.0).alias("mx")),
                      lambda a, d: F.struct((a["s"] + d).alias("s"), (a["sq"] + (a["s"] + d) * (a["s"] + d)).alias("sq"),
                                            F.greatest(a["mx"], F.abs(a["s"] + d)).alias("mx")))
    return {"jdiv": div, "cvm": acc["sq"], "ks": acc["mx"]}


def function_histogram(df: DataFrame, fn: Callable[[Column], Column], nb: int, lo: float, hi: float, eps: float = 0.0) -> DataFrame:
    """Bins of a given density evaluated at bin centres, normalised to sum 1; one array per row."""
    dx = (hi - lo) / nb
    raw = F.transform(F.sequence(F.lit(0), F.lit(nb - 1)), lambda i: fn(i * dx + (lo + dx / 2)))
    raw = F.transform(raw, lambda f: F.when(F.abs(f) < HIST_EPS, F.lit(eps)).otherwise(f))
    total = F.aggregate(raw, F.lit(0.0), lambda a, x: a + x)
    return df.withColumn("model", F.transform(raw, lambda f: f / total))


# --- empirical distributions ----------------------------------------------------

def compare_samples(df: DataFrame, keys: list[str], value: str, is_first: Column, squared: bool = False,
                    group_rows: int | None = None) -> DataFrame:
    """Area between two empirical distribution functions, and their largest gap."""
    counts = O.value_counts(df.withColumn("__a", is_first.cast("bigint")), keys, value, {"a": F.sum("__a")})
    b = F.col("c") - F.col("a")
    r = O.running(counts, keys, [value], {"pa": F.col("a"), "pb": b}, maxima={"prev": F.col(value)},
                  totals={"na": F.col("a"), "nb": b}, group_rows=group_rows)
    gap = F.abs(F.col("pa") / F.col("na") - F.col("pb") / F.col("nb"))
    step = F.col(value) - F.coalesce(F.col("prev"), F.col(value))
    area = F.sum(gap * step) if not squared else F.sqrt(F.sum(gap * step * gap * step))
    return r.groupBy(*keys).agg(area.alias("area"), F.max(F.when(step > 1e-20, gap).otherwise(0.0)).alias("ks"))


def compare_binned(df: DataFrame, keys: list[str], bin_: Column, is_first: Column, nb: int, relative: bool) -> DataFrame:
    """The same on fixed integer bins: root of summed squares and largest gap of the running counts."""
    c = df.groupBy(*keys, F.greatest(bin_, F.lit(0)).cast("int").alias("bin")).agg(
        F.count_if(is_first).alias("a"), F.count_if(~is_first).alias("b"))
    kept = F.when(F.col("bin") < nb, F.struct("bin", F.struct("a", "b")))
    packed = c.groupBy(*keys).agg(F.map_from_entries(F.collect_list(kept)).alias("m"), F.sum("a").alias("na"), F.sum("b").alias("nb_"))
    na = F.col("na").cast("double") if relative else F.lit(1.0)
    nb2 = F.col("nb_").cast("double") if relative else F.lit(1.0)
    diff = F.transform(F.sequence(F.lit(0), F.lit(nb - 1)),
                       lambda i: F.coalesce(F.try_element_at(F.col("m"), i)["a"] / na - F.try_element_at(F.col("m"), i)["b"] / nb2, F.lit(0.0)))
    acc = F.aggregate(diff, F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("sq"), F.lit(0.0).alias("mx")),
                      lambda a, d: F.struct((a["s"] + d).alias("s"), (a["sq"] + (a["s"] + d) * (a["s"] + d)).alias("sq"),
                                            F.greatest(a["mx"], F.abs(a["s"] + d)).alias("mx")))
    return packed.select(*keys, F.sqrt(acc["sq"]).alias("cvm"), acc["mx"].alias("ks"))


def inverse_cdf(df: DataFrame, keys: list[str], value: str, us: list[float], mode: str = "linear",
                bounds: tuple[float, float] | None = None, group_rows: int | None = None, draws: list[float] | None = None) -> DataFrame:
    """Sample quantiles at each u.

    ``linear`` interpolates between order statistics and runs straight to the bounds
    outside; ``log`` has logarithmic tails; ``raw`` picks an order statistic; ``kde`` moves that
    one by a kernel width times the standard normal draw given for each u.
    Without bounds the tails extend by the mean spacing of the outer quarter.
    """
    n = F.col("n")
    if mode == "raw":
        pos = [F.least(F.floor(n * u), n - 1) for u in us]
        return O.kth(df, keys, value, pos, group_rows).select(*keys, F.element_at(F.array(*map(F.lit, us)), F.col("q") + 1).alias("u"), F.col(value).alias("x"))
    if mode == "kde":
        spread = df.groupBy(*keys).agg(F.stddev_pop(value).alias("__sd"))
        pos = [F.floor(n * 0.25), F.floor(n * 0.75)] + [F.least(F.floor(n * u), n - 1) for u in us]
        got = O.kth(df, keys, value, pos, group_rows)
        row = got.groupBy(*keys).agg(F.max("n").alias("n"), F.map_from_entries(F.collect_list(F.struct("q", value))).alias("s"))
        row = join_groups(row, spread, keys)
        range_ = F.element_at(F.col("s"), F.lit(1)) - F.element_at(F.col("s"), F.lit(0))
        width = F.least("__sd", range_ / 1.34) * F.pow(F.col("n"), F.lit(-0.2)) * (0.776 * 1.364)
        at = F.array(*[F.struct(F.lit(float(u)).alias("u"), F.lit(i + 2).alias("q"), F.lit(float(z)).alias("z")) for i, (u, z) in enumerate(zip(us, draws))])
        out = row.withColumn("__w", width).select("*", F.explode(at).alias("__d"))
        return out.select(*keys, F.col("__d.u").alias("u"), (F.element_at(F.col("s"), F.col("__d.q")) + F.col("__w") * F.col("__d.z")).alias("x"))
    quarter = F.greatest(F.floor(n * 0.25), F.lit(2))
    ends = [F.lit(0), quarter - 1, n - quarter, n - 1]
    low = [F.greatest(F.floor((n + 1) * u), F.lit(1)) - 1 for u in us]
    high = [F.least(F.floor((n + 1) * u), n - 1) for u in us]
    got = O.kth(df, keys, value, ends + low + high, group_rows)
    row = got.groupBy(*keys).agg(F.max("n").alias("n"), F.map_from_entries(F.collect_list(F.struct("q", value))).alias("s"))
    at = lambda q: F.element_at(F.col("s"), q)
    alpha_l = (at(F.lit(1)) - at(F.lit(0))) / (quarter - 1)
    alpha_r = (at(F.lit(3)) - at(F.lit(2))) / (quarter - 1)
    x_min = F.lit(bounds[0]) if bounds else at(F.lit(0)) - alpha_l
    x_max = F.lit(bounds[1]) if bounds else at(F.lit(3)) + alpha_r
    out = row.select("*", F.posexplode(F.array(*[F.lit(float(u)) for u in us])).alias("k", "u"))
    y = F.col("u") * (n + 1)
    j = F.floor(y)
    s_lo, s_hi = at(F.col("k") + 4), at(F.col("k") + 4 + len(us))
    middle = s_lo + (s_hi - s_lo) * (y - j)
    if mode == "log":
        left = at(F.lit(0)) + alpha_l * F.ln(F.when(j < 1, y))
        right = at(F.lit(3)) - alpha_r * F.ln(F.when(j >= n, F.lit(1.0) - (y - n)))
    else:
        left = x_min + (at(F.lit(0)) - x_min) * (y - j)
        right = at(F.lit(3)) + (x_max - at(F.lit(3))) * (y - j)
    return out.select(*keys, "u", F.when(j < 1, left).when(j >= n, right).otherwise(middle).alias("x"))


def kernel_density(df: DataFrame, keys: list[str], value: str, xs: list[float], h: float | None = None, bw: float = 1.0) -> DataFrame:
    """Gaussian kernel density at given points, one pass, no pairing of rows.

    Without ``h`` the bandwidth is 1.06 * deviation * n^(-1/5) * bw per group.
    """
    v = F.col(value)
    if h is None:
        st = df.groupBy(*keys).agg((F.stddev_pop(value) * 1.06 / F.pow(F.count("*"), F.lit(0.2)) * bw).alias("__h"))
        df = join_groups(df, st, keys)
        width = F.col("__h")
    else:
        width = F.lit(float(h))
    sums = [F.sum(gauss_kernel((F.lit(float(x)) - v) / width)).alias(f"__k{i}") for i, x in enumerate(xs)]
    g = df.groupBy(*keys).agg(F.count("*").alias("n"), F.max(width).alias("h"), *sums)
    pts = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.col(f"__k{i}").alias("s")) for i, x in enumerate(xs)])
    return g.select(*keys, "n", "h", F.explode(pts).alias("p")).select(
        *keys, F.col("p.x").alias("x"), (F.col("p.s") / (F.col("n") * F.col("h"))).alias("density"))


def vector_density(df: DataFrame, vec: str, at: list[list[float]], h: float) -> DataFrame:
    """Gaussian window estimate and nearest-sample estimate at given vectors."""
    def d2(q: list[float]) -> Column:
        ref = F.array(*[F.lit(float(t)) for t in q])
        return F.aggregate(F.zip_with(F.col(vec), ref, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, t: s + t)

    aggs = []
    for i, q in enumerate(at):
        aggs += [F.avg(F.exp(-d2(q) / (2 * h * h)) / SQRT_2PI).alias(f"w{i}"), F.min(F.sqrt(d2(q))).alias(f"m{i}")]
    row = df.agg(*aggs)
    pts = F.array(*[F.struct(F.lit(i).alias("q"), F.col(f"w{i}").alias("parzen"), F.try_divide(F.lit(1.0), F.col(f"m{i}")).alias("nearest"))
                    for i in range(len(at))])
    return row.select(F.explode(pts).alias("p")).select("p.*")


def nearest(df: DataFrame, vec: str, ids: list[str], at: list[list[float]], k: int) -> DataFrame:
    """k nearest samples of each given vector; each task keeps only its own best k."""
    ref = F.array(*[F.struct(F.lit(i).alias("q"), F.array(*[F.lit(float(t)) for t in q]).alias("p")) for i, q in enumerate(at)])
    d = F.aggregate(F.zip_with(F.col(vec), F.col("r.p"), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, t: s + t)
    cand = df.select(*ids, vec, F.explode(ref).alias("r")).select(*ids, F.col("r.q").alias("q"), F.sqrt(d).alias("dist"))
    w = Window.partitionBy("q").orderBy("dist", *ids)
    # the row_number filter is pushed below the shuffle as a per-task group limit
    return cand.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


QUERY_ROWS = 4096
"""Query vectors that one pass over the samples carries along."""


def _query_blocks(queries: DataFrame, q: str, vec: str):
    """Blocks of bounded size as broadcast (ids, matrix)."""
    rows = queries.select(F.col(q).cast("bigint").alias("q"), F.col(vec).cast("array<double>").alias("p")).where("q is not null and p is not null")
    n = max(1, -(-rows.count() // QUERY_ROWS))
    for b in range(n):
        got = rows.where(F.pmod(F.xxhash64("q"), F.lit(n)) == b).orderBy("q").collect()
        if got:
            yield queries.sparkSession.sparkContext.broadcast((np.array([r.q for r in got]), np.array([r.p for r in got])))


def _distances(x: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Squared distances (queries, samples), summed in the order of the components."""
    out = np.zeros((len(p), len(x)))
    for j in range(x.shape[1]):
        out += (p[:, j:j + 1] - x[None, :, j]) ** 2
    return out


def _matrix(lists: pa.Array) -> np.ndarray:
    sizes = np.asarray(lists.value_lengths())
    if lists.null_count or (len(sizes) and (sizes != sizes[0]).any()):
        raise ValueError("vectors must be present and of one length")
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), -1)


def nearest_table(df: DataFrame, vec: str, id_: str, queries: DataFrame, q: str, q_vec: str, k: int) -> DataFrame:
    """(q, id, dist, rank): the k nearest samples of each row of a query table.

    Queries travel in blocks; a task answers each with its own best k, ties by id, before
    anything is shuffled.
    """
    def run(shipped):
        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, p = shipped.value
            best_d, best_i = np.full((len(p), 0), 0.0), np.full((len(p), 0), 0, np.int64)
            for b in batches:
                for at in range(0, b.num_rows, 1024):
                    part = b.slice(at, 1024)
                    d = np.sqrt(_distances(_matrix(part.column(1)), p))
                    i = np.broadcast_to(part.column(0).to_numpy(zero_copy_only=False), d.shape)
                    d, i = np.concatenate([best_d, d], axis=1), np.concatenate([best_i, i], axis=1)
                    order = np.lexsort((i, d), axis=1)[:, :k]
                    best_d, best_i = np.take_along_axis(d, order, 1), np.take_along_axis(i, order, 1)
            m = best_d.shape[1]
            yield pa.record_batch({"q": pa.array(np.repeat(names, m)), "id": pa.array(best_i.ravel()), "dist": pa.array(best_d.ravel())})
        return task

    src = df.select(F.col(id_).cast("bigint"), F.col(vec).cast("array<double>"))
    parts = [src.mapInArrow(run(s), "q bigint, id bigint, dist double") for s in _query_blocks(queries, q, q_vec)]
    if not parts:
        return df.sparkSession.createDataFrame([], "q bigint, id bigint, dist double, rank int")
    w = Window.partitionBy("q").orderBy("dist", "id")  # at most k rows per task and query
    both = reduce(DataFrame.unionByName, parts)
    return both.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def density_table(df: DataFrame, vec: str, queries: DataFrame, q: str, q_vec: str, h: float) -> DataFrame:
    """(q, parzen, nearest): Gaussian window and nearest-sample estimates at each row of a query table."""
    def run(shipped):
        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, p = shipped.value
            total, least, n = np.zeros(len(p)), np.full(len(p), np.inf), 0
            for b in batches:
                for at in range(0, b.num_rows, 1024):
                    d2 = _distances(_matrix(b.slice(at, 1024).column(0)), p)
                    total += np.exp(-d2 / (2 * h * h)).sum(axis=1)
                    least = np.minimum(least, d2.min(axis=1))
                    n += d2.shape[1]
            yield pa.record_batch({"q": pa.array(names), "s": pa.array(total), "m": pa.array(least), "n": pa.array(np.full(len(p), n))})
        return task

    src = df.select(F.col(vec).cast("array<double>"))
    parts = [src.mapInArrow(run(s), "q bigint, s double, m double, n bigint") for s in _query_blocks(queries, q, q_vec)]
    if not parts:
        return df.sparkSession.createDataFrame([], "q bigint, parzen double, nearest double")
    return reduce(DataFrame.unionByName, parts).groupBy("q").agg(
        F.try_divide(F.sum("s"), F.sum("n") * SQRT_2PI).alias("parzen"), F.try_divide(F.lit(1.0), F.sqrt(F.min("m"))).alias("nearest"))


# --- multivariate --------------------------------------------------------------

def gram(df: DataFrame, vec: str, weight: str | None = None) -> DataFrame:
    """Weighted sums of vectors and of their outer products, one matrix product per batch.

    Rows: (i, j, s) with i <= j from 0; i = -1 holds component sums; (-1,-1) the
    weight total and (-1,-2) the sum of squared weights.
    """
    cols = [vec] + ([weight] if weight else [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc = None
        for b in batches:
            if b.num_rows == 0:
                continue
            lists = b.column(0)
            sizes = np.asarray(lists.value_lengths())
            dim = int(sizes[0]) if lists.null_count == 0 else -1
            if lists.null_count or (sizes != dim).any() or (acc is not None and len(acc[0]) != dim):
                raise ValueError("vectors must be present and of one length")
            x = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
            w = b.column(1).to_numpy(zero_copy_only=False).astype(np.float64) if weight else np.ones(len(x))
            part = (w @ x, (x * w[:, None]).T @ x, w.sum(), (w * w).sum())
            acc = part if acc is None else tuple(p + q for p, q in zip(acc, part))
        if acc is None:
            return
        s, g, n, nn = acc
        i, j = np.triu_indices(len(s))
        yield pa.RecordBatch.from_arrays([
            pa.array(np.r_[i, np.full(len(s) + 2, -1)], pa.int32()),
            pa.array(np.r_[j, np.arange(len(s)), -1, -2], pa.int32()),
            pa.array(np.r_[g[i, j], s, n, nn], pa.float64())], names=["i", "j", "s"])

    part = df.select(*cols).mapInArrow(run, "i int, j int, s double")
    return part.groupBy("i", "j").agg(F.sum("s").alias("s"))


def covariance(df: DataFrame, vec: str, weight: str | None = None) -> DataFrame:
    """Covariance, means, deviations and correlation of vector components (i <= j), with the weight total ``n``.

    Unweighted: divided by n.  Weighted: weights are normalised and the result is
    divided by 1 minus the sum of their squares.
    """
    g = gram(df, vec, weight)
    one = F.col("i") == -1
    # the vector length bounds the row below: one entry per component
    head = g.where(one).agg(F.map_from_entries(F.collect_list(F.struct("j", "s"))).alias("m"))
    h = g.where(~one).join(F.broadcast(head))
    n = F.element_at("m", F.lit(-1))
    mi, mj = F.element_at(F.col("m"), F.col("i")) / n, F.element_at(F.col("m"), F.col("j")) / n
    cov = F.col("s") / n - mi * mj
    if weight:
        rest = F.lit(1.0) - F.element_at("m", F.lit(-2)) / (n * n)
        cov = F.when(F.abs(rest) > 1e-20, cov / rest).otherwise(0.0)
    c = h.select("i", "j", mi.alias("mean_i"), mj.alias("mean_j"), cov.alias("cov"), n.alias("n"))
    var = c.where("i = j").agg(F.map_from_entries(F.collect_list(F.struct("i", "cov"))).alias("v"))
    sd = lambda k: F.sqrt(F.greatest(F.element_at(F.col("v"), F.col(k)), F.lit(0.0)))
    out = c.join(F.broadcast(var)).select("i", "j", "n", "mean_i", "mean_j", "cov", sd("i").alias("sd_i"), sd("j").alias("sd_j"))
    return out.withColumn("corr", cov_to_corr("cov", "sd_i", "sd_j"))


def cov_to_corr(cov, si, sj) -> Column:
    s = F.col(si) * F.col(sj)
    return F.when(s < 1e-20, 0.0).otherwise(F.col(cov) / F.when(s >= 1e-20, s))


def corr_to_cov(corr, si, sj) -> Column:
    return F.col(corr) * F.col(si) * F.col(sj)


def shrink(cov, target, n, dim: int, alpha: float = 1.0) -> Column:
    """Blend towards a target; the fewer of ``n`` samples per dimension, the more."""
    n = n if isinstance(n, Column) else F.lit(n)
    share = F.when(n > 0, F.pow(F.lit(2.0), -n / dim)).otherwise(1.0) * alpha
    lam = F.greatest(F.least(share, F.lit(1.0)), F.lit(0.0))
    return F.col(cov) * (1.0 - lam) + (F.col(target) if isinstance(target, str) else target) * lam


def normal_density(df: DataFrame, vec: str, mean: np.ndarray, cov: np.ndarray, log: bool = False, plain: bool = False) -> DataFrame:
    """Multivariate normal density of each vector; ``plain`` leaves out the constant factor.

    The inverse matrix is as large as the vectors are long and travels with the task.
    """
    inverse = np.linalg.inv(cov)
    const = 0.0 if plain else -0.5 * (np.linalg.slogdet(cov)[1] + len(mean) * np.log(2 * np.pi))

    @F.pandas_udf("double")
    def density(v: pd.Series) -> pd.Series:
        z = np.stack(v.to_numpy()) - mean if len(v) else np.zeros((0, len(mean)))
        lf = -0.5 * np.einsum("ni,ij,nj->n", z, inverse, z, optimize=True) + const
        return pd.Series(lf if log else np.exp(lf))

    return df.withColumn("density", density(vec))


def collect_matrix(cov: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Means and covariance as small arrays: component count squared, whatever the row count."""
    rows = cov.select("i", "j", "mean_j", "cov").toPandas()
    dim = int(rows["j"].max()) + 1
    c, m = np.zeros((dim, dim)), np.zeros(dim)
    i, j = rows["i"].to_numpy(), rows["j"].to_numpy()
    c[i, j] = c[j, i] = rows["cov"].to_numpy()
    m[j] = rows["mean_j"].to_numpy()
    return m, c
