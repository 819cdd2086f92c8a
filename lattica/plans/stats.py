"""Statistics of samples, vectors and histograms."""

import math

from pyspark.sql import functions as F

from lattica.functions import dist as D
from lattica.operators import channels as C, order as O, stats as S
from lattica.plans.common import rnd, rsql
from lattica.plans.registry import query
from lattica.sources import tables as B

SM = B.SAMPLES_SQL
_STAT = lambda v: (f"CAST(count({v}) AS BIGINT) AS n, {rsql(f'avg({v})')} AS avg, {rsql(f'stddev_pop({v})')} AS var, min({v}) AS min, "
                   f"max({v}) AS max, {rsql(f'max({v}) - min({v})')} AS span, {rsql(f'sum({v} * {v})', 3)} AS sum_sqr")


def rounded_stat(df, *keys):
    return df.select(*keys, "n", rnd("avg").alias("avg"), rnd("var").alias("var"), "min", "max", rnd("span").alias("span"), rnd("sum_sqr", 3).alias("sum_sqr"))


@query("st_sample_stat", "A10", f"WITH {SM} SELECT g, {_STAT('v')} FROM samples GROUP BY g")
def _(spark, d):
    return rounded_stat(S.sample_stat(B.samples(spark, d), ["g"], "v"), "g")


@query("st_merge_parts", "A11", f"""WITH {SM} SELECT g, CAST(count(*) AS BIGINT) AS n, {rsql('avg(v)')} AS avg, {rsql('sqrt(sum(v * v) / count(*) - avg(v) * avg(v))')} AS var,
 min(v) AS min, max(v) AS max FROM samples GROUP BY g""")
def _(spark, d):
    ev = B.table(spark, d, "events").select(F.col("event_type").alias("g"), F.to_date("ts").alias("day"), F.col("value").alias("v"))
    parts = ev.groupBy("g", "day").agg(F.count("*").alias("n"), F.sum("v").alias("sum"), F.sum(F.col("v") * F.col("v")).alias("sum_sqr"),
                                       F.min("v").alias("min"), F.max("v").alias("max"))
    return C.merge_moments(parts, ["g"]).select("g", "n", rnd("avg").alias("avg"), rnd("var").alias("var"), "min", "max")


@query("st_median", "A12", f"WITH {SM} SELECT g, {rsql('quantile_cont(v, 0.5)')} AS median FROM samples GROUP BY g")
def _(spark, d):
    m = O.median(B.samples(spark, d), ["g"], "v")
    return m.select("g", rnd("median").alias("median"))


@query("st_median_price", "A12", f"SELECT l_returnflag AS g, {rsql('quantile_cont(l_extendedprice, 0.5)', 3)} AS median FROM lineitem GROUP BY 1")
def _(spark, d):
    li = B.table(spark, d, "lineitem").select(F.col("l_returnflag").alias("g"), F.col("l_extendedprice").alias("v"))
    return O.median(li, ["g"], "v").select("g", rnd("median", 3).alias("median"))


@query("st_kth", "A12 O4", f"""WITH {SM}, r AS (SELECT g, v, row_number() OVER (PARTITION BY g ORDER BY v) - 1 AS p, count(*) OVER (PARTITION BY g) AS n FROM samples),
 q AS (SELECT *, unnest([0, 1, 2]) AS q FROM r) SELECT g, q, CAST(p AS BIGINT) AS p, v FROM q WHERE p = CASE q WHEN 0 THEN 10 WHEN 1 THEN n // 4 ELSE n - 1 END""")
def _(spark, d):
    n = F.col("n")
    return O.kth(B.samples(spark, d), ["g"], "v", [10, F.floor(n / 4), n - 1]).select("g", "q", "p", "v")


@query("st_rank_avg", "W11", f"""WITH {SM}, r AS (SELECT g, v, rank() OVER (PARTITION BY g ORDER BY v) AS r, count(*) OVER (PARTITION BY g, v) AS c FROM samples)
SELECT DISTINCT g, v, CAST(c AS BIGINT) AS ties, r + (c - 1) / 2e0 AS rank FROM r""")
def _(spark, d):
    return O.average_rank(B.samples(spark, d), ["g"], "v")


@query("st_corr_regr", "A13", f"""SELECT l_returnflag AS g, CAST(count(*) AS BIGINT) AS n, {rsql('corr(l_quantity, l_extendedprice)')} AS r,
 {rsql('regr_intercept(l_extendedprice, l_quantity)', 3)} AS alpha1, {rsql('regr_slope(l_extendedprice, l_quantity)', 3)} AS alpha2 FROM lineitem GROUP BY 1""")
def _(spark, d):
    li = B.table(spark, d, "lineitem").withColumnRenamed("l_returnflag", "g")
    c = S.correlation(li, ["g"], "l_quantity", "l_extendedprice")
    return c.select("g", "n", rnd("r").alias("r"), rnd("alpha1", 3).alias("alpha1"), rnd("alpha2", 3).alias("alpha2"))


def student_sql(t: str, v: str) -> str:
    """Two-sided exceedance for a whole number of degrees of freedom: a finite sum of powers of a cosine."""
    a = f"atan({t} / sqrt({v}))"
    even = f"sin({a}) * list_sum(list_transform(range(CAST({v} AS BIGINT) // 2), lambda k: exp(lgamma(k + 0.5e0) - lgamma(0.5e0) - lgamma(k + 1) + 2 * k * ln(cos({a})))))"
    odd = f"2 / pi() * ({a} + sin({a}) * coalesce(list_sum(list_transform(range((CAST({v} AS BIGINT) - 1) // 2), lambda k: exp(lgamma(k + 1) - lgamma(k + 1.5e0) + lgamma(1.5e0) + (2 * k + 1) * ln(cos({a}))))), 0))"
    return f"(1 - CASE WHEN CAST({v} AS BIGINT) % 2 = 0 THEN {even} ELSE {odd} END)"


def quantile_sql(src: str, alpha: str) -> str:
    """CTE ``tq(m, t05)``: bisection for every m of ``src``."""
    return f"""bis AS (SELECT m, 0e0 AS lo, 100e0 AS hi, 0 AS k FROM {src} UNION ALL
  SELECT m, CASE WHEN p > {alpha} THEN mid ELSE lo END, CASE WHEN p > {alpha} THEN hi ELSE mid END, k + 1 FROM (SELECT *, (lo + hi) / 2 AS mid, {student_sql('((lo + hi) / 2)', 'm')} AS p FROM bis WHERE k < 70)),
 tq AS (SELECT m, lo AS t05 FROM bis WHERE k = 70)"""


@query("st_corr_confidence", "A14 F7", f"""WITH RECURSIVE c AS (SELECT l_suppkey AS g, CAST(count(*) AS BIGINT) AS n, corr(l_quantity, l_discount) AS r FROM lineitem GROUP BY 1),
 ms AS (SELECT DISTINCT CAST(n - 2 AS DOUBLE) AS m FROM c), {quantile_sql('ms', '0.05e0')}
SELECT g, n, {rsql('r')} AS r, {rsql('abs(r * sqrt(n - 2) / sqrt(1 - r * r)) / t05')} AS confidence FROM c JOIN tq ON tq.m = n - 2""")
def _(spark, d):
    o = B.table(spark, d, "lineitem").withColumnRenamed("l_suppkey", "g")
    c = S.correlation(o, ["g"], "l_quantity", "l_discount")
    return c.select("g", "n", rnd("r").alias("r"), rnd(D.corr_confidence("r", "n", 0.05)).alias("confidence"))


@query("st_semidev", "A15", f"""WITH {SM}, m AS (SELECT g, avg(v) AS m FROM samples GROUP BY g)
SELECT g, {rsql('sqrt(sum((v - m) * (v - m)) / count(*))')} AS semidev FROM samples JOIN m USING (g) WHERE v < m GROUP BY g""")
def _(spark, d):
    return S.semi_deviation(B.samples(spark, d), ["g"], "v").select("g", rnd("semidev").alias("semidev"))


_LONG = f"{B.VECTORS_SQL}, lng AS (SELECT vec_id, label, unnest(range(64)) AS i, unnest(e) AS x FROM vectors)"


@query("st_covariance", "A16", f"""WITH {_LONG}, m AS (SELECT i, avg(x) AS m, stddev_pop(x) AS s FROM lng GROUP BY i)
SELECT CAST(a.i AS INTEGER) AS i, CAST(b.i AS INTEGER) AS j, {rsql('covar_pop(a.x, b.x)')} AS cov, {rsql('covar_pop(a.x, b.x) / (any_value(ma.s) * any_value(mb.s))')} AS corr,
 {rsql('any_value(ma.m)')} AS mean_i FROM lng a JOIN lng b ON a.vec_id = b.vec_id AND a.i <= b.i JOIN m ma ON ma.i = a.i JOIN m mb ON mb.i = b.i GROUP BY a.i, b.i""")
def _(spark, d):
    c = S.covariance(B.vectors(spark, d), "e")
    return c.select("i", "j", rnd("cov").alias("cov"), rnd("corr").alias("corr"), rnd("mean_i").alias("mean_i"))


@query("st_weighted_cov", "A16", f"""WITH {_LONG}, w AS (SELECT vec_id, i, x, (label + 1) / CAST(sum(label + 1) OVER (PARTITION BY i) AS DOUBLE) AS w FROM lng),
 m AS (SELECT i, sum(w * x) AS m, sum(w * w) AS ww FROM w GROUP BY i)
SELECT CAST(a.i AS INTEGER) AS i, CAST(b.i AS INTEGER) AS j, {rsql('sum(a.w * (a.x - ma.m) * (b.x - mb.m)) / (1 - any_value(ma.ww))')} AS cov
FROM w a JOIN w b ON a.vec_id = b.vec_id AND a.i <= b.i JOIN m ma ON ma.i = a.i JOIN m mb ON mb.i = b.i GROUP BY a.i, b.i""")
def _(spark, d):
    v = B.vectors(spark, d).withColumn("w", F.col("label") + 1)
    return S.covariance(v, "e", "w").select("i", "j", rnd("cov").alias("cov"))


@query("st_shrunk_cov", "A16", f"""WITH {_LONG}, c AS (SELECT a.i AS i, b.i AS j, covar_pop(a.x, b.x) AS cov, pow(2, -count(*) / 64e0) AS lam FROM lng a JOIN lng b ON a.vec_id = b.vec_id AND a.i <= b.i GROUP BY a.i, b.i)
SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, {rsql('cov * (1 - lam) + (CASE WHEN i = j THEN 0.02e0 ELSE 0e0 END) * lam')} AS cov FROM c""")
def _(spark, d):
    c = S.covariance(B.vectors(spark, d), "e")
    target = F.when(F.col("i") == F.col("j"), 0.02).otherwise(0.0)
    return c.select("i", "j", rnd(S.shrink("cov", target, F.col("n"), 64)).alias("cov"))


_BIN = lambda v, nb, lo, hi: f"CAST(greatest(least(floor(({v} - {lo}e0) / {(hi - lo) / nb!r}e0), {nb - 1}), 0) AS INTEGER)"
_HIST = lambda nb, lo, hi: f"""{SM}, hc AS (SELECT g, {_BIN('v', nb, lo, hi)} AS bin, count(*) AS c FROM samples GROUP BY 1, 2), hn AS (SELECT g, count(*) AS n FROM samples GROUP BY 1),
 hist AS (SELECT g, b AS bin, coalesce(c, 0) / (n * {(hi - lo) / nb!r}e0) AS density FROM (SELECT g, n, CAST(unnest(range({nb})) AS INTEGER) AS b FROM hn) LEFT JOIN hc USING (g) WHERE hc.bin = b OR FALSE),
 full_hist AS (SELECT hn.g, b AS bin, coalesce((SELECT c FROM hc WHERE hc.g = hn.g AND hc.bin = b), 0) / (n * {(hi - lo) / nb!r}e0) AS density FROM hn, (SELECT CAST(unnest(range({nb})) AS INTEGER) AS b))"""


@query("st_hist", "A17", f"WITH {_HIST(40, 0, 100)} SELECT g, bin, {rsql('density')} AS density, bin * 2.5e0 AS \"left\" FROM full_hist")
def _(spark, d):
    h = S.histogram(B.samples(spark, d), ["g"], "v", 40, 0.0, 100.0)
    return S.explode_bins(h, ["g"], 0.0, 2.5).select("g", "bin", rnd("density").alias("density"), "left")


@query("st_hist_norm", "A17", f"""WITH {SM}, m AS (SELECT g, avg(v) AS m, stddev_pop(v) AS s, count(*) AS n FROM samples GROUP BY g),
 c AS (SELECT g, {_BIN('(v - m) / s', 16, -4, 4)} AS bin, count(*) AS c, any_value(n) AS n FROM samples JOIN m USING (g) GROUP BY 1, 2)
SELECT m.g, b.bin, {rsql('coalesce(c.c, 0) / (m.n * 0.5e0)')} AS density FROM m CROSS JOIN (SELECT CAST(unnest(range(16)) AS INTEGER) AS bin) b LEFT JOIN c ON c.g = m.g AND c.bin = b.bin""")
def _(spark, d):
    h = S.histogram(B.samples(spark, d), ["g"], "v", 16, -4.0, 4.0, standardise=True)
    return S.explode_bins(h, ["g"], -4.0, 0.5).select("g", "bin", rnd("density").alias("density"))


@query("st_hist_pct", "A18", f"""WITH {_HIST(40, 0, 1).replace("(v - 0e0)", "(v / 100e0 - 0e0)")}, r AS (SELECT *, sum(density) OVER (PARTITION BY g ORDER BY bin) AS s FROM full_hist)
SELECT g, {rsql('coalesce(min(CASE WHEN s > 0.1e0 * 40 THEN bin END), 40) * 0.025e0')} AS p10, {rsql('coalesce(min(CASE WHEN s > 0.9e0 * 40 THEN bin END), 40) * 0.025e0')} AS p90 FROM r GROUP BY g""")
def _(spark, d):
    h = S.histogram(B.samples(spark, d).withColumn("v", F.col("v") / 100.0), ["g"], "v", 40, 0.0, 1.0)
    pct = lambda p: rnd(S.hist_percentile(F.col("bins"), p, 0.0, 1.0, 40))
    return h.select("g", pct(0.1).alias("p10"), pct(0.9).alias("p90"))


_SMOOTH = [math.exp(-((abs(j - 3) / 3) ** 2) / 0.5) for j in range(7)]
_SMOOTH_SQL = "[" + ", ".join(f"{w / sum(_SMOOTH):.17e}" for w in _SMOOTH) + "]"


@query("st_hist_smooth", "A18 T20", f"""WITH RECURSIVE {_HIST(40, 0, 100)},
 p AS (SELECT g, list_concat([0e0, 0e0, 0e0], list(density ORDER BY bin), [0e0, 0e0, 0e0]) AS l FROM full_hist GROUP BY g),
 r AS (SELECT g, l, 1 AS i FROM p UNION ALL SELECT g, list_concat(l[:i + 2], [list_sum(list_transform(list_zip(l[i:i + 6], {_SMOOTH_SQL}), lambda t: t[1] * t[2]))], l[i + 4:]), i + 1 FROM r WHERE i <= 40)
SELECT g, b.bin, {rsql('l[b.bin + 4]')} AS density FROM r, (SELECT CAST(unnest(range(40)) AS INTEGER) AS bin) b WHERE i = 41""")
def _(spark, d):
    h = S.histogram(B.samples(spark, d), ["g"], "v", 40, 0.0, 100.0)
    s = h.withColumn("bins", S.smooth_in_place(3, 0.5)(F.col("bins")))
    return S.explode_bins(s, ["g"], 0.0, 2.5).select("g", "bin", rnd("density").alias("density"))


_PAIR = f"""{_HIST(40, 0, 100)}, pr AS (SELECT a.g, a.bin, CASE WHEN a.density < 1e-20 THEN 0.001e0 ELSE a.density END AS f, CASE WHEN b.density < 1e-20 THEN 0.001e0 ELSE b.density END AS q,
 sum(a.density - b.density) OVER (PARTITION BY a.g ORDER BY a.bin) AS cd FROM full_hist a JOIN full_hist b ON b.bin = a.bin AND b.g = 'view')"""


@query("st_hist_dist", "A19", f"""WITH {_PAIR} SELECT g, {rsql('sum(f * ln(f / q) + q * ln(q / f))')} AS jdiv, {rsql('sum(cd * cd)')} AS cvm, {rsql('max(abs(cd))')} AS ks FROM pr GROUP BY g""")
def _(spark, d):
    h = S.histogram(B.samples(spark, d), ["g"], "v", 40, 0.0, 100.0)
    ref = h.where("g = 'view'").select(F.col("bins").alias("ref"))  # one row: the group is named
    both = h.join(F.broadcast(ref))
    return both.select("g", *[rnd(c).alias(n) for n, c in S.hist_distances(F.col("bins"), F.col("ref"), 0.001).items()])


@query("st_hist_model", "A17", f"""WITH {_HIST(40, 0, 100)}, mdl AS (SELECT b AS bin, exp(-(b * 2.5e0 + 1.25e0) / 20e0) AS f FROM (SELECT unnest(range(40)) AS b)), t AS (SELECT sum(f) AS t FROM mdl)
SELECT g, {rsql('sum(abs(density * 2.5e0 - f / t))')} AS gap FROM full_hist JOIN mdl USING (bin), t GROUP BY g""")
def _(spark, d):
    h = S.histogram(B.samples(spark, d), ["g"], "v", 40, 0.0, 100.0)
    m = S.function_histogram(h, lambda x: F.exp(-x / 20.0), 40, 0.0, 100.0)
    gap = F.aggregate(F.zip_with("bins", "model", lambda a, b: F.abs(a * 2.5 - b)), F.lit(0.0), lambda a, x: a + x)
    return m.select("g", rnd(gap).alias("gap"))


_BOTH = f"""{SM}, both_ AS (SELECT g, v, 1 AS a, 0 AS b FROM samples WHERE g <> 'view' UNION ALL
  SELECT t.g, s.v, 0, 1 FROM samples s, (SELECT DISTINCT g FROM samples WHERE g <> 'view') t WHERE s.g = 'view')"""
_ECDF = f"""{_BOTH}, u AS (SELECT g, v, sum(a) AS a, sum(b) AS b FROM both_ GROUP BY g, v),
 t AS (SELECT g, sum(a) AS na, sum(b) AS nb FROM u GROUP BY g),
 r AS (SELECT g, v, coalesce(lag(v) OVER w, v) AS pv, abs((sum(a) OVER w - a) / na - (sum(b) OVER w - b) / nb) AS gap FROM u JOIN t USING (g) WINDOW w AS (PARTITION BY g ORDER BY v))"""


def against_view(spark, d):
    """Every other event type beside the views: (g, v, first)."""
    s = B.samples(spark, d)
    others = s.where("g <> 'view'")
    types = others.agg(F.collect_set("g").alias("gs"))  # one row
    views = s.where("g = 'view'").join(F.broadcast(types)).select(F.explode("gs").alias("g"), "v", F.lit(False).alias("first"))
    return others.withColumn("first", F.lit(True)).unionByName(views)


@query("st_ecdf_compare", "A20", f"WITH {_ECDF} SELECT g, {rsql('sum(gap * (v - pv))')} AS area, {rsql('max(CASE WHEN v - pv > 1e-20 THEN gap ELSE 0 END)')} AS ks FROM r GROUP BY g")
def _(spark, d):
    return S.compare_samples(against_view(spark, d), ["g"], "v", F.col("first")).select("g", rnd("area").alias("area"), rnd("ks").alias("ks"))


@query("st_ecdf_squared", "A20", f"WITH {_ECDF} SELECT g, {rsql('sqrt(sum(gap * (v - pv) * gap * (v - pv)))')} AS area, {rsql('max(CASE WHEN v - pv > 1e-20 THEN gap ELSE 0 END)')} AS ks FROM r GROUP BY g")
def _(spark, d):
    return S.compare_samples(against_view(spark, d), ["g"], "v", F.col("first"), squared=True).select("g", rnd("area").alias("area"), rnd("ks").alias("ks"))


_B256 = lambda e, na, nb: f"""{_BOTH}, c AS (SELECT g, CAST(greatest({e}, 0) AS INTEGER) AS bin, sum(a) AS a, sum(b) AS b FROM both_ GROUP BY 1, 2),
 t AS (SELECT g, sum(a) AS na, sum(b) AS nb FROM c GROUP BY g), f AS (SELECT g, na, nb, b.bin FROM t, (SELECT CAST(unnest(range(256)) AS INTEGER) AS bin) b),
 r AS (SELECT f.g, sum(coalesce(a, 0) / CAST({na} AS DOUBLE) - coalesce(b, 0) / CAST({nb} AS DOUBLE)) OVER (PARTITION BY f.g ORDER BY f.bin) AS df FROM f LEFT JOIN c ON c.bin = f.bin AND c.g = f.g)"""


@query("st_bin256_compare", "A20", f"WITH {_B256('trunc(trunc(v) / 2) + 128', '1', '1')} SELECT g, {rsql('sqrt(sum(df * df))')} AS cvm, {rsql('max(abs(df))')} AS ks FROM r GROUP BY g")
def _(spark, d):
    b = (F.col("v").cast("int") / 2).cast("int") + 128
    return S.compare_binned(against_view(spark, d), ["g"], b, F.col("first"), 256, False).select("g", rnd("cvm").alias("cvm"), rnd("ks").alias("ks"))


@query("st_bin256_relative", "A20", f"WITH {_B256('floor(v)', 'na', 'nb')} SELECT g, {rsql('sqrt(sum(df * df))')} AS cvm, {rsql('max(abs(df))')} AS ks FROM r GROUP BY g")
def _(spark, d):
    return S.compare_binned(against_view(spark, d), ["g"], F.floor("v"), F.col("first"), 256, True).select("g", rnd("cvm").alias("cvm"), rnd("ks").alias("ks"))


_US = [0.0001, 0.01, 0.25, 0.5, 0.9, 0.9999]
_INV = f"""{SM}, r AS (SELECT g, list(v ORDER BY v) AS s, count(*) AS n FROM samples GROUP BY g), q AS (SELECT *, greatest(n // 4, 2) AS nq FROM r),
 e AS (SELECT *, (s[nq] - s[1]) / (nq - 1) AS al, (s[n] - s[n - nq + 1]) / (nq - 1) AS ar, unnest([{', '.join(f'{u}e0' for u in _US)}]) AS u FROM q),
 y AS (SELECT *, u * (n + 1) AS y, CAST(floor(u * (n + 1)) AS BIGINT) AS j FROM e)"""


@query("st_inverse_cdf", "A21", f"""WITH {_INV} SELECT g, u, {rsql('CASE WHEN j < 1 THEN (s[1] - al) + al * (y - j) WHEN j >= n THEN s[n] + ar * (y - j) ELSE s[j] + (s[j + 1] - s[j]) * (y - j) END')} AS x FROM y""")
def _(spark, d):
    return S.inverse_cdf(B.samples(spark, d), ["g"], "v", _US).select("g", "u", rnd("x").alias("x"))


@query("st_inverse_cdf_log", "A21", f"""WITH {_INV} SELECT g, u, {rsql('CASE WHEN j < 1 THEN s[1] + al * ln(y) WHEN j >= n THEN s[n] - ar * ln(1 - (y - n)) ELSE s[j] + (s[j + 1] - s[j]) * (y - j) END')} AS x FROM y""")
def _(spark, d):
    return S.inverse_cdf(B.samples(spark, d), ["g"], "v", _US, "log").select("g", "u", rnd("x").alias("x"))


@query("st_inverse_cdf_raw", "A21", f"""WITH {_INV} SELECT g, u, {rsql('s[least(CAST(floor(u * n) AS BIGINT), n - 1) + 1]')} AS x FROM y""")
def _(spark, d):
    return S.inverse_cdf(B.samples(spark, d), ["g"], "v", _US, "raw").select("g", "u", rnd("x").alias("x"))


_DRAWS = [-1.5, 0.25, 0.0, 1.0, -0.5, 2.0]


@query("st_inverse_cdf_kde", "A21", f"""WITH {SM}, r AS (SELECT g, list(v ORDER BY v) AS s, count(*) AS n, stddev_pop(v) AS sd FROM samples GROUP BY g),
 w AS (SELECT *, 0.776e0 * 1.364e0 * least(sd, (s[CAST(floor(0.75e0 * n) AS BIGINT) + 1] - s[CAST(floor(0.25e0 * n) AS BIGINT) + 1]) / 1.34e0) * pow(n, -0.2e0) AS h FROM r),
 d AS (SELECT * FROM (VALUES {', '.join(f'({u}e0, {z}e0)' for u, z in zip(_US, _DRAWS))}) t(u, z))
SELECT g, u, {rsql('s[least(CAST(floor(u * n) AS BIGINT), n - 1) + 1] + h * z')} AS x FROM w, d""")
def _(spark, d):
    return S.inverse_cdf(B.samples(spark, d), ["g"], "v", _US, "kde", draws=_DRAWS).select("g", "u", rnd("x").alias("x"))


_XS = [0.0, 2.5, 10.0, 25.0, 60.0]


@query("st_kde", "A22", f"""WITH {SM}, x AS (SELECT unnest([{', '.join(f'{x}e0' for x in _XS)}]) AS x)
SELECT g, x, {rsql('sum(exp(-((x - v) / 1.5e0) * ((x - v) / 1.5e0) / 2) / sqrt(2 * pi())) / (count(*) * 1.5e0)', 8)} AS density FROM samples, x GROUP BY g, x""")
def _(spark, d):
    return S.kernel_density(B.samples(spark, d), ["g"], "v", _XS, h=1.5).withColumn("density", rnd("density", 8))


@query("st_density_auto", "A21 A22", f"""WITH {SM}, x AS (SELECT unnest([{', '.join(f'{x}e0' for x in _XS)}]) AS x), h AS (SELECT g, 1.06e0 * stddev_pop(v) / pow(count(*), 0.2e0) AS h FROM samples GROUP BY g)
SELECT g, x, {rsql('sum(exp(-((x - v) / h) * ((x - v) / h) / 2)) / (count(*) * any_value(h) * sqrt(2 * pi()))', 8)} AS density FROM samples JOIN h USING (g), x GROUP BY g, x""")
def _(spark, d):
    return S.kernel_density(B.samples(spark, d), ["g"], "v", _XS).withColumn("density", rnd("density", 8))


_Q3 = [[0.1 * ((i * k) % 5 - 2) for i in range(64)] for k in (1, 2, 3)]
_Q3SQL = "q AS (SELECT * FROM (VALUES " + ", ".join(f"({k}, [{', '.join(f'{x!r}e0' if 'e' not in repr(x) else repr(x) for x in q)}])" for k, q in enumerate(_Q3)) + ") t(q, p))"
_D2 = "list_sum(list_transform(list_zip(e, p), lambda t: (t[1] - t[2]) * (t[1] - t[2])))"


@query("st_vec_density", "A22 J10", f"""WITH {B.VECTORS_SQL}, {_Q3SQL}, dd AS (SELECT q, {_D2} AS d2 FROM vectors, q)
SELECT q, {rsql('avg(exp(-d2 / (2 * 0.25e0)) / sqrt(2 * pi()))', 8)} AS parzen, {rsql('1 / min(sqrt(d2))')} AS nearest FROM dd GROUP BY q""")
def _(spark, d):
    v = S.vector_density(B.vectors(spark, d), "e", _Q3, 0.5)
    return v.select("q", rnd("parzen", 8).alias("parzen"), rnd("nearest").alias("nearest"))


@query("st_knn", "J10", f"""WITH {B.VECTORS_SQL}, {_Q3SQL}, dd AS (SELECT q, vec_id, sqrt({_D2}) AS dist FROM vectors, q),
 r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY dist, vec_id) AS rank FROM dd) SELECT q, vec_id, CAST(rank AS INTEGER) AS rank, {rsql('dist')} AS dist FROM r WHERE rank <= 10""")
def _(spark, d):
    return S.nearest(B.vectors(spark, d), "e", ["vec_id"], _Q3, 10).withColumn("dist", rnd("dist"))


_PAIRS = f"{B.VECTORS_SQL}, pq AS (SELECT vec_id AS q, e AS p FROM vectors WHERE vec_id % 20 = 0), dd AS (SELECT q, vec_id, {_D2} AS d2 FROM vectors, pq)"


def _asked(spark, d):
    return B.vectors(spark, d).where("vec_id % 20 = 0").select("vec_id", "e")


@query("st_knn_table", "J10 F10", f"""WITH {_PAIRS}, r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY sqrt(d2), vec_id) AS rank FROM dd)
SELECT q, vec_id, CAST(rank AS INTEGER) AS rank, {rsql('sqrt(d2)')} AS dist FROM r WHERE rank <= 10""")
def _(spark, d):
    n = S.nearest_table(B.vectors(spark, d), "e", "vec_id", _asked(spark, d), "vec_id", "e", 10)
    return n.select("q", F.col("id").alias("vec_id"), "rank", rnd("dist").alias("dist"))


@query("st_density_table", "A22 J10", f"""WITH {_PAIRS} SELECT q, {rsql('avg(exp(-d2 / 0.5e0)) / sqrt(2 * pi())', 8)} AS parzen, {rsql('1 / nullif(min(sqrt(d2)), 0)')} AS nearest FROM dd GROUP BY q""")
def _(spark, d):
    v = S.density_table(B.vectors(spark, d), "e", _asked(spark, d), "vec_id", "e", 0.5)
    return v.select("q", rnd("parzen", 8).alias("parzen"), rnd("nearest").alias("nearest"))


_VOL = "1e0 / (1e0 + 0.2316419e0 * abs(x))"
_CDF = f"(CASE WHEN x > 0 THEN 1 - t ELSE t END)"
_NORM = lambda src: f"""n0 AS (SELECT *, {_VOL} AS y FROM {src}), n1 AS (SELECT *, 0.3989423e0 * exp(-(x * x) / 2) * y * ((((1.330274e0 * y - 1.821256e0) * y + 1.781478e0) * y - 0.356538e0) * y + 0.3193815e0) AS t FROM n0)"""


@query("fn_norm_cdf", "F7", f"WITH src AS (SELECT event_id, (value - 20e0) / 10e0 AS x FROM events), {_NORM('src')} SELECT event_id, {rsql(_CDF, 7)} AS p, {rsql('exp(-(x * x) / 2) / sqrt(2 * pi())', 7)} AS dens FROM n1")
def _(spark, d):
    e = B.table(spark, d, "events").select("event_id", ((F.col("value") - 20.0) / 10.0).alias("x"))
    return e.select("event_id", rnd(D.norm_cdf("x"), 7).alias("p"), rnd(D.norm_density("x", 0.0, 1.0), 7).alias("dens"))


#: Fixed values of the oracles: the usual rational approximation of the normal quantile, highest power first.
_CENTRE_NUM = (-39.69683028665376, 220.9460984245205, -275.9285104469687, 138.3577518672690, -30.66479806614716, 2.506628277459239)
_CENTRE_DEN = (-54.47609879822406, 161.5858368580409, -155.6989798598866, 66.80131188771972, -13.28068155288572, 1.0)
_TAIL_NUM = (-0.007784894002430293, -0.3223964580411365, -2.400758277161838, -2.549732539343734, 4.374664141464968, 2.938163982698783)
_TAIL_DEN = (0.007784695709041462, 0.3224671290700398, 2.445134137142996, 3.754408661907416, 1.0)


def _horner_sql(x, terms):
    s = f"{terms[0]!r}e0"
    for t in terms[1:]:
        s = f"({s} * {x} + {t!r}e0)"
    return s


_TAIL = lambda p: f"({_horner_sql(f'sqrt(-2 * ln({p}))', _TAIL_NUM)} / {_horner_sql(f'sqrt(-2 * ln({p}))', _TAIL_DEN)})"


@query("fn_norm_quantile", "F7", f"""WITH src AS (SELECT event_id, (event_id % 997 + 1) / 1000e0 AS p FROM events)
SELECT event_id, {rsql(f"CASE WHEN p < 0.02425e0 THEN {_TAIL('p')} WHEN p > 0.97575e0 THEN -{_TAIL('(1 - p)')} ELSE (p - 0.5e0) * {_horner_sql('((p - 0.5e0) * (p - 0.5e0))', _CENTRE_NUM)} / {_horner_sql('((p - 0.5e0) * (p - 0.5e0))', _CENTRE_DEN)} END", 7)} AS z FROM src""")
def _(spark, d):
    e = B.table(spark, d, "events").select("event_id", ((F.col("event_id") % 997 + 1) / 1000.0).alias("p"))
    return e.select("event_id", rnd(D.norm_quantile("p"), 7).alias("z"))


@query("fn_student", "F7", f"""WITH RECURSIVE e AS (SELECT o_orderkey, CAST(o_custkey % 60 + 2 AS DOUBLE) AS m, o_totalprice / 200000e0 AS t FROM orders), ms AS (SELECT DISTINCT m FROM e), {quantile_sql('ms', '0.05e0')}
SELECT o_orderkey, {rsql('t05')} AS t05, {rsql(student_sql('t', 'm'))} AS p FROM e JOIN tq USING (m)""")
def _(spark, d):
    e = B.table(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") % 60 + 2).cast("double").alias("m"), (F.col("o_totalprice") / 200000.0).alias("t"))
    return e.select("o_orderkey", rnd(D.student_t(F.lit(0.05), "m")).alias("t05"), rnd(D.student_prob("t", "m")).alias("p"))


_N = lambda a, x: f"a{a} AS (SELECT *, 1e0 / (1e0 + 0.2316419e0 * abs({x})) AS y{a} FROM a{a - 1}), b{a} AS (SELECT *, 0.3989423e0 * exp(-({x} * {x}) / 2) * y{a} * ((((1.330274e0 * y{a} - 1.821256e0) * y{a} + 1.781478e0) * y{a} - 0.356538e0) * y{a} + 0.3193815e0) AS t{a} FROM a{a})"


def _opt_sql():
    base = """a0 AS (SELECT o_orderkey, o_totalprice AS p, 200000e0 AS s, 0.5e0 + (o_custkey % 5) / 2e0 AS t, 0.1e0 + (o_custkey % 7) / 20e0 AS v, 0.03e0 AS r FROM orders),
 d AS (SELECT *, (ln(p / s) + (r + v * v / 2) * t) / (v * sqrt(t)) AS d1, (ln(p / s) + (r + v * v / 2) * t) / (v * sqrt(t)) - v * sqrt(t) AS d2 FROM a0)"""
    cdf = lambda x: (f"(CASE WHEN {x} > 0 THEN 1 - {tail(x)} ELSE {tail(x)} END)")
    tail = lambda x: (f"(0.3989423e0 * exp(-({x} * {x}) / 2) * (1e0 / (1e0 + 0.2316419e0 * abs({x}))) * "
                      + _horner_sql(f"(1e0 / (1e0 + 0.2316419e0 * abs({x})))", (1.330274, -1.821256, 1.781478, -0.356538, 0.3193815)) + ")")
    call = f"p * {cdf('d1')} - s * exp(-(r * t)) * {cdf('d2')}"
    put = f"s * exp(-(r * t)) * {cdf('(-d2)')} - p * {cdf('(-d1)')}"
    return f"WITH {base} SELECT o_orderkey, {rsql(call, 3)} AS call_price, {rsql(put, 3)} AS put_price FROM d"


@query("fn_option_price", "F7", _opt_sql())
def _(spark, d):
    o = B.table(spark, d, "orders").select(
        "o_orderkey", F.col("o_totalprice").alias("p"), F.lit(200000.0).alias("s"), ((F.col("o_custkey") % 5) / 2.0 + 0.5).alias("t"),
        ((F.col("o_custkey") % 7) / 20.0 + 0.1).alias("v"), F.lit(0.03).alias("r"))
    return o.select("o_orderkey", rnd(D.option_price(True, "s", "t", "p", "v", "r"), 3).alias("call_price"),
                    rnd(D.option_price(False, "s", "t", "p", "v", "r"), 3).alias("put_price"))


# the inverse by elimination of the matrix beside the unit matrix, its logarithmic determinant from the pivots
_INVERSE = f"""{_LONG}, mu AS (SELECT i, avg(x) AS m FROM lng GROUP BY i), cv AS (SELECT a.i, b.i AS j, covar_pop(a.x, b.x) AS v FROM lng a JOIN lng b ON a.vec_id = b.vec_id GROUP BY 1, 2),
 rw AS (SELECT i, list_concat(list(v ORDER BY j), list(CASE WHEN i = j THEN 1e0 ELSE 0e0 END ORDER BY j)) AS r, CAST(count(*) AS BIGINT) AS n FROM cv GROUP BY i),
 el AS (SELECT 1 AS k, list(r ORDER BY i) AS a, 0e0 AS ld, any_value(n) AS n FROM rw UNION ALL SELECT k + 1,
  list_transform(a, lambda row, p: CASE WHEN p = k THEN list_transform(row, lambda x: x / a[k][k]) ELSE list_transform(row, lambda x, q: x - row[k] / a[k][k] * a[k][q]) END), ld + ln(a[k][k]), n FROM el WHERE k <= n),
 fin AS (SELECT a, ld, n FROM el WHERE k = n + 1), inv AS (SELECT p - 1 + (SELECT min(i) FROM lng) AS i, unnest(a[p][n + 1:2 * n]) AS v, unnest(range(n)) + (SELECT min(i) FROM lng) AS j FROM fin, (SELECT unnest(range(1, n + 1)) AS p FROM fin)),
 z AS (SELECT vec_id, i, x - m AS z FROM lng JOIN mu USING (i)), half AS (SELECT z.vec_id, inv.j AS i, sum(z.z * inv.v) AS h FROM z JOIN inv USING (i) GROUP BY 1, 2)"""


@query("st_normal_density", "A16", f"""WITH RECURSIVE {_INVERSE} SELECT z.vec_id, {rsql('-0.5e0 * (sum(z.z * h) + any_value(ld) + any_value(n) * ln(2 * pi()))', 3)} AS log_density FROM z JOIN half USING (vec_id, i), fin GROUP BY 1""")
def _(spark, d):
    v = B.vectors(spark, d)
    mean, cov = S.collect_matrix(S.covariance(v, "e"))
    return S.normal_density(v, "e", mean, cov, log=True).select("vec_id", rnd("density", 3).alias("log_density"))
