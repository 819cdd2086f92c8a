"""Polynomials, linear algebra, transforms, draws, noise, colour, text and image queries."""

import math

import numpy as np
from pyspark.sql import functions as F

from lattica.functions.keys import COORD_PRIMES
from lattica.functions import color as CO, noise as N, poly as PY, rng as R, text as TX
from lattica.operators import channels as C, image as IM, linalg as LA, order as O
from lattica.operators.slices import colour_map
from lattica.plans.addressing import _mix64_sql
from lattica.plans.common import rnd, rsql
from lattica.plans.registry import query
from lattica.plans.stats import _CENTRE_DEN, _CENTRE_NUM, _D2, _Q3, _Q3SQL, _TAIL, _horner_sql
from lattica.sources import blocks as BK, tables as B


# --- polynomials ---------------------------------------------------------------------

@query("poly_quadratic", "F5", f"""WITH p AS (SELECT DISTINCT l_quantity AS a, l_linenumber * 10e0 AS b, l_tax * 100e0 - 4e0 AS c FROM lineitem)
SELECT a, b, c, CAST(CASE WHEN b * b - 4 * a * c < 0 THEN 0 WHEN b * b - 4 * a * c = 0 THEN 1 ELSE 2 END AS INTEGER) AS n, {rsql('CASE WHEN b * b - 4 * a * c >= 0 THEN (-b - sqrt(b * b - 4 * a * c)) / (2 * a) END')} AS lo,
 {rsql('CASE WHEN b * b - 4 * a * c >= 0 THEN (-b + sqrt(b * b - 4 * a * c)) / (2 * a) END')} AS hi FROM p""")
def _(spark, d):
    p = B.table(spark, d, "lineitem").select(F.col("l_quantity").alias("a"), (F.col("l_linenumber") * 10.0).alias("b"), (F.col("l_tax") * 100.0 - 4.0).alias("c")).distinct()
    r = p.withColumn("r", PY.quadratic_roots("a", "b", "c"))
    return r.select("a", "b", "c", F.size("r").alias("n"), rnd(F.get("r", F.lit(0))).alias("lo"), rnd(F.get("r", F.size("r") - 1)).alias("hi"))


_K3 = "k AS (SELECT DISTINCT CAST(l_linenumber AS DOUBLE) AS r1, l_quantity AS r2, floor(l_tax * 100 + 0.5e0) AS r3 FROM lineitem)"


@query("poly_real_roots", "F5", f"""WITH {_K3}
SELECT r1, r2, r3, {rsql('least(r1, r2, r3)', 5)} AS lo, {rsql('r1 + r2 + r3 - least(r1, r2, r3) - greatest(r1, r2, r3)', 5)} AS mid, {rsql('greatest(r1, r2, r3)', 5)} AS hi, 3 AS n FROM k""")
def _(spark, d):
    k = B.table(spark, d, "lineitem").select(F.col("l_linenumber").cast("double").alias("r1"), F.col("l_quantity").alias("r2"), F.floor(F.col("l_tax") * 100 + 0.5).cast("double").alias("r3")).distinct()
    a, b, c = F.col("r1"), F.col("r2"), F.col("r3")
    r = k.withColumn("z", PY.real_roots(F.array(F.lit(1.0), -(a + b + c), a * b + a * c + b * c, -(a * b * c))))
    return r.select("r1", "r2", "r3", *[rnd(F.get("z", F.lit(i)), 5).alias(n) for i, n in enumerate(("lo", "mid", "hi"))], F.size("z").alias("n"))


# two known roots beside a pair c ± i e that is real, and double, where e = 0
@query("poly_quartic", "F5", f"""WITH k AS (SELECT DISTINCT CAST(l_linenumber AS DOUBLE) AS a, l_quantity AS b, floor(l_tax * 100 + 0.5e0) AS c, floor(l_discount * 100 + 0.5e0) AS e FROM lineitem),
 r AS (SELECT *, list_sort(list_concat([a, b], CASE WHEN e = 0 THEN [c, c] ELSE [] END)) AS z FROM k)
SELECT a, b, c, e, CAST(len(z) AS INTEGER) AS n, {rsql('z[1]', 4)} AS lo, {rsql('z[len(z)]', 4)} AS hi, CAST(len(list_filter(z, lambda v: v = z[1])) AS INTEGER) AS times FROM r""")
def _(spark, d):
    whole = lambda c: F.floor(F.col(c) * 100 + 0.5).cast("double")
    k = B.table(spark, d, "lineitem").select(F.col("l_linenumber").cast("double").alias("a"), F.col("l_quantity").alias("b"), whole("l_tax").alias("c"), whole("l_discount").alias("e")).distinct()
    s, p, u, v = F.col("a") + F.col("b"), F.col("a") * F.col("b"), F.col("c") * 2, F.col("c") * F.col("c") + F.col("e") * F.col("e")
    r = k.withColumn("z", PY.real_roots(F.array(F.lit(1.0), -(s + u), p + s * u + v, -(p * u + s * v), p * v)))
    least = F.get("z", F.lit(0))
    return r.select("a", "b", "c", "e", F.size("z").alias("n"), rnd(least, 4).alias("lo"), rnd(F.get("z", F.size("z") - 1), 4).alias("hi"),
                    F.size(F.filter("z", lambda t: t == least)).alias("times"))


@query("poly_bisect", "F5", f"SELECT o_orderkey, {rsql('pow(o_totalprice, 1e0 / 3)', 4)} AS root, {rsql('sqrt(o_totalprice)', 4)} AS sq FROM orders")
def _(spark, d):
    o = B.table(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").alias("p"))
    cube = PY.bisect(lambda x, p: x**3 - p, 0.0, 1e3)
    square = PY.newton(lambda x, p: x * x - p, 500.0, 1e-6, 60)
    return o.select("o_orderkey", rnd(cube(F.struct("p")), 4).alias("root"), rnd(square(F.struct("p")), 4).alias("sq"))


@query("poly_geometric", "F5", f"""WITH RECURSIVE p AS (SELECT DISTINCT CAST(l_linenumber AS DOUBLE) AS n, l_quantity AS c FROM lineitem),
 b AS (SELECT n, c, 0e0 AS lo, c AS hi, 0 AS k FROM p WHERE n > 1 UNION ALL
  SELECT n, c, CASE WHEN s < c THEN m ELSE lo END, CASE WHEN s < c THEN hi ELSE m END, k + 1 FROM (SELECT *, (lo + hi) / 2 AS m, list_sum(list_transform(range(CAST(n AS BIGINT)), lambda i: pow((lo + hi) / 2, i))) AS s FROM b WHERE k < 80))
SELECT p.n, p.c, {rsql('CASE WHEN p.n > 1 THEN b.lo END', 6)} AS x FROM p LEFT JOIN b ON b.n = p.n AND b.c = p.c AND b.k = 80""")
def _(spark, d):
    p = B.table(spark, d, "lineitem").select(F.col("l_linenumber").cast("double").alias("n"), F.col("l_quantity").alias("c")).distinct()
    return p.select("n", "c", rnd(PY.geometric_ratio()(F.struct("n", "c")), 6).alias("x"))


_P2 = [0.5, 1.0, -2.0, 0.25, 0.125, 3.0, -1.0, 0.75, 0.5, -0.25]


@query("poly_2d", "F5", f"""WITH {B.CELLS_SQL}, c AS (SELECT x, y, z, a AS u, y / 10e0 AS w FROM cells) SELECT x, y, z,
 {rsql('0.5e0 + u - 2 * w + 0.25e0 * u * u + 0.125e0 * u * w + 3 * w * w - u * u * u + 0.75e0 * u * u * w + 0.5e0 * u * w * w - 0.25e0 * w * w * w')} AS p,
 {rsql('1 + 0.5e0 * u + 0.125e0 * w - 3 * u * u + 1.5e0 * u * w + 0.5e0 * w * w')} AS px, {rsql('-2 + 0.125e0 * u + 6 * w + 0.75e0 * u * u + u * w - 0.75e0 * w * w')} AS py FROM c""")
def _(spark, d):
    c = B.cells(spark, d).select("x", "y", "z", F.col("a").alias("u"), (F.col("y") / 10.0).alias("w"))
    dx, dy = (PY.poly2d_derivative(_P2, 3, k) for k in "xy")
    return c.select("x", "y", "z", rnd(PY.poly2d(_P2, 3, "u", "w")).alias("p"), rnd(PY.poly2d(dx, 2, "u", "w")).alias("px"), rnd(PY.poly2d(dy, 2, "u", "w")).alias("py"))


@query("fn_clip_interval", "E12 F1", f"""SELECT event_id, {rsql('CASE WHEN value >= 80 THEN 40 WHEN value > 20 THEN 20 + (value - 20) * 20e0 / 60 ELSE value END')} AS lin,
 {rsql('CASE WHEN value >= 80 THEN 40 WHEN value > 20 THEN 40 - 20 * pow((80 - value) / 60e0, 3) ELSE value END')} AS bend FROM events""")
def _(spark, d):
    e = B.table(spark, d, "events")
    return e.select("event_id", rnd(PY.clip_interval("value", 20.0, 40.0, 80.0, True)).alias("lin"), rnd(PY.clip_interval("value", 20.0, 40.0, 80.0)).alias("bend"))


# --- linear algebra --------------------------------------------------------------------

@query("mat_multiply", "F8", f"""WITH m AS (SELECT l_suppkey AS i, l_linenumber AS j, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2)
SELECT a.j AS i, b.j, {rsql('sum(a.v * b.v)', 2)} AS v FROM m a JOIN m b ON a.i = b.i GROUP BY 1, 2""")
def _(spark, d):
    m = B.table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("i"), F.col("l_linenumber").alias("j")).agg(F.sum("l_quantity").alias("v"))
    return LA.multiply(LA.transpose(m), m).select("i", "j", rnd("v", 2).alias("v"))


_NE = """ne AS (SELECT l_suppkey AS g, sum(l_quantity * l_quantity) AS a, sum(l_quantity * l_discount) AS b, sum(l_discount * l_discount) AS c, sum(l_quantity * l_tax) AS r1, sum(l_discount * l_tax) AS r2 FROM lineitem GROUP BY 1)"""


def _equations(spark, d):
    li = B.table(spark, d, "lineitem").withColumnRenamed("l_suppkey", "g")
    return LA.normal_equations(li, ["g"], ["l_quantity", "l_discount"], "l_tax")


@query("mat_solve", "F8 F10", f"WITH {_NE} SELECT g, {rsql('(r1 * c - b * r2) / (a * c - b * b)')} AS w1, {rsql('(a * r2 - b * r1) / (a * c - b * b)')} AS w2 FROM ne")
def _(spark, d):
    e = _equations(spark, d).withColumn("w", LA.solve(F.col("m"), F.col("r"), 2))
    return e.select("g", rnd(F.col("w")[0]).alias("w1"), rnd(F.col("w")[1]).alias("w2"))


@query("mat_factor", "F8", f"""WITH {_NE} SELECT g, {rsql('a * c - b * b', 1)} AS det, {rsql('c / (a * c - b * b)')} AS inv00, {rsql('sqrt(a)')} AS l00, {rsql('b / sqrt(a)')} AS l10, {rsql('sqrt(c - b * b / a)')} AS l11,
 {rsql('(a + c + sqrt((a - c) * (a - c) + 4 * b * b)) / 2', 3)} AS s0 FROM ne""")
def _(spark, d):
    e = _equations(spark, d)
    m = F.col("m")
    e = e.select("g", LA.determinant(m, 2).alias("det"), LA.inverse(m, 2).alias("i"), LA.cholesky(m, 2).alias("l"), LA.singular_values(m, 2).alias("s"))
    return e.select("g", rnd("det", 1).alias("det"), rnd(F.col("i")[0]).alias("inv00"), rnd(F.col("l")[0]).alias("l00"), rnd(F.col("l")[2]).alias("l10"),
                    rnd(F.col("l")[3]).alias("l11"), rnd(F.col("s")[0], 3).alias("s0"))


@query("mat_pseudo_inverse", "F8", f"WITH {_NE} SELECT g, {rsql('c / (a * c - b * b)')} AS p00, {rsql('-b / (a * c - b * b)')} AS p01 FROM ne")
def _(spark, d):
    e = _equations(spark, d).select("g", LA.pseudo_inverse(F.col("m"), 2).alias("p"))
    return e.select("g", rnd(F.col("p")[0]).alias("p00"), rnd(F.col("p")[1]).alias("p01"))


def _gram_sql(n):
    """Per label the n x n matrix of inner products of components, one unit added on the diagonal."""
    return f"""{B.VECTORS_SQL}, m AS (SELECT label AS g, i, j, sum(e[i] * e[j]) + (CASE WHEN i = j THEN 1e0 ELSE 0e0 END) AS v FROM vectors, range(1, {n + 1}) a(i), range(1, {n + 1}) b(j) GROUP BY 1, 2, 3),
 rows_ AS (SELECT g, i, list(v ORDER BY j) AS r FROM m GROUP BY 1, 2), mats AS (SELECT g, list(r ORDER BY i) AS a FROM rows_ GROUP BY 1),
 el AS (SELECT g, 1 AS k, a, 1e0 AS det FROM mats UNION ALL SELECT g, k + 1,
  list_transform(a, lambda row, p: CASE WHEN p <= k THEN row ELSE list_transform(row, lambda x, q: x - row[k] / a[k][k] * a[k][q]) END), det * a[k][k] FROM el WHERE k <= {n})"""


def _gram(spark, d, n):
    v = B.vectors(spark, d).withColumnRenamed("label", "g")
    e = lambda i: F.element_at("e", i + 1)
    sums = [F.sum(e(i) * e(j)) + (1.0 if i == j else 0.0) for i in range(n) for j in range(n)]
    return v.groupBy("g").agg(F.array(*sums).alias("m"))


def _row(m, n, i):
    return F.slice(m, i * n + 1, n)


def _dot(a, b):
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


# determinants by elimination, solutions and factors by what they must give back
_DENSE = lambda n: f"""WITH RECURSIVE {_gram_sql(n)},
 total AS (SELECT g, sum(v * v) AS sq, sum(CASE WHEN i = j THEN v END) AS tr FROM m GROUP BY 1)
SELECT m.g, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, {rsql('v')} AS back, {rsql('CASE WHEN i = j THEN 1e0 ELSE 0e0 END')} AS unit, {rsql('CASE WHEN i = j THEN 1e0 ELSE 0e0 END')} AS pinv_unit,
 {rsql('i - 2.5e0')} AS x, {rsql('ln(det)')} AS log_det, {rsql('sq')} AS squares, {rsql('tr')} AS trace FROM m JOIN el ON el.g = m.g AND k = {n + 1} JOIN total ON total.g = m.g"""


def _dense(spark, d, n):
    g = _gram(spark, d, n)
    m = F.col("m")
    known = F.array(*[F.lit(i + 1 - 2.5) for i in range(n)])
    right = F.array(*[_dot(_row(m, n, i), known) for i in range(n)])
    f = g.select("g", "m", LA.cholesky(m, n).alias("l"), LA.inverse(m, n).alias("v"), LA.pseudo_inverse(m, n).alias("p"), LA.singular_values(m, n).alias("s"),
                 LA.determinant(m, n).alias("det"), LA.solve(m, right, n).alias("x"))
    at = f.withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(n * n - 1)))).withColumns({"i": F.floor(F.col("c") / n).cast("int"), "j": F.col("c") % n})
    row = lambda a, i: F.slice(a, F.col(i) * n + 1, F.lit(n))
    column = lambda a: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.element_at(a, k * n + F.col("j") + 1))
    done = {"back": _dot(row("l", "i"), row("l", "j")), "unit": _dot(row("m", "i"), column("v")), "pinv_unit": _dot(row("m", "i"), column("p")),
            "x": F.element_at("x", F.col("i") + 1), "log_det": F.log("det"), "squares": _dot(F.col("s"), F.col("s")), "trace": F.aggregate("s", F.lit(0.0), lambda a, x: a + x)}
    out = at.select("g", "i", "j", *[rnd(e).alias(k) for k, e in done.items()])
    return out.withColumns({"i": F.col("i") + 1, "j": F.col("j") + 1})


@query("mat_dense3", "F8", _DENSE(3))
def _(spark, d):
    return _dense(spark, d, 3)


@query("mat_dense8", "F8", _DENSE(8))
def _(spark, d):
    return _dense(spark, d, 8)


@query("reg_adapt", "F10", f"""WITH RECURSIVE s AS (SELECT event_type AS g, value / 100e0 AS x, user_id / 100e0 AS y, ts, event_id FROM events),
 l AS MATERIALIZED (SELECT g, list(x ORDER BY ts, event_id) AS xs, list(y ORDER BY ts, event_id) AS ys, count(*) AS n, 0.1e0 / avg(x * x + 1) AS eta FROM s GROUP BY g),
 w AS (SELECT g, 0 AS k, 0e0 AS w1, 0e0 AS w2 FROM l UNION ALL
  SELECT g, k + 1, w1 + e * x, w2 + e FROM (SELECT w.g, k, w1, w2, xs[k % n + 1] AS x, eta * (ys[k % n + 1] - w1 * xs[k % n + 1] - w2) AS e FROM w JOIN l USING (g) WHERE k < 2 * n))
SELECT w.g, {rsql('w1')} AS w1, {rsql('w2')} AS w2 FROM w JOIN l ON l.g = w.g AND w.k = 2 * l.n""")
def _(spark, d):
    s = B.table(spark, d, "events").select(F.col("event_type").alias("g"), "ts", "event_id", (F.col("value") / 100).alias("x1"), F.lit(1.0).alias("x2"), (F.col("user_id") / 100).alias("y"))
    w = LA.adapt(s, ["g"], ["ts", "event_id"], ["x1", "x2"], "y", 0.05, passes=2)
    return w.select("g", rnd(F.col("w")[0]).alias("w1"), rnd(F.col("w")[1]).alias("w2"))


_STEPS = 137


@query("reg_adapt_steps", "F10", f"""WITH RECURSIVE s AS (SELECT event_type AS g, value / 100e0 AS x, user_id / 100e0 AS y, ts, event_id FROM events),
 l AS MATERIALIZED (SELECT g, list(x ORDER BY ts, event_id) AS xs, list(y ORDER BY ts, event_id) AS ys, count(*) AS n, 0.1e0 / avg(x * x + 1) AS eta FROM s GROUP BY g),
 w AS (SELECT g, 0 AS k, 0.5e0 AS w1, -1e0 AS w2 FROM l UNION ALL
  SELECT g, k + 1, w1 + e * x, w2 + e FROM (SELECT w.g, k, w1, w2, xs[k % n + 1] AS x, eta * (ys[k % n + 1] - w1 * xs[k % n + 1] - w2) AS e FROM w JOIN l USING (g) WHERE k < {_STEPS}))
SELECT g, {rsql('w1')} AS w1, {rsql('w2')} AS w2 FROM w WHERE k = {_STEPS}""")
def _(spark, d):
    s = B.table(spark, d, "events").select(F.col("event_type").alias("g"), "ts", "event_id", (F.col("value") / 100).alias("x1"), F.lit(1.0).alias("x2"), (F.col("user_id") / 100).alias("y"))
    w = LA.adapt(s, ["g"], ["ts", "event_id"], ["x1", "x2"], "y", 0.05, w0=[0.5, -1.0], steps=_STEPS)
    return w.select("g", rnd(F.col("w")[0]).alias("w1"), rnd(F.col("w")[1]).alias("w2"))


@query("reg_neighbours", "F10 J10", f"""WITH {B.VECTORS_SQL}, {_Q3SQL}, r AS (SELECT q, label, row_number() OVER (PARTITION BY q ORDER BY sqrt({_D2}), vec_id, label) AS rn FROM vectors, q)
SELECT q, {rsql('avg(label)')} AS forecast FROM r WHERE rn <= 20 GROUP BY q""")
def _(spark, d):
    return LA.forecast_by_neighbours(B.vectors(spark, d), "e", ["vec_id"], "label", _Q3).withColumn("forecast", rnd("forecast"))


# --- transforms --------------------------------------------------------------------------

_DFT = lambda n: f"""{B.VECTORS_SQL}, lng AS (SELECT vec_id, unnest(range({n})) AS j, unnest(e[1:{n}]) AS x FROM vectors),
 f AS (SELECT vec_id, CAST(k AS BIGINT) AS k, sum(x * cos(2 * pi() * ((j * k) % {n}) / {n})) AS re, -sum(x * sin(2 * pi() * ((j * k) % {n}) / {n})) AS im FROM lng, (SELECT unnest(range({n})) AS k) GROUP BY 1, 2)"""


def _transformed(spark, d, n):
    line = B.vectors(spark, d).select("vec_id", F.posexplode(F.slice("e", 1, n)).alias("i", "re")).select("vec_id", F.col("i").cast("bigint").alias("i"), "re", F.lit(0.0).alias("im"))
    return LA.fft_any(line, ["vec_id"], n).select("vec_id", F.col("i").alias("k"), rnd("re").alias("re"), rnd("im").alias("im"))


@query("fft_vectors", "F9", f"WITH {_DFT(64)} SELECT vec_id, k, {rsql('re')} AS re, {rsql('im')} AS im FROM f")
def _(spark, d):
    return _transformed(spark, d, 64)


@query("fft_prime", "F9", f"WITH {_DFT(61)} SELECT vec_id, k, {rsql('re')} AS re, {rsql('im')} AS im FROM f")
def _(spark, d):
    return _transformed(spark, d, 61)


@query("fft_series", "F9", f"""WITH s AS (SELECT event_type AS g, value AS v, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS i FROM events), n AS (SELECT g, CAST(pow(2, ceil(log2(max(i) + 1))) AS BIGINT) AS n FROM s GROUP BY g)
SELECT g, k AS i, {rsql('sum(v * cos(2 * pi() * ((i * k) % n) / n))', 4)} AS re, {rsql('-sum(v * sin(2 * pi() * ((i * k) % n) / n))', 4)} AS im FROM s JOIN n USING (g) JOIN (SELECT g, unnest(range(n)) AS k FROM n) USING (g) GROUP BY 1, 2""")
def _(spark, d):
    s = B.table(spark, d, "events").select(F.col("event_type").alias("g"), "ts", "event_id", F.col("value").alias("re"), F.lit(0.0).alias("im"))
    return LA.fft_series(s, ["g"], ["ts", "event_id"]).select("g", "i", rnd("re", 4).alias("re"), rnd("im", 4).alias("im"))


PIX = f"""{B.CELLS_SQL}, {B.grid_sql(8)}, px AS (SELECT x, y, avg(a) AS v FROM cells GROUP BY 1, 2), sz AS (SELECT max(x) + 1 AS nx, 11 AS ny FROM px)"""


def pixels(spark, d):
    """An image: the channel averaged along z."""
    p = B.cells(spark, d).groupBy("x", "y").agg(F.avg("a").alias("v"))
    g = B.grid_for(spark, d, 4)
    return p, (int(p.agg(F.max("x")).first()[0]) + 1, 11)


_RESPONSE = lambda n: f"(SELECT k, (SELECT sum(exp(-pow(least(f, {n} - f) / CAST({n} AS DOUBLE), 2) / 0.02e0) * cos(2 * pi() * ((f * k) % {n}) / {n})) FROM (SELECT unnest(range({n})) AS f)) / {n} AS w FROM (SELECT unnest(range({n})) AS k))"


@query("fft_plane_lowpass", "F9", f"""WITH {PIX}, n AS (SELECT CAST(pow(2, ceil(log2(greatest(nx, 2)))) AS BIGINT) AS nx, 16 AS ny FROM sz),
 f AS (SELECT unnest(range(nx)) AS f, nx FROM n), kx AS (SELECT k, sum(exp(-pow(least(f, f.nx - f) / CAST(f.nx AS DOUBLE), 2) / 0.02e0) * cos(2 * pi() * ((f * k) % f.nx) / f.nx)) / any_value(f.nx) AS w FROM f, (SELECT unnest(range(nx)) AS k FROM n) GROUP BY k),
 ky AS {_RESPONSE(16)},
 a AS (SELECT (px.x + kx.k) % n.nx AS x, px.y, sum(v * w) AS v FROM px, kx, n GROUP BY 1, 2)
SELECT a.x, CAST((a.y + ky.k) % 16 AS BIGINT) AS y, {rsql('sum(v * w)')} AS v FROM a, ky GROUP BY 1, 2""")
def _(spark, d):
    p, (nx, ny) = pixels(spark, d)
    n2 = lambda n: 1 << max(n - 1, 1).bit_length()
    src = p.select("x", "y", F.col("v").alias("re"), F.lit(0.0).alias("im"))
    out = LA.filter_plane(src, n2(nx), n2(ny), lambda r: F.exp(-(r * r) / (2 * 0.1 * 0.1)))
    return out.select("x", "y", rnd("re").alias("v"))


# --- draws -------------------------------------------------------------------------------

_HU = lambda key, seed, draw: f"src AS (SELECT {key} AS k, CAST({key} * 1000003 + {seed * 131 + draw} AS BIGINT) AS kk FROM orders), " + ", ".join(_mix64_sql("kk")) + ", u AS (SELECT k, (CAST(q5 >> 12 AS DOUBLE) + 0.5e0) * pow(2e0, -52) AS u FROM h5)"
_QN = lambda p: f"(CASE WHEN {p} < 0.02425e0 THEN {_TAIL(p)} WHEN {p} > 0.97575e0 THEN -{_TAIL(f'(1 - {p})')} ELSE ({p} - 0.5e0) * {_horner_sql(f'(({p} - 0.5e0) * ({p} - 0.5e0))', _CENTRE_NUM)} / {_horner_sql(f'(({p} - 0.5e0) * ({p} - 0.5e0))', _CENTRE_DEN)} END)"


@query("rng_uniform_normal", "F12", f"WITH {_HU('o_orderkey', 7, 0)} SELECT k, {rsql('u', 9)} AS u, {rsql(_QN('u'))} AS z FROM u")
def _(spark, d):
    o = B.table(spark, d, "orders").select(F.col("o_orderkey").alias("k"))
    return o.select("k", rnd(R.uniform("k", 7), 9).alias("u"), rnd(R.normal("k", 7)).alias("z"))


_DRAW = lambda seed, draw: f"(WITH {_HU('o_orderkey', seed, draw)} SELECT k, {{}} AS {{}} FROM u)"


def _cdf_at(x: float) -> float:
    """The usual fifth-order approximation of the normal distribution."""
    y = 1 / (1 + 0.2316419 * abs(x))
    t = 0.3989423 * math.exp(-x * x / 2) * y * ((((1.330274 * y - 1.821256) * y + 1.781478) * y - 0.356538) * y + 0.3193815)
    return 1 - t if x > 0 else t


_CUT = f"({_cdf_at(-1.0):.17e} + {_cdf_at(0.5) - _cdf_at(-1.0):.17e} * u)"
_GC = 1 / (9 * 2.5)


@query("rng_truncated_gamma", "F12", f"""SELECT k, {rsql('greatest(least(z, 0.5e0), -1e0)')} AS t, {rsql('greatest(s, 0) * s * s * 2.5e0')} AS gm
 FROM {_DRAW(3, 0).format(_QN(_CUT), 'z')} a JOIN {_DRAW(4, 0).format(f"{_QN('u')} * {_GC ** 0.5:.17e} + {1 - _GC:.17e}", 's')} b USING (k)""")
def _(spark, d):
    o = B.table(spark, d, "orders").select(F.col("o_orderkey").alias("k"))
    return o.select("k", rnd(R.truncated_normal("k", 3, 0.0, 1.0, -1.0, 0.5)).alias("t"), rnd(R.gamma_like("k", 4, 2.5)).alias("gm"))


@query("rng_correlated", "F12", f"""SELECT k, {rsql('sqrt(2e0) * a.z + 1')} AS z0, {rsql('0.6e0 / sqrt(2e0) * a.z + sqrt(0.82e0) * b.z - 2')} AS z1
 FROM {_DRAW(5, 0).format(_QN('u'), 'z')} a JOIN {_DRAW(5, 1).format(_QN('u'), 'z')} b USING (k)""")
def _(spark, d):
    o = B.table(spark, d, "orders").select(F.col("o_orderkey").alias("k"))
    z = R.correlated_normals("k", 5, [1.0, -2.0], [[2.0, 0.6], [0.6, 1.0]])
    return o.select("k", z.alias("z")).select("k", rnd(F.col("z")[0]).alias("z0"), rnd(F.col("z")[1]).alias("z1"))


@query("rng_shuffle", "O3 F12", f"WITH {_HU('o_orderkey', 11, 0)} SELECT k, CAST(row_number() OVER (ORDER BY CASE WHEN q5 >= 9223372036854775808 THEN CAST(q5 AS HUGEINT) - 18446744073709551616 ELSE CAST(q5 AS HUGEINT) END, k) - 1 AS BIGINT) AS i FROM h5")
def _(spark, d):
    return R.shuffled(B.table(spark, d, "orders").select(F.col("o_orderkey").alias("k")), "k", 11).select("k", "i")


@query("vec_sort", "O3 O4", f"WITH {B.VECTORS_SQL} SELECT vec_id, {rsql('list_sort(e)[1]')} AS lo, {rsql('list_sort(e)[33]')} AS mid, {rsql('list_reverse_sort(e)[1]')} AS hi FROM vectors")
def _(spark, d):
    v = B.vectors(spark, d).withColumn("s", F.array_sort("e"))
    return v.select("vec_id", rnd(F.col("s")[0]).alias("lo"), rnd(F.col("s")[32]).alias("mid"), rnd(F.element_at("s", -1)).alias("hi"))


# --- noise ---------------------------------------------------------------------------------

def _noise_sql(tag, src, keys, pos, seed):
    """Gradient noise at positions ``pos`` of every row: its lattice corners, their hashes, directions and fades, summed per ``keys``."""
    n = len(pos)
    cell = ", ".join(f"CAST(floor({p}) AS BIGINT) AS b{k}, {p} - floor({p}) AS t{k}, (corner >> {k}) & 1 AS o{k}" for k, p in enumerate(pos))
    h = f"(({seed}) * 2654435761) & 4294967295"
    for k, prime in zip(range(n), COORD_PRIMES):
        h = f"xor({h}, ((b{k} + o{k}) * {prime}) & 4294967295)"
    fade = " * ".join(f"(CASE o{k} WHEN 1 THEN f{k} ELSE 1 - f{k} END)" for k in range(n))
    sign = lambda k: f"(CASE (h >> {k}) & 1 WHEN 1 THEN 1e0 ELSE -1e0 END) * (t{k} - o{k})"
    if n == 1:
        slope = f"{sign(0)} * (((h >> 1) % 8) + 1) / 8"
    else:
        slope = " + ".join(f"(CASE WHEN {f'(h >> 8) % {n}' if n > 2 else n} = {k} THEN 0e0 ELSE {sign(k)} END)" for k in range(n))
    return f"""{tag}0 AS (SELECT *, {cell} FROM {src}, range({1 << n}) c(corner)), {tag}1 AS (SELECT *, {h} AS h0, {', '.join(f't{k} * t{k} * t{k} * (t{k} * (t{k} * 6 - 15) + 10) AS f{k}' for k in range(n))} FROM {tag}0),
 {tag}2 AS (SELECT *, CAST((xor(h0, h0 >> 16) * 2246822507::HUGEINT) % 4294967296 AS BIGINT) AS h1 FROM {tag}1), {tag}3 AS (SELECT *, CAST((xor(h1, h1 >> 13) * 3266489909::HUGEINT) % 4294967296 AS BIGINT) AS h2 FROM {tag}2),
 {tag}4 AS (SELECT *, xor(h2, h2 >> 16) AS h FROM {tag}3), {tag} AS (SELECT {keys}, sum({fade} * ({slope})) AS v FROM {tag}4 GROUP BY {keys})"""


def _octaves_sql(octaves, alpha, beta):
    """(k, freq, amp): one row per octave, the last one faded in."""
    rows, amp, freq = [], 1.0, 1.0
    for k in range(math.ceil(octaves)):
        rows.append(f"({k}, {freq!r}e0, {amp * min(1.0, octaves - k)!r}e0)")
        amp, freq = amp / alpha, freq * beta
    return f"(SELECT * FROM (VALUES {', '.join(rows)}) t(k, freq, amp))"


_XYZ37 = [f"(p{c} * 0.37e0)" for c in "xyz"]


@query("noise_points", "F11", f"""WITH {B.POINTS_SQL}, p AS (SELECT DISTINCT px, py, pz FROM points), {_noise_sql('a', 'p', 'px, py, pz', _XYZ37, '0')}, {_noise_sql('b', 'p', 'px, py, pz', [*_XYZ37, '0.5e0'], '0')},
 {_noise_sql('d', 'p', 'px, py, pz', _XYZ37[:2], '0')}, {_noise_sql('e', 'p', 'px, py, pz', _XYZ37[:1], '0')}
SELECT px, py, pz, {rsql('a.v')} AS n3, {rsql('b.v')} AS n4, {rsql('d.v')} AS n2, {rsql('e.v')} AS n1 FROM a JOIN b USING (px, py, pz) JOIN d USING (px, py, pz) JOIN e USING (px, py, pz)""")
def _(spark, d):
    p = B.points(spark, d).select("px", "py", "pz").distinct()
    s = [F.col(c) * 0.37 for c in ("px", "py", "pz")]
    return p.select("px", "py", "pz", rnd(N.noise(*s)).alias("n3"), rnd(N.noise(*s, F.lit(0.5))).alias("n4"), rnd(N.noise(s[0], s[1])).alias("n2"), rnd(N.noise(s[0])).alias("n1"))


_XYZ16 = [f"({c} / 16e0 * freq)" for c in "xyz"]


@query("noise_fractal", "F11 S5", f"""WITH {B.CELLS_SQL}, o AS {_octaves_sql(4.5, 1.5, 1.97)}, u AS {_octaves_sql(3, 1.5, 1.97)}, co AS (SELECT x, y, z, k, freq FROM cells, o),
 {_noise_sql('a', 'co', 'x, y, z, k', _XYZ16, 'k')}
SELECT x, y, z, {rsql('sum(o.amp * v)')} AS v, {rsql('sum(u.amp * abs(v))')} AS t FROM a JOIN o USING (k) LEFT JOIN u USING (k) GROUP BY 1, 2, 3""")
def _(spark, d):
    c = B.cells(spark, d).select("x", "y", "z")
    s = [F.col(a) / 16.0 for a in "xyz"]
    return c.select("x", "y", "z", rnd(N.fractal(*s, octaves=4.5)).alias("v"), rnd(N.fractal(*s, octaves=3, turbulence=True)).alias("t"))


# component m takes slopes of two potentials along the two other axes, as central differences: (m, potential, axis, side, weight)
_SLOPES = ", ".join(f"({m}, {which}, {axis}, {side}, {side * sign})" for m, pair in enumerate((((2, 1, 1), (1, 2, -1)), ((0, 2, 1), (2, 0, -1)), ((1, 0, 1), (0, 1, -1))))
                    for which, axis, sign in pair for side in (1, -1))
_CURL_AT = [f"(({c} / 8e0 + 0.3e0 + (CASE WHEN axis = {k} THEN side * 1e-4 ELSE 0 END)) * freq)" for k, c in enumerate("xyz")] + ["(0.25e0 * freq)"]


@query("noise_curl", "F11", f"""WITH {B.CELLS_SQL}, o AS {_octaves_sql(2.0, 2.0, 2.0)}, sl AS (SELECT * FROM (VALUES {_SLOPES}) t(m, which, axis, side, w)),
 co AS (SELECT x, y, z, m, which, axis, side, w, k, freq FROM cells, sl, o), {_noise_sql('a', 'co', 'x, y, z, m, w, which, axis, side, k', _CURL_AT, 'which * 101 + k')},
 g AS (SELECT x, y, z, m, sum(w * amp * v) / 2e-4 AS v FROM a JOIN o USING (k) GROUP BY 1, 2, 3, 4)
SELECT x, y, z, {', '.join(rsql(f'sum(CASE WHEN m = {m} THEN v END)', 4) + f' AS v{c}' for m, c in enumerate('xyz'))} FROM g GROUP BY 1, 2, 3""")
def _(spark, d):
    c = B.cells(spark, d).select("x", "y", "z", N.curl(*[F.col(a) / 8.0 + 0.3 for a in "xyz"], F.lit(0.25), octaves=2.0).alias("c"))
    return c.select("x", "y", "z", *[rnd(F.col("c")[a], 4).alias(f"v{a}") for a in "xyz"])


# --- colour --------------------------------------------------------------------------------

_RGB = f"{B.CELLS_SQL}, q AS (SELECT x, y, z, CAST(floor(a * 255) AS INTEGER) AS r, CAST(b % 256 AS INTEGER) AS g, CAST((x * 7 + y * 13) % 256 AS INTEGER) AS b FROM cells)"


def rgb(spark, d):
    c = B.cells(spark, d)
    return c.select("x", "y", "z", F.floor(F.col("a") * 255).cast("int").alias("r"), (F.col("b") % 256).cast("int").alias("g"), ((F.col("x") * 7 + F.col("y") * 13) % 256).cast("int").alias("b"))


_P = lambda c: f"(((mx - {c}) * 85 + ch // 2) // nullif(ch, 0))"


@query("color_hcl", "F13", f"""WITH {_RGB}, m AS (SELECT *, greatest(r, g, b) AS mx, greatest(r, g, b) - least(r, g, b) AS ch FROM q),
 h AS (SELECT *, CASE WHEN mx = r THEN 85 + {_P('b')} - {_P('g')} WHEN mx = g THEN 255 + {_P('r')} - {_P('b')} ELSE 425 + {_P('g')} - {_P('r')} END AS h0 FROM m)
SELECT x, y, z, CAST(coalesce(CASE WHEN h0 < 0 THEN h0 + 510 WHEN h0 > 509 THEN h0 - 510 ELSE h0 END, 0) AS INTEGER) AS h, ch AS c, CAST((2 * mx - ch) // 2 AS INTEGER) AS l,
 {rsql('0.3e0 * r + 0.5e0 * g + 0.2e0 * b', 4)} AS gray FROM h""")
def _(spark, d):
    q = rgb(spark, d)
    h = CO.rgb_to_hcl("r", "g", "b")
    return q.select("x", "y", "z", *[e.alias(n) for n, e in h.items()], rnd(CO.grey("r", "g", "b"), 4).alias("gray"))


@query("color_hsv", "F6 F13", f"""WITH {_RGB}, u AS (SELECT x, y, z, r / 255e0 AS r, g / 255e0 AS g, b / 255e0 AS b FROM q), m AS (SELECT *, greatest(r, g, b) AS mx, least(r, g, b) AS mn FROM u),
 h AS (SELECT *, CASE WHEN mx = mn THEN 0 ELSE 60e0 * CASE WHEN g > greatest(r, b) THEN (r - g) / (mx - mn) + 4 WHEN b > r THEN (b - r) / (mx - mn) + 2 ELSE (g - b) / (mx - mn) END END AS h0 FROM m)
SELECT x, y, z, {rsql('CASE WHEN h0 < 0 THEN h0 + 360 ELSE h0 END', 4)} AS h, {rsql('CASE WHEN mx > 0 THEN (mx - mn) / mx ELSE 0 END')} AS s, {rsql('mx')} AS v FROM h""")
def _(spark, d):
    q = rgb(spark, d).select("x", "y", "z", *[(F.col(c) / 255.0).alias(c) for c in "rgb"])
    h = CO.rgb_to_hsv("r", "g", "b")
    return q.select("x", "y", "z", rnd(h["h"], 4).alias("h"), rnd(h["s"]).alias("s"), rnd(h["v"]).alias("v"))


_SIX = lambda *e: "CASE least(h // 85, 5) " + " ".join(f"WHEN {i} THEN {x}" for i, x in enumerate(e)) + " END"
_HSV6 = lambda *e: "CASE WHEN sat = 0 THEN val ELSE coalesce(CASE floor(hue) " + " ".join(f"WHEN {i} THEN {x}" for i, x in enumerate(e)) + " END, 0) END"
_HP, _HQ, _HT = "val * (1 - sat)", "val * (1 - sat * (hue - floor(hue)))", "val * (1 - sat * (1 - (hue - floor(hue))))"


@query("color_back", "F13 F6", f"""WITH {_RGB}, m AS (SELECT *, greatest(r, g, b) AS mx, greatest(r, g, b) - least(r, g, b) AS ch FROM q),
 h0 AS (SELECT *, CASE WHEN mx = r THEN 85 + {_P('b')} - {_P('g')} WHEN mx = g THEN 255 + {_P('r')} - {_P('b')} ELSE 425 + {_P('g')} - {_P('r')} END AS hh FROM m),
 h AS (SELECT x, y, z, CAST(coalesce(CASE WHEN hh < 0 THEN hh + 510 WHEN hh > 509 THEN hh - 510 ELSE hh END, 0) AS INTEGER) AS h, ch AS c, (2 * mx - ch) // 2 AS l FROM h0),
 k AS (SELECT *, CASE WHEN l < 128 THEN l * 2 ELSE (255 - l) * 2 END AS room FROM h),
 t AS (SELECT *, CASE WHEN c > room THEN CASE WHEN l < 128 THEN room ELSE 255 END ELSE l + c // 2 END AS top, least(c, room) AS cc FROM k),
 e AS (SELECT *, top - cc AS low, top - cc + cc * ((h // 85 + 1) * 85 - h) // 85 AS dn, top - cc + cc * (h - h // 85 * 85) // 85 AS up FROM t),
 v AS (SELECT *, CAST({_SIX('top', 'top', 'dn', 'low', 'low', 'up')} AS INTEGER) AS r, CAST({_SIX('low', 'up', 'top', 'top', 'dn', 'low')} AS INTEGER) AS g, CAST({_SIX('dn', 'low', 'low', 'up', 'top', 'top')} AS INTEGER) AS b,
  h * 360e0 / 510 / 60 AS hue, c / 255e0 AS sat, l / 255e0 AS val FROM e),
 w AS (SELECT *, sqrt(pow(r / 255e0 - 0.3e0, 2) + pow(g / 255e0 - 0.3e0, 2)) AS s FROM v)
SELECT x, y, z, r, g, b, {rsql('(r / 255e0 - 0.3e0) * coalesce(pow(s, 0.8e0) * 1.1e0 / nullif(s, 0), 1) + 0.3e0')} AS su, {rsql('(g / 255e0 - 0.3e0) * coalesce(pow(s, 0.8e0) * 1.1e0 / nullif(s, 0), 1) + 0.3e0')} AS sv,
 {rsql(_HSV6('val', _HQ, _HP, _HP, _HT, 'val'))} AS hr, {rsql(_HSV6(_HT, 'val', 'val', _HQ, _HP, _HP))} AS hg FROM w""")
def _(spark, d):
    q = rgb(spark, d)
    h = q.select("x", "y", "z", *[e.alias(n) for n, e in CO.rgb_to_hcl("r", "g", "b").items()])
    h = h.select("*", *[e.alias(n) for n, e in CO.hcl_to_rgb("h", "c", "l").items()])
    u, v = CO.saturate(F.col("r") / 255.0, F.col("g") / 255.0, 0.3, 0.3, 0.8, 1.1)
    back = CO.hsv_to_rgb((F.col("h") * 360.0 / 510.0), F.col("c") / 255.0, F.col("l") / 255.0)
    return h.select("x", "y", "z", "r", "g", "b", rnd(u).alias("su"), rnd(v).alias("sv"), rnd(back["r"]).alias("hr"), rnd(back["g"]).alias("hg"))


@query("color_planes", "F13", f"""WITH {_RGB} SELECT x, y, z, {rsql('pow(r / 255e0, 2.22e0)')} AS lin, {rsql('pow(g / 255e0, 1 / 2.22e0)')} AS disp, {rsql('(r / 255e0 + 1) * 127.5e0', 4)} AS py,
 CAST(floor(b / 255e0 * 65535 + 0.5e0) AS INTEGER) AS w FROM q""")
def _(spark, d):
    q = rgb(spark, d).select("x", "y", "z", *[(F.col(c) / 255.0).alias(c) for c in "rgb"])
    pl = CO.plane_bytes("b", "r", "g")
    return q.select("x", "y", "z", rnd(CO.to_linear("r")).alias("lin"), rnd(CO.to_display("g")).alias("disp"), rnd(pl["y"], 4).alias("py"), CO.to_words("b").alias("w"))


_IN = lambda e: f"greatest(least({e}, 255e0), 0e0)"
_LIGHT = lambda r, g, b: f"({r} * 0.3e0 + {g} * 0.5e0 + {b} * 0.2e0)"
_MOVED = [_IN(f"({c} + m * {w}e0)") for c, w in zip("rgb", (0.3, 0.5, 0.2))]
_OUT = lambda c, e: rsql(f"CASE WHEN r BETWEEN 0 AND 255 AND g BETWEEN 0 AND 255 AND b BETWEEN 0 AND 255 THEN {c} ELSE {e} END", 4)


@query("color_clip", "F13", f"""WITH {_RGB}, c AS (SELECT x, y, z, r * 1.5e0 - 40 AS r, g * 1.2e0 AS g, b - 20e0 AS b FROM q),
 s AS (SELECT *, {_IN(_LIGHT('r', 'g', 'b'))} AS aim, unnest([-r / 0.3e0, (255 - r) / 0.3e0, -g / 0.5e0, (255 - g) / 0.5e0, -b / 0.2e0, (255 - b) / 0.2e0]) AS m FROM c),
 k AS (SELECT *, {_LIGHT(*_MOVED)} AS light FROM s),
 e AS (SELECT x, y, z, r, g, b, aim, max(light) FILTER (light <= aim) AS y0, max(m) FILTER (light <= aim) AS m0, min(light) FILTER (light >= aim) AS y1, min(m) FILTER (light >= aim) AS m1 FROM k GROUP BY ALL),
 f AS (SELECT *, coalesce(m0 + (m1 - m0) * ((aim - y0) / nullif(y1 - y0, 0)), m0, m1) AS m FROM e)
SELECT x, y, z, {', '.join(f"{_OUT(c, e)} AS {c}" for c, e in zip('rgb', _MOVED))} FROM f""")
def _(spark, d):
    q = rgb(spark, d).select("x", "y", "z", (F.col("r") * 1.5 - 40).alias("r"), (F.col("g") * 1.2).alias("g"), (F.col("b") - 20).alias("b"))
    out = q.select("x", "y", "z", CO.clip_rgb("r", "g", "b").alias("c"))
    return out.select("x", "y", "z", *[rnd(F.col("c")[n], 4).alias(n) for n in "rgb"])


# --- images --------------------------------------------------------------------------------

def _tap_sql(cols):
    rd = lambda dx, dy: f"(SELECT v FROM px n WHERE n.x = greatest(least(p.x + {dx}, nx - 1), 0) AND n.y = greatest(least(p.y + {dy}, ny - 1), 0))"
    return rd


def _joined(offsets):
    js = " ".join(f"LEFT JOIN px n{i} ON n{i}.x = greatest(least(p.x + {dx}, nx - 1), 0) AND n{i}.y = greatest(least(p.y + {dy}, ny - 1), 0)" for i, (dx, dy) in enumerate(offsets))
    vs = ", ".join(f"coalesce(n{i}.v, 0) AS {IM.tap(o)}" for i, o in enumerate(offsets))
    return f"w AS (SELECT p.x, p.y, p.v, {vs} FROM px p, sz {js})".replace("FROM px p, sz LEFT", "FROM px p CROSS JOIN sz LEFT")


_T = lambda dx, dy: "v" if (dx, dy) == (0, 0) else IM.tap((dx, dy))


@query("img_gradients", "F14", f"""WITH {PIX}, {_joined(IM.RING)} SELECT x, y, {rsql(f'({_T(1, 0)} - {_T(-1, 0)}) / 2')} AS cx, {rsql(f'({_T(0, 1)} - {_T(0, -1)}) / 2')} AS cy, {rsql(f'{_T(1, 0)} - v')} AS fx, {rsql(f'v - {_T(0, -1)}')} AS by_,
 {rsql(f'0.25e0 * (2 - sqrt(2e0)) * ({_T(1, 1)} - {_T(-1, -1)} + {_T(1, -1)} - {_T(-1, 1)}) + 0.5e0 * (sqrt(2e0) - 1) * ({_T(1, 0)} - {_T(-1, 0)})')} AS rx FROM w""")
def _(spark, d):
    p, size = pixels(spark, d)
    g = IM.gradients(p, "v", size, ("central", "forward", "backward", "rotation"))
    return g.select("x", "y", rnd("central.gx").alias("cx"), rnd("central.gy").alias("cy"), rnd("forward.gx").alias("fx"),
                    rnd("backward.gy").alias("by_"), rnd("rotation.gx").alias("rx"))


_SX = f"({_T(1, -1)} - {_T(-1, -1)}) + 2 * ({_T(1, 0)} - {_T(-1, 0)}) + ({_T(1, 1)} - {_T(-1, 1)})"
_SY = f"({_T(-1, -1)} - {_T(-1, 1)}) + 2 * ({_T(0, -1)} - {_T(0, 1)}) + ({_T(1, -1)} - {_T(1, 1)})"


@query("img_sobel", "F14", f"""WITH {PIX}, {_joined(IM.RING)}, g AS (SELECT x, y, {_SX} AS gx, {_SY} AS gy FROM w), s AS (SELECT avg(gx) AS ax, stddev_pop(gx) AS sx, avg(gy) AS ay, stddev_pop(gy) AS sy, max(sqrt(gx * gx + gy * gy)) AS mm FROM g)
SELECT x, y, {rsql('(gx - ax) / s.sx')} AS gx, {rsql('(gy - ay) / s.sy')} AS gy, {rsql('sqrt(gx * gx + gy * gy) / mm')} AS gm FROM g, s""")
def _(spark, d):
    p, size = pixels(spark, d)
    s = IM.sobel_standardised(p, "v", size)
    return s.select("x", "y", rnd("gx").alias("gx"), rnd("gy").alias("gy"), rnd("gm").alias("gm"))


def _shape_sql(centre, side, corner):
    """A 3x3 window with equal sides and equal corners, over its sum."""
    ring = f"{side} * ({_T(1, 0)} + {_T(-1, 0)} + {_T(0, 1)} + {_T(0, -1)}) + {corner} * ({_T(1, 1)} + {_T(1, -1)} + {_T(-1, 1)} + {_T(-1, -1)})"
    return f"(({centre} * v + {ring}) / ({centre} + 4 * {side} + 4 * {corner}))"


_BELL = ("exp(-8e0 / 9)", "exp(-16e0 / 9)")
_GAUSS_SQL, _FLAT_SQL = _shape_sql("1e0", *_BELL), _shape_sql("1e0", "1e0", "1e0")
_CONE_SQL = _shape_sql("1e0", "(2e0 / 3)", "(1 - sqrt(2e0) / 3)")
_HAT_SQL = _shape_sql(f"(2 * (1 + 4 * {_BELL[0]} + 4 * {_BELL[1]}) + 1)", f"(-{_BELL[0]})", f"(-{_BELL[1]})")


@query("img_smooth", "F14", f"WITH {PIX}, {_joined(IM.RING)} SELECT x, y, {rsql(_GAUSS_SQL)} AS gauss, {rsql(_FLAT_SQL)} AS flat, {rsql(_CONE_SQL)} AS cone, {rsql(_HAT_SQL)} AS hat FROM w")
def _(spark, d):
    p, size = pixels(spark, d)
    k = {"gauss": IM.kernel("gauss", 3), "flat": IM.kernel("flat", 3), "cone": IM.kernel("cone", 3, 1.0), "hat": IM.kernel("hat", 3, 1.0, 2.0)}
    w = IM.window(p, "v", size, k)
    return w.select("x", "y", *[rnd(n).alias(n) for n in k])


@query("img_resize", "F14", f"""WITH {PIX}, t AS (SELECT i % (nx * 2) AS x, i // (nx * 2) AS y, nx, ny FROM (SELECT unnest(range(nx * 2 * 22)) AS i, nx, ny FROM sz)),
 q AS (SELECT *, greatest(least((x + 0.5e0) / 2 - 0.5e0, nx - 1), 0) AS qx, greatest(least((y + 0.5e0) / 2 - 0.5e0, ny - 1), 0) AS qy FROM t),
 r AS (SELECT q.x, q.y, sum((CASE i WHEN 0 THEN 1 - (qx - floor(qx)) ELSE qx - floor(qx) END) * (CASE j WHEN 0 THEN 1 - (qy - floor(qy)) ELSE qy - floor(qy) END) * n.v) AS v FROM q, range(2) a(i), range(2) c(j) JOIN px n ON n.x = CAST(floor(qx) AS BIGINT) + i AND n.y = CAST(floor(qy) AS BIGINT) + j GROUP BY 1, 2)
SELECT t.x, t.y, {rsql('coalesce(v, 0)')} AS v FROM t LEFT JOIN r USING (x, y)""")
def _(spark, d):
    p, (nx, ny) = pixels(spark, d)
    return IM.resize(p, "v", (nx, ny), (nx * 2, ny * 2)).select("x", "y", rnd("v").alias("v"))


@query("img_pyramid", "F14", f"""WITH {PIX}, k AS (SELECT * FROM (VALUES (-2, 0.05e0), (-1, 0.25e0), (0, 0.4e0), (1, 0.25e0), (2, 0.05e0)) t(d, w)),
 t AS (SELECT i % ((nx + 1) // 2) AS x, i // ((nx + 1) // 2) AS y, nx, ny FROM (SELECT unnest(range(((nx + 1) // 2) * 6)) AS i, nx, ny FROM sz))
SELECT t.x, t.y, {rsql('sum(a.w * b.w * n.v)')} AS v FROM t, k a, k b JOIN px n ON n.x = greatest(least(2 * t.x + a.d, nx - 1), 0) AND n.y = greatest(least(2 * t.y + b.d, ny - 1), 0) GROUP BY 1, 2""")
def _(spark, d):
    p, size = pixels(spark, d)
    return IM.pyramid(p, size, "v", 1)[1].select("x", "y", rnd("v").alias("v"))


def _moved_sql(d):
    """All pixels of the d x d window of each pixel, moved into the image, absent ones 0."""
    at = lambda c, n: f"greatest(least(p.{c} - {d // 2}, {n} - {d}), 0)"
    return f"""win AS (SELECT p.x, p.y, list(coalesce(q.v, 0e0)) AS w FROM px p CROSS JOIN sz CROSS JOIN range({d}) a(i) CROSS JOIN range({d}) b(j)
  LEFT JOIN px q ON q.x = {at('x', 'nx')} + i AND q.y = {at('y', 'ny')} + j GROUP BY 1, 2)"""


@query("img_median", "F14", f"""WITH {PIX}, {_moved_sql(5)} SELECT x, y, {rsql('list_sort(w)[13]')} AS median, {rsql('list_min(w)')} AS lo, {rsql('list_max(w)')} AS hi FROM win""")
def _(spark, d):
    p, size = pixels(spark, d)
    m = IM.moving(p, "v", size, 5, {"median": "median", "lo": "min", "hi": "max"})
    return m.select("x", "y", *[rnd(n).alias(n) for n in ("median", "lo", "hi")])


# any function of the window: the mean of the five middle values of nine, and how far the ends lie apart
@query("img_window", "F14", f"""WITH {PIX}, {_moved_sql(3)} SELECT x, y, {rsql('list_avg(list_sort(w)[3:7])')} AS middle, {rsql('list_max(w) - list_min(w)')} AS reach,
 {rsql('list_sort(w)[3]')} AS quarter, {rsql('list_avg(w)')} AS mean FROM win""")
def _(spark, d):
    p, size = pixels(spark, d)
    own = {"middle": IM.window_function(lambda w: np.sort(w, axis=1)[:, 2:7].mean(axis=1)), "reach": IM.window_function(lambda w: np.ptp(w, axis=1)),
           "quarter": IM.rank_window(0.25), "mean": "mean"}
    return IM.moving(p, "v", size, 3, own).select("x", "y", *[rnd(n).alias(n) for n in own])


_FIVE = "k AS (SELECT * FROM (VALUES (-2, 0.05e0), (-1, 0.25e0), (0, 0.4e0), (1, 0.25e0), (2, 0.05e0)) t(d, w))"
_COARSE = """n1 AS (SELECT (nx + 1) // 2 AS nx, (ny + 1) // 2 AS ny FROM sz), t1 AS (SELECT i % n1.nx AS x, i // n1.nx AS y FROM (SELECT unnest(range(nx * ny)) AS i FROM n1), n1),
 g1 AS (SELECT t1.x, t1.y, sum(a.w * b.w * p.v) AS v FROM t1, sz, k a, k b JOIN px p ON p.x = greatest(least(2 * t1.x + a.d, nx - 1), 0) AND p.y = greatest(least(2 * t1.y + b.d, ny - 1), 0) GROUP BY 1, 2)"""
_FINE = """t0 AS (SELECT i % nx AS x, i // nx AS y FROM (SELECT unnest(range(nx * ny)) AS i, nx, ny FROM sz)),
 e0 AS (SELECT t0.x, t0.y, sum(4 * a.w * b.w * coalesce(g1.v, 0)) AS v FROM t0, n1, k a, k b LEFT JOIN g1 ON g1.x = greatest(least((t0.x + a.d) // 2, n1.nx - 1), 0) AND g1.y = greatest(least((t0.y + b.d) // 2, n1.ny - 1), 0)
  WHERE (t0.x + a.d) % 2 = 0 AND (t0.y + b.d) % 2 = 0 GROUP BY 1, 2)"""


@query("img_laplacian", "F14", f"WITH {PIX}, {_FIVE}, {_COARSE}, {_FINE} SELECT t0.x, t0.y, {rsql('1000 * (coalesce(px.v, 0) - coalesce(e0.v, 0))', 4)} AS v FROM t0 LEFT JOIN e0 USING (x, y) LEFT JOIN px USING (x, y)")
def _(spark, d):
    p, size = pixels(spark, d)
    own = IM.laplacian_pyramid(IM.pyramid(p, size, "v", 1), size, "v")[0]
    return _everywhere(spark, own, size).select("x", "y", rnd("v", 4).alias("v"))


def _everywhere(spark, pixels_, size):
    """Every pixel of the image, 0 where nothing is stored or lands."""
    nx, ny = size
    at = spark.range(nx * ny).select((F.col("id") % nx).alias("x"), F.floor(F.col("id") / nx).cast("bigint").alias("y"))
    return at.join(pixels_, ["x", "y"], "left").select("x", "y", F.coalesce("v", F.lit(0.0)).alias("v"))


@query("img_reconstruct", "F14", f"WITH {PIX}, t0 AS (SELECT i % nx AS x, i // nx AS y FROM (SELECT unnest(range(nx * ny)) AS i, nx, ny FROM sz)) SELECT t0.x, t0.y, {rsql('coalesce(px.v, 0)')} AS v FROM t0 LEFT JOIN px USING (x, y)")
def _(spark, d):
    p, size = pixels(spark, d)
    back = IM.reconstruct(IM.laplacian_pyramid(IM.pyramid(p, size, "v", 2), size, "v"), size, "v")
    return _everywhere(spark, back, size).select("x", "y", rnd("v").alias("v"))


@query("img_diff", "F14 A24", f"""WITH {_RGB}, p AS (SELECT x, y, max(r) AS r, max(g) AS g, min(b) AS b FROM q GROUP BY 1, 2), o AS (SELECT x, y, min(r) AS r, max(g) AS g, max(b) AS b FROM q GROUP BY 1, 2),
 df AS (SELECT CAST(abs(p.r - o.r) + abs(p.g - o.g) + abs(p.b - o.b) AS DOUBLE) AS d FROM p JOIN o USING (x, y)) SELECT CAST(count(*) AS BIGINT) AS n, {rsql('avg(d)')} AS avg, {rsql('stddev_pop(d)')} AS var, min(d) AS min, max(d) AS max FROM df""")
def _(spark, d):
    q = rgb(spark, d)
    a = q.groupBy("x", "y").agg(F.max("r").alias("r"), F.max("g").alias("g"), F.min("b").alias("b"))
    b = q.groupBy("x", "y").agg(F.min("r").alias("r"), F.max("g").alias("g"), F.max("b").alias("b"))
    return IM.difference(a, b, ["r", "g", "b"]).select("n", rnd("avg").alias("avg"), rnd("var").alias("var"), "min", "max")


# every pixel of every tile that has one, black where nothing is stored
@query("img_png_tiles", "S7 S8", f"""WITH {PIX}, t AS (SELECT DISTINCT x // 128 AS tx, y // 128 AS ty FROM px),
 all_ AS (SELECT tx * 128 + i AS x, ty * 128 + j AS y FROM t, range(128) a(i), range(128) b(j)), c AS (SELECT x, y, greatest(least(v, 1), 0) AS t FROM px)
SELECT all_.x, all_.y, CAST(coalesce(floor(t * 255 + 0.5e0), 0) AS INTEGER) AS r, CAST(coalesce(floor((1 - abs(2 * t - 1)) * 255 + 0.5e0), 0) AS INTEGER) AS g,
 CAST(coalesce(floor((1 - t) * 255 + 0.5e0), 0) AS INTEGER) AS b FROM all_ LEFT JOIN c USING (x, y)""")
def _(spark, d):
    p, _ = pixels(spark, d)
    t = BK.png_tiles(colour_map(p, "v", 0.0, 1.0), 128)
    return BK.read_png_tiles(t, 128)


# --- text ----------------------------------------------------------------------------------

@query("text_lines", "S10", """WITH l AS (SELECT doc_id, string_split(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)) AS ls FROM documents)
SELECT doc_id, CAST(len(ls) AS BIGINT) AS n_lines, CAST(list_max(list_transform(ls, lambda s: length(s))) AS INTEGER) AS longest FROM l""")
def _(spark, d):
    ls = TX.lines(B.table(spark, d, "documents").select("doc_id", "text"), "text")
    return ls.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.max(F.length("line")).alias("longest"))


@query("text_numbers", "S10", """WITH p AS (SELECT event_id, regexp_extract(props, ':\\s*([^}]*)', 1) AS s FROM events) SELECT event_id, TRY_CAST(trim(s) AS BIGINT) AS n, TRY_CAST(trim(s) AS DOUBLE) AS f FROM p""")
def _(spark, d):
    p = B.table(spark, d, "events").select("event_id", F.regexp_extract("props", r":\s*([^}]*)", 1).alias("s"))
    return p.select("event_id", TX.parse_int("s").alias("n"), TX.parse_float("s").alias("f"))


@query("text_glob", "F16", """SELECT p_partkey, p_name LIKE '%ring%' AS has_ring, p_name LIKE '_ed %' AS q, starts_with(p_name, 'blue') AS pre, p_name ILIKE 'SMALL%' AS ci, p_brand LIKE 'Brand#1%' AS esc FROM part""")
def _(spark, d):
    p = B.table(spark, d, "part")
    return p.select("p_partkey", TX.glob("p_name", "*ring*").alias("has_ring"), TX.glob("p_name", "?ed *").alias("q"), TX.glob("p_name", "blue", prefix=True).alias("pre"),
                    TX.glob("p_name", "SMALL*", ignore_case=True).alias("ci"), TX.glob("p_brand", r"Brand\#1*").alias("esc"))
