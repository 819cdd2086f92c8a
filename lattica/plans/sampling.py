"""Interpolation, slices, projections and prefix lookups."""

import re

from pyspark.sql import functions as F

from lattica.functions import keys as K
from lattica.operators import halo as H, interp as I, slices as L
from lattica.plans.common import BID, rnd, rsql
from lattica.plans.registry import query
from lattica.sources import tables as B

F64 = "float64"
G8 = B.grid_sql(8)
PTS = f"{B.CELLS_SQL}, {B.POINTS_SQL}, {G8}"
_CL = lambda e, n: f"greatest(least({e}, {n} - 1), 0)"


def sampled(spark, d, kind, **kw):
    g = B.grid_for(spark, d, 8)
    packed = H.pack(B.cells(spark, d), g, "a", dtype=F64)
    pts = B.points(spark, d).select("px", "py", "pz")
    return I.sample(pts, packed, g, kind, dtype=F64, **kw)


def rounded(df, *names):
    return df.select("px", "py", "pz", *[rnd(n).alias(n) for n in names])


def window_sql(shift, weights, lo, extra=(), fade=False):
    """Weighted window read per point: ``weights`` give SQL text per tap as a function of t."""
    fr = lambda c: f"(p{c} - {shift}e0 - floor(p{c} - {shift}e0))"
    pre = f"q AS (SELECT DISTINCT px, py, pz, sx, {', '.join(f'CAST(floor(p{c} - {shift}e0) AS BIGINT) AS i{c}, {fr(c)} AS t{c}' for c in 'xyz')} FROM points, grid)"
    if fade:
        f = lambda c: f"(t{c} * t{c} * t{c} * (t{c} * (t{c} * 6 - 15) + 10))"
        pre += f", q2 AS (SELECT * REPLACE ({', '.join(f'{f(c)} AS t{c}' for c in 'xyz')}) FROM q)"
    n = len(weights)
    k = lambda c, ws: "CASE k" + c + " " + " ".join(f"WHEN {i} THEN {re.sub(r'\bT\b', 't' + c, w)}" for i, w in enumerate(ws)) + " END"
    cols = {"value": (weights, weights, weights)} | dict(extra)
    sums = ", ".join(rsql("sum(" + " * ".join(f"({k(c, ws)})" for c, ws in zip("xyz", trio)) + " * coalesce(a, 0))") + f" AS {name}" for name, trio in cols.items())
    return f"""WITH {PTS}, {pre}, w AS (SELECT px, py, pz, {sums} FROM {'q2' if fade else 'q'}, range({n}) rx(kx), range({n}) ry(ky), range({n}) rz(kz)
  LEFT JOIN cells c ON c.x = {_CL(f'ix + kx + {lo}', 'sx')} AND c.y = {_CL(f'iy + ky + {lo}', '16')} AND c.z = {_CL(f'iz + kz + {lo}', '16')} GROUP BY 1, 2, 3)
SELECT points.px, points.py, points.pz, {', '.join(cols)} FROM points JOIN w USING (px, py, pz)"""


def channels_sql(shift, lo, sets, channels):
    """Several channels through one window: ``sets`` gives weight trios by suffix, ``channels`` SQL over a cell's values."""
    fr = lambda c: f"(p{c} - {shift}e0 - floor(p{c} - {shift}e0))"
    n = len(next(iter(sets.values()))[0])
    k = lambda c, ws: "CASE k" + c + " " + " ".join(f"WHEN {i} THEN {re.sub(r'\bT\b', 't' + c, w)}" for i, w in enumerate(ws)) + " END"
    sums = {f"{name}{suffix}": rsql("sum(" + " * ".join(f"({k(c, ws)})" for c, ws in zip("xyz", trio)) + f" * coalesce({v}, 0))")
            for name, v in channels.items() for suffix, trio in sets.items()}
    return f"""WITH {PTS}, q AS (SELECT DISTINCT px, py, pz, sx, {', '.join(f'CAST(floor(p{c} - {shift}e0) AS BIGINT) AS i{c}, {fr(c)} AS t{c}' for c in 'xyz')} FROM points, grid),
 w AS (SELECT px, py, pz, {', '.join(f'{e} AS {name}' for name, e in sums.items())} FROM q, range({n}) rx(kx), range({n}) ry(ky), range({n}) rz(kz)
  LEFT JOIN cells c ON c.x = {_CL(f'ix + kx + {lo}', 'sx')} AND c.y = {_CL(f'iy + ky + {lo}', '16')} AND c.z = {_CL(f'iz + kz + {lo}', '16')} GROUP BY 1, 2, 3)
SELECT points.px, points.py, points.pz, {', '.join(sums)} FROM points JOIN w USING (px, py, pz)"""


def sampled_channels(spark, d, kind, channels):
    """All channels packed into the same blocks and sampled together."""
    g = B.grid_for(spark, d, 8)
    cells = B.cells(spark, d).select("x", "y", "z", *[e.alias(n) for n, e in channels.items()])
    packed = H.pack(cells, g, list(channels), dtype=F64)
    return I.sample(B.points(spark, d).select("px", "py", "pz"), packed, g, kind, dtype=F64, channels=list(channels))


LIN = ["1 - T", "T"]


@query("interp_vector", "K20", channels_sql(0.5, 0, {"": (LIN, LIN, LIN)}, {"vx": "a", "vy": "b / 1000e0", "vz": "(a * c.y - c.z)"}))
def _(spark, d):
    vector = {"vx": F.col("a"), "vy": F.col("b") / 1000.0, "vz": F.col("a") * F.col("y") - F.col("z")}
    return rounded(sampled_channels(spark, d, "linear", vector), *vector)


@query("interp_nearest", "K19 P12", f"""WITH {PTS} SELECT px, py, pz, {rsql('coalesce(a, 0)')} AS value FROM points LEFT JOIN cells ON x = CAST(floor(px) AS BIGINT) AND y = CAST(floor(py) AS BIGINT) AND z = CAST(floor(pz) AS BIGINT)""")
def _(spark, d):
    return rounded(sampled(spark, d, "nearest"), "value")


@query("interp_linear", "K19 K20", window_sql(0.5, LIN, 0))
def _(spark, d):
    return rounded(sampled(spark, d, "linear"), "value")


@query("interp_linear_corner", "K19", window_sql(0.0, LIN, 0))
def _(spark, d):
    return rounded(sampled(spark, d, "linear", corner=True), "value")


@query("interp_linear_fade", "K19", window_sql(0.5, LIN, 0, fade=True))
def _(spark, d):
    return rounded(sampled(spark, d, "linear", fade_weights=True), "value")


CUB = ["-T / 2 + T * T - T * T * T / 2", "1 - 2.5e0 * T * T + 1.5e0 * T * T * T", "T / 2 + 2 * T * T - 1.5e0 * T * T * T", "-T * T / 2 + T * T * T / 2"]


@query("interp_cubic", "K19", window_sql(0.5, CUB, -1))
def _(spark, d):
    return rounded(sampled(spark, d, "cubic"), "value")


def lines_sql(rule):
    """A four-point line rule along x, then y, then z; ``rule`` is SQL over p0..p3 and t."""
    fr = lambda c: f"(p{c} - 0.5e0 - floor(p{c} - 0.5e0))"
    pick = lambda k, v: ", ".join(f"max(CASE WHEN {k} = {i} THEN {v} END) AS p{i}" for i in range(4))
    at = "px, py, pz, tx, ty, tz"
    return f"""WITH {PTS}, q AS (SELECT DISTINCT px, py, pz, sx, {', '.join(f'CAST(floor(p{c} - 0.5e0) AS BIGINT) AS i{c}, {fr(c)} AS t{c}' for c in 'xyz')} FROM points, grid),
 w AS (SELECT {at}, kx, ky, kz, coalesce(a, 0e0) AS v FROM q, range(4) rx(kx), range(4) ry(ky), range(4) rz(kz)
  LEFT JOIN cells c ON c.x = {_CL('ix + kx - 1', 'sx')} AND c.y = {_CL('iy + ky - 1', '16')} AND c.z = {_CL('iz + kz - 1', '16')}),
 x0 AS (SELECT {at}, tx AS t, ky, kz, {pick('kx', 'v')} FROM w GROUP BY ALL), x1 AS (SELECT {at}, ky, kz, {rule} AS v FROM x0),
 y0 AS (SELECT {at}, ty AS t, kz, {pick('ky', 'v')} FROM x1 GROUP BY ALL), y1 AS (SELECT {at}, kz, {rule} AS v FROM y0),
 z0 AS (SELECT {at}, tz AS t, {pick('kz', 'v')} FROM y1 GROUP BY ALL), z1 AS (SELECT px, py, pz, {rsql(rule)} AS value FROM z0)
SELECT px, py, pz, value FROM points JOIN z1 USING (px, py, pz)"""


def hermite_sql(m1, m2):
    d = "(p2 - p1)"
    return f"(p1 + t * ({m1} + t * ((3 * {d} - 2 * {m1} - {m2}) + t * ({m1} + {m2} - 2 * {d}))))"


_AGREE = "(p2 - p0) / 2 * ((p3 - p1) / 2) > 0"
MONO = hermite_sql(*(f"(CASE WHEN {_AGREE} THEN {m} ELSE 0e0 END)" for m in ("(p2 - p0) / 2", "(p3 - p1) / 2")))
_HARM = lambda a, b: f"(CASE WHEN {a} * {b} > 1e-12 THEN 2 * {a} * {b} / ({a} + {b}) ELSE 0e0 END)"
MONO2 = hermite_sql(_HARM("(p1 - p0)", "(p2 - p1)"), _HARM("(p2 - p1)", "(p3 - p2)"))


def weno_sql():
    """Slope and curvature of each parabola, squared and integrated from 0 to 1 in closed form."""
    sides = []
    for a, b, c, x, linear in (("p0", "p1", "p2", "t", "(2 - t)"), ("p1", "p2", "p3", "(t - 1)", "(1 + t)")):
        mid, bend, off = f"(({c} - {a}) / 2)", f"({a} - 2 * {b} + {c})", "0" if a == "p0" else "1"
        lo, hi = f"({mid} - {off} * {bend})", f"({mid} + (1 - {off}) * {bend})"
        rough = f"(({lo} * {lo} + {lo} * {hi} + {hi} * {hi}) / 3 + {bend} * {bend})"
        sides.append((f"({linear} / pow(1e-6 + {rough}, 2))", f"({b} + {x} * ({mid} + {bend} * {x} / 2))"))
    (wa, ga), (wb, gb) = sides
    return f"(({wa} * {ga} + {wb} * {gb}) / ({wa} + {wb}))"


@query("interp_mono", "K19", lines_sql(MONO))
def _(spark, d):
    return rounded(sampled(spark, d, "mono"), "value")


@query("interp_mono2", "K19", lines_sql(MONO2))
def _(spark, d):
    return rounded(sampled(spark, d, "mono2"), "value")


@query("interp_weno", "K19", lines_sql(weno_sql()))
def _(spark, d):
    return rounded(sampled(spark, d, "weno"), "value")


_S3 = ["pow(1 - T, 3) / 6", "2e0 / 3 - T * T * (2 - T) / 2", "2e0 / 3 - (1 - T) * (1 - T) * (1 + T) / 2", "T * T * T / 6"]
_D3 = ["-(1 - T) * (1 - T) / 2", "1.5e0 * T * T - 2 * T", "2 * (1 - T) - 1.5e0 * (1 - T) * (1 - T)", "T * T / 2"]
_C3 = ["1 - T", "3 * T - 2", "1 - 3 * T", "T"]


@query("interp_bspline3", "K21", window_sql(0.5, _S3, -1, {"gx": (_D3, _S3, _S3), "gy": (_S3, _D3, _S3), "gz": (_S3, _S3, _D3)}))
def _(spark, d):
    return rounded(sampled(spark, d, "bspline3"), "value", "gx", "gy", "gz")


@query("interp_multi", "K20 K21", channels_sql(0.5, -1, {"": (_S3, _S3, _S3), "_gx": (_D3, _S3, _S3), "_gy": (_S3, _D3, _S3), "_gz": (_S3, _S3, _D3)},
                                               {"va": "a", "vb": "b / 1000e0"}))
def _(spark, d):
    channels = {"va": F.col("a"), "vb": F.col("b") / 1000.0}
    return rounded(sampled_channels(spark, d, "bspline3", channels), *[f"{c}{s}" for c in channels for s in ("", "_gx", "_gy", "_gz")])


@query("interp_hessian", "K21", window_sql(0.5, _S3, -1, {"hxx": (_C3, _S3, _S3), "hyz": (_S3, _D3, _D3), "hxy": (_D3, _D3, _S3)}))
def _(spark, d):
    return rounded(sampled(spark, d, "hessian"), "value", "hxx", "hyz", "hxy")


# quadratic weights count down from the upper cell edge, so t = 1 - fraction (0 on an edge)
_U = "(CASE WHEN T = 0 THEN 0 ELSE 1 - T END)"
_S2 = [f"{_U} * {_U} / 2", f"0.5e0 + {_U} * (1 - {_U})", f"(1 - {_U}) * (1 - {_U}) / 2"]
_D2 = [f"-{_U}", f"2 * {_U} - 1", f"1 - {_U}"]


@query("interp_bspline2", "K21", window_sql(0.0, _S2, -1, {"gx": (_D2, _S2, _S2), "gy": (_S2, _D2, _S2), "gz": (_S2, _S2, _D2)}))
def _(spark, d):
    return rounded(sampled(spark, d, "bspline2"), "value", "gx", "gy", "gz")


_DL = ["-1", "1"]


@query("interp_gradient", "K21", window_sql(0.0, LIN, 0, {"gx": (_DL, LIN, LIN), "gy": (LIN, _DL, LIN), "gz": (LIN, LIN, _DL)}))
def _(spark, d):
    return rounded(sampled(spark, d, "gradient"), "value", "gx", "gy", "gz")


@query("slice_planes", "K24", f"""WITH {PTS} SELECT 'x' AS axis, y AS u, z AS w, {rsql('a')} AS v FROM cells WHERE x = 40 UNION ALL SELECT 'y', x, z, {rsql('a')} FROM cells WHERE y = 5 UNION ALL SELECT 'z', x, y, {rsql('a')} FROM cells WHERE z = 4""")
def _(spark, d):
    return L.slices(B.cells(spark, d), (40, 5, 4), "a").select("axis", "u", "w", rnd("v").alias("v"))


@query("slice_colors", "K24 F13", f"""WITH {PTS}, s AS (SELECT x AS u, y AS w, greatest(least(a, 1), 0) AS t FROM cells WHERE z = 4) SELECT u, w, CAST(floor(t * 255 + 0.5e0) AS INTEGER) AS r,
 CAST(floor((1 - abs(2 * t - 1)) * 255 + 0.5e0) AS INTEGER) AS g, CAST(floor((1 - t) * 255 + 0.5e0) AS INTEGER) AS b FROM s""")
def _(spark, d):
    s = L.slices(B.cells(spark, d), (40, 5, 4), "a").where("axis = 'z'")
    return L.colour_map(s, "v", 0.0, 1.0).select("u", "w", "r", "g", "b")


@query("slice_resampled", "K24 K19", f"""WITH {PTS}, px AS (SELECT i % (sx * 2) AS u, i // (sx * 2) AS w, (i % (sx * 2) + 0.5e0) / 2 AS px, (i // (sx * 2) + 0.5e0) / 2 AS py, 4.3e0 AS pz, sx FROM (SELECT unnest(range(sx * 2 * 32)) AS i, sx FROM grid)),
 q AS (SELECT *, {', '.join(f'CAST(floor(p{c} - 0.5e0) AS BIGINT) AS i{c}, p{c} - 0.5e0 - floor(p{c} - 0.5e0) AS t{c}' for c in 'xyz')} FROM px)
SELECT u, w, {rsql('sum((CASE kx WHEN 0 THEN 1 - tx ELSE tx END) * (CASE ky WHEN 0 THEN 1 - ty ELSE ty END) * (CASE kz WHEN 0 THEN 1 - tz ELSE tz END) * coalesce(a, 0))')} AS v
FROM q, range(2) rx(kx), range(2) ry(ky), range(2) rz(kz) LEFT JOIN cells c ON c.x = {_CL('ix + kx', 'sx')} AND c.y = {_CL('iy + ky', '16')} AND c.z = {_CL('iz + kz', '16')} GROUP BY 1, 2""")
def _(spark, d):
    g = B.grid_for(spark, d, 8)
    packed = H.pack(B.cells(spark, d), g, "a", dtype=F64)
    px = L.plane_pixels(spark, g, "z", 4.3, 2)
    return I.sample(px, packed, g, "linear", dtype=F64).select("u", "w", rnd("value").alias("v"))


@query("slice_levels", "K24 G14", f"""WITH {PTS}, b AS (SELECT {BID(3)} AS bid, x >> 3 AS bx, y >> 3 AS byy, count(*) AS n FROM cells, grid WHERE z >> 3 = 0 GROUP BY ALL)
SELECT bx, byy, CASE WHEN n > 200 THEN 0 WHEN n > 100 THEN 1 ELSE 2 END AS level FROM b""")
def _(spark, d):
    g = B.grid_for(spark, d, 8)
    n = B.cells(spark, d).groupBy(K.cell_block_id("x", "y", "z", g).alias("bid")).agg(F.count("*").alias("n"))
    lv = n.select("bid", F.when(F.col("n") > 200, 0).when(F.col("n") > 100, 1).otherwise(2).alias("level"))
    return L.block_plane(lv, g, "z", 0).select(F.col("u").alias("bx"), F.col("w").alias("byy"), "level")


@query("transp_prefix", "K25", f"WITH {PTS} SELECT x, y, z, {rsql('sum(a) OVER (PARTITION BY y, z ORDER BY x)')} AS depth FROM cells")
def _(spark, d):
    return L.accumulate(B.cells(spark, d), "a", "x").select("x", "y", "z", rnd("depth").alias("depth"))


@query("transp_lookup", "K25", f"""WITH {PTS}, q AS (SELECT px, py, pz, CAST(floor(px) AS BIGINT) AS x, CAST(floor(py) AS BIGINT) AS y, CAST(floor(pz) AS BIGINT) AS z FROM points)
SELECT px, py, pz, {rsql('coalesce(sum(a), 0)')} AS depth FROM (SELECT *, row_number() OVER () AS id FROM q) q LEFT JOIN cells c ON c.y = q.y AND c.z = q.z AND c.x <= q.x GROUP BY id, px, py, pz""")
def _(spark, d):
    g = B.grid_for(spark, d, 8)
    pts = B.points(spark, d).select("px", "py", "pz")
    return L.depth_at(pts, B.cells(spark, d), "a", g).select("px", "py", "pz", rnd("depth").alias("depth"))
