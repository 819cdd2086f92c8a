"""Channel algebra, reductions, boundary reads, vectors and geometry."""

from functools import reduce

from pyspark.sql import functions as F

from lattica.functions import keys as K, ramp, vec as V
from lattica.operators import channels as C, points as P, stats as S
from lattica.plans.addressing import CELL_FLAG_EXPR, flagged_cells
from lattica.plans.common import BID, rnd, rsql
from lattica.plans.registry import query
from lattica.plans.stats import _STAT, rounded_stat
from lattica.sources import patterns, tables as B

CL = B.CELLS_SQL
FC = f"{CL}, fc AS (SELECT *, {CELL_FLAG_EXPR} AS flags FROM cells)"
TWO = f"""{CL}, {B.POINTS_SQL}, other AS (SELECT CAST(floor(px) AS BIGINT) AS x, CAST(floor(py) AS BIGINT) AS y, CAST(floor(pz) AS BIGINT) AS z, avg(mass) / 104999.7e0 AS c FROM points GROUP BY 1, 2, 3)"""


def other_channel(spark, d):
    p = B.points(spark, d)
    return p.groupBy(*[F.floor(a).alias(c) for a, c in zip(("px", "py", "pz"), "xyz")]).agg((F.avg("mass") / B.PRICE_FULL).alias("c"))


@query("ch_stat", "A1 A7 T10", f"WITH {CL} SELECT {_STAT('a')} FROM cells".replace("min(a) AS min", f"{rsql('min(a)')} AS min").replace("max(a) AS max", f"{rsql('max(a)')} AS max"))
def _(spark, d):
    s = rounded_stat(C.channel_stat(B.cells(spark, d), ["a"]))
    return s.withColumns({"min": rnd("min"), "max": rnd("max")})


@query("ch_stat_fluid", "A1 P7", f"WITH {FC} SELECT {_STAT('b')} FROM fc WHERE (flags & 4097) = 0 AND abs(b) > 10")
def _(spark, d):
    return rounded_stat(C.channel_stat(flagged_cells(spark, d), ["b"], mask=C.is_fluid("flags"), zero_eps=10.0))


@query("ch_stat_vector", "A1", f"WITH {CL}, v AS (SELECT unnest([b, b * 2, b + 1]) AS t FROM cells) SELECT {_STAT('t')} FROM v")
def _(spark, d):
    c = B.cells(spark, d).select("b", (F.col("b") * 2).alias("b2"), (F.col("b") + 1).alias("b3"))
    return rounded_stat(C.channel_stat(c, ["b", "b2", "b3"]))


@query("ch_maxabs_pos", "A2 O5", f"""WITH {CL}, l AS (SELECT *, CASE WHEN b > 80 THEN 0 WHEN b > 40 THEN 1 ELSE 2 END AS level FROM cells),
 r AS (SELECT *, row_number() OVER (PARTITION BY level ORDER BY abs(b * 0.5e0) DESC, z, y, x) AS rn FROM l)
SELECT level, {rsql('abs(b * 0.5e0)')} AS max_abs, x, y, z FROM r WHERE rn = 1""")
def _(spark, d):
    level = F.when(F.col("b") > 80, 0).when(F.col("b") > 40, 1).otherwise(2)
    m = C.max_abs(B.cells(spark, d).withColumn("level", level), "b", 0.5, ["level"])
    return m.select("level", rnd("max_abs").alias("max_abs"), "x", "y", "z")


@query("ch_dot", "A3 J1", f"WITH {TWO} SELECT {rsql('sum(a * c)', 4)} AS dot, CAST(count(*) AS BIGINT) AS n FROM cells JOIN other USING (x, y, z)")
def _(spark, d):
    z = C.zip_channels(B.cells(spark, d), other_channel(spark, d))
    return z.agg(rnd(C.dot("a", "c"), 4).alias("dot"), F.count("*").alias("n"))


@query("ch_sum_slices", "A4", f"""WITH {CL} SELECT 'x' AS axis, y AS u, z AS w, {rsql('sum(b)', 3)} AS total FROM cells GROUP BY y, z
UNION ALL SELECT 'y', x, z, {rsql('sum(b)', 3)} FROM cells GROUP BY x, z UNION ALL SELECT 'z', x, y, {rsql('sum(b)', 3)} FROM cells GROUP BY x, y""")
def _(spark, d):
    return C.sum_slices(B.cells(spark, d), "b").select("axis", "u", "w", rnd("total", 3).alias("total"))


@query("ch_compare", "A5 O5", f"""WITH {TWO}, j AS (SELECT x, y, z, abs(a - c) AS d FROM cells JOIN other USING (x, y, z)),
 r AS (SELECT *, row_number() OVER (ORDER BY d DESC, z, y, x) AS rn FROM j)
SELECT {rsql('d')} AS max_diff, x, y, z, (SELECT CAST(sum(CASE WHEN d > 0.25e0 THEN 1 ELSE 0 END) AS BIGINT) FROM j) AS n_over, (SELECT CAST(count(*) AS BIGINT) FROM j) AS n FROM r WHERE rn = 1""")
def _(spark, d):
    z = C.zip_channels(B.cells(spark, d), other_channel(spark, d))
    return C.compare(z, ["a"], ["c"], 0.25).withColumn("max_diff", rnd("max_diff"))


@query("ch_check", "A6", f"""WITH {FC} SELECT CAST(count(*) AS BIGINT) AS n, CAST(sum(CASE WHEN isfinite(a) THEN 0 ELSE 1 END) AS BIGINT) AS n_bad,
 CAST(sum(CASE WHEN (flags & 4097) <> 0 AND a <> 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_solid_nonzero,
 CAST(sum(CASE WHEN ((flags & 4097) <> 0 OR (flags & 2) <> 0) AND a <> 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_held_nonzero FROM fc""")
def _(spark, d):
    return C.check_finite(flagged_cells(spark, d), "a", "flags")


@query("ch_algebra", "E1 E2 E4 E6 E12", f"""WITH {FC}, g AS (SELECT *, CASE WHEN b > 80 THEN 0 WHEN b > 40 THEN 1 ELSE 2 END AS level FROM fc)
SELECT x, y, z, {rsql('CASE WHEN (flags & 4097) = 0 THEN 0.5e0 ELSE a END')} AS set_v, {rsql('a * 2 - 0.25e0')} AS scaled, {rsql('abs(a - 0.5e0)')} AS magnitude,
 {rsql('sqrt(greatest(a - 0.4e0, 0))')} AS root, {rsql('b / pow(pow(2e0, level), 3)')} AS per_volume FROM g""")
def _(spark, d):
    c = flagged_cells(spark, d).withColumn("level", F.when(F.col("b") > 80, 0).when(F.col("b") > 40, 1).otherwise(2))
    return c.select("x", "y", "z", rnd(C.set_where("a", 0.5, C.is_fluid("flags"))).alias("set_v"), rnd(F.col("a") * 2 - 0.25).alias("scaled"),
                    rnd(F.abs(F.col("a") - 0.5)).alias("magnitude"), rnd(C.sqrt_clipped(F.col("a") - 0.4)).alias("root"),
                    rnd(C.by_cell_volume("b", "level")).alias("per_volume"))


@query("ch_binary", "E3 E7 E8 J1 J9", f"WITH {TWO} SELECT x, y, z, {rsql('a * c')} AS product, {rsql('2 * a - 0.5e0 * c')} AS blend, {rsql('b + 0.1e0 * a')} AS px, {rsql('c + 0.7e0 * a')} AS pp FROM cells JOIN other USING (x, y, z)")
def _(spark, d):
    z = C.zip_channels(B.cells(spark, d), other_channel(spark, d))
    pair = C.update_pair("b", "a", "c", 0.1, 0.7)
    return z.select("x", "y", "z", rnd(F.col("a") * F.col("c")).alias("product"), rnd(C.axpby(2.0, "a", -0.5, "c")).alias("blend"),
                    rnd(pair["x"]).alias("px"), rnd(pair["p"]).alias("pp"))


@query("ch_normalize", "E5 A24", f"WITH {CL}, m AS (SELECT min(b) AS lo, max(b) AS hi FROM cells) SELECT x, y, z, {rsql('(b - lo) / (hi - lo)')} AS b FROM cells, m")
def _(spark, d):
    return C.normalise(B.cells(spark, d), "b").select("x", "y", "z", rnd("b").alias("b"))


@query("ch_apply", "E9 E10", f"WITH {CL} SELECT x, y, z, {rsql('a * (x + 1) / (y + z + 1)', 4)} AS a FROM cells")
def _(spark, d):
    f = lambda v, x, y, z: v * (x + 1) / (y + z + 1)
    return C.apply_function(B.cells(spark, d), "a", f).select("x", "y", "z", rnd("a", 4).alias("a"))


@query("ch_components", "G11", f"WITH {CL} SELECT x, y, z, {rsql('a')} AS vx, {rsql('b')} AS vy, {rsql('a + b')} AS s FROM cells")
def _(spark, d):
    c = B.cells(spark, d).select("x", "y", "z", V.vec3("a", "b", F.col("a") + F.col("b")).alias("v"))
    return c.select("x", "y", "z", *[rnd(C.move_component("v", i)).alias(n) for i, n in (("x", "vx"), ("y", "vy"), ("z", "s"))])


@query("ch_dense_roundtrip", "S2 S3 S4", f"""WITH {CL}, {B.grid_sql(8)}, kb AS (SELECT {BID(3)} AS bid FROM cells, grid GROUP BY 1 HAVING max(abs(a)) >= 0.93e0),
 k AS (SELECT cells.* FROM cells, grid WHERE {BID(3)} IN (SELECT bid FROM kb)),
 al AS (SELECT i % sx AS x, (i // sx) % 16 AS y, i // (sx * 16) AS z FROM (SELECT unnest(range(sx * 256)) AS i, sx FROM grid))
SELECT x, y, z, {rsql('coalesce(a, -1)')} AS a FROM al LEFT JOIN k USING (x, y, z)""")
def _(spark, d):
    g = B.grid_for(spark, d, 8)
    return C.densify(C.sparsify(B.cells(spark, d), g, "a", 0.93), g, "a", -1.0).select("x", "y", "z", rnd("a").alias("a"))


_NZ = f"{CL}, {B.grid_sql(8)}, al AS (SELECT x, y, z, sx, nbx, nby FROM cells, grid), q AS (SELECT *, {BID(3)} * 1000 + (x & 7) + (y & 7) * 8 + (z & 7) * 64 AS idx FROM al)"


@query("gen_patterns", "S5 T16", f"""WITH {_NZ} SELECT x, y, z, CAST(idx AS DOUBLE) AS p0, {rsql('0.5e0 * sin(20e0 * sqrt(pow(x / 16e0, 2) + pow(y / 16e0, 2) + pow(z / 16e0, 2)))')} AS p4,
 {rsql('sqrt(pow((x + 0.5e0) / greatest(sx, 16) - 0.3e0, 2) + pow((y + 0.5e0) / greatest(sx, 16) - 0.3e0, 2) + pow((z + 0.5e0) / greatest(sx, 16) - 0.5e0, 2)) - 0.2e0')} AS p5 FROM q""")
def _(spark, d):
    g = B.grid_for(spark, d, 8)
    return patterns.at_cells(B.cells(spark, d), g).select("x", "y", "z", patterns.pattern(0, g).alias("p0"), rnd(patterns.pattern(4, g)).alias("p4"), rnd(patterns.pattern(5, g)).alias("p5"))


_M32 = lambda v: f"xor(({v}), ({v}) >> 16)"


@query("gen_hash_pattern", "S5 F3", f"""WITH {_NZ}, h1 AS (SELECT x, y, z, CAST((xor(idx, idx >> 16) * 2246822507::HUGEINT) % 4294967296 AS BIGINT) AS r1 FROM q),
 h2 AS (SELECT x, y, z, CAST((xor(r1, r1 >> 13) * 3266489909::HUGEINT) % 4294967296 AS BIGINT) AS r2 FROM h1)
SELECT x, y, z, {rsql('(xor(r2, r2 >> 16) >> 9) / 8388608e0')} AS v FROM h2""")
def _(spark, d):
    g = B.grid_for(spark, d, 8)
    return patterns.at_cells(B.cells(spark, d), g).select("x", "y", "z", rnd(patterns.pattern(2, g)).alias("v"))


# --- reads across the domain border ---------------------------------------------

def boundary_read(kind):
    """Cells read 3 to the left in x and 2 up in y under one boundary rule."""
    qx, qy = "(x - 3)", "(y + 8)"
    base = f"WITH {CL}, {B.grid_sql(8)}, p AS (SELECT DISTINCT x AS hx, y AS hy, z AS hz, x - 3 AS qx, y + 8 AS qy, sx FROM cells, grid)"
    cx, cy = "greatest(least(qx, sx - 1), 0)", "greatest(least(qy, 15), 0)"
    if kind == "PERIODIC":
        cx, cy = "((qx % sx) + sx) % sx", "((qy % 16) + 16) % 16"
    val = "coalesce(a, 0)"
    if kind == "DIRICHLET":
        val = "CASE WHEN qx < 0 OR qy > 15 THEN 0 ELSE coalesce(a, 0) END"
    if kind == "FREESLIP":
        val = "CASE WHEN qx < 0 THEN 0 ELSE coalesce(a, 0) END"
    return f"{base} SELECT hx, hy, hz, {rsql(val)} AS a FROM p LEFT JOIN cells c ON c.x = {cx} AND c.y = {cy} AND c.z = hz"


def read_with_bc(spark, d, kind):
    g = B.grid_for(spark, d, 8)
    c = B.cells(spark, d).select("x", "y", "z", "a")
    probe = c.select(F.col("x").alias("hx"), F.col("y").alias("hy"), F.col("z").alias("hz"), (F.col("x") - 3).alias("qx"), (F.col("y") + 8).alias("qy"), F.col("z").alias("qz"))
    out = C.boundary_lookup(probe, ("qx", "qy", "qz"), c, "a", g, kind, 0.0, component=0)
    return out.select("hx", "hy", "hz", rnd("a").alias("a"))


@query("bc_dirichlet", "G10 G9", boundary_read("DIRICHLET"))
def _(spark, d):
    return read_with_bc(spark, d, "DIRICHLET")


@query("bc_neumann", "G10 G9", boundary_read("NEUMANN"))
def _(spark, d):
    return read_with_bc(spark, d, "NEUMANN")


@query("bc_periodic", "G10 G9 T13", boundary_read("PERIODIC"))
def _(spark, d):
    return read_with_bc(spark, d, "PERIODIC")


@query("bc_freeslip", "G10 G9", boundary_read("FREESLIP"))
def _(spark, d):
    return read_with_bc(spark, d, "FREESLIP")


# --- ramps, vectors, geometry ------------------------------------------------------

_LS = lambda a, b, x: f"(CASE WHEN {x} < {a} THEN 0e0 WHEN {x} >= {b} THEN 1e0 ELSE ({x} - {a}) / ({b} - {a}) END)"
_AI = lambda m, n, x: f"(CASE WHEN {x} > {m} THEN {x} ELSE ((2 * {n} - {m}) * ({x} / {m}) + 2 * {m} - 3 * {n}) * ({x} / {m}) * ({x} / {m}) + {n} END)"


@query("fn_ramps", "F1 T21", f"""WITH {CL} SELECT x, y, z, {rsql(_LS('0.2e0', '0.7e0', 'a'))} AS lin, {rsql(f"{_LS('0.2e0', '0.7e0', 'a')} * {_LS('0.2e0', '0.7e0', 'a')} * (3 - 2 * {_LS('0.2e0', '0.7e0', 'a')})")} AS smooth,
 {rsql(f"1 + 4 * {_LS('0.2e0', '0.7e0', 'a')}")} AS fit, {rsql(_AI('0.5e0', '0.1e0', 'a'))} AS ident, {rsql(f"CASE WHEN a < 0.3e0 THEN 0 ELSE {_AI('0.3e0', '-0.3e0', '(a - 0.3e0)')} + 0.3e0 END")} AS soft,
 {rsql('CASE WHEN a - 0.5e0 < 0 THEN -1 ELSE 1 END')} AS sgn, {rsql('sign(a - 0.5e0) * pow(abs(a - 0.5e0), 1.5e0)')} AS pw, {rsql('abs(a - b) / least(a, b)', 4)} AS rel FROM cells""")
def _(spark, d):
    a = F.col("a")
    return B.cells(spark, d).select(
        "x", "y", "z", rnd(ramp.linstep(0.2, 0.7, "a")).alias("lin"), rnd(ramp.smoothstep(0.2, 0.7, "a")).alias("smooth"),
        rnd(ramp.linfit("a", 0.2, 1.0, 0.7, 5.0)).alias("fit"), rnd(ramp.almost_identity(0.5, 0.1, "a")).alias("ident"),
        rnd(ramp.soft_clamp_to_zero(0.3, 0.6, "a")).alias("soft"), rnd(ramp.sign_or_one(a - 0.5)).alias("sgn"),
        rnd(ramp.abs_pow(a - 0.5, 1.5)).alias("pw"), rnd(ramp.rel_diff("a", "b"), 4).alias("rel"))


_LS_ = lambda e: f"list_sum({e})"


@query("vec_norms", "A25", f"""WITH {B.VECTORS_SQL} SELECT vec_id, {rsql(_LS_('list_transform(e, lambda t: t * t)'))} AS n2, {rsql('sqrt(' + _LS_('list_transform(e, lambda t: t * t)') + ')')} AS n1,
 {rsql(_LS_('list_transform(e, lambda t: abs(t))'))} AS l1, {rsql('list_max(list_transform(e, lambda t: abs(t)))')} AS mx FROM vectors""")
def _(spark, d):
    return B.vectors(spark, d).select("vec_id", rnd(V.norm2("e")).alias("n2"), rnd(V.norm("e")).alias("n1"), rnd(V.abs_sum("e")).alias("l1"), rnd(V.max_abs("e")).alias("mx"))


_PAIR = f"{B.VECTORS_SQL}, p AS (SELECT a.vec_id, a.e AS e, b.e AS f FROM vectors a JOIN vectors b ON b.vec_id = a.vec_id + 1)"
_ZIP = lambda body: f"list_sum(list_transform(list_zip(e, f), lambda t: {body}))"


@query("vec_pairs", "A25", f"WITH {_PAIR} SELECT vec_id, {rsql(_ZIP('t[1] * t[2]'))} AS dot, {rsql(_ZIP('(t[1] - t[2]) * (t[1] - t[2])'))} AS d2, {rsql('sqrt(' + _ZIP('(t[1] - t[2]) * (t[1] - t[2])') + ')')} AS dist FROM p")
def _(spark, d):
    v = B.vectors(spark, d).select("vec_id", "e")
    p = v.join(v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("e").alias("f")), "vec_id")
    return p.select("vec_id", rnd(V.dot("e", "f")).alias("dot"), rnd(V.distance2("e", "f")).alias("d2"), rnd(V.distance("e", "f")).alias("dist"))


@query("vec_maps", "E12", f"""WITH {_PAIR} SELECT vec_id, {rsql('e[3] + f[3]')} AS a3, {rsql('e[3] - f[3]')} AS s3, {rsql('e[3] * 2.5e0')} AS k3, {rsql('e[16]')} AS t2, CAST(64 // 8 AS INTEGER) AS nt,
 {rsql('CASE WHEN list_max(e) - list_min(e) > 1e-20 THEN (e[3] - list_min(e)) / (list_max(e) - list_min(e)) ELSE 0 END')} AS unit3 FROM p""")
def _(spark, d):
    v = B.vectors(spark, d).select("vec_id", "e")
    p = v.join(v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("e").alias("f")), "vec_id")
    k, o = V.to_unit_interval(F.array_min("e"), F.array_max("e") - F.array_min("e"))
    return p.select("vec_id", rnd(V.add("e", "f")[2]).alias("a3"), rnd(V.sub("e", "f")[2]).alias("s3"), rnd(V.scale("e", 2.5)[2]).alias("k3"),
                    rnd(V.every("e", 8)[1]).alias("t2"), F.size(V.every("e", 8)).alias("nt"), rnd(k * F.col("e")[2] + o).alias("unit3"))


_V3 = f"{B.VECTORS_SQL}, q AS (SELECT vec_id, e[1] AS ax, e[2] AS ay, e[3] AS az, e[4] AS bx, e[5] AS b_y, e[6] AS bz FROM vectors), u AS (SELECT *, sqrt(bx * bx + b_y * b_y + bz * bz) AS nb, sqrt(ax * ax + ay * ay + az * az) AS na FROM q), w AS (SELECT *, bx / nb AS nx, b_y / nb AS ny, bz / nb AS nz, ax / na AS ux, ay / na AS uy, az / na AS uz FROM u), k AS (SELECT *, ux * nx + uy * ny + uz * nz AS dn FROM w), r AS (SELECT *, 1 - 0.64e0 * (1 - dn * dn) AS kk FROM k)"


@query("geo_vec3", "F6", f"""WITH {_V3} SELECT vec_id, {rsql('ay * bz - az * b_y')} AS cx, {rsql('az * bx - ax * bz')} AS cy, {rsql('ux - 2 * dn * nx')} AS rx, {rsql('CASE WHEN kk < 0 THEN ux ELSE 0.8e0 * ux - nx * (0.8e0 * dn + sqrt(greatest(kk, 0))) END')} AS tx,
 {rsql('dn')} AS cosine FROM r""")
def _(spark, d):
    e = F.col("e")
    v = B.vectors(spark, d).select("vec_id", V.vec3(e[0], e[1], e[2]).alias("a"), V.vec3(e[3], e[4], e[5]).alias("b"))
    v = v.select("*", V.unit3(F.col("a")).alias("u"), V.unit3(F.col("b")).alias("n"))
    u, n = F.col("u"), F.col("n")
    cr = V.cross3(F.col("a"), F.col("b"))
    return v.select("vec_id", rnd(cr["x"]).alias("cx"), rnd(cr["y"]).alias("cy"), rnd(V.reflect3(u, n)["x"]).alias("rx"),
                    rnd(V.refract3(u, n, 0.8)["x"]).alias("tx"), rnd(V.dot3(u, n)).alias("cosine"))


_SEG = "((px - 100) * 200 + (py - 2) * 8) / (200e0 * 200 + 8 * 8)"


@query("geo_plane", "F6", f"""WITH {B.POINTS_SQL}, t AS (SELECT px, py, pz, greatest(least({_SEG}, 1), 0) AS t, py / 10 AS p, pz / 10 AS q FROM points), g AS (SELECT *, p / (1 + sqrt(1 + p * p + q * q)) AS f, q / (1 + sqrt(1 + p * p + q * q)) AS h, sqrt(p * p + q * q + 1) AS nn FROM t)
SELECT px, py, pz, {rsql('pow(px - 100 - 200 * t, 2) + pow(py - 2 - 8 * t, 2)', 3)} AS seg, {rsql('f')} AS sf, {rsql('h')} AS sg, {rsql('p')} AS back, {rsql('-p / nn')} AS nx,
 {rsql('CASE WHEN atan2(-q / nn, -p / nn) < 0 THEN atan2(-q / nn, -p / nn) + 2 * pi() ELSE atan2(-q / nn, -p / nn) END')} AS tilt, {rsql('acos(1 / nn)')} AS slant FROM g""")
def _(spark, d):
    p = B.points(spark, d).select("px", "py", "pz", (F.col("py") / 10).alias("p"), (F.col("pz") / 10).alias("q"))
    f, g = V.stereographic("p", "q")
    p = p.select("*", f.alias("f"), g.alias("g"), V.gradient_normal("p", "q").alias("n"))
    tilt, slant = V.normal_angles(F.col("n"))
    return p.select("px", "py", "pz", rnd(V.segment_distance2(("px", "py"), (100, 2), (300, 10)), 3).alias("seg"), rnd("f").alias("sf"), rnd("g").alias("sg"),
                    rnd(V.stereographic_inverse("f", "g")[0]).alias("back"), rnd(F.col("n")["x"]).alias("nx"), rnd(tilt).alias("tilt"), rnd(slant).alias("slant"))


def _ray_sql():
    ax = [("x", "-5e0", "1e0"), ("y", "3.3e0", "(0.02e0 * (z - 4))"), ("z", "4.1e0", "(0.01e0 * (y - 3))")]
    inv = lambda dd: f"(CASE WHEN abs({dd}) > 1e-7 THEN 1 / {dd} ELSE 1 / 1e-7 END)"
    lo = [f"CASE WHEN {inv(dd)} >= 0 THEN ({c} - {p}) * {inv(dd)} ELSE ({c} + 1 - {p}) * {inv(dd)} END" for c, p, dd in ax]
    hi = [f"CASE WHEN {inv(dd)} >= 0 THEN ({c} + 1 - {p}) * {inv(dd)} ELSE ({c} - {p}) * {inv(dd)} END" for c, p, dd in ax]
    return f"WITH {CL}, t AS (SELECT x, y, z, greatest({', '.join(lo)}) AS a0, least({', '.join(hi)}) AS b0 FROM cells) SELECT x, y, z, {rsql('a0', 3)} AS t_in, {rsql('b0', 3)} AS t_out FROM t WHERE a0 <= b0"


@query("geo_ray_cell", "K26", _ray_sql())
def _(spark, d):
    c = B.cells(spark, d).withColumns({"dy": (F.col("z") - 4) * 0.02, "dz": (F.col("y") - 3) * 0.01})
    r = V.ray_cell((F.lit(-5.0), F.lit(3.3), F.lit(4.1)), (F.lit(1.0), "dy", "dz"), ("x", "y", "z"), 1.0)
    return c.select("x", "y", "z", *[e.alias(n) for n, e in r.items()]).where("hit").select("x", "y", "z", rnd("t_in", 3).alias("t_in"), rnd("t_out", 3).alias("t_out"))
