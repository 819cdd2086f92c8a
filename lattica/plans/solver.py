"""Laplacian, relaxation and mixed-resolution queries."""

from pyspark.sql import functions as F

from lattica.operators import halo as H, mixedres as M, pyramid as Y, solver as S
from lattica.plans.addressing import CELL_FLAG_EXPR, flagged_cells
from lattica.plans.common import BID, rnd, rsql
from lattica.plans.pyramids import LEVELED, leveled_cells
from lattica.plans.registry import query
from lattica.operators import channels as C
from lattica.session import cut_lineage
from lattica.sources import tables as B

F64 = "float64"
_AR = lambda t: f"CASE WHEN {t} > 0.8e0 THEN 0.5e0 ELSE 1e0 END"
BASE = f"""{B.CELLS_SQL}, fc AS (SELECT x, y, z, b, {CELL_FLAG_EXPR} AS flags, {_AR('a')} AS ax, {_AR('1 - a')} AS ay, 1e0 AS az, CASE WHEN (({CELL_FLAG_EXPR}) & 4097) = 0 THEN a ELSE 0e0 END AS v FROM cells)"""


def FACE(src="fc", name="fw"):
    at = {0: (-1, 0, 0), 1: (1, 0, 0), 2: (0, -1, 0), 3: (0, 1, 0), 4: (0, 0, -1), 5: (0, 0, 1)}
    joins = " ".join(f"LEFT JOIN {src} n{i} ON n{i}.x = c.x + {o[0]} AND n{i}.y = c.y + {o[1]} AND n{i}.z = c.z + {o[2]}" for i, o in at.items())
    ws = ", ".join((f"c.a{'xyz'[i // 2]}" if i % 2 == 0 else f"coalesce(n{i}.a{'xyz'[i // 2]}, 1e0)") + f" AS w{i}" for i in range(6))
    xs = ", ".join(f"coalesce(n{i}.v, 0e0) AS x{i}" for i in range(6))
    return f"{name} AS (SELECT c.*, {ws}, {xs} FROM {src} c {joins})"


W = " + ".join(f"w{i}" for i in range(6))
FLOW = "(" + " + ".join(f"w{i} * x{i}" for i in range(6)) + ")"
H0 = "0.5e0"
FLUID = "(flags & 4097) = 0"


def system(spark, d):
    c = flagged_cells(spark, d)
    area = lambda t: F.when(t > 0.8, 0.5).otherwise(1.0)
    fluid = C.is_fluid("flags")
    c = c.select("x", "y", "z", "b", "flags", area(F.col("a")).alias("ax"), area(F.lit(1.0) - F.col("a")).alias("ay"), F.lit(1.0).alias("az"),
                 F.when(fluid, F.col("a")).otherwise(0.0).alias("v"))
    return c, S.face_weights(c, "v", ("ax", "ay", "az"), ("b", "flags"))


@query("lapl_apply", "K16", f"WITH {BASE}, {FACE()} SELECT x, y, z, {rsql(f'CASE WHEN {FLUID} THEN v * {H0} * ({W}) - {H0} * {FLOW} ELSE 0 END')} AS y_out FROM fw")
def _(spark, d):
    _, f = system(spark, d)
    return f.select("x", "y", "z", rnd(S.apply_laplacian(f, "v", 0.5, C.is_fluid("flags"))).alias("y_out"))


@query("lapl_residual", "K16 A3", f"""WITH {BASE}, {FACE()}, y AS (SELECT x, y, z, v, b / 100e0 AS rhs, CASE WHEN {FLUID} THEN v * {H0} * ({W}) - {H0} * {FLOW} ELSE 0 END AS ax FROM fw)
SELECT x >> 4 AS bx, {rsql('sum((rhs - ax) * (rhs - ax))', 4)} AS res2, {rsql('sum(v * ax)', 4)} AS x_ax FROM y GROUP BY 1""")
def _(spark, d):
    _, f = system(spark, d)
    y = f.withColumn("ax", S.apply_laplacian(f, "v", 0.5, C.is_fluid("flags"))).withColumn("r", F.col("b") / 100 - F.col("ax"))
    return y.groupBy(F.shiftright("x", 4).alias("bx")).agg(rnd(C.dot("r", "r"), 4).alias("res2"), rnd(C.dot("v", "ax"), 4).alias("x_ax"))


_JAC = f"CASE WHEN {FLUID} THEN (b / 100e0 + {H0} * {FLOW}) / ({W}) * 0.8e0 / {H0} + 0.2e0 * v ELSE 0 END"


@query("relax_jacobi_step", "K17", f"WITH {BASE}, {FACE()} SELECT x, y, z, {rsql(_JAC)} AS v FROM fw")
def _(spark, d):
    _, f = system(spark, d)
    return f.select("x", "y", "z", rnd(S.jacobi("v", F.col("b") / 100, 0.5, 0.8, C.is_fluid("flags"))).alias("v"))


def _half(src, turn, name):
    par = f"(((x >> 3) + (y >> 3) + (z >> 3)) & 1) = {turn}"
    return f"{FACE(src, 'f' + name)}, {name} AS (SELECT x, y, z, b, flags, ax, ay, az, CASE WHEN {par} THEN {_JAC} ELSE v END AS v FROM f{name})"


# all cells of blocks that hold any
_STORED = """, stored AS (SELECT bx * 8 + i AS x, b_y * 8 + j AS y, bz * 8 + k AS z FROM (SELECT DISTINCT x >> 3 AS bx, y >> 3 AS b_y, z >> 3 AS bz FROM cells), range(8) a(i), range(8) b(j), range(8) c(k))"""


@query("relax_redblack", "K17", f"WITH {BASE}, {_half('fc', 1, 'r1')}, {_half('r1', 0, 'r2')} {_STORED} SELECT x, y, z, {rsql('coalesce(v, 0)')} AS v FROM stored LEFT JOIN r2 USING (x, y, z)")
def _(spark, d):
    g = B.grid_for(spark, d, 8)
    c, f = system(spark, d)
    sys = S.pack_system(f.withColumns({"rhs": F.col("b") / 100, "fluid": C.is_fluid("flags")}), g)
    x = S.relax(H.pack(c, g, "v", dtype=F64), sys, g, h=0.5, omega=0.8)
    return H.unpack(x, g, "v", F64).select("x", "y", "z", rnd("v").alias("v"))


@query("relax_inner_sweeps", "K17")
def _(spark, d):
    g = B.grid_for(spark, d, 8)
    c, f = system(spark, d)
    sys = S.pack_system(f.withColumns({"rhs": F.col("b") / 100, "fluid": C.is_fluid("flags")}), g)
    x = S.relax(H.pack(c, g, "v", dtype=F64), sys, g, h=0.5, omega=0.8, inner=3, reverse=True)
    return H.unpack(x, g, "v", F64).select("x", "y", "z", rnd("v").alias("v"))


# interface helpers on differences of the two channels
_LF = lambda a, b: f"(CASE WHEN {a} < 0 AND {b} < 0 THEN 1e0 WHEN {a} < 0 THEN {a} / ({a} - {b}) WHEN {b} < 0 THEN {b} / ({b} - {a}) ELSE 0e0 END)"


@query("iface_line_theta", "K18", f"""WITH {B.CELLS_SQL}, p AS (SELECT c.x, c.y, c.z, c.a - 0.5e0 AS p, n.a - 0.5e0 AS q, c.b FROM cells c JOIN cells n ON n.x = c.x + 1 AND n.y = c.y AND n.z = c.z),
 t AS (SELECT *, greatest(CASE WHEN -p < 0 AND -q > 0 THEN CASE WHEN abs(q - p) < 1e-5 THEN 0.5e0 ELSE -p / (q - p) END WHEN -p < 0 AND -q < 0 AND -q > -p + 1e-5 THEN 1e0 ELSE 0.5e0 END, 0.05e0) AS theta FROM p)
SELECT x, y, z, {rsql(_LF('p', 'q'))} AS inside, {rsql('theta')} AS theta, {rsql('-b * (1 - theta) / theta', 4)} AS pressure FROM t""")
def _(spark, d):
    c = B.cells(spark, d)
    nb = H.neighbour_values(c, [(1, 0, 0)], "a").where("a_0 is not null").join(c.select("x", "y", "z", "b"), ["x", "y", "z"])
    g = S.ghost_pressure(F.col("b"), F.col("a"), F.col("a_0"), 0.5, 0.05)
    return nb.select("x", "y", "z", rnd(S.line_fraction(F.col("a") - 0.5, F.col("a_0") - 0.5)).alias("inside"), rnd(g["theta"]).alias("theta"), rnd(g["pressure"], 4).alias("pressure"))


def _area_sql():
    r = ["p0", "p1", "p2", "p3"]  # bottom left, bottom right, top right, top left
    n = lambda i: r[i % 4]
    tri_in = lambda i: f"0.5e0 * {_LF(n(i), n(i - 1))} * {_LF(n(i), n(i + 1))}"
    tri_out = lambda i: f"0.5e0 * (1 - {_LF(n(i), n(i - 1))}) * (1 - {_LF(n(i), n(i + 1))})"
    w = " ".join([f"WHEN k = 3 AND {n(i)} >= 0 THEN 1 - {tri_out(i)} WHEN k = 1 AND {n(i)} < 0 THEN {tri_in(i)} WHEN k = 2 AND {n(i)} < 0 AND {n(i + 1)} < 0 THEN 0.5e0 * ({_LF(n(i), n(i - 1))} + {_LF(n(i + 1), n(i + 2))})" for i in range(4)]
                 + [f"WHEN k = 2 AND {n(i)} < 0 AND {n(i + 2)} < 0 THEN CASE WHEN p0 + p1 + p2 + p3 < 0 THEN 1 - {tri_out(i + 1)} - {tri_out(i + 3)} ELSE {tri_in(i)} + {tri_in(i + 2)} END" for i in (0, 1)])
    j = " ".join(f"JOIN cells n{k} ON n{k}.x = c.x + {dx} AND n{k}.y = c.y + {dy} AND n{k}.z = c.z" for k, (dx, dy) in enumerate([(0, 0), (1, 0), (1, 1), (0, 1)]) if k)
    return f"""WITH {B.CELLS_SQL}, q AS (SELECT c.x, c.y, c.z, c.a - 0.5e0 AS p0, n1.a - 0.5e0 AS p1, n2.a - 0.5e0 AS p2, n3.a - 0.5e0 AS p3 FROM cells c {j}),
 k AS (SELECT *, CAST(p0 < 0 AS INTEGER) + CAST(p1 < 0 AS INTEGER) + CAST(p2 < 0 AS INTEGER) + CAST(p3 < 0 AS INTEGER) AS k FROM q)
SELECT x, y, z, {rsql(f"CASE WHEN k = 4 THEN 1 WHEN k = 0 THEN 0 {w} END")} AS inside FROM k"""


@query("iface_area", "K18", _area_sql())
def _(spark, d):
    nb = H.neighbour_values(B.cells(spark, d), [(1, 0, 0), (1, 1, 0), (0, 1, 0)], "a").where("a_0 is not null and a_1 is not null and a_2 is not null")
    p = [F.col(n) - 0.5 for n in ("a", "a_0", "a_1", "a_2")]
    return nb.select("x", "y", "z", rnd(S.area_fraction(p[0], p[1], p[3], p[2])).alias("inside"))


# --- mixed resolution -------------------------------------------------------------------

def _mixed_sql():
    parts = []
    for i, (dx, dy, dz) in enumerate([(-1, 0, 0), (1, 0, 0), (0, -1, 0), (0, 1, 0), (0, 0, -1), (0, 0, 1)]):
        ax = [abs(dx), abs(dy), abs(dz)].index(1)
        up = dx + dy + dz > 0
        sub = ["2 * c.{0} + {1}".format(v, 2 if up else -1) if k == ax else None for k, v in enumerate("xyz")]
        cond = " AND ".join(f"n.{v} = {sub[k]}" if sub[k] else f"n.{v} IN (2 * c.{v}, 2 * c.{v} + 1)" for k, v in enumerate("xyz"))
        parts.append(f"SELECT c.level, c.x, c.y, c.z, {i} AS f, 0 AS kind, n.v FROM lc c JOIN lc n ON n.level = c.level AND n.x = c.x + {dx} AND n.y = c.y + {dy} AND n.z = c.z + {dz}")
        parts.append(f"SELECT c.level, c.x, c.y, c.z, {i}, 2, n.v FROM lc c JOIN lc n ON n.level = c.level + 1 AND n.x = (c.x + {dx}) >> 1 AND n.y = (c.y + {dy}) >> 1 AND n.z = (c.z + {dz}) >> 1")
        parts.append(f"SELECT c.level, c.x, c.y, c.z, {i}, 1, n.v FROM lc c JOIN lc n ON n.level = c.level - 1 AND {cond}")
    return f"WITH {LEVELED}, nb AS ({' UNION ALL '.join(parts)}), mf AS (SELECT level, x, y, z, f, max(kind) AS kind, avg(v) AS v FROM nb GROUP BY ALL)"


@query("mixed_faces", "J5", f"{_mixed_sql()} SELECT f AS face, kind, CAST(count(*) AS BIGINT) AS n, {rsql('sum(v)', 4)} AS total FROM mf GROUP BY 1, 2")
def _(spark, d):
    g, _, own = leveled_cells(spark, d)
    f = M.face_neighbours(own.select("level", "x", "y", "z", "v"), ["v"], g)
    rows = F.explode(F.array(*[F.struct(F.lit(i).alias("face"), F.col(f"kind_{i}").alias("kind"), F.col(f"v_{i}").alias("v")) for i in range(6)]))
    return f.select(rows.alias("r")).select("r.*").where("kind is not null").groupBy("face", "kind").agg(F.count("*").alias("n"), rnd(F.sum("v"), 4).alias("total"))


_SIDE = lambda i: f"coalesce(v{i}, 2 * v - v{i ^ 1})"


@query("mixed_derivatives", "K23", f"""{_mixed_sql()}, pv AS (SELECT c.level, c.x, c.y, c.z, any_value(c.v) AS v, {', '.join(f'max(CASE WHEN f = {i} THEN mf.v END) AS v{i}' for i in range(6))} FROM lc c LEFT JOIN mf USING (level, x, y, z) GROUP BY 1, 2, 3, 4)
SELECT level, x, y, z, {', '.join(rsql(f'({_SIDE(2 * k + 1)} - {_SIDE(2 * k)}) * 0.5e0 / pow(2, level)') + f' AS d{a}' for k, a in enumerate('xyz'))} FROM pv""")
def _(spark, d):
    g, _, own = leveled_cells(spark, d)
    f = M.face_neighbours(own.select("level", "x", "y", "z", "v"), ["v"], g)
    return f.select("level", "x", "y", "z", *[rnd(c).alias(n) for n, c in M.scalar_derivatives(f, "v").items()])


@query("cell_accessor", "P14", f"""WITH {LEVELED}, {B.POINTS_SQL.replace('points AS', 'pts AS')}, b AS (SELECT *, (CAST(floor(px) AS BIGINT) >> 2) + (CAST(floor(py) AS BIGINT) >> 2) * nbx + (CAST(floor(pz) AS BIGINT) >> 2) * nbx * nby AS bid FROM pts, grid)
SELECT level, CAST(floor(px) AS BIGINT) >> level AS x, CAST(floor(py) AS BIGINT) >> level AS y, CAST(floor(pz) AS BIGINT) >> level AS z, CAST(count(*) AS BIGINT) AS n FROM b JOIN l1 USING (bid) GROUP BY ALL""")
def _(spark, d):
    g, flagged, _ = leveled_cells(spark, d)
    return M.cell_at(B.points(spark, d), flagged, g).groupBy("level", "x", "y", "z").agg(F.count("*").alias("n"))


def settled_levels(spark, d):
    """Levels and cells are read many times below: keep them as files.

    Blocks of 16 leave room for the blend inside every level.
    """
    g, flagged, own = leveled_cells(spark, d, 16, 2150)
    flagged, own = cut_lineage(flagged), cut_lineage(own)
    ghosts = cut_lineage(Y.all_ghosts(own, flagged, g, "v"))
    return g, flagged, own, ghosts


@query("interp_levels", "K22")
def _(spark, d):
    g, flagged, own, ghosts = settled_levels(spark, d)
    pts = B.points(spark, d).select("px", "py", "pz")
    return M.sample_levels(pts, own, ghosts, flagged, g, "v").select("px", "py", "pz", rnd("value").alias("value"))


@query("interp_levels_slope", "K22 K21")
def _(spark, d):
    g, flagged, own, ghosts = settled_levels(spark, d)
    pts = B.points(spark, d).select("px", "py", "pz")
    out = M.sample_levels(pts, own, ghosts, flagged, g, "v", kind="bspline3")
    return out.select("px", "py", "pz", *[rnd(n).alias(n) for n in ("value", "gx", "gy", "gz")])
