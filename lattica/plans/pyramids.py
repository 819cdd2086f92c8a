"""Resampling queries: means, smooth kernels, Laplacian levels, faces, ghosts."""

from pyspark.sql import functions as F

from lattica.functions import keys as K
from lattica.operators import pyramid as Y, topology as T
from lattica.plans.common import BID, rnd, rsql
from lattica.plans.registry import query
from lattica.plans.topology import ACTIVE_HITS, FLAGGED, REG, point_levels
from lattica.sources import tables as B

CL, G8 = B.CELLS_SQL, B.grid_sql(8)


#: Weights of the oracles, in literal numbers.
MEAN2_W, SMOOTH4_W = "(VALUES (0, 0.5e0), (1, 0.5e0))", "(VALUES (-1, 0.125e0), (0, 0.375e0), (1, 0.375e0), (2, 0.125e0))"
STAGGERED4_W = "(VALUES (-1, 0.25e0), (0, 0.5e0), (1, 0.25e0))"
GAUSS5_W = "(VALUES (-2, 0.05e0), (-1, 0.25e0), (0, 0.4e0), (1, 0.25e0), (2, 0.05e0))"


def down_sql(w, src, val, dims, name="dn"):
    """Gather form: every target cell reads its clamped window."""
    cl = lambda e, n: f"greatest(least({e}, {n} - 1), 0)"
    return f"""{name} AS (SELECT g.x, g.y, g.z, sum(kx.w * ky.w * kz.w * coalesce(s.v, 0)) AS v, count(s.v) AS hits FROM
   (SELECT i % mx AS x, (i // mx) % my AS y, i // (mx * my) AS z, nx, ny, nz FROM (SELECT unnest(range(((nx + 1) // 2) * ((ny + 1) // 2) * ((nz + 1) // 2))) AS i, (nx + 1) // 2 AS mx, (ny + 1) // 2 AS my, nx, ny, nz FROM {dims})) g,
   {w} kx(d, w), {w} ky(d, w), {w} kz(d, w) LEFT JOIN {src} s ON s.x = {cl('2 * g.x + kx.d', 'nx')} AND s.y = {cl('2 * g.y + ky.d', 'ny')} AND s.z = {cl('2 * g.z + kz.d', 'nz')} GROUP BY 1, 2, 3)"""


BASE = f"{CL}, {G8}, d0 AS (SELECT sx AS nx, 16 AS ny, 16 AS nz FROM grid), s0 AS (SELECT x, y, z, a AS v FROM cells)"


def one_down(spark, d, w):
    g = B.grid_for(spark, d, 8)
    return Y.downsample(B.cells(spark, d), g.dims, ["a"], w).select("x", "y", "z", rnd("a").alias("v"))


def simple(w):
    return f"WITH {BASE}, {down_sql(w, 's0', 'v', 'd0')} SELECT x, y, z, {rsql('v')} AS v FROM dn WHERE hits > 0"


@query("pyr_mean2", "K9 K15", simple(MEAN2_W))
def _(spark, d):
    return one_down(spark, d, Y.MEAN2)


@query("pyr_tensor4", "K10", simple(SMOOTH4_W))
def _(spark, d):
    return one_down(spark, d, Y.SMOOTH4)


@query("pyr_gauss5", "K15", simple(GAUSS5_W))
def _(spark, d):
    return one_down(spark, d, Y.gauss5())


@query("pyr_build", "K14", f"""WITH {BASE}, {down_sql(SMOOTH4_W, 's0', 'v', 'd0', 'l1')}, d1 AS (SELECT (nx + 1) // 2 AS nx, 8 AS ny, 8 AS nz FROM d0), s1 AS (SELECT * FROM l1 WHERE hits > 0),
 {down_sql(SMOOTH4_W, 's1', 'v', 'd1', 'l2')} SELECT 0 AS level, x, y, z, {rsql('v')} AS v FROM s0 UNION ALL SELECT 1, x, y, z, {rsql('v')} FROM s1 UNION ALL SELECT 2, x, y, z, {rsql('v')} FROM l2 WHERE hits > 0""")
def _(spark, d):
    g = B.grid_for(spark, d, 8)
    c = B.cells(spark, d).withColumnRenamed("a", "v")
    return Y.stack(Y.build(c, g.dims, "v", Y.SMOOTH4, 2)).select("level", "x", "y", "z", rnd("v").alias("v"))


_UP = lambda src: f"""up AS (SELECT g.x, g.y, g.z, 8 * sum(kx.w * ky.w * kz.w * s.v) AS v FROM (SELECT i % nx AS x, (i // nx) % ny AS y, i // (nx * ny) AS z, nx, ny, nz FROM (SELECT unnest(range(nx * ny * nz)) AS i, nx, ny, nz FROM d0)) g,
   {GAUSS5_W} kx(d, w), {GAUSS5_W} ky(d, w), {GAUSS5_W} kz(d, w)
   JOIN {src} s ON s.x = greatest(least((g.x + kx.d) // 2, (nx + 1) // 2 - 1), 0) AND s.y = greatest(least((g.y + ky.d) // 2, (ny + 1) // 2 - 1), 0) AND s.z = greatest(least((g.z + kz.d) // 2, (nz + 1) // 2 - 1), 0)
   WHERE (g.x + kx.d) % 2 = 0 AND (g.y + ky.d) % 2 = 0 AND (g.z + kz.d) % 2 = 0 GROUP BY 1, 2, 3)"""


@query("pyr_laplacian", "K15", f"""WITH {BASE}, {down_sql(GAUSS5_W, 's0', 'v', 'd0', 'l1')}, s1 AS (SELECT * FROM l1 WHERE hits > 0), {_UP('s1')}
SELECT x, y, z, {rsql('coalesce(s0.v, 0) - coalesce(up.v, 0)')} AS v FROM s0 FULL OUTER JOIN up USING (x, y, z)""")
def _(spark, d):
    g = B.grid_for(spark, d, 8)
    c = B.cells(spark, d).withColumnRenamed("a", "v")
    w = Y.gauss5()
    low = Y.downsample(c, g.dims, ["v"], w)
    return Y.laplacian(c, low, g.dims, "v", w).select("x", "y", "z", rnd("v").alias("v"))


@query("pyr_reconstruct", "K15", f"WITH {BASE} SELECT x, y, z, {rsql('v')} AS v FROM s0")
def _(spark, d):
    g = B.grid_for(spark, d, 8)
    c = B.cells(spark, d).withColumnRenamed("a", "v")
    w = Y.gauss5()
    low = Y.downsample(c, g.dims, ["v"], w)
    back = Y.reconstruct(Y.laplacian(c, low, g.dims, "v", w), low, g.dims, "v", w)
    return back.join(c.select("x", "y", "z"), ["x", "y", "z"], "left_semi").select("x", "y", "z", rnd("v").alias("v"))


@query("pyr_masked", "K11", f"""WITH {BASE}, {down_sql(SMOOTH4_W, 's0', 'v', 'd0')}, f AS (SELECT x >> 1 AS x, y >> 1 AS y, z >> 1 AS z, bit_and(CASE WHEN b < 60 THEN 1 ELSE 0 END) AS flags FROM cells GROUP BY 1, 2, 3)
SELECT x, y, z, {rsql('CASE WHEN coalesce(flags, 0) <> 0 THEN 0 ELSE v END')} AS v FROM dn LEFT JOIN f USING (x, y, z) WHERE hits > 0""")
def _(spark, d):
    g = B.grid_for(spark, d, 8)
    c = B.cells(spark, d)
    flags = c.groupBy(*[F.shiftright(a, 1).alias(a) for a in "xyz"]).agg(F.bit_and(F.when(F.col("b") < 60, 1).otherwise(0)).alias("flags"))
    return Y.downsample_masked(c, g.dims, "a", Y.SMOOTH4, flags, 1).select("x", "y", "z", rnd("a").alias("v"))


@query("pyr_faces", "K12", f"""WITH {CL} SELECT x >> 1 AS x, y >> 1 AS y, z >> 1 AS z, {rsql('coalesce(sum(CASE WHEN x % 2 = 0 THEN a END), 0) / 4')} AS fx,
 {rsql('coalesce(sum(CASE WHEN y % 2 = 0 THEN b END), 0) / 4')} AS fy, {rsql('coalesce(sum(CASE WHEN z % 2 = 0 THEN a * b END), 0) / 4')} AS fz FROM cells GROUP BY 1, 2, 3""")
def _(spark, d):
    c = B.cells(spark, d).select("x", "y", "z", F.col("a").alias("fx"), F.col("b").alias("fy"), (F.col("a") * F.col("b")).alias("fz"))
    return Y.downsample_faces(c, ["fx", "fy", "fz"]).select("x", "y", "z", *[rnd(v).alias(v) for v in ("fx", "fy", "fz")])


def _stag():
    cl = lambda e, n: f"greatest(least({e}, {n} - 1), 0)"
    parts = []
    for own, val in zip("xyz", ("a", "b", "a * b")):
        t = {a: STAGGERED4_W if a == own else SMOOTH4_W for a in "xyz"}
        parts.append(f"""SELECT g.x, g.y, g.z, {', '.join((f'kx.w * ky.w * kz.w * ({val})' if o == own else '0e0') + f' AS f{o}' for o in 'xyz')} FROM tg g, {t['x']} kx(d, w), {t['y']} ky(d, w), {t['z']} kz(d, w)
   JOIN cells s ON s.x = {cl('2 * g.x + kx.d', 'nx')} AND s.y = {cl('2 * g.y + ky.d', 'ny')} AND s.z = {cl('2 * g.z + kz.d', 'nz')}""")
    return f"""WITH {BASE}, tg AS (SELECT i % mx AS x, (i // mx) % 8 AS y, i // (mx * 8) AS z, nx, ny, nz FROM (SELECT unnest(range(((nx + 1) // 2) * 64)) AS i, (nx + 1) // 2 AS mx, nx, ny, nz FROM d0)),
 u AS ({' UNION ALL '.join(parts)}) SELECT x, y, z, {', '.join(rsql(f'sum(f{o})', 5) + f' AS f{o}' for o in 'xyz')} FROM u GROUP BY 1, 2, 3"""


@query("pyr_staggered", "K12", _stag())
def _(spark, d):
    g = B.grid_for(spark, d, 8)
    c = B.cells(spark, d).select("x", "y", "z", F.col("a").alias("fx"), F.col("b").alias("fy"), (F.col("a") * F.col("b")).alias("fz"))
    return Y.downsample_staggered(c, g.dims, ["fx", "fy", "fz"]).select("x", "y", "z", *[rnd(v, 5).alias(v) for v in ("fx", "fy", "fz")])


LEVELED = f"""{FLAGGED}, {CL}, lc AS (SELECT level, bid, x >> level AS x, y >> level AS y, z >> level AS z, avg(a) AS v FROM
   (SELECT c.*, ((x >> 2) + (y >> 2) * nbx + (z >> 2) * nbx * nby) AS bid FROM cells c, grid) k JOIN l1 USING (bid) GROUP BY ALL)"""


def leveled_cells(spark, d, bsx=4, least=ACTIVE_HITS):
    """The cell channel stored at each block's own level, with block flags."""
    g, lv = point_levels(spark, d, bsx, least)
    reg = T.regularize_levels(lv, g)
    flagged = T.block_flags(reg.withColumn("exists", F.col("level") < g.n_levels - 1), g)
    c = B.cells(spark, d).withColumn("bid", K.cell_block_id("x", "y", "z", g)).join(reg, "bid")
    own = c.groupBy("level", "bid", *[K.shr(a, "level").alias(a) for a in "xyz"]).agg(F.avg("a").alias("v"))
    return g, flagged, own


@query("pyr_leveled", "K14 J9", f"WITH {LEVELED} SELECT level, bid, x, y, z, {rsql('v')} AS v FROM lc")
def _(spark, d):
    return leveled_cells(spark, d)[2].select("level", "bid", "x", "y", "z", rnd("v").alias("v"))


def _ghost_sql():
    t = SMOOTH4_W
    cl = lambda e, n: f"greatest(least({e}, {n} - 1), 0)"
    return f"""WITH {LEVELED}, view0 AS (SELECT x, y, z, v FROM lc WHERE level = 0 UNION ALL SELECT 2 * x + i % 2, 2 * y + (i // 2) % 2, 2 * z + i // 4, v FROM lc JOIN fl USING (bid), (SELECT unnest(range(8)) AS i) WHERE lc.level = 1 AND fl.cf),
 tg AS (SELECT bid, 2 * (bid % nbx) + i % 2 AS x, 2 * ((bid // nbx) % nby) + (i // 2) % 2 AS y, 2 * (bid // (nbx * nby)) + i // 4 AS z, sx FROM fl, grid, (SELECT unnest(range(8)) AS i) WHERE level = 0 AND fc)
SELECT 1 AS level, tg.bid, tg.x, tg.y, tg.z, {rsql('sum(kx.w * ky.w * kz.w * s.v)')} AS v FROM tg, {t} kx(d, w), {t} ky(d, w), {t} kz(d, w)
 JOIN view0 s ON s.x = {cl('2 * tg.x + kx.d', 'sx')} AND s.y = {cl('2 * tg.y + ky.d', '16')} AND s.z = {cl('2 * tg.z + kz.d', '16')} GROUP BY ALL"""


@query("pyr_ghosts", "K13", _ghost_sql())
def _(spark, d):
    g, flagged, own = leveled_cells(spark, d)
    return Y.ghost_cells(own, flagged, g, 0, "v").select("level", "bid", "x", "y", "z", rnd("v").alias("v"))
