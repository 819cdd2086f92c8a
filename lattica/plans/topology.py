"""Block topology and point-to-density queries."""

import uuid

from pyspark.sql import functions as F

from lattica.functions import keys as K
from lattica.operators import channels as C, points as P, topology as T
from lattica.plans.common import BID, OFF26, rnd, rsql
from lattica.plans.registry import query
from lattica.schema import BLOCK_FLAGS
from lattica.session import ensure_checkpoint_dir
from lattica.sources import ply, tables as B

G4 = B.grid_sql(4)
_seq = lambda p, n, edge=4, r=1: (f"(SELECT unnest(range(CAST(greatest(floor((p{p} - {r}e0) / {edge}e0), 0) AS BIGINT), "
                                  f"CAST(least(floor((p{p} + {r}e0) / {edge}e0), {n} - 1) AS BIGINT) + 1)))")
HITS = f"""hits AS (SELECT *, hx + hy * nbx + hz * nbx * nby AS bid FROM (SELECT *, unnest(range(CAST(greatest(floor((pz - 1e0) / 4e0), 0) AS BIGINT), CAST(least(floor((pz + 1e0) / 4e0), nbz - 1) AS BIGINT) + 1)) AS hz FROM
 (SELECT *, unnest(range(CAST(greatest(floor((py - 1e0) / 4e0), 0) AS BIGINT), CAST(least(floor((py + 1e0) / 4e0), nby - 1) AS BIGINT) + 1)) AS hy FROM
 (SELECT *, unnest(range(CAST(greatest(floor((px - 1e0) / 4e0), 0) AS BIGINT), CAST(least(floor((px + 1e0) / 4e0), nbx - 1) AS BIGINT) + 1)) AS hx FROM points, grid))))"""
LEVELS = f"""{B.POINTS_SQL}, {G4}, {OFF26}, {HITS},
 l0 AS (SELECT i AS bid, i % nbx AS bx, (i // nbx) % nby AS byy, i // (nbx * nby) AS bz, CASE WHEN i IN (SELECT bid FROM hits GROUP BY 1 HAVING count(*) >= 117) THEN 0 ELSE 2 END AS level
   FROM (SELECT unnest(range(nbx * nby * nbz)) AS i, nbx, nby FROM grid))"""
_NB = lambda src: f"""(SELECT a.bid, min(b.level) AS nmin, max(b.level) AS nmax FROM {src} a, off
   JOIN {src} b ON b.bx = a.bx + dx AND b.byy = a.byy + dy AND b.bz = a.bz + dz GROUP BY 1)"""
REG = f"""{LEVELS}, l1 AS (SELECT l0.* EXCLUDE (level), CASE WHEN level >= 1 AND nmin = 0 THEN 1 ELSE level END AS level FROM l0 LEFT JOIN {_NB('l0')} n USING (bid))"""
_FB = BLOCK_FLAGS
FLAGGED = f"""{REG}, fl AS (SELECT l1.bid, level, level < 2 AS ex, coalesce(nmax > level, false) AS fc, coalesce(nmin < level, false) AS cf,
  (bx = 0 OR bx = nbx - 1 OR byy = 0 OR byy = nby - 1 OR bz = 0 OR bz = nbz - 1) AS brd FROM l1 LEFT JOIN {_NB('l1')} n USING (bid), grid)"""


ACTIVE_HITS = 117
"""Points around a block of four cells from which it is stored finely: about a quarter of all blocks."""


def point_levels(spark, d, bsx=4, least=ACTIVE_HITS):
    g = B.grid_for(spark, d, bsx)
    active = T.active_blocks(B.points(spark, d), g, 1.0, least)
    return g, T.assign_levels(T.all_blocks(spark, g), active, g)


@query("pt_block_bin", "J6", f"""WITH {B.POINTS_SQL}, {B.grid_sql(8)}
SELECT (CAST(floor(px) AS BIGINT) >> 3) + (CAST(floor(py) AS BIGINT) >> 3) * nbx + (CAST(floor(pz) AS BIGINT) >> 3) * nbx * nby AS bid,
 CAST(count(*) AS BIGINT) AS n, min(px) AS lo, {rsql('sum(mass)', 2)} AS mass FROM points, grid GROUP BY 1""")
def _(spark, d):
    g = B.grid_for(spark, d, 8)
    return P.bin_points(B.points(spark, d), g).groupBy("bid").agg(
        F.count("*").alias("n"), F.min("px").alias("lo"), rnd(F.sum("mass"), 2).alias("mass"))


@query("blk_active", "G2 J7", f"WITH {B.POINTS_SQL}, {G4}, {HITS} SELECT bid, CAST(count(*) AS BIGINT) AS n FROM hits GROUP BY 1")
def _(spark, d):
    g = B.grid_for(spark, d, 4)
    return T.block_hits(B.points(spark, d), g, 1.0).groupBy("bid").agg(F.count("*").alias("n"))


@query("blk_levels", "G1 G3", f"WITH {LEVELS} SELECT bid, bx, byy, bz, level FROM l0")
def _(spark, d):
    return point_levels(spark, d)[1].withColumnRenamed("by", "byy")


@query("blk_neighbours", "J2", f"""WITH {LEVELS} SELECT a.bid, CAST(count(*) AS BIGINT) AS n, min(b.level) AS finest, max(b.level) AS coarsest,
 CAST(sum(CASE WHEN abs(dx) + abs(dy) + abs(dz) = 1 AND b.level = 0 THEN 1 ELSE 0 END) AS BIGINT) AS fine_faces
FROM l0 a, off JOIN l0 b ON b.bx = a.bx + dx AND b.byy = a.byy + dy AND b.bz = a.bz + dz GROUP BY 1""")
def _(spark, d):
    g, lv = point_levels(spark, d)
    nb = T.tell_neighbours(lv.select("bid", "level"), g, ["level"])
    face = F.abs("dx") + F.abs("dy") + F.abs("dz") == 1
    return nb.groupBy("bid").agg(F.count("*").alias("n"), F.min("level").alias("finest"), F.max("level").alias("coarsest"),
                                 F.count_if(face & (F.col("level") == 0)).alias("fine_faces"))


@query("blk_regularize", "G4", f"WITH {REG} SELECT bid, level FROM l1")
def _(spark, d):
    g, lv = point_levels(spark, d)
    return T.regularize_levels(lv, g)


@query("blk_flags", "G5", f"""WITH {FLAGGED} SELECT bid, level, CAST((CASE WHEN ex THEN {_FB['EXISTS']} ELSE 0 END) + (CASE WHEN brd THEN {_FB['DOM_BORDER']} ELSE 0 END)
 + (CASE WHEN fc THEN {_FB['FINE_COARSE']} ELSE 0 END) + (CASE WHEN cf THEN {_FB['COARSE_FINE']} ELSE 0 END)
 + (CASE WHEN NOT ex AND NOT fc AND NOT cf THEN {_FB['UNIFORM_EMPTY']} ELSE 0 END) AS INTEGER) AS flags FROM fl""")
def _(spark, d):
    g, lv = point_levels(spark, d)
    reg = T.regularize_levels(lv, g).withColumn("exists", F.col("level") < g.n_levels - 1)
    return T.block_flags(reg, g)


@query("blk_transition_dist", "G5 P4", f"""WITH {REG}, near AS (SELECT a.bid, a.level, 4 >> a.level AS e, dx, dy, dz FROM l1 a, off JOIN l1 b
   ON b.bx = a.bx + dx AND b.byy = a.byy + dy AND b.bz = a.bz + dz WHERE b.level > a.level),
 v AS (SELECT *, unnest(range(CAST(e * e * e AS BIGINT))) AS vid FROM near),
 dd AS (SELECT bid, level, vid, min(pow(greatest(dx * e - (vid % e + 0.5e0), 0e0, vid % e + 0.5e0 - (dx + 1) * e), 2)
   + pow(greatest(dy * e - ((vid // e) % e + 0.5e0), 0e0, (vid // e) % e + 0.5e0 - (dy + 1) * e), 2)
   + pow(greatest(dz * e - (vid // (e * e) + 0.5e0), 0e0, vid // (e * e) + 0.5e0 - (dz + 1) * e), 2)) AS d2 FROM v GROUP BY ALL)
SELECT bid, level, vid, CAST(floor(least(sqrt(d2), 6e0) * 1024e0) AS INTEGER) AS dist FROM dd""")
def _(spark, d):
    g, lv = point_levels(spark, d)
    return T.transition_distance(T.regularize_levels(lv, g), g)


_CENSUS = """CAST(count(*) AS BIGINT) AS n_blocks, CAST(count(*) * pow(4 >> level, 3) AS BIGINT) AS n_cells"""


@query("blk_census", "A8 G14", f"WITH {REG} SELECT level, {_CENSUS}, {rsql('count(*) / CAST(max(nbx * nby * nbz) AS DOUBLE)')} AS fill FROM l1, grid GROUP BY level")
def _(spark, d):
    g, lv = point_levels(spark, d)
    return T.level_census(T.regularize_levels(lv, g), g).withColumn("fill", rnd("fill"))


_R3 = "sqrt(" + " + ".join(f"pow(({c} + 0.5e0) / least(nbx, nby, nbz) - 0.2e0, 2)" for c in ("bx", "byy", "bz")) + ")"
_LONE = "((bx = nbx - 3 AND byy = nby - 3 AND bz = nbz // 2) OR (bx = nbx - 4 AND byy = nby - 4 AND bz = nbz // 2 - 1))"


@query("blk_refinement_maps", "S6", f"""WITH {B.POINTS_SQL}, {G4}, b AS (SELECT DISTINCT bx + byy * nbx + bz * nbx * nby AS bid, bx, byy, bz, nbx, nby, nbz
  FROM (SELECT CAST(floor(px) AS BIGINT) >> 2 AS bx, CAST(floor(py) AS BIGINT) >> 2 AS byy, CAST(floor(pz) AS BIGINT) >> 2 AS bz, nbx, nby, nbz FROM points, grid))
SELECT bid, 0 AS kind, 0 AS level FROM b
UNION ALL SELECT bid, 1, CASE WHEN {_LONE} OR {_R3.replace('0.2e0', '0.5e0')} < 0.4e0 OR (bx = nbx // 2 AND bz = nbz // 2) THEN 0 ELSE 2 END FROM b
UNION ALL SELECT bid, 2, CASE WHEN {_LONE} OR {_R3} < 0.8e0 THEN 0 ELSE 2 END FROM b
UNION ALL SELECT bid, 3, CASE WHEN {_LONE} OR {_R3} < 0.4e0 THEN 0 ELSE 2 END FROM b""")
def _(spark, d):
    g = B.grid_for(spark, d, 4)
    blocks = T.with_coords(P.bin_points(B.points(spark, d), g).select("bid").distinct(), g)
    out = None
    for kind in range(4):
        one = T.refinement_map(blocks, g, kind, (0.5, 0.5, 0.5)).select("bid", F.lit(kind).alias("kind"), "level")
        out = one if out is None else out.unionByName(one)
    return out


@query("blk_const_detect", "G7", f"""WITH {B.CELLS_SQL}, {G4} SELECT {BID(2)} AS bid, min(b) AS vmin, max(b) AS vmax,
 (max(b) - min(b) <= 300 AND count(*) = 64) AS is_const FROM cells, grid GROUP BY 1""")
def _(spark, d):
    return T.const_blocks(B.cells(spark, d), B.grid_for(spark, d, 4), "b", 300.0)


@query("blk_flag_edit", "G13 G6", f"""WITH {FLAGGED}, w AS (SELECT bid, (CASE WHEN ex THEN 4096 ELSE 0 END) + (CASE WHEN brd THEN 2 ELSE 0 END) AS f FROM fl)
SELECT bid, CAST((f & ~2) | 1024 AS INTEGER) AS flags FROM w""")
def _(spark, d):
    g, lv = point_levels(spark, d)
    reg = T.regularize_levels(lv, g).withColumn("exists", F.col("level") < g.n_levels - 1)
    keep = _FB["EXISTS"] | _FB["DOM_BORDER"]
    f = T.block_flags(reg, g).select("bid", F.col("flags").bitwiseAND(F.lit(keep)).alias("flags"))
    return f.select("bid", T.set_flags(T.clear_flags("flags", _FB["DOM_BORDER"]), _FB["TMP_MARK"]).cast("int").alias("flags"))


def splat_sql(r: float, nb: float) -> str:
    m = r + nb
    ax = lambda p, s: f"unnest(range(CAST(greatest(ceil({p} - {m}e0 - 0.5e0), 0) AS BIGINT), CAST(least(floor({p} + {m}e0 - 0.5e0), {s} - 1) AS BIGINT) + 1))"
    return f"""{B.POINTS_SQL}, {B.grid_sql(8)}, dp AS (SELECT DISTINCT px, py, pz, sx FROM points, grid),
 vx AS (SELECT *, {ax('px', 'sx')} AS x FROM dp), vy AS (SELECT *, {ax('py', 16)} AS y FROM vx), vz AS (SELECT *, {ax('pz', 16)} AS z FROM vy),
 dd AS (SELECT x, y, z, (z - (pz - 0.5e0)) * (z - (pz - 0.5e0)) + (y - (py - 0.5e0)) * (y - (py - 0.5e0)) + (x - (px - 0.5e0)) * (x - (px - 0.5e0)) AS d2 FROM vz),
 splat AS (SELECT x, y, z, CAST(floor(min(d2) * {1.0 / (m * m)!r}e0 * 65535e0 + 0.5e0) AS INTEGER) AS q FROM dd WHERE d2 <= {m * m}e0 GROUP BY 1, 2, 3),
 lin AS (SELECT *, q / 65535e0 AS rel, sqrt(q / 65535e0 * {m * m}e0) - {r}e0 AS dist FROM splat),
 dens AS (SELECT x, y, z, CAST(CASE WHEN rel < 0.999e0 THEN floor((1e0 - CASE WHEN dist < -{r}e0 THEN 0e0 WHEN dist >= {m}e0 THEN 1e0 ELSE (dist + {r}e0) / ({m}e0 + {r}e0) END) * 65535e0 + 0.5e0) ELSE 0 END AS INTEGER) AS dens FROM lin)"""


SPLAT = splat_sql(1.0, 1.0)


def density(spark, d):
    g = B.grid_for(spark, d, 8)
    return g, P.finalise_density(P.splat_min_distance(B.points(spark, d), g, 1.0, 1.0), 1.0, 1.0)


@query("splat_min", "A9 J8 A26", f"WITH {SPLAT} SELECT x, y, z, q FROM splat")
def _(spark, d):
    return P.splat_min_distance(B.points(spark, d), B.grid_for(spark, d, 8), 1.0, 1.0)


@query("splat_density", "E11", f"WITH {SPLAT} SELECT x, y, z, dens FROM dens")
def _(spark, d):
    return density(spark, d)[1]


@query("splat_density_stats", "A9 E11 A1", f"""WITH {SPLAT} SELECT {BID(3)} AS bid, CAST(count(*) AS BIGINT) AS n, {rsql('avg(dens)')} AS avg, {rsql('stddev_pop(dens)')} AS var,
 min(dens) AS min, max(dens) AS max, max(dens) - min(dens) AS span FROM dens, grid WHERE dens > 0 GROUP BY 1""")
def _(spark, d):
    g, dens = density(spark, d)
    st = C.channel_stat(dens.withColumn("bid", K.cell_block_id("x", "y", "z", g)), ["dens"], ["bid"], zero_eps=0.0)
    return st.select("bid", "n", rnd("avg").alias("avg"), rnd("var").alias("var"), "min", "max", "span")


@query("scatter_reduce", "A26", f"""WITH {B.POINTS_SQL} SELECT CAST(floor(px) AS BIGINT) AS x, CAST(floor(py) AS BIGINT) AS y, CAST(floor(pz) AS BIGINT) AS z,
 max(mass) AS hi, min(mass) AS lo, {rsql('sum(mass)', 2)} AS total FROM points GROUP BY 1, 2, 3""")
def _(spark, d):
    p = B.points(spark, d)
    return p.groupBy(*[F.floor(a).alias(c) for a, c in zip(("px", "py", "pz"), "xyz")]).agg(
        F.max("mass").alias("hi"), F.min("mass").alias("lo"), rnd(F.sum("mass"), 2).alias("total"))


@query("pt_bounding_box", "S1", f"WITH {B.POINTS_SQL} SELECT {', '.join(f'{f}({c}) AS {f}_{c}' for c in ('px', 'py', 'pz') for f in ('min', 'max'))}, CAST(count(*) AS BIGINT) AS n FROM points")
def _(spark, d):
    return P.bounding_box(B.points(spark, d))


@query("pt_ply", "S1", f"""WITH {B.POINTS_SQL}, s AS (SELECT px, py, pz FROM points) SELECT CAST(floor(px) AS BIGINT) >> 3 AS bx, CAST(count(*) AS BIGINT) AS n, {', '.join(f'min({c}) AS lo_{c}, max({c}) AS hi_{c}' for c in ('px', 'py', 'pz'))} FROM s GROUP BY 1""")
def _(spark, d):
    """The points written as PLY parts in the shared folder and read back."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/ply-{uuid.uuid4().hex}"
    back = ply.read(spark, ply.write(B.points(spark, d), path))
    ends = [e for c in ("px", "py", "pz") for e in (F.min(c).alias(f"lo_{c}"), F.max(c).alias(f"hi_{c}"))]
    return back.groupBy(F.shiftright(F.floor("px"), 3).alias("bx")).agg(F.count("*").alias("n"), *ends)


@query("pt_instances", "§3.1", f"""WITH {B.POINTS_SQL}, shape AS (SELECT DISTINCT (n_nationkey % 5 - 2) * 0.5e0 AS sx, (n_nationkey // 5 - 2) * 0.5e0 AS sy, n_regionkey * 0.5e0 AS sz FROM nation),
 spot AS (SELECT px, py, pz FROM points)
SELECT CAST(floor(px + sx) AS BIGINT) >> 3 AS bx, CAST(count(*) AS BIGINT) AS n, {rsql('sum(py + sy)', 3)} AS ty FROM spot, shape GROUP BY 1""")
def _(spark, d):
    # the shape is a fixed model, the spots grow with the data
    k = F.col("n_nationkey")
    base = B.table(spark, d, "nation").select((k % 5 - 2).cast("double").alias("px"), (F.floor(k / 5) - 2).cast("double").alias("py"), F.col("n_regionkey").cast("double").alias("pz"))
    spots = B.points(spark, d)
    return P.instantiate(base, spots, 0.5).groupBy(F.shiftright(F.floor("px"), 3).alias("bx")).agg(
        F.count("*").alias("n"), rnd(F.sum("py"), 3).alias("ty"))
