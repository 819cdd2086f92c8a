"""Stencil steps and blurs on the cell grid, each against a joined long form."""

import math
import uuid

from pyspark.sql import functions as F

from lattica.operators import halo as H, pde
from lattica.plans.common import BID, rnd, rsql
from lattica.plans.registry import query
from lattica.plans.topology import SPLAT, density
from lattica.session import ensure_checkpoint_dir
from lattica.sources import blocks as BK, tables as B

N = 8
F64 = "float64"

# every cell of every block that holds any cell, absent ones at 0
DENSE = f"""{B.CELLS_SQL}, {B.grid_sql(N)}, blk AS (SELECT DISTINCT x >> 3 AS bx, y >> 3 AS byy, z >> 3 AS bz FROM cells),
 dn AS (SELECT bx * 8 + i % 8 AS x, byy * 8 + (i // 8) % 8 AS y, bz * 8 + i // 64 AS z, bx, byy, bz FROM blk, (SELECT unnest(range(512)) AS i)),
 dense AS (SELECT dn.*, coalesce(a, 0e0) AS v FROM dn LEFT JOIN cells USING (x, y, z))"""


def offs(names):
    return "o AS (SELECT * FROM (VALUES " + ", ".join(f"({x}, {y}, {z})" for x, y, z in names) + ") t(dx, dy, dz))"


CROSS = [(0, 0, 0), (1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)]
BOX = [(x, y, z) for z in (-1, 0, 1) for y in (-1, 0, 1) for x in (-1, 0, 1)]
FAR = [o for o in BOX if sum(map(abs, o)) <= 2] + [tuple(2 * t for t in o) for o in CROSS[1:]]
nm = lambda o: "f" + "".join("mnzpq"[t + 2] for t in o)


def taps(offsets, src="dense"):
    """Neighbour values as columns; where no block is, the block's own border value."""
    cols = ", ".join(f"max(CASE WHEN dx = {x} AND dy = {y} AND dz = {z} THEN nv END) AS {nm((x, y, z))}" for x, y, z in offsets)
    cl = lambda c, b: f"greatest(least(d.{c} + d{c}, {b} * 8 + 7), {b} * 8)"
    return f"""{offs(offsets)}, tp AS (SELECT d.x, d.y, d.z, dx, dy, dz, coalesce(n.v, c.v) AS nv FROM {src} d, o
   LEFT JOIN {src} n ON n.x = d.x + dx AND n.y = d.y + dy AND n.z = d.z + dz
   JOIN {src} c ON c.x = {cl('x', 'd.bx')} AND c.y = {cl('y', 'd.byy')} AND c.z = {cl('z', 'd.bz')}),
 w AS (SELECT x, y, z, {cols} FROM tp GROUP BY x, y, z)"""


C = "fzzz"
SX, SY, SZ = ("(fpzz - fnzz)", "(fzpz - fznz)", "(fzzp - fzzn)")
RING = "(fpzz + fnzz + fzpz + fznz + fzzp + fzzn)"
G2 = f"(0.25e0 * ({SX} * {SX} + {SY} * {SY} + {SZ} * {SZ}))"
clip01 = lambda e: f"greatest(least({e}, 1e0), 0e0)"
lim = lambda e: f"greatest(least({e}, 0.1e0), -0.1e0)"


def step_sql(offsets, expr):
    return f"WITH {DENSE}, {taps(offsets)} SELECT x, y, z, {rsql(clip01(f'{C} + ({expr})'))} AS v FROM w"


def packed_a(spark, d):
    g = B.grid_for(spark, d, N)
    return g, H.pack(B.cells(spark, d), g, "a", dtype=F64)


def one_step(spark, d, step):
    g, p = packed_a(spark, d)
    out = H.stencil(p, g, step.width, pde.kernel(step, 0), dtype=F64)
    return H.unpack(out, g, "v", F64).select("x", "y", "z", rnd("v").alias("v"))


@query("sten_laplace", "K4 J3 J4", step_sql(CROSS, f"0.1e0 * ({RING} - 6 * {C}) * sqrt({G2})"))
def _(spark, d):
    return one_step(spark, d, pde.Step(1, 0.1))


@query("sten_bilaplace", "K3", step_sql(FAR, lim(
    f"-0.05e0 * (42 * {C} - 12 * {RING} + " + " + ".join(nm(tuple(2 * t for t in o)) for o in CROSS[1:]) + " + 2 * ("
    + " + ".join(nm(o) for o in BOX if sum(map(abs, o)) == 2) + f")) * sqrt({G2})")))
def _(spark, d):
    return one_step(spark, d, pde.Step(2, 0.05))


@query("sten_diffuse", "K5", step_sql(CROSS, f"0.3e0 * ({RING} / 6 - {C})"))
def _(spark, d):
    return one_step(spark, d, pde.Step(3, 0.3))


@query("sten_diffuse_implicit", "K5", step_sql(CROSS, f"({C} + 0.3e0 * {RING}) / (1 + 6 * 0.3e0) - {C}"))
def _(spark, d):
    return one_step(spark, d, pde.Step(17, 0.3))


_SIDES = [nm(o) for o in CROSS[1:]]
_GW = lambda f, neg: f"exp(-pow(({f} - {C}) / 0.2e0, 2))" if neg else f"(1 / (1 + pow(({f} - {C}) / 0.2e0, 2)))"


@query("sten_peronamalik", "K6", step_sql(CROSS, "0.1e0 * (" + " + ".join(f"{_GW(f, False)} * ({f} - {C})" for f in _SIDES) + ")"))
def _(spark, d):
    return one_step(spark, d, pde.Step(14, 0.1, alpha=0.2))


@query("sten_peronamalik_implicit", "K6", step_sql(CROSS, f"({C} + 0.1e0 * (" + " + ".join(f"{_GW(f, True)} * {f}" for f in _SIDES)
       + ")) / (1 + 0.1e0 * (" + " + ".join(_GW(f, True) for f in _SIDES) + f")) - {C}"))
def _(spark, d):
    return one_step(spark, d, pde.Step(15, 0.1, alpha=-0.2))


_SEC = lambda p, q: f"({p} + {q} - 2 * {C})"
_MEAN = (f"((0.25e0 * ({SY} * {SY} + {SZ} * {SZ})) * {_SEC('fpzz', 'fnzz')} + (0.25e0 * ({SX} * {SX} + {SZ} * {SZ})) * {_SEC('fzpz', 'fznz')}"
         f" + (0.25e0 * ({SX} * {SX} + {SY} * {SY})) * {_SEC('fzzp', 'fzzn')}"
         f" - 2 * (0.25e0 * {SX} * {SY} * 0.25e0 * (fppz - fpnz - fnpz + fnnz) + 0.25e0 * {SX} * {SZ} * 0.25e0 * (fpzp - fpzn - fnzp + fnzn)"
         f" + 0.25e0 * {SY} * {SZ} * 0.25e0 * (fzpp - fzpn - fznp + fznn)))")
NEAR19 = [o for o in BOX if sum(map(abs, o)) <= 2]
CURV = lim(f"0.2e0 * CASE WHEN {G2} > 1e-7 THEN {_MEAN} / {G2} ELSE 0 END")


@query("sten_meancurv", "K2 K1", step_sql(NEAR19, CURV))
def _(spark, d):
    return one_step(spark, d, pde.Step(4, 0.2))


_AGAIN = lambda offsets: taps(offsets, 's1').replace('o AS (', 'o2 AS (', 1).replace('tp AS', 'tp2 AS').replace(' d, o\n', ' d, o2\n').replace('FROM tp ', 'FROM tp2 ').replace('w AS', 'w2 AS')


# the first sweep inflates, the second shrinks
@query("sten_taubin", "K2 K1", f"""WITH {DENSE}, {taps(NEAR19)}, s1 AS (SELECT w.x, w.y, w.z, bx, byy, bz, {clip01(f'{C} - 0.9e0 * ({CURV})')} AS v FROM w JOIN dn USING (x, y, z)),
 {_AGAIN(NEAR19)} SELECT x, y, z, {rsql(clip01(f'{C} + ({CURV})'))} AS v FROM w2""")
def _(spark, d):
    g, p = packed_a(spark, d)
    return H.unpack(pde.smooth(p, g, pde.Step(4, 0.2, taubin=0.9), 2, order="jacobi", dtype=F64), g, "v", F64).select("x", "y", "z", rnd("v").alias("v"))


@query("sten_diffuse_sweeps", "K1 T1", f"""WITH {DENSE}, {taps(CROSS)}, s1 AS (SELECT w.x, w.y, w.z, bx, byy, bz, {clip01(f'{C} + 0.3e0 * ({RING} / 6 - {C})')} AS v FROM w JOIN dn USING (x, y, z)),
 {taps(CROSS, 's1').replace('o AS (', 'o2 AS (', 1).replace('tp AS', 'tp2 AS').replace(' d, o\n', ' d, o2\n').replace('FROM tp ', 'FROM tp2 ').replace('w AS', 'w2 AS')}
SELECT x, y, z, {rsql(clip01(f'{C} + 0.3e0 * ({RING} / 6 - {C})'))} AS v FROM w2""")
def _(spark, d):
    g, p = packed_a(spark, d)
    out = pde.smooth(p, g, pde.Step(3, 0.3), 1, dtype=F64)  # one asked for, two run
    return H.unpack(out, g, "v", F64).select("x", "y", "z", rnd("v").alias("v"))


def colour_sql(offsets, expr, colour, n_colours, sweeps, band=None):
    """Colour after colour: blocks of one colour are renewed from the latest state, one CTE each."""
    val = clip01(f"{C} + ({expr})")
    cols = ", ".join(f"max(CASE WHEN dx = {x} AND dy = {y} AND dz = {z} THEN nv END) AS {nm((x, y, z))}" for x, y, z in offsets)
    cl = lambda c, b: f"greatest(least(d.{c} + d{c}, {b} * 8 + 7), {b} * 8)"
    parts, last = [offs(offsets), "s0 AS MATERIALIZED (SELECT x, y, z, bx, byy, bz, v FROM dense)"], "s0"
    for k in range(sweeps * n_colours):
        held = val if band is None else f"greatest(least({val}, least(ref + {band[1]}e0, 1e0)), greatest(ref - {band[0]}e0, 0e0))"
        parts.append(f"""t{k} AS MATERIALIZED (SELECT x, y, z, {cols} FROM (SELECT d.x, d.y, d.z, dx, dy, dz, coalesce(n.v, c.v) AS nv FROM {last} d CROSS JOIN o
   LEFT JOIN {last} n ON n.x = d.x + dx AND n.y = d.y + dy AND n.z = d.z + dz
   JOIN {last} c ON c.x = {cl('x', 'd.bx')} AND c.y = {cl('y', 'd.byy')} AND c.z = {cl('z', 'd.bz')} WHERE {colour} = {k % n_colours}) GROUP BY x, y, z)""")
        parts.append(f"s{k + 1} AS MATERIALIZED (SELECT s.x, s.y, s.z, s.bx, s.byy, s.bz, CASE WHEN t.x IS NULL THEN s.v ELSE {held} END AS v FROM {last} s LEFT JOIN t{k} t USING (x, y, z) JOIN (SELECT x, y, z, v AS ref FROM s0) USING (x, y, z))")
        last = f"s{k + 1}"
    return f"WITH {DENSE}, {', '.join(parts)} SELECT x, y, z, {rsql('v')} AS v FROM {last}"


@query("sten_meancurv_color8", "K1 K2 T5 G8", colour_sql(NEAR19, CURV, "((d.bx & 1) + (d.byy & 1) * 2 + (d.bz & 1) * 4)", 8, 2))
def _(spark, d):
    g, p = packed_a(spark, d)
    out = pde.smooth(p, g, pde.Step(4, 0.2), 2, order="color8", dtype=F64)
    return H.unpack(out, g, "v", F64).select("x", "y", "z", rnd("v").alias("v"))


@query("sten_diffuse_band", "K1", colour_sql(CROSS, f"0.5e0 * ({RING} / 6 - {C})", "((d.bx + d.byy + d.bz) & 1)", 2, 2, (0.05, 0.02)))
def _(spark, d):
    g, p = packed_a(spark, d)
    out = pde.smooth(p, g, pde.Step(3, 0.5, band=(0.05, 0.02)), 2, order="redblack", dtype=F64)
    return H.unpack(out, g, "v", F64).select("x", "y", "z", rnd("v").alias("v"))


@query("blk_store_roundtrip", "S9", f"WITH {DENSE} SELECT x, y, z, {rsql('v')} AS v FROM dense")
def _(spark, d):
    """Blocks written in Morton order to the shared folder and read back."""
    g, p = packed_a(spark, d)
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/blocks-{uuid.uuid4().hex}"
    BK.write_blocks(p, path, g)
    return H.unpack(BK.read_blocks(spark, path), g, "v", F64).select("x", "y", "z", rnd("v").alias("v"))


_DENSE_OF = DENSE[DENSE.index("blk AS"):]
_AGAIN = (taps(NEAR19, "s1").replace("o AS (", "o2 AS (", 1).replace("tp AS", "tp2 AS").replace(" d, o\n", " d, o2\n")
          .replace("FROM tp ", "FROM tp2 ").replace("w AS", "w2 AS"))


@query("pipeline_surface", "A9 E11 K1 K2 A4", f"""WITH {SPLAT}, cells AS (SELECT x, y, z, dens / 65535e0 AS a FROM dens), {_DENSE_OF}, {taps(NEAR19)},
 s1 AS (SELECT w.x, w.y, w.z, bx, byy, bz, {clip01(f'{C} + ({CURV})')} AS v FROM w JOIN dn USING (x, y, z)), {_AGAIN},
 s2 AS (SELECT x, y, z, {clip01(f'{C} + ({CURV})')} AS v FROM w2)
SELECT x, y, CAST(sum(CASE WHEN v > 0.5e0 THEN 1 ELSE 0 END) AS BIGINT) AS inside, {rsql('sum(v)', 4)} AS total FROM s2 GROUP BY 1, 2""")
def _(spark, d):
    """Points to density, two sweeps of curvature flow, projection along z."""
    g, dens = density(spark, d)
    packed = H.pack(dens.select("x", "y", "z", (F.col("dens") / 65535.0).alias("v")), g, "v", dtype=F64)
    smooth = H.unpack(pde.smooth(packed, g, pde.Step(4, 0.2), 2, dtype=F64), g, "v", F64)
    return smooth.groupBy("x", "y").agg(F.count_if(F.col("v") > 0.5).alias("inside"), rnd(F.sum("v"), 4).alias("total"))


def blur_sql(sigma, sharp):
    """Bell weights by distance, over their sum; sharpening takes a share of the blur from the raised centre."""
    bell = lambda d2: math.exp(-d2 / (2 * sigma * sigma))
    total = bell(0) + 6 * bell(1) + 12 * bell(2) + 8 * bell(3)
    k = lambda o: (bell(sum(t * t for t in o)) / total) * (-sharp if sharp else 1) + (sharp + 1 if sharp and o == (0, 0, 0) else 0)
    return f"""WITH {DENSE}, o AS (SELECT * FROM (VALUES {', '.join(f'({x}, {y}, {z}, {k((x, y, z)):.17e})' for x, y, z in BOX)}) t(dx, dy, dz, k))
SELECT d.x, d.y, d.z, {rsql('sum(k * coalesce(n.v, 0))')} AS v FROM dense d, grid, o LEFT JOIN dense n ON n.x = greatest(least(d.x + dx, sx - 1), 0)
 AND n.y = greatest(least(d.y + dy, 15), 0) AND n.z = greatest(least(d.z + dz, 15), 0) GROUP BY 1, 2, 3"""


@query("filt_gauss3", "K8 T9", blur_sql(1.5, 0.0))
def _(spark, d):
    g, p = packed_a(spark, d)
    return H.unpack(pde.convolve3(p, g, pde.gauss3(1.0, 0.0), F64), g, "v", F64).select("x", "y", "z", rnd("v").alias("v"))


@query("filt_sharpen3", "K8", blur_sql(0.6, 1.2))
def _(spark, d):
    g, p = packed_a(spark, d)
    return H.unpack(pde.convolve3(p, g, pde.gauss3(1.0, 0.6), F64), g, "v", F64).select("x", "y", "z", rnd("v").alias("v"))


@query("sten_neighbourhood", "J4", f"""WITH {B.CELLS_SQL}, {offs(CROSS[1:])} SELECT c.x, c.y, c.z, CAST(count(n.a) AS BIGINT) AS active, {rsql('coalesce(sum(n.a), 0) - 6 * any_value(c.a)')} AS lap
FROM cells c, o LEFT JOIN cells n ON n.x = c.x + dx AND n.y = c.y + dy AND n.z = c.z + dz GROUP BY 1, 2, 3""")
def _(spark, d):
    nb = H.neighbour_values(B.cells(spark, d), CROSS[1:], "a")
    ring = sum((F.coalesce(f"a_{i}", F.lit(0.0)) for i in range(6)), F.lit(0.0))
    return nb.select("x", "y", "z", "active", rnd(ring - F.col("a") * 6).alias("lap"))
