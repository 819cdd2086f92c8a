"""Addressing, predicates, codecs and hashes on the cell and point tables."""

from pyspark.sql import functions as F

from lattica.functions import codec, keys as K
from lattica.operators import channels as C, points as P, topology as T
from lattica.plans.common import BID, rnd, rsql
from lattica.plans.registry import query
from lattica.sources import tables as B

G4 = B.grid_sql(4)


@query("grid_address", "P1", f"""WITH {B.CELLS_SQL}, {G4}
SELECT x, y, z, x >> 2 AS bx, y >> 2 AS by, z >> 2 AS bz, {BID(2)} AS bid,
  (x & 3) + (y & 3) * 4 + (z & 3) * 16 AS vid, x AS x_back, y AS y_back, z AS z_back
FROM cells, grid""")
def _(spark, d):
    g = B.grid_for(spark, d, 4)
    c = B.cells(spark, d)
    keyed = c.select(
        "x", "y", "z", *[K.block_coord(n, g).alias(f"b{n}") for n in "xyz"],
        K.cell_block_id("x", "y", "z", g).alias("bid"), K.voxel_id("x", "y", "z", 4).alias("vid"))
    blk, vox = K.block_coords("bid", g), K.voxel_coords("vid", 4)
    return keyed.select("*", *[(b * 4 + v).alias(f"{n}_back") for n, b, v in zip("xyz", blk, vox)])


@query("range_filter", "P2", f"""WITH {B.CELLS_SQL}, {B.grid_sql(8)}
SELECT {BID(3)} AS bid, CAST(count(*) AS BIGINT) AS n FROM cells, grid
WHERE x BETWEEN 10 AND sx - 10 AND y >= 2 AND y < 9 AND z >= 1 AND z < 8 GROUP BY 1""")
def _(spark, d):
    g = B.grid_for(spark, d, 8)
    c = B.cells(spark, d).where((F.col("x").between(10, g.sx - 10)) & (F.col("y") >= 2) & (F.col("y") < 9)
                                & (F.col("z") >= 1) & (F.col("z") < 8) & K.in_range("x", "y", "z", g))
    return c.groupBy(K.cell_block_id("x", "y", "z", g).alias("bid")).agg(F.count("*").alias("n"))


@query("block_box", "P3", f"""WITH {B.POINTS_SQL}, {G4}, hit AS (
SELECT CAST(floor(px) AS BIGINT) >> 2 AS bx, CAST(floor(py) AS BIGINT) >> 2 AS "by", CAST(floor(pz) AS BIGINT) >> 2 AS bz FROM points)
SELECT bx, "by", bz, CAST(count(*) AS BIGINT) AS n FROM hit, grid
WHERE (bx + 1) * 4 > 30.5e0 AND bx * 4 < sx / 2 AND ("by" + 1) * 4 > 2e0 AND "by" * 4 < 9e0 AND (bz + 1) * 4 > 4e0 AND bz * 4 < 12e0
GROUP BY 1, 2, 3""")
def _(spark, d):
    g = B.grid_for(spark, d, 4)
    b = B.points(spark, d).select(*[K.block_coord(F.floor(p), g).alias(n) for p, n in zip(("px", "py", "pz"), ("bx", "by", "bz"))])
    return b.where(K.block_intersects_box("bx", "by", "bz", (30.5, 2.0, 4.0), (g.sx / 2, 9.0, 12.0), 4)).groupBy(
        "bx", "by", "bz").agg(F.count("*").alias("n"))


_BOXD = "+".join(f"pow(greatest({lo} - p{c}, 0e0, p{c} - {hi}), 2)" for c, lo, hi in
                 (("x", "100e0", "200e0"), ("y", "4e0", "8e0"), ("z", "4e0", "8e0")))


@query("point_box_dist", "P4", f"""WITH {B.POINTS_SQL}, d AS (SELECT {_BOXD} AS d2 FROM points)
SELECT CAST(floor(sqrt(d2) / 10e0) AS BIGINT) AS shell, CAST(count(*) AS BIGINT) AS n, {rsql('sum(d2)', 3)} AS total,
{rsql('max(d2)')} AS far FROM d GROUP BY 1""")
def _(spark, d):
    d2 = K.dist_to_box_sq(("px", "py", "pz"), (100.0, 4.0, 4.0), (200.0, 8.0, 8.0))
    return B.points(spark, d).select(d2.alias("d2")).groupBy(F.floor(F.sqrt("d2") / 10.0).alias("shell")).agg(
        F.count("*").alias("n"), rnd(F.sum("d2"), 3).alias("total"), rnd(F.max("d2")).alias("far"))


@query("coord_clip", "P5", f"""WITH {B.CELLS_SQL}, {B.grid_sql(8)}, c AS (SELECT x, y, z, x - 40 AS qx, y * 3 - 6 AS qy, z - 2 AS qz, sx FROM cells, grid)
SELECT x, y, z, CAST(greatest(least(qx, sx - 1), 0) AS BIGINT) AS cx, CAST(greatest(least(qy, 15), 0) AS BIGINT) AS cy,
 CAST(greatest(least(qz, 15), 0) AS BIGINT) AS cz,
 CASE WHEN qx < 0 OR qx >= sx THEN 0 WHEN qy < 0 OR qy >= 16 THEN 1 WHEN qz < 0 OR qz >= 16 THEN 2 ELSE -1 END AS clip_dir,
 CASE WHEN qx < 0 THEN 0 WHEN qx >= sx THEN 1 WHEN qy < 0 THEN 0 WHEN qy >= 16 THEN 1 WHEN qz < 0 THEN 0 WHEN qz >= 16 THEN 1 ELSE -1 END AS clip_face
FROM c""")
def _(spark, d):
    g = B.grid_for(spark, d, 8)
    c = B.cells(spark, d).select("x", "y", "z", (F.col("x") - 40).alias("qx"), (F.col("y") * 3 - 6).alias("qy"), (F.col("z") - 2).alias("qz"))
    return c.select("x", "y", "z", *[e.alias(n) for n, e in K.clip_report("qx", "qy", "qz", g).items()])


@query("block_state", "P6", f"""WITH {B.CELLS_SQL}, {G4}, b AS (SELECT {BID(2)} AS bid, count(*) AS n, min(a) AS lo FROM cells, grid GROUP BY 1),
 st AS (SELECT i AS bid, CASE WHEN n IS NULL THEN 'EMPTY' WHEN n = 64 AND lo > 0.3e0 THEN 'FULL' ELSE 'VALUE' END AS state
 FROM (SELECT unnest(range(nbx * nby * nbz)) AS i FROM grid) r LEFT JOIN b ON b.bid = r.i)
SELECT state, state <> 'VALUE' AS is_const, CAST(count(*) AS BIGINT) AS n FROM st GROUP BY 1, 2""")
def _(spark, d):
    g = B.grid_for(spark, d, 4)
    b = B.cells(spark, d).groupBy(K.cell_block_id("x", "y", "z", g).alias("bid")).agg(F.count("*").alias("n"), F.min("a").alias("lo"))
    state = F.when(F.col("n").isNull(), "EMPTY").when((F.col("n") == 64) & (F.col("lo") > 0.3), "FULL").otherwise("VALUE")
    return T.all_blocks(spark, g).join(b, "bid", "left").select(state.alias("state")).groupBy("state").agg(
        F.count("*").alias("n")).withColumn("is_const", F.col("state") != "VALUE")


CELL_FLAG_EXPR = "(CASE WHEN b < 5 THEN 1 ELSE 0 END) + (CASE WHEN a > 0.8e0 THEN 4 ELSE 0 END) + (CASE WHEN b > 120 THEN 4096 ELSE 0 END) + (CASE WHEN z = 0 THEN 2 ELSE 0 END)"


def flagged_cells(spark, d):
    w = lambda cond, bit: F.when(cond, bit).otherwise(0)
    c = B.cells(spark, d)
    flags = w(F.col("b") < 5, 1) + w(F.col("a") > 0.8, 4) + w(F.col("b") > 120, 4096) + w(F.col("z") == 0, 2)
    return c.withColumn("flags", flags.cast("int"))


@query("cell_flags", "P7", f"""WITH {B.CELLS_SQL}, f AS (SELECT {CELL_FLAG_EXPR} AS flags FROM cells)
SELECT CAST(flags AS INTEGER) AS flags, (flags & 4101) = 0 AS liquid, (flags & 4097) = 0 AS fluid, (flags & 4) <> 0 AS air,
CAST(count(*) AS BIGINT) AS n FROM f GROUP BY 1, 2, 3, 4""")
def _(spark, d):
    return flagged_cells(spark, d).groupBy("flags").agg(F.count("*").alias("n")).select(
        "flags", C.is_liquid("flags").alias("liquid"), C.is_fluid("flags").alias("fluid"), C.is_air("flags").alias("air"), "n")


@query("border_dist", "P8", f"""WITH {B.CELLS_SQL}, {B.grid_sql(8)}
SELECT CAST(least(x, sx - 1 - x, y, 15 - y, z, 15 - z) AS BIGINT) AS dist, CAST(count(*) AS BIGINT) AS n, {rsql('sum(b)', 3)} AS total
FROM cells, grid GROUP BY 1""")
def _(spark, d):
    g = B.grid_for(spark, d, 8)
    return B.cells(spark, d).groupBy(K.dist_to_border("x", "y", "z", g).alias("dist")).agg(
        F.count("*").alias("n"), rnd(F.sum("b"), 3).alias("total"))


@query("block_list_cells", "P9 P10", f"""WITH {B.CELLS_SQL}, {B.POINTS_SQL}, {B.grid_sql(8)},
 marks AS (SELECT (CAST(floor(px) AS BIGINT) >> 3) + (CAST(floor(py) AS BIGINT) >> 3) * nbx + (CAST(floor(pz) AS BIGINT) >> 3) * nbx * nby AS bid
 FROM points, grid GROUP BY 1 HAVING count(*) >= 240), k AS (SELECT *, {BID(3)} AS bid FROM cells, grid)
SELECT bid, CAST(count(*) AS BIGINT) AS n, {rsql('sum(a * 2 + 1)')} AS total FROM k WHERE bid IN (SELECT bid FROM marks) GROUP BY 1""")
def _(spark, d):
    g = B.grid_for(spark, d, 8)
    marks = P.bin_points(B.points(spark, d), g).groupBy("bid").agg(F.count("*").alias("n")).where("n >= 240").select("bid")
    k = B.cells(spark, d).withColumn("bid", K.cell_block_id("x", "y", "z", g))
    return C.select_blocks(k, marks).groupBy("bid").agg(F.count("*").alias("n"), rnd(F.sum(F.col("a") * 2 + 1)).alias("total"))


@query("codec_roundtrip", "P11 K20", f"""WITH {B.CELLS_SQL}, c AS (SELECT x, y, z, a, CAST(floor(a * 65535e0 + 0.5e0) AS INTEGER) AS q16,
 CAST(floor(a * 255e0 + 0.5e0) AS INTEGER) AS q8, CAST(floor(sqrt(a) * 255e0 + 0.5e0) AS INTEGER) AS q8s,
 CAST(greatest(least(floor(b * 0.1e0 * 2048e0 + 0.5e0), 65535e0), 0e0) AS INTEGER) AS qm FROM cells)
SELECT x, y, z, q16, q8, q8s, qm, {rsql('q16 / 65535e0')} AS d16, {rsql('q8 / 255e0')} AS d8, {rsql('(q8s / 255e0) * (q8s / 255e0)')} AS d8s,
 {rsql('qm / 2048e0')} AS dm FROM c""")
def _(spark, d):
    c = B.cells(spark, d).select(
        "x", "y", "z", codec.encode_unit("a").alias("q16"), codec.encode_unit("a", codec.FULL8).alias("q8"),
        codec.encode_unit("a", codec.FULL8, True).alias("q8s"), codec.encode_mass(F.col("b") * 0.1).alias("qm"))
    return c.select("*", rnd(codec.decode_unit("q16")).alias("d16"), rnd(codec.decode_unit("q8", codec.FULL8)).alias("d8"),
                    rnd(codec.decode_unit("q8s", codec.FULL8, True)).alias("d8s"), rnd(codec.decode_mass("qm")).alias("dm"))


@query("point_lookup", "P12", f"""WITH {B.CELLS_SQL}, {B.POINTS_SQL}, q AS (SELECT CAST(floor(px) AS BIGINT) AS x, CAST(floor(py) AS BIGINT) AS y, CAST(floor(pz) AS BIGINT) AS z,
 count(*) AS w FROM points GROUP BY 1, 2, 3)
SELECT x, y, z, CAST(w AS BIGINT) AS w, {rsql('coalesce(a, -1)')} AS a FROM q LEFT JOIN cells USING (x, y, z)""")
def _(spark, d):
    q = B.points(spark, d).groupBy(*[F.floor(p).alias(c) for p, c in zip(("px", "py", "pz"), "xyz")]).agg(F.count("*").alias("w"))
    return C.lookup(q, B.cells(spark, d), "a", -1.0).select("x", "y", "z", "w", rnd("a").alias("a"))


@query("point_write", "P13", f"""WITH {B.CELLS_SQL}, {B.POINTS_SQL}, w AS (SELECT CAST(floor(px) AS BIGINT) AS x, CAST(floor(py) AS BIGINT) AS y, CAST(floor(pz) AS BIGINT) AS z,
 max(mass) AS a FROM points GROUP BY 1, 2, 3)
SELECT x, y, z, {rsql('coalesce(w.a, cells.a)')} AS a FROM cells FULL OUTER JOIN w USING (x, y, z)""")
def _(spark, d):
    w = B.points(spark, d).groupBy(*[F.floor(p).alias(c) for p, c in zip(("px", "py", "pz"), "xyz")]).agg(F.max("mass").alias("a"))
    return C.upsert(B.cells(spark, d).select("x", "y", "z", "a"), w, "a").select("x", "y", "z", rnd("a").alias("a"))


@query("virtual_index", "G14 §1.3", f"""WITH {B.CELLS_SQL}, {B.grid_sql(8)}, l AS (SELECT *, CASE WHEN b > 80 THEN 0 WHEN b > 40 THEN 1 ELSE 2 END AS level, sx AS w FROM cells, grid)
SELECT DISTINCT level, x >> level AS lx, y >> level AS ly, z >> level AS lz,
 CAST(((x >> level) << level) + ((y >> level) << level) * w + ((z >> level) << level) * w * 16 AS BIGINT) AS vci,
 ((x >> level) + 0.5e0) * pow(2e0, level) AS cx FROM l""")
def _(spark, d):
    g = B.grid_for(spark, d, 8)
    level = F.when(F.col("b") > 80, 0).when(F.col("b") > 40, 1).otherwise(2)
    c = B.cells(spark, d).withColumn("level", level)
    c = c.select("level", *[F.expr(f"shiftright({n}, level)").alias(f"l{n}") for n in "xyz"]).distinct()
    return c.select("*", K.virtual_cell_index("lx", "ly", "lz", "level", g).alias("vci"), K.cell_centre("lx", "level").alias("cx"))


def _spread_sql(v: str) -> str:
    for s, m in K.MORTON_SPREAD:
        v = f"(({v} | ({v} << {s})) & {m})" if len(v) < 40 else f"(SELECT (t | (t << {s})) & {m} FROM (SELECT {v} AS t))"
    return v


def _bits_sql(v: str) -> str:
    return "(" + " + ".join(f"((({v} >> {i}) & 1) << {3 * i})" for i in range(16)) + ")"


@query("morton_order", "O1 F2", f"""WITH {B.CELLS_SQL}, m AS (SELECT x, y, z, {_bits_sql('x')} + 2 * {_bits_sql('y')} + 4 * {_bits_sql('z')} AS code FROM cells)
SELECT x, y, z, CAST(code AS BIGINT) AS code, x AS ux, y AS uy, z AS uz, CAST(floor(log2(code + 1)) AS INTEGER) AS lg FROM m""")
def _(spark, d):
    c = B.cells(spark, d).select("x", "y", "z", K.morton_key("x", "y", "z").alias("code"))
    ux, uy, uz = K.morton_coords("code")
    c = c.select("*", ux.alias("ux"), uy.alias("uy"), uz.alias("uz"), K.int_log2(F.col("code") + 1).alias("lg"))
    # range partitions plus a local sort lay the file out in key order without one global task
    return c.repartitionByRange("code").sortWithinPartitions("code")


@query("block_color8", "G8", f"""WITH {B.CELLS_SQL}, {G4}
SELECT CAST(((x >> 2) & 1) + 2 * ((y >> 2) & 1) + 4 * ((z >> 2) & 1) AS BIGINT) AS color, CAST(count(DISTINCT {BID(2)}) AS BIGINT) AS blocks,
 CAST(count(*) AS BIGINT) AS cells FROM cells, grid GROUP BY 1""")
def _(spark, d):
    g = B.grid_for(spark, d, 4)
    b = B.cells(spark, d).groupBy(*[K.block_coord(c, g).alias(f"b{c}") for c in "xyz"]).agg(F.count("*").alias("n"))
    return b.groupBy(K.color8("bx", "by", "bz").alias("color")).agg(F.count("*").alias("blocks"), F.sum("n").alias("cells"))


_U = "18446744073709551616::UHUGEINT"


def _mix64_sql(v: str) -> list[str]:
    return [
        f"h0 AS (SELECT *, CAST({v} AS UBIGINT) AS q0 FROM src)",
        "h1 AS (SELECT *, xor(q0, q0 >> 33) AS q1 FROM h0)",
        f"h2 AS (SELECT *, CAST((q1::UHUGEINT * 18397679294719823053::UHUGEINT) % {_U} AS UBIGINT) AS q2 FROM h1)",
        "h3 AS (SELECT *, xor(q2, q2 >> 33) AS q3 FROM h2)",
        f"h4 AS (SELECT *, CAST((q3::UHUGEINT * 14181476777654086739::UHUGEINT) % {_U} AS UBIGINT) AS q4 FROM h3)",
        "h5 AS (SELECT *, xor(q4, q4 >> 33) AS q5 FROM h4)",
    ]


@query("hash_mix64", "F3", f"""WITH src AS (SELECT DISTINCT l_orderkey AS k FROM lineitem), {', '.join(_mix64_sql('k'))}
SELECT k, CAST(q5 >> 32 AS BIGINT) AS hi, CAST(q5 & 4294967295 AS BIGINT) AS lo FROM h5""")
def _(spark, d):
    k = B.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k")).distinct()
    h = k.select("k", K.mix64("k").alias("h"))
    return h.select("k", F.shiftrightunsigned("h", 32).alias("hi"), F.col("h").bitwiseAND(F.lit(0xFFFFFFFF)).alias("lo"))


@query("hash_coords", "F3", f"""WITH {B.CELLS_SQL}, src AS (SELECT x, y, z, xor(7, ((z & 255) << 24) | ((y & 255) << 16) | ((x & 255) << 8) | 3) AS q0 FROM cells),
 h1 AS (SELECT *, (xor(q0, q0 >> 16) * 2246822507::HUGEINT) % 4294967296 AS q1 FROM src), h2 AS (SELECT *, CAST(q1 AS BIGINT) AS r1 FROM h1),
 h3 AS (SELECT *, CAST((xor(r1, r1 >> 13) * 3266489909::HUGEINT) % 4294967296 AS BIGINT) AS r2 FROM h2)
SELECT x, y, z, xor(r2, r2 >> 16) AS h8, xor(xor((x * 73856093) & 4294967295, (y * 19349663) & 4294967295), (z * 83492791) & 4294967295) AS h16 FROM h3""")
def _(spark, d):
    c = B.cells(spark, d).select("x", "y", "z")
    return c.select("x", "y", "z", K.coord_hash8(F.lit(7), "x", "y", "z", F.lit(3)).alias("h8"), K.coord_hash16("x", "y", "z", F.lit(0)).alias("h16"))


@query("morton32_log2", "F2", f"""WITH {B.CELLS_SQL}, e AS (SELECT x, y, z, a, CAST(floor(log2(a)) AS INTEGER) AS e FROM cells)
SELECT x, y, z, CAST((SELECT sum((((x >> i) & 1) << (3 * i)) + (((y >> i) & 1) << (3 * i + 1)) + (((z >> i) & 1) << (3 * i + 2))) FROM range(10) r(i)) AS INTEGER) AS key,
 CASE WHEN pow(2e0, e) > a THEN e - 1 WHEN pow(2e0, e + 1) <= a THEN e + 1 ELSE e END AS log2 FROM e""")
def _(spark, d):
    c = B.cells(spark, d)
    return c.select("x", "y", "z", K.morton32_key("x", "y", "z").alias("key"), K.exponent2("a").alias("log2"))
