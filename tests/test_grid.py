"""Grid operators against small dense numpy references."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lattica.functions import codec, keys as K
from lattica.operators import channels as C, halo as H, interp as I, mixedres as M, pde, points as P, pyramid as Y, solver as S, topology as T
from lattica.schema import BLOCK_FLAGS, Grid
from lattica.sources import patterns

G = Grid(16, 8, 8, 4, 3)


@pytest.fixture(scope="module")
def field():
    return np.random.default_rng(3).random((8, 8, 16))  # z, y, x


@pytest.fixture(scope="module")
def cells(spark, field):
    z, y, x = np.indices(field.shape)
    return spark.createDataFrame(pd.DataFrame({"x": x.ravel(), "y": y.ravel(), "z": z.ravel(), "v": field.ravel()})).repartition(4)


def to_array(df, shape=(8, 8, 16), col="v"):
    pdf = df.toPandas()
    out = np.zeros(shape)
    out[pdf["z"], pdf["y"], pdf["x"]] = pdf[col]
    return out


def test_grid_rules():
    assert Grid.default_block_edge(400, 400, 400) == 32 and Grid.default_block_edge(100, 64, 64) == 16
    assert G.coarsened(1).block_dims == G.block_dims
    for bad in (dict(bsx=3), dict(bsx=64), dict(sx=10)):
        with pytest.raises(ValueError):
            Grid(**{"sx": 64, "sy": 64, "sz": 64, "bsx": 4, **bad})


def test_addressing_round_trip(spark):
    df = patterns.all_cells(spark, G)
    b, v = K.block_coords("bid", G), K.voxel_coords("vid", 4)
    bad = O_any([b[i] * 4 + v[i] != F.col(c) for i, c in enumerate("xyz")])
    assert df.where(bad).count() == 0
    m = df.withColumn("m", K.morton_key("x", "y", "z"))
    assert m.select("m").distinct().count() == df.count()
    back = K.morton_coords("m")
    assert m.where(O_any([back[i] != F.col(c) for i, c in enumerate("xyz")])).count() == 0


def O_any(conds):
    out = conds[0]
    for c in conds[1:]:
        out = out | c
    return out


def test_morton_high_coordinates(spark):
    top = (1 << 21) - 1
    df = spark.createDataFrame([(top, 0, top), (123456, top, 7)], "x bigint, y bigint, z bigint").withColumn("m", K.morton_key("x", "y", "z"))
    got = df.select("x", "y", "z", *[c.alias(f"b{n}") for n, c in zip("xyz", K.morton_coords("m"))]).collect()
    for r in got:
        assert (r.x, r.y, r.z) == (r.bx, r.by, r.bz)


def test_color8_never_touches(spark):
    b = T.all_blocks(spark, G).withColumn("color", K.color8("bx", "by", "bz"))
    nb = T.tell_neighbours(b.select("bid", "color"), G, ["color"]).withColumnRenamed("color", "nc")
    assert nb.join(b.select("bid", "color"), "bid").where("color = nc").count() == 0


def test_codec_round_trip(spark):
    df = spark.range(65536).select(codec.encode_unit(codec.decode_unit("id")).alias("q"), "id")
    assert df.where("q <> id").count() == 0
    got = spark.createDataFrame([(2.5,), (-2.5,), (0.49,)], "v double").select(codec.round_half_away("v").alias("r")).collect()
    assert [r.r for r in got] == [3, -3, 0]


def test_regularized_levels_differ_by_one(spark):
    g = Grid(64, 64, 64, 8, 4)
    for kind in (1, 2, 3):
        lv = T.regularize_levels(T.refinement_map(T.all_blocks(spark, g), g, kind, (0.5, 0.5, 0.5)), g)
        nb = T.tell_neighbours(lv, g, ["level"]).withColumnRenamed("level", "n")
        assert nb.join(lv, "bid").where(F.abs(F.col("n") - F.col("level")) > 1).count() == 0


def test_flags_mark_both_sides(spark):
    g = Grid(64, 64, 64, 16, 3)
    lv = T.regularize_levels(T.refinement_map(T.all_blocks(spark, g), g, 3), g).withColumn("exists", F.lit(True))
    f = T.block_flags(lv, g)
    fine = f.where(F.col("flags").bitwiseAND(F.lit(BLOCK_FLAGS["FINE_COARSE"])) != 0).count()
    coarse = f.where(F.col("flags").bitwiseAND(F.lit(BLOCK_FLAGS["COARSE_FINE"])) != 0).count()
    assert fine and coarse


def test_splat_matches_brute_force(spark):
    rng = np.random.default_rng(8)
    pts = rng.random((40, 3)) * [16, 8, 8]
    pts = np.vstack([pts, np.repeat(pts[:1], 200, axis=0)])  # many copies of one point
    df = spark.createDataFrame(pd.DataFrame(pts, columns=["px", "py", "pz"]))
    got = P.splat_min_distance(df, G, 1.5, 1.0).toPandas()
    z, y, x = np.indices((8, 8, 16)) + 0.5
    d2 = np.min([(x - a) ** 2 + (y - b) ** 2 + (z - c) ** 2 for a, b, c in pts], axis=0)
    want = {(int(i), int(j), int(k)): int(np.floor(d2[k, j, i] / 6.25 * 65535 + 0.5)) for k, j, i in zip(*np.nonzero(d2 <= 6.25))}
    assert {(r.x, r.y, r.z): r.q for r in got.itertuples()} == want


def test_density_jumps_to_zero_at_cut_off(spark):
    # r = 2, band = 2: density just inside the cut-off is about 1/3, then 0
    q = spark.createDataFrame([(0, 0, 0, int(0.998 * 65535)), (1, 0, 0, 65535), (2, 0, 0, 0)], "x int, y int, z int, q int")
    d = {r.x: r.dens / 65535 for r in P.finalise_density(q, 2.0, 2.0).collect()}
    assert d[0] == pytest.approx(1 / 3, abs=2e-3) and d[1] == 0 and d[2] == 1.0


def test_instances_in_chunks(spark):
    base = spark.createDataFrame([(float(i), 0.0, 1.0) for i in range(50)], "px double, py double, pz double")
    spots = spark.createDataFrame([(10.0, 1.0, 0.0), (20.0, 2.0, 0.0)], "px double, py double, pz double")
    got = sorted(tuple(r) for r in P.instantiate(base, spots, 0.5, chunk=7).collect())
    assert got == sorted((s[0] + i * 0.5, s[1], s[2] + 0.5) for s in [(10.0, 1.0, 0.0), (20.0, 2.0, 0.0)] for i in range(50))


def test_pack_round_trip(cells, field):
    packed = H.pack(cells, G, "v", dtype="float64")
    np.testing.assert_array_equal(to_array(H.unpack(packed, G, "v", "float64")), field)


def np_halo(f, h, n=4):
    """Halo blocks with the block's own border outside the domain."""
    out = {}
    sz, sy, sx = f.shape
    for bz in range(sz // n):
        for by in range(sy // n):
            for bx in range(sx // n):
                blk = np.zeros((n + 2 * h,) * 3)
                for k, z in enumerate(range(bz * n - h, bz * n + n + h)):
                    for j, y in enumerate(range(by * n - h, by * n + n + h)):
                        for i, x in enumerate(range(bx * n - h, bx * n + n + h)):
                            if 0 <= z < sz and 0 <= y < sy and 0 <= x < sx:
                                blk[k, j, i] = f[z, y, x]
                            else:
                                c = lambda v, b: min(max(v, b * n), b * n + n - 1)
                                blk[k, j, i] = f[c(z, bz), c(y, by), c(x, bx)]
                out[bx, by, bz] = blk
    return out


def np_step(f, step, it, blocks):
    new = f.copy()
    halos = np_halo(f, step.width)
    for bx, by, bz in blocks:
        got = pde.kernel(step, it)(halos[bx, by, bz][None], None)[0]
        new[bz * 4:bz * 4 + 4, by * 4:by * 4 + 4, bx * 4:bx * 4 + 4] = got
    return new


ALL = [(x, y, z) for z in range(2) for y in range(2) for x in range(4)]


@pytest.mark.parametrize("kind", [1, 2, 3, 4, 14, 15, 17])
def test_jacobi_step(cells, field, kind):
    step = pde.Step(kind, 0.05)
    p = H.pack(cells, G, "v", dtype="float64")
    got = to_array(H.unpack(H.stencil(p, G, step.width, pde.kernel(step, 1), dtype="float64"), G, "v", "float64"))
    np.testing.assert_allclose(got, np_step(field, step, 1, ALL), atol=1e-12)


def test_color8_order_and_rounded_up_sweeps(cells, field):
    step = pde.Step(4, 0.2)
    p = H.pack(cells, G, "v", dtype="float64")
    got = to_array(H.unpack(pde.smooth(p, G, step, 1, order="color8", dtype="float64"), G, "v", "float64"))
    want = field
    for it in range(2):  # one asked for, two run
        for c in range(8):
            want = np_step(want, step, it, [b for b in ALL if (b[0] & 1) + (b[1] & 1) * 2 + (b[2] & 1) * 4 == c])
    np.testing.assert_allclose(got, want, atol=1e-12)


def test_band_and_redblack(cells, field):
    step = pde.Step(3, 0.5, band=(0.05, 0.02))
    p = H.pack(cells, G, "v", dtype="float64")
    got = to_array(H.unpack(pde.smooth(p, G, step, 2, order="redblack", dtype="float64"), G, "v", "float64"))
    want = field
    for it in range(2):
        for c in (0, 1):
            nxt = np_step(want, step, it, [b for b in ALL if sum(b) & 1 == c])
            want = np.clip(nxt, np.maximum(field - 0.05, 0), np.minimum(field + 0.02, 1))
    np.testing.assert_allclose(got, want, atol=1e-12)


def test_curvature_leaves_planes_alone():
    z, y, x = np.indices((18, 18, 18)).astype(float)
    a = (0.02 * x + 0.01 * y - 0.03 * z)[None]
    np.testing.assert_allclose(pde.change(a, pde.Step(4)), 0, atol=1e-12)


def test_blur_keeps_constants_and_sums_to_one():
    for r, s in ((1.0, 0.0), (1.5, 0.4)):
        assert pde.gauss3(r, s).sum() == pytest.approx(1.0)


def test_periodic_exchange(cells, field):
    p = H.pack(cells, G, "v", dtype="float64")
    out = H.stencil(p, G, 1, lambda h, b: H.shifted(h, 1, -1, 0, 0), dtype="float64", outside="clamp", periodic=(True, False, False))
    np.testing.assert_array_equal(to_array(H.unpack(out, G, "v", "float64")), np.roll(field, 1, axis=2))


def test_restriction_keeps_constants(spark):
    ones = patterns.all_cells(spark, G).select("x", "y", "z", F.lit(2.5).alias("v"))
    for w in (Y.MEAN2, Y.SMOOTH4, Y.gauss5()):
        r = Y.downsample(ones, G.dims, ["v"], w).agg(F.min("v"), F.max("v"), F.count("*")).first()
        assert r[0] == pytest.approx(2.5) and r[1] == pytest.approx(2.5) and r[2] == 8 * 4 * 4
    low = Y.downsample(ones, G.dims, ["v"], Y.gauss5())
    up = Y.upsample(low, (8, 4, 4), G.dims, ["v"], Y.gauss5()).agg(F.min("v"), F.max("v"), F.count("*")).first()
    assert up[0] == pytest.approx(2.5) and up[1] == pytest.approx(2.5) and up[2] == 16 * 64


def np_window(field, q, n):
    """Clamped n^3 windows around positions q (cell centres at integers)."""
    f = np.floor(q).astype(int)
    k = np.arange(n) - (n - 1) // 2
    ix = [np.clip(f[:, a:a + 1] + k, 0, s - 1) for a, s in enumerate((16, 8, 8))]
    return field[ix[2][:, :, None, None], ix[1][:, None, :, None], ix[0][:, None, None, :]], q - f


def np_mono(p, t):
    m1, m2 = (p[2] - p[0]) / 2, (p[3] - p[1]) / 2
    if m1 * m2 <= 0:
        m1 = m2 = 0.0
    d = p[2] - p[1]
    return p[1] + m1 * t + (3 * d - 2 * m1 - m2) * t**2 + (m1 + m2 - 2 * d) * t**3


def np_mono2(p, t):
    d0, d1, d2 = np.diff(p)
    m1 = 6 / (3 / d0 + 3 / d1) if d0 * d1 > 1e-12 else 0.0
    m2 = 6 / (3 / d1 + 3 / d2) if d1 * d2 > 1e-12 else 0.0
    return p[1] + m1 * t + (3 * d1 - 2 * m1 - m2) * t**2 + (m1 + m2 - 2 * d1) * t**3


def np_weno(p, t):
    def para(a, b, c, x):
        d, e = (c - a) / 2, a - 2 * b + c
        return (2 - x) / (1e-6 + d * (d + e) + 4 / 3 * e * e) ** 2, b + x * (d + 0.5 * x * e)
    (w1, g1), (w2, g2) = para(p[0], p[1], p[2], t), para(p[3], p[2], p[1], 1 - t)
    return (w1 * g1 + w2 * g2) / (w1 + w2)


@pytest.fixture(scope="module")
def probes(spark):
    rng = np.random.default_rng(4)
    pts = rng.random((60, 3)) * [16, 8, 8]
    pts[0], pts[1] = [0.01, 0.01, 0.01], [15.99, 7.99, 7.99]
    pts = np.vstack([pts, np.repeat(pts[2:3], 5, axis=0)])
    return pts, spark.createDataFrame(pd.DataFrame(pts, columns=["px", "py", "pz"]))


@pytest.mark.parametrize("kind,ref", [("mono", np_mono), ("mono2", np_mono2), ("weno", np_weno)])
@pytest.mark.parametrize("share", [1000, 3])
def test_line_rules(cells, field, probes, kind, ref, share):
    pts, df = probes
    p = H.pack(cells, G, "v", dtype="float64")
    got = I.sample(df, p, G, kind, dtype="float64", share=share).toPandas()
    assert len(got) == len(pts)
    got = got.groupby(["px", "py", "pz"])["value"].first()
    win, t = np_window(field, pts - 0.5, 4)
    for i, q in enumerate(pts):
        lx = [[ref(win[i, k, j], t[i, 0]) for j in range(4)] for k in range(4)]
        want = ref([ref(np.array(r), t[i, 1]) for r in lx], t[i, 2]) if kind == "weno" else ref(np.array([ref(np.array(r), t[i, 1]) for r in lx]), t[i, 2])
        assert got[tuple(q)] == pytest.approx(want, abs=1e-9)


def test_sampling_where_nothing_is_stored(spark):
    one = spark.createDataFrame([(0, 0, 0, 1.0)], "x int, y int, z int, v double")
    pts = spark.createDataFrame([(12.5, 6.5, 6.5), (0.5, 0.5, 0.5)], "px double, py double, pz double")
    p = H.pack(one, G, "v", dtype="float64")
    got = {r.px: r.value for r in I.sample(pts, p, G, "linear", dtype="float64", empty=-3.0).collect()}
    assert got == {12.5: pytest.approx(-3.0), 0.5: pytest.approx(1.0)}


def test_levels_blend_keeps_constants(spark):
    g = Grid(64, 32, 32, 16, 3)
    first = T.all_blocks(spark, g).select("bid", F.when(F.col("bid") == 0, 0).otherwise(2).alias("level"))
    lv = T.regularize_levels(first, g)
    fl = T.block_flags(lv.withColumn("exists", F.lit(True)), g)
    fine = patterns.all_cells(spark, g).select("bid", "x", "y", "z").join(lv, "bid")
    own = fine.select("level", "bid", *[K.shr(c, "level").alias(c) for c in "xyz"]).distinct().withColumn("v", F.lit(4.0))
    gh = Y.all_ghosts(own, fl, g, "v")
    assert gh.agg(F.min("v"), F.max("v")).first() == (pytest.approx(4.0), pytest.approx(4.0))
    rng = np.random.default_rng(1)
    pts = spark.createDataFrame(pd.DataFrame(rng.random((200, 3)) * [64, 32, 32], columns=["px", "py", "pz"]))
    for kind in ("linear", "bspline3"):
        out = M.sample_levels(pts, own, gh, fl, g, "v", kind=kind, edge=16).toPandas()
        np.testing.assert_allclose(out["value"], 4.0, atol=1e-9)
        if kind == "bspline3":
            np.testing.assert_allclose(out[["gx", "gy", "gz"]], 0.0, atol=1e-9)


def test_relaxation_inner_sweeps(spark, cells, field):
    src = cells.withColumns({"ax": F.lit(1.0), "ay": F.lit(1.0), "az": F.lit(1.0)})
    faces = S.face_weights(src, "v", ("ax", "ay", "az")).withColumns({"rhs": F.lit(0.3), "fluid": F.col("x") > 0})
    sys = S.pack_system(faces, G)
    x = S.relax(H.pack(cells, G, "v", dtype="float64"), sys, G, h=0.5, omega=0.7, iterations=1, inner=2, reverse=True)
    got = to_array(H.unpack(x, G, "v", "float64"))
    want = field.copy()
    for turn in (0, 1):
        nxt = want.copy()
        pad = np.pad(want, 1)
        for b in ALL:
            if sum(b) & 1 != turn:
                continue
            sl = tuple(slice(c * 4, c * 4 + 6) for c in reversed(b))
            h = pad[sl].copy()
            for _ in range(2):
                ring = h[1:-1, 1:-1, :-2] + h[1:-1, 1:-1, 2:] + h[1:-1, :-2, 1:-1] + h[1:-1, 2:, 1:-1] + h[:-2, 1:-1, 1:-1] + h[2:, 1:-1, 1:-1]
                new = (0.3 + 0.5 * ring) / 6 * 0.7 / 0.5 + 0.3 * h[1:-1, 1:-1, 1:-1]
                if b[0] == 0:
                    new[:, :, 0] = 0
                h[1:-1, 1:-1, 1:-1] = new
            nxt[tuple(slice(c * 4, c * 4 + 4) for c in reversed(b))] = h[1:-1, 1:-1, 1:-1]
        want = nxt
    np.testing.assert_allclose(got, want, atol=1e-12)


def test_dense_and_sparse(spark, cells):
    few = cells.where("v > 0.97")
    full = C.densify(few, G, "v", -1.0)
    assert full.count() == 16 * 64 and full.where("v >= 0").count() == few.count()
    kept = C.sparsify(cells, G, "v", 0.999)
    assert kept.select("bid").distinct().count() == cells.where("v >= 0.999").select(K.cell_block_id("x", "y", "z", G).alias("b")).distinct().count()


def test_channels_travel_together(cells, probes):
    """Packed channels give what each gives alone, in one exchange; a lost position gives null."""
    some = cells.where("x < 12").withColumns({"w": F.col("v") * 2 - 1, "u": F.col("x") + F.col("y") / 10.0})
    pts = probes[1].unionByName(probes[1].limit(1).selectExpr("px", "py", "cast('nan' as double) as pz"))
    order = ["px", "py", "pz"]
    tidy = lambda df: df.toPandas().sort_values(order).reset_index(drop=True)
    packed = H.pack(some, G, ["v", "w", "u"], empty=[0.0, -1.0, 7.0], dtype="float64")
    for kind, names in (("linear", ["value"]), ("bspline3", ["value", "gx", "gz"])):
        got = tidy(I.sample(pts, packed, G, kind, dtype="float64", empty=[0.0, -1.0, 7.0], channels=["v", "w", "u"], share=7))
        assert len(got) == 66 and got["v"].isna().sum() == 1
        for c, e in (("v", 0.0), ("w", -1.0), ("u", 7.0)):
            one = tidy(I.sample(pts, H.pack(some, G, c, empty=e, dtype="float64"), G, kind, dtype="float64", empty=e))
            for n in names:
                np.testing.assert_allclose(got[c if n == "value" else f"{c}_{n}"], one[n], atol=1e-12)


def plan_of(df):
    return df._jdf.queryExecution().toString()


def test_levels_are_summed_by_block(spark, cells):
    """No copy of a cell for a single target is shuffled; null values and positions keep their rows."""
    low = Y.downsample(cells, G.dims, ["v"], Y.gauss5())
    back = Y.reconstruct(Y.laplacian(cells, low, G.dims, "v", Y.gauss5()), low, G.dims, "v", Y.gauss5())
    assert "HashAggregate" not in plan_of(low)
    assert back.join(cells.withColumnRenamed("v", "u"), ["x", "y", "z"]).where(F.abs(F.col("u") - F.col("v")) < 1e-9).count() == 1024
    odd = spark.createDataFrame([(0, 0, 0, None), (None, 1, 0, 3.0), (14, 6, 6, 2.0)], "x bigint, y bigint, z bigint, v double")
    coarse = {(r.x, r.y, r.z): r.v for r in Y.downsample(odd, G.dims, ["v"], Y.MEAN2).collect()}
    assert coarse == {(0, 0, 0): None, (7, 3, 3): 0.25}
    fine = {(r.x, r.y, r.z): r.v for r in Y.laplacian(odd, Y.downsample(odd, G.dims, ["v"], Y.MEAN2), G.dims, "v", Y.MEAN2).collect()}
    assert fine[(None, 1, 0)] == 3.0 and fine[(0, 0, 0)] is None and fine[(14, 6, 6)] == pytest.approx(1.75)


def test_points_are_brought_together_before_they_fan_out(spark):
    df = spark.createDataFrame([(float(i % 16), 1.5, 2.5) for i in range(64)], "px double, py double, pz double")
    assert "rangepartitioning" in plan_of(P.splat_min_distance(df, G, 1.0, 1.0))


def test_neighbours_are_looked_up_by_cube(spark):
    """Across cube faces, negative coordinates, copies of a cell, null values and a missing coordinate; nothing is grouped by target cell."""
    df = spark.createDataFrame([(None, 1, 2, 1.0), (None, 2, 2, None), (31, 0, 0, 2.0), (32, 0, 0, 3.0), (-1, 0, 0, 7.0), (0, 0, 0, 4.0), (0, 0, 0, 5.0)],
                               "x bigint, y bigint, z bigint, v double")
    df = H.neighbour_values(df, [(-1, 0, 0), (1, 0, 0), (0, 1, 0)], "v")
    got = {(r.x, r.y, r.z): (r.v, r.active, r.v_0, r.v_1, r.v_2) for r in df.collect()}
    assert got == {(None, 1, 2): (1.0, 3, 1.0, 1.0, None), (None, 2, 2): (None, 2, None, None, None), (31, 0, 0): (2.0, 1, None, 3.0, None),
                   (32, 0, 0): (3.0, 1, 2.0, None, None), (-1, 0, 0): (7.0, 2, None, 5.0, None), (0, 0, 0): (5.0, 1, 7.0, None, None)}
    assert "FlatMapGroupsInArrow" in plan_of(df)


def test_face_neighbours_are_looked_up_by_region(spark):
    """A coarse cell beside four fine ones across a region's face; null values count for the kind only; nothing is grouped by target cell."""
    g = Grid(64, 8, 8, 4, 2)
    rows = [(1, 15, 0, 0, 10.0), (0, 32, 0, 0, 1.0), (0, 32, 1, 0, 2.0), (0, 32, 0, 1, 3.0), (0, 32, 1, 1, None), (0, 33, 0, 0, 5.0)]
    df = M.face_neighbours(spark.createDataFrame(rows, "level int, x bigint, y bigint, z bigint, v double"), ["v"], g)
    got = {(r.level, r.x, r.y, r.z): r for r in df.collect()}
    assert len(got) == 6 and "FlatMapGroupsInArrow" in plan_of(df)
    coarse, fine = got[1, 15, 0, 0], got[0, 32, 0, 0]
    assert (coarse.kind_1, coarse.v_1, coarse.kind_0) == (M.FROM_FINE, 2.0, None)
    assert (fine.kind_0, fine.v_0, fine.kind_1, fine.v_1, fine.v) == (M.FROM_COARSE, 10.0, M.SAME, 5.0, 1.0)
    assert got[0, 32, 1, 1].v is None and (got[0, 32, 1, 0].kind_5, got[0, 32, 1, 0].v_5) == (M.SAME, None)
