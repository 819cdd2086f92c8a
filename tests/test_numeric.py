"""Numerics, sources and the catalogue."""

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from lattica.functions import color as CO, dist as D, noise as N, poly as PY, rng as R, text as TX
from lattica.operators import image as IM, linalg as LA, order as O, slices as L, stats as S
from lattica.plans.registry import catalogue
from lattica.schema import Grid
from lattica.sources import blocks as BK, ply


def test_adaptation_equals_stepping(spark):
    rng = np.random.default_rng(0)
    x = rng.random((90, 2))
    y = x @ [1.5, -0.5] + 0.01 * rng.random(90)
    pdf = pd.DataFrame({"k": "a", "t": np.arange(90), "x1": x[:, 0], "x2": x[:, 1], "y": y})
    got = LA.adapt(spark.createDataFrame(pdf).repartition(4), ["k"], ["t"], ["x1", "x2"], "y", 0.1, passes=3, chunk=20).first()["w"]
    eta, w = 0.2 / ((x**2).sum() / 90), np.zeros(2)
    for _ in range(3):
        for a, b in zip(x, y):
            w = w + eta * (b - w @ a) * a
    np.testing.assert_allclose(got, w, rtol=1e-9)


@pytest.mark.parametrize("back", [False, True])
def test_long_transform(spark, back):
    v = np.random.default_rng(1).random(120)
    df = spark.createDataFrame([("a", i, float(t), 0.0) for i, t in enumerate(v)], "k string, i bigint, re double, im double")
    got = LA.fft_long(df, ["k"], 8, 16, back).orderBy("i").toPandas()
    z = np.r_[v, np.zeros(8)]
    want = np.fft.ifft(z) if back else np.fft.fft(z)
    np.testing.assert_allclose(got["re"] + 1j * got["im"], want, atol=1e-9)


def test_plane_filter_with_unit_gain_is_identity(spark):
    v = np.random.default_rng(2).random((4, 8))
    df = spark.createDataFrame([(x, y, float(v[y, x]), 0.0) for y in range(4) for x in range(8)], "x bigint, y bigint, re double, im double")
    got = LA.filter_plane(df, 8, 4, lambda r: F.lit(1.0)).toPandas()
    out = np.zeros((4, 8))
    out[got["y"], got["x"]] = got["re"]
    np.testing.assert_allclose(out, v, atol=1e-12)


def test_student_quantiles():
    # two-sided 5 % points of the t distribution
    for m, t in ((1, 12.7062), (5, 2.5706), (30, 2.0423), (120, 1.9799)):
        assert D.student_quantile(0.05, m) == pytest.approx(t, abs=1e-4)


def test_roots():
    got = PY.real_roots_values(pd.Series([[1.0, -6.0, 11.0, -6.0], [1.0, 0.0, 1.0], [2.0, -8.0], [1.0, 0.0, -5.0, 0.0, 4.0]]))
    for g, w in zip(got, ([1, 2, 3], [], [4], [-2, -1, 1, 2])):
        np.testing.assert_allclose(g, w, atol=1e-8)


def test_geometric_ratio(spark):
    df = spark.createDataFrame([(4.0, 1 + 1.5 + 2.25 + 3.375), (3.0, 7.0)], "n double, c double")
    got = [r.x for r in df.select(PY.geometric_ratio()(F.struct("n", "c")).alias("x")).collect()]
    np.testing.assert_allclose(got, [1.5, 2.0], atol=1e-9)


def test_noise_properties():
    rng = np.random.default_rng(0)
    for n in (1, 2, 3, 4):
        grid = [rng.integers(-5, 5, 50).astype(float) for _ in range(n)]
        np.testing.assert_allclose(N.noise_values(grid, 3), 0, atol=1e-12)
        p = [rng.random(4000) * 40 for _ in range(n)]
        v = N.noise_values(p, 3)
        assert abs(v.mean()) < 0.1 and 0.05 < v.std() < 0.7 and np.abs(v).max() <= n
        step = N.noise_values([p[0] + 1e-6, *p[1:]], 3)
        assert np.abs(step - v).max() < 1e-4
    assert not np.allclose(N.noise_values(p, 3), N.noise_values(p, 4))


def test_curl_has_no_divergence():
    rng = np.random.default_rng(5)
    p = [rng.random(200) * 10 + 0.1 for _ in range(3)]
    e = 1e-3
    div = sum((N.curl_values([q + e * (k == a) for k, q in enumerate(p)])[a] - N.curl_values([q - e * (k == a) for k, q in enumerate(p)])[a]) / (2 * e) for a in range(3))
    assert np.median(np.abs(div)) < 1e-3


def test_draws(spark):
    df = spark.range(40000)
    r = df.select(R.uniform("id", 1).alias("u"), R.normal("id", 2, 3.0, 2.0).alias("z"), R.truncated_normal("id", 3, 0.0, 1.0, -1.0, 0.5).alias("t"), R.gamma_like("id", 4, 3.0).alias("g"))
    p = r.toPandas()
    assert p["u"].between(0, 1).all() and p["u"].mean() == pytest.approx(0.5, abs=0.01)
    assert p["z"].mean() == pytest.approx(3.0, abs=0.05) and p["z"].std() == pytest.approx(2.0, abs=0.05)
    assert p["t"].between(-1.0, 0.5).all() and p["g"].mean() == pytest.approx(3.0, abs=0.1)
    again = df.repartition(7).select("id", R.uniform("id", 1).alias("u")).orderBy("id").toPandas()["u"]
    np.testing.assert_array_equal(again, p["u"])
    z = np.stack(df.select(R.correlated_normals("id", 5, [1.0, -2.0], [[2.0, 0.6], [0.6, 1.0]]).alias("z")).toPandas()["z"])
    np.testing.assert_allclose(np.cov(z.T), [[2.0, 0.6], [0.6, 1.0]], atol=0.06)


def test_colours_come_back(spark):
    rng = np.random.default_rng(6)
    df = spark.createDataFrame(pd.DataFrame(rng.integers(0, 256, (500, 3)), columns=list("rgb")))
    h = df.select("*", *[e.alias(n) for n, e in CO.rgb_to_hcl("r", "g", "b").items()])
    back = h.select("r", "g", "b", *[e.alias(f"q{n}") for n, e in CO.hcl_to_rgb("h", "c", "l").items()]).toPandas()
    for c in "rgb":
        assert (back[c] - back[f"q{c}"]).abs().max() <= 4  # integer hue steps
    hsv = df.where("r >= greatest(g, b)").select(*[(F.col(c) / 255.0).alias(c) for c in "rgb"])
    hsv = hsv.select("r", "g", "b", *[e.alias(n) for n, e in CO.rgb_to_hsv("r", "g", "b").items()])
    back = hsv.select("r", "g", "b", *[e.alias(f"q{n}") for n, e in CO.hsv_to_rgb("h", "s", "v").items()]).toPandas()
    for c in "rgb":
        np.testing.assert_allclose(back[c], back[f"q{c}"], atol=1e-9)
    over = spark.createDataFrame([(300.0, 100.0, 50.0), (-20.0, 50.0, 60.0), (10.0, 20.0, 30.0)], "r double, g double, b double")
    c = over.select(CO.clip_rgb("r", "g", "b").alias("c"), CO.grey("r", "g", "b").alias("before")).select("c.*", "before").toPandas()
    assert c[list("rgb")].to_numpy().min() >= 0 and c[list("rgb")].to_numpy().max() <= 255
    np.testing.assert_allclose(c["r"] * 0.3 + c["g"] * 0.5 + c["b"] * 0.2, c["before"], atol=1e-9)


def test_glob(spark):
    words = ["ring", "string", "Ring", "r?ng", "rang", "ringer", ""]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    match = lambda *a, **k: [r.w for r in df.where(TX.glob("w", *a, **k)).collect()]
    assert match("r?ng") == ["ring", "r?ng", "rang"]
    assert match(r"r\?ng") == ["r?ng"]
    assert match("*ring*") == ["ring", "string", "ringer"]
    assert match("ring", prefix=True) == ["ring", "ringer"]
    assert match("RING", ignore_case=True) == ["ring", "Ring"]
    assert match("*") == words


def test_smoothing_in_place(spark):
    bins = np.random.default_rng(0).random(12)
    got = spark.createDataFrame([(bins.tolist(),)], "b array<double>").select(S.smooth_in_place(2, 0.5)(F.col("b")).alias("s")).first()["s"]
    w = np.exp(-((np.abs(np.arange(5) - 2) / 2) ** 2) / 0.5)
    w /= w.sum()
    pad = np.pad(bins, 2)
    for i in range(12):
        pad[i + 2] = pad[i:i + 5] @ w
    np.testing.assert_allclose(got, pad[2:-2])


def test_ply(spark, tmp_path):
    pts = np.random.default_rng(0).random((300, 3))
    head = ["ply", "format ascii 1.0", "comment made here", "element vertex 300", "property float x", "property float y", "property float z",
            "property float q", "element face 2", "property list uchar int vertex_indices", "end_header"]
    path = tmp_path / "a.ply"
    path.write_text("\n".join(head + [f"{a!r} {b!r} {c!r} 9" for a, b, c in pts.tolist()] + ["3 0 1 2", "3 1 2 3"]) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")  # several splits of one file
    try:
        got = ply.read(spark, str(path)).orderBy("pid").toPandas()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    np.testing.assert_array_equal(got[["px", "py", "pz"]].to_numpy(), pts)
    (tmp_path / "b.ply").write_text("hello\n")
    with pytest.raises(ValueError):
        ply.read(spark, str(tmp_path / "b.ply"))


def test_block_files(spark, tmp_path):
    from lattica.operators import halo as H
    from lattica.sources import patterns
    g = Grid(16, 16, 16, 8)
    p = H.pack(patterns.all_cells(spark, g).withColumn("v", F.col("x") * 1.0), g, "v")
    BK.write_blocks(p, str(tmp_path / "blocks"), g)
    back = H.unpack(BK.read_blocks(spark, str(tmp_path / "blocks")), g, "v")
    assert back.where("v <> x").count() == 0 and back.count() == 4096
    assert BK.read_raw(spark, str(tmp_path / "blocks" / "*.parquet")).count() >= 1


def test_png_tiles(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame([(x, y, *rng.integers(0, 256, 3)) for x in range(70) for y in range(40)], columns=["x", "y", "r", "g", "b"])
    tiles = BK.png_tiles(spark.createDataFrame(pdf), 32)
    assert tiles.count() == 6
    back = BK.read_png_tiles(tiles, 32).where("x < 70 and y < 40").toPandas().sort_values(["x", "y"]).reset_index(drop=True)
    pd.testing.assert_frame_equal(back.astype("int64"), pdf.sort_values(["x", "y"]).reset_index(drop=True).astype("int64"))


def test_plane_and_axis_accumulation(spark):
    df = spark.createDataFrame([(x, 0, 0, 1.0) for x in range(100)], "x bigint, y bigint, z bigint, v double")
    got = L.accumulate(df, "v", "x", group_rows=16).toPandas()
    assert (got["depth"] == got["x"] + 1).all()


def test_catalogue_contract():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and len(q) > 140
    con = duckdb.connect()
    for sql in o.values():
        assert con.execute("SELECT json_serialize_sql(?::VARCHAR)", [sql]).fetchone()[0].find('"error":true') < 0


@pytest.mark.parametrize("name", ["pt_block_bin", "blk_flags", "splat_density_stats", "ch_sum_slices", "sten_meancurv", "pyr_tensor4", "interp_linear",
                                  "st_median", "ts_ema", "mixed_derivatives", "relax_redblack"])
def test_against_oracle(spark, sf, name):
    con = duckdb.connect()
    for t in "part lineitem events embeddings".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    q = catalogue()[name]
    got, want = q.build(spark, sf).toPandas(), con.execute(q.sql).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    key = lambda d: d[cols].sort_values(cols).reset_index(drop=True)
    pd.testing.assert_frame_equal(key(got), key(want), check_dtype=False)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_normal_density_and_covariance(spark):
    x = np.random.default_rng(3).random((200, 3)) @ [[1.0, 0.2, 0.0], [0.0, 1.0, 0.4], [0.3, 0.0, 1.0]]
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id bigint, e array<double>").repartition(4)
    mean, cov = S.collect_matrix(S.covariance(df, "e"))
    np.testing.assert_allclose(mean, x.mean(0), atol=1e-12)
    np.testing.assert_allclose(cov, np.cov(x.T, bias=True), atol=1e-12)
    got = S.normal_density(df, "e", mean, cov, log=True).orderBy("id").toPandas()["density"]
    z = x - mean
    want = -0.5 * np.sum(z @ np.linalg.inv(cov) * z, axis=1) - 0.5 * (np.log(np.linalg.det(cov)) + 3 * np.log(2 * np.pi))
    np.testing.assert_allclose(got, want, rtol=1e-9)


def test_hashes_beside_nulls(spark):
    from lattica.functions import keys as K
    big = 2**60 + 1
    df = spark.createDataFrame([(big, 3), (None, 3), (7, None)], "k long, x int").coalesce(1)
    for fn in (K.mix64, K.mix32, K.fold64, K.hash_unit_float, K.fold_unit_float):
        alone = spark.createDataFrame([(big,)], "k long").select(fn("k").alias("h")).first().h
        rows = df.select("k", fn("k").alias("h")).collect()
        assert rows[0].h == alone and rows[1].h is None and rows[2].h is not None
    h = [r.h for r in df.select(K.coord_hash8(F.lit(1), "k", "x", "x", "x").alias("h")).collect()]
    assert h[0] is not None and h[1] is None and h[2] is None


def test_ragged_vectors_are_refused(spark):
    from lattica.operators import stats as S
    for rows in ([([1.0, 2.0, 3.0],), ([1.0],), ([1.0, 2.0],)], [([1.0],), (None,)]):
        df = spark.createDataFrame(rows, "e array<double>").coalesce(1)
        with pytest.raises(Exception, match="one length"):
            S.gram(df, "e").collect()


def test_student_batches_equal_single_values():
    from lattica.functions import dist as D
    t = np.array([0.0, 0.1, 1.0, 2.5, 12.0, 300.0, 0.7, np.nan])
    m = np.array([1.0, 2.0, 5.0, 30.0, 3.0, 4.0, 1e5, 3.0])
    got = D.student_two_sided_values(t, m)
    np.testing.assert_allclose(got[:-1], [D.student_two_sided(a, b) for a, b in zip(t[:-1], m[:-1])], rtol=1e-9, atol=1e-13)
    assert np.isnan(got[-1])


def test_bisection_grows_its_bracket(spark):
    from lattica.functions import poly as PY
    df = spark.createDataFrame([(2.0, 1e9), (3.0, 0.5), (1.0, 4.0), (5.0, 5.0)], "n double, c double")
    got = [r.x for r in df.select(PY.geometric_ratio()(F.struct("n", "c")).alias("x")).collect()]
    assert got[0] == pytest.approx(1e9 - 1) and got[1] is None and got[2] is None and got[3] == pytest.approx(1.0)


def test_two_by_two_formulas_equal_numpy(spark):
    from lattica.operators import linalg as LA
    rng = np.random.default_rng(12)
    ms = [rng.normal(size=(2, 2)) for _ in range(20)] + [np.array([[1.0, 2.0], [2.0, 4.0]]), np.zeros((2, 2))]
    df = spark.createDataFrame([(i, m.ravel().tolist(), (m @ m.T + np.eye(2)).ravel().tolist()) for i, m in enumerate(ms)], "i int, m array<double>, s array<double>")
    m, s = F.col("m"), F.col("s")
    out = df.select("i", LA.determinant(m, 2).alias("det"), LA.pseudo_inverse(m, 2).alias("pinv"), LA.singular_values(m, 2).alias("sv"), LA.inverse(s, 2).alias("inv"),
                    LA.cholesky(s, 2).alias("low"), LA.solve(s, F.array(F.lit(1.0), F.lit(-2.0)), 2).alias("x")).orderBy("i").collect()
    for r, a in zip(out, ms):
        b = a @ a.T + np.eye(2)
        for got, want in ((r.det, np.linalg.det(a)), (r.pinv, np.linalg.pinv(a).ravel()), (r.sv, np.linalg.svd(a, compute_uv=False)), (r.inv, np.linalg.inv(b).ravel()),
                          (r.low, np.linalg.cholesky(b).ravel()), (r.x, np.linalg.solve(b, [1.0, -2.0]))):
            np.testing.assert_allclose(got, want, rtol=1e-8, atol=1e-8)


@pytest.mark.parametrize("coefs, roots", [
    ([1, -15, 75, -125], [5, 5, 5]), ([2, -24, 96, -128], [4, 4, 4]), ([1, 0, 0, 0, 0], [0, 0, 0, 0]), ([1, -10, 37, -60, 36], [2, 2, 3, 3]),
    ([1, 0, 2, 0, 1], []), ([1, -2, 2, -2, 1], [1, 1]), ([0, 0, 3, -6], [2]), ([7], []), ([1, -1e-3, 0, 0], [0, 0, 1e-3]), (list(np.poly([1, 2, 2, 2, -7.5, -7.5])), [-7.5, -7.5, 1, 2, 2, 2])])
def test_roots_with_multiplicity(coefs, roots):
    got = PY.real_roots_values(pd.Series([[float(c) for c in coefs], None, [1.0, float("nan")]]))
    assert len(got[0]) == len(roots) and got[1] is None and got[2] is None
    np.testing.assert_allclose(got[0], roots, atol=1e-7)


@pytest.mark.parametrize("n", [3, 5, 8])
def test_stacks_equal_numpy(n):
    rng = np.random.default_rng(n)
    a = rng.standard_normal((40, n, n))
    a[3] = np.diag(np.r_[np.zeros(1), np.ones(n - 1)])[::-1]  # needs row swaps
    spd = a @ a.transpose(0, 2, 1) + np.eye(n)
    right = rng.standard_normal((40, n, 2))
    np.testing.assert_allclose(LA.solve_stack(spd, right), np.linalg.solve(spd, right), atol=1e-9)
    np.testing.assert_allclose(LA.determinant_stack(a), np.linalg.det(a), atol=1e-9)
    np.testing.assert_allclose(LA.cholesky_stack(spd), np.linalg.cholesky(spd), atol=1e-9)
    np.testing.assert_allclose(LA.jacobi_stack(a)[1], np.linalg.svd(a, compute_uv=False), atol=1e-9)
    flat = a.copy()
    flat[:, 1] = flat[:, 0] * 2  # rank n - 1
    us, size, v = LA.jacobi_stack(flat)
    np.testing.assert_allclose(us @ v.transpose(0, 2, 1), flat, atol=1e-9)
    assert (size[:, -1] < 1e-12).all()
    np.testing.assert_allclose(LA.pseudo_inverse_stack(a), np.linalg.pinv(a), atol=1e-6)


def test_matrices_without_an_answer(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0, 2.0, 4.0, 6.0, 0.0, 0.0, 0.0],), ([2.0, 0.0, 0.0, 0.0, 3.0, 0.0, 0.0, 0.0, 4.0],)], "m array<double>")
    r = df.select(LA.inverse(F.col("m"), 3).alias("i"), LA.cholesky(F.col("m"), 3).alias("c"), LA.determinant(F.col("m"), 3).alias("d")).collect()
    assert r[0].i is None and r[0].c is None and r[0].d == 0 and r[1].d == 24 and r[1].i == [0.5, 0.0, 0.0, 0.0, pytest.approx(1 / 3), 0.0, 0.0, 0.0, 0.25]


@pytest.mark.parametrize("steps", [0, 7, 90, 137])
def test_adaptation_stops_after_steps(spark, steps):
    rng = np.random.default_rng(3)
    x, y = rng.random((45, 2)), rng.random(45)
    pdf = pd.DataFrame({"k": "a", "t": np.arange(45), "x1": x[:, 0], "x2": x[:, 1], "y": y})
    got = LA.adapt(spark.createDataFrame(pdf).repartition(3), ["k"], ["t"], ["x1", "x2"], "y", 0.1, w0=[1.0, -2.0], steps=steps, chunk=10).first()["w"]
    eta, w = 0.2 / ((x**2).sum() / 45), np.array([1.0, -2.0])
    for i in range(steps):
        w = w + eta * (y[i % 45] - w @ x[i % 45]) * x[i % 45]
    np.testing.assert_allclose(got, w, rtol=1e-9)


@pytest.mark.parametrize("n, back", [(1, False), (7, False), (13, True), (12, False)])
def test_transform_of_any_length(spark, n, back):
    z = np.random.default_rng(n).random((2, n)) + 1j * np.random.default_rng(n + 1).random((2, n))
    rows = [(k, i, float(z[k, i].real), float(z[k, i].imag)) for k in range(2) for i in range(n)]
    got = LA.fft_any(spark.createDataFrame(rows, "k int, i bigint, re double, im double"), ["k"], n, back).orderBy("k", "i").toPandas()
    want = np.fft.ifft(z, axis=1) if back else np.fft.fft(z, axis=1)
    np.testing.assert_allclose((got["re"] + 1j * got["im"]).to_numpy().reshape(2, n), want, atol=1e-10)


def test_png_row_filters():
    img = np.random.default_rng(4).integers(0, 256, (9, 14, 3), dtype=np.uint8)
    for kind in range(5):
        np.testing.assert_array_equal(BK.png_pixels(BK.png_bytes(img, kind)), img)
    with pytest.raises(ValueError):
        BK.png_pixels(b"no image")


def test_windows_over_tiles(spark):
    v = np.round(np.random.default_rng(5).random((19, 23)), 3)
    v[3:9, 4:8] = np.nan
    df = spark.createDataFrame([(x, y, float(v[y, x])) for y in range(19) for x in range(23) if v[y, x] == v[y, x]], "x int, y int, v double")
    full = np.nan_to_num(v)
    for d in (1, 4, 5):
        got = IM.moving(df, "v", (23, 19), d, {"m": "median", "lo": "min", "hi": "max", "s": IM.window_function(lambda w: w.sum(axis=1))}, tile=7).toPandas()
        assert len(got) == int((v == v).sum())
        for r in got.itertuples():
            x0, y0 = min(max(r.x - d // 2, 0), 23 - d), min(max(r.y - d // 2, 0), 19 - d)
            w = full[y0:y0 + d, x0:x0 + d]
            assert (r.lo, r.hi) == (w.min(), w.max()) and (r.m, r.s) == pytest.approx((np.median(w), w.sum()))
    with pytest.raises(ValueError):
        IM.moving(df, "v", (23, 19), 20, {"m": "median"})


def test_laplacian_pyramid_comes_back(spark):
    v = np.random.default_rng(6).random((9, 13))
    df = spark.createDataFrame([(x, y, float(v[y, x])) for y in range(9) for x in range(13)], "x bigint, y bigint, v double")
    levels = IM.pyramid(df, (13, 9), "v", 2)
    laps = IM.laplacian_pyramid(levels, (13, 9), "v")
    back = IM.reconstruct(laps, (13, 9), "v").toPandas()
    out = np.zeros((9, 13))
    out[back["y"], back["x"]] = back["v"]
    np.testing.assert_allclose(out, v, atol=1e-9)
    assert IM.expand(spark.createDataFrame([(x, y, 1.0) for x in range(7) for y in range(5)], "x bigint, y bigint, v double"), "v", (13, 9)).where("abs(v - 1) > 1e-9").count() == 0


def test_parts_of_strings_ties_and_large_groups(spark):
    rng = np.random.default_rng(7)
    rows = [("strings", f"name-{i:06d}", int(i), 0) for i in rng.permutation(6000)]
    rows += [("instant", "same", int(i), 0) for i in rng.permutation(6000)]
    rows += [(None, None if i % 2 else "b", int(i), 0) for i in rng.permutation(3000)]
    rows += [(f"k{i}", "x", j, 0) for i in range(300) for j in range(3)]
    df = spark.createDataFrame(rows, "k string, s string, t int, one int").repartition(5)
    sizes = O.in_parts(df, ["k"], ["s", "t"], 200).groupBy("k", "__part").count().toPandas()
    assert sizes["count"].max() <= 600 and sizes[sizes["k"] == "instant"]["__part"].nunique() >= 15 and sizes[sizes["k"] == "k7"]["__part"].tolist() == [0]
    many = spark.range(60_000).select(F.xxhash64("id").cast("string").alias("s"))
    assert O.in_parts(many, [], ["s"], 100).select("__part").distinct().count() > 300  # grows with the rows
    got = O.indexed(df, ["k"], ["s", "t"], group_rows=200).toPandas().sort_values(["k", "i"], na_position="first")
    for k, g in got.groupby("k", dropna=False):
        want = sorted(((s is not None and s == s, s if isinstance(s, str) else "", t) for s, t in zip(g["s"], g["t"])))
        assert g["i"].tolist() == list(range(len(g))) and [t for _, _, t in want] == g["t"].tolist()
