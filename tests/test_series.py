"""Series operators: chunked plans must equal plain numpy on skewed groups."""

import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lattica.operators import order as O, series as R
from lattica.streaming import moving as M


@pytest.fixture(scope="module")
def skewed(spark):
    """One key holds most rows; values repeat."""
    rng = np.random.default_rng(5)
    rows = []
    for k, n in (("hot", 400), ("b", 23), ("c", 1), ("d", 60)):
        v = np.round(rng.gamma(2.0, 3.0, n), 1)
        rows += [(k, int(t), float(x)) for t, x in enumerate(v)]
    pdf = pd.DataFrame(rows, columns=["k", "t", "v"]).sample(frac=1.0, random_state=1)
    return spark.createDataFrame(pdf).repartition(5), pdf.sort_values(["k", "t"])


def by_key(pdf):
    return {k: g["v"].to_numpy() for k, g in pdf.groupby("k")}


def check(df, col, want, keys=("k",)):
    got = df.select("k", "t", col).toPandas().sort_values(["k", "t"])
    for k, g in got.groupby("k"):
        np.testing.assert_allclose(g[col].to_numpy(float), want[k], rtol=1e-7, atol=1e-6, err_msg=k)
    assert sum(map(len, want.values())) == len(got)


def padded(x, d):
    return np.concatenate([np.full(d - 1, x[0]), x])


def np_ma(x, d):
    d = min(len(x), d)
    return np.array([padded(x, d)[i:i + d].mean() for i in range(len(x))])


def np_dev(x, d):
    p = padded(x, d)
    return np.array([p[i:i + d].std() for i in range(len(x))])


def np_median(x, d):
    return np.array([np.median(x[max(0, i - d + 1):i + 1]) for i in range(len(x))])


def np_rise(x, d):
    s = np.r_[0, np.maximum(np.diff(x), 0)]
    return np.array([s[max(0, i - d + 1):i + 1].sum() for i in range(len(x))])


def np_tau(x):
    n = len(x)
    if n < 2:
        return np.nan
    s = sum(1 if x[j] > x[i] else -1 for i in range(n) for j in range(i + 1, n))
    return s / (n * (n - 1) / 2)


def np_ema(x, beta):
    y = [x[0]]
    for v in x[1:]:
        y.append(beta * y[-1] + (1 - beta) * v)
    return np.array(y)


@pytest.mark.parametrize("rows", [None, 50, 17])
def test_windows(skewed, rows):
    df, pdf = skewed
    x = by_key(pdf)
    cases = {
        "ma": (R.moving_average(7), lambda v: np_ma(v, 7)),
        "dev": (R.moving_deviation(6), lambda v: np_dev(v, 6)),
        "med": (R.moving_median(5), lambda v: np_median(v, 5)),
        "rise": (R.moving_rise(8, 1), lambda v: np_rise(v, 8)),
        "mom": (R.momentum(4, False), lambda v: v - v[np.maximum(np.arange(len(v)) - 4, 0)]),
        "tau": (R.trend_strength(6), lambda v: np.array([np_tau(v[max(0, i - 5):i + 1]) for i in range(len(v))])),
    }
    for col, ((reach, build), ref) in cases.items():
        out = R.moving(df, ["k"], ["t"], "v", reach, build, group_rows=rows)
        check(out, col, {k: ref(v) for k, v in x.items()})


@pytest.mark.parametrize("rows", [None, 40])
@pytest.mark.parametrize("beta", [0.9, -12.0, 0.999])
def test_exponential_average(skewed, rows, beta):
    df, pdf = skewed
    b = beta if beta >= 0 else 1 - 2 / (-beta + 1)
    out = R.exponential_average(df, ["k"], ["t"], "v", beta, group_rows=rows)
    check(out, "ema", {k: np_ema(v, b) for k, v in by_key(pdf).items()})


@pytest.mark.parametrize("rows", [None, 30])
def test_trend_counts_every_pair_once(skewed, rows):
    df, pdf = skewed
    got = {r["k"]: r["tau"] for r in R.trend(df, ["k"], ["t"], "v", group_rows=rows, chunk=30).collect()}
    for k, v in by_key(pdf).items():
        want = np_tau(v)
        assert (got[k] is None and np.isnan(want)) or got[k] == pytest.approx(want, abs=1e-12)


def test_trend_with_one_dominant_value(spark):
    v = np.r_[np.full(300, 2.0), np.arange(100) % 7]
    np.random.default_rng(2).shuffle(v)
    df = spark.createDataFrame([("a", i, float(x)) for i, x in enumerate(v)], "k string, t bigint, v double")
    got = R.trend(df, ["k"], ["t"], "v", group_rows=25, chunk=25).first()["tau"]
    assert got == pytest.approx(np_tau(v), abs=1e-12)


def test_rising_pairs():
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 9, 64, 65):
        v = rng.integers(0, 6, n).astype(float)
        assert R.rising_pairs(v) == sum(v[j] > v[i] for i in range(n) for j in range(i + 1, n))


@pytest.mark.parametrize("rows", [None, 30])
def test_monotony_and_detrend(skewed, rows):
    df, pdf = skewed
    got = {r["k"]: r for r in R.monotony(df, ["k"], ["t"], "v", rows).collect()}
    for k, v in by_key(pdf).items():
        peak = np.maximum.accumulate(v)
        low = np.r_[False, v[1:] < peak[:-1]]
        low[-1] = False
        assert got[k]["monotony"] == pytest.approx(v[low].sum() / v.sum())
        assert got[k]["n_valleys"] == int((low & ~np.r_[False, low[:-1]]).sum())
    zero = df.withColumn("v", F.when(F.col("t") % 10 < 6, 0.0).otherwise(F.col("v")))
    out = R.detrended(zero, ["k"], ["t"], "v", 3, rows)
    want = {}
    for k, v in by_key(pdf).items():
        x = np.where(np.arange(len(v)) % 10 < 6, 0.0, v)
        m = np_ma(np.abs(x), 3)
        y = np.full(len(x), np.nan)
        for i in range(len(x)):
            j = next((p % len(x) for p in range(i, i + len(x)) if m[p % len(x)] >= 1e-12), None)
            if j is not None:
                y[i] = x[i] / m[j]
        want[k] = y
    got = out.select("k", "t", "det").toPandas().sort_values(["k", "t"])
    for k, g in got.groupby("k"):
        ok = np.abs(want[k]) > 0
        np.testing.assert_allclose(g["det"].to_numpy(float)[ok], want[k][ok], rtol=1e-6)


@pytest.mark.parametrize("rows", [None, 35])
def test_order_statistics(skewed, rows):
    df, pdf = skewed
    x = by_key(pdf)
    med = {r["k"]: r["median"] for r in O.median(df, ["k"], "v", rows).collect()}
    assert med == pytest.approx({k: float(np.median(v)) for k, v in x.items()})
    kth = {(r["k"], r["q"]): r["v"] for r in O.kth(df, ["k"], "v", [0, F.col("n") - 1], rows).collect()}
    for k, v in x.items():
        assert kth[k, 0] == v.min() and kth[k, 1] == v.max()
    rank = {(r["k"], r["v"]): r["rank"] for r in O.average_rank(df, ["k"], "v", rows).collect()}
    for k, v in x.items():
        want = pd.Series(v).rank().to_numpy()
        for a, b in zip(v, want):
            assert rank[k, a] == b


def test_running_without_keys_over_ranges(spark):
    df = spark.range(1000).select(((F.col("id") * 7919) % 1000).alias("t"))
    got = O.running(df, [], ["t"], {"s": F.col("t")}, totals={"n": F.lit(1)}, group_rows=64).toPandas().sort_values("t")
    np.testing.assert_array_equal(got["s"], np.r_[0, np.cumsum(np.arange(999))])
    assert set(got["n"]) == {1000}


def _drain(job, spark, tmp_path, schema):
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = job.start(stream, str(tmp_path / "out"), str(tmp_path / "cp"), availableNow=True)
    q.awaitTermination(180)
    assert q.exception() is None


def _held(spark, tmp_path):
    return spark.read.format("statestore").load(str(tmp_path / "cp"))


def test_stream_equals_batch(spark, skewed, tmp_path):
    _, pdf = skewed
    (tmp_path / "in").mkdir()
    schema = "k string, t bigint, v double"
    job = M.ring_deviation(["k"], ["t"], "v", 6)

    def arrive(lo):
        part = pdf[(pdf["t"] >= lo) & (pdf["t"] < lo + 200)].sample(frac=1, random_state=1)
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    arrive(0)
    _drain(job, spark, tmp_path, schema)
    arrive(200)
    _drain(job, spark, tmp_path, schema)
    check(M.results(spark, str(tmp_path / "out")), "dev", {k: np_dev(v, 6) for k, v in by_key(pdf).items()})
    # one row of bounded size per series
    held = _held(spark, tmp_path).selectExpr("key.k as k", "size(value.groupState.tail) as n", "value.groupState.count as c").toPandas()
    assert len(held) == pdf["k"].nunique(dropna=False) and (held["n"] == 5).all() and held["c"].sum() == len(pdf)
    # a batch that was computed but not committed is replayed from the same state and counted once
    commits = sorted((tmp_path / "cp" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    commits[-1].unlink()
    commits[-1].with_name(f".{commits[-1].name}.crc").unlink(missing_ok=True)
    _drain(job, spark, tmp_path, schema)
    check(M.results(spark, str(tmp_path / "out")), "dev", {k: np_dev(v, 6) for k, v in by_key(pdf).items()})


def test_idle_series_are_forgotten(spark, tmp_path):
    (tmp_path / "in").mkdir()
    schema = "k string, t bigint, v double"
    job = M.ring_average(["k"], ["t"], "v", 3, ttl=1000)
    put = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    put([(k, t, float(t)) for k in ("a", "b", None) for t in range(4)])
    _drain(job, spark, tmp_path, schema)
    assert _held(spark, tmp_path).count() == 3
    time.sleep(2)
    put([("a", 4, 4.0), ("a", 5, 5.0)])
    _drain(job, spark, tmp_path, schema)
    left = _held(spark, tmp_path).selectExpr("key.k as k", "value.groupState.count as c").collect()
    assert [r.k for r in left] == ["a"]
    got = {(r.k, r.t): r.ma for r in M.results(spark, str(tmp_path / "out")).collect()}
    assert len(got) == 14 and got[None, 3] == 2.0 and got["b", 1] == pytest.approx(1 / 3)


def _with_null_group(spark):
    """A null group, a dominant one and many small ones, with ties in time."""
    rng = np.random.default_rng(8)
    rows = [(None, t // 2, t, float(rng.integers(0, 30))) for t in range(60)]
    rows += [(1, t // 3, t, float(rng.integers(0, 30))) for t in range(2000)]
    rows += [(k, t, t, float(rng.integers(0, 30))) for k in range(2, 60) for t in range(5)]
    return spark.createDataFrame(rows, "k int, t int, e int, v double")


def _same(a, b, by):
    x, y = (d.toPandas().sort_values(by, na_position="first").reset_index(drop=True)[sorted(d.columns)] for d in (a, b))
    pd.testing.assert_frame_equal(x, y, check_dtype=False, rtol=1e-9)
    assert x["k"].isna().any()


def test_null_groups_and_part_sizes_agree(spark):
    df = _with_null_group(spark)
    for rows in (40,):
        for fn, by in ((lambda g: O.median(df, ["k"], "v", g), ["k"]), (lambda g: O.average_rank(df, ["k"], "v", g), ["k", "v"]),
                       (lambda g: O.indexed(df, ["k"], ["t", "e"], g), ["k", "t", "e"]),
                       (lambda g: R.moving(df, ["k"], ["t", "e"], "v", *R.moving_median(5), group_rows=g), ["k", "t", "e"]),
                       (lambda g: R.exponential_average(df, ["k"], ["t", "e"], "v", 0.9, group_rows=g), ["k", "t", "e"]),
                       (lambda g: R.exponential_average(df, ["k"], ["t", "e"], "v", 1.0, group_rows=g), ["k", "t", "e"]),
                       (lambda g: R.monotony(df, ["k"], ["t", "e"], "v", g), ["k"]),
                       (lambda g: R.detrended(df, ["k"], ["t", "e"], "v", 4, g), ["k", "t", "e"]),
                       (lambda g: R.trend(df, ["k"], ["t", "e"], "v", g, chunk=1 << 18 if g is None else g), ["k"])):
            _same(fn(rows), fn(None), by)


def test_null_groups_keep_their_statistics(spark):
    from lattica.operators import linalg as LA, stats as S
    df = _with_null_group(spark)
    known = df.fillna({"k": -1})
    _back = lambda d: d.withColumn("k", F.nullif("k", F.lit(-1)))
    _same(S.semi_deviation(df, ["k"], "v"), _back(S.semi_deviation(known, ["k"], "v")), ["k"])
    _same(S.histogram(df, ["k"], "v", 5, -2.0, 2.0, standardise=True), _back(S.histogram(known, ["k"], "v", 5, -2.0, 2.0, standardise=True)), ["k"])
    x = df.withColumn("x", F.col("t") / 100)
    _same(LA.adapt(x, ["k"], ["t", "e"], ["x"], "v", 0.1), _back(LA.adapt(x.fillna({"k": -1}), ["k"], ["t", "e"], ["x"], "v", 0.1)), ["k"])


def test_no_job_runs_while_a_plan_is_built(spark):
    df = _with_null_group(spark)
    status = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("plan", "plan")
    O.median(df, ["k"], "v")
    R.trend(df, ["k"], ["t", "e"], "v")
    R.moving(df, ["k"], ["t", "e"], "v", *R.moving_average(5))
    assert not status.getJobIdsForGroup("plan")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_momentum_of_zero_values_is_null(spark):
    """A ratio to zero has no logarithm, nor has a ratio of zero; the other rows keep theirs."""
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate([0.0, 2.0, 4.0, 0.0, 1.0])], "k string, t int, v double")
    got = {r.t: r.mom for r in R.moving(df, ["k"], ["t"], "v", *R.momentum(1, True)).collect()}
    assert got == {0: None, 1: None, 2: pytest.approx(np.log(2.0)), 3: None, 4: None}
