"""Moving windows, recursions and trend measures over the event series."""

import uuid

from pyspark.sql import functions as F

from lattica.operators import series as R
from lattica.plans.common import rnd, rsql
from lattica.plans.registry import query
from lattica.session import ensure_checkpoint_dir
from lattica.sources import tables as B
from lattica.streaming import moving as M

ORDER = ["ts", "event_id"]
S0 = B.SERIES_SQL
_W = lambda d: f"(PARTITION BY k ORDER BY i ROWS BETWEEN {d - 1} PRECEDING AND CURRENT ROW)"
_HEAD = "first_value(v) OVER (PARTITION BY k ORDER BY i)"


def run(spark, d, spec, out, digits=6):
    reach, build = spec
    df = R.moving(B.series(spark, d), ["k"], ORDER, "v", reach, build)
    return df.select("k", "event_id", rnd(out, digits).alias(out))


@query("ts_ma", "W1 T11", f"""WITH {S0}, f AS (SELECT *, {_HEAD} AS h, count(*) OVER (PARTITION BY k) AS n, sum(v) OVER {_W(7)} AS s FROM s)
SELECT k, event_id, {rsql('(s + greatest(least(n, 7) - (i + 1), 0) * h) / least(n, 7)')} AS ma FROM f""")
def _(spark, d):
    return run(spark, d, R.moving_average(7), "ma")


@query("ts_median", "W2 T11", f"WITH {S0} SELECT k, event_id, {rsql(f'median(v) OVER {_W(5)}')} AS med FROM s")
def _(spark, d):
    return run(spark, d, R.moving_median(5), "med")


@query("ts_movstd", "W3 T11", f"""WITH {S0}, f AS (SELECT *, {_HEAD} AS h, sum(v) OVER {_W(6)} AS s1, sum(v * v) OVER {_W(6)} AS s2 FROM s),
 m AS (SELECT *, (s1 + greatest(5 - i, 0) * h) / 6 AS m, (s2 + greatest(5 - i, 0) * h * h) / 6 AS q FROM f)
SELECT k, event_id, {rsql('sqrt(abs(q - m * m))', 4)} AS dev FROM m""")
def _(spark, d):
    return run(spark, d, R.moving_deviation(6), "dev", 4)


def _rise_sql(sign):
    return f"""WITH {S0}, f AS (SELECT *, coalesce(greatest({sign} * (v - lag(v) OVER (PARTITION BY k ORDER BY i)), 0), 0) AS st FROM s)
SELECT k, event_id, {rsql(f'sum(st) OVER {_W(8)}')} AS rise FROM f"""


@query("ts_movdiff_up", "W4", _rise_sql("1"))
def _(spark, d):
    return run(spark, d, R.moving_rise(8, 1), "rise")


@query("ts_movdiff_down", "W4", _rise_sql("-1"))
def _(spark, d):
    return run(spark, d, R.moving_rise(8, -1), "rise")


def _ema_sql(beta):
    return f"""WITH RECURSIVE {S0}, r AS (SELECT k, event_id, i, v AS y FROM s WHERE i = 0
 UNION ALL SELECT s.k, s.event_id, s.i, {beta} * r.y + (1 - {beta}) * s.v FROM r JOIN s ON s.k = r.k AND s.i = r.i + 1)
SELECT k, event_id, {rsql('y')} AS ema FROM r"""


@query("ts_ema", "W5", _ema_sql("0.9e0"))
def _(spark, d):
    return R.exponential_average(B.series(spark, d), ["k"], ORDER, "v", 0.9).select("k", "event_id", rnd("ema").alias("ema"))


@query("ts_ema_span", "W5", _ema_sql("(1 - 2e0 / 13e0)"))
def _(spark, d):
    return R.exponential_average(B.series(spark, d), ["k"], ORDER, "v", -12.0).select("k", "event_id", rnd("ema").alias("ema"))


@query("ts_decay_window", "W5 W10", f"""WITH {S0}, f AS (SELECT *, {_HEAD} AS h FROM s),
 a AS (SELECT *, {' + '.join(f"pow(0.8e0, {j}) * coalesce(lag(v, {j}) OVER (PARTITION BY k ORDER BY i), h)" for j in range(5))} AS t FROM f)
SELECT k, event_id, {rsql('t / ((pow(0.8e0, 5) - 1) / (0.8e0 - 1))')} AS dma FROM a""")
def _(spark, d):
    return run(spark, d, R.windowed_decay(5, 0.8), "dma")


@query("ts_stream_decay", "W10", f"""WITH {S0}, f AS (SELECT *, {_HEAD} AS h FROM s),
 a AS (SELECT *, {' + '.join(f"pow(0.8e0, {j}) * coalesce(lag(v, {j}) OVER (PARTITION BY k ORDER BY i), h)" for j in range(5))} AS t FROM f)
SELECT k, event_id, {rsql('t / ((pow(0.8e0, 5) - 1) / (0.8e0 - 1))')} AS dma FROM a""")
def _(spark, d):
    """The events as an arriving stream, drained into the shared folder; a pattern may name one file, a plain path only a folder."""
    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    schema = B.table(spark, d, "events").schema
    events = spark.readStream.schema(schema).parquet(f"{d}/events.parque[t]").select(F.col("user_id").alias("k"), "ts", "event_id", F.col("value").alias("v"))
    M.ring_decay(["k"], ORDER, "v", 5, 0.8).start(events, f"{root}/out", f"{root}/log", availableNow=True).awaitTermination()
    return M.results(spark, f"{root}/out").select("k", "event_id", rnd("dma").alias("dma"))


@query("ts_momentum", "W6", f"WITH {S0}, f AS (SELECT *, coalesce(lag(v, 4) OVER (PARTITION BY k ORDER BY i), {_HEAD}) AS p FROM s) SELECT k, event_id, {rsql('ln(v / p)')} AS mom FROM f")
def _(spark, d):
    return run(spark, d, R.momentum(4, True), "mom")


@query("ts_momdiff", "W7", f"WITH {S0}, f AS (SELECT *, coalesce(lag(v, 4) OVER (PARTITION BY k ORDER BY i), {_HEAD}) AS p FROM s) SELECT k, event_id, {rsql('v - p')} AS mom FROM f")
def _(spark, d):
    return run(spark, d, R.momentum(4, False), "mom")


@query("ts_trend_window", "W8 T12", f"""WITH {S0}, a AS (SELECT *, list(v) OVER {_W(6)} AS w FROM s),
 p AS (SELECT k, event_id, {' + '.join(f"coalesce(CAST(w[{q}] > w[{j}] AS INTEGER), 0)" for j in range(1, 7) for q in range(j + 1, 7))} AS up, len(w) * (len(w) - 1) / 2 AS m FROM a)
SELECT k, event_id, CASE WHEN m > 0 THEN {rsql('(2 * up - m) / m')} END AS tau FROM p""")
def _(spark, d):
    return run(spark, d, R.trend_strength(6), "tau")


@query("ts_detrend", "W9", f"""WITH {S0.replace('value AS v', '(CASE WHEN value < 6 THEN 0e0 ELSE value - 30 END) AS v')},
 f AS (SELECT *, abs({_HEAD}) AS h, count(*) OVER (PARTITION BY k) AS n, sum(abs(v)) OVER {_W(3)} AS s FROM s),
 m AS (SELECT *, round((s + greatest(least(n, 3) - (i + 1), 0) * h) / least(n, 3), 9) AS ma FROM f),
 x AS (SELECT *, CASE WHEN ma > 0 THEN ma ELSE coalesce(first_value(CASE WHEN ma > 0 THEN ma END IGNORE NULLS) OVER (PARTITION BY k ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING),
   first_value(CASE WHEN ma > 0 THEN ma END IGNORE NULLS) OVER (PARTITION BY k ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) END AS sc FROM m)
SELECT k, event_id, {rsql('CASE WHEN sc IS NOT NULL THEN v / sc END')} AS det FROM x""")
def _(spark, d):
    s = B.series(spark, d).withColumn("v", F.when(F.col("v") < 6, 0.0).otherwise(F.col("v") - 30))
    return R.detrended(s, ["k"], ORDER, "v", 3).select("k", "event_id", rnd("det").alias("det"))


@query("ts_monotony", "W12", f"""WITH {S0}, p AS (SELECT *, max(v) OVER (PARTITION BY k ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pk, count(*) OVER (PARTITION BY k) AS n FROM s),
 l AS (SELECT *, coalesce(v < pk AND i < n - 1, false) AS low FROM p),
 g AS (SELECT *, sum(CASE WHEN low THEN 0 ELSE 1 END) OVER (PARTITION BY k ORDER BY i) AS isle FROM l),
 vs AS (SELECT k, isle, sum(v) AS s FROM g WHERE low GROUP BY 1, 2), t AS (SELECT k, sum(v) AS t FROM s GROUP BY 1)
SELECT k, {rsql('coalesce(sum(vs.s), 0) / any_value(t)')} AS monotony, CAST(count(vs.s) AS BIGINT) AS n_valleys, {rsql('max(vs.s) / any_value(t)')} AS max_share FROM t LEFT JOIN vs USING (k) GROUP BY k""")
def _(spark, d):
    return R.monotony(B.series(spark, d), ["k"], ORDER, "v").select("k", rnd("monotony").alias("monotony"), "n_valleys", rnd("max_share").alias("max_share"))


@query("ts_trend", "A23 T12", f"""WITH {S0} SELECT a.k, any_value(n) AS n, {rsql('avg(CASE WHEN b.v > a.v THEN 1e0 ELSE -1e0 END)')} AS tau
FROM s a JOIN s b ON a.k = b.k AND a.i < b.i JOIN (SELECT k, CAST(count(*) AS BIGINT) AS n FROM s GROUP BY 1) c ON c.k = a.k GROUP BY a.k""")
def _(spark, d):
    return R.trend(B.series(spark, d), ["k"], ORDER, "v").select("k", "n", rnd("tau").alias("tau"))


@query("ts_thin", "E12", f"WITH {S0} SELECT k, event_id, i // 5 AS i, v FROM s WHERE i % 5 = 4")
def _(spark, d):
    return R.thin(B.series(spark, d), ["k"], ORDER, 5).select("k", "event_id", "i", "v")
