"""Headline queries, each run to completion; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from lattica.plans.registry import catalogue  # noqa: E402
from lattica.session import build_session  # noqa: E402
from lattica.sources import tables as B  # noqa: E402

HEADLINE = [
    "pt_block_bin", "blk_regularize", "blk_flags", "splat_density", "splat_density_stats", "ch_stat", "ch_binary", "ch_sum_slices",
    "sten_diffuse", "sten_meancurv", "pyr_tensor4", "interp_linear", "relax_jacobi_step", "st_median_price", "st_covariance",
    "pipeline_surface", "st_hist", "st_ecdf_compare", "ts_ma", "ts_ema", "ts_trend", "transp_prefix", "hash_mix64",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g", "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    queries = catalogue()
    # start the JVM and the Python workers outside the clock
    queries["hash_mix64"].build(spark, folder).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for name in HEADLINE:
        t0 = time.perf_counter()
        queries[name].build(spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
    n_points = B.table(spark, folder, "lineitem").count()
    n_cells = spark.read.parquet(f"{folder}/lineitem.parquet").selectExpr("l_partkey >> 5 as b").distinct().count() * 4 * 512
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": Path(folder).name.removeprefix("sf"),
        "splat_points_per_s": round(n_points / times["splat_density"]),
        "stencil_cells_per_s": round(n_cells / times["sten_meancurv"]),
    }))
    sys.stdout.flush()
    spark.stop()


if __name__ == "__main__":
    main()
