"""Compare registered queries with their oracle SQL on one data folder.

usage: check_oracle.py [--sf DIR] [--explain] [name-prefix ...]
"""

from __future__ import annotations

import argparse
import math
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb  # noqa: E402
import pandas as pd  # noqa: E402

from lattica.plans.registry import catalogue  # noqa: E402
from lattica.session import build_session  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def rows(pdf: pd.DataFrame) -> list[tuple]:
    pdf = pdf[sorted(pdf.columns)]
    out = []
    for r in pdf.itertuples(index=False, name=None):
        out.append(tuple(norm(v) for v in r))
    return sorted(out, key=lambda t: tuple((v is None, str(type(v)), v) if not isinstance(v, tuple) else (False, "t", str(v)) for v in t))


def norm(v):
    if v is None or v is pd.NaT:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return v + 0.0
    if hasattr(v, "item") and getattr(v, "ndim", 0) == 0:
        return norm(v.item())
    if hasattr(v, "tolist"):
        return tuple(norm(x) for x in v.tolist())
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


def main() -> int:
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("--explain", action="store_true")
    ap.add_argument("names", nargs="*")
    a = ap.parse_args()
    spark = build_session("check", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g",
        "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{a.sf}/{t}.parquet'")
    bad = 0
    for name, q in catalogue().items():
        if a.names and not any(name.startswith(p) for p in a.names):
            continue
        try:
            t0 = time.time()
            df = q.build(spark, a.sf)
            if a.explain:
                df.explain("formatted")
            got = df.toPandas()
            t1 = time.time()
            if q.sql is None:
                print(f"ROWS  {name:28s} {len(got):7d} rows  spark {t1-t0:6.2f}s  {list(got.columns)}")
                continue
            rel = con.sql(q.sql)
            want = rel.df()
            t2 = time.time()
        except Exception as e:  # noqa: BLE001
            bad += 1
            print(f"ERROR {name}: {str(e)[:1500]}")
            continue
        msg = ""
        if sorted(got.columns) != sorted(want.columns):
            msg = f"columns {sorted(got.columns)} != {sorted(want.columns)}"
        elif len(got) != len(want):
            msg = f"rows {len(got)} != {len(want)}"
        else:
            st = {f.name: f.dataType.simpleString() for f in df.schema.fields}
            dt = dict(zip(rel.columns, [str(x) for x in rel.types]))
            same = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "float": "FLOAT"}
            tm = [(c, st[c], dt[c]) for c in st if same.get(st[c], dt[c].lower()) != dt[c]]
            g, w = rows(got), rows(want)
            diff = [(x, y) for x, y in zip(g, w) if x != y]
            if diff:
                msg = f"{len(diff)} differ, cols {sorted(got.columns)}\n   spark {diff[0][0]}\n   duck  {diff[0][1]}"
            elif tm:
                msg = f"types {tm}"
        bad += bool(msg)
        print(f"{'FAIL ' if msg else 'ok   '} {name:28s} {len(got):7d} rows  spark {t1-t0:6.2f}s duck {t2-t1:6.2f}s {msg}", flush=True)
    print("bad:", bad)
    sys.stdout.flush()
    spark.stop()
    return bad


if __name__ == "__main__":
    os._exit(1 if main() else 0)
