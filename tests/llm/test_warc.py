import hashlib

import pandas as pd

from lattica.llm import common as C
from lattica.llm import queries as Q
from lattica.llm import warc as W


def brute(rows):
    least = {}
    for p, _, h in rows:
        b = (h or "").encode()
        if p is not None:
            least[b] = min(least.get(b, p), p)
    out = []
    for p, _, h in rows:
        b = (h or "").encode()
        again = len(b) >= 100 and b in least and least[b] != p
        out.append((p, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", least[b] if again else None))
    return sorted(out, key=str)


def test_query_equals_brute_force(spark, sf):
    rows = [(r.page_id, r.url, r.html) for r in C.table(spark, sf, "pages").collect()]
    assert sorted(map(tuple, Q.op10_warc(spark, sf).collect()), key=str) == brute(rows)


ROWS = [(1, "u", None), (2, None, ""), (None, "u\r\nX: y", "é" * 80), (4, "u", "x" * 99), (3, "u", "x" * 99), (9, "u", "y" * 100), (8, "u", "y" * 100), (8, "u", "y" * 100),
        (None, "u", "y" * 100), (10, "u", "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.1\r\n" * 5), (11, "u", "WARC/"), (12, "u", "a\r\n\r\nb WARC/1.0\r\n\r\n"),
        (13, "u", "\r\n\r\n"), (14, "u", "z" * 3_000_000), (-5, "u", "\x00 tail\n")]


def test_edges(spark):
    df = spark.createDataFrame([(*r, 1, 2) for r in ROWS], "page_id long, url string, html string, size int, digest int")
    out = W.round_trip(df).collect()
    assert all(r.intact for r in out)
    assert sorted((tuple(r)[:5] for r in out), key=str) == brute(ROWS)
    assert W.round_trip(df.limit(0)).count() == 0


def test_split_files(spark):
    rows = [(i, "u", f"{i} WARC/1.1\r\nContent-Length: {i}\r\n\r\n" * (i % 9)) for i in range(400)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    path = f"{C.checkpoint_dir(spark)}/warc-split"
    try:
        W.write_archives(W.archive(df), path, "none")
        got = W.read_archives(spark, path)
        assert spark.read.text(path).rdd.getNumPartitions() > 5
        assert sorted(W.page_of(got.record_id) is not None and r.record_id for r in got.collect()) == sorted(f"<urn:page:{i}>" for i in range(400))
        assert all(r.intact for r in got.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_chain():
    got = W.reachable(pd.DataFrame({"file": "f", "off": [0, 10, 25, 40, 90], "succ": [25, 40, 90, 90, 100]}))
    assert got.off.tolist() == [0, 25, 90] and got.end.tolist() == [25, 90, 100]
    assert W.reachable(pd.DataFrame({"file": "f", "off": [3, 10], "succ": [10, 20]})).empty
