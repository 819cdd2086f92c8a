import math

import numpy as np
import pytest

from lattica.llm import ann_forest as A
from lattica.llm import common as C
from lattica.llm import hard_negatives as H
from lattica.llm import queries as Q

ODD = [(900, None, 1), (901, [0.0] * 4, 1), (902, [float("nan"), 1.0, 0.0, 0.0], 2), (903, [float("inf")] * 4, 2), (904, [None, 1.0, 1.0, 1.0], 2), (905, [], 3), (950, [1.0, 2.0], 3)]


def dot(a, b):
    return sum(x * y for x, y in zip(a, b))


def fine(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def near(rows, k=5, every=50):
    rows = sorted({(d, tuple(v)) for d, v in rows if fine(v) and any(v)}, key=str)
    out = []
    for q, a in rows:
        if q is None or q % every:
            continue
        found = [(-(dot(a, b) / math.sqrt(dot(a, a) * dot(b, b))), d is None, d or 0, d) for d, b in rows if (d, b) != (q, a)]
        out += [(q, r, x[3], round(-x[0], 9)) for r, x in enumerate(sorted(found, key=lambda x: (round(x[0], 9), *x[1:3]))[:k], 1)]
    return sorted(out, key=str)


def mined(rows, positives=5, negatives=3):
    rows = [(d, tuple(math.floor(256 * x) for x in v), (l if d is None or d % 7 else (l + 1) % 10)) for d, v, l in rows if l is not None and fine(v)]
    rows = sorted(set(rows), key=str)
    out = []
    for a in rows:
        if a[0] is None or a[0] % 50:
            continue
        s = sorted((-dot(a[1], b[1]), b[0] is None, b[0] or 0, b) for b in rows if b is not a)
        for p in [x for x in s if x[3][2] == a[2]][:positives]:
            fit = [x for x in s if x[3][2] != a[2] and 50 * -p[0] <= 100 * -x[0] <= 95 * -p[0]][:negatives]
            out += [(a[0], p[3][0], r, x[3][0], -p[0], -x[0]) for r, x in enumerate(fit, 1)]
    return sorted(out, key=str)


def moved(F):
    return F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))


def tables(rng):
    """Spread rows, a crowded direction, one vector a third of all rows share, repeats, null ids and unusable rows."""
    free = [(i, rng.standard_normal(4).tolist(), int(rng.integers(10))) for i in range(300)]
    crowd = [(300 + i, (np.array([1, 2, 3, 4]) + rng.standard_normal(4) * 0.01).tolist(), i % 2) for i in range(200)]
    same = [(500 + i, [0.5, -0.25, 1.0, 0.125], 4 if i % 3 else 6) for i in range(300)]
    return free + crowd + same + ODD + [(100, free[7][1], 2), (7, free[7][1], free[7][2]), (None, free[3][1], 5), (None, [1.0, 1.0, 1.0, -1.0], None), (800, [40.0, 3.0, -7.0, 900.0], 5)]


@pytest.mark.parametrize("part, block", [(8192, 1024), (100, 8)])
def test_neighbours_of_edge_rows(spark, monkeypatch, part, block):
    monkeypatch.setattr(A, "PART_ROWS", part)
    monkeypatch.setattr(A, "BLOCK_QUERIES", block)
    rows = tables(np.random.default_rng(8))
    df = spark.createDataFrame([(d, v, l, 0.5) for d, v, l in rows], "vec_id long, embedding array<double>, label int, score double").repartition(6)
    got = sorted(((r.query_id, r.rank, r.vec_id, round(r.score, 9)) for r in A.nearest(df).collect()), key=str)
    assert got == near([(d, v) for d, v, _ in rows])  # every part is below the least number of candidates, so all rows are met
    assert A.nearest(df.limit(0)).count() == 0 and A.nearest(df.where("vec_id = 900")).count() == 0


def test_recall_of_the_query(spark):
    folder = "/root/testdata/sf0.1"
    rows = [(r.vec_id, r.embedding) for r in C.table(spark, folder, "embeddings").collect()]
    x = np.array([v for _, v in rows], np.float64)
    ids = np.array([d for d, _ in rows])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    got = {}
    for r in Q.op13_nearest(spark, folder).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    hits = 0
    for q in np.flatnonzero(ids % 50 == 0):
        s = unit @ unit[q]
        s[q] = -2
        mine = sorted(got[ids[q]])
        assert [r for r, _, _ in mine] == [1, 2, 3, 4, 5] and all(abs(s[np.flatnonzero(ids == d)[0]] - v) < 1e-12 for _, d, v in mine)
        hits += len({d for _, d, _ in mine} & set(ids[np.argsort(-s)[:5]]))
    assert hits >= 0.9 * 5 * len(got)


def test_forest_meets_longest_prefixes_first():
    rng = np.random.default_rng(2)
    x = rng.standard_normal((3000, 32))
    q = x[:40] + rng.standard_normal((40, 32)) * 0.3
    keys, asked = A.strings(x), A.strings(q)
    f = A.Forest(keys)
    shared = np.zeros((40, 3000), int)
    for level in range(1, A.LETTERS + 1):
        cut = np.uint64(A.BITS * (A.LETTERS - level))
        shared[(asked[:, None] >> cut == keys[None] >> cut).any(axis=2)] = level
    for enough in (1, 100, 900, 3000):
        for i, c in enumerate(f.candidates(asked, enough)):
            assert len(c) >= enough
            out = np.setdiff1d(np.arange(3000), c)
            least = shared[i, c].min()
            assert not len(out) or shared[i, out].max() <= least + 1  # the last level is taken tree by tree
            assert enough < 100 or i in c


@pytest.mark.parametrize("part, block, sample", [(8192, 512, 4096), (100, 8, 10)])
def test_negatives_equal_brute_force(spark, monkeypatch, part, block, sample):
    from pyspark.sql import functions as F

    for k, v in (("PART_ROWS", part), ("BLOCK_QUERIES", block), ("SAMPLE_ROWS", sample)):
        monkeypatch.setattr(H, k, v)
    rows = tables(np.random.default_rng(9))
    df = spark.createDataFrame([(d, v, l, "r") for d, v, l in rows], "vec_id long, embedding array<double>, label int, rank string").repartition(6)
    got = sorted((tuple(r) for r in H.mine(df, label=moved(F)).collect()), key=str)
    want = mined(rows)
    assert got == want and len(want) > 100
    assert H.mine(df.limit(0)).count() == 0 and H.mine(df.where("vec_id = 900")).count() == 0


def test_ranges_lose_nothing_and_prune():
    rng = np.random.default_rng(4)
    x = np.floor(256 * rng.standard_normal((2000, 24)) * rng.uniform(0.2, 2, (2000, 1))).astype(np.int64)
    x[:5] = 0
    b = H.Bucket(x)
    for i in range(5, 65):
        s = H.scores(x, x[i])
        for least in (-(1 << 40), -1000, 0, 1, int(np.sort(s)[-10]), int(s.max()), int(s.max()) + 1):
            c = b.candidates(x[i], least)
            assert not set(np.flatnonzero(s >= least)) - set(c.tolist())
    big = x[:20] * (1 << 20)
    assert H.scores(big, big[7]).tolist() == [int(sum(int(p) * int(q) for p, q in zip(r, big[7]))) for r in big]
    near_by = np.floor(256 * (np.ones((500, 24)) + rng.standard_normal((500, 24)) * 0.02)).astype(np.int64)
    like = np.floor(1254 * x[5:] / np.linalg.norm(x[5:], axis=1, keepdims=True)).astype(np.int64)
    alike = H.Bucket(np.r_[like, near_by])
    s = H.scores(alike.x, near_by[0])
    assert len(alike.candidates(near_by[0], int(np.sort(s)[-5]))) < 700  # all in a bucket of one length but few of the others
    assert not len(alike.candidates(near_by[0] // 2, int(s.max())))
