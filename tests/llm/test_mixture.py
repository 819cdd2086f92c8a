import random
import re

from lattica.llm import common as C
from lattica.llm import mixture as M
from lattica.llm import queries as Q

WORD = re.compile(C.WORD)


def water_fill(sizes, weights, share, limit):
    """Shares by weight; what is over a cap is shared again until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    t, excess, free = dict.fromkeys(order, 0.0), share * sum(sizes.values()), set(order)
    while excess > 1e-9 and free:
        total = sum(w[s] for s in free)
        for s in free:
            t[s] += excess * w[s] / total
        over = {s for s in free if t[s] > limit * sizes[s]}
        excess = sum(t[s] - limit * sizes[s] for s in over)
        for s in over:
            t[s] = float(limit * sizes[s])
        free -= over
    return t


def check(rows, out):
    size = {}
    for _, t, s in rows:
        size[s] = size.get(s, 0) + len(WORD.findall(t or ""))
    want = water_fill(size, (3, 1, 2), 1.5, 2)
    assert sorted((r.doc_id, r.size) for r in out if r.doc_id is not None) == sorted((d, len(WORD.findall(t or ""))) for d, t, _ in rows if d is not None)
    taken = {}
    for r in out:
        assert r.source_size == size[r.source] and abs(r.target - want[r.source]) < 1e-6 * max(1, want[r.source])
        assert 0 <= r.taken <= 2 * r.size and (not r.size or r.taken % r.size == 0)
        taken[r.source] = taken.get(r.source, 0) + r.taken
    return {s: abs(taken[s] - want[s]) for s in size}


def test_whole_table(spark, sf):
    docs = C.table(spark, sf, "documents")
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    off = check(rows, M.mix(docs).collect())
    assert sum(d <= 3 for d in off.values()) >= 15 and max(off.values()) <= 60  # ten documents a source
    a, b = (sorted(map(tuple, Q.op7_mixture(spark, sf).repartition(k).collect())) for k in (1, 7))
    assert a == b


def test_edges(spark):
    rng = random.Random(5)
    rows = [(i if i % 7 else None, " ".join("w" * rng.randrange(1, 9) for _ in range(rng.randrange(0, 40))), rng.choice(["b", "a", None, "", "é"])) for i in range(300)]
    rows += [(1000 + i, "the same five words here", "a") for i in range(400)] + [(1, None, "empty"), (1, None, "empty"), (2, "", "void")]
    df = spark.createDataFrame([(d, t, s, 3, 4) for d, t, s in rows], "doc_id long, text string, source string, size int, taken int")
    off = check(rows, M.mix(df).collect())
    assert max(off.values()) <= 1
    assert M.mix(df.limit(0)).count() == 0


def test_fit_is_optimal():
    rng = random.Random(1)
    for _ in range(200):
        sizes = rng.sample(range(1, 60), rng.randrange(1, 6))
        counts = [rng.randrange(0, 4) for _ in sizes]
        total = sum(s * n for s, n in zip(sizes, counts))
        budget = rng.randrange(0, total + 3)
        take = M.fit_budget(sizes, counts, budget)
        assert all(0 <= k <= n for k, n in zip(take, counts))
        got = sum(s * k for s, k in zip(sizes, take))
        sums = {0}
        for s, n in zip(sizes, counts):
            sums = {x + s * k for x in sums for k in range(n + 1)}
        best = min(abs(x - budget) for x in sums)
        assert abs(got - budget) == best or max(counts) > 1  # a bulk share comes first where counts allow one
        assert abs(got - budget) <= best + max(sizes) / 2
