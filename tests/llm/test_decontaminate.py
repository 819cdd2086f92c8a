import random
from collections import Counter

import numpy as np

from lattica.llm import common as C
from lattica.llm import decontaminate as D
from lattica.llm import queries as Q


def words(t):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    return [w for w in __import__("re").findall(C.WORD, low)]


def brute(docs, bench, k=5, threshold=0.8):
    """Every window of every item's size, by exact similarity alone."""
    items = {i: words(t) for i, t in bench}
    out = {}
    for d, t in docs:
        dw = words(t)
        for i, w in items.items():
            kk = min(k, len(w))
            if not w or len(dw) < kk:
                continue
            bag = Counter(tuple(w[j:j + kk]) for j in range(len(w) - kk + 1))
            all_s = [tuple(dw[j:j + kk]) for j in range(len(dw) - kk + 1)]
            if not any(s in bag for s in all_s):
                continue
            width = min(len(w) - kk + 1, len(all_s))
            for s in range(len(all_s) - width + 1):
                x = Counter(all_s[s:s + width])
                v = sum((x & bag).values()) / sum((x | bag).values())
                if v >= threshold - 1e-12:
                    out[d, i] = max(out.get((d, i), 0), round(v, 9))
    return out


def test_query_equals_brute_force(spark, sf):
    docs = [(r.doc_id, r.text) for r in C.table(spark, sf, "documents").collect()]
    bench = [(r.item_id, r.text) for r in C.table(spark, sf, "benchmark").collect()]
    want = brute(docs, bench)
    got = {(r.doc_id, r.item_id): round(r.similarity, 9) for r in Q.op2_decontaminate(spark, sf).collect()}
    assert want and got == want


def test_edited_passages_and_edges(spark, sf, monkeypatch):
    rng = random.Random(6)
    bench = [(r.item_id, r.text) for r in C.table(spark, sf, "benchmark").collect()]
    vocab = [w for _, t in bench for w in words(t)]
    noise = lambda n: [rng.choice(vocab) + str(rng.randrange(99)) for _ in range(n)]
    docs = []
    for d in range(120):
        w = words(bench[d % len(bench)][1])
        for _ in range(d % 3):
            w[rng.randrange(len(w))] = "changed"
        docs.append((d, "  ".join(noise(rng.randrange(40)) + w[rng.randrange(3):] + noise(rng.randrange(40))).upper()))
    bench += [(900, "two words"), (901, ""), (902, None), (903, "Solo")]
    docs += [(500, None), (501, ""), (None, bench[0][1]), (502, "say TWO  words now"), (503, " ".join(noise(20_000) + ["solo"])), (504, bench[1][1]), (504, bench[1][1])]
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in docs], "doc_id long, text string, item_id int, n_words string")
    bf = spark.createDataFrame(bench, "item_id long, text string")
    want = brute(docs, bench)
    for limit in (500_000, 300):
        monkeypatch.setattr(D, "BENCH_WORDS", limit)
        got = D.find_leaks(df, bf)
        assert {(r.doc_id, r.item_id): round(r.similarity, 9) for r in got.collect()} == want
        kept = D.drop_leaks(df, bf).collect()
        hit = {(d, t) for d, t in docs if any(k[0] == d for k in want)}
        assert sorted(((r.doc_id, r.text) for r in kept), key=str) == sorted((x for x in docs if x not in hit), key=str)
    assert D.find_leaks(df.limit(0), bf).count() == 0 and D.find_leaks(df, bf.limit(0)).count() == 0
    assert D.drop_leaks(df, bf.limit(0)).count() == len(docs)


def test_index_finds_all_within_radius():
    rng = np.random.default_rng(1)
    items = rng.integers(0, 1 << 63, 70).astype(np.uint64)
    flips = np.array([np.bitwise_xor.reduce(np.uint64(1) << rng.choice(64, rng.integers(0, 30), replace=False).astype(np.uint64), initial=np.uint64(0)) for _ in range(400)])
    q = items[rng.integers(0, 70, 400)] ^ flips
    i, j = D.HammingIndex(items).find(q)
    want = {(a, b) for a in range(400) for b in range(70) if int(q[a] ^ items[b]).bit_count() <= D.RADIUS}
    assert set(zip(i.tolist(), j.tolist())) == want


def test_small_regions_and_batches_change_nothing(spark, sf, monkeypatch):
    bench = [(r.item_id, r.text) for r in C.table(spark, sf, "benchmark").collect()]
    rng = random.Random(8)
    dense = " ".join(t for _ in range(6) for _, t in rng.sample(bench, len(bench)))  # a long text that is all hits
    m = D.Matcher([t for _, t in bench], 5, 0.8, D.RADIUS)
    import pyarrow as pa

    want = m.find(pa.chunked_array([pa.array([dense, bench[3][1]])]))
    monkeypatch.setattr(D, "REGION", 40)
    monkeypatch.setattr(D, "PAIRS", 100)
    assert len(want) == len(bench) + 1 and m.find(pa.chunked_array([pa.array([dense, bench[3][1]])])) == want


def test_index_finds_all_and_rejects():
    rng = np.random.default_rng(1)
    fps = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    q = np.concatenate([rng.integers(0, 1 << 63, 2000, dtype=np.uint64), fps ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (20, 300)).astype(np.uint64))])
    index = D.HammingIndex(fps)
    i, j = index.find(q)
    close = np.bitwise_count(q[:, None] ^ fps[None]) <= D.RADIUS
    assert set(zip(i.tolist(), j.tolist())) == set(zip(*(x.tolist() for x in np.nonzero(close))))
    hit = np.bitwise_or.reduce([t[p] for t, p in zip(index.table, index._parts(q[:2000]).T)])
    assert np.unpackbits(hit, axis=1, count=300).mean() < 0.25
