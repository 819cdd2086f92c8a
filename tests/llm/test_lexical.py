import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from lattica.llm import common as C
from lattica.llm import lexical as L

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def cut(t):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def brute(docs, items, k=20):
    bags = [(d, Counter(cut(t))) for d, t in docs]
    n_docs, total = sum(bool(c) for _, c in bags), sum(sum(c.values()) for _, c in bags)
    df = Counter(t for _, c in bags for t in c)
    out = []
    for item, text in sorted(set(items), key=str):
        found = []
        for d, c in bags:
            n = sum(c.values())
            s = 0
            for t in cut(text):
                if c[t]:
                    m = 75 + 25 * n * n_docs // total
                    s += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * m))
            if s > 0:
                found.append((-s, d is None, d or 0, d))
        out += [(item, r, x[3], -x[0]) for r, x in enumerate(sorted(found, key=lambda x: x[:3])[:k], 1)]
    return sorted(out, key=str)


def got(df):
    return sorted(((r.item_id, r.rank, r.doc_id, r.score) for r in df.collect()), key=str)


def test_table_equals_brute_force(spark, sf):
    docs, items = C.table(spark, sf, "documents"), C.table(spark, sf, "benchmark")
    assert got(L.rank(docs, items)) == brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])


@pytest.mark.parametrize("slice_bytes, item_bytes", [(L.SLICE_BYTES, L.ITEM_BYTES), (2000, 150)])
def test_edges(spark, monkeypatch, slice_bytes, item_bytes):
    monkeypatch.setattr(L, "SLICE_BYTES", slice_bytes)
    monkeypatch.setattr(L, "ITEM_BYTES", item_bytes)
    rng = random.Random(5)
    words = [f"w{i}" for i in range(60)] + ["été", "Öl", "日本", "A1b"]
    text = lambda n: " ".join(words[min(int(rng.expovariate(0.08)), 63)] for _ in range(n))
    docs = [(d, text(rng.randrange(1, 40))) for d in range(300)]
    docs += [(300, None), (301, ""), (302, " ,;\t"), (None, "w1 w2 w3"), (303, "w1 w2 w3"), (7, "w1 w2 w3"), (7, "w1 w2 w3"), (304, "été-ÉTÉ été"), (305, "w5 " * 30_000)]
    items = [(1, "w1 w2 w3 w3"), (2, ""), (3, None), (4, "nowhere"), (5, "ÉTÉ Été öl a1B"), (1, "w1 w2 w3 w3"), (6, text(30)), (None, "w40 w41"), (8, "w5")]
    df = spark.createDataFrame([(d, t, 1, 2.5) for d, t in docs], "doc_id long, text string, rank int, score double").repartition(5)
    q = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")
    assert got(L.rank(df, q)) == brute(docs, items)
    assert L.rank(df.limit(0), q).count() == 0 and L.rank(df, q.limit(0)).count() == 0 and L.rank(df.where("doc_id = 300"), q).count() == 0


def test_skipping_changes_nothing():
    rng = np.random.default_rng(3)
    n, terms = 400, 12
    tf = {t: (np.sort(rng.choice(n, rng.integers(1, n), replace=False)), None) for t in range(terms)}
    codes = np.arange(terms)
    at = np.concatenate([tf[t][0] for t in range(terms)])
    starts = np.r_[0, np.cumsum([len(tf[t][0]) for t in range(terms)])]
    freq = rng.integers(1, 9, len(at))
    lengths = np.bincount(at, freq, n).astype(np.int64)
    s = L.Slice(np.arange(n) * 3, lengths, codes, starts, at, freq, n, int(lengths.sum()))
    for k in (1, 7, 20):
        for _ in range(40):
            mine = np.sort(rng.choice(terms, rng.integers(1, terms), replace=False))
            w = rng.integers(0, 3000, len(mine))
            whole = np.zeros(n, np.int64)
            for c, x in zip(mine, w):
                whole[at[starts[c]:starts[c + 1]]] += x * s.part[starts[c]:starts[c + 1]]
            best = L.Best(k)
            best.add(np.array([int(np.sort(whole)[-min(k, n)])] * k), np.full(k, -1))  # the bar a full set of earlier slices may set
            s.search(mine, w, best)
            order = np.lexsort((np.arange(n), -whole))
            want = [(v, -1) for v in best.score[best.doc == -1]] + [(whole[d], d * 3) for d in order]
            want = sorted((x for x in want if x[0] > 0), key=lambda x: (-x[0], x[1]))[:k]
            assert [(a, b) for a, b in zip(best.score, best.doc) if a > 0] == want
