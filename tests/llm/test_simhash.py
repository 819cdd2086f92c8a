import random
import re

import xxhash

from lattica.llm import common as C
from lattica.llm import graph
from lattica.llm import queries as Q
from lattica.llm import simhash as S

WORD = re.compile(C.WORD)


def fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(low)
    sh = [w[i:i + 3] for i in range(len(w) - 2)] if len(w) >= 3 else ([w] if w else [])
    hs = [xxhash.xxh64_intdigest(" ".join(x).encode(), 42) for x in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def classes(ids, fps):
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i
    for i in range(len(ids)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 2:
                root[find(i)] = find(j)
    least = {}
    for i in range(len(ids)):
        if ids[i] is not None:
            least[find(i)] = min(least.get(find(i), ids[i]), ids[i])
    return [least.get(find(i)) for i in range(len(ids))]


def brute(rows):
    fps = [fingerprint(t) for _, t in rows]
    comp = classes([d for d, _ in rows], fps)
    return sorted(((d, f"{f:016x}", c) for (d, _), f, c in zip(rows, fps, comp)), key=str)


def test_query_equals_brute_force(spark, sf):
    rows = [(r.doc_id, r.text) for r in C.table(spark, sf, "documents").collect()]
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in Q.op8_simhash_dedup(spark, sf).collect()), key=str)
    assert got == brute(rows)


def test_edges(spark):
    rows = [(4, None), (None, ""), (2, " \t"), (9, "One"), (9, "ONE"), (7, "one two"), (6, "É x y z " * 40), (5, "É x y z " * 40 + "q"), (None, "lone words here now")]
    df = spark.createDataFrame([(d, t, "c", 1) for d, t in rows], "doc_id long, text string, fp string, component_id int")
    got = sorted(((r.doc_id, f"{r.fp & (1 << 64) - 1:016x}", r.component_id) for r in S.near_components(df).collect()), key=str)
    assert got == brute(rows)
    assert S.near_components(df.limit(0)).count() == 0


def test_links_of_crowded_lists(spark):
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(40)]
    fps = {b ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for b in base for _ in range(6)}
    fps |= {base[0] ^ rng.getrandbits(16) for _ in range(1500)}
    signed = lambda f: f - (1 << 64) if f >> 63 else f
    df = spark.createDataFrame([(signed(f),) for f in fps], "fp long")
    got = {(r.a & (1 << 64) - 1, r.b & (1 << 64) - 1) for r in S.near_links(df).collect()}
    fl = sorted(fps)
    want = {(a, b) for i, b in enumerate(fl) for a in fl[:i] if bin(a ^ b).count("1") <= 2}
    assert {tuple(sorted(x)) for x in got} == want and len(got) == len(want)


def test_components_of_paths_and_stars(spark):
    e = [(i, i + 1) for i in range(0, 300)] + [(1000, 1000 + i) for i in range(1, 200)] + [(5000, 5000), (7, 3)]
    got = {r.a: r.root for r in graph.components(spark.createDataFrame(e, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 301)} | {1000 + i: 1000 for i in range(1, 200)}
