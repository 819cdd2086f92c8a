import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from lattica.llm import common as C
from lattica.llm import near_dup as N
from lattica.llm.simhash import normal_words, shingle_hashes, simhash

WORD = re.compile(C.WORD)


def shingles(t):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    w = WORD.findall(low)
    return frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def groups(rows, similarity=0.8):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i
    post, first = defaultdict(list), {}
    for i, s in enumerate(sets):
        root[find(i)] = find(first.setdefault(tuple(WORD.findall((rows[i][1] or "").lower())), i))
        for x in s:
            post[x].append(i)
    pairs = Counter((i, j) for ix in post.values() for k, i in enumerate(ix) for j in ix[:k])
    for (i, j), k in pairs.items():
        if k / (len(sets[i]) + len(sets[j]) - k) >= similarity:
            root[find(i)] = find(j)
    out = defaultdict(list)
    for i in range(len(rows)):
        out[find(i)].append(i)
    return list(out.values())


def staying(rows):
    key = lambda i: (rows[i][0] is None, rows[i][0] or 0)
    return sorted((rows[min(g, key=key)] for g in groups(rows)), key=str)


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.01"])
def test_whole_table_equals_brute_force(spark, folder):
    docs = C.table(spark, f"/root/testdata/{folder}", "documents").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    got = sorted(map(tuple, N.drop_near_duplicates(docs).collect()), key=str)
    want = staying(rows)
    assert len(set(got) - set(want)) <= 1 and len(want) < len(rows)  # a pair at the threshold may be missed
    assert not set(want) - set(got)


def test_crowded_group_and_edges(spark, monkeypatch):
    rng = random.Random(9)
    base = ["".join(rng.choice("abcdefg") for _ in range(6)) for _ in range(300)]
    rows = []
    for d in range(900):
        w = list(base)
        for _ in range(rng.randrange(0, 5)):
            w[rng.randrange(len(w))] = f"x{d}"
        rows.append((d, " ".join(w)))
    rows += [(1000 + d, " ".join("".join(rng.choice("hijklmn") for _ in range(5)) for _ in range(60))) for d in range(200)]
    rows += [(2000, None), (2001, ""), (None, " \t"), (None, "only null ids"), (None, "ONLY null  ids"), (2002, "twice"), (2002, "twice"), (2003, "Twice")]
    df = spark.createDataFrame([(d, t, 1, "k") for d, t in rows], "doc_id long, text string, node int, mark string")
    want = staying(rows)
    for limit in (8192, 50):
        monkeypatch.setattr(N, "LIST_ROWS", limit)
        out = N.drop_near_duplicates(df)
        assert out.columns == df.columns
        got = sorted(((r.doc_id, r.text) for r in out.collect()), key=str)
        assert sorted((d, t) for d, t in got if d is not None) == sorted((d, t) for d, t in want if d is not None) and len(got) == len(want)
    assert N.drop_near_duplicates(df.limit(0)).count() == 0


def test_choices_are_even():
    for size, count in N.CHOICES.items():
        c = N.choices(size, count)
        assert c.shape == (count, size) and all(len(set(r.tolist())) == size for r in c)
        used = Counter(c.reshape(-1).tolist())
        assert len(used) == 64 and max(used.values()) <= 2 * min(used.values())


def boilerplate(n, pairs, shared=150, own=50):
    """Texts that share most of their words but no near copies, and pairs (d, 100000 + d) at similarity 0.82 to 0.86."""
    rng = random.Random(17)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(7))
    common = [word() for _ in range(shared)]
    rows = []
    for d in range(n):
        w = common + [word() for _ in range(own)]
        rows.append((d, " ".join(w)))
        if d < pairs:
            for at in rng.sample(range(0, len(w) - 5, 6), 4):
                w[at] = word()
            rows.append((100_000 + d, " ".join(w)))
    return rows


def test_pairs_in_a_boilerplate_source(spark):
    rows = boilerplate(1500, 120)
    data, off = C.text_bytes(pa.chunked_array([pa.array([t for _, t in rows])]))
    fps = simhash(*N._distinct(*shingle_hashes(*normal_words(data, off), 5)), len(rows), N.WORDS).view(np.uint8)
    at = {d: i for i, (d, _) in enumerate(rows)}
    same = [fps[at[d]] == fps[at[100_000 + d]] for d in range(120)]
    meet = {100_000 + d for d, x in enumerate(same) if x[N.choices(3, N.CHOICES[3])].all(axis=1).any()}
    assert len(meet) >= 110
    left = {r.doc_id for r in N.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(range(1500)) <= left and not meet & left


@pytest.mark.parametrize("limit", [8192, 40])
def test_second_look_connects_all_near_roots(monkeypatch, limit):
    monkeypatch.setattr(N, "LIST_ROWS", limit)
    rng = np.random.default_rng(4)
    centre = rng.integers(0, 1 << 63, (2, 8), dtype=np.uint64)
    flips = np.packbits(rng.random((300, 512)) < 0.11, axis=1).view(np.uint64)
    fps = centre[np.arange(300) % 2] ^ flips
    fps[250:] = rng.integers(0, 1 << 63, (50, 8), dtype=np.uint64)
    node = np.arange(1, 301)
    root = np.where(node <= 120, 1 + (node - 1) % 2, node)
    t = pa.table({"bucket": pa.array([0], pa.int32()), "keys": [np.zeros(300, np.uint32).tobytes()], "nodes": [node.tobytes()],
                  "roots": [C.planes(node ^ root)], "counts": [C.planes(np.ones(300, np.uint32))]})
    lists = N._open_lists(t).to_pandas().sort_values("lid", kind="stable")
    at = lists.node.to_numpy() - 1
    met = pa.record_batch({"lid": pa.array(lists.lid.to_numpy()), "node": pa.array(node[at]), "fp": pa.array([fps[i].tobytes() for i in at], pa.binary()), "root": pa.array(root[at])})
    got = [(a, b) for out in N._candidates(N._stars)(iter([met.slice(0, 100), met.slice(100)])) for a, b in zip(out.column("a").to_pylist(), out.column("b").to_pylist())]
    bits = np.bitwise_count(fps[:, None] ^ fps[None]).sum(axis=2)
    want = [(root[i], root[j]) for i in range(300) for j in range(i) if bits[i, j] <= N.HAMMING and root[i] != root[j]]
    parts = lambda links: sorted(map(sorted, united(links)))
    assert want and parts(got) == parts(want)
    assert limit < 300 or len(got) <= len(set(root)) - 1  # spanning stars, not the pairs
    forest = [(a, b) for out in N._candidates(N._stars, forest=True)(iter([met])) for a, b in zip(out.column("a").to_pylist(), out.column("b").to_pylist())]
    assert parts(forest) == parts(want) and len(forest) <= len(set(root)) - 1


def united(links):
    of = {}
    for a, b in links:
        x = of.get(a, {a}) | of.get(b, {b})
        for y in x:
            of[y] = x
    return {frozenset(map(int, x)) for x in of.values()}


def crowd(n, seed=31):
    """Copies of one text of 120 words with 3 to 5 words of their own, most of which are not similar enough to each other, and unlike texts."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(7))
    base = [word() for _ in range(120)]
    rows = []
    for d in range(n):
        w = list(base)
        for at in rng.sample(range(120), rng.randrange(3, 6)):
            w[at] = word()
        rows.append((d, " ".join(w)))
    return rows + [(100_000 + d, " ".join(word() for _ in range(60))) for d in range(200)]


def test_rows_grow_with_a_crowd_of_nearly_similar_texts(spark, monkeypatch):
    monkeypatch.setattr(N, "PART_BYTES", 200_000)  # several parts
    made = []
    settle = C.settle

    def counted(df):
        out = settle(df)
        made.append(out.count())
        return out
    monkeypatch.setattr(C, "settle", counted)
    most = {}
    for n in (300, 600):
        rows = crowd(n)
        made.clear()
        got = sorted(r.doc_id for r in N.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
        want = [d for d, _ in staying(rows)]
        missed = sorted(set(got) ^ set(want))
        assert not set(want) - set(got) and len(missed) <= 0.1 * (len(rows) - len(want)) + 1, missed
        most[n] = max(made)
    assert most[600] <= 2.6 * most[300]


def test_part_pairs_find_all_links():
    rng = np.random.default_rng(6)
    sets = [np.unique(rng.choice(400, 120)) for _ in range(60)]
    sets += [np.unique(np.r_[s[:-6], rng.choice(400, 3)]) for s in sets[:40]]
    fp = np.zeros(8, np.uint64).tobytes()
    n = len(sets)
    alike = lambda a, b: len(np.intersect1d(a, b)) / len(np.union1d(a, b)) >= 0.8
    want = united([(i, j) for i in range(n) for j in range(i) if alike(sets[i], sets[j])])
    part = np.arange(n) % 3
    links = []
    for lo in range(3):
        for hi in range(lo, 3):
            at = np.flatnonzero((part == lo) | (part == hi))
            t = pa.table({"node": pa.array(at), "part": pa.array(part[at]), "hood": pa.array(np.zeros(len(at), np.int64)), "fp": pa.array([fp] * len(at), pa.binary()),
                          "s": pa.array([sets[i] for i in at], pa.list_(pa.int64()))})
            got = N._joined(0.8)(t)
            links += zip(got.column("a").to_pylist(), got.column("b").to_pylist())
    assert united(links) == want and want


def test_lines_repeated_more_often(spark):
    rng = random.Random(23)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(7))
    rows = []
    for d in range(40):
        text, line = [" ".join(word() for _ in range(k)) for k in (200, 14)]
        rows += [(d, f"{text} {line}"), (1000 + d, f"{text} {line}" + f" {line}" * (5 + 5 * (d % 4)))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert all(len(shingles(a) & shingles(b)) >= 0.9 * len(shingles(a) | shingles(b)) for (_, a), (_, b) in zip(rows[::2], rows[1::2]))
    assert sorted(r.doc_id for r in N.drop_near_duplicates(df).collect()) == list(range(40))
