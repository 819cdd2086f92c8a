import hashlib
import random
from collections.abc import Iterator

import pyarrow as pa
import pytest

from lattica.llm import common as C
from lattica.llm import fingerprint as P
from lattica.llm import queries as Q


def edits(rows):
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    out = []
    for k, (d, t) in enumerate(order):
        t, nxt = t or "", order[(k + 1) % len(order)][1] or ""
        m = len(t) // 3
        out.append((d, len(t), hashlib.sha256((t[:len(t) - m] + nxt[:m]).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("part", [8 << 20, 30_000])
def test_query_equals_brute_force(spark, sf, monkeypatch, part):
    monkeypatch.setattr(P, "PART_BYTES", part)
    rows = [(r.doc_id, r.text) for r in C.table(spark, sf, "documents").collect()]
    got = Q.op5_fingerprints(spark, sf).collect()
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in got), key=str) == edits(rows)
    text = dict(rows)
    prints = {}
    for r in got:
        prints.setdefault(text[r.doc_id], set()).add(r.fingerprint)
        fp = P.Fingerprint(P.Prefix(text[r.doc_id] or ""))
        assert str(fp) == r.fingerprint and str(P.Fingerprint.parse(r.fingerprint)) == r.fingerprint
        assert P.Fingerprint.parse(r.fingerprint).likeness(P.Fingerprint.parse(r.edited_fingerprint)) == r.near_edited
    assert all(len(s) == 1 for s in prints.values()) and len(set().union(*prints.values())) == len(prints)
    long = [r for r in got if r.n_chars > 200]
    assert sum(0.6 <= r.near_edited <= 0.75 for r in long) > 0.9 * len(long)
    assert sum(r.near_next < 0.2 for r in long) > 0.9 * len(long)


def test_edges(spark):
    rows = [(5, "abcdef"), (None, "null id"), (None, "null id 2"), (4, None), (3, ""), (3, "xyz"), (3, "xyz"), (2, "é🙂" * 50), (-7, "q" * 100_000), (2**62, "z")]
    df = spark.createDataFrame([(d, t, 1, "y") for d, t in rows], "doc_id long, text string, part int, carry string")
    got = P.with_next(df).collect()
    assert sorted(((r.doc_id, r.n_chars, hashlib.sha256(r.edited_text.encode()).hexdigest()) for r in got), key=str) == edits(rows)
    assert P.with_next(df.limit(0)).count() == 0
    one = P.with_next(df.limit(1)).collect()
    assert len(one) == 1 and one[0].near_next == 1.0


def test_a_batch_holds_one_part(spark, monkeypatch):
    names = P._OUT

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.record_batch([pa.array([len(set(b.column("part").to_pylist()))], pa.int64()), pa.array([b.num_rows], pa.int64())] + [
                pa.array(["" if k < 3 else 0.0]) for k in range(5)], names=names)

    monkeypatch.setattr(P, "PART_BYTES", 10_000)
    monkeypatch.setattr(P, "_compare", probe)
    df = spark.range(2000).selectExpr("id as doc_id", "repeat(string(id % 10), 100) as text")
    got = P.with_next(df).collect()
    assert {r.doc_id for r in got} == {1} and len(got) > 10 and max(r.n_chars for r in got) < 250
    assert sum(r.n_chars for r in got) == 2000 + len(got)  # with the row that follows each part


def test_results_leave_while_a_batch_is_read():
    rng = random.Random(6)
    texts = ["".join(rng.choice("abcdé ") for _ in range(3000)) for _ in range(600)]
    n = len(texts)
    rows = pa.record_batch([pa.array([1] * n, pa.int32()), pa.array([0] * (n - 1) + [1], pa.int32()), pa.array(range(n, 0, -1), pa.int64()), pa.array(texts)],
                           names=["part", "carry", "doc_id", "text"])
    got = list(P._compare(iter([rows])))
    assert [d for b in got for d in b.column("doc_id").to_pylist()] == list(range(n, 1, -1))
    assert len(got) > 1 and all(b.nbytes < 2 << 20 for b in got)


def test_spans_and_extensions():
    rng = random.Random(2)
    for _ in range(60):
        a, b = ("".join(rng.choice("abé") for _ in range(rng.randrange(1, 80))) for _ in range(2))
        p, q = P.Prefix(a), P.Prefix(b)
        i, j = rng.randrange(len(a)), rng.randrange(len(b))
        want = next((k for k in range(min(len(a) - i, len(b) - j)) if a[i + k] != b[j + k]), min(len(a) - i, len(b) - j))
        assert p.extension(i, q, j) == want
        keep, m = rng.randrange(len(a) + 1), rng.randrange(len(b) + 1)
        assert str(P.Fingerprint(p.joined(keep, q, m))) == str(P.Fingerprint(P.Prefix(a[:keep] + b[:m])))


def test_scattered_edits_stay_alike():
    rng = random.Random(4)
    text = "".join(rng.choice("abcdefgh ijk") for _ in range(3000))
    near = text[:100] + "Z" + text[101:2900] + "Q" + text[2901:]
    a, b = P.Fingerprint(P.Prefix(text)), P.Fingerprint(P.Prefix(near))
    assert 0.9 < a.likeness(b) < 1 and P.Fingerprint.parse(str(a)).likeness(P.Fingerprint.parse(str(b))) == a.likeness(b) == b.likeness(a)
    moved = P.Fingerprint(P.Prefix(text[1500:] + text[:1500]))
    assert a.likeness(moved) > 0.9
    other = P.Fingerprint(P.Prefix("".join(rng.choice("abcdefgh ijk") for _ in range(3000))))
    assert a.likeness(other) < 0.05
    assert len(P.Fingerprint(P.Prefix("ab" * 50_000)).at) < 2 * P.GRID and len(P.Fingerprint(P.Prefix(text * 30)).at) <= 2 * P.GRID + 1
    longer = P.Fingerprint(P.Prefix(text + "".join(rng.choice("xyz ") for _ in range(9000))))
    assert 0.2 <= a.likeness(longer) <= 0.3  # other sampling levels, a quarter in common


def test_near_copies_of_the_table_score_high(spark):
    rows = {r.doc_id: r.text or "" for r in C.table(spark, "/root/testdata/sf0.01", "documents").collect()}
    sets = {}
    for d, t in rows.items():
        w = t.lower().split()
        sets[d] = {tuple(w[i:i + 5]) for i in range(len(w) - 4)}
    post = {}
    for d, s in sets.items():
        for x in s:
            post.setdefault(x, []).append(d)
    pairs = {(a, b) for ds in post.values() if len(ds) < 60 for i, b in enumerate(ds) for a in ds[:i]}
    near = [(a, b) for a, b in pairs if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) and rows[a].split()[:3] == rows[b].split()[:3]]
    prints = {d: P.Fingerprint(P.Prefix(rows[d])) for p in near for d in p}
    assert near and all(prints[a].likeness(prints[b]) > 0.5 for a, b in near)
