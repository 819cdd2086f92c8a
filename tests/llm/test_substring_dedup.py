import hashlib
import re

import pytest

from lattica.llm import common as C
from lattica.llm import queries as Q
from lattica.llm import substring_dedup as S

WORD = re.compile(C.WORD)


def brute(rows, width):
    first = {}
    key = lambda d: C.NO_ID if d is None else d
    ws = [(d, WORD.findall(t or "")) for d, t in rows]
    for d, w in ws:
        for i in range(len(w) - width + 1):
            k = tuple(w[i:i + width])
            first[k] = min(first.get(k, C.NO_ID + 1), key(d))
    out = []
    for d, w in ws:
        gone = set()
        for i in range(len(w) - width + 1):
            if first[tuple(w[i:i + width])] < key(d):
                gone.update(range(i, i + width))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [2 << 20, 40_000])
def test_query_equals_brute_force(spark, sf, monkeypatch, block):
    monkeypatch.setattr(C, "BLOCK_BYTES", block)
    monkeypatch.setattr(C, "BUCKET_KEYS", block // 40)
    rows = [(r.doc_id, r.text) for r in C.table(spark, sf, "documents").collect()]
    got = sorted(map(tuple, Q.op1_substring_dedup(spark, sf).collect()), key=str)
    assert got == brute(rows, 13)


def test_edges(spark):
    run = " ".join(f"w{i}" for i in range(20))
    rows = [(5, run), (None, run), (3, "a  b\t" + run + "\nz"), (3, run), (9, None), (8, ""), (7, " x " * 30), (6, "é " + run[:30])]
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, blk int, n_words string")
    out = S.remove_repeats(df, 4)
    got = sorted(((r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest()) for r in out.collect()), key=str)
    assert got == brute(rows, 4)
    spans = {(r.doc_id, r.n_words): r.spans for r in out.collect()}
    assert spans[(5, 20)] == [[0, 20]] and spans[(8, 0)] == []
    assert S.remove_repeats(df.limit(0)).count() == 0
