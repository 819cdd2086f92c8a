from pathlib import Path

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lattica.llm import common as C
from lattica.llm import queries as Q
from lattica.llm import token_counts as T

PATH = public_tokenizers.path("byte_bpe_50k.json")


def expected(rows):
    tok = Tokenizer.from_file(PATH)
    return sorted(((d, len((t or "").encode()), len(tok.encode(t or "", add_special_tokens=False).ids)) for d, t in rows), key=str)


def test_query_equals_library(spark, sf):
    rows = [(r.doc_id, r.text) for r in C.table(spark, sf, "documents").collect()]
    got = sorted(((r.doc_id, r.n_bytes, r.n_tokens) for r in Q.op4_token_counts(spark, sf).collect()), key=str)
    assert got == expected(rows)
    assert all(r.over_limit == (r.n_tokens > 512) for r in Q.op4_token_counts(spark, sf).collect())


@pytest.mark.parametrize("small", [False, True])
def test_edges(spark, monkeypatch, small):
    if small:
        monkeypatch.setattr(T, "RUN_BYTES", 64)
        monkeypatch.setattr(T, "GROUP_BYTES", 128)
        monkeypatch.setattr(T, "SALT_RUNS", 2)
    odd = ["", None, " ", "   a  b\n\n\n c", "it's we'll ''s 's", "x<|endoftext|>y <|endoftext|>", "<|endoftext|>", "<|endoftext", "é à ñ 日本語 🙂🙂   x",
           "12 345,678.9 --- ***", "\x00\x01 ퟿", "a" * 5000, "the " * 3000, "\t\r\n  \t", "ẞ ǅ ٣٤ ½ Ⅷ"]
    rows = [(i if i % 5 else None, t) for i, t in enumerate(odd)] + [(3, "again"), (3, "again")]
    df = spark.createDataFrame([(d, t, 7, "z") for d, t in rows], "doc_id long, text string, n long, part string")
    spec = Path(PATH).read_text(encoding="utf-8")
    got = sorted(map(tuple, T.count_tokens(df, spec).collect()), key=str)
    assert got == expected(rows)
    assert T.count_tokens(df.limit(0), spec).count() == 0
