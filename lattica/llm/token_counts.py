"""Token counts without token ids: pieces are counted once per distinct pre-token.

Tasks cut texts into pre-tokens and pack, per run of documents and bucket of the
vocabulary, the distinct pre-tokens and which documents hold how many of each.  A
bucket counts the pieces of its distinct pre-tokens, joins them to these frequencies
and returns partial sums per document, which meet again by run.  A frequent pre-token
is one entry per run; buckets are salted by run once there are many runs.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm import common as C

PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
"""Fixed value: how the byte-level vocabularies split text before merging."""
RUN_BYTES = 4 << 20
GROUP_BYTES = 16 << 20
SALT_RUNS = 4096
_PART = "run bigint, part bigint, heads array<bigint>, sizes array<bigint>, vocab array<string>, entries binary, docs binary, counts binary"


def _splitter(specials: list[str]):
    import regex

    find = regex.compile(PATTERN).findall
    if not specials:
        return find
    cut = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(specials, key=len, reverse=True)) + ")")

    def split(text: str) -> list[str]:
        if not any(s in text for s in specials):
            return find(text)
        return [p for k, x in enumerate(cut.split(text)) for p in ([x] if k % 2 else find(x))]
    return split


def _runs(batches: Iterator[pa.RecordBatch], budget: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if not b.num_rows:
            continue
        ends = np.cumsum(b.column("n").to_numpy(zero_copy_only=False)) // budget
        cuts = [0, *(np.flatnonzero(np.diff(ends)) + 1).tolist(), b.num_rows]
        for i, j in zip(cuts, cuts[1:]):
            yield b.slice(i, j - i)


def count_tokens(docs: DataFrame, tokenizer_json: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens) of every row, as the library counts ``tokenizer_json``.

    The vocabulary must be byte-level BPE with the usual splitting pattern and no
    normaliser.  Special strings inside texts are one token each.  Null and empty texts
    have no tokens; every row is counted on its own, whatever its id.  Rows should come
    from files or another source that repeats its order when a task is run again.
    """
    spec = json.loads(tokenizer_json)
    pre = spec.get("pre_tokenizer") or {}
    if spec.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
        raise ValueError("byte-level BPE without normaliser or prefix space is expected")
    specials = [t["content"] for t in spec.get("added_tokens", [])]
    if any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in spec.get("added_tokens", [])):
        raise ValueError("added tokens that strip or look at neighbours are not supported")
    spark = docs.sparkSession
    size = C.total_bytes(docs, text_col)
    n_salt = -(-max(1, size // RUN_BYTES) // SALT_RUNS)
    n_buckets = max(1, size // GROUP_BYTES // n_salt)
    shipped = spark.sparkContext.broadcast(tokenizer_json)  # a fixed file of a few MB

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = _splitter(specials)
        serial = TaskContext.get().partitionId() << 32
        for b in _runs(batches, RUN_BYTES):
            lists = [split(t) for t in b.column("text").to_pylist()]
            lens = np.array([len(x) for x in lists])
            coded = pa.array([t for x in lists for t in x], pa.string()).dictionary_encode()
            lists = None
            vocab, index = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
            pair, count = np.unique(index * len(lens) + np.repeat(np.arange(len(lens)), lens), return_counts=True)
            entry, doc = pair // max(len(lens), 1), pair % max(len(lens), 1)
            hashed = pd.util.hash_array(vocab.to_numpy(zero_copy_only=False), categorize=False) if len(vocab) else np.zeros(0, np.uint64)
            bucket = (hashed % np.uint64(n_buckets)).astype(np.int64)
            salt = serial % n_salt
            rows = {"run": [serial], "part": [-1 - serial % n_buckets], "heads": [b.column("doc_id").to_pylist()], "sizes": [b.column("n").to_pylist()],
                    "vocab": [[]], "entries": [b""], "docs": [b""], "counts": [b""]}
            order = np.argsort(bucket, kind="stable")
            place = np.empty(len(order), np.int64)
            s, e = C.runs(bucket[order])
            for i, j in zip(s, e):
                place[order[i:j]] = np.arange(j - i)
            of = bucket[entry]
            by = np.argsort(of, kind="stable")
            ps, pe = C.runs(of[by])
            for (i, j), (p, q) in zip(zip(s, e), zip(ps, pe)):
                mine = by[p:q]
                rows["run"].append(serial)
                rows["part"].append(int(bucket[order[i]]) * n_salt + salt)
                rows["heads"].append(None)
                rows["sizes"].append(None)
                rows["vocab"].append(vocab.take(pa.array(order[i:j])))
                rows["entries"].append(C.pack_sorted(place[entry[mine]].astype(np.uint32)))
                rows["docs"].append(C.planes(doc[mine].astype(np.uint32)))
                rows["counts"].append(C.planes(count[mine].astype(np.uint32)))
            serial += 1
            yield pa.record_batch({
                "run": pa.array(rows["run"], pa.int64()), "part": pa.array(rows["part"], pa.int64()),
                "heads": pa.array(rows["heads"], pa.list_(pa.int64())), "sizes": pa.array(rows["sizes"], pa.list_(pa.int64())),
                "vocab": pa.ListArray.from_arrays(np.r_[0, np.cumsum([len(v) for v in rows["vocab"]])].astype(np.int32),
                                                  pa.concat_arrays([v if isinstance(v, pa.Array) else pa.array(v, pa.string()) for v in rows["vocab"]])),
                **{k: pa.array(rows[k], pa.binary()) for k in ("entries", "docs", "counts")}})

    def pieces(t: pa.Table) -> pa.Table:
        if t.column("part")[0].as_py() < 0:
            return t.select(["run", "heads", "sizes"]).append_column("docs", pa.array([b""] * t.num_rows, pa.binary())).append_column(
                "sums", pa.array([b""] * t.num_rows, pa.binary()))
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tok = Tokenizer.from_str(shipped.value)
        vocab = t.column("vocab").combine_chunks()
        vocab = pa.concat_arrays(vocab.chunks) if isinstance(vocab, pa.ChunkedArray) else vocab
        coded = vocab.flatten().dictionary_encode()
        own = coded.dictionary.to_pylist()
        n = np.array([len(x) for i in range(0, len(own), 20_000) for x in tok.encode_batch_fast(own[i:i + 20_000], add_special_tokens=False)], np.int64)
        index, off = coded.indices.to_numpy(), np.r_[0, np.cumsum(vocab.value_lengths().to_numpy())]
        docs_out, sums = [], []
        for k, (e, d, c) in enumerate(zip(*(t.column(x).to_pylist() for x in ("entries", "docs", "counts")))):
            entry = C.unpack_sorted(e, np.uint32)
            doc = C.from_planes(d, np.uint32)
            total = np.bincount(doc, n[index[off[k]:off[k + 1]][entry]] * C.from_planes(c, np.uint32)).astype(np.uint64)
            at = np.flatnonzero(total)
            docs_out.append(C.pack_sorted(at.astype(np.uint32)))
            sums.append(C.planes(total[at]))
        return pa.table({"run": t.column("run"), "heads": t.column("heads"), "sizes": t.column("sizes"),
                         "docs": pa.array(docs_out, pa.binary()), "sums": pa.array(sums, pa.binary())})

    def gather(t: pa.Table) -> pa.Table:
        rows = t.to_pylist()
        head = next(r for r in rows if r["heads"] is not None)
        total = np.zeros(len(head["heads"]), np.int64)
        for r in rows:
            if r["heads"] is None:
                total[C.unpack_sorted(r["docs"], np.uint32)] += C.from_planes(r["sums"], np.uint64).astype(np.int64)
        return pa.table({"doc_id": pa.array(head["heads"], pa.int64()), "n_bytes": pa.array(head["sizes"], pa.int64()), "n_tokens": pa.array(total)})

    text = F.coalesce(F.col(text_col), F.lit(""))
    src = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text.alias("text"), F.octet_length(text).cast("bigint").alias("n"))
    packed = src.mapInArrow(cut, _PART)
    summed = packed.groupBy("part").applyInArrow(pieces, "run bigint, heads array<bigint>, sizes array<bigint>, docs binary, sums binary")
    return summed.groupBy("run").applyInArrow(gather, "doc_id bigint, n_bytes bigint, n_tokens bigint")
