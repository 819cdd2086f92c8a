"""Ranked lexical search: term-at-a-time over short lists, document-at-a-time over long ones.

First pass: texts are cut into terms and every slice of documents (some megabytes of text) keeps
the posting lists of the query terms, in document order, with term frequencies; document
frequencies and lengths are summed over all slices.

Second pass, per slice and query: the short lists are summed term at a time into accumulators,
which then count as one list with one upper bound.  That list and the long ones are gone through document
at a time: lists whose bounds together cannot reach the current k-th score propose no
documents, and are looked into only for documents that can still reach it.  The k best of a task carry
over from slice to slice, so bounds bite early.  All arithmetic is in 64-bit integers and exact.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattica.llm import common as C
from lattica.llm.simhash import text_slices

ITEM_BYTES = 4 << 20
"""Text of the queries that one pass over the documents carries along."""
SLICE_BYTES = 4 << 20
SHORT = 8
"""A list is short in a slice if it holds at most one in so many of its documents."""
SALTS = 64
TERM_BYTES = np.zeros(256, bool)
TERM_BYTES[48:58] = TERM_BYTES[65:91] = TERM_BYTES[97:123] = TERM_BYTES[128:] = True
"""Digits, letters and every byte of a character beyond ASCII."""


def terms(data: np.ndarray, off: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """All terms of the texts, A-Z lowered, and the text that each belongs to."""
    data = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    inside = TERM_BYTES[data]
    first = np.zeros(len(data) + 1, bool)
    first[off] = True
    starts = np.flatnonzero(inside & (np.r_[True, ~inside[:-1]][:len(data)] | first[:-1]))
    ends = np.flatnonzero(inside & (np.r_[~inside[1:], True][:len(data)] | first[1:])) + 1
    at = np.r_[0, np.cumsum(ends - starts)].astype(np.int64)
    packed = np.ascontiguousarray(data[inside])
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(packed)])
    return words, np.searchsorted(off, starts, side="right") - 1


def terms_of(text: str | None) -> list[bytes]:
    raw = np.frombuffer((text or "").encode(), np.uint8)
    return terms(raw, np.array([0, len(raw)]))[0].to_pylist()


SLICE = ("docs array<bigint>, lengths array<bigint>, codes binary, starts binary, at binary, freq binary, df array<bigint>, total bigint, filled bigint")
SLICE_TYPES = [pa.list_(pa.int64())] * 2 + [pa.binary()] * 4 + [pa.list_(pa.int64()), pa.int64(), pa.int64()]
SLICE_NAMES = ["docs", "lengths", "codes", "starts", "at", "freq", "df", "total", "filled"]


def _lists(vocabulary: list[bytes]):
    """Slices with their posting lists; a task's last row has its document frequencies, terms and non-empty documents."""
    size = max(1, len(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(vocabulary, pa.large_binary())
        df, total, filled = np.zeros(size, np.int64), 0, 0
        for batch in batches:
            for b in text_slices(batch, SLICE_BYTES):
                words, doc = terms(*C.text_bytes(pa.chunked_array([b.column("text")])))
                n = np.bincount(doc, minlength=b.num_rows)
                code = pc.index_in(words, value_set=known).fill_null(-1).to_numpy().astype(np.int64)
                hit = code >= 0
                # (term, document) in one number; equal ones in a row are a frequency
                both = np.sort(code[hit] * b.num_rows + doc[hit])
                s, e = C.runs(both)
                code, at = np.divmod(both[s], b.num_rows)
                t, t_end = C.runs(code)
                df[code[t]] += t_end - t
                total, filled = total + int(n.sum()), filled + int(np.count_nonzero(n))
                yield pa.record_batch([pa.array([v], k) for v, k in zip(
                    (C.ids(pa.chunked_array([b.column("doc_id")])), n, code[t].astype(np.int32).tobytes(), np.r_[t, len(code)].astype(np.int32).tobytes(),
                     at.astype(np.int32).tobytes(), (e - s).astype(np.int32).tobytes(), None, None, None), SLICE_TYPES)], names=SLICE_NAMES)
        yield pa.record_batch([pa.array([v], k) for v, k in zip((None,) * 6 + (df, total, filled), SLICE_TYPES)], names=SLICE_NAMES)
    return run


class Best:
    """The k best (score, id) so far: higher scores first, then smaller ids."""

    def __init__(self, k: int):
        self.k, self.score, self.doc = k, np.zeros(0, np.int64), np.zeros(0, np.int64)

    @property
    def least(self) -> int:
        """What a document must reach: an equal score may still win by its id."""
        return max(1, int(self.score[-1])) if len(self.score) == self.k else 1

    def add(self, score: np.ndarray, doc: np.ndarray) -> None:
        s, d = np.r_[self.score, score], np.r_[self.doc, doc]
        o = np.lexsort((d, -s))[:self.k]
        self.score, self.doc = s[o], d[o]


class Slice:
    """Posting lists of one slice with the part of a score that does not depend on the query."""

    def __init__(self, docs: np.ndarray, lengths: np.ndarray, codes: np.ndarray, starts: np.ndarray, at: np.ndarray, freq: np.ndarray, n_docs: int, n_terms: int):
        self.docs, self.codes, self.starts, self.at = docs, codes, starts, at.astype(np.int64)
        m = 100 - 25 + (25 * lengths * n_docs) // max(1, n_terms)
        f = freq.astype(np.int64)
        self.part = (1_000_000_000 * f) // (1000 * f + 12 * m[self.at]) if len(f) else f
        self.top = np.maximum.reduceat(self.part, starts[:-1]) if len(codes) else np.zeros(0, np.int64)

    def search(self, codes: np.ndarray, weights: np.ndarray, best: Best) -> None:
        """Add this slice's documents to the best of a query with distinct ``codes``, weighted."""
        n = len(self.docs)
        i = np.searchsorted(self.codes, codes)
        there = (i < len(self.codes)) & (self.codes[np.minimum(i, len(self.codes) - 1)] == codes) & (weights > 0) if len(self.codes) else np.zeros(len(codes), bool)
        i, w = i[there], weights[there]
        if not len(i) or int((w * self.top[i]).sum()) < best.least:
            return
        lo, hi = self.starts[i], self.starts[i + 1]
        short = (hi - lo) * SHORT <= n
        lists = []  # (bound, documents, scores)
        if short.any():
            sums = np.zeros(n, np.int64)
            for a, b, x in zip(lo[short], hi[short], w[short]):
                sums[self.at[a:b]] += x * self.part[a:b]
            hit = np.flatnonzero(sums)
            if len(hit):
                lists.append((int(sums[hit].max()), hit, sums[hit]))
        for a, b, x, t in zip(lo[~short], hi[~short], w[~short], self.top[i[~short]]):
            lists.append((int(x * t), self.at[a:b], x * self.part[a:b]))
        lists.sort(key=lambda x: x[0])
        reach = np.cumsum([x[0] for x in lists])  # what the lists up to each can add together
        need = best.least
        # lists below cannot carry a document into the best by themselves
        first = int(np.searchsorted(reach, need, "left"))
        if first == len(lists):
            return
        score, proposed = np.zeros(n, np.int64), np.zeros(n, bool)
        for _, d, s in lists[first:]:
            score[d] += s
            proposed[d] = True
        d = np.flatnonzero(proposed)
        for k in range(first - 1, -1, -1):
            d = d[score[d] + reach[k] >= need]
            if not len(d):
                return
            _, of, s = lists[k]
            p = np.minimum(np.searchsorted(of, d), len(of) - 1)  # skip to each document that is still open
            hit = of[p] == d
            score[d[hit]] += s[p[hit]]
        d = d[score[d] >= need]
        if len(d):
            best.add(score[d], self.docs[d])


def _score(queries: list[tuple[int, np.ndarray, np.ndarray]], n_docs: int, n_terms: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {i: Best(k) for i, _, _ in queries}
        for b in batches:
            for r in range(b.num_rows):
                raw = [np.frombuffer(b.column(c)[r].as_py(), np.int32) for c in ("codes", "starts", "at", "freq")]
                docs, lengths = (b.column(c)[r].values.to_numpy() for c in ("docs", "lengths"))
                s = Slice(docs, lengths, *raw, n_docs, n_terms)
                for i, codes, weights in queries:
                    s.search(codes, weights, best[i])
        full = [(i, x) for i, x in best.items() if len(x.score)]
        if full:
            yield pa.record_batch([pa.array(np.concatenate([np.full(len(x.score), i) for i, x in full]), pa.int64()),
                                   pa.array(np.concatenate([x.doc for _, x in full])), pa.array(np.concatenate([x.score for _, x in full]))],
                                  names=["item", "doc_id", "score"])
    return run


def _item_blocks(items: DataFrame, id_col: str, text_col: str) -> Iterator[list]:
    """Distinct items in blocks of about ITEM_BYTES of text."""
    rows = items.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).distinct()
    n = max(1, -(-C.total_bytes(rows) // ITEM_BYTES))
    for b in range(n):
        yield rows.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == b).orderBy("id", "text").collect()


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def rank(docs: DataFrame, items: DataFrame, k: int = 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` documents of highest score above 0 for each item, ties by smaller id.

    Null and empty texts have no terms: such documents are not counted and such items find nothing.
    Documents of the same id are ranked each for itself, null ids last among equals; equal rows of
    items count once.  Of all documents only the lists of the items' terms are kept; items beyond
    ITEM_BYTES take further passes.
    """
    src = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).where("text is not null")
    out = None
    for block in _item_blocks(items, item_col, item_text):
        counts = [Counter(terms_of(r.text)) for r in block]
        vocabulary = sorted({t for c in counts for t in c})
        code = {t: i for i, t in enumerate(vocabulary)}
        slices = C.settle(src.mapInArrow(_lists(vocabulary), SLICE))
        sums = slices.where("df is not null").select("total", "filled", "df")
        n_terms, n_docs = (int(x or 0) for x in sums.agg(F.sum("total"), F.sum("filled")).first())
        df = {r.pos: r.n for r in sums.select(F.posexplode("df")).groupBy("pos").agg(F.sum("col").alias("n")).collect()}
        queries = []
        for i, c in enumerate(counts):
            own = sorted(code[t] for t in c)
            queries.append((i, np.array(own, np.int64), np.array([c[vocabulary[t]] * weight(n_docs, df.get(t, 0)) for t in own], np.int64)))
        found = slices.where("df is null").mapInArrow(_score(queries, n_docs, n_terms, k), "item bigint, doc_id bigint, score bigint")
        best = [F.col("score").desc(), F.col("doc_id")]
        part = found.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
        for by in (["item", "salt"], ["item"]):
            part = part.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*best))).where(F.col("rank") <= k)
        names = docs.sparkSession.createDataFrame([(i, r.id) for i, r in enumerate(block)], "item bigint, item_id bigint")
        part = part.join(F.broadcast(names), "item").select("item_id", "rank", F.when(F.col("doc_id") != C.NO_ID, F.col("doc_id")).alias("doc_id"), "score")
        out = part if out is None else out.unionByName(part)
    return out
