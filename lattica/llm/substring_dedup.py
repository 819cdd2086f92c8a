"""Substring deduplication by Rabin-Karp hashes of every window of words.

1. Every block hashes all its windows and sends distinct short hashes with counts to
   buckets; a bucket returns those that occur at least twice overall.
2. Only windows with such a hash send an independent 64-bit hash and the smallest
   document id of the block that has it; a bucket finds the smallest id overall and
   tells every block which of its windows start in an earlier document.
3. Blocks merge these windows into maximal intervals and remove their words.

A window that a third of the documents share costs one key per block, not per document.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lattica.llm import common as C

SEEDS = (0x243F6A8885A308D3, 0x13198A2E03707344)
BASES = (0x5851F42D4C957F2D, 0xD1342543DE82EF95)
"""Odd multipliers; hashes are modulo 2**64."""


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte start and end of every word and the text it belongs to."""
    space = (data == 32) | ((data >= 9) & (data <= 13))
    n = len(data)
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    prev = np.r_[True, space[:-1]] if n else space
    starts = np.flatnonzero(~space & (prev | first[:-1]))
    nxt = np.r_[space[1:], True] if n else space
    ends = np.flatnonzero(~space & (nxt | first[1:])) + 1
    doc = np.searchsorted(offsets, starts, side="right") - 1
    return starts, ends, doc


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int) -> np.ndarray:
    """Polynomial hash of each word from one prefix array, freed of its position, then mixed."""
    p = C.powers(BASES[which], len(data))
    prefix = np.r_[np.zeros(1, np.uint64), np.cumsum(C.letters(SEEDS[which])[data] * p, dtype=np.uint64)]
    inverse = C.powers(pow(BASES[which], -1, 1 << 64), len(data))
    return C.mix((prefix[ends] - prefix[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def window_hashes(h: np.ndarray, doc: np.ndarray, width: int, which: int) -> tuple[np.ndarray, np.ndarray]:
    """Start index and hash of every window of ``width`` words inside one text."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    base, acc = np.uint64(BASES[1 - which]), h[:n].copy()
    for j in range(1, width):
        acc = acc * base + h[j:j + n]
    at = np.flatnonzero(doc[:n] == doc[width - 1:])
    return at, C.mix(acc[at])


class Windows:
    """The windows of a block of documents."""

    def __init__(self, t: pa.Table, width: int, both: bool):
        self.ids = C.ids(t.column("doc_id"))
        self.data, self.offsets = C.text_bytes(t.column("text"))
        self.starts, self.ends, self.doc = word_spans(self.data, self.offsets)
        self.at, self.short = window_hashes(word_hashes(self.data, self.starts, self.ends, 0), self.doc, width, 0)
        if both:
            self.full = window_hashes(word_hashes(self.data, self.starts, self.ends, 1), self.doc, width, 1)[1]
        self.owner = self.ids[self.doc[self.at]]


def earliest_here(full: np.ndarray, bucket: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct (bucket, hash), sorted, with the smallest owner of each."""
    order = np.lexsort((owner, full, bucket))
    b, f = bucket[order], full[order]
    first = np.r_[True, (f[1:] != f[:-1]) | (b[1:] != b[:-1])] if len(f) else np.zeros(0, bool)
    return b[first], f[first], owner[order][first]


def _tell_earliest(t: pa.Table) -> pa.Table:
    """Of one bucket: the hashes of each block that an earlier document of another block has."""
    blk = t.column("blk").to_numpy()
    full = [C.unpack_sorted(x, np.uint64) for x in t.column("hashes").to_pylist()]
    own = [C.from_planes(x, np.int64) for x in t.column("owners").to_pylist()]
    row = np.repeat(np.arange(len(full)), [len(x) for x in full])
    f, o = np.concatenate(full), np.concatenate(own)
    order = np.argsort(f, kind="stable")
    s, e = C.runs(f[order])
    least = np.empty(len(f), np.int64)
    least[order] = np.repeat(np.minimum.reduceat(o[order], s), e - s)
    hit = np.flatnonzero(least < o)
    rs, re = C.runs(row[hit])
    return pa.table({"blk": pa.array(blk[row[hit][rs]], pa.int32()),
                     "bucket": pa.array(np.full(len(rs), t.column("bucket")[0].as_py(), np.int32)),
                     "hashes": pa.array([C.pack_sorted(f[hit[i:j]]) for i, j in zip(rs, re)], pa.binary())})


def kept_texts(w: Windows, gone: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words that stay, joined by one space, as bytes and offsets per document."""
    stay = ~gone
    s, ln, doc = w.starts[stay], (w.ends - w.starts)[stay], w.doc[stay]
    out_at = np.r_[0, np.cumsum(ln + 1)]
    index = np.repeat(s - out_at[:-1], ln + 1) + np.arange(out_at[-1])
    out = w.data[np.minimum(index, max(len(w.data) - 1, 0))] if len(w.data) else np.zeros(0, np.uint8)
    out[out_at[1:] - 1] = 32
    return out, out_at[np.searchsorted(doc, np.arange(len(w.ids) + 1))]


def remove_repeats(docs: DataFrame, width: int = 13, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: counts, removed word intervals, and the text that stays.

    Removes every word covered by a window of ``width`` words that also starts in a
    document with a smaller id, judged on the input.  Null text: no words.  Null ids
    come after all others; rows with equal ids are separate documents of which neither
    is earlier.  Other columns are ignored.
    """
    size = C.total_bytes(docs, text_col)
    n_blocks = max(1, -(-size // C.BLOCK_BYTES))
    n_buckets = max(1, size // 6 // C.BUCKET_KEYS)
    laid = C.blocks(docs, n_blocks, id_col, text_col)
    by_block = lambda: laid.groupBy("blk")

    def hash_all(t: pa.Table) -> pa.Table:
        return C.short_rows(Windows(t, width, False).short, t.column("blk")[0].as_py(), n_buckets)

    def hash_repeated(t: pa.Table, shared: pa.Table) -> pa.Table:
        w = Windows(t, width, True)
        hit, _ = C.lookup(w.short, n_buckets, shared)
        b, f, o = earliest_here(w.full[hit], C.bucket_of(w.short[hit], n_buckets), w.owner[hit])
        s, e = C.runs(b)
        return pa.table({"bucket": pa.array(b[s], pa.int32()), "blk": pa.array(np.full(len(s), t.column("blk")[0].as_py(), np.int32)),
                         "hashes": pa.array([C.pack_sorted(f[i:j]) for i, j in zip(s, e)], pa.binary()),
                         "owners": pa.array([C.planes(o[i:j]) for i, j in zip(s, e)], pa.binary())})

    def remove(t: pa.Table, told: pa.Table) -> pa.Table:
        w = Windows(t, width, True)
        bucket = C.bucket_of(w.short, n_buckets)
        order = np.lexsort((w.full, bucket))
        b, f, own = bucket[order], w.full[order], w.owner[order]
        gone_sorted = np.zeros(len(f), bool)
        for row, raw in zip(told.column("bucket").to_pylist(), told.column("hashes").to_pylist()):
            i, j = np.searchsorted(b, [row, row + 1])
            gone_sorted[i:j] = C.member(f[i:j], C.unpack_sorted(raw, np.uint64))
        if len(f):
            s = np.flatnonzero(np.r_[True, (f[1:] != f[:-1]) | (b[1:] != b[:-1])])
            gone_sorted |= np.repeat(np.minimum.reduceat(own, s), np.diff(np.r_[s, len(f)])) < own
        gone = C.covered(w.at[np.sort(order[gone_sorted])], width, len(w.starts))
        per = np.arange(len(w.ids) + 1)
        bounds = np.searchsorted(w.doc, per)
        lost = np.r_[0, np.cumsum(gone)]
        begins = np.flatnonzero(gone & ~(np.r_[False, gone[:-1]] & np.r_[False, w.doc[1:] == w.doc[:-1]])) if len(gone) else np.zeros(0, np.int64)
        stops = np.flatnonzero(gone & ~(np.r_[gone[1:], False] & np.r_[w.doc[1:] == w.doc[:-1], False])) + 1 if len(gone) else np.zeros(0, np.int64)
        of = np.searchsorted(w.doc[begins], per) if len(begins) else np.zeros(len(per), np.int64)
        spans = [[[int(a - bounds[d]), int(z - bounds[d])] for a, z in zip(begins[of[d]:of[d + 1]], stops[of[d]:of[d + 1]])] for d in range(len(w.ids))]
        out, off = kept_texts(w, gone)
        raw = out.tobytes()
        kept = [raw[off[d]:max(off[d], off[d + 1] - 1)] for d in range(len(w.ids))]
        return pa.table({
            "doc_id": t.column("doc_id"), "n_words": pa.array(np.diff(bounds), pa.int64()),
            "n_removed": pa.array(np.diff(lost[bounds]), pa.int64()), "spans": pa.array(spans, pa.list_(pa.list_(pa.int64()))),
            "kept": pa.array([k.decode() for k in kept], pa.string())})

    shared = C.repeated_keys(by_block().applyInArrow(hash_all, C.SHORT_SCHEMA))
    sent = by_block().cogroup(shared.groupBy("blk")).applyInArrow(hash_repeated, "bucket int, blk int, hashes binary, owners binary")
    told = sent.groupBy("bucket").applyInArrow(_tell_earliest, "blk int, bucket int, hashes binary")
    return by_block().cogroup(told.groupBy("blk")).applyInArrow(
        remove, "doc_id bigint, n_words bigint, n_removed bigint, spans array<array<bigint>>, kept string")
