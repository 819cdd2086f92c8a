"""Benchmark decontamination by SimHash over windows of each item's size.

Every text's windows are fingerprinted at every item size.  A multi-index over the items'
fingerprints, four blocks of sixteen bits with a share of the radius each, returns all items
within the radius for certain; similarity of the bags of word shingles decides exactly.  Windows
without a single benchmark shingle have similarity zero and are passed over.  Nothing is
shuffled: the benchmark travels to the texts in blocks of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm import common as C
from lattica.llm.simhash import normal_words, text_slices
from lattica.llm.substring_dedup import window_hashes, word_hashes

BENCH_WORDS = 100_000
"""Words of the benchmark that one pass over the texts carries along."""
RADIUS = 20
"""Of 64 bits; a similarity of 0.8 differs in about ten, give or take three."""
BLOCKS = 4
WIDTH = 16
PAIRS = 1 << 22
"""Windows times items that are looked up at once."""
REGION = 1 << 13
"""Shingles of a text that are summed at once, besides the longest window."""


class HammingIndex:
    """All of a set of 64-bit fingerprints within a radius, by blocks of sixteen bits.

    Blocks have shares of their own that add up to ``radius - BLOCKS + 1``: were every block's distance
    over its share, they would add up to more than the radius.  Per block and value, a table has the items
    within the share.
    """

    def __init__(self, fps: np.ndarray, radius: int = RADIUS):
        self.fps, self.radius = fps, radius
        total = radius - BLOCKS + 1
        self.shares = [total // BLOCKS + (k < total % BLOCKS) for k in range(BLOCKS)]
        values = np.arange(1 << WIDTH, dtype=np.uint16)
        self.table = []
        for part, share in zip(self._parts(fps).T, self.shares):
            rows = np.zeros((1 << WIDTH, -(-len(fps) // 8)), np.uint8)
            for i, v in enumerate(part):
                rows[np.bitwise_count(values ^ v) <= share, i >> 3] |= 128 >> (i & 7)
            self.table.append(rows)

    @staticmethod
    def _parts(q: np.ndarray) -> np.ndarray:
        return q.astype("<u8").view(np.uint16).reshape(-1, BLOCKS)

    def find(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, item) within the radius."""
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        step = max(1, PAIRS // max(1, len(self.fps)))
        for lo in range(0, len(q), step):
            some = q[lo:lo + step]
            hit = np.bitwise_or.reduce([t[p] for t, p in zip(self.table, self._parts(some).T)])
            i, j = np.nonzero(np.unpackbits(hit, axis=1, count=len(self.fps)))
            close = np.bitwise_count(some[i] ^ self.fps[j]) <= self.radius
            found.append((lo + i[close], j[close]))
        return tuple(np.concatenate(x) for x in zip(*found))


def signed_bits(h: np.ndarray) -> np.ndarray:
    return np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.int32) * 2 - 1


def fingerprint_sums(sums: np.ndarray) -> np.ndarray:
    return np.packbits(sums > 0, axis=1, bitorder="little").view("<u8").reshape(-1)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Overlap of two bags of shingles over their union, each weighted by how often it occurs."""
    u, at = np.unique(np.r_[a, b], return_inverse=True)
    x, y = np.bincount(at[:len(a)], minlength=len(u)), np.bincount(at[len(a):], minlength=len(u))
    return float(np.minimum(x, y).sum() / np.maximum(x, y).sum())


class Matcher:
    """The items of a benchmark block, by size."""

    def __init__(self, texts: list[str], shingle: int, threshold: float, radius: int):
        self.threshold = threshold
        self.groups: dict[int, list] = {}
        data, off = C.text_bytes(pa.chunked_array([pa.array(texts, pa.string())]))
        for k in range(1, shingle + 1):
            h, bounds = _shingles(data, off, k)
            n_words = np.diff(bounds)
            mine = np.flatnonzero((np.minimum(n_words, shingle) == k) & (n_words > 0))
            if not len(mine):
                continue
            per = {int(i): h[_span(bounds, i, k)] for i in mine}
            shingles = np.unique(np.concatenate(list(per.values())))
            sizes = {}
            for n in np.unique(n_words[mine]):
                of = mine[n_words[mine] == n]
                fps = np.concatenate([fingerprint_sums(signed_bits(per[int(i)]).sum(axis=0, keepdims=True)) for i in of])
                sizes[int(n)] = (of, HammingIndex(fps, radius))
            self.groups[k] = [shingles, per, sizes]

    def find(self, texts: pa.ChunkedArray) -> list[tuple[int, int, float, int, int]]:
        """(text, item, similarity, first word, words) of the best window per text and item."""
        best: dict[tuple[int, int], tuple] = {}
        data, off = C.text_bytes(texts)
        for k, (shingles, per, sizes) in self.groups.items():
            h, bounds = _shingles(data, off, k)
            known = C.member(h, shingles)
            n_words = np.diff(bounds)
            count = np.maximum(n_words - k + 1, 0)
            first = np.r_[0, np.cumsum(count)]
            doc = np.repeat(np.arange(len(n_words)), count)
            flat = h[_valid(bounds, k)]
            hits = np.flatnonzero(known[_valid(bounds, k)])
            longest = max(sizes)
            for a, b in zip(*C.runs(doc[hits])):
                d = int(doc[hits[a]])
                mine = flat[first[d]:first[d + 1]]
                at = hits[a:b] - first[d]
                for lo, hi in _sliced(_regions(at, longest - k + 1, len(mine)), longest - k + 1):
                    self._search(d, mine, lo, hi, at[(at >= lo) & (at < hi)], k, per, sizes, best)
        return [(d, i, *v) for (d, i), v in sorted(best.items())]

    def _search(self, d, mine, lo, hi, at, k, per, sizes, best) -> None:
        part = mine[lo:hi]
        sums = np.zeros((len(part) + 1, 64), np.int32)
        np.cumsum(signed_bits(part), axis=0, out=sums[1:])
        seen = np.r_[0, np.cumsum(np.isin(np.arange(lo, hi), at))]
        for n, (items, index) in sizes.items():
            width = min(n - k + 1, len(mine))  # a text shorter than the item is one window
            s = np.arange(0, len(part) - width + 1)
            s = s[seen[s + width] > seen[s]]
            if not len(s):
                continue
            q, j = index.find(fingerprint_sums(sums[s + width] - sums[s]))
            for w, i in zip(s[q], items[j]):
                v = similarity(part[w:w + width], per[int(i)])
                key = (int(d), int(i))
                if v >= self.threshold and (key not in best or (-v, lo + w) < (-best[key][0], best[key][1])):
                    best[key] = (v, int(lo + w), int(width + k - 1))


def _shingles(data: np.ndarray, off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every k words in a row (0 across texts) and the word bounds of the texts."""
    raw, s, e, bounds = normal_words(data, off)
    h = word_hashes(np.frombuffer(raw, np.uint8), s, e, 0)
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    out = np.zeros(len(h), np.uint64)
    at, v = window_hashes(h, doc, k, 0)
    out[at] = v
    return out, bounds


def _valid(bounds: np.ndarray, k: int) -> np.ndarray:
    """Places where a shingle of k words starts inside a text."""
    n = np.diff(bounds)
    c = np.maximum(n - k + 1, 0)
    return np.repeat(bounds[:-1] - np.r_[0, np.cumsum(c)][:-1], c) + np.arange(c.sum())


def _span(bounds: np.ndarray, i: int, k: int) -> slice:
    return slice(bounds[i], bounds[i + 1] - k + 1)


def _regions(at: np.ndarray, reach: int, n: int) -> list[tuple[int, int]]:
    """Stretches that hold every window with a known shingle; overlapping ones are merged."""
    lo, hi = np.maximum(at - reach + 1, 0), np.minimum(at + reach, n)
    new = np.flatnonzero(np.r_[True, lo[1:] > hi[:-1]])
    return list(zip(lo[new].tolist(), hi[np.r_[new[1:] - 1, len(at) - 1]].tolist()))


def _sliced(regions: list[tuple[int, int]], reach: int) -> list[tuple[int, int]]:
    """The same stretches in pieces of bounded size that overlap by a longest window."""
    return [(a, min(a + REGION + reach, hi)) for lo, hi in regions for a in range(lo, max(lo + 1, hi - reach + 1), REGION)]


def _shipped(bench: DataFrame, id_col: str, text_col: str):
    """One broadcast per benchmark block: (ids, texts), each at most about BENCH_WORDS words."""
    rows = bench.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    size = C.total_bytes(rows) // 6
    n = max(1, -(-size // BENCH_WORDS))
    for b in range(n):
        got = rows.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == b).orderBy("id", "text").collect()
        yield bench.sparkSession.sparkContext.broadcast(([r.id for r in got], [r.text for r in got]))


def find_leaks(docs: DataFrame, bench: DataFrame, shingle: int = 5, threshold: float = 0.8, radius: int = RADIUS,
               id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, similarity, first_word, n_words): the best window per text and item, from ``threshold`` on.

    Words are compared with A-Z lowered.  An item of fewer words than a shingle is one shingle; items
    and texts without words match nothing.  Repeated rows are matched one by one.
    """
    src = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    out = None
    for shipped in _shipped(bench, item_col, item_text):
        part = src.mapInArrow(_finder(shipped, shingle, threshold, radius), "doc_id bigint, item_id bigint, similarity double, first_word bigint, n_words bigint")
        out = part if out is None else out.unionByName(part)
    return out


def _finder(shipped, shingle: int, threshold: float, radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts = shipped.value
        m = Matcher(texts, shingle, threshold, radius)
        for batch in batches:
            for b in text_slices(batch):
                found = m.find(pa.chunked_array([b.column("text")]))
                docs = b.column("doc_id").to_pylist()
                cols = list(zip(*[(docs[d], ids[i], v, s, n) for d, i, v, s, n in found])) or [[]] * 5
                yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()))],
                                      names=["doc_id", "item_id", "similarity", "first_word", "n_words"])
    return run


def drop_leaks(docs: DataFrame, bench: DataFrame, shingle: int = 5, threshold: float = 0.8, radius: int = RADIUS, text_col: str = "text",
               item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``docs`` in which no item is found, with all their columns."""
    out = docs
    for shipped in _shipped(bench, item_col, item_text):
        out = out.mapInArrow(_filter(shipped, shingle, threshold, radius, text_col), docs.schema)
    return out


def _filter(shipped, shingle: int, threshold: float, radius: int, text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Matcher(shipped.value[1], shingle, threshold, radius)
        for batch in batches:
            texts = batch.column(text_col).cast(pa.string()).fill_null("")
            begin, keep = 0, np.ones(batch.num_rows, bool)
            for part in text_slices(pa.record_batch({"text": texts})):
                for d in {x[0] for x in m.find(pa.chunked_array([part.column("text")]))}:
                    keep[begin + d] = False
                begin += part.num_rows
            yield batch.filter(pa.array(keep))
    return run
