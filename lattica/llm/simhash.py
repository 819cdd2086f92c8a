"""SimHash fingerprints and near-duplicate search over an index of byte positions.

Two fingerprints within ``radius`` bits agree in at least ``positions - radius`` of their
bytes: the guaranteed tally.  A posting of one (position, byte) holds a 256th of all
fingerprints, so tallying over single postings forms a number of pairs that grows with the square of the
corpus.  The index therefore lists fingerprints under every choice of that many postings at once: a list
only holds pairs that reach the guarantee, and its members differ in ``radius`` known bytes at most.
In a list, pairs are tallied and verified; a long one, which is bounded since its members are
distinct, is probed with every allowed bit pattern instead.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm import common as C
from lattica.llm import graph
from lattica.llm.substring_dedup import word_spans

CHUNK_BYTES = 2 << 20
TALLIED = 64
"""Members up to which every pair of a list is tallied; longer lists are probed bit by bit, with the same result."""


def normal_words(data: np.ndarray, offsets: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """A-Z lowered, words one space apart: the bytes, word starts and ends, words per text (cumulated)."""
    data = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    s, e, doc = word_spans(data, offsets)
    at = np.r_[0, np.cumsum(e - s + 1)]
    if len(s):
        index = np.repeat(s - at[:-1], e - s + 1) + np.arange(at[-1])
        out = data[np.minimum(index, len(data) - 1)]
        out[at[1:] - 1] = 32
    else:
        out = np.zeros(0, np.uint8)
    return out.tobytes(), at[:-1], at[1:] - 1, np.searchsorted(doc, np.arange(len(offsets)))


def shingle_hashes(raw: bytes, starts: np.ndarray, ends: np.ndarray, bounds: np.ndarray, k: int, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of every k-word shingle and the text of each; a shorter text is one shingle."""
    import xxhash

    n = np.diff(bounds)
    per = np.where(n == 0, 0, np.maximum(n - k + 1, 1))
    doc = np.repeat(np.arange(len(n)), per)
    first = bounds[:-1][doc] + np.arange(len(doc)) - np.r_[0, np.cumsum(per)][doc]
    last = np.minimum(first + k - 1, bounds[1:][doc] - 1)
    digest = xxhash.xxh64_intdigest
    if not len(doc):
        return np.zeros(0, np.uint64), doc
    return np.fromiter((digest(raw[a:b], seed) for a, b in zip(starts[first].tolist(), ends[last].tolist())), np.uint64, len(doc)), doc


def simhash(h: np.ndarray, doc: np.ndarray, n_docs: int, words: int = 1) -> np.ndarray:
    """(n_docs, words) fingerprints: a bit is 1 where over half the hashes have it; word w uses a remixed hash."""
    out = np.zeros((n_docs, words), np.uint64)
    if not len(h):
        return out
    s, e = C.runs(doc)
    for w in range(words):
        hw = h if w == 0 else C.mix(h + np.uint64((w * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF))
        bits = np.unpackbits(hw.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        count = np.add.reduceat(bits, s, axis=0, dtype=np.uint32)
        on = (count.astype(np.int64) * 2 > (e - s)[:, None]).astype(np.uint8)
        out[doc[s], w] = np.packbits(on, axis=1, bitorder="little").view("<u8").reshape(-1)
    return out


def text_slices(b: pa.RecordBatch, budget: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of rows of about ``budget`` bytes of text, at least one row each."""
    if not b.num_rows:
        return
    sizes = np.array([len(x.as_buffer()) if x.is_valid else 0 for x in b.column("text").cast(pa.large_binary())], np.int64)
    part = np.cumsum(sizes) // budget
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), b.num_rows]
    for i, j in zip(cuts, cuts[1:]):
        yield b.slice(i, j - i)


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): the 64-bit fingerprint of every row as a bigint; no words: zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in text_slices(batch):
                data, offsets = C.text_bytes(pa.chunked_array([b.column("text")]))
                raw, s, e, bounds = normal_words(data, offsets)
                h, doc = shingle_hashes(raw, s, e, bounds, shingle)
                fp = simhash(h, doc, b.num_rows)[:, 0].view(np.int64)
                yield pa.record_batch({"doc_id": b.column("doc_id"), "fp": pa.array(fp)})

    src = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return src.mapInArrow(run, "doc_id bigint, fp bigint")


def position_sets(radius: int, positions: int = 8) -> list[int]:
    """Masks of every choice of ``positions - radius`` bytes, as signed 64-bit integers."""
    out = []
    for kept in combinations(range(positions), positions - radius):
        m = sum(0xFF << (8 * p) for p in kept)
        out.append(m - (1 << 64) if m >> 63 else m)
    return out


def _probe(radius: int):
    def links_of(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        fps = np.sort(fps)
        if len(fps) <= TALLIED:
            i, j = np.triu_indices(len(fps), 1)
            parts = fps.view(np.uint8).reshape(-1, 8)
            reached = (parts[i] == parts[j]).sum(axis=1) >= 8 - radius  # the tally of shared positional bytes
            i, j = i[reached], j[reached]
            near = np.bitwise_count(fps[i] ^ fps[j]) <= radius
            return fps[i[near]], fps[j[near]]
        free = np.bitwise_or.reduce(fps ^ fps[0])
        bits = [np.uint64(1 << k) for k in range(64) if int(free) >> k & 1]
        a, b = [], []
        for r in range(1, radius + 1):
            for c in combinations(bits, r):
                other = fps ^ np.bitwise_or.reduce(np.array(c))
                hit = (other > fps) & C.member(other, fps)
                a.append(fps[hit])
                b.append(other[hit])
        return np.concatenate(a), np.concatenate(b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            for fps in batch.column("fps"):
                x, y = links_of(fps.values.to_numpy().view(np.uint64))
                a.append(x)
                b.append(y)
            if a:
                yield pa.record_batch({"a": pa.array(np.concatenate(a).view(np.int64)), "b": pa.array(np.concatenate(b).view(np.int64))})
    return run


def near_links(distinct: DataFrame, radius: int = 2) -> DataFrame:
    """Every pair (a, b) of distinct fingerprints ``fp`` that differ in 1 to ``radius`` bits."""
    sets = F.array(*[F.lit(m) for m in position_sets(radius)])
    # a row becomes one per choice, so the few bytes of fingerprints are spread before
    spread = distinct.repartition(int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp")
    posted = spread.select("fp", F.posexplode(sets).alias("which", "mask"))
    # distinct fingerprints that agree outside two known bytes: a list has 65,536 members at most
    lists = posted.groupBy("which", F.col("fp").bitwiseAND(F.col("mask")).alias("key")).agg(F.collect_list("fp").alias("fps"))
    return lists.where(F.size("fps") > 1).select("fps").mapInArrow(_probe(radius), "a bigint, b bigint").distinct()


def near_components(docs: DataFrame, shingle: int = 3, radius: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id, links) of every row.

    ``component_id`` is the smallest id reachable over links, ``links`` the number of other
    fingerprints within the radius.  Null, empty and blank texts have fingerprint zero and
    link like any other.  Repeated ids are separate rows; null ids never name a component
    unless all of its ids are null.
    """
    marked = C.settle(fingerprints(docs, shingle, id_col, text_col))
    distinct = marked.groupBy("fp").agg(F.min("doc_id").alias("least"))
    links = C.settle(near_links(distinct.select("fp"), radius))
    roots = graph.components(links)
    degree = links.select(F.explode(F.array("a", "b")).alias("fp")).groupBy("fp").agg(F.count("*").alias("links"))
    of = distinct.join(roots.withColumnRenamed("a", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = of.join(of.groupBy("root").agg(F.min("least").alias("component_id")), "root").join(degree, "fp", "left").select(
        "fp", "component_id", F.coalesce("links", F.lit(0)).alias("links"))
    return marked.join(named, "fp").select("doc_id", "fp", "component_id", "links")
