"""Document fingerprints from prefix polynomial hashes.

A modular prefix array answers whether any two spans are equal, and binary search over it
finds the longest common extension.  A fingerprint keeps samples of that array where the
content says so: at code points whose next WINDOW ones hash to enough zero bits, so equal stretches
of two texts are sampled alike wherever they stand.  Two fingerprints are compared by
extending stretches that both have, by binary search, as far as the samples agree.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattica.llm import common as C

MODULI = np.array([[2147483647], [2147483629]], np.uint64)
BASES = np.array([[911382323], [972663749]], np.uint64)
WINDOW = 8
"""Code points that decide whether a place is sampled."""
GRID = 192
"""About the most samples of a text; the number of zero bits asked for grows with its length."""
PARTS = 100_000
"""Most parts; larger ones stream through their tasks row by row."""
PART_BYTES = 2 << 20
"""About the texts of a part, which meets a worker as a group of its own; one that equal or null ids make larger comes in Spark's batches."""
TASK_PARTS = 2
"""Parts a task gets, on average."""
OUT_BYTES = 1 << 20
"""Results of this size leave the worker."""

INVERSES = np.array([[pow(int(b), int(m) - 2, int(m))] for b, m in zip(BASES[:, 0], MODULI[:, 0])], np.uint64)
"""Of the bases, by Fermat's exponent."""
SHIFT = np.uint64(0x5851F42D4C957F2D)
"""Multiplier of the windows' hash, which is modulo 2**64."""
SPREAD = np.uint64(0x9E3779B97F4A7C15)
"""Carries a hash into its upper bits, which decide on samples."""

_tables = {"up": np.ones((2, 1), np.uint64), "down": np.ones((2, 1), np.uint64)}


def _table(which: str, step: np.ndarray, n: int) -> np.ndarray:
    p = _tables[which]
    while p.shape[1] < n:
        p = np.concatenate([p, p * (p[:, -1:] * step % MODULI) % MODULI], axis=1)
    _tables[which] = p
    return p


def powers(n: int) -> np.ndarray:
    """BASES**0 .. BASES**(n-1) for both moduli; grows by doubling and is kept."""
    return _table("up", BASES, n)


def inverse_powers(at: np.ndarray) -> np.ndarray:
    """BASES**-k for every k in ``at``."""
    return _table("down", INVERSES, int(at.max(initial=0)) + 1)[:, at]


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def window_hashes(c: np.ndarray) -> np.ndarray:
    """A hash of every WINDOW code points in a row."""
    n = max(0, len(c) - WINDOW + 1)
    h, wide = np.zeros(n, np.uint64), c.astype(np.uint64)
    for k in range(WINDOW if n else 0):
        h = h * SHIFT + wide[k:k + n]
    return h * SPREAD


class Prefix:
    """Prefix hashes of a text: column i covers its first i code points."""

    def __init__(self, text: str):
        c = codes(text)
        self.n, self.codes, self.windows = len(c), c, window_hashes(c)
        self.sums = np.zeros((2, self.n + 1), np.uint64)
        if self.n:
            self.sums[:, 1:] = np.cumsum((c.astype(np.uint64) + np.uint64(1)) * powers(self.n)[:, :self.n] % MODULI, axis=1, dtype=np.uint64) % MODULI

    def spans(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Position-free hashes of spans, both moduli in one 64-bit number."""
        h = (self.sums[:, stop] + MODULI - self.sums[:, start]) % MODULI * inverse_powers(np.asarray(start)) % MODULI
        return (h[0] << np.uint64(32)) | h[1]

    def equal(self, i: int, other: Prefix, j: int, n: int) -> bool:
        return i + n <= self.n and j + n <= other.n and bool(
            self.spans(np.array([i]), np.array([i + n]))[0] == other.spans(np.array([j]), np.array([j + n]))[0])

    def extension(self, i: int, other: Prefix, j: int) -> int:
        """Length of the longest common span that starts at i here and at j there."""
        lo, hi = 0, min(self.n - i, other.n - j)
        while lo < hi:
            mid = (lo + hi + 1) // 2
            lo, hi = (mid, hi) if self.equal(i, other, j, mid) else (lo, mid - 1)
        return lo

    def joined(self, keep: int, other: Prefix, m: int) -> Prefix:
        """Prefix hashes of this text's first ``keep`` code points followed by the other's first ``m``."""
        out = Prefix.__new__(Prefix)
        out.n, out.codes = keep + m, np.concatenate([self.codes[:keep], other.codes[:m]])
        # windows over the joint are new, the others are known
        left, right = max(0, keep - WINDOW + 1), max(0, m - WINDOW + 1)
        out.windows = np.concatenate([self.windows[:left], window_hashes(out.codes[left:keep + WINDOW - 1]), other.windows[:right]])
        shift = powers(keep + 1)[:, keep:keep + 1]
        out.sums = np.concatenate([self.sums[:, :keep + 1], (self.sums[:, keep:keep + 1] + other.sums[:, 1:m + 1] * shift) % MODULI], axis=1)
        return out


def _zeros(h: np.ndarray) -> np.ndarray:
    """Zero bits at the top of each number, to within rounding."""
    return np.clip(64 - np.frexp(h.astype(np.float64))[1], 0, 64).astype(np.uint8)


class Fingerprint:
    """Length, hash of all, level, and per sample its place, prefix hash and zero bits; the end is a sample too."""

    def __init__(self, p: Prefix):
        self.n = p.n
        self.whole = int(C.mix(p.spans(np.array([0]), np.array([p.n])))[0])
        h = p.windows
        self.level = max(0, (max(p.n, 1) // GRID).bit_length())
        while True:
            pick = np.flatnonzero(h < np.uint64(1 << 64 - self.level)) if self.level else np.arange(len(h))
            # what repeats at once is sampled where it begins
            order = np.lexsort((pick, h[pick]))
            near = (np.diff(h[pick][order]) == 0) & (np.diff(pick[order]) <= 1 << self.level)
            pick = np.delete(pick, order[1:][near])
            if len(pick) <= 2 * GRID:
                break
            self.level += 1
        pick = pick[(pick > 0)]
        self.at = np.r_[pick, p.n].astype(np.int64)
        self.sums = p.sums[:, self.at]
        self.zeros = np.r_[np.maximum(_zeros(h[pick]), self.level), 255].astype(np.uint8)
        self._kept: dict[int, tuple] = {}

    def __str__(self) -> str:
        raw = b"".join(a.tobytes() for a in (np.diff(self.at, prepend=0).astype(">u4"), self.sums[0].astype(">u4"), self.zeros))
        return f"{self.n:x}-{self.whole:016x}-{self.level:x}-{raw.hex()}"

    @classmethod
    def parse(cls, text: str) -> Fingerprint:
        n, whole, level, raw = text.split("-")
        out = cls.__new__(cls)
        out.n, out.whole, out.level, data = int(n, 16), int(whole, 16), int(level, 16), bytes.fromhex(raw)
        k = len(data) // 9
        out.at = np.cumsum(np.frombuffer(data[:4 * k], ">u4").astype(np.int64))
        out.sums = np.frombuffer(data[4 * k:8 * k], ">u4").astype(np.uint64)[None]
        out.zeros, out._kept = np.frombuffer(data[8 * k:], np.uint8), {}
        return out

    def _samples(self, level: int) -> tuple[list[int], list[int], list[int]]:
        """Places and prefix hashes from the start on, and a key of each stretch between two of them."""
        if level not in self._kept:
            keep = self.zeros >= level
            at, sums = np.r_[0, self.at[keep]], np.r_[np.uint64(0), self.sums[0][keep]]
            p = MODULI[0, 0]
            h = (sums[1:] + p - sums[:-1]) % p * inverse_powers(at[:-1])[0] % p
            self._kept[level] = at.tolist(), sums.tolist(), ((h << np.uint64(32)) | np.diff(at).astype(np.uint64)).tolist()
        return self._kept[level]

    def likeness(self, other: Fingerprint) -> float:
        """Length of the stretches that both have, as a share of the longer text; 1 for equal texts."""
        if (self.n, self.whole) == (other.n, other.whole):
            return 1.0
        if not self.n or not other.n:
            return 0.0
        level = max(self.level, other.level)
        (a, sa, ka), (b, sb, kb) = self._samples(level), other._samples(level)
        p, base = int(MODULI[0, 0]), int(BASES[0, 0])
        both = set(ka).intersection(kb)
        if not both:
            return 0.0
        where: dict[int, list[int]] = {}
        for j, key in enumerate(kb):
            if key in both:
                where.setdefault(key, []).append(j)

        def equal(i: int, j: int, k: int) -> bool:
            """Are the k stretches from i here and from j there the same text?"""
            x, y = sa[i + k] - sa[i], sb[j + k] - sb[j]
            return a[i + k] - a[i] == b[j + k] - b[j] and (x * pow(base, b[j], p) - y * pow(base, a[i], p)) % p == 0

        total, past, done = 0, 0, 0
        for i, key in enumerate(ka):
            if i < past or key not in both:
                continue
            ways = where[key]
            # the first place that is not before the last one used, else the first
            j = next((j for j in ways if j >= done), ways[0])
            lo, hi = 1, min(len(ka) - i, len(kb) - j)
            while lo < hi:  # equal spans have equal beginnings
                mid = (lo + hi + 1) // 2
                lo, hi = (mid, hi) if equal(i, j, mid) else (lo, mid - 1)
            total += a[i + lo] - a[i]
            past, done = i + lo, j + lo
        return min(total, self.n, other.n) / max(self.n, other.n)


def _edit(text: str, p: Prefix, following: str, q: Prefix) -> tuple[str, Prefix]:
    keep, m = p.n - p.n // 3, min(p.n // 3, q.n)
    return text[:keep] + following[:m], p.joined(keep, q, m)


_OUT = ["doc_id", "n_chars", "edited_text", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come part by part in order, a part's last row being the one that follows it.

    A text leaves its batch when its turn comes, and results leave while the batch is read.
    """
    last, out, held = None, [], 0

    def row(one, nxt):
        (_, doc_id, text, p, fp), (_, _, following, q, fq) = one, nxt
        edited, e = _edit(text, p, following, q)
        fe = Fingerprint(e)
        return doc_id, p.n, edited, str(fp), str(fe), fp.likeness(fe), fp.likeness(fq)

    def batch(rows):
        return pa.record_batch([pa.array(x) if k != 0 else pa.array(x, pa.int64()) for k, x in enumerate(zip(*rows))], names=_OUT)

    for b in batches:
        columns = [b.column(c) for c in ("part", "carry", "doc_id", "text")]
        for k in range(b.num_rows):
            part, carry, doc_id, text = (c[k].as_py() for c in columns)
            p = Prefix(text)
            now = (part, doc_id, text, p, Fingerprint(p))
            if last is not None and last[0] == part:
                out.append(row(last, now))
                held += sum(map(len, out[-1][2:5]))
                if held >= OUT_BYTES:
                    yield batch(out)
                    out, held = [], 0
            last = None if carry else now
    if out:
        yield batch(out)


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edit with the next text, in descending id order.

    (doc_id, n_chars, edited_text, fingerprint, edited_fingerprint, near_edited, near_next).  In the edit
    the last third of the code points (rounded down) gives way to as many of the next text's first, or to
    all of it.  The first text follows the last.  Null texts are empty; null ids come last; equal ids
    follow one another in order of their texts.
    """
    src = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    n = max(1, min(PARTS, C.total_bytes(src) // PART_BYTES))
    cuts = src.agg(F.percentile_approx("doc_id", [k / n for k in range(1, n)] or [0.5], 25 * n)).first()[0]
    bounds = np.unique(np.array(cuts or [], np.int64))  # at most PARTS ids: a document's part is found by value

    @F.pandas_udf(T.IntegerType())
    def part_of(v: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, v.to_numpy(np.int64), side="left").astype(np.int32))

    dealt = src.withColumn("part", F.when(F.col("doc_id").isNull(), -1).otherwise(part_of(F.coalesce("doc_id", F.lit(0)))))
    line = Window.partitionBy(F.lit(0)).orderBy(F.col("part").desc())  # at most PARTS + 2 rows of three numbers
    whole = line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    heads = dealt.groupBy("part").agg(F.max("doc_id").alias("head")).withColumn(
        "before", F.coalesce(F.lag("part").over(line), F.last("part").over(whole)))
    # a part's first text ends the part before it
    carry = dealt.alias("d").join(F.broadcast(heads).alias("h"), F.expr("d.part = h.part and d.doc_id <=> h.head")).groupBy(
        F.col("h.before").alias("part")).agg(F.min("text").alias("text"))
    rows = dealt.select("part", F.lit(0).alias("carry"), "doc_id", "text").unionByName(
        carry.select("part", F.lit(1).alias("carry"), F.lit(None).cast("bigint").alias("doc_id"), "text"))
    laid = rows.repartition(n // TASK_PARTS + 1, "part").sortWithinPartitions("part", "carry", F.col("doc_id").desc_nulls_last(), "text")
    return laid.groupBy("part").applyInArrow(_compare, "doc_id bigint, n_chars bigint, edited_text string, fingerprint string, "
                                                       "edited_fingerprint string, near_edited double, near_next double")
