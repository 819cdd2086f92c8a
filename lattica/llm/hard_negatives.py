"""Hard-negative mining by coordinate pruning over length buckets.

Rows are dealt to buckets by the length of their vector.  A bucket keeps its vectors at unit length in
one sorted list per coordinate.  An anchor with a least score of interest has a least cosine in a
bucket, by the bucket's greatest length: over 1, the bucket is passed over; otherwise the anchor's
largest coordinates (its focus) have feasible ranges, outside of which no vector reaches that
cosine.  Rows in the ranges of all focus coordinates are candidates and are scored exactly.

Least scores come from a bounded sample of rows: what it holds is a lower bound of what all rows
hold, so the sample changes the work and never the result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattica.llm import common as C
from lattica.llm import vectors as V

FOCUS = 6
SAMPLE_ROWS = 4096
"""Rows (those with the smallest hash) that give every anchor its first least scores."""
PART_ROWS, BLOCK_QUERIES = 8192, 512
SLACK = 1e-9
EXACT = float(1 << 53)


def feasible(a: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of each coordinate of a unit vector whose cosine with unit vector ``a`` is ``least`` or more."""
    if least <= -1:
        return np.full(len(a), -1.0), np.full(len(a), 1.0)
    wide = np.sqrt(np.maximum(0, 1 - a * a) * max(0.0, 1 - least * least))
    lo = np.where(-a >= least, -1.0, a * least - wide)
    hi = np.where(a >= least, 1.0, a * least + wide)
    return lo - SLACK, hi + SLACK


def scores(x: np.ndarray, a: np.ndarray) -> np.ndarray:
    """Exact integer inner products; doubles hold them where no sum can pass 2**53."""
    if len(x) and float(np.abs(x).max()) * float(np.abs(a).max(initial=0)) * x.shape[1] < EXACT:
        return (x.astype(np.float64) @ a.astype(np.float64)).astype(np.int64)
    return (x * a).sum(axis=1)


class Bucket:
    """Vectors of like length with a sorted list for every focus coordinate asked for."""

    def __init__(self, x: np.ndarray):
        self.x = x
        length = np.sqrt((x.astype(np.float64) ** 2).sum(axis=1))
        self.longest = float(length.max(initial=0.0))
        self.shortest = float(length[length > 0].min(initial=np.inf))
        self.unit = x / np.where(length > 0, length, 1)[:, None]
        # a zero vector has score 0 whatever its cosine: it is a candidate wherever 0 is wanted
        self.zero = np.flatnonzero(length == 0)
        self.lists: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def sorted_list(self, f: int) -> tuple[np.ndarray, np.ndarray]:
        if f not in self.lists:
            o = np.argsort(self.unit[:, f], kind="stable")
            self.lists[f] = o, self.unit[o, f]
        return self.lists[f]

    def candidates(self, a: np.ndarray, least: float) -> np.ndarray:
        """Rows that may have a score of ``least`` or more with ``a``; every such row is among them."""
        size = float(np.sqrt((a.astype(np.float64) ** 2).sum()))
        everything = np.arange(len(self.x))
        if size == 0 or self.longest == 0:
            return everything if least <= 0 else everything[:0]
        cosine = least / (size * (self.longest if least > 0 else self.shortest)) - SLACK
        if cosine > 1:
            return everything[:0]
        u = a / size
        focus = np.argsort(-np.abs(u), kind="stable")[:FOCUS]
        lo, hi = feasible(u[focus], cosine)
        ranges = []
        for f, p, q in zip(focus, lo, hi):
            o, v = self.sorted_list(int(f))
            ranges.append((int(np.searchsorted(v, p, "left")), int(np.searchsorted(v, q, "right"))))
        # the shortest list range first, the other coordinates by value
        first = int(np.argmin([j - i for i, j in ranges]))
        i, j = ranges[first]
        found = self.sorted_list(int(focus[first]))[0][i:j]
        for k, f in enumerate(focus):
            if k != first and len(found):
                v = self.unit[found, f]
                found = found[(v >= lo[k]) & (v <= hi[k])]
        return np.union1d(found, self.zero) if least <= 0 and len(self.zero) else found


def kth(values: np.ndarray, k: int) -> int | None:
    """The k-th largest, None where there are fewer."""
    return int(np.partition(values, len(values) - k)[len(values) - k]) if len(values) >= k else None


def best_of(s: np.ndarray, ids: list, at: np.ndarray, k: int) -> list[tuple[int, int]]:
    """The first k of (score, id), largest score first, then smallest id, over all ids of each class."""
    least = kth(s, k)
    if least is not None:
        keep = s >= least
        s, at = s[keep], at[keep]
    return [(-v, d) for v, d in sorted((-v, d) for v, j in zip(s.tolist(), at.tolist()) for d in ids[j])[:k]]


class Sample:
    """A bounded number of rows whose scores bound what all rows hold from below."""

    def __init__(self, rows: list):
        self.x = V.matrix(pa.chunked_array([pa.array([r.vec for r in rows], pa.list_(pa.int64()))]), np.int64)
        self.label = np.array([r.label for r in rows], np.int64)
        self.times = np.array([r.times for r in rows], np.int64)

    def scores(self, a: np.ndarray, label: int, same: bool) -> np.ndarray:
        """Scores of the rows of the anchor's label, or of all others; a class of several rows several times."""
        m = (self.label == label) == same
        x, q = V.same_width(self.x[m], a[None])
        return np.repeat(scores(x, q[0]), self.times[m])


def _read(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    return V.matrix(t.column("vec"), np.int64), t.column("label").to_numpy()


def _out(found: list, names: list[str], types: list) -> pa.Table:
    cols = list(zip(*found)) or [[]] * len(names)
    return pa.table([pa.array(c, t) for c, t in zip(cols, types)], names=names)


LIST = pa.list_(pa.int64())


def _positives(k: int, sample: Sample):
    def run(rows: pa.Table, asks: pa.Table) -> pa.Table:
        found = []
        if rows.num_rows and asks.num_rows:
            (x, label), (q, q_label) = _read(rows), _read(asks)
            x, q = V.same_width(x, q)
            bucket, ids, keys = Bucket(x), rows.column("ids").to_pylist(), asks.column("key").to_pylist()
            of = {int(v): np.flatnonzero(label == v) for v in np.unique(label)}
            for i in range(len(q)):
                c = of.get(int(q_label[i]))
                if c is None:
                    continue
                least = kth(sample.scores(q[i], q_label[i], True), k)
                if least is not None:
                    c = bucket.candidates(q[i], least)
                    c = c[label[c] == q_label[i]]
                best = best_of(scores(x[c], q[i]), ids, c, k)
                if best:
                    found.append((keys[i], [d for _, d in best], [v for v, _ in best]))
        return _out(found, ["key", "ids", "scores"], [pa.int64(), LIST, LIST])
    return run


def _negatives(k: int, low: int, high: int, sample: Sample):
    def fits(s: np.ndarray, p: int) -> np.ndarray:
        return (low * p <= 100 * s) & (100 * s <= high * p)

    def run(rows: pa.Table, asks: pa.Table) -> pa.Table:
        found = []
        if rows.num_rows and asks.num_rows:
            (x, label), (q, q_label) = _read(rows), _read(asks)
            x, q = V.same_width(x, q)
            bucket, ids, keys = Bucket(x), rows.column("ids").to_pylist(), asks.column("key").to_pylist()
            for i, wanted in enumerate(asks.column("wanted").to_pylist()):
                wanted = [p for p in wanted if low * p <= high * p]
                if not wanted:
                    continue
                seen = sample.scores(q[i], q_label[i], False)
                # -(-a // b) rounds up
                least = min(max(-(-low * p // 100), kth(seen[fits(seen, p)], k) or -(-low * p // 100)) for p in wanted)
                c = bucket.candidates(q[i], least)
                c = c[label[c] != q_label[i]]
                s = scores(x[c], q[i])
                for p in wanted:
                    m = fits(s, p)
                    best = best_of(s[m], ids, c[m], k)
                    if best:
                        found.append((keys[i], p, [d for _, d in best], [v for v, _ in best]))
        return _out(found, ["key", "positive_score", "ids", "scores"], [pa.int64(), pa.int64(), LIST, LIST])
    return run


def _first(found: DataFrame, by: list[str], k: int) -> DataFrame:
    """The first k over all buckets: (by, id, score, r)."""
    each = found.select(*by, F.explode(F.arrays_zip("ids", "scores")).alias("x")).select(*by, F.col("x.ids").alias("id"), F.col("x.scores").alias("score"))
    return each.withColumn("r", F.row_number().over(Window.partitionBy(*by).orderBy(F.col("score").desc(), "id"))).where(F.col("r") <= k)


def by_length(kept: DataFrame, n_parts: int) -> tuple[DataFrame, int]:
    """Add ``part``: buckets of like length and size; rows of one length are told apart by key, so any length splits."""
    length = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    parts = C.settle(kept.withColumn("length", length).repartitionByRange(n_parts, "length", "key").withColumn("part", F.spark_partition_id()).drop("length"))
    return parts, int(parts.agg(F.max("part")).first()[0] or 0) + 1


def mine(df: DataFrame, positives: int = 5, negatives: int = 3, every: int = 50, low: int = 50, high: int = 95, scale: int = 256,
         label: Column | None = None, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Anchors are the rows whose id ``every`` divides; components become ``floor(scale * x)``.  An anchor's
    positives are its first ``positives`` other rows of its label; for each, the first ``negatives``
    rows of other labels whose score is ``low`` to ``high`` percent of the positive's.  Higher scores
    come first, then smaller ids, null ids last.  ``label`` may replace the label column.

    Rows with a null label or vector, or a null or non-finite component, take no part; an empty or
    zero vector has score 0.  Equal rows count once; vectors of unlike length end in zeros.  Scores
    are 64-bit integers.
    """
    told = (F.col(label_col) if label is None else label).cast("bigint").alias("label")
    rows = V.usable(df, id_col, vec_col, told).where("label is not null").withColumn("vec", F.transform("vec", lambda x: F.floor(x * scale)))
    once = C.settle(V.classes(rows, ["label", "vec"], max(positives + 1, negatives)).withColumn("key", F.monotonically_increasing_id()))
    kept, n_parts = by_length(once, max(1, -(-once.count() // PART_ROWS)))
    taken = kept.orderBy(F.xxhash64("key"), "key").limit(SAMPLE_ROWS).select("vec", "label", F.size("ids").alias("times")).collect()
    sample = Sample(taken)
    asking = rows.where((F.col("vec_id") % every == 0) & (F.col("vec_id") != C.NO_ID)).distinct()
    named = C.settle(asking.join(kept.select("label", "vec", "key"), ["label", "vec"]).select("vec_id", "key"))
    n_blocks = max(1, -(-named.count() // BLOCK_QUERIES))
    asks = kept.join(named.select("key").distinct(), "key", "semi").select("key", "label", "vec", V.dealt("key", n_blocks).alias("block"))
    side = kept.select("label", "vec", "ids", "part")

    found = V.meet(side, n_parts, asks, n_blocks, _positives(positives + 1, sample), "key bigint, ids array<bigint>, scores array<bigint>")
    best = C.settle(_first(found, ["key"], positives + 1))
    mates = named.join(best, "key").withColumn("own", (F.col("id") == F.col("vec_id")) & (F.col("r") == F.min(F.when(F.col("id") == F.col("vec_id"), F.col("r"))).over(
        Window.partitionBy("vec_id", "key")))).where(~F.coalesce("own", F.lit(False)))
    ranked = mates.withColumn("p", F.row_number().over(Window.partitionBy("vec_id", "key").orderBy("r"))).where(F.col("p") <= positives)

    wanted = best.groupBy("key").agg(F.sort_array(F.collect_set("score")).alias("wanted"))
    others = V.meet(side, n_parts, asks.join(wanted, "key"), n_blocks, _negatives(negatives, low, high, sample),
                    "key bigint, positive_score bigint, ids array<bigint>, scores array<bigint>")
    last = _first(others, ["key", "positive_score"], negatives)
    return ranked.select(F.col("vec_id").alias("anchor_id"), "key", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")).join(
        last, ["key", "positive_score"]).select("anchor_id", V.restore("positive_id").alias("positive_id"), F.col("r").alias("rank"),
                                                V.restore("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
