"""Approximate nearest neighbours by a forest of hash-prefix trees.

Every tree gives a vector a long string of letters.  A letter is the vertex of a cross-polytope
nearest to a random projection of the vector, so near vectors share it more often than others;
a tree is the sorted array of all strings.  A query descends to its longest prefix match in
every tree, variable in length, and ascends in all trees at once, a letter at a time, until it has met
enough candidates; within the last level it goes tree by tree.  Candidates are scored exactly.

Rows are dealt to parts of bounded size with a forest each, queries to blocks; each block visits
each part.  The number of candidates is a share of the part (never a cap on a bucket: a level is
taken whole, and the top level is the part itself).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattica.llm import common as C
from lattica.llm import vectors as V

TREES = 128
LETTERS = 8
FACES = 16
"""Projected dimensions of a letter, so 32 letters: 5 bits each."""
BITS = 5
SHARE, LEAST = 0.25, 1024
"""A query stops ascending in a part once it has met this share of its rows, and as many at least."""
PART_ROWS, BLOCK_QUERIES = 8192, 1024
STEP = 4
"""Trees between two looks at the number of candidates within the last level."""


def strings(x: np.ndarray, trees: int = TREES, letters: int = LETTERS, seed: int = 7) -> np.ndarray:
    """(rows, trees) strings as numbers, first letter highest.  A vector's string depends on the vector alone."""
    out = np.zeros((len(x), trees), np.uint64)
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    unit = (x / np.where(norm > 0, norm, 1)).astype(np.float32)
    for t in range(trees):
        r = np.random.default_rng((seed, t, x.shape[1])).standard_normal((x.shape[1], letters * FACES), np.float32)
        for lo in range(0, len(x), 4096):
            p = (unit[lo:lo + 4096] @ r).reshape(-1, letters, FACES)
            face = np.abs(p).argmax(axis=2)
            sign = np.take_along_axis(p, face[..., None], 2)[..., 0] > 0
            code = (face * 2 + sign).astype(np.uint64)
            key = np.zeros(len(code), np.uint64)
            for j in range(letters):
                key = (key << np.uint64(BITS)) | code[:, j]
            out[lo:lo + 4096, t] = key
    return out


class Forest:
    """Sorted string arrays of a part, one per tree."""

    def __init__(self, keys: np.ndarray):
        self.n, self.trees = keys.shape
        self.order = [np.argsort(keys[:, t], kind="stable") for t in range(self.trees)]
        self.sorted = [keys[o, t] for t, o in enumerate(self.order)]

    def ranges(self, keys: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
        """(queries, trees) bounds of the rows that share a query's first ``level`` letters."""
        low = np.uint64((1 << BITS * (LETTERS - level)) - 1)
        lo, hi = np.empty(keys.shape, np.int64), np.empty(keys.shape, np.int64)
        for t, s in enumerate(self.sorted):
            first = keys[:, t] & ~low
            lo[:, t] = np.searchsorted(s, first, "left")
            hi[:, t] = np.searchsorted(s, first | low, "right")
        return lo, hi

    def candidates(self, keys: np.ndarray, enough: int) -> Iterator[np.ndarray]:
        """For each query the rows that it meets before it stops."""
        levels = [self.ranges(keys, x) for x in range(LETTERS + 1)]
        met = np.array([(hi - lo).sum(axis=1) for lo, hi in levels])  # rows met at a level, with repeats
        for q in range(len(keys)):
            seen = np.zeros(self.n, bool)
            # shorter prefixes hold longer ones, so only the last level below ``enough`` needs a visit of its own
            x = max((k for k in range(LETTERS + 1) if met[k, q] >= min(enough, self.n)), default=0)
            for level in range(min(x + 1, LETTERS), -1, -1):
                lo, hi = levels[level][0][q], levels[level][1][q]
                for t in range(self.trees):
                    seen[self.order[t][lo[t]:hi[t]]] = True
                    if level <= x and t % STEP == STEP - 1 and np.count_nonzero(seen) >= enough:
                        break
                if np.count_nonzero(seen) >= enough:
                    break
            yield np.flatnonzero(seen)


def _strings_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        x = V.matrix(b.column("vec"))
        keys = strings(x) if b.num_rows else np.zeros((0, TREES), np.uint64)
        yield pa.record_batch([*b.columns, pa.array([k.tobytes() for k in keys], pa.binary())], names=[*b.schema.names, "keys"])


def _keys(t: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(t.column("keys").to_pylist()), np.uint64).reshape(t.num_rows, TREES)


def _search(k: int, share: float, least: int):
    def run(rows: pa.Table, asks: pa.Table) -> pa.Table:
        names, found = ["key", "ids", "scores"], []
        if rows.num_rows and asks.num_rows:
            x, q = V.same_width(V.matrix(rows.column("vec")), V.matrix(asks.column("vec")))
            nx, nq = np.sqrt((x * x).sum(axis=1)), np.sqrt((q * q).sum(axis=1))
            ids = rows.column("ids").to_pylist()
            enough = max(least, int(np.ceil(share * len(x))))
            for i, c in enumerate(Forest(_keys(rows)).candidates(_keys(asks), enough)):
                s = (x[c] * q[i]).sum(axis=1) / (nx[c] * nq[i])
                if len(c) > k:
                    top = s >= np.partition(s, len(s) - k)[len(s) - k]
                    c, s = c[top], s[top]
                best = sorted((-v, d) for v, j in zip(s.tolist(), c.tolist()) for d in ids[j])[:k]
                found.append((i, [d for _, d in best], [-v for v, _ in best]))
        at = asks.column("key").to_pylist()
        return pa.table([pa.array([at[i] for i, _, _ in found], pa.int64()), pa.array([d for _, d, _ in found], pa.list_(pa.int64())),
                         pa.array([s for _, _, s in found], pa.list_(pa.float64()))], names=names)
    return run


def nearest(df: DataFrame, k: int = 5, every: int = 50, share: float = SHARE, least: int = LEAST,
            id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` found rows of largest cosine for each row whose id ``every`` divides.

    Null, zero and non-finite vectors take no part.  Equal rows count once and a row is not its own
    neighbour; rows of the same id but another vector are.  Ties go to smaller ids, null ids last.
    Vectors of unlike length are compared as if the shorter one ended in zeros.
    """
    rows = V.usable(df, id_col, vec_col).where(F.exists("vec", lambda x: x != 0))
    kept = C.settle(V.classes(rows, ["vec"], k + 1).withColumn("key", F.monotonically_increasing_id()).mapInArrow(
        _strings_of, "vec array<double>, ids array<bigint>, key bigint, keys binary"))
    asking = rows.where((F.col("vec_id") % every == 0) & (F.col("vec_id") != C.NO_ID)).select("vec_id", "vec").distinct()
    named = C.settle(asking.join(kept.select("vec", "key"), "vec").select("vec_id", "key"))
    asks = kept.join(named.select("key").distinct(), "key", "semi")
    n_parts = max(1, -(-kept.count() // PART_ROWS))
    n_blocks = max(1, -(-named.count() // BLOCK_QUERIES))
    found = V.meet(kept.select("vec", "ids", "keys", V.dealt("key", n_parts).alias("part")), n_parts,
                   asks.select("key", "vec", "keys", V.dealt("key", n_blocks).alias("block")), n_blocks,
                   _search(k + 1, share, least), "key bigint, ids array<bigint>, scores array<double>")
    each = found.select("key", F.explode(F.arrays_zip("ids", "scores")).alias("x")).select("key", F.col("x.ids").alias("found"), F.col("x.scores").alias("score"))
    order = [F.col("score").desc(), F.col("found")]
    best = each.withColumn("r", F.row_number().over(Window.partitionBy("key").orderBy(*order))).where(F.col("r") <= k + 1)
    # of the row itself one entry goes: the first with its id and the score of equal vectors
    mine = named.join(best, "key").withColumn("own", (F.col("found") == F.col("vec_id")) & (F.col("r") == F.min(F.when(F.col("found") == F.col("vec_id"), F.col("r"))).over(
        Window.partitionBy("vec_id", "key"))))
    last = mine.where(~F.coalesce("own", F.lit(False))).withColumn("rank", F.row_number().over(Window.partitionBy("vec_id", "key").orderBy(*order)))
    return last.where(F.col("rank") <= k).select(F.col("vec_id").alias("query_id"), "rank", V.restore("found").alias("vec_id"), "score")
