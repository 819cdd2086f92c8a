"""What the corpus operators share: reading, blocks of documents, packed key exchange.

Long texts are laid out once in blocks (``blk``, a hash of the row) and every pass that
needs texts groups by that column, so Spark reuses one exchange of the texts for all
of them.  Keys travel between blocks as packed sorted arrays: one row per (block,
bucket), a few bytes per key.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.session import ensure_checkpoint_dir

WORD = r"[^\x20\x09-\x0D]+"
NO_ID = np.iinfo(np.int64).max
"""Stands for a null document id: it comes after every other."""

BLOCK_BYTES = 2 << 20
BUCKET_KEYS = 1 << 20


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the session names it; one of its own only in local mode without one."""
    return ensure_checkpoint_dir(spark)


def settle(df: DataFrame) -> DataFrame:
    """Write the rows to the shared checkpoint folder and go on from there."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of this package's own in the shared checkpoint folder."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def total_bytes(df: DataFrame, text: str = "text") -> int:
    return int(df.agg(F.sum(F.octet_length(text))).first()[0] or 0)


def blocks(docs: DataFrame, n: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, blk): rows dealt to ``n`` blocks by id; rows without one by their text."""
    return docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"),
        F.pmod(F.xxhash64(F.coalesce(F.col(id_col).cast("bigint"), F.xxhash64(text_col))), F.lit(n)).cast("int").alias("blk"))


def ids(col: pa.ChunkedArray) -> np.ndarray:
    return col.fill_null(NO_ID).to_numpy().astype(np.int64)


def text_bytes(col: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All texts of a column as one byte array and the n + 1 offsets into it."""
    parts, offsets, base = [], [np.zeros(1, np.int64)], 0
    for chunk in col.cast(pa.large_string()).chunks:
        off = np.frombuffer(chunk.buffers()[1], np.int64)[chunk.offset:chunk.offset + len(chunk) + 1]
        data = chunk.buffers()[2]
        part = np.frombuffer(data, np.uint8)[off[0]:off[-1]] if data is not None and len(off) > 1 else np.zeros(0, np.uint8)
        parts.append(part)
        offsets.append(off[1:] - off[0] + base)
        base += len(part)
    return np.concatenate(parts) if parts else np.zeros(0, np.uint8), np.concatenate(offsets)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser: xor-shift and multiply rounds."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, by doubling."""
    out = np.ones(max(n, 1), np.uint64)
    done, step = 1, np.uint64(base)
    while done < n:
        m = min(done, n - done)
        out[done:done + m] = out[:m] * step
        done, step = done + m, step * step
    return out


def letters(seed: int) -> np.ndarray:
    """One pseudo-random 64-bit value for each byte value."""
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


# --- packed key exchange -----------------------------------------------------------

def planes(a: np.ndarray) -> bytes:
    """Bytes of equal weight side by side: what is mostly zero compresses away in a shuffle."""
    a = np.ascontiguousarray(a)
    return a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes()


def from_planes(raw: bytes, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).view(dtype).reshape(-1)


def pack_sorted(a: np.ndarray) -> bytes:
    return planes(np.diff(a, prepend=a.dtype.type(0)))


def unpack_sorted(raw: bytes, dtype) -> np.ndarray:
    return np.cumsum(from_planes(raw, dtype), dtype=dtype)


def bucket_of(h: np.ndarray, n_buckets: int) -> np.ndarray:
    """Bucket of a hash, from its upper half."""
    return (((h >> np.uint64(32)) * np.uint64(n_buckets)) >> np.uint64(32)).astype(np.int64)


def short_of(h: np.ndarray) -> np.ndarray:
    """32 more bits; with buckets of bounded size, chance repeats stay equally rare at any scale."""
    return (h & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def runs(sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs of equal values."""
    if not len(sorted_keys):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    s = np.flatnonzero(np.r_[True, sorted_keys[1:] != sorted_keys[:-1]])
    return s, np.r_[s[1:], len(sorted_keys)]


SHORT_SCHEMA = "bucket int, blk int, keys binary, counts binary"
SHARED_SCHEMA = "blk int, bucket int, keys binary, totals binary"


def short_rows(h: np.ndarray, blk: int, n_buckets: int) -> pa.Table:
    """One row per bucket: the distinct short keys of a block and how often each occurs there."""
    both = np.sort((bucket_of(h, n_buckets).astype(np.uint64) << np.uint64(32)) | (h & np.uint64(0xFFFFFFFF)))
    s, e = runs(both)
    uniq, cnt = both[s], np.minimum(e - s, 0xFFFFFFFF).astype(np.uint32)
    bucket = (uniq >> np.uint64(32)).astype(np.int32)
    short = (uniq & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    bs, be = runs(bucket)
    return pa.table({
        "bucket": pa.array(bucket[bs], pa.int32()), "blk": pa.array(np.full(len(bs), blk, np.int32)),
        "keys": pa.array([pack_sorted(short[i:j]) for i, j in zip(bs, be)], pa.binary()),
        "counts": pa.array([planes(cnt[i:j]) for i, j in zip(bs, be)], pa.binary())})


def keep_repeated(t: pa.Table) -> pa.Table:
    """Of one bucket: for each block the keys that occur at least twice overall, with their totals."""
    blk = t.column("blk").to_numpy()
    keys = [unpack_sorted(x, np.uint32) for x in t.column("keys").to_pylist()]
    cnts = [from_planes(x, np.uint32) for x in t.column("counts").to_pylist()]
    row = np.repeat(np.arange(len(keys)), [len(k) for k in keys])
    allk, allc = np.concatenate(keys), np.concatenate(cnts).astype(np.int64)
    order = np.argsort(allk, kind="stable")
    s, e = runs(allk[order])
    total = np.repeat(np.add.reduceat(allc[order], s), e - s)
    hit = order[total >= 2]
    tot = np.empty(len(allk), np.int64)
    tot[order] = total
    hit.sort()
    rs, re = runs(row[hit])
    return pa.table({
        "blk": pa.array(blk[row[hit][rs]], pa.int32()),
        "bucket": pa.array(np.full(len(rs), t.column("bucket")[0].as_py(), np.int32)),
        "keys": pa.array([pack_sorted(allk[hit[i:j]]) for i, j in zip(rs, re)], pa.binary()),
        "totals": pa.array([planes(np.minimum(tot[hit[i:j]], 0xFFFFFFFF).astype(np.uint32)) for i, j in zip(rs, re)], pa.binary())})


def repeated_keys(short: DataFrame) -> DataFrame:
    """Rows of SHORT_SCHEMA to rows of SHARED_SCHEMA; a bucket holds a key once per block at most."""
    return short.groupBy("bucket").applyInArrow(keep_repeated, SHARED_SCHEMA)


def lookup(h: np.ndarray, n_buckets: int, shared: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Which hashes are among a block's repeated keys, and the total of each."""
    if not shared.num_rows or not len(h):
        return np.zeros(len(h), bool), np.zeros(len(h), np.int64)
    known, total = [], []
    for b, k, c in zip(shared.column("bucket").to_pylist(), shared.column("keys").to_pylist(), shared.column("totals").to_pylist()):
        known.append(unpack_sorted(k, np.uint32).astype(np.uint64) | (np.uint64(b) << np.uint64(32)))
        total.append(from_planes(c, np.uint32))
    known, total = np.concatenate(known), np.concatenate(total).astype(np.int64)
    order = np.argsort(known)
    known, total = known[order], total[order]
    mine = (bucket_of(h, n_buckets).astype(np.uint64) << np.uint64(32)) | (h & np.uint64(0xFFFFFFFF))
    at = np.minimum(np.searchsorted(known, mine), len(known) - 1)
    hit = known[at] == mine
    return hit, np.where(hit, total[at], 0)


def member(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Is each value in the sorted array?"""
    if not len(known):
        return np.zeros(len(values), bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def covered(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """Mask of positions 0..n-1 that lie in some window of ``width`` at a start."""
    diff = np.zeros(n + 1, np.int32)
    np.add.at(diff, starts, 1)
    np.subtract.at(diff, np.minimum(starts + width, n), 1)
    return np.cumsum(diff[:-1]) > 0
