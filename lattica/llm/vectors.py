"""What the vector operators share: usable rows, equal vectors as one class, and query blocks against row parts."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.llm import common as C


def usable(df: DataFrame, id_col: str, vec_col: str, *more: Column) -> DataFrame:
    """(vec_id, vec array<double>, ...) of the rows whose vector is there and finite; a null id becomes NO_ID."""
    v = F.col(vec_col)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return df.where(v.isNotNull() & F.coalesce(fine, F.lit(False))).select(
        F.coalesce(F.col(id_col).cast("bigint"), F.lit(C.NO_ID)).alias("vec_id"), v.cast("array<double>").alias("vec"), *more)


def classes(rows: DataFrame, by: list[str], keep: int) -> DataFrame:
    """One row per distinct ``by``: its ``keep`` smallest ids in order; equal rows count once.

    Ids are ranked per map task first, so a vector that a third of the rows share sends few of them.
    """
    once = rows.groupBy(*by, "vec_id").agg(F.lit(1).alias("one"))
    w = Window.partitionBy(*by).orderBy("vec_id")
    few = once.withColumn("r", F.row_number().over(w)).where(F.col("r") <= keep)
    return few.groupBy(*by).agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))


def restore(col: str) -> Column:
    return F.when(F.col(col) != C.NO_ID, F.col(col))


def matrix(col: pa.ChunkedArray, dtype=np.float64) -> np.ndarray:
    """A list column as one row each; shorter vectors end in zeros."""
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    if isinstance(col, pa.ChunkedArray):
        col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], col.type)
    n = col.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(dtype, copy=False)
    width = int(n.max()) if len(n) else 0
    if len(n) and (n == width).all():
        return flat.reshape(len(n), width)
    out = np.zeros((len(n), width), dtype)
    row = np.repeat(np.arange(len(n)), n)
    out[row, np.arange(len(flat)) - np.repeat(np.r_[0, np.cumsum(n)][:-1], n)] = flat
    return out


def same_width(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    w = max(a.shape[1], b.shape[1])
    return tuple(np.pad(x, ((0, 0), (0, w - x.shape[1]))) if x.shape[1] < w else x for x in (a, b))


def meet(rows: DataFrame, n_parts: int, queries: DataFrame, n_blocks: int, run: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """Every block of queries (column ``block``) with every part of rows (column ``part``), one task call for each two.

    Both are of bounded size, so each call is; a row travels once per block and a query once per part.
    """
    left = rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    right = queries.toDF(*queries.columns).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(n_parts - 1))))
    return left.groupBy("part", "block").cogroup(right.groupBy("part", "block")).applyInArrow(run, schema)


def dealt(key: str, n: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
