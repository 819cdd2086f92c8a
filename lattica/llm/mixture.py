"""Mixing sources to target weights by subset sums over exact document lengths.

Documents are counted by (source, length).  Per source, whole copies come first, then
the same share of every length, then a bounded knapsack over what lengths are left
spends the remaining budget.  Which documents of a length are taken follows from a seeded
hash; a crowded length is dealt to hash buckets, and only the bucket on the border is
ranked.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattica.llm import common as C

KNAPSACK_WORDS = 1 << 16
"""Budget that the dynamic programme covers; more than that is first spent on the longest lengths that fit."""
HASH_BUCKETS = 1024


def targets(per_source: DataFrame, weights: tuple[float, ...], share: float, limit: float) -> DataFrame:
    """Add ``target`` to rows (source, source_size), one per source.

    Weights repeat over the sources in code point order, null last.  A target is
    min(limit * size, level * weight) for the one level at which the targets add up: what a
    capped source can't take is shared by weight among the others.
    """
    one = Window.partitionBy(F.lit(0))  # one row per source
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]),
                     ((F.row_number().over(one.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights) + 1).cast("int"))
    cap = F.col("source_size") * F.lit(float(limit))
    at = per_source.withColumn("w", w).withColumn("cap", cap).withColumn("ratio", F.col("cap") / F.col("w"))
    up = one.orderBy("ratio", F.col("source").asc_nulls_last())
    before = up.rowsBetween(Window.unboundedPreceding, -1)
    budget = F.sum(F.col("source_size")).over(one) * F.lit(float(share))
    level = (budget - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (
        F.sum("w").over(one) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    at = at.withColumn("level", level).withColumn("free", F.min(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(
        up.rowsBetween(Window.unboundedPreceding, 0)))
    # sources up to the first one whose level is under its cap are capped; that level holds for all others
    settled = F.first("free", ignorenulls=True).over(up.rowsBetween(Window.unboundedPreceding, 0))
    return at.withColumn("target", F.when(settled.isNull(), F.col("cap")).otherwise(F.least("cap", settled * F.col("w")))).select(
        *per_source.columns, "target")


def fit_budget(sizes: list[int], counts: list[int], budget: int) -> list[int]:
    """How many documents of each length add up to the budget, or as near as is found."""
    total = sum(s * n for s, n in zip(sizes, counts))
    if budget <= 0 or total == 0:
        return [0] * len(sizes)
    if budget >= total:
        return list(counts)
    take = [n * budget // total for n in counts]
    left = budget - sum(s * k for s, k in zip(sizes, take))
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        if left <= KNAPSACK_WORDS:
            break
        more = min(counts[i] - take[i], left // sizes[i]) if sizes[i] else 0
        take[i] += more
        left -= more * sizes[i]
    # bounded knapsack: bit b of reach is set if b words can be spent; counts split into powers of two
    reach, steps, mask = 1, [], (1 << (2 * left + 1)) - 1  # twice the budget is as far off as nothing
    for i in sorted(range(len(sizes)), key=lambda i: sizes[i]):
        room, chunk = counts[i] - take[i], 1
        while room > 0 and 0 < sizes[i] * min(chunk, room) <= 2 * left and not reach >> left & 1:
            c = min(chunk, room)
            steps.append((i, c, reach))
            reach |= (reach << (sizes[i] * c)) & mask
            room, chunk = room - c, chunk * 2
    under = (reach & ((1 << (left + 1)) - 1)).bit_length() - 1
    above = reach >> left
    over = left + (above & -above).bit_length() - 1 if above else 2 * left + 1
    spent = over if over - left < left - under else under
    for i, c, earlier in reversed(steps):
        if not earlier >> spent & 1:
            take[i] += c
            spent -= sizes[i] * c
    return take


def _fit(pdf: pd.DataFrame) -> pd.DataFrame:
    size, n, target = pdf["size"].tolist(), pdf["n"].tolist(), float(pdf["target"].iloc[0])
    total = sum(s * k for s, k in zip(size, n))
    whole = int(target // total) if total else 0
    extra = fit_budget(size, n, round(target) - whole * total)
    return pd.DataFrame({"key": pdf["key"], "size": pdf["size"], "whole": whole, "extra": extra})


def mix(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, limit: int = 2, seed: int = 7,
        id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken) of every row.

    ``copies`` is how often the mix takes the document (0 to ``limit``), ``taken`` the words
    that makes.  Null texts have no words and are never taken; null is a source of its
    own.  Rows with equal ids are separate documents.  Reruns agree.
    """
    order = F.xxhash64(F.lit(seed), F.coalesce(F.col(id_col).cast("bigint"), F.xxhash64(text_col)))
    key = F.coalesce(F.concat(F.lit("s"), F.col(source_col)), F.lit("n"))
    slim = C.settle(docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"), F.col(source_col).alias("source"), key.alias("key"),
        F.coalesce(F.regexp_count(text_col, F.lit(C.WORD)), F.lit(0)).cast("bigint").alias("size"), order.alias("h")))
    binned = slim.withColumn("bin", F.pmod("h", F.lit(HASH_BUCKETS)))
    bins = binned.groupBy("key", "source", "size", "bin").agg(F.count("*").alias("n"))
    hist = bins.groupBy("key", "source", "size").agg(F.sum("n").alias("n"))
    per_source = hist.groupBy("key", "source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    aims = targets(per_source, tuple(weights), share, limit).select("key", "source_size", "target")
    fitted = hist.join(aims, "key").select("key", "size", "n", "target").groupBy("key").applyInPandas(
        _fit, "key string, size bigint, whole int, extra bigint")
    before = Window.partitionBy("key", "size").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    dealt = bins.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).join(fitted, ["key", "size"]).join(aims, "key").select(
        "key", "size", "bin", "whole", "source_size", "target",
        F.least(F.greatest(F.col("extra") - F.col("before"), F.lit(0)), "n").alias("quota"), "n")
    joined = binned.join(dealt, ["key", "size", "bin"])
    place = F.row_number().over(Window.partitionBy("key", "size", "bin").orderBy("h", "doc_id"))
    copies = F.when(F.col("size") == 0, 0).otherwise(F.col("whole") + (place <= F.col("quota")).cast("int"))
    return joined.withColumn("copies", copies).select(
        "doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))
