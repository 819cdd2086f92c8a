"""Running totals, ranks and order statistics over groups of any size.

One plan serves every size.  Rows whose hash falls in a small share are a sample that is the
same in every run; a group with enough of them is cut into parts at every SAMPLES-th, so parts have
about the same size and their number grows with the group.  Cuts compare all order columns, of any
type, so strings and equal first values split like numbers.  Parts are ordered and totalled on
their own, and each gets what earlier parts of its group add up to.  No group has to fit one task,
null is a group like any other, and nothing runs before the result is asked for.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.functions.keys import col

GROUP_ROWS = 1 << 20
"""Rows of a part, and about the size up to which a group stays whole."""
SAMPLES = 16
"""Sampled rows of a part."""


def join_on(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on equal keys, null included; key columns come from the left."""
    if not keys:
        return left.join(F.broadcast(right), how=how if how != "inner" else "cross")  # one row without keys
    named = right.withColumnsRenamed({k: f"__right_{i}" for i, k in enumerate(keys)})
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__right_{i}")) for i, k in enumerate(keys)])
    return left.join(named, same, how).drop(*[f"__right_{i}" for i in range(len(keys))])


def in_parts(df: DataFrame, keys: list[str], order: list[str], rows: int) -> DataFrame:
    """Add ``__part``: nondecreasing in ``order``, null before all, about ``rows`` rows of a group each.

    The cuts travel to all tasks: one order tuple for about ``rows`` rows, of large groups only.
    """
    at = F.struct(*order)
    picked = df.where(F.pmod(F.xxhash64(*keys, *order), F.lit(max(1, rows // SAMPLES))) == 0)
    drawn = picked.groupBy(*keys).agg(F.sort_array(F.collect_set(at)).alias("__drawn")).where(F.size("__drawn") >= SAMPLES)
    every = lambda a, first, step: F.transform(F.sequence(first, F.size(a), step), lambda i: F.element_at(a, i.cast("int")))
    cuts = drawn.select(*keys, every("__drawn", F.lit(SAMPLES), F.lit(SAMPLES)).alias("__cuts"))
    cuts = cuts.withColumn("__step", F.ceil(F.sqrt(F.size("__cuts"))).cast("int")).withColumn("__heads", every("__cuts", F.lit(1), F.col("__step")))
    # among the heads of runs of cuts first, then inside one run
    ahead = F.size(F.filter("__heads", lambda c: c < at))
    inside = F.slice("__cuts", (ahead - 1) * F.col("__step") + 1, F.col("__step"))
    below = F.when(ahead == 0, 0).otherwise((ahead - 1) * F.col("__step") + F.size(F.filter(inside, lambda c: c < at)))
    part = F.when(F.col("__cuts").isNull(), 0).otherwise(below)
    return join_on(df, F.broadcast(cuts), keys, "left").withColumn("__part", part).drop("__cuts", "__heads", "__step")


def _prefixes(w, sums, maxima) -> dict[str, Column]:
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    out = {n: F.coalesce(F.sum(e).over(before), F.lit(0)) for n, e in sums.items()}
    out |= {n: F.max(e).over(before) for n, e in maxima.items()}
    return out


def running(df: DataFrame, keys: list[str], order: list[str], sums: dict[str, Column], *,
            maxima: dict[str, Column] | None = None, totals: dict[str, Column] | None = None,
            group_rows: int | None = None) -> DataFrame:
    """Add, per group and in order, totals and maxima of all *earlier* rows.

    ``sums``/``maxima`` name exclusive prefixes (0 / null on the first row);
    ``totals`` name whole-group sums.  ``order`` must be unique inside a group, or
    ties must not matter.
    """
    maxima, totals = maxima or {}, totals or {}
    # one exchange, read by the windows and by the totals of parts
    laid = in_parts(df, keys, order, group_rows or GROUP_ROWS).repartition(*keys, "__part")
    local = Window.partitionBy(*keys, "__part")
    cols = {f"__in_{k}": c for k, c in _prefixes(local.orderBy(*order), sums, maxima).items()}
    cols |= {f"__tot_{k}": F.sum(e).over(local) for k, e in totals.items()}
    inside = laid.withColumns(cols)

    part = laid.groupBy(*keys, "__part").agg(
        *[F.sum(e).alias(f"__s_{k}") for k, e in sums.items()],
        *[F.max(e).alias(f"__m_{k}") for k, e in maxima.items()],
        *[F.sum(e).alias(f"__t_{k}") for k, e in totals.items()],
        F.count("*").alias("__rows"),
    )
    # one row per part
    w = Window.partitionBy(*keys)
    before = w.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    carry = part.select(
        *keys, "__part", F.count("*").over(w).alias("__span"),
        *[F.coalesce(F.sum(f"__s_{k}").over(before), F.lit(0)).alias(f"__c_{k}") for k in sums],
        *[F.max(f"__m_{k}").over(before).alias(f"__c_{k}") for k in maxima],
        *[F.sum(f"__t_{k}").over(w).alias(f"__w_{k}") for k in totals],
    ).where("__span > 1").drop("__span")
    # only parts of groups that were cut, one for about GROUP_ROWS rows
    joined = join_on(inside, F.broadcast(carry), [*keys, "__part"], "left")
    out = {k: F.col(f"__in_{k}") + F.coalesce(f"__c_{k}", F.lit(0)) for k in sums}
    out |= {k: F.greatest(f"__in_{k}", f"__c_{k}") for k in maxima}
    out |= {k: F.coalesce(f"__w_{k}", f"__tot_{k}") for k in totals}
    return joined.withColumns(out).select(*df.columns, *out)


def value_counts(df: DataFrame, keys: list[str], value: str, extra: dict[str, Column] | None = None) -> DataFrame:
    """Distinct values with their multiplicity: copies of a hot value collapse early."""
    return df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(
        F.count("*").alias("c"), *[e.alias(k) for k, e in (extra or {}).items()])


def ranked_values(df: DataFrame, keys: list[str], value: str, group_rows: int | None = None) -> DataFrame:
    """Distinct values with count ``c``, rows before ``start``, group size ``n``, predecessor ``prev``."""
    return running(value_counts(df, keys, value), keys, [value], {"start": F.col("c")},
                   maxima={"prev": F.col(value)}, totals={"n": F.col("c")}, group_rows=group_rows)


def covers(position) -> Column:
    """Does a ranked value hold the 0-based sorted position?"""
    p = col(position)
    return (F.col("start") <= p) & (p < F.col("start") + F.col("c"))


def median(df: DataFrame, keys: list[str], value: str, group_rows: int | None = None) -> DataFrame:
    """Exact median; the mean of the two middle values when the count is even."""
    r = ranked_values(df, keys, value, group_rows)
    lo, hi = F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2)
    w = covers(lo).cast("int") + covers(hi).cast("int")
    return r.withColumn("__w", w).where("__w > 0").groupBy(*keys).agg((F.sum(F.col(value) * F.col("__w")) / 2).alias("median"))


def kth(df: DataFrame, keys: list[str], value: str, positions: list[Column | int], group_rows: int | None = None) -> DataFrame:
    """Values at 0-based sorted positions; positions may refer to the group size ``n``."""
    r = ranked_values(df, keys, value, group_rows)
    wanted = F.array(*[F.struct(F.lit(i).alias("q"), (p if isinstance(p, Column) else F.lit(p)).cast("bigint").alias("p"))
                       for i, p in enumerate(positions)])
    r = r.withColumn("__hit", F.filter(wanted, lambda s: (F.col("start") <= s["p"]) & (s["p"] < F.col("start") + F.col("c"))))
    return r.where(F.size("__hit") > 0).select(*keys, "n", value, F.explode("__hit").alias("h")).select(
        *keys, F.col("h.q").alias("q"), F.col("h.p").alias("p"), "n", value)


def average_rank(df: DataFrame, keys: list[str], value: str, group_rows: int | None = None) -> DataFrame:
    """1-based rank of each distinct value; copies share the mean of their places."""
    r = ranked_values(df, keys, value, group_rows)
    return r.select(*keys, value, F.col("c").alias("ties"), (F.col("start") + (F.col("c") + 1) / 2).alias("rank"))


def indexed(df: DataFrame, keys: list[str], order: list[str], group_rows: int | None = None) -> DataFrame:
    """Add the 0-based position ``i`` of each row in its group."""
    return running(df, keys, order, {"i": F.lit(1).cast("bigint")}, group_rows=group_rows)


def any_of(conds: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conds)
