"""Connected components over a table of links, without gathering any of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm import common as C


def _state(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("h")).first()
    return r["n"], r["h"]


def components(links: DataFrame) -> DataFrame:
    """(a, root) of every linked node that is not itself its component's smallest.

    ``links`` has bigint columns a and b; order, repeats and loops do not matter.
    Alternates large-star and small-star steps; rows are settled in the shared folder
    after each round.  Rounds grow with the logarithm of the longest path, and a node
    with many links is a skewed join key that adaptive execution splits, never a group.
    """
    edges = C.settle(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = _state(edges)
    while before[0]:
        # large star: everything above a node goes to the least node around it
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: a node and everything below it go to the least of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(low, "a")
        small = joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            low.select("a", F.col("m").alias("b"))).distinct()
        edges = C.settle(small)
        after = _state(edges)
        if after == before:
            break
        before = after
    return edges.select("a", F.col("b").alias("root"))
