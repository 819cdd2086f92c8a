"""Bind the relational test tables to the roles the operators expect.

Every binding is one scan with pushed-down columns; the SQL text beside each one
says the same thing for the oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.schema import Grid

PRICE_FULL = 104999.7


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def grid_for(spark: SparkSession, folder: str, bsx: int, n_levels: int = 3) -> Grid:
    """Domain: one x cell per four part keys, 16 cells in y and z."""
    top = table(spark, folder, "part").agg(F.max("p_partkey")).first()[0]
    return Grid.covering(int(top) // 4 + 1, 16, 16, bsx, n_levels)


def grid_sql(bsx: int) -> str:
    return f"""grid AS (SELECT CAST(((max(p_partkey) // 4) + {bsx}) // {bsx} AS BIGINT) AS nbx,
      CAST({16 // bsx} AS BIGINT) AS nby, CAST({16 // bsx} AS BIGINT) AS nbz,
      CAST(((max(p_partkey) // 4) + {bsx}) // {bsx} * {bsx} AS BIGINT) AS sx FROM part)"""


def points(spark: SparkSession, folder: str) -> DataFrame:
    """Point cloud with a mass."""
    return table(spark, folder, "lineitem").select(
        (F.col("l_partkey") * 0.25).alias("px"),
        (F.col("l_quantity") * 0.25).alias("py"),
        (F.col("l_extendedprice") / 6600.0).alias("pz"),
        F.col("l_extendedprice").alias("mass"),
    )


POINTS_SQL = """points AS (SELECT CAST(l_partkey AS DOUBLE) * 0.25e0 AS px, l_quantity * 0.25e0 AS py,
      l_extendedprice / 6600e0 AS pz, l_extendedprice AS mass FROM lineitem)"""


def cells(spark: SparkSession, folder: str) -> DataFrame:
    """Two channels on integer cells; a lies in [0,1], b is a whole number."""
    li = table(spark, folder, "lineitem")
    step = lambda c: F.floor(F.col(c) * 100.0 + 0.5).cast("bigint")
    return (
        li.groupBy(
            F.shiftright("l_partkey", 2).alias("x"),
            step("l_discount").alias("y"),
            step("l_tax").alias("z"),
        )
        .agg((F.avg("l_extendedprice") / PRICE_FULL).alias("a"), F.sum("l_quantity").alias("b"))
    )


CELLS_SQL = """cells AS (SELECT l_partkey >> 2 AS x, CAST(floor(l_discount * 100e0 + 0.5e0) AS BIGINT) AS y,
      CAST(floor(l_tax * 100e0 + 0.5e0) AS BIGINT) AS z,
      avg(l_extendedprice) / 104999.7e0 AS a, sum(l_quantity) AS b FROM lineitem GROUP BY 1, 2, 3)"""


def series(spark: SparkSession, folder: str) -> DataFrame:
    """One series per user; the event id settles equal instants."""
    return table(spark, folder, "events").select(
        F.col("user_id").alias("k"), "ts", "event_id", F.col("value").alias("v")
    )


SERIES_SQL = """s AS (SELECT user_id AS k, event_id, value AS v,
      row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i FROM events)"""


def samples(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select(F.col("event_type").alias("g"), F.col("value").alias("v"))


SAMPLES_SQL = "samples AS (SELECT event_type AS g, value AS v FROM events)"


def vectors(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("e"))


VECTORS_SQL = "vectors AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings)"
