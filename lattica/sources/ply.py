"""ASCII PLY point clouds as distributed text, in one file or in parts whose names are in order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a file, or of all parts of one in the order of their paths, with their number.

    Row ids run on inside a split, so a split's first id and the line counts of the
    splits before it give the number.  Only that table, one row per split, is
    broadcast.
    """
    raw = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("id"), F.col("_metadata.file_path").alias("file"),
                                       F.col("_metadata.file_block_start").alias("at"))
    per = raw.groupBy("file", "at").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    splits = sorted((r["file"], r["at"], r["first"], r["n"]) for r in per.collect())
    rows, before = [], 0
    for file, at, first, n in splits:
        rows.append((file, at, first, before))
        before += n
    table = spark.createDataFrame(rows, "file string, at bigint, first bigint, before bigint")
    return raw.join(F.broadcast(table), ["file", "at"]).select("value", (F.col("id") - F.col("first") + F.col("before")).alias("line"))


def write(points: DataFrame, path: str, at: tuple[str, str, str] = ("px", "py", "pz")) -> str:
    """Points as PLY in parts, written side by side in a new folder; returns the pattern that ``read`` takes."""
    spark = points.sparkSession
    lines = points.select(F.concat_ws(" ", *[F.col(c).cast("double").cast("string") for c in at]).alias("value"))
    head = ["ply", "format ascii 1.0", f"element vertex {lines.count()}", *[f"property double {c}" for c in "xyz"], "end_header"]
    spark.createDataFrame([("\n".join(head),)], "value string").coalesce(1).write.text(f"{path}/0-header")
    lines.write.text(f"{path}/1-vertices")
    return f"{path}/*"


def header(spark: SparkSession, path: str) -> tuple[int, int]:
    """(vertex count, line number of the first vertex), however long the header is."""
    text, line = F.trim("value"), F.col("line")
    element = F.regexp_extract(text, r"^element\s+vertex\s+(\d+)", 1)
    r = numbered_lines(spark, path).agg(
        F.max(F.when(line == 0, text)).alias("magic"), F.min(F.when(text == "end_header", line)).alias("end"),
        F.min(F.when(element != "", F.struct(line.alias("line"), element.cast("bigint").alias("count")))).alias("vertex")).first()
    if r["magic"] != "ply":
        raise ValueError(f"{path} is not a PLY file")
    if r["end"] is None or r["vertex"] is None or r["vertex"]["line"] > r["end"]:
        raise ValueError(f"{path} has no vertex header")
    return r["vertex"]["count"], r["end"] + 1


def read(spark: SparkSession, path: str) -> DataFrame:
    """Vertices (pid, px, py, pz); further properties of a vertex line are ignored."""
    count, start = header(spark, path)
    body = numbered_lines(spark, path).where((F.col("line") >= start) & (F.col("line") < start + count))
    part = F.split(F.trim("value"), r"\s+")
    return body.select((F.col("line") - start).alias("pid"), *[part[i].cast("double").alias(p) for i, p in enumerate(("px", "py", "pz"))])
