"""Line splitting, number parsing and glob matching."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.functions.keys import col


def lines(df: DataFrame, text: str) -> DataFrame:
    """One row per line with its number; line ends of either kind."""
    return df.withColumn("__l", F.split(F.regexp_replace(col(text), "\r\n?", "\n"), "\n", -1)).select(
        *[c for c in df.columns if c != text], F.posexplode("__l").alias("line_no", "line"))


def parse_float(c) -> Column:
    return F.expr("try_cast(trim(`{0}`) as double)".format(c)) if isinstance(c, str) else c.try_cast("double")


def parse_int(c) -> Column:
    return F.expr("try_cast(trim(`{0}`) as bigint)".format(c)) if isinstance(c, str) else c.try_cast("bigint")


def parse_floats(c, sep: str = r"[\s,;]+") -> Column:
    """Numbers of a delimited string; pieces that are none become null."""
    return F.transform(F.filter(F.split(F.trim(col(c)), sep), lambda s: s != ""), lambda s: s.try_cast("double"))


def glob_regex(pattern: str, prefix: bool = False, ignore_case: bool = False) -> str:
    """``*`` any run, ``?`` one character, backslash quotes; ``prefix`` leaves the end open."""
    out, i = [], 0
    while i < len(pattern):
        ch = pattern[i]
        if ch == "*":
            out.append(".*")
        elif ch == "?":
            out.append(".")
        elif ch == "\\":
            i += 1
            if i == len(pattern):
                return r"(?!)"
            out.append(re.escape(pattern[i]))
        else:
            out.append(re.escape(ch))
        i += 1
    return ("(?is)" if ignore_case else "(?s)") + r"\A" + "".join(out) + ("" if prefix else r"\z")


def glob(c, pattern: str, prefix: bool = False, ignore_case: bool = False) -> Column:
    return col(c).rlike(glob_regex(pattern, prefix, ignore_case))
