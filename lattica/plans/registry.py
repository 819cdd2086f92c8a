"""Catalogue of runnable queries and, where SQL can say it, their oracle text."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Build = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    covers: str
    build: Build
    sql: str | None


CATALOGUE: dict[str, Query] = {}


def query(name: str, covers: str, sql: str | None = None) -> Callable[[Build], Build]:
    def keep(fn: Build) -> Build:
        if name in CATALOGUE:
            raise ValueError(f"duplicate query {name}")
        CATALOGUE[name] = Query(name, covers, fn, sql)
        return fn

    return keep


def catalogue() -> dict[str, Query]:
    from lattica.plans import load_all

    load_all()
    return CATALOGUE
