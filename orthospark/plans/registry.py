"""Where queries register themselves, with the SQL of the same result."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import fixtures

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Views:
    """The base tables and derived views of one data folder, by name."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in fixtures.SPARK:
            return fixtures.SPARK[name](self)
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


def with_views(sql: str) -> str:
    """SQL that defines the derived views that it names."""
    needed: list[str] = []

    def need(text: str) -> None:
        for name, body in fixtures.SQL.items():
            if re.search(rf"\b{name}\b", text) and name not in needed and body is not text:
                need(body)
                needed.append(name)

    need(sql)
    views = ", ".join(f"{name} as ({fixtures.SQL[name]})" for name in needed)
    if not views:
        return sql
    rest = re.match(r"\s*with\s+(recursive\s+)?(.*)", sql, re.S | re.I)
    return f"with {rest[1] or ''}{views}, {rest[2]}" if rest else f"with {views} {sql}"


def query(sql: str | None = None):
    """Registers a function of Views under its own name."""

    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Views(spark, sf_dir))
        if sql:
            ORACLES[f.__name__] = with_views(sql)
        return f

    return add
