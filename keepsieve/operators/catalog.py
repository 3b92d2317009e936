"""Queries of the core library, by name, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keepsieve.functions.timestamps import normalise_timestamps
from keepsieve.plans.runtime import read_table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a function as a query under its own name, with its SQL where there is one."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query()
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Bookmarks whose created_at names exactly one instant, with that instant."""
    items = read_table(spark, d, "bookmark").select("id", "collection", "created_at")
    found = normalise_timestamps(items, read_table(spark, d, "origin"))
    return found.where("created_ms is not null").select(F.col("id").alias("bookmark"), "created_ms")


@query()
def p5_finding(spark: SparkSession, d: str) -> DataFrame:
    """Every bookmark with its instant, or null where the text names none."""
    items = read_table(spark, d, "bookmark").select("id", "collection", "created_at")
    return normalise_timestamps(items, read_table(spark, d, "origin")).select(F.col("id").alias("bookmark"), "created_at", "created_ms")
