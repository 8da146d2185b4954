"""Queries by name, each with the SQL that an oracle runs over the same tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quire.sources import derived

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """Derived and plain tables as attributes, loaded when asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str, whole: bool = False):
        self.spark, self.sf_dir, self.whole = spark, sf_dir, whole

    def __getattr__(self, name: str) -> DataFrame:
        return derived.load(self.spark, self.sf_dir, name, self.whole)


def query(name: str, *tables: str, sql: str | None = None):
    """Register f(tables) under a name. tables: those derived tables that the SQL names.

    What reads a table of derived.WHOLE is registered once more, as NAME_whole, over the whole text of every document."""

    def add(f: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            ORACLES[name] = derived.oracle(sql, *tables) if tables else sql
        if derived.WHOLE.keys() & set(tables):
            QUERIES[f"{name}_whole"] = lambda spark, sf_dir: f(Tables(spark, sf_dir, whole=True))
            if sql:
                ORACLES[f"{name}_whole"] = derived.oracle(sql, *tables, whole=True)
        return f

    return add
