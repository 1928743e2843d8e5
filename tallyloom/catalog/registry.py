"""Queries by name, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallyloom.sources.tables import Catalog

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers ``build(catalog)`` under ``name``."""

    def register(build: Callable[[Catalog], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: build(Catalog(spark, sf_dir))
        if sql:
            ORACLES[name] = sql
        return build

    return register
