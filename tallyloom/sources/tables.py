"""The catalog of supplied tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


class Catalog:
    """Tables of a folder by name: ``Catalog(spark, folder).orders``."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def append_new(df: DataFrame, target: DataFrame, keys: list[str]) -> DataFrame:
    """Target rows, and those of ``df`` whose keys the target doesn't have."""
    return target.unionByName(df.join(target.select(*keys), keys, "left_anti"))
