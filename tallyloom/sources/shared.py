"""The folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """What ``spark.checkpoint.dir`` names; a temporary folder only where it is unset, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def with_checkpoints(spark: SparkSession) -> SparkSession:
    """The session, ready for ``checkpoint()``."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return spark


def dealt(df: DataFrame, keys: list[str]) -> DataFrame:
    """The rows as a table in the warehouse, bucketed by ``keys``: lineage ends, and what groups by them needs no shuffle."""
    spark = df.sparkSession
    name = f"dealt_{uuid.uuid4().hex}"
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.repartition(parts, *keys).write.bucketBy(parts, *keys).sortBy(*keys).format("parquet").saveAsTable(name)
    return spark.table(name)


#: Rows of a part, beyond which a table is dealt into more parts than the session's shuffles have.
PART_ROWS = 1 << 18


def in_parts(df: DataFrame, *keys: str, rows: int | None = None) -> DataFrame:
    """The rows dealt by ``keys`` into parts of about ``PART_ROWS``, so that what a task holds doesn't grow with the table.

    Where the session's own number of partitions gives no larger parts, the rows are left as they are.  ``rows`` saves
    counting what is no plain table.
    """
    parts = -(-(df.count() if rows is None else rows) // PART_ROWS)
    return df.repartition(parts, *keys) if parts > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def put_together(df: DataFrame, *keys: str) -> DataFrame:
    """The rows dealt by ``keys``, each key's in one partition, for a step that reads whole partitions.

    Dealt by a hash of their own: Spark leaves out a ``repartition`` by columns that the sides of a union are dealt by
    already, and merges the partitions of each side by themselves afterwards, so a key's rows would come apart.
    """
    return df.repartition(F.xxhash64(*keys))


@contextmanager
def kept_together(spark: SparkSession) -> Iterator[None]:
    """While it lasts, joins on more columns than their inputs are dealt by don't deal them anew; only for what is written meanwhile."""
    name = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)
