"""Small helpers that the text operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_KEY = "spark.checkpoint.dir"

#: ASCII white space that separates words: space and \x09 to \x0D.
SPACES = " \t\n\x0b\f\r"

#: Lower-cases the bytes A-Z and leaves all others, so UTF-8 stays valid.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    A cluster names it in ``spark.checkpoint.dir``.  Only where that is unset (a
    local session, as in tests) is a temporary folder made and recorded.
    """
    found = spark.conf.get(CHECKPOINT_KEY, None)
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {CHECKPOINT_KEY} to a folder that driver and executors share")
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set(CHECKPOINT_KEY, found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a table in the shared folder: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.written_to = path
    return table


def released(*tables: DataFrame) -> None:
    """Deletes ``written`` tables that nothing reads any more: what was made of them is itself written."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table.written_to)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Bytes that may be broadcast; more are joined by a shuffle.
BROADCAST_BYTES = 32 << 20


def small(df: DataFrame) -> DataFrame:
    """``df``, a written table, marked for broadcast if its values, summed over all rows, are few bytes."""
    sizes = [F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) + 8 if t in ("string", "binary") else F.lit(16) for c, t in df.dtypes]
    total = df.agg(F.sum(sum(sizes[1:], sizes[0])).alias("bytes")).first()["bytes"]
    flat = not any(t.startswith(("array", "map", "struct")) for _, t in df.dtypes)
    return F.broadcast(df) if flat and (total or 0) <= BROADCAST_BYTES else df


def text_of(column: str = "text"):
    """The text column with null read as the empty text."""
    return F.coalesce(F.col(column), F.lit(""))


def numbered(df: DataFrame) -> DataFrame:
    """``df`` with columns in_0, in_1 and so on, so that an operator's working columns meet no name of the input's."""
    return df.toDF(*(f"in_{i}" for i in range(len(df.columns))))


def named_again(names: list[str], *added: str) -> list[Column]:
    """The columns of ``numbered`` under their ``names`` and then the ``added`` ones, which replace input columns of their names in any case."""
    new = {a.lower() for a in added}
    return [*(F.col(f"in_{i}").alias(n) for i, n in enumerate(names) if n.lower() not in new), *map(F.col, added)]
