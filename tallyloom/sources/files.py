"""Files of results: CSV in a global order, with cells that a spreadsheet would run made plain text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions.text import guard_formula


def write_csv(df: DataFrame, path: str, order: list[str] | None = None, files: int | None = None) -> None:
    """``df`` as CSV files with a header under ``path``; with ``order``, the files one after the other are in that order.

    Rows are dealt to files by ranges of the order and sorted within, so no task sorts the whole table; there are ``files`` of them, or as many as the session makes.  Texts that begin
    like a formula get an apostrophe before them.
    """
    safe = df.select(*(guard_formula(F.col(c)).alias(c) if t == "string" else F.col(c) for c, t in df.dtypes))
    if order:
        safe = (safe.repartitionByRange(files, *order) if files else safe.repartitionByRange(*order)).sortWithinPartitions(*order)
    safe.write.mode("overwrite").option("header", True).option("escape", '"').option("quoteAll", False).csv(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of such files, and ``part``, the number of the file that holds them."""
    rows = spark.read.schema(schema).option("header", True).option("escape", '"').option("multiLine", True).csv(path)
    return rows.withColumn("part", F.regexp_extract(F.col("_metadata.file_name"), r"part-([0-9]+)", 1).cast("int"))
