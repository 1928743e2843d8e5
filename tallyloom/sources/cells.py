"""Nested JSON documents of tables, as one table of cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "type string, source string, verified boolean, tables array<struct<page:int, grid:array<array<string>>>>"


def load_cells(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """(doc_id, table_id, page, row_ix, col_ix, raw) of all JSON files under ``path``.

    A file is one document, named by its last path part; or with ``lines`` each line is one, named by its own ``doc_id``,
    so that many documents share a file that Spark can split.  Rows may be ragged; empty tables and null cells give no
    rows and null values.
    """
    if lines:
        named = spark.read.schema(f"doc_id string, {SCHEMA}").json(path).select("doc_id", "tables")
    else:
        named = spark.read.schema(SCHEMA).option("multiLine", True).json(path).select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)$", 1).alias("doc_id"), "tables")
    docs = named.select("doc_id", F.posexplode("tables").alias("t", "table"))
    rows = docs.select("doc_id", F.concat_ws("-", F.lit("t"), F.col("t").cast("string")).alias("table_id"), F.col("table.page").alias("page"), F.posexplode("table.grid").alias("row_ix", "row"))
    return rows.select("doc_id", "table_id", "page", "row_ix", F.posexplode("row").alias("col_ix", "raw"))


def save_layouts(cells: DataFrame, path: str) -> None:
    """Cells (doc_id, page, row_ix, col_ix, raw) as JSON lines of documents, a table a page; a document is one task's row."""
    rows = cells.groupBy("doc_id", "page", "row_ix").agg(F.transform(F.array_sort(F.collect_list(F.struct("col_ix", "raw"))), lambda c: c["raw"]).alias("row"))
    pages = rows.groupBy("doc_id", "page").agg(F.transform(F.array_sort(F.collect_list(F.struct("row_ix", "row"))), lambda r: r["row"]).alias("grid"))
    docs = pages.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page", "grid"))).alias("tables"))
    docs.select("doc_id", F.lit("bill").alias("type"), F.lit("scan").alias("source"), F.lit(False).alias("verified"), "tables").write.mode("overwrite").json(path)
