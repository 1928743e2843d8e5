"""Approved overrides of rows, kept as versions of a table in a shared folder.

A version is a folder with a manifest: which parts it consists of and where each lies.  Rows are in parts by a hash of
their key.  Applying approvals rewrites the parts that they touch and no other; what is already as approved stays, so a
second application makes no version.  Each row holds its original value, its version and who approved it from where.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F



class VersionedTable:
    """A table of (key, value) under ``folder`` with all its versions."""

    def __init__(self, spark: SparkSession, folder: str, key: str, value: str, parts: int = 16):
        self.spark, self.folder, self.key, self.value, self.parts = spark, folder.rstrip("/"), key, value, parts

    def _path(self, *names: object):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.folder, *map(str, names)]))

    def _files(self):
        return self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def latest(self) -> int:
        """The last version with a manifest; 0 if there is none."""
        files = self._files()
        if not files.exists(self._path("manifests")):
            return 0
        return max((int(s.getPath().getName()) for s in files.listStatus(self._path("manifests")) if s.getPath().getName().isdigit()), default=0)

    def manifest(self, version: int) -> dict[int, int]:
        """Part number to the version that wrote it."""
        found = self.spark.read.text(str(self._path("manifests", version))).first()[0]
        return {int(p): v for p, v in json.loads(found).items()}

    def _part(self, df: DataFrame) -> DataFrame:
        return df.withColumn("part", F.pmod(F.xxhash64(F.col(self.key)), F.lit(self.parts)).cast("int"))

    def _written(self, rows: DataFrame, version: int, kept: dict[int, int]) -> None:
        # Parts first, the manifest last and under its own name at once: a run that fails leaves no version behind.
        rows.repartition("part").write.mode("overwrite").partitionBy("part").parquet(f"{self.folder}/data/{version}")
        new = [r.part for r in self.spark.read.parquet(f"{self.folder}/data/{version}").select("part").distinct().collect()]  # ``parts`` rows at most
        said = json.dumps(kept | {p: version for p in new})
        waiting, ready = self._path("manifests", f".{version}"), self._path("manifests", version)
        self.spark.createDataFrame([(said,)], "m string").coalesce(1).write.mode("overwrite").text(str(waiting))
        if not self._files().rename(waiting, ready):
            raise RuntimeError(f"version {version} was written by another run")

    def begin(self, rows: DataFrame) -> None:
        """Version 1: every row as it is."""
        state = rows.select(self.key, self.value, F.lit(1).cast("long").alias("version"), F.col(self.value).alias("original"), F.lit(None).cast("string").alias("approved_by"), F.lit(None).cast("string").alias("source"))
        self._written(self._part(state), 1, {})

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, by default the last."""
        where = self.manifest(version or self.latest())
        out = None
        for v in sorted(set(where.values())):
            parts = [p for p, w in where.items() if w == v]
            rows = self.spark.read.parquet(f"{self.folder}/data/{v}").where(F.col("part").isin(parts))
            out = rows if out is None else out.unionByName(rows)
        return out

    def apply(self, approved: DataFrame) -> int:
        """The version that holds the ``approved`` rows (key, value, approved_by, source); a new one only if any row changes.

        A key that is approved twice takes the least value; keys that the table doesn't have change nothing.
        """
        now = self.latest()
        one = approved.groupBy(self.key).agg(F.min(F.struct(F.col(self.value).alias("v"), "approved_by", "source")).alias("new"))
        held = self.read(now)
        # The approvals are few beside the table: which parts they change is found by a join, and is ``parts`` rows at most.
        changed = F.col("new").isNotNull() & ~F.col(self.value).eqNullSafe(F.col("new.v"))
        joined = held.join(self._part(one), [self.key, "part"], "left")
        touched = [r.part for r in joined.where(changed).select("part").distinct().collect()]
        if not touched:
            return now
        rows = joined.where(F.col("part").isin(touched)).select(
            self.key,
            F.when(changed, F.col("new.v")).otherwise(F.col(self.value)).alias(self.value),
            (F.col("version") + changed.cast("long")).alias("version"),
            "original",
            F.when(changed, F.col("new.approved_by")).otherwise(F.col("approved_by")).alias("approved_by"),
            F.when(changed, F.col("new.source")).otherwise(F.col("source")).alias("source"),
            "part",
        )
        self._written(rows, now + 1, {p: v for p, v in self.manifest(now).items() if p not in touched})
        return now + 1
