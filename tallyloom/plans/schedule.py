"""Checks of schedule networks: edges, baselines, variance, summary nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def clean_edges(edges: DataFrame) -> DataFrame:
    """One edge for each (pred, succ, type), the one with the largest lag either way; no loops."""
    return edges.where("pred <> succ").groupBy("pred", "succ", "type").agg(F.max_by("lag", F.struct(F.abs("lag"), "lag")).alias("lag"))


def open_ends(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes without a predecessor, or without a successor."""
    before = edges.select(F.col("succ").alias("code")).distinct().withColumn("has_pred", F.lit(True))
    after = edges.select(F.col("pred").alias("code")).distinct().withColumn("has_succ", F.lit(True))
    joined = nodes.select("code").join(before, "code", "left").join(after, "code", "left")
    return joined.select("code", F.coalesce("has_pred", F.lit(False)).alias("has_pred"), F.coalesce("has_succ", F.lit(False)).alias("has_succ")).where("NOT has_pred OR NOT has_succ")


def relation_text(edges: DataFrame) -> DataFrame:
    """Per successor its predecessors as ``A10FS+3d``, in order, joined."""
    lag = F.when(F.col("lag") > 0, F.concat(F.lit("+"), F.col("lag").cast("string"), F.lit("d"))).when(F.col("lag") < 0, F.concat(F.col("lag").cast("string"), F.lit("d"))).otherwise("")
    token = F.concat(F.col("pred").cast("string"), F.col("type"), lag)
    return edges.groupBy("succ").agg(F.array_join(F.array_sort(F.collect_list(token)), "; ").alias("predecessors"))


def summary_nodes(leaves: DataFrame, path: str, start: str, finish: str) -> DataFrame:
    """Every proper prefix of the dotted paths with its leaves' first start and last finish: one grouping, no loop."""
    parts = F.split(path, r"\.")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "."))
    deep = leaves.where(F.size(parts) > 1).select(F.explode(prefixes).alias("node"), start, finish)
    return deep.groupBy("node").agg(F.min(start).alias("start"), F.max(finish).alias("finish"), F.count("*").alias("leaves"))


def chosen_baseline(df: DataFrame, columns: list[str]) -> DataFrame:
    """The best filled of several columns; ties go to the first."""
    counts = df.agg(*(F.count(c).alias(c) for c in columns))
    ranked = F.array(*(F.struct(F.col(c).alias("n"), F.lit(-i).alias("i"), F.lit(c).alias("c")) for i, c in enumerate(columns)))
    return counts.select(F.array_max(ranked)["c"].alias("baseline"), F.array_max(ranked)["n"].alias("filled"))


def ordered_outline(tasks: DataFrame) -> DataFrame:
    """Leaves (package, wbs, name, pos, start, finish) with their numbers, summary nodes, and an id in the order of the outline.

    A leaf's path gets .0001 and so on within its path and name.  A path has one summary, of the name that comes first in
    it, over the leaves of that name; each shorter path down to two parts has one over all summaries below it, named by
    its last part.  Ids run from 1 within a package, summaries before their leaves.
    """
    leaf = F.row_number().over(Window.partitionBy("package", "wbs", "name").orderBy("pos"))
    leaves = tasks.select("package", F.format_string("%s.%04d", "wbs", leaf).alias("wbs"), "name", F.lit(False).alias("is_summary"), "start", "finish", "pos")
    named = tasks.where((F.trim("name") != "") & F.col("name").isNotNull())
    groups = named.groupBy("package", "wbs", F.trim("name").alias("name")).agg(F.min("pos").alias("__first"), F.min("start").alias("start"), F.max("finish").alias("finish"))
    first = groups.withColumn("__n", F.row_number().over(Window.partitionBy("package", "wbs").orderBy("__first"))).where("__n = 1").drop("__n", "__first")
    parts = F.split("wbs", r"\.")
    above = first.withColumn("__p", parts).where(F.size("__p") > 2).select("package", F.explode(F.transform(F.sequence(F.lit(2), F.size("__p") - 1), lambda i: F.array_join(F.slice("__p", 1, i), "."))).alias("wbs"), "start", "finish")
    higher = above.groupBy("package", "wbs").agg(F.min("start").alias("start"), F.max("finish").alias("finish")).join(first, ["package", "wbs"], "left_anti")
    higher = higher.withColumn("name", F.element_at(parts, -1))
    columns = ["package", "wbs", "name", "start", "finish"]
    sums = first.select(columns).unionByName(higher.select(columns)).withColumns({"is_summary": F.lit(True), "pos": F.lit(-1).cast("long")})
    order = Window.partitionBy("package").orderBy("wbs", F.col("is_summary").desc(), "pos")
    return leaves.withColumn("pos", F.col("pos").cast("long")).unionByName(sums.select(leaves.columns)).withColumn("id", F.row_number().over(order))


def against_baseline(tasks: DataFrame, chosen: DataFrame, columns: list[str]) -> DataFrame:
    """``tasks`` (start, the baselines, total_float, native_critical) with ``variance`` in days against the chosen baseline, and ``critical``.

    ``chosen`` is the one row of ``chosen_baseline``.  Float decides what is critical; where it is unknown the task's own flag does.
    """
    both = tasks.crossJoin(F.broadcast(chosen.select("baseline")))
    base = None
    for c in columns:
        base = F.when(F.col("baseline") == c, F.col(c)) if base is None else base.when(F.col("baseline") == c, F.col(c))
    critical = F.when(F.col("total_float").isNull(), F.col("native_critical")).otherwise(F.col("total_float") <= 0)
    return both.withColumns({"variance": F.datediff("start", base), "critical": critical})
