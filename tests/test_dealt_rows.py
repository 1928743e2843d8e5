"""Rows that are dealt by their keys once meet within their keys without being shuffled again."""

from decimal import Decimal

from pyspark.sql import functions as F

from tallyloom.plans import reconcile
from tallyloom.sources.shared import dealt, kept_together


def test_dealt_rows_meet_without_a_shuffle(spark):
    name = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(name)
    rows = [(d, i, Decimal(100 + 7 * i), Decimal(5), i) for d in range(20) for i in range(6)]
    trusted = dealt(spark.createDataFrame(rows, "doc long, i long, amount decimal(18,2), rate decimal(18,2), qty int"), ["doc"])
    noisy = dealt(trusted.select("doc", F.col("i").alias("j"), F.lit(1).alias("page"), *(F.col(c).cast("string").alias(f"{c}_raw") for c in ("amount", "rate", "qty"))), ["doc"])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    with kept_together(spark):
        pairs = reconcile.scored_pairs(trusted, noisy, ["doc"])
        plan = pairs._jdf.queryExecution().executedPlan().toString()
        found = {(r.doc, r.i, r.j): float(r.score) for r in pairs.collect()}
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    assert spark.conf.get(name) == before
    assert all(found[d, i, i] == 1.0 for d in range(20) for i in range(6))
