"""Batch changes of tables: intake, updates, decisions, histories."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.plans.verify import reasons


def validated(df: DataFrame, *rules: tuple[Column, str]) -> DataFrame:
    """Rows with ``rejected_for``: the names of the rules they break."""
    return df.withColumn("rejected_for", reasons(*rules))


def applied(df: DataFrame, changes: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows with the changed values where there are any, and whether there were."""
    new = changes.select(key, *(F.col(c).alias(f"__{c}") for c in columns), F.lit(True).alias("changed"))
    joined = df.join(new, key, "left")
    return joined.withColumns({c: F.coalesce(f"__{c}", c) for c in columns} | {"changed": F.coalesce("changed", F.lit(False))}).drop(*(f"__{c}" for c in columns))


def decided(requests: DataFrame, key: str, order: list[str], amount: str, balance: str) -> DataFrame:
    """Grants requests in order while the key's balance lasts; a refusal uses nothing.

    A key's requests stream through a task in their order, which holds what is left of the balance only.  The balance is
    that of the key's first request; a null amount is refused, a null key has no balance to draw on and is left out.
    """
    schema = T.StructType([requests.schema[key], *(requests.schema[c] for c in order), T.StructField(amount, T.DoubleType()), T.StructField("granted", T.BooleanType()), T.StructField("__left", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, left = None, 0.0
        for batch in batches:
            granted, lefts = [], []
            for k, a, b in zip(*(batch.column(i).to_pylist() for i in (0, -2, -1)), strict=True):
                if k != at:
                    at, left = k, b or 0.0
                granted.append(a is not None and a <= left)
                if granted[-1]:
                    left -= a
                lefts.append(left)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(granted, pa.bool_()), pa.array(lefts, pa.float64())], names=schema.names)

    rows = requests.where(F.col(key).isNotNull()).select(key, *order, F.col(amount).cast("double"), F.col(balance).cast("double").alias("__balance"))
    done = rows.repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, schema)
    # What is left never rises, so the least is the last.
    return done.withColumn("balance_left", F.min("__left").over(Window.partitionBy(key))).drop("__left")


def weighted_pick(df: DataFrame, key: str, choices: list[tuple[str, int]], name: str) -> DataFrame:
    """A choice for each row by a stable hash of its key, in proportion to the weights."""
    total = sum(w for _, w in choices)
    place = F.pmod(F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 8), 16, 10).cast("long"), F.lit(total))
    picked, reach = None, 0
    for value, weight in choices:
        reach += weight
        picked = F.when(place < reach, value) if picked is None else picked.when(place < reach, value)
    return df.withColumn(name, picked)


def latest_state(history: DataFrame, key: str, order: list[str], state: str) -> DataFrame:
    """The last state of each key in an append-only history."""
    return history.groupBy(key).agg(F.max_by(state, F.struct(*order)).alias(state), F.count("*").alias("changes"))


def running_balance(df: DataFrame, key: str, order: list[str], amount: Column, name: str) -> DataFrame:
    return df.withColumn(name, F.sum(amount).over(Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
