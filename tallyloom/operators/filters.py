"""Filters, searches and pages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def directory_filter(df: DataFrame, **wanted) -> DataFrame:
    """Rows equal to every given value; None and values that begin with "All " don't filter."""
    used = [F.col(c) == v for c, v in wanted.items() if v is not None and not str(v).startswith("All ")]
    return df.where(reduce(Column.__and__, used, F.lit(True)))


def contains_any(df: DataFrame, term: str | None, *columns: str) -> DataFrame:
    """Rows where any of the columns holds the term, letter case aside; an empty term keeps all."""
    if not term:
        return df
    return df.where(reduce(Column.__or__, [F.coalesce(F.lower(c).contains(term.lower()), F.lit(False)) for c in columns]))


def global_search(term: str, sources: list[tuple[str, DataFrame, str, list[str]]], most: int = 50) -> DataFrame:
    """(entity, id, title) of the first ``most`` hits, by id, of each (entity, table, id column, text columns)."""
    found = [
        contains_any(df, term, *columns).orderBy(key).limit(most).select(F.lit(entity).alias("entity"), F.col(key).cast("string").alias("id"), F.col(columns[0]).alias("title"))
        for entity, df, key, columns in sources
    ]
    return reduce(DataFrame.unionByName, found)


def page(df: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """One page of the ordered rows, each with the total of all rows."""
    total = df.agg(F.count("*").alias("total_rows"))
    return df.orderBy(*order).offset((number - 1) * size).limit(size).crossJoin(F.broadcast(total))


def flagged(df: DataFrame, flag: str | None, allowed: set[str]) -> DataFrame:
    """Rows whose flag is set; flags that aren't allowed don't filter."""
    return df.where(F.coalesce(F.col(flag), F.lit(False))) if flag in allowed else df


def displayed(c: Column, names: dict[str, str]) -> Column:
    """The display name of a stored value; values without one stay."""
    pairs = [F.lit(x) for kv in names.items() for x in kv]
    return F.coalesce(F.create_map(*pairs)[c], c)


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).where(F.col(column).isNotNull()).distinct()


def visible_rows(df: DataFrame, role: str, me, member: str, anonymous: Column, name: str) -> DataFrame:
    """Own rows for employees, all for others; names of anonymous rows are hidden."""
    own = df.where(F.col(member) == me) if role == "Employee" else df
    return own.withColumn(name, F.when(~anonymous, F.col(name)))


def bumped_priority(rank: Column, at_risk: Column, highest: int = 2) -> Column:
    """The rank, one level up (``highest`` at most) for rows at risk."""
    return F.least(rank + F.when(at_risk, 1).otherwise(0), F.lit(highest))


def relevance(name: Column, category: Column, term: str) -> Column:
    """100 exact, 80 prefix, 60 word prefix, 40 contained, 10 category only, else 0."""
    t, n = term.lower(), F.lower(name)
    return F.when(n == t, 100).when(n.startswith(t), 80).when(n.contains(" " + t), 60).when(n.contains(t), 40).when(F.lower(category).contains(t), 10).otherwise(0)


def latest_by_key(df: DataFrame, key: str, order: list[Column], keep: int) -> DataFrame:
    """The first ``keep`` rows of each key in the order given."""
    ranked = df.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    return ranked.where(F.col("__n") <= keep).drop("__n")
