"""Joins beyond plain equality."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_defaults(left: DataFrame, right: DataFrame, on: str, defaults: dict) -> DataFrame:
    """Left join; the right side's columns fall back to their defaults."""
    joined = left.join(right, on, "left")
    return joined.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})


def overlapping(a: DataFrame, b: DataFrame, on: list[str], start: str, end: str, ids: tuple[str, str], bucket_days: int = 32) -> DataFrame:
    """Pairs of ``a`` and ``b`` rows that agree on ``on`` and whose closed date intervals meet.

    Intervals are dealt into buckets of days, so a key with very many rows is
    spread over its buckets; a pair is taken in the bucket where the later of the
    two begins, once.
    """

    def first(c: Column) -> Column:
        return F.floor(F.datediff(c, F.lit("1970-01-01")) / bucket_days)

    x = a.select(*on, F.col(ids[0]).alias("a_id"), F.col(start).alias("a_start"), F.col(end).alias("a_end"))
    y = b.select(*on, F.col(ids[1]).alias("b_id"), F.col(start).alias("b_start"), F.col(end).alias("b_end"))
    x = x.withColumn("bucket", F.explode(F.sequence(first(F.col("a_start")), first(F.col("a_end")))))
    y = y.withColumn("bucket", F.explode(F.sequence(first(F.col("b_start")), first(F.col("b_end")))))
    met = x.join(y, [*on, "bucket"]).where("a_start <= b_end AND b_start <= a_end")
    return met.where(F.col("bucket") == first(F.greatest("a_start", "b_start"))).drop("bucket")


def met_in_parts(few: DataFrame, many: DataFrame, on: list[str], row_id: str, parts: int = 16) -> DataFrame:
    """Pairs of ``few`` and ``many`` rows that agree on ``on``, where few keys have very many rows.

    The rows of ``many`` are dealt into parts of each key by ``row_id``, those of ``few`` meet each part, so a key's pairs
    are made by many tasks.
    """
    part = F.pmod(F.xxhash64(row_id), F.lit(parts)).cast("int")
    shuffles = int(many.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = many.withColumn("__part", part).repartition(shuffles, *on, "__part")
    each = few.withColumn("__part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    return each.join(dealt, [*on, "__part"]).drop("__part")


def near_repeats(df: DataFrame, keys: list[str], at: str, days: int, row_id: str) -> DataFrame:
    """Rows with another row of equal keys within so many days: a sorted row's nearest neighbours decide."""
    w = Window.partitionBy(*keys).orderBy(at, row_id)
    gaps = df.withColumn("__b", F.datediff(at, F.lag(at).over(w))).withColumn("__a", F.datediff(F.lead(at).over(w), at))
    return gaps.where((F.col("__b") <= days) | (F.col("__a") <= days)).drop("__a", "__b")


def heads(df: DataFrame, key: str, parent: str, org: str) -> DataFrame:
    """The first member (by key) of each org without a parent in the same org."""
    up = df.select(F.col(key).alias("__k"), F.col(org).alias("__org"))
    joined = df.join(up, df[parent] == up["__k"], "left")
    roots = joined.where(F.col("__org").isNull() | (F.col("__org") != F.col(org)))
    return roots.groupBy(org).agg(F.min(key).alias("head"))


def descendants(edges: DataFrame, root: str, node: str, depth: int) -> DataFrame:
    """(root, node, depth, path) down to ``depth`` levels of (parent, child) edges: one join a level."""
    level = edges.select(F.col(root).alias("root"), F.col(node).alias("node"), F.lit(1).alias("depth"), F.concat_ws("/", F.col(root), F.col(node)).alias("path"))
    out = level
    for d in range(2, depth + 1):
        step = edges.select(F.col(root).alias("node"), F.col(node).alias("__next"))
        level = level.join(step, "node").select("root", F.col("__next").alias("node"), F.lit(d).alias("depth"), F.concat_ws("/", "path", F.col("__next")).alias("path"))
        out = out.unionByName(level)
    return out


def bag_matches(a: DataFrame, b: DataFrame, value: str) -> DataFrame:
    """Per value, how many of ``a``, of ``b``, and how many pair up."""
    x = a.groupBy(value).agg(F.count("*").alias("n_a"))
    y = b.groupBy(value).agg(F.count("*").alias("n_b"))
    both = x.join(y, value, "full_outer").fillna(0, ["n_a", "n_b"])
    return both.withColumn("matched", F.least("n_a", "n_b"))


def scoped_rules(df: DataFrame, rules: DataFrame, scope: str, rule_scope: str) -> DataFrame:
    """Rows with the rules that name their scope, and with those that name none.

    Rules of one scope meet by an equi join; the org-wide ones, a table of rules
    whose number doesn't grow with the rows, are attached to every row.
    """
    named = df.join(rules.where(F.col(rule_scope).isNotNull()), F.col(scope) == F.col(rule_scope))
    wide = df.crossJoin(F.broadcast(rules.where(F.col(rule_scope).isNull())))
    return named.unionByName(wide)


def mutual_best(scores: DataFrame, left: str, right: str, score: str, max_rounds: int = 12) -> DataFrame:
    """One-to-one pairs, highest score first, each side used once (ties by ids).

    Rounds take all pairs that are best for both sides; what they use is dropped.  Each round is written to the checkpoint
    folder.  What ``max_rounds`` leave (chains of falling scores, which settle one pair a round) is gone through once in
    the order of scores by a task that holds nothing but the ids that are used.
    """
    out, left_over = None, scores
    for _ in range(max_rounds):
        by_left = F.row_number().over(Window.partitionBy(left).orderBy(F.col(score).desc(), right))
        by_right = F.row_number().over(Window.partitionBy(right).orderBy(F.col(score).desc(), left))
        best = left_over.withColumn("__l", by_left).withColumn("__r", by_right).where("__l = 1 AND __r = 1").drop("__l", "__r")
        best = best.checkpoint()
        if best.isEmpty():
            return out if out is not None else best
        out = best if out is None else out.unionByName(best)
        left_over = left_over.join(best.select(left), left, "left_anti").join(best.select(right), right, "left_anti").checkpoint()
    names = left_over.columns
    a, b = names.index(left), names.index(right)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        used_left, used_right = set(), set()
        for batch in batches:
            taken = []
            for x, y in zip(batch.column(a).to_pylist(), batch.column(b).to_pylist()):
                taken.append(x not in used_left and y not in used_right)
                if taken[-1]:
                    used_left.add(x)
                    used_right.add(y)
            yield batch.filter(pa.array(taken, pa.bool_()))

    in_order = left_over.orderBy(F.col(score).desc(), left, right).coalesce(1)
    return out.unionByName(in_order.mapInArrow(run, left_over.schema))


def latest_record(df: DataFrame, key: str, order: list[str], columns: list[str]) -> DataFrame:
    """Per key, the columns of the row that is last in the order."""
    last = F.max_by(F.struct(*columns), F.struct(*order)).alias("__r")
    return df.groupBy(key).agg(last).select(key, *(F.col("__r." + c) for c in columns))


def inside(elements: DataFrame, boxes: DataFrame, on: str, pad: float = 0.0) -> DataFrame:
    """Elements whose centre lies in a box of the same page (columns x0, y0, x1, y1 on both sides, boxes' prefixed b_)."""
    x, y = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    hit = x.between(F.col("b_x0") - pad, F.col("b_x1") + pad) & y.between(F.col("b_y0") - pad, F.col("b_y1") + pad)
    return elements.join(boxes, on).where(hit)


def unambiguous(matches: DataFrame, key: str) -> DataFrame:
    """Matches of keys that have exactly one."""
    n = F.count("*").over(Window.partitionBy(key))
    return matches.withColumn("__n", n).where("__n = 1").drop("__n")
