"""Rankings, series and running states."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def among_peers(df: DataFrame, peers: list[str], score: str) -> DataFrame:
    """n_peers, share of peers strictly below, and the peers' mean; the row itself is no peer of its own."""
    group, ordered = Window.partitionBy(*peers), Window.partitionBy(*peers).orderBy(score)
    others = F.count("*").over(group) - 1
    below = F.rank().over(ordered) - 1
    exact = F.sum(F.col(score).cast("decimal(18,2)")).over(group) - F.col(score).cast("decimal(18,2)")
    return df.withColumns({"n_peers": others, "percentile": F.when(others > 0, below / others), "peer_mean": F.when(others > 0, exact.cast("double") / others)})


def first_and_last(df: DataFrame, key: str, at: str, value: str, step: float) -> DataFrame:
    """Per key the first and last value of the series, and Improving, Stable or Declining by the step."""
    ends = df.groupBy(key).agg(F.min_by(value, at).alias("first_value"), F.max_by(value, at).alias("last_value"))
    change = F.col("last_value") - F.col("first_value")
    return ends.withColumn("trend", F.when(change >= step, "Improving").when(change <= -step, "Declining").otherwise("Stable"))


def top_k(df: DataFrame, group: str, order: list[Column], k: int, position: str = "position") -> DataFrame:
    ranked = df.withColumn(position, F.row_number().over(Window.partitionBy(group).orderBy(*order)).cast("long"))
    return ranked.where(F.col(position) <= k)


def recent_against_prior(df: DataFrame, key: str, at: str, value: Column, recent: int) -> DataFrame:
    """Per key the mean of the last ``recent`` values, of the others, and their difference."""
    ranked = df.withColumn("__r", F.row_number().over(Window.partitionBy(key).orderBy(F.col(at).desc())))
    new, old = (F.avg(F.when(c, value)) for c in (F.col("__r") <= recent, F.col("__r") > recent))
    return ranked.groupBy(key).agg(new.alias("recent_mean"), old.alias("prior_mean"), (new - old).alias("change"))


def trend(x: Column, y: Column) -> dict[str, Column]:
    """Least-squares slope, intercept and fit; the fit is 0 where x or y doesn't vary or a row stands alone."""
    n, flat = F.count(y), F.coalesce((F.var_pop(y) == 0) | (F.var_pop(x) == 0), F.lit(True))
    slope = F.when(flat | (n < 2), 0.0).otherwise(F.regr_slope(y, x))
    return {"slope": slope, "intercept": F.avg(y) - slope * F.avg(x), "fit": F.when(flat | (n < 2), 0.0).otherwise(F.regr_r2(y, x))}


def clusters(df: DataFrame, key: str, value: str, gap: float) -> DataFrame:
    """Numbers runs of values whose neighbours are at most ``gap`` apart."""
    w = Window.partitionBy(key).orderBy(value)
    opens = F.when(F.col(value) - F.lag(value).over(w) <= gap, 0).otherwise(1)
    return _running(df.withColumn("__o", opens), w, "cluster")


def _running(df: DataFrame, w, name: str) -> DataFrame:
    return df.withColumn(name, F.sum("__o").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long")).drop("__o")


def islands(df: DataFrame, key: str, start: str, end: str, tie: str) -> DataFrame:
    """Merged intervals per key: those that touch or overlap are one."""
    w = Window.partitionBy(key).orderBy(start, end, tie)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = df.withColumn("__o", F.when(F.col(start) <= reach, 0).otherwise(1))
    numbered = _running(marked, w, "island")
    return numbered.groupBy(key, "island").agg(F.min(start).alias("from_date"), F.max(end).alias("to_date"), F.count("*").alias("n"))


def serial_gaps(df: DataFrame, key: str, serial: str, share: float = 0.6, least: int = 3) -> DataFrame:
    """Gaps of serials that mostly run on: (key, first_missing, last_missing), one row a gap, however wide it is."""
    w = Window.partitionBy(key).orderBy(serial)
    steps = df.select(key, F.col(serial).alias("__s"), (F.col(serial) - F.lag(serial).over(w)).alias("__d"))
    runs = steps.groupBy(key).agg(F.count("*").alias("n"), F.count_if(F.col("__d") == 1).alias("runs")).where((F.col("n") >= least) & (F.col("runs") / (F.col("n") - 1) >= share))
    gaps = steps.where("__d > 1").select(key, (F.col("__s") - F.col("__d") + 1).alias("first_missing"), (F.col("__s") - 1).alias("last_missing"))
    return gaps.join(runs.select(key), key, "left_semi")


def longest_rising(df: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """Per key the length of the longest strictly rising subsequence of its ordered values; nulls are left out.

    A key's rows stream through a task in their order; only the least last value for each length is held.
    """
    schema = T.StructType([df.schema[key], T.StructField("rising", T.LongType())])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, tails = None, None
        for frame in frames:
            done = []
            for k, v in zip(frame[key].tolist(), frame[value].tolist()):
                if tails is None or k != at:
                    if tails is not None:
                        done.append((at, len(tails)))
                    at, tails = k, []
                place = bisect_left(tails, v)
                tails[place : place + 1] = [v]
            yield pd.DataFrame(done, columns=[key, "rising"])
        if tails is not None:
            yield pd.DataFrame([(at, len(tails))], columns=[key, "rising"])

    rows = df.where(F.col(value).isNotNull() & F.col(key).isNotNull()).select(key, *order, value)
    return rows.repartition(key).sortWithinPartitions(key, *order).select(key, value).mapInPandas(run, schema)


def ordinal_id(df: DataFrame, parent: str, order: list[Column], name: str = "item_id") -> DataFrame:
    """parent.0001, parent.0002, ... in the order given."""
    n = F.row_number().over(Window.partitionBy(parent).orderBy(*order))
    return df.withColumn(name, F.format_string("%s.%04d", F.col(parent).cast("string"), n))


#: Months and fit that a trend needs, holidays of a usual month and what each further one takes, the alarming rise in percent.
MONTHS, FIT, USUAL_HOLIDAYS, EACH_HOLIDAY, RISE = 4, 0.3, 2, 0.03, 15


def demand_alerts(volume: DataFrame, holidays: DataFrame) -> DataFrame:
    """(org, zone, current, projected, change, alert): next month's volume by trend, less what its holidays take.

    ``volume`` are (org, zone, m, n), ``holidays`` the next month's days, each once or more.
    """
    order = Window.partitionBy("org", "zone").orderBy("m")
    steps = volume.withColumn("i", F.row_number().over(order) - 1)
    line = trend(F.col("i"), F.col("n"))
    fits = steps.groupBy("org", "zone").agg(F.count("*").alias("months"), F.max_by("n", "i").alias("current"), line["slope"].alias("slope"), line["intercept"].alias("base"), line["fit"].alias("fit")).where(F.col("months") >= MONTHS)
    factor = F.floor((1 - F.greatest(F.lit(0), F.countDistinct("day") - USUAL_HOLIDAYS) * EACH_HOLIDAY) * 10 + 0.5) / 10
    both = fits.crossJoin(F.broadcast(holidays.agg(factor.alias("factor"))))  # one row
    ahead = F.round((F.col("base") + F.col("slope") * F.col("months")) * F.col("factor"), 6)
    rows = both.withColumn("projected", F.greatest(F.floor(ahead + 0.5), F.lit(0)))
    change = F.floor(F.round((F.col("projected") - F.col("current")) / F.col("current") * 1000, 6) + 0.5) / 10
    return rows.withColumn("change", change).select("org", "zone", "current", "projected", "change", ((F.col("fit") >= FIT) & (F.col("change") > RISE)).alias("alert"))


def sums_before(df: DataFrame, key: str, value: str, width: int = 1 << 16) -> DataFrame:
    """``df`` with ``before``, the sum of ``value`` over all rows of lesser whole keys; each key stands in one row.

    Ranges of ``width`` keys are summed apart, so one task sees a row a range, not a row a key.
    """
    dealt = df.withColumn("__range", F.floor(F.col(key) / width))
    lesser = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = dealt.groupBy("__range").agg(F.sum(value).alias("__sum"))
    ranges = ranges.select("__range", F.coalesce(F.sum("__sum").over(lesser), F.lit(0)).alias("__start"))
    within = Window.partitionBy("__range").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    summed = dealt.withColumn("__within", F.coalesce(F.sum(value).over(within), F.lit(0))).join(ranges, "__range")
    return summed.withColumn("before", F.col("__start") + F.col("__within")).drop("__range", "__start", "__within")
