"""Grouped summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions.numbers import ratio
from tallyloom.operators import windows


def weighted_mean(value: Column, weight: Column) -> Column:
    return ratio(F.sum((value * weight).cast("decimal(28,4)")).cast("double"), F.sum(weight.cast("decimal(28,4)")).cast("double"))


def mean_by_mode(part: Column, whole: Column, mode: str) -> Column:
    """Mean of ratios, ratio of means, or ratio of sums."""
    if mode == "mean_of_ratios":
        return F.avg(F.when(whole != 0, part / whole))
    if mode == "ratio_of_means":
        return F.avg(part) / F.avg(whole)
    return F.sum(part) / F.sum(whole)


def two_level_mean(df: DataFrame, member: str, org: str, amount: Column) -> DataFrame:
    """Per org: members, and the mean of their totals."""
    per = df.groupBy(org, member).agg(F.sum(amount).alias("__t"))
    return per.groupBy(org).agg(F.count("*").alias("members"), (F.sum("__t").cast("double") / F.count("*")).alias("mean_total"))


def mode_of(df: DataFrame, key: str, value: str) -> DataFrame:
    """Per key the most frequent value and its count; ties go to the first by name."""
    counted = df.groupBy(key, value).agg(F.count("*").alias("n"))
    w = Window.partitionBy(key).orderBy(F.col("n").desc(), value)
    return counted.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def weakest(metrics: dict[str, Column]) -> Column:
    """The name of the least of several columns; ties go to the first by name."""
    pairs = [F.struct(v.cast("double").alias("v"), F.lit(n).alias("n")) for n, v in metrics.items()]
    return F.array_min(F.array(*pairs))["n"]


def shortfall(sanctioned: DataFrame, filled: DataFrame, key: str, need: str, have: str) -> DataFrame:
    """Sum of what is missing where it is missing; surpluses elsewhere don't count."""
    joined = sanctioned.join(filled, key, "left").withColumn(have, F.coalesce(F.col(have), F.lit(0)))
    return joined.agg(F.sum(F.greatest(F.lit(0), F.col(need) - F.col(have))).alias("vacant"))


def last_periods(df: DataFrame, period: str, keep: int) -> DataFrame:
    """Rows of the last ``keep`` distinct periods; only the periods are ranked, not the rows."""
    kept = df.select(period).distinct().orderBy(F.col(period).desc()).limit(keep)
    return df.join(F.broadcast(kept), period, "left_semi")


def scope_totals(df: DataFrame, outer: str, inner: str, *aggregates: Column) -> DataFrame:
    """Totals by (outer, inner), by outer, and overall, with the level: 0, 1, 3."""
    return df.rollup(outer, inner).agg(F.grouping_id().cast("long").alias("level"), *aggregates)


#: Rain of a day in millimetres up to which each band goes; bands that call for staff; the share of a staff that stays.
RAIN = [(2.4, "No Rain"), (15.5, "Light Rain"), (64.4, "Moderate Rain"), (115.5, "Heavy Rain")]
HEAVIEST, TRIGGERS, FLOOR = "Very Heavy Rain", ("Moderate Rain", "Heavy Rain", "Very Heavy Rain"), 0.8


def redeployment(posts: DataFrame, daily: DataFrame, high: Column, low: Column, least_posts: int = 10, most_vacant: float = 5.0) -> DataFrame:
    """Short-staffed orgs of the ``high`` load with their thinnest zone and what the pool of the ``low`` load's staff gives them.

    ``posts`` are (org, zone, posts, filled), ``daily`` the rain (day, mm).  Orgs with few posts are not judged.  The pool,
    one row, is what the low-load orgs have above four fifths of their staff; it goes to the orgs in the order of their
    vacancy rates until it is used up.  The window runs over one row an org.
    """
    zones = posts.groupBy("org").agg(F.min(F.struct("filled", "zone")).alias("z"), F.sum("posts").alias("sanctioned"), F.sum("filled").alias("headcount"), F.sum(F.greatest(F.col("posts") - F.col("filled"), F.lit(0))).alias("vacancies"))
    rate = F.floor(F.col("vacancies") / F.col("sanctioned") * 1000 + 0.5) / 10
    short = zones.where(high & (F.col("sanctioned") >= least_posts)).withColumn("rate", rate).where(F.col("rate") > most_vacant)
    spare = F.greatest(F.col("headcount") - F.floor(F.col("headcount") * FLOOR + 0.5), F.lit(0))
    pool = zones.where(low).agg(F.coalesce(F.sum(spare), F.lit(0)).alias("pool"))
    last = daily.agg(F.max("day").alias("last"))
    most = daily.crossJoin(F.broadcast(last)).where("day > date_sub(last, 7)").agg(F.max("mm").alias("most"))
    band = F.when(F.col("most") <= RAIN[0][0], RAIN[0][1])
    for edge, name in RAIN[1:]:
        band = band.when(F.col("most") <= edge, name)
    turn = Window.orderBy(F.col("rate").desc(), "org").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("vacancies").over(turn), F.lit(0))
    found = short.withColumn("before", before).crossJoin(F.broadcast(pool)).crossJoin(F.broadcast(most)).withColumn("band", band.otherwise(HEAVIEST))
    given = F.greatest(F.least(F.col("vacancies"), F.col("pool") - F.col("before")), F.lit(0))
    return found.select("org", "sanctioned", "headcount", "vacancies", "rate", F.col("z.zone").alias("zone"), F.col("z.filled").alias("zone_headcount"), "pool", given.alias("allocated"), "band", F.col("band").isin(*TRIGGERS).alias("alert"))


#: Risk of a case by its type (50 for others) and what its status adds.
CASE_TYPES = {
    "Land Acquisition": 70, "Public Interest Litigation": 65, "Encroachment & Demolition": 60, "Labour Dispute": 55,
    "Contractor Dispute": 50, "Property Tax Dispute": 45, "Service Matter": 40, "RTI Appeal": 20,
}
CASE_STATUS = {"Disposed - Unfavorable": 15, "Disposed - Favorable": -35, "Stayed": -10}
CASE_LONG, CASE_LONG_DAYS, CASE_OPEN = 10, 365, ("Pending", "Hearing Scheduled")


def case_risk(cases: DataFrame) -> DataFrame:
    """``cases`` (type, status, days) with score (5 to 95), class, and the chance to win."""
    by = lambda c, known, other: F.coalesce(F.create_map(*(F.lit(x) for pair in known.items() for x in pair))[c], F.lit(other))
    status = F.col("status")
    waits = F.when(status.isin(*CASE_OPEN) & (F.col("days") > CASE_LONG_DAYS), CASE_LONG).otherwise(0)
    score = F.greatest(F.lit(5), F.least(F.lit(95), by(F.col("type"), CASE_TYPES, 50) + waits + by(status, CASE_STATUS, 0)))
    scored = cases.withColumn("score", score)
    win = F.when(status == "Disposed - Favorable", 100).when(status == "Disposed - Unfavorable", 0).otherwise(F.greatest(F.lit(5), F.least(F.lit(95), 100 - F.col("score"))))
    return scored.withColumns({"win": win, "class": F.when(F.col("score") >= 65, "High").when(F.col("score") >= 35, "Medium").otherwise("Low")})


#: Months that a budget's trend needs, the alarming overrun in percent, what fit is worth, and orgs that make a sound base.
BUDGET_MONTHS, OVERRUN, FIT_WORTH, SOUND_BASE, THIN_PENALTY = 6, 10, 85, 10, 10


def overruns(spending: DataFrame) -> DataFrame:
    """(org, months, now, ahead, fit, alert): the variance of spending in percent, its last value and the next by trend.

    ``spending`` are rows (org, m, allocated, spent); rows without a sum spent count nowhere.
    """
    known = spending.where("spent IS NOT NULL").groupBy("org", "m").agg(F.sum("spent").cast("double").alias("s"), F.sum("allocated").alias("a"))
    pct = known.select("org", "m", ((F.col("s") - F.col("a")) / F.col("a") * 100).alias("pct")).withColumn("i", F.row_number().over(Window.partitionBy("org").orderBy("m")) - 1)
    line, tenth = windows.trend(F.col("i"), F.col("pct")), lambda x: F.floor(F.round(x * 10, 6) + 0.5) / 10
    per = pct.groupBy("org").agg(F.count("*").alias("months"), F.max_by("pct", "i").alias("now"), line["slope"].alias("slope"), line["intercept"].alias("base"), line["fit"].alias("fit")).where(F.col("months") >= BUDGET_MONTHS)
    ahead = tenth(F.col("base") + F.col("slope") * F.col("months"))
    return per.select("org", "months", tenth(F.col("now")).alias("now"), ahead.alias("ahead"), "fit").withColumn("alert", F.col("ahead") > OVERRUN)


def overrun_confidence(spending: DataFrame) -> DataFrame:
    """(alerts, missing, confidence), one row: the alerts' mean fit, less the share of rows without a sum and a penalty for few orgs."""
    rows = spending.agg(F.count("*").alias("rows"), F.count_if(F.col("spent").isNull()).alias("missing"))
    found = overruns(spending).agg(F.count("*").alias("orgs"), F.count_if("alert").alias("alerts"), F.coalesce(F.avg(F.when(F.col("alert"), F.col("fit"))), F.lit(0.0)).alias("fit"))
    thin = F.greatest(F.lit(0.0), (SOUND_BASE - F.least(F.col("orgs"), F.lit(SOUND_BASE))) / SOUND_BASE) * THIN_PENALTY
    score = F.floor(F.round(F.col("fit") * FIT_WORTH - 100 * F.col("missing") / F.col("rows") - thin, 6) + 0.5)
    return found.crossJoin(F.broadcast(rows)).select("alerts", "missing", F.greatest(F.lit(5), F.least(F.lit(97), score)).cast("long").alias("confidence"))
