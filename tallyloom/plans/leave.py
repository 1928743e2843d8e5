"""Leave requests in batches: notice, blackouts, peers away, balances, and the next dates that are free."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.operators import joins

#: Fixed value: days from which on a free window is looked for.
LOOK_AHEAD = 180


def least_two(away: DataFrame) -> DataFrame:
    """(grp, day, least, next): the two least members of a group who are away on a day; ``next`` is null where one alone is.

    Its size is bounded by groups and days, whatever the number of members.
    """
    days = away.where("s <= e").select("grp", "member", F.explode(F.sequence("s", "e")).alias("day"))
    rank = F.dense_rank().over(Window.partitionBy("grp", "day").orderBy("member"))
    two = days.withColumn("__n", rank).where("__n <= 2").groupBy("grp", "day").agg(F.min("member").alias("least"), F.max("member").alias("__last"))
    return two.select("grp", "day", "least", F.when(F.col("__last") != F.col("least"), F.col("__last")).alias("next"))


def busy_runs(days: DataFrame) -> DataFrame:
    """(grp, only, s, e): runs of ``least_two``'s days on which the same member alone is away, or (``only`` null) several are."""
    w = Window.partitionBy("grp").orderBy("day")
    held = days.select("grp", "day", F.when(F.col("next").isNull(), F.col("least")).alias("only"))
    same = F.lag("day").over(w).eqNullSafe(F.date_sub("day", 1)) & F.lag("only").over(w).eqNullSafe(F.col("only"))
    runs = held.withColumn("__new", (~same).cast("int")).withColumn("__run", F.sum("__new").over(w))
    return runs.groupBy("grp", "__run", "only").agg(F.min("day").alias("s"), F.max("day").alias("e")).drop("__run")


def validated(requests: DataFrame, members: DataFrame, rules: DataFrame, blackouts: DataFrame, others: DataFrame, balances: DataFrame, today: str) -> DataFrame:
    """(request, decision, peer, suggested): the first rule that a request breaks, or ``accepted``.

    ``requests`` are (request, member, kind, s, e), ``members`` (member, org, grp) with ``grp`` naming those who may not
    be away together, ``rules`` (kind, notice), ``blackouts`` (org or null for all, s, e), ``others`` the requests that
    are not rejected (member, s, e), ``balances`` (member, kind, year, left).  Rules and blackouts are few and are broadcast.
    A request that meets a peer's names the least such peer and the first dates on or after the wanted ones, within the
    notice and ``LOOK_AHEAD`` days, on which neither a peer is away nor a blackout lies.
    Requests meet the days of their group, and runs of them, not each peer: what a request meets is bounded by the days it
    asks for and looks ahead.
    """
    now = F.lit(today).cast("date")
    # One row: all blackouts.
    closed = blackouts.agg(F.collect_list(F.struct("org", "s", "e")).alias("closed"))
    held = requests.join(members, "member").join(F.broadcast(rules), "kind", "left").withColumn("days", F.datediff("e", "s") + 1).crossJoin(F.broadcast(closed))
    held = held.withColumn("closed", F.filter("closed", lambda b: b["org"].isNull() | (b["org"] == F.col("org"))))
    held = held.withColumn("shut", F.exists("closed", lambda b: (F.col("s") <= b["e"]) & (b["s"] <= F.col("e"))))
    early = F.datediff("s", now) < F.coalesce("notice", F.lit(-(10**6)))
    ruled = F.when(F.col("days") < 1, "dates").when(early, "notice").when(F.col("shut"), "blackout")
    # Only requests that pass these rules meet peers.
    passed = held.where(ruled.isNull())
    away = least_two(others.join(members, "member").select("grp", "member", "s", "e"))
    asked_days = passed.select("request", "member", "grp", F.explode(F.sequence("s", "e")).alias("day"))
    peer = F.when(F.col("least") != F.col("member"), F.col("least")).otherwise(F.col("next"))
    clash = asked_days.join(away, ["grp", "day"]).groupBy("request").agg(F.min(peer).alias("peer")).where("peer IS NOT NULL")
    # Peers away from the first day on as far as a free window is looked for.
    first = F.greatest(now, F.col("s"), F.date_add(now, F.coalesce("notice", F.lit(0))))
    wanted = passed.join(clash, "request", "left_semi").withColumn("from", first).withColumn("until", F.expr(f"date_add(from, {LOOK_AHEAD} + days)"))
    row = F.struct("request", "member", "days", "from")
    near = joins.overlapping(wanted.select("grp", row.alias("row"), F.col("from").alias("s"), F.col("until").alias("e")), busy_runs(away).withColumn("run", F.struct("only", "s", "e")), ["grp"], "s", "e", ("row", "run"))
    near = near.where("b_id.only IS NULL OR b_id.only <> a_id.member")
    busy = near.select("a_id.request", "a_id.days", "a_id.from", F.col("b_id.s").alias("p_s"), F.col("b_id.e").alias("p_e"))
    closures = wanted.select("request", "days", "from", F.explode("closed").alias("b")).where("from <= b.e").select("request", "days", "from", F.col("b.s").alias("p_s"), F.col("b.e").alias("p_e"))
    # A window begins on the first day, or on the day after what ends last of all that begins no later.
    w = Window.partitionBy("request").orderBy("p_s", "p_e")
    start = busy.unionByName(closures)
    reach = start.withColumn("end", F.max("p_e").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("next", F.lead("p_s").over(w)).withColumn("__n", F.row_number().over(w))
    # The first row also stands for the window that begins on the first day.
    on_first = F.when(F.col("__n") == 1, F.struct(F.col("from").alias("open"), F.col("p_s").alias("next")))
    spans = reach.select("request", "days", "from", F.explode(F.array_compact(F.array(on_first, F.struct(F.date_add("end", 1).alias("open"), "next")))).alias("x")).select("request", "days", "from", "x.*")
    fits = (F.col("next").isNull() | (F.expr("date_add(open, days)") <= F.col("next"))) & (F.datediff("open", "from") < LOOK_AHEAD)
    # Peers who are back before the first day leave it free.
    free = spans.groupBy("request").agg(F.min(F.when(fits, F.col("open"))).alias("suggested"), F.lit(True).alias("ahead"))
    asked = held.join(clash, "request", "left").join(free, "request", "left")
    asked = asked.withColumn("suggested", F.when(F.col("ahead"), F.col("suggested")).otherwise(first))
    # A row a member, kind and year: not to be broadcast where its source is small.
    left = balances.select("member", "kind", "year", "left").hint("merge")
    asked = asked.withColumn("year", F.year("s")).join(left, ["member", "kind", "year"], "left")
    decision = (
        F.when(ruled.isNotNull(), ruled)
        .when(F.col("peer").isNotNull(), "peer away")
        .when(F.col("left").isNull(), "no balance")
        .when(F.col("days") > F.col("left"), "balance")
        .otherwise("accepted")
    )
    clashed = F.col("decision") == "peer away"
    return asked.withColumn("decision", decision).select("request", "decision", F.when(clashed, F.col("peer")).alias("peer"), F.when(clashed, F.col("suggested")).alias("suggested"))
