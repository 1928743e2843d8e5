"""Leave, demand and skills of members by whole rules: customers are members, their lines and orders what they ask and do."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyloom.catalog.registry import query
from tallyloom.catalog.relational import day
from tallyloom.functions.numbers import half_up
from tallyloom.operators import windows
from tallyloom.plans import leave, reconcile

TODAY = "1998-01-01"
_ASKED = """WITH l AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, o_custkey AS member, l_linenumber % 3 AS kind, CAST(l_shipdate AS DATE) AS s, CAST(l_shipdate AS DATE) + CAST(l_quantity AS INTEGER) % 9 - 1 AS e,
         row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity, l_extendedprice) AS request FROM lineitem JOIN (SELECT o_orderkey, min(o_custkey) AS o_custkey FROM orders GROUP BY 1) ON l_orderkey = o_orderkey),
       m AS (SELECT c_custkey AS member, c_nationkey AS org, c_nationkey || '/' || c_mktsegment || '/' || c_custkey % 2 AS grp FROM customer),
       q AS (SELECT l.*, org, grp, CASE kind WHEN 0 THEN 0 WHEN 1 THEN 7 ELSE 30 END AS notice, CAST(e - s + 1 AS INTEGER) AS days FROM l JOIN m USING (member) WHERE l_orderkey % 10 = 3),
       o AS (SELECT l.member, grp, s, e FROM l JOIN m USING (member) WHERE l_orderkey % 10 = 5 AND e >= s),
       b AS (SELECT * FROM (VALUES (NULL, DATE '1999-12-24', DATE '1999-12-31'), (3, DATE '1998-06-01', DATE '1998-07-31')) AS v(org, s, e))"""


@query(
    "u4_leave_decisions_whole",
    _ASKED
    + f""", c AS (SELECT request, min(o.member) AS peer FROM q JOIN o ON o.grp = q.grp AND o.member <> q.member AND q.s <= o.e AND o.s <= q.e WHERE q.days >= 1 GROUP BY 1),
       f AS (SELECT q.request, greatest(DATE '{TODAY}', q.s, DATE '{TODAY}' + notice) AS first FROM q JOIN c USING (request)),
       g AS (SELECT q.request, min(first + CAST(d AS INTEGER)) AS suggested FROM q JOIN f USING (request), range(180) AS r(d) WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.grp = q.grp AND o.member <> q.member AND first + CAST(d AS INTEGER) <= o.e AND o.s <= first + CAST(d AS INTEGER) + days - 1)
           AND NOT EXISTS (SELECT 1 FROM b WHERE (b.org IS NULL OR b.org = q.org) AND first + CAST(d AS INTEGER) <= b.e AND b.s <= first + CAST(d AS INTEGER) + days - 1) GROUP BY 1),
       x AS (SELECT q.*, peer, suggested, EXISTS (SELECT 1 FROM b WHERE (b.org IS NULL OR b.org = q.org) AND q.s <= b.e AND b.s <= q.e) AS shut, CASE WHEN (member + kind + year(s)) % 11 > 0 THEN (member * 7 + kind * 3 + year(s)) % 9 END AS balance FROM q LEFT JOIN c USING (request) LEFT JOIN g USING (request)),
       y AS (SELECT *, CASE WHEN days < 1 THEN 'dates' WHEN s - DATE '{TODAY}' < notice THEN 'notice' WHEN shut THEN 'blackout' WHEN peer IS NOT NULL THEN 'peer away' WHEN balance IS NULL THEN 'no balance' WHEN days > balance THEN 'balance' ELSE 'accepted' END AS decision FROM x)
       SELECT request, decision, CASE WHEN decision = 'peer away' THEN peer END AS peer, CASE WHEN decision = 'peer away' THEN CAST(suggested AS DATE) END AS suggested FROM y""",
)
def _(t):
    orders = t.orders.groupBy("o_orderkey").agg(F.min("o_custkey").alias("member"))
    # The supplied lines have no request number: one is made in the order of their columns, by ranges.
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice"]
    per = Window.partitionBy("l_orderkey").orderBy(*order[1:])
    counts = t.lineitem.join(orders, F.col("l_orderkey") == F.col("o_orderkey"), "left_semi").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    starts = windows.sums_before(counts, "l_orderkey", "n").select("l_orderkey", F.col("before").alias("start"))
    lines = t.lineitem.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).withColumn("place", F.row_number().over(per)).join(starts, "l_orderkey")
    lines = lines.select("l_orderkey", "member", (F.col("l_linenumber") % 3).alias("kind"), day("l_shipdate").alias("s"), F.date_add(day("l_shipdate"), (F.col("l_quantity").cast("int") % 9 - 1)).alias("e"), (F.col("start") + F.col("place")).alias("request"))
    members = t.customer.select(F.col("c_custkey").alias("member"), F.col("c_nationkey").alias("org"), F.concat_ws("/", F.col("c_nationkey").cast("string"), "c_mktsegment", (F.col("c_custkey") % 2).cast("string")).alias("grp"))
    rules = t.spark.createDataFrame([(0, 0), (1, 7), (2, 30)], "kind int, notice int")
    blackouts = t.spark.sql("SELECT * FROM VALUES (CAST(NULL AS INT), DATE '1999-12-24', DATE '1999-12-31'), (3, DATE '1998-06-01', DATE '1998-07-31') AS v(org, s, e)")
    years = F.explode(F.sequence(F.lit(1990), F.lit(2010)))
    balances = t.customer.select(F.col("c_custkey").alias("member"), years.alias("year")).select("member", "year", F.explode(F.array(*map(F.lit, (0, 1, 2)))).alias("kind"))
    balances = balances.where((F.col("member") + F.col("kind") + F.col("year")) % 11 > 0).withColumn("left", (F.col("member") * 7 + F.col("kind") * 3 + F.col("year")) % 9)
    asked = lines.where("l_orderkey % 10 = 3").drop("l_orderkey")
    return leave.validated(asked, members, rules, blackouts, lines.where("l_orderkey % 10 = 5 AND e >= s").select("member", "s", "e"), balances, TODAY)


_VOLUME = """WITH v AS (SELECT c_nationkey AS org, c_mktsegment AS zone, CAST(date_trunc('month', o_orderdate) AS DATE) AS m, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderdate < TIMESTAMP '2001-08-01' GROUP BY 1, 2, 3),
       h AS (SELECT count(DISTINCT CAST(o_orderdate AS DATE)) AS holidays FROM orders WHERE o_orderkey % 20 = 0 AND o_orderdate >= TIMESTAMP '2001-06-01' AND o_orderdate < TIMESTAMP '2001-07-01'),
       f AS (SELECT floor((1 - greatest(0, holidays - 2) * 0.03::DOUBLE) * 10 + 0.5) / 10 AS factor FROM h),
       x AS (SELECT *, row_number() OVER (PARTITION BY org, zone ORDER BY m) - 1 AS i, count(*) OVER (PARTITION BY org, zone) AS months FROM v),
       t AS (SELECT org, zone, max(months) AS months, arg_max(n, i) AS current, CASE WHEN var_pop(n) = 0 THEN 0 ELSE regr_slope(n, i) END AS slope, avg(n) - CASE WHEN var_pop(n) = 0 THEN 0 ELSE regr_slope(n, i) * avg(i) END AS base, CASE WHEN var_pop(n) = 0 THEN 0 ELSE regr_r2(n, i) END AS fit FROM x WHERE months >= 4 GROUP BY 1, 2)"""


@query(
    "x2_demand_alerts",
    _VOLUME
    + """, p AS (SELECT *, CAST(greatest(0, floor(round((base + slope * months) * factor, 6) + 0.5)) AS BIGINT) AS projected FROM t, f)
       SELECT org, zone, current, projected, floor(round(CAST(projected - current AS DOUBLE) / current * 1000, 6) + 0.5) / 10 AS change, fit >= 0.3 AND floor(round(CAST(projected - current AS DOUBLE) / current * 1000, 6) + 0.5) / 10 > 15 AS alert FROM p""",
)
def _(t):
    # The month that follows the data has the holidays of one before it: days on which every twentieth order fell.
    joined = t.orders.where(F.col("o_orderdate") < F.lit("2001-08-01").cast("timestamp")).join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    volume = joined.groupBy(F.col("c_nationkey").alias("org"), F.col("c_mktsegment").alias("zone"), F.trunc(day("o_orderdate"), "month").alias("m")).agg(F.count("*").alias("n"))
    holidays = t.orders.where("o_orderkey % 20 = 0").where(day("o_orderdate").between(F.lit("2001-06-01").cast("date"), F.lit("2001-06-30").cast("date"))).select(day("o_orderdate").alias("day"))
    return windows.demand_alerts(volume, holidays)


@query(
    "x6_skill_losses",
    """WITH s AS (SELECT DISTINCT o_custkey AS member, CAST(substr(p_brand, 7) AS INTEGER) AS skill FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey),
       h AS (SELECT c_nationkey AS org, skill, count(*) AS holders, count(*) FILTER (c_custkey % 4 = 0) AS leaving FROM s JOIN customer ON c_custkey = member WHERE c_acctbal > 0 AND skill % 25 = c_nationkey GROUP BY 1, 2),
       c AS (SELECT c_nationkey AS org, floor(CAST(count(*) FILTER (o_orderstatus = 'F') AS DOUBLE) / count(*) * 1000 + 0.5) / 10 AS backfill FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1)
       SELECT org, skill, holders, leaving, holders - leaving AS left, floor(CAST(leaving AS DOUBLE) / holders * 1000 + 0.5) / 10 AS loss, CASE WHEN skill % 2 = 0 THEN backfill END AS backfill, floor(CAST(leaving AS DOUBLE) / holders * 1000 + 0.5) / 10 > 20 AS alert FROM h LEFT JOIN c USING (org) WHERE holders >= 8""",
)
def _(t):
    skill = F.substring("p_brand", 7, 10).try_cast("int")
    held = t.orders.join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey")).join(t.part, F.col("l_partkey") == F.col("p_partkey")).select(F.col("o_custkey").alias("member"), skill.alias("skill")).distinct()
    members = t.customer.where("c_acctbal > 0").select(F.col("c_custkey").alias("member"), F.col("c_nationkey").alias("org"))
    holders = held.join(members, "member").where(F.col("skill") % 25 == F.col("org")).groupBy("org", "skill").agg(F.count("*").alias("holders"), F.count_if(F.col("member") % 4 == 0).alias("leaving")).where("holders >= 8")
    courses = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_nationkey").alias("org")).agg((half_up(F.count_if(F.col("o_orderstatus") == "F") / F.count("*") * 1000) / 10).alias("backfill"))
    loss = F.floor(F.col("leaving") / F.col("holders") * 1000 + 0.5) / 10
    return holders.join(courses, "org", "left").select("org", "skill", "holders", "leaving", (F.col("holders") - F.col("leaving")).alias("left"), loss.alias("loss"), F.when(F.col("skill") % 2 == 0, F.col("backfill")).alias("backfill"), (loss > 20).alias("alert"))


@query(
    "e10_rising_rows",
    """WITH RECURSIVE x AS (SELECT c_nationkey, c_custkey AS i, CAST(floor(c_acctbal / 500) AS BIGINT) AS v FROM customer),
       levels AS (SELECT c_nationkey, i, v, 1 AS lev FROM x UNION SELECT b.c_nationkey, b.i, b.v, a.lev + 1 FROM levels a JOIN x b ON b.c_nationkey = a.c_nationkey AND b.i > a.i AND b.v > a.v),
       longest AS (SELECT c_nationkey, i, v, max(lev) AS lev FROM levels GROUP BY 1, 2, 3),
       chain AS (SELECT c_nationkey, max(i) AS i, lev FROM longest l WHERE lev = (SELECT max(lev) FROM longest k WHERE k.c_nationkey = l.c_nationkey) GROUP BY 1, 3
         UNION ALL SELECT c.c_nationkey, (SELECT max(l.i) FROM longest l WHERE l.c_nationkey = c.c_nationkey AND l.lev = c.lev - 1 AND l.i < c.i), c.lev - 1 FROM chain c WHERE c.lev > 1)
       SELECT c_nationkey, i AS c_custkey, v FROM chain JOIN x USING (c_nationkey, i)""",
)
def _(t):
    return reconcile.rising_rows(t.customer.select("c_nationkey", "c_custkey", F.floor(F.col("c_acctbal") / 500).alias("v")), ["c_nationkey"], "c_custkey", "v")
