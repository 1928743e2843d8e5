"""Workforce metrics with all of their parts: a customer stands for a member, orders for tasks, lines for days and records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.catalog.registry import query
from tallyloom.functions.numbers import clamp
from tallyloom.operators import joins, windows
from tallyloom.plans import changes

#: The year that metrics are taken in.
YEAR = 2002


def whole(x: Column) -> Column:
    """Rounded to a whole number, halves up; first to six decimals, so that the order of a sum doesn't show."""
    return F.floor(F.round(x, 6) + 0.5)


def _sql_whole(x: str) -> str:
    return f"floor(round({x}, 6) + 0.5)"


_FACTS = f"""WITH o AS (SELECT *, year(o_orderdate) AS y, o_orderstatus = 'P' OR (o_orderstatus = 'O' AND o_orderkey % 3 = 0) AS late FROM orders),
  tasks AS (SELECT o_custkey AS k, count(*) AS n, {_sql_whole("100.0 * (count(*) - count(*) FILTER (late)) / count(*)")} AS sla, count(*) FILTER (o_orderstatus = 'F') AS done, {_sql_whole("avg(((CASE o_orderstatus WHEN 'F' THEN 100 WHEN 'P' THEN 50 ELSE 20 END) + 60 + o_orderkey % 40) / 2.0)")} AS documents,
     least(100, 50 + sum((CASE o_orderstatus WHEN 'F' THEN 15 ELSE 8 END) * (CASE WHEN y >= {YEAR - 2} THEN 1.0 ELSE 0.5 END))) AS activity, {YEAR} - min(y) AS tenure, count(*) FILTER (o_orderkey % 17 = 0) AS steps, count(*) FILTER (late AND o_orderkey % 2 = 0) AS overdue FROM o GROUP BY 1),
  rated AS (SELECT o_custkey AS k, y, least(5.0, greatest(1.0, floor(round(avg(o_totalprice) / 80000, 6) * 10 + 0.5) / 10)) AS r FROM o GROUP BY 1, 2),
  perf AS (SELECT k, arg_max(r, y) AS latest, arg_max(r, y) - arg_min(r, y) AS delta FROM rated GROUP BY 1),
  days AS (SELECT o_custkey AS k, l_orderkey, CAST(count(*) FILTER (l_returnflag <> 'R') AS DOUBLE) / count(*) AS present FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2),
  att AS (SELECT k, avg(present) AS attendance FROM days GROUP BY 1),
  recs AS (SELECT o_custkey AS k, {_sql_whole("100.0 * count(*) FILTER (l_linestatus = 'F') / count(*)")} AS training, {_sql_whole("100 - 100.0 * count(*) FILTER (l_returnflag = 'A' AND l_linenumber > 3) / count(*)")} AS assets FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1),
  sk AS (SELECT k, least(100, {_sql_whole("avg(CASE p_size % 4 WHEN 0 THEN 30 WHEN 1 THEN 60 WHEN 2 THEN 85 ELSE 97 END) + least(10, count(*))")}) AS skills FROM (SELECT DISTINCT o_custkey AS k, l_partkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey) JOIN part ON p_partkey = l_partkey GROUP BY 1),
  pay AS (SELECT c_custkey AS k, coalesce({_sql_whole("100.0 * (rank() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal) - 1) / nullif(count(*) OVER (PARTITION BY c_mktsegment) - 1, 0)")}, 60) AS compensation FROM customer),
  f AS (SELECT c_custkey, c_nationkey, c_mktsegment, c_acctbal, latest, coalesce(delta, 0) AS delta, coalesce(tenure, 0) AS tenure, attendance, coalesce(n, 0) AS n, coalesce(done, 0) AS done, c_custkey % 23 = 0 AS suspended, c_custkey % 19 = 0 AS flagged,
     coalesce({_sql_whole("latest / 5 * 100")}, 70) AS performance, coalesce({_sql_whole("attendance * 100")}, 90) AS attended, coalesce(sla, 100) AS tasks, coalesce(training, CASE WHEN c_custkey % 2 = 0 THEN 40 ELSE 85 END) AS training,
     coalesce(documents, 50) AS documents, coalesce(assets, 100) AS assets, coalesce(skills, 50) AS skills, coalesce(activity, 50) AS activity, compensation,
     least(100, greatest(0, 50 + 4 * coalesce(tenure, 0) + 10 * coalesce(steps, 0) - 20 * least(coalesce(overdue, 0), 2))) AS career
     FROM customer LEFT JOIN tasks ON tasks.k = c_custkey LEFT JOIN perf ON perf.k = c_custkey LEFT JOIN att ON att.k = c_custkey LEFT JOIN recs ON recs.k = c_custkey LEFT JOIN sk ON sk.k = c_custkey LEFT JOIN pay ON pay.k = c_custkey),
  g AS (SELECT *, {_sql_whole("performance * 0.35 + attended * 0.15 + tasks * 0.20 + training * 0.15 + skills * 0.15")} AS score FROM f)"""


def facts(t) -> DataFrame:
    """One row for each member with every part of its scores; a part without records has its neutral value."""
    status, k = F.col("o_orderstatus"), F.col("o_custkey").alias("c_custkey")
    late = (status == "P") | ((status == "O") & (F.col("o_orderkey") % 3 == 0))
    o = t.orders.withColumns({"y": F.year("o_orderdate"), "late": late})
    ocr = (F.when(status == "F", 100).when(status == "P", 50).otherwise(20) + 60 + F.col("o_orderkey") % 40) / 2
    points = F.when(status == "F", 15).otherwise(8) * F.when(F.col("y") >= YEAR - 2, 1.0).otherwise(0.5)
    n = F.count("*")
    tasks = o.groupBy(k).agg(
        n.alias("n"),
        whole(100 * (n - F.count_if("late")) / n).alias("tasks"),
        F.count_if(status == "F").alias("done"),
        whole(F.avg(ocr)).alias("documents"),
        F.least(F.lit(100.0), 50 + F.sum(points)).alias("activity"),
        (YEAR - F.min("y")).alias("tenure"),
        F.count_if(F.col("o_orderkey") % 17 == 0).alias("steps"),
        F.count_if(F.col("late") & (F.col("o_orderkey") % 2 == 0)).alias("overdue"),
    )
    rating = clamp(F.floor(F.round(F.avg("o_totalprice") / 80000, 6) * 10 + 0.5) / 10, 1.0, 5.0)
    perf = o.groupBy(k, "y").agg(rating.alias("r")).groupBy("c_custkey").agg(F.max_by("r", "y").alias("latest"), (F.max_by("r", "y") - F.min_by("r", "y")).alias("delta"))
    lines = t.lineitem.join(t.orders.select("o_orderkey", k), F.col("l_orderkey") == F.col("o_orderkey"))
    att = lines.groupBy("c_custkey", "l_orderkey").agg((F.count_if(F.col("l_returnflag") != "R") / n).alias("p")).groupBy("c_custkey").agg(F.avg("p").alias("attendance"))
    lost = (F.col("l_returnflag") == "A") & (F.col("l_linenumber") > 3)
    recs = lines.groupBy("c_custkey").agg(whole(100 * F.count_if(F.col("l_linestatus") == "F") / n).alias("training"), whole(100 - 100 * F.count_if(lost) / n).alias("assets"))
    level = F.col("p_size") % 4
    level = F.when(level == 0, 30).when(level == 1, 60).when(level == 2, 85).otherwise(97)
    held = lines.select("c_custkey", F.col("l_partkey").alias("p_partkey")).distinct().join(t.part, "p_partkey")
    skills = held.groupBy("c_custkey").agg(F.least(F.lit(100), whole(F.avg(level) + F.least(F.lit(10), n))).alias("skills"))
    pay = windows.among_peers(t.customer, ["c_mktsegment"], "c_acctbal").select("c_custkey", F.coalesce(whole(F.col("percentile") * 100), F.lit(60)).alias("compensation"))
    x = t.customer.select("c_custkey", "c_nationkey", "c_mktsegment", "c_acctbal")
    for part in (tasks, perf, att, recs, skills, pay):
        x = x.join(part, "c_custkey", "left")
    x = x.withColumns(
        {
            "suspended": F.col("c_custkey") % 23 == 0,
            "flagged": F.col("c_custkey") % 19 == 0,
            "performance": F.coalesce(whole(F.col("latest") / 5 * 100), F.lit(70)),
            "attended": F.coalesce(whole(F.col("attendance") * 100), F.lit(90)),
            "training": F.coalesce("training", F.when(F.col("c_custkey") % 2 == 0, 40).otherwise(85)),
            "career": clamp(50 + 4 * F.coalesce("tenure", F.lit(0)) + 10 * F.coalesce("steps", F.lit(0)) - 20 * F.least(F.coalesce("overdue", F.lit(0)), F.lit(2)), 0, 100),
        }
    )
    x = x.fillna({"n": 0, "done": 0, "delta": 0.0, "tenure": 0, "tasks": 100, "documents": 50, "assets": 100, "skills": 50, "activity": 50.0})
    score = F.col("performance") * 0.35 + F.col("attended") * 0.15 + F.col("tasks") * 0.20 + F.col("training") * 0.15 + F.col("skills") * 0.15
    return x.withColumn("score", whole(score))


@query(
    "w8_potential_score",
    _FACTS
    + " SELECT c_custkey, CAST(score AS BIGINT) AS score, coalesce(CASE WHEN c_custkey % 97 = 0 THEN c_acctbal > 0 END, score >= 80 AND NOT flagged AND NOT suspended AND tenure >= 2 AND latest IS NOT NULL) AS high_potential FROM g",
)
def _(t):
    x = facts(t)
    override = F.when(F.col("c_custkey") % 97 == 0, F.col("c_acctbal") > 0)
    rule = (F.col("score") >= 80) & ~F.col("flagged") & ~F.col("suspended") & (F.col("tenure") >= 2) & F.col("latest").isNotNull()
    return x.select("c_custkey", F.col("score").cast("long").alias("score"), F.coalesce(override, rule).alias("high_potential"))


_PARTS = ["performance", "attended", "tasks", "training", "documents", "assets", "skills", "activity", "compensation", "career"]


@query("w10_health_scores", _FACTS + f" SELECT c_custkey, {', '.join(f'CAST({p} AS DOUBLE) AS {p}' for p in _PARTS)}, CAST(score AS DOUBLE) AS overview, CAST(score AS DOUBLE) AS advice FROM g")
def _(t):
    # The overview and what advice is drawn from are both the composite.
    return facts(t).select("c_custkey", *(F.col(p).cast("double").alias(p) for p in _PARTS), F.col("score").cast("double").alias("overview"), F.col("score").cast("double").alias("advice"))


@query(
    "w30_trouble_strength",
    _FACTS
    + """ , w AS (SELECT c_custkey, round((5 - coalesce(latest, 3)) * 18 + greatest(0, -delta) * 25 + greatest(0, 0.9 - coalesce(attendance, 0.9)) * 120 + CASE WHEN suspended THEN 30 ELSE 0 END, 6) AS trouble,
         round(coalesce(latest, 3) * 15 + greatest(0, delta) * 20 + greatest(0, coalesce(attendance, 0.9) - 0.92) * 150 + least(15, tenure), 6) AS strength, tenure FROM g)
       SELECT c_custkey, trouble, strength, trouble > 55 AS disciplinary, NOT trouble > 55 AND strength > 55 AND tenure >= 2 AS promotion_due, least(100.0, greatest(0.0, round(trouble * 0.5, 1))) AS attrition FROM w""",
)
def _(t):
    latest, att = F.coalesce("latest", F.lit(3.0)), F.coalesce("attendance", F.lit(0.9))
    up = lambda x: F.greatest(F.lit(0.0), x)
    trouble = (5 - latest) * 18 + up(-F.col("delta")) * 25 + up(0.9 - att) * 120 + F.when(F.col("suspended"), 30).otherwise(0)
    strength = latest * 15 + up(F.col("delta")) * 20 + up(att - 0.92) * 150 + F.least(F.lit(15), F.col("tenure"))
    x = facts(t).select("c_custkey", "tenure", F.round(trouble, 6).alias("trouble"), F.round(strength, 6).alias("strength"))
    bad = F.col("trouble") > 55
    return x.select("c_custkey", "trouble", "strength", bad.alias("disciplinary"), (~bad & (F.col("strength") > 55) & (F.col("tenure") >= 2)).alias("promotion_due"), clamp(F.round(F.col("trouble") * 0.5, 1), 0.0, 100.0).alias("attrition"))


_FACTORS = [("sla", 0.30), ("attendance", 0.25), ("vacancy", 0.15), ("grievance", 0.15), ("budget", 0.15)]


@query(
    "w18_org_factors",
    _FACTS
    + f""", b AS (SELECT c_nationkey AS org, avg(tasks) AS sla, avg(attended) AS attendance, greatest(0, 100 - 5 * (100.0 * count(*) FILTER (c_acctbal < -900) / count(*))) AS vacancy, greatest(0, 100 - 20 * (100.0 * count(*) FILTER (c_custkey % 40 = 0) / count(*))) AS grievance,
         greatest(0, 100 - 4 * abs(100.0 * (sum(CAST(c_acctbal AS DECIMAL(18,2))) / (4500.0 * count(*)) - 1))) AS budget FROM g GROUP BY 1),
       u AS (SELECT org, unnest([{', '.join(repr(n) for n, _ in _FACTORS)}]) AS factor, unnest([{', '.join(n for n, _ in _FACTORS)}]) AS component, unnest([{', '.join(str(w) for _, w in _FACTORS)}]) AS weight FROM b),
       c AS (SELECT org, factor, round(component, 6) AS component, CAST(weight AS DOUBLE) AS weight, floor(round(component * weight, 6) * 10 + 0.5) / 10 AS contribution FROM u)
       SELECT org, factor, component, contribution, round(weight * 100 - contribution, 1) AS gap, CAST(floor(round(sum(contribution) OVER (PARTITION BY org), 6) + 0.5) AS BIGINT) AS score, row_number() OVER (PARTITION BY org ORDER BY round(weight * 100 - contribution, 1) DESC, factor) = 1 AS weakest FROM c""",
)
def _(t):
    n = F.count("*")
    per = facts(t).groupBy(F.col("c_nationkey").alias("org")).agg(
        F.avg("tasks").alias("sla"),
        F.avg("attended").alias("attendance"),
        F.greatest(F.lit(0.0), 100 - 5 * (100 * F.count_if(F.col("c_acctbal") < -900) / n)).alias("vacancy"),
        F.greatest(F.lit(0.0), 100 - 20 * (100 * F.count_if(F.col("c_custkey") % 40 == 0) / n)).alias("grievance"),
        F.greatest(F.lit(0.0), 100 - 4 * F.abs(100 * (F.sum(F.col("c_acctbal").cast("decimal(18,2)")).cast("double") / (4500.0 * n) - 1))).alias("budget"),
    )
    rows = per.select("org", F.inline(F.array(*[F.struct(F.lit(name).alias("factor"), F.col(name).cast("double").alias("component"), F.lit(w).alias("weight")) for name, w in _FACTORS])))
    c = rows.withColumn("contribution", F.floor(F.round(F.col("component") * F.col("weight"), 6) * 10 + 0.5) / 10).withColumn("gap", F.round(F.col("weight") * 100 - F.col("contribution"), 1))
    w = Window.partitionBy("org")
    return c.select(
        "org", "factor", F.round("component", 6).alias("component"), "contribution", "gap", whole(F.sum("contribution").over(w)).alias("score"), (F.row_number().over(w.orderBy(F.desc("gap"), "factor")) == 1).alias("weakest")
    )


@query(
    "w28_statutory_parts",
    f"""WITH c AS (SELECT c_custkey, floor(c_acctbal * 3) + 15000 AS gross, floor((floor(c_acctbal * 3) + 15000) / 2) AS basic, c_custkey % 12 AS years, CASE c_mktsegment WHEN 'BUILDING' THEN 8000 WHEN 'MACHINERY' THEN 2500 ELSE 0 END AS tds FROM customer)
       SELECT c_custkey, CAST({_sql_whole("basic * 0.12")} AS BIGINT) AS pf, gross <= 21000 AS esic_applies, CASE WHEN gross <= 21000 THEN CAST({_sql_whole("gross * 0.0075")} AS BIGINT) END AS esic, years >= 5 AS gratuity_due, CAST(CASE WHEN years >= 5 THEN {_sql_whole("basic / 26 * 15 * years")} ELSE 0 END AS BIGINT) AS gratuity, CAST(tds AS INTEGER) AS tds FROM c""",
)
def _(t):
    gross = F.floor(F.col("c_acctbal") * 3) + 15000
    x = t.customer.select("c_custkey", gross.alias("gross"), F.floor(gross / 2).alias("basic"), (F.col("c_custkey") % 12).alias("years"), F.when(F.col("c_mktsegment") == "BUILDING", 8000).when(F.col("c_mktsegment") == "MACHINERY", 2500).otherwise(0).alias("tds"))
    low, long = F.col("gross") <= 21000, F.col("years") >= 5
    return x.select("c_custkey", whole(F.col("basic") * 0.12).alias("pf"), low.alias("esic_applies"), F.when(low, whole(F.col("gross") * 0.0075)).alias("esic"), long.alias("gratuity_due"), F.when(long, whole(F.col("basic") / 26 * 15 * F.col("years"))).otherwise(0).alias("gratuity"), "tds")


@query(
    "w33_expense_risk",
    """WITH l AS (SELECT * FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC, o_totalprice DESC LIMIT 200), m AS (SELECT c_nationkey AS org, avg(o_totalprice) AS mean FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1),
       d AS (SELECT l.*, (SELECT count(*) FROM orders x WHERE x.o_custkey = l.o_custkey AND abs(x.o_totalprice - l.o_totalprice) < 500 AND abs(date_diff('day', x.o_orderdate, l.o_orderdate)) <= 30) > 1 AS repeated, l.o_totalprice >= 2 * mean AS high FROM l JOIN customer ON c_custkey = o_custkey JOIN m ON m.org = c_nationkey)
       SELECT CASE WHEN high AND repeated THEN 'High' WHEN high OR repeated THEN 'Medium' ELSE 'Low' END AS risk, count(*) AS n, count(*) FILTER (high) AS above, count(*) FILTER (repeated) AS repeats FROM d GROUP BY 1""",
)
def _(t):
    # The latest 200 are the report's own limit; they are few enough to meet all others by a broadcast.
    latest = t.orders.orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"), F.desc("o_totalprice")).limit(200)
    members = t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    means = t.orders.join(members, "o_custkey").groupBy("c_nationkey").agg(F.avg("o_totalprice").alias("mean"))
    other = t.orders.select("o_custkey", F.col("o_totalprice").alias("p"), F.col("o_orderdate").alias("d"))
    keyed = latest.withColumn("row", F.struct("o_orderkey", "o_orderdate", "o_totalprice"))
    near = (F.abs(F.col("p") - F.col("o_totalprice")) < 500) & (F.abs(F.datediff("d", "o_orderdate")) <= 30)
    met = other.join(F.broadcast(keyed), "o_custkey").groupBy("o_custkey", "row").agg(F.count_if(near).alias("same"))
    x = met.join(members, "o_custkey").join(means, "c_nationkey").select((F.col("same") > 1).alias("repeated"), (F.col("row.o_totalprice") >= 2 * F.col("mean")).alias("high"))
    risk = F.when(F.col("high") & F.col("repeated"), "High").when(F.col("high") | F.col("repeated"), "Medium").otherwise("Low")
    return x.groupBy(risk.alias("risk")).agg(F.count("*").alias("n"), F.count_if("high").alias("above"), F.count_if("repeated").alias("repeats"))


@query(
    "w38_radar_scores",
    f"""WITH c AS (SELECT count(*) FILTER (c_acctbal <= 5000) AS a, count(*) FILTER (c_acctbal <= 5000 AND c_custkey % 9 <> 0) AS b, count(*) FILTER (c_mktsegment IN ('BUILDING', 'MACHINERY')) AS c, count(*) FILTER (c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_custkey % 8 <> 0) AS d FROM customer),
       o AS (SELECT count(*) FILTER (o_orderdate >= DATE '2001-05-01') AS e, count(*) FILTER (o_orderdate >= DATE '2001-05-01' AND o_orderstatus = 'F') AS f, count(*) AS g, count(*) FILTER (o_orderstatus = 'P') AS h FROM orders), n AS (SELECT count(*) AS i, count(*) FILTER (n_nationkey % 10 >= 8) AS j FROM nation),
       s AS (SELECT unnest(['labour law', 'payroll and tax', 'grievances', 'deadlines', 'legal exposure']) AS subject, unnest([{_sql_whole("100.0 * b / a")}, {_sql_whole("100.0 * d / greatest(1, c)")}, CASE WHEN e > 0 THEN {_sql_whole("100.0 * f / e")} ELSE 100 END, {_sql_whole("100.0 * (i - j) / i")}, {_sql_whole("100.0 * (g - h) / g")}]) AS score FROM c, o, n)
       SELECT subject, CAST(score AS BIGINT) AS score, CAST({_sql_whole("avg(score) OVER ()")} AS BIGINT) AS overall FROM s""",
)
def _(t):
    low, top = F.col("c_acctbal") <= 5000, F.col("c_mktsegment").isin("BUILDING", "MACHINERY")
    recent = F.col("o_orderdate") >= F.lit("2001-05-01").cast("date")

    def share(part: Column, of: Column) -> Column:
        return F.coalesce(F.when(of > 0, whole(100 * part / of)), F.lit(100))

    def row(subject: str, df: DataFrame, part: Column, of: Column) -> DataFrame:
        return df.agg(share(F.count_if(part), F.count_if(of)).alias("score")).select(F.lit(subject).alias("subject"), "score")

    every = row("labour law", t.customer, low & (F.col("c_custkey") % 9 != 0), low)
    every = every.unionByName(row("payroll and tax", t.customer, top & (F.col("c_custkey") % 8 != 0), top))
    every = every.unionByName(row("grievances", t.orders, recent & (F.col("o_orderstatus") == "F"), recent))
    every = every.unionByName(row("deadlines", t.nation, F.col("n_nationkey") % 10 < 8, F.lit(True)))
    every = every.unionByName(row("legal exposure", t.orders, F.col("o_orderstatus") != "P", F.lit(True)))
    overall = every.agg(whole(F.avg("score")).alias("overall"))
    return every.crossJoin(F.broadcast(overall))  # five rows and one


@query("d6_three_ratios", "SELECT l_returnflag, round(avg(l_discount / nullif(l_quantity, 0)), 12) AS mean_of_ratios, round(avg(l_discount) / avg(l_quantity), 12) AS ratio_of_means, round(sum(l_discount) FILTER (l_quantity > 10) / sum(l_quantity), 12) AS ratio_of_sums FROM lineitem GROUP BY 1")
def _(t):
    p, q = F.col("l_discount"), F.col("l_quantity")
    return t.lineitem.groupBy("l_returnflag").agg(
        F.round(F.avg(F.when(q != 0, p / q)), 12).alias("mean_of_ratios"), F.round(F.avg(p) / F.avg(q), 12).alias("ratio_of_means"), F.round(F.sum(F.when(q > 10, p)) / F.sum(q), 12).alias("ratio_of_sums")
    )


@query("c9_named_peers", "SELECT a.c_custkey, b.c_custkey AS peer FROM customer a JOIN customer b ON a.c_nationkey = b.c_nationkey AND a.c_mktsegment = b.c_mktsegment AND a.c_custkey <> b.c_custkey WHERE a.c_custkey % 50 = 0")
def _(t):
    # The members that a report names, each fiftieth here; all others only take part in windows.
    asked = t.customer.where("c_custkey % 50 = 0").select("c_custkey", "c_nationkey", "c_mktsegment")
    peers = t.customer.select(F.col("c_custkey").alias("peer"), "c_nationkey", "c_mktsegment")
    return joins.met_in_parts(asked, peers, ["c_nationkey", "c_mktsegment"], "peer").where("c_custkey <> peer").select("c_custkey", "peer")


@query(
    "x4_attendance_alerts",
    """WITH d AS (SELECT c_mktsegment || c_nationkey AS org, date_trunc('month', o_orderdate) AS m, o_custkey, CAST(count(*) FILTER (l_returnflag <> 'R') AS DOUBLE) / count(*) * 100 AS p FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2, 3),
       s AS (SELECT org, m, avg(p) AS p, row_number() OVER (PARTITION BY org ORDER BY m) - 1 AS i FROM d GROUP BY 1, 2), h AS (SELECT org, count(DISTINCT o_custkey) AS heads FROM d GROUP BY 1),
       r AS (SELECT org, count(*) AS n, CASE WHEN count(*) < 2 OR var_pop(p) = 0 THEN 0 ELSE regr_slope(p, i) END AS slope, CASE WHEN count(*) < 2 OR var_pop(p) = 0 THEN 0 ELSE regr_r2(p, i) END AS fit, avg(p) AS mp, avg(i) AS mi FROM s GROUP BY 1)
       SELECT org, heads, round(mp + slope * (n - mi), 6) AS projected, round(slope, 6) AS slope, heads >= 5 AND (round(mp + slope * (n - mi), 6) < 85 OR (slope < -0.5 AND fit >= 0.3)) AS alert FROM r JOIN h USING (org)""",
)
def _(t):
    lines = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).join(t.customer, F.col("c_custkey") == F.col("o_custkey"))
    org = F.concat("c_mktsegment", F.col("c_nationkey").cast("string")).alias("org")
    per = lines.groupBy(org, F.trunc("o_orderdate", "month").alias("m"), "o_custkey").agg((F.count_if(F.col("l_returnflag") != "R") / F.count("*") * 100).alias("p"))
    heads = lines.groupBy(org).agg(F.countDistinct("o_custkey").alias("heads"))
    series = per.groupBy("org", "m").agg(F.avg("p").alias("p")).withColumn("i", F.row_number().over(Window.partitionBy("org").orderBy("m")) - 1)
    line = windows.trend(F.col("i"), F.col("p"))
    r = series.groupBy("org").agg(F.count("*").alias("n"), line["slope"].alias("slope"), line["intercept"].alias("intercept"), line["fit"].alias("fit")).join(heads, "org")
    projected = F.round(F.col("intercept") + F.col("slope") * F.col("n"), 6)
    alert = (F.col("heads") >= 5) & ((projected < 85) | ((F.col("slope") < -0.5) & (F.col("fit") >= 0.3)))
    return r.select("org", "heads", projected.alias("projected"), F.round("slope", 6).alias("slope"), alert.alias("alert"))


@query(
    "u5_two_stage_decisions",
    """WITH RECURSIVE r AS (SELECT o_custkey AS k, o_orderdate AS d, o_orderkey AS id, CAST(o_totalprice / 100 AS DOUBLE) AS a, CAST(greatest(c_acctbal, 0) AS DOUBLE) AS b FROM orders JOIN customer ON c_custkey = o_custkey),
       q AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY d, id, a) AS i FROM r WHERE a <= 2500),
       f AS (SELECT k, i, id, a <= b AS granted, CASE WHEN a <= b THEN b - a ELSE b END AS rest FROM q WHERE i = 1 UNION ALL SELECT q.k, q.i, q.id, q.a <= f.rest, CASE WHEN q.a <= f.rest THEN f.rest - q.a ELSE f.rest END FROM f JOIN q ON q.k = f.k AND q.i = f.i + 1)
       SELECT k AS o_custkey, id AS o_orderkey, CASE WHEN granted THEN 'approved' ELSE 'no balance' END AS decision FROM f UNION ALL SELECT k, id, 'refused by officer' FROM r WHERE a > 2500""",
)
def _(t):
    requests = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select("o_custkey", "o_orderdate", "o_orderkey", (F.col("o_totalprice") / 100).alias("days"), F.greatest(F.col("c_acctbal"), F.lit(0.0)).alias("balance"))
    # The officer looks at the length, the office at the balance of what the officer let pass.
    passed = changes.decided(requests.where("days <= 2500"), "o_custkey", ["o_orderdate", "o_orderkey"], "days", "balance")
    second = passed.select("o_custkey", "o_orderkey", F.when(F.col("granted"), "approved").otherwise("no balance").alias("decision"))
    return second.unionByName(requests.where("days > 2500").select("o_custkey", "o_orderkey", F.lit("refused by officer").alias("decision")))


@query(
    "k4_integrity_counts",
    """SELECT 'unknown code' AS kind, count(*) AS n FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part) OR l_orderkey NOT IN (SELECT o_orderkey FROM orders) UNION ALL SELECT 'open end', count(*) FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)
       UNION ALL SELECT 'finish before start', count(*) FROM lineitem JOIN (SELECT o_orderkey, min(o_orderdate) AS s FROM orders GROUP BY 1) ON o_orderkey = l_orderkey WHERE l_shipdate < s
       UNION ALL SELECT 'count differs from header', count(*) FROM (SELECT l_orderkey, count(*) AS n, max(l_linenumber) AS m FROM lineitem GROUP BY 1) WHERE n <> m""",
)
def _(t):
    lines = t.lineitem
    known = lines.join(t.part.select(F.col("p_partkey").alias("l_partkey")).distinct(), "l_partkey", "left_semi").join(t.orders.select(F.col("o_orderkey").alias("l_orderkey")).distinct(), "l_orderkey", "left_semi")
    starts = t.orders.groupBy(F.col("o_orderkey").alias("l_orderkey")).agg(F.min("o_orderdate").alias("s"))
    found = {
        "unknown code": lines.agg(F.count("*").alias("n")).crossJoin(known.agg(F.count("*").alias("k"))).select((F.col("n") - F.col("k")).alias("n")),  # one row each
        "open end": t.orders.join(lines.select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_anti").agg(F.count("*").alias("n")),
        "finish before start": lines.join(starts, "l_orderkey").where("l_shipdate < s").agg(F.count("*").alias("n")),
        "count differs from header": lines.groupBy("l_orderkey").agg(F.count("*").alias("n"), F.max("l_linenumber").alias("m")).where("n <> m").agg(F.count("*").alias("n")),
    }
    out = None
    for kind, n in found.items():
        row = n.select(F.lit(kind).alias("kind"), "n")
        out = row if out is None else out.unionByName(row)
    return out
