"""Summaries and alerts of organisations and members with all of their rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.catalog.members import _FACTS, _sql_whole, facts, whole
from tallyloom.catalog.registry import query
from tallyloom.functions.numbers import band, total
from tallyloom.operators import windows


def stacked(*rows: DataFrame) -> DataFrame:
    out = rows[0]
    for row in rows[1:]:
        out = out.unionByName(row)
    return out


@query(
    "w9_potential_by_year",
    """WITH y AS (SELECT o_custkey AS k, year(o_orderdate) AS y, floor(100.0 * count(*) FILTER (o_orderstatus <> 'P') / count(*) + 0.5) AS sla, floor(least(5.0, greatest(1.0, round(avg(o_totalprice) / 80000, 6))) * 20 + 0.5) AS perf FROM orders GROUP BY 1, 2),
       s AS (SELECT k, y, c_nationkey, c_mktsegment, CAST(floor(round(perf * 0.55 + sla * 0.45, 6) + 0.5) AS BIGINT) AS score FROM y JOIN customer ON c_custkey = k)
       SELECT k AS o_custkey, y, score, CAST(rank() OVER w - 1 AS DOUBLE) / nullif(count(*) OVER p - 1, 0) AS below FROM s WINDOW w AS (PARTITION BY y, c_nationkey, c_mktsegment ORDER BY score), p AS (PARTITION BY y, c_nationkey, c_mktsegment)""",
)
def _(t):
    n = F.count("*")
    per = t.orders.groupBy("o_custkey", F.year("o_orderdate").alias("y")).agg(
        F.floor(100 * F.count_if(F.col("o_orderstatus") != "P") / n + 0.5).alias("sla"), F.floor(F.least(F.lit(5.0), F.greatest(F.lit(1.0), F.round(F.avg("o_totalprice") / 80000, 6))) * 20 + 0.5).alias("perf")
    )
    s = per.join(t.customer, F.col("c_custkey") == F.col("o_custkey")).withColumn("score", whole(F.col("perf") * 0.55 + F.col("sla") * 0.45))
    return windows.among_peers(s, ["y", "c_nationkey", "c_mktsegment"], "score").select("o_custkey", "y", "score", F.col("percentile").alias("below"))


@query(
    "w17_reallocation_of_three",
    """WITH m AS (SELECT c_nationkey AS org, c_custkey, count(o_orderkey) FILTER (o_orderstatus <> 'F') AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2), s AS (SELECT org, sum(n) AS n, count(*) AS heads FROM m GROUP BY 1),
       x AS (SELECT *, rank() OVER (ORDER BY CAST(n AS DOUBLE) / heads DESC, org) AS hi, rank() OVER (ORDER BY CAST(n AS DOUBLE) / heads, org) AS lo FROM s) SELECT org, round(CAST(n AS DOUBLE) / heads, 9) AS before, round(CAST(n - CASE WHEN hi = 1 THEN 3 ELSE 0 END + CASE WHEN lo = 1 AND hi <> 1 THEN 3 ELSE 0 END AS DOUBLE) / heads, 9) AS after FROM x""",
)
def _(t):
    # Three open tasks move from the organisation with most a head to the one with fewest.
    load = t.orders.where("o_orderstatus <> 'F'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    s = t.customer.join(load, "c_custkey", "left").groupBy(F.col("c_nationkey").alias("org")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("heads"))
    mean = F.col("n") / F.col("heads")
    ends = s.agg(F.min_by("org", F.struct(-mean, "org")).alias("from"), F.min_by("org", F.struct(mean, "org")).alias("to"))
    x = s.crossJoin(F.broadcast(ends))  # one row
    moved = F.when(F.col("org") == F.col("from"), -3).when(F.col("org") == F.col("to"), 3).otherwise(0)
    return x.select("org", F.round(mean, 9).alias("before"), F.round((F.col("n") + moved) / F.col("heads"), 9).alias("after"))


@query(
    "w20_summaries",
    """SELECT 'members' AS summary, 'all' AS key, CAST(count(*) AS DOUBLE) AS value FROM customer UNION ALL SELECT 'by segment', c_mktsegment, count(*) FROM customer GROUP BY 2 UNION ALL SELECT 'by zone', r_name, count(*) FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY 2
       UNION ALL SELECT 'attendance', r_name, round(100.0 * count(*) FILTER (l_returnflag <> 'R') / count(*), 6) FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY 2 UNION ALL SELECT 'total pay', 'all', CAST(sum(CAST(c_acctbal AS DECIMAL(18,2))) AS DOUBLE) FROM customer""",
)
def _(t):
    places = t.nation.join(F.broadcast(t.region), F.col("r_regionkey") == F.col("n_regionkey")).select(F.col("n_nationkey").alias("c_nationkey"), "r_name")  # 25 rows
    placed = t.customer.join(F.broadcast(places), "c_nationkey")
    lines = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).join(placed, F.col("c_custkey") == F.col("o_custkey"))

    def by(df, name, key, value):
        return df.groupBy(F.lit(name).alias("summary"), key.alias("key")).agg(value.cast("double").alias("value"))

    n, every = F.count("*"), F.lit("all")
    rate = F.round(100 * F.count_if(F.col("l_returnflag") != "R") / n, 6)
    return stacked(by(t.customer, "members", every, n), by(t.customer, "by segment", F.col("c_mktsegment"), n), by(placed, "by zone", F.col("r_name"), n), by(lines, "attendance", F.col("r_name"), rate), by(t.customer, "total pay", every, total("c_acctbal")))


@query(
    "w23_six_alerts",
    _FACTS
    + """ , m AS (SELECT date_trunc('month', o_orderdate) AS m, count(*) FILTER (o_orderstatus = 'P') AS absent FROM orders GROUP BY 1), d AS (SELECT absent - lag(absent) OVER (ORDER BY m) AS rise FROM m), b AS (SELECT c_nationkey AS org, sum(CAST(c_acctbal AS DECIMAL(18,2))) > 4500.0 * count(*) AS over FROM customer GROUP BY 1)
       SELECT 'worst rise' AS metric, CAST((SELECT max(rise) FROM d) AS BIGINT) AS n UNION ALL SELECT 'declining', count(*) FILTER (delta < 0) FROM g UNION ALL SELECT 'milestone near', count(*) FILTER (c_custkey % 1000 BETWEEN 900 AND 930) FROM g
       UNION ALL SELECT 'leaving', count(*) FILTER (tenure >= 7) FROM g UNION ALL SELECT 'over budget', (SELECT count(*) FROM b WHERE over) UNION ALL SELECT 'at risk', count(*) FILTER (score < 60) FROM g""",
)
def _(t):
    months = t.orders.groupBy(F.trunc("o_orderdate", "month").alias("m")).agg(F.count_if(F.col("o_orderstatus") == "P").alias("absent"))
    rise = months.select((F.col("absent") - F.lag("absent").over(Window.orderBy("m"))).alias("rise"))  # one row a month
    orgs = t.customer.groupBy("c_nationkey").agg((F.sum(F.col("c_acctbal").cast("decimal(18,2)")) > 4500 * F.count("*")).alias("over"))
    g = facts(t).agg(
        F.count_if(F.col("delta") < 0).alias("declining"), F.count_if((F.col("c_custkey") % 1000).between(900, 930)).alias("milestone near"), F.count_if(F.col("tenure") >= 7).alias("leaving"), F.count_if(F.col("score") < 60).alias("at risk")
    )
    own = g.select(F.inline(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(f"`{c}`").alias("n")) for c in ("declining", "milestone near", "leaving", "at risk")])))
    return stacked(rise.agg(F.max("rise").alias("n")).select(F.lit("worst rise").alias("metric"), "n"), own, orgs.agg(F.count_if("over").alias("n")).select(F.lit("over budget").alias("metric"), "n"))


_READY = ["digitisation", "appraisal", "training", "establishment"]
_ACTIONS = {"digitisation": "scan records", "appraisal": "close appraisals", "training": "schedule courses", "establishment": "fill posts"}


@query(
    "w25_readiness_matrix",
    _FACTS
    + f""", r AS (SELECT c_nationkey AS org, round(avg(documents), 6) AS digitisation, round(100.0 * count(latest) / count(*), 6) AS appraisal, round(avg(training), 6) AS training, round(100.0 * count(*) FILTER (c_acctbal >= -500) / count(*), 6) AS establishment FROM g GROUP BY 1),
       u AS (SELECT org, unnest([{', '.join(repr(x) for x in _READY)}]) AS part, unnest([{', '.join(_READY)}]) AS v FROM r), w AS (SELECT org, arg_min(part, (v, part)) AS weakest FROM u GROUP BY 1)
       SELECT org, {', '.join(_READY)}, weakest, CASE weakest {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in _ACTIONS.items())} END AS action FROM r JOIN w USING (org)""",
)
def _(t):
    n = F.count("*")
    r = facts(t).groupBy(F.col("c_nationkey").alias("org")).agg(
        F.round(F.avg("documents"), 6).alias("digitisation"), F.round(100 * F.count("latest") / n, 6).alias("appraisal"), F.round(F.avg("training"), 6).alias("training"), F.round(100 * F.count_if(F.col("c_acctbal") >= -500) / n, 6).alias("establishment")
    )
    least = F.array_min(F.array(*[F.struct(F.col(x).alias("v"), F.lit(x).alias("part")) for x in _READY]))["part"]
    action = F.create_map(*[F.lit(x) for pair in _ACTIONS.items() for x in pair])
    return r.withColumn("weakest", least).withColumn("action", action[F.col("weakest")])


@query(
    "w26_training_needs",
    """WITH x AS (SELECT c_mktsegment AS org, p_type AS course, l_linestatus = 'F' AS done FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON c_custkey = o_custkey JOIN part ON p_partkey = l_partkey), y AS (SELECT org, course, count(*) AS enrolled, count(*) FILTER (done) AS completed FROM x GROUP BY 1, 2),
       z AS (SELECT *, row_number() OVER (PARTITION BY org ORDER BY enrolled - completed DESC, course) = 1 AS most_needed FROM y) SELECT org, course, enrolled, completed, round(100.0 * completed / enrolled, 6) AS rate, most_needed FROM z""",
)
def _(t):
    lines = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).join(t.customer, F.col("c_custkey") == F.col("o_custkey")).join(t.part, F.col("p_partkey") == F.col("l_partkey"))
    y = lines.groupBy(F.col("c_mktsegment").alias("org"), F.col("p_type").alias("course")).agg(F.count("*").alias("enrolled"), F.count_if(F.col("l_linestatus") == "F").alias("completed"))
    open_ = F.row_number().over(Window.partitionBy("org").orderBy(F.desc(F.col("enrolled") - F.col("completed")), "course"))
    return y.select("org", "course", "enrolled", "completed", F.round(100 * F.col("completed") / F.col("enrolled"), 6).alias("rate"), (open_ == 1).alias("most_needed"))


_BANDS = "CASE WHEN used <= 70 THEN 'low' WHEN used <= 95 THEN 'normal' WHEN used <= 105 THEN 'full' ELSE 'over' END"


@query(
    "w31_budget_report",
    f"""WITH m AS (SELECT c_nationkey AS org, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS spent, count(*) * 250000 AS allocated FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1), v AS (SELECT org, CAST(spent AS DOUBLE) AS spent, CAST(allocated AS DOUBLE) AS allocated, round(100.0 * CAST(spent AS DOUBLE) / allocated, 6) AS used FROM m)
       SELECT org, spent, allocated, round(used - 100, 6) AS variance, {_BANDS} AS utilisation, used > 105 AS over_list, used < 95 AS under_list FROM v""",
)
def _(t):
    m = t.orders.join(t.customer, F.col("c_custkey") == F.col("o_custkey")).groupBy(F.col("c_nationkey").alias("org")).agg(total("o_totalprice").alias("spent"), (F.count("*") * 250000).cast("double").alias("allocated"))
    v = m.withColumn("used", F.round(100 * F.col("spent") / F.col("allocated"), 6))
    return v.select("org", "spent", "allocated", F.round(F.col("used") - 100, 6).alias("variance"), band(F.col("used"), [70, 95, 105], ["low", "normal", "full", "over"]).alias("utilisation"), (F.col("used") > 105).alias("over_list"), (F.col("used") < 95).alias("under_list"))


@query(
    "w42_three_indicators",
    _FACTS
    + """ , r AS (SELECT c_nationkey AS org, count(*) FILTER (tenure >= 7) AS leaving, count(*) FILTER (performance >= 60) AS due, avg(documents) AS complete FROM g GROUP BY 1)
       (SELECT 'largest retirement' AS indicator, org FROM r ORDER BY leaving DESC, org LIMIT 1) UNION ALL (SELECT 'largest promotion', org FROM r ORDER BY due DESC, org LIMIT 1) UNION ALL (SELECT 'lowest completeness', org FROM r ORDER BY round(complete, 6), org LIMIT 1)""",
)
def _(t):
    r = facts(t).groupBy(F.col("c_nationkey").alias("org")).agg(F.count_if(F.col("tenure") >= 7).alias("leaving"), F.count_if(F.col("performance") >= 60).alias("due"), F.round(F.avg("documents"), 6).alias("complete"))
    first = r.agg(F.min_by("org", F.struct(-F.col("leaving"), "org")).alias("largest retirement"), F.min_by("org", F.struct(-F.col("due"), "org")).alias("largest promotion"), F.min_by("org", F.struct("complete", "org")).alias("lowest completeness"))
    return first.select(F.inline(F.array(*[F.struct(F.lit(c).alias("indicator"), F.col(f"`{c}`").alias("org")) for c in first.columns])))


@query(
    "w29_pay_parts",
    f"WITH p AS (SELECT c_custkey, floor(c_acctbal * 3) + 15000 AS gross FROM customer), q AS (SELECT c_custkey, gross, {_sql_whole('gross * 0.5')} AS basic, {_sql_whole('gross * 0.2')} AS housing, {_sql_whole('gross * 0.2')} AS dearness FROM p), s AS (SELECT sum(gross) AS g, sum(basic) AS b, sum(housing) AS h, sum(dearness) AS d FROM q) SELECT c_custkey, CAST(basic AS BIGINT) AS basic, CAST(housing AS BIGINT) AS housing, CAST(dearness AS BIGINT) AS dearness, CAST(gross - basic - housing - dearness AS BIGINT) AS other, round(100 * CAST(b AS DOUBLE) / CAST(g AS DOUBLE), 6) AS basic_share, round(100 * CAST(h AS DOUBLE) / CAST(g AS DOUBLE), 6) AS housing_share, round(100 * CAST(d AS DOUBLE) / CAST(g AS DOUBLE), 6) AS dearness_share FROM q, s",
)
def _(t):
    gross = F.floor(F.col("c_acctbal") * 3) + 15000
    q = t.customer.select("c_custkey", gross.alias("gross")).withColumns({"basic": whole(F.col("gross") * 0.5), "housing": whole(F.col("gross") * 0.2), "dearness": whole(F.col("gross") * 0.2)})
    shares = q.agg(*(F.round(100 * F.sum(c).cast("double") / F.sum("gross").cast("double"), 6).alias(f"{c}_share") for c in ("basic", "housing", "dearness")))
    return q.crossJoin(F.broadcast(shares)).select("c_custkey", "basic", "housing", "dearness", (F.col("gross") - F.col("basic") - F.col("housing") - F.col("dearness")).alias("other"), *shares.columns)  # one row


@query("w35_funnel_and_onboarding", "SELECT 'funnel' AS part, CASE o_orderstatus WHEN 'O' THEN 'applied' WHEN 'P' THEN 'interview' ELSE 'joined' END AS key, count(*) AS n, CAST(NULL AS DOUBLE) AS done FROM orders GROUP BY 2 UNION ALL SELECT 'onboarding', CASE WHEN d = 100 THEN 'complete' WHEN d > 0 THEN 'under way' ELSE 'not begun' END, count(*), round(avg(d), 6) FROM (SELECT l_orderkey, 100.0 * count(*) FILTER (l_linestatus = 'F') / count(*) AS d FROM lineitem GROUP BY 1) GROUP BY 2")
def _(t):
    status = F.col("o_orderstatus")
    funnel = t.orders.groupBy(F.lit("funnel").alias("part"), F.when(status == "O", "applied").when(status == "P", "interview").otherwise("joined").alias("key")).agg(F.count("*").alias("n"), F.lit(None).cast("double").alias("done"))
    d = t.lineitem.groupBy("l_orderkey").agg((100 * F.count_if(F.col("l_linestatus") == "F") / F.count("*")).alias("d"))
    stage = F.when(F.col("d") == 100, "complete").when(F.col("d") > 0, "under way").otherwise("not begun")
    return stacked(funnel, d.groupBy(F.lit("onboarding").alias("part"), stage.alias("key")).agg(F.count("*").alias("n"), F.round(F.avg("d"), 6).alias("done")))


@query("k3_float_criticality", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, date_diff('day', CAST(b AS DATE), CAST(l_shipdate AS DATE)) AS variance_days, CAST(e - i AS BIGINT) AS float_days, e - i <= 0 AS critical FROM (SELECT *, min(l_shipdate) OVER (PARTITION BY l_orderkey) AS b, max(l_linenumber) OVER (PARTITION BY l_orderkey) AS e, l_linenumber AS i FROM lineitem)")
def _(t):
    w = Window.partitionBy("l_orderkey")
    slack = (F.max("l_linenumber").over(w) - F.col("l_linenumber")).cast("long")
    # The order's first shipping stands for its baseline, lines after this one for its float.
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.datediff("l_shipdate", F.min("l_shipdate").over(w)).alias("variance_days"), slack.alias("float_days"), (slack <= 0).alias("critical"))
