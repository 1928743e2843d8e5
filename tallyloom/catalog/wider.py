"""Workbooks against their contract price, cases and incidents, and figures that repeat over pages: whole rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.catalog.bills import _items
from tallyloom.catalog.registry import query
from tallyloom.catalog.relational import AS_OF, as_of, day
from tallyloom.operators import aggregates
from tallyloom.plans import bills, layout, schedule

_BOOK = """WITH items AS (SELECT l_orderkey AS doc, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS i, CAST(l_extendedprice AS DECIMAL(18,2)) AS amount FROM lineitem),
       s AS (SELECT doc, sum(amount) AS total, coalesce(sum(amount) FILTER (i <= 2), 0) AS a, coalesce(sum(amount) FILTER (i > 2), 0) AS b FROM items GROUP BY 1)"""


@query(
    "v13_contract_ties",
    _BOOK
    + """, p AS (SELECT *, CASE WHEN doc % 8 <> 0 AND total + CASE WHEN doc % 9 = 0 THEN 500 ELSE 0 END > 10000 THEN total + CASE WHEN doc % 9 = 0 THEN 500 ELSE 0 END END AS price FROM s),
       t AS (SELECT *, CASE WHEN doc % 3 = 0 THEN CASE WHEN total >= 1000 THEN [total] ELSE [] END WHEN doc % 3 = 1 THEN list_filter([a, b], lambda x: x >= 1000) ELSE [] END AS amounts FROM p)
       SELECT doc, CAST(price AS DOUBLE) AS price, CAST(len(amounts) AS BIGINT) AS totals, CASE WHEN price IS NULL OR len(amounts) = 0 THEN NULL ELSE len(list_filter(amounts, lambda x: abs(x - price) <= 1)) > 0 OR abs(list_sum(amounts) - price) <= greatest(1, ceil(0.5 * len(amounts))) END AS passed,
         CASE WHEN price IS NULL OR len(amounts) = 0 THEN 'not tested' WHEN len(list_filter(amounts, lambda x: abs(x - price) <= 1)) > 0 THEN 'one total' WHEN abs(list_sum(amounts) - price) <= greatest(1, ceil(0.5 * len(amounts))) THEN 'sum of sub-totals' ELSE 'does not tie out' END AS how FROM t""",
)
def _(t):
    doc, text = F.col("doc"), lambda c: c.cast("string")
    items = _items(t).select("doc", "i", "amount")
    sums = items.groupBy("doc").agg(F.sum("amount").alias("total"), F.sum(F.when(F.col("i") <= 2, F.col("amount"))).alias("a"), F.sum(F.when(F.col("i") > 2, F.col("amount"))).alias("b"))
    price = F.col("total") + F.when(doc % 9 == 0, 500).otherwise(0)
    label = F.when(doc % 2 == 0, "Total Contract Price (Rs)").otherwise("अनुबंध राशि")
    row = lambda at, *cells: F.struct(F.lit(at).alias("row"), F.array(*(c if hasattr(c, "cast") else F.lit(c) for c in cells)).alias("cells"))
    heads = F.array(F.when(doc % 8 != 0, row(2, label, "", text(price))))
    totals = F.when(doc % 3 == 0, F.array(row(10**6, "Grand Total", "1.0", text(F.col("total"))))).when(doc % 3 == 1, F.array(row(20, "Sub-Total A", "1.00", text(F.col("a"))), row(10**6, "Sub-Total B", "1", text(F.col("b")))))
    rows = sums.select("doc", F.explode(F.array_compact(F.concat(heads, F.coalesce(totals, F.array().cast("array<struct<row:int,cells:array<string>>>"))))).alias("r")).select("doc", "r.*")
    lines = items.select("doc", (F.col("i") * 10 + 41).cast("int").alias("row"), F.array(F.lit("supply"), text(F.col("amount")), F.lit("0.25")).alias("cells"))
    cells = rows.unionByName(lines).select("doc", "row", F.posexplode("cells").alias("col", "raw"))
    return bills.contract_ties(cells, "doc")


_CASES = f"""WITH c AS (SELECT o_orderkey, o_totalprice, CASE o_orderkey % 4 WHEN 0 THEN 'Pending' WHEN 1 THEN 'Stayed' WHEN 2 THEN 'Disposed - Favorable' ELSE 'Disposed - Unfavorable' END AS status,
         CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 70 WHEN '2' THEN 60 WHEN '3' THEN 55 WHEN '4' THEN 45 ELSE 20 END AS base, {AS_OF} - CAST(o_orderdate AS DATE) AS days FROM orders),
       r AS (SELECT *, greatest(5, least(95, base + CASE WHEN status = 'Pending' AND days > 365 THEN 10 ELSE 0 END + CASE status WHEN 'Disposed - Unfavorable' THEN 15 WHEN 'Disposed - Favorable' THEN -35 WHEN 'Stayed' THEN -10 ELSE 0 END)) AS score FROM c),
       k AS (SELECT *, CASE WHEN score >= 65 THEN 'High' WHEN score >= 35 THEN 'Medium' ELSE 'Low' END AS class, CASE status WHEN 'Disposed - Favorable' THEN 100 WHEN 'Disposed - Unfavorable' THEN 0 ELSE greatest(5, least(95, 100 - score)) END AS win FROM r)"""


def _cases(t):
    kind = {"1": "Land Acquisition", "2": "Encroachment & Demolition", "3": "Labour Dispute", "4": "Property Tax Dispute", "5": "RTI Appeal"}
    k, first = F.col("o_orderkey") % 4, F.substring("o_orderpriority", 1, 1)
    named = F.lit(None).cast("string")
    for mark, name in kind.items():
        named = F.when(first == mark, name).otherwise(named)
    status = F.when(k == 0, "Pending").when(k == 1, "Stayed").when(k == 2, "Disposed - Favorable").otherwise("Disposed - Unfavorable")
    rows = t.orders.select("o_orderkey", "o_totalprice", named.alias("type"), status.alias("status"), F.datediff(as_of(), day("o_orderdate")).alias("days"))
    return aggregates.case_risk(rows)


@query("w37_case_scores", _CASES + " SELECT o_orderkey, score, win, class FROM k")
def _(t):
    return _cases(t).select("o_orderkey", "score", "win", "class")


@query("w37_exposure", _CASES + " SELECT class, count(*) AS cases, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS exposure, max(score) AS highest FROM k WHERE status IN ('Pending', 'Stayed') GROUP BY 1")
def _(t):
    open_ = _cases(t).where(F.col("status").isin("Pending", "Stayed"))
    return open_.groupBy("class").agg(F.count("*").alias("cases"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("exposure"), F.max("score").alias("highest"))


@query(
    "w34_six_months",
    f"WITH m AS (SELECT CAST(unnest(generate_series(date_trunc('month', {AS_OF}) - INTERVAL 5 MONTH, date_trunc('month', {AS_OF}), INTERVAL 1 MONTH)) AS DATE) AS month) SELECT month, count(o_orderkey) AS volume, count(*) FILTER (o_orderpriority = '1-URGENT') AS critical FROM m LEFT JOIN orders ON CAST(date_trunc('month', o_orderdate) AS DATE) = month GROUP BY 1",
)
def _(t):
    months = t.spark.range(1).select(F.explode(F.sequence(F.add_months(F.trunc(as_of(), "month"), -5), F.trunc(as_of(), "month"), F.expr("INTERVAL 1 MONTH"))).alias("month"))
    per = t.orders.where(day("o_orderdate") >= F.add_months(F.trunc(as_of(), "month"), -5)).groupBy(F.trunc(day("o_orderdate"), "month").alias("month")).agg(F.count("*").alias("volume"), F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("critical"))
    return months.join(per, "month", "left").fillna(0, ["volume", "critical"])


@query("w34_open_by_org", "SELECT c_nationkey, count(*) AS open, count(*) FILTER (o_orderpriority = '1-URGENT') AS critical FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus <> 'F' GROUP BY 1")
def _(t):
    open_ = t.orders.where("o_orderstatus <> 'F'").join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    return open_.groupBy("c_nationkey").agg(F.count("*").alias("open"), F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("critical"))


@query(
    "e15_repeated_figures",
    """WITH f AS (SELECT l_suppkey AS doc, l_orderkey AS page, l_linenumber, l_partkey, CASE WHEN l_linenumber = 1 THEN 'raster ' || l_partkey % 40 ELSE 'drawn ' || l_partkey % 7 || ' ' || l_linenumber || ' ' || l_partkey % 5 || ' ' || l_partkey % 3 END AS sig FROM lineitem),
       n AS (SELECT doc, sig, count(DISTINCT page) AS pages FROM f GROUP BY 1, 2) SELECT doc, page, l_linenumber, l_partkey, pages >= 2 AS decorative FROM f JOIN n USING (doc, sig)""",
)
def _(t):
    p, n = F.col("l_partkey"), F.col("l_linenumber")
    # The first line's figure is an image with a number, others are drawn boxes that differ by little.
    figures = t.lineitem.select(
        F.col("l_suppkey").alias("doc"), F.col("l_orderkey").alias("page"), "l_linenumber", "l_partkey", F.when(n == 1, p % 40).alias("image"), ((p % 7) * 8 + p % 3).cast("double").alias("x0"), (n * 8.0).alias("y0"), ((p % 7) * 8 + p % 3 + (p % 5 + 1) * 8).cast("double").alias("x1"), (n * 8.0 + (p % 3 + 1) * 8).alias("y1")
    )
    return layout.repeated_figures(figures, "doc", "page").select("doc", "page", "l_linenumber", "l_partkey", "decorative")


@query(
    "n28_kinds_and_caps",
    """WITH d AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_partkey % 1900 + 20 AS w, (l_suppkey * 7) % 900 * CASE WHEN l_linenumber = 7 THEN 400 ELSE 1 END AS h FROM lineitem)
       SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN greatest(w, h) <= 160 THEN 'icon/logo' WHEN greatest(w, h) >= 6 * greatest(1, least(w, h)) THEN 'banner/rule' ELSE 'photo/figure' END AS kind, w > 0 AND h > 0 AND w * h <= 300 * 1000000 AS safe FROM d""",
)
def _(t):
    w, h = F.col("l_partkey") % 1900 + 20, (F.col("l_suppkey") * 7) % 900 * F.when(F.col("l_linenumber") == 7, 400).otherwise(1)
    return layout.image_kinds(t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", w.alias("w"), h.alias("h"))).drop("w", "h")


@query(
    "g11_years_covered",
    f"""WITH a AS (SELECT o_custkey AS member, year(l_shipdate) AS y, count(*) AS absent FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_returnflag = 'R' GROUP BY 1, 2),
       q AS (SELECT o_custkey AS member, year(o_orderdate) AS y, sum(o_orderkey % 5 + 1) AS days FROM orders WHERE o_orderstatus = 'F' GROUP BY 1, 2)
       SELECT a.member, a.y, absent, CAST(coalesce(days, 0) AS BIGINT) AS approved, CAST(least(100, floor(CAST(coalesce(days, 0) AS DOUBLE) / absent * 100 + 0.5)) AS BIGINT) AS covered FROM a LEFT JOIN q ON q.member = a.member AND q.y = a.y""",
)
def _(t):
    # Lines that came back are days of absence, finished orders approved leave of some days.
    absent = t.lineitem.where("l_returnflag = 'R'").join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy(F.col("o_custkey").alias("member"), F.year("l_shipdate").alias("y")).agg(F.count("*").alias("absent"))
    leave = t.orders.where("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("member"), F.year("o_orderdate").alias("y")).agg(F.sum(F.col("o_orderkey") % 5 + 1).alias("approved"))
    both = absent.join(leave, ["member", "y"], "left").fillna(0, ["approved"])
    return both.withColumn("covered", F.least(F.lit(100), F.floor(F.col("approved") / F.col("absent") * 100 + 0.5)))


@query(
    "k3_chosen_baseline",
    """WITH b AS (SELECT count(*) FILTER (o_orderstatus = 'F') >= count(*) FILTER (o_orderstatus = 'O') AS first FROM orders)
       SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(CAST(l_shipdate AS DATE) - CASE WHEN CASE WHEN first THEN o_orderstatus = 'F' ELSE o_orderstatus = 'O' END THEN CAST(o_orderdate AS DATE) END AS INTEGER) AS variance, CASE WHEN l_suppkey % 4 = 0 THEN l_returnflag = 'R' ELSE l_linenumber - 3 <= 0 END AS critical
       FROM lineitem JOIN orders ON o_orderkey = l_orderkey, b""",
)
def _(t):
    d, s = day("o_orderdate"), F.col("o_orderstatus")
    tasks = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", day("l_shipdate").alias("start"), F.when(s == "F", d).alias("b0"), F.when(s == "O", d).alias("b1"), F.when(F.col("l_suppkey") % 4 > 0, F.col("l_linenumber") - 3).alias("total_float"), (F.col("l_returnflag") == "R").alias("native_critical")
    )
    plans = t.orders.select(F.when(s == "F", d).alias("b0"), F.when(s == "O", d).alias("b1"))
    return schedule.against_baseline(tasks, schedule.chosen_baseline(plans, ["b0", "b1"]), ["b0", "b1"]).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "variance", "critical")


_SPENT = """WITH r AS (SELECT c_nationkey AS org, CAST(date_trunc('month', o_orderdate) AS DATE) AS m, 150000 AS allocated, CASE WHEN o_orderkey % 10 > 0 THEN CAST(o_totalprice AS DECIMAL(18,2)) END AS spent FROM orders JOIN customer ON c_custkey = o_custkey),
       v AS (SELECT org, m, (CAST(sum(spent) AS DOUBLE) - sum(allocated)) / sum(allocated) * 100 AS pct FROM r WHERE spent IS NOT NULL GROUP BY 1, 2), x AS (SELECT *, row_number() OVER (PARTITION BY org ORDER BY m) - 1 AS i, count(*) OVER (PARTITION BY org) AS months FROM v),
       p AS (SELECT org, max(months) AS months, arg_max(pct, i) AS now, CASE WHEN var_pop(pct) = 0 THEN 0 ELSE regr_slope(pct, i) END AS slope, avg(pct) AS mp, avg(i) AS mi, CASE WHEN var_pop(pct) = 0 THEN 0 ELSE regr_r2(pct, i) END AS fit FROM x WHERE months >= 6 GROUP BY 1),
       q AS (SELECT org, months, floor(round(now * 10, 6) + 0.5) / 10 AS now, floor(round((mp - slope * mi + slope * months) * 10, 6) + 0.5) / 10 AS ahead, fit FROM p)"""


@query("x5_overrun_projections", _SPENT + " SELECT org, months, now, ahead, ahead > 10 AS alert FROM q")
def _(t):
    return aggregates.overruns(_spending(t)).select("org", "months", "now", "ahead", "alert")


@query(
    "x5_overrun_confidence",
    _SPENT
    + """ SELECT count(*) FILTER (ahead > 10) AS alerts, (SELECT count(*) FILTER (spent IS NULL) FROM r) AS missing, CAST(greatest(5, least(97, floor(round(coalesce(avg(fit) FILTER (ahead > 10), 0) * 85 - 100 * (SELECT CAST(count(*) FILTER (spent IS NULL) AS DOUBLE) / count(*) FROM r) - greatest(0, (10 - least(count(*), 10)) / 10.0::DOUBLE) * 10, 6) + 0.5))) AS BIGINT) AS confidence FROM q""",
)
def _(t):
    return aggregates.overrun_confidence(_spending(t))


def _spending(t):
    joined = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    return joined.select(F.col("c_nationkey").alias("org"), F.trunc(day("o_orderdate"), "month").alias("m"), F.lit(150000).alias("allocated"), F.when(F.col("o_orderkey") % 10 > 0, F.col("o_totalprice").cast("decimal(18,2)")).alias("spent"))
