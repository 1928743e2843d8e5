"""Reports and combined checks over the supplied tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyloom.catalog.applied import _COMPOSITE, _composite
from tallyloom.catalog.registry import query
from tallyloom.catalog.relational import AS_OF, as_of, day
from tallyloom.functions import text
from tallyloom.functions.numbers import half_up, money
from tallyloom.plans import verify


@query("a9_training_report", "SELECT p_brand AS course, count(*) AS enrolled, count(*) FILTER (l_linestatus = 'F') AS completed FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1")
def _(t):
    joined = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    return joined.groupBy(F.col("p_brand").alias("course")).agg(F.count("*").alias("enrolled"), F.count_if(F.col("l_linestatus") == "F").alias("completed"))


@query("g11_covered_days", "SELECT year(l_shipdate) AS y, count(*) AS absent, least(100, CAST(floor(CAST(count(*) FILTER (l_returnflag <> 'R') AS DOUBLE) / count(*) * 100 + 0.5) AS BIGINT)) AS covered FROM lineitem GROUP BY 1")
def _(t):
    share = half_up(F.count_if(F.col("l_returnflag") != "R") / F.count("*") * 100).cast("long")
    return t.lineitem.groupBy(F.year("l_shipdate").alias("y")).agg(F.count("*").alias("absent"), F.least(F.lit(100), share).alias("covered"))


@query(
    "n15_engine_agreement",
    """WITH a AS (SELECT conv_id, turn, list_distinct(list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda x: x <> '')) AS w FROM conversations), p AS (SELECT x.conv_id, x.turn, len(list_intersect(x.w, y.w)) AS i, len(x.w) AS n, len(y.w) AS m FROM a x JOIN a y ON y.conv_id = x.conv_id AND y.turn = x.turn + 1)
       SELECT conv_id, turn, round((0.7::DOUBLE * CASE WHEN least(n, m) > 0 THEN CAST(i AS DOUBLE) / least(n, m) ELSE 0 END + 0.3::DOUBLE * CASE WHEN n + m - i > 0 THEN CAST(i AS DOUBLE) / (n + m - i) ELSE 0 END) * CASE WHEN least(n, m) < 8 THEN least(n, m) / 8.0::DOUBLE ELSE 1 END, 9) AS agreement FROM p""",
)
def _(t):
    a = t.conversations.select("conv_id", "turn", text.tokens(F.col("text")).alias("w"))
    b = a.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("w").alias("v"))
    w, v = F.col("w"), F.col("v")
    smaller = F.least(F.size(w), F.size(v))
    score = 0.7 * text.overlap(w, v) + 0.3 * text.jaccard(w, v)
    return a.join(b, ["conv_id", "turn"]).select("conv_id", "turn", F.round(score * F.when(smaller < 8, smaller / 8.0).otherwise(1.0), 9).alias("agreement"))


@query(
    "n25_merged_paragraphs",
    """WITH l AS (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents)),
       b AS (SELECT *, CASE WHEN coalesce(regexp_matches(lag(line) OVER w, '[.!?]$'), true) THEN 1 ELSE 0 END AS o FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY n)), i AS (SELECT *, sum(o) OVER (PARTITION BY doc_id ORDER BY n) AS p FROM b)
       SELECT doc_id, CAST(p AS BIGINT) AS paragraph, string_agg(line, ' ' ORDER BY n) AS merged FROM i GROUP BY 1, 2""",
)
def _(t):
    lines = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    w = Window.partitionBy("doc_id").orderBy("pos")
    opens = F.when(F.coalesce(F.lag("line").over(w).rlike("[.!?]$"), F.lit(True)), 1).otherwise(0)
    numbered = lines.withColumn("o", opens).withColumn("paragraph", F.sum("o").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"])
    return numbered.groupBy("doc_id", "paragraph").agg(F.array_join(parts, " ").alias("merged"))


@query("v3_column_roles", "SELECT l_orderkey, CASE WHEN max(l_quantity) <= max(l_extendedprice) THEN 'quantity' ELSE 'price' END AS smaller FROM lineitem GROUP BY 1")
def _(t):
    columns = F.array(F.struct(F.max("l_quantity").alias("m"), F.lit("quantity").alias("c")), F.struct(F.max("l_extendedprice").alias("m"), F.lit("price").alias("c")))
    return t.lineitem.groupBy("l_orderkey").agg(F.array_min(columns).alias("least")).select("l_orderkey", F.when(F.col("least.c") == "quantity", "quantity").otherwise("price").alias("smaller"))


@query(
    "v10_table_verdict",
    "SELECT l_orderkey, count(*) FILTER (abs(l_quantity * 100 - l_extendedprice) > greatest(1.0, abs(l_extendedprice) * 0.005)) > 0 OR count(*) FILTER (l_returnflag = 'N') = 0 OR count(DISTINCT l_linenumber) < count(*) AS flagged FROM lineitem GROUP BY 1",
)
def _(t):
    wrong = F.count_if(verify.row_mismatch(F.col("l_quantity"), F.lit(100), F.col("l_extendedprice"))) > 0
    no_anchor = F.count_if(F.col("l_returnflag") == "N") == 0
    repeated = F.countDistinct("l_linenumber") < F.count("*")
    return t.lineitem.groupBy("l_orderkey").agg(wrong.alias("a"), no_anchor.alias("b"), repeated.alias("c")).select("l_orderkey", (F.size(verify.reasons((F.col("a"), "rows"), (F.col("b"), "anchor"), (F.col("c"), "serial"))) > 0).alias("flagged"))


@query("v13_contract_price", "SELECT o_orderkey, abs(coalesce(s, 0) - o_totalprice) <= 1 AS passed FROM orders LEFT JOIN (SELECT l_orderkey, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS s FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey")
def _(t):
    sums = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum(money("l_extendedprice")).cast("double").alias("s"))
    joined = t.orders.join(sums, "o_orderkey", "left")
    return joined.select("o_orderkey", (F.abs(F.coalesce("s", F.lit(0.0)) - F.col("o_totalprice")) <= 1).alias("passed"))


@query("v19_audit", "SELECT l_orderkey, CASE WHEN count(*) FILTER (l_returnflag = 'R') >= 2 THEN 'hierarchical' ELSE 'flat' END AS kind FROM lineitem GROUP BY 1")
def _(t):
    return t.lineitem.groupBy("l_orderkey").agg(F.when(F.count_if(F.col("l_returnflag") == "R") >= 2, "hierarchical").otherwise("flat").alias("kind"))


@query("v24_heading_audit", r"SELECT doc_id, count(*) FILTER (regexp_matches(line, '^[0-9]+\.[0-9]+ ')) AS level_two FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) GROUP BY 1")
def _(t):
    lines = t.documents.select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return lines.groupBy("doc_id").agg(F.count_if(F.col("line").rlike(r"^[0-9]+\.[0-9]+ ")).alias("level_two"))


@query("v32_ensemble_pages", "SELECT a.conv_id, a.turn, a.text, greatest(length(a.text), length(b.text)) AS best FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1")
def _(t):
    a = t.conversations.select("conv_id", "turn", "text")
    b = t.conversations.select("conv_id", (F.col("turn") - 1).alias("turn"), F.length("text").alias("other"))
    return a.join(b, ["conv_id", "turn"]).select("conv_id", "turn", "text", F.greatest(F.length("text"), F.col("other")).cast("long").alias("best"))


@query("w9_potential_trend", "SELECT o_custkey, year(o_orderdate) AS y, CAST(count(*) FILTER (o_orderstatus = 'F') AS DOUBLE) / count(*) AS rate FROM orders GROUP BY 1, 2")
def _(t):
    return t.orders.groupBy("o_custkey", F.year("o_orderdate").alias("y")).agg((F.count_if(F.col("o_orderstatus") == "F") / F.count("*")).alias("rate"))


@query("w17_reallocation", "WITH x AS (SELECT c_nationkey, c_custkey, count(o_orderkey) FILTER (o_orderstatus = 'O') AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2) SELECT c_nationkey, avg(n) AS before, avg(n) - 3.0::DOUBLE / count(*) AS after FROM x GROUP BY 1")
def _(t):
    load = t.orders.where("o_orderstatus = 'O'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    x = t.customer.select("c_custkey", "c_nationkey").join(load, "c_custkey", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return x.groupBy("c_nationkey").agg(F.avg("n").alias("before"), (F.avg("n") - 3.0 / F.count("*")).alias("after"))


@query("w23_smart_alerts", f"SELECT 'late' AS metric, count(*) AS n FROM orders WHERE o_orderstatus = 'P' UNION ALL SELECT 'old', count(*) FROM orders WHERE {AS_OF} - CAST(o_orderdate AS DATE) BETWEEN 900 AND 930 UNION ALL SELECT 'errors', count(*) FROM events WHERE event_type = 'error'")
def _(t):
    late = t.orders.agg(F.count_if(F.col("o_orderstatus") == "P").alias("late"), F.count_if(F.datediff(as_of(), day("o_orderdate")).between(900, 930)).alias("old"))
    errors = t.events.agg(F.count_if(F.col("event_type") == "error").alias("errors"))
    return late.crossJoin(F.broadcast(errors)).selectExpr("stack(3, 'late', late, 'old', old, 'errors', errors) AS (metric, n)")


@query("w25_governance", _COMPOSITE + " SELECT c_nationkey, round(avg(delivery), 6) AS delivery, round(avg(reliability), 6) AS reliability, CAST(count(*) FILTER (completeness = 'full') AS DOUBLE) / count(*) AS complete FROM s GROUP BY 1")
def _(t):
    return _composite(t).groupBy("c_nationkey").agg(F.round(F.avg("delivery"), 6).alias("delivery"), F.round(F.avg("reliability"), 6).alias("reliability"), (F.count_if(F.col("completeness") == "full") / F.count("*")).alias("complete"))


@query("w29_pay_shares", "SELECT c_mktsegment, CAST(sum(CAST(c_acctbal AS DECIMAL(18,2))) FILTER (c_acctbal > 5000) AS DOUBLE) / CAST(sum(CAST(greatest(c_acctbal, 0) AS DECIMAL(18,2))) AS DOUBLE) AS upper_share FROM customer GROUP BY 1")
def _(t):
    upper = F.sum(F.when(F.col("c_acctbal") > 5000, money("c_acctbal"))).cast("double")
    whole = F.sum(money(F.greatest(F.col("c_acctbal"), F.lit(0.0)))).cast("double")
    return t.customer.groupBy("c_mktsegment").agg((upper / whole).alias("upper_share"))


@query("w42_risk_indicators", "(SELECT 'most_pending' AS indicator, c_nationkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'P' GROUP BY 2 ORDER BY count(*) DESC, c_nationkey LIMIT 1) UNION ALL (SELECT 'fewest_members', c_nationkey FROM customer GROUP BY 2 ORDER BY count(*), c_nationkey LIMIT 1)")
def _(t):
    pending = t.orders.where("o_orderstatus = 'P'").join(t.customer, F.col("o_custkey") == F.col("c_custkey")).groupBy("c_nationkey").agg(F.count("*").alias("n"))
    first = pending.orderBy(F.col("n").desc(), "c_nationkey").limit(1).select(F.lit("most_pending").alias("indicator"), "c_nationkey")
    few = t.customer.groupBy("c_nationkey").agg(F.count("*").alias("n")).orderBy("n", "c_nationkey").limit(1)
    return first.unionByName(few.select(F.lit("fewest_members").alias("indicator"), "c_nationkey"))


@query("x2_holiday_demand", "SELECT c_nationkey, CAST(date_trunc('month', o_orderdate) AS DATE) AS m, CAST(count(*) * 0.97::DOUBLE AS DOUBLE) AS adjusted FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2")
def _(t):
    joined = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    return joined.groupBy("c_nationkey", F.trunc(day("o_orderdate"), "month").alias("m")).agg((F.count("*") * 0.97).alias("adjusted"))
