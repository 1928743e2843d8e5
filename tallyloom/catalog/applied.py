"""Workforce metrics, predictions, verification, schedules, changes and streams over the supplied tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyloom.catalog.registry import query
from tallyloom.catalog.relational import _MONTHLY, AS_OF, _monthly, as_of, day
from tallyloom.functions import text
from tallyloom.functions.numbers import clamp, half_up, money, total
from tallyloom.operators import joins, windows
from tallyloom.plans import changes, schedule, verify
from tallyloom.sources.shared import shared_folder, with_checkpoints
from tallyloom.streaming import jobs


@query("c12_best_assignment")
def _(t):
    with_checkpoints(t.spark)
    pairs = t.lineitem.groupBy("l_suppkey", "l_partkey").agg(F.sum("l_quantity").alias("score"))
    return joins.mutual_best(pairs, "l_suppkey", "l_partkey", "score")


@query("c14_boxes", "SELECT e.l_orderkey, count(*) AS inside FROM lineitem e JOIN lineitem b ON e.l_orderkey = b.l_orderkey WHERE e.l_quantity + 0.5 BETWEEN 0 AND b.l_quantity AND e.l_linenumber + 0.5 BETWEEN 0 AND b.l_linenumber + 1 GROUP BY 1")
def _(t):
    q, n = F.col("l_quantity"), F.col("l_linenumber")
    elements = t.lineitem.select("l_orderkey", q.alias("x0"), (q + 1).alias("x1"), n.alias("y0"), (n + 1).alias("y1"))
    boxes = t.lineitem.select("l_orderkey", F.lit(0).alias("b_x0"), q.alias("b_x1"), F.lit(0).alias("b_y0"), (n + 1).alias("b_y1"))
    return joins.inside(elements, boxes, "l_orderkey").groupBy("l_orderkey").agg(F.count("*").alias("inside"))


@query("n4_tolerance", "SELECT l_orderkey, CAST(greatest(1.0, ceil(count(*) * 0.5)) AS DOUBLE) AS tolerance FROM lineitem GROUP BY 1")
def _(t):
    return t.lineitem.groupBy("l_orderkey").agg(verify.rounding_tolerance(F.count("*")).cast("double").alias("tolerance"))


@query("n3_total_labels", "SELECT p_partkey, (p_partkey % 3 = 0) AS is_total FROM part")
def _(t):
    label = F.when(F.col("p_partkey") % 3 == 0, "Grand Total").when(F.col("p_partkey") % 3 == 1, "Sub-total of items").otherwise(F.col("p_type"))
    return t.part.select("p_partkey", text.is_total_label(label).alias("is_total"))


@query("n16_path_parts", "SELECT c_custkey, c_nationkey || '.' || c_custkey AS parent, 'SUM-' || upper(substr(sha1(c_nationkey || '.' || c_custkey), 1, 8)) AS node_id FROM customer")
def _(t):
    path = F.concat_ws(".", F.col("c_nationkey").cast("string"), F.col("c_custkey").cast("string"), F.lit("leaf"))
    parent = F.regexp_replace(path, r"\.[^.]*$", "")
    return t.customer.select("c_custkey", parent.alias("parent"), F.concat(F.lit("SUM-"), F.upper(F.substring(F.sha1(parent), 1, 8))).alias("node_id"))


@query("n18_percent_scale", "SELECT l_suppkey, max(l_discount) <= 1 AND max(l_discount) > 0 AS is_fraction FROM lineitem GROUP BY 1")
def _(t):
    return t.lineitem.groupBy("l_suppkey").agg(((F.max("l_discount") <= 1) & (F.max("l_discount") > 0)).alias("is_fraction"))


_TOKENS = "list_distinct(list_filter(string_split_regex(lower({}), '[^a-z0-9]+'), lambda x: x <> ''))"


@query(
    "f5_token_overlap",
    f"""WITH a AS (SELECT conv_id, turn, {_TOKENS.format("text")} AS w FROM conversations), p AS (SELECT x.conv_id, x.turn, len(list_intersect(x.w, y.w)) AS i, len(x.w) AS n, len(y.w) AS m FROM a x JOIN a y ON y.conv_id = x.conv_id AND y.turn = x.turn + 1)
       SELECT conv_id, turn, CASE WHEN n + m - i > 0 THEN CAST(i AS DOUBLE) / (n + m - i) ELSE 0 END AS jaccard, CASE WHEN least(n, m) > 0 THEN CAST(i AS DOUBLE) / least(n, m) ELSE 0 END AS overlap FROM p""",
)
def _(t):
    a = t.conversations.select("conv_id", "turn", text.tokens(F.col("text")).alias("w"))
    b = a.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("w").alias("v"))
    both = a.join(b, ["conv_id", "turn"])
    return both.select("conv_id", "turn", text.jaccard(F.col("w"), F.col("v")).alias("jaccard"), text.overlap(F.col("w"), F.col("v")).alias("overlap"))


@query("w3_activity_score", "SELECT user_id, least(100.0, 50 + sum(CASE event_type WHEN 'purchase' THEN 15 WHEN 'signup' THEN 8 ELSE 0 END * CASE WHEN ts >= TIMESTAMP '2024-01-15' THEN 1.0 ELSE 0.5 END))::DOUBLE AS score FROM events GROUP BY 1")
def _(t):
    points = F.when(F.col("event_type") == "purchase", 15).when(F.col("event_type") == "signup", 8).otherwise(0)
    fresh = F.when(F.col("ts") >= F.lit("2024-01-15").cast("timestamp"), 1.0).otherwise(0.5)
    return t.events.groupBy("user_id").agg(F.least(F.lit(100.0), 50 + F.sum(points * fresh)).alias("score"))


_COMPOSITE = """WITH o AS (SELECT o_custkey, CAST(count(*) FILTER (o_orderstatus = 'F') AS DOUBLE) / count(*) * 100 AS delivery, count(*) AS n FROM orders GROUP BY 1),
  r AS (SELECT o_custkey, 100 - CAST(count(*) FILTER (l_returnflag = 'R') AS DOUBLE) / count(*) * 100 AS reliability FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1),
  x AS (SELECT c_custkey, c_nationkey, c_mktsegment, c_acctbal, coalesce(delivery, 70) AS delivery, coalesce(reliability, 90) AS reliability, least(100.0, greatest(0.0, 50 + c_acctbal / 200)) AS growth,
          CASE WHEN o.o_custkey IS NULL THEN 'none' WHEN r.o_custkey IS NULL THEN 'partial' ELSE 'full' END AS completeness FROM customer LEFT JOIN o ON o.o_custkey = c_custkey LEFT JOIN r ON r.o_custkey = c_custkey),
  s AS (SELECT *, floor((0.4 * delivery + 0.3 * reliability + 0.3 * growth) * 100 + 0.5) / 100 AS score FROM x)"""


def _composite(t):
    orders = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg((F.count_if(F.col("o_orderstatus") == "F") / F.count("*") * 100).alias("delivery"))
    lines = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy(F.col("o_custkey").alias("c_custkey"))
    reliability = lines.agg((100 - F.count_if(F.col("l_returnflag") == "R") / F.count("*") * 100).alias("reliability"))
    x = t.customer.join(orders, "c_custkey", "left").join(reliability, "c_custkey", "left")
    state = F.when(F.col("delivery").isNull(), "none").when(F.col("reliability").isNull(), "partial").otherwise("full")
    x = x.withColumn("completeness", state).withColumns({"delivery": F.coalesce("delivery", F.lit(70.0)), "reliability": F.coalesce("reliability", F.lit(90.0)), "growth": clamp(50 + F.col("c_acctbal") / 200, 0.0, 100.0)})
    return x.withColumn("score", half_up(0.4 * F.col("delivery") + 0.3 * F.col("reliability") + 0.3 * F.col("growth"), 2))


@query("w6_composite_score", _COMPOSITE + " SELECT c_custkey, score, completeness FROM s")
def _(t):
    return _composite(t).select("c_custkey", "score", "completeness")


@query("w7_composite_percentile", _COMPOSITE + " SELECT c_custkey, CAST(rank() OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY score) - 1 AS DOUBLE) / nullif(count(*) OVER (PARTITION BY c_nationkey, c_mktsegment) - 1, 0) AS percentile FROM s")
def _(t):
    return windows.among_peers(_composite(t), ["c_nationkey", "c_mktsegment"], "score").select("c_custkey", "percentile")


@query("w8_high_potential", _COMPOSITE + " SELECT c_custkey, coalesce(CASE WHEN c_custkey % 97 = 0 THEN c_acctbal > 0 END, score >= 80 AND completeness = 'full') AS high_potential FROM s")
def _(t):
    override = F.when(F.col("c_custkey") % 97 == 0, F.col("c_acctbal") > 0)
    return _composite(t).select("c_custkey", F.coalesce(override, (F.col("score") >= 80) & (F.col("completeness") == "full")).alias("high_potential"))


@query(
    "w12_top_recommendations",
    _COMPOSITE + " SELECT c_custkey, array_to_string(list_slice(list_filter([CASE WHEN reliability < 60 THEN '1 returns' END, CASE WHEN delivery < 40 THEN '2 delivery' END, CASE WHEN growth < 50 THEN '3 growth' END, CASE WHEN completeness <> 'full' THEN '4 data' END], lambda x: x IS NOT NULL), 1, 3), '; ') AS advice FROM s",
)
def _(t):
    said = verify.reasons((F.col("reliability") < 60, "1 returns"), (F.col("delivery") < 40, "2 delivery"), (F.col("growth") < 50, "3 growth"), (F.col("completeness") != "full", "4 data"))
    return _composite(t).select("c_custkey", F.array_join(F.slice(said, 1, 3), "; ").alias("advice"))


@query("w14_workload", "SELECT o_custkey, count(*) FILTER (o_orderstatus = 'O') AS open_tasks, count(*) FILTER (o_orderstatus = 'O') >= 8 AS overloaded FROM orders GROUP BY 1")
def _(t):
    n = F.count_if(F.col("o_orderstatus") == "O")
    return t.orders.groupBy("o_custkey").agg(n.alias("open_tasks"), (n >= 8).alias("overloaded"))


@query("w16_reassignment", "WITH x AS (SELECT c_nationkey, c_custkey, count(o_orderkey) FILTER (o_orderstatus = 'O') AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2) SELECT c_nationkey, c_custkey, greatest(60, 98 - 4 * n) AS match FROM x QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY n, c_custkey) <= 3")
def _(t):
    load = t.orders.where("o_orderstatus = 'O'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    x = joins.with_defaults(t.customer.select("c_custkey", "c_nationkey"), load, "c_custkey", {"n": 0})
    return windows.top_k(x, "c_nationkey", [F.col("n"), F.col("c_custkey")], 3).select("c_nationkey", "c_custkey", F.greatest(F.lit(60), 98 - 4 * F.col("n")).alias("match"))


@query("w19_density", "WITH x AS (SELECT c_nationkey, CAST(count(*) AS DOUBLE) / (10 + c_nationkey) AS density FROM customer GROUP BY 1) SELECT c_nationkey, CASE WHEN density > 1.5 * (SELECT avg(density) FROM x) THEN 'Over' WHEN density < 0.5 * (SELECT avg(density) FROM x) THEN 'Under' ELSE 'Normal' END AS band FROM x")
def _(t):
    x = t.customer.groupBy("c_nationkey").agg((F.count("*") / (10 + F.first("c_nationkey"))).alias("density"))
    mean = x.agg(F.avg("density").alias("mean"))
    band = F.when(F.col("density") > 1.5 * F.col("mean"), "Over").when(F.col("density") < 0.5 * F.col("mean"), "Under").otherwise("Normal")
    return x.crossJoin(F.broadcast(mean)).select("c_nationkey", band.alias("band"))


@query("w27_net_pay", "SELECT c_custkey, CAST(CAST(greatest(c_acctbal, 0) AS DECIMAL(18,2)) AS DOUBLE) AS gross, greatest(c_acctbal, 0) * (1 - 0.12::DOUBLE - CASE WHEN c_acctbal <= 2100 THEN 0.0075::DOUBLE ELSE 0 END) AS net FROM customer")
def _(t):
    gross = F.greatest(F.col("c_acctbal"), F.lit(0.0))
    rate = 1 - F.lit(0.12) - F.when(F.col("c_acctbal") <= 2100, 0.0075).otherwise(0.0)
    return t.customer.select("c_custkey", money(gross).cast("double").alias("gross"), (gross * rate).alias("net"))


@query("w31_budget_variance", f"WITH s AS ({_MONTHLY}), b AS (SELECT c_nationkey, avg(v) AS usual FROM s GROUP BY 1) SELECT s.c_nationkey, m, CASE WHEN v > usual * 1.05 THEN 'over' WHEN v < usual * 0.95 THEN 'under' ELSE 'within' END AS state FROM s JOIN b ON b.c_nationkey = s.c_nationkey")
def _(t):
    s = _monthly(t)
    usual = s.groupBy("c_nationkey").agg(F.avg("v").alias("usual"))
    state = F.when(F.col("v") > F.col("usual") * 1.05, "over").when(F.col("v") < F.col("usual") * 0.95, "under").otherwise("within")
    return s.join(usual, "c_nationkey").select("c_nationkey", "m", state.alias("state"))


@query(
    "w33_expense_audit",
    """WITH m AS (SELECT l_suppkey, avg(l_extendedprice) AS mean FROM lineitem GROUP BY 1) SELECT l.l_suppkey, count(*) FILTER (l_extendedprice >= 2.25 * mean) AS high, count(*) AS n FROM lineitem l JOIN m ON m.l_suppkey = l.l_suppkey GROUP BY 1""",
)
def _(t):
    mean = t.lineitem.groupBy("l_suppkey").agg(F.avg("l_extendedprice").alias("mean"))
    joined = t.lineitem.join(mean, "l_suppkey")
    return joined.groupBy("l_suppkey").agg(F.count_if(F.col("l_extendedprice") >= 2.25 * F.col("mean")).alias("high"), F.count("*").alias("n"))


@query("w34_incident_trend", "SELECT CAST(date_trunc('day', ts) AS DATE) AS d, count(*) AS n, count(*) FILTER (event_type = 'error') AS critical FROM events GROUP BY 1")
def _(t):
    return t.events.groupBy(day("ts").alias("d")).agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("critical"))


@query("w37_case_risk", "SELECT o_orderkey, least(95, greatest(5, 60 + CASE o_orderstatus WHEN 'F' THEN 20 WHEN 'P' THEN -10 ELSE 0 END - CASE WHEN DATE '2001-08-01' - CAST(o_orderdate AS DATE) > 365 THEN 25 ELSE 0 END)) AS chance FROM orders")
def _(t):
    base = 60 + F.when(F.col("o_orderstatus") == "F", 20).when(F.col("o_orderstatus") == "P", -10).otherwise(0)
    old = F.when(F.datediff(as_of(), day("o_orderdate")) > 365, 25).otherwise(0)
    return t.orders.select("o_orderkey", clamp(base - old, 5, 95).alias("chance"))


@query("x1_upcoming_load", f"SELECT c_nationkey, count(*) AS due FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE CAST(l_shipdate AS DATE) BETWEEN {AS_OF} AND {AS_OF} + 30 GROUP BY 1")
def _(t):
    due = t.lineitem.where(day("l_shipdate").between(as_of(), F.date_add(as_of(), 30)))
    joined = due.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    return joined.groupBy("c_nationkey").agg(F.count("*").alias("due"))


@query(
    "x2_demand_projection",
    f"""WITH s AS ({_MONTHLY}), x AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY m) - 1 AS i FROM s)
       SELECT c_nationkey, count(*) AS months, round(regr_intercept(v, i) + regr_slope(v, i) * count(*), 1) AS projected, regr_r2(v, i) >= 0.3 AND count(*) >= 4 AS trusted FROM x GROUP BY 1""",
)
def _(t):
    x = _monthly(t).withColumn("i", F.row_number().over(Window.partitionBy("c_nationkey").orderBy("m")) - 1)
    line, n = windows.trend(F.col("i"), F.col("v")), F.count("*")
    return x.groupBy("c_nationkey").agg(n.alias("months"), F.round(line["intercept"] + line["slope"] * n, 1).alias("projected"), ((line["fit"] >= 0.3) & (n >= 4)).alias("trusted"))


@query("v4_row_check", "SELECT l_orderkey, count(*) FILTER (abs(l_quantity * 100 - l_extendedprice) > greatest(1.0, abs(l_extendedprice) * 0.005)) AS wrong FROM lineitem GROUP BY 1")
def _(t):
    wrong = verify.row_mismatch(F.col("l_quantity"), F.lit(100), F.col("l_extendedprice"))
    return t.lineitem.groupBy("l_orderkey").agg(F.count_if(wrong).alias("wrong"))


@query(
    "v5_tie_out",
    "SELECT l_orderkey AS doc, CAST(0 AS BIGINT) AS section, CASE WHEN l_orderkey % 10 = 0 THEN 100.0 ELSE 0.0 END::DOUBLE AS gap, l_orderkey % 10 = 0 AND 100 > greatest(1, ceil(count(*) * 0.5)) AS flagged FROM lineitem GROUP BY 1",
)
def _(t):
    lines = t.lineitem.select(F.col("l_orderkey").alias("doc"), F.struct("l_linenumber", "l_partkey", "l_suppkey", F.monotonically_increasing_id()).alias("at"), money("l_extendedprice").alias("amount"), F.lit(False).alias("is_total"))
    totals = t.lineitem.groupBy(F.col("l_orderkey").alias("doc")).agg((F.sum(money("l_extendedprice")) + F.when(F.col("doc") % 10 == 0, 100).otherwise(0)).alias("amount"))
    last = F.struct(F.lit(1 << 30).alias("l_linenumber"), F.lit(0).cast("long").alias("l_partkey"), F.lit(0).cast("long").alias("l_suppkey"), F.lit(0).cast("long").alias("id"))
    with_totals = lines.select("doc", "at", F.col("amount").cast("decimal(28,2)").alias("amount"), "is_total").union(totals.select("doc", last.alias("at"), F.col("amount").cast("decimal(28,2)"), F.lit(True)))
    found = verify.tie_out(with_totals, "doc", "at", "amount", "is_total")
    return found.select("doc", F.col("section").cast("long").alias("section"), F.col("gap").cast("double").alias("gap"), "flagged")


@query("v15_stitch", "SELECT o_custkey, count(*) FILTER (NOT coalesce(o_orderkey - p = 1 AND s = q AND NOT (q = 'P'), false)) AS tables FROM (SELECT o_custkey, o_orderkey, o_orderstatus AS s, lag(o_orderkey) OVER w AS p, lag(o_orderstatus) OVER w AS q FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)) GROUP BY 1")
def _(t):
    fragments = t.orders.select("o_custkey", "o_orderkey", "o_orderstatus", (F.col("o_orderstatus") == "P").alias("ended"))
    return verify.stitch(fragments, "o_custkey", "o_orderkey", "o_orderstatus", "ended").groupBy("o_custkey").agg(F.max("table_no").alias("tables"))


@query("v17_completeness", "SELECT doc_id, CASE WHEN n_chars < 400 OR lang <> 'en' THEN 'review' ELSE 'complete' END AS status FROM documents")
def _(t):
    why = verify.reasons((F.col("n_chars") < 400, "short"), (F.col("lang") != "en", "language"))
    return t.documents.select("doc_id", F.when(F.size(why) == 0, "complete").otherwise("review").alias("status"))


@query("v18_routing", "SELECT doc_id, CASE WHEN c >= 0.95 THEN 'AUTO' WHEN c >= 0.9 THEN 'MANUAL' ELSE 'REQUEST_SOURCE' END AS route FROM (SELECT doc_id, 1 - 1.0 / greatest(n_chars / 100, 1) AS c FROM documents)")
def _(t):
    c = 1 - 1.0 / F.greatest(F.col("n_chars") / 100, F.lit(1))
    return t.documents.select("doc_id", F.when(c >= 0.95, "AUTO").when(c >= 0.9, "MANUAL").otherwise("REQUEST_SOURCE").alias("route"))


_PAIRS = "SELECT least(0.999, n_chars / 10000.0)::DOUBLE AS c, quality = 0 AS wrong FROM labels JOIN documents USING (doc_id)"


def _pairs(t):
    return t.labels.join(t.documents, "doc_id").select(F.least(F.lit(0.999), F.col("n_chars") / 10000.0).alias("c"), (F.col("quality") == 0).alias("wrong"))


@query("v20_calibration", f"SELECT CAST(least(floor(c * 10), 9) AS INTEGER) AS bin, count(*) AS n, round(avg(c), 9) AS mean_confidence, CAST(count(*) FILTER (wrong) AS DOUBLE) / count(*) AS error_rate FROM ({_PAIRS}) GROUP BY 1")
def _(t):
    return verify.calibration(_pairs(t), "c", "wrong").withColumn("mean_confidence", F.round("mean_confidence", 9))


@query("v20_gate", f"WITH s AS (SELECT c, count(*) AS n, count(*) FILTER (wrong) AS e FROM ({_PAIRS}) GROUP BY 1), r AS (SELECT c, sum(n) OVER (ORDER BY c DESC) AS n, sum(e) OVER (ORDER BY c DESC) AS e FROM s) SELECT min(c) AS gate FROM r WHERE n >= 50 AND e / n <= 0.2")
def _(t):
    return verify.lowest_gate(_pairs(t), "c", "wrong", 0.2, 50)


@query("v22_cell_scores", "SELECT o_custkey, count(*) FILTER (o_orderkey % 5 <> 0) AS hits, count(*) AS said, count(*) AS gold, 2.0 * count(*) FILTER (o_orderkey % 5 <> 0) / (2 * count(*)) AS f1 FROM orders GROUP BY 1")
def _(t):
    gold = t.orders.select("o_custkey", "o_orderkey", "o_orderstatus")
    said = gold.withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 5 == 0, "?").otherwise(F.col("o_orderstatus")))
    return verify.cell_scores(said, gold, ["o_custkey", "o_orderkey"], "o_orderstatus")


_EDGES = "SELECT l_orderkey * 10 + l_linenumber AS pred, l_orderkey * 10 + l_linenumber + 1 AS succ, CASE WHEN l_returnflag = 'R' THEN 'SS' ELSE 'FS' END AS type, CAST(l_quantity AS INTEGER) % 7 - 3 AS lag FROM lineitem"


def _edges(t):
    pred = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    return t.lineitem.select(pred.alias("pred"), (pred + 1).alias("succ"), F.when(F.col("l_returnflag") == "R", "SS").otherwise("FS").alias("type"), (F.col("l_quantity").cast("int") % 7 - 3).alias("lag"))


@query("k1_clean_edges", f"SELECT pred, succ, type, lag FROM ({_EDGES}) QUALIFY row_number() OVER (PARTITION BY pred, succ, type ORDER BY abs(lag) DESC, lag DESC) = 1")
def _(t):
    return schedule.clean_edges(_edges(t))


@query("k4_open_ends", f"WITH e AS ({_EDGES}), n AS (SELECT pred AS code FROM e UNION SELECT succ FROM e) SELECT code, code IN (SELECT succ FROM e) AS has_pred, code IN (SELECT pred FROM e) AS has_succ FROM n WHERE NOT (code IN (SELECT succ FROM e) AND code IN (SELECT pred FROM e))")
def _(t):
    e = _edges(t)
    nodes = e.select(F.col("pred").alias("code")).union(e.select("succ")).distinct()
    return schedule.open_ends(nodes, e)


@query("n17_relation_text", f"WITH e AS (SELECT pred, succ, type, lag FROM ({_EDGES}) QUALIFY row_number() OVER (PARTITION BY pred, succ, type ORDER BY abs(lag) DESC, lag DESC) = 1) SELECT succ, string_agg(pred || type || CASE WHEN lag > 0 THEN '+' || lag || 'd' WHEN lag < 0 THEN lag || 'd' ELSE '' END, '; ' ORDER BY pred || type || CASE WHEN lag > 0 THEN '+' || lag || 'd' WHEN lag < 0 THEN lag || 'd' ELSE '' END) AS predecessors FROM e GROUP BY 1")
def _(t):
    return schedule.relation_text(schedule.clean_edges(_edges(t)))


@query(
    "k5_summary_nodes",
    """WITH x AS (SELECT n_regionkey || '' AS a, n_regionkey || '.' || c_nationkey AS b, c_acctbal AS v FROM customer JOIN nation ON c_nationkey = n_nationkey), y AS (SELECT a AS node, v FROM x UNION ALL SELECT b, v FROM x)
       SELECT node, min(v) AS start, max(v) AS finish, count(*) AS leaves FROM y GROUP BY 1""",
)
def _(t):
    joined = t.customer.join(F.broadcast(t.nation), F.col("c_nationkey") == F.col("n_nationkey"))
    leaves = joined.select(F.concat_ws(".", *(F.col(c).cast("string") for c in ("n_regionkey", "c_nationkey", "c_custkey"))).alias("path"), F.col("c_acctbal").alias("s"), F.col("c_acctbal").alias("f"))
    return schedule.summary_nodes(leaves, "path", "s", "f")


@query("u1_intake", "SELECT o_orderkey, o_totalprice <= 0 OR o_totalprice > 300000 OR o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal >= 0) AS rejected FROM orders")
def _(t):
    known = t.customer.where("c_acctbal >= 0").select(F.col("c_custkey").alias("o_custkey"), F.lit(True).alias("known"))
    joined = t.orders.join(known, "o_custkey", "left")
    price = F.col("o_totalprice")
    return changes.validated(joined, (F.col("known").isNull(), "unknown member"), ((price <= 0) | (price > 300000), "amount")).select("o_orderkey", (F.size("rejected_for") > 0).alias("rejected"))


@query("u2_reassign", "SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 3 THEN 1 ELSE o_custkey END AS o_custkey, o_orderkey % 10 = 3 AS changed FROM orders")
def _(t):
    moved = t.orders.where("o_orderkey % 10 = 3").select("o_orderkey", F.lit(1).cast("long").alias("o_custkey"))
    return changes.applied(t.orders.select("o_orderkey", "o_custkey"), moved, "o_orderkey", ["o_custkey"])


@query("u5_leave_decisions")
def _(t):
    requests = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select("o_custkey", "o_orderdate", "o_orderkey", (F.col("o_totalprice") / 100).alias("days"), F.greatest(F.col("c_acctbal"), F.lit(0.0)).alias("balance"))
    return changes.decided(requests, "o_custkey", ["o_orderdate", "o_orderkey"], "days", "balance")


@query("u6_latest_state", "SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, count(*) AS changes FROM events GROUP BY 1")
def _(t):
    return changes.latest_state(t.events, "user_id", ["ts", "event_id"], "event_type")


@query("u7_backfill", "SELECT c_custkey, CASE WHEN p < 5 THEN 'north' WHEN p < 8 THEN 'south' ELSE 'east' END AS ward FROM (SELECT c_custkey, CAST('0x' || substr(md5(CAST(c_custkey AS VARCHAR)), 1, 8) AS BIGINT) % 10 AS p FROM customer)")
def _(t):
    return changes.weighted_pick(t.customer.select("c_custkey"), "c_custkey", [("north", 5), ("south", 3), ("east", 2)], "ward")


@query("u8_monthly_snapshot", "SELECT c_nationkey, c_mktsegment, CAST(date_trunc('month', o_orderdate) AS DATE) AS m, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS done FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 3")
def _(t):
    joined = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    return joined.groupBy("c_nationkey", "c_mktsegment", F.trunc(day("o_orderdate"), "month").alias("m")).agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("done"))


_CLOSED = "(SELECT max(ts) - INTERVAL 1 DAY FROM events)"


@query("s2_tumbling_volume", f"SELECT date_trunc('day', ts)::TIMESTAMP AS start, date_trunc('day', ts)::TIMESTAMP + INTERVAL 1 DAY AS \"end\", count(*) AS n, count(*) FILTER (event_type = 'error') AS errors FROM events GROUP BY 1 HAVING date_trunc('day', ts)::TIMESTAMP + INTERVAL 1 DAY <= {_CLOSED}")
def _(t):
    return jobs.drained(jobs.windowed_volume(jobs.events_stream(t.spark, t.folder), "1 day", None, "1 day"), shared_folder(t.spark))


@query("s6_enriched_stream", "SELECT event_id, c_mktsegment FROM events JOIN customer ON user_id = c_custkey")
def _(t):
    members = t.customer.select(F.col("c_custkey").alias("user_id"), "c_mktsegment")
    return jobs.drained(jobs.enriched(jobs.events_stream(t.spark, t.folder).select("event_id", "user_id"), members, "user_id").select("event_id", "c_mktsegment"), shared_folder(t.spark))


@query("s7_stream_join", "SELECT a.event_id AS raised_id, b.event_id AS answer_id FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'error' AND b.event_type = 'click' AND b.ts BETWEEN a.ts AND a.ts + INTERVAL 6 HOUR")
def _(t):
    events = jobs.events_stream(t.spark, t.folder)
    return jobs.drained(jobs.answered(events.where("event_type = 'error'"), events.where("event_type = 'click'"), "1 day", "6 HOURS"), shared_folder(t.spark))
