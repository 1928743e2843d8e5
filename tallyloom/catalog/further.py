"""Further verification rules, predictions, metrics and change jobs over the supplied tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyloom.catalog.applied import _COMPOSITE, _composite
from tallyloom.catalog.registry import query
from tallyloom.catalog.relational import _MONTHLY, _SPANS, AS_OF, _monthly, _spans, as_of, day
from tallyloom.functions import text
from tallyloom.functions.numbers import clamp, money
from tallyloom.operators import joins, windows
from tallyloom.plans import changes, schedule, verify
from tallyloom.sources.shared import shared_folder
from tallyloom.streaming import jobs, state

_ROW = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
_ROW_SQL = "l_orderkey, l_linenumber, l_partkey, l_suppkey"


@query(
    "v2_amount_column",
    "SELECT l_orderkey, CASE WHEN p >= q AND p >= 3 THEN 'price' WHEN q >= 3 THEN 'quantity' ELSE 'none' END AS amount_column FROM (SELECT l_orderkey, count(*) FILTER (l_extendedprice > 30000) AS p, count(*) FILTER (l_quantity > 20) AS q FROM lineitem GROUP BY 1)",
)
def _(t):
    n = t.lineitem.groupBy("l_orderkey").agg(F.count_if(F.col("l_extendedprice") > 30000).alias("p"), F.count_if(F.col("l_quantity") > 20).alias("q"))
    best = F.when((F.col("p") >= F.col("q")) & (F.col("p") >= 3), "price").when(F.col("q") >= 3, "quantity").otherwise("none")
    return n.select("l_orderkey", best.alias("amount_column"))


@query("v7_not_verified", "SELECT l_orderkey, count(*) > 0 AND count(*) FILTER (l_returnflag = 'N') = 0 AS not_verified FROM lineitem GROUP BY 1")
def _(t):
    return t.lineitem.groupBy("l_orderkey").agg(((F.count("*") > 0) & (F.count_if(F.col("l_returnflag") == "N") == 0)).alias("not_verified"))


@query("v8_merged_cells", f"SELECT {_ROW_SQL}, l_linenumber % 2 = 0 AND l_quantity <> l_linenumber AS merged FROM lineitem")
def _(t):
    q = F.col("l_quantity").cast("int").cast("string")
    cell = F.when(F.col("l_linenumber") % 2 == 0, F.concat_ws(" ", q, F.col("l_linenumber").cast("string"))).otherwise(q)
    parts = F.split(cell, " ")
    numbers = F.array_distinct(F.filter(parts, lambda x: x.rlike("^[0-9]+$")))
    share = F.size(F.filter(parts, lambda x: x.rlike("^[0-9]+$"))) / F.size(parts)
    return t.lineitem.select(*_ROW, ((F.size(numbers) >= 2) & (share >= 0.6)).alias("merged"))


@query("v11_worth_emitting", "SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(*) >= 2 AND count(DISTINCT l_partkey) >= 2")
def _(t):
    return t.lineitem.groupBy("l_orderkey").agg(F.count("*").alias("n"), F.countDistinct("l_partkey").alias("k")).where("n >= 2 AND k >= 2").select("l_orderkey")


@query("v16_total_terminated", "SELECT l_orderkey, arg_max(l_returnflag, (l_linenumber, l_partkey, l_suppkey, l_quantity)) = 'R' AS ended FROM lineitem GROUP BY 1")
def _(t):
    last = F.max_by("l_returnflag", F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity"))
    ends = t.lineitem.groupBy("l_orderkey").agg(last.alias("flag"))
    return ends.select("l_orderkey", text.is_total_label(F.when(F.col("flag") == "R", "Total").otherwise("item")).alias("ended"))


@query("v21_apply_calibration", "SELECT doc_id, CASE WHEN c <= 0.5 THEN c * 0.8::DOUBLE ELSE 0.4::DOUBLE + (c - 0.5::DOUBLE) * 1.2::DOUBLE END AS calibrated FROM (SELECT doc_id, least(1.0, n_chars / 8000.0)::DOUBLE AS c FROM documents)")
def _(t):
    c = F.least(F.lit(1.0), F.col("n_chars") / 8000.0)
    segments = [(0.0, 0.5, 0.0, 0.8), (0.5, 1.0, 0.4, 1.2)]
    out = None
    for low, high, base, slope in segments:
        value = F.lit(base) + (c - low) * slope if low else c * slope
        out = F.when(c <= high, value) if out is None else out.when(c <= high, value)
    return t.documents.select("doc_id", out.alias("calibrated"))


@query("v25_uncertain_tables", "SELECT doc_id, lang <> 'en' OR regexp_matches(text, '[|]') AS uncertain FROM documents")
def _(t):
    return t.documents.select("doc_id", ((F.col("lang") != "en") | F.col("text").rlike("[|]")).alias("uncertain"))


@query("v27_number_match", f"SELECT {_ROW_SQL}, CASE WHEN l_linenumber % 3 = 0 THEN 1.0 WHEN l_linenumber % 3 = 1 THEN 0.9 ELSE 0.0 END::DOUBLE AS score FROM lineitem")
def _(t):
    gold = (F.col("l_quantity").cast("int") * 100).cast("string")
    said = F.when(F.col("l_linenumber") % 3 == 0, gold).when(F.col("l_linenumber") % 3 == 1, F.replace(gold, F.lit("0"), F.lit("O"))).otherwise("x")
    exact, fixed = said.try_cast("double") == gold.cast("double"), verify.repaired(said) == gold.cast("double")
    score = F.when(F.coalesce(exact, F.lit(False)), 1.0).when(F.coalesce(fixed, F.lit(False)), 0.9).otherwise(0.0)
    return t.lineitem.select(*_ROW, score.alias("score"))


@query("v31_overrides", "SELECT o_orderkey, CASE WHEN o_orderkey % 20 = 7 THEN 0 ELSE o_totalprice END AS o_totalprice, CASE WHEN o_orderkey % 20 = 7 THEN 2 ELSE 1 END AS version FROM orders")
def _(t):
    approved = t.orders.where("o_orderkey % 20 = 7").select("o_orderkey", F.lit(0.0).alias("o_totalprice"))
    done = changes.applied(t.orders.select("o_orderkey", "o_totalprice"), approved, "o_orderkey", ["o_totalprice"])
    return done.select("o_orderkey", "o_totalprice", F.when(F.col("changed"), 2).otherwise(1).alias("version"))


@query("k2_baseline", "SELECT CASE WHEN count(*) FILTER (o_orderstatus = 'F') >= count(*) FILTER (o_orderstatus = 'O') THEN 'b0' ELSE 'b1' END AS baseline, greatest(count(*) FILTER (o_orderstatus = 'F'), count(*) FILTER (o_orderstatus = 'O')) AS filled FROM orders")
def _(t):
    d, s = F.col("o_orderdate"), F.col("o_orderstatus")
    return schedule.chosen_baseline(t.orders.select(F.when(s == "F", d).alias("b0"), F.when(s == "O", d).alias("b1")), ["b0", "b1"])


_ATTENDANCE = "SELECT c_nationkey, CAST(date_trunc('month', o_orderdate) AS DATE) AS m, CAST(count(*) FILTER (o_orderstatus <> 'P') AS DOUBLE) / count(*) * 100 AS v FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2"


@query(
    "x4_attendance_risk",
    f"WITH s AS ({_ATTENDANCE}), x AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY m) - 1 AS i FROM s) SELECT c_nationkey, round(regr_slope(v, i), 6) AS slope, regr_intercept(v, i) + regr_slope(v, i) * count(*) < 85 AS alert FROM x GROUP BY 1",
)
def _(t):
    joined = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    s = joined.groupBy("c_nationkey", F.trunc(day("o_orderdate"), "month").alias("m")).agg((F.count_if(F.col("o_orderstatus") != "P") / F.count("*") * 100).alias("v"))
    x = s.withColumn("i", F.row_number().over(Window.partitionBy("c_nationkey").orderBy("m")) - 1)
    line = windows.trend(F.col("i"), F.col("v"))
    return x.groupBy("c_nationkey").agg(F.round(line["slope"], 6).alias("slope"), (line["intercept"] + line["slope"] * F.count("*") < 85).alias("alert"))


@query(
    "x3_capacity_shortfall",
    f"WITH h AS (SELECT c_nationkey, count(*) AS heads, count(*) FILTER (c_acctbal < 0) AS leaving FROM customer GROUP BY 1), s AS ({_MONTHLY}), u AS (SELECT c_nationkey, avg(v) AS usual, arg_max(v, m) AS latest FROM s GROUP BY 1) SELECT h.c_nationkey, heads - leaving AS capacity, heads >= 15 AND latest > usual * CAST(heads - leaving AS DOUBLE) / heads * 1.1::DOUBLE AS alert FROM h JOIN u ON u.c_nationkey = h.c_nationkey",
)
def _(t):
    heads = t.customer.groupBy("c_nationkey").agg(F.count("*").alias("heads"), F.count_if(F.col("c_acctbal") < 0).alias("leaving"))
    usual = _monthly(t).groupBy("c_nationkey").agg(F.avg("v").alias("usual"), F.max_by("v", "m").alias("latest"))
    left = F.col("heads") - F.col("leaving")
    alert = (F.col("heads") >= 15) & (F.col("latest") > F.col("usual") * left.cast("double") / F.col("heads") * 1.1)
    return heads.join(usual, "c_nationkey").select("c_nationkey", left.alias("capacity"), alert.alias("alert"))


@query("x6_skill_loss", "SELECT p_brand, count(DISTINCT l_suppkey) AS holders, count(DISTINCT l_suppkey) FILTER (s_acctbal < 0) AS leaving, count(DISTINCT l_suppkey) >= 8 AND count(DISTINCT l_suppkey) FILTER (s_acctbal < 0) > 0.2 * count(DISTINCT l_suppkey) AS alert FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1")
def _(t):
    held = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select("p_brand", "l_suppkey").distinct().join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    n, gone = F.count("*"), F.count_if(F.col("s_acctbal") < 0)
    return held.groupBy("p_brand").agg(n.alias("holders"), gone.alias("leaving"), ((n >= 8) & (gone > 0.2 * n)).alias("alert"))


@query("x7_weather_bands", "SELECT d, CASE WHEN v <= 1000 THEN 'dry' WHEN v <= 20000 THEN 'rain' ELSE 'storm' END AS band FROM (SELECT CAST(ts AS DATE) AS d, sum(CAST(value AS DECIMAL(18,2))) AS v FROM events GROUP BY 1)")
def _(t):
    daily = t.events.groupBy(day("ts").alias("d")).agg(F.sum(money("value")).alias("v"))
    return daily.select("d", F.when(F.col("v") <= 1000, "dry").when(F.col("v") <= 20000, "rain").otherwise("storm").alias("band"))


@query("x8_narrative", "SELECT c_nationkey, 'Org ' || c_nationkey || ' has ' || n || CASE WHEN n >= 50 THEN ' members, many.' ELSE ' members.' END AS narrative FROM (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1)")
def _(t):
    n = t.customer.groupBy("c_nationkey").agg(F.count("*").alias("n"))
    return n.select("c_nationkey", F.concat(F.format_string("Org %d has %d", "c_nationkey", "n"), F.when(F.col("n") >= 50, " members, many.").otherwise(" members.")).alias("narrative"))


@query("w5_career_score", f"SELECT o_custkey, CAST(least(100, greatest(20, 50 + count(*) * 3 - CASE WHEN {AS_OF} - max(CAST(o_orderdate AS DATE)) > 365 THEN 20 ELSE 0 END)) AS BIGINT) AS score FROM orders GROUP BY 1")
def _(t):
    overdue = F.when(F.datediff(as_of(), F.max(day("o_orderdate"))) > 365, 20).otherwise(0)
    return t.orders.groupBy("o_custkey").agg(clamp(50 + F.count("*") * 3 - overdue, 20, 100).cast("long").alias("score"))


@query("w13_retention_risk", "WITH x AS (SELECT o_custkey, o_totalprice AS a, lead(o_totalprice) OVER w AS b, row_number() OVER w AS r FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC)) SELECT o_custkey, CASE WHEN a < b * 0.5::DOUBLE THEN 'High' WHEN a < b THEN 'Medium' ELSE 'Low' END AS risk FROM x WHERE r = 1")
def _(t):
    w = Window.partitionBy("o_custkey").orderBy(F.col("o_orderdate").desc(), F.col("o_orderkey").desc())
    x = t.orders.select("o_custkey", F.col("o_totalprice").alias("a"), F.lead("o_totalprice").over(w).alias("b"), F.row_number().over(w).alias("r")).where("r = 1")
    return x.select("o_custkey", F.when(F.col("a") < F.col("b") * 0.5, "High").when(F.col("a") < F.col("b"), "Medium").otherwise("Low").alias("risk"))


@query("w21_completeness", "SELECT c_nationkey, count(*) FILTER (o_orderstatus = 'F') AS done, count(*) AS n, CAST(count(*) FILTER (o_orderstatus = 'F') AS DOUBLE) / count(*) AS share FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1")
def _(t):
    done = F.count_if(F.col("o_orderstatus") == "F")
    joined = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    return joined.groupBy("c_nationkey").agg(done.alias("done"), F.count("*").alias("n"), (done / F.count("*")).alias("share"))


@query("w22_performance_summary", "WITH l AS (SELECT o_custkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1) SELECT c_nationkey, count(*) AS rated, count(*) FILTER (o_totalprice >= 200000) AS high FROM l JOIN customer ON o_custkey = c_custkey GROUP BY 1")
def _(t):
    latest = joins.latest_record(t.orders, "o_custkey", ["o_orderdate", "o_orderkey"], ["o_totalprice"])
    joined = latest.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    return joined.groupBy("c_nationkey").agg(F.count("*").alias("rated"), F.count_if(F.col("o_totalprice") >= 200000).alias("high"))


@query("w26_course_summary", "SELECT p_brand, count(DISTINCT l_suppkey) AS people, CAST(count(*) FILTER (l_linestatus = 'F') AS DOUBLE) / count(*) AS rate FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1")
def _(t):
    joined = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    return joined.groupBy("p_brand").agg(F.countDistinct("l_suppkey").alias("people"), (F.count_if(F.col("l_linestatus") == "F") / F.count("*")).alias("rate"))


@query(
    "w32_payroll_projection",
    f"WITH s AS (SELECT m, CAST(sum(CAST(v AS DECIMAL(28,2))) AS DOUBLE) AS v FROM ({_MONTHLY}) GROUP BY 1), x AS (SELECT *, row_number() OVER (ORDER BY m) - 1 AS i FROM s), r AS (SELECT regr_intercept(v, i) AS a, regr_slope(v, i) AS b, count(*) AS n FROM x) SELECT CAST(k AS INTEGER) AS ahead, round(a + b * (n - 1 + k), 0) AS projected FROM r, generate_series(1, 2) g(k)",
)
def _(t):
    s = _monthly(t).groupBy("m").agg(F.sum(F.col("v").cast("decimal(28,2)")).cast("double").alias("v"))
    # A row for each month: few, whatever the table's size.
    x = s.withColumn("i", F.row_number().over(Window.orderBy("m")) - 1)
    line = windows.trend(F.col("i"), F.col("v"))
    r = x.agg(line["intercept"].alias("a"), line["slope"].alias("b"), F.count("*").alias("n"))
    return r.select("a", "b", "n", F.explode(F.array(F.lit(1), F.lit(2))).alias("ahead")).select("ahead", F.round(F.col("a") + F.col("b") * (F.col("n") - 1 + F.col("ahead")), 0).alias("projected"))


@query("w39_project_progress", "SELECT l_suppkey, count(*) AS tasks, count(*) FILTER (l_linestatus = 'F') AS done, CAST(floor(CAST(count(*) FILTER (l_linestatus = 'F') AS DOUBLE) / count(*) * 100 + 0.5) AS BIGINT) AS progress FROM lineitem GROUP BY 1")
def _(t):
    done = F.count_if(F.col("l_linestatus") == "F")
    return t.lineitem.groupBy("l_suppkey").agg(F.count("*").alias("tasks"), done.alias("done"), F.floor(done / F.count("*") * 100 + 0.5).alias("progress"))


@query("w40_page_snapshot", "SELECT 'orders' AS section, o_orderstatus AS key, CAST(count(*) AS DOUBLE) AS value FROM orders GROUP BY 2 UNION ALL SELECT 'events', event_type, CAST(count(*) AS DOUBLE) FROM events GROUP BY 2")
def _(t):
    def part(df, section, key):
        return df.groupBy(F.lit(section).alias("section"), F.col(key).alias("key")).agg(F.count("*").cast("double").alias("value"))

    return part(t.orders, "orders", "o_orderstatus").unionByName(part(t.events, "events", "event_type"))


@query("w41_org_digest", _COMPOSITE + " SELECT c_nationkey, round(avg(score), 6) AS health FROM s GROUP BY 1 ORDER BY health, c_nationkey LIMIT 3")
def _(t):
    return _composite(t).groupBy("c_nationkey").agg(F.round(F.avg("score"), 6).alias("health")).orderBy("health", "c_nationkey").limit(3)


@query("w44_asset_score", "SELECT l_suppkey, 100 - CAST(count(*) FILTER (l_returnflag = 'R') AS DOUBLE) / count(*) * 100 AS score FROM lineitem GROUP BY 1")
def _(t):
    return t.lineitem.groupBy("l_suppkey").agg((100 - F.count_if(F.col("l_returnflag") == "R") / F.count("*") * 100).alias("score"))


@query("w45_consistency_audit", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' AND o_totalprice < 1000 THEN 'status' WHEN o_totalprice > 300000 THEN 'ceiling' END AS finding FROM orders")
def _(t):
    return t.orders.select("o_orderkey", F.when((F.col("o_orderstatus") == "F") & (F.col("o_totalprice") < 1000), "status").when(F.col("o_totalprice") > 300000, "ceiling").alias("finding"))


@query(
    "u4_leave_validation",
    f"WITH x AS ({_SPANS}), y AS (SELECT a.o_custkey, a.span_id, a.l_partkey, a.l_suppkey, a.s, a.e, count(b.span_id) AS n FROM x a JOIN x b ON a.o_custkey = b.o_custkey AND a.s <= b.e AND b.s <= a.e GROUP BY ALL) SELECT span_id, l_partkey, l_suppkey, s, e, CASE WHEN s < DATE '1996-01-01' THEN 'notice' WHEN e - s + 1 > 6 THEN 'too long' WHEN n > 1 THEN 'conflict' ELSE 'ok' END AS decision FROM y",
)
def _(t):
    x = _spans(t).withColumn("uid", F.struct("span_id", "l_partkey", "l_suppkey", "s", "e"))
    met = joins.overlapping(x, x, ["o_custkey"], "s", "e", ("uid", "uid")).groupBy("a_id").agg(F.count("*").alias("n"))
    s, e = F.col("a_id.s"), F.col("a_id.e")
    decision = F.when(s < F.lit("1996-01-01").cast("date"), "notice").when(F.datediff(e, s) + 1 > 6, "too long").when(F.col("n") > 1, "conflict").otherwise("ok")
    return met.select("a_id.span_id", "a_id.l_partkey", "a_id.l_suppkey", "a_id.s", "a_id.e", decision.alias("decision"))


@query("n5_labelled_fields", r"SELECT doc_id, regexp_extract(text, 'password[ ]*[:=][ ]*([0-9a-z]+)', 1) AS value, CASE WHEN regexp_matches(text, 'password[ ]*[:=]') THEN 0.95 ELSE 0.4 END::DOUBLE AS confidence FROM documents")
def _(t):
    return t.documents.select("doc_id", F.regexp_extract("text", "password[ ]*[:=][ ]*([0-9a-z]+)", 1).alias("value"), F.when(F.col("text").rlike("password[ ]*[:=]"), 0.95).otherwise(0.4).alias("confidence"))


@query("n14_engine_votes", "SELECT a.conv_id, count(*) AS pairs, round(avg(CAST(a.role = b.role AS INTEGER)), 9) AS agreement FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn < b.turn GROUP BY 1")
def _(t):
    a = t.conversations.select("conv_id", F.col("turn").alias("x"), F.col("role").alias("p"))
    b = t.conversations.select("conv_id", F.col("turn").alias("y"), F.col("role").alias("q"))
    # Turns of one conversation stand for the engines of one page: a handful.
    return a.join(b, "conv_id").where("x < y").groupBy("conv_id").agg(F.count("*").alias("pairs"), F.round(F.avg((F.col("p") == F.col("q")).cast("int")), 9).alias("agreement"))


@query("n21_grounded_numbers", "SELECT conv_id, turn, len(list_filter(regexp_extract_all(text, '[0-9]+'), lambda x: len(x) > 3)) = 0 AS grounded FROM conversations")
def _(t):
    claims = F.regexp_extract_all("text", F.lit("[0-9]+"), F.lit(0))
    return t.conversations.select("conv_id", "turn", F.forall(claims, lambda c: F.length(c) <= 3).alias("grounded"))


@query("n23_context_prefix", "SELECT conv_id, turn, regexp_replace(text, '^[A-Z][a-z]* ', '') AS said FROM conversations")
def _(t):
    return t.conversations.select("conv_id", "turn", F.regexp_replace("text", "^[A-Z][a-z]* ", "").alias("said"))


@query("n27_demoted_headings", "SELECT doc_id, line, length(line) > 55 AND length(regexp_replace(line, '[^a-z]', '', 'g')) > length(regexp_replace(line, '[^A-Z]', '', 'g')) AS demoted FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)")
def _(t):
    lines = t.documents.select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    lower, upper = (F.length(F.regexp_replace("line", p, "")) for p in ("[^a-z]", "[^A-Z]"))
    return lines.select("doc_id", "line", ((F.length("line") > 55) & (lower > upper)).alias("demoted"))


@query(
    "e18_breadcrumbs",
    """WITH l AS (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents))
       SELECT doc_id, n, last_value(CASE WHEN length(line) < 60 THEN line END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY n) AS section FROM l""",
)
def _(t):
    lines = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    w = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return lines.select("doc_id", (F.col("pos") + 1).cast("long").alias("n"), F.last(F.when(F.length("line") < 60, F.col("line")), ignorenulls=True).over(w).alias("section"))


@query(
    "s1_escalations",
    """WITH w AS (SELECT max(ts) - INTERVAL 1 DAY AS mark FROM events), l AS (SELECT user_id, max(ts) AS last FROM events GROUP BY 1)
       SELECT e.event_id, e.user_id FROM events e JOIN l ON l.user_id = e.user_id, w WHERE e.event_type = 'error' AND e.ts + INTERVAL 48 HOUR <= greatest(mark, last)
         AND NOT EXISTS (SELECT 1 FROM events c WHERE c.user_id = e.user_id AND c.event_type = 'click' AND c.ts >= e.ts AND c.ts < e.ts + INTERVAL 48 HOUR AND (c.ts > e.ts OR c.event_id > e.event_id))""",
)
def _(t):
    events = jobs.events_stream(t.spark, t.folder)
    return jobs.drained(state.escalations(events, "error", "click", 48, "1 day"), shared_folder(t.spark))


@query("s8_run_log", "SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 30")
def _(t):
    events = jobs.events_stream(t.spark, t.folder).select("user_id", "event_id", "ts")
    return state.logged_with_retention(events, "user_id", ["ts", "event_id"], 30, f"{shared_folder(t.spark)}/log-{uuid.uuid4().hex}").select("user_id", "event_id")


@query("s4_last_messages", "SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 5")
def _(t):
    events = jobs.events_stream(t.spark, t.folder).select("user_id", "event_id", "ts")
    return state.logged_with_retention(events, "user_id", ["ts", "event_id"], 5, f"{shared_folder(t.spark)}/log-{uuid.uuid4().hex}").select("user_id", "event_id")
