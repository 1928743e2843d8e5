"""Further metrics, text rules, predictions and checks over the supplied tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyloom.catalog.applied import _COMPOSITE, _composite
from tallyloom.catalog.registry import query
from tallyloom.catalog.relational import _MONTHLY, _SPANS, AS_OF, _monthly, _spans, as_of, day
from tallyloom.functions import text
from tallyloom.functions.numbers import total
from tallyloom.operators import aggregates, joins, windows
from tallyloom.plans import changes, verify
from tallyloom.sources.shared import in_parts, shared_folder
from tallyloom.streaming import jobs, state


@query("a7_review_queue", "SELECT doc_id, CAST(n_chars AS DOUBLE) / (n_chars + 1000) AS confidence FROM documents WHERE n_chars < 1000")
def _(t):
    c = F.col("n_chars") / (F.col("n_chars") + 1000)
    return t.documents.where("n_chars < 1000").select("doc_id", c.alias("confidence")).orderBy("confidence", "doc_id")


@query(
    "b11_presence_hash",
    """SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN abs(h) % 100 < 85 END AS present FROM (SELECT c_custkey, c_acctbal,
         list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(string_split(c_custkey || '|2001-08-01', ''), lambda c: CAST(ord(c) AS BIGINT))), lambda h, c: (((h * 31 + c + 2147483648) % 4294967296) + 4294967296) % 4294967296 - 2147483648) AS h FROM customer)""",
)
def _(t):
    key = F.concat_ws("|", F.col("c_custkey").cast("string"), F.lit("2001-08-01"))
    wrap = lambda x: F.pmod(x + (1 << 31), F.lit(1 << 32)) - (1 << 31)
    hashed = F.aggregate(F.filter(F.split(key, ""), lambda c: c != ""), F.lit(0).cast("long"), lambda s, c: wrap(s * 31 + F.ascii(c)))
    return t.customer.select("c_custkey", F.when(F.col("c_acctbal") > 0, F.pmod(F.abs(hashed), F.lit(100)) < 85).alias("present"))


@query(
    "c15_single_candidates",
    "WITH m AS (SELECT conv_id, turn, unnest(list_distinct(string_split(lower(text), ' '))) AS w FROM conversations), p AS (SELECT lower(string_split(p_name, ' ')[1]) AS w, p_partkey FROM part) SELECT conv_id, turn, min(p_partkey) AS k FROM m JOIN p ON m.w = p.w GROUP BY 1, 2 HAVING count(*) = 1",
)
def _(t):
    words = t.conversations.select("conv_id", "turn", F.explode(F.array_distinct(F.split(F.lower("text"), " "))).alias("w"))
    names = t.part.groupBy(F.lower(F.split("p_name", " ")[0]).alias("w")).agg(F.count("*").alias("candidates"), F.min("p_partkey").alias("k"))
    found = words.join(names, "w").groupBy("conv_id", "turn").agg(F.sum("candidates").alias("candidates"), F.min("k").alias("k"))
    return found.where("candidates = 1").select("conv_id", "turn", "k")


@query(
    "e5_worst_rise",
    "WITH d AS (SELECT user_id, CAST(ts AS DATE) AS d, CAST(count(*) FILTER (event_type = 'error') AS DOUBLE) / count(*) AS r FROM events GROUP BY 1, 2), x AS (SELECT user_id, d, r - lag(r) OVER (PARTITION BY user_id ORDER BY d) AS rise FROM d) SELECT user_id, max(rise) AS rise FROM x WHERE rise > 0 GROUP BY 1",
)
def _(t):
    daily = t.events.groupBy("user_id", day("ts").alias("d")).agg((F.count_if(F.col("event_type") == "error") / F.count("*")).alias("r"))
    rise = F.col("r") - F.lag("r").over(Window.partitionBy("user_id").orderBy("d"))
    return daily.withColumn("rise", rise).where("rise > 0").groupBy("user_id").agg(F.max("rise").alias("rise"))


@query(
    "e7_best_and_weakest",
    f"WITH s AS (SELECT c_nationkey, sum(CAST(v AS DECIMAL(28,2))) AS v FROM ({_MONTHLY}) GROUP BY 1), x AS (SELECT *, row_number() OVER (ORDER BY v DESC, c_nationkey) AS a, row_number() OVER (ORDER BY v, c_nationkey) AS b FROM s) SELECT c_nationkey, CASE WHEN a <= 2 THEN 'best' ELSE 'weakest' END AS tag FROM x WHERE a <= 2 OR b <= 2",
)
def _(t):
    sums = _monthly(t).groupBy("c_nationkey").agg(F.sum(F.col("v").cast("decimal(28,2)")).alias("v"))
    best = sums.orderBy(F.col("v").desc(), "c_nationkey").limit(2).select("c_nationkey", F.lit("best").alias("tag"))
    weakest = sums.orderBy("v", "c_nationkey").limit(2).select("c_nationkey", F.lit("weakest").alias("tag"))
    return best.unionByName(weakest.join(best, "c_nationkey", "left_anti"))


@query("e14_reading_order", "WITH x AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, sum(CASE WHEN l_quantity > 40 THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey ROWS UNBOUNDED PRECEDING) AS band FROM lineitem) SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY band, l_quantity % 2, l_linenumber, l_partkey, l_suppkey) AS BIGINT) AS n FROM x")
def _(t):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    band = F.sum(F.when(F.col("l_quantity") > 40, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    order = Window.partitionBy("l_orderkey").orderBy("band", F.col("l_quantity") % 2, "l_linenumber", "l_partkey", "l_suppkey")
    return in_parts(t.lineitem, "l_orderkey").withColumn("band", band).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.row_number().over(order).cast("long").alias("n"))


@query("f6_alerts", "(SELECT 'late' AS kind, o_custkey AS id, count(*) AS n FROM orders WHERE o_orderstatus = 'P' GROUP BY 2 ORDER BY n DESC, id LIMIT 5) UNION ALL (SELECT 'overloaded', o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'O' GROUP BY 2 HAVING count(*) >= 8 ORDER BY n DESC, o_custkey LIMIT 3)")
def _(t):
    def counted(status, kind):
        return t.orders.where(F.col("o_orderstatus") == status).groupBy(F.lit(kind).alias("kind"), F.col("o_custkey").alias("id")).agg(F.count("*").alias("n"))

    return counted("P", "late").orderBy(F.col("n").desc(), "id").limit(5).unionByName(counted("O", "overloaded").where("n >= 8").orderBy(F.col("n").desc(), "id").limit(3))


@query("f8_notifications", "WITH f AS ((SELECT 'error' AS kind, event_id AS id FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id DESC LIMIT 3) UNION ALL (SELECT 'order', o_orderkey FROM orders WHERE o_orderstatus = 'P' ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 2)) SELECT * FROM f WHERE id % 5 <> 0")
def _(t):
    errors = t.events.where("event_type = 'error'").orderBy(F.col("ts").desc(), F.col("event_id").desc()).limit(3).select(F.lit("error").alias("kind"), F.col("event_id").alias("id"))
    late = t.orders.where("o_orderstatus = 'P'").orderBy(F.col("o_orderdate").desc(), F.col("o_orderkey").desc()).limit(2).select(F.lit("order").alias("kind"), F.col("o_orderkey").alias("id"))
    feed = errors.unionByName(late)
    return feed.join(feed.where("id % 5 = 0").select("kind", "id"), ["kind", "id"], "left_anti")


@query("g3_calendar_tenure", "SELECT o_orderkey, CAST(2001 - year(o_orderdate) AS INTEGER) AS years FROM orders")
def _(t):
    return t.orders.select("o_orderkey", (F.year(as_of()) - F.year("o_orderdate")).alias("years"))


@query("g8_working_factor", "SELECT strftime(ts, '%Y-%m') AS m, 1 - greatest(0, count(DISTINCT CAST(ts AS DATE)) - 2) * 0.03::DOUBLE AS factor FROM events WHERE event_type = 'signup' GROUP BY 1")
def _(t):
    days = F.countDistinct(day("ts"))
    return t.events.where("event_type = 'signup'").groupBy(F.date_format("ts", "yyyy-MM").alias("m")).agg((1 - F.greatest(F.lit(0), days - 2) * 0.03).alias("factor"))


@query(
    "g9_earliest_free",
    f"WITH x AS ({_SPANS}), c AS (SELECT DISTINCT o_custkey FROM x), d AS (SELECT o_custkey, {AS_OF} + CAST(i AS INTEGER) AS s FROM c, generate_series(0, 179) g(i)) SELECT o_custkey, min(s) AS free_from FROM d WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.o_custkey = d.o_custkey AND x.s <= d.s + 4 AND d.s <= x.e) GROUP BY 1",
)
def _(t):
    x = _spans(t)
    days = x.select("o_custkey").distinct().select("o_custkey", F.explode(F.sequence(F.lit(0), F.lit(179))).alias("i")).select("o_custkey", F.date_add(as_of(), F.col("i")).alias("s"))
    # A start is taken if an interval covers any of the five days from it on.
    taken = x.where(F.col("e") >= as_of()).select("o_custkey", F.explode(F.sequence(F.date_sub("s", 4), F.col("e"))).alias("s")).distinct()
    return days.join(taken, ["o_custkey", "s"], "left_anti").groupBy("o_custkey").agg(F.min("s").alias("free_from"))


@query("n2_amount_cells", "SELECT p_partkey, p_partkey % 2 = 0 AS is_amount FROM part")
def _(t):
    cell = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("Rs. "), F.col("p_retailprice").cast("decimal(18,2)").cast("string"))).otherwise(F.col("p_name"))
    return t.part.select("p_partkey", text.is_amount(cell).alias("is_amount"))


@query("n8_document_class", "SELECT page_id, CASE WHEN contains(url, '/en/') THEN 'english' WHEN contains(url, '/de/') THEN 'german' WHEN contains(url, '?') THEN 'query' ELSE 'other' END AS class FROM pages")
def _(t):
    u = F.lower("url")
    return t.pages.select("page_id", F.when(u.contains("/en/"), "english").when(u.contains("/de/"), "german").when(u.contains("?"), "query").otherwise("other").alias("class"))


@query("n10_table_like", "WITH w AS (SELECT doc_id, list_filter(string_split(text, ' '), lambda x: x <> '') AS w FROM documents) SELECT doc_id, len(w) >= 8 AND len(list_filter(w, lambda x: regexp_matches(x, '[0-9|]'))) >= 0.3 * len(w) AS table_like FROM w")
def _(t):
    words = t.documents.select("doc_id", F.filter(F.split("text", " "), lambda w: w != "").alias("w"))
    numeric = F.size(F.filter("w", lambda w: w.rlike("[0-9|]")))
    return words.select("doc_id", ((F.size("w") >= 8) & (numeric >= 0.3 * F.size("w"))).alias("table_like"))


@query(
    "n11_plain_text",
    r"""SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '<[^>]*>', ' ', 'g'),
         '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&nbsp;', ' '), '&amp;', '&'), '[\x00-\x20]+', ' ', 'g')) AS plain FROM pages""",
)
def _(t):
    return t.pages.select("page_id", text.plain_text(F.col("html")).alias("plain"))


@query("n20_intents", "SELECT conv_id, turn, CASE WHEN contains(lower(text), 'the') AND contains(lower(text), 'and') THEN 'both' WHEN contains(lower(text), 'the') THEN 'first' WHEN contains(lower(text), 'de') THEN 'second' ELSE 'none' END AS intent FROM conversations WHERE role = 'user'")
def _(t):
    said = F.lower("text")
    rules = [("both", ["the", "and"]), ("first", ["the"]), ("second", ["de"])]
    intent = F.lit("none")
    for name, needed in reversed(rules):
        holds = F.lit(True)
        for word in needed:
            holds &= said.contains(word)
        intent = F.when(holds, name).otherwise(intent)
    return t.conversations.where("role = 'user'").select("conv_id", "turn", intent.alias("intent"))


@query("n24_line_classes", r"WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) SELECT doc_id, count(*) FILTER (regexp_matches(line, '^[0-9]+(\.[0-9]+)* ')) AS headings, count(*) FILTER (regexp_matches(line, '^[-*] ')) AS items, count(*) AS lines FROM l GROUP BY 1")
def _(t):
    lines = t.documents.select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    heading, item = F.col("line").rlike(r"^[0-9]+(\.[0-9]+)* "), F.col("line").rlike("^[-*] ")
    return lines.groupBy("doc_id").agg(F.count_if(heading).alias("headings"), F.count_if(item).alias("items"), F.count("*").alias("lines"))


@query("n28_image_kinds", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN greatest(l_quantity * 20, l_linenumber * 40) <= 160 THEN 'icon' WHEN greatest(l_quantity * 20, l_linenumber * 40) >= 6 * least(l_quantity * 20, l_linenumber * 40) THEN 'banner' ELSE 'figure' END AS kind FROM lineitem")
def _(t):
    w, h = F.col("l_quantity") * 20, F.col("l_linenumber") * 40
    kind = F.when(F.greatest(w, h) <= 160, "icon").when(F.greatest(w, h) >= 6 * F.least(w, h), "banner").otherwise("figure")
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", kind.alias("kind"))


@query("w1_skill_score", "SELECT s_suppkey, least(100.0, CAST(avg(CASE p_size % 4 WHEN 0 THEN 30 WHEN 1 THEN 60 WHEN 2 THEN 85 ELSE 97 END) AS DOUBLE) + least(10, count(*))) AS score FROM supplier JOIN (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) ON l_suppkey = s_suppkey JOIN part ON p_partkey = l_partkey GROUP BY 1")
def _(t):
    level = F.col("p_size") % 4
    points = F.when(level == 0, 30).when(level == 1, 60).when(level == 2, 85).otherwise(97)
    held = t.lineitem.select(F.col("l_suppkey").alias("s_suppkey"), F.col("l_partkey").alias("p_partkey")).distinct().join(t.part, "p_partkey")
    return held.join(t.supplier, "s_suppkey").groupBy("s_suppkey").agg(F.least(F.lit(100.0), F.avg(points) + F.least(F.lit(10), F.count("*"))).alias("score"))


@query("w2_document_score", "SELECT o_custkey, avg(CASE o_orderstatus WHEN 'F' THEN 100 WHEN 'P' THEN 50 ELSE 20 END) AS score FROM orders GROUP BY 1")
def _(t):
    points = F.when(F.col("o_orderstatus") == "F", 100).when(F.col("o_orderstatus") == "P", 50).otherwise(20)
    return t.orders.groupBy("o_custkey").agg(F.avg(points).alias("score"))


@query("w4_pay_percentile", "SELECT c_custkey, coalesce(CAST(rank() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal) - 1 AS DOUBLE) / nullif(count(*) OVER (PARTITION BY c_mktsegment) - 1, 0) * 100, 60) AS score FROM customer")
def _(t):
    found = windows.among_peers(t.customer, ["c_mktsegment"], "c_acctbal")
    return found.select("c_custkey", F.coalesce(F.col("percentile") * 100, F.lit(60.0)).alias("score"))


@query("w10_health_vector", _COMPOSITE + " SELECT c_custkey, delivery, reliability, growth FROM s")
def _(t):
    return _composite(t).select("c_custkey", "delivery", "reliability", "growth")


@query("w11_readiness", _COMPOSITE + " SELECT c_custkey, CAST((CASE WHEN reliability < 60 THEN 1 ELSE 0 END) + (CASE WHEN delivery < 40 THEN 1 ELSE 0 END) + (CASE WHEN growth < 50 THEN 1 ELSE 0 END) AS INTEGER) AS blockers FROM s")
def _(t):
    why = verify.reasons((F.col("reliability") < 60, "returns"), (F.col("delivery") < 40, "delivery"), (F.col("growth") < 50, "growth"))
    return _composite(t).select("c_custkey", F.size(why).alias("blockers"))


@query(
    "w15_promotion_due",
    """WITH o AS (SELECT o_custkey, CAST(count(*) FILTER (o_orderstatus = 'F') AS DOUBLE) / count(*) * 5 AS rating, floor((DATE '2001-08-01' - CAST(min(o_orderdate) AS DATE)) / 365.25) AS years, count(*) FILTER (o_orderstatus = 'P') > 0 AS pending FROM orders GROUP BY 1)
       SELECT c_custkey, CAST(floor(coalesce(rating, 0) * 20 + least(coalesce(years, 0), 30) - CASE WHEN c_acctbal < 0 THEN 50 ELSE 0 END - CASE WHEN pending THEN 10 ELSE 0 END + 0.5) AS BIGINT) AS score
       FROM customer LEFT JOIN o ON o_custkey = c_custkey""",
)
def _(t):
    """Everyone who is due, ranked: finished share as a rating of 5, years since the first order, debt and open orders as penalties."""
    status = F.col("o_orderstatus")
    years = F.floor(F.datediff(as_of(), F.min(day("o_orderdate"))) / 365.25)
    held = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg((F.count_if(status == "F") / F.count("*") * 5).alias("rating"), years.alias("years"), (F.count_if(status == "P") > 0).alias("pending"))
    zero = F.lit(0)
    points = F.coalesce("rating", zero) * 20 + F.least(F.coalesce("years", zero), F.lit(30)) - F.when(F.col("c_acctbal") < 0, 50).otherwise(0) - F.when(F.col("pending"), 10).otherwise(0)
    return t.customer.join(held, "c_custkey", "left").select("c_custkey", F.floor(points + 0.5).alias("score")).orderBy(F.col("score").desc(), "c_custkey")


@query(
    "w18_org_health",
    _COMPOSITE + """, f AS (SELECT c_nationkey, avg(delivery) AS d, avg(reliability) AS r, avg(growth) AS g FROM s GROUP BY 1)
       SELECT c_nationkey, round(0.4 * d + 0.35 * r + 0.25 * g, 6) AS health, CASE WHEN d <= g AND d <= r THEN 'delivery' WHEN g <= r THEN 'growth' ELSE 'reliability' END AS weakest FROM f""",
)
def _(t):
    f = _composite(t).groupBy("c_nationkey").agg(*(F.avg(c).alias(c) for c in ("delivery", "reliability", "growth")))
    weak = aggregates.weakest({c: F.col(c) for c in ("delivery", "growth", "reliability")})
    return f.select("c_nationkey", F.round(0.4 * F.col("delivery") + 0.35 * F.col("reliability") + 0.25 * F.col("growth"), 6).alias("health"), weak.alias("weakest"))


@query("w20_workforce_summary", "SELECT n_name, count(*) AS members, CAST(sum(CAST(c_acctbal AS DECIMAL(18,2))) AS DOUBLE) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def _(t):
    joined = t.customer.join(F.broadcast(t.nation), F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.groupBy("n_name").agg(F.count("*").alias("members"), total("c_acctbal").alias("balance"))


@query("w24_age_profile", "SELECT CASE WHEN y <= 2 THEN 'new' WHEN y <= 4 THEN 'settled' ELSE 'long' END AS band, count(*) AS n FROM (SELECT floor((DATE '2001-08-01' - CAST(o_orderdate AS DATE)) / 365.25) AS y FROM orders) GROUP BY 1")
def _(t):
    y = F.floor(F.datediff(as_of(), day("o_orderdate")) / 365.25)
    return t.orders.groupBy(F.when(y <= 2, "new").when(y <= 4, "settled").otherwise("long").alias("band")).agg(F.count("*").alias("n"))


@query("w28_statutory", "SELECT c_custkey, p * 0.12::DOUBLE AS pf, CASE WHEN p <= 2100 THEN p * 0.0075::DOUBLE ELSE 0 END AS esic, p / 26 * 15 AS gratuity FROM (SELECT c_custkey, greatest(c_acctbal, 0) AS p FROM customer)")
def _(t):
    p = F.greatest(F.col("c_acctbal"), F.lit(0.0))
    return t.customer.select("c_custkey", (p * 0.12).alias("pf"), F.when(p <= 2100, p * 0.0075).otherwise(0.0).alias("esic"), (p / 26 * 15).alias("gratuity"))


@query("w35_funnel", "SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'O') AS open, count(*) FILTER (o_orderstatus = 'P') AS pending, count(*) FILTER (o_orderstatus = 'F') AS finished FROM orders GROUP BY 1")
def _(t):
    return t.orders.groupBy("o_orderpriority").agg(*(F.count_if(F.col("o_orderstatus") == s).alias(n) for s, n in (("O", "open"), ("P", "pending"), ("F", "finished"))))


@query("w36_prior_requests", "SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey) - 1 AS others, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS BIGINT) AS before FROM orders")
def _(t):
    w = Window.partitionBy("o_custkey")
    return t.orders.select("o_orderkey", (F.count("*").over(w) - 1).alias("others"), (F.row_number().over(w.orderBy("o_orderdate", "o_orderkey")) - 1).cast("long").alias("before"))


@query("w38_compliance_radar", "SELECT 'finished' AS metric, CAST(count(*) FILTER (o_orderstatus = 'F') AS DOUBLE) / count(*) AS score FROM orders UNION ALL SELECT 'large', CAST(count(*) FILTER (o_totalprice > 100000) AS DOUBLE) / count(*) FROM orders")
def _(t):
    one = t.orders.agg((F.count_if(F.col("o_orderstatus") == "F") / F.count("*")).alias("finished"), (F.count_if(F.col("o_totalprice") > 100000) / F.count("*")).alias("large"))
    return one.selectExpr("stack(2, 'finished', finished, 'large', large) AS (metric, score)")


@query("w43_member_records", "SELECT c_custkey, count(o_orderkey) AS orders, max(o_orderdate) AS latest FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def _(t):
    held = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("orders"), F.max("o_orderdate").alias("latest"))
    return joins.with_defaults(t.customer.select("c_custkey"), held, "c_custkey", {"orders": 0})


@query("x5_budget_alerts", f"WITH s AS ({_MONTHLY}), x AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY m) - 1 AS i FROM s), y AS (SELECT c_nationkey, avg(v) AS usual, regr_intercept(v, i) + regr_slope(v, i) * count(*) AS p, count(*) AS n FROM x GROUP BY 1) SELECT c_nationkey, n >= 6 AND p > usual * 1.1 AS alert FROM y")
def _(t):
    x = _monthly(t).withColumn("i", F.row_number().over(Window.partitionBy("c_nationkey").orderBy("m")) - 1)
    line, n = windows.trend(F.col("i"), F.col("v")), F.count("*")
    y = x.groupBy("c_nationkey").agg(F.avg("v").alias("usual"), (line["intercept"] + line["slope"] * n).alias("p"), n.alias("n"))
    return y.select("c_nationkey", ((F.col("n") >= 6) & (F.col("p") > F.col("usual") * 1.1)).alias("alert"))


@query("x9_due_runs", "SELECT user_id, max(ts) < (SELECT max(ts) FROM events) - INTERVAL 6 HOUR AS due FROM events GROUP BY 1")
def _(t):
    now = t.events.agg(F.max("ts").alias("now"))
    last = t.events.groupBy("user_id").agg(F.max("ts").alias("last"))
    return last.crossJoin(F.broadcast(now)).select("user_id", (F.col("last") < F.col("now") - F.expr("INTERVAL 6 HOURS")).alias("due"))


@query("x10_contradictions", "SELECT conv_id, turn, contains(lower(text), 'the') AND NOT contains(lower(text), 'and') AS contradicts FROM conversations")
def _(t):
    said = F.lower("text")
    return t.conversations.select("conv_id", "turn", (said.contains("the") & ~said.contains("and")).alias("contradicts"))


@query("v1_numeric_cells", "SELECT source, count(*) FILTER (regexp_matches(w, '^[0-9]+$')) AS numeric, count(*) AS n FROM (SELECT source, unnest(string_split(text, ' ')) AS w FROM documents) GROUP BY 1")
def _(t):
    cells = t.documents.select("source", F.explode(F.split("text", " ")).alias("w"))
    return cells.groupBy("source").agg(F.count_if(F.col("w").rlike("^[0-9]+$")).alias("numeric"), F.count("*").alias("n"))


@query("v14_merged_fill", "SELECT doc, \"row\", 1 AS col, raw FROM (SELECT o_custkey AS doc, CAST(row_number() OVER w AS INTEGER) AS \"row\", first_value(o_orderstatus) OVER w AS raw FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey))")
def _(t):
    row = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    cells = t.orders.select(F.col("o_custkey").alias("doc"), row.alias("row"), F.lit(1).alias("col"), F.col("o_orderstatus").alias("raw"))
    cells = cells.withColumn("raw", F.when(F.col("row") == 1, F.col("raw")))
    ranges = cells.groupBy("doc").agg(F.lit(1).alias("r0"), F.max("row").alias("r1")).withColumns({"c0": F.lit(1), "c1": F.lit(1)})
    return verify.fill_merged(cells, ranges)


@query("v33_orphans", "SELECT doc_id, count(*) FILTER (regexp_matches(w, '[0-9]')) AS orphans FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS w FROM documents) GROUP BY 1")
def _(t):
    lines = t.documents.select("doc_id", F.explode(F.split("text", "\n")).alias("w"))
    return lines.groupBy("doc_id").agg(F.count_if(F.col("w").rlike("[0-9]")).alias("orphans"))


@query("k3_variance", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(CAST(l_shipdate AS DATE) - CAST(o_orderdate AS DATE) AS INTEGER) AS variance, CAST(l_shipdate AS DATE) <= CAST(o_orderdate AS DATE) AS critical FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def _(t):
    joined = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    late = F.datediff(day("l_shipdate"), day("o_orderdate"))
    return joined.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", late.alias("variance"), (late <= 0).alias("critical"))


@query("u3_escalate", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'E' ELSE o_orderstatus END AS o_orderstatus FROM orders")
def _(t):
    late = t.orders.where("o_orderstatus = 'P'").select("o_orderkey", F.lit("E").alias("o_orderstatus"))
    return changes.applied(t.orders.select("o_orderkey", "o_orderstatus"), late, "o_orderkey", ["o_orderstatus"]).drop("changed")


@query("s3_sliding_volume", "WITH d AS (SELECT CAST(unnest(generate_series(date_trunc('day', ts) - INTERVAL 6 DAY, date_trunc('day', ts), INTERVAL 1 DAY)) AS TIMESTAMP) AS start, event_type FROM events) SELECT start, start + INTERVAL 7 DAY AS \"end\", count(*) AS n, count(*) FILTER (event_type = 'error') AS errors FROM d GROUP BY 1, 2 HAVING start + INTERVAL 7 DAY <= (SELECT max(ts) - INTERVAL 1 DAY FROM events)")
def _(t):
    return jobs.drained(jobs.windowed_volume(jobs.events_stream(t.spark, t.folder), "7 days", "1 day", "1 day"), shared_folder(t.spark))


@query(
    "s3_recent_extremes",
    """WITH d AS (SELECT date_trunc('day', ts) AS day, sum(CAST(value AS DECIMAL(18,2))) AS total FROM events GROUP BY 1), m AS (SELECT max(ts) - INTERVAL 1 DAY AS mark FROM events),
       c AS (SELECT * FROM d WHERE day + INTERVAL 1 DAY <= (SELECT mark FROM m)), w AS (SELECT unnest(generate_series(day, day + INTERVAL 6 DAY, INTERVAL 1 DAY)) + INTERVAL 1 DAY AS "end", total FROM c)
       SELECT CAST("end" AS TIMESTAMP) AS "end", count(*) AS days, CAST(sum(total) AS DOUBLE) AS total, CAST(max(total) AS DOUBLE) AS most FROM w WHERE "end" <= (SELECT mark FROM m) GROUP BY 1""",
)
def _(t):
    return jobs.drained(jobs.recent_extremes(jobs.events_stream(t.spark, t.folder), "value", "1 day"), shared_folder(t.spark))


@query(
    "s5_stream_repeats",
    """WITH RECURSIVE e AS (SELECT user_id, event_type, event_id, ts, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM events), m AS (SELECT max(ts) - INTERVAL 1 DAY AS mark FROM events),
       r AS (SELECT user_id, event_type, n, event_id AS head, ts AS begun FROM e WHERE n = 1 UNION ALL SELECT e.user_id, e.event_type, e.n, CASE WHEN e.ts > r.begun + INTERVAL 7 DAY THEN e.event_id ELSE r.head END, CASE WHEN e.ts > r.begun + INTERVAL 7 DAY THEN e.ts ELSE r.begun END
         FROM r JOIN e ON e.user_id = r.user_id AND e.event_type = r.event_type AND e.n = r.n + 1), last AS (SELECT user_id, event_type, max(ts) AS seen FROM e GROUP BY 1, 2)
       SELECT user_id, event_type, head AS event_id, count(*) - 1 AS repeats FROM r JOIN last USING (user_id, event_type), m WHERE begun + INTERVAL 7 DAY < greatest(mark, seen) GROUP BY 1, 2, 3""",
)
def _(t):
    return jobs.drained(state.first_of_repeats(jobs.events_stream(t.spark, t.folder), ["user_id", "event_type"], 7 * 24, "1 day"), shared_folder(t.spark))
