"""Sources, filters, joins, aggregates, windows, sets and dates over the supplied tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyloom.catalog.registry import query
from tallyloom.functions import dates, text
from tallyloom.functions.numbers import band, money, ratio, total
from tallyloom.operators import aggregates, filters, joins, windows
from tallyloom.sources.shared import in_parts
from tallyloom.sources.tables import TABLES, append_new

AS_OF = "DATE '2001-08-01'"


def as_of():
    return F.lit("2001-08-01").cast("date")


def day(c: str):
    return F.to_date(c)


@query("a1_table_counts", " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n FROM {t}" for t in TABLES))
def _(t):
    out = None
    for name in TABLES:
        one = getattr(t, name).agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("a3_append_new", "SELECT o_orderkey, o_custkey FROM orders")
def _(t):
    o = t.orders.select("o_orderkey", "o_custkey")
    return append_new(o, o.where("o_orderkey % 2 = 0"), ["o_orderkey"])


@query(
    "a5_chunk_ordinals",
    """SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS BIGINT) AS chunk_ix, line FROM (
         SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents
       ) WHERE trim(line) <> ''""",
)
def _(t):
    lines = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line")).where("trim(line) <> ''")
    return lines.select("doc_id", (F.row_number().over(Window.partitionBy("doc_id").orderBy("pos")) - 1).cast("long").alias("chunk_ix"), "line")


@query("a6_hash_shards", "SELECT substr(sha1(CAST(doc_id AS VARCHAR)), 1, 2) AS shard, count(*) AS n FROM documents GROUP BY 1")
def _(t):
    return t.documents.groupBy(F.substring(F.sha1(F.col("doc_id").cast("string")), 1, 2).alias("shard")).agg(F.count("*").alias("n"))


@query("a8_size_guards", """SELECT doc_id, CASE WHEN n_chars = 0 THEN 'empty' WHEN n_chars > 20000 THEN 'too_large' WHEN n_chars < 400 THEN 'too_small' ELSE 'ok' END AS reason FROM documents""")
def _(t):
    n = F.col("n_chars")
    return t.documents.select("doc_id", F.when(n == 0, "empty").when(n > 20000, "too_large").when(n < 400, "too_small").otherwise("ok").alias("reason"))


@query("a10_log_retention", "SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 30")
def _(t):
    return filters.latest_by_key(t.events, "user_id", [F.col("ts").desc(), F.col("event_id").desc()], 30).select("user_id", "event_id")


@query("b1_directory_filter", "SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey = 7")
def _(t):
    return filters.directory_filter(t.customer, c_mktsegment="BUILDING", c_nationkey=7, c_name="All names").select("c_custkey", "c_name")


@query("b2_contains_any", "SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'an') OR contains(lower(p_brand), 'an')")
def _(t):
    return filters.contains_any(t.part, "AN", "p_name", "p_brand").select("p_partkey", "p_name")


@query(
    "b3_global_search",
    """(SELECT 'customer' AS entity, CAST(c_custkey AS VARCHAR) AS id, c_name AS title FROM customer WHERE contains(lower(c_name), '12') OR contains(lower(c_mktsegment), '12') ORDER BY c_custkey LIMIT 50)
       UNION ALL (SELECT 'supplier', CAST(s_suppkey AS VARCHAR), s_name FROM supplier WHERE contains(lower(s_name), '12') ORDER BY s_suppkey LIMIT 50)
       UNION ALL (SELECT 'part', CAST(p_partkey AS VARCHAR), p_name FROM part WHERE contains(lower(p_name), '12') OR contains(lower(p_brand), '12') ORDER BY p_partkey LIMIT 50)""",
)
def _(t):
    return filters.global_search("12", [("customer", t.customer, "c_custkey", ["c_name", "c_mktsegment"]), ("supplier", t.supplier, "s_suppkey", ["s_name"]), ("part", t.part, "p_partkey", ["p_name", "p_brand"])])


@query("b4_page", "SELECT o_orderkey, o_custkey, (SELECT count(*) FROM orders) AS total_rows FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 25 OFFSET 50")
def _(t):
    return filters.page(t.orders.select("o_orderkey", "o_custkey", "o_orderdate"), [F.col("o_orderdate"), F.col("o_orderkey")], 3, 25).drop("o_orderdate")


@query("b5_flag_filter", "SELECT c_custkey FROM customer WHERE c_acctbal < 0")
def _(t):
    return filters.flagged(t.customer.withColumn("overdrawn", F.col("c_acctbal") < 0), "overdrawn", {"overdrawn"}).select("c_custkey")


@query("b6_display_names", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'Finished' WHEN 'O' THEN 'Open' ELSE o_orderstatus END AS status FROM orders")
def _(t):
    return t.orders.select("o_orderkey", filters.displayed(F.col("o_orderstatus"), {"F": "Finished", "O": "Open"}).alias("status"))


@query("b7_distinct_values", "SELECT DISTINCT p_brand FROM part WHERE p_brand IS NOT NULL")
def _(t):
    return filters.distinct_values(t.part, "p_brand")


@query("b8_directory_columns", "SELECT c_custkey, c_name, c_mktsegment FROM customer")
def _(t):
    return t.customer.select("c_custkey", "c_name", "c_mktsegment")


@query("b9_visible_rows", "SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN o_orderpriority END AS o_orderpriority FROM orders WHERE o_custkey = 5")
def _(t):
    return filters.visible_rows(t.orders, "Employee", 5, "o_custkey", F.col("o_orderstatus") == "P", "o_orderpriority").select("o_orderkey", "o_orderpriority")


@query(
    "b10_bumped_priority",
    """SELECT o_orderkey, CAST(least(CASE WHEN o_orderpriority LIKE '1%' THEN 2 WHEN o_orderpriority LIKE '2%' THEN 1 ELSE 0 END + CASE WHEN r.l_orderkey IS NULL THEN 0 ELSE 1 END, 2) AS INTEGER) AS effective
       FROM orders LEFT JOIN (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_returnflag = 'R') r ON l_orderkey = o_orderkey""",
)
def _(t):
    returned = t.lineitem.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey")).distinct().withColumn("risk", F.lit(True))
    rank = F.when(F.col("o_orderpriority").startswith("1"), 2).when(F.col("o_orderpriority").startswith("2"), 1).otherwise(0)
    joined = joins.with_defaults(t.orders, returned, "o_orderkey", {"risk": False})
    return joined.select("o_orderkey", filters.bumped_priority(rank, F.col("risk")).alias("effective"))


@query("b12_bands", "SELECT c_custkey, CASE WHEN c_acctbal <= 0 THEN 'none' WHEN c_acctbal <= 2500 THEN 'low' WHEN c_acctbal <= 7500 THEN 'middle' ELSE 'high' END AS band FROM customer")
def _(t):
    return t.customer.select("c_custkey", band(F.col("c_acctbal"), [0, 2500, 7500], ["none", "low", "middle", "high"]).alias("band"))


@query("c1_member_org_join", "SELECT o_orderkey, c_name, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey")
def _(t):
    joined = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(t.nation), F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.select("o_orderkey", "c_name", "n_name")


@query("c2_left_defaults", "SELECT n_nationkey, coalesce(n, 0) AS customers FROM nation LEFT JOIN (SELECT c_nationkey, count(*) AS n FROM customer WHERE c_acctbal > 9000 GROUP BY 1) ON c_nationkey = n_nationkey")
def _(t):
    rich = t.customer.where("c_acctbal > 9000").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("customers"))
    return joins.with_defaults(t.nation.select("n_nationkey"), rich, "n_nationkey", {"customers": 0})


@query("c3_semi_filter", "SELECT o_orderkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def _(t):
    return t.orders.select("o_orderkey").join(t.lineitem.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_semi")


@query("c4_unknown_keys", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal >= 0)")
def _(t):
    known = t.customer.where("c_acctbal >= 0").select(F.col("c_custkey").alias("o_custkey"))
    return t.orders.select("o_orderkey", "o_custkey").join(known, "o_custkey", "left_anti")


_SPANS = """SELECT o_custkey, l_orderkey * 10 + l_linenumber AS span_id, CAST(l_shipdate AS DATE) AS s, CAST(l_shipdate AS DATE) + l_linenumber AS e, l_partkey, l_suppkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey"""


def _spans(t):
    joined = in_parts(t.lineitem, "l_orderkey").join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.select("o_custkey", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("span_id"), day("l_shipdate").alias("s"), F.date_add(day("l_shipdate"), F.col("l_linenumber")).alias("e"), "l_partkey", "l_suppkey")


@query("c5_interval_overlap", f"WITH x AS ({_SPANS}) SELECT a.o_custkey, count(*) AS pairs FROM x a JOIN x b ON a.o_custkey = b.o_custkey AND a.s <= b.e AND b.s <= a.e GROUP BY 1")
def _(t):
    x = _spans(t)
    return joins.overlapping(x, x, ["o_custkey"], "s", "e", ("span_id", "span_id")).groupBy("o_custkey").agg(F.count("*").alias("pairs"))


@query(
    "c6_near_repeats",
    """WITH x AS (SELECT l_suppkey, l_quantity, CAST(l_shipdate AS DATE) AS d, l_orderkey, l_linenumber, l_partkey FROM lineitem), y AS (
         SELECT *, lag(d) OVER w AS b, lead(d) OVER w AS a FROM x WINDOW w AS (PARTITION BY l_suppkey, l_quantity ORDER BY d))
       SELECT l_suppkey, count(*) AS n FROM y WHERE d - b <= 7 OR a - d <= 7 GROUP BY 1""",
)
def _(t):
    x = t.lineitem.select("l_suppkey", "l_quantity", day("l_shipdate").alias("d"), "l_orderkey")
    return joins.near_repeats(x, ["l_suppkey", "l_quantity"], "d", 7, "l_orderkey").groupBy("l_suppkey").agg(F.count("*").alias("n"))


@query(
    "c7_org_heads",
    "SELECT c.c_nationkey, min(c.c_custkey) AS head FROM customer c LEFT JOIN customer p ON p.c_custkey = c.c_custkey // 5 WHERE p.c_custkey IS NULL OR p.c_nationkey <> c.c_nationkey GROUP BY 1",
)
def _(t):
    return joins.heads(t.customer.withColumn("parent", F.floor(F.col("c_custkey") / 5)), "c_custkey", "parent", "c_nationkey")


@query(
    "c8_descendants",
    """WITH RECURSIVE e AS (SELECT c_custkey // 5 AS p, c_custkey AS c FROM customer WHERE c_custkey // 5 <> c_custkey), r AS (
         SELECT p AS root, c AS node, 1 AS depth FROM e UNION ALL SELECT r.root, e.c, r.depth + 1 FROM r JOIN e ON e.p = r.node WHERE r.depth < 3)
       SELECT root, CAST(depth AS INTEGER) AS depth, count(*) AS n FROM r GROUP BY 1, 2""",
)
def _(t):
    edges = t.customer.select(F.floor(F.col("c_custkey") / 5).alias("p"), F.col("c_custkey").alias("c")).where("p <> c")
    return joins.descendants(edges, "p", "c", 3).groupBy("root", "depth").agg(F.count("*").alias("n"))


@query(
    "c10_scoped_rules",
    """WITH r AS (SELECT * FROM (VALUES (1, 'BUILDING'), (2, NULL), (3, 'MACHINERY')) v(rule_id, scope))
       SELECT c_custkey, CAST(rule_id AS INTEGER) AS rule_id FROM customer JOIN r ON scope IS NULL OR scope = c_mktsegment""",
)
def _(t):
    rules = t.spark.createDataFrame([(1, "BUILDING"), (2, None), (3, "MACHINERY")], "rule_id int, scope string")
    return joins.scoped_rules(t.customer.select("c_custkey", "c_mktsegment"), rules, "c_mktsegment", "scope").select("c_custkey", "rule_id")


@query(
    "c11_bag_matches",
    """WITH a AS (SELECT CAST(floor(o_totalprice) AS BIGINT) AS v, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), b AS (SELECT CAST(floor(o_totalprice) AS BIGINT) AS v, count(*) AS n FROM orders WHERE o_orderstatus = 'O' GROUP BY 1)
       SELECT coalesce(a.v, b.v) AS v, coalesce(a.n, 0) AS n_a, coalesce(b.n, 0) AS n_b, least(coalesce(a.n, 0), coalesce(b.n, 0)) AS matched FROM a FULL JOIN b ON a.v = b.v""",
)
def _(t):
    o = t.orders.withColumn("v", F.floor("o_totalprice"))
    return joins.bag_matches(o.where("o_orderstatus = 'F'"), o.where("o_orderstatus = 'O'"), "v")


@query("c13_latest_record", "SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def _(t):
    return joins.latest_record(t.orders, "o_custkey", ["o_orderdate", "o_orderkey"], ["o_orderkey", "o_totalprice"])


@query("d1_counts", "SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY 1, 2")
def _(t):
    return t.customer.groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").alias("n"))


@query("d2_conditional_counts", "SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'O') AS n_open, count(*) FILTER (o_totalprice > 100000) AS large, count(*) AS n FROM orders GROUP BY 1")
def _(t):
    return t.orders.groupBy("o_orderpriority").agg(F.count_if(F.col("o_orderstatus") == "O").alias("n_open"), F.count_if(F.col("o_totalprice") > 100000).alias("large"), F.count("*").alias("n"))


@query(
    "d3_share_of_total",
    """SELECT l_returnflag, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS amount,
              CAST(sum(CASE WHEN l_discount > 0.05 THEN CAST(l_extendedprice AS DECIMAL(18,2)) ELSE 0 END) AS DOUBLE) / CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS discounted FROM lineitem GROUP BY 1""",
)
def _(t):
    part = F.when(F.col("l_discount") > 0.05, money("l_extendedprice")).otherwise(F.lit(0).cast("decimal(18,2)"))
    return t.lineitem.groupBy("l_returnflag").agg(total("l_extendedprice").alias("amount"), ratio(F.sum(part).cast("double"), total("l_extendedprice")).alias("discounted"))


@query(
    "d4_weighted_mean",
    "SELECT l_suppkey, CAST(sum(CAST(l_extendedprice * l_quantity AS DECIMAL(28,4))) AS DOUBLE) / CAST(sum(CAST(l_quantity AS DECIMAL(28,4))) AS DOUBLE) AS mean_price FROM lineitem GROUP BY 1",
)
def _(t):
    return t.lineitem.groupBy("l_suppkey").agg(aggregates.weighted_mean(F.col("l_extendedprice"), F.col("l_quantity")).alias("mean_price"))


@query("d5_document_confidence", "SELECT source, CAST(sum(CASE WHEN lang = 'en' THEN greatest(n_chars, 1) ELSE 0 END) AS DOUBLE) / CAST(sum(greatest(n_chars, 1)) AS DOUBLE) AS confidence FROM documents GROUP BY 1")
def _(t):
    weight = F.greatest(F.col("n_chars"), F.lit(1))
    return t.documents.groupBy("source").agg((F.sum(F.when(F.col("lang") == "en", weight).otherwise(0)).cast("double") / F.sum(weight)).alias("confidence"))


@query("d6_ratio_of_sums", "SELECT l_linestatus, CAST(sum(l_linenumber) AS DOUBLE) / CAST(sum(l_orderkey) AS DOUBLE) AS share FROM lineitem GROUP BY 1")
def _(t):
    return t.lineitem.groupBy("l_linestatus").agg(aggregates.mean_by_mode(F.col("l_linenumber"), F.col("l_orderkey"), "ratio_of_sums").alias("share"))


@query(
    "d7_two_level_mean",
    "SELECT c_nationkey, count(*) AS members, CAST(sum(t) AS DOUBLE) / count(*) AS mean_total FROM (SELECT c_nationkey, o_custkey, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS t FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2) GROUP BY 1",
)
def _(t):
    joined = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    return aggregates.two_level_mean(joined, "o_custkey", "c_nationkey", money("o_totalprice"))


@query("d8_status_summary", "SELECT user_id, " + ", ".join(f"count(*) FILTER (event_type = '{e}') AS n_{e}" for e in ("signup", "purchase", "view", "click", "error")) + " FROM events GROUP BY 1")
def _(t):
    return t.events.groupBy("user_id").agg(*(F.count_if(F.col("event_type") == e).alias(f"n_{e}") for e in ("signup", "purchase", "view", "click", "error")))


@query("d9_mode", "SELECT user_id, event_type, n FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) = 1")
def _(t):
    return aggregates.mode_of(t.events, "user_id", "event_type")


@query(
    "d10_weakest_metric",
    """SELECT c_nationkey, CASE WHEN b <= r AND b <= s THEN 'balance' WHEN r <= s THEN 'rich' ELSE 'segments' END AS weakest FROM (
         SELECT c_nationkey, CAST(count(*) FILTER (c_acctbal > 0) AS DOUBLE) / count(*) AS b, CAST(count(*) FILTER (c_acctbal > 5000) AS DOUBLE) / count(*) AS r, CAST(count(DISTINCT c_mktsegment) AS DOUBLE) / 5 AS s FROM customer GROUP BY 1)""",
)
def _(t):
    n = t.customer.groupBy("c_nationkey").agg(
        (F.count_if(F.col("c_acctbal") > 0) / F.count("*")).alias("b"), (F.count_if(F.col("c_acctbal") > 5000) / F.count("*")).alias("r"), (F.countDistinct("c_mktsegment") / 5).alias("s")
    )
    return n.select("c_nationkey", aggregates.weakest({"balance": F.col("b"), "rich": F.col("r"), "segments": F.col("s")}).alias("weakest"))


@query("d11_vacancies", "SELECT CAST(sum(greatest(0, p_size - coalesce(n, 0))) AS BIGINT) AS vacant FROM part LEFT JOIN (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_partkey = p_partkey")
def _(t):
    filled = t.lineitem.groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("filled"))
    return aggregates.shortfall(t.part.select("p_partkey", "p_size"), filled, "p_partkey", "p_size", "filled")


@query("d12_distinct_counts", "SELECT c_nationkey, count(DISTINCT o_custkey) AS buyers FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1")
def _(t):
    return t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).groupBy("c_nationkey").agg(F.countDistinct("o_custkey").alias("buyers"))


@query("d13_list_rollup", "SELECT l_orderkey, count(*) AS n, CAST(count(*) FILTER (l_returnflag = 'R') AS DOUBLE) / count(*) AS returned, list_sort(list(l_partkey))[1] AS first_part FROM lineitem GROUP BY 1")
def _(t):
    rolled = t.lineitem.groupBy("l_orderkey").agg(F.array_sort(F.collect_list("l_partkey")).alias("parts"), (F.count_if(F.col("l_returnflag") == "R") / F.count("*")).alias("returned"))
    return rolled.select("l_orderkey", F.size("parts").cast("long").alias("n"), "returned", F.col("parts")[0].alias("first_part"))


@query("d14_last_months", "SELECT m, count(*) AS n FROM (SELECT strftime(l_shipdate, '%Y-%m') AS m FROM lineitem) WHERE m IN (SELECT DISTINCT strftime(l_shipdate, '%Y-%m') FROM lineitem ORDER BY 1 DESC LIMIT 6) GROUP BY 1")
def _(t):
    months = t.lineitem.select(F.date_format("l_shipdate", "yyyy-MM").alias("m"))
    return aggregates.last_periods(months, "m", 6).groupBy("m").agg(F.count("*").alias("n"))


@query(
    "d15_scope_totals",
    "SELECT n_regionkey, n_nationkey, CAST(grouping_id(n_regionkey, n_nationkey) AS BIGINT) AS level, count(*) AS n, CAST(sum(CAST(c_acctbal AS DECIMAL(18,2))) AS DOUBLE) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ROLLUP (n_regionkey, n_nationkey)",
)
def _(t):
    joined = t.customer.join(F.broadcast(t.nation), F.col("c_nationkey") == F.col("n_nationkey"))
    return aggregates.scope_totals(joined, "n_regionkey", "n_nationkey", F.count("*").alias("n"), total("c_acctbal").alias("balance"))


@query("d16_element_counts", "SELECT tag, count(*) AS n FROM (SELECT unnest(regexp_extract_all(html, '<([a-z][a-z0-9]*)', 1)) AS tag FROM pages) GROUP BY 1")
def _(t):
    tags = t.pages.select(F.explode(F.regexp_extract_all("html", F.lit("<([a-z][a-z0-9]*)"), F.lit(1))).alias("tag"))
    return tags.groupBy("tag").agg(F.count("*").alias("n"))


@query(
    "e1_latest_change",
    """WITH x AS (SELECT o_custkey, o_totalprice, row_number() OVER w AS r, lead(o_totalprice) OVER w AS p FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC))
       SELECT o_custkey, o_totalprice AS latest, p AS previous, coalesce(o_totalprice < p, false) AS declining FROM x WHERE r = 1""",
)
def _(t):
    w = Window.partitionBy("o_custkey").orderBy(F.col("o_orderdate").desc(), F.col("o_orderkey").desc())
    x = t.orders.select("o_custkey", F.col("o_totalprice").alias("latest"), F.row_number().over(w).alias("r"), F.lead("o_totalprice").over(w).alias("previous")).where("r = 1")
    return x.select("o_custkey", "latest", "previous", F.coalesce(F.col("latest") < F.col("previous"), F.lit(False)).alias("declining"))


@query(
    "e2_among_peers",
    """SELECT c_custkey, count(*) OVER g - 1 AS n_peers, CAST(rank() OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_acctbal) - 1 AS DOUBLE) / nullif(count(*) OVER g - 1, 0) AS percentile,
              CAST(sum(CAST(c_acctbal AS DECIMAL(18,2))) OVER g - CAST(c_acctbal AS DECIMAL(18,2)) AS DOUBLE) / nullif(count(*) OVER g - 1, 0) AS peer_mean
       FROM customer WINDOW g AS (PARTITION BY c_nationkey, c_mktsegment)""",
)
def _(t):
    return windows.among_peers(t.customer, ["c_nationkey", "c_mktsegment"], "c_acctbal").select("c_custkey", "n_peers", "percentile", "peer_mean")


_MONTHLY = "SELECT c_nationkey, date_trunc('month', o_orderdate)::DATE AS m, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS v FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2"


def _monthly(t):
    joined = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    return joined.groupBy("c_nationkey", F.trunc(day("o_orderdate"), "month").alias("m")).agg(total("o_totalprice").alias("v"))


@query(
    "e3_first_last_trend",
    f"WITH s AS ({_MONTHLY}), x AS (SELECT c_nationkey, arg_min(v, m) AS first_value, arg_max(v, m) AS last_value FROM s GROUP BY 1) SELECT *, CASE WHEN last_value - first_value >= 1000 THEN 'Improving' WHEN last_value - first_value <= -1000 THEN 'Declining' ELSE 'Stable' END AS trend FROM x",
)
def _(t):
    return windows.first_and_last(_monthly(t), "c_nationkey", "m", "v", 1000)


@query("e4_recent_against_prior", f"WITH s AS ({_MONTHLY}), x AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY m DESC) AS r FROM s) SELECT c_nationkey, round(avg(v) FILTER (r <= 3), 2) AS recent_mean, round(avg(v) FILTER (r > 3), 2) AS prior_mean FROM x GROUP BY 1")
def _(t):
    found = windows.recent_against_prior(_monthly(t), "c_nationkey", "m", F.col("v"), 3)
    return found.select("c_nationkey", F.round("recent_mean", 2).alias("recent_mean"), F.round("prior_mean", 2).alias("prior_mean"))


@query("e6_top_per_group", "SELECT c_nationkey, c_custkey, row_number() OVER w AS position FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_name) QUALIFY row_number() OVER w <= 5")
def _(t):
    return windows.top_k(t.customer, "c_nationkey", [F.col("c_acctbal").desc(), F.col("c_name")], 5).select("c_nationkey", "c_custkey", "position")


@query("e8_ordinal_ids", "SELECT o_custkey, o_orderkey, o_custkey || '.' || lpad(CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS VARCHAR), 4, '0') AS item_id FROM orders")
def _(t):
    return windows.ordinal_id(t.orders, "o_custkey", [F.col("o_orderdate"), F.col("o_orderkey")]).select("o_custkey", "o_orderkey", "item_id")


@query(
    "e9_trend_line",
    f"""WITH s AS ({_MONTHLY}), x AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY m) - 1 AS i FROM s)
       SELECT c_nationkey, round(regr_slope(v, i), 3) AS slope, round(regr_r2(v, i), 6) AS fit FROM x GROUP BY 1""",
)
def _(t):
    x = _monthly(t).withColumn("i", F.row_number().over(Window.partitionBy("c_nationkey").orderBy("m")) - 1)
    line = windows.trend(F.col("i"), F.col("v"))
    return x.groupBy("c_nationkey").agg(F.round(line["slope"], 3).alias("slope"), F.round(line["fit"], 6).alias("fit"))


@query(
    "e10_longest_rising",
    """WITH RECURSIVE o AS (SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i, o_totalprice AS v FROM orders),
       r AS (SELECT o_custkey, i, v, 1 AS n FROM o UNION SELECT o.o_custkey, o.i, o.v, r.n + 1 FROM r JOIN o ON o.o_custkey = r.o_custkey AND o.i > r.i AND o.v > r.v)
       SELECT o_custkey, CAST(max(n) AS BIGINT) AS rising FROM r GROUP BY 1""",
)
def _(t):
    return windows.longest_rising(t.orders.select("o_custkey", "o_orderkey", "o_totalprice"), "o_custkey", ["o_orderkey"], "o_totalprice")


@query(
    "e11_serial_gaps",
    """WITH x AS (SELECT o_custkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i, o_orderkey FROM orders), y AS (SELECT k, i FROM x WHERE o_orderkey % 7 <> 3), z AS (SELECT k, i, i - lag(i) OVER (PARTITION BY k ORDER BY i) AS d FROM y),
       g AS (SELECT k, count(*) AS n, count(*) FILTER (d = 1) AS runs, min(i) AS lo, max(i) AS hi FROM z GROUP BY 1 HAVING count(*) >= 3 AND count(*) FILTER (d = 1) >= 0.6 * (count(*) - 1)),
       m AS (SELECT k, unnest(generate_series(lo, hi)) AS v FROM g), a AS (SELECT m.k, m.v FROM m ANTI JOIN y ON y.k = m.k AND y.i = m.v)
       SELECT k, count(*) AS missing, min(v) AS first_missing FROM a GROUP BY 1""",
)
def _(t):
    numbered = t.orders.select(F.col("o_custkey").alias("k"), F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).cast("long").alias("i"), "o_orderkey").where("o_orderkey % 7 <> 3")
    found = windows.serial_gaps(numbered, "k", "i")
    return found.groupBy("k").agg(F.sum(F.col("last_missing") - F.col("first_missing") + 1).alias("missing"), F.min("first_missing").alias("first_missing"))


@query(
    "e12_value_clusters",
    "WITH x AS (SELECT user_id, event_id, value, CASE WHEN value - lag(value) OVER w <= 5 THEN 0 ELSE 1 END AS o FROM events WINDOW w AS (PARTITION BY user_id ORDER BY value)) SELECT user_id, CAST(sum(o) AS BIGINT) AS clusters FROM x GROUP BY 1",
)
def _(t):
    return windows.clusters(t.events, "user_id", "value", 5.0).groupBy("user_id").agg(F.max("cluster").alias("clusters"))


@query(
    "e13_interval_islands",
    f"WITH x AS ({_SPANS}), y AS (SELECT *, max(e) OVER (PARTITION BY o_custkey ORDER BY s, e, span_id, l_partkey, l_suppkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM x) SELECT o_custkey, count(*) FILTER (reach IS NULL OR s > reach) AS islands FROM y GROUP BY 1",
)
def _(t):
    spans = in_parts(_spans(t), "o_custkey", rows=t.lineitem.count())
    return windows.islands(spans, "o_custkey", "s", "e", "span_id").groupBy("o_custkey").agg(F.count("*").alias("islands"))


@query(
    "e15_repeated_lines",
    """WITH l AS (SELECT source, doc_id, regexp_replace(trim(unnest(string_split(text, chr(10)))), '[0-9]', '#', 'g') AS line FROM documents), p AS (SELECT source, count(DISTINCT doc_id) AS pages FROM documents GROUP BY 1)
       SELECT l.source, line, count(DISTINCT doc_id) AS n FROM l JOIN p ON p.source = l.source WHERE line <> '' GROUP BY l.source, line, pages HAVING count(DISTINCT doc_id) >= greatest(2, 0.02 * pages)""",
)
def _(t):
    lines = t.documents.select("source", "doc_id", F.explode(F.split("text", "\n")).alias("raw")).select("source", "doc_id", F.regexp_replace(F.trim("raw"), "[0-9]", "#").alias("line")).where("line <> ''")
    pages = t.documents.groupBy("source").agg(F.countDistinct("doc_id").alias("pages"))
    counted = lines.distinct().groupBy("source", "line").agg(F.count("*").alias("n"))
    return counted.join(pages, "source").where("n >= greatest(2, 0.02 * pages)").select("source", "line", "n")


@query("e16_first_of_copies", "SELECT md5(text) AS digest, min(doc_id) AS first_doc, count(*) AS copies FROM documents GROUP BY 1")
def _(t):
    return t.documents.groupBy(F.md5("text").alias("digest")).agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("copies"))


@query("f1_sorted", "SELECT c_custkey, c_acctbal FROM customer")
def _(t):
    return t.customer.select("c_custkey", "c_acctbal").orderBy(F.col("c_acctbal").asc(), F.col("c_custkey").asc())


@query("f2_top_n", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def _(t):
    return t.orders.select("o_orderkey", "o_totalprice").orderBy(F.col("o_totalprice").desc(), "o_orderkey").limit(10)


@query(
    "f3_calendar_feed",
    """SELECT 'order' AS kind, o_orderkey AS id, CAST(o_orderdate AS DATE) AS d, o_orderpriority AS note FROM orders UNION ALL SELECT 'shipment', l_orderkey, CAST(l_shipdate AS DATE), NULL FROM lineitem WHERE l_linestatus = 'O'""",
)
def _(t):
    a = t.orders.select(F.lit("order").alias("kind"), F.col("o_orderkey").alias("id"), day("o_orderdate").alias("d"), F.col("o_orderpriority").alias("note"))
    b = t.lineitem.where("l_linestatus = 'O'").select(F.lit("shipment").alias("kind"), F.col("l_orderkey").alias("id"), day("l_shipdate").alias("d"))
    return a.unionByName(b, allowMissingColumns=True)


@query("f4_set_difference", "SELECT o_orderkey FROM orders EXCEPT SELECT l_orderkey FROM lineitem")
def _(t):
    return t.orders.select("o_orderkey").subtract(t.lineitem.select("l_orderkey"))


@query(
    "f7_month_spine",
    """WITH b AS (SELECT date_trunc('month', min(l_shipdate)) AS lo, date_trunc('month', max(l_shipdate)) AS hi FROM lineitem), s AS (SELECT CAST(unnest(generate_series(lo, hi, INTERVAL 1 MONTH)) AS DATE) AS m FROM b),
       c AS (SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS m, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 49 GROUP BY 1) SELECT s.m, coalesce(n, 0) AS n FROM s LEFT JOIN c ON c.m = s.m""",
)
def _(t):
    month = F.trunc(day("l_shipdate"), "month")
    spine = t.lineitem.agg(F.min(month).alias("lo"), F.max(month).alias("hi")).select(F.explode(F.expr("sequence(lo, hi, interval 1 month)")).alias("m"))
    counted = t.lineitem.where("l_returnflag = 'R' AND l_quantity > 49").groupBy(month.alias("m")).agg(F.count("*").alias("n"))
    return joins.with_defaults(spine, counted, "m", {"n": 0})


@query("f9_ranked_search", "WITH x AS (SELECT p_partkey, CASE WHEN lower(p_name) = 'part' THEN 100 WHEN lower(p_name) LIKE 'part%' THEN 80 WHEN lower(p_name) LIKE '% part%' THEN 60 WHEN lower(p_name) LIKE '%part%' THEN 40 WHEN lower(p_type) LIKE '%part%' THEN 10 ELSE 0 END AS score FROM part) SELECT * FROM x WHERE score > 0 ORDER BY score DESC, p_partkey LIMIT 20")
def _(t):
    x = t.part.select("p_partkey", filters.relevance(F.col("p_name"), F.col("p_type"), "part").alias("score"))
    return x.where("score > 0").orderBy(F.col("score").desc(), "p_partkey").limit(20)


@query("g1_days_since", f"SELECT o_orderkey, CAST({AS_OF} - CAST(o_orderdate AS DATE) AS INTEGER) AS days FROM orders")
def _(t):
    return t.orders.select("o_orderkey", dates.days_since(F.col("o_orderdate"), as_of()).alias("days"))


@query("g2_years_of_service", f"SELECT o_orderkey, CAST(floor(({AS_OF} - CAST(o_orderdate AS DATE)) / 365.25) AS BIGINT) AS years FROM orders")
def _(t):
    return t.orders.select("o_orderkey", dates.years_of_service(F.col("o_orderdate"), as_of()).alias("years"))


@query("g4_inclusive_days", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(CAST(l_shipdate AS DATE) - CAST(o_orderdate AS DATE) + 1 AS INTEGER) AS days FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def _(t):
    joined = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", dates.inclusive_days(day("o_orderdate"), day("l_shipdate")).alias("days"))


@query("g5_days_of_ranges", f"WITH x AS ({_SPANS}) SELECT d, count(*) AS away FROM (SELECT CAST(unnest(generate_series(s::TIMESTAMP, e::TIMESTAMP, INTERVAL 1 DAY)) AS DATE) AS d FROM x) GROUP BY 1")
def _(t):
    return _spans(t).select(F.explode(F.sequence("s", "e")).alias("d")).groupBy("d").agg(F.count("*").alias("away"))


@query(
    "g6_next_deadline",
    f"""WITH x AS (SELECT p_partkey, least(p_size, 31) AS k FROM part), y AS (SELECT p_partkey, k, CAST(date_trunc('month', {AS_OF}) AS DATE) AS f, CAST(date_trunc('month', {AS_OF}) + INTERVAL 1 MONTH AS DATE) AS g FROM x),
       z AS (SELECT p_partkey, f + CAST(least(k, day(last_day(f))) - 1 AS INTEGER) AS a, g + CAST(least(k, day(last_day(g))) - 1 AS INTEGER) AS b FROM y) SELECT p_partkey, CASE WHEN a >= {AS_OF} THEN a ELSE b END AS due FROM z""",
)
def _(t):
    return t.part.select("p_partkey", dates.next_monthly(F.least(F.col("p_size"), F.lit(31)), as_of()).alias("due"))


@query("g7_milestones", f"SELECT o_orderkey, CASE WHEN d BETWEEN 900 AND 930 THEN 'first' WHEN d BETWEEN 1800 AND 1830 THEN 'second' END AS milestone FROM (SELECT o_orderkey, {AS_OF} - CAST(o_orderdate AS DATE) AS d FROM orders)")
def _(t):
    return t.orders.select("o_orderkey", dates.milestone(dates.days_since(F.col("o_orderdate"), as_of()), [(900, 930, "first"), (1800, 1830, "second")]).alias("milestone"))


@query("g10_serial_dates", "SELECT DISTINCT l_partkey, CAST(DATE '1899-12-30' + CAST(l_partkey AS INTEGER) AS DATE) AS d FROM lineitem")
def _(t):
    return t.lineitem.select("l_partkey").distinct().select("l_partkey", F.to_date(dates.serial_to_timestamp(F.col("l_partkey"))).alias("d"))


@query(
    "n1_parse_number",
    "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS DOUBLE) * CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END AS value FROM lineitem",
)
def _(t):
    shown = F.concat(F.lit("₹ "), F.format_number(F.col("l_extendedprice").cast("decimal(18,2)"), 2))
    cell = F.when(F.col("l_returnflag") == "R", F.concat(F.lit("("), shown, F.lit(")"))).otherwise(shown)
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", text.parse_number(cell).alias("value"))


@query("n9_script", "SELECT doc_id, 'latin' AS script FROM documents")
def _(t):
    return t.documents.select("doc_id", text.script_of(F.col("text")).alias("script"))


@query("n12_addresses", r"SELECT page_id, count(DISTINCT lower(u)) AS urls FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]+)\"', 1)) AS u FROM pages) GROUP BY 1")
def _(t):
    found = t.pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1))).alias("u"))
    return found.groupBy("page_id").agg(F.countDistinct(F.lower("u")).alias("urls"))


@query("n13_error_rate", "SELECT item_id, CAST(levenshtein(lower(trim(replace(text, 'e', ''))), lower(trim(text))) AS DOUBLE) / length(lower(trim(text))) AS cer FROM benchmark")
def _(t):
    return t.benchmark.select("item_id", text.error_rate(F.translate("text", "e", ""), F.col("text")).alias("cer"))


@query("n19_slab_tax", "SELECT c_custkey, least(x, 30000) * 0.05::DOUBLE + greatest(0, least(x, 60000) - 30000) * 0.1::DOUBLE + greatest(0, x - 60000) * 0.2::DOUBLE AS tax FROM (SELECT c_custkey, greatest(0, c_acctbal * 12) AS x FROM customer)")
def _(t):
    x = F.greatest(F.lit(0.0), F.col("c_acctbal") * 12)
    slabs = [(0, 30000, 0.05), (30000, 60000, 0.1), (60000, 1e12, 0.2)]
    tax = sum((F.greatest(F.lit(0.0), F.least(x, F.lit(float(hi))) - lo) * rate for lo, hi, rate in slabs), F.lit(0.0))
    return t.customer.select("c_custkey", tax.alias("tax"))


@query("n26_whole_cells", "SELECT doc_id, CASE WHEN substr(text, 1, 1) IN ('=', '+', '-', '@') THEN '''' || text ELSE text END AS shown FROM documents")
def _(t):
    return t.documents.select("doc_id", text.guard_formula(F.col("text")).alias("shown"))
