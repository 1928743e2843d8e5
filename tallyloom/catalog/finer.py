"""Rules in full beside the shorter forms of other modules: repairs, scripts, percents, taxes, votes, alerts, batches."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyloom.catalog.registry import query
from tallyloom.functions import text
from tallyloom.operators import graphs
from tallyloom.plans import verify
from tallyloom.sources.shared import with_checkpoints

_LINE = "l_orderkey, l_linenumber, l_partkey, l_suppkey"
_ROWS = f"""WITH b AS (SELECT {_LINE}, CAST(l_quantity AS INTEGER) AS q, l_linenumber * 11 AS r, (l_orderkey + l_linenumber) % 4 AS k FROM lineitem)"""


@query(
    "v12_look_alikes",
    # Of the four spellings only two can be told: a misread zero of the amount and a misread one of the rate where no other reading fits.
    _ROWS
    + f""", s AS (SELECT *, CAST(q * r AS VARCHAR) AS a, CAST(r AS VARCHAR) AS rs FROM b)
       SELECT {_LINE}, CAST(q AS DOUBLE) AS qty, CAST(q * r AS DOUBLE) AS amount FROM s
       WHERE k = 1 AND strpos(a, '0') > 0 AND NOT starts_with(a, '0') AND length(a) - length(replace(a, '0', '')) <= 2 AND abs(q * r - CAST(split_part(a, '0', 1) AS DOUBLE)) > greatest(1, 0.005 * CAST(split_part(a, '0', 1) AS DOUBLE))""",
)
def _(t):
    q, r, k = F.col("l_quantity").cast("int"), F.col("l_linenumber") * 11, (F.col("l_orderkey") + F.col("l_linenumber")) % 4
    amount = (q * r).cast("string")
    # Zeros of one row in four are written as letters; a cell with more than two of them is left alone.
    said = F.when(k == 1, F.translate(amount, "0", "O")).otherwise(amount)
    # Readings are made of rows whose arithmetic fails only.
    rows = t.lineitem.select(*_LINE.split(", "), q.cast("string").alias("q"), r.cast("string").alias("r"), said.alias("a")).where(verify.misread(F.col("q"), F.col("r"), F.col("a")))
    x = rows.select(*_LINE.split(", "), verify.repair_look_alikes(F.col("q"), F.col("r"), F.col("a")).alias("x"))
    return x.where("x IS NOT NULL").select(*_LINE.split(", "), "x.qty", "x.amount")


@query("v21_piecewise_calibration", "SELECT o_orderkey, o_custkey, CAST(CASE WHEN c <= 0.2 THEN 0.1 WHEN c <= 0.5 THEN 0.1 + (c - 0.2) * ((0.4 - 0.1) / (0.5 - 0.2)) WHEN c <= 0.9 THEN 0.4 + (c - 0.5) * ((0.95 - 0.4) / (0.9 - 0.5)) ELSE 0.95 END AS DOUBLE) AS calibrated FROM (SELECT o_orderkey, o_custkey, CAST(o_orderkey % 100 AS DOUBLE) / 100 AS c FROM orders)")
def _(t):
    x = t.orders.select("o_orderkey", "o_custkey", (F.col("o_orderkey") % 100 / 100).alias("c"))
    return verify.piecewise(x, "c", [(0.2, 0.1), (0.5, 0.4), (0.9, 0.95)], "calibrated").select("o_orderkey", "o_custkey", "calibrated")


@query(
    "e17_box_groups",
    """WITH RECURSIVE b AS (SELECT l_orderkey AS page, l_orderkey * 1000 + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS id, l_quantity * 10 AS x, l_linenumber * 40 AS y FROM lineitem),
       e AS (SELECT p.id AS a, q.id AS b FROM b p JOIN b q ON p.page = q.page AND p.id <> q.id AND abs(p.x - q.x) <= 60 + 12 AND abs(p.y - q.y) <= 30 + 12),
       r AS (SELECT id AS node, id AS seen FROM b UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.seen) SELECT node // 1000 AS page, count(*) AS boxes, count(DISTINCT root) AS groups FROM (SELECT node, min(seen) AS root FROM r GROUP BY 1) GROUP BY 1""",
)
def _(t):
    n = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity"))
    x, y = F.col("l_quantity") * 10, F.col("l_linenumber") * 40
    boxes = t.lineitem.select(F.col("l_orderkey").alias("page"), (F.col("l_orderkey") * 1000 + n).alias("id"), x.alias("x0"), y.alias("y0"), (x + 60).alias("x1"), (y + 30).alias("y1"))
    groups = graphs.box_groups(boxes, "page", "id", 12)
    return groups.groupBy("page").agg(F.count("*").alias("boxes"), F.countDistinct("root").alias("groups"))


@query(
    "n9_script_shares",
    r"WITH x AS (SELECT doc_id, len(regexp_extract_all(text, '[\x{900}-\x{97F}]')) AS d, len(regexp_extract_all(text, '[A-Za-z]')) AS l FROM documents) SELECT doc_id, CASE WHEN d + l = 0 THEN 'none' WHEN d = 0 THEN 'latin' WHEN l = 0 THEN 'devanagari' ELSE 'mixed' END AS script, CASE WHEN d + l > 0 THEN round(100.0 * d / (d + l), 6) END AS devanagari_percent FROM x",
)
def _(t):
    count = lambda p: F.length(F.regexp_replace("text", f"[^{p}]", ""))
    x = t.documents.select("doc_id", count(r"\x{0900}-\x{097F}").alias("d"), count("A-Za-z").alias("l"))
    both = F.col("d") + F.col("l")
    script = F.when(both == 0, "none").when(F.col("d") == 0, "latin").when(F.col("l") == 0, "devanagari").when(both > 0, "mixed")
    return x.select("doc_id", script.alias("script"), F.when(both > 0, F.round(100 * F.col("d") / both, 6)).alias("devanagari_percent"))


@query(
    "n10_number_dense",
    r"WITH x AS (SELECT doc_id, regexp_extract_all(text, '[^ \t\n\r\x0b\x0c]+') AS w FROM documents), y AS (SELECT doc_id, len(w) AS n, len(list_filter(w, lambda t: regexp_matches(t, '[0-9]'))) AS d, len(list_filter(w, lambda t: length(t) <= 4)) AS s FROM x) SELECT doc_id, n >= 8 AND (d >= 0.30 * n OR (d >= 0.12 * n AND s >= 0.55 * n)) AS table_like FROM y",
)
def _(t):
    x = t.documents.select("doc_id", F.regexp_extract_all("text", F.lit(r"[^ \t\n\r\x0b\x0c]+"), F.lit(0)).alias("w"))
    n, d, s = F.size("w"), F.size(F.filter("w", lambda w: w.rlike("[0-9]"))), F.size(F.filter("w", lambda w: F.length(w) <= 4))
    return x.select("doc_id", ((n >= 8) & ((d >= 0.30 * n) | ((d >= 0.12 * n) & (s >= 0.55 * n)))).alias("table_like"))


@query(
    "n12_page_addresses",
    r"WITH x AS (SELECT page_id, unnest(list_concat(regexp_extract_all(html, 'https?://[^\s\"<>)]+'), regexp_extract_all(html, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9.-]+'))) AS a FROM pages) SELECT DISTINCT page_id, lower(rtrim(a, '.,;')) AS address, contains(a, '@') AND NOT starts_with(a, 'http') AS is_mail FROM x",
)
def _(t):
    urls = F.regexp_extract_all("html", F.lit(r'https?://[^\s"<>)]+'), F.lit(0))
    mails = F.regexp_extract_all("html", F.lit(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9.-]+"), F.lit(0))
    x = t.pages.select("page_id", F.explode(F.concat(urls, mails)).alias("a"))
    return x.select("page_id", F.lower(F.rtrim(F.col("a"), F.lit(".,;"))).alias("address"), (F.col("a").contains("@") & ~F.col("a").startswith("http")).alias("is_mail")).distinct()


@query(
    "n14_token_votes",
    r"""WITH w AS (SELECT DISTINCT conv_id, turn % 3 AS engine, unnest(regexp_split_to_array(lower(text), '[^a-z0-9]+')) AS w FROM conversations), x AS (SELECT * FROM w WHERE w <> ''), n AS (SELECT conv_id, turn % 3 AS engine FROM conversations GROUP BY 1, 2),
       k AS (SELECT n.conv_id, n.engine, count(w) AS n FROM n LEFT JOIN x ON x.conv_id = n.conv_id AND x.engine = n.engine GROUP BY 1, 2),
       p AS (SELECT a.conv_id, CAST(coalesce((SELECT count(*) FROM x u JOIN x v ON u.conv_id = v.conv_id AND u.w = v.w WHERE u.conv_id = a.conv_id AND u.engine = a.engine AND v.engine = b.engine), 0) AS DOUBLE) AS both, a.n + b.n AS n FROM k a JOIN k b ON a.conv_id = b.conv_id AND a.engine < b.engine)
       SELECT conv_id, count(*) AS pairs, round(avg(CASE WHEN n > both THEN both / (n - both) ELSE 0 END), 9) AS agreement, avg(CASE WHEN n > both THEN both / (n - both) ELSE 0 END) >= 0.6 AS primary_stands FROM p GROUP BY 1""".replace("both", "met"),
)
def _(t):
    # Every third turn of a conversation stands for what one of three engines read of a page.
    engine = (F.col("turn") % 3).alias("engine")
    return text.engine_votes(t.conversations.select("conv_id", engine, "text"), "conv_id", "engine", "text")


@query(
    "n18_fractions",
    f"WITH x AS (SELECT {_LINE}, CASE WHEN l_suppkey % 3 = 0 THEN l_discount * 100 WHEN l_suppkey % 7 = 1 THEN l_discount - 0.02 ELSE l_discount END AS v FROM lineitem), s AS (SELECT *, max(CASE WHEN v >= 0 THEN v END) OVER (PARTITION BY l_suppkey) AS m FROM x) SELECT {_LINE}, round(least(1.0, greatest(0.0, CASE WHEN m > 0 AND m <= 1 THEN v ELSE v / 100 END)), 9) AS fraction FROM s",
)
def _(t):
    v = F.when(F.col("l_suppkey") % 3 == 0, F.col("l_discount") * 100).when(F.col("l_suppkey") % 7 == 1, F.col("l_discount") - 0.02).otherwise(F.col("l_discount"))
    # A supplier's lines are a file; its greatest value tells the scale.
    most = t.lineitem.select("l_suppkey", v.alias("v")).where("v >= 0").groupBy("l_suppkey").agg(F.max("v").alias("m"))
    x = t.lineitem.select(*_LINE.split(", "), v.alias("v")).join(most, "l_suppkey", "left")
    fraction = F.when((F.col("m") > 0) & (F.col("m") <= 1), F.col("v")).otherwise(F.col("v") / 100)
    return x.select(*_LINE.split(", "), F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), fraction)), 9).alias("fraction"))


#: Upper ends of the slabs and rates, new and old rules, and the deduction of both.
NEW_SLABS = [(300000, 0.0), (600000, 0.05), (900000, 0.10), (1200000, 0.15), (1500000, 0.20), (None, 0.30)]
OLD_SLABS = [(250000, 0.0), (500000, 0.05), (1000000, 0.20), (None, 0.30)]
DEDUCTION = 50000


def _slab_tax(x, slabs):
    out, low = F.lit(0.0), 0
    for high, rate in slabs:
        top = x if high is None else F.least(x, F.lit(high))
        out, low = out + F.greatest(top - low, F.lit(0)) * rate, high
    return out


def _slab_sql(slabs):
    ends = [0, *(h for h, _ in slabs[:-1])]
    return " + ".join(f"greatest({'x' if h is None else f'least(x, {h})'} - {low}, 0) * {rate}" for low, (h, rate) in zip(ends, slabs))


@query(
    "n19_cheaper_regime",
    f"WITH t AS (SELECT c_custkey, greatest(c_acctbal * 250 - {DEDUCTION}, 0) AS x FROM customer), r AS (SELECT c_custkey, round({_slab_sql(NEW_SLABS)}, 2)::DOUBLE AS new_tax, round({_slab_sql(OLD_SLABS)}, 2)::DOUBLE AS old_tax FROM t) SELECT c_custkey, new_tax, old_tax, CASE WHEN new_tax <= old_tax THEN 'new' ELSE 'old' END AS cheaper FROM r",
)
def _(t):
    x = t.customer.select("c_custkey", F.greatest(F.col("c_acctbal") * 250 - DEDUCTION, F.lit(0)).alias("x"))
    r = x.select("c_custkey", F.round(_slab_tax(F.col("x"), NEW_SLABS), 2).alias("new_tax"), F.round(_slab_tax(F.col("x"), OLD_SLABS), 2).alias("old_tax"))
    return r.select("c_custkey", "new_tax", "old_tax", F.when(F.col("new_tax") <= F.col("old_tax"), "new").otherwise("old").alias("cheaper"))


@query(
    "n21_known_numbers",
    r"""WITH c AS (SELECT conv_id, turn, unnest(list_transform(regexp_extract_all(regexp_replace(text, '\b[0-9]{4}-[0-9]{2}-[0-9]{2}\b', '', 'g'), '[0-9]+(?:\.[0-9]+)?'), lambda x: CAST(x AS DOUBLE))) AS v FROM conversations), k AS (SELECT DISTINCT p_retailprice AS f FROM part)
       SELECT conv_id, turn, count(*) AS claims, count(*) FILTER (EXISTS (SELECT 1 FROM k WHERE abs(f - v) <= greatest(0.6, 0.05 * abs(f)))) AS grounded FROM c GROUP BY 1, 2""",
)
def _(t):
    bare = F.regexp_replace("text", r"\b[0-9]{4}-[0-9]{2}-[0-9]{2}\b", "")
    claims = t.conversations.select("conv_id", "turn", F.explode(F.regexp_extract_all(bare, F.lit(r"[0-9]+(?:\.[0-9]+)?"), F.lit(0))).alias("v")).withColumn("v", F.col("v").cast("double"))
    values = claims.select("v").distinct()
    # Logarithmic bands of ten percent: a value and a finding within the tolerance are in the same band or the next.
    band = lambda c: F.floor(F.log(F.greatest(c, F.lit(1.0))) / 0.1)
    known = t.part.select(F.col("p_retailprice").alias("f")).distinct()
    known = known.select("f", F.explode(F.sequence(band(F.least(F.col("f") * 0.95, F.col("f") - 0.6)), band(F.greatest(F.col("f") * 1.05, F.col("f") + 0.6)))).alias("band"))
    close = F.abs(F.col("f") - F.col("v")) <= F.greatest(F.lit(0.6), 0.05 * F.abs("f"))
    met = values.withColumn("band", band(F.col("v"))).join(known, "band").where(close).select("v").distinct().withColumn("ok", F.lit(True))
    return claims.join(met, "v", "left").groupBy("conv_id", "turn").agg(F.count("*").alias("claims"), F.count("ok").alias("grounded"))


@query(
    "f6_alerts_with_bottleneck",
    """WITH o AS (SELECT *, o_orderstatus = 'P' AS late FROM orders WHERE o_orderstatus <> 'F'),
       a AS (SELECT 'breach' AS type, CAST(o_orderkey AS VARCHAR) AS subject, CAST(o_custkey AS BIGINT) AS n FROM o WHERE late ORDER BY o_orderdate, o_orderkey, o_custkey LIMIT 5),
       b AS (SELECT 'overloaded', CAST(o_custkey AS VARCHAR), count(*) FROM o GROUP BY o_custkey HAVING count(*) >= 8 ORDER BY count(*) DESC, o_custkey LIMIT 3),
       c AS (SELECT 'bottleneck', c_mktsegment, count(*) FILTER (late) FROM o JOIN customer ON c_custkey = o_custkey GROUP BY c_mktsegment HAVING count(*) >= 5 ORDER BY CAST(count(*) FILTER (late) AS DOUBLE) / count(*) DESC, c_mktsegment LIMIT 1)
       SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c""",
)
def _(t):
    # Five, three and one are the bundle's own limits.
    o = t.orders.where("o_orderstatus <> 'F'").withColumn("late", F.col("o_orderstatus") == "P")
    breach = o.where("late").orderBy("o_orderdate", "o_orderkey", "o_custkey").limit(5).select(F.lit("breach").alias("type"), F.col("o_orderkey").cast("string").alias("subject"), F.col("o_custkey").alias("n"))
    load = o.groupBy("o_custkey").agg(F.count("*").alias("n")).where("n >= 8").orderBy(F.desc("n"), "o_custkey").limit(3).select(F.lit("overloaded").alias("type"), F.col("o_custkey").cast("string").alias("subject"), "n")
    per = o.join(t.customer, F.col("c_custkey") == F.col("o_custkey")).groupBy("c_mktsegment").agg(F.count("*").alias("all"), F.count_if("late").alias("n")).where("all >= 5")
    worst = per.orderBy(F.desc(F.col("n") / F.col("all")), "c_mktsegment").limit(1).select(F.lit("bottleneck").alias("type"), F.col("c_mktsegment").alias("subject"), "n")
    return breach.unionByName(load).unionByName(worst)


@query(
    "u1_intake_derived",
    """WITH x AS (SELECT o_orderkey, o_custkey, o_totalprice, CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE date_diff('day', DATE '1998-01-01', CAST(o_orderdate AS DATE)) END AS due FROM orders WHERE o_custkey % 11 <> 0), y AS (SELECT *, coalesce(due, 7) AS d FROM x)
       SELECT 'T-' || lpad(CAST(row_number() OVER (ORDER BY o_orderkey, o_custkey, o_totalprice) AS VARCHAR), 7, '0') AS task_id, o_orderkey, CAST(d AS INTEGER) AS due_in, CAST(greatest(d, 1) AS INTEGER) AS tat, CASE WHEN d < 0 THEN 'Breached' WHEN d < 3 THEN 'AtRisk' ELSE 'OnTrack' END AS sla, CASE WHEN d < 0 THEN 'High' WHEN d < 3 THEN 'Medium' ELSE 'Low' END AS delay_risk FROM y""",
)
def _(t):
    good = t.orders.where("o_custkey % 11 <> 0")  # the others name no member and are rejected
    due = F.when(F.col("o_orderkey") % 10 != 0, F.datediff("o_orderdate", F.lit("1998-01-01").cast("date")))
    x = good.select("o_orderkey", "o_custkey", "o_totalprice", F.coalesce(due, F.lit(7)).alias("d"))
    # Running numbers without one window over all rows: each part of sorted rows is counted, then numbered from where the last one ended.
    parts = x.repartitionByRange("o_orderkey", "o_custkey", "o_totalprice").sortWithinPartitions("o_orderkey", "o_custkey", "o_totalprice")
    marked = parts.withColumn("place", F.monotonically_increasing_id()).withColumn("part", F.shiftright("place", 33))
    with_checkpoints(t.spark)
    marked = marked.checkpoint()
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    starts = marked.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    number = F.col("start") + F.col("place").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    d = F.col("d")
    sla, risk = (F.when(d < 0, a).when(d < 3, b).otherwise(c) for a, b, c in (("Breached", "AtRisk", "OnTrack"), ("High", "Medium", "Low")))
    out = marked.join(F.broadcast(starts), "part")
    return out.select(F.concat(F.lit("T-"), F.lpad(number.cast("string"), 7, "0")).alias("task_id"), "o_orderkey", d.alias("due_in"), F.greatest(d, F.lit(1)).alias("tat"), sla.alias("sla"), risk.alias("delay_risk"))


@query("u2_reassigned_with_audit", "SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN o_custkey + 1 ELSE o_custkey END AS member, CASE WHEN o_orderkey % 9 = 0 THEN o_custkey END AS was, CASE WHEN o_orderkey % 9 = 0 THEN 'batch' ELSE 'intake' END AS changed_by, o_orderkey % 9 = 0 AS changed FROM orders")
def _(t):
    change = t.orders.where("o_orderkey % 9 = 0").select("o_orderkey", "o_custkey", (F.col("o_custkey") + 1).alias("to"), F.lit("batch").alias("by")).distinct()
    x = t.orders.join(change, ["o_orderkey", "o_custkey"], "left")
    moved = F.col("to").isNotNull()
    return x.select("o_orderkey", F.coalesce("to", "o_custkey").alias("member"), F.when(moved, F.col("o_custkey")).alias("was"), F.coalesce("by", F.lit("intake")).alias("changed_by"), moved.alias("changed"))


@query("u3_escalated_with_note", "SELECT o_orderkey, o_custkey, CASE WHEN o_orderstatus = 'P' AND o_orderkey % 4 = 0 THEN 'E' ELSE o_orderstatus END AS status, o_orderpriority || CASE WHEN o_orderstatus = 'P' AND o_orderkey % 4 = 0 THEN ' | escalated from P' ELSE '' END AS notes FROM orders")
def _(t):
    up = (F.col("o_orderstatus") == "P") & (F.col("o_orderkey") % 4 == 0)
    note = F.when(up, F.concat(F.lit(" | escalated from "), "o_orderstatus")).otherwise("")
    return t.orders.select("o_orderkey", "o_custkey", F.when(up, "E").otherwise(F.col("o_orderstatus")).alias("status"), F.concat("o_orderpriority", note).alias("notes"))


@query("b8_both_shapes", "SELECT 'full' AS shape, count(*) AS n, sum(length(c_name)) AS chars, sum(c_nationkey) AS nations, CAST(sum(CAST(c_acctbal AS DECIMAL(18,2))) AS DOUBLE) AS pay FROM customer UNION ALL SELECT 'directory', count(*), sum(length(c_name)), sum(c_nationkey), NULL FROM customer")
def _(t):
    shapes = {"full": ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"], "directory": ["c_custkey", "c_name", "c_nationkey"]}
    out = None
    for name, columns in shapes.items():
        x = t.customer.select(*columns)
        pay = F.sum(F.col("c_acctbal").cast("decimal(18,2)")).cast("double") if "c_acctbal" in columns else F.lit(None).cast("double")
        row = x.agg(F.lit(name).alias("shape"), F.count("*").alias("n"), F.sum(F.length("c_name")).alias("chars"), F.sum("c_nationkey").alias("nations"), pay.alias("pay"))
        out = row if out is None else out.unionByName(row)
    return out
