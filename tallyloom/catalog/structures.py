"""Scores of tables, pages of boxes, outlines, versions of overrides, and staffing: whole rules over the supplied tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyloom.catalog.bills import _items
from tallyloom.catalog.registry import query
from tallyloom.operators import aggregates
from tallyloom.plans import layout, overrides, schedule, scores
from tallyloom.sources.shared import shared_folder

_READ = """WITH RECURSIVE items AS (SELECT l_orderkey AS doc, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS i, CAST(l_extendedprice AS DECIMAL(18,2)) AS amount, CAST(l_quantity AS INTEGER) AS qty FROM lineitem),
       gold AS (SELECT doc, CAST(i AS BIGINT) AS row, 0 AS col, 'Item ' || i AS raw FROM items UNION ALL SELECT doc, i, 1, CAST(qty AS VARCHAR) FROM items UNION ALL SELECT doc, i, 2, CAST(amount AS VARCHAR) FROM items
         UNION ALL SELECT doc, 0, c, h FROM (SELECT DISTINCT doc FROM items), (VALUES (0, 'Item'), (1, 'Qty'), (2, 'Amount')) AS v(c, h)),
       said AS (SELECT doc, CASE WHEN doc % 5 = 0 AND row > 0 THEN row + 1 ELSE row END AS row, CASE WHEN doc % 8 = 3 THEN col + 1 ELSE col END AS col,
           CASE WHEN row = 0 AND col = 1 AND doc % 6 = 0 THEN 'Qnty' WHEN row > 0 AND col = 1 AND (doc + row) % 7 = 0 THEN CAST(CAST(raw AS INTEGER) + 100 AS VARCHAR) WHEN row > 0 AND col = 2 AND (doc + row) % 4 = 0 THEN CAST(CAST(CAST(raw AS DECIMAL(18,2)) + 1 AS DECIMAL(18,2)) AS VARCHAR)
             WHEN col = 0 AND doc % 3 = 0 THEN upper(raw) || ' ' ELSE raw END AS raw FROM gold WHERE NOT (row > 0 AND col = 1 AND (doc + row) % 9 = 0)),
"""
_NUMBER = "TRY_CAST(regexp_extract(raw, '-?[0-9]+\\.[0-9]+|-?[0-9]+') AS DOUBLE)"
#: The two cursors of a bag match within a tolerance, one value a step.
_CURSORS = """seq AS (SELECT key, v, side, row_number() OVER (PARTITION BY key ORDER BY v, side) AS turn FROM ({values})),
       walk AS (SELECT key, 0 AS turn, CAST([] AS DOUBLE[]) AS oa, CAST([] AS DOUBLE[]) AS ob, 0 AS m, 0 AS na, 0 AS nb FROM (SELECT DISTINCT key FROM seq)
         UNION ALL SELECT key, turn, CASE WHEN side = 0 AND len(fb) = 0 THEN list_append(oa, v) WHEN side = 0 THEN oa ELSE fa[2:] END, CASE WHEN side = 1 AND len(fa) = 0 THEN list_append(ob, v) WHEN side = 1 THEN ob ELSE fb[2:] END,
           m + CASE WHEN (side = 0 AND len(fb) > 0) OR (side = 1 AND len(fa) > 0) THEN 1 ELSE 0 END, na + 1 - side, nb + side
         FROM (SELECT s.*, oa, ob, m, na, nb, list_filter(oa, lambda x: s.v - x <= {tolerance}) AS fa, list_filter(ob, lambda x: s.v - x <= {tolerance}) AS fb FROM walk w JOIN seq s ON s.key = w.key AND s.turn = w.turn + 1)),
       paired AS (SELECT key, max(na) AS n_a, max(nb) AS n_b, max(m) AS matched FROM walk GROUP BY 1)"""
_TOKEN = f"CASE WHEN {_NUMBER} IS NOT NULL THEN 'n' || round({_NUMBER}, 2) ELSE 't' || lower(trim(raw)) END"
_SCORES = (
    _READ
    + _CURSORS.format(values=f"SELECT doc AS key, {_NUMBER} AS v, 0 AS side FROM said WHERE {_NUMBER} IS NOT NULL UNION ALL SELECT doc, {_NUMBER}, 1 FROM gold WHERE {_NUMBER} IS NOT NULL", tolerance="0.005 * greatest(abs(s.v), abs(x), 1.0)")
    + f""", texts AS (SELECT doc, sum(least(a, b)) AS matched FROM (SELECT doc, lower(trim(raw)) AS t, count(*) AS a FROM said WHERE {_NUMBER} IS NULL GROUP BY 1, 2) JOIN (SELECT doc, lower(trim(raw)) AS t, count(*) AS b FROM gold WHERE {_NUMBER} IS NULL GROUP BY 1, 2) USING (doc, t) GROUP BY 1),
       held AS (SELECT 's' AS side, doc, row, col, raw, {_TOKEN} AS token FROM said UNION ALL SELECT 'g', doc, row, col, raw, {_TOKEN} FROM gold),
       row_keys AS (SELECT side, doc, row, list_sort(list(token)) AS k FROM held GROUP BY 1, 2, 3), col_keys AS (SELECT side, doc, col, list_sort(list(token)) AS k FROM held GROUP BY 1, 2, 3),
       row_hits AS (SELECT g.doc, CAST(sum(least(gn, coalesce(sn, 0))) AS DOUBLE) / sum(gn) AS row_accuracy FROM (SELECT doc, k, count(*) AS gn FROM row_keys WHERE side = 'g' GROUP BY 1, 2) g LEFT JOIN (SELECT doc, k, count(*) AS sn FROM row_keys WHERE side = 's' GROUP BY 1, 2) s ON g.doc = s.doc AND g.k = s.k GROUP BY 1),
       col_hits AS (SELECT g.doc, CAST(sum(least(gn, coalesce(sn, 0))) AS DOUBLE) / sum(gn) AS col_accuracy FROM (SELECT doc, k, count(*) AS gn FROM col_keys WHERE side = 'g' GROUP BY 1, 2) g LEFT JOIN (SELECT doc, k, count(*) AS sn FROM col_keys WHERE side = 's' GROUP BY 1, 2) s ON g.doc = s.doc AND g.k = s.k GROUP BY 1),
       places AS (SELECT coalesce(s.doc, g.doc) AS doc, coalesce(s.row, g.row) AS row, s.raw AS sr, g.raw AS gr, s.n AS sn, g.n AS gn FROM (SELECT doc, row, col, raw, {_NUMBER} AS n FROM said) s FULL JOIN (SELECT doc, row, col, raw, {_NUMBER} AS n FROM gold) g ON s.doc = g.doc AND s.row = g.row AND s.col = g.col),
       hits AS (SELECT *, sr IS NOT NULL AND gr IS NOT NULL AND CASE WHEN sn IS NOT NULL AND gn IS NOT NULL THEN abs(sn - gn) <= 0.005 * greatest(abs(sn), abs(gn), 1.0) ELSE lower(trim(sr)) = lower(trim(gr)) END AS hit FROM places),
       p AS (SELECT doc, count(sr) AS n_said, count(gr) AS n_gold, CAST(count(*) FILTER (hit) AS DOUBLE) AS h, count(*) AS places, CAST(count(sr) FILTER (row = 0) AS DOUBLE) AS hs, CAST(count(gr) FILTER (row = 0) AS DOUBLE) AS hg, CAST(count(*) FILTER (hit AND row = 0) AS DOUBLE) AS hh FROM hits GROUP BY 1),
       shapes AS (SELECT doc, max(row) FILTER (side = 's') AS rs, max(row) FILTER (side = 'g') AS rg, max(col) FILTER (side = 's') AS cs, max(col) FILTER (side = 'g') AS cg FROM held GROUP BY 1),
       parts AS (SELECT p.doc, n_gold, n_said, CAST(coalesce(texts.matched, 0) + coalesce(paired.matched, 0) AS DOUBLE) AS m, h, places, hs, hg, hh, row_accuracy, col_accuracy, rs, rg, cs, cg FROM p LEFT JOIN texts USING (doc) LEFT JOIN paired ON paired.key = p.doc JOIN row_hits USING (doc) JOIN col_hits USING (doc) JOIN shapes USING (doc)),
       shares AS (SELECT *, m / n_said AS cp, m / n_gold AS cr, h / n_said AS pp, h / n_gold AS pr, hh / hs AS hp, hh / hg AS hr FROM parts),
       scored AS (SELECT doc, n_gold, n_said, cp AS content_precision, cr AS content_recall, CASE WHEN cp + cr > 0 THEN 2 * cp * cr / (cp + cr) ELSE 0 END AS content_f1, CASE WHEN pp + pr > 0 THEN 2 * pp * pr / (pp + pr) ELSE 0 END AS positional_f1, row_accuracy, col_accuracy,
         CASE WHEN hp + hr > 0 THEN 2 * hp * hr / (hp + hr) ELSE 0 END AS header_accuracy, rs = rg AND cs = cg AS shape_exact, abs(rs - rg) <= 1 AND abs(cs - cg) <= 1 AS shape_near, h / places AS structure, greatest(cr - pr, 0.0) AS misplacement FROM shares)"""
)


def _gold(t):
    items = _items(t).select("doc", F.col("i").cast("long").alias("row"), "amount", "qty")
    cells = F.array(*(F.struct(F.lit(c).alias("col"), v.alias("raw")) for c, v in enumerate((F.concat(F.lit("Item "), F.col("row").cast("string")), F.col("qty").cast("string"), F.col("amount").cast("string")))))
    heads = F.array(*(F.struct(F.lit(c).alias("col"), F.lit(h).alias("raw")) for c, h in enumerate(("Item", "Qty", "Amount"))))
    body = items.select("doc", "row", F.explode(cells).alias("c")).select("doc", "row", "c.*")
    return body.unionByName(items.select("doc").distinct().select("doc", F.lit(0).cast("long").alias("row"), F.explode(heads).alias("c")).select("doc", "row", "c.*"))


def _said(t):
    row, col, doc, raw = F.col("row"), F.col("col"), F.col("doc"), F.col("raw")
    body, place = row > 0, doc + row
    read = F.when((row == 0) & (col == 1) & (doc % 6 == 0), "Qnty").when(body & (col == 1) & (place % 7 == 0), (raw.try_cast("int") + 100).cast("string"))
    read = read.when(body & (col == 2) & (place % 4 == 0), (raw.try_cast("decimal(18,2)") + 1).cast("decimal(18,2)").cast("string")).when((col == 0) & (doc % 3 == 0), F.concat(F.upper(raw), F.lit(" "))).otherwise(raw)
    kept = _gold(t).where(~(body & (col == 1) & (place % 9 == 0)))
    return kept.select("doc", F.when((doc % 5 == 0) & body, row + 1).otherwise(row).alias("row"), F.when(doc % 8 == 3, col + 1).otherwise(col).alias("col"), read.alias("raw"))


@query("v22_table_scores", _SCORES + " SELECT * FROM scored")
def _(t):
    return scores.table_scores(_said(t), _gold(t))


_WEIGHTED = ", ".join(f"CAST(sum(CAST({c} AS DECIMAL(12,9)) * n_gold) AS DOUBLE) / sum(n_gold) AS {c}" for c in ("content_precision", "content_recall", "content_f1", "positional_f1", "structure", "misplacement"))
_PLAIN = ", ".join(f"CAST(sum(CAST({c} AS DECIMAL(12,9))) AS DOUBLE) / count(*) AS {c}" for c in ("row_accuracy", "col_accuracy", "header_accuracy"))


@query("v22_corpus_scores", _SCORES + f" SELECT count(*) AS tables, sum(n_gold) AS gold_cells, {_WEIGHTED}, {_PLAIN}, CAST(count(*) FILTER (shape_exact) AS DOUBLE) / count(*) AS shape_exact_rate FROM scored")
def _(t):
    return scores.corpus_scores(scores.table_scores(_said(t), _gold(t)))


@query(
    "c11_pairs_within",
    "WITH RECURSIVE "
    + _CURSORS.format(
        values="SELECT o_custkey AS key, floor(o_totalprice / 2000) AS v, 0 AS side FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT o_custkey, floor(o_totalprice / 2000) + (o_orderkey * 37) % 7 - 3, 1 FROM orders WHERE o_orderkey % 3 > 0", tolerance="4.0"
    )
    + " SELECT key AS o_custkey, n_a, n_b, matched FROM paired",
)
def _(t):
    price = F.floor(F.col("o_totalprice") / 2000)
    a = t.orders.where("o_orderkey % 2 = 0").select("o_custkey", price.alias("v"))
    b = t.orders.where("o_orderkey % 3 > 0").select("o_custkey", (price + (F.col("o_orderkey") * 37) % 7 - 3).alias("v"))
    return scores.paired_within(a, b, ["o_custkey"], "v", absolute=4.0)


#: A customer's lines as boxes of a page of 600: two columns on most pages, headings, tables, headers and footers among them.
_BOXES = """WITH l AS (SELECT o_custkey AS page, row_number() OVER (PARTITION BY o_custkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS pos, l_partkey AS p, l_suppkey AS s, l_quantity AS q FROM lineitem JOIN (SELECT o_orderkey, min(o_custkey) AS o_custkey FROM orders GROUP BY 1) ON l_orderkey = o_orderkey),
       b AS (SELECT page, pos, CASE WHEN pos % 11 = 1 THEN 'header' WHEN pos % 11 = 2 THEN 'footer' WHEN (p + s) % 17 = 0 THEN 'heading' WHEN (p + s) % 17 = 1 THEN 'table' WHEN (p + s) % 17 < 6 THEN 'list_item' ELSE 'paragraph' END AS type,
           CASE WHEN page % 3 = 0 THEN 40.0 WHEN p % 2 = 0 THEN 40.0 + q % 9 ELSE 320.0 + q % 9 END AS x0, CASE WHEN page % 3 = 0 THEN 540.0 WHEN p % 2 = 0 THEN 280.0 ELSE 560.0 END AS x1, CAST((s * 37 + p * 13) % 700 AS DOUBLE) AS y0 FROM l)"""


def _boxes(t):
    orders = t.orders.groupBy("o_orderkey").agg(F.min("o_custkey").alias("page"))
    own = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity"]
    lines = t.lineitem.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).withColumn("pos", F.row_number().over(Window.partitionBy("page").orderBy(*own)))
    pos, mixed, left, single = F.col("pos"), (F.col("l_partkey") + F.col("l_suppkey")) % 17, F.col("l_partkey") % 2 == 0, F.col("page") % 3 == 0
    kind = F.when(pos % 11 == 1, "header").when(pos % 11 == 2, "footer").when(mixed == 0, "heading").when(mixed == 1, "table").when(mixed < 6, "list_item").otherwise("paragraph")
    x0 = F.when(single, 40.0).when(left, 40.0 + F.col("l_quantity") % 9).otherwise(320.0 + F.col("l_quantity") % 9)
    x1 = F.when(single, 540.0).when(left, 280.0).otherwise(560.0)
    return lines.select("page", "pos", kind.alias("type"), x0.alias("x0"), x1.alias("x1"), ((F.col("l_suppkey") * 37 + F.col("l_partkey") * 13) % 700).cast("double").alias("y0"))


@query(
    "e14_page_order",
    _BOXES
    + """, t AS (SELECT *, max(x1) OVER (PARTITION BY page ORDER BY x0, x1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM b WHERE type IN ('paragraph', 'list_item')),
       g AS (SELECT page, (x0 + reach) / 2 AS m FROM t WHERE x0 - reach > 1 AND x0 - reach >= 30), n AS (SELECT page, count(*) AS k FROM g GROUP BY 1),
       c AS (SELECT b.*, CASE type WHEN 'header' THEN 0 WHEN 'footer' THEN 2 ELSE 1 END AS part, CASE WHEN type IN ('header', 'footer') OR k IS NULL THEN 0 WHEN x1 - x0 > 360 OR type IN ('table', 'figure', 'heading') THEN -1
           ELSE (SELECT count(*) FROM g WHERE g.page = b.page AND g.m <= (b.x0 + b.x1) / 2) END AS col FROM b LEFT JOIN n USING (page)),
       d AS (SELECT *, coalesce(count(*) FILTER (col = -1) OVER (PARTITION BY page, part ORDER BY y0, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS band FROM c)
       SELECT page, pos, col AS "column", band, row_number() OVER (PARTITION BY page ORDER BY part, band, col = -1, col, y0, pos) AS place FROM d""",
)
def _(t):
    return layout.reading_order(_boxes(t), "page", 600.0).select("page", "pos", "column", "band", "place")


_HEADS = """SELECT l_suppkey AS doc, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity) AS pos, l_linenumber AS n, l_partkey AS p FROM lineitem"""


@query(
    "v24_numbering_audit",
    f"""WITH h AS ({_HEADS}), x AS (SELECT doc, pos, p, p % 4 + 1 + CASE WHEN p % 5 = 0 THEN 1 ELSE 0 END AS level, CASE WHEN p % 4 = 0 THEN [pos // 10 + 1] WHEN p % 4 = 1 THEN [pos // 10 + 1, n] WHEN p % 4 = 2 THEN [pos // 10 + 1, n, p % 12] END AS parts FROM h),
       y AS (SELECT *, last_value(parts IGNORE NULLS) OVER (PARTITION BY doc ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before, lag(level) OVER (PARTITION BY doc ORDER BY pos) AS above FROM x)
       SELECT doc, count(*) AS headings, count(*) FILTER (len(parts) >= 2 AND level <> len(parts)) AS wrong_level, count(*) FILTER (parts IS NOT NULL AND p % 3 = 0) AS number_only,
         count(*) FILTER (parts <= before) AS out_of_order, count(*) FILTER (level > above + 1) AS skipped FROM y GROUP BY 1""",
)
def _(t):
    p, n = F.col("l_partkey"), F.col("l_linenumber")
    order = Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity")
    lines = t.lineitem.withColumn("pos", F.row_number().over(order))
    chapter = F.floor(F.col("pos") / 10) + 1
    dotted = lambda *parts: F.concat_ws(".", *(x.cast("string") for x in parts))
    number = F.when(p % 4 == 0, dotted(chapter)).when(p % 4 == 1, dotted(chapter, n)).when(p % 4 == 2, dotted(chapter, n, p % 12))
    level = p % 4 + 1 + (p % 5 == 0).cast("int")
    heads = lines.select(F.col("l_suppkey").alias("doc"), "pos", number.alias("number"), level.alias("level"), F.when(p % 3 == 0, F.coalesce(number, F.lit("Scope"))).otherwise("Scope of work").alias("text"))
    return layout.heading_audit(heads, "doc", "pos", "number", "level", "text")


@query(
    "v31_versions",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 40 = 7 THEN 5.0 WHEN o_orderkey % 20 = 7 THEN 1.0 ELSE o_totalprice END AS o_totalprice, CASE WHEN o_orderkey % 40 = 7 THEN 3 WHEN o_orderkey % 20 = 7 THEN 2 ELSE 1 END AS version, o_totalprice AS original,
         CASE WHEN o_orderkey % 40 = 7 THEN 'second' WHEN o_orderkey % 20 = 7 THEN 'first' END AS approved_by, CASE WHEN o_orderkey % 20 = 7 THEN 'sheet ' || o_custkey % 3 END AS source, 3 AS table_version FROM orders""",
)
def _(t):
    table = overrides.VersionedTable(t.spark, f"{shared_folder(t.spark)}/overrides-{uuid.uuid4().hex}", "o_orderkey", "o_totalprice")
    table.begin(t.orders.select("o_orderkey", "o_totalprice"))
    said = t.orders.select("o_orderkey", F.concat(F.lit("sheet "), (F.col("o_custkey") % 3).cast("string")).alias("source"))
    first = said.where("o_orderkey % 20 = 7").withColumns({"o_totalprice": F.lit(1.0), "approved_by": F.lit("first")})
    second = said.where("o_orderkey % 40 = 7").withColumns({"o_totalprice": F.lit(5.0), "approved_by": F.lit("second")})
    # Applied again, the same approvals change nothing and make no version.
    for approved in (first, first, second, second):
        last = table.apply(approved)
    return table.read().drop("part").withColumn("table_version", F.lit(last))


@query(
    "k5_ordered_outline",
    """WITH x AS (SELECT c_custkey, n_regionkey || '.' || c_nationkey AS parent, c_mktsegment AS name, c_acctbal AS s FROM customer JOIN nation ON c_nationkey = n_nationkey),
       leaf AS (SELECT parent || '.' || lpad(CAST(row_number() OVER (PARTITION BY parent, name ORDER BY c_custkey) AS VARCHAR), 4, '0') AS wbs, name, FALSE AS is_summary, s AS start, s AS finish, c_custkey AS pos, parent FROM x),
       first AS (SELECT parent, arg_min(name, c_custkey) AS name FROM x GROUP BY 1),
       sums AS (SELECT parent AS wbs, first.name, TRUE AS is_summary, min(s) AS start, max(s) AS finish FROM x JOIN first USING (parent, name) GROUP BY 1, 2),
       every AS (SELECT wbs, name, is_summary, start, finish, -1 AS pos FROM sums UNION ALL SELECT wbs, name, is_summary, start, finish, pos FROM leaf)
       SELECT split_part(wbs, '.', 1) AS package, wbs, name, is_summary, start, finish, row_number() OVER (PARTITION BY split_part(wbs, '.', 1) ORDER BY wbs, is_summary DESC, pos) AS id FROM every""",
)
def _(t):
    joined = t.customer.join(F.broadcast(t.nation), F.col("c_nationkey") == F.col("n_nationkey"))
    tasks = joined.select(
        F.col("n_regionkey").cast("string").alias("package"), F.concat_ws(".", F.col("n_regionkey").cast("string"), F.col("c_nationkey").cast("string")).alias("wbs"), F.col("c_mktsegment").alias("name"), F.col("c_custkey").alias("pos"), F.col("c_acctbal").alias("start"), F.col("c_acctbal").alias("finish")
    )
    return schedule.ordered_outline(tasks).select("package", "wbs", "name", "is_summary", "start", "finish", "id")


_STAFF = """WITH d AS (SELECT c_nationkey AS org, c_mktsegment AS zone, count(*) AS posts, count(*) FILTER (c_acctbal > 500) AS filled FROM customer GROUP BY 1, 2),
       o AS (SELECT org, CAST(sum(posts) AS BIGINT) AS sanctioned, CAST(sum(filled) AS BIGINT) AS headcount, CAST(sum(greatest(posts - filled, 0)) AS BIGINT) AS vacancies FROM d GROUP BY 1),
       z AS (SELECT org, zone, filled FROM d QUALIFY row_number() OVER (PARTITION BY org ORDER BY filled, zone) = 1),
       short AS (SELECT org, sanctioned, headcount, vacancies, floor(CAST(vacancies AS DOUBLE) / sanctioned * 1000 + 0.5) / 10 AS rate FROM o WHERE org % 2 = 0 AND sanctioned >= 10),
       pool AS (SELECT coalesce(CAST(sum(greatest(headcount - floor(headcount * 0.8 + 0.5), 0)) AS BIGINT), 0) AS pool FROM o WHERE org % 2 = 1),
       days AS (SELECT CAST(ts AS DATE) AS day, sum(CAST(value AS DECIMAL(18,2))) AS mm FROM events GROUP BY 1),
       rain AS (SELECT CAST(max(mm) AS DOUBLE) / 1000 AS most FROM days WHERE day > (SELECT max(day) FROM days) - 7)"""


@query(
    "x7_redeployment",
    _STAFF
    + """, turn AS (SELECT *, coalesce(sum(vacancies) OVER (ORDER BY rate DESC, org ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM short WHERE rate > 5)
       SELECT org, sanctioned, headcount, vacancies, rate, zone, filled AS zone_headcount, pool, CAST(greatest(least(vacancies, pool - before), 0) AS BIGINT) AS allocated,
         CASE WHEN most <= 2.4 THEN 'No Rain' WHEN most <= 15.5 THEN 'Light Rain' WHEN most <= 64.4 THEN 'Moderate Rain' WHEN most <= 115.5 THEN 'Heavy Rain' ELSE 'Very Heavy Rain' END AS band, most > 15.5 AS alert
       FROM turn JOIN z USING (org), pool, rain""",
)
def _(t):
    posts = t.customer.groupBy(F.col("c_nationkey").alias("org"), F.col("c_mktsegment").alias("zone")).agg(F.count("*").alias("posts"), F.count_if(F.col("c_acctbal") > 500).alias("filled"))
    daily = t.events.groupBy(F.to_date("ts").alias("day")).agg((F.sum(F.col("value").cast("decimal(18,2)")).cast("double") / 1000).alias("mm"))
    return aggregates.redeployment(posts, daily, high=F.col("org") % 2 == 0, low=F.col("org") % 2 == 1)
