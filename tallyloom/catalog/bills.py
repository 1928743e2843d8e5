"""Verification of bills, labels and labelled fields: bills are orders' lines with sub-totals and totals put in.

Of a bill's lines, some are dropped or misread by a rule of their numbers; what is stated stands for all of them.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyloom.catalog.registry import query
from tallyloom.functions import labels
from tallyloom.functions.text import VERHOEFF_D, VERHOEFF_P
from tallyloom.operators import windows
from tallyloom.plans import bills, verify
from tallyloom.sources.shared import in_parts

_ITEMS = """WITH items AS (SELECT l_orderkey AS doc, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS i, count(*) OVER (PARTITION BY l_orderkey) AS n,
         CAST(l_extendedprice AS DECIMAL(18,2)) AS amount, CAST(l_quantity AS INTEGER) AS qty FROM lineitem),
       kept AS (SELECT *, (doc + i) % 13 = 0 AS misread, (doc + i) % 17 = 0 AS merged FROM items WHERE (doc + i) % 11 <> 0),
       st AS (SELECT doc, max(n) AS n, sum(amount) FILTER (i <= 2) AS sub, sum(amount) AS total FROM items GROUP BY 1),
       kp AS (SELECT doc, coalesce(sum(amount) FILTER (i <= 2), 0) AS a, count(*) FILTER (i <= 2) AS na, coalesce(sum(amount) FILTER (i > 2), 0) AS b, count(*) FILTER (i > 2) AS nb, count(*) AS nk FROM kept GROUP BY 1),
       tied AS (SELECT doc, 'subtotal' AS kind, sub AS stated, a AS base, na AS n, na > 0 AND sub >= 1000 AND sub >= 0.5 * a AND a >= 0.5 * sub AND abs(sub - a) > greatest(1, ceil(greatest(na, 1) * 0.5)) AS flagged FROM st JOIN kp USING (doc) WHERE st.n >= 3 AND doc % 7 <> 0
         UNION ALL SELECT doc, 'total', total, CASE WHEN st.n >= 3 THEN sub + b ELSE a + b END, CASE WHEN st.n >= 3 THEN 1 + nb ELSE nk END,
           (st.n >= 3 OR nk > 0) AND total >= 1000 AND total >= 0.5 * (CASE WHEN st.n >= 3 THEN sub + b ELSE a + b END) AND abs(total - (CASE WHEN st.n >= 3 THEN sub + b ELSE a + b END)) > greatest(1, ceil(greatest(CASE WHEN st.n >= 3 THEN 1 + nb ELSE nk END, 1) * 0.5)) FROM st JOIN kp USING (doc) WHERE doc % 7 <> 0)"""


def _items(t):
    # Lines get their bill's name before they are dealt, so that what follows knows they are dealt by it.
    w = Window.partitionBy("doc")
    order = w.orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    lines = in_parts(t.lineitem.select(F.col("l_orderkey").alias("doc"), "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity"), "doc")
    return lines.select("doc", F.row_number().over(order).alias("i"), F.count("*").over(w).alias("n"), F.col("l_extendedprice").cast("decimal(18,2)").alias("amount"), F.col("l_quantity").cast("int").alias("qty"))


def _kept(t):
    place = F.col("doc") + F.col("i")
    return _items(t).where(place % 11 != 0).withColumns({"misread": place % 13 == 0, "merged": place % 17 == 0})


#: Fixed value: the labels of what a bill states.
_SUB, _GRAND = "Sub-Total (A)", "Grand Total"


def _rows(t):
    """(doc, pos, label, amount, value): the kept lines, a sub-total after the second of three or more, and a total; one bill in seven states none.

    A second column, "value", ties out in every third bill.  A bill's lines are numbered and added up where they were
    dealt once; its second and last line bring the sums along.  Bills of which no line is left are no tables.
    """
    bill = Window.partitionBy("doc")
    amount, early = F.col("amount"), F.col("i") <= 2
    kept = F.coalesce((F.col("doc") + F.col("i")) % 11 != 0, F.lit(False))
    lines = _items(t).select("doc", "i", "n", "amount", kept.alias("kept"))
    of = lambda c: F.sum(F.when(c, amount)).over(bill)
    sums = {"sub": of(early), "total": F.sum("amount").over(bill), "a": of(F.col("kept") & early), "b": F.coalesce(of(F.col("kept") & ~early), F.lit(0)), "all": of(F.col("kept")), "some": F.max("kept").over(bill)}
    added = lines.withColumns(sums)
    states = (F.col("doc") % 7 != 0) & F.col("some")
    has_sub = states & (F.col("n") >= 3) & F.col("sub").isNotNull()
    money = lambda c: c.cast("decimal(18,2)")
    told = lambda right, c: money(F.when(F.col("doc") % 3 == 0, F.coalesce(right, c)).otherwise(c)).alias("value")
    row = lambda pos, label, c, value: F.struct(pos.cast("long").alias("pos"), F.lit(label).alias("label"), money(c).alias("amount"), value)
    line = F.when(F.col("kept"), row(F.col("i") * 10, "supply of item", amount, amount.alias("value")))
    sub = F.when(has_sub & (F.col("i") == 2), row(F.lit(25), _SUB, F.col("sub"), told(F.col("a"), F.col("sub"))))
    right = F.when(has_sub, F.coalesce("a", "sub") + F.col("b")).otherwise(F.col("all"))
    total = F.when(states & (F.col("i") == F.col("n")) & F.col("total").isNotNull(), row(F.lit(10**9), _GRAND, F.col("total"), told(right, F.col("total"))))
    return added.select("doc", F.explode(F.array(line, sub, total)).alias("x")).where("x IS NOT NULL").select("doc", "x.*")


@query("v5_section_totals", _ITEMS + " SELECT doc, kind, CAST(stated AS DOUBLE) AS stated, CAST(base AS DOUBLE) AS base, n, flagged FROM tied")
def _(t):
    return bills.anchors(_rows(t), ["doc"]).select("doc", "kind", F.col("stated").cast("double").alias("stated"), F.col("base").cast("double").alias("base"), "n", "flagged")


@query(
    "v6_column_rescue",
    _ITEMS
    + """ , f AS (SELECT doc, count(*) FILTER (flagged) AS flags FROM tied GROUP BY 1)
       SELECT doc, CASE WHEN flags > 0 AND doc % 2 = 0 AND doc % 3 = 0 THEN 0 ELSE flags END AS flags, CASE WHEN flags > 0 AND doc % 2 = 0 AND doc % 3 = 0 THEN 'value' ELSE 'amount' END AS by FROM f""",
)
def _(t):
    return _rescued(t)


def _rescued(t):
    """(doc, flags, by): the header of a bill's second column, "value", names it in every second one."""
    return bills.rescued(bills.column_anchors(_rows(t), ["doc"], ["amount", "value"]), "doc", "column", "amount", {"value": F.col("doc") % 2 == 0})


_GAPS = """, d AS (SELECT doc, i, i - lag(i) OVER (PARTITION BY doc ORDER BY i) AS d FROM kept), gs AS (SELECT doc, count(*) AS c, count(*) FILTER (d = 1) AS runs FROM d GROUP BY 1 HAVING count(*) >= 3 AND count(*) FILTER (d = 1) >= 0.6 * (count(*) - 1)),
       gaps AS (SELECT doc, i - d + 1 AS first_missing, i - 1 AS last_missing FROM d JOIN gs USING (doc) WHERE d > 1)"""


def _gaps(t):
    return windows.serial_gaps(_kept(t).select("doc", F.col("i").cast("long").alias("i")), "doc", "i")


@query("v9_serial_gaps", _ITEMS + _GAPS + " SELECT doc, first_missing, last_missing FROM gaps")
def _(t):
    return _gaps(t)


@query(
    "v10_union_of_flags",
    _ITEMS
    + _GAPS
    + """, ties AS (SELECT doc, count(*) FILTER (flagged) AS flags FROM tied GROUP BY 1), every AS (SELECT doc, 'tie_out' AS kind, flags AS n FROM ties WHERE flags > 0 AND NOT (doc % 2 = 0 AND doc % 3 = 0) UNION ALL SELECT doc, 'serial_gap', count(*) FROM gaps GROUP BY 1
         UNION ALL SELECT doc, 'row_arith', count(*) FROM kept WHERE misread AND doc % 7 <> 0 AND abs(amount) > greatest(1, 0.005 * abs(amount)) * qty GROUP BY 1
         UNION ALL SELECT doc, 'merged_cell', count(*) FROM kept WHERE merged AND (doc + i) % 34 <> 0 AND qty <> amount GROUP BY 1 UNION ALL SELECT doc, 'not_verified', 1 FROM kept WHERE doc % 7 = 0 GROUP BY doc HAVING count(*) >= 2 AND max(amount) >= 1000)
       SELECT doc, kind, n FROM every""",
)
def _(t):
    kept = _kept(t)
    ties = _rescued(t).select("doc", F.col("flags").alias("tie_out"))
    qty = F.col("qty") + F.col("misread").cast("int")
    # Bills without totals have no quantities to test rows by either.
    arith = (F.col("doc") % 7 != 0) & verify.row_mismatch(qty.cast("double"), F.col("amount").cast("double") / F.col("qty"), F.col("amount").cast("double"))
    cell = F.when(F.col("merged"), F.concat_ws(" ", F.when((F.col("doc") + F.col("i")) % 34 == 0, "part of lot"), F.col("qty").cast("string"), F.col("amount").cast("string"))).otherwise(F.col("amount").cast("string"))
    return bills.flag_counts(kept, "doc", "i", arith, verify.merged_numbers(cell), F.col("amount"), ties)


_SAID = """WITH gold AS (SELECT l_orderkey AS doc, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS i, CAST(l_quantity AS INTEGER) AS v FROM lineitem),
       said AS (SELECT doc, CASE WHEN doc % 5 = 0 THEN i + 1 ELSE i END AS i, CASE WHEN (doc + i) % 7 = 0 THEN v + 100 ELSE v END AS v FROM gold),"""


def _gold(t):
    return _items(t).select("doc", F.col("i"), F.col("qty").alias("v"))


def _misplaced():
    """Place and value of a line as they were read."""
    return F.when(F.col("doc") % 5 == 0, F.col("i") + 1).otherwise(F.col("i")), F.when((F.col("doc") + F.col("i")) % 7 == 0, F.col("v") + 100).otherwise(F.col("v"))


@query(
    "v22_content_scores",
    _SAID
    + """ a AS (SELECT doc, v, count(*) AS a FROM said GROUP BY 1, 2), b AS (SELECT doc, v, count(*) AS b FROM gold GROUP BY 1, 2),
       c AS (SELECT doc, sum(least(coalesce(a, 0), coalesce(b, 0))) AS m, sum(coalesce(a, 0)) AS said, sum(coalesce(b, 0)) AS gold FROM a FULL JOIN b USING (doc, v) GROUP BY 1),
       p AS (SELECT gold.doc, count(*) FILTER (said.v = gold.v) AS hits FROM gold LEFT JOIN said ON said.doc = gold.doc AND said.i = gold.i GROUP BY 1)
       SELECT doc, CAST(m AS DOUBLE) / said AS precision, CAST(m AS DOUBLE) / gold AS recall, 2.0 * CAST(m AS DOUBLE) / (said + gold) AS content_f1, 2.0 * CAST(hits AS DOUBLE) / (said + gold) AS positional_f1,
         round(2.0 * CAST(m AS DOUBLE) / (said + gold) - 2.0 * CAST(hits AS DOUBLE) / (said + gold), 9) AS misplacement FROM c JOIN p USING (doc)""",
)
def _(t):
    # A line gives what was said and its gold, so both sides are dealt by one step.
    side = lambda i, v, a: F.struct(i.alias("i"), v.alias("v"), F.lit(a).alias("__a"), F.lit(1 - a).alias("__b"))
    sides = _gold(t).select("doc", F.explode(F.array(side(*_misplaced(), 1), side(F.col("i"), F.col("v"), 0))).alias("s")).select("doc", "s.*")
    content = bills.content_scores(sides, ["doc"], "v")
    place = verify.place_scores(sides, ["doc", "i"], "v").select("doc", F.col("f1").alias("positional_f1"))
    both = content.join(place, "doc")
    return both.select("doc", "precision", "recall", F.col("f1").alias("content_f1"), "positional_f1", F.round(F.col("f1") - F.col("positional_f1"), 9).alias("misplacement"))


@query(
    "v23_misorder_warning",
    """WITH o AS (SELECT o_orderkey, any_value(o_custkey) AS doc FROM orders GROUP BY 1), k AS (SELECT doc, o_orderkey, row_number() OVER (PARTITION BY doc ORDER BY o_orderkey) AS j, count(*) OVER (PARTITION BY doc) AS n FROM o WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)),
       gold AS (SELECT doc, j, n, CAST(l_quantity AS INTEGER) AS v FROM k JOIN lineitem ON l_orderkey = o_orderkey), said AS (SELECT doc, CASE WHEN doc % 3 = 0 THEN j % n + 1 ELSE j END AS j, v FROM gold),
       a AS (SELECT doc, j, v, count(*) AS a FROM said GROUP BY 1, 2, 3), b AS (SELECT doc, j AS g, v, count(*) AS b FROM gold GROUP BY 1, 2, 3), na AS (SELECT doc, j, count(*) AS na FROM said GROUP BY 1, 2), nb AS (SELECT doc, j AS g, count(*) AS nb FROM gold GROUP BY 1, 2),
       s AS (SELECT na.doc, na.j, nb.g, 2.0 * CAST(coalesce((SELECT sum(least(a.a, b.b)) FROM a JOIN b ON a.v = b.v AND a.doc = b.doc WHERE a.doc = na.doc AND a.j = na.j AND b.g = nb.g), 0) AS DOUBLE) / (na.na + nb.nb) AS f FROM na JOIN nb ON na.doc = nb.doc),
       p AS (SELECT doc, j, max(f) AS best, max(f) FILTER (j = g) AS own FROM s GROUP BY 1, 2)
       SELECT doc, round(avg(own), 9) AS by_order, round(avg(best), 9) AS best, count(*) >= 2 AND avg(best) - avg(own) > 0.2 AS warned FROM p GROUP BY 1""",
)
def _(t):
    # Orders with lines are numbered by their lines, so each side is dealt by the order once and by the customer once.
    n_lines = t.lineitem.count()
    orders = in_parts(t.orders.select("o_orderkey", F.col("o_custkey").alias("doc")), "o_orderkey", rows=n_lines).groupBy("o_orderkey").agg(F.min("doc").alias("doc"))
    lines = orders.join(t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_quantity").cast("int").alias("v")), "o_orderkey")
    w = Window.partitionBy("doc")
    number = F.dense_rank().over(w.orderBy("o_orderkey")).cast("long")
    gold = in_parts(lines, "doc", rows=n_lines).select("doc", number.alias("j"), "v").withColumn("n", F.max("j").over(w))
    # A line gives what was said and its gold, so both sides are dealt by one step.
    said = F.when(F.col("doc") % 3 == 0, F.col("j") % F.col("n") + 1).otherwise(F.col("j"))
    side = lambda j, a: F.struct(j.alias("j"), F.col("v"), F.lit(a).alias("__a"), F.lit(1 - a).alias("__b"))
    sides = gold.select("doc", F.inline(F.array(side(said, 1), side(F.col("j"), 0))))
    return bills.misordered_sides(sides, "doc", "j", "v").select("doc", F.round("by_order", 9).alias("by_order"), F.round("best", 9).alias("best"), "warned")


@query("v26_uncertain_groups", "WITH x AS (SELECT o_custkey, o_orderkey, o_orderstatus AS s FROM orders WHERE o_orderstatus <> 'P'), y AS (SELECT o_custkey, o_orderkey - lag(o_orderkey) OVER w = 1 AND s = lag(s) OVER w AND NOT (o_orderkey - 1) % 4 = 0 AS goes_on FROM x WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)) SELECT o_custkey, count(*) AS fragments, count(*) FILTER (NOT coalesce(goes_on, false)) AS groups FROM y GROUP BY 1")
def _(t):
    # Uncertain fragments are those not settled; an order's number stands for the page, its status for the header.
    uncertain = t.orders.where("o_orderstatus <> 'P'").withColumn("ended", F.col("o_orderkey") % 4 == 0)
    found = verify.stitch(uncertain, "o_custkey", "o_orderkey", "o_orderstatus", "ended")
    return found.groupBy("o_custkey").agg(F.count("*").alias("fragments"), F.max("table_no").alias("groups"))


@query("v20_calibration_error", "WITH p AS (SELECT (o_orderkey % 100) / 100.0::DOUBLE AS c, o_orderstatus = 'F' AS wrong FROM orders), b AS (SELECT least(floor(c * 10), 9) AS bin, count(*) AS n, avg(c) AS m, avg(CAST(wrong AS INTEGER)) AS e FROM p GROUP BY 1) SELECT CAST(sum(n) AS BIGINT) AS n, round(sum(n * abs(m - (1 - e))) / sum(n), 9) AS ece FROM b")
def _(t):
    pairs = t.orders.select((F.col("o_orderkey") % 100 / 100).alias("c"), (F.col("o_orderstatus") == "F").alias("wrong"))
    return bills.calibration_error(verify.calibration(pairs, "c", "wrong")).select("n", F.round("ece", 9).alias("ece"))


_LABELS = "SELECT p_partkey, CASE p_partkey % 9 WHEN 0 THEN 'Grand Total' WHEN 1 THEN 'Sub-Total ' || p_size WHEN 2 THEN 'Total quantity of steel as per ' || p_type WHEN 3 THEN 'कुल ' || p_size WHEN 4 THEN 'Amount (' || p_size || ') in Rs' WHEN 5 THEN 'say Rs' WHEN 6 THEN 'Carried forward' WHEN 7 THEN 'a long row of words with योग ' || p_type ELSE p_type END AS label FROM part"


@query(
    "n3_bilingual_labels",
    # What each kind of label is, from how it was made.
    f"WITH l AS ({_LABELS}) SELECT p_partkey, label, p_partkey % 9 IN (0, 1, 3, 5) AS is_total, p_partkey % 9 IN (1, 4, 6) AS is_subtotal, p_partkey % 9 IN (0, 1, 2, 3, 4, 5, 7) AS names_a_total FROM l",
)
def _(t):
    size, k = F.col("p_size").cast("string"), F.col("p_partkey") % 9
    label = F.when(k == 0, "Grand Total").when(k == 1, F.concat(F.lit("Sub-Total "), size)).when(k == 2, F.concat(F.lit("Total quantity of steel as per "), F.col("p_type"))).when(k == 3, F.concat(F.lit("कुल "), size))
    label = label.when(k == 4, F.concat(F.lit("Amount ("), size, F.lit(") in Rs"))).when(k == 5, "say Rs").when(k == 6, "Carried forward").when(k == 7, F.concat(F.lit("a long row of words with योग "), F.col("p_type"))).otherwise(F.col("p_type"))
    x = t.part.select("p_partkey", label.alias("label"))
    return x.select("p_partkey", "label", labels.is_total(F.col("label")).alias("is_total"), labels.is_subtotal(F.col("label")).alias("is_subtotal"), labels.names_a_total(F.col("label")).alias("names_a_total"))


_LETTER = "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ', CAST(c_custkey % 26 + 1 AS INTEGER), 1)"
_PAN = f"'AB' || {_LETTER} || 'PQ' || lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0') || {_LETTER}"
_LETTERS = f"""SELECT c_custkey, c_name || CASE WHEN c_custkey % 3 = 0 THEN ' ref ' ELSE ' PAN: ' END || {_PAN} || ' GSTIN 27' || {_PAN} || '1Z' || substr('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ', CAST(c_custkey % 36 + 1 AS INTEGER), 1)
       || CASE WHEN c_custkey % 4 = 0 THEN '' ELSE ' IFSC HDFC0' || lpad(CAST(c_custkey % 1000000 AS VARCHAR), 6, '0') END || ' uid 2345 ' || lpad(CAST(c_custkey * 7 % 10000 AS VARCHAR), 4, '0') || '-' || lpad(CAST(c_custkey * 31 % 10000 AS VARCHAR), 4, '0')
       || CASE WHEN c_custkey % 5 = 0 THEN ' dated 03/04/20' || lpad(CAST(c_custkey % 100 AS VARCHAR), 2, '0') ELSE '' END AS text FROM customer"""
_D = "[" + ", ".join(str(x) for row in VERHOEFF_D for x in row) + "]"
_P = "[" + ", ".join(str(x) for row in VERHOEFF_P for x in row) + "]"


#: Texts of a part.
TEXTS = 10_000


@query(
    "n5_fields_and_checks",
    rf"""WITH l AS ({_LETTERS}),
       pan AS (SELECT c_custkey, 'pan' AS field, regexp_extract(text, '(?i)\b[A-Z]{{5}}[0-9]{{4}}[A-Z]\b') AS value, true AS reconciled FROM l WHERE regexp_matches(text, '(?i)\bpan\b')),
       gst AS (SELECT c_custkey, 'gstin' AS field, regexp_extract(text, '(?i)\b[0-9]{{2}}[A-Z]{{5}}[0-9]{{4}}[A-Z][0-9A-Z]Z[0-9A-Z]\b') AS value FROM l WHERE regexp_matches(text, '(?i)\bgst(in)?\b')),
       gst2 AS (SELECT c_custkey, field, value, substr('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ', CAST((36 - list_sum([((strpos('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ', value[i]) - 1) * (CASE WHEN i % 2 = 1 THEN 1 ELSE 2 END)) // 36 + ((strpos('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ', value[i]) - 1) * (CASE WHEN i % 2 = 1 THEN 1 ELSE 2 END)) % 36 for i in range(1, 15)]) % 36) % 36 + 1 AS INTEGER), 1) = value[15] AS reconciled FROM gst WHERE value <> ''),
       ifsc AS (SELECT c_custkey, 'ifsc' AS field, regexp_extract(text, '(?i)\b[A-Z]{{4}}0[A-Z0-9]{{6}}\b') AS value, true AS reconciled FROM l WHERE regexp_matches(text, '(?i)\bifsc\b')),
       uid AS (SELECT c_custkey, 'aadhaar' AS field, regexp_extract(text, '(?i)\b[2-9][0-9]{{3}}[ -]?[0-9]{{4}}[ -]?[0-9]{{4}}\b') AS value FROM l WHERE regexp_matches(text, '(?i)\b(aadhaar|aadhar|uid)\b')),
       uid2 AS (SELECT c_custkey, field, value, list_reduce(list_prepend(0, [{_P}[((12 - i) % 8) * 10 + CAST(regexp_replace(value, '[^0-9]', '', 'g')[i] AS INTEGER) + 1] for i in range(12, 0, -1)]), lambda s, x: {_D}[s * 10 + x + 1]) = 0 AS reconciled FROM uid WHERE value <> ''),
       dat AS (SELECT c_custkey, 'date' AS field, regexp_extract(text, '\b[0-3]?[0-9][/.-][01]?[0-9][/.-]20[0-9]{{2}}\b') AS value, CAST(NULL AS BOOLEAN) AS reconciled FROM l),
       every AS (SELECT * FROM pan UNION ALL SELECT * FROM gst2 UNION ALL SELECT * FROM ifsc UNION ALL SELECT * FROM uid2 UNION ALL SELECT * FROM dat)
       SELECT c_custkey, field, value, reconciled, CAST(CASE WHEN reconciled THEN 0.99 WHEN NOT reconciled THEN 0.40 ELSE 0.65 END AS DOUBLE) AS confidence FROM every WHERE value <> ''""",
)
def _(t):
    k, digits = F.col("c_custkey"), lambda x, n: F.lpad(x.cast("string"), n, "0")
    letter = F.substring(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), (k % 26 + 1).cast("int"), F.lit(1))
    pan = F.concat(F.lit("AB"), letter, F.lit("PQ"), digits(k % 10000, 4), letter)
    text = F.concat(
        "c_name",
        F.when(k % 3 == 0, " ref ").otherwise(" PAN: "),
        pan,
        F.lit(" GSTIN 27"),
        pan,
        F.lit("1Z"),
        F.substring(F.lit(labels.BASE36), (k % 36 + 1).cast("int"), F.lit(1)),
        F.when(k % 4 == 0, "").otherwise(F.concat(F.lit(" IFSC HDFC0"), digits(k % 1000000, 6))),
        F.lit(" uid 2345 "),
        digits(k * 7 % 10000, 4),
        F.lit("-"),
        digits(k * 31 % 10000, 4),
        F.when(k % 5 == 0, F.concat(F.lit(" dated 03/04/20"), digits(k % 100, 2))).otherwise(""),
    )
    # A small table's texts are much work, so they are dealt by number, not by size, and each is made once.
    texts = t.customer.select("c_custkey", text.alias("text")).repartition(-(-t.customer.count() // TEXTS) or 1, "c_custkey")
    found = texts.select("c_custkey", F.explode(labels.fields_of(F.col("text"))).alias("f"))
    return found.select("c_custkey", "f.*")


_ONES = "['', 'one', 'two', 'three', 'four', 'five', 'six', 'seven', 'eight', 'nine', 'ten', 'eleven', 'twelve', 'thirteen', 'fourteen', 'fifteen', 'sixteen', 'seventeen', 'eighteen', 'nineteen']"
_TENS = "['', '', 'twenty', 'thirty', 'forty', 'fifty', 'sixty', 'seventy', 'eighty', 'ninety']"


@query(
    "n7_amount_in_words",
    f"""WITH a AS (SELECT o_orderkey, o_custkey, CAST(floor(o_totalprice) * 97 AS BIGINT) AS n FROM orders), p AS (SELECT *, [n // 10000000, n // 100000 % 100, n // 1000 % 100, n // 100 % 10, n % 100] AS g FROM a),
       w AS (SELECT *, list_transform(g, lambda x: trim(CASE WHEN x < 20 THEN {_ONES}[CAST(x + 1 AS INTEGER)] ELSE {_TENS}[CAST(x // 10 + 1 AS INTEGER)] || ' ' || {_ONES}[CAST(x % 10 + 1 AS INTEGER)] END)) AS s FROM p),
       said AS (SELECT o_orderkey, o_custkey, n, trim(regexp_replace(concat_ws(' ', CASE WHEN g[1] > 0 THEN s[1] || ' crore' END, CASE WHEN g[2] > 0 THEN s[2] || ' lakh' END, CASE WHEN g[3] > 0 THEN s[3] || ' thousand' END, CASE WHEN g[4] > 0 THEN s[4] || ' hundred' END, s[5]), ' +', ' ', 'g')) AS words FROM w)
       SELECT o_orderkey, o_custkey, n, words, CASE WHEN o_orderkey % 5 = 4 THEN NULL ELSE o_orderkey % 5 <> 3 OR o_orderkey % 5 = 3 AND 1 - CAST(levenshtein('one', words) AS DOUBLE) / greatest(3, length(words)) >= 0.8 END AS agrees FROM said""",
)
def _(t):
    x = t.orders.select("o_orderkey", "o_custkey", (F.floor("o_totalprice") * 97).cast("long").alias("n"))
    x = x.withColumn("words", labels.amount_words(F.col("n")))
    k = F.col("o_orderkey") % 5
    # Right, in capitals, the first letter lost, another amount, and no amount in words at all.
    said = F.when(k == 0, F.concat(F.lit("Rupees "), F.col("words"), F.lit(" only"))).when(k == 1, F.concat(F.lit("(RUPEES "), F.upper("words"), F.lit(" ONLY)")))
    said = said.when(k == 3, F.lit("rupees one only")).otherwise(F.col("words"))
    said = F.when(k == 2, F.concat(F.lit("rupees "), F.substring(F.col("words"), F.lit(2), F.length("words")), F.lit(" only"))).otherwise(said)
    return x.select("o_orderkey", "o_custkey", "n", "words", labels.words_agree(F.col("n"), said).alias("agrees"))


_TRAIL = """WITH l AS (SELECT l_orderkey AS doc, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS i, CASE WHEN l_returnflag = 'A' THEN 1 WHEN l_returnflag = 'R' THEN 2 WHEN l_linestatus = 'F' THEN 3 END AS level, l_returnflag || CAST(l_linenumber AS VARCHAR) AS text FROM lineitem),
  h AS (SELECT *, max(CASE WHEN level = 1 THEN i END) OVER w AS a, max(CASE WHEN level = 2 THEN i END) OVER w AS b, max(CASE WHEN level = 3 THEN i END) OVER w AS c FROM l WINDOW w AS (PARTITION BY doc ORDER BY i))"""


@query(
    "e18_section_trails",
    _TRAIL
    + """ SELECT h.doc, h.i, 'd' || h.doc || '-e' || h.i AS element, concat_ws(' > ', x.text, CASE WHEN h.b > coalesce(h.a, 0) THEN y.text END, CASE WHEN h.c > greatest(coalesce(h.a, 0), coalesce(h.b, 0)) THEN z.text END) AS trail
       FROM h LEFT JOIN l x ON x.doc = h.doc AND x.i = h.a LEFT JOIN l y ON y.doc = h.doc AND y.i = h.b LEFT JOIN l z ON z.doc = h.doc AND z.i = h.c""",
)
def _(t):
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    flag = F.col("l_returnflag")
    level = F.when(flag == "A", 1).when(flag == "R", 2).when(F.col("l_linestatus") == "F", 3)
    lines = t.lineitem.select(F.col("l_orderkey").alias("doc"), F.row_number().over(order).alias("i"), level.alias("level"), F.concat(flag, F.col("l_linenumber").cast("string")).alias("text"))
    element = F.concat(F.lit("d"), F.col("doc").cast("string"), F.lit("-e"), F.col("i").cast("string"))
    return bills.breadcrumbs(lines, "doc", "i", "level", "text").select("doc", "i", element.alias("element"), "trail")
