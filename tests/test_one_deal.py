"""Steps that deal their rows by one key do it once."""

import random
from contextlib import redirect_stdout
from io import StringIO

import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyloom.catalog import bills as catalog_bills
from tallyloom.catalog import registry
from tallyloom.functions import labels, text
from tallyloom.operators import graphs, joins
from tallyloom.plans import bills, columns, scores, verify
from tallyloom.sources import shared
from tallyloom.sources.shared import in_parts, with_checkpoints

import __spark_entry__  # noqa: F401  (registers the queries)


def plan(df):
    out = StringIO()
    with redirect_stdout(out):
        df.explain()
    return out.getvalue()


def deals(df):
    return plan(df).count("Exchange ")


def cells(spark, rows):
    return spark.createDataFrame(rows, "doc long, row long, col long, raw string")


def test_table_scores_deal_once_and_count_blank_and_equal_cells(spark):
    gold = cells(spark, [(1, 0, 0, "Item"), (1, 0, 1, "Qty"), (1, 1, 0, "Bolt  M8"), (1, 1, 1, "12"), (1, 2, 0, " "), (2, 0, 0, " ")])
    said = cells(spark, [(1, 0, 0, "ITEM "), (1, 0, 1, "Qty"), (1, 1, 0, "12.00"), (1, 1, 1, "bolt m8"), (3, 0, 0, "x")])
    found = scores.table_scores(said, gold)
    assert deals(found) == 1
    (r,) = found.collect()  # table 2 has no filled gold cell, and table 3 is no gold table
    assert (r.doc, r.n_gold, r.n_said, r.content_f1, r.positional_f1, r.row_accuracy, r.col_accuracy) == (1, 4, 4, 1.0, 0.5, 1.0, 0.0)
    assert (r.header_accuracy, r.shape_exact, r.shape_near, r.structure, r.misplacement) == (1.0, False, True, 0.5, 0.5)


def test_column_profiles_deal_once_and_keep_the_first_of_equals(spark):
    rows = [(1, 0, 0, "Sr"), (1, 0, 1, None), (1, 0, 2, "राशि"), (1, 1, 0, "(5)"), (1, 1, 1, "7"), (1, 1, 2, "7"), (1, 3, 0, "9"), (1, 3, 2, "₹ ८"), (2, 0, 0, "x")]
    found = columns.profiles(cells(spark, rows))
    assert deals(found) == 1
    got = {(r.doc, r.col): (r.header, r.numbers, r.amounts, r.wins) for r in found.collect()}
    assert got == {(1, 0): ("sr (5)", 2, 2, 1), (1, 1): ("7", 1, 1, 1), (1, 2): ("राशि 7", 2, 2, 0), (2, 0): ("x", 0, 0, 0)}
    tables = spark.createDataFrame([(1, "native", False, 1)], "doc long, route string, low boolean, flags int")
    assert deals(columns.uncertain(tables, found)) == 3  # cells, profiles and tables: profiles are made once


def test_plain_cells_are_parsed_as_dressed_ones(spark):
    raws = ["12", "-3.5", "12\n", "12 ", "1e5", "NaN", "(4)", "१२.५", "abc", "", None, "1.", "--2", "007", " 8 ", "Rs. 1,200", "9" * 400]
    df = spark.createDataFrame([(r,) for r in raws], "raw string")
    got = [tuple(r) for r in df.select(text.parse_number(F.col("raw")), text.is_amount(F.col("raw"))).collect()]
    numbers = [12.0, -3.5, 12.0, 12.0, 1.0, None, -4.0, 12.5, None, None, None, 1.0, -2.0, 7.0, 8.0, 1200.0, float("inf")]
    amounts = [True, True, True, True, False, False, True, True, False, False, False, False, False, True, True, True, True]
    assert got == list(zip(numbers, amounts))


def test_pairs_of_one_large_key_are_made_in_many_parts(spark):
    few, many = spark.createDataFrame([(1, "a"), (2, "b")], "k long, g string"), spark.range(1000).select(F.col("id").alias("peer"), F.lit("a").alias("g"))
    met = joins.met_in_parts(few, many, ["g"], "peer", parts=8)
    assert sorted(r.peer for r in met.collect()) == list(range(1000))
    assert "__part" in plan(met).split("Exchange hashpartitioning(")[1].split(")")[0]


def test_box_groups_are_those_of_all_near_pairs(spark):
    r = random.Random(3)
    rows = [(p, p * 1000 + i, float(r.randint(0, 200)), float(r.randint(0, 200))) for p in range(8) for i in range(r.randint(1, 40))]
    boxes = spark.createDataFrame(rows, "page long, id long, x0 double, y0 double").withColumns({"x1": F.col("x0") + 9, "y1": F.col("y0") + 7})
    found = graphs.box_groups(boxes, "page", "id", 5)
    assert deals(found) == 1
    with_checkpoints(spark)
    want = graphs.connected(boxes, graphs.near_boxes(boxes, "page", "id", 5, 12), "id", "a", "b")
    assert sorted((x.id, x.root) for x in found.collect()) == sorted((x.id, x.root) for x in want.collect())


def test_contract_ties_deal_once(spark):
    rows = [(1, 0, 0, "Contract Price"), (1, 0, 1, "project cost"), (1, 0, 2, "20,000"), (1, 0, 3, "30,000"), (1, 5, 0, "Grand Total"), (1, 5, 1, "1.0"), (1, 5, 2, "20000.50"), (2, 0, 0, None)]
    found = bills.contract_ties(cells(spark, rows), "doc")
    assert deals(found) == 1
    assert sorted(tuple(r) for r in found.collect()) == [(1, 20000.0, 1, True, "one total"), (2, None, 0, None, "not tested")]


def test_row_scores_take_one_pass_over_the_lines(spark):
    # Orders with lines are joined once; before, lines were joined with themselves after.
    assert deals(registry.QUERIES["v27_row_scores"](spark, "/root/testdata/sf0.001")) <= 4


def test_labels_that_state_a_sum_are_never_passed_over(spark):
    stated = ["Grand Total", "SUB - TOTAL (A)", "sub total", "Carried over", "Brought  Forward", "Amount (3) in Rs", "say Rs", "महायोग", "कुल 4"]
    df = spark.createDataFrame([(s,) for s in [*stated, "supply of item", "", None]], "label string")
    got = df.select("label", labels.may_state(F.col("label")).alias("may"), (labels.is_total(F.col("label")) | labels.is_subtotal(F.col("label"))).alias("does")).collect()
    assert [r.label for r in got if r.does] == stated
    assert [r.label for r in got if r.may] == stated


def test_batches_of_cells_are_read_as_single_ones(spark):
    raws = ["12", "-3.5", "12\n", "12 ", "1e5", "NaN", "(4)", "(4)\r\n", " (4) ", "\t(4)", "( 4)", "4\u0085", "१२.५", "abc", "", None, "1.", "--2", "007", "Rs. 1,200", "rS5", "INR 3%", "₹ ८", "(5) of 6", "3-4", " 7", "9" * 400, "-" + "9" * 400, "0." + "0" * 400 + "1", "(" + "9" * 400 + ")"]
    df = spark.createDataFrame([(r,) for r in raws], "raw string")
    want = [tuple(r) for r in df.select(text.parse_number(F.col("raw")), text.is_amount(F.col("raw"))).collect()]
    numbers, amounts = text.read_cells(pa.array(raws, pa.string()))
    assert list(zip(numbers.to_pylist(), amounts.to_pylist())) == want


def test_column_profiles_are_whole_over_any_batches(spark):
    r = random.Random(5)
    raws = ["Qty", "राशि", "ÀB", "(5)", "7", "7", "9", "₹ ८", "-3", None, "", "12.5", "1,200"]
    rows = [(r.choice([1, 2, 3, None, 5]), r.choice([-1, 0, 0, 1, 2, 3, 4, None]), r.choice([0, 1, 2, 3, None]), r.choice(raws)) for _ in range(150)]
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    whole = sorted(map(repr, columns.profiles(cells(spark, rows)).collect()))
    spark.conf.set(name, "3")
    try:
        assert sorted(map(repr, columns.profiles(cells(spark, rows)).collect())) == whole
    finally:
        spark.conf.unset(name)


def test_columns_of_bills_deal_lines_once_and_profiles_once(spark):
    # Before, the header's rows were dealt by themselves and cells once more.
    for name in ("v2_money_column", "v3_bilingual_roles"):
        assert deals(registry.QUERIES[name](spark, "/root/testdata/sf0.001")) <= 2


def test_large_tables_are_dealt_into_more_parts_than_the_session_has(spark, monkeypatch):
    assert in_parts(spark.range(100), "id").rdd.getNumPartitions() == spark.range(100).rdd.getNumPartitions()
    monkeypatch.setattr(shared, "PART_ROWS", 500)
    assert in_parts(spark.range(6001), "id").rdd.getNumPartitions() == 13
    for name in ("e14_reading_order", "e13_interval_islands", "v22_content_scores"):
        df = registry.QUERIES[name](spark, "/root/testdata/sf0.001")
        assert "REPARTITION_BY_NUM" in plan(df), name


def test_content_scores_deal_lines_once(spark, monkeypatch):
    monkeypatch.setattr(shared, "PART_ROWS", 500)
    # One for each score, where the second is the first's read again, and a small side's broadcast.
    assert deals(registry.QUERIES["v22_content_scores"](spark, "/root/testdata/sf0.001")) <= 3


def test_scores_count_nulls_and_repeated_places(spark):
    said = spark.createDataFrame([(1, 1, 5), (1, 1, 5), (1, 2, None), (1, 3, 7), (1, None, 9)], "doc long, i long, v long")
    gold = spark.createDataFrame([(1, 1, 5), (1, 1, 6), (1, 2, None), (1, 3, 8), (1, None, 9)], "doc long, i long, v long")
    (place,) = verify.cell_scores(said, gold, ["doc", "i"], "v").collect()
    assert (place.hits, place.said, place.gold) == (2, 6, 6)
    (content,) = bills.content_f1(said, gold, ["doc"], "v").collect()
    assert (content.matched, content.said, content.gold) == (2, 5, 5)


def test_texts_of_a_small_table_are_dealt_by_number(spark, monkeypatch):
    monkeypatch.setattr(catalog_bills, "TEXTS", 20)
    assert "REPARTITION_BY_NUM" in plan(registry.QUERIES["n5_fields_and_checks"](spark, "/root/testdata/sf0.001"))


def test_rescue_deals_lines_once_and_sorts_no_groups(spark):
    # Before, lines were numbered for each use, joined with their sums, and groups that kept a kind's name were sorted.
    for name in ("v5_section_totals", "v6_column_rescue"):
        df = registry.QUERIES[name](spark, "/root/testdata/sf0.001")
        assert deals(df) == 1
        assert "SortAggregate" not in plan(df) and "Join" not in plan(df)


def test_flags_of_bills_read_one_deal_of_the_lines(spark):
    # Before, the lines were written as a checkpoint, which was dealt again for the sums of each bill.
    df = registry.QUERIES["v10_union_of_flags"](spark, "/root/testdata/sf0.001")
    assert "ExistingRDD" not in plan(df)
    assert deals(df) <= 3  # one for the lines' flags, the same for the sums, and a small side's broadcast


def test_merged_cells_of_any_spacing(spark):
    cases = [("4 5", True), ("4\t\n5", True), (" 45 ", False), ("4 4", False), ("4 of 5 lots here", False), ("", False), (" ", False), ("12.5", False), (None, None)]
    df = spark.createDataFrame([(c,) for c, _ in cases], "cell string")
    assert [r[0] for r in df.select(verify.merged_numbers(F.col("cell"))).collect()] == [m for _, m in cases]
    assert "RLIKE" in plan(df.select(verify.merged_numbers(F.col("cell"))))  # plain cells are passed over


def test_misordered_tables_are_those_of_all_pairs(spark):
    r = random.Random(7)
    side = lambda docs: [(r.choice(docs), r.choice([1, 2, 3, None]), r.choice([5, 6, 7, 8, None])) for _ in range(60)]
    said, gold = side([1, 2, 3, 4, None]), side([1, 2, 3, 5, None])

    def f1(doc, j, g):
        a, b = ([v for d, t, v in rows if (d, t) == (doc, n)] for rows, n in ((said, j), (gold, g)))
        met = sum(min(a.count(v), b.count(v)) for v in set(a) if v is not None) if None not in (doc, j, g) else 0
        return 2 * met / (len(a) + len(b))

    want = {}
    for doc in {d for d, *_ in said}:
        tables = {t for d, t, _ in said if d == doc}
        best = [max(f1(doc, j, g) for g in (1, 2, 3)) for j in tables]
        by_order, best = sum(f1(doc, j, j) for j in tables) / len(tables), sum(best) / len(tables)
        want[doc] = (round(by_order, 9), round(best, 9), len(tables) >= 2 and best - by_order > 0.2)
    schema = "doc long, t long, v long"
    found = bills.misordered(spark.createDataFrame(said, schema), spark.createDataFrame(gold, schema), "doc", "t", "v")
    assert deals(found) == 1  # before, each side was dealt by table, by value and by pair
    assert {x.doc: (round(x.by_order, 9), round(x.best, 9), x.warned) for x in found.collect()} == want


def test_misorder_warning_deals_lines_by_order_and_by_customer(spark):
    # Orders, a small side's broadcast, and the lines by customer.
    assert deals(registry.QUERIES["v23_misorder_warning"](spark, "/root/testdata/sf0.001")) <= 3


def test_sides_that_are_dealt_by_their_doc_meet_in_one_task(spark):
    """Both sides are unions of rows that are dealt by doc, of sizes that Spark merges into other partitions each."""
    held = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1b", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false"}
    for k, v in held.items():
        spark.conf.set(k, v)
    rows = spark.range(400 * 50).select((F.col("id") % 400).alias("doc"), "id")
    body = rows.select("doc", F.row_number().over(Window.partitionBy("doc").orderBy("id")).alias("row"))
    heads = rows.select("doc").distinct().select("doc", F.lit(0).alias("row"))
    gold = body.unionByName(heads).select("doc", F.col("row").cast("long").alias("row"), F.lit(0).cast("long").alias("col"), F.col("row").cast("string").alias("raw"))
    cells, pairs = scores.table_counts(gold, gold, "doc").collect(), scores.paired_within(gold, gold, ["doc"], "row").collect()
    for k in held:
        spark.conf.unset(k)
    assert len(cells) == 400 and {(r.n_said, r.n_gold, r.hits, r.matched) for r in cells} == {(51, 51, 51, 51)}
    assert len(pairs) == 400 and {(r.n_a, r.n_b, r.matched) for r in pairs} == {(51, 51, 51)}
