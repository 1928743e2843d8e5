import pytest
from pyspark.sql import functions as F

from tallyloom.functions import labels, messages
from tallyloom.operators import aggregates
from tallyloom.plans import bills, columns, verify


def cells(doc, grid):
    return [(doc, r, c, raw) for r, row in enumerate(grid) for c, raw in enumerate(row)]


def frame(spark, *grids):
    return spark.createDataFrame([x for d, g in enumerate(grids) for x in cells(d, g)], "doc long, row long, col int, raw string")


@pytest.mark.parametrize(
    "message,page,route,topic,asked",
    [
        ("[Context: Legal · Department: Fire] how do I reassign this Task", "Legal", "/tasks", "hand over a task", 5),
        ("[Context: Tasks] top 200 holidays", None, "/calendar", None, 50),
        ("help me apply for leave", None, "/leave", "apply for leave", 5),
        ("hello", None, None, None, 5),
        ("first 0 of all", None, None, None, 1),
        (None, None, None, None, 5),
    ],
)
def test_messages(spark, message, page, route, topic, asked):
    m = F.col("m")
    got = spark.createDataFrame([(message,)], "m string").select(messages.page_name(m), messages.route(m), messages.help_topic(m), messages.asked_count(m)).first()
    assert tuple(got) == (page, route, topic, asked if message else got[3])


def test_longest_name_wins_and_context_does_not_count(spark):
    rows = [("[Context: Water] ask the water supply people",), ("water and fire",), ("nobody",)]
    got = spark.createDataFrame(rows, "m string").select(messages.named_entity(F.col("m"), ["Water", "Fire", "Water Supply"])).collect()
    assert [r[0] for r in got] == ["Water Supply", "Water", None]


def test_money_columns_and_roles(spark):
    items = [[str(i), "work", "4", "25", str(100 + i)] for i in range(4)]
    grids = (
        [["Sr", "Item", "Quantity", "Unit Rate", "Amount"], *items],
        [["a", "b", "c", "d", "e"], *items],
        [["क्र", "कार्य", "मात्रा", "दर", "राशि"], *items],
        [["a", "b"], ["1", "x"], ["2", "y"]],
    )
    found = columns.profiles(frame(spark, *grids))
    assert {r.doc: (r.col, r.by) for r in columns.amount_column(found).collect()} == {0: (4, "header"), 1: (4, "largest"), 2: (4, "header")}
    assert {r.doc: (r.qty, r.rate, r.amount) for r in columns.roles(found).collect()} == {0: (2, 3, 4), 1: (None, None, None), 2: (2, 3, 4), 3: (None, None, None)}


def test_tables_and_prose(spark):
    prose = [[("word " * 20).strip(), ("more " * 20).strip()]] * 4
    sparse = [["A", "", ""], ["", "1", "10"], ["", "2", "20"], ["B", "", ""]]
    got = {r.doc: (r.emit, r.tabular) for r in columns.tabular(frame(spark, prose, sparse, [["title", ""], [None, " "]], [["a", "b"], ["c", "d"], ["e", "f"]])).collect()}
    assert got == {0: (True, False), 1: (True, True), 2: (False, False), 3: (True, True)}


def test_contract_prices(spark):
    head = ["Total Contract Price", "", "600,000"]
    grids = (
        [head, ["works", "250", "0.4"], ["Sub-Total A", "1.0", "400000"], ["Sub-Total B", "1", "200000"]],
        [head, ["Grand Total", "1.0", "600000"]],
        [head, ["Grand Total", "1.0", "900000"]],
        [["अनुबंध मूल्य", "600000", ""], ["works", "250000", "0.4"]],
        [["Grand Total", "1.0", "900000"]],
    )
    got = {r.doc: (r.price, r.totals, r.passed, r.how) for r in bills.contract_ties(frame(spark, *grids), "doc").collect()}
    assert got == {
        0: (600000.0, 2, True, "sum of sub-totals"),
        1: (600000.0, 1, True, "one total"),
        2: (600000.0, 1, False, "does not tie out"),
        3: (600000.0, 0, None, "not tested"),
        4: (None, 1, None, "not tested"),
    }


def test_case_risk(spark):
    rows = [("Land Acquisition", "Pending", 400), ("Land Acquisition", "Pending", 365), ("RTI Appeal", "Disposed - Favorable", 9), ("Unheard of", "Disposed - Unfavorable", 9), ("Service Matter", "Stayed", 999)]
    got = aggregates.case_risk(spark.createDataFrame(rows, "type string, status string, days int")).collect()
    assert [(r.score, r.win, r["class"]) for r in got] == [(80, 20, "High"), (70, 30, "High"), (5, 100, "Low"), (65, 0, "High"), (30, 70, "Low")]


def test_merged_cells_and_words_of_large_amounts(spark):
    got = spark.createDataFrame([("12 450",), ("12 12",), ("part of lot 12 450",), ("450",), (None,)], "c string").select(verify.merged_numbers(F.col("c"))).collect()
    assert [r[0] for r in got] == [True, False, False, False, None]
    said = spark.createDataFrame([(25_000_000_000,), (10_000_000,), (12_345_678,)], "n long").select(labels.amount_words(F.col("n"))).collect()
    assert [r[0] for r in said] == ["two thousand five hundred crore", "one crore", "one crore twenty three lakh forty five thousand six hundred seventy eight"]
