"""Operators without SQL twins, and small cases by hand."""

import random
from bisect import bisect_left

import pytest
from pyspark.sql import functions as F

from tallyloom.catalog import registry
from tallyloom.functions import dates, text
from tallyloom.functions.numbers import band, half_up
from tallyloom.operators import joins, windows
from tallyloom.plans import changes, schedule, verify
from tallyloom.sources.shared import with_checkpoints
from tallyloom.streaming import state

import __spark_entry__  # noqa: F401


def values(spark, rows, schema, column):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


def test_numbers_in_cells(spark):
    cases = [("₹ 1,234.50", 1234.5), ("(1,000)", -1000.0), ("१२३", 123.0), ("12 %", 12.0), ("Rs. 7", 7.0), ("n/a", None), ("", None), (None, None)]
    assert values(spark, [(a,) for a, _ in cases], "raw string", text.parse_number(F.col("raw"))) == [b for _, b in cases]
    amounts = [("₹ 5", True), ("5 kg", False), ("", False), (None, False)]
    assert values(spark, [(a,) for a, _ in amounts], "raw string", text.is_amount(F.col("raw"))) == [b for _, b in amounts]


def test_check_digits(spark):
    cases = [("2363", True), ("2364", False), ("23-63", True), ("", False)]
    assert values(spark, [(a,) for a, _ in cases], "d string", text.verhoeff_ok(F.col("d"))) == [b for _, b in cases]


def test_rounding_and_bands(spark):
    assert values(spark, [(-2.5,), (2.5,), (-0.4,)], "x double", half_up(F.col("x"))) == [-2.0, 3.0, 0.0]
    assert values(spark, [(0.0,), (1.0,), (9.0,), (None,)], "x double", band(F.col("x"), [0, 5], ["a", "b", "c"])) == ["a", "b", "c", None]


def test_plain_text(spark):
    html = "<p>a&amp;lt;b</p><script>x<y</script> <b>c</b>&nbsp;d"
    assert values(spark, [(html,)], "h string", text.plain_text(F.col("h"))) == ["a&lt;b c d"]


def test_monthly_deadlines(spark):
    cases = [((15, "2024-02-10"), "2024-02-15"), ((31, "2024-02-10"), "2024-02-29"), ((5, "2024-02-10"), "2024-03-05"), ((10, "2024-02-10"), "2024-02-10")]
    got = values(spark, [c for c, _ in cases], "d int, a string", dates.next_monthly(F.col("d"), F.col("a").cast("date")).cast("string"))
    assert got == [w for _, w in cases]


def test_tie_out_of_sections(spark):
    rows = [("a", 1, 100.0, False), ("a", 2, 50.0, False), ("a", 3, 150.0, True), ("a", 4, 10.0, False), ("a", 5, 40.0, True), ("b", 1, 7.0, False)]
    df = spark.createDataFrame(rows, "doc string, n int, v double, t boolean")
    got = {(r.doc, r.section): (r.gap, r.flagged) for r in verify.tie_out(df, "doc", "n", "v", "t").collect()}
    assert got == {("a", 0): (0.0, False), ("a", 1): (30.0, True)}


def test_digit_repair(spark):
    rows = [("1O", "1OO", "1000"), ("3O", "2O", "6O"), ("2", "3", "9"), ("2", "3", "6")]
    got = values(spark, rows, "q string, r string, a string", verify.repair_row(F.col("q"), F.col("r"), F.col("a")))
    assert got[0][1:] == (10.0, 100.0, 1000.0) and got[1] is None and got[2] is None and got[3]["n"] == 0


def test_mutual_best_is_greedy(spark):
    with_checkpoints(spark)
    r = random.Random(1)
    pairs = [(i, j, float(r.randint(0, 30))) for i in range(12) for j in range(9) if r.random() < 0.7]
    left, right, want = set(), set(), set()
    for i, j, s in sorted(pairs, key=lambda p: (-p[2], p[0], p[1])):
        if i not in left and j not in right:
            left.add(i)
            right.add(j)
            want.add((i, j, s))
    got = {tuple(x) for x in joins.mutual_best(spark.createDataFrame(pairs, "a long, b long, s double"), "a", "b", "s").collect()}
    assert len({x[0] for x in got}) == len(got) == len({x[1] for x in got})
    assert sum(x[2] for x in got) == sum(x[2] for x in want)


def test_longest_rising(spark):
    r = random.Random(2)
    rows = [(k, i, r.randint(0, 20)) for k in range(5) for i in range(r.randint(1, 30))]
    got = {x.k: x.rising for x in windows.longest_rising(spark.createDataFrame(rows, "k long, i long, v long"), "k", ["i"], "v").collect()}
    for k in range(5):
        tails = []
        for _, _, v in sorted(x for x in rows if x[0] == k):
            at = bisect_left(tails, v)
            tails[at : at + 1] = [v]
        assert got[k] == len(tails)


def test_decisions_use_up_the_balance(spark):
    rows = [("m", 1, 4.0, 10.0), ("m", 2, 7.0, 10.0), ("m", 3, 6.0, 10.0), ("n", 1, 1.0, 0.0)]
    got = {(r.k, r.i): (r.granted, r.balance_left) for r in changes.decided(spark.createDataFrame(rows, "k string, i int, d double, b double"), "k", ["i"], "d", "b").collect()}
    assert got == {("m", 1): (True, 0.0), ("m", 2): (False, 0.0), ("m", 3): (True, 0.0), ("n", 1): (False, 0.0)}


def test_overlap_pairs_once(spark):
    rows = [(1, "2020-01-01", "2020-06-30"), (2, "2020-06-30", "2020-07-02"), (3, "2020-07-03", "2020-07-03"), (4, "2020-02-01", "2020-02-01")]
    df = spark.createDataFrame(rows, "id int, s string, e string").select(F.lit("k").alias("k"), "id", F.col("s").cast("date").alias("s"), F.col("e").cast("date").alias("e"))
    got = sorted((r.a_id, r.b_id) for r in joins.overlapping(df, df, ["k"], "s", "e", ("id", "id")).where("a_id < b_id").collect())
    assert got == [(1, 2), (1, 4)]


def test_summary_nodes_and_baseline(spark):
    leaves = spark.createDataFrame([("a.b.1", 3, 9), ("a.b.2", 1, 4), ("a.c", 2, 2), ("z", 0, 0)], "p string, s int, f int")
    got = {r.node: (r.start, r.finish, r.leaves) for r in schedule.summary_nodes(leaves, "p", "s", "f").collect()}
    assert got == {"a": (1, 9, 3), "a.b": (1, 9, 2)}


def test_hashes_against_python(spark):
    folder = "/root/testdata/sf0.001"
    rows = registry.QUERIES["b11_presence_hash"](spark, folder).collect()
    balance = {r.c_custkey: r.c_acctbal for r in spark.read.parquet(f"{folder}/customer.parquet").collect()}
    for r in rows:
        h = 0
        for ch in f"{r.c_custkey}|2001-08-01":
            h = (h * 31 + ord(ch) + (1 << 31)) % (1 << 32) - (1 << 31)
        assert r.present == ((abs(h) % 100 < 85) if balance[r.c_custkey] > 0 else None)


def test_verhoeff_digits_against_python(spark):
    def ok(n):
        c = 0
        for i, ch in enumerate(reversed(str(n))):
            c = text.VERHOEFF_D[c][text.VERHOEFF_P[i % 8][int(ch)]]
        return c == 0

    rows = spark.range(100000, 100400).select("id", text.verhoeff_ok(F.col("id").cast("string")).alias("ok")).collect()
    assert all(r.ok == ok(r.id) for r in rows) and any(r.ok for r in rows)


def test_nested_json_tables(spark, tmp_path):
    import json

    from tallyloom.sources.cells import load_cells

    (tmp_path / "a.json").write_text(json.dumps({"type": "bill", "tables": [{"page": 2, "grid": [["item", "amount"], ["x", None], []]}, {"page": 3, "grid": []}]}, indent=1))
    (tmp_path / "b.json").write_text(json.dumps({"type": "bill", "tables": []}))
    got = sorted(tuple(r) for r in load_cells(spark, str(tmp_path)).collect() if r.raw is not None)
    assert got == [("a.json", "t-0", 2, 0, 0, "item"), ("a.json", "t-0", 2, 0, 1, "amount"), ("a.json", "t-0", 2, 1, 0, "x")]
    assert load_cells(spark, str(tmp_path)).count() == 4


def test_one_to_one_pairs_of_a_chain_of_falling_scores(spark):
    with_checkpoints(spark)
    n = 400
    pairs = [(i, i, 10.0 * n - 2 * i) for i in range(n)] + [(i + 1, i, 10.0 * n - 2 * i - 1) for i in range(n - 1)]
    got = {tuple(x) for x in joins.mutual_best(spark.createDataFrame(pairs, "a long, b long, s double"), "a", "b", "s", max_rounds=2).collect()}
    used_a, used_b, want = set(), set(), set()
    for a, b, s in sorted(pairs, key=lambda p: (-p[2], p[0], p[1])):
        if a not in used_a and b not in used_b:
            used_a.add(a)
            used_b.add(b)
            want.add((a, b, s))
    assert got == want


def test_serial_gaps_of_any_width(spark):
    rows = [("a", v) for v in (1, 2, 3, 5, 6, 7, 8, 10**12)] + [("b", v) for v in (1, 5, 9)] + [("c", 1)]
    got = {tuple(x) for x in windows.serial_gaps(spark.createDataFrame(rows, "k string, v long"), "k", "v").collect()}
    assert got == {("a", 4, 4), ("a", 9, 10**12 - 1)}


def test_gate_over_continuous_confidences(spark):
    r = random.Random(2)
    rows = [(c, r.random() > c) for c in [r.random() for _ in range(3000)] + [0.0, 1.0, 1.0]]
    gate = verify.lowest_gate(spark.createDataFrame(rows, "c double, wrong boolean"), "c", "wrong", 0.2, 50).first()["gate"]
    rows.sort(key=lambda x: -x[0])
    n = e = 0
    want = None
    for i, (c, wrong) in enumerate(rows):
        n, e = n + 1, e + wrong
        if (i + 1 == len(rows) or rows[i + 1][0] != c) and n >= 50 and e / n <= 0.2:
            want = c
    assert gate == want


def test_a_log_goes_on_in_its_folder_and_may_be_empty(spark, tmp_path):
    schema = "user_id long, event_id long, ts long"
    source, target = tmp_path / "in", f"file://{tmp_path}/log"
    source.mkdir()
    stream = lambda: spark.readStream.schema(schema).parquet(str(source))
    assert state.logged_with_retention(stream(), "user_id", ["ts", "event_id"], 3, target).count() == 0
    for part in range(3):
        rows = [(u, 10 * part + u, part) for u in range(8) if part < 2 or u < 2]
        spark.createDataFrame(rows, schema).write.mode("append").parquet(str(source))
        left = state.logged_with_retention(stream(), "user_id", ["ts", "event_id"], 2, target).collect()
        assert len(left) == [8, 16, 16][part]
    assert {x.event_id for x in left if x.user_id == 1} == {11, 21} and {x.event_id for x in left if x.user_id == 5} == {5, 15}
