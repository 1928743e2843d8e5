import random

import pytest
from pyspark.sql import functions as F

from tallyloom.plans import reconcile
from tallyloom.sources.shared import with_checkpoints

TRUSTED = "doc long, i long, amount decimal(18,2), rate decimal(18,2), qty int"
NOISY = "doc long, j long, page long, amount_raw string, rate_raw string, qty_raw string"


@pytest.fixture()
def bill(spark):
    """90 lines of distinct amounts on two pages, aligned with what ``read`` makes of them."""
    with_checkpoints(spark)

    def run(read):
        amounts = [100000 + 1000 * i for i in range(90)]
        trusted = spark.createDataFrame([(1, i, a, None, None) for i, a in enumerate(amounts)], "doc long, i long, amount long, rate long, qty int")
        trusted = trusted.select("doc", "i", *(F.col(c).cast("decimal(18,2)").alias(c) for c in ("amount", "rate")), "qty")
        noisy = spark.createDataFrame([(1, j, 37 if j < 45 else 38, read(j, a), "", "") for j, a in enumerate(amounts)], NOISY)
        rows = reconcile.aligned(trusted, noisy, ["doc"])
        parts = reconcile.segments(rows, noisy, ["doc"])
        return rows.orderBy("i").collect(), parts.orderBy("segment").collect(), reconcile.overall(parts, ["doc"]).collect()

    return run


def test_clean_lines_find_their_pages(bill):
    rows, parts, _ = bill(lambda j, a: str(a))
    assert [r.j for r in rows] == list(range(90)) and all(r.anchored and r.method == "anchor" for r in rows)
    assert [(p.page, p.first_i, p.n, p.confidence) for p in parts] == [(37, 0, 45, 1.0), (38, 45, 45, 1.0)]


def test_a_third_of_unreadable_lines_keeps_the_pages(bill):
    rows, parts, _ = bill(lambda j, a: str(a).replace("0", "O") if j % 3 == 0 else str(a))
    assert {r.method for r in rows} == {"anchor"}
    assert (parts[0].page, parts[-1].page) == (37, 38)


def test_too_few_anchors_fall_back_to_counts_below_the_gate(bill):
    rows, _, whole = bill(lambda j, a: "?")
    assert {r.method for r in rows} == {"count_order"} and [r.j for r in rows] == list(range(90))
    assert whole[0].confidence < reconcile.GATE


def test_other_counts_and_missing_tables_fail(spark):
    with_checkpoints(spark)
    trusted = spark.createDataFrame([(d, i, None, None, 3) for d in (1, 2) for i in range(9)], TRUSTED)
    noisy = spark.createDataFrame([(1, j, 1, "?", "", "") for j in range(3)], NOISY)
    rows = reconcile.aligned(trusted, noisy, ["doc"])
    got = rows.collect()
    assert len(got) == 18 and {(r.method, r.j, r.page, r.anchored) for r in got} == {("failed", None, None, False)}
    assert reconcile.segments(rows, noisy, ["doc"]).count() == 0


@pytest.mark.parametrize(
    "value,raw,score",
    [("1000", "1000", 1.0), ("100000", "100050", 0.9), ("3000", "3O00", 0.7), ("3000", "3OOO", 0.0), ("1000", "apple", 0.0), ("12.50", "12.5", 1.0), ("7", None, 0.0), (None, "7", None), ("-1500", "(1,500)", 1.0), ("4711", "47ll", 0.7)],
)
def test_number_matches(spark, value, raw, score):
    df = spark.createDataFrame([(value, raw)], "v string, raw string").select(F.col("v").cast("decimal(18,2)").alias("v"), "raw")
    assert df.select(reconcile.number_match(F.col("v"), F.col("raw"))).first()[0] == score


def plain_scores(trusted, noisy):
    def match(v, raw):
        try:
            p = float(raw)
        except ValueError:
            p = None
        if p is not None and abs(v - p) <= 1:
            return 1.0
        if p is not None and abs(v - p) <= 0.01 * max(abs(v), abs(p), 1.0):
            return 0.9
        return 0.0

    return [[round(0.6 * match(t[0], n[0]) + 0.25 * match(t[1], n[1]) + 0.15 * match(t[2], n[2]), 6) for n in noisy] for t in trusted]


def test_rows_that_share_numbers_are_all_that_can_be_best(spark):
    """Anchors and best scores equal those of every row against every other, with many repeats and near values."""
    r = random.Random(3)
    for seed in range(3):
        trusted = [(r.choice([50, 50.5, 99, 100, 101, 150, 1000, 1005, 20000, 20150]), r.choice([10, 11, 500]), r.randint(1, 4)) for _ in range(30)]
        noisy = [(r.choice(["50", "51.5", "98.5", "100", "102", "150", "1009", "20000", "19900", "x"]), r.choice(["10", "12.5", "504"]), r.choice("1234x")) for _ in range(30)]
        scores = plain_scores(trusted, noisy)
        t = spark.createDataFrame([(1, i, *map(float, x[:2]), x[2]) for i, x in enumerate(trusted)], "doc long, i long, amount double, rate double, qty int")
        t = t.select("doc", "i", F.col("amount").cast("decimal(18,2)").alias("amount"), F.col("rate").cast("decimal(18,2)").alias("rate"), "qty")
        n = spark.createDataFrame([(1, j, 1, *x) for j, x in enumerate(noisy)], NOISY)
        pairs = reconcile.scored_pairs(t, n, ["doc"])
        best = {x.i: float(x.best) for x in reconcile.best_scores(t, n, ["doc"], pairs).collect()}
        assert best == {i: max(s) for i, s in enumerate(scores)}
        want = set()
        for i, s in enumerate(scores):
            j = s.index(max(s))
            column = [row[j] for row in scores]
            if max(s) >= 0.85 and column.index(max(column)) == i and sum(x[0] == trusted[i][0] for x in trusted) <= 3:
                want.add((i, j))
        assert {(x.i, x.j) for x in reconcile.mutual_anchors(t, pairs, ["doc"]).collect()} == want


def test_rising_rows_are_a_longest_subsequence(spark):
    r = random.Random(5)
    lists = {k: [r.randint(0, 12) for _ in range(r.randint(1, 14))] for k in range(40)}
    df = spark.createDataFrame([(k, i, v) for k, vs in lists.items() for i, v in enumerate(vs)] + [(99, 0, None)], "k long, i long, v long")
    got = {}
    for x in reconcile.rising_rows(df, ["k"], "i", "v").collect():
        got.setdefault(x.k, []).append((x.i, x.v))
    assert set(got) == set(lists)
    for k, vs in lists.items():
        length = [1] * len(vs)
        for i in range(len(vs)):
            length[i] = 1 + max((length[j] for j in range(i) if vs[j] < vs[i]), default=0)
        rows = sorted(got[k])
        assert len(rows) == max(length) and all(a[1] < b[1] for a, b in zip(rows, rows[1:])) and all(vs[i] == v for i, v in rows)


def test_best_first_is_a_plain_greedy_pass(spark):
    r = random.Random(6)
    rows = [(g, a, b, r.randint(0, 9) / 10) for g in range(20) for a in range(5) for b in range(4) if r.random() < 0.7]
    df = spark.createDataFrame(rows, "file long, sheet long, tab long, score double")
    got = {tuple(x) for x in reconcile.best_first(df, "file", "sheet", "tab", "score").collect()}
    want, used = set(), set()
    for g, a, b, s in sorted(rows, key=lambda x: (x[0], -x[3], x[1], x[2])):
        if s > 0 and (g, "a", a) not in used and (g, "b", b) not in used:
            used |= {(g, "a", a), (g, "b", b)}
            want.add((g, a, b, s))
    assert got == want
    assert reconcile.best_first(df.limit(0), "file", "sheet", "tab", "score").count() == 0


@pytest.mark.parametrize(
    "headers,sections,change",
    [(("", ""), ("", ""), 0), (("Item Cost", "Item Cost"), ("", ""), 1), (("Item Cost", "Zzz Qqq"), ("", ""), -1), (("", ""), ("Table 3.2", "Table 9"), -1), (("", ""), ("Table 3.2", "Table 3.2"), 1)],
)
def test_context_moves_confidence(spark, headers, sections, change):
    row = spark.createDataFrame([(0.9, *headers, *sections)], "c double, h1 string, h2 string, s1 string, s2 string")
    got = row.select(reconcile.in_context(F.col("c"), (F.col("h1"), F.col("h2")), (F.col("s1"), F.col("s2")))).first()[0]
    assert (got > 0.9) - (got < 0.9) == change
    if sections == ("Table 3.2", "Table 9"):
        assert got < reconcile.GATE


def test_reasons_and_queue(spark):
    df = spark.createDataFrame([("f", 1, 2, 0, 0, 5, 6, 0.9, 0.8, "anchor"), ("f", 2, 1, 1, 1, 5, 9, 0.95, 0.9, "anchor"), ("g", 3, 1, 0, 0, 5, 5, 0.65, 0.6, "count_order")], "file string, sheet int, tab int, flags int, empty int, nt int, nn int, confidence double, least double, method string")
    links = df.withColumn("reasons", reconcile.trust_reasons(F.col("flags"), F.col("empty"), F.col("nt"), F.col("nn")))
    plan = reconcile.eligibility(links)
    assert {r.sheet: (r.eligible, r.reasons) for r in plan.collect()} == {1: (True, []), 2: (False, ["does not tie out", "formulas without values", "5 rows against 9"]), 3: (False, [])}
    got = {r.file: (r.links, r.eligible, r.best_confidence, r.methods, r.reasons) for r in reconcile.queue(plan, "file").collect()}
    assert got == {"f": (2, 1, 0.95, "anchor", "does not tie out; formulas without values; 5 rows against 9"), "g": (1, 0, 0.65, "count_order", "")}
