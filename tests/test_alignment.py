"""The task's step of the alignment: put together once, and the same rows whichever way tables meet."""

import random
from contextlib import redirect_stdout
from io import StringIO

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyloom.plans import alignment, reconcile

NOISY = "doc long, tab long, j long, page long, amount_raw string, rate_raw string, qty_raw string"
NAMES = ["doc", "sheet", "tab", "i", "j", "page", "anchored", "best", "method", "n_trusted", "n_noisy", "on_page"]


def files(seed, docs=6, parts=4, rows=5):
    """Sheets and tables of few values: many repeats, near ones, look-alikes, empty cells."""
    r = random.Random(seed)
    amounts, raws = [0.05, 50.0, 50.5, 99.0, 100.0, 101.5, 1000.0, 1005.0, 20150.0, -70.0, None], ["0.05", "5O.5", "51", "98.5", "1OO", "1,009", "20000", "(70)", "x", "", "?", None]
    trusted = [(d, s, i, r.choice(amounts), r.choice([10.0, 11.0, 500.4, None]), r.randint(1, 4)) for d in range(docs) for s in range(parts) for i in range(rows)]
    noisy = [(d, b, j, 1 + j // 2, r.choice(raws), r.choice(["1O", "11", "504", "?"]), r.choice("1234x")) for d in range(docs) for b in range(parts) for j in range(r.randint(0, rows + 2))]
    return trusted, noisy


def framed(spark, trusted, noisy):
    t = spark.createDataFrame(trusted, "doc long, sheet long, i long, amount double, rate double, qty int")
    return t.select("doc", "sheet", "i", *(F.col(c).cast("decimal(18,2)").alias(c) for c in ("amount", "rate")), "qty"), spark.createDataFrame(noisy, NOISY)


def rows_of(df):
    return sorted(map(str, df.select(sorted(df.columns)).collect()))


def test_sides_are_put_together_once(spark):
    t, n = framed(spark, *files(1))
    out = StringIO()
    with redirect_stdout(out):
        reconcile.aligned(t, n, ["doc"], ("sheet", "tab")).explain()
    assert out.getvalue().count("Exchange ") == 1


def test_linked_parts_are_aligned_as_tables_of_their_own(spark):
    t, n = framed(spark, *files(2))
    found = reconcile.aligned(t, n, ["doc"], ("sheet", "tab")).cache()
    links = found.select("doc", "sheet", "tab").distinct()
    want = t.join(n, "doc").where(reconcile.number_match(F.col("amount"), F.col("amount_raw")) > 0).select("doc", "sheet", "tab").distinct()
    assert 0 < links.count() < 6 * 16 and rows_of(links) == rows_of(want)
    keys = ["doc", "sheet", "tab"]
    mine, theirs = t.join(links, ["doc", "sheet"]), n.join(links, ["doc", "tab"])
    assert rows_of(found) == rows_of(reconcile.aligned(mine, theirs, keys))
    scores = reconcile.best_scores(mine, theirs, keys, reconcile.scored_pairs(mine, theirs, keys))
    assert rows_of(found.select(*keys, "i", "best")) == rows_of(scores.select(*keys, "i", "best"))
    runs = reconcile.aligned_runs(t, n, ["doc"], ("sheet", "tab")).drop("n_trusted", "n_noisy")
    assert rows_of(runs) == rows_of(reconcile.segments(found.drop("n_trusted", "n_noisy", "on_page"), theirs, keys))


@pytest.mark.parametrize("linked", [True, False])
def test_large_tables_meet_as_small_ones(monkeypatch, linked):
    trusted, noisy = files(3, docs=5, parts=3, rows=9)
    cell = lambda v: (None if v is None else float(v), None if v is None else round(abs(v) * 100), None)
    rows = [(d, 0, s, i, 0, *cell(a), *cell(q), *cell(n)) for d, s, i, a, q, n in trusted] + [(d, 1, b, j, p, *(x for raw in raws for x in (None, None, raw))) for d, b, j, p, *raws in noisy]
    if not linked:  # places are numbered within the key
        rows = [(d, s, 0, part * 100 + place, *rest) for d, s, part, place, *rest in rows]
    rows.sort(key=lambda x: x[:4])
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), *[pa.float64(), pa.int64(), pa.string()] * 3]
    table = pa.table([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=[f"c{i}" for i in range(len(kinds))])
    names = NAMES if linked else [n for n in NAMES if n not in ("sheet", "tab")]

    def told():
        return [r for b in alignment.steps(iter(table.to_batches(max_chunksize=7)), 1, linked, False, names) for r in b.to_pylist()]

    want = told()
    monkeypatch.setattr(alignment, "LARGE", 0)
    monkeypatch.setattr(alignment, "SLICE", 5)
    monkeypatch.setattr(alignment, "CHUNK", 10)
    assert len(want) > 40 and told() == want


def test_digits_of_cells_are_those_of_the_columns(spark):
    raws = ["3O00.00", "l2,5B", "3OOO", "apple", "", None, "1234567890123456789", "123456789012345678", "0.05", "५0", "|7", "₹ 1,00", "-1.50", ".", "O", "b7", "é9"]
    df = spark.createDataFrame([(r, i) for i, r in enumerate(raws)], "raw string, i int")
    want = [r[0] for r in df.orderBy("i").select(reconcile._alike(F.col("raw"))).collect()]
    got = alignment.read_digits(pa.array(["skipped", *raws], pa.string()).slice(1)).tolist()
    assert got == [0 if w is None or len(w) > 18 else int("1" + w) for w in want]
    values = ["3000.00", "12.50", "0.05", "0.00", "-7.10", "1000000.01", "9999999999999999.99"]
    own = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v string").select(reconcile.digits_of(F.col("v").cast("decimal(18,2)"))).collect()]
    assert alignment.own_digits(pa.array([abs(int(v.replace(".", ""))) for v in values]).to_numpy()).tolist() == [int("1" + o) for o in own]
