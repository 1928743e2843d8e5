import datetime as dt

import pytest
from pyspark.sql import functions as F

from tallyloom.catalog import exchange
from tallyloom.sources import cells, files
from tallyloom.sources.relational import RelationalCatalog
from tallyloom.sources.tables import Catalog
from tallyloom.streaming import jobs, state


def test_csv_files_are_in_order_and_read_back(spark, tmp_path):
    rows = [(i, (i * 37 % 101) / 101, t) for i, t in enumerate(["=1+1", "-x", "@cmd", 'a "b", c', "two\nlines", "", None, "plain"] * 40)]
    df = spark.createDataFrame(rows, "id long, confidence double, reason string").repartition(5)
    files.write_csv(df, f"file://{tmp_path}/q", ["confidence", "id"], files=4)
    got = files.read_csv(spark, f"file://{tmp_path}/q", "id long, confidence double, reason string").collect()
    want = {i: (c, f"'{t}" if t and t[0] in "=-@" else t or None) for i, c, t in rows}
    assert {r.id: (r.confidence, r.reason) for r in got} == want
    parts = {}
    for r in got:
        parts.setdefault(r.part, []).append((r.confidence, r.id))
    ends = [x for p in sorted(parts) for x in (min(parts[p]), max(parts[p]))]
    assert len(parts) > 1 and ends == sorted(ends)


@pytest.fixture()
def database(spark, tmp_path):
    spark._jvm.java.lang.System.setProperty("derby.stream.error.file", f"{tmp_path}/derby.log")
    return RelationalCatalog(spark, f"jdbc:derby:{tmp_path}/db;create=true", {"t": "k", "one": "k", "none": "k"}, parts=4, driver="org.apache.derby.jdbc.EmbeddedDriver")


def test_tables_of_a_database_are_read_in_parts_with_filters(spark, database, capsys):
    df = spark.range(100).select(F.col("id").alias("k"), (F.col("id") % 7).cast("double").alias("v"), F.concat(F.lit("n"), F.col("id").cast("string")).alias("name"))
    database.write("t", df, "name VARCHAR(20)")
    assert database.t.rdd.getNumPartitions() == 4
    assert sorted(map(tuple, database.t.collect())) == sorted(map(tuple, df.collect()))
    wanted = database.t.where("v = 3 AND name <> 'n3'").select("k")
    wanted.explain()
    plan = capsys.readouterr().out
    assert "PushedFilters" in plan and "EqualTo(v,3.0)" in plan
    assert sorted(r.k for r in wanted.collect()) == [k for k in range(100) if k % 7 == 3 and k != 3]
    for name, rows in (("one", df.limit(1)), ("none", df.limit(0))):
        database.write(name, rows, "name VARCHAR(20)")
        assert getattr(database, name).count() == rows.count()
    with pytest.raises(AttributeError):
        database.other


def test_layouts_come_back_as_the_cells_they_were_made_of(spark, tmp_path):
    rows = [("d", 1, 0, 0, "a"), ("d", 1, 0, 1, None), ("d", 1, 1, 0, "x, y"), ("d", 3, 0, 0, "p"), ("é", 2, 0, 0, '"q"\n')]
    cells.save_layouts(spark.createDataFrame(rows, "doc_id string, page int, row_ix int, col_ix int, raw string"), f"file://{tmp_path}/l")
    got = {(r.doc_id, r.page, r.row_ix, r.col_ix, r.raw) for r in cells.load_cells(spark, f"file://{tmp_path}/l", lines=True).collect()}
    assert got == set(rows)


def test_reports_have_their_headers(spark):
    t = Catalog(spark, "/root/testdata/sf0.001")
    assert exchange.report(t, "Vacancy Report").columns == ["Department", "Sanctioned", "Filled", "Vacant"]
    assert len(exchange.REPORTS) == 9
    with pytest.raises(KeyError):
        exchange.report(t, "No Report")


START = dt.datetime(2024, 1, 1)


def events(spark, days, seed):
    rows = [(seed * 10000 + i, START + dt.timedelta(days=d, hours=i % 24, minutes=i % 60), i % 5, "click" if i % 3 else "error", float(i % 11)) for d in days for i in range(d * 17 % 13 + 3)]
    return spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double")


@pytest.mark.parametrize("name", ["extremes", "repeats"])
def test_streams_go_on_after_a_restart(spark, tmp_path, name):
    def job(folder):
        stream = spark.readStream.schema("event_id long, ts timestamp, user_id long, event_type string, value double").parquet(folder)
        return jobs.recent_extremes(stream, "value", "1 day") if name == "extremes" else state.first_of_repeats(stream, ["user_id", "event_type"], 48, "1 day")

    def run(folder, out):
        stream = job(folder)
        q = stream.writeStream.format("parquet").outputMode("append").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
        q.awaitTermination()
        return sorted(map(tuple, spark.read.schema(stream.schema).parquet(f"{out}/rows").collect()))

    first, second = events(spark, range(0, 12), 1), events(spark, range(12, 25), 2)
    for part, folder in ((first, "a"), (second, "a"), (first.unionByName(second), "b")):
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/{folder}")
        if part is first:
            before = run(f"{tmp_path}/a", f"{tmp_path}/out-a")
    after = run(f"{tmp_path}/a", f"{tmp_path}/out-a")
    whole = run(f"{tmp_path}/b", f"{tmp_path}/out-b")
    assert before and set(before) < set(after) and after == whole


def test_keys_of_repeats_share_groups_and_may_be_null(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(state, "KEY_GROUPS", 2)
    big = 2**53 + 1
    rows = [(i, START + dt.timedelta(days=d), user, kind) for i, (d, user, kind) in enumerate([(0, None, "a"), (1, None, "a"), (0, big, "a"), (5, big, "a"), (0, big + 1, None), (1, 7, "b"), (30, 7, "b"), (60, 8, "b")])]
    schema = "event_id long, ts timestamp, user_id long, event_type string"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in")
    found = state.first_of_repeats(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), ["user_id", "event_type"], 48, "1 day")
    got = {tuple(r) for r in jobs.drained(found, str(tmp_path)).collect()}
    assert got == {(None, "a", 0, 1), (big, "a", 2, 0), (big, "a", 3, 0), (big + 1, None, 4, 0), (7, "b", 5, 0), (7, "b", 6, 0)}
