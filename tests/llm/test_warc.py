import hashlib
import random

from pyspark.sql import functions as F

from tallyloom.llm import warc


def test_loser_tree_merges_like_sorting():
    r = random.Random(1)
    for k in (0, 1, 2, 3, 7, 16):
        runs = [sorted(r.randint(0, 50) for _ in range(r.randint(0, 30))) for _ in range(k)]
        assert list(warc.LoserTree(runs, key=lambda x: x)) == sorted(x for run in runs for x in run)


def test_url_keys_group_sites():
    assert warc.url_key("http://a.example.com/x?q=1") == "com,example,a)/x?q=1"
    assert warc.url_key("https://EXAMPLE.com") == "com,example)/"
    assert warc.url_key("http://[bad") == ")http://[bad"


def _captures(spark):
    r = random.Random(3)
    payloads = ["<p>" + "é中x" * n for n in (1, 20, 40, 41, 60)] + ["WARC/1.1\r\n\r\n" * 20, "", None]
    rows = [(i * 7 % 401, r.choice(["http://a.example.com/1", "http://b.example.com/", None, "http://a.example.com/1\r\nX: y"]), r.randint(0, 10**6), r.choice(payloads)) for i in range(300)]
    rows += [(None, "http://c.example.com", 5, payloads[3]), (None, "http://c.example.com", None, "unique" * 40), rows[0], rows[0]]
    df = spark.createDataFrame(rows, "id long, url string, s long, payload string").repartition(5)
    return rows, df.select("id", "url", F.timestamp_seconds("s").alias("at"), "payload", F.lit(1).alias("first"), F.lit("x").alias("file"))


def test_archives_read_back(spark):
    rows, df = _captures(spark)
    got = warc.captures_index(df, least_bytes=100, file_bytes=23 * warc.FIRST_CLASS).collect()
    least = {}
    for i, _, _, p in rows:
        if i is not None:
            least[p] = min(least.get(p, i), i)
    want = []
    for i, _, _, p in rows:
        data = (p or "").encode()
        again = len(data) >= 100 and p in least and i != least[p]
        want.append((-1 if i is None else i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", least[p] if again else -1))
    assert sorted((-1 if x.id is None else x.id, x.payload_bytes, x.payload_digest, x.record_type, -1 if x.refers_to is None else x.refers_to) for x in got) == sorted(want)
    assert all(x.intact for x in got)
    assert len({x.file for x in got}) > 5
    # collect() keeps the order of partitions: the whole index is one sorted history
    order = [(x.url_key, x.timestamp, -1 if x.id is None else x.id) for x in got]
    assert order == sorted(order)


def test_runs_are_merged_in_passes_of_bounded_fan_in():
    r = random.Random(5)
    entry = lambda: ("k%d" % r.randint(0, 9), "2024", r.choice([None, r.randint(0, 99)]), "response", None, 1, "d", True, "f%d" % r.randint(0, 40), r.randint(0, 10**6), 1)
    rows = [sorted((entry() for _ in range(r.randint(1, 30))), key=warc.order_of) for _ in range(70)]
    batches = [warc._batch(run) for run in rows]
    runs = warc.natural_runs([*batches, warc._batch(rows[0]).slice(0, 0)])
    assert 2 < len(runs) <= 70
    for fan_in in (2, 5, 64, 100):
        got = [x for b in warc.merge_runs(list(runs), fan_in) for x in warc._rows([b])]
        assert [warc.order_of(x) for x in got] == sorted(warc.order_of(x) for run in rows for x in run)
    assert list(warc.merge_runs([])) == []


def test_files_are_bounded_in_bytes(spark, tmp_path):
    r = random.Random(8)
    rows = [(i, "http://a.example.com/", "%07d" % r.randint(0, 10**7) * r.choice([1, 50, 5000, 30_000])) for i in range(80)]
    df = spark.createDataFrame(rows, "id long, url string, payload string").coalesce(2).withColumn("at", F.timestamp_seconds("id"))
    warc.write_archives(df, f"file://{tmp_path}/w", file_bytes=100_000)
    sizes = [(len(list(warc.records(f.read_bytes()))), f.stat().st_size) for f in tmp_path.rglob("part-*")]
    assert sum(n for n, _ in sizes) == 80 and all(size < 110_000 or n == 1 for n, size in sizes)
    assert {x.id for x in warc.read_archives(spark, f"file://{tmp_path}/w").where("intact").collect()} == set(range(80))


def test_stamps_are_utc_in_any_session(spark):
    df = spark.createDataFrame([(1, "http://a.example.com/", 1_704_067_200, "x"), (2, "http://a.example.com/", -1, "y")], "id long, url string, s long, payload string")
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        for z in ("Asia/Tokyo", "America/New_York", "UTC"):
            spark.conf.set("spark.sql.session.timeZone", z)
            got = warc.captures_index(df.select("id", "url", F.timestamp_seconds("s").alias("at"), "payload")).collect()
            assert {x.id: x.timestamp for x in got} == {1: "20240101000000", 2: "19691231235959"}
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_a_damaged_archive_raises():
    good = b"WARC/1.1\r\nContent-Length: 2\r\n\r\nab\r\n\r\n"
    assert [(s, b, e) for _, s, b, e in warc.records(good * 2)] == [(0, 31, 33), (37, 68, 70)]
    for bad in (b"junk", good[:-1], good.replace(b"2", b"3")):
        try:
            list(warc.records(bad))
        except ValueError:
            continue
        raise AssertionError(bad)


def test_empty_table(spark):
    _, df = _captures(spark)
    assert warc.captures_index(df.limit(0)).count() == 0
