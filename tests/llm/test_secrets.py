import hashlib
import random
import re
from math import log2

from tallyloom.llm import secrets as S
from pyspark.sql import functions as F

ASSIGN = re.compile(r"""((?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def base_spans(text):
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m.group()) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m.group()) >= 24]
    return sorted(out)


def entropy(window):
    n = len(window)
    return log2(n) - sum(window.count(c) * log2(window.count(c)) for c in set(window)) / n


def all_spans(text):
    base = base_spans(text)
    out = list(base)
    for m in re.finditer(S.CANDIDATE, text):
        run, a, b = m.group(), m.start(), m.end()
        if any(x < b and a < y for x, _, y in base) or any(re.search(p, run) for p in S.ALLOWED):
            continue
        bits = next(bits for _, p, bits in S.CLASSES if re.search(p, run))
        good = [i for i in range(len(run) - S.WINDOW + 1) if entropy(run[i : i + S.WINDOW]) >= bits - 1e-9]
        if good:
            out.append((a + good[0], 3, a + good[-1] + S.WINDOW))
    return sorted(out)


def texts():
    r = random.Random(11)
    hexes = "0123456789abcdef"
    pieces = [
        lambda: "password=" + "".join(r.choice(hexes) for _ in range(r.randint(3, 20))),
        lambda: "Api_Key: '" + "".join(r.choice(S.ALPHABET) for _ in range(r.randint(3, 40))) + "'",
        lambda: "AKIA" + "".join(r.choice("ABCDEFGH0123456789") for _ in range(r.randint(10, 25))),
        lambda: "".join(r.choice(hexes) for _ in range(r.randint(15, 60))),
        lambda: "".join(r.choice(S.ALPHABET) for _ in range(r.randint(15, 60))),
        lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(15, 60))),
        lambda: "token=token:abcdefgh",
        lambda: "1234567890" * r.randint(1, 4),
        lambda: "héllo wörld 中文 𝄞",
        lambda: r.choice(["=", " ", "\n", '"', ": "]),
    ]
    fixed = [None, "", " ", "secret", "secret:", "AKIA" * 20, "token = " * 700 + "abcdefg", "f" * 5000, ("tOkEn=abcdef " * 900)]
    return fixed + [r.choice([" ", "", "\n"]).join(r.choice(pieces)() for _ in range(r.randint(0, 9))) for _ in range(250)]


def test_spans_equal_brute_force(spark):
    rows = [(i, t, "x") for i, t in enumerate(texts())]
    rows += rows[5:9]
    df = spark.createDataFrame(rows, "doc_id long, text string, kind string")
    found = S.scan(df).select("doc_id", "kind", S.listed(F.col("secret_spans")).alias("spans"), S.redacted(F.coalesce("text", F.lit("")), F.col("secret_spans"), "#").alias("clean")).collect()
    assert len(found) == len(rows)
    by_id = {i: t or "" for i, t, _ in rows}
    for row in found:
        text = by_id[row.doc_id]
        want = all_spans(text)
        assert row.spans == ",".join(f"{S.KINDS[k]}:{a}:{b}" for a, k, b in want), text[:200]
        mask = [any(a <= i < b for a, _, b in want) for i in range(len(text))]
        at, clean = 0, ""
        for a, _, b in want:
            if a >= at:
                clean += text[at:a] + "#"
            at = max(at, b)
        assert row.clean == clean + text[at:] and len(mask) == len(text)


def test_digest_of_no_spans_and_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert S.scan(df).count() == 0
    one = S.scan(spark.createDataFrame([(1, "plain words only")], "doc_id long, text string"))
    assert one.select(F.sha2(S.listed(F.col("secret_spans")), 256)).first()[0] == hashlib.sha256(b"").hexdigest()


def test_a_run_of_a_million_characters_and_many_spans(spark):
    r = random.Random(6)
    letters = "".join(r.choice(S.ALPHABET) for _ in range(5000))
    long_run = "x=" + letters * 200
    many = " ".join(r.choice(["deadbeef" * 4, "AKIA" + "Q7" * 9, "pässword=abcdefgh", letters[i : i + 40]]) for i in range(3000))
    words = "ab-" * 200_000
    rows = [(1, long_run), (2, many), (3, words)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    scanned = S.scan(df).withColumn("clean", S.redacted(F.col("text"), F.col("secret_spans"), "#"))
    got = {x.doc_id: x for x in scanned.collect()}
    [(first, kind, last)] = map(tuple, got[1].secret_spans)
    reaches = [entropy(long_run[i : i + S.WINDOW]) >= 3.7 - 1e-9 for i in range(5002)]
    assert kind == 3 and first == reaches.index(True) and got[1].clean == long_run[:first] + "#" + long_run[last:]
    tail = [i for i in range(len(long_run) - 200, len(long_run) - S.WINDOW + 1) if entropy(long_run[i : i + S.WINDOW]) >= 3.7 - 1e-9]
    assert last == tail[-1] + S.WINDOW
    want = all_spans(many)
    assert [tuple(x) for x in got[2].secret_spans] == [(a, k, b) for a, k, b in want]
    assert got[3].secret_spans == [] and got[3].clean == words
    at, clean = 0, ""
    for a, _, b in want:
        if a >= at:
            clean += many[at:a] + "#"
        at = max(at, b)
    assert got[2].clean == clean + many[at:]


def test_other_columns_stay_and_a_column_of_the_same_name_is_replaced(spark):
    df = spark.createDataFrame([(1, "token=abcdefgh", 5, "y", 7)], "doc_id long, text string, Secret_Spans int, __scan_text string, in_0 int")
    got = S.scan(df)
    assert got.columns == ["doc_id", "text", "__scan_text", "in_0", "secret_spans"]
    row = got.first()
    assert tuple(row[:4]) == (1, "token=abcdefgh", "y", 7) and [tuple(x) for x in row.secret_spans] == [(0, 0, 14)]
