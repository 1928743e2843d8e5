import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.llm import fill_middle


def by_hand(doc_id, text, unit, rate=100, spm_rate=50, seed="7"):
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]
    units = re.findall(r"[^\n]*\n|[^\n]+", text) if unit == "line" else list(text)
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    if h[3] % 100 < spm_rate:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def texts(n):
    r = random.Random(2)
    fixed = [None, "", "\n", "\n\n", "a", "a\n", "\na", "é\n中\n𝄞x", "x<P>y", "<S>", "<", "<S", "a<\n<b", "<S\n>\n<M\nx", "line\n" * 5000, "x" * 70000 + "\ny"]
    return fixed + ["".join(r.choice("ab é中𝄞\n\n\r<SPM>") for _ in range(r.randint(0, 40))) for _ in range(n)]


@pytest.mark.parametrize("unit,rate,spm_rate", [("line", 100, 50), ("char", 100, 50), ("line", 60, 0), ("line", 0, 50)])
def test_rows_equal_the_plain_form_and_go_back(spark, unit, rate, spm_rate):
    whole = texts(800)
    rows = [(i, t, "kept", 1, 2) for i, t in enumerate(whole)] + [(None, "a\nb\nc", "kept", 1, 2)] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, other string, Form int, h1 int")
    got = fill_middle.transform(df, rate=rate, spm_rate=spm_rate, unit=unit)
    assert got.columns == ["doc_id", "text", "other", "h1", "n", "form", "prefix_chars", "middle_chars", "output"]
    got = got.withColumn("back", fill_middle.restored(F.col("output"), F.col("form"))).collect()
    assert len(got) == len(rows)
    for r in got:
        text = "a\nb\nc" if r.doc_id is None else whole[r.doc_id] or ""
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == by_hand(r.doc_id, text, unit, rate, spm_rate)
        assert (r.back, r.other, r.h1) == (text, "kept", 2)


def test_ids_of_text_and_empty_tables(spark):
    df = spark.createDataFrame([("a", "x\ny\n")], "doc_id string, text string")
    r = fill_middle.transform(df).first()
    assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == by_hand("a", "x\ny\n", "line")
    assert fill_middle.transform(df.limit(0)).collect() == []
    with pytest.raises(ValueError):
        fill_middle.transform(df, unit="page")


def test_ranks_and_places_equal_counting():
    r = random.Random(4)
    for n in (0, 1, 7, 8, 9, 63, 64, 65, 500):
        data = np.array([r.choice(b" \n\nab\xc3\xa9\xa9") for _ in range(n)], dtype=np.uint8)
        matrix = fill_middle.WaveletMatrix(data)
        kinds = fill_middle.CLASSES[data]
        every = np.arange(n + 1)
        for kind in range(4):
            assert matrix.rank(kind, every).tolist() == [int((kinds[:i] == kind).sum()) for i in every]
        ends = (np.flatnonzero(data == 10) + 1).tolist()
        assert matrix.end_of_line(np.arange(1, len(ends) + 1)).tolist() == ends
