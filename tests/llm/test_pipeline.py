import random

import numpy as np
import pytest

import corpus_pipeline as C

P = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    r = random.Random(5)
    words = [f"w{i}" for i in range(900)]
    passage = " ".join(r.choice(words) for _ in range(60))
    rows = []
    for i in range(400):
        body = " ".join(r.choice(words) for _ in range(120))
        if i % 4 == 1:
            body += " " + passage + " é"
        if i % 10 == 3:
            body = body.upper().replace(" ", "!! ")
        if i % 10 == 7:
            body += " password=b7db7aa4a5fcc78305"
        rows.append((i, body, "en", "s", len(body)))
    rows += [(1200, rows[0][1], "en", "s", 1), (1201, rows[0][1], "en", "s", 1), (1202, None, None, None, None), (1203, "", "en", "s", 0), (None, rows[4][1] + " tail", "en", "s", 1)]
    folder = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, int(i % 10 != 3), 0) for i in range(400)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder, rows, passage


def test_stages_in_turn(spark, tables):
    folder, rows, passage = tables
    docs, seen = spark.read.parquet(f"{folder}/documents.parquet"), []
    for name, stage in C.STAGES[:-1]:
        columns = docs.columns
        docs = C.written(stage(spark, docs, folder), name)
        assert docs.columns == columns and docs.schema == spark.read.parquet(f"{folder}/documents.parquet").schema
        seen.append({x.doc_id: x for x in docs.collect()})
    quality, near, cut, clean = seen
    assert set(quality) == {i for i, t, *_ in rows if t and (i is None or i % 10 != 3 or i > 999)} - {1203}
    assert set(near) == set(quality) - {1200, 1201}
    assert set(cut) == set(near) and set(clean) == set(cut)
    holders = [i for i in sorted(x for x in near if x is not None) if i % 4 == 1]
    assert passage in cut[holders[0]].text and all(passage not in cut[i].text for i in holders[1:])
    assert all(cut[i].text == near[i].text for i in near if i is not None and i % 4 != 1 and i != 4)
    for i, x in clean.items():
        assert "b7db7aa4a5fcc78305" not in x.text and x.n_chars == len(x.text)
    assert "[REDACTED]" in clean[7].text


def test_run_packs_what_is_left(spark, tables):
    folder, _, _ = tables
    got = C.run(spark, folder).collect()
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in C.STAGES[:-1]:
        docs = C.written(stage(spark, docs, folder), "again")
    coder = tokenizers.Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want = sorted((-1 if x.doc_id is None else x.doc_id, coder.encode(x.text, add_special_tokens=False).ids + [0]) for x in docs.collect())
    pieces = {}
    for x in got:
        pieces.setdefault(-1 if x.doc_id is None else x.doc_id, []).append((x.start, np.frombuffer(bytes(x.ids), "<u4").tolist()))
    assert sorted((i, [t for _, part in sorted(p) for t in part]) for i, p in pieces.items()) == want


def test_empty_documents(spark, tables):
    folder, _, _ = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in C.STAGES:
        assert stage(spark, docs, folder).count() == 0
