"""Ids of any type, and bounds that hold for what labels and long texts bring along."""

import random

import pytest
from pyspark.sql import functions as F

from tallyloom.llm import ctw, decision_list, ordinal, packing, suffix_dedup
from tallyloom.llm.components import components


def words(r, n):
    return " ".join(r.choice(["alpha", "beta", "gamma", "delta", "of", "the"]) + str(r.randrange(40)) for _ in range(n))


def test_ids_of_text_score_like_numbers(spark):
    r = random.Random(1)
    rows = [(i, f"é{i:03d}", words(r, r.randint(0, 30))) for i in range(60)] + [(None, None, "no id at all"), (3, "é003", None)]
    df = spark.createDataFrame(rows, "n long, name string, text string")
    training = F.coalesce(F.col("n") % 3 != 0, F.lit(False))
    by_number = {(x.n, x.n_bytes): (x.score, x.base_score, x.n_known) for x in ctw.scores(df, training, id_col="n").collect()}
    by_name = {(None if x.name is None else int(x.name[1:]), x.n_bytes): (x.score, x.base_score, x.n_known) for x in ctw.scores(df, training, id_col="name").collect()}
    assert by_number == by_name and len(by_name) == 62


def test_ids_of_text_keep_their_order_in_dedup(spark):
    r = random.Random(2)
    passage = words(r, 40)
    rows = [("b", passage + " tail one"), ("a", "head " + passage), (None, words(r, 30)), ("c", None), ("ab", passage[:150])]
    got = {x.name: x for x in suffix_dedup.dedup(spark.createDataFrame(rows, "name string, text string"), id_col="name").collect()}
    order = {None: 0, "a": 1, "ab": 2, "b": 3, "c": 4}
    numbered = spark.createDataFrame([(order[n], t) for n, t in rows], "doc_id long, text string")
    want = {x.doc_id: x for x in suffix_dedup.dedup(numbered).collect()}
    assert {order[n]: (x.kept, x.spans) for n, x in got.items()} == {i: (x.kept, x.spans) for i, x in want.items()}
    assert want[3].spans and want[2].spans and not want[1].spans


def test_long_texts_keep_their_partitions(spark):
    P = pytest.importorskip("public_tokenizers")
    long = spark.range(0, 32, 1, 8).select(F.col("id").alias("doc_id"), F.repeat(F.lit("some words of a long text "), 20_000).alias("text"))
    assert packing.pack(long, P.path("byte_bpe_50k.json")).rdd.getNumPartitions() == 8
    short = spark.range(0, 32, 1, 8).select(F.col("id").alias("doc_id"), F.lit("short").alias("text"))
    assert packing.pack(short, P.path("byte_bpe_50k.json")).rdd.getNumPartitions() == 1
    with pytest.raises(ValueError):
        packing.Ids(P.path("word_bpe_49k.json"))


def test_labelled_rows_are_bounded_after_they_meet_their_texts(spark, monkeypatch):
    r = random.Random(3)
    docs = spark.createDataFrame([(i % 2, words(r, 60) + f" own{i}") for i in range(400)], "doc_id long, text string")
    labels = spark.createDataFrame([(0, 0, 0), (1, 1, 1)], "doc_id long, toxic int, quality int")
    assert len(decision_list.labelled_sample(docs, labels, "quality", 0, 50, "doc_id", "text")) == 50
    seen = []
    fit = ordinal.fit
    monkeypatch.setattr(ordinal, "fit", lambda rows, grades, n: seen.append(len(rows)) or fit(rows, grades, n))
    ordinal.train(docs, labels, max_rows=50)
    assert seen and max(seen) <= 50


def test_components_take_more_tasks_than_the_table_has(spark, monkeypatch):
    from tallyloom.llm import components as module

    monkeypatch.setattr(module, "TASK_EDGES", 7)
    r = random.Random(4)
    edges = [(r.randrange(60), r.randrange(60)) for _ in range(50)]
    root = {i: i for i in range(60)}
    for _ in range(60):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = {x.node: x.root for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: root[i] for i in {x for e in edges if e[0] != e[1] for x in e}}
