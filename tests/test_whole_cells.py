import __spark_entry__ as entry


def test_whole_text_is_kept(spark, tmp_path):
    spark.createDataFrame([(1, "=" + "a" * 90), (2, "b" * 90), (3, None), (4, "")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {x.doc_id: x.shown for x in entry.queries()["n26_whole_cells"](spark, str(tmp_path)).collect()}
    assert got == {1: "'=" + "a" * 90, 2: "b" * 90, 3: None, 4: ""}
