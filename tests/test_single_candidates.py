import __spark_entry__ as entry


def test_a_name_of_two_parts_is_no_link(spark, tmp_path):
    spark.createDataFrame([(1, "blue bolt"), (2, "blue nut"), (3, "Red nut"), (4, "green nut")], "p_partkey long, p_name string").write.parquet(f"{tmp_path}/part.parquet")
    said = [(1, 1, "the blue one"), (1, 2, "the red RED one"), (1, 3, "red or green"), (1, 4, "none"), (2, 1, "blue and red")]
    spark.createDataFrame(said, "conv_id long, turn long, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert [tuple(x) for x in entry.queries()["c15_single_candidates"](spark, str(tmp_path)).collect()] == [(1, 2, 3)]
