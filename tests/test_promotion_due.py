import datetime

import __spark_entry__ as entry


def test_everyone_due_is_ranked(spark, tmp_path):
    spark.createDataFrame([(i, -1.0 if i == 3 else 5.0) for i in range(1, 121)], "c_custkey long, c_acctbal double").write.parquet(f"{tmp_path}/customer.parquet")
    old, new = datetime.datetime(1998, 7, 1), datetime.datetime(2001, 7, 1)
    orders = [(1, "F", old), (1, "P", new), (2, "F", new), (3, "F", old)]
    spark.createDataFrame(orders, "o_custkey long, o_orderstatus string, o_orderdate timestamp").write.parquet(f"{tmp_path}/orders.parquet")
    got = [(x.c_custkey, x.score) for x in entry.queries()["w15_promotion_due"](spark, str(tmp_path)).collect()]
    assert len(got) == 120 and got[:3] == [(2, 100), (3, 53), (1, 43)] and {s for _, s in got[3:]} == {0}
