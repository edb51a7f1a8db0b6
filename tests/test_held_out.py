import datetime

from lumenframe.plans.registry import QUERIES

LINE = "l_orderkey bigint, l_partkey bigint, l_quantity double"


def test_held_out_likes_leave_no_trace(spark, tmp_path):
    """Five users like the items 0 to 9; only held-out likes link item 100 to them, so it can't be recommended."""
    orders = [(u, u, datetime.datetime(2000, 1, 1)) for u in range(0, 30, 5)]
    lines = [(u, i, 50.0) for u in range(0, 30, 5) for i in (*range(1, 5), 100)]
    spark.createDataFrame(orders, "o_orderkey bigint, o_custkey bigint, o_orderdate timestamp").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame(lines, LINE).write.parquet(f"{tmp_path}/lineitem.parquet")
    [row] = QUERIES["op_m01_ranking_metrics"](spark, str(tmp_path)).collect()
    assert (row.users, row.recall, row.ndcg, row.mrr) == (6, 0.0, 0.0, 0.0)
