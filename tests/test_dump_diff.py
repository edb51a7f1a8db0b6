import datetime

from lumenframe.plans.registry import QUERIES

DUMPS = "mirror_id string, snapshot_no int, imdb_id string, title string, year int, votes bigint, loaded_at timestamp_ntz"


def test_every_mirror_and_dump_is_compared(spark, tmp_path):
    at = lambda n: datetime.datetime(2024, 1, n)
    rows = [("m7", 2, "a", "A", 1990, 5, at(1)), ("m7", 2, "b", "B", 1991, 6, at(1)), ("m7", 2, "c", "C", 1992, 1, at(1)), ("m7", 5, "a", "A", 1990, 9, at(2)), ("m7", 5, "a", "A", 1990, 5, at(3)), ("m7", 5, "d", "D", 1991, 6, at(2)), ("m7", 5, "c", "C", 1992, 2, at(2)), ("m8", 1, "x", "X", 1990, 1, at(1))]
    spark.createDataFrame(rows, DUMPS).write.parquet(f"{tmp_path}/title_snapshots.parquet")
    spark.createDataFrame([("c", 2), ("x", 3), ("z", 1)], "imdb_id string, votes bigint").write.parquet(f"{tmp_path}/media_items.parquet")
    got = {tuple(r) for r in QUERIES["op_e05_scan_diff"](spark, str(tmp_path)).collect()}
    assert got == {("m7", 5, "a", "unchanged"), ("m7", 5, "b", "missing"), ("m7", 5, "c", "changed"), ("m7", 5, "d", "new")}
    assert [tuple(r) for r in QUERIES["op_j23_moved"](spark, str(tmp_path)).collect()] == [("m7", 5, "b", "d")]
    assert {tuple(r) for r in QUERIES["op_st09_refresh"](spark, str(tmp_path)).collect()} == {("c", 2, None, "same"), ("x", 3, 1, "moved"), ("z", 1, None, "new")}
