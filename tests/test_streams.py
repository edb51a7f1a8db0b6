import pandas as pd

from lumenframe.streaming import streams


def arrive(spark, folder, rows):
    spark.createDataFrame(rows, "k string, ts timestamp, x bigint").coalesce(1).write.mode("append").parquet(folder)


def at(seconds):
    return pd.Timestamp("2024-01-01", tz="UTC").to_pydatetime().replace(tzinfo=None) + pd.Timedelta(seconds=seconds).to_pytimedelta()


def test_inserts_resume_where_they_stopped(spark, tmp_path):
    folder, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    arrive(spark, folder, [("a", at(0), 1), ("a", at(0), 1), ("b", at(1), 2)])
    like = spark.read.parquet(folder)
    go = lambda: streams.run_to_end(streams.inserted_once(streams.file_stream(spark, folder, like), ["x"], "ts", "1 day"), out, mark)
    go()
    arrive(spark, folder, [("b", at(2), 2), ("c", at(3), 3)])
    go()
    go()
    assert sorted(r.x for r in spark.read.parquet(out).collect()) == [1, 2, 3]


def test_debounce_and_accepted_signals(spark, tmp_path):
    folder = str(tmp_path / "in")
    arrive(spark, folder, [("a", at(0), 1), ("a", at(30), 2), ("a", at(70), 3), ("b", at(0), 4), ("z", at(100_000), 9)])
    like = spark.read.parquet(folder)
    streams.run_to_end(streams.debounced(streams.file_stream(spark, folder, like), ["k"], "ts", "x", "60 seconds", "1 minute"), str(tmp_path / "d"), str(tmp_path / "dm"))
    got = {r.k: (r.x, r.changes) for r in spark.read.parquet(str(tmp_path / "d")).collect()}
    assert got["a"] == (3, 3) and got["b"] == (4, 1)
    streams.run_to_end(streams.accepted_signals(streams.file_stream(spark, folder, like), "k", "ts", 60), str(tmp_path / "s"), str(tmp_path / "sm"))
    assert sorted(r.x for r in spark.read.parquet(str(tmp_path / "s")).collect()) == [1, 3, 4, 9]


def test_merges_are_handed_every_batch(spark, tmp_path):
    folder, seen = str(tmp_path / "in"), []
    arrive(spark, folder, [("a", at(0), 1)])
    like = spark.read.parquet(folder)
    streams.merge_batches(streams.file_stream(spark, folder, like), lambda df, n: seen.append((n, df.count())), str(tmp_path / "m"))
    assert seen == [(0, 1)]
