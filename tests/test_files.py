import datetime
import json

import pytest
from lumenframe.sources import files as X
from pyspark.sql import functions as F

DAY = datetime.date(2024, 1, 2)


def test_sniff_and_csv(spark, tmp_path):
    assert [X.sniff(b) for b in (b"PK\x03\x04..", b"\xef\xbb\xbf <a/>", b" [1]", b"Name,Year\n")] == ["zip", "xml", "json", "csv"]
    (tmp_path / "a.csv").write_bytes("﻿Name,YEAR\r\n\"A, \"\"B\"\"\",1990\r\n".encode())
    df = X.read_csv(spark, str(tmp_path / "a.csv"))
    assert df.columns == ["name", "year"] and tuple(df.first()) == ('A, "B"', "1990") and X.data_lines(spark, str(tmp_path / "a.csv")) == 1


def test_merged_history(spark):
    rows = [("Film", 1990, None, 4.5, 5.0, DAY, None), (" film", 1990, None, None, None, DAY, None), ("Film", 1990, None, 8.0, 10.0, datetime.date(2023, 1, 1), "watchlist"), ("B", None, "tt1", 0.0, 10.0, None, "Plan to Watch"), ("Bee", 2000, "tt1", None, None, None, None), (None, 1990, None, 5.0, 5.0, None, None)]
    df = spark.createDataFrame(rows, "title string, year int, imdb_id string, rating double, scale double, watched_on date, status string")
    got = {r.key: (r.halves, len(r.watched), r.watchlist) for r in X.merged_history(df).collect()}
    assert got == {"film|1990": (9, 2, False), "tt1": (None, 0, True)}


def test_probe(spark):
    good = {"streams": [{"codec_type": "audio", "codec_name": "aac", "tags": {"language": "ENG"}}, {"codec_type": "video", "codec_name": "h264", "width": 1920, "height": 800}, {"codec_type": "audio", "tags": {"language": "eng"}}, {"codec_type": "audio", "tags": {"language": "jpn"}}], "format": {"duration": "61.6", "tags": {"title": " "}}}
    df = spark.createDataFrame([(json.dumps(good),), ("nothing",), (None,), ("{}",)], "t string").coalesce(1).select(X.probe(F.col("t")).alias("p"))
    a, *rest = [r.p for r in df.collect()]
    assert (a.seconds, a.video_codec, a.width, a.audio_codec, a.languages, a.title) == (62, "h264", 1920, "aac", ["en", "ja"], None) and rest == [None] * 3


def test_files_and_subtitles(spark):
    paths = [("m/Film.2019.mkv", 9 << 30), ("m/Film.2019.en.forced.srt", 1), ("m/Subs/French.srt", 1), ("m/film.sample.mkv", 5), ("s/E1.mkv", 9), ("s/E2.mkv", 9), ("s/E1.de.srt", 1), ("s/x.srt", 1), ("s/.E3.mkv", 9), ("t/a.txt", 1)]
    df = spark.createDataFrame(paths, "path string, size bigint")
    assert {r.path for r in X.media_files(df).collect()} == {"m/Film.2019.mkv", "s/E1.mkv", "s/E2.mkv"}
    got = {(r.video, r.subtitle, r.language, r.forced) for r in X.subtitles_beside(df.filter("path not like '%sample%' and path not like '%/.%'")).collect()}
    assert got == {("m/Film.2019.mkv", "m/Film.2019.en.forced.srt", "en", True), ("m/Film.2019.mkv", "m/Subs/French.srt", "fr", False), ("s/E1.mkv", "s/E1.de.srt", "de", False)}


def test_cues_and_traces(spark):
    ass = "[Events]\nDialogue: 0,0:00:01.50,0:00:02.00,Default,,0,0,0,,{\\i1}Hello,\\Nyou\nComment: 0,x\n"
    df = spark.createDataFrame([("a", ass), ("b", "WEBVTT\n"), ("c", "1\n00:00:01,000 --> 00:00:02,000\nHi"), ("d", "text"), ("e", None)], "k string, t string")
    assert {r.k: r.f for r in df.select("k", X.subtitle_format(F.col("t")).alias("f")).collect()} == {"a": "ass", "b": "vtt", "c": "srt", "d": None, "e": None}
    cues = X.ass_cues(df, "k", "t")
    assert [tuple(r)[2:] for r in cues.collect()] == [(1500, 2000, "Hello,\nyou")]
    assert X.srt_files(cues, "k").first().text == "1\n00:00:01,500 --> 00:00:02,000\nHello,\nyou\n"
    row = spark.createDataFrame([("# x\n2 3\n1 z 1",)], "t string").select(X.trace(F.col("t")).alias("x")).first()
    assert row.x == [False, False, True, True, True, False, True]


def test_artefacts(spark, tmp_path):
    df = spark.createDataFrame([(1, [1, 2]), (2, [3, 4])], "id bigint, v array<tinyint>")
    X.write_artefact(df, str(tmp_path / "a"), "id", "v", "m", 3)
    assert X.read_artefact(spark, str(tmp_path / "a"), "m", 3).count() == 2 and X.sizes(spark, str(tmp_path / "a")).count() > 1
    with pytest.raises(ValueError):
        X.read_artefact(spark, str(tmp_path / "a"), "m", 4)
    df.withColumn("v", F.reverse("v")).withColumnRenamed("id", "key").withColumnRenamed("v", "vector").write.mode("overwrite").parquet(str(tmp_path / "a/vectors"))
    with pytest.raises(ValueError):
        X.read_artefact(spark, str(tmp_path / "a"), "m", 3)


def test_cache(spark):
    s = spark.createDataFrame([("u", "old", 1), ("v", "x", 1)], "url string, body string, at int")
    now = X.put(s, spark.createDataFrame([("u", "new", 1), ("w", "y", 3), ("v", "late", 0)], "url string, body string, at int"), "url", "at")
    assert {tuple(r) for r in now.collect()} == {("u", "new", 1), ("v", "x", 1), ("w", "y", 3)}
    touched = X.touch(now, s.select("url").filter("url = 'v'"), "url", "at", F.lit(9))
    assert {(r.url, r.at) for r in X.purge(touched, F.when(F.col("at") < 3, "expired").otherwise("fresh")).collect()} == {("v", 9), ("w", 3)}
    assert spark.range(1).select(X.serveable(F.lit("stale"), F.lit(False)).alias("a"), X.serveable(F.lit("stale"), F.lit(True)).alias("b")).first() == (False, True)


def test_new_rows_are_written_once(spark, tmp_path):
    from lumenframe.sources.readers import write_new_rows

    df = spark.createDataFrame([(1, "a"), (1, "b"), (None, "c"), (None, "d"), (2, "e")], "k int, v string")
    path = str(tmp_path / "t")
    assert [write_new_rows(df, path, ["k"]) for _ in range(2)] == [3, 0]
    assert write_new_rows(df.unionByName(spark.createDataFrame([(3, "f")], "k int, v string")), path, ["k"]) == 1 and spark.read.parquet(path).count() == 4
