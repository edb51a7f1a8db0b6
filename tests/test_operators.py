import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lumenframe.functions import text as T
from lumenframe.functions.filenames import parse_name
from lumenframe.operators import folds, recommend, timeseries, vectors
from lumenframe.operators.selection import normal_cdf, plausibility
from lumenframe.sources import readers


def test_nearest_against_brute_force_and_recall(spark):
    rng = np.random.default_rng(1)
    m = rng.standard_normal((400, 64))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)] + [(900, [0.0] * 64), (901, None)], "vec_id bigint, embedding array<float>")
    q = df.filter("vec_id % 20 = 0")
    exact = vectors.nearest(df, q, "vec_id", "embedding", 5)
    got = {}
    for r in exact.collect():
        got.setdefault(r.query, {})[r["rank"]] = r.id
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    for i in range(0, 400, 20):
        order = [j for j in np.lexsort((np.arange(400), -np.round(u @ u[i], 6))) if j != i][:5]
        assert list(map(int, order)) == [got[i][k] for k in range(1, 6)]


def test_cells_find_neighbours_and_take_inserts(spark, monkeypatch):
    rng = np.random.default_rng(1)
    m = (rng.standard_normal((12, 16))[:, None, :] + 0.4 * rng.standard_normal((12, 50, 16))).reshape(600, 16)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)] + [(901, None)], "vec_id bigint, embedding array<float>")
    q = df.filter("vec_id % 20 = 0")
    exact = vectors.nearest(df, q, "vec_id", "embedding", 5)
    centres = vectors.fit_cells(df, "vec_id", "embedding")
    index = vectors.in_cells(df.filter("vec_id < 300"), "vec_id", "embedding", centres)
    index = vectors.insert(index, df.filter("vec_id >= 250"), "vec_id", "embedding", centres)
    assert index.count() == index.select("id").distinct().count() == 600
    near = vectors.nearest_in_cells(index, q, "vec_id", "embedding", centres, 5)
    assert vectors.recall_at(near, exact).first().recall >= 0.95 and near.agg(F.max("candidates")).first()[0] < 500
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 7)
    key = lambda rows: sorted((r.query, r.id, r["rank"]) for r in rows)
    assert key(vectors.nearest(df, q, "vec_id", "embedding", 5).collect()) == key(exact.collect())
    assert vectors.fit_cells(df.limit(0), "vec_id", "embedding").probes == 0


def test_edited_modes(spark):
    modes = spark.createDataFrame([(1, 1, 0.5), (1, 2, 0.5), (2, 1, 1.0), (3, 1, 0.4), (3, 2, 0.6)], "profile int, mode int, weight double")
    words = spark.createDataFrame([(1, 1, "more"), (2, 1, "not_me"), (3, 2, "less")], "profile int, mode int, word string")
    got = {(r.profile, r.mode): round(r.weight, 4) for r in vectors.edited_modes(modes, words, spark.createDataFrame([(2,), (3,), (3,), (4,)], "profile int")).collect()}
    assert got == {(1, 1): 0.6667, (1, 2): 0.3333, (2, None): 1.0, (3, 1): round(0.4 / 0.7 * 0.8, 4), (3, 2): round(0.3 / 0.7 * 0.8, 4), (3, None): 0.2, (4, None): 1.0}


def test_modes_find_separate_directions():
    rng = np.random.default_rng(2)
    m = np.concatenate([c + 0.05 * rng.standard_normal((8, 6)) for c in np.eye(6)[:3]])
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    own = vectors.modes(m, np.ones(24))
    assert len({tuple(own[i : i + 8]) for i in (0, 8, 16)}) == 3 and all(len(set(own[i : i + 8])) == 1 for i in (0, 8, 16))
    assert vectors.modes(m[:3], np.ones(3)).tolist() == [0, 0, 0]


def test_quotas(spark):
    cases = {1: ([0.5, 0.3, 0.2], [5, 3, 2]), 2: ([0.98, 0.01, 0.01], [8, 1, 1]), 3: ([0.0, 0.0], [0, 0]), 4: ([0.7, 0.2, 0.1], [7, 2, 1]), 5: ([1.0, 1.0, 1.0], [4, 3, 3]), 6: ([-1.0, 1.0, None], [0, 10, 0]), 7: ([0.48, 0.48] + [0.01] * 4, [3, 3, 1, 1, 1, 1]), 8: ([1.0] * 12, [1] * 10 + [0, 0])}
    rows = [(k, g, w) for k, (ws, _) in cases.items() for g, w in enumerate(ws)]
    got = recommend.quotas(spark.createDataFrame(rows, "k int, g int, w double"), ["k"], "g", "w", 10).collect()
    assert {k: [r.places for r in sorted((r for r in got if r.k == k), key=lambda r: r.g)] for k in cases} == {k: want for k, (_, want) in cases.items()}


def test_rail_caps():
    rng = np.random.default_rng(3)
    kind = np.array(["a", "b", None] * 10, dtype=object)
    chosen = recommend.diversified(rng.random(30), np.eye(30), {"kind": kind}, {"kind": 2}, 10)
    assert len(chosen) == len(set(chosen)) == 10 and sum(kind[i] == "a" for i in chosen) <= 2


def test_allocation_respects_cap_and_floor():
    places = recommend.allocate([50, 1, 1], [1, 50, 50], 20, seed=1)
    assert sum(places) == 20 and min(places) >= 1 and max(places) <= 10


def test_folds_against_plain_loops(spark):
    r = random.Random(4)
    rows = [(r.choice(["a", "b", None]), (pd.Timestamp("2024-01-01") + pd.Timedelta(seconds=r.randrange(5000))).to_pydatetime(), i, r.choice([None, 1.0, 2.0])) for i in range(600)]
    df = spark.createDataFrame(rows, "k string, ts timestamp_ntz, id bigint, x double")
    got = {x.id: x.accepted for x in folds.accepted(df, ["k"], "ts", "id", 60).collect()}
    smooth = {x.id: x.smoothed for x in folds.smoothed(df, ["k"], ["ts", "id"], "x").collect()}
    for k in ("a", "b", None):
        last = mean = None
        for _, ts, i, x in sorted((y for y in rows if y[0] == k), key=lambda y: y[1:3]):
            ok = last is None or (ts - last).total_seconds() >= 60
            last = ts if ok else last
            mean = mean if x is None else x if mean is None else 0.8 * mean + 0.2 * x
            assert got[i] == ok and (smooth[i] is None or smooth[i] != smooth[i] if mean is None else smooth[i] == pytest.approx(mean))
    waits = folds.bucket_waits(df, ["k"], "ts", "id", 0.01, 2).collect()
    assert min(w.wait for w in waits) == 0 and max(w.wait for w in waits) > 0
    assert folds.accepted(df.limit(0), ["k"], "ts", "id").count() == 0


def test_alignment_finds_scale_and_offset(spark):
    rng = np.random.default_rng(5)
    starts = np.cumsum(rng.integers(1500, 6000, 80))
    ends = starts + rng.integers(500, 1400, 80)
    voice = timeseries.render(starts + 1230, ends + 1230, 60_000)
    films = [("moved", voice.tolist(), starts.tolist(), ends.tolist()), ("noise", rng.integers(0, 2, 5000).astype(float).tolist(), [10, 900], [400, 1200]), ("none", [], [], [])]
    df = spark.createDataFrame(films, "film string, voice array<double>, starts array<bigint>, ends array<bigint>")
    got = {r.film: r for r in timeseries.align_films(df).collect()}
    assert got["moved"].scale == 1.0 and abs(got["moved"].offset_ms - 1230) <= 20
    assert got["noise"].offset_ms is None and got["none"].offset_ms is None


def test_smoothed_flags(spark):
    flags = [0, 1, 1, 0, 1, 1, 1, 0, 0, 0, 1, 0, 0]
    df = spark.createDataFrame([("k", i, bool(f)) for i, f in enumerate(flags)], "k string, i int, f boolean")
    got = timeseries.smoothed_flags(df, ["k"], "i", "f", bridge=2, least=3).collect()
    assert [(r.start, r.length) for r in got] == [(1, 6)]


def test_query_reading(spark):
    cases = {
        "heist films directed by jane doe in 1994": ("jane doe", 1994, 1994, None, None, "heist films"), "in love in 1994": (None, 1994, 1994, None, None, "in love"),
        "between 1980 and 1989 space": (None, 1980, 1989, None, None, "space"), "1990s comedies under 90 minutes": (None, 1990, 1999, None, 90, "comedies"),
        "before 1950": (None, None, 1949, None, None, ""), "after 2010 robots": (None, 2011, None, None, None, "robots"), "in 1200": (None, None, None, None, None, ""), "": (None, None, None, None, None, ""),
        "'20s jazz": (None, 2020, 2029, None, None, "jazz"), "'90s crime over two hours": (None, 1990, 1999, 120, None, "crime"), "short, less than half an hour": (None, None, None, None, 30, "short"),
        "since 2001 longer than 3 hours": (None, 2001, None, 180, None, ""), "understated 5 minimalist films": (None, None, None, None, None, "understated 5 minimalist films"),
    }
    df = spark.createDataFrame([(q,) for q in cases], "q string").select("q", T.query_reading(F.col("q")).alias("r")).select("q", "r.*")
    for r in df.collect():
        assert (r.director, r.year_from, r.year_to, r.least_minutes, r.most_minutes, r.rest) == cases[r.q], r.q


def test_small_functions(spark):
    row = spark.createDataFrame([("https://a/b?x=1&token=s&y=2", "https://a?key=1", "1:02:03", 1.5)], "u string, v string, c string, x double").select(
        T.cache_key(F.col("u")).alias("u"), T.cache_key(F.col("v")).alias("v"), T.clock_seconds(F.col("c")).alias("c"), normal_cdf(F.col("x")).alias("p"),
        T.import_form(F.lit("The  Spider-Man & Co")).alias("i"), plausibility(F.lit(100), F.lit(0), F.lit(1080), F.lit(None).cast("double")).alias("none"),
    ).first()
    assert (row.u, row.v, row.c, row.i) == ("https://a/b?x=1&y=2", "https://a", 3723, "spider man and co") and row.p == pytest.approx(0.9331928, abs=1e-6)


@pytest.mark.parametrize(
    "name, want",
    [
        ("The.Long.Road.S02E03-E05.1080p.WEB-DL.x264-CREW.mkv", ("The Long Road", None, 2, 3, 5, 1080, "webdl", "h264")),
        ("Old Film (1968) [BluRay] 2160p.mkv", ("Old Film", 1968, None, None, None, 2160, "bluray", None)),
        ("[Crew] Some Show - 07 [720p].mkv", ("Some Show", None, None, 7, None, 720, None, None)),
        ("2012.2009.1080p.BluRay.mkv", ("2012", 2009, None, None, None, 1080, "bluray", None)), ("plain name.avi", ("plain name", None, None, None, None, None, None, None)),
    ],
)
def test_file_names(name, want):
    p = parse_name(name)
    assert (p["title"], p["year"], p["season"], p["episode"], p["last_episode"], p["resolution"], p["source"], p["codec"]) == want


def test_readers(spark, tmp_path):
    (tmp_path / "t.tsv").write_text("tconst\taverageRating\tnumVotes\ntt1\t7.5\t10\nshort\n\ntt2\t\\N\t\ntt3\t1\t2\t3\n")
    rows = readers.read_tsv(spark, str(tmp_path / "t.tsv"), readers.DATASETS["title.ratings"])
    assert sorted(map(tuple, rows.collect())) == [("tt1", "7.5", "10"), ("tt2", None, None)]
    assert rows.select("tconst").count() == 2
    with pytest.raises(ValueError, match="missing"):
        readers.read_tsv(spark, str(tmp_path / "t.tsv"), ["nope"])
    (tmp_path / "r.csv").write_text("userId,movieId,rating,timestamp\n1,2,4.5,9\nx,2,4,9\n1,3,9,9\n")
    assert [tuple(r) for r in readers.read_ratings_csv(spark, str(tmp_path / "r.csv")).collect()] == [(1, 2, 4.5)]
    lines = ["#EXTM3U", '#EXTINF:-1 group="a,b",One Film (1999)', "http://x/1", "#EXTINF:-1,Two", "ftp://x/2", "http://x/3"]
    got = readers.playlist_entries(spark.createDataFrame([("p", i, x) for i, x in enumerate(lines)], "p string, n int, line string"), "p", "n", "line").collect()
    assert [(r.title, r.year, r.url) for r in got] == [("One Film", 1999, "http://x/1"), (None, None, "http://x/3")]
    srt = "1\r\n00:00:01,500 --> 00:00:02,000\r\nHi\r\nthere\r\n\r\nbad\r\n\r\n2\r\n00:01:00,000 --> 00:01:01,250\r\nBye\r\n"
    cues = readers.subtitle_cues(spark.createDataFrame([("s", srt)], "k string, t string"), "k", "t")
    assert [(r.start_ms, r.end_ms, r.words) for r in cues.orderBy("n").collect()] == [(1500, 2000, "Hi\nthere"), (60000, 61250, "Bye")]
    assert readers.retimed(cues, 1.0, -2000).orderBy("n").first().start_ms == 0
    table = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "id int, x string")
    assert readers.write_new_rows(table, str(tmp_path / "out"), ["id"]) == 2
    assert readers.write_new_rows(table, str(tmp_path / "out"), ["id"]) == 0


def test_speech_is_found_in_noise():
    rng = np.random.default_rng(6)
    rate = 8000
    t = np.arange(rate * 12) / rate
    said = ((t > 3) & (t < 5)) | ((t > 8) & (t < 9.5))
    voice = np.sin(2 * np.pi * 700 * t) * (np.sin(2 * np.pi * 4 * t) > -0.2) * said
    flags = timeseries.speech(voice * 0.3 + 0.002 * rng.standard_normal(len(t)) + 0.3 * np.sin(2 * np.pi * 50 * t), rate)
    inside = np.add.reduceat(said, np.arange(0, len(t), 80)) > 40
    assert len(flags) == 1200 and (flags == inside).mean() > 0.95
    assert not timeseries.speech(np.zeros(4000), rate).any() and timeseries.speech(np.zeros(0), rate).size == 0


def test_rows_of_one_vector_are_compared_once(spark, monkeypatch):
    rng = np.random.default_rng(7)
    m = np.repeat(rng.standard_normal((9, 8)), 2, axis=0)[:17]  # some groups are alike
    rows = [(i, (i * 7) % 17, m[(i * 7) % 17].tolist()) for i in range(300)]
    df = spark.createDataFrame(rows, "id bigint, g bigint, v array<float>")
    key = lambda d: sorted((r.query, r.id, r["rank"], r.similarity) for r in d.collect())
    want = key(vectors.nearest(df, df.filter("id % 20 = 0"), "id", "v", 10))
    counts = []
    monkeypatch.setattr(vectors, "nearest", lambda base, *a, f=vectors.nearest: counts.append(base.count()) or f(base, *a))
    assert key(vectors.nearest_sharing(df, df.filter("id % 20 = 0"), "id", "g", "v", 10)) == want and counts == [17]
