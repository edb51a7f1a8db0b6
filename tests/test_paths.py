import pytest
from lumenframe.functions.filenames import parse_name, read_path
from lumenframe.operators import selection as S
from pyspark.sql import functions as F

NAMES = {
    "Some.Show.S2 - 05.mkv": (None, 2, 5), "[Crew] Long Runner - 1071 [1080p].mkv": (None, None, 1071), "12.mkv": (None, None, 12), "Late Talk 2019.05.17 720p.mkv": (None, None, None),
    "[Crew] Show - 05v2 [720p].mkv": (None, None, 5), "2001.A.Space.Film.1968.2160p.mkv": (1968, None, None), "Blade 2049 (2017).mkv": (2017, None, None), "Show.1920x1080.S01E02.mkv": (None, 1, 2),
}


@pytest.mark.parametrize("name", NAMES)
def test_numbers_in_names(name):
    got = parse_name(name)
    assert (got["year"], got["season"], got["episode"]) == NAMES[name]


def test_folders_help():
    got = read_path("Films/2a. Harbour Lights (2004)/Season 1/Episode 3.mkv")
    assert (got["title"], got["year"], got["season"], got["episode"], got["is_episode"]) == ("Harbour Lights", 2004, 1, 3, True)
    got = read_path("Moon Garden (2016)/01.mkv")
    assert (got["title"], got["year"], got["likelihood"], got["is_episode"]) == ("Moon Garden", 2016, 0.5, False)
    got = read_path("Breaking Glass (2008)/Breaking.Glass.S01E01.mkv")
    assert (got["title"], got["year"], got["likelihood"]) == ("Breaking Glass", 2008, 1.0)
    assert read_path("Film (1999)/Extras/x.mkv")["extra"] and not read_path("Extra Ordinary (2019).mkv")["extra"] and read_path("Late.Talk.2019.05.17.mkv")["aired"] == "2019-05-17"


def test_choose_file_and_backfill(spark):
    rows = [("a", "f.mkv", 900, None, None, True, False, None, None), ("a", "x.mkv", 950, None, None, True, True, None, None), ("b", "e1.mkv", 5, 1, 2, True, False, 1, 1), ("b", "e2.mkv", 4, 1, 2, True, False, 1, 2), ("c", "s.mkv", 1, None, None, True, True, None, None), ("d", "t.txt", 9, None, None, False, False, None, None)]
    df = spark.createDataFrame(rows, "k string, path string, size bigint, s int, e int, video boolean, extra boolean, file_season int, file_episode int")
    assert {(r.k, r.path) for r in S.choose_file(df, "k", "s", "e").collect()} == {("a", "f.mkv"), ("b", "e2.mkv"), ("c", "s.mkv")}
    cands = [(1, 0, "The Old Mill Story", 1950, ["old", "mill"], ["the", "old", "mill", "story"]), (1, 1, "Old Mill", 1960, ["old", "mill"], ["old", "mill"]), (2, 0, "Old Mill", None, ["old"], ["old", "mill"]), (3, 0, "Sea", 1970, ["sea"], ["sea"])]
    c = spark.createDataFrame(cands, "q int, pos int, title string, year int, want array<string>, has array<string>")
    known = spark.createDataFrame([("sea", None)], "name string, year int")
    assert [tuple(r) for r in S.choose_backfill(c, "q", "want", known).collect()] == [(1, "Old Mill", 1960)]
