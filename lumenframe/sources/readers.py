"""Readers of published dumps and small text formats. Each is lazy and returns a DataFrame; rejected rows can be had apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenframe.storage import materialize

#: Columns of the known dumps. Fixed values.
DATASETS = {
    "title.basics": ["tconst", "titleType", "primaryTitle", "originalTitle", "isAdult", "startYear", "runtimeMinutes", "genres"],
    "title.ratings": ["tconst", "averageRating", "numVotes"],
    "title.akas": ["titleId", "title", "region", "language", "isOriginalTitle"],
    "name.basics": ["nconst", "primaryName", "birthYear", "deathYear", "primaryProfession"],
    "title.principals": ["tconst", "nconst", "category", "ordering", "characters"],
    "title.episode": ["tconst", "parentTconst", "seasonNumber", "episodeNumber"],
}


def require_columns(present: list[str], required: list[str]) -> None:
    """Raises with the missing and the present columns."""
    if missing := [c for c in required if c not in present]:
        raise ValueError(f"missing columns {missing}; present are {present}")


def read_tsv(spark: SparkSession, path: str, required: list[str]) -> DataFrame:
    """A tab-separated dump with a header: `\\N` and nothing are null, no quoting, lines of another width are dropped.

    The text is split here, not by the CSV reader, which under column pruning doesn't see a line's width.
    """
    lines = spark.read.text(path)
    header = lines.first()[0].split("\t")
    require_columns(header, required)
    cells = F.split("value", "\t")
    rows = lines.filter((F.trim("value") != "") & (F.col("value") != "\t".join(header))).select(cells.alias("c")).filter(F.size("c") == len(header))
    null = lambda c: F.nullif(F.nullif(c, F.lit(r"\N")), F.lit(""))
    return rows.select(*[null(F.col("c")[i]).alias(name) for i, name in enumerate(header)])


def read_ratings_csv(spark: SparkSession, path: str) -> DataFrame:
    """(user, item, stars) of a ratings file; lines that don't parse or stars outside 0.5 to 5 are dropped."""
    rows = spark.read.option("header", True).schema("userId string, movieId string, rating string, timestamp string").csv(path)
    typed = rows.select(F.col("userId").try_cast("bigint").alias("user"), F.col("movieId").try_cast("bigint").alias("item"), F.col("rating").try_cast("double").alias("stars"))
    return typed.dropna().filter(F.col("stars").between(0.5, 5))


def title_and_year(name: Column) -> Column:
    """struct(title, year) of a name that may end with a year in brackets."""
    year = F.nullif(F.regexp_extract(name, r"\((\d{4})\)\s*$", 1), F.lit("")).cast("int")
    return F.struct(F.trim(F.regexp_replace(name, r"\s*\(\d{4}\)\s*$", "")).alias("title"), year.alias("year"))


def playlist_entries(lines: DataFrame, source: str, line_no: str, line: str) -> DataFrame:
    """(source, title, year, url) of playlist lines: an info line names the address after it; other addresses are dropped."""
    known = lines.filter(F.trim(line) != "").withColumn("info", F.lag(line).over(Window.partitionBy(source).orderBy(line_no)))
    name = F.when(F.startswith("info", F.lit("#EXTINF")), F.regexp_extract("info", r'^#EXTINF(?:[^",]|"[^"]*")*,(.*)$', 1))
    links = known.filter(F.col(line).rlike("^https?://")).select(source, title_and_year(F.trim(name)).alias("t"), F.trim(line).alias("url"))
    return links.select(source, "t.title", "t.year", "url")


def _milliseconds(clock: Column) -> Column:
    parts = F.split(F.replace(clock, F.lit(","), F.lit(".")), ":")
    return F.round(F.aggregate(F.transform(parts, lambda p: p.try_cast("double")), F.lit(0.0), lambda s, p: s * 60 + p) * 1000).cast("bigint")


def subtitle_cues(files: DataFrame, key: str, text: str) -> DataFrame:
    """(key, n, start_ms, end_ms, words) of SubRip and WebVTT files; blocks without two readable times are dropped."""
    blocks = files.select(key, F.posexplode(F.split(F.replace(F.col(text), F.lit("\r"), F.lit("")), r"\n\s*\n")).alias("n", "block"))
    time = r"((?:\d+:)?\d+:\d+[.,]\d+)\s*-->\s*((?:\d+:)?\d+:\d+[.,]\d+)"
    read = blocks.filter(F.col("block").rlike(time)).select(
        key, "n", _milliseconds(F.regexp_extract("block", time, 1)).alias("start_ms"), _milliseconds(F.regexp_extract("block", time, 2)).alias("end_ms"),
        F.regexp_replace(F.regexp_extract("block", r"(?s)-->[^\n]*\n(.*)\z", 1), r"^\s+|\s+\z", "").alias("words"),
    )
    return read.filter("start_ms is not null and end_ms is not null")


def retimed(cues: DataFrame, scale: float, offset_ms: int) -> DataFrame:
    """Cues moved by a linear function of time, never before 0."""
    move = lambda c: F.greatest(F.round(F.col(c) * scale + offset_ms).cast("bigint"), F.lit(0)).alias(c)
    return cues.select(*[move(c) if c in ("start_ms", "end_ms") else c for c in cues.columns])


def freshness(age_seconds: Column, kind: Column) -> Column:
    """fresh, stale or expired by the age of a stored answer and its kind."""
    day = 86_400
    lives = {"detail": 30 * day, "images": 14 * day, "ratings": 7 * day, "search": day, "schedule": day // 4}
    ttl = F.lit(day)
    for name, seconds in lives.items():
        ttl = F.when(kind == name, seconds).otherwise(ttl)
    most = F.when(kind == "schedule", 7 * day).otherwise(365 * day)
    return F.when(age_seconds <= ttl, "fresh").when(age_seconds <= most, "stale").otherwise("expired")


def write_new_rows(rows: DataFrame, path: str, keys: list[str]) -> int:
    """Append the rows whose keys a Parquet table lacks, each key once (null keys are equal); returns how many. Running it again
    adds nothing. The new rows are written to the shared folder first, so the input is read once."""
    spark = rows.sparkSession
    fresh = rows.dropDuplicates(keys)
    try:
        old = spark.read.parquet(path).select(*[F.col(k).alias(f"_old_{k}") for k in keys])
        fresh = fresh.join(old, [F.col(k).eqNullSafe(F.col(f"_old_{k}")) for k in keys], "left_anti")
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
    fresh = materialize(fresh, "fresh")
    n = fresh.count()
    if n:
        fresh.write.mode("append").parquet(path)
    return n
