"""Entity resolution by rules, and choice among copies of a title."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def name_match(entries: DataFrame, titles: DataFrame) -> DataFrame:
    """(entry, title, outcome, n): entries matched by normal name with a year off by one at most (unknown years pass).

    outcome is `matched` with one title, `ambiguous` with several (n of them), `year conflict` where only names agree and
    `not in catalogue`. entries: entry, name, year; titles: title, name, year.
    """
    both = entries.join(titles.withColumnRenamed("year", "title_year"), "name", "left")
    near = F.coalesce(F.abs(F.col("year") - F.col("title_year")) <= 1, F.lit(True)) & F.col("title").isNotNull()
    each = both.groupBy("entry").agg(
        F.countDistinct(F.when(near, F.col("title"))).alias("n"), F.min(F.when(near, F.col("title"))).alias("first"), F.count("title").alias("named")
    )
    outcome = F.when(F.col("n") == 1, "matched").when(F.col("n") > 1, "ambiguous").when(F.col("named") > 0, "year conflict").otherwise("not in catalogue")
    return each.select("entry", F.when(F.col("n") == 1, F.col("first")).alias("title"), outcome.alias("outcome"), "n")


def claim_once(matches: DataFrame, title: str, order: list[Column]) -> DataFrame:
    """One entry per title: the first in order keeps it, later ones are refused."""
    place = F.row_number().over(Window.partitionBy(title).orderBy(*order))
    return matches.withColumn("claimed", place == 1)


def place_imports(entries: DataFrame, titles: DataFrame) -> DataFrame:
    """(entry, title): entries placed by name within a year; with several candidates only if the first has ten times the
    votes of the second. entries: entry, name, year; titles: title, name, year, votes."""
    own = titles.withColumnRenamed("year", "title_year")
    near = entries.join(own, "name").filter(F.abs(F.col("year") - F.col("title_year")) <= 1)
    order = Window.partitionBy("entry").orderBy(F.col("votes").desc_nulls_last(), "title")
    ranked = near.withColumn("place", F.row_number().over(order)).withColumn("second", F.lead(F.coalesce("votes", F.lit(0))).over(order))
    first = ranked.filter("place = 1")
    return first.filter(F.col("second").isNull() | (F.coalesce("votes", F.lit(0)) >= 10 * F.col("second"))).select("entry", "title")


def merge_copies(copies: DataFrame, locator: str, order: str, lists: list[str], firsts: list[str]) -> DataFrame:
    """Copies with one locator as one row: values of `lists` in first-seen order, the first known of `firsts`; copies without
    a locator stay single."""
    known = F.col(locator).isNotNull() & (F.col(locator) != "")
    ordered = lambda c: F.transform(F.array_sort(F.collect_list(F.when(F.col(c).isNotNull(), F.struct(order, c)))), lambda s: s[c])
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order)))
    merged = copies.filter(known).groupBy(locator).agg(*[F.array_distinct(ordered(c)).alias(c) for c in lists], *[first(c).alias(c) for c in firsts], F.count(F.lit(1)).alias("copies"))
    single = copies.filter(~F.coalesce(known, F.lit(False))).select(locator, *[F.when(F.col(c).isNotNull(), F.array(c)).otherwise(F.array()).alias(c) for c in lists], *firsts, F.lit(1).cast("bigint").alias("copies"))
    return merged.unionByName(single)


def plausibility(size_mb: Column, minutes: Column, height: Column, wanted_minutes: Column) -> Column:
    """0 for a fake, 1 for a sound copy: megabytes per minute under the floor of its height (1, 3, 5, 12) or a length under
    0.8 of the wanted one is fake; more than 1.3 times is neutral, 0.5."""
    floor = F.when(height >= 2160, 12).when(height >= 1080, 5).when(height >= 720, 3).otherwise(1)
    ratio = F.try_divide(minutes.cast("double"), wanted_minutes)
    return F.when(F.try_divide(size_mb.cast("double"), minutes) < floor, 0.0).when(ratio < 0.8, 0.0).when(ratio > 1.3, 0.5).otherwise(1.0)


def swarm_health(seeds: Column) -> Column:
    """(s - 5) / (s + 5)."""
    return (seeds.cast("double") - 5) / (seeds.cast("double") + 5)


def normal_cdf(x: Column) -> Column:
    """Normal distribution function by a five-term polynomial, good to 1e-7."""
    t = 1 / (1 + 0.2316419 * F.abs(x))
    tail = F.exp(-x * x / 2) / F.sqrt(F.lit(2 * 3.141592653589793)) * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return F.when(x >= 0, 1 - tail).otherwise(tail)


def stall_chance(need: Column, throughput: Column, spread: Column, thin: Column) -> Column:
    """Chance that a stream stalls: the needed rate with a margin against throughput and its uncertainty."""
    return normal_cdf((1.05 * need - throughput) / F.sqrt(spread * spread + thin * thin))


#: Weights of a copy's terms.
COPY_WEIGHTS = {
    "language": 4.0, "quality": 3.0, "plausibility": 3.0, "health": 2.0, "duration": 2.0, "compatibility": 2.0, "throughput": 2.0, "encoding": 1.0, "subtitles": 0.5,
}


def copy_terms(language: str, wanted_rank: int, best_rank: int, speed: float) -> dict[str, Column]:
    """The nine terms of a copy, each from -1 to 1, from its columns: language, rank (0 to 3, null unknown), mb, minutes, runtime,
    codec, seeds, local, name, has_subtitles. speed is in megabytes a second. Unknown facts give 0."""
    c = F.col
    floor = F.when(c("rank") >= 3, 12.0).when(c("rank") == 2, 5.0).when(c("rank") == 1, 3.0).otherwise(1.0) * F.when(c("codec").isin("h265", "av1"), 0.6).otherwise(1.0)
    dense, ratio = F.try_divide("mb", "minutes"), F.try_divide("minutes", "runtime")
    room = F.try_divide(F.lit(speed), F.try_divide("mb", c("minutes") * 60))
    words = F.split(F.lower("name"), "[^a-z0-9]+")
    fake = F.lower("name").rlike(r"\.(?:exe|scr|bat|cmd|msi|lnk|zip|rar|7z)\z")
    camera = F.arrays_overlap(words, F.array(*map(F.lit, ("cam", "camrip", "hdcam", "ts", "hdts", "telesync"))))
    sound = F.arrays_overlap(words, F.array(*map(F.lit, ("bluray", "bdrip", "remux", "webdl", "webrip", "web", "hdtv", "x264", "x265"))))
    terms = {
        "language": F.when(c("language").isNull(), 0.0).when(c("language") == language, 1.0).otherwise(-1.0),
        "quality": F.when(c("rank").isNull(), 0.0).when(c("rank") > best_rank, -1.0).when(c("rank") == wanted_rank, 1.0).when(c("rank") < wanted_rank, 1 - 0.5 * (wanted_rank - c("rank"))).otherwise(0.5),
        "plausibility": F.when(dense.isNull(), 0.0).when(dense < floor, -1.0).when(dense < 2 * floor, 0.0).otherwise(1.0),
        "duration": F.when(ratio.isNull(), 0.0).when(ratio < 0.8, -1.0).when(ratio > 1.3, 0.0).otherwise(1.0),
        "encoding": F.when(fake | camera, -1.0).when(sound, 1.0).otherwise(0.0),
        "health": F.when(c("local"), 1.0).when(c("seeds").isNull(), 0.0).otherwise(swarm_health(c("seeds"))),
        "compatibility": F.when(c("codec") == "h264", 1.0).when(c("codec").isin("h265", "av1"), -0.5).when(c("codec") == "vp9", 0.5).otherwise(0.0),
        "throughput": F.when(c("local"), 1.0).when(room.isNull(), 0.0).when(room >= 1.5, 1.0).when(room >= 1, 0.0).otherwise(-1.0),
        "subtitles": F.when(c("has_subtitles"), 1.0).otherwise(0.0),
    }
    return {k: F.coalesce(v.cast("double"), F.lit(0.0)) for k, v in terms.items()}


def rank_copies(copies: DataFrame, keys: list[str], tie: list[Column], language: str, wanted_rank: int, best_rank: int, speed: float) -> DataFrame:
    """copies with the nine terms, total and rank: fakes last, then those that lack the language, local ones first, those that
    start badly (no seeds to speak of, or too slow) later, then by distance from the wanted quality, points and tie."""
    terms = copy_terms(language, wanted_rank, best_rank, speed)
    scored = copies.withColumns(terms if not set(terms) & set(copies.columns) - {"language"} else {f"{k}": v for k, v in terms.items() if k != "language"} | {"t_language": terms["language"]})
    name = lambda k: "t_language" if k == "language" and "t_language" in scored.columns else k
    total = F.round(sum((w * F.col(name(k)) for k, w in COPY_WEIGHTS.items()), F.lit(0.0)), 6)
    sunk = (F.col("plausibility") == -1) | (F.col("duration") == -1) | (F.col("encoding") == -1)
    weak = (F.col("health") < 0) | (F.col("throughput") == -1)
    off = F.abs(F.coalesce("rank", F.lit(wanted_rank)) - wanted_rank)
    order = [sunk, F.col(name("language")) == -1, ~F.coalesce("local", F.lit(False)), weak, off, F.col("total").desc(), *tie]
    return scored.withColumn("total", total).withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def choose_file(files: DataFrame, key: str, season: str, episode: str) -> DataFrame:
    """(key, path, size): of each bundle's videos that are no extras (or of all, if all are) the largest, of the wanted episode
    where one is wanted. files: key, path, size, wanted season and episode (null is any), video, extra, and the path's own
    file_season and file_episode."""
    video = files.filter("video").withColumn("features", F.max((~F.col("extra")).cast("int")).over(Window.partitionBy(key)))
    pool = video.filter((F.col("features") == 0) | ~F.col("extra"))
    fits = F.col(episode).isNull() | ((F.col("file_episode") == F.col(episode)) & F.coalesce(F.col("file_season") == F.col(season), F.col(season).isNull()))
    best = pool.filter(F.coalesce(fits, F.lit(False))).groupBy(key).agg(F.max_by(F.struct("path", "size"), F.struct("size", (F.lit("")), "path")).alias("b"))
    return best.select(key, "b.path", "b.size")


def choose_backfill(candidates: DataFrame, query: str, words: str, known: DataFrame) -> DataFrame:
    """(query, title, year): for every search the first dated candidate that holds all its words, an exact name before others;
    none where the catalogue (known: name, year) has that name in that year or one of them is undated.

    candidates: query, pos, title, year, and as arrays the search's words and the title's (`has`).
    """
    fit = candidates.filter(F.col("year").isNotNull() & (F.size(F.array_except(words, "has")) == 0))
    best = fit.groupBy(query).agg(F.min_by(F.struct("title", "year", F.array_join("has", " ").alias("name")), F.struct(F.col("has") != F.col(words), F.col("pos"))).alias("b")).select(query, "b.*")
    same = (F.col("k.name") == F.col("c.name")) & F.coalesce(F.col("k.year") == F.col("c.year"), F.lit(True))
    return best.alias("c").join(known.alias("k"), same, "left_anti").select(query, "title", "year")
