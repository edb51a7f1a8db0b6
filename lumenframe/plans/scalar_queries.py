"""Scalar rules over whole tables: playback, hours, labels, ratings, languages, splits and hashes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.functions import scalars as S
from lumenframe.plans.base import EVENTS_SQL, RATINGS_SQL, TITLES_SQL, Registry, events, ratings, titles
from lumenframe.tables import table

_r = Registry()
query = _r.query
#: Watch events as playbacks: the item's length and where it was stopped, in seconds.
_PLAYED = "WITH " + EVENTS_SQL + ", pl AS (SELECT event_id, CAST(floor(value * 20) AS BIGINT) AS pos, (item % 10 + 1) * 600 AS dur FROM ev)\n"


def _played(spark: SparkSession, folder: str) -> DataFrame:
    return events(spark, folder).select("event_id", F.floor(F.col("value") * 20).alias("pos"), ((F.col("item") % 10 + 1) * 600).alias("dur"))


@query("op_f14_finished", _PLAYED + "SELECT event_id, coalesce(pos >= dur * 95 // 100, false) AS finished FROM pl")
def finished(spark: SparkSession, folder: str) -> DataFrame:
    return _played(spark, folder).select("event_id", S.finished(F.col("pos"), F.col("dur")).alias("finished"))


@query("op_f16_resume_points", _PLAYED + "SELECT event_id, CASE WHEN pos >= 10 AND coalesce(pos <= dur - 180, true) THEN pos END AS resume FROM pl")
def resume_points(spark: SparkSession, folder: str) -> DataFrame:
    """Where every playback goes on."""
    return _played(spark, folder).select("event_id", S.resume_point(F.col("pos"), F.col("dur")).alias("resume"))


@query("op_x10_outcomes", _PLAYED + """SELECT event_id, CASE WHEN pos < 60 THEN 'skim' WHEN pos >= 0.9::DOUBLE * dur OR dur - pos <= 300 THEN 'completed' ELSE 'abandoned' END AS outcome,
  round(-0.6::DOUBLE + 0.5::DOUBLE * greatest(0, least(1, pos / dur)), 9)::DOUBLE AS weight FROM pl""")
def outcomes(spark: SparkSession, folder: str) -> DataFrame:
    """How every playback ended, and what leaving it there would weigh."""
    pos, dur = F.col("pos"), F.col("dur")
    return _played(spark, folder).select("event_id", S.playback_outcome(pos, pos, dur).alias("outcome"), F.round(S.abandon_weight(pos, dur), 9).alias("weight"))


@query("op_f15_retry_window", """WITH a AS (SELECT imdb_id, max(fetched_at) AS last FROM documents WHERE imdb_id IS NOT NULL GROUP BY 1), m AS (SELECT max(fetched_at) AS now FROM documents)
  SELECT t.item_id, a.last IS NULL AS never FROM (SELECT DISTINCT item_id, imdb_id, year FROM media_items) t LEFT JOIN a USING (imdb_id), m
  WHERE a.last IS NULL OR a.last < now - CASE WHEN t.year >= year(now) - 1 THEN INTERVAL 7 DAY ELSE INTERVAL 90 DAY END""")
def retry_window(spark: SparkSession, folder: str) -> DataFrame:
    """Titles never asked about, or long ago: a week for recent ones, ninety days for others."""
    docs = table(spark, folder, "documents").select("imdb_id", "fetched_at")
    asked = docs.filter("imdb_id is not null").groupBy("imdb_id").agg(F.max("fetched_at").alias("last"))
    own = table(spark, folder, "media_items").select("item_id", "imdb_id", "year").distinct().join(asked, "imdb_id", "left")
    both = own.join(F.broadcast(docs.agg(F.max("fetched_at").alias("now"))))  # one row
    wait = F.when(F.col("year") >= F.year("now") - 1, F.expr("interval 7 days")).otherwise(F.expr("interval 90 days"))
    return both.filter(F.col("last").isNull() | (F.col("last") < F.col("now") - wait)).select("item_id", F.col("last").isNull().alias("never"))


@query("op_f17_tiers", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_quantity * 512 < 8192 OR l_returnflag = 'N' OR l_linenumber + 1 <= 2 THEN 'modest'
  WHEN l_quantity * 512 >= 16384 AND l_linenumber + 1 >= 6 AND l_linestatus = 'F' THEN 'capable' ELSE 'standard' END AS tier FROM lineitem""")
def hardware_tiers(spark: SparkSession, folder: str) -> DataFrame:
    """Order lines as machines: memory, cores, decoding and GPU."""
    own = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag", "l_linestatus")
    tier = S.hardware_tier(F.col("l_quantity") * 512, F.col("l_linenumber") + 1, F.col("l_returnflag") != "N", F.col("l_linestatus") == "F")
    return own.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", tier.alias("tier"))


@query("op_x21_local_hours", "WITH " + EVENTS_SQL + """, u AS (SELECT event_id, CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS s, (user_id % 27 - 12) * 3600 AS o FROM ev)
  SELECT event_id, CAST(((s + o) % 86400) // 3600 AS INT) AS hour, s - (s + o - 3600) % 86400 + 86400 AS tonight FROM u""")
def local_hours(spark: SparkSession, folder: str) -> DataFrame:
    """The local hour of every event and the next 01:00 there."""
    s, o = F.unix_seconds(F.date_trunc("second", F.col("ts").cast("timestamp"))), (F.col("user_id") % 27 - 12) * 3600
    return events(spark, folder).select("event_id", S.local_hour(s, o).alias("hour"), S.next_local_one(s, o).alias("tonight"))


@query("op_x22_thousands", TITLES_SQL + "SELECT item_id, format('{:,}', votes) AS votes FROM titles")
def thousands(spark: SparkSession, folder: str) -> DataFrame:
    return titles(spark, folder).select("item_id", S.thousands(F.col("votes")).alias("votes"))


@query("op_x23_numbering", """WITH e AS (SELECT DISTINCT imdb_id, title, nullif(CAST(substr(imdb_id, 3) AS BIGINT) % 4, 0) AS s, nullif(CAST(substr(imdb_id, 3) AS BIGINT) % 7, 0) AS n FROM title_snapshots WHERE title_type = 'tvEpisode' AND imdb_id IS NOT NULL)
  SELECT imdb_id, title, concat_ws(' ', 'S' || s, 'E' || n) AS place, CASE WHEN trim(title) <> '' AND NOT regexp_matches(trim(title), '^Episode[ #]*[0-9.]+$') THEN trim(title) END AS name FROM e""")
def numbering(spark: SparkSession, folder: str) -> DataFrame:
    """Every episode's place as text, and its name unless that only counts."""
    own = table(spark, folder, "title_snapshots").filter("title_type = 'tvEpisode' and imdb_id is not null").select("imdb_id", "title").distinct()
    n = F.substring("imdb_id", 3, 20).try_cast("bigint")
    return own.select("imdb_id", "title", S.numbering(F.nullif(n % 4, F.lit(0)), F.nullif(n % 7, F.lit(0))).alias("place"), S.episode_name(F.col("title")).alias("name"))


@query("op_x24_first_sentences")
def first_sentences(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").filter("text is not null").select("doc_id", S.first_sentence(F.col("text"), 160).alias("sentence"))


@query("op_x25_same_language", """WITH d AS (SELECT doc_id, lang, CASE doc_id % 3 WHEN 0 THEN 'en-US' WHEN 1 THEN 'FR_ca' ELSE 'de' END AS want FROM documents)
  SELECT doc_id, want, lang <> '' AND lower(regexp_split_to_array(lang, '[-_]')[1]) = lower(regexp_split_to_array(want, '[-_]')[1]) AS same FROM d""")
def same_language(spark: SparkSession, folder: str) -> DataFrame:
    """Whether texts are in the language asked for, whatever the region."""
    want = F.when(F.col("doc_id") % 3 == 0, "en-US").when(F.col("doc_id") % 3 == 1, "FR_ca").otherwise("de")
    return table(spark, folder, "documents").select("doc_id", want.alias("want"), S.same_language(F.col("lang"), want).alias("same"))


@query("op_x26_halves", TITLES_SQL + "SELECT item_id, CASE WHEN rating > 0 THEN CAST(greatest(1, least(10, round(rating / 10.0::DOUBLE))) AS INT) END AS halves FROM titles")
def halves(spark: SparkSession, folder: str) -> DataFrame:
    return titles(spark, folder).select("item_id", S.halves(F.col("rating") / 10).alias("halves"))


@query("op_x13_length_bands", TITLES_SQL + """SELECT year // 10 * 10 AS decade, CASE WHEN runtime_minutes < 90 THEN 'short' WHEN runtime_minutes < 130 THEN 'middle' WHEN runtime_minutes IS NOT NULL THEN 'long' END AS band, count(*) AS titles FROM titles GROUP BY 1, 2""")
def length_bands(spark: SparkSession, folder: str) -> DataFrame:
    return titles(spark, folder).groupBy(F.expr("year div 10 * 10").cast("int").alias("decade"), S.length_band(F.col("runtime_minutes")).alias("band")).agg(F.count(F.lit(1)).alias("titles"))


_MIX = """mixed AS (SELECT *, xor(c, c >> 31) AS m FROM (SELECT *, CAST((xor(b, b >> 27)::UHUGEINT * 10723151780598845931) % 18446744073709551616 AS UBIGINT) AS c
  FROM (SELECT *, CAST((xor(a, a >> 30)::UHUGEINT * 13787848793156543929) % 18446744073709551616 AS UBIGINT) AS b FROM (SELECT *, CAST((x::UHUGEINT + 11400714819323198485) % 18446744073709551616 AS UBIGINT) AS a FROM given))))
"""


@query("op_x16_held_out_split", "WITH " + RATINGS_SQL + """, given AS (SELECT "user", item, CAST("user" AS UBIGINT) AS x FROM rating), """ + _MIX + """
  SELECT CASE m % 10 WHEN 0 THEN 'tune' WHEN 1 THEN 'test' ELSE 'build' END AS part, count(*) AS ratings, count(DISTINCT "user") AS users FROM mixed GROUP BY 1""")
def user_parts(spark: SparkSession, folder: str) -> DataFrame:
    """Users split for building, tuning and testing, by a hash that any engine can compute."""
    own = ratings(spark, folder)
    return own.groupBy(S.user_part(F.col("user")).alias("part")).agg(F.count(F.lit(1)).alias("ratings"), F.countDistinct("user").alias("users"))


@query("op_x16_held_out_likes", "WITH " + RATINGS_SQL + """, given AS (SELECT DISTINCT "user", item, CAST("user" * 4294967296 + item AS UBIGINT) AS x FROM rating WHERE stars >= 4), """ + _MIX + """
  SELECT "user", item, m % 5 = 0 AS held FROM mixed""")
def held_out_likes(spark: SparkSession, folder: str) -> DataFrame:
    """The fifth of all likes that is held out."""
    own = ratings(spark, folder).filter("stars >= 4").select("user", "item").distinct()
    return own.withColumn("held", S.held_out(F.col("user"), F.col("item")))


@query("op_x19_file_hashes")
def file_hashes(spark: SparkSession, folder: str) -> DataFrame:
    """Texts as files, hashed over 64 bytes at either end."""
    data = F.encode("text", "UTF-8")
    own = table(spark, folder, "documents").filter("text is not null").select("doc_id", data.alias("d"), F.octet_length("text").alias("n"))
    return own.select("doc_id", S.file_hash(F.col("n"), F.substring("d", 1, 64), F.substring("d", -64, 64), 64).alias("hash"))


@query("op_x30_years", """SELECT item_id, CASE WHEN CAST(substr(CAST(updated_at AS VARCHAR), 1, 4) AS INT) BETWEEN 1878 AND 2100 THEN CAST(substr(CAST(updated_at AS VARCHAR), 1, 4) AS INT) END AS year FROM (SELECT DISTINCT item_id, updated_at FROM media_items)""")
def years(spark: SparkSession, folder: str) -> DataFrame:
    """The year at the beginning of a date's text."""
    return table(spark, folder, "media_items").select("item_id", "updated_at").distinct().select("item_id", S.year_of(F.col("updated_at").cast("string")).alias("year"))


QUERIES, ORACLES = _r.queries, _r.oracles
