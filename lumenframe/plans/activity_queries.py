"""Activity logs, signals on a grid, rule-based identity and copies."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenframe.functions.filenames import parse_path
from lumenframe.operators import folds, timeseries
from lumenframe.operators import selection as S
from lumenframe.plans.base import EVENTS_SQL, TITLES_SQL, Registry, events, titles
from lumenframe.storage import shared_dir
from lumenframe.streaming import streams
from lumenframe.tables import table

_r = Registry()
query = _r.query
_EV = "WITH " + EVENTS_SQL
_LIST = "list({0} ORDER BY ts, event_id)"


@query("op_st01_debounce", _EV + """, n AS (SELECT *, lead(ts) OVER (PARTITION BY user_id, item ORDER BY ts, event_id) AS next FROM ev)
  SELECT event_id, user_id, item, event_type, ts + INTERVAL 1 HOUR AS due FROM n WHERE next IS NULL OR next > ts + INTERVAL 1 HOUR""")
def debounce(spark: SparkSession, folder: str) -> DataFrame:
    """The last change of each thing once it has been quiet for an hour."""
    following = F.lead("ts").over(Window.partitionBy("user_id", "item").orderBy("ts", "event_id"))
    quiet = F.col("ts") + F.expr("interval 1 hour")
    own = events(spark, folder).withColumn("next", following).filter(F.col("next").isNull() | (F.col("next") > quiet))
    return own.select("event_id", "user_id", "item", "event_type", quiet.alias("due"))


@query("op_st02_fold_changes", _EV + """SELECT user_id, item, arg_max(event_type, struct_pack(ts, event_id)) AS state, count(*) AS changes FROM ev GROUP BY 1, 2
  HAVING arg_max(event_type, struct_pack(ts, event_id)) <> 'error'""")
def fold_changes(spark: SparkSession, folder: str) -> DataFrame:
    """The state after all changes; a removal (error) last takes the thing away."""
    last = F.max_by("event_type", F.struct("ts", "event_id"))
    return events(spark, folder).groupBy("user_id", "item").agg(last.alias("state"), F.count(F.lit(1)).alias("changes")).filter("state <> 'error'")


@query("op_st03_signal_dedup", "WITH RECURSIVE " + EVENTS_SQL + """, k AS (SELECT event_id, user_id, item, event_type, ts, row_number() OVER (PARTITION BY user_id, item, event_type ORDER BY ts, event_id) AS n FROM ev),
  w AS (SELECT n, event_id, user_id, item, event_type, ts, ts AS last, true AS ok FROM k WHERE n = 1 UNION ALL
    SELECT k.n, k.event_id, k.user_id, k.item, k.event_type, k.ts, CASE WHEN k.ts >= w.last + INTERVAL 1 DAY THEN k.ts ELSE w.last END, k.ts >= w.last + INTERVAL 1 DAY
    FROM w JOIN k ON k.n = w.n + 1 AND k.user_id = w.user_id AND k.item = w.item AND k.event_type = w.event_type)
  SELECT event_id, user_id, item, event_type, ts FROM w WHERE ok""")
def signal_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Signals at least a day after the last accepted one of their user, item and kind."""
    kept = folds.accepted(events(spark, folder), ["user_id", "item", "event_type"], "ts", "event_id", gap_seconds=86_400)
    return kept.filter("accepted").select("event_id", "user_id", "item", "event_type", "ts")


@query("op_st04_idempotent", """SELECT DISTINCT ON (rec_id) rec_id, profile_id, item_id FROM recommendations ORDER BY rec_id""")
def idempotent(spark: SparkSession, folder: str) -> DataFrame:
    """Records delivered again under one id count once."""
    return table(spark, folder, "recommendations").select("rec_id", "profile_id", "item_id").dropDuplicates(["rec_id"])


@query("op_st06_token_bucket")
def token_bucket(spark: SparkSession, folder: str) -> DataFrame:
    """Waits under two requests a day with a burst of three, per user."""
    return folds.bucket_waits(events(spark, folder), ["user_id"], "ts", "event_id", 2 / 86_400, 3).select("event_id", "user_id", F.round("wait", 3).alias("wait"))


@query("op_st08_ewma", _EV + """, l AS (SELECT event_type, list(coalesce(value, 0.0)::DOUBLE ORDER BY ts, event_id) AS v FROM ev GROUP BY 1)
  SELECT event_type, round(list_reduce(v, lambda a, x: 0.8 * a + 0.2 * x), 6) AS smoothed FROM l""")
def ewma(spark: SparkSession, folder: str) -> DataFrame:
    """The exponentially weighted mean after the last event of each kind."""
    own = events(spark, folder).withColumn("value", F.coalesce("value", F.lit(0.0)))
    each = folds.smoothed(own, ["event_type"], ["ts", "event_id"], "value")
    return each.groupBy("event_type").agg(F.round(F.max_by("smoothed", F.struct("ts", "event_id")), 6).alias("smoothed"))


@query("op_a16_hourly_mean")
def hourly_mean(spark: SparkSession, folder: str) -> DataFrame:
    """Capped running mean by hour of day after the last event."""
    own = events(spark, folder).withColumn("hour", F.hour("ts")).filter("value is not null")
    each = folds.capped_mean(own, ["hour"], ["ts", "event_id"], "value")
    return each.groupBy("hour").agg(F.round(F.max_by("mean", F.struct("ts", "event_id")), 6).alias("mean"), F.count(F.lit(1)).alias("events"))


@query("op_st09_refresh", """WITH o AS (SELECT imdb_id, votes AS votes FROM title_snapshots WHERE imdb_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY imdb_id ORDER BY loaded_at DESC NULLS LAST, votes DESC NULLS LAST) = 1), n AS (SELECT DISTINCT imdb_id, votes FROM media_items)
  SELECT n.imdb_id, n.votes, CASE WHEN o.votes IS DISTINCT FROM n.votes AND o.imdb_id IS NOT NULL THEN o.votes END AS previous_votes, CASE WHEN o.imdb_id IS NULL THEN 'new' WHEN o.votes IS DISTINCT FROM n.votes THEN 'moved' ELSE 'same' END AS state
  FROM n LEFT JOIN o USING (imdb_id)""")
def refresh(spark: SparkSession, folder: str) -> DataFrame:
    """A refresh against what was known, the row loaded last in all dumps of all mirrors: new rows, and the previous value only where
    it moved."""
    old = table(spark, folder, "title_snapshots").filter("imdb_id is not null").groupBy("imdb_id").agg(F.max(F.struct("loaded_at", "votes")).alias("old"))
    both = table(spark, folder, "media_items").select("imdb_id", "votes").distinct().join(old, "imdb_id", "left")
    moved = F.col("old").isNotNull() & ~F.col("old.votes").eqNullSafe(F.col("votes"))
    state = F.when(F.col("old").isNull(), "new").when(moved, "moved").otherwise("same")
    return both.select("imdb_id", "votes", F.when(moved, F.col("old.votes")).alias("previous_votes"), state.alias("state"))


@query("op_j09_temporal", _EV + """SELECT r.rec_id, min(e.event_id) AS event_id FROM (SELECT DISTINCT rec_id, profile_id, item_id, shown_at FROM recommendations) r JOIN ev e
  ON e.user_id = r.profile_id AND e.item = r.item_id % 100 AND e.ts >= r.shown_at AND e.ts < r.shown_at + INTERVAL 30 DAY GROUP BY 1""")
def temporal(spark: SparkSession, folder: str) -> DataFrame:
    """Events that follow what was shown, within thirty days: an equi join with a range beside it."""
    shown = table(spark, folder, "recommendations").select("rec_id", F.col("profile_id").alias("user_id"), (F.col("item_id") % 100).alias("item"), "shown_at").distinct()
    both = shown.join(events(spark, folder), ["user_id", "item"]).filter((F.col("ts") >= F.col("shown_at")) & (F.col("ts") < F.col("shown_at") + F.expr("interval 30 days")))
    return both.groupBy("rec_id").agg(F.min("event_id").alias("event_id"))


@query("op_j10_followed", _EV + "SELECT DISTINCT user_id, item FROM ev WHERE event_type = 'purchase' UNION SELECT DISTINCT user_id, item FROM ev WHERE event_type = 'signup'")
def followed(spark: SparkSession, folder: str) -> DataFrame:
    own = events(spark, folder)
    pick = lambda t: own.filter(F.col("event_type") == t).select("user_id", "item")
    return pick("purchase").union(pick("signup")).distinct()


@query("op_r24_continue", _EV + """, l AS (SELECT * FROM ev WHERE event_type IN ('view', 'purchase') QUALIFY row_number() OVER (PARTITION BY user_id, item ORDER BY ts DESC, event_id DESC) = 1)
  SELECT user_id, item, ts, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, item) AS INT) AS rank FROM l WHERE event_type = 'view' QUALIFY rank <= 20""")
def continue_watching(spark: SparkSession, folder: str) -> DataFrame:
    """Latest position of each card; finished ones are left out."""
    own = events(spark, folder).filter(F.col("event_type").isin("view", "purchase"))
    last = own.groupBy("user_id", "item").agg(F.max(F.struct("ts", "event_id", "event_type")).alias("l")).select("user_id", "item", "l.*").filter("event_type = 'view'")
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy(F.col("ts").desc(), "item"))
    return last.select("user_id", "item", "ts", rank.alias("rank")).filter("rank <= 20")


_GRID = _EV + """, g AS (SELECT user_id, date_trunc('day', ts) AS day, count(*)::DOUBLE AS n FROM ev GROUP BY 1, 2)
"""


@query("op_w04_moving", _GRID + """SELECT user_id, day, round(avg(n) OVER w, 6) AS mean, round(stddev_pop(n) OVER w, 6) AS spread, sum(n) OVER (PARTITION BY user_id ORDER BY day) AS total FROM g
  WINDOW w AS (PARTITION BY user_id ORDER BY day ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING)""")
def moving(spark: SparkSession, folder: str) -> DataFrame:
    """Moving mean and spread, and the running total."""
    grid = events(spark, folder).groupBy("user_id", F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    return timeseries.moving(grid, ["user_id"], "day", "n", 10).select("user_id", "day", F.round("mean", 6).alias("mean"), F.round("spread", 6).alias("spread"), "total")


@query("op_w07_runs", _EV + """, f AS (SELECT user_id, event_id, event_type = 'view' AS flag, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - row_number() OVER (PARTITION BY user_id, event_type = 'view' ORDER BY event_id) AS i FROM ev)
  SELECT user_id, flag, min(event_id) AS start, count(*) AS length FROM f GROUP BY user_id, flag, i""")
def flag_runs(spark: SparkSession, folder: str) -> DataFrame:
    return timeseries.runs(events(spark, folder).select("user_id", "event_id", (F.col("event_type") == "view").alias("flag")), ["user_id"], "event_id", "flag")


@query("op_z05_align")
def align(spark: SparkSession, folder: str) -> DataFrame:
    """Cues laid on voice: daily activity of every user against itself moved by thirty frames; a user's days are bounded."""
    day = F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date"))
    hours = events(spark, folder).select("user_id", (day * 24 + F.hour("ts")).alias("h")).distinct()
    films = hours.groupBy("user_id").agg(F.sort_array(F.collect_set("h")).alias("hs"))
    voice = F.transform(F.sequence(F.lit(0), F.lit(999)), lambda i: F.when(F.array_contains("hs", i), 1.0).otherwise(0.0))
    starts = F.transform("hs", lambda h: ((h + 30) * 10).cast("bigint"))
    films = films.select(F.col("user_id").alias("film"), voice.alias("voice"), starts.alias("starts"), F.transform(starts, lambda s: s + 10).alias("ends"))
    return timeseries.align_films(films)


_MATCH = TITLES_SQL + """, a AS (SELECT DISTINCT anilist_id AS entry, lower(title) AS name, year FROM anime_entries),
 b AS (SELECT a.entry, count(DISTINCT CASE WHEN t.item_id IS NOT NULL AND coalesce(abs(a.year - t.year) <= 1, true) THEN t.item_id END) AS n, min(CASE WHEN coalesce(abs(a.year - t.year) <= 1, true) THEN t.item_id END) AS first, count(t.item_id) AS named
   FROM a LEFT JOIN titles t ON lower(t.title) = a.name GROUP BY 1),
 matched AS (SELECT entry, CASE WHEN n = 1 THEN first END AS title, CASE WHEN n = 1 THEN 'matched' WHEN n > 1 THEN 'ambiguous' WHEN named > 0 THEN 'year conflict' ELSE 'not in catalogue' END AS outcome, n FROM b)
"""


def _named(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    entries = table(spark, folder, "anime_entries").select(F.col("anilist_id").alias("entry"), F.lower("title").alias("name"), "year").distinct()
    return entries, titles(spark, folder).select(F.col("item_id").alias("title"), F.lower("title").alias("name"), "year", "votes")


@query("op_j18_name_match", _MATCH + "SELECT entry, title, outcome, n FROM matched")
def name_match(spark: SparkSession, folder: str) -> DataFrame:
    entries, own = _named(spark, folder)
    return S.name_match(entries, own.drop("votes"))


@query("op_j19_claim", _MATCH + "SELECT entry, title, row_number() OVER (PARTITION BY title ORDER BY entry) = 1 AS claimed FROM matched WHERE title IS NOT NULL")
def claim(spark: SparkSession, folder: str) -> DataFrame:
    """An entry that matches a title another already holds is refused."""
    return S.claim_once(name_match(spark, folder).filter("title is not null"), "title", [F.col("entry")]).select("entry", "title", "claimed")


@query("op_j20_place_imports", TITLES_SQL + """, c AS (SELECT a.anilist_id AS entry, t.item_id AS title, t.votes, row_number() OVER w AS place, lead(coalesce(votes, 0)) OVER w AS second
   FROM (SELECT DISTINCT anilist_id, lower(title) AS name, year FROM anime_entries) a JOIN titles t ON lower(t.title) = a.name AND abs(a.year - t.year) <= 1 WINDOW w AS (PARTITION BY a.anilist_id ORDER BY t.votes DESC NULLS LAST, t.item_id))
  SELECT entry, title FROM c WHERE place = 1 AND (second IS NULL OR coalesce(votes, 0) >= 10 * second)""")
def place_imports(spark: SparkSession, folder: str) -> DataFrame:
    return S.place_imports(*_named(spark, folder))


@query("op_j22_merge_copies", """WITH d AS (SELECT doc_id, imdb_id, source, lang, n_chars FROM documents)
  SELECT imdb_id, array_to_string(list_distinct_first, '|') AS langs, n_chars, copies FROM (
    SELECT imdb_id, list_filter(list(lang ORDER BY doc_id), lambda x, i: x IS NOT NULL AND list_position(list(lang ORDER BY doc_id), x) = i) AS list_distinct_first, arg_min(n_chars, doc_id) FILTER (n_chars IS NOT NULL) AS n_chars, count(*) AS copies FROM d WHERE imdb_id IS NOT NULL AND imdb_id <> '' GROUP BY 1)
  UNION ALL SELECT imdb_id, coalesce(lang, ''), n_chars, 1 FROM d WHERE imdb_id IS NULL OR imdb_id = ''""")
def merge_copies(spark: SparkSession, folder: str) -> DataFrame:
    """Copies of one work as one row: languages in first-seen order, the first known length."""
    docs = table(spark, folder, "documents").select("doc_id", "imdb_id", "lang", "n_chars")
    merged = S.merge_copies(docs, "imdb_id", "doc_id", ["lang"], ["n_chars"])
    return merged.select("imdb_id", F.array_join("lang", "|").alias("langs"), "n_chars", "copies")


_COPIES = """WITH c AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice / 10.0::DOUBLE AS mb, l_quantity * 4 AS minutes, 100.0::DOUBLE AS runtime, 3 - l_linenumber % 4 AS rank, CASE l_suppkey % 5 WHEN 0 THEN 'h264' WHEN 1 THEN 'h265' WHEN 2 THEN 'av1' WHEN 3 THEN 'vp9' END AS codec,
  l_suppkey % 50 AS seeds, l_partkey % 11 = 0 AS local, CASE l_partkey % 3 WHEN 0 THEN 'en' WHEN 1 THEN 'fr' END AS lang, CASE l_suppkey % 7 WHEN 0 THEN 'a.cam.mkv' WHEN 1 THEN 'a.zip' WHEN 2 THEN 'a.web.x264.mkv' ELSE 'a.mkv' END AS name, l_partkey % 2 = 0 AS subs FROM lineitem),
 f AS (SELECT *, CASE WHEN rank >= 3 THEN 12.0 WHEN rank = 2 THEN 5.0 WHEN rank = 1 THEN 3.0 ELSE 1.0 END::DOUBLE * CASE WHEN codec IN ('h265', 'av1') THEN 0.6 ELSE 1.0 END::DOUBLE AS floor, mb / minutes AS dense, minutes / runtime AS ratio, 0.8::DOUBLE / (mb / (minutes * 60)) AS room FROM c),
 p AS (SELECT *, CASE WHEN lang IS NULL THEN 0.0 WHEN lang = 'en' THEN 1.0 ELSE -1.0 END::DOUBLE AS language, CASE WHEN rank > 2 THEN -1.0 WHEN rank = 2 THEN 1.0 ELSE 1 - 0.5 * (2 - rank) END::DOUBLE AS quality, CASE WHEN dense < floor THEN -1.0 WHEN dense < 2 * floor THEN 0.0 ELSE 1.0 END::DOUBLE AS plausibility,
  CASE WHEN ratio < 0.8 THEN -1.0 WHEN ratio > 1.3 THEN 0.0 ELSE 1.0 END::DOUBLE AS duration, CASE WHEN l_suppkey % 7 < 2 THEN -1.0 WHEN l_suppkey % 7 = 2 THEN 1.0 ELSE 0.0 END::DOUBLE AS encoding, CASE WHEN local THEN 1.0 ELSE (seeds - 5)::DOUBLE / (seeds + 5) END::DOUBLE AS health,
  CASE WHEN codec = 'h264' THEN 1.0 WHEN codec IN ('h265', 'av1') THEN -0.5 WHEN codec = 'vp9' THEN 0.5 ELSE 0.0 END::DOUBLE AS compatibility, CASE WHEN local THEN 1.0 WHEN room >= 1.5 THEN 1.0 WHEN room >= 1 THEN 0.0 ELSE -1.0 END::DOUBLE AS throughput, CASE WHEN subs THEN 1.0 ELSE 0.0 END::DOUBLE AS subtitles FROM f),
 s AS (SELECT *, round(4 * language + 3 * quality + 3 * plausibility + 2 * health + 2 * duration + 2 * compatibility + 2 * throughput + encoding + 0.5 * subtitles, 6) AS total FROM p)
"""


def _copies(spark: SparkSession, folder: str) -> DataFrame:
    """Order lines as copies of what the order asks for."""
    def choose(n, *names):
        out = F.lit(None).cast("string")
        for i, name in enumerate(names):
            out = F.when(n == i, name).otherwise(out)
        return out

    supp, part = F.col("l_suppkey"), F.col("l_partkey")
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    return lines.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (F.col("l_extendedprice") / 10).alias("mb"), (F.col("l_quantity") * 4).alias("minutes"), F.lit(100.0).alias("runtime"), (3 - F.col("l_linenumber") % 4).alias("rank"),
        choose(supp % 5, "h264", "h265", "av1", "vp9").alias("codec"), (supp % 50).alias("seeds"), (part % 11 == 0).alias("local"), choose(part % 3, "en", "fr").alias("language"),
        F.coalesce(choose(supp % 7, "a.cam.mkv", "a.zip", "a.web.x264.mkv"), F.lit("a.mkv")).alias("name"), (part % 2 == 0).alias("has_subtitles"),
    )


@query("op_q01_rank_copies", _COPIES + """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, total, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY plausibility = -1 OR duration = -1 OR encoding = -1, language = -1, NOT local, health < 0 OR throughput = -1, abs(rank - 2), total DESC, l_linenumber, l_partkey, l_suppkey) AS INT) AS place FROM s""")
def rank_copies(spark: SparkSession, folder: str) -> DataFrame:
    """Copies of an order in order of choice, by nine terms."""
    ranked = S.rank_copies(_copies(spark, folder), ["l_orderkey"], [F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey")], "en", 2, 2, 0.8)
    return ranked.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "total", "place")


@query("op_q07_quota", _EV + "SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id, ts::DATE ORDER BY ts, event_id) <= 2 AS granted FROM ev")
def quota(spark: SparkSession, folder: str) -> DataFrame:
    """Requests within a daily budget of two."""
    n = F.row_number().over(Window.partitionBy("user_id", F.to_date("ts")).orderBy("ts", "event_id"))
    return events(spark, folder).select("event_id", "user_id", (n <= 2).alias("granted"))


@query("op_x04_filename")
def filenames(spark: SparkSession, folder: str) -> DataFrame:
    """Names and paths in eight layouts made of all titles, read back: per layout how many came out with their title's words, year
    and episode. Titles that themselves look like facts are among them."""
    own = table(spark, folder, "media_items").filter("title is not null and year is not null").select("item_id", "title", "year").distinct()
    dotted, year, n = F.regexp_replace("title", r"[\s/\\]+", "."), F.col("year").cast("string"), F.lpad((F.col("item_id") % 24 + 1).cast("string"), 2, "0")
    flat = F.regexp_replace("title", r"[/\\]+", " ")
    layouts = {
        "film dotted": F.concat(dotted, F.lit("."), year, F.lit(".1080p.WEB-DL.x264-CREW.mkv")), "film brackets": F.concat(flat, F.lit(" ("), year, F.lit(") [720p].mp4")),
        "episode": F.concat(dotted, F.lit(".S01E"), n, F.lit(".720p.HDTV.x265-CREW.mkv")), "episode cross": F.concat(flat, F.lit(" 1x"), n, F.lit(".avi")), "running": F.concat(F.lit("[Crew] "), flat, F.lit(" - "), n, F.lit("v2 [1080p].mkv")),
        "season folder": F.concat(flat, F.lit("/Season 1/Episode "), n, F.lit(".mkv")), "bare number": F.concat(flat, F.lit(" ("), year, F.lit(")/"), n, F.lit(".mkv")), "dated": F.concat(dotted, F.lit(".2019.05.17.720p.WEB.mkv")),
    }
    each = own.select("title", "year", F.col("item_id") % 24 + 1, F.explode(F.array(*[F.struct(F.lit(k).alias("layout"), v.alias("path")) for k, v in layouts.items()])).alias("x")).toDF("title", "year", "n", "x")
    read = each.select("title", "year", "n", "x.layout", parse_path(F.col("x.path")).alias("f"))
    words = lambda c: F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " "))
    count = lambda c: F.count(F.when(c, 1))
    return read.groupBy("layout").agg(
        F.count(F.lit(1)).alias("names"), count(words(F.col("title")) == words(F.col("f.title"))).alias("titles"), count(F.col("f.year") == F.col("year")).alias("years"), count(F.col("f.episode") == F.col("n")).alias("episodes")
    )


@query("op_st10_stream_inserts", "SELECT DISTINCT event_id, user_id, event_type FROM events")
def stream_inserts(spark: SparkSession, folder: str) -> DataFrame:
    """Events inserted once by a resumable stream that runs until its input ends."""
    like = table(spark, folder, "events")
    out = f"{shared_dir(spark)}/inserts-{uuid.uuid4().hex}"
    stream = streams.file_stream(spark, f"{folder}/[e]vents.parquet", like).select("event_id", "user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    streams.run_to_end(streams.inserted_once(stream, ["event_id"], "ts", "60 days"), f"{out}/rows", f"{out}/checkpoint")
    return spark.read.parquet(f"{out}/rows").select("event_id", "user_id", "event_type")


QUERIES, ORACLES = _r.queries, _r.oracles
