"""What profiles did and are shown: labels, shelves, resume points, discovery arms, scores and plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenframe.operators import recommend as C
from lumenframe.operators.relational import SERIES_KINDS, top_per_key
from lumenframe.operators.selection import stall_chance
from lumenframe.plans.base import EVENTS_SQL, RATINGS_SQL, TITLES_SQL, Registry, events, ratings, titles
from lumenframe.tables import table

_r = Registry()
query = _r.query
_EV = "WITH " + EVENTS_SQL
_desc = lambda c: F.col(c).desc_nulls_last()


@query("op_a02_ratings_view", "WITH " + RATINGS_SQL + """, s AS (SELECT "user", item, avg(stars) AS mean, max(stars) AS best FROM rating GROUP BY 1, 2 HAVING count(*) > 1), o AS (SELECT "user", item, stars FROM rating)
  SELECT "user", item, round(mean, 6) AS stars, round(best, 6) AS best, true AS by_season FROM s UNION ALL SELECT "user", item, round(stars, 6), round(stars, 6), false FROM o ANTI JOIN s USING ("user", item)""")
def ratings_view(spark: SparkSession, folder: str) -> DataFrame:
    """Own ratings, overridden by the mean where a title was rated by parts."""
    own = ratings(spark, folder)
    parts = own.groupBy("user", "item").agg(F.avg("stars").alias("stars"), F.max("stars").alias("best"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    single = own.join(parts, ["user", "item"], "left_anti").select("user", "item", "stars", F.col("stars").alias("best"), F.lit(False).alias("by_season"))
    both = parts.withColumn("by_season", F.lit(True)).unionByName(single)
    return both.withColumns({"stars": F.round("stars", 6), "best": F.round("best", 6)})


@query("op_a06_fingerprint", _EV + """SELECT count(*) || '|' || max(event_id) || '|' || sum(event_id % 1000003) AS fingerprint FROM ev""")
def fingerprint(spark: SparkSession, folder: str) -> DataFrame:
    """Count, greatest id and a sum as one text, to see whether signals changed."""
    return events(spark, folder).agg(F.concat_ws("|", F.count(F.lit(1)).cast("string"), F.max("event_id").cast("string"), F.sum(F.col("event_id") % 1000003).cast("string")).alias("fingerprint"))


@query("op_a07_liked_weights", "WITH " + RATINGS_SQL + """, h AS (SELECT "user", item, CAST(max(round(stars * 2)) AS INT) AS halves FROM rating GROUP BY 1, 2)
  SELECT "user", item, round(CASE WHEN halves >= 8 THEN 0.7 + (halves - 8) * 0.15 ELSE 0.3 END, 6)::DOUBLE AS weight FROM h WHERE halves >= 8 OR halves BETWEEN 5 AND 6""")
def liked_weights(spark: SparkSession, folder: str) -> DataFrame:
    """Weights of liked titles by half stars; middling ones count a little."""
    halves = ratings(spark, folder).groupBy("user", "item").agg(F.max(F.round(F.col("stars") * 2)).cast("int").alias("halves"))
    liked = halves.filter("halves >= 8 or halves between 5 and 6")
    return liked.select("user", "item", F.round(F.when(F.col("halves") >= 8, 0.7 + (F.col("halves") - 8) * 0.15).otherwise(0.3), 6).alias("weight"))


@query("op_x11_rating_weight", "WITH " + RATINGS_SQL + """, p AS (SELECT "user", item, l, stars, list_transform(range(1, 6), lambda i: [0.5, 1, 2, 3, 4, 5][i]::DOUBLE) AS x FROM (SELECT *, 1 AS l FROM rating))
  SELECT item, round(sum(CASE WHEN stars < 2 THEN -1 + (stars - 1) * 0.4 WHEN stars < 3 THEN -0.6 + (stars - 2) * 0.8 WHEN stars < 4 THEN 0.2 + (stars - 3) * 0.8 ELSE 1 + (stars - 4) * 0.6 END), 6) AS weight FROM p GROUP BY item""")
def rating_weight(spark: SparkSession, folder: str) -> DataFrame:
    """Piecewise linear weight of stars, summed by item."""
    s = F.col("stars")
    w = F.when(s < 2, -1 + (s - 1) * 0.4).when(s < 3, -0.6 + (s - 2) * 0.8).when(s < 4, 0.2 + (s - 3) * 0.8).otherwise(1 + (s - 4) * 0.6)
    return ratings(spark, folder).groupBy("item").agg(F.round(F.sum(w), 6).alias("weight"))


@query("op_f11_hidden", _EV + """, h AS (SELECT user_id, item, max(ts) AS hidden_at FROM ev WHERE event_type = 'error' GROUP BY 1, 2)
  SELECT user_id, item, hidden_at FROM h WHERE NOT EXISTS (SELECT 1 FROM ev w WHERE w.user_id = h.user_id AND w.item = h.item AND w.event_type = 'view' AND w.ts > h.hidden_at)""")
def hidden(spark: SparkSession, folder: str) -> DataFrame:
    """What was hidden and not watched since: one pass over each pair's latest times."""
    last = lambda t: F.max(F.when(F.col("event_type") == t, F.col("ts")))
    both = events(spark, folder).groupBy("user_id", "item").agg(last("error").alias("hidden_at"), last("view").alias("seen_at"))
    return both.filter(F.col("hidden_at").isNotNull() & ~F.coalesce(F.col("seen_at") > F.col("hidden_at"), F.lit(False))).select("user_id", "item", "hidden_at")


@query("op_f18_due", """WITH asked AS (SELECT item_id, max(shown_at) AS last FROM recommendations WHERE source = 'tmdb' GROUP BY 1), m AS (SELECT max(shown_at) AS now FROM recommendations)
  SELECT DISTINCT item_id FROM media_items ANTI JOIN (SELECT item_id FROM asked, m WHERE last >= now - INTERVAL 90 DAY) USING (item_id)""")
def due(spark: SparkSession, folder: str) -> DataFrame:
    """Titles that a source hasn't been asked about for ninety days."""
    shown = table(spark, folder, "recommendations").select("source", "item_id", "shown_at")
    now = shown.agg(F.max("shown_at").alias("now"))
    recent = shown.filter("source = 'tmdb'").groupBy("item_id").agg(F.max("shown_at").alias("last")).join(F.broadcast(now)).filter(F.col("last") >= F.col("now") - F.expr("interval 90 days"))
    return table(spark, folder, "media_items").select("item_id").distinct().join(recent.select("item_id"), "item_id", "left_anti")


@query("op_j14_makers_other_works", """WITH loved AS (SELECT DISTINCT p_brand, l_partkey FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_quantity >= 50 AND l_returnflag = 'R'),
  r AS (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS n FROM part)
  SELECT l.l_partkey AS loved, r.p_partkey AS other FROM loved l JOIN r ON r.p_brand = l.p_brand AND r.n <= 5 AND r.p_partkey <> l.l_partkey""")
def makers_other_works(spark: SparkSession, folder: str) -> DataFrame:
    """The first works of the makers of what is loved, at most five each."""
    parts = table(spark, folder, "part").select("p_partkey", "p_brand", "p_retailprice")
    lines = table(spark, folder, "lineitem").filter("l_quantity >= 50 and l_returnflag = 'R'").select(F.col("l_partkey").alias("loved"))
    loved = lines.distinct().join(parts.select(F.col("p_partkey").alias("loved"), "p_brand"), "loved")
    first = top_per_key(parts, ["p_brand"], [F.col("p_retailprice").desc(), F.col("p_partkey")], 5).select("p_brand", F.col("p_partkey").alias("other"))
    return loved.join(first, "p_brand").filter("loved <> other").select("loved", "other")


@query("op_j17_document", TITLES_SQL + """, n AS (SELECT item_id, list_sort(list_distinct(list_filter(alternative_titles, lambda x: x IS NOT NULL)))[1:4] AS other FROM (SELECT item_id, any_value(alternative_titles) AS alternative_titles FROM media_items GROUP BY 1))
  SELECT item_id, concat_ws('. ', title || coalesce(' (' || year || ')', ''), nullif(array_to_string(other, ', '), ''), array_to_string(list_sort(string_split(genres, ',')), ' ')) AS document FROM titles JOIN n USING (item_id)""")
def document(spark: SparkSession, folder: str) -> DataFrame:
    """The descriptive text of every title: name and year, up to four other names, genres."""
    items = table(spark, folder, "media_items").select("item_id", "title", "year", "genres", "alternative_titles").distinct()
    other = F.slice(F.array_sort(F.array_distinct(F.filter(F.coalesce("alternative_titles", F.array().cast("array<string>")), lambda x: x.isNotNull()))), 1, 4)
    name = F.concat("title", F.coalesce(F.concat(F.lit(" ("), F.col("year").cast("string"), F.lit(")")), F.lit("")))
    return items.select("item_id", F.concat_ws(". ", name, F.nullif(F.array_join(other, ", "), F.lit("")), F.array_join(F.array_sort(F.split("genres", ",")), " ")).alias("document"))


@query("op_a18_offers", """SELECT imdb_id, lang, count(*) AS copies, CAST(row_number() OVER (PARTITION BY imdb_id ORDER BY count(*) DESC, lang) AS INT) AS rank FROM documents WHERE imdb_id IS NOT NULL AND lang IS NOT NULL GROUP BY 1, 2""")
def offers(spark: SparkSession, folder: str) -> DataFrame:
    """Languages on offer for each title, most copies first."""
    own = table(spark, folder, "documents").select("imdb_id", "lang").dropna().groupBy("imdb_id", "lang").agg(F.count(F.lit(1)).alias("copies"))
    return own.withColumn("rank", F.row_number().over(Window.partitionBy("imdb_id").orderBy(F.col("copies").desc(), "lang")))


@query("op_a15_second_half", _EV + """, n AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, count(*) OVER (PARTITION BY user_id) AS c FROM ev)
  SELECT user_id, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS spread FROM n WHERE n > c // 2 GROUP BY 1""")
def second_half(spark: SparkSession, folder: str) -> DataFrame:
    """Mean and spread of the second half of every user's samples."""
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    half = events(spark, folder).withColumn("n", n).withColumn("c", F.count(F.lit(1)).over(Window.partitionBy("user_id"))).filter("n > c div 2")
    return half.groupBy("user_id").agg(F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev_pop("value"), 6).alias("spread"))


@query("op_w02_new_episodes", """WITH e AS (SELECT DISTINCT mirror_id, parent_imdb_id, imdb_id, year FROM title_snapshots WHERE title_type = 'tvEpisode' AND parent_imdb_id IS NOT NULL)
  SELECT mirror_id, parent_imdb_id, imdb_id, year FROM e QUALIFY row_number() OVER (PARTITION BY mirror_id, parent_imdb_id ORDER BY year DESC NULLS LAST, imdb_id DESC) = 1""")
def new_episodes(spark: SparkSession, folder: str) -> DataFrame:
    """The newest episode of every series."""
    own = table(spark, folder, "title_snapshots").filter("title_type = 'tvEpisode' and parent_imdb_id is not null").select("mirror_id", "parent_imdb_id", "imdb_id", "year").distinct()
    return top_per_key(own, ["mirror_id", "parent_imdb_id"], [_desc("year"), F.col("imdb_id").desc()], 1).drop("rank")


@query("op_w05_rolling_floor", _EV + """, g AS (SELECT user_id, date_trunc('day', ts) AS day, quantile_disc(value, 0.1) AS q FROM ev WHERE value IS NOT NULL GROUP BY 1, 2)
  SELECT user_id, day, round(min(q) OVER (PARTITION BY user_id ORDER BY day ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING), 6) AS floor FROM g""")
def rolling_floor(spark: SparkSession, folder: str) -> DataFrame:
    """The least tenth percentile of the blocks around each block."""
    blocks = events(spark, folder).filter("value is not null").groupBy("user_id", F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day")).agg(F.expr("percentile_disc(0.1) WITHIN GROUP (ORDER BY value)").alias("q"))
    around = Window.partitionBy("user_id").orderBy("day").rowsBetween(-3, 3)
    return blocks.select("user_id", "day", F.round(F.min("q").over(around), 6).alias("floor"))


@query("op_t06_to_rate", TITLES_SQL + """, met AS (SELECT DISTINCT profile_id, item_id FROM recommendations WHERE profile_id IS NOT NULL), films AS (SELECT item_id, votes FROM titles WHERE kind = 'movie'),
  f AS (SELECT p.profile_id, f.item_id, f.votes FROM (SELECT DISTINCT profile_id FROM met) p, films f), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY profile_id ORDER BY votes DESC NULLS LAST, item_id) AS INT) AS place FROM f ANTI JOIN met USING (profile_id, item_id))
  SELECT profile_id, item_id, place FROM r WHERE place BETWEEN 21 AND 40""")
def to_rate(spark: SparkSession, folder: str) -> DataFrame:
    """The second page of popular films that each profile hasn't met. A profile looks at as many of the most voted films as its
    pages hold and it has met, so no profile meets every film."""
    met = table(spark, folder, "recommendations").filter("profile_id is not null").select("profile_id", "item_id").distinct()
    films = titles(spark, folder).filter("kind = 'movie'").select("item_id", "votes")
    reach = met.groupBy("profile_id").agg((40 + F.count(F.lit(1))).cast("int").alias("n"))
    best = films.orderBy(_desc("votes"), "item_id").limit(reach.agg(F.coalesce(F.max("n"), F.lit(0)).alias("n")).first().n)  # as far as any profile looks
    ranked = best.select("item_id", F.row_number().over(Window.orderBy(_desc("votes"), "item_id")).alias("at"))
    looked = reach.select("profile_id", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("at")).join(ranked, "at")
    rest = looked.join(met, ["profile_id", "item_id"], "left_anti")
    return rest.select("profile_id", "item_id", F.row_number().over(Window.partitionBy("profile_id").orderBy("at")).alias("place")).filter("place between 21 and 40")


@query("op_t09_queue_plan", """SELECT o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, o_orderkey) AS INT) AS place,
  CASE WHEN row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, o_orderkey) <= 3 THEN 'start' ELSE 'hold' END AS action FROM orders WHERE o_orderstatus = 'O'""")
def queue_plan(spark: SparkSession, folder: str) -> DataFrame:
    """The first three waiting jobs of every owner start, the others hold."""
    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderpriority", "o_orderkey"))
    own = table(spark, folder, "orders").filter("o_orderstatus = 'O'").select("o_orderkey", place.alias("place"))
    return own.withColumn("action", F.when(F.col("place") <= 3, "start").otherwise("hold"))


@query("op_u04_difference", TITLES_SQL + "SELECT imdb_id FROM titles ANTI JOIN (SELECT imdb_id FROM documents WHERE imdb_id IS NOT NULL) USING (imdb_id)")
def difference(spark: SparkSession, folder: str) -> DataFrame:
    """Titles without a text."""
    return titles(spark, folder).select("imdb_id").join(table(spark, folder, "documents").select("imdb_id"), "imdb_id", "left_anti")


@query("op_r06_axis_score", "WITH " + RATINGS_SQL + """, t AS (SELECT "user", p_type AS axis, sum(stars - 3) AS w FROM rating JOIN part ON p_partkey = item GROUP BY 1, 2)
  SELECT "user", round(greatest(-1, least(1, max(w) / 10 + least(min(w), 0) / 10)), 6)::DOUBLE AS score FROM t GROUP BY 1""")
def axis_score(spark: SparkSession, folder: str) -> DataFrame:
    """The best axis of a user less the worst avoided one, within -1 and 1."""
    kinds = table(spark, folder, "part").select(F.col("p_partkey").alias("item"), F.col("p_type").alias("axis"))
    w = ratings(spark, folder).join(kinds, "item").groupBy("user", "axis").agg(F.sum(F.col("stars") - 3).alias("w"))
    raw = F.max("w") / 10 + F.least(F.min("w"), F.lit(0.0)) / 10
    return w.groupBy("user").agg(F.round(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), raw)), 6).alias("score"))


@query("op_r19_outcomes", _EV + """, s AS (SELECT user_id, item, max(CASE event_type WHEN 'purchase' THEN 4 WHEN 'error' THEN 3 WHEN 'view' THEN 2 WHEN 'click' THEN 1 ELSE 0 END) AS k FROM ev GROUP BY 1, 2)
  SELECT user_id, item, CASE k WHEN 4 THEN 1.0 WHEN 3 THEN 0.0 WHEN 2 THEN 0.6 WHEN 1 THEN 0.3 ELSE 0.5 END::DOUBLE AS reward FROM s""")
def outcomes(spark: SparkSession, folder: str) -> DataFrame:
    """The strongest outcome of every pair as a reward."""
    strength, reward = {"purchase": 4, "error": 3, "view": 2, "click": 1}, {4: 1.0, 3: 0.0, 2: 0.6, 1: 0.3}
    k = F.lit(0)
    for t, n in strength.items():
        k = F.when(F.col("event_type") == t, n).otherwise(k)
    best = F.lit(0.5)
    own = events(spark, folder).groupBy("user_id", "item").agg(F.max(k).alias("k"))
    for n, value in reward.items():
        best = F.when(F.col("k") == n, value).otherwise(best)
    return own.select("user_id", "item", best.alias("reward"))


@query("op_r21_discovery_share", _EV + """, c AS (SELECT user_id, avg(CASE WHEN event_type = 'purchase' THEN 1.0 ELSE 0.0 END) - 0.2 AS lead FROM ev GROUP BY 1) SELECT user_id, round(greatest(0.2, least(0.8, 0.4 + 0.6 * lead)), 6)::DOUBLE AS share FROM c""")
def discovery_share(spark: SparkSession, folder: str) -> DataFrame:
    """Share of new things between a floor and a ceiling, by how well they did."""
    lead = F.avg(F.when(F.col("event_type") == "purchase", 1.0).otherwise(0.0)) - 0.2
    return events(spark, folder).groupBy("user_id").agg(F.round(F.greatest(F.lit(0.2), F.least(F.lit(0.8), 0.4 + 0.6 * lead)), 6).alias("share"))


@query("op_r26_shelves", TITLES_SQL + """, g AS (SELECT DISTINCT item_id, votes, trim(x.g) AS shelf FROM titles, unnest(string_split(genres, ',')) AS x(g))
  SELECT shelf, item_id, votes, CAST(row_number() OVER (PARTITION BY shelf ORDER BY votes DESC NULLS LAST, item_id) AS INT) AS rank FROM g QUALIFY rank <= 20""")
def shelves(spark: SparkSession, folder: str) -> DataFrame:
    """The most voted of every genre."""
    g = titles(spark, folder).select("item_id", "votes", F.explode(F.split("genres", ",")).alias("shelf")).withColumn("shelf", F.trim("shelf")).distinct()
    return top_per_key(g, ["shelf"], [_desc("votes"), F.col("item_id")], 20).select("shelf", "item_id", "votes", "rank")


@query("op_r09_quotas", TITLES_SQL + """, w AS (SELECT r.profile_id, t.kind, count(*)::DOUBLE AS w FROM (SELECT DISTINCT rec_id, profile_id, item_id FROM recommendations WHERE profile_id IS NOT NULL) r JOIN titles t USING (item_id) GROUP BY 1, 2),
  x AS (SELECT *, round(w * 20 / sum(w) OVER (PARTITION BY profile_id), 9) AS e FROM w), f AS (SELECT *, floor(e) AS n0 FROM x),
  g AS (SELECT *, n0 + CASE WHEN row_number() OVER (PARTITION BY profile_id ORDER BY e - n0 DESC, kind NULLS FIRST) <= 20 - sum(n0) OVER (PARTITION BY profile_id) THEN 1 ELSE 0 END AS n FROM f),
  b AS (SELECT *, sum(CASE WHEN n = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY profile_id) AS bare FROM g),
  u AS (SELECT profile_id, kind, bare, unnest(range(2, CAST(n AS BIGINT) + 1)) AS height FROM b WHERE n > 1),
  l AS (SELECT profile_id, kind, count(*) AS lost FROM (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY profile_id ORDER BY height DESC, kind NULLS FIRST) <= bare) GROUP BY 1, 2)
  SELECT b.profile_id, b.kind, CAST(CASE WHEN n = 0 THEN 1 ELSE n - coalesce(lost, 0) END AS INT) AS places FROM b LEFT JOIN l ON l.profile_id = b.profile_id AND l.kind IS NOT DISTINCT FROM b.kind""")
def place_quotas(spark: SparkSession, folder: str) -> DataFrame:
    """Places per kind for every profile, by largest remainders over what it was shown."""
    kinds = titles(spark, folder).select("item_id", "kind")
    shown = table(spark, folder, "recommendations").filter("profile_id is not null").select("rec_id", "profile_id", "item_id").distinct()
    n = shown.join(kinds, "item_id").groupBy("profile_id", "kind").agg(F.count(F.lit(1)).alias("w"))
    return C.quotas(n, ["profile_id"], "kind", "w", 20).select("profile_id", "kind", "places")


@query("op_q04_advice", """WITH c AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, (l_extendedprice / 10000.0::DOUBLE) AS need, l_quantity / 5.0::DOUBLE AS thr, l_quantity / 20.0::DOUBLE + 0.1 AS spread FROM lineitem), z AS (SELECT *, (1.05 * need - thr) / sqrt(spread * spread + 0.04) AS x FROM c),
  t AS (SELECT *, 1 / (1 + 0.2316419 * abs(x)) AS t FROM z), p AS (SELECT *, exp(-x * x / 2) / sqrt(2 * pi()) * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429)))) AS tail FROM t)
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(CASE WHEN x >= 0 THEN 1 - tail ELSE tail END, 6) AS stall FROM p""")
def advice(spark: SparkSession, folder: str) -> DataFrame:
    """The chance that streaming stalls, from needed rate, throughput and their spread."""
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    stall = stall_chance(F.col("l_extendedprice") / 10000, F.col("l_quantity") / 5, F.col("l_quantity") / 20 + 0.1, F.lit(0.2))
    return lines.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(stall, 6).alias("stall"))


@query("op_q06_choose_text", """SELECT DISTINCT ON (imdb_id) imdb_id, doc_id, lang FROM documents WHERE imdb_id IS NOT NULL
  ORDER BY imdb_id, CASE lang WHEN 'en' THEN 0 WHEN 'fr' THEN 1 ELSE 2 END, source NULLS LAST, doc_id""")
def choose_text(spark: SparkSession, folder: str) -> DataFrame:
    """One text per title, by language preference, then source."""
    want = F.when(F.col("lang") == "en", 0).when(F.col("lang") == "fr", 1).otherwise(2)
    key = F.struct(want.alias("w"), F.col("source").isNull().alias("none"), F.coalesce("source", F.lit("")).alias("s"), F.col("doc_id"))
    return table(spark, folder, "documents").filter("imdb_id is not null").groupBy("imdb_id").agg(F.min_by(F.struct("doc_id", "lang"), key).alias("d")).select("imdb_id", "d.doc_id", "d.lang")


@query("op_e03_review_queue", """WITH p AS (SELECT DISTINCT a.anilist_id, m.item_id, (CASE WHEN a.year IS NULL OR m.year IS NULL THEN 0.5 WHEN a.year = m.year THEN 1.0 WHEN abs(a.year - m.year) = 1 THEN 0.6 ELSE 0.0 END)::DOUBLE AS s, m.votes
    FROM anime_entries a JOIN media_items m ON lower(a.title) = lower(m.title)), r AS (SELECT *, row_number() OVER (PARTITION BY anilist_id ORDER BY s DESC, votes DESC NULLS LAST, item_id) AS n FROM p),
  c AS (SELECT anilist_id, max(s) FILTER (n = 1) AS best, coalesce(max(s) FILTER (n = 2), 0) AS next, max(item_id) FILTER (n = 1) AS item_id FROM r GROUP BY 1)
  SELECT anilist_id, item_id, round(greatest(0, least(1, (best - next) / 0.12)) * greatest(0, least(1, (best - 0.5) / 0.3)), 6)::DOUBLE AS confidence FROM c""")
def review_queue(spark: SparkSession, folder: str) -> DataFrame:
    """Confidence from the best candidate's score and its lead; low ones go to review."""
    entries = table(spark, folder, "anime_entries").select("anilist_id", F.lower("title").alias("n"), F.col("year").alias("y"))
    items = table(spark, folder, "media_items").select("item_id", F.lower("title").alias("n"), "year", "votes")
    s = F.when(F.col("y").isNull() | F.col("year").isNull(), 0.5).when(F.col("y") == F.col("year"), 1.0).when(F.abs(F.col("y") - F.col("year")) == 1, 0.6).otherwise(0.0)
    pairs = entries.join(items, "n").select("anilist_id", "item_id", s.alias("s"), "votes").distinct()
    top = top_per_key(pairs, ["anilist_id"], [F.col("s").desc(), _desc("votes"), F.col("item_id")], 2)
    two = top.groupBy("anilist_id").agg(F.max(F.when(F.col("rank") == 1, F.col("s"))).alias("best"), F.coalesce(F.max(F.when(F.col("rank") == 2, F.col("s"))), F.lit(0.0)).alias("next"), F.max(F.when(F.col("rank") == 1, F.col("item_id"))).alias("item_id"))
    clamp = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    return two.select("anilist_id", "item_id", F.round(clamp((F.col("best") - F.col("next")) / 0.12) * clamp((F.col("best") - 0.5) / 0.3), 6).alias("confidence"))


@query("op_s18_archive", """SELECT profile_id, count(*) AS entries, count(*) FILTER (reference IS NULL) AS unmatched FROM (
  SELECT DISTINCT r.profile_id, r.item_id, CASE WHEN m.imdb_id IS NOT NULL THEN 'imdb:' || m.imdb_id END AS reference FROM recommendations r LEFT JOIN (SELECT DISTINCT item_id, imdb_id FROM media_items) m USING (item_id)) GROUP BY 1""")
def archive(spark: SparkSession, folder: str) -> DataFrame:
    """What an archive of each profile would hold by external id, and what has none."""
    ids = table(spark, folder, "media_items").select("item_id", "imdb_id").distinct()
    own = table(spark, folder, "recommendations").select("profile_id", "item_id").distinct().join(ids, "item_id", "left").select("profile_id", "item_id", F.concat(F.lit("imdb:"), "imdb_id").alias("reference")).distinct()
    return own.groupBy("profile_id").agg(F.count(F.lit(1)).alias("entries"), F.count(F.when(F.col("reference").isNull(), 1)).alias("unmatched"))


@query("op_st13_catch_up", TITLES_SQL + """, ix AS (SELECT imdb_id, max(loaded_at) AS at FROM title_snapshots GROUP BY 1) SELECT t.imdb_id, CASE WHEN ix.at IS NULL THEN 'add' ELSE 'again' END AS action FROM titles t LEFT JOIN ix USING (imdb_id) WHERE ix.at IS NULL OR t.updated_at > ix.at""")
def catch_up(spark: SparkSession, folder: str) -> DataFrame:
    """Titles an index lacks or holds in an older state."""
    index = table(spark, folder, "title_snapshots").groupBy("imdb_id").agg(F.max("loaded_at").alias("at"))
    both = titles(spark, folder).select("imdb_id", "updated_at").join(index, "imdb_id", "left").filter(F.col("at").isNull() | (F.col("updated_at") > F.col("at")))
    return both.select("imdb_id", F.when(F.col("at").isNull(), "add").otherwise("again").alias("action"))


@query("op_j07_episode_parents", TITLES_SQL + """SELECT e.imdb_id, t.item_id AS series FROM (SELECT DISTINCT imdb_id, parent_imdb_id FROM title_snapshots WHERE title_type = 'tvEpisode') e JOIN titles t ON t.imdb_id = e.parent_imdb_id
  WHERE t.kind IN ('tvSeries', 'tvMiniSeries') AND (t.votes >= 20 OR list_contains(string_split(t.genres, ','), 'Animation'))""")
def episode_parents(spark: SparkSession, folder: str) -> DataFrame:
    """Episodes of the series in scope."""
    e = table(spark, folder, "title_snapshots").filter("title_type = 'tvEpisode'").select("imdb_id", "parent_imdb_id").distinct()
    inside = (F.col("votes") >= 20) | F.array_contains(F.split("genres", ","), "Animation")
    t = titles(spark, folder).filter(F.col("kind").isin(*SERIES_KINDS) & F.coalesce(inside, F.col("votes") >= 20, F.array_contains(F.split("genres", ","), "Animation"))).select(F.col("imdb_id").alias("parent_imdb_id"), F.col("item_id").alias("series"))
    return e.join(t, "parent_imdb_id").select("imdb_id", "series")


QUERIES, ORACLES = _r.queries, _r.oracles
