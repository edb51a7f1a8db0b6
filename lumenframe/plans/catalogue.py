"""Catalogue queries: scopes, top lists, joins by name, ordered unions, snapshots of episodes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenframe.operators import relational as R
from lumenframe.plans.base import TITLES_SQL, Registry, titles
from lumenframe.tables import table

_r = Registry()
query = _r.query
FILMS = "('movie', 'tvMovie', 'video', 'short', 'tvSpecial')"
SERIES = "('tvSeries', 'tvMiniSeries')"
_desc = lambda c: F.col(c).desc_nulls_last()


@query("op_f01_scope", TITLES_SQL + """SELECT item_id, kind, votes, year FROM titles
  WHERE CASE WHEN votes IS NULL THEN coalesce(year >= 2024 - 2, false) ELSE votes >= 10 END""")
def scope(spark: SparkSession, folder: str) -> DataFrame:
    """Kept kinds with enough votes, or unrated and recent."""
    kept = titles(spark, folder).filter(F.col("kind").isin(*R.KEPT_KINDS) & R.in_scope(F.col("votes"), F.col("year"), 10, 2024, 2))
    return kept.select("item_id", "kind", "votes", "year")


@query("op_f02_tiers", TITLES_SQL + """SELECT in_core, count(*) AS titles, sum(CAST(votes AS BIGINT))::BIGINT AS votes FROM (
  SELECT *, CASE WHEN votes IS NULL THEN coalesce(year >= 2022, false) ELSE votes >= 10 END AS in_core FROM titles) GROUP BY 1""")
def tiers(spark: SparkSession, folder: str) -> DataFrame:
    core = titles(spark, folder).withColumn("in_core", R.in_scope(F.col("votes"), F.col("year"), 10, 2024, 2))
    return core.groupBy("in_core").agg(F.count(F.lit(1)).alias("titles"), F.sum("votes").alias("votes"))


@query("op_f03_kinds", TITLES_SQL + f"""SELECT CASE WHEN kind IN {FILMS} THEN 'film' WHEN kind IN {SERIES} THEN 'series' END AS media_kind,
  count(*) AS titles, count(runtime_minutes) AS timed FROM titles GROUP BY 1""")
def kinds(spark: SparkSession, folder: str) -> DataFrame:
    kind = R.media_kind(F.col("kind")).alias("media_kind")
    return titles(spark, folder).groupBy(kind).agg(F.count(F.lit(1)).alias("titles"), F.count("runtime_minutes").alias("timed"))


@query("op_f06_filters", TITLES_SQL + "SELECT item_id, year, runtime_minutes FROM titles WHERE year BETWEEN 1990 AND 1999 AND runtime_minutes <= 100")
def filters(spark: SparkSession, folder: str) -> DataFrame:
    """Search filters: an unknown year or runtime fails."""
    return titles(spark, folder).filter(F.col("year").between(1990, 1999) & (F.col("runtime_minutes") <= 100)).select("item_id", "year", "runtime_minutes")


@query("op_f07_filters_only", TITLES_SQL + """SELECT item_id, votes FROM titles WHERE year BETWEEN 2000 AND 2009
  ORDER BY votes DESC NULLS LAST, item_id LIMIT 50""")
def filters_only(spark: SparkSession, folder: str) -> DataFrame:
    """Retrieval by filters alone, most voted first."""
    return titles(spark, folder).filter(F.col("year").between(2000, 2009)).orderBy(_desc("votes"), "item_id").limit(50).select("item_id", "votes")


@query("op_f08_name_lookup", """WITH names AS (SELECT c_custkey AS id, c_name AS name FROM customer), p AS (
  SELECT id, name FROM names WHERE starts_with(lower(name), 'customer#00000001') ORDER BY name, id LIMIT 20), s AS (
  SELECT id, name FROM names WHERE contains(lower(name), 'customer#00000001') AND NOT EXISTS (SELECT 1 FROM p) ORDER BY name, id LIMIT 20)
  SELECT * FROM p UNION ALL SELECT * FROM s""")
def name_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """Names that begin with a word; names that contain it only if none begins with it."""
    names = table(spark, folder, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    wanted, low = F.lit("customer#00000001"), F.lower("name")
    begins = names.filter(F.startswith(low, wanted)).orderBy("name", "id").limit(20)
    holds = names.filter(F.contains(low, wanted)).orderBy("name", "id").limit(20)
    none = begins.limit(1).agg(F.count(F.lit(1)).alias("n")).filter("n = 0")
    return begins.unionByName(holds.join(F.broadcast(none), how="cross").drop("n"))  # one row at most


@query("op_f09_kids", TITLES_SQL + """SELECT item_id, genres FROM titles WHERE list_has_any(string_split(genres, ','), ['Children', 'Family'])
  AND NOT list_has_any(string_split(genres, ','), ['Adult', 'Horror', 'Thriller', 'Crime', 'War', 'Film-Noir'])""")
def kids(spark: SparkSession, folder: str) -> DataFrame:
    """Suitable for children: a family genre and none of the excluded ones."""
    own = F.split("genres", ",")
    any_of = lambda *g: F.arrays_overlap(own, F.array(*map(F.lit, g)))
    return titles(spark, folder).filter(any_of("Children", "Family") & ~any_of("Adult", "Horror", "Thriller", "Crime", "War", "Film-Noir")).select("item_id", "genres")


@query("op_f10_indexable", "SELECT doc_id, length(trim(text)) AS chars FROM documents WHERE length(trim(text)) >= 300")
def indexable(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", F.length(F.trim("text")).cast("bigint").alias("chars")).filter("chars >= 300")


@query("op_f12_vote_histogram", TITLES_SQL + """, e AS (SELECT CAST(list_max(list_filter([0, 10, 50, 100, 500, 1000, 5000, 10000, 50000, 100000], lambda x: votes >= x)) AS INT) AS edge
  FROM titles WHERE votes IS NOT NULL), c AS (SELECT edge, count(*) AS titles FROM e GROUP BY 1)
  SELECT edge, titles, CAST(sum(titles) OVER (ORDER BY edge DESC) AS BIGINT) AS at_least FROM c""")
def histogram(spark: SparkSession, folder: str) -> DataFrame:
    return R.vote_histogram(titles(spark, folder))


@query("op_f13_measure", TITLES_SQL + """SELECT kind, count(*) AS titles, count(*) FILTER (votes >= 10) AS core, count(*) FILTER (votes IS NULL) AS unrated,
  round(avg(length(title)), 6) AS mean_title FROM titles GROUP BY kind""")
def measure(spark: SparkSession, folder: str) -> DataFrame:
    """Counts per kind in one pass."""
    return titles(spark, folder).groupBy("kind").agg(
        F.count(F.lit(1)).alias("titles"), F.count(F.when(F.col("votes") >= 10, 1)).alias("core"), F.count(F.when(F.col("votes").isNull(), 1)).alias("unrated"),
        F.round(F.avg(F.length("title")), 6).alias("mean_title"),
    )


@query("op_s04_genre_list", TITLES_SQL + "SELECT g AS genre, count(*) AS titles FROM titles, unnest(string_split(genres, ',')) AS x(g) WHERE g <> '' GROUP BY g")
def genre_list(spark: SparkSession, folder: str) -> DataFrame:
    """Comma lists split, empties dropped."""
    own = F.filter(F.split("genres", ","), lambda g: g != "")
    return titles(spark, folder).select(F.explode(own).alias("genre")).groupBy("genre").agg(F.count(F.lit(1)).alias("titles"))


@query("op_s03_seek", TITLES_SQL + "SELECT imdb_id, item_id FROM titles WHERE imdb_id > 'tt900150000' ORDER BY imdb_id LIMIT 100")
def seek(spark: SparkSession, folder: str) -> DataFrame:
    """Resume a sorted scan behind a cursor; the filter reaches the Parquet statistics."""
    return titles(spark, folder).filter(F.col("imdb_id") > "tt900150000").orderBy("imdb_id").limit(100).select("imdb_id", "item_id")


@query("op_j06_external_key", TITLES_SQL + """SELECT doc_id, item_id, try_cast(substr(d.imdb_id, 3) AS BIGINT) AS number
  FROM documents d JOIN titles t ON try_cast(substr(d.imdb_id, 3) AS BIGINT) = try_cast(substr(t.imdb_id, 3) AS BIGINT)""")
def external_key(spark: SparkSession, folder: str) -> DataFrame:
    """Join by the number in an external id; ids that hold none match nothing."""
    number = F.substring("imdb_id", 3, 20).try_cast("bigint").alias("number")
    docs = table(spark, folder, "documents").select("doc_id", number)
    return docs.join(titles(spark, folder).select("item_id", number), "number").select("doc_id", "item_id", "number")


@query("op_j02_core_semi", TITLES_SQL + "SELECT doc_id, source FROM documents SEMI JOIN (SELECT imdb_id FROM titles WHERE votes >= 10) USING (imdb_id)")
def core_semi(spark: SparkSession, folder: str) -> DataFrame:
    """Facts of core titles only."""
    core = titles(spark, folder).filter("votes >= 10").select("imdb_id")
    return table(spark, folder, "documents").select("doc_id", "source", "imdb_id").join(core, "imdb_id", "left_semi").select("doc_id", "source")


@query("op_j05_exact_title", """WITH n AS (SELECT DISTINCT item_id, title, votes FROM media_items
   UNION ALL SELECT item_id, unnest(alternative_titles) AS title, votes FROM media_items),
  w AS (SELECT DISTINCT lower(english_title) AS wanted FROM anime_entries WHERE english_title IS NOT NULL)
  SELECT wanted, item_id, max(votes) AS votes FROM w JOIN n ON lower(n.title) = wanted GROUP BY 1, 2""")
def exact_title(spark: SparkSession, folder: str) -> DataFrame:
    """Titles by any of their names, each once."""
    items = table(spark, folder, "media_items")
    names = items.select("item_id", "votes", F.explode(F.concat(F.array("title"), F.coalesce("alternative_titles", F.array().cast("array<string>")))).alias("name"))
    wanted = table(spark, folder, "anime_entries").select(F.lower("english_title").alias("wanted")).dropna().distinct()
    return wanted.join(names, F.lower("name") == F.col("wanted")).groupBy("wanted", "item_id").agg(F.max("votes").alias("votes"))


@query("op_j11_next_previous", """WITH e AS (SELECT DISTINCT mirror_id, parent_imdb_id, imdb_id FROM title_snapshots WHERE title_type = 'tvEpisode' AND parent_imdb_id IS NOT NULL)
  SELECT mirror_id, imdb_id, lag(imdb_id) OVER w AS previous, lead(imdb_id) OVER w AS following FROM e WINDOW w AS (PARTITION BY mirror_id, parent_imdb_id ORDER BY imdb_id)""")
def next_previous(spark: SparkSession, folder: str) -> DataFrame:
    """The neighbours of every episode within its series."""
    dumps = table(spark, folder, "title_snapshots").filter((F.col("title_type") == "tvEpisode") & F.col("parent_imdb_id").isNotNull())
    order = Window.partitionBy("mirror_id", "parent_imdb_id").orderBy("imdb_id")
    episodes = dumps.select("mirror_id", "parent_imdb_id", "imdb_id").distinct()
    return episodes.select("mirror_id", "imdb_id", F.lag("imdb_id").over(order).alias("previous"), F.lead("imdb_id").over(order).alias("following"))


@query("op_j13_roll_up", """SELECT coalesce(parent_imdb_id, imdb_id) AS card, count(DISTINCT imdb_id) AS members, max(loaded_at) AS last_loaded
  FROM title_snapshots GROUP BY 1""")
def roll_up(spark: SparkSession, folder: str) -> DataFrame:
    """Episodes under their series, other titles under themselves."""
    card = F.coalesce("parent_imdb_id", "imdb_id").alias("card")
    return table(spark, folder, "title_snapshots").groupBy(card).agg(F.countDistinct("imdb_id").alias("members"), F.max("loaded_at").alias("last_loaded"))


@query("op_a01_season_counts", """SELECT parent_imdb_id, year, count(DISTINCT imdb_id) AS episodes FROM title_snapshots WHERE title_type = 'tvEpisode' GROUP BY 1, 2""")
def season_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Episodes per series and year, unknown years as a group of their own."""
    own = table(spark, folder, "title_snapshots").filter("title_type = 'tvEpisode'")
    return own.groupBy("parent_imdb_id", "year").agg(F.countDistinct("imdb_id").alias("episodes"))


@query("op_a04_recently_added", TITLES_SQL + "SELECT item_id, updated_at FROM titles ORDER BY updated_at DESC, item_id LIMIT 40")
def recently_added(spark: SparkSession, folder: str) -> DataFrame:
    return titles(spark, folder).orderBy(F.col("updated_at").desc(), "item_id").limit(40).select("item_id", "updated_at")


@query("op_a08_weighted_shares", TITLES_SQL + """, g AS (SELECT g AS genre, sum(greatest(votes, 0))::DOUBLE AS w FROM titles, unnest(string_split(genres, ',')) AS x(g) GROUP BY g)
  SELECT genre, round(w / sum(w) OVER (), 6) AS share FROM g QUALIFY w / sum(w) OVER () >= 0.01""")
def weighted_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Shares of a total weight, small ones dropped."""
    one = titles(spark, folder).select(F.explode(F.split("genres", ",")).alias("genre"), F.greatest("votes", F.lit(0)).alias("w"))
    sums = one.groupBy("genre").agg(F.sum("w").cast("double").alias("w"))
    share = F.col("w") / F.sum("w").over(Window.partitionBy())  # one row per genre
    return sums.select("genre", share.alias("share")).filter("share >= 0.01").select("genre", F.round("share", 6).alias("share"))


@query("op_t02_by_decade", TITLES_SQL + """SELECT decade, item_id, votes, rank FROM (SELECT CAST(floor(year / 10) * 10 AS INT) AS decade, item_id, votes,
  CAST(row_number() OVER (PARTITION BY floor(year / 10) ORDER BY votes DESC NULLS LAST, item_id) AS INT) AS rank FROM titles WHERE year IS NOT NULL) WHERE rank <= 10""")
def by_decade(spark: SparkSession, folder: str) -> DataFrame:
    """The most voted of every decade."""
    dated = titles(spark, folder).filter("year is not null").withColumn("decade", (F.floor(F.col("year") / 10) * 10).cast("int"))
    return R.top_per_key(dated, ["decade"], [_desc("votes"), F.col("item_id")], 10).select("decade", "item_id", "votes", "rank")


@query("op_t03_new_releases", TITLES_SQL + "SELECT item_id, year, votes FROM titles WHERE year >= 2023 AND votes >= 20 ORDER BY votes DESC, item_id LIMIT 50")
def new_releases(spark: SparkSession, folder: str) -> DataFrame:
    return titles(spark, folder).filter("year >= 2023 and votes >= 20").orderBy(_desc("votes"), "item_id").limit(50).select("item_id", "year", "votes")


@query("op_t04_acclaimed", TITLES_SQL + "SELECT item_id, rating, votes FROM titles WHERE rating >= 75 AND votes >= 50 ORDER BY rating DESC, votes DESC, item_id LIMIT 50")
def acclaimed(spark: SparkSession, folder: str) -> DataFrame:
    return titles(spark, folder).filter("rating >= 75 and votes >= 50").orderBy(_desc("rating"), _desc("votes"), "item_id").limit(50).select("item_id", "rating", "votes")


_LAST_TWO = """WITH one AS (SELECT mirror_id, snapshot_no, imdb_id, max(votes) AS votes FROM title_snapshots GROUP BY 1, 2, 3),
  n AS (SELECT mirror_id, snapshot_no, row_number() OVER (PARTITION BY mirror_id ORDER BY snapshot_no DESC) AS back FROM (SELECT DISTINCT mirror_id, snapshot_no FROM one))
"""


@query("op_t05_rising", _LAST_TWO + """SELECT mirror_id, imdb_id, gained, rank FROM (SELECT a.mirror_id, a.imdb_id, a.votes - b.votes AS gained,
  CAST(row_number() OVER (PARTITION BY a.mirror_id ORDER BY a.votes - b.votes DESC, a.imdb_id) AS INT) AS rank
  FROM one a JOIN n x ON x.mirror_id = a.mirror_id AND x.snapshot_no = a.snapshot_no AND x.back = 1
  JOIN n y ON y.mirror_id = a.mirror_id AND y.back = 2 JOIN one b ON b.mirror_id = a.mirror_id AND b.snapshot_no = y.snapshot_no AND b.imdb_id = a.imdb_id
  WHERE a.votes >= 10 AND a.votes > b.votes) WHERE rank <= 20""")
def rising(spark: SparkSession, folder: str) -> DataFrame:
    """Votes gained from the last dump but one to the last."""
    dumps = table(spark, folder, "title_snapshots").groupBy("mirror_id", "snapshot_no", "imdb_id").agg(F.max("votes").alias("votes"))
    last = dumps.select("mirror_id", "snapshot_no").distinct().withColumn("back", F.row_number().over(Window.partitionBy("mirror_id").orderBy(F.col("snapshot_no").desc())))
    two = dumps.join(last.filter("back <= 2"), ["mirror_id", "snapshot_no"]).groupBy("mirror_id", "imdb_id").agg(
        F.max(F.when(F.col("back") == 1, F.col("votes"))).alias("now"), F.max(F.when(F.col("back") == 2, F.col("votes"))).alias("then")
    )
    gained = two.filter("now >= 10 and now > then").select("mirror_id", "imdb_id", (F.col("now") - F.col("then")).alias("gained"))
    return R.top_per_key(gained, ["mirror_id"], [_desc("gained"), F.col("imdb_id")], 20)


@query("op_t07_filmography", """WITH p AS (SELECT p_partkey, p_brand, p_type, p_retailprice FROM part) SELECT p_brand, p_partkey, p_type, rank FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC NULLS LAST, p_partkey) AS INT) AS rank FROM p) WHERE rank <= 5""")
def filmography(spark: SparkSession, folder: str) -> DataFrame:
    """A maker's first works in order."""
    works = table(spark, folder, "part").select("p_partkey", "p_brand", "p_type", "p_retailprice")
    return R.top_per_key(works, ["p_brand"], [_desc("p_retailprice"), F.col("p_partkey")], 5).select("p_brand", "p_partkey", "p_type", "rank")


@query("op_t12_title_order", TITLES_SQL + "SELECT item_id, title FROM titles ORDER BY lower(title), item_id LIMIT 100")
def title_order(spark: SparkSession, folder: str) -> DataFrame:
    return titles(spark, folder).orderBy(F.lower("title"), "item_id").limit(100).select("item_id", "title")


@query("op_u03_ordered_union", TITLES_SQL + """, a AS (SELECT item_id AS id, 0 AS list, CAST(row_number() OVER (ORDER BY votes DESC NULLS LAST, item_id) AS INT) AS pos FROM titles QUALIFY pos <= 100),
  b AS (SELECT item_id AS id, 1 AS list, CAST(row_number() OVER (ORDER BY rating DESC NULLS LAST, item_id) AS INT) AS pos FROM titles QUALIFY pos <= 100)
  SELECT id, list, pos FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY list, pos) AS n FROM (FROM a UNION ALL FROM b)) WHERE n = 1 ORDER BY list, pos LIMIT 100""")
def ordered_union(spark: SparkSession, folder: str) -> DataFrame:
    """Ordered lists after one another, each title where it is seen first."""
    own = titles(spark, folder)
    return R.first_seen_union([(own, "item_id", [_desc("votes"), F.col("item_id")]), (own, "item_id", [_desc("rating"), F.col("item_id")])], 100)


@query("op_u05_dedupe_min", """SELECT title, kind, min(item_id) AS item_id, count(*) AS copies FROM media_items GROUP BY 1, 2""")
def dedupe_min(spark: SparkSession, folder: str) -> DataFrame:
    """The lowest id of every name and kind."""
    return table(spark, folder, "media_items").groupBy("title", "kind").agg(F.min("item_id").alias("item_id"), F.count(F.lit(1)).alias("copies"))


@query("op_w08_round_robin", TITLES_SQL + """, l AS (SELECT kind, item_id, CAST(row_number() OVER (PARTITION BY kind ORDER BY votes DESC NULLS LAST, item_id) AS INT) AS pos FROM titles QUALIFY pos <= 20)
  SELECT item_id, kind, pos, CAST(row_number() OVER (ORDER BY pos, kind) AS INT) AS place FROM l""")
def round_robin(spark: SparkSession, folder: str) -> DataFrame:
    """The best of each kind in turn."""
    order = [_desc("votes"), F.col("item_id")]
    return R.interleave(R.top_per_key(titles(spark, folder), ["kind"], order, 20), "kind", order, "item_id")


@query("op_w10_spread", TITLES_SQL + """SELECT kind, item_id, year FROM (SELECT kind, item_id, year, row_number() OVER (PARTITION BY kind ORDER BY item_id) AS n FROM titles) WHERE n % 100 = 1""")
def spread(spark: SparkSession, folder: str) -> DataFrame:
    """Every hundredth row of a sorted list: a sampling operator."""
    n = F.row_number().over(Window.partitionBy("kind").orderBy("item_id"))
    return titles(spark, folder).withColumn("n", n).filter("n % 100 = 1").select("kind", "item_id", "year")


@query("op_a17_lower_median", TITLES_SQL + """SELECT kind, list_sort(list(runtime_minutes))[CAST((count(runtime_minutes) + 1) // 2 AS INT)] AS median
  FROM titles WHERE runtime_minutes IS NOT NULL GROUP BY kind""")
def median(spark: SparkSession, folder: str) -> DataFrame:
    """Lower middle per kind; ranks are found by window, so no group is collected."""
    timed = titles(spark, folder).filter("runtime_minutes is not null").groupBy("kind", "runtime_minutes").agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(Window.partitionBy("kind").orderBy("runtime_minutes"))
    total = F.sum("n").over(Window.partitionBy("kind"))
    reached = timed.withColumn("upto", upto).withColumn("total", total).filter("upto >= (total + 1) div 2")
    return reached.groupBy("kind").agg(F.min("runtime_minutes").alias("median"))


@query("op_a05_conditional_distinct", """SELECT lang, count(DISTINCT imdb_id) FILTER (source = 'synopsis') AS with_synopsis,
  count(DISTINCT imdb_id) FILTER (source = 'user_review') AS with_review FROM documents GROUP BY lang""")
def conditional_distinct(spark: SparkSession, folder: str) -> DataFrame:
    pick = lambda s: F.countDistinct(F.when(F.col("source") == s, F.col("imdb_id")))
    return table(spark, folder, "documents").groupBy("lang").agg(pick("synopsis").alias("with_synopsis"), pick("user_review").alias("with_review"))


@query("op_a19_ordered_concat", """SELECT imdb_id, string_agg(source, '|' ORDER BY source) AS sources FROM (SELECT DISTINCT imdb_id, source FROM documents WHERE imdb_id IS NOT NULL AND source IS NOT NULL) GROUP BY 1""")
def ordered_concat(spark: SparkSession, folder: str) -> DataFrame:
    """Joined text in a fixed order."""
    own = table(spark, folder, "documents").select("imdb_id", "source").dropna().distinct()
    return own.groupBy("imdb_id").agg(F.array_join(F.sort_array(F.collect_list("source")), "|").alias("sources"))


@query("op_j21_existing", TITLES_SQL + """SELECT a.anilist_id, t.item_id FROM (SELECT DISTINCT anilist_id, title, year FROM anime_entries) a JOIN titles t
  ON lower(a.title) = lower(t.title) AND (a.year = t.year OR a.year IS NULL OR t.year IS NULL)""")
def existing(spark: SparkSession, folder: str) -> DataFrame:
    """Same name, and the same year as far as both are known."""
    entries = table(spark, folder, "anime_entries").select("anilist_id", F.lower("title").alias("name"), F.col("year").alias("y")).distinct()
    own = titles(spark, folder).select("item_id", F.lower("title").alias("name"), "year")
    return entries.join(own, "name").filter(F.coalesce(F.col("y") == F.col("year"), F.lit(True))).select("anilist_id", "item_id")


QUERIES, ORACLES = _r.queries, _r.oracles
