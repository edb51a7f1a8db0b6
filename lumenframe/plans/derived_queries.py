"""Derived facts: roles and variants, referential loads, identification, neighbours with exclusions, discovery arms, rails."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenframe.functions import text as T
from lumenframe.operators import vectors as V
from lumenframe.operators.relational import first_seen_union, top_per_key
from lumenframe.plans.base import EVENTS_SQL, TITLES_SQL, Registry, events, titles
from lumenframe.plans.taste_queries import neighbours
from lumenframe.plans.taste_queries import _EDGES as EDGES_SQL
from lumenframe.sources.readers import freshness
from lumenframe.tables import table

_r = Registry()
query = _r.query
_EV = "WITH " + EVENTS_SQL
_desc = lambda c: F.col(c).desc_nulls_last()
_E = "WITH e AS (SELECT DISTINCT vec_id, embedding::DOUBLE[] AS v, label FROM embeddings)\n"


@query("op_f04_roles", """SELECT CASE source WHEN 'user_review' THEN 'audience' WHEN 'forum_post' THEN 'audience' WHEN 'press_note' THEN 'press' WHEN 'festival_note' THEN 'press' WHEN 'article_extract' THEN 'press' END AS role, count(*) AS texts
  FROM documents GROUP BY 1 HAVING role IS NOT NULL""")
def roles(spark: SparkSession, folder: str) -> DataFrame:
    """Categories mapped to roles, unknown ones dropped."""
    known = {"user_review": "audience", "forum_post": "audience", "press_note": "press", "festival_note": "press", "article_extract": "press"}
    pairs = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    return table(spark, folder, "documents").select(F.try_element_at(pairs, "source").alias("role")).dropna().groupBy("role").agg(F.count(F.lit(1)).alias("texts"))


@query("op_f05_variants", r"""WITH n AS (SELECT DISTINCT item_id, unnest(alternative_titles) AS name FROM media_items), c AS (SELECT item_id, name, length(regexp_replace(name, '[^\p{L}]', '', 'g')) AS letters, length(regexp_replace(name, '[^\x{250}-\x{10FFFF}]|[^\p{L}]', '', 'g')) AS far FROM n WHERE name IS NOT NULL)
  SELECT item_id, name, CASE WHEN far * 2 > letters THEN 'native' ELSE 'alternative' END AS variant FROM c""")
def variants(spark: SparkSession, folder: str) -> DataFrame:
    """Names whose letters mostly lie beyond the Latin blocks are native ones."""
    names = table(spark, folder, "media_items").select("item_id", F.explode("alternative_titles").alias("name")).distinct().filter("name is not null")
    letters, far = (F.length(F.regexp_replace("name", p, "")) for p in (r"[^\p{L}]", r"[^\x{250}-\x{10FFFF}]|[^\p{L}]"))
    return names.select("item_id", "name", F.when(far * 2 > letters, "native").otherwise("alternative").alias("variant"))


@query("op_j01_left_facts", TITLES_SQL + """, d AS (SELECT imdb_id, count(*) AS texts, max(n_chars) AS longest FROM documents GROUP BY 1) SELECT item_id, texts, longest FROM titles LEFT JOIN d USING (imdb_id)""")
def left_facts(spark: SparkSession, folder: str) -> DataFrame:
    """Facts laid onto titles; a title without any keeps nulls."""
    d = table(spark, folder, "documents").groupBy("imdb_id").agg(F.count(F.lit(1)).alias("texts"), F.max("n_chars").alias("longest"))
    return titles(spark, folder).select("item_id", "imdb_id").join(d, "imdb_id", "left").select("item_id", "texts", "longest")


@query("op_j03_referential", """WITH need AS (SELECT DISTINCT l_suppkey FROM lineitem WHERE l_returnflag = 'R'), dim AS (SELECT s_suppkey, s_name FROM supplier SEMI JOIN need ON s_suppkey = l_suppkey WHERE s_acctbal > 0)
  SELECT l_suppkey, s_name, count(*) AS facts FROM lineitem JOIN dim ON s_suppkey = l_suppkey WHERE l_returnflag = 'R' GROUP BY 1, 2""")
def referential(spark: SparkSession, folder: str) -> DataFrame:
    """Only the dimension rows that facts need, then only facts whose dimension row is kept."""
    facts = table(spark, folder, "lineitem").filter("l_returnflag = 'R'").select("l_suppkey")
    dim = table(spark, folder, "supplier").filter("s_acctbal > 0").select(F.col("s_suppkey").alias("l_suppkey"), "s_name").join(facts.distinct(), "l_suppkey", "left_semi")
    return facts.join(dim, "l_suppkey").groupBy("l_suppkey", "s_name").agg(F.count(F.lit(1)).alias("facts"))


@query("op_j12_numbering", TITLES_SQL + """SELECT a.anilist_id, coalesce(s.item_id, c.item_id) AS item_id, CASE WHEN s.item_id IS NOT NULL THEN 'specific' WHEN c.item_id IS NOT NULL THEN 'canonical' END AS way FROM (SELECT DISTINCT anilist_id, lower(title) AS t, lower(english_title) AS e FROM anime_entries) a
  LEFT JOIN (SELECT lower(title) AS n, min(item_id) AS item_id FROM titles GROUP BY 1) s ON s.n = a.e LEFT JOIN (SELECT lower(title) AS n, min(item_id) AS item_id FROM titles GROUP BY 1) c ON c.n = a.t""")
def numbering(spark: SparkSession, folder: str) -> DataFrame:
    """A specific key first, then the canonical one."""
    entries = table(spark, folder, "anime_entries").select("anilist_id", F.lower("title").alias("t"), F.lower("english_title").alias("e")).distinct()
    first = titles(spark, folder).groupBy(F.lower("title").alias("n")).agg(F.min("item_id").alias("i"))
    both = entries.join(first.select(F.col("n").alias("e"), F.col("i").alias("s")), "e", "left").join(first.select(F.col("n").alias("t"), F.col("i").alias("c")), "t", "left")
    return both.select("anilist_id", F.coalesce("s", "c").alias("item_id"), F.when(F.col("s").isNotNull(), "specific").when(F.col("c").isNotNull(), "canonical").alias("way"))


@query("op_j24_regions_due", """WITH touched AS (SELECT item_id FROM recommendations UNION SELECT e.x.item_id FROM recommendations, unnest(loved_with) AS e(x)) SELECT item_id FROM touched ANTI JOIN (SELECT item_id FROM media_items WHERE genres IS NOT NULL) USING (item_id) WHERE item_id IS NOT NULL""")
def regions_due(spark: SparkSession, folder: str) -> DataFrame:
    """Touched titles whose facts are still to be asked for."""
    shown = table(spark, folder, "recommendations")
    touched = shown.select("item_id").union(shown.select(F.explode("loved_with.item_id"))).filter("item_id is not null").distinct()
    return touched.join(table(spark, folder, "media_items").filter("genres is not null").select("item_id"), "item_id", "left_anti")


@query("op_a21_readiness", _EV + """, l AS (SELECT user_id, max(ts) AS last, arg_max(event_type, struct_pack(ts, event_id)) AS state FROM ev GROUP BY 1), n AS (SELECT max(ts) AS now FROM ev)
  SELECT user_id, state, CASE WHEN state = 'error' THEN 'failed' WHEN last >= now - INTERVAL 1 DAY THEN 'running' ELSE 'idle' END AS readiness FROM l, n""")
def readiness(spark: SparkSession, folder: str) -> DataFrame:
    """The latest job of each owner, and whether it has gone quiet."""
    own = events(spark, folder)
    last = own.groupBy("user_id").agg(F.max("ts").alias("last"), F.max_by("event_type", F.struct("ts", "event_id")).alias("state"))
    both = last.join(F.broadcast(own.agg(F.max("ts").alias("now"))))  # one row
    kind = F.when(F.col("state") == "error", "failed").when(F.col("last") >= F.col("now") - F.expr("interval 1 day"), "running").otherwise("idle")
    return both.select("user_id", "state", kind.alias("readiness"))


@query("op_t10_cleanup", """SELECT doc_id, n_chars FROM documents WHERE text IS NOT NULL ORDER BY (lang IS NULL) DESC, n_chars DESC NULLS LAST, fetched_at NULLS LAST, doc_id LIMIT 100""")
def cleanup(spark: SparkSession, folder: str) -> DataFrame:
    """What to remove first: unlabelled, larger, older."""
    own = table(spark, folder, "documents").filter("text is not null")
    return own.orderBy(F.col("lang").isNull().desc(), _desc("n_chars"), F.col("fetched_at").asc_nulls_last(), "doc_id").limit(100).select("doc_id", "n_chars")


@query("op_k15_import_form", """SELECT DISTINCT item_id, regexp_replace(trim(regexp_replace(replace(replace(lower(title), '-', ' '), '&', 'and'), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'), ' '), '^the ', '') AS form FROM media_items""")
def import_form(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "media_items").select("item_id", T.import_form(F.col("title")).alias("form")).distinct()


@query("op_k10_cards", TITLES_SQL + """, d AS (SELECT imdb_id, min(doc_id) AS doc_id FROM documents WHERE source = 'synopsis' AND text <> '' GROUP BY 1)
  SELECT item_id, title, coalesce(runtime_minutes // 60 || ' h ' || runtime_minutes % 60 || ' min', '') AS runtime, doc_id FROM titles LEFT JOIN d USING (imdb_id)""")
def cards(spark: SparkSession, folder: str) -> DataFrame:
    """What a result card shows: name, running time and the synopsis to quote."""
    d = table(spark, folder, "documents").filter("source = 'synopsis' and text <> ''").groupBy("imdb_id").agg(F.min("doc_id").alias("doc_id"))
    m = F.col("runtime_minutes")
    runtime = F.coalesce(F.concat(F.expr("runtime_minutes div 60").cast("string"), F.lit(" h "), (m % 60).cast("string"), F.lit(" min")), F.lit(""))
    return titles(spark, folder).join(d, "imdb_id", "left").select("item_id", "title", runtime.alias("runtime"), "doc_id")


@query("op_x12_day_numbers", """SELECT o_orderkey, CAST(date_diff('day', DATE '1970-01-01', o_orderdate::DATE) AS INT) AS day, CAST(year(o_orderdate) // 10 * 10 AS INT) AS decade FROM orders""")
def day_numbers(spark: SparkSession, folder: str) -> DataFrame:
    """Day numbers and decades."""
    return table(spark, folder, "orders").select("o_orderkey", F.datediff(F.to_date("o_orderdate"), F.to_date(F.lit("1970-01-01"))).alias("day"), F.expr("cast(year(o_orderdate) div 10 * 10 as int)").alias("decade"))


@query("op_x20_contexts", _EV + """SELECT user_id, CASE WHEN hour(ts) BETWEEN 5 AND 16 THEN 'day' WHEN hour(ts) BETWEEN 17 AND 22 THEN 'evening' ELSE 'late' END AS context, count(*) AS events FROM ev GROUP BY 1, 2""")
def contexts(spark: SparkSession, folder: str) -> DataFrame:
    hour = F.hour("ts")
    context = F.when(hour.between(5, 16), "day").when(hour.between(17, 22), "evening").otherwise("late")
    return events(spark, folder).groupBy("user_id", context.alias("context")).agg(F.count(F.lit(1)).alias("events"))


@query("op_s20_freshness", """WITH a AS (SELECT doc_id, source, date_diff('second', fetched_at, (SELECT max(fetched_at) FROM documents)) AS age FROM documents WHERE fetched_at IS NOT NULL),
  k AS (SELECT *, CASE source WHEN 'trivia' THEN 86400 WHEN 'synopsis' THEN 2592000 ELSE 604800 END AS ttl FROM a) SELECT doc_id, CASE WHEN age <= ttl THEN 'fresh' WHEN age <= 31536000 THEN 'stale' ELSE 'expired' END AS state FROM k""")
def fresh(spark: SparkSession, folder: str) -> DataFrame:
    """Freshness of stored texts by the class of their source."""
    own = table(spark, folder, "documents").select("doc_id", "source", "fetched_at").filter("fetched_at is not null")
    now = own.agg(F.max("fetched_at").alias("now"))
    age = F.unix_seconds(F.col("now").cast("timestamp")) - F.unix_seconds(F.col("fetched_at").cast("timestamp"))
    kind = F.when(F.col("source") == "trivia", "search").when(F.col("source") == "synopsis", "detail").otherwise("ratings")
    return own.join(F.broadcast(now)).select("doc_id", freshness(age, kind).alias("state"))


@query("op_v05_nearest_excluding", _E + """, s AS (SELECT q.vec_id AS query, b.vec_id AS id, round(list_cosine_similarity(q.v, b.v), 6) AS similarity FROM e q JOIN e b ON b.vec_id <> q.vec_id AND (b.vec_id + q.vec_id) % 50 <> 0 WHERE q.vec_id % 20 = 0)
  SELECT query, id, similarity, CAST(row_number() OVER (PARTITION BY query ORDER BY similarity DESC, id) AS INT) AS rank FROM s QUALIFY rank <= 10""")
def nearest_excluding(spark: SparkSession, folder: str) -> DataFrame:
    """Neighbours of every twentieth vector without those it has met: a fiftieth of all, another for every seed."""
    own = table(spark, folder, "embeddings").dropDuplicates(["vec_id"])
    asked = own.filter("vec_id % 20 = 0")
    fiftieth = F.pmod(-F.col("vec_id"), F.lit(50))
    met = asked.select(F.col("vec_id").alias("query"), fiftieth.alias("r")).join(own.select(F.col("vec_id").alias("id"), F.pmod("vec_id", F.lit(50)).alias("r")), "r").drop("r")
    return V.nearest_excluding(own, asked, "vec_id", "embedding", met, 10)


@query("op_v11_agreement", """SELECT count(*) AS vectors, count(DISTINCT vec_id) AS ids, sum(vec_id)::BIGINT AS checksum, sum(CASE WHEN len(embedding) = 64 THEN 1 ELSE 0 END)::BIGINT AS whole FROM embeddings""")
def agreement(spark: SparkSession, folder: str) -> DataFrame:
    """Whether an artefact still agrees with its catalogue."""
    return table(spark, folder, "embeddings").agg(F.count(F.lit(1)).alias("vectors"), F.countDistinct("vec_id").alias("ids"), F.sum("vec_id").alias("checksum"), F.count(F.when(F.size("embedding") == 64, 1)).alias("whole"))


@query("op_r04_live_neighbours", EDGES_SQL + """, ty AS (SELECT rank, round(avg(score), 6) AS typical FROM edge WHERE rank <= 20 GROUP BY rank), live AS (SELECT item, neighbour, CAST(row_number() OVER (PARTITION BY item ORDER BY neighbour) AS INT) AS pos FROM edge)
  SELECT item, neighbour, round(coalesce(typical, 0.29 / pow(1 + pos, 0.25::DOUBLE)), 6) AS score FROM live LEFT JOIN ty ON rank = pos""")
def live_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """Neighbours that come without scores take the typical one at their rank."""
    edges = neighbours(spark, folder)
    typical = edges.filter("rank <= 20").groupBy(F.col("rank").alias("pos")).agg(F.round(F.avg("score"), 6).alias("typical"))
    live = edges.select("item", "neighbour", F.row_number().over(Window.partitionBy("item").orderBy("neighbour")).alias("pos"))
    return live.join(typical, "pos", "left").select("item", "neighbour", F.round(F.coalesce("typical", 0.29 / F.pow(1 + F.col("pos"), F.lit(0.25))), 6).alias("score"))


@query("op_r17_arm_plan", TITLES_SQL + """, a AS (SELECT item_id, 'canon' AS arm, 1 AS n FROM (SELECT item_id FROM titles WHERE rating >= 75 ORDER BY votes DESC NULLS LAST, item_id LIMIT 20)), b AS (SELECT item_id, 'new' AS arm, 2 AS n FROM (SELECT item_id FROM titles ANTI JOIN a USING (item_id) ORDER BY year DESC NULLS LAST, votes DESC NULLS LAST, item_id LIMIT 20)),
  c AS (SELECT item_id, 'popular' AS arm, 3 AS n FROM (SELECT item_id FROM titles ANTI JOIN a USING (item_id) ANTI JOIN b USING (item_id) ORDER BY votes DESC NULLS LAST, item_id LIMIT 20)) FROM a UNION ALL FROM b UNION ALL FROM c""")
def arm_plan(spark: SparkSession, folder: str) -> DataFrame:
    """Arms in turn, each without what earlier ones took."""
    own = titles(spark, folder).select("item_id", "rating", "year", "votes")
    plan = [("canon", own.filter("rating >= 75"), [_desc("votes")]), ("new", own, [_desc("year"), _desc("votes")]), ("popular", own, [_desc("votes")])]
    taken = None
    for n, (arm, pool, order) in enumerate(plan, 1):
        left = pool if taken is None else pool.join(taken.select("item_id"), "item_id", "left_anti")
        chosen = left.orderBy(*order, "item_id").limit(20).select("item_id", F.lit(arm).alias("arm"), F.lit(n).alias("n"))
        taken = chosen if taken is None else taken.unionByName(chosen)
    return taken


@query("op_r23_mood_shelf", TITLES_SQL + """SELECT item_id, round(CASE WHEN list_contains(string_split(genres, ','), 'Comedy') THEN 1 ELSE 0 END + 0.25 * coalesce(rating, 0) / 100 + 0.4 * ln(1 + votes) / 15, 6) AS score FROM titles
  WHERE kind = 'movie' AND votes >= 20 AND runtime_minutes <= 120 ORDER BY score DESC, item_id LIMIT 40""")
def mood_shelf(spark: SparkSession, folder: str) -> DataFrame:
    """Films for a mood: fitting genre, some taste, a prior of votes, within a length; an unknown length fails."""
    fits = F.when(F.array_contains(F.split("genres", ","), "Comedy"), 1).otherwise(0)
    score = fits + 0.25 * F.coalesce("rating", F.lit(0)) / 100 + 0.4 * F.log(1 + F.col("votes")) / 15
    own = titles(spark, folder).filter("kind = 'movie' and votes >= 20 and runtime_minutes <= 120").select("item_id", F.round(score, 6).alias("score"))
    return own.orderBy(F.col("score").desc(), "item_id").limit(40)


@query("op_r25_home", TITLES_SQL + """, a AS (SELECT item_id AS id, 0 AS list, CAST(row_number() OVER (ORDER BY year DESC NULLS LAST, votes DESC NULLS LAST, item_id) AS INT) AS pos FROM titles QUALIFY pos <= 60), b AS (SELECT item_id AS id, 1 AS list, CAST(row_number() OVER (ORDER BY votes DESC NULLS LAST, item_id) AS INT) AS pos FROM titles QUALIFY pos <= 60),
  c AS (SELECT item_id AS id, 2 AS list, CAST(row_number() OVER (ORDER BY rating DESC NULLS LAST, votes DESC NULLS LAST, item_id) AS INT) AS pos FROM titles QUALIFY pos <= 60)
  SELECT id, list, pos FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY list, pos) AS n FROM (FROM a UNION ALL FROM b UNION ALL FROM c)) WHERE n = 1 ORDER BY list, pos LIMIT 60""")
def home(spark: SparkSession, folder: str) -> DataFrame:
    """Rails in order, each title on the first that holds it."""
    own = titles(spark, folder)
    key = F.col("item_id")
    return first_seen_union([(own, "item_id", [_desc("year"), _desc("votes"), key]), (own, "item_id", [_desc("votes"), key]), (own, "item_id", [_desc("rating"), _desc("votes"), key])], 60)


@query("op_e01_identify", """WITH p AS (SELECT DISTINCT a.anilist_id, m.item_id, CASE WHEN a.year IS NULL OR m.year IS NULL THEN 0.5 WHEN a.year = m.year THEN 1.0 WHEN abs(a.year - m.year) = 1 THEN 0.6 ELSE 0.0 END::DOUBLE AS y,
    CASE WHEN a.minutes IS NULL OR m.runtime_minutes IS NULL THEN 0.5 ELSE greatest(0, 1 - abs(a.minutes - m.runtime_minutes)::DOUBLE / m.runtime_minutes) END AS r, least(log10(coalesce(m.votes, 0) + 1) / 6, 1) AS v, CASE WHEN (a.format = 'MOVIE') = (m.kind = 'movie') THEN 1.0 ELSE 0.0 END::DOUBLE AS k
    FROM anime_entries a JOIN media_items m ON lower(a.title) = lower(m.title)), s AS (SELECT anilist_id, item_id, round(0.40 + 0.22 * y + 0.18 * coalesce(k, 0.5) + 0.12 * r + 0.08 * v, 6) AS score FROM p)
  SELECT anilist_id, item_id, score, CAST(row_number() OVER (PARTITION BY anilist_id ORDER BY score DESC, item_id) AS INT) AS rank FROM s QUALIFY rank <= 6""")
def identify(spark: SparkSession, folder: str) -> DataFrame:
    """Candidates by name, scored by weighted signals, six at most."""
    a = table(spark, folder, "anime_entries").select("anilist_id", F.lower("title").alias("n"), F.col("year").alias("ay"), "minutes", "format")
    m = table(spark, folder, "media_items").select("item_id", F.lower("title").alias("n"), "year", "runtime_minutes", "votes", "kind")
    p = a.join(m, "n").drop("n").distinct()
    y = F.when(F.col("ay").isNull() | F.col("year").isNull(), 0.5).when(F.col("ay") == F.col("year"), 1.0).when(F.abs(F.col("ay") - F.col("year")) == 1, 0.6).otherwise(0.0)
    r = F.when(F.col("minutes").isNull() | F.col("runtime_minutes").isNull(), 0.5).otherwise(F.greatest(F.lit(0.0), 1 - F.abs(F.col("minutes") - F.col("runtime_minutes")) / F.col("runtime_minutes")))
    k = F.when((F.col("format") == "MOVIE") == (F.col("kind") == "movie"), 1.0).otherwise(0.0)
    v = F.least(F.log10(F.coalesce("votes", F.lit(0)) + 1) / 6, F.lit(1.0))
    scored = p.select("anilist_id", "item_id", F.round(0.40 + 0.22 * y + 0.18 * k + 0.12 * r + 0.08 * v, 6).alias("score")).distinct()
    return top_per_key(scored, ["anilist_id"], [F.col("score").desc(), F.col("item_id")], 6)


@query("op_e02_remembered", """WITH p AS (SELECT DISTINCT anilist_id, lower(title) || '|' || coalesce(year::VARCHAR, '') || '|' || coalesce(format, '') AS pattern FROM anime_entries), d AS (SELECT pattern, min(anilist_id) AS decided FROM p GROUP BY 1)
  SELECT p.anilist_id, d.decided, p.anilist_id <> d.decided AS remembered FROM p JOIN d USING (pattern)""")
def remembered(spark: SparkSession, folder: str) -> DataFrame:
    """Entries of one pattern share the first one's decision."""
    pattern = F.concat_ws("|", F.lower("title"), F.coalesce(F.col("year").cast("string"), F.lit("")), F.coalesce("format", F.lit("")))
    p = table(spark, folder, "anime_entries").select("anilist_id", pattern.alias("pattern")).distinct()
    d = p.groupBy("pattern").agg(F.min("anilist_id").alias("decided"))
    return p.join(d, "pattern").select("anilist_id", "decided", (F.col("anilist_id") != F.col("decided")).alias("remembered"))


@query("op_q08_fallbacks", """WITH r AS (SELECT imdb_id, doc_id, n_chars, row_number() OVER (PARTITION BY imdb_id ORDER BY n_chars DESC NULLS LAST, doc_id) AS n FROM documents WHERE imdb_id IS NOT NULL) SELECT imdb_id, doc_id, CAST(n - 1 AS INT) AS fallback FROM r WHERE n BETWEEN 2 AND 4 AND n_chars > 0""")
def fallbacks(spark: SparkSession, folder: str) -> DataFrame:
    """The copies after the chosen one, without empty ones."""
    own = table(spark, folder, "documents").filter("imdb_id is not null").select("imdb_id", "doc_id", "n_chars")
    ranked = top_per_key(own, ["imdb_id"], [_desc("n_chars"), F.col("doc_id")], 4)
    return ranked.filter("rank >= 2 and n_chars > 0").select("imdb_id", "doc_id", (F.col("rank") - 1).alias("fallback"))


@query("op_st07_backoff", _EV + """, g AS (SELECT *, count(*) FILTER (event_type <> 'error') OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM ev),
  n AS (SELECT event_id, value, row_number() OVER (PARTITION BY user_id, run ORDER BY ts, event_id) - CASE WHEN run > 0 THEN 1 ELSE 0 END AS attempt, event_type FROM g)
  SELECT event_id, CAST(attempt AS INT) AS attempt, CASE WHEN CAST(floor(value) AS BIGINT) % 3 = 0 THEN 'give up' ELSE 'retry' END AS kind,
    CASE WHEN CAST(floor(value) AS BIGINT) % 3 <> 0 THEN round(least(60.0 * pow(2, attempt - 1), 3600.0) * (0.5 + (event_id % 1000) / 2000.0::DOUBLE), 6) END::DOUBLE AS seconds FROM n WHERE event_type = 'error'""")
def backoff(spark: SparkSession, folder: str) -> DataFrame:
    """How long each failure waits: doubled with every failure in a row up to an hour, spread by half; some kinds aren't tried
    again."""
    own = Window.partitionBy("user_id").orderBy("ts", "event_id")
    runs = events(spark, folder).withColumn("run", F.sum((F.col("event_type") != "error").cast("int")).over(own))
    n = F.row_number().over(Window.partitionBy("user_id", "run").orderBy("ts", "event_id")) - F.when(F.col("run") > 0, 1).otherwise(0)
    failed = runs.withColumn("attempt", n).filter("event_type = 'error'")
    again = F.floor("value") % 3 != 0
    wait = F.least(60.0 * F.pow(F.lit(2.0), F.col("attempt") - 1), F.lit(3600.0)) * (0.5 + (F.col("event_id") % 1000) / 2000)
    return failed.select("event_id", F.col("attempt").cast("int").alias("attempt"), F.when(again, "retry").otherwise("give up").alias("kind"), F.when(again, F.round(wait, 6)).alias("seconds"))


QUERIES, ORACLES = _r.queries, _r.oracles
