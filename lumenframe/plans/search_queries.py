"""Search over names and documents, and the text functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenframe.functions import text as T
from lumenframe.operators import search as S
from lumenframe.plans.base import TITLES_SQL, Registry, titles
from lumenframe.storage import materialize
from lumenframe.tables import table

_r = Registry()
query = _r.query

#: Queries: the English titles of entries, all of them; some with a year, a decade or a length said in words.
_ASKED = """asked AS (SELECT DISTINCT anilist_id AS query, english_title AS q FROM anime_entries WHERE english_title IS NOT NULL),
"""
_SAID = """said AS (SELECT DISTINCT anilist_id AS query, english_title || CASE anilist_id % 8 WHEN 0 THEN ' in ' || year WHEN 1 THEN ' from the ' || year // 10 || '0s' WHEN 2 THEN ' under ' || (minutes + 10) || ' minutes'
  WHEN 3 THEN ', over an hour and a half' WHEN 4 THEN ' between ' || (year - 1) || ' and ' || (year + 1) WHEN 5 THEN ' directed by Jane Doe, before ' || (year + 2) WHEN 6 THEN ' after ' || (year - 2) ELSE ' ' || (year % 100 // 10) || '0s less than 2 hours' END AS q
  FROM anime_entries WHERE english_title IS NOT NULL AND year IS NOT NULL AND minutes IS NOT NULL)
"""
_SPAN_SQL = T._SPAN
_READ = """, l AS (SELECT query, lower(q) AS l FROM said),
d AS (SELECT query, l, nullif(trim(regexp_extract(l, 'directed by (.+?)""" + T._UNTIL + """', 1), ' '), '') AS director FROM l),
a AS (SELECT query, director, CASE WHEN director IS NOT NULL THEN regexp_replace(l, 'directed by ' || regexp_extract(l, 'directed by (.+?)""" + T._UNTIL + """', 1), ' ') ELSE l END AS t FROM d),
n AS (SELECT *, TRY_CAST(nullif(regexp_extract(t, 'between ([0-9]{4}) and ([0-9]{4})', 1), '') AS INT) AS b1, TRY_CAST(nullif(regexp_extract(t, 'between ([0-9]{4}) and ([0-9]{4})', 2), '') AS INT) AS b2,
  TRY_CAST(nullif(regexp_extract(t, '""" + T._DECADE_LONG + """', 1), '') AS INT) AS d4, TRY_CAST(nullif(regexp_extract(t, '""" + T._DECADE_SHORT + """', 1), '') AS INT) AS d2,
  TRY_CAST(nullif(regexp_extract(t, '(?:^|[^a-z])before ([0-9]{4})(?:[^0-9]|$)', 1), '') AS INT) AS bf, TRY_CAST(nullif(regexp_extract(t, '(?:^|[^a-z])after ([0-9]{4})(?:[^0-9]|$)', 1), '') AS INT) AS af,
  TRY_CAST(nullif(regexp_extract(t, '(?:^|[^a-z])since ([0-9]{4})(?:[^0-9]|$)', 1), '') AS INT) AS si, TRY_CAST(nullif(regexp_extract(t, '(?:^|[^a-z])(?:in|from|of) ([0-9]{4})(?:[^0-9]|$)', 1), '') AS INT) AS y,
  regexp_extract(t, '""" + T._UNDER + """', 1) AS u, regexp_extract(t, '""" + T._OVER + """', 1) AS o FROM a),
s AS (SELECT query, director, t, u, o, CASE WHEN b1 BETWEEN 1870 AND 2100 THEN b1 END AS b1, CASE WHEN b2 BETWEEN 1870 AND 2100 THEN b2 END AS b2, CASE WHEN d4 BETWEEN 1870 AND 2100 THEN d4 WHEN d2 IS NOT NULL THEN CASE WHEN d2 < 3 THEN 2000 + d2 * 10 ELSE 1900 + d2 * 10 END END AS dec,
  CASE WHEN bf BETWEEN 1870 AND 2100 THEN bf END AS bf, CASE WHEN af BETWEEN 1870 AND 2100 THEN af END AS af, CASE WHEN si BETWEEN 1870 AND 2100 THEN si END AS si, CASE WHEN y BETWEEN 1870 AND 2100 THEN y END AS y FROM n),
""" + "\n".join(f"m_{x} AS (SELECT query, CASE trim({x}, ' ') " + " ".join(f"WHEN '{w}' THEN {m}" for w, m in T.DURATIONS.items()) + f" ELSE TRY_CAST(nullif(regexp_extract({x}, '^([0-9]+)', 1), '') AS INT) * CASE WHEN regexp_matches({x}, '^[0-9]+ ?h') THEN 60 ELSE 1 END END AS m FROM s)," for x in "uo") + """
reading AS (SELECT s.query, director, CAST(coalesce(b1, dec, af + 1, si, y) AS INT) AS year_from, CAST(CASE WHEN b1 IS NOT NULL THEN b2 WHEN dec IS NOT NULL THEN dec + 9 WHEN bf IS NOT NULL THEN bf - 1 WHEN af IS NOT NULL OR si IS NOT NULL THEN NULL ELSE y END AS INT) AS year_to,
  CAST(mo.m AS INT) AS least_minutes, CAST(mu.m AS INT) AS most_minutes FROM s JOIN m_u mu USING (query) JOIN m_o mo USING (query))
"""
_WORDS = "list_filter(regexp_split_to_array(lower({0}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')"
#: Four fields: titles, other names, genres and the first synopsis, weighted 10, 6, 2 and 1.
_BM25 = """
one AS (SELECT imdb_id, arg_min(text, doc_id) AS plot FROM documents WHERE source = 'synopsis' AND imdb_id IS NOT NULL AND text <> '' GROUP BY 1),
names AS (SELECT DISTINCT m.item_id, title, array_to_string(list_filter(alternative_titles, lambda x: x IS NOT NULL), ' ') AS other, genres, plot FROM media_items m LEFT JOIN one USING (imdb_id)),
word AS (""" + " UNION ALL ".join(f"SELECT item_id, unnest({_WORDS.format(c)}) AS term, {w}::DOUBLE AS w FROM names" for c, w in (("title", 10), ("other", 6), ("genres", 2), ("plot", 1))) + """),
tf AS (SELECT item_id, term, CAST(sum(w) AS DOUBLE) AS tf FROM word GROUP BY 1, 2),
len AS (SELECT item_id, sum(tf) AS dl FROM tf GROUP BY 1), st AS (SELECT count(*) AS n, avg(dl) AS ml FROM len),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
term AS (SELECT DISTINCT query, unnest(""" + _WORDS.format("q") + """) AS term FROM asked), need AS (SELECT query, count(*) AS needed FROM term GROUP BY 1),
hit AS (SELECT query, item_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / ml))), 6) AS score, count(*) AS found
  FROM term JOIN df USING (term) JOIN tf USING (term) JOIN len USING (item_id), st GROUP BY 1, 2),
keyword AS (SELECT query, item_id, score, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, item_id) AS INT) AS rank FROM hit JOIN need USING (query) WHERE found = needed QUALIFY rank <= 50)
"""
_GRAM = "CASE WHEN length({0}) >= 3 THEN list_transform(range(1, length({0}) - 1), lambda i: substr(lower({0}), i, 3)) ELSE [] END"
_ALL_NAMES = """every AS (SELECT item_id, title AS name FROM media_items WHERE title IS NOT NULL UNION SELECT item_id, x.n FROM media_items, unnest(alternative_titles) AS x(n) WHERE x.n IS NOT NULL)"""
_FUZZY = ", " + _ALL_NAMES + """, gt AS (SELECT item_id, gram, count(*)::DOUBLE AS tf FROM (SELECT item_id, unnest(""" + _GRAM.format("name") + """) AS gram FROM every) GROUP BY 1, 2),
gl AS (SELECT item_id, sum(tf) AS dl FROM gt GROUP BY 1), gs AS (SELECT count(*) AS n, avg(dl) AS ml FROM gl), gd AS (SELECT gram, count(*) AS df FROM gt GROUP BY 1),
gq AS (SELECT query, unnest(list_distinct(""" + _GRAM.format("q") + """)) AS gram FROM asked WHERE length(q) >= 4), gn AS (SELECT query, ceil(round(count(*) * 0.3::DOUBLE, 9)) AS needed FROM gq GROUP BY 1),
gh AS (SELECT query, item_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / ml))), 6) AS score, count(*) AS held FROM gq JOIN gd USING (gram) JOIN gt USING (gram) JOIN gl USING (item_id), gs GROUP BY 1, 2),
fuzzy AS (SELECT query, item_id, score, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, item_id) AS INT) AS rank FROM gh JOIN gn USING (query) WHERE held >= needed QUALIFY rank <= 50)
"""
_EXACT = """, e AS (SELECT query, item_id, CAST(row_number() OVER (PARTITION BY query ORDER BY item_id) AS INT) AS rank FROM (SELECT DISTINCT query, item_id FROM asked JOIN every ON lower(q) = lower(name)))
"""


def _asked(spark: SparkSession, folder: str) -> DataFrame:
    entries = table(spark, folder, "anime_entries")
    return entries.select(F.col("anilist_id").alias("query"), F.col("english_title").alias("q")).filter("q is not null").distinct()


def _said(spark: SparkSession, folder: str) -> DataFrame:
    """(query, q): searches in words, with years, decades and lengths in several ways of saying them."""
    e = table(spark, folder, "anime_entries").dropna(subset=["english_title", "year", "minutes"])
    text = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    year = lambda n=0: (F.col("year") + n).cast("string")
    ways = [
        text(" in ", year()), text(" from the ", F.expr("year div 10").cast("string"), "0s"), text(" under ", (F.col("minutes") + 10).cast("string"), " minutes"), text(", over an hour and a half"),
        text(" between ", year(-1), " and ", year(1)), text(" directed by Jane Doe, before ", year(2)), text(" after ", year(-2)), text(" ", F.expr("year % 100 div 10").cast("string"), "0s less than 2 hours"),
    ]
    said = ways[7]
    for i, way in enumerate(ways[:7]):
        said = F.when(F.col("anilist_id") % 8 == i, way).otherwise(said)
    return e.select(F.col("anilist_id").alias("query"), F.concat("english_title", said).alias("q")).distinct()


def _all_names(spark: SparkSession, folder: str) -> DataFrame:
    """(item_id, name): titles and alternative titles."""
    items = table(spark, folder, "media_items")
    more = items.select("item_id", F.explode("alternative_titles").alias("name"))
    return items.select("item_id", F.col("title").alias("name")).unionByName(more).filter("name is not null").distinct()


def _keyword(spark: SparkSession, folder: str, asked: DataFrame | None = None) -> DataFrame:
    docs = table(spark, folder, "documents").filter("source = 'synopsis' and imdb_id is not null and text <> ''")
    plots = docs.groupBy("imdb_id").agg(F.min_by("text", "doc_id").alias("plot"))
    items = table(spark, folder, "media_items").select("item_id", "imdb_id", "title", "genres", F.array_join("alternative_titles", " ").alias("other")).distinct()
    posts = materialize(S.postings(items.join(plots, "imdb_id", "left"), "item_id", {"title": 10, "other": 6, "genres": 2, "plot": 1}), "postings")
    return S.bm25(posts, "item_id", asked if asked is not None else _asked(spark, folder), "query", "q", 50)


def _fuzzy(spark: SparkSession, folder: str, asked: DataFrame | None = None) -> DataFrame:
    posts = materialize(S.gram_postings(_all_names(spark, folder), "item_id", "name"), "pieces")
    return S.fuzzy(posts, "item_id", asked if asked is not None else _asked(spark, folder), "query", "q", 50)


@query("op_k02_all_terms", "WITH " + _ASKED + """names AS (SELECT DISTINCT item_id, title FROM media_items WHERE title IS NOT NULL), w AS (SELECT DISTINCT item_id, unnest(""" + _WORDS.format("title") + """) AS term FROM names),
  t AS (SELECT DISTINCT query, unnest(""" + _WORDS.format("q") + """) AS term FROM asked), n AS (SELECT query, count(*) AS n FROM t GROUP BY 1)
  SELECT query, item_id FROM t JOIN w USING (term) JOIN n USING (query) GROUP BY query, item_id HAVING count(*) = max(n)""")
def all_terms(spark: SparkSession, folder: str) -> DataFrame:
    """The titles that hold every word of a query, for all queries. Candidates are looked up by each query's rarest word."""
    own = table(spark, folder, "media_items").filter("title is not null").select("item_id", "title").distinct()
    own = own.groupBy("item_id").agg(F.array_distinct(F.flatten(F.collect_list(T.words(F.col("title"))))).alias("has"))  # an item's one title
    asked = _asked(spark, folder).select("query", F.array_distinct(T.words(F.col("q"))).alias("want")).filter(F.size("want") > 0)
    held = own.select("item_id", F.explode("has").alias("term"))
    frequency = held.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    terms = asked.select("query", F.explode("want").alias("term")).join(frequency, "term", "left").fillna(0, ["df"])
    rarest = terms.groupBy("query").agg(F.min_by("term", F.struct("df", "term")).alias("term"))
    found = rarest.join(held, "term").select("query", "item_id")
    return found.join(asked, "query").join(own, "item_id").filter(F.size(F.array_except("want", "has")) == 0).select("query", "item_id")


@query("op_k03_bm25", "WITH " + _ASKED + _BM25 + "SELECT query, item_id, score, rank FROM keyword")
def bm25(spark: SparkSession, folder: str) -> DataFrame:
    """The titles that hold all words of a query, by BM25 over four weighted fields."""
    return _keyword(spark, folder)


@query("op_k04_trigram", "WITH " + _ASKED.rstrip().rstrip(",") + _FUZZY + "SELECT query, item_id, score, rank FROM fuzzy")
def trigram(spark: SparkSession, folder: str) -> DataFrame:
    """Titles that share three-letter pieces of any name with a query, by BM25."""
    return _fuzzy(spark, folder)


@query("op_k06_fusion", "WITH " + _ASKED + _BM25 + _FUZZY + """, f AS (SELECT query, item_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score, count(*) AS sides
  FROM (SELECT query, item_id, rank FROM keyword UNION ALL SELECT query, item_id, rank FROM fuzzy) GROUP BY 1, 2)
  SELECT query, item_id, score, sides, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, item_id) AS INT) AS rank FROM f QUALIFY rank <= 10""")
def fusion(spark: SparkSession, folder: str) -> DataFrame:
    """Keyword and fuzzy lists fused by reciprocal rank."""
    return S.reciprocal_rank_fusion([_keyword(spark, folder), _fuzzy(spark, folder)], "item_id", 10)


@query("op_k08_query_reading", "WITH " + _SAID + _READ + "SELECT query, director, year_from, year_to, least_minutes, most_minutes FROM reading")
def query_readings(spark: SparkSession, folder: str) -> DataFrame:
    """What searches in words ask for: director, years and lengths."""
    read = _said(spark, folder).select("query", T.query_reading(F.col("q")).alias("r"))
    return read.select("query", "r.director", "r.year_from", "r.year_to", "r.least_minutes", "r.most_minutes")


@query("op_k05_tiers", "WITH " + _ASKED + _SAID + _READ + ", " + _BM25.strip() + _FUZZY + _EXACT + """, limits AS (SELECT * FROM reading WHERE coalesce(year_from, year_to, least_minutes, most_minutes) IS NOT NULL),
  kinds AS (SELECT DISTINCT year_from, year_to, least_minutes, most_minutes FROM limits), own AS (SELECT DISTINCT item_id, year, runtime_minutes AS minutes, votes FROM media_items),
  top AS (SELECT k.*, item_id, row_number() OVER (PARTITION BY year_from, year_to, least_minutes, most_minutes ORDER BY votes DESC NULLS LAST, item_id) AS rank FROM kinds k JOIN own ON coalesce(year >= year_from, year_from IS NULL) AND coalesce(year <= year_to, year_to IS NULL)
    AND coalesce(minutes >= least_minutes, least_minutes IS NULL) AND coalesce(minutes <= most_minutes, most_minutes IS NULL) QUALIFY rank <= 10),
  filters AS (SELECT l.query, t.item_id, t.rank FROM limits l JOIN top t ON t.year_from IS NOT DISTINCT FROM l.year_from AND t.year_to IS NOT DISTINCT FROM l.year_to AND t.least_minutes IS NOT DISTINCT FROM l.least_minutes AND t.most_minutes IS NOT DISTINCT FROM l.most_minutes),
  u0 AS (SELECT query, item_id, 0 AS tier, rank AS pos FROM e UNION ALL SELECT query, item_id, 1, rank FROM keyword UNION ALL SELECT query, item_id, 2, rank FROM filters),
  few AS (SELECT query FROM asked ANTI JOIN (SELECT query FROM u0 GROUP BY 1 HAVING count(DISTINCT item_id) >= 2) USING (query)),
  u AS (FROM u0 UNION ALL SELECT query, item_id, 3, rank FROM fuzzy SEMI JOIN few USING (query)),
  o AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY query, item_id ORDER BY tier, pos) = 1)
  SELECT query, item_id, tier, CAST(pos AS INT) AS pos, CAST(row_number() OVER (PARTITION BY query ORDER BY tier, pos, item_id) AS INT) AS rank FROM o QUALIFY rank <= 10""")
def tiered(spark: SparkSession, folder: str) -> DataFrame:
    """Exact names, then keyword hits, then the most voted within what the search says of years and lengths; fuzzy hits only for
    searches with fewer than two results before."""
    asked = _asked(spark, folder)
    exact = asked.join(_all_names(spark, folder), F.lower("q") == F.lower("name")).select("query", "item_id").distinct()
    exact = exact.select("query", "item_id", F.row_number().over(Window.partitionBy("query").orderBy("item_id")).alias("rank"))
    read = _said(spark, folder).select("query", T.query_reading(F.col("q")).alias("r")).select("query", "r.*")
    own = table(spark, folder, "media_items").select("item_id", "year", F.col("runtime_minutes").alias("minutes"), "votes").distinct()
    sure = [materialize(x, "tier") for x in (exact, _keyword(spark, folder, asked), S.filtered(own, "item_id", read, 10))]
    some = sure[0].select("query", "item_id")
    for x in sure[1:]:
        some = some.unionByName(x.select("query", "item_id"))
    enough = some.distinct().groupBy("query").agg(F.count(F.lit(1)).alias("n")).filter("n >= 2")
    few = asked.join(enough, "query", "left_anti")
    return S.tiers([*sure, _fuzzy(spark, folder, few)], "item_id", 10)


@query("op_k01_normalise", """SELECT DISTINCT item_id, title, trim(regexp_replace(lower(strip_accents(title)), '[^\\p{L}\\p{N}]+', ' ', 'g'), ' ') AS normal FROM media_items
""")
def normalise(spark: SparkSession, folder: str) -> DataFrame:
    """Normal form of every name."""
    own = table(spark, folder, "media_items").select("item_id", "title").distinct()
    return own.withColumn("normal", T.normalise_title(F.col("title")))


@query("op_k13_title_dice", """WITH p AS (SELECT DISTINCT a.anilist_id, m.item_id, regexp_split_to_array(lower(a.english_title), '[^\\p{L}\\p{N}]+') AS x, regexp_split_to_array(lower(m.title), '[^\\p{L}\\p{N}]+') AS y
    FROM anime_entries a JOIN media_items m ON a.year = m.year AND a.episodes = m.episode_count WHERE a.english_title IS NOT NULL),
  f AS (SELECT anilist_id, item_id, list_filter(x, lambda w: w <> '') AS x, list_filter(y, lambda w: w <> '') AS y FROM p)
  SELECT anilist_id, item_id, round(2 * list_sum(list_transform(list_distinct(list_concat(x, y)), lambda w: least(len(list_filter(x, lambda v: v = w)), len(list_filter(y, lambda v: v = w)))))::DOUBLE / (len(x) + len(y)), 6) AS dice FROM f""")
def title_dice(spark: SparkSession, folder: str) -> DataFrame:
    """Word overlap of entries and titles of one year and length."""
    entries = table(spark, folder, "anime_entries").select("anilist_id", "english_title", "year", F.col("episodes").alias("episode_count")).filter("english_title is not null")
    both = entries.join(table(spark, folder, "media_items").select("item_id", "title", "year", "episode_count"), ["year", "episode_count"]).distinct()
    return both.select("anilist_id", "item_id", F.round(T.dice(T.words(F.col("english_title")), T.words(F.col("title"))), 6).alias("dice"))


@query("op_k14_comparable", """SELECT DISTINCT item_id, trim(regexp_replace(regexp_replace(replace(translate(lower(title), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy'), '&', ' and '), '[''’]', '', 'g'), '[^\\p{L}\\p{N}]+', ' ', 'g'), ' ') AS form
  FROM media_items""")
def comparable(spark: SparkSession, folder: str) -> DataFrame:
    own = table(spark, folder, "media_items").select("item_id", "title").distinct()
    return own.select("item_id", T.comparable(F.col("title")).alias("form"))


@query("op_k16_season_split", """WITH e AS (SELECT DISTINCT anilist_id, english_title AS t FROM anime_entries WHERE english_title IS NOT NULL),
  m AS (SELECT *, coalesce(nullif(regexp_extract(t, '[\\s:(]+(?:season (\\d+)|(\\d+)(?:st|nd|rd|th) season|part (\\d+))\\)?\\s*$', 1, 'i'), ''), nullif(regexp_extract(t, '[\\s:(]+(?:season (\\d+)|(\\d+)(?:st|nd|rd|th) season|part (\\d+))\\)?\\s*$', 2, 'i'), ''),
      nullif(regexp_extract(t, '[\\s:(]+(?:season (\\d+)|(\\d+)(?:st|nd|rd|th) season|part (\\d+))\\)?\\s*$', 3, 'i'), '')) AS s, regexp_extract(t, '\\s(II|III|IV|V)\\s*$', 1) AS r FROM e)
  SELECT anilist_id, CASE WHEN s IS NOT NULL THEN regexp_replace(t, '[\\s:(]+(?:season (\\d+)|(\\d+)(?:st|nd|rd|th) season|part (\\d+))\\)?\\s*$', '', 'i') WHEN r <> '' THEN regexp_replace(t, '\\s(II|III|IV|V)\\s*$', '') ELSE t END AS base,
    coalesce(CAST(s AS INT), CASE r WHEN 'II' THEN 2 WHEN 'III' THEN 3 WHEN 'IV' THEN 4 WHEN 'V' THEN 5 END) AS season FROM m""")
def season_split(spark: SparkSession, folder: str) -> DataFrame:
    """Season marks at the end of names."""
    own = table(spark, folder, "anime_entries").select("anilist_id", "english_title").filter("english_title is not null").distinct()
    return own.select("anilist_id", T.season_split(F.col("english_title")).alias("s")).select("anilist_id", "s.base", "s.season")


@query("op_k17_franchise", """WITH h AS (SELECT DISTINCT item_id, regexp_replace(regexp_replace(trim(regexp_replace(lower(title), '(?::| - ).*$', ''), ' '), '^the ', ''), ' (?:\\d+|ii|iii|iv|v)$', '') AS b FROM media_items)
  SELECT item_id, array_to_string(regexp_split_to_array(trim(b, ' '), '\\s+')[1:2], ' ') AS franchise FROM h""")
def franchise(spark: SparkSession, folder: str) -> DataFrame:
    """Franchise keys of all names."""
    own = table(spark, folder, "media_items").select("item_id", "title").distinct()
    return own.select("item_id", T.franchise_key(F.col("title")).alias("franchise"))


@query("op_k11_excerpt", """WITH f AS (SELECT doc_id, trim(regexp_replace(text, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'), ' ') AS t FROM documents WHERE text IS NOT NULL)
  SELECT doc_id, CASE WHEN length(t) <= 220 THEN t ELSE regexp_replace(substr(t, 1, 220), '[ \\t\\n\\x0B\\f\\r][^ \\t\\n\\x0B\\f\\r]*$', '') || '…' END AS excerpt FROM f""")
def excerpts(spark: SparkSession, folder: str) -> DataFrame:
    """The beginning of every text."""
    own = table(spark, folder, "documents").filter("text is not null")
    return own.select("doc_id", T.excerpt(F.col("text")).alias("excerpt"))


@query("op_k07_popularity_prior", TITLES_SQL + """SELECT item_id, round(coalesce(rating, 0) / 100.0::DOUBLE + 0.4 * ln(1 + coalesce(votes, 0)) / ln(1 + max(coalesce(votes, 0)) OVER ()), 6) AS score FROM titles""")
def popularity_prior(spark: SparkSession, folder: str) -> DataFrame:
    """A score with a share of logarithmic votes; the greatest votes come from one aggregate row."""
    own = titles(spark, folder).select("item_id", F.coalesce("rating", F.lit(0)).alias("r"), F.coalesce("votes", F.lit(0)).alias("v"))
    most = own.agg(F.max("v").alias("most"))
    score = F.col("r") / 100 + 0.4 * F.log(1 + F.col("v")) / F.log(1 + F.col("most"))
    return own.join(F.broadcast(most)).select("item_id", F.round(score, 6).alias("score"))


@query("op_x08_signals", """WITH p AS (SELECT DISTINCT a.anilist_id, m.item_id, a.year AS y, m.year AS z, a.minutes AS s, m.runtime_minutes AS t, m.votes AS v
    FROM anime_entries a JOIN media_items m ON lower(a.title) = lower(m.title))
  SELECT anilist_id, item_id, CASE WHEN y IS NULL OR z IS NULL THEN 0.5 WHEN y = z THEN 1.0 WHEN abs(y - z) = 1 THEN 0.6 ELSE 0.0 END::DOUBLE AS year_signal,
    round(CASE WHEN s IS NULL OR t IS NULL THEN 0.5 ELSE greatest(0, 1 - abs(s - t)::DOUBLE / t) END, 6)::DOUBLE AS runtime_signal,
    round(least(log10(coalesce(v, 0) + 1) / 6, 1), 6) AS popularity FROM p""")
def signals(spark: SparkSession, folder: str) -> DataFrame:
    """Year, runtime and popularity signals; unknown facts are neutral."""
    entries = table(spark, folder, "anime_entries").select("anilist_id", F.lower("title").alias("n"), F.col("year").alias("y"), F.col("minutes").alias("s"))
    items = table(spark, folder, "media_items").select("item_id", F.lower("title").alias("n"), F.col("year").alias("z"), F.col("runtime_minutes").alias("t"), F.col("votes").alias("v"))
    p = entries.join(items, "n").drop("n").distinct()
    year = F.when(F.col("y").isNull() | F.col("z").isNull(), 0.5).when(F.col("y") == F.col("z"), 1.0).when(F.abs(F.col("y") - F.col("z")) == 1, 0.6).otherwise(0.0)
    runtime = F.when(F.col("s").isNull() | F.col("t").isNull(), 0.5).otherwise(F.greatest(F.lit(0.0), 1 - F.abs(F.col("s") - F.col("t")) / F.col("t")))
    popular = F.least(F.log10(F.coalesce("v", F.lit(0)) + 1) / 6, F.lit(1.0))
    return p.select("anilist_id", "item_id", year.alias("year_signal"), F.round(runtime, 6).alias("runtime_signal"), F.round(popular, 6).alias("popularity"))


QUERIES, ORACLES = _r.queries, _r.oracles
