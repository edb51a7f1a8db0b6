"""Queries over the training-data operators, with production parameters, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.llm.containers import fill_containers
from lumenframe.llm.cooccurrence import associated_pairs
from lumenframe.llm.lookalikes import alike_pairs, unify
from lumenframe.llm.matching import match
from lumenframe.llm.mixing import mix, mixture_report
from lumenframe.llm.pages import non_prose_shares, stuffed_pages
from lumenframe.llm.tokens import token_counts
from lumenframe.storage import materialize
from lumenframe.tables import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(f):
    """Register f under its name."""
    QUERIES[f.__name__] = f
    return f


def _together(spark: SparkSession, folder: str) -> DataFrame:
    shown = table(spark, folder, "recommendations").select("rec_id", "loved_with")
    return associated_pairs(shown, "rec_id", F.col("loved_with.item_id"), min_together=10, min_lift=5)


@query
def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return _together(spark, folder).select(F.col("item_a").alias("item_id_a"), F.col("item_b").alias("item_id_b"))


@query
def p1_scores(spark: SparkSession, folder: str) -> DataFrame:
    """The same pairs with their counts, lift and conviction."""
    scores = _together(spark, folder)
    return scores.select("item_a", "item_b", "n_ab", F.round("lift", 6).alias("lift"), F.round("conviction", 6).alias("conviction"), F.round("conviction_back", 6).alias("conviction_back"))


_PAIRS = """
WITH element AS (
  SELECT DISTINCT r.rec_id, e.x.item_id AS item FROM recommendations r, unnest(r.loved_with) AS e(x)
  WHERE e.x.item_id IS NOT NULL AND r.rec_id IS NOT NULL),
total AS (SELECT count(DISTINCT rec_id) AS n FROM element),
one AS (SELECT item, count(*) AS n_item FROM element GROUP BY item),
two AS (SELECT a.item AS item_a, b.item AS item_b, count(*) AS n_ab
        FROM element a JOIN element b ON a.rec_id = b.rec_id AND a.item < b.item GROUP BY 1, 2 HAVING count(*) >= 10),
pair AS (SELECT item_a, item_b, n_ab, x.n_item AS n_a, y.n_item AS n_b, n
         FROM two JOIN one x ON x.item = item_a JOIN one y ON y.item = item_b, total WHERE n_ab * n >= 5 * x.n_item * y.n_item)
"""
ORACLES["p1_found"] = _PAIRS + "SELECT item_a AS item_id_a, item_b AS item_id_b FROM pair"
ORACLES["p1_scores"] = _PAIRS + """
SELECT item_a, item_b, n_ab, round(n_ab::DOUBLE * n / (n_a::DOUBLE * n_b), 6) AS lift,
       round(CASE WHEN n_ab < n_a THEN (1 - n_b::DOUBLE / n) / (1 - n_ab::DOUBLE / n_a) END, 6) AS conviction,
       round(CASE WHEN n_ab < n_b THEN (1 - n_a::DOUBLE / n) / (1 - n_ab::DOUBLE / n_b) END, 6) AS conviction_back FROM pair"""


def _names(spark: SparkSession, folder: str) -> DataFrame:
    items = table(spark, folder, "media_items")
    more = items.select("item_id", F.explode("alternative_titles").alias("name"))
    return items.select("item_id", F.col("title").alias("name")).unionByName(more)


@query
def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    found = alike_pairs(_names(spark, folder), "item_id", "name")
    return found.select(F.col("item_a").alias("item_id_a"), F.col("item_b").alias("item_id_b"))


@query
def p3_forms(spark: SparkSession, folder: str) -> DataFrame:
    """Every name of every item with its consistent form."""
    return unify(_names(spark, folder).distinct(), "name")


@query
def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    found = stuffed_pages(table(spark, folder, "documents").select("doc_id", "text"), "doc_id", "text")
    return found.select(F.col("key").alias("doc_id")).distinct()


@query
def p8_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's shares of link lists, tag lists, menus and lists of facts."""
    shares = non_prose_shares(table(spark, folder, "documents").select("doc_id", "text"), "doc_id", "text")
    return shares.withColumnRenamed("key", "doc_id")


def _sized(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts(table(spark, folder, "documents"), "doc_id", "text", keep=["source"])


@query
def p6_containers(spark: SparkSession, folder: str) -> DataFrame:
    """The containers of every document, for each kind of container."""
    kinds = table(spark, folder, "container_sizes").limit(1001).collect()  # a table of kinds, checked to be small
    if len(kinds) > 1000:
        raise ValueError("more than 1,000 kinds of container")
    sized = _sized(spark, folder).select("key", "tokens")
    placed = fill_containers(sized, {r.container_kind: r.capacity_tokens for r in kinds})
    return placed.withColumnsRenamed({"kind": "container_kind", "key": "doc_id"})


@query
def p6_fill(spark: SparkSession, folder: str) -> DataFrame:
    """Per kind of container: how many there are, and how full."""
    one = p6_containers(spark, folder).groupBy("container_kind", "container").agg(F.max("fill").alias("fill"), F.count(F.lit(1)).alias("texts"))
    sizes = table(spark, folder, "container_sizes")
    total = one.groupBy("container_kind").agg(
        F.count(F.lit(1)).alias("containers"), F.sum("fill").alias("tokens"), F.sum("texts").alias("parts"), F.max("fill").alias("fullest")
    )
    return total.join(sizes, "container_kind").withColumn("filled", F.round(F.col("tokens") / (F.col("containers") * F.col("capacity_tokens")), 6))


def _targets(spark: SparkSession, folder: str) -> dict[str, tuple[float, int]]:
    rows = table(spark, folder, "mix_targets").limit(10_001).collect()  # a table of targets, checked to be small
    if len(rows) > 10_000:
        raise ValueError("more than 10,000 targets")
    return {r.source: (r.target_share, r.max_repeats) for r in rows}


@query
def p7_mixture(spark: SparkSession, folder: str) -> DataFrame:
    """The documents of the mixture and how often each is used."""
    used = mix(_sized(spark, folder), _targets(spark, folder))
    return used.withColumnRenamed("key", "doc_id")


@query
def p7_shares(spark: SparkSession, folder: str) -> DataFrame:
    """The shares and repeats reached for each source."""
    sized, targets = materialize(_sized(spark, folder), "sized"), _targets(spark, folder)
    return mixture_report(mix(sized, targets), sized, targets)


def _matches(spark: SparkSession, folder: str) -> DataFrame:
    entries = table(spark, folder, "anime_entries").select(
        F.col("anilist_id").alias("id"), F.col("english_title").alias("english"), F.col("title").alias("romanised"),
        F.col("native_title").alias("native"), "year", F.col("format").alias("kind"), "episodes", "minutes",
    )
    items = table(spark, folder, "media_items").select(
        F.col("imdb_id").alias("id"), F.concat(F.array("title"), F.coalesce("alternative_titles", F.array().cast("array<string>"))).alias("names"),
        "year", "kind", F.col("episode_count").alias("episodes"), F.col("runtime_minutes").alias("minutes"), "genres",
    )
    return match(entries, items)


@query
def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return _matches(spark, folder).select(F.col("entry").alias("anilist_id"), F.col("item").alias("imdb_id"))


@query
def p4_confidence(spark: SparkSession, folder: str) -> DataFrame:
    """The matches with their posteriors."""
    found = _matches(spark, folder)
    return found.select(F.col("entry").alias("anilist_id"), F.col("item").alias("imdb_id"), F.round("confidence", 6).alias("confidence"))
