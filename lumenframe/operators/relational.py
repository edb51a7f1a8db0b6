"""Relational building blocks of the catalogue: scopes, histograms, top lists, ordered unions and identity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEPT_KINDS = ("movie", "tvMovie", "video", "short", "tvSpecial", "tvSeries", "tvMiniSeries")
FILM_KINDS = ("movie", "tvMovie", "video", "short", "tvSpecial")
SERIES_KINDS = ("tvSeries", "tvMiniSeries")
VOTE_EDGES = (0, 10, 50, 100, 500, 1000, 5000, 10000, 50000, 100000)


def media_kind(kind: Column) -> Column:
    """film or series; null for kinds that aren't kept."""
    return F.when(kind.isin(*FILM_KINDS), "film").when(kind.isin(*SERIES_KINDS), "series")


def in_scope(votes: Column, year: Column, least: int, this_year: int, unrated_years: int) -> Column:
    """Enough votes, or unrated and recent; an unrated title without a year is out."""
    return F.when(votes.isNull(), F.coalesce(year >= this_year - unrated_years, F.lit(False))).otherwise(votes >= least)


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    """The first n rows of every key in a total order, numbered from 1."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn(rank, place).filter(F.col(rank) <= n)


def vote_histogram(df: DataFrame, votes: str = "votes") -> DataFrame:
    """(edge, titles, at_least): titles between each edge and the next, and at or above it."""
    edge = F.lit(None).cast("int")
    for e in VOTE_EDGES:
        edge = F.when(F.col(votes) >= e, e).otherwise(edge)
    counts = df.filter(F.col(votes).isNotNull()).groupBy(edge.alias("edge")).agg(F.count(F.lit(1)).alias("titles"))
    above = Window.orderBy(F.col("edge").desc()).rowsBetween(Window.unboundedPreceding, 0)  # ten rows
    return counts.withColumn("at_least", F.sum("titles").over(above))


def first_seen_union(lists: list[tuple[DataFrame, str, list[Column]]], limit: int) -> DataFrame:
    """(id, list, pos): ids of several ordered lists, each where it is seen first, lists in turn, at most `limit`.

    lists: frame, id column and total order of each. Every list is cut to `limit` first, so little is sorted together.
    """
    parts = None
    for i, (df, key, order) in enumerate(lists):
        head = df.orderBy(*order).limit(limit)
        one = head.select(F.col(key).alias("id"), F.lit(i).alias("list"), F.row_number().over(Window.orderBy(*order)).alias("pos"))
        parts = one if parts is None else parts.unionByName(one)
    first = F.row_number().over(Window.partitionBy("id").orderBy("list", "pos"))
    return parts.withColumn("_n", first).filter("_n = 1").drop("_n").orderBy("list", "pos").limit(limit)


def interleave(df: DataFrame, lists: str, order: list[Column], key: str) -> DataFrame:
    """Round robin over ordered lists: (key, list, pos, place), the first of each list, then the second, each key once."""
    pos = F.row_number().over(Window.partitionBy(lists).orderBy(*order))
    seen = df.withColumn("pos", pos).withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy("pos", lists)))
    return seen.filter("_n = 1").select(key, lists, "pos", F.row_number().over(Window.orderBy("pos", lists)).alias("place"))


def lower_median(x: Column) -> Column:
    """The lower middle of the sorted values."""
    values = F.sort_array(F.collect_list(x))
    return F.get(values, F.floor((F.size(values) - 1) / 2).cast("int"))
