"""Registration of queries with their SQL twins, and the catalogue's tables as the queries see them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.tables import table


class Registry:
    """Queries of one module."""

    def __init__(self) -> None:
        self.queries: dict = {}
        self.oracles: dict[str, str] = {}

    def query(self, name: str, sql: str | None = None):
        def add(f):
            self.queries[name] = f
            if sql:
                self.oracles[name] = sql
            return f

        return add


COLUMNS = ["item_id", "imdb_id", "kind", "title", "year", "runtime_minutes", "episode_count", "genres", "rating", "votes", "updated_at"]
#: The same table in DuckDB, as a common table expression.
TITLES_SQL = f"WITH titles AS (SELECT DISTINCT {', '.join(COLUMNS)} FROM media_items)\n"
#: Watch events: user, item (the property k) and what happened.
EVENTS_SQL = "ev AS (SELECT DISTINCT event_id, ts, user_id, event_type, value, CAST(json_extract(props, '$.k') AS BIGINT) AS item FROM events)\n"


def titles(spark: SparkSession, folder: str) -> DataFrame:
    """The catalogue without repeated rows."""
    return table(spark, folder, "media_items").select(*COLUMNS).distinct()


def events(spark: SparkSession, folder: str) -> DataFrame:
    """Watch events: event_id, ts, user_id, event_type, value, item."""
    rows = table(spark, folder, "events")
    return rows.select("event_id", "ts", "user_id", "event_type", "value", F.get_json_object("props", "$.k").cast("bigint").alias("item")).distinct()


def ratings(spark: SparkSession, folder: str) -> DataFrame:
    """(user, item, stars 1-5): order lines as ratings, by quantity."""
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    stars = 1 + (F.col("l_quantity") - 1) / 49 * 4
    return lines.join(orders, lines.l_orderkey == orders.o_orderkey).select(F.col("o_custkey").alias("user"), F.col("l_partkey").alias("item"), stars.alias("stars"))


RATINGS_SQL = """rating AS (SELECT o_custkey AS "user", l_partkey AS item, 1 + (l_quantity - 1) / 49 * 4 AS stars
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
"""
