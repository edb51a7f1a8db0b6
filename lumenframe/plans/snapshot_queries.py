"""Queries over the periodic full dumps of titles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenframe.operators.snapshots import consecutive, snapshot_changes
from lumenframe.tables import table

COMPARED = ["title", "year", "votes", "average_rating"]


def _changes(spark: SparkSession, folder: str) -> DataFrame:
    dumps = table(spark, folder, "title_snapshots")
    return snapshot_changes(dumps, "mirror_id", "snapshot_no", "imdb_id", COMPARED, "loaded_at", extra=["title_type"])


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    found = _changes(spark, folder)
    return found.select(F.col("source").alias("mirror_id"), F.col("number").cast("int").alias("snapshot_no"), F.col("key").alias("imdb_id"), "change")


def p2_refresh(spark: SparkSession, folder: str) -> DataFrame:
    """Per dump what its mirror should have reported: titles and episodes added, removed or changed, and votes gained."""
    changes = _changes(spark, folder)
    episode = F.coalesce(F.col("extra.title_type") == "tvEpisode", F.lit(False))
    count = lambda what: F.count(F.when(what, 1))
    gained = F.sum(F.when(F.col("change") == "changed", F.col("after.votes") - F.col("before.votes")))
    return changes.groupBy(F.col("source").alias("mirror_id"), F.col("number").cast("int").alias("snapshot_no")).agg(
        count((F.col("change") == "added") & ~episode).alias("titles_added"), count((F.col("change") == "added") & episode).alias("episodes_added"),
        count(F.col("change") == "removed").alias("removed"), count(F.col("change") == "changed").alias("changed"), gained.alias("votes_gained"),
    )


def _sides(spark: SparkSession, folder: str) -> DataFrame:
    """source, number, key, old, new: the latest rows (year, votes) of every key in each dump and in the one delivered before it."""
    known = table(spark, folder, "title_snapshots").dropna(subset=["mirror_id", "snapshot_no", "imdb_id"])
    own = known.select(F.col("mirror_id").alias("source"), F.col("snapshot_no").alias("number"), F.col("imdb_id").alias("key"), F.struct("loaded_at", "title", "year", "votes").alias("row"))
    latest = own.groupBy("source", "number", "key").agg(F.max("row").alias("row"))
    order = consecutive(known.select(F.col("mirror_id").alias("source"), F.col("snapshot_no").alias("number")))
    placed = latest.join(order, ["source", "number"])
    none = F.lit(None).cast("struct<loaded_at: timestamp_ntz, title: string, year: int, votes: bigint>")
    new = placed.filter("previous is not null").select("source", "number", "key", none.alias("old"), F.col("row").alias("new"))
    old = placed.filter("following is not null").select("source", F.col("following").alias("number"), "key", F.col("row").alias("old"), none.alias("new"))
    return new.unionByName(old).groupBy("source", "number", "key").agg(F.max("old").alias("old"), F.max("new").alias("new"))


def dump_diff(spark: SparkSession, folder: str) -> DataFrame:
    """New, missing, changed and unchanged rows of every dump of every mirror against the one delivered before, by votes."""
    both = _sides(spark, folder)
    same = F.col("old.votes").eqNullSafe(F.col("new.votes"))
    state = F.when(F.col("old").isNull(), "new").when(F.col("new").isNull(), "missing").when(~same, "changed").otherwise("unchanged")
    return both.select(F.col("source").alias("mirror_id"), F.col("number").alias("snapshot_no"), F.col("key").alias("imdb_id"), state.alias("state"))


def dump_moved(spark: SparkSession, folder: str) -> DataFrame:
    """Rows missing from a dump that one row of it with the same year and votes explains, where there is exactly one such."""
    both = _sides(spark, folder)
    gone = both.filter("new is null").select("source", "number", F.col("key").alias("was"), F.col("old.year").alias("year"), F.col("old.votes").alias("votes"))
    here = both.filter("new is not null").select("source", "number", F.col("key").alias("now"), F.col("new.year").alias("year"), F.col("new.votes").alias("votes"))
    found = gone.join(here, ["source", "number", "year", "votes"]).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("source", "number", "was")))
    return found.filter("n = 1").select(F.col("source").alias("mirror_id"), F.col("number").alias("snapshot_no"), "was", "now")


_DUMPS = """
WITH one AS (
  SELECT mirror_id, snapshot_no, imdb_id, year, votes FROM title_snapshots WHERE mirror_id IS NOT NULL AND snapshot_no IS NOT NULL AND imdb_id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY mirror_id, snapshot_no, imdb_id ORDER BY loaded_at DESC NULLS LAST, title DESC NULLS LAST, year DESC NULLS LAST, votes DESC NULLS LAST) = 1),
dump AS (SELECT mirror_id, snapshot_no, lag(snapshot_no) OVER (PARTITION BY mirror_id ORDER BY snapshot_no) AS before FROM (SELECT DISTINCT mirror_id, snapshot_no FROM one)),
new AS (SELECT o.* FROM dump d JOIN one o USING (mirror_id, snapshot_no) WHERE before IS NOT NULL),
old AS (SELECT d.mirror_id, d.snapshot_no, o.imdb_id, o.year, o.votes FROM dump d JOIN one o ON o.mirror_id = d.mirror_id AND o.snapshot_no = d.before)
"""
DUMP_ORACLES = {
    "op_e05_scan_diff": _DUMPS + """SELECT mirror_id, snapshot_no, imdb_id, CASE WHEN o.hit IS NULL THEN 'new' WHEN n.hit IS NULL THEN 'missing' WHEN o.votes IS DISTINCT FROM n.votes THEN 'changed' ELSE 'unchanged' END AS state
  FROM (SELECT *, 1 AS hit FROM new) n FULL JOIN (SELECT *, 1 AS hit FROM old) o USING (mirror_id, snapshot_no, imdb_id)""",
    "op_j23_moved": _DUMPS + """, gone AS (SELECT * FROM old ANTI JOIN new USING (mirror_id, snapshot_no, imdb_id))
  SELECT mirror_id, snapshot_no, was, now FROM (SELECT g.mirror_id, g.snapshot_no, g.imdb_id AS was, n.imdb_id AS now, count(*) OVER (PARTITION BY g.mirror_id, g.snapshot_no, g.imdb_id) AS c
    FROM gone g JOIN new n ON n.mirror_id = g.mirror_id AND n.snapshot_no = g.snapshot_no AND n.year = g.year AND n.votes = g.votes) WHERE c = 1""",
}


_SQL = """
WITH one AS (
  SELECT * FROM title_snapshots WHERE mirror_id IS NOT NULL AND snapshot_no IS NOT NULL AND imdb_id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY mirror_id, snapshot_no, imdb_id ORDER BY loaded_at DESC NULLS LAST, title DESC NULLS LAST,
    year DESC NULLS LAST, votes DESC NULLS LAST, average_rating DESC NULLS LAST, title_type DESC NULLS LAST) = 1),
dump AS (SELECT mirror_id, snapshot_no, lag(snapshot_no) OVER (PARTITION BY mirror_id ORDER BY snapshot_no) AS before
         FROM (SELECT DISTINCT mirror_id, snapshot_no FROM one)),
new AS (SELECT d.mirror_id, d.snapshot_no AS no, o.* EXCLUDE (mirror_id, snapshot_no) FROM dump d JOIN one o ON o.mirror_id = d.mirror_id AND o.snapshot_no = d.snapshot_no WHERE before IS NOT NULL),
old AS (SELECT d.mirror_id, d.snapshot_no AS no, o.* EXCLUDE (mirror_id, snapshot_no) FROM dump d JOIN one o ON o.mirror_id = d.mirror_id AND o.snapshot_no = d.before),
diff AS (
  SELECT coalesce(n.mirror_id, o.mirror_id) AS mirror_id, coalesce(n.no, o.no) AS snapshot_no, coalesce(n.imdb_id, o.imdb_id) AS imdb_id,
    CASE WHEN o.imdb_id IS NULL THEN 'added' WHEN n.imdb_id IS NULL THEN 'removed'
      WHEN n.title IS DISTINCT FROM o.title OR n.year IS DISTINCT FROM o.year OR n.votes IS DISTINCT FROM o.votes
        OR n.average_rating IS DISTINCT FROM o.average_rating THEN 'changed' END AS change,
    CASE WHEN n.imdb_id IS NULL THEN o.title_type ELSE n.title_type END AS title_type, n.votes - o.votes AS gain
  FROM new n FULL JOIN old o ON n.mirror_id = o.mirror_id AND n.no = o.no AND n.imdb_id = o.imdb_id)
"""
ORACLES = {
    "p2_found": _SQL + "SELECT mirror_id, snapshot_no, imdb_id, change FROM diff WHERE change IS NOT NULL",
    "p2_refresh": _SQL
    + """SELECT mirror_id, snapshot_no,
        count(*) FILTER (change = 'added' AND title_type IS DISTINCT FROM 'tvEpisode') AS titles_added,
        count(*) FILTER (change = 'added' AND title_type = 'tvEpisode') AS episodes_added,
        count(*) FILTER (change = 'removed') AS removed, count(*) FILTER (change = 'changed') AS changed,
        CAST(sum(gain) FILTER (change = 'changed') AS BIGINT) AS votes_gained
        FROM diff WHERE change IS NOT NULL GROUP BY 1, 2""",
}
QUERIES = {"p2_found": p2_found, "p2_refresh": p2_refresh}
QUERIES |= {"op_e05_scan_diff": dump_diff, "op_j23_moved": dump_moved}
ORACLES |= DUMP_ORACLES
