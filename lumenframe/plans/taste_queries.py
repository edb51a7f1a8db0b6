"""Vectors, collaborative filtering, taste, discovery and evaluation."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenframe.operators import recommend as C
from lumenframe.operators import vectors as V
from lumenframe.operators.relational import top_per_key
from lumenframe.plans.base import EVENTS_SQL, RATINGS_SQL, TITLES_SQL, Registry, events, ratings, titles
from lumenframe.storage import materialize
from lumenframe.tables import table

_r = Registry()
query = _r.query
_E = "WITH e AS (SELECT DISTINCT vec_id, embedding::DOUBLE[] AS v, label FROM embeddings)\n"
_KNN = _E + """, knn AS (SELECT q.vec_id AS query, b.vec_id AS id, round(list_cosine_similarity(q.v, b.v), 6) AS similarity,
  CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(q.v, b.v), 6) DESC, b.vec_id) AS INT) AS rank
  FROM e q JOIN e b ON q.vec_id <> b.vec_id WHERE q.vec_id % 20 = 0 QUALIFY rank <= 10)
"""


def _vectors(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").dropDuplicates(["vec_id"])


def _asked(spark: SparkSession, folder: str) -> DataFrame:
    return _vectors(spark, folder).filter("vec_id % 20 = 0")


@query("op_v01_nearest", _KNN + "SELECT query, id, similarity, rank FROM knn")
def nearest(spark: SparkSession, folder: str) -> DataFrame:
    """Exact neighbours of every twentieth vector among all."""
    return V.nearest(_vectors(spark, folder), _asked(spark, folder), "vec_id", "embedding", 10)


def _indexed(spark: SparkSession, folder: str) -> tuple[DataFrame, V.Cells]:
    """The vectors in their cells: an index made of the even ids first, with the odd ones inserted."""
    own = _vectors(spark, folder)
    cells = V.fit_cells(own, "vec_id", "embedding")
    index = V.in_cells(own.filter("vec_id % 2 = 0"), "vec_id", "embedding", cells)
    return materialize(V.insert(index, own.filter("vec_id % 2 = 1"), "vec_id", "embedding", cells), "index"), cells


@query("op_v02_nearest_in_cells")
def nearest_in_cells(spark: SparkSession, folder: str) -> DataFrame:
    """Approximate neighbours of every twentieth vector: of the rows in its nearest cells."""
    index, cells = _indexed(spark, folder)
    return V.nearest_in_cells(index, _asked(spark, folder), "vec_id", "embedding", cells, 10)


@query("op_v03_recall")
def recall(spark: SparkSession, folder: str) -> DataFrame:
    """Queries, the share of true neighbours that the index finds, and the share of all rows it looks at."""
    found = materialize(nearest_in_cells(spark, folder), "found")
    seen = found.groupBy("query").agg(F.max("candidates").alias("c")).agg(F.avg("c").alias("c"))
    rows = _vectors(spark, folder).agg(F.count(F.lit(1)).alias("rows"))
    both = V.recall_at(found, nearest(spark, folder)).join(F.broadcast(seen)).join(F.broadcast(rows))  # single rows
    return both.select("queries", F.round("recall", 4).alias("recall"), F.round(F.col("c") / F.col("rows"), 4).alias("looked_at"))


@query("op_v09_prior_rank", _E + """, m AS (SELECT max(vec_id) AS most FROM e)
  SELECT query, id, similarity AS score, rank FROM (SELECT q.vec_id AS query, b.vec_id AS id, round(list_cosine_similarity(q.v, b.v) + 0.5 * log10(1 + b.vec_id) / log10(1 + most), 6) AS similarity,
    CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(q.v, b.v) + 0.5 * log10(1 + b.vec_id) / log10(1 + most), 6) DESC, b.vec_id) AS INT) AS rank FROM e q JOIN e b ON q.vec_id <> b.vec_id, m WHERE q.vec_id % 20 = 0 QUALIFY rank <= 10)""")
def prior_rank(spark: SparkSession, folder: str) -> DataFrame:
    """Likeness to every twentieth vector with a logarithmic prior; the id stands for votes."""
    own = _vectors(spark, folder)
    own = own.join(F.broadcast(own.agg(F.max("vec_id").alias("most"))))  # one row
    prior = 0.5 * F.log10(1 + F.col("vec_id")) / F.log10(1 + F.col("most"))
    return V.nearest(own, _asked(spark, folder), "vec_id", "embedding", 10, prior).withColumnRenamed("similarity", "score")


_SHOWN_VECTORS = """, n AS (SELECT count(DISTINCT vec_id) AS n FROM embeddings), tv AS (SELECT DISTINCT item_id, v FROM media_items, n JOIN e ON vec_id = item_id % n)
"""


@query("op_k09_similar_titles", _E + _SHOWN_VECTORS + """SELECT q.item_id AS query, b.item_id AS id, round(list_cosine_similarity(q.v, b.v), 6) AS similarity,
  CAST(row_number() OVER (PARTITION BY q.item_id ORDER BY round(list_cosine_similarity(q.v, b.v), 6) DESC, b.item_id) AS INT) AS rank FROM tv q JOIN tv b ON q.item_id <> b.item_id WHERE q.item_id % 20 = 0 QUALIFY rank <= 10""")
def similar_titles(spark: SparkSession, folder: str) -> DataFrame:
    """The titles most like every twentieth one, itself left out."""
    own = _vectors(spark, folder)
    n = max(own.count(), 1)
    items = titles(spark, folder).select("item_id", F.pmod("item_id", F.lit(n)).alias("vec_id")).distinct().join(own.select("vec_id", "embedding"), "vec_id")
    return V.nearest_sharing(items, items.filter("item_id % 20 = 0"), "item_id", "vec_id", "embedding", 10)


@query("op_x14_quantise", _E + """, p AS (SELECT vec_id, v, list_max(list_transform(v, lambda x: abs(x))) AS peak FROM e), i AS (SELECT vec_id, v, list_transform(v, lambda x: round(x * 127 / peak)) AS b FROM p)
  SELECT vec_id, CAST(list_sum(b) AS BIGINT) AS total, round(list_cosine_similarity(v, b), 6) AS kept FROM i""")
def quantised(spark: SparkSession, folder: str) -> DataFrame:
    """Quantised vectors and how much of their direction is kept."""
    both = _vectors(spark, folder).withColumn("b", V.quantise(F.col("embedding")))
    total = F.aggregate("b", F.lit(0).cast("bigint"), lambda s, x: s + x)
    return both.select("vec_id", total.alias("total"), F.round(V.cosine(F.col("embedding"), F.col("b")), 6).alias("kept"))


@query("op_a11_mean_vector", _E + """, u AS (SELECT label, (vec_id % 7) - 1 AS w, v, sqrt(list_dot_product(v, v)) AS n FROM e), x AS (SELECT label, unnest(range(1, len(v) + 1)) AS pos, unnest(v) / n * w AS c FROM u WHERE w > 0),
  s AS (SELECT label, pos, sum(c) AS c FROM x GROUP BY 1, 2) SELECT label, CAST(pos AS INT) AS pos, round(c / sqrt(sum(c * c) OVER (PARTITION BY label)), 6) AS c FROM s""")
def mean_vector(spark: SparkSession, folder: str) -> DataFrame:
    """Weighted mean directions per label."""
    mean = V.mean_vectors(_vectors(spark, folder), "label", "embedding", F.col("vec_id") % 7 - 1)
    return mean.select("label", F.posexplode("mean").alias("at", "x")).select("label", (F.col("at") + 1).alias("pos"), F.round("x", 6).alias("c"))


@query("op_v08_modes")
def modes(spark: SparkSession, folder: str) -> DataFrame:
    """Interests of every rating user: clusters of the vectors of what they like (a user's likes are a bounded list)."""
    own = _vectors(spark, folder)
    n = own.count()
    liked = C.likes(ratings(spark, folder)).withColumn("vec_id", F.pmod("item", F.lit(max(n, 1))))
    both = liked.join(own.select("vec_id", "embedding"), "vec_id").select("user", "item", "w", "embedding")

    def run(pool: pd.DataFrame) -> pd.DataFrame:
        pool = pool.sort_values("item").reset_index(drop=True)
        m = np.stack(pool["embedding"].map(np.asarray).to_numpy()).astype(float)
        m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
        return pool[["user", "item"]].assign(mode=V.modes(m, pool["w"].to_numpy()).astype("int32"))

    return both.groupBy("user").applyInPandas(run, "user bigint, item bigint, mode int")


_LIKED = "WITH " + RATINGS_SQL + """, l0 AS (SELECT DISTINCT "user", item FROM rating WHERE stars >= 4), l1 AS (SELECT * FROM l0 SEMI JOIN (SELECT item FROM l0 GROUP BY item HAVING count(*) >= 5) USING (item)),
 liked AS (SELECT "user", item, 1 / ln(exp(1.0::DOUBLE) + count(*) OVER (PARTITION BY "user")) AS w FROM l1)
"""
_EDGES = _LIKED + """, t AS (SELECT a.item AS i, b.item AS j, sum(a.w) AS t FROM liked a JOIN liked b ON a."user" = b."user" AND a.item <> b.item GROUP BY 1, 2), m AS (SELECT item, sum(w) AS m FROM liked GROUP BY 1),
 s AS (SELECT i AS item, j AS neighbour, round(t / (pow(x.m, 1 - 0.65::DOUBLE) * pow(y.m, 0.65::DOUBLE)), 6) AS score FROM t JOIN m x ON x.item = i JOIN m y ON y.item = j),
 edge AS (SELECT item, neighbour, score, CAST(row_number() OVER (PARTITION BY item ORDER BY score DESC, neighbour) AS INT) AS rank FROM s QUALIFY rank <= 50)
"""


@query("op_r01_likes", _LIKED + 'SELECT "user", item, round(w, 6) AS w FROM liked')
def likes(spark: SparkSession, folder: str) -> DataFrame:
    return C.likes(ratings(spark, folder)).withColumn("w", F.round("w", 6))


@query("op_r02_neighbours", _EDGES + "SELECT item, neighbour, score, rank FROM edge")
def neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return C.item_neighbours(materialize(C.likes(ratings(spark, folder)), "likes"))


@query("op_r03_recommend", _EDGES + """, f AS (SELECT "user", neighbour AS item, round(sum(score), 6) AS score FROM liked JOIN edge USING (item) GROUP BY 1, 2)
  SELECT "user", item, score, CAST(row_number() OVER (PARTITION BY "user" ORDER BY score DESC, item) AS INT) AS rank FROM f ANTI JOIN liked USING ("user", item) QUALIFY rank <= 20""")
def recommended(spark: SparkSession, folder: str) -> DataFrame:
    liked = materialize(C.likes(ratings(spark, folder)), "likes")
    return C.recommend(liked, materialize(C.item_neighbours(liked), "edges"), 20)


@query("op_a03_typical_scores", _EDGES + "SELECT rank, round(avg(score), 6) AS typical FROM edge WHERE rank <= 20 GROUP BY rank")
def typical(spark: SparkSession, folder: str) -> DataFrame:
    return C.typical_scores(neighbours(spark, folder), 20)


@query("op_a13_popularity", _LIKED + "SELECT item, count(*) AS likes, round(sum(w), 6) AS mass FROM liked GROUP BY item")
def popularity(spark: SparkSession, folder: str) -> DataFrame:
    """Likes and weighted mass of every item."""
    return C.likes(ratings(spark, folder)).groupBy("item").agg(F.count(F.lit(1)).alias("likes"), F.round(F.sum("w"), 6).alias("mass"))


@query("op_j15_best_edge", """WITH x AS (SELECT DISTINCT r.rec_id, r.source, r.item_id, e.x.item_id AS neighbour, e.x.score AS score FROM recommendations r, unnest(r.loved_with) AS e(x))
  SELECT item_id, neighbour, max(score) AS score, count(DISTINCT source) AS sources FROM x WHERE neighbour IS NOT NULL AND score IS NOT NULL GROUP BY 1, 2""")
def best_edge(spark: SparkSession, folder: str) -> DataFrame:
    """The best score of every pair over all sources of edges."""
    shown = table(spark, folder, "recommendations").select("source", "item_id", F.explode("loved_with").alias("x"))
    edges = shown.select("source", "item_id", F.col("x.item_id").alias("neighbour"), F.col("x.score").alias("score")).filter("neighbour is not null and score is not null")
    return edges.groupBy("item_id", "neighbour").agg(F.max("score").alias("score"), F.countDistinct("source").alias("sources"))


_WEIGHT = "CASE event_type WHEN 'purchase' THEN 1.0 WHEN 'signup' THEN 0.5 WHEN 'view' THEN 0.3 WHEN 'click' THEN 0.2 WHEN 'error' THEN -1.0 END::DOUBLE"
_SIGNAL = "WITH " + EVENTS_SQL + f""", w AS (SELECT user_id, item, {_WEIGHT} AS base, greatest(date_diff('day', ts::DATE, (SELECT max(ts)::DATE FROM ev)), 0) AS age,
  count(*) FILTER (event_type = 'purchase') OVER (PARTITION BY user_id, item) AS bought, event_type FROM ev),
 signal AS (SELECT user_id, item, round(sum(base * CASE WHEN event_type = 'purchase' AND bought > 1 THEN 1.5 ELSE 1 END * pow(0.5::DOUBLE, age / CASE WHEN abs(base) >= 1 THEN 720.0 ELSE 180.0 END::DOUBLE)), 6) AS weight FROM w GROUP BY 1, 2)
"""


def _signals(spark: SparkSession, folder: str) -> DataFrame:
    """(user_id, item, weight): signals decayed by age, completions repeated weigh more, strong ones last longer."""
    own = events(spark, folder)
    last = own.agg(F.max("ts").alias("as_of"))  # one row
    kinds = {"purchase": 1.0, "signup": 0.5, "view": 0.3, "click": 0.2, "error": -1.0}
    base = F.lit(None).cast("double")
    for kind, weight in kinds.items():
        base = F.when(F.col("event_type") == kind, weight).otherwise(base)
    bought = own.groupBy("user_id", "item").agg(F.count(F.when(F.col("event_type") == "purchase", 1)).alias("bought"))
    w = own.join(bought, ["user_id", "item"]).join(F.broadcast(last)).withColumn("base", base)
    again = F.when((F.col("event_type") == "purchase") & (F.col("bought") > 1), 1.5).otherwise(1.0)
    fade = F.pow(F.lit(0.5), C.age_days(F.col("ts"), F.col("as_of")) / F.when(F.abs("base") >= 1, 720.0).otherwise(180.0))
    return w.groupBy("user_id", "item").agg(F.round(F.sum(F.col("base") * again * fade), 6).alias("weight"))


@query("op_a10_signal_weights", _SIGNAL + "SELECT user_id, item, weight FROM signal")
def signal_weights(spark: SparkSession, folder: str) -> DataFrame:
    return _signals(spark, folder)


@query("op_a09_taste_axes", _SIGNAL + """, x AS (SELECT user_id, p_type AS axis, sum(greatest(weight, 0)) AS w FROM signal JOIN part ON p_partkey = item GROUP BY 1, 2)
  SELECT user_id, axis, round(w / nullif(sum(w) OVER (PARTITION BY user_id), 0), 6) AS share FROM x""")
def taste_axes(spark: SparkSession, folder: str) -> DataFrame:
    """Shares of every user's weight by kind of thing."""
    kinds = table(spark, folder, "part").select(F.col("p_partkey").alias("item"), F.col("p_type").alias("axis"))
    sums = _signals(spark, folder).join(kinds, "item").groupBy("user_id", "axis").agg(F.sum(F.greatest("weight", F.lit(0.0))).alias("w"))
    return sums.select("user_id", "axis", F.round(F.try_divide("w", F.sum("w").over(Window.partitionBy("user_id"))), 6).alias("share"))


_OUTCOME = "WITH " + EVENTS_SQL + """, o AS (SELECT item % 6 AS arm, CASE WHEN hour(ts) BETWEEN 5 AND 16 THEN 'day' WHEN hour(ts) BETWEEN 17 AND 22 THEN 'evening' ELSE 'late' END AS context, event_type = 'purchase' AS success,
  greatest(date_diff('day', ts::DATE, (SELECT max(ts)::DATE FROM ev)), 0) AS age FROM ev WHERE event_type IN ('purchase', 'view', 'error')),
 b AS (SELECT arm, context, round(sum(CASE WHEN success THEN pow(0.5::DOUBLE, age / 60.0::DOUBLE) ELSE 0 END), 6) AS good, round(sum(CASE WHEN NOT success THEN pow(0.5::DOUBLE, age / 60.0::DOUBLE) ELSE 0 END), 6) AS bad FROM o GROUP BY 1, 2)
"""


def _beliefs(spark: SparkSession, folder: str) -> DataFrame:
    own = events(spark, folder)
    last = own.agg(F.max("ts").alias("as_of"))
    hour = F.hour("ts")
    context = F.when(hour.between(5, 16), "day").when(hour.between(17, 22), "evening").otherwise("late")
    out = own.filter(F.col("event_type").isin("purchase", "view", "error")).join(F.broadcast(last))
    return C.beliefs(out.select((F.col("item") % 6).alias("arm"), context.alias("context"), (F.col("event_type") == "purchase").alias("success"), C.age_days(F.col("ts"), F.col("as_of")).alias("age")))


@query("op_a12_beliefs", _OUTCOME + "SELECT arm, context, good, bad FROM b")
def bandit_beliefs(spark: SparkSession, folder: str) -> DataFrame:
    return _beliefs(spark, folder)


@query("op_r20_borrowed_beliefs", _OUTCOME + """, d AS (SELECT arm, context, CAST(good AS DECIMAL(18,6)) AS good, CAST(bad AS DECIMAL(18,6)) AS bad FROM b)
  SELECT arm, context, round(1 + good + CAST(0.3 AS DECIMAL(2,1)) * CAST(sum(good) OVER (PARTITION BY arm) - good AS DECIMAL(18,6)), 6)::DOUBLE AS alpha, round(1 + bad + CAST(0.3 AS DECIMAL(2,1)) * CAST(sum(bad) OVER (PARTITION BY arm) - bad AS DECIMAL(18,6)), 6)::DOUBLE AS beta FROM d""")
def borrowed(spark: SparkSession, folder: str) -> DataFrame:
    return C.borrowed_beliefs(_beliefs(spark, folder))


@query("op_r22_allocation")
def allocation(spark: SparkSession, folder: str) -> DataFrame:
    """Places of every arm in each context, by Thompson sampling; a context has as many rows as there are arms."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("arm")
        return rows[["context", "arm"]].assign(places=C.allocate(rows["alpha"].tolist(), rows["beta"].tolist(), 20, seed=len(rows["context"].iloc[0])))

    return borrowed(spark, folder).groupBy("context").applyInPandas(run, "context string, arm bigint, places int")


_METRICS_SQL = """, h AS (SELECT t."user", rank FROM test t LEFT JOIN top USING ("user", item)),
  u AS (SELECT "user", count(*) AS n, count(rank) AS hit, sum(1 / log2(rank + 1)) AS dcg, max(1.0::DOUBLE / rank) AS rr FROM h GROUP BY 1),
  i AS (SELECT *, (SELECT sum(1 / log2(k + 1)) FROM range(1, 21) x(k) WHERE k <= n) AS ideal FROM u)
  SELECT count(*) AS users, round(avg(hit / least(n, 20)), 6) AS recall, round(avg(coalesce(dcg, 0) / ideal), 6) AS ndcg, round(avg(coalesce(rr, 0)), 6) AS mrr FROM i"""
_NOVELTY_SQL = """, pop AS (SELECT item, count(*)::DOUBLE / (SELECT count(DISTINCT "user") FROM train) AS p FROM train GROUP BY 1)
  SELECT count(DISTINCT item) AS items, round(avg(-log2(p)), 6) AS novelty FROM top JOIN pop USING (item)"""


def _metrics(top: DataFrame, test: DataFrame) -> DataFrame:
    hits = test.join(top.select("user", "item", "rank"), ["user", "item"], "left")
    gain = lambda r: 1 / F.log2(r + 1)
    each = hits.groupBy("user").agg(
        F.count(F.lit(1)).alias("n"), F.count("rank").alias("hit"), F.coalesce(F.sum(gain(F.col("rank"))), F.lit(0.0)).alias("dcg"), F.coalesce(F.max(1 / F.col("rank")), F.lit(0.0)).alias("rr")
    )
    places = F.least("n", F.lit(20))
    ideal = F.aggregate(F.sequence(F.lit(1), places.cast("int")), F.lit(0.0), lambda s, k: s + gain(k))
    return each.agg(
        F.count(F.lit(1)).alias("users"), F.round(F.avg(F.col("hit") / places), 6).alias("recall"), F.round(F.avg(F.col("dcg") / ideal), 6).alias("ndcg"), F.round(F.avg("rr"), 6).alias("mrr")
    )


def _novelty(top: DataFrame, train: DataFrame) -> DataFrame:
    users = train.select("user").distinct().agg(F.count(F.lit(1)).alias("users"))
    pop = train.groupBy("item").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(users)).select("item", (F.col("n") / F.col("users")).alias("p"))
    return top.join(pop, "item").agg(F.countDistinct("item").alias("items"), F.round(F.avg(-F.log2("p")), 6).alias("novelty"))


_HELD_OUT = _LIKED + """, test AS (SELECT "user", item FROM liked WHERE ("user" + item) % 5 = 0),
 tl AS (SELECT DISTINCT "user", item FROM rating WHERE stars >= 4 AND ("user" + item) % 5 <> 0), tk AS (SELECT item FROM tl GROUP BY 1 HAVING count(*) >= 5), ts AS (SELECT * FROM tl SEMI JOIN tk USING (item)),
 train AS (SELECT "user", item, 1 / ln(exp(1.0::DOUBLE) + count(*) OVER (PARTITION BY "user")) AS w FROM ts),
 tt AS (SELECT a.item AS i, b.item AS j, sum(a.w) AS t FROM train a JOIN train b ON a."user" = b."user" AND a.item <> b.item GROUP BY 1, 2), tm AS (SELECT item, sum(w) AS m FROM train GROUP BY 1),
 tsc AS (SELECT i AS item, j AS neighbour, round(t / (pow(x.m, 1 - 0.65::DOUBLE) * pow(y.m, 0.65::DOUBLE)), 6) AS score FROM tt JOIN tm x ON x.item = i JOIN tm y ON y.item = j),
 tedge AS (SELECT item, neighbour, score FROM tsc QUALIFY row_number() OVER (PARTITION BY item ORDER BY score DESC, neighbour) <= 50),
 f AS (SELECT "user", neighbour AS item, round(sum(score), 6) AS score FROM train JOIN tedge USING (item) GROUP BY 1, 2),
 top AS (SELECT "user", item, CAST(row_number() OVER (PARTITION BY "user" ORDER BY score DESC, item) AS INT) AS rank FROM f ANTI JOIN train USING ("user", item) QUALIFY rank <= 20)
"""


def _held_out_split(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Recommendations from four fifths of the likes, of which weights, support and item graph are made too, and the held-out fifth."""
    rated = ratings(spark, folder)
    held = (F.col("user") + F.col("item")) % 5 == 0
    train = materialize(C.likes(rated.filter(~held)), "train")
    return C.recommend(train, materialize(C.item_neighbours(train), "edges"), 20), C.likes(rated).filter(held).select("user", "item"), train


@query("op_m01_ranking_metrics", _HELD_OUT + _METRICS_SQL)
def ranking_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """Recall, nDCG and mean reciprocal rank at 20 over all users with held-out likes, none of which is in the item graph."""
    top, test, _ = _held_out_split(spark, folder)
    return _metrics(top, test)


@query("op_m02_novelty_coverage", _HELD_OUT + _NOVELTY_SQL)
def novelty(spark: SparkSession, folder: str) -> DataFrame:
    """How many items are recommended at all, and their mean surprise in bits."""
    top, _, train = _held_out_split(spark, folder)
    return _novelty(top, train)


QUERIES, ORACLES = _r.queries, _r.oracles
