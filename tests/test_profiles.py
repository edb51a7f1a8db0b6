import duckdb
import numpy as np
import pytest
from lumenframe.operators import profiles as P
from lumenframe.operators import recommend as C
from lumenframe.operators.relational import top_per_key
from lumenframe.plans.discovery_queries import _Gathered
from lumenframe.plans.registry import ORACLES, QUERIES
from pyspark.sql import Window
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Titles without id, name, year or votes; leads and loves outside the catalogue; profiles without modes or leads; a null mode."""
    path = tmp_path_factory.mktemp("profiles")
    genres = ["Drama", "War, Drama", None, "", "Animation,Comedy , War", "Comedy"]
    items = [(i, None if i % 13 == 0 else f"tt{i}", None if i % 17 == 0 else f"The {'abcdefgh'[i % 8]}x {i}: part", None if i % 11 == 0 else 1950 + i * 7 % 70, 70, None if i % 9 == 0 else 60, None if i % 7 == 0 else i * 31 % 90, genres[i % 6]) for i in range(1, 160)]
    items.append((None, "tt1", "The ax lost", 1990, 80, 80, 1000, "Drama"))
    spark.createDataFrame(items, "item_id bigint, imdb_id string, title string, year int, runtime_minutes int, rating int, votes bigint, genres string").write.parquet(f"{path}/media_items.parquet")
    vectors = [(v, [float((v * 5 + k * 3) % 7 - 2 + 4 * (k == v % 4)) for k in range(4)], None if v == 11 else v % 4) for v in range(12)]
    spark.createDataFrame(vectors, "vec_id bigint, embedding array<float>, label int").write.parquet(f"{path}/embeddings.parquet")
    loved = lambda p, r: [(1 + (p * 37 + r * 11 + k * 23) % 170, round(0.1 + (p + r + k) % 9 / 10, 2)) for k in range(r % 4 + 1)]
    shown = [(p * 100 + r, p, None if r == 5 else (p * 53 + r * 29) % 200, loved(p, r)) for p in range(30) for r in range(p % 7 + 1)]
    shown += [(5000, 90, 3, [(900, 0.5)]), (5001, None, 3, [(4, 0.5)]), (5002, 91, 901, [(5, 0.5), (None, 0.7)]), (5003, 92, 6, None)]
    spark.createDataFrame(shown, "rec_id bigint, profile_id bigint, item_id bigint, loved_with array<struct<item_id: bigint, score: double>>").write.parquet(f"{path}/recommendations.parquet")
    spark.createDataFrame([(i, f"tt{i}") for i in range(0, 160, 3)], "doc_id bigint, imdb_id string").write.parquet(f"{path}/documents.parquet")
    return str(path)


def same_as_twin(df, folder, name):
    con = duckdb.connect()
    for t in ("media_items", "embeddings", "recommendations", "documents"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    want = con.execute(ORACLES[name]).fetchall()
    columns = [x[0] for x in con.description]
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in df.select(*columns).collect()) and want


def joins(df):
    """What is joined after the intermediate tables are written."""
    return [x for x in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Join" in x]


def test_scores_are_made_in_one_task_a_profile(spark, folder):
    df = QUERIES["op_r07_hybrid_score"](spark, folder)
    same_as_twin(df, folder, "op_r07_hybrid_score")
    same_as_twin(QUERIES["op_r05_candidate_pool"](spark, folder), folder, "op_r05_candidate_pool")
    assert not joins(df)


@pytest.mark.parametrize("batch", ["3", "10000"])
def test_profiles_go_on_over_batches(spark, folder, batch):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        same_as_twin(QUERIES["op_r07_hybrid_score"](spark, folder), folder, "op_r07_hybrid_score")
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_rails_choose_from_the_best_candidates(spark, folder):
    """The same rails as from the candidates in a table of their own."""
    g = _Gathered(spark, folder)
    best = top_per_key(QUERIES["op_r07_hybrid_score"](spark, folder), ["profile"], [F.col("score").desc(), F.col("item")], 60)
    own = g.vectors.select("vec_id", F.col("v").alias("vector"), "mode")
    pool = best.join(g.titles.select("item", "year", F.pmod("item", F.lit(12)).alias("vec_id")).join(own, "vec_id"), "item").join(g.makers, "item", "left")
    quota = C.quotas(g.modes, ["profile"], "mode", "w", 10).select("profile", "mode", "places")
    nth = F.row_number().over(Window.partitionBy("profile", "mode").orderBy("rank"))
    inside = pool.withColumn("n", nth).join(quota, ["profile", "mode"], "left").filter(F.col("n") <= 3 * F.coalesce("places", F.lit(1)))
    want = C.rail(inside.select("profile", "item", "score", "vector", F.col("maker").alias("franchise"), "year"), 10, {"franchise": 2, "year": 5})
    df = QUERIES["op_r08_rails"](spark, folder)
    assert sorted(map(tuple, df.collect())) == sorted(map(tuple, want.select(*df.columns).collect()))
    assert len(joins(df)) == 1  # of the quotas, a few rows a profile


def test_stretch_is_found_in_one_task_a_profile(spark, folder):
    df = QUERIES["op_r11_stretch"](spark, folder)
    same_as_twin(df, folder, "op_r11_stretch")
    assert not joins(df)


def test_labels_are_judged_where_they_are_made(spark, folder):
    df = QUERIES["op_r10_labels"](spark, folder)
    same_as_twin(df, folder, "op_r10_labels")
    assert not joins(df)


def test_untrue_labels_are_counted(spark, folder):
    t = P._Titles(_Gathered(spark, folder).by_profile()[1])
    loved = np.array([np.flatnonzero((t.mode == 0) & (t.decade < t.R))[0]])
    none = np.zeros(0, int)
    space = {"loved": np.zeros(t.n + 1, bool)}
    own = P._Profile(t, space, (loved, np.ones(1)), (none, none, none), (np.array([0]), np.ones(1), np.ones(1, int)))
    ((mode, given, regions),) = own.stretch(10)
    assert len(given) and own.untrue(mode, given, regions) == 0
    assert own.untrue(mode, given, np.repeat(t.decade[loved], len(given))) == len(given)  # a region of what was loved
    t.known[given] = False
    assert own.untrue(mode, given, regions) == len(given)
