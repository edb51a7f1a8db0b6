import pytest
from lumenframe.operators import search
from lumenframe.plans.registry import QUERIES


@pytest.mark.parametrize("name", ["op_k03_bm25", "op_k04_trigram", "op_k05_tiers", "op_k06_fusion"])
def test_alternative_names_are_found(spark, tmp_path, name):
    items = [(1, "tt1", "Umi no Kaze", ["Wind over Water", None], "Drama", 1990, 90, 5), (2, "tt2", "Kigubo", None, None, None, None, None), (3, "tt3", "Wind over Water", [], None, 1991, 100, 7)]
    shape = "item_id bigint, imdb_id string, title string, alternative_titles array<string>, genres string, year int, runtime_minutes int, votes bigint"
    spark.createDataFrame(items, shape).write.parquet(f"{tmp_path}/media_items.parquet")
    spark.createDataFrame([(7, "Wind over Water", None, None)], "anilist_id bigint, english_title string, year int, minutes int").write.parquet(f"{tmp_path}/anime_entries.parquet")
    spark.createDataFrame([(1, "tt2", "synopsis", "A story")], "doc_id bigint, imdb_id string, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES[name](spark, str(tmp_path)).collect()
    assert {r.item_id for r in got} == {1, 3} and len(got) == 2


def test_rare_pieces_find_all_that_share_enough(spark):
    import math
    import random
    from collections import Counter

    r = random.Random(4)
    names = [(i, "".join(r.choice("abcd ") for _ in range(r.randrange(0, 14)))) for i in range(120)]
    asked = [(i, "".join(r.choice("abcd ") for _ in range(r.randrange(0, 10)))) for i in range(40)]
    posts = search.gram_postings(spark.createDataFrame(names, "id int, name string"), "id", "name")
    got = {(x.query, x.id) for x in search.fuzzy(posts, "id", spark.createDataFrame(asked, "query int, q string"), "query", "q", 1000).collect()}
    cut = lambda t: Counter(t[i : i + 3] for i in range(len(t) - 2))
    want = {(q, i) for q, t in asked if len(t) >= 4 for i, n in names if (g := set(cut(t))) and len(g & set(cut(n))) >= math.ceil(round(len(g) * 0.3, 9))}
    assert got == want and want


@pytest.mark.parametrize("block", [7, 1_000_000])
def test_search_moves_results_not_hits(spark, monkeypatch, block):
    """What is shuffled after the postings are written are k results a query at most, and blocks don't change them."""
    monkeypatch.setattr(search, "BLOCK_POSTINGS", block)
    docs = spark.createDataFrame([(i, f"alpha w{i % 3} x{i % 5} tail{i}") for i in range(60)], "id bigint, name string")
    asked = spark.createDataFrame([(q, f"alpha w{q % 3}") for q in range(9)] + [(0, "alpha x1"), (20, "alpha none"), (21, None)], "query bigint, q string")
    got = {}
    ranked = search.bm25(search.postings(docs, "id", {"name": 1}), "id", asked, "query", "q", 4)
    for r in ranked.orderBy("query", "rank").collect():
        got.setdefault(r.query, []).append(r.id)
    assert got == {0: [6, 21, 36, 51]} | {q: [i for i in range(60) if i % 3 == q % 3][:4] for q in range(1, 9)}
    found = search.fuzzy(search.gram_postings(docs, "id", "name"), "id", asked, "query", "q", 3)
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString() and found.groupBy("query").count().agg({"count": "max"}).first()[0] == 3


def test_limits_take_the_most_voted(spark):
    rows = [(i, None if i % 11 == 0 else 1980 + i % 25, None if i % 7 == 0 else 60 + i % 90, None if i % 5 == 0 else i % 13) for i in range(400)]
    titles = spark.createDataFrame(rows, "id bigint, year int, minutes int, votes bigint")
    limits = [(1985, 1991, None, None), (None, None, 100, None), (1990, None, None, 80), (None, 1984, 70, 120), (2001, 1999, None, None), (None, None, None, None)]
    asked = spark.createDataFrame([(q, *x) for q, x in enumerate(limits)], "query int, year_from int, year_to int, least_minutes int, most_minutes int")
    got = {}
    for r in search.filtered(titles, "id", asked, 6).orderBy("query", "rank").collect():
        got.setdefault(r.query, []).append(r.id)
    fits = lambda x, low, high: low is None and high is None or x is not None and (low is None or x >= low) and (high is None or x <= high)
    want = {q: [r[0] for r in sorted(rows, key=lambda r: (r[3] is None, -(r[3] or 0), r[0])) if fits(r[1], *x[:2]) and fits(r[2], *x[2:])][:6] for q, x in enumerate(limits[:4])}
    assert got == want
