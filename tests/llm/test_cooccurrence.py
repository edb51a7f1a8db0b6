import random
from collections import Counter
from itertools import combinations

from pyspark.sql import functions as F

from lumenframe.llm.cooccurrence import associated_pairs

SCHEMA = "rec bigint, loved array<struct<item_id: bigint, score: double>>, items string, weight string, n string"


def run(spark, rows, **more):
    df = spark.createDataFrame([(r, None if x is None else [(i, None) for i in x], "clash", "clash", "clash") for r, x in rows], SCHEMA)
    return {(r.item_a, r.item_b): r for r in associated_pairs(df, "rec", F.col("loved.item_id"), **more).collect()}


def test_against_brute_force(spark):
    r = random.Random(1)
    rows = [(i, r.choice([None, [], [None], [r.randrange(12) for _ in range(r.randrange(1, 7))]])) for i in range(400)]
    got = run(spark, rows + rows[:150], min_together=5, min_lift=1.1)
    one, two, n = Counter(), Counter(), 0
    for _, x in rows:
        s = sorted({i for i in x or [] if i is not None})
        n += bool(s)
        one.update(s)
        two.update(combinations(s, 2))
    want = {p for p, c in two.items() if c >= 5 and c * n >= 1.1 * one[p[0]] * one[p[1]]}
    assert set(got) == want and want
    for (a, b), x in got.items():
        assert (x.n_ab, x.n_a, x.n_b, x.n) == (two[a, b], one[a], one[b], n)
        assert abs(x.lift - two[a, b] * n / (one[a] * one[b])) < 1e-9


def test_conviction_and_ties(spark):
    got = run(spark, [(1, [1, 2]), (2, [1, 2]), (3, [3]), (4, [2, 3])])
    assert got[1, 2].conviction is None and abs(got[2, 3].conviction - (1 - 2 / 4) / (1 - 1 / 3)) < 1e-9


def test_empty_and_very_long_lists(spark):
    assert run(spark, []) == {}
    assert run(spark, [(None, [1, 2]), (1, None), (2, [])]) == {}
    assert len(run(spark, [(1, list(range(1500)) * 2)])) == 1500 * 1499 // 2


def test_long_baskets_are_cut_and_rare_items_left_out(spark, monkeypatch):
    from lumenframe.llm import cooccurrence as C

    r = random.Random(2)
    rows = [(i, [r.randrange(60) for _ in range(r.randrange(1, 40))] + [1000 + i]) for i in range(60)]
    want = {k: (x.n_ab, x.n_a, x.n_b) for k, x in run(spark, rows, min_together=3).items()}
    monkeypatch.setattr(C, "LONG", 5)
    monkeypatch.setattr(C, "BLOCK", 3)
    assert {k: (x.n_ab, x.n_a, x.n_b) for k, x in run(spark, rows, min_together=3).items()} == want
    monkeypatch.setattr(C, "BROADCAST_ITEMS", 0)
    assert {k: (x.n_ab, x.n_a, x.n_b) for k, x in run(spark, rows, min_together=3).items()} == want and want
