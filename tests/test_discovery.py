from lumenframe.operators import discovery as D


def test_interleave_by_weight(spark):
    rows = [("a", 0, 3.0, [1, 2, 3, 4]), ("a", 1, 1.0, [2, 9]), ("b", 0, 0.0, []), ("c", 0, None, [5, 5, 6]), ("d", 0, 1.0, [1]), ("d", 1, 1.0, [7])]
    df = spark.createDataFrame(rows, "key string, list int, weight double, items array<int>")
    got = {}
    for r in sorted(D.interleave_by_weight(df, 5).collect(), key=lambda r: (r.key, r.place)):
        got.setdefault(r.key, []).append(r.item)
    assert got == {"a": [1, 2, 9, 3, 4], "c": [5, 6], "d": [1, 7]}


def test_outside_on_one_axis(spark):
    inside = spark.createDataFrame([(1, 0, i) for i in (10, 11, 12, 13)], "profile int, mode int, item int")
    regions = spark.createDataFrame([(10, "decade", "1990"), (10, "genre", "Drama"), (11, "decade", "1980"), (11, "genre", "Drama"), (12, "decade", "1980"), (12, "genre", "War"), (13, "genre", "War"), (13, "genre", "Animation")], "item int, axis string, region string")
    taste = spark.createDataFrame([(1, 0, "decade", "1990"), (1, 0, "genre", "Drama")], "profile int, mode int, axis string, region string")
    assert {(r.item, r.region) for r in D.outside_axes(inside, regions, taste).collect()} == {(11, "1980"), (13, "Animation")}
    assert D.outside_axes(inside, regions, taste.filter("axis = 'decade'")).count() == 2


def test_reasons(spark):
    rows = [(1, 1, 0.9, 0.0, 0.0, 0.0, 0.0, 0), (1, 2, 0.1, 1.0, 0.0, 0.0, 0.0, 0), (1, 3, None, None, None, None, None, None), (2, 1, 0.5, 0.0, 0.0, 0.0, 0.0, 0)]
    df = spark.createDataFrame(rows, "profile int, item int, cos double, loved double, people double, popular double, axes double, playable int")
    got = {(r.profile, r.item): (round(r.score, 4), r.reason) for r in D.hybrid_scores(df).collect()}
    assert got == {(1, 1): (0.95, "near"), (1, 2): (1.05, "loved"), (1, 3): (0.0, None), (2, 1): (0.5 + 0.25, None)}


def test_pool_is_put_together_in_one_task_a_profile(spark):
    """Titles near the modes, by far the most rows, don't travel: only profiles, leads, loves and works do."""
    modes = spark.createDataFrame([(p, m, 1.0, m + 1) for p in (1, 2) for m in range(2)], "profile bigint, mode bigint, w double, rank int")
    close = spark.createDataFrame([(m, i, round(((i * 7 + m * 3) % 50) / 50, 6)) for m in range(2) for i in range(50)], "mode bigint, item bigint, cos double")
    led = spark.createDataFrame([(1, 60, 0.5), (1, 3, 0.9)], "profile bigint, item bigint, s double")
    loved = spark.createDataFrame([(1, 5), (2, 7)], "profile bigint, item bigint")
    makers = spark.createDataFrame([(5, "a"), (70, "a"), (7, None)], "item bigint, maker string").dropna()
    titles = spark.createDataFrame([(i, i % 9) for i in (*range(50), 60, 70)], "item bigint, votes bigint")
    pool = D.candidate_pool(modes, close, led, loved, makers, titles, loved)
    got = {(r.profile, r.item): (r.list, r.pos) for r in pool.collect()}
    assert (1, 5) not in got and (2, 7) not in got and len(got) == 49 + 2 + 51
    assert got[1, 60] == (1, 2) and got[1, 70] == (2, 1) and got[2, 60][0] == got[2, 70][0] == 3
    order = {p: sorted((r for r in got if r[0] == p and got[r][0] == 0), key=got.get) for p in (1, 2)}
    ranks = {m: {i: n for n, i in enumerate(sorted(range(50), key=lambda i: (-((i * 7 + m * 3) % 50), i)))} for m in range(2)}
    want = sorted(range(50), key=lambda i: (*min((ranks[m][i], m) for m in range(2)), i))
    assert [i for _, i in order[2]] == [i for i in want if i != 7]
    exchanges = [x for x in pool._jdf.queryExecution().executedPlan().toString().splitlines() if "hashpartitioning(" in x]
    assert exchanges and not any("hashpartitioning(profile" in x and ", item" in x.split("),")[0] for x in exchanges)
