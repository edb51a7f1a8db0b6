import random

import pytest

from lumenframe.llm import containers as C
from lumenframe.llm import mixing as X
from lumenframe.llm.tokens import token_counts


def optimum(sizes, capacity):
    """Fewest containers by exhaustive search."""
    best = len(sizes)

    def go(i, free):
        nonlocal best
        if len(free) >= best:
            return
        if i == len(sizes):
            best = len(free)
            return
        for j in range(len(free)):
            if free[j] >= sizes[i]:
                go(i + 1, free[:j] + [free[j] - sizes[i]] + free[j + 1 :])
        go(i + 1, [*free, capacity - sizes[i]])

    go(0, [])
    return best


def test_bin_completion_is_optimal_on_small_blocks():
    r = random.Random(1)
    for _ in range(60):
        sizes = [r.randrange(1, 60) for _ in range(r.randrange(1, 9))]
        packed = C.bin_completion(sizes, 60, branches=5000)
        assert sorted(x for b in packed for x in b) == sorted(sizes) and all(sum(b) <= 60 for b in packed)
        assert len(packed) == optimum(sorted(sizes, reverse=True), 60) >= C.least_bins(sizes, 60)


def test_dominance():
    assert C.dominated([3, 2], [5]) and C.dominated([2], [3]) and not C.dominated([5], [3, 2]) and not C.dominated([4], [4])


def place(spark, rows, capacities):
    df = spark.createDataFrame([(k, t, "clash", 0) for k, t in rows], "key bigint, tokens bigint, kind string, part int")
    return C.fill_containers(df, capacities).collect()


def test_every_token_is_placed_once(spark):
    r = random.Random(2)
    rows = [(i, r.choice([None, 0, 1, 50, 50, 100, 101, 999, r.randrange(1, 400)])) for i in range(1500)]
    out = place(spark, rows, {"small": 100, "large": 1000})
    for kind, capacity in (("small", 100), ("large", 1000)):
        own = [x for x in out if x.kind == kind]
        fill, per = {}, {}
        for x in own:
            fill[x.container] = fill.get(x.container, 0) + x.tokens
            per.setdefault(x.key, []).append((x.part, x.first_token, x.tokens))
        assert all(fill[x.container] == x.fill <= capacity for x in own)
        for k, t in rows:
            parts = sorted(per.get(k, []))
            assert sum(p[2] for p in parts) == (t or 0) and [p[0] for p in parts] == list(range(len(parts))) and len(parts) == -(-(t or 0) // capacity)
            assert all(p[1] == p[0] * capacity for p in parts)
        assert len(fill) <= 1.02 * sum(t or 0 for _, t in rows) / capacity + 1


def test_container_edges(spark):
    assert place(spark, [], {"a": 10}) == []
    with pytest.raises(ValueError):
        place(spark, [(1, 1)], {"a": 0})
    assert len({x.container for x in place(spark, [(i, 10) for i in range(7)], {"a": 10})}) == 7
    assert len(place(spark, [(1, 1_000_000)], {"a": 512})) == -(-1_000_000 // 512)


def test_flight_keeps_totals_and_probabilities():
    r = random.Random(3)
    sizes = [float(r.randrange(1, 500)) for _ in range(60)]
    mean = [0.0] * 60
    for seed in range(300):
        out = X.flight([0.3] * 60, sizes, seed, stop=2)
        assert sum(0 < p < 1 for p in out) <= 2
        assert sum(out) == pytest.approx(18) and sum(p * s for p, s in zip(out, sizes)) == pytest.approx(0.3 * sum(sizes))
        mean = [m + p / 300 for m, p in zip(mean, out)]
    assert all(abs(m - 0.3) < 0.12 for m in mean)
    assert X.flight([0.5] * 4, [7.0] * 4, 1, stop=0).count(1.0) == 2 and X.flight([], [], 1) == []


def test_plan():
    assert X.plan({"a": 100, "b": 100}, {"a": (0.5, 1), "b": (0.5, 2)}) == {"a": 100, "b": 100}
    assert X.plan({"a": 10, "b": 1000}, {"a": (0.5, 3), "b": (0.5, 1)}, total=100) == {"a": 30, "b": 70}
    assert X.plan({"b": 100}, {"a": (0.5, 3), "b": (0.5, 2)}) == {"b": 200} and X.plan({}, {"a": (1.0, 1)}) == {}


def test_mixture_meets_its_targets(spark):
    r = random.Random(4)
    rows = [(i, r.choice(["big"] * 30 + ["mid"] * 5 + ["rare", None, "unused"]), r.choice([None, 0, 10, r.randrange(20, 900)])) for i in range(9000)]
    targets = {"big": (0.6, 1), "mid": (0.3, 2), "rare": (0.1, 4), "absent": (0.0, 1)}
    df = spark.createDataFrame([(*x, 1.0, 1) for x in rows], "key bigint, source string, tokens bigint, chance double, times int")
    used = X.mix(df, targets)
    out = used.collect()
    assert len({x.key for x in out}) == len(out) and {x.source for x in out} == {"big", "mid", "rare"}
    assert all(1 <= x.times <= targets[x.source][1] and x.tokens > 0 for x in out)
    report = {x.source: x for x in X.mixture_report(used, df, targets).collect()}
    for s in ("big", "mid", "rare"):
        assert report[s].share == pytest.approx(targets[s][0], abs=0.003)
    assert report["absent"].tokens_used == 0
    assert sorted(map(tuple, out)) == sorted(map(tuple, X.mix(df, targets).collect()))


def test_mixture_edges(spark):
    none = spark.createDataFrame([], "key bigint, source string, tokens bigint")
    assert X.mix(none, {"a": (1.0, 2)}).count() == 0
    one = spark.createDataFrame([(1, "a", 5)], "key bigint, source string, tokens bigint")
    assert X.mix(one, {"a": (1.0, 2)}).first().times == 2 and X.mix(one, {}).count() == 0


def test_tokens_of_whole_texts(spark):
    rows = [(1, None), (2, ""), (3, "hello world"), (4, "naïve ﷺ 漢字 \N{GRINNING FACE}"), (5, "word " * 200_000), (3, "hello world")]
    df = spark.createDataFrame(rows, "id bigint, text string")
    got = sorted((r.key, r.tokens) for r in token_counts(df, "id", "text").collect())
    assert got[:3] == [(2, 0), (3, 2), (3, 2)] and got[-1] == (5, 200_001)
