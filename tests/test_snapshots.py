import random

import pytest

from lumenframe.operators import snapshots as S

SCHEMA = "m string, no int, id string, kind string, title string, votes bigint, at int, content string, bucket int"


def brute(rows):
    last = {}
    for m, no, i, kind, title, votes, at, *_ in rows:
        if m is None or no is None or i is None:
            continue
        new = (at if at is not None else -1, title is not None, title or "", votes if votes is not None else -1)
        if (m, no, i) not in last or new > last[m, no, i][0]:
            last[m, no, i] = (new, (title, votes))
    out = set()
    for m in {k[0] for k in last}:
        numbers = sorted({k[1] for k in last if k[0] == m})
        for a, b in zip(numbers, numbers[1:]):
            old, new = ({k[2]: v[1] for k, v in last.items() if k[:2] == (m, n)} for n in (a, b))
            out |= {(m, b, i, "added") for i in new.keys() - old.keys()} | {(m, b, i, "removed") for i in old.keys() - new.keys()}
            out |= {(m, b, i, "changed") for i in new.keys() & old.keys() if new[i] != old[i]}
    return out


def dumps(n, seed=1):
    r = random.Random(seed)
    rows = []
    for m in ("a", "b"):
        for no in (1, 2, 5):
            for i in range(n):
                if r.random() < 0.9:
                    rows.append((m, no, f"t{i}", "x", None if r.random() < 0.1 else f"T{i}", r.choice([None, 1, 2]), r.choice([None, 1, 2]), "clash", 3))
    return rows + rows[: n // 2] + [(None, 1, "t1", "x", "T", 1, 1, "", 0), ("a", None, "t1", "x", "T", 1, 1, "", 0), ("a", 1, None, "x", "T", 1, 1, "", 0)]


def changes(spark, rows, **more):
    df = spark.createDataFrame(rows, SCHEMA)
    out = S.snapshot_changes(df, "m", "no", "id", ["title", "votes"], "at", extra=["kind"], **more)
    return {(r.source, r.number, r.key, r.change) for r in out.collect()}


def test_against_brute_force(spark):
    rows = dumps(300)
    assert changes(spark, rows) == brute(rows)


@pytest.mark.parametrize("sizes", [(12, 1536), (12,)])
def test_enlarged_and_exact_ways(spark, sizes):
    rows = dumps(120, 2)
    assert changes(spark, rows, sizes=sizes) == brute(rows)


def test_empty_single_and_unchanged(spark):
    assert changes(spark, []) == set()
    one = [("a", 1, "t", "x", "T", 1, 1, "", 0)]
    assert changes(spark, one) == set()
    assert changes(spark, one + [("a", 2, "t", "x", "T", 1, 9, "", 0)]) == set()
    assert changes(spark, one + [("a", 2, "t", "x", "", 1, 9, "", 0)]) == {("a", 2, "t", "changed")}


def test_long_values(spark):
    rows = [("a", n, "t", "x", "y" * 200_000 + str(n), 1, 1, "", 0) for n in (1, 2)]
    assert changes(spark, rows) == {("a", 2, "t", "changed")}


def test_hash_twin(spark):
    row = spark.sql("SELECT xxhash64(-5L, 77L) AS h").first()
    assert S.pair_check(-5, 77) == row.h


def test_failed_digest_is_no_solution():
    k, h = 5, 9
    cells = [{"cell": c, "n": 1, "k": k, "h": h, "c": S.pair_check(k, h)} for c in S.places(h, 12)]
    assert S.peel(cells, 12) is None
    cells.append({"cell": -1, "n": 1, "k": k, "h": h, "c": S.pair_check(k, h)})
    assert S.peel(cells, 12) == [(k, h, 1)]


def test_versions_of_one_time_and_without_time(spark):
    """Ties of one loading time go to the greatest content, on either side of a comparison; a null time is the earliest."""
    rows = [("a", n, "t", "x", title, 1, at, "", 0) for n, at, title in ((1, 5, "B"), (1, 5, "A"), (2, 5, "B"), (3, 5, "A"), (3, 5, "B"), (4, None, "C"), (4, None, "D"), (5, None, "C"), (5, 1, "D"))]
    assert changes(spark, rows) == {("a", 4, "t", "changed")} == brute(rows)
