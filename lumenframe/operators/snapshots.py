"""What changed between full snapshots, by invertible Bloom lookup tables.

Each snapshot of a source is reduced to one row per key and cut into hash buckets of the key. Every bucket of every
snapshot becomes a small table of cells (count and xors of key hashes, row hashes and their checks); the table of a
snapshot less that of the one before holds only the rows that differ, whose (key hash, row hash) pairs are peeled out of
it. What is compared between snapshots thus grows with the number of changes, not of rows: unchanged rows cancel.

A bucket with more differences than its cells can hold doesn't peel to nothing; it is built again with more cells, and what
is unsolved after the last size is compared exactly, by an aggregation over its rows. Every solved bucket is verified
against digests kept beside the cells. At the end the recovered key hashes are looked up in the rows of both snapshots, so
that only rows that truly differ are classified.

Rows are spread by source and bucket, so a source that holds a third of all rows is spread as well.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenframe.storage import materialize

HASHES = 3
#: Cells per bucket in each round; n cells hold about 0.7 n differing rows.
SIZES = (384, 1536, 12288)
BUCKET_ROWS = 4096
#: Largest number of sources whose bucket counts are broadcast (a few MB); beyond it the join shuffles.
BROADCAST_SOURCES = 50_000

_MASK = (1 << 64) - 1
_P1, _P2, _P3, _P4, _P5 = 0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5


def xxh64_long(value: int, seed: int) -> int:
    """XXH64 of one 8-byte integer, as the SQL function xxhash64 computes it; unsigned."""
    rotate = lambda x, r: ((x << r) | (x >> (64 - r))) & _MASK
    h = (seed + _P5 + 8) & _MASK
    h ^= rotate(value * _P2 & _MASK, 31) * _P1 & _MASK
    h = (rotate(h, 27) * _P1 + _P4) & _MASK
    h = (h ^ (h >> 33)) * _P2 & _MASK
    h = (h ^ (h >> 29)) * _P3 & _MASK
    return h ^ (h >> 32)


def pair_check(k: int, h: int) -> int:
    """xxhash64(k, h) of two signed longs, signed."""
    c = xxh64_long(h & _MASK, xxh64_long(k & _MASK, 42))
    return c - (1 << 64) if c >> 63 else c


def places(h: int, cells: int) -> list[int]:
    """The cells of a row hash: one in each third of the table."""
    third = cells // HASHES
    return [((h & _MASK) >> (21 * i)) % (1 << 21) % third + i * third for i in range(HASHES)]


def known_rows(rows: DataFrame, source: str, number: str, key: str, values: list[str], extra: list[str], loaded: str) -> DataFrame:
    """source, number, key, loaded, content, extra, k and h of the rows that belong to a snapshot: those with source, number
    and key. k hashes the key, h key and content (null differs from every value)."""
    parts = [x for v in values for x in (F.col(v), F.col(v).isNull())]
    return rows.filter(F.col(source).isNotNull() & F.col(number).isNotNull() & F.col(key).isNotNull()).select(
        F.col(source).alias("source"), F.col(number).cast("bigint").alias("number"), F.col(key).alias("key"), F.col(loaded).alias("loaded"),
        F.struct(*values).alias("content"), F.struct(*(extra or [F.lit(None).cast("string").alias("none")])).alias("extra"),
        F.xxhash64(key).alias("k"), F.xxhash64(key, *parts).alias("h"),
    )


def latest_hashes(known: DataFrame) -> DataFrame:
    """One row per source, snapshot and key: source, number, bucket, k, h, tied.

    Of several versions the one loaded last counts; where several of different content were loaded at that time the row is
    tied, and its h is one of theirs. The buckets of a source follow its rows.
    """
    per_snapshot = known.groupBy("source", "number").agg(F.count(F.lit(1)).alias("n"))
    sizes = per_snapshot.groupBy("source").agg(F.ceil(F.max("n") / BUCKET_ROWS).alias("buckets"))
    if sizes.count() <= BROADCAST_SOURCES:
        sizes = F.broadcast(sizes)
    spread = known.select("source", "number", "key", "loaded", "k", "h").join(sizes, "source")
    spread = spread.withColumn("bucket", F.pmod("k", F.col("buckets"))).drop("buckets").repartition("source", "bucket")
    keys = ["source", "bucket", "number", "key", "k"]
    versions = spread.groupBy(*keys, "loaded").agg(F.max("h").alias("high"), F.min("h").alias("low"))
    # a null time is the earliest; of one key each time stands once, so the last is defined
    last = lambda c: F.coalesce(F.max_by(c, "loaded"), F.max(F.when(F.col("loaded").isNull(), F.col(c))))
    one = versions.groupBy(*keys).agg(last("high").alias("h"), last("low").alias("low"))
    return one.select("source", "number", "bucket", "k", "h", (F.col("h") != F.col("low")).alias("tied"))


def consecutive(rows: DataFrame) -> DataFrame:
    """(source, number, previous, following) of the snapshots delivered; null where there is none."""
    order = Window.partitionBy("source").orderBy("number")
    return rows.select("source", "number").distinct().select(
        "source", "number", F.lag("number").over(order).alias("previous"), F.lead("number").over(order).alias("following")
    )


def _cell(i: int, cells: int) -> Column:
    bits = F.shiftrightunsigned("h", 21 * i).bitwiseAND(F.lit((1 << 21) - 1))
    return F.pmod(bits, F.lit(cells // HASHES)) + i * (cells // HASHES)


def _differences(rows: DataFrame, order: DataFrame, cells: int) -> DataFrame:
    """Subtracted tables: source, number, bucket and its cells that aren't empty, with the digest as cell -1.

    A bucket in which nothing differs has no row; one that differs has the digest of its side counts and row checks.
    """
    at = F.explode(F.array(F.lit(-1).cast("bigint"), *[_cell(i, cells).cast("bigint") for i in range(HASHES)]))
    built = rows.select("source", "number", "bucket", "k", "h", F.xxhash64("k", "h").alias("c"), at.alias("cell"))
    sums = [F.bit_xor(x).alias(x) for x in ("k", "h", "c")]
    built = built.groupBy("source", "number", "bucket", "cell").agg(F.count(F.lit(1)).alias("n"), *sums)
    both = built.join(order, ["source", "number"])
    sides = F.explode(F.array(
        F.struct(F.when(F.col("previous").isNotNull(), F.col("number")).alias("to"), F.col("n").alias("n")),
        F.struct(F.col("following").alias("to"), (-F.col("n")).alias("n")),
    ))
    signed = both.select("source", "bucket", "cell", "k", "h", "c", sides.alias("side")).filter(F.col("side.to").isNotNull())
    less = signed.groupBy("source", F.col("side.to").alias("number"), "bucket", "cell").agg(F.sum("side.n").alias("n"), *sums)
    left = less.filter((F.col("n") != 0) | (F.col("k") != 0) | (F.col("h") != 0) | (F.col("c") != 0))
    return left.groupBy("source", "number", "bucket").agg(F.collect_list(F.struct("cell", "n", "k", "h", "c")).alias("cells"))


def peel(left: list[dict], cells: int) -> list[tuple[int, int, int]] | None:
    """The differing rows (k, h, sign) of a subtracted table, or None if it doesn't peel to nothing or fails its digest."""
    table = {x["cell"]: [x["n"], x["k"], x["h"], x["c"]] for x in left}
    digest = table.pop(-1, [0, 0, 0, 0])
    found: list[tuple[int, int, int]] = []
    todo = list(table)
    while todo:
        n, k, h, c = table.get(todo.pop(), (0, 0, 0, 0))
        if abs(n) != 1 or pair_check(k, h) != c:
            continue
        found.append((k, h, n))
        if len(found) > cells:  # a table can't hold more
            return None
        for p in places(h, cells):
            x = table.setdefault(p, [0, 0, 0, 0])
            table[p] = [x[0] - n, x[1] ^ k, x[2] ^ h, x[3] ^ c]
            todo.append(p)
    for k, h, n in found:
        digest = [digest[0] - n, digest[1] ^ k, digest[2] ^ h, digest[3] ^ pair_check(k, h)]
    return None if any(map(any, table.values())) or any(digest) else found


def _solve(differences: DataFrame, cells: int) -> DataFrame:
    """source, number, bucket, found (array of k, h, sign; null where the bucket failed)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [peel(x, cells) for x in batch["cells"]]
            batch = batch[["source", "number", "bucket"]].copy()
            batch["found"] = [None if f is None else [{"k": k, "h": h, "sign": s} for k, h, s in f] for f in found]
            yield batch

    source = dict(differences.dtypes)["source"]
    return differences.mapInPandas(run, f"source {source}, number bigint, bucket bigint, found array<struct<k: bigint, h: bigint, sign: int>>")


def _classify(known: DataFrame, wanted: DataFrame) -> DataFrame:
    """source, number, key, change, before, after, extra of the wanted (source, number, previous, k) that truly differ.

    The latest version of each side is taken from the rows given: the one loaded last, of several loaded at one time the
    greatest in the order of values.
    """
    sides = F.explode(F.array(F.struct(F.col("number").alias("at"), F.lit(True).alias("new")), F.struct(F.col("previous").alias("at"), F.lit(False).alias("new"))))
    asked = wanted.select("source", F.col("number").alias("to"), "k", sides.alias("s")).select("source", "to", "k", F.col("s.at").alias("number"), "s.new")
    hit = known.join(asked, ["source", "number", "k"]).withColumn("version", F.struct("loaded", "content", "extra"))
    both = hit.groupBy("source", "to", "key").agg(F.max(F.when(F.col("new"), F.col("version"))).alias("new"), F.max(F.when(~F.col("new"), F.col("version"))).alias("old"))
    change = (
        F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed")
        .when(~F.col("new.content").eqNullSafe(F.col("old.content")), "changed")
    )
    return both.select(
        "source", F.col("to").alias("number"), "key", change.alias("change"), F.col("old.content").alias("before"), F.col("new.content").alias("after"),
        F.coalesce("new.extra", "old.extra").alias("extra"),
    ).filter(F.col("change").isNotNull())


def _of(rows: DataFrame, buckets: DataFrame) -> DataFrame:
    """Rows of the given (source, number, bucket), of both snapshots compared."""
    sides = buckets.select("source", "bucket", F.explode(F.array("number", "previous")).alias("number")).distinct()
    return rows.join(sides, ["source", "number", "bucket"], "left_semi")


def snapshot_changes(
    rows: DataFrame, source: str, number: str, key: str, values: list[str], loaded: str, extra: list[str] = [], sizes: tuple[int, ...] = SIZES  # noqa: B006
) -> DataFrame:
    """(source, number, key, change, before, after, extra): what each snapshot added, removed or changed since the last.

    Snapshots of a source are compared in order of number with the one before among those present; the first has no rows.
    change is `added`, `removed` or `changed`, the last when any of values differs (null equals null). before and after hold
    the values, extra other columns of the row. A key that leaves and returns is removed and later added. A table without
    rows gives none; other columns, whatever their names, are ignored; repeated rows and several versions count once.
    """
    known = known_rows(rows, source, number, key, values, extra, loaded)
    kept = materialize(latest_hashes(known), "snapshot-hashes")
    order = materialize(consecutive(kept), "snapshot-order")
    todo, part, found = None, kept, []
    for cells in sizes:
        own = order if todo is None else order.join(todo.select("source", F.col("number")).distinct(), ["source", "number"], "left_semi")
        tables = _differences(part, order, cells)
        tables = tables if todo is None else tables.join(todo.select("source", "number", "bucket"), ["source", "number", "bucket"], "left_semi")
        result = materialize(_solve(tables, cells), f"peeled-{cells}")
        found.append(result.filter(F.col("found").isNotNull()).select("source", "number", F.explode("found.k").alias("k")))
        todo = result.filter(F.col("found").isNull()).join(own, ["source", "number"]).select("source", "number", "previous", "bucket")
        if todo.isEmpty():
            todo = None
            break
        part = materialize(_of(kept, todo), "unsolved-rows")
    # tied rows are judged by their contents in both comparisons they stand in
    tied = kept.filter("tied").join(order, ["source", "number"])
    found.append(tied.select("source", F.explode(F.array("number", "following")).alias("number"), "k"))
    if todo is not None:  # the exact way for buckets that no size could hold: all their keys
        for at in ("number", "previous"):
            at_side = todo.select("source", "bucket", F.col("number").alias("to"), F.col(at).alias("number"))
            found.append(part.join(at_side, ["source", "number", "bucket"]).select("source", F.col("to").alias("number"), "k"))
    wanted = found[0]
    for x in found[1:]:
        wanted = wanted.unionByName(x)
    return _classify(known, wanted.distinct().join(order, ["source", "number"]).filter("previous is not null"))
