"""Items that appear together: pair counts over baskets, with lift and conviction.

Identical baskets are collapsed into one weighted row first, so a basket that occurs a million times is enumerated once.
Pairs are generated from each distinct basket by two streaming generators (no array of all pairs exists at any time), and
their weights are summed map-side before the only shuffle by pair; items too rare for any wanted pair are left out before.
A long basket is enumerated in blocks by several tasks. A popular item is no hot key: no exchange is keyed by
one item except the per-item count, whose partial aggregation leaves one row per task and item.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.storage import materialize

#: Items from which on a basket is cut into blocks of first items. Frequent items up to which pairs are filtered by a broadcast.
LONG, BLOCK, BROADCAST_ITEMS = 2000, 200, 2_000_000


def basket(ids: Column) -> Column:
    """Sorted distinct non-null elements of an array; null for a null array."""
    return F.sort_array(F.array_distinct(F.filter(ids, lambda x: x.isNotNull())))


def collapse_baskets(records: DataFrame, key: str, ids: Column) -> DataFrame:
    """(items array, weight bigint): distinct non-empty baskets and in how many distinct records they stand.

    Records delivered again under one key count once; should their contents differ, the largest basket in array order is
    taken, so that the result doesn't depend on arrival. Records with a null key, a null list or no usable element have no
    basket.
    """
    # the greatest array of a record is found by sorting; equal baskets are then grouped by hash
    rows = records.select(F.col(key).alias("_key"), basket(ids).alias("items"))
    rows = rows.filter(F.col("_key").isNotNull() & (F.size("items") > 0))
    one = rows.groupBy("_key").agg(F.max("items").alias("items"))
    return one.groupBy("items").agg(F.count(F.lit(1)).alias("weight"))


def item_counts(baskets: DataFrame) -> DataFrame:
    """(item, n_item): summed weight of the baskets that hold the item."""
    return baskets.select(F.explode("items").alias("item"), "weight").groupBy("item").agg(F.sum("weight").alias("n_item"))


def pair_counts(baskets: DataFrame, among: DataFrame | None = None) -> DataFrame:
    """(item_a, item_b, n_ab) for all pairs a < b within any basket; with `among` (item) only of items that are in it, which
    must be few enough to be broadcast."""
    several = baskets.filter(F.size("items") > 1)
    short = several.filter(F.size("items") <= LONG).select("weight", "items", F.posexplode("items").alias("at", "item_a"))
    blocks = several.filter(F.size("items") > LONG).select("weight", "items", F.explode(F.sequence(F.lit(0), F.size("items") - 2, F.lit(BLOCK))).alias("block"))
    blocks = blocks.repartition(F.xxhash64("items"), F.col("block"))
    long = blocks.select("weight", "items", "block", F.posexplode(F.slice("items", F.col("block") + 1, F.lit(BLOCK))).alias("n", "item_a"))
    first = short.unionByName(long.select("weight", "items", (F.col("block") + F.col("n")).alias("at"), "item_a"))
    if among is not None:
        first = first.join(F.broadcast(among.select(F.col("item").alias("item_a"))), "item_a", "left_semi")
    rest = F.slice("items", F.col("at") + 2, F.size("items"))
    pairs = first.filter(F.col("at") + 1 < F.size("items")).select("item_a", "weight", F.explode(rest).alias("item_b"))
    if among is not None:
        pairs = pairs.join(F.broadcast(among.select(F.col("item").alias("item_b"))), "item_b", "left_semi")
    return pairs.groupBy("item_a", "item_b").agg(F.sum("weight").alias("n_ab"))


def associated_pairs(records: DataFrame, key: str, ids: Column, min_together: int = 1, min_lift: float = 0.0) -> DataFrame:
    """Pairs of items in one record: item_a, item_b, n_ab, n_a, n_b, n, lift, conviction, conviction_back.

    n counts records with a basket. lift = n_ab * n / (n_a * n_b) is compared with min_lift in exact decimals.
    conviction of a => b is (1 - n_b / n) / (1 - n_ab / n_a), null where a never stands without b; conviction_back is that of
    b => a. Empty input gives no rows.
    """
    baskets = materialize(collapse_baskets(records, key, ids), "baskets")
    often = materialize(item_counts(baskets).filter(F.col("n_item") >= min_together), "frequent-items")
    few = min_together > 1 and often.count() <= BROADCAST_ITEMS
    pairs = pair_counts(baskets, often if few else None).filter(F.col("n_ab") >= min_together)
    total = baskets.agg(F.sum("weight").alias("n"))  # one row
    joined = (
        pairs.join(often.select(F.col("item").alias("item_a"), F.col("n_item").alias("n_a")), "item_a")
        .join(often.select(F.col("item").alias("item_b"), F.col("n_item").alias("n_b")), "item_b")
        .join(F.broadcast(total))  # a single row by construction
    )
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    enough = wide("n_ab") * wide("n") >= F.lit(str(min_lift)).cast("decimal(12,4)") * (wide("n_a") * wide("n_b")).cast("decimal(38,0)").cast("decimal(26,0)")
    a, b, ab, n = (F.col(c).cast("double") for c in ("n_a", "n_b", "n_ab", "n"))
    return joined.filter(enough).select(
        "item_a", "item_b", "n_ab", "n_a", "n_b", "n",
        (ab * n / (a * b)).alias("lift"),
        F.when(F.col("n_ab") < F.col("n_a"), (1 - b / n) / (1 - ab / a)).alias("conviction"),
        F.when(F.col("n_ab") < F.col("n_b"), (1 - a / n) / (1 - ab / b)).alias("conviction_back"),
    )
