"""What profiles may like beyond what they know: candidate pools, scores with reasons, and labels whose truth can be checked.

Modes are clusters of all titles, found once; a profile has weights over them. So nearness is computed per mode and title,
never per profile and title, and a profile's rows come from joins on its few modes.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenframe.operators.relational import top_per_key
from lumenframe.storage import materialize

#: Sizes of a candidate pool: titles per mode and near all modes, loved-with, by makers, popular. Modes of a profile.
PER_MODE, NEAR, LOVED, MADE, POPULAR, MODES = 200, 500, 400, 150, 100, 8
_POSITIONS = 1 + max(NEAR, LOVED, MADE, POPULAR)
#: Weights of a candidate's terms.
WEIGHTS = {"near": 1.0, "loved": 0.5, "people": 0.1, "popular": 0.0, "axes": 0.2, "playable": 0.1}
#: The title at which closeness to a mode ends.
CLOSE_AT = 1000


def closeness(items: DataFrame, centres: DataFrame, cosine: Column) -> DataFrame:
    """(mode, item, cos): likeness of every title to every mode's direction; modes are few, and their table is broadcast by size."""
    return items.crossJoin(centres).select("mode", "item", F.round(cosine, 6).alias("cos"))


def close_enough(close: DataFrame, at: int = CLOSE_AT) -> DataFrame:
    """(mode, item, cos) of the titles as close to a mode as its at-th closest one, or its last."""
    order = Window.partitionBy("mode").orderBy(F.col("cos").desc(), "item")
    placed = close.withColumn("place", F.row_number().over(order))
    bound = placed.filter(F.col("place") <= at).groupBy("mode").agg(F.min("cos").alias("bound"))
    return close.join(bound, "mode").filter("cos >= bound").select("mode", "item", "cos")


def profile_modes(loved: DataFrame, mode_of: DataFrame, most: int = MODES) -> DataFrame:
    """(profile, mode, w, rank): the heaviest modes of each profile by the weight of what it loved."""
    sums = loved.join(mode_of, "item").groupBy("profile", "mode").agg(F.round(F.sum("w"), 6).alias("w"))
    return top_per_key(sums, ["profile"], [F.col("w").desc(), F.col("mode")], most)


def candidate_pool(modes: DataFrame, close: DataFrame, led_to: DataFrame, loved: DataFrame, makers: DataFrame, titles: DataFrame, met: DataFrame) -> DataFrame:
    """(profile, item, list, pos): titles near the modes in turn, loved-with, by the makers of what was loved, and popular; each
    where it is seen first, less what was met.

    modes: profile, mode, rank. close: mode, item, cos. led_to: profile, item, s. loved, met: profile, item. makers: item,
    maker. titles: item, votes.
    """
    parts = int(modes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own_task = lambda df: df.repartition(parts, "profile")  # noqa: E731 - a profile's candidates are made, cut and put together in one task
    place = lambda n, pos: (F.lit(n) * _POSITIONS + F.col(pos)).alias("at")  # noqa: E731 - list and position as one number
    near = materialize(top_per_key(close, ["mode"], [F.col("cos").desc(), F.col("item")], PER_MODE, "place").select("mode", "item", "place"), "near")
    turns = own_task(modes.select("profile", "mode", F.col("rank").alias("turn")))
    by_mode = turns.join(near, "mode").groupBy("profile", "item").agg(F.min(F.col("place").cast("bigint") * (MODES + 1) + F.col("turn")).alias("turn"))
    lists = [top_per_key(by_mode, ["profile"], [F.col("turn"), F.col("item")], NEAR, "pos").select("profile", "item", place(0, "pos"))]
    lists.append(top_per_key(own_task(led_to), ["profile"], [F.col("s").desc(), F.col("item")], LOVED, "pos").select("profile", "item", place(1, "pos")))
    own = loved.join(makers, "item").groupBy("profile", "maker").agg(F.countDistinct("item").alias("n"))
    works = makers.join(titles, "item")
    works = top_per_key(works, ["maker"], [F.col("votes").desc_nulls_last(), F.col("item")], MADE, "place").drop("place")
    made = own_task(own.join(works, "maker").select("profile", "item", "votes", "n")).groupBy("profile", "item", "votes").agg(F.max("n").alias("n"))
    lists.append(top_per_key(made, ["profile"], [F.col("n").desc(), F.col("votes").desc_nulls_last(), F.col("item")], MADE, "pos").select("profile", "item", place(2, "pos")))
    popular = titles.orderBy(F.col("votes").desc_nulls_last(), "item").limit(POPULAR)
    popular = popular.select("item", F.row_number().over(Window.orderBy(F.col("votes").desc_nulls_last(), "item")).alias("pos"))  # POPULAR rows
    lists.append(own_task(modes.select("profile")).distinct().crossJoin(F.broadcast(popular)).select("profile", "item", place(3, "pos")))
    every = own_task(met.select("profile", "item")).withColumn("at", F.lit(-1))
    for x in lists:
        every = every.unionByName(x)
    first = every.groupBy("profile", "item").agg(F.min("at").alias("at")).filter("at >= 0")
    return first.select("profile", "item", F.floor(F.col("at") / _POSITIONS).cast("int").alias("list"), (F.col("at") % _POSITIONS).alias("pos"))


def hybrid_scores(parts: DataFrame) -> DataFrame:
    """(profile, item, score, reason): weighted terms of candidates, and the term that lifts one most over the median candidate.

    parts: profile, item, cos (to the nearest of the profile's modes; null is none), loved, people, popular (each a share of the
    profile's or the whole's greatest, 0 to 1), axes (-1 to 1), playable (0 or 1). The median is the lower middle. Of equal
    lifts the first term in order gives the reason; without a positive lift there is none.
    """
    terms = {"near": F.coalesce((F.col("cos") + 1) / 2, F.lit(0.0)), **{c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in list(WEIGHTS)[1:]}}
    # a trifle more, so that exact halves round alike however they were computed
    own = parts.select("profile", "item", *[F.round(WEIGHTS[c] * x + 1e-12, 9).alias(c) for c, x in terms.items()])
    middle = own.groupBy("profile").agg(*[F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {c})").alias(f"m_{c}") for c in terms])
    both = own.join(middle, "profile")
    lift = {c: F.round(F.col(c) - F.col(f"m_{c}"), 9) for c in terms}
    most = F.greatest(*lift.values())
    reason = F.coalesce(*[F.when((x == most) & (most > 0), c) for c, x in lift.items()])
    return both.select("profile", "item", F.round(sum((F.col(c) for c in terms), F.lit(0.0)), 9).alias("score"), reason.alias("reason"))


def outside_axes(inside: DataFrame, regions: DataFrame, taste: DataFrame) -> DataFrame:
    """(profile, mode, item, region): titles inside a mode of a profile that leave it on exactly one axis, with the first region
    of that axis that is new.

    inside: profile, mode, item. regions: item, axis, region. taste: profile, mode, axis, region of what was loved in the mode; an
    axis of which the mode says nothing can't be left.
    """
    known = taste.select("profile", "mode", "axis").distinct()
    new = inside.join(regions, "item").join(known, ["profile", "mode", "axis"], "left_semi").join(taste, ["profile", "mode", "axis", "region"], "left_anti")
    each = new.groupBy("profile", "mode", "item").agg(F.countDistinct("axis").alias("axes"), F.min("region").alias("region"))
    return each.filter("axes = 1").drop("axes")


def interleave_by_weight(lists: DataFrame, k: int) -> DataFrame:
    """(key, item, place): lists of a key merged by credit: at each step every list earns its share of the weight, the one with
    most credit and something left gives its next item and pays one; items already given are passed over. Ties go to the first
    list.

    lists: key, list, weight, items (array). A key's lists are bounded, as each is cut to 2k items here.
    """
    kinds = dict(lists.dtypes)
    item = kinds["items"][len("array<") : -1]
    pools = lists.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("list", "weight", F.slice("items", 1, 2 * k).alias("items")))).alias("lists"))

    def merged(own: list[dict]) -> list:
        weights = [max(x["weight"] or 0.0, 0.0) for x in own]
        total = sum(weights) or 1.0
        credit, waiting, out = [0.0] * len(own), [list(reversed(x["items"] or [])) for x in own], dict()
        while len(out) < k and any(waiting):
            credit = [c + w / total for c, w in zip(credit, weights)]
            at = max((i for i, x in enumerate(waiting) if x), key=lambda i: (credit[i], -i))
            credit[at] -= 1
            while waiting[at] and len(out) < k:
                if out.setdefault((given := waiting[at].pop()), at) == at and list(out)[-1] == given:
                    break
        return list(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [merged(x) for x in batch.column("lists").to_pylist()]
            at = pa.array([i for i, m in enumerate(made) for _ in m], pa.int64())
            items = pa.array([x for m in made for x in m], batch.schema.field("lists").type.value_type.field("items").type.value_type)
            yield pa.RecordBatch.from_arrays([batch.column("key").take(at), items, pa.array([n for m in made for n in range(1, len(m) + 1)], pa.int32())], ["key", "item", "place"])

    return pools.mapInArrow(run, f"key {kinds['key']}, item {item}, place int")
