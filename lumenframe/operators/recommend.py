"""Recommendation: likes, item similarity, scoring, quotas, diversified selection, beliefs and allocation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenframe.functions.scalars import Draws
from lumenframe.operators.relational import top_per_key

ALPHA, NEIGHBOURS = 0.65, 50
HALF_LIFE_BELIEF, BORROWED = 60, 0.3


def likes(ratings: DataFrame, least: float = 4.0, support: int = 5) -> DataFrame:
    """(user, item, w): distinct likes of items with enough of them; w = 1 / ln(e + likes of the user)."""
    liked = ratings.filter(F.col("stars") >= least).select("user", "item").distinct()
    known = liked.groupBy("item").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= support).select("item")
    liked = liked.join(known, "item", "left_semi")
    n = liked.groupBy("user").agg(F.count(F.lit(1)).alias("n"))
    return liked.join(n, "user").select("user", "item", (1 / F.log(F.exp(F.lit(1.0)) + F.col("n"))).alias("w"))


def item_neighbours(liked: DataFrame, k: int = NEIGHBOURS, alpha: float = ALPHA, shrink: float = 0.0) -> DataFrame:
    """(item, neighbour, score, rank) from weighted co-likes: together / (mass_i^(1-a) mass_j^a) * together / (together + shrink).

    A user's items are paired by two generators over the sorted list, each pair once, and summed map-side before the shuffle;
    the mirror image is made from the sums.
    """
    baskets = liked.groupBy("user", "w").agg(F.sort_array(F.collect_list("item")).alias("items"))
    first = baskets.select("w", "items", F.posexplode("items").alias("at", "i")).filter(F.col("at") + 1 < F.size("items"))
    pairs = first.select("i", "w", F.explode(F.slice("items", F.col("at") + 2, F.size("items"))).alias("j"))
    half = pairs.groupBy("i", "j").agg(F.sum("w").alias("together"))
    both = half.select(F.explode(F.array(F.struct("i", "j", "together"), F.struct(F.col("j").alias("i"), F.col("i").alias("j"), "together"))).alias("p")).select("p.*")
    mass = liked.groupBy("item").agg(F.sum("w").alias("mass"))
    scored = both.join(mass.select(F.col("item").alias("i"), F.col("mass").alias("mi")), "i").join(mass.select(F.col("item").alias("j"), F.col("mass").alias("mj")), "j")
    t = F.col("together")
    score = t / (F.pow("mi", F.lit(1 - alpha)) * F.pow("mj", F.lit(alpha))) * t / (t + shrink)
    rows = scored.select(F.col("i").alias("item"), F.col("j").alias("neighbour"), F.round(score, 6).alias("score"))
    return top_per_key(rows, ["item"], [F.col("score").desc(), F.col("neighbour")], k)


def recommend(liked: DataFrame, edges: DataFrame, n: int) -> DataFrame:
    """(user, item, score, rank): sums of the liked items' neighbour scores, liked ones left out."""
    sums = liked.select("user", "item").join(edges, "item").groupBy("user", F.col("neighbour").alias("item")).agg(F.round(F.sum("score"), 6).alias("score"))
    fresh = sums.join(liked.select("user", "item"), ["user", "item"], "left_anti")
    return top_per_key(fresh, ["user"], [F.col("score").desc(), F.col("item")], n)


def typical_scores(edges: DataFrame, n: int) -> DataFrame:
    """(rank, typical): the mean score at each rank."""
    return edges.filter(F.col("rank") <= n).groupBy("rank").agg(F.round(F.avg("score"), 6).alias("typical"))


def age_days(ts: Column, as_of: Column) -> Column:
    """Whole days between two dates, 0 for future ones."""
    return F.greatest(F.datediff(F.to_date(as_of), F.to_date(ts)), F.lit(0))


def quotas(shares: DataFrame, keys: list[str], group: str, weight: str, places: int) -> DataFrame:
    """shares with `places`: how many of a number of places each group of a key gets, by largest remainders.

    Every whole part of a group's exact share is a place; the places left over go to the greatest fractions. Groups of positive
    weight left without one then get the topmost places of the others, each place seen as a unit at its height above the first:
    the highest units are given up. Ties go to the group first in order. Without a positive weight all get 0; null counts as 0.
    """
    own = Window.partitionBy(*keys)
    w = F.greatest(F.coalesce(F.col(weight).cast("double"), F.lit(0.0)), F.lit(0.0))
    exact = F.coalesce(F.try_divide(w * places, F.sum(w).over(own)), F.lit(0.0))
    split = shares.withColumn("_exact", F.round(exact, 9)).withColumn("_whole", F.floor("_exact"))
    split = split.withColumn("_left", F.when(F.sum("_exact").over(own) > 0, places - F.sum("_whole").over(own)).otherwise(0))
    by_fraction = own.orderBy((F.col("_exact") - F.col("_whole")).desc(), F.col(group))
    dealt = split.withColumn("_n", F.col("_whole") + (F.row_number().over(by_fraction) <= F.col("_left")).cast("bigint"))
    bare = (F.col("_n") == 0) & (F.col("_exact") > 0)
    dealt = dealt.withColumn("_bare", F.sum(bare.cast("int")).over(own)).withColumn("_spare", F.sum(F.greatest(F.col("_n") - 1, F.lit(0))).over(own))
    units = dealt.filter("_n > 1 and _bare > 0").select(*keys, group, "_bare", F.explode(F.sequence(F.lit(2).cast("bigint"), F.col("_n"))).alias("_height"))
    given = units.withColumn("_r", F.row_number().over(own.orderBy(F.col("_height").desc(), F.col(group)))).filter("_r <= _bare")
    lost = given.groupBy(*keys, group).agg(F.count(F.lit(1)).alias("_lost"))
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in [*keys, group]]
    both = dealt.alias("a").join(lost.alias("b"), same, "left").select("a.*", F.coalesce("b._lost", F.lit(0)).alias("_lost"))
    heaviest = F.row_number().over(Window.partitionBy(*keys, bare).orderBy(F.col("_exact").desc(), F.col(group)))
    n = F.when(bare & (heaviest <= F.col("_spare")), 1).otherwise(F.col("_n") - F.col("_lost"))
    return both.withColumn("places", n.cast("int")).drop("_exact", "_whole", "_left", "_n", "_bare", "_spare", "_lost")


def diversified(scores: np.ndarray, vectors: np.ndarray, groups: dict[str, np.ndarray], caps: dict[str, int], n: int, trade: float = 0.15) -> list[int]:
    """Greedy selection: the best (1 - trade) * score - trade * greatest likeness to those chosen, within caps per group."""
    span = scores.max() - scores.min() if len(scores) else 0
    norm = (scores - scores.min()) / span if span > 0 else np.ones(len(scores))
    like = np.zeros(len(scores))
    open_, used, chosen = np.ones(len(scores), dtype=bool), {g: {} for g in groups}, []
    while len(chosen) < n and open_.any():
        i = int(np.argmax(np.where(open_, (1 - trade) * norm - trade * like, -np.inf)))
        chosen.append(i)
        open_[i] = False
        like = np.maximum(like, vectors @ vectors[i])
        for g, of in groups.items():
            used[g][of[i]] = used[g].get(of[i], 0) + 1
            if of[i] is not None and used[g][of[i]] >= caps[g]:
                open_ &= of != of[i]
    return chosen


def rail(candidates: DataFrame, n: int, caps: dict[str, int]) -> DataFrame:
    """(profile, item, place): diversified() for every profile; candidates: profile, item, score, vector and the capped columns.

    A profile's candidates are a bounded pool (the candidate step cuts it), so they make one row; rows run in batches.
    """
    kinds = dict(candidates.dtypes)
    one = F.struct((-F.col("score")).alias("low"), "item", "vector", *caps)
    pools = candidates.groupBy("profile").agg(F.sort_array(F.collect_list(one)).alias("pool"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            profiles, items, places = [], [], []
            for profile, pool in zip(batch.column("profile").to_pylist(), batch.column("pool").to_pylist()):
                m = np.array([x["vector"] for x in pool], dtype=float)
                m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
                groups = {g: np.array([x[g] for x in pool], dtype=object) for g in caps}
                chosen = diversified(np.array([-x["low"] for x in pool]), m, groups, caps, n)
                profiles += [profile] * len(chosen)
                items += [pool[i]["item"] for i in chosen]
                places += range(1, len(chosen) + 1)
            types = [batch.schema.field("profile").type, batch.schema.field("pool").type.value_type.field("item").type, pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip((profiles, items, places), types)], ["profile", "item", "place"])

    return pools.mapInArrow(run, f"profile {kinds['profile']}, item {kinds['item']}, place int")


def beliefs(outcomes: DataFrame) -> DataFrame:
    """(arm, context, good, bad): sums decayed by half every 60 days; outcomes: arm, context, success, age."""
    w = F.pow(F.lit(0.5), F.col("age") / HALF_LIFE_BELIEF)
    return outcomes.groupBy("arm", "context").agg(
        F.round(F.sum(F.when(F.col("success"), w).otherwise(0.0)), 6).alias("good"), F.round(F.sum(F.when(~F.col("success"), w).otherwise(0.0)), 6).alias("bad")
    )


def borrowed_beliefs(own: DataFrame) -> DataFrame:
    """(arm, context, alpha, beta): a Beta(1, 1) prior, own evidence and 0.3 of the arm's evidence in other contexts. Sums are
    exact decimals, so the result doesn't depend on the order of rows."""
    arm = Window.partitionBy("arm")
    exact = lambda c: F.col(c).cast("decimal(18,6)")
    with_rest = lambda c: F.lit(1) + exact(c) + F.lit(str(BORROWED)).cast("decimal(2,1)") * (F.sum(exact(c)).over(arm).cast("decimal(18,6)") - exact(c))
    return own.select("arm", "context", F.round(with_rest("good"), 6).cast("double").alias("alpha"), F.round(with_rest("bad"), 6).cast("double").alias("beta"))


def allocate(alpha: list[float], beta: list[float], places: int, seed: int, draws: int = 100, cap: float = 0.5, floor: int = 1) -> list[int]:
    """Places per arm by Thompson sampling: the share of draws an arm wins, at most cap, at least floor; the arm furthest
    behind its share takes the next place."""
    random = Draws(seed)
    drawn = np.stack([random.beta(a, b, draws) for a, b in zip(alpha, beta)], axis=1)
    wins = np.bincount(np.argmax(drawn, axis=1), minlength=len(alpha)) / draws
    share = np.minimum(wins, cap)
    share = share / share.sum() if share.sum() > 0 else np.full(len(alpha), 1 / len(alpha))
    out = np.full(len(alpha), min(floor, places // max(len(alpha), 1)))
    limit = max(int(np.ceil(cap * places)), 1)
    while out.sum() < places:
        behind = np.where(out < limit, share * places - out, -np.inf)
        if not np.isfinite(behind).any():
            behind = share * places - out
        out[int(np.argmax(behind))] += 1
    return out.tolist()
