"""Mixing sources to target weights, by balanced sampling with the cube method.

Each source gets a number of tokens in proportion to its target share. A text is used the whole number of times that its
source's rate demands, and the fraction that remains becomes its inclusion probability for one use more. The cube method
turns these probabilities into yes or no: they move within the null space of the balancing constraints (the source's number
of texts and of tokens) until only some undecided texts remain; so totals come out as planned and every text keeps its
probability. Texts move in blocks of bounded size, by hash within their source; the undecided ones
of all blocks form the blocks of the next level, until one last block of a source leaves the small landing problem, which is
solved by trying every rounding. A source that holds most texts is many blocks.
"""

from __future__ import annotations

import random

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.storage import materialize

BLOCK = 2000
#: Undecided texts at which a block's flight ends; all roundings of so many are tried in landing.
LANDING = 15
EPSILON = 1e-9


def null_vector(sizes: list[float]) -> list[float]:
    """A vector orthogonal to (1, 1, 1) and to three sizes; for two texts of one size it moves between them."""
    if len(sizes) == 2:
        return [1.0, -1.0] if sizes[0] == sizes[1] else [0.0, 0.0]
    a, b, c = sizes
    return [1.0, -1.0, 0.0] if a == b == c else [c - b, a - c, b - a]


def flight(chance: list[float], sizes: list[float], seed: int, stop: int = LANDING) -> list[float]:
    """Moves probabilities until at most `stop` (2 at least) are neither 0 nor 1, keeping their sum and their sum of sizes.

    Every step goes in one of two directions with chances that leave the expectation unchanged. Expects the probabilities of
    one source, equal or not; the totals kept are those of chance and chance times size.
    """
    move = random.Random(seed)
    chance = list(chance)
    waiting = [i for i in range(len(chance) - 1, -1, -1) if EPSILON < chance[i] < 1 - EPSILON]
    held: list[int] = []
    while True:
        if len(held) + len(waiting) <= stop:
            break
        while len(held) < 3 and waiting:
            held.append(waiting.pop())
        if len(held) < 2:
            break
        u = null_vector([sizes[i] for i in held])
        if not any(u):
            break
        up = min((1 - chance[i]) / x if x > 0 else chance[i] / -x for i, x in zip(held, u) if x)
        down = min(chance[i] / x if x > 0 else (1 - chance[i]) / -x for i, x in zip(held, u) if x)
        step = up if move.random() * (up + down) < down else -down
        for i, x in zip(held, u):
            chance[i] = min(1.0, max(0.0, chance[i] + step * x))
        held = [i for i in held if EPSILON < chance[i] < 1 - EPSILON]
    return [0.0 if p <= EPSILON else 1.0 if p >= 1 - EPSILON else p for p in chance]


def land(chance: list[float], sizes: list[float]) -> list[float]:
    """Rounds the few undecided probabilities so that the tokens, then the texts, come nearest to their expectation."""
    open_ = [i for i, p in enumerate(chance) if 0 < p < 1]
    p, s = np.array([chance[i] for i in open_]), np.array([sizes[i] for i in open_])
    ways = (np.arange(1 << len(open_))[:, None] >> np.arange(len(open_))) & 1
    off = np.abs(ways @ s - p @ s), np.abs(ways.sum(axis=1) - p.sum())
    out = list(chance)
    for i, x in zip(open_, ways[np.lexsort(off[::-1])[0]]):
        out[i] = float(x)
    return out


def _decide(items: pd.DataFrame) -> pd.DataFrame:
    """Flight of one block; landing where it is its source's only one."""
    # large texts move first; texts of all sizes move last, so that landing can make up for any one left open
    items = items.sort_values(["tokens", "key"], ascending=[False, True])
    last = np.unique(np.linspace(0, len(items) - 1, LANDING).astype(int))
    items = items.iloc[np.concatenate([np.setdiff1d(np.arange(len(items)), last), last])].reset_index(drop=True)
    sizes, block = items["tokens"].astype(float).tolist(), int(items["block"].iloc[0])
    chance = flight(items["chance"].tolist(), sizes, block * 1_000_003 + len(items))
    return items.assign(chance=land(chance, sizes) if items["blocks"].iloc[0] == 1 else chance)


def plan(available: dict[str, int], targets: dict[str, tuple[float, int]], total: float | None = None) -> dict[str, float]:
    """Tokens to take per source: share times total, as far as max_repeats times what is available allows.

    Without a total it is the largest at which every source with texts meets its share. With a greater one sources at their
    cap give the rest to the others in proportion to their shares, until all are at their caps.
    """
    caps = {s: available.get(s, 0) * repeats for s, (share, repeats) in targets.items() if share > 0}
    live = {s: targets[s][0] for s, cap in caps.items() if cap > 0}
    if not live:
        return {}
    if total is None:
        weight = sum(live.values())
        total = min(caps[s] / (share / weight) for s, share in live.items())
    taken: dict[str, float] = {}
    left = total
    while live:
        weight = sum(live.values())
        over = [s for s, share in live.items() if left * share / weight >= caps[s]]
        if not over:
            return taken | {s: left * share / weight for s, share in live.items()}
        for s in over:
            taken[s] = float(caps[s])
            live.pop(s)
        left = total - sum(taken.values())
    return taken


def mix(sized: DataFrame, targets: dict[str, tuple[float, int]], total: float | None = None) -> DataFrame:
    """(key, source, tokens, times): how often each text is used, for those used at all.

    sized: key (unique), source, tokens. targets: share and greatest number of uses per source; sources without a target,
    null sources and texts without tokens aren't used. There must be few enough targets for a table of them to be
    broadcast; the queries allow 10,000. A source without texts leaves its share to the others.
    """
    spark = sized.sparkSession
    per_source = lambda values, column: F.broadcast(spark.createDataFrame(list(values.items()), f"source string, {column} double"))  # noqa: E731 - a row per target
    usable = sized.filter(F.col("tokens") > 0).join(per_source({s: t[0] for s, t in targets.items()}, "share"), "source", "left_semi")
    usable = materialize(usable.select("key", "source", "tokens"), "usable")
    sums = usable.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("n")).collect()  # one row per target
    available, texts = {r.source: r.tokens for r in sums}, {r.source: r.n for r in sums}
    taken = plan(available, targets, total)
    rates = {}
    for s, tokens in taken.items():
        exact = tokens / available[s]
        nearest = round(exact)
        rates[s] = float(nearest) if abs(exact - nearest) < 1e-9 else exact
    rated = usable.join(per_source(rates, "rate"), "source").withColumn("sure", F.floor("rate"))
    todo = rated.select("key", "source", "tokens", (F.col("rate") - F.col("sure")).alias("chance")).filter(F.col("chance") > 0)
    decided = None
    level = 0
    key = dict(usable.dtypes)["key"]
    shape = f"key {key}, source string, tokens bigint, chance double, blocks bigint, block bigint"
    while True:
        level += 1
        blocks = {s: -(-n // BLOCK) for s, n in texts.items()}
        counted = todo.join(per_source({s: float(n) for s, n in blocks.items()}, "blocks"), "source").withColumn("blocks", F.col("blocks").cast("bigint"))
        dealt = counted.withColumn("block", F.pmod(F.xxhash64("key", F.lit(level)), F.col("blocks"))).select("key", "source", "tokens", "chance", "blocks", "block")
        moved = materialize(dealt.groupBy("source", "block").applyInPandas(_decide, shape), f"flight-{level}")
        yes = moved.filter(F.col("chance") == 1).select("key")
        decided = yes if decided is None else decided.unionByName(yes)
        # a source of one block has landed; a block of the others leaves a few open at most
        texts = {s: LANDING * n for s, n in blocks.items() if n > 1}
        if not texts:
            break
        todo = moved.filter((F.col("chance") > 0) & (F.col("chance") < 1)).select("key", "source", "tokens", "chance")
    more = decided.select("key", F.lit(1).alias("more"))
    times = (F.col("sure") + F.coalesce("more", F.lit(0))).cast("int")
    return rated.join(more, "key", "left").select("key", "source", "tokens", times.alias("times")).filter(F.col("times") > 0)


def mixture_report(used: DataFrame, sized: DataFrame, targets: dict[str, tuple[float, int]]) -> DataFrame:
    """Per target source: its share, the share reached, texts and tokens used, mean and greatest number of uses."""
    spark = sized.sparkSession
    rows = [(s, float(share), int(repeats)) for s, (share, repeats) in targets.items()]
    goal = spark.createDataFrame(rows, "source string, target_share double, max_repeats int")
    have = sized.filter(F.col("tokens") > 0).groupBy("source").agg(F.count(F.lit(1)).alias("texts"), F.sum("tokens").alias("tokens"))
    took = used.groupBy("source").agg(
        F.count(F.lit(1)).alias("texts_used"), F.sum(F.col("tokens") * F.col("times")).alias("tokens_used"), F.sum("times").alias("uses"), F.max("times").alias("most_uses")
    )
    both = goal.join(have, "source", "left").join(took, "source", "left")
    total = both.agg(F.sum("tokens_used").alias("all_tokens"))  # one row
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return both.join(F.broadcast(total)).select(
        "source", "target_share", (F.coalesce("tokens_used", F.lit(0)) / F.col("all_tokens")).alias("share"), "max_repeats",
        zero("texts"), zero("tokens"), zero("texts_used"), zero("tokens_used"), zero("most_uses"), (F.coalesce("uses", F.lit(0)) / F.col("texts")).alias("mean_uses"),
    )
