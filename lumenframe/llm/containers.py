"""Filling containers of fixed capacity with texts, by bin completion.

Items are dealt by hash into blocks of a bounded total size, so no block grows with the data and no source or group is
hot. Each block is packed by branch and bound: for the largest remaining item the undominated fillings of its container are
enumerated, the emptiest waste first, and a branch is cut when its waste can no longer beat the best solution, which at
first is best fit decreasing. The few containers of a block that stay rather empty are opened again: in the next round their
items form blocks of their own. So the loss is about one container in BLOCK squared.

The search of a block ends after a number of branches; the packing is always whole, at worst it is the best-fit one.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.storage import materialize

#: Containers' worth of items in a block; branches searched in a block; fillings enumerated for a container; items up to which
#: a filling's dominance is decided (a longer one counts as undominated). They bound the search, never what is placed.
BLOCK, BRANCHES, LEAVES, DOMINANCE = 64, 200, 24, 8
#: A container filled to this share is final in any round but the last.
CLOSED = 0.985
ROUNDS = 2


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Best fit decreasing: positions of the items of each container. sizes are sorted from large to small."""
    bins: list[list[int]] = []
    free: list[tuple[int, int]] = []
    for i, size in enumerate(sizes):
        at = bisect_left(free, (size, -1))
        if at == len(free):
            bins.append([i])
            insort(free, (capacity - size, len(bins) - 1))
        else:
            room, b = free.pop(at)
            bins[b].append(i)
            insort(free, (room - size, b))
    return bins


def least_bins(sizes: list[int], capacity: int) -> int:
    """Lower bound of containers: the total, sharpened for each k by the items that can't lie with one larger than capacity - k."""
    up = sorted(sizes)
    ahead = [0]
    for s in up:
        ahead.append(ahead[-1] + s)
    best = -(-ahead[-1] // capacity)
    half = bisect_right(up, capacity // 2)
    large = len(up) - half
    for at in sorted({bisect_left(up, k) for k in up[:half]}):
        k = up[at]
        huge = bisect_right(up, capacity - k)  # items above it share with nothing of size k or more
        middle, room = ahead[huge] - ahead[half], (huge - half) * capacity
        rest = ahead[half] - ahead[at]
        best = max(best, large + max(0, -(-(rest - (room - middle)) // capacity)))
    return max(best, large)


def dominated(a: list[int], b: list[int]) -> bool:
    """Whether filling b is at least as good as a in every solution: a's items can be packed into b's as if those were bins."""
    if sum(a) > sum(b) or a == b:
        return False
    if len(a) > DOMINANCE or len(b) > DOMINANCE:
        return False

    def place(i: int, room: list[int]) -> bool:
        if i == len(a):
            return True
        tried = set()
        for j, r in enumerate(room):
            if r >= a[i] and r not in tried:
                tried.add(r)
                if place(i + 1, [*room[:j], r - a[i], *room[j + 1 :]]):
                    return True
        return False

    return place(0, list(b))


def fillings(left: list[int], room: int) -> list[list[int]]:
    """Maximal fillings of the room from sizes sorted from small to large, least waste first, without dominated ones.

    Enumeration takes the largest that fits first and ends after LEAVES fillings or at the first without waste.
    """
    found: list[list[int]] = []
    seen: set[tuple[int, ...]] = set()

    def extend(room: int, below: int, chosen: list[int]) -> bool:
        at = bisect_right(left, room, 0, below)
        if at == 0:
            if tuple(chosen) not in seen:
                seen.add(tuple(chosen))
                found.append(list(chosen))
            return room == 0 or len(found) >= LEAVES
        while at:
            size = left[at - 1]
            chosen.append(size)
            done = extend(room - size, at - 1, chosen)
            chosen.pop()
            if done:
                return True
            at = bisect_left(left, size, 0, at)
        return False

    extend(room, len(left), [])
    found.sort(key=lambda f: (-sum(f), f))
    kept: list[list[int]] = []
    for f in found:
        if not any(dominated(f, k) for k in kept):
            kept.append(f)
    return kept


def bin_completion(sizes: list[int], capacity: int, branches: int = BRANCHES) -> list[list[int]]:
    """Containers as lists of sizes. sizes needn't be sorted; each is from 1 to capacity."""
    down = sorted(sizes, reverse=True)
    best = [[down[i] for i in b] for b in best_fit(down, capacity)]
    least = least_bins(down, capacity)
    total = sum(down)
    budget = branches

    # explicit stack: (remaining from small to large, waste so far, containers so far, fillings to try)
    def options(left: list[int]) -> list[list[int]]:
        return list(reversed(fillings(left[:-1], capacity - left[-1])))

    stack = [(down[::-1], 0, [], None)] if len(best) > least else []
    while stack and budget > 0 and len(best) > least:
        left, waste, bins, tries = stack.pop()
        if not left:
            if len(bins) < len(best):
                best = bins
            continue
        tries = options(left) if tries is None else tries
        if not tries:
            continue
        budget -= 1
        filling = tries.pop()
        if tries:
            stack.append((left, waste, bins, tries))
        chosen = [left[-1], *filling]
        lost = waste + capacity - sum(chosen)
        if lost > (len(best) - 1) * capacity - total:
            continue
        rest = left[:-1]
        for s in filling:
            rest.pop(bisect_left(rest, s))
        stack.append((rest, lost, [*bins, chosen], None))
    return best


def pack_block(items: pd.DataFrame) -> pd.DataFrame:
    """Adds bin and fill to the items (capacity, tokens) of one block; ties are dealt in the order of key and part."""
    capacity = int(items["capacity"].iloc[0])
    items = items.sort_values(["tokens", "key", "part"], kind="stable").reset_index(drop=True)
    where: dict[int, list[int]] = {}
    for i, s in enumerate(items["tokens"].tolist()):
        where.setdefault(s, []).append(i)
    bin_of, fill = [0] * len(items), [0] * len(items)
    for b, own in enumerate(bin_completion(items["tokens"].tolist(), capacity)):
        total = sum(own)
        for s in own:
            i = where[s].pop()
            bin_of[i], fill[i] = b, total
    return items.assign(bin=bin_of, fill=fill)


def parts(sized: DataFrame, capacities: dict[str, int]) -> DataFrame:
    """(kind, capacity, key, part, tokens) of sized texts (key, tokens): one part, or as many full ones as needed and a rest."""
    kinds = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(c).cast("bigint").alias("capacity")) for k, c in capacities.items()]))
    each = sized.filter(F.col("tokens") > 0).select("key", "tokens", kinds.alias("of")).select("of.*", "key", "tokens")
    last = F.expr("(tokens - 1) div capacity")
    part = F.explode(F.sequence(F.lit(0).cast("bigint"), last))
    return each.select("kind", "capacity", "key", part.alias("part"), F.col("tokens").alias("of")).withColumn(
        "tokens", F.least("capacity", F.col("of") - F.col("part") * F.col("capacity"))
    ).drop("of")


def fill_containers(sized: DataFrame, capacities: dict[str, int]) -> DataFrame:
    """Places every text: kind, container, key, part, first_token, tokens, fill (tokens in the container).

    sized: key (unique), tokens. Texts longer than a container are split at multiples of its capacity; others never are.
    Null or non-positive sizes need no container and have no row; capacities below 1 are an error. An empty table gives no
    rows. Equal sizes are placed in the order of key, so a run gives the same containers again.
    """
    if not capacities or min(capacities.values()) < 1:
        raise ValueError("capacities must be 1 or more")
    items = materialize(parts(sized, capacities), "items")
    full = items.filter(F.col("tokens") == F.col("capacity"))
    todo = items.filter(F.col("tokens") < F.col("capacity"))
    done = [full.select(
        "kind", F.concat_ws("-", "kind", F.lit("full"), "key", "part").alias("container"), "key", "part", "capacity", "tokens", F.col("tokens").alias("fill")
    )]
    key = dict(items.dtypes)["key"]
    shape = f"kind string, capacity bigint, key {key}, part bigint, tokens bigint, block bigint, bin bigint, fill bigint"
    for n in range(1, ROUNDS + 1):
        sums = {r.kind: r.total for r in todo.groupBy("kind").agg(F.sum("tokens").alias("total")).collect()}  # one row per kind
        blocks = F.lit(1)
        for kind, capacity in capacities.items():
            blocks = F.when(F.col("kind") == kind, -(-sums.get(kind, 0) // (BLOCK * capacity)) or 1).otherwise(blocks)
        dealt = todo.withColumn("block", F.pmod(F.xxhash64("key", "part", F.lit(n)), blocks.cast("bigint")))
        packed = materialize(dealt.groupBy("kind", "block").applyInPandas(pack_block, shape), f"packed-{n}")
        closed = F.lit(True) if n == ROUNDS else F.col("fill") >= F.col("capacity") * CLOSED
        name = F.concat_ws("-", "kind", F.lit(n), "block", "bin")
        done.append(packed.filter(closed).select("kind", name.alias("container"), "key", "part", "capacity", "tokens", "fill"))
        todo = packed.filter(~closed).select("kind", "capacity", "key", "part", "tokens")
    placed = done[0]
    for x in done[1:]:
        placed = placed.unionByName(x)
    return placed.select("kind", "container", "key", "part", (F.col("part") * F.col("capacity")).alias("first_token"), "tokens", "fill")
