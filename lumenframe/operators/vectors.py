"""Vectors: exact and approximate neighbours, recall, quantisation, means, spherical k-means with silhouette."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenframe.operators.relational import top_per_key
from lumenframe.storage import materialize

#: Query vectors held by the driver and every task at once; a larger set is answered in as many passes as needed.
QUERY_BLOCK = 4096


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; null where either has no length."""
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def quantise(v: Column) -> Column:
    """Signed bytes: each value over a 127th of the greatest, rounded; zeros for a zero vector."""
    peak = F.aggregate(v, F.lit(0.0), lambda m, x: F.greatest(m, F.abs(x.cast("double"))))
    return F.transform(v, lambda x: F.coalesce(F.round(F.try_divide(x.cast("double") * 127, peak)), F.lit(0.0)).cast("tinyint"))


def _rows(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _unit(m: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(m, axis=-1, keepdims=True)
    return m / np.where(norms == 0, 1, norms)


def _matrix(column: pa.Array) -> np.ndarray:
    """Unit vectors of rows that all have one length."""
    return _unit(_rows(column))


def _query_blocks(queries: DataFrame, key: str, vector: str) -> Iterator[tuple[list, np.ndarray]]:
    """The queries in blocks of bounded size, in order of key."""
    last = None
    while True:
        rest = queries if last is None else queries.filter(F.col(key) > last)
        rows = rest.orderBy(key).limit(QUERY_BLOCK).collect()
        if not rows:
            return
        m = np.array([r[vector] for r in rows], dtype=np.float64)
        norms = np.linalg.norm(m, axis=1, keepdims=True)
        yield [r[key] for r in rows], m / np.where(norms == 0, 1, norms)
        last = rows[-1][key]


def nearest(base: DataFrame, queries: DataFrame, key: str, vector: str, k: int, bonus: Column | None = None) -> DataFrame:
    """(query, id, similarity, rank): the k rows most alike by cosine, the query itself left out; ties go to the lower id.

    bonus: of a row, added to its likeness to any query. Each task keeps k rows per query and batch, by one matrix product; only
    those meet in the shuffle. Of several blocks of queries each one's result is written before the next is read.
    """
    base = base.select(F.col(key).alias("id"), F.col(vector).alias("v"), (bonus if bonus is not None else F.lit(0.0)).cast("double").alias("bonus"))
    base = base.filter(F.col("v").isNotNull())
    best = lambda parts: top_per_key(parts, ["query"], [F.col("similarity").desc(), F.col("id")], k)
    done = None
    for ids, block in _query_blocks(queries.filter(F.col(vector).isNotNull()), key, vector):

        def run(batches: Iterator[pa.RecordBatch], ids=np.array(ids), block=block) -> Iterator[pa.RecordBatch]:
            for batch in filter(len, batches):
                own = np.asarray(batch.column("id"))
                alike = np.round(block @ _matrix(batch.column("v")).T + np.asarray(batch.column("bonus"))[None, :], 6)
                order = np.lexsort((np.broadcast_to(own, alike.shape), -alike), axis=1)[:, : k + 1]
                query = np.repeat(ids, order.shape[1])
                found = own[order].ravel()
                keep = query != found
                score = np.take_along_axis(alike, order, axis=1).ravel()
                yield pa.RecordBatch.from_arrays([pa.array(query[keep]), pa.array(found[keep]), pa.array(score[keep])], ["query", "id", "similarity"])

        part = best(base.mapInArrow(run, "query bigint, id bigint, similarity double"))
        part = part if len(ids) < QUERY_BLOCK and done is None else materialize(part, "nearest")
        done = part if done is None else done.unionByName(part)
    if done is None:
        return best(base.select(F.col("id").alias("query"), "id", F.lit(0.0).alias("similarity")).filter(F.lit(False)))
    return done


def nearest_excluding(base: DataFrame, queries: DataFrame, key: str, vector: str, excluded: DataFrame, k: int, most: int = 2000) -> DataFrame:
    """nearest() without each query's excluded (query, id): so many more are fetched, up to `most`, and the excluded left out."""
    counts = excluded.groupBy("query").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("n")).first()  # one row
    found = nearest(base, queries, key, vector, k + min(counts.n or 0, most)).drop("rank")
    return top_per_key(found.join(excluded, ["query", "id"], "left_anti"), ["query"], [F.col("similarity").desc(), F.col("id")], k)


def nearest_sharing(base: DataFrame, queries: DataFrame, key: str, group: str, vector: str, k: int) -> DataFrame:
    """nearest() of rows of which many have one vector, that of their `group`: vectors are compared once for all their rows.

    A group stands in for its rows by its lowest id. One that isn't among a query's first k + 1 has that many ids before any of its
    own, and of each group the first k + 1 rows are enough, as the query itself is left out at last. queries are rows of base.
    """
    base = base.filter(F.col(vector).isNotNull()).select(F.col(key).alias("id"), F.col(group).alias("group"), F.col(vector).alias("v"))
    asked = queries.filter(F.col(vector).isNotNull()).select(F.col(key).alias("query"), F.col(group).alias("group"))
    heads = materialize(base.groupBy("group").agg(F.min("id").alias("head"), F.first("v").alias("v")), "heads")
    rows = materialize(top_per_key(base.select("group", "id"), ["group"], [F.col("id")], k + 1, "_n").join(heads.select("group", "head"), "group").select("head", "id"), "first-rows")
    asked = materialize(asked.join(heads.select("group", "head"), "group").select("query", "head"), "asked")
    used = heads.join(asked.select("head").distinct(), "head", "left_semi")
    alike = nearest(heads, used, "head", "v", k).select("query", F.col("id").alias("head"), "similarity")
    own = used.select(F.col("head").alias("query"), "head", F.round(F.coalesce(cosine(F.col("v"), F.col("v")), F.lit(0.0)), 6).alias("similarity"))
    of_group = top_per_key(alike.unionByName(own).join(rows, "head").select("query", "id", "similarity"), ["query"], [F.col("similarity").desc(), F.col("id")], k + 1)
    each = asked.withColumnRenamed("query", "asked").join(of_group.drop("rank").withColumnRenamed("query", "head"), "head").filter("asked <> id")
    return top_per_key(each.select(F.col("asked").alias("query"), "id", "similarity"), ["query"], [F.col("similarity").desc(), F.col("id")], k)


#: Vectors on which cells are fitted, in the order of a hash of their ids; most cells; neighbours that the sample's own must find.
SAMPLE, MOST_CELLS, TARGET = 20_000, 4096, 0.97


class Cells:
    """Unit centres of cells, and how many of a query's nearest cells hold its neighbours."""

    def __init__(self, centres: np.ndarray, probes: int) -> None:
        self.centres, self.probes = centres, probes

    def nearest(self, m: np.ndarray, n: int) -> np.ndarray:
        return np.argsort(-(m @ self.centres.T), axis=1, kind="stable")[:, :n]


def fit_cells(base: DataFrame, key: str, vector: str, cells: int | None = None, steps: int = 12, seed: int = 7, k: int = 10, target: float = TARGET) -> Cells:
    """About the square root of the rows many cells, by spherical k-means on a bounded sample (SAMPLE rows).

    As many cells are to be searched as hold the share `target` of the k nearest sample rows of 400 sample rows: few where
    vectors lie in clusters, most of them where they lie evenly in many dimensions.
    """
    known = base.filter(F.col(vector).isNotNull())
    cells = cells or int(min(MOST_CELLS, max(1, round(known.count() ** 0.5))))
    rows = known.orderBy(F.xxhash64(key), key).limit(SAMPLE).select(vector).toPandas()[vector]
    if not len(rows):
        return Cells(np.zeros((0, 0)), 0)
    points = _unit(np.stack([np.asarray(x, dtype=np.float64) for x in rows]))
    random = np.random.default_rng(seed)
    centres = points[random.choice(len(points), min(cells, len(points)), replace=False)]
    for _ in range(steps):
        own = np.argmax(points @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, points)
        moved = np.linalg.norm(sums, axis=1) > 0
        centres[moved] = _unit(sums[moved])
    own = np.argmax(points @ centres.T, axis=1)
    asked = points[:400]
    alike = asked @ points.T
    np.fill_diagonal(alike, -np.inf)
    true = np.argsort(-alike, axis=1)[:, : min(k, len(points) - 1)]
    place = np.argsort(np.argsort(-(asked @ centres.T), axis=1, kind="stable"), axis=1)
    needed = np.sort(np.take_along_axis(place, own[true], axis=1).ravel())
    return Cells(centres, int(needed[int(np.ceil(target * len(needed))) - 1]) + 1 if len(needed) else 1)


def in_cells(rows: DataFrame, key: str, vector: str, cells: Cells, n: int = 1) -> DataFrame:
    """(id, v, cell): every row with its nearest cell, or one row for each of its n nearest. Rows without a vector are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in filter(len, batches):
            order = cells.nearest(_matrix(batch.column("v")), n)
            at = pa.array(np.repeat(np.arange(len(batch)), order.shape[1]))
            yield pa.RecordBatch.from_arrays([batch.column("id").take(at), batch.column("v").take(at), pa.array(order.ravel())], ["id", "v", "cell"])

    own = rows.select(F.col(key).cast("bigint").alias("id"), F.col(vector).alias("v")).filter(F.col("v").isNotNull())
    return own.mapInArrow(run, f"id bigint, v {dict(own.dtypes)['v']}, cell bigint")


def insert(index: DataFrame, rows: DataFrame, key: str, vector: str, cells: Cells) -> DataFrame:
    """The index with further rows in their cells; a row replaces one of the same id."""
    new = in_cells(rows, key, vector, cells)
    return index.join(rows.select(F.col(key).cast("bigint").alias("id")), "id", "left_anti").unionByName(new)


def nearest_in_cells(index: DataFrame, queries: DataFrame, key: str, vector: str, cells: Cells, k: int, probes: int | None = None) -> DataFrame:
    """(query, id, similarity, rank, candidates): the nearest of the rows in each query's nearest cells; candidates counts them."""
    asked = in_cells(queries, key, vector, cells, probes or cells.probes).withColumnsRenamed({"id": "query", "v": "q"})
    both = asked.join(index, "cell").filter("query <> id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in filter(len, batches):
            alike = np.round((_matrix(batch.column("q")) * _matrix(batch.column("v"))).sum(axis=1), 6)
            yield pa.RecordBatch.from_arrays([batch.column("query"), batch.column("id"), pa.array(alike)], ["query", "id", "similarity"])

    scored = both.select("query", "id", "q", "v").mapInArrow(run, "query bigint, id bigint, similarity double")
    seen = scored.withColumn("candidates", F.count(F.lit(1)).over(Window.partitionBy("query")))
    return top_per_key(seen, ["query"], [F.col("similarity").desc(), F.col("id")], k)


def edited_modes(modes: DataFrame, corrections: DataFrame, stated: DataFrame, share: float = 0.2) -> DataFrame:
    """(profile, mode, weight): weights doubled, halved or struck out by corrections and made shares again; profiles that said
    what they like give `share` to that (a mode of number null), all of it where no other mode is left.

    modes: profile, mode, weight. corrections: profile, mode, word (more, less, not_me). stated: profile.
    """
    factor = F.when(F.col("word") == "more", 2.0).when(F.col("word") == "less", 0.5).when(F.col("word") == "not_me", 0.0).otherwise(1.0)
    edited = modes.join(corrections, ["profile", "mode"], "left").withColumn("weight", F.col("weight") * factor).filter("weight > 0")
    own = edited.withColumn("weight", F.col("weight") / F.sum("weight").over(Window.partitionBy("profile"))).select("profile", "mode", "weight")
    said = stated.select("profile").distinct()
    kept = own.join(said.withColumn("said", F.lit(True)), "profile", "left").select("profile", "mode", F.when(F.col("said"), F.col("weight") * (1 - share)).otherwise(F.col("weight")).alias("weight"))
    some = own.select("profile").distinct().withColumn("some", F.lit(True))
    words = said.join(some, "profile", "left").select("profile", F.lit(None).cast(dict(modes.dtypes)["mode"]).alias("mode"), F.when(F.col("some"), share).otherwise(1.0).alias("weight"))
    return kept.unionByName(words)


def recall_at(found: DataFrame, truth: DataFrame) -> DataFrame:
    """(queries, recall): share of the true neighbours that were found; a query without truth counts as 1."""
    hits = truth.select("query", "id").join(found.select("query", "id", F.lit(1).alias("hit")), ["query", "id"], "left")
    each = hits.groupBy("query").agg(F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))
    return each.agg(F.count(F.lit(1)).alias("queries"), F.avg("recall").alias("recall"))


def mean_vectors(df: DataFrame, key: str, vector: str, weight: Column) -> DataFrame:
    """(key, mean): weighted mean of unit vectors, made a unit vector again; weights of 0 or less are left out."""
    norm = F.sqrt(dot(F.col(vector), F.col(vector)))
    each = df.select(key, F.posexplode(vector).alias("at", "x"), norm.alias("norm"), weight.alias("w")).filter("w > 0 and norm > 0")
    sums = each.groupBy(key, "at").agg(F.sum(F.col("w") * F.col("x") / F.col("norm")).alias("x"))
    mean = sums.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda s: s["x"]).alias("m"))
    return mean.select(key, F.transform("m", lambda x: F.try_divide(x, F.sqrt(dot(F.col("m"), F.col("m"))))).alias("mean"))


def spherical_kmeans(points: np.ndarray, weights: np.ndarray, k: int, steps: int = 25) -> np.ndarray:
    """Cluster of each unit vector: start at the heaviest point, then always at the point farthest from all centres; an empty
    centre keeps its place; ties go to the first point and centre."""
    chosen = [int(np.argmax(weights))]
    near = points @ points[chosen[0]]
    while len(chosen) < k:
        chosen.append(int(np.argmin(near)))
        near = np.maximum(near, points @ points[chosen[-1]])
    centres = points[chosen].copy()
    own = np.zeros(len(points), dtype=int)
    for _ in range(steps):
        own = np.argmax(points @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, points * weights[:, None])
        moved = np.linalg.norm(sums, axis=1) > 0
        centres[moved] = _unit(sums[moved])
    return own


def silhouette(points: np.ndarray, own: np.ndarray, most: int = 160) -> float:
    """Mean silhouette by cosine distance over an evenly spaced sample of at most `most` points."""
    at = np.unique(np.linspace(0, len(points) - 1, min(most, len(points))).astype(int))
    far, own = 1 - points[at] @ points[at].T, own[at]
    scores = []
    for i, c in enumerate(own):
        mine = (own == c) & (np.arange(len(own)) != i)
        others = [far[i, own == o].mean() for o in np.unique(own) if o != c]
        if not mine.any() or not others:
            scores.append(0.0)
            continue
        a, b = far[i, mine].mean(), min(others)
        scores.append((b - a) / max(a, b) if max(a, b) > 0 else 0.0)
    return float(np.mean(scores)) if scores else 0.0


def modes(points: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Interests of one profile: one under six points, else the number from 3 to min(8, n / 2) of the best silhouette."""
    if len(points) < 6:
        return np.zeros(len(points), dtype=int)
    best, chosen = -2.0, None
    for k in range(3, min(8, len(points) // 2) + 1):
        own = spherical_kmeans(points, weights, k)
        if (score := silhouette(points, own)) > best:
            best, chosen = score, own
    return chosen
