"""Ranked retrieval over whole sets of queries: BM25, trigrams, reciprocal rank fusion, tiers and popularity."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lumenframe.functions.text import words
from lumenframe.operators.relational import top_per_key
from lumenframe.storage import materialize

K1, B, FUSION = 1.2, 0.75, 60


def postings(docs: DataFrame, key: str, fields: dict[str, float]) -> DataFrame:
    """(key, term, tf, doc_len): weighted term frequencies over several fields; a field's weight multiplies its counts."""
    weighed = lambda c, w: F.transform(F.coalesce(words(F.col(c)), F.array().cast("array<string>")), lambda t: F.struct(t.alias("term"), F.lit(float(w)).alias("w")))
    each = [weighed(c, w) for c, w in fields.items()]
    return _with_lengths(_by_key(docs, key).select(key, F.inline(F.concat(*each))).groupBy(key, "term").agg(F.sum("w").alias("tf")), key)


def _by_key(docs: DataFrame, key: str) -> DataFrame:
    """Texts travel to their key's task before they are cut up, so that no piece has to."""
    return docs.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def _with_lengths(counted: DataFrame, key: str) -> DataFrame:
    return counted.withColumn("doc_len", F.sum("tf").over(Window.partitionBy(key)))


#: Postings of one block of documents, and most queries that one task answers.
BLOCK_POSTINGS, BLOCK_QUERIES = 1_000_000, 4096
_BLOCK = "keys array<bigint>, terms array<string>, ends array<int>, docs array<int>, weights array<double>"


def _blocks(posts: DataFrame, key: str, terms: DataFrame, stats: DataFrame) -> str:
    """Where the postings of the asked terms are: a row for every block of whole documents, with its documents by term. A weight is
    what a posting adds to a score but for the term's rarity."""
    weight = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("doc_len") / F.col("mean_len")))
    held = materialize(posts.join(terms, "term", "left_semi").join(F.broadcast(stats)).select(F.col(key).cast("bigint").alias("key"), "term", weight.alias("weight")), "asked-postings")
    blocks = held.count() // BLOCK_POSTINGS + 1

    def build(rows: pa.Table) -> pa.Table:
        keys, docs = np.unique(np.asarray(rows["key"]), return_inverse=True)
        words = rows["term"].combine_chunks().dictionary_encode()
        order = np.lexsort((docs, np.asarray(words.indices)))
        ends = np.cumsum(np.bincount(np.asarray(words.indices), minlength=len(words.dictionary)))
        one = [keys, words.dictionary, pa.array(ends, pa.int32()), pa.array(docs[order], pa.int32()), np.asarray(rows["weight"])[order]]
        return pa.table({f.split()[0]: pa.ListArray.from_arrays([0, len(x)], pa.array(x) if isinstance(x, np.ndarray) else x) for f, x in zip(_BLOCK.split(", "), one)})

    own = held.withColumn("block", F.pmod(F.xxhash64("key"), F.lit(blocks)))
    return _path(materialize(own.groupBy("block").applyInArrow(build, _BLOCK), "blocks"))


def _path(written: DataFrame) -> str:
    return written.inputFiles()[0].rpartition("/")[0] if written.inputFiles() else ""


def _best(slots: np.ndarray, idf: np.ndarray, needed: int, ends: np.ndarray, docs: np.ndarray, weights: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The documents of a block that hold `needed` of a query's terms, and their scores. slots: of the terms, -1 is none."""
    there = slots >= 0
    if there.sum() < needed:
        return np.zeros(0, int), np.zeros(0)
    slots, idf = slots[there], idf[there]
    begins, stops = np.where(slots > 0, ends[slots - 1], 0), ends[slots]
    if needed == len(there):  # every term: from the rarest on, only what is left is looked up
        order = np.argsort(stops - begins, kind="stable")
        found, score = None, 0.0
        for i in order:
            own, w = docs[begins[i] : stops[i]], weights[begins[i] : stops[i]]
            if found is None:
                found, score = own, w * idf[i]
                continue
            at = np.minimum(np.searchsorted(own, found), len(own) - 1)
            both = own[at] == found
            found, score = found[both], score[both] + w[at[both]] * idf[i]
            if not len(found):
                break
        return found, score
    own = np.concatenate([docs[a:b] for a, b in zip(begins, stops)])
    held = np.bincount(own, minlength=n)
    found = np.flatnonzero(held >= needed)
    if not len(found):
        return found, np.zeros(0)
    score = np.bincount(own, np.concatenate([weights[a:b] * x for a, b, x in zip(begins, stops, idf)]), minlength=n)
    return found, score[found]


def _ranked(posts: DataFrame, key: str, asked: DataFrame, k: int) -> DataFrame:
    """(query, key, score, rank): the k best documents by BM25 that hold `needed` of each query's terms; ties go to the lower key.

    asked: query, term, needed; a term counts as often as it stands. Postings never meet queries in a shuffle: a task answers a
    block of queries, reads the blocks of documents from the shared folder one after another, and keeps k results a query.
    """
    stats = posts.groupBy(key).agg(F.max("doc_len").alias("doc_len")).agg(F.count(F.lit(1)).alias("n"), F.avg("doc_len").alias("mean_len"))  # one row
    terms = asked.select("term").distinct()
    frequency = posts.join(terms, "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    stats = materialize(stats, "stats")
    path = _blocks(posts, key, terms, stats)
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    known = asked.join(frequency, "term", "left").join(F.broadcast(stats)).select("query", "term", "needed", F.coalesce(idf, F.lit(0.0)).alias("idf"))
    known = materialize(known, "asked-terms")
    kinds = dict(posts.dtypes) | dict(asked.dtypes)
    shape = f"query {kinds['query']}, {key} {kinds[key]}, score double, rank int"
    if not path:
        return asked.sparkSession.createDataFrame([], shape)
    tasks = max(2 * asked.sparkSession.sparkContext.defaultParallelism, known.select("query").distinct().count() // BLOCK_QUERIES + 1)

    def answer(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("query")
        query = np.asarray(rows["query"])
        starts = np.flatnonzero(np.r_[True, query[1:] != query[:-1]])
        parts = list(zip(starts, np.r_[starts[1:], len(query)]))
        words, rarity, needed = rows["term"].combine_chunks(), np.asarray(rows["idf"]), np.asarray(rows["needed"])
        best = [(np.zeros(0), np.zeros(0, np.int64))] * len(parts)
        files, folder = fs.FileSystem.from_uri(path)
        for file in files.get_file_info(fs.FileSelector(folder)):
            if not file.path.endswith(".parquet"):
                continue
            for block in pq.ParquetFile(files.open_input_file(file.path)).iter_batches(batch_size=1):
                keys, names, ends, docs, weights = (block.column(c).flatten() for c in ("keys", "terms", "ends", "docs", "weights"))
                keys, ends, docs, weights = np.asarray(keys), np.asarray(ends), np.asarray(docs).astype(np.int64), np.asarray(weights)
                slots = pc.fill_null(pc.index_in(words, value_set=names), -1).to_numpy()
                for i, (a, b) in enumerate(parts):
                    found, score = _best(slots[a:b], rarity[a:b], int(needed[a]), ends, docs, weights, len(keys))
                    if not len(found):
                        continue
                    score = np.round(score, 6)
                    least = best[i][0][-1] if len(best[i][0]) == k else -np.inf
                    if len(score) > k:
                        least = max(least, np.partition(score, len(score) - k)[len(score) - k])
                    score, own = np.r_[best[i][0], score[score >= least]], np.r_[best[i][1], keys[found[score >= least]]]
                    order = np.lexsort((own, -score))[:k]
                    best[i] = score[order], own[order]
        sizes = [len(s) for s, _ in best]
        out = [np.repeat(query[starts], sizes), np.concatenate([x for _, x in best]), np.concatenate([s for s, _ in best]), np.concatenate([np.arange(1, n + 1) for n in sizes])]
        return pa.table({c: pa.array(x).cast(t) for c, x, t in zip(("query", key, "score", "rank"), out, kept)})

    kept = [to_arrow_type(f.dataType) for f in asked.sparkSession.createDataFrame([], shape).schema]
    known = known.withColumn("task", F.pmod(F.xxhash64("query"), F.lit(tasks))).repartition(tasks, "task")  # few bytes, but much work
    return known.groupBy("task").applyInArrow(answer, shape)


def bm25(posts: DataFrame, key: str, queries: DataFrame, query: str, text: str, k: int) -> DataFrame:
    """(query, key, score, rank): for every query the best documents that hold all its words (implicit AND)."""
    asked = queries.select(F.col(query).alias("query"), F.explode(words(F.col(text))).alias("term")).distinct()
    return _ranked(posts, key, asked.withColumn("needed", F.count(F.lit(1)).over(Window.partitionBy("query"))), k)


def grams(text: Column, size: int = 3) -> Column:
    """The pieces of `size` letters of a lower-case text, as often as they stand; a null or shorter text has none."""
    low = F.lower(text)
    cut = F.transform(F.sequence(F.lit(1), F.length(low) - (size - 1)), lambda i: F.substr(low, i, F.lit(size)))
    return F.when(F.length(low) >= size, cut).otherwise(F.array().cast("array<string>"))


def gram_postings(names: DataFrame, key: str, name: str) -> DataFrame:
    """(key, term, tf, doc_len): three-letter pieces of all names of each key."""
    pieces = _by_key(names, key).select(key, F.explode(grams(F.col(name))).alias("term"))
    return _with_lengths(pieces.groupBy(key, "term").agg(F.count(F.lit(1)).cast("double").alias("tf")), key)


def fuzzy(posts: DataFrame, key: str, queries: DataFrame, query: str, text: str, k: int, least: float = 0.3) -> DataFrame:
    """(query, key, score, rank): documents that hold any of a query's three-letter pieces, `least` of the distinct ones at
    least, best by BM25; queries under four letters find nothing. posts: gram_postings(), written once as it is read thrice."""
    asked = queries.filter(F.length(text) >= 4).select(F.col(query).alias("query"), F.explode(F.array_distinct(grams(F.col(text)))).alias("term"))
    needed = F.ceil(F.round(F.count(F.lit(1)).over(Window.partitionBy("query")) * least, 9))
    return _ranked(posts, key, asked.withColumn("needed", needed), k)


def filtered(titles: DataFrame, key: str, asked: DataFrame, k: int) -> DataFrame:
    """(query, key, rank): titles within each query's limits, most votes first; a query without a limit finds nothing.

    asked: query, year_from, year_to, least_minutes, most_minutes (null is no limit). An unknown year or length fails a limit on
    it. Equal limits are looked up once, by decade, and among the best titles of each year and length alone.
    """
    limits = ["year_from", "year_to", "least_minutes", "most_minutes"]
    known = asked.filter(F.coalesce(*limits).isNotNull())
    kinds = materialize(known.select(*limits).distinct(), "limits")
    order = [F.col("votes").desc_nulls_last(), F.col(key)]
    inside = lambda c, low, high: (F.col(low).isNull() | (F.col(c) >= F.col(low))) & (F.col(high).isNull() | (F.col(c) <= F.col(high)))
    decades = F.sequence(F.expr("coalesce(year_from, 1870) div 10"), F.expr("coalesce(year_to, 2100) div 10"))
    limited = {"year": F.coalesce("year_from", "year_to").isNotNull(), "minutes": F.coalesce("least_minutes", "most_minutes").isNotNull()}
    every = None
    for by in (["year"], ["minutes"], ["year", "minutes"]):
        some = kinds.filter(limited["year"] if "year" in by else ~limited["year"]).filter(limited["minutes"] if "minutes" in by else ~limited["minutes"])
        # limits on these columns take all rows of one year and length or none, so only the first k of those can be among the first k
        own = top_per_key(titles.select(key, "year", "minutes", "votes").dropna(subset=by), by, order, k).drop("rank")
        if "year" in by:
            some = some.filter(F.coalesce("year_from", F.lit(1870)) <= F.coalesce("year_to", F.lit(2100))).withColumn("decade", F.explode(decades))
            both = some.join(own.withColumn("decade", F.expr("year div 10")), "decade")
        else:
            both = some.crossJoin(own)
        one = both.filter(inside("year", "year_from", "year_to") & inside("minutes", "least_minutes", "most_minutes")).select(*limits, key, "votes")
        every = one if every is None else every.unionByName(one)
    best = top_per_key(every, limits, order, k)
    match = [F.col(f"q.{c}").eqNullSafe(F.col(f"t.{c}")) for c in limits]
    return known.alias("q").join(best.alias("t"), match).select("q.query", F.col(f"t.{key}"), F.col("t.rank"))


def reciprocal_rank_fusion(lists: list[DataFrame], key: str, k: int) -> DataFrame:
    """(query, key, score, sides, rank): ranked lists (query, key, rank) fused by the sum of 1 / (60 + rank)."""
    every = None
    for ranked in lists:
        one = ranked.select("query", key, "rank")
        every = one if every is None else every.unionByName(one)
    fused = every.groupBy("query", key).agg(F.round(F.sum(1.0 / (FUSION + F.col("rank"))), 9).alias("score"), F.count(F.lit(1)).alias("sides"))
    return top_per_key(fused, ["query"], [F.col("score").desc(), F.col(key)], k)


def tiers(frames: list[DataFrame], key: str, k: int) -> DataFrame:
    """(query, key, tier, rank): results of earlier tiers before those of later ones, each result once."""
    every = None
    for n, frame in enumerate(frames):
        one = frame.select("query", key, F.lit(n).alias("tier"), F.col("rank").alias("pos"))
        every = one if every is None else every.unionByName(one)
    once = F.row_number().over(Window.partitionBy("query", key).orderBy("tier", "pos"))
    return top_per_key(every.withColumn("_n", once).filter("_n = 1").drop("_n"), ["query"], [F.col("tier"), F.col("pos"), F.col(key)], k)
