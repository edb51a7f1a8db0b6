"""Files beside the catalogue: exports of watch histories, media files with their probes and subtitles, vector artefacts, caches."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Extensions of videos and subtitles, and what a probe calls languages. Fixed values.
VIDEO = ("mkv", "mp4", "avi", "m4v", "mov", "wmv", "ts", "webm")
SUBTITLE = ("srt", "vtt", "ass", "ssa", "sub")
LANGUAGES = {
    "eng": "en", "fre": "fr", "fra": "fr", "ger": "de", "deu": "de", "ita": "it", "spa": "es", "por": "pt", "rus": "ru", "jpn": "ja", "kor": "ko", "chi": "zh", "zho": "zh", "hin": "hi", "dut": "nl", "nld": "nl",
    "swe": "sv", "dan": "da", "nor": "no", "fin": "fi", "pol": "pl", "english": "en", "french": "fr", "german": "de", "italian": "it", "spanish": "es", "japanese": "ja", "korean": "ko",
}
#: A file of this name under so many bytes is a sample.
SAMPLE_BYTES = 300 << 20


def sniff(head: bytes) -> str:
    """zip, xml, json or csv by the first bytes of a file; csv is what is none of the others."""
    text = head.removeprefix(b"\xef\xbb\xbf").lstrip()
    return "zip" if head[:4] == b"PK\x03\x04" else "xml" if text[:1] == b"<" else "json" if text[:1] in (b"{", b"[") else "csv"


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A quoted CSV file whose columns are named in lower case, whatever the header's case and mark of byte order."""
    rows = spark.read.csv(path, header=True, quote='"', escape='"', multiLine=True)
    return rows.toDF(*[c.lstrip("﻿").strip().lower() for c in rows.columns])


def data_lines(spark: SparkSession, path: str) -> int:
    """Lines of a text file, compressed or not, less the header of each file."""
    lines = spark.read.text(path).select(F.input_file_name().alias("f")).groupBy("f").agg(F.count(F.lit(1)).alias("n"))
    return int(lines.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n")).first().n)


def merged_history(parts: DataFrame) -> DataFrame:
    """(key, title, year, imdb_id, halves, watched, watchlist): the files of exports as one entry per work.

    parts: title, year, imdb_id, rating, scale (its greatest value), watched_on (date), status. Rows of one imdb_id, else of one
    lower-case title and year, are one work; the greatest rating counts, as half stars of five; watch days are sorted and
    distinct; statuses of waiting put a work on the watchlist unless it was watched. A row without title and id is left out.
    """
    named = parts.filter(F.col("imdb_id").isNotNull() | F.col("title").isNotNull())
    key = F.coalesce("imdb_id", F.concat_ws("|", F.lower(F.trim("title")), F.coalesce(F.col("year").cast("string"), F.lit(""))))
    halves = F.round(F.try_divide(F.col("rating") * 10, F.col("scale")))
    waiting = F.lower("status").isin("plan to watch", "watchlist", "planned", "want to watch")
    each = named.select(
        key.alias("key"), "title", "year", "imdb_id", F.when(halves > 0, F.greatest(F.lit(1), F.least(F.lit(10), halves))).cast("int").alias("halves"), "watched_on", F.coalesce(waiting, F.lit(False)).alias("waiting"),
        (F.lower("status") == "completed").alias("completed"),
    )
    merged = each.groupBy("key").agg(
        F.min("title").alias("title"), F.min("year").alias("year"), F.max("imdb_id").alias("imdb_id"), F.max("halves").alias("halves"), F.array_sort(F.collect_set("watched_on")).alias("watched"),
        F.max("waiting").alias("waiting"), F.coalesce(F.max("completed"), F.lit(False)).alias("completed"),
    )
    return merged.select("key", "title", "year", "imdb_id", "halves", "watched", (F.col("waiting") & (F.size("watched") == 0) & ~F.col("completed")).alias("watchlist"))


def probe(text: Column) -> Column:
    """struct(seconds, video_codec, width, height, audio_codec, languages, title) of a probe's JSON; null where it isn't any."""
    stream = "struct<codec_type:string,codec_name:string,width:int,height:int,tags:struct<language:string>>"
    o = F.from_json(text, f"struct<streams:array<{stream}>,format:struct<duration:string,tags:struct<title:string>>>")
    kind = lambda k: F.filter(F.coalesce(o["streams"], F.array().cast(f"array<{stream}>")), lambda s: s["codec_type"] == k)
    video, audio = F.get(kind("video"), F.lit(0)), kind("audio")
    codes = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    two = lambda s: F.coalesce(F.try_element_at(codes, F.lower(s["tags"]["language"])), F.when(F.length(s["tags"]["language"]) == 2, F.lower(s["tags"]["language"])))
    languages = F.array_distinct(F.filter(F.transform(audio, two), lambda x: x.isNotNull()))
    title = o["format"]["tags"]["title"]
    out = F.struct(
        F.round(o["format"]["duration"].try_cast("double")).cast("bigint").alias("seconds"), video["codec_name"].alias("video_codec"), video["width"].alias("width"), video["height"].alias("height"),
        F.get(audio, F.lit(0))["codec_name"].alias("audio_codec"), languages.alias("languages"), F.when(F.trim(title) != "", title).alias("title"),
    )
    return F.when(F.coalesce(o["streams"].isNotNull() | o["format"].isNotNull(), F.lit(False)), out)


def _parts(files: DataFrame, path: str) -> DataFrame:
    name = F.regexp_extract(path, r"([^/\\]*)\z", 1)
    return files.withColumns({
        "_folder": F.regexp_extract(path, r"^(.*?)[^/\\]*\z", 1), "_stem": F.lower(F.regexp_extract(name, r"^(.*?)(?:\.[^.]*)?\z", 1)), "_kind": F.lower(F.regexp_extract(name, r"\.([^.]*)\z", 1)),
    })


def media_files(files: DataFrame, path: str = "path", size: str = "size") -> DataFrame:
    """The files that are videos and neither hidden nor samples: small ones with the word `sample` in their name."""
    own = _parts(files, path)
    sample = (F.col(size) < SAMPLE_BYTES) & F.array_contains(F.split("_stem", "[^a-z0-9]+"), "sample")
    return own.filter(F.col("_kind").isin(*VIDEO) & ~F.col("_stem").startswith(".") & ~F.coalesce(sample, F.lit(False))).drop("_folder", "_stem", "_kind")


def subtitles_beside(files: DataFrame, path: str = "path") -> DataFrame:
    """(video, subtitle, language, forced): subtitle files in a video's folder, or in one within it, that begin with its name; where
    a folder holds one video alone all of them are its. The language is the last word of the name that is one, else the inner
    folder's name."""
    own = _parts(files, path)
    videos = own.filter(F.col("_kind").isin(*VIDEO)).select("_folder", F.col(path).alias("video"), F.col("_stem").alias("stem"))
    videos = videos.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("_folder")))
    subs = own.filter(F.col("_kind").isin(*SUBTITLE)).select(F.col(path).alias("subtitle"), "_stem", F.explode(F.array_distinct(F.array(
        F.struct(F.col("_folder").alias("f"), F.lit(None).cast("string").alias("inner")),
        F.struct(F.regexp_replace("_folder", r"[^/\\]+[/\\]\z", "").alias("f"), F.lower(F.regexp_extract("_folder", r"([^/\\]+)[/\\]\z", 1)).alias("inner")),
    ))).alias("x")).select("subtitle", "_stem", F.col("x.f").alias("_folder"), "x.inner")
    codes = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    code = lambda w: F.coalesce(F.try_element_at(codes, w), F.when(w.rlike("^[a-z]{2}$"), w))
    words = F.split("_stem", r"[._ \-\[\]()]+")
    said = F.element_at(F.filter(F.transform(words, code), lambda x: x.isNotNull()), -1)
    both = videos.join(subs, "_folder").filter((F.col("n") == 1) | F.col("_stem").startswith(F.col("stem")))
    last = F.when(F.size(F.filter(F.transform(words, code), lambda x: x.isNotNull())) > 0, said)
    return both.select("video", "subtitle", F.coalesce(last, code(F.col("inner"))).alias("language"), F.array_contains(words, "forced").alias("forced"))


def subtitle_format(text: Column) -> Column:
    """vtt, ass or srt by how a subtitle file begins and goes on; null if it has no times."""
    body = F.regexp_replace(text, "^﻿", "")
    return F.when(body.startswith("WEBVTT"), "vtt").when(body.rlike(r"(?m)^\s*Dialogue:"), "ass").when(body.rlike(r"\d+:\d+[.,]\d+\s*-->"), "srt")


def ass_cues(files: DataFrame, key: str, text: str) -> DataFrame:
    """(key, n, start_ms, end_ms, words) of the dialogue lines of ASS files; drawing codes are dropped, `\\N` is a line break."""
    lines = files.select(key, F.posexplode(F.split(F.replace(F.col(text), F.lit("\r"), F.lit("")), "\n")).alias("n", "line")).filter(F.trim("line").startswith("Dialogue:"))
    cells = lines.select(key, "n", F.split(F.regexp_replace("line", r"^\s*Dialogue:\s*", ""), ",", 10).alias("c"))
    clock = lambda c: F.round(F.aggregate(F.transform(F.split(F.trim(c), ":"), lambda p: p.try_cast("double")), F.lit(0.0), lambda s, p: s * 60 + p) * 1000).cast("bigint")
    words = F.trim(F.regexp_replace(F.regexp_replace(F.get("c", F.lit(9)), r"\{[^}]*\}", ""), r"\\[Nn]", "\n"))
    return cells.select(key, "n", clock(F.get("c", F.lit(1))).alias("start_ms"), clock(F.get("c", F.lit(2))).alias("end_ms"), words.alias("words")).filter("start_ms is not null and end_ms is not null")


def srt_files(cues: DataFrame, key: str) -> DataFrame:
    """(key, text): cues written as SubRip files, numbered in order of time."""
    time = lambda c: F.format_string("%02d:%02d:%02d,%03d", F.expr(f"{c} div 3600000"), F.expr(f"{c} div 60000 % 60"), F.expr(f"{c} div 1000 % 60"), F.expr(f"{c} % 1000"))
    n = F.row_number().over(Window.partitionBy(key).orderBy("start_ms", "end_ms", "n"))
    block = F.concat(F.col("at").cast("string"), F.lit("\n"), time("start_ms"), F.lit(" --> "), time("end_ms"), F.lit("\n"), F.col("words"), F.lit("\n"))
    made = cues.withColumn("at", n).select(key, "at", block.alias("block"))
    return made.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "block"))), lambda x: x["block"]), "\n").alias("text"))


def trace(text: Column) -> Column:
    """A speech trace, run lengths of silence and speech in turn, as booleans; comment lines and what is no number are left out."""
    kept = F.filter(F.split(text, "\n"), lambda line: ~line.startswith("#"))
    runs = F.filter(F.transform(F.split(F.array_join(kept, " "), r"\s+"), lambda x: x.try_cast("int")), lambda x: x.isNotNull())
    return F.flatten(F.transform(runs, lambda n, i: F.array_repeat(i % 2 == 1, n)))


def write_artefact(vectors: DataFrame, path: str, key: str, vector: str, model: str, builder: int) -> None:
    """Vectors with their keys as Parquet, and beside them a manifest: model, builder version, count, dimensions and a digest."""
    vectors.select(F.col(key).alias("key"), F.col(vector).alias("vector")).write.mode("overwrite").parquet(f"{path}/vectors")
    manifest = {"model": model, "builder": builder, **_digest(vectors.sparkSession.read.parquet(f"{path}/vectors"))}
    vectors.sparkSession.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")


def _digest(stored: DataFrame) -> dict:
    """Count, dimensions and an order-free digest of stored vectors: sums of 32-bit pieces of each row's SHA-256."""
    own = F.sha2(F.concat_ws("|", F.col("key").cast("string"), F.array_join(F.transform("vector", lambda x: x.cast("string")), ",")), 256)
    pieces = [F.sum(F.conv(F.substring(own, 1 + 8 * i, 8), 16, 10).cast("bigint")).alias(f"s{i}") for i in range(4)]
    row = stored.agg(F.count(F.lit(1)).alias("count"), F.min(F.size("vector")).alias("least"), F.max(F.size("vector")).alias("most"), *pieces).first()
    return {"count": row["count"], "dimensions": [row["least"], row["most"]], "digest": "-".join(str(row[f"s{i}"] or 0) for i in range(4))}


def read_artefact(spark: SparkSession, path: str, model: str, builder: int) -> DataFrame:
    """The vectors of an artefact that still is what its manifest says, made by this model and builder; raises otherwise."""
    manifest = json.loads(spark.read.text(f"{path}/manifest").first().value)
    stored = spark.read.parquet(f"{path}/vectors")
    found = {"model": model, "builder": builder, **_digest(stored)}
    if wrong := [k for k in found if manifest.get(k) != found[k]]:
        raise ValueError(f"the artefact differs in {wrong}")
    return stored


def sizes(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes) of the files under a folder, without reading them."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", F.col("length").alias("bytes"))


def put(store: DataFrame, entries: DataFrame, key: str, stored_at: str) -> DataFrame:
    """A cache with further entries: the one stored last counts for each key; of one time the new one."""
    both = store.withColumn("_new", F.lit(0)).unionByName(entries.withColumn("_new", F.lit(1)))
    first = F.row_number().over(Window.partitionBy(key).orderBy(F.col(stored_at).desc_nulls_last(), F.col("_new").desc()))
    return both.withColumn("_n", first).filter("_n = 1").drop("_n", "_new")


def touch(store: DataFrame, keys: DataFrame, key: str, stored_at: str, now: Column) -> DataFrame:
    """A cache whose entries of the given keys count as stored now."""
    asked = keys.select(key).distinct().withColumn("_hit", F.lit(True))
    return store.join(asked, key, "left").withColumn(stored_at, F.when(F.col("_hit"), now).otherwise(F.col(stored_at))).drop("_hit")


def purge(store: DataFrame, state: Column) -> DataFrame:
    """A cache without what has expired by its freshness."""
    return store.filter(~F.coalesce(state == "expired", F.lit(False)))


def serveable(state: Column, offline: Column) -> Column:
    """Fresh answers always, stale ones only offline, expired ones never."""
    return (state == "fresh") | ((state == "stale") & offline)
