"""Scalar rules of playback, ratings, labels and hashing. Column expressions, except where 64-bit arithmetic must wrap: there
Arrow functions in numpy."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words before a full stop that end no sentence; one letter alone doesn't either. Fixed values.
ABBREVIATIONS = ("Dr", "Mr", "Mrs", "Ms", "St", "Jr", "Sr", "vs", "No", "Mt")
#: Bytes hashed at either end of a file.
FILE_END = 64 * 1024
_GOLDEN, _MIX_1, _MIX_2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def hardware_tier(memory_mb: Column, cores: Column, decodes: Column, gpu: Column) -> Column:
    """modest under 8 GB, up to two cores or without hardware decoding; capable from 16 GB, six cores and a GPU; else standard."""
    modest = (memory_mb < 8 * 1024) | ~decodes | (cores <= 2)
    return F.when(modest, "modest").when((memory_mb >= 16 * 1024) & (cores >= 6) & gpu, "capable").otherwise("standard")


def finished(position: Column, duration: Column) -> Column:
    """Whether whole seconds of position reach 95 hundredths of the duration, by integer division; an unknown duration never."""
    return F.coalesce((duration > 0) & (position >= F.floor(duration * 95 / 100)), F.lit(False))


def playback_outcome(played: Column, stopped_at: Column, duration: Column) -> Column:
    """skim under a minute; completed at nine tenths or within five minutes of the end; else abandoned."""
    done = (duration > 0) & ((stopped_at >= 0.9 * duration) | (duration - stopped_at <= 300))
    return F.when(played < 60, "skim").when(F.coalesce(done, F.lit(False)), "completed").otherwise("abandoned")


def resume_point(position: Column, duration: Column) -> Column:
    """Where to go on: nowhere in the first ten seconds or the last three minutes; an unknown duration has no end."""
    return F.when((position >= 10) & F.coalesce(position <= duration - 180, F.lit(True)), position)


def local_hour(unix_seconds: Column, offset: Column) -> Column:
    return F.floor(F.pmod(unix_seconds + offset, F.lit(86_400)) / 3600).cast("int")


def next_local_one(unix_seconds: Column, offset: Column) -> Column:
    """The next 01:00 of local time after an instant, in unix seconds."""
    since_one = F.pmod(unix_seconds + offset - 3600, F.lit(86_400))
    return unix_seconds - since_one + 86_400


def thousands(n: Column) -> Column:
    return F.format_number(n, 0)


def numbering(season: Column, episode: Column) -> Column:
    """`S1 E2`, with what is known."""
    return F.concat_ws(" ", F.concat(F.lit("S"), season.cast("string")), F.concat(F.lit("E"), episode.cast("string")))


def episode_name(title: Column) -> Column:
    """A trimmed episode title; null if it is empty or only says which number it has."""
    own = F.trim(title)
    return F.when((own != "") & ~own.rlike(r"^Episode[ #]*[0-9.]+\z"), own)


def first_sentence(text: Column, most: int) -> Column:
    """Up to the first `.`, `!` or `?` before a blank, an abbreviation's full stop aside; longer ones are cut at a word."""
    own = F.trim(text)
    no_end = "|".join(["[^ ]", *ABBREVIATIONS])
    found = F.regexp_extract(own, rf"(?s)^(.*?(?:[!?]|(?<!(?:^| )(?:{no_end}))\.))(?= )", 1)
    sentence = F.when(found != "", found).otherwise(own)
    head = F.substring(sentence, 1, most)
    cut = F.regexp_replace(F.when(head.contains(" "), F.regexp_replace(head, r"(?s) [^ ]*\z", "")).otherwise(head), r"[,;:]+\z", "")
    return F.when(F.length(sentence) <= most, sentence).otherwise(F.concat(cut, F.lit("…")))


def same_language(a: Column, b: Column) -> Column:
    """Whether two language tags have one primary part; an empty tag has none."""
    primary = lambda c: F.lower(F.split(c, "[-_]")[0])
    return (a != "") & (primary(a) == primary(b))


def halves(out_of_ten: Column) -> Column:
    """Half stars of a rating from 0 to 10, of which 0 is none."""
    return F.when(out_of_ten > 0, F.greatest(F.lit(1), F.least(F.lit(10), F.round(out_of_ten)))).cast("int")


def year_of(text: Column) -> Column:
    """The year at the beginning of a text, from 1878 to 2100."""
    year = F.substring(text, 1, 4).try_cast("int")
    return F.when(year.between(1878, 2100), year)


def length_band(minutes: Column) -> Column:
    return F.when(minutes < 90, "short").when(minutes < 130, "middle").when(minutes.isNotNull(), "long")


def abandon_weight(at: Column, runtime: Column) -> Column:
    """-0.6 for a title left at once, up to -0.1 at its end; an unknown runtime is 6,000 seconds."""
    known = F.when(runtime > 0, runtime).otherwise(6000.0)
    return -0.6 + 0.5 * F.greatest(F.lit(0.0), F.least(F.lit(1.0), at / known))


def pooled(tokens: Column, mask: Column | None = None) -> Column:
    """A text's unit vector from its token vectors: the first without a mask, else the mean of those the mask keeps."""
    if mask is None:
        raw = F.get(tokens, F.lit(0))
    else:
        kept = F.filter(F.arrays_zip(tokens.alias("t"), mask.alias("m")), lambda x: F.coalesce(x["m"], F.lit(0)) != 0)
        kept = F.transform(kept, lambda x: x["t"])
        total = F.aggregate(kept, F.transform(F.get(tokens, F.lit(0)), lambda _: F.lit(0.0)), lambda s, t: F.zip_with(s, t, lambda a, b: a + b))
        raw = F.transform(total, lambda x: x / F.greatest(F.size(kept), F.lit(1)))
    norm = F.greatest(F.sqrt(F.aggregate(raw, F.lit(0.0), lambda s, x: s + x * x)), F.lit(1e-12))
    return F.transform(raw, lambda x: x / norm)


def mixed(x: np.ndarray) -> np.ndarray:
    """SplitMix64 of unsigned 64-bit numbers."""
    x = x + _GOLDEN
    x = (x ^ (x >> np.uint64(30))) * _MIX_1
    x = (x ^ (x >> np.uint64(27))) * _MIX_2
    return x ^ (x >> np.uint64(31))


def mixed_modulo(x: Column, n: int) -> Column:
    """SplitMix64 of a number modulo n."""

    def run(values: pd.Series) -> pd.Series:
        return pd.Series((mixed(values.to_numpy(dtype=np.int64).view(np.uint64)) % np.uint64(n)).astype(np.int64), index=values.index)

    return F.when(x.isNotNull(), F.pandas_udf(run, "bigint")(F.coalesce(x, F.lit(0)).cast("bigint")))


def user_part(user: Column) -> Column:
    """tune, test or build: which part of an evaluation a user belongs to."""
    at = mixed_modulo(user, 10)
    return F.when(at == 0, "tune").when(at == 1, "test").when(at.isNotNull(), "build")


def held_out(user: Column, item: Column) -> Column:
    """Whether a like is among the fifth held out; both numbers have 32 bits."""
    return mixed_modulo(F.shiftleft(user.cast("bigint"), 32).bitwiseOR(item.cast("bigint")), 5) == 0


class Draws:
    """Numbers that depend on a seed only, the same on every machine: uniform, normal, gamma and beta."""

    def __init__(self, seed: int) -> None:
        self.seed, self.used = np.uint64(seed & 0xFFFFFFFFFFFFFFFF), 0

    def uniform(self, n: int) -> np.ndarray:
        """n numbers in (0, 1)."""
        at = np.arange(self.used + 1, self.used + n + 1, dtype=np.uint64)
        self.used += n
        return ((mixed(self.seed + at * _GOLDEN) >> np.uint64(11)).astype(float) + 0.5) / (1 << 53)

    def normal(self, n: int) -> np.ndarray:
        """By Box and Muller."""
        u = self.uniform(2 * n).reshape(2, n)
        return np.sqrt(-2 * np.log(u[0])) * np.cos(2 * np.pi * u[1])

    def gamma(self, shape: float, n: int) -> np.ndarray:
        """By Marsaglia and Tsang; a shape under 1 is taken from the next one."""
        if shape < 1:
            return self.gamma(shape + 1, n) * self.uniform(n) ** (1 / shape)
        d = shape - 1 / 3
        out, todo = np.empty(n), np.arange(n)
        while len(todo):
            x = self.normal(len(todo))
            v = (1 + x / np.sqrt(9 * d)) ** 3
            with np.errstate(invalid="ignore", divide="ignore"):
                good = (v > 0) & (np.log(self.uniform(len(todo))) < 0.5 * x * x + d - d * v + d * np.log(v))
            out[todo[good]] = d * v[good]
            todo = todo[~good]
        return out

    def beta(self, a: float, b: float, n: int) -> np.ndarray:
        x = self.gamma(a, n)
        return x / (x + self.gamma(b, n))


def file_hash(size: Column, head: Column, tail: Column, end: int = FILE_END) -> Column:
    """16 hex digits: the size and all little-endian words of a file's first and last bytes, summed with wrapping; null for
    files under twice that many bytes. A last word that is short is filled with zeros."""

    def words(data: bytes | None) -> np.uint64:
        data = data or b""
        return np.frombuffer(data + b"\0" * (-len(data) % 8), dtype="<u8").sum(dtype=np.uint64)

    def run(sizes: pd.Series, heads: pd.Series, tails: pd.Series) -> pd.Series:
        with np.errstate(over="ignore"):
            return pd.Series([None if n is None or n != n or n < 2 * end else f"{int(np.uint64(n) + words(h) + words(t)):016x}" for n, h, t in zip(sizes, heads, tails)])

    return F.pandas_udf(run, "string")(size, head, tail)


def validator_state(cached: Column, known: Column, status: Column, current: Column) -> Column:
    """Whether a stored answer still stands by its ETag or date: stale without one, unknown if the source gives none or fails."""
    answered = status.between(200, 299) & current.isNotNull()
    return F.when(~cached | known.isNull(), "stale").when(~F.coalesce(answered, F.lit(False)), "unknown").when(current == known, "current").otherwise("stale")
