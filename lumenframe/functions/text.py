"""Scalar text functions: normal forms of names, readings of queries, excerpts, cache keys. All are column expressions,
except the folding of accents in every script, which is an Arrow function."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Accented letters of Latin-1 and their plain ones, position by position. Fixed values.
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyy"
NOT_WORD = r"[^\p{L}\p{N}]+"


def fold_accents(text: Column) -> Column:
    """Text without combining marks, in any script."""

    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda x: None if x is None else x if x.isascii() else "".join(c for c in unicodedata.normalize("NFD", x) if unicodedata.category(c)[0] != "M"))

    return F.pandas_udf(run, "string")(text)


def normalise_title(text: Column) -> Column:
    """Folded, lower case, every run of other characters one blank, trimmed."""
    return F.trim(F.regexp_replace(F.lower(fold_accents(text)), NOT_WORD, " "))


def comparable(text: Column) -> Column:
    """Comparable form: Latin folds, & as and, apostrophes dropped, punctuation as blanks."""
    low = F.translate(F.lower(text), ACCENTED, PLAIN)
    return F.trim(F.regexp_replace(F.regexp_replace(F.replace(low, F.lit("&"), F.lit(" and ")), "['’]", ""), r"[^\p{L}\p{N}]+", " "))


def import_form(text: Column) -> Column:
    """Normal form of imported names: no leading article, hyphens as blanks, & as and; accents stay."""
    low = F.replace(F.replace(F.lower(F.trim(text)), F.lit("-"), F.lit(" ")), F.lit("&"), F.lit("and"))
    return F.regexp_replace(F.trim(F.regexp_replace(low, r"\s+", " ")), "^the ", "")


def words(text: Column) -> Column:
    """Lower-case words of a text."""
    return F.filter(F.split(F.lower(text), NOT_WORD), lambda w: w != "")


def season_split(title: Column) -> Column:
    """struct(base, season): a season mark at the end of a title taken off."""
    mark = r"(?i)[\s:(]+(?:season (\d+)|(\d+)(?:st|nd|rd|th) season|part (\d+))\)?\s*$"
    season = F.coalesce(*[F.nullif(F.regexp_extract(title, mark, i), F.lit("")) for i in (1, 2, 3)]).cast("int")
    roman = F.regexp_extract(title, r"\s(II|III|IV|V)\s*$", 1)
    numeral = F.when(roman == "II", 2).when(roman == "III", 3).when(roman == "IV", 4).when(roman == "V", 5)
    base = F.when(season.isNotNull(), F.regexp_replace(title, mark, "")).when(numeral.isNotNull(), F.regexp_replace(title, r"\s(II|III|IV|V)\s*$", "")).otherwise(title)
    return F.struct(base.alias("base"), F.coalesce(season, numeral).alias("season"))


def franchise_key(title: Column) -> Column:
    """The head of a title before a colon or dash, without a leading article and sequel marks: its first two words."""
    head = F.regexp_replace(F.lower(title), r"(?::| - ).*$", "")
    bare = F.regexp_replace(F.regexp_replace(F.trim(head), r"^the ", ""), r" (?:\d+|ii|iii|iv|v)$", "")
    return F.array_join(F.slice(F.split(F.trim(bare), r"\s+"), 1, 2), " ")


#: Spelled durations in minutes. Fixed values.
DURATIONS = {"half an hour": 30, "an hour and a half": 90, "hour and a half": 90, "an hour": 60, "one hour": 60, "two hours": 120, "three hours": 180, "four hours": 240}
_UNTIL = r"(?:,| in | from | under | over | with | about |$)"
_DECADE_LONG, _DECADE_SHORT = r"(?:^|[^0-9])([0-9]{3}0)s", r"(?:^|[^0-9])([0-9])0s"
_SPAN = r"(half an hour|an hour and a half|hour and a half|an hour|one hour|two hours|three hours|four hours|[0-9]+ ?(?:minutes|minute|mins|min|hours|hour|hrs|h)(?:[^a-z]|$))"
_UNDER, _OVER = rf"(?:under|less than|shorter than|below) {_SPAN}", rf"(?:over|more than|longer than|above) {_SPAN}"


def query_reading(text: Column) -> Column:
    """struct(director, year_from, year_to, least_minutes, most_minutes, rest) of a search in words.

    Of every marker only the first occurrence is read, directors first, then years, then lengths: a director after "directed
    by" up to a comma or the next marker; "between a and b", a decade ("1990s" or "90s", under 30 of this century), "before",
    "after" or "since" a year, or "in", "from" or "of" one, from 1870 to 2100; "under" or "over" a length in figures or words.
    """
    # each step is bound once as the element of an array, so that no expression is repeated in the next
    bind = lambda value, step: F.get(F.transform(F.array(value), step), F.lit(0))
    director = lambda low: F.nullif(F.trim(F.regexp_extract(low, rf"directed by (.+?){_UNTIL}", 1)), F.lit(""))
    return bind(F.lower(text), lambda low: bind(F.struct(low.alias("low"), director(low).alias("director")), _after_director))


def _after_director(read: Column) -> Column:
    director = read["director"]
    after_director = F.when(director.isNotNull(), F.regexp_replace(read["low"], rf"directed by .+?(?={_UNTIL})", " ")).otherwise(read["low"])
    take = lambda pattern, i=1: F.nullif(F.regexp_extract(after_director, pattern, i), F.lit(""))
    sound = lambda y: F.when(y.between(1870, 2100), y)
    number = lambda pattern, i=1: sound(take(pattern, i).cast("int"))
    pair = r"between ([0-9]{4}) and ([0-9]{4})"
    short = take(_DECADE_SHORT).cast("int")
    decade = F.coalesce(number(_DECADE_LONG), F.when(short < 3, 2000 + short * 10).otherwise(1900 + short * 10))
    before, after, since, year = (number(rf"(?:^|[^a-z]){w} ([0-9]{{4}})(?:[^0-9]|$)") for w in ("before", "after", "since", "(?:in|from|of)"))
    low_year = F.coalesce(number(pair, 1), decade, after + 1, since, year)
    kinds = [number(pair, 2), decade + 9, before - 1, year]
    high_year = F.when(number(pair, 1).isNotNull(), kinds[0]).when(decade.isNotNull(), kinds[1]).when(before.isNotNull(), kinds[2]).when(after.isNotNull() | since.isNotNull(), None).otherwise(kinds[3])
    words = F.create_map(*[F.lit(x) for item in DURATIONS.items() for x in item])

    def minutes(pattern: str) -> Column:
        span = take(pattern)
        n = F.regexp_extract(span, "^([0-9]+)", 1).try_cast("int")
        return F.coalesce(F.try_element_at(words, F.trim(span)), F.when(span.rlike("^[0-9]+ ?h"), n * 60).otherwise(n))

    rest = after_director
    for pattern in (pair, _DECADE_LONG, _DECADE_SHORT, r"(?:^|[^a-z])(?:before|after|since|in|from|of) [0-9]{4}(?:[^0-9]|$)", _UNDER, _OVER):
        rest = F.regexp_replace(rest, pattern, " ")
    rest = F.trim(F.regexp_replace(rest, r"[\s,]+", " "))
    return F.struct(
        director.alias("director"), low_year.alias("year_from"), high_year.alias("year_to"), minutes(_OVER).alias("least_minutes"),
        minutes(_UNDER).alias("most_minutes"), rest.alias("rest"),
    )


def excerpt(text: Column, most: int = 220) -> Column:
    """The text's beginning: whole where short, else cut at a word before `most` characters, with an ellipsis."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    cut = F.regexp_replace(F.substring(flat, 1, most), r"\s\S*$", "")
    return F.when(F.length(flat) <= most, flat).otherwise(F.concat(cut, F.lit("…")))


def cache_key(url: Column, secrets: tuple[str, ...] = ("api_key", "token", "key")) -> Column:
    """A URL without its secret query parameters."""
    parts = F.split(url, r"\?", 2)
    kept = F.filter(F.split(F.get(parts, F.lit(1)), "&"), lambda p: ~F.split(p, "=")[0].isin(*secrets))
    return F.when(F.size(parts) < 2, url).otherwise(F.when(F.size(kept) == 0, parts[0]).otherwise(F.concat_ws("?", parts[0], F.array_join(kept, "&"))))


def clock_seconds(clock: Column) -> Column:
    """h:m:s, m:s or seconds as whole seconds; null where a part is no number."""
    return F.aggregate(F.transform(F.split(clock, ":"), lambda p: p.try_cast("double")), F.lit(0.0), lambda acc, p: acc * 60 + p).cast("bigint")


def dice(a: Column, b: Column) -> Column:
    """Dice coefficient of two word arrays as multisets."""
    each = F.array_distinct(F.concat(a, b))
    count = lambda words, w: F.size(F.filter(words, lambda x: x == w))
    both = F.aggregate(F.transform(each, lambda w: F.least(count(a, w), count(b, w))), F.lit(0), lambda acc, n: acc + n)
    return F.when(F.size(a) + F.size(b) == 0, F.lit(0.0)).otherwise(2 * both / (F.size(a) + F.size(b)))
