"""One consistent form for text that looks the same in different characters.

Three steps. First what draws nothing is deleted and compatibility forms (widths, ligatures, numerals in one character,
encodings of accents, sorts of hyphen and blank) are unified. Then every token becomes a lattice: each letter stands for
all letters of the same shape in any script. At last the path through the lattice with the best score under character
bigrams, counted over the single-script tokens of the whole corpus, with a charge for every change of script, gives the
token's letters. The lattice depends on the shapes only, so tokens that look alike get the same letters, and tokens that
don't, never do. Letter case, accents, punctuation and digits are kept.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.storage import materialize

#: Letters of one shape, the first by which the shape is named. Fixed values.
SHAPES = """
a а|c с|d ԁ|e е|h һ հ|i і|j ј ϳ յ|l ӏ|n ո|o о ο օ|p р|q ԛ զ|s ѕ|u ս|v ѵ ν|w ԝ|x х|y у|g ց
A А Α|B В Β|C С|E Е Ε|H Н Η|I І Ι Ӏ|J Ј Ϳ|K К Κ|M М Μ|N Ν|O О Ο Օ|P Р Ρ|Q Ԛ|S Ѕ|T Т Τ|U Ս|V Ѵ|W Ԝ|X Х Χ|Y Ү Υ|Z Ζ
Г Γ|П Π|Ф Φ
ヘ へ|ロ 口|ニ 二|タ 夕|カ 力|エ 工|ハ 八|ト 卜|オ 才|ー 一
A Ꭺ ꓮ|B Ᏼ ꓐ Ⲃ|C Ꮯ ꓚ Ⲥ|D Ꭰ ꓓ|E Ꭼ ꓰ|F ꓝ|G Ꮐ ꓖ|H Ꮋ ꓧ Ⲏ|I ꓲ Ⲓ|J Ꭻ ꓙ|K Ꮶ ꓗ Ⲕ|L Ꮮ ꓡ|M Ꮇ ꓟ Ⲙ|N ꓠ Ⲛ|O ꓳ Ⲟ|P Ꮲ ꓑ Ⲣ|R Ꮢ ꓣ|S Ꮪ ꓢ|T Ꭲ ꓔ Ⲧ
U ꓴ|V Ꮩ ꓦ|W Ꮃ ꓪ|X ꓫ Ⲭ|Y ꓬ Ⲩ|Z Ꮓ ꓜ Ⲍ|c ᴄ ⲥ|g ɡ|o ᴏ ⲟ|p ⲣ|s ꜱ|v ᴠ|w ᴡ|z ᴢ
"""
MEMBERS: dict[str, str] = {}
SHAPE_OF: dict[str, str] = {}
for _line in SHAPES.split("\n"):
    for _group in filter(None, _line.split("|")):
        _letters = _group.split()
        MEMBERS[_letters[0]] = "".join(dict.fromkeys(MEMBERS.get(_letters[0], "") + "".join(_letters)))
        SHAPE_OF |= dict.fromkeys(_letters, _letters[0])

#: Look-alikes that compatibility normalisation would turn into letters of another look, replaced before it.
BEFORE = {0x3F2: "c", 0x3F9: "C"}
HYPHENS = "‐‑﹣－"
#: What draws nothing: default-ignorable code points and control characters other than white space.
INVISIBLE = regex.compile(r"[\p{Default_Ignorable_Code_Point}\p{Cf}\p{Cc}--[\t\n\v\f\r\x1c-\x1f\x85]]", regex.V1)
BLANKS = regex.compile(r"[\p{White_Space}\x1c-\x1f]+")
TOKEN = regex.compile(r"\p{L}[\p{L}\p{M}]*")
SCRIPT = {s: regex.compile(rf"\p{{{s}}}") for s in ("Latin", "Cyrillic", "Greek", "Armenian", "Katakana", "Hiragana", "Han")}
#: Scripts written together count as one when a change is charged.
FAMILY = {"Katakana": "Japanese", "Hiragana": "Japanese", "Han": "Japanese"}
VOICED = "\u3099\u309a"
#: Charge, in logarithms, for a change of script within a token and from one token to the next.
CHANGE, NEXT = -25.0, -12.0
START = "^"


def fold(text: str) -> str:
    """Compatibility-normalised, decomposed text without what draws nothing; one blank between words, none at the ends."""
    if text.isascii() and text.isprintable():
        return re.sub(" +", " ", text).strip(" ")
    text = unicodedata.normalize("NFKC", INVISIBLE.sub("", text).translate(BEFORE))
    text = INVISIBLE.sub("", text).translate({ord(h): "-" for h in HYPHENS})
    return unicodedata.normalize("NFD", BLANKS.sub(" ", text).strip(" "))


@lru_cache(maxsize=4096)
def script(letter: str) -> str:
    return "Katakana" if letter == "ー" else next((s for s, p in SCRIPT.items() if p.match(letter)), "Other")


def family(letter: str) -> str:
    return FAMILY.get(script(letter), script(letter))


@lru_cache(maxsize=4096)
def symbol(letter: str) -> str:
    """The model's symbol: the letter itself where others share its shape, else its script. So symbols are few."""
    return letter if letter in SHAPE_OF else "*" + script(letter)


def bigrams(token: str) -> list[tuple[str, str]]:
    """Symbol bigrams of a token of one family of scripts; none of others."""
    letters = [c for c in token if not unicodedata.combining(c)]
    if len({family(c) for c in letters}) != 1:
        return []
    signs = [symbol(c) for c in letters]
    return list(zip([START, *signs], signs))


class Model:
    """Smoothed bigram scores. counts has at most (letters in SHAPES + scripts + 1)^2 entries, whatever the corpus."""

    def __init__(self, counts: dict[tuple[str, str], int]) -> None:
        self.counts, self.totals = counts, Counter()
        for (a, _), n in counts.items():
            self.totals[a] += n
        self.kinds = len(SHAPE_OF) + 9

    def score(self, a: str, b: str) -> float:
        return math.log((self.counts.get((a, b), 0) + 0.1) / (self.totals[a] + 0.1 * self.kinds))

    def options(self, token: str) -> dict[str, tuple[float, str]]:
        """Best score and letters of a token by the script family it ends in. Marks stay with their letters."""
        parts = regex.findall(r"\p{L}\p{M}*", token)
        if not any(p[0] in SHAPE_OF for p in parts):
            return {family(parts[-1][0]): (0.0, token)}
        paths = {START: (0.0, "")}
        for part in parts:
            own = MEMBERS.get(SHAPE_OF.get(part[0], ""), part[0])
            if any(c in VOICED for c in part):  # a voicing mark stands on kana only
                own = "".join(c for c in own if script(c) in ("Katakana", "Hiragana")) or own
            after: dict[str, tuple[float, str]] = {}
            for letter in own:
                ways = []
                for before, (score, text) in paths.items():
                    charge = CHANGE if before != START and family(before) != family(letter) else 0.0
                    sign = START if before == START else symbol(before)
                    ways.append((-(score + self.score(sign, symbol(letter)) + charge), text + letter + part[1:]))
                cost, text = min(ways)
                after[letter] = (-cost, text)
            paths = after
        best: dict[str, tuple[float, str]] = {}
        for letter, (score, text) in paths.items():
            best[family(letter)] = max(best.get(family(letter), (-math.inf, "")), (score, text))
        return best

    def form(self, text: str, options) -> str:
        """The letters of the best path through a whole text; options is options(), or a cache of it."""
        tokens = TOKEN.findall(text)
        paths: dict[str, tuple] = {START: (0.0, None)}  # score and back pointer (letters, pointer)
        for token in tokens:
            after = {}
            for end, (own, letters) in options(token).items():
                ways = [(score + own + (NEXT if before not in (START, end) else 0.0), before) for before, (score, _) in paths.items()]
                score, before = max(ways)
                after[end] = (score, (letters, paths[before][1]))
            paths = after
        chosen, pointer = [], paths[max(paths, key=lambda end: (paths[end][0], end))][1]
        while pointer:
            chosen.append(pointer[0])
            pointer = pointer[1]
        return TOKEN.sub(lambda m: chosen.pop(), text)


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        tokens = Counter(t for text in batch["folded"].dropna() for t in TOKEN.findall(text))
        counts: Counter = Counter()
        for token, n in tokens.items():
            for pair in bigrams(token):
                counts[pair] += n
        yield pd.DataFrame([(a, b, n) for (a, b), n in counts.items()], columns=["a", "b", "n"])


def folded(column: Column) -> Column:
    """fold() of each text; null stays null."""
    def run(text: pd.Series) -> pd.Series:
        return text.map(lambda x: None if x is None else fold(x))

    return F.pandas_udf(run, "string")(column)


def fit(texts: DataFrame, column: str) -> Model:
    """The bigram model of all single-script tokens of a column that holds folded text."""
    counted = texts.select(F.col(column).alias("folded")).mapInPandas(_count, "a string, b string, n bigint").groupBy("a", "b").agg(F.sum("n").alias("n"))
    return Model({(r.a, r.b): r.n for r in counted.collect()})  # bounded: see Model


def shape(column: Column) -> Column:
    """A folded text with every letter as its shape, in the JVM: texts have one form exactly if they have one shape."""
    return F.translate(column, "".join(SHAPE_OF), "".join(SHAPE_OF.values()))


def canonical(model: Model, column: Column) -> Column:
    """The one form of a folded text, composed; null stays null. A task's tokens are searched once each."""

    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        options = lru_cache(maxsize=200_000)(model.options)
        for text in texts:
            yield text.map(lambda x: None if x is None else unicodedata.normalize("NFC", model.form(x, options)))

    return F.pandas_udf(run, "string")(column)


def unify(texts: DataFrame, column: str, output: str = "form") -> DataFrame:
    """texts with `output`: the consistent form of `column`, under a model counted over all its rows.

    Null gives null; text that draws nothing gives ''. Repeated rows weigh in the counts as often as they stand.
    """
    names = materialize(texts.withColumn("_folded", folded(F.col(column))), "folded")
    return names.withColumn(output, canonical(fit(names, "_folded"), F.col("_folded"))).drop("_folded")


def alike_pairs(names: DataFrame, item: str, name: str) -> DataFrame:
    """(item_a, item_b), a < b: different items with names of the same look but not of the same characters.

    Names are reduced to distinct ones per item; null names and names that draw nothing are no names. Every distinct spelling
    is folded once, and only spellings whose shape has several go through the lattice. Spellings are paired first, once per
    pair of spellings, then each spelling's items are looked up: items that share a spelling are never compared, so a name
    that many items share makes no more pairs than it has rows in the result.
    """
    own = names.select(F.col(item).alias("item"), F.col(name).alias("name")).filter(F.col("item").isNotNull() & F.col("name").isNotNull())
    own = materialize(own.distinct(), "names")
    spellings = materialize(own.select("name").distinct().withColumn("folded", folded(F.col("name"))).withColumn("shape", shape(F.col("folded"))), "spellings")
    model = fit(spellings, "folded")
    several = spellings.filter(F.col("shape") != "").groupBy("shape").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1).select("shape")
    forms = materialize(spellings.join(several, "shape", "left_semi").select("name", canonical(model, F.col("folded")).alias("form")), "forms")
    pairs = forms.withColumnRenamed("name", "name_a").join(forms.withColumnRenamed("name", "name_b"), "form").filter(F.col("name_a") < F.col("name_b"))
    one = own.select(F.col("name").alias("name_a"), F.col("item").alias("x"))
    two = own.select(F.col("name").alias("name_b"), F.col("item").alias("y"))
    items = pairs.select("name_a", "name_b").join(one, "name_a").join(two, "name_b").filter(F.col("x") != F.col("y"))
    return items.select(F.least("x", "y").alias("item_a"), F.greatest("x", "y").alias("item_b")).distinct()
