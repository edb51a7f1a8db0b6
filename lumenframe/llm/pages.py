"""Keyword-stuffed and link-list pages, by a hidden Markov model over the lines of a text.

A text is cut into lines, lines into sentences and long ones into runs of a few words. Each such segment is in one of the
states prose, facts (casts, credits, dates: lists that are no spam), link list, tag list (keywords and tags) and menu (product
lists, navigation). A segment emits its words, hashed whole into a fixed number of buckets, and signs of its form. The
emissions are not given: segments whose form alone tells their state start the counts over the whole corpus, then all texts
are decoded and counted again, round by round. A page is flagged by the share of its characters in link-list, tag-list and
menu segments.

Texts are tokenised once, in numpy over the code points of many texts at a time; only pieces that hold a sign of a link, tag
or price pass through a pattern. The rounds read bucket numbers, all texts of a batch side by side. What the driver holds is
one table of states by buckets, whatever the corpus.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.storage import materialize

PROSE, FACTS, LINKS, TAGS, MENU = range(5)
STATES = 5
UNKNOWN = STATES
BUCKETS = 1 << 14
RUN = 8
ROUNDS = 2
STAY = 0.8
#: Words remembered by a task with their buckets. Code points worked on together, at least a text's.
KNOWN_WORDS, TOGETHER = 500_000, 1 << 18
#: Times a word stands in a text from which on it is repeated.
OFTEN = 4
#: A text of one piece with fewer words shows no list by its form: it emits SHORT in place of form, and its words decide.
LEAST_WORDS = 6
START_PROSE = 0.9
#: Share of a state's emissions that follows the whole corpus, so that unseen words speak for no state.
BACKGROUND = 0.05
LINK, TAG, YEAR, NUMBER, PRICE, CODE, SENTENCE, OPEN, CAPITALS, SOME_CAPITALS, LOWER, LABEL, REPEATED, SEPARATED, SHORT, FIRST = range(16)

DOMAIN = r"[^\W_][\w\-]*(?:\.[\w\-]+)*(?: ?\[\.\] ?| dot |\.)(?:[a-z]{2,})(?:[/?]\S*)?(?![\w])"
#: Words of pieces that hold a sign of a link, tag or price.
WORD = re.compile(rf"\w+://\S+|{DOMAIN}|#\w+|[$€£]?\d+[.,]\d\d(?!\.?\d)[$€£]?|-?\d+ ?%|[^\W_]+(?:['’\-][^\W_]+)*")
NUMERIC = re.compile(r"[$€£]?-?\d[\d.,]* ?[%$€£]?")
DATE = re.compile(r"\d+[./]\d+[./]\d+")
ARTICLE = re.compile(r"[A-Z]{2,}-?\d{3,}")
LEET = str.maketrans("013457", "oieast")

#: What a code point is, as bits.
ALNUM, DIGIT, UPPER, SPACE, GONE, NEWLINE, ENDS, CLOSES, SIGN, JOINS, DOTS, BARS = (1 << i for i in range(12))
_OF = {"\n\r": NEWLINE, ".!?…": ENDS | CLOSES, "\"»”": CLOSES, "#%$€£": SIGN, "'’-": JOINS, ".,": DOTS, "|/>»·•": BARS}
_OF |= {"\u200b\u200c\u200d\u200e\u200f\u2060\ufeff\u00ad\u034f\ufe0e\ufe0f": GONE}
#: Base of the words' hash and its inverse modulo 2^64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
_MASK = (1 << 64) - 1


class _Points:
    """Kind and plain letter of every code point; the first plane at once, others when they are met."""

    def __init__(self) -> None:
        self.kind, self.plain = np.zeros(0x110000, dtype=np.uint16), np.arange(0x110000, dtype=np.uint32)
        self.more: set[int] = set()
        self.fill(range(0x10000))
        for letters, bits in _OF.items():
            self.kind[[ord(c) for c in letters]] |= bits

    def fill(self, points: Iterable[int]) -> None:
        for i in points:
            c = chr(i)
            self.kind[i] |= ALNUM * c.isalnum() | DIGIT * c.isdecimal() | UPPER * c.isupper() | SPACE * c.isspace()
            if c.isalnum():
                self.plain[i] = ord((unicodedata.normalize("NFKC", c).lower() or c)[0].translate(LEET))

    def see(self, code: np.ndarray) -> None:
        new = set(np.unique(code[code > 0xFFFF]).tolist()) - self.more
        self.fill(new)
        self.more |= new


_points = lru_cache(maxsize=1)(_Points)


@lru_cache(maxsize=1)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """The first powers of BASE and of INVERSE, from the first on."""
    return tuple(np.multiply.accumulate(np.full(size, x, dtype=np.uint64)) for x in (BASE, INVERSE))


def _bucket(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (FIRST + (h ^ (h >> np.uint64(32))) % np.uint64(BUCKETS - FIRST)).astype(np.int32)


def token(word: str) -> int:
    """The bucket of a word; links, tags, years, other numbers, article codes and prices have their own."""
    if word[0] == "#":
        return TAG
    if word[-1].isdigit() and ARTICLE.fullmatch(word):
        return CODE
    if "." in word[1:] or " dot " in word or "://" in word:
        if "://" in word or " dot " in word or "[" in word or any(c.isalpha() for c in word):
            return LINK
    if NUMERIC.fullmatch(word):
        if word[-1] in "%$€£" or word[0] in "$€£-" or "." in word or "," in word:
            return PRICE
        return YEAR if len(word) == 4 else NUMBER
    points = _points()
    points.see(np.array([ord(c) for c in word]))
    h, power = 0, 1
    for c in word:
        h, power = (h + int(points.plain[ord(c)]) * power) & _MASK, power * BASE & _MASK
    return int(_bucket(np.array([h], dtype=np.uint64))[0])


class Known(dict):
    """Buckets of words met before."""

    def __missing__(self, word: str) -> int:
        self[word] = bucket = token(word)
        return bucket


def _at(mask: np.ndarray) -> np.ndarray:
    return np.flatnonzero(mask)


def _part_of(starts: np.ndarray, positions: np.ndarray) -> np.ndarray:
    return np.searchsorted(starts, positions, side="right") - 1


class _Pieces:
    """The sentences and lines of some texts: where they stand, and which text holds them."""

    def __init__(self, texts: list[str]) -> None:
        points = _points()
        whole = "\n" + "\n".join(texts) + "\n"
        code = np.frombuffer(whole.encode("utf-32-le"), dtype=np.uint32)
        starts = 1 + np.concatenate([[0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)[:-1]])
        points.see(code)
        kind = points.kind.take(code)
        if (gone := (kind & GONE) != 0).any():
            starts -= np.concatenate([[0], np.cumsum(gone)])[starts]
            code, kind = code[~gone], kind[~gone]
            whole = code.tobytes().decode("utf-32-le")
        self.whole, self.code, self.kind, self.plain = whole, code, kind, points.plain
        space = (kind & SPACE) != 0
        begin, last = _at(space[:-1] & ~space[1:]) + 1, _at(~space[:-1] & space[1:])
        lines = _at((kind & NEWLINE) != 0)
        new = np.ones(len(begin), dtype=bool)
        if len(begin):
            new[1:] = (np.searchsorted(lines, begin[1:]) > np.searchsorted(lines, last[:-1])) | ((kind[last[:-1]] & ENDS) != 0)
        self.start = begin[new]
        self.last = last[np.append(_at(new)[1:] - 1, len(begin) - 1)] if len(begin) else last
        self.text = _part_of(starts, self.start)

    def holding(self, positions: np.ndarray) -> np.ndarray:
        """Whether each piece holds any of the positions, which lie within pieces."""
        out = np.zeros(len(self.start), dtype=bool)
        out[_part_of(self.start, positions)] = True
        return out

    def words(self, known: Known) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(piece, bucket, capital) of all words in order, with flags of the pieces: self.label, self.bars."""
        code, kind = self.code, self.kind
        alnum = (kind & ALNUM) != 0
        word = alnum.copy()
        word[1:-1] |= alnum[:-2] & alnum[2:] & ((kind[1:-1] & JOINS) != 0)
        begin, end = _at(~word[:-1] & word[1:]) + 1, _at(word[:-1] & ~word[1:]) + 1
        length = end - begin
        blank = code == 32
        alone = blank[begin - 1] & blank[np.minimum(end, len(code) - 1)]

        def spelt(w: str) -> np.ndarray:
            """Where the word w stands between blanks."""
            at = begin[alone & (length == len(w))]
            return at[np.logical_and.reduce([code[at + i] == ord(c) for i, c in enumerate(w)])]

        inner = alnum | (code == 95)
        dots = _at((kind & DOTS) != 0)
        dots = dots[(inner[dots - 1] | (code[dots - 1] == 93)) & inner[dots + 1]]
        colons, brackets, bars = _at(code == 58), _at(code == 91), _at((kind & BARS) != 0)
        links = colons[(code[colons + 1] == 47) & (code[np.minimum(colons + 2, len(code) - 1)] == 47)]
        signs = [_at((kind & SIGN) != 0), dots, links, brackets[code[brackets + 1] == 46], spelt("dot")]
        special = self.holding(np.concatenate(signs))
        hyphens = _at(code == 45)
        self.label = self.holding(np.concatenate([colons[blank[colons + 1]], hyphens[blank[hyphens - 1] & blank[hyphens + 1]], spelt("as")])) | (code[self.last] == 41)
        for p in _at((kind[self.start] & DIGIT) != 0).tolist():
            self.label[p] |= DATE.match(self.whole, int(self.start[p])) is not None
        between = bars[blank[bars - 1] & blank[bars + 1]]
        self.bars = np.bincount(_part_of(self.start, between), minlength=len(self.start))

        piece = _part_of(self.start, begin)
        up, down = _powers(max(2 * TOGETHER, 1 << int(len(code)).bit_length()))
        sums = np.cumsum(self.plain.take(code) * up[: len(code)])
        bucket = _bucket((sums[end - 1] - sums[begin - 1]) * down[begin])
        digits = np.bincount(_part_of(begin, _at((kind & DIGIT) != 0)), minlength=len(begin)) if len(begin) else length
        bucket[digits == length] = NUMBER
        bucket[(digits == 4) & (length == 4)] = YEAR
        for i in _at((digits >= 3) & (digits < length) & (code[begin] < 91) & (code[begin] > 64)).tolist():
            if ARTICLE.fullmatch(self.whole, int(begin[i]), int(end[i])):
                bucket[i] = CODE
        capital = (kind[begin] & UPPER) != 0
        if not special.any():
            return piece, bucket, capital
        more: tuple[list, list, list] = ([], [], [])
        for p in _at(special).tolist():
            for w in WORD.findall(self.whole, int(self.start[p]), int(self.last[p]) + 1):
                for values, value in zip(more, (p, known[w], w[0].isupper())):
                    values.append(value)
        plain = ~special[piece]
        piece, bucket, capital = (np.concatenate([x[plain], np.array(y, dtype=x.dtype)]) for x, y in zip((piece, bucket, capital), more))
        order = np.argsort(piece, kind="stable")
        return piece[order], bucket[order], capital[order]


def _group_counts(groups: np.ndarray, buckets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How often each word's bucket stands in its group, for every word; and the number of distinct buckets per group."""
    both = groups.astype(np.int64) * BUCKETS + buckets
    distinct, at, n = np.unique(both, return_inverse=True, return_counts=True)
    return n[at], np.bincount(distinct // BUCKETS, minlength=int(groups[-1]) + 1 if len(groups) else 0)


def segments(texts: list[str], known: Known) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all segments of the texts, one after another: their buckets, how many each has, its characters, its state by form
    and its text."""
    pieces = _Pieces(texts)
    piece, bucket, capital = pieces.words(known)
    n = np.bincount(piece, minlength=len(pieces.start))
    have = n > 0
    piece = (np.cumsum(have) - 1)[piece]
    n = n[have]
    text, label, bars = pieces.text[have], pieces.label[have], pieces.bars[have]
    chars = (pieces.last - pieces.start + 1)[have]
    end = (pieces.kind[pieces.last[have]] & CLOSES) != 0
    per_piece = lambda mask: np.bincount(piece[mask], minlength=len(n))
    capitals, links, tags = per_piece(capital) / np.maximum(n, 1), per_piece(bucket == LINK), per_piece(bucket == TAG)
    label &= links == 0
    priced, listed = per_piece((bucket == PRICE) | (bucket == CODE)) > 0, bars > 1
    _, different = _group_counts(piece, bucket)
    state = np.select(
        [
            (links > 0) & (n - links <= 6 * links), (tags > 0) & (2 * tags >= n), ~end & (priced | listed), (n > 30) | (links > 0) | (tags > 0),
            end & (capitals < 0.6), end, ~label & (n >= 4) & (3 * different <= 2 * n), label | (capitals >= 0.6), (n > 2) & (capitals < 0.3),
        ],
        [LINKS, TAGS, MENU, UNKNOWN, PROSE, UNKNOWN, TAGS, FACTS, TAGS], UNKNOWN,
    )
    short = (np.bincount(text, minlength=len(texts))[text] == 1) & (n < LEAST_WORDS) & (state != LINKS)
    state[short] = UNKNOWN

    runs = np.maximum(1, np.rint(n / RUN).astype(np.int64))
    first_word, first_run = np.cumsum(n) - n, np.cumsum(runs) - runs
    place = np.arange(len(piece)) - first_word[piece]
    segment = first_run[piece] + ((place + 1) * runs[piece] + n[piece] - 1) // n[piece] - 1
    of = np.repeat(np.arange(len(n)), runs)
    often, _ = _group_counts(text[piece], bucket)
    words = np.bincount(segment, minlength=len(of))
    again = 2 * np.bincount(segment[often >= OFTEN], minlength=len(of)) > words
    signs = [
        (np.select([short, end], [SHORT, SENTENCE], OPEN)[of], np.ones(len(of), dtype=bool)),
        (np.select([capitals >= 0.6, capitals > 0], [CAPITALS, SOME_CAPITALS], LOWER)[of], ~short[of]),
        (np.full(len(of), LABEL), label[of]), (np.full(len(of), SEPARATED), listed[of]), (np.full(len(of), REPEATED), again),
    ]
    sizes = words + sum(on.astype(np.int64) for _, on in signs)
    starts = np.cumsum(sizes) - sizes
    out = np.empty(int(sizes.sum()), dtype=np.int32)
    out[np.arange(len(segment)) + (starts - (np.cumsum(words) - words))[segment]] = bucket
    at = starts + words
    for sign, on in signs:
        out[at[on]] = sign[on]
        at = at + on
    return out, sizes, (chars / runs)[of], state[of], text[of]


def _chunks(texts: list[str]) -> Iterator[list[str]]:
    """The texts in turn, about TOGETHER code points at a time."""
    held, size = [], 0
    for text in texts:
        held.append(text)
        size += len(text) + 1
        if size >= TOGETHER:
            yield held
            held, size = [], 0
    if held:
        yield held


def tokenised(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, buckets, sizes, chars, states) of the texts that have a segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Known()
        for batch in batches:
            at = 0
            for held in _chunks(batch.column("text").to_pylist()):
                if len(known) > KNOWN_WORDS:
                    known.clear()
                buckets, sizes, chars, states, of = segments(held, known)
                per_text = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(held)))])
                per_segment = np.concatenate([[0], np.cumsum(sizes)])
                lists = [pa.ListArray.from_arrays(pa.array(per_segment[per_text].astype(np.int32)), pa.array(buckets))]
                for values, kind in ((sizes, np.int32), (chars, np.float32), (states, np.int8)):
                    lists.append(pa.ListArray.from_arrays(pa.array(per_text.astype(np.int32)), pa.array(values.astype(kind))))
                yield pa.RecordBatch.from_arrays([batch.column("key").slice(at, len(held)), *lists], ["key", "buckets", "sizes", "chars", "states"])
                at += len(held)

    given = texts.select(F.col(key).alias("key"), F.col(text).alias("text")).filter(F.col("text").isNotNull())
    kind = dict(given.dtypes)["key"]
    made = given.mapInArrow(run, f"key {kind}, buckets array<int>, sizes array<int>, chars array<float>, states array<tinyint>")
    return made.filter(F.size("sizes") > 0)


class Model:
    """Emission and transition scores of the states; one float per state and bucket."""

    def __init__(self, counts: np.ndarray) -> None:
        corpus = counts.sum(axis=0) + 0.5
        corpus /= corpus.sum()
        own = counts[:STATES] / np.maximum(counts[:STATES].sum(axis=1, keepdims=True), 1)
        self.emit = np.log((1 - BACKGROUND) * own + BACKGROUND * corpus).astype(np.float32)
        self.start = np.log(np.where(np.arange(STATES) == PROSE, START_PROSE, (1 - START_PROSE) / (STATES - 1))).astype(np.float32)
        self.move = np.full((STATES, STATES), np.log((1 - STAY) / (STATES - 1)), dtype=np.float32)
        np.fill_diagonal(self.move, np.log(STAY))

    def decode(self, buckets: np.ndarray, sizes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The best state of every segment, for texts of the given numbers of segments one after another (Viterbi)."""
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        score = np.stack([np.add.reduceat(own[buckets], starts) for own in self.emit], axis=1)
        order = np.argsort(-lengths, kind="stable")
        first = np.concatenate([[0], np.cumsum(lengths)[:-1]])[order]
        lengths = lengths[order]
        active = np.searchsorted(-lengths, -np.arange(lengths[0]), side="left")  # texts longer than t
        back = np.zeros(score.shape, dtype=np.int8)
        best = score[first] + self.start
        for t in range(1, int(lengths[0])):
            n = int(active[t])
            ways = best[:n, :, None] + self.move
            back[first[:n] + t] = came = ways.argmax(axis=1)
            best[:n] = np.take_along_axis(ways, came[:, None, :], axis=1)[:, 0] + score[first[:n] + t]
        states = np.zeros(len(sizes), dtype=np.int8)
        now = best.argmax(axis=1).astype(np.int8)
        for t in range(int(lengths[0]) - 1, -1, -1):
            n = int(active[t])
            states[first[:n] + t] = now[:n]
            if t:
                now[:n] = back[first[:n] + t, now[:n]]
        return states


class _Batch:
    """The flat columns of a batch of tokenised texts."""

    def __init__(self, batch: pa.RecordBatch) -> None:
        flat = lambda c: batch.column(c).flatten().to_numpy(zero_copy_only=False)
        self.buckets, self.sizes, self.chars, self.formed = flat("buckets"), flat("sizes"), flat("chars"), flat("states")
        self.lengths = np.asarray(batch.column("sizes").value_lengths())
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])

    def states(self, model: Model | None) -> np.ndarray:
        """By form without a model, else decoded."""
        return self.formed if model is None else model.decode(self.buckets, self.sizes, self.lengths)


def _counts(pages: DataFrame, model: Model | None) -> np.ndarray:
    """Buckets by state, unknown last, over all texts: by form alone without a model, else as decoded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((STATES + 1) * BUCKETS, dtype=np.int64)
        for batch in map(_Batch, filter(len, batches)):
            each = np.repeat(batch.states(model).astype(np.int64), batch.sizes)
            total += np.bincount(each * BUCKETS + batch.buckets, minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["at", "n"])

    rows = pages.drop("key").mapInArrow(run, "at bigint, n bigint").groupBy("at").agg(F.sum("n").alias("n")).toPandas()  # at most states x buckets
    counts = np.zeros((STATES + 1) * BUCKETS)
    counts[rows["at"].to_numpy(dtype=np.int64)] = rows["n"]
    return counts.reshape(STATES + 1, BUCKETS)


def non_prose_shares(texts: DataFrame, key: str, text: str, rounds: int = ROUNDS) -> DataFrame:
    """(key, links, tags, menus, facts, segments): shares of each text's characters by the state of its segments.

    A null or empty text, or one without a word, has no row; repeated rows give repeated results and weigh in the counts.
    """
    pages = materialize(tokenised(texts, key, text), "pages")
    model = Model(_counts(pages, None))
    for _ in range(rounds):
        model = Model(_counts(pages, model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for given in filter(len, batches):
            batch = _Batch(given)
            states = batch.states(model)
            whole = np.add.reduceat(batch.chars.astype(float), batch.starts)
            shares = [np.add.reduceat(np.where(states == s, batch.chars, 0).astype(float), batch.starts) / whole for s in (LINKS, TAGS, MENU, FACTS)]
            columns = [given.column("key"), *map(pa.array, shares), pa.array(batch.lengths.astype(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, ["key", "links", "tags", "menus", "facts", "segments"])

    kind = dict(pages.dtypes)["key"]
    return pages.mapInArrow(run, f"key {kind}, links double, tags double, menus double, facts double, segments bigint")


def stuffed_pages(texts: DataFrame, key: str, text: str, least: float = 0.5) -> DataFrame:
    """non_prose_shares of the texts of which more than `least` of the characters are link lists, tag lists or menus."""
    return non_prose_shares(texts, key, text).filter(F.col("links") + F.col("tags") + F.col("menus") > least)
