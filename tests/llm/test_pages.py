import os

import pytest

import re

import numpy as np

from lumenframe.llm import pages as P
from lumenframe.llm.pages import WORD, non_prose_shares, stuffed_pages

PROSE = "The old keeper opens the door and looks at the sea. Nobody believes her story about the letter. She walks home before the storm."
LINKS = "http://a.example/watch/one\nhttps://b.test/p/two\nwww.c.example/x"
TAGS = "watch free online, download hd series, best movies free, stream drama online, cheap dvd box, watch series hd, download free movies"
FACTS = "Editor: Komo Kotome\nSound: Hoze Donohu\nComposer: Sapi Dohere\nCamera: Gepi Hodepi\nWriter: Zuza Pitiga"
DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")


def corpus():
    rows = []
    for i in range(40):
        rows += [(8 * i, PROSE), (8 * i + 1, LINKS), (8 * i + 2, TAGS), (8 * i + 3, FACTS), (8 * i + 4, f"{PROSE}\n{LINKS.splitlines()[0]}"), (8 * i + 5, PROSE.split(". ")[0] + ".\n" + TAGS)]
    return rows


def test_labels(spark):
    rows = corpus() + [(1000, None), (1001, ""), (1002, " \n "), (1003, "ok"), (1004, "no spoilers please"), (1005, "!!!"), (1, LINKS)]
    df = spark.createDataFrame([(i, t, "clash", 0.0, []) for i, t in rows], "id bigint, text string, key string, links double, buckets array<int>")
    flagged = {r.key for r in stuffed_pages(df, "id", "text").collect()}
    assert flagged == {i for i, _ in corpus() if i % 8 in (1, 2, 5)}
    shares = {r.key: r for r in non_prose_shares(df, "id", "text").collect()}
    assert not {1000, 1001, 1002, 1005} & set(shares) and shares[3].facts > 0.5 and shares[1].links == 1


def test_empty_and_very_long(spark):
    df = spark.createDataFrame([], "id bigint, text string")
    assert stuffed_pages(df, "id", "text").count() == 0
    long = [(1, (PROSE + "\n") * 8000), (2, TAGS * 5000), (3, "x" * 500_000)]
    got = {r.key for r in stuffed_pages(spark.createDataFrame(corpus() + [(i + 5000, t) for i, t in long], "id bigint, text string"), "id", "text").collect()}
    assert 5002 in got and 5001 not in got and 5003 not in got


def test_code_points_give_the_words_of_the_pattern():
    texts = [PROSE, FACTS, TAGS, LINKS, "it's a well-made film (1999) and l'été 2 - so: 5/5", "", " \n ", "x", "Ｗａｔｃｈ 𝐟𝐫𝐞𝐞 wat\u200bch 12,99 € AB-1234", "a... b! c\u00a0d \n- e -\n", "::// [.] #", "A" * 5000]
    pieces = P._Pieces(texts)
    piece, bucket, _ = pieces.words(P.Known())
    want = []
    for t, text in enumerate(texts):
        for part in re.split(r"(?<=[.!?…])\s+|[\n\r]+", re.sub("\u200b", "", text)):
            if part.strip():
                want.append((t, [P.token(w) for w in WORD.findall(part)]))
    got = [(int(pieces.text[i]), bucket[piece == i].tolist()) for i in range(len(pieces.start))]
    assert got == want
    sizes = P.segments(texts, P.Known())[1]
    assert P.segments([], P.Known())[0].size == 0 and (sizes > 0).all()


def test_states_by_form():
    def state(text):
        return np.unique(P.segments(["One sentence about it.\n" + text], P.Known())[3][1:]).tolist()

    assert state("Home / About us / Products / Contact / Login") == [P.MENU]
    assert state("Lamp A4 12,99 €") == [P.MENU] and state("Cheap Watches Best Watches Replica Watches") == [P.TAGS]
    assert state("https://a.example/x https://b.example/y") == [P.LINKS] and state("Editor: Komo Kotome") == [P.FACTS]
    assert state("watch free series online now") == [P.TAGS] and state("Nobody believes her story about the letter.") == [P.PROSE]


def test_menus_are_flagged(spark):
    menu = "\n".join(["Home / About us / Products / Contact / Login", "Lamps | Chairs | Tables | Shelves", "Desk lamp 12,99 €", "Oak chair 49,00 €"] * 3)
    df = spark.createDataFrame(corpus() + [(9000, menu), (9001, PROSE + "\nHome / About / Contact")], "id bigint, text string")
    shares = {r.key: r for r in non_prose_shares(df, "id", "text").collect()}
    assert shares[9000].menus > 0.5 and shares[9001].menus < 0.5
    assert {r.key for r in stuffed_pages(df, "id", "text").collect()} >= {9000}


@pytest.mark.skipif(not os.path.exists(DATA), reason="no tables here")
def test_labelled_examples(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    flagged = {r.key for r in stuffed_pages(docs, "doc_id", "text").collect()}
    labels = spark.read.parquet(f"{DATA}/page_labels.parquet").collect()
    right = sum((r.doc_id in flagged) == bool(r.spam) for r in labels)
    assert right >= 0.95 * len(labels)
