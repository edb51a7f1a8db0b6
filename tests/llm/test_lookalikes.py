import itertools
import random

from pyspark.sql import functions as F

from lumenframe.llm import lookalikes as L

SCHEMA = "item bigint, name string, form string, _folded string"


def pairs(spark, rows):
    df = spark.createDataFrame([(i, n, "clash", "clash") for i, n in rows], SCHEMA)
    return {(r.item_a, r.item_b) for r in L.alike_pairs(df, "item", "name").collect()}


SAME = ["Office ß Café III-x", "Оffіcе ß Café ⅠII-x", "Office ß Café III‑x", " Ｏﬃce  ß C​afé ＩⅡ－x", "Office ß Café ӀΙІ‐x "]
DIFFERENT = ["office ß Café III-x", "Office ss Café III-x", "Office ß Cafe III-x", "Officeß Café III-x", "Office ß Café III–x", "Office ß Café lll-x", "Office ß Café III_x", "Office ß Café II1-x"]


def test_same_looks_and_visible_differences(spark):
    rows = list(enumerate(SAME + DIFFERENT)) + [(100, None), (101, "​"), (102, " ­ "), (103, ""), (None, SAME[0])]
    assert pairs(spark, rows + rows) == set(itertools.combinations(range(len(SAME)), 2))


def test_equal_characters_are_no_pair_but_join_variants(spark):
    rows = [(1, "Роро Топ"), (2, "Роро Топ"), (3, "Popo Топ"), (4, "other")]
    assert pairs(spark, rows) == {(1, 3), (2, 3)}
    assert pairs(spark, rows[:2]) == set() and pairs(spark, []) == set()


def test_kana_and_scripts(spark):
    assert pairs(spark, [(1, "ロへカ"), (2, "口ヘ力"), (3, "ﾛヘｶ"), (4, "ロヘガ")]) == {(1, 2), (1, 3), (2, 3)}


def test_form_is_a_function_of_the_look():
    r = random.Random(2)
    words = ["Тоска", "space", "Rope", "Москва", "Νικος", "COPE", "カロリ", "ace of"]
    model = L.Model({})
    counts = {}
    for w in words * 3:
        for t in L.TOKEN.findall(L.fold(w)):
            for b in L.bigrams(t):
                counts[b] = counts.get(b, 0) + 1
    for m in (model, L.Model(counts)):
        for w in words:
            forms = set()
            for _ in range(30):
                other = "".join(r.choice(L.MEMBERS[L.SHAPE_OF[c]]) if c in L.SHAPE_OF else c for c in w)
                forms.add(m.form(L.fold(other), m.options))
            assert len(forms) == 1


def test_script_of_the_neighbours_decides(spark):
    texts = ["space opera", "ocean scope", "соль моря", "роса поле", "cор", "сop and space", "соp моря"] * 20
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = {r.t: r.form for r in L.unify(df, "t").collect()}
    assert got["сop and space"] == "cop and space" and got["соp моря"] == "сор моря" and got["space opera"] == "space opera"


def test_very_long_text(spark):
    long = "Оffice " * 60_000
    df = spark.createDataFrame([(long,), (None,)], "t string")
    got = {r.t: r.form for r in L.unify(df, "t").collect()}
    assert len(got[long]) == len(long) - 1 and got[None] is None


def test_letters_of_further_scripts(spark):
    rows = list(enumerate(["Apple gone", "Ꭺpple ɡᴏne", "ꓮpple gⲟne", "Apple gοne", "Apple gone!", "αpple gone", "Applе gıne"]))
    assert pairs(spark, rows) == set(itertools.combinations(range(4), 2))


def test_shape_and_form_agree(spark):
    r = random.Random(3)
    words = ["Тоска", "space", "Rope", "カロリ", "ガ", "ace of"]
    texts = ["".join(r.choice(L.MEMBERS[L.SHAPE_OF[c]]) if c in L.SHAPE_OF else c for c in w) for w in words for _ in range(20)]
    df = spark.createDataFrame([(t, L.fold(t)) for t in texts], "t string, f string")
    rows = df.select(L.shape(F.col("f")).alias("s"), L.canonical(L.Model({}), F.col("f")).alias("c")).collect()
    assert len({x.s for x in rows}) == len({x.c for x in rows}) == len({(x.s, x.c) for x in rows})
