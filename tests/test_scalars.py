import re

import numpy as np
import pytest
from lumenframe.functions import scalars as S
from pyspark.sql import functions as F


def values(spark, column, rows, schema):
    return [r.x for r in spark.createDataFrame(rows, schema).coalesce(1).select(column.alias("x")).collect()]


def test_first_sentences(spark):
    cases = {
        "One. Two.": "One.", "Dr. Who came. He left.": "Dr. Who came.", "J. R. Doe sings! Yes": "J. R. Doe sings!", "No stop here": "No stop here", "Ends.": "Ends.",
        "  Is it? No. ": "Is it?", "": "", "word " * 40: ("word " * 6).strip() + "…", "a.b c. D": "a.b c. D",
    }
    got = values(spark, S.first_sentence(F.col("t"), 32), [(t,) for t in cases] + [(None,)], "t string")
    assert got == [*cases.values(), None]


def test_playback(spark):
    rows = [(5, 5000), (59, None), (570, 600), (569, 600), (5000, 5200), (400, 10000), (9, 0)]
    p, d = F.col("p"), F.col("d")
    assert values(spark, S.finished(p, d), rows, "p int, d int") == [False, False, True, False, True, False, False]
    assert values(spark, S.playback_outcome(p, p, d), rows, "p int, d int") == ["skim", "skim", "completed", "completed", "completed", "abandoned", "skim"]
    assert values(spark, S.resume_point(p, d), rows, "p int, d int") == [None, 59, None, None, 5000, 400, None]


def test_wrapping_numbers(spark):
    assert int(S.mixed(np.array([0], dtype=np.uint64))[0]) == 0xE220A8397B1DCDAF  # the published first output of the generator
    zeros, one = bytes(64), b"\x01" + bytes(63)
    rows = [(131072, zeros, zeros), (131072, one, one), (1 << 20, b"\xff" * 8, b""), (100, one, one), (None, one, one)]
    got = values(spark, S.file_hash(F.col("n"), F.col("h"), F.col("t")), rows, "n bigint, h binary, t binary")
    assert got == ["0000000000020000", "0000000000020002", "00000000000fffff", None, None]
    assert values(spark, S.user_part(F.col("u")), [(None,)], "u bigint") == [None]


def test_draws_have_their_moments():
    d = S.Draws(7)
    assert abs(d.uniform(20_000).mean() - 0.5) < 0.01 and abs(d.normal(20_000).std() - 1) < 0.02
    assert abs(d.gamma(0.5, 20_000).mean() - 0.5) < 0.02 and abs(d.gamma(3.0, 20_000).mean() - 3) < 0.06
    assert abs(d.beta(2, 6, 20_000).mean() - 0.25) < 0.01 and (S.Draws(7).uniform(5) == S.Draws(7).uniform(5)).all()


def test_pooling(spark):
    df = spark.createDataFrame([([[3.0, 4.0], [1.0, 0.0], [9.0, 9.0]], [1, 1, 0])], "t array<array<double>>, m array<int>")
    row = df.select(S.pooled(F.col("t")).alias("first"), S.pooled(F.col("t"), F.col("m")).alias("mean")).first()
    assert row.first == pytest.approx([0.6, 0.8]) and row["mean"] == pytest.approx([2 / 8**0.5, 2 / 8**0.5])


def test_labels(spark):
    row = spark.range(1).select(
        S.thousands(F.lit(-1234567)).alias("a"), S.numbering(F.lit(2), F.lit(None).cast("int")).alias("b"), S.episode_name(F.lit(" Episode #3.1 ")).alias("c"),
        S.episode_name(F.lit("Episodes of 3")).alias("d"), S.same_language(F.lit("pt-BR"), F.lit("PT_pt")).alias("e"), S.same_language(F.lit(""), F.lit("")).alias("f"),
        S.halves(F.lit(0.2)).alias("g"), S.halves(F.lit(0.0)).alias("h"), S.halves(F.lit(11.0)).alias("i"), S.year_of(F.lit("1877-x")).alias("j"), S.length_band(F.lit(129)).alias("k"),
        S.validator_state(F.lit(True), F.lit("a"), F.lit(200), F.lit("a")).alias("l"), S.validator_state(F.lit(False), F.lit("a"), F.lit(500), F.lit("a")).alias("m"), S.validator_state(F.lit(True), F.lit("a"), F.lit(500), F.lit("b")).alias("n"),
        S.next_local_one(F.lit(3600), F.lit(0)).alias("o"), S.local_hour(F.lit(0), F.lit(-3600)).alias("p"),
    ).first()
    assert tuple(row) == ("-1,234,567", "S2", None, "Episodes of 3", True, False, 1, None, 10, None, "middle", "current", "stale", "unknown", 90_000, 23)
    assert re.fullmatch("[0-9a-f]+", hex(int(S.mixed(np.array([5], dtype=np.uint64))[0]))[2:])
