import csv
import io
import random

from lumenframe.sources.delimited import clean_records, faulty_records, parse_records
from pyspark.sql import functions as F

RULES = [
    ("movielens.x", 1, "id", "int", False, 1.0, 100.0, "extra"), ("movielens.x", 2, "name", "text", False, None, None, "extra"),
    ("title.x", 1, "tconst", "id", False, None, None, "extra"), ("title.x", 2, "flag", "flag", True, None, float("nan"), "extra"), ("title.x", 3, "rate", "decimal", True, -1.0, 10.0, "extra"),
]
RULE_SCHEMA = "dataset string, column_no int, column_name string, value_type string, nullable boolean, min_value double, max_value double, value string"
LINE_SCHEMA = "file_name string, line_no bigint, dataset string, fields string, value string, cells string"


def judge(spark, records, dataset):
    lines = spark.createDataFrame([("f", i + 2, dataset, r, "v", "c") for i, r in enumerate(records)], LINE_SCHEMA)
    out = faulty_records(lines, spark.createDataFrame(RULES, RULE_SCHEMA))
    return {records[r.line_no - 2]: r.reason for r in out.collect()}


def test_csv_faults(spark):
    records = ['1,a', '2,"b"', '3,"b""c,\nd"\r\n', '4,"b', '5,"b"c', '6,b"c', '7', '8,a,b', '0,a', '101,a', '1.0,a', 'x,a', '9,', '9,""', ',a', '10,\N{REPLACEMENT CHARACTER}', '', '   ', '\r\n', None, '11, "a"', '"12",x', '-1,a', '١,a', '13,"a,"",""b"']
    bad = judge(spark, records, "movielens.x")
    quoting = {'4,"b', '5,"b"c', '6,b"c', '11, "a"'}
    count = {'7', '8,a,b'}
    value = {'0,a', '101,a', '1.0,a', 'x,a', '9,', '9,""', ',a', '10,\N{REPLACEMENT CHARACTER}', '-1,a', '١,a'}
    assert bad == {**dict.fromkeys(quoting, "quoting"), **dict.fromkeys(count, "column_count"), **dict.fromkeys(value, "value")}


def test_tsv_faults(spark):
    good = ['tt123456789\t1\t-0.5', 'tt123456789\t\\N\t\\N', 'tt123456789\t\t10\r\n']
    bad = ['tt12345678\t1\t1', 'tt123456789\t2\t1', 'tt123456789\t1\t10.5', 'tt123456789\t1\t1.', 'tt123456789\t1\t.5', ' tt123456789\t1\t1', '\\N\t1\t1', 'tt123456789\t1\t1e1']
    assert judge(spark, good + bad, "title.x") == dict.fromkeys(bad, "value")
    assert judge(spark, ['tt123456789\t1', 'a\tb\tc\td', 'tt123456789\t"1\t2'], "title.x") == {'tt123456789\t1': "column_count", 'a\tb\tc\td': "column_count", 'tt123456789\t"1\t2': "value"}
    assert judge(spark, ["x"], "unknown") == {"x": "column_count"}


def test_headers_duplicates_and_empty(spark):
    rules = spark.createDataFrame(RULES, RULE_SCHEMA)
    lines = [("f", 1, "title.x", "a", "", ""), ("f", 2, "title.x", "a", "", ""), ("f", 2, "title.x", "a", "", ""), (None, 2, "title.x", "a", "", ""), ("f", None, "title.x", "a", "", "")]
    out = faulty_records(spark.createDataFrame(lines, LINE_SCHEMA), rules).collect()
    assert {(r.file_name, r.line_no) for r in out} == {("f", 2), (None, 2)} and len(out) == 2
    assert faulty_records(spark.createDataFrame([], LINE_SCHEMA), rules).count() == 0


def test_typed_rows(spark):
    rules = spark.createDataFrame(RULES, RULE_SCHEMA)
    lines = [("f", 1, "title.x", "h", "", ""), ("f", 2, "title.x", "tt123456789\t1\t2.5", "", ""), ("f", 2, "title.x", "tt123456789\t1\t2.5", "", ""), ("f", 3, "title.x", "tt1\t1\t2", "", ""), ("f", 4, "title.x", "tt123456780\t\\N\t", "", "")]
    got = clean_records(spark.createDataFrame(lines, LINE_SCHEMA), rules, "title.x", [("t", "id"), ("f", "flag"), ("r", "decimal")]).collect()
    assert sorted((r.line_no, r.t, r.f, r.r) for r in got) == [(2, "tt123456789", True, 2.5), (4, "tt123456780", None, None)]


def test_round_trip_with_a_csv_writer(spark):
    r = random.Random(3)
    rows = [["".join(r.choice('ab",\n ') for _ in range(r.randrange(0, 8))) for _ in range(3)] for _ in range(400)]
    texts = []
    for row in rows:
        out = io.StringIO()
        csv.writer(out, quoting=csv.QUOTE_ALL).writerow(row)
        texts.append(out.getvalue())
    texts.append('"' + "x" * 300_000 + '",b,' + "y" * 300_000)
    rows.append(["x" * 300_000, "b", "y" * 300_000])
    df = spark.createDataFrame(list(enumerate(texts)), "n int, fields string")
    got = {x.n: (x._cells, x._bad_quoting) for x in parse_records(df, csv=F.lit(True)).collect()}
    assert all(got[i] == (row, False) for i, row in enumerate(rows))
