from lumenframe.plans.registry import QUERIES
from lumenframe.sources.delimited import candidate_records
from pyspark.sql import functions as F

RULES = [
    ("movielens.x", 1, "id", "int", False, 1.0, 100.0), ("movielens.x", 2, "name", "text", True, None, None),
    ("title.x", 1, "tconst", "id", False, None, None), ("title.x", 2, "flag", "flag", True, None, None), ("title.x", 3, "rate", "decimal", True, -1.0, 10.0),
]
LINES = [
    ("m", 1, "movielens.x", "id,name"), ("m", 2, "movielens.x", '7,"a, ""b"""\r\n'), ("m", 2, "movielens.x", '7,"a, ""b"""\r\n'), ("m", 3, "movielens.x", "8,\\N"),
    ("m", 4, "movielens.x", "9,"), ("m", 5, "movielens.x", "x,a"), ("t", 2, "title.x", "tt123456789\t0\t2.5"), ("t", 3, "title.x", "tt123456780\t\\N\t"), ("t", 4, "title.x", "tt1\t1\t2"), ("u", 2, "unknown", "a"),
]


def test_good_rows_of_every_dataset_come_out_typed(spark, tmp_path):
    spark.createDataFrame(RULES, "dataset string, column_no int, column_name string, value_type string, nullable boolean, min_value double, max_value double").write.parquet(f"{tmp_path}/raw_schemas.parquet")
    spark.createDataFrame(LINES, "file_name string, line_no bigint, dataset string, fields string").write.parquet(f"{tmp_path}/raw_lines.parquet")
    rows = QUERIES["p5_typed"](spark, str(tmp_path)).collect()
    got = {(r.file_name, r.line_no, r.column_name): (r.text_value, r.int_value, r.decimal_value, r.flag_value) for r in rows}
    none = (None, None, None, None)
    assert len(got) == len(rows)
    assert got == {
        ("m", 2, "id"): (None, 7, None, None), ("m", 2, "name"): ('a, "b"', None, None, None), ("m", 3, "id"): (None, 8, None, None), ("m", 3, "name"): ("\\N", None, None, None),
        ("m", 4, "id"): (None, 9, None, None), ("m", 4, "name"): none, ("t", 2, "tconst"): ("tt123456789", None, None, None), ("t", 2, "flag"): (None, None, None, False), ("t", 2, "rate"): (None, None, 2.5, None),
        ("t", 3, "tconst"): ("tt123456780", None, None, None), ("t", 3, "flag"): none, ("t", 3, "rate"): none,
    }


def test_every_record_is_either_typed_or_faulty(spark):
    folder = "/root/testdata/sf0.001"
    lines = spark.read.parquet(f"{folder}/raw_lines.parquet")
    keys = lambda df: {(r.file_name, r.line_no) for r in df.select("file_name", "line_no").distinct().collect()}
    typed, faulty = QUERIES["p5_typed"](spark, folder), QUERIES["p5_found"](spark, folder)
    assert keys(typed) | keys(faulty) == keys(candidate_records(lines)) and not keys(typed) & keys(faulty)
    datasets = {r.dataset for r in spark.read.parquet(f"{folder}/raw_schemas.parquet").select("dataset").distinct().collect()}
    assert {r.dataset for r in typed.select("dataset").distinct().collect()} == datasets
    assert typed.select(F.countDistinct("dataset", "column_no")).first()[0] == 18
