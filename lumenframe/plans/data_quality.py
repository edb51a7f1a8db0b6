"""Queries over delivered raw records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lumenframe.sources.delimited import clean_records, faulty_records, typed_cells
from lumenframe.tables import table


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    faults = faulty_records(table(spark, folder, "raw_lines"), table(spark, folder, "raw_schemas"))
    return faults.select("file_name", "line_no", "reason")


def p5_ratings(spark: SparkSession, folder: str) -> DataFrame:
    """The good records of title.ratings as typed rows."""
    columns = [("tconst", "id"), ("average_rating", "decimal"), ("num_votes", "int")]
    return clean_records(table(spark, folder, "raw_lines"), table(spark, folder, "raw_schemas"), "title.ratings", columns)


def p5_typed(spark: SparkSession, folder: str) -> DataFrame:
    """The good records of every dataset of raw_schemas, a row for each cell, typed as its column."""
    return typed_cells(table(spark, folder, "raw_lines"), table(spark, folder, "raw_schemas"))


_JUDGED = r"""
WITH body AS (
  SELECT DISTINCT file_name, line_no, dataset, rtrim(fields, chr(13) || chr(10)) AS b, dataset LIKE 'movielens.%' AS csv
  FROM raw_lines WHERE line_no <> 1),
rec AS (SELECT * FROM body WHERE trim(b, ' ') <> ''),
quoted AS (
  SELECT *, csv AND NOT regexp_full_match(b, '(?:"(?:[^"]|"")*"|[^",]*)(?:,(?:"(?:[^"]|"")*"|[^",]*))*', 's') AS badq FROM rec),
cells AS (
  SELECT file_name, line_no, dataset, csv, badq, CASE WHEN csv THEN
     list_transform(regexp_extract_all(',' || b, ',("(?:[^"]|"")*"|[^",]*)', 1), lambda x:
       CASE WHEN starts_with(x, '"') THEN replace(substr(x, 2, length(x) - 2), '""', '"') ELSE x END)
     ELSE string_split(b, chr(9)) END AS c FROM quoted),
shape AS (
  SELECT x.*, CASE WHEN badq THEN 'quoting' WHEN len(c) <> coalesce(w.n, 0) THEN 'column_count' END AS fault
  FROM cells x LEFT JOIN (SELECT dataset, count(*) AS n FROM raw_schemas GROUP BY dataset) w USING (dataset)),
cell AS (
  SELECT file_name, line_no, csv, s.*, c[s.column_no] AS v FROM shape JOIN raw_schemas s USING (dataset) WHERE fault IS NULL),
wrong AS (
  SELECT DISTINCT file_name, line_no FROM cell WHERE CASE WHEN v = '' OR (NOT csv AND v = '\N') THEN NOT nullable
    ELSE NOT CASE value_type WHEN 'id' THEN regexp_full_match(v, 'tt[0-9]{9}') WHEN 'flag' THEN v IN ('0', '1')
      WHEN 'text' THEN NOT contains(v, chr(65533))
      ELSE regexp_full_match(v, CASE value_type WHEN 'int' THEN '-?[0-9]+' ELSE '-?[0-9]+(\.[0-9]+)?' END)
           AND coalesce(try_cast(v AS DOUBLE) >= min_value, true) AND coalesce(try_cast(v AS DOUBLE) <= max_value, true) END END)
"""
ORACLES = {
    "p5_found": _JUDGED
    + """SELECT file_name, line_no, min(fault) AS reason FROM shape WHERE fault IS NOT NULL GROUP BY 1, 2
         UNION ALL SELECT file_name, line_no, 'value' AS reason FROM wrong""",
    "p5_ratings": _JUDGED
    + """SELECT DISTINCT file_name, line_no, c[1] AS tconst, CAST(c[2] AS DOUBLE) AS average_rating, CAST(c[3] AS BIGINT) AS num_votes
         FROM shape ANTI JOIN wrong USING (file_name, line_no) WHERE dataset = 'title.ratings' AND fault IS NULL""",
    "p5_typed": _JUDGED
    + r""", good AS (SELECT DISTINCT file_name, line_no, dataset, column_no, column_name, value_type, CASE WHEN v = '' OR (NOT csv AND v = '\N') THEN NULL ELSE v END AS v
           FROM cell ANTI JOIN wrong USING (file_name, line_no))
         SELECT file_name, line_no, dataset, column_no, column_name, value_type, CASE WHEN value_type IN ('id', 'text') THEN v END AS text_value,
           CASE WHEN value_type = 'int' THEN TRY_CAST(v AS BIGINT) END AS int_value, CASE WHEN value_type = 'decimal' THEN TRY_CAST(v AS DOUBLE) END AS decimal_value,
           CASE WHEN value_type = 'flag' THEN v = '1' END AS flag_value FROM good""",
}
QUERIES = {"p5_found": p5_found, "p5_ratings": p5_ratings, "p5_typed": p5_typed}
