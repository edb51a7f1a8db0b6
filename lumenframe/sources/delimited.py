"""Delivered text records: cells, faults and typed rows.

Two dialects. ``tsv``: cells split at tabs, no quoting, ``\\N`` or nothing is null. ``csv``: RFC 4180, nothing is null.
Everything runs as JVM expressions; only records that hold a quote pass through the quote-aware fold.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What each type accepts, as full matches. Text is whatever holds no replacement character.
PATTERNS = {"id": r"^tt[0-9]{9}\z", "int": r"^-?[0-9]+\z", "decimal": r"^-?[0-9]+(\.[0-9]+)?\z", "flag": r"^[01]\z"}
TYPES = {"id": "string", "text": "string", "int": "bigint", "decimal": "double", "flag": "boolean"}
QUOTING, COLUMN_COUNT, VALUE = "quoting", "column_count", "value"


def record_body(fields: Column) -> Column:
    """The record without CR and LF at its end."""
    return F.rtrim(fields, F.lit("\r\n"))


def _quoted_cells(body: Column) -> Column:
    """struct(cells, bad) of a CSV record that holds quotes, by folding over its comma-separated pieces.

    Within an open quoted cell a doubled quote is text, so it is masked first; a quote left after that closes the cell and
    must be the piece's last character. A cell that doesn't start with a quote must hold none.
    """
    mask = "￾"
    start = F.struct(
        F.array().cast("array<string>").alias("cells"), F.lit(None).cast("string").alias("open"), F.lit(False).alias("bad")
    )

    def step(state: Column, piece: Column) -> Column:
        is_open = state["open"].isNotNull()
        opens = ~is_open & piece.startswith('"')
        inner = F.replace(F.when(opens, F.substr(piece, F.lit(2))).otherwise(piece), F.lit('""'), F.lit(mask))
        closing = F.instr(inner, '"')
        text = F.when(is_open, F.concat(state["open"], F.lit(","), inner)).otherwise(inner)
        quoted = is_open | opens
        ends = quoted & (closing > 0)
        misplaced = F.when(quoted, (closing > 0) & (closing < F.length(inner))).otherwise(F.contains(piece, F.lit('"')))
        cell = F.when(quoted, F.replace(F.replace(text, F.lit('"'), F.lit("")), F.lit(mask), F.lit('"'))).otherwise(piece)
        return F.struct(
            F.when(quoted & ~ends, state["cells"]).otherwise(F.concat(state["cells"], F.array(cell))).alias("cells"),
            F.when(quoted & ~ends, text).alias("open"),
            (state["bad"] | misplaced).alias("bad"),
        )

    return F.aggregate(
        F.split(body, ","), start, step, lambda s: F.struct(s["cells"].alias("cells"), (s["bad"] | s["open"].isNotNull()).alias("bad"))
    )


def parse_records(lines: DataFrame, fields: str = "fields", csv: Column | None = None) -> DataFrame:
    """lines plus _cells array<string> and _bad_quoting boolean. csv: whether a record is CSV (else TSV; null is TSV)."""
    body = record_body(F.col(fields))
    is_csv = F.coalesce(csv if csv is not None else F.lit(True), F.lit(False))
    plain = F.struct(F.split(body, F.when(is_csv, F.lit(",")).otherwise(F.lit("\t"))).alias("cells"), F.lit(False).alias("bad"))
    parsed = F.when(is_csv & F.contains(body, F.lit('"')), _quoted_cells(body)).otherwise(plain)
    return lines.withColumn("_parsed", parsed).withColumns({"_cells": F.col("_parsed.cells"), "_bad_quoting": F.col("_parsed.bad")}).drop("_parsed")


def _cell_fault(value: Column, is_csv: Column) -> Column:
    """Whether a cell breaks its rule (columns value_type, nullable, min_value, max_value of the rule table)."""
    null = value.isNull() | (value == "") | (~is_csv & (value == r"\N"))
    number = value.try_cast("double")
    low, high = (F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")) for c in ("min_value", "max_value"))
    inside = F.coalesce(number >= low, F.lit(True)) & F.coalesce(number <= high, F.lit(True))
    kind = F.col("value_type")
    shape = reduce(lambda c, k: c.when(kind == k, value.rlike(PATTERNS[k])), list(PATTERNS), F.when(kind == "text", ~F.contains(value, F.lit("�"))))
    sound = F.coalesce(shape, F.lit(True)) & F.when(kind.isin("int", "decimal"), inside).otherwise(F.lit(True))
    return F.when(null, ~F.coalesce(F.col("nullable"), F.lit(True))).otherwise(~sound)


def candidate_records(lines: DataFrame) -> DataFrame:
    """Records that must be judged: no header (line 1), not null, not empty or only spaces."""
    return lines.filter((F.col("line_no") != 1) & (F.trim(record_body(F.col("fields"))) != ""))


RULE = ["dataset", "column_no", "value_type", "nullable", "min_value", "max_value"]


def _parsed(lines: DataFrame, rules: DataFrame) -> DataFrame:
    """file_name, line_no, dataset, cells, structure fault or null. Columns beyond the four needed are dropped."""
    wanted = lines.select("file_name", "line_no", "dataset", "fields")
    records = parse_records(candidate_records(wanted), csv=F.col("dataset").startswith("movielens."))
    widths = rules.groupBy("dataset").agg(F.count(F.lit(1)).alias("width"))
    structure = F.when(F.col("_bad_quoting"), QUOTING).when(F.size("_cells") != F.coalesce("width", F.lit(0)), COLUMN_COUNT)
    return records.join(widths, "dataset", "left").select(
        "file_name", "line_no", "dataset", F.col("_cells").alias("cells"), structure.alias("fault")
    )


def faulty_records(lines: DataFrame, rules: DataFrame) -> DataFrame:
    """(file_name, line_no, reason, columns): records that don't fit, one row each, with the first reason that applies.

    lines: file_name, line_no, dataset, fields. rules: dataset, column_no, column_name, value_type, nullable, min_value,
    max_value. Reasons in order: quoting, column_count, value; columns names the cells at fault where the reason is value.
    Headers and blank or null records are neither good nor faulty; repeated rows count once; a dataset without rules
    fails by column_count; a null file_name or line_no is a key like any other, except that line_no must be known to be no
    header. Only cells that break a rule are shuffled.
    """
    parsed = _parsed(lines, rules)
    structural = parsed.filter(F.col("fault").isNotNull()).select("file_name", "line_no", F.col("fault").alias("reason"), F.lit(None).cast("string").alias("column_name"))
    cells = parsed.filter(F.col("fault").isNull()).select(
        "file_name", "line_no", "dataset", F.posexplode("cells").alias("at", "value")
    )
    checked = cells.withColumn("column_no", F.col("at") + 1).join(rules.select(*RULE, "column_name"), ["dataset", "column_no"])
    wrong = checked.filter(_cell_fault(F.col("value"), F.col("dataset").startswith("movielens.")))
    faults = structural.unionByName(wrong.select("file_name", "line_no", F.lit(VALUE).alias("reason"), "column_name"))
    order = F.when(F.col("reason") == QUOTING, 1).when(F.col("reason") == COLUMN_COUNT, 2).otherwise(3)
    return faults.groupBy("file_name", "line_no").agg(
        F.min_by("reason", order).alias("reason"), F.array_sort(F.collect_set("column_name")).alias("columns")
    )


def clean_records(lines: DataFrame, rules: DataFrame, dataset: str, columns: list[tuple[str, str]]) -> DataFrame:
    """Typed good rows of one dataset: file_name, line_no and the given (name, value_type) columns, in order.

    A null cell is null. The rows are those left after an anti join with the faulty ones; repeated rows count once.
    """
    own, own_rules = lines.filter(F.col("dataset") == dataset), rules.filter(F.col("dataset") == dataset)
    is_csv = dataset.startswith("movielens.")
    parsed = _parsed(own, own_rules).filter(F.col("fault").isNull())

    def typed(at: int, kind: str) -> Column:
        cell = F.nullif(F.get("cells", F.lit(at)), F.lit(""))
        cell = cell if is_csv else F.nullif(cell, F.lit(r"\N"))
        return cell == "1" if kind == "flag" else cell.try_cast(TYPES[kind])

    values = [typed(i, kind).alias(name) for i, (name, kind) in enumerate(columns)]
    bad = faulty_records(own, own_rules).select("file_name", "line_no")
    good = parsed.select(F.col("file_name").alias("_file"), F.col("line_no").alias("_line"), *values).distinct()
    rest = good.join(bad, F.col("_file").eqNullSafe(F.col("file_name")) & F.col("_line").eqNullSafe(F.col("line_no")), "left_anti")
    return rest.withColumnsRenamed({"_file": "file_name", "_line": "line_no"})


def typed_cells(lines: DataFrame, rules: DataFrame) -> DataFrame:
    """The cells of the good records of every dataset with rules, one row each, under the type of its column.

    file_name, line_no, dataset, column_no, column_name, value_type, and text_value (ids and texts), int_value,
    decimal_value, flag_value, of which the column's own type is filled unless the cell is null. The records are those left
    after an anti join with the faulty ones; repeated rows count once.
    """
    parsed = _parsed(lines, rules).filter(F.col("fault").isNull())
    good = parsed.select(F.col("file_name").alias("_file"), F.col("line_no").alias("_line"), "dataset", "cells").distinct()
    bad = faulty_records(lines, rules).select("file_name", "line_no")
    rest = good.join(bad, F.col("_file").eqNullSafe(F.col("file_name")) & F.col("_line").eqNullSafe(F.col("line_no")), "left_anti")
    cells = rest.select(F.col("_file").alias("file_name"), F.col("_line").alias("line_no"), "dataset", F.posexplode("cells").alias("at", "cell"))
    kinds = rules.select("dataset", "column_no", "column_name", "value_type")
    own = cells.withColumn("column_no", F.col("at") + 1).join(kinds, ["dataset", "column_no"])
    null = (F.col("cell") == "") | (~F.col("dataset").startswith("movielens.") & (F.col("cell") == r"\N"))
    value, kind = F.when(~null, F.col("cell")), F.col("value_type")
    return own.select(
        "file_name", "line_no", "dataset", "column_no", "column_name", "value_type",
        F.when(kind.isin("id", "text"), value).alias("text_value"), F.when(kind == "int", value.try_cast(TYPES["int"])).alias("int_value"),
        F.when(kind == "decimal", value.try_cast(TYPES["decimal"])).alias("decimal_value"), F.when(kind == "flag", value == "1").alias("flag_value"),
    )
