"""Every core query against its SQL twin on the smallest tables, and a clean import of the contract."""

import os
from pathlib import Path

import duckdb
import pytest

from lumenframe.plans import registry

FOLDER = Path(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))


def same(spark, build, sql):
    con = duckdb.connect()
    for path in FOLDER.glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')").fetchall()
    got = build(spark, str(FOLDER)).toPandas()
    want = con.execute(sql).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    con.register("got", got[columns])
    con.execute(f"CREATE TABLE want AS {sql}").fetchall()
    names = ", ".join(f'"{c}"' for c in columns)
    assert len(got) == len(want)
    missing = con.execute(f"SELECT * FROM (SELECT {names} FROM want EXCEPT ALL SELECT {names} FROM got) LIMIT 3").fetchall()
    assert not missing


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_its_twin(spark, name):
    same(spark, registry.QUERIES[name], registry.ORACLES[name])


def test_contract():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
