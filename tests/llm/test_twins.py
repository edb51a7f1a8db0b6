import duckdb
import pytest
from pathlib import Path

queries = pytest.importorskip("lumenframe.llm.queries")
FOLDER = Path("/root/testdata/sf0.001")


@pytest.mark.skipif(not FOLDER.exists(), reason="no tables here")
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_twin(spark, name):
    con = duckdb.connect()
    for path in FOLDER.glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')").fetchall()
    got = queries.QUERIES[name](spark, str(FOLDER)).toPandas()
    want = con.execute(queries.ORACLES[name]).fetchdf()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    key = lambda df: sorted(map(str, df[columns].itertuples(index=False, name=None)))
    assert key(got) == key(want)
