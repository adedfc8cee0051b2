"""Every registered query against its DuckDB SQL on the smallest scale factor."""

import duckdb
import pytest

import __spark_entry__ as entry
from tools.oracle_check import TABLES, rows_of
from tools.schema_check import duck_type

SF = "/root/testdata/sf0.001"
SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query_matches_oracle(spark, con, name):
    sdf = entry.queries()[name](spark, SF)
    got = sdf.toPandas()
    if name not in SQL:
        assert len(got.columns) > 0
        return
    want = con.execute(SQL[name]).df()
    types = {f.name: duck_type(f.dataType.simpleString()) for f in sdf.schema.fields}
    assert types == {r[0]: r[1] for r in con.execute(f"DESCRIBE {SQL[name]}").fetchall()}
    gc, gr = rows_of(got)
    wc, wr = rows_of(want)
    assert gc == wc
    assert len(gr) == len(wr)
    assert gr == wr


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() >= 0
    assert "corpus_id" in df.columns
