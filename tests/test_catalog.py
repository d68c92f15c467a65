"""Every registered query of the change-log engine against its SQL in DuckDB."""

import os

import duckdb
import pytest

from tidelog import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{SF}/{name}')")
    return con


@pytest.mark.parametrize("name", catalog.queries())
def test_query_equals_sql(spark, duck, name):
    have, want = catalog.queries()[name](spark, SF).toPandas(), duck.sql(catalog.oracle_sql()[name]).df()
    columns = sorted(want.columns)
    assert columns == sorted(have.columns)
    rows = [sorted(map(str, d[columns].astype(object).where(d[columns].notna(), None).itertuples(index=False, name=None))) for d in (have, want)]
    assert rows[0] == rows[1]


def test_entry_module_has_all(spark):
    import __spark_entry__ as entry

    assert set(catalog.queries()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
