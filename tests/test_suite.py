"""Every registered query against its SQL on the smallest data, and the driver contract."""

import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry_points

sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))
from verify import rows_of  # noqa: E402


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for p in sorted(Path(sf_dir).glob("*.parquet")):
        c.sql(f"create view {p.stem} as select * from '{p}'")
    return c


def test_flagship(spark):
    assert entry_points.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())


@pytest.mark.parametrize("name", list(entry_points.queries()))
def test_query(spark, sf_dir, con, name):
    df = entry_points.queries()[name](spark, sf_dir)
    got = rows_of(df.columns, df.collect())
    sql = entry_points.oracle_sql().get(name)
    if sql is None:
        assert df.columns
        return
    res = con.execute(sql)
    names = [d[0] for d in res.description]
    assert sorted(names) == sorted(df.columns)
    assert got == rows_of(names, res.fetchall())
