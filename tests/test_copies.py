"""Tables that hold their rows several times over under shifted keys, as the larger ones do."""

import datetime as dt

import duckdb
import pytest

import __spark_entry__ as entry_points
from gavelframe.sinks import tables as TB
from test_suite import rows_of

KEYS = {"supplier": {"s_suppkey": 1000}, "customer": {"c_custkey": 15000}, "orders": {"o_orderkey": 150000, "o_custkey": 15000}}


@pytest.fixture(scope="module")
def copies(sf_dir, tmp_path_factory):
    """A folder of three copies of the smallest tables and a DuckDB connection on it."""
    folder = tmp_path_factory.mktemp("copies")
    con = duckdb.connect()
    for t in ("supplier", "customer", "orders", "nation"):
        times = 3 if t in KEYS else 1
        kept = ", ".join(f"({c} + i * {n})::BIGINT AS {c}" for c, n in KEYS.get(t, {}).items())
        columns = f"* EXCLUDE (i) REPLACE ({kept})" if kept else "* EXCLUDE (i)"
        con.sql(f"copy (select {columns} from '{sf_dir}/{t}.parquet', range({times}) r(i)) to '{folder}/{t}.parquet' (format parquet)")
        con.sql(f"create view {t} as select * from '{folder}/{t}.parquet'")
    return str(folder), con


def agrees(spark, copies, name):
    folder, con = copies
    df = entry_points.queries()[name](spark, folder)
    res = con.execute(entry_points.oracle_sql()[name])
    names = [d[0] for d in res.description]
    return rows_of(df.columns, df.collect()) == rows_of(names, res.fetchall())


def test_adjudications_of_equal_keys(spark, copies):
    assert agrees(spark, copies, "insert_ignore_adjudications")


def test_equal_keys_of_one_batch_count_once(spark):
    schema = "source string, postal_code string, sale_date date, hammer_price double, surface_m2 double"
    day = dt.date(2024, 1, 1)
    new = spark.createDataFrame([("s", "13010", day, 100.0, 10.0), ("s", "13010", day, 100.0, 20.0), ("s", "13010", None, 100.0, 10.0),
                                 ("s", "13010", None, 100.0, 10.0)], schema)
    none = TB.priced_adjudications(new).filter("false")
    assert TB.insert_adjudications(none, new).count() == 3
    assert TB.insert_adjudications(TB.priced_adjudications(new), new).count() == 6


@pytest.mark.parametrize("name", ["parse_notices_by_source", "report_summary"])
def test_notices_of_one_small_file_are_parsed_by_many_tasks(spark, sf_dir, name):
    df = entry_points.queries()[name](spark, sf_dir)
    assert df.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
