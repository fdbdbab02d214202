import datetime as dt
import random
import statistics

import pytest
from pyspark.sql import functions as F

from gavelframe.operators import medians as M
from gavelframe.operators import ranking as R
from gavelframe.operators import sets as U
from gavelframe.operators import stats as ST
from gavelframe.sinks import tables as TB


@pytest.mark.parametrize("seed,width", [(1, 25.0), (2, None), (3, 100000.0)])
def test_grouped_median_is_exact(spark, seed, width):
    r = random.Random(seed)
    rows = [(r.choice(["hot", "hot", "hot", "a", "b", None]), r.choice([r.random() * 9000 + 1, 1234.5, 10.0])) for _ in range(900)]
    rows += [("one", 5.0), ("two", 1.0), ("two", 4.0), ("empty", None)]
    out = M.grouped_stats(spark.createDataFrame(rows, "g string, v double").repartition(6), ["g"], "v", cell_width=width)
    got = {x.g: x for x in out.collect()}
    want = {}
    for g, v in rows:
        if v is not None:
            want.setdefault(g, []).append(v)
    assert set(got) == set(want)
    for g, vs in want.items():
        assert got[g].median == statistics.median(vs)
        assert (got[g].n, got[g].low, got[g].high) == (len(vs), min(vs), max(vs))
        assert got[g].mean == pytest.approx(statistics.fmean(vs))


def test_neighbourhoods_need_three_and_round_half_even(spark):
    rows = [("75001", dt.date(2024, 1, 1), p, 1.0, p, "Paris", "Maison") for p in (500.5, 501.5, 502.5)]
    rows += [("75002", None, 1000.0, 1.0, 1000.0, None, "Maison")] * 3 + [("75003", None, 1000.0, 1.0, 1000.0, "X", "Maison")] * 2
    t = spark.createDataFrame(rows, "postal_code string, tx_date date, price double, surface_m2 double, price_m2 double, commune string, local_type string")
    got = {r.postal_code: r for r in ST.neighbourhood_stats(t, year=2024).collect()}
    assert set(got) == {"75001", "75002"}
    assert got["75001"].median_price_m2 == 502.0 and got["75001"].min_price_m2 == 500.0
    assert got["75002"].city == "CP 75002"
    assert ST.neighbourhood_stats(t, year=2023).count() == 1


def test_seed_counts_and_prices(spark):
    rows = [("s", "13010", None, 45000.0, 27.48), ("s", "13008", None, 81000.0, 43.71)]
    new = spark.createDataFrame(rows, "source string, postal_code string, sale_date date, hammer_price double, surface_m2 double")
    empty = new.withColumn("price_m2", F.lit(None).cast("double")).filter("false")
    got = {r.postal_code: r.price_m2 for r in TB.insert_adjudications(empty, new).collect()}
    assert got == {"13010": 1638.0, "13008": 1853.0}


def test_null_keys_never_collide(spark):
    old = spark.createDataFrame([("a", None, 1), ("b", "x", 1)], "name string, firm string, v int")
    out = TB.insert_ignore(old, old.withColumn("v", F.lit(2)), ["name", "firm"])
    assert sorted((r.name, r.v) for r in out.collect()) == [("a", 1), ("a", 2), ("b", 1)]


def test_upsert_last_of_batch_wins_and_null_urls_stay(spark):
    old = spark.createDataFrame([("u", 0, "old"), (None, 0, "n1")], "url string, seq int, v string")
    new = spark.createDataFrame([("u", 1, "first"), ("u", 2, "last"), (None, 1, "n2")], "url string, seq int, v string")
    got = sorted(((r.url or ""), r.v) for r in TB.upsert(old, new, ["url"], order=["seq"]).collect())
    assert got == [("", "n1"), ("", "n2"), ("u", "last")]


def test_versions_replay_to_the_same_table(spark, tmp_path):
    base = str(tmp_path / "t")
    a = spark.createDataFrame([("u", 1)], "url string, seq int")
    b = spark.createDataFrame([("u", 2), ("w", 1)], "url string, seq int")
    TB.upsert_table(a, base, ["url"], order=["seq"], version=0)
    for _ in range(2):
        TB.upsert_table(b, base, ["url"], order=["seq"], version=1)
    assert sorted(map(tuple, TB.read_current(spark, base).collect())) == [("u", 2), ("w", 1)]


def test_update_by_id_sets_only_given_columns(spark):
    old = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "id int, p string, q string")
    new = spark.createDataFrame([(2, "z"), (3, "n")], "id int, p string")
    assert sorted(map(tuple, TB.update_by_id(old, new, "id").collect())) == [(1, "a", "x"), (2, "z", "y")]


def test_distinct_urls_keep_first(spark):
    df = spark.createDataFrame([("u", 2, "b"), ("u", 1, "a"), ("v", 3, "c")], "url string, pos int, t string")
    assert sorted((r.url, r.t) for r in U.distinct_urls(df, position=["pos"]).collect()) == [("u", "a"), ("v", "c")]


def test_week_starts_on_monday(spark):
    df = spark.createDataFrame([(dt.date(2024, 1, 14),), (dt.date(2024, 1, 15),)], "d date")
    got = [r[0] for r in df.orderBy("d").select(R.week_start("d")).collect()]
    assert got == [dt.date(2024, 1, 8), dt.date(2024, 1, 15)]


def test_contents_equal_inside_group_only_once(spark):
    df = spark.createDataFrame([(1, "a", "x" * 1000), (2, "a", "x" * 1000), (3, "b", "x" * 1000), (4, "a", "x" * 999)],
                               "item_key int, g string, body string")
    assert ST.distinct_contents(df, ["g"], "body", min_size=1000).select("item_key").orderBy("item_key").collect() == [(1,), (3,)]
    assert ST.distinct_contents(df, ["g"], "body").select("item_key").orderBy("item_key").collect() == [(1,), (3,), (4,)]
