"""CSV folders by city: every row once, as formatted, dealt out before it is text."""

import datetime as dt

from pyspark.sql import functions as F

from gavelframe.sinks import exports as X

CITIES = ["Paris", "Saint Ouen", "", None, "L'Haÿ, \"les\"\nRoses"]


def rows(spark, n=400):
    day = dt.date(2024, 1, 1)
    return spark.createDataFrame(
        [(f"k{i}", CITIES[i % 5], f"{i} rue\nde la \"Paix\"; {i}", day if i % 3 else None, i * 1.5, "Bien à vendre") for i in range(n)],
        "listing_key string, city string, address string, sale_date date, start_price double, description string")


def read(spark, path):
    back = spark.read.option("header", True).option("multiLine", True).option("escape", "\\").csv(path)
    return sorted(tuple(r) for r in back.select(*[F.coalesce(c, F.lit("")) for c in X.COLUMNS], "city_slug").collect())


def test_city_folders_hold_the_same_rows_compressed_or_plain(spark, tmp_path):
    listings = rows(spark)
    X.export_by_city(listings, f"{tmp_path}/packed")
    X.export_by_city(listings, f"{tmp_path}/plain", compression="none")
    want = sorted(tuple(r) for r in X.export_rows(listings).withColumn("city_slug", X.city_slug("ville")).collect())
    assert read(spark, f"{tmp_path}/packed") == read(spark, f"{tmp_path}/plain") == want
    sizes = [sum(p.stat().st_size for p in (tmp_path / d).rglob("part-*")) for d in ("packed", "plain")]
    assert 4 * sizes[0] < sizes[1]


def test_listings_without_a_city_column(spark, tmp_path):
    X.export_by_city(rows(spark, 20).drop("city"), f"{tmp_path}/out")
    assert {r[-1] for r in read(spark, f"{tmp_path}/out")} == {"inconnu"} and len(read(spark, f"{tmp_path}/out")) == 20


def test_rows_are_dealt_out_before_they_are_formatted(spark, tmp_path, monkeypatch):
    seen, made = [], X.export_rows
    monkeypatch.setattr(X, "export_rows", lambda listings: seen.append(listings) or made(listings))
    X.export_by_city(rows(spark, 20), f"{tmp_path}/out")
    assert ["RebalancePartitions" in df._jdf.queryExecution().optimizedPlan().toString() for df in seen] == [True]
