import datetime as dt

import pytest
from pyspark.sql import functions as F

from gavelframe.functions import keys as KEY
from gavelframe.sources import readers as RD
from gavelframe.text import cards as C
from gavelframe.text import fields as T
from gavelframe.text import html as H


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "t string").select(column.alias("v")).first().v


@pytest.mark.parametrize("text,want", [
    ("Mise à prix : 45 000 €", 45000.0), ("mise a prix 1.250.000,50 euros", 1250000.5), ("prix : 12 500 €", 12500.0),
    ("vendu 99 000 €", 99000.0), ("mise à prix : 0 €, soit 70 000 €", None), ("rien", None)])
def test_price(spark, text, want):
    assert one(spark, text, T.price("t")) == want


@pytest.mark.parametrize("text,want", [
    ("15 janvier 2024", dt.date(2024, 1, 15)), ("1er aout 2024", dt.date(2024, 8, 1)), ("3 août 2024", dt.date(2024, 8, 3)),
    ("31 février 2024", None), ("31/02/2024", None), ("05/03/2024", dt.date(2024, 3, 5)), ("7 FÉVRIER 2024", dt.date(2024, 2, 7))])
def test_french_date(spark, text, want):
    assert one(spark, text, T.french_date("t")) == want


def test_visits_default_hour_and_no_repeats(spark):
    v = one(spark, "Visites : 05/01/2024 et 05/01/2024, 12/01/2024", T.visits("t"))
    assert v == [dt.datetime(2024, 1, 5, 14), dt.datetime(2024, 1, 12, 14)]
    v = one(spark, "Visite sur place lundi 29 décembre 2025 de 10h à 11h", T.visits("t"))
    assert v == [dt.datetime(2025, 12, 29, 10)]


def test_address_is_not_the_agents(spark):
    text = "Un studio 12, rue des Lilas fleuris, 75011 Paris. Maître Dupont, 3 avenue de la Gare du Nord, Tél 01 02 03 04 05"
    assert one(spark, text, T.address("t")).startswith("12, rue des Lilas")
    assert one(spark, "Maître X, 3 avenue de la Gare du Nord, Paris", T.address("t")) is None


def test_similar_labels(spark):
    assert one(spark, "  Saint-Ouen   l'Été ", KEY.normalize_text("t")) == "saint ouen l ete"
    assert one(spark, "boulogne-billancourt", KEY.title_case("t")) == "Boulogne-Billancourt"


def test_html_reader_keeps_main_text_whole(spark):
    body = "mot " * 9000
    html = f"<html><head><title>T</title><style>x</style></head><body><nav><a href='/n'>n</a></nav><article>{body}<script>var a='<p>';</script><img src='/i.png'><a href='/d.pdf'>PV</a></article><footer>f</footer></body></html>"
    r = H.page_digest(H.read_pages(spark.createDataFrame([(1, html), (2, None)], "page_id long, html string"))).orderBy("page_id").collect()
    assert r[0].title == "T" and len(r[0].text) > 35000 and "f" not in r[0].text.split()[-1:]
    assert [link.url for link in r[0].links] == ["/n", "/d.pdf"] and r[0].images == ["/i.png"]
    assert "DOCUMENTS: PV: /d.pdf" in r[0].digest and r[1].text == ""


def test_sold_lots(spark):
    rows = [(1, "Appartement Marseille 4ème 45 m² Adjugé 80 000 €"), (2, "Box 13008 12 m² Adjugé 9 000 €"),
            (3, "Villa 83000 14 m² adjugé à 100 000 €"), (4, "Maison 13001 à venir"), (5, "13001 Adjudication inconnue adjugé 5 €")]
    got = {r.card_id: r for r in C.sold_lots(spark.createDataFrame(rows, "card_id int, text string")).collect()}
    assert set(got) == {1, 3}
    assert (got[1].postal_code, got[1].hammer_price, got[1].surface_m2) == ("13004", 80000.0, 45.0)
    assert (got[3].hammer_price, got[3].surface_m2, got[3].property_type) == (100000.0, None, "Maison")


def test_transactions_from_csv_files(spark, tmp_path):
    head = "date_mutation,nature_mutation,valeur_fonciere,adresse_numero,adresse_nom_voie,code_postal,nom_commune,type_local,surface_reelle_bati,nombre_pieces_principales,latitude,longitude\n"
    (tmp_path / "dvf_75_2023.csv").write_text(head + '2023-05-01,Vente,"100000,50",3,RUE A,75011,Paris,Appartement,"40,5",2,48.1,2.1\n'
                                              "bad,Vente,,,RUE B,75011,Paris,Maison,,x,,\n", encoding="utf-8")
    (tmp_path / "dvf_75_2024.csv").write_text(head + "2024-05-01,Vente,abc,3,RUE A,75011,Paris,Maison,40,2,48.1,2.1\n", encoding="utf-8")
    rows = sorted(RD.read_transactions(spark, str(tmp_path / "dvf_75_*.csv")).collect(), key=lambda r: -r.price)
    assert len(rows) == 2
    assert rows[0].price_m2 == pytest.approx(100000.5 / 40.5) and rows[0].address == "3 RUE A" and rows[0].department == "75"
    assert (rows[1].tx_date, rows[1].price, rows[1].surface_m2, rows[1].rooms, rows[1].price_m2) == (None, 0.0, None, None, None)
    RD.write_transactions(spark.createDataFrame(rows, RD.read_transactions(spark, str(tmp_path / "dvf_75_*.csv")).schema), str(tmp_path / "p"))
    plan = spark.read.parquet(str(tmp_path / "p")).filter(F.col("department") == "75")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(department" in plan


def test_listing_cache(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"k1": {"prix_m2": 4173, "prix_m2_raw": 4637, "nb_listings": 31, "cached_at": "2024-01-05T10:00:00.5", '
                                     '"comparables": [{"titre": "T2", "prix": 90000, "surface": 20.0, "prix_m2": 4500, "url": "u", "source": "s"}]}}', encoding="utf-8")
    c = RD.read_listing_cache(spark, str(tmp_path / "c.json"))
    row = c.first()
    assert (row.cache_key, row.price_m2, row.n_ads) == ("k1", 4173.0, 31) and row.cached_at.year == 2024
    assert abs(row.raw_price_m2 * 0.9 - row.price_m2) <= 1
    assert RD.cache_comparables(c).first().price_m2 == 4500.0


@pytest.mark.parametrize("minutes,fresh", [(23 * 60 + 59, True), (24 * 60, False)])
def test_freshness_boundary(spark, minutes, fresh):
    at = dt.datetime(2024, 1, 2) - dt.timedelta(minutes=minutes)
    df = spark.createDataFrame([(at,)], "t timestamp")
    assert df.select(KEY.is_fresh("t", "2024-01-02 00:00:00").alias("f")).first().f is fresh


def test_location_names_districts_and_listed_cities(spark):
    def place(text, url=None):
        rows = spark.createDataFrame([(text, url)], "t string, u string")
        p = T.location("t", "u")
        return tuple(rows.select(p["postal_code"], p["city"]).first())
    assert place("Un studio à Marseille 4ème\nMaître X, 13006 Marseille") == ("13004", "Marseille 4ème")
    assert place("Un studio sis commune de La Ciotat") == ("13600", "La Ciotat")
    assert place("Un studio 92300 Levallois Perret\nMise à prix") == ("92300", "Levallois Perret")
    assert place("Toulonnais") == (None, None)


def test_photos_are_all_kept(spark):
    html = "".join(f"<img src='/p{i}.jpg'>" for i in range(30)) + "<img data-lazy='/z.jpg' srcset='/a.jpg 1x, /b.jpg 2x'>"
    got = one(spark, html, T.photos("t", F.lit("https://x.example/l")))
    assert len(got) == 32 and got[-2:] == ["https://x.example/b.jpg", "https://x.example/z.jpg"]


def test_long_values_stay_whole(spark):
    assert len(one(spark, "x" * 20000, KEY.title_case("t"))) == 20000
    assert len(one(spark, "Désignation : " + "mot " * 900, T.description("t"))) == 3599


def test_city_from_a_url_of_its_region(spark):
    rows = [("/annonce/toulon/var/vente.html", "Toulon", "83000"), ("/vente/aix-en-provence/bouches-du-rhone/1", "Aix En Provence", "13100"),
            ("/marseille-14eme/bouches-du-rhone/", "Marseille", "13000"), ("/vieux-marseille-2eme/bouches-du-rhone/", "Marseille 2ème", "13002"),
            ("/paris-75/1", "Paris", "75000"), ("/nowhere/var/", None, None), ("/toulon-centre-3eme/x", "Toulon", "83000"), (None, None, None)]
    got = spark.createDataFrame([(i, "Une maison", u) for i, (u, _, _) in enumerate(rows)], "i int, t string, u string").select(
        "i", *[c.alias(n) for n, c in T.location(F.col("t"), F.col("u"), ["13", "83", "75"]).items()]).orderBy("i").collect()
    assert [(r.city, r.postal_code) for r in got] == [(c, p) for _, c, p in rows]
