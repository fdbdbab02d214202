import pytest

from gavelframe.functions.scoring import estimate_confidence
from gavelframe.operators import estimates as E
from gavelframe.operators import filters as FL

EST = "listing_key string, source_type string, price_m2 double, total double, n_points long, age_days int, geo_match string, notes string, confidence double"


@pytest.mark.parametrize("n,age,geo,want", [
    (20, 180, "exact", 100), (19, 181, "commune", 70), (10, 365, "department", 60), (5, 366, "", 30), (3, 730, None, 20), (2, 731, "x", 0)])
def test_confidence_ladder(spark, n, age, geo, want):
    df = spark.createDataFrame([(n, age, geo)], "n_points int, age_days int, geo_match string")
    assert df.select(estimate_confidence().alias("c")).first().c == want


def test_combination_and_reliability(spark):
    rows = [("x", "dvf", 3000.0, None, 20, 100, "commune", "", 90.0), ("x", "commune", 3600.0, None, 50, 400, "commune", "", 70.0),
            ("y", "dvf", 2000.0, None, 3, 700, "commune", "", 0.0), ("z", "dvf", None, None, 1, 0, "", "", 30.0)]
    c = {r.listing_key: r for r in E.combine_estimates(spark.createDataFrame(rows, EST)).collect()}
    assert set(c) == {"x", "y"}
    assert c["x"].combined_price_m2 == pytest.approx((3000 * 90 + 3600 * 70) / 160)
    agreement = 100 - 300 / 3300 * 200
    assert c["x"].agreement == pytest.approx(agreement)
    assert c["x"].reliability_score == pytest.approx(min(100, 80 * 0.5 + 20 + agreement * 0.3)) and c["x"].reliability == "high"
    assert (c["y"].combined_price_m2, c["y"].agreement, c["y"].reliability) == (2000.0, 50.0, "low")


def test_no_source_is_insufficient(spark):
    subjects = spark.createDataFrame([("z", "75001", "maison", 50.0, 1000.0)], "listing_key string, postal_code string, property_type string, surface_m2 double, start_price double")
    r = E.recommend(subjects, E.combine_estimates(spark.createDataFrame([], EST))).first()
    assert r.reliability == "insufficient" and r.recommended_price_m2 is None
    assert r.warnings == ["Aucune source de données disponible", "Données insuffisantes pour une estimation fiable"]


def test_a_source_is_any_callable(spark):
    subjects = spark.createDataFrame([("z", "75001", "maison", 50.0)], "listing_key string, postal_code string, property_type string, surface_m2 double")

    def flat(rows):
        return rows.selectExpr("listing_key", "'notaires' AS source_type", "1234.0D AS price_m2", "NULL AS total", "20L AS n_points",
                               "10 AS age_days", "'exact' AS geo_match", "'' AS notes")

    got = E.source_estimates(subjects, [flat]).first()
    assert (got.price_m2, got.confidence) == (1234.0, 100.0)


def test_ask_median_correction(spark):
    rows = [("75001", "maison", 50.0, 50.0 * p) for p in (4000.0, 4637.0, 5000.0)] + [("75001", "maison", 50.0, 1.0)]
    ads = spark.createDataFrame(rows, "postal_code string, property_type string, surface_m2 double, price double")
    subject = spark.createDataFrame([("z", "75001", "maison", 59.0), ("w", "75001", "maison", 60.0)], "listing_key string, postal_code string, property_type string, surface_m2 double")
    got = E.from_ads(ads)(subject).collect()
    assert [(r.listing_key, r.price_m2, r.n_points) for r in got] == [("z", 4173.0, 3)]


@pytest.mark.parametrize("text,want", [
    ("Vente devant notaire", False), ("Tribunal Judiciaire, Me X notaire", True), ("Rien", True), ("Vente volontaire", False)])
def test_judicial(spark, text, want):
    assert spark.createDataFrame([(text,)], "text string").select(FL.is_judicial().alias("j")).first().j is want
