"""CSV exports of listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gavelframe.functions.scoring import export_recommendation
from gavelframe.functions.values import has_text, number_text

# fixed values: export header
COLUMNS = [
    "id", "source", "url", "adresse", "code_postal", "ville", "type_bien", "surface_m2", "nb_pieces", "nb_chambres", "etage",
    "date_vente", "heure_vente", "dates_visite", "mise_a_prix_euros", "tribunal", "avocat", "pv_disponible", "pv_url",
    "prix_marche_estime", "prix_m2_marche", "decote_pourcent", "score_opportunite", "recommandation", "description",
]
ESSENTIAL = COLUMNS[:15]


def export_rows(listings: DataFrame, all_columns: bool = True, chars: int | None = None) -> DataFrame:
    """The formatted export columns; missing values are empty."""
    def own(name: str) -> Column:
        return F.col(name) if name in listings.columns else F.lit(None).cast("string")

    def text(name: str) -> Column:
        return F.coalesce(own(name).cast("string"), F.lit(""))

    def number(name: str, digits: int = 0) -> Column:
        return F.coalesce(number_text(own(name), digits), F.lit("")) if name in listings.columns else F.lit("")

    visits = F.coalesce(F.array_join(F.transform(own("visit_times"), lambda v: F.date_format(v, "dd/MM/yyyy HH:mm")), "; "), F.lit("")) \
        if "visit_times" in listings.columns else F.lit("")
    made = {
        "id": text("listing_id" if "listing_id" in listings.columns else "listing_key"),
        "source": text("source"), "url": text("url"), "adresse": text("address"), "code_postal": text("postal_code"),
        "ville": text("city"), "type_bien": text("property_type"), "surface_m2": text("surface_m2"), "nb_pieces": text("rooms"),
        "nb_chambres": text("bedrooms"), "etage": text("floor"),
        "date_vente": F.coalesce(F.date_format(own("sale_date"), "dd/MM/yyyy"), F.lit("")), "heure_vente": text("sale_time"),
        "dates_visite": visits, "mise_a_prix_euros": number("start_price"), "tribunal": text("court"), "avocat": text("agent_name"),
        "pv_disponible": F.when(has_text(own("report_url")), "Oui").otherwise("Non"), "pv_url": text("report_url"),
        "prix_marche_estime": number("market_value"), "prix_m2_marche": number("market_price_m2"),
        "decote_pourcent": number("discount_pct", 1), "score_opportunite": number("opportunity_score"),
        "recommandation": export_recommendation(own("discount_pct").cast("double")),
        "description": text("description") if chars is None else F.left(text("description"), F.lit(chars)),
    }
    return listings.select(*[made[c].alias(c) for c in (COLUMNS if all_columns else ESSENTIAL)])


def opportunities(listings: DataFrame, min_score: float = 50, ordered: bool = True) -> DataFrame:
    kept = listings.filter(F.coalesce("opportunity_score", F.lit(0.0)) >= min_score)
    return kept.orderBy(F.col("opportunity_score").desc(), "listing_key") if ordered else kept


def city_slug(city: str = "city") -> Column:
    named = F.when(has_text(city), F.col(city)).otherwise("Inconnu")
    return F.replace(F.lower(named), F.lit(" "), F.lit("_"))


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).csv(path)


def export_listings_csv(listings: DataFrame, path: str, all_columns: bool = True) -> None:
    write_csv(export_rows(listings, all_columns), path)


def export_opportunities(listings: DataFrame, path: str, min_score: float = 50) -> None:
    write_csv(export_rows(opportunities(listings, min_score)), path)


def export_by_city(listings: DataFrame, path: str, compression: str = "gzip") -> None:
    """One folder of CSV files per city; the rebalance keeps a large city on several writers.

    Typed rows are dealt out and formatted by the writer, as the formatted text is wider. Files are compressed, which Spark
    and other readers undo by their name; ``compression="none"`` leaves plain text.
    """
    city = city_slug("city") if "city" in listings.columns else F.lit("")
    dealt = listings.withColumn("_slug", city).hint("rebalance", "_slug")
    (export_rows(dealt).withColumn("city_slug", city_slug("ville")).write.mode("overwrite").option("header", True)
     .option("compression", compression).partitionBy("city_slug").csv(path))
