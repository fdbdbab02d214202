"""Valuation, scores, labels and texts as Column expressions over a priced listing.

A priced listing carries ``market_price_m2, n_comparables, total_age_days`` next to
the listing's own columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gavelframe.functions import constants as K
from gavelframe.functions.values import (
    as_date, col, contains_any, descending_ladder, has_items, has_number, has_text, ladder,
    lookup, number_text,
)

COST_FACTOR = 1 + sum(K.COST_SHARES)


def market_value(price_m2="market_price_m2", surface="surface_m2") -> Column:
    return F.when(has_number(price_m2) & has_number(surface), col(price_m2) * col(surface))


def discount(value="market_value", price="start_price") -> Column:
    """Share of the market value saved at the start price."""
    return F.when(has_number(value) & has_number(price), (col(value) - col(price)) / col(value))


def opportunity_score() -> Column:
    n = F.col("n_comparables")
    age = F.col("total_age_days") / n
    points = (
        F.coalesce(ladder("discount", K.DISCOUNT_POINTS, 0), F.lit(0))
        + ladder(n, K.COUNT_POINTS, 0)
        + descending_ladder(age, K.AGE_POINTS, 5)
        + ladder(n, K.LOCATION_POINTS, 0)
    )
    return F.when(n > 0, points).otherwise(0).cast("double")


def recommendation(discount_="discount") -> Column:
    d = col(discount_)
    return F.when(d.isNull(), K.RECOMMENDATION_NO_DATA).otherwise(
        ladder(d, K.RECOMMENDATION_LADDER, K.RECOMMENDATION_BELOW))


def export_recommendation(discount_pct="discount_pct") -> Column:
    d = col(discount_pct)
    return F.when(d.isNull(), K.EXPORT_NO_DATA).otherwise(ladder(d, K.EXPORT_LADDER, K.EXPORT_BELOW))


def valuated(priced: DataFrame) -> DataFrame:
    """Market value, discount, score and recommendation of priced listings."""
    return (
        priced.withColumn("market_value", market_value())
        .withColumn("discount", discount())
        .withColumns({
            "discount_pct": F.col("discount") * 100,
            "opportunity_score": opportunity_score(),
            "recommendation": recommendation(),
        })
    )


def total_cost(price="start_price") -> Column:
    return col(price) * F.lit(COST_FACTOR)


def potential_profit() -> Column:
    return F.when(has_number("market_value") & has_number("start_price"), F.col("market_value") - total_cost())


def roi_pct() -> Column:
    return F.when(total_cost() > 0, potential_profit() / total_cost() * 100)


def own_price_m2(price="start_price", surface="surface_m2") -> Column:
    return F.when(has_number(price) & has_number(surface), col(price) / col(surface))


def investment_score() -> Column:
    ratio = F.when(has_number("market_price_m2"), own_price_m2() / F.col("market_price_m2"))
    bonus = F.when(ratio < 0.5, 20).when(ratio < 0.7, 15).when(ratio < 0.8, 10).otherwise(0)
    many = F.when(F.col("n_comparables") >= 10, 10).otherwise(0)
    return F.least(F.lit(100.0), F.col("opportunity_score") * 0.5 + bonus + many)


def risk_score() -> Column:
    n = F.col("n_comparables")
    occupied = has_text("description") & contains_any(F.lower("description"), K.OCCUPIED_WORDS)
    suspicious = (has_number("start_price") & has_number("market_value")
                  & (F.col("start_price") < F.col("market_value") * 0.3))

    def points(condition, value):
        return F.when(condition, value).otherwise(0)

    risk = (
        F.when(n < 3, 20).when(n < 5, 10).otherwise(0)
        + points(~has_number("surface_m2"), 15)
        + points(~has_items("visit_times"), 10)
        + points(F.col("discount_pct") < 10, 15)
        + points(occupied, 20)
        + points(suspicious, 15)
    )
    return F.least(F.lit(100), risk).cast("double")


def badge_key() -> Column:
    d = F.col("discount_pct")
    return (
        F.when(d.isNull(), "unknown")
        .when((d >= 40) & (F.col("risk_score") < 40), "exceptional")
        .when(d >= 30, "opportunity")
        .when(d >= 20, "good_deal")
        .when(d >= 0, "fair")
        .otherwise("overpriced")
    )


def _texts(*conditional) -> Column:
    return F.array_compact(F.array(*[F.when(c, t) for c, t in conditional]))


def strengths() -> Column:
    d, own = F.col("discount_pct"), own_price_m2()
    market = F.col("market_price_m2")
    return _texts(
        (d >= 20, F.concat(F.lit("Décote de "), number_text(d), F.lit("% par rapport au marché"))),
        (F.col("n_comparables") >= 10, F.lit("Nombreuses transactions comparables (données fiables)")),
        (F.col("surface_m2") > 50,
         F.concat(F.lit("Belle surface de "), F.col("surface_m2").cast("string"), F.lit("m²"))),
        (has_items("visit_times"),
         F.concat(F.size("visit_times").cast("string"), F.lit(" date(s) de visite programmée(s)"))),
        (has_text("report_url"), F.lit("Procès-verbal disponible")),
        (has_number(market) & (own < market * 0.7),
         F.concat(F.lit("Prix/m² très attractif ("), number_text(own), F.lit("€ vs "),
                  number_text(market), F.lit("€ marché)"))),
    )


def risks() -> Column:
    text, d = F.lower("description"), F.col("discount_pct")
    return _texts(
        (F.col("n_comparables") < 3, F.lit("Peu de données comparables (estimation moins fiable)")),
        (~has_number("surface_m2"), F.lit("Surface non renseignée")),
        (~has_items("visit_times"), F.lit("Aucune date de visite connue")),
        (text.contains(K.OCCUPIED_WORDS[0]), F.lit("Bien potentiellement occupé")),
        (contains_any(text, K.WORK_WORDS), F.lit("Travaux probablement nécessaires")),
        (has_number(d) & (d < 10), F.lit("Faible décote par rapport au marché")),
        (d < 0, F.lit("Prix supérieur au marché!")),
    )


def notes(as_of) -> Column:
    days = F.date_diff(F.col("sale_date"), as_date(as_of))
    return _texts(
        (days > 0, F.concat(F.lit("Vente dans "), days.cast("string"), F.lit(" jours"))),
        (days == 0, F.lit("Vente aujourd'hui!")),
        (days < 0, F.lit("Vente passée")),
        (has_number("market_price_m2"),
         F.concat(F.lit("Prix moyen du secteur: "), number_text("market_price_m2"), F.lit("€/m²"))),
        (has_text("court"), F.concat(F.lit("Tribunal: "), F.col("court"))),
    )


def appraised(valuated_: DataFrame, as_of) -> DataFrame:
    """Valuated listings plus profit, scores, badge and texts."""
    badges = {k: v[0] for k, v in K.BADGES.items()}
    colours = {k: v[1] for k, v in K.BADGES.items()}
    return (
        valuated_.withColumns({
            "potential_profit": potential_profit(),
            "roi_pct": roi_pct(),
            "investment_score": investment_score(),
            "risk_score": risk_score(),
        })
        .withColumn("badge_key", badge_key())
        .withColumns({
            "badge": lookup("badge_key", badges),
            "badge_colour": lookup("badge_key", colours),
            "strengths": strengths(),
            "risks": risks(),
            "notes": notes(as_of),
        })
    )


def report_struct(as_of, key: str = "listing_key") -> Column:
    """The per-listing report as one nested value."""
    return F.struct(
        F.col(key), as_date(as_of).alias("report_date"), F.col("n_comparables"),
        F.col("market_price_m2"), F.col("market_value"), F.col("discount_pct"),
        F.col("opportunity_score").alias("score"), F.col("badge").alias("recommendation"),
        F.col("strengths"), F.col("risks"),
    )


# --- estimates of several sources ---------------------------------------------------------

def estimate_confidence(n="n_points", age="age_days", geo="geo_match") -> Column:
    return (
        ladder(F.coalesce(col(n), F.lit(0)), K.CONFIDENCE_COUNT, 0)
        + descending_ladder(col(age), K.CONFIDENCE_AGE, 0)
        + F.coalesce(lookup(geo, K.CONFIDENCE_GEO), F.lit(0))
    ).cast("double")


# --- display bands ---------------------------------------------------------------------------

def gain_band(gain="gain") -> Column:
    g = col(gain)
    return (F.when(g > 100000, "exceptional").when(g > 50000, "opportunity")
             .when(g > 20000, "interesting").otherwise(""))


def discount_colour(pct="discount_pct") -> Column:
    d = F.coalesce(col(pct), F.lit(0.0))
    return F.when(d >= 30, "green").when(d >= 20, "orange").otherwise("blue")


def score_colour(score="opportunity_score") -> Column:
    s = F.coalesce(col(score), F.lit(0.0))
    return F.when(s >= 70, "green").when(s >= 50, "orange").otherwise("gray")


def visit_urgency(days) -> Column:
    d = col(days)
    return (F.when(d == 0, "today").when(d == 1, "tomorrow").when(d <= 3, "soon").otherwise("later"))


def visit_colour(days) -> Column:
    d = col(days)
    return F.when(d <= 7, "red").when(d <= 14, "orange").when(d.isNotNull(), "green")
