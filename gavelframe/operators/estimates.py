"""Price estimates of several sources, their combination, reliability and recommendation.

A source is any callable ``subjects -> estimates``: subjects are listings with
``listing_key, postal_code, property_type, surface_m2``, estimates have one row per
(listing, source) in the columns of ``ESTIMATE_COLUMNS``. Sources work on all subjects
at once and are combined by a union.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gavelframe.functions import constants as K
from gavelframe.functions.keys import age_in_days, department_of, estimate_cache_key, mid_year, thousands
from gavelframe.functions.scoring import estimate_confidence
from gavelframe.functions.values import half_even, has_number, has_text, lookup, number_text
from gavelframe.operators import comparables as C
from gavelframe.operators.medians import grouped_stats

ESTIMATE_COLUMNS = ["listing_key", "source_type", "price_m2", "total", "n_points", "age_days", "geo_match", "notes"]
PriceSource = Callable[[DataFrame], DataFrame]


def from_transactions(transactions: DataFrame, as_of) -> PriceSource:
    """Median of the 50 most recent sales within 30 % of the surface (60 m² when unknown)."""
    options = {"tolerance": 0.30, "k": 50, "default_surface": 60.0, "type_map": K.ESTIMATE_TYPE_MAP}

    def estimate(subjects: DataFrame) -> DataFrame:
        priced = C.market_prices(subjects, transactions, as_of, **options).filter(F.col("n_comparables") > 0)
        known = F.col("market_price_m2").isNotNull()
        return priced.select(
            "listing_key", F.lit("dvf").alias("source_type"),
            half_even("market_price_m2").alias("price_m2"),
            F.when(has_number("surface_m2"), half_even(F.col("market_price_m2") * F.col("probe_surface"))).alias("total"),
            F.col("n_valid").cast("long").alias("n_points"),
            F.when(known, F.coalesce(age_in_days("oldest_sale", as_of), F.lit(730))).otherwise(0).alias("age_days"),
            F.when(known, "commune").otherwise("").alias("geo_match"),
            F.when(known, F.concat(F.lit("Médiane de "), F.col("n_valid").cast("string"), F.lit(" transactions sur 24 mois")))
             .otherwise(F.concat(F.lit("Données insuffisantes ("), F.col("n_valid").cast("string"), F.lit(" transactions)"))).alias("notes"),
        )
    return estimate


def newest_indicators(indicators: DataFrame) -> DataFrame:
    """The newest year's figures of each commune, a map-side combinable aggregate."""
    row = F.struct("year", "price_m2", "n_sales")
    return indicators.groupBy("insee").agg(F.max_by(row, "year").alias("r")).select("insee", "r.*")


def commune_lookup(subjects: DataFrame, indicators: DataFrame, insee_postal: DataFrame | None = None) -> DataFrame:
    """Subjects with their commune's newest indicators, else those of the department's lowest code.

    A postal code finds its commune through the code table (``insee, postal_code``), or as a code of the
    same spelling. The table is joined, so a country's communes are no literal of the plan.
    """
    newest = newest_indicators(indicators)
    figures = F.struct("insee", "year", "price_m2", "n_sales")
    places = newest.select("*", F.col("insee").alias("postal_code"), F.lit(1).alias("order"))
    if insee_postal is None:
        insee_postal = subjects.sparkSession.createDataFrame(list(K.INSEE_POSTAL.items()), "insee string, postal_code string")
    codes = insee_postal.filter(has_text("postal_code")).select("insee", "postal_code").distinct()
    places = places.unionByName(newest.join(codes, "insee").withColumn("order", F.lit(0)))
    exact = places.groupBy("postal_code").agg(F.min_by(figures, F.struct("order", "insee")).alias("own"))
    fallback = newest.groupBy(department_of("insee").alias("_department")).agg(F.min_by(figures, "insee").alias("near"))
    return (subjects.withColumn("_department", department_of("postal_code"))
            .join(exact, "postal_code", "left").join(fallback, "_department", "left")
            .withColumn("_hit", F.coalesce("own", "near"))
            .withColumn("geo_match", F.when(F.col("own").isNotNull(), "commune").when(F.col("near").isNotNull(), "department"))
            .select(*subjects.columns, F.col("_hit.insee").alias("insee"), F.col("_hit.year").alias("year"),
                    F.col("_hit.price_m2").alias("commune_price_m2"), F.col("_hit.n_sales").alias("n_sales"), "geo_match"))


def from_communes(indicators: DataFrame, as_of, insee_postal: DataFrame | None = None) -> PriceSource:
    """Mean price of the commune's newest year."""
    def estimate(subjects: DataFrame) -> DataFrame:
        hit = commune_lookup(subjects, indicators, insee_postal).filter(has_number("commune_price_m2"))
        n = F.coalesce("n_sales", F.lit(0)).cast("long")
        return hit.select(
            "listing_key", F.lit("commune").alias("source_type"), half_even("commune_price_m2").alias("price_m2"),
            F.when(has_number("surface_m2"), half_even(F.col("commune_price_m2") * F.col("surface_m2"))).alias("total"),
            n.alias("n_points"), age_in_days(mid_year("year"), as_of).alias("age_days"), "geo_match",
            F.concat(F.lit("Moyenne commune "), F.col("year").cast("string"), F.lit(" ("),
                     F.when(n > 0, n.cast("string")).otherwise("?"), F.lit(" mutations)")).alias("notes"))
    return estimate


def ask_medians(ads: DataFrame) -> DataFrame:
    """Median asking price per m² of each (postal code, type, surface band) with three valid ads.

    ``ads``: ``postal_code, property_type, surface_m2, price``.
    """
    priced = ads.withColumn("price_m2", F.when(has_number("price") & (F.col("surface_m2") > 0), F.col("price") / F.col("surface_m2")))
    valid = priced.filter(F.col("price_m2").between(K.MIN_PRICE_M2, K.MAX_PRICE_M2)).withColumn("cache_key", estimate_cache_key())
    stats = grouped_stats(valid, ["cache_key"], "price_m2").filter(F.col("n") >= K.MIN_COMPARABLES)
    return stats.select("cache_key", F.col("n").alias("n_ads"), F.col("median").alias("median_price_m2"))


def from_ads(ads: DataFrame) -> PriceSource:
    """Median asking price less the asking premium, by postal code, type and surface band."""
    medians = ask_medians(ads)

    def estimate(subjects: DataFrame) -> DataFrame:
        hit = subjects.withColumn("cache_key", estimate_cache_key()).join(medians, "cache_key")
        return hit.select(
            "listing_key", F.lit("listings").alias("source_type"),
            half_even(F.col("median_price_m2") * F.lit(1 - K.ASKING_PRICE_PREMIUM)).alias("price_m2"),
            F.lit(None).cast("double").alias("total"), F.col("n_ads").cast("long").alias("n_points"),
            F.lit(1).alias("age_days"), F.lit("commune").alias("geo_match"),
            F.concat(F.lit("Prix demandés -10% ("), F.col("n_ads").cast("string"), F.lit(" annonces)")).alias("notes"))
    return estimate


def source_estimates(subjects: DataFrame, sources: Iterable[PriceSource]) -> DataFrame:
    """Estimates of every source with their confidence."""
    rows = reduce(DataFrame.unionByName, [s(subjects).select(*ESTIMATE_COLUMNS) for s in sources])
    return rows.withColumn("confidence", estimate_confidence())


def _whole(c) -> Column:
    """A number without decimals, thousands set apart by commas, ties to even."""
    return thousands(c, ",")


def _source_notes(said: dict) -> Column:
    return F.array(*[F.concat(F.lit(f"{name}: "), F.coalesce(said.get(s, F.lit(None)), F.lit(K.SOURCE_WITHOUT_DATA)))
                     for s, name in K.SOURCE_NAMES.items()])


def combine_estimates(estimates: DataFrame) -> DataFrame:
    """One row per listing: weighted price, range, one column per source, a note on each, agreement, reliability."""
    e = estimates.filter(has_number("price_m2"))
    price, weight = F.col("price_m2"), F.col("confidence")
    said = F.concat(_whole(price), F.lit(" €/m² ("), F.col("n_points").cast("string"), F.lit(" données, confiance: "), number_text(weight), F.lit("%)"))
    out = e.groupBy("listing_key").agg(
        F.count(F.lit(1)).alias("n_sources"),
        F.sum(price * weight).alias("_pw"), F.sum(weight).alias("_w"), F.avg(price).alias("_mean"),
        F.min(price).alias("min_price_m2"), F.max(price).alias("max_price_m2"),
        F.stddev_pop(price).alias("_dev"), F.avg(weight).alias("_confidence"),
        *[F.max(F.when(F.col("source_type") == s, price)).alias(f"{s}_price_m2") for s in K.SOURCE_NAMES],
        *[F.max(F.when(F.col("source_type") == s, said)).alias(f"_{s}") for s in K.SOURCE_NAMES],
    ).withColumn("source_notes", _source_notes({s: F.col(f"_{s}") for s in K.SOURCE_NAMES})).drop(*[f"_{s}" for s in K.SOURCE_NAMES])
    agreement = (F.when(F.col("n_sources") < 2, 50.0)
                 .when(F.col("_mean") > 0, F.greatest(F.lit(0.0), 100 - F.col("_dev") / F.col("_mean") * 200)).otherwise(0.0))
    out = out.withColumns({
        "combined_price_m2": F.when(F.col("_w") > 0, F.col("_pw") / F.col("_w")).otherwise(F.col("_mean")),
        "agreement": agreement,
    }).withColumn("reliability_score", F.least(
        F.lit(100.0),
        F.col("_confidence") * 0.5 + F.least(F.lit(20), F.col("n_sources") * 10) + F.col("agreement") * 0.3))
    score = F.col("reliability_score")
    return out.withColumn("reliability", (
        F.when((score >= 70) & (F.col("n_sources") >= 2), "high").when(score >= 40, "medium")
        .when(score > 0, "low").otherwise("insufficient"))).drop("_pw", "_w", "_mean", "_dev", "_confidence")


def recommend(subjects: DataFrame, combined: DataFrame) -> DataFrame:
    """Subjects with recommended price, total, discount, and texts on agreement and reliability."""
    s = subjects.join(combined, "listing_key", "left").withColumns({
        "n_sources": F.coalesce("n_sources", F.lit(0)),
        "reliability": F.coalesce("reliability", F.lit("insufficient")),
        "reliability_score": F.coalesce("reliability_score", F.lit(0.0)),
        "recommended_price_m2": half_even("combined_price_m2"),
        "source_notes": F.coalesce("source_notes", _source_notes({})),
    })
    price, surface = F.col("recommended_price_m2"), F.col("surface_m2")
    value = F.when(has_number(price) & has_number(surface), price * surface)
    several = F.col("n_sources") >= 2
    agreed = number_text("agreement")
    note = (F.when(several & (F.col("agreement") >= 80), F.concat(F.lit("Sources en accord ("), agreed, F.lit("%)")))
             .when(several & (F.col("agreement") >= 50), F.concat(F.lit("Accord modéré entre sources ("), agreed, F.lit("%)"))))
    apart = F.concat(F.lit("Désaccord entre sources ("), agreed, F.lit("%) - plage: "), _whole("min_price_m2"),
                     F.lit(" - "), _whole("max_price_m2"), F.lit(" €/m²"))
    warnings = F.array_compact(F.array(
        F.when(F.col("n_sources") == 0, F.lit(K.NO_SOURCE)),
        F.when(several & (F.col("agreement") < 50), apart),
        F.when(F.col("reliability") == "low", F.lit(K.LOW_RELIABILITY)),
        F.when((F.col("reliability") == "insufficient"), F.lit(K.NO_RELIABILITY)),
    ))
    return s.withColumns({
        "recommended_total": half_even(value),
        "discount_vs_market": F.when(has_number("start_price") & (value != 0), (value - F.col("start_price")) / value * 100),
        "note": note, "notes": F.concat("source_notes", F.array_compact(F.array(note))), "warnings": warnings,
    }).drop("source_notes")


def source_details(estimates: DataFrame, samples: DataFrame | None = None, top: int = 5) -> DataFrame:
    """Per listing a map source -> detail struct (at most one entry per source type).

    ``samples`` optionally gives ``listing_key, source_type, rank, sample`` rows whose first
    ``top`` are attached.
    """
    e = estimates.filter(has_number("price_m2"))
    fields = ["price_m2", "confidence", "n_points", "age_days", "geo_match", "notes"]
    if samples is not None:
        shown = samples.filter(F.col("rank") <= top).groupBy("listing_key", "source_type").agg(
            F.sort_array(F.collect_list(F.struct("rank", "sample"))).alias("samples"))
        e = e.join(shown, ["listing_key", "source_type"], "left")
        fields = [*fields, "samples"]
    return e.withColumn("name", lookup("source_type", K.SOURCE_NAMES)).groupBy("listing_key").agg(
        F.map_from_entries(F.collect_list(F.struct("source_type", F.struct("name", *fields)))).alias("sources"))
