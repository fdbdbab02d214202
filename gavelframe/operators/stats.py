"""Grouped statistics over transactions, listings and adjudications."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gavelframe.functions import constants as K
from gavelframe.functions.values import (
    as_date, contains_fold, half_even, has_number, has_text, number_or_null, text_or_null,
)
from gavelframe.operators.filters import is_upcoming
from gavelframe.operators.medians import grouped_stats

ALL_TYPES = "Tous"


def price_m2_stats(transactions: DataFrame, as_of, *, local_type: str = "Appartement", months: int = 24,
                   postal_codes: list[str] | None = None) -> DataFrame:
    """Count, mean, median, min and max price per m² by postal code over the last months.

    With ``postal_codes`` every asked code is answered, with count 0 and NULLs if empty.
    """
    since = F.date_sub(as_date(as_of), months * K.DAYS_PER_MONTH)
    rows = transactions.filter(
        (F.col("tx_date").isNull() | (F.col("tx_date") >= since)) & contains_fold("local_type", local_type)
        & (F.col("price_m2") > 0))
    if postal_codes is not None:
        rows = rows.filter(F.col("postal_code").isin(postal_codes))
    stats = grouped_stats(rows, ["postal_code"], "price_m2", cell_width=None)
    out = stats.select(
        "postal_code", F.col("n").alias("n_transactions"),
        *[half_even(c, 2).alias(f"{name}_price_m2")
          for c, name in [("mean", "mean"), ("median", "median"), ("low", "min"), ("high", "max")]])
    if postal_codes is None:
        return out
    asked = transactions.sparkSession.createDataFrame([(c,) for c in postal_codes], "postal_code string")
    return asked.join(out, "postal_code", "left").withColumn(
        "n_transactions", F.coalesce("n_transactions", F.lit(0)))


def _typed(transactions: DataFrame, group_types: list[str]) -> DataFrame:
    """Every row once as ``Tous`` and, for the asked types, once as its own type."""
    own = F.when(F.col("local_type").isin(group_types), F.col("local_type"))
    return (transactions.withColumn("type_group", F.explode(F.array(F.lit(ALL_TYPES), own)))
            .filter(F.col("type_group").isNotNull()))


def _area_stats(rows: DataFrame, keys: list[str]) -> DataFrame:
    stats = grouped_stats(
        rows, keys, "price_m2",
        sums={"mean_surface_m2": number_or_null("surface_m2"), "mean_price": number_or_null("price")},
        firsts={"city": text_or_null("commune")})
    return stats.filter(F.col("n") >= K.MIN_COMPARABLES).select(
        *keys,
        F.coalesce("city", F.concat(F.lit("CP "), F.col("postal_code"))).alias("city"),
        F.col("n").alias("n_transactions"),
        half_even("median").alias("median_price_m2"), half_even("mean").alias("mean_price_m2"),
        half_even("low").alias("min_price_m2"), half_even("high").alias("max_price_m2"),
        F.coalesce(half_even("mean_surface_m2", 1), F.lit(0.0)).alias("mean_surface_m2"),
        F.coalesce(half_even("mean_price"), F.lit(0.0)).alias("mean_price"))


def _priced(transactions: DataFrame, department, year, local_type) -> DataFrame:
    t = transactions.filter(
        F.col("price_m2").between(K.MIN_PRICE_M2, K.MAX_PRICE_M2) & has_text("postal_code"))
    if department:
        t = t.filter(F.col("department") == department) if "department" in t.columns else t.filter(
            F.col("postal_code").startswith(department))
    if year:
        t = t.filter(F.col("tx_date").isNull() | (F.year("tx_date") == year))
    if local_type:
        t = t.filter(F.col("local_type") == local_type)
    return t


def neighbourhood_stats(transactions: DataFrame, *, department=None, year=None, local_type=None) -> DataFrame:
    """Price statistics of every postal code with at least three banded sales.

    A sale without a date counts in every year; the type must match exactly. Order by
    ``median_price_m2`` descending (``top_neighbourhoods``) for display.
    """
    return _area_stats(_priced(transactions, department, year, local_type), ["postal_code"])


def price_evolution(transactions: DataFrame, years: list[int], *, postal_code=None, local_type=None) -> DataFrame:
    """``neighbourhood_stats`` per year; an undated sale counts in each asked year."""
    t = _priced(transactions, None, None, local_type)
    if postal_code:
        t = t.filter(F.col("postal_code") == postal_code)
    asked = F.array(*[F.lit(y) for y in years])
    of_row = F.when(F.col("tx_date").isNull(), asked).otherwise(F.array(F.year("tx_date")))
    t = t.withColumn("year", F.explode(of_row)).filter(F.col("year").isin(years))
    return _area_stats(t, ["postal_code", "year"])


def filter_by_codes(stats: DataFrame, postal_codes: list[str]) -> DataFrame:
    """Rows of the given codes with ``position``, their place in the list (a caller's short list)."""
    place = F.array_position(F.array(*[F.lit(c) for c in postal_codes]), F.col("postal_code"))
    return stats.withColumn("position", place.cast("int") - 1).filter(F.col("position") >= 0).orderBy("position")


def compare_neighbourhoods(transactions: DataFrame, postal_codes: list[str], *, year=None, local_type=None) -> DataFrame:
    near = transactions.filter(F.col("postal_code").isin(postal_codes))
    return filter_by_codes(neighbourhood_stats(near, year=year, local_type=local_type), postal_codes)


def department_summary(transactions: DataFrame, *, year=None, types=("Appartement", "Maison")) -> DataFrame:
    """Per department and type group: areas, sales, weighted median, dearest and cheapest area."""
    rows = _typed(_priced(transactions, None, year, None), list(types))
    areas = _area_stats(rows, ["postal_code", "type_group"]).withColumn("department", F.left("postal_code", F.lit(2)))
    dearest = F.struct("median_price_m2", "postal_code")
    cheapest = F.struct(F.col("median_price_m2"), F.col("postal_code"))
    return areas.groupBy("department", "type_group").agg(
        F.count(F.lit(1)).alias("n_areas"),
        F.sum("n_transactions").alias("n_transactions"),
        half_even(F.sum(F.col("median_price_m2") * F.col("n_transactions")) / F.sum("n_transactions")).alias("overall_median_price_m2"),
        F.max_by("postal_code", dearest).alias("dearest_postal"),
        F.min_by("postal_code", cheapest).alias("cheapest_postal"))


def store_stats(listings: DataFrame, agents: DataFrame, as_of) -> DataFrame:
    """(metric, label, n) rows: total, by status, by source, upcoming, agents."""
    none = F.lit(None).cast("string")
    counted = listings.groupingSets([["status"], ["source"], []], "status", "source").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(is_upcoming(as_of)).alias("upcoming"), F.grouping_id().alias("_set"))
    # bits of the grouping id: 2 = status rolled up, 1 = source rolled up
    rows = F.when(F.col("_set") == 1, F.array(F.struct(F.lit("by_status").alias("metric"), F.col("status").alias("label"), "n"))).when(
        F.col("_set") == 2, F.array(F.struct(F.lit("by_source").alias("metric"), F.col("source").alias("label"), "n"))).otherwise(
        F.array(F.struct(F.lit("total").alias("metric"), none.alias("label"), "n"),
                F.struct(F.lit("upcoming").alias("metric"), none.alias("label"), F.col("upcoming").alias("n"))))
    people = agents.agg(F.count(F.lit(1)).alias("n")).select(F.lit("agents").alias("metric"), none.alias("label"), "n")
    return counted.select(F.explode(rows).alias("r")).select("r.*").unionByName(people)


def adjudication_stats(adjudications: DataFrame, prefixes: list[str] | None = None, property_type=None) -> DataFrame:
    """Hammer-price statistics by postal code, for any of the code prefixes."""
    a = adjudications
    if prefixes:
        hit = F.lit(False)
        for p in prefixes:
            hit = hit | F.col("postal_code").startswith(p)
        a = a.filter(hit)
    if property_type:
        a = a.filter(F.col("property_type") == property_type)
    return a.groupBy("postal_code").agg(
        F.min("city").alias("city"), F.count(F.lit(1)).alias("n_sales"),
        F.avg("hammer_price").alias("mean_price"), F.avg("price_m2").alias("mean_price_m2"),
        F.min("price_m2").alias("min_price_m2"), F.max("price_m2").alias("max_price_m2"),
        F.avg("surface_m2").alias("mean_surface_m2"),
        F.min("sale_date").alias("first_sale"), F.max("sale_date").alias("last_sale"))


def adjudication_count(adjudications: DataFrame) -> DataFrame:
    return adjudications.agg(F.count(F.lit(1)).alias("n"))


def city_summary(listings: DataFrame) -> DataFrame:
    """Listings by city: count, start prices, mean score, opportunities."""
    price, score = number_or_null("start_price"), number_or_null("opportunity_score")
    return listings.filter(has_text("city")).groupBy("city").agg(
        F.count(F.lit(1)).alias("n_listings"),
        F.avg(price).alias("mean_price"), F.min(price).alias("min_price"), F.max(price).alias("max_price"),
        F.avg(score).alias("mean_score"),
        F.count_if(F.coalesce("opportunity_score", F.lit(0.0)) >= 50).alias("n_opportunities"))


def listing_kpis(listings: DataFrame, as_of) -> DataFrame:
    """Totals of the dashboard in one pass; ``upcoming`` is every future listing, ``upcoming_30d`` the next 30 days."""
    opportunity = is_upcoming(as_of, 60) & (F.coalesce("discount_pct", F.lit(0.0)) >= 20)
    return listings.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(is_upcoming(as_of)).alias("upcoming"),
        F.count_if(is_upcoming(as_of, 30)).alias("upcoming_30d"), F.count_if(opportunity).alias("opportunities"))


def board_kpis(board: DataFrame) -> DataFrame:
    """Counts over ``with_board_columns`` rows and the sum of positive gains."""
    return board.agg(
        F.count("next_visit").alias("with_visit"), F.count_if(F.col("gain") > 50000).alias("gain_over_50k"),
        F.count_if(F.col("discount_shown") >= 30).alias("discount_over_30"),
        F.sum(F.when(F.col("gain") > 0, F.col("gain")).otherwise(0.0)).alias("total_gain"))


def visit_kpis(visits: DataFrame, as_of, week_offset: int = 0) -> DataFrame:
    """Visits from ``as_of`` on: this week (Monday to Sunday), today, the next 7 days, all."""
    today, day = as_date(as_of), F.col("visit_at").cast("date")
    monday = F.date_add(F.date_trunc("week", today).cast("date"), 7 * week_offset)
    ahead = visits.filter(day >= today)
    return ahead.agg(
        F.count_if(day.between(monday, F.date_add(monday, 6))).alias("this_week"),
        F.count_if(day == today).alias("today"),
        F.count_if(day <= F.date_add(today, 7)).alias("next_7_days"),
        F.count(F.lit(1)).alias("all_ahead"))


def weekly_visits(visits: DataFrame) -> DataFrame:
    """Visits and mean amount per Monday-based week (the batch twin of the streaming window)."""
    return visits.groupBy(F.date_trunc("week", F.col("visit_at")).cast("date").alias("week")).agg(
        F.count(F.lit(1)).alias("n_visits"), F.avg("amount").alias("mean_amount"))


def distinct_contents(items: DataFrame, group: list[str], content: str, min_size: int = 0,
                      tie: str = "item_key") -> DataFrame:
    """One row per (group, content hash), contents under ``min_size`` bytes dropped.

    Only the hash and the tie key are shuffled, never the contents.
    """
    return (items.withColumns({"content_hash": F.md5(F.col(content)), "size": F.octet_length(F.col(content))})
            .filter(F.col("size") >= min_size)
            .groupBy(*group, "content_hash").agg(F.min(tie).alias(tie), F.first("size").alias("size")))


def content_totals(distinct: DataFrame, owner: str) -> DataFrame:
    return distinct.agg(
        F.count(F.lit(1)).alias("total_items"), F.countDistinct(owner).alias("owners"),
        half_even(F.sum("size") / (1024 * 1024), 2).alias("total_size_mb"))


def with_own_price_m2(adjudications: DataFrame) -> DataFrame:
    """Hammer price per m², rounded half-even."""
    return adjudications.withColumn("price_m2", F.when(
        has_number("surface_m2") & (F.col("surface_m2") > 0), half_even(F.col("hammer_price") / F.col("surface_m2"))))
