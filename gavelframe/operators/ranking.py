"""Ordered lists, boards, calendars and first-of-group selections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gavelframe.functions.scoring import visit_urgency
from gavelframe.functions.values import as_date, col, has_number
from gavelframe.operators.filters import is_upcoming
from gavelframe.operators.topk import top_k_per_key


def top_opportunities(scored: DataFrame, as_of, *, limit: int = 10, min_score: float | None = None,
                      score: str = "opportunity_score") -> DataFrame:
    """Best scored upcoming listings; a distributed top-n, never a full sort."""
    due = scored.filter(F.col(score).isNotNull() & is_upcoming(as_of))
    if min_score is not None:
        due = due.filter(F.col(score) >= min_score)
    return due.orderBy(F.col(score).desc(), F.col("listing_key")).limit(limit)


def newest(listings: DataFrame, as_of, limit: int = 5) -> DataFrame:
    return listings.filter(is_upcoming(as_of)).orderBy(F.col("sale_date").desc(), "listing_key").limit(limit)


def top_neighbourhoods(stats: DataFrame, *, sort_by: str = "median_price_m2", ascending: bool = False,
                       limit: int = 20) -> DataFrame:
    if sort_by not in ("median_price_m2", "n_transactions", "mean_price_m2"):
        raise ValueError(f"cannot sort by {sort_by}")
    key = F.col(sort_by).asc() if ascending else F.col(sort_by).desc()
    return stats.orderBy(key, "postal_code").limit(limit)


def rank_batch(valuated: DataFrame) -> DataFrame:
    """All valuated listings, best score first; rows that failed to price stay, with score 0."""
    return valuated.orderBy(F.col("opportunity_score").desc_nulls_last(), "listing_key")


def closest_to_median(rows: DataFrame, medians: DataFrame, keys: list[str], *, k: int = 15,
                      price: str = "price_m2", tie: str = "item_key") -> DataFrame:
    """The ``k`` rows of each group nearest to the group's median.

    The distance takes the *rounded* price against the raw median.
    """
    near = rows.join(medians, keys).withColumn(
        "distance", F.abs(F.rint(F.col(price)) - F.col("median_price_m2")))
    return top_k_per_key(near, keys, [F.col("distance"), F.col(tie)], k)


def latest_year(indicators: DataFrame, key: str = "insee") -> DataFrame:
    """The newest year's row of each commune and its five newest years as a list; of repeated years the greatest row counts."""
    others = [c for c in indicators.columns if c not in (key, "year")]
    # one row a year first: a commune's list is as long as its years, however often they repeat
    yearly = indicators.groupBy(key, "year").agg(F.max(F.struct("year", *others)).alias("row"))
    return yearly.groupBy(key).agg(
        F.max_by("row", "year").alias("newest"),
        F.slice(F.sort_array(F.collect_list("row"), asc=False), 1, 5).alias("recent"),
    ).select(key, "newest.*", "recent")


def first_distinct(items, cap: int | None = None) -> Column:
    """Array without repeats, first occurrence kept, at most ``cap`` items."""
    out = F.array_distinct(F.filter(col(items), lambda x: x.isNotNull() & (x != "")))
    return out if cap is None else F.slice(out, 1, cap)


def next_visit(as_of, visits="visit_times") -> Column:
    today = as_date(as_of)
    return F.array_min(F.filter(col(visits), lambda v: v.cast("date") >= today))


def gain(value="market_value", price="start_price") -> Column:
    return F.when(has_number(value) & has_number(price), col(value) - col(price)).otherwise(0.0)


def with_board_columns(listings: DataFrame, as_of) -> DataFrame:
    return listings.withColumns({
        "next_visit": next_visit(as_of), "gain": gain(),
        "discount_shown": F.coalesce("discount_pct", F.lit(0.0)),
    }).withColumn("days_to_visit", F.date_diff(F.col("next_visit").cast("date"), as_date(as_of)))


def opportunity_board(listings: DataFrame, as_of) -> DataFrame:
    """Listings by next planned visit, then by gain."""
    return with_board_columns(listings, as_of).orderBy(
        F.col("next_visit").asc_nulls_last(), F.col("gain").desc(), "listing_key")


def visit_rows(listings: DataFrame, as_of, days: int = 90) -> DataFrame:
    """One row per planned visit of listings sold within ``days``."""
    return (listings.filter(is_upcoming(as_of, days))
            .withColumn("visit_at", F.explode("visit_times"))
            .filter(F.col("visit_at").cast("date") >= as_date(as_of)))


def week_start(day) -> Column:
    """Monday of the week."""
    return F.date_trunc("week", col(day)).cast("date")


def visit_calendar(visits: DataFrame, as_of, *, week_offset: int = 0) -> DataFrame:
    """Visits of one Monday-based week, with days to go and urgency."""
    monday = F.date_add(week_start(as_date(as_of)), 7 * week_offset)
    day = F.col("visit_at").cast("date")
    return (visits.filter(day.between(monday, F.date_add(monday, 6)))
            .withColumns({"visit_day": day, "days_to_visit": F.date_diff(day, as_date(as_of))})
            .withColumn("urgency", visit_urgency("days_to_visit")))


def first_k_of_array(df: DataFrame, items: str, k: int, *, item: str = "item", pos: str = "pos") -> DataFrame:
    """Rows of an array column in order, at most ``k`` per record."""
    return df.select("*", F.posexplode(F.slice(F.col(items), 1, k)).alias(pos, item)).drop(items)
