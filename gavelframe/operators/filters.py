"""Predicates and filtered lists over listings, transactions, adjudications and pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gavelframe.functions import constants as K
from gavelframe.functions.values import as_date, col, contains_any, contains_fold, has_number

def _by_sale_date():
    return [F.col("sale_date").asc_nulls_first(), F.col("listing_key")]


def search_listings(listings: DataFrame, *, postal_code=None, city=None, property_type=None,
                    price_min=None, price_max=None, surface_min=None, surface_max=None,
                    ordered: bool = True) -> DataFrame:
    """Listings that meet every given condition; a NULL never meets a bound."""
    tests = [
        (postal_code, lambda v: F.col("postal_code") == v),
        (city, lambda v: contains_fold("city", v)),
        (property_type, lambda v: F.col("property_type") == v),
    ]
    bounds = [
        (price_min, lambda v: F.col("start_price") >= v),
        (price_max, lambda v: F.col("start_price") <= v),
        (surface_min, lambda v: F.col("surface_m2") >= v),
        (surface_max, lambda v: F.col("surface_m2") <= v),
    ]
    for value, test in tests:
        if value:
            listings = listings.filter(test(value))
    for value, test in bounds:
        if value is not None:
            listings = listings.filter(test(value))
    return listings.orderBy(*_by_sale_date()) if ordered else listings


def list_listings(listings: DataFrame, status: str | None = None, limit: int | None = None, offset: int = 0) -> DataFrame:
    """One page of listings in sale-date order."""
    if status:
        listings = listings.filter(F.col("status") == status)
    page = listings.orderBy(*_by_sale_date()).offset(offset)
    return page if limit is None else page.limit(limit)


def is_upcoming(as_of, days: int | None = None) -> Column:
    today = as_date(as_of)
    due = F.col("sale_date") >= today
    return due if days is None else due & (F.col("sale_date") <= F.date_add(today, days))


def upcoming(listings: DataFrame, as_of, days: int = 30, ordered: bool = False) -> DataFrame:
    """Listings sold within ``days`` days from ``as_of``, both ends included."""
    due = listings.filter(is_upcoming(as_of, days))
    return due.orderBy(*_by_sale_date()) if ordered else due


def lookup_listing(listings: DataFrame, *, key=None, url=None) -> DataFrame:
    if key is not None:
        return listings.filter(F.col("listing_key") == key)
    return listings.filter(F.col("url") == url)


def lookup_agent(agents: DataFrame, agent_id=None) -> DataFrame:
    """One agent by id, or all of them by name; missing texts read as ''."""
    texts = ["firm", "address", "phone", "email", "site"]
    out = agents.withColumns({c: F.coalesce(c, F.lit("")) for c in texts if c in agents.columns})
    if agent_id is not None:
        return out.filter(F.col("agent_id") == agent_id)
    return out.orderBy("name", "agent_id")


def search_transactions(transactions: DataFrame, *, postal_code=None, commune=None, department=None,
                        local_type=None, date_min=None, date_max=None, price_min=None, price_max=None,
                        surface_min=None, surface_max=None) -> DataFrame:
    """Transactions meeting the given conditions; a missing date or surface passes its range.

    ``department`` prunes partitions of a table written by ``write_transactions``; it is
    taken from the postal code when not given.
    """
    t = transactions
    department = department or (postal_code[:2] if postal_code else None)
    if department:
        t = t.filter(F.col("department") == department) if "department" in t.columns else t.filter(
            F.left("postal_code", F.lit(2)) == department)
    if postal_code:
        t = t.filter(F.col("postal_code") == postal_code)
    if commune:
        t = t.filter(contains_fold("commune", commune))
    if local_type:
        t = t.filter(contains_fold("local_type", local_type))
    undated, no_surface = F.col("tx_date").isNull(), ~has_number("surface_m2")
    if date_min:
        t = t.filter(undated | (F.col("tx_date") >= as_date(date_min)))
    if date_max:
        t = t.filter(undated | (F.col("tx_date") <= as_date(date_max)))
    if price_min:
        t = t.filter(F.col("price") >= price_min)
    if price_max:
        t = t.filter(F.col("price") <= price_max)
    if surface_min:
        t = t.filter(no_surface | (F.col("surface_m2") >= surface_min))
    if surface_max:
        t = t.filter(no_surface | (F.col("surface_m2") <= surface_max))
    return t


def in_price_band(price_m2="price_m2", low: float = K.MIN_PRICE_M2, high: float = K.MAX_PRICE_M2) -> Column:
    return col(price_m2).between(low, high)


def list_adjudications(adjudications: DataFrame, postal_prefix: str | None = None,
                       property_type: str | None = None, limit: int | None = None) -> DataFrame:
    a = adjudications
    if postal_prefix:
        a = a.filter(F.col("postal_code").startswith(postal_prefix))
    if property_type:
        a = a.filter(F.col("property_type") == property_type)
    page = a.orderBy(F.col("sale_date").desc_nulls_last(), "source", "postal_code", "hammer_price")
    return page if limit is None else page.limit(limit)


def in_target_area(listings: DataFrame, postal_codes=None) -> DataFrame:
    """Listings whose postal code is monitored (a list of under 200 codes inside the predicate)."""
    return listings.filter(F.col("postal_code").isin(list(postal_codes or K.MONITORED_POSTALS)))


def url_in_departments(url="url", departments=None) -> Column:
    return col(url).rlike("-(" + "|".join(departments or K.TARGET_DEPARTMENTS) + ")/")


def only_opportunities(listings: DataFrame, min_discount: float = 20) -> DataFrame:
    return listings.filter(F.coalesce("discount_pct", F.lit(0.0)) >= min_discount)


def is_judicial(text="text") -> Column:
    """Judicial sale by its wording; a notarial one is refused unless it is judicial too."""
    low = F.lower(col(text))
    judicial = contains_any(low, K.JUDICIAL_WORDS)
    notarial = contains_any(low, K.NOTARIAL_WORDS)
    return judicial | ~(notarial | low.contains("notaire"))


def is_low_confidence(confidence="confidence", threshold: float = 0.7) -> Column:
    return col(confidence) < threshold


def needs_ocr(text="text", min_chars: int = 100) -> Column:
    return F.length(F.regexp_replace(col(text), r"^\s+|\s+$", "")) < min_chars


def listing_table(listings: DataFrame) -> DataFrame:
    """The columns of the listing table, with the price per m² at the start price."""
    own = F.when(has_number("start_price") & (F.col("surface_m2") > 0), F.col("start_price") / F.col("surface_m2"))
    wanted = ["listing_key", "sale_date", "city", "property_type", "surface_m2", "start_price"]
    tail = ["market_price_m2", "discount_pct", "opportunity_score", "agent_name", "agent_phone", "agent_site",
            "report_url", "url"]
    return listings.select(
        *[c for c in wanted if c in listings.columns], own.alias("own_price_m2"),
        *[c for c in tail if c in listings.columns])
