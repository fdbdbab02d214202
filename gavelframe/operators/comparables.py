"""Comparable sales of each listing: a surface-band join to recent transactions.

A naive join pairs every listing with every sale of its postal code and type, which
is quadratic in the hottest area. Here both sides are reduced first, exactly:

* listings collapse to distinct *probes* (postal code, type word, surface): listings
  that agree on these share their comparables;
* sales collapse to *heads*: the ``k`` most recent of each surface value, and the
  ``k`` most recent of each geometric surface bucket. A probe's window covers some
  buckets entirely (their heads suffice) and cuts two at its edges (there the heads
  of single surface values are tested against the exact bounds).

So the rows a probe meets depend on ``k`` and the width of a bucket, not on how many
sales or listings an area holds. Sales without a surface pass every window and form
one more head per (postal code, type word).
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gavelframe.functions import constants as K
from gavelframe.functions.values import as_date, has_number, has_text, lookup, number_or_null
from gavelframe.operators.topk import top_k_per_key

PROBE = ["postal_code", "type_word", "probe_surface"]
_CELLS_PER_WINDOW = 8


def type_word(property_type, type_map=None, default=K.DEFAULT_LOCAL_TYPE):
    """Word looked for in the transactions' local type; unknown types use ``default``."""
    return lookup(F.lower(property_type), type_map or K.MARKET_TYPE_MAP, default)


def with_type_words(transactions: DataFrame, words) -> DataFrame:
    """One row per type word a transaction's local type contains (normally one)."""
    # explode + filter stays in generated code, an array filter would not
    local = F.lower("local_type")
    hits = F.array(*[F.when(local.contains(w.lower()), F.lit(w)) for w in words])
    return transactions.withColumn("type_word", F.explode(hits)).filter(F.col("type_word").isNotNull())


def _most_recent():
    return [F.col("tx_date").desc_nulls_last(), F.col("tx_key")]


def with_probe(listings: DataFrame, *, type_map=None, default_surface: float = 50.0) -> DataFrame:
    """Listings plus the columns that decide their comparables."""
    return listings.filter(has_text("postal_code")).withColumns({
        "type_word": type_word(F.col("property_type"), type_map),
        "probe_surface": F.coalesce(number_or_null("surface_m2"), F.lit(float(default_surface))),
    })


def probe_comparables(listings: DataFrame, transactions: DataFrame, as_of, *,
                      tolerance: float = 0.25, months: int = 24, k: int = 20,
                      type_map=None, default_surface: float = 50.0, salts: int = 0) -> DataFrame:
    """The ``k`` most recent comparable sales of each distinct probe, ranked."""
    type_map = type_map or K.MARKET_TYPE_MAP
    words = list(dict.fromkeys([*type_map.values(), K.DEFAULT_LOCAL_TYPE]))
    today = as_date(as_of)
    width = math.log((1 + tolerance) / (1 - tolerance)) / _CELLS_PER_WINDOW

    def bucket(surface):
        return F.floor(F.log(surface) / F.lit(width)).cast("int")

    recent = transactions.filter(
        F.col("tx_date").isNull()
        | F.col("tx_date").between(F.date_sub(today, months * K.DAYS_PER_MONTH), today)
    ).filter(has_text("postal_code"))
    # no surface (NULL or 0) passes every window, a negative one is a fault of the record
    recent = recent.filter(F.col("surface_m2").isNull() | (F.col("surface_m2") >= 0))
    recent = with_type_words(recent, words).select(
        "postal_code", "type_word", "tx_key", "tx_date", "surface_m2", "price_m2", "price",
        "address", "commune",
        F.when(has_number("surface_m2"), bucket(F.col("surface_m2"))).alias("cell"),
    )
    area = ["postal_code", "type_word"]
    # map tasks trim to k rows per key before either shuffle, so a hot bucket never crosses the network whole;
    # both branches read one shuffle by surface (no filter may set them apart; sales without a surface fail `inside`)
    by_surface = top_k_per_key(recent, area + ["cell", "surface_m2"], _most_recent(), k, salts=salts).drop("rank")
    by_cell = top_k_per_key(by_surface, area + ["cell"], _most_recent(), k, salts=salts).drop("rank")
    heads = (
        by_surface.withColumn("grain", F.lit("surface"))
        .unionByName(by_cell.withColumn("grain", F.when(F.col("cell").isNull(), "none").otherwise("cell")))
        .withColumn("cell", F.coalesce("cell", F.lit(0)))
    )

    probes = with_probe(listings, type_map=type_map, default_surface=default_surface).select(*PROBE).distinct()
    low = F.col("probe_surface") * F.lit(1 - tolerance)
    high = F.col("probe_surface") * F.lit(1 + tolerance)
    probes = probes.withColumns({"low": low, "high": high}).withColumns({
        "first_cell": bucket(F.col("low")), "last_cell": bucket(F.col("high")),
    })
    covered = F.transform(
        F.sequence("first_cell", "last_cell"),
        lambda c: F.struct(
            F.when((c == F.col("first_cell")) | (c == F.col("last_cell")), F.lit("surface"))
             .otherwise(F.lit("cell")).alias("grain"),
            c.alias("cell"),
        ),
    )
    every = F.array(F.struct(F.lit("none").alias("grain"), F.lit(0).alias("cell")))
    probes = (probes.withColumn("at", F.explode(F.concat(covered, every)))
                    .select(*PROBE, "low", "high", "at.grain", "at.cell"))

    inside = (F.col("grain") != "surface") | F.col("surface_m2").between(F.col("low"), F.col("high"))
    met = probes.join(heads, area + ["grain", "cell"]).filter(inside).drop("grain", "cell", "low", "high")
    return top_k_per_key(met, PROBE, _most_recent(), k)


def comparables(listings: DataFrame, transactions: DataFrame, as_of, *, key: str = "listing_key", **options) -> DataFrame:
    """One row per (listing, comparable sale), ``rank`` 1 the most recent."""
    found = probe_comparables(listings, transactions, as_of, **options)
    shape = {n: options[n] for n in ("type_map", "default_surface") if n in options}
    return with_probe(listings, **shape).select(key, *PROBE).join(found, PROBE)


def summarise(found: DataFrame, keys: list[str], as_of) -> DataFrame:
    """Counts, robust price and age of each group of at most ``k`` comparables."""
    valid = has_number("price_m2") & F.col("price_m2").between(K.MIN_PRICE_M2, K.MAX_PRICE_M2)
    out = found.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_comparables"),
        F.count_if(valid).alias("n_valid"),
        F.median(F.when(valid, F.col("price_m2"))).alias("_median"),
        F.coalesce(F.sum(F.date_diff(as_date(as_of), F.col("tx_date"))), F.lit(0)).alias("total_age_days"),
        F.min("tx_date").alias("oldest_sale"),
    )
    return out.withColumn(
        "market_price_m2", F.when(F.col("n_valid") >= K.MIN_COMPARABLES, F.col("_median"))
    ).drop("_median")


def market_prices(listings: DataFrame, transactions: DataFrame, as_of, **options) -> DataFrame:
    """Listings with the summary of their comparables; counts are 0 where there is none.

    The summary is computed per probe and joined back, so listings that share a probe
    never multiply the comparables.
    """
    found = probe_comparables(listings, transactions, as_of, **options)
    shape = {n: options[n] for n in ("type_map", "default_surface") if n in options}
    stats = summarise(found, PROBE, as_of)
    probed = listings.withColumns({
        "type_word": F.when(has_text("postal_code"), type_word(F.col("property_type"), shape.get("type_map"))),
        "probe_surface": F.coalesce(number_or_null("surface_m2"), F.lit(float(shape.get("default_surface", 50.0)))),
    })
    return probed.join(stats, PROBE, "left").withColumns({
        "n_comparables": F.coalesce("n_comparables", F.lit(0)),
        "n_valid": F.coalesce("n_valid", F.lit(0)),
    })
