"""Cached price estimates: a keyed table and its JSON form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gavelframe.sinks.tables import PARTS, merge_parts
from gavelframe.sources import schemas as S


def write_listing_cache(entries: DataFrame, base: str, *, batch: str | None = None, order: list[str] = (), parts: int = PARTS) -> None:
    """Keep the newest entry of each ``cache_key`` by (``cached_at``, order) as a table; `read_parts` reads it.

    ``batch`` names a batch that may be replayed (`merge_parts`).
    """
    merge_parts(entries, base, ["cache_key"], order=["cached_at", *order], batch=batch, parts=parts)


def export_listing_cache(entries: DataFrame, path: str) -> None:
    """The columns of `read_listing_cache` as JSON, one object ``{key: entry}`` a line; rows without a key are left out."""
    entry = F.struct(
        F.col("price_m2").alias("prix_m2"), F.col("raw_price_m2").alias("prix_m2_raw"), F.col("n_ads").alias("nb_listings"),
        F.col("geo_match").alias("geographic_match"), "source_url", "sources", "notes", "comparables",
        F.date_format("cached_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("cached_at")).cast(S.CACHE_ENTRY)
    keyed = entries.filter(F.col("cache_key").isNotNull())
    keyed.select(F.to_json(F.create_map("cache_key", entry)).alias("value")).write.mode("overwrite").text(path)
