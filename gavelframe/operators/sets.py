"""Unions, differences and order-preserving deduplication."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union_sources(*frames: DataFrame) -> DataFrame:
    """Rows of all sources; columns a source lacks read as NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def difference_by_key(rows: DataFrame, matched: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key does not occur in ``matched``."""
    return rows.join(matched.select(*keys), keys, "left_anti")


def distinct_urls(links: DataFrame, *, url: str = "url", position: list[str] = ("pos",)) -> DataFrame:
    """First occurrence of every url by position; a map-side combinable aggregate, not a window."""
    others = [c for c in links.columns if c not in (url, *position)]
    place = F.struct(*position)
    kept = links.groupBy(url).agg(F.min_by(F.struct(*position, *others), place).alias("row"))
    return kept.select(url, "row.*")
