"""Multi-source price analysis of listings."""

from __future__ import annotations

from pyspark.sql import DataFrame

from gavelframe.operators import estimates as E


def detailed_analysis(subjects: DataFrame, transactions: DataFrame, indicators: DataFrame, ads: DataFrame, as_of,
                      insee_postal: DataFrame | None = None) -> DataFrame:
    """Recommended price, reliability, discount, notes and warnings from three sources."""
    sources = [E.from_transactions(transactions, as_of), E.from_communes(indicators, as_of, insee_postal), E.from_ads(ads)]
    return E.recommend(subjects, E.combine_estimates(E.source_estimates(subjects, sources)))
