"""Price every upcoming listing against comparable sales and rank the result."""

from __future__ import annotations

from pyspark.sql import DataFrame

from gavelframe.functions.scoring import appraised, valuated
from gavelframe.operators.comparables import market_prices
from gavelframe.operators.filters import upcoming
from gavelframe.operators.ranking import top_opportunities


def analyze(listings: DataFrame, transactions: DataFrame, as_of, days: int = 60) -> DataFrame:
    """Upcoming listings with market price, value, discount, score, label, risk and texts."""
    due = upcoming(listings, as_of, days)
    return appraised(valuated(market_prices(due, transactions, as_of)), as_of)


def best_opportunities(listings: DataFrame, transactions: DataFrame, as_of, *,
                       days: int = 60, min_score: float = 50, limit: int = 10) -> DataFrame:
    due = upcoming(listings, as_of, days)
    scored = valuated(market_prices(due, transactions, as_of))
    return top_opportunities(scored, as_of, min_score=min_score, limit=limit)
