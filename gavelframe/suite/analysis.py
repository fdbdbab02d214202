"""Comparables, market price, valuation, scores, labels and the opportunity ranking."""

from __future__ import annotations

from pyspark.sql import functions as F

from gavelframe.functions import constants as K
from gavelframe.functions import scoring as S
from gavelframe.functions.values import half_even
from gavelframe.operators import comparables as C
from gavelframe.operators import filters as FL
from gavelframe.operators import ranking as R
from gavelframe.plans import analyze as plan
from gavelframe.sources import testbed as T
from gavelframe.suite.registry import query, sql_case, sql_ladder

AS_OF = T.AS_OF
TODAY = f"DATE '{AS_OF}'"


def comps_sql(where="TRUE", *, tolerance="0.25", k=20, default=50.0, types=K.MARKET_TYPE_MAP) -> str:
    """CTEs ``probed`` and ``comps``: the plain band join, one row per pair."""
    word = sql_case("property_type", types, "'Appartement'")
    return (
        T.cte("transactions", "listings") + f""",
probed AS (
  SELECT *, {word} AS type_word, coalesce(nullif(surface_m2, 0), {default}) AS probe_surface
  FROM listings WHERE postal_code IS NOT NULL AND postal_code <> '' AND {where}),
comps AS (
  SELECT p.listing_key, t.tx_key, t.tx_date, t.surface_m2, t.price, t.price_m2, t.address, t.commune,
    row_number() OVER (PARTITION BY p.listing_key ORDER BY t.tx_date DESC NULLS LAST, t.tx_key) AS rank
  FROM probed p JOIN transactions t
    ON t.postal_code = p.postal_code AND contains(lower(t.local_type), lower(p.type_word))
   AND (t.tx_date IS NULL OR (t.tx_date >= {TODAY} - 720 AND t.tx_date <= {TODAY}))
   AND (t.surface_m2 IS NULL OR t.surface_m2 = 0
        OR (t.surface_m2 >= p.probe_surface * (1 - {tolerance}) AND t.surface_m2 <= p.probe_surface * (1 + {tolerance})))
  QUALIFY rank <= {k})""")


STATS_SQL = """,
stats AS (
  SELECT listing_key, count(*) AS n_comparables,
    count(*) FILTER (WHERE price_m2 BETWEEN 500 AND 15000) AS n_valid,
    median(price_m2) FILTER (WHERE price_m2 BETWEEN 500 AND 15000) AS med,
    coalesce(sum(DATE '1998-01-01' - tx_date), 0) AS total_age_days, min(tx_date) AS oldest_sale
  FROM comps GROUP BY listing_key),
priced AS (
  SELECT l.*, coalesce(n_comparables, 0) AS n_comparables, coalesce(n_valid, 0) AS n_valid,
    CASE WHEN n_valid >= 3 THEN med END AS market_price_m2, total_age_days, oldest_sale
  FROM listings l LEFT JOIN stats USING (listing_key))"""

VALUED_SQL = STATS_SQL + f""",
valued0 AS (
  SELECT *, CASE WHEN surface_m2 <> 0 THEN market_price_m2 * surface_m2 END AS market_value FROM priced),
valued1 AS (
  SELECT *, CASE WHEN market_value <> 0 AND start_price <> 0 THEN (market_value - start_price) / market_value END AS discount FROM valued0),
valued AS (
  SELECT *, discount * 100 AS discount_pct,
    CASE WHEN n_comparables > 0 THEN
      {sql_ladder('discount', K.DISCOUNT_POINTS, '0')} + {sql_ladder('n_comparables', K.COUNT_POINTS, '0')}
      + CASE WHEN total_age_days / n_comparables <= 180 THEN 15 WHEN total_age_days / n_comparables <= 365 THEN 10 ELSE 5 END
      + {sql_ladder('n_comparables', K.LOCATION_POINTS, '0')} ELSE 0 END::DOUBLE AS opportunity_score,
    CASE WHEN discount IS NULL THEN '{K.RECOMMENDATION_NO_DATA}' ELSE {sql_ladder('discount', K.RECOMMENDATION_LADDER, repr(K.RECOMMENDATION_BELOW))} END AS recommendation
  FROM valued1)"""

DUE = f"sale_date >= {TODAY} AND sale_date <= {TODAY} + 60"
DUE_VALUED = comps_sql(DUE) + VALUED_SQL
VALUE_COLUMNS = ["listing_key", "n_comparables", "market_price_m2", "market_value", "discount_pct",
                 "opportunity_score", "recommendation"]


def due(spark, sf_dir):
    return FL.upcoming(T.listings(spark, sf_dir), AS_OF, 60)


def valued(spark, sf_dir):
    return S.valuated(C.market_prices(due(spark, sf_dir), T.transactions(spark, sf_dir), AS_OF))


@query("comparables_market", comps_sql(DUE) + """
SELECT listing_key, tx_key, rank, tx_date, surface_m2, price_m2 FROM comps""", headline=True)
def comparables_market(spark, sf_dir):
    """Band join, 25 %, the 20 most recent sales."""
    rows = C.comparables(due(spark, sf_dir), T.transactions(spark, sf_dir), AS_OF)
    return rows.select("listing_key", "tx_key", "rank", "tx_date", "surface_m2", "price_m2")


@query("comparables_estimate", comps_sql(DUE, tolerance="0.3", k=50, default=60.0, types=K.ESTIMATE_TYPE_MAP) + """
SELECT listing_key, tx_key, rank, tx_date, surface_m2, price_m2 FROM comps""", headline=True)
def comparables_estimate(spark, sf_dir):
    """Band join, 30 %, the 50 most recent sales."""
    rows = C.comparables(due(spark, sf_dir), T.transactions(spark, sf_dir), AS_OF, tolerance=0.30, k=50,
                         default_surface=60.0, type_map=K.ESTIMATE_TYPE_MAP)
    return rows.select("listing_key", "tx_key", "rank", "tx_date", "surface_m2", "price_m2")


@query("type_words", T.cte("transactions") + """
SELECT w AS type_word, count(*) AS n FROM transactions,
  (VALUES ('Appartement'), ('Maison'), ('Local'), ('Dépendance')) v(w)
WHERE contains(lower(local_type), lower(w)) GROUP BY w""")
def type_words(spark, sf_dir):
    """Transactions by the type word their local type contains."""
    t = C.with_type_words(T.transactions(spark, sf_dir), ["Appartement", "Maison", "Local", "Dépendance"])
    return t.groupBy("type_word").agg(F.count(F.lit(1)).alias("n"))


@query("robust_market_price", comps_sql(DUE) + STATS_SQL + f"""
SELECT listing_key, n_comparables, n_valid, market_price_m2, oldest_sale FROM priced WHERE {DUE}""", headline=True)
def robust_market_price(spark, sf_dir):
    """Exact banded median of the comparables, NULL under three valid ones."""
    m = C.market_prices(due(spark, sf_dir), T.transactions(spark, sf_dir), AS_OF)
    return m.select("listing_key", "n_comparables", "n_valid", "market_price_m2", "oldest_sale")


@query("valuation", DUE_VALUED + f"""
SELECT {', '.join(VALUE_COLUMNS)} FROM valued WHERE {DUE}""", headline=True)
def valuation(spark, sf_dir):
    """Market value, discount, opportunity score and recommendation of each due listing."""
    return valued(spark, sf_dir).select(*VALUE_COLUMNS)


@query("top_opportunities", DUE_VALUED + f"""
SELECT {', '.join(VALUE_COLUMNS)} FROM valued WHERE {DUE} AND opportunity_score >= 50
ORDER BY opportunity_score DESC, listing_key LIMIT 10""", headline=True)
def top_opportunities(spark, sf_dir):
    """The flagship: the ten best priced upcoming listings."""
    best = plan.best_opportunities(T.listings(spark, sf_dir), T.transactions(spark, sf_dir), AS_OF)
    return best.select(*VALUE_COLUMNS)


@query("rank_batch", DUE_VALUED + f"""
SELECT listing_key, opportunity_score, recommendation FROM valued WHERE {DUE}""")
def rank_batch(spark, sf_dir):
    return R.rank_batch(valued(spark, sf_dir)).select("listing_key", "opportunity_score", "recommendation")


APPRAISED_SQL = DUE_VALUED + """,
visited AS (
  SELECT *, (visit_one IS NOT NULL)::INT + (visit_two IS NOT NULL)::INT AS n_visits,
    CASE WHEN surface_m2 <> 0 AND start_price <> 0 THEN start_price / surface_m2 END AS own
  FROM valued),
profits AS (
  SELECT *, CASE WHEN market_value <> 0 AND start_price <> 0 THEN market_value - start_price * 1.15 END AS potential_profit,
    least(100, opportunity_score * 0.5
      + CASE WHEN own / market_price_m2 < 0.5 THEN 20 WHEN own / market_price_m2 < 0.7 THEN 15 WHEN own / market_price_m2 < 0.8 THEN 10 ELSE 0 END
      + CASE WHEN n_comparables >= 10 THEN 10 ELSE 0 END)::DOUBLE AS investment_score,
    least(100, CASE WHEN n_comparables < 3 THEN 20 WHEN n_comparables < 5 THEN 10 ELSE 0 END
      + CASE WHEN coalesce(surface_m2, 0) = 0 THEN 15 ELSE 0 END
      + CASE WHEN n_visits = 0 THEN 10 ELSE 0 END
      + CASE WHEN discount_pct < 10 THEN 15 ELSE 0 END
      + CASE WHEN contains(lower(description), 'occupé') OR contains(lower(description), 'loué') THEN 20 ELSE 0 END
      + CASE WHEN start_price <> 0 AND market_value <> 0 AND start_price < market_value * 0.3 THEN 15 ELSE 0 END)::DOUBLE AS risk_score
  FROM visited),
judged AS (
  SELECT *, CASE WHEN discount_pct IS NULL THEN 'unknown' WHEN discount_pct >= 40 AND risk_score < 40 THEN 'exceptional'
      WHEN discount_pct >= 30 THEN 'opportunity' WHEN discount_pct >= 20 THEN 'good_deal'
      WHEN discount_pct >= 0 THEN 'fair' ELSE 'overpriced' END AS badge_key
  FROM profits)"""


def appraisal(spark, sf_dir):
    return plan.analyze(T.listings(spark, sf_dir), T.transactions(spark, sf_dir), AS_OF)


@query("profit_roi", APPRAISED_SQL + f"""
SELECT listing_key, round_even(potential_profit * 100, 0) / 100 AS potential_profit,
  CASE WHEN start_price * 1.15 > 0 THEN round_even(potential_profit / (start_price * 1.15) * 100 * 100, 0) / 100 END AS roi_pct
FROM judged WHERE {DUE}""")
def profit_roi(spark, sf_dir):
    return appraisal(spark, sf_dir).select(
        "listing_key", half_even("potential_profit", 2).alias("potential_profit"), half_even("roi_pct", 2).alias("roi_pct"))


@query("investment_risk_badge", APPRAISED_SQL + f"""
SELECT listing_key, investment_score, risk_score, badge_key,
  {sql_case('badge_key', {k: v[0] for k, v in K.BADGES.items()}, 'NULL')} AS badge,
  {sql_case('badge_key', {k: v[1] for k, v in K.BADGES.items()}, 'NULL')} AS badge_colour
FROM judged WHERE {DUE}""", headline=True)
def investment_risk_badge(spark, sf_dir):
    return appraisal(spark, sf_dir).select(
        "listing_key", "investment_score", "risk_score", "badge_key", "badge", "badge_colour")


_ZERO = "CAST(round_even({}, 0) AS BIGINT)::VARCHAR"


@query("strengths_risks_notes", APPRAISED_SQL + f"""
SELECT listing_key,
  concat_ws(' | ',
    CASE WHEN discount_pct >= 20 THEN 'Décote de ' || {_ZERO.format('discount_pct')} || '% par rapport au marché' END,
    CASE WHEN n_comparables >= 10 THEN 'Nombreuses transactions comparables (données fiables)' END,
    CASE WHEN surface_m2 > 50 THEN 'Belle surface de ' || surface_m2::VARCHAR || 'm²' END,
    CASE WHEN n_visits > 0 THEN n_visits::VARCHAR || ' date(s) de visite programmée(s)' END,
    CASE WHEN report_url <> '' THEN 'Procès-verbal disponible' END,
    CASE WHEN own < market_price_m2 * 0.7 THEN 'Prix/m² très attractif (' || {_ZERO.format('own')} || '€ vs ' || {_ZERO.format('market_price_m2')} || '€ marché)' END) AS strengths,
  concat_ws(' | ',
    CASE WHEN n_comparables < 3 THEN 'Peu de données comparables (estimation moins fiable)' END,
    CASE WHEN coalesce(surface_m2, 0) = 0 THEN 'Surface non renseignée' END,
    CASE WHEN n_visits = 0 THEN 'Aucune date de visite connue' END,
    CASE WHEN contains(lower(description), 'occupé') THEN 'Bien potentiellement occupé' END,
    CASE WHEN contains(lower(description), 'travaux') OR contains(lower(description), 'rénovation') THEN 'Travaux probablement nécessaires' END,
    CASE WHEN discount_pct <> 0 AND discount_pct < 10 THEN 'Faible décote par rapport au marché' END,
    CASE WHEN discount_pct < 0 THEN 'Prix supérieur au marché!' END) AS risks,
  concat_ws(' | ',
    CASE WHEN sale_date > {TODAY} THEN 'Vente dans ' || (sale_date - {TODAY})::VARCHAR || ' jours' WHEN sale_date = {TODAY} THEN 'Vente aujourd''hui!' ELSE 'Vente passée' END,
    CASE WHEN market_price_m2 <> 0 THEN 'Prix moyen du secteur: ' || {_ZERO.format('market_price_m2')} || '€/m²' END,
    CASE WHEN court <> '' THEN 'Tribunal: ' || court END) AS notes
FROM judged WHERE {DUE}""")
def strengths_risks_notes(spark, sf_dir):
    a = appraisal(spark, sf_dir)
    return a.select("listing_key", *[F.array_join(c, " | ").alias(c) for c in ("strengths", "risks", "notes")])


@query("report_struct", APPRAISED_SQL + f"""
SELECT listing_key, {TODAY} AS report_date, n_comparables, market_price_m2, market_value, discount_pct,
  opportunity_score AS score, {sql_case('badge_key', {k: v[0] for k, v in K.BADGES.items()}, 'NULL')} AS recommendation
FROM judged WHERE {DUE}""")
def report_struct(spark, sf_dir):
    """The per-listing report, its scalar fields unpacked."""
    r = appraisal(spark, sf_dir).select(S.report_struct(AS_OF).alias("report")).select("report.*")
    return r.drop("strengths", "risks")


@query("bands_and_badges", DUE_VALUED + f"""
SELECT listing_key,
  CASE WHEN g > 100000 THEN 'exceptional' WHEN g > 50000 THEN 'opportunity' WHEN g > 20000 THEN 'interesting' ELSE '' END AS gain_band,
  CASE WHEN coalesce(discount_pct, 0) >= 30 THEN 'green' WHEN coalesce(discount_pct, 0) >= 20 THEN 'orange' ELSE 'blue' END AS discount_colour,
  CASE WHEN coalesce(opportunity_score, 0) >= 70 THEN 'green' WHEN coalesce(opportunity_score, 0) >= 50 THEN 'orange' ELSE 'gray' END AS score_colour
FROM (SELECT *, CASE WHEN market_value <> 0 AND start_price <> 0 THEN market_value - start_price ELSE 0 END AS g FROM valued) WHERE {DUE}""")
def bands_and_badges(spark, sf_dir):
    v = valued(spark, sf_dir).withColumn("gain", R.gain())
    return v.select("listing_key", S.gain_band().alias("gain_band"), S.discount_colour().alias("discount_colour"),
                    S.score_colour().alias("score_colour"))
