"""Neighbourhood, department, adjudication, city and dashboard statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from gavelframe.functions.values import half_even
from gavelframe.operators import ranking as R
from gavelframe.operators import sets as U
from gavelframe.operators import stats as ST
from gavelframe.sources import testbed as T
from gavelframe.suite.analysis import AS_OF, DUE, DUE_VALUED, TODAY, valued
from gavelframe.suite.filters import _ADJ
from gavelframe.suite.registry import query

YEARS = [1996, 1997, 1998]
CODES = ["94130", "75003", "92110", "93150"]


def _r(x, digits=0):
    return f"round_even({x}, 0)" if not digits else f"round_even(({x}) * {10 ** digits}, 0) / {10.0 ** digits}"


def _area_sql(keys: str, where: str = "TRUE", source: str = "transactions") -> str:
    return f"""
SELECT {keys}, coalesce(min(nullif(commune, '')), 'CP ' || postal_code) AS city, count(*) AS n_transactions,
  {_r('median(price_m2)')} AS median_price_m2, {_r('avg(price_m2)')} AS mean_price_m2,
  {_r('min(price_m2)')} AS min_price_m2, {_r('max(price_m2)')} AS max_price_m2,
  coalesce({_r('avg(nullif(surface_m2, 0))', 1)}, 0) AS mean_surface_m2,
  coalesce({_r('avg(nullif(price, 0))')}, 0) AS mean_price
FROM {source} WHERE price_m2 BETWEEN 500 AND 15000 AND postal_code <> '' AND {where}
GROUP BY {keys} HAVING count(*) >= 3"""


@query("price_m2_stats", T.cte("transactions") + f"""
SELECT postal_code, count(*) AS n_transactions, {_r('avg(price_m2)', 2)} AS mean_price_m2, {_r('median(price_m2)', 2)} AS median_price_m2,
  {_r('min(price_m2)', 2)} AS min_price_m2, {_r('max(price_m2)', 2)} AS max_price_m2
FROM transactions WHERE contains(lower(local_type), 'appartement') AND price_m2 > 0
  AND (tx_date IS NULL OR tx_date >= {TODAY} - 720) GROUP BY postal_code""", headline=True)
def price_m2_stats(spark, sf_dir):
    return ST.price_m2_stats(T.transactions(spark, sf_dir), AS_OF)


@query("price_m2_stats_asked", T.cte("transactions") + f"""
SELECT c AS postal_code, count(price_m2) AS n_transactions, {_r('avg(price_m2)', 2)} AS mean_price_m2, {_r('median(price_m2)', 2)} AS median_price_m2,
  {_r('min(price_m2)', 2)} AS min_price_m2, {_r('max(price_m2)', 2)} AS max_price_m2
FROM (VALUES ('94130'), ('75003'), ('99999')) v(c) LEFT JOIN
  (SELECT * FROM transactions WHERE contains(lower(local_type), 'maison') AND price_m2 > 0
    AND (tx_date IS NULL OR tx_date >= {TODAY} - 360)) t ON t.postal_code = c GROUP BY c""")
def price_m2_stats_asked(spark, sf_dir):
    return ST.price_m2_stats(T.transactions(spark, sf_dir), AS_OF, local_type="Maison", months=12,
                             postal_codes=["94130", "75003", "99999"])


@query("neighbourhood_stats", T.cte("transactions") + _area_sql("postal_code"), headline=True)
def neighbourhood_stats(spark, sf_dir):
    return ST.neighbourhood_stats(T.transactions(spark, sf_dir))


@query("neighbourhood_stats_filtered", T.cte("transactions") + _area_sql(
    "postal_code", "left(postal_code, 2) = '93' AND local_type = 'Maison' AND (tx_date IS NULL OR year(tx_date) = 1997)"))
def neighbourhood_stats_filtered(spark, sf_dir):
    return ST.neighbourhood_stats(T.transactions(spark, sf_dir), department="93", year=1997, local_type="Maison")


@query("price_evolution", T.cte("transactions") + """, dated AS (
  SELECT t.* EXCLUDE (tx_date), y AS year FROM transactions t, (VALUES (1996), (1997), (1998)) v(y)
  WHERE tx_date IS NULL OR year(tx_date) = y)""" + _area_sql("postal_code, year", source="dated"))
def price_evolution(spark, sf_dir):
    return ST.price_evolution(T.transactions(spark, sf_dir), YEARS)


@query("compare_neighbourhoods", T.cte("transactions") + f""", areas AS ({_area_sql('postal_code')})
SELECT areas.*, position FROM areas JOIN (VALUES ('94130', 0), ('75003', 1), ('92110', 2), ('93150', 3)) v(c, position) ON c = postal_code""")
def compare_neighbourhoods(spark, sf_dir):
    return ST.compare_neighbourhoods(T.transactions(spark, sf_dir), CODES)


@query("filter_by_codes", T.cte("adjudications") + """
SELECT postal_code, count(*) AS n, position FROM adjudications
JOIN (VALUES ('94130', 0), ('75003', 1), ('92110', 2), ('93150', 3)) v(c, position) ON c = postal_code GROUP BY ALL""")
def filter_by_codes(spark, sf_dir):
    counts = T.domain(spark, sf_dir, "adjudications").groupBy("postal_code").agg(F.count(F.lit(1)).alias("n"))
    return ST.filter_by_codes(counts, CODES)


@query("department_summary", T.cte("transactions") + f""", typed AS (
  SELECT *, 'Tous' AS type_group FROM transactions UNION ALL BY NAME
  SELECT *, local_type AS type_group FROM transactions WHERE local_type IN ('Appartement', 'Maison')),
areas AS ({_area_sql('postal_code, type_group', source='typed')})
SELECT left(postal_code, 2) AS department, type_group, count(*) AS n_areas, sum(n_transactions)::BIGINT AS n_transactions,
  {_r('sum(median_price_m2 * n_transactions) / sum(n_transactions)')} AS overall_median_price_m2,
  max_by(postal_code, {{'m': median_price_m2, 'p': postal_code}}) AS dearest_postal,
  min_by(postal_code, {{'m': median_price_m2, 'p': postal_code}}) AS cheapest_postal
FROM areas GROUP BY 1, 2""", headline=True)
def department_summary(spark, sf_dir):
    return ST.department_summary(T.transactions(spark, sf_dir))


@query("top_neighbourhoods", T.cte("transactions") + f""", areas AS ({_area_sql('postal_code')})
SELECT * FROM areas ORDER BY mean_price_m2 ASC, postal_code LIMIT 20""")
def top_neighbourhoods(spark, sf_dir):
    stats = ST.neighbourhood_stats(T.transactions(spark, sf_dir))
    return R.top_neighbourhoods(stats, sort_by="mean_price_m2", ascending=True)


@query("store_stats", T.cte("listings", "agents") + f"""
SELECT 'total' AS metric, NULL AS label, count(*) AS n FROM listings
UNION ALL SELECT 'upcoming', NULL, count(*) FROM listings WHERE sale_date >= {TODAY}
UNION ALL SELECT 'by_status', status, count(*) FROM listings GROUP BY status
UNION ALL SELECT 'by_source', source, count(*) FROM listings GROUP BY source
UNION ALL SELECT 'agents', NULL, count(*) FROM agents""")
def store_stats(spark, sf_dir):
    return ST.store_stats(T.listings(spark, sf_dir), T.domain(spark, sf_dir, "agents"), AS_OF)


def _adjudications(spark, sf_dir):
    return ST.with_own_price_m2(T.domain(spark, sf_dir, "adjudications"))


@query("adjudication_stats", _ADJ + f"""
SELECT postal_code, min(city) AS city, count(*) AS n_sales, {_r('avg(hammer_price)', 2)} AS mean_price,
  {_r('avg(price_m2)', 2)} AS mean_price_m2, min(price_m2) AS min_price_m2, max(price_m2) AS max_price_m2,
  {_r('avg(surface_m2)', 2)} AS mean_surface_m2, min(sale_date) AS first_sale, max(sale_date) AS last_sale
FROM adj WHERE postal_code LIKE '92%' OR postal_code LIKE '94%' GROUP BY postal_code""", headline=True)
def adjudication_stats(spark, sf_dir):
    s = ST.adjudication_stats(_adjudications(spark, sf_dir), ["92", "94"])
    return s.withColumns({c: half_even(c, 2) for c in ("mean_price", "mean_price_m2", "mean_surface_m2")})


@query("adjudication_count", T.cte("adjudications") + "SELECT count(*) AS n FROM adjudications")
def adjudication_count(spark, sf_dir):
    return ST.adjudication_count(T.domain(spark, sf_dir, "adjudications"))


@query("city_summary", DUE_VALUED + f"""
SELECT city, count(*) AS n_listings, {_r('avg(nullif(start_price, 0))', 2)} AS mean_price, min(nullif(start_price, 0)) AS min_price,
  max(nullif(start_price, 0)) AS max_price, {_r('avg(nullif(opportunity_score, 0))', 2)} AS mean_score,
  count(*) FILTER (WHERE opportunity_score >= 50) AS n_opportunities
FROM valued WHERE {DUE} AND city <> '' GROUP BY city""")
def city_summary(spark, sf_dir):
    s = ST.city_summary(valued(spark, sf_dir))
    return s.withColumns({c: half_even(c, 2) for c in ("mean_price", "mean_score")})


@query("listing_kpis", DUE_VALUED + f"""
SELECT count(*) AS total, count(*) FILTER (WHERE sale_date >= {TODAY}) AS upcoming,
  count(*) FILTER (WHERE sale_date >= {TODAY} AND sale_date <= {TODAY} + 30) AS upcoming_30d,
  count(*) FILTER (WHERE {DUE} AND coalesce(discount_pct, 0) >= 20) AS opportunities
FROM valued WHERE {DUE}""")
def listing_kpis(spark, sf_dir):
    return ST.listing_kpis(valued(spark, sf_dir), AS_OF)


BOARD_SQL = DUE_VALUED + f""", board AS (
  SELECT *, least(CASE WHEN visit_one::DATE >= {TODAY} THEN visit_one END, CASE WHEN visit_two::DATE >= {TODAY} THEN visit_two END) AS next_visit,
    CASE WHEN market_value <> 0 AND start_price <> 0 THEN market_value - start_price ELSE 0 END AS gain,
    coalesce(discount_pct, 0) AS discount_shown
  FROM valued WHERE {DUE})"""


@query("board_kpis", BOARD_SQL + f"""
SELECT count(next_visit) AS with_visit, count(*) FILTER (WHERE gain > 50000) AS gain_over_50k,
  count(*) FILTER (WHERE discount_shown >= 30) AS discount_over_30, {_r('sum(greatest(gain, 0))')} AS total_gain FROM board""")
def board_kpis(spark, sf_dir):
    k = ST.board_kpis(R.with_board_columns(valued(spark, sf_dir), AS_OF))
    return k.withColumn("total_gain", half_even("total_gain"))


@query("opportunity_board", BOARD_SQL + f"""
SELECT listing_key, strftime(next_visit, '%Y-%m-%d %H:%M') AS next_visit, gain, discount_shown, next_visit::DATE - {TODAY} AS days_to_visit,
  CASE WHEN next_visit::DATE - {TODAY} <= 7 THEN 'red' WHEN next_visit::DATE - {TODAY} <= 14 THEN 'orange' WHEN next_visit IS NOT NULL THEN 'green' END AS visit_colour
FROM board""")
def opportunity_board(spark, sf_dir):
    from gavelframe.functions.scoring import visit_colour
    b = R.opportunity_board(valued(spark, sf_dir), AS_OF)
    return b.select("listing_key", F.date_format("next_visit", "yyyy-MM-dd HH:mm").alias("next_visit"), "gain",
                    "discount_shown", "days_to_visit", visit_colour("days_to_visit").alias("visit_colour"))


@query("visit_rows", T.cte("listings") + f"""
SELECT listing_key, strftime(visit_at, '%Y-%m-%d %H:%M') AS visit_at FROM (
  SELECT listing_key, sale_date, unnest([visit_one, visit_two]) AS visit_at FROM listings)
WHERE sale_date >= {TODAY} AND sale_date <= {TODAY} + 90 AND visit_at::DATE >= {TODAY}""")
def visit_rows(spark, sf_dir):
    rows = R.visit_rows(T.listings(spark, sf_dir), AS_OF)
    return rows.select("listing_key", F.date_format("visit_at", "yyyy-MM-dd HH:mm").alias("visit_at"))


V_TODAY = f"DATE '{T.VISIT_AS_OF}'"


@query("visit_kpis", T.cte("visits") + f"""
SELECT count(*) FILTER (WHERE visit_at::DATE BETWEEN date_trunc('week', {V_TODAY})::DATE AND date_trunc('week', {V_TODAY})::DATE + 6) AS this_week,
  count(*) FILTER (WHERE visit_at::DATE = {V_TODAY}) AS today,
  count(*) FILTER (WHERE visit_at::DATE <= {V_TODAY} + 7) AS next_7_days, count(*) AS all_ahead
FROM visits WHERE visit_at::DATE >= {V_TODAY}""")
def visit_kpis(spark, sf_dir):
    return ST.visit_kpis(T.domain(spark, sf_dir, "visits"), T.VISIT_AS_OF)


@query("visit_calendar", T.cte("visits") + f"""
SELECT visit_id, listing_key, visit_at::DATE AS visit_day, visit_at::DATE - {V_TODAY} AS days_to_visit,
  CASE visit_at::DATE - {V_TODAY} WHEN 0 THEN 'today' WHEN 1 THEN 'tomorrow' ELSE CASE WHEN visit_at::DATE - {V_TODAY} <= 3 THEN 'soon' ELSE 'later' END END AS urgency
FROM visits WHERE visit_at::DATE >= {V_TODAY} AND visit_at::DATE BETWEEN date_trunc('week', {V_TODAY})::DATE AND date_trunc('week', {V_TODAY})::DATE + 6""")
def visit_calendar(spark, sf_dir):
    ahead = T.domain(spark, sf_dir, "visits").filter(F.col("visit_at").cast("date") >= F.lit(T.VISIT_AS_OF).cast("date"))
    return R.visit_calendar(ahead, T.VISIT_AS_OF).select("visit_id", "listing_key", "visit_day", "days_to_visit", "urgency")


@query("first_visits", T.cte("visits") + f"""
SELECT visit_id, listing_key, strftime(visit_at, '%Y-%m-%d %H:%M:%S') AS visit_at FROM visits WHERE visit_at::DATE >= {V_TODAY} ORDER BY visits.visit_at, visit_id LIMIT 20""")
def first_visits(spark, sf_dir):
    ahead = T.domain(spark, sf_dir, "visits").filter(F.col("visit_at").cast("date") >= F.lit(T.VISIT_AS_OF).cast("date"))
    return ahead.orderBy("visit_at", "visit_id").limit(20).select(
        "visit_id", "listing_key", F.date_format("visit_at", "yyyy-MM-dd HH:mm:ss").alias("visit_at"))


@query("weekly_visits", T.cte("visits") + f"""
SELECT date_trunc('week', visit_at)::DATE AS week, count(*) AS n_visits, {_r('avg(amount)', 2)} AS mean_amount FROM visits GROUP BY 1""", headline=True)
def weekly_visits(spark, sf_dir):
    return ST.weekly_visits(T.domain(spark, sf_dir, "visits")).withColumn("mean_amount", half_even("mean_amount", 2))


@query("newest", T.cte("listings") + f"""
SELECT listing_key, sale_date FROM listings WHERE sale_date >= {TODAY} ORDER BY sale_date DESC, listing_key LIMIT 5""")
def newest(spark, sf_dir):
    return R.newest(T.listings(spark, sf_dir), AS_OF).select("listing_key", "sale_date")


@query("content_dedup", """
SELECT source, lang, md5(text) AS content_hash, min(doc_id) AS doc_id, any_value(strlen(text)) AS size
FROM documents WHERE text IS NOT NULL GROUP BY source, lang, md5(text)""", headline=True)
def content_dedup(spark, sf_dir):
    return ST.distinct_contents(T.read(spark, sf_dir, "documents"), ["source", "lang"], "text", tie="doc_id")


@query("content_totals", """
SELECT count(*) AS total_items, count(DISTINCT source) AS owners, round_even(sum(size) / 1048576.0 * 100, 0) / 100 AS total_size_mb FROM (
  SELECT source, any_value(strlen(text)) AS size FROM documents WHERE text IS NOT NULL GROUP BY source, lang, md5(text))""")
def content_totals(spark, sf_dir):
    kept = ST.distinct_contents(T.read(spark, sf_dir, "documents"), ["source", "lang"], "text", tie="doc_id")
    return ST.content_totals(kept, "source")


@query("union_sources", T.cte("site_one", "site_two", "adjudications") + """
SELECT source, count(*) AS n, count(agent_name) AS with_agent, count(hammer_price) AS with_hammer FROM (
  SELECT source, agent_name, NULL::DOUBLE AS hammer_price FROM site_one UNION ALL SELECT source, agent_name, NULL FROM site_two
  UNION ALL SELECT source, NULL, hammer_price FROM adjudications) GROUP BY source""")
def union_sources(spark, sf_dir):
    u = U.union_sources(*[T.domain(spark, sf_dir, n) for n in ("site_one", "site_two", "adjudications")])
    return u.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count("agent_name").alias("with_agent"),
                                   F.count("hammer_price").alias("with_hammer"))


@query("difference_by_key", T.cte("listings", "agents") + """
SELECT agent_id, name FROM agents WHERE agent_id NOT IN (SELECT agent_id FROM listings WHERE property_type = 'parking')""")
def difference_by_key(spark, sf_dir):
    used = T.listings(spark, sf_dir).filter(F.col("property_type") == "parking")
    return U.difference_by_key(T.domain(spark, sf_dir, "agents"), used, ["agent_id"]).select("agent_id", "name")


