"""Price sources, their combination, reliability, recommendation, and asking-price lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from gavelframe.functions import constants as K
from gavelframe.functions.values import half_even
from gavelframe.functions.keys import estimate_cache_key
from gavelframe.operators import estimates as E
from gavelframe.operators import ranking as R
from gavelframe.plans.detailed import detailed_analysis
from gavelframe.sources import testbed as T
from gavelframe.suite.analysis import AS_OF, DUE, TODAY, comps_sql, due
from gavelframe.suite.registry import query

CODE_MAP = {"75011": "75001", "92110": "92190"}


def code_table(spark):
    return spark.createDataFrame(list(CODE_MAP.items()), "insee string, postal_code string")


def indicators(spark, sf_dir):
    """Yearly commune figures: customers' orders by postal code and year."""
    a = T.domain(spark, sf_dir, "adjudications")
    return a.filter(F.col("sale_date").isNotNull()).groupBy(
        F.col("postal_code").alias("insee"), F.year("sale_date").alias("year")).agg(
        half_even(F.avg("hammer_price") / 50).alias("price_m2"), F.count(F.lit(1)).alias("n_sales"),
        half_even(F.avg("surface_m2")).alias("mean_surface_m2"))


def ads(spark, sf_dir):
    """Online ads: every line as an asking price."""
    t = T.domain(spark, sf_dir, "transactions")
    own = (F.when(F.col("local_type") == "Maison", "maison").when(F.col("local_type") == "Dépendance", "parking")
            .when(F.col("local_type") == "Appartement", "appartement").otherwise("local_commercial"))
    return t.select(F.col("tx_key").alias("item_key"), "postal_code", own.alias("property_type"), "surface_m2",
                    (F.col("price") * 1.1).alias("price"))


_KEY = ("md5(coalesce(postal_code, 'None') || '_' || property_type || '_' || CASE WHEN surface_m2 <> 0 THEN"
        " CAST(CAST(floor(surface_m2 / 20) * 20 AS BIGINT) AS VARCHAR) ELSE 'any' END)")

_SAID = ", ".join(
    f"max(format('{{:,}}', CAST(round_even(price_m2, 0) AS BIGINT)) || ' €/m² (' || n_points || ' données, confiance: ' || CAST(round_even(confidence, 0) AS BIGINT) || '%)')"
    f" FILTER (WHERE source_type = '{s}') AS {s}_said" for s in K.SOURCE_NAMES)

SOURCES_SQL = comps_sql(DUE, tolerance="0.3", k=50, default=60.0, types=K.ESTIMATE_TYPE_MAP).replace(
    T.cte("transactions", "listings"), T.cte("transactions", "listings", "adjudications")) + f""",
subjects AS (SELECT * FROM listings WHERE {DUE}),
indicators AS (
  SELECT postal_code AS insee, year(sale_date) AS year, round_even(avg(hammer_price) / 50, 0) AS price_m2, count(*) AS n_sales,
    round_even(avg(surface_m2), 0) AS mean_surface_m2
  FROM adjudications WHERE sale_date IS NOT NULL GROUP BY 1, 2),
ads AS (
  SELECT tx_key AS item_key, postal_code, CASE local_type WHEN 'Maison' THEN 'maison' WHEN 'Dépendance' THEN 'parking'
    WHEN 'Appartement' THEN 'appartement' ELSE 'local_commercial' END AS property_type, surface_m2, price * 1.1::DOUBLE AS price FROM transactions),
keyed_ads AS (SELECT *, price / surface_m2 AS price_m2, {_KEY} AS cache_key FROM ads WHERE price <> 0 AND surface_m2 > 0 AND price / surface_m2 BETWEEN 500 AND 15000),
ask AS (SELECT cache_key, count(*) AS n_ads, median(price_m2) AS med FROM keyed_ads GROUP BY cache_key HAVING count(*) >= 3),
tx_stats AS (
  SELECT listing_key, count(*) FILTER (WHERE price_m2 BETWEEN 500 AND 15000) AS n_valid,
    median(price_m2) FILTER (WHERE price_m2 BETWEEN 500 AND 15000) AS med, min(tx_date) AS oldest FROM comps GROUP BY 1),
newest AS (SELECT insee, max(year) AS year, max_by(price_m2, year) AS price_m2, max_by(n_sales, year) AS n_sales FROM indicators GROUP BY insee),
places AS (
  SELECT CASE insee {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in CODE_MAP.items())} END AS postal_code, 0 AS o, * FROM newest
  UNION ALL SELECT insee, 1, * FROM newest),
own AS (SELECT * FROM places WHERE postal_code IS NOT NULL QUALIFY row_number() OVER (PARTITION BY postal_code ORDER BY o, insee) = 1),
near AS (SELECT left(insee, 2) AS department, * FROM newest QUALIFY row_number() OVER (PARTITION BY left(insee, 2) ORDER BY insee) = 1),
hits AS (
  SELECT s.listing_key, s.surface_m2, coalesce(own.insee, near.insee) AS insee, coalesce(own.year, near.year) AS year,
    CASE WHEN own.insee IS NOT NULL THEN own.price_m2 ELSE near.price_m2 END AS price_m2,
    CASE WHEN own.insee IS NOT NULL THEN own.n_sales ELSE near.n_sales END AS n_sales,
    CASE WHEN own.insee IS NOT NULL THEN 'commune' WHEN near.insee IS NOT NULL THEN 'department' END AS geo_match
  FROM subjects s LEFT JOIN own ON own.postal_code = s.postal_code LEFT JOIN near ON near.department = left(s.postal_code, 2)),
est0 AS (
  SELECT s.listing_key, 'dvf' AS source_type, CASE WHEN n_valid >= 3 THEN round_even(med, 0) END AS price_m2,
    CASE WHEN n_valid >= 3 AND surface_m2 <> 0 THEN round_even(med * surface_m2, 0) END AS total, n_valid AS n_points,
    CASE WHEN n_valid >= 3 THEN coalesce({TODAY} - oldest, 730) ELSE 0 END AS age_days, CASE WHEN n_valid >= 3 THEN 'commune' ELSE '' END AS geo_match,
    'Médiane de ' || n_valid || ' transactions sur 24 mois' AS notes
  FROM tx_stats JOIN subjects s USING (listing_key)
  UNION ALL
  SELECT listing_key, 'commune', round_even(price_m2, 0), CASE WHEN surface_m2 <> 0 THEN round_even(price_m2 * surface_m2, 0) END, n_sales,
    {TODAY} - make_date(year, 6, 30), geo_match, 'Moyenne commune ' || year || ' (' || n_sales || ' mutations)' FROM hits WHERE price_m2 <> 0
  UNION ALL
  SELECT listing_key, 'listings', round_even(med * 0.9::DOUBLE, 0), NULL, n_ads, 1, 'commune', 'Prix demandés -10% (' || n_ads || ' annonces)' FROM (SELECT *, {_KEY} AS cache_key FROM subjects) JOIN ask USING (cache_key)),
est AS (
  SELECT *, (CASE WHEN n_points >= 20 THEN 40 WHEN n_points >= 10 THEN 30 WHEN n_points >= 5 THEN 20 WHEN n_points >= 3 THEN 10 ELSE 0 END
    + CASE WHEN age_days <= 180 THEN 30 WHEN age_days <= 365 THEN 20 WHEN age_days <= 730 THEN 10 ELSE 0 END
    + CASE geo_match WHEN 'exact' THEN 30 WHEN 'commune' THEN 20 WHEN 'department' THEN 10 ELSE 0 END)::DOUBLE AS confidence FROM est0),
combined0 AS (
  SELECT listing_key, count(*) AS n_sources, CASE WHEN sum(confidence) > 0 THEN sum(price_m2 * confidence) / sum(confidence) ELSE avg(price_m2) END AS combined_price_m2,
    min(price_m2) AS min_price_m2, max(price_m2) AS max_price_m2, avg(confidence) AS ac,
    max(price_m2) FILTER (WHERE source_type = 'dvf') AS dvf_price_m2, max(price_m2) FILTER (WHERE source_type = 'commune') AS commune_price_m2,
    max(price_m2) FILTER (WHERE source_type = 'listings') AS listings_price_m2,
    {_SAID},
    CASE WHEN count(*) < 2 THEN 50 WHEN avg(price_m2) > 0 THEN greatest(0, 100 - stddev_pop(price_m2) / avg(price_m2) * 200) ELSE 0 END AS agreement
  FROM est WHERE price_m2 <> 0 GROUP BY listing_key),
combined AS (
  SELECT *, least(100, ac * 0.5 + least(20, n_sources * 10) + agreement * 0.3) AS reliability_score FROM combined0)"""


def estimates(spark, sf_dir):
    sources = [E.from_transactions(T.transactions(spark, sf_dir), AS_OF),
               E.from_communes(indicators(spark, sf_dir), AS_OF, code_table(spark)), E.from_ads(ads(spark, sf_dir))]
    return E.source_estimates(due(spark, sf_dir), sources)


@query("source_estimates", SOURCES_SQL + """
SELECT listing_key, source_type, price_m2, total, n_points, age_days, geo_match, confidence FROM est""", headline=True)
def source_estimates(spark, sf_dir):
    return estimates(spark, sf_dir).drop("notes")


@query("commune_lookup", SOURCES_SQL + """
SELECT listing_key, insee, year, price_m2 AS commune_price_m2, n_sales, geo_match FROM hits""")
def commune_lookup(spark, sf_dir):
    hits = E.commune_lookup(due(spark, sf_dir), indicators(spark, sf_dir), code_table(spark))
    return hits.select("listing_key", "insee", "year", "commune_price_m2", "n_sales", "geo_match")


@query("combine_estimates", SOURCES_SQL + """
SELECT listing_key, n_sources, round_even(combined_price_m2 * 100, 0) / 100 AS combined_price_m2, min_price_m2, max_price_m2, dvf_price_m2, commune_price_m2, listings_price_m2
FROM combined""", headline=True)
def combine_estimates(spark, sf_dir):
    c = E.combine_estimates(estimates(spark, sf_dir)).withColumn("combined_price_m2", half_even("combined_price_m2", 2))
    return c.drop("agreement", "reliability_score", "reliability", "source_notes")


@query("reliability", SOURCES_SQL + """
SELECT listing_key, round_even(agreement * 10000, 0) / 10000 AS agreement, round_even(reliability_score * 10000, 0) / 10000 AS reliability_score,
  CASE WHEN reliability_score >= 70 AND n_sources >= 2 THEN 'high' WHEN reliability_score >= 40 THEN 'medium' WHEN reliability_score > 0 THEN 'low' ELSE 'insufficient' END AS reliability
FROM combined""")
def reliability(spark, sf_dir):
    c = E.combine_estimates(estimates(spark, sf_dir))
    return c.select("listing_key", half_even("agreement", 4).alias("agreement"),
                    half_even("reliability_score", 4).alias("reliability_score"), "reliability")


@query("price_recommendation", SOURCES_SQL + """
SELECT s.listing_key, round_even(combined_price_m2, 0) AS recommended_price_m2,
  CASE WHEN surface_m2 <> 0 THEN round_even(round_even(combined_price_m2, 0) * surface_m2, 0) END AS recommended_total,
  CASE WHEN surface_m2 <> 0 AND start_price <> 0 THEN
    (round_even(combined_price_m2, 0) * surface_m2 - start_price) / (round_even(combined_price_m2, 0) * surface_m2) * 100 END AS discount_vs_market,
  CASE WHEN n_sources >= 2 AND agreement >= 80 THEN 'Sources en accord (' || CAST(round_even(agreement, 0) AS BIGINT) || '%)'
    WHEN n_sources >= 2 AND agreement >= 50 THEN 'Accord modéré entre sources (' || CAST(round_even(agreement, 0) AS BIGINT) || '%)' END AS note,
  concat_ws(' | ', CASE WHEN n_sources IS NULL THEN 'Aucune source de données disponible' END,
    CASE WHEN n_sources >= 2 AND agreement < 50 THEN 'Désaccord entre sources (' || CAST(round_even(agreement, 0) AS BIGINT) || '%) - plage: '
      || format('{:,}', CAST(round_even(min_price_m2, 0) AS BIGINT)) || ' - ' || format('{:,}', CAST(round_even(max_price_m2, 0) AS BIGINT)) || ' €/m²' END,
    CASE WHEN reliability_score > 0 AND reliability_score < 40 THEN 'Fiabilité faible - peu de données ou sources en désaccord' END,
    CASE WHEN coalesce(reliability_score, 0) <= 0 THEN 'Données insuffisantes pour une estimation fiable' END) AS warnings,
  """ + " || ' | ' || ".join(f"'{name}: ' || coalesce({s}_said, 'Données insuffisantes')" for s, name in K.SOURCE_NAMES.items()) + """
    || coalesce(CASE WHEN n_sources >= 2 AND agreement >= 80 THEN ' | Sources en accord (' || CAST(round_even(agreement, 0) AS BIGINT) || '%)'
    WHEN n_sources >= 2 AND agreement >= 50 THEN ' | Accord modéré entre sources (' || CAST(round_even(agreement, 0) AS BIGINT) || '%)' END, '') AS notes
FROM subjects s LEFT JOIN combined USING (listing_key)""", headline=True)
def price_recommendation(spark, sf_dir):
    r = detailed_analysis(due(spark, sf_dir), T.transactions(spark, sf_dir), indicators(spark, sf_dir), ads(spark, sf_dir), AS_OF, code_table(spark))
    return r.select("listing_key", "recommended_price_m2", "recommended_total", "discount_vs_market", "note",
                    F.array_join("warnings", " | ").alias("warnings"), F.array_join("notes", " | ").alias("notes"))


_NAMES = " ".join(f"WHEN '{s}' THEN '{name}'" for s, name in K.SOURCE_NAMES.items())


@query("source_details", SOURCES_SQL + f"""
SELECT listing_key, source_type, CASE source_type {_NAMES} END AS name, price_m2, confidence, n_points, age_days, geo_match, notes FROM est WHERE price_m2 <> 0""")
def source_details(spark, sf_dir):
    """The nested detail of every source, one row per entry of the map."""
    d = E.source_details(estimates(spark, sf_dir)).select("listing_key", F.explode("sources").alias("source_type", "d"))
    return d.select("listing_key", "source_type", "d.*")


@query("closest_to_median", SOURCES_SQL + """
SELECT item_key, cache_key, round_even(price_m2, 0) AS shown_price_m2, rank FROM (
  SELECT a.*, row_number() OVER (PARTITION BY cache_key ORDER BY abs(round_even(price_m2, 0) - med), item_key) AS rank
  FROM keyed_ads a JOIN ask USING (cache_key)) WHERE rank <= 15""", headline=True)
def closest_to_median(spark, sf_dir):
    a = ads(spark, sf_dir)
    priced = a.filter((F.col("price") != 0) & (F.col("surface_m2") > 0)).withColumns({
        "price_m2": F.col("price") / F.col("surface_m2"), "cache_key": estimate_cache_key(),
    }).filter(F.col("price_m2").between(K.MIN_PRICE_M2, K.MAX_PRICE_M2))
    near = R.closest_to_median(priced, E.ask_medians(a), ["cache_key"])
    return near.select("item_key", "cache_key", half_even("price_m2").alias("shown_price_m2"), "rank")


@query("latest_year", SOURCES_SQL + """
SELECT insee, max(year) AS year, max_by(price_m2, year) AS price_m2, array_to_string(list_slice(list_sort(list(year), 'DESC'), 1, 5), ',') AS recent_years
FROM indicators GROUP BY insee""")
def latest_year(spark, sf_dir):
    newest = R.latest_year(indicators(spark, sf_dir))
    years = F.array_join(F.transform("recent", lambda r: r["year"].cast("string")), ",")
    return newest.select("insee", "year", "price_m2", years.alias("recent_years"))


@query("first_k_per_group", T.cte("notice_texts") + """
SELECT page_id, pos - 1 AS pos, word AS item FROM (
  SELECT page_id, unnest(w[1:15]) AS word, generate_subscripts(w[1:15], 1) AS pos FROM (SELECT page_id, string_split(body, ' ') AS w FROM notice_texts))""")
def first_k_per_group(spark, sf_dir):
    """First 15 items of a list in document order."""
    rows = T.domain(spark, sf_dir, "notice_texts").select("page_id", F.split("body", " ").alias("items"))
    return R.first_k_of_array(rows, "items", 15)


@query("first_distinct", """
WITH words AS (SELECT doc_id, unnest(string_split(text, ' ')) AS w, generate_subscripts(string_split(text, ' '), 1) AS p FROM documents),
firsts AS (SELECT doc_id, w, min(p) AS p FROM words WHERE w <> '' GROUP BY doc_id, w),
ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY p) AS rn FROM firsts)
SELECT d.doc_id, coalesce(string_agg(w, ' ' ORDER BY p), '') AS words FROM documents d LEFT JOIN ranked r ON r.doc_id = d.doc_id AND rn <= 20 GROUP BY d.doc_id""")
def first_distinct(spark, sf_dir):
    """Order-preserving distinct of a list, first 20 kept."""
    d = T.read(spark, sf_dir, "documents")
    return d.select("doc_id", F.array_join(R.first_distinct(F.split("text", " "), 20), " ").alias("words"))
