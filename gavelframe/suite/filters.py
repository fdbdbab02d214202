"""Filters, lookups, paging and column projections."""

from __future__ import annotations

from pyspark.sql import functions as F

from gavelframe.functions import constants as K
from gavelframe.operators import filters as FL
from gavelframe.operators import stats as ST
from gavelframe.sources import testbed as T
from gavelframe.suite.analysis import AS_OF, DUE, DUE_VALUED, TODAY, valued
from gavelframe.suite.registry import query, sql_values

BRIEF = ["listing_key", "sale_date", "city", "property_type", "surface_m2", "start_price"]
B = ", ".join(BRIEF)


@query("search_listings", T.cte("listings") + f"""
SELECT {B} FROM listings WHERE city ILIKE '%on_1%' AND property_type = 'maison'
  AND start_price >= 5000 AND start_price <= 90000 AND surface_m2 >= 10 AND surface_m2 <= 45""")
def search_listings(spark, sf_dir):
    return FL.search_listings(T.listings(spark, sf_dir), city="on_1", property_type="maison", price_min=5000.0,
                              price_max=90000.0, surface_min=10.0, surface_max=45.0).select(*BRIEF)


@query("list_listings", T.cte("listings") + f"""
SELECT {B}, status FROM listings WHERE status = 'a_venir' ORDER BY sale_date NULLS FIRST, listing_key LIMIT 50 OFFSET 20""")
def list_listings(spark, sf_dir):
    return FL.list_listings(T.listings(spark, sf_dir), "a_venir", limit=50, offset=20).select(*BRIEF, "status")


@query("upcoming", T.cte("listings") + f"""
SELECT {B} FROM listings WHERE sale_date >= {TODAY} AND sale_date <= {TODAY} + 30""")
def upcoming(spark, sf_dir):
    return FL.upcoming(T.listings(spark, sf_dir), AS_OF, 30, ordered=True).select(*BRIEF)


@query("lookup_by_url", T.cte("listings") + f"""
SELECT {B} FROM listings WHERE url = (SELECT min(url) FROM listings)""")
def lookup_by_url(spark, sf_dir):
    rows = T.listings(spark, sf_dir)
    least = rows.agg(F.min("url").alias("url"))
    return rows.join(F.broadcast(least), "url", "left_semi").select(*BRIEF)


@query("agents_by_name", T.cte("agents") + """
SELECT agent_id, name, coalesce(firm, '') AS firm, coalesce(site, '') AS site, phone, email FROM agents""")
def agents_by_name(spark, sf_dir):
    return FL.lookup_agent(T.domain(spark, sf_dir, "agents")).select("agent_id", "name", "firm", "site", "phone", "email")


@query("agent_by_id", T.cte("agents") + """
SELECT agent_id, name, coalesce(firm, '') AS firm FROM agents WHERE agent_id = 7""")
def agent_by_id(spark, sf_dir):
    return FL.lookup_agent(T.domain(spark, sf_dir, "agents"), 7).select("agent_id", "name", "firm")


@query("search_transactions", T.cte("transactions") + """
SELECT tx_key, tx_date, price, surface_m2, local_type FROM transactions
WHERE left(postal_code, 2) = '92' AND commune ILIKE '%on_1%' AND local_type ILIKE '%maison%'
  AND (tx_date IS NULL OR (tx_date >= DATE '1996-01-01' AND tx_date <= DATE '1999-12-31'))
  AND price >= 10000 AND price <= 80000
  AND (surface_m2 IS NULL OR surface_m2 = 0 OR (surface_m2 >= 10 AND surface_m2 <= 40))""", headline=True)
def search_transactions(spark, sf_dir):
    return FL.search_transactions(
        T.transactions(spark, sf_dir), department="92", commune="on_1", local_type="maison", date_min="1996-01-01",
        date_max="1999-12-31", price_min=10000, price_max=80000, surface_min=10, surface_max=40,
    ).select("tx_key", "tx_date", "price", "surface_m2", "local_type")


@query("price_band", T.cte("transactions") + """
SELECT local_type, count(*) AS n FROM transactions WHERE price_m2 BETWEEN 500 AND 15000 GROUP BY local_type""")
def price_band(spark, sf_dir):
    return T.transactions(spark, sf_dir).filter(FL.in_price_band()).groupBy("local_type").agg(F.count(F.lit(1)).alias("n"))


_ADJ = T.cte("adjudications") + ", adj AS (SELECT *, CASE WHEN surface_m2 > 0 THEN round_even(hammer_price / surface_m2, 0) END AS price_m2 FROM adjudications)"


@query("list_adjudications", _ADJ + """
SELECT source, sale_date, postal_code, hammer_price, price_m2 FROM adj
WHERE postal_code LIKE '93%' AND property_type = 'Maison'
ORDER BY sale_date DESC NULLS LAST, source, postal_code, hammer_price LIMIT 100""")
def list_adjudications(spark, sf_dir):
    rows = ST.with_own_price_m2(T.domain(spark, sf_dir, "adjudications"))
    return FL.list_adjudications(rows, "93", "Maison", 100).select("source", "sale_date", "postal_code", "hammer_price", "price_m2")


@query("in_target_area", T.cte("listings") + f"""
SELECT postal_code, count(*) AS n FROM listings
WHERE postal_code IN (SELECT p FROM ({sql_values([(p,) for p in K.MONITORED_POSTALS])}) v(p)) GROUP BY postal_code""")
def in_target_area(spark, sf_dir):
    return FL.in_target_area(T.listings(spark, sf_dir)).groupBy("postal_code").agg(F.count(F.lit(1)).alias("n"))


@query("url_in_departments", T.cte("notice_texts") + """
SELECT page_id, url FROM notice_texts WHERE regexp_matches(url, '-(75|92|93|94)/')""")
def url_in_departments(spark, sf_dir):
    return T.domain(spark, sf_dir, "notice_texts").filter(FL.url_in_departments()).select("page_id", "url")


@query("only_opportunities", DUE_VALUED + f"""
SELECT listing_key, discount_pct FROM valued WHERE {DUE} AND coalesce(discount_pct, 0) >= 20""")
def only_opportunities(spark, sf_dir):
    return FL.only_opportunities(valued(spark, sf_dir)).select("listing_key", "discount_pct")


def _any(words, text="t"):
    return "(" + " OR ".join(f"contains({text}, '{w}')" for w in words) + ")"


# judicial and notarial wording appended to the documents' own text by their number
_MARKS = ("CASE doc_id % 5 WHEN 0 THEN ' Vente sur SAISIE au tribunal judiciaire.' WHEN 1 THEN ' Étude notariale, vente volontaire.'"
          " WHEN 2 THEN ' Vente judiciaire devant notaire.' WHEN 3 THEN ' Me Notaires associés.' ELSE '' END")


@query("is_judicial", f"""
SELECT doc_id, {_any(K.JUDICIAL_WORDS)} OR NOT ({_any(K.NOTARIAL_WORDS)} OR contains(t, 'notaire')) AS judicial
FROM (SELECT doc_id, lower(text || {_MARKS}) AS t FROM documents)""")
def is_judicial(spark, sf_dir):
    d = T.read(spark, sf_dir, "documents").withColumn("notice", F.concat(F.col("text"), F.expr(_MARKS)))
    return d.select("doc_id", FL.is_judicial("notice").alias("judicial"))


@query("low_confidence", """
SELECT event_id, value / 100 AS confidence FROM events WHERE value / 100 < 0.7""")
def low_confidence(spark, sf_dir):
    e = T.read(spark, sf_dir, "events").withColumn("confidence", F.col("value") / 100)
    return e.filter(FL.is_low_confidence()).select("event_id", "confidence")


@query("needs_ocr", r"""
SELECT doc_id, length(regexp_replace(text, '^\s+|\s+$', '', 'g')) < 100 AS ocr,
  length(regexp_replace(text, '^\s+|\s+$', '', 'g')) < 200 AS ocr_hybrid FROM documents""")
def needs_ocr(spark, sf_dir):
    d = T.read(spark, sf_dir, "documents")
    return d.select("doc_id", FL.needs_ocr().alias("ocr"), FL.needs_ocr(min_chars=200).alias("ocr_hybrid"))


@query("listing_table", DUE_VALUED + f"""
SELECT listing_key, sale_date, city, property_type, surface_m2, start_price,
  CASE WHEN start_price <> 0 AND surface_m2 > 0 THEN start_price / surface_m2 END AS own_price_m2,
  market_price_m2, discount_pct, opportunity_score, agent_name, report_url, url FROM valued WHERE {DUE}""")
def listing_table(spark, sf_dir):
    return FL.listing_table(valued(spark, sf_dir))


