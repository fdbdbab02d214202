"""Agents' notices, documents, catalog and sites matched to listings."""

from __future__ import annotations

from pyspark.sql import functions as F

from gavelframe.functions import constants as K
from gavelframe.operators import agents as A
from gavelframe.sources import testbed as T
from gavelframe.suite.registry import query

# notices are the second feed, stored listings the first
MATCH_SQL = T.cte("site_one", "site_two") + """,
ok AS (
  SELECT b.seq AS notice_id, a.seq AS listing_key,
    row_number() OVER (PARTITION BY b.seq ORDER BY a.seq) AS rn
  FROM site_two b JOIN site_one a ON (a.sale_date IS NULL OR b.sale_date IS NULL OR a.sale_date = b.sale_date)
   AND (nullif(a.postal_code, '') = nullif(b.postal_code, '') OR (a.city <> '' AND b.city <> '' AND (contains(lower(a.city), lower(b.city)) OR contains(lower(b.city), lower(a.city)))))
   AND (coalesce(a.start_price, 0) = 0 OR coalesce(b.start_price, 0) = 0 OR abs(a.start_price - b.start_price) / ((a.start_price + b.start_price) / 2) <= 0.2)),
matches AS (SELECT notice_id, listing_key FROM ok WHERE rn = 1)"""


def parts(spark, sf_dir):
    stored = T.domain(spark, sf_dir, "site_one").withColumnRenamed("seq", "listing_key").withColumn(
        "documents", F.when(F.col("listing_key") % 2 == 0, F.array(F.lit("doc-0"))))
    own = T.domain(spark, sf_dir, "site_two").withColumnRenamed("seq", "notice_id").withColumn(
        "documents", F.array(F.concat(F.lit("doc-"), (F.col("notice_id") % 3).cast("string"))))
    return own, stored


@query("match_agent_listings", MATCH_SQL + "SELECT notice_id, listing_key FROM matches", headline=True)
def match_agent_listings(spark, sf_dir):
    return A.match_agent_listings(*parts(spark, sf_dir))


@query("enrich_from_agent_listings", MATCH_SQL + """
SELECT a.seq AS listing_key, coalesce(nullif(a.report_url, ''), min_by(b.report_url, b.seq) FILTER (WHERE b.report_url <> '')) AS report_url,
  coalesce(nullif(a.report_url, ''), '') = '' AND count(b.report_url) > 0 AS report_added,
  (a.seq % 2 = 0)::BIGINT + count(DISTINCT CASE WHEN a.seq % 2 <> 0 OR b.seq % 3 <> 0 THEN b.seq % 3 END) AS n_documents
FROM site_one a LEFT JOIN matches ON a.seq = listing_key LEFT JOIN site_two b ON b.seq = notice_id GROUP BY a.seq, a.report_url""")
def enrich_from_agent_listings(spark, sf_dir):
    own, stored = parts(spark, sf_dir)
    e = A.enrich_from_agent_listings(stored, own, A.match_agent_listings(own, stored))
    return e.select("listing_key", "report_url", F.coalesce("report_added", F.lit(False)).alias("report_added"),
                    F.size("documents").cast("long").alias("n_documents"))


@query("agent_match_counters", MATCH_SQL + """
SELECT count(listing_key) AS matched, count(*) - count(listing_key) AS "new",
  (SELECT count(*) FROM (SELECT a.seq FROM site_one a JOIN matches ON a.seq = listing_key JOIN site_two b ON b.seq = notice_id
     WHERE coalesce(a.report_url, '') = '' AND b.report_url <> '' GROUP BY a.seq)) AS report_added
FROM site_two LEFT JOIN matches ON seq = notice_id""")
def agent_match_counters(spark, sf_dir):
    own, stored = parts(spark, sf_dir)
    m = A.match_agent_listings(own, stored)
    return A.agent_match_counters(own, m, A.enrich_from_agent_listings(stored, own, m))


@query("match_documents", T.cte("site_two") + """,
docs AS (SELECT c_custkey % 50 AS page_id, c_custkey AS pos, c_mktsegment || ' rue de nation ' || c_nationkey AS title,
  'https://docs.example/' || (c_custkey % 7) || '-01-1998_' || lower(c_name) || '.pdf' AS url FROM customer),
targets AS (SELECT s_suppkey AS target_id, s_suppkey % 50 AS page_id, 'RUE ' || s_nationkey || '  building' AS address,
  CASE WHEN s_suppkey % 2 = 0 THEN (s_suppkey % 7) || '/01/1998' END AS date_text FROM supplier),
hits AS (
  SELECT target_id, pos, url FROM targets t JOIN docs d USING (page_id)
  WHERE len(list_filter(string_split_regex(lower(t.address), '\\s+'), lambda w: w <> '' AND (contains(lower(d.title), w) OR contains(lower(d.url), w)))) >= 2
     OR (date_text <> '' AND contains(lower(d.url), replace(date_text, '/', '-'))))
SELECT target_id, min(pos) AS pos, min_by(url, pos) AS url FROM hits GROUP BY target_id""")
def match_documents(spark, sf_dir):
    docs = T.read(spark, sf_dir, "customer").select(
        F.expr("c_custkey % 50").alias("page_id"), F.col("c_custkey").alias("pos"),
        F.expr("c_mktsegment || ' rue de nation ' || c_nationkey").alias("title"),
        F.expr("'https://docs.example/' || (c_custkey % 7) || '-01-1998_' || lower(c_name) || '.pdf'").alias("url"))
    targets = T.read(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("target_id"), F.expr("s_suppkey % 50").alias("page_id"),
        F.expr("'RUE ' || s_nationkey || '  building'").alias("address"),
        F.expr("CASE WHEN s_suppkey % 2 = 0 THEN (s_suppkey % 7) || '/01/1998' END").alias("date_text"))
    return A.match_documents(docs, targets)


CATALOG = [
    {"key": "supplier#000000001", "site": "https://one.example"},
    {"key": "zz", "firm": "SCP 3", "auction_page": "https://three.example/encheres", "site": "https://three.example"},
    {"key": "yy", "agents": ["Supplier#000000004", "Supplier#000000005"], "site": "https://four.example"},
]


@query("agent_catalog_lookup", T.cte("agents") + """
SELECT agent_id, CASE WHEN contains(t, 'supplier#000000001') THEN 'https://one.example' WHEN contains(t, 'zz') OR contains(t, 'scp 3') THEN 'https://three.example/encheres'
  WHEN contains(t, 'yy') OR contains(t, 'supplier#000000004') OR contains(t, 'supplier#000000005') THEN 'https://four.example' END AS site
FROM (SELECT agent_id, lower(coalesce(name, '') || ' ' || coalesce(firm, '')) AS t FROM agents)""")
def agent_catalog_lookup(spark, sf_dir):
    a = T.domain(spark, sf_dir, "agents")
    return a.select("agent_id", A.catalog_site(CATALOG, "name", "firm").alias("site"))


_CANDIDATES = ("CASE event_id % 5 WHEN 0 THEN 'https://www.linkedin.com/in/avocat' || event_id WHEN 1 THEN 'https://news.example/' || event_id"
               " WHEN 2 THEN 'https://annuaire-avocat.fr/' || event_id WHEN 3 THEN 'https://search.example/l/?uddg=https%3A%2F%2Fdupont-' || event_id || '.example&rut=1' ELSE 'https://ad_domain.example/cabinet' END")


def _any(words):
    return "(" + " OR ".join(f"contains(lower(url), '{w}')" for w in words) + ")"


@query("rank_agent_sites", f"""
WITH c AS (SELECT 'Me Dupont ' || user_id AS agent_name, event_type AS city, event_id,
    row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) - 1 AS pos,
    CASE event_id % 5 WHEN 3 THEN 'https://dupont-' || event_id || '.example' ELSE {_CANDIDATES} END AS url FROM events)
SELECT agent_name, city, min_by(url, pos) AS site FROM c
WHERE pos < 10 AND NOT contains(url, 'ad_domain') AND NOT {_any(K.SOCIAL_DOMAINS)}
  AND ({_any(K.AGENT_DIRECTORIES + K.AGENT_URL_WORDS)} OR contains(lower(url), 'dupont')) GROUP BY agent_name, city""")
def rank_agent_sites(spark, sf_dir):
    from pyspark.sql import Window
    w = Window.partitionBy("user_id", "event_type").orderBy("event_id")
    c = T.read(spark, sf_dir, "events").select(
        F.expr("'Me Dupont ' || user_id").alias("agent_name"), F.col("event_type").alias("city"),
        (F.row_number().over(w) - 1).alias("pos"), F.expr(_CANDIDATES).alias("url"))
    return A.rank_agent_sites(c, 10)


@query("fill_agent_sites", """
WITH own AS (SELECT agent_id, name AS agent_name, CASE WHEN agent_id % 2 = 0 THEN NULL ELSE 'Paris' END AS city, site FROM ("""
       + T.cte("agents") + """ SELECT * FROM agents))
SELECT agent_id, coalesce(nullif(site, ''), CASE WHEN agent_id % 3 = 0 THEN 'https://cabinet.example/' || agent_id END) AS agent_site FROM own""")
def fill_agent_sites(spark, sf_dir):
    """Missing sites from those found, by name and city (also where the city is unknown)."""
    own = T.domain(spark, sf_dir, "agents").select(
        "agent_id", F.col("name").alias("agent_name"), F.expr("CASE WHEN agent_id % 2 = 0 THEN NULL ELSE 'Paris' END").alias("city"),
        F.col("site").alias("agent_site"))
    found = own.filter("agent_id % 3 = 0").select("agent_name", "city", F.expr("'https://cabinet.example/' || agent_id").alias("site"))
    return A.fill_agent_sites(own, found).select("agent_id", "agent_site")
