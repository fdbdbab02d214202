"""Record linkage of two feeds, merging, location enrichment and agent matching."""

from __future__ import annotations

from difflib import SequenceMatcher

from pyspark.sql import functions as F

from gavelframe.functions import constants as K
from gavelframe.functions import keys as KEY
from gavelframe.functions.similarity import similar_values
from gavelframe.operators import enrich as EN
from gavelframe.operators import linkage as L
from gavelframe.sources import testbed as T
from gavelframe.suite.registry import query, sql_values

_ACCENTS = "translate(regexp_replace(trim(lower({0})), '\\s+', ' ', 'g'), 'éèêëàâäùûüôöîïç-''', 'eeeeaaauuuooiic  ')"


def norm_sql(c: str) -> str:
    return f"coalesce({_ACCENTS.format(c)}, '')"


def _norm(text: str) -> str:
    return " ".join(text.lower().split()).translate(str.maketrans("éèêëàâäùûüôöîïç-'", "eeeeaaauuuooiic  "))


def _like(a: list[str], b: list[str], threshold: float) -> list[tuple[str, str]]:
    return [(x, y) for x in a for y in b if SequenceMatcher(None, _norm(x), _norm(y)).ratio() > threshold]


_C1 = T._CITIES
_C2 = [c.replace("-", " ").lower() for c in T._CITIES]
_COURTS = list(K.COURTS.values())
LINK_SQL = T.cte("site_one", "site_two") + f""",
city_like AS (SELECT * FROM ({sql_values(_like(_C1, _C2, L.SIMILAR["city"]))}) v(c1, c2)),
court_like AS (SELECT * FROM ({sql_values(_like(_COURTS, _COURTS, L.SIMILAR["court"]))}) v(t1, t2)),
scored AS (
  SELECT a.seq AS seq_1, b.seq AS seq_2,
    CASE WHEN a.sale_date = b.sale_date THEN 30 ELSE 0 END
    + CASE WHEN (a.court, b.court) IN (SELECT (t1, t2) FROM court_like) THEN 15 ELSE 0 END
    + CASE WHEN a.start_price <> 0 AND b.start_price <> 0 AND abs(a.start_price - b.start_price) / ((a.start_price + b.start_price) / 2) < 0.1 THEN 20 ELSE 0 END
    + CASE WHEN (a.city, b.city) IN (SELECT (c1, c2) FROM city_like) THEN 15 ELSE 0 END
    + CASE WHEN a.property_type = b.property_type THEN 10 ELSE 0 END
    + CASE WHEN a.surface_m2 <> 0 AND b.surface_m2 <> 0 AND abs(a.surface_m2 - b.surface_m2) / ((a.surface_m2 + b.surface_m2) / 2) < 0.05 THEN 10 ELSE 0 END AS matched,
    CASE WHEN a.sale_date IS NOT NULL AND b.sale_date IS NOT NULL THEN 30 ELSE 0 END
    + CASE WHEN a.court <> '' AND b.court <> '' THEN 15 ELSE 0 END
    + CASE WHEN a.start_price <> 0 AND b.start_price <> 0 THEN 20 ELSE 0 END
    + CASE WHEN a.city <> '' AND b.city <> '' THEN 15 ELSE 0 END
    + CASE WHEN a.property_type <> '' AND b.property_type <> '' THEN 10 ELSE 0 END
    + CASE WHEN a.surface_m2 <> 0 AND b.surface_m2 <> 0 THEN 10 ELSE 0 END AS weight
  FROM site_one a, site_two b)"""


def feeds(spark, sf_dir):
    return T.domain(spark, sf_dir, "site_one"), T.domain(spark, sf_dir, "site_two")


@query("match_score", LINK_SQL + """
SELECT seq_1, seq_2, matched, weight FROM scored WHERE matched > 0 AND matched * 2 >= weight""", headline=True)
def match_score(spark, sf_dir):
    """Every pair of the two feeds that scores one half or more."""
    return L.match_scores(*feeds(spark, sf_dir))


_KNOWN = ", ".join(f"'{c}'" for c in EN.POSTAL_OF_CITY)
_DIM = sql_values([(p, KEY_CITY) for p, KEY_CITY in EN.CITY_OF_POSTAL.items()])
_TITLE = "array_to_string(list_transform(string_split({0}, ' '), lambda w: array_to_string(list_transform(string_split(w, '-'), lambda x: upper(x[1:1]) || x[2:]), '-')), ' ')"
_UNLIKE = sql_values([(_norm(c), _norm(e)) for c in dict.fromkeys(_C2) for e in dict.fromkeys(EN.CITY_OF_POSTAL.values())
                      if _norm(c) != _norm(e) and SequenceMatcher(None, _norm(c), _norm(e)).ratio() < 0.6])


def enriched_sql(source: str, out: str) -> str:
    """CTE `out`: rows of `source` with locations filled, corrected and counted, as `enrich_locations` does."""
    return f""",
{out}_place AS (SELECT * FROM ({_DIM}) v(p, c)),
{out}_code AS (SELECT * FROM ({sql_values(list(EN.POSTAL_OF_CITY.items()))}) v(n, q)),
{out}_unlike AS (SELECT * FROM ({_UNLIKE}) v(has, wants)),
{out}_named AS (
  SELECT s.*, coalesce(city, '') = '' AND postal_code <> '' AND c IS NOT NULL AS by_code,
    CASE WHEN coalesce(city, '') = '' AND postal_code <> '' THEN coalesce({_TITLE.format('c')}, city) ELSE city END AS new_city
  FROM {source} s LEFT JOIN {out}_place ON p = postal_code),
{out}_coded AS (
  SELECT *, coalesce(postal_code, '') = '' AND new_city <> '' AND q IS NOT NULL AS by_city,
    CASE WHEN coalesce(postal_code, '') = '' AND new_city <> '' THEN coalesce(q, postal_code) ELSE postal_code END AS new_code
  FROM {out}_named LEFT JOIN {out}_code ON n = {norm_sql('new_city')}),
{out}_judged AS (
  SELECT k.*, e.c AS expected, u.has IS NOT NULL AND new_city <> '' AND new_code <> '' AS wrong
  FROM {out}_coded k LEFT JOIN {out}_place e ON e.p = new_code LEFT JOIN {out}_unlike u ON u.has = {norm_sql('new_city')} AND u.wants = {norm_sql('e.c')}),
{out} AS (
  SELECT * EXCLUDE (city, postal_code, n, q), CASE WHEN wrong THEN {_TITLE.format('expected')} ELSE new_city END AS city, new_code AS postal_code,
    CASE WHEN new_code <> '' THEN left(new_code, 2) END AS department,
    coalesce(by_code, false)::INT + coalesce(by_city, false)::INT + coalesce(new_code <> '', false)::INT AS n_inferred
  FROM {out}_judged)"""


# the first feed in order, each row taking its best free partner
WALK_SQL = LINK_SQL.replace("WITH ", "WITH RECURSIVE ", 1) + """,
cand AS (SELECT seq_1, seq_2, matched::DOUBLE / weight AS score FROM scored WHERE matched > 0 AND matched * 2 >= weight),
options AS (
  SELECT seq_1, list(seq_2 ORDER BY score DESC, seq_2) AS o, list(score ORDER BY score DESC, seq_2) AS s, row_number() OVER (ORDER BY seq_1) AS n
  FROM cand GROUP BY seq_1),
walk AS (
  SELECT 0::BIGINT AS n, NULL::BIGINT AS seq_1, NULL::BIGINT AS seq_2, NULL::DOUBLE AS score, []::BIGINT[] AS taken
  UNION ALL
  SELECT n, seq_1, best, s[list_position(o, best)], CASE WHEN best IS NULL THEN taken ELSE list_append(taken, best) END
  FROM (SELECT t.n, t.seq_1, t.o, t.s, w.taken, list_filter(t.o, lambda x: NOT list_contains(w.taken, x))[1] AS best
        FROM walk w JOIN options t ON t.n = w.n + 1)),
chosen AS (SELECT seq_1, seq_2, score FROM walk WHERE seq_2 IS NOT NULL)"""


def _full(side: str, name: str) -> str:
    blank = "0" if name in L.NUMERIC else "''"
    return f"{side}.{name} IS NOT NULL" if name == "sale_date" else f"coalesce({side}.{name}, {blank}) <> {blank}"


def _kept(name: str) -> str:
    """Does the first feed's value stay where both have one?"""
    if name in L.LONGER:
        return f"length(a.{name}) > length(b.{name})"
    if name == "postal_code":
        return "regexp_matches(a.postal_code, '^\\d{5}$') OR NOT regexp_matches(b.postal_code, '^\\d{5}$')"
    if name == "city":
        ka, kb = (f"{norm_sql(f'{x}.city')} IN ({_KNOWN})" for x in "ab")
        return f"CASE WHEN {ka} AND NOT {kb} THEN true WHEN {kb} AND NOT {ka} THEN false ELSE length(a.city) > length(b.city) END"
    return "true"


_FIELDS = ["address", "postal_code", "city", "property_type", "surface_m2", "rooms", "description", "start_price", "sale_date",
           "court", "agent_name", "report_url"]


def _merged_sql(pairs: str, out: str) -> str:
    """CTE `out`: one row of best values per pair, with the numbers of equal and of differing fields."""
    def value(n):
        both = f"{_full('a', n)} AND {_full('b', n)}"
        return f"CASE WHEN {both} THEN CASE WHEN {_kept(n)} THEN a.{n} ELSE b.{n} END WHEN {_full('a', n)} THEN a.{n} WHEN {_full('b', n)} THEN b.{n} END AS {n}"

    def origin(n):
        return f"CASE WHEN {_full('a', n)} AND ({_kept(n)} OR NOT ({_full('b', n)})) THEN 'site_a' WHEN {_full('b', n)} THEN 'site_b' END AS {n}_from"

    def count(sign):
        return " + ".join(f"coalesce({_full('a', n)} AND {_full('b', n)} AND a.{n} {sign} b.{n}, false)::INT" for n in _FIELDS)
    return f""",
{out} AS (
  SELECT p.seq_1, p.seq_2, 'site_a+site_b' AS source, a.url, {', '.join(value(n) for n in _FIELDS)}, {', '.join(origin(n) for n in _FIELDS)},
    {count('=')} AS n_equal, {count('<>')} AS n_picked
  FROM {pairs} p JOIN site_one a ON a.seq = p.seq_1 JOIN site_two b ON b.seq = p.seq_2)"""


_FILLED = " + ".join([*(f"coalesce({_full('m', n)}, false)::INT" for n in _FIELDS), "coalesce(m.department <> '', false)::INT"])
VALID_SQL = (WALK_SQL + _merged_sql("chosen", "pairs") + enriched_sql("pairs", "m")
             + ", rest_one AS (SELECT * FROM site_one WHERE seq NOT IN (SELECT seq_1 FROM chosen)), rest_two AS (SELECT * FROM site_two WHERE seq NOT IN (SELECT seq_2 FROM chosen))"
             + enriched_sql("rest_one", "r1") + enriched_sql("rest_two", "r2"))


@query("one_to_one_match", WALK_SQL + " SELECT seq_1, seq_2, score FROM chosen", headline=True)
def one_to_one_match(spark, sf_dir):
    """Greedy one-to-one choice."""
    return L.one_to_one(*feeds(spark, sf_dir))


def _pairs_by_seq(spark, sf_dir):
    one, two = feeds(spark, sf_dir)
    pairs = one.select(F.col("seq").alias("seq_1")).join(two.select(F.col("seq").alias("seq_2")), F.col("seq_1") == F.col("seq_2"))
    return pairs, one, two


@query("survivorship_merge", T.cte("site_one", "site_two")
       + ", same AS (SELECT a.seq AS seq_1, b.seq AS seq_2 FROM site_one a JOIN site_two b ON a.seq = b.seq)"
       + _merged_sql("same", "pairs") + enriched_sql("pairs", "m") + f"""
SELECT seq_1, seq_2, source, url, {', '.join(_FIELDS)}, department, {', '.join(f'{n}_from' for n in _FIELDS)},
  n_picked + n_inferred + wrong::INT AS n_notes, n_equal::DOUBLE / ({_FILLED}) AS confidence FROM m""")
def survivorship_merge(spark, sf_dir):
    """Best value per field of rows of equal number in both feeds, where it is from, and the notes on it."""
    m = L.merge_pairs(*_pairs_by_seq(spark, sf_dir))
    return m.select("seq_1", "seq_2", "source", "url", *_FIELDS, "department", *[F.col("field_sources")[n].alias(f"{n}_from") for n in _FIELDS],
                    F.size("notes").alias("n_notes"), "confidence")


@query("cross_validate", VALID_SQL + f"""
SELECT 'merged' AS origin, seq_1, seq_2, source, url, city, postal_code, department, start_price, n_equal::DOUBLE / ({_FILLED}) AS confidence FROM m
UNION ALL SELECT 'first', seq, NULL, source, url, city, postal_code, department, start_price, NULL FROM r1
UNION ALL SELECT 'second', NULL, seq, source, url, city, postal_code, department, start_price, NULL FROM r2""")
def cross_validate(spark, sf_dir):
    """Merged and unmatched listings of both feeds."""
    v = L.cross_validate(*feeds(spark, sf_dir))
    return v.select("origin", "seq_1", "seq_2", "source", "url", "city", "postal_code", "department", "start_price", "confidence")


@query("match_counters", VALID_SQL + """
SELECT (SELECT 2 * count(*) FROM m) + (SELECT count(*) FROM r1) + (SELECT count(*) FROM r2) AS total_processed,
  (SELECT count(*) FROM m) AS matches_found, (SELECT coalesce(sum(n_picked + n_inferred), 0) FROM m) AS fields_improved""")
def match_counters(spark, sf_dir):
    return L.match_counters(L.cross_validate(*feeds(spark, sf_dir)))


@query("postal_city_fill", T.cte("site_one") + f""",
place AS (SELECT * FROM ({_DIM}) v(p, c)),
code AS (SELECT * FROM ({sql_values(list(EN.POSTAL_OF_CITY.items()))}) v(n, q)),
named AS (SELECT s.*, CASE WHEN coalesce(city, '') = '' AND postal_code <> '' THEN {_TITLE.format('c')} ELSE city END AS new_city FROM site_one s LEFT JOIN place ON p = postal_code)
SELECT seq, new_city AS city, CASE WHEN coalesce(postal_code, '') = '' AND new_city <> '' THEN coalesce(q, postal_code) ELSE postal_code END AS postal_code
FROM named LEFT JOIN code ON n = {norm_sql('new_city')}""")
def postal_city_fill(spark, sf_dir):
    return EN.fill_locations(T.domain(spark, sf_dir, "site_one")).select("seq", "city", "postal_code")


@query("enrich_locations", T.cte("site_two") + enriched_sql("site_two", "e") + """
SELECT seq, city, postal_code, department, n_inferred + wrong::INT AS n_changes FROM e""")
def enrich_locations(spark, sf_dir):
    """Fill plus the similarity-based city correction."""
    return EN.enrich_locations(T.domain(spark, sf_dir, "site_two")).select("seq", "city", "postal_code", "department", F.size("changes").alias("n_changes"))


@query("normalize_text", f"SELECT doc_id, {norm_sql('text')} AS normalized FROM documents")
def normalize_text(spark, sf_dir):
    return T.read(spark, sf_dir, "documents").select("doc_id", KEY.normalize_text("text").alias("normalized"))


@query("similar_cities", T.cte("site_one", "site_two") + f"""
SELECT DISTINCT a.city AS value_1, b.city AS value_2 FROM site_one a JOIN site_two b
  ON (a.city, b.city) IN (SELECT (c1, c2) FROM ({sql_values(_like(_C1, _C2, L.SIMILAR["city"]))}) v(c1, c2))""")
def similar_cities(spark, sf_dir):
    one, two = feeds(spark, sf_dir)
    return similar_values(one, two, {"city": L.SIMILAR["city"]}).drop("field")


@query("district_postal", T.cte("agents") + """
SELECT agent_id, '130' || CASE WHEN length(d) >= 2 THEN d ELSE lpad(d, 2, '0') END AS postal FROM (
  SELECT agent_id, nullif(regexp_extract(lower('Marseille ' || (agent_id % 16 + 1)::VARCHAR || 'ème'), '^marseille\\s*(\\d+)', 1), '') AS d FROM agents)""")
def district_postal(spark, sf_dir):
    a = T.domain(spark, sf_dir, "agents")
    city = F.concat(F.lit("Marseille "), (F.col("agent_id") % 16 + 1).cast("string"), F.lit("ème"))
    return a.select("agent_id", KEY.district_postal(city).alias("postal"))


@query("listing_agents", T.cte("listings", "agents") + """
SELECT listing_key, coalesce(nullif(agent_name, ''), name) AS agent_name, firm AS agent_firm, phone AS agent_phone, site AS agent_site
FROM listings LEFT JOIN agents USING (agent_id)""")
def listing_agents(spark, sf_dir):
    j = EN.join_agents(T.listings(spark, sf_dir), T.domain(spark, sf_dir, "agents"))
    return j.select("listing_key", "agent_name", "agent_firm", "agent_phone", "agent_site")


_POINTS = {"nanterre": (48.89, 2.2), "saint": (48.9, 2.3), "paris": (48.85, 2.35), "vi": (48.8, 2.4)}


@query("city_centroids", T.cte("site_one") + f"""
SELECT seq, CASE {' '.join(f"WHEN contains(lower(coalesce(city, '')), '{k}') OR contains('{k}', lower(coalesce(city, ''))) THEN {v[0]}::DOUBLE" for k, v in _POINTS.items())} END AS lat
FROM site_one""")
def city_centroids(spark, sf_dir):
    rows = T.domain(spark, sf_dir, "site_one").withColumns({"lat": F.lit(None).cast("double"), "lon": F.lit(None).cast("double")})
    return EN.fill_coordinates(rows, _POINTS).select("seq", "lat")
