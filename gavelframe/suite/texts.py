"""Notice texts and pages to columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from gavelframe.functions import constants as K
from gavelframe.functions import keys as KEY
from gavelframe.operators.groups import spread
from gavelframe.sources import testbed as T
from gavelframe.suite.registry import query
from gavelframe.text import cards as C
from gavelframe.text import fields as FD
from gavelframe.text import html as H
from gavelframe.text import patterns as P
from gavelframe.text import records as R

DEPARTMENTS = K.TARGET_DEPARTMENTS


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def rx(pattern: str, text: str = "t", group: int = 1) -> str:
    return f"nullif(regexp_extract({text}, {q(pattern)}, {group}), '')"


def amount_sql(x: str) -> str:
    d = f"replace(regexp_replace({x}, '[^\\d,.]', '', 'g'), ',', '.')"
    return (f"TRY_CAST(CASE WHEN length({d}) - length(replace({d}, '.', '')) > 1 THEN replace(regexp_replace({d}, '\\.[^.]*$', ''), '.', '')"
            f" || regexp_extract({d}, '(\\.[^.]*)$', 1) ELSE {d} END AS DOUBLE)")


_MONTH = "CASE {0} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in K.MONTHS.items()) + " END"


def date_sql(x: str) -> str:
    def made(p, month):
        return f"TRY_CAST({rx(p, x, 3)} || '-' || lpad({month}, 2, '0') || '-' || lpad({rx(p, x, 1)}, 2, '0') AS DATE)"
    words = f"CAST({_MONTH.format(rx(P.DATE_WORDS_LOW, x, 2))} AS VARCHAR)"
    return f"coalesce({made(P.DATE_SLASH, rx(P.DATE_SLASH, x, 2))}, {made(P.DATE_WORDS_LOW, words)})"


def decimal_sql(x: str) -> str:
    return f"TRY_CAST(replace({x}, ',', '.') AS DOUBLE)"


TEXTS = T.cte("notice_texts") + ", n AS (SELECT page_id, url, body, lower(body) AS t FROM notice_texts)"


def notices(spark, sf_dir):
    return spread(T.domain(spark, sf_dir, "notice_texts"), "page_id")


PRICE_SQL = f"coalesce({', '.join(f'nullif({amount_sql(rx(p))}, 0)' for p in P.PRICES_LOW)})"


@query("parse_price", TEXTS + f"SELECT page_id, {PRICE_SQL} AS price FROM n", headline=True)
def parse_price(spark, sf_dir):
    return notices(spark, sf_dir).select("page_id", FD.price("body").alias("price"))


@query("parse_french_date", """
SELECT o_orderkey, CASE o_orderkey % 3 WHEN 2 THEN NULL ELSE o_orderdate::DATE END AS day FROM orders""")
def parse_french_date(spark, sf_dir):
    """Dates written as ``dd/mm/yyyy`` or in French words are read back; a 31 February is NULL."""
    months = F.array(*[F.lit(m) for m in ["janvier", "février", "mars", "avril", "mai", "juin", "juillet", "août",
                                          "septembre", "octobre", "novembre", "décembre"]])
    d = F.col("o_orderdate")
    words = F.concat_ws(" ", F.concat(F.dayofmonth(d).cast("string"), F.when(F.dayofmonth(d) == 1, "er").otherwise("")),
                        F.element_at(months, F.month(d)), F.year(d).cast("string"))
    text = (F.when(F.col("o_orderkey") % 3 == 0, F.date_format(d, "dd/MM/yyyy"))
             .when(F.col("o_orderkey") % 3 == 1, words).otherwise("31 février 2024"))
    return T.read(spark, sf_dir, "orders").select("o_orderkey", FD.french_date(text).alias("day"))


@query("parse_sale_datetime", TEXTS + f"""
SELECT page_id, coalesce({', '.join(date_sql(rx(p)) for p in P.SALE_DATES_LOW)}) AS sale_date,
  {rx(P.SALE_TIME, 'body', 1)} || 'h' || coalesce({rx(P.SALE_TIME, 'body', 2)}, '00') AS sale_time FROM n""")
def parse_sale_datetime(spark, sf_dir):
    return notices(spark, sf_dir).select("page_id", FD.sale_date("body").alias("sale_date"), FD.sale_time(F.col("body")).alias("sale_time"))


def _visit_sql(pattern: str) -> str:
    days, hours = f"regexp_extract_all(t, {q(pattern)}, 1)", f"regexp_extract_all(t, {q(pattern)}, 2)"
    return (f"list_filter(list_transform(list_zip({days}, {hours}), lambda p: ({date_sql('p[1]')})::TIMESTAMP"
            " + to_hours(coalesce(TRY_CAST(nullif(p[2], '') AS INT), 14))), lambda x: x IS NOT NULL)")


_SECTION = (f"list_filter(list_transform(regexp_extract_all(regexp_extract(t, {q(P.VISIT_SECTION_LOW)}, 1), {q(P.VISIT_SECTION_DATE)}, 1),"
            f" lambda d: ({date_sql('d')})::TIMESTAMP + to_hours(14)), lambda x: x IS NOT NULL)")


VISITS_SQL = f"""v AS (
  SELECT page_id, {_visit_sql(P.VISITS_LOW[0])} AS a, {_visit_sql(P.VISITS_LOW[1])} AS b, {_SECTION} AS c FROM n),
seen AS (
  SELECT page_id, coalesce(array_to_string(list_transform(CASE WHEN len(a) > 0 THEN a WHEN len(b) > 0 THEN b ELSE c END, lambda x: strftime(x, '%Y-%m-%d %H:%M')), ','), '') AS visits FROM v)"""


@query("parse_visits", TEXTS + f", {VISITS_SQL} SELECT page_id, visits FROM seen")
def parse_visits(spark, sf_dir):
    shown = F.transform(FD.visits("body"), lambda v: F.date_format(v, "yyyy-MM-dd HH:mm"))
    return notices(spark, sf_dir).select("page_id", F.array_join(shown, ",").alias("visits"))


@query("parse_features", TEXTS + f"""
SELECT page_id, coalesce({', '.join(decimal_sql(rx(p)) for p in P.SURFACES_LOW)}) AS surface_m2, TRY_CAST({rx(P.ROOMS_LOW)} AS INT) AS rooms,
  TRY_CAST({rx(P.BEDROOMS_LOW)} AS INT) AS bedrooms, TRY_CAST({rx(P.FLOOR_LOW)} AS INT) AS floor FROM n""")
def parse_features(spark, sf_dir):
    b = F.col("body")
    return notices(spark, sf_dir).select("page_id", FD.surface(b).alias("surface_m2"), FD.rooms(b).alias("rooms"),
                                         FD.bedrooms(b).alias("bedrooms"), FD.floor(b).alias("floor"))


def class_sql(families: dict, otherwise: str, t: str = "t") -> str:
    arms = " ".join(f"WHEN {' OR '.join(f'contains({t}, {q(w)})' for w in words)} THEN {q(n)}" for n, words in families.items())
    return f"CASE {arms} ELSE {q(otherwise)} END"


@query("classify_property", f"""
SELECT doc_id, {class_sql(K.PROPERTY_WORDS, 'autre')} AS property_type FROM (SELECT doc_id, lower(text) AS t FROM documents)""")
def classify_property(spark, sf_dir):
    return T.read(spark, sf_dir, "documents").select("doc_id", FD.property_class("text").alias("property_type"))


@query("classify_notices", TEXTS + f"SELECT page_id, {class_sql(K.PROPERTY_WORDS, 'autre')} AS property_type FROM n")
def classify_notices(spark, sf_dir):
    return notices(spark, sf_dir).select("page_id", FD.property_class("body").alias("property_type"))


_CUT = "CASE " + " ".join(f"WHEN contains(body, {q(m)}) THEN split_part(body, {q(m)}, 1)" for m in P.AGENT_MARKERS) + " ELSE body END"


def _addr_sql(p: str) -> str:
    c = f"trim(regexp_replace({rx(p, 's')}, '\\s+', ' ', 'g'))"
    return f"CASE WHEN NOT regexp_matches(lower({c}), {q(P.NOT_ADDRESS_LOW)}) AND length({c}) > 10 THEN {c} END"


_PLACE = f"trim({rx(P.PLACE_IN_SENTENCE, 's')})"
ADDRESS_SQL = f"coalesce({', '.join(_addr_sql(p) for p in P.ADDRESSES)}, CASE WHEN NOT regexp_matches({_PLACE}, {q(P.NOT_PLACE)}) THEN {_PLACE} END)"


@query("parse_address", TEXTS + f"""
SELECT page_id, {ADDRESS_SQL} AS address FROM (SELECT page_id, {_CUT} AS s FROM n)""")
def parse_address(spark, sf_dir):
    return notices(spark, sf_dir).select("page_id", FD.address("body").alias("address"))


def title_sql(x: str) -> str:
    return f"array_to_string(list_transform(string_split({x}, ' '), lambda w: array_to_string(list_transform(string_split(w, '-'), lambda c: upper(c[1:1]) || c[2:]), '-')), ' ')"


def located_sql(dictionary: str = "true") -> str:
    """Postal code and city of every notice: text, url, named city, numbered district."""
    named = "CASE " + " ".join(f"WHEN regexp_matches(ls, {q(P.named_city(c))}) THEN {q(c)}" for c in K.SOUTHERN_CITIES) + " END"
    codes = "CASE named " + " ".join(f"WHEN {q(c)} THEN {q(p)}" for c, p in K.SOUTHERN_CITIES.items()) + " END"
    return f"""
cuts AS (SELECT *, {_CUT} AS s, lower({_CUT}) AS ls FROM n),
places AS (
  SELECT *, coalesce({rx(P.postal_pattern(DEPARTMENTS), 's')}, {rx(P.URL_CITY, 'url', 2)} || '000') AS code,
    coalesce({rx(P.city_after_postal(DEPARTMENTS), 's')}, {rx(P.CITY_AFTER_A, 's')},
      {title_sql(f"replace({rx(P.URL_CITY, 'url', 1)}, '-', ' ')")}) AS place FROM cuts),
filled AS (
  SELECT page_id, url, body, t, s, ls, coalesce(place, {title_sql("replace(named, '-', ' ')")}) AS place, coalesce(code, {codes}) AS code
  FROM (SELECT *, CASE WHEN place IS NULL AND {dictionary} THEN {named} END AS named FROM places)),
numbered AS (SELECT *, CASE WHEN contains(lower(place), 'marseille') THEN {rx(P.DISTRICT_LOW, 'ls')} END AS d FROM filled),
located AS (
  SELECT page_id, url, body, t, s, CASE WHEN d IS NOT NULL AND (code IS NULL OR code = '13000') THEN '130' || lpad(d, 2, '0') ELSE code END AS postal_code,
    CASE WHEN d IS NOT NULL THEN 'Marseille ' || d || 'ème' ELSE place END AS city FROM numbered)"""


@query("parse_location", TEXTS + "," + located_sql() + """
SELECT page_id, postal_code, left(postal_code, 2) AS department, city FROM located""")
def parse_location(spark, sf_dir):
    place = FD.location("body", "url")
    return notices(spark, sf_dir).select("page_id", place["postal_code"].alias("postal_code"), place["city"].alias("city")).withColumn(
        "department", KEY.department_of("postal_code"))


@query("parse_agent_address", TEXTS + f"""
SELECT page_id, trim({rx(P.AGENT_ADDRESS, "body[length(s) + 1:]")}) AS agent_address FROM (SELECT page_id, body, {_CUT} AS s FROM n)""")
def parse_agent_address(spark, sf_dir):
    return notices(spark, sf_dir).select("page_id", FD.agent_address("body").alias("agent_address"))


PHONE_SQL = f"trim(regexp_replace(coalesce({', '.join(f"nullif(trim({rx(p, 'body')}), '')" for p in P.PHONES)}), '\\s+$', ''))"
FIRM_SQL = f"trim({rx(P.FIRM, 'body')})"


@query("parse_agent", TEXTS + f"""
SELECT page_id, coalesce({', '.join(f"trim({rx(p, 'body')})" for p in P.AGENT_NAMES)}) AS agent_name,
  {PHONE_SQL} AS phone, {rx(P.EMAIL, 'body')} AS email, {FIRM_SQL} AS firm FROM n""")
def parse_agent(spark, sf_dir):
    return notices(spark, sf_dir).select("page_id", FD.agent_name("body").alias("agent_name"), FD.agent_phone("body").alias("phone"),
                                         FD.agent_email("body").alias("email"), FD.agent_firm("body").alias("firm"))


@query("parse_court", TEXTS + f"""
SELECT page_id, CASE {' '.join(f"WHEN contains(t, {q(v.lower())}) OR contains(t, {q(k.replace('-', ' '))}) THEN {q(v)}" for k, v in K.COURTS.items())} END AS court,
  {rx(P.COURT_LOW)} AS spelled FROM n""")
def parse_court(spark, sf_dir):
    from gavelframe.functions.values import matched
    return notices(spark, sf_dir).select("page_id", FD.court("body").alias("court"), matched(P.COURT_LOW, F.lower("body")).alias("spelled"))


_SAID = "trim(" + rx(P.OCCUPANCY_LOW[0][0]) + ")"


OCCUPANCY_SQL = (f"CASE WHEN regexp_matches(t, {q(P.OCCUPANCY_LOW[0][0])}) THEN upper({_SAID}[1:1]) || {_SAID}[2:] "
                 + " ".join(f"WHEN regexp_matches(t, {q(p)}) THEN {q(v)}" for p, v in P.OCCUPANCY_LOW[1:]) + " END")


@query("parse_occupancy", TEXTS + f"""
SELECT page_id, {OCCUPANCY_SQL} AS occupancy,
  state, CASE WHEN state = 'occupé' THEN trim({rx(P.TENANT_LOW)}) END AS tenant, CASE WHEN state = 'occupé' THEN {amount_sql(rx(P.RENT_LOW))} END AS rent
FROM (SELECT *, CASE WHEN contains(t, 'libre') AND contains(t, 'occupation') THEN 'libre' WHEN contains(t, 'occupé') OR contains(t, 'loué') THEN 'occupé' END AS state FROM n)""")
def parse_occupancy(spark, sf_dir):
    b = F.col("body")
    return notices(spark, sf_dir).select("page_id", FD.occupancy(b).alias("occupancy"), FD.occupancy_state(b).alias("state"),
                                         FD.tenant(b).alias("tenant"), FD.rent(b).alias("rent"))


PARCEL_SQL = (f"coalesce('Section ' || {rx(P.PARCEL_SECTION, 'body', 1)} || ' n°' || {rx(P.PARCEL_SECTION, 'body', 2)}, "
              + ", ".join(f"trim({rx(p, 'body')})" for p in P.PARCELS) + ")")


@query("parse_parcel", TEXTS + f"""
SELECT page_id, {PARCEL_SQL} AS parcel FROM n""")
def parse_parcel(spark, sf_dir):
    return notices(spark, sf_dir).select("page_id", FD.parcel("body").alias("parcel"))


@query("parse_coownership", TEXTS + f"""
SELECT page_id, f AS is_coownership, CASE WHEN f THEN {rx(P.LOT_LOW)} END AS lot, CASE WHEN f THEN {amount_sql(rx(P.CHARGES_LOW))} END AS charges,
  CASE WHEN f THEN TRY_CAST({rx(P.SHARES_LOW)} AS INT) END AS shares FROM (SELECT *, contains(t, 'copropriété') AS f FROM n)""")
def parse_coownership(spark, sf_dir):
    return notices(spark, sf_dir).select("page_id", *[c.alias(n) for n, c in FD.coownership("body").items()])


@query("parse_finance_legal", TEXTS + f"""
SELECT page_id, {amount_sql(rx(P.START_PRICE_LOW))} AS start_price, {amount_sql(rx(P.FEES_LOW))} AS fees, {amount_sql(rx(P.DEBT_LOW))} AS debt,
  {rx(P.CASE_NUMBER, 'body')} AS case_no FROM n""")
def parse_finance_legal(spark, sf_dir):
    return notices(spark, sf_dir).select("page_id", *[c.alias(n) for n, c in FD.finance(F.col("body")).items()])


def _diag_sql(word: str) -> str:
    g = rx(FD.diagnostic_pattern(word), "body")
    return f"CASE WHEN contains(lower(body), {q(word.lower())}) THEN CASE WHEN {g} IS NOT NULL THEN {q(word + ': ')} || {g} ELSE {q(word)} END END"


@query("parse_description_diagnostics", TEXTS + f"""
SELECT page_id, left(trim(coalesce({', '.join(rx(p, 'body') for p in P.DESCRIPTIONS)})), 500) AS description,
  concat_ws(', ', {', '.join(_diag_sql(w) for w in K.DIAGNOSTICS)}) AS diagnostics FROM n""")
def parse_description_diagnostics(spark, sf_dir):
    return notices(spark, sf_dir).select("page_id", FD.description("body", 500).alias("description"),
                                         F.array_join(FD.diagnostics("body"), ", ").alias("diagnostics"))


@query("source_id_from_url", TEXTS + f"""
SELECT page_id, CASE WHEN contains(url, 'site-a') THEN {rx(P.SOURCE_IDS['site_a'], 'url')} WHEN contains(url, 'site-b') THEN {rx(P.SOURCE_IDS['site_b'], 'url')}
  ELSE coalesce({rx(P.SOURCE_IDS['site_c'], 'url', 1)}, {rx(P.SOURCE_IDS['site_c'], 'url', 2)}) END AS source_id FROM n""")
def source_id_from_url(spark, sf_dir):
    n = notices(spark, sf_dir).withColumn("source", FD.site_of())
    return n.select("page_id", FD.source_id().alias("source_id"))


# --- pages ------------------------------------------------------------------------------

# a page around every notice: anchors, embedded files, images, scripts, cards
_HTML = (
    "'<html><head><title>Vente ' || s_suppkey || '</title></head><body><nav><a href=\"/home\">Accueil</a></nav><main>'"
    " || CASE WHEN s_suppkey % 10 = 9 THEN '' ELSE '<a href=\"/doc/cahier_' || s_suppkey || '.pdf\">Cahier des charges</a>'"
    " || '<a href=\"https://x.example/pv_' || s_suppkey || '.pdf\"></a><a href=\"/doc/cahier_' || s_suppkey || '.pdf\">Cahier des charges</a>' END"
    " || CASE s_suppkey % 4 WHEN 0 THEN '<a href=\"mailto:me' || s_suppkey || '@a.example?subject=x\">mail</a><a class=\"site\" href=\"https://cab' || s_suppkey || '.example\">site</a>'"
    " WHEN 1 THEN '<a href=\"https://avocat' || s_suppkey || '.example/\">x</a>' ELSE '' END"
    " || CASE WHEN s_suppkey % 5 = 0 THEN '<img srcset=\"/s/1.jpg 320w, /s/2.jpg 640w\" src=\"/s/0.jpg\"><img data-src=\"/lazy.jpg\"><div data-photos=''[\"/l/a.jpg\",{\"url\":\"/l/b.jpg\"},{\"src\":\"/l/c.jpg\"}]''></div><script>var s=\"streetview?adresse_id=' || s_suppkey || '&x=1\";</script>' ELSE '' END"
    " || CASE WHEN s_suppkey % 3 = 2 THEN '<script>{\"critere_occupation_bien\":\"Loué ' || s_suppkey || '\"}</script>' ELSE '' END"
    " || '<a href=\"/encheres/immobilier/maisons/paris-75/bien_' || s_suppkey || '\">Lot</a>'"
    " || '<img class=\"photo\" src=\"/p/' || s_suppkey || '.jpg\"><img src=\"/_next/image?url=https%3A%2F%2Fcdn.example%2F' || s_suppkey || '.png&amp;w=640\"><img src=\"/placeholder.png\"><img src=\"/p/' || s_suppkey || '.jpg\">'"
    " || CASE WHEN s_suppkey % 2 = 0 THEN '<script>{\"__typename\":\"LotDocument\",\"file\":\"a' || s_suppkey || '.pdf\",\"nom\":\"PV de description\"},{\"file\":\"b.pdf\",\"nom\":\"Diagnostics\"}; \"/static/lot/photo/' || s_suppkey || '.jpg\"</script>' ELSE '' END"
    " || CASE s_suppkey % 3"
    " WHEN 0 THEN '<script id=\"__NEXT_DATA__\" type=\"application/json\">{\"props\":{\"pageProps\":{\"cards\":[{\"price\":\"' || (100000 + s_suppkey) || '\",\"livingArea\":\"45.5\",\"title\":\"T2\",\"url\":\"/a/' || s_suppkey || '\",\"city\":\"Paris\"},{\"price\":null,\"surface\":\"30\"}]}}}</script>'"
    " WHEN 1 THEN '<script type=\"application/ld+json\">{\"@type\":\"ItemList\",\"itemListElement\":[{\"item\":{\"@type\":\"Residence\",\"name\":\"Maison 80,5 m²\",\"url\":\"/m/' || s_suppkey || '\",\"offers\":{\"price\":' || (200000 + s_suppkey) || '}}},{\"item\":{\"name\":\"sans prix\"}}]}</script>'"
    " ELSE '' END"
    " || '<article class=\"card\"><a href=\"/vente/' || s_suppkey || '\">Studio ' || s_suppkey || '</a> 75011 Paris, ' || (20 + s_suppkey % 30) || ' m² <b>' || (90 + s_suppkey % 9) || ' 000 €</b> le 12/02/2024 <span class=\"badge\">a venir</span></article>'"
    " || '</main></body></html>'"
)
_PAGE_URL = "'https://site' || s_suppkey || '.example/list/page?x=1'"
PAGES = f"WITH p AS (SELECT s_suppkey AS page_id, {_PAGE_URL} AS url, {_HTML} AS html FROM supplier)"


def built_pages(spark, sf_dir):
    return T.read(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("page_id"), F.expr(_PAGE_URL).alias("url"), F.expr(_HTML).alias("html"))


def _plain(x: str) -> str:
    """Character references as the pages use them; the last may have lost its semicolon."""
    for name, char in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("#39", "''"), ("amp", "&")):
        x = f"regexp_replace({x}, '&{name};?', '{char}', 'g')"
    return x


@query("html_to_text", rf"""
WITH cut AS (
  SELECT page_id, regexp_extract(html, '(?s)<article[^>]*>(.*)</article>', 1) AS body, trim({_plain("regexp_extract(html, '(?s)<title>(.*?)</title>', 1)")}) AS title,
    list_zip(regexp_extract_all(html, '(?s)<a [^>]*href="([^"]+)"[^>]*>(.*?)</a>', 1), regexp_extract_all(html, '(?s)<a [^>]*href="([^"]+)"[^>]*>(.*?)</a>', 2)) AS links FROM pages),
nodes AS (
  SELECT page_id, title, [struct_pack(u := {_plain("l[1]")}, t := {_plain("l[2]")}) FOR l IN links] AS links,
    regexp_split_to_array(regexp_replace(body, '(?s)<script.*?</script>|<style.*?</style>|<!--.*?-->', '<x>', 'g'), '<[^>]*>') AS parts FROM cut),
shown AS (
  SELECT page_id, title, links, regexp_replace(regexp_replace(array_to_string(list_filter(
    [regexp_replace({_plain("x")}, '^\s+|\s+$', '', 'g') FOR x IN parts], lambda x: x <> ''), chr(10)), '\n{{3,}}', chr(10) || chr(10), 'g'), ' {{2,}}', ' ', 'g') AS text,
    [l.t || ': ' || l.u FOR l IN links IF contains(lower(l.u), '.pdf') OR regexp_matches(lower(l.t), 'cahier|pv|document|télécharger')] AS docs FROM nodes)
SELECT page_id, title, text, len(links) AS n_links, concat_ws(chr(10), CASE WHEN title <> '' THEN 'TITRE: ' || title END, text,
  CASE WHEN len(docs) > 0 THEN chr(10) || 'DOCUMENTS: ' || array_to_string(docs, ', ') END) AS digest FROM shown""", headline=True)
def html_to_text(spark, sf_dir):
    """Titles, texts and links of all stored pages; the SQL holds for pages whose main text is one article without images."""
    parsed = H.page_digest(H.read_pages(T.read(spark, sf_dir, "pages")))
    return parsed.select("page_id", "title", "text", F.size("links").alias("n_links"), "digest")


@query("extract_links", f"""
WITH l AS (SELECT page_id, url AS page_url, unnest(regexp_extract_all(html, {q(P.LINK)}, 1)) AS href, generate_subscripts(regexp_extract_all(html, {q(P.LINK)}, 1), 1) AS pos FROM pages)
SELECT page_id, CASE WHEN href LIKE 'http%' THEN href WHEN href LIKE '//%' THEN 'https:' || href ELSE regexp_extract(page_url, '^(https?://[^/?#]+)', 1) || href END AS url, min(pos) - 1 AS pos
FROM l GROUP BY 1, 2""", headline=True)
def extract_links(spark, sf_dir):
    """Absolute distinct links of every stored page."""
    return C.page_links(T.read(spark, sf_dir, "pages")).select("page_id", "url", F.col("pos").cast("long").alias("pos"))


@query("property_links", PAGES + """
SELECT page_id, 'https://site' || page_id || '.example/encheres/immobilier/maisons/paris-75/bien_' || page_id AS url FROM p""")
def property_links(spark, sf_dir):
    return C.page_links(built_pages(spark, sf_dir), C.is_property_link()).select("page_id", "url")


@query("parse_documents", PAGES + """
SELECT page_id, CASE WHEN page_id % 10 = 9 THEN '' WHEN page_id % 2 = 0 THEN 'PV de description=https://site' || page_id || '.example/static/lot/document/a' || page_id || '.pdf=PV de description|Diagnostics=https://site' || page_id || '.example/static/lot/document/b.pdf=Diagnostics'
  ELSE 'Cahier des charges=https://site' || page_id || '.example/doc/cahier_' || page_id || '.pdf=Cahier des conditions de vente|Procès-verbal de description=https://x.example/pv_' || page_id || '.pdf=Procès-verbal de description' END AS documents,
  CASE WHEN page_id % 10 = 9 THEN NULL WHEN page_id % 2 = 0 THEN 'https://site' || page_id || '.example/static/lot/document/a' || page_id || '.pdf' ELSE 'https://x.example/pv_' || page_id || '.pdf' END AS report_url,
  CASE WHEN page_id % 10 = 9 THEN 'a_demander' ELSE 'a_telecharger' END AS report_status
FROM p""")
def parse_documents(spark, sf_dir):
    d = built_pages(spark, sf_dir).withColumn("documents", FD.pdf_documents("html", "url"))
    shown = F.transform("documents", lambda x: F.concat_ws("=", x["name"], x["url"], x["type"]))
    return d.select("page_id", F.array_join(shown, "|").alias("documents"), FD.report_of().alias("report_url"),
                    FD.report_status("documents", FD.report_of()).alias("report_status"))


@query("classify_firm_documents", """
SELECT c_custkey AS doc_id, CASE c_custkey % 5 WHEN 0 THEN 'cahier_charges' WHEN 1 THEN 'cahier_charges' WHEN 2 THEN 'proces_verbal' WHEN 3 THEN 'photos' ELSE 'document' END AS kind FROM customer""")
def classify_firm_documents(spark, sf_dir):
    d = T.read(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("doc_id"),
        F.expr("CASE c_custkey % 5 WHEN 0 THEN 'Charges de vente' WHEN 2 THEN 'Proces verbal' WHEN 4 THEN 'Annexe' ELSE 'Voir' END").alias("title"),
        F.expr("CASE c_custkey % 5 WHEN 1 THEN '/d/CAHIER.pdf' WHEN 3 THEN '/images/1' ELSE '/d/1' END").alias("url"))
    return d.select("doc_id", FD.firm_document_class("title", "url").alias("kind"))


@query("page_agent_contacts", PAGES + """
SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'me' || page_id || '@a.example' ELSE 'x@y.example' END AS agent_email,
  CASE page_id % 4 WHEN 0 THEN 'https://cab' || page_id || '.example' WHEN 1 THEN 'https://avocat' || page_id || '.example/' END AS agent_site,
  CASE WHEN page_id % 3 = 2 THEN 'Loué ' || page_id END AS occupancy FROM p""")
def page_agent_contacts(spark, sf_dir):
    """What pages say beside their text: mail links, sites, embedded occupancy."""
    return built_pages(spark, sf_dir).select(
        "page_id", FD.agent_email(F.lit("écrire à x@y.example"), "html").alias("agent_email"), FD.agent_site("html").alias("agent_site"),
        FD.occupancy(F.lit("Vente"), "html").alias("occupancy"))


@query("parse_photos", PAGES + """
SELECT page_id, CASE WHEN page_id % 5 = 0 THEN concat_ws('|', o || '/s/2.jpg', o || '/s/0.jpg', o || '/lazy.jpg', '') ELSE '' END
  || o || '/p/' || page_id || '.jpg|https://cdn.example/' || page_id || '.png'
  || CASE WHEN page_id % 2 = 0 THEN '|' || o || '/static/lot/photo/' || page_id || '.jpg' ELSE '' END
  || CASE WHEN page_id % 5 = 0 THEN concat_ws('|', '', o || '/back/services/streetview?adresse_id=' || page_id || '&x=1', o || '/l/a.jpg', o || '/l/b.jpg', o || '/l/c.jpg') ELSE '' END AS photos
FROM (SELECT page_id, 'https://site' || page_id || '.example' AS o FROM p)""")
def parse_photos(spark, sf_dir):
    return built_pages(spark, sf_dir).select("page_id", F.array_join(FD.photos("html", "url"), "|").alias("photos"))


@query("parse_embedded_listings", PAGES + """
SELECT page_id, 0 AS pos, CASE page_id % 3 WHEN 0 THEN 'T2' WHEN 1 THEN 'Maison 80,5 m²' ELSE 'Studio ' || page_id || ' 75011 Paris, ' || (20 + page_id % 30) || ' m² ' || (90 + page_id % 9) || ' 000 € le 12/02/2024 a venir' END AS title,
  CASE page_id % 3 WHEN 0 THEN 100000.0 + page_id WHEN 1 THEN 200000.0 + page_id ELSE (90 + page_id % 9) * 1000.0 END::DOUBLE AS price,
  CASE page_id % 3 WHEN 0 THEN 45.5 WHEN 1 THEN 80.5 ELSE 20.0 + page_id % 30 END::DOUBLE AS surface_m2,
  CASE page_id % 3 WHEN 0 THEN '/a/' WHEN 1 THEN '/m/' ELSE '/vente/' END || page_id AS url, CASE page_id % 3 WHEN 0 THEN 'Paris' END AS city
FROM p""")
def parse_embedded_listings(spark, sf_dir):
    return C.embedded_ads(built_pages(spark, sf_dir))


_FEED = ("CASE event_id % 2 WHEN 0 THEN '{\"ads\":[{\"subject\":\"T3\",\"list_id\":' || event_id || ',\"price\":[' || value * 1000 || '],\"location\":{\"city\":\"Paris\"},\"attributes\":[{\"key\":\"rooms\",\"value\":\"3\"},{\"key\":\"square\",\"value\":\"60.5\"}]},{\"subject\":\"vide\",\"price\":[]}]}'"
         " ELSE '{\"realEstateAds\":[{\"id\":\"x' || event_id || '\",\"title\":\"Maison\",\"city\":\"Lyon\",\"price\":' || value * 1000 || ',\"surfaceArea\":75}]}' END")


@query("parse_ad_feeds", """
SELECT event_id AS feed_id, 0 AS pos, CASE event_id % 2 WHEN 0 THEN 'T3' ELSE 'Maison' END AS title, round(value * 1000, 2) AS price,
  CASE event_id % 2 WHEN 0 THEN 60.5 ELSE 75.0 END::DOUBLE AS surface_m2, CASE event_id % 2 WHEN 0 THEN '' ELSE 'x' END || event_id AS url,
  CASE event_id % 2 WHEN 0 THEN 'Paris' ELSE 'Lyon' END AS city FROM events WHERE value <> 0""")
def parse_ad_feeds(spark, sf_dir):
    feeds = T.read(spark, sf_dir, "events").select(F.col("event_id").alias("feed_id"), F.expr(_FEED).alias("json"))
    return C.feed_ads(feeds).withColumn("price", F.round("price", 2))


_CARD = ("CASE o_orderkey % 4 WHEN 0 THEN 'Appartement T2 Marseille ' || (1 + o_orderkey % 16) || 'ème 45,5 m² Adjugé : ' || (50 + o_orderkey % 90) || ' 000 €'"
         " WHEN 1 THEN 'Maison 83000 Toulon 120 m² Adjugé à ' || (o_orderkey % 900 + 100) || ' 500 €' WHEN 2 THEN 'Box 13008 12 m² Adjugé 9 000 €' ELSE 'Villa 13100 Adjudication inconnue adjugé 1 €' END")


@query("parse_adjudication_cards", """
SELECT o_orderkey AS card_id, 'site_a' AS source, CASE WHEN o_orderkey % 4 = 0 THEN '130' || lpad((1 + o_orderkey % 16)::VARCHAR, 2, '0') ELSE '83000' END AS postal_code,
  CASE WHEN o_orderkey % 4 = 0 THEN (50 + o_orderkey % 90) * 1000.0 ELSE (o_orderkey % 900 + 100) * 1000.0 + 500 END::DOUBLE AS hammer_price,
  CASE WHEN o_orderkey % 4 = 0 THEN 'Appartement' ELSE 'Maison' END AS property_type, CASE WHEN o_orderkey % 4 = 0 THEN 45.5 ELSE 120 END::DOUBLE AS surface_m2
FROM orders WHERE o_orderkey % 4 < 2""")
def parse_adjudication_cards(spark, sf_dir):
    cards = T.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("card_id"), F.expr(_CARD).alias("text"))
    return C.sold_lots(cards)


@query("parse_notice_cards", PAGES + """
SELECT page_id, 0 AS pos, 'https://site' || page_id || '.example/vente/' || page_id AS url, 'Studio ' || page_id AS title, '75011' AS postal_code,
  ((90 + page_id % 9) * 1000)::DOUBLE AS start_price, DATE '2024-02-12' AS sale_date, 'a venir' AS status FROM p""")
def parse_notice_cards(spark, sf_dir):
    return C.notice_cards(built_pages(spark, sf_dir))


# --- records ----------------------------------------------------------------------------

_RECORD = ("'{\"address\":\"' || o_orderkey || ' rue X\",\"postal_code\":\"75011\",\"property_type\":\"' || CASE o_orderkey % 3 WHEN 0 THEN 'maison' WHEN 1 THEN 'chateau' ELSE 'parking' END"
           " || '\",\"surface\":' || (o_orderkey % 90) || ',\"sale_date\":\"' || CASE o_orderkey % 4 WHEN 0 THEN '2024-02-31' ELSE CAST(CAST(o_orderdate AS DATE) AS STRING) END"
           " || '\",\"visits\":[\"2024-01-05T10:00:00\",\"bad\"]' || CASE o_orderkey % 2 WHEN 0 THEN ',\"report_url\":\"https://d.example/pv.pdf\"' ELSE '' END || ',\"confidence\":0.' || (o_orderkey % 10) || '}'")


@query("extraction_to_listing", """
SELECT 'u' || o_orderkey AS url, o_orderkey || ' rue X' AS address, CASE o_orderkey % 3 WHEN 0 THEN 'maison' WHEN 1 THEN 'autre' ELSE 'parking' END AS property_type,
  (o_orderkey % 90)::DOUBLE AS surface_m2, CASE WHEN o_orderkey % 4 <> 0 THEN o_orderdate::DATE END AS sale_date, 1 AS n_visits,
  CASE WHEN o_orderkey % 2 = 0 THEN 'a_telecharger' ELSE 'non_disponible' END AS report_status, (o_orderkey % 10) / 10.0::DOUBLE < 0.7 AND o_orderkey % 10 <> 0 AS low_confidence
FROM orders""", headline=True)
def extraction_to_listing(spark, sf_dir):
    rows = T.read(spark, sf_dir, "orders").select(F.expr("'u' || o_orderkey").alias("url"), F.lit("x").alias("source"), F.expr(_RECORD).alias("record"))
    e = R.usable(R.extraction_to_listing(rows))
    return e.select("url", "address", "property_type", "surface_m2", "sale_date", F.size("visit_times").alias("n_visits"), "report_status", "low_confidence")


@query("fill_from_report", T.cte("site_one") + """
SELECT seq AS listing_key, coalesce(nullif(a.postal_code, ''), '75019') AS postal_code, coalesce(nullif(a.surface_m2, 0), 33.0) AS surface_m2,
  concat_ws(chr(10), 'Vente ' || s_name || chr(10) || chr(10) || 'Rapport', 'État d''occupation: occupé (M. X) - Loyer: 800.0€/mois', CASE WHEN seq % 2 = 0 THEN 'Copropriété - Lot n°7' END) AS description, 'disponible' AS report_status
FROM site_one a JOIN supplier ON s_suppkey = seq""")
def fill_from_report(spark, sf_dir):
    one = T.domain(spark, sf_dir, "site_one").withColumnRenamed("seq", "listing_key")
    reports = one.select(
        "listing_key", F.lit("75019").alias("postal_code"), F.lit(33.0).alias("surface_m2"), F.lit("").alias("address"), F.lit(None).cast("string").alias("city"),
        F.lit(0).alias("rooms"), F.lit(None).cast("double").alias("start_price"), F.lit("Rapport").alias("description"), F.lit("occupé").alias("occupancy"),
        F.lit("M. X").alias("tenant"), F.lit(800.0).alias("rent"), (F.col("listing_key") % 2 == 0).alias("is_coownership"), F.lit("7").alias("lot"),
        F.lit(None).cast("double").alias("charges"))
    f = R.fill_from_report(one, reports)
    return f.select("listing_key", "postal_code", "surface_m2", "description", "report_status")


FEATURES_SQL = f"""coalesce({', '.join(decimal_sql(rx(p)) for p in P.SURFACES_LOW)}) AS surface_m2, TRY_CAST({rx(P.ROOMS_LOW)} AS INT) AS rooms,
  TRY_CAST({rx(P.BEDROOMS_LOW)} AS INT) AS bedrooms, TRY_CAST({rx(P.FLOOR_LOW)} AS INT) AS floor,
  coalesce({', '.join(date_sql(rx(p)) for p in P.SALE_DATES_LOW)}) AS sale_date,
  coalesce({', '.join(f"trim({rx(p, 'body')})" for p in P.AGENT_NAMES)}) AS agent_name,
  coalesce(CASE {' '.join(f"WHEN contains(t, {q(v.lower())}) OR contains(t, {q(k.replace('-', ' '))}) THEN {q(v)}" for k, v in K.COURTS.items())} END,
    'Tribunal Judiciaire de ' || {title_sql(rx(P.COURT_LOW))}) AS court"""
_STATE = "CASE WHEN contains(t, 'libre') AND contains(t, 'occupation') THEN 'libre' WHEN contains(t, 'occupé') OR contains(t, 'loué') THEN 'occupé' END"


@query("report_summary", TEXTS + f""", {VISITS_SQL},
f AS (
  SELECT page_id, {ADDRESS_SQL} AS address, {rx(P.postal_pattern(DEPARTMENTS), 'body')} AS postal_code,
    coalesce({rx(P.city_after_postal(DEPARTMENTS), 'body')}, {rx(P.CITY_AFTER_A, 'body')}) AS city,
    {class_sql(K.PROPERTY_WORDS, 'autre')} AS type, {FEATURES_SQL}, contains(t, 'copropriété') AS is_coownership, {_STATE} AS state,
    {rx(P.LOT_LOW)} AS lot, {amount_sql(rx(P.CHARGES_LOW))} AS charges, TRY_CAST({rx(P.SHARES_LOW)} AS INT) AS shares,
    trim({rx(P.TENANT_LOW)}) AS tenant, {amount_sql(rx(P.RENT_LOW))} AS rent,
    {amount_sql(rx(P.START_PRICE_LOW))} AS start_price, {amount_sql(rx(P.FEES_LOW))} AS fees, {amount_sql(rx(P.DEBT_LOW))} AS debt,
    {rx(P.CASE_NUMBER, 'body')} AS case_no, concat_ws(', ', {', '.join(_diag_sql(w) for w in K.DIAGNOSTICS)}) AS diagnostics
  FROM (SELECT *, {_CUT} AS s FROM n))
SELECT page_id, trim(concat_ws(' ', address, postal_code, city)) AS full_address, address, postal_code, city, type, surface_m2 AS surface, rooms, bedrooms, floor,
  is_coownership, CASE WHEN is_coownership THEN lot END AS lot, CASE WHEN is_coownership THEN charges END AS charges, CASE WHEN is_coownership THEN shares END AS shares,
  state AS status, CASE WHEN state = 'occupé' THEN tenant END AS tenant, CASE WHEN state = 'occupé' THEN rent END AS rent,
  start_price, fees, debt, sale_date AS sale, visits, court, agent_name AS agent, case_no, diagnostics
FROM f JOIN seen USING (page_id)""")
def report_summary(spark, sf_dir):
    """The nested summary of all report fields, laid flat."""
    s = R.report_fields(notices(spark, sf_dir)).select("page_id", R.report_summary().alias("s"))
    shown = F.transform("s.dates.visits", lambda v: F.date_format(v, "yyyy-MM-dd HH:mm"))
    return s.select(
        "page_id", F.col("s.address.full").alias("full_address"), "s.address.address", "s.address.postal_code", "s.address.city",
        "s.property.*", "s.coownership.*", "s.occupancy.*", "s.finance.*", "s.dates.sale", F.array_join(shown, ",").alias("visits"),
        "s.legal.*", F.array_join("s.diagnostics", ", ").alias("diagnostics"))


@query("merge_document_list", PAGES + """
SELECT page_id, CASE WHEN page_id % 10 = 9 THEN 1 ELSE 2 END AS n, CASE WHEN page_id % 10 = 9 THEN 'PV Descriptif' WHEN page_id % 2 = 0 THEN 'PV de description' ELSE 'Cahier des charges' END AS first_name FROM p""")
def merge_document_list(spark, sf_dir):
    d = built_pages(spark, sf_dir).withColumn("merged", FD.merge_document_list(FD.pdf_documents("html", "url"), F.lit("https://r.example/r.pdf")))
    return d.select("page_id", F.size("merged").alias("n"), F.col("merged")[0]["name"].alias("first_name"))


# --- keys and labels -----------------------------------------------------------------------

@query("cache_keys", T.cte("listings") + """
SELECT listing_key, md5(coalesce(postal_code, 'None') || '_' || property_type || '_' || CASE WHEN surface_m2 <> 0 THEN CAST(CAST(floor(surface_m2 / 20) * 20 AS BIGINT) AS VARCHAR) ELSE 'any' END) AS estimate_key,
  md5(lower(trim(agent_name)) || '_' || coalesce(lower(trim(city)), '')) AS agent_key FROM listings""")
def cache_keys(spark, sf_dir):
    return T.listings(spark, sf_dir).select("listing_key", KEY.estimate_cache_key().alias("estimate_key"), KEY.agent_cache_key("agent_name", "city").alias("agent_key"))


@query("page_cache_keys", "SELECT page_id, left(md5(url), 8) || '_' || left(md5(html), 8) AS page_key FROM pages")
def page_cache_keys(spark, sf_dir):
    return T.read(spark, sf_dir, "pages").select("page_id", KEY.page_cache_key().alias("page_key"))


@query("is_fresh", """
SELECT event_id, TIMESTAMP '2024-01-15 12:00:00' - ts < INTERVAL 24 HOUR AS fresh_day, TIMESTAMP '2024-01-31 12:00:00' - ts < INTERVAL 720 HOUR AS fresh_month FROM events""")
def is_fresh(spark, sf_dir):
    return T.read(spark, sf_dir, "events").select(
        "event_id", KEY.is_fresh("ts", "2024-01-15 12:00:00", 24).alias("fresh_day"), KEY.is_fresh("ts", "2024-01-31 12:00:00", 720).alias("fresh_month"))


@query("normalize_url", """
SELECT page_id, url, CASE WHEN x = '' THEN '' WHEN x LIKE 'http%' THEN x WHEN x LIKE '//%' THEN 'https:' || x WHEN x LIKE '/%' THEN regexp_extract(url, '^(https?://[^/?#]+)', 1) || x
  ELSE regexp_replace(regexp_replace(url, '[?#].*$', ''), '[^/]*$', '') || x END AS absolute,
  CASE WHEN x LIKE '%.png%' THEN '.png' ELSE '.jpg' END AS extension FROM (
  SELECT page_id, url, CASE page_id % 5 WHEN 0 THEN 'https://a.example/p.png?w=1' WHEN 1 THEN '//cdn.example/p.JPG' WHEN 2 THEN '/img/p.png#x' WHEN 3 THEN 'p/q' ELSE '' END AS x FROM pages)""")
def normalize_url(spark, sf_dir):
    x = F.expr("CASE page_id % 5 WHEN 0 THEN 'https://a.example/p.png?w=1' WHEN 1 THEN '//cdn.example/p.JPG' WHEN 2 THEN '/img/p.png#x' WHEN 3 THEN 'p/q' ELSE '' END")
    return T.read(spark, sf_dir, "pages").select("page_id", "url", KEY.normalize_url(x, "url").alias("absolute"), KEY.image_extension(x).alias("extension"))


@query("label_text", T.cte("listings") + """
SELECT listing_key, strftime(sale_date, '%d/%m/%Y') AS sold_on, CASE WHEN start_price IS NULL THEN '?' ELSE replace(format('{:,}', CAST(round_even(start_price, 0) AS BIGINT)), ',', ' ') || '€' END AS price_label FROM listings""")
def label_text(spark, sf_dir):
    return T.listings(spark, sf_dir).select(
        "listing_key", KEY.day_text("sale_date").alias("sold_on"),
        KEY.label(F.concat(KEY.thousands("start_price"), F.lit("€")), "?").alias("price_label"))
