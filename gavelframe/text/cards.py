"""Listings and sold lots embedded in pages: JSON in scripts, ad feeds, cards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gavelframe.functions import constants as K
from gavelframe.functions.keys import normalize_url
from gavelframe.functions.values import all_matches, col, matched, number_or_null, plain_spaces, text_or_null
from gavelframe.text import fields as T
from gavelframe.text import patterns as P

_ITEM = ("struct<`@type`:string,name:string,description:string,url:string,"
         "offers:struct<price:string>,floorSize:struct<value:string>>")
ITEM_LIST = f"struct<`@type`:string,itemListElement:array<struct<item:{_ITEM}>>>"
PRODUCTS = f"array<{_ITEM}>"
NEXT_CARDS = ("struct<props:struct<pageProps:struct<cards:array<struct<price:string,livingArea:string,surface:string,"
              "title:string,url:string,city:string>>>>>")
AD_FEED = ("struct<ads:array<struct<subject:string,list_id:string,price:array<double>,location:struct<city:string>,"
           "attributes:array<struct<key:string,value:string>>>>>")
ESTATE_FEED = "struct<realEstateAds:array<struct<id:string,title:string,city:string,price:double,surfaceArea:double>>>"
_AD = "array<struct<title:string,price:double,surface_m2:double,url:string,city:string>>"

ARTICLE = r"(?s)<article[^>]*>(.*?)</article>"
TAG = r"<[^>]*>"


def _number(c: Column) -> Column:
    return F.regexp_replace(plain_spaces(c), r"\s", "").try_cast("double")


def _area_in(text: Column) -> Column:
    return T.decimal(matched(P.AREA_IN_TEXT, text))


def _ad(title, price, surface, url, city) -> Column:
    return F.struct(title.alias("title"), price.alias("price"), surface.alias("surface_m2"), url.alias("url"), city.alias("city"))


def _complete(ads: Column) -> Column:
    return F.filter(ads, lambda a: number_or_null(a["price"]).isNotNull() & number_or_null(a["surface_m2"]).isNotNull())


def _none() -> Column:
    return F.lit(None).cast("string")


def next_data_ads(html) -> Column:
    """Cards of the page-props script."""
    docs = F.transform(all_matches(P.NEXT_DATA, html), lambda s: F.from_json(s, NEXT_CARDS))
    cards = F.flatten(F.transform(docs, lambda d: F.coalesce(d["props"]["pageProps"]["cards"], F.array())))
    return _complete(F.transform(cards, lambda c: _ad(
        c["title"], _number(c["price"]),
        F.coalesce(number_or_null(_number(c["livingArea"])), _number(c["surface"])), c["url"], c["city"])))


def _residence(i: Column) -> Column:
    about = F.concat(F.coalesce(i["name"], F.lit("")), F.lit(" "), F.coalesce(i["description"], F.lit("")))
    return _ad(i["name"], _number(i["offers"]["price"]),
               F.coalesce(_number(i["floorSize"]["value"]), _area_in(about)), i["url"], _none())


def json_ld_ads(html) -> Column:
    """Item lists and product arrays of the linked-data scripts; a surface may sit in the wording."""
    scripts = all_matches(P.JSON_LD, html)
    lists = F.filter(F.transform(scripts, lambda s: F.from_json(s, ITEM_LIST)), lambda d: d["@type"] == "ItemList")
    items = F.flatten(F.transform(lists, lambda d: F.transform(F.coalesce(d["itemListElement"], F.array()), lambda e: e["item"])))
    arrays = F.filter(scripts, lambda s: F.trim(s).startswith("["))
    products = F.filter(
        F.flatten(F.transform(arrays, lambda s: F.coalesce(F.from_json(s, PRODUCTS), F.array()))),
        lambda i: i["@type"].isin("Product", "Residence", "Apartment", "House"))
    return _complete(F.transform(F.concat(items, products), _residence))


def card_text_ads(html) -> Column:
    """Price and surface read from the text of each article."""
    def read(card):
        text = plain_spaces(F.regexp_replace(card, TAG, " "))
        return _ad(text_or_null(F.trim(F.regexp_replace(text, r"\s+", " "))), _number(matched(P.CARD_PRICE, text)), _area_in(text),
                   matched(P.LINK, card), _none())
    return _complete(F.transform(all_matches(ARTICLE, html), read))


def embedded_ads(pages: DataFrame, cap: int | None = None) -> DataFrame:
    """One row per ad of a page: page-props cards, else linked data, else card texts."""
    html = F.col("html")
    nexts, linked, cards = (c.cast(_AD) for c in (next_data_ads(html), json_ld_ads(html), card_text_ads(html)))
    ads = F.when(F.size(nexts) > 0, nexts).when(F.size(linked) > 0, linked).otherwise(cards)
    if cap:
        ads = F.slice(ads, 1, cap)
    return pages.select("page_id", F.posexplode(ads).alias("pos", "ad")).select("page_id", "pos", "ad.*")


def feed_ads(feeds: DataFrame, base: str = "") -> DataFrame:
    """Ads of stored JSON feeds (``feed_id, json``), either of the two known shapes."""
    ads = F.coalesce(F.from_json("json", AD_FEED)["ads"], F.array())
    square = lambda a: F.try_element_at(F.filter(a["attributes"], lambda x: x["key"] == "square"), F.lit(1))["value"]
    first = F.transform(ads, lambda a: _ad(
        a["subject"], F.try_element_at(a["price"], F.lit(1)), square(a).try_cast("double"),
        F.concat(F.lit(base), a["list_id"]), a["location"]["city"]))
    estates = F.coalesce(F.from_json("json", ESTATE_FEED)["realEstateAds"], F.array())
    second = F.transform(estates, lambda a: _ad(a["title"], a["price"], a["surfaceArea"], F.concat(F.lit(base), a["id"]), a["city"]))
    both = _complete(F.concat(first.cast(_AD), second.cast(_AD)))
    return feeds.select("feed_id", F.posexplode(both).alias("pos", "ad")).select("feed_id", "pos", "ad.*")


def sold_lots(cards: DataFrame, *, departments=("13", "83"), min_surface: float = 15.0, source: str = "site_a") -> DataFrame:
    """Sold cards (``card_id, text``) to adjudication rows; unknown results and parking are left out."""
    text = plain_spaces("text")
    t = F.lower(text)
    district = matched(P.DISTRICT_LOW, t)
    postal = F.coalesce(F.concat(F.lit("130"), F.lpad(district, 2, "0")), matched(P.postal_pattern(departments), text))
    rows = cards.filter(F.contains(F.lower("text"), F.lit("adjugé")) & ~t.contains("inconnue")).select(
        "card_id", F.lit(source).alias("source"), postal.alias("postal_code"),
        _number(matched(P.SOLD_PRICE_LOW, t)).alias("hammer_price"),
        T.decimal(matched(P.CARD_SURFACE_LOW, t)).alias("_area"),
        T.property_class(text, K.SOLD_CARD_WORDS, "Autre").alias("property_type"))
    return rows.filter(
        F.col("postal_code").isNotNull() & F.col("hammer_price").isNotNull() & (F.col("property_type") != "Parking")
    ).withColumn("surface_m2", F.when(F.col("_area") >= min_surface, F.col("_area"))).drop("_area")


def notice_cards(pages: DataFrame, *, departments=K.TARGET_DEPARTMENTS) -> DataFrame:
    """Summary cards of list pages: url, title, location, price, date."""
    cards = pages.select("page_id", F.col("url").alias("page_url"), F.posexplode(all_matches(ARTICLE, "html")).alias("pos", "card"))
    text = F.trim(F.regexp_replace(plain_spaces(F.regexp_replace("card", TAG, " ")), r"\s+", " "))
    out = cards.select(
        "page_id", "pos", normalize_url(matched(P.LINK, F.col("card")), F.col("page_url")).alias("url"),
        F.trim(matched(P.LINK_TEXT, F.col("card"))).alias("title"),
        matched(P.postal_pattern(departments), text).alias("postal_code"),
        _number(matched(P.CARD_PRICE, text)).alias("start_price"),
        T.french_date(matched(r"(\d{1,2}/\d{1,2}/\d{4})", text)).alias("sale_date"),
        matched(r"""(?s)<[^>]*class=["'][^"']*(?:statut|status|badge)[^"']*["'][^>]*>([^<]*)<""", F.col("card")).alias("status"))
    return out.filter(F.col("url") != "")


def page_links(pages: DataFrame, wanted: Column | None = None) -> DataFrame:
    """Absolute links of stored pages, first occurrence each, optionally only ``wanted`` ones."""
    links = pages.select("page_id", F.col("url").alias("page_url"), F.posexplode(all_matches(P.LINK, "html")).alias("pos", "href"))
    links = links.withColumn("url", normalize_url("href", "page_url"))
    if wanted is not None:
        links = links.filter(wanted)
    return links.groupBy("page_id", "url").agg(F.min("pos").alias("pos"))


def is_property_link(url="url") -> Column:
    return col(url).rlike(P.PROPERTY_LINK)


def is_auction_link(url="url") -> Column:
    u = F.lower(col(url))
    return u.contains(".pdf") | u.contains("cahier") | u.contains("vente") | u.contains("/enchere/")
