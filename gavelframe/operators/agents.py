"""Agents' own notices, documents and sites matched to stored listings."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gavelframe.functions import constants as K
from gavelframe.functions.values import has_number, has_text, text_or_null
from gavelframe.operators.groups import spread, stored
from gavelframe.text import patterns as P


def _city_pairs(notices: DataFrame, listings: DataFrame) -> DataFrame:
    """Distinct (notice city, listing city) with one containing the other.

    Containment inside distinct names is found by joining every substring of the longer
    name that is as long as some name; only distinct city names are expanded.
    """
    def names(df, out):
        return df.filter(has_text("city")).select(F.lower("city").alias(out)).distinct()

    def parts(df, name):
        n = F.length(name)
        spans = F.flatten(F.transform(F.sequence(F.lit(1), n), lambda p: F.transform(
            F.sequence(F.lit(1), n - p + 1), lambda w: F.substring(F.col(name), p, w))))
        return df.withColumn("part", F.explode(F.array_distinct(spans)))

    a, b = names(notices, "notice_city"), names(listings, "listing_city")
    inside = parts(a, "notice_city").join(b, F.col("part") == F.col("listing_city"))
    around = parts(b, "listing_city").join(a, F.col("part") == F.col("notice_city"))
    both = ["notice_city", "listing_city"]
    return inside.select(*both).unionByName(around.select(*both)).distinct()


PRICE_SPREAD = 0.2
_PRICE_CELL = math.log((1 + PRICE_SPREAD / 2) / (1 - PRICE_SPREAD / 2)) / 8


def _price_cell(price: Column) -> Column:
    return F.floor(F.log(price) / F.lit(_PRICE_CELL)).cast("int")


def match_agent_listings(notices: DataFrame, listings: DataFrame, *, order: str = "listing_key") -> DataFrame:
    """First stored listing (by ``order``) of equal date, near place and price within 20 %.

    A missing date or price on either side matches any; place means equal postal code or
    one city name inside the other. Result: ``notice_id, listing_key``.

    Only the lowest listing counts, so listings are reduced to the lowest of each (place,
    date, price cell) and (place, date, price); a notice's price range covers some cells
    entirely and tests single prices in the two cells at its edges. A place and date that
    hold very many rows on both sides thus never pair them all.
    """
    pairs = _city_pairs(notices, listings)
    priced = F.when(has_number("start_price"), F.col("start_price"))

    # stored side: what a notice can ask for -> lowest listing
    cell = _price_cell(F.col("_price"))
    none = F.lit(None).cast("int")

    def grain(name, at, price=None):
        return F.struct(F.lit(name).alias("grain"), at.alias("cell"),
                        (F.col("_price") if price else F.lit(None).cast("double")).alias("l_price"))

    stored = listings.select(
        F.col(order).alias("_key"), priced.alias("_price"),
        F.explode(F.array(F.concat(F.lit("p:"), text_or_null("postal_code")),
                          F.concat(F.lit("c:"), F.lower(text_or_null("city"))))).alias("place"),
        F.coalesce(F.col("sale_date").cast("string"), F.lit("none")).alias("_day"),
    ).filter(F.col("place").isNotNull()).withColumn("day", F.explode(F.array("_day", F.lit("any"))))
    stored = stored.withColumn("at", F.explode(F.when(F.col("_price").isNull(), F.array(grain("any", none), grain("none", none))).otherwise(
        F.array(grain("any", none), grain("cell", cell), grain("price", cell, True))))).select("_key", "place", "day", "at.*")
    heads = stored.withColumn("cell", F.coalesce("cell", F.lit(0))).groupBy(
        "place", "day", "grain", "cell", "l_price").agg(F.min("_key").alias("_key"))

    # notices: the places, days and price cells they accept
    facts = ["n_postal", "n_city", "n_date", "n_price"]
    n = notices.select(
        "notice_id", text_or_null("postal_code").alias("n_postal"), F.lower(text_or_null("city")).alias("n_city"),
        F.col("sale_date").alias("n_date"), priced.alias("n_price"))
    # explicit width: every row is about to become dozens of probes
    asked = n.select(*facts).distinct().repartition(int(notices.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    by_postal = asked.filter(F.col("n_postal").isNotNull()).withColumn("place", F.concat(F.lit("p:"), F.col("n_postal")))
    by_city = asked.join(pairs, F.col("n_city") == F.col("notice_city")).withColumn(
        "place", F.concat(F.lit("c:"), F.col("listing_city"))).select(*by_postal.columns)
    days = F.when(F.col("n_date").isNull(), F.array(F.lit("any"))).otherwise(F.array(F.col("n_date").cast("string"), F.lit("none")))
    half = PRICE_SPREAD / 2
    first = _price_cell(F.col("n_price") * F.lit((1 - half) / (1 + half) * (1 - 1e-9)))
    last = _price_cell(F.col("n_price") * F.lit((1 + half) / (1 - half) * (1 + 1e-9)))

    def want(name, at):
        return F.struct(F.lit(name).alias("grain"), at.alias("cell"))

    zero = F.lit(0)
    # the two outer cells on each side are tested price by price
    cells = F.transform(F.sequence(first, last), lambda c: F.struct(
        F.when((c <= first + 1) | (c >= last - 1), F.lit("price")).otherwise(F.lit("cell")).alias("grain"), c.alias("cell")))
    wants = F.when(F.col("n_price").isNull(), F.array(want("any", zero))).otherwise(F.concat(F.array(want("none", zero)), cells))
    probes = (by_postal.unionByName(by_city).withColumn("day", F.explode(days)).withColumn("at", F.explode(wants))
              .select(*facts, "place", "day", "at.grain", "at.cell"))
    near = (F.abs(F.col("n_price") - F.col("l_price")) / ((F.col("n_price") + F.col("l_price")) / 2) <= PRICE_SPREAD)
    met = probes.join(heads, ["place", "day", "grain", "cell"]).filter((F.col("grain") != "price") | near)
    best = met.groupBy(*facts).agg(F.min("_key").alias("listing_key")).select(
        *[F.col(f).alias(f"b_{f}") for f in facts], "listing_key")
    return n.join(best, [n[f].eqNullSafe(F.col(f"b_{f}")) for f in facts]).select("notice_id", "listing_key")


def enrich_from_agent_listings(listings: DataFrame, notices: DataFrame, matches: DataFrame) -> DataFrame:
    """Listings with a missing report url filled and unseen documents appended, in notice order."""
    found = matches.join(notices.select("notice_id", F.col("report_url").alias("_report"), F.col("documents").alias("_docs")), "notice_id")
    reports = found.filter(has_text("_report")).groupBy("listing_key").agg(F.min_by("_report", "notice_id").alias("_report"))
    # distinct documents first, so a listing met by very many notices gathers only its own list
    place = F.struct("notice_id", "_pos")
    docs = (found.select("listing_key", "notice_id", F.posexplode("_docs").alias("_pos", "_doc"))
            .groupBy("listing_key", "_doc").agg(F.min(place).alias("_at"))
            .groupBy("listing_key").agg(F.array_sort(F.collect_list(F.struct("_at", "_doc"))).alias("_more")))
    own = F.coalesce("documents", F.array())
    more = F.coalesce(F.transform("_more", lambda x: x["_doc"]), F.array())
    return (listings.join(reports, "listing_key", "left").join(docs, "listing_key", "left")
            .withColumns({
                "report_added": ~has_text("report_url") & has_text("_report"),
                "report_url": F.coalesce(text_or_null("report_url"), F.col("_report")),
                "documents": F.concat(own, F.array_except(more, own))})
            .drop("_report", "_more"))


def agent_match_counters(notices: DataFrame, matches: DataFrame, enriched: DataFrame) -> DataFrame:
    """matched, report urls added, new notices."""
    none = F.lit(0).cast("long")
    placed = notices.join(matches, "notice_id", "left").agg(
        F.count("listing_key").alias("matched"), F.count_if(F.col("listing_key").isNull()).alias("new"), F.max(none).alias("report_added"))
    added = enriched.agg(F.max(none).alias("matched"), F.max(none).alias("new"),
                         F.count_if(F.coalesce("report_added", F.lit(False))).alias("report_added"))
    return placed.unionByName(added).agg(*[F.sum(c).alias(c) for c in ("matched", "new", "report_added")])


KEY_LETTERS = 5


def _asked_by_rarest(wants: DataFrame) -> DataFrame:
    """The distinct wants of each page with the word a document is looked up by, the other word and the lookup's first letters.

    Of a pair the word that fewer pairs of the page ask for, so that "rue" leads to few of them.
    """
    asked = wants.select("page_id", "kind", "first", "second").distinct()
    words = asked.withColumn("word", F.explode(F.array_distinct(F.array("first", "second")))).groupBy("page_id", "kind", "word").agg(
        F.count(F.lit(1)).alias("n"))
    counts = [words.select("page_id", "kind", F.col("word").alias(w), F.col("n").alias(f"n_{w}")) for w in ("first", "second")]
    both = asked.join(counts[0], ["page_id", "kind", "first"]).join(counts[1], ["page_id", "kind", "second"])
    rarer = (F.col("n_first") < F.col("n_second")) | (
        (F.col("n_first") == F.col("n_second")) & (F.length("first") > F.length("second")))
    return both.select("page_id", "kind", "first", "second", F.when(rarer, F.col("first")).otherwise(F.col("second")).alias("key"),
                       F.when(rarer, F.col("second")).otherwise(F.col("first")).alias("other")).withColumn(
        "piece", F.left("key", F.lit(KEY_LETTERS)))


def _lowest_holding(documents: DataFrame, asked: DataFrame) -> DataFrame:
    """(page_id, kind, first, second, pos): the first document of the page that holds each asked pair, or the date in its url.

    The pieces of a text, as long as some lookup, are met with the asked lookups; both words are then tested on the text
    itself. Nothing of a document but its lowest position is gathered, and that before the shuffle.
    """
    sizes = asked.agg(F.collect_set(F.length("piece")).alias("sizes"))  # one row of at most KEY_LETTERS numbers
    texts = spread(documents.select("page_id", "pos", F.lower(F.coalesce("title", F.lit(""))).alias("title"),
                                    F.lower(F.coalesce("url", F.lit(""))).alias("url")), "page_id", "pos")
    # a piece across title and url is refused by the test on the whole word
    starts = texts.withColumn("text", F.concat_ws("\n", "title", "url")).crossJoin(F.broadcast(sizes)).withColumn(
        "at", F.explode(F.sequence(F.lit(1), F.length("text"))))
    pieces = starts.withColumn("size", F.explode("sizes")).withColumn(
        "piece", F.substring(F.col("text"), F.col("at"), F.col("size"))).drop("text", "sizes", "at", "size")
    met = pieces.join(asked, ["page_id", "piece"])

    def held(word):
        return F.contains("url", word) | ((F.col("kind") == "word") & F.contains("title", word))

    return met.filter(held(F.col("key")) & held(F.col("other"))).groupBy("page_id", "kind", "first", "second").agg(F.min("pos").alias("pos"))


def match_documents(documents: DataFrame, targets: DataFrame) -> DataFrame:
    """First document of each target's firm page that holds two of its address words, or its date.

    ``documents``: page_id, pos, title, url; ``targets``: target_id, page_id, address, date_text.
    Words count once per occurrence in the address, as a word contained in title or url.

    Only the first document counts, so documents are reduced to the lowest position of each
    (page, word pair) and (page, date); a page with very many documents and targets never
    pairs them. What targets ask for is stored first, so its size is known: where it is small,
    documents meet it in one pass without a shuffle of their pieces.
    """
    words = F.filter(F.split(F.lower("address"), r"\s+"), lambda w: w != "")
    t = targets.select("target_id", "page_id", F.array_sort(words).alias("_words"), F.replace("date_text", F.lit("/"), F.lit("-")).alias("_date"))
    pair = F.transform(
        F.sequence(F.lit(1), F.size("_words") - 1),
        lambda i: F.transform(F.slice(F.col("_words"), i + 1, F.size("_words")), lambda b: F.struct(
            F.element_at("_words", i).alias("first"), b.alias("second"))))
    pairs = t.filter(F.size("_words") > 1).select(
        "target_id", "page_id", F.lit("word").alias("kind"), F.explode(F.array_distinct(F.flatten(pair))).alias("p")).select(
        "target_id", "page_id", "kind", "p.first", "p.second")
    dates = t.filter(has_text("_date")).select(
        "target_id", "page_id", F.lit("date").alias("kind"), F.col("_date").alias("first"), F.col("_date").alias("second"))
    wants = pairs.unionByName(dates)
    lowest = _lowest_holding(documents, stored(_asked_by_rarest(wants)))
    best = wants.join(lowest, ["page_id", "kind", "first", "second"]).groupBy("target_id", "page_id").agg(F.min("pos").alias("pos"))
    return best.join(documents.select("page_id", "pos", "url"), ["page_id", "pos"]).select("target_id", "pos", "url")


def catalog_site(catalog: list[dict], name="agent_name", firm="agent_firm") -> Column:
    """Auction page, else site, of the first catalog entry named in "name firm".

    The catalog is a short configured list (key, firm, agents, auction_page, site) and
    becomes one expression; no join.
    """
    text = F.lower(F.concat_ws(" ", F.coalesce(F.col(name), F.lit("")), F.coalesce(F.col(firm), F.lit(""))))
    known = F.length(F.trim(text)) > 0
    out = F.when(~known, F.lit(None).cast("string"))
    for entry in catalog:
        words = [entry["key"], (entry.get("firm") or "").lower(), *[a.lower() for a in entry.get("agents", [])]]
        hit = F.lit(False)
        for w in words:
            if w:
                hit = hit | F.contains(text, F.lit(w))
        out = out.when(hit, F.lit(entry.get("auction_page") or entry.get("site")))
    return out


def is_agent_site(url="url", name="agent_name") -> Column:
    """Plausible site of a law firm: no social network; a directory, firm word or the agent's name in the url."""
    u = F.lower(F.col(url))

    def holds(words):
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(u, F.lit(w))
        return hit

    parts = F.filter(F.regexp_extract_all(F.lower(F.col(name)), F.lit("([a-zà-ü]+)"), F.lit(1)), lambda p: F.length(p) > 3)
    named = F.exists(parts, lambda p: F.contains(u, p))
    return ~holds(K.SOCIAL_DOMAINS) & (holds(K.AGENT_DIRECTORIES) | holds(K.AGENT_URL_WORDS) | F.coalesce(named, F.lit(False)))


def rank_agent_sites(candidates: DataFrame, first: int | None = None) -> DataFrame:
    """First plausible link (redirects unwrapped) of each search, or among its ``first`` results: ``agent_name, city -> site``."""
    asked = F.lit(True) if first is None else F.col("pos") < first
    inner = F.regexp_extract("url", P.REDIRECT, 1)
    candidates = candidates.withColumn("url", F.when(has_text("url") & ~F.col("url").contains("ad_domain") & (inner != ""),
                                                     F.try_url_decode(inner)).otherwise(F.col("url")))
    ok = candidates.filter(asked & has_text("url") & ~F.col("url").contains("ad_domain") & is_agent_site())
    return ok.groupBy("agent_name", "city").agg(F.min_by("url", "pos").alias("site"))


def fill_agent_sites(listings: DataFrame, sites: DataFrame) -> DataFrame:
    s = sites.select(F.col("agent_name").alias("_name"), F.coalesce("city", F.lit("")).alias("_city"), F.col("site").alias("_site"))
    same = (F.col("agent_name") == F.col("_name")) & (F.coalesce("city", F.lit("")) == F.col("_city"))
    return listings.join(s, same, "left").withColumn(
        "agent_site", F.coalesce(text_or_null("agent_site"), F.col("_site"))).drop("_name", "_city", "_site")
