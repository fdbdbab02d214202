"""Notice text to typed columns, all native Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gavelframe.functions import constants as K
from gavelframe.functions.keys import normalize_url, title_case
from gavelframe.functions.values import all_matches, col, contains_any, lookup, matched, number_or_null, plain_spaces, text_or_null
from gavelframe.text import patterns as P


def low(text) -> Column:
    return F.lower(plain_spaces(text))


def first_of(patterns, text, parse=None) -> Column:
    """Result of the first pattern whose capture parses."""
    hits = [matched(p, text) for p in patterns]
    return F.coalesce(*[parse(h) if parse else h for h in hits])


def decimal(c) -> Column:
    return F.replace(col(c), F.lit(","), F.lit(".")).try_cast("double")


def amount(c) -> Column:
    """Number of a French price text; of several separators only the last is a decimal point."""
    digits = F.translate(F.regexp_replace(col(c), r"[^\d,.]", ""), ",", ".")
    whole = F.replace(F.regexp_replace(digits, r"\.[^.]*$", ""), F.lit("."), F.lit(""))
    tail = F.regexp_extract(digits, r"(\.[^.]*)$", 1)
    several = F.length(digits) - F.length(F.replace(digits, F.lit("."), F.lit(""))) > 1
    return F.when(several, F.concat(whole, tail)).otherwise(digits).try_cast("double")


def price(text) -> Column:
    """Start price: after "mise à prix", else after "prix", else any amount in euros."""
    return first_of(P.PRICES_LOW, low(text), lambda h: number_or_null(amount(h)))


def french_date(text) -> Column:
    """``15/01/2024`` or ``15 janvier 2024``; a day that does not exist is NULL."""
    t = F.lower(col(text))

    def made(pattern, month):
        day, year = (F.regexp_extract(t, pattern, i) for i in (1, 3))
        return F.try_to_date(F.concat_ws("-", year, month, day), "yyyy-M-d")

    words = lookup(F.regexp_extract(t, P.DATE_WORDS_LOW, 2), {k: str(v) for k, v in K.MONTHS.items()}, "")
    return F.coalesce(made(P.DATE_SLASH, F.regexp_extract(t, P.DATE_SLASH, 2)), made(P.DATE_WORDS_LOW, words))


def sale_date(text) -> Column:
    return first_of(P.SALE_DATES_LOW, low(text), french_date)


def sale_time(text) -> Column:
    hour, minute = matched(P.SALE_TIME, text, 1), matched(P.SALE_TIME, text, 2)
    return F.concat(hour, F.lit("h"), F.coalesce(minute, F.lit("00")))


def _at(day: Column, hour: Column) -> Column:
    h = F.coalesce(text_or_null(hour).try_cast("int"), F.lit(14))
    return F.timestamp_add("HOUR", h, day.cast("timestamp"))


def visits(text) -> Column:
    """Planned visits as timestamps, at 14 h unless an hour is given; no repeats."""
    t = low(text)
    found = []
    for pattern in P.VISITS_LOW:
        pairs = F.arrays_zip(all_matches(pattern, t, 1).alias("d"), all_matches(pattern, t, 2).alias("h"))
        found.append(F.transform(pairs, lambda p: _at(french_date(p["d"]), p["h"])))
    days = all_matches(P.VISIT_SECTION_DATE, F.regexp_extract(t, P.VISIT_SECTION_LOW, 1), 1)
    found.append(F.transform(days, lambda d: _at(french_date(d), F.lit(""))))
    out = F.array().cast("array<timestamp>")
    for stamps in reversed(found):
        real = F.array_distinct(F.array_compact(stamps))
        out = F.when(F.size(real) > 0, real).otherwise(out)
    return out


def surface(text) -> Column:
    return first_of(P.SURFACES_LOW, low(text), decimal)


def whole_number(pattern: str, text) -> Column:
    return matched(pattern, low(text)).try_cast("int")


def rooms(text) -> Column:
    return whole_number(P.ROOMS_LOW, text)


def bedrooms(text) -> Column:
    return whole_number(P.BEDROOMS_LOW, text)


def floor(text) -> Column:
    return whole_number(P.FLOOR_LOW, text)


def property_class(text, families: dict | None = None, otherwise: str = "autre") -> Column:
    """First family one of whose words occurs."""
    t, out = low(text), None
    for name, words in (families or K.PROPERTY_WORDS).items():
        hit = contains_any(t, words)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(otherwise)


def property_section(text) -> Column:
    """Text before the agent's section, which starts at the first listed marker found."""
    t, out = col(text), None
    for marker in P.AGENT_MARKERS:
        cut = F.substring_index(t, marker, 1)
        out = F.when(t.contains(marker), cut) if out is None else out.when(t.contains(marker), cut)
    return out.otherwise(t)


def address(text) -> Column:
    """Street address of the property: not the agent's, no phone, day, month or time in it.

    Without a street, the place named in the sentence that describes the property.
    """
    section = property_section(text)

    def valid(hit):
        clean = F.trim(F.regexp_replace(hit, r"\s+", " "))
        return F.when(~F.lower(clean).rlike(P.NOT_ADDRESS_LOW) & (F.length(clean) > 10), clean)

    place = F.trim(matched(P.PLACE_IN_SENTENCE, section))
    return F.coalesce(first_of(P.ADDRESSES, section, valid), F.when(~place.rlike(P.NOT_PLACE), place))


def postal_code(text, url=None, departments=K.TARGET_DEPARTMENTS) -> Column:
    """Code in the text, else the url's department followed by 000."""
    own = matched(P.postal_pattern(departments), text)
    if url is None:
        return own
    return F.coalesce(own, F.concat(matched(P.URL_CITY, url, 2), F.lit("000")))


def city(text, url=None, departments=K.TARGET_DEPARTMENTS) -> Column:
    """City after the postal code, else after "à", else from the url."""
    own = F.coalesce(matched(P.city_after_postal(departments), text), matched(P.CITY_AFTER_A, text))
    if url is None:
        return own
    return F.coalesce(own, title_case(F.replace(matched(P.URL_CITY, url, 1), F.lit("-"), F.lit(" "))))


def known_city_in(text, cities) -> Column:
    """First listed city that the text names as a word (a fixed short list)."""
    t = low(text)
    return F.coalesce(*[F.when(t.rlike(P.named_city(c)), F.lit(c)) for c in cities])


def url_region_city(url, cities: dict) -> dict[str, Column]:
    """City and code of a url that names its southern region or a district; only listed cities and Marseille count."""
    by_region = matched(P.URL_REGION_CITY, url, 1)
    slug = F.lower(F.coalesce(by_region, matched(P.URL_DISTRICT_CITY, url, 1)))
    number = F.when(by_region.isNotNull(), matched(P.URL_REGION_CITY, url, 2)).otherwise(matched(P.URL_DISTRICT_CITY, url, 2))
    name = F.replace(slug, F.lit("-"), F.lit(" "))
    code = F.coalesce(lookup(name, cities), lookup(F.replace(name, F.lit(" "), F.lit("-")), cities))
    other = code.isNull() & name.contains("marseille")
    return {
        "postal_code": F.when(other, F.concat(F.lit("130"), F.lpad(number, 2, "0"))).otherwise(code),
        "city": F.when(other, F.concat(F.lit("Marseille"), F.coalesce(F.concat(F.lit(" "), number, F.lit("ème")), F.lit(""))))
                 .when(code.isNotNull(), title_case(name)),
    }


def location(text, url=None, departments=K.TARGET_DEPARTMENTS, cities: dict | None = None) -> dict[str, Column]:
    """City and postal code of the property, from the text before the agent's section.

    A listed city in a url of its region goes before the text's. A city of the given dictionary fills what text and url leave
    open. A numbered district replaces
    the city, and its code a missing or whole-city one. Several words of a city end with their line.
    """
    cities = K.SOUTHERN_CITIES if cities is None else cities
    section = property_section(text)
    code, place = postal_code(section, url, departments), city(section, url, departments)
    named = known_city_in(section, cities) if cities else F.lit(None).cast("string")
    taken = F.when(place.isNull(), named)
    place = F.coalesce(place, title_case(F.replace(taken, F.lit("-"), F.lit(" "))))
    code = F.coalesce(code, lookup(taken, cities)) if cities else code
    if url is not None and cities:
        of_url = url_region_city(url, cities)
        code, place = F.coalesce(of_url["postal_code"], code), F.coalesce(of_url["city"], place)
    number = matched(P.DISTRICT_LOW, low(section))
    district = F.when(F.lower(place).contains("marseille") & (F.length(number) <= 2), number)
    whole = code.isNull() | (code == "13000")
    return {
        "postal_code": F.when(district.isNotNull() & whole, F.concat(F.lit("13"), F.lpad(district, 3, "0"))).otherwise(code),
        "city": F.when(district.isNotNull(), F.concat(F.lit("Marseille "), district, F.lit("ème"))).otherwise(place),
    }


def agent_name(text) -> Column:
    return first_of(P.AGENT_NAMES, text, F.trim)


def agent_phone(text) -> Column:
    return F.trim(first_of(P.PHONES, text, lambda h: text_or_null(F.trim(h))))


def agent_email(text, html=None) -> Column:
    """Address of the page's first mail link, else the first in the text."""
    own = matched(P.EMAIL, text)
    return own if html is None else F.coalesce(matched(P.MAILTO, html), own)


def agent_address(text) -> Column:
    """Street, postal code and city named after the property's own section."""
    return F.trim(matched(P.AGENT_ADDRESS, F.substr(col(text), F.length(property_section(text)) + 1)))


def agent_site(html) -> Column:
    return first_of(P.AGENT_SITES, html)


def agent_firm(text) -> Column:
    return F.trim(matched(P.FIRM, text))


def court(text, courts: dict | None = None) -> Column:
    """First known court named, else the one spelled out in the text."""
    t, known = low(text), None
    for slug, name in (courts or K.COURTS).items():
        hit = t.contains(name.lower()) | t.contains(slug.replace("-", " "))
        known = F.when(hit, name) if known is None else known.when(hit, name)
    spelled = F.concat(F.lit("Tribunal Judiciaire de "), title_case(matched(P.COURT_LOW, t)))
    return F.coalesce(known, spelled)


def occupancy(text, html=None) -> Column:
    """Free or occupied, by the first pattern that occurs in the text, else as the page's scripts say."""
    t, out = low(text), None
    for pattern, value in P.OCCUPANCY_LOW:
        hit = t.rlike(pattern)
        if value is None:
            said = F.trim(F.regexp_extract(t, pattern, 1))
            value = F.concat(F.upper(F.left(said, F.lit(1))), F.substr(said, F.lit(2)))
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out if html is None else F.coalesce(out, matched(P.OCCUPANCY_JSON, html))


def occupancy_state(text) -> Column:
    t = low(text)
    free = t.contains("libre") & t.contains("occupation")
    return F.when(free, "libre").when(contains_any(t, K.OCCUPIED_WORDS), "occupé")


def tenant(text) -> Column:
    return F.when(occupancy_state(text) == "occupé", F.trim(matched(P.TENANT_LOW, low(text))))


def rent(text) -> Column:
    return F.when(occupancy_state(text) == "occupé", amount(matched(P.RENT_LOW, low(text))))


def parcel(text) -> Column:
    section, number = matched(P.PARCEL_SECTION, text, 1), matched(P.PARCEL_SECTION, text, 2)
    return F.coalesce(F.concat(F.lit("Section "), section, F.lit(" n°"), number), first_of(P.PARCELS, text, F.trim))


def coownership(text) -> dict[str, Column]:
    """Co-ownership flag, lot, yearly charges, shares; the rest only under the flag."""
    t = low(text)
    flag = t.contains("copropriété")
    return {
        "is_coownership": flag,
        "lot": F.when(flag, matched(P.LOT_LOW, t)),
        "charges": F.when(flag, amount(matched(P.CHARGES_LOW, t))),
        "shares": F.when(flag, matched(P.SHARES_LOW, t).try_cast("int")),
    }


def finance(text) -> dict[str, Column]:
    t = low(text)
    return {
        "start_price": amount(matched(P.START_PRICE_LOW, t)),
        "fees": amount(matched(P.FEES_LOW, t)),
        "debt": amount(matched(P.DEBT_LOW, t)),
        "case_no": matched(P.CASE_NUMBER, text),
    }


def description(text, chars: int | None = None) -> Column:
    """The description, whole or its first ``chars`` characters (500 on list pages, 2000 on detail pages)."""
    whole = first_of(P.DESCRIPTIONS, text)
    return F.trim(whole if chars is None else F.left(whole, F.lit(chars)))


def diagnostics(text) -> Column:
    """Named diagnostics, with the grade or word that follows."""
    t = col(text)
    out = []
    for word in K.DIAGNOSTICS:
        grade = matched(diagnostic_pattern(word), t)
        shown = F.when(grade.isNotNull(), F.concat(F.lit(f"{word}: "), grade)).otherwise(F.lit(word))
        out.append(F.when(F.lower(t).contains(word.lower()), shown))
    return F.array_compact(F.array(*out))


def diagnostic_pattern(word: str) -> str:
    return rf"(?i){word}\s*:?\s*([A-Ga-g]|\w+)"


def source_id(url="url", source="source", table: dict | None = None) -> Column:
    """Notice number in the url, by the source's own pattern."""
    out = None
    for name, pattern in (table or P.SOURCE_IDS).items():
        hit = matched(pattern, url, 1)
        if pattern.count("(\\d+)") > 1:
            hit = F.coalesce(hit, matched(pattern, url, 2))
        out = F.when(col(source) == name, hit) if out is None else out.when(col(source) == name, hit)
    return out


def site_of(url="url", hosts: dict | None = None) -> Column:
    host = F.regexp_extract(col(url), r"^https?://([^/?#]+)", 1)
    out = None
    for word, name in (hosts or {"site-a": "site_a", "site-b": "site_b", "site-c": "site_c"}).items():
        out = F.when(host.contains(word), name) if out is None else out.when(host.contains(word), name)
    return out


def document_type(name, url, types: dict | None = None) -> Column:
    n, u, out = F.lower(col(name)), F.lower(col(url)), None
    for word, label in (types or K.DOCUMENT_TYPES).items():
        hit = n.contains(word) | u.contains(word)
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out.otherwise(K.DEFAULT_DOCUMENT_TYPE)


def firm_document_class(title, url) -> Column:
    t, u = F.lower(col(title)), F.lower(col(url))
    return (F.when(t.contains("cahier") | u.contains("cahier") | t.contains("charges"), "cahier_charges")
             .when(t.contains("pv") | t.contains("proces") | t.contains("verbal"), "proces_verbal")
             .when(t.contains("photo") | u.contains("image"), "photos").otherwise("document"))


def links(html) -> Column:
    """(url, title) of every simple anchor, in page order."""
    return F.arrays_zip(all_matches(P.LINK_HREF, html).alias("url"), all_matches(P.LINK_TEXT, html).alias("title"))


def pdf_documents(html, base=None) -> Column:
    """Documents of a page: embedded JSON file entries, else PDF anchors; typed, no repeats."""
    h = col(html)
    origin = F.regexp_extract(col(base), r"^(https?://[^/?#]+)", 1) if base is not None else F.lit("")
    files = F.arrays_zip(all_matches(P.JSON_FILE, h).alias("f"), all_matches(P.JSON_FILE_NAME, h).alias("n"))
    embedded = F.transform(files, lambda x: F.struct(
        x["n"].alias("name"), F.concat(origin, F.lit("/static/lot/document/"), x["f"]).alias("url"), x["n"].alias("type")))
    anchors = F.filter(links(h), lambda a: F.lower(a["url"]).contains(".pdf"))

    def entry(a):
        kind = document_type(a["title"], a["url"])
        return F.struct(F.coalesce(text_or_null(F.trim(a["title"])), kind).alias("name"),
                        normalize_url(a["url"], base).alias("url"), kind.alias("type"))

    return F.array_distinct(F.when(F.size(embedded) > 0, embedded).otherwise(F.transform(anchors, entry)))


def report_of(documents="documents") -> Column:
    """Url of the first document that names a report."""
    hits = F.filter(col(documents), lambda d: F.lower(d["name"]).contains("pv") | F.lower(d["name"]).contains("procès"))
    return F.try_element_at(hits, F.lit(1))["url"]


def report_status(documents="documents", report_url="report_url", current=None) -> Column:
    """To be downloaded where a report is linked, to be asked for where a page has no document at all."""
    known = F.lit(None).cast("string") if current is None else col(current)
    return (F.when(text_or_null(report_url).isNotNull(), "a_telecharger")
             .when(F.coalesce(F.size(col(documents)), F.lit(0)) <= 0, "a_demander").otherwise(known))


def photos(html, base=None, cap: int | None = None) -> Column:
    """Photo urls, no repeats: of each image the last of its set and its own or lazy source (resizer urls
    unwrapped), files and street views named in scripts, lists kept in attributes."""
    h = col(html)
    origin = F.regexp_extract(col(base), r"^(https?://[^/?#]+)", 1) if base is not None else F.lit("")

    def shown(src):
        inner = F.regexp_extract(src, P.NEXT_IMAGE, 1)
        unwrapped = F.when(src.contains("/_next/image") & (inner != ""), F.url_decode(inner)).otherwise(src)
        return normalize_url(unwrapped, base)

    def sources(tag):
        last = F.element_at(F.split(F.trim(F.element_at(F.split(F.regexp_extract(tag, P.IMAGE_SET, 1), r",\s+"), -1)), " "), 1)
        return F.array(text_or_null(last), F.coalesce(*[text_or_null(F.regexp_extract(tag, p, 1)) for p in P.IMAGE_SOURCES]))

    listed = F.flatten(F.transform(all_matches(P.PHOTO_LIST, h), lambda j: F.coalesce(
        F.from_json(j, "array<string>"), F.array().cast("array<string>"))))
    listed = F.transform(listed, lambda x: F.when(x.startswith("{"), F.coalesce(
        F.get_json_object(x, "$.url"), F.get_json_object(x, "$.src"))).otherwise(x))
    tags = F.array_compact(F.flatten(F.transform(all_matches(P.IMAGE_TAG, h), sources)))
    images = F.transform(F.filter(tags, lambda s: ~F.lower(s).contains("placeholder")), shown)
    static = F.transform(all_matches(P.STATIC_PHOTO, h), lambda p: F.concat(origin, p))
    street = F.transform(all_matches(P.STREET_VIEW, h), lambda p: F.concat(origin, F.lit(P.STREET_VIEW_PATH), p))
    kept = F.transform(F.filter(listed, lambda x: x != ""), lambda x: normalize_url(x, base))
    found = F.array_distinct(F.concat(images, static, street, kept))
    return found if cap is None else F.slice(found, 1, cap)


def merge_document_list(documents, report_url, cap: int | None = None) -> Column:
    """Documents with the report put first unless one already names it."""
    docs = F.coalesce(col(documents), F.array())
    named = F.exists(docs, lambda d: F.lower(F.coalesce(d["url"], F.lit(""))).contains("pv")
                     | F.lower(F.coalesce(d["name"], F.lit(""))).contains("pv"))
    report = F.struct(F.lit("PV Descriptif").alias("name"), col(report_url).alias("url"),
                      F.lit("Procès-verbal de description").alias("type"))
    ahead = F.when(text_or_null(report_url).isNotNull() & ~named, F.concat(F.array(report), docs)).otherwise(docs)
    return ahead if cap is None else F.slice(ahead, 1, cap)
