"""Normalised texts, keys and dates that join tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gavelframe.functions.values import as_date, col, has_number, has_text, matched, text_or_null

# fixed values: accented letters and what they read as; hyphen and apostrophe separate words
_ACCENTED = "éèêëàâäùûüôöîïç-'"
_PLAIN = "eeeeaaauuuooiic  "


def normalize_text(text) -> Column:
    """Lower case, trimmed, single spaces, no French accents, no hyphens or apostrophes."""
    low = F.regexp_replace(F.lower(col(text)), r"^\s+|\s+$", "")
    flat = F.translate(F.regexp_replace(low, r"\s+", " "), _ACCENTED, _PLAIN)
    return F.coalesce(flat, F.lit(""))


def title_case(text) -> Column:
    """Capital after every space and hyphen, as ``Boulogne-Billancourt``."""
    spaced = F.initcap(col(text))
    parts = F.split(spaced, "-")
    return F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.left(p, F.lit(1))), F.substr(p, F.lit(2)))), "-")


def department_of(postal) -> Column:
    return F.left(col(postal), F.lit(2))


def district_postal(city, big_city: str = "marseille", prefix: str = "130") -> Column:
    """Postal code of a numbered district: ``Marseille 14ème`` -> ``13014``."""
    number = matched(rf"^{big_city}\s*(\d+)", normalize_text(city))
    return F.concat(F.lit(prefix), F.when(F.length(number) >= 2, number).otherwise(F.lpad(number, 2, "0")))


def surface_band(surface="surface_m2", width: int = 20) -> Column:
    band = (F.floor(col(surface) / width) * width).cast("long").cast("string")
    return F.when(has_number(surface), band).otherwise(F.lit("any"))


def estimate_cache_key(postal="postal_code", property_type="property_type", surface="surface_m2") -> Column:
    return F.md5(F.concat_ws("_", F.coalesce(col(postal), F.lit("None")), col(property_type), surface_band(surface)))


def agent_cache_key(name="name", city="city") -> Column:
    def part(c):
        return F.regexp_replace(F.lower(F.coalesce(col(c), F.lit(""))), r"^\s+|\s+$", "")
    return F.md5(F.concat(part(name), F.lit("_"), part(city)))


def page_cache_key(url="url", content="html") -> Column:
    """First 8 hex digits each of the url's and the content's hash."""
    return F.concat(F.left(F.md5(col(url)), F.lit(8)), F.lit("_"), F.left(F.md5(col(content)), F.lit(8)))


def is_fresh(cached_at, now, hours: int = 24) -> Column:
    """Cached less than ``hours`` before ``now``; an unknown time is stale."""
    now = now if isinstance(now, Column) else F.lit(now).cast("timestamp")
    age = F.unix_micros(now) - F.unix_micros(col(cached_at).cast("timestamp"))
    return F.coalesce(age < hours * 3_600_000_000, F.lit(False))


def normalize_url(url, base=None) -> Column:
    """Absolute form of a link: kept, given a scheme, or joined to the page's url."""
    u = F.coalesce(col(url), F.lit(""))
    if base is None:
        relative = u
    else:
        b = col(base)
        origin = F.regexp_extract(b, r"^(https?://[^/?#]+)", 1)
        bare = F.regexp_replace(b, r"[?#].*$", "")
        folder = F.when(bare.rlike(r"^https?://[^/]+$"), F.concat(bare, F.lit("/"))).otherwise(
            F.regexp_replace(bare, r"[^/]*$", ""))
        relative = (
            F.when(~has_text(b), u)
            .when(u.startswith("/"), F.concat(origin, u))
            .when(u.startswith("#"), F.concat(F.regexp_replace(b, "#.*$", ""), u))
            .when(u.startswith("?"), F.concat(bare, u))
            .otherwise(F.concat(folder, u))
        )
    return (F.when(u == "", "").when(u.rlike("^https?://"), u)
             .when(u.startswith("//"), F.concat(F.lit("https:"), u)).otherwise(relative))


def image_extension(url, mime=None, extensions=None, mime_map=None) -> Column:
    """Extension by the url's path, else by MIME type, else ``.jpg``."""
    from gavelframe.functions import constants as K
    path = F.lower(F.regexp_replace(col(url), r"[?#].*$", ""))
    out = F.when(F.lit(False), "")
    for ext in extensions or K.IMAGE_EXTENSIONS:
        out = out.when(path.endswith(ext), ext)
    if mime is not None:
        for name, ext in (mime_map or K.IMAGE_MIME).items():
            out = out.when(F.contains(F.lower(col(mime)), F.lit(name)), ext)
    return out.otherwise(".jpg")


def thousands(c, separator: str = " ") -> Column:
    """A number without decimals, thousands set apart."""
    return F.replace(F.format_number(F.rint(col(c)), 0), F.lit(","), F.lit(separator))


def day_text(c) -> Column:
    return F.coalesce(F.date_format(col(c), "dd/MM/yyyy"), F.lit("?"))


def label(c, otherwise: str) -> Column:
    return F.coalesce(text_or_null(c), F.lit(otherwise))


def mid_year(year) -> Column:
    return F.make_date(col(year).cast("int"), F.lit(6), F.lit(30))


def age_in_days(day, as_of) -> Column:
    return F.date_diff(as_date(as_of), col(day))
