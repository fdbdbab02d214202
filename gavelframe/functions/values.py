"""Small Column helpers shared by every operator."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def as_date(d) -> Column:
    """A date literal from a ``date``, an ISO string or a Column."""
    if isinstance(d, Column):
        return d
    if isinstance(d, dt.date):
        d = d.isoformat()
    return F.lit(d).cast("date")


# "Present" means neither NULL nor the empty value of its type (0, '', []).

def has_number(c) -> Column:
    c = col(c)
    return c.isNotNull() & (c != 0)


def has_text(c) -> Column:
    c = col(c)
    return c.isNotNull() & (c != "")


def has_items(c) -> Column:
    return F.coalesce(F.size(col(c)), F.lit(0)) > 0


def number_or_null(c) -> Column:
    c = col(c)
    return F.when(c != 0, c)


def text_or_null(c) -> Column:
    c = col(c)
    return F.when(c != "", c)


def half_even(c, digits: int = 0) -> Column:
    """Round to ``digits`` decimals, ties to even."""
    c = col(c).cast("double")
    if digits == 0:
        return F.rint(c)
    scale = float(10 ** digits)
    return F.rint(c * scale) / scale


def ladder(c, steps, otherwise=None) -> Column:
    """Value of the first ``(lower bound, value)`` step that ``c`` reaches."""
    c, out = col(c), None
    for bound, value in steps:
        out = F.when(c >= bound, value) if out is None else out.when(c >= bound, value)
    return out.otherwise(otherwise)


def descending_ladder(c, steps, otherwise=None) -> Column:
    """Value of the first ``(upper bound, value)`` step that ``c`` does not exceed."""
    c, out = col(c), None
    for bound, value in steps:
        out = F.when(c <= bound, value) if out is None else out.when(c <= bound, value)
    return out.otherwise(otherwise)


def contains_any(text, words) -> Column:
    """True when ``text`` holds one of the literal ``words``."""
    text = col(text)
    hit = F.lit(False)
    for w in words:
        hit = hit | text.contains(w)
    return hit


def contains_fold(text, needle) -> Column:
    """Case-insensitive containment."""
    needle = F.lit(needle) if isinstance(needle, str) else needle
    return F.contains(F.lower(col(text)), F.lower(needle))


def lookup(c, mapping: dict, otherwise=None) -> Column:
    """Map a column through a small fixed dictionary inside the expression."""
    pairs = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    hit = F.try_element_at(pairs, col(c))
    return hit if otherwise is None else F.coalesce(hit, F.lit(otherwise))


def matched(pattern: str, text, group: int = 1) -> Column:
    """First regex capture, NULL instead of '' when there is none."""
    return text_or_null(F.regexp_extract(col(text), pattern, group))


def all_matches(pattern: str, text, group: int = 1) -> Column:
    return F.regexp_extract_all(col(text), F.lit(pattern), F.lit(group))


def plain_spaces(c) -> Column:
    """No-break and narrow no-break spaces become plain ones."""
    return F.translate(col(c), "\u00a0\u202f", "  ")


def number_text(c, digits: int = 0) -> Column:
    """Python-like fixed-point text of a number, ties to even."""
    rounded = half_even(c, digits)
    return F.when(rounded.isNotNull(), F.format_string(f"%.{digits}f", rounded))
