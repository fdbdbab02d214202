"""Per-site notice parsers: a table of parameters, picked by the ``source`` column.

A parser is any callable ``(text Column, url Column) -> {listing column: Column}``; new
sites are added by putting one more entry into the mapping given to ``parse_notices``. A parser may say in
``same`` by which parameters a column differs: sites that agree on them share one expression, so the
projection holds what differs between sites once a difference, not once a site.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gavelframe.functions import constants as K
from gavelframe.functions.keys import department_of
from gavelframe.text import fields as T
from gavelframe.text import patterns as P

Parser = Callable[[Column, Column], dict[str, Column]]


def notice_parser(*, source_id: str, departments=K.TARGET_DEPARTMENTS, families: dict | None = None,
                  courts: dict | None = None, cities: dict | None = None) -> Parser:
    """Parser of a site that differs from the others by these parameters only."""
    def parse(text: Column, url: Column) -> dict[str, Column]:
        from gavelframe.functions.values import matched
        number = matched(source_id, url, 1)
        if source_id.count("(\\d+)") > 1:
            number = F.coalesce(number, matched(source_id, url, 2))
        place = T.location(text, url, departments, cities or {})
        return {
            "source_id": number, "address": T.address(text), "postal_code": place["postal_code"],
            "department": department_of(place["postal_code"]), "city": place["city"], "property_type": T.property_class(text, families),
            "surface_m2": T.surface(text), "rooms": T.rooms(text), "bedrooms": T.bedrooms(text), "floor": T.floor(text),
            "sale_date": T.sale_date(text), "sale_time": T.sale_time(text), "visit_times": T.visits(text),
            "start_price": T.price(text), "court": T.court(text, courts), "occupancy": T.occupancy(text),
            "parcel_ref": T.parcel(text), "agent_name": T.agent_name(text), "agent_firm": T.agent_firm(text),
            "agent_phone": T.agent_phone(text), "agent_email": T.agent_email(text),
        }
    place = ("place", tuple(departments), repr(sorted((cities or {}).items())))
    parse.same = {"source_id": source_id, "postal_code": place, "department": place, "city": place,
                  "property_type": repr(families), "court": repr(courts)}
    return parse


# fixed values: what sets the known sites apart
SITE_FAMILIES = {
    "site_b": {
        "appartement": ["appartement", "studio", "f1", "f2", "f3", "f4", "f5"], "maison": ["maison", "villa", "pavillon"],
        "local_commercial": ["local", "commerce", "bureau"], "terrain": ["terrain", "parcelle"], "parking": ["parking", "garage", "box"]},
    "site_c": {
        "appartement": ["appartement", "studio", "duplex", "loft"], "maison": ["maison", "villa", "pavillon", "propriété"],
        "local_commercial": ["local", "commerce", "bureau", "boutique"], "terrain": ["terrain", "parcelle", "foncier"],
        "parking": ["parking", "garage", "box", "stationnement"]},
}
DEFAULT_PARSERS: dict[str, Parser] = {
    "site_a": notice_parser(source_id=P.SOURCE_IDS["site_a"], cities=K.SOUTHERN_CITIES),
    "site_b": notice_parser(source_id=P.SOURCE_IDS["site_b"], families=SITE_FAMILIES["site_b"]),
    "site_c": notice_parser(source_id=P.SOURCE_IDS["site_c"], families=SITE_FAMILIES["site_c"]),
}


def parse_notices(pages: DataFrame, parsers: dict[str, Parser] | None = None, *, text: str = "body") -> DataFrame:
    """``source, url, <text>`` rows to listing columns, each by its site's parser; one pass, no union."""
    parsers = parsers or DEFAULT_PARSERS
    made = {name: p(F.col(text), F.col("url")) for name, p in parsers.items()}
    columns = list(dict.fromkeys(c for m in made.values() for c in m))

    def chosen(column: str) -> Column:
        alike: dict = {}
        for name, m in made.items():
            if column in m:
                same = getattr(parsers[name], "same", None)
                alike.setdefault(name if same is None else (same.get(column),), []).append(name)
        out = None
        for names in alike.values():
            hit = F.col("source").isin(names)
            out = F.when(hit, made[names[0]][column]) if out is None else out.when(hit, made[names[0]][column])
        return out

    keys = [c for c in ("page_id", "source", "url") if c in pages.columns]
    return pages.select(*keys, *[chosen(c).alias(c) for c in columns])
