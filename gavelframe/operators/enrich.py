"""Locations completed from fixed dimensions, agents joined, coordinates filled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gavelframe.functions import constants as K
from gavelframe.functions.keys import department_of, district_postal, normalize_text, title_case
from gavelframe.functions.similarity import text_ratio
from gavelframe.functions.values import has_text, lookup, text_or_null


def _plain(name: str) -> str:
    return name.replace("-", " ").replace("'", " ")


POSTAL_OF_CITY = {_plain(c): p for c, p in K.CITY_POSTAL.items()}
CITY_OF_POSTAL = {p: c for c, p in K.CITY_POSTAL.items()}


def known_city(city) -> Column:
    return normalize_text(city).isin(list(POSTAL_OF_CITY))


def fill_locations(rows: DataFrame) -> DataFrame:
    """City from postal code, postal code from city; ``changes`` lists what was inferred."""
    city_in = lookup("postal_code", CITY_OF_POSTAL)
    no_city = ~has_text("city")
    no_postal = ~has_text("postal_code")
    named = F.when(no_city & has_text("postal_code") & city_in.isNotNull(), title_case(city_in))
    rows = rows.withColumn("_named", named)
    city = F.coalesce("_named", F.col("city"))
    code = F.coalesce(district_postal(city), lookup(normalize_text(city), POSTAL_OF_CITY))
    rows = rows.withColumn("_coded", F.when(no_postal & has_text(city), code))
    return rows.withColumns({
        "city": city, "postal_code": F.coalesce("_coded", F.col("postal_code")),
        "changes": F.array_compact(F.array(
            F.concat(F.lit("city inferred from postal code: "), F.col("_named")),
            F.concat(F.lit("postal code inferred from city: "), F.col("_coded")))),
    }).drop("_named", "_coded")


def enrich_locations(rows: DataFrame, min_similarity: float = 0.6) -> DataFrame:
    """``fill_locations``, then cities unlike the one their code belongs to are corrected.

    The similarity is computed once per distinct (city, expected city) and joined back.
    """
    if "department" not in rows.columns:
        rows = rows.withColumn("department", F.lit(None).cast("string"))
    filled = fill_locations(rows)
    expected = lookup("postal_code", CITY_OF_POSTAL)
    filled = filled.withColumns({
        "_has": F.when(has_text("city") & has_text("postal_code"), normalize_text("city")),
        "_expected": expected,
    }).withColumn("_wants", normalize_text("_expected"))
    unlike = (filled.filter((F.col("_has") != F.col("_wants")) & F.col("_expected").isNotNull())
              .select("_has", "_wants").distinct()
              .filter(text_ratio("_has", "_wants") < min_similarity)
              .withColumn("_wrong", F.lit(True)))
    checked = filled.join(unlike, ["_has", "_wants"], "left")
    wrong = F.coalesce("_wrong", F.lit(False))
    right = title_case("_expected")
    note = F.when(wrong, F.concat(F.lit("city corrected from '"), F.col("city"), F.lit("' to '"), right,
                                  F.lit("' (based on postal code "), F.col("postal_code"), F.lit(")")))
    no_department = ~has_text("department") & has_text("postal_code")
    dept_note = F.when(no_department, F.concat(F.lit("department inferred: "), department_of("postal_code")))
    return checked.withColumns({
        "changes": F.concat("changes", F.array_compact(F.array(note, dept_note))),
        "city": F.when(wrong, right).otherwise(F.col("city")),
        "department": F.when(no_department, department_of("postal_code")).otherwise(F.col("department")),
    }).drop("_has", "_wants", "_expected", "_wrong")


def join_agents(listings: DataFrame, agents: DataFrame) -> DataFrame:
    """Listings with their agent's contact columns; the own ones come first."""
    a = agents.select("agent_id", *[F.col(c).alias(f"_{c}") for c in ("name", "firm", "phone", "email", "site") if c in agents.columns])
    joined = listings.join(a, "agent_id", "left")
    pairs = {"agent_name": "_name", "agent_firm": "_firm", "agent_phone": "_phone", "agent_email": "_email", "agent_site": "_site"}
    for own, theirs in pairs.items():
        if theirs in joined.columns:
            mine = text_or_null(own) if own in joined.columns else F.lit(None).cast("string")
            joined = joined.withColumn(own, F.coalesce(mine, F.col(theirs))).drop(theirs)
    return joined


def city_centroid(city, centroids: dict | None = None) -> Column:
    """(lat, lon) of the first listed city contained in, or containing, the name; a small fixed table."""
    name = F.lower(F.coalesce(F.col(city) if isinstance(city, str) else city, F.lit("")))
    out = None
    for known, (lat, lon) in (centroids or K.CITY_CENTROIDS).items():
        hit = name.contains(known) | F.contains(F.lit(known), name)
        point = F.struct(F.lit(lat).alias("lat"), F.lit(lon).alias("lon"))
        out = F.when(hit, point) if out is None else out.when(hit, point)
    return out


def fill_coordinates(listings: DataFrame, centroids: dict | None = None) -> DataFrame:
    point = city_centroid("city", centroids)
    return listings.withColumn("_p", point).withColumns({
        "lat": F.coalesce("lat", F.col("_p.lat")), "lon": F.coalesce("lon", F.col("_p.lon"))}).drop("_p")
