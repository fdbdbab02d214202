"""Extracted records joined back to listings: conversion, filling gaps, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gavelframe.functions import constants as K
from gavelframe.functions.keys import department_of
from gavelframe.functions.values import has_number, has_text, number_or_null, text_or_null
from gavelframe.text import fields as T

EXTRACTED_JSON = (
    "struct<address:string,postal_code:string,city:string,department:string,property_type:string,surface:double,"
    "rooms:int,bedrooms:int,floor:int,description:string,occupancy:string,start_price:double,sale_date:string,"
    "sale_time:string,visits:array<string>,court:string,agent_name:string,agent_firm:string,agent_phone:string,"
    "agent_email:string,agent_address:string,photos:array<string>,documents:array<struct<name:string,url:string>>,"
    "report_url:string,confidence:double,notes:array<string>>"
)


def extraction_to_listing(rows: DataFrame, record: str = "record") -> DataFrame:
    """JSON extraction records (``url, source, record``) to listing columns; bad dates are dropped."""
    r = F.from_json(record, EXTRACTED_JSON)
    kinds = [k for k in K.PROPERTY_TYPES if k != "autre"]
    visits = F.array_compact(F.transform(F.col("_r.visits"), lambda v: F.try_to_timestamp(v)))
    same = ["address", "postal_code", "city", "department", "rooms", "bedrooms", "floor", "description", "occupancy",
            "start_price", "sale_time", "court", "agent_name", "agent_firm", "agent_phone", "agent_email", "agent_address", "confidence"]
    return rows.withColumn("_r", r).select(
        "url", "source", *[F.col(f"_r.{c}").alias(c) for c in same],
        F.when(F.col("_r.property_type").isin(kinds), F.col("_r.property_type")).otherwise("autre").alias("property_type"),
        F.col("_r.surface").alias("surface_m2"),
        F.try_to_date("_r.sale_date", "yyyy-MM-dd").alias("sale_date"),
        F.coalesce(visits, F.array()).alias("visit_times"),
        F.coalesce("_r.photos", F.array()).alias("photos"),
        F.coalesce("_r.documents", F.array()).alias("documents"),
        F.col("_r.report_url").alias("report_url"),
        F.when(has_text("_r.report_url"), "a_telecharger").otherwise("non_disponible").alias("report_status"))


def report_fields(pages: DataFrame, text: str = "body", departments=K.TARGET_DEPARTMENTS) -> DataFrame:
    """All fields of a report text, keyed by ``page_id``."""
    t = F.col(text)
    return pages.select(
        "page_id",
        T.address(t).alias("address"), T.postal_code(t, departments=departments).alias("postal_code"),
        T.city(t, departments=departments).alias("city"), T.property_class(t).alias("property_type"),
        T.surface(t).alias("surface_m2"), T.rooms(t).alias("rooms"), T.bedrooms(t).alias("bedrooms"), T.floor(t).alias("floor"),
        *[c.alias(n) for n, c in T.coownership(t).items()],
        T.occupancy_state(t).alias("occupancy"), T.tenant(t).alias("tenant"), T.rent(t).alias("rent"),
        *[c.alias(n) for n, c in T.finance(t).items()],
        T.sale_date(t).alias("sale_date"), T.visits(t).alias("visit_times"), T.court(t).alias("court"),
        T.agent_name(t).alias("agent_name"), T.description(t).alias("description"), T.diagnostics(t).alias("diagnostics"))


def fill_from_report(listings: DataFrame, reports: DataFrame, key: str = "listing_key") -> DataFrame:
    """Missing listing fields from the report; sentences on occupancy and co-ownership appended."""
    names = [c for c in reports.columns if c != key]
    r = reports.select(key, *[F.col(c).alias(f"r_{c}") for c in names], F.lit(True).alias("r_found"))
    j = listings.join(r, key, "left")
    found = F.coalesce("r_found", F.lit(False))
    for c in ("address", "postal_code", "city"):
        j = j.withColumn(c, F.coalesce(text_or_null(c), text_or_null(f"r_{c}"), F.col(c)))
    for c in ("surface_m2", "rooms", "bedrooms", "floor", "start_price"):
        if c in listings.columns:
            j = j.withColumn(c, F.coalesce(number_or_null(c), number_or_null(f"r_{c}"), F.col(c)))
    if "department" in listings.columns:
        came = ~has_text(listings["postal_code"]) & has_text("r_postal_code")
        j = j.withColumn("department", F.when(came, department_of("r_postal_code")).otherwise(F.col("department")))
    state = F.concat(
        F.lit("État d'occupation: "), text_or_null("r_occupancy"),
        F.coalesce(F.concat(F.lit(" ("), text_or_null("r_tenant"), F.lit(")")), F.lit("")),
        F.coalesce(F.concat(F.lit(" - Loyer: "), number_or_null("r_rent").cast("string"), F.lit("€/mois")), F.lit("")))
    shared = F.when(F.col("r_is_coownership"), F.concat(
        F.lit("Copropriété"),
        F.coalesce(F.concat(F.lit(" - Lot n°"), text_or_null("r_lot")), F.lit("")),
        F.coalesce(F.concat(F.lit(" - Charges: "), number_or_null("r_charges").cast("string"), F.lit("€/an")), F.lit(""))))
    opening = F.concat_ws("\n\n", text_or_null("description"), text_or_null("r_description"))
    text = F.concat_ws("\n", text_or_null(opening), state, shared)
    status = F.when(found, "disponible")
    if "report_status" in listings.columns:
        status = F.coalesce(status, F.col("report_status"))
    return j.withColumns({
        "description": F.when(found, text).otherwise(F.col("description")), "report_status": status,
    }).drop("r_found", *[f"r_{c}" for c in names])


def report_summary() -> Column:
    """Nested summary of ``report_fields`` columns."""
    def group(**parts):
        return F.struct(*[F.col(c).alias(n) for n, c in parts.items()])

    full = F.trim(F.concat_ws(" ", "address", "postal_code", "city"))
    return F.struct(
        F.struct(full.alias("full"), "address", "postal_code", "city").alias("address"),
        group(type="property_type", surface="surface_m2", rooms="rooms", bedrooms="bedrooms", floor="floor").alias("property"),
        group(is_coownership="is_coownership", lot="lot", charges="charges", shares="shares").alias("coownership"),
        group(status="occupancy", tenant="tenant", rent="rent").alias("occupancy"),
        group(start_price="start_price", fees="fees", debt="debt").alias("finance"),
        group(sale="sale_date", visits="visit_times").alias("dates"),
        group(court="court", agent="agent_name", case_no="case_no").alias("legal"),
        F.col("diagnostics"))


def usable(extracted: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Extractions with a flag where their confidence is low."""
    return extracted.withColumn("low_confidence", has_number("confidence") & (F.col("confidence") < threshold))
