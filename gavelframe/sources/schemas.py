"""Table schemas; every column may be NULL unless a reader says otherwise."""

from __future__ import annotations

from pyspark.sql import types as T

# raw column of the open-data transaction files -> ours
RAW_TRANSACTION_COLUMNS = {
    "date_mutation": "tx_date",
    "nature_mutation": "nature",
    "valeur_fonciere": "price",
    "adresse_numero": "street_number",
    "adresse_nom_voie": "street",
    "code_postal": "postal_code",
    "nom_commune": "commune",
    "type_local": "local_type",
    "surface_reelle_bati": "surface_m2",
    "nombre_pieces_principales": "rooms",
    "latitude": "lat",
    "longitude": "lon",
}
RAW_INDICATOR_COLUMNS = {
    "INSEE_COM": "insee",
    "annee": "year",
    "Prixm2Moyen": "price_m2",
    "PrixMoyen": "mean_price",
    "nb_mutations": "n_sales",
    "NbMaisons": "n_houses",
    "NbApparts": "n_flats",
    "SurfaceMoy": "mean_surface_m2",
}

TRANSACTIONS = (
    "tx_key string, tx_date date, nature string, price double, address string, postal_code string, commune string, "
    "department string, local_type string, surface_m2 double, rooms int, lat double, lon double, price_m2 double"
)
LISTINGS = (
    "listing_id long, source string, source_id string, url string, address string, postal_code string, city string, "
    "department string, lat double, lon double, property_type string, surface_m2 double, rooms int, bedrooms int, "
    "floor int, description string, description_long string, occupancy string, parcel_ref string, photos array<string>, "
    "documents array<struct<name:string,url:string,type:string>>, sale_date date, sale_time string, "
    "visit_times array<timestamp>, judgment_date date, start_price double, hammer_price double, court string, "
    "agent_id long, agent_name string, agent_firm string, agent_address string, agent_phone string, agent_email string, "
    "agent_site string, report_status string, report_url string, report_path string, market_value double, "
    "market_price_m2 double, discount_pct double, opportunity_score double, status string, created_at timestamp, "
    "updated_at timestamp"
)
AGENTS = (
    "agent_id long, name string, firm string, address string, phone string, email string, site string, "
    "created_at timestamp, updated_at timestamp"
)
ADJUDICATIONS = (
    "source string, source_url string, sale_date date, address string, postal_code string, city string, "
    "property_type string, surface_m2 double, rooms int, start_price double, hammer_price double, price_m2 double, court string"
)
CACHE_ENTRY = (
    "struct<prix_m2:double,prix_m2_raw:double,nb_listings:int,geographic_match:string,source_url:string,"
    "sources:array<string>,notes:string,comparables:array<struct<titre:string,prix:double,surface:double,"
    "prix_m2:double,url:string,source:string>>,cached_at:string>"
)


def struct_of(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)
