"""Raw files and legacy text rows to typed tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gavelframe.functions import constants as K
from gavelframe.functions.values import has_number, text_or_null
from gavelframe.sources import schemas as S


def _number(name: str) -> Column:
    return F.replace(F.col(name), F.lit(","), F.lit(".")).try_cast("double")


def parse_transactions(raw: DataFrame) -> DataFrame:
    """All-string raw rows to transactions.

    A date that cannot be read is NULL; a price, surface or coordinate that is filled in
    but no number drops the row; an empty price is 0.
    """
    have = [c for c in S.RAW_TRANSACTION_COLUMNS if c in raw.columns]
    t = raw.select(*[F.col(c).alias(S.RAW_TRANSACTION_COLUMNS[c]) for c in have],
                   *[F.lit(None).cast("string").alias(n) for c, n in S.RAW_TRANSACTION_COLUMNS.items() if c not in have])
    broken = F.lit(False)
    for c in ("price", "surface_m2", "lat", "lon"):
        given = text_or_null(c)
        number = _number(c) if c in ("price", "surface_m2") else F.col(c).try_cast("double")
        broken = broken | (given.isNotNull() & number.isNull())
    t = t.filter(~broken)
    price = F.coalesce(F.when(text_or_null("price").isNotNull(), _number("price")), F.lit(0.0))
    surface = F.when(text_or_null("surface_m2").isNotNull(), _number("surface_m2"))
    return t.select(
        F.try_to_date("tx_date", "yyyy-M-d").alias("tx_date"), F.coalesce("nature", F.lit("")).alias("nature"), price.alias("price"),
        F.trim(F.concat(F.coalesce("street_number", F.lit("")), F.lit(" "), F.coalesce("street", F.lit("")))).alias("address"),
        *[F.coalesce(c, F.lit("")).alias(c) for c in ("postal_code", "commune", "local_type")],
        F.left(F.coalesce("postal_code", F.lit("")), F.lit(2)).alias("department"), surface.alias("surface_m2"),
        F.when(F.col("rooms").rlike(r"^\d+$"), F.col("rooms").try_cast("int")).alias("rooms"),
        text_or_null("lat").try_cast("double").alias("lat"), text_or_null("lon").try_cast("double").alias("lon"),
        F.when((surface > 0) & (price > 0), price / surface).alias("price_m2"))


def read_transactions(spark: SparkSession, paths) -> DataFrame:
    """Department/year CSV files (plain or gzip, globs welcome) to transactions."""
    return parse_transactions(spark.read.option("header", True).option("inferSchema", False).csv(paths))


def write_transactions(transactions: DataFrame, path: str) -> None:
    """Parquet by department and year; the rebalance splits large departments over tasks."""
    (transactions.withColumn("year", F.coalesce(F.year("tx_date"), F.lit(0)))
     .hint("rebalance", "department", "year")
     .sortWithinPartitions("postal_code", "tx_date")
     .write.mode("overwrite").partitionBy("department", "year").parquet(path))


def parse_indicators(raw: DataFrame, departments=K.TARGET_DEPARTMENTS) -> DataFrame:
    """All-string commune rows to long (insee, year, figures); the last row of a year would
    win in file order, so rows are expected unique per commune and year."""
    def number(c, kind):
        text = F.replace(F.col(c), F.lit(" "), F.lit(""))
        return (F.replace(text, F.lit(","), F.lit(".")) if kind == "double" else text).try_cast(kind)

    t = raw.select(*[F.trim(F.col(c)).alias(n) for c, n in S.RAW_INDICATOR_COLUMNS.items()])
    keep = text_or_null("insee").isNotNull() & text_or_null("year").isNotNull()
    if departments:
        keep = keep & F.left("insee", F.lit(2)).isin(list(departments))
    return t.filter(keep).select(
        "insee", F.col("year").try_cast("int").alias("year"), number("price_m2", "double").alias("price_m2"),
        number("mean_price", "double").alias("mean_price"), number("n_sales", "int").alias("n_sales"),
        number("n_houses", "int").alias("n_houses"), number("n_flats", "int").alias("n_flats"),
        number("mean_surface_m2", "double").alias("mean_surface_m2"))


def read_indicators(spark: SparkSession, paths, departments=K.TARGET_DEPARTMENTS) -> DataFrame:
    return parse_indicators(spark.read.option("header", True).csv(paths), departments)


def read_listing_cache(spark: SparkSession, paths, *, lines: bool = False) -> DataFrame:
    """JSON objects keyed by cache key to one row per key.

    A legacy file is one JSON object and so one record. With ``lines`` each line is an object of
    its own, as `export_listing_cache` writes them, and files of any size are split over tasks.
    """
    text = spark.read.text(paths, wholetext=not lines)
    entries = text.select(F.explode(F.from_json("value", f"map<string,{S.CACHE_ENTRY}>")).alias("cache_key", "e"))
    return entries.select(
        "cache_key", F.col("e.prix_m2").alias("price_m2"), F.col("e.prix_m2_raw").alias("raw_price_m2"),
        F.col("e.nb_listings").alias("n_ads"), F.col("e.geographic_match").alias("geo_match"),
        F.col("e.source_url").alias("source_url"), F.col("e.sources").alias("sources"),
        F.col("e.notes").alias("notes"), F.col("e.comparables").alias("comparables"),
        F.try_to_timestamp("e.cached_at").alias("cached_at"))


def cache_comparables(cache: DataFrame) -> DataFrame:
    return cache.select("cache_key", F.posexplode("comparables").alias("pos", "c")).select(
        "cache_key", "pos", F.col("c.titre").alias("title"), F.col("c.prix").alias("price"), F.col("c.surface").alias("surface_m2"),
        F.col("c.prix_m2").alias("price_m2"), F.col("c.url").alias("url"), F.col("c.source").alias("source"))


def decode_stored_rows(rows: DataFrame) -> DataFrame:
    """Stored text rows to the listings schema: JSON arrays, ISO dates, enumerations with
    defaults; columns an old store lacks read as NULL or empty."""
    target = S.struct_of(S.LISTINGS)
    have = set(rows.columns)

    def column(f) -> Column:
        kind, name = f.dataType.typeName(), f.name
        stored = F.col(name) if name in have else F.lit(None).cast("string")
        if kind == "array":
            element = f.dataType.elementType
            if name == "visit_times":
                texts = F.from_json(stored, "array<string>")
                return F.coalesce(F.array_compact(F.transform(texts, lambda v: F.try_to_timestamp(v))), F.array()).cast(f.dataType)
            return F.coalesce(F.from_json(stored, f"array<{element.simpleString()}>"), F.array()).cast(f.dataType)
        if kind == "date":
            return F.try_to_date(stored.cast("string"))
        if kind == "timestamp":
            return F.try_to_timestamp(stored.cast("string"))
        if kind == "string":
            return stored.cast("string")
        return stored.cast("string").try_cast(kind if kind != "long" else "bigint")

    out = rows.select(*[column(f).alias(f.name) for f in target.fields])
    empty = ["source_id", "url", "address", "postal_code", "city", "department", "description", "description_long",
             "occupancy", "parcel_ref", "court"]

    def allowed(name, values, default):
        return F.when(F.col(name).isin(values), F.col(name)).otherwise(default)

    return out.withColumns({
        **{c: F.coalesce(c, F.lit("")) for c in empty},
        "property_type": allowed("property_type", K.PROPERTY_TYPES, "autre"),
        "report_status": allowed("report_status", K.REPORT_STATUSES, "non_disponible"),
        "status": allowed("status", K.LISTING_STATUSES, "a_venir"),
    })


def evolve(*frames: DataFrame) -> DataFrame:
    """Tables of different age under the union of their columns."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def with_price_m2(transactions: DataFrame) -> DataFrame:
    return transactions.withColumn("price_m2", F.when(has_number("surface_m2") & (F.col("price") > 0), F.col("price") / F.col("surface_m2")))
