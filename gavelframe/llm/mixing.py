"""Mixing sources to target weights: repetition rates per source, then whole copies plus one Bernoulli copy.

Sizes are summed per source (map-side combination), shares of the total are filled up by weight with
a ceiling of `most` times the source's own size, and rate = target / size. A document is taken
floor(rate) times and once more if a keyed hash of its id, size and place among rows with equal id, source and size falls
below the fraction of the rate.

The ceiling is solved in closed form: sources sorted by size / weight are at their ceiling up to the
point where the remaining total shared by the remaining weight stays below the next ceiling. That is
the fixed point of resharing the excess until no source is above.

Nulls: a null text has size 0, a null source is a source of its own that comes last, a null id counts
as -1. Rows that share id, source and size are numbered, in slices so that no task gets them all, and decide each for
itself; where there are none, nothing is shuffled. A source of size 0 has target 0 and takes nothing. Empty input
gives no rows. The table of sources has one row each. Where it is counted to hold at most `BROADCAST_BYTES`
of names it is broadcast; beyond that it is joined by salted keys, so that a source with a third of all
rows is spread over `SALTS` keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gavelframe.llm.base import WORD, folded, mixed, table, word_count, written

WEIGHTS = (5, 2, 1)
MOST = 3
SALTS = 32
BROADCAST_BYTES = 4 << 20
SEED = 20261


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """Of (source, size): source, source_size, target. Weights repeat along the sources in code point order."""
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("weight", weight)
    order = [F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last()]
    before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = per.select(
        "*",
        (F.sum("source_size").over(whole) - most * F.coalesce(F.sum("source_size").over(before), F.lit(0))).alias("left"),
        (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))).alias("open"),
    ).withColumn("share", F.col("left") / F.col("open"))
    # the level of the first source that stays below its ceiling holds for all after it
    free = F.when(F.col("share") * F.col("weight") <= most * F.col("source_size"), F.col("share"))
    return level.withColumn("share", F.first(free, True).over(whole)).select(
        "source", "source_size",
        F.least(F.col("share") * F.col("weight"), (most * F.col("source_size")).cast("double")).alias("target"),
    )


def chance(key: str, size: str, place: str, seed: int) -> str:
    """SQL text: a number in [0, 2**31 - 1) from id, size and place among equals."""
    return mixed(f"(({folded(key)} + ({size}) % 1048576 * 7919 + ({place}) % 1048576 * 40503) % 1073741789)", seed)


def copies(rate: Column, key: str, seed: int = SEED) -> Column:
    """floor(rate), and one more with the rate's fraction as probability."""
    drawn = F.expr(f"({chance(f'`{key}`', 'size', 'place', seed)}) / 2147483647.0D")
    return (F.floor(rate) + F.when(drawn < rate - F.floor(rate), 1).otherwise(0)).cast("long")


def _placed(rows: DataFrame) -> DataFrame:
    """`rows` with `place`: 0 if all ids differ, else numbers that differ among equals."""
    equals = ["id", "source", "size"]
    if rows.groupBy("id").agg(F.count(F.lit(1)).alias("c")).where("c > 1").isEmpty():
        return rows.withColumn("place", F.lit(0).cast("long"))
    sliced = rows.withColumn("slice", F.expr(f"pmod(xxhash64(monotonically_increasing_id()), {SALTS})"))
    number = F.row_number().over(Window.partitionBy(*equals, "slice").orderBy(F.lit(0)))
    return sliced.withColumn("place", ((number - 1) * SALTS + F.col("slice")).cast("long")).drop("slice")


def with_copies(docs: DataFrame, size: Column, source: str = "source", key: str = "doc_id",
                weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: int = SEED,
                broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Struct `row` of the input's columns, its `size`, `source_size`, `target` and the `copies` to take."""
    rows = _placed(docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), size.alias("size"), F.col(f"`{key}`").alias("id"),
        F.col(f"`{source}`").alias("source"), F.expr(f"pmod(xxhash64(`{key}`), {SALTS})").alias("salt"),
    ))
    aims = written(targets(rows.select("source", "size"), weights, most).withColumnRenamed("source", "of"), "targets")
    held = aims.agg(F.sum(F.coalesce(F.octet_length("of"), F.lit(0)) + 32)).first()[0] or 0
    same = F.col("source").eqNullSafe(F.col("of"))
    if held <= broadcast_bytes:
        joined = rows.join(F.broadcast(aims), same)
    else:
        spread = aims.withColumn("salt_of", F.explode(F.expr(f"sequence(0L, {SALTS - 1}L)")))
        joined = rows.join(spread, same & (F.col("salt") == F.col("salt_of")))
    rate = F.coalesce(F.col("target") / F.expr("nullif(source_size, 0)"), F.lit(0.0))
    return joined.select("row", "size", "id", "place", "source_size", "target", rate.alias("rate")).withColumn(
        "copies", copies(F.col("rate"), "id", seed)).drop("id", "place")


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus: each document as often as it is taken, with the columns of `docs`."""
    taken = with_copies(docs, word_count(F.col("text")), **options).where("copies > 0")
    repeated = taken.select("row", F.explode(F.expr("sequence(1, copies)")).alias("copy"))
    return repeated.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", word_count(F.col("text")).alias("size"))
    out = with_copies(docs, F.col("size"))
    return out.select(
        "row.doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"),
        "row.source", "copies",
    )


OP2_SQL = f"""
WITH docs AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS size FROM documents),
per AS (
  SELECT source, sum(size)::BIGINT AS source_size,
    [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight
  FROM docs GROUP BY source),
level AS (
  SELECT *, ((sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER w, 0))::DOUBLE
    / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0))) AS share FROM per
  WINDOW w AS (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
chosen AS (
  SELECT first(share ORDER BY source_size / weight, source NULLS LAST) AS share FROM level
  WHERE share * weight <= 3 * source_size),
aims AS (
  SELECT source, source_size, least(chosen.share * weight, (3 * source_size)::DOUBLE) AS target FROM level, chosen),
rated AS (
  SELECT doc_id, size, docs.source, source_size, target, coalesce(target / nullif(source_size, 0), 0.0) AS rate
  FROM docs JOIN aims ON docs.source IS NOT DISTINCT FROM aims.source)
SELECT doc_id, size, source_size, target, size * copies AS taken, source, copies FROM (
  SELECT *, (floor(rate) + CASE WHEN ({chance("doc_id", "size", "0", SEED)}) / 2147483647.0::DOUBLE < rate - floor(rate)
    THEN 1 ELSE 0 END)::BIGINT AS copies FROM rated)
"""
