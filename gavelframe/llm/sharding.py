"""Sharding: a keyed Feistel permutation of global row numbers gives every row its shard and slot.

Rows are numbered 0..n-1 in the order (bucket of the mixed key and tie columns, key, tie columns), so rows that share
a key are spread by what else they hold. Buckets are counted with map-side combination, the running sum over the at most `buckets` counts is the only
thing that is broadcast, and rows are numbered inside their bucket. The number is then permuted:
it is split into two digits of bases a = ceil(sqrt n) and b = ceil(n / a), alternating rounds add
a keyed hash of one digit to the other, and numbers that land in [n, a*b) walk on through the
permutation until they fall below n (cycle walking). shard = y mod k and slot = y div k, so shard
sizes differ by at most one row, slots have no gaps, and a row's place can be computed from its
number alone.

Nulls: a null key counts as -1. Repeated rows, equal in key and tie columns, are numbered one after another in one bucket;
give the tie columns that tell rows of one key apart. Empty input gives no
rows. Columns of the input called like an output column are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gavelframe.llm.base import folded, mixed, table

BUCKETS = 16384
ROUNDS = 4
#: A walk meets each of the a*b - n < a numbers above n at most once, so 64 steps always do for
#: n <= 4096; above that a walk of s steps has a chance of about n ** (1 - s / 2).
WALK = 64


def permuted(x: str, a: str, b: str, seed: int, quotient: str) -> str:
    """SQL text of one pass of the Feistel network over [0, a*b)."""
    left, right = f"({quotient.format(x=x, y=b)})", f"(({x}) % {b})"
    for i in range(0, ROUNDS, 2):
        left = f"(({left} + {mixed(right, seed * 7919 + i * 104729 + 1)}) % {a})"
        right = f"(({right} + {mixed(left, seed * 7919 + i * 104729 + 15485863)}) % {b})"
    return f"({left} * {b} + {right})"


def permutation(x: str, n: str, a: str, b: str, seed: int) -> Column:
    """Column with the place of row number `x` among `n`; raises if a walk does not end."""
    div = "({x}) div {y}"
    first = permuted(x, a, b, seed, div)
    again = permuted("y", a, b, seed, div)
    walk = (
        f"aggregate(sequence(1, {WALK}), {{y0}}, (y, s) -> CASE WHEN y < {n} THEN y ELSE {again} END,"
        f" y -> CASE WHEN y < {n} THEN y ELSE raise_error('cycle walk did not end') END)"
    )
    return F.expr(f"CASE WHEN {first} < {n} THEN {first} ELSE {walk.format(y0=first)} END")


def spread(key: str, ties: list[str]) -> str:
    """SQL text: one number of [0, 1073741789) from a bigint key and bigint tie values."""
    more = "".join(f" + {folded(t)} * {31 + 6 * i}" for i, t in enumerate(ties))
    return f"(({folded(key)}{more}) % 1073741789)"


def shard(df: DataFrame, shards: int = 8, key: str = "doc_id", ties: tuple[str, ...] = (), seed: int = 1) -> DataFrame:
    """`df` with `shard` int and `slot` long."""
    kept = [c for c in df.columns if c not in ("shard", "slot")]
    whole_number = ("tinyint", "smallint", "int", "bigint")
    values = [f"`{t}`" if df.schema[t].dataType.simpleString() in whole_number else f"xxhash64(`{t}`)" for t in ties]
    bucket = F.expr(f"cast({mixed(spread(f'`{key}`', values), seed)} % {BUCKETS} as int)")
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), bucket.alias("bucket"))
    counts = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    upto = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    starts = counts.select(
        "bucket", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("start"), F.sum("n").over(whole).alias("total"),
    ).withColumn("a", F.ceil(F.sqrt("total"))).withColumn("b", F.ceil(F.col("total") / F.col("a")))
    order = [F.col(f"row.`{c}`").asc_nulls_first() for c in (key, *ties)]
    numbered = (
        rows.withColumn("r", F.row_number().over(Window.partitionBy("bucket").orderBy(*order)).cast("long"))
        .join(F.broadcast(starts), "bucket")
        .withColumn("x", F.col("start") + F.col("r") - 1)
        .withColumn("y", permutation("x", "total", "a", "b", seed))
    )
    return numbered.select(
        *[F.col(f"row.`{c}`").alias(c) for c in kept],
        (F.col("y") % shards).cast("int").alias("shard"), F.expr(f"y div {shards}").alias("slot"),
    )


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
    )
    return shard(docs, 8, "doc_id", ("size", "text_crc32")).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


_P = permuted("{x}", "a", "b", 1, "({x}) // {y}")
OP1_SQL = f"""
WITH RECURSIVE docs AS (
  SELECT doc_id, strlen(coalesce(text, '')) + 1 AS size, encode(coalesce(text, '')) AS bytes FROM documents),
crc_table AS (
  SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)),
      lambda v, k: xor(v >> 1, CASE WHEN v & 1 = 1 THEN 3988292384 ELSE 0 END)) AS v FROM range(256) r(i))),
hexed AS (SELECT doc_id, size, hex(bytes) AS h FROM docs),
summed AS (
  SELECT doc_id, size, xor(list_reduce(list_prepend(4294967295::BIGINT,
      list_transform(range(size - 1), lambda i: ('0x' || substr(h, (2 * i + 1)::BIGINT, 2))::BIGINT)),
      lambda c, v: xor(c >> 8, t[(xor(c, v) & 255) + 1])), 4294967295::BIGINT) AS text_crc32
  FROM hexed, crc_table),
numbered AS (
  SELECT *, row_number() OVER (ORDER BY {mixed(spread("doc_id", ["size", "text_crc32"]), 1)} % {BUCKETS},
    doc_id NULLS FIRST, size, text_crc32) - 1 AS x FROM summed),
total AS (SELECT n, a, ceil(n / a)::BIGINT AS b FROM (SELECT count(*) AS n, ceil(sqrt(count(*)))::BIGINT AS a FROM documents)),
walk(x, y) AS (
  SELECT x, {_P.format(x="x")} FROM numbered, total
  UNION ALL SELECT x, {_P.format(x="y")} FROM walk, total WHERE y >= n)
SELECT doc_id, size::BIGINT AS size, text_crc32, 'rows' AS law, (y % 8)::INT AS shard, y // 8 AS slot,
  NULL::INT AS grown_shard
FROM numbered JOIN (SELECT walk.* FROM walk, total WHERE y < n) USING (x)
"""
