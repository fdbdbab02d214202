"""Group statistics with an exact median that never gathers a group in one task.

``F.median`` keeps every distinct value of a group in one aggregation buffer, which a
postal code holding a third of all sales would overflow. Here the rows are first counted
per (group, value cell) with map-side combination; running counts over the cells, whose
number is bounded by the value range, tell which cell holds the middle ranks; only that
cell's rows, again pre-counted per value, are ranked.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_CELL = 25.0


def _cells(df: DataFrame, value: str, cell_width: float | None):
    v = F.col(value)
    if cell_width is None:  # unbounded positive values: cells of 1 % width
        return F.floor(F.log(v) / F.lit(0.01)).cast("long")
    return F.floor(v / F.lit(float(cell_width))).cast("long")


def grouped_stats(df: DataFrame, keys: list[str], value: str, *, sums: dict | None = None,
                  firsts: dict | None = None, cell_width: float | None = DEFAULT_CELL) -> DataFrame:
    """Per group: ``n``, ``mean``, ``low``, ``high``, ``median`` of ``value`` (NULLs ignored).

    ``sums`` names further numeric columns averaged over their non-null rows, ``firsts``
    text columns whose smallest value is kept: ``{output name: Column}``.
    """
    sums, firsts = sums or {}, firsts or {}
    extra = {f"_s_{n}": c for n, c in sums.items()} | {f"_f_{n}": c for n, c in firsts.items()}
    rows = df.filter(F.col(value).isNotNull()).withColumns({**extra, "_cell": _cells(df, value, cell_width)}).select(
        *keys, F.col(value).alias("_v"), "_cell", *extra)

    per_cell = rows.groupBy(*keys, "_cell").agg(
        F.count(F.lit(1)).alias("_n"), F.sum("_v").alias("_sum"), F.min("_v").alias("_low"), F.max("_v").alias("_high"),
        *[F.sum(f"_s_{n}").alias(f"_s_{n}") for n in sums],
        *[F.count(f"_s_{n}").alias(f"_c_{n}") for n in sums],
        *[F.min(f"_f_{n}").alias(f"_f_{n}") for n in firsts],
    )
    # Running and whole sums over a group's cells (their number is bounded by the value range).
    # The group's figures ride along as one struct on its middle cells, so the aggregate
    # above is computed once.
    run = Window.partitionBy(*keys).orderBy("_cell").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy(*keys)

    def total(c):
        return F.sum(c).over(whole)

    figures = F.struct(
        total("_n").alias("n"), (total("_sum") / total("_n")).alias("mean"),
        F.min("_low").over(whole).alias("low"), F.max("_high").over(whole).alias("high"),
        *[F.try_divide(total(f"_s_{n}"), total(f"_c_{n}")).alias(n) for n in sums],
        *[F.min(f"_f_{n}").over(whole).alias(n) for n in firsts])
    running = per_cell.select(*keys, "_cell", "_n", F.sum("_n").over(run).alias("_upto"), figures.alias("_all")).withColumns({
        "_before": F.col("_upto") - F.col("_n"),
        "_lower": F.floor((F.col("_all.n") - 1) / 2), "_upper": F.floor(F.col("_all.n") / 2),
    })

    def inside(rank):
        return (F.col(rank) >= F.col("_before")) & (F.col(rank) < F.col("_upto"))

    # cells that hold the two middle ranks (0-based), with the rank inside the cell
    side = {k: f"_m_{k}" for k in (*keys, "_cell")}
    carried = ["_before", "_lower", "_upper", "_all"]
    middle = running.filter(inside("_lower") | inside("_upper")).select(
        *[F.col(k).alias(n) for k, n in side.items()], *carried)
    near = rows.select(*keys, "_cell", "_v").join(
        middle, [F.col(k).eqNullSafe(F.col(n)) for k, n in side.items()]
    ).groupBy(*keys, "_cell", "_v").agg(F.count(F.lit(1)).alias("_n"), *[F.first(c).alias(c) for c in carried])
    by_value = Window.partitionBy(*keys, "_cell").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = near.withColumn("_upto", F.col("_before") + F.sum("_n").over(by_value)).withColumn(
        "_before", F.col("_upto") - F.col("_n"))
    return ranked.filter(inside("_lower") | inside("_upper")).groupBy(*keys).agg(
        ((F.min("_v") + F.max("_v")) / 2).alias("median"), F.first("_all").alias("_all")
    ).select(*keys, "_all.n", "_all.mean", "median", "_all.low", "_all.high", *[f"_all.{n}" for n in (*sums, *firsts)])
