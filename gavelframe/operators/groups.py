"""Positions inside groups of any size, and the checkpoint folder of iterative jobs."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


SLICE_ROWS = 1_000_000


def positions(df: DataFrame, keys: list[str], order: str, out: str, *, lead: list[str] = (), tie: list[str] = (),
              slice_rows: int = SLICE_ROWS) -> DataFrame:
    """1-based position of every row in its group by ``(lead descending, order, tie)``.

    ``order`` is an integer. Groups are cut into slices of the order's range; rows are ranked per slice and
    slices are offset by the running count, so a huge group is ranked by many tasks.
    """
    cut = df.withColumn("_cut", F.floor(F.col(order) / slice_rows))
    parts = [*keys, *lead, "_cut"]
    within = Window.partitionBy(*parts).orderBy(order, *tie)
    sizes = cut.groupBy(*parts).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in lead], F.col("_cut")).rowsBetween(
        Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    ranked = cut.withColumn("_in", F.row_number().over(within))
    return ranked.join(offsets, parts).withColumn(out, F.col("_off") + F.col("_in")).drop("_cut", "_off", "_in")


def spread(rows: DataFrame, *columns: str) -> DataFrame:
    """Rows dealt over the configured number of partitions, before work that is dear per row.

    A number of its own keeps a small file, which one task scans, or a coalesced shuffle from leaving all to one task.
    """
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *columns)


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder the session names; a local session without one gets a folder below its warehouse."""
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and (not context.master.startswith("local") or context.master.startswith("local-cluster")):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    context.setCheckpointDir(named or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints")


def stored(df: DataFrame) -> DataFrame:
    """``df`` written below the checkpoint folder and read again: lineage ends, and its size is known to the planner."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
