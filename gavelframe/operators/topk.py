"""Top-k per key that survives hot keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def top_k_per_key(df: DataFrame, keys: list[str], order: list, k: int, *,
                  rank: str = "rank", salts: int = 0) -> DataFrame:
    """The ``k`` first rows of every key by ``order``.

    Spark trims each map task to ``k`` rows per key before the shuffle
    (``WindowGroupLimit``). A key that holds a large share of all rows still meets
    in one task with ``k`` rows from every map task; with ``salts`` the rows pass a
    first round over (key, slice of map tasks), so the last task sees at most
    ``salts * k`` rows of a key. The answer does not depend on the slicing: the best ``k`` of a
    set are among the best ``k`` of each of its parts.
    """
    if salts:
        part = "_slice"
        df = df.withColumn(part, F.pmod(F.spark_partition_id(), F.lit(salts)))
        first = Window.partitionBy(*keys, part).orderBy(*order)
        df = (df.withColumn(rank, F.row_number().over(first))
                .filter(F.col(rank) <= k).drop(part, rank))
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)
