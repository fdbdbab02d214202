"""Helpers shared by the corpus operators: tables, shared work folder, keyed integer mixing."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than these six.
SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: `spark.checkpoint.dir` of the session.

    Where it is unset, a local session (one machine) gets a folder of its own; any other
    master is refused, since its executors could not read each other's files.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    spark.conf.set("spark.checkpoint.dir", f"{tempfile.gettempdir()}/gavelframe-{uuid.uuid4().hex}")
    return spark.conf.get("spark.checkpoint.dir")


def fresh_dir(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str, with_path: bool = False):
    """`df` written to the shared folder and read again: lineage ends, lost executors cost nothing."""
    spark = df.sparkSession
    path = fresh_dir(spark, label)
    df.write.parquet(path)
    again = spark.read.schema(df.schema).parquet(path)
    return (again, path) if with_path else again


def deleted(spark: SparkSession, path: str) -> None:
    """Remove a folder of `written` that nothing reads any more."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# --- keyed mixing of integers, in arithmetic that any SQL engine evaluates alike -----------

def mixed(value: str, salt: int) -> str:
    """SQL text: `value` in [0, 2**31 - 2**29) to a scattered integer in [0, 2**31 - 1)."""
    salt %= 1 << 29
    return (
        f"(((((({value}) + {salt}) * 2654435761) % 4294967291) % 1073741824"
        f" * 2246822519) % 4294967279 % 1073741824 * 3266489917) % 2147483647"
    )


def folded(value: str) -> str:
    """SQL text: any bigint (null counts as -1) to [0, 2**31 - 2**29)."""
    v = f"coalesce({value}, -1)"
    return f"((({v} % 1073741789) + 1073741789) % 1073741789)"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
