"""The corpus pipeline: from raw documents to a mixed, sharded training set.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame that is
written as Parquet and read again as the next stage's docs. All but the last return the columns of
documents; the last adds shard and slot. Extra columns go along, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gavelframe.llm.base import table, written
from gavelframe.llm.decontam import clean
from gavelframe.llm.langid import identified
from gavelframe.llm.mixing import mix
from gavelframe.llm.ngram_join import without_near_duplicates
from gavelframe.llm.sharding import shard

SHARDS = 8


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language. Null and empty texts and texts without letters go; repeated rows go or stay together; ties of
    two languages go to the first in code point order. An empty table stays empty."""
    return identified(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates, that of the smallest doc_id; where ids are null or repeat, the
    first row. Documents without words are near to none and stay. An empty table stays empty."""
    return without_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of a benchmark item. Null and empty texts hold none and stay, as all do where there is no
    item; repeated rows go or stay together."""
    return clean(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target asks. Documents without words have size 0 and are drawn like the others
    of their source; a null source is one more source, the last. Rows of equal id, source and size draw each for itself."""
    return mix(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows dealt out to shards. Rows of one doc_id, null or repeated, are told apart by their text; rows equal in both follow
    one another. An empty table has no shards."""
    return shard(docs, SHARDS, "doc_id", ("text",))


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("sharding", sharding),
]

#: The first stage is a trained classifier; tests compare each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
