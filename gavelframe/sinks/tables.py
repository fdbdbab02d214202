"""Keyed tables on plain Parquet: upsert, insert-if-absent, atomic replacement."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gavelframe.functions.values import half_even
from gavelframe.operators.groups import ensure_checkpoint_dir, stored


def _complete_key(keys):
    ok = F.lit(True)
    for k in keys:
        ok = ok & F.col(k).isNotNull()
    return ok


def latest_by_key(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Newest row of every key by ``order``; rows with a NULL in their key all stay.

    One combinable aggregate over one reading of the rows: a key with very many versions is reduced before
    the shuffle, and a row with a NULL in its key is a group of its own by a number.
    """
    others = [c for c in rows.columns if c not in keys]
    alone = F.when(~_complete_key(keys), F.monotonically_increasing_id())
    return (rows.withColumn("_alone", alone).groupBy(*keys, "_alone")
            .agg(F.max_by(F.struct(*others), F.struct(*order)).alias("_row")).select(*keys, "_row.*"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str], *, order: list[str] = (), batch_time=None) -> DataFrame:
    """``old`` with ``new`` rows replacing equal keys; the last of a batch by ``order`` wins."""
    stamped = new if batch_time is None else new.withColumn("updated_at", F.lit(batch_time).cast("timestamp"))
    both = old.withColumn("_gen", F.lit(0)).unionByName(stamped.withColumn("_gen", F.lit(1)), allowMissingColumns=True)
    return latest_by_key(both, keys, ["_gen", *order]).drop("_gen")


def update_by_id(old: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Rows of ``old`` with the columns of ``changes`` set where the id matches; no inserts."""
    c = changes.select(key, F.struct(*[x for x in changes.columns if x != key]).alias("_new"))
    joined = old.join(c, key, "left")
    return joined.select(*[
        F.when(F.col("_new").isNotNull(), F.col(f"_new.{x}")).otherwise(F.col(x)).alias(x)
        if x in changes.columns and x != key else F.col(x) for x in old.columns])


def insert_ignore(old: DataFrame, new: DataFrame, keys: list[str], *, order: list[str] = ()) -> DataFrame:
    """``old`` plus the first new row of every absent key; rows with a NULL key never collide."""
    others = [c for c in new.columns if c not in keys]
    rank = F.struct(*(order or others))
    first = (new.filter(_complete_key(keys)).groupBy(*keys)
             .agg(F.min_by(F.struct(*others), rank).alias("_row")).select(*keys, "_row.*"))
    fresh = first.join(old.select(*keys), keys, "left_anti").unionByName(new.filter(~_complete_key(keys)))
    return old.unionByName(fresh, allowMissingColumns=True)


def insert_agents(old: DataFrame, new: DataFrame) -> DataFrame:
    """Agents unique by (name, firm), each with an id of its own.

    The id is a hash of every column, NULL told from empty text. Agents with a NULL in their key
    never collide, so equal ones of a batch are told apart by their position among their equals.
    """
    known = [c for c in new.columns if c != "agent_id"]
    marked = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("")) for c in known]
    told = new.withColumn("agent_id", F.xxhash64(*marked))
    again = Window.partitionBy("agent_id").orderBy("name")
    loose = told.filter(~_complete_key(["name", "firm"])).withColumn("_n", F.row_number().over(again)).withColumn(
        "agent_id", F.xxhash64("agent_id", "_n")).drop("_n")
    return insert_ignore(old, told.filter(_complete_key(["name", "firm"])).unionByName(loose), ["name", "firm"])


def priced_adjudications(rows: DataFrame) -> DataFrame:
    """Adjudications with their price per m²."""
    return rows.withColumn("price_m2", F.when(F.col("surface_m2") > 0, half_even(F.col("hammer_price") / F.col("surface_m2"))))


def insert_adjudications(old: DataFrame, new: DataFrame) -> DataFrame:
    """New adjudications unique by source, code, date, price; price per m² derived. Rows of ``old`` stay as they are."""
    return insert_ignore(old, priced_adjudications(new), ["source", "postal_code", "sale_date", "hammer_price"])


# --- versions: a table is a folder of complete snapshots; readers take the newest -----------

def shared_folder(spark: SparkSession, name: str = "work") -> str:
    """A fresh folder under the cluster's shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def _versions(spark: SparkSession, base: str) -> list[int]:
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(base)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return []
    done = []
    for status in fs.listStatus(root):
        name = status.getPath().getName()
        if name.startswith("version=") and fs.exists(jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")):
            done.append(int(name.split("=")[1]))
    return sorted(done)


def read_current(spark: SparkSession, base: str) -> DataFrame | None:
    """Newest complete snapshot, or None."""
    versions = _versions(spark, base)
    return spark.read.parquet(f"{base}/version={versions[-1]}") if versions else None


def write_next(df: DataFrame, base: str, version: int | None = None) -> int:
    """Write a snapshot beside the one being read; it counts once its job has committed.

    With an explicit ``version`` a repeated batch rewrites the same snapshot.
    """
    if version is None:
        versions = _versions(df.sparkSession, base)
        version = versions[-1] + 1 if versions else 0
    df.write.mode("overwrite").parquet(f"{base}/version={version}")
    return version


def upsert_table(new: DataFrame, base: str, keys: list[str], *, order: list[str] = (), version: int | None = None) -> int:
    """Upsert ``new`` into the table at ``base``. A replayed ``version`` starts from the one before."""
    spark = new.sparkSession
    versions = [v for v in _versions(spark, base) if version is None or v < version]
    old = spark.read.parquet(f"{base}/version={versions[-1]}") if versions else None
    out = latest_by_key(new, keys, list(order)) if old is None else upsert(old, new, keys, order=order)
    return write_next(out, base, version)


# --- tables by key part: a batch rewrites only the parts its keys fall into ----------------------

PARTS, PART_BYTES = 16, 256 << 20


def _at(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def _exists(spark: SparkSession, path: str) -> bool:
    fs, where = _at(spark, path)
    return fs.exists(where)


def _labels(spark: SparkSession, base: str, *, sweep: bool = False) -> dict[str, int]:
    """Bytes of each part of the table. A part whose halves are there counts no more and is swept by the next merge."""
    if not _exists(spark, base):
        return {}
    fs, root = _at(spark, base)
    found = {x.getPath().getName().removeprefix("_part="): x.getPath() for x in fs.listStatus(root) if x.getPath().getName().startswith("_part=")}
    old = _halved(found) & set(found)
    for n in old if sweep else ():
        fs.delete(found[n], True)
    return {n: fs.getContentSummary(p).getLength() for n, p in found.items() if n not in old}


def _part(keys: list[str], order: list[str], split: set[str], parts: int):
    """Label of a row's part: its number at first, then the next bit of its hash for every time the part was halved.

    Rows with a NULL in their key are spread by the order columns too.
    """
    h = F.when(_complete_key(keys), F.xxhash64(*keys)).otherwise(F.xxhash64(*keys, *order))
    label = F.concat(F.lit("p"), F.pmod(h, F.lit(parts)).cast("string"), F.lit("."))
    for depth in range(max((len(x) - x.index(".") for x in split), default=0)):
        here = sorted(x for x in split if len(x) - x.index(".") - 1 == depth)
        bit = F.shiftright(F.xxhash64(h), depth).bitwiseAND(F.lit(1)).cast("string")
        label = F.when(label.isin(here), F.concat(label, bit)).otherwise(label)
    return label


def _halved(labels) -> set[str]:
    """All parts that were halved on the way to these: the label "p3.01" comes from "p3." and "p3.0"."""
    return {x[:n] for x in labels for n in range(x.index(".") + 1, len(x))}


def read_parts(spark: SparkSession, base: str) -> DataFrame | None:
    """The table that `merge_parts` keeps at ``base``, or None."""
    labels = _labels(spark, base)
    if not labels:
        return None
    return spark.read.option("mergeSchema", True).option("basePath", base).parquet(*[f"{base}/_part={x}" for x in sorted(labels)]).drop("_part")


def read_key(spark: SparkSession, base: str, keys: dict, *, parts: int = PARTS) -> DataFrame | None:
    """The rows of one key, from the one part that can hold it; None where that part is not there."""
    labels = _labels(spark, base)
    found = spark.range(1).select(*[F.lit(v).alias(k) for k, v in keys.items()]).select(_part(list(keys), [], _halved(labels), parts)).first()[0]
    if found not in labels:
        return None
    part = spark.read.option("mergeSchema", True).parquet(f"{base}/_part={found}")
    for k, v in keys.items():
        part = part.filter(F.col(k) == F.lit(v))
    return part


def _named(spark: SparkSession, folder: str, start: str) -> bool:
    """Does the folder hold a name that starts so?"""
    if not _exists(spark, folder):
        return False
    fs, where = _at(spark, folder)
    return any(x.getPath().getName().startswith(start.replace("/", "_")) for x in fs.listStatus(where))


def _batch_name(rows: DataFrame, batch: str | None) -> str | None:
    """Name of a batch by its given name, or one of its own, and its rows; None for an empty one."""
    n, print_ = rows.agg(F.count(F.lit(1)), F.expr(f"bit_xor(xxhash64({', '.join(f'`{c}`' for c in rows.columns)}))")).first()
    return f"{batch or uuid.uuid4().hex}-{n}-{print_}".replace("/", "_") if n else None


def _put_in_place(spark: SparkSession, staged: str, base: str) -> None:
    """Move the staged parts over those of the table. A part once moved is no longer staged, so a call that broke off may be repeated."""
    fs, root = _at(spark, base)
    fs.mkdirs(root)
    for status in fs.listStatus(_at(spark, staged)[1]):
        if status.getPath().getName().startswith("_part="):
            _, place = _at(spark, f"{base}/{status.getPath().getName()}")
            if fs.exists(place):
                fs.delete(place, True)
            if not fs.rename(status.getPath(), place):
                raise OSError(f"{place.toString()} could not be put in place")


def merge_parts(new: DataFrame, base: str, keys: list[str], *, order: list[str], batch: str | None = None,
                parts: int = PARTS, part_bytes: int = PART_BYTES) -> None:
    """Merge ``new`` into the table at ``base``; per key the newest by ``order`` wins wherever it comes from.

    Only the key parts that the batch touches are read and rewritten; a touched part over ``part_bytes`` is halved on the way, so a
    part stays as large as a few tasks take, however the table grows. The parts are written whole beside the table, then moved into place.
    ``batch`` names a batch and its writer, as in "id of the query-number": the same rows under the same name are a replay and
    change nothing, or finish what broke off; other rows under that name are a batch of their own. Without a name every call
    counts. Rows with a NULL in their key all stay. An empty batch changes nothing. Give a table the same ``parts`` always, and
    one writer at a time; readers see whole parts, but maybe of two batches while one is put in place.
    """
    spark = new.sparkSession
    if batch and _named(spark, f"{base}_batches", f"{batch}-") and _exists(spark, f"{base}_batches/{_batch_name(new, batch)}"):
        return  # a replay is known before anything is written
    held = stored(new)  # the batch is read once, whatever it is made of
    name = _batch_name(held, batch)
    if name is None:
        return
    done, staged = f"{base}_batches/{name}", f"{base}_staged/{name}"
    if _exists(spark, done):
        return
    if not _exists(spark, f"{staged}/_SUCCESS"):
        labels = _labels(spark, base, sweep=True)
        split = _halved(labels)
        told = held.withColumn("_part", _part(keys, order, split, parts))
        touched = sorted(r[0] for r in told.select("_part").distinct().collect())  # at most as many as the table has parts
        there = [x for x in touched if x in labels]
        if there:
            old = spark.read.option("mergeSchema", True).option("basePath", base).parquet(*[f"{base}/_part={x}" for x in there])
            told = old.unionByName(told, allowMissingColumns=True)
        big = {x for x in there if labels[x] > part_bytes}
        merged = latest_by_key(told, keys, order).withColumn("_part", _part(keys, order, split | big, parts)).hint("rebalance", "_part")
        merged.write.mode("overwrite").partitionBy("_part").parquet(staged)
    _put_in_place(spark, staged, base)
    fs, mark = _at(spark, done)
    fs.mkdirs(mark)
    fs.delete(_at(spark, staged)[1], True)
