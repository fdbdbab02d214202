"""Incremental jobs: keyed ingest, values that expire, weekly counts."""

from __future__ import annotations

import datetime as dt
from bisect import bisect_right

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from gavelframe.sinks.tables import PARTS, merge_parts, read_key, read_parts


def file_stream(spark: SparkSession, folder: str, schema, *, files_per_batch: int | None = None, name_filter: str | None = None) -> DataFrame:
    """Parquet files appearing in a folder as a stream."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    if name_filter:
        reader = reader.option("pathGlobFilter", name_filter)
    return reader.parquet(folder)


def stream_upsert(rows: DataFrame, base: str, checkpoint: str, *, key: str = "url", time: str = "updated_at",
                  order: list[str] = (), parts: int = PARTS) -> StreamingQuery:
    """Upsert a stream of listings into the table at ``base``, all data available now.

    Nothing is dropped before the upsert: late rows, rows of one time and repeats all reach it,
    and the newest by (time, order) of table and batch together stays. A batch rewrites only the
    key parts it touches, and a replayed batch is harmless: it is named by the id of the query, which the
    checkpoint keeps, so a new checkpoint on an old table goes on with it. `read_parts` reads the table.
    """
    def merge(batch: DataFrame, batch_id: int) -> None:
        query = batch.sparkSession.read.json(f"{checkpoint}/metadata").first()["id"]
        merge_parts(batch, base, [key], order=[time, *order], batch=f"{query}-{batch_id}", parts=parts)

    return (rows.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def weekly_counts(visits: DataFrame, delay: str = "30 days") -> DataFrame:
    """Visits and mean amount per Monday-based week (epoch day 0 is a Thursday, so weeks start 4 days on).

    On a stream a week's state is kept until ``delay`` behind its end; later rows are dropped.
    """
    week = F.window("visit_at", "7 days", startTime="4 days")
    return (visits.withWatermark("visit_at", delay).groupBy(week.alias("w"))
            .agg(F.count(F.lit(1)).alias("n_visits"), F.avg("amount").alias("mean_amount"))
            .select(F.col("w.start").cast("date").alias("week"), "n_visits", "mean_amount"))


def stream_weekly_stats(visits: DataFrame, base: str, checkpoint: str) -> StreamingQuery:
    """Keep the weekly counts as a table, one row per week: a batch rewrites the weeks it changes.

    Counts only grow, so the row of most visits is the newest. `read_parts` reads the table.
    """
    def keep(batch: DataFrame, batch_id: int) -> None:
        query = batch.sparkSession.read.json(f"{checkpoint}/metadata").first()["id"]
        merge_parts(batch, base, ["week"], order=["n_visits"], batch=f"{query}-{batch_id}", parts=1)

    return (weekly_counts(visits).writeStream.outputMode("update").foreachBatch(keep)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def stream_values(values: DataFrame, base: str, checkpoint: str, *, key: str = "cache_key", time: str = "cached_at",
                  order: list[str] = (), parts: int = PARTS) -> StreamingQuery:
    """Keep the newest value of each key as a table; `live_values` reads it."""
    return stream_upsert(values, base, checkpoint, key=key, time=time, order=order, parts=parts)


def live_values(spark: SparkSession, base: str, now, hours: int, *, key: str = "cache_key", time: str = "cached_at") -> DataFrame:
    """The table's values that are younger than ``hours`` at ``now``; expired ones are hidden."""
    return latest_fresh(read_parts(spark, base), now, hours, key=key, time=time)


def live_value(spark: SparkSession, base: str, value: str, now, hours: int, *, key: str = "cache_key", time: str = "cached_at",
               parts: int = PARTS) -> DataFrame | None:
    """The value of one key, if it is younger than ``hours`` at ``now``: only the part that can hold it is read."""
    found = read_key(spark, base, {key: value}, parts=parts)
    return None if found is None else latest_fresh(found, now, hours, key=key, time=time)


class _Sessions(StatefulProcessor):
    """Open sessions of a key: rows less than ``ttl`` apart are one, and its newest value expires ``ttl`` after it.

    The sessions of a key, (end, first, time, others) by end, are one state value with one timer, that of the first to
    expire: a batch or an expiry costs a key a few calls to the store, however many sessions it has. Sessions lie ``ttl``
    apart, so their number is bounded by the time they span.
    """

    def __init__(self, ttl_ms: int, key: str, time: str, others: list[str], run: T.StructType):
        self.ttl, self.key, self.time, self.others, self.run = ttl_ms, key, time, others, run

    def init(self, handle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", T.StructType([T.StructField("runs", T.ArrayType(self.run))]))

    def _runs(self) -> list[tuple]:
        held = self.open.get()
        return [tuple(r) for r in held[0]] if held is not None else []

    def _keep(self, runs: list[tuple], timer: int | None) -> None:
        """Store the runs; ``timer`` is the one that stands now."""
        if runs:
            self.open.update((runs,))
        else:
            self.open.clear()
        due = runs[0][0] + self.ttl if runs else None
        if due != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if due is not None:
                self.handle.registerTimer(due)

    def handleInputRows(self, key, rows, timerValues):
        runs = self._runs()
        timer = runs[0][0] + self.ttl if runs else None
        ends = [r[0] for r in runs]
        for row in rows:
            at = _millis(row[self.time])
            new = (at, at, row[self.time], *(row[c] for c in self.others))
            i = j = bisect_right(ends, at - self.ttl)
            while j < len(runs) and runs[j][1] - self.ttl < at:
                j += 1
            met = runs[i:j]
            first = min([at, *(r[1] for r in met)])
            newest = max([*met, new], key=_newness)
            runs[i:j] = [(newest[0], first, *newest[2:])]
            ends[i:j] = [newest[0]]
        self._keep(runs, timer)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        runs = self._runs()
        due = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        n = bisect_right([r[0] for r in runs], due - self.ttl)
        if n:
            self._keep(runs[n:], None)
        for _, _, at, *others in runs[:n]:
            yield Row(**{self.key: key[0], self.time: at, **dict(zip(self.others, others)), "expires_at": at + dt.timedelta(milliseconds=self.ttl)})

    def close(self) -> None:
        pass


def _newness(run: tuple) -> tuple:
    """Order of rows by time; of rows of one time by their texts."""
    return run[0], run[2], tuple(map(repr, run[3:]))


def _millis(at: dt.datetime) -> int:
    return int(at.replace(microsecond=0).timestamp()) * 1000 + at.microsecond // 1000


def expired_values(values: DataFrame, ttl: str, delay: str, *, key: str = "cache_key", time: str = "cached_at") -> DataFrame:
    """Values that have expired: the newest of each run of a key's rows less than ``ttl`` apart, once ``ttl`` behind the watermark.

    Keyed state with timers: a key holds its open runs only, one entry each, in the state store (RocksDB, set for the
    session here), so a key with very many rows holds no more than its runs. ``delay`` is how far rows may come
    out of order across batches; later ones are dropped. Times count in milliseconds.
    """
    spark = values.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    others = [c for c in values.columns if c not in (key, time)]
    fields = {f.name: f for f in values.schema.fields}
    millis = int(spark.sql(f"SELECT cast(INTERVAL {ttl} AS INTERVAL DAY TO SECOND) AS t").first()["t"].total_seconds() * 1000)
    plain = lambda n: T.StructField(n, fields[n].dataType, True)
    state = T.StructType([T.StructField("_end", T.LongType()), T.StructField("_first", T.LongType()), plain(time), *[plain(c) for c in others]])
    out = T.StructType([plain(key), plain(time), *[plain(c) for c in others], T.StructField("expires_at", T.TimestampType())])
    return (values.withWatermark(time, delay).groupBy(key)
            .transformWithState(_Sessions(millis, key, time, others, state), out, "Append", "EventTime"))


def latest_fresh(values: DataFrame, now, hours: int, *, key: str = "cache_key", time: str = "cached_at") -> DataFrame:
    """Batch twin: newest value per key, only if younger than ``hours`` at ``now``."""
    from gavelframe.functions.keys import is_fresh
    others = [c for c in values.columns if c != key]
    newest = values.groupBy(key).agg(F.max_by(F.struct(*others), time).alias("v")).select(key, "v.*")
    return newest.filter(is_fresh(time, now, hours))
