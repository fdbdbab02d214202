"""Incremental tables lose nothing, values have no hidden caps."""

import datetime as dt

from pyspark.sql import functions as F
from pyspark.sql import types as T

from gavelframe.functions.keys import title_case
from gavelframe.operators.ranking import first_distinct
from gavelframe.sinks.tables import insert_agents, merge_parts, read_key, read_parts
from gavelframe.streaming import jobs as J
from gavelframe.text import fields as FD


def _day(n, hour=0):
    return dt.datetime(2024, 1, 1) + dt.timedelta(days=n, hours=hour)


def _stream(spark, folder, batches, schema):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/in/b{i}")
    files = [spark.read.parquet(f"{folder}/in/b{i}") for i in range(len(batches))]
    for i, f in enumerate(files):  # one batch a run, in this order
        f.write.mode("append").parquet(f"{folder}/feed")
        source = J.file_stream(spark, f"{folder}/feed", f.schema)
        yield source


def test_late_equal_and_repeated_rows_reach_the_table(spark, tmp_path):
    schema = "url string, updated_at timestamp, seq int"
    batches = [
        [("a", _day(1), 1), ("b", _day(1), 1)],
        [("a", _day(150), 2), ("c", _day(150), 1), ("c", _day(150), 9), ("c", _day(150), 5)],
        [("late", _day(0), 1), ("a", _day(2), 7), ("b", _day(1), 1)],
    ]
    for source in _stream(spark, str(tmp_path), batches, schema):
        J.stream_upsert(source, f"{tmp_path}/table", f"{tmp_path}/state", order=["seq"]).awaitTermination()
    got = {r.url: (r.updated_at, r.seq) for r in read_parts(spark, f"{tmp_path}/table").collect()}
    assert got == {"a": (_day(150), 2), "b": (_day(1), 1), "c": (_day(150), 9), "late": (_day(0), 1)}


def test_live_values_are_read_and_expired_ones_hidden(spark, tmp_path):
    schema = "cache_key string, cached_at timestamp, value double"
    batches = [[("x", _day(3), 1.0), ("y", _day(3), 2.0)], [("y", _day(9), 3.0), ("x", _day(1), 9.0)]]
    for source in _stream(spark, str(tmp_path), batches, schema):
        J.stream_values(source, f"{tmp_path}/table", f"{tmp_path}/state").awaitTermination()
    live = J.live_values(spark, f"{tmp_path}/table", "2024-01-10 12:00:00", 24)
    assert [(r.cache_key, r.value) for r in live.collect()] == [("y", 3.0)]


def test_a_batch_rewrites_only_its_parts_and_may_be_replayed(spark, tmp_path):
    base = f"{tmp_path}/table"
    rows = spark.range(200).select(F.col("id").cast("string").alias("k"), F.lit(1).alias("v"))
    merge_parts(rows, base, ["k"], order=["v"], batch="a-0", parts=16)
    stamp = {p: p.stat().st_mtime_ns for p in (tmp_path / "table").rglob("*.parquet")}
    one = spark.createDataFrame([("7", 2, "x"), (None, 3, "y"), (None, 3, "y")], "k string, v int, more string")
    for _ in range(2):  # as after a break between staging and putting in place
        merge_parts(one, base, ["k"], order=["v"], batch="a-1", parts=16)
    got = read_parts(spark, base)
    assert got.count() == 202 and [tuple(r) for r in got.filter("k = '7'").collect()] == [("7", 2, "x")]
    assert got.filter("k is null").count() == 2
    now = {p: p.stat().st_mtime_ns for p in (tmp_path / "table").rglob("*.parquet")}
    kept = {p.parent for p, t in stamp.items() if now.get(p) == t}
    assert len(kept) >= 14
    merge_parts(one.filter("false"), base, ["k"], order=["v"], batch="a-2", parts=16)
    assert read_parts(spark, base).count() == 202


def test_one_batch_number_may_stand_for_different_rows(spark, tmp_path):
    base = f"{tmp_path}/table"
    rows = lambda *k: spark.createDataFrame([(x, 1) for x in k], "k string, v int")
    merge_parts(rows("a"), base, ["k"], order=["v"], batch="0")
    merge_parts(rows("b", None), base, ["k"], order=["v"], batch="0")
    merge_parts(rows("b", None), base, ["k"], order=["v"], batch="0")  # a replay
    merge_parts(rows("c"), base, ["k"], order=["v"])
    merge_parts(rows("d"), base, ["k"], order=["v"])
    assert sorted(str(r.k) for r in read_parts(spark, base).collect()) == ["None", "a", "b", "c", "d"]
    assert not list((tmp_path / "table_staged").iterdir())


def test_a_new_checkpoint_goes_on_with_an_old_table(spark, tmp_path):
    schema = "url string, updated_at timestamp, seq int"
    for i in range(2):
        spark.createDataFrame([(f"u{i}", _day(i), 1)], schema).write.parquet(f"{tmp_path}/feed{i}")
        source = J.file_stream(spark, f"{tmp_path}/feed{i}", spark.read.parquet(f"{tmp_path}/feed{i}").schema)
        J.stream_upsert(source, f"{tmp_path}/table", f"{tmp_path}/state{i}").awaitTermination()
    assert {r.url for r in read_parts(spark, f"{tmp_path}/table").collect()} == {"u0", "u1"}


def test_parts_are_halved_as_the_table_grows(spark, tmp_path):
    base = f"{tmp_path}/table"
    sizes = []
    for i in range(4):
        rows = spark.range(3000).selectExpr(f"concat('k', id + {2000 * i}) as k", f"{i} as v", "sha2(string(id), 256) as text")
        merge_parts(rows, base, ["k"], order=["v"], parts=2, part_bytes=40_000)
        sizes.append(max(sum(f.stat().st_size for f in p.glob("*.parquet")) for p in (tmp_path / "table").glob("_part=*")))
    got = {r.k: r.v for r in read_parts(spark, base).collect()}
    assert got == {f"k{n}": max(i for i in range(4) if 2000 * i <= n < 2000 * i + 3000) for n in range(9000)}
    labels = {p.name for p in (tmp_path / "table").glob("_part=*")}
    assert any("." in x and not x.endswith(".") for x in labels) and max(sizes) < 3 * min(sizes)
    for k in ("k0", "k4999", "k8999"):
        assert [r.v for r in read_key(spark, base, {"k": k}, parts=2).collect()] == [got[k]]
    assert read_key(spark, base, {"k": "none"}, parts=2).count() == 0


def test_one_live_value(spark, tmp_path):
    rows = spark.createDataFrame([("x", _day(3), 1.0), ("y", _day(9), 2.0)], "cache_key string, cached_at timestamp, value double")
    merge_parts(rows, f"{tmp_path}/table", ["cache_key"], order=["cached_at"])
    ask = lambda k: J.live_value(spark, f"{tmp_path}/table", k, "2024-01-10 12:00:00", 24)
    assert [r.value for r in ask("y").collect()] == [2.0] and ask("x").collect() == []


def test_agents_have_ids_of_their_own(spark):
    schema = "agent_id long, name string, firm string, phone string, email string"
    rows = [(None, "A", None, "1", "e"), (None, "A", None, "1", "e"), (None, "A", "", "1", "e"), (None, "A", None, "2", "e"), (None, None, "A", "1", "e")]
    none = spark.createDataFrame([], schema)
    got = insert_agents(none, spark.createDataFrame(rows, schema)).collect()
    assert len(got) == 5 and len({r.agent_id for r in got}) == 5


def test_long_values_stay_whole(spark):
    word = "x" * 20_000
    body = "Désignation : " + "mot " * 750
    row = spark.createDataFrame([(word, body, [f"d{i}" for i in range(30)])], "w string, body string, items array<string>").select(
        title_case("w").alias("w"), FD.description("body").alias("d"), FD.description("body", 2000).alias("d2"),
        first_distinct("items").alias("i")).first()
    assert row.w == "X" + "x" * 19_999 and len(row.d) == 2999 and len(row.d2) <= 2000 and len(row.i) == 30


def test_many_documents_and_photos_stay(spark):
    html = "".join(f'<img src="/photos/p{i}.jpg">' for i in range(30))
    docs = F.transform(F.sequence(F.lit(1), F.lit(12)), lambda i: F.struct(
        F.concat(F.lit("doc "), i.cast("string")).alias("name"), F.lit("u").alias("url"), F.lit("t").alias("type")))
    row = spark.createDataFrame([(html,)], "html string").select(
        F.size(FD.photos("html")).alias("p"), F.size(FD.merge_document_list(docs, F.lit("https://r/r.pdf"))).alias("d")).first()
    assert row.p == 30 and row.d == 13


def test_written_date_comes_before_the_numeric_one(spark):
    from gavelframe.text import patterns as P
    assert [i for i, p in enumerate(P.SALE_DATES_LOW) if "/" in p] == [2, 3]


def test_expired_values_over_restarts(spark, tmp_path):
    """Out-of-order rows within the delay, over three restarts: the newest value of every quiet run, each once."""
    schema = "cache_key string, cached_at timestamp, value double"
    batches = [
        [("x", _day(1, 0), 1.0), ("x", _day(1, 2), 2.0), ("y", _day(1, 1), 5.0)],
        [("x", _day(1, 1), 9.0), ("y", _day(2, 0), 6.0), ("x", _day(1, 20), 3.0)],  # the first is late, but within the delay
        [("x", _day(2, 4), 4.0), ("z", _day(4, 0), 7.0), ("x", _day(2, 4), 4.0)],
    ]
    for source in _stream(spark, str(tmp_path), batches, schema):
        q = (J.expired_values(source, "6 hours", "2 days").writeStream.outputMode("append").format("parquet").option("path", f"{tmp_path}/out")
             .option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start())
        q.awaitTermination()
    got = sorted((r.cache_key, r.cached_at, r.value, r.expires_at) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    # the watermark ends at day 2: what expires until then has expired
    assert got == [("x", _day(1, 2), 2.0, _day(1, 8)), ("y", _day(1, 1), 5.0, _day(1, 7))]


def test_weekly_counts_change_only_their_weeks(spark, tmp_path):
    schema = "visit_at timestamp, amount double"
    batches = [[(_day(0), 1.0), (_day(8), 2.0)], [(_day(1), 3.0)], [(_day(9), 4.0), (_day(15), 6.0)]]
    for source in _stream(spark, str(tmp_path), batches, schema):
        J.stream_weekly_stats(source, f"{tmp_path}/table", f"{tmp_path}/state").awaitTermination()
    got = sorted(tuple(r) for r in read_parts(spark, f"{tmp_path}/table").select("week", "n_visits", "mean_amount").collect())
    assert got == [(_day(0).date(), 2, 2.0), (_day(7).date(), 2, 3.0), (_day(14).date(), 1, 6.0)]


def test_expired_values_take_one_state_value_and_timer_a_key(spark):
    """The calls a key costs do not grow with its rows and sessions (before: several a session)."""
    calls = []

    class Store:
        held = None
        def get(self): calls.append("get"); return self.held  # noqa: E704
        def update(self, v): calls.append("update"); self.held = v  # noqa: E704
        def clear(self): calls.append("clear"); self.held = None  # noqa: E704

    class Handle:
        timers = set()
        def getValueState(self, name, schema): return Store()  # noqa: E704, N802
        def registerTimer(self, at): calls.append("register"); self.timers.add(at)  # noqa: E704, N802
        def deleteTimer(self, at): calls.append("delete"); self.timers.discard(at)  # noqa: E704, N802

    class At:
        def __init__(self, ms): self.ms = ms  # noqa: E704
        def getCurrentWatermarkInMs(self): return self.ms  # noqa: E704, N802
        getExpiryTimeInMs = getCurrentWatermarkInMs  # noqa: N815

    ttl = 6 * 3600 * 1000
    s = J._Sessions(ttl, "k", "t", ["v"], T.StructType([]))
    s.init(Handle())
    rows = [{"t": _day(n, h), "v": float(n + h)} for n in range(50) for h in (3, 0, 8)]  # two runs a day: hours 0 and 3, hour 8 is 5 on
    rows += [{"t": _day(n, 16), "v": 1.0} for n in range(50)]
    list(s.handleInputRows(("x",), iter(rows[::-1]), At(0)))
    assert len(calls) == 3 and len(s.handle.timers) == 1
    first = s.handle.timers.pop()
    watermark = J._millis(_day(30))
    out = list(s.handleExpiredTimer(("x",), At(watermark), At(first)))
    assert len(calls) == 6 and len(s.handle.timers) == 1
    assert sorted((r.t, r.v) for r in out) == sorted([(_day(n, 8), float(n + 8)) for n in range(30)] + [(_day(n, 16), 1.0) for n in range(30)])


def test_parts_are_written_once_and_a_broken_move_is_finished(spark, tmp_path, monkeypatch):
    """The files of the table are the staged ones, moved; a batch that breaks off between two parts is finished by its replay."""
    from gavelframe.sinks import tables as TB
    base = f"{tmp_path}/table"
    rows = spark.range(200).select(F.col("id").cast("string").alias("k"), F.lit(1).alias("v"))
    staged = set()
    put = TB._put_in_place

    def broken(session, folder, table):
        root = type(tmp_path)(folder)
        staged.update(p.name for p in root.rglob("*.parquet"))
        first = sorted(root.glob("_part=*"))[0]
        (tmp_path / "table").mkdir(exist_ok=True)
        first.rename(tmp_path / "table" / first.name)
        raise RuntimeError("stopped")
    monkeypatch.setattr(TB, "_put_in_place", broken)
    try:
        merge_parts(rows, base, ["k"], order=["v"], batch="a-0", parts=4)
    except RuntimeError:
        pass
    monkeypatch.setattr(TB, "_put_in_place", put)
    merge_parts(rows, base, ["k"], order=["v"], batch="a-0", parts=4)
    assert read_parts(spark, base).count() == 200
    assert staged == {p.name for p in (tmp_path / "table").rglob("*.parquet")}


def test_a_replay_writes_nothing(spark, tmp_path, monkeypatch):
    from gavelframe.sinks import tables as TB
    base = f"{tmp_path}/table"
    rows = spark.range(20).select(F.col("id").cast("string").alias("k"), F.lit(1).alias("v"))
    merge_parts(rows, base, ["k"], order=["v"], batch="a-0", parts=2)
    monkeypatch.setattr(TB, "stored", lambda df: 1 / 0)
    merge_parts(rows, base, ["k"], order=["v"], batch="a-0", parts=2)
    assert read_parts(spark, base).count() == 20
