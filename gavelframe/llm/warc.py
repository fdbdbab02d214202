"""Deterministic sharded WARC writer, and the reader of what it wrote.

Records are range-sorted: page ids are cut into `RANGES` equal ranges, bytes per range are counted,
and ranges with about equal payload form a shard. The layout depends on the rows alone, not on the
cluster. Each shard is written in page order as gzip members; a file is rolled when its compressed
size passes `roll_bytes`. Record ids, dates and digests are derived from the content.

Equal payloads: the smallest page id of a digest is the response, the others are revisits that name
it. The page ids of revisits travel as small rows of their own that sort just before the page, so the
html is shuffled once and a digest with a third of all pages needs no group anywhere.

Commit: tasks write below `_tmp` under names of their own attempt and return a manifest row for each
closed file; a second job renames what the manifest lists, and may be repeated. Files of lost or
speculative attempts are never listed, so readers, who start from the manifest, don't see them.

A null html is an empty payload, a null url is left out. Pages without an id come last, those whose
payload has an identified page revisit it. Rows that repeat id and payload: the first is written as
its kind, the others revisit the response. No rows give an empty archive. Page ids of any integer type count as long;
other columns are not looked at, whatever their names.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import os
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gavelframe.llm.base import fresh_dir, partitions, table, written

RANGES = 16384
MIB = 1 << 20
MANIFEST = "shard int, seq int, name string, temp string, records long, bytes long, sha1 string"
FOUND = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


class Folder:
    """A folder on a shared mount, or in any store that pyarrow opens."""

    def __init__(self, uri: str):
        self.fs = None
        if uri.startswith("file:") or "://" not in uri:
            self.path = "/" + uri.removeprefix("file:").lstrip("/") if uri.startswith("file:") else uri
        else:
            from pyarrow import fs
            self.fs, self.path = fs.FileSystem.from_uri(uri)

    def _at(self, name: str) -> str:
        return f"{self.path}/{name}"

    def create(self, name: str):
        if self.fs:
            self.fs.create_dir(os.path.dirname(self._at(name)), recursive=True)
            return self.fs.open_output_stream(self._at(name))
        os.makedirs(os.path.dirname(self._at(name)), exist_ok=True)
        return open(self._at(name), "wb")

    def open(self, name: str):
        return self.fs.open_input_stream(self._at(name)) if self.fs else open(self._at(name), "rb")

    def rename(self, temp: str, name: str) -> None:
        """Idempotent: a file that a former attempt of the commit has renamed stays."""
        if self.fs:
            from pyarrow import fs
            if self.fs.get_file_info(self._at(temp)).type != fs.FileType.NotFound:
                self.fs.move(self._at(temp), self._at(name))
            elif self.fs.get_file_info(self._at(name)).type == fs.FileType.NotFound:
                raise FileNotFoundError(self._at(temp))
        elif os.path.exists(self._at(temp)):
            os.replace(self._at(temp), self._at(name))
        elif not os.path.exists(self._at(name)):
            raise FileNotFoundError(self._at(temp))


def _record_id(*parts) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha1(repr(parts).encode()).digest()[:16], version=5)}>"


def _b32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def _line(text: str) -> str:
    """One header line's worth: control characters are percent-encoded."""
    return "".join(c if ord(c) >= 32 and ord(c) != 127 else f"%{ord(c):02X}" for c in text)


def encode(page_id, url, payload: bytes, first, repeat: bool, date: str) -> bytes:
    """One record as a gzip member. `first`: the page it revisits; `repeat`: a row that came before."""
    raw = hashlib.sha1(payload).digest()
    revisit = repeat or first is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    origin = page_id if first is None else first
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {_record_id(page_id, _b32(raw), 'revisit' if revisit else 'response')}", f"WARC-Date: {date}",
        *([f"WARC-Target-URI: {_line(url)}"] if url is not None else []),
        *([f"X-Page-Id: {page_id}"] if page_id is not None else []),
        f"WARC-Payload-Digest: sha1:{_b32(raw)}", f"WARC-Block-Digest: sha1:{_b32(hashlib.sha1(block).digest())}",
    ]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                 f"WARC-Refers-To: {_record_id(origin, _b32(raw), 'response')}",
                 *([f"X-Refers-To-Page: {origin}"] if origin is not None else [])]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    member = zlib.compressobj(4, zlib.DEFLATED, 31)
    return member.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + member.flush()


def layout(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Rows to write: shard, page_id, digest, kind (0 names the page a revisit refers to, 1 is a page), url, html, first."""
    body = F.coalesce("html", F.lit(""))
    keys = pages.select("page_id", F.sha1(body.cast("binary")).alias("digest"), F.octet_length(body).cast("long").alias("n"))
    firsts = keys.where(F.col("n") >= min_bytes).groupBy("digest").agg(
        F.min("page_id").alias("first"), F.count(F.lit(1)).alias("c")).where("c > 1").select("digest", "first")
    refs = keys.join(firsts, "digest").where("first is not null and not page_id <=> first").select("page_id", "digest", "first").distinct()

    low, high, total = keys.agg(F.min("page_id"), F.max("page_id"), F.sum("n")).first()
    low, high, total = low or 0, high or 0, total or 0
    width = (high - low) // RANGES + 1
    span = F.expr(f"coalesce((page_id - {low}L) div {width}L, {RANGES}L)")
    shard_bytes = min(256 * MIB, max(2 * MIB, total // 256))
    before = Window.orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    # at most RANGES + 1 rows
    shards = keys.groupBy(span.alias("span")).agg(F.sum("n").alias("n")).select(
        "span", (F.coalesce(F.sum("n").over(before), F.lit(0)) / shard_bytes).cast("int").alias("shard"))
    rows = pages.select("page_id", F.sha1(body.cast("binary")).alias("digest"), F.lit(1).alias("kind"), "url", body.alias("html"),
                        F.lit(None).cast("long").alias("first")).unionByName(
        refs.select("page_id", "digest", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("url"),
                    F.lit(None).cast("string").alias("html"), "first"))
    return rows.withColumn("span", span).join(F.broadcast(shards), "span").drop("span")


def write(pages: DataFrame, folder: str, roll_bytes: int = 64 * MIB, min_bytes: int = 0,
          date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write (page_id, url, html) below `folder`; returns the committed manifest."""
    spark = pages.sparkSession
    info = "\r\n".join(["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: {_record_id('info')}", f"WARC-Date: {date}",
                        "Content-Type: application/warc-fields", "Content-Length: 0", "", "", "", ""]).encode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target, out, state = Folder(folder), None, {}

        def close() -> pa.RecordBatch:
            out.close()
            row = {k: [state[k]] for k in ("shard", "seq", "name", "temp", "records", "bytes")} | {"sha1": [state["sum"].hexdigest()]}
            return pa.RecordBatch.from_arrays(
                [pa.array(row[n], t) for n, t in zip(row, (pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()))],
                list(row))

        def put(data: bytes) -> None:
            out.write(data)
            state["bytes"] += len(data)
            state["sum"].update(data)

        refs, last, seen = {}, None, set()
        for batch in batches:
            for r in zip(*(batch.column(i).to_pylist() for i in range(7))):
                shard, page_id, digest, kind, url, html, first = r
                if last != (shard, page_id):
                    refs, seen, last = {}, set(), (shard, page_id)
                if kind == 0:
                    refs[digest] = first
                    continue
                payload = html.encode("utf-8", "surrogatepass")
                repeat = len(payload) >= min_bytes and digest in seen
                seen.add(digest)
                if out is not None and (state["shard"] != shard or state["bytes"] >= roll_bytes):
                    yield close()
                    state["seq"], out = (state["seq"] + 1 if state["shard"] == shard else 0), None
                if out is None:
                    seq = state.get("seq", 0)
                    name = f"part-{shard:06d}-{seq:05d}.warc.gz"
                    state = {"shard": shard, "seq": seq, "name": name, "temp": f"_tmp/{name}.{uuid.uuid4().hex}", "records": 0,
                             "bytes": 0, "sum": hashlib.sha1()}
                    out = target.create(state["temp"])
                    put(gzip.compress(info, mtime=0))
                put(encode(page_id, url, payload, refs.get(digest), repeat, date))
                state["records"] += 1
        if out is not None:
            yield close()

    rows = layout(pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html"), min_bytes)
    ordered = rows.repartition(partitions(spark), "shard").sortWithinPartitions(
        "shard", F.col("page_id").asc_nulls_last(), "kind", "digest", "url")
    files = written(ordered.select("shard", "page_id", "digest", "kind", "url", "html", "first").mapInArrow(run, MANIFEST), "warc-files")

    def commit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target = Folder(folder)
        for batch in batches:
            for temp, name in zip(batch.column(3).to_pylist(), batch.column(2).to_pylist()):
                target.rename(temp, name)
            yield batch

    files.mapInArrow(commit, MANIFEST).write.parquet(f"{folder}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of an open archive, one record in memory at a time."""
    with gzip.GzipFile(fileobj=stream) as lines:
        while True:
            line = lines.readline()
            if not line:
                return
            if not line.startswith(b"WARC/"):
                continue
            head = {}
            while (line := lines.readline()).strip():
                k, _, v = line.decode().rstrip("\r\n").partition(": ")
                head[k] = v
            yield head, lines.read(int(head["Content-Length"]))


def read(spark: SparkSession, folder: str, check: bool = True) -> DataFrame:
    """Pages of the archives that the manifest of `folder` lists; block and payload digests are verified."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source = Folder(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                found: list[tuple] = []
                with source.open(name) as stream:
                    for head, block in records(stream):
                        if head["WARC-Type"] == "warcinfo":
                            continue
                        digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
                        http, _, payload = block.partition(b"\r\n\r\n")
                        length = int(http.rpartition(b"Content-Length: ")[2])
                        if check and (head["WARC-Block-Digest"] != f"sha1:{_b32(hashlib.sha1(block).digest())}"
                                      or head["WARC-Type"] == "response" and (
                                          _b32(hashlib.sha1(payload).digest()) != digest or len(payload) != length)):
                            raise ValueError(f"{name}: digest of {head['WARC-Record-ID']} differs")
                        page, ref = head.get("X-Page-Id"), head.get("X-Refers-To-Page")
                        found.append((page and int(page), head.get("WARC-Target-URI"), length, digest, head["WARC-Type"], ref and int(ref)))
                if found:
                    kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(zip(*found), kinds)],
                        ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    names = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest").select("name")
    return names.repartition(partitions(spark), "name").mapInArrow(run, FOUND)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh_dir(spark, "warc")
    write(table(spark, sf_dir, "pages"), folder)
    return read(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP8_SQL = """
WITH hashed AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
named AS (
  SELECT page_id, payload_bytes, min(page_id) OVER (PARTITION BY h) AS first_id,
    row_number() OVER (PARTITION BY h ORDER BY page_id) AS place,
    array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      (((('0x' || substr(h, 5 * (i // 4) + 1, 5))::INT >> (15 - 5 * (i % 4))::INT) & 31) + 1)::INT, 1)), '') AS payload_digest
  FROM hashed)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN place = 1 THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN place > 1 THEN first_id END AS refers_to
FROM named
"""
