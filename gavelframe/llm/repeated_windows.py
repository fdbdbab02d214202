"""Substring dedup: words in windows that also start in an earlier document, found by level-wise doubling.

A window is `length` consecutive words of one document. A word goes if a window that covers it also starts
in a document with a smaller key; windows are judged on the input, not on what is left.

1. Half length. Every window is represented by the smallest hash among the half-length windows inside it (the
   first of equal ones), a choice that depends on the window's words alone. So a window can repeat only
   if its representative does. About 1 in 13 positions represents anything, and only these travel, beside
   one hash for the whole document.
2. Twice that length. Windows whose representative occurs in another document, those alone, are hashed at
   full length and travel in turn; the smallest key that holds each decides. The asked length ends the doubling, since longer
   windows cover no further word; a batch without survivors sends nothing more.

A document whose words are all those of an earlier one is done at the first level. Hashes travel to
buckets as packed arrays, one row for each batch of documents and bucket; a hash that several documents
of a batch hold is sent once with the smallest key, so a passage that a third of all documents share is one
entry a batch. The answer is one bit a hash, in the order of the question. Texts travel once, to where the
answers for their batch arrive. Hashes have 64 bits beside the bucket number, which comes from an independent hash.
The input is read twice and must read alike, as a table does; a batch whose answers do not fit it fails.

Null and empty texts have no words and lose none. Null keys come after all others and are equal among
themselves; rows that share a key are windows of one document, so none of them takes words from another, and repeated
rows lose the same words. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gavelframe.llm.base import partitions, table
from gavelframe.llm.packs import Stretches, find_words, hash_ranges, joined_words, runs, slices, splitmix, text_bytes, window_starts

LENGTH = 50
SLICE_DOCS, SLICE_BYTES = 20_000, 8 << 20
NO_ID = np.iinfo(np.int64).max
_U = np.uint64
_K1, _K2 = _U(0xA24BAED4963EE407), _U(0x9FB21C651E98DF25)

POSTED = "grp long, batch long, tok binary, own binary, many binary"
TOLD = "batch long, bucket long, smaller binary, other binary, ids binary, off binary, data binary"
FOUND = "key long, n_words long, removed array<struct<start: long, end: long>>, kept string"
_POSTED, _TOLD = ([x.split(" ")[0] for x in s.split(", ")] for s in (POSTED, TOLD))
_SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64())])


class Texts:
    """A batch of texts cut into words, with hashes of stretches. Rows marked as gone have no text any more."""

    def __init__(self, ids: np.ndarray, data: np.ndarray, off: np.ndarray):
        self.ids, self.data, self.off = ids, data, off
        self.starts, self.ends = find_words(data, off)
        self.at = np.searchsorted(self.starts, off)
        words = hash_ranges(data, self.starts, self.ends, lower=False)
        self.hash = Stretches(words)
        self.second = Stretches(splitmix(words ^ _K2))


class Question:
    """Hashes of a batch in the order they are asked in: by bucket, then smallest key, each once."""

    def __init__(self, hashes: np.ndarray, second: np.ndarray, ids: np.ndarray, buckets: int):
        order = np.lexsort((ids, hashes))
        starts, lengths = runs(hashes[order])
        self.place = np.empty(len(hashes), np.int64)
        self.place[order] = np.repeat(np.arange(len(starts)), lengths)
        own, last = ids[order][starts], ids[order][starts + lengths - 1] if len(starts) else ids[:0]
        bucket = (second[order][starts] % _U(buckets)).astype(np.int64)
        asked = np.lexsort((own, bucket))
        back = np.empty(len(asked), np.int64)
        back[asked] = np.arange(len(asked))
        self.place = back[self.place]
        self.tok, self.own, self.bucket, self.many = hashes[order][starts][asked], own[asked], bucket[asked], (own != last)[asked]

    def rows(self, batch: int) -> pa.RecordBatch | None:
        used, sizes = runs(self.bucket)
        if not len(used):
            return None
        parts = [slice(a, a + n) for a, n in zip(used, sizes)]
        return pa.RecordBatch.from_arrays([
            pa.array(self.bucket[used]), pa.array([batch] * len(parts), pa.int64()), pa.array([self.tok[p].tobytes() for p in parts]),
            pa.array([self.own[p].tobytes() for p in parts]), pa.array([np.packbits(self.many[p]).tobytes() for p in parts])], _POSTED)

    def answers(self, told: pa.Table, column: str) -> np.ndarray:
        """Bits of all buckets, which come in any order, for each hash as given."""
        bits = {b: v for b, v in zip(told["bucket"].to_pylist(), told[column].to_pylist()) if b is not None}
        used, sizes = runs(self.bucket)
        if {b: len(v) for b, v in bits.items()} != {b: (n + 7) // 8 for b, n in zip(self.bucket[used].tolist(), sizes.tolist())}:
            raise ValueError("the documents did not read alike twice; write them to a table first")
        parts = [np.unpackbits(np.frombuffer(bits[b], np.uint8), count=n) for b, n in zip(self.bucket[used].tolist(), sizes.tolist())]
        return np.concatenate(parts).astype(bool)[self.place] if parts else np.zeros(0, bool)


def representatives(t: Texts, length: int):
    """Starts of all windows of `length` words, and of the half-length window that stands for each."""
    half = length // 2
    at = window_starts(t.at, length)
    if not len(at):
        return at, at
    small = t.hash(np.arange(len(t.starts) - half + 1), half)
    inside = np.lib.stride_tricks.sliding_window_view(small, length - half + 1)
    best = np.concatenate([inside[at[i: i + 65536]].argmin(1) for i in range(0, len(at), 65536)])
    return at, at + best


def first_question(t: Texts, length: int, buckets: int):
    """Hashes of the anchors and of the whole documents of at least `length` words."""
    at, stands = representatives(t, length)
    anchors = np.unique(stands)
    row = np.searchsorted(t.at, anchors, "right") - 1
    whole = np.flatnonzero(np.diff(t.at) >= length)
    sizes = np.diff(t.at)[whole]
    hashes = np.concatenate([t.hash(anchors, length // 2), splitmix(t.hash(t.at[whole], sizes) ^ _K1)])
    second = np.concatenate([t.second(anchors, length // 2), t.second(t.at[whole], sizes)])
    return at, stands, anchors, whole, Question(hashes, second, np.concatenate([t.ids[row], t.ids[whole]]), buckets)


def second_question(t: Texts, at: np.ndarray, length: int, buckets: int) -> Question:
    return Question(t.hash(at, length), t.second(at, length), t.ids[np.searchsorted(t.at, at, "right") - 1], buckets)


def _tell(g: pa.Table) -> pa.Table:
    """Of one bucket, to each batch: is there a smaller key with this hash, and is there any other key?"""
    toks = [np.frombuffer(v, _U) for v in g["tok"].to_pylist()]
    sizes = [len(x) for x in toks]
    tok = np.concatenate(toks)
    own = np.frombuffer(b"".join(g["own"].to_pylist()), np.int64)
    many = np.concatenate([np.unpackbits(np.frombuffer(v, np.uint8), count=n) for v, n in zip(g["many"].to_pylist(), sizes)])
    order = np.argsort(tok, kind="stable")
    starts, lengths = runs(tok[order])
    least, most = (np.repeat(f.reduceat(own[order], starts), lengths) for f in (np.minimum, np.maximum))
    several = np.repeat(np.maximum.reduceat(many[order], starts), lengths)
    smaller, other = np.empty(len(tok), bool), np.empty(len(tok), bool)
    smaller[order] = least < own[order]
    other[order] = (least < most) | (several > 0)
    cuts = np.concatenate([[0], np.cumsum(sizes)])
    parts = [slice(a, b) for a, b in zip(cuts[:-1], cuts[1:])]
    none = pa.array([None] * len(g), pa.binary())
    return pa.table([g["batch"], g["grp"], pa.array([np.packbits(smaller[p]).tobytes() for p in parts]),
                     pa.array([np.packbits(other[p]).tobytes() for p in parts]), none, none, none], names=_TOLD)


def _opened(told: pa.Table) -> Texts:
    own = told["ids"].is_valid().to_pylist().index(True)
    ids, off, data = (told[c][own].as_py() for c in ("ids", "off", "data"))
    return Texts(np.frombuffer(ids, np.int64), np.frombuffer(data, np.uint8), np.frombuffer(off, np.int64))


def _survivors(told: pa.Table, length: int, buckets: int):
    """The texts, which of them copy an earlier document, and the question of the windows that survive the first level."""
    t = _opened(told)
    at, stands, anchors, whole, q = first_question(t, length, buckets)
    smaller, other = q.answers(told, "smaller"), q.answers(told, "other")
    # a copy within the batch is not the batch's smallest key of its hash
    copy = np.zeros(len(t.ids), bool)
    mine = np.arange(len(whole)) + len(anchors)
    copy[whole] = smaller[mine] | (q.own[q.place[mine]] < t.ids[whole])
    windows = at[other[: len(anchors)][np.searchsorted(anchors, stands)] & ~copy[np.searchsorted(t.at, at, "right") - 1]]
    row = np.searchsorted(t.at, windows, "right") - 1
    return t, copy, windows, row, Question(t.hash(windows, length), t.second(windows, length), t.ids[row], buckets)


def _extend(length: int, buckets: int):
    """What survives the first level, asked for at full length."""
    def run(told: pa.Table) -> pa.Table:
        rows = _survivors(told, length, buckets)[-1].rows(told["batch"][0].as_py())
        return pa.table([[]] * len(_POSTED), pa.schema([(n, pa.int64() if i < 2 else pa.binary()) for i, n in enumerate(_POSTED)])) if rows is None \
            else pa.Table.from_batches([rows])
    return run


def _finish(length: int, buckets: int):
    def run(told: pa.Table, answers: pa.Table) -> pa.Table:
        t, copy, windows, row, q = _survivors(told, length, buckets)
        hit = windows[q.answers(answers, "smaller") | (q.own[q.place] < t.ids[row])]
        edge = np.zeros(len(t.starts) + 1, np.int64)
        np.add.at(edge, hit, 1)
        np.add.at(edge, hit + length, -1)
        dropped = (np.cumsum(edge)[:-1] > 0) | np.repeat(copy, np.diff(t.at))
        # spans are the maximal dropped stretches of each row
        row = np.repeat(np.arange(len(t.ids)), np.diff(t.at))
        new = np.concatenate([[True], (row[1:] != row[:-1]) | (dropped[1:] != dropped[:-1])]) if len(row) else np.zeros(0, bool)
        begin = np.flatnonzero(new)
        end = np.append(begin[1:], len(row)) if len(row) else begin
        spans: list[list] = [[] for _ in t.ids]
        for a, b in zip(begin[dropped[begin]].tolist(), end[dropped[begin]].tolist()):
            spans[row[a]].append({"start": a - int(t.at[row[a]]), "end": b - int(t.at[row[a]])})
        return pa.table([
            pa.array(t.ids), pa.array(np.diff(t.at)), pa.array(spans, pa.list_(_SPAN)),
            joined_words(t.data, t.starts, t.ends, t.at, ~dropped)], names=["key", "n_words", "removed", "kept"])
    return run


def without_repeated_windows(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """(key, n_words, removed, kept) of every row: the removed spans of word numbers, and the text that is left."""
    if length < 2:
        raise ValueError("a window has two words at least")
    buckets = min(65536, 16 * partitions(docs.sparkSession))

    def numbered(batches: Iterator[pa.RecordBatch]):
        number = TaskContext.get().partitionId() << 24
        for whole in batches:
            for part in slices(whole, 1, SLICE_BYTES, SLICE_DOCS):
                data, off = text_bytes(part.column(1))
                yield number, np.asarray(part.column(0)), data, off.astype(np.int64)
                number += 1

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, ids, data, off in numbered(batches):
            rows = first_question(Texts(ids, data, off), length, buckets)[-1].rows(number)
            if rows is not None:
                yield rows

    def carry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, ids, data, off in numbered(batches):
            none = pa.array([None], pa.binary())
            yield pa.RecordBatch.from_arrays([
                pa.array([number]), pa.array([None], pa.int64()), none, none,
                *[pa.array([x.tobytes()], pa.binary()) for x in (ids, off, data)]], _TOLD)

    rows = docs.select(F.coalesce(F.col(f"`{key}`").cast("long"), F.lit(int(NO_ID))).alias("key"), F.col(f"`{text}`").alias("text"))
    first = rows.mapInArrow(post, POSTED).groupBy("grp").applyInArrow(_tell, TOLD)
    # the texts stand first in the union, so that their tasks have the numbers they had when they asked
    met = rows.mapInArrow(carry, TOLD).unionByName(first).repartition(partitions(docs.sparkSession), "batch")
    second = met.groupBy("batch").applyInArrow(_extend(length, buckets), POSTED).groupBy("grp").applyInArrow(_tell, TOLD)
    # the texts lie where the batch is: both uses of `met` read the same exchange
    found = met.groupBy("batch").cogroup(second.groupBy("batch")).applyInArrow(_finish(length, buckets), FOUND)
    return found.withColumn("key", F.nullif("key", F.lit(int(NO_ID)))).withColumnRenamed("key", key)


def op11_repeated_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = without_repeated_windows(table(spark, sf_dir, "documents"))
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


OP11_SQL = rf"""
WITH docs AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^ 	-
]+') AS w FROM documents),
windows AS (
  SELECT doc_id, p, array_to_string(w[p:p + {LENGTH - 1}], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - {LENGTH - 2})) AS p FROM docs WHERE len(w) >= {LENGTH})),
firsts AS (SELECT s, min(doc_id) AS first FROM windows GROUP BY s),
hits AS (SELECT doc_id, p FROM windows JOIN firsts USING (s) WHERE first < doc_id),
words AS (SELECT doc_id, w[i] AS word, i FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM docs)),
judged AS (
  SELECT words.doc_id, word, i, coalesce(i - h.p < {LENGTH}, false) AS gone
  FROM words ASOF LEFT JOIN hits h ON words.doc_id = h.doc_id AND words.i >= h.p),
kept AS (SELECT doc_id, count_if(gone) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY i) FILTER (NOT gone), '') AS kept FROM judged GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM docs LEFT JOIN kept USING (doc_id)
"""
