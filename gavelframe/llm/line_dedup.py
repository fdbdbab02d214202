"""Line dedup: near-equal lines found through their deletion neighbourhood, the earliest one kept.

A line is the sequence of words between two \\n; lines without words are not looked at. Two lines are near if
one edit of a word (replaced, inserted or left out) makes them equal; lines of fewer than `MIN_WORDS`
words must be equal. A line is dropped if an earlier occurrence, in the order (doc_id, line number),
is equal or near; the row names the earliest such occurrence. Rows that share an id are ordered, where their
line numbers are equal, by the hash of their text, then by a row number.

1. Every line becomes the hash of its words. Equal lines collapse to classes with their earliest
   occurrence (map-side combination, so a line of a third of all documents is one row a task).
2. Near lines share their first or their last half, so four hashed halves per class tell which classes have
   anybody near at all. Only documents that hold the earliest occurrence of such a class are read again; a document
   is found by its id and the hash of its text, since rows may share an id. Classes are numbered in their order.
3. Those lines emit all their variants with one word left out as hashed keys. Two lines of equal length are near
   exactly if they share a variant at the same place, and a line is near to a shorter one exactly if a variant
   equals it. Every place is kept, also within a run of equal words: the other line need not have that run. So the earliest occurrence of each (variant, place) is
   an aggregate; no pair within a group is listed.
4. The words of each line and of the earliest line found for it are compared, and only true distances stay.

Null texts have no lines. Null ids come last in the order. Rows that repeat an id are one document for
the order of their lines: of the same line only the first row's stays, and of equal rows all but one lose
every line. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gavelframe.llm.base import WORD, table, written
from gavelframe.llm.packs import find_words, hash_ranges, slices, splitmix, text_bytes

MIN_WORDS = 8
NO_ID = np.iinfo(np.int64).max
_U = np.uint64
_M = _U(0xD6E8FEB86659FD93)
_INV = _U(pow(int(_M), -1, 1 << 64))
LINES = "doc_id long, text_id long, row long, line_no int, n int, line long, halves array<long>"
PLACE = ("doc_id", "line_no", "text_id", "row")
VARIANTS = "rank long, place int, variant long"


def _power(base: np.uint64, n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([[_U(1)], np.full(max(0, n - 1), base)]))[:n]


def lines_of(col: pa.Array):
    """Word hashes of a column, offset of each line's first word, row and number of each line (lines with a word only)."""
    data, off = text_bytes(col)
    breaks = np.flatnonzero(data == 10) + 1
    bounds = np.union1d(breaks, off)
    starts, ends = find_words(data, off)
    words = hash_ranges(data, starts, ends, lower=False)
    at = np.searchsorted(starts, bounds)
    full = np.flatnonzero(np.diff(at) > 0)
    begin = bounds[full]
    row = np.searchsorted(off, begin, "right") - 1
    number = np.searchsorted(breaks, begin, "right") - np.searchsorted(breaks, off[row], "right")
    return words, np.append(at[full], len(words)), row, number


def _prefix_sums(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Running sums of word k times M**k, and M**-k: hashes of stretches are differences, moved to place 0."""
    return np.concatenate([[_U(0)], np.cumsum(words * _power(_M, len(words)), dtype=_U)]), _power(_INV, len(words) + 1)


def _stretch(sums, back, a, b):
    return (sums[b] - sums[a]) * back[a]


def whole_hash(sums, back, a, b) -> np.ndarray:
    return splitmix(_stretch(sums, back, a, b) + (b - a).astype(_U) * _U(0x9E3779B97F4A7C15))


def _halves(sums, back, a, b) -> np.ndarray:
    """Four keys a line: the first and last half of lines of its length, and of lines one word longer."""
    n, keys = b - a, []
    for length, h in ((n, n // 2), (n + 1, (n + 1) // 2)):
        for side, (x, y) in enumerate(((a, a + h), (b - h, b))):
            keys.append(splitmix(_stretch(sums, back, x, y) + (2 * length + side).astype(_U) * _U(0xA24BAED4963EE407)))
    return np.stack(keys, 1)


def lines(docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, text_id, row, line_no, n, line, halves) of every line with a word; `row` holds for this reading only."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, 3)):
            ids = np.asarray(batch.column(0).fill_null(NO_ID))
            words, at, row, number = lines_of(batch.column(3))
            if not len(row):
                continue
            sums, back = _prefix_sums(words)
            a, b = at[:-1], at[1:]
            long = b - a >= min_words
            halves = _halves(sums, back, a[long], b[long]).view(np.int64).ravel()
            offsets = np.concatenate([[0], np.cumsum(4 * long)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([
                pa.array(ids[row]), batch.column(1).take(pa.array(row)), batch.column(2).take(pa.array(row)), pa.array(number.astype(np.int32)), pa.array((b - a).astype(np.int32)),
                pa.array(whole_hash(sums, back, a, b).view(np.int64)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(halves))],
                ["doc_id", "text_id", "row", "line_no", "n", "line", "halves"])

    text_id = F.xxhash64(F.col(f"`{text}`")).alias("text_id")
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), text_id, F.monotonically_increasing_id().alias("row"), F.col(f"`{text}`").alias("text"))
    return rows.mapInArrow(run, LINES)


def variants(docs: DataFrame) -> DataFrame:
    """Of (numbers, text): (rank, place, variant) with one word left out; place -1 is the line itself."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, 1)):
            words, at, row, number = lines_of(batch.column(1))
            if not len(row):
                continue
            asked = batch.column(0).to_pylist()
            wanted = [{x["line_no"]: x["rank"] for x in xs} for xs in asked]
            rank = np.array([wanted[r].get(k, -1) for r, k in zip(row.tolist(), number.tolist())], np.int64)
            pick = rank >= 0
            rank = rank[pick]
            sums, back = _prefix_sums(words)
            a, b = at[:-1][pick], at[1:][pick]
            n = b - a
            line = whole_hash(sums, back, a, b)
            which = np.repeat(np.arange(len(a)), n)
            i = np.arange(int(n.sum())) + np.repeat(a - (np.cumsum(n) - n), n)
            kept = _stretch(sums, back, a[which], i) + (sums[b[which]] - sums[i + 1]) * back[a[which]] * _INV
            gone = splitmix(kept + (n[which] - 1).astype(_U) * _U(0x9E3779B97F4A7C15))
            yield pa.RecordBatch.from_arrays([
                pa.array(np.concatenate([rank[which], rank])),
                pa.array(np.concatenate([i - a[which], np.full(len(a), -1)]).astype(np.int32)),
                pa.array(np.concatenate([gone, line]).view(np.int64))], ["rank", "place", "variant"])

    return docs.select("numbers", "text").mapInArrow(run, VARIANTS)


def _one_edit(x: str, y: str) -> Column:
    """One word replaced, inserted or left out: but for one word, the lines share their start and their end."""
    def shared(a: str, b: str) -> str:
        return f"(coalesce(nullif(array_position(zip_with({a}, {b}, (u, v) -> u <=> v), false), 0), size({a}) + 1) - 1)"
    longer = f"greatest(size({x}), size({y}))"
    return F.expr(f"{x} <> {y} and abs(size({x}) - size({y})) <= 1 and "
                  f"{shared(x, y)} + {shared(f'reverse({x})', f'reverse({y})')} >= {longer} - 1")


def duplicate_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, line_no, first_doc_id, first_line_no, distance) of every line occurrence that is dropped."""
    found = written(lines(docs, key, text, min_words), "lines")
    place = F.struct(*PLACE)
    classes = written(found.groupBy("line").agg(
        F.min(place).alias("first"), F.count(F.lit(1)).alias("c"), F.first("halves").alias("halves")), "line-classes")
    halves = classes.select("line", F.explode("halves").alias("half"))
    shared = halves.groupBy("half").agg(F.min("line").alias("a"), F.max("line").alias("b")).where("a <> b").select("half")
    live = halves.join(shared, "half").select("line").distinct().join(classes.select("line", "first"), "line")
    # the numbers grow with the order: one number stands for a class and its place
    live = written(live.orderBy("first").withColumn("rank", F.monotonically_increasing_id()), "live-lines")

    # the lines of a text are gathered: as many as it has, not as many as the corpus or the rows of an id
    numbers = live.groupBy("first.doc_id", "first.text_id").agg(F.collect_list(F.struct("first.line_no", "rank")).alias("numbers"))
    texts = docs.select(F.coalesce(F.col(f"`{key}`").cast("long"), F.lit(int(NO_ID))).alias("doc_id"),
                        F.xxhash64(F.col(f"`{text}`")).alias("text_id"), F.col(f"`{text}`").alias("text"))
    # merged at every size: which documents are live is not a bounded table
    again = written(texts.join(numbers.hint("merge"), ["doc_id", "text_id"]), "live-texts")
    # equal rows emit the same again, which the minima below do not feel
    emitted = written(variants(again), "variants")

    cut, own = emitted.where("place >= 0"), emitted.where("place < 0").select("variant", F.col("rank").alias("short"))
    swapped = cut.groupBy("variant", "place").agg(F.min("rank").alias("near"), F.max("rank").alias("last")).where("near < last").drop("last")
    grown = cut.join(own, "variant")
    best = (
        cut.join(swapped, ["variant", "place"]).select("rank", "near")
        .unionByName(grown.select("rank", F.col("short").alias("near")))
        .unionByName(grown.select(F.col("short").alias("rank"), F.col("rank").alias("near")))
        .groupBy("rank").agg(F.min("near").alias("near")).where("near < rank"))

    # compare the words of what is claimed
    texts_of = again.select(F.explode("numbers").alias("k"), "text").select(
        "k.rank", F.regexp_extract_all(F.element_at(F.split("text", "\n", -1), F.col("k.line_no") + 1), F.lit(WORD), F.lit(0)).alias("words"))
    texts_of = texts_of.groupBy("rank").agg(F.first("words").alias("words"))
    mine = best.join(texts_of.select("rank", F.col("words").alias("x")), "rank")
    proved = mine.join(texts_of.select(F.col("rank").alias("near"), F.col("words").alias("y")), "near").where(_one_edit("x", "y"))
    proved = proved.join(live.select("line", "rank"), "rank").join(live.select(F.col("rank").alias("near"), F.col("first").alias("at")), "near")

    info = classes.select("line", "first", "c").join(proved.select("line", F.col("at").alias("near")), "line", "left").where("c > 1 or near is not null")
    dropped = found.select("line", *PLACE).join(info, "line")
    repeat = place != F.col("first")
    out = dropped.where(F.col("near").isNotNull() | repeat).select(
        "doc_id", "line_no", F.coalesce("near", "first").alias("keep"), F.when(F.col("near").isNull(), 0).otherwise(1).alias("distance"))
    null = F.lit(int(NO_ID))
    return out.select(
        F.nullif("doc_id", null).alias("doc_id"), "line_no", F.nullif(F.col("keep.doc_id"), null).alias("first_doc_id"),
        F.col("keep.line_no").alias("first_line_no"), "distance")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicate_lines(table(spark, sf_dir, "documents"))


OP9_SQL = rf"""
WITH cut AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents),
numbered AS (SELECT doc_id, k - 1 AS line_no, regexp_extract_all(l[k], '[^\x20\x09-\x0D]+') AS w
  FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS k FROM cut)),
occ AS (SELECT doc_id, line_no, w, len(w) AS n FROM numbered WHERE len(w) > 0),
classes AS (SELECT w, n, min((doc_id, line_no)) AS first FROM occ GROUP BY w, n),
gone AS (SELECT w, n, first, p, list_concat(w[:p - 1], w[p + 1:]) AS v
  FROM (SELECT *, unnest(range(1, n + 1)) AS p FROM classes WHERE n >= {MIN_WORDS})),
near AS (
  SELECT a.w, b.first FROM gone a JOIN gone b ON a.v = b.v AND a.p = b.p AND a.w <> b.w
  UNION ALL SELECT a.w, b.first FROM gone a JOIN classes b ON a.v = b.w AND b.n >= {MIN_WORDS}
  UNION ALL SELECT b.w, a.first FROM gone a JOIN classes b ON a.v = b.w AND b.n >= {MIN_WORDS}),
best AS (SELECT w, min(first) AS near FROM near GROUP BY w),
kept AS (SELECT c.w, c.first, CASE WHEN b.near < c.first THEN b.near END AS near FROM classes c LEFT JOIN best b USING (w))
SELECT doc_id, line_no::INT AS line_no, (coalesce(near, first))[1] AS first_doc_id, (coalesce(near, first))[2]::INT AS first_line_no,
  CASE WHEN near IS NULL THEN 0 ELSE 1 END::INT AS distance
FROM occ JOIN kept USING (w) WHERE near IS NOT NULL OR (doc_id, line_no) <> first
"""
