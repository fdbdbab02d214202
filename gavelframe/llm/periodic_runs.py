"""Periodic runs: stretches of consecutive words that repeat with a period, found on a suffix automaton.

A run is a maximal stretch with smallest period q (words q apart are equal) of at least `least` words and
at least `times` * q words. The words of a text after the first period of a run are repeats; `kept` is the
text without them.

1. A run holds two equal windows of `least` - `least` / `times` words within one period. Sorting hashed
   windows of whole batches tells which stretches of a text can hold a run at all; the rest, most text, is
   done. A stretch stays while some window of it comes again within its length / `times`.
2. The words of a stretch are appended to a suffix automaton. Its suffix links form a tree; every word
   accesses the path from its prefix to the root in a link-cut forest, where the nodes of one preferred path
   carry the end of their last occurrence. An access meets the path as segments of equal last occurrence;
   a segment of end e whose deepest node is L words long says that the L words up to here also end at e and
   nowhere between: with distance q = here - e the stretch of the last L + q words has smallest period q.
   L >= q makes it a square, and enough of it a run; the longest one per (start, q) is the run. The path then
   takes the colour of this word. Segments number O(log n) a word, taken together.

Texts are independent of each other, so nothing is shuffled. Memory of a task is bounded by a batch of
about 6 MB of text or its longest text, and by about 1 KB a word of the longest repeating stretch.

Null and empty texts have no words and no runs; `kept` is then empty. Null ids, repeated ids and repeated
rows are rows like any other, one result each. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gavelframe.llm.base import WORD, table
from gavelframe.llm.packs import Stretches, find_words, hash_ranges, joined_words, slices, splitmix, text_bytes, window_starts

LEAST, TIMES = 24, 3
FOUND = "key long, n_words long, runs array<struct<start: long, length: long, period: long>>, kept string"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def suffix_automaton(codes: list[int]) -> tuple[list[int], list[int], list[int]]:
    """(length, suffix link) of every state, and the state of every prefix; state 0 is the empty word."""
    length, link, step, prefix = [0], [-1], [{}], []
    last = 0
    for n, c in enumerate(codes, 1):
        now = len(length)
        length.append(n)
        link.append(0)
        step.append({})
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = now
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[q] != length[p] + 1:
                copy = len(length)
                length.append(length[p] + 1)
                link.append(link[q])
                step.append(dict(step[q]))
                link[q] = copy
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = copy
                    p = link[p]
                q = copy
            link[now] = q
        prefix.append(now)
        last = now
    return length, link, prefix


class LinkCut:
    """Preferred paths of a fixed forest as splay trees; `mark` of a path stands at its splay root."""

    def __init__(self, parent: list[int]):
        self.up, self.left, self.right, self.mark = list(parent), [-1] * len(parent), [-1] * len(parent), [0] * len(parent)

    def _splay(self, x: int) -> None:
        up, left, right = self.up, self.left, self.right
        top = x
        while (y := up[top]) >= 0 and (left[y] == top or right[y] == top):
            top = y
        if top == x:
            return
        self.mark[x] = self.mark[top]
        while True:
            y = up[x]
            if y < 0 or (left[y] != x and right[y] != x):
                return
            z = up[y]
            if z >= 0 and (left[z] == y or right[z] == y):
                self._turn(y if (left[z] == y) == (left[y] == x) else x)
            self._turn(x)

    def _turn(self, x: int) -> None:
        up, left, right = self.up, self.left, self.right
        y = up[x]
        z = up[y]
        if left[y] == x:
            child = left[y] = right[x]
            right[x] = y
        else:
            child = right[y] = left[x]
            left[x] = y
        if child >= 0:
            up[child] = y
        if z >= 0:
            if left[z] == y:
                left[z] = x
            elif right[z] == y:
                right[z] = x
        up[y] = x
        up[x] = z

    def access(self, v: int, colour: int) -> list[tuple[int, int]]:
        """(mark, deepest node) of the marked segments on the path from v to its root, which then gets `colour`."""
        met, x, below = [], v, -1
        while x >= 0:
            self._splay(x)
            mark, deeper = self.mark[x], self.right[x]
            if mark:
                met.append((mark, x))
            if deeper >= 0:
                self.mark[deeper] = mark
            self.right[x] = below
            below, x = x, self.up[x]
        self._splay(v)
        self.mark[v] = colour
        return met


def runs_of(codes: list[int], least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of a sequence, by start, then period."""
    shortest = least - least // times
    length, link, prefix = suffix_automaton(codes)
    # what is shorter than a run without its first period never decides, so the tree is cut there
    paths = LinkCut([p if p > 0 and length[p] >= shortest else -1 for p in link])
    last: dict[tuple[int, int], int] = {}
    for now, v in enumerate(prefix, 1):
        if now < shortest:
            continue
        for end, node in paths.access(v, now):
            period = now - end
            whole = length[node] + period
            if whole >= least and whole >= times * period:
                last[now - whole, period] = now
    return [(start, end - start, period) for (start, period), end in sorted(last.items())]


def repeating_stretches(words: np.ndarray, off: np.ndarray, least: int, times: int) -> np.ndarray:
    """(begin, end) of the stretches of each row outside of which no word can lie in a run."""
    width = least - least // times
    at = window_starts(off, width)
    if not len(at):
        return np.zeros((0, 2), np.int64)
    row = np.searchsorted(off, at, "right") - 1
    key = Stretches(words)(at, width) ^ splitmix(row.astype(np.uint64))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    gap = np.where(same, np.diff(at[order]), np.iinfo(np.int64).max // times)
    ends = np.full(1, np.iinfo(np.int64).max // times)
    near = np.empty(len(at), np.int64)
    near[order] = np.minimum(np.concatenate([ends, gap]), np.concatenate([gap, ends]))
    keep = near <= len(words)
    while True:
        at, near = at[keep], near[keep]
        if not len(at):
            return np.zeros((0, 2), np.int64)
        # windows that overlap or touch make a stretch; rows are apart
        row = np.searchsorted(off, at, "right") - 1
        new = np.concatenate([[True], (at[1:] > at[:-1] + width) | (row[1:] != row[:-1])])
        begin = at[new]
        end = at[np.append(np.flatnonzero(new)[1:], len(at)) - 1] + width
        keep = near * times <= (end - begin)[np.cumsum(new) - 1]
        if keep.all():
            return np.stack([begin, end], 1)


def _read(batch: pa.RecordBatch, least: int, times: int) -> pa.RecordBatch:
    data, off = text_bytes(batch.column(1))
    starts, ends = find_words(data, off)
    words = hash_ranges(data, starts, ends, lower=False)
    at = np.searchsorted(starts, off)
    found: list[list] = [[] for _ in range(len(off) - 1)]
    dropped = np.zeros(len(words), bool)
    for a, b in repeating_stretches(words, at, least, times).tolist():
        row = int(np.searchsorted(at, a, "right")) - 1
        for start, length, period in runs_of(np.unique(words[a:b], return_inverse=True)[1].tolist(), least, times):
            found[row].append((start + a - int(at[row]), length, period))
            dropped[a + start + period: a + start + length] = True
    return pa.RecordBatch.from_arrays([
        batch.column(0), pa.array(np.diff(at)),
        pa.array([[dict(zip(("start", "length", "period"), r)) for r in f] for f in found], pa.list_(_RUN)),
        joined_words(data, starts, ends, at, ~dropped)], ["key", "n_words", "runs", "kept"])


def periodic_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST, times: int = TIMES) -> DataFrame:
    """(key, n_words, runs, kept) of every row; runs are sorted by start, then period."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in slices(whole, 1):
                yield _read(part, least, times)

    found = docs.select(F.col(f"`{key}`").cast("long").alias("key"), F.col(f"`{text}`").alias("text")).mapInArrow(run, FOUND)
    return found.withColumnRenamed("key", key)


def repeated_tails(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text) with the end of every tenth text made periodic, as a crc32 of its key decides."""
    h = F.crc32(F.col(f"`{key}`").cast("string").cast("binary"))
    rows = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"), F.floor(h / 10).alias("g"), (h % 10 == 0).alias("hit"))
    rows = rows.withColumn("words", F.when(F.col("hit"), F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(WORD), F.lit(0))))
    rows = rows.withColumn("n", F.size("words")).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    rows = rows.withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    tail = F.expr("array_join(transform(words, (w, i) -> if(i < a, w, words[int(a + (i - a) % p)])), ' ')")
    return rows.select(F.col("key").alias(key), F.when(F.col("n") > 0, tail).otherwise(F.col("text")).alias(text))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(repeated_tails(table(spark, sf_dir, "documents")))
    # greatest length / period by products, the earlier run stays on equal ones
    best = F.expr("""aggregate(runs, cast(null as struct<start: bigint, length: bigint, period: bigint>),
        (b, r) -> if(b is null or r.length * b.period > b.length * r.period, r, b))""")
    lines = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')")
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("kept").cast("binary"), 256).alias("collapsed_sha256"))
