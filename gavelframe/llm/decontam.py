"""Benchmark decontamination: every passage of the corpus queries a BM25 index of the test items.

The index maps the hashes of lower-cased words to the items that hold them. A posting's weight is its BM25 weight
divided by `share` times the item's score against itself, so that one threshold, 1, means for every item
that the passage covers `share` of its weight. Items are cut into blocks of `BLOCK`; each term keeps the
largest weight it has in a block. In each item the lightest terms are optional up to `OPTIONAL` in all.

Passages are windows of twice the longest item, half overlapping, over whole texts. Scoring runs over
whole Arrow batches: the block maxima of the passage's distinct essential terms are summed, and a
(passage, block) that stays below 1 with all optional weight added is skipped without looking at its
items (block-max pruning); then the same with the items' own weights. What is left is scored in full,
and accepted when half of the word n-grams of the question and half of those of the answer (the item's first two
thirds of words and the rest) are found in the passage.

Items of equal text are one. The benchmark is indexed in parts of about `ITEMS` items and `BYTES` bytes of text; only such a part is
ever broadcast. Document frequencies, item count, mean length and the window length are those of the whole
benchmark, counted by Spark, so the parts change no answer. A null text has no passages, a null or empty item
matches nothing. Repeated rows are reported each. Other columns of the input are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gavelframe.llm.base import table, word_count, written
from gavelframe.llm.packs import hash_words, runs, slices, splitmix

ITEMS, BYTES = 20_000, 16 << 20
BLOCK = 16
OPTIONAL = 0.45
SHARE = 0.6
K1, B = 1.2, 0.75
GRAM = 3
PART = 0.5
_C = np.random.default_rng(31).integers(1, 1 << 63, GRAM, dtype=np.uint64) | np.uint64(1)
MATCH = ["item_id", "score", "question_overlap", "answer_overlap"]


def _grams(words: np.ndarray) -> np.ndarray:
    n = min(GRAM, len(words))
    if not n:
        return np.zeros(0, np.uint64)
    total = np.zeros(len(words) - n + 1, np.uint64)
    for j in range(n):
        total += words[j: len(words) - n + 1 + j] * _C[j]
    return np.unique(splitmix(total + np.uint64(n)))


class Counts(NamedTuple):
    """Of the whole benchmark: items, their mean and greatest number of words; df of the sorted `terms` of a part."""
    items: int
    mean: float
    longest: int
    terms: np.ndarray
    df: np.ndarray


def counts_of(texts: list[str]) -> Counts:
    words, off = hash_words(pa.array(texts, pa.string()))
    lengths = np.diff(off)
    lengths = lengths[lengths > 0]
    each = [np.unique(words[a:b]) for a, b in zip(off[:-1], off[1:])]
    terms, df = np.unique(np.concatenate([np.zeros(0, np.uint64), *each]), return_counts=True)
    return Counts(len(lengths), float(lengths.mean()) if len(lengths) else 0.0, int(lengths.max(initial=0)), terms, df)


class Index:
    """Arrays of one part of the benchmark."""

    def __init__(self, items: list[tuple[int, str]], counts: Counts, share: float = SHARE):
        words, off = hash_words(pa.array([t for _, t in items], pa.string()))
        lengths = np.diff(off)
        items, lengths = [x for x, n in zip(items, lengths) if n], lengths[lengths > 0]
        off = np.concatenate([[0], np.cumsum(lengths)])
        self.ids = [i for i, _ in items]
        self.words = [words[a:b] for a, b in zip(off[:-1], off[1:])]
        self.longest = counts.longest if len(items) else 0
        if not items:
            return
        item = np.repeat(np.arange(len(items)), lengths)
        self.terms, term = np.unique(words, return_inverse=True)
        pair, tf = np.unique(item * len(self.terms) + term, return_counts=True)
        item, term = pair // len(self.terms), pair % len(self.terms)
        df = counts.df[np.searchsorted(counts.terms, self.terms)]
        idf = np.log1p((counts.items - df + 0.5) / (df + 0.5))
        norm = K1 * (1 - B + B * lengths[item] / counts.mean)
        weight = idf[term] * tf * (K1 + 1) / (tf + norm)
        weight /= share * np.bincount(item, weight, len(items))[item]
        # the lightest terms of each item are optional
        order = np.lexsort((weight, item))
        item, term, weight = item[order], term[order], weight[order]
        upto = np.cumsum(weight)
        heads, spans = runs(item)
        within = upto - np.repeat(upto[heads] - weight[heads], spans)
        optional = within <= OPTIONAL
        self.optional = np.bincount(item[optional], weight[optional], len(items))
        self.full = [(term[a: a + n], weight[a: a + n]) for a, n in zip(heads, spans)]
        self.by_item = self._postings(item[~optional], term[~optional], weight[~optional])
        block = item[~optional] // BLOCK
        self.by_block = self._postings(*self._largest(block, term[~optional], weight[~optional]))
        blocks = -(-len(items) // BLOCK)
        self.block_optional = np.array([self.optional[b * BLOCK: (b + 1) * BLOCK].max() for b in range(blocks)])
        self.seen = np.zeros(1 << 20, bool)
        self.seen[(self.terms & np.uint64(0xFFFFF)).astype(np.int64)] = True
        self.question = [_grams(w[: -(-2 * len(w) // 3)]) for w in self.words]
        self.answer = [_grams(w[-(-2 * len(w) // 3):]) for w in self.words]

    def _largest(self, block, term, weight):
        order = np.lexsort((-weight, term, block))
        key = (block * len(self.terms) + term)[order]
        heads, _ = runs(key)
        return block[order][heads], term[order][heads], weight[order][heads]

    def _postings(self, place, term, weight):
        order = np.argsort(term, kind="stable")
        return np.searchsorted(term[order], np.arange(len(self.terms) + 1)), place[order], weight[order]

    def _summed(self, window, term, postings, bound) -> tuple[np.ndarray, np.ndarray]:
        """(window, place) whose essential weight reaches 1 with `bound` of the place; windows hold distinct terms."""
        at, place, weight = postings
        counts = at[term + 1] - at[term]
        take = np.repeat(at[term] - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))
        width = len(bound)
        key = np.repeat(window, counts) * width + place[take]
        order = np.argsort(key, kind="stable")
        heads, _ = runs(key[order])
        if not len(heads):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        total = np.add.reduceat(weight[take][order], heads)
        key = key[order][heads]
        keep = total + bound[key % width] >= 1 - 1e-9
        return key[keep] // width, key[keep] % width

    def search(self, words: np.ndarray, off: np.ndarray) -> list[tuple[int, int, float, float, float]]:
        """(row, item, score, question overlap, answer overlap): the best passage of each row and item."""
        if not self.longest or not len(words):
            return []
        maybe = np.flatnonzero(self.seen[(words & np.uint64(0xFFFFF)).astype(np.int64)])
        term = np.minimum(np.searchsorted(self.terms, words[maybe]), len(self.terms) - 1)
        hit = self.terms[term] == words[maybe]
        at, term = maybe[hit], term[hit]
        essential = (self.by_block[0][1:] > self.by_block[0][:-1])[term]
        step = self.longest
        # windows are numbered through all rows: row r has windows base[r] .. base[r + 1] - 1
        base = np.concatenate([[0], np.cumsum(-(-np.diff(off) // step))])
        row = np.searchsorted(off, at[essential], "right") - 1
        second = base[row] + (at[essential] - off[row]) // step
        first = np.maximum(second - 1, base[row])
        pair = np.unique(np.concatenate([first, second]) * len(self.terms) + np.concatenate([term[essential]] * 2))
        window, essential_term = pair // len(self.terms), pair % len(self.terms)
        win, block = self._summed(window, essential_term, self.by_block, self.block_optional)
        if not len(win):
            return []
        # items are looked up only for windows with an open block
        inside = np.isin(window, win)
        win2, item = self._summed(window[inside], essential_term[inside], self.by_item, self.optional)
        width = len(self.block_optional)
        opened = np.isin(win2 * width + item // BLOCK, win * width + block)
        best: dict[tuple[int, int], tuple[float, float, float]] = {}
        sets: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for w, i in zip(win2[opened].tolist(), item[opened].tolist()):
            r = int(np.searchsorted(base, w, "right")) - 1
            if w not in sets:
                a = int(off[r]) + (w - int(base[r])) * step
                passage = words[a: min(a + 2 * step, int(off[r + 1]))]
                sets[w] = np.unique(passage), _grams(passage)
            terms, grams = sets[w]
            own, weight = self.full[i]
            score = float(weight[np.isin(self.terms[own], terms)].sum())
            if score < 1:
                continue
            q, a = (float(np.isin(x, grams).mean()) if len(x) else 1.0 for x in (self.question[i], self.answer[i]))
            if min(q, a) >= PART:
                best[r, i] = max(best.get((r, i), (0.0, 0.0, 0.0)), (score, q, a))
        return [(r, self.ids[i], *v) for (r, i), v in sorted(best.items())]


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(part, term) for every distinct term of every item."""
    for batch in batches:
        words, off = hash_words(batch.column(1))
        item = np.repeat(np.arange(batch.num_rows), np.diff(off))
        order = np.lexsort((words, item))
        item, words = item[order], words[order]
        new = np.concatenate([[True], (item[1:] != item[:-1]) | (words[1:] != words[:-1])])[: len(item)]
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(item[new])), pa.array(words[new].view(np.int64))], ["part", "term"])


def indexes(benchmark: DataFrame, key: str = "item_id", text: str = "text", most_items: int = ITEMS, most_bytes: int = BYTES) -> Iterator[Index]:
    """One index after the other, each over a part of the benchmark of bounded size; equal items are one, the smallest."""
    items = written(benchmark.select(F.col(f"`{key}`").cast("long").alias("i"), F.col(f"`{text}`").alias("t")).where("t is not null")
                    .groupBy("t").agg(F.min("i").alias("i")).select("i", "t", word_count(F.col("t")).alias("n")).where("n > 0"), "items")
    count, size, mean, longest = items.agg(F.count(F.lit(1)), F.sum(F.octet_length("t")), F.avg("n"), F.max("n")).first()
    if not count:
        return
    parts = max(-(-count // most_items), -(-size // most_bytes))
    items = items.withColumn("part", F.pmod(F.xxhash64("t"), F.lit(parts)).cast("int"))
    terms = written(items.select("part", "t").mapInArrow(_terms, "part int, term long"), "item-terms")
    df = written(terms.groupBy("term").agg(F.count(F.lit(1)).alias("df")), "item-df")
    for part in range(parts):
        mine = terms.where(F.col("part") == part).select("term").distinct().join(df, "term").toArrow()  # bounded by the part's text
        term, n = np.asarray(mine["term"]).view(np.uint64), np.asarray(mine["df"])
        order = np.argsort(term)
        own = items.where(F.col("part") == part).orderBy("i", "t").collect()
        yield Index([(r.i, r.t) for r in own], Counts(count, mean, longest, term[order], n[order]))


def matches(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", **limits) -> DataFrame:
    """(key, item_id, score, question_overlap, answer_overlap) of every document and item above the threshold."""
    kind = docs.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, item_id long, score double, question_overlap double, answer_overlap double"
    rows, out = docs.select(F.col(f"`{key}`").alias(key), F.col(f"`{text}`").alias("text")), docs.sparkSession.createDataFrame([], schema)
    for index in indexes(benchmark, **limits):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in (part for whole in batches for part in slices(whole, 1)):
                found = shared.value.search(*hash_words(batch.column(1)))
                if found:
                    r, i, s, q, a = zip(*found)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array(r)), pa.array(i, pa.int64()), *(pa.array(x, pa.float64()) for x in (s, q, a))],
                        [key, *MATCH])

        out = out.unionByName(rows.mapInArrow(run, schema))
    # items of equal text are all reported
    texts = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null")
    same = texts.join(texts.groupBy("text").agg(F.min("item_id").alias("first"), F.count(F.lit(1)).alias("c")).where("c > 1"), "text")
    others = out.withColumnRenamed("item_id", "first").join(same.where("not item_id <=> first").select("first", "item_id"), "first")
    return out.unionByName(others.select(*out.columns))


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """`docs` without the documents that match an item; one narrow stage for each part of the benchmark."""
    place = docs.columns.index(text)
    for index in indexes(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in (part for whole in batches for part in slices(whole, place)):
                keep = np.ones(batch.num_rows, bool)
                keep[[x[0] for x in shared.value.search(*hash_words(batch.column(place)))]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
