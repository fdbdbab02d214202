"""Language identification: multinomial naive Bayes over hashed character n-grams (1 to 3).

Training counts n-grams of a bounded sample of labelled rows (`per_language` rows of each language at
most, picked by a keyed hash of the id); the counts of each language are summed from one array per
task. The matrix of log probabilities, `buckets` x languages (at most MAX_LANGUAGES), is all that is
broadcast. Scoring gathers rows of the matrix for every n-gram of a batch and sums them per document,
over whole texts, in pieces of bounded size.

A null text, or one without a letter, is `und` with score 0. Without training rows every document is
`und`. The score is the posterior probability of the predicted language. Repeated rows get equal
answers; other columns of the input are not looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gavelframe.llm.base import folded, mixed, table

BUCKET_BITS = 16
MAX_LANGUAGES = 256
PER_LANGUAGE = 2000
PIECE = 1 << 18
UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")


def held_out(key: Column) -> Column:
    return F.crc32(key.cast("string").cast("binary")) % 4 == 2


def _pieces(texts: list[str], size: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Bucket numbers (3 per position), start of each piece among the positions, row of each piece."""
    batch, rows, held = [], [], 0
    for row, text in enumerate(texts):
        text = text.lower()
        for at in range(0, len(text), size):
            piece = text[at: at + size + 2]
            batch.append((piece, min(size, len(text) - at)))
            rows.append(row)
            held += len(piece)
            if held >= size:
                yield _ngrams(batch, rows)
                batch, rows, held = [], [], 0
    if batch:
        yield _ngrams(batch, rows)


def _ngrams(batch, rows):
    joined = "".join(p + "\n\n" for p, _ in batch)
    c = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.array([len(p) + 2 for p, _ in batch])
    heads = np.cumsum(lengths) - lengths
    counted = np.array([n for _, n in batch])
    at = np.arange(int(counted.sum())) + np.repeat(heads - (np.cumsum(counted) - counted), counted)
    a, b, d = c[at], c[at + 1], c[at + 2]
    shift = np.uint32(32 - BUCKET_BITS)
    one = (a * np.uint32(2654435761)) >> shift
    two = ((a * np.uint32(2246822519) + b) * np.uint32(3266489917) + np.uint32(77)) >> shift
    three = (((a * np.uint32(668265263) + b) * np.uint32(374761393) + d) * np.uint32(2654435769)) >> shift
    return np.stack([one, two, three]), np.cumsum(counted) - counted, np.array(rows)


def train(labelled: DataFrame, label: str = "lang", text: str = "text", alpha: float = 0.1) -> tuple[list[str], np.ndarray]:
    """Languages and the matrix [bucket, language] of log probabilities."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lang in set(langs):
                mine = [t or "" for t, x in zip(texts, langs) if x == lang]
                total = sums.setdefault(lang, np.zeros(1 << BUCKET_BITS, np.int64))
                for grams, _, _ in _pieces(mine, PIECE):
                    total += np.bincount(grams.ravel(), minlength=1 << BUCKET_BITS)
        if sums:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(sums)), pa.array([v.tobytes() for v in sums.values()], pa.binary())], ["lang", "counts"])

    parts = labelled.select(F.col(f"`{label}`").alias("lang"), F.col(f"`{text}`").alias("text")).repartition(8)
    sums: dict[str, np.ndarray] = {}
    for row in parts.mapInArrow(count, "lang string, counts binary").toLocalIterator():
        counts = np.frombuffer(row.counts, np.int64)
        sums[row.lang] = sums.get(row.lang, 0) + counts
    langs = sorted(sums)
    if not langs:
        return [], np.zeros((1 << BUCKET_BITS, 0), np.float32)
    counts = np.stack([sums[x] for x in langs], 1) + alpha
    return langs, np.log(counts / counts.sum(0)).astype(np.float32)


def _scorer(langs: list[str], shared):
    """texts -> (predicted languages, scores); the matrix is a broadcast variable."""
    size = max(1024, PIECE * 4 // max(4, len(langs)))

    def score(texts: list[str]) -> tuple[list[str], np.ndarray]:
        known = np.array([bool(langs) and _LETTER.search(t) is not None for t in texts], bool)
        sums = np.zeros((len(texts), max(1, len(langs))))
        if langs:
            matrix = shared.value
            for grams, heads, rows in _pieces(texts, size):
                got = matrix[grams[0]]
                got += matrix[grams[1]]
                got += matrix[grams[2]]
                np.add.at(sums, rows, np.add.reduceat(got, heads, axis=0, dtype=np.float64))
        best = sums.argmax(1)
        odds = np.exp(sums - sums[np.arange(len(texts)), best][:, None]).sum(1)
        return [langs[b] if k else UNKNOWN for b, k in zip(best, known)], np.where(known, 1 / odds, 0.0)

    return score


def predict(docs: DataFrame, langs: list[str], weights: np.ndarray, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`key`, `lang_pred`, `score` of each row."""
    score = _scorer(langs, docs.sparkSession.sparkContext.broadcast(weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = score([t or "" for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores)], [key, "lang_pred", "score"])

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(f"`{key}`").alias(key), F.col(f"`{text}`").alias("text"))
    return rows.mapInArrow(run, f"`{key}` {kind}, lang_pred string, score double")


def identified(docs: DataFrame, least: float = 0.4, text: str = "text") -> DataFrame:
    """`docs` without those that have no language or whose best language scores below `least`."""
    langs, weights = train(sample(docs))
    score = _scorer(langs, docs.sparkSession.sparkContext.broadcast(weights))
    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = score([t or "" for t in batch.column(place).to_pylist()])
            yield batch.filter(pa.array([n != UNKNOWN and s >= least for n, s in zip(names, scores)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def sample(docs: DataFrame, per_language: int = PER_LANGUAGE, key: str = "doc_id", label: str = "lang") -> DataFrame:
    """Labelled rows outside the held-out part, about `per_language` of each language at most."""
    rows = docs.where(F.col(label).isNotNull() & ~F.coalesce(held_out(F.col(key)), F.lit(False)))
    sizes = rows.groupBy(label).count().limit(MAX_LANGUAGES + 1).collect()
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    chance = F.lit(0.0)
    for row in sizes:
        chance = F.when(F.col(label) == row[label], min(1.0, per_language / row["count"])).otherwise(chance)
    return rows.where(F.expr(f"({mixed(folded(f'`{key}`'), 4711)}) / 2147483647.0D") < chance)


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score; trained on the rows of `docs` that are not held out."""
    langs, weights = train(sample(docs))
    return predict(docs, langs, weights).select(
        "doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "lang_pred", "score")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))
