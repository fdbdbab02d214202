"""Connected components: edges are contracted to forests inside each task, so that few rounds are left.

A round sends every edge to both of its nodes; a task joins all edges it got and answers with a forest, each
node at the smallest node it can reach there. Distances at least halve from round to round, and all hops inside a
task are done in one. The rounds are written to the shared folder and the one before is deleted. There are as many
parts as the edges need, so a round of one part is the last. A task holds its nodes, not its edges.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gavelframe.llm.base import deleted, partitions, written

EDGES = "a long, b long"
PART_EDGES = 400_000


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its component) of all nodes but the smallest ones."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    up, (x, y) = np.arange(len(nodes)), at.reshape(2, -1)
    while True:
        p, q = up[x], up[y]
        apart = p != q
        if not apart.any():
            break
        x, y, p, q = x[apart], y[apart], p[apart], q[apart]
        np.minimum.at(up, np.maximum(p, q), np.minimum(p, q))
        while (up[up] != up).any():
            up = up[up]
    low = up != np.arange(len(nodes))
    return nodes[low], nodes[up[low]]


def _batch(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def _spanned(edges: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """A forest of all edges of a task, made piece by piece."""
    held, size, least = [], 0, 1 << 20
    for a, b in edges:
        held.append((a, b))
        size += len(a)
        if size > least:
            held = [forest(*map(np.concatenate, zip(*held)))]
            size = len(held[0][0])
            least = max(least, 2 * size)
    if size:
        a, b = forest(*map(np.concatenate, zip(*held)))
        for i in range(0, len(a), 1 << 16):
            yield _batch(a[i: i + (1 << 16)], b[i: i + (1 << 16)])


def spanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _spanned((np.asarray(x.column(0)), np.asarray(x.column(1))) for x in batches)


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (key, node) rows: each key of a batch once, with one node (a = b), and the edges among its nodes."""
    for x in batches:
        k, n = np.asarray(x.column(0)), np.asarray(x.column(1))
        order = np.argsort(k, kind="stable")
        k, n = k[order], n[order]
        same = np.concatenate([[False], k[1:] == k[:-1]])
        a, b = forest(n[same], n[np.flatnonzero(same) - 1])
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate(c)) for c in ((k[~same], a), (n[~same], a), (n[~same], b))], ["k", "a", "b"])


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def edges():
        last = None
        for x in batches:
            k, a, b = (np.asarray(c) for c in x.columns)
            yield a[a != b], b[a != b]
            k, n = k[a == b], a[a == b]
            if last is not None:
                k, n = np.concatenate([last[0], k]), np.concatenate([last[1], n])
            same = k[1:] == k[:-1]
            yield n[1:][same], n[:-1][same]
            last = (k[-1:], n[-1:])
    return _spanned(edges())


def linked_by(rows: DataFrame, key: str, node: str) -> DataFrame:
    """Edges that span what is linked by an equal `key` (both long); a frequent key travels once a batch."""
    met = rows.select(key, node).mapInArrow(_met, "k long, a long, b long").repartition(partitions(rows.sparkSession), "k")
    return met.sortWithinPartitions(F.col("a") != F.col("b"), "k").mapInArrow(_chained, EDGES)


def components(edges: DataFrame) -> DataFrame:
    """(id, label) of every node of the edges (a, b) between different nodes; label is the component's smallest node."""
    spark = edges.sparkSession
    now, path = written(edges.select("a", "b").where("a <> b"), "edges", with_path=True)
    state = None
    while True:
        before, (size, *seen) = state, now.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(a, b))"), F.expr("sum(cast(hash(a, b) as long))")).first()
        state = (size, *seen)
        if state == before or not size:
            break
        parts = min(partitions(spark), 1 + size // PART_EDGES)
        both = now.select(F.explode(F.array("a", "b")).alias("node"), "a", "b").repartition(parts, "node")
        rounds = both.select("a", "b").mapInArrow(spanned, EDGES)
        old = path
        now, path = written(rounds.distinct() if parts > 1 else rounds, "edges", with_path=True)
        deleted(spark, old)
        if parts == 1:
            break
    heads = now.select(F.col("b").alias("id"), F.col("b").alias("label")).distinct()
    return now.select(F.col("a").alias("id"), F.col("b").alias("label")).unionByName(heads)
