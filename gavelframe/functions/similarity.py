"""Similarity of short texts (names of cities, courts), computed on distinct values only.

The ratio is twice the matched characters over the summed lengths, matched blocks found
longest first (Ratcliff-Obershelp). Spark has no such function, so a pandas UDF computes
it; ``similar_values`` first finds the pairs worth computing with an ordinary equi-join.
"""

from __future__ import annotations

import math
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gavelframe.functions.keys import normalize_text


@F.pandas_udf(T.DoubleType())
def text_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratio of two already normalised texts; 0 when one is missing."""
    return pd.Series([
        SequenceMatcher(None, x, y).ratio() if x and y else 0.0 for x, y in zip(a, b)
    ], dtype="float64")


def similarity(a, b) -> Column:
    return text_ratio(normalize_text(a), normalize_text(b))


# A ratio above t over lengths n, m leaves fewer than (1-t)(n+m) unmatched characters.
# So with d the largest such count, cutting the first text into d+1 pieces leaves one
# piece unchanged inside the second, shifted by no more than the insertions and
# deletions allow. Equal (lengths, piece number, piece) is therefore a lossless join key.

def _unmatched(n: int, m: int, t: float) -> int:
    return max(0, math.ceil((1 - t) * (n + m) - 1e-9) - 1)


def _pieces(n: int, count: int) -> list[tuple[int, int]]:
    size, longer = divmod(n, count)
    out, at = [], 0
    for i in range(count):
        width = size + (1 if i >= count - longer else 0)
        out.append((at, width))
        at += width
    return out


def _partner_lengths(n: int, t: float) -> range:
    return range(max(1, math.ceil(n * t / (2 - t) - 1e-9)), math.floor(n * (2 - t) / t + 1e-9) + 1)


def _first_keys(text: str, t: float) -> list[str]:
    n, keys = len(text), []
    for m in _partner_lengths(n, t):
        d = _unmatched(n, m, t)
        if d >= n:
            keys.append(f"{n},{m}")
            continue
        keys += [f"{n},{m},{i},{text[p:p + w]}" for i, (p, w) in enumerate(_pieces(n, d + 1))]
    return keys


def _second_keys(text: str, t: float) -> list[str]:
    m, keys = len(text), set()
    for n in _partner_lengths(m, t):
        d = _unmatched(n, m, t)
        if d >= n:
            keys.add(f"{n},{m}")
            continue
        back, ahead = max(0, (d - (m - n)) // 2), max(0, (d + (m - n)) // 2)
        for i, (p, w) in enumerate(_pieces(n, d + 1)):
            for at in range(max(0, p - back), min(m - w, p + ahead) + 1):
                keys.add(f"{n},{m},{i},{text[at:at + w]}")
    return sorted(keys)


def _keys(make):
    @F.pandas_udf(T.ArrayType(T.StringType()))
    def keys(texts: pd.Series, thresholds: pd.Series) -> pd.Series:
        return pd.Series([make(s, t) for s, t in zip(texts, thresholds)], dtype=object)
    return keys


def similar_values(first: DataFrame, second: DataFrame, thresholds: dict[str, float]) -> DataFrame:
    """Distinct value pairs ``(field, value_1, value_2)`` whose ratio exceeds the field's threshold.

    All fields go through one job; the work depends on distinct values, not on rows.
    """
    def values(df, n):
        each = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias(f"value_{n}"), F.lit(t).alias("threshold"))
                         for c, t in thresholds.items()])
        v = df.select(F.explode(each).alias("v")).select("v.*").distinct()
        return v.withColumn(f"norm_{n}", normalize_text(f"value_{n}")).filter(F.col(f"norm_{n}") != "")

    a, b = values(first, 1), values(second, 2)
    by = ["field", "threshold"]
    norm_a = a.select(*by, "norm_1").distinct().withColumn("key", F.explode(_keys(_first_keys)("norm_1", "threshold")))
    norm_b = b.select(*by, "norm_2").distinct().withColumn("key", F.explode(_keys(_second_keys)("norm_2", "threshold")))
    pairs = norm_a.join(norm_b, [*by, "key"]).select(*by, "norm_1", "norm_2").distinct()
    close = pairs.filter(text_ratio("norm_1", "norm_2") > F.col("threshold")).drop("threshold")
    return a.drop("threshold").join(close, ["field", "norm_1"]).join(b.drop("threshold"), ["field", "norm_2"]).select(
        "field", "value_1", "value_2")
