"""The six compared fields of two listing feeds, their weights and their masks."""

from __future__ import annotations

from fractions import Fraction
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gavelframe.functions import constants as K
from gavelframe.functions.values import has_number, has_text

FIELDS = list(K.MATCH_WEIGHTS)  # date, court, price, city, type, surface
COLUMNS = {"date": "sale_date", "court": "court", "price": "start_price", "city": "city",
           "type": "property_type", "surface": "surface_m2"}
BIT = {f: 1 << i for i, f in enumerate(FIELDS)}
SIMILAR = {"court": 0.7, "city": 0.8}
TOLERANCE = {"price": 0.10, "surface": 0.05}
HALF = Fraction(1, 2)


def weight(mask: int) -> int:
    return sum(K.MATCH_WEIGHTS[f] for f, bit in BIT.items() if mask & bit)


def weight_of(mask: Column) -> Column:
    return sum((F.when(mask.bitwiseAND(F.lit(bit)) != 0, K.MATCH_WEIGHTS[f]).otherwise(0) for f, bit in BIT.items()), F.lit(0))


def sufficient_sets(present: int, share: Fraction = HALF) -> list[int]:
    """Field sets within ``present`` that carry a share of its weight."""
    bits = [b for b in BIT.values() if present & b]
    return [sum(c) for n in range(1, len(bits) + 1) for c in combinations(bits, n) if weight(sum(c)) >= share * weight(present)]


def minimal_sets(present: int, share: Fraction = HALF) -> list[int]:
    """The smallest of them."""
    enough = sufficient_sets(present, share)
    return [s for s in enough if not any(o != s and o & s == o for o in enough)]


def has_field(field: str) -> Column:
    c = F.col(COLUMNS[field])
    if field == "date":
        return c.isNotNull()
    return has_number(c) if field in TOLERANCE else has_text(c)


def signed(rows: DataFrame) -> DataFrame:
    """Rows with the compared values (empty ones as NULL) and the mask of present fields."""
    mask = sum((F.when(has_field(f), F.lit(bit)).otherwise(F.lit(0)) for f, bit in BIT.items()), F.lit(0))
    return rows.select("seq", mask.alias("mask"), *[F.when(has_field(f), F.col(COLUMNS[f])).alias(f) for f in FIELDS])


def masks(rows: DataFrame) -> list[int]:
    """The masks that occur, 64 at most."""
    return sorted(r.mask for r in rows.select("mask").distinct().collect())


def close(a: Column, b: Column, tolerance: float) -> Column:
    return F.abs(a - b) / ((a + b) / 2) < tolerance
