"""Link two listing feeds, choose one partner each, merge the pairs.

Scoring compares six fields; only jointly present ones count. Writing P for the jointly
present fields and M for the matching ones, a pair scores at least one half exactly when
the weights of M reach half of those of P. So each such pair agrees on one of the minimal
field sets of P that reach it, and these sets are the blocking keys: equality of (present
masks, field set, field values) with neighbouring buckets for prices and surfaces and
similar names for courts and cities. No pair is missed and no cross product is formed.

A row of the first feed has a key for every mask it may face and every minimal set of the joint fields; a row of the second
has one for every such set of its own mask. A pair meets once under each minimal set that all agrees on and counts under the
lowest, so nothing as large as the pairs is ever shuffled. Equal rows (mask and compared values) are one class where pairs
of classes will do.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from fractions import Fraction
from itertools import chain, repeat
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gavelframe.functions import constants as K
from gavelframe.functions.similarity import similar_values
from gavelframe.functions.values import has_items, has_number, has_text
from gavelframe.operators.enrich import enrich_locations, known_city
from gavelframe.operators.groups import SLICE_ROWS, positions, spread, stored
from gavelframe.operators.match_fields import BIT, FIELDS, HALF, SIMILAR, TOLERANCE, close, masks, minimal_sets, signed, weight_of


def _bucket(c: Column, tolerance: float) -> Column:
    half = tolerance / 2
    steps = F.floor(F.log(F.abs(c)) / F.lit(math.log((1 + half) / (1 - half)))).cast("long")
    return F.when(c < 0, -steps - (1 << 40)).otherwise(steps)


def _wanted(field: str) -> Column:
    return F.col("field_set").bitwiseAND(F.lit(BIT[field])) != 0


def _key(mask: Column, values: dict[str, Column]) -> Column:
    """Key of a row for the second feed's mask and its field set; what meets by a like hash only is sorted out by its values."""
    return F.xxhash64(mask, "field_set", *[F.when(_wanted(f), values[f]) for f in FIELDS])


def _one_per(rows: DataFrame, field: str, out: str, choices: Column, otherwise: Column) -> DataFrame:
    """A row per value the field may match by, only for field sets that use it."""
    return rows.withColumn(out, F.explode(F.when(_wanted(field), choices).otherwise(F.array(otherwise))))


class Scores(NamedTuple):
    """``pairs`` of classes (class_1, class_2, matched, weight) and the rows of the classes (class_n, seq_n)."""
    pairs: DataFrame
    rows_1: DataFrame
    rows_2: DataFrame

    def unfold(self) -> DataFrame:
        """Row pairs ``seq_1, seq_2, matched, weight``: as many as really match, copies and all."""
        return self.rows_1.join(self.pairs, "class_1").join(self.rows_2, "class_2").select("seq_1", "seq_2", "matched", "weight")


def _folded(signatures: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """Classes of equal rows, named by their lowest ``seq``, and their rows (class_n, seq_n)."""
    told = signatures.withColumn("sig", _sig_id("mask"))
    classes = told.groupBy("sig", "mask", *FIELDS).agg(F.min("seq").alias("id"))
    rows = told.select("sig", "seq").join(classes.select("sig", "id"), "sig")
    return classes.drop("sig"), rows.select(F.col("id").alias(f"class_{n}"), F.col("seq").alias(f"seq_{n}"))


def _lowest_set(joint: Column, alike: Column, share: Fraction) -> Column:
    """The lowest minimal set of the joint fields within the matching ones, 0 where they do not reach the share.

    A table of all 64 x 64 cases as one literal, a printable byte each.
    """
    n = 1 << len(FIELDS)
    sets = [sorted(minimal_sets(p, share)) if p else [] for p in range(n)]
    table = bytes(33 + next((s for s in sets[p] if s & m == s), 0) for p in range(n) for m in range(n))
    return F.ascii(F.substring(F.lit(table), joint * F.lit(n) + alike + F.lit(1), F.lit(1)).cast("string")) - F.lit(33)


def _both(k1: Column, k2: Column) -> Column:
    """One number for the numbers of two names, so that a pair is looked up by a plain long."""
    return F.shiftleft(k1, 31).bitwiseOR(k2)


def _pairs(one: DataFrame, two: DataFrame, masks1: list[int], masks2: list[int], names: dict[str, DataFrame], *,
           share: Fraction = HALF, keep_1: Sequence[str] = (), keep_2: Sequence[str] = ()) -> DataFrame:
    """``id_1, id_2, matched, weight`` and what is kept of all rows (id, mask, fields) of two sides that score at least ``share``, each pair once."""
    spark = one.sparkSession
    # at most 64 x 64 masks with their few minimal sets: fixed small tables
    faced = [(m, o, s) for m in masks1 for o in masks2 for s in minimal_sets(m & o, share) if m & o]
    asked = spark.createDataFrame(faced, "mask int, _other int, field_set int")
    own = spark.createDataFrame(sorted({(o, s) for _, o, s in faced}), "mask int, field_set int")
    v = {f: F.col(f) for f in FIELDS}
    price, surface = _bucket(v["price"], TOLERANCE["price"]), _bucket(v["surface"], TOLERANCE["surface"])
    around = F.array(F.lit(-1), F.lit(0), F.lit(1))

    left = spread(one, "id").join(F.broadcast(asked), "mask")
    left = _one_per(left, "price", "_dp", around, F.lit(0))
    left = _one_per(left, "surface", "_ds", around, F.lit(0))
    for f, edges in names.items():
        # field sets without the name keep a number of their own, so that no join key is frequent
        asks = F.when(_wanted(f), v[f]).otherwise(-1 - F.pmod(F.xxhash64("id"), F.lit(64)))
        none = spark.range(64).select((-1 - F.col("id")).alias("_k"), F.lit(-1).cast("long").alias(f"_{f}"))
        near = edges.select(F.col(f"{f}_1").alias("_k"), F.col(f"{f}_2").alias(f"_{f}")).unionByName(none)
        left = left.withColumn("_k", asks).join(near, "_k").drop("_k")
    left = left.select(
        _key(F.col("_other"), {**v, "price": price + F.col("_dp"), "surface": surface + F.col("_ds"), "court": F.col("_court"), "city": F.col("_city")}).alias("key"),
        "field_set", F.col("id").alias("id_1"), F.col("mask").alias("m1"), *[F.col(f).alias(f"a_{f}") for f in FIELDS], *keep_1)
    right = spread(two, "id").join(F.broadcast(own), "mask").select(
        _key(F.col("mask"), {**v, "price": price, "surface": surface}).alias("key"),
        F.col("id").alias("id_2"), F.col("mask").alias("m2"), *[F.col(f).alias(f"b_{f}") for f in FIELDS], *keep_2)

    met = left.join(right, "key")
    for f, edges in names.items():
        found = edges.select(_both(F.col(f"{f}_1"), F.col(f"{f}_2")).alias("_k"), F.lit(True).alias(f"{f}_like"))
        met = met.withColumn("_k", _both(F.col(f"a_{f}"), F.col(f"b_{f}"))).join(found, "_k", "left").drop("_k")
    agree = {f: F.col(f"a_{f}") == F.col(f"b_{f}") for f in ("date", "type")}
    agree |= {f: F.col(f"{f}_like") for f in names}
    agree |= {f: close(F.col(f"a_{f}"), F.col(f"b_{f}"), t) for f, t in TOLERANCE.items()}
    alike = sum((F.when(agree[f], F.lit(bit)).otherwise(0) for f, bit in BIT.items()), F.lit(0))
    met = met.withColumn("joint", F.col("m1").bitwiseAND(F.col("m2"))).withColumn("alike", alike)
    lowest = _lowest_set(F.col("joint"), F.col("alike"), share)
    return met.filter(F.col("field_set") == lowest).select(
        "id_1", "id_2", weight_of(F.col("alike")).alias("matched"), weight_of(F.col("joint")).alias("weight"), *keep_1, *keep_2)


class Compared(NamedTuple):
    """Two feeds with their names as numbers (NULL where no name of the other feed is like it), their masks and the pairs of like names."""
    one: DataFrame
    two: DataFrame
    masks_1: list[int]
    masks_2: list[int]
    names: dict[str, DataFrame]


def _compared(one: DataFrame, two: DataFrame) -> Compared:
    s1, s2 = signed(one), signed(two)
    # names as a table of edges: joined to the keys and to the pairs, never gathered per name
    like = stored(similar_values(s1, s2, SIMILAR))
    values = like.select("field", F.explode(F.array(
        *[F.struct(F.lit(n).alias("side"), F.col(f"value_{n}").alias("value")) for n in (1, 2)])).alias("v")).select("field", "v.*").distinct()
    # a partition's number and a place in it, made one small number
    numbered = stored(spread(values, "field", "side", "value").withColumn("k", F.monotonically_increasing_id()))
    parts = 1 + (numbered.agg(F.max(F.shiftright("k", 33)).alias("p")).first().p or 0)
    numbered = numbered.withColumn("k", F.shiftright("k", 33) + F.col("k").bitwiseAND(F.lit((1 << 33) - 1)) * F.lit(parts))

    def of(f: str, n: int, value: str, k: str) -> DataFrame:
        return numbered.filter((F.col("field") == f) & (F.col("side") == n)).select(F.col("value").alias(value), F.col("k").alias(k))

    names = {f: like.filter(F.col("field") == f).join(of(f, 1, "value_1", f"{f}_1"), "value_1").join(of(f, 2, "value_2", f"{f}_2"), "value_2").select(f"{f}_1", f"{f}_2")
             for f in SIMILAR}

    def told(s: DataFrame, n: int) -> DataFrame:
        for f in SIMILAR:
            s = s.join(of(f, n, f, "_k"), f, "left").drop(f).withColumnRenamed("_k", f)
        return s.select("seq", "mask", *FIELDS)
    return Compared(told(s1, 1), told(s2, 2), masks(s1), masks(s2), names)


def match_classes(one: DataFrame, two: DataFrame) -> Scores:
    """All that scores at least one half, as pairs of classes beside the classes' rows; each pair of rows lies in exactly one."""
    c = _compared(one, two)
    (c1, rows_1), (c2, rows_2) = _folded(c.one, 1), _folded(c.two, 2)
    pairs = _pairs(c1, c2, *c[2:]).withColumnsRenamed({"id_1": "class_1", "id_2": "class_2"})
    return Scores(pairs, rows_1, rows_2)


def _sig_id(mask: str) -> Column:
    """Text id of a row's mask and compared values."""
    parts = [F.coalesce(F.col(f).cast("string"), F.lit("")) for f in FIELDS]
    return F.concat_ws("|", mask, *[F.concat(F.length(p).cast("string"), F.lit(":"), p) for p in parts])


def match_scores(one: DataFrame, two: DataFrame) -> DataFrame:
    """Row pairs scoring at least one half, as reports list them; `match_classes` has them folded.

    Rows are compared as they are: the pairs come out of the join on the keys and are not shuffled again.
    """
    c = _compared(one, two)
    rows = [s.withColumnRenamed("seq", "id") for s in (c.one, c.two)]
    return _pairs(*rows, *c[2:]).withColumnsRenamed({"id_1": "seq_1", "id_2": "seq_2"})


# --- one partner each -------------------------------------------------------------------

# shares of the weight that candidates are looked for by, one after the other; the last goes on until nothing is left
SHARES = [Fraction(1), Fraction(4, 5), HALF]
# candidates of a row's list, and list rows that one task goes through
AHEAD = 32
TASK_ROWS = 10_000_000
ROW = ["seq_1", "copy"]


def _first_free(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a partition's rows in order, each with its candidates from best to worst: the first candidate no row before it took."""
    taken, served = set(), None
    for batch in batches:
        kept = []
        for i, (seq, copy, wanted) in enumerate(zip(*(batch.column(c).to_pylist() for c in [*ROW, "seq_2"]))):
            if (seq, copy) != served and wanted not in taken:
                taken.add(wanted)
                served = (seq, copy)
                kept.append(i)
        yield batch.take(pa.array(kept, pa.int64()))


def _chosen(lists: DataFrame, held: DataFrame, task_rows: int) -> DataFrame:
    """``held`` (seq_2, seq_1, copy, score) after all rows have gone through their lists.

    Every task lets its rows choose in order, as if there were no others; a candidate then keeps its lowest row, and tasks choose
    anew among what no lower row of another one holds. With one task's rows that is one round.
    """
    me = F.struct(*ROW)
    tasks = 1 + lists.count() // task_rows
    while True:
        asked = lists.join(held.select("seq_2", me.alias("holder")), "seq_2", "left").filter(F.col("holder").isNull() | (F.col("holder") >= me))
        asked = asked.repartition(tasks, "place").select(*ROW, "seq_2", "score").sortWithinPartitions(*ROW, F.desc("score"), "seq_2")
        choices = stored(asked.mapInArrow(_first_free, asked.schema))
        held = stored(held.unionByName(choices).groupBy("seq_2").agg(F.min_by(F.struct(*ROW, "score"), me).alias("k")).select("seq_2", "k.*"))
        # who holds something has chosen it, so equal numbers mean that every choice was granted
        if held.count() == choices.count():
            return held


def one_to_one(one: DataFrame, two: DataFrame, *, slice_rows: int = SLICE_ROWS, ahead: int = AHEAD, task_rows: int = TASK_ROWS) -> DataFrame:
    """Partners as if each first-feed row, in order of ``seq``, took its best free second-feed row.

    Ties go to the lowest second ``seq``. Rows without a partner are given a list of their next ``ahead`` best candidates that no
    lower row holds: those of full score first, then those above the lower shares. The rows of a task choose from their lists in
    order, and of the tasks' choices a candidate keeps the lowest row. A row that has used up its list gets the next one, so no
    list of all pairs is ever kept. The m-th of equal rows starts at the m-th candidate: the earlier ones are certain to be kept
    from it by its own copies.

    Returns ``seq_1, seq_2, score``. Each round is written to the shared folder; the
    loop ends when no unplaced row has a candidate left.
    """
    spark = one.sparkSession
    c = _compared(one.filter("seq IS NOT NULL"), two.filter("seq IS NOT NULL"))
    (classes_1, rows_1), (classes_2, rows_2) = _folded(c.one, 1), _folded(c.two, 2)
    classes_1, classes_2, members = stored(classes_1), stored(classes_2), stored(rows_2.distinct())
    # rows of one day and city want much the same, so they are dealt out together, some thousands at a time
    crowds = rows_1.join(classes_1.select(F.col("id").alias("class_1"), F.xxhash64("date", "city").alias("crowd")), "class_1").withColumn(
        "copy", F.row_number().over(Window.partitionBy("seq_1").orderBy("class_1")))
    rows = stored(positions(crowds, ["crowd"], "seq_1", "_at", tie=["copy"], slice_rows=slice_rows).select(
        "class_1", *ROW, F.xxhash64("crowd", F.floor(F.col("_at") / 4096)).alias("place")))

    held = spark.createDataFrame([], "seq_2 long, seq_1 long, copy int, score double")
    lists = spark.createDataFrame([], "seq_1 long, copy int, place long, seq_2 long, score double")
    done = held.select(ROW)
    for share in chain(SHARES, repeat(HALF)):
        hungry = rows.join(held.select(ROW), ROW, "left_anti").join(done, ROW, "left_anti")
        hungry = stored(positions(hungry, ["class_1"], "seq_1", "m", tie=["copy"], slice_rows=slice_rows))
        most = hungry.agg(F.max("m").alias("m")).first().m
        if most is None:
            return held.select("seq_1", "seq_2", "score")
        asking = hungry.groupBy("class_1").agg(F.min(F.struct(*ROW)).alias("first"), (F.max("m") + ahead).alias("n"))
        offers, cut = _offers(classes_1.join(asking.withColumnRenamed("class_1", "id"), "id"), classes_2, members, held, c, share, most + ahead, slice_rows)
        block = lambda at: F.floor((at - 1) / ahead)
        part = hungry.withColumn("block", F.explode(F.array(block(F.col("m")), block(F.col("m")) + 1))).join(
            offers.withColumn("block", block(F.col("at"))), ["class_1", "block"]).filter((F.col("at") >= F.col("m")) & (F.col("at") < F.col("m") + ahead))
        lists = lists.unionByName(stored(part.select(*ROW, "place", "seq_2", "score")))
        if share == HALF:
            ends = offers.groupBy("class_1").agg(F.max("at").alias("end")).join(cut, "class_1", "left")
            over = hungry.join(ends, "class_1", "left").filter(F.col("cut").isNull() & (F.coalesce("end", F.lit(0)) < F.col("m") + ahead))
            done = stored(done.unionByName(over.select(ROW)))
        held = _chosen(lists, held, task_rows)


def _offers(asking: DataFrame, classes: DataFrame, members: DataFrame, held: DataFrame, c: Compared, share: Fraction,
            most: int, slice_rows: int) -> tuple[DataFrame, DataFrame]:
    """The best ``n`` candidates (class_1, seq_2, score, at) of classes (id, mask, fields, first, n), and the classes that may have more.

    Candidates are free or held by a row above the ``first``, and score ``share`` at least. Free copies are met as one, under their lowest
    ``seq``: only the best ``n`` such groups of a class can hold its best ``n`` rows.
    """
    free = members.join(held.select("seq_2"), "seq_2", "left_anti")
    groups = free.groupBy("class_2").agg(F.min("seq_2").alias("seq_2")).withColumn("holder", F.lit(None).cast("struct<seq_1:long,copy:int>"))
    singles = members.join(held.select("seq_2", F.struct(*ROW).alias("holder")), "seq_2").select("class_2", "seq_2", "holder")
    points = groups.unionByName(singles).join(classes.withColumnRenamed("id", "class_2"), "class_2").withColumnRenamed("seq_2", "id")
    met = _pairs(asking, points, *c[2:], share=share, keep_1=["first", "n"], keep_2=["class_2", "holder"]).filter(
        F.col("holder").isNull() | (F.col("holder") > F.col("first")))
    met = met.select(F.col("id_1").alias("class_1"), "n", "class_2", F.col("id_2").alias("seq_2"), F.col("holder").isNull().alias("free"),
                     (F.col("matched") / F.col("weight")).alias("score"))
    best = Window.partitionBy("class_1").orderBy(F.desc("score"), "seq_2")
    near = stored(met.withColumn("_at", F.row_number().over(best)).filter(F.col("_at") <= most).filter(F.col("_at") <= F.col("n")))
    ranked = positions(free, ["class_2"], "seq_2", "nth", slice_rows=slice_rows).filter(F.col("nth") <= most)
    copies = near.filter("free").drop("seq_2").join(ranked, "class_2").filter(F.col("nth") <= F.col("n")).select("class_1", "n", "seq_2", "score")
    found = copies.unionByName(near.filter("NOT free").select(copies.columns)).groupBy("class_1", "n", "seq_2").agg(F.max("score").alias("score"))
    offers = stored(positions(found, ["class_1"], "seq_2", "at", lead=["score"], slice_rows=slice_rows).filter(F.col("at") <= F.col("n")).drop("n"))
    return offers, near.groupBy("class_1").agg(F.max(F.col("_at") >= F.col("n")).alias("cut")).filter("cut")


# --- merging pairs ----------------------------------------------------------------------

# how the better value of two is chosen; other columns prefer the first feed
LONGER = ["address", "description", "agent_address"]
NUMERIC = ["surface_m2", "rooms", "bedrooms", "start_price"]
LISTS = ["photos", "documents"]
MERGED = [
    "address", "postal_code", "city", "department", "property_type", "surface_m2", "rooms", "bedrooms", "floor",
    "description", "occupancy", "start_price", "sale_date", "sale_time", "court", "agent_name", "agent_firm",
    "agent_phone", "agent_email", "agent_address", "report_url", "photos", "documents",
]


def _filled(df: DataFrame, prefix: str, name: str) -> Column:
    kind = df.schema[f"{prefix}{name}"].dataType.typeName()
    c = F.col(f"{prefix}{name}")
    if kind == "array":
        return has_items(c)
    if kind in ("integer", "long", "double", "float", "short"):
        return has_number(c)
    return has_text(c) if kind == "string" else c.isNotNull()


def _first_wins(name: str, a: Column, b: Column) -> Column:
    """With both values present: does the first feed's one stay?"""
    if name in LONGER:
        return F.length(a) > F.length(b)
    if name == "postal_code":
        return a.rlike(r"^\d{5}$") | ~b.rlike(r"^\d{5}$")
    if name == "city":
        known_a, known_b = known_city(a), known_city(b)
        return F.when(known_a & ~known_b, True).when(known_b & ~known_a, False).otherwise(F.length(a) > F.length(b))
    return F.lit(True)


def merge_pairs(pairs: DataFrame, one: DataFrame, two: DataFrame) -> DataFrame:
    """One merged listing per pair with provenance, notes and confidence.

    Columns outside the merged list are carried with the first feed's value preferred.
    """
    common = [c for c in one.columns if c in two.columns and c != "seq"]
    a = one.select(*[F.col(c).alias(f"a_{c}") for c in ["seq", *common]])
    b = two.select(*[F.col(c).alias(f"b_{c}") for c in ["seq", *common]])
    both = pairs.join(a, F.col("seq_1") == F.col("a_seq")).join(b, F.col("seq_2") == F.col("b_seq"))
    s1, s2 = F.coalesce("a_source", F.lit("source1")), F.coalesce("b_source", F.lit("source2"))
    joined_name = F.concat(s1, F.lit("+"), s2)

    out, provenance, notes, agreements = {}, [], [], F.lit(0)
    for name in [c for c in MERGED if c in common]:
        x, y = F.col(f"a_{name}"), F.col(f"b_{name}")
        fx, fy = _filled(both, "a_", name), _filled(both, "b_", name)
        if name in LISTS:
            value = F.when(fx | fy, F.array_distinct(F.concat(F.coalesce(x, F.array()), F.coalesce(y, F.array()))))
            origin = F.when(fx & fy, joined_name).when(fx, s1).when(fy, s2)
        else:
            stays = F.when(fx & fy, _first_wins(name, x, y)).otherwise(fx)
            value = F.when(fx | fy, F.when(stays, x).otherwise(y))
            origin = F.when(fx | fy, F.when(stays, s1).otherwise(s2))
        differ = fx & fy & ~x.eqNullSafe(y)
        out[name] = value
        provenance.append(F.when(origin.isNotNull(), F.struct(F.lit(name).alias("key"), origin.alias("value"))))
        loser = F.when(origin == s2, x.cast("string")).otherwise(y.cast("string"))
        notes.append(F.when(differ, F.concat(F.lit(f"{name}: picked '"), value.cast("string"), F.lit("' from "), origin,
                                             F.lit(" over '"), loser, F.lit("'"))))
        agreements = agreements + F.when(fx & fy & (x == y), 1).otherwise(0)
    if "visit_times" in common:
        vx, vy = F.coalesce("a_visit_times", F.array()), F.coalesce("b_visit_times", F.array())
        out["visit_times"] = F.array_sort(F.array_union(vx, vy))
        provenance.append(F.when(has_items("a_visit_times") & has_items("b_visit_times"),
                                 F.struct(F.lit("visit_times").alias("key"), joined_name.alias("value"))))
    carried = {c: F.coalesce(f"a_{c}", f"b_{c}") for c in common if c not in out and c not in ("source", "url")}
    merged = both.select(
        "seq_1", "seq_2", joined_name.alias("source"),
        F.when(has_text("a_url"), F.col("a_url")).otherwise(F.col("b_url")).alias("url"),
        *[v.alias(k) for k, v in {**out, **carried}.items()],
        F.map_from_entries(F.array_compact(F.array(*provenance))).alias("field_sources"),
        F.array_compact(F.array(*notes)).alias("pick_notes"), agreements.alias("n_agreements"))
    enriched = enrich_locations(merged)
    counted = [c for c in MERGED if c in enriched.columns]
    filled = sum((F.when(_filled(enriched, "", c), 1).otherwise(0) for c in counted), F.lit(0))
    return enriched.withColumns({
        "confidence": F.when(filled > 0, F.col("n_agreements") / filled).otherwise(0.5),
        "notes": F.concat("pick_notes", "changes"),
    }).drop("pick_notes", "changes", "n_agreements")


def cross_validate(one: DataFrame, two: DataFrame) -> DataFrame:
    """Merged pairs, then the unmatched rows of both feeds, all with enriched locations."""
    matches = one_to_one(one, two).checkpoint()
    merged = merge_pairs(matches, one, two).withColumn("origin", F.lit("merged"))
    rest1 = one.join(matches.select(F.col("seq_1").alias("seq")), "seq", "left_anti")
    rest2 = two.join(matches.select(F.col("seq_2").alias("seq")), "seq", "left_anti")
    alone1 = enrich_locations(rest1).withColumns({"origin": F.lit("first"), "seq_1": F.col("seq")})
    alone2 = enrich_locations(rest2).withColumns({"origin": F.lit("second"), "seq_2": F.col("seq")})
    out = merged
    for alone in (alone1, alone2):
        out = out.unionByName(alone.drop("seq").withColumnRenamed("changes", "notes"), allowMissingColumns=True)
    return out


def match_counters(validated: DataFrame) -> DataFrame:
    """Rows processed, matches found, fields improved (picked or inferred values)."""
    pair = F.col("origin") == "merged"
    improved = F.size(F.filter("notes", lambda n: n.contains("picked") | n.contains("inferred")))
    return validated.agg(
        F.sum(F.when(pair, 2).otherwise(1)).alias("total_processed"), F.count_if(pair).alias("matches_found"),
        F.sum(F.when(pair, improved).otherwise(0)).alias("fields_improved"))


