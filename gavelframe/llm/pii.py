"""Personal data: base patterns, then contextual extraction bootstrapped from what they found.

One Arrow stage reads every whole text and finds the base entities (email, ip, card, phone) and the
candidates: other tokens, or digit groups joined by single blanks, with at least four digits or an at sign. For both it notes lexical patterns: the two words
before, the word before and after, the two words after. Spark then scores the graph of patterns and
instances: a pattern's confidence for a kind is the score of its distinct instances over their number
plus one, an instance's score is one for seeds and else the chance that one of its patterns is right.
Every round scores all patterns anew: a pattern counts once it has `support` distinct instances that are seeds or have reached
`confidence` in the round before, so found identifiers bring in patterns that no seed stands in. After `rounds` rounds
candidates in a pattern of such support and a confidence of at least `confidence` are accepted as
that kind. Base spans always stay; a candidate never overlaps one.

Edges are counted per (pattern, instance) with map-side combination before anything is joined; seeds are summed per pattern
once, and a round joins only the candidates' edges.

A null text is empty. Repeated rows get equal answers, each its own row. Ties between kinds go to the
kind listed first. Other columns of the input are not looked at.
"""

from __future__ import annotations

import re
from bisect import bisect
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gavelframe.llm.base import table, written

KINDS = ("email", "ip", "card", "phone")
_AT = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
#: Maximal chains of digit groups joined by one dot, space or hyphen; ips and cards lie within one.
_CHAIN = re.compile(r"[0-9]++(?:[.\x20-][0-9]++)*+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Digit groups joined by single blanks.
_GROUP = r"\+?\(?[0-9]++(?:[./-][0-9]++)*+\)?"
_GROUPS = re.compile(rf"(?<![^\x20\x09-\x0D.,;:!?\[{{<>\"']){_GROUP}(?:\x20{_GROUP})+(?=[.,;:!?)\]}}<>\"']*(?:[\x20\x09-\x0D]|\Z))")
_SPACE = re.compile(r"[\x20\x09-\x0D]")
_EDGE = ".,;:!?()[]{}<>\"'"

FOUND = ("doc_id {kind}, base array<struct<start:int,kind:int,end:int>>, "
         "marks array<struct<start:int,end:int,seed:int,instance:string,patterns:array<string>>>")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all base entities, sorted."""
    out, upto = [], 0
    for m in _AT.finditer(text):
        s = m.start()
        while s > upto and text[s - 1] in _LOCAL:
            s -= 1
        if s < m.start():
            out.append((s, 0, m.end()))
            upto = m.end()
    for chain in _CHAIN.finditer(text):
        if chain.end() - chain.start() < 7:
            continue
        part = chain[0]
        for m in _IP.finditer(part):
            if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                out.append((chain.start() + m.start(), 1, chain.start() + m.end()))
        for m in _CARD.finditer(part):
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((chain.start() + m.start(), 2, chain.start() + m.end()))
    for m in _PHONE.finditer(text):
        if 10 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
            out.append((m.start(), 3, m.end()))
    out.sort()
    return out


def _word_before(text: str, at: int) -> tuple[str, int]:
    """The word that ends before `at`, without punctuation around it, and where it starts."""
    e = at
    while e > 0 and _SPACE.match(text, e - 1):
        e -= 1
    s = e
    while s > 0 and not _SPACE.match(text, s - 1):
        s -= 1
    return text[s:e].strip(_EDGE).lower(), s


def _word_after(text: str, at: int) -> tuple[str, int]:
    s = at
    while s < len(text) and _SPACE.match(text, s):
        s += 1
    m = _SPACE.search(text, s)
    e = m.start() if m else len(text)
    return text[s:e].strip(_EDGE).lower(), e


def _token(text: str, start: int, end: int) -> tuple[int, int]:
    while start > 0 and not _SPACE.match(text, start - 1):
        start -= 1
    m = _SPACE.search(text, end)
    return start, m.start() if m else len(text)


def _context(text: str, start: int, end: int) -> list[str]:
    start, end = _token(text, start, end)
    (b1, s), (a1, e) = _word_before(text, start), _word_after(text, end)
    b2, a2 = _word_before(text, s)[0], _word_after(text, e)[0]
    return [f"{k}\t{x}\t{y}" for k, x, y in (("before", b2, b1), ("around", b1, a1), ("after", a1, a2)) if x and y]


def _free(taken: list[tuple[int, int]], start: int, end: int) -> bool:
    k = bisect(taken, (start,))
    return all(b <= start or a >= end for a, b in taken[max(0, k - 4): k + 1])


def marks(text: str, base: list[tuple[int, int, int]]) -> list[tuple]:
    """Seeds and candidates with their patterns: (start, end, seed kind or None, instance, patterns)."""
    out = [(s, e, k, text[s:e].lower(), _context(text, s, e)) for s, k, e in base]
    taken = sorted((s, e) for s, _, e in base)
    # groups with a base entity among them stand alone
    chains = [x for x in (m.span() for m in _GROUPS.finditer(text)) if _free(taken, *x)]
    at, c = 0, 0
    for m in re.finditer(r"[0-9]{4}|@|[0-9][^\x20\x09-\x0D]*[0-9]|[0-9]", text):
        if m.start() < at:
            continue
        while c < len(chains) and chains[c][1] <= m.start():
            c += 1
        within = c < len(chains) and chains[c][0] <= m.start()
        s, e = _token(text, *chains[c]) if within else _token(text, m.start(), m.end())
        if s < at:  # the chain began within the token before
            s, e = _token(text, m.start(), m.end())
        at = e
        while s < e and text[s] in _EDGE:
            s += 1
        while e > s and text[e - 1] in _EDGE:
            e -= 1
        clear = _free(taken, s, e)
        if clear and e > s and ("@" in text[s:e] or sum("0" <= c <= "9" for c in text[s:e]) >= 4):
            out.append((s, e, None, text[s:e].lower(), _context(text, s, e)))
    return out


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Base spans and marks of each row."""
    kind = docs.schema[key].dataType.simpleString()
    names = ["doc_id", "base", "marks"]
    span = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))
    mark = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("seed", pa.int32()), ("instance", pa.string()),
                               ("patterns", pa.list_(pa.string()))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x.as_py() or "" for x in batch.column(1)]
            base = [base_spans(t) for t in texts]
            found = [marks(t, b) for t, b in zip(texts, base)]
            yield pa.RecordBatch.from_arrays([
                batch.column(0),
                pa.array([[dict(zip(("start", "kind", "end"), x)) for x in b] for b in base], span),
                pa.array([[dict(zip(("start", "end", "seed", "instance", "patterns"), x)) for x in f] for f in found], mark)], names)

    return docs.select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{text}`").alias("text")).mapInArrow(run, FOUND.format(kind=kind))


def accepted(found: DataFrame, support: int = 5, confidence: float = 0.8, rounds: int | None = None) -> DataFrame:
    """(pattern, kind, confidence) of the patterns that may find unseen identifiers, after as many rounds as bring in new ones."""
    edges = written(found.select(F.explode("marks").alias("m")).select(
        F.explode("m.patterns").alias("pattern"), "m.instance", "m.seed").groupBy("pattern", "instance").agg(
        F.max("seed").alias("seed")), "pattern-edges")
    sizes = edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("size"), F.count(F.when(F.col("seed").isNull(), 1)).alias("unseen"))
    # a pattern without candidates finds nothing, and one smaller than the support never counts
    sizes = written(sizes.where((F.col("unseen") > 0) & (F.col("size") >= support)).drop("unseen"), "pattern-sizes")
    known = edges.where("seed is not null").groupBy("pattern", F.col("seed").alias("kind")).agg(
        F.count(F.lit(1)).cast("double").alias("score"), F.count(F.lit(1)).alias("found"))
    seeds = written(known.join(sizes.select("pattern"), "pattern"), "pattern-seeds")
    open_edges = written(edges.where("seed is null").select("pattern", "instance").join(sizes.select("pattern"), "pattern"), "open-edges")

    def trusted(reached: DataFrame | None) -> DataFrame:
        """(pattern, kind, confidence) of the patterns with support, from seeds and what was reached so far."""
        sums = seeds
        if reached is not None:
            sums = sums.unionByName(open_edges.join(reached, "instance").groupBy("pattern", "kind").agg(
                F.sum("score").alias("score"), F.count(F.when(F.col("score") >= confidence, 1)).alias("found")))
        sums = sums.groupBy("pattern", "kind").agg(F.sum("score").alias("score"), F.sum("found").alias("found"))
        return sums.where(F.col("found") >= support).join(sizes, "pattern").select(
            "pattern", "kind", (F.col("score") / (F.col("size") + 1)).alias("confidence"))

    reached, seen, number = None, None, 0
    while True:
        trust = written(trusted(reached), "patterns")
        good = trust.where(F.col("confidence") >= confidence)
        names = good.select("pattern", "kind")
        fresh = names if seen is None else names.join(seen, ["pattern", "kind"], "left_anti")
        if number == rounds or fresh.isEmpty() and number:
            return good
        seen = names if seen is None else seen.unionByName(fresh)
        number += 1
        doubt = F.exp(F.sum(F.log(F.greatest(F.lit(1e-12), 1 - F.col("confidence")))))
        reached = written(open_edges.join(trust, "pattern").groupBy("instance", "kind").agg(
            (1 - doubt).alias("score")), "pattern-scores")


def _listed(spans: Column) -> Column:
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(kinds, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def find(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """doc_id, `base` and `added` spans (start, kind, end) of each row."""
    found = written(scan(docs, key, text).withColumn("row", F.monotonically_increasing_id()), "pii")
    unseen = found.select("row", F.explode("marks").alias("m")).where("m.seed is null").select(
        "row", "m.start", "m.end", F.explode("m.patterns").alias("pattern"))
    best = unseen.join(accepted(found, **options), "pattern").groupBy("row", "start", "end").agg(
        F.max_by("kind", F.struct("confidence", -F.col("kind"))).alias("kind"))
    added = best.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "kind", "end"))).alias("added"))
    return found.join(added, "row", "left").select(
        "doc_id", "base", F.coalesce("added", F.expr("cast(array() as array<struct<start:int,kind:int,end:int>>)")).alias("added"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents"))
    counts = [F.expr(f"size(filter(base, s -> s.kind = {k}))").cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return found.select(
        "doc_id", *counts, F.sha2(_listed(F.col("base")), 256).alias("base_sha256"),
        _listed(F.sort_array(F.concat("base", "added"))).alias("spans"), F.size("added").cast("long").alias("n_added"))
