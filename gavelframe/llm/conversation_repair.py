"""Conversation repair: cheapest edits that give every conversation the roles `(s?(ua)+)?`, on a suffix-shared automaton.

A row's first fault counts: blank (no word), duplicate (role and text seen earlier in the conversation),
truncated (the last character that is no white space is none of `.!?`). Keep costs 0, Rerole (to user or assistant) 1,
Delete 2 and is all a blank or duplicate row allows, Insert of an empty turn 5 anywhere; a truncated row that
stays adds 5. Of equally cheap edits the audit (their initials, in order) that is least in ASCII is taken.

1. Signatures. Every row becomes a symbol of its role's initial and its fault. First occurrences are an
   aggregate by (conversation, role, digest of the text); rows are sorted by conversation and turn over all
   tasks, so a conversation of any length is cut at task borders and comes together again as one symbol a row.
2. Automaton. Its nodes are the suffixes of all signatures, so conversations that end alike share theirs. Sorted by
   their reversed signature, conversations come in the order of a walk over that automaton from its end: a node is
   entered once by each task that meets it, and only the nodes from the end to the present one are held. Entering a node computes,
   for each of the four grammar states, cost and first edit of the best way to the end from those of the next
   node: the rest of the best audit is shared by all who reach that node in that state. The edits open to a node
   and state have different initials, so the first one decides ties.
3. Audits are read along the automaton and meet the texts of their conversation, which travel once.

Conversations with the same signature may be a third of all: they are spread over tasks by their key as well. One audit, a
letter a row, must fit one cell and eight times that the task that makes it; texts of a conversation are streamed.

Null roles and texts count as one space, a null turn comes before all others, and rows of a null key are
one conversation. Rows of equal turn are ordered by role, then by the digest of their text; equal rows are
duplicates of each other. Rows marked as absent only say that the conversation exists. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gavelframe.llm.base import partitions, table

ROLES, FAULTS = "suax", ("none", "blank", "duplicate", "truncated")
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: Grammar states: nothing yet, after s, after u, after a. What a state takes by Rerole or Insert, and where that leads.
START, SYSTEM, USER, ASSISTANT = range(4)
TAKES = (USER, USER, ASSISTANT, USER)
#: (state, role) that may stand: s only at the start, u anywhere but after u, a after u.
KEEPS = {(START, 0): SYSTEM, (START, 1): USER, (SYSTEM, 1): USER, (USER, 2): ASSISTANT, (ASSISTANT, 1): USER}
LEGAL = {(0, 1), (1, 2), (2, 1)}
FAR = 1 << 60

PIECES = "key long, piece long, signature string, first long, last long, turns long"
AUDITS = "key long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
ROWS = "key long, position long, edit string, role string, text string, facts array<long>"
DIGESTS = "key long, facts array<long>, audit string, repaired_sha256 string"


def symbol(role: int, fault: int) -> str:
    return chr(97 + 4 * fault + role)


class Suffixes:
    """The automaton along one walk: nodes from the end (depth 0) to the present suffix, one symbol each."""

    def __init__(self):
        self.symbols = ""  # the suffix, last symbol first
        self.cost = array("q", (0, FAR, FAR, 0))
        self.edit = bytearray(b"....")
        self.counts = array("q", (0, 0, 0, 0))  # blank, duplicate, truncated, illegal
        self._insert(self.cost, self.edit)

    @staticmethod
    def _insert(cost, edit) -> None:
        """An empty turn may come before the rest; from USER and ASSISTANT it leads to the other."""
        base = list(cost)
        for s in (USER, ASSISTANT, START, SYSTEM):
            other = base[TAKES[s]] if s in (USER, ASSISTANT) else cost[TAKES[s]]
            if (other + INSERT, "I") < (cost[s], chr(edit[s])):
                cost[s], edit[s] = other + INSERT, ord("I")

    def enter(self, signature: str) -> None:
        """Go to the node of a whole signature, back to the shared suffix first."""
        turned = signature[::-1]
        same, most = 0, min(len(turned), len(self.symbols))
        while same < most:  # the longest shared start by doubling steps
            step = 1
            while same + step <= most and turned[same: same + step] == self.symbols[same: same + step]:
                same += step
                step *= 2
            if step == 1:
                break
        del self.cost[4 * (same + 1):], self.edit[4 * (same + 1):], self.counts[4 * (same + 1):]
        for at in range(same, len(turned)):
            self._push(turned[at], turned[at - 1] if at else None)
        self.symbols = turned

    def _push(self, this: str, following: str | None) -> None:
        fault, role = divmod(ord(this) - 97, 4)
        after = self.cost[-4:]
        cost, edit = [0] * 4, bytearray(4)
        extra = TRUNCATED if fault == 3 else 0
        for s in range(4):
            best = (after[s] + DELETE, "D")
            if fault in (0, 3):
                best = min(best, (after[TAKES[s]] + REROLE + extra, "R"))
                if (s, role) in KEEPS:
                    best = min(best, (after[KEEPS[s, role]] + KEEP + extra, "K"))
            cost[s], edit[s] = best[0], ord(best[1])
        self._insert(cost, edit)
        self.cost.extend(cost)
        self.edit += edit
        counts = self.counts[-4:]
        if fault:
            counts[fault - 1] += 1
        if following is not None and (role, (ord(following) - 97) % 4) not in LEGAL:
            counts[3] += 1
        self.counts.extend(counts)

    def audit(self) -> str:
        """The best edits of the present signature, read from node to node."""
        out, state, node = bytearray(), START, len(self.symbols)
        while node or self.edit[state] != 46:
            e = self.edit[4 * node + state]
            out.append(e)
            if e == 75:
                state = KEEPS[state, (ord(self.symbols[node - 1]) - 97) % 4]
            elif e != 68:
                state = TAKES[state]
            if e != 73:
                node -= 1
        return out.decode()


def _turns(rows: DataFrame, key: str, turn: str, role: str, text: str, copies: str) -> DataFrame:
    filled = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))
    return rows.select(F.col(f"`{key}`").cast("long").alias("key"), F.col(f"`{turn}`").cast("long").alias("turn"), filled(role).alias("role"),
                       F.md5(filled(text).cast("binary")).alias("digest"), filled(text).alias("text"), F.col(f"`{copies}`").alias("copies"))


def signatures(turns: DataFrame) -> DataFrame:
    """(key, signature, gaps) of every conversation of (key, turn, role, digest, text, copies)."""
    solid = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    narrow = turns.select("key", "turn", "role", "digest", "copies", (solid == "").alias("blank"), (~solid.isin(".", "!", "?")).alias("cut"))
    lone = narrow.groupBy("key", "turn", "role", "digest", "blank", "cut").agg(F.sum("copies").alias("copies"))
    first = lone.where("copies > 0").groupBy(F.col("key").alias("k"), F.col("role").alias("r"), F.col("digest").alias("d")).agg(
        F.bool_or(F.col("turn").isNull()).alias("untimed"), F.min("turn").alias("earliest"))
    same = F.col("key").eqNullSafe(F.col("k")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d"))
    judged = lone.join(first, same, "left")
    earliest = F.col("turn").isNull() | (~F.col("untimed") & (F.col("turn") == F.col("earliest")))
    initial = F.substring("role", 1, 1)
    who = F.when(initial.isin(*"sua"), F.instr(F.lit(ROLES), initial)).otherwise(4) - 1
    fault = F.when(F.col("blank"), 1).when(~earliest, 2).when(F.col("cut"), 3).otherwise(0)
    again = F.when(F.col("blank"), 1).otherwise(2)
    letter = lambda f: F.char(97 + 4 * f + who)
    symbols = F.when(F.col("copies") > 0, F.concat(letter(fault), F.repeat(letter(again), (F.col("copies") - 1).cast("int")))).otherwise("")
    ordered = judged.select("key", "turn", "role", "digest", symbols.alias("symbols")).orderBy(
        "key", F.col("turn").asc_nulls_first(), "role", "digest")
    pieces = ordered.select("key", "turn", "symbols").mapInArrow(_pieces, PIECES)
    each = pieces.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("piece", "signature", "first", "last", "turns"))).alias("p"))
    # a turn that goes on in the next piece is one turn
    distinct = F.expr("""aggregate(p, struct(0L as n, cast(null as bigint) as last),
        (s, x) -> struct(s.n + x.turns - if(coalesce(s.last = x.first, false), 1L, 0L) as n, coalesce(x.last, s.last) as last), s -> s.n)""")
    span = F.array_max("p.last") - F.array_min("p.first") + 1
    return each.select("key", F.array_join("p.signature", "").alias("signature"), F.coalesce(span - distinct, F.lit(0)).cast("long").alias("gaps"))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sorted rows: the symbols and turns of each conversation's part of a batch. Only rows that are there count."""
    number = TaskContext.get().partitionId() << 32
    for batch in batches:
        if not batch.num_rows:
            continue
        key, null = np.asarray(batch.column(0).fill_null(0)), np.asarray(batch.column(0).is_null())
        starts = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (null[1:] != null[:-1])]))
        ends = np.append(starts[1:], batch.num_rows)
        turns, symbols = batch.column(1).to_pylist(), batch.column(2).to_pylist()
        out = []
        for a, b in zip(starts.tolist(), ends.tolist()):
            there = sorted({t for t, s in zip(turns[a:b], symbols[a:b]) if s and t is not None})
            out.append((None if null[a] else int(key[a]), number, "".join(symbols[a:b]),
                        there[0] if there else None, there[-1] if there else None, len(there)))
        number += 1
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*out), [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()])],
            ["key", "piece", "signature", "first", "last", "turns"])


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Signatures in the order of their reversal, walked over the automaton."""
    nodes, before, known = Suffixes(), None, ()
    for batch in batches:
        out = []
        for signature in batch.column(1).to_pylist():
            if signature != before:
                nodes.enter(signature)
                known, before = (*nodes.counts[-4:], nodes.cost[-4], nodes.audit()), signature
            out.append(known)
        columns = zip(*out) if out else [[]] * 6
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(2), *[pa.array(c, pa.int64() if i < 5 else pa.string()) for i, c in enumerate(columns)]],
            ["key", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"])


def audits(turns: DataFrame) -> DataFrame:
    """(key, gaps, blank, duplicate, truncated, illegal, cost, audit) of every conversation."""
    walked = signatures(turns).orderBy(F.reverse("signature"), "key").select("key", "signature", "gaps")
    return walked.mapInArrow(_walk, AUDITS)


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows behind the audit of their conversation: the audit as `edit`, without a position, then the repaired rows."""
    audit, at, state, position, key = "", 0, START, 0, None

    def inserted():
        nonlocal at, state, position
        while audit[at: at + 1] == "I":
            state = TAKES[state]
            yield key, position, "I", "user" if state == USER else "assistant", "", None
            at, position = at + 1, position + 1

    for batch in batches:
        out = []
        for k, facts, row_audit, role, text in zip(*[c.to_pylist() for c in batch.columns]):
            out += inserted()
            if row_audit is not None:
                key, audit, at, state, position = k, row_audit, 0, START, 0
                out.append((k, None, audit, None, None, facts))
                continue
            edit = audit[at]
            at += 1
            if edit == "D":
                continue
            if edit == "K":
                state = KEEPS[state, ROLES.find(role[0])]
            else:
                state = TAKES[state]
                role = "user" if state == USER else "assistant"
            out.append((key, position, edit, role, text, None))
            position += 1
        yield _rows(out, ROWS)
    yield _rows(list(inserted()), ROWS)


def _rows(out: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "string": pa.string(), "array<long>": pa.list_(pa.int64())}
    names, types = zip(*(x.split(" ") for x in schema.split(", ")))
    columns = zip(*out) if out else [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, t in zip(columns, types)], list(names))


def _repaired(turns: DataFrame, audited: DataFrame) -> DataFrame:
    """Repaired rows of each conversation in order, behind a row without a position that has its audit and counts."""
    empty = lambda kind, *names: [F.lit(None).cast(kind).alias(n) for n in names]
    rows = turns.withColumn("one", F.explode(F.expr("array_repeat(1, int(copies))"))).select(
        "key", *empty("array<long>", "facts"), *empty("string", "audit"), "turn", "role", "digest", "text")
    heads = audited.select("key", F.array("gaps", "blank", "duplicate", "truncated", "illegal", "cost").alias("facts"), "audit",
                           *empty("long", "turn"), *empty("string", "role", "digest", "text"))
    both = rows.unionByName(heads).repartition(partitions(turns.sparkSession), "key").sortWithinPartitions(
        "key", F.col("audit").isNull(), F.col("turn").asc_nulls_first(), "role", "digest")
    return both.select("key", "facts", "audit", "role", "text").mapInArrow(_edited, ROWS)


def repair(rows: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(key, position, edit, role, text) of the repaired conversations; deleted rows are left out."""
    present = "_".join(["copies", *rows.columns])  # no column is called so
    turns = _turns(rows.withColumn(present, F.lit(1)), key, turn, role, text, present)
    return _repaired(turns, audits(turns)).where("position is not null").drop("facts").withColumnRenamed("key", key)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Audit and counts of each conversation, and the sha256 of its `role:text` lines, streamed."""
    head, digest = None, None
    for batch in batches:
        out = []
        for key, position, edit, role, text, facts in zip(*[c.to_pylist() for c in batch.columns]):
            if position is None:
                if head:
                    out.append((*head, digest.hexdigest()))
                head, digest = (key, facts, edit), hashlib.sha256()
            else:
                digest.update(f"{chr(10) if position else ''}{role}:{text}".encode("utf-8", "surrogatepass"))
        yield _rows(out, DIGESTS)
    if head:
        yield _rows([(*head, digest.hexdigest())], DIGESTS)


def damaged(rows: DataFrame) -> DataFrame:
    """Conversations with faults, as a crc32 of `conv_id:turn` decides; `copies` is 0 where the row is dropped."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    k = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    rows = rows.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), k.alias("k"))
    text = F.when(F.col("k") == 1, "").when(F.col("k") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return rows.select("conv_id", "turn", F.when(F.col("k") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
                       F.when(F.col("k") == 0, 0).when(F.col("k") == 3, 2).otherwise(1).alias("copies"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _turns(damaged(table(spark, sf_dir, "conversations")), "conv_id", "turn", "role", "text", "copies")
    found = _repaired(turns, audits(turns)).mapInArrow(_digests, DIGESTS)
    names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return found.select(F.col("key").alias("conv_id"), *[F.col("facts")[i].alias(n) for i, n in enumerate(names)], "audit", "repaired_sha256")


def _least(*choices: str) -> str:
    return f"list_min([{', '.join(choices)}])"


def _step(edit: str, cost: str, after: str) -> str:
    return f"{{'c': {after}.c + {cost}, 'a': '{edit}' || {after}.a}}"


#: Rows in their order with damage and faults, then the best (cost, audit) of each grammar state from the last row to the first.
OP12_SQL = rf"""
WITH RECURSIVE crc_table AS (
  SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)),
      lambda v, k: xor(v >> 1, CASE WHEN v & 1 = 1 THEN 3988292384 ELSE 0 END)) AS v FROM range(256) r(i))),
keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
hashed AS (
  SELECT conv_id, turn, role, text, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, len(k) + 1), lambda i: ascii(k[i])::BIGINT)),
    lambda c, v: xor(c >> 8, t[(xor(c, v) & 255) + 1])), 4294967295::BIGINT) % 20 AS k FROM keyed, crc_table),
damaged AS (
  SELECT conv_id, turn, CASE k WHEN 4 THEN 'user' ELSE role END AS role,
    CASE k WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM (SELECT *, unnest(range(CASE k WHEN 3 THEN 2 ELSE 1 END)) FROM hashed WHERE k <> 0)),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text)) AS i,
    regexp_extract(text, '([^ 	-
])[ 	-
]*$', 1) AS last FROM damaged),
judged AS (
  SELECT *, CASE WHEN last = '' THEN 1 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 2 WHEN last NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault,
    lead(role[1]) OVER (PARTITION BY conv_id ORDER BY i) AS next, max(i) OVER (PARTITION BY conv_id) AS n FROM placed),
best AS (
  SELECT conv_id, n + 1 AS i, {{'c': 0, 'a': ''}} AS s0, {{'c': 10, 'a': 'II'}} AS s1, {{'c': 5, 'a': 'I'}} AS s2, {{'c': 0, 'a': ''}} AS s3
  FROM judged WHERE i = n
  UNION ALL
  SELECT conv_id, i, {_least("n0", _step("I", "5", "m2"))}, {_least("n1", _step("I", "5", "m2"))}, m2, m3
  FROM (SELECT *, {_least("n2", _step("I", "5", "n3"))} AS m2, {_least("n3", _step("I", "5", "n2"))} AS m3
  FROM (SELECT conv_id, i,
    CASE WHEN fault IN (1, 2) THEN {_step("D", "2", "s0")} WHEN role[1] = 's' THEN {_least(_step("K", "x", "s1"), _step("D", "2", "s0"), _step("R", "1 + x", "s2"))}
      WHEN role[1] = 'u' THEN {_least(_step("K", "x", "s2"), _step("D", "2", "s0"))} ELSE {_least(_step("R", "1 + x", "s2"), _step("D", "2", "s0"))} END AS n0,
    CASE WHEN fault IN (1, 2) THEN {_step("D", "2", "s1")} WHEN role[1] = 'u' THEN {_least(_step("K", "x", "s2"), _step("D", "2", "s1"))}
      ELSE {_least(_step("R", "1 + x", "s2"), _step("D", "2", "s1"))} END AS n1,
    CASE WHEN fault IN (1, 2) THEN {_step("D", "2", "s2")} WHEN role[1] = 'a' THEN {_least(_step("K", "x", "s3"), _step("D", "2", "s2"))}
      ELSE {_least(_step("R", "1 + x", "s3"), _step("D", "2", "s2"))} END AS n2,
    CASE WHEN fault IN (1, 2) THEN {_step("D", "2", "s3")} WHEN role[1] = 'u' THEN {_least(_step("K", "x", "s2"), _step("D", "2", "s3"))}
      ELSE {_least(_step("R", "1 + x", "s2"), _step("D", "2", "s3"))} END AS n3
    FROM (SELECT j.conv_id, j.i, role, fault, CASE fault WHEN 3 THEN 5 ELSE 0 END AS x, s0, s1, s2, s3
      FROM best b JOIN judged j ON j.conv_id IS NOT DISTINCT FROM b.conv_id AND j.i = b.i - 1)))),
ends AS (SELECT conv_id, s0.c AS cost, s0.a AS audit FROM best WHERE i = 1),
letters AS (
  SELECT conv_id, p, audit[p] AS e, len(replace(audit[1:p], 'I', '')) AS i FROM (SELECT *, unnest(range(1, len(audit) + 1)) AS p FROM ends)),
staying AS (
  SELECT l.conv_id, p, CASE WHEN e <> 'I' THEN text ELSE '' END AS text, CASE WHEN e = 'K' THEN role END AS role,
    row_number() OVER (PARTITION BY l.conv_id ORDER BY p) - 1 AS j
  FROM letters l LEFT JOIN judged g ON g.conv_id IS NOT DISTINCT FROM l.conv_id AND g.i = l.i AND e <> 'I' WHERE e <> 'D'),
spoken AS (
  SELECT conv_id, j, text, coalesce(role, CASE WHEN (j - count_if(j = 0 AND role[1] = 's') OVER (PARTITION BY conv_id)) % 2 = 0
    THEN 'user' ELSE 'assistant' END) AS role FROM staying),
digests AS (SELECT conv_id, sha256(string_agg(role || ':' || text, chr(10) ORDER BY j)) AS d FROM spoken GROUP BY conv_id),
counted AS (
  SELECT conv_id, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count_if(fault = 1) AS blank, count_if(fault = 2) AS duplicate,
    count_if(fault = 3) AS truncated, count_if(next IS NOT NULL AND role[1] || next NOT IN ('su', 'ua', 'au')) AS illegal FROM judged GROUP BY conv_id),
every AS (SELECT DISTINCT conv_id FROM conversations)
SELECT e.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
  coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit,
  coalesce(d, sha256('')) AS repaired_sha256
FROM every e LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM e.conv_id LEFT JOIN ends x ON x.conv_id IS NOT DISTINCT FROM e.conv_id
LEFT JOIN digests g ON g.conv_id IS NOT DISTINCT FROM e.conv_id
"""
