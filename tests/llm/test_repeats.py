"""Repeated windows, conversation repair and periodic runs against brute force."""

import hashlib
import random
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gavelframe.llm import conversation_repair as repair
from gavelframe.llm import periodic_runs as periodic
from gavelframe.llm import repeated_windows as repeated
from test_corpus import SCHEMA, WORD, _texts

EXTRA = ", ".join(f"{n} string" for n in ("grp", "batch", "tok", "runs", "kept", "copies", "k", "text_", "key", "words", "n"))


@pytest.fixture(scope="module")
def odd(spark):
    rng = random.Random(4)
    words = lambda n, k=9: " ".join(f"w{rng.randrange(k)}" for _ in range(n))
    shared = words(70, 500)
    texts = [*_texts(), shared, "x " + shared, shared.replace(" ", "\t") + "\n" + words(30), words(20) + " " + shared[:300], "a b c " * 40, "a b c " * 40 + "z " + "q " * 60]
    rows = [(i, t, "en", ("b", None)[i % 2], i, *["clash"] * 9) for i, t in enumerate(texts)]
    rows += [(6, texts[6], *[None] * 12), (6, shared, *[None] * 12), (None, texts[6], *[None] * 12), (None, shared + " end", *[None] * 12), (None, words(60, 500), *[None] * 12)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


def _sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def _rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# 11 -----------------------------------------------------------------------------------------

def _windows(rows, length):
    ids = [float("inf") if i is None else i for i, _ in rows]
    words = [WORD.findall(t or "") for _, t in rows]
    first = {}
    for i, w in zip(ids, words):
        for p in range(len(w) - length + 1):
            first[tuple(w[p:p + length])] = min(i, first.get(tuple(w[p:p + length]), i))
    out = []
    for (key, _), i, w in zip(rows, ids, words):
        gone = set()
        for p in range(len(w) - length + 1):
            if first[tuple(w[p:p + length])] < i:
                gone.update(range(p, p + length))
        spans = [(p, next(q for q in range(p, len(w) + 1) if q not in gone)) for p in sorted(gone) if p - 1 not in gone]
        out.append((key, len(w), spans, " ".join(x for p, x in enumerate(w) if p not in gone)))
    return sorted(out, key=repr)


def _got(df):
    return sorted(((r.doc_id, r.n_words, [tuple(s) for s in r.removed], r.kept) for r in df.collect()), key=repr)


@pytest.mark.parametrize("length", [50, 7])
def test_repeated_windows_on_odd_rows(spark, odd, length):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert _got(repeated.without_repeated_windows(odd, length=length)) == _windows(rows, length)


@pytest.mark.parametrize("length", [2, 3, 8])
def test_repeated_windows_over_few_words(spark, length):
    """A tiny alphabet: windows overlap themselves, repeat within a document and tie everywhere."""
    rng = random.Random(length)
    rows = [(rng.choice([None, *range(40)]), " ".join(rng.choice("ab") for _ in range(rng.randrange(30)))) for _ in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert _got(repeated.without_repeated_windows(df, length=length)) == _windows(rows, length)


def test_repeated_windows_in_many_batches(spark, monkeypatch):
    """A third of all documents hold one passage, some are copies; batches of three documents."""
    rng = random.Random(9)
    words = lambda n: " ".join(f"w{rng.randrange(30)}" for _ in range(n))
    passage, copy = words(25), words(40)
    rows = [(i, f"{words(rng.randrange(9))} {passage} {words(rng.randrange(9))}" if i % 3 == 0 else copy if i % 3 == 1 else words(30)) for i in range(120)]
    rng.shuffle(rows)
    monkeypatch.setattr(repeated, "SLICE_DOCS", 3)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = repeated.without_repeated_windows(df, length=10)
    assert _got(found) == _windows(rows, 10)


def test_repeated_windows_of_nothing(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert repeated.without_repeated_windows(empty).collect() == []
    assert _got(repeated.without_repeated_windows(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string"))) == [(1, 0, [], ""), (2, 0, [], "")]
    with pytest.raises(ValueError):
        repeated.without_repeated_windows(empty, length=1)


# 12 -----------------------------------------------------------------------------------------

def _judge(rows):
    """(kept rows as in the order, counts) of one conversation given as (turn, role, text) after damage."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.md5(r[2].encode()).hexdigest()))
    seen, faults = set(), []
    for _, role, text in rows:
        solid = "".join(WORD.findall(text))
        faults.append(1 if not solid else 2 if (role, text) in seen else 3 if solid[-1] not in ".!?" else 0)
        seen.add((role, text))
    return rows, faults


def _best(rows, faults):
    """Cheapest edits by plain recursion over whole audits: (cost, audit, output)."""
    ends = {0: [], 3: []}
    goes = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}

    @lru_cache(None)
    def go(i, state, inserted):
        found = [(0, "", ())] if i == len(rows) and state in ends else []
        if inserted < 3:
            for c in "ua":
                if (state, c) in goes:
                    cost, audit, out = go(i, goes[state, c], inserted + 1)
                    found.append((cost + 5, "I" + audit, (({"u": "user", "a": "assistant"}[c], ""), *out)))
        if i < len(rows):
            _, role, text = rows[i]
            cost, audit, out = go(i + 1, state, 0)
            found.append((cost + 2, "D" + audit, out))
            if faults[i] in (0, 3):
                for c, name, price, e in [(role[:1], role, 0, "K"), ("u", "user", 1, "R"), ("a", "assistant", 1, "R")]:
                    if (state, c) in goes:
                        cost, audit, out = go(i + 1, goes[state, c], 0)
                        found.append((cost + price + (5 if faults[i] == 3 else 0), e + audit, ((name, text), *out)))
        return min(found, key=lambda f: f[:2]) if found else (10 ** 6, "", ())
    return go(0, 0, 0)


def _conversations(rows):
    """Rows (conv_id, turn, role, text, copies) to the contract's answer."""
    out = {}
    for conv, turn, role, text, copies in rows:
        out.setdefault(conv, []).extend([(turn, " " if role is None else role, " " if text is None else text)] * copies)
    answers = []
    for conv, turns in out.items():
        ordered, faults = _judge(turns)
        real = [t for t, _, _ in ordered if t is not None]
        gaps = max(real) - min(real) + 1 - len(set(real)) if real else 0
        initials = [r[:1] for _, r, _ in ordered]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        cost, audit, repaired = _best(ordered, tuple(faults))
        answers.append((conv, gaps, *(faults.count(f) for f in (1, 2, 3)), illegal, cost, audit, _sha("\n".join(f"{r}:{t}" for r, t in repaired))))
    return sorted(answers, key=repr)


def _damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if k == 1 else "".join(c for c in text if c not in ".!?") if k == 2 else text
        out.append((conv, turn, "user" if k == 4 else role, text, {0: 0, 3: 2}.get(k, 1)))
    return out


TALK = "conv_id long, turn long, role string, text string, " + EXTRA


def _talk(seed, n, most):
    rng = random.Random(seed)
    texts = [None, "", " \t", "one.", "two!", "three?", "cut", "cut ", "said. \n", "é…", "漢字.", "four.", "five.", "x" * 3000 + "."]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", None, "", "unknown", "Sam"]
    rows = []
    for c in range(n):
        turns = rng.randrange(most)
        plain = rng.random() < 0.5
        for t in range(turns):
            role = ("user", "assistant")[t % 2] if plain and rng.random() < 0.8 else rng.choice(roles)
            text = f"words {rng.randrange(1000)}." if plain and rng.random() < 0.7 else rng.choice(texts)
            rows.append((rng.choice([c, c, c, 3, None]), rng.choice([t, t, t, None, 2 * t, -t]), role, text))
    return rows


def test_conversations_as_the_contract_says(spark, tmp_path):
    rows = _talk(1, 150, 9)
    rows += rows[:40]
    df = spark.createDataFrame([(*r, *["clash"] * 11) for r in rows], TALK).repartition(4)
    df.write.parquet(str(tmp_path / "conversations.parquet"))
    got = repair.op12_conversation_repair(spark, str(tmp_path)).select(
        "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    assert _rows(got) == _conversations(_damaged(rows))


def test_conversation_repair_itself(spark):
    rows = [r for r in _talk(2, 60, 7)]
    df = spark.createDataFrame([(*r, *["clash"] * 11) for r in rows], TALK).repartition(3)
    got = {}
    for r in repair.repair(df).orderBy("conv_id", "position").collect():
        got.setdefault(r.conv_id, []).append((r.position, r.role, r.text))
    digests = {c: _sha("\n".join(f"{r}:{t}" for _, r, t in x)) for c, x in got.items()}
    want = {a[0]: a[-1] for a in _conversations([(*r, 1) for r in rows])}
    assert {c: digests.get(c, _sha("")) for c in want} == want
    assert all([p for p, _, _ in x] == list(range(len(x))) for x in got.values())


def test_one_long_conversation_over_many_tasks(spark):
    """Two thirds of all rows are one conversation, many of them alike; its parts come together again."""
    rng = random.Random(3)
    rows = [(7, i // 2, rng.choice(["user", "assistant", "assistant", "system"]), rng.choice(["same.", f"t{i}.", f"t{i}.", "", "cut"])) for i in range(2000)]
    rows += [(i, 0, "user", "a.") for i in range(500)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(6)
    turns = repair._turns(df.withColumn("copies", F.lit(1)), "conv_id", "turn", "role", "text", "copies")
    assert turns.count() == 2500
    pieces = repair.audits(turns).where("key = 7").first()
    ordered, faults = _judge([(t, r, x) for c, t, r, x in rows if c == 7])
    costs = {0: 0, 3: 0, 1: 10, 2: 5}
    for (_, role, _), fault in zip(reversed(ordered), reversed(faults)):
        new = {}
        for s in range(4):
            best = costs[s] + 2
            if fault in (0, 3):
                extra = 5 if fault == 3 else 0
                to, takes = {0: (2, "u"), 1: (2, "u"), 2: (3, "a"), 3: (2, "u")}[s]
                best = min(best, costs[to] + extra + (0 if role[0] == takes else 1))
                if s == 0 and role[0] == "s":
                    best = min(best, costs[1] + extra)
            new[s] = best
        new[2], new[3] = min(new[2], new[3] + 5), min(new[3], new[2] + 5)
        new[0], new[1] = min(new[0], new[2] + 5), min(new[1], new[2] + 5)
        costs = new
    assert pieces.cost == costs[0] and (pieces.blank, pieces.duplicate, pieces.truncated) == tuple(faults.count(f) for f in (1, 2, 3))
    assert sum(c != "I" for c in pieces.audit) == len(ordered)


def test_no_conversations(spark):
    empty = spark.createDataFrame([], TALK)
    assert repair.repair(empty).collect() == []


def test_every_short_signature():
    """The automaton against plain recursion for all signatures up to four rows, in walk order."""
    from itertools import product
    symbols = [repair.symbol(r, f) for r in range(4) for f in (0, 1, 3)]
    names = dict(zip(range(4), ("system", "user", "assistant", "other")))
    every = sorted(("".join(s) for n in range(4) for s in product(symbols, repeat=n)), key=lambda s: s[::-1])
    nodes = repair.Suffixes()
    for s in every:
        nodes.enter(s)
        faults, roles = zip(*(divmod(ord(c) - 97, 4) for c in s)) if s else ((), ())
        cost, audit, _ = _best(tuple((i, names[r], "x") for i, r in enumerate(roles)), faults)
        assert (nodes.cost[-4], nodes.audit()) == (cost, audit), s


# 13 -----------------------------------------------------------------------------------------

def _runs(w, least=24, times=3):
    out = []
    for q in range(1, len(w) // times + 1):
        i = q
        while i < len(w):
            if w[i] != w[i - q]:
                i += 1
                continue
            a = i
            while i < len(w) and w[i] == w[i - q]:
                i += 1
            start, length = a - q, i - a + q
            if length >= max(least, times * q) and not any(
                    all(w[j] == w[j - p] for j in range(start + p, start + length)) for p in range(1, q)):
                out.append((start, length, q))
    return sorted(out)


def _tails(key, text):
    words = WORD.findall(text or "")
    h, n = zlib.crc32(str(key).encode()), len(words)
    if key is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    return words


def _kept(words, runs):
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


@pytest.mark.parametrize("seed", range(4))
def test_runs_of_random_sequences(seed):
    rng = random.Random(seed)
    for _ in range(250):
        k, (least, times) = rng.choice([1, 2, 3, 5]), rng.choice([(24, 3), (6, 2), (8, 3), (5, 2), (4, 2), (9, 4)])
        rows = []
        for _ in range(rng.randrange(4)):
            w, n = [], rng.randrange(120)
            while len(w) < n:
                block = [rng.randrange(k) for _ in range(rng.randint(1, 9))]
                w += (block * 12)[: rng.randint(1, len(block) * 8)]
            rows.append(w)
        for w in rows:
            assert periodic.runs_of(w, least, times) == _runs(w, least, times)
        text = pa.array([" ".join(map(str, w)) for w in rows], pa.string())
        got = periodic._read(pa.RecordBatch.from_arrays([pa.array(range(len(rows)), pa.int64()), text], ["key", "text"]), least, times).to_pylist()
        for w, g in zip(rows, got):
            want = _runs(w, least, times)
            assert [tuple(r.values()) for r in g["runs"]] == want and g["n_words"] == len(w) and g["kept"] == _kept(map(str, w), want)


def test_periodic_runs_on_odd_rows(odd):
    rows = odd.select("doc_id", "text").collect()
    got = periodic.periodic_runs(odd).collect()
    want = [(r.doc_id, *(lambda w: (len(w), _runs(w) if len(w) < 5000 else [], w))(WORD.findall(r.text or ""))) for r in rows]
    assert sorted((str(r.doc_id), r.n_words, [tuple(x) for x in r.runs], r.kept) for r in got) == sorted(
        (str(k), n, runs, _kept(w, runs)) for k, n, runs, w in want)
    assert periodic.periodic_runs(odd.limit(0)).collect() == []


def test_periodic_query_on_whole_documents(spark, sf_dir):
    """Every document with a made period is held against brute force, the others against their shorter stretches."""
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = {r.doc_id: r for r in periodic.op13_periodic_runs(spark, sf_dir).collect()}
    assert set(got) == set(docs)
    some = 0
    for key, text in docs.items():
        words = _tails(key, text)
        if len(words) > 1500:
            continue
        runs, r = _runs(words), got[key]
        best = max(runs, key=lambda x: (x[1] / x[2], -x[0], -x[2]), default=(None, None, None))
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *best)
        assert r.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        assert r.runs_sha256 == _sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)) and r.collapsed_sha256 == _sha(_kept(words, runs))
        some += bool(runs)
    assert some > 5


def test_tails_made_periodic(spark):
    rows = [(i, t) for i in range(60) for t in (None, "", "one", "a b\tc  d e f g", " ".join(map(str, range(40))))] + [(None, "a b c")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r.doc_id), WORD.findall(r.text or "")) for r in periodic.repeated_tails(df).collect())
    assert got == sorted((str(k), _tails(k, t)) for k, t in rows)


def test_stretches_hash_alike_only_for_equal_words():
    from gavelframe.llm.packs import Stretches, splitmix
    rng = np.random.default_rng(1)
    codes = rng.integers(0, 2, 300)
    h = Stretches(splitmix(codes.astype(np.uint64) + np.uint64(1)))
    for n in (1, 2, 5, 16):
        at = np.arange(300 - n + 1)
        known = {}
        for a, x in zip(at, h(at, n)):
            assert known.setdefault(int(x), tuple(codes[a:a + n])) == tuple(codes[a:a + n])
        assert len(known) == len({tuple(codes[a:a + n]) for a in at})
