"""N-gram Jaccard join: classes of documents linked by word shingles, found with prefix trees.

A document's set holds the 64-bit hashes of its distinct 5-word shingles. Two sets link when
100 * |intersection| >= 75 * |union|; the answer is the component of each document.

1. Sharing. Postings travel to buckets of tokens as packed arrays, one row for each batch of documents
   and bucket. A token that several documents of a batch hold is sent once with its count, so a
   frequent token costs one entry a batch, not one a document. The bucket tells each batch which of its
   tokens occur elsewhere. Nobody can overlap a document in more than its shared tokens, so documents
   that share less than three quarters of their set are done: they are alone.
2. Equal sets are one class. Every set has a token of its own, so a batch learns in the same exchange which of its sets an
   earlier batch holds already and keeps none of theirs. What is left is shared out again, now with exact frequencies. All sets are
   kept in one global order, frequent tokens first; the last (rarest) tokens that any partner must
   touch are the class's prefix. Classes that touch a common prefix token form a candidate group.
3. Each group is a prefix tree, so sets that begin alike share their path. A set walks the tree once,
   its overlap with a path is counted once for all sets below, and a subtree is cut when the overlap so
   far plus what remains on either side can't reach the bound. Links are united as they are found; a
   group that has become one component is finished.
4. A group over `chunk_tokens` is dealt out to chunks. Chunks are joined inside, then the representatives
   of the components found, then every class outside the group's largest component against all chunks.
   So each pair of classes of one group is either tested or already in one component. Who meets whom is worked out on ids;
   the sets join in last.

Tokens are compared by at least 56 bits within a pair of documents and 64 bits make up the fingerprints
twice, so a wrong link needs a collision inside one compared pair.

Null texts and texts without words have an empty set and are linked with nothing. Repeated rows are
equal sets and so one component. A null id never becomes a component's name unless it is alone. The
input should be a table (a scan reads alike if a task is run again). Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gavelframe.llm.base import deleted, partitions, table, written
from gavelframe.llm.components import components, linked_by
from gavelframe.llm.packs import hash_words, runs, slices, splitmix

SHINGLE = 5
MANY = 0xFFFF
SLICE_DOCS, SLICE_BYTES = 10_000, 4 << 20
CHUNK_TOKENS = 400_000
NO_ID = np.iinfo(np.int64).max
_K = np.random.default_rng(5).integers(1, 1 << 63, 2 * SHINGLE, dtype=np.uint64) | np.uint64(1)
_U = np.uint64

POSTED = "grp long, batch long, ids binary, n binary, fp1 binary, fp2 binary, tok binary, doc binary, len binary, cnt binary"
SHARED = "batch long, grp long, ids binary, n binary, fp1 binary, fp2 binary, tok binary, doc binary, len binary, df binary"
SETS = "id long, n long, fp1 long, fp2 long, class long, size int, toks binary, dfs binary, prefix array<long>"
FIRST = np.uint32(1 << 31)  # on a frequency: no earlier batch holds the token
DOC_BITS = 14  # a slice has at most 2 ** 14 documents


def shingle_sets(words: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each row, and the offset of each row's first and of the end."""
    counts = np.diff(off)
    sizes = np.where(counts >= SHINGLE, counts - SHINGLE + 1, (counts > 0).astype(np.int64))
    start = np.concatenate([[0], np.cumsum(sizes)])
    toks = np.empty(int(start[-1]), _U)
    long = counts >= SHINGLE
    if long.any():
        s = np.zeros(len(words) - SHINGLE + 1, _U)
        for j in range(SHINGLE):
            s += words[j: len(words) - SHINGLE + 1 + j] * _K[j]
        s = splitmix(s)
        at = np.arange(int(sizes[long].sum())) + np.repeat(off[:-1][long] - (np.cumsum(sizes[long]) - sizes[long]), sizes[long])
        toks[np.repeat(long, sizes)] = s[at]
    for i in np.flatnonzero((counts > 0) & ~long):
        part = words[off[i]: off[i + 1]]
        toks[start[i]] = splitmix(np.array([(part * _K[SHINGLE: SHINGLE + len(part)]).sum() + _U(len(part))], _U))[0]
    for a, b in zip(start[:-1], start[1:]):
        toks[a:b].sort()
    new = np.ones(len(toks), bool)
    new[1:] = toks[1:] != toks[:-1]
    new[start[:-1][sizes > 0]] = True
    return toks[new], np.concatenate([[0], np.cumsum(new)])[start]


def _sums(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    total = np.concatenate([[_U(0)], np.cumsum(values, dtype=_U)])
    return total[off[1:]] - total[off[:-1]]


def _row(names: list[str], values: list) -> pa.RecordBatch:
    kinds = [pa.int64() if isinstance(v, int) else pa.binary() for v in values]
    return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names)


_POSTED, _SHARED = ([x.split(" ")[0] for x in schema.split(", ")] for schema in (POSTED, SHARED))


def _own_token(fp1: np.ndarray) -> np.ndarray:
    """The token that stands for a whole set."""
    return splitmix(fp1.view(_U) ^ _K[1])


def _spread(values: np.ndarray, lengths: np.ndarray) -> tuple[bytes, bytes]:
    return values.tobytes(), lengths.astype(np.uint32).tobytes()


def post(batch: int, ids, n, fp1, fp2, toks, off, buckets: int, width: int) -> Iterator[pa.RecordBatch]:
    """Rows for the buckets of tokens, and one for the batch itself. Equal sets of a batch are posted once."""
    first: dict[tuple, int] = {}
    own = np.array([first.setdefault((a, b), i) == i for i, (a, b) in enumerate(zip(fp1.tolist(), fp2.tolist()))], bool) & (n > 0)
    sizes = np.diff(off)
    pick = np.repeat(own, sizes)
    doc = np.concatenate([np.repeat(np.arange(len(ids)), sizes)[pick], np.flatnonzero(own)])
    toks = np.concatenate([toks[pick], _own_token(fp1[own])])
    if width == 6:
        key = (((toks & _U(0xFFFF)) % _U(buckets)) << _U(48)) | (toks >> _U(16))
        order = np.argsort(key)
        toks = key[order]
    else:
        order = np.argsort(toks)
        toks = toks[order]
    doc = doc[order].astype(np.uint16)
    starts, lengths = runs(toks)
    many = lengths > 1
    sent = np.where(many, MANY, doc[starts]).astype(np.uint16) if len(starts) else np.zeros(0, np.uint16)
    tok = toks[starts]
    bucket = tok >> _U(48) if width == 6 else splitmix(tok) % _U(buckets)
    # tokens of one document stand together, so documents are sent as runs
    order = np.lexsort((sent, bucket))
    tok, sent, many, bucket, count = tok[order], sent[order], many[order], bucket[order], lengths[order].astype(np.uint32)
    cuts = np.searchsorted(bucket, np.arange(buckets + 1, dtype=_U))
    raw = tok.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]
    used = np.flatnonzero(np.diff(cuts))
    if len(used):
        parts = [(slice(cuts[b], cuts[b + 1])) for b in used]
        spread = [_spread(sent[p][s], l) for p in parts for s, l in [runs(sent[p])]]
        empty = [None] * len(used)
        yield pa.RecordBatch.from_arrays(
            [pa.array(used, pa.int64()), pa.array([batch] * len(used), pa.int64()), *[pa.array(empty, pa.binary())] * 4,
             pa.array([raw[p].tobytes() for p in parts], pa.binary()), pa.array([d for d, _ in spread], pa.binary()),
             pa.array([l for _, l in spread], pa.binary()), pa.array([count[p][many[p]].tobytes() for p in parts], pa.binary())], _POSTED)
    inside = np.repeat(lengths > 1, lengths)
    yield _row(_POSTED, [buckets + batch, batch, ids.tobytes(), n.tobytes(), fp1.tobytes(), fp2.tobytes(),
                         toks[inside].tobytes(), doc[inside].tobytes(), None, None])


def _tokens(raws: list[bytes], buckets: list[int], width: int) -> np.ndarray:
    sizes = [len(r) // width for r in raws]
    raw = np.zeros((sum(sizes), 8), np.uint8)
    raw[:, :width] = np.frombuffer(b"".join(raws), np.uint8).reshape(-1, width)
    tok = raw.view("<u8").ravel().astype(_U)
    return tok | (np.repeat(np.array(buckets, _U), sizes) << _U(48)) if width == 6 else tok


def _docs(docs: list[bytes], lens: list[bytes]) -> np.ndarray:
    return np.repeat(np.frombuffer(b"".join(docs), np.uint16), np.frombuffer(b"".join(lens), np.uint32))


def _tell(width: int):
    """Of one bucket: to each batch, which of its tokens occur at least twice, how often, and if it is the first to hold them."""
    def run(t: pa.Table) -> pa.Table:
        if t["ids"][0].is_valid:
            return pa.table([*[t[c] for c in _SHARED[:1]], t["grp"], *[t[c] for c in _SHARED[2:8]],
                             *[pa.array([None] * len(t), pa.binary())] * 2], names=_SHARED)
        bucket = t["grp"][0].as_py()
        raws = t["tok"].to_pylist()
        tok = _tokens(raws, [bucket] * len(raws), width)
        doc = _docs(t["doc"].to_pylist(), t["len"].to_pylist())
        row = np.repeat(np.arange(len(raws)), [len(r) // width for r in raws])
        batch = np.asarray(t["batch"])
        count = np.ones(len(tok), np.int64)
        count[doc == MANY] = np.frombuffer(b"".join(t["cnt"].to_pylist()), np.uint32)
        order = np.argsort(tok, kind="stable")
        starts, lengths = runs(tok[order])
        df, first = np.empty(len(tok), np.int64), np.empty(len(tok), bool)
        df[order] = np.repeat(np.add.reduceat(count[order], starts), lengths)
        first[order] = np.repeat(np.minimum.reduceat(batch[row[order]], starts), lengths) == batch[row[order]]
        at = np.flatnonzero(df > 1)
        told = df[at].astype(np.uint32) | np.where(first[at], FIRST, np.uint32(0))
        heads, spans = runs(row[at])
        parts = [at[a: a + b] for a, b in zip(heads, spans)]
        spread = [_spread(doc[p][s], l) for p in parts for s, l in [runs(doc[p])]]
        none = pa.array([None] * len(parts), pa.binary())
        raw = tok.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]
        return pa.table([
            pa.array(batch[row[at[heads]]] if len(heads) else [], pa.int64()), pa.array([bucket] * len(parts), pa.int64()), none, none, none, none,
            pa.array([raw[p].tobytes() for p in parts], pa.binary()), pa.array([d for d, _ in spread], pa.binary()),
            pa.array([l for _, l in spread], pa.binary()), pa.array([told[a: a + b].tobytes() for a, b in zip(heads, spans)], pa.binary())], names=_SHARED)
    return run


def _gather(width: int):
    """Of one batch of documents: the sets, each held by one batch, of those that share enough to have a partner."""
    def run(t: pa.Table) -> pa.Table:
        own = t["ids"].is_valid().to_pylist().index(True)
        batch = t["batch"][0].as_py()
        ids, n, fp1, fp2 = (np.frombuffer(t[c][own].as_py(), np.int64) for c in ("ids", "n", "fp1", "fp2"))
        local_tok, local_doc = np.frombuffer(t["tok"][own].as_py(), _U), np.frombuffer(t["doc"][own].as_py(), np.uint16)
        cols = {c: [v for i, v in enumerate(t[c].to_pylist()) if i != own] for c in ("grp", "tok", "doc", "len", "df")}
        tok = _tokens(cols["tok"], cols["grp"], width)
        doc = _docs(cols["doc"], cols["len"])
        df = np.frombuffer(b"".join(cols["df"]), np.uint32)
        many = doc == MANY
        many_tok, many_df = tok[many], df[many]
        by = np.argsort(many_tok)
        at = np.searchsorted(many_tok[by], local_tok)
        local_df = many_df[by][at] if len(local_tok) else np.zeros(0, np.uint32)
        tok, doc, df = (np.concatenate(x) for x in ((tok[~many], local_tok), (doc[~many], local_doc), (df[~many], local_df)))
        mark = _own_token(fp1)
        if width == 6:
            mark = (((mark & _U(0xFFFF)) % _U(_bucket_count(t, own, batch))) << _U(48)) | (mark >> _U(16))
        whole = tok == mark[doc]
        copies = np.zeros(len(ids), bool)
        copies[doc[whole]] = (df[whole] & FIRST) == 0
        tok, doc, df = tok[~whole], doc[~whole], df[~whole] & ~FIRST
        shared = np.bincount(doc, minlength=len(ids))
        least = -(-3 * n // 4)
        live = (shared >= least) & (n > 0) & ~copies
        pick = live[doc]
        tok, doc, df = tok[pick], doc[pick], df[pick]
        order = np.lexsort((tok, -df.astype(np.int64), doc))
        tok, df = tok[order], df[order]
        upto = np.concatenate([[0], np.cumsum(np.where(live, shared, 0))])
        cut = [(slice(a, b), slice(b - (s - o + 1), b)) if ok else None
               for a, b, s, o, ok in zip(upto[:-1], upto[1:], shared, least, live)]
        return pa.table([
            pa.array(ids), pa.array(n), pa.array(fp1), pa.array(fp2),
            pa.array((batch << DOC_BITS) + np.arange(len(ids)), mask=~live), pa.array(shared.astype(np.int32)),
            pa.array([c and tok[c[0]].tobytes() for c in cut], pa.binary()), pa.array([c and df[c[0]].tobytes() for c in cut], pa.binary()),
            pa.array([None if c is None else tok[c[1]].view(np.int64) for c in cut], pa.list_(pa.int64()))],
            names=["id", "n", "fp1", "fp2", "class", "size", "toks", "dfs", "prefix"])
    return run


def _bucket_count(t: pa.Table, own: int, batch: int) -> int:
    """The number of buckets: a batch's own row has the group `buckets` + batch."""
    return t["grp"][own].as_py() - batch


def _share(rows: DataFrame, read, width: int) -> DataFrame:
    """The sets of `rows` after telling each batch what others hold. `read` makes arrays of an Arrow batch."""
    buckets = min(65536, 4 * partitions(rows.sparkSession))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 24
        for whole in batches:
            for part in slices(whole, whole.num_columns - 1, SLICE_BYTES, SLICE_DOCS):
                yield from post(number, *read(part), buckets, width)
                number += 1

    return (rows.mapInArrow(run, POSTED).groupBy("grp").applyInArrow(_tell(width), SHARED)
            .groupBy("batch").applyInArrow(_gather(width), SETS))


def _read_texts(batch: pa.RecordBatch):
    ids = np.asarray(batch.column(0).cast(pa.int64()).fill_null(NO_ID))
    toks, off = shingle_sets(*hash_words(batch.column(1)))
    mixed = splitmix(toks)
    return ids, np.diff(off), _sums(mixed, off).view(np.int64), _sums(splitmix(mixed ^ _K[0]), off).view(np.int64), toks, off


def _read_classes(batch: pa.RecordBatch):
    ids = np.asarray(batch.column(0))
    blobs = batch.column(2).to_pylist()
    off = np.concatenate([[0], np.cumsum([len(b) // 8 for b in blobs])]).astype(np.int64)
    return ids, np.asarray(batch.column(1)), ids, ids, np.frombuffer(b"".join(blobs), _U), off


# --- prefix trees ---------------------------------------------------------------------------

class Trie:
    """Path-compressed prefix tree over ascending code lists; node 0 is the root, leaves carry a set."""

    def __init__(self, codes: list[np.ndarray], n: np.ndarray):
        order = sorted(range(len(codes)), key=lambda i: codes[i].astype(">u4").tobytes())
        parent, end, doc, sample = [-1], [0], [-1], [order[0]]
        stack, prev = [0], None
        for i in order:
            if prev is not None:
                a, b = codes[prev], codes[i]
                k = min(len(a), len(b))
                diff = np.flatnonzero(a[:k] != b[:k])
                lcp, last = int(diff[0]) if len(diff) else k, None
                while end[stack[-1]] > lcp or doc[stack[-1]] >= 0:
                    last = stack.pop()
                if end[stack[-1]] < lcp:
                    parent.append(stack[-1])
                    end.append(lcp)
                    doc.append(-1)
                    sample.append(i)
                    parent[last] = len(parent) - 1
                    stack.append(len(parent) - 1)
            parent.append(stack[-1])
            end.append(len(codes[i]))
            doc.append(i)
            sample.append(i)
            stack.append(len(parent) - 1)
            prev = i
        self.doc, self.end, self.n = np.array(doc), np.array(end), n
        self.kids: list[list[int]] = [[] for _ in parent]
        for k, p in enumerate(parent[1:], 1):
            self.kids[p].append(k)
        self.kids = [np.array(k, np.int64) for k in self.kids]
        begin = [0 if p < 0 else end[p] for p in parent]
        spans = [codes[s][a:b] for s, a, b in zip(sample, begin, end)]
        self.flat = np.concatenate(spans) if spans else np.zeros(0, np.int64)
        upto = np.concatenate([[0], np.cumsum([len(s) for s in spans])])
        self.first, self.last = upto[:-1], upto[1:]
        self.final = np.array([codes[s][b - 1] if b else -1 for s, b in zip(sample, end)])
        size = len(parent)
        self.least, self.most, self.longest = np.full(size, np.iinfo(np.int64).max), np.zeros(size, np.int64), np.zeros(size, np.int64)
        order_up, todo = [], [0]
        while todo:
            x = todo.pop()
            order_up.append(x)
            todo += self.kids[x].tolist()
        for x in reversed(order_up):
            if doc[x] >= 0:
                self.least[x] = self.most[x] = n[doc[x]]
                self.longest[x] = end[x]
            p = parent[x]
            if p >= 0:
                self.least[p] = min(self.least[p], self.least[x])
                self.most[p] = max(self.most[p], self.most[x])
                self.longest[p] = max(self.longest[p], self.longest[x])

    def partners(self, codes: np.ndarray, size: int, marks: np.ndarray) -> np.ndarray:
        """Sets of the tree that link with a set of `size` shingles whose shared ones are `codes`."""
        marks[codes] = 1
        upto = np.concatenate([[0], np.cumsum(marks[self.flat])])
        marks[codes] = 0
        found, front, before = [], self.kids[0], np.zeros(len(self.kids[0]), np.int64)
        while len(front):
            over = before + upto[self.last[front]] - upto[self.first[front]]
            left = np.minimum(len(codes) - np.searchsorted(codes, self.final[front], "right"), self.longest[front] - self.end[front])
            other = np.maximum(self.least[front], -(-3 * size // 4))
            keep = (7 * (over + left) >= 3 * (size + other)) & (4 * self.most[front] >= 3 * size) & (3 * self.least[front] <= 4 * size)
            front, over = front[keep], over[keep]
            sets = self.doc[front]
            leaf = sets >= 0
            hit = sets[leaf]
            found.append(hit[7 * over[leaf] >= 3 * (size + self.n[hit])])
            inner = [(self.kids[x], o) for x, o in zip(front[~leaf], over[~leaf])]
            front = np.concatenate([k for k, _ in inner]) if inner else np.zeros(0, np.int64)
            before = np.concatenate([np.full(len(k), o) for k, o in inner]) if inner else before
        return np.concatenate(found) if found else np.zeros(0, np.int64)


def links(ids: np.ndarray, n: np.ndarray, toks: list[bytes], dfs: list[bytes], probes: np.ndarray | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the links among the sets, or of those that touch `probes`."""
    if len(ids) < 2:
        return []
    sizes = [len(t) // 8 for t in toks]
    alltok, alldf = np.frombuffer(b"".join(toks), _U), np.frombuffer(b"".join(dfs), np.uint32)
    uniq, at, inv = np.unique(alltok, return_index=True, return_inverse=True)
    rank = np.empty(len(uniq), np.int64)
    rank[np.lexsort((uniq, -alldf[at].astype(np.int64)))] = np.arange(len(uniq))
    codes = np.split(rank[inv], np.cumsum(sizes)[:-1])
    trie, marks = Trie(codes, n), np.zeros(len(uniq), np.int32)
    above = np.arange(len(ids))
    left = len(ids) - 1

    def top(x: int) -> int:
        while above[x] != x:
            above[x] = above[above[x]]
            x = above[x]
        return x

    out = []
    for x in range(len(ids)) if probes is None else np.flatnonzero(probes):
        for y in trie.partners(codes[x], int(n[x]), marks):
            a, b = top(x), top(int(y))
            if a != b:
                above[max(a, b)] = min(a, b)
                out.append((int(ids[x]), int(ids[y])))
                left -= 1
        if not left:
            break
    return out


def _unit(t: pa.Table) -> pa.Table:
    probes = np.asarray(t["probe"]).astype(bool) if "probe" in t.column_names else None
    found = links(np.asarray(t["id"]), np.asarray(t["n"]), t["toks"].to_pylist(), t["dfs"].to_pylist(), probes)
    return pa.table([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], names=["a", "b"])


def _chunked(members: DataFrame, chunk_tokens: int) -> DataFrame:
    """(g, id, size) with the number of chunks of their group, and their own."""
    sizes = members.groupBy("g").agg(F.ceil(F.sum("size") / chunk_tokens).cast("int").alias("chunks"))
    return members.join(sizes, "g").withColumn("chunk", F.expr("pmod(xxhash64(id), chunks)"))


def tree_links(members: DataFrame, sets: DataFrame, chunk_tokens: int = CHUNK_TOKENS) -> DataFrame:
    """Links (a, b) that span the components of the sets (id, n, toks, dfs); only members (g, id, size) of one group g can link."""
    def units(plan: DataFrame, *by: str) -> DataFrame:
        return sets.join(plan, "id").groupBy(*by).applyInArrow(_cross if "probe" in plan.columns else _unit, "a long, b long")

    dealt = written(_chunked(members, chunk_tokens), "members")
    found = written(units(dealt.select("id", "g", "chunk"), "g", "chunk"), "links")
    wide = dealt.where("chunks > 1")
    if wide.isEmpty():
        return found

    def labelled(known: DataFrame) -> DataFrame:
        return wide.join(components(known), "id", "left").withColumn("label", F.coalesce("label", "id"))

    heads = written(_chunked(labelled(found).where("id = label").select("g", "id", "size"), chunk_tokens), "members")
    found = written(found.unionByName(units(heads.select("id", "g", "chunk"), "g", "chunk")), "links")
    now = written(labelled(found), "members")
    per = now.groupBy("g", "label").agg(F.count(F.lit(1)).alias("c"))
    largest = per.groupBy("g").agg(F.max_by("label", F.struct("c", "label")).alias("largest"))
    strays = written(_chunked(now.join(largest, "g").where("label <> largest").select("g", "id", "size"), chunk_tokens)
                     .withColumnsRenamed({"chunks": "parts", "chunk": "part"}), "members")
    counts, whole = strays.groupBy("g").agg(F.first("parts").alias("parts")), now.groupBy("g").agg(F.first("chunks").alias("chunks"))
    cols = ["id", "g", "part", "chunk", "probe"]
    probing = strays.join(whole, "g").withColumn("chunk", F.explode(F.expr("sequence(0L, chunks - 1L)"))).withColumn("probe", F.lit(1))
    probed = now.join(counts, "g").withColumn("part", F.explode(F.expr("sequence(0L, parts - 1L)"))).withColumn("probe", F.lit(0))
    plan = written(probing.select(cols).unionByName(probed.select(cols)), "members")
    return found.unionByName(written(units(plan, "g", "part", "chunk"), "links"))


def _cross(t: pa.Table) -> pa.Table:
    """A stray that is itself in the chunk comes twice; once is enough, as a probe."""
    ids, probe = np.asarray(t["id"]), np.asarray(t["probe"])
    order = np.lexsort((-probe, ids))
    first = np.concatenate([[True], ids[order][1:] != ids[order][:-1]])
    return _unit(t.take(pa.array(order[first])))


# --- the join -------------------------------------------------------------------------------

def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", chunk_tokens: int = CHUNK_TOKENS) -> DataFrame:
    """Of each row: its key, n_shingles, component_id and a `row` number in scan order of the written sets."""
    texts = docs.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text"))
    sets, path = written(_share(texts, _read_texts, 6).drop("dfs", "prefix", "size"), "shingles", with_path=True)
    # a class is named by the set that kept its tokens, if any
    classes = written(sets.where("n > 0").groupBy("fp1", "fp2").agg(F.min("id").alias("first_id"), F.max("class").alias("id")), "classes")
    rows = written(sets.select("id", "n", "fp1", "fp2"), "rows")
    live = written(_share(sets.where("class is not null").select("class", "n", "toks"), _read_classes, 8)
                   .where("toks is not null").select("id", "n", "size", "toks", "dfs", "prefix"), "live")
    deleted(docs.sparkSession, path)
    groups = components(linked_by(live.select("id", F.explode("prefix").alias("tok")), "tok", "id"))
    members = live.select("id", "size").join(groups.select("id", F.col("label").alias("g")), "id").select("g", "id", "size")
    labels = components(tree_links(members, live.select("id", "n", "toks", "dfs"), chunk_tokens))
    named = classes.where("id is not null").join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))
    names = named.groupBy("label").agg(F.min("first_id").alias("component_id"))
    alone = classes.where("id is null").select("fp1", "fp2", F.col("first_id").alias("component_id"))
    found = rows.join(named.join(names, "label").select("fp1", "fp2", "component_id").unionByName(alone), ["fp1", "fp2"], "left")
    null = F.lit(int(NO_ID))
    return found.select(
        F.nullif("id", null).alias(key), F.col("n").alias("n_shingles"),
        F.nullif(F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")), null).alias("component_id"))


def without_near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` with one document of each component: that with the smallest key.

    Where keys are missing or repeat, rows are numbered and the first row of each component stays.
    """
    columns = docs.columns
    unsure = docs.groupBy(key).count().where(f"count > 1 or `{key}` is null")
    own = key
    if not unsure.isEmpty():
        own = "_" + "_".join(columns)  # no column is called so
        docs = written(docs.withColumn(own, F.monotonically_increasing_id()), "numbered")
    gone = near_duplicates(docs, own, text).where(F.col(f"`{own}`") != F.col("component_id")).select(F.col(f"`{own}`").alias("gone"))
    return docs.join(written(gone, "gone"), F.col(f"`{own}`") == F.col("gone"), "left_anti").select(*[F.col(f"`{c}`") for c in columns])


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


OP4_SQL = """
WITH RECURSIVE docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
grams AS (
  SELECT DISTINCT doc_id, s FROM (
    SELECT doc_id, array_to_string(w[p:p + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS p FROM docs WHERE len(w) > 0))),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
pairs AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM grams x JOIN grams y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL),
linked AS (
  SELECT a, b FROM pairs JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * i >= 75 * (p.n + q.n - i)),
walk(doc_id, other) AS (SELECT doc_id, doc_id FROM docs UNION SELECT walk.doc_id, b FROM walk JOIN linked ON a = other)
SELECT doc_id, coalesce(n, 0) AS n_shingles, least(doc_id, min(other)) AS component_id
FROM walk LEFT JOIN sizes USING (doc_id) GROUP BY doc_id, n
"""
