"""Corpus operators against brute force, on rows that are odd in every way the docstrings name."""

import base64
import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from gavelframe.llm import decontam, html_text, langid, line_dedup, mixing, ngram_join, pii, quality, sharding, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard string, slot string, size string, label string, row string, batch string, line string, target string, word string"


def _texts():
    rng = np.random.default_rng(3)
    vocab = ["the", "of", "and", *("".join(rng.choice(list("abcdeghilnorst"), rng.integers(2, 9))) for _ in range(400))]
    prose = lambda n: " ".join(rng.choice(vocab, n))
    base, other = prose(120), prose(90)
    near = base.split(" ")
    near[60] = "changed"
    half = " ".join(near[:70]) + " " + prose(50)
    lines = "\n".join(prose(12) for _ in range(6))
    first = lines.split("\n")[0].split(" ")
    return [
        None, "", " \t\n\x0b\x0c\r ", "a", "one two three", "ONE Two three", base, base, " ".join(near), base.upper(), half, other,
        other + " tail", prose(30_000), "x" * 50_000, lines, lines + "\n" + " ".join(first[:-1]), " ".join(["new", *first]),
        " ".join([*first[:4], "other", *first[5:]]), "éè ñ 漢字   ß", "\n\n" + base + "\n", "same same same same same same same same same",
        "a.b@c.de@f.gh +49 (30) 123-4567 8 1.2.3.4 999.1.1.1 4111 1111 1111 1111 4111-1111-1111-1112 01.02.03.04.05",
        "& % $ # words with | and * < > all over the place in it", "12345 !!! ...",
    ]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, ("en", "de", None)[i % 3], ("b", "a", None)[i % 3], i, *["clash"] * 9) for i, t in enumerate(_texts())]
    rows += [rows[6], rows[6], (None, _texts()[6], None, None, None, *[None] * 9)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def _pairs(df):
    return [(r.doc_id, r.text) for r in df.collect()]


# 1 ------------------------------------------------------------------------------------------

def test_sharding(odd, empty):
    rows = sharding.shard(odd, 4).collect()
    n = odd.count()
    sizes = Counter(r.shard for r in rows)
    assert len(rows) == n and max(sizes.values()) - min(sizes.values()) <= 1
    for s in sizes:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sizes[s]))
    again = sharding.shard(odd.repartition(7), 4).select("doc_id", "text", "shard", "slot")
    known = {(r.doc_id, r.shard, r.slot) for r in rows if r.doc_id not in (None, 6)}
    assert known <= {(r.doc_id, r.shard, r.slot) for r in again.collect()}
    assert sharding.shard(empty, 4).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 10, 97, 1000, 5000])
def test_permutation_is_a_bijection(spark, n):
    a = int(np.ceil(np.sqrt(n)))
    rows = spark.range(n).withColumn("y", sharding.permutation("id", f"{n}L", f"{a}L", f"{-(-n // a)}L", 5)).collect()
    assert sorted(r.y for r in rows) == list(range(n))


# 2 ------------------------------------------------------------------------------------------

def _targets(sizes):
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, open_, out = sum(sizes.values()), set(order), {}
    while open_:
        share = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if share * weight[s] > 3 * sizes[s]}
        if not over:
            return out | {s: share * weight[s] for s in open_}
        for s in over:
            out[s] = 3 * sizes[s]
            left -= out[s]
        open_ -= over
    return out


@pytest.mark.parametrize("broadcast", [0, 1 << 20])
def test_mixing(odd, empty, broadcast):
    size = mixing.word_count(F.col("text"))
    rows = mixing.with_copies(odd, size, broadcast_bytes=broadcast).select(
        "row.doc_id", "row.source", "size", "source_size", "target", "copies", "row.text").collect()
    assert len(rows) == odd.count()
    assert all(r.size == len(WORD.findall(r.text or "")) for r in rows)
    sizes = Counter()
    for r in rows:
        sizes[r.source] += r.size
    want = _targets(sizes)
    for r in rows:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6
        rate = r.target / r.source_size
        assert int(rate) <= r.copies <= min(3, int(rate) + 1)
    assert mixing.mix(odd).count() == sum(r.copies for r in rows) and mixing.mix(odd).columns == odd.columns
    assert mixing.mix(empty).count() == 0


def test_mixing_comes_near_its_targets_without_ids(spark):
    """A third of the rows have no id, as many share one, half of these are alike in all else."""
    rows = [(None, f"{'w ' * 9}x{i if i % 2 else 0}", "a") for i in range(600)] + [(7, f"{'w ' * 9}y{i}", "b") for i in range(600)]
    rows += [(i, "w " * (1 + i % 30), "c") for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5).cache()
    out = mixing.with_copies(df, mixing.word_count(F.col("text"))).select("row.source", "size", "target", "copies").collect()
    for source in "abc":
        mine = [r for r in out if r.source == source]
        taken, target = sum(r.size * r.copies for r in mine), mine[0].target
        # as independent draws: three and a half times their spread at most
        assert abs(taken - target) < 3.5 * sum(r.size ** 2 / 4 for r in mine) ** 0.5, (source, taken, target)
    assert sorted(map(tuple, out)) == sorted(map(tuple, mixing.with_copies(df, mixing.word_count(F.col("text"))).select(
        "row.source", "size", "target", "copies").collect()))


# 3 ------------------------------------------------------------------------------------------

BASE = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")


def _base(text):
    out = []
    for k, p in enumerate(BASE):
        for m in re.finditer(p, text or ""):
            d = re.sub(r"[^0-9]", "", m[0])
            if (k == 1 and any(int(x) > 255 for x in m[0].split("."))) or (k == 2 and not (14 <= len(d) <= 19 and pii.luhn(d))) \
                    or (k == 3 and not 10 <= len(d) <= 15):
                continue
            out.append((m.start(), k, m.end()))
    return sorted(out)


def test_pii_base(odd, empty):
    rows = pii.find(odd).collect()
    want = sorted((str(i), _base(t)) for i, t in _pairs(odd))
    assert sorted((str(r.doc_id), [tuple(x) for x in r.base]) for r in rows) == want
    assert pii.find(empty).count() == 0


def test_pii_base_on_random_text():
    rng = np.random.default_rng(8)
    for _ in range(3000):
        text = "".join(rng.choice(list("1290.@- +(x)a\n"), rng.integers(1, 60)))
        assert pii.base_spans(text) == _base(text), text


def test_pii_finds_what_has_a_known_context(spark):
    rows = [(i, f"lorem {i} please write to user{i}@mail.example.org for details ok") for i in range(12)]
    rows += [(100, "ipsum please write to hidden0815at for details ok"), (101, "nothing of this kind 0815123 here")]
    got = {r.doc_id: r.added for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [(x.kind, rows[12][1][x.start:x.end]) for x in got[100]] == [(0, "hidden0815at")]
    assert got[101] == [] and all(got[i] == [] for i in range(12))


def test_pii_second_hop_and_spaced_digits(spark):
    rows = [(i, f"lorem ipsum please write to user{i}@mail.example.org for details ok") for i in range(60)]
    # known context and a context without any seed share these
    rows += [(100 + i, f"dolor sit please write to ref{i}0815x for details ok") for i in range(40)]
    rows += [(200 + i, f"amet the quiet member ref{i}0815x lives here now") for i in range(40)]
    rows += [(300, "amet the quiet member unseen4711y lives here now"), (301, "lorem ipsum please write to 020 7946 0958 for details ok"),
             (302, "nothing of this kind 0815123 here"), (303, "tel (030) 1234 567, then a@b.de 12 3456 x 1.2.3.4 77 8899")]
    text = dict(rows)
    got = {r.doc_id: [(x.kind, text[r.doc_id][x.start:x.end]) for x in r.added]
           for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string"), rounds=3).collect()}
    assert got[300] == [(0, "unseen4711y")] and got[301] == [(0, "020 7946 0958")] and got[302] == []
    assert all(got[100 + i] == got[200 + i] == [(0, f"ref{i}0815x")] for i in range(40))
    marks = pii.marks(text[303], pii.base_spans(text[303]))
    assert [m[3] for m in marks if m[2] is None] == ["030) 1234 567", "12 3456", "8899"]


# 4 ------------------------------------------------------------------------------------------

def _sets(text):
    w = WORD.findall((text or "").translate({i: i + 32 for i in range(65, 91)}))
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i:i + 5]) for i in range(len(w) - 4)}


def _components(pairs):
    sets = [(i, _sets(t)) for i, t in pairs]
    name = list(range(len(sets)))
    changed = True
    while changed:
        changed = False
        for a in range(len(sets)):
            for b in range(a):
                x, y = sets[a][1], sets[b][1]
                if x and y and name[a] != name[b] and 100 * len(x & y) >= 75 * len(x | y):
                    name[a] = name[b] = min(name[a], name[b])
                    changed = True
    out = []
    for k, (i, s) in enumerate(sets):
        ids = [sets[j][0] for j in range(len(sets)) if name[j] == name[k] and sets[j][0] is not None]
        out.append((i, len(s), min(ids) if s and ids else i))
    return sorted(out, key=str)


def test_ngram_join(odd, empty):
    got = sorted((tuple(r) for r in ngram_join.near_duplicates(odd).collect()), key=str)
    assert got == _components(_pairs(odd))
    kept = ngram_join.without_near_duplicates(odd)
    assert kept.columns == odd.columns and kept.count() == len({(c if n else ("none", k)) for k, (_, n, c) in enumerate(got)})
    assert ngram_join.near_duplicates(empty).count() == 0


def test_ngram_join_chunks_lose_no_link(spark):
    rng = np.random.default_rng(1)
    base = [f"w{i}" for i in range(100)]
    rows = []
    for i in range(60):  # copies at every distance from the base, many of them not linked with each other
        w = list(base)
        for k in rng.choice(100, rng.integers(0, 7), replace=False):
            w[k] = f"x{i}-{k}" if rng.random() < 0.5 else f"y{k}"
        rows.append((i, " ".join(w)))
    want = _components(rows)
    assert len({c for *_, c in want}) > 1
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for tokens in (300, 1500, 10**6):
        got = sorted((tuple(r) for r in ngram_join.near_duplicates(docs, chunk_tokens=tokens).collect()), key=str)
        assert got == want


def test_trie_equals_brute_force():
    rng = np.random.default_rng(2)
    for _ in range(40):
        sets = [np.sort(rng.choice(40, rng.integers(1, 30), replace=False)) for _ in range(12)]
        n = np.array([len(s) + rng.integers(0, 3) for s in sets])
        trie, marks = ngram_join.Trie(sets, n), np.zeros(40, np.int32)
        for i, s in enumerate(sets):
            want = {j for j, t in enumerate(sets) if 7 * len(np.intersect1d(s, t)) >= 3 * (n[i] + n[j])}
            assert set(trie.partners(s, int(n[i]), marks).tolist()) == want


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 102), (102, 101), (7, 7)]
    got = {r.id: r.label for r in ngram_join.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(31)}, 100: 100, 101: 100, 102: 100}


# 5 ------------------------------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><nav><a href=/>Home</a></nav>
<div class="ad-box">buy</div><article><h1>Head &amp; line</h1><p>One <b>bold</b>
 two<br>three<p>Second &copy; block<ul><li>x<li>y</ul><script>var t="</p>";</script><form>f</form>
<section id="comments"><p>reader</p></section></article><footer>foot</footer></body></html>"""


def test_html_text(spark):
    assert html_text.main_text(PAGE) == "Head & line\nOne bold two three\nSecond © block\nx\ny"
    plain = "<body><div id=menu><a href=x>a</a></div><div><p>" + "long text here " * 20 + "</p><p>" + "more of it " * 20 + "</p></div></body>"
    assert html_text.main_text(plain) == ("long text here " * 20).strip() + "\n" + ("more of it " * 20).strip()
    assert [html_text.main_text(x) for x in (None, "", "<p>", "just text", "<!-- open", "<a <b>")][:5] == ["", "", "", "just text", ""]
    rows = [(1, "u", PAGE, "c"), (1, "u", PAGE, "c"), (None, None, None, None), (2, "v", "<p>" + "word " * 100_000, "c")]
    out = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert sorted(len(r.text) for r in out) == [0, 49, 49, 499_999]
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


PROSE = "".join("<p>" + f"some sentence number {i} of the real article, " * 4 + "</p>" for i in range(8))


@pytest.mark.parametrize("name", ["content has-sidebar", "no-comments", "social-studies", "search-result", "menu-recipe"])
def test_html_text_keeps_the_article_within_a_marked_wrapper(name):
    want = html_text.main_text(f"<body><div>{PROSE}</div></body>")
    assert want.count("\n") == 7
    ad = '<div class="ad">buy this now</div>'
    for tag in ("div", "article", "main"):
        assert html_text.main_text(f'<body>{ad}<div class="{name}"><{tag}>{PROSE}</{tag}></div></body>') == want
    assert html_text.main_text(f'<body>{ad}<div class="{name}">{PROSE}</div></body>') == want
    assert html_text.main_text(f'<body>{ad}<main><div id="{name}"><article>{PROSE}</article></div></main></body>') == want
    comments = "<div class=comments>" + "<div><b>Jo</b> <a href=x>reply</a> I think so</div>" * 30 + "</div>"
    assert html_text.main_text(f"<body><article>{PROSE}{comments}</article></body>") == want
    assert html_text.main_text(f"<body><div>{PROSE}</div>{comments}</body>") == want


def test_html_text_selects_by_density_not_by_tag():
    part = lambda n: "".join(f"<p>{'a longer sentence of part ' + str(n) + ' ' + str(i):s} {'goes on and on ' * 9}</p>" for i in range(6))
    words = lambda x: [" ".join(p.split()) for p in re.findall("<p>(.*?)</p>", x)]
    siblings = "".join(f"<article>{part(n)}</article>" for n in range(3))
    assert html_text.main_text(f"<body>{siblings}</body>").split("\n") == [w for n in range(3) for w in words(part(n))]
    teasers = "<ul>" + "".join(f"<li><a href=/{i}>Other story {i}</a>" for i in range(40)) + "</ul><div class=x><a href=/t>Read</a> this <a href=/u>teaser</a></div>"
    assert html_text.main_text(f"<body><main>{teasers}<div>{part(0)}</div>{teasers}</main></body>").split("\n") == words(part(0))
    bold = f"<h1>A title</h1>{part(0)}<p><b>{'all of it bold ' * 60}</b></p>"
    assert html_text.main_text(f"<body><article>{bold}</article></body>").startswith("A title\na longer sentence")


# 6 ------------------------------------------------------------------------------------------

def test_decontamination(spark, odd, empty):
    words = (_texts()[13]).split(" ")
    items = [(1, " ".join(words[500:530])), (2, " ".join(words[900:950])), (3, " ".join(f"q{i}" for i in range(40))), (4, None), (5, ""), (6, " ".join(words[500:530]))]
    bench = spark.createDataFrame([(*x, "clash") for x in items], "item_id long, text string, score string")
    assert sorted((r.doc_id, r.item_id) for r in decontam.matches(odd, bench).collect()) == [(13, 1), (13, 2), (13, 6)]
    kept = decontam.clean(odd, bench)
    assert kept.columns == odd.columns and kept.count() == odd.count() - 1
    assert decontam.matches(empty, bench).count() == 0
    assert decontam.matches(odd, bench.where("false")).count() == 0 and decontam.clean(odd, bench.where("false")).count() == odd.count()


def test_pruning_loses_no_passage():
    rng = np.random.default_rng(4)
    vocab = [f"v{int(x)}" for x in rng.zipf(1.3, 4000) % 700]
    items = [(i, " ".join(rng.choice(vocab, rng.integers(5, 60)))) for i in range(120)]
    index = decontam.Index(items, decontam.counts_of([t for _, t in items]))
    docs = [" ".join([*rng.choice(vocab, 200), *items[i][1].split()[: (i % 7) * 10 + 3], *rng.choice(vocab, 100)]) for i in range(60)]
    import pyarrow as pa
    words, off = decontam.hash_words(pa.array(docs))
    got = {(r, i) for r, i, *_ in index.search(words, off)}
    want, step = set(), index.longest
    for r in range(len(docs)):
        w = words[off[r]:off[r + 1]]
        for a in range(0, len(w), step):
            passage = w[a:a + 2 * step]
            grams = decontam._grams(passage)
            for i, (terms, weight) in enumerate(index.full):
                if weight[np.isin(index.terms[terms], passage)].sum() >= 1:
                    q, b = (np.isin(x, grams).mean() if len(x) else 1 for x in (index.question[i], index.answer[i]))
                    if min(q, b) >= decontam.PART:
                        want.add((r, index.ids[i]))
    assert got == want and len(want) > 20


def _bm25(docs, items, step):
    """Every passage against every item, BM25 over the whole benchmark, by plain counting."""
    texts = {}
    for i, t in items:
        texts.setdefault(" ".join(WORD.findall(t.lower())), (t, []))[1].append(i)
    bags = [(WORD.findall(t.lower()), ids) for t, ids in texts.values()]
    mean, df = np.mean([len(w) for w, _ in bags]), Counter(x for w, _ in bags for x in set(w))
    idf = {x: np.log1p((len(bags) - n + 0.5) / (n + 0.5)) for x, n in df.items()}
    grams = lambda w: {tuple(w[i:i + min(3, len(w))]) for i in range(len(w) - min(3, len(w)) + 1)} if w else set()
    found = set()
    for key, text in docs:
        words = WORD.findall((text or "").lower())
        for a in range(0, len(words), step):
            passage = words[a:a + 2 * step]
            held, g = set(passage), grams(passage)
            for w, ids in bags:
                weight = {x: idf[x] * c * 2.2 / (c + 1.2 * (0.25 + 0.75 * len(w) / mean)) for x, c in Counter(w).items()}
                cut = -(-2 * len(w) // 3)
                if sum(v for x, v in weight.items() if x in held) >= 0.6 * sum(weight.values()) - 1e-9 and all(
                        len(part & g) >= 0.5 * len(part) for part in (grams(w[:cut]), grams(w[cut:]))):
                    found |= {(key, i) for i in ids}
    return found


@pytest.mark.parametrize("limits", [{}, {"most_items": 3}, {"most_bytes": 600}])
def test_decontamination_is_bm25_over_the_whole_benchmark(spark, limits):
    rng = np.random.default_rng(14)
    vocab = [f"v{int(x)}" for x in rng.zipf(1.3, 3000) % 300]
    items = [(i, " ".join(rng.choice(vocab, rng.integers(4, 30)))) for i in range(30)]
    items += [(100, items[3][1]), (101, items[3][1])]
    docs = []
    for d in range(60):
        part = items[d % 30][1].split(" ")
        docs.append((d, " ".join([*rng.choice(vocab, 60), *part[: len(part) - d % 4 * 3], *rng.choice(vocab, 30)])))
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.matches(df, bench, **limits).collect()}
    assert got == _bm25(docs, items, max(len(t.split()) for _, t in items)) and len(got) > 8


# 7 ------------------------------------------------------------------------------------------

def test_language_id(spark, odd, empty, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    truth = {r.doc_id: r.lang for r in docs.collect()}
    rows = [r for r in langid.identify(docs).collect() if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert sum(truth[r.doc_id] == r.lang_pred for r in rows) >= 0.95 * len(rows)
    got = langid.identify(odd).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 for r in got)
    letters = {str(i): any(c.isalpha() for c in t or "") for i, t in _pairs(odd)}
    assert all((r.lang_pred == "und") == (not letters[str(r.doc_id)]) for r in got)
    assert langid.identified(odd).count() == sum(any(c.isalpha() for c in t or "") for _, t in _pairs(odd))
    assert langid.identify(empty).count() == 0
    assert {r.lang_pred for r in langid.identify(odd.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def _buckets(text):
    """Buckets of the 1-, 2- and 3-grams at every position, in plain integers."""
    m, c = 0xFFFFFFFF, [ord(x) for x in text.lower()] + [10, 10]
    for a, b, d in zip(c, c[1:], c[2:]):
        yield (a * 2654435761 & m) >> 16
        yield (((a * 2246822519 + b & m) * 3266489917 & m) + 77 & m) >> 16
        yield (((a * 668265263 + b & m) * 374761393 & m) + d & m) * 2654435769 % 2**32 >> 16


def test_language_id_is_naive_bayes(spark):
    rng = np.random.default_rng(17)
    vocab = {x: ["".join(rng.choice(list(letters), rng.integers(2, 8))) for _ in range(30)] for x, letters in (("aa", "abcdeé"), ("bb", "defghi"), ("cc", "ñxyzab"))}
    text = lambda x, n: " ".join(rng.choice(vocab[x], n))
    rows = [(i, text(x, int(rng.integers(1, 30))), x) for i, x in enumerate(list(vocab) * 20)] + [(100, None, "aa"), (101, "", "bb"), (102, "\U0001F600 12", "cc")]
    langs, weights = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    counts = {x: Counter() for x in vocab}
    for _, t, x in rows:
        counts[x].update(_buckets(t or ""))
    total = {x: sum(c.values()) + 0.1 * (1 << 16) for x, c in counts.items()}
    asked = [(i, t) for i, t in enumerate([text("aa", 3), text("bb", 40), "abc xyz def", "ñ", text("cc", 400), "??", None])]
    got = {r.doc_id: r for r in langid.predict(spark.createDataFrame(asked, "doc_id long, text string"), langs, weights).collect()}
    assert langs == sorted(vocab)
    for i, t in asked:
        sums = {x: sum(np.log((counts[x][b] + 0.1) / total[x]) for b in _buckets(t or "")) for x in langs}
        best = max(langs, key=lambda x: sums[x])
        if not any(c.isalpha() for c in t or ""):
            assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
        else:
            assert got[i].lang_pred == best and abs(got[i].score - 1 / sum(np.exp(v - sums[best]) for v in sums.values())) < 1e-3


# 8 ------------------------------------------------------------------------------------------

def test_warc_round_trip(spark, tmp_path):
    rows = [(1, "http://a", "x"), (2, "http://b", "y" * 300_000), (3, None, "x"), (3, None, "x"), (4, "a\nb", None), (5, "e", ""), (None, "n", "x"), (9, "é", "ß")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    folder = f"file://{tmp_path}/warc"
    manifest = warc.write(pages, folder, roll_bytes=1).collect()
    assert sum(m.records for m in manifest) == len(rows) and len(manifest) == len(rows)
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read(spark, folder).collect()), key=str)
    b32 = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    first, want = {}, []
    for i, _, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        seen = (t or "") in first
        first.setdefault(t or "", i)
        want.append((i, len((t or "").encode()), b32(t), "revisit" if seen else "response", first[t or ""] if seen else None))
    assert got == sorted(want, key=str)
    again = warc.write(pages.repartition(5), f"file://{tmp_path}/again", roll_bytes=1).collect()
    assert {(m.name, m.sha1) for m in manifest} == {(m.name, m.sha1) for m in again}
    warc.write(pages.where("false"), f"file://{tmp_path}/none")
    assert warc.read(spark, f"file://{tmp_path}/none").count() == 0
    warc.write(pages, f"file://{tmp_path}/large", min_bytes=10)
    assert {r.record_type for r in warc.read(spark, f"file://{tmp_path}/large").collect()} == {"response"}


def test_warc_with_other_columns_and_integer_ids(spark, tmp_path):
    rows = [(1, "u1", "<p>a", "x"), (2, "u2", "<p>a", "y"), (3, None, None, None), (None, "u4", "<p>a", "z"), (3, "u5", "", "z")]
    extra = ["digest", "kind", "first", "span", "shard", "n", "c"]
    pages = spark.createDataFrame([(*r[:3], *[r[3]] * 7) for r in rows], "page_id int, url string, html string, " + ", ".join(f"{c} string" for c in extra))
    warc.write(pages, f"file://{tmp_path}/odd")
    got = sorted(((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.read(spark, f"file://{tmp_path}/odd").collect()), key=repr)
    assert got == sorted([(1, 4, "response", None), (2, 4, "revisit", 1), (None, 4, "revisit", 1), (3, 0, "response", None), (3, 0, "revisit", 3)], key=repr)


# 9 ------------------------------------------------------------------------------------------

def _dropped(pairs):
    occ = sorted(((d, k, WORD.findall(x)) for d, t in dict(pairs).items() if t and d is not None for k, x in enumerate(t.split("\n")) if WORD.search(x)), key=lambda x: x[:2])
    out = []
    for i, (d, k, w) in enumerate(occ):
        for e, m, v in occ[:i]:
            if v == w or min(len(v), len(w)) >= line_dedup.MIN_WORDS and _near(w, v):
                equal = next(((a, b) for a, b, u in occ[:i] if u == w), None)
                out.append((d, k, e, m))
                assert v == w or equal is None or (e, m) <= equal
                break
    return out


def test_line_dedup(odd, empty):
    plain = odd.where("doc_id is not null").dropDuplicates(["doc_id"])
    got = sorted((r.doc_id, r.line_no, r.first_doc_id, r.first_line_no) for r in line_dedup.duplicate_lines(plain).collect())
    want = _dropped(_pairs(plain))
    assert {x[:2] for x in got} >= {x[:2] for x in want} and len(got) == len(want)
    assert [x for x in got if x[0] in (16, 17, 18)] == [x for x in want if x[0] in (16, 17, 18)]
    whole = line_dedup.duplicate_lines(odd).collect()
    assert any(r.doc_id is None and r.first_doc_id == 6 for r in whole)
    assert line_dedup.duplicate_lines(empty).count() == 0


def _near(x, y):
    """One word replaced, inserted or left out."""
    if len(x) > len(y):
        x, y = y, x
    if x == y or len(y) - len(x) > 1:
        return False
    i = next((k for k, (a, b) in enumerate(zip(x, y)) if a != b), len(x))
    return list(x[i + 1:]) == list(y[i + 1:]) if len(x) == len(y) else list(x[i:]) == list(y[i + 1:])


def _plain(rows):
    """(doc_id, line_no, first_doc_id, first_line_no, distance) by the rule read literally; rows are (doc_id, text)."""
    occ = sorted(((d, k, WORD.findall(x)) for d, t in rows for k, x in enumerate(t.split("\n")) if WORD.search(x)), key=lambda x: x[:2])
    first = {}
    for d, k, w in occ:
        first.setdefault(tuple(w), (d, k))
    out = []
    for d, k, w in occ:
        near = [at for v, at in first.items() if at < first[tuple(w)] and min(len(v), len(w)) >= line_dedup.MIN_WORDS
                and _near(list(v), w)]
        if near:
            out.append((d, k, *min(near), 1))
        elif (d, k) != first[tuple(w)]:
            out.append((d, k, *first[tuple(w)], 0))
    return out


def test_line_dedup_within_runs_of_equal_words(spark):
    rng = np.random.default_rng(21)
    pairs = [("the old old man of the sea said so", "the old new man of the sea said so"), ("0 0 0 0 0 0 0 0 0", "0 0 0 0 7 0 0 0 0")]
    texts = ["\n".join(x) for x in pairs]
    texts += ["\n".join(" ".join(rng.choice(list("ab"), rng.integers(7, 12))) for _ in range(3)) for _ in range(60)]
    texts += ["\n".join(" ".join(rng.choice(list("abc"), 9, p=[0.9, 0.05, 0.05])) for _ in range(3)) for _ in range(20)]
    rows = list(enumerate(texts))
    got = line_dedup.duplicate_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    want = _plain(rows)
    assert sorted(tuple(r) for r in got) == want and {(0, 1, 0, 0, 1), (1, 1, 1, 0, 1)} <= set(want)


def test_line_dedup_with_null_and_repeated_ids(spark):
    rng = np.random.default_rng(22)
    line = lambda n: " ".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), n))
    lines = [line(10) for _ in range(40)]
    other = lambda x: " ".join([*x.split(" ")[:4], "changed", *x.split(" ")[5:]])
    rows = [(None, x + "\n" + line(9)) for x in lines] + [(7, other(x)) for x in lines[:20]] + [(None, other(x) + "\nno") for x in lines[20:]]
    rows += [(5, lines[0] + "\n" + lines[1])] * 3 + [(5, line(12))]
    got = line_dedup.duplicate_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    ids = lambda x: (x is None, x or 0)
    # ids 5 and 7 come first; the two rows of a null id that are near stand at line 0, one of them stays
    want = [(5, 0, 5, 0, 0)] * 2 + [(5, 1, 5, 1, 0)] * 2 + [(7, 0, 5, 0, 1), (7, 0, 5, 1, 1)]
    want += [(None, 0, 5, 0, 0), (None, 0, 5, 1, 0)] + [(None, 0, 7, 0, 1)] * 18 + [(None, 0, None, 0, 1)] * 20 + [(None, 1, None, 1, 0)] * 19
    full = sorted(map(tuple, got), key=lambda r: (ids(r[0]), r[1], ids(r[2]), *r[3:]))
    assert full == sorted(want, key=lambda r: (ids(r[0]), r[1], ids(r[2]), *r[3:]))
    plain = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter(map(tuple, line_dedup.duplicate_lines(plain.repartition(2)).collect())) == Counter(map(tuple, got))


# 10 -----------------------------------------------------------------------------------------

def _quality(text):
    t = text or ""
    w = WORD.findall(t)
    c = Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
    covered = {j for i in range(len(w) - 4) if c[tuple(w[i:i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in t), len(lines) - len(set(lines)), len(covered)


def test_quality(odd, empty):
    rows = quality.judged(odd).collect()
    assert sorted((str(r.doc_id), (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)) for r in rows) == sorted(
        (str(i), _quality(t)) for i, t in _pairs(odd))
    for r in rows:
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert r.kept == (not r.base_failed and not r.broken)
    assert {r.doc_id: r.kept for r in rows}[6] and quality.judged(empty).count() == 0


# pipeline -----------------------------------------------------------------------------------

def test_pipeline_stages(spark, sf_dir):
    import corpus_pipeline as cp
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, pairs = docs.columns, _pairs(docs)
    kept = cp.language_id(spark, docs, sf_dir)
    assert kept.columns == columns and kept.count() == sum(any(c.isalpha() for c in t or "") for _, t in pairs)
    lone = cp.near_duplicates(spark, docs, sf_dir)
    assert {r.doc_id for r in lone.collect()} == {i for i, n, c in _components(pairs) if i == c}
    items = [" ".join(WORD.findall(r.text.lower())) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    clean = {i for i, t in pairs if not any(x in " ".join(WORD.findall((t or "").lower())) for x in items)}
    assert {r.doc_id for r in cp.decontamination(spark, docs, sf_dir).collect()} == clean
    out = cp.run(spark, sf_dir)
    assert out.columns == [*columns, "shard", "slot"]
    sizes = Counter(r.shard for r in out.collect())
    assert max(sizes.values()) - min(sizes.values()) <= 1
