"""Scores against the full product, partners against the sequential choice, merges."""

import datetime as dt
import random
from difflib import SequenceMatcher

import pytest
from gavelframe.functions.similarity import similar_values
from gavelframe.operators import enrich as EN
from gavelframe.operators import linkage as L
from gavelframe.operators import match_fields as MF

FEED = ("seq long, source string, url string, sale_date date, court string, start_price double, city string, "
        "property_type string, surface_m2 double, postal_code string")
WEIGHTS = {"date": 30, "court": 15, "price": 20, "city": 15, "type": 10, "surface": 10}


def norm(s):
    table = str.maketrans("éèêëàâäùûüôöîïç-'", "eeeeaaauuuooiic  ")
    return " ".join(s.lower().split()).translate(table)


def ratio(a, b):
    return SequenceMatcher(None, norm(a), norm(b)).ratio()


def close(a, b, t):
    return abs(a - b) / ((a + b) / 2) < t


def score(a, b):
    """(matched, weight) of two rows, field by field."""
    tests = {
        "date": (a[3], b[3], lambda x, y: x == y), "court": (a[4], b[4], lambda x, y: ratio(x, y) > 0.7),
        "price": (a[5], b[5], lambda x, y: close(x, y, 0.1)), "city": (a[6], b[6], lambda x, y: ratio(x, y) > 0.8),
        "type": (a[7], b[7], lambda x, y: x == y), "surface": (a[8], b[8], lambda x, y: close(x, y, 0.05)),
    }
    m = w = 0
    for f, (x, y, same) in tests.items():
        if x and y:
            w += WEIGHTS[f]
            m += WEIGHTS[f] if same(x, y) else 0
    return m, w


def feed(r, n, source, copies=0.3):
    """Random rows; about ``copies`` of them are one and the same listing."""
    out = []
    for i in range(n):
        if r.random() < copies:
            out.append((i, source, f"{source}{i}", dt.date(2024, 1, 1), "TJ Paris", 100000.0, "Paris", "maison", 50.0, "75011"))
            continue
        pick = lambda *xs: r.choice(xs)
        out.append((i, source, f"{source}{i}", pick(None, dt.date(2024, 1, 1), dt.date(2024, 1, 2)),
                    pick(None, "", "TJ Paris", "Tribunal de Nanterre", "tribunal  Nanterre"),
                    pick(None, 0.0, 100000.0, 104000.0, 115000.0, 90000.0),
                    pick(None, "Paris", "Saint-Denis", "saint denis", "Montreuil"), pick("maison", "parking", None),
                    pick(None, 0.0, 50.0, 51.0, 53.0), None))
    return out


def greedy(one, two):
    free, out = list(range(len(two))), {}
    for a in one:
        best, best_score = None, 0.0
        for j in free:
            m, w = score(a, two[j])
            if w and m / w > best_score and 2 * m >= w:
                best, best_score = j, m / w
        if best is not None:
            free.remove(best)
            out[a[0]] = two[best][0]
    return out


def test_minimal_sets_are_sufficient_and_minimal():
    for present in range(1, 64):
        sets = L.minimal_sets(present)
        for matched in range(64):
            if matched & ~present:
                continue
            passes = matched and 2 * MF.weight(matched) >= MF.weight(present)
            assert bool(passes) == any(s & matched == s for s in sets)


@pytest.mark.parametrize("seed", [1, 2])
def test_scores_equal_full_product(spark, seed):
    r = random.Random(seed)
    one, two = feed(r, 25, "a"), feed(r, 30, "b")
    want = {(a[0], b[0]): score(a, b) for a in one for b in two}
    want = {k: v for k, v in want.items() if v[0] and 2 * v[0] >= v[1]}
    got = {(x.seq_1, x.seq_2): (x.matched, x.weight)
           for x in L.match_scores(spark.createDataFrame(one, FEED), spark.createDataFrame(two, FEED)).collect()}
    assert got == want


@pytest.mark.parametrize("seed,n,m,copies,slice_rows", [(1, 12, 12, 0.3, 10**6), (2, 20, 9, 0.7, 3), (3, 15, 25, 0.0, 3)])
def test_partners_equal_sequential_choice(spark, seed, n, m, copies, slice_rows):
    r = random.Random(seed)
    one, two = feed(r, n, "a", copies), feed(r, m, "b", copies)
    found = L.one_to_one(spark.createDataFrame(one, FEED), spark.createDataFrame(two, FEED), slice_rows=slice_rows).collect()
    assert {x.seq_1: x.seq_2 for x in found} == greedy(one, two)
    for x in found:
        m, w = score(one[x.seq_1], two[x.seq_2])
        assert abs(x.score - m / w) < 1e-12


@pytest.mark.parametrize("seed,n,m,copies,ahead,task_rows", [(4, 22, 18, 0.6, 2, 12)])
def test_partners_from_short_lists_in_many_tasks(spark, seed, n, m, copies, ahead, task_rows):
    """Lists that are used up are followed by the next ones, and tasks that choose the same candidates choose anew."""
    r = random.Random(seed)
    one, two = feed(r, n, "a", copies), feed(r, m, "b", copies)
    found = L.one_to_one(spark.createDataFrame(one, FEED), spark.createDataFrame(two, FEED), ahead=ahead, task_rows=task_rows).collect()
    assert {x.seq_1: x.seq_2 for x in found} == greedy(one, two)


def test_partners_without_a_list_of_all_pairs(spark, monkeypatch):
    """Every row is near every other one; what is stored grows with the rows, not with their pairs."""
    n, sizes, stored = 80, [], L.stored

    def counted(df):
        sizes.append((out := stored(df)).count())
        return out
    monkeypatch.setattr(L, "stored", counted)
    row = lambda i, s: (i, s, f"{s}{i}", dt.date(2024, 1, 1), None, 100000.0 + i, None, "maison", None, None)
    one, two = [row(i, "a") for i in range(n)], [row(i, "b") for i in range(n)]
    found = L.one_to_one(spark.createDataFrame(one, FEED), spark.createDataFrame(two, FEED)).collect()
    assert {x.seq_1: x.seq_2 for x in found} == {i: i for i in range(n)}
    assert max(sizes) < n * n * 3 // 4


def test_partners_of_rows_without_number_or_that_come_twice(spark):
    row = lambda i, s, c: (i, s, "u", dt.date(2024, 1, 1), None, None, c, "maison", None, None)
    one = [row(1, "a", "Paris"), row(1, "a", "Paris"), row(None, "a", "Paris"), row(2, "a", "Paris")]
    two = [row(5, "b", "Paris"), row(5, "b", "Paris"), row(None, "b", "Paris"), row(6, "b", "Paris"), row(7, "b", "Montreuil")]
    found = L.one_to_one(spark.createDataFrame(one, FEED), spark.createDataFrame(two, FEED)).collect()
    assert sorted((x.seq_1, x.seq_2) for x in found) == [(1, 5), (1, 6), (2, 7)]


def test_many_names_near_one_name(spark):
    """Similar names are a table of edges: hundreds of names near one name are joined, not gathered."""
    names = [f"Saint-Denis-sur-Seine {a}{b}" for a in "abcdefghij" for b in "klmnopqrst"]
    row = lambda i, c: (i, "a", f"u{i}", dt.date(2024, 1, 1), None, None, c, "maison", None, None)
    one = [row(i, c) for i, c in enumerate(names)]
    two = [row(0, "Saint-Denis-sur-Seine"), row(1, "Marseille")]
    scores = L.match_classes(spark.createDataFrame(one, FEED), spark.createDataFrame(two, FEED))
    got = {(x.seq_1, x.seq_2): x.matched for x in scores.unfold().collect()}
    assert got == {(i, j): 40 + (15 if j == 0 else 0) for i in range(len(names)) for j in (0, 1)}


def test_scores_grow_with_classes_not_with_copies(spark):
    r = random.Random(11)
    one, two = feed(r, 8, "a", 0.0), feed(r, 9, "b", 0.0)
    again = lambda rows, n: [(i * len(rows) + k, *x[1:]) for i in range(n) for k, x in enumerate(rows)]
    sizes = []
    for n in (1, 6):
        s = L.match_classes(spark.createDataFrame(again(one, n), FEED), spark.createDataFrame(again(two, n), FEED))
        sizes.append((s.pairs.count(), s.unfold().count()))
    assert sizes[0][0] == sizes[1][0] and sizes[1][1] == 36 * sizes[0][1]


def test_similar_values_equals_brute_force(spark):
    r = random.Random(5)
    words = ["saint", "denis", "ouen", "mont", "reuil", "la", "garde", "sur", "seine", "ivry", "x"]
    def names(n): return sorted({"-".join(r.choice(words) for _ in range(r.randint(1, 3))) for _ in range(n)})
    a, b = names(60), names(60)
    for t in (0.7, 0.8):
        want = {(x, y) for x in a for y in b if ratio(x, y) > t}
        got = {tuple(x) for x in similar_values(spark.createDataFrame([(x,) for x in a], "c string"),
                                                spark.createDataFrame([(x,) for x in b], "c string"), {"c": t}).drop("field").collect()}
        assert got == want


def test_merge_rules(spark):
    schema = ("seq long, source string, url string, address string, postal_code string, city string, surface_m2 double, "
              "rooms int, photos array<string>, sale_date date")
    one = spark.createDataFrame([(1, "a", "ua", "12 rue X", "9211", "Vanves", None, 0, ["p", "q"], None)], schema)
    two = spark.createDataFrame([(9, "b", "ub", "12 rue XY", "92170", "Lieu-dit inconnu", 40.0, 3, ["q", "r"], dt.date(2024, 1, 1))], schema)
    pair = spark.createDataFrame([(1, 9)], "seq_1 long, seq_2 long")
    m = L.merge_pairs(pair, one, two).first()
    assert (m.address, m.postal_code, m.city, m.surface_m2, m.rooms) == ("12 rue XY", "92170", "Vanves", 40.0, 3)
    assert m.photos == ["p", "q", "r"] and m.sale_date == dt.date(2024, 1, 1)
    assert m.field_sources["city"] == "a" and m.field_sources["photos"] == "a+b" and m.source == "a+b"
    assert m.department == "92" and any("postal_code: picked '92170' from b" in n for n in m.notes)


def test_locations_filled_and_corrected(spark):
    rows = [(1, "92170", None), (2, "", "Saint Ouen"), (3, "93100", "Marseille"), (4, "93100", "montreuil"), (5, None, "Marseille 4ème"), (6, "01000", "Bourg")]
    got = {r.seq: r for r in EN.enrich_locations(spark.createDataFrame(rows, "seq long, postal_code string, city string")).collect()}
    assert got[1].city == "Vanves" and got[2].postal_code == "93400" and got[3].city == "Montreuil"
    assert got[4].city == "montreuil" and got[5].postal_code == "13004"
    assert got[6].city == "Bourg" and got[6].department == "01"


def test_cross_validation_keeps_every_row(spark):
    r = random.Random(7)
    one, two = feed(r, 10, "a"), feed(r, 14, "b")
    v = L.cross_validate(spark.createDataFrame(one, FEED), spark.createDataFrame(two, FEED))
    by = {x.origin: x["count"] for x in v.groupBy("origin").count().collect()}
    pairs = len(greedy(one, two))
    assert by.get("merged", 0) == pairs and by.get("first", 0) == 10 - pairs and by.get("second", 0) == 14 - pairs
    c = L.match_counters(v).first()
    assert (c.total_processed, c.matches_found) == (24, pairs)


def test_scores_shuffle_rows_not_pairs(spark):
    """Above the join that forms the pairs there is no exchange, whatever their number."""
    r = random.Random(3)
    df = L.match_scores(spark.createDataFrame(feed(r, 8, "a"), FEED), spark.createDataFrame(feed(r, 8, "b"), FEED))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and "Distinct" not in plan
