import collections
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from loomwork.llm import components, decontam, line_templates, simhash_tiles

FOLD = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def slow_fingerprint(text):
    w = WORD.findall((text or "").translate(FOLD))
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_classes(rows, radius):
    """Least id reachable, by comparing all pairs."""
    fps = [slow_fingerprint(t) for _, t in rows]
    part = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for i in range(len(rows)):
            for j in range(len(rows)):
                if (fps[i] ^ fps[j]).bit_count() <= radius and part[j] < part[i]:
                    part[i], changed = part[j], True
    least = {}
    for (i, _), p in zip(rows, part, strict=True):
        if i is not None:
            least[p] = min(least.get(p, i), i)
    return [(i, f"{f:016x}", least.get(p)) for (i, _), f, p in zip(rows, fps, part, strict=True)]


def key(r):
    return tuple((v is None, v if v is not None else 0) for v in r)


def test_near_duplicates_against_all_pairs(docs, corpus):
    got = sorted(map(tuple, simhash_tiles.near_duplicates(docs).collect()), key=key)
    assert got == sorted(slow_classes(corpus, 2), key=key)


@pytest.mark.parametrize("most", [simhash_tiles.MOST, 90])
def test_links_of_clustered_fingerprints(spark, most):
    """Dense clusters, so that tiles hold long runs and chains of links."""
    r = random.Random(2)
    fps = set()
    for _ in range(6):
        base = r.getrandbits(64)
        for _ in range(400):
            x = base
            for _ in range(r.randrange(4)):
                x ^= 1 << r.randrange(12)
            fps.add(x)
    fps |= {r.getrandbits(64) for _ in range(500)}
    a = np.array(sorted(fps), dtype=np.uint64)
    label = np.arange(len(a))
    pairs = [np.flatnonzero(np.bitwise_count(a ^ x) <= 2) for x in a]
    while True:
        new = np.array([label[p].min() for p in pairs])
        if (new == label).all():
            break
        label = new
    df = spark.createDataFrame([(int(x),) for x in a.view(np.int64)], "fp long")
    roots = {r.node: r.root for r in components.with_roots(components.components(simhash_tiles.links(df, most=most))).collect()}
    got = collections.defaultdict(set)
    for x in a.view(np.int64).tolist():
        got[roots.get(x, x)].add(x)
    want = collections.defaultdict(set)
    for x, p in zip(a.view(np.int64).tolist(), label, strict=True):
        want[p].add(x)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(1, 50)] + [(7, 7), (3, 3)]
    e = spark.createDataFrame(edges, "a long, b long")
    roots = dict(map(tuple, components.with_roots(components.components(e)).collect()))
    assert roots == {i: 0 for i in range(61)} | {100 + i: 100 for i in range(50)}
    assert components.components(e.limit(0)).count() == 0


def test_empty(nothing, docs):
    assert simhash_tiles.near_duplicates(nothing).count() == 0
    assert line_templates.dedup(nothing).count() == 0
    assert decontam.find(nothing, docs, item_id="doc_id").count() == 0
    assert decontam.find(docs, nothing, item_id="doc_id").count() == 0


# --- lines ----------------------------------------------------------------------------------------


def test_recurring_lines_stay_once(docs, corpus):
    shared = "This very line stands in many documents and says nothing new at all."
    out = line_templates.dedup(docs).select("doc_id", "text", "n_lines", "n_dropped").collect()
    assert len(out) == len(corpus)
    have = [r for r in out if r.text and shared in r.text.split("\n")]
    assert {r.doc_id for r in have} == {0}
    for r in out:
        was = next(t for i, t in corpus if i == r.doc_id and (t is None) == (r.text is None) and (t is None or set((r.text or "").split("\n")) <= set(t.split("\n"))))
        if r.n_dropped == 0:
            assert r.text == was
        else:
            assert r.text.split("\n") == [x for x in was.split("\n") if x != shared]
    # copies alone do not make a line recur
    assert all(r.n_dropped == 0 for r in out if r.doc_id is not None and 200 <= r.doc_id < 205)


def test_variable_fields_are_generalised(spark):
    r = random.Random(8)
    own = lambda: " ".join("".join(r.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(12))
    rows = [(i, f"{own()} unique\nuser {r.randrange(999)} logged in at {r.randrange(24)}:00 from host{r.randrange(99)} over secure channel") for i in range(9)]
    names = ["alice", "bob", "carol", "dave"]
    rows += [(20 + i, f"{own()} alone\nplease sign the form and hand it to {n} before the end of this week") for i, n in enumerate(names)]
    rows += [(40 + i, f"{own()}\nplease sign the form only when all of these other things were done {i}") for i in range(1)]
    out = {x.doc_id: x for x in line_templates.dedup(spark.createDataFrame(rows, "doc_id long, text string"), min_docs=3).collect()}
    assert [out[i].n_dropped for i in range(9)] == [0] + [1] * 8
    assert [out[20 + i].n_dropped for i in range(4)] == [0, 1, 1, 1]
    assert out[40].n_dropped == 0


# --- benchmark items ------------------------------------------------------------------------------


def slow_find(rows, items, width=5, least=0.8):
    words = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    runs = lambda w, k: {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}
    out = []
    for i, t in rows:
        for j, s in items:
            w = words(s)
            if w:
                k = min(width, len(w))
                q, have = runs(w, k), runs(words(t), k)
                n = len(q & have)
                if n >= least * len(q):
                    out.append((i, j, len(q), n))
    return out


def test_items_against_brute_force(spark, docs, corpus):
    r = random.Random(9)
    text = dict(corpus)
    long = text[300].split()
    items = [(k, " ".join(long[a : a + n])) for k, (a, n) in enumerate([(100, 9), (2000, 30), (5, 60), (1500, 200), (2990, 10)])]
    broken = long[700:740]
    broken[20] = "changed"
    worse = long[900:940]
    for p in range(0, 40, 6):
        worse[p] = "changed"
    items += [(10, " ".join(broken).upper() + "!"), (11, " ".join(worse)), (12, "one two"), (13, "one"), (14, ""), (15, None), (None, "one two"), (16, text[3]), (17, text[3]), (18, " ".join(r.choice(long) for _ in range(20)))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontam.find(docs, bench).collect()
    assert sorted(map(key, [(x.doc_id, x.item_id, x.n_shingles, x.n_found) for x in got])) == sorted(map(key, slow_find(corpus, items)))
    assert all(x.containment == x.n_found / x.n_shingles for x in got)
    few = decontam.find(docs, bench, group=8).select("doc_id", "item_id").collect()
    assert sorted(map(key, few)) == sorted(key((x.doc_id, x.item_id)) for x in got)
    assert docs.filter(F.col("doc_id") == 300).count() == 1


def test_no_item_passes_through_the_driver(spark, docs, corpus, monkeypatch):
    """Indexes are made and kept in the cluster: the driver makes none, and gets a number a group."""
    items = [(k, " ".join(dict(corpus)[300].split()[9 * k : 9 * k + 30])) for k in range(40)]
    bench = spark.createDataFrame(items, "item_id long, text string").repartition(3)

    def never(*a, **k):
        raise AssertionError("the driver makes an index or broadcasts it")

    monkeypatch.setattr(type(spark.sparkContext), "broadcast", never)
    monkeypatch.setattr(type(bench), "orderBy", never)
    got = decontam.find(docs, bench, group=16).collect()
    assert sorted(map(key, [(x.doc_id, x.item_id, x.n_shingles, x.n_found) for x in got])) == sorted(map(key, slow_find(corpus, items)))
