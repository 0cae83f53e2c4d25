import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomwork.llm import token_alignment as ta


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(ta.default_tokenizer())
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=ta.default_pieces())


def groups_of(libraries, text):
    """The groups of a text, token by token; None where it has none."""
    a, b = libraries
    if not text:
        return None
    al, ids_a, ids_b = ta.Aligner.of(ta.default_tokenizer(), ta.default_pieces()), a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    bytes_a, bytes_b, want = [al.bytes_a[i] for i in ids_a], [al.bytes_b[i] for i in ids_b], (" " + text).encode()
    if b"".join(bytes_a) != want or b"".join(bytes_b) != want:
        return None
    out, x, y, at_a, at_b, now = [], 0, 0, 0, 0, ([], [])
    while x < len(ids_a) or y < len(ids_b):
        if at_a <= at_b:
            now[0].append(ids_a[x])
            at_a, x = at_a + len(bytes_a[x]), x + 1
        else:
            now[1].append(ids_b[y])
            at_b, y = at_b + len(bytes_b[y]), y + 1
        if at_a == at_b:
            out.append(now)
            now = ([], [])
    return out


def brute(libraries, rows):
    links, figures, counts = [], [], Counter()
    for i, text in rows:
        groups = groups_of(libraries, text)
        pairs = [(a, b) for x, y in groups or [] for a in x for b in y]
        links.append(pairs)
        counts.update(set(pairs))
        said = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups or [])
        figures.append((i, sum(len(x) for x, _ in groups or []), sum(len(y) for _, y in groups or []), len(groups or []), len(pairs), said))
    best = {}
    for (a, _), n in counts.items():
        best[a] = max(best.get(a, 0), n)
    full = [(*f[:5], sum(counts[p] == best[p[0]] for p in pairs), sum(counts[p] for p in pairs), f[5]) for f, pairs in zip(figures, links, strict=True)]
    return full, {(a, b, n, n == best[a]) for (a, b), n in counts.items()}


HARD = ["<|endoftext|> <s></s><unk> <0x41>", "a▁b", "▁", " ", "  two  blanks  ", "\n\n a\r\n b", "tab\tand other　spaces  x", "日本語の テキスト、です", "🙂🙂 🤦🏽‍♂️", "é ﬁ Å", "\x00 \x01", "x" * 5000, " " * 700, "don't  we'll", "½ ² x²."]


def test_against_tokens_walked_one_by_one(spark, docs, corpus, libraries):
    rows = [*corpus, *((900 + k, t) for k, t in enumerate(HARD)), (900, HARD[0]), (950, None)]
    table = docs.select("doc_id", "text").unionByName(spark.createDataFrame(rows[len(corpus) :], "doc_id long, text string")).repartition(3)
    got = sorted(map(tuple, ta.align(table, bucket_bytes=20_000).collect()), key=str)
    want, pairs = brute(libraries, rows)
    assert got == sorted(want, key=str)
    assert {tuple(r) for r in ta.pair_counts(table).collect()} == pairs


def test_digest(docs, libraries, corpus):
    rows = {r.doc_id: r for r in ta.digest(ta.align(docs)).collect()}
    want, _ = brute(libraries, corpus)
    for i, *_, said in (w for w in want if w[0] is not None):
        assert rows[i].groups_sha256 == (hashlib.sha256(said.encode()).hexdigest() if said else "")


def test_empty_tables(nothing):
    assert ta.align(nothing).count() == 0
    assert ta.pair_counts(nothing).count() == 0


def test_equal_rows_part(spark):
    """Rows that are equal in id and text, as a third of a table may be, go to several buckets."""
    df = spark.createDataFrame([(None, "one text in every row")] * 400, "doc_id long, text string").repartition(40)
    docs, _ = ta._dealt(df, 1, "doc_id", "text")
    assert docs.groupBy("bucket").count().count() > 10
    (row,) = {tuple(r) for r in ta.align(df).collect()}
    assert row[6] == 400 * row[4] and row[5] == row[4]


def test_intervals_and_products():
    r = random.Random(3)
    for _ in range(300):
        n = r.randrange(1, 30)
        a, b = (np.array(sorted({*r.sample(range(1, n + 1), r.randrange(0, n)), n})) for _ in range(2))
        cuts, in_a, in_b, shared = ta.intervals(a, b)
        assert cuts.tolist() == sorted({*a.tolist(), *b.tolist()})
        for c, x, y, s in zip(cuts.tolist(), in_a.tolist(), in_b.tolist(), shared.tolist(), strict=True):
            assert a[x] >= c and (x == 0 or a[x - 1] < c) and b[y] >= c and (y == 0 or b[y - 1] < c) and s == (c in a and c in b)
    group, x, y = ta.products(np.array([2, 1, 0]), np.array([1, 3, 2]))
    assert list(zip(group.tolist(), x.tolist(), y.tolist(), strict=True)) == [(0, 0, 0), (0, 1, 0), (1, 2, 1), (1, 2, 2), (1, 2, 3)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=" \t\n 　 ab'st.▁<>é日🙂17\x1c\x85", max_size=25), min_size=1, max_size=4))
def test_chunks_join_to_the_librarys_groups(libraries, texts):
    al = ta.Aligner.of(ta.default_tokenizer(), ta.default_pieces())
    entries, z = al.chunks([t.encode() for t in texts])
    held = ta._held(al, entries, z.tolist())
    for k, t in enumerate(texts):
        groups = groups_of(libraries, t)
        if t:
            assert held[k] == (groups is not None)
        if groups is not None:
            said = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
            assert ";".join(al.words[e] for e in entries[z[k] : z[k + 1]].tolist()) == said


def test_large_groups_and_forgetting(monkeypatch, libraries):
    """Groups written out by distinct pairs, and a worker that forgets, give the same."""
    al = ta.Aligner(ta.default_tokenizer(), ta.default_pieces())
    monkeypatch.setattr(al, "large", 2)
    monkeypatch.setattr(al, "most", 50)
    r = random.Random(5)
    for _ in range(12):
        texts = [" ".join("".join(r.choice("abcßé日🙂'0") for _ in range(r.randrange(1, 12))) for _ in range(25)) for _ in range(3)]
        entries, z = al.chunks([t.encode() for t in texts])
        for k, t in enumerate(texts):
            at, _ = al.links(entries[z[k] : z[k + 1]])
            got = Counter()
            for pair, n in zip(al.pair[at].tolist(), al.times[at].tolist(), strict=True):
                got[pair >> 32, pair & 0xFFFFFFFF] += n
            assert got == Counter((a, b) for x, y in groups_of(libraries, t) for a in x for b in y)
    assert al.shrunk > 5
