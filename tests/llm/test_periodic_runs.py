import hashlib
import random
import re
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomwork.llm import periodic_runs as pr


def brute(s, least):
    """Every maximal stretch in which letters q apart are equal, for each q; a stretch found with a smaller q is a run of that."""
    n, seen, out = len(s), set(), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if s[i] != s[i + q]:
                i += 1
                continue
            first = i
            while i + q < n and s[i] == s[i + q]:
                i += 1
            if i - first >= q and (first, i + q) not in seen:
                seen.add((first, i + q))
                if i + q - first >= least:
                    out.append((first, i + q - first, q))
    return sorted(out)


@settings(max_examples=600, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=14), st.integers(1, 7), st.lists(st.integers(0, 2), max_size=14), st.integers(1, 3))
def test_runs_against_every_period(head, times, tail, copies):
    s = (head + (tail or [0]) * times + head) * copies
    for least in (2, 12):
        assert pr.runs_of(s, least) == brute(s, least)
        assert pr.text_runs([b"%d" % x for x in s], least) == brute(s, least)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abc", max_size=70))
def test_lyndon_ends_and_extents(text):
    equal = pr.repeats(text)
    for up in (True, False):
        order = {c: (k if up else -k) for k, c in enumerate("abc")}
        suffix = [[order[c] for c in text[i:]] for i in range(len(text))]
        after, agree = pr.lyndon(text, equal, up)
        before = pr.left_extents(text, after)
        for i, j in enumerate(after):
            assert j == next((k for k in range(i + 1, len(text)) if suffix[k] < suffix[i]), len(text))
            assert j == len(text) or agree[i] == next((k for k in range(len(text)) if text[i + k : i + k + 1] != text[j + k : j + k + 1] or j + k >= len(text)), 0)
            assert before[i] == next((k for k in range(j - i) if k >= i or text[i - k - 1] != text[j - k - 1]), j - i)


class Letter:
    """Knows nothing but its order, and counts how often it is asked."""

    asked = 0

    def __init__(self, v):
        self.v = v

    def __eq__(self, other):
        Letter.asked += 1
        return self.v == other.v

    def __lt__(self, other):
        Letter.asked += 1
        return self.v < other.v


def fibonacci(n):
    a, b = "a", "ab"
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


def nested(n):
    u, k = "a", 0
    while len(u) < n:
        u, k = u + u + chr(98 + k), k + 1
    return u


N = 1 << 13
STRINGS = {
    "one": "a" * N, "fibonacci": fibonacci(N), "thue-morse": "".join("ab"[i.bit_count() & 1] for i in range(N)), "random": "".join(random.Random(1).choices("ab", k=N)),
    "blocks": "".join("a" * k + "b" for k in range(1, 127)), "rising": "".join(chr(200 + i) for i in range(N)), "falling": "".join(chr(200 + N - i) for i in range(N)), "nested": nested(N),
    "backwards": nested(N)[::-1], "palindrome": fibonacci(N // 2) + fibonacci(N // 2)[::-1], "parted": (fibonacci(100) + "z") * (N // 101), "period doubling": "".join("ab"[(i & -i).bit_length() & 1] for i in range(1, N)),
}


@pytest.mark.parametrize("name", STRINGS)
def test_comparisons_are_linear(name):
    s = STRINGS[name]
    Letter.asked = 0
    assert len(pr.runs_of([Letter(c) for c in s], 2)) < len(s)
    assert Letter.asked < 12 * len(s)


def test_a_deep_text():
    words = (b"one two three four " * 30_000).split()
    assert pr.text_runs(words) == [(0, 120_000, 4)]
    assert pr.collapse(words, [(0, 120_000, 4)]) == b"one two three four"


def planted(i, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    if i is None or zlib.crc32(str(i).encode()) % 10 or not words:
        return words
    n, g = len(words), zlib.crc32(str(i).encode()) // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (k - a) % p] for k in range(a, n)]


def test_query_rows(spark, docs, corpus):
    r = random.Random(9)
    extra = [(1000 + i, " ".join(r.choice(["a", "b", "c", "日"]) for _ in range(r.randrange(0, 40)))) for i in range(400)]
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame(extra, "doc_id long, text string"))
    got = sorted(map(tuple, pr.digest(pr.find(pr.with_planted(df))).collect()), key=str)
    want = []
    for i, text in [*corpus, *extra]:
        words = planted(i, text)
        runs = brute(words, 12)
        best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=None)
        gone = {k for s, n, q in runs for k in range(s + q, s + n)}
        shown = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
        hashes = (hashlib.sha256(x.encode()).hexdigest() for x in ("".join(f"{s},{n},{q}\n" for s, n, q in runs), " ".join(w for k, w in enumerate(words) if k not in gone)))
        want.append((i, len(runs), *shown, *hashes))
    assert got == sorted(want, key=str)
    assert sum(w[1] > 0 for w in want) > 20


def test_operator_gives_texts_and_runs(spark):
    line = "to be or not to be that is the question "
    df = spark.createDataFrame([(1, line * 3 + "said he"), (1, line * 3 + "said he"), (2, None), (None, "  "), (3, "word " * 11), (4, "word\n" * 12)], "doc_id long, text string")
    rows = sorted(((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in pr.find(df).collect()), key=str)
    both = (1, 32, [(0, 30, 10)], line + "said he")
    assert rows == sorted([both, both, (2, 0, [], ""), (None, 0, [], ""), (3, 11, [], " ".join(["word"] * 11)), (4, 12, [(0, 12, 1)], "word")], key=str)


def test_empty_tables(nothing):
    assert pr.digest(pr.find(pr.with_planted(nothing))).count() == 0
