import random

from loomwork.llm.decontam import Items


def test_items_of_few_shingles_are_never_missed():
    """Windows of 16 shingles missed an item of one shingle in about one text of 250."""
    r = random.Random(6)
    word = lambda: "".join(r.choice("abcdefghijklmnopqrst") for _ in range(6))
    rows = [(i, n, " ".join(word() for _ in range(n + 4))) for i, n in enumerate((1, 1, 1, 2, 3, 4))]
    index = Items([(i, t) for i, _, t in rows], 5, 0.8, 64)
    texts, want = [], set()
    for k in range(6000):
        i, n, item = rows[k % 6]
        texts.append(" ".join([*(word() for _ in range(r.randrange(30, 60))), item, *(word() for _ in range(r.randrange(30)))]))
        want.add((k, i, n, n))
    assert set(index.search(texts)) == want


def test_recall_by_size_class():
    """Items inside long texts, found through equal minima alone: every class has its share of each hundred."""
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefghijklmnopqrst") for _ in range(6))
    for n in (5, 6, 8, 9, 16, 17, 40, 100):
        rows = [(k, " ".join(word() for _ in range(n + 4))) for k in range(20)]
        index = Items(rows, 5, 0.8, 64)
        texts = [" ".join([*(word() for _ in range(r.randrange(400))), rows[k % 20][1], *(word() for _ in range(r.randrange(400)))]) for k in range(300)]
        found = {(i, k) for i, k, _, _ in index.search(texts)}
        assert sum((i, i % 20) in found for i in range(300)) == 300, n
