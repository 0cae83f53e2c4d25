import random

import pytest

#: Names that operators use inside; a table that has them too must change nothing.
CLASHES = ("fp", "rk", "h", "c", "n", "key", "line", "score", "at", "template", "a", "b", "u", "v", "root", "x", "shard", "w", "kept", "__rk", "__gone")


def words(r, n, vocabulary=400):
    return " ".join("".join("abcdefghijklmnopqrst"[int(d)] for d in str(r.randrange(vocabulary * 8))) + "abcdefgh"[r.randrange(8)] for _ in range(n))


@pytest.fixture(scope="session")
def corpus():
    """(doc_id, text): copies, near copies, shared lines, empty, null, very long, tied and repeated rows."""
    r = random.Random(11)
    rows = [(i, "\n".join(words(r, r.randrange(5, 40)) for _ in range(r.randrange(1, 6)))) for i in range(120)]
    shared = "This very line stands in many documents and says nothing new at all."
    rows = [(i, t + ("\n" + shared if i % 6 == 0 else "")) for i, t in rows]
    rows += [(200 + i, rows[3][1]) for i in range(5)]
    long = words(r, 3000)
    rows += [(300, long), (301, long + " tail"), (302, long.upper()), (303, ""), (304, None), (305, "one"), (306, "one two"), (307, " \t\n "), (308, "日本語 テキスト"), (None, "no id here at all, none"), (309, "x" * 20000)]
    return [*rows, rows[0], rows[0], (None, None)]


@pytest.fixture(scope="session")
def docs(spark, corpus):
    rows = [(i, t, "en", None if i is None or i % 2 else "src0", None, *["clash"] * len(CLASHES)) for i, t in corpus]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHES)
    return spark.createDataFrame(rows, schema).repartition(5)


@pytest.fixture(scope="session")
def nothing(docs):
    return docs.limit(0)
