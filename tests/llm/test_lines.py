import random

import pytest

from loomwork.llm import line_templates


def line(r, n=8):
    return " ".join("".join(r.choice("abcdefghijklmnopqrst") for _ in range(6)) for _ in range(n))


def dropped(spark, rows):
    return {x.doc_id: x.n_dropped for x in line_templates.dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}


def test_a_group_of_copies_does_not_save_a_line(spark):
    r = random.Random(3)
    shared, base = line(r, 15), line(r, 40)
    rows = [(i, f"{line(r, 40)}\n{shared}\n{line(r, 40)}") for i in range(6)] + [(10 + i, f"{base}\n{shared}") for i in range(20)]
    assert dropped(spark, rows) == {i: int(i > 0) for i, _ in rows}


@pytest.mark.parametrize(("passage", "own"), [(10, 2), (20, 3), (30, 5), (40, 2), (60, 2), (200, 2)])
def test_a_passage_of_many_lines_in_short_documents(spark, passage, own):
    r = random.Random(passage)
    shared = [line(r) for _ in range(passage)]
    rows = [(i, "\n".join([*shared, *(line(r) for _ in range(own))])) for i in range(40)]
    assert dropped(spark, rows) == {i: passage * (i > 0) for i, _ in rows}


def test_documents_of_one_line(spark):
    r = random.Random(4)
    start, end = line(r, 5), line(r, 4)
    rows = [(i, f"{start} {1000 + i} {2000 + i} {end}") for i in range(8)]
    assert dropped(spark, rows) == {i: int(i > 0) for i, _ in rows}


def test_copies_keep_their_lines_beside_strangers(spark):
    """Under one licence of 60 lines: strangers with two lines of their own, exact copies, near copies with edited lines."""
    r = random.Random(8)
    licence = [line(r) for _ in range(60)]
    rows = [(i, "\n".join([*licence, line(r, 9), line(r, 9)])) for i in range(30)]
    body = [line(r, 14) for _ in range(30)]
    rows += [(100 + i, "\n".join(body)) for i in range(12)]
    for i in range(12):  # a word more, a word less, or another word, each in a line of its own
        words = body[i].split()
        edited = [words[:5] + ["extra"] + words[5:], words[:5] + words[6:], words[:5] + ["other"] + words[6:]][i % 3]
        rows.append((200 + i, "\n".join([*body[:i], " ".join(edited), *body[i + 1 :]])))
    assert dropped(spark, rows) == {i: 60 if 0 < i < 100 else 0 for i, _ in rows}


def test_a_leaf_of_many_lines_against_a_loop(spark):
    """One leaf of very many lines; the templates are those of a loop that compares each line with all before it."""
    r = random.Random(9)
    start = "these four words lead"
    bases = [[line(r, 1) for _ in range(8)] for _ in range(40)]
    rows = []
    for i in range(1500):
        words = list(r.choice(bases)) if i % 2 else [line(r, 1) for _ in range(8)]
        for _ in range(r.randrange(2)):
            words[r.randrange(8)] = line(r, 1)
        rows.append((i, "\n".join([line(r, 30), f"{start} " + " ".join(words), line(r, 30)])))
    found = line_templates.occurrences(spark.createDataFrame([(line_no, i, t) for line_no, (i, t) in enumerate(rows)], "rk long, doc_id long, text string")).filter("leaf is not null").select("leaf", "line", "tokens").distinct().collect()
    by_leaf = {}
    for x in found:
        by_leaf.setdefault((x.leaf, len(x.tokens)), []).append((x.line, x.tokens))
    assert max(map(len, by_leaf.values())) > 700
    df = spark.createDataFrame([(k[0], n, t) for k, v in by_leaf.items() for n, t in v], "leaf long, line long, tokens binary")
    got = dict(df.coalesce(1).sortWithinPartitions("leaf", "line").mapInArrow(line_templates._parse(0.8), "line long, template long").collect())
    for lines in by_leaf.values():
        founders = []
        for n, t in sorted(lines):
            tokens = [t[k : k + 2] for k in range(0, len(t), 2)]
            best = max(founders, key=lambda f: sum(a == b for a, b in zip(f[1], tokens, strict=True)), default=None)
            if best and sum(a == b for a, b in zip(best[1], tokens, strict=True)) >= 0.8 * len(tokens):
                best[1][:] = [a if a == b else None for a, b in zip(best[1], tokens, strict=True)]
                assert got[n] == best[0]
            else:
                founders.append((n, tokens))
                assert n not in got
