import random
import re

import corpus_pipeline
import pytest
from loomwork.functions import session
from loomwork.llm import components, line_templates, near_copies, pipeline, quality_bt
from loomwork.llm.textkit import Encoder, default_tokenizer
from tests.llm.test_duplicates import slow_classes, slow_find


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("tables")
    r = random.Random(21)
    word = lambda: "".join(r.choice("aeioulnrst") for _ in range(r.randrange(2, 9)))
    line = lambda n=30: (" ".join(word() for _ in range(n)) + ".").capitalize()
    clean = [(i, "\n".join(line() for _ in range(r.randrange(2, 6)))) for i in range(200)]
    boiler = line(60)
    items = [line(25) for _ in range(3)]
    rows = clean + [(300 + i, "\n".join([line(), boiler, line()])) for i in range(12)]
    rows += [(400 + i, clean[7][1]) for i in range(4)]
    rows += [(500 + i, "\n".join([line(), items[i % 3], line()])) for i in range(4)]
    junk = [(600 + i, (word().upper() + "!! ") * 80) for i in range(40)]
    rows = [(i, t, "en", "src0", len(t)) for i, t in rows + junk]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4).write.parquet(str(d / "documents.parquet"))
    spark.createDataFrame([(i, int(i < 600), 0) for i, *_ in rows if i % 2 == 0], "doc_id long, quality int, toxic int").write.parquet(str(d / "labels.parquet"))
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(str(d / "benchmark.parquet"))
    return str(d), rows, boiler, items


def test_stages_against_brute_force(spark, tables):
    d, rows, boiler, items = tables
    docs = spark.read.parquet(f"{d}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, d)
        assert out.columns == docs.columns
        out.write.parquet(f"{d}/{name}")
        docs = spark.read.parquet(f"{d}/{name}")
        seen[name] = {r.doc_id: r for r in docs.collect()}
    text = {i: t for i, t, *_ in rows}
    # rejected: the junk; every clean document stays
    kept = {i for i in text if i < 600}
    assert kept - set(seen["quality"]) == set() and not any(i >= 600 for i in seen["quality"])
    # the line of twelve documents stays in the first, all other lines everywhere
    want = {i: text[i] if i == 300 else "\n".join(x for x in text[i].split("\n") if x != boiler) for i in kept}
    assert {i: r.text for i, r in seen["line_dedup"].items()} == want
    assert all(r.n_chars == len(r.text) for r in seen["line_dedup"].values())
    classes = slow_classes(sorted(want.items()), 2)
    assert set(seen["near_dedup"]) == {i for i, _, c in classes if i == c} and not any(400 <= i < 404 for i in seen["near_dedup"])
    leaks = {i for i, *_ in slow_find([(i, want[i]) for i in seen["near_dedup"]], list(enumerate(items)))}
    assert leaks == {500, 501, 502, 503} and set(seen["decontamination"]) == set(seen["near_dedup"]) - leaks

    pieces = corpus_pipeline.run(spark, d).collect()
    enc = Encoder.of(default_tokenizer()).lib
    length = {i: len(enc.encode(r.text, add_special_tokens=False).ids) + 1 for i, r in seen["decontamination"].items()}
    got = {}
    for p in pieces:
        got[p.doc_id] = got.get(p.doc_id, 0) + p.length
        assert p.offset + p.length <= 2048 and p.doc_tokens == length[p.doc_id]
    assert got == length


def test_no_join_leaves_to_spark_what_is_broadcast(spark, tables, monkeypatch):
    """Of estimates and compressed bytes Spark broadcasts tables that fill the driver; each join says which kind it is, and what is broadcast has a bound."""
    d, rows, *_ = tables
    plans = []

    def seen(df):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return df

    for module in (components, line_templates, near_copies, pipeline, quality_bt):
        monkeypatch.setattr(module, "settle", lambda df: session.settle(seen(df)), raising=False)
    docs = spark.read.parquet(f"{d}/documents.parquet")
    # near copies in addition, and a template that only equal texts beside it hold
    more = [(700 + i, rows[k][1] + " and more", "en", "src0", 1) for i, k in enumerate((3, 4, 5))]
    docs = docs.unionByName(spark.createDataFrame(more, docs.schema))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        seen(stage(spark, docs, d)).count()
    joins = [x.strip() for p in plans for x in p.split("\n") if re.search(r"\bJoin\b", x)]
    assert len(joins) > 30
    assert [x for x in joins if "strategy=" not in x] == []
