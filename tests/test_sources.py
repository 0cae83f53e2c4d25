import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwork.operators import gates as Gt
from loomwork.sources import files as S
from loomwork.sources import keyed_json as K
from loomwork.sources.keyed_json import read_keyed_json
from loomwork.streaming.validate import start, validated, windowed_counts


def test_csv_is_strict(spark, tmp_path):
    good = tmp_path / "a.csv"
    good.write_text('id,prompt,answer\n1,"two\nlines, ""quoted""",x\n2,b\n', encoding="utf-8")
    rows = sorted(map(tuple, S.read_csv(spark, str(good)).select("id", "prompt", "answer").collect()))
    assert rows == [("1", 'two\nlines, "quoted"', "x"), ("2", "b", None)]
    bad = tmp_path / "b.csv"
    bad.write_text("id,answer,prompt\n1,2,3\n")
    with pytest.raises(ValueError, match="header"):
        S.read_csv(spark, str(bad))
    more = tmp_path / "c.csv"
    more.write_text("id,prompt,answer\n1,2,3,4\n")
    with pytest.raises(ValueError, match="more fields"):
        S.read_csv(spark, str(more)).collect()


def test_jsonl(spark, tmp_path):
    schema = T.StructType([T.StructField("id", T.StringType()), T.StructField("prompt", T.StringType())])
    p = tmp_path / "a.jsonl"
    p.write_text('{"id":"1","prompt":"a","extra":1}\n\n  \n{"id":"2","prompt":"b"}\n')
    df = S.read_jsonl(spark, str(p), schema, ("id", "prompt"), split="train").orderBy("_ord")
    assert [(r.id, r.prompt, r.split) for r in df.collect()] == [("1", "a", "train"), ("2", "b", "train")]
    p.write_text('{"id":"1"}\nnot json\n')
    with pytest.raises(ValueError, match="invalid_json x 1, missing:prompt x 1"):
        S.read_jsonl(spark, str(p), schema, ("id", "prompt"))


def test_pool_and_keyed_json(spark, tmp_path):
    p = tmp_path / "pool.json"
    p.write_text(json.dumps({"seed": 1, "pool": ["b", "a", "b"]}))
    assert [r.id for r in S.read_pool(spark, str(p)).orderBy("_ord").collect()] == ["b", "a"]
    p.write_text(json.dumps(["x"]))
    assert [r.id for r in S.read_pool(spark, str(p)).collect()] == ["x"]
    k = tmp_path / "big.json"
    k.write_text(json.dumps({f"k{i}": {"q": f"é{i}", "n": i} for i in range(500)}, indent=1), encoding="utf-8")
    rows = read_keyed_json(spark, str(k), "q string, n int").orderBy("_ord").collect()
    assert [(r.key, r.value.q, r.value.n) for r in rows] == [(f"k{i}", f"é{i}", i) for i in range(500)]


def _in_ranges(path, size, piece):
    """The pairs of a file as tasks read them, range by range."""
    n = path.stat().st_size
    opening = K._check_ends(str(path), n)
    data, out, known = path.read_bytes(), [], []
    for at in range(0, n, size):
        escaped = (len(data[:at]) - len(data[:at].rstrip(b"\\"))) % 2 == 1
        known.append((at, escaped, K.summary(K._bytes(str(path), at, size), escaped)))
    begins, inside, depth = K.starts([s for _, _, s in known])
    if inside or depth:
        raise ValueError("keyed JSON: open")
    for (at, escaped, _), (i, d) in zip(known, begins, strict=True):
        if d < 1 and at > opening:
            if not K._blank_after(str(path), at, n):
                raise ValueError("keyed JSON: after")
        else:
            out += [(k, json.loads(v)) for k, v, _ in K.pairs(str(path), at, min(size, n - at), i, d, escaped, piece)]
    return out


def test_keyed_json_in_any_ranges(tmp_path):
    r = random.Random(3)

    def value(deep=0):
        kind = r.randrange(6)
        if kind < 3 or deep > 3:
            return r.choice([1, 2.5, None, True, "".join(r.choice('a"\\{}[],: \n日é') for _ in range(r.randrange(12)))])
        return [value(deep + 1) for _ in range(r.randrange(4))] if kind < 5 else {f'k{n}"': value(deep + 1) for n in range(r.randrange(4))}

    path = tmp_path / "a.json"
    for _ in range(40):
        pairs = [(f"key{n}" + r.choice(["", '"', "\\", "{", ", \\\\"]), value()) for n in range(r.randrange(9))]
        said = r.choice([",", ",\n", " , "]).join(json.dumps(k, ensure_ascii=r.random() < 0.5) + r.choice([":", " : "]) + json.dumps(v, ensure_ascii=r.random() < 0.5, indent=r.choice([None, 1])) for k, v in pairs)
        path.write_text(r.choice(["", " \n"]) + "{" + said + "}" + r.choice(["", " \n\n  "]), encoding="utf-8")
        for size in (1, 2, 3, 7, 50, 10**6):
            assert _in_ranges(path, size, r.choice([1, 5, 100])) == pairs


def test_keyed_json_is_whole_or_an_error(spark, tmp_path):
    pairs = {f"k{i}": {"q": "x" * (i * 37 % 90), "n": i, "deep": [i, None, {"a": "\\u00e9, }"}]} for i in range(60)}
    text, path = json.dumps(pairs), tmp_path / "b.json"
    path.write_text(text)
    for parts in (1, 2, 7, 64):
        size = -(-len(text) // parts)
        rows = read_keyed_json(spark, str(path), "q string, n int", range_bytes=size).orderBy("_ord").collect()
        assert [(r.key, r.value.q, r.value.n) for r in rows] == [(k, v["q"], v["n"]) for k, v in pairs.items()]
    assert [r.key for r in read_keyed_json(spark, str(path), "n int", range_bytes=500, most=5).collect()] == [f"k{i}" for i in range(5)]
    for bad in (text[: len(text) // 2], text[:-1], text.replace('"n": 30', '"n": oops 30'), text + "x", text + text, "[1]", "", "  ", '{"a":1 "b":2}', '{"a":1,}', "{1:2}", "{,}", '{"a":1}}', '{"a":"x}'):
        path.write_text(bad)
        for size in (1, 3, 64, 10**6):
            with pytest.raises(ValueError, match="keyed JSON"):
                _in_ranges(path, size, 16)
    path.write_text(text[:-40])
    with pytest.raises(Exception, match="keyed JSON"):
        read_keyed_json(spark, str(path), "q string", range_bytes=1000).collect()
    path.write_text(" { } \n")
    assert read_keyed_json(spark, str(path), "q string").count() == 0


def test_order_over_files_is_by_name(spark, tmp_path):
    schema = T.StructType([T.StructField("id", T.StringType())])
    want = []
    for name, n in (("a", 3), ("b", 500), ("c", 1), ("d", 90)):
        ids = [f"{name}{i}" for i in range(n)]
        (tmp_path / f"{name}.jsonl").write_text("".join(json.dumps({"id": i}) + "\n" for i in ids))
        want += ids
    assert [r.id for r in S.read_jsonl(spark, str(tmp_path), schema, ("id",)).orderBy("_ord").collect()] == want


def test_write_then_read(spark, tmp_path):
    df = spark.createDataFrame([(2, "b", "é"), (1, "a", None)], "_ord long, id string, v string")
    S.write_jsonl(df, str(tmp_path / "out"), ("id", "v"), single_file=True)
    text = next((tmp_path / "out").glob("part-*")).read_text(encoding="utf-8")
    assert text == '{"id":"a"}\n{"id":"b","v":"é"}\n'


def test_probe(spark):
    df = spark.createDataFrame([(" ", "x", ["p", "q"]), ("y", None, [])], "question string, input string, rationale array<string>")
    text, name = S.probe(df, ("question", "input", "prompt"))
    long, _ = S.probe(df, ("rationale",))
    assert [tuple(r) for r in df.select(text, name, long).collect()] == [("x", "input", "p\nq"), ("y", "question", None)]


def test_stream(spark, tmp_path):
    src = tmp_path / "in"
    rows = [("2026-01-01 00:00:00", "a  b"), ("2026-01-01 00:01:00", "a b"), ("2026-01-01 00:02:00", " "), ("2026-01-01 01:00:00", "c")]
    df = spark.createDataFrame(rows, "ts string, prompt string").selectExpr("to_timestamp(ts) ts", "prompt")
    df.coalesce(1).write.parquet(str(src))
    stream = spark.readStream.schema(df.schema).parquet(str(src))
    start(validated(stream, "prompt", "ts"), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(60)
    assert sorted(r.hash for r in spark.read.parquet(str(tmp_path / "out")).collect()) == sorted(r.hash for r in validated(df, "prompt", "ts").collect())
    assert windowed_counts(df, "ts", "prompt").count() == 4


def test_splits_manifest_and_reports(spark, tmp_path):
    from loomwork.sources import sinks

    df = spark.createDataFrame([(i, f"id{i}", "train" if i % 3 else "test", None if i else "bad") for i in range(9)], "_ord long, id string, split string, error string")
    sinks.write_splits(df, str(tmp_path / "s"), ("id",))
    lines = [x for p in sorted((tmp_path / "s" / "split=train").glob("part-*")) for x in p.read_text().splitlines()]
    assert lines == [f'{{"id":"id{i}"}}' for i in (1, 2, 4, 5, 7, 8)]
    with pytest.raises(Exception, match="already exists"):
        sinks.write_splits(df, str(tmp_path / "s"), ("id",))
    m = sinks.write_manifest(df, str(tmp_path / "m.json"), "split", "id", 42)
    assert json.loads((tmp_path / "m.json").read_text()) == m and m["splits"]["test"]["n"] == 3
    with pytest.raises(ValueError, match="1 invalid"):
        sinks.require(df, "error", str(tmp_path / "r.json"))
    assert json.loads((tmp_path / "r.json").read_text())["errors"] == {"bad": 1}
    assert sinks.require(df.filter("error is null"), "error", "unused").count() == 8
    sinks.write_exclusions(spark.createDataFrame([("train", "a", "too long"), ("dev", "b", None)], "split string, id string, reason string"), str(tmp_path / "x"), 5)
    assert sorted((r.split, r.id) for r in sinks.read_exclusions(spark, str(tmp_path / "x"), 5).collect()) == [("dev", "b"), ("train", "a")]
    with pytest.raises(ValueError, match="max_length 5, not 6"):
        sinks.read_exclusions(spark, str(tmp_path / "x"), 6)
    p = spark.createDataFrame([("a", True), ("b", False), ("c", None)], "id string, primary_correct boolean")
    sinks.write_evaluation(p, str(tmp_path / "e"))
    assert spark.read.json(str(tmp_path / "e" / "error_cases")).count() == 2


def test_a_large_split_is_written_in_order_by_many_tasks(spark, tmp_path):
    from loomwork.sources import sinks

    df = spark.range(2000).select(F.col("id").alias("_ord"), F.when(F.col("id") % 10 == 0, "dev").otherwise("train").alias("split")).repartition(6)
    sinks.write_splits(df, str(tmp_path / "s"), ("_ord",))
    files = sorted((tmp_path / "s" / "split=train").glob("part-*"))
    assert len(files) > 2
    got = [json.loads(x)["_ord"] for p in files for x in p.read_text().splitlines()]
    assert got == [i for i in range(2000) if i % 10]


def test_hash_trees_do_not_depend_on_parts(spark):
    def root(hashes, fanout):
        while len(hashes) > 1:
            hashes = [hashlib.sha256("".join(hashes[k : k + fanout]).encode()).hexdigest() for k in range(0, len(hashes), fanout)]
        return hashes[0]

    rows = [(i, f"line {i}", "a" if i % 3 else "b") for i in range(500)] + [(1000, "alone", "c")]
    df = spark.createDataFrame(rows, "o long, t string, s string")
    want = {s: root([hashlib.sha256(t.encode()).hexdigest() for _, t, x in rows if x == s], 4) for s in "abc"}
    for n in (1, 3, 11):
        got = {r.split: (r.root, r.n) for r in Gt.hash_trees(df.repartition(n), "s", F.col("t"), "o", fanout=4).collect()}
        assert got == {s: (want[s], sum(x == s for *_, x in rows)) for s in "abc"}
    assert Gt.hash_trees(df.limit(0), "s", F.col("t"), "o").count() == 0


def test_overrides():
    from loomwork.functions.config import override

    c = {"a": {"b": 1}, "t": "x"}
    assert override(c, ["a.b=2.5", "t=y"]) == {"a": {"b": 2.5}, "t": "y"} and c["a"]["b"] == 1
    for bad in ("a.c=1", "z=1", "a.b.c=1"):
        with pytest.raises(KeyError):
            override(c, [bad])


def test_twister_order_is_pythons_shuffle(spark):
    import random

    from loomwork.operators.split import twister_order

    want = list(range(50))
    random.Random(7).shuffle(want)
    rows = twister_order(spark.range(50).repartition(5), "id", 7).orderBy("place").collect()
    assert [r.id for r in rows] == want


def test_records_of_mixed_shapes(spark, tmp_path):
    from loomwork.sources import external as X

    why = "To solve this, first recall the fact, then apply it step by step, checking each result before the answer. " * 2
    records = [
        {"instruction": "What is twenty plus twenty-two?", "rationale": why, "answer": "42", "id": 7},
        {"question": "What is the capital city of France?", "cot": [why, {"content": "so"}, {"text": "it is"}, 5, {"x": "y"}], "target": {"note": 1, "final": "Paris"}},
        {"problem": {"question": "What is five multiplied by six?", "n": 1}, "reasoning": [{"role": "a", "content": why}], "output": "30", "prompt_id": "p3"},
        {"prompt": "bad", "reasoning": "", "answer": ""},
        {"question": 5, "input": " What is it? ", "response": why, "gold": 7},
        {"question": "   ", "query": "What is the capital city of France?", "solution": why, "final": "Paris"},
        {"source": "Write an essay about the industrial revolution.", "explanation": why, "ground_truth": "essay"},
        {"question": "What is the meaning of life?", "thoughts": why, "answer": "a " * 200},
        {"rationale": why, "answer": "x"},
        {"question": None, "input": [], "answer": {}},
    ]
    path = tmp_path / "mixed.jsonl"
    path.write_text("\n".join(json.dumps(r) for r in records) + "\n\n")
    rows = X.read_variants(spark, str(path))
    out = X.adapt(rows).orderBy("_ord").collect()
    assert [r.status for r in out] == [None, None, None, "missing_reasoning", "missing_answer", "duplicate_question", None, None, "missing_question", "missing_question"]
    assert [r.question for r in out[:3]] == ["What is twenty plus twenty-two?", "What is the capital city of France?", "What is five multiplied by six?"]
    assert out[1].reasoning == why.strip() + " \nso\nit is" and out[1].answer == "Paris" and out[4].question == "What is it?"
    assert [r.fields_used["question"] for r in out[:6]] == ["instruction", "question", "problem", "prompt", "input", "question"]
    assert [r.fields_used["reasoning"] for r in out[:3]] == ["rationale", "cot", "reasoning"] and [r.original_id for r in out[:3]] == ["7", "", "p3"]
    kept = X.candidates(X.adapt(rows)).collect()
    assert {r.question.split()[0]: r.reject_reason for r in kept if r.reject_reason} == {"Write": "open_ended", "What": "answer_too_long"} and sum(r.reject_reason is None for r in kept) == 3
    kinds = {(r.field, r.kind): r.n for r in X.field_kinds(rows).collect()}
    assert kinds["question", "string"] == 3 and kinds["question", "bigint"] == 1 and kinds["question", "null"] == 1 and kinds["input", "array"] == 1 and kinds["answer", "object"] == 1
    assert "question: VARIANT" in X.common_schema(rows) and "rationale: STRING" in X.common_schema(rows)
    path.write_text('{"a":1}\n[1]\nnot json\n')
    with pytest.raises(ValueError, match="2 lines"):
        X.read_variants(spark, str(path))


def test_file_digests_are_streamed(spark, tmp_path):
    for k, n in enumerate((1, 10, 3_000_000)):
        (tmp_path / f"{k} é.bin").write_bytes(bytes(range(256)) * (n // 256) + b"x" * (n % 256))
    got = {r.path.rsplit("/", 1)[1][0]: (r.n_bytes, r.sha256) for r in Gt.file_digests(spark, str(tmp_path)).collect()}
    assert got == {p.name[0]: (p.stat().st_size, hashlib.sha256(p.read_bytes()).hexdigest()) for p in tmp_path.iterdir()}


def test_output_folders_and_protected_splits(spark, tmp_path):
    from loomwork.sources import sinks

    run = tmp_path / "run"
    with pytest.raises(FileNotFoundError, match="does not exist"):
        sinks.output_folder(spark, str(run), str(run / "step-1"))
    assert sinks.output_folder(spark, str(run)).endswith("/run") and run.is_dir()
    with pytest.raises(FileExistsError):
        sinks.output_folder(spark, str(run))
    with pytest.raises(ValueError, match="not inside"):
        sinks.output_folder(spark, str(run), str(tmp_path / "run-2"))
    with pytest.raises(FileNotFoundError, match="no folder"):
        sinks.output_folder(spark, str(run), str(run / "step-1"))
    (run / "step-1").mkdir()
    assert sinks.output_folder(spark, str(run), str(run / "step-1")).endswith("/run")
    assert sinks.open_split("validation") == "validation" and sinks.open_split("test", True) == "test"
    for args in (("train",), ("test",)):
        with pytest.raises(ValueError):
            sinks.open_split(*args)
