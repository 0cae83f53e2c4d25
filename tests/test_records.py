import random

import pytest
from pyspark.sql import functions as F

from loomwork.functions import bits as B
from loomwork.operators import generate as Gn
from loomwork.operators import reason as R
from loomwork.operators import records as Rec
from loomwork.operators import scoring as S

C = F.col


def errors(spark, rows, schema, expr):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(expr).collect()]


def test_strict(spark):
    rows = [("yes_no", "q", "yes"), ("yes_no", "q", "Yes"), ("yes_no", "", "yes"), ("yes_no", "q", ""), ("binary_only", "q", "0101010"), ("exact", "q", " x"), ("exact", "q", "Sure thing"), ("exact", "q", "a```"), ("line_count", "q", "a\nb"), ("line_count", "q", "a"), ("other", "q", "a"), ("classification", "q", "good"), ("exact", "q", "a<|im_end|>")]
    got = errors(spark, rows, "c string, u string, a string", Rec.strict_error(C("c"), C("u"), C("a"), categories=("yes_no", "binary_only", "exact", "line_count", "classification"), line_count=F.lit(2)))
    assert got == [None, "not_yes_no", "empty_user", "empty_assistant", "not_8_bits", "outer_whitespace", "explanatory_prefix", "markdown_fence", None, "wrong_line_count", "unsupported_category", "not_a_label", "end_mark"]


def test_mixture(spark):
    cot = "<think>\nr\n</think>\n\n57.0"
    rows = [
        ("gravity", "compressed_cot", cot, "57.0"), ("gravity", "compressed_cot", cot + "\nmore", "57.0"), ("gravity", "compressed_cot", "57.0", "57.0"), ("gravity", "answer_only", cot, "57.0"), ("gravity", "answer_only", "57.0", "57.0"), ("gravity", "answer_only", "57.0", "58"),
        ("cipher", "answer_only", "A b", "A b"), ("gravity", "answer_only", "\\boxed{1}", "1"), ("x", "strict_replay", "<think>a", None), ("x", "strict_replay", "fine", None), ("gravity", "odd", "1", "1"), ("gravity", "compressed_cot", cot.replace("r", "r\n" * 10), "57.0"),
    ]
    got = errors(spark, rows, "t string, s string, a string, g string", Rec.mixture_error(C("t"), C("s"), F.lit("u"), C("a"), tokens=F.lit(5), gold=C("g"), final_answer=C("g"), reasoner_answer=C("g")))
    assert got == [None, "more_than_final", "unclosed_tags", "tags_in_answer_only", None, "not_gold", "final_parse_failed", "boxed_residue", "invalid_replay_tags", None, "unsupported_sample_type", "trace_too_long"]


def test_thinking_and_no_think(spark):
    ok = "<think>r</think> yes"
    rows = [(ok, True, "yes", "yes_no_reasoning_thinking"), (ok, False, "yes", None), (ok, True, "no", None), ("yes", True, "yes", None), ("<think>r</think>", True, "", None), ("<think>r</think>maybe", True, "maybe", "yes_no_reasoning_thinking"), ("<think>" + "r " * 700 + "</think>a", True, "a", None)]
    got = errors(spark, rows, "a string, m boolean, f string, s string", Rec.thinking_error(F.lit("u"), C("a"), thinking=C("m"), final_answer=C("f"), subtype=C("s")))
    assert got == [None, "metadata_not_thinking", "final_mismatch", "no_think_structure", "empty_final", "not_yes_no", "reasoning_too_long"]
    rows = [("<think>", False, "x", False), ("a", True, "x", False), ("01", False, "binary_only", False), ("word " * 60, False, None, True), ("word", False, None, True)]
    got = errors(spark, rows, "a string, m boolean, s string, o boolean", Rec.no_think_error(C("a"), thinking=C("m"), source_category=C("s"), open_replay=C("o")))
    assert got == ["think_tags", "metadata_thinking", "not_8_bits", None, "words_out_of_range"]


def test_sharegpt(spark):
    t = "array<struct<`from`:string,role:string,value:string,content:string>>"
    both = "<|begin_of_thought|> why <|end_of_thought|> ```\nfirst\nsecond\n```"
    rows = [([("human", None, "q1", None), ("gpt", None, "early", None), (None, "user", None, "q2"), (None, "assistant", None, both)],), ([("human", None, "q", None)],), ([("human", None, "q", None), ("gpt", None, "no marks", None)],), ([],)]
    got = [tuple(r[0]) for r in spark.createDataFrame(rows, f"m {t}").select(Rec.sharegpt(C("m"))).collect()]
    assert got[0] == (True, "q1", "why", "first")
    assert not any(g[0] for g in got[1:] if g[0] is not None)


def test_mini_classes(spark):
    rows = [("1", "1.0", "1", False, 5), ("10", "1.0", "10", False, 5), ("a", "b", "a", False, 5), ("", "b", "", False, 5), ("a", "b", "a", False, 256), ("a", "b", "a", True, 5), ("a", "b", "<think>", True, 5)]
    got = errors(spark, rows, "f string, e string, r string, w boolean, n int", Rec.mini_error_class(C("f"), C("e"), C("r"), C("w"), C("n")))
    assert got == ["answer_wrong", "rounding_error", "rounding_error", "parse_fail", "stop_fail", "missing_think", "unclosed_think"]


def test_bits(spark):
    r = random.Random(0)
    rows = [(f"{r.randrange(256):08b}", f"{r.randrange(256):08b}") for _ in range(50)]
    out = spark.createDataFrame(rows, "b string, m string").select("b", "m", B.rotate_left(C("b"), 3).alias("l"), B.rotate_right(C("b"), 3).alias("r"), B.shift_left(C("b"), 2).alias("sl"), B.shift_right(C("b"), 2).alias("sr"), B.masked(C("b"), C("m"), "and").alias("a"), B.masked(C("b"), C("m"), "or").alias("o"), B.masked(C("b"), C("m"), "xor").alias("x"), B.invert(C("b")).alias("i")).collect()
    for x in out:
        b, m = x.b, x.m
        assert (x.l, x.r, x.sl, x.sr) == (b[3:] + b[:3], b[-3:] + b[:-3], b[2:] + "00", "00" + b[:-2])
        n, k = int(b, 2), int(m, 2)
        assert (x.a, x.o, x.x, x.i) == tuple(f"{v:08b}" for v in (n & k, n | k, n ^ k, 255 - n))


@pytest.mark.parametrize("category", Gn.STRICT)
def test_generated_rows_satisfy_their_validator(spark, category):
    df = Gn.generate(spark, category, 60)
    if category == "json_only":
        df = S.json_success(df.withColumn("e", F.lit(None).cast("string")), "answer", "e", "ok")
    else:
        v = F.struct(C("validator.type").alias("type"), C("validator.value").alias("value"), C("validator.pattern").alias("pattern"), C("validator.count").alias("count"), F.lit(None).cast("array<string>").alias("values"), F.lit(None).cast("int").alias("max_words"), F.lit(None).cast("int").alias("max_lines"))
        df = df.withColumn("ok", S.validator_success(v, C("answer")))
    rows = df.collect()
    assert len(rows) == 60 and all(r.ok for r in rows)


@pytest.mark.parametrize("category", ["wonderland_like_binary_thinking", "binary_operation_thinking"])
def test_generated_rules_are_consistent(spark, category):
    for r in Gn.generate(spark, category, 40).collect():
        assert len(r.answer) == 8 and set(r.answer) <= {"0", "1"} and r.answer in r.reasoning


def test_physics_and_emission(spark):
    ex = [("1", "4.9"), ("2", "19.6"), ("0", "0")]
    rows = [("a", "gravity", ex, "3", "44.10", "p"), ("b", "gravity", ex, "3", "50.0", "p"), ("c", "unit_conversion", [("2", "3.0"), ("4", "6.0")], "10", "15.00", "p"), ("d", "unit_conversion", [("0", "1")], "1", "1", "p"), ("e", "numeral", [("1", "I")], "14", "XIV", "p"), ("f", "cipher", [("b", "a")], "zz", "aa", "p")]
    df = spark.createDataFrame(rows, "pid string, task_type string, examples array<struct<input_value:string,output_value:string>>, question string, gold string, prompt string")
    out = {r.pid: r for r in R.reason(df).collect()}
    assert {k: (r.ok, r.error) for k, r in out.items()} == {"a": (True, None), "b": (False, "numeric_tolerance_failed"), "c": (True, None), "d": (False, "no_nonzero_examples"), "e": (True, None), "f": (False, "no_rule")}
    assert out["a"].coefficient == pytest.approx(9.8) and out["c"].coefficient == pytest.approx(1.5)
    emitted = {(r.pid, r.sample_type): r.skip_reason for r in R.emit(R.reason(df), 3, budget=True).collect()}
    assert len(emitted) == 12 and all(v is None for (_, s), v in emitted.items() if s == "answer_only")
    assert [emitted[p, "compressed_cot"] for p in "abe"] == [None, "reasoner:numeric_tolerance_failed", None]
