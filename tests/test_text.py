import hashlib
import random
import re

from pyspark.sql import functions as F

from loomwork.functions import text as T
from loomwork.functions import thinking as Th

ODD = ["", " ", "a  b\tc\n", "\x85 x  y", "\xa0a　", "a\r\nb\x0bc\x0c", "\x1cz\x1f", "no end\n", "\n\n", "é ñ_1", "a b\x1db"]


def adversarial(n=300):
    r = random.Random(4)
    pool = [chr(c) for c in (*range(1, 0x100), 0x1680, 0x2000, 0x200A, 0x200B, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0x4E00)]
    return ODD + ["".join(r.choice(pool) for _ in range(r.randrange(12))) for _ in range(n)]


def test_white_space_lines_and_hash_match_python(spark):
    texts = adversarial()
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    rows = df.select("i", T.strip("t").alias("s"), T.normalize_ws("t").alias("n"), T.lines("t").alias("l"), T.count_fields("t").alias("f"), T.prompt_hash("t").alias("h")).collect()
    for r in rows:
        t = texts[r.i]
        assert r.s == t.strip()
        assert r.n == " ".join(t.split())
        assert list(r.l) == t.splitlines()
        assert r.f == len(t.split())
        assert r.h == hashlib.sha256(" ".join(t.split()).encode()).hexdigest()


def test_fullmatch_does_not_stop_before_a_final_newline(spark):
    df = spark.createDataFrame([("abc",), ("abc\n",)], "t string")
    assert [r[0] for r in df.select(T.fullmatch("t", "[a-z]+")).collect()] == [True, False]
    assert [r[0] for r in df.select(T.fullmatch("t", F.lit("[a-z]+"))).collect()] == [True, False]


def test_clean_text_and_token_estimate(spark):
    texts = ["", "abcdefgh", "abcdefghi", "a\x00bcdefghij", "�abcdefghij", "aaaa"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.select(T.looks_clean("t", 8).alias("a"), T.looks_clean("t", 9).alias("b"), T.token_estimate("t").alias("n")).collect()
    for t, r in zip(texts, rows, strict=True):
        ok = "\x00" not in t and "�" not in t and bool(t.strip())
        assert r.a == (ok and len(set(t.strip())) >= 8)
        assert r.b == (ok and len(set(t.strip())) > 8)
        assert r.n == (0 if not t else max(1, int(len(t) / 3.5)))


def test_decimal_key_is_decimal_equality(spark):
    from decimal import Decimal

    values = ["57.0", "57.00", "16.65", "16.650", "-0", "0", "-0.50", "-.5", "007.10", "1e3", "x", "12345678901234567890123456789012345678901.10", "12345678901234567890123456789012345678901.1"]
    keys = {v: k for v, k in zip(values, [r[0] for r in spark.createDataFrame([(v,) for v in values], "t string").select(T.decimal_key("t")).collect()], strict=True)}
    for a in values:
        for b in values:
            plain = all(re.fullmatch(r"-?\d+(\.\d+)?", v) for v in (a, b))
            if plain:
                assert (keys[a] == keys[b]) == (Decimal(a) == Decimal(b)), (a, b)
    assert keys["1e3"] is None and keys["x"] is None and keys["-.5"] is None


def test_thinking_parsers_differ_as_specified(spark):
    cases = ["<think>r</think> a", "<think>r</think>", "<think><think>r</think>a", "</think>r<think>a", "<think> </think>a", "a", "<think>r</think>a</think>b"]
    df = spark.createDataFrame([(c,) for c in cases], "t string")
    rows = df.select(Th.parse("t", strict=False).alias("l"), Th.parse("t", strict=True).alias("s"), Th.final_answer("t").alias("f"), Th.final_after_first("t").alias("g")).collect()
    assert [r.l.ok for r in rows] == [True, True, True, False, False, False, True]
    assert [r.s.ok for r in rows] == [True, False, False, False, False, False, False]
    assert rows[1].l.final == "" and rows[6].f == "b" and rows[6].g == "a</think>b"


def test_build_then_parse(spark):
    r = spark.sql("select ' r ' a, ' b ' c").select(Th.build("a", "c").alias("t")).select("t", Th.parse("t", strict=True).alias("p")).first()
    assert r.t == "<think>\nr\n</think>\n\nb" and (r.p.reasoning, r.p.final) == ("r", "b")
