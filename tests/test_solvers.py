"""The batch and column solvers against row-at-a-time models, long arithmetic against whole numbers of any size."""

import random
import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomwork.functions import bit_rules as B
from loomwork.functions import equations as E
from loomwork.functions import long_arithmetic as L
from loomwork.functions import word_cipher as W
from loomwork.functions.grammar import WORD_LIST
from loomwork.functions.solvers import solve_many
from loomwork.operators import long_traces as Lt
from loomwork.operators import reason as R
from loomwork.plans import arithmetic_queries
from tests import models as M

EXAMPLES = "examples array<struct<input_value:string,output_value:string>>"


# --- bits: every rule on every example, one character after the other -----------------------------


def obeys(rule, examples, bit):
    return all(B._apply(rule, x) == y[bit] for x, y in examples)


def test_fits_are_the_rules_that_examples_obey():
    r = random.Random(1)
    problems = []
    for n in (1, 2, 5, 9, 64, 65, 130):
        rules = [r.choice(B.RULES) for _ in range(8)]
        xs = [f"{r.randrange(256):08b}" for _ in range(n)]
        problems.append([(x, "".join(B._apply(q, x) for q in rules)) for x in xs])
    got = B.fits([([x for x, _ in p], [y for _, y in p]) for p in problems])
    for k, p in enumerate(problems):
        for n, rule in enumerate(B.RULES):
            for bit in range(8):
                assert got[k, n, bit] == obeys(rule, p, bit)


def test_runs_are_the_longest_chains():
    r = random.Random(2)
    problems = []
    for _ in range(40):
        a, b, cut = r.choice(B.RULES), r.choice(B.RULES), r.randrange(9)
        rules = [B.moved(a, k) if k < cut else B.moved(b, k) for k in range(8)]
        problems.append([(x, "".join(B._apply(q, x) for q in rules)) for x in (f"{r.randrange(256):08b}" for _ in range(r.randrange(1, 9)))])
    fit = B.fits([([x for x, _ in p], [y for _, y in p]) for p in problems])
    for from_left in (True, False):
        rules, lengths = B.runs(fit, from_left)
        for k, p in enumerate(problems):
            side = list(range(8)) if from_left else list(range(7, -1, -1))
            best, most = 0, 0
            for n, rule in enumerate(B.RULES):
                length = 0
                while length < 8 and obeys(B.moved(rule, length if from_left else -length), p, side[length]):
                    length += 1
                if length > most:
                    best, most = n, length
            assert (rules[k], lengths[k]) == (best, most)


def test_a_bad_row_of_a_batch_is_its_own():
    good = ([("00000001", "00000010"), ("00000011", "00000110"), ("10000001", "00000011")], "01000000")
    tasks = ["bit_manipulation", "numeral", "symbolic_transform", "bit_manipulation", "symbolic_transform"]
    out = solve_many(tasks, [good, ([], "1"), ([("12+34", "46")], "11+22"), ([("x", "y")], "z"), ([], "")])
    assert out[0][0] == "10000000" and out[0][2] == "" and out[1][2] == "missing_reasoner" and out[2][0] == "33" and out[3][2] == out[4][2] == "no_rule"


# --- equations: operations written out on texts ---------------------------------------------------


@pytest.mark.parametrize(
    ("name", "x", "y", "want"),
    [
        ("concatenation", "05", "12", "0512"), ("reverse concatenation", "05", "12", "1205"), ("addition", "05", "12", "17"), ("negated absolute difference", "05", "12", "-7"), ("negated absolute difference", "5", "5", "0"),
        ("subtraction (a-b)", "05", "12", "-7"), ("multiplication", "05", "12", "60"), ("multiply-1", "0", "7", "-1"), ("sub+1", "3", "9", "-5"), ("max mod min", "31", "07", "3"), ("max mod min", "31", "00", None),
        ("integer division (a/b)", "31", "07", "4"), ("reverse modulo (b mod a)", "07", "31", "3"), ("reverse division (b/a)", "00", "31", None), ("digit absolute diff", "19", "25", "14"), ("digit absolute diff", "1", "25", None),
        ("digit sub mod10", "19", "25", "94"), ("cross multiply", "12", "34", "11"), ("cross multiply rev", "12", "34", "10"), ("digit multiply", "39", "42", "1218"), ("digit multiply rev", "39", "42", "636"), ("digit multiply", "30", "42", "120"),
        ("digit sum diff", "12", "34", "-4"), ("digit sum sum", "12", "34", "10"), ("digit product diff", "12", "34", "-10"), ("digit product sum", "12", "34", "14"), ("determinant", "12", "34", "-2"), ("abs determinant", "12", "34", "2"),
    ],
)
def test_operations(name, x, y, want):
    names = [*E.COMMON, *E.RARE]
    result = E.holds([x], [y], [want or "0"])[1][0][names.index(name)]
    assert (E._texts(*result[:3])[0] if result[3][0] else None) == want


def test_search_recovers_planted_operations():
    """The first operation and reading that holds is one that gives every example back, and none before it does."""
    r, names = random.Random(4), [*E.COMMON, *E.RARE]
    for _ in range(150):
        k, (back, turned) = r.randrange(len(names)), r.choice(E.READINGS)
        rows = [("".join(r.choices("0123456789", k=2)), "".join(r.choices("0123456789", k=2))) for _ in range(4)]
        xs, ys = ([v[::-1] if back else v for v in side] for side in zip(*rows, strict=True))
        results = E.holds(xs, ys, ["0"] * 4)[1][0][k]
        if not results[3].all():
            continue
        outs = [E._flip(t) if turned else t for t in E._texts(*results[:3])]
        examples = [(f"{a}#{b}", o) for (a, b), o in zip(rows, outs, strict=True)]
        answer, rule = E.solve_batch([(examples, f"{rows[0][0]}#{rows[0][1]}")])[0]
        assert answer == outs[0] or "-" in outs[0]
        table = E.holds([a for a, _ in rows], [b for _, b in rows], outs)[0].all(axis=0)
        at = [n for n, (op, reading) in enumerate(E._ORDER) if table[op, reading]][0]
        op, reading = E._ORDER[at]
        assert rule.endswith(names[op]) and ("reversed operands" in rule, "reversed result" in rule) == E.READINGS[reading]


def test_numbers_of_any_length():
    a, b = "123456789012345678901234567890", "987654321098765432109876543210"
    examples = [(f"{a}*{b}", str(int(a) * int(b))), (f"{b}*12", str(int(b) * 12))]
    assert E.solve_batch([(examples, f"{a}*3")])[0] == (str(int(a) * 3), "multiplication")


# --- ciphers and numerals -------------------------------------------------------------------------


def test_ciphers_against_the_model(spark):
    r, rows = random.Random(5), []
    letters = "abcdefghijklmnopqrstuvwxyz"
    for i in range(300):
        key = dict(zip(letters, r.sample(letters, 26), strict=True))
        said = lambda n, key=key: " ".join(r.choice(WORD_LIST) for _ in range(n))
        secret = lambda t, key=key: "".join(key.get(c, c) for c in t)
        examples = [(secret(p) + (" x" if r.random() < 0.1 else ""), p) for p in (said(r.randrange(1, 4)) for _ in range(r.randrange(0, 4)))]
        rows.append((i, examples, r.choice(["", "  "]) + secret(said(r.randrange(1, 4)))))
    rows += [(900, [], ""), (901, [("a", "b")], "a"), (902, [("a", "b")], "q")]
    got = {x.i: x.s for x in spark.createDataFrame(rows, f"i int, {EXAMPLES}, question string").select("i", W.solve_cipher("examples", "question").alias("s")).collect()}
    for i, examples, question in rows:
        assert (None if got[i] is None else (got[i].answer, got[i].rule)) == M.solve_cipher(examples, question)
    assert [tuple(s) for s in got[901].steps] == [("letter", "a", "b"), ("word", "a", "b")]
    assert sum(s is not None for s in got.values()) > 200


def test_cipher_plan_has_no_python(spark):
    df = spark.createDataFrame([([("a", "b")], "a", "cipher")], f"{EXAMPLES}, question string, task_type string")
    plan = R.worded(df)._jdf.queryExecution().executedPlan().toString()
    assert "Arrow" not in plan and "Python" not in plan


def test_numerals_against_the_model(spark):
    numbers = [str(n) for n in [*range(1, 4000, 13), 0, 12345]] + ["", "x", "1.5"]
    for x in spark.createDataFrame([(n,) for n in numbers], "q string").select("q", W.solve_numeral("q").alias("s")).collect():
        assert (None if x.s is None else (x.s.answer, x.s.rule)) == M.solve_numeral([], x.q)
        assert x.s is None or [(s.input, s.output) for s in x.s.steps] == [(str(n), s) for n, _, s in M.roman(int(x.q))]


# --- long arithmetic ------------------------------------------------------------------------------


def shown(v, places):
    digits = str(abs(v)).rjust(places + 1, "0")
    whole, rest = (digits[:-places], "." + digits[-places:]) if places else (digits, "")
    return ("-" + ("" if whole == "0" and places else whole) if v < 0 else whole) + rest


def places_of(t):
    return len(t.partition(".")[2])


def model_product(a, b):
    x, y, n = int(a.replace(".", "")), int(b.replace(".", "")), places_of(a) + places_of(b)
    parts = [int(c) * 10**k for k, c in enumerate(reversed(str(abs(y)))) if c != "0"]
    lines = [f"{a} * {shown(p, places_of(b))} = {shown(x * p, n)}" for p in parts]
    lines += [f"{shown(x * sum(parts[:k]), n)} + {shown(x * parts[k], n)} = {shown(x * sum(parts[: k + 1]), n)}" for k in range(1, len(parts))]
    return shown(x * y, n), lines


def model_quotient(a, b, places=3):
    n = max(places_of(a), places_of(b))
    x, y = (int(t.replace(".", "")) * 10 ** (n - places_of(t)) for t in (a, b))
    lines, had = [], 0
    for k in range(places + 1):
        if k:
            x, had = x * 10, had * 10
        lines.append(f"= {shown(had, k)} + {shown(1, k) if k else '1'} * {x} / {y}")
        while x >= y:
            x, had = x - y, had + 1
            lines.append(f"= {shown(had, k)} + {shown(1, k) if k else '1'} * {x} / {y}")
    return shown(had, places), lines


def numbers(r, n):
    for _ in range(n):
        t = str(r.randrange(10 ** r.choice([1, 2, 4, 9, 10, 18, 19, 40])))
        yield ("0" if r.random() < 0.1 else "") + t + ("." + "".join(r.choices("0123456789", k=r.choice([1, 2, 3, 8]))) if r.random() < 0.6 else "")


def test_products_and_quotients_of_any_length(spark):
    r = random.Random(6)
    rows = [(a, b) for a, b in zip(numbers(r, 300), numbers(r, 300), strict=True)]
    rows = [("-" + a if r.random() < 0.2 else a, "-" + b if r.random() < 0.2 else b) for a, b in rows]
    df = spark.createDataFrame(rows, "a string, b string")
    for x in df.withColumn("p", L.product("a", "b")).select("a", "b", "p", L.product_lines("a", F.col("p")).alias("l")).collect():
        assert (x.p.result, x.l) == model_product(x.a, x.b)
    pairs = [(a.lstrip("-"), b.lstrip("-")) for a, b in rows]
    pairs = [(a, b) for a, b in pairs if float(b) and float(a) / float(b) < 300]
    for x in spark.createDataFrame(pairs, "a string, b string").withColumn("q", L.quotient("a", "b")).select("a", "b", "q", L.quotient_lines(F.col("q")).alias("l")).collect():
        assert (x.q.result, x.l) == model_quotient(x.a, x.b)
    none = spark.createDataFrame([("1", "0"), ("1", "0.00"), ("-1", "2"), ("1", "-2"), ("x", "1"), (None, "1"), ("", "1")], "a string, b string")
    assert all(x.q is None for x in none.select(L.quotient("a", "b").alias("q")).collect())
    assert [x.p is None for x in none.select(L.product("a", "b").alias("p")).collect()] == [False, False, False, False, True, True, True]


def written(df, path):
    df.write.parquet(str(path))
    return sum(f.stat().st_size for f in path.glob("*.parquet"))


def test_copies_of_order_lines_add_little_to_the_quotients_disk(spark, tmp_path):
    def quotients(copies):
        line, d = F.col("id") % 1500, tmp_path / str(copies)
        rows = spark.range(0, 1500 * copies, 1, 1).select(
            F.col("id").alias("l_orderkey"), F.lit(1).alias("l_linenumber"), ((line * 7919 * 7919) % 10_000_000 / 100 + 900).alias("l_extendedprice"), (line % 50 + 1).cast("double").alias("l_quantity"), (line % 11 / 100).alias("l_discount")
        )
        rows.unionByName(rows.limit(1).withColumns({"l_orderkey": F.lit(-1).cast("bigint"), "l_extendedprice": F.lit(None).cast("double")})).write.parquet(f"{d}/lineitem.parquet")
        return arithmetic_queries.long_quotients(spark, str(d))

    one, eight = written(quotients(1), tmp_path / "one"), written(quotients(8), tmp_path / "eight")
    rows = spark.read.parquet(str(tmp_path / "eight")).collect()
    assert sorted(x.l_orderkey for x in rows) == list(range(-1, 12_000))
    for x in rows:
        assert (x.a, x.b, x.result, x.lines) == (None,) * 4 if x.l_orderkey < 0 else (x.result, x.lines.split("\n")) == model_quotient(x.a, x.b)
    assert eight < 3 * one


def order_lines(spark, rows, d):
    spark.createDataFrame(rows, "l_orderkey bigint, l_linenumber int, l_extendedprice double, l_quantity double, l_discount double").write.parquet(f"{d}/lineitem.parquet")
    return arithmetic_queries.long_quotients(spark, str(d))


def test_quotients_of_short_numbers_are_those_of_texts(spark, tmp_path):
    """Prices from nothing to over 64 bits, below nothing and unknown; whole parts of up to 200 and so beyond LINES."""
    r = random.Random(8)
    prices = [0.0, 0.01, 0.02, 0.09, 1.0, 9.99, 900.0, 104949.5, 1e12, 999999999999999.0, 1e16, 9e16, -0.01, -3.5, None, *(r.randrange(1, 10**7) / 100 for _ in range(150))]
    rows = [(i, 1, p, r.choice([0.0, 1.0, 2.0, 49.0, 50.0, 63.0, 64.0, 65.0, 200.0]), r.randrange(11) / 100) for i, p in enumerate(prices)]
    shown = order_lines(spark, rows, tmp_path).collect()
    texts = spark.createDataFrame([(x.l_orderkey, x.a, x.b) for x in shown], "k bigint, a string, b string").withColumn("q", L.quotient("a", "b")).withColumn("l", L.quotient_lines(F.col("q")))
    want = {x.k: (x.result, x.n, x.lines) for x in texts.select("k", "q.result", F.size("l").alias("n"), F.array_join("l", "\n").alias("lines")).collect()}
    assert len(shown) == len(rows) and {x.l_orderkey: (x.result, x.n_lines, x.lines) for x in shown} == want
    assert max(x.n_lines or 0 for x in shown) > L.LINES + 40 and sum(x.result is None for x in shown) == 3
    assert all((x.result, x.lines.split("\n")) == model_quotient(x.a, x.b) for x in shown if x.result)


def test_quotients_of_short_numbers_take_less_than_half_the_time_of_texts(spark, tmp_path):
    fast = order_lines(spark, [(i, 1, 900 + i * 7919 % 100_000 + i % 100 / 100, i % 50 + 1.0, i % 11 / 100) for i in range(8_000)], tmp_path)
    slow = fast.select("a", "b").withColumn("q", L.quotient("a", "b")).withColumn("l", L.quotient_lines(F.col("q"))).select("q.result", F.array_join("l", "\n").alias("lines"))

    def seconds(df):
        began = time.perf_counter()
        df.write.format("noop").mode("overwrite").save()
        return time.perf_counter() - began

    assert all(seconds(df) for df in (slow, fast, fast))  # compiled
    assert 2 * min(seconds(fast) for _ in range(3)) < min(seconds(slow) for _ in range(2))


def cut(t):
    return re.sub(r"(\.\d{3})\d+$", r"\1", t)


def padded(a, b):
    n = max(places_of(a), places_of(b))
    return [(t if "." in t else t + ".") + "0" * (n - places_of(t)) for t in (a, b)]


def test_physics_on_paper(spark):
    units = [("12.5", "30.00"), ("7", "16.8"), ("0", "1"), ("3.25", "7.8251"), ("2.0", "4.9")]
    falls = [("1.5", "11.03"), ("2.0", "19.62"), ("0", "0"), ("3", "44.145")]
    df = spark.createDataFrame([("u", units, "25.1"), ("v", units[2:3], "1"), ("w", [("1", "2")], "3"), ("x", [("1", "two")], "3")], f"id string, {EXAMPLES}, question string")
    got = {r.id: r for r in Lt.solve(df, False).collect()}
    factors = [model_quotient(*padded(cut(o), cut(i)))[0] for i, o in units if float(i)]
    middle = sorted(factors, key=lambda t: (float(t), t))[(len(factors) - 1) // 2]
    bare = re.sub(r"\.$", "", re.sub("0+$", "", middle))
    product, lines = model_product("25.1", bare)
    assert [f.factor for f in got["u"].factors] == factors and (got["u"].median, got["u"].product, got["u"].answer) == (bare, product, cut(product))
    divided = [s.output for s in got["u"].steps if s.step == "divide"]
    assert divided == [x for i, o in units if float(i) for x in model_quotient(*padded(cut(o), cut(i)))[1]]
    assert [s.output for s in got["u"].steps if s.step == "multiply"] == lines
    assert got["v"].factors is None and got["v"].steps is None and got["x"].answer is None
    assert (got["w"].product, got["w"].answer) == ("6", None)  # no point, no places to cut at

    r = Lt.solve(spark.createDataFrame([("g", falls, "2.5")], f"id string, {EXAMPLES}, question string"), True).first()
    squares = ["2.25", "4.0", "9.0"]
    assert [f.squared for f in r.factors] == squares
    factors = [model_quotient(*padded(cut(o), s))[0] for (_, o), s in zip([falls[0], falls[1], falls[3]], squares, strict=True)]
    middle = re.sub(r"\.$", "", re.sub("0+$", "", sorted(factors, key=float)[1]))
    assert (r.median, r.product) == (middle, model_product(middle, "6.25")[0])
    assert [s.output for s in r.steps if s.step == "multiply"][-len(model_product(middle, "6.25")[1]) :] == model_product(middle, "6.25")[1]


# --- steps and traces -----------------------------------------------------------------------------


def test_steps_and_traces_say_what_was_done(spark):
    shift = lambda t: t.translate(str.maketrans("abcdefghijklmnopqrstuvwxyz", "bcdefghijklmnopqrstuvwxyza"))
    bits = [(f"{x:08b}", f"{x << 1 & 254 | x >> 7:08b}") for x in (3, 77, 130, 201, 9, 64, 255, 18)]
    rows = [
        ("b", "bit_manipulation", bits, "00000101", "00001010"), ("n", "numeral", [("1", "I")], "61", "LXI"), ("c", "cipher", [(shift("the cat reads"), "the cat reads")], shift("the cat"), "the cat"),
        ("s", "symbolic_transform", [("17+35", "52"), ("58+14", "72")], "20+22", "42"), ("g", "gravity", [("1", "4.9"), ("2", "19.6")], "3", "44.10"), ("u", "unit_conversion", [("2", "3.0")], "10", "15.00"),
        ("z", "unknown", [("2", "3.0")], "10", "15.00"), (None, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, f"pid string, task_type string, {EXAMPLES}, question string, gold string")
    out = {r.pid: r for r in R.reason(df).select("*", *[R.trace(v).alias(f"t{v}") for v in (1, 2, 3)]).collect()}
    assert [out[p].ok for p in "bncsgu"] == [True] * 6 and out["z"].error == out[None].error == "missing_reasoner"
    assert [tuple(s) for s in out["n"].steps] == [("take", "61", "L"), ("take", "11", "X"), ("take", "1", "I")]
    assert ("letter", "u", "t") in [tuple(s) for s in out["c"].steps] and ("word", "dbu", "cat") in [tuple(s) for s in out["c"].steps]
    assert [s.step for s in out["b"].steps] == [f"b{k}" for k in range(8)] and "".join(s.output for s in out["b"].steps) == "00001010"
    assert [tuple(s) for s in out["s"].steps] == [("operation", "addition", "42")]
    assert out["g"].intermediates == pytest.approx({"value_1": 9.8, "value_2": 9.8, "coefficient": 9.8, "predicted": 44.1}) and out["n"].intermediates == {"number": 61.0, "symbols": 3.0}
    assert "u→t" in out["c"].t2 and "u→t" in out["c"].t3 and "u→t" not in out["c"].t1
    assert "61 gives L, 11 gives X, 1 gives I" in out["n"].t2 and "61 >= 50 -> L, rem 11" in out["n"].t3
    assert all("b0:I1" in out["b"][f"t{v}"] for v in (1, 2, 3)) and "addition" in out["s"].t1 and "9.8" in out["g"].t3
    assert all(out["z"][f"t{v}"] is None for v in (1, 2, 3))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 255), st.integers(0, 255)), min_size=1, max_size=6), st.integers(0, 255))
def test_any_bits_are_answered_or_not(pairs, asked):
    found = B.solve_batch([([(f"{x:08b}", f"{y:08b}") for x, y in pairs], f"{asked:08b}")])[0]
    assert found is None or re.fullmatch(r"[01]{8}", found[0])
