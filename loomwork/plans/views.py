"""Derived inputs: rule-induction problems, defective ones, predictions and thinking texts, from the driver's tables.

All arithmetic is on integers, so Spark and the SQL of the oracles print the same digits. No randomness.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomwork.functions import grammar as G
from loomwork.functions.session import settle
from loomwork.plans.registry import table

_ALPHA = "abcdefghijklmnopqrstuvwxyz"
_ROMAN = (("", "M", "MM", "MMM"), ("", "C", "CC", "CCC", "CD", "D", "DC", "DCC", "DCCC", "CM"), ("", "X", "XX", "XXX", "XL", "L", "LX", "LXX", "LXXX", "XC"), ("", "I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX"))


def _roman_sql(n: str, div: str, pick: str) -> str:
    parts = []
    for k, symbols in zip((1000, 100, 10, 1), _ROMAN, strict=True):
        arr = "(" + ", ".join(f"'{s}'" for s in symbols) + ")"
        parts.append(pick.format(arr=arr[1:-1], i=f"(({n} {div} {k}) % 10) + 1"))
    return " || ".join(parts)


def _sql(engine: str) -> str:
    """The problems view as SQL. Both engines share the text but for integer division, arrays, lambdas and bits."""
    spark = engine == "spark"
    div = "div" if spark else "//"
    pick = "element_at(array({arr}), cast({i} as int))" if spark else "([{arr}])[({i})::INT]"
    each = (lambda hi, body: f"transform(sequence(1, {hi}), i -> {body})") if spark else (lambda hi, body: f"[{body} for i in generate_series(1, {hi})]")
    joined = (lambda a: f"array_join({a}, '\\n')") if spark else (lambda a: f"array_to_string({a}, chr(10))")
    nl = "'\\n'" if spark else "chr(10)"
    text = (lambda e: f"cast({e} as string)") if spark else (lambda e: f"({e})::VARCHAR")
    bits = lambda e: f"lpad(bin({e}), 8, '0')"
    xor = (lambda e: f"({e} ^ 170)") if spark else (lambda e: f"xor({e}, 170)")
    cents = lambda c: f"{text(f'({c}) {div} 100')} || '.' || lpad({text(f'({c}) % 100')}, 2, '0')"
    tenths = lambda c: f"{text(f'({c}) {div} 10')} || '.' || {text(f'({c}) % 10')}"

    def rule(x: str) -> str:
        forms = [f"255 - {x}", f"(({x} * 2) % 256) + ({x} {div} 128)", f"({x} {div} 2) + ({x} % 2) * 128", xor(x), f"{x} % 16", f"({x} * 2) % 256", f"{x} {div} 2", f"({x} | 192)"]
        return "CASE s % 8 " + " ".join(f"WHEN {k} THEN {f}" for k, f in enumerate(forms)) + " END"

    bit_in = lambda i: f"((k * 37 + {i} * 61) % 256)"
    t_of = lambda i: f"(10 + {i} * 5)"
    d_of = lambda t: f"(((50 + k % 100) * {t} * {t} + 10) {div} 20)"
    x_of = lambda i: f"(30 + {i} * 25)"
    u_of = lambda x: f"(((50 + k % 300) * {x} + 5) {div} 10)"
    n_of = lambda i: f"((k * 7 + {i} * 113) % 3999 + 1)"
    words = ", ".join(f"'{w}'" for w in G.WORD_LIST)
    word = lambda i, j: pick.format(arr=words, i=f"((k + {i} * 5 + {j} * 11) % {len(G.WORD_LIST)}) + 1")
    phrase = lambda i: f"{word(i, 1)} || ' ' || {word(i, 2)} || ' ' || {word(i, 3)}"
    secret = lambda p: f"translate({p}, '{_ALPHA}', substr('{_ALPHA}{_ALPHA}', cast(s % 25 + 2 as int), 26))"
    ab = lambda i: f"{text(f'10 + (k + {i} * 17) % 90')} || '|' || {text(f'10 + (k + {i} * 29) % 90')}"
    cd = lambda i: f"{text(f'10 + (k + {i} * 17) % 90')} || {text(f'10 + (k + {i} * 29) % 90')}"
    q = lambda s: s.replace("'", "\\'" if spark else "''")
    prefix = {t: f"'{q(p)}'" for t, p in G.PREFIXES.items()}
    parts = {
        "bit_manipulation": (f"{prefix['bit_manipulation']} || {nl} || '{G.BIT_HEADER}'", each(8, f"{bits(bit_in('i'))} || ' -> ' || {bits(rule(bit_in('i')))}"), f"'Now, determine the output for: ' || {bits(bit_in('0'))}", bits(rule(bit_in("0"))), bits(bit_in("0"))),
        "gravity": (prefix["gravity"], each(4, f"'For t = ' || {tenths(t_of('i'))} || 's, distance = ' || {cents(d_of(t_of('i')))} || ' m'"), f"'Now, determine the falling distance for t = ' || {tenths(t_of('7'))} || 's given d = 0.5*g*t^2.'", cents(d_of(t_of("7"))), tenths(t_of("7"))),
        "unit_conversion": (prefix["unit_conversion"], each(4, f"{tenths(x_of('i'))} || ' m becomes ' || {cents(u_of(x_of('i')))}"), f"'Now, convert the following measurement: ' || {tenths(x_of('9'))} || ' m'", cents(u_of(x_of("9"))), tenths(x_of("9"))),
        "numeral": (prefix["numeral"], each(4, f"{text(n_of('i'))} || ' -> ' || {_roman_sql(n_of('i'), div, pick)}"), f"'Now, write the number ' || {text(n_of('0'))} || ' in the Wonderland numeral system.'", _roman_sql(n_of("0"), div, pick), text(n_of("0"))),
        "cipher": (prefix["cipher"], each(5, f"{secret(phrase('i'))} || ' -> ' || {phrase('i')}"), f"'Now, decrypt the following text: ' || {secret(phrase('2'))}", phrase("2"), secret(phrase("2"))),
        "symbolic_transform": (prefix["symbolic_transform"], each(4, f"{ab('i')} || ' = ' || {cd('i')}"), f"'Now, determine the result for: ' || {ab('0')}", cd("0"), ab("0")),
    }
    case = lambda f: "CASE k % 6 " + " ".join(f"WHEN {n} THEN {f(parts[t])}" for n, t in enumerate(G.TASKS)) + " END"
    names = "CASE k % 6 " + " ".join(f"WHEN {n} THEN '{t}'" for n, t in enumerate(G.TASKS)) + " END"
    hexed = "lpad(lower(hex(p_partkey)), 8, '0')" if spark else "lpad(lower(to_hex(p_partkey)), 8, '0')"
    base = f"(SELECT cast(p_partkey AS bigint) AS k, cast(p_size AS bigint) AS s, {hexed} AS pid FROM part)"
    return f"""SELECT pid, {names} AS task_type, {case(lambda p: p[4])} AS question, {case(lambda p: p[3])} AS answer,
        {case(lambda p: f"{p[0]} || {nl} || {joined(p[1])} || {nl} || {nl} || {p[2]}")} AS prompt, k AS _ord FROM {base}"""


PROBLEMS = f"problems AS ({_sql('duckdb')})"
_BAD = {
    0: "replace(prompt, 'Wonderland', 'Underland')",
    1: "replace(prompt, 'Here are some examples of input', 'Some inputs')",
    2: "prompt || {nl} || 'Now, once more: 1'",
    3: "replace(prompt, 'Now,', 'Then,')",
    4: "replace(replace(prompt, ' -> ', ' => '), ' becomes ', ' is ')",
    5: "replace(prompt, 'Now, ', 'Now, please ')",
    6: "''",
}


def _bad(engine: str) -> str:
    nl = "'\\n'" if engine == "spark" else "chr(10)"
    cases = " ".join(f"WHEN {k} THEN {e.format(nl=nl)}" for k, e in _BAD.items())
    return f"SELECT pid, task_type, question, CASE _ord % 9 WHEN 7 THEN answer || ' x' WHEN 8 THEN answer ELSE answer END AS answer, CASE _ord % 9 {cases} ELSE prompt END AS prompt, _ord FROM problems"


PROBLEMS_BAD = f"{PROBLEMS}, problems_bad AS ({_bad('duckdb')})"


def problems(spark: SparkSession, d: str) -> DataFrame:
    # Settled, as a table of prompts would be: else every use of a prompt repeats the expression that prints it.
    return settle(spark.sql(_sql("spark").replace("FROM part)", "FROM {part})"), part=table(spark, d, "part")))


def problems_bad(spark: SparkSession, d: str) -> DataFrame:
    return spark.sql(_bad("spark").replace("FROM problems", "FROM {problems}"), problems=problems(spark, d))


def _prediction(engine: str) -> str:
    nl = "'\\n'" if engine == "spark" else "chr(10)"
    return f"""SELECT pid, task_type, answer AS gold, question, prompt, _ord, CASE (_ord {'div' if engine == 'spark' else '//'} 6) % 8 WHEN 0 THEN answer WHEN 1 THEN 'Answer: ' || answer
        WHEN 2 THEN lower(answer) || '0' WHEN 3 THEN 'Let me see.' || {nl} || 'Final answer: ' || answer WHEN 4 THEN 'not-a-number ?' WHEN 5 THEN '' WHEN 6 THEN '  ' || lower(answer) || '  ' ELSE answer || {nl} || 'and more' END AS prediction_raw,
        CASE WHEN _ord % 5 = 0 THEN 'max_tokens' WHEN _ord % 5 = 1 THEN 'endoftext' ELSE 'im_end' END AS stop_reason, 10 + _ord % 300 AS generated_tokens FROM problems"""


PREDICTIONS = f"{PROBLEMS}, predictions AS ({_prediction('duckdb')})"


def predictions(spark: SparkSession, d: str) -> DataFrame:
    return spark.sql(_prediction("spark").replace("FROM problems", "FROM {problems}"), problems=problems(spark, d))


def _thinking(engine: str) -> str:
    nl = "'\\n'" if engine == "spark" else "chr(10)"
    ok = f"'<think>' || {nl} || 'g = 2*d/t^2 and ratio ' || question || {nl} || '</think>' || {nl} || {nl} || answer"
    kinds = [ok, f"'reason </think>' || answer", f"'<think> reason ' || answer", f"'<think> a <think> b </think> ' || answer", f"'</think> a <think> ' || answer", f"'<think> </think> ' || answer", "'<think> reason </think>  '", f"'<think> reason </think> ' || answer || {nl} || answer", "answer"]
    return f"SELECT pid, task_type, answer, question, _ord, CASE _ord % 9 {' '.join(f'WHEN {k} THEN {e}' for k, e in enumerate(kinds))} END AS assistant, _ord % 4 <> 3 AS wants_think FROM problems"


THINKING = f"{PROBLEMS}, thinking AS ({_thinking('duckdb')})"


def thinking(spark: SparkSession, d: str) -> DataFrame:
    return spark.sql(_thinking("spark").replace("FROM problems", "FROM {problems}"), problems=problems(spark, d))
