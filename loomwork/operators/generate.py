"""Rule-based rows from a seed: nine strict and seven thinking categories.

Every draw is SHA-256 of "seed:category:id:number", so a row depends on these alone. Generators are SQL
expressions over draws d0 to d7 (32-bit numbers) that both Spark and the oracle's engine read; ``sql`` prints them for
either.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.functions.text import prompt_hash
from loomwork.operators.chat import with_rank

NL = "chr(10)"
CLOSE = "</think>"


def _pick(d: str, values: list[str]) -> str:
    return f"CASE {d} % {len(values)} " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in enumerate(values)) + " END"


def _n(d: str, low: int, high: int) -> str:
    return f"({low} + {d} % {high - low + 1})"


def _t(e: str) -> str:
    return f"cast({e} as string)"


def _b(e: str) -> str:
    return f"lpad(bin({e}), 8, '0')"


def _rule(x: str, xor: str) -> str:
    """An 8-bit rule of draw d0 with amount a = 1 + d1 % 3 and mask m = d2 % 256, over numbers."""
    power = "(CASE d1 % 3 WHEN 0 THEN 2 WHEN 1 THEN 4 ELSE 8 END)"
    down = f"cast(floor({x} / {power}) as bigint)"
    up = f"({x} * {power})"
    wrap = f"cast(floor({x} * {power} / 256) as bigint)"
    return f"""(CASE d0 % 8 WHEN 0 THEN 255 - {x} WHEN 1 THEN {up} % 256 + {wrap} WHEN 2 THEN {down} + ({x} % {power}) * cast(256 / {power} as bigint) WHEN 3 THEN {xor.format(x, '(d2 % 256)')}
        WHEN 4 THEN {x} & (d2 % 256) WHEN 5 THEN {x} | (d2 % 256) WHEN 6 THEN {up} % 256 ELSE {down} END)"""


_RULE_NAME = f"""(CASE d0 % 8 WHEN 0 THEN 'bitwise_not' WHEN 1 THEN 'rotate_left_' || {_t('1 + d1 % 3')} WHEN 2 THEN 'rotate_right_' || {_t('1 + d1 % 3')} WHEN 3 THEN 'xor_' || {_b('d2 % 256')}
    WHEN 4 THEN 'and_' || {_b('d2 % 256')} WHEN 5 THEN 'or_' || {_b('d2 % 256')} WHEN 6 THEN 'shift_left_' || {_t('1 + d1 % 3')} ELSE 'shift_right_' || {_t('1 + d1 % 3')} END)"""
_X = "(d3 % 256)"
_EXAMPLE = lambda i, xor: f"{_b(f'((d3 + {37 * i}) % 256)')} || ' -> ' || {_b(_rule(f'((d3 + {37 * i}) % 256)', xor))}"
_MOODS = {"negative": ["The parcel came late and torn.", "I waited an hour for a wrong answer."], "neutral": ["The shop opens at nine.", "The box holds six pens."], "positive": ["The staff were kind and quick.", "This lamp is a joy to use."]}
_MOOD = _pick("d0", sorted(_MOODS))
_MOOD_TEXT = "CASE d0 % 3 " + " ".join(f"WHEN {k} THEN {_pick('d1', _MOODS[m])}" for k, m in enumerate(sorted(_MOODS))) + " END"
_A, _B, _C = _n("d1", 2, 60), _n("d2", 2, 60), _n("d3", 2, 9)


def _strict(xor: str) -> dict[str, tuple[str, str]]:
    """category -> (user, assistant)."""
    word = _pick("d1", ["OK", "DONE", "READY", "YES", "PASS", "GREEN", "42"])
    json_key, json_value = _pick("d0", ["sum", "answer", "label", "binary"]), f"CASE d0 % 4 WHEN 0 THEN {_t(_n('d1', 0, 40))} WHEN 1 THEN {_pick('d1', ['\"yes\"', '\"no\"'])} WHEN 2 THEN {_pick('d1', ['\"negative\"', '\"neutral\"', '\"positive\"'])} ELSE '\"' || {_b('d1 % 256')} || '\"' END"
    question = f"CASE d0 % 4 WHEN 0 THEN 'Is ' || {_t(_A)} || ' greater than ' || {_t(_B)} || '?' WHEN 1 THEN 'Is ' || {_t(_A)} || ' less than ' || {_t(_B)} || '?' WHEN 2 THEN 'Is ' || {_t(_A)} || ' an even number?' ELSE 'Is ' || {_t(_A)} || ' divisible by ' || {_t(_C)} || '?' END"
    verdict = f"CASE WHEN (d0 % 4 = 0 AND {_A} > {_B}) OR (d0 % 4 = 1 AND {_A} < {_B}) OR (d0 % 4 = 2 AND {_A} % 2 = 0) OR (d0 % 4 = 3 AND {_A} % {_C} = 0) THEN 'yes' ELSE 'no' END"
    value = f"CASE d0 % 3 WHEN 0 THEN {_pick('d1', ['mira', 'theo', 'rosa', 'eli'])} || {_t(_n('d2', 10, 99))} || '@' || {_pick('d3', ['example.com', 'sample.org'])} WHEN 1 THEN 'ORD-' || {_t(_n('d1', 100000, 999999))} ELSE '2026-' || lpad({_t(_n('d1', 1, 12))}, 2, '0') || '-' || lpad({_t(_n('d2', 1, 28))}, 2, '0') END"
    what = _pick("d0", ["e-mail address", "order number", "date"])
    colours = [["Red", "Blue"], ["Green", "Black"], ["White", "Grey"]]
    return {
        "exact_output": (f"'Reply with ' || {word} || ' and nothing else.'", word),
        "binary_only": (f"'Print the bits ' || {_b('d1 % 256')} || '. No other text.'", _b("d1 % 256")),
        "wonderland_like_binary": (f"'One 8-bit rule made these:' || {NL} || " + f" || {NL} || ".join(_EXAMPLE(i, xor) for i in range(1, 5)) + f" || {NL} || 'What does it make of ' || {_b(_X)} || '? Only the bits.'", _b(_rule(_X, xor))),
        "json_only": (f"'Give JSON alone, with key \"' || {json_key} || '\" and value ' || {json_value} || '.'", f"'{{\"' || {json_key} || '\":' || {json_value} || '}}'"),
        "yes_no": (f"{question} || ' Only yes or no.'", verdict),
        "classification": (f"'Name the mood: positive, negative or neutral.' || {NL} || {_MOOD_TEXT}", _MOOD),
        "extraction": (f"'Copy out the ' || {what} || ' alone: We noted ' || {value} || ' on the form.'", value),
        "line_count": ("'Write two colours, one a line.' || ' (' || " + _t("d1 % 1000") + " || ')'", "CASE d0 % 3 " + " ".join(f"WHEN {k} THEN '{a}' || {NL} || '{b}'" for k, (a, b) in enumerate(colours)) + " END"),
        "stop_behavior": (f"'Say ' || {word} || ', then stop.'", word),
    }


def _thinking(xor: str) -> dict[str, tuple[str, str, str]]:
    """category -> (user, reasoning, final answer)."""
    ask = f" || ' Think briefly; after {CLOSE} give only the result.'"
    op = _pick("d0", ["+", "-", "*"])
    math = f"(CASE d0 % 3 WHEN 0 THEN {_A} + {_B} WHEN 1 THEN {_A} - {_B} ELSE {_A} * {_B} END)"
    other = f"(CASE WHEN {_A} = {_B} THEN {_B} + 1 ELSE {_B} END)"
    big, small = f"greatest({_A}, {other})", f"least({_A}, {other})"
    total, limit = f"({_A} + {_B})", _n("d3", 20, 100)
    over = f"CASE WHEN {total} > {limit} THEN 'yes' ELSE 'no' END"
    bits, result = _b(_X), _b(_rule(_X, xor))
    return {
        "simple_math_thinking": (f"'What is ' || {_t(_A)} || ' ' || {op} || ' ' || {_t(_B)} || '?'" + ask, f"{_t(_A)} || ' ' || {op} || ' ' || {_t(_B)} || ' = ' || {_t(math)} || '.'", _t(math)),
        "comparison_thinking": (f"'Which is more, ' || {_t(_A)} || ' or ' || {_t(other)} || '?'" + ask, f"{_t(big)} || ' > ' || {_t(small)} || '.'", _t(big)),
        "yes_no_reasoning_thinking": (f"'Is ' || {_t(_A)} || ' + ' || {_t(_B)} || ' more than ' || {_t(limit)} || '?'" + ask, f"'The sum is ' || {_t(total)} || ', against ' || {_t(limit)} || '.'", over),
        "binary_operation_thinking": (f"'Apply ' || {_RULE_NAME} || ' to ' || {bits} || '.'" + ask, f"{_RULE_NAME} || ' of ' || {bits} || ' is ' || {result} || '.'", result),
        "json_final_thinking": (f"'Add ' || {_t(_A)} || ' and ' || {_t(_B)} || '; answer as JSON with key \"sum\".'" + ask, f"{_t(_A)} || ' + ' || {_t(_B)} || ' = ' || {_t(total)} || '.'", f"'{{\"sum\":' || {_t(total)} || '}}'"),
        "classification_thinking": (f"'Is this positive, negative or neutral? ' || {_MOOD_TEXT}" + ask, f"'The text reads as ' || {_MOOD} || '.'", _MOOD),
        "wonderland_like_binary_thinking": (f"'A hidden 8-bit rule:' || {NL} || " + f" || {NL} || ".join(_EXAMPLE(i, xor) for i in range(1, 5)) + f" || {NL} || 'Now ' || {bits} || '.'" + ask, f"'The rule is ' || {_RULE_NAME} || '; it gives ' || {result} || '.'", result),
    }


STRICT, THINKING = tuple(_strict("{0}")), tuple(_thinking("{0}"))
_PATTERNS = {"binary_only": "[01]{8}", "wonderland_like_binary": "[01]{8}"}


def sql(category: str, ids: str, seed: int, engine: str) -> str:
    """id, category, user, reasoning, answer as SQL over a relation with column id."""
    spark = engine == "spark"
    xor = "({0} ^ {1})" if spark else "xor({0}, {1})"
    drawn = lambda k: f"'{seed}:{category}:' || cast(id as string) || ':{k}'"
    draws = ", ".join(f"cast(conv(substr(sha2({drawn(k)}, 256), 1, 8), 16, 10) as bigint) AS d{k}" if spark else f"('0x' || substr(sha256({drawn(k)}), 1, 8))::BIGINT AS d{k}" for k in range(5))
    user, *rest = _strict(xor)[category] if category in STRICT else _thinking(xor)[category]
    reasoning, answer = rest if len(rest) == 2 else ("cast(NULL as string)", rest[0])
    return f"SELECT id, '{category}' AS category, {user} AS user, {reasoning} AS reasoning, {answer} AS answer FROM (SELECT id, {draws} FROM {ids})"


def generate(spark: SparkSession, category: str, n: int | DataFrame, seed: int = 42) -> DataFrame:
    """n rows, or a row for each id of a table; strict ones carry the validator that accepts their answer. A row depends on its id, category and seed alone."""
    text = sql(category, "@ids", seed, "spark").replace("{", "{{").replace("}", "}}").replace("@ids", "{ids}")
    df = spark.sql(text, ids=spark.range(n) if isinstance(n, int) else n.select("id"))
    if category not in STRICT:
        return df
    kind = {"json_only": "json", "line_count": "line_count"}.get(category, "regex" if category in _PATTERNS else "exact")
    return df.withColumn("validator", F.struct(F.lit(kind).alias("type"), F.when(F.lit(kind) == "exact", F.col("answer")).alias("value"), F.lit(_PATTERNS.get(category)).alias("pattern"), F.lit(2 if kind == "line_count" else None).cast("int").alias("count")))


def over_generate(spark: SparkSession, category: str, wanted: int, seed: int = 42, factor: int = 25, ids: DataFrame | None = None) -> DataFrame:
    """The first ``wanted`` rows with distinct prompts out of factor times as many draws, or out of a draw for each of the ids."""
    df = generate(spark, category, wanted * factor if ids is None else ids, seed).withColumn("hash", prompt_hash("user"))
    first = df.groupBy("hash").agg(F.min("id").alias("id"))
    return with_rank(df.join(first, ["hash", "id"], "left_semi"), "id").filter(F.col("rank") <= wanted).drop("rank")


def stop_set(spark: SparkSession) -> DataFrame:
    """A handful of literal rows that teach only to stop."""
    words = ("DONE", "OK", "STOP", "READY", "PASS")
    return spark.createDataFrame([(f"stop-{i:05d}", f"Say {w} and stop.", w) for i, w in enumerate(words)], "id string, user string, answer string")
