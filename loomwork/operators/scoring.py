"""Answers, validators, metrics, error classes and flags over a table of predictions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.functions import grammar as G
from loomwork.functions import thinking as Th
from loomwork.functions.text import WS, contains_any, count_fields, decimal_key, fullmatch, lines, normalize_ws, strip

# The answer label and the stop reasons of a finished generation.
LABEL = r"(?i)\A(?:final answer|answer|the answer is):[ \t]*([^\n]*)\z"
STOPPED = ("im_end", "endoftext")
NUMERIC = ("gravity", "unit_conversion")


def candidate(prediction: Column | str) -> Column:
    """struct(candidate, clean, method): the answer that a raw generation offers.

    method is empty, plain, labeled, labeled_with_extra_text or multiline; clean says that nothing else was there.
    """
    p = F.col(prediction) if isinstance(prediction, str) else prediction
    kept = F.filter(F.split(F.regexp_replace(p, "\r\n?", "\n"), "\n"), lambda x: x.rlike(f"[^{WS[1:-1]}]"))
    kept = F.transform(kept, strip)
    labeled = F.filter(kept, lambda x: x.rlike(LABEL))
    n, first = F.size(kept), F.get(kept, F.lit(0))
    value = lambda x: strip(F.regexp_extract(x, LABEL, 1))
    one = F.when(first.rlike(LABEL), value(first)).otherwise(first)
    text = F.nullif(F.when(n == 0, "").when(n == 1, one).when(F.size(labeled) == 1, value(F.get(labeled, F.lit(0)))).otherwise(first), F.lit(""))
    method = F.when(n == 0, "empty").when((n == 1) & first.rlike(LABEL), "labeled").when(n == 1, "plain").when(F.size(labeled) == 1, "labeled_with_extra_text").otherwise("multiline")
    return F.struct(text.alias("candidate"), ((n == 1) & text.isNotNull()).alias("clean"), method.alias("method"))


def evaluate(df: DataFrame, task: str = "task_type", gold: str = "gold", prediction: str = "prediction_raw") -> DataFrame:
    """Adds parsed_answer, extraction_method, parse_error and the five flags of an answer's correctness."""
    df = df.withColumn("__c", candidate(prediction))
    c, t, g = F.col("__c.candidate"), F.col(task), F.col(gold)
    upper, low = F.upper(c), normalize_ws(F.lower(c))
    number = fullmatch(c, r"-?\d+(\.\d+)?")
    parsed = (
        F.when(t.isin(*NUMERIC), number).when(t == "numeral", fullmatch(upper, G.ANSWER["numeral"])).when(t == "cipher", fullmatch(low, G.WORDS))
        .when(t == "bit_manipulation", fullmatch(c, G.ANSWER["bit_manipulation"])).otherwise(fullmatch(c, G.ANSWER["symbolic_transform"]))
    )
    shaped = F.coalesce(*[F.when(t == name, fullmatch(c, p)) for name, p in G.ANSWER.items()])
    same = F.when(t.isin(*NUMERIC), decimal_key(c) == decimal_key(g)).when(t == "numeral", upper == F.upper(g)).when(t == "cipher", low == normalize_ws(F.lower(g))).otherwise(c == g)
    no = lambda x: F.coalesce(x, F.lit(False))
    df = df.withColumns({"parsed_answer": c, "extraction_method": F.col("__c.method"), "parse_success": no(parsed)})
    df = df.withColumn("format_valid", no(F.col("__c.clean") & shaped & F.col("parse_success")))
    df = df.withColumn("normalized_correct", no(F.col("parse_success") & same)).withColumn("strict_correct", no(F.col("format_valid") & (c == g)))
    df = df.withColumn("primary_correct", F.when(t == "gravity", F.col("format_valid") & F.col("normalized_correct")).otherwise(F.col("strict_correct")))
    return df.withColumn("parse_error", F.when(~F.col("parse_success"), F.concat(F.lit("invalid "), F.replace(t, F.lit("_"), F.lit(" ")), F.lit(" answer")))).drop("__c")


def metrics(df: DataFrame, task: str = "task_type") -> DataFrame:
    """Counts and rates of the flags by task and overall ('*'), and the macro mean of primary accuracy in the overall row."""
    flags = ("parse_success", "format_valid", "strict_correct", "normalized_correct", "primary_correct")
    by = df.groupBy(task).agg(F.count("*").alias("n"), *[F.count_if(f).alias(f"n_{f}") for f in flags])
    total = by.agg(F.lit("*").alias(task), F.sum("n").alias("n"), *[F.sum(f"n_{f}").alias(f"n_{f}") for f in flags], F.avg(F.col("n_primary_correct") / F.col("n")).alias("macro"))
    out = by.withColumn("macro", F.lit(None).cast("double")).unionByName(total.filter("n is not null"))
    return out.select(task, "n", *[f"n_{f}" for f in flags], F.round(F.col("n_primary_correct") / F.col("n"), 6).alias("primary_accuracy"), F.round("macro", 6).alias("macro_accuracy"))


def validator_success(v: Column, prediction: Column) -> Column:
    """One instruction validator: exact, regex, line_count or contains; a pattern is the row's own. json is judged by json_success."""
    split = lines(prediction)
    contains = F.coalesce(F.forall(v["values"], lambda x: F.contains(prediction, x)), F.lit(False))
    words_ok = F.coalesce(count_fields(prediction) <= v["max_words"], F.lit(True))
    lines_ok = F.coalesce(F.size(split) <= v["max_lines"], F.lit(True))
    return F.coalesce(
        F.when(v["type"] == "exact", prediction == v["value"])
        .when(v["type"] == "regex", F.when(v["pattern"].isNotNull(), fullmatch(prediction, v["pattern"])))
        .when(v["type"] == "line_count", (F.size(split) == v["count"]) & F.forall(split, lambda x: F.char_length(strip(x)) > 0))
        .when(v["type"] == "contains", contains & words_ok & lines_ok),
        F.lit(False),
    )


def json_success(df: DataFrame, prediction: str, expected: str, out: str) -> DataFrame:
    """Adds out: the prediction is JSON as Python reads it, and equals the expected JSON text where there is one."""
    import json

    @F.pandas_udf("boolean")
    def judged(p: pd.Series, e: pd.Series) -> pd.Series:
        def one(a: str | None, b: str | None) -> bool:
            try:
                got = json.loads(a)
            except (TypeError, ValueError):
                return False
            want = None if b is None else json.loads(b)
            return want is None or got == want

        return pd.Series([one(a, b) for a, b in zip(p, e, strict=True)])

    return df.withColumn(out, judged(prediction, expected))


def instruction_flags(v: Column, success: Column, prediction: Column, stop_reason: Column) -> dict[str, Column]:
    stopped = stop_reason.isin(*STOPPED)
    runs_on = (v["type"] == "exact") & F.startswith(prediction, v["value"]) & (prediction != v["value"])
    return {"instruction_success": success, "format_success": success, "stop_success": stopped, "continuation_failure": ~stopped | F.coalesce(runs_on, F.lit(False))}


def instruction_metrics(df: DataFrame, category: str = "category") -> DataFrame:
    """Counts, accuracy and token figures by category and overall ('*'), in one pass of grouping sets."""
    flags = ("instruction_success", "format_success", "stop_success", "continuation_failure")
    out = df.rollup(category).agg(
        F.count("*").alias("n"), *[F.count_if(f).alias(f"n_{f}") for f in flags], F.round(F.avg(F.col("instruction_success").cast("int")), 6).alias("instruction_accuracy"),
        F.round(F.avg("generated_tokens"), 6).alias("mean_tokens"), F.max("generated_tokens").cast("long").alias("max_tokens"), F.grouping(category).alias("__g"),
    )
    return out.withColumn(category, F.when(F.col("__g") == 1, "*").otherwise(F.col(category))).drop("__g")


def numeric_close(a: Column, b: Column) -> Column:
    gap = F.abs(a - b)
    return (gap <= 0.05) | (gap / F.greatest(F.abs(b), F.lit(1e-12)) <= 0.005)


def bit_error(expected: Column, final: Column) -> Column:
    return F.when(final == "", "parse_fail").when(final != expected, "mapping_wrong").otherwise("final_mismatch")


def numeric_error(raw: Column, expected: Column, final: Column) -> Column:
    """Why a number is wrong. The relative gap keeps the gold's sign, so with a negative gold it is always small."""
    num = r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?"
    gold, got = F.when(fullmatch(expected, num), expected.cast("double")), F.when(fullmatch(final, num), final.cast("double"))
    ratio = got / gold
    formula = raw.rlike(r"(?i)g\s*[=≈]|ratio|coefficient|2\*d|0\.5\*g|output/input")
    computed = raw.rlike(r"\d+\.?\d*\s*[*×]\s*\d+\.?\d*|0\.5\s*[*×]")
    return (
        F.when(gold.isNull() | got.isNull(), "parse_fail")
        .when((gold == 0) | (gold == got), "final_mismatch")
        .when(F.abs(gold - got) / gold < 0.01, "rounding_wrong")
        .when((ratio > 0.7) & (ratio < 1.3) & (F.abs(ratio - 1.0) > 0.01), "coefficient_wrong")
        .when(formula & ~computed, "formula_wrong")
        .otherwise("arithmetic_wrong")
    )


def error_class(task: Column, raw: Column, expected: Column, final: Column, wants_think: Column) -> Column:
    """Class of a wrong prediction; parse failures and open loops come before what a task can tell."""
    return (
        F.when(wants_think & ~Th.has_close(raw), "parse_fail")
        .when(Th.has_open(raw) & ~Th.has_close(raw) & (F.char_length(raw) > 300), "loop")
        .when(final == "", "parse_fail")
        .when(task.isin(*NUMERIC), numeric_error(raw, expected, final))
        .when(task == "bit_manipulation", bit_error(expected, final))
        .when(task == "cipher", "mapping_wrong")
        .when(task.isin("numeral", "symbolic_transform"), "rule_wrong")
        .otherwise("final_mismatch")
    )


def physics_features(task: Column, raw: Column) -> dict[str, Column]:
    g, u = task == "gravity", task == "unit_conversion"
    return {
        "formula_correct": (g & raw.rlike(r"(?i)g\s*[=≈]|2\*d/\s*t\^2|0\.5\*g\*t\^2")) | (u & raw.rlike("(?i)ratio|coefficient|output/input")),
        "coefficient_extracted": (g & raw.rlike(r"g\s*[≈=]\s*\d+\.?\d*")) | (u & raw.rlike(r"(?i)ratio|coefficient.*?\d+\.\d+")),
        "computation_present": (g & raw.rlike(r"0\.5\s*[*×]\s*\d+\.?\d*\s*[*×]")) | (u & raw.rlike(r"(?i)\*\s*coefficient|coefficient\s*\*|multiply|×")),
    }


def exact(raw: Column, expected: Column, compat: str = "final") -> Column:
    """The final part of a generation equals the expected one, white space aside. compat="literal" compares with the whole
    expected message, its thinking block included, so that no row with a block can be exact."""
    want = Th.final_answer(expected) if compat == "final" else expected
    return normalize_ws(Th.final_answer(raw)) == normalize_ws(want)


def dev_summary(df: DataFrame, *by: str, most_tokens: int = 256) -> DataFrame:
    """exact, parse and stop counts and mean tokens; df has exact, wants_think, think_close, final and tokens."""
    return df.groupBy(*by).agg(
        F.count("*").alias("total"), F.count_if("exact").alias("exact"), F.count_if("wants_think").alias("parse_total"),
        F.count_if(F.col("wants_think") & F.col("think_close") & (F.col("final") != "")).alias("parse_ok"), F.count_if(F.col("tokens") < most_tokens).alias("stop_ok"), F.round(F.avg("tokens"), 6).alias("mean_tokens"),
    )


def protocol_flags(raw: Column, wants: Column, max_new: int = 512) -> dict[str, Column]:
    """Flags of the thinking protocol: both tags, parse, an overlong block (characters against 0.7 of max_new), spurious tags."""
    both = Th.has_open(raw) & Th.has_close(raw)
    parsed = Th.parse(raw, strict=False)
    block = F.substring_index(F.substring_index(raw, Th.CLOSE, 1), Th.OPEN, -1)
    return {
        "both_tags": wants & both, "parsed": wants & F.coalesce(parsed["ok"], F.lit(False)),
        "overlong": wants & both & (F.char_length(block) > 0.7 * max_new), "spurious": ~wants & (Th.has_open(raw) | Th.has_close(raw)),
    }


def protocol_rates(df: DataFrame) -> DataFrame:
    """Rates over requested and unrequested thinking; without requests 0, without unrequested rows clean is 1."""
    think, plain = F.count_if("wants_think"), F.count_if(~F.col("wants_think"))
    rate = lambda f, n, empty: F.round(F.coalesce(F.count_if(f) / F.nullif(n, F.lit(0)), F.lit(empty)), 6)
    return df.agg(
        F.count("*").alias("n"), think.alias("n_think"), rate("both_tags", think, 0.0).alias("both_rate"), rate("parsed", think, 0.0).alias("parse_rate"),
        rate("overlong", think, 0.0).alias("overlong_rate"), rate(~F.col("wants_think") & ~F.col("spurious"), plain, 1.0).alias("clean_rate"),
    )


# Words that explain, and answers that refuse.
EXPLAINING = ("explanation", "because", "therefore", "the rule", "i think", "let me")
REFUSING = ("i don't know", "i do not know", "idk", "n/a")


def binary_format(raw: Column) -> dict[str, Column]:
    """Six findings about an answer that should be eight bits. has_extra asks a longer text to match eight bits as a
    whole, so it is never true; it is kept as it is defined."""
    t = strip(raw)
    is8, explains, marked = fullmatch(t, "[01]{8}"), contains_any(F.lower(raw), EXPLAINING), contains_any(raw, ("```", "**"))
    return {"is_8bit": is8, "explains": explains, "markdown": marked, "has_extra": (F.char_length(t) > 8) & is8, "raw_length": F.char_length(t).cast("long"), "passed": is8 & ~explains & ~marked}


def open_flags(raw: Column, max_new: int = 128) -> dict[str, Column]:
    return {"too_short": count_fields(raw) <= 3, "possible_truncation": F.char_length(raw) >= 3 * max_new, "refusal": F.lower(strip(raw)).isin(*REFUSING)}


def side_by_side(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Accuracy of two models by key; a key that one lacks counts as 0 there."""
    x = a.select(key, F.col("correct").alias("correct_a"), F.col("total").alias("total_a"))
    y = b.select(key, F.col("correct").alias("correct_b"), F.col("total").alias("total_b"))
    z = x.join(y, key, "full_outer").na.fill(0)
    acc = lambda s: F.coalesce(F.col(f"correct_{s}") / F.nullif(F.col(f"total_{s}"), F.lit(0)), F.lit(0.0))
    return z.withColumn("delta", F.round(acc("b") - acc("a"), 6))


def top_reasons(df: DataFrame, group: str, reason: str, k: int = 10) -> DataFrame:
    from pyspark.sql import Window

    n = df.groupBy(group, reason).agg(F.count("*").alias("n"))
    return n.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("n"), reason))).filter(F.col("rank") <= k)


def error_samples(classed: DataFrame, k: int = 5, shown: int = 200) -> DataFrame:
    """The first k wrong rows of each task, in order: what was expected, the final part, and the first characters of what was said."""
    from loomwork.operators.split import take_per_group

    rows = take_per_group(classed, "task_type", k, "_ord")
    return rows.select("task_type", F.col("rank").cast("long").alias("rank"), "pid", "error_class", F.col("answer").alias("expected"), "final", F.substring("assistant", 1, shown).alias("said"))
