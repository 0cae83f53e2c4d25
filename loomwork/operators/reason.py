"""Solvers over tables of problems, their steps, traces, the rows they give for training, budgets and reports.

Physics problems, numerals and ciphers are Catalyst expressions; bit strings and symbols run in one Arrow pass, a batch at a time. Every problem yields ok, answer, rule,
values, error, its steps and its intermediate values; a problem is ok where the answer equals its gold answer. Traces are folds over the steps.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwork.functions import thinking as Th
from loomwork.functions import word_cipher as W
from loomwork.functions.text import let, rstrip, token_estimate
from loomwork.operators.scoring import numeric_close

PHYSICS = ("unit_conversion", "gravity")
WORDED = ("numeral", "cipher")
# Token budgets of the third trace version.
BUDGET = {"numeral": 240, "gravity": 310, "unit_conversion": 300, "bit_manipulation": 400, "cipher": 280, "symbolic_transform": 260}
BUDGET_ELSE = 300


def _median(values: Column) -> Column:
    n = F.size(values)
    s = F.array_sort(values)
    return F.when(n == 0, None).otherwise((F.get(s, ((n - 1) / 2).cast("int")) + F.get(s, (n / 2).cast("int"))) / 2)


def physics(df: DataFrame) -> DataFrame:
    """Adds values (a coefficient an example), coefficient (their median), predicted, answer, rule and error."""
    gravity = F.col("task_type") == "gravity"
    q, gold = F.col("question").try_cast("double"), F.col("gold").try_cast("double")
    pairs = F.transform("examples", lambda e: F.struct(e["input_value"].try_cast("double").alias("x"), e["output_value"].try_cast("double").alias("y")))
    values = F.transform(F.filter(pairs, lambda p: p["x"] != 0), lambda p: F.when(gravity, 2 * p["y"] / (p["x"] * p["x"])).otherwise(p["y"] / p["x"]))

    def judged(v: Column, c: Column, predicted: Column) -> Column:
        error = F.when(F.size(v) == 0, "no_nonzero_examples").when(q.isNull() | gold.isNull(), "parse_error").when(~numeric_close(predicted, gold), "numeric_tolerance_failed")
        return F.struct(v.alias("values"), c.alias("coefficient"), predicted.alias("predicted"), error.alias("error"))

    def with_values(v: Column) -> Column:
        return let(_median(v), lambda c: let(F.when(gravity, 0.5 * c * q * q).otherwise(q * c), lambda p: judged(v, c, p)))

    df = df.withColumn("__p", let(values, with_values))
    df = df.withColumns({c: F.col(f"__p.{c}") for c in ("values", "coefficient", "predicted", "error")}).drop("__p")
    df = df.withColumn("solved", F.when(F.col("error").isNull(), F.col("gold"))).withColumn("rule", F.when(F.col("error").isNull(), F.when(gravity, "g = 2*d/t^2").otherwise("output/input")))
    used = F.filter("examples", lambda e: e["input_value"].try_cast("double") != 0)
    each = F.zip_with(used, F.col("values"), lambda e, v: _step(F.lit("value"), F.concat(e["output_value"], F.lit(" over "), e["input_value"]), compact(v)))
    steps = F.concat(each, F.array(_step(F.lit("median"), F.array_join(F.transform(F.array_sort("values"), lambda v: compact(v, 4)), ", "), compact(F.col("coefficient"))), _step(F.lit("apply"), F.col("question"), F.format_string("%.2f", F.col("predicted")))))
    named = F.array(F.struct(F.lit("coefficient").alias("k"), F.col("coefficient").alias("v")), F.struct(F.lit("predicted").alias("k"), F.col("predicted").alias("v")))
    numbered = F.transform("values", lambda v, i: F.struct(F.concat(F.lit("value_"), (i + 1).cast("string")).alias("k"), v.alias("v")))
    return _with_log(df, F.when(F.col("solved").isNotNull(), steps), F.map_from_entries(F.filter(F.concat(numbered, named), lambda e: e["v"].isNotNull())))


def _step(name: Column, given: Column, got: Column) -> Column:
    return F.struct(name.alias("step"), given.alias("input"), got.alias("output"))


def _with_log(df: DataFrame, steps: Column, values: Column | None = None) -> DataFrame:
    """steps: array of struct(step, input, output), empty where nothing was solved; intermediates: values by name."""
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<double>"))
    return df.withColumns({"steps": F.coalesce(steps.cast(W.STEPS), F.array().cast(W.STEPS)), "intermediates": none if values is None else F.coalesce(values.cast("map<string,double>"), none)})


def _unmeasured(df: DataFrame) -> DataFrame:
    return df.withColumns({"values": F.array().cast("array<double>"), "coefficient": F.lit(None).cast("double"), "predicted": F.lit(None).cast("double")})


def worded(df: DataFrame) -> DataFrame:
    """Numerals and ciphers: adds solved, rule, error, steps and intermediates."""
    numeral = F.col("task_type") == "numeral"
    question = F.coalesce("question", F.lit(""))
    examples = F.coalesce("examples", F.array().cast("array<struct<input_value: string, output_value: string>>"))
    df = df.withColumn("__s", F.when(numeral, W.solve_numeral(question)).otherwise(W.solve_cipher(examples, question)))
    df = df.withColumns({"solved": F.col("__s.answer"), "rule": F.col("__s.rule"), "error": F.when(F.col("__s").isNull(), "no_rule")})
    n = F.map_from_arrays(F.array(F.lit("number"), F.lit("symbols")), F.array(question.try_cast("double"), F.size("__s.steps").cast("double")))
    return _unmeasured(_with_log(df, F.col("__s.steps"), F.when(numeral & F.col("solved").isNotNull(), n)).drop("__s"))


def batched(df: DataFrame, version: int = 1) -> DataFrame:
    """Bit strings and symbols by the Python solvers, an Arrow batch at a time: adds what ``worded`` adds.

    Rows pass through with all their columns: nothing is joined back. A task without a solver has the error missing_reasoner.
    """
    new = ("solved", "rule", "error")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from loomwork.functions.solvers import solve_many

        for b in batches:
            tasks, examples, questions = (b.column(c).to_pylist() for c in ("task_type", "examples", "question"))
            out = solve_many(tasks, [([(e["input_value"], e["output_value"]) for e in ex or []], q or "") for ex, q in zip(examples, questions, strict=True)], version)
            cols = [[a if not e else None for a, _, e in out], [r if not e else None for _, r, e in out], [e or None for _, _, e in out]]
            yield pa.RecordBatch.from_arrays([*b.columns, *[pa.array(c, pa.string()) for c in cols]], names=[*b.schema.names, *new])

    schema = T.StructType([*df.schema.fields, *[T.StructField(c, T.StringType()) for c in new]])
    solved = df.mapInArrow(run, schema)
    bit = F.transform(F.split("rule", ", "), lambda r, i: _step(F.substring_index(r, ":", 1), F.substring_index(r, ":", -1), F.substring("solved", i + 1, F.lit(1))))
    other = F.array(_step(F.lit("operation"), F.col("rule"), F.col("solved")))
    return _unmeasured(_with_log(solved, F.when(F.col("solved").isNotNull(), F.when(F.col("task_type") == "bit_manipulation", bit).otherwise(other))))


def reason(df: DataFrame, version: int = 1) -> DataFrame:
    """df has task_type, examples, question and gold. Adds solved, rule, values, coefficient, predicted, error, steps, intermediates, ok."""
    task = F.col("task_type")
    parts = [physics(df.filter(task.isin(*PHYSICS))), worded(df.filter(task.isin(*WORDED))), batched(df.filter(~task.isin(*PHYSICS, *WORDED) | task.isNull()), version)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.withColumn("ok", F.coalesce(F.col("solved") == F.col("gold"), F.lit(False)))


def compact(x: Column, digits: int = 6) -> Column:
    """A number with at most so many significant digits and no trailing zeros (plain notation)."""
    places = F.greatest(F.lit(0), digits - 1 - F.floor(F.log10(F.greatest(F.abs(x), F.lit(1e-12)))).cast("int"))
    scale = lambda s: F.format_string("%.10f", F.round(x * s, 0) / s)
    return F.regexp_replace(F.regexp_replace(let(F.pow(F.lit(10.0), places), scale), r"(\.\d*?)0+\z", "$1"), r"\.\z", "")


def bit_fits(df: DataFrame) -> DataFrame:
    """pid, bit, family, p, q of every rule that an output bit obeys in all of a problem's examples. df has pid, examples and question."""
    kinds = [pa.string(), pa.int32(), pa.string(), pa.int32(), pa.int32()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from loomwork.functions import bit_rules as B

        for whole in batches:
            for at in range(0, whole.num_rows, B.SLICE):
                b = whole.slice(at, B.SLICE)
                read = [(p, r) for p, ex, q in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True) if (r := B.readable([(e["input_value"], e["output_value"]) for e in ex or []], q or ""))]
                if read:
                    problem, rule, bit = (c.tolist() for c in B.fits([(inputs, outputs) for _, (inputs, outputs, _) in read]).nonzero())
                    columns = [[read[k][0] for k in problem], bit, *zip(*(B.RULES[k] for k in rule), strict=True)] if problem else [[]] * 5
                    yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)], names=["pid", "bit", "family", "p", "q"])

    return df.select("pid", "examples", "question").mapInArrow(run, "pid string, bit int, family string, p int, q int")


def _named(step: str) -> Column:
    return F.filter("steps", lambda s: s["step"] == step)


def trace(version: int) -> Column:
    """The compressed trace of a solved row, folded from its steps: the first version names the rule, the second shows how it is found or applied, the third all values."""
    task, q, a = F.col("task_type"), F.col("question"), F.col("solved")
    first = F.get("examples", F.lit(0))
    coefficient, predicted = compact(F.col("coefficient")), F.format_string("%.2f", F.col("predicted"))
    listed = F.get(F.transform(_named("median"), lambda s: s["input"]), F.lit(0))
    j = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    letters = F.array_join(F.transform(F.slice(_named("letter"), 1, 10), lambda s: j(s["input"], "→", s["output"])), ", ")
    many = F.size(_named("letter")) > 10
    taken = F.array_join(F.transform(F.slice(_named("take"), 1, 6), lambda s: j(s["input"], " gives ", s["output"])), ", ")
    more = F.when(F.size(_named("take")) > 6, ", ...").otherwise("")
    rules = F.array_join(F.transform("steps", lambda s: j(s["step"], ":", s["input"])), ", ")
    if version == 1:
        texts = {
            "gravity": j("Gravity. From g = 2*d/t^2 the examples give g near ", coefficient, ". Then d = 0.5*g*t^2."),
            "unit_conversion": j("Units. The ratios output/input are near ", coefficient, ". Multiply the query by it."),
            "bit_manipulation": j("Bits. Each output bit has a rule: ", rules, ".\nQuery: ", q, "\nResult: ", a),
            "numeral": j("Numerals. Roman symbols are taken largest first.\nQuery: ", q, "\nResult: ", a),
            "cipher": j("Cipher. The examples say what each letter stands for.\nQuery: ", q, "\nResult: ", a),
            "symbolic_transform": j("Symbols. Rule: ", F.col("rule"), ".\nQuery: ", q, "\nResult: ", a),
        }
    elif version == 2:
        texts = {
            "gravity": j("Gravity. t=", first["input_value"], ", d=", first["output_value"], " give g near ", coefficient, ".\nFor t=", q, ": 0.5 * ", coefficient, " * ", q, "^2 = ", predicted, "."),
            "unit_conversion": j("Units. ", first["output_value"], "/", first["input_value"], " and the others give the median ", coefficient, ".\nFor ", q, ": ", q, " * ", coefficient, " = ", predicted, "."),
            "bit_manipulation": j("Bits. Rules: ", rules, ".\nBit by bit ", q, " gives ", a, "."),
            "numeral": j("Numerals. ", taken, more, ".\n", q, " gives ", a, "."),
            "cipher": j("Cipher. Letters: ", letters, F.when(many, ", ...").otherwise(""), ".\n'", q, "' reads '", a, "'."),
            "symbolic_transform": j("Symbols. Rule: ", F.col("rule"), ".\n", q, " gives ", a, "."),
        }
    else:
        texts = {
            "gravity": j("Gravity. The values of g are ", listed, "; the median is ", coefficient, ".\nFor t=", q, ": 0.5 * ", coefficient, " * ", q, "^2 = ", predicted, "."),
            "unit_conversion": j("Units. The coefficients are ", listed, "; the median is ", coefficient, ".\nFor ", q, ": ", q, " * ", coefficient, " = ", predicted, "."),
            "bit_manipulation": j("Bits. Rules: ", rules, ".\nThese eight rules turn ", q, " into ", a, "."),
            "numeral": j("Numerals. Rule: ", F.col("rule"), ".\nApplied to ", q, " it gives ", a, "."),
            "cipher": j("Cipher. Rule: ", letters, F.when(many, " (remaining consistent)").otherwise(""), ".\nApplied to ", q, " it gives ", a, "."),
            "symbolic_transform": j("Symbols. Rule: ", F.col("rule"), ".\nApplied to ", q, " it gives ", a, "."),
        }
    return F.when(F.col("ok") & (F.col("rule") != ""), F.coalesce(*[F.when(task == t, text) for t, text in texts.items()]))


def answer_prompt(prompt: Column | str) -> Column:
    return F.concat(rstrip(prompt), F.lit("\n\nReturn only the final answer. Do not explain."))


def cot_prompt(prompt: Column | str) -> Column:
    return F.concat(rstrip(prompt), F.lit(f"\n\nThink briefly in {Th.OPEN}...{Th.CLOSE}, then output only the final answer."))


def emit(solved: DataFrame, version: int = 1, budget: bool = False) -> DataFrame:
    """Training rows and reasons for those left out: an answer-only row for every problem, a chain-of-thought row where it
    is solved, has a trace and, with budget, keeps within its task's tokens."""
    df = solved.withColumn("trace", trace(version))
    text = Th.build("trace", "solved")
    tokens = token_estimate(F.concat(cot_prompt("prompt"), text))
    limit = F.coalesce(*[F.when(F.col("task_type") == t, n) for t, n in BUDGET.items()], F.lit(BUDGET_ELSE))
    skip = (
        F.when(F.col("error").isNotNull(), F.concat(F.lit("reasoner:"), F.col("error"))).when(~F.col("ok"), "answer_mismatch").when(F.col("trace").isNull(), "no_trace")
        .when(F.lit(budget) & (tokens > limit), "over_budget")
    )
    plain = F.struct(F.lit("answer_only").alias("sample_type"), answer_prompt("prompt").alias("user"), F.col("gold").alias("assistant"), F.lit(None).cast("string").alias("skip_reason"))
    cot = F.struct(F.lit("compressed_cot").alias("sample_type"), cot_prompt("prompt").alias("user"), text.alias("assistant"), skip.alias("skip_reason"))
    rows = df.select(*solved.columns, F.explode(F.array(plain, cot)).alias("__r")).select(*solved.columns, "__r.*")
    return rows.withColumn("tokens", token_estimate(F.concat("user", "assistant")))


def rates(solved: DataFrame) -> DataFrame:
    return solved.groupBy("task_type").agg(F.count("*").alias("n"), F.count_if("ok").alias("n_ok"), F.count_if(F.col("error").isNotNull()).alias("n_error"), F.round(F.avg(F.col("ok").cast("int")), 6).alias("ok_rate"))


def trace_quality(solved: DataFrame, version: int = 1) -> DataFrame:
    """Flags of each trace: there, names the answer, names its method, short enough, free of residue."""
    t = F.col("trace")
    method = F.when(F.col("task_type") == "gravity", t.rlike("(?i)g = |value")).when(F.col("task_type") == "unit_conversion", t.rlike("(?i)ratio|coefficient|median")).otherwise(F.contains(t, F.col("rule")))
    df = solved.withColumn("trace", trace(version))
    no = lambda c: F.coalesce(c, F.lit(False))
    return df.select("pid", "task_type", t.isNotNull().alias("present"), no(F.contains(t, F.col("solved"))).alias("names_answer"), no(method).alias("names_method"), no(token_estimate(t) <= 120).alias("short"), no(~t.rlike(r"\\boxed|<\|im_end\|>")).alias("clean"))


def mixture_report(rows: DataFrame) -> DataFrame:
    """Emitted rows by sample type: count, share, parse rate, mean tokens, rows with residue."""
    kept = rows.filter("skip_reason is null")
    total = kept.count()
    parsed = F.when(F.col("sample_type") == "compressed_cot", Th.parse("assistant", strict=True)["ok"]).otherwise(F.char_length("assistant") > 0)
    return kept.groupBy("sample_type").agg(
        F.count("*").alias("n"), F.round(F.count("*") / F.lit(max(total, 1)), 6).alias("share"), F.round(F.avg(F.coalesce(parsed, F.lit(False)).cast("int")), 6).alias("parse_rate"),
        F.round(F.avg("tokens"), 6).alias("mean_tokens"), F.count_if(F.contains("assistant", F.lit("\\boxed"))).alias("residue"),
    )
