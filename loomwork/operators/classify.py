"""Structural classification of prompts with reason codes, and the parse into examples and a question."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.functions import grammar as G
from loomwork.functions.text import fullmatch, let, lines, strip


def _case(task: Column, of: dict[str, Column | str | int]) -> Column:
    out = F.lit(None)
    for name, value in of.items():
        out = F.when(task == name, value if isinstance(value, Column) else F.lit(value)).otherwise(out)
    return out


def task_by_prefix(ls: Column) -> Column:
    """Of a prompt's lines: the task whose first line is exactly theirs, or null."""
    first = F.get(ls, F.lit(0))
    return F.coalesce(*[F.when(first == p, t) for t, p in G.PREFIXES.items()])


def detect(prompt: Column | str) -> Column:
    """The task whose first line the prompt's begins with, or null."""
    first = F.get(lines(prompt), F.lit(0))
    return F.coalesce(*[F.when(F.startswith(first, F.lit(p)), t) for t, p in G.PREFIXES.items()])


def classify(df: DataFrame, prompt: str = "prompt", answer: str = "answer") -> DataFrame:
    """Adds task_type ('unknown' where anything is wrong) and reasons (sorted, distinct)."""
    a = F.col(answer)

    def query_faults(task: Column, queries: Column) -> list[Column]:
        n, first = F.size(queries), F.get(queries, F.lit(0))
        symbol = F.regexp_extract(first, r"\A" + G.QUERY["symbolic_transform"] + r"\z", 1)
        return [
            F.when(n != 1, F.concat(F.lit("unexpected_query_count:"), n.cast("string"))).when(~_case(task, {t: fullmatch(first, p) for t, p in G.QUERY.items()}), "invalid_query_format"),
            F.when((task == "symbolic_transform") & (symbol != "") & ~fullmatch(symbol, G.SYMBOLS), "invalid_query_symbol_format"),
        ]

    def example_faults(task: Column, examples: Column, bad_header: Column) -> list[Column]:
        n = F.size(examples)
        wrong = F.size(F.filter(examples, lambda x: ~_case(task, {t: fullmatch(x, p) for t, p in G.EXAMPLE.items()})))
        low, high = _case(task, {t: c[0] for t, c in G.EXAMPLES.items()}), _case(task, {t: c[1] for t, c in G.EXAMPLES.items()})
        return [
            F.when(bad_header, "invalid_example_header"),
            F.when(~n.between(low, high), F.concat(F.lit("unexpected_example_count:"), n.cast("string"))),
            let(wrong, lambda w: F.when(w > 0, F.concat(F.lit("invalid_example_lines:"), w.cast("string")))),
        ]

    def judged(ls: Column, task: Column) -> Column:
        filled = F.filter(ls, lambda x: x != "")
        queries = F.filter(ls, lambda x: F.startswith(x, F.lit("Now,")))
        headed = task == "bit_manipulation"

        def rest(full: Column) -> Column:
            bad = headed & ~F.coalesce(F.get(full, F.lit(1)) == G.BIT_HEADER, F.lit(False))
            skip = F.when(headed & ~bad, 2).otherwise(1)
            examples = F.slice(full, skip + 1, F.greatest(F.size(full) - 1 - skip, F.lit(0)))
            found = let(examples, lambda e: let(queries, lambda q: F.array_compact(F.array(
                *example_faults(task, e, bad), *query_faults(task, q),
                F.when(~_case(task, {t: fullmatch(a, p) for t, p in G.ANSWER.items()}), "invalid_answer_format"),
            ))))
            return F.array_sort(F.array_distinct(found))

        return F.when(F.size(ls) == 0, F.array(F.lit("empty_prompt"))).when(task.isNull(), F.array(F.lit("prefix_match_count:0"))).otherwise(let(filled, rest))

    both = let(lines(prompt), lambda ls: let(task_by_prefix(ls), lambda task: F.struct(task.alias("task"), judged(ls, task).alias("reasons"))))
    out = let(both, lambda k: F.struct(F.when(F.size(k["reasons"]) > 0, "unknown").otherwise(k["task"]).alias("task_type"), k["reasons"].alias("reasons")))
    return df.withColumn("__k", out).withColumn("task_type", F.col("__k.task_type")).withColumn("reasons", F.col("__k.reasons")).drop("__k")


def parse(df: DataFrame, prompt: str = "prompt", answer: str = "answer") -> DataFrame:
    """Adds task_type, examples (array of input_value, output_value), question, category and error (null where none)."""
    p = F.col(prompt)

    def pairs(pattern: str) -> Column:
        both = F.arrays_zip(F.regexp_extract_all(p, F.lit(pattern), 1).alias("a"), F.regexp_extract_all(p, F.lit(pattern), 2).alias("b"))
        return F.transform(both, lambda e: F.struct(e["a"].alias("input_value"), e["b"].alias("output_value")))

    def cut(mark: str, skip_query: bool) -> Column:
        kept = F.filter(lines(p), lambda x: F.contains(x, F.lit(mark)) & (~F.startswith(x, F.lit("Now,")) if skip_query else F.lit(True)))
        left = lambda x: F.substring_index(x, mark, 1)
        return F.transform(kept, lambda x: F.struct(strip(left(x)).alias("input_value"), strip(F.substring(x, F.char_length(left(x)) + len(mark) + 1, F.char_length(x))).alias("output_value")))

    def parsed(task: Column) -> Column:
        examples = (
            F.when(task.isin("numeral", "cipher"), cut(" -> ", False)).when(task == "symbolic_transform", cut(" = ", True))
            .when(task == "bit_manipulation", pairs(G.PAIRS["bit_manipulation"])).when(task == "gravity", pairs(G.PAIRS["gravity"])).when(task == "unit_conversion", pairs(G.PAIRS["unit_conversion"]))
        )
        question = strip(F.nullif(F.coalesce(*[F.when(task == t, F.regexp_extract(p, q, 1)) for t, q in G.QUESTION.items()]), F.lit("")))

        def judged(e: Column, q: Column) -> Column:
            error = F.when(task.isNull(), "unknown_task_type").when(q.isNull(), F.concat(task, F.lit(":missing_question"))).when(F.size(e) == 0, F.concat(task, F.lit(":missing_examples")))
            category = F.when(task != "symbolic_transform", task).when(fullmatch(q, r"\d+\D\d+"), "equation_numeric").otherwise("cryptarithm")
            return let(error, lambda x: F.struct(task.alias("task_type"), e.alias("examples"), q.alias("question"), x.alias("error"), F.when(x.isNull(), category).alias("category")))

        return let(examples, lambda e: let(question, lambda q: judged(e, q)))

    df = df.withColumn("__p", let(detect(prompt), parsed)).withColumn("answer", strip(answer))
    return df.withColumns({c: F.col(f"__p.{c}") for c in ("task_type", "examples", "question", "error", "category")}).drop("__p")
