"""Regression summaries over tables of generations: strict answers, open answers, and the three reports of one run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.functions import thinking as Th
from loomwork.functions.text import count_fields, strip
from loomwork.operators.chat import with_rank

# Rows of each report of a run, and the examples, steps and epochs of each run mode.
LIMITS = {"strict": 40, "protocol": 30, "protocol_plain": 30, "open": 20}
RUN_MODES = {"overfit": ("overfit_examples", 16, "overfit_steps", 40), "smoke": ("smoke_examples", 256, "smoke_steps", 20)}


def _rates(row: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    total = F.nullif("total", F.lit(0))
    return row.withColumns({f"{n}_rate": F.coalesce(F.round(F.col(n) / total, digits), F.lit(0.0)) for n in names})


def first_rows(df: DataFrame, n: int | None, order: str = "_ord") -> DataFrame:
    """The first n rows in order, or all. By rank, so that a large n needs no task to hold them."""
    return df if n is None else with_rank(df, order).filter(F.col("rank") <= n).drop("rank")


def strict(df: DataFrame, generated: str = "generated", expected: str = "expected", tokens: str = "tokens", *, most_new: int = 128, limit: int | None = None) -> DataFrame:
    """One row: exact answers after stripping, answers without tags (their format is taken as right), and answers that ended."""
    g = F.col(generated)
    row = first_rows(df, limit).agg(
        F.count("*").alias("total"), F.count_if(strip(g) == strip(expected)).alias("exact_match"), F.count_if(~Th.has_open(g)).alias("no_spurious_think"), F.count_if(Th.has_open(g)).alias("spurious_think"),
        F.count_if(~Th.has_open(g)).alias("format_correct"), F.count_if(F.col(tokens) < most_new).alias("stop_success"),
    )
    return _rates(row, "exact_match", "no_spurious_think", "spurious_think", "format_correct", "stop_success")


def too_short(generated: Column, tokens: Column, by: str) -> Column:
    """Two rules that differ: under ten tokens, or up to three words."""
    if by not in ("tokens", "words"):
        raise ValueError(f"unknown rule: {by}")
    return tokens < 10 if by == "tokens" else count_fields(strip(generated)) <= 3


def open_answers(df: DataFrame, generated: str = "generated", tokens: str = "tokens", *, short_by: str = "tokens", most_new: int = 256, limit: int | None = None) -> DataFrame:
    """One row: answers with tags, answers that ended, answers that are too short, and their lengths."""
    g, t = F.col(generated), F.col(tokens)
    words = count_fields(strip(g))
    row = first_rows(df, limit).agg(
        F.count("*").alias("total"), F.count_if(Th.has_open(g)).alias("spurious_think"), F.count_if(t < most_new).alias("stop_success"), F.count_if(too_short(g, t, short_by)).alias("too_short"),
        F.coalesce(F.round(F.avg(t), 6), F.lit(0.0)).alias("mean_tokens"), F.coalesce(F.round(F.avg(words), 1), F.lit(0.0)).alias("word_count_mean"), F.coalesce(F.min(words), F.lit(0)).alias("word_count_min"), F.coalesce(F.max(words), F.lit(0)).alias("word_count_max"),
    )
    return _rates(row, "spurious_think", "stop_success", "too_short")


def trio(strict_rows: DataFrame, protocol_rows: DataFrame, open_rows: DataFrame, limits: dict[str, int] = LIMITS) -> DataFrame:
    """The three reports of a run as rows (report, total, passed, rate). Protocol rows have generated, expected, tokens and wants_think."""
    a = strict(strict_rows, limit=limits["strict"]).select(F.lit("strict").alias("report"), "total", F.col("exact_match").alias("passed"))
    asked = first_rows(protocol_rows.filter("wants_think"), limits["protocol"]).unionByName(first_rows(protocol_rows.filter("not wants_think"), limits["protocol_plain"]))
    g = F.col("generated")
    kept = F.when(F.col("wants_think"), Th.has_open(g) & Th.has_close(g)).otherwise(~Th.has_open(g))
    b = asked.agg(F.lit("protocol").alias("report"), F.count("*").alias("total"), F.count_if(kept).alias("passed"))
    c = open_answers(open_rows, short_by="words", limit=limits["open"]).select(F.lit("open").alias("report"), "total", (F.col("total") - F.col("too_short")).alias("passed"))
    return a.unionByName(b).unionByName(c).withColumn("rate", F.round(F.col("passed") / F.greatest("total", F.lit(1)), 6))


def run_limits(mode: str, training: dict) -> dict[str, int | float | None]:
    """example_limit, max_steps and num_train_epochs of a run mode."""
    if mode in RUN_MODES:
        examples, n, steps, m = RUN_MODES[mode]
        return {"example_limit": int(training.get(examples, n)), "max_steps": int(training.get(steps, m)), "num_train_epochs": None}
    if mode == "formal":
        return {"example_limit": None, "max_steps": int(training.get("max_steps", -1)), "num_train_epochs": training.get("num_train_epochs")}
    raise ValueError(f"unsupported run mode: {mode}")


def console(df: DataFrame, by: str, text: str, *, samples: int = 2, key: str = "_ord") -> str:
    """Counts of each group and its first rows in hash order, as text for a terminal."""
    from loomwork.operators.split import shuffle_key, take_per_group

    counts = {str(r[0]): r[1] for r in df.groupBy(by).count().collect()}
    shown: dict[str, list[str]] = {}
    for r in take_per_group(df, by, samples, shuffle_key(42, key), key).select(by, F.substring(text, 1, 120).alias("t"), "rank").orderBy(by, "rank").collect():
        shown.setdefault(str(r[0]), []).append(f"    {r['t']}")
    return "\n".join(line for g in sorted(counts) for line in (f"{g}: {counts[g]}", *shown.get(g, []))) + "\n"
