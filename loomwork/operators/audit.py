"""Label audits of rendered chats at the level of segments: tokens, masks, spans, boundaries, eligibility.

Tokens are the fields between white space of a message's content, with one token each for the header and the end
mark; a real tokenizer's arrays can be given to ``spans`` and ``audit_arrays`` instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.functions.text import WS_SET, let

END = "<|im_end|>"


def tokens(messages: Column | str = "messages") -> Column:
    m = F.col(messages) if isinstance(messages, str) else messages
    one = lambda x: F.concat(F.array(F.concat(F.lit("<|im_start|>"), x["role"])), F.regexp_extract_all(x["content"], F.lit(f"[^{WS_SET}]+"), 0), F.array(F.lit(END)))
    return F.flatten(F.transform(m, one))


def mask(messages: Column | str = "messages") -> Column:
    """1 for every token of an assistant message but its header."""
    m = F.col(messages) if isinstance(messages, str) else messages
    n = lambda x: F.regexp_count(x["content"], F.lit(f"[^{WS_SET}]+")) + 1
    return F.flatten(F.transform(m, lambda x: F.concat(F.array(F.lit(0)), F.array_repeat((x["role"] == "assistant").cast("int"), n(x).cast("int")))))


def spans(mask: Column) -> Column:
    """(start, end) of each run of ones."""

    def runs(m: Column) -> Column:
        at = lambda i: F.coalesce(F.get(m, i), F.lit(0))
        every = F.sequence(F.lit(0), F.greatest(F.size(m) - 1, F.lit(0)))
        starts = F.filter(every, lambda i: (at(i) == 1) & (at(i - 1) == 0))
        ends = F.filter(every, lambda i: (at(i) == 1) & (at(i + 1) == 0))
        return F.zip_with(starts, ends, lambda a, b: F.struct(a.alias("start"), b.alias("end")))

    return let(mask, runs)


def boundaries_ok(spans: Column, ids: Column, end: Column) -> Column:
    """Each span holds an end mark or is followed by one."""
    return F.forall(spans, lambda s: F.array_contains(F.slice(ids, s["start"] + 1, s["end"] - s["start"] + 1), end) | F.coalesce(F.get(ids, s["end"] + 1) == end, F.lit(False)))


def audit_arrays(df: DataFrame, max_length: int, *, ids: str = "input_ids", masks: str = "mask", end: Column | None = None) -> DataFrame:
    """Adds lengths, spans, labels (-100 outside the mask), eligibility and the error of a row that cannot be audited."""
    if max_length <= 0:
        raise ValueError("max_length must be positive")
    end = F.lit(END) if end is None else end
    supervised = lambda m: F.aggregate(m, F.lit(0), lambda a, x: a + x).cast("long")

    def judged(i: Column, m: Column, s: Column) -> Column:
        n, kept = F.size(i), F.slice(m, 1, max_length)
        error = (
            F.when(F.size(i) != F.size(m), "inconsistent_lengths").when(supervised(m) == 0, "no_supervised_tokens")
            .when(~boundaries_ok(s, i, end), "missing_end_boundary")
        )
        return let(kept, lambda k: F.struct(
            n.cast("long").alias("original_tokens"), F.least(n, F.lit(max_length)).cast("long").alias("sequence_tokens"),
            supervised(m).alias("original_supervised_tokens"), supervised(k).alias("supervised_tokens"), (n > max_length).alias("truncated"),
            F.size(s).cast("long").alias("original_spans"), F.size(spans(k)).cast("long").alias("supervised_spans"),
            F.exists(s, lambda x: (x["start"] < max_length) & (F.lit(max_length) <= x["end"])).alias("truncates_supervised_span"),
            F.coalesce(F.try_element_at(k, F.lit(-1)) == 1, F.lit(False)).alias("ends_with_supervised_token"),
            F.exists(F.arrays_zip(F.slice(i, 1, max_length).alias("t"), k.alias("k")), lambda z: (z["k"] == 1) & (z["t"] == end)).alias("end_supervised"),
            error.alias("error"), (error.isNull() & (n <= max_length)).alias("eligible"), F.when(n > max_length, "sequence_exceeds_max_length").alias("exclusion_reason"),
        ))

    found = let(F.col(ids), lambda i: let(F.col(masks), lambda m: let(spans(m), lambda s: judged(i, m, s))))
    df = df.withColumn("__a", found)
    names = ("original_tokens", "sequence_tokens", "original_supervised_tokens", "supervised_tokens", "truncated", "original_spans", "supervised_spans", "truncates_supervised_span", "ends_with_supervised_token", "end_supervised", "error", "eligible", "exclusion_reason")
    return df.withColumns({c: F.col(f"__a.{c}") for c in names}).drop("__a")


def labels(ids: Column, mask: Column) -> Column:
    """The ids under the mask, -100 elsewhere."""
    return F.zip_with(ids, mask, lambda i, m: F.when(m == 1, i).otherwise(-100))


def audit(chat: DataFrame, max_length: int = 1024) -> DataFrame:
    df = chat.withColumn("input_ids", let(tokens(), lambda t: t)).withColumn("mask", mask())
    return audit_arrays(df, max_length)


def report(audited: DataFrame, split: str) -> DataFrame:
    """By split: eligible and excluded counts, reasons and token totals."""
    return audited.groupBy(split).agg(
        F.count("*").alias("n"), F.count_if("eligible").alias("n_eligible"), F.count_if(~F.col("eligible")).alias("n_excluded"), F.count_if("truncated").alias("n_truncated"),
        F.sum("supervised_tokens").alias("supervised_tokens"), F.max("original_tokens").alias("longest"), F.round(F.avg("sequence_tokens"), 6).alias("mean_tokens"),
    )


def excluded(audited: DataFrame, split: str, key: str) -> DataFrame:
    """A row for each conversation that is left out: split, its key and why (an error, or that it is too long)."""
    why = F.coalesce("error", "exclusion_reason")
    return audited.filter(~F.col("eligible")).select(F.col(split).alias("split"), F.col(key).alias("key"), why.alias("reason"))


def reasons(audited: DataFrame, split: str) -> DataFrame:
    """How often each reason stands behind an exclusion, by split."""
    return audited.filter(~F.col("eligible")).groupBy(F.col(split).alias("split"), F.coalesce("error", "exclusion_reason").alias("reason")).agg(F.count("*").alias("n"))


def distributions(audited: DataFrame, split: str, points: tuple[float, ...] = (0.5, 0.9, 0.95, 0.99)) -> DataFrame:
    """n, min, mean, max and percentiles of the token counts of each split: original, in the sequence, supervised. One pass: the counts of a row become three rows."""
    from loomwork.operators.profile import length_stats

    counts = F.array(*[F.struct(F.lit(c).alias("count"), F.col(c).alias("tokens")) for c in ("original_tokens", "sequence_tokens", "supervised_tokens")])
    long = audited.select(F.col(split).alias("split"), F.explode(counts).alias("c")).select("split", "c.count", "c.tokens")
    return length_stats(long, "tokens", "split", "count", points=points)


def batch_checks(audited: DataFrame, split: str, order: str, k: int = 4) -> DataFrame:
    """The first k eligible rows of each split, and whether all of them pass."""
    from loomwork.operators.split import take_per_group

    rows = take_per_group(audited.filter("eligible"), split, k, order)
    return rows.agg(F.count("*").alias("rows"), F.coalesce(F.bool_and(F.col("supervised_tokens") > 0), F.lit(True)).alias("mask_nonempty"), F.coalesce(F.bool_and(F.col("error").isNull()), F.lit(True)).alias("boundaries_present"))


def first_stop(ids: Column, stops: list[int]) -> Column:
    """struct(ids before the first stop id, reason): max_tokens where none comes."""
    at = F.array_min(F.filter(F.array(*[F.array_position(ids, F.lit(s)) for s in stops]), lambda p: p > 0))
    return F.struct(F.when(at.isNull(), ids).otherwise(F.slice(ids, F.lit(1), (at - 1).cast("int"))).alias("ids"), F.when(at.isNull(), "max_tokens").otherwise("stop").alias("reason"))
