"""Quality rules as weak supervision, in DataFrame operations only.

Each rule votes 1 (good), -1 (bad) or 0 (abstains) from counts of the whole text. Expectation-maximisation
over the vote patterns finds how often each rule votes each way on good and on bad documents, and the share of good
documents; a document's posterior probability of being good replaces an all-must-pass filter. Nothing but Laplace smoothing holds the
estimates. Which class is the good one is set by the start alone: the more rules vote bad, the likelier a pattern begins as bad.
A defect shows in several rules (symbols lengthen words, repetition lowers the number of distinct words), so that no single
defect becomes a class of its own, and one mild symptom can be outvoted.

Vote patterns are counted first: the driver sees at most 3**12 rows of 13 numbers, whatever the corpus, and iterates over these.

Counts (null text: none): words are runs outside space and the controls 9 to 13. A word repeats where it lies in
a window of three words that the text has twice or more; windows compare by a 64-bit hash of their words.

Base failure (fewer than 50 words, or over half of them repeated) is never kept, whatever the posterior.
Repeated rows stay repeated, with equal results. Empty tables give no rows.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.llm.textkit import pick, settle

_BLANK = r"\x20\x09-\x0D"


def counts(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the long counts that the rules read."""
    t = pick(df, id_col, text_col)
    t = t.select(
        "doc_id",
        F.regexp_extract_all("text", F.lit(f"[^{_BLANK}]+"), 0).alias("w"),
        F.filter(F.split("text", "\n"), lambda x: x.rlike(f"[^{_BLANK}]")).alias("lines"),
        (F.char_length("text") - F.regexp_count("text", F.lit(f"[{_BLANK}]"))).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.regexp_count("text", F.lit("[A-Z]")).cast("long").alias("n_upper"),
        F.regexp_count("text", F.lit("[!?]")).cast("long").alias("n_bangs"),
        F.regexp_count("text", F.lit("[.!?]")).cast("long").alias("n_marks"),
        F.coalesce(F.expr(rf"text rlike '[.!?…\"”»][{_BLANK}]*\\z'"), F.lit(False)).alias("ends"),
    )
    t = t.select(
        "doc_id", "word_chars", "n_symbols", "n_upper", "n_bangs", "n_marks", "ends",
        F.size("w").cast("long").alias("n_words"), F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.array_distinct("w")).cast("long").alias("n_distinct"), F.size(F.filter("w", lambda x: F.char_length(x) == 1)).cast("long").alias("n_single"),
        F.expr("if(size(w) < 2, 0L, cast(size(filter(sequence(0, size(w) - 2), i -> w[i] = w[i + 1])) as bigint))").alias("n_stutter"),
        F.expr("if(size(w) < 3, cast(array() as array<bigint>), transform(sequence(0, size(w) - 3), i -> xxhash64(w[i], w[i + 1], w[i + 2])))").alias("h"),
    )
    # Windows in the order of their hashes, with their places; equal neighbours mark both places.
    t = t.withColumn("some", F.size(F.array_distinct("h")) < F.size("h"))
    t = t.withColumn("order", F.expr("if(some, transform(sort_array(transform(h, (x, i) -> named_struct('x', x, 'i', i))), p -> p.i), cast(array() as array<int>))"))
    t = t.withColumn("marked", F.expr("""
        if(size(order) = 0, order, sort_array(filter(transform(sequence(0, size(order) - 1), k ->
            if((k > 0 and h[order[k]] = h[order[greatest(k, 1) - 1]]) or (k < size(order) - 1 and h[order[k]] = h[order[least(k + 1, size(order) - 1)]]), order[k], -1)), p -> p >= 0)))"""))
    # Windows reach three words; of two that begin closer, the later one adds only the distance.
    covered = "if(size(marked) = 0, 0L, aggregate(marked, named_struct('n', 0L, 'last', -3), (a, p) -> named_struct('n', a.n + least(3, p - a.last), 'last', p), a -> a.n))"
    rest = ("n_lines", "n_upper", "n_bangs", "n_marks", "n_distinct", "n_single", "n_stutter", "ends")
    return t.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", F.expr(covered).cast("long").alias("n_repeat_words"), *rest)


def _vote(good: Column, bad: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0).cast("int")


def rules() -> dict[str, Column]:
    """Votes by name. A text without words gets what its zero counts give."""
    n = F.greatest(F.col("n_words"), F.lit(1))
    per = lambda c: F.col(c) / n
    repeated_lines = F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))
    # Distinct words grow more slowly than the text.
    variety = F.col("n_distinct") / F.pow(n.cast("double"), F.lit(0.8))
    return {
        "length": _vote(F.col("n_words") >= 100, F.col("n_words") < 50),
        "word_length": _vote(per("word_chars").between(4.2, 6.5), (per("word_chars") < 3.5) | (per("word_chars") > 7)),
        "symbols": _vote(per("n_symbols") <= 0.01, per("n_symbols") > 0.05),
        "single": _vote(per("n_single") < 0.1, per("n_single") > 0.25),
        "lines": _vote(F.col("n_dup_lines") == 0, repeated_lines > 0.2),
        "repeats": _vote(per("n_repeat_words") < 0.05, per("n_repeat_words") > 0.25),
        "capitals": _vote(F.col("n_upper") < 0.06 * F.col("word_chars"), F.col("n_upper") > 0.25 * F.col("word_chars")),
        "bangs": _vote(per("n_bangs") < 0.05, per("n_bangs") > 0.25),
        "ending": _vote(F.col("ends"), ~F.col("ends")),
        "variety": _vote(variety > 1.7, variety < 1.2),
        "stutter": _vote(per("n_stutter") < 0.03, per("n_stutter") > 0.1),
        "marks": _vote(per("n_marks").between(0.02, 0.2), (per("n_marks") < 0.01) | (per("n_marks") > 0.3)),
    }


#: For each rule the chances that it votes -1, 0 and 1, on good documents and on bad ones.
Rates = dict[str, tuple[tuple[float, float, float], tuple[float, float, float]]]


def posterior(prior: float, rates: Rates) -> Column:
    """Probability of a good document, of the vote columns."""
    odds = F.lit(math.log(prior / (1 - prior)))
    for name, (good, bad) in rates.items():
        v, gain = F.col(f"vote_{name}"), [math.log(g / b) for g, b in zip(good, bad, strict=True)]
        odds = odds + F.when(v < 0, gain[0]).when(v > 0, gain[2]).otherwise(gain[1])
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-odds))


def maximise(votes: np.ndarray, counts: np.ndarray, *, rounds: int = 500, close: float = 1e-7) -> tuple[float, np.ndarray]:
    """The share of good documents, and rates[class, rule, vote + 1] with class 0 the good one, of patterns met counts times.

    Every rate is (expected votes + 1) / (expected documents + 3), the share (expected good ones + 1) / (documents + 2).
    """
    bad = (votes < 0).sum(axis=1)
    good = np.choose(np.minimum(bad, 2), (0.95, 0.6, 0.1))
    cast = np.stack([votes == o for o in (-1, 0, 1)], axis=2).astype(float)  # pattern, rule, vote
    for _ in range(rounds):
        share = ((good * counts).sum() + 1) / (counts.sum() + 2)
        rates = np.stack([(np.einsum("p,pro->ro", c * counts, cast) + 1) / ((c * counts).sum() + 3) for c in (good, 1 - good)])
        odds = math.log(share / (1 - share)) + np.einsum("pro,ro->p", cast, np.log(rates[0] / rates[1]))
        now = 1 / (1 + np.exp(-np.clip(odds, -700, 700)))
        moved, good = np.abs(now - good).max(initial=0.0), now
        if moved < close:
            break
    return share, rates


def estimate(votes: DataFrame, names: list[str]) -> tuple[float, Rates]:
    """The share of good documents and the rates of each rule, by expectation-maximisation over the distinct patterns."""
    columns = [f"vote_{n}" for n in names]
    rows = sorted(tuple(r) for r in votes.groupBy(*columns).agg(F.count("*").alias("n")).collect())  # at most 3 ** rules
    table = np.array(rows, dtype=np.int64).reshape(len(rows), len(names) + 1)
    share, rates = maximise(table[:, :-1], table[:, -1].astype(float))
    return float(share), {n: (tuple(rates[0, k].tolist()), tuple(rates[1, k].tolist())) for k, n in enumerate(names)}


def fit(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> tuple[float, Rates]:
    """The share of good documents and the rules' rates on a corpus, for ``judge`` on this or another one."""
    return estimate(_votes(df, id_col, text_col), list(rules()))


def _votes(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return settle(counts(df, id_col=id_col, text_col=text_col)).withColumns({f"vote_{n}": v for n, v in rules().items()})


def judge(df: DataFrame, *, keep_from: float = 0.5, least_words: int = 50, fitted: tuple[float, Rates] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts, base_failed, kept and posterior_quality (the posterior, rounded to 6 places) of every row.

    Without a fit, rates are those of df itself, so the verdict is relative to it: what was kept, judged by itself, loses its mildest symptoms again. To judge several tables by one measure, or
    one table twice, pass the fit of one of them.
    """
    votes = _votes(df, id_col, text_col)
    out = votes.withColumn("posterior_quality", F.round(posterior(*(fitted or estimate(votes, list(rules())))), 6))
    out = out.withColumn("base_failed", (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & (F.col("posterior_quality") >= keep_from)).alias("kept"), "posterior_quality")
