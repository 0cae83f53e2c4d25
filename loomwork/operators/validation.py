"""Row validation: issues as columns, counted once; strict mode raises after one aggregate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.functions.session import settle
from loomwork.functions.text import WS, count_words, looks_clean, lstrip, starts_with_any

# Issue names, preferred replay categories and refusal openings.
ISSUES = ("duplicate_id", "duplicate_prompt", "empty_answer", "empty_prompt", "invalid_id", "multiline_answer", "answer_outer_whitespace", "prompt_outer_whitespace")
REFUSALS = ("i'm sorry", "i’m sorry", "i cannot")
OUTER_WS = rf"\A{WS}|{WS}\z"


#: A key that so large a part of all repeated rows has is hot: there can be no more such keys than this.
HOT = 1000


def repeated(df: DataFrame, key: str, order: str, name: str) -> DataFrame:
    """df with a flag for rows whose key an earlier row has; rows without a key are of one key.

    First rows are aggregates, a row a key that repeats. Rows meet them by the key's hash: hot keys by broadcast, so that their rows stay where they are, the others in a
    shuffle in which rows of hot keys go by their own place.
    """
    h = F.coalesce(F.sha2(F.col(key).cast("string"), 256), F.lit(""))
    firsts = settle(df.groupBy(h.alias("__h")).agg(F.min(order).alias("__first"), F.count("*").alias("__n")).filter("__n > 1"))
    least = max(2, -(-(firsts.agg(F.sum("__n")).first()[0] or 0) // HOT))
    hot = F.broadcast(firsts.filter(F.col("__n") >= least).select("__h", F.col("__first").alias("__hot")))
    cold = firsts.filter(F.col("__n") < least).select(F.col("__h").alias("__c"), F.col("__first").alias("__cold"))
    met = df.withColumn("__h", h).join(hot, "__h", "left")
    met = met.withColumn("__c", F.when(F.col("__hot").isNull(), F.col("__h")).otherwise(F.concat(F.lit("at "), F.col(order).cast("string")))).join(cold, "__c", "left")
    return met.withColumn(name, F.coalesce(F.col(order) > F.coalesce("__hot", "__cold"), F.lit(False))).drop("__h", "__c", "__hot", "__cold")


def basic_issues(df: DataFrame, id_col: str = "id", prompt: str = "prompt", answer: str = "answer", order: str = "_ord", id_pattern: str = "[0-9a-f]{8}") -> DataFrame:
    """Adds issues: the array of what is wrong with a row."""
    a, p, i = F.coalesce(F.col(answer), F.lit("")), F.coalesce(F.col(prompt), F.lit("")), F.coalesce(F.col(id_col), F.lit(""))
    blank = lambda c: ~c.rlike(rf"[^{WS[1:-1]}]")
    names = df.columns
    df = repeated(repeated(df, id_col, order, "__id_again"), prompt, order, "__prompt_again")
    found = [
        F.when(~i.rlike(rf"\A(?:{id_pattern})\z"), "invalid_id"),
        F.when(F.col("__id_again"), "duplicate_id"),
        F.when(blank(p), "empty_prompt"),
        F.when(blank(a), "empty_answer"),
        F.when(F.col("__prompt_again"), "duplicate_prompt"),
        F.when(p.rlike(OUTER_WS), "prompt_outer_whitespace"),
        F.when(a.rlike(OUTER_WS), "answer_outer_whitespace"),
        F.when(a.rlike(r"[\n\r]"), "multiline_answer"),
    ]
    return df.select(*[df[c] for c in names], F.array_compact(F.array(*found)).alias("issues"))


def issue_counts(df: DataFrame) -> DataFrame:
    return df.select(F.explode("issues").alias("issue")).groupBy("issue").agg(F.count("*").alias("n"))


def raise_on(df: DataFrame, error: str = "error") -> DataFrame:
    """df unchanged, or ValueError with the counts of its errors: the 20 most frequent kinds by name, and how many rows have other kinds."""
    kinds = df.filter(F.col(error).isNotNull()).groupBy(error).count()
    bad = kinds.orderBy(F.desc("count"), error).limit(20).collect()
    if bad:
        n, rows = kinds.agg(F.count("*"), F.sum("count")).first()
        others = [f"{n - len(bad)} other kinds x {rows - sum(r[1] for r in bad)}"] if n > len(bad) else []
        raise ValueError("invalid rows: " + ", ".join([*(f"{r[0]} x {r[1]}" for r in bad), *others]))
    return df


def replay_reject_reason(user: Column, assistant: Column, *, least_words: int = 50, most_words: int = 250, most_user: int = 2500, distinct: int = 8) -> Column:
    """Why a pair is not fit for replay, first reason first; null where it is."""
    words = count_words(assistant)
    opening = F.lower(lstrip(assistant))
    return (
        F.when(user.isNull() | assistant.isNull(), "missing_role")
        .when(F.char_length(user) >= most_user, "user_too_long")
        .when((words < least_words) | (words > most_words), "words_out_of_range")
        .when(starts_with_any(opening, REFUSALS), "refusal")
        .when(~looks_clean(user, distinct) | ~looks_clean(assistant, distinct), "dirty_text")
    )


def unique_ids(df: DataFrame, id_col: str = "id") -> DataFrame:
    """Ids that occur more than once."""
    return df.groupBy(id_col).agg(F.count("*").alias("n")).filter("n > 1")


def quota_mismatches(df: DataFrame, category: str, quotas: DataFrame) -> DataFrame:
    """Categories whose count is not their quota; either side may lack a category."""
    have = df.groupBy(F.col(category).alias("category")).agg(F.count("*").alias("have"))
    met = have.join(quotas.select("category", F.col("quota").cast("long").alias("quota")), "category", "full_outer").na.fill(0, ["have", "quota"])
    return met.filter("have <> quota")
