"""First-occurrence dedup, leakage and set operators over normalised hashes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomwork.functions.text import prompt_hash


def with_hash(df: DataFrame, text: str, name: str = "hash") -> DataFrame:
    return df.withColumn(name, prompt_hash(text))


def first_of(df: DataFrame, *keys: str, order: str = "_ord") -> DataFrame:
    """The first row of each key by order.

    ``min_by`` combines on the map side, so a hot key sends one row a task and no task holds its rows.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    return df.groupBy(*keys).agg(F.min_by(row, order).alias("__row")).select("__row.*")


def duplicate_counts(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def cross_split_collisions(df: DataFrame, key: str = "hash", split: str = "split") -> DataFrame:
    """Keys that occur in more than one split."""
    return df.groupBy(key).agg(F.count_distinct(split).alias("n_splits"), F.count("*").alias("n_rows")).filter("n_splits > 1")


def leaked(df: DataFrame, reference: DataFrame, key: str) -> DataFrame:
    """Rows whose key the reference also has."""
    return df.join(reference.select(key).distinct(), key, "left_semi")


def missing(wanted: DataFrame, have: DataFrame, key: str) -> DataFrame:
    return wanted.join(have.select(key), key, "left_anti")


def union_all(*parts: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def distinct_in_order(df: DataFrame, key: str, order: str = "_ord") -> DataFrame:
    return df.groupBy(key).agg(F.min(order).alias(order))


def consecutive(turns: DataFrame, role: str) -> DataFrame:
    """Turns whose predecessor in the conversation has the same given role."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    return turns.withColumn("previous", F.lag("role").over(w)).filter((F.col("role") == role) & (F.col("previous") == role)).drop("previous")
