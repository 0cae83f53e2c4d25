"""Connected components and skew-safe joins on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.llm.textkit import settle, tidy

HOT_SHARE = 1000
#: Links in a partition, where there are fewer than the session's partitions would hold; so many partitions at least.
LINKS, LEAST = 50_000, 8


def shuffled(df: DataFrame) -> DataFrame:
    """df for a join that shuffles both sides, whatever size Spark takes it for.

    Spark broadcasts what it sizes under ``spark.sql.autoBroadcastJoinThreshold``, by estimates that leave out what an explode or a function adds, or by the compressed
    bytes of a shuffle; the driver holds it several times as large. Only tables with a bound of their own are broadcast, and say so.
    """
    return df.hint("merge")


def skew_join(left: DataFrame, right: DataFrame, key: str, count: str, how: str = "inner") -> DataFrame:
    """Joins many rows of ``left`` to the one row a key of ``right``, whose ``count`` says how many rows of left it meets.

    Keys that meet at least a 1000th of all counted rows (so 1000 of them at most) are broadcast; the others
    shuffle. Both inputs are read twice, so they should be settled. ``count`` is not in the result.
    """
    total = right.agg(F.sum(count)).first()[0] or 0
    least = max(2, -(-total // HOT_SHARE))
    hot, cold = right.filter(F.col(count) >= least).drop(count), right.filter(F.col(count) < least).drop(count)
    if not hot.head(1):
        return left.join(shuffled(right.drop(count)), key, how)
    met = left.join(F.broadcast(hot), key)
    rest = left.join(F.broadcast(hot.select(key)), key, "left_anti").join(shuffled(cold), key, how)
    return met.unionByName(rest)


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(node, root) of every node that has a link; root is the least node of its component.

    Alternates large-star and small-star steps until the edges stop changing; each round is settled in the
    shared folder. Hubs are met by ``skew_join``, so no task holds a hub's links together. Rounds take no more partitions
    than their links need, and what they leave on disk goes with them.
    """
    e = settle(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct())
    state, parts = None, max(LEAST, e.count() // LINKS)
    for _ in range(rounds):
        e = e.coalesce(parts)
        both = settle(e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))))
        low = settle(both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).withColumn("m", F.least("m", "u")))
        large = settle(skew_join(both.filter("v > u"), low, "u", "n").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct())
        low = settle(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")))
        small = skew_join(large, low, "u", "n").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")).filter("u <> v")
        e = settle(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == state:
            break
        state, parts = now, max(LEAST, now[0] // LINKS)
        tidy(e.sparkSession)
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))


def with_roots(roots: DataFrame) -> DataFrame:
    """Adds each root as a node of its own."""
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
