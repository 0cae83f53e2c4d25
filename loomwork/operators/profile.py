"""Length profiles: three definitions of a percentile, cubes, overflow tables and a recommendation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Thresholds of the overflow table.
THRESHOLDS = (512, 768, 1024, 1536, 2048, 4096)


def _p(c: str, p: float, kind: str) -> Column:
    if kind == "nearest":
        return F.expr(f"percentile_disc({p}) within group (order by {c})").cast("double")
    if kind == "linear":
        return F.percentile(c, F.lit(p)).cast("double")
    raise ValueError(kind)


def length_stats(df: DataFrame, value: str, *by: str, kind: str = "linear", points: tuple[float, ...] = (0.5, 0.9, 0.95, 0.99)) -> DataFrame:
    """count, min, mean, max and percentiles. kind: nearest (rank ceil(p*n)), linear (between ranks), or index
    (the rank round((n-1)*p), halves to even).

    Length values repeat, so exact percentiles keep (value, count) pairs and not rows; index percentiles are
    read off a cumulative count of distinct values in the same way.
    """
    base = [F.count("*").alias("n"), F.min(value).cast("double").alias("min"), F.round(F.avg(value), 6).alias("mean"), F.max(value).cast("double").alias("max")]
    names = [f"p{round(p * 100)}" for p in points]
    if kind != "index":
        return df.groupBy(*by).agg(*base, *[F.round(_p(value, p, kind), 6).alias(n) for p, n in zip(points, names, strict=True)])
    from pyspark.sql import Window

    w = Window.partitionBy(*by).orderBy(value)
    seen = df.groupBy(*by, value).agg(F.count("*").alias("c")).withColumn("upto", F.sum("c").over(w))
    total = F.sum("c").over(Window.partitionBy(*by))
    seen = seen.withColumn("total", total)
    at = lambda p: F.min(F.when(F.col("upto") > F.bround((F.col("total") - 1) * F.lit(p), 0), F.col(value))).cast("double")
    return seen.groupBy(*by).agg(F.sum("c").alias("n"), F.min(value).cast("double").alias("min"), F.round(F.sum(F.col(value) * F.col("c")) / F.sum("c"), 6).alias("mean"), F.max(value).cast("double").alias("max"), *[at(p).alias(n) for p, n in zip(points, names, strict=True)])


def length_cube(df: DataFrame, value: str, a: str, b: str) -> DataFrame:
    """Linear length stats overall, by a, by b and by both; '*' stands for all."""
    out = df.cube(a, b).agg(
        F.count("*").alias("n"), F.min(value).cast("double").alias("min"), F.round(F.avg(value), 6).alias("mean"), F.max(value).cast("double").alias("max"),
        F.round(F.percentile(value, F.lit(0.5)), 6).alias("p50"), F.round(F.percentile(value, F.lit(0.95)), 6).alias("p95"),
        F.grouping(a).alias("__a"), F.grouping(b).alias("__b"),
    )
    return out.withColumn(a, F.when(F.col("__a") == 1, "*").otherwise(F.col(a))).withColumn(b, F.when(F.col("__b") == 1, "*").otherwise(F.col(b))).drop("__a", "__b")


def overflow_cube(df: DataFrame, value: str, a: str, b: str, thresholds: tuple[int, ...] = THRESHOLDS) -> DataFrame:
    """Rows over each threshold, overall and by a and b. One pass: a counter a threshold, then a row for each."""
    wide = df.cube(a, b).agg(F.count("*").alias("n"), *[F.count_if(F.col(value) > t).alias(f"over_{t}") for t in thresholds], F.grouping(a).alias("__a"), F.grouping(b).alias("__b"))
    long = wide.select(
        F.when(F.col("__a") == 1, "*").otherwise(F.col(a)).alias(a), F.when(F.col("__b") == 1, "*").otherwise(F.col(b)).alias(b), "n",
        F.explode(F.array(*[F.struct(F.lit(t).alias("threshold"), F.col(f"over_{t}").alias("n_over")) for t in thresholds])).alias("t"),
    )
    return long.select(a, b, F.col("t.threshold").cast("long").alias("threshold"), "n", F.col("t.n_over").alias("n_over"), F.round(F.col("t.n_over") / F.col("n"), 8).alias("ratio"))


def recommend_max_length(df: DataFrame, value: str, thresholds: tuple[int, ...] = THRESHOLDS) -> DataFrame:
    """The least threshold that no row exceeds, or the largest one; long_tail says how many rows it leaves over."""
    most = F.max(value)
    best = F.coalesce(*[F.when(most <= t, t) for t in sorted(thresholds)], F.lit(max(thresholds)))
    return df.agg(best.cast("long").alias("max_length"), F.count_if(F.col(value) > max(thresholds)).alias("long_tail"), F.max(value).cast("long").alias("longest"))


def longest(df: DataFrame, value: str, key: str, n: int = 20) -> DataFrame:
    return df.orderBy(F.desc(value), F.asc(key)).limit(n)
