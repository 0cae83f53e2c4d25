"""Assembly of a mixture: candidate pools by split and category, filled under quotas with no prompt twice anywhere."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.functions.text import prompt_hash
from loomwork.operators.generate import generate
from loomwork.operators.select import quota_select, require_filled


def pools(spark: SparkSession, quotas: dict[str, dict[str, int]], *, buffer: float = 3.0, seed: int = 42, extra: DataFrame | None = None, ids: DataFrame | None = None) -> DataFrame:
    """Candidates of every (split, category): generated ones, each split under a seed of its own, and the rows of extra.

    A category has buffer times its quota of draws, or one for each of the ids.
    """
    parts = [
        generate(spark, c, int(q * buffer) + 20 if ids is None else ids, seed + i).select(F.lit(s).alias("split"), "category", "user", "answer", F.col("id").alias("_ord"))
        for i, (s, of) in enumerate(quotas.items()) for c, q in of.items() if extra is None or c not in set(extra_categories(extra))
    ]
    if extra is not None:
        parts.append(extra.select("split", "category", "user", "answer", "_ord"))
    rows = reduce(lambda a, b: a.unionByName(b), parts)
    return rows.withColumn("hash", prompt_hash("user")).withColumn("bucket", F.concat_ws("/", "split", "category"))


def extra_categories(extra: DataFrame) -> list[str]:
    return [r[0] for r in extra.select("category").distinct().collect()]


def assemble(candidates: DataFrame, quotas: dict[str, dict[str, int]]) -> DataFrame:
    """Rows of all splits in quota order; a bucket that cannot be filled is an error that names all of them."""
    flat = {f"{s}/{c}": q for s, of in quotas.items() for c, q in of.items()}
    return require_filled(quota_select(candidates, flat), flat)


def stats(mixture: DataFrame) -> DataFrame:
    return mixture.groupBy("split", "category").agg(F.count("*").alias("n"), F.count_distinct("hash").alias("n_prompts"), F.round(F.avg(F.char_length("user")), 6).alias("mean_chars"))


def think_stats(rows: DataFrame) -> DataFrame:
    """Rows of each category (category, thinking, user): with and without a thought, and mean characters asked."""
    return rows.groupBy("category").agg(F.count("*").alias("n"), F.count_if("thinking").alias("n_thinking"), F.count_if(~F.col("thinking")).alias("n_plain"), F.round(F.avg(F.char_length("user")), 6).alias("mean_chars"))
