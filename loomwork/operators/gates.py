"""Gates computed from metrics tables, manifests and file digests. A gate is never an input flag."""

from __future__ import annotations

import json
import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.functions.session import settle
from loomwork.functions.streams import digests
from loomwork.operators.split import rank_within


def overfit_gate(losses: DataFrame, step: str = "step", loss: str = "loss") -> DataFrame:
    """passed: the last loss is below 0.8 of the first."""
    return losses.agg(F.min_by(loss, step).alias("first_loss"), F.max_by(loss, step).alias("last_loss")).withColumn("passed", F.coalesce(F.col("last_loss") < 0.8 * F.col("first_loss"), F.lit(False)))


def stop_gate(predictions: DataFrame, max_new: int) -> DataFrame:
    """passed: every generation ended by itself before the limit."""
    ok = F.col("stop_reason").isin("im_end", "endoftext") & (F.col("generated_tokens") < max_new)
    return predictions.agg(F.count("*").alias("n"), F.count_if(ok).alias("n_ok")).withColumn("passed", (F.col("n") > 0) & (F.col("n") == F.col("n_ok")))


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """path, n_bytes and SHA-256 of each file; equal before and after says that the data did not change.

    Spark lists the files (empty ones it leaves out); each is read as a stream by one task, of whatever size it is.
    """
    files = spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("n_bytes"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return files.repartition(n, "path").mapInArrow(digests, "path string, n_bytes long, sha256 string")


def hash_trees(df: DataFrame, split: str, line: Column, order: str, *, fanout: int = 1024) -> DataFrame:
    """split, n, root: a tree of SHA-256 over the lines of each split in order.

    A node is the hash of the texts of up to ``fanout`` nodes below it, in order; the lines' hashes are the leaves, and a split's one node is its root. The root depends on lines and order alone, not on
    files, parts or partitions. A level is one grouping by place, of fanout rows a group; there are as many levels as fanout has to be raised to reach the rows.
    """
    ranked = rank_within(df.select(F.col(split).alias("split"), F.col(order).alias("order"), F.sha2(line, 256).alias("h")), "split", "order")
    nodes = settle(ranked.select("split", (F.col("rank") - 1).alias("i"), "h"))
    sizes = settle(nodes.groupBy("split").agg(F.count("*").alias("n")))
    left = sizes.agg(F.max("n")).first()[0] or 0
    while left > 1:
        above = nodes.groupBy("split", F.floor(F.col("i") / fanout).alias("i")).agg(F.array_sort(F.collect_list(F.struct("i", "h"))).alias("all"))
        # A split that is down to its root stays as it is.
        alone = (F.col("i") == 0) & (F.size("all") == 1)
        nodes = above.select("split", "i", F.when(alone, F.get("all", F.lit(0))["h"]).otherwise(F.sha2(F.array_join(F.transform("all", lambda x: x["h"]), ""), 256)).alias("h"))
        left = -(-left // fanout)
    return sizes.join(nodes.select("split", F.col("h").alias("root")), "split")


def manifest(df: DataFrame, split: str, key: str, seed: int) -> DataFrame:
    """A row a split: count, least and greatest key, and an order-free digest of its keys."""
    return df.groupBy(split).agg(
        F.count("*").alias("n"), F.min(key).alias("first"), F.max(key).alias("last"),
        F.sum(F.conv(F.substring(F.sha2(F.col(key).cast("string"), 256), 1, 8), 16, 10).cast("long")).alias("digest"), F.lit(seed).cast("long").alias("seed"),
    )


def write_json(path: str, value: object) -> None:
    """Atomic: a reader sees the old file or the new one."""
    own = f"{path}.{os.getpid()}.tmp"
    with open(own, "w", encoding="utf-8") as f:
        json.dump(value, f, ensure_ascii=False, indent=2, sort_keys=True)
    os.replace(own, path)


def markdown_table(df: DataFrame, limit: int = 200) -> str:
    """A result as a Markdown table; of a longer one the first rows, and a line that says how many there are."""
    rows = df.limit(limit + 1).collect()
    head = "| " + " | ".join(df.columns) + " |\n|" + "---|" * len(df.columns)
    lines = [head, *("| " + " | ".join("" if v is None else str(v).replace("|", "\\|").replace("\n", " ") for v in r) + " |" for r in rows[:limit])]
    if len(rows) > limit:
        lines += ["", f"The first {limit} of {df.count()} rows."]
    return "\n".join(lines) + "\n"
