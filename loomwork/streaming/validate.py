"""Row-local validators over streams: validate, then dedup by prompt hash within a watermark.

Quotas and percentiles need all rows and stay batch operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.functions.text import prompt_hash


def validated(rows: DataFrame, prompt: str, time: str, *, late: str = "10 minutes") -> DataFrame:
    """Rows with a non-blank prompt, once for each prompt hash within the watermark. Batch tables pass too."""
    out = rows.withColumn("hash", prompt_hash(prompt)).filter(F.col("hash") != F.sha2(F.lit(""), 256))
    if not out.isStreaming:
        return out.dropDuplicates(["hash"])
    return out.withWatermark(time, late).dropDuplicatesWithinWatermark(["hash"])


def windowed_counts(rows: DataFrame, time: str, key: str, *, late: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """Counts by key and tumbling window; late rows within the watermark still count."""
    if rows.isStreaming:
        rows = rows.withWatermark(time, late)
    return rows.groupBy(F.window(time, window).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), key, "n")


def start(rows: DataFrame, path: str, checkpoint: str):
    """Writes a validated stream as Parquet; runs until stopped or, with available input only, until it is read."""
    return rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
