"""Sharding by extendible hashing, in DataFrame operations.

A document's key is 63 bits: 32 of a hash of its id, then 31 of a hash of its text. A shard is a prefix of
the key. All documents start in the empty prefix; only a shard over the byte limit splits, on one more bit, until
every shard fits. Splits are read off byte sums of prefixes: sums at one fine depth are added up the tree of
prefixes, and a shard is a prefix that fits while its parent does not. Prefixes over the limit at that depth
(a few hot keys) go on alone at a finer one. The directory, with an entry for each fine prefix, joins documents
to their shards; it is a table, not a driver's dictionary.

Equal rows share all 63 bits. Where they exceed the limit together they go to overflow pages, each of as many
rows as fit, numbered within the tasks that read them. A single document over the limit is a shard of its own.

Nulls: a null text has 0 bytes; a null id hashes as the empty string. Empty tables give no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.llm.textkit import pick, settle

KEY_BITS = 63


def _prefix(depth: int) -> Column:
    return F.shiftright("key", KEY_BITS - depth) if depth else F.lit(0).cast("long")


def _tree(rows: DataFrame, top: int, depth: int) -> DataFrame:
    """(level, p, bytes) for every prefix from level top to depth that rows have."""
    fine = rows.groupBy(_prefix(depth).alias("fine")).agg(F.sum("n_bytes").alias("bytes"))
    up = fine.select(F.explode(F.sequence(F.lit(top), F.lit(depth))).alias("level"), "fine", "bytes")
    return up.groupBy("level", F.expr(f"shiftright(fine, {depth} - level)").alias("p")).agg(F.sum("bytes").alias("bytes"))


def shard(df: DataFrame, *, byte_limit: int = 1 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, shard (the bits of its prefix, then -page for overflow pages), depth of every row."""
    hi = F.conv(F.substring(F.sha2(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), 256), 1, 8), 16, 10).cast("long")
    lo = F.xxhash64("text").bitwiseAND((1 << 31) - 1)
    rows = settle(pick(df, id_col, text_col).select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.shiftleft(hi, 31).bitwiseOR(lo).alias("key")))
    total = rows.agg(F.sum("n_bytes")).first()[0] or 0
    top, left, out = 0, rows, None
    while True:
        depth = min(KEY_BITS, top + max(0, math.ceil(math.log2(max(1, total / byte_limit)))) + 4) if top == 0 else min(KEY_BITS, top + 8)
        tree = settle(_tree(left, top, depth))
        child, parent = tree.alias("c"), tree.alias("p")
        fits = child.filter(F.col("bytes") <= byte_limit).join(parent.filter(F.col("bytes") > byte_limit), F.expr("c.level = p.level + 1 and shiftright(c.p, 1) = p.p"))
        leaves = fits.select("c.level", "c.p")
        if top == 0:
            leaves = leaves.unionByName(tree.filter((F.col("level") == 0) & (F.col("bytes") <= byte_limit)).select("level", "p"))
        entries = leaves.select("level", "p", F.explode(F.expr(f"sequence(shiftleft(p, {depth} - level), shiftleft(p + 1, {depth} - level) - 1)")).alias("fine"))
        named = F.when(F.col("level") == 0, "").otherwise(F.expr("lpad(bin(p), cast(level as int), '0')"))
        done = left.withColumn("fine", _prefix(depth)).join(entries, "fine").select("doc_id", "n_bytes", named.alias("shard"), F.col("level").cast("int").alias("depth"))
        out = done if out is None else out.unionByName(done)
        over = tree.filter((F.col("level") == depth) & (F.col("bytes") > byte_limit)).select(F.col("p").alias("fine"))
        if not over.head(1):
            return out
        left = settle(left.withColumn("fine", _prefix(depth)).join(over, "fine", "left_semi").drop("fine"))
        if depth == KEY_BITS:
            page = F.floor(F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1) / F.greatest(F.lit(1), F.floor(F.lit(byte_limit) / F.greatest(F.col("n_bytes"), F.lit(1)))))
            bits = F.expr(f"lpad(bin(key), {KEY_BITS}, '0')")
            pages = left.sortWithinPartitions("key").select("doc_id", "n_bytes", "key", F.spark_partition_id().alias("task"), page.cast("string").alias("page"))
            return out.unionByName(pages.select("doc_id", "n_bytes", F.concat_ws("-", bits, F.col("task").cast("string"), "page").alias("shard"), F.lit(KEY_BITS).alias("depth")))
        top = depth


def oracle_sql(byte_limit: int = 1 << 20) -> str:
    return f"""
    WITH d AS (SELECT doc_id, coalesce(octet_length(encode(text)), 0)::BIGINT AS n_bytes, ('0x' || substr(sha256(doc_id::VARCHAR), 1, 8))::BIGINT AS h FROM documents),
    l AS (SELECT d.*, r.depth, h >> (32 - r.depth) AS p FROM d, range(0, 25) r(depth)),
    s AS (SELECT *, sum(n_bytes) OVER (PARTITION BY depth, p) AS bytes FROM l)
    SELECT doc_id, n_bytes, CASE WHEN depth = 0 THEN '' ELSE lpad(bin(p), depth::INT, '0') END AS shard, depth::INT AS depth
    FROM s WHERE bytes <= {byte_limit} QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY depth) = 1
    """
