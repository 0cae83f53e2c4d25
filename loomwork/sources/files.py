"""Strict readers and writers.

Row order is part of the data model: ``_ord`` grows with the file's place in name order and with the place in the file, so
it does not depend on the partitioning of later steps.
"""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwork.functions.session import settle
from loomwork.functions.text import strip

MESSAGE = T.ArrayType(T.StructType([T.StructField("role", T.StringType()), T.StructField("content", T.StringType())]))


def _ordered(df: DataFrame) -> DataFrame:
    """_ord in file order. Splits of one file come to the partitions in their order, so a running number serves there.

    Splits of several files are dealt out by size. Their rows are settled with path and running number, and each (path,
    partition) starts where the one before it in that order ends: the driver sees a count a split.
    """
    if len(df.inputFiles()) < 2:
        return df.withColumn("_ord", F.monotonically_increasing_id())
    rows = settle(df.select("*", F.col("_metadata.file_path").alias("__path"), F.monotonically_increasing_id().alias("__at")))
    part = F.shiftright("__at", 33)
    splits = sorted(tuple(r) for r in rows.groupBy("__path", part.alias("p")).agg(F.min("__at").alias("lo"), F.count("*").alias("n")).collect())
    starts, total = [], 0
    for path, p, lo, n in splits:
        starts.append((path, p, total - lo))
        total += n
    known = F.broadcast(df.sparkSession.createDataFrame(starts, "__in string, __p long, __shift long"))
    return rows.join(known, (F.col("__path") == F.col("__in")) & (part == F.col("__p"))).withColumn("_ord", F.col("__at") + F.col("__shift")).drop("__path", "__at", "__in", "__p", "__shift")


def read_csv(spark: SparkSession, path: str, columns: tuple[str, ...] = ("id", "prompt", "answer")) -> DataFrame:
    """CSV whose header is exactly the columns, in order. A row with more fields is an error; missing last fields are null."""
    head = spark.read.text(path).limit(1).collect()
    names = next(csv.reader(io.StringIO(head[0][0]))) if head else []
    if tuple(names) != columns:
        raise ValueError(f"header must be {','.join(columns)}, is {','.join(names)}")
    extra = "_extra"
    schema = T.StructType([T.StructField(c, T.StringType()) for c in (*columns, extra)])
    rows = spark.read.schema(schema).option("header", True).option("multiLine", True).option("enforceSchema", True).option("escape", '"').option("mode", "PERMISSIVE").csv(path)
    if bad := rows.filter(F.col(extra).isNotNull()).count():
        raise ValueError(f"{bad} rows have more fields than the header")
    return _ordered(rows.drop(extra))


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType, required: tuple[str, ...] = (), *, split: str | None = None, allow_empty: bool = True) -> DataFrame:
    """JSON lines: blank lines are skipped, every other line must be an object, required fields must be present and not
    null, fields outside the schema are dropped."""
    lines = _ordered(spark.read.text(path)).filter(F.char_length(strip("value")) > 0)
    parsed = lines.select("_ord", F.from_json("value", T.StructType([*schema.fields, T.StructField("_bad", T.StringType())]), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r"))
    missing = F.array_compact(F.array(F.when(F.col("r._bad").isNotNull() | F.col("r").isNull(), "invalid_json"), *[F.when(F.col(f"r.`{c}`").isNull(), f"missing:{c}") for c in required]))
    checked = parsed.withColumn("_error", F.get(missing, F.lit(0)))
    bad = checked.filter("_error is not null").groupBy("_error").count().collect()
    if bad:
        raise ValueError("invalid lines: " + ", ".join(f"{r[0]} x {r[1]}" for r in sorted(bad)))
    out = checked.select("r.*", "_ord").drop("_bad")
    if not allow_empty and not out.head(1):
        raise ValueError(f"no rows in {path}")
    return out if split is None else out.withColumn("split", F.lit(split))


def read_conversations(spark: SparkSession, path: str) -> DataFrame:
    schema = T.StructType([T.StructField(c, T.StringType()) for c in ("id", "prompt_id", "category")] + [T.StructField("messages", MESSAGE)])
    return read_jsonl(spark, path, schema, ("messages",), allow_empty=False)


VALIDATOR = "struct<type:string,value:string,pattern:string,json_value:string,count:int,values:array<string>,max_words:int,max_lines:int>"
# The kinds of validators.
VALIDATORS = ("exact", "regex", "json", "line_count", "contains")


def read_instruction_eval(spark: SparkSession, path: str, split: str) -> DataFrame:
    """id, category, messages, validator, split of an evaluation set: every field there, known roles with texts, messages of two
    fields, a known validator, and ids that occur once; else ValueError with the counts of what is wrong."""
    lines = _ordered(spark.read.text(path)).filter(F.char_length(strip("value")) > 0)
    fields = T.StructType([T.StructField(c, T.StringType()) for c in ("id", "category", "messages", "validator", "_bad")])
    raw = lines.select("_ord", "value", F.from_json("value", fields, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r"))
    each = F.from_json("r.messages", "array<map<string,string>>")
    rows = raw.select("_ord", "r.id", "r.category", F.from_json("r.messages", MESSAGE).alias("messages"), F.from_json("r.validator", VALIDATOR).alias("validator"), each.alias("__each"), (F.col("r").isNull() | F.col("r._bad").isNotNull()).alias("__bad"))
    odd = F.exists("__each", lambda m: (F.size(m) != 2) | ~F.map_contains_key(m, "role") | ~F.map_contains_key(m, "content"))
    error = (
        F.when(F.col("__bad"), "invalid_json").when(F.coalesce("id", F.lit("")) == "", "invalid_id").when(F.coalesce("category", F.lit("")) == "", "invalid_category").when(F.coalesce(F.size("messages"), F.lit(0)) < 1, "no_messages")
        .when(F.coalesce(odd, F.lit(True)), "invalid_message").when(F.exists("messages", lambda m: m["role"].isNull() | ~m["role"].isin("system", "user", "assistant")), "unsupported_role")
        .when(F.exists("messages", lambda m: m["content"].isNull()), "content_not_text").when(F.coalesce(~F.col("validator.type").isin(*VALIDATORS), F.lit(True)), "unsupported_validator")
    )
    checked = rows.withColumn("error", error)
    bad = {r[0]: r[1] for r in checked.filter("error is not null").groupBy("error").count().collect()}
    if twice := checked.groupBy("id").count().filter("count > 1").count():
        bad["duplicate_id"] = twice
    if bad:
        raise ValueError("invalid records: " + ", ".join(f"{k} x {n}" for k, n in sorted(bad.items())))
    if not checked.head(1):
        raise ValueError(f"no evaluation records in {path}")
    return checked.select("id", "category", "messages", "validator", "_ord").withColumn("split", F.lit(split))


def read_problem_files(spark: SparkSession, folder: str, schema: T.StructType, pattern: str = "*.jsonl") -> DataFrame:
    """The first line of each file of a folder whose name fits the pattern, with the file's name."""
    lines = spark.read.text(f"{folder}/{pattern}").select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    first = lines.filter("block = 0").groupBy("path", "file").agg(F.min_by("value", "at").alias("value"))
    return first.select("file", F.from_json("value", schema).alias("r")).select("file", "r.*")


def read_words(spark: SparkSession, path: str) -> DataFrame:
    """The distinct words of a list, a word a line, blanks cut off."""
    return spark.read.text(path).select(strip("value").alias("word")).filter("word <> ''").distinct()


def read_splits(spark: SparkSession, paths: dict[str, str], schema: T.StructType, required: tuple[str, ...]) -> DataFrame:
    """Several splits as one table with a split column."""
    from functools import reduce

    return reduce(lambda a, b: a.unionByName(b), [read_jsonl(spark, p, schema, required, split=s, allow_empty=False) for s, p in paths.items()])


def read_pool(spark: SparkSession, path: str, key: str = "pool") -> DataFrame:
    """Ids of a manifest that is a list or an object with a list under key: distinct, in order."""
    whole = spark.read.option("wholetext", True).text(path)
    listed = F.coalesce(F.from_json("value", "array<string>"), F.from_json(F.get_json_object("value", f"$.{key}"), "array<string>"))
    return whole.select(F.posexplode(listed).alias("_ord", "id")).groupBy("id").agg(F.min("_ord").alias("_ord"))


def scan_with_pool(rows: DataFrame, pool: DataFrame, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """(rows whose key the pool has, pool keys that no row has)."""
    return rows.join(pool.select(key), key, "left_semi"), pool.select(key).join(rows.select(key), key, "left_anti")


def write_jsonl(df: DataFrame, path: str, columns: tuple[str, ...], order: str = "_ord", *, single_file: bool = False) -> None:
    """One compact JSON object a line, in order over the parts by name. A single file is written by one task: for small exports only."""
    rows = df.orderBy(order).select(F.to_json(F.struct(*columns)).alias("value"))
    (rows.coalesce(1) if single_file else rows).write.mode("errorifexists").text(path)


def probe(df: DataFrame, candidates: tuple[str, ...]) -> tuple[Column, Column]:
    """(text, name) of the first candidate column that a row fills; columns that the table lacks are passed over."""
    have = [c for c in candidates if c in df.columns]
    if not have:
        return F.lit(None).cast("string"), F.lit(None).cast("string")

    def text(c: str) -> Column:
        kind = df.schema[c].dataType
        if isinstance(kind, T.ArrayType):
            one = (lambda x: x["content"]) if isinstance(kind.elementType, T.StructType) else (lambda x: x)
            value = F.array_join(F.transform(F.col(c), one), "\n")
        else:
            value = F.col(c).cast("string")
        return F.when(F.char_length(strip(value)) > 0, value)

    return F.coalesce(*[text(c) for c in have]), F.coalesce(*[F.when(text(c).isNotNull(), c) for c in have])


def external_reject_reason(question: Column, reasoning: Column, answer: Column, *, most_total: int = 512) -> Column:
    """Why an external reasoning record is left out, first reason first; null where it is kept."""
    from loomwork.functions.text import contains_any, looks_clean, token_estimate

    # Markers of open-ended questions.
    markers = ("write an essay", "write a story", "write a poem", "in your own words, describe", "do you agree", "what is your opinion", "discuss your views")
    q, r, a = token_estimate(question), token_estimate(reasoning), token_estimate(answer)
    return (
        F.when(~looks_clean(question) | ~looks_clean(reasoning), "dirty_text")
        .when(reasoning.rlike("<[a-zA-Z/][^>]*>"), "html_in_reasoning")
        .when((r < 40) | (r > 300), "reasoning_tokens_out_of_range")
        .when(a > 64, "answer_too_long").when(q + r + a > most_total, "total_too_long")
        .when(F.char_length(question) > 1200, "prompt_too_long").when(F.char_length(answer) > 400, "answer_chars_too_long")
        .when(contains_any(F.lower(question), markers), "open_ended")
    )
