"""Reasoning records of unknown shape, as variants: fields are found by name and by what they hold in each row.

A field may be a text in one row, a list of texts or messages in the next, and an object in a third; no schema is declared or inferred over the file. A text is itself; of a list
the texts of its items, or of their content or else text, are joined by line breaks; of an object the first known field that holds a text counts. Numbers, truth values and nulls hold no text.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.functions.text import let, prompt_hash, strip
from loomwork.sources.files import _ordered, external_reject_reason

# Names of fields that hold questions, reasonings and answers, in the order in which they are looked up.
QUESTIONS = ("question", "input", "instruction", "prompt", "problem", "query", "source")
REASONINGS = ("rationale", "reasoning", "cot", "explanation", "thoughts", "thinking", "deep_thinking", "solution", "response")
ANSWERS = ("answer", "output", "target", "final_answer", "final", "ground_truth", "gold")
IDS = ("id", "prompt_id", "_id")


def read_variants(spark: SparkSession, path: str) -> DataFrame:
    """record (variant), _ord of JSON lines; blank lines are skipped, a line that is no object is an error."""
    rows = _ordered(spark.read.text(path)).filter(F.char_length(strip("value")) > 0).select(F.try_parse_json("value").alias("record"), "_ord")
    bad = rows.filter(F.col("record").isNull() | ~F.schema_of_variant("record").startswith("OBJECT")).count()
    if bad:
        raise ValueError(f"{bad} lines are no objects")
    return rows


def _string(v: Column) -> Column:
    return F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))


def _field(v: Column, name: str) -> Column:
    return F.try_variant_get(v, f"$.{name}", "variant")


def text_of(v: Column) -> Column:
    """The text that a variant holds, or null."""

    def of_item(x: Column) -> Column:
        return F.coalesce(_string(x), F.when(F.schema_of_variant(x).startswith("OBJECT"), F.coalesce(_string(_field(x, "content")), _string(_field(x, "text")))))

    def of_list(x: Column) -> Column:
        parts = F.filter(F.transform(F.try_variant_get(x, "$", "array<variant>"), of_item), lambda p: p.isNotNull())
        return let(parts, lambda p: F.when(F.size(p) > 0, F.array_join(p, "\n")))

    def of_object(x: Column) -> Column:
        return F.coalesce(*[_string(_field(x, n)) for n in (*ANSWERS, *REASONINGS, *QUESTIONS)])

    kind = F.schema_of_variant(v)
    return F.when(v.isNull() | (kind == "VOID"), None).when(kind == "STRING", F.try_variant_get(v, "$", "string")).when(kind.startswith("ARRAY"), of_list(v)).when(kind.startswith("OBJECT"), of_object(v))


def _found(record: Column, names: tuple[str, ...]) -> Column:
    """struct(text, field): the first field with a text that is not blank, and the name of the first that has any text."""
    texts = F.array(*[F.struct(text_of(_field(record, n)).alias("text"), F.lit(n).alias("field")) for n in names])
    first = lambda t, keep: F.get(F.filter(t, keep), F.lit(0))
    return let(texts, lambda t: F.struct(first(t, lambda x: F.char_length(strip(x["text"])) > 0)["text"].alias("text"), F.coalesce(first(t, lambda x: F.char_length(x["text"]) > 0)["field"], F.lit("")).alias("field")))


def adapt(records: DataFrame) -> DataFrame:
    """question, reasoning, answer (stripped), fields_used, original_id, prompt_hash, status and _ord of every record.

    status is missing_question, missing_reasoning or missing_answer, the first that holds; duplicate_question for a question that an earlier sound record has; else null.
    """
    r = F.col("record")
    rows = records.select("_ord", _found(r, QUESTIONS).alias("q"), _found(r, REASONINGS).alias("r"), _found(r, ANSWERS).alias("a"), F.coalesce(*[F.try_variant_get(r, f"$.{n}", "string") for n in IDS], F.lit("")).alias("original_id"))
    missing = F.when(F.col("q.text").isNull(), "missing_question").when(F.col("r.text").isNull(), "missing_reasoning").when(F.col("a.text").isNull(), "missing_answer")
    used = F.create_map(F.lit("question"), F.col("q.field"), F.lit("reasoning"), F.col("r.field"), F.lit("answer"), F.col("a.field"))
    rows = rows.select("_ord", strip("q.text").alias("question"), strip("r.text").alias("reasoning"), strip("a.text").alias("answer"), used.alias("fields_used"), "original_id", missing.alias("missing")).withColumn("prompt_hash", prompt_hash("question"))
    first = rows.filter("missing IS NULL").groupBy("prompt_hash").agg(F.min("_ord").alias("_ord"), F.lit(True).alias("first"))
    met = rows.join(first, ["prompt_hash", "_ord"], "left")
    return met.withColumn("status", F.coalesce("missing", F.when(F.col("first").isNull(), "duplicate_question"))).drop("missing", "first")


def candidates(adapted: DataFrame, *, most_total: int = 512) -> DataFrame:
    """Sound records that pass the filter of reasoning records; ``reject_reason`` of the others says why they do not."""
    why = external_reject_reason(F.col("question"), F.col("reasoning"), F.col("answer"), most_total=most_total)
    return adapted.filter("status IS NULL").withColumn("reject_reason", why)


def field_kinds(records: DataFrame) -> DataFrame:
    """field, kind, n: what each field of the records holds, and how often; a field that changes its type has several rows."""
    spark = records.sparkSession
    rows = spark.sql("SELECT e.key AS field, schema_of_variant(e.value) AS shape FROM {records}, LATERAL variant_explode(record) AS e", records=records)
    kind = reduce(lambda c, k: c.when(F.col("shape").startswith(k), k.lower()), ("ARRAY", "OBJECT"), F.when(F.col("shape") == "VOID", "null"))
    return rows.groupBy("field", kind.otherwise(F.lower(F.regexp_replace("shape", r"\(.*", ""))).alias("kind")).agg(F.count("*").alias("n"))


def common_schema(records: DataFrame) -> str:
    """The least schema of all records, with VARIANT where a field changes its type."""
    return records.agg(F.schema_of_variant_agg("record")).first()[0]
