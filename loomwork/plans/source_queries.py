"""Queries that write the driver's tables through a sink and read them back through a source, in the shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwork.functions.session import shared_dir
from loomwork.operators import chat as C
from loomwork.operators import gates as Gt
from loomwork.operators import mixture as Mx
from loomwork.operators import records as Rec
from loomwork.operators import validation as Va
from loomwork.plans import views as V
from loomwork.plans.core_queries import CHAT, chat
from loomwork.plans.registry import query, table
from loomwork.sources import external as X
from loomwork.sources import files as S
from loomwork.sources import sinks as K
from loomwork.sources.keyed_json import read_keyed_json


def _fresh(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/sources-{uuid.uuid4().hex}"


def _strings(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def _csv(spark: SparkSession, d: str) -> DataFrame:
    """The problems as CSV with quoted line breaks, read strictly."""
    folder = _fresh(spark)
    rows = V.problems(spark, d).select(F.col("pid").alias("id"), "prompt", "answer")
    rows.write.option("header", True).option("escape", '"').csv(folder)
    return S.read_csv(spark, folder)


@query(f"WITH {V.PROBLEMS} SELECT pid AS id, prompt, answer FROM problems")
def csv_round_trip(spark: SparkSession, d: str) -> DataFrame:
    return _csv(spark, d).select("id", "prompt", "answer")


@query(f"WITH {V.PROBLEMS}, p AS (SELECT pid AS id FROM problems WHERE _ord % 3 = 0 UNION ALL SELECT 'absent-' || s FROM generate_series(1, 3) t(s)) SELECT id, 'found' AS fate FROM p WHERE id NOT LIKE 'absent%' UNION ALL SELECT id, 'missing' FROM p WHERE id LIKE 'absent%'")
def csv_with_pool(spark: SparkSession, d: str) -> DataFrame:
    """A manifest of ids as JSON; the rows it names, and the names without rows."""
    folder = _fresh(spark)
    ids = V.problems(spark, d).filter("_ord % 3 = 0").select("pid").unionByName(spark.createDataFrame([(f"absent-{k}",) for k in (1, 2, 3)], "pid string"))
    ids.agg(F.to_json(F.struct(F.array_sort(F.collect_list("pid")).alias("pool"))).alias("value")).write.text(folder)
    found, missing = S.scan_with_pool(_csv(spark, d), S.read_pool(spark, folder))
    return found.select("id", F.lit("found").alias("fate")).unionByName(missing.select("id", F.lit("missing").alias("fate")))


@query(f"WITH {V.PROBLEMS} SELECT pid, task_type, prompt, answer, row_number() OVER (ORDER BY _ord) AS place FROM problems")
def jsonl_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Rows written in order over several files come back in that order."""
    folder = _fresh(spark)
    S.write_jsonl(V.problems(spark, d), folder, ("pid", "task_type", "prompt", "answer"))
    rows = S.read_jsonl(spark, folder, _strings("pid", "task_type", "prompt", "answer"), ("pid", "task_type", "prompt", "answer"), allow_empty=False)
    return C.with_rank(rows, "_ord").select("pid", "task_type", "prompt", "answer", F.col("rank").alias("place"))


@query(f"WITH {V.PROBLEMS} SELECT CASE _ord % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'validation' ELSE 'test' END AS split, count(*) AS n, min(pid) AS first, max(pid) AS last FROM problems GROUP BY 1")
def splits_round_trip(spark: SparkSession, d: str) -> DataFrame:
    folder = _fresh(spark)
    m = F.col("_ord") % 3
    K.write_splits(V.problems(spark, d).withColumn("split", F.when(m == 0, "train").when(m == 1, "validation").otherwise("test")), folder, ("pid", "answer"))
    rows = S.read_splits(spark, {s: f"{folder}/split={s}" for s in ("train", "validation", "test")}, _strings("pid", "answer"), ("pid", "answer"))
    return rows.groupBy("split").agg(F.count("*").alias("n"), F.min("pid").alias("first"), F.max("pid").alias("last"))


@query("SELECT conv_id::VARCHAR AS id, count(*) AS n_messages, sum(length(text))::BIGINT AS n_chars, arg_min(text, turn) AS first FROM conversations GROUP BY 1")
def conversations_round_trip(spark: SparkSession, d: str) -> DataFrame:
    folder = _fresh(spark)
    S.write_jsonl(chat(spark, d).withColumn("id", F.col("conv_id").cast("string")), folder, ("id", "category", "messages"))
    m = F.col("messages")
    chars = F.aggregate(m, F.lit(0).cast("long"), lambda n, x: n + F.char_length(x["content"]))
    return S.read_conversations(spark, folder).select("id", F.size(m).cast("long").alias("n_messages"), chars.alias("n_chars"), m[0]["content"].alias("first"))


@query(f"WITH {CHAT} SELECT conv_id::VARCHAR AS id, category, n AS n_messages, CASE WHEN conv_id % 2 = 0 THEN 'exact' ELSE 'regex' END AS type, 'dev' AS split FROM conv WHERE error IS NULL")
def instruction_eval_scan(spark: SparkSession, d: str) -> DataFrame:
    folder = _fresh(spark)
    good = C.validate(chat(spark, d)).filter("error is null")
    validator = F.struct(F.when(F.col("conv_id") % 2 == 0, "exact").otherwise("regex").alias("type"), F.lit("x").alias("value"))
    S.write_jsonl(good.withColumns({"id": F.col("conv_id").cast("string"), "validator": validator, "extra": F.lit(1)}), folder, ("id", "category", "messages", "validator", "extra"))
    return S.read_instruction_eval(spark, folder, "dev").select("id", "category", F.size("messages").cast("long").alias("n_messages"), F.col("validator.type").alias("type"), "split")


@query("SELECT doc_id // 40 AS part, doc_id, source FROM documents QUALIFY row_number() OVER (PARTITION BY doc_id // 40 ORDER BY doc_id) = 1")
def problem_files(spark: SparkSession, d: str) -> DataFrame:
    """A file for every forty ids, of which the first line is read."""
    folder = _fresh(spark)
    part = F.floor(F.col("doc_id") / 40)
    rows = table(spark, d, "documents").select(part.alias("part"), part.alias("file"), "doc_id", "source").repartition("file").sortWithinPartitions("file", "doc_id")
    rows.select("file", F.to_json(F.struct("part", "doc_id", "source")).alias("value")).write.partitionBy("file").text(folder)
    schema = T.StructType([T.StructField("part", T.LongType()), T.StructField("doc_id", T.LongType()), T.StructField("source", T.StringType())])
    return S.read_problem_files(spark, folder, schema, "file=*/part-*").select("part", "doc_id", "source")


@query("SELECT item_id::VARCHAR AS key, text, length(text)::BIGINT AS n FROM benchmark")
def keyed_json_scan(spark: SparkSession, d: str) -> DataFrame:
    """One object of all items, written line after line and read in ranges of 2000 bytes."""
    folder = _fresh(spark)
    rows = C.with_rank(table(spark, d, "benchmark"), "item_id")
    pair = F.concat(F.when(F.col("rank") > 1, ",").otherwise(""), F.concat(F.lit("\""), "item_id", F.lit("\"")), F.lit(": "), F.to_json(F.struct("text", F.char_length("text").alias("n"))))
    ends = spark.createDataFrame([(0, "{"), (1 << 62, "}")], "rank long, value string")
    lines = rows.select("rank", pair.alias("value")).unionByName(ends)
    # One file has one writer, which streams its lines.
    lines.coalesce(1).sortWithinPartitions("rank").select("value").write.text(f"{folder}/parts")
    path, conf = spark._jvm.org.apache.hadoop.fs.Path, spark._jsc.hadoopConfiguration()
    whole = path(f"{folder}/parts").getFileSystem(conf).globStatus(path(f"{folder}/parts/part-*"))[0].getPath().toString()
    return read_keyed_json(spark, whole, "text string, n bigint", range_bytes=2000).select("key", "value.text", "value.n")


@query("SELECT DISTINCT trim(p_type) AS word FROM part")
def word_list(spark: SparkSession, d: str) -> DataFrame:
    """Types of parts as a list with blanks, repeats and empty lines."""
    folder = _fresh(spark)
    lines = table(spark, d, "part").select(F.explode(F.array(F.concat(F.lit(" "), "p_type", F.lit(" ")), F.col("p_type"), F.lit(""))).alias("value"))
    lines.write.text(folder)
    return S.read_words(spark, folder)


@query("SELECT lang AS split, count(*) AS n_excluded, min(doc_id) AS first, max(doc_id) AS last FROM documents WHERE doc_id % 10 = 0 GROUP BY 1")
def exclusion_reader(spark: SparkSession, d: str) -> DataFrame:
    """An audit's excluded rows, written out and read back for the length it was made for."""
    folder = _fresh(spark)
    rows = table(spark, d, "documents").filter("doc_id % 10 = 0").select(F.col("lang").alias("split"), F.col("doc_id").alias("id"), F.lit("sequence_exceeds_max_length").alias("reason"))
    K.write_exclusions(rows, folder, 512)
    return K.read_exclusions(spark, folder, 512, "long").groupBy("split").agg(F.count("*").alias("n_excluded"), F.min("id").alias("first"), F.max("id").alias("last"))


@query(f"WITH {V.PREDICTIONS} SELECT 'predictions' AS artifact, count(*) AS n FROM predictions UNION ALL SELECT 'error_cases', count(*) FILTER (prediction_raw <> gold) FROM predictions UNION ALL SELECT 'protected', 0")
def evaluation_artifacts(spark: SparkSession, d: str) -> DataFrame:
    """Predictions and error cases of an open split; a protected one has no error cases."""
    folder = _fresh(spark)
    p = V.predictions(spark, d).select("pid", "prediction_raw", (F.col("prediction_raw") == F.col("gold")).alias("primary_correct"))
    K.write_evaluation(p, f"{folder}/open")
    K.write_evaluation(p, f"{folder}/closed", protected=True)
    path, conf = spark._jvm.org.apache.hadoop.fs.Path, spark._jsc.hadoopConfiguration()
    hidden = path(f"{folder}/closed/error_cases")
    rows = [("protected", int(hidden.getFileSystem(conf).exists(hidden)))]
    parts = [spark.read.text(f"{folder}/open/{a}").agg(F.lit(a).alias("artifact"), F.count("*").alias("n")) for a in ("predictions", "error_cases")]
    return parts[0].unionByName(parts[1]).unionByName(spark.createDataFrame(rows, "artifact string, n long"))


@query(f"WITH {V.PROBLEMS} SELECT 'train' AS part, count(*) FILTER (_ord % 4 <> 0) AS n FROM problems UNION ALL SELECT 'validation', count(*) FILTER (_ord % 4 = 0) FROM problems")
def smoke_files(spark: SparkSession, d: str) -> DataFrame:
    folder, p = _fresh(spark), V.problems(spark, d)
    K.write_smoke(p.filter("_ord % 4 <> 0"), p.filter("_ord % 4 = 0"), folder, ("pid", "answer"))
    parts = [spark.read.text(f"{folder}/{n}").agg(F.lit(n).alias("part"), F.count("*").alias("n")) for n in ("train", "validation")]
    return parts[0].unionByName(parts[1])


@query("SELECT count(*) > 0 AS copied, true AS unchanged FROM region")
def raw_copy(spark: SparkSession, d: str) -> DataFrame:
    """A file copied below raw/ has the digest of its source, also when copied again."""
    folder, source = _fresh(spark), f"{d}/region.parquet"
    for _ in range(2):
        K.raw_copy(spark, source, folder)
    a, b = (Gt.file_digests(spark, p).select("n_bytes", "sha256") for p in (source, f"{folder}/raw/*"))
    return a.exceptAll(b).unionByName(b.exceptAll(a)).agg(F.lit(True).alias("copied"), (F.count("*") == 0).alias("unchanged"))


@query("SELECT c_nationkey AS nation, sum(length(c_name) + 1)::BIGINT AS n_bytes, sha256(string_agg(c_name || chr(10), '' ORDER BY c_custkey)) AS sha256 FROM customer GROUP BY 1")
def file_digest(spark: SparkSession, d: str) -> DataFrame:
    """A file a nation with its customers' names; digests of the files' bytes."""
    folder = _fresh(spark)
    rows = table(spark, d, "customer").repartition("c_nationkey").sortWithinPartitions("c_nationkey", "c_custkey")
    rows.select("c_nationkey", F.col("c_name").alias("value")).write.partitionBy("c_nationkey").text(folder)
    digests = Gt.file_digests(spark, f"{folder}/*/part-*.txt")
    return digests.select(F.regexp_extract("path", r"c_nationkey=(\d+)", 1).cast("int").alias("nation"), "n_bytes", "sha256")


_TREE = "WITH p AS (SELECT CASE WHEN doc_id % 5 = 0 THEN 'validation' ELSE 'train' END AS split, doc_id, sha256(coalesce(text, '')) AS h FROM documents), l0 AS (SELECT split, row_number() OVER (PARTITION BY split ORDER BY doc_id) - 1 AS i, h FROM p), " + ", ".join(
    f"l{k + 1} AS (SELECT split, i // 8 AS i, CASE WHEN max(n) = 1 THEN any_value(h) ELSE sha256(string_agg(h, '' ORDER BY i)) END AS h FROM (SELECT *, count(*) OVER (PARTITION BY split) AS n FROM l{k}) GROUP BY split, i // 8)" for k in range(7)
)


@query(_TREE + " SELECT split, n, h AS root FROM l7 JOIN (SELECT split, count(*) AS n FROM l0 GROUP BY 1) USING (split)")
def hash_trees(spark: SparkSession, d: str) -> DataFrame:
    """The root of each split's tree of hashes, over the lines of its files in order; written in parts, and read back."""
    folder = _fresh(spark)
    split = F.when(F.col("doc_id") % 5 == 0, "validation").otherwise("train")
    rows = table(spark, d, "documents").select(split.alias("split"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    K.write_splits(rows, folder, ("doc_id", "text"), order="doc_id")
    parts = [S.read_jsonl(spark, f"{folder}/split={s}", T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())]), split=s) for s in ("train", "validation")]
    return Gt.hash_trees(parts[0].unionByName(parts[1]), "split", F.col("text"), "_ord", fanout=8)


@query("SELECT doc_id, count(*) AS n FROM (SELECT doc_id FROM documents UNION ALL SELECT doc_id FROM documents WHERE doc_id % 7 = 0) GROUP BY 1 HAVING count(*) > 1")
def repeated_ids(spark: SparkSession, d: str) -> DataFrame:
    ids = table(spark, d, "documents").select("doc_id")
    return Va.unique_ids(ids.unionByName(ids.filter("doc_id % 7 = 0")), "doc_id")


@query("WITH h AS (SELECT lang AS category, count(*) AS have FROM documents GROUP BY 1), q(category, quota) AS (VALUES ('en', 10), ('de', 20), ('xx', 3)) SELECT category, coalesce(have, 0) AS have, coalesce(quota, 0)::BIGINT AS quota FROM h FULL JOIN q USING (category) WHERE coalesce(have, 0) <> coalesce(quota, 0)")
def quota_mismatches(spark: SparkSession, d: str) -> DataFrame:
    quotas = spark.createDataFrame([("en", 10), ("de", 20), ("xx", 3)], "category string, quota int")
    return Va.quota_mismatches(table(spark, d, "documents"), "lang", quotas)


@query(f"WITH {V.PROBLEMS}, a AS (SELECT pid, task_type, CASE WHEN _ord % 7 = 0 THEN answer || chr(10) || 'x' WHEN _ord % 7 = 1 THEN '' WHEN _ord % 7 = 2 THEN '\\boxed{{1}}' ELSE answer END AS answer FROM problems) SELECT pid, answer <> '' AND NOT contains(answer, chr(10)) AND NOT contains(answer, '\\boxed') AND CASE task_type WHEN 'bit_manipulation' THEN regexp_full_match(answer, '[01]{{8}}') WHEN 'numeral' THEN regexp_full_match(answer, '[IVXLCDM]+') WHEN 'cipher' THEN regexp_full_match(answer, '[a-z]+( [a-z]+)*') WHEN 'symbolic_transform' THEN trim(answer) <> '' ELSE regexp_full_match(answer, '-?\\d+(\\.\\d+)?') END AS ok FROM a")
def final_answer_format(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("_ord") % 7
    answer = F.when(k == 0, F.concat("answer", F.lit("\nx"))).when(k == 1, "").when(k == 2, "\\boxed{1}").otherwise(F.col("answer"))
    return V.problems(spark, d).select("pid", Rec.final_answer_ok(F.col("task_type"), answer).alias("ok"))


@query("SELECT lang AS category, count(*) AS n, count(*) FILTER (doc_id % 3 = 0) AS n_thinking, count(*) FILTER (doc_id % 3 <> 0) AS n_plain, round(avg(length(coalesce(text, ''))), 6) AS mean_chars FROM documents GROUP BY 1")
def think_stats(spark: SparkSession, d: str) -> DataFrame:
    return Mx.think_stats(table(spark, d, "documents").select(F.col("lang").alias("category"), (F.col("doc_id") % 3 == 0).alias("thinking"), F.coalesce("text", F.lit("")).alias("user")))


# Six shapes by doc_id: plain texts, lists, objects, a blank field before the good one, a number for an answer, and a repeated question.
_SHAPES = r"""WITH t AS (SELECT doc_id, doc_id % 6 AS k, 'Describe document ' || CASE WHEN doc_id % 6 = 5 THEN (doc_id // 60)::VARCHAR ELSE doc_id::VARCHAR END || '.' AS q, coalesce(text, '') AS r, lang AS a FROM documents WHERE trim(coalesce(text, ''), E' \t\n\r') <> ''),
    f AS (SELECT doc_id, k, q, CASE k WHEN 1 THEN r || chr(10) || 'so' WHEN 2 THEN r ELSE r END AS r, CASE k WHEN 4 THEN NULL ELSE a END AS a, ['instruction', 'question', 'problem', 'prompt', 'question', 'input'][k + 1] AS asked, ['rationale', 'cot', 'reasoning', 'solution', 'thoughts', 'thinking'][k + 1] AS thought FROM t)"""


def _mixed(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").filter(F.coalesce("text", F.lit("")).rlike(r"[^ \t\n\r]"))
    k, r, a = F.col("doc_id") % 6, F.col("text"), F.col("lang")
    q = F.concat(F.lit("Describe document "), F.when(k == 5, F.floor(F.col("doc_id") / 60)).otherwise(F.col("doc_id")).cast("string"), F.lit("."))
    js = lambda *cols: F.to_json(F.struct(F.col("doc_id").alias("id"), *cols))
    shapes = [
        js(q.alias("instruction"), r.alias("rationale"), a.alias("answer")),
        js(q.alias("question"), F.array(r, F.lit("so")).alias("cot"), F.struct(F.lit(1).alias("n"), a.alias("final")).alias("target")),
        js(F.struct(q.alias("question")).alias("problem"), F.array(F.struct(F.lit("x").alias("role"), r.alias("content"))).alias("reasoning"), a.alias("output")),
        js(F.lit("  ").alias("prompt"), q.alias("query"), r.alias("solution"), a.alias("gold")),
        js(q.alias("question"), r.alias("thoughts"), F.lit(7).alias("answer")),
        js(q.alias("input"), r.alias("thinking"), a.alias("ground_truth")),
    ]
    folder = _fresh(spark)
    lines = t.select(F.coalesce(*[F.when(k == i, s) for i, s in enumerate(shapes)]).alias("value"), "doc_id")
    lines.repartitionByRange(4, "doc_id").sortWithinPartitions("doc_id").select("value").write.text(folder)
    return X.read_variants(spark, folder)


@query(_SHAPES + """, o AS (SELECT *, CASE WHEN a IS NULL THEN 'missing_answer' WHEN row_number() OVER (PARTITION BY q, a IS NULL ORDER BY doc_id) > 1 THEN 'duplicate_question' ELSE 'sound' END AS status FROM f)
    SELECT doc_id::VARCHAR AS id, q AS question, md5(regexp_replace(r, '[^a-zA-Z]', '', 'g')) AS letters, coalesce(a, '') AS answer, asked, thought, status FROM o""")
def external_shapes(spark: SparkSession, d: str) -> DataFrame:
    """What is found in each record, under which names."""
    rows = X.adapt(_mixed(spark, d))
    letters = F.md5(F.regexp_replace("reasoning", "[^a-zA-Z]", ""))
    return rows.select(F.col("original_id").alias("id"), "question", letters.alias("letters"), F.coalesce("answer", F.lit("")).alias("answer"), F.col("fields_used")["question"].alias("asked"), F.col("fields_used")["reasoning"].alias("thought"), F.coalesce("status", F.lit("sound")).alias("status"))


@query(_SHAPES + """, g AS (SELECT unnest([['id', 'bigint'], [CASE k WHEN 0 THEN 'instruction' WHEN 2 THEN 'problem' WHEN 3 THEN 'query' WHEN 5 THEN 'input' ELSE 'question' END, CASE k WHEN 2 THEN 'object' ELSE 'string' END], [thought, CASE WHEN k IN (1, 2) THEN 'array' ELSE 'string' END],
    [['answer', 'target', 'output', 'gold', 'answer', 'ground_truth'][k + 1], CASE k WHEN 1 THEN 'object' WHEN 4 THEN 'bigint' ELSE 'string' END]]) AS x FROM f UNION ALL SELECT ['prompt', 'string'] FROM f WHERE k = 3) SELECT x[1] AS field, x[2] AS kind, count(*) AS n FROM g GROUP BY ALL""")
def external_field_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Fields that change their type from row to row."""
    return X.field_kinds(_mixed(spark, d))
