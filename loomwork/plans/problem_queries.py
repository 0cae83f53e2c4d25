"""Queries over the derived problem, prediction and thinking views: classification, parsing, scoring, errors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.functions import grammar as G
from loomwork.functions import thinking as Th
from loomwork.operators import classify as K
from loomwork.operators import scoring as S
from loomwork.operators import traces as Tr
from loomwork.plans import views as V
from loomwork.plans.registry import query

_q = lambda s: s.replace("'", "''")
_case = lambda of: "CASE task " + " ".join(f"WHEN '{t}' THEN {e}" for t, e in of.items()) + " END"
_full = lambda x, of: _case({t: f"regexp_full_match({x}, '{_q(p)}')" for t, p in of.items()})
# The engine of the oracle has no lookahead: the two patterns that use it are split.
_ANSWER = {t: f"regexp_full_match(answer, '{_q(p)}')" for t, p in G.ANSWER.items() if "(?=" not in p} | {
    "numeral": f"(answer <> '' AND regexp_full_match(answer, '{G.ROMAN}'))",
    "symbolic_transform": f"(length(answer) BETWEEN 1 AND 4 AND regexp_full_match(answer, '{_q(G.SYMBOLS)}'))",
}
_CLASSIFIED = f"""l AS (SELECT pid, prompt, answer, CASE WHEN prompt = '' THEN [] WHEN prompt[-1] = chr(10) THEN string_split(prompt, chr(10))[:-2] ELSE string_split(prompt, chr(10)) END AS lines FROM problems_bad),
t AS (SELECT *, CASE lines[1] {' '.join(f"WHEN '{_q(p)}' THEN '{t}'" for t, p in G.PREFIXES.items())} END AS task, [x for x in lines if x <> ''] AS filled, [x for x in lines if starts_with(x, 'Now,')] AS queries FROM l),
h AS (SELECT *, task = 'bit_manipulation' AND coalesce(filled[2] <> '{G.BIT_HEADER}', true) AS bad_header FROM t),
e AS (SELECT *, filled[(CASE WHEN task = 'bit_manipulation' AND NOT bad_header THEN 3 ELSE 2 END):(len(filled) - 1)] AS examples FROM h),
w AS (SELECT *, len([x for x in examples if NOT ({_full('x', G.EXAMPLE)})]) AS wrong FROM e),
r AS (SELECT pid, task, CASE WHEN len(lines) = 0 THEN ['empty_prompt'] WHEN task IS NULL THEN ['prefix_match_count:0'] ELSE list_sort(list_distinct([x for x in [
    CASE WHEN bad_header THEN 'invalid_example_header' END,
    CASE WHEN len(examples) NOT BETWEEN (CASE WHEN task = 'bit_manipulation' THEN 7 ELSE 3 END) AND (CASE WHEN task = 'bit_manipulation' THEN 10 ELSE 5 END) THEN 'unexpected_example_count:' || len(examples) END,
    CASE WHEN wrong > 0 THEN 'invalid_example_lines:' || wrong END,
    CASE WHEN len(queries) <> 1 THEN 'unexpected_query_count:' || len(queries) WHEN NOT ({_full('queries[1]', G.QUERY)}) THEN 'invalid_query_format' END,
    CASE WHEN NOT ({_case(_ANSWER)}) THEN 'invalid_answer_format' END] if x IS NOT NULL])) END AS reasons FROM w),
classified AS (SELECT pid, CASE WHEN len(reasons) > 0 THEN 'unknown' ELSE task END AS task_type, reasons FROM r)"""


@query(f"WITH {V.PROBLEMS} SELECT pid, task_type, question, answer, prompt FROM problems")
def problem_view(spark: SparkSession, d: str) -> DataFrame:
    return V.problems(spark, d).select("pid", "task_type", "question", "answer", "prompt")


@query(f"WITH {V.PROBLEMS_BAD}, {_CLASSIFIED} SELECT pid, task_type, array_to_string(reasons, ';') AS reasons FROM classified")
def classify(spark: SparkSession, d: str) -> DataFrame:
    return K.classify(V.problems_bad(spark, d)).select("pid", "task_type", F.array_join("reasons", ";").alias("reasons"))


@query(f"WITH {V.PROBLEMS_BAD}, {_CLASSIFIED} SELECT reason, count(*) AS n FROM (SELECT unnest(reasons) AS reason FROM classified) GROUP BY 1")
def classify_reasons(spark: SparkSession, d: str) -> DataFrame:
    return K.classify(V.problems_bad(spark, d)).select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


@query(f"WITH {V.PROBLEMS_BAD}, {_CLASSIFIED}, n AS (SELECT unnest([{', '.join(repr(t) for t in (*G.TASKS, 'unknown'))}]) AS task_type) SELECT task_type, count(c.pid) AS n FROM n LEFT JOIN classified c USING (task_type) GROUP BY 1")
def task_counts(spark: SparkSession, d: str) -> DataFrame:
    """Zero-filled over the fixed task names."""
    names = spark.createDataFrame([(t,) for t in (*G.TASKS, "unknown")], "task_type string")
    counts = K.classify(V.problems_bad(spark, d)).groupBy("task_type").agg(F.count("*").alias("n"))
    return names.join(counts, "task_type", "left").na.fill(0, ["n"])


_PARSED = f"""task AS (SELECT *, CASE {' '.join(f"WHEN starts_with(prompt, '{_q(p)}') THEN '{t}'" for t, p in G.PREFIXES.items())} END AS task FROM problems_bad),
q AS (SELECT *, nullif(trim({_case({t: f"regexp_extract(prompt, '{_q(p)}', 1)" for t, p in G.QUESTION.items()})}), '') AS asked,
    CASE WHEN task IN ('numeral', 'cipher') THEN len([x for x in string_split(prompt, chr(10)) if contains(x, ' -> ')]) WHEN task = 'symbolic_transform' THEN len([x for x in string_split(prompt, chr(10)) if contains(x, ' = ') AND NOT starts_with(x, 'Now,')])
    ELSE len({_case({t: f"regexp_extract_all(prompt, '{_q(p)}', 1)" for t, p in G.PAIRS.items()})}) END AS n FROM task)"""


@query(f"""WITH {V.PROBLEMS_BAD}, {_PARSED} SELECT pid, task AS task_type, asked AS question, CASE WHEN task IS NOT NULL THEN n END::BIGINT AS n_examples,
    CASE WHEN task IS NULL THEN 'unknown_task_type' WHEN asked IS NULL THEN task || ':missing_question' WHEN n = 0 THEN task || ':missing_examples' END AS error,
    CASE WHEN task IS NULL OR asked IS NULL OR n = 0 THEN NULL WHEN task <> 'symbolic_transform' THEN task WHEN regexp_full_match(asked, '\\d+\\D\\d+') THEN 'equation_numeric' ELSE 'cryptarithm' END AS category FROM q""")
def problem_parse(spark: SparkSession, d: str) -> DataFrame:
    return K.parse(V.problems_bad(spark, d)).select("pid", "task_type", "question", F.size("examples").cast("long").alias("n_examples"), "error", "category")


# --- scoring --------------------------------------------------------------------------------------

_LABEL = "^(?i:final answer|answer|the answer is):[ \\t]*(.*)$"
_EVALUATED = f"""k AS (SELECT *, [trim(x, E' \\t\\r') for x in string_split(prediction_raw, chr(10)) if regexp_matches(x, '\\S')] AS kept FROM predictions),
m AS (SELECT *, [x for x in kept if regexp_matches(x, '{_LABEL}')] AS labeled FROM k),
c AS (SELECT *, nullif(CASE WHEN len(kept) = 0 THEN '' WHEN len(kept) = 1 THEN CASE WHEN len(labeled) = 1 THEN trim(regexp_extract(kept[1], '{_LABEL}', 1)) ELSE kept[1] END WHEN len(labeled) = 1 THEN trim(regexp_extract(labeled[1], '{_LABEL}', 1)) ELSE kept[1] END, '') AS cand,
    CASE WHEN len(kept) = 0 THEN 'empty' WHEN len(kept) = 1 AND len(labeled) = 1 THEN 'labeled' WHEN len(kept) = 1 THEN 'plain' WHEN len(labeled) = 1 THEN 'labeled_with_extra_text' ELSE 'multiline' END AS method, task_type AS task FROM m),
p AS (SELECT *, coalesce(CASE WHEN task IN ('gravity', 'unit_conversion') THEN regexp_full_match(cand, '-?\\d+(\\.\\d+)?') WHEN task = 'numeral' THEN regexp_full_match(upper(cand), '{G.ROMAN}') WHEN task = 'cipher' THEN regexp_full_match(trim(regexp_replace(lower(cand), '\\s+', ' ', 'g')), '{G.WORDS}')
        WHEN task = 'bit_manipulation' THEN regexp_full_match(cand, '[01]{{8}}') ELSE length(cand) BETWEEN 1 AND 4 AND regexp_full_match(cand, '{_q(G.SYMBOLS)}') END, false) AS parse_success,
    coalesce({_case({t: e.replace('answer', 'cand') for t, e in _ANSWER.items()})}, false) AS shaped,
    coalesce(CASE WHEN task IN ('gravity', 'unit_conversion') THEN try_cast(cand AS DECIMAL(38, 9)) = try_cast(gold AS DECIMAL(38, 9)) WHEN task = 'numeral' THEN upper(cand) = upper(gold) WHEN task = 'cipher' THEN trim(regexp_replace(lower(cand), '\\s+', ' ', 'g')) = trim(regexp_replace(lower(gold), '\\s+', ' ', 'g')) ELSE cand = gold END, false) AS same FROM c),
f AS (SELECT *, len(kept) = 1 AND cand IS NOT NULL AND shaped AND parse_success AS format_valid, parse_success AND same AS normalized_correct FROM p),
evaluated AS (SELECT *, format_valid AND coalesce(cand = gold, false) AS strict_correct, CASE WHEN task = 'gravity' THEN format_valid AND normalized_correct ELSE format_valid AND coalesce(cand = gold, false) END AS primary_correct,
    CASE WHEN NOT parse_success THEN 'invalid ' || replace(task, '_', ' ') || ' answer' END AS parse_error FROM f)"""


@query(f"WITH {V.PREDICTIONS}, {_EVALUATED} SELECT pid, cand AS candidate, len(kept) = 1 AND cand IS NOT NULL AS clean, method FROM evaluated")
def extract_candidate(spark: SparkSession, d: str) -> DataFrame:
    return V.predictions(spark, d).select("pid", S.candidate("prediction_raw").alias("c")).select("pid", "c.*")


@query(f"WITH {V.PREDICTIONS}, {_EVALUATED} SELECT pid, cand AS parsed_answer, method AS extraction_method, parse_success, format_valid, strict_correct, normalized_correct, primary_correct, parse_error FROM evaluated")
def answer_eval(spark: SparkSession, d: str) -> DataFrame:
    return S.evaluate(V.predictions(spark, d)).select("pid", "parsed_answer", "extraction_method", "parse_success", "format_valid", "strict_correct", "normalized_correct", "primary_correct", "parse_error")


_METRICS = f"""WITH {V.PREDICTIONS}, {_EVALUATED}, b AS (SELECT task_type, count(*) AS n, {', '.join(f'count(*) FILTER ({x}) AS n_{x}' for x in ('parse_success', 'format_valid', 'strict_correct', 'normalized_correct', 'primary_correct'))} FROM evaluated GROUP BY 1),
    a AS (SELECT *, NULL::DOUBLE AS macro FROM b UNION ALL SELECT '*', sum(n), sum(n_parse_success), sum(n_format_valid), sum(n_strict_correct), sum(n_normalized_correct), sum(n_primary_correct), avg(n_primary_correct / n) FROM b)"""


@query(_METRICS + " SELECT task_type, n::BIGINT AS n, n_parse_success::BIGINT AS n_parse_success, n_format_valid::BIGINT AS n_format_valid, n_strict_correct::BIGINT AS n_strict_correct, n_normalized_correct::BIGINT AS n_normalized_correct, n_primary_correct::BIGINT AS n_primary_correct, round(n_primary_correct / n, 6)::DOUBLE AS primary_accuracy, round(macro, 6) AS macro_accuracy FROM a")
def answer_metrics(spark: SparkSession, d: str) -> DataFrame:
    return S.metrics(S.evaluate(V.predictions(spark, d)))


@query(_METRICS + " SELECT round(macro, 6) AS macro_accuracy, round(n_primary_correct / n, 6)::DOUBLE AS micro_accuracy FROM a WHERE task_type = '*'")
def macro_accuracy(spark: SparkSession, d: str) -> DataFrame:
    return S.metrics(S.evaluate(V.predictions(spark, d))).filter("task_type = '*'").select("macro_accuracy", F.col("primary_accuracy").alias("micro_accuracy"))


@query(f"WITH {V.PREDICTIONS}, {_EVALUATED} SELECT pid, task_type, prediction_raw FROM evaluated WHERE NOT primary_correct")
def error_cases(spark: SparkSession, d: str) -> DataFrame:
    return S.evaluate(V.predictions(spark, d)).filter("not primary_correct").select("pid", "task_type", "prediction_raw")


def _validators(spark: SparkSession, d: str) -> DataFrame:
    """Each prediction under a validator by _ord % 4: exact, regex, line_count, contains."""
    k = F.col("_ord") % 4
    v = F.struct(
        F.when(k == 0, "exact").when(k == 1, "regex").when(k == 2, "line_count").otherwise("contains").alias("type"),
        F.when(k == 0, F.col("gold")).alias("value"), F.when(k == 1, r"[A-Za-z ]+|[0-9.]+").alias("pattern"), F.when(k == 2, 1).alias("count"),
        F.when(k == 3, F.array(F.substring("gold", 1, 2))).alias("values"), F.when(k == 3, 3).alias("max_words"), F.when(k == 3, 1).alias("max_lines"),
    )
    return V.predictions(spark, d).withColumn("validator", v).withColumn("category", F.col("validator.type"))


_VALIDATED = f"""v AS (SELECT *, CASE _ord % 4 WHEN 0 THEN 'exact' WHEN 1 THEN 'regex' WHEN 2 THEN 'line_count' ELSE 'contains' END AS category, CASE WHEN prediction_raw = '' THEN [] ELSE string_split(prediction_raw, chr(10)) END AS lines FROM predictions),
s AS (SELECT *, CASE category WHEN 'exact' THEN prediction_raw = gold WHEN 'regex' THEN regexp_full_match(prediction_raw, '[A-Za-z ]+|[0-9.]+') WHEN 'line_count' THEN len(lines) = 1 AND len([x for x in lines if NOT regexp_matches(x, '\\S')]) = 0
    ELSE contains(prediction_raw, substr(gold, 1, 2)) AND len(regexp_extract_all(prediction_raw, '\\S+')) <= 3 AND len(lines) <= 1 END AS instruction_success, stop_reason IN ('im_end', 'endoftext') AS stop_success FROM v),
judged AS (SELECT *, NOT stop_success OR (category = 'exact' AND starts_with(prediction_raw, gold) AND prediction_raw <> gold) AS continuation_failure FROM s)"""


def _judged(spark: SparkSession, d: str) -> DataFrame:
    df = _validators(spark, d)
    v, p = F.col("validator"), F.col("prediction_raw")
    return df.withColumns(S.instruction_flags(v, S.validator_success(v, p), p, F.col("stop_reason")))


@query(f"WITH {V.PREDICTIONS}, {_VALIDATED} SELECT pid, category, instruction_success, stop_success, continuation_failure FROM judged")
def instr_validators(spark: SparkSession, d: str) -> DataFrame:
    return _judged(spark, d).select("pid", "category", "instruction_success", "stop_success", "continuation_failure")


@query(f"WITH {V.PREDICTIONS}, {_VALIDATED} SELECT CASE WHEN grouping(category) = 1 THEN '*' ELSE category END AS category, count(*) AS n, count(*) FILTER (instruction_success) AS n_instruction_success, count(*) FILTER (instruction_success) AS n_format_success, count(*) FILTER (stop_success) AS n_stop_success, count(*) FILTER (continuation_failure) AS n_continuation_failure, round(avg(instruction_success::INT), 6) AS instruction_accuracy, round(avg(generated_tokens), 6) AS mean_tokens, max(generated_tokens)::BIGINT AS max_tokens FROM judged GROUP BY ROLLUP (category)")
def instr_metrics(spark: SparkSession, d: str) -> DataFrame:
    return S.instruction_metrics(_judged(spark, d))


@query()
def instr_json(spark: SparkSession, d: str) -> DataFrame:
    """JSON validity as Python reads it, in an Arrow UDF: no engine's own JSON functions agree with it."""
    df = V.predictions(spark, d).withColumn("expected", F.lit(None).cast("string"))
    return S.json_success(df, "prediction_raw", "expected", "is_json").select("pid", "is_json")


_FINAL = "trim(CASE WHEN contains(assistant, '</think>') THEN string_split(assistant, '</think>')[-1] ELSE assistant END, E' \\t\\n\\r')"
_NORM = "trim(regexp_replace({0}, '\\s+', ' ', 'g'))"
_SCORED = f"""x AS (SELECT *, {_FINAL} AS final, contains(assistant, '<think>') AS think_open, contains(assistant, '</think>') AS think_close FROM thinking),
scored AS (SELECT *, {_NORM.format('final')} = {_NORM.format('answer')} AS exact, 1 + _ord % 300 AS tokens FROM x)"""


def _scored(spark: SparkSession, d: str) -> DataFrame:
    t = V.thinking(spark, d).withColumns({"final": Th.final_answer("assistant"), "think_open": Th.has_open("assistant"), "think_close": Th.has_close("assistant")})
    return t.withColumn("exact", S.exact(F.col("assistant"), F.col("answer"))).withColumn("tokens", 1 + F.col("_ord") % 300)


@query(f"WITH {V.THINKING}, {_SCORED} SELECT task_type, count(*) AS total, count(*) FILTER (exact) AS exact, count(*) FILTER (wants_think) AS parse_total, count(*) FILTER (wants_think AND think_close AND final <> '') AS parse_ok, count(*) FILTER (tokens < 256) AS stop_ok, round(avg(tokens), 6) AS mean_tokens FROM scored GROUP BY 1")
def dev_summary(spark: SparkSession, d: str) -> DataFrame:
    return S.dev_summary(_scored(spark, d), "task_type")


@query(f"WITH {V.THINKING}, p AS (SELECT *, strpos(assistant, '<think>') AS a, strpos(assistant, '</think>') AS b, len(string_split(assistant, '<think>')) - 1 AS na, len(string_split(assistant, '</think>')) - 1 AS nb FROM thinking), r AS (SELECT *, trim(substr(assistant, a + 7, greatest(b - a - 7, 0)), E' \\t\\n\\r') AS reasoning, trim(substr(assistant, b + 8), E' \\t\\n\\r') AS final, a > 0 AND b > a AS tags FROM p) SELECT pid, tags AND reasoning <> '' AS lenient_ok, tags AND reasoning <> '' AND na = 1 AND nb = 1 AND final <> '' AS strict_ok, CASE WHEN tags AND reasoning <> '' THEN final END AS lenient_final FROM r")
def thinking_parse(spark: SparkSession, d: str) -> DataFrame:
    t = V.thinking(spark, d).withColumns({"l": Th.parse("assistant", strict=False), "s": Th.parse("assistant", strict=True)})
    return t.select("pid", F.col("l.ok").alias("lenient_ok"), F.col("s.ok").alias("strict_ok"), F.col("l.final").alias("lenient_final"))


@query(f"WITH {V.THINKING}, f AS (SELECT *, contains(assistant, '<think>') AS o, contains(assistant, '</think>') AS c, strpos(assistant, '<think>') AS a, strpos(assistant, '</think>') AS b FROM thinking), g AS (SELECT wants_think, wants_think AND o AND c AS both_tags, wants_think AND a > 0 AND b > a AND trim(substr(assistant, a + 7, greatest(b - a - 7, 0)), E' \\t\\n\\r') <> '' AS parsed, wants_think AND o AND c AND length(string_split(string_split(assistant, '</think>')[1], '<think>')[-1]) > 0.7 * 40 AS overlong, NOT wants_think AND (o OR c) AS spurious FROM f) SELECT count(*) AS n, count(*) FILTER (wants_think) AS n_think, round(count(*) FILTER (both_tags) / count(*) FILTER (wants_think), 6)::DOUBLE AS both_rate, round(count(*) FILTER (parsed) / count(*) FILTER (wants_think), 6)::DOUBLE AS parse_rate, round(count(*) FILTER (overlong) / count(*) FILTER (wants_think), 6)::DOUBLE AS overlong_rate, round(count(*) FILTER (NOT wants_think AND NOT spurious) / count(*) FILTER (NOT wants_think), 6)::DOUBLE AS clean_rate FROM g")
def protocol_rates(spark: SparkSession, d: str) -> DataFrame:
    t = V.thinking(spark, d)
    return S.protocol_rates(t.withColumns(S.protocol_flags(F.col("assistant"), F.col("wants_think"), 40)))


_NUM = "[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?"
_CLASSED = f"""n AS (SELECT *, CASE WHEN regexp_full_match(answer, '{_NUM}') THEN answer::DOUBLE END AS gold, CASE WHEN regexp_full_match(final, '{_NUM}') THEN final::DOUBLE END AS got,
    regexp_matches(assistant, '(?i)g\\s*[=≈]|ratio|coefficient|2\\*d|0\\.5\\*g|output/input') AS formula, regexp_matches(assistant, '\\d+\\.?\\d*\\s*[*×]\\s*\\d+\\.?\\d*|0\\.5\\s*[*×]') AS computed FROM scored WHERE NOT exact),
classed AS (SELECT *, CASE WHEN wants_think AND NOT think_close THEN 'parse_fail' WHEN think_open AND NOT think_close AND length(assistant) > 300 THEN 'loop' WHEN final = '' THEN 'parse_fail'
    WHEN task_type IN ('gravity', 'unit_conversion') THEN CASE WHEN gold IS NULL OR got IS NULL THEN 'parse_fail' WHEN gold = 0 OR gold = got THEN 'final_mismatch' WHEN abs(gold - got) / gold < 0.01 THEN 'rounding_wrong' WHEN got / gold > 0.7 AND got / gold < 1.3 AND abs(got / gold - 1) > 0.01 THEN 'coefficient_wrong' WHEN formula AND NOT computed THEN 'formula_wrong' ELSE 'arithmetic_wrong' END
    WHEN task_type = 'bit_manipulation' THEN CASE WHEN final <> answer THEN 'mapping_wrong' ELSE 'final_mismatch' END WHEN task_type = 'cipher' THEN 'mapping_wrong' ELSE 'rule_wrong' END AS error_class FROM n)"""


def _classed(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d).filter("not exact").withColumn("error_class", S.error_class(F.col("task_type"), F.col("assistant"), F.col("answer"), F.col("final"), F.col("wants_think")))


@query(f"WITH {V.THINKING}, {_SCORED}, {_CLASSED} SELECT task_type, error_class, count(*) AS n FROM classed GROUP BY ALL")
def error_class_numeric(spark: SparkSession, d: str) -> DataFrame:
    return _classed(spark, d).groupBy("task_type", "error_class").agg(F.count("*").alias("n"))


@query(f"WITH {V.THINKING}, {_SCORED}, {_CLASSED} SELECT task_type, row_number() OVER (PARTITION BY task_type ORDER BY _ord) AS rank, pid, error_class, answer AS expected, final, substr(assistant, 1, 20) AS said FROM classed QUALIFY row_number() OVER (PARTITION BY task_type ORDER BY _ord) <= 5")
def error_samples(spark: SparkSession, d: str) -> DataFrame:
    """Five wrong answers of each task."""
    return S.error_samples(_classed(spark, d), 5, 20)


@query(f"WITH {V.THINKING}, {_SCORED}, {_CLASSED}, c AS (SELECT task_type, error_class, count(*) AS n FROM classed GROUP BY ALL) SELECT task_type, error_class, n, row_number() OVER (PARTITION BY task_type ORDER BY n DESC, error_class)::INT AS rank FROM c QUALIFY row_number() OVER (PARTITION BY task_type ORDER BY n DESC, error_class) <= 2")
def top_error_classes(spark: SparkSession, d: str) -> DataFrame:
    return S.top_reasons(_classed(spark, d), "task_type", "error_class", 2).withColumn("rank", F.col("rank").cast("int"))


@query(f"WITH {V.THINKING} SELECT pid, (task_type = 'gravity' AND regexp_matches(assistant, '(?i)g\\s*[=≈]|2\\*d/\\s*t\\^2|0\\.5\\*g\\*t\\^2')) OR (task_type = 'unit_conversion' AND regexp_matches(assistant, '(?i)ratio|coefficient|output/input')) AS formula_correct FROM thinking WHERE task_type IN ('gravity', 'unit_conversion')")
def physics_features(spark: SparkSession, d: str) -> DataFrame:
    t = V.thinking(spark, d).filter(F.col("task_type").isin(*S.NUMERIC))
    return t.select("pid", S.physics_features(F.col("task_type"), F.col("assistant"))["formula_correct"].alias("formula_correct"))


@query(f"WITH {V.PREDICTIONS}, t AS (SELECT pid, trim(prediction_raw, E' \\t\\n\\r') AS t, regexp_matches(lower(prediction_raw), 'explanation|because|therefore|the rule|i think|let me') AS explains, contains(prediction_raw, '```') OR contains(prediction_raw, '**') AS markdown FROM predictions) SELECT pid, regexp_full_match(t, '[01]{{8}}') AS is_8bit, explains, markdown, false AS has_extra, length(t)::BIGINT AS raw_length, regexp_full_match(t, '[01]{{8}}') AND NOT explains AND NOT markdown AS passed FROM t")
def binary_format(spark: SparkSession, d: str) -> DataFrame:
    flags = S.binary_format(F.col("prediction_raw"))
    return V.predictions(spark, d).select("pid", *[c.alias(n) for n, c in flags.items()])


@query(f"WITH {V.PREDICTIONS} SELECT pid, len(regexp_extract_all(prediction_raw, '\\S+')) <= 3 AS too_short, length(prediction_raw) >= 18 AS possible_truncation, lower(trim(prediction_raw, E' \\t\\n\\r')) IN ('i don''t know', 'i do not know', 'idk', 'n/a') AS refusal FROM predictions")
def open_flags(spark: SparkSession, d: str) -> DataFrame:
    flags = S.open_flags(F.col("prediction_raw"), 6)
    return V.predictions(spark, d).select("pid", *[c.alias(n) for n, c in flags.items()])


_MODEL = "SELECT task_type, count(*) FILTER (primary_correct) AS correct, count(*) AS total FROM evaluated WHERE {0} GROUP BY 1"


@query(f"WITH {V.PREDICTIONS}, {_EVALUATED}, a AS ({_MODEL.format('_ord % 3 = 0')}), b AS ({_MODEL.format('_ord % 3 <> 0')}) SELECT task_type, coalesce(a.correct, 0) AS correct_a, coalesce(a.total, 0) AS total_a, coalesce(b.correct, 0) AS correct_b, coalesce(b.total, 0) AS total_b, round(coalesce(b.correct / b.total, 0) - coalesce(a.correct / a.total, 0), 6)::DOUBLE AS delta FROM a FULL JOIN b USING (task_type)")
def model_side_by_side(spark: SparkSession, d: str) -> DataFrame:
    e = S.evaluate(V.predictions(spark, d))
    by = lambda df: df.groupBy("task_type").agg(F.count_if("primary_correct").alias("correct"), F.count("*").alias("total"))
    return S.side_by_side(by(e.filter("_ord % 3 = 0")), by(e.filter("_ord % 3 <> 0")), "task_type")


_FLAG = lambda of: "CASE task_type " + " ".join(f"WHEN '{t}' THEN regexp_matches(block, '{_q(p)}')" for t, p in of.items()) + " ELSE false END"


@query(f"""WITH {V.THINKING}, {_SCORED}, b AS (SELECT pid, task_type, final, trim(regexp_extract(assistant, '(?s)<think>(.*?)</think>', 1), E' \\t\\n\\r') AS block, regexp_matches(assistant, '(?s)<think>.*?</think>') AS closed FROM scored),
    f AS (SELECT pid, task_type, closed, closed AND {_FLAG(Tr.RULE)} AS has_rule, closed AND {_FLAG(Tr.NUMBER)} AS has_number, closed AND {_FLAG(Tr.QUERY)} AS has_query, closed AND final <> '' AS has_answer FROM b)
    SELECT pid, has_rule, has_number, has_query, has_answer, closed AND CASE WHEN task_type IN ('gravity', 'unit_conversion') THEN NOT has_number AND NOT has_query WHEN task_type = 'bit_manipulation' THEN NOT has_rule AND NOT has_number WHEN task_type = 'cipher' THEN NOT has_number ELSE NOT has_rule END AS template_only FROM f""")
def trace_audit(spark: SparkSession, d: str) -> DataFrame:
    t = V.thinking(spark, d)
    return t.select("pid", *[c.alias(n) for n, c in Tr.flags(F.col("task_type"), F.col("assistant")).items()])
