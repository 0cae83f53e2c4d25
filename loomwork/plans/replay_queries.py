"""Queries for replayed and external rows, regression reports, positional joins, run limits, raw traces and decimal strings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.functions import decimals as Dec
from loomwork.functions import raw_traces as Raw
from loomwork.operators import chat as C
from loomwork.operators import reason as R
from loomwork.operators import regression as Rg
from loomwork.operators import replay as Rp
from loomwork.plans import views as V
from loomwork.plans.core_queries import CHAT, HASH, TOKENS, chat
from loomwork.plans.record_queries import _KINDS, _STRICT, _defective
from loomwork.plans.registry import query, table
from loomwork.plans.training_queries import _parsed, ids

# --- eligibility ----------------------------------------------------------------------------------


@query(_STRICT.replace("{{8}}", "{8}").split(" SELECT id, category, CASE")[0] + """ SELECT id, category, assistant <> '' AND NOT contains(assistant, '<|im_end|>') AND NOT regexp_matches(assistant, '^\\s|\\s$') AND NOT regexp_matches(lower(assistant), '^(sure|here is|the answer is|i hope this helps|```)') AND NOT contains(assistant, '```')
    AND CASE category WHEN 'binary_only' THEN regexp_full_match(assistant, '[01]{8}') WHEN 'yes_no' THEN assistant IN ('yes', 'no') WHEN 'classification' THEN assistant IN ('positive', 'negative', 'neutral') ELSE true END AS ok FROM r""")
def replay_strict_ok(spark: SparkSession, d: str) -> DataFrame:
    text = _defective("spark").replace("{", "{{").replace("}", "}}").replace("@ids", "{ids}")
    rows = spark.sql(text, ids=ids(spark, d))
    return rows.select("id", "category", Rp.strict_ok(F.col("category"), F.col("user"), F.col("assistant")).alias("ok"))


_COUNTS = "(length(assistant) - length(replace(assistant, '<think>', ''))) // 7 AS n_open, (length(assistant) - length(replace(assistant, '</think>', ''))) // 8 AS n_close, strpos(assistant, '<think>') AS a, strpos(assistant, '</think>') AS z"
_PARSES = "n_open = 1 AND n_close = 1 AND z > a AND trim(substr(assistant, a + 7, z - a - 7), E' \\n') <> '' AND trim(substr(assistant, z + 8), E' \\n') <> ''"


@query(f"WITH {V.THINKING}, k AS (SELECT *, {_COUNTS} FROM thinking) SELECT pid, trim(question) <> '' AND trim(assistant) <> '' AND CASE WHEN wants_think THEN (n_open = 0 AND n_close = 0) OR ({_PARSES}) ELSE n_open = 0 AND n_close = 0 END AS ok FROM k")
def replay_mixture_ok(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("wants_think"), Rp.THINKING).otherwise(Rp.STRICT)
    return V.thinking(spark, d).select("pid", Rp.mixture_ok(F.col("question"), F.col("assistant"), kind).alias("ok"))


@query(r"""WITH t AS (SELECT 'Describe document ' || doc_id || ' of source ' || coalesce(source, '') || '.' || CASE WHEN doc_id % 11 = 0 THEN ' Use def f.' ELSE '' END AS q, CASE WHEN doc_id % 7 = 0 THEN text || '```' ELSE text END AS r, repeat(lang, 1 + doc_id::INT % 130) AS a FROM documents),
    n AS (SELECT *, greatest(1, floor(length(q) / 3.5)) AS nq, CASE WHEN length(r) = 0 THEN 0 ELSE greatest(1, floor(length(r) / 3.5)) END AS nr, greatest(1, floor(length(a) / 3.5)) AS na FROM t)
    SELECT reason, count(*) AS n FROM (SELECT CASE WHEN length(trim(r, E' \t\n\r')) = 0 OR len(list_distinct(string_split(trim(r, E' \t\n\r'), ''))) < 8 THEN 'dirty_text' WHEN contains(r, '```') THEN 'code_in_reasoning' WHEN contains(q, 'def ') THEN 'code_question' WHEN nr > 500 THEN 'reasoning_too_long' WHEN na > 72 THEN 'answer_too_long'
        WHEN nq + nr + na > 450 THEN 'total_too_long' WHEN length(a) > 400 THEN 'answer_chars_too_long' ELSE 'pass' END AS reason FROM n) GROUP BY 1""")
def long_thought_filter(spark: SparkSession, d: str) -> DataFrame:
    """Whole texts as reasoning, some with code, some questions about code, answers of all lengths."""
    k = F.col("doc_id")
    q = F.concat(F.lit("Describe document "), k, F.lit(" of source "), F.coalesce("source", F.lit("")), F.lit("."), F.when(k % 11 == 0, " Use def f.").otherwise(""))
    r = F.when(k % 7 == 0, F.concat("text", F.lit("```"))).otherwise(F.col("text"))
    why = Rp.long_thought_reason(F.col("q"), F.col("r"), F.col("a"), most_reasoning=250, most_answer=28, most_total=450)
    rows = table(spark, d, "documents").select(q.alias("q"), r.alias("r"), F.repeat("lang", (1 + k % 130).cast("int")).alias("a"))
    return rows.groupBy(F.coalesce(why, F.lit("pass")).alias("reason")).agg(F.count("*").alias("n"))


# --- records --------------------------------------------------------------------------------------


@query(f"""WITH {V.PROBLEMS}, x AS (SELECT *, '  Because  ' || task_type || chr(10) || ' of ' || question AS reasoning, ' ' || answer || '  ' AS raw FROM problems),
    y AS (SELECT *, trim(regexp_replace(reasoning, '\\s+', ' ', 'g')) AS clean, trim(regexp_replace(raw, '\\s+', ' ', 'g')) AS final FROM x),
    z AS (SELECT *, 'Solve the problem. Think briefly, then give the final answer after </think>.' || chr(10) || chr(10) || 'Problem: ' || question AS user, '<think>' || chr(10) || clean || chr(10) || '</think>' || chr(10) || chr(10) || final AS assistant FROM y)
    SELECT 'stage2-train-external-' || printf('%05d', row_number() OVER (ORDER BY _ord) - 1) AS id, 'external' AS category, 'hub' AS source, user AS asked, assistant AS said, final AS final_answer, {TOKENS.format('clean')} AS reasoning_tokens, {TOKENS.format('user')} + {TOKENS.format('assistant')} AS total_tokens, pid AS original_id FROM z""")
def external_records(spark: SparkSession, d: str) -> DataFrame:
    reasoning = F.concat(F.lit("  Because  "), "task_type", F.lit("\n of "), "question")
    rows = V.problems(spark, d).select("_ord", "question", reasoning.alias("reasoning"), F.concat(F.lit(" "), "answer", F.lit("  ")).alias("answer"), F.col("pid").alias("original_id"), F.create_map(F.lit("question"), F.lit("question")).alias("fields_used"))
    out = Rp.external_record(rows, "train", "external", "hub")
    m = F.col("metadata")
    return out.select("id", "category", "source", F.col("messages")[0]["content"].alias("asked"), F.col("messages")[1]["content"].alias("said"), m["final_answer"].alias("final_answer"), m["reasoning_token_estimate"].alias("reasoning_tokens"), m["total_token_estimate"].alias("total_tokens"), m["source_original_id"].alias("original_id"))


_GOOD = f"WITH {CHAT}, good AS (SELECT *, [x[2] for x in list_zip(roles, texts) if x[1] = 'assistant'][-1] AS last_assistant, row_number() OVER (ORDER BY conv_id) - 1 AS i FROM conv WHERE error IS NULL)"


def _good(spark: SparkSession, d: str) -> DataFrame:
    rows = C.validate(chat(spark, d)).filter("error is null")
    return rows.select(F.col("conv_id").cast("string").alias("id"), "category", F.lit("no_robots").alias("source"), "messages", "_ord")


def _flat(out: DataFrame, *fields: str) -> DataFrame:
    return out.select("id", "category", "source", F.size("messages").cast("long").alias("n_messages"), *[F.col(f"metadata.{c}").alias(c) for c in fields])


@query(f"{_GOOD} SELECT 'stage2-validation-stage1_5_strict_replay-' || printf('%05d', i) AS id, 'stage1_5_strict_replay' AS category, 'stage1_5_replay' AS source, n AS n_messages, false AS thinking, last_assistant AS final_answer, 0::BIGINT AS reasoning_token_estimate, {TOKENS.format('first_user')} + {TOKENS.format('last_assistant')} AS total_token_estimate, conv_id::VARCHAR AS source_original_id, category AS source_category FROM good")
def replay_records_strict(spark: SparkSession, d: str) -> DataFrame:
    return _flat(Rp.replay_record(_good(spark, d), "validation", "stage1_5_strict_replay"), "thinking", "final_answer", "reasoning_token_estimate", "total_token_estimate", "source_original_id", "source_category")


@query(f"{_GOOD} SELECT 'stage2-train-no_robots_open_replay-' || printf('%05d', i) AS id, 'no_robots_open_replay' AS category, 'no_robots' AS source, n AS n_messages, '' AS final_answer, {TOKENS.format('first_user')} + {TOKENS.format('last_assistant')} AS total_token_estimate, 'train' AS split FROM good")
def replay_records_open(spark: SparkSession, d: str) -> DataFrame:
    return _flat(Rp.replay_record(_good(spark, d), "train", "no_robots_open_replay", open_=True), "final_answer", "total_token_estimate", "split")


@query(f"{_GOOD} SELECT 'stage3-train-stage1_5_replay-' || printf('%06d', i) AS id, 'stage1_5_replay' AS category, 'stage1_5_replay' AS source, 2::BIGINT AS n_messages, conv_id::VARCHAR AS source_id, category AS source_category, {HASH.format('first_user')} AS prompt_hash, trim(last_assistant, E' \\n\\t') AS final_answer, {TOKENS.format('first_user')} + {TOKENS.format("trim(last_assistant, E' \\n\\t')")} AS token_length FROM good")
def replay_records_mixture(spark: SparkSession, d: str) -> DataFrame:
    return _flat(Rp.mixture_record(_good(spark, d), "train", Rp.STRICT), "source_id", "source_category", "prompt_hash", "final_answer", "token_length")


@query(f"{_GOOD} SELECT conv_id, array_to_string([CASE WHEN j = n AND roles[j] = 'assistant' THEN '<|im_start|>assistant' || chr(10) || '<think>' || chr(10) || chr(10) || '</think>' || chr(10) || chr(10) || ltrim(texts[j], chr(10)) || '<|im_end|>' || chr(10) ELSE '<|im_start|>' || roles[j] || chr(10) || texts[j] || '<|im_end|>' || chr(10) END for j in generate_series(1, n)], '') AS rendered FROM good")
def render_base(spark: SparkSession, d: str) -> DataFrame:
    return _good(spark, d).select(F.col("id").cast("long").alias("conv_id"), C.render_base().alias("rendered"))


# --- reports --------------------------------------------------------------------------------------


def _generated(spark: SparkSession, d: str) -> DataFrame:
    return V.thinking(spark, d).select("pid", "_ord", "wants_think", F.col("assistant").alias("generated"), F.col("answer").alias("expected"), (5 + F.col("_ord") % 300).alias("tokens"))


_GEN = f"{V.THINKING}, g AS (SELECT *, assistant AS generated, answer AS expected, 5 + _ord % 300 AS tokens, contains(assistant, '<think>') AS tagged, contains(assistant, '</think>') AS closed, trim(assistant, E' \\n') AS bare, len(regexp_extract_all(assistant, '\\S+')) AS words FROM thinking)"
_rate = lambda n: f"round({n} / total, 6)::DOUBLE AS {n}_rate"


def _strict_sql(source: str) -> str:
    return f"s AS (SELECT count(*) AS total, count(*) FILTER (bare = trim(expected)) AS exact_match, count(*) FILTER (NOT tagged) AS no_spurious_think, count(*) FILTER (tagged) AS spurious_think, count(*) FILTER (NOT tagged) AS format_correct, count(*) FILTER (tokens < 128) AS stop_success FROM {source})"


@query(f"WITH {_GEN}, {_strict_sql('g')} SELECT *, {', '.join(_rate(n) for n in ('exact_match', 'no_spurious_think', 'spurious_think', 'format_correct', 'stop_success'))} FROM s")
def strict_regression(spark: SparkSession, d: str) -> DataFrame:
    return Rg.strict(_generated(spark, d))


def _open_sql(short: str) -> str:
    return f"""WITH {_GEN}, s AS (SELECT count(*) AS total, count(*) FILTER (tagged) AS spurious_think, count(*) FILTER (tokens < 256) AS stop_success, count(*) FILTER ({short}) AS too_short, round(avg(tokens), 6) AS mean_tokens, round(avg(words), 1) AS word_count_mean, min(words) AS word_count_min, max(words) AS word_count_max FROM g)
    SELECT *, {', '.join(_rate(n) for n in ('spurious_think', 'stop_success', 'too_short'))} FROM s"""


@query(_open_sql("tokens < 10"))
def open_regression_tokens(spark: SparkSession, d: str) -> DataFrame:
    return Rg.open_answers(_generated(spark, d))


@query(_open_sql("words <= 3"))
def open_regression_words(spark: SparkSession, d: str) -> DataFrame:
    return Rg.open_answers(_generated(spark, d), short_by="words")


@query(f"""WITH {_GEN}, top AS (SELECT *, row_number() OVER (ORDER BY _ord) AS r, row_number() OVER (PARTITION BY wants_think ORDER BY _ord) AS w FROM g),
    a AS (SELECT 'strict' AS report, count(*) AS total, count(*) FILTER (bare = trim(expected)) AS passed FROM top WHERE r <= 40
    UNION ALL SELECT 'protocol', count(*), count(*) FILTER (CASE WHEN wants_think THEN tagged AND closed ELSE NOT tagged END) FROM top WHERE w <= 30 UNION ALL SELECT 'open', count(*), count(*) FILTER (words > 3) FROM top WHERE r <= 20)
    SELECT *, round(passed / greatest(total, 1), 6)::DOUBLE AS rate FROM a""")
def regression_trio(spark: SparkSession, d: str) -> DataFrame:
    g = _generated(spark, d)
    return Rg.trio(g, g, g)


@query(f"WITH {V.PREDICTIONS} SELECT pid, pid AS right_pid, gold, prediction_raw AS right_prediction FROM predictions")
def positional_join(spark: SparkSession, d: str) -> DataFrame:
    """Problems and predictions met row by row: each prediction lies at the place of its problem."""
    left = V.problems(spark, d).select("pid", F.col("answer").alias("gold"), "_ord")
    right = V.predictions(spark, d).select("pid", F.col("prediction_raw").alias("prediction"), "_ord")
    return Rp.positional_join(left, right).drop("_ord")


@query(f"WITH {V.PROBLEMS}, r AS (SELECT pid, row_number() OVER (ORDER BY _ord) AS r FROM problems) SELECT 'overfit' AS mode, pid FROM r WHERE r <= 16 UNION ALL SELECT 'smoke', pid FROM r WHERE r <= 256 UNION ALL SELECT 'formal', pid FROM r")
def run_limits(spark: SparkSession, d: str) -> DataFrame:
    p = V.problems(spark, d)
    parts = [Rg.first_rows(p, Rg.run_limits(m, {})["example_limit"]).select(F.lit(m).alias("mode"), "pid") for m in ("overfit", "smoke", "formal")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(f"WITH {V.PROBLEMS} SELECT task_type, pid, row_number() OVER (PARTITION BY task_type ORDER BY _ord) - 1 AS index FROM problems WHERE task_type IN ('gravity', 'cipher')")
def sequential_index(spark: SparkSession, d: str) -> DataFrame:
    parts = [Rp.sequential_index(V.problems(spark, d).filter(F.col("task_type") == t)).select("task_type", "pid", "index") for t in ("gravity", "cipher")]
    return parts[0].unionByName(parts[1])


@query(f"WITH {V.PROBLEMS} SELECT pid, answer AS solved, true AS ok, NULL::VARCHAR AS error FROM problems WHERE task_type IN ('symbolic_transform', 'numeral', 'cipher')")
def reason_later_versions(spark: SparkSession, d: str) -> DataFrame:
    """The registry of the second and third version, whose symbolic dispatcher returns at once."""
    return R.reason(_parsed(spark, d).filter(F.col("task_type").isin("symbolic_transform", "numeral", "cipher")), 2).select("pid", "solved", "ok", "error")


# --- raw traces and decimals ----------------------------------------------------------------------

_RAW = """raw AS (SELECT p_partkey AS k, 'Look' || {nl} || CASE WHEN p_partkey % 3 = 0 THEN 'match, correct, actions: reversed ' || p_size || ', addition,' WHEN p_partkey % 3 = 1 THEN 'The question operator is [+], which is concatenation.' ELSE 'The question operator is (*), which is unknown.' END
    || {nl} || 'Selected' || {nl} || '0 I' || p_size || {nl} || '1  XOR ' || p_partkey % 8 || CASE WHEN p_partkey % 2 = 0 THEN {nl} || {nl} || '2 late' ELSE {nl} || 'end' END || {nl} || 'so {box}{{first}} and {box}{{' || CASE WHEN p_partkey % 5 = 0 THEN '–' ELSE 'v' || p_size END || '}}' AS trace FROM part)"""


@query("WITH " + _RAW.format(nl="chr(10)", box="\\boxed").replace("{{", "{").replace("}}", "}") + """ SELECT k, CASE WHEN k % 5 = 0 THEN 'first' ELSE 'v' || p_size END AS answer, 'I' || p_size || ';' || 'XOR ' || k % 8 AS rules, CASE k % 3 WHEN 0 THEN 'reversed ' || p_size || ', addition' WHEN 1 THEN 'concatenation on operator [+]' ELSE '' END AS rule, 'so and' AS clean FROM raw JOIN part ON k = p_partkey""")
def raw_traces(spark: SparkSession, d: str) -> DataFrame:
    k, s, nl = F.col("p_partkey"), F.col("p_size").cast("string"), F.lit("\n")
    operator = F.when(k % 3 == 0, F.concat(F.lit("match, correct, actions: reversed "), s, F.lit(", addition,"))).when(k % 3 == 1, "The question operator is [+], which is concatenation.").otherwise("The question operator is (*), which is unknown.")
    boxes = F.concat(F.lit("so \\boxed{first} and \\boxed{"), F.when(k % 5 == 0, "–").otherwise(F.concat(F.lit("v"), s)), F.lit("}"))
    text = F.concat_ws("\n", F.lit("Look"), operator, F.lit("Selected"), F.concat(F.lit("0 I"), s), F.concat(F.lit("1  XOR "), k % 8, F.when(k % 2 == 0, "\n\n2 late").otherwise("\nend")), boxes)
    t = table(spark, d, "part").select(k.alias("k"), text.alias("trace"), boxes.alias("last"))
    return t.select("k", Raw.answer("trace").alias("answer"), F.array_join(Raw.selected_rules("trace"), ";").alias("rules"), Raw.symbolic_rule("trace").alias("rule"), Raw.clean_line("last").alias("clean"))


@query("""WITH x AS (SELECT p_partkey AS k, (p_partkey * 37 % 100000)::VARCHAR || CASE p_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN '.5' WHEN 2 THEN '.' || lpad((p_partkey % 1000)::VARCHAR, 4, '0') ELSE '.07' END AS a FROM part), y AS (SELECT *, CASE WHEN contains(a, '.') THEN length(split_part(a, '.', 2)) ELSE 0 END AS n FROM x)
    SELECT k, n AS places, CASE WHEN n > 3 THEN left(a, length(a) - n + 3) ELSE a END AS truncated, CASE WHEN n = 0 THEN a || '.' ELSE a END || repeat('0', greatest(0, 6 - n)) AS padded, CASE WHEN n = 0 THEN a || '.' ELSE a END || repeat('0', greatest(0, 2 - n)) AS matched, lpad(k::VARCHAR, greatest(length(k::VARCHAR), 4)::INT, '0')[:-4] || '.' || right(lpad(k::VARCHAR, greatest(length(k::VARCHAR), 4)::INT, '0'), 3) AS scaled FROM y""")
def decimal_strings(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    tail = F.when(k % 4 == 0, "").when(k % 4 == 1, ".5").when(k % 4 == 2, F.concat(F.lit("."), F.lpad((k % 1000).cast("string"), 4, "0"))).otherwise(".07")
    x = table(spark, d, "part").select(k.cast("long").alias("k"), F.concat((k * 37 % 100000).cast("string"), tail).alias("a"))
    return x.select("k", Dec.places("a").cast("long").alias("places"), Dec.truncated("a").alias("truncated"), Dec.padded("a", 6).alias("padded"), Dec.matched("a", F.lit("1.25"))["a"].alias("matched"), Dec.scaled("k", 3).alias("scaled"))
