"""Queries for record validators, the short error taxonomy, bit strings and numerals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.functions import bits as B
from loomwork.functions import thinking as Th
from loomwork.functions import url as U
from loomwork.functions.text import token_estimate
from loomwork.operators import generate as Gn
from loomwork.operators import mixture as Mx
from loomwork.operators import reason as R
from loomwork.operators import records as Rec
from loomwork.plans import views as V
from loomwork.plans.core_queries import TOKENS
from loomwork.plans.problem_queries import _SCORED, _scored
from loomwork.plans.registry import query, table
from loomwork.plans.training_queries import _solved, ids

_KINDS = ("exact_output", "binary_only", "yes_no", "classification", "line_count", "stop_behavior")
# Every seventh row has a defect of its own.
_DEFECTS = {0: "answer || ' '", 1: "'Sure, ' || answer", 2: "answer || '<|im_end|>'", 3: "''", 4: "'```' || answer || '```'", 5: "'maybe'"}


def _defective(engine: str) -> str:
    rows = " UNION ALL ".join(Gn.sql(c, "@ids", 11, engine) for c in _KINDS)
    cases = " ".join(f"WHEN {k} THEN {e}" for k, e in _DEFECTS.items())
    return f"SELECT id, category, user, CASE id % 9 {cases} ELSE answer END AS assistant FROM ({rows})"


_STRICT = f"""WITH r AS ({_defective('duckdb').replace('@ids', '(SELECT p_partkey AS id FROM part)')}) SELECT id, category, CASE
    WHEN assistant = '' THEN 'empty_assistant' WHEN contains(assistant, '<|im_end|>') THEN 'end_mark' WHEN regexp_matches(assistant, '^\\s|\\s$') THEN 'outer_whitespace'
    WHEN regexp_matches(lower(assistant), '^(sure|here is|the answer is|i hope this helps|```)') THEN 'explanatory_prefix' WHEN contains(assistant, '```') THEN 'markdown_fence'
    WHEN category = 'binary_only' AND NOT regexp_full_match(assistant, '[01]{{8}}') THEN 'not_8_bits' WHEN category = 'yes_no' AND assistant NOT IN ('yes', 'no') THEN 'not_yes_no'
    WHEN category = 'classification' AND assistant NOT IN ('positive', 'negative', 'neutral') THEN 'not_a_label' WHEN category = 'line_count' AND len(string_split(assistant, chr(10))) <> 2 THEN 'wrong_line_count' END AS error FROM r"""


@query(_STRICT.replace("{{8}}", "{8}"))
def record_errors_strict(spark: SparkSession, d: str) -> DataFrame:
    text = _defective("spark").replace("{", "{{").replace("}", "}}").replace("@ids", "{ids}")
    rows = spark.sql(text, ids=ids(spark, d))
    error = Rec.strict_error(F.col("category"), F.col("user"), F.col("assistant"), categories=_KINDS, line_count=F.when(F.col("category") == "line_count", 2))
    return rows.select("id", "category", error.alias("error"))


@query(f"""WITH {V.THINKING}, {_SCORED} SELECT pid, CASE WHEN wants_think AND NOT think_open THEN 'missing_think' WHEN wants_think AND NOT think_close THEN 'unclosed_think' WHEN wants_think AND final = '' THEN 'parse_fail'
    WHEN tokens >= 256 THEN 'stop_fail' WHEN final = '' THEN 'parse_fail' WHEN regexp_replace(final, '[^0-9]', '', 'g') = regexp_replace(answer, '[^0-9]', '', 'g') AND final <> answer THEN 'rounding_error' WHEN final <> answer THEN 'answer_wrong' ELSE 'unknown' END AS error_class FROM scored WHERE NOT exact""")
def error_class_mini(spark: SparkSession, d: str) -> DataFrame:
    wrong = _scored(spark, d).filter("not exact")
    return wrong.select("pid", Rec.mini_error_class(F.col("final"), F.col("answer"), F.col("assistant"), F.col("wants_think"), F.col("tokens")).alias("error_class"))


@query("""WITH x AS (SELECT p_partkey AS k, lpad(bin(p_partkey % 256), 8, '0') AS b, p_partkey % 3999 + 1 AS n FROM part)
    SELECT k, b, translate(b, '01', '10') AS inverted, substr(b, 4) || substr(b, 1, 3) AS left_3, substr(b, 7) || substr(b, 1, 6) AS right_2, substr(b, 3) || '00' AS shifted_left, '0' || substr(b, 1, 7) AS shifted_right,
        lpad(bin(xor(k % 256, 170)), 8, '0') AS xored, ['', 'M', 'MM', 'MMM'][(n // 1000) % 10 + 1] || ['', 'C', 'CC', 'CCC', 'CD', 'D', 'DC', 'DCC', 'DCCC', 'CM'][(n // 100) % 10 + 1] || ['', 'X', 'XX', 'XXX', 'XL', 'L', 'LX', 'LXX', 'LXXX', 'XC'][(n // 10) % 10 + 1] || ['', 'I', 'II', 'III', 'IV', 'V', 'VI', 'VII', 'VIII', 'IX'][n % 10 + 1] AS numeral FROM x""")
def bits_and_numerals(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    rows = table(spark, d, "part").select(k.alias("k"), B.eight(k % 256).alias("b"))
    b = F.col("b")
    return rows.select(
        "k", "b", B.invert(b).alias("inverted"), B.rotate_left(b, 3).alias("left_3"), B.rotate_right(b, 2).alias("right_2"), B.shift_left(b, 2).alias("shifted_left"), B.shift_right(b, 1).alias("shifted_right"),
        B.masked(b, F.lit("10101010"), "xor").alias("xored"), B.roman(F.col("k") % 3999 + 1).alias("numeral"),
    )


@query()
def record_errors_mixture(spark: SparkSession, d: str) -> DataFrame:
    """Emitted rows, every fifth with a defect, through the mixture's validator."""
    rows = R.emit(_solved(spark, d), 3, budget=True).filter("skip_reason is null")
    k = F.pmod(F.xxhash64("pid"), F.lit(10))
    text = F.when(k == 0, F.concat("assistant", F.lit("<|im_end|>"))).when(k == 1, F.concat("assistant", F.lit("\nand more"))).when(k == 2, F.concat(F.lit("<think>"), "assistant")).otherwise(F.col("assistant"))
    rows = rows.withColumn("assistant", text)
    error = Rec.mixture_error(F.col("task_type"), F.col("sample_type"), F.col("user"), F.col("assistant"), tokens=F.col("tokens"), gold=F.col("gold"), final_answer=F.col("gold"), reasoner_answer=F.col("solved"))
    return rows.groupBy("sample_type", F.coalesce(error, F.lit("ok")).alias("error")).agg(F.count("*").alias("n"))


# The lenient rule: the first of each tag, and a thought that is not blank.
_LENIENT = f"""WITH {V.THINKING}, a AS (SELECT *, strpos(assistant, '<think>') AS a, strpos(assistant, '</think>') AS z FROM thinking),
    p AS (SELECT *, coalesce(a > 0 AND z > a AND trim(substr(assistant, a + 7, greatest(0, z - a - 7)), E' \\n') <> '', false) AS parsed, trim(substr(assistant, z + 8), E' \\n') AS final, trim(substr(assistant, a + 7, greatest(0, z - a - 7)), E' \\n') AS reasoning, task_type = 'bit_manipulation' AS bits FROM a),
    e AS (SELECT *, CASE WHEN NOT parsed THEN 'no_think_structure' WHEN final = '' THEN 'empty_final' WHEN final <> answer THEN 'final_mismatch' WHEN {TOKENS.format('reasoning')} > 306 THEN 'reasoning_too_long'
        WHEN {TOKENS.format('question')} + {TOKENS.format('assistant')} > 640 THEN 'total_too_long' WHEN contains(final, chr(10)) AND len(regexp_extract_all(final, '[\\p{{L}}\\p{{N}}_]+')) > 40 THEN 'final_explains' WHEN bits AND NOT regexp_full_match(final, '[01]{{8}}') THEN 'not_8_bits' ELSE 'ok' END AS thinking_error,
        CASE WHEN contains(assistant, '<think>') OR contains(assistant, '</think>') THEN 'think_tags' WHEN bits AND NOT regexp_full_match(trim(assistant), '[01]{{8}}') THEN 'not_8_bits' ELSE 'ok' END AS plain_error FROM p)
    SELECT CASE WHEN wants_think THEN 'thinking' ELSE 'no_think' END AS kind, CASE WHEN wants_think THEN thinking_error ELSE plain_error END AS error, count(*) AS n FROM e GROUP BY ALL"""


@query(_LENIENT)
def record_errors_thinking(spark: SparkSession, d: str) -> DataFrame:
    t = V.thinking(spark, d)
    error = Rec.thinking_error(F.col("question"), F.col("assistant"), thinking=F.col("wants_think"), final_answer=F.col("answer"), subtype=F.when(F.col("task_type") == "bit_manipulation", "binary_operation_thinking"))
    plain = Rec.no_think_error(F.col("assistant"), thinking=F.col("wants_think"), source_category=F.when(F.col("task_type") == "bit_manipulation", "binary_only"), open_replay=F.lit(False))
    return t.groupBy(F.when(F.col("wants_think"), "thinking").otherwise("no_think").alias("kind"), F.coalesce(F.when(F.col("wants_think"), error).otherwise(plain), F.lit("ok")).alias("error")).agg(F.count("*").alias("n"))


@query(f"""WITH {V.PROBLEMS} SELECT pid, prompt || chr(10) || chr(10) || 'Return only the final answer. Do not explain.' AS answer_only, prompt || chr(10) || chr(10) || 'Think briefly in <think>...</think>, then output only the final answer.' AS cot, prompt || chr(10) || chr(10) || 'Answer:' AS evaluation,
    '<think>' || chr(10) || 'r' || chr(10) || '</think>' || chr(10) || chr(10) || answer AS completion FROM problems""")
def prompts_built(spark: SparkSession, d: str) -> DataFrame:
    """Both prompt forms and the evaluation prompt of each problem."""
    p = V.problems(spark, d)
    return p.select("pid", R.answer_prompt("prompt").alias("answer_only"), R.cot_prompt("prompt").alias("cot"), F.concat("prompt", F.lit("\n\nAnswer:")).alias("evaluation"), Th.build(F.lit("r"), "answer").alias("completion"))


@query(f"WITH {V.PROBLEMS} SELECT pid, {TOKENS.format('prompt')} AS prompt_tokens, {TOKENS.format('answer')} AS answer_tokens, {TOKENS.format("(prompt || chr(10) || chr(10) || 'Answer: ' || answer)")} AS full_tokens FROM problems")
def token_profile(spark: SparkSession, d: str) -> DataFrame:
    """Tokens of prompt, answer and the full text, which is counted by itself."""
    full = F.concat("prompt", F.lit("\n\nAnswer: "), "answer")
    return V.problems(spark, d).select("pid", token_estimate("prompt").alias("prompt_tokens"), token_estimate("answer").alias("answer_tokens"), token_estimate(full).alias("full_tokens"))


@query("""WITH u AS (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN replace(url, '://', '://user:pw@') WHEN page_id % 3 = 1 THEN replace(url, '://', ':/') ELSE url END AS url FROM pages)
    SELECT page_id, regexp_matches(lower(url), '^(http|https|socks5|socks5h)://[^/?#]+') AS valid, regexp_replace(url, '^([A-Za-z][A-Za-z0-9+.-]*://)[^/?#@]*@', '\\1') AS redacted,
        nullif(lower(regexp_extract(url, '^[^:]+://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '') AS host FROM u""")
def url_redaction(spark: SparkSession, d: str) -> DataFrame:
    k, u = F.col("page_id") % 3, F.col("url")
    url = F.when(k == 0, F.replace(u, F.lit("://"), F.lit("://user:pw@"))).when(k == 1, F.replace(u, F.lit("://"), F.lit(":/"))).otherwise(u)
    rows = table(spark, d, "pages").select("page_id", url.alias("url"))
    return rows.select("page_id", U.valid(F.col("url")).alias("valid"), U.redact(F.col("url")).alias("redacted"), U.host(F.col("url")).alias("host"))


_CATEGORIES = ("simple_math_thinking", "comparison_thinking", "yes_no_reasoning_thinking")
#: Parts for one row of each category, by split.
_SHARE = {"train": 40, "validation": 200}


@query("WITH p AS (SELECT count(*) AS n FROM part) SELECT split, category, least(n // share, 200) AS n, least(n // share, 200) AS n_prompts FROM p, (VALUES " + ", ".join(f"('{s}', {k})" for s, k in _SHARE.items()) + ") s(split, share), (VALUES " + ", ".join(f"('{c}')" for c in _CATEGORIES) + ") c(category) WHERE n >= share")
def mixture_stats(spark: SparkSession, d: str) -> DataFrame:
    """Pools with a draw for each part, filled under quotas that grow with the parts up to 200, with global dedup: every quota met, no prompt twice."""
    draws = ids(spark, d)
    n = draws.count()
    quotas = {s: {c: min(n // k, 200) for c in _CATEGORIES} for s, k in _SHARE.items() if n >= k}
    return Mx.stats(Mx.assemble(Mx.pools(spark, quotas, ids=draws), quotas)).select("split", "category", "n", "n_prompts")
