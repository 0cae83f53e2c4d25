"""Queries for generators, chat rendering and label audits, selection under quotas, solvers, mixtures and gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.functions import bit_rules as B
from loomwork.functions.session import settle
from loomwork.functions.text import prompt_hash
from loomwork.operators import audit as A
from loomwork.operators import chat as C
from loomwork.operators import classify as K
from loomwork.operators import gates as Gt
from loomwork.operators import generate as Gn
from loomwork.operators import reason as R
from loomwork.operators import select as Se
from loomwork.operators import token_masks as Tm
from loomwork.operators.split import shuffle_key
from loomwork.plans import views as V
from loomwork.plans.core_queries import CHAT, HASH, TOKENS, chat
from loomwork.plans.registry import ORACLES, QUERIES, query, table
from loomwork.sources.files import external_reject_reason
from loomwork.streaming.validate import windowed_counts

# --- generators: a query a category ---------------------------------------------------------------

_IDS = "(SELECT p_partkey AS id FROM part)"


def ids(spark: SparkSession, d: str) -> DataFrame:
    """A draw for each part."""
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"))


def _generator(category: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        return Gn.generate(spark, category, ids(spark, d)).select("id", "category", "user", "reasoning", "answer")

    return run


for _c in (*Gn.STRICT, *Gn.THINKING):
    QUERIES[f"gen_{_c}"] = _generator(_c)
    ORACLES[f"gen_{_c}"] = Gn.sql(_c, _IDS, 42, "duckdb")


@query("WITH g AS (" + " UNION ALL ".join(Gn.sql(c, _IDS, 7, "duckdb") for c in ("simple_math_thinking", "comparison_thinking", "yes_no")) + f"), u AS (SELECT category, {HASH.format('user')} AS h, min(id) AS id FROM g GROUP BY ALL) SELECT category, least(count(*), 40) AS n FROM u GROUP BY 1")
def gen_quota_counts(spark: SparkSession, d: str) -> DataFrame:
    parts = [Gn.over_generate(spark, c, 40, 7, ids=ids(spark, d)).groupBy("category").agg(F.count("*").alias("n")) for c in ("simple_math_thinking", "comparison_thinking", "yes_no")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


# --- chat and audit -------------------------------------------------------------------------------


@query(f"WITH {CHAT} SELECT conv_id, array_to_string([('<|im_start|>' || roles[i] || chr(10) || texts[i] || '<|im_end|>' || chr(10)) for i in generate_series(1, n)], '') AS rendered FROM conv")
def render_training(spark: SparkSession, d: str) -> DataFrame:
    return chat(spark, d).select("conv_id", C.render().alias("rendered"))


@query(f"WITH {CHAT} SELECT conv_id, array_to_string([('<|im_start|>' || roles[i] || chr(10) || texts[i] || '<|im_end|>' || chr(10)) for i in generate_series(1, n)], '') || '<|im_start|>assistant' || chr(10) || '<think>' || chr(10) || chr(10) || '</think>' || chr(10) || chr(10) AS rendered FROM conv")
def render_generation(spark: SparkSession, d: str) -> DataFrame:
    return chat(spark, d).select("conv_id", C.render(generation=True, no_think=True).alias("rendered"))


# A message is a header, its words and an end mark; an assistant message is one span from its first word to its end mark.
_SEG = """seg AS (SELECT conv_id, turn, role, len(regexp_extract_all(text, '\\S+')) + 2 AS n, sum(len(regexp_extract_all(text, '\\S+')) + 2) OVER (PARTITION BY conv_id ORDER BY turn) AS upto FROM conversations),
tot AS (SELECT conv_id, sum(n) AS original_tokens, coalesce(sum(n - 1) FILTER (role = 'assistant'), 0) AS original_supervised_tokens, count(*) FILTER (role = 'assistant') AS original_spans,
    coalesce(sum(greatest(0, least(upto, 120) - (upto - n + 1))) FILTER (role = 'assistant'), 0) AS supervised_tokens, coalesce(bool_or(role = 'assistant' AND upto - n + 1 < 120 AND 120 <= upto - 1), false) AS cut FROM seg GROUP BY 1)"""


@query(f"WITH {_SEG} SELECT conv_id, original_tokens::BIGINT AS original_tokens, original_supervised_tokens::BIGINT AS original_supervised_tokens, original_spans, supervised_tokens::BIGINT AS supervised_tokens, original_tokens > 120 AS truncated, cut AS truncates_supervised_span, CASE WHEN original_supervised_tokens = 0 THEN 'no_supervised_tokens' END AS error FROM tot")
def label_audit(spark: SparkSession, d: str) -> DataFrame:
    return A.audit(chat(spark, d), 120).select("conv_id", "original_tokens", "original_supervised_tokens", "original_spans", "supervised_tokens", "truncated", "truncates_supervised_span", "error")


@query(f"WITH {_SEG} SELECT conv_id, (upto - n + 1)::BIGINT AS first, (upto - 1)::BIGINT AS last FROM seg WHERE role = 'assistant'")
def mask_spans(spark: SparkSession, d: str) -> DataFrame:
    return chat(spark, d).select("conv_id", F.explode(A.spans(A.mask())).alias("s")).select("conv_id", F.col("s.start").cast("long").alias("first"), F.col("s.end").cast("long").alias("last"))


_AUDITED = f"WITH {_SEG}, k AS (SELECT *, CASE WHEN conv_id % 3 = 0 THEN 'validation' ELSE 'train' END AS split, original_tokens <= 120 AND original_supervised_tokens > 0 AS eligible FROM tot)"


def _audited(spark: SparkSession, d: str) -> DataFrame:
    return A.audit(chat(spark, d), 120).withColumn("split", F.when(F.col("conv_id") % 3 == 0, "validation").otherwise("train"))


@query(_AUDITED + " SELECT split, count(*) AS n, count(*) FILTER (eligible) AS n_eligible, count(*) FILTER (NOT eligible) AS n_excluded, count(*) FILTER (original_tokens > 120) AS n_truncated, sum(supervised_tokens)::BIGINT AS supervised_tokens, max(original_tokens)::BIGINT AS longest, round(avg(least(original_tokens, 120)), 6) AS mean_tokens FROM k GROUP BY 1")
def audit_report(spark: SparkSession, d: str) -> DataFrame:
    return A.report(_audited(spark, d), "split")


_WHY = "CASE WHEN original_supervised_tokens = 0 THEN 'no_supervised_tokens' ELSE 'sequence_exceeds_max_length' END"


@query(_AUDITED + f" SELECT split, conv_id AS key, {_WHY} AS reason FROM k WHERE NOT eligible")
def audit_excluded(spark: SparkSession, d: str) -> DataFrame:
    return A.excluded(_audited(spark, d), "split", "conv_id")


@query(_AUDITED + f" SELECT split, {_WHY} AS reason, count(*) AS n FROM k WHERE NOT eligible GROUP BY ALL")
def audit_reasons(spark: SparkSession, d: str) -> DataFrame:
    return A.reasons(_audited(spark, d), "split")


@query(_AUDITED + """, c AS (SELECT split, 'original_tokens' AS count, original_tokens AS t FROM k UNION ALL SELECT split, 'sequence_tokens', least(original_tokens, 120) FROM k UNION ALL SELECT split, 'supervised_tokens', supervised_tokens FROM k)
    SELECT split, count, count(*) AS n, min(t)::DOUBLE AS min, round(avg(t), 6) AS mean, max(t)::DOUBLE AS max, """ + ", ".join(f"round(quantile_cont(t, {p}), 6)::DOUBLE AS p{round(p * 100)}" for p in (0.5, 0.9, 0.95, 0.99)) + " FROM c GROUP BY ALL")
def audit_distributions(spark: SparkSession, d: str) -> DataFrame:
    return A.distributions(_audited(spark, d), "split")


def _tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query()
def token_masks(spark: SparkSession, d: str) -> DataFrame:
    """The audit over a real tokenizer's tokens; a test holds masks against each character's token."""
    rows = Tm.tokenized(chat(spark, d), _tokenizer())
    return A.audit_arrays(rows, 512, end=F.col("end_id")).select("conv_id", "original_tokens", "original_supervised_tokens", "supervised_tokens", "original_spans", "truncated", "truncates_supervised_span", "end_supervised", "error", "eligible", "exclusion_reason")


@query(f"""WITH {CHAT} SELECT conv_id, array_to_string([('<|im_start|>' || roles[i] || chr(10) || CASE WHEN roles[i] = 'assistant' THEN ltrim(texts[i], chr(10)) ELSE texts[i] END || '<|im_end|>' || chr(10)) for i in generate_series(1, n)], '') AS text,
    len([i for i in generate_series(1, n) IF roles[i] = 'assistant']) AS n_spans, coalesce(list_sum([length(ltrim(texts[i], chr(10))) + 11 for i in generate_series(1, n) IF roles[i] = 'assistant']), 0)::BIGINT AS generated FROM conv""")
def generated_spans(spark: SparkSession, d: str) -> DataFrame:
    """The training form with the characters that are generated."""
    r = chat(spark, d).select("conv_id", Tm.rendered().alias("r"))
    return r.select("conv_id", F.col("r.text").alias("text"), F.size("r.spans").cast("long").alias("n_spans"), F.aggregate("r.spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"]).alias("generated"))


@query(_AUDITED + ", r AS (SELECT * FROM k WHERE eligible QUALIFY row_number() OVER (PARTITION BY split ORDER BY conv_id) <= 4) SELECT count(*) AS rows, bool_and(supervised_tokens > 0) AS mask_nonempty, true AS boundaries_present FROM r")
def batch_checks(spark: SparkSession, d: str) -> DataFrame:
    return A.batch_checks(_audited(spark, d), "split", "conv_id")


# --- selection ------------------------------------------------------------------------------------

_POOLS = f"pools AS (SELECT doc_id AS _ord, {HASH.format('text')} AS hash, lang AS bucket FROM documents)"
_ORDER = "CASE bucket WHEN 'en' THEN 1 WHEN 'fr' THEN 2 WHEN 'de' THEN 3 ELSE 4 END"


def _pools(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("_ord"), prompt_hash("text").alias("hash"), F.col("lang").alias("bucket"))


@query(f"WITH {_POOLS} SELECT _ord, bucket FROM pools QUALIFY row_number() OVER (PARTITION BY hash ORDER BY {_ORDER}, _ord) = 1")
def quota_select(spark: SparkSession, d: str) -> DataFrame:
    """Quotas that no bucket reaches: then selection equals the first of each hash by bucket and order."""
    return Se.quota_select(_pools(spark, d), dict.fromkeys(("en", "fr", "de", "es"), 10_000_000)).select("_ord", "bucket")


def _greedy_sql(quotas: dict[str, int]) -> str:
    """Bucket after bucket, each without the hashes picked before it."""
    parts, seen = [], []
    for k, (b, q) in enumerate(quotas.items()):
        known = " UNION ALL ".join(f"SELECT hash FROM p{i}" for i in seen)
        rest = f" AND hash NOT IN ({known})" if known else ""
        parts.append(f"p{k} AS (SELECT min(_ord) AS _ord, hash, any_value(bucket) AS bucket FROM pools WHERE bucket = '{b}'{rest} GROUP BY hash ORDER BY 1 LIMIT {q})")
        seen.append(k)
    return f"WITH {_POOLS}, " + ", ".join(parts) + " " + " UNION ALL ".join(f"SELECT _ord, bucket FROM p{i}" for i in seen)


_QUOTAS = {"en": 100, "fr": 30, "de": 30, "es": 20}


@query(_greedy_sql(_QUOTAS))
def quota_select_bounded(spark: SparkSession, d: str) -> DataFrame:
    return Se.quota_select(_pools(spark, d), _QUOTAS).select("_ord", "bucket")


# The first names its parts' numbers: the second part has fewer rows than that, and the others take what it lacks.
_PARTS = {"en": 150, "fr": 1_000_000, "de": 25}
_ROOM = ", ".join(f"('{k}', {v})" for k, v in _PARTS.items())
_DEALT = f"""WITH d AS (SELECT doc_id, lang, 'g' || (doc_id % 7) AS part FROM documents WHERE lang <> 'es' OR doc_id % 3 = 0), n AS (SELECT lang, part, count(*) AS n FROM d GROUP BY ALL), u AS (SELECT lang, sum(n)::BIGINT AS n, coalesce(any_value(q), 0)::BIGINT AS q FROM n LEFT JOIN (VALUES {_ROOM}) v(lang, q) USING (lang) GROUP BY 1),
    a AS (SELECT lang, n, least(n, q) AS got, n - least(n, q) AS room, @total - sum(least(n, q)) OVER () AS short, sum(n - least(n, q)) OVER () AS rooms FROM u),
    b AS (SELECT *, least(short, rooms)::BIGINT AS s FROM a), c AS (SELECT *, CASE WHEN rooms > 0 THEN (s * room // rooms)::BIGINT ELSE 0 END AS more, CASE WHEN rooms > 0 THEN (s * room % rooms)::BIGINT ELSE 0 END AS rest FROM b),
    e AS (SELECT lang, n, got + more + CASE WHEN row_number() OVER (ORDER BY rest DESC, lang) <= s - sum(more) OVER () THEN 1 ELSE 0 END AS q FROM c),
    f AS (SELECT n.lang, part, n.n, (q * n.n // e.n)::BIGINT AS k, (q * n.n % e.n)::BIGINT AS rest, q FROM n JOIN e USING (lang)),
    g AS (SELECT lang, part, n, k + CASE WHEN row_number() OVER (PARTITION BY lang ORDER BY rest DESC, part) <= q - sum(k) OVER (PARTITION BY lang) THEN 1 ELSE 0 END AS quota FROM f),
    r AS (SELECT doc_id, lang, part, row_number() OVER (PARTITION BY lang, part ORDER BY sha256('42:' || doc_id), doc_id) AS rank FROM d)"""


def _apportioned(spark: SparkSession, d: str, total: int | dict[str, int]) -> DataFrame:
    rows = table(spark, d, "documents").filter("lang <> 'es' OR doc_id % 3 = 0").select("doc_id", "lang", F.concat(F.lit("g"), (F.col("doc_id") % 7).cast("string")).alias("part"))
    return Se.apportioned(rows, ("lang", "part"), total, shuffle_key(42, "doc_id"), "doc_id")


# As much as there is, less 40, so that every part that has room gives and takes.
@query(_DEALT.replace("@total", "(SELECT greatest(0, count(*) - 40) FROM d)") + " SELECT doc_id, lang, part FROM r JOIN g USING (lang, part) WHERE rank <= quota")
def two_level_sample(spark: SparkSession, d: str) -> DataFrame:
    """Languages of given numbers, one of which runs out, and parts of each by largest remainder."""
    n = max(0, table(spark, d, "documents").filter("lang <> 'es' OR doc_id % 3 = 0").count() - 40)
    return _apportioned(spark, d, _PARTS | {"fr": n - _PARTS["en"] - _PARTS["de"]})


@query("WITH n AS (SELECT count(*) FILTER (lang = 'de') AS de, count(*) FILTER (lang = 'fr') AS fr FROM documents) SELECT unnest(['de', 'fr', 'made', 'replay']) AS category, unnest([least(de, 1000000), least(fr, 40), 30 + 1000000 - least(de, 1000000) + 40 - least(fr, 40), 20])::BIGINT AS quota FROM n")
def effective_quotas(spark: SparkSession, d: str) -> DataFrame:
    """Two external categories with as many rows as the table has; what they lack is made."""
    have = {r[0]: r[1] for r in table(spark, d, "documents").filter("lang IN ('de', 'fr')").groupBy("lang").count().collect()}
    q = Se.effective_quotas({"de": 1_000_000, "fr": 40, "made": 30, "replay": 20}, have, ("de", "fr"), "made")
    return spark.createDataFrame(list(q.items()), "category string, quota long")


@query(r"""WITH t AS (SELECT doc_id, 'Describe document ' || doc_id || ' of source ' || coalesce(source, '') || '.' AS q, text AS r, lang AS a FROM documents), n AS (SELECT *, greatest(1, floor(length(q) / 3.5)) AS nq, greatest(1, floor(length(r) / 3.5)) AS nr FROM t)
    SELECT reason, count(*) AS n FROM (SELECT CASE WHEN len(list_distinct(string_split(trim(q, E' \t\n\r'), ''))) < 8 OR len(list_distinct(string_split(trim(r, E' \t\n\r'), ''))) < 8 THEN 'dirty_text' WHEN regexp_matches(r, '<[a-zA-Z/][^>]*>') THEN 'html_in_reasoning' WHEN nr < 40 OR nr > 300 THEN 'reasoning_tokens_out_of_range' WHEN nq + nr + 1 > 310 THEN 'total_too_long' ELSE 'pass' END AS reason FROM n) GROUP BY 1""")
def external_filter(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents")
    question = F.concat(F.lit("Describe document "), "doc_id", F.lit(" of source "), F.coalesce("source", F.lit("")), F.lit("."))
    why = external_reject_reason(question, F.col("text"), F.col("lang"), most_total=310)
    return t.groupBy(F.coalesce(why, F.lit("pass")).alias("reason")).agg(F.count("*").alias("n"))


# --- solvers and mixtures -------------------------------------------------------------------------


def _parsed(spark: SparkSession, d: str) -> DataFrame:
    return K.parse(V.problems(spark, d)).filter("error is null").drop("error").withColumn("gold", F.col("answer"))


def _solved(spark: SparkSession, d: str) -> DataFrame:
    return settle(R.reason(_parsed(spark, d)))  # traces, emission and reports all read it


def _task(name: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        return R.reason(_parsed(spark, d).filter(F.col("task_type") == name)).select("pid", "solved", "ok", "error")

    return run


# In these views every problem follows its rule, so the solver's answer is the gold answer.
for _t, _name in (("numeral", "reason_numeral"), ("unit_conversion", "reason_unit"), ("gravity", "reason_gravity"), ("cipher", "reason_cipher"), ("symbolic_transform", "reason_symbolic")):
    QUERIES[_name] = _task(_t)
    ORACLES[_name] = f"WITH {V.PROBLEMS} SELECT pid, answer AS solved, true AS ok, NULL::VARCHAR AS error FROM problems WHERE task_type = '{_t}'"
# Eight examples do not always tell one bit rule from another, so some answers differ from the gold ones; tests hold the
# bit solver against planted rules.
QUERIES["reason_bit"] = _task("bit_manipulation")


@query()
def reasoner_rates(spark: SparkSession, d: str) -> DataFrame:
    return R.rates(_solved(spark, d))


def _traced(version: int):
    def run(spark: SparkSession, d: str) -> DataFrame:
        return _solved(spark, d).select("pid", "task_type", R.trace(version).alias("trace"))

    return run


for _v in (1, 2, 3):
    QUERIES[f"trace_v{_v}"] = _traced(_v)

# The traces of the five tasks whose steps SQL can name. Letters stand opposite each other in question and answer; symbols are cut from the answer.
_STEPS = f"""WITH {V.PROBLEMS}, x AS (SELECT pid, task_type, question AS q, answer AS a, CASE task_type WHEN 'gravity' THEN regexp_extract_all(prompt, 't = ([0-9.]+)s, distance = ([0-9.]+) m', 1) ELSE regexp_extract_all(prompt, '([0-9.]+) m becomes ([0-9.]+)', 1) END AS xs,
    CASE task_type WHEN 'gravity' THEN regexp_extract_all(prompt, 't = ([0-9.]+)s, distance = ([0-9.]+) m', 2) ELSE regexp_extract_all(prompt, '([0-9.]+) m becomes ([0-9.]+)', 2) END AS ys FROM problems WHERE task_type <> 'bit_manipulation'),
v AS (SELECT *, [CASE task_type WHEN 'gravity' THEN 2 * ys[i]::DOUBLE / (xs[i]::DOUBLE * xs[i]::DOUBLE) ELSE ys[i]::DOUBLE / xs[i]::DOUBLE END for i in range(1, len(xs) + 1)] AS vs FROM x),
c AS (SELECT *, median_of AS c, CASE task_type WHEN 'gravity' THEN 0.5 * median_of * q::DOUBLE * q::DOUBLE WHEN 'unit_conversion' THEN q::DOUBLE * median_of END AS predicted FROM (SELECT *, CASE WHEN len(vs) > 0 THEN (list_sort(vs)[(len(vs) + 1) // 2] + list_sort(vs)[len(vs) // 2 + 1]) / 2 END AS median_of FROM v)),
n AS (SELECT *, printf('%.6g', c) AS coefficient, printf('%.2f', predicted) AS said, array_to_string([printf('%.4g', z) for z in list_sort(vs)], ', ') AS listed,
    [substr(q, i, 1) || '→' || substr(a, i, 1) for i in range(1, length(q) + 1) IF task_type = 'cipher' AND substr(q, i, 1) <> ' ' AND strpos(q, substr(q, i, 1)) = i] AS letters,
    CASE WHEN task_type = 'numeral' THEN regexp_extract_all(a, 'CM|CD|XC|XL|IX|IV|[MDCLXVI]') ELSE [] END AS symbols FROM c),
r AS (SELECT *, [CASE s WHEN 'M' THEN 1000 WHEN 'CM' THEN 900 WHEN 'D' THEN 500 WHEN 'CD' THEN 400 WHEN 'C' THEN 100 WHEN 'XC' THEN 90 WHEN 'L' THEN 50 WHEN 'XL' THEN 40 WHEN 'X' THEN 10 WHEN 'IX' THEN 9 WHEN 'V' THEN 5 WHEN 'IV' THEN 4 ELSE 1 END for s in symbols] AS taken FROM n),
k AS (SELECT *, [list_sum(taken[i:])::BIGINT for i in range(1, len(taken) + 1)] AS upto, array_to_string(letters[1:10], ', ') AS first_ten, len(letters) > 10 AS many FROM r),
t AS (SELECT *, ['Converting ' || q] || [upto[i] || ' >= ' || taken[i] || ' -> ' || symbols[i] || ', rem ' || (upto[i] - taken[i]) for i in range(1, len(taken) + 1)] AS lines FROM k)"""
_ENDS = "chr(10) || 'Query: ' || q || chr(10) || 'Result: ' || a"
_RULE = "'reversed operands, reversed result, reverse concatenation'"
_HALF = "chr(10) || 'For t=' || q || ': 0.5 * ' || coefficient || ' * ' || q || '^2 = ' || said || '.'"
_FOR = "chr(10) || 'For ' || q || ': ' || q || ' * ' || coefficient || ' = ' || said || '.'"
_GIVES = "'.' || chr(10) || 'Applied to ' || q || ' it gives ' || a || '.'"
_QUOTED = "chr(10) || chr(39) || q || chr(39) || ' reads ' || chr(39) || a || chr(39) || '.'"
_TRACES = {
    1: {
        "gravity": "'Gravity. From g = 2*d/t^2 the examples give g near ' || coefficient || '. Then d = 0.5*g*t^2.'", "unit_conversion": "'Units. The ratios output/input are near ' || coefficient || '. Multiply the query by it.'",
        "numeral": f"'Numerals. Roman symbols are taken largest first.' || {_ENDS}", "cipher": f"'Cipher. The examples say what each letter stands for.' || {_ENDS}", "symbolic_transform": f"'Symbols. Rule: ' || {_RULE} || '.' || {_ENDS}",
    },
    2: {
        "gravity": f"'Gravity. t=' || xs[1] || ', d=' || ys[1] || ' give g near ' || coefficient || '.' || {_HALF}", "unit_conversion": f"'Units. ' || ys[1] || '/' || xs[1] || ' and the others give the median ' || coefficient || '.' || {_FOR}",
        "numeral": "'Numerals. ' || array_to_string([upto[i] || ' gives ' || symbols[i] for i in range(1, least(len(taken), 6) + 1)], ', ') || CASE WHEN len(taken) > 6 THEN ', ...' ELSE '' END || '.' || chr(10) || q || ' gives ' || a || '.'",
        "cipher": f"'Cipher. Letters: ' || first_ten || CASE WHEN many THEN ', ...' ELSE '' END || '.' || {_QUOTED}", "symbolic_transform": f"'Symbols. Rule: ' || {_RULE} || '.' || chr(10) || q || ' gives ' || a || '.'",
    },
    3: {
        "gravity": f"'Gravity. The values of g are ' || listed || '; the median is ' || coefficient || '.' || {_HALF}", "unit_conversion": f"'Units. The coefficients are ' || listed || '; the median is ' || coefficient || '.' || {_FOR}",
        "numeral": f"'Numerals. Rule: ' || array_to_string(lines[1:6], ' | ') || CASE WHEN len(lines) > 6 THEN ' | ...' ELSE '' END || {_GIVES}",
        "cipher": f"'Cipher. Rule: ' || first_ten || CASE WHEN many THEN ' (remaining consistent)' ELSE '' END || {_GIVES}", "symbolic_transform": f"'Symbols. Rule: ' || {_RULE} || {_GIVES}",
    },
}


def _trace_texts(version: int):
    def run(spark: SparkSession, d: str) -> DataFrame:
        rows = R.reason(_parsed(spark, d).filter("task_type <> 'bit_manipulation'"), version)
        return rows.select("pid", "task_type", R.trace(version).alias("trace"))

    return run


for _v, _of in _TRACES.items():
    QUERIES[f"trace_texts_v{_v}"] = _trace_texts(_v)
    ORACLES[f"trace_texts_v{_v}"] = f"{_STEPS} SELECT pid, task_type, CASE task_type {' '.join(f'WHEN {chr(39)}{t}{chr(39)} THEN {text}' for t, text in _of.items())} END AS trace FROM t"


@query(f"""{_STEPS}, s AS (SELECT pid, 'take' AS step, upto[i]::VARCHAR AS input, symbols[i] AS output, i AS place FROM t, unnest(generate_series(1, len(taken))) u(i) WHERE task_type = 'numeral'
    UNION ALL SELECT pid, 'letter', substr(letters[i], 1, 1), substr(letters[i], 3, 1), i FROM t, unnest(generate_series(1, len(letters))) u(i) WHERE task_type = 'cipher'
    UNION ALL SELECT pid, 'word', string_split(q, ' ')[i], string_split(a, ' ')[i], len(letters) + i FROM t, unnest(generate_series(1, len(string_split(q, ' ')))) u(i) WHERE task_type = 'cipher'
    UNION ALL SELECT pid, 'operation', {_RULE}, a, 1 FROM t WHERE task_type = 'symbolic_transform')
    SELECT pid, (place - 1)::INT AS place, step, input, output FROM s""")
def solver_steps(spark: SparkSession, d: str) -> DataFrame:
    """What the solvers of words and symbols did, a row a step."""
    rows = R.reason(_parsed(spark, d).filter("task_type IN ('numeral', 'cipher', 'symbolic_transform')"))
    # Outer: else the filter that Catalyst infers would work the steps out once more.
    return rows.select("pid", F.posexplode_outer("steps").alias("place", "s")).select("pid", "place", "s.*").filter("step IS NOT NULL")


_BUDGET = "CASE task_type " + " ".join(f"WHEN '{t}' THEN {n}" for t, n in R.BUDGET.items()) + f" ELSE {R.BUDGET_ELSE} END"
_EMITTED = f"""{_STEPS}, w AS (SELECT pid, task_type, a, CASE task_type {' '.join(f"WHEN '{t}' THEN {text}" for t, text in _TRACES[3].items())} END AS trace FROM t),
    said_ AS (SELECT w.*, p.prompt || chr(10) || chr(10) || 'Return only the final answer. Do not explain.' AS plain_user, p.prompt || chr(10) || chr(10) || 'Think briefly in <think>...</think>, then output only the final answer.' AS user, '<think>' || chr(10) || trace || chr(10) || '</think>' || chr(10) || chr(10) || a AS assistant FROM w JOIN problems p USING (pid)),
    sent AS (SELECT pid, task_type, 'answer_only' AS sample_type, {TOKENS.format('(plain_user || a)')} AS tokens, 'kept' AS outcome, contains(a, '\\boxed') AS residue FROM said_
        UNION ALL SELECT pid, task_type, 'compressed_cot', {TOKENS.format('(user || assistant)')}, CASE WHEN {TOKENS.format('(user || assistant)')} > {_BUDGET} THEN 'over_budget' ELSE 'kept' END, contains(assistant, '\\boxed') FROM said_)"""


def _named(spark: SparkSession, d: str) -> DataFrame:
    """The solved problems of the five tasks that SQL can follow."""
    return settle(R.reason(_parsed(spark, d).filter("task_type <> 'bit_manipulation'")))


@query(_EMITTED + " SELECT task_type, sample_type, outcome, count(*) AS n FROM sent GROUP BY ALL")
def named_emission(spark: SparkSession, d: str) -> DataFrame:
    rows = R.emit(_named(spark, d), 3, budget=True)
    return rows.groupBy("task_type", "sample_type", F.coalesce("skip_reason", F.lit("kept")).alias("outcome")).agg(F.count("*").alias("n"))


@query(_EMITTED + ", done AS (SELECT * FROM sent WHERE outcome = 'kept') SELECT sample_type, count(*) AS n, round(count(*) / (SELECT count(*) FROM done), 6)::DOUBLE AS share, 1.0::DOUBLE AS parse_rate, round(avg(tokens), 6) AS mean_tokens, count(*) FILTER (residue) AS residue FROM done GROUP BY 1")
def named_mixture_report(spark: SparkSession, d: str) -> DataFrame:
    return R.mixture_report(R.emit(_named(spark, d), 3, budget=True))


@query(f"{_STEPS} SELECT task_type, count(*) AS n, count(*) AS n_ok, 0::BIGINT AS n_error, 1.0::DOUBLE AS ok_rate FROM t GROUP BY 1")
def named_rates(spark: SparkSession, d: str) -> DataFrame:
    return R.rates(_named(spark, d))


@query(f"""{_STEPS}, s AS (SELECT pid, 'coefficient' AS name, c AS value FROM t WHERE c IS NOT NULL UNION ALL SELECT pid, 'predicted', predicted FROM t WHERE c IS NOT NULL UNION ALL SELECT pid, 'value_' || i, vs[i] FROM t, unnest(generate_series(1, len(vs))) u(i) WHERE c IS NOT NULL
    UNION ALL SELECT pid, 'number', q::DOUBLE FROM t WHERE task_type = 'numeral' UNION ALL SELECT pid, 'symbols', len(symbols)::DOUBLE FROM t WHERE task_type = 'numeral') SELECT pid, name, round(value, 6) AS value FROM s""")
def intermediates(spark: SparkSession, d: str) -> DataFrame:
    """Values by name that stand behind an answer."""
    rows = _named(spark, d).select("pid", F.explode("intermediates").alias("name", "value"))
    return rows.withColumn("value", F.round("value", 6))


def _bit_rules_sql() -> str:
    of = {"Identity": "a", "NOT": "xor(a, ones)", "Constant": "CASE p WHEN 1 THEN ones ELSE 0 END", "AND": "a & b", "OR": "a | b", "XOR": "xor(a, b)", "AND-NOT": "a & xor(b, ones)", "OR-NOT": "a | xor(b, ones)", "XOR-NOT": "xor(a, xor(b, ones))"}
    rules = ", ".join(f"('{f}', {p}, {'NULL' if q is None else q})" for f, p, q in B.RULES)
    columns = "[list_sum([substr({0}[e], i, 1)::BIGINT << (e - 1) for e in range(1, len({0}) + 1)])::BIGINT for i in range(1, 9)]"
    return f"""WITH {V.PROBLEMS}, x AS (SELECT pid, regexp_extract_all(prompt, '([01]{{8}}) -> ([01]{{8}})', 1) AS xs, regexp_extract_all(prompt, '([01]{{8}}) -> ([01]{{8}})', 2) AS ys FROM problems WHERE task_type = 'bit_manipulation'),
    c AS (SELECT pid, {columns.format('xs')} AS given, {columns.format('ys')} AS wanted, (1::BIGINT << len(xs)) - 1 AS ones FROM x),
    r AS (SELECT * FROM (VALUES {rules}) v(family, p, q)),
    j AS (SELECT pid, family, p, q, wanted, ones, CASE WHEN family = 'Constant' THEN 0 ELSE given[p + 1] END AS a, CASE WHEN q IS NULL THEN 0 ELSE given[q + 1] END AS b FROM c CROSS JOIN r),
    m AS (SELECT *, CASE family {' '.join(f"WHEN '{f}' THEN {e}" for f, e in of.items())} END AS made FROM j)
    SELECT pid, (i - 1)::INT AS bit, family, p::INT AS p, coalesce(q, -1)::INT AS q FROM m, unnest(generate_series(1, 8)) u(i) WHERE made = wanted[i]"""


@query(_bit_rules_sql())
def bit_rules(spark: SparkSession, d: str) -> DataFrame:
    """Which rule gives which output bit in all examples; -1 is no second operand."""
    return R.bit_fits(_parsed(spark, d).filter("task_type = 'bit_manipulation'")).withColumn("q", F.coalesce("q", F.lit(-1)))


@query()
def trace_quality(spark: SparkSession, d: str) -> DataFrame:
    return R.trace_quality(_solved(spark, d), 3)


@query()
def cot_emission(spark: SparkSession, d: str) -> DataFrame:
    rows = R.emit(_solved(spark, d), 3, budget=True)
    return rows.groupBy("task_type", "sample_type", F.coalesce("skip_reason", F.lit("kept")).alias("outcome")).agg(F.count("*").alias("n"))


@query()
def mixture_report(spark: SparkSession, d: str) -> DataFrame:
    return R.mixture_report(R.emit(_solved(spark, d), 3, budget=True))


# --- gates ----------------------------------------------------------------------------------------


@query("SELECT arg_min(value, event_id) AS first_loss, arg_max(value, event_id) AS last_loss, coalesce(arg_max(value, event_id) < 0.8 * arg_min(value, event_id), false) AS passed FROM events WHERE event_type = 'purchase'")
def overfit_gate(spark: SparkSession, d: str) -> DataFrame:
    return Gt.overfit_gate(table(spark, d, "events").filter("event_type = 'purchase'"), "event_id", "value")


@query(f"WITH {V.PREDICTIONS} SELECT count(*) AS n, count(*) FILTER (stop_reason IN ('im_end', 'endoftext') AND generated_tokens < 256) AS n_ok, count(*) = count(*) FILTER (stop_reason IN ('im_end', 'endoftext') AND generated_tokens < 256) AS passed FROM predictions")
def stop_gate(spark: SparkSession, d: str) -> DataFrame:
    return Gt.stop_gate(V.predictions(spark, d), 256)


@query("SELECT lang, count(*) AS n, min(doc_id) AS first, max(doc_id) AS last, sum(('0x' || substr(sha256(doc_id::VARCHAR), 1, 8))::BIGINT)::BIGINT AS digest, 42::BIGINT AS seed FROM documents GROUP BY 1")
def split_manifest(spark: SparkSession, d: str) -> DataFrame:
    return Gt.manifest(table(spark, d, "documents"), "lang", "doc_id", 42)


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def windowed_events(spark: SparkSession, d: str) -> DataFrame:
    """The streaming operator over the table as a batch; tests run it as a stream."""
    return windowed_counts(table(spark, d, "events"), "ts", "event_type")
