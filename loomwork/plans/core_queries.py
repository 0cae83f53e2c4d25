"""Queries over the driver's tables: text, validation, dedup, splits and profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.functions import text as T
from loomwork.operators import chat as C
from loomwork.operators import dedup as D
from loomwork.operators import profile as P
from loomwork.operators import split as S
from loomwork.operators import validation as V
from loomwork.plans.registry import query, table

# SQL for what several oracles share. The driver's texts hold no white space beyond ASCII.
NORM = "trim(regexp_replace({0}, '\\s+', ' ', 'g'))"
HASH = "sha256(trim(regexp_replace({0}, '\\s+', ' ', 'g')))"
TOKENS = "CASE WHEN length({0}) = 0 THEN 0 ELSE greatest(1, floor(length({0}) / 3.5)) END::BIGINT"
CHAT = """chat AS (
    SELECT conv_id, list(role ORDER BY turn) AS roles, list(text ORDER BY turn) AS texts, count(*) AS n FROM conversations GROUP BY conv_id),
checked AS (
    SELECT conv_id, turn, role, text, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i FROM conversations),
turn_errors AS (
    SELECT conv_id, i, CASE
        WHEN role IS NULL OR role NOT IN ('system', 'user', 'assistant') THEN 'unsupported_role'
        WHEN text IS NULL THEN 'content_not_text'
        WHEN text = '' AND NOT (i = 0 AND role = 'system') THEN 'empty_content'
        WHEN role = 'system' AND i <> 0 THEN 'system_not_first'
        WHEN (i = 0 OR (i = 1 AND before = 'system')) AND role NOT IN ('user', 'system') THEN 'invalid_role_order'
        WHEN role = 'user' AND before = 'user' THEN 'consecutive_user' END AS error FROM checked),
first_errors AS (SELECT conv_id, arg_min(error, i) AS error FROM turn_errors WHERE error IS NOT NULL GROUP BY conv_id),
conv AS (
    SELECT chat.conv_id, roles, texts, n, coalesce(f.error,
        CASE WHEN NOT list_contains(roles, 'user') OR NOT list_contains(roles, 'assistant') THEN 'missing_user_or_assistant'
             WHEN roles[-1] <> 'assistant' THEN 'not_ending_with_assistant' END) AS error,
        texts[list_position(roles, 'user')] AS first_user,
        CASE WHEN n <= 3 THEN 'short' WHEN n <= 6 THEN 'medium' ELSE 'long' END AS category,
        (SELECT arg_max(c.text, c.turn) FROM conversations c WHERE c.conv_id = chat.conv_id AND c.role = 'assistant') AS last_assistant
    FROM chat LEFT JOIN first_errors f USING (conv_id))"""
DOCS = "docs AS (SELECT *, " + HASH.format("text") + " AS hash, doc_id AS _ord FROM documents)"


def chat(spark: SparkSession, d: str) -> DataFrame:
    return C.with_category(C.assemble(table(spark, d, "conversations")))


def docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").withColumn("_ord", F.col("doc_id"))


def hashed(spark: SparkSession, d: str) -> DataFrame:
    return D.with_hash(docs(spark, d), "text")


# --- text -----------------------------------------------------------------------------------------


@query(f"SELECT doc_id, {HASH.format('text')} AS hash FROM documents")
def norm_hash(spark: SparkSession, d: str) -> DataFrame:
    return hashed(spark, d).select("doc_id", "hash")


@query(r"SELECT doc_id, len(regexp_extract_all(text, '[\p{L}\p{N}_]+'))::BIGINT AS words, len(regexp_extract_all(text, '\S+'))::BIGINT AS fields FROM documents")
def word_count(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("doc_id", T.count_words("text").alias("words"), T.count_fields("text").alias("fields"))


@query(f"SELECT doc_id, {TOKENS.format('text')} AS tokens FROM documents")
def token_estimate(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("doc_id", T.token_estimate("text").alias("tokens"))


@query(r"""SELECT doc_id, len(list_distinct(string_split(trim(text, E' \t\n\r'), ''))) > 8 AS clean_above_8, len(list_distinct(string_split(trim(text, E' \t\n\r'), ''))) >= 8 AS clean_from_8,
    len(list_distinct(string_split(trim(text, E' \t\n\r'), '')))::BIGINT AS distinct_chars FROM documents""")
def clean_text_flags(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("doc_id", T.looks_clean("text", 9).alias("clean_above_8"), T.looks_clean("text", 8).alias("clean_from_8"), T.distinct_chars("text").alias("distinct_chars"))


@query(r"""WITH l AS (SELECT doc_id, CASE WHEN text[-1] = chr(10) THEN string_split(text, chr(10))[:-2] ELSE string_split(text, chr(10)) END AS l FROM documents)
    SELECT doc_id, len(l)::BIGINT AS n_lines, len([x for x in l if regexp_matches(x, '\S')])::BIGINT AS n_filled, (len(l) - len(list_distinct(l)))::BIGINT AS n_repeated FROM l""")
def line_stats(spark: SparkSession, d: str) -> DataFrame:
    lines = T.lines("text")
    return docs(spark, d).select("doc_id", F.size(lines).cast("long").alias("n_lines"), F.size(F.filter(lines, lambda x: F.char_length(T.strip(x)) > 0)).cast("long").alias("n_filled"), (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_repeated"))


# --- validation -----------------------------------------------------------------------------------


@query(r"""WITH r AS (SELECT lpad(lower(to_hex(doc_id % 900)), 8, '0') AS id, text AS prompt, CASE doc_id % 5 WHEN 0 THEN '' WHEN 1 THEN ' a' WHEN 2 THEN 'a' || chr(10) || 'b' ELSE 'ok' END AS answer, doc_id AS _ord FROM documents),
    f AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY _ord) AS a, row_number() OVER (PARTITION BY prompt ORDER BY _ord) AS b FROM r),
    i AS (SELECT unnest([CASE WHEN NOT regexp_full_match(id, '[0-9a-f]{8}') THEN 'invalid_id' END, CASE WHEN a > 1 THEN 'duplicate_id' END, CASE WHEN NOT regexp_matches(prompt, '\S') THEN 'empty_prompt' END,
        CASE WHEN NOT regexp_matches(answer, '\S') THEN 'empty_answer' END, CASE WHEN b > 1 THEN 'duplicate_prompt' END, CASE WHEN regexp_matches(prompt, '^\s|\s$') THEN 'prompt_outer_whitespace' END,
        CASE WHEN regexp_matches(answer, '^\s|\s$') THEN 'answer_outer_whitespace' END, CASE WHEN contains(answer, chr(10)) THEN 'multiline_answer' END]) AS issue FROM f)
    SELECT issue, count(*) AS n FROM i WHERE issue IS NOT NULL GROUP BY 1""")
def basic_validation_issues(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id") % 5
    rows = docs(spark, d).select(F.lower(F.lpad(F.hex(F.col("doc_id") % 900), 8, "0")).alias("id"), F.col("text").alias("prompt"), F.when(k == 0, "").when(k == 1, " a").when(k == 2, "a\nb").otherwise("ok").alias("answer"), "_ord")
    return V.issue_counts(V.basic_issues(rows))


@query(f"WITH {CHAT} SELECT conv_id, coalesce(error, 'ok') AS error FROM conv")
def conv_errors(spark: SparkSession, d: str) -> DataFrame:
    return C.validate(chat(spark, d)).select("conv_id", F.coalesce("error", F.lit("ok")).alias("error"))


@query(f"WITH {CHAT} SELECT coalesce(error, 'ok') AS error, count(*) AS n FROM conv GROUP BY 1")
def conv_error_counts(spark: SparkSession, d: str) -> DataFrame:
    return C.validate(chat(spark, d)).groupBy(F.coalesce("error", F.lit("ok")).alias("error")).agg(F.count("*").alias("n"))


@query(f"""WITH {CHAT}, p AS (SELECT conv_id, bool_or(role = 'assistant' AND before = 'assistant') AS c FROM checked GROUP BY 1)
    SELECT count(*) AS conversations, min(n)::BIGINT AS min_messages, max(n)::BIGINT AS max_messages, sum(n)::BIGINT AS total_messages, count(*) FILTER (c) AS consecutive_assistant,
        count(*) FILTER (roles[1] = 'system' AND texts[1] = '') AS empty_leading_system, count(*) FILTER (roles[1] = 'system') AS with_system FROM conv JOIN p USING (conv_id)""")
def conv_shape_stats(spark: SparkSession, d: str) -> DataFrame:
    return C.shape(chat(spark, d))


@query("SELECT conv_id, turn FROM (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM (SELECT conv_id, turn, CASE WHEN turn % 4 = 2 THEN 'assistant' ELSE role END AS role FROM conversations)) WHERE role = 'assistant' AND b = 'assistant'")
def consecutive_assistant(spark: SparkSession, d: str) -> DataFrame:
    turns = table(spark, d, "conversations").select("conv_id", "turn", F.when(F.col("turn") % 4 == 2, "assistant").otherwise(F.col("role")).alias("role"))
    return D.consecutive(turns, "assistant").select("conv_id", "turn")


@query(f"WITH {CHAT} SELECT conv_id, first_user, last_assistant FROM conv")
def first_user_last_assistant(spark: SparkSession, d: str) -> DataFrame:
    return chat(spark, d).select("conv_id", C.first_user().alias("first_user"), C.last_assistant().alias("last_assistant"))


_REJECT = r"""CASE WHEN first_user IS NULL OR last_assistant IS NULL THEN 'missing_role' WHEN length(first_user) >= 2500 THEN 'user_too_long'
    WHEN len(regexp_extract_all(last_assistant, '[\p{L}\p{N}_]+')) NOT BETWEEN 10 AND 250 THEN 'words_out_of_range'
    WHEN regexp_matches(lower(last_assistant), '^\s*(i''m sorry|i’m sorry|i cannot)') THEN 'refusal'
    WHEN len(list_distinct(string_split(trim(first_user, E' \t\n\r'), ''))) < 8 OR len(list_distinct(string_split(trim(last_assistant, E' \t\n\r'), ''))) < 8 THEN 'dirty_text' END"""


@query(f"WITH {CHAT} SELECT conv_id, {_REJECT} IS NULL AS eligible FROM conv")
def replay_eligible(spark: SparkSession, d: str) -> DataFrame:
    why = V.replay_reject_reason(C.first_user(), C.last_assistant(), least_words=10)
    return chat(spark, d).select("conv_id", why.isNull().alias("eligible"))


@query(f"WITH {CHAT} SELECT coalesce({_REJECT}, 'pass') AS reason, count(*) AS n FROM conv GROUP BY 1")
def reject_reason_counts(spark: SparkSession, d: str) -> DataFrame:
    why = V.replay_reject_reason(C.first_user(), C.last_assistant(), least_words=10)
    return chat(spark, d).groupBy(F.coalesce(why, F.lit("pass")).alias("reason")).agg(F.count("*").alias("n"))


# --- dedup and leakage ----------------------------------------------------------------------------


@query(f"WITH {DOCS} SELECT doc_id, hash FROM docs QUALIFY row_number() OVER (PARTITION BY hash ORDER BY _ord) = 1")
def dedup_first(spark: SparkSession, d: str) -> DataFrame:
    return D.first_of(hashed(spark, d).select("doc_id", "hash", "_ord"), "hash").select("doc_id", "hash")


@query(f"WITH {DOCS} SELECT doc_id, lang, hash FROM docs QUALIFY row_number() OVER (PARTITION BY lang, hash ORDER BY _ord) = 1")
def dedup_in_split(spark: SparkSession, d: str) -> DataFrame:
    return D.first_of(hashed(spark, d).select("doc_id", "lang", "hash", "_ord"), "lang", "hash").select("doc_id", "lang", "hash")


@query(f"WITH {DOCS} SELECT hash, count(DISTINCT source) AS n_splits, count(*) AS n_rows FROM docs GROUP BY 1 HAVING count(DISTINCT source) > 1")
def cross_split_collisions(spark: SparkSession, d: str) -> DataFrame:
    return D.cross_split_collisions(hashed(spark, d).select("hash", F.col("source").alias("split")))


@query(f"WITH {DOCS}, l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM documents), b AS (SELECT DISTINCT unnest(string_split(text, chr(10))) AS l FROM benchmark) SELECT DISTINCT doc_id FROM l WHERE {HASH.format('l')} IN (SELECT {HASH.format('l')} FROM b)")
def benchmark_leak(spark: SparkSession, d: str) -> DataFrame:
    """Documents with a line that a benchmark item also has, by normalised hash."""
    have = table(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line")).select("doc_id", T.prompt_hash("line").alias("hash"))
    wanted = table(spark, d, "benchmark").select(F.explode(F.split("text", "\n")).alias("line")).select(T.prompt_hash("line").alias("hash"))
    return D.leaked(have, wanted, "hash").select("doc_id").distinct()


@query("SELECT doc_id FROM documents WHERE lang = 'en' INTERSECT SELECT doc_id FROM labels")
def id_overlap(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).filter("lang = 'en'").select("doc_id").intersect(table(spark, d, "labels").select("doc_id"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def missing_ids(spark: SparkSession, d: str) -> DataFrame:
    return D.missing(docs(spark, d).select("doc_id"), table(spark, d, "labels"), "doc_id")


@query("SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)")
def excluded_antijoin(spark: SparkSession, d: str) -> DataFrame:
    return D.missing(docs(spark, d).select("doc_id", "lang"), table(spark, d, "labels").filter("quality = 0"), "doc_id")


@query("SELECT lang, min(doc_id) AS first_id FROM documents GROUP BY 1")
def distinct_in_order(spark: SparkSession, d: str) -> DataFrame:
    return D.distinct_in_order(docs(spark, d), "lang").select("lang", F.col("_ord").alias("first_id"))


@query("SELECT 'documents' AS origin, doc_id AS id, lang AS tag FROM documents UNION ALL SELECT 'benchmark', item_id, NULL FROM benchmark")
def union_sources(spark: SparkSession, d: str) -> DataFrame:
    a = docs(spark, d).select(F.lit("documents").alias("origin"), F.col("doc_id").alias("id"), F.col("lang").alias("tag"))
    return D.union_all(a, table(spark, d, "benchmark").select(F.lit("benchmark").alias("origin"), F.col("item_id").alias("id")))


# --- splits ---------------------------------------------------------------------------------------

_RANKED = "ranked AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY sha256('42:' || doc_id), doc_id) AS rank, count(*) OVER (PARTITION BY lang) AS n FROM documents)"


def _apportion(name: str, ratio: float, seed: int) -> str:
    return f"""{name} AS (SELECT lang, f + CASE WHEN row_number() OVER (ORDER BY f - share, sha256('{seed}:' || lang)) <= left_over THEN 1 ELSE 0 END AS q
        FROM (SELECT lang, n * {ratio}::DOUBLE AS share, floor(n * {ratio}::DOUBLE)::BIGINT AS f, (round_even((sum(n) OVER ()) * {ratio}::DOUBLE, 0) - sum(floor(n * {ratio}::DOUBLE)) OVER ())::BIGINT AS left_over FROM strata))"""


_QUOTAS = "strata AS (SELECT lang, count(*) AS n FROM documents GROUP BY 1), " + _apportion("tr", 0.8, 42) + ", " + _apportion("va", 0.1, 43)
_SPLIT = f"WITH {_RANKED}, {_QUOTAS}, s AS (SELECT doc_id, r.lang, rank, CASE WHEN rank <= tr.q THEN 'train' WHEN rank <= tr.q + va.q THEN 'validation' ELSE 'test' END AS split FROM ranked r JOIN tr USING (lang) JOIN va USING (lang))"


@query(f"WITH {_QUOTAS} SELECT strata.lang, tr.q AS train, va.q AS validation, n - tr.q - va.q AS test FROM strata JOIN tr USING (lang) JOIN va USING (lang)")
def split_quotas(spark: SparkSession, d: str) -> DataFrame:
    counts = {r[0]: r[1] for r in docs(spark, d).groupBy("lang").count().collect()}
    rows = [(k, *q) for k, q in S.split_quotas(counts).items()]
    return spark.createDataFrame(rows, "lang string, train long, validation long, test long")


@query(f"{_SPLIT} SELECT doc_id, lang, rank, split FROM s")
def stratified_split(spark: SparkSession, d: str) -> DataFrame:
    return S.stratified_split(docs(spark, d).select("doc_id", "lang"), "lang", "doc_id").select("doc_id", "lang", "rank", "split")


@query(f"{_SPLIT} SELECT split, lang, count(*) AS n FROM s GROUP BY ALL")
def split_counts(spark: SparkSession, d: str) -> DataFrame:
    return S.stratified_split(docs(spark, d).select("doc_id", "lang"), "lang", "doc_id").groupBy("split", "lang").agg(F.count("*").alias("n"))


_ALL_RANKED = "r AS (SELECT doc_id, row_number() OVER (ORDER BY sha256('42:' || doc_id), doc_id) AS rank, count(*) OVER () AS n FROM documents)"


@query(f"WITH {_ALL_RANKED} SELECT doc_id, CASE WHEN rank <= round_even(n * 0.1::DOUBLE, 0) THEN 'dev' ELSE 'train' END AS split FROM r")
def train_dev(spark: SparkSession, d: str) -> DataFrame:
    return S.train_dev(docs(spark, d).select("doc_id"), "doc_id").select("doc_id", "split")


@query(f"WITH {_ALL_RANKED} SELECT doc_id, CASE WHEN rank <= round_even(n * 10 / 12, 0) THEN 0 WHEN rank <= round_even(n * 10 / 12, 0) + round_even(n / 12, 0) THEN 1 ELSE 2 END::INT AS part FROM r")
def ratio_10_1_1(spark: SparkSession, d: str) -> DataFrame:
    return S.partition_by_ratio(docs(spark, d).select("doc_id"), "doc_id").select("doc_id", "part")


@query(f"WITH {_ALL_RANKED} SELECT doc_id, CASE WHEN rank <= n // 2 THEN 'first' ELSE 'second' END AS half FROM r")
def half_split(spark: SparkSession, d: str) -> DataFrame:
    df = docs(spark, d).select("doc_id").withColumn("k", S.shuffle_key(42, "doc_id"))
    n = df.count()
    return C.with_rank(df, "k", "doc_id").select("doc_id", F.when(F.col("rank") <= n // 2, "first").otherwise("second").alias("half"))


@query(f"WITH {_RANKED} SELECT doc_id, lang, rank FROM ranked WHERE rank <= 5")
def replay_limit(spark: SparkSession, d: str) -> DataFrame:
    ranked = S.take_per_group(docs(spark, d).select("doc_id", "lang"), "lang", 5, S.shuffle_key(42, "doc_id"), "doc_id")
    return ranked.select("doc_id", "lang", F.col("rank").cast("long").alias("rank"))


@query(f"WITH {_RANKED}, strata AS (SELECT lang, least(count(*), 60) AS n FROM documents GROUP BY 1), {_apportion('q', 0.5, 42)} SELECT doc_id, r.lang, rank FROM ranked r JOIN q USING (lang) WHERE rank <= q.q")
def smoke_sample(spark: SparkSession, d: str) -> DataFrame:
    """Half of at most 60 rows a language, by largest remainder, in hash order."""
    df = docs(spark, d).select("doc_id", "lang")
    counts = {r[0]: min(60, r[1]) for r in df.groupBy("lang").count().collect()}
    return S.sample_by_quota(df, "lang", "doc_id", S.largest_remainder(counts, 0.5, 42)).select("doc_id", "lang", "rank")


_KIND = "k AS (SELECT doc_id, CASE WHEN doc_id % 10 < 5 THEN 'answer_only' WHEN doc_id % 10 < 9 THEN 'cot' ELSE 'replay' END AS kind FROM documents), c AS (SELECT count(*) FILTER (kind = 'cot') AS cot, count(*) FILTER (kind = 'replay') AS rep, count(*) FILTER (kind = 'answer_only') AS ao FROM k), a AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY sha256('42:' || doc_id), doc_id) AS rank FROM k)"


def _kinds(spark: SparkSession, d: str) -> tuple[DataFrame, dict[str, int]]:
    m = F.col("doc_id") % 10
    df = docs(spark, d).select("doc_id", F.when(m < 5, "answer_only").when(m < 9, "cot").otherwise("replay").alias("kind"))
    return df, {r[0]: r[1] for r in df.groupBy("kind").count().collect()}


@query(f"WITH {_KIND} SELECT doc_id, kind FROM a, c WHERE kind <> 'answer_only' OR rank <= greatest(0, least(ao, trunc(cot / 0.475::DOUBLE - cot - rep)))")
def rebalance_cot(spark: SparkSession, d: str) -> DataFrame:
    df, n = _kinds(spark, d)
    keep = S.answer_only_for_cot_share(n.get("cot", 0), n.get("replay", 0), 0.475, n.get("answer_only", 0))
    return S.rebalance(df, "kind", "doc_id", reduce="answer_only", keep=keep)


@query(f"WITH {_KIND} SELECT doc_id, kind FROM a, c WHERE kind <> 'answer_only' OR rank <= greatest(0, least(ao, trunc(0.32::DOUBLE / (1 - 0.32::DOUBLE) * (cot + rep))))")
def rebalance_ao(spark: SparkSession, d: str) -> DataFrame:
    df, n = _kinds(spark, d)
    keep = S.answer_only_for_own_share(n.get("cot", 0), n.get("replay", 0), 0.32, n.get("answer_only", 0))
    return S.rebalance(df, "kind", "doc_id", reduce="answer_only", keep=keep)


# --- profiles -------------------------------------------------------------------------------------


def _lengths(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("doc_id", "lang", "source", T.token_estimate("text").alias("tokens"))


_LEN = f"t AS (SELECT doc_id, lang, source, {TOKENS.format('text')} AS tokens FROM documents)"


@query(f"WITH {_LEN} SELECT lang, count(*) AS n, min(tokens)::DOUBLE AS min, round(avg(tokens), 6) AS mean, max(tokens)::DOUBLE AS max, quantile_disc(tokens, 0.5)::DOUBLE AS p50, quantile_disc(tokens, 0.9)::DOUBLE AS p90, quantile_disc(tokens, 0.99)::DOUBLE AS p99 FROM t GROUP BY 1")
def length_stats_nearest(spark: SparkSession, d: str) -> DataFrame:
    return P.length_stats(_lengths(spark, d), "tokens", "lang", kind="nearest", points=(0.5, 0.9, 0.99))


@query(f"WITH {_LEN} SELECT lang, count(*) AS n, min(tokens)::DOUBLE AS min, round(avg(tokens), 6) AS mean, max(tokens)::DOUBLE AS max, {', '.join(f'round(quantile_cont(tokens, {p}), 6)::DOUBLE AS p{round(p * 100)}' for p in (0.5, 0.9, 0.95, 0.99))} FROM t GROUP BY 1")
def length_stats_linear(spark: SparkSession, d: str) -> DataFrame:
    return P.length_stats(_lengths(spark, d), "tokens", "lang")


@query(f"WITH {_LEN}, s AS (SELECT lang, list(tokens ORDER BY tokens) AS l FROM t GROUP BY 1) SELECT lang, len(l) AS n, l[1]::DOUBLE AS min, round(list_avg(l), 6) AS mean, l[-1]::DOUBLE AS max, l[round_even((len(l) - 1) * 0.5::DOUBLE, 0)::INT + 1]::DOUBLE AS p50, l[round_even((len(l) - 1) * 0.9::DOUBLE, 0)::INT + 1]::DOUBLE AS p90, l[round_even((len(l) - 1) * 0.95::DOUBLE, 0)::INT + 1]::DOUBLE AS p95 FROM s")
def length_stats_index(spark: SparkSession, d: str) -> DataFrame:
    return P.length_stats(_lengths(spark, d), "tokens", "lang", kind="index", points=(0.5, 0.9, 0.95))


@query(f"WITH {_LEN} SELECT CASE WHEN grouping(lang) = 1 THEN '*' ELSE lang END AS lang, CASE WHEN grouping(source) = 1 THEN '*' ELSE source END AS source, count(*) AS n, min(tokens)::DOUBLE AS min, round(avg(tokens), 6) AS mean, max(tokens)::DOUBLE AS max, round(quantile_cont(tokens, 0.5), 6)::DOUBLE AS p50, round(quantile_cont(tokens, 0.95), 6)::DOUBLE AS p95 FROM t GROUP BY CUBE (lang, source)")
def length_cube(spark: SparkSession, d: str) -> DataFrame:
    return P.length_cube(_lengths(spark, d), "tokens", "lang", "source")


@query(f"WITH {_LEN}, h AS (SELECT unnest([512, 768, 1024, 1536, 2048, 4096]) AS h) SELECT CASE WHEN grouping(lang) = 1 THEN '*' ELSE lang END AS lang, CASE WHEN grouping(source) = 1 THEN '*' ELSE source END AS source, h::BIGINT AS threshold, count(*) AS n, count(*) FILTER (tokens > h) AS n_over, round(count(*) FILTER (tokens > h) / count(*), 8)::DOUBLE AS ratio FROM t, h GROUP BY GROUPING SETS ((h), (h, lang), (h, source), (h, lang, source))")
def overflow_cube(spark: SparkSession, d: str) -> DataFrame:
    return P.overflow_cube(_lengths(spark, d), "tokens", "lang", "source")


@query(f"WITH {_LEN} SELECT coalesce(min(h) FILTER (h >= m), 4096)::BIGINT AS max_length, any_value(o) AS long_tail, any_value(m)::BIGINT AS longest FROM (SELECT max(tokens) AS m, count(*) FILTER (tokens > 4096) AS o FROM t), (SELECT unnest([512, 768, 1024, 1536, 2048, 4096]) AS h)")
def recommend_max_length(spark: SparkSession, d: str) -> DataFrame:
    return P.recommend_max_length(_lengths(spark, d), "tokens")


@query(f"WITH {_LEN} SELECT doc_id, tokens FROM t ORDER BY tokens DESC, doc_id LIMIT 20")
def longest20(spark: SparkSession, d: str) -> DataFrame:
    return P.longest(_lengths(spark, d).select("doc_id", "tokens"), "tokens", "doc_id")


# --- flagship -------------------------------------------------------------------------------------

_FLAG = f"""WITH {CHAT}, good AS (SELECT conv_id, category, {HASH.format('first_user')} AS hash FROM conv WHERE error IS NULL QUALIFY row_number() OVER (PARTITION BY {HASH.format('first_user')} ORDER BY conv_id) = 1),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY sha256('42:' || conv_id), conv_id) AS rank FROM good),
    strata AS (SELECT category AS lang, count(*) AS n FROM good GROUP BY 1), {_apportion('tr', 0.8, 42)}, {_apportion('va', 0.1, 43)}
    SELECT CASE WHEN rank <= tr.q THEN 'train' WHEN rank <= tr.q + va.q THEN 'validation' ELSE 'test' END AS split, category, count(*) AS n FROM ranked JOIN tr ON tr.lang = category JOIN va ON va.lang = category GROUP BY ALL"""


@query(_FLAG)
def prepared_chat_splits(spark: SparkSession, d: str) -> DataFrame:
    """Turns to conversations, the role grammar, first-occurrence dedup by prompt, stratified split, counts."""
    good = C.validate(chat(spark, d)).filter("error is null").select("conv_id", "category", "_ord", T.prompt_hash(C.first_user()).alias("hash"))
    unique = D.first_of(good, "hash").select("conv_id", "category")
    return S.stratified_split(unique, "category", "conv_id").groupBy("split", "category").agg(F.count("*").alias("n"))
