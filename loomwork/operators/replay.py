"""Rows of earlier stages and of external sources: which of them fit, and the records they become."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.functions import thinking as Th
from loomwork.functions.text import contains_any, fullmatch, looks_clean, normalize_ws, prompt_hash, starts_with_any, strip, token_estimate
from loomwork.operators.chat import first_user, last_assistant, with_rank
from loomwork.operators.records import BAD_OPENINGS, END, LABELS

_TAGS = (Th.OPEN, Th.CLOSE)
# Sample types of replayed rows, the wrapping of external problems.
STRICT, THINKING = "stage1_5_replay", "stage2_replay"
WRAP = f"Solve the problem. Think briefly, then give the final answer after {Th.CLOSE}.\n\nProblem: "


def _no(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def strict_ok(category: Column, user: Column, assistant: Column, *, json_ok: Column | None = None) -> Column:
    """A strict row may be replayed: both texts there, no end mark, no outer white space, no explanation, and its category's form."""
    valid_json = F.lit(True) if json_ok is None else _no(json_ok)
    form = (
        F.when(category.isin("binary_only", "wonderland_like_binary"), fullmatch(assistant, "[01]{8}")).when(category == "json_only", valid_json)
        .when(category == "yes_no", assistant.isin("yes", "no")).when(category == "classification", assistant.isin(*LABELS)).otherwise(True)
    )
    plain = ~F.contains(assistant, F.lit(END)) & (assistant == strip(assistant)) & ~starts_with_any(F.lower(assistant), BAD_OPENINGS) & ~F.contains(assistant, F.lit("```"))
    return _no(category.isNotNull() & (category != "no_robots_replay") & (user != "") & (assistant != "") & plain & form)


def mixture_ok(user: Column, assistant: Column, sample_type: Column) -> Column:
    """A row may enter the final mixture: no blanks, no residue; strict rows without tags, thinking rows with tags only where they parse."""
    tagged = contains_any(assistant, _TAGS)
    fits = F.when(sample_type == STRICT, ~tagged).when((sample_type == THINKING) & tagged, Th.parse(assistant, strict=True)["ok"]).otherwise(True)
    return _no((strip(user) != "") & (strip(assistant) != "") & ~F.contains(assistant, F.lit(END)) & ~F.contains(assistant, F.lit("\\boxed")) & fits)


def long_thought_reason(question: Column, reasoning: Column, answer: Column, *, most_reasoning: int = 400, most_answer: int = 64, most_total: int = 512) -> Column:
    """Why a long chain of thought is left out, first reason first; null where it is kept. Its limits are twice those of short ones, up to a bound."""
    q, r, a = token_estimate(question), token_estimate(reasoning), token_estimate(answer)
    return (
        F.when(~looks_clean(question) | ~looks_clean(reasoning), "dirty_text").when(F.contains(reasoning, F.lit("```")), "code_in_reasoning")
        .when(F.contains(question, F.lit("def ")) | F.contains(F.substring(question, 1, 200), F.lit("executable Python")), "code_question")
        .when(r > min(2 * most_reasoning, 800), "reasoning_too_long").when(a > min(2 * most_answer + 16, 80), "answer_too_long").when(q + r + a > most_total, "total_too_long")
        .when(F.char_length(question) > 1200, "prompt_too_long").when(F.char_length(answer) > 400, "answer_chars_too_long")
    )


def sequential_index(df: DataFrame, order: str = "_ord", start: int = 0) -> DataFrame:
    """index: start, start + 1, ... in order."""
    return with_rank(df, order).withColumn("index", F.col("rank") - 1 + start).drop("rank")


def _pair(user: Column, assistant: Column) -> Column:
    turn = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    return F.array(turn("user", user), turn("assistant", assistant))


def _record(df: DataFrame, prefix: str, digits: int, category: str, source: Column, messages: Column, metadata: dict[str, Column]) -> DataFrame:
    numbered = sequential_index(df)
    record_id = F.format_string(f"{prefix}-%0{digits}d", "index")
    return numbered.select(record_id.alias("id"), F.lit(category).alias("category"), source.alias("source"), messages.alias("messages"), F.struct(*[v.alias(k) for k, v in metadata.items()]).alias("metadata"))


def external_record(df: DataFrame, split: str, category: str, source: str) -> DataFrame:
    """Records of external candidates (question, reasoning, answer, original_id, fields_used, _ord), white space normalised."""
    reasoning, final = normalize_ws("reasoning"), normalize_ws("answer")
    user, assistant = F.concat(F.lit(WRAP), F.col("question")), Th.build(reasoning, final)
    return _record(df, f"stage2-{split}-{category}", 5, category, F.lit(source), _pair(user, assistant), {
        "thinking": F.lit(True), "final_answer": final, "reasoning_token_estimate": token_estimate(reasoning), "total_token_estimate": token_estimate(user) + token_estimate(assistant),
        "source_original_id": F.coalesce("original_id", F.lit("")), "split": F.lit(split), "fields_used": F.col("fields_used"),
    })


def replay_record(df: DataFrame, split: str, kind: str, *, open_: bool = False) -> DataFrame:
    """Records of replayed conversations (id, category, source, messages, _ord); open answers have no final answer of their own."""
    user, assistant = first_user(), last_assistant()
    source = F.coalesce("source", F.lit("no_robots")) if open_ else F.lit("stage1_5_replay")
    return _record(df, f"stage2-{split}-{kind}", 5, kind, source, F.col("messages"), {
        "thinking": F.lit(False), "final_answer": F.lit("") if open_ else assistant, "reasoning_token_estimate": F.lit(0).cast("long"), "total_token_estimate": token_estimate(user) + token_estimate(assistant),
        "source_original_id": F.coalesce(F.col("id").cast("string"), F.lit("")), "split": F.lit(split), "source_category": F.coalesce("category", F.lit("")),
    })


def mixture_record(df: DataFrame, split: str, sample_type: str) -> DataFrame:
    """Records of the final mixture from replayed conversations: two messages, lineage, and the final answer after the tags."""
    user, assistant = first_user(), strip(last_assistant())
    return _record(df, f"stage3-{split}-{sample_type}", 6, sample_type, F.lit(sample_type), _pair(user, assistant), {
        "source_id": F.coalesce(F.col("id").cast("string"), F.lit("")), "source_split": F.lit(split), "source_category": F.coalesce("category", F.lit("")), "prompt_hash": prompt_hash(user),
        "final_answer": Th.final_answer(assistant), "token_length": token_estimate(user) + token_estimate(assistant),
    })


def positional_join(left: DataFrame, right: DataFrame, order: str = "_ord") -> DataFrame:
    """Row by row in order; tables of different lengths are an error. Columns of the right table take the prefix right_."""
    a, b = with_rank(left, order), with_rank(right, order).drop(order)
    n, m = left.count(), right.count()
    if n != m:
        raise ValueError(f"{n} rows on the left, {m} on the right")
    b = b.select(*[F.col(f"`{c}`").alias("rank" if c == "rank" else f"right_{c}") for c in b.columns])
    return a.join(b, "rank").drop("rank")
