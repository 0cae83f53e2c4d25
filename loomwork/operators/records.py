"""Validators of training records, as one error column each: the first broken rule, or null.

JSON is judged by ``scoring.json_success`` beforehand where a rule needs it (``json_ok``), because no engine's own JSON
reader agrees with Python's.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomwork.functions import grammar as G
from loomwork.functions import thinking as Th
from loomwork.functions.text import contains_any, count_words, fullmatch, let, lines, starts_with_any, strip, token_estimate

# Labels, openings that explain instead of answering, sample types and the length limit.
LABELS = ("positive", "negative", "neutral")
BAD_OPENINGS = ("sure", "here is", "the answer is", "i hope this helps", "```")
ANSWER_ONLY, COT = "answer_only", "compressed_cot"
REPLAYS = ("strict_replay", "thinking_replay")
MOST_TOKENS = 1024
END = "<|im_end|>"
THOUGHT = ("<|begin_of_thought|>", "<|end_of_thought|>")
_TAGS = (Th.OPEN, Th.CLOSE)


def strict_error(category: Column, user: Column, assistant: Column, *, categories: tuple[str, ...], line_count: Column | None = None, json_ok: Column | None = None) -> Column:
    """Records with a mechanical answer: shape of the answer by category."""
    count = F.lit(None).cast("int") if line_count is None else line_count
    low = F.lower(strip(assistant))
    return (
        F.when(category.isNull() | ~category.isin(*categories), "unsupported_category")
        .when(F.coalesce(user, F.lit("")) == "", "empty_user").when(F.coalesce(assistant, F.lit("")) == "", "empty_assistant")
        .when(F.contains(assistant, F.lit(END)), "end_mark").when(assistant != strip(assistant), "outer_whitespace")
        .when(starts_with_any(low, BAD_OPENINGS), "explanatory_prefix").when(F.contains(assistant, F.lit("```")), "markdown_fence")
        .when(category.isin("binary_only", "wonderland_like_binary") & ~fullmatch(assistant, "[01]{8}"), "not_8_bits")
        .when((category == "json_only") & ~F.coalesce(F.lit(True) if json_ok is None else json_ok, F.lit(False)), "invalid_json")
        .when((category == "yes_no") & ~assistant.isin("yes", "no"), "not_yes_no")
        .when((category == "classification") & ~assistant.isin(*LABELS), "not_a_label")
        .when((category == "line_count") & count.isNull(), "missing_count")
        .when((category == "line_count") & (F.size(lines(assistant)) != count), "wrong_line_count")
    )


def thinking_error(user: Column, assistant: Column, *, thinking: Column, final_answer: Column, subtype: Column, most_reasoning: int = 256, most_total: int = 512, json_ok: Column | None = None) -> Column:
    """Thinking records: tags, agreement with the metadata, token ceilings and the shape of the final answer."""

    def judged(p: Column) -> Column:
        final = p["final"]
        kind = F.coalesce(subtype, F.lit(""))
        return (
            F.when(~p["ok"], "no_think_structure").when(final == "", "empty_final").when(~F.coalesce(thinking, F.lit(False)), "metadata_not_thinking")
            .when(~F.coalesce(final_answer == final, F.lit(False)), "final_mismatch").when(token_estimate(p["reasoning"]) > most_reasoning + 50, "reasoning_too_long")
            .when(token_estimate(user) + token_estimate(assistant) > most_total + 128, "total_too_long").when(F.contains(final, F.lit("\n")) & (count_words(final) > 40), "final_explains")
            .when(kind.isin("binary_operation_thinking", "wonderland_like_binary_thinking") & ~fullmatch(final, "[01]{8}"), "not_8_bits")
            .when((kind == "json_final_thinking") & ~F.coalesce(F.lit(True) if json_ok is None else json_ok, F.lit(False)), "invalid_json")
            .when((kind == "yes_no_reasoning_thinking") & ~final.isin("yes", "no"), "not_yes_no").when((kind == "classification_thinking") & ~final.isin(*LABELS), "not_a_label")
        )

    return let(Th.parse(assistant, strict=False), judged)


def no_think_error(assistant: Column, *, thinking: Column, source_category: Column, open_replay: Column) -> Column:
    words, text = count_words(assistant), strip(assistant)
    return (
        F.when(contains_any(assistant, _TAGS), "think_tags").when(F.coalesce(thinking, F.lit(True)), "metadata_thinking")
        .when(~open_replay & source_category.isin("binary_only", "wonderland_like_binary") & ~fullmatch(text, "[01]{8}"), "not_8_bits")
        .when(~open_replay & (source_category == "yes_no") & ~text.isin("yes", "no"), "not_yes_no")
        .when(open_replay & ~words.between(50, 250), "words_out_of_range")
    )


def final_answer_ok(task: Column, answer: Column) -> Column:
    """A single line without residue, of the task's form: numbers need no decimals here, symbols need only be there."""
    loose = {"bit_manipulation": "[01]{8}", "numeral": "[IVXLCDM]+", "unit_conversion": G.NUMBER, "gravity": G.NUMBER, "cipher": G.WORDS}
    shaped = F.coalesce(*[F.when(task == t, fullmatch(answer, p)) for t, p in loose.items()], F.char_length(strip(answer)) > 0)
    return F.coalesce((answer != "") & ~F.contains(answer, F.lit("\n")) & ~contains_any(answer, (END, "\\boxed")) & shaped, F.lit(False))


def mixture_error(task: Column, sample_type: Column, user: Column, assistant: Column, *, tokens: Column, gold: Column, final_answer: Column, reasoner_answer: Column) -> Column:
    """Records of the final mixture: residue, tags by sample type, and agreement of final, gold, metadata and solver."""
    tagged = contains_any(assistant, _TAGS)

    def judged(p: Column) -> Column:
        final = F.when(tagged, F.when(p["ok"], p["final"]).otherwise("")).otherwise(strip(assistant))
        same = lambda x: F.coalesce(final == x, F.lit(False))
        cot = sample_type == COT
        breaks = F.char_length(p["reasoning"]) - F.char_length(F.replace(p["reasoning"], F.lit("\n"), F.lit("")))
        return (
            F.when(F.char_length(strip(F.coalesce(user, F.lit("")))) == 0, "empty_user").when(F.char_length(strip(F.coalesce(assistant, F.lit("")))) == 0, "empty_assistant")
            .when(F.contains(assistant, F.lit(END)), "end_mark").when(F.contains(assistant, F.lit("\\boxed")), "boxed_residue").when(tokens > MOST_TOKENS, "too_many_tokens")
            .when(cot & ~p["ok"], "unclosed_tags").when(cot & F.contains(p["final"], F.lit("\n")), "more_than_final").when(cot & (breaks > 8), "trace_too_long")
            .when((sample_type == ANSWER_ONLY) & tagged, "tags_in_answer_only").when(sample_type.isin(*REPLAYS) & tagged & ~p["ok"], "invalid_replay_tags")
            .when(sample_type.isin(*REPLAYS), F.lit(None).cast("string")).when(~sample_type.isin(COT, ANSWER_ONLY), "unsupported_sample_type")
            .when(~task.isin(*G.TASKS), "unsupported_task").when(~final_answer_ok(task, final), "final_parse_failed").when(~same(gold), "not_gold").when(~same(final_answer), "metadata_mismatch")
            .when(cot & ~same(reasoner_answer), "reasoner_mismatch")
        )

    return let(Th.parse(assistant, strict=True), judged)


def mini_error_class(final: Column, expected: Column, raw: Column, wants_think: Column, tokens: Column) -> Column:
    """Class of one wrong prediction: tags first, then stopping, then the answer; equal digits alone are a rounding error."""
    digits = lambda c: F.regexp_replace(c, r"[^0-9]", "")
    return (
        F.when(wants_think & ~Th.has_open(raw), "missing_think").when(wants_think & ~Th.has_close(raw), "unclosed_think").when(wants_think & (final == ""), "parse_fail")
        .when(tokens >= 256, "stop_fail").when(final == "", "parse_fail").when((digits(final) == digits(expected)) & (final != expected), "rounding_error")
        .when(final != expected, "answer_wrong").otherwise("unknown")
    )


def sharegpt(turns: Column) -> Column:
    """struct(ok, question, reasoning, answer) of turns with from/role and value/content: the first user turn, and the
    last assistant turn split at its thought marks."""
    role = lambda t: F.coalesce(F.nullif(t["from"], F.lit("")), t["role"])
    value = lambda t: F.coalesce(F.nullif(t["value"], F.lit("")), t["content"])
    said = F.filter(turns, lambda t: value(t).isNotNull())
    user = F.get(F.transform(F.filter(said, lambda t: role(t).isin("user", "human")), value), F.lit(0))
    reply = F.try_element_at(F.transform(F.filter(said, lambda t: role(t).isin("assistant", "gpt", "model")), value), F.lit(-1))

    def cut(r: Column) -> Column:
        a, b = F.locate(THOUGHT[0], r), F.locate(THOUGHT[1], r)
        reasoning = strip(F.substring(r, a + len(THOUGHT[0]), b - a - len(THOUGHT[0])))
        answer = strip(F.substring(r, b + len(THOUGHT[1]), F.char_length(r)))
        ok = F.coalesce((user != "") & (a > 0) & (b > a) & (reasoning != "") & (answer != ""), F.lit(False))
        return F.struct(ok.alias("ok"), F.when(ok, user).alias("question"), F.when(ok, reasoning).alias("reasoning"), F.when(ok, short_answer(answer)).alias("answer"))

    return let(reply, cut)


def short_answer(answer: Column) -> Column:
    """Without a code fence around it; of several lines the first, if it has 200 characters at most; else 400 characters."""
    bare = let(strip(answer), lambda s: F.when(F.startswith(s, F.lit("```")) & F.endswith(s, F.lit("```")), strip(F.regexp_replace(F.regexp_replace(s, r"\A```\n?", ""), r"\n?\z", ""))).otherwise(s))

    def first(s: Column) -> Column:
        kept = F.filter(F.transform(lines(s), strip), lambda x: x != "")
        return F.when((F.size(kept) > 1) & (F.char_length(F.get(kept, F.lit(0))) <= 200), F.get(kept, F.lit(0))).otherwise(F.substring(s, 1, 400))

    return let(bare, first)
