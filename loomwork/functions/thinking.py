"""Thinking blocks: build, parse by three rules, and flags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomwork.functions.text import col, strip

# The tags of the chat format.
OPEN, CLOSE = "<think>", "</think>"


def build(reasoning: Column | str, answer: Column | str) -> Column:
    return F.concat(F.lit(f"{OPEN}\n"), strip(reasoning), F.lit(f"\n{CLOSE}\n\n"), strip(answer))


def tag_count(c: Column | str, tag: str) -> Column:
    c = col(c)
    return ((F.char_length(c) - F.char_length(F.replace(c, F.lit(tag), F.lit("")))) / len(tag)).cast("int")


def parse(c: Column | str, *, strict: bool) -> Column:
    """struct(ok, reasoning, final). The lenient rule takes the first of each tag and permits an empty final;
    the strict rule asks for each tag once and a final. Both ask for reasoning that is not blank."""
    c = col(c)
    start, end = F.locate(OPEN, c), F.locate(CLOSE, c)
    reasoning = strip(F.substring(c, start + len(OPEN), end - start - len(OPEN)))
    final = strip(F.substring(c, end + len(CLOSE), F.char_length(c)))
    ok = (start > 0) & (end > start) & (F.char_length(reasoning) > 0)
    if strict:
        ok = ok & (tag_count(c, OPEN) == 1) & (tag_count(c, CLOSE) == 1) & (F.char_length(final) > 0)
    return F.struct(ok.alias("ok"), F.when(ok, reasoning).alias("reasoning"), F.when(ok, final).alias("final"))


def final_answer(c: Column | str) -> Column:
    """What follows the last closing tag, or the whole text; stripped."""
    return strip(F.substring_index(col(c), CLOSE, -1))


def final_after_first(c: Column | str) -> Column:
    """What follows the first closing tag, or the whole text; stripped."""
    c = col(c)
    at = F.locate(CLOSE, c)
    return strip(F.when(at > 0, F.substring(c, at + len(CLOSE), F.char_length(c))).otherwise(c))


def has_open(c: Column | str) -> Column:
    return F.contains(col(c), F.lit(OPEN))


def has_close(c: Column | str) -> Column:
    return F.contains(col(c), F.lit(CLOSE))
