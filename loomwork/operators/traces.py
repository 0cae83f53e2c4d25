"""What a compressed trace teaches: flags by task from its thinking block."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomwork.functions import thinking as Th
from loomwork.functions.text import strip

# Patterns of each flag by task; a task without a pattern never has the flag.
RULE = {
    "gravity": r"g\s*=\s*2\*d/\s*t\^2|0\.5\*g\*t\^2",
    "unit_conversion": r"(?i)ratio|output/input",
    "bit_manipulation": r"(?i)selected rule|rule:|pattern:",
    "cipher": r"(?i)mapping|substitution|shift|caesar",
    "symbolic_transform": r"(?i)rule:|reversed|swap|mirror",
    "numeral": r"(?i)rule|place.?value|roman|decimal",
}
NUMBER = {
    "gravity": r"g\s*[≈=]\s*\d+\.?\d*",
    "unit_conversion": r"(?i)ratio.*?\d+\.\d+|coefficient.*?\d+\.\d+|\d+\.\d+.*?ratio",
    "bit_manipulation": r"(?i)rule\s*[=:]\s*\[\d|bit\s*\d",
    "cipher": r"(?i)\w+\s*->\s*\w+|encrypted|decoded",
}
QUERY = {
    "gravity": r"(?i)query|t\s*=\s*\d+|compute d",
    "unit_conversion": r"(?i)query|apply.*coefficient|multiply|×",
    "bit_manipulation": r"(?i)apply.*rule|query|each bit",
    "cipher": r"(?i)query|apply.*mapping|decode.*word",
    "symbolic_transform": r"(?i)apply|query|each.*rule|operands",
    "numeral": r"(?i)convert|query|number",
}
# A trace is only a template where none of these flags holds.
NEEDS = {"gravity": ("number", "query"), "unit_conversion": ("number", "query"), "bit_manipulation": ("rule", "number"), "cipher": ("number",), "symbolic_transform": ("rule",), "numeral": ("rule",)}


def flags(task: Column, text: Column) -> dict[str, Column]:
    """has_rule, has_number, has_query, has_answer and template_only; without a closed thinking block all are false."""
    block = strip(F.regexp_extract(text, r"(?s)<think>(.*?)</think>", 1))
    closed = text.rlike(r"(?s)<think>.*?</think>")
    one = lambda of: closed & F.coalesce(*[F.when(task == t, block.rlike(p)) for t, p in of.items()], F.lit(False))
    found = {"rule": one(RULE), "number": one(NUMBER), "query": one(QUERY)}
    lacks = F.coalesce(*[F.when(task == t, ~found[n[0]] & (~found[n[1]] if len(n) > 1 else F.lit(True))) for t, n in NEEDS.items()], F.lit(False))
    return {f"has_{k}": v for k, v in found.items()} | {"has_answer": closed & (Th.final_answer(text) != ""), "template_only": closed & lacks}
