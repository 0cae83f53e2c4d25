"""Text predicates and transforms as Column expressions, with Python's notion of white space and lines.

``\\s``, ``trim`` and ``$`` of the JVM differ from Python's; everything here spells its classes out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Members of the white-space class and the line separators, as code points.
WS_SET = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WS = f"[{WS_SET}]"
LINE_SEP = r"\r\n|[\n\r\x0B\f\x1c-\x1e\x85\u2028\u2029]"
WORD = r"[\p{L}\p{N}_]+"
NONPRINT = rf"[[\p{{C}}\p{{Z}}]&&[^{WS_SET}]]"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once.

    Catalyst puts a projection's expressions in the place of their names when it moves filters or aggregates
    below it, so an expression that names others several times can grow without bound; a lambda's variable cannot.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(c: Column | str) -> Column:
    return F.regexp_replace(col(c), rf"\A{WS}+|{WS}+\z", "")


def lstrip(c: Column | str) -> Column:
    return F.regexp_replace(col(c), rf"\A{WS}+", "")


def rstrip(c: Column | str) -> Column:
    return F.regexp_replace(col(c), rf"{WS}+\z", "")


def normalize_ws(c: Column | str) -> Column:
    """Runs of white space become one blank; ends are stripped."""
    return F.trim(F.regexp_replace(col(c), f"{WS}+", " "))


def prompt_hash(c: Column | str) -> Column:
    return F.sha2(normalize_ws(c), 256)


def fullmatch(c: Column | str, pattern: str | Column) -> Column:
    """The whole value matches; a pattern column gives each row its own pattern."""
    if isinstance(pattern, str):
        return col(c).rlike(rf"\A(?:{pattern})\z")
    return F.regexp_like(col(c), F.concat(F.lit(r"\A(?:"), pattern, F.lit(r")\z")))


def lines(c: Column | str) -> Column:
    """The lines of a text: a final separator opens no new line, an empty text has none."""
    return let(F.split(col(c), LINE_SEP), lambda parts: F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts))


def count_words(c: Column | str) -> Column:
    """Runs of letters, digits and underscores."""
    return F.regexp_count(col(c), F.lit(WORD)).cast("long")


def count_fields(c: Column | str) -> Column:
    """Runs between white space."""
    return F.regexp_count(col(c), F.lit(f"[^{WS_SET}]+")).cast("long")


def token_estimate(c: Column | str) -> Column:
    """One token for 3.5 characters, at least one; none for an empty text."""
    n = F.char_length(col(c))
    return F.when(n == 0, 0).otherwise(F.greatest(F.lit(1), (n / 3.5).cast("int"))).cast("long")


def printable_ratio(c: Column | str) -> Column:
    c = col(c)
    n = F.char_length(c)
    return F.when(n == 0, 1.0).otherwise(F.char_length(F.regexp_replace(c, NONPRINT, "")) / n)


def distinct_chars(c: Column | str) -> Column:
    return F.size(F.array_distinct(F.filter(F.split(strip(c), ""), lambda x: x != ""))).cast("long")


def looks_clean(c: Column | str, least_distinct: int = 8, least_printable: float = 0.98) -> Column:
    """No NUL or replacement character, printable enough, and varied enough after stripping."""
    c = col(c)
    return (F.char_length(strip(c)) > 0) & ~c.contains("\x00") & ~c.contains("\ufffd") & (printable_ratio(c) >= least_printable) & (distinct_chars(c) >= least_distinct)


def starts_with_any(c: Column, prefixes: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for p in prefixes:
        out = out | F.startswith(c, F.lit(p))
    return out


def contains_any(c: Column, parts: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | F.contains(c, F.lit(p))
    return out


def decimal_key(c: Column | str) -> Column:
    """A canonical text of a plain decimal number, so that equal numbers of any size have equal texts; others are null."""
    c = col(c)
    neg, whole, frac = F.regexp_extract(c, r"\A(-?)", 1), F.regexp_extract(c, r"\A-?0*(\d*)", 1), F.regexp_extract(c, r"\.(\d*?)0*\z", 1)
    body = F.concat(F.when(whole == "", "0").otherwise(whole), F.when(frac == "", "").otherwise(F.concat(F.lit("."), frac)))
    return F.when(fullmatch(c, r"-?\d+(\.\d+)?"), F.when(body == "0", "0").otherwise(F.concat(neg, body)))
