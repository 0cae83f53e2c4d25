"""What raw solver traces say: the boxed answer, the selected rules, the symbolic rule. As Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomwork.functions.text import col, let, lines, normalize_ws, strip

# Patterns of the traces.
BOXED = r"\\boxed\{([^}]*)\}"
ACTIONS = r"match,\s*correct,\s*actions:\s*(.+)"
OPERATOR = r"The question operator is (.+?), which is (.+?)\.?\z"
KNOWN_OPERATOR = "The question operator is found in the examples."


def answer(trace: Column | str) -> Column:
    """The last boxed value that is neither blank nor a dash; empty where there is none."""
    found = F.filter(F.transform(F.regexp_extract_all(col(trace), F.lit(BOXED), 1), strip), lambda x: (x != "") & (x != "–"))
    return F.coalesce(F.try_element_at(found, F.lit(-1)), F.lit(""))


def selected_rules(trace: Column | str) -> Column:
    """The rules listed by number below the line Selected, up to the first line of another form."""

    def read(all_: Column) -> Column:
        start = F.array_position(all_, "Selected").cast("int")
        rest = F.transform(F.when(start > 0, F.slice(all_, start + 1, F.size(all_))).otherwise(F.slice(all_, 1, 0)), strip)
        shaped = F.transform(rest, lambda x: x.rlike(r"\A\d+\s+\S"))
        n = F.array_position(shaped, False)
        kept = F.when(n > 0, F.slice(rest, F.lit(1), (n - 1).cast("int"))).otherwise(rest)
        return F.transform(kept, lambda x: F.regexp_extract(x, r"(?s)\A\d+\s+(.*)\z", 1))

    return let(lines(trace), read)


def symbolic_rule(trace: Column | str) -> Column:
    """The rule that an equation or a joined operator followed; empty where it is unknown or too general."""

    def read(all_: Column) -> Column:
        tidy = F.transform(all_, strip)
        actions = F.filter(F.transform(tidy, lambda x: F.regexp_extract(x, ACTIONS, 1)), lambda x: x != "")
        operators = F.filter(tidy, lambda x: x.rlike(OPERATOR))
        first = F.get(operators, F.lit(0))
        rule = F.regexp_replace(strip(F.regexp_extract(first, OPERATOR, 2)), r"\.+\z", "")
        joined = F.when(first.isNull() | (F.lower(rule) == "unknown"), "").otherwise(F.concat(rule, F.lit(" on operator "), strip(F.regexp_extract(first, OPERATOR, 1))))
        return F.when(F.size(actions) > 0, F.regexp_replace(F.get(actions, F.lit(0)), r",+\z", "")).when(F.contains(col(trace), F.lit(KNOWN_OPERATOR)), "").otherwise(joined)

    return let(lines(trace), read)


def clean_line(line: Column | str) -> Column:
    """Without boxed values, white space normalised."""
    return normalize_ws(F.regexp_replace(col(line), BOXED, ""))
