"""Rules of bit strings as truth tables over a batch of problems.

A rule gives one bit of the output as a function of one or two bits of the input. Each column of bits, that is one place of the inputs or outputs over all
examples of a problem, is packed into whole numbers, 64 examples to each: a rule is then one bitwise operation on a problem's columns, and it fits an output bit
where its column equals that bit's. All rules are worked out at once for all problems of a batch.

A run is a rule that goes on fitting as output bit and operands move by one place together. Since moving permutes the rules, runs are read off the table of fits by
that permutation, and their lengths are running conjunctions.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np

Pairs = list[tuple[str, str]]
BITS = 8
# Families in the order in which they win ties.
FAMILIES = ("Identity", "NOT", "Constant", "AND", "OR", "XOR", "AND-NOT", "OR-NOT", "XOR-NOT")
# How families are written in a rule's text, where not by name.
WRITTEN = {"Identity": "I", "Constant": "C"}
#: Problems worked out at once: their table of fits has some 3000 bytes each.
SLICE = 2048


def operands(family: str) -> Iterator[tuple[int, int | None]]:
    """A family's operands in the order in which they are tried; a constant's operand is its value.

    The second operand of an inverted family lies 1 to 7 places after the first. Of the others, whose operands may change places, pairs lie up to half way round, both ways.
    """
    if family == "Constant":
        yield from ((v, None) for v in (0, 1))
    elif family in ("Identity", "NOT"):
        yield from ((p, None) for p in range(BITS))
    elif family.endswith("-NOT"):
        yield from ((a, (a + d) % BITS) for d in range(1, BITS) for a in range(BITS))
    else:
        for d in range(1, BITS // 2 + 1):
            for a in range(BITS if 2 * d < BITS else BITS // 2):
                yield from ((a, (a + d) % BITS), ((a + d) % BITS, a))


RULES: list[tuple[str, int, int | None]] = [(f, p, q) for f in FAMILIES for p, q in operands(f)]
_PLACE = {r: k for k, r in enumerate(RULES)}
_SPAN = {f: (min(k for k, r in enumerate(RULES) if r[0] == f), max(k for k, r in enumerate(RULES) if r[0] == f) + 1) for f in FAMILIES}


def moved(rule: tuple[str, int, int | None], by: int) -> tuple[str, int, int | None]:
    family, p, q = rule
    return rule if family == "Constant" else (family, (p + by) % BITS, None if q is None else (q + by) % BITS)


#: The place of each rule moved by 0 to 7.
_MOVED = np.array([[_PLACE[moved(r, k)] for r in RULES] for k in range(BITS)])
_FIRST = np.array([p for _, p, _ in RULES])
_SECOND = np.array([p if q is None else q for _, p, q in RULES])


def written(rule: tuple[str, int, int | None] | None) -> str:
    """The text of a rule; where no rule is known a bit is 1."""
    return "default 1" if rule is None else WRITTEN.get(rule[0], rule[0]) + str(rule[1]) + ("" if rule[2] is None else str(rule[2]))


def packed(columns: np.ndarray) -> np.ndarray:
    """(problem, example, place) of bits -> (problem, place, word): columns as whole numbers of 64 examples."""
    n, m, places = columns.shape
    words = -(-m // 64)
    bits = np.zeros((n, places, 64 * words), dtype=np.uint8)
    bits[:, :, :m] = columns.transpose(0, 2, 1)
    return np.packbits(bits, axis=2, bitorder="little").view("<u8")


def tables(inputs: np.ndarray, full: np.ndarray) -> np.ndarray:
    """(problem, rule, word): every rule's column. full has ones where a problem has examples."""
    a, b = inputs[:, _FIRST], inputs[:, _SECOND]
    out = np.empty_like(a)
    for family, (first, last) in _SPAN.items():
        s = np.s_[:, first:last]
        x, y = a[s], b[s] ^ full if family.endswith("-NOT") else b[s]
        match family.removesuffix("-NOT"):
            case "Identity":
                out[s] = x
            case "NOT":
                out[s] = x ^ full
            case "Constant":
                out[s] = np.array([0, 2**64 - 1], dtype=np.uint64)[None, :, None] & full
            case "AND":
                out[s] = x & y
            case "OR":
                out[s] = x | y
            case "XOR":
                out[s] = x ^ y
    return out


def fits(problems: list[tuple[list[str], list[str]]]) -> np.ndarray:
    """(problem, rule, bit): whether the rule gives that bit of all outputs. Inputs and outputs are strings of eight bits."""
    most = max(len(i) for i, _ in problems)
    columns = np.zeros((2, len(problems), most, BITS), dtype=np.uint8)
    full = np.zeros((len(problems), most, 1), dtype=np.uint8)
    for k, sides in enumerate(problems):
        full[k, : len(sides[0])] = 1
        for side, values in enumerate(sides):
            columns[side, k, : len(values)] = np.frombuffer("".join(values).encode(), dtype=np.uint8).reshape(-1, BITS) - 48
    given, wanted, ones = packed(columns[0]), packed(columns[1]), packed(full)
    made = tables(given, ones)
    out = np.ones((len(problems), len(RULES), BITS), dtype=bool)
    for w in range(made.shape[2]):
        out &= made[:, :, None, w] == wanted[:, None, :, w]
    return out


def runs(fit: np.ndarray, from_left: bool) -> tuple[np.ndarray, np.ndarray]:
    """The first of each problem's longest runs from that side: the rule at the side's own bit, and the length (0 if there is none)."""
    goes = np.ones(fit.shape[:2], dtype=bool)
    length = np.zeros(fit.shape[:2], dtype=np.int8)
    for k in range(BITS):
        bit, by = (k, k) if from_left else (BITS - 1 - k, -k % BITS)
        goes &= fit[:, _MOVED[by], bit]
        length += goes
    best = length.argmax(axis=1)
    return best, length[np.arange(len(fit)), best]


@cache
def _candidates(family: str, p: int | None, q: int | None) -> tuple[int, ...]:
    """Places of a family's rules that have the operands wished for, in order; None wishes nothing."""
    first, last = _SPAN[family]
    if family == "Constant":
        return tuple(range(first, last))
    if family in ("Identity", "NOT"):
        return tuple(k for k in range(first, last) if RULES[k][1] in (p, q))
    ways = dict.fromkeys([(p, q), (q, p) if None not in (p, q) else (p, q)])
    return tuple(k for a, b in ways for k in range(first, last) if a in (None, RULES[k][1]) and b in (None, RULES[k][2]))


def _wish(runs_: list[tuple[str, tuple, int]]) -> tuple[int | None, int | None] | None:
    """The operands that runs would have at a bit; a run of one operand wishes it on its own side, and joins in with the other's where that is free."""
    wish: list[int | None] | None = None
    for side, rule, by in runs_:
        family, p, q = moved(rule, by)
        if family == "Constant":
            continue
        more = [p, q] if q is not None else [p, None] if side == "left" else [None, p]
        if wish is None:
            wish = more
        elif family in ("Identity", "NOT"):
            wish = [w if w is not None else m for w, m in zip(wish, more, strict=True)]
    return tuple(wish) if wish is not None else None  # type: ignore[return-value]


def _vector(fit: np.ndarray, left: tuple[int, int], right: tuple[int, int]) -> list[tuple[str, int, int | None] | None]:
    """A problem's rule for each bit: both runs, and between them what they wish where it fits, of one family if one does for all."""
    (l_rule, l_len), (r_rule, r_len) = left, right
    right_first = r_len > l_len
    if l_len + r_len > BITS:
        if right_first:
            l_len = BITS - r_len
        else:
            r_len = BITS - l_len
    # The right run's rule is that of the last bit.
    best: list[tuple[str, int, int | None] | None] = [None] * BITS
    for k in range(l_len):
        best[k] = moved(RULES[l_rule], k)
    for k in range(r_len):
        best[BITS - 1 - k] = moved(RULES[r_rule], -k)
    wishes = {}
    for bit in range(l_len, BITS - r_len):
        sides = ([("left", RULES[l_rule], bit)] if l_len else []) + ([("right", RULES[r_rule], bit - BITS + 1)] if r_len else [])
        wish = _wish(sides[::-1] if right_first else sides)
        if wish is not None:
            wishes[bit] = wish

    def choice(family: str, bit: int) -> int | None:
        return next((k for k in _candidates(family, *wishes[bit]) if fit[k, bit]), None)

    whole = next((f for f in FAMILIES if wishes and all(choice(f, bit) is not None for bit in wishes)), None)
    for bit in wishes:
        chosen = next((k for f in ([whole] if whole else FAMILIES) if (k := choice(f, bit)) is not None), None)
        best[bit] = None if chosen is None else RULES[chosen]
    return best


def _apply(rule: tuple[str, int, int | None] | None, bits: str) -> str:
    if rule is None:
        return "1"
    family, p, q = rule
    if family == "Constant":
        return str(p)
    a = int(bits[p])
    if q is None:
        return str(a ^ (family == "NOT"))
    b = int(bits[q]) ^ family.endswith("-NOT")
    return str({"AND": a & b, "OR": a | b, "XOR": a ^ b}[family.removesuffix("-NOT")])


def cleaned(v: str) -> str:
    return "".join(c for c in v if c in "01")


def readable(examples: Pairs, question: str) -> tuple[list[str], list[str], str] | None:
    """Inputs, outputs and question as eight bits each, or None."""
    inputs, outputs, asked = [cleaned(a) for a, _ in examples], [cleaned(b) for _, b in examples], cleaned(question)
    return (inputs, outputs, asked) if examples and all(len(v) == BITS for v in (*inputs, *outputs, asked)) else None


def solve_batch(problems: list[tuple[Pairs, str]]) -> list[tuple[str, str] | None]:
    """(answer, rules) of each problem, None where the examples are no bits or nothing fits."""
    out: list[tuple[str, str] | None] = [None] * len(problems)
    clear = [(i, r) for i, p in enumerate(problems) if (r := readable(*p))]
    for at in range(0, len(clear), SLICE):
        part = clear[at : at + SLICE]
        fit = fits([(inputs, outputs) for _, (inputs, outputs, _) in part])
        left, right = runs(fit, True), runs(fit, False)
        for k, (i, (_, _, asked)) in enumerate(part):
            vector = _vector(fit[k], (int(left[0][k]), int(left[1][k])), (int(right[0][k]), int(right[1][k])))
            if any(vector):
                out[i] = ("".join(_apply(r, asked) for r in vector), ", ".join(f"b{b}:{written(r)}" for b, r in enumerate(vector)))
    return out
