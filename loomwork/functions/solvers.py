"""The solvers that work on batches of problems in Python: bit strings and symbols. Numerals and ciphers are columns (``word_cipher``), physics too.

Each takes (examples, question) pairs and gives (answer, rule) for each, or None where the examples show no rule.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from loomwork.functions import bit_rules, equations

Pairs = list[tuple[str, str]]
Found = tuple[str, str] | None
_NUMERIC = re.compile(r"\d+\D\d+")


def solve_bits(examples: Pairs, question: str) -> Found:
    return bit_rules.solve_batch([(examples, question)])[0]


def solve_equation(examples: Pairs, question: str) -> Found:
    return equations.solve_batch([(examples, question)])[0]


def solve_cryptarithm(examples: Pairs, question: str) -> Found:
    """Five characters, two on each side of an operator: joined forwards or backwards as its examples all do, else forwards."""
    if len(question) != 5 or any(len(a) != 5 for a, _ in examples):
        return None
    same = [(a, o) for a, o in examples if a[2] == question[2]]
    forward, backward = (lambda s: s[:2] + s[3:]), (lambda s: s[3:] + s[:2])
    if same and all(o == forward(a) for a, o in same):
        return forward(question), "concatenation"
    if same and all(o == backward(a) for a, o in same):
        return backward(question), "reverse concatenation"
    return forward(question), ""


def solve_symbolic(problems: list[tuple[Pairs, str]], at_once: bool = False) -> list[Found]:
    """Numeric questions try the equations first, others the cryptarithm; a result without a rule gives way to the next,
    or, at once, to none (the second and third version)."""
    by_equation = equations.solve_batch(problems)
    out: list[Found] = []
    for (examples, question), equation in zip(problems, by_equation, strict=True):
        found = [equation, solve_cryptarithm(examples, question)]
        if not _NUMERIC.fullmatch(question):
            found.reverse()
        shown = [f for f in found if f is not None]
        if at_once:
            shown = shown[:1]
        out.append(next((f for f in shown if f[1]), None))
    return out


#: The first version's symbolic dispatcher tries both solvers; those of later versions return at once.
_SOLVERS: dict[str, Callable[[list[tuple[Pairs, str]], int], list[Found]]] = {
    "bit_manipulation": lambda problems, version: bit_rules.solve_batch(problems),
    "symbolic_transform": lambda problems, version: solve_symbolic(problems, at_once=version > 1),
}


def solve_many(tasks: list[str], problems: list[tuple[Pairs, str]], version: int = 1) -> list[tuple[str, str, str]]:
    """(answer, rule, error) of each problem; error is empty where there is an answer.

    A batch that a solver fails on is solved row by row, so that the error is the row's own: its type and what it says.
    """
    out = [("", "", "missing_reasoner")] * len(tasks)
    for task, solver in _SOLVERS.items():
        places = [i for i, t in enumerate(tasks) if t == task]
        try:
            found = [f or "no_rule" for f in solver([problems[i] for i in places], version)]
        except (ValueError, KeyError, IndexError, ArithmeticError):
            found = [_alone(solver, problems[i], version) for i in places]
        for i, f in zip(places, found, strict=True):
            out[i] = ("", "", f) if isinstance(f, str) else (*f, "")
    return out


def _alone(solver: Callable, problem: tuple[Pairs, str], version: int) -> tuple[str, str] | str:
    try:
        return solver([problem], version)[0] or "no_rule"
    except (ValueError, KeyError, IndexError, ArithmeticError) as e:
        return f"reasoner_error:{type(e).__name__}: {e}"


def solve(task: str, examples: Pairs, question: str, version: int = 1) -> tuple[str, str, str]:
    return solve_many([task], [(examples, question)], version)[0]
