"""Row-at-a-time models in plain Python, against which the column versions are held."""

import re

from loomwork.functions.grammar import WORD_LIST
from loomwork.functions.word_cipher import SYMBOLS


def roman(n: int) -> list[tuple[int, int, str]]:
    """Steps (remaining before, value taken, symbol)."""
    out = []
    for value, symbol in SYMBOLS:
        while n >= value:
            out.append((n, value, symbol))
            n -= value
    return out


def solve_numeral(examples, question):
    if not re.fullmatch(r"\d+", question):
        return None
    steps = roman(int(question))
    shown = [f"Converting {question}", *(f"{n} >= {v} -> {s}, rem {n - v}" for n, v, s in steps)]
    return "".join(s for _, _, s in steps), " | ".join(shown[:6]) + (" | ..." if len(shown) > 6 else "")


def _shape(word: str) -> tuple[int, ...]:
    return tuple(word.index(c) for c in word)


def solve_cipher(examples, question, words=WORD_LIST):
    """Letters from aligned example words, the first mapping of a letter winning; words that hold unknown letters are
    matched to the word list one after the other, each match adding its letters for the next."""
    known: dict[str, str] = {}
    for secret, plain in examples:
        a, b = secret.split(), plain.split()
        if len(a) == len(b):
            for x, y in zip(a, b, strict=True):
                if len(x) == len(y):
                    for s, p in zip(x, y, strict=True):
                        known.setdefault(s, p)
    asked = question.split()
    out = ["".join(known.get(c, "?") for c in w) for w in asked]
    for k in [k for k, w in enumerate(asked) if any(c not in known for c in w)]:
        secret, taken = asked[k], set(known.values())
        fits = [w for w in sorted(words) if _shape(w) == _shape(secret) and all(known[s] == p if s in known else p not in taken for s, p in zip(secret, w, strict=True))]
        if not fits:
            return None
        out[k] = fits[0]
        known.update(zip(secret, fits[0], strict=True))
    used = dict.fromkeys(c for w in asked for c in w if known[c] != c)
    shown = [f"{c}→{known[c]}" for c in used]
    return " ".join(out), ", ".join(shown[:10]) + (" (remaining consistent)" if len(shown) > 10 else "")
