"""Letter ciphers and Roman numerals as Column expressions, with the steps behind each answer.

A letter map is two texts of the same length, known letters and what they stand for, so that reading is ``translate``. Words with unknown letters are looked
up by their shape (the places at which letters repeat) in an index of the word list, which is a literal of the plan; each word found adds its letters before the next is looked up.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomwork.functions.grammar import WORD_LIST
from loomwork.functions.text import WS_SET, col, let

STEPS = "array<struct<step: string, input: string, output: string>>"


def _words(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(f"[^{WS_SET}]+"), F.lit(0))


def _letter(word: Column, at: Column) -> Column:
    return F.substring(word, at, F.lit(1))


def _letters(word: Column) -> Column:
    """The letters of a word that is not empty."""
    return F.transform(F.sequence(F.lit(1), F.char_length(word)), lambda i: _letter(word, i))


def shape(word: Column) -> Column:
    """For each letter the place where it is first seen: 1.2.2.4 for a word like ball, with 2 for both of the same."""
    return F.array_join(F.transform(_letters(word), lambda c: F.call_function("instr", word, c).cast("string")), ".")


def _translate(text: Column, known: Column, meant: Column) -> Column:
    return F.call_function("translate", text, known, meant)


def _has(text: Column, letter: Column) -> Column:
    return F.call_function("instr", text, letter) > 0


def letter_map(examples: Column) -> Column:
    """struct(known, meant): the letters of words that stand opposite each other, each by its first place."""

    def aligned(v: Column) -> Column:
        words = F.zip_with(v["a"], v["b"], lambda x, y: F.struct(x.alias("x"), y.alias("y")))
        equal = F.filter(words, lambda w: F.char_length(w["x"]) == F.char_length(w["y"]))
        return F.flatten(F.transform(equal, lambda w: F.zip_with(_letters(w["x"]), _letters(w["y"]), lambda p, q: F.struct(p.alias("p"), q.alias("q")))))

    def of(e: Column) -> Column:
        both = F.struct(_words(e["input_value"]).alias("a"), _words(e["output_value"]).alias("b"))
        return let(both, lambda v: F.when(F.size(v["a"]) == F.size(v["b"]), aligned(v)).otherwise(F.array().cast("array<struct<p: string, q: string>>")))

    def learn(acc: Column, pair: Column) -> Column:
        more = F.struct(F.concat(acc["known"], pair["p"]).alias("known"), F.concat(acc["meant"], pair["q"]).alias("meant"))
        return F.when(_has(acc["known"], pair["p"]), acc).otherwise(more)

    return F.aggregate(F.array_distinct(F.flatten(F.transform(examples, of))), F.struct(F.lit("").alias("known"), F.lit("").alias("meant")), learn)


def _shape_of(word: str) -> str:
    return ".".join(str(word.index(c) + 1) for c in word)


def _index(words: tuple[str, ...]) -> Column:
    by_shape: dict[str, list[str]] = {}
    for w in sorted(words):
        by_shape.setdefault(_shape_of(w), []).append(w)
    entries = [x for s, ws in by_shape.items() for x in (F.lit(s), F.array(*map(F.lit, ws)))]
    return F.create_map(*entries)


def solve_cipher(examples: Column | str, question: Column | str, words: tuple[str, ...] = WORD_LIST) -> Column:
    """struct(answer, rule, steps), null where a word with unknown letters is like no word of the list."""
    index = _index(words)

    def unknown(word: Column, known: Column) -> Column:
        return F.exists(_letters(word), lambda c: ~_has(known, c))

    def like(secret: Column, word: Column, acc: Column) -> Column:
        def agrees(i: Column) -> Column:
            return let(F.struct(_letter(secret, i).alias("s"), _letter(word, i).alias("p")), lambda v: F.when(_has(acc["known"], v["s"]), _translate(v["s"], acc["known"], acc["meant"]) == v["p"]).otherwise(~_has(acc["meant"], v["p"])))

        return F.forall(F.sequence(F.lit(1), F.char_length(secret)), agrees)

    def learnt(acc: Column, secret: Column, word: Column) -> Column:
        pairs = F.array_distinct(F.zip_with(_letters(secret), _letters(word), lambda p, q: F.struct(p.alias("p"), q.alias("q"))))
        new = F.filter(pairs, lambda x: ~_has(acc["known"], x["p"]))
        return let(new, lambda n: F.struct(F.concat(acc["known"], F.array_join(F.transform(n, lambda x: x["p"]), "")).alias("known"), F.concat(acc["meant"], F.array_join(F.transform(n, lambda x: x["q"]), "")).alias("meant"), acc["found"].alias("found")))

    def step(acc: Column, v: Column) -> Column:
        """v is a word of the question, and whether the examples leave letters of it unknown."""
        hit = F.try_element_at(F.filter(F.coalesce(F.try_element_at(index, shape(v["w"])), F.array().cast("array<string>")), lambda w: like(v["w"], w, acc)), F.lit(1))

        def put(w: Column) -> Column:
            return let(learnt(acc, v["w"], w), lambda m: F.struct(m["known"].alias("known"), m["meant"].alias("meant"), F.concat(acc["found"], F.array(w)).alias("found")))

        lost = F.struct(acc["known"].alias("known"), acc["meant"].alias("meant"), F.lit(None).cast("array<string>").alias("found"))
        seen = F.struct(acc["known"].alias("known"), acc["meant"].alias("meant"), F.concat(acc["found"], F.array(F.lit(""))).alias("found"))
        return F.when(acc["found"].isNull(), acc).when(~v["u"], seen).otherwise(let(hit, lambda w: F.when(w.isNull(), lost).otherwise(put(w))))

    def told(asked: Column, m: Column, acc: Column) -> Column:
        read = F.zip_with(asked, acc["found"], lambda w, f: F.when(f != "", f).otherwise(_translate(w, m["known"], m["meant"])))
        used = F.array_distinct(F.flatten(F.transform(asked, _letters)))
        pairs = F.filter(F.transform(used, lambda c: F.struct(c.alias("c"), _translate(c, acc["known"], acc["meant"]).alias("p"))), lambda x: x["c"] != x["p"])

        def shown(v: Column) -> Column:
            rule = F.concat(F.array_join(F.transform(F.slice(v["pairs"], 1, 10), lambda x: F.concat(x["c"], F.lit("→"), x["p"])), ", "), F.when(F.size(v["pairs"]) > 10, " (remaining consistent)").otherwise(""))
            steps = F.concat(
                F.transform(v["pairs"], lambda x: F.struct(F.lit("letter").alias("step"), x["c"].alias("input"), x["p"].alias("output"))),
                F.zip_with(asked, v["read"], lambda w, r: F.struct(F.lit("word").alias("step"), w.alias("input"), r.alias("output"))),
            ).cast(STEPS)
            return F.struct(F.array_join(v["read"], " ").alias("answer"), rule.alias("rule"), steps.alias("steps"))

        return let(F.struct(read.alias("read"), pairs.alias("pairs")), shown)

    def with_map(asked: Column, m: Column) -> Column:
        marked = F.transform(asked, lambda w: F.struct(w.alias("w"), unknown(w, m["known"]).alias("u")))
        start = F.struct(m["known"].alias("known"), m["meant"].alias("meant"), F.array().cast("array<string>").alias("found"))
        return let(F.aggregate(marked, start, step), lambda acc: F.when(acc["found"].isNotNull(), told(asked, m, acc)))

    return let(_words(col(question)), lambda asked: let(letter_map(col(examples)), lambda m: with_map(asked, m)))


# The symbols of Roman numerals.
SYMBOLS = ((1000, "M"), (900, "CM"), (500, "D"), (400, "CD"), (100, "C"), (90, "XC"), (50, "L"), (40, "XL"), (10, "X"), (9, "IX"), (5, "V"), (4, "IV"), (1, "I"))
_TAKEN = "array<struct<before: bigint, value: bigint, symbol: string>>"


def roman_steps(n: Column) -> Column:
    """array of struct(before, value, symbol): what is left, and what is taken off it, largest first."""
    symbols = F.array(*[F.struct(F.lit(v).cast("bigint").alias("value"), F.lit(s).alias("symbol")) for v, s in SYMBOLS])
    start = F.struct(n.cast("bigint").alias("left"), F.array().cast(_TAKEN).alias("steps"))

    def take(acc: Column, s: Column) -> Column:
        times = F.call_function("div", acc["left"], s["value"])

        def taken(k: Column) -> Column:
            rows = F.transform(F.sequence(F.lit(0).cast("bigint"), k - 1), lambda i: F.struct((acc["left"] - i * s["value"]).alias("before"), s["value"].alias("value"), s["symbol"].alias("symbol")))
            return F.struct((acc["left"] - k * s["value"]).alias("left"), F.concat(acc["steps"], rows).alias("steps"))

        return let(times, lambda k: F.when(k > 0, taken(k)).otherwise(acc))

    return F.aggregate(symbols, start, take, lambda acc: acc["steps"])


def solve_numeral(question: Column | str) -> Column:
    """struct(answer, rule, steps) of a number, null for what is none."""
    q = col(question)

    def of(taken: Column) -> Column:
        text = lambda s: F.concat(s["before"].cast("string"), F.lit(" >= "), s["value"].cast("string"), F.lit(" -> "), s["symbol"], F.lit(", rem "), (s["before"] - s["value"]).cast("string"))
        lines = F.concat(F.array(F.concat(F.lit("Converting "), q)), F.transform(taken, text))
        rule = let(lines, lambda v: F.concat(F.array_join(F.slice(v, 1, 6), " | "), F.when(F.size(v) > 6, " | ...").otherwise("")))
        steps = F.transform(taken, lambda s: F.struct(F.lit("take").alias("step"), s["before"].cast("string").alias("input"), s["symbol"].alias("output"))).cast(STEPS)
        return F.struct(F.array_join(F.transform(taken, lambda s: s["symbol"]), "").alias("answer"), rule.alias("rule"), steps.alias("steps"))

    return F.when(q.rlike(r"\A\d+\z"), let(roman_steps(q.try_cast("bigint")), of))
