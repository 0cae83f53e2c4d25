"""Runs of a text's words: stretches that repeat with a period, maximal on both sides.

A run is a stretch of consecutive words with smallest period q and a length of at least max(least, 2 * q) that neither neighbouring word extends.
They are found by Lyndon words, over words that are only compared, never hashed into fingerprints, and without suffix structures:

* Of every position, the next position whose suffix is smaller ends the longest Lyndon word that begins there. ``lyndon`` finds these ends, for an
  order of the words and for the reverse order, by a stack of suffixes that still wait for a smaller one. The root of every run is such a word in
  one of the two orders (Bannai et al.), so a run has the period next - here, and reaches as far as the texts from both ends agree to either side.
* How far two suffixes agree is read off what is known. Two waiting suffixes and a third: the smaller of the two extents, if they
  differ. Within a stretch that was matched before, the pair that lies as far back as the match shifts by has the same extent, as far as the match goes
  (Ellert and Fischer). Letters are only compared beyond the farthest match, so all extents together take a linear number of comparisons; ``left_extents`` does
  the same towards the front, no further than one period: a run is taken at the first of its roots.

A word that a text holds once ends every run, so the text falls apart there, and its pieces at words that the piece holds once, until nothing changes. Pieces
shorter than ``least`` hold no run. This is exact, and leaves the words of few texts to be walked.

``find`` gives doc_id, n_words, runs (array of start, length, period by start, then period) and collapsed: the words joined by one space without those that stand
in a run after its first period. Every row is worked on by itself, in slices of a batch: no shuffle. Memory grows with the longest text alone.

Nulls: a null text is an empty one, without words, runs or collapsed words; a null id stays. Repeated rows give a row each. Ties: equal words are one letter. Texts
shorter than ``least`` words have no runs. Empty tables give no rows. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.functions.text import let
from loomwork.llm.textkit import WORD, pick, ship, sub_batches

LEAST = 12
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_OUT = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


def repeats(s: Sequence) -> list[int]:
    """How many letters from each position on are equal to the letter after them."""
    out = [0] * len(s)
    for i in range(len(s) - 2, -1, -1):
        if s[i] == s[i + 1]:
            out[i] = out[i + 1] + 1
    return out


def lyndon(s: Sequence, equal: list[int], up: bool) -> tuple[list[int], list[int]]:
    """For each position the next one whose suffix is smaller (the text's length where none is), and how far both suffixes agree.

    Letters are ordered as they compare, or the other way round; the end of the text is smaller than any letter in both. ``equal`` is of ``repeats``.
    """
    n = len(s)
    after, agree = [n] * n, [0] * n
    # Of a waiting suffix: the one that waits below it, and how far it agrees with that.
    below, common = [-1] * n, [0] * n
    # s[back:far - j + back] was found equal to s[front:far].
    far = back = front = 0
    for j in range(1, n):
        i, b = j - 1, equal[j - 1]
        while True:
            x = j + b
            if x < n and (s[i + b] < s[x]) == up:
                below[j], common[j] = i, b
                break
            after[i], agree[i] = j, b
            k, a = below[i], common[i]
            if k < 0:
                break
            i = k
            if a < b:
                below[j], common[j] = k, a
                break
            if a > b:
                continue
            if j < far:
                # The place of j in the earlier stretch, and the pair there that has the same extent.
                m = j - front + back
                known = -1
                if k >= front:
                    y = k - front + back
                    known = agree[y] if after[y] == m else common[m] if below[m] == y else -1
                elif below[m] == k:
                    known = common[m]
                if 0 <= known < far - j:
                    b = known
                    continue
                if known >= 0:
                    b = far - j
            x = j + b
            while x < n and s[k + b] == s[x]:
                b += 1
                x += 1
            if x > far:
                far, back, front = x, k, j
    return after, agree


def left_extents(s: Sequence, after: list[int]) -> list[int]:
    """How far the texts before each position and before its next smaller suffix agree, going back one period at most."""
    n = len(s)
    out = [0] * n
    # s[low:back] was found equal to the stretch before front.
    low, back, front = n, -1, -1
    for i in range(n - 1, -1, -1):
        j = after[i]
        period, b = j - i, 0
        if j <= back and i > low and after[i + front - back] == j + front - back:
            b = min(out[i + front - back], period)
            if b < i - low:
                out[i] = b
                continue
            b = min(i - low, period)
        while b < period and b < i and s[i - b - 1] == s[j - b - 1]:
            b += 1
        out[i] = b
        if i - b < low:
            low, back, front = i - b, i, j
    return out


def runs_of(s: Sequence, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of a sequence of letters that have an order, by start, then period."""
    n, found, equal = len(s), set(), repeats(s)
    for up in (True, False):
        after, agree = lyndon(s, equal, up)
        before = left_extents(s, after)
        for i in range(n):
            period = after[i] - i
            more = before[i] + agree[i]
            if before[i] < period <= more and more + period >= least:
                found.add((i - before[i], more + period, period))
    return sorted(found)


def pieces(ids: np.ndarray, least: int = LEAST) -> list[tuple[int, int]]:
    """First and end of the stretches that can hold a run: each word of a stretch stands in it twice or more."""
    keep = np.bincount(ids)[ids] > 1
    while True:
        edge = np.flatnonzero(np.diff(np.concatenate(([False], keep, [False]))))
        first, last = edge[::2], edge[1::2]
        long = last - first >= least
        first, last = first[long], last[long]
        if not len(first):
            return []
        size = last - first
        piece = np.repeat(np.arange(len(first)), size)
        at = np.arange(len(piece)) + np.repeat(first - (np.cumsum(size) - size), size)
        _, word, count = np.unique(piece * (int(ids.max()) + 1) + ids[at], return_inverse=True, return_counts=True)
        twice = count[word] > 1
        if twice.all():
            return list(zip(first.tolist(), last.tolist(), strict=True))
        keep = np.zeros(len(ids), dtype=bool)
        keep[at[twice]] = True


def text_runs(words: list[bytes], least: int = LEAST) -> list[tuple[int, int, int]]:
    if len(words) < least:
        return []
    # Words as numbers by first place: an order as good as any, and quick to compare.
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), dtype=np.int64, count=len(words))
    return [(first + start, length, period) for first, last in pieces(ids, least) for start, length, period in runs_of(ids[first:last].tolist(), least)]


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words without those that stand in a run after its first period, joined by one space."""
    if runs:
        gone = np.zeros(len(words) + 1, dtype=np.int64)
        for start, length, period in runs:
            gone[start + period] += 1
            gone[start + length] -= 1
        words = [words[i] for i in np.flatnonzero(np.cumsum(gone[:-1]) == 0).tolist()]
    return b" ".join(words)


def _found(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sub_batches(batches):
            sizes, runs, ends, texts = [], [], [0], []
            for text in b.column(1).to_pylist():
                words = text.encode().split()
                own = text_runs(words, least)
                sizes.append(len(words))
                runs += own
                ends.append(len(runs))
                texts.append(collapse(words, own).decode())
            parts = [pa.array([r[k] for r in runs], pa.int64()) for k in range(3)]
            listed = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(parts, fields=list(_RUN)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), listed, pa.array(texts, pa.string())], names=["doc_id", "n_words", "runs", "collapsed"])

    return run


def find(df: DataFrame, *, least: int = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, runs, collapsed of every row (see the module)."""
    ship(df.sparkSession)
    return pick(df, id_col, text_col).mapInArrow(_found(least), _OUT)


def with_planted(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and text; every tenth document (by the crc32 of its id) repeats a stretch of its words from some word on, at least three times."""

    def repeated(words: Column, g: Column) -> Column:
        n = F.size(words)
        return let(
            F.struct(words.alias("w"), n.alias("n"), F.pmod(g, n).alias("a"), g.alias("g")),
            lambda v: let(
                F.struct(v["w"].alias("w"), v["n"].alias("n"), v["a"].alias("a"), (F.floor((v["n"] - v["a"]) / (3 + F.pmod(v["g"], F.lit(8)))) + 1).alias("p")),
                lambda u: F.array_join(F.transform(u["w"], lambda x, i: F.when(i >= u["a"], F.get(u["w"], (u["a"] + F.pmod(i - u["a"], u["p"])).cast("int"))).otherwise(x)), " "),
            ),
        )

    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    text = F.when((F.pmod(h, F.lit(10)) == 0) & F.col("text").rlike(WORD), repeated(words, F.floor(h / 10))).otherwise(F.col("text"))
    return pick(df, id_col, text_col).select("doc_id", text.alias("text"))


def digest(rows: DataFrame) -> DataFrame:
    """Rows of ``find`` as n_runs, the longest run (ties: least start, then period) and SHA-256 of the runs and of the collapsed text."""
    said = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    best = rows.select("doc_id", "collapsed", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(said, 256).alias("runs_sha256"))
    return best.select(
        "doc_id", "n_runs", (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.period")).alias("period"),
        F.floor(1000 * F.col("best.length") / -F.col("best.period")).alias("exponent_milli"), "runs_sha256", F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
