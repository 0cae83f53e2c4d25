"""Quality scores by Bradley-Terry pairwise ranking.

A document's strength is linear in features of its text. Labelled rows give preference pairs (one document of
label 1, one of label 0); the weights minimise the logistic loss of the pairs' feature differences, so no
intercept is learned. Documents are rejected whose strength lies below a low quantile of the preferred documents'
strengths (halfway to the high quantile of the others, where the two classes lie apart). ``score`` is a logistic
curve through ``cut`` (0.3) at that strength, its slope fitted to the labels, so ``score >= cut`` says the same as
``strength >= threshold``.

Weights, the scales of features and the curve's slope are learned on a bounded sample: at most ``max_rows`` labelled
rows (those with low hashes of their id) and ``max_pairs`` pairs. The quantiles are taken over all labelled rows;
features and scores cover every document and its whole text.

Nulls: a null text is an empty text and gets a score; a null doc_id meets no label. An id with several labels
counts once, with the larger share (a tie is 1). Without rows of both labels every score is 0.5. Repeated rows
stay repeated. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.llm.components import shuffled
from loomwork.llm.textkit import pick, release, settle, ship, sub_batches

_CLASSES = {"upper": range(65, 91), "digit": range(48, 58), "wide": range(128, 256), "mark": b"#*$%&|<>", "bar": b"|", "bang": b"!?", "stop": b".", "comma": b",;:", "other": b"\"'()-/=@[]^_`{}~+\\", "control": [*range(9), *range(14, 32), 127]}
_SETS = np.zeros((len(_CLASSES), 256))
for _k, _v in enumerate(_CLASSES.values()):
    _SETS[_k, list(_v)] = 1
NAMES = [*_CLASSES, "blank", "log_words", "word_length", "distinct", "stutter", "log_lines", "line_distinct"]


def features(text: str) -> np.ndarray:
    data = text.encode("utf-8", "surrogatepass")
    words, lines = data.split(), [x for x in data.split(b"\n") if x.strip()]
    n, m = max(1, len(data)), max(1, len(words))
    counts = np.bincount(np.frombuffer(data, dtype=np.uint8), minlength=256)
    # The share of distinct words falls with length in any text; the root of the length makes up for that.
    shares = np.sqrt(_SETS @ counts / n)
    rest = [counts[32] / n, np.log1p(len(words)), min(40.0, sum(map(len, words)) / m), len(set(words)) / m**0.8, sum(map(eq, words, words[1:])) / m, np.log1p(len(lines)), len(set(lines)) / max(1, len(lines))]
    return np.concatenate((shares, rest))


def feature_table(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for b in sub_batches(batches):
            rows = [features(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([r.tolist() for r in rows], pa.list_(pa.float64()))], names=["doc_id", "rk", "x"])

    return pick(df, id_col, text_col).withColumn("rk", F.xxhash64("doc_id", "text")).mapInArrow(run, "doc_id long, rk long, x array<double>")


class Ranker:
    def __init__(self, mean: np.ndarray, scale: np.ndarray, w: np.ndarray, cut_at: float, slope: float, cut: float) -> None:
        self.mean, self.scale, self.w, self.cut_at, self.slope, self.base = mean, scale, w, cut_at, slope, np.log(cut / (1 - cut))

    def strength(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8) @ self.w

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * (self.strength(x) - self.cut_at) + self.base, -40, 40)))


def between(at: float, other: float) -> float:
    return (at + other) / 2 if other < at else at


def fit(x: np.ndarray, y: np.ndarray, *, max_pairs: int = 200_000, ridge: float = 1e-3, quantile: float = 0.002, cut: float = 0.3) -> Ranker | None:
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return None
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
    z = np.clip((x - mean) / scale, -8, 8)
    n = int(min(max_pairs, len(good) * len(bad)))
    k = np.arange(n)
    # Every row takes part: both sides are walked through, the second with a step that shifts each round.
    i, j = good[k % len(good)], bad[(k + k // len(good)) % len(bad)]
    d = z[i] - z[j]
    w = np.zeros(d.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))  # of the wrong order
        g = d.T @ p / n - ridge * w
        h = (d * (p * (1 - p))[:, None]).T @ d / n + ridge * np.eye(len(w))
        step = np.linalg.solve(h, g)
        step *= min(1.0, 4 / max(1e-12, np.abs(step).max()))
        w += step
        if np.abs(step).max() < 1e-6:
            break
    s = z @ w
    # The cut is a low quantile of the preferred strengths; where it lies clear of the others' high quantile, halfway.
    at = between(float(np.quantile(s[good], quantile)), float(np.quantile(s[bad], 1 - quantile)))
    a, b = 1.0, 0.0
    centre, width = s.mean(), max(s.std(), 1e-6)
    t = (s - centre) / width
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(a * t + b, -30, 30)))
        r, v = y - p, np.maximum(p * (1 - p), 1e-6)
        h = np.array([[(v * t * t).sum() + 1, (v * t).sum()], [(v * t).sum(), v.sum() + 1e-3]])
        step = np.linalg.solve(h, np.array([(r * t).sum() - a, r.sum()]))
        step *= min(1.0, 4 / max(1e-12, np.abs(step).max()))
        a, b = a + step[0], b + step[1]
    return Ranker(mean, scale, w, at, max(a, 1e-3) / width, cut)


def _quantiles(labelled: DataFrame, ranker: Ranker, quantile: float) -> tuple[float, float]:
    """The low quantile of preferred strengths and the high one of the others, over all labelled rows (ranks within a millionth)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ranker.strength(b.column(1).flatten().to_numpy().reshape(b.num_rows, -1)))], names=["y", "s"])

    s = labelled.select("y", "x").mapInArrow(run, "y int, s double")
    return tuple(s.agg(F.percentile_approx(F.when(F.col("y") == 1, F.col("s")), quantile, 1_000_000), F.percentile_approx(F.when(F.col("y") == 0, F.col("s")), 1 - quantile, 1_000_000)).first())


def score(df: DataFrame, labels: DataFrame, *, label: str = "quality", folds: int = 5, held_fold: int = 0, max_rows: int = 20_000, max_pairs: int = 200_000, quantile: float = 0.002, cut: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted of every row; labels of held-out ids are never read into the fit."""
    out = score_rows(df, labels, label=label, folds=folds, held_fold=held_fold, max_rows=max_rows, max_pairs=max_pairs, quantile=quantile, cut=cut, id_col=id_col, text_col=text_col)
    return out.select("doc_id", "held_out", "score", "predicted")


def score_rows(df: DataFrame, labels: DataFrame, *, label: str = "quality", folds: int = 5, held_fold: int = 0, max_rows: int = 20_000, max_pairs: int = 200_000, quantile: float = 0.002, cut: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As ``score``, with rk, a hash of id and text by which rows are known."""
    held = lambda c: F.coalesce(F.crc32(F.col(c).cast("string")) % folds == held_fold, F.lit(False))
    x = settle(feature_table(df, id_col=id_col, text_col=text_col))
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("double").alias("y")).dropna().filter(~held("doc_id"))
    known = known.groupBy("doc_id").agg((F.avg("y") >= 0.5).cast("int").alias("y"))
    once = x.groupBy("doc_id").agg(F.min("x").alias("x"))
    labelled = settle(once.join(shuffled(known), "doc_id"))
    # Ids below a hash threshold: tasks send what stays, not a sorted head each.
    n, place = labelled.count(), F.shiftrightunsigned(F.xxhash64("doc_id"), 32)
    few = labelled if n <= max_rows else labelled.filter(place < int((1 << 32) * 0.98 * max_rows / n))
    rows = [tuple(r) for r in few.select("x", "y", place, "doc_id").collect()]
    rows = sorted(rows, key=lambda r: r[2:])[:max_rows]
    ranker = fit(np.array([r[0] for r in rows]), np.array([r[1] for r in rows]), max_pairs=max_pairs, quantile=quantile, cut=cut) if rows else None

    if ranker is not None:
        at, other = _quantiles(labelled, ranker, quantile)
        ranker.cut_at = between(at, other)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                m = b.column(2).flatten().to_numpy().reshape(b.num_rows, -1)
                s = np.full(b.num_rows, 0.5) if ranker is None else ranker.score(m)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s), pa.array((s >= cut).astype(np.int32))], names=["doc_id", "rk", "score", "predicted"])

    out = x.mapInArrow(run, "doc_id long, rk long, score double, predicted int")
    return out.select("doc_id", held("doc_id").alias("held_out"), "score", "predicted", "rk")
