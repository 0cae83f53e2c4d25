"""SimHash near-duplicates by tiled exact comparison.

Fingerprint: the majority of each bit over the XXH64 (seed 42) of all word shingles of a text, repeats
included. Copies share a fingerprint, so the comparison runs over distinct fingerprints only.

Two fingerprints within ``radius`` bits agree in at least one of radius + 1 blocks, and their population
counts differ by at most radius. Tiles are therefore keyed by (block, block value, population count //
(radius + 1)); a fingerprint is a member of its own tile and a visitor of the tile below. Inside a tile, numpy
compares pieces of 1024 by exclusive-or and bit count and skips pairs of pieces whose population counts differ
beyond the radius. A tile of many fingerprints is split into pairs of pieces, each a task's. A task keeps a union-find of what it has linked and emits a spanning forest, never all
pairs of a group. Components settle the rest.

Nulls: a null text is an empty one; empty texts have fingerprint zero and link like any other. A null doc_id
keeps its row; component_id is the least non-null id. Repeated rows stay repeated. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.llm.components import components, shuffled, skew_join, with_roots
from loomwork.llm.textkit import ascii_words, pick, release, settle, ship, sub_batches

TILE = 1024
#: Fingerprints in one tile beyond which it is split.
MOST = 50_000


def fingerprint(text: str, width: int = 3, seed: int = 42) -> int:
    words = ascii_words(text)
    if not words:
        return 0
    width = min(width, len(words))
    data, lengths = b" ".join(words), np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths).tolist()
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(data[s:e], seed) for s, e in zip(starts, ends[width - 1 :].tolist())], dtype="<u8")  # noqa: B905
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(h), 1 << 15):
        piece = h[at : at + (1 << 15)]
        ones += np.unpackbits(piece.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return int.from_bytes(np.packbits(2 * ones > len(h), bitorder="little").tobytes(), "little")


def fingerprints(df: DataFrame, *, width: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (the fingerprint's bits as a signed long)."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for b in sub_batches(batches):
            fps = np.array([fingerprint(t, width, seed) for t in b.column(1).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps)], names=["doc_id", "fp"])

    return pick(df, id_col, text_col).mapInArrow(run, "doc_id long, fp long")


def _forest(n: int, i: np.ndarray, j: np.ndarray, label: np.ndarray | None = None) -> np.ndarray:
    """Least index reachable from each of n nodes over the links i-j, continuing from label."""
    label = np.arange(n) if label is None else label
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def _close(run: np.ndarray, own: np.ndarray, radius: int) -> np.ndarray:
    """For one tile: the least linked index of each fingerprint. Two visitors are compared in their own tile."""
    n = len(run)
    order = np.argsort(np.bitwise_count(run), kind="stable")
    fp, mine = run[order], own[order]
    pc = np.bitwise_count(fp).astype(np.int64)
    label = np.arange(n)
    for a in range(0, n, TILE):
        x = fp[a : a + TILE]
        for b in range(a, n, TILE):
            if pc[b] - pc[min(a + TILE, n) - 1] > radius:
                break
            y = fp[b : b + TILE]
            near = np.bitwise_count(x[:, None] ^ y[None, :]) <= radius
            near &= mine[a : a + TILE, None] | mine[None, b : b + TILE]
            i, j = np.nonzero(near)
            keep = i + a < j + b
            if keep.any():
                label = _forest(n, i[keep] + a, j[keep] + b, label)
    out = np.empty(n, dtype=np.int64)
    out[order] = order[label]
    return out


def _short_links(key: np.ndarray, fp: np.ndarray, own: np.ndarray, longest: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links inside runs of equal keys, by shifting the arrays against themselves."""
    ii, jj = [], []
    for d in range(1, longest):
        if d >= len(key):
            break
        i = np.flatnonzero(key[:-d] == key[d:])
        if not len(i):
            break
        i = i[(np.bitwise_count(fp[i] ^ fp[i + d]) <= radius) & (own[i] | own[i + d])]
        ii.append(i)
        jj.append(i + d)
    empty = np.zeros(0, dtype=np.int64)
    return (np.concatenate(ii) if ii else empty), (np.concatenate(jj) if jj else empty)


def split(rows: DataFrame, most: int) -> DataFrame:
    """rows (key, fp and others), with tiles of over ``most`` fingerprints dealt to tasks of their own.

    Such a tile is cut into pieces by a hash; a task takes two pieces (or one), under a key made of the tile's and theirs. So all
    pairs meet, and no task holds more than about two pieces. Sizes are counted in the cluster; large tiles are few, as
    a fingerprint is in a fixed number of tiles.
    """
    large = rows.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > most)
    large = settle(large.select("key", F.ceil(F.col("n") / most).cast("int").alias("pieces")))
    if not large.head(1):
        return rows
    met = rows.join(F.broadcast(large), "key", "left")  # at most tiles / most rows
    mine = F.pmod(F.xxhash64("fp"), F.col("pieces")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))
    rest = [c for c in rows.columns if c != "key"]
    dealt = met.filter("pieces is not null").select("key", *rest, mine.alias("i"), other.alias("j"))
    dealt = dealt.select(F.xxhash64("key", F.least("i", "j"), F.greatest("i", "j")).alias("key"), *rest)
    return met.filter("pieces is null").select("key", *rest).unionByName(dealt)


def links(fps: DataFrame, radius: int = 2, most: int = MOST) -> DataFrame:
    """(a, b): spanning forests of the links among distinct fingerprints (column fp)."""
    parts = radius + 1
    cuts = [64 * k // parts for k in range(parts + 1)]
    blocks = [F.shiftrightunsigned("fp", lo).bitwiseAND((1 << (hi - lo)) - 1) for lo, hi in zip(cuts, cuts[1:], strict=False)]
    group = F.floor(F.bit_count("fp") / F.lit(parts)).cast("long")
    keys = F.array(*[F.struct(F.xxhash64(F.lit(k), v, group - back).alias("key"), F.lit(back == 0).alias("own")) for k, v in enumerate(blocks) for back in (0, 1)])
    spark = ship(fps.sparkSession)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = fps.select("fp", F.explode(keys).alias("t")).select(F.col("t.key").alias("key"), "fp", F.col("t.own").alias("own"))
    rows = split(rows, most).repartition(n, "key").sortWithinPartitions("key", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def linked(key: np.ndarray, fp: np.ndarray, own: np.ndarray) -> Iterator[pa.RecordBatch]:
            at = np.concatenate(([0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]))
            size = np.diff(at)
            short = np.repeat((size > 1) & (size <= 64), size)
            out: list[tuple[np.ndarray, np.ndarray]] = []
            if short.any():
                k, f, o = key[short], fp[short], own[short]
                i, j = _short_links(k, f, o, int(size[(size > 1) & (size <= 64)].max()), radius)
                if len(i):
                    root = _forest(len(f), i, j)
                    moved = np.flatnonzero(root != np.arange(len(f)))
                    out.append((f[moved], f[root[moved]]))
            for r in np.flatnonzero(size > 64):
                f = fp[at[r] : at[r + 1]]
                root = _close(f, own[at[r] : at[r + 1]], radius)
                moved = np.flatnonzero(root != np.arange(len(f)))
                out.append((f[moved], f[root[moved]]))
            if out:
                a, b = np.concatenate([x for x, _ in out]), np.concatenate([x for _, x in out])
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        def joined() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            return tuple(np.concatenate(x) for x in zip(*held, strict=True))  # type: ignore[return-value]

        for b in batches:
            if not b.num_rows:
                continue
            key = b.column(0).to_numpy()
            now = (key, b.column(1).to_numpy().view(np.uint64), b.column(2).to_numpy(zero_copy_only=False))
            if held and held[0][0][0] == key[-1]:
                held.append(now)  # still the same tile
                continue
            held.append(now)
            key, fp, own = joined()
            last = int(np.searchsorted(key, key[-1]))
            held = [(key[last:], fp[last:], own[last:])]
            if last:
                yield from linked(key[:last], fp[:last], own[:last])
        if held:
            yield from linked(*joined())

    return rows.mapInArrow(run, "a long, b long").distinct()


def near_duplicates(df: DataFrame, *, width: int = 3, seed: int = 42, radius: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id (least doc_id reachable over links)."""
    docs = settle(fingerprints(df, width=width, seed=seed, id_col=id_col, text_col=text_col))
    reps = settle(docs.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")))
    roots = with_roots(components(links(reps.select("fp"), radius)))
    known = settle(reps.join(shuffled(roots.withColumnRenamed("node", "fp")), "fp", "left").withColumn("root", F.coalesce("root", "fp")))
    least = known.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("m"))
    table = settle(skew_join(known, settle(least), "root", "m").select("fp", "component_id", "n"))
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return skew_join(docs, table, "fp", "n").select("doc_id", hexed.alias("fingerprint"), "component_id")
