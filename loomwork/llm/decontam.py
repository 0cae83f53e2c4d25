"""Benchmark decontamination: containment search with MinHash over size classes, then exact checks.

An item is found in a document when at least ``containment`` of its distinct shingles (five words, lower-cased
runs of letters and digits) occur anywhere in the document. A short item is a tiny part of a long document, so
whole documents cannot be compared by Jaccard. Items are partitioned by size instead: class u holds items of
u/2 to u shingles, from 8 on, and for each class a document is read in windows of 2u shingles that advance by u. An item
that lies in a window shares at least a fifth of their union, so of ``hashes`` minima one at least agrees but
for a chance of 0.8**64, and pairs with an equal minimum become candidates. A candidate is checked exactly, over
all shingles of the document. Items of fewer than five shingles have none of this: a document with any of their shingles
is a candidate. Nothing caps candidates.

Items come in groups of at most ``group``, one group after the other against all documents (a pass for every half group of items, each
some 4 kilobytes in a worker); documents are never shuffled. Tasks make a group's index and write it to the shared folder, workers read it there, so the
driver holds no item. The ``decontam-*`` folder stays, as the result is read when it is asked for.

Nulls: null texts are empty; an item without words is in no document; null ids stay null. An item of fewer
than five words is one shingle of its own length, found where a document has that run of words. Repeated
rows give repeated results. Empty tables give no rows.
"""

from __future__ import annotations

import pickle
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.llm.sstable import open_fs
from loomwork.llm.textkit import HELD, pick, release, shared_dir, shingle_hashes, ship, sub_batches, word_hashes

_WORDS = re.compile(r"[^\W_]+")
SCHEMA = "doc_id long, item_id long, n_shingles long, n_found long, containment double"


def words_of(text: str) -> np.ndarray:
    return word_hashes([w.encode("utf-8", "surrogatepass") for w in _WORDS.findall(text.lower())])


class Items:
    """One group of benchmark items, ready for search."""

    def __init__(self, rows: list[tuple[int | None, str]], width: int, containment: float, hashes: int) -> None:
        self.width, self.containment = width, containment
        rng = np.random.default_rng(20)
        self.mul = rng.integers(1, 1 << 31, hashes, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
        self.xor = rng.integers(0, 1 << 32, hashes, dtype=np.uint32)
        self.ids: list[int | None] = []
        self.shingles: list[np.ndarray] = []
        self.short: dict[int, dict[int, list[int]]] = {}
        self.few: dict[int, list[int]] = {}
        classes: dict[int, list[int]] = {}
        for item, text in rows:
            w = words_of(text)
            if not len(w):
                continue
            s = np.unique(shingle_hashes(w, width))
            k = len(self.ids)
            self.ids.append(item)
            self.shingles.append(s)
            if len(w) < width:
                self.short.setdefault(len(w), {}).setdefault(int(s[0]), []).append(k)
            elif len(s) < 5:
                for x in s:
                    self.few.setdefault(int(x), []).append(k)
            else:
                classes.setdefault(max(8, 1 << (len(s) - 1).bit_length()), []).append(k)
        self.classes = []
        for u, members in sorted(classes.items()):
            minima = np.array([[((self.fold(self.shingles[k]) ^ x) * m).min() for m, x in zip(self.mul, self.xor, strict=True)] for k in members], dtype=np.uint32)
            lists = []
            for j in range(hashes):
                order = np.argsort(minima[:, j], kind="stable")
                bits = np.zeros(1 << 16, dtype=bool)
                bits[minima[:, j] >> np.uint32(16)] = True
                lists.append((minima[order, j], np.array(members, dtype=np.int32)[order], bits))
            self.classes.append((u, lists))

    @staticmethod
    def fold(h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(32)).astype(np.uint32)

    def candidates(self, docs: list[np.ndarray]) -> set[tuple[int, int]]:
        """(document, item) pairs of which some window and the item share a minimum."""
        found: set[tuple[int, int]] = set()
        if not docs:
            return found
        sizes = np.array([len(d) for d in docs])
        if self.few:
            whole, keys = np.concatenate(docs), np.array(sorted(self.few), dtype=np.uint64)
            hit = np.flatnonzero(keys[np.minimum(np.searchsorted(keys, whole), len(keys) - 1)] == whole)
            for d, x in zip(np.repeat(np.arange(len(docs)), sizes)[hit].tolist(), whole[hit].tolist(), strict=True):
                found.update((d, k) for k in self.few[x])
        joined = self.fold(np.concatenate(docs))
        first = np.cumsum(sizes) - sizes
        for u, lists in self.classes:
            blocks = -(-sizes // u)
            owner = np.repeat(np.arange(len(docs)), blocks)
            at = np.repeat(first - (np.cumsum(blocks) - blocks) * u, blocks * u) + np.arange(int(blocks.sum()) * u)
            at = np.minimum(at, np.repeat(first + sizes - 1, blocks * u))  # the last block repeats its last shingle
            grid = np.ascontiguousarray(joined[at].reshape(-1, u).T)
            step = max(1, (1 << 16) // u)
            for lo in range(0, grid.shape[1], step):
                hi = min(grid.shape[1], lo + step + 1)  # one block more, for the window that reaches over
                part, who = np.ascontiguousarray(grid[:, lo:hi]), owner[lo:hi]
                for (values, members, bits), m, x in zip(lists, self.mul, self.xor, strict=True):
                    low = ((part ^ x) * m).min(axis=0)
                    pair = np.minimum(low[:-1], low[1:]) if len(low) > 1 else low
                    hit = np.flatnonzero(bits[pair >> np.uint32(16)])
                    if not len(hit):
                        continue
                    a, b = np.searchsorted(values, pair[hit], "left"), np.searchsorted(values, pair[hit], "right")
                    for h, p, q in zip(hit[a < b], a[a < b], b[a < b], strict=True):
                        for k in members[p:q]:
                            found.add((int(who[h]), int(k)))
                            if h + 1 < len(who):
                                found.add((int(who[h + 1]), int(k)))  # a window over a bound belongs to both texts
        return found

    def search(self, texts: list[str]) -> Iterator[tuple[int, int, int, int]]:
        """(index of text, item, its shingles, of which found)."""
        words = [words_of(t) for t in texts]
        full = [i for i, w in enumerate(words) if len(w) >= self.width]
        shingles = [shingle_hashes(words[i], self.width) for i in full]
        kept: dict[int, np.ndarray] = {}
        for d, k in sorted(self.candidates(shingles)):
            if d not in kept:
                kept[d] = np.unique(shingles[d])
            s, have = self.shingles[k], kept[d]
            n = int((have[np.minimum(np.searchsorted(have, s), len(have) - 1)] == s).sum())
            if n >= self.containment * len(s):
                yield full[d], k, len(s), n
        for length, wanted in self.short.items():
            keys = np.array(sorted(wanted), dtype=np.uint64)
            for i, w in enumerate(words):
                if len(w) >= length:
                    h = np.unique(shingle_hashes(w, length))
                    for x in keys[np.isin(keys, h)]:
                        for k in wanted[int(x)]:
                            yield i, k, 1, 1


def _write(batches: Iterator[pa.RecordBatch], folder: str, width: int, containment: float, hashes: int) -> Iterator[pa.RecordBatch]:
    """Over rows (part, item, text) sorted by part: the index of each part as a file. A repeated task writes the same file once more."""
    system, root = open_fs(folder)
    system.create_dir(root, recursive=True)
    now, rows = None, []

    def publish() -> pa.RecordBatch:
        own = f"{root}/{now}-{uuid.uuid4().hex}.tmp"
        with system.open_output_stream(own) as sink:
            pickle.dump(Items(rows, width, containment, hashes), sink, protocol=5)
        system.move(own, f"{root}/{now}")
        return pa.RecordBatch.from_arrays([pa.array([now], pa.int32())], names=["part"])

    release()
    for b in batches:
        for part, item, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if part != now and rows:
                yield publish()
                rows = []
            now = part
            rows.append((item, text))
    if rows:
        yield publish()


def _read(path: str) -> Items:
    """The index of a file; a worker keeps one at a time."""
    index = HELD.get(path)
    release()
    if index is None:
        system, where = open_fs(path)
        with system.open_input_stream(where) as source:
            index = pickle.load(source)
    HELD[path] = index
    return index


def find(df: DataFrame, items: DataFrame, *, width: int = 5, containment: float = 0.8, hashes: int = 64, group: int = 100_000, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """A row for each document and item found in it: doc_id, item_id, n_shingles, n_found, containment."""
    spark = ship(df.sparkSession)
    bench = pick(items, item_id, item_text)
    rounds = max(1, -(-bench.count() // (group // 2)))
    folder = f"{shared_dir(spark)}/decontam-{uuid.uuid4().hex}"
    part = F.pmod(F.xxhash64("doc_id", "text"), F.lit(rounds)).cast("int").alias("part")
    dealt = bench.select(part, "doc_id", "text").repartition(rounds, "part").sortWithinPartitions("part", "doc_id", "text")
    present = sorted(x.part for x in dealt.mapInArrow(lambda x: _write(x, folder, width, containment, hashes), "part int").collect())
    out = spark.createDataFrame([], SCHEMA)
    for r in present:

        def run(batches: Iterator[pa.RecordBatch], path=f"{folder}/{r}") -> Iterator[pa.RecordBatch]:
            index = _read(path)
            for b in sub_batches(batches, 4 << 20):
                ids = b.column(0).to_pylist()
                found = [(ids[i], index.ids[k], q, n, n / q) for i, k, q, n in index.search(b.column(1).to_pylist())]
                if found:
                    types = [pa.int64()] * 4 + [pa.float64()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), types, strict=True)], names=[x.split()[0] for x in SCHEMA.split(", ")])

        out = out.unionByName(pick(df, id_col, text_col).mapInArrow(run, SCHEMA))
    return out
