"""Language-model scores by online logistic context mixing.

A text is coded as its UTF-8 bytes, A-Z lower-cased, and one zero byte as its end; each document is coded
on its own. A byte is a path of binary decisions in a Huffman tree over the training bytes, so frequent
bytes cost few decisions. Three predictors give each decision a probability, from how training text went on
after a hashed context: the last two bytes, the last four bytes, and the word so far. Their log odds enter a
logistic mixer whose weights are chosen by a gate (the depth in the tree, and whether training knew the word so far) and learn online inside each
document; an adaptive map, again per document, then refines the mixed probability.

The tables of contexts are bounded; the words are not. Every word of the training texts is kept with its count, and a
word with the separator after it has a probability twice: from its bits, and from the word's share of all tokens times the
separator's share of all separators. ``share`` of the latter and the rest of the former make a proper mixture, also where
no word comes. So what a text is scored by grows with the training texts. The score sums the log10 probabilities of all
words and lone separators; bits_per_byte is the total in bits over the bytes coded.

Learning in a document goes by blocks: decisions of a block use what the blocks before it taught, and
blocks grow from 256 to 4096 bytes, so that numpy codes many documents side by side.

The tables hold counts of all training texts. Context tables have a fixed size, a parameter (2**16,
2**17 and 2**18 contexts of 256 nodes, one byte each: 112 MB in a worker), so what is broadcast has a proven bound. Token
counts (for both scores) have no bound and stay in the cluster: tokens with at least a 262144th of all
occurrences are at most 262144 and broadcast; all others meet their counts in a shuffle join.

Nulls: a null text is an empty text, whose score is that of the end alone; a null doc_id is never held out.
Repeated rows get a row each. With no training text, counts are zero and every decision starts even.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.llm.textkit import lower_ascii, mix64, pick, power_tables, settle, ship, sub_batches

#: Context bits of the predictors: two bytes, four bytes, the word so far.
BITS = (16, 17, 18)
CHUNKS = 64
SCALE = 16.0
PRIOR = 0.1
PAD = 4
GATES = 8
#: Weights that every document starts with: where the word so far is unknown, and where it is known.
START = ((0.2, 0.9, 0.0), (0.15, 0.55, 0.4))
BUCKETS = 24
HOT = 1 << 18
SLOTS = 1 << 20
#: Weight of whole words against bits.
SHARE = 0.1
BLOCKS = (256, 256, 512, 1024, 2048)
LAST_BLOCK = 4096
#: Bytes scored at a time within a block.
SLICE = 1 << 15
_END_HASH = xxhash.xxh64_intdigest(b"\x00end")
_M = np.uint64(0x9E3779B97F4A7C15)


def contexts(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Coded bytes of all texts, how many each has, and each predictor's context of every coded byte."""
    buf = np.frombuffer(b"".join(b"\0" * PAD + t + b"\0" for t in texts), dtype=np.uint8)
    sizes = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
    coded = np.ones(len(buf), dtype=bool)
    first = np.cumsum(sizes + PAD) - (sizes + PAD)
    for k in range(PAD):
        coded[first + k] = False
    at = np.flatnonzero(coded)
    wide = buf.astype(np.uint32)
    b1, b2, b3, b4 = (wide[at - k] for k in (1, 2, 3, 4))
    two = ((b1 | b2 << np.uint32(8)) * np.uint32(40503)) & np.uint32(0xFFFF)
    four = (b1 | b2 << np.uint32(8) | b3 << np.uint32(16) | b4 << np.uint32(24)) * np.uint32(2654435761) >> np.uint32(32 - BITS[1])
    power, inverse = power_tables(len(buf) + 1)
    total = np.zeros(len(buf) + 1, dtype=np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * power[: len(buf)], out=total[1:])
    blank = (buf <= 32) & ((buf == 0) | (buf == 32) | (buf >= 9) & (buf <= 13))
    start = np.maximum.accumulate(np.where(blank, np.arange(1, len(buf) + 1), 0))[at - 1]
    word = (total[at] - total[start]) * inverse[start]
    word = ((word ^ word >> np.uint64(29)) * _M >> np.uint64(64 - BITS[2])).astype(np.uint32)
    return buf[at], sizes, [two, four, word]


def token_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the tokens of all texts (words, and one end a text), and how many each text has.

    A word's hash is a polynomial of its bytes, read off running sums: no word becomes an object of its own.
    """
    buf = np.frombuffer(b" " + b" ".join(texts) + b" ", dtype=np.uint8)
    sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    power, inverse = power_tables(len(buf) + 1)
    total = np.zeros(len(buf) + 1, dtype=np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * power[: len(buf)], out=total[1:])
    blank = (buf == 32) | ((buf >= 9) & (buf <= 13))
    starts = np.flatnonzero(blank[:-1] & ~blank[1:]) + 1
    ends = np.flatnonzero(~blank[:-1] & blank[1:]) + 1
    words = mix64((total[ends] - total[starts]) * inverse[starts])
    cuts = np.searchsorted(starts, np.cumsum(sizes + 1) + 1)
    n_tokens = np.diff(cuts, prepend=0) + 1
    tokens = np.full(int(n_tokens.sum()), np.uint64(_END_HASH))
    inner = np.ones(len(tokens), dtype=bool)
    inner[np.cumsum(n_tokens) - 1] = False
    tokens[inner] = words
    return tokens, n_tokens


def huffman(counts: np.ndarray) -> tuple[list[tuple[int, int]], list[list[tuple[int, int]]]]:
    """Children of each inner node (a leaf b as b, an inner node k as 256 + k), and each byte's path of (node, bit)."""
    heap = [(int(c) + 1, b) for b, c in enumerate(counts)]
    heapq.heapify(heap)
    children: list[tuple[int, int]] = []
    while len(heap) > 1:
        (x, a), (y, b) = heapq.heappop(heap), heapq.heappop(heap)
        children.append((a, b))
        heapq.heappush(heap, (x + y, 255 + len(children)))
    paths: list[list[tuple[int, int]]] = [[] for _ in range(256)]
    stack: list[tuple[int, list[tuple[int, int]]]] = [(254, [])]
    while stack:
        node, path = stack.pop()
        for bit, child in enumerate(children[node]):
            if child < 256:
                paths[child] = [*path, (node, bit)]
            else:
                stack.append((child - 256, [*path, (node, bit)]))
    return children, paths


def _train(docs: DataFrame) -> DataFrame:
    """(kind, part, n, data): for kind -1 the count n of byte part; by predictor and part of its contexts, the counts of (context, byte)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def counted(keys: list[list[np.ndarray]]) -> pa.RecordBatch:
            out: list[tuple[int, int, int | None, bytes | None]] = []
            for k in range(len(BITS)):
                key = np.sort(np.concatenate(keys[k]))
                keys[k] = []
                if k == 0:
                    histogram = np.bincount((key & np.uint32(255)).astype(np.uint8), minlength=256)
                    out += [(-1, int(b), int(histogram[b]), None) for b in np.flatnonzero(histogram)]
                first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
                n = np.diff(np.append(first, len(key))).astype("<u4")
                key = key[first].astype("<u4")
                width = np.uint32((1 << BITS[k] + 8) // CHUNKS)
                cuts = np.searchsorted(key, np.arange(CHUNKS + 1, dtype=np.uint64) * width)
                for p in range(CHUNKS):
                    if cuts[p] < cuts[p + 1]:
                        part = slice(cuts[p], cuts[p + 1])
                        steps = np.diff(key[part], prepend=np.uint32(p) * width).astype("<u4")
                        out.append((k, p, None, pa.compress(steps.tobytes() + n[part].tobytes(), codec="zstd", asbytes=True) + len(steps).to_bytes(4, "little")))
            cols = list(zip(*out, strict=True))
            types = (pa.int32(), pa.int32(), pa.int64(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["kind", "part", "n", "data"])

        keys: list[list[np.ndarray]] = [[] for _ in BITS]
        size = 0
        for b in sub_batches(batches, 1 << 20):
            coded, _, ctx = contexts([lower_ascii(t.encode("utf-8", "surrogatepass")) for t in b.column(1).to_pylist()])
            for k, c in enumerate(ctx):
                keys[k].append(c << np.uint32(8) | coded)
            size += len(coded)
            if size > 4 << 20:
                yield counted(keys)
                keys, size = [[] for _ in BITS], 0
        if size:
            yield counted(keys)

    return docs.mapInArrow(run, "kind int, part int, n long, data binary")


def _merge(parts: DataFrame, children: list[tuple[int, int]]) -> DataFrame:
    """(kind, part, table): log odds of every node after every context of the part, as compressed signed bytes."""
    n = int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for b in batches:
            for kind, part, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
                size = int.from_bytes(data[-4:], "little")
                raw = pa.decompress(data[:-4], decompressed_size=size * 8, codec="zstd", asbytes=True)
                width = (1 << BITS[kind] + 8) // CHUNKS
                if (kind, part) not in sums:
                    sums[kind, part] = np.zeros(width, dtype=np.int64)
                sums[kind, part][np.cumsum(np.frombuffer(raw, "<u4", size), dtype=np.int64)] += np.frombuffer(raw, "<u4", size, size * 4)
        for (kind, part), c in sums.items():
            bytes_ = c.reshape(-1, 256)
            inner = np.zeros((255, len(bytes_)), dtype=np.int64)
            table = np.zeros((len(bytes_), 256), dtype=np.int8)
            for node, (x, y) in enumerate(children):
                zero, one = (bytes_[:, z] if z < 256 else inner[z - 256] for z in (x, y))
                inner[node] = zero + one
                table[:, node] = np.clip(np.rint(np.log((one + PRIOR) / (zero + PRIOR)) * SCALE), -127, 127)
            yield pa.RecordBatch.from_arrays([pa.array([kind], pa.int32()), pa.array([part], pa.int32()), pa.array([pa.compress(table.tobytes(), codec="zstd", asbytes=True)], pa.binary())], names=["kind", "part", "table"])

    return parts.filter("kind >= 0").select("kind", "part", "data").repartition(n, "kind", "part").mapInArrow(run, "kind int, part int, table binary")


class Model:
    """Tables and tree; log10 probabilities of texts."""

    def __init__(self, paths: list[list[tuple[int, int]]], tables: dict[tuple[int, int], bytes], weights: tuple, rate: float, refine: float) -> None:
        self.length = np.array([len(p) for p in paths], dtype=np.int64)
        self.start = np.concatenate(([0], np.cumsum(self.length)[:-1]))
        flat = [x for p in paths for x in p]
        self.node = np.array([n for n, _ in flat], dtype=np.int64)
        self.bit = np.array([b for _, b in flat], dtype=np.float32)
        self.gate = np.array([2 * min(d, GATES // 2 - 1) for p in paths for d in range(len(p))], dtype=np.int64)
        self.tables = []
        for k, bits in enumerate(BITS):
            t, width = np.zeros(1 << bits + 8, dtype=np.int8), (1 << bits + 8) // CHUNKS
            for p in range(CHUNKS):
                if (k, p) in tables:
                    t[p * width : (p + 1) * width] = np.frombuffer(pa.decompress(tables[k, p], decompressed_size=width, codec="zstd", asbytes=True), dtype=np.int8)
            self.tables.append(t)
        self.weights, self.rate, self.refine = weights, rate, refine

    def log10(self, texts: list[bytes]) -> np.ndarray:
        """Of whole texts, by the bits alone."""
        unit_doc, _, _, nats = self.unit_nats(texts)
        return np.bincount(unit_doc, nats, minlength=len(texts)) / math.log(10)

    def unit_nats(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each unit in the order of the texts: its document, whether it holds a word, the byte that ends it, and its log probability.

        A unit ends with a separator or a text's end: a word and the byte after it, or such a byte alone.
        """
        coded, sizes, ctx = contexts(texts)
        ends = (coded == 32) | (coded >= 9) & (coded <= 13)
        ends[np.cumsum(sizes) - 1] = True
        last = np.flatnonzero(ends)
        unit = np.cumsum(ends, dtype=np.int32) - ends  # a batch has under 2**31 bytes
        word = np.diff(last, prepend=-1) > 1
        owner = np.searchsorted(np.cumsum(sizes), last, side="right")
        return owner, word, coded[last], self._bits(coded, sizes, ctx, unit, len(last))

    def _bits(self, coded: np.ndarray, sizes: np.ndarray, ctx: list[np.ndarray], unit: np.ndarray, n_units: int) -> np.ndarray:
        first = np.cumsum(sizes) - sizes
        n = len(sizes)
        nats = np.zeros(n_units)
        w = np.tile(np.array(self.weights, dtype=np.float32).T, (1, n * GATES // 2))
        centre = (np.arange(BUCKETS, dtype=np.float32) - (BUCKETS - 1) / 2) * np.float32(0.75)
        curve = np.tile(1 / (1 + np.exp(-centre)), n).astype(np.float32)
        done, r = 0, 0
        left = np.arange(n)
        while len(left):
            size = BLOCKS[r] if r < len(BLOCKS) else LAST_BLOCK
            take = np.minimum(sizes[left] - done, size)
            pos = np.repeat(first[left] + done - (np.cumsum(take) - take), take) + np.arange(take.sum())
            self._block(coded, ctx, unit, pos, np.repeat(left, take), w, curve, nats, n)
            done, r = done + size, r + 1
            left = left[sizes[left] > done]
        return nats

    def _block(self, coded: np.ndarray, ctx: list[np.ndarray], unit: np.ndarray, pos: np.ndarray, doc: np.ndarray, w: np.ndarray, curve: np.ndarray, nats: np.ndarray, n: int) -> None:
        """Scores a block with what the blocks before it taught, a slice that fits the caches at a time, then learns from it."""
        scaled = w * np.float32(1 / SCALE)
        counts = np.zeros(2 * len(curve), dtype=np.int64)
        slope = np.zeros(w.shape)
        for i in range(0, len(pos), SLICE):
            self._slice(coded, ctx, unit, pos[i : i + SLICE], doc[i : i + SLICE], scaled, curve, nats, counts, slope)
        both = counts.reshape(-1, 2)
        hits = both.sum(axis=1)
        curve += ((both[:, 1] - hits * curve) / (hits + self.refine)).astype(np.float32)
        np.clip(curve, 1e-4, 1 - 1e-4, out=curve)
        seen = np.repeat(hits.reshape(n, BUCKETS).sum(axis=1) / GATES, GATES)
        w += (self.rate / SCALE / np.maximum(np.sqrt(seen), 1) * slope).astype(np.float32)
        np.clip(w, -0.5, 2.0, out=w)

    def _slice(self, coded: np.ndarray, ctx: list[np.ndarray], unit: np.ndarray, pos: np.ndarray, doc: np.ndarray, scaled: np.ndarray, curve: np.ndarray, nats: np.ndarray, counts: np.ndarray, slope: np.ndarray) -> None:
        # Indices are all within bounds: mode="clip" only spares numpy a check and a copy.
        b = coded.take(pos)
        length = self.length.take(b)
        ends = np.cumsum(length)
        which = np.repeat(np.arange(len(pos)), length)
        begins = ends - length
        flat = (self.start.take(b) - begins).take(which, mode="clip")
        flat += np.arange(len(flat))
        node, bit = self.node.take(flat, mode="clip"), self.bit.take(flat, mode="clip")
        odds = []
        for c, table in zip(ctx, self.tables, strict=True):
            at = (c.take(pos).astype(np.int64) << 8).take(which, mode="clip")
            at += node
            odds.append(table.take(at, mode="clip"))
        low = int(doc[0])  # documents of a slice follow each other
        owner = (doc - low).take(which, mode="clip")
        gate = owner * GATES
        gate += self.gate.take(flat, mode="clip")
        gate += odds[-1] != 0
        n = int(doc[-1]) - low + 1
        here = slice(low * GATES, (low + n) * GATES)
        mixed = scaled[0, here].take(gate, mode="clip")
        mixed *= odds[0]
        for k in range(1, len(odds)):
            part = scaled[k, here].take(gate, mode="clip")
            part *= odds[k]
            mixed += part
        np.clip(mixed, -9, 9, out=mixed)
        p = np.exp(-mixed)
        p += 1
        np.reciprocal(p, out=p)
        mixed *= np.float32(1 / 0.75)
        mixed += np.float32(BUCKETS / 2)  # truncation below rounds to the nearest centre
        np.minimum(mixed, np.float32(BUCKETS - 0.5), out=mixed)
        owner *= BUCKETS
        owner += mixed.astype(np.int32)
        q = curve[low * BUCKETS : (low + n) * BUCKETS].take(owner, mode="clip")
        q *= np.float32(0.25)
        q += p * np.float32(0.75)
        q += bit
        q -= 1  # of the bit that came, but for the sign
        np.abs(q, out=q)
        np.log(q, out=q)
        u = unit.take(pos)
        new = np.flatnonzero(np.diff(u, prepend=-1))  # a unit lies in one run of a slice
        nats[u[new]] += np.add.reduceat(q, begins[new], dtype=np.float64)
        # What this slice teaches the next block.
        owner *= 2
        owner += bit > 0
        counts[2 * low * BUCKETS : 2 * (low + n) * BUCKETS] += np.bincount(owner, minlength=2 * n * BUCKETS)
        np.subtract(bit, p, out=p)
        for k, s in enumerate(odds):
            slope[k, here] += np.bincount(gate, s * p, minlength=n * GATES)


def _token_counts(train: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def counted() -> pa.RecordBatch:
            h, c = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c.astype(np.int64))], names=["h", "c"])

        for b in sub_batches(batches, 1 << 20):
            held.append(token_hashes([lower_ascii(t.encode("utf-8", "surrogatepass")) for t in b.column(1).to_pylist()])[0])
            size += len(held[-1])
            if size > 4_000_000:
                yield counted()
                held, size = [], 0
        if held:
            yield counted()

    return train.mapInArrow(run, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


def score(df: DataFrame, *, folds: int = 10, held_fold: int = 0, weights: tuple = START, rate: float = 0.01, refine: float = 30.0, share: float = SHARE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte of every row.

    Rows whose crc32 of the id's text, modulo folds, is held_fold are never learned from.
    """
    spark = ship(df.sparkSession)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds == held_fold, F.lit(False))
    docs = pick(df, id_col, text_col)
    train = docs.filter(~held)

    counts = settle(_token_counts(train))
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    hot = counts.filter(F.col("c") >= max(1, -(-total // HOT))).collect()  # at most HOT rows
    hot_h = np.array([r[0] for r in hot], dtype=np.int64).view(np.uint64)
    hot_c = np.array([r[1] for r in hot], dtype=np.int64)
    order = np.argsort(hot_c, kind="stable")  # of two tokens in one slot the more frequent one stays
    slot_key, slot_c = np.zeros(SLOTS, dtype=np.uint64), np.zeros(SLOTS, dtype=np.int64)
    place = (hot_h[order] % np.uint64(SLOTS)).astype(np.int64)
    slot_key[place], slot_c[place] = hot_h[order], hot_c[order]

    parts = settle(_train(train))
    histogram = np.zeros(256, dtype=np.int64)
    for byte, n in parts.filter("kind < 0").groupBy("part").agg(F.sum("n")).collect():
        histogram[byte] = n
    children, paths = huffman(histogram)
    tables = {(k, p): bytes(t) for k, p, t in _merge(parts, children).collect()}
    shared = spark.sparkContext.broadcast((paths, tables, slot_key, slot_c))
    blanks = np.zeros(256)
    blanks[[0, *range(9, 14), 32]] = histogram[[0, *range(9, 14), 32]] + 1.0
    blanks /= blanks.sum()
    floor = math.log10(0.1 / (total + 0.1 * (distinct + 1)))
    bottom = total + 0.1 * (distinct + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        paths, tables, key, c = shared.value
        model = Model(paths, tables, weights, rate, refine)  # a task's own: idle workers should hold no tables
        logs = np.where(c > 0, np.log10((c + 0.1) / bottom), 0.0)
        with np.errstate(divide="ignore"):
            whole = np.log(c / max(1, total))
            after = np.log(blanks) + math.log(share)
        names = ["rk", "h", "lead", "doc_id", "n_tokens", "known", "base", "score", "n_bytes"]
        for b in sub_batches(batches, 1 << 19):
            ids, texts = b.column(0), b.column(1).to_pylist()
            data = [t.encode("utf-8", "surrogatepass") for t in texts]
            low = [lower_ascii(t) for t in data]
            unit_doc, word, mark, nats = model.unit_nats(low)
            nats += math.log1p(-share)
            rk = np.array([xxhash.xxh64_intdigest(t) for t in data], dtype=np.uint64).view(np.int64)
            tokens, n_tokens = token_hashes(low)
            owner = np.repeat(np.arange(len(ids)), n_tokens)
            at = (tokens % np.uint64(SLOTS)).astype(np.int64)
            known = (key.take(at) == tokens) & (c.take(at) > 0)
            # Words, in order, are the units with one; texts' ends lie between them. A word's lead is what its count has to make up for.
            is_word = np.ones(len(tokens), dtype=bool)
            is_word[np.cumsum(n_tokens) - 1] = False
            lead = np.full(len(tokens), -np.inf)
            lead[is_word] = after[mark[word]] - nats[word]
            gain = np.logaddexp(0.0, lead + whole.take(at))
            scores = (np.bincount(unit_doc, nats, minlength=len(ids)) + np.bincount(owner, np.where(known, gain, 0.0), minlength=len(ids))) / math.log(10)
            sums = np.bincount(owner, np.where(known, logs.take(at), 0.0), minlength=len(ids))
            hot = np.bincount(owner, known, minlength=len(ids)).astype(np.int64)
            # Rows of documents meet no count; they are spread, also where many have one text.
            spread = mix64(rk.view(np.uint64) ^ (ids.fill_null(-1).to_numpy().view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) + np.arange(len(ids), dtype=np.uint64)).view(np.int64)
            cols = [rk, spread, pa.nulls(len(ids), pa.float32()), ids, n_tokens, hot, sums, scores, np.array([len(t) + 1 for t in data])]
            types = [pa.int64(), pa.int64(), pa.float32(), *[pa.int64()] * 3, pa.float64(), pa.float64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, t) for x, t in zip(cols, types, strict=True)], names=names)
            # Tokens that are not hot meet their counts in the cluster, a row each.
            cold = np.flatnonzero(~known)
            if len(cold):
                none = [pa.nulls(len(cold), t) for t in types[4:]]
                yield pa.RecordBatch.from_arrays([pa.array(rk[owner[cold]]), pa.array(tokens[cold].view(np.int64)), pa.array(lead[cold].astype(np.float32)), ids.take(pa.array(owner[cold])), *none], names=names)

    rows = docs.mapInArrow(run, "rk long, h long, lead float, doc_id long, n_tokens long, known long, base double, score double, n_bytes long")
    met = rows.join(counts, "h", "left")
    term = F.when(F.col("c").isNull(), F.lit(floor)).otherwise(F.log10((F.col("c") + 0.1) / F.lit(bottom)))
    met_c, far = F.when(F.col("lead").isNotNull(), F.col("c")), F.col("lead") + F.log(F.col("c") / total)
    gain = F.when(far > 30, far).otherwise(F.log1p(F.exp(far)))  # beyond 30 the one does not count
    # Rows of one id (or none) and one text are counted, their sums divided, and each gets its row again.
    by = met.groupBy("doc_id", "rk").agg(
        F.count("n_tokens").alias("m"), F.max("n_tokens").alias("n_tokens"), F.max("known").alias("hot"), F.max("base").alias("hot_base"), F.max("score").alias("score"), F.max("n_bytes").alias("n_bytes"),
        F.count(met_c).alias("cold"), F.coalesce(F.sum(F.when(F.col("lead").isNotNull(), term)), F.lit(0.0)).alias("cold_base"), F.coalesce(F.sum(F.when(met_c.isNotNull(), gain)), F.lit(0.0)).alias("gain"),
    )
    score = F.col("score") + F.col("gain") / F.col("m") / math.log(10)
    return by.select(
        "doc_id", held.alias("held_out"), "n_tokens", (F.col("hot") + (F.col("cold") / F.col("m")).cast("long")).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("hot_base") + F.col("cold_base") / F.col("m")).alias("base_score"), score.alias("score"), (-score * math.log2(10) / F.col("n_bytes")).alias("bits_per_byte"),
        F.explode(F.sequence(F.lit(1), F.col("m").cast("int"))).alias("copy"),
    ).drop("copy")
