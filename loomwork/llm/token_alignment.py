"""Alignment of two tokenizers' ids over the same bytes, and how often ids of the one meet ids of the other.

Tokenizer A is a byte-level BPE file of the tokenizers library, B a sentencepiece model. A encodes a space and the text, B the text,
before which it adds that space itself. Both give tokens that tile the same bytes, so a tokenization is an array of byte ends:

* ``intervals`` takes the union of both arrays of ends. Each elementary interval between two cuts lies in one token of A and one of B, its
  owners, found by binary search: it is one overlap.
* Ends that both have close a group. The links of a group are all pairs of a token of A and a token of B in it.

A text is cut before each space that follows a character which is no white space. There both tokenizers begin a token, whatever stands
around: the chunks between are encoded, aligned and linked once a worker, and a text is a sequence of known chunks.

``align`` gives a row for each row of the table: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups. ``groups`` is the alignment
itself, ``a1,a2|b1;a3|b2,b3``: the ids of A and of B of each group, in order. The count of an id pair is the number of rows that hold it
linked; n_best is how many of a row's links have the highest count of their id of A, ties included, and count_sum sums the counts of its links.
``pair_counts`` gives the pairs: a, b, n_docs, best.

In the cluster: rows are dealt to buckets of about ``bucket_bytes`` of text. A first pass gives the distinct pairs of each bucket with their
number of rows; they are summed by pair, and the sums go back to the buckets that hold the pair. A second pass deals the texts to the same
buckets, where they meet the counts of their own bucket. Nothing is broadcast, and a task holds the pairs of its buckets alone.
The same rows must come from the table each time it is read; a pair without its count is an error.

Nulls: a null or empty text has no tokens, and all its figures are 0, its groups ''; so has a text that B writes otherwise (one with U+2581).
A null id is an id like others. Repeated rows each count and each give a row. Long texts take memory in proportion to their own length. Empty tables give no rows.
Extra columns are not read.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomwork.llm.textkit import Encoder, default_tokenizer, pick, run_hashes, settle, ship, sub_batches

#: Salts for rows that are equal in id and text: as many buckets share them.
SALTS = 61


def default_pieces() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def intervals(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of two rising arrays of ends with the same last end: the cuts, the owner of each interval in A and in B, and whether a group closes there."""
    cuts = np.union1d(ends_a, ends_b)
    in_a, in_b = np.searchsorted(ends_a, cuts), np.searchsorted(ends_b, cuts)
    return cuts, in_a, in_b, (ends_a[in_a] == cuts) & (ends_b[in_b] == cuts) if len(cuts) else np.zeros(0, bool)


def products(n_a: np.ndarray, n_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Group, place in A and place in B of every link of groups that hold n_a and n_b tokens."""
    n = n_a * n_b
    group = np.repeat(np.arange(len(n)), n)
    k = np.arange(len(group)) - np.repeat(np.cumsum(n) - n, n)
    return group, (np.cumsum(n_a) - n_a)[group] + k // n_b[group], (np.cumsum(n_b) - n_b)[group] + k % n_b[group]


def _byte_of() -> dict[str, int]:
    """How byte-level vocabularies write bytes: printable ones as themselves, the others in order from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Aligner:
    """Chunks by their 64-bit hashes, in a table of open addresses; what belongs to a chunk lies in flat arrays."""

    _kept: dict[tuple[str, str], Aligner] = {}
    #: Chunks remembered in a worker, some 200 bytes each; beyond that only those of the fuller half are kept that were used most.
    most = 400_000
    slots = 1 << 20
    #: Links of a group beyond which equal pairs are put together before they are written out.
    large = 4096
    _find, _insert = Encoder._find, Encoder._insert

    def __init__(self, path_a: str, path_b: str) -> None:
        import sentencepiece
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        os.environ.setdefault("RAYON_NUM_THREADS", "1")
        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        byte = _byte_of()
        vocabulary = self.a.get_vocab(with_added_tokens=False)
        self.bytes_a = [b""] * (max(vocabulary.values(), default=-1) + 1)
        for token, i in vocabulary.items():
            self.bytes_a[i] = bytes(byte[c] for c in token)
        self.bytes_b = [bytes([int(self.b.id_to_piece(i)[3:5], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace("▁", " ").encode() for i in range(self.b.get_piece_size())]
        self.width_a, self.width_b = (np.array([len(x) for x in xs], dtype=np.int64) for xs in (self.bytes_a, self.bytes_b))
        self.shrunk = 0
        self._begin()

    @classmethod
    def of(cls, path_a: str, path_b: str) -> Aligner:
        if (path_a, path_b) not in cls._kept:
            cls._kept[path_a, path_b] = cls(path_a, path_b)
        return cls._kept[path_a, path_b]

    def _begin(self) -> None:
        self.keys, self.entry = np.zeros(self.slots, dtype=np.uint64), np.zeros(self.slots, dtype=np.int32)
        n = 1 << 16
        #: n_a, n_b, n_groups, n_links of each chunk; n_a is -1 where the bytes differ.
        self.sums = np.zeros((n, 4), dtype=np.int64)
        self.hash, self.uses, self.at, self.size = np.zeros(n, dtype=np.uint64), np.zeros(n, dtype=np.int32), np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int32)
        self.pair, self.times = np.zeros(1 << 18, dtype=np.int64), np.zeros(1 << 18, dtype=np.int64)
        self.words: list[str] = []
        self.used = 0

    def _make_room(self, coming: int) -> None:
        """Forgets rare chunks where there are too many, and widens the table where those that come need it. Entries change."""
        n = len(self.words)
        keep = np.arange(n)
        if n + coming > self.most:
            keep = np.sort(np.argsort(-self.uses[:n], kind="stable")[: max(0, min(self.most // 2, self.most - coming))])
            keep = keep[self.uses[keep] > 1]
            self.shrunk += 1
        while 2 * (len(keep) + coming) > self.slots:
            self.slots *= 2
        places, size = self.links(keep)
        words, hashes, sums, uses = [self.words[i] for i in keep.tolist()], self.hash[keep], self.sums[keep], self.uses[keep] // 2
        pair, times = self.pair[places], self.times[places]
        self._begin()
        self._store(hashes, words, sums, size, pair, times)
        self.uses[: len(keep)] = uses

    def _store(self, hashes: np.ndarray, words: list[str], sums: np.ndarray, size: np.ndarray, pair: np.ndarray, times: np.ndarray) -> None:
        known, n = len(self.words), len(words)

        def grown(v: np.ndarray, n: int) -> np.ndarray:
            while n > len(v):
                v = np.concatenate((v, np.zeros_like(v)))
            return v

        self.hash, self.uses, self.at, self.size, self.sums = (grown(v, known + n) for v in (self.hash, self.uses, self.at, self.size, self.sums))
        self.pair, self.times = grown(self.pair, self.used + len(pair)), grown(self.times, self.used + len(pair))
        entries = np.arange(known, known + n)
        self.hash[entries], self.at[entries], self.size[entries], self.sums[entries] = hashes, self.used + np.cumsum(size) - size, size, sums
        self.pair[self.used : self.used + len(pair)], self.times[self.used : self.used + len(pair)] = pair, times
        self.words += words
        self.used += len(pair)
        self._insert(hashes, entries.astype(np.int32))

    # ---- what is new

    def _encode_b(self, chunks: list[bytes]) -> list[list[int]]:
        """B puts a space before what is not empty; a single space after a text's last word is a piece of its own."""
        blank = [self.b.piece_to_id("▁")]
        return [ids if c != b" " else blank for c, ids in zip(chunks, self.b.encode([c.decode()[1:] for c in chunks], num_threads=1), strict=True)]

    def _ids(self, data: bytes, ends: np.ndarray, joins: np.ndarray, encode, width: np.ndarray, content: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all chunks, which lie in data up to ends, and how many each has: -1 where their bytes are others.

        Chunks that end before a cut (``joins``) are encoded some hundred in a text, the others alone.
        """
        begins = np.concatenate(([0], ends[:-1]))
        n = len(ends)
        first = np.flatnonzero(np.concatenate(([True], ~joins[1:] | ~joins[:-1])) | (np.arange(n) % 400 == 0)) if n else np.zeros(0, np.int64)
        last = np.append(first[1:], n)
        ids, count = [], np.full(n, -1, dtype=np.int64)

        def run(first: np.ndarray, last: np.ndarray) -> list[tuple[int, int]]:
            """Encodes the chunks of each stretch in one text; gives the stretches that do not come apart."""
            texts = [data[p:q] for p, q in zip(begins[first].tolist(), ends[last - 1].tolist(), strict=True)]
            failed = []
            for f, z, text, got in zip(first.tolist(), last.tolist(), texts, encode(texts), strict=True):
                flat = np.array(got, dtype=np.int64)
                upto, want = np.cumsum(width[flat]), ends[f:z] - begins[f]
                at = np.searchsorted(upto, want)
                if not len(upto) or at[-1] != len(upto) - 1 or (upto[at] != want).any() or b"".join(map(content.__getitem__, got)) != text:
                    failed.append((f, z))
                    continue
                count[f:z] = np.diff(at + 1, prepend=0)
                ids.append((f, flat))
            return failed

        again = [k for f, z in run(first, last) if z - f > 1 for k in range(f, z)]
        if again:
            run(np.array(again), np.array(again) + 1)
        return np.concatenate([x for _, x in sorted(ids, key=lambda x: x[0])] or [np.zeros(0, np.int64)]), count

    def _learn(self, hashes: np.ndarray, chunks: list[bytes]) -> None:
        data, lens = b"".join(chunks), np.fromiter(map(len, chunks), dtype=np.int64, count=len(chunks))
        ends, n = np.cumsum(lens), len(chunks)
        joins = _cut_after(np.frombuffer(data, dtype=np.uint8))[ends - 1] & (lens < 1000)
        ids_a, k_a = self._ids(data, ends, joins, lambda xs: [e.ids for e in self.a.encode_batch_fast([x.decode() for x in xs], add_special_tokens=False)], self.width_a, self.bytes_a)
        ids_b, k_b = self._ids(data, ends, joins, self._encode_b, self.width_b, self.bytes_b)
        good = (k_a >= 0) & (k_b >= 0)
        ids_a, ids_b = ids_a[np.repeat(good[k_a >= 0], k_a[k_a >= 0])], ids_b[np.repeat(good[k_b >= 0], k_b[k_b >= 0])]
        sums = np.zeros((n, 4), dtype=np.int64)
        sums[:, 0] = -1
        words, size, rows = [""] * n, np.zeros(n, dtype=np.int64), np.flatnonzero(good)
        if len(rows):
            cuts, in_a, in_b, shared = intervals(np.cumsum(self.width_a[ids_a]), np.cumsum(self.width_b[ids_b]))
            closes = np.flatnonzero(shared)
            n_a, n_b = np.diff(in_a[closes] + 1, prepend=0), np.diff(in_b[closes] + 1, prepend=0)
            # Chunks end at shared ends, so each group is of one chunk.
            owner = np.searchsorted(np.cumsum(lens[rows]), cuts[closes])
            sums[rows] = np.stack([np.bincount(owner, w, len(rows)).astype(np.int64) for w in (n_a, n_b, np.ones(len(owner)), n_a * n_b)], axis=1)
            big = n_a * n_b > self.large
            group, x, y = products(np.where(big, 0, n_a), np.where(big, 0, n_b))
            # Places count tokens of small groups alone: back to places among all tokens.
            small_a, small_b = np.flatnonzero(np.repeat(~big, n_a)), np.flatnonzero(np.repeat(~big, n_b))
            pair, times, of = ids_a[small_a[x]] << 32 | ids_b[small_b[y]], np.ones(len(x), dtype=np.int64), owner[group]
            first_a, first_b = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b
            for g in np.flatnonzero(big).tolist():
                (ua, ca), (ub, cb) = (np.unique(ids[f : f + m], return_counts=True) for ids, f, m in ((ids_a, first_a[g], n_a[g]), (ids_b, first_b[g], n_b[g])))
                pair, times = np.concatenate((pair, (ua[:, None] << 32 | ub).ravel())), np.concatenate((times, (ca[:, None] * cb).ravel()))
                of = np.concatenate((of, np.full(len(ua) * len(ub), owner[g])))
            if big.any():
                order = np.argsort(of, kind="stable")
                pair, times = pair[order], times[order]
            size[rows] = np.bincount(of, minlength=len(rows))
            text_a, text_b = list(map(str, ids_a.tolist())), list(map(str, ids_b.tolist()))
            parts = [
                (text_a[p] if k == 1 else ",".join(text_a[p : p + k])) + "|" + (text_b[q] if m == 1 else ",".join(text_b[q : q + m]))
                for p, k, q, m in zip(first_a.tolist(), n_a.tolist(), first_b.tolist(), n_b.tolist(), strict=True)
            ]
            z = np.searchsorted(owner, np.arange(len(rows) + 1)).tolist()
            for i, p, q in zip(rows.tolist(), z, z[1:], strict=False):
                words[i] = parts[p] if q == p + 1 else ";".join(parts[p:q])
        else:
            pair = times = np.zeros(0, dtype=np.int64)
        self._store(hashes, words, sums, size, pair, times)

    # ---- texts

    def chunks(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The entries of the chunks of all texts, one after the other, and where each text's begin (one bound more than texts)."""
        data = b"".join([b" " + t for t in texts])
        buf = np.frombuffer(data, dtype=np.uint8)
        begins = np.cumsum([0, *(len(t) + 1 for t in texts)])
        cut = np.zeros(len(buf) + 1, dtype=bool)
        cut[1:-1] = (buf[1:] == 32) & _cut_after(buf)[:-1]
        cut[begins] = True
        bounds = np.flatnonzero(cut)
        h = run_hashes(buf, bounds[:-1], bounds[1:]) | np.uint64(1)
        entry = self._find(h)
        new = np.flatnonzero(entry < 0)
        if len(new):
            known, at = np.unique(h[new], return_index=True)
            if len(self.words) + len(known) > min(self.most, self.slots // 2):
                self._make_room(len(known))
                entry = self._find(h)
                new = np.flatnonzero(entry < 0)
                known, at = np.unique(h[new], return_index=True)
                if 2 * (len(self.words) + len(known)) > self.slots:  # one very long text, of which much was forgotten
                    self._make_room(len(known))
                    entry = self._find(h)
                    new = np.flatnonzero(entry < 0)
                    known, at = np.unique(h[new], return_index=True)
            spot = new[at]
            todo = [data[p:q] for p, q in zip(bounds[spot].tolist(), bounds[spot + 1].tolist(), strict=True)]
            for k in range(0, len(todo), 50_000):
                self._learn(known[k : k + 50_000], todo[k : k + 50_000])
            entry[new] = self._find(h[new])
        times = np.bincount(entry, minlength=len(self.words))
        self.uses[: len(self.words)] += times.astype(np.int32)
        return entry, np.searchsorted(bounds, begins)

    def links(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``pair`` of the links of entries, one entry after the other, and how many each has."""
        n = self.size[entries]
        upto = np.cumsum(n)
        return np.repeat(self.at[entries] - (upto - n), n) + np.arange(upto[-1] if len(upto) else 0), n


def _cut_after(buf: np.ndarray) -> np.ndarray:
    """Whether a space after each byte surely follows a character that is no white space."""
    ok = (buf > 32) & (buf != 127)
    # Characters that may be white space begin with these bytes; some others of them are left uncut as well.
    ok[1:] &= ~((buf[1:] >= 128) & (buf[:-1] == 0xC2))
    lead = (buf == 0xE1) | (buf == 0xE2) | (buf == 0xE3)
    ok[2:] &= ~(lead[:-2] & (buf[2:] >= 128) & (buf[1:-1] >= 128))
    return ok


def _encoded(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    return [t.encode() for t in column.to_pylist()]


def _held(aligner: Aligner, entries: np.ndarray, z: list[int]) -> list[bool]:
    """Which texts have tokens: neither empty nor of other bytes."""
    bad = np.concatenate(([0], np.cumsum(aligner.sums[entries, 0] < 0)))
    return [bad[p] == bad[q] for p, q in zip(z, z[1:], strict=False)]


def _pairs(paths: tuple[str, str]):
    """(bucket, text) -> (bucket, pair, c): the pairs of each bucket in the task, with the number of its rows that hold them."""

    def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        pair, n = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(pair, kind="stable")
        pair, n = pair[order], n[order]
        first = np.flatnonzero(np.concatenate(([True], pair[1:] != pair[:-1]))) if len(pair) else np.zeros(0, np.int64)
        return pair[first], np.add.reduceat(n, first) if len(first) else n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner.of(*paths)
        found: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        held: dict[int, int] = {}
        for batch in sub_batches(batches, 2 << 20):
            texts = _encoded(batch.column(1))
            entries, starts = aligner.chunks(texts)
            z, fresh = starts.tolist(), {}
            has = _held(aligner, entries, z)
            for k, bucket in enumerate(batch.column(0).to_pylist()):
                if texts[k] and has[k]:
                    at, _ = aligner.links(np.unique(entries[z[k] : z[k + 1]]))
                    fresh.setdefault(bucket, []).append(np.unique(aligner.pair[at]))
            for bucket, parts in fresh.items():
                pair, n = np.unique(np.concatenate(parts), return_counts=True)
                found.setdefault(bucket, []).append((pair, n))
                held[bucket] = held.get(bucket, 0) + len(pair)
                if len(found[bucket]) > 1 and held[bucket] > 2 * max(1 << 20, len(found[bucket][0][0])):
                    found[bucket] = [merged(found[bucket])]
                    held[bucket] = len(found[bucket][0][0])
        for bucket, parts in found.items():
            pair, n = merged(parts)
            for k in range(0, len(pair), 100_000):
                p = pair[k : k + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(p), bucket)), pa.array(p), pa.array(n[k : k + 100_000])], names=["bucket", "pair", "c"])

    return run


_OUT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string"
_NAMES = [c.split()[0] for c in _OUT.split(", ")]


def _figures(paths: tuple[str, str]):
    """Over rows (bucket, doc_id, text, pair, n, best) in order of buckets, pairs (without text) first: a row for each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner.of(*paths)
        now: int | None = None
        waiting: list[tuple[np.ndarray, np.ndarray]] = []
        pairs = counts = np.zeros(0, dtype=np.int64)

        def texts_of(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = _encoded(batch.column(2))
            entries, starts = aligner.chunks(texts)
            z = starts.tolist()
            has = [bool(t) and h for t, h in zip(texts, _held(aligner, entries, z), strict=True)]
            good = np.concatenate([np.zeros(0, bool), *(np.full(q - p, h) for p, q, h in zip(z, z[1:], has, strict=False))])
            one, back = np.unique(entries[good], return_inverse=True)
            # What the counts make of each chunk, once a slice.
            at, n = aligner.links(one)
            want = aligner.pair[at]
            spot = np.searchsorted(pairs, want)
            if len(want) and (spot.max() >= len(pairs) or (pairs[spot] != want).any()):
                raise RuntimeError("the table gave other rows when it was read again")
            count, upto = counts[spot], np.concatenate(([0], np.cumsum(n)))
            sums = np.zeros((len(one), 6), dtype=np.int64)
            sums[:, :4] = aligner.sums[one]
            for k, v in ((4, (count & 1) * aligner.times[at]), (5, (count >> 1) * aligner.times[at])):
                total = np.concatenate(([0], np.cumsum(v)))
                sums[:, k] = total[upto[1:]] - total[upto[:-1]]
            total = np.zeros((len(entries) + 1, 6), dtype=np.int64)
            total[1:][good] = sums[back]
            np.cumsum(total, axis=0, out=total)
            rows = total[starts[1:]] - total[starts[:-1]]
            listed, word = entries.tolist(), aligner.words.__getitem__
            groups = [";".join(map(word, listed[p:q])) if h else "" for p, q, h in zip(z, z[1:], has, strict=False)]
            return pa.RecordBatch.from_arrays([batch.column(1), *(pa.array(rows[:, k]) for k in range(6)), pa.array(groups, pa.string())], names=_NAMES)

        for whole in batches:
            bucket = whole.column(0).to_numpy()
            is_text = whole.column(2).is_valid().to_numpy(zero_copy_only=False)
            bounds = [0, *(np.flatnonzero((bucket[1:] != bucket[:-1]) | (is_text[1:] != is_text[:-1])) + 1).tolist(), len(bucket)]
            for p, q in zip(bounds, bounds[1:], strict=False):
                if p == q:
                    continue
                part = whole.slice(p, q - p)
                if bucket[p] != now:
                    now, waiting = int(bucket[p]), []
                    pairs = counts = np.zeros(0, dtype=np.int64)
                if not is_text[p]:
                    waiting.append((part.column(3).to_numpy(), part.column(4).to_numpy() << 1 | part.column(5).to_numpy()))
                    continue
                if waiting:
                    pairs, counts = (np.concatenate(x) for x in zip(*waiting, strict=True))
                    order = np.argsort(pairs)
                    pairs, counts, waiting = pairs[order], counts[order], []
                for sub in sub_batches(iter([part]), 2 << 20):
                    yield texts_of(sub)

    return run


def _dealt(df: DataFrame, bucket_bytes: int, id_col: str, text_col: str) -> tuple[DataFrame, int]:
    docs = pick(df, id_col, text_col)
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // bucket_bytes))
    # Rows that are equal in id and text part by the partition that they are read in.
    salt = F.pmod(F.spark_partition_id(), F.lit(SALTS))
    return docs.withColumn("bucket", F.pmod(F.xxhash64("text", "doc_id", salt), F.lit(parts))), parts


def _bucket_pairs(docs: DataFrame, parts: int, paths: tuple[str, str]) -> DataFrame:
    return settle(docs.select("bucket", "text").repartition(parts, "bucket").mapInArrow(_pairs(paths), "bucket long, pair long, c long"))


def _summed(rows: DataFrame) -> DataFrame:
    """pair, n, best (0 or 1). An id of A meets no more ids than B has, so the window's groups are bounded."""
    n = rows.groupBy("pair").agg(F.sum("c").alias("n")).withColumn("a", F.shiftright("pair", 32))
    return n.withColumn("best", (F.col("n") == F.max("n").over(Window.partitionBy("a"))).cast("long")).drop("a")


def pair_counts(df: DataFrame, *, tokenizer: str | None = None, pieces: str | None = None, bucket_bytes: int = 32 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """a, b, n_docs, best: every id pair that some row holds linked."""
    ship(df.sparkSession)
    docs, parts = _dealt(df, bucket_bytes, id_col, text_col)
    pairs = _summed(_bucket_pairs(docs, parts, (tokenizer or default_tokenizer(), pieces or default_pieces())))
    return pairs.select(F.shiftright("pair", 32).alias("a"), F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF)).alias("b"), F.col("n").alias("n_docs"), (F.col("best") == 1).alias("best"))


def align(df: DataFrame, *, tokenizer: str | None = None, pieces: str | None = None, bucket_bytes: int = 32 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups of every row (see the module)."""
    ship(df.sparkSession)
    paths = (tokenizer or default_tokenizer(), pieces or default_pieces())
    docs, parts = _dealt(df, bucket_bytes, id_col, text_col)
    rows = _bucket_pairs(docs, parts, paths)
    counts = rows.select("bucket", "pair").join(_summed(rows), "pair")
    blank = F.lit(None)
    both = counts.select("bucket", blank.cast("long").alias("doc_id"), blank.cast("string").alias("text"), "pair", "n", "best").unionByName(
        docs.select("bucket", "doc_id", "text", *(blank.cast("long").alias(c) for c in ("pair", "n", "best")))
    )
    return both.repartition(parts, "bucket").sortWithinPartitions("bucket", F.col("text").isNotNull()).mapInArrow(_figures(paths), _OUT)


def digest(rows: DataFrame) -> DataFrame:
    """Rows of ``align`` with the groups as lower-case hex SHA-256, '' where there are none."""
    return rows.withColumn("groups_sha256", F.when(F.col("groups") == "", F.lit("")).otherwise(F.sha2("groups", 256))).drop("groups")
