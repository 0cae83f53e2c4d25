"""What several operators share: words, hashes, batches, the token encoder and the shared folder.

Words are maximal runs of characters outside space and the controls 9 to 13; ``lower_ascii`` folds A-Z
only. Null texts count as empty texts everywhere.
"""

from __future__ import annotations

import os
import re
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.functions.session import settle, shared_dir, tidy  # noqa: F401  (the operators take them from here)

WORD = r"[^\x20\x09-\x0D]+"
MASK64 = (1 << 64) - 1
_FOLD = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_ROOT = Path(__file__).resolve().parents[2]


def ship(spark: SparkSession) -> SparkSession:
    """Makes this package importable on the executors where their PYTHONPATH lacks it."""
    seen = [os.path.abspath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if str(_ROOT) not in seen and os.getcwd() != str(_ROOT) and not getattr(spark, "_loomwork_shipped", False):
        folder = Path(os.environ.get("TMPDIR", "/tmp")) / f"loomwork-{uuid.uuid4().hex}"
        folder.mkdir(parents=True)
        with zipfile.ZipFile(folder / "loomwork_pkg.zip", "w") as z:
            for p in sorted((_ROOT / "loomwork").rglob("*.py")):
                z.write(p, p.relative_to(_ROOT))
        spark.sparkContext.addPyFile(str(folder / "loomwork_pkg.zip"))
        spark._loomwork_shipped = True
    return spark


def pick(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns an operator reads, as doc_id and text; whatever else the table holds stays out."""
    return df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))


def sub_batches(batches: Iterator[pa.RecordBatch], most_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of at most about most_bytes, so that a batch of very long texts stays small in memory."""
    for b in batches:
        n = b.num_rows
        if not n:
            continue
        step = max(1, int(n * most_bytes / max(1, b.nbytes)))
        for i in range(0, n, step):
            yield b.slice(i, step)


def lower_ascii(data: bytes) -> bytes:
    return data.translate(_FOLD)


def ascii_words(text: str) -> list[bytes]:
    """Lower-cased words as UTF-8; bytes.split() parts at exactly the six separators."""
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split()


class WordHashes(dict):
    """word -> 64-bit hash, remembered while the vocabulary stays under ``most`` entries."""

    most = 400_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


_HASHES = WordHashes()
#: What a worker has read from the shared folder and may need again.
HELD: dict[str, object] = {}


def release() -> None:
    """Workers are reused: one that begins other work gives back what it remembered."""
    Encoder.release()
    _HASHES.clear()
    HELD.clear()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_HASHES.__getitem__, words), dtype=np.uint64, count=len(words))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(h: np.ndarray, width: int) -> np.ndarray:
    """64-bit hashes of the runs of ``width`` words; a shorter sequence is one shingle, an empty one none."""
    if not len(h):
        return h
    width = min(width, len(h))
    out = np.zeros(len(h) - width + 1, dtype=np.uint64)
    for j in range(width):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[j : j + len(out)]
    return mix64(out)


_ODD = np.uint64(0x9E3779B97F4A7C15)
_ODD_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd number and of its inverse, modulo 2**64."""
    if len(_powers[0]) < n:
        for k, m in enumerate((_ODD, _ODD_INVERSE)):
            p = np.full(n + (1 << 18), m, dtype=np.uint64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0][:n], _powers[1][:n]


def run_hashes(values: np.ndarray, first: np.ndarray, last: np.ndarray, span: int = 1 << 20) -> np.ndarray:
    """64-bit hashes of values[first:last] for each pair, read off running sums: a polynomial of the values, mixed.

    Runs come in order and do not overlap. Sums cover about span values at a time, so the tables are no longer than that or the longest run.
    """
    out, at = np.empty(len(first), dtype=np.uint64), 0
    while at < len(first):
        low = int(first[at])
        to = max(at + 1, int(np.searchsorted(last, low + span, side="right")))
        part = values[low : int(last[to - 1])].astype(np.uint64)
        part += np.uint64(1)
        power, inverse = power_tables(len(part) + 1)
        part *= power[: len(part)]
        total = np.zeros(len(part) + 1, dtype=np.uint64)
        np.cumsum(part, out=total[1:])
        a, z = first[at:to] - low, last[at:to] - low
        out[at:to] = mix64((total[z] - total[a]) * inverse[a] + (z - a).astype(np.uint64))
        at = to
    return out


def token_bounds(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and end of each word in bytes that begin and end with a blank."""
    blank = (buf == 32) | ((buf >= 9) & (buf <= 13))
    return np.flatnonzero(blank[:-1] & ~blank[1:]) + 1, np.flatnonzero(~blank[:-1] & blank[1:]) + 1


# ---------------------------------------------------------------------------------------------------
# Byte-level BPE through the tokenizers library. Its pieces never cross the bounds that the vocabulary's
# pattern sets, so ids of a piece may be remembered: that saves most of the library's work on running text.

# Classes of bytes: what parts texts, letters, digits, blanks, all others.
_PART, _LETTER, _DIGIT_, _BLANK, _OTHER = range(5)
_CLASS = np.full(256, _OTHER, dtype=np.uint8)
_CLASS[0] = _PART
_CLASS[[9, 10, 13, 32]] = _BLANK
_CLASS[48:58] = _DIGIT_
_CLASS[65:91] = _CLASS[97:123] = _CLASS[128:256] = _LETTER


def pieces(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and end of each piece, by the byte-level pattern, in texts of plain characters (see Encoder) that begin and end with a zero byte.

    The pattern's rules: 's 't 'm 'd 'll 've 're by themselves; a run of letters, of digits or of others takes one space before it;
    of several blanks before such a run all but the last are one piece.
    """
    kind = _CLASS[buf]
    signs = np.flatnonzero((buf[:-1] == 0xC3) & ((buf[1:] == 0x97) | (buf[1:] == 0xB7)))  # the two signs among the letters
    kind[signs] = kind[signs + 1] = _OTHER
    cut = np.empty(len(buf) + 1, dtype=bool)
    cut[0] = cut[-1] = True
    np.not_equal(kind[1:], kind[:-1], out=cut[1:-1])
    # Ends of runs of blanks that something other than a text's end follows.
    ends = np.flatnonzero((kind[:-1] == _BLANK) & cut[1:-1]) + 1
    ends = ends[kind[ends] != _PART]
    cut[ends - 1] = True
    cut[ends[buf[ends - 1] == 32]] = False
    # Contractions: an apostrophe that begins a piece, and the letters after it.
    at = np.flatnonzero((buf[:-2] == 39) & cut[:-3] & (kind[1:-1] == _LETTER))
    x, y = buf[at + 1], buf[at + 2]
    one = (x == 115) | (x == 116) | (x == 109) | (x == 100)
    two = ((x == 108) & (y == 108)) | (((x == 118) | (x == 114)) & (y == 101))
    cut[at[one | two] + 1] = False
    cut[at[one] + 2] = True
    cut[at[two] + 3] = True
    bounds = np.flatnonzero(cut)
    first, last = bounds[:-1], bounds[1:]
    real = kind[first] != _PART
    return first[real], last[real]


class Encoder:
    """encode(texts) -> for each text its ids as little-endian unsigned 32-bit integers, as the library gives them.

    Texts whose characters this module and the library may class apart (outside the letters, digits, punctuation and
    blanks below U+0250), and texts with an added token's content, go to the library whole. Pieces are known by 64-bit hashes, in
    a table of open addresses; their ids lie one after the other in an array.
    """

    _kept: dict[str, Encoder] = {}
    #: Pieces remembered in a worker, some 60 bytes each; the memory starts anew beyond that.
    most = 1_200_000
    slots = 1 << 22

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.added = [t.content for t in self.lib.get_added_tokens_decoder().values()]
        self.plain = re.compile(r"[\t\n\r\x20-\x7e\xc0-\u024f]*\Z")
        vocabulary = self.lib.get_vocab(with_added_tokens=False)
        #: Bytes of each id: a byte-level vocabulary writes a byte as a character.
        self.width = np.zeros(max(vocabulary.values(), default=0) + 1, dtype=np.int64)
        for token, i in vocabulary.items():
            self.width[i] = len(token)
        self._begin()

    def _begin(self) -> None:
        self.keys, self.entry = np.zeros(self.slots, dtype=np.uint64), np.zeros(self.slots, dtype=np.int32)
        self.at, self.size = np.zeros(1 << 16, dtype=np.int64), np.zeros(1 << 16, dtype=np.int32)
        self.store, self.n, self.used = np.zeros(1 << 18, dtype="<u4"), 0, 0

    @classmethod
    def release(cls) -> None:
        """Workers are reused: one that does other work gives the remembered pieces back."""
        cls._kept.clear()

    @classmethod
    def of(cls, path: str) -> Encoder:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        os.environ.setdefault("RAYON_NUM_THREADS", "1")
        if path not in cls._kept:
            cls._kept[path] = cls(path)
        return cls._kept[path]

    def _find(self, h: np.ndarray) -> np.ndarray:
        """The entry of each hash, -1 where there is none."""
        out, todo, slot = np.full(len(h), -1, dtype=np.int32), np.arange(len(h)), (h & np.uint64(self.slots - 1)).astype(np.int64)
        while len(todo):
            key = self.keys[slot]
            hit = key == h[todo]
            out[todo[hit]] = self.entry[slot[hit]]
            on = ~hit & (key != 0)
            todo, slot = todo[on], (slot[on] + 1) & (self.slots - 1)
        return out

    def _insert(self, h: np.ndarray, entries: np.ndarray) -> None:
        todo, slot = np.arange(len(h)), (h & np.uint64(self.slots - 1)).astype(np.int64)
        while len(todo):
            free = np.flatnonzero(self.keys[slot] == 0)
            taken, first = np.unique(slot[free], return_index=True)
            won = free[first]
            self.keys[taken], self.entry[taken] = h[todo[won]], entries[todo[won]]
            left = np.ones(len(todo), dtype=bool)
            left[won] = False
            todo, slot = todo[left], (slot[left] + 1) & (self.slots - 1)

    def _learn(self, h: np.ndarray, texts: list[bytes]) -> None:
        """Adds pieces that are new, by the library."""
        word = [t[0] == 32 and t[1:].isalpha() for t in texts]
        runs = [i for i, w in enumerate(word) if w]
        others = [i for i, w in enumerate(word) if not w]
        ids: list[np.ndarray] = [np.zeros(0, "<u4")] * len(texts)
        # Words with a leading blank stay apart when written one after the other; the bytes of the ids say where each ends.
        parts = [runs[i : i + 500] for i in range(0, len(runs), 500)]
        for part, e in zip(parts, self.lib.encode_batch_fast([b"".join([texts[i] for i in p]).decode() for p in parts], add_special_tokens=False), strict=True):
            got = np.array(e.ids, dtype="<u4")
            upto = np.cumsum(self.width[np.minimum(got, len(self.width) - 1)])
            ends = np.cumsum([len(texts[i]) for i in part])
            last = np.searchsorted(upto, ends)
            if not len(upto) or last[-1] >= len(upto) or (upto[last] != ends).any():
                others += part
                continue
            for i, x in zip(part, np.split(got, last[:-1] + 1), strict=True):
                ids[i] = x
        for i, e in zip(others, self.lib.encode_batch_fast([texts[i].decode() for i in others], add_special_tokens=False), strict=True):
            ids[i] = np.array(e.ids, dtype="<u4")
        sizes = np.fromiter(map(len, ids), dtype=np.int32, count=len(ids))
        flat = np.concatenate(ids)
        while self.n + len(ids) > len(self.at):
            self.at, self.size = np.concatenate((self.at, np.zeros_like(self.at))), np.concatenate((self.size, np.zeros_like(self.size)))
        while self.used + len(flat) > len(self.store):
            self.store = np.concatenate((self.store, np.zeros_like(self.store)))
        self.store[self.used : self.used + len(flat)] = flat
        entries = np.arange(self.n, self.n + len(ids))
        self.at[entries], self.size[entries] = self.used + np.cumsum(sizes) - sizes, sizes
        self._insert(h, entries.astype(np.int32))
        self.n, self.used = self.n + len(ids), self.used + len(flat)

    def _encode(self, texts: list[bytes]) -> list[bytes]:
        data = b"\0" + b"\0".join(texts) + b"\0"
        buf = np.frombuffer(data, dtype=np.uint8)
        first, last = pieces(buf)
        h = run_hashes(buf, first, last) | np.uint64(1)
        entry = self._find(h)
        new = np.flatnonzero(entry < 0)
        if len(new):
            known, at = np.unique(h[new], return_index=True)
            if self.n + len(known) > self.most:
                self._begin()
                new, (known, at) = np.arange(len(h)), np.unique(h, return_index=True)
            spot = new[at]
            self._learn(known, [data[a:z] for a, z in zip(first[spot].tolist(), last[spot].tolist(), strict=True)])
            entry[new] = self._find(h[new])
        size = self.size[entry]
        upto = np.cumsum(size, dtype=np.int64)
        total = int(upto[-1]) if len(upto) else 0
        ids = self.store[np.repeat(self.at[entry] - (upto - size), size) + np.arange(total)]
        # The pieces of each text, from where the texts begin.
        begins = np.cumsum([0, *(len(t) + 1 for t in texts)]) + 1
        cuts = np.concatenate(([0], upto))[np.searchsorted(first, begins)].tolist()
        raw = ids.tobytes()
        return [raw[4 * a : 4 * z] for a, z in zip(cuts, cuts[1:], strict=False)]

    def encode(self, texts: list[str], most_bytes: int = 1 << 20) -> list[bytes]:
        out: list[bytes | None] = [None] * len(texts)
        held: list[tuple[int, bytes]] = []
        size, rest = 0, []

        def settle_held() -> None:
            for (i, _), ids in zip(held, self._encode([t for _, t in held]), strict=True):
                out[i] = ids
            held.clear()

        for i, t in enumerate(texts):
            if not self.plain.match(t) or any(a in t for a in self.added):
                rest.append(i)
                continue
            held.append((i, t.encode()))
            size += len(held[-1][1])
            if size > most_bytes:
                settle_held()
                size = 0
        if held:
            settle_held()
        if rest:
            for i, e in zip(rest, self.lib.encode_batch_fast([texts[i] for i in rest], add_special_tokens=False), strict=True):
                out[i] = np.array(e.ids, dtype="<u4").tobytes()
        return out  # type: ignore[return-value]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
