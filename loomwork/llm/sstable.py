"""Sorted-string-table shards of token ids, keyed by document id.

A shard is one file, written once and never changed:

    blocks   each: entries, then nothing; an entry is varint(shared), varint(unshared), key tail,
             varint(value length), value. Keys share a prefix with the key before them in the block; a
             block's first key is whole, so a block can be read alone. Values are little-endian unsigned
             32-bit ids. A block is compressed by zstd
             as a whole, after the varint of its plain size.
    index    one entry a block: its first key, offset, stored size, entries, crc32 of the stored block
    bloom    bits for all keys of the shard
    footer   fixed size: offsets and sizes of index and bloom, entries, ids, hash count, crc32 of index and
             bloom, magic

A key is the signed 64-bit document id, big-endian with the sign bit turned, so that bytes sort as ids do;
null ids sort first under the key 0x00 alone. ``lookup`` asks the Bloom filter, binary-searches the sparse
index, and reads one block (more only while equal keys go on).

``write`` range-partitions by id, within an id by a hash of the text and within a text by place, sorts each partition and writes it as one shard; shards are numbered in
id order. So an id that a third of all rows share, or none, fills many shards; ``lookup`` asks each of them. A task writes under a name of its own attempt and renames at the end; a repeated task gives the
same bytes under the same final name. Files lie in the shared folder, through pyarrow's file systems.
"""

from __future__ import annotations

import bisect
import struct
import uuid
import zlib
from collections.abc import Iterator
from io import BytesIO

import numpy as np
import pyarrow as pa
import xxhash
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.llm.textkit import Encoder, default_tokenizer, pick, shared_dir, ship, sub_batches

MAGIC = b"LWSST001"
FOOTER = struct.Struct("<QQQQQQII8s")


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return pafs.FileSystem.from_uri(uri) if "://" in uri else (pafs.LocalFileSystem(), uri)


def key_of(doc_id: int | None) -> bytes:
    return b"\0" if doc_id is None else b"\1" + struct.pack(">Q", (doc_id + (1 << 63)) & ((1 << 64) - 1))


def id_of(key: bytes) -> int | None:
    return None if key == b"\0" else struct.unpack(">Q", key[1:])[0] - (1 << 63)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def _bloom_places(key: bytes, bits: int, k: int) -> list[int]:
    h = xxhash.xxh64_intdigest(key, 7)
    a, b = h & 0xFFFFFFFF, h >> 32 | 1
    return [(a + i * b) % bits for i in range(k)]


class ShardWriter:
    """Entries come in key order; equal keys are allowed. Holds one block and the keys' Bloom hashes."""

    def __init__(self, sink, *, block_bytes: int = 64 << 10, bits_per_key: int = 10) -> None:
        self.sink, self.block_bytes, self.bits_per_key = sink, block_bytes, bits_per_key
        self.codec = pa.Codec("zstd", compression_level=1)
        self.at = self.entries = self.ids = 0
        self.index: list[tuple[bytes, int, int, int, int]] = []
        self.hashes: list[int] = []
        self._begin()

    def _begin(self) -> None:
        self.buf, self.first, self.last, self.n = BytesIO(), b"", b"", 0

    def add(self, key: bytes, value: bytes) -> None:
        if self.n and key < self.last:
            raise ValueError("keys out of order")
        shared = 0
        if self.n:
            most = min(len(key), len(self.last))
            while shared < most and key[shared] == self.last[shared]:
                shared += 1
        else:
            self.first = key
        self.buf.write(_varint(shared) + _varint(len(key) - shared) + key[shared:] + _varint(len(value)) + value)
        self.last, self.n = key, self.n + 1
        self.hashes.append(xxhash.xxh64_intdigest(key, 7))
        self.entries, self.ids = self.entries + 1, self.ids + len(value) // 4
        if self.buf.tell() >= self.block_bytes:
            self.flush()

    def flush(self) -> None:
        if self.n:
            plain = self.buf.getvalue()
            data = _varint(len(plain)) + self.codec.compress(plain, asbytes=True)
            self.sink.write(data)
            self.index.append((self.first, self.at, len(data), self.n, zlib.crc32(data)))
            self.at += len(data)
            self._begin()

    def close(self) -> None:
        self.flush()
        index = b"".join(_varint(len(k)) + k + _varint(o) + _varint(s) + _varint(n) + _varint(crc) for k, o, s, n, crc in self.index)
        bits = max(64, self.entries * self.bits_per_key) + 7 & ~7
        k = max(1, round(0.69 * self.bits_per_key))
        marks = np.zeros(bits, dtype=bool)
        h = np.array(self.hashes, dtype=np.uint64)
        a, b = h & np.uint64(0xFFFFFFFF), h >> np.uint64(32) | np.uint64(1)
        for i in range(k):
            marks[((a + np.uint64(i) * b) % np.uint64(bits)).astype(np.int64)] = True
        bloom = np.packbits(marks, bitorder="little").tobytes()
        self.sink.write(index + bloom)
        self.sink.write(FOOTER.pack(self.at, len(index), self.at + len(index), len(bloom), self.entries, self.ids, k, zlib.crc32(bloom, zlib.crc32(index)), MAGIC))


class Shard:
    """Reads one shard; only footer, index and Bloom filter stay in memory."""

    def __init__(self, uri: str) -> None:
        system, path = open_fs(uri)
        self.file = system.open_input_file(path)
        self.file.seek(self.file.size() - FOOTER.size)
        i_at, i_len, b_at, b_len, self.entries, self.ids, self.k, crc, magic = FOOTER.unpack(self.file.read(FOOTER.size))
        if magic != MAGIC:
            raise ValueError(f"not a shard: {uri}")
        index, self.bloom = self._part(i_at, i_len), self._part(b_at, b_len)
        if zlib.crc32(self.bloom, zlib.crc32(index)) != crc:
            raise ValueError(f"damaged shard: {uri}")
        self.uri = uri
        self.blocks: list[tuple[bytes, int, int, int, int]] = []
        at = 0
        while at < len(index):
            n, at = _read_varint(index, at)
            key, at = index[at : at + n], at + n
            o, at = _read_varint(index, at)
            s, at = _read_varint(index, at)
            m, at = _read_varint(index, at)
            crc, at = _read_varint(index, at)
            self.blocks.append((key, o, s, m, crc))
        self.firsts = [b[0] for b in self.blocks]

    def _part(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def block(self, i: int) -> Iterator[tuple[bytes, bytes]]:
        _, o, s, n, crc = self.blocks[i]
        stored, key = self._part(o, s), b""
        if zlib.crc32(stored) != crc:
            raise ValueError(f"damaged block {i}: {self.uri}")
        size, at = _read_varint(stored, 0)
        data, at = pa.Codec("zstd").decompress(stored[at:], decompressed_size=size, asbytes=True), 0
        for _ in range(n):
            shared, at = _read_varint(data, at)
            more, at = _read_varint(data, at)
            key, at = key[:shared] + data[at : at + more], at + more
            size, at = _read_varint(data, at)
            yield key, data[at : at + size]
            at += size

    def scan(self) -> Iterator[tuple[bytes, bytes]]:
        for i in range(len(self.blocks)):
            yield from self.block(i)

    def may_hold(self, key: bytes) -> bool:
        bits = len(self.bloom) * 8
        return all(self.bloom[p >> 3] >> (p & 7) & 1 for p in _bloom_places(key, bits, self.k))

    def lookup(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids of every entry under doc_id, in file order."""
        key = key_of(doc_id)
        if not self.blocks or not self.may_hold(key):
            return []
        found = []
        for i in range(max(0, bisect.bisect_left(self.firsts, key) - 1), len(self.blocks)):
            if self.firsts[i] > key:
                break
            found += [np.frombuffer(v, dtype="<u4") for k, v in self.block(i) if k == key]
        return found


def _publish(system: pafs.FileSystem, own: str, final: str) -> None:
    """Gives a whole file its name. Where a repeated task finds the name taken, and the file system keeps it, the bytes are the same."""
    try:
        system.move(own, final)
    except OSError:
        if system.get_file_info(final).type == pafs.FileType.NotFound:
            raise
        system.delete_file(own)


def write(df: DataFrame, folder: str, *, tokenizer: str | None = None, end_id: int = 2, shards: int | None = None, block_bytes: int = 64 << 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the shards and gives their manifest: shard, path, n_docs, n_ids; shards without documents have no row.

    Rows of one id lie one after the other, over several shards where they are many, in the order of their texts' hashes. The shuffle carries texts, not ids.
    """
    spark, path = ship(df.sparkSession), tokenizer or default_tokenizer()
    if shards is None:
        shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 8)
    system, root = open_fs(folder)
    system.create_dir(root, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        enc, end, writer = Encoder.of(path), np.array([end_id], dtype="<u4").tobytes(), None
        system, root = open_fs(folder)
        final = f"{root}/shard-{part:06d}.sst"
        own = f"{final}.{TaskContext.get().taskAttemptId()}.{uuid.uuid4().hex[:8]}"
        sink = None
        for b in sub_batches(batches, 4 << 20):
            if writer is None:
                sink = system.open_output_stream(own)
                writer = ShardWriter(sink, block_bytes=block_bytes)
            for doc, ids in zip(b.column(0).to_pylist(), enc.encode(b.column(1).to_pylist()), strict=True):
                writer.add(key_of(doc), ids + end)
        if writer is not None:
            writer.close()
            sink.close()
            _publish(system, own, final)
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([f"{folder}/shard-{part:06d}.sst"]), pa.array([writer.entries], pa.int64()), pa.array([writer.ids], pa.int64())], names=["shard", "path", "n_docs", "n_ids"])

    # Rows of one id and text are told apart by where they are read, so that they too can be cut.
    order = (F.col("doc_id").asc_nulls_first(), "text_hash", "place")
    rows = pick(df, id_col, text_col).withColumns({"text_hash": F.xxhash64("text"), "place": F.monotonically_increasing_id()})
    rows = rows.repartitionByRange(shards, *order).sortWithinPartitions(*order).select("doc_id", "text")
    return rows.mapInArrow(run, "shard long, path string, n_docs long, n_ids long")


def read(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every entry, read back from the shards.

    The driver sees one row a shard: their count follows from the number of partitions, not of documents.
    """
    files = sorted(manifest.collect())
    starts, before = [], 0
    for shard, path, _, n_ids in files:
        starts.append((shard, path, before))
        before += n_ids
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not starts:
        return spark.createDataFrame([], schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, start in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                docs, at, n, crc = [], [], [], []
                shard = Shard(path)
                for i in range(len(shard.blocks)):
                    for key, value in shard.block(i):
                        docs.append(id_of(key))
                        at.append(start)
                        n.append(len(value) // 4)
                        crc.append(zlib.crc32(value))
                        start += n[-1]
                    if len(docs) > 20_000 or i == len(shard.blocks) - 1:
                        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (docs, at, n, crc)], names=["doc_id", "start", "n_tokens", "ids_crc32"])
                        docs, at, n, crc = [], [], [], []

    paths = spark.createDataFrame(starts, "shard long, path string, before long").repartition(len(starts))
    return paths.mapInArrow(run, schema)


def round_trip(df: DataFrame, **options) -> DataFrame:
    """Writes a fresh set of shards under the shared folder and reads it back."""
    spark = df.sparkSession
    folder = f"{shared_dir(spark)}/sst-{uuid.uuid4().hex}"
    return read(spark, write(df, folder, **options))
