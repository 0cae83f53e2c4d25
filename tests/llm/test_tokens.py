import zlib

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from loomwork.llm import packing, sstable
from loomwork.llm.textkit import Encoder, default_tokenizer


def encoded(text):
    return Encoder.of(default_tokenizer()).lib.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=40))
def test_encoder_is_the_librarys(text):
    assert np.frombuffer(Encoder.of(default_tokenizer()).encode([text])[0], "<u4").tolist() == encoded(text)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(alphabet="asStvelrmd'  \n\t\r17!-éß×÷Ÿ", max_size=30), max_size=4))
def test_pieces_of_plain_texts_are_the_librarys(texts):
    enc = Encoder.of(default_tokenizer())
    assert [np.frombuffer(x, "<u4").tolist() for x in enc.encode(texts, most_bytes=20)] == [encoded(t) for t in texts]


def test_encoder_forgets_and_learns_again(monkeypatch):
    enc = Encoder(default_tokenizer())
    monkeypatch.setattr(enc, "most", 40)
    texts = [" ".join(f"word{chr(97 + i % 26)}{chr(97 + k % 26)} it's {i}" for i in range(k % 7, 30)) for k in range(60)]
    for k in range(0, 60, 5):
        assert [np.frombuffer(x, "<u4").tolist() for x in enc.encode(texts[k : k + 5])] == [encoded(t) for t in texts[k : k + 5]]


def test_pieces_tile_documents_and_sequences(docs, corpus):
    rows = packing.pack(docs, window=64).collect()
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault((r.doc_id, r.doc_tokens), []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    for pieces in by_seq.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 64
    total = sum(len(encoded(t)) + 1 for _, t in corpus)
    assert sum(r.length for r in rows) == total
    unique = {i: t for i, t in corpus if sum(j == i for j, _ in corpus) == 1}
    for i, t in unique.items():
        ids, at = np.array([*encoded(t), 1], dtype="<u4"), 0
        for p in sorted((r for r in rows if r.doc_id == i), key=lambda p: p.start):
            assert p.start == at and p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    padding = sum(0 if (n := sum(p.length for p in s)) & (n - 1) == 0 else 64 - n for s in by_seq.values())
    assert padding == 0


def test_packer_takes_the_least_sum_of_squares():
    r = np.random.default_rng(0)
    packer = packing.SquarePacker(16, 0, lambda *_: None)
    for s in r.integers(1, 16, 400):
        before = packer.count.copy()

        def total(h, s=s, before=before):
            n = before.copy()
            if h:
                n[h] -= 1
            if h + s < 16:
                n[h + s] += 1
            return int((n**2).sum())

        options = [h for h in range(0, 17 - s) if h == 0 or before[h]]
        packer.place((0, 0, np.zeros(s, dtype="<u4"), s))
        assert int((packer.count**2).sum()) == min(map(total, options))


@pytest.mark.parametrize(("docs_", "most"), [(8192, 0.01), (1000, 0.06), (300, 0.2)])
def test_most_ids_stay_where_the_method_puts_them(docs_, most):
    """Also in small partitions: of ids that are not part of a whole window, those moved at the end are few."""
    r, windows = np.random.default_rng(docs_), []
    packer = packing.SquarePacker(2048, 0, lambda k, pieces: windows.append(pieces))
    sizes = np.maximum(1, r.lognormal(5.8, 1.0, docs_)).astype(int)
    for k, n in enumerate(sizes):
        packer.add(k, np.arange(n))
    packer.finish()
    assert packer.moved <= most * sizes.sum()
    seen = {}
    for pieces in windows:
        assert [p[4] for p in pieces] == [0, *np.cumsum([len(p[2]) for p in pieces])[:-1]]
        used = sum(len(p[2]) for p in pieces)
        assert used == 2048 or (used & (used - 1) == 0 and used < 2048)
        for doc, start, ids, n, _ in pieces:
            assert n == sizes[doc] and ids[0] == start
            seen.setdefault(doc, []).extend(ids.tolist())
    assert all(sorted(seen[k]) == list(range(n)) for k, n in enumerate(sizes))


def test_empty_tables(nothing):
    assert packing.pack(nothing).count() == 0
    assert sstable.round_trip(nothing).count() == 0


def test_round_trip_through_shards(docs, corpus):
    rows = sorted(sstable.round_trip(docs, shards=4).collect(), key=lambda r: r.start)
    # Within an id by the texts' hashes, as Spark's xxhash64 gives them.
    hashed = lambda t: (xxhash.xxh64_intdigest(t.encode(), 42) + (1 << 63)) % (1 << 64)
    want = sorted(((i, t or "") for i, t in corpus), key=lambda x: (x[0] is not None, x[0] or 0, hashed(x[1])))
    at = 0
    for r, (i, t) in zip(rows, want, strict=True):
        ids = np.array([*encoded(t), 2], dtype="<u4")
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_an_id_of_most_rows_fills_many_shards(spark, tmp_path):
    """Null ids with texts of their own, and one id whose rows are all equal."""
    rows = [(None, f"text {i} of its own") for i in range(3000)] + [(7, "one text")] * 3000 + [(i, f"other {i}") for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    manifest = sstable.write(df, str(tmp_path / "shards"), shards=16)
    sizes = [r.n_docs for r in manifest.collect()]
    assert sum(sizes) == 8000 and max(sizes) < 2 * 8000 / 16
    got = sstable.read(spark, manifest).collect()
    assert sorted((r.doc_id is not None, r.doc_id or 0) for r in got) == sorted((i is not None, i or 0) for i, _ in rows)
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    shards = [sstable.Shard(r.path) for r in manifest.collect()]
    assert sum(len(s.lookup(None)) for s in shards) == 3000 and sum(len(s.lookup(7)) for s in shards) == 3001 and sum(len(s.lookup(5)) for s in shards) == 1


def test_lookup_by_binary_search(tmp_path):
    path = str(tmp_path / "a.sst")
    keys = [None, -(2**63), -5, *range(0, 3000, 3), 2**63 - 1]
    with open(path, "wb") as f:
        w = sstable.ShardWriter(f, block_bytes=200)
        for k in keys:
            w.add(sstable.key_of(k), np.array([7, (k or 0) & 0xFFFF], dtype="<u4").tobytes())
            if k == 30:
                for _ in range(40):
                    w.add(sstable.key_of(k), np.array([9], dtype="<u4").tobytes())
        w.close()
    s = sstable.Shard(path)
    assert len(s.blocks) > 10 and s.entries == len(keys) + 40
    for k in keys:
        assert s.lookup(k)[0].tolist() == [7, (k or 0) & 0xFFFF]
    assert len(s.lookup(30)) == 41
    absent = [k for k in range(1, 3000) if k % 3]
    assert not any(s.lookup(k) for k in absent)
    assert sum(s.may_hold(sstable.key_of(k)) for k in absent) < 0.05 * len(absent)
    assert [sstable.id_of(k) for k, _ in s.scan() if k != sstable.key_of(30)] == [k for k in keys if k != 30]
    with pytest.raises(ValueError, match="order"):
        w2 = sstable.ShardWriter(open(tmp_path / "b", "wb"))
        w2.add(sstable.key_of(2), b"")
        w2.add(sstable.key_of(1), b"")
    data = bytearray(open(path, "rb").read())
    data[s.blocks[2][1] + 4] ^= 1
    (tmp_path / "d").write_bytes(data)
    with pytest.raises(ValueError, match="damaged block 2"):
        list(sstable.Shard(str(tmp_path / "d")).scan())
    data = bytearray(open(path, "rb").read())
    data[-sstable.FOOTER.size - 3] ^= 1
    (tmp_path / "c").write_bytes(data)
    with pytest.raises(ValueError, match="damaged"):
        sstable.Shard(str(tmp_path / "c"))
