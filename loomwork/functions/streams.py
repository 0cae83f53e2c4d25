"""Files as streams of bytes inside of tasks, through pyarrow's file systems."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa


def file_system(path: str):
    """(file system, path in it) of a URI or a local path."""
    from pyarrow import fs

    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path.removeprefix("file:")


def digest(path: str, piece: int = 1 << 20) -> str:
    """SHA-256 of a file's bytes, read piece by piece."""
    system, where = file_system(path)
    h = hashlib.sha256()
    with system.open_input_stream(where) as f:
        while data := f.read(piece):
            h.update(data)
    return h.hexdigest()


def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, n_bytes) -> with the digest of each file."""
    for b in batches:
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array([digest(p) for p in b.column(0).to_pylist()], pa.string())], names=[*b.schema.names, "sha256"])
