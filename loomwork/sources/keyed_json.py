"""One JSON object {key: value, ...}, of any size, read by many tasks.

A file of this shape has no lines to part it at. It is cut into byte ranges, and two passes go over them. The first says of each range, without knowing what stands
before it, how a reader leaves it: for a reader that comes in outside of a string, and for one that comes in inside, whether it goes out inside of one and how much deeper it is. Unescaped quotes
only turn one into the other, so both answers come from one look at the bytes. The driver runs through these summaries, a few numbers a range, and knows where each range begins. In the second pass a
task finds the separators of its range, the opening brace and the commas at depth one outside of strings: the pair after a separator is its own, and it reads on past its range until
the last of them ends. A task holds its range and its last pair.

A file that is damaged, or cut off before the object closes, or that goes on after it, is an error, whatever the ranges. Rows are key, value (as JSON text) and _ord, which grows with
the place in the file.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.functions.streams import file_system

_QUOTE, _BACK, _COMMA = 34, 92, 44
_OPEN, _CLOSE, _BLANK = (123, 91), (125, 93), (9, 10, 13, 32)
RANGE = 32 << 20


def _bytes(path: str, start: int, size: int) -> np.ndarray:
    system, where = file_system(path)
    with system.open_input_file(where) as f:
        return np.frombuffer(f.read_at(size, start), dtype=np.uint8)


def quotes(data: np.ndarray, escaped: bool = False) -> tuple[np.ndarray, bool]:
    """Places of the quotes that no backslash stands before (of an odd run of them), and whether the byte after the data is escaped.

    With ``escaped`` the first byte is.
    """
    back = data == _BACK
    at = np.flatnonzero(data == _QUOTE)
    # The last byte before each place that is no backslash; before the data there is one, or an odd backslash.
    plain = np.where(~back, np.arange(len(data)), -1)
    if escaped and len(data):
        plain[0] = 0
    last = np.maximum.accumulate(plain) if len(data) else plain
    before = np.where(at > 0, last[at - 1], -1)
    odd = (at - 1 - before) % 2 == 1
    if escaped:
        odd |= at == 0
    tail = (len(data) - 1 - int(last[-1])) % 2 == 1 if len(data) else escaped
    return at[~odd], bool(tail)


def summary(data: np.ndarray, escaped: bool) -> tuple[int, int, int, bool]:
    """Quotes, depth gained outside of strings by a reader that comes in outside, by one that comes in inside, whether the next byte is escaped."""
    q, tail = quotes(data, escaped)
    step = np.isin(data, _OPEN).astype(np.int64) - np.isin(data, _CLOSE)
    at = np.flatnonzero(step)
    inside = np.searchsorted(q, at) % 2 == 1
    return len(q), int(step[at][~inside].sum()), int(step[at][inside].sum()), tail


class _Reader:
    """Bytes from a range's start on, with what holds at each of them; grows past the range's end."""

    def __init__(self, path: str, start: int, inside: bool, depth: int, escaped: bool) -> None:
        self.path, self.at, self.inside, self.depth, self.escaped = path, start, inside, depth, escaped

    def read(self, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The next bytes; places of what counts outside of strings (braces, brackets, commas), the byte there, and the depth after it."""
        data = _bytes(self.path, self.at, size)
        q, tail = quotes(data, self.escaped)
        step = np.isin(data, _OPEN).astype(np.int64) - np.isin(data, _CLOSE)
        at = np.flatnonzero((step != 0) | (data == _COMMA))
        at = at[(np.searchsorted(q, at) + int(self.inside)) % 2 == 0]
        depth = self.depth + np.cumsum(step[at])
        self.at += len(data)
        self.inside ^= bool(len(q) % 2)
        self.escaped = tail
        if len(at):
            self.depth = int(depth[-1])
        return data, at, data[at], depth


def _pair(data: bytes) -> tuple[str, str]:
    try:
        pair = json.loads(b"{" + data + b"}")
    except (json.JSONDecodeError, UnicodeDecodeError) as e:
        raise ValueError(f"keyed JSON: {e}") from e
    if len(pair) != 1:
        raise ValueError("keyed JSON: one key and one value expected between separators")
    (key, value), *_ = pair.items()
    return key, json.dumps(value, ensure_ascii=False)


def pairs(path: str, start: int, size: int, inside: bool, depth: int, escaped: bool, piece: int = 4 << 20) -> Iterator[tuple[str, str, int]]:
    """(key, value, place of its separator) of the pairs whose separators lie in a range."""
    reader, held, base, open_at, first = _Reader(path, start, inside, depth, escaped), b"", start, -1, start + size
    while True:
        left = first - reader.at
        data, at, what, after = reader.read(left if left > 0 else piece)
        # Depth before a closing brace is one more than after it.
        opens, commas, closes = (what == 123) & (after == 1), (what == _COMMA) & (after == 1), (what == 125) & (after == 0)
        held += data.tobytes()
        for place, kind in sorted([*((int(p) + reader.at - len(data), "open") for p in at[opens]), *((int(p) + reader.at - len(data), "comma") for p in at[commas]), *((int(p) + reader.at - len(data), "close") for p in at[closes])]):
            if open_at >= 0:
                text = held[open_at + 1 - base : place - base]
                if text.strip() or kind == "comma" or held[open_at - base] == _COMMA:
                    yield (*_pair(text), open_at)
                open_at = -1
            if kind == "close":
                system, where = file_system(path)
                if not _blank_after(path, place + 1, system.get_file_info(where).size):
                    raise ValueError("keyed JSON: text after the object")
            if kind == "close" or place >= first:
                return
            open_at = place
        if open_at < 0 and reader.at >= first:
            return
        if not len(data):
            raise ValueError("keyed JSON: the object does not close")
        # What lies before the open pair is done.
        keep = open_at if open_at >= 0 else reader.at
        held, base = held[keep - base :], keep


def _check_ends(path: str, size: int, block: int = 1 << 20) -> int:
    """The place of the object's opening brace. The first and last bytes that are no blanks must be its braces."""
    first = 0
    for forward, brace in ((True, 123), (False, 125)):
        at = 0
        while at < size:
            n = min(block, size - at)
            data = _bytes(path, at if forward else size - at - n, n)
            solid = data[~np.isin(data, _BLANK)]
            if len(solid):
                if solid[0 if forward else -1] != brace:
                    raise ValueError("keyed JSON: the file is no whole object")
                if forward:
                    first = at + int(np.flatnonzero(~np.isin(data, _BLANK))[0])
                break
            at += n
        else:
            raise ValueError("keyed JSON: the file is no whole object")
    return first


def starts(summaries: list[tuple[int, int, int, int]]) -> tuple[list[tuple[bool, int]], bool, int]:
    """For each range, in order, whether its reader comes in inside of a string and how deep; and how the last one goes out."""
    out, inside, depth = [], False, 0
    for n_quotes, outside_gain, inside_gain, _ in summaries:
        out.append((inside, depth))
        depth += inside_gain if inside else outside_gain
        inside ^= bool(n_quotes % 2)
    return out, inside, depth


def read_keyed_json(spark: SparkSession, path: str, value_schema: str, *, range_bytes: int = RANGE, most: int | None = None) -> DataFrame:
    """key, value (by the schema), _ord of one JSON object, its first ``most`` pairs at least where that is given: then no more ranges are read than that takes."""
    system, where = file_system(path)
    size = system.get_file_info(where).size or 0
    opening = _check_ends(path, size)
    cuts = [(k, at, min(range_bytes, size - at)) for k, at in enumerate(range(0, size, range_bytes))]

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for k, at, n in zip(*(b.column(c).to_pylist() for c in range(3)), strict=True):
                # Whether the first byte is escaped is seen from the bytes before it.
                back, low = 0, at
                while low > 0 and back == at - low:
                    step = min(1 << 12, low)
                    run = _bytes(path, low - step, step)[::-1] == _BACK
                    back += int(np.argmin(run)) if not run.all() else step
                    low -= step
                escaped = back % 2 == 1
                rows.append((k, at, n, *summary(_bytes(path, at, n), escaped)[:3], int(escaped)))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)] if rows else [pa.array([], pa.int64())] * 7, names=["k", "at", "n", "q", "d0", "d1", "e"])

    ranges = spark.createDataFrame(cuts, "k long, at long, n long").repartition(max(1, len(cuts)), "k")
    known = sorted(ranges.mapInArrow(summed, "k long, at long, n long, q long, d0 long, d1 long, e long").collect())
    begins, inside, depth = starts([tuple(r[3:]) for r in known])
    if inside or depth:
        raise ValueError("keyed JSON: the object does not close")
    over = [r[1] for r, (_, d) in zip(known, begins, strict=True) if d < 1 and r[1] > opening]
    if over and not _blank_after(path, over[0], size):
        raise ValueError("keyed JSON: text after the object")
    tasks = [(r[0], r[1], r[2], i, d, bool(r[6])) for r, (i, d) in zip(known, begins, strict=True) if not over or r[1] < over[0]]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, at, n, i, d, e in zip(*(b.column(c).to_pylist() for c in range(6)), strict=True):
                rows, held = [], 0
                for row in pairs(path, at, n, i, d, e):
                    rows.append(row)
                    held += len(row[1])
                    if held > 1 << 20:
                        yield _batch(rows)
                        rows, held = [], 0
                if rows:
                    yield _batch(rows)

    def _batch(rows: list[tuple[str, str, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.string(), pa.int64()), strict=True)], names=["key", "value", "_ord"])

    # A range a task, in the order of the file, so that a limit stops after the first of them.
    rows = spark.createDataFrame(tasks, "k long, at long, n long, inside boolean, depth long, escaped boolean").repartitionByRange(max(1, len(tasks)), "k").mapInArrow(read, "key string, value string, _ord long")
    out = rows.select("key", F.from_json("value", value_schema).alias("value"), "_ord")
    return out if most is None else out.limit(most)


def _blank_after(path: str, at: int, size: int, block: int = 1 << 20) -> bool:
    """Whether only blanks stand from a place on."""
    while at < size:
        data = _bytes(path, at, min(block, size - at))
        if not np.isin(data, _BLANK).all():
            return False
        at += len(data)
    return True
