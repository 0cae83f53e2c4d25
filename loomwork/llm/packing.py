"""Sum-of-squares online packing of token sequences into fixed windows.

Each document (its ids and one end id) arrives once, in the order of its partition. Whole windows are cut
off at once; what is left, shorter than a window, goes where the sum over fill levels of the squared number
of open windows at that level becomes least: into an open window of level h, which moves one count from
N[h] to N[h+s], or into a new one, which raises N[s]; a window that becomes full leaves the array. Equal
choices take the fullest window. When the partition ends, pieces of the emptiest open windows are cut to fill the
fullest ones; all other pieces stay where they are. The last window is cut at powers of two, which need no padding. A partition needs
no other partition: nothing is shuffled, and a lost task repeats alone with the same result.

Nulls: a null text is an empty text, one piece with the end id alone. A null doc_id stays null. Repeated
rows are packed once each. An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from loomwork.llm.textkit import Encoder, default_tokenizer, pick, ship, sub_batches

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class SquarePacker:
    """The level array of one partition. emit: gets (window, pieces), pieces: (document, start, ids, total, offset)."""

    def __init__(self, window: int, first_id: int, emit) -> None:
        self.window, self.next, self.emit = window, first_id, emit
        self.count = np.zeros(window + 1, dtype=np.int64)  # open windows by fill; 0 and window stay 0
        self.open: list[list[list[tuple]]] = [[] for _ in range(window)]
        self.moved = 0  # ids that did not stay where the sum of squares had put them

    def close(self, pieces: list[tuple]) -> None:
        self.emit(self.next, pieces)
        self.next += 1

    def add(self, doc: object, ids: np.ndarray) -> None:
        n, w = len(ids), self.window
        whole = n // w * w
        for at in range(0, whole, w):
            self.close([(doc, at, ids[at : at + w], n, 0)])
        if n > whole:
            self.place((doc, whole, ids[whole:], n))

    def place(self, piece: tuple) -> None:
        s, w = len(piece[2]), self.window
        # Change of the sum of squares if the piece goes to level h (h = 0: a new window).
        room = w - s
        now = self.count[: room + 1]
        then = self.count[s : w + 1]
        change = 2 * then[: room + 1] + 1 - (2 * now - 1)
        change[0] = 2 * self.count[s] + 1
        change[room] = 1 - 2 * self.count[room]  # a full window leaves the array
        change[1:][now[1:] == 0] = np.iinfo(np.int64).max
        best = int(room - np.argmin(change[::-1]))
        if best:
            pieces = self.open[best].pop()
            self.count[best] -= 1
        else:
            pieces = []
        pieces.append((*piece, best))
        if best + s == w:
            self.close(pieces)
        else:
            self.open[best + s].append(pieces)
            self.count[best + s] += 1

    def finish(self) -> None:
        """Fills the fullest open windows to the last id with pieces of the emptiest ones, which alone give up their place.

        What is left of the last window is cut at powers of two, which need no padding.
        """
        windows = [pieces for level in reversed(self.open) for pieces in level]
        self.open = [[] for _ in range(self.window)]
        self.count[:] = 0
        at, last = 0, len(windows) - 1
        while at < last:
            pieces, used = windows[at], sum(len(p[2]) for p in windows[at])
            while used < self.window and at < last:
                doc, start, ids, n, _ = windows[last].pop()
                take = min(self.window - used, len(ids))
                pieces.append((doc, start, ids[:take], n, used))
                used, self.moved = used + take, self.moved + take
                if take < len(ids):
                    windows[last].append((doc, start + take, ids[take:], n, 0))
                elif not windows[last]:
                    last -= 1
            if used < self.window:  # the donors ran out
                break
            self.close(pieces)
            at += 1
        if at <= last:
            self._cut(windows[at])

    def _cut(self, stream: list[tuple]) -> None:
        left = sum(len(p[2]) for p in stream)
        self.moved += left
        fill: list[tuple] = []
        size, used = self._next_size(left), 0
        for doc, start, ids, n, _ in stream:
            at = 0
            while at < len(ids):
                take = min(size - used, len(ids) - at)
                fill.append((doc, start + at, ids[at : at + take], n, used))
                at, used, left = at + take, used + take, left - take
                if used == size:
                    self.close(fill)
                    fill, size, used = [], self._next_size(left), 0

    def _next_size(self, left: int) -> int:
        return self.window if left >= self.window else 1 << max(0, left.bit_length() - 1)


def pack(df: DataFrame, *, tokenizer: str | None = None, window: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each piece of a document: where it starts in the document and in which sequence, at which offset, it lies."""
    path = tokenizer or default_tokenizer()
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, rows = Encoder.of(path), []

        def emit(sequence: int, pieces: list[tuple]) -> None:
            for doc, start, ids, n, offset in pieces:
                rows.append((doc, start, len(ids), zlib.crc32(ids.tobytes()), n, sequence, offset))

        def out() -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True))
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, type=pa.int64()) for c in cols], names=[x.split()[0] for x in SCHEMA.split(", ")])

        packer = SquarePacker(window, TaskContext.get().partitionId() << 36, emit)
        end = np.array([end_id], dtype="<u4").tobytes()
        for b in sub_batches(batches, 4 << 20):
            docs = b.column(0).to_pylist()
            for doc, ids in zip(docs, enc.encode(b.column(1).to_pylist()), strict=True):
                packer.add(doc, np.frombuffer(ids + end, dtype="<u4"))
            if rows:
                yield out()
        packer.finish()
        if rows:
            yield out()

    return pick(df, id_col, text_col).mapInArrow(run, SCHEMA)
