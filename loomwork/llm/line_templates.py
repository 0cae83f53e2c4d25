"""Line dedup by a log-template tree.

Each line is parsed into tokens (A-Z lower-cased); tokens with a digit are variable fields. The tree has a fixed
depth: the token count, then the first four tokens. Lines of one leaf are parsed in the order of their
hashes: a line joins the template that agrees with it in most places, at least ``similar`` of them (of equals the older
one), and places that differ become variable; else it founds a template. Lines of up to four tokens are their own leaf.

A template recurs when ``min_docs`` documents hold it that are no near copies of each other; copies of a document alone do not
make its lines recur, and are left to document-level dedup. Whether two documents are near copies is read off sketches: BINS
least hashes of five-word shingles of the whole text, of which a share of COPY agrees. Documents of equal sketches count once; the others
are taken in the order of their sketch ids, and each that is no near copy of those taken before is taken, until there are
``min_docs``. That goes first by slices of a template's documents, then over what the slices took, so that no
task holds all documents of a template. Documents that share most of their text, but not all, are alike in these sketches and still may be strangers: a
licence over two lines of content. So templates for which that fails are looked at once more without the shared lines. A document is told by the least of its own
lines, of five words or more, which fewer than ``min_docs`` documents hold and which are no edited versions of shared lines (none of their MARKS least shingle hashes is one of a
shared line's); a template that documents of ``min_docs`` different own lines hold recurs. Copies have no own lines, and near copies only edited ones; a line that one copy
alone has makes it a document of its own. A recurring template stays in its first document (least doc_id) and is dropped
from all others.

Lines travel as hashes, templates as 16 bits a token; no key is collected whole: hot lines are pre-aggregated
or met by ``skew_join``. The lines of a leaf are parsed by one task, in memory of 2 bytes a token of each template. A line is compared
only with templates that share a block of tokens with it: of a leaf's places after the leading tokens, cut in one
block more than may differ, one block at least agrees, so nothing is missed.

Nulls: a null text is an empty one; blank lines are never dropped and never counted. Null ids come last.
Repeated rows are one document. Empty tables give no rows. A table that has columns named like the two counts keeps them;
the counts then take the first free name with a number.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.llm.components import shuffled, skew_join
from loomwork.llm.textkit import lower_ascii, mix64, pick, release, run_hashes, settle, shared_dir, ship, sub_batches, tidy, token_bounds

LEAD = 4
BINS = 32
COPY = 0.8
WIDTH = 5
#: Documents of a template in one slice, about.
SLICE = 2000
#: Least shingle hashes of a line that tell its edited versions.
MARKS = 4
_FIELD = np.uint64(0x2A2A2A2A)
_FOUND = "rk long, doc_id long, sid long, line long, leaf long, at array<int>, tokens binary"
_ODD = np.uint64(0x9E3779B97F4A7C15)


def row_key(doc_id: Column | str = "doc_id", text: Column | str = "text") -> Column:
    return F.xxhash64(doc_id, text)


def sketches(tokens: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """For each of n documents the least shingle hash of each bin, cut to 16 bits; 0 where a bin is empty."""
    size = np.bincount(owner, minlength=n)
    width = np.minimum(size, WIDTH)
    end = np.cumsum(size)
    at = np.arange(len(tokens))
    at = at[at <= (end - width)[owner]]  # where a shingle begins
    whose = owner[at]
    h = np.zeros(len(at), dtype=np.uint64)
    for j in range(WIDTH):
        here = np.minimum(at + j, len(tokens) - 1)
        h = np.where(j < width[whose], h * _ODD + tokens[here], h)
    h = mix64(h)
    low = np.full(n * BINS, np.iinfo(np.uint64).max, dtype=np.uint64)
    np.minimum.at(low, whose * BINS + (h >> np.uint64(59)).astype(np.int64), h)
    out = (low & np.uint64(0xFFFF)).astype("<u2") | np.uint16(1)
    out[low == np.iinfo(np.uint64).max] = 0
    return out.reshape(n, BINS)


def _binary(data: np.ndarray, sizes: np.ndarray, valid: np.ndarray) -> pa.Array:
    offsets = np.zeros(len(sizes) + 1, dtype=np.int32)
    np.cumsum(sizes, out=offsets[1:])
    mask = np.packbits(valid, bitorder="little")
    return pa.Array.from_buffers(pa.binary(), len(sizes), [pa.py_buffer(mask.tobytes()), pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes())])


def _parsed(b: pa.RecordBatch) -> pa.RecordBatch:
    """A row for each distinct line of each document, and one (line null) with the sketch of each document."""
    n = b.num_rows
    texts = [lower_ascii(t.encode("utf-8", "surrogatepass")) for t in b.column(2).to_pylist()]
    buf = np.frombuffer(b"\n" + b"\n".join(texts) + b"\n", dtype=np.uint8)
    first, end = token_bounds(buf)
    tokens = run_hashes(buf, first, end)
    breaks = np.flatnonzero(buf == 10)
    line_no = np.searchsorted(breaks, first) - 1  # among the lines of all texts
    lines_of = np.fromiter((t.count(b"\n") + 1 for t in texts), dtype=np.int64, count=n)
    line_end = np.cumsum(lines_of)
    owner = np.searchsorted(line_end, line_no, side="right")
    marks = sketches(tokens, owner, n)
    digits = np.zeros(len(buf) + 1, dtype=np.int64)
    np.cumsum((buf >= 48) & (buf <= 57), out=digits[1:])
    fields = np.where(digits[end] > digits[first], _FIELD, tokens)
    # Lines that have tokens.
    a = np.flatnonzero(np.diff(line_no, prepend=-1))
    z = np.append(a[1:], len(line_no)) if len(a) else a
    line = run_hashes(fields, a, z)
    doc, at = owner[a], line_no[a] - (line_end - lines_of)[owner[a]]
    # Equal lines of a document are one row with all their places.
    order = np.lexsort((at, line, doc))
    head = np.flatnonzero(np.concatenate(([True], (line[order][1:] != line[order][:-1]) | (doc[order][1:] != doc[order][:-1])))) if len(order) else order
    places = pa.ListArray.from_arrays(pa.array(np.append(head, len(order)).astype(np.int32)), pa.array(at[order].astype(np.int32)))
    pick_ = order[head]
    a, z, line, doc = a[pick_], z[pick_], line[pick_], doc[pick_]
    size = z - a
    deep = size > LEAD
    leaf = size.astype(np.uint64)
    for j in range(LEAD):
        leaf = mix64(leaf * _ODD + fields[np.minimum(a + j, max(len(fields) - 1, 0))]) if len(a) else leaf
    kept = np.where(deep, size, 0)
    spot = np.repeat(a - (np.cumsum(kept) - kept), kept) + np.arange(kept.sum())
    sig = (fields[spot] & np.uint64(0xFFFF)).astype("<u2")
    sid = mix64(marks.view("<u8").reshape(n, -1) @ np.arange(1, BINS // 4 + 1, dtype=np.uint64) * _ODD) if n else np.zeros(0, np.uint64)
    sid = sid.view(np.int64)
    some = len(a)
    who = pa.array(np.concatenate((doc, np.arange(n))))
    valid = np.concatenate((deep, np.ones(n, dtype=bool)))
    data = np.concatenate((sig, marks.reshape(-1)))
    sizes = np.concatenate((kept * 2, np.full(n, BINS * 2)))
    none = pa.nulls(n, pa.int64())
    cols = [
        b.column(0).take(who), b.column(1).take(who), pa.array(sid).take(who), pa.concat_arrays([pa.array(line.view(np.int64)), none]),
        pa.concat_arrays([pa.array(leaf.view(np.int64), mask=~deep) if some else pa.array([], pa.int64()), none]), pa.concat_arrays([places, pa.nulls(n, places.type)]), _binary(data, sizes, valid),
    ]
    return pa.RecordBatch.from_arrays(cols, names=["rk", "doc_id", "sid", "line", "leaf", "at", "tokens"])


def occurrences(docs: DataFrame) -> DataFrame:
    """rk, doc_id, sid (hash of the sketch), line (hash), leaf (hash; null where the leaf is the line), at (places), tokens (16
    bits each). A row without line holds a document's sketch as its tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for b in sub_batches(batches, 1 << 20):
            yield _parsed(b)

    return docs.mapInArrow(run, _FOUND)


class Leaf:
    """The templates of one leaf, found by the blocks of their founders' tokens."""

    def __init__(self, size: int, similar: float) -> None:
        self.least = similar * size
        differ = int(size - self.least + 1e-9)
        places = size - LEAD
        self.cuts = np.unique(np.linspace(LEAD, size, differ + 2).astype(np.int64)) if differ < places else None
        self.index: dict[tuple[int, bytes], list[int]] = defaultdict(list)
        self.founders: list[int] = []
        self.matrix = np.zeros((8, size), dtype=np.int32)

    def blocks(self, tokens: np.ndarray) -> list[tuple[int, bytes]]:
        data = tokens.astype("<u2").tobytes()
        return [(k, data[2 * i : 2 * j]) for k, (i, j) in enumerate(zip(self.cuts.tolist(), self.cuts[1:].tolist(), strict=False))]

    def put(self, line: int, tokens: np.ndarray) -> int:
        """The founder of the line's template; the line itself where it founds one."""
        n = len(self.founders)
        keys = self.blocks(tokens) if self.cuts is not None else []
        near = np.array(sorted({k for key in keys for k in self.index.get(key, ())}), dtype=np.int64) if keys else np.arange(n)
        if len(near):
            same = (self.matrix[near] == tokens).sum(axis=1)
            best = int(np.argmax(same))
            if same[best] >= self.least - 1e-9:
                k = int(near[best])
                self.matrix[k][self.matrix[k] != tokens] = -1
                return self.founders[k]
        if n == len(self.matrix):
            self.matrix = np.concatenate((self.matrix, np.zeros_like(self.matrix)))
        self.matrix[n] = tokens
        for key in keys:
            self.index[key].append(n)
        self.founders.append(line)
        return line


def _parse(similar: float):
    """Over lines sorted by (leaf, line): (line, template) where the template is another line's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, previous, leaf = None, None, None
        for b in batches:
            lines, templates = [], []
            for key, line, sig in zip(*(c.to_pylist() for c in b.columns), strict=True):
                tokens = np.frombuffer(sig, dtype="<u2").astype(np.int32)
                if leaf is None or key != now or len(tokens) != leaf.matrix.shape[1]:
                    now, previous, leaf = key, None, Leaf(len(tokens), similar)
                if line != previous:
                    previous, founder = line, leaf.put(line, tokens)
                    if founder != line:
                        lines.append(line)
                        templates.append(founder)
            if lines:
                yield pa.RecordBatch.from_arrays([pa.array(lines, pa.int64()), pa.array(templates, pa.int64())], names=["line", "template"])

    return run


def unlike(marks: np.ndarray, most: int) -> list[int]:
    """The rows taken when each is taken that is no near copy of those taken before, up to most."""
    taken: list[int] = []
    left = np.arange(len(marks))
    while len(left) and len(taken) < most:
        k = int(left[0])
        taken.append(k)
        rest = marks[left]
        either = ((rest != 0) | (marks[k] != 0)).sum(axis=1)
        left = left[((rest == marks[k]) & (rest != 0)).sum(axis=1) < COPY * np.maximum(either, 1)]
    return taken


def _unlike(most: int):
    """Over rows (template, slice, sid, mark) sorted by the first three: the rows that ``unlike`` takes of each (template, slice)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {"key": None, "sid": [], "mark": np.zeros((0, BINS), "<u2")}
        for b in batches:
            if not b.num_rows:
                continue
            template, part, sid = (b.column(i).to_numpy() for i in range(3))
            marks = np.frombuffer(b"".join(b.column(3).to_pylist()), dtype="<u2").reshape(-1, BINS)
            head = np.flatnonzero(np.concatenate(([True], (template[1:] != template[:-1]) | (part[1:] != part[:-1]))))
            out: list[tuple[int, int, int, bytes]] = []
            for lo, hi in zip(head.tolist(), [*head[1:].tolist(), len(template)], strict=True):
                key = (int(template[lo]), int(part[lo]))
                if key != held["key"]:
                    out += [(*held["key"], s, m.tobytes()) for s, m in zip(held["sid"], held["mark"], strict=True)] if held["key"] else []
                    held = {"key": key, "sid": [], "mark": np.zeros((0, BINS), "<u2")}
                if len(held["sid"]) < most:
                    # What was taken comes first, so it is taken again.
                    sids, all_ = [*held["sid"], *sid[lo:hi].tolist()], np.concatenate((held["mark"], marks[lo:hi]))
                    taken = unlike(all_, most) if len(all_) > 1 else [0]
                    held["sid"], held["mark"] = [sids[k] for k in taken], all_[taken]
            if out:
                yield batch(out)
        if held["key"]:
            yield batch([(*held["key"], s, m.tobytes()) for s, m in zip(held["sid"], held["mark"], strict=True)])

    def batch(rows: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
        types = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["template", "slice", "sid", "mark"])

    return run


def line_marks(lines: DataFrame) -> DataFrame:
    """(line, mark): the MARKS least hashes of five-word shingles of each (line, tokens)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sub_batches(batches, 1 << 20):
            sizes = np.array([len(t) // 2 for t in b.column(1).to_pylist()], dtype=np.int64)
            tokens = np.frombuffer(b"".join(b.column(1).to_pylist()), dtype="<u2").astype(np.uint64)
            end, owner = np.cumsum(sizes), np.repeat(np.arange(len(sizes)), sizes)
            at = np.arange(len(tokens))
            at = at[at <= (end - np.minimum(sizes, WIDTH))[owner]]
            whose, h = owner[at], np.zeros(len(at), dtype=np.uint64)
            for j in range(WIDTH):
                h = np.where(j < sizes[whose], h * _ODD + tokens[np.minimum(at + j, max(len(tokens) - 1, 0))], h)
            h = mix64(h)
            order = np.lexsort((h, whose))
            whose, h = whose[order], h[order]
            rank = np.arange(len(whose)) - np.searchsorted(whose, whose)
            keep = rank < MARKS
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(whose[keep])), pa.array(h[keep].view(np.int64))], names=["line", "mark"])

    return lines.select("line", "tokens").mapInArrow(run, "line long, mark long")


def _strangers(known: DataFrame, found: DataFrame, wanted: DataFrame, lines: DataFrame, doubtful: DataFrame, min_docs: int) -> DataFrame:
    """Those of the doubtful templates (template, n) that documents of min_docs different own lines hold."""
    held = skew_join(known.select("rk", "line", "template"), doubtful, "template", "n")
    docs = settle(held.select("rk").distinct())
    # Lines of five words or more that these documents have beside the shared ones.
    shared = known.select("rk", "line").join(shuffled(docs), "rk", "left_semi")
    own = found.filter("tokens IS NOT NULL").select("rk", "line").join(shuffled(docs), "rk", "left_semi").join(shuffled(shared), ["rk", "line"], "left_anti")
    own = settle(own.distinct())
    tokens = lines.filter("tokens IS NOT NULL").groupBy("line").agg(F.min("tokens").alias("tokens"))
    marks = line_marks(tokens.join(shuffled(wanted.select("line")), "line", "left_semi")).select("mark").distinct()
    edited = line_marks(tokens.join(shuffled(own.select("line").distinct()), "line", "left_semi")).join(shuffled(marks), "mark", "left_semi").select("line").distinct()
    told = own.join(shuffled(edited), "line", "left_anti").groupBy("rk").agg(F.min("line").alias("own"))
    return held.join(shuffled(told), "rk").select("template", "own").distinct().groupBy("template").agg(F.count("*").alias("k")).filter(F.col("k") >= min_docs).select("template")


def recurring(df: DataFrame, *, min_docs: int = 3, similar: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """rk, at: the places of lines to drop, a row for each document (by row_key of id and text) that loses any."""
    spark = ship(df.sparkSession)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Written as columns, which take half of the room that settled rows do and are read one by one; it goes when this is done.
    folder = f"{shared_dir(spark)}/lines-{uuid.uuid4().hex}"
    occurrences(pick(df, id_col, text_col).select(row_key().alias("rk"), "doc_id", "text")).write.option("compression", "zstd").parquet(folder)
    found = spark.read.schema(_FOUND).parquet(folder)
    marks = found.filter("line is null").select("sid", F.col("tokens").alias("mark"))
    found = found.filter("line is not null")
    # One occurrence of each line: copies are gone before lines meet by leaf.
    lines = settle(found.groupBy("line", "leaf").agg(F.count("*").alias("n"), F.min("tokens").alias("tokens")))
    busy = lines.filter("leaf is not null").groupBy("leaf").agg(F.count("*").alias("m")).filter("m > 1").select("leaf")
    ordered = lines.join(shuffled(busy), "leaf", "left_semi").select("leaf", "line", "tokens").repartition(n, "leaf").sortWithinPartitions("leaf", "line")
    moved = settle(ordered.mapInArrow(_parse(similar), "line long, template long"))
    # Lines of templates that so many rows hold.
    named = lines.groupBy("line").agg(F.sum("n").alias("n")).join(shuffled(moved), "line", "left").withColumn("template", F.coalesce("template", "line"))
    often = named.groupBy("template").agg(F.sum("n").alias("m")).filter(F.col("m") >= min_docs).select("template")
    wanted = settle(named.join(shuffled(often), "template").select("line", "template", "n"))
    known = settle(skew_join(found.select("rk", "doc_id", "sid", "line", "at"), wanted, "line", "n"))

    place = F.struct(F.col("doc_id").isNull().alias("null_id"), "doc_id", "rk")
    per = settle(known.groupBy("template", "sid").agg(F.min(place).alias("first"), F.count("*").alias("n")))
    every = per.groupBy("template").agg(F.count("*").alias("m"), F.min("first").alias("first"), F.sum("n").alias("n"))
    every = settle(every.select("template", F.col("first.rk").alias("first_rk"), "n", "m"))
    several = every.filter(F.col("m") >= min_docs)
    slices = F.greatest(F.lit(1), F.ceil(F.col("m") / SLICE))
    rows = skew_join(per.select("template", "sid"), several.select("template", "m", slices.alias("slices")), "template", "m")
    rows = rows.select("template", F.expr("pmod(sid, slices)").alias("slice"), "sid").join(shuffled(marks.groupBy("sid").agg(F.min("mark").alias("mark"))), "sid")
    schema = "template long, slice long, sid long, mark binary"
    taken = rows.select("template", "slice", "sid", "mark").repartition(n, "template", "slice").sortWithinPartitions("template", "slice", "sid").mapInArrow(_unlike(min_docs), schema)
    taken = taken.select("template", F.lit(0).cast("long").alias("slice"), "sid", "mark").repartition(n, "template").sortWithinPartitions("template", "slice", "sid").mapInArrow(_unlike(min_docs), schema)
    recur = settle(taken.groupBy("template").agg(F.count("*").alias("k")).filter(F.col("k") >= min_docs).select("template"))
    doubtful = settle(every.filter(F.col("n") >= min_docs).join(shuffled(recur), "template", "left_anti").select("template", "n"))
    tidy(spark)
    if doubtful.head(1):
        recur = settle(recur.unionByName(_strangers(known, found, wanted, lines, doubtful, min_docs)))
        tidy(spark)
    drop = settle(every.join(shuffled(recur), "template").select("template", "first_rk", "n"))
    hit = skew_join(known.select("rk", "template", "at"), drop, "template", "n").filter("rk <> first_rk")
    # Equal rows have the same places: a set holds them once.
    out = settle(hit.groupBy("rk").agg(F.flatten(F.collect_set("at")).alias("at")))
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return out


def rebuilt(df: DataFrame, *, min_docs: int = 3, similar: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """row (df's columns as they are), text (without the dropped lines), n_lines (not blank) and n_dropped."""
    gone = recurring(df, min_docs=min_docs, similar=similar, id_col=id_col, text_col=text_col)
    tidy(df.sparkSession)  # all that led to it goes before texts are shuffled
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))
    was = F.col("row")[text_col]
    text = F.coalesce(was.cast("string"), F.lit(""))
    met = rows.withColumn("rk", row_key(F.col("row")[id_col].cast("long"), text)).join(shuffled(gone), "rk", "left").withColumn("lines", F.split(text, "\n"))
    left = F.array_join(F.expr("transform(array_except(sequence(0, size(lines) - 1), at), i -> lines[i])"), "\n")
    counted = F.size(F.filter("lines", lambda x: x.rlike(r"[^\x20\x09-\x0D]"))).cast("long")
    return met.select("row", F.when(F.col("at").isNull(), was).otherwise(left).alias("text"), counted.alias("n_lines"), F.coalesce(F.when(F.col("at").isNotNull(), F.size("at")), F.lit(0)).cast("long").alias("n_dropped"))


def dedup(df: DataFrame, *, min_docs: int = 3, similar: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df with its text rebuilt without the dropped lines, and two more columns: n_lines (not blank) and n_dropped."""
    out = rebuilt(df, min_docs=min_docs, similar=similar, id_col=id_col, text_col=text_col)
    taken = {c.lower() for c in df.columns}

    def free(name: str) -> str:
        return next(c for c in (name, *(f"{name}_{k}" for k in range(len(taken) + 1))) if c.lower() not in taken)

    kept = [F.col("text").alias(c) if c == text_col else F.col("row")[c].alias(c) for c in df.columns]
    return out.select(*kept, F.col("n_lines").alias(free("n_lines")), F.col("n_dropped").alias(free("n_dropped")))
