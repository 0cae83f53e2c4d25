"""Assistant masks over a real tokenizer's tokens: character spans of what is generated, merged with the tokens' offsets.

A chat is rendered in its training form as segments, each with whether it is generated. The tokenizer runs over the whole text in Arrow batches, as it would for
training, and gives ids and the characters that each token covers. Both lists are sorted, so the tokens of a span are those between two places found by binary search: from the token that
holds its first character to the one that holds its last. The arrays go to ``audit.audit_arrays``.

The tokenizer is a file of the tokenizers library, given by its path; marks of the form that its vocabulary lacks are added as special tokens. Null chats have no tokens; a null content is an empty
one. Characters that a tokenizer covers by several tokens, or drops, are covered by those tokens, or none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwork.functions.text import col, let

# The marks of the form.
START, END = "<|im_start|>", "<|im_end|>"


def _bare(c: Column, side: str) -> Column:
    return F.regexp_replace(c, r"\A\n+" if side == "left" else r"\n+\z", "")


def training_text(content: Column) -> Column:
    """An answer in its training form: a thought between its tags on lines of its own, if there is one; an empty thought is left out."""
    both = F.contains(content, F.lit("<think>")) & F.contains(content, F.lit("</think>"))
    thought = _bare(F.substring_index(_bare(F.substring_index(content, "</think>", 1), "right"), "<think>", -1), "left")
    answer = F.when(both, _bare(F.substring_index(content, "</think>", -1), "left")).otherwise(content)
    block = lambda t: F.concat(F.lit("<think>\n"), _bare(_bare(t, "left"), "right"), F.lit("\n</think>\n\n"))
    return F.concat(F.when(both & (thought != ""), block(thought)).otherwise(""), _bare(answer, "left"))


def segments(messages: Column | str = "messages") -> Column:
    """array of struct(text, generated): headers and what is said to the model are not generated, an answer with its end mark is.

    A system message counts where it comes first or later alike; messages of other roles than system, user and assistant are not rendered.
    """

    def of(m: Column) -> Column:
        content = F.coalesce(m["content"], F.lit(""))
        seg = lambda text, generated: F.struct(text.alias("text"), F.lit(generated).alias("generated"))
        head = F.concat(F.lit(START), m["role"], F.lit("\n"))
        end = F.lit(END + "\n")
        none = F.array().cast("array<struct<text: string, generated: boolean>>")
        return F.when(m["role"] == "assistant", F.array(seg(head, False), seg(F.concat(training_text(content), end), True))).when(m["role"].isin("system", "user"), F.array(seg(F.concat(head, content, end), False))).otherwise(none)

    return F.flatten(F.transform(col(messages), of))


def rendered(messages: Column | str = "messages") -> Column:
    """struct(text, spans): the training form, and (start, end) of the characters that are generated, end not included."""

    def of(s: Column) -> Column:
        upto = F.aggregate(s, F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + F.char_length(x["text"]))))

        def spans(u: Column) -> Column:
            each = F.transform(s, lambda x, i: F.struct(x["generated"].alias("g"), F.get(u, i).alias("start"), F.get(u, i + 1).alias("end")))
            return F.transform(F.filter(each, lambda x: x["g"]), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))

        return F.struct(F.array_join(F.transform(s, lambda x: x["text"]), "").alias("text"), let(upto, spans).alias("spans"))

    return let(segments(messages), of)


def covered(begin: np.ndarray, end: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """1 for each token that covers a character of a span. Tokens and spans come in order, tokens may be empty or share characters."""
    n = len(begin)
    # From the first token that ends after the start to the last that begins before the end.
    first, last = np.searchsorted(end, starts, side="right"), np.searchsorted(begin, ends, side="left")
    marks = np.zeros(n + 1, dtype=np.int64)
    full = (ends > starts) & (last > first)
    np.add.at(marks, first[full], 1)
    np.add.at(marks, last[full], -1)
    return ((np.cumsum(marks[:-1]) > 0) & (end > begin)).astype(np.int32)


def tokenizer_of(path: str):
    """The tokenizer of a file, with the marks of the form as special tokens."""
    from tokenizers import AddedToken, Tokenizer

    t = Tokenizer.from_file(path)
    t.add_special_tokens([AddedToken(m, special=True) for m in (START, END) if t.token_to_id(m) is None])
    return t


#: Bytes of text that the tokenizer sees at once: what it returns for a token is some hundred bytes.
MOST_BYTES = 1 << 20


def _slices(batch: pa.RecordBatch, most_bytes: int) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of about most_bytes of text, or of one row that is longer."""
    upto = np.cumsum(pc.binary_length(batch.column("__t")).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + most_bytes, side="right")))
        yield batch.slice(at, to - at)
        at = to


def encoded(batches: Iterator[pa.RecordBatch], path: str, given: list[str]) -> Iterator[pa.RecordBatch]:
    """The columns given, input_ids, mask and end_id of rows with a text (__t) and the first and end of each span (__a, __z)."""
    t = tokenizer_of(path)
    end_id = t.token_to_id(END)
    for b in (x for batch in batches for x in _slices(batch, MOST_BYTES)):
        texts, starts, ends = (b.column(c).to_pylist() for c in ("__t", "__a", "__z"))
        ids, masks = [], []
        for e, a, z in zip(t.encode_batch(texts, add_special_tokens=False), starts, ends, strict=True):
            offsets = np.array(e.offsets, dtype=np.int64).reshape(-1, 2)
            ids.append(np.array(e.ids, dtype=np.int32))
            masks.append(covered(offsets[:, 0], offsets[:, 1], np.array(a, dtype=np.int64), np.array(z, dtype=np.int64)))
        kept = [b.column(c) for c in given]
        yield pa.RecordBatch.from_arrays([*kept, pa.array(ids, pa.list_(pa.int32())), pa.array(masks, pa.list_(pa.int32())), pa.array([end_id] * len(ids), pa.int32())], names=[*given, "input_ids", "mask", "end_id"])


def tokenized(df: DataFrame, path: str, messages: str = "messages") -> DataFrame:
    """df with input_ids, mask (1 where a token is generated) and end_id; df's own columns pass through."""
    new = T.StructType([T.StructField("input_ids", T.ArrayType(T.IntegerType())), T.StructField("mask", T.ArrayType(T.IntegerType())), T.StructField("end_id", T.IntegerType())])
    given = df.columns
    shown = df.withColumn("__r", rendered(messages)).withColumns({"__t": F.coalesce("__r.text", F.lit("")), "__a": F.coalesce("__r.spans.start", F.array().cast("array<int>")), "__z": F.coalesce("__r.spans.end", F.array().cast("array<int>"))}).drop("__r")
    return shown.mapInArrow(lambda batches: encoded(batches, path, given), T.StructType([*df.schema.fields, *new.fields]))
