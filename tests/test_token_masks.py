import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomwork.operators import audit as A
from loomwork.operators import token_masks as Tm

MSG = "array<struct<role:string,content:string>>"


@pytest.fixture(scope="module")
def path():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def model(messages):
    """Text, and whether each character is generated."""
    text, made = "", []

    def add(t, generated):
        nonlocal text
        text += t
        made.extend([generated] * len(t))

    for role, content in messages or []:
        content = content or ""
        if role not in ("system", "user", "assistant"):
            continue
        add(f"<|im_start|>{role}\n", False)
        if role == "assistant":
            said = content
            if "<think>" in content and "</think>" in content:
                thought = content.split("</think>")[0].rstrip("\n").split("<think>")[-1].lstrip("\n")
                said = content.split("</think>")[-1].lstrip("\n")
                said = ("<think>\n" + thought.strip("\n") + "\n</think>\n\n" if thought else "") + said.lstrip("\n")
            add(said.lstrip("\n") + "<|im_end|>\n", True)
        else:
            add(content + "<|im_end|>\n", False)
    return text, made


CHATS = [
    [("user", "Question"), ("assistant", "Answer")],
    [("system", "be brief"), ("user", "a"), ("assistant", "<think>\nold\n</think>\n\nb"), ("user", "c"), ("assistant", "\n\n<think>\n\n</think>\n\nd")],
    [("user", "日本語 🙂🙂 é"), ("assistant", "🤦🏽‍♂️ naïve  text\n\nend"), ("assistant", ""), ("tool", "ignored"), ("assistant", None)],
    [("user", "no answer")],
    [],
    None,
    [("assistant", "<|im_end|> and <|im_start|> as text"), ("user", None)],
]


def test_masks_against_each_characters_token(spark, path):
    r = random.Random(2)
    rows = [(i, m, "clash") for i, m in enumerate(CHATS)]
    rows += [(100 + i, [(r.choice(["user", "assistant", "system"]), "".join(r.choices("ab \n1é日🙂'.<", k=r.randrange(40)))) for _ in range(r.randrange(6))], "clash") for i in range(80)]
    df = spark.createDataFrame(rows, f"id int, messages {MSG}, `mask_` string").repartition(3)
    got = {x.id: x for x in Tm.tokenized(df, path).collect()}
    t = Tm.tokenizer_of(path)
    for i, messages, _ in rows:
        text, made = model(messages)
        e = t.encode(text, add_special_tokens=False)
        want = [int(any(made[a:z])) for a, z in e.offsets]
        assert (got[i].input_ids, got[i].mask) == (e.ids, want), messages
        assert got[i].end_id == t.token_to_id("<|im_end|>") and got[i].mask_ == "clash"


def test_audit_of_real_tokens(spark, path):
    df = spark.createDataFrame([(i, m) for i, m in enumerate(CHATS)], f"id int, messages {MSG}")
    out = {r.id: r for r in A.audit_arrays(Tm.tokenized(df, path), 30, end=F.col("end_id")).collect()}
    assert out[0].end_supervised and out[0].eligible and out[0].original_spans == 1 and out[0].error is None
    assert out[3].error == "no_supervised_tokens" and out[4].error == "no_supervised_tokens" and not out[3].eligible
    assert out[1].truncated and out[1].exclusion_reason == "sequence_exceeds_max_length" and out[1].original_spans == 2


def test_the_tokenizer_sees_few_bytes_at_once(spark, path, monkeypatch):
    """A batch of many or long chats goes to the tokenizer in slices of about MOST_BYTES, and gives the same rows."""
    sizes, real = [], Tm.tokenizer_of

    class Seen:
        def __init__(self, p):
            self.t = real(p)

        def token_to_id(self, m):
            return self.t.token_to_id(m)

        def encode_batch(self, texts, **k):
            sizes.append([len(x.encode()) for x in texts])
            return self.t.encode_batch(texts, **k)

    chats = [[("user", "word " * (7 * k)), ("assistant", "an answer " * k)] for k in range(60)] + [None, [("user", "long " * 3000)]]
    rows = spark.createDataFrame([(i, m) for i, m in enumerate(chats)], f"id int, messages {MSG}").coalesce(1)
    want = sorted(map(tuple, Tm.tokenized(rows, path).select("id", "input_ids", "mask").collect()))
    shown = rows.withColumn("r", Tm.rendered()).select("id", F.coalesce("r.text", F.lit("")).alias("__t"), F.coalesce("r.spans.start", F.array().cast("array<int>")).alias("__a"), F.coalesce("r.spans.end", F.array().cast("array<int>")).alias("__z"))
    monkeypatch.setattr(Tm, "tokenizer_of", Seen)
    monkeypatch.setattr(Tm, "MOST_BYTES", 4000)
    got = []
    for b in Tm.encoded(iter(shown.toArrow().combine_chunks().to_batches()), path, ["id"]):
        got += zip(*(b.column(c).to_pylist() for c in ("id", "input_ids", "mask")), strict=True)
    assert sorted(got) == want and len(sizes) > 5
    assert all(sum(x) <= 4000 or len(x) == 1 for x in sizes)


# Ids, masks and what an audit must say of them; 99 ends an answer.
@pytest.mark.parametrize(
    ("ids", "mask", "most", "labels", "want"),
    [
        ([10, 11, 12, 20, 21, 99], [0, 0, 0, 1, 1, 1], 32, [-100, -100, -100, 20, 21, 99], {"supervised_tokens": 3, "end_supervised": True, "truncated": False, "error": None}),
        ([10, 20, 21, 99], [0, 1, 1, 0], 32, [-100, 20, 21, -100], {"supervised_tokens": 2, "end_supervised": False, "error": None, "eligible": True}),
        ([10, 20, 21, 99, 198], [0, 1, 1, 1, 1], 32, [-100, 20, 21, 99, 198], {"end_supervised": True, "error": None, "ends_with_supervised_token": True}),
        ([10, 20, 21, 99, 198], [0, 1, 1, 1, 1], 4, [-100, 20, 21, 99, 198], {"truncated": True, "end_supervised": True, "eligible": False, "exclusion_reason": "sequence_exceeds_max_length", "supervised_tokens": 3}),
        ([10, 11], [0, 0], 32, [-100, -100], {"error": "no_supervised_tokens", "eligible": False}),
        ([10, 20, 21, 99], [0, 1, 1, 0], 3, [-100, 20, 21, -100], {"eligible": False, "exclusion_reason": "sequence_exceeds_max_length"}),
        ([10, 20, 21, 99, 11, 30, 31, 99], [0, 1, 1, 0, 0, 1, 1, 0], 32, None, {"supervised_tokens": 4, "end_supervised": False, "supervised_spans": 2, "ends_with_supervised_token": False, "error": None}),
        ([10, 20, 21, 99, 11, 30, 31, 99], [0, 1, 1, 0, 0, 1, 1, 0], 6, None, {"eligible": False, "truncates_supervised_span": True}),
        ([10, 20, 21], [0, 1, 1], 32, None, {"error": "missing_end_boundary", "eligible": False}),
        ([10, 20], [0, 1, 1], 32, None, {"error": "inconsistent_lengths", "eligible": False}),
    ],
)
def test_audit_cases(spark, ids, mask, most, labels, want):
    df = spark.createDataFrame([(ids, mask)], "input_ids array<int>, mask array<int>")
    row = A.audit_arrays(df, most, end=F.lit(99)).withColumn("labels", A.labels(F.col("input_ids"), F.col("mask"))).first()
    assert {k: row[k] for k in want} == want
    assert labels is None or row.labels == labels


def test_excluded_reasons_and_distributions(spark):
    rows = [(i, "train" if i % 3 else "dev", [1] * (i + 1) + [99], [0] + [int(i != 4)] * i + [0]) for i in range(12)]
    audited = A.audit_arrays(spark.createDataFrame(rows, "id int, split string, input_ids array<int>, mask array<int>"), 8, end=F.lit(99))
    out = {(r.split, r.key): r.reason for r in A.excluded(audited, "split", "id").collect()}
    too_long = {("train" if i % 3 else "dev", i): "sequence_exceeds_max_length" for i in range(7, 12)}
    assert out == too_long | {("dev", 0): "no_supervised_tokens", ("train", 4): "no_supervised_tokens"}
    assert {(r.split, r.reason): r.n for r in A.reasons(audited, "split").collect()} == {("train", "sequence_exceeds_max_length"): 4, ("dev", "sequence_exceeds_max_length"): 1, ("dev", "no_supervised_tokens"): 1, ("train", "no_supervised_tokens"): 1}
    stats = {(r.split, r["count"]): r for r in A.distributions(audited, "split", (0.5,)).collect()}
    assert len(stats) == 6 and stats["dev", "original_tokens"].p50 == np.median([i + 2 for i in range(0, 12, 3)]) and stats["train", "sequence_tokens"].max == 8


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=15), st.lists(st.tuples(st.integers(0, 3), st.integers(0, 4)), max_size=5))
def test_covered_is_any_shared_character(widths, gaps):
    ends = np.cumsum([0, *widths])
    begin, end = ends[:-1], ends[1:]
    at, spans = 0, []
    for gap, size in gaps:
        spans.append((at + gap, at + gap + size))
        at += gap + size
    got = Tm.covered(begin, end, np.array([a for a, _ in spans], dtype=np.int64), np.array([z for _, z in spans], dtype=np.int64))
    assert got.tolist() == [int(any(max(b, a) < min(e, z) for a, z in spans)) for b, e in zip(begin.tolist(), end.tolist(), strict=True)]
