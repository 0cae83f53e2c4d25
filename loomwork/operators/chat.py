"""Conversations: assembly from turns, the grammar of roles, projections and shape counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.functions.session import settle
from loomwork.functions.text import prompt_hash

# The roles that a conversation may have.
ROLES = ("system", "user", "assistant")


def assemble(turns: DataFrame) -> DataFrame:
    """conv_id, messages in the order of their turns, and _ord (the conversation's id).

    Turns sort inside the group's array, so the rows of a conversation meet once, in one hash aggregate.
    """
    ordered = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    messages = F.transform(ordered, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("content")))
    return turns.groupBy("conv_id").agg(messages.alias("messages")).withColumn("_ord", F.col("conv_id"))


def with_category(chat: DataFrame) -> DataFrame:
    """A category by length, as strata for tables that have none."""
    n = F.size("messages")
    return chat.withColumn("category", F.when(n <= 3, "short").when(n <= 6, "medium").otherwise("long"))


def first_user(messages: Column | str = "messages") -> Column:
    m = F.col(messages) if isinstance(messages, str) else messages
    return F.get(F.filter(m, lambda x: x["role"] == "user"), F.lit(0))["content"]


def last_assistant(messages: Column | str = "messages") -> Column:
    m = F.col(messages) if isinstance(messages, str) else messages
    return F.try_element_at(F.filter(m, lambda x: x["role"] == "assistant"), F.lit(-1))["content"]


def error(messages: Column | str = "messages") -> Column:
    """The first broken rule of the role grammar, or null.

    Messages are judged in order and, within one, rule by rule; rules on the whole conversation come last.
    """
    m = F.col(messages) if isinstance(messages, str) else messages

    def at(x: Column, i: Column) -> Column:
        before = F.get(m, i - 1)["role"]
        role, content = x["role"], x["content"]
        after_system = (i == 1) & (before == "system")
        return (
            F.when(role.isNull() | ~role.isin(*ROLES), "unsupported_role")
            .when(content.isNull(), "content_not_text")
            .when((content == "") & ~((i == 0) & (role == "system")), "empty_content")
            .when((role == "system") & (i != 0), "system_not_first")
            .when(((i == 0) | after_system) & ~role.isin("user", "system"), "invalid_role_order")
            .when((role == "user") & (before == "user"), "consecutive_user")
        )

    first = F.get(F.filter(F.transform(m, at), lambda e: e.isNotNull()), F.lit(0))
    has = lambda r: F.exists(m, lambda x: x["role"] == r)
    return (
        F.when(m.isNull() | (F.size(m) == 0), "empty_messages")
        .when(first.isNotNull(), first)
        .when(~has("user") | ~has("assistant"), "missing_user_or_assistant")
        .when(F.element_at(m, -1)["role"] != "assistant", "not_ending_with_assistant")
    )


def validate(chat: DataFrame) -> DataFrame:
    return chat.withColumn("error", error())


def prepare(chat: DataFrame, source: str, split: str) -> DataFrame:
    """Adds id, source, source_split, source_row_index (by _ord) and the prompt's hash; invalid rows are the caller's to drop.

    Row numbers come from range-partitioned ranks, not from one global window.
    """
    ranked = with_rank(chat, "_ord").withColumn("source_row_index", F.col("rank") - 1).drop("rank")
    return ranked.withColumns({
        "id": F.format_string(f"{split}-%05d", "source_row_index"),
        "source": F.lit(source),
        "source_split": F.lit(split),
        "prompt_hash": prompt_hash(first_user()),
    })


def placed(df: DataFrame, *order: Column | str) -> tuple[DataFrame, list[int]]:
    """df in the order of the columns with __at, and the rows before each partition.

    __at is a partition's number in its high bits and the place in the partition in its low 33 bits. The rows are settled with
    it: range bounds are drawn from samples, so a second run of the same plan may cut elsewhere.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = settle(df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()))
    sizes = {r[0]: r[1] for r in rows.groupBy(F.shiftright("__at", 33).alias("p")).count().collect()}
    before, total = [], 0
    for p in range(max(sizes, default=0) + 1):
        before.append(total)
        total += sizes.get(p, 0)
    return rows, before


def place(before: list[int]) -> Column:
    """The place among all rows, from 1, of rows that ``placed`` gave."""
    return (F.get(F.lit(before), F.shiftright("__at", 33).cast("int")) + F.col("__at").bitwiseAND((1 << 33) - 1) + 1).cast("long")


def with_rank(df: DataFrame, *order: str) -> DataFrame:
    """rank: 1, 2, ... over all rows in the order of the columns, without bringing the rows to one task.

    Rows are range-partitioned, sorted and settled once; the driver sees one count a partition.
    """
    rows, before = placed(df, *order)
    return rows.withColumn("rank", place(before)).drop("__at")


def shape(chat: DataFrame) -> DataFrame:
    """One row: message counts and how many conversations have consecutive assistants or an empty leading system."""
    m = F.col("messages")
    pairs = F.exists(F.sequence(F.lit(0), F.size(m) - 1), lambda i: (i > 0) & (F.get(m, i)["role"] == "assistant") & (F.get(m, i - 1)["role"] == "assistant"))
    first = F.get(m, F.lit(0))
    return chat.agg(
        F.count("*").alias("conversations"),
        F.min(F.size(m)).cast("long").alias("min_messages"),
        F.max(F.size(m)).cast("long").alias("max_messages"),
        F.sum(F.size(m)).cast("long").alias("total_messages"),
        F.count_if(pairs).alias("consecutive_assistant"),
        F.count_if((first["role"] == "system") & (first["content"] == "")).alias("empty_leading_system"),
        F.count_if(first["role"] == "system").alias("with_system"),
    )


def render(messages: Column | str = "messages", *, generation: bool = False, no_think: bool = False) -> Column:
    """The chat as text of the ChatML form; with generation, the header of the answer to come."""
    m = F.col(messages) if isinstance(messages, str) else messages
    text = F.array_join(F.transform(m, lambda x: F.concat(F.lit("<|im_start|>"), x["role"], F.lit("\n"), x["content"], F.lit("<|im_end|>\n"))), "")
    if generation:
        text = F.concat(text, F.lit("<|im_start|>assistant\n" + ("<think>\n\n</think>\n\n" if no_think else "")))
    return text


def render_base(messages: Column | str = "messages") -> Column:
    """The chat in the base form: thoughts stay only after the last user message, and the last answer always shows a block for them."""
    m = F.col(messages) if isinstance(messages, str) else messages
    newlines = lambda c, side: F.regexp_replace(c, r"\A\n+" if side == "left" else r"\n+\z", "")
    asked = F.array_max(F.transform(m, lambda x, i: F.when(x["role"] == "user", i).otherwise(-1)))

    def said(x: Column, i: Column) -> Column:
        head = F.concat(F.lit("<|im_start|>"), x["role"], F.lit("\n"))
        text = x["content"]
        parted = F.contains(text, F.lit("</think>"))
        thought = F.when(parted, newlines(F.substring_index(newlines(F.substring_index(text, "</think>", 1), "right"), "<think>", -1), "left")).otherwise("")
        answer = F.when(parted, newlines(F.substring_index(text, "</think>", -1), "left")).otherwise(text)
        shown = (i > asked) & ((i == F.size(m) - 1) | (thought != ""))
        block = F.concat(F.lit("<think>\n"), newlines(newlines(thought, "left"), "right"), F.lit("\n</think>\n\n"), newlines(answer, "left"))
        return F.concat(head, F.when(x["role"] != "assistant", text).when(shown, block).otherwise(answer), F.lit("<|im_end|>\n"))

    return F.array_join(F.transform(m, said), "")


def stop_ids(vocabulary: dict[str, int], end: str = "<|im_end|>", eos: str | None = "<|endoftext|>", unknown: int | None = None) -> dict[str, int]:
    """Ids that end a generation, of a tokenizer's vocabulary; a missing one is an error."""
    if vocabulary.get(end) is None or vocabulary[end] == unknown:
        raise ValueError(f"tokenizer does not define {end}")
    if eos is None or vocabulary.get(eos) is None:
        raise ValueError("tokenizer does not define an end of text")
    return {"im_end": int(vocabulary[end]), "endoftext": int(vocabulary[eos])}


def training_form(native: str, base: str, training: str, patched: str | None = None) -> str:
    """The training template: a patched one, or the own one where the native template is the base; it must mark generations."""
    chosen = patched if patched is not None else training if native.strip() == base.strip() else None
    if chosen is None:
        raise ValueError("the chat template cannot be trained on, and there is no patch for it")
    if "{% generation" not in chosen and "{%- generation" not in chosen:
        raise ValueError("training chat template has no generation markers")
    return chosen
