"""Chat formatting as relational work: Spark expressions only, from rows by turn to one string for each conversation.

    <s><|turn|>user<|text|>first text<|next|>second text of the same role<|end|><|turn|>assistant<|text|>...<|end|></s>

Adjacent turns of one role become one block, whose texts stay apart by <|next|>. Inside roles and texts every
backslash is doubled and every control string gets a backslash after its first character; nothing else can look like
that, so both steps can be undone. The loss mask covers the texts of assistant blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barscreen.llm.common import narrow

ANSWERS = "assistant"
#: What begins every control string: of this template, and of templates that a text may have been copied from.
CONTROL = r"<\||</?s>|\[/?INST\]"


def escaped(text: Column) -> Column:
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(doubled, rf"([<\[])(?=(?<=<)\||(?<=<)/?s>|(?<=\[)/?INST\])", r"$1\\")


def unescaped(text: Column) -> Column:
    plain = F.regexp_replace(text, r"(?<=<)\\(?=\||/?s>)|(?<=\[)\\(?=/?INST\])", "")
    return F.replace(plain, F.lit("\\\\"), F.lit("\\"))


def formatted(conversations: DataFrame) -> DataFrame:
    """(conv_id, formatted): one row for each conv_id of conversations (conv_id, turn, role, text; others are ignored).

    Turns are in order of turn, then role, then text, with nulls first; repeated rows stay. A null role or text counts
    as empty. Rows with a null conv_id form one conversation. A conversation is one string, so it must fit one row; within
    that, texts of any length are whole. An empty table gives no rows.
    """
    rows = narrow(conversations, "conv_id", "turn", "role", "text")
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("t"))
    role_at = lambda k: F.element_at("t", k)["role"]
    starts = F.filter(F.sequence(F.lit(1), F.size("t")), lambda k: (k == 1) | (role_at(k) != role_at(F.greatest(k - 1, F.lit(1)))))
    turns = turns.withColumn("starts", starts)

    def block(start: Column, k: Column) -> Column:
        length = F.coalesce(F.get("starts", k + 1), F.size("t") + 1) - start
        texts = F.transform(F.slice("t", start, length), lambda t: escaped(t["text"]))
        return F.concat(F.lit("<|turn|>"), escaped(role_at(start)), F.lit("<|text|>"), F.array_join(texts, "<|next|>"), F.lit("<|end|>"))

    return turns.select("conv_id", F.concat(F.lit("<s>"), F.array_join(F.transform("starts", block), ""), F.lit("</s>")).alias("formatted"))


def turns_of(text: Column) -> Column:
    """The array of (role, text) that a formatted conversation was made from."""
    blocks = F.slice(F.split(text, r"<\|turn\|>"), F.lit(2), F.size(F.split(text, r"<\|turn\|>")))

    def one(block: Column) -> Column:
        role = unescaped(F.substring_index(block, "<|text|>", 1))
        body = F.split(F.substring_index(F.substring_index(block, "<|text|>", -1), "<|end|>", 1), r"<\|next\|>")
        return F.transform(body, lambda t: F.struct(role.alias("role"), unescaped(t).alias("text")))

    return F.flatten(F.transform(blocks, one))


def digests(conversations: DataFrame) -> DataFrame:
    """What the formatted conversations hold, read back from them."""
    back = formatted(conversations).withColumn("turns", turns_of(F.col("formatted")))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("turns", lambda t: t["role"] == ANSWERS), lambda t: t["text"]), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(whole, 256).alias("turns_sha256"),
        F.length(loss).cast("bigint").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )
