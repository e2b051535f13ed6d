"""Chat formatting by prefix-target expansion, in DataFrame functions only.

Every assistant turn becomes an example: all turns before it as context, and only that reply trainable.
A turn is written as TURN role TEXT text END. Texts and roles may hold any characters: a backslash is put
into every control string in them, and taken out again when read back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"

# Control strings of this and other common templates, after any number of backslashes.
_CONTROL = r"(\||/?s>|/?INST\]|<SYS>>|</SYS>>)"
_ESCAPE, _UNESCAPE = rf"([<\[])(\\*){_CONTROL}", rf"([<\[])\\(\\*){_CONTROL}"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPE, r"$1\\$2$3")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, _UNESCAPE, "$1$2$3")


def expand(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", trained_role: str = "assistant") -> DataFrame:
    """conv_id, part, example, formatted, loss_start, loss_length: one row per turn of `trained_role`.

    loss_start (from 0) and loss_length are code points of `formatted`; they span the reply's text alone.
    Turns after the last such turn make one more example without anything trainable (loss_length 0), so no
    turn is lost. Null roles and texts count as empty. Turns are ordered by turn, then role, then text;
    nulls come first, and repeated rows stay as turns of their own. Each row without conv_id is a
    conversation by itself, told apart by `part` (0 elsewhere). Texts are kept whole; an empty table gives
    no examples. Other columns are ignored.
    """
    part = F.when(F.col(conv_col).isNull(), 1 + F.monotonically_increasing_id()).otherwise(0)
    turns = conversations.select(
        F.col(conv_col).alias("conv_id"), part.alias("part"), F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).alias("t")
    )
    whole = turns.groupBy("conv_id", "part").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    head = lambda t: F.concat(F.lit(TURN), escaped(t["role"]), F.lit(TEXT))
    shown = F.transform("turns", lambda t: F.struct((t["role"] == trained_role).alias("trained"), head(t).alias("head"), escaped(t["text"]).alias("text")))
    whole = whole.select("conv_id", "part", shown.alias("turns"), F.transform("turns", lambda t: F.concat(head(t), escaped(t["text"]), F.lit(END))).alias("shown"))
    ends = F.filter(F.sequence(F.lit(1), F.size("turns")), lambda i: F.get("turns", i - 1)["trained"] | (i == F.size("turns")))
    example = whole.select("conv_id", "part", "turns", "shown", F.posexplode(ends).alias("example", "n"))
    before = F.array_join(F.expr("slice(shown, 1, n - 1)"), "")
    last = F.get("turns", F.col("n") - 1)
    example = example.select("conv_id", "part", "example", F.concat(before, last["head"]).alias("context"), last["text"].alias("reply"), last["trained"].alias("trained"))
    return example.select(
        "conv_id",
        "part",
        "example",
        F.concat("context", "reply", F.lit(END)).alias("formatted"),
        F.char_length("context").cast("long").alias("loss_start"),
        F.when(F.col("trained"), F.char_length("reply")).otherwise(0).cast("long").alias("loss_length"),
    )


def read_back(formatted: Column) -> Column:
    """array<struct<role, text>> of a formatted example."""
    parts = F.filter(F.split(formatted, r"<\|turn\|>"), lambda p: p != "")
    cut = lambda p: F.split(p, r"<\|text\|>", 2)
    return F.transform(parts, lambda p: F.struct(unescaped(F.get(cut(p), 0)).alias("role"), unescaped(F.regexp_replace(F.get(cut(p), 1), r"<\|end\|>\z", "")).alias("text")))


def trained_text(formatted: Column, start: Column, length: Column) -> Column:
    """What the loss mask covers, unescaped."""
    return unescaped(F.substring(formatted, start.cast("int") + 1, length.cast("int")))


def digests(examples: DataFrame) -> DataFrame:
    """Per conversation what its examples hold: turns, trainable text and formatted size, with digests."""
    loss = F.sort_array(F.collect_list(F.when(F.col("loss_length") > 0, F.struct("example", trained_text(F.col("formatted"), F.col("loss_start"), F.col("loss_length")).alias("text")))))
    each = examples.groupBy("conv_id", "part").agg(F.max_by("formatted", "example").alias("last"), loss.alias("loss"), F.sum(F.char_length("formatted")).alias("formatted_chars"))
    each = each.select("conv_id", read_back(F.col("last")).alias("turns"), F.array_join(F.transform("loss", lambda x: x["text"]), "").alias("loss"), "formatted_chars")
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return each.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.encode(F.array_join(lines, ""), "utf-8"), 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.encode("loss", "utf-8"), 256).alias("loss_sha256"),
        F.col("formatted_chars").cast("long").alias("formatted_chars"),
    )
