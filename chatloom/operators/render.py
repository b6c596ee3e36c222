"""Renderings of a message array and sample projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatloom.functions.text import JS_SPACE, jstrim
from chatloom.operators.messages import clean_turns, valid_blocks

# Turn markers and the label of an untitled sample.
TURN_OPEN, TURN_CLOSE = "<|im_start|>", "<|im_end|>"
UNTITLED = "样本"
TITLE_LENGTH = 36


def _content(m: Column) -> Column:
    return F.coalesce(m["content"], F.lit(""))


def _turns(messages: Column) -> Column:
    return F.transform(
        messages, lambda m: F.concat(F.lit(TURN_OPEN), m["role"], F.lit("\n"), _content(m), F.lit(TURN_CLOSE))
    )


def render_training_text(messages: Column) -> Column:
    """Marked turns, closed by an open assistant turn."""
    return F.concat_ws("\n", _turns(messages), F.lit(f"{TURN_OPEN}assistant\n"))


def render_chatml(messages: Column) -> Column:
    """Marked turns, one line break after the last."""
    return F.concat(F.array_join(_turns(messages), "\n"), F.lit("\n"))


def render_prompt(messages: Column) -> Column:
    """``role: content`` lines and an open assistant line; a missing role is a user."""
    lines = F.transform(messages, lambda m: F.concat(F.coalesce(m["role"], F.lit("user")), F.lit(": "), _content(m)))
    return F.concat_ws("\n", lines, F.lit("assistant:"))


def sample_title(messages: Column, number: Column) -> Column:
    """Start of the first user message on one line, else a label with the sample's number."""
    first = F.get(F.filter(messages, lambda m: m["role"] == "user"), F.lit(0))["content"]
    line = jstrim(F.regexp_replace(F.coalesce(first, F.lit("")), f"[{JS_SPACE}]+", " "))
    title = F.substring(line, 1, TITLE_LENGTH)
    return F.when(title != "", title).otherwise(F.concat(F.lit(UNTITLED + " "), number.cast("string")))


def render_turns(
    turns: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """``key, n_messages, text``: training text of the valid conversations of a turn table.

    Turns are first put together per block of turn numbers, so one conversation may hold a large
    part of all turns; then the texts of its blocks, one row each, are put together in order. Only
    the result row grows with its conversation, which it is.
    """
    clean = clean_turns(turns, key, turn, role, text)
    fragment = F.concat(F.lit(TURN_OPEN), F.col("role"), F.lit("\n"), F.col("content"), F.lit(TURN_CLOSE + "\n"))
    blocks = (
        clean.filter("spoken")
        .groupBy(key, "block")
        .agg(F.sort_array(F.collect_list(F.struct(F.col(turn), fragment.alias("f")))).alias("_p"))
        .join(valid_blocks(clean, key, turn), [key, "block"])
        .select(
            key,
            F.size("_p").alias("_n"),
            F.struct("block", F.array_join(F.transform("_p", lambda p: p["f"]), "").alias("f")).alias("_b"),
        )
    )
    whole = blocks.groupBy(key).agg(
        F.sum("_n").cast("bigint").alias("n_messages"), F.sort_array(F.collect_list("_b")).alias("_b")
    )
    texts = F.array_join(F.transform("_b", lambda b: b["f"]), "")
    return whole.select(key, "n_messages", F.concat(texts, F.lit(f"{TURN_OPEN}assistant\n")).alias("text"))


def sample_stats(samples: DataFrame) -> DataFrame:
    """How many samples have how many messages."""
    sizes = samples.select(F.size("messages").cast("bigint").alias("messages"))
    return sizes.groupBy("messages").agg(F.count(F.lit(1)).alias("samples"))


def with_training_text(samples: DataFrame) -> DataFrame:
    return samples.withColumn("text", render_training_text(F.col("messages")))
