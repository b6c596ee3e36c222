"""Operators on a message array: roles, system prompt, blank messages, validity.

Arguments are SQL expression texts, usually a column name; ``*_sql`` give text for nesting.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from chatloom.functions.records import bind, case, lit
from chatloom.functions.text import PY_SPACE, pystrip

MESSAGES = "array<struct<role:string,content:string>>"

# Spelling of a role -> canonical role.
ROLE_ALIASES = {
    "user": "user",
    "human": "user",
    "instruction": "user",
    "prompt": "user",
    "assistant": "assistant",
    "gpt": "assistant",
    "bot": "assistant",
    "chatgpt": "assistant",
    "model": "assistant",
    "system": "system",
}


def message(role: Column, content: Column) -> Column:
    return F.struct(role.alias("role"), content.alias("content"))


def message_sql(role: str, content: str) -> str:
    return f"named_struct('role', {role}, 'content', {content})"


def strip_sql(text: str) -> str:
    return f"btrim({text}, {lit(PY_SPACE)})"


def role_sql(role: str) -> str:
    aliases = ", ".join(f"{lit(k)}, {lit(v)}" for k, v in ROLE_ALIASES.items())
    return f"try_element_at(map({aliases}), lower({strip_sql(role)}))"


def with_system_sql(messages: str, prompt: str) -> str:
    if not prompt.strip(PY_SPACE):
        return messages
    system = message_sql("'system'", lit(prompt))
    filled = f"transform({messages}, (m, i) -> CASE WHEN i = 0 AND coalesce(m.content, '') = '' THEN {system} ELSE m END)"
    return case(
        (f"coalesce(get({messages}, 0).role = 'system', false)", filled), otherwise=f"concat(array({system}), {messages})"
    )


def drop_empty_sql(messages: str) -> str:
    normal = f"transform({messages}, m -> {message_sql(role_sql('m.role'), strip_sql('m.content'))})"
    known = "NOT exists(n, m -> m.role IS NULL)"
    return bind(normal, "n", f"CASE WHEN {known} THEN filter(n, m -> coalesce(m.content, '') <> '') END")


def missing_role_sql(messages: str) -> str:
    return case(
        (f"NOT exists({messages}, m -> m.role = 'user')", "'no_user'"),
        (f"NOT exists({messages}, m -> m.role = 'assistant')", "'no_assistant'"),
    )


def validate_sql(messages: str) -> str:
    reason = case(
        ("s.n IS NULL OR s.n < 0", "'bad_messages'"),
        ("s.n = 0", "'empty_messages'"),
        ("s.kept IS NULL", "'unsupported_role'"),
        otherwise=missing_role_sql("s.kept"),
    )
    staged = f"named_struct('n', size({messages}), 'kept', {drop_empty_sql(messages)})"
    return bind(staged, "s", f"named_struct('messages', s.kept, 'reason', {reason})")


def normalize_role(role: str) -> Column:
    """Canonical role, or null for an unknown one."""
    return F.expr(role_sql(role))


def with_system(messages: str, prompt: str) -> Column:
    """Put a system prompt first. A leading message with the exact role ``system`` stays in
    place, and takes the prompt only when its own content is missing or empty."""
    return F.expr(with_system_sql(messages, prompt))


def drop_empty_messages(messages: str) -> Column:
    """Normalised messages without the blank ones; null if any role is unknown, blank or not."""
    return F.expr(drop_empty_sql(messages))


def missing_role(messages: str) -> Column:
    """Reason why normalised messages are no sample, or null."""
    return F.expr(missing_role_sql(messages))


def validate(messages: str) -> Column:
    """``struct<messages, reason>``: the clean sample, or the reason it is rejected."""
    return F.expr(validate_sql(messages))


def load_system_prompt(spark: SparkSession, path: str | None) -> str:
    """Stripped text of a small prompt file; a missing file is an empty prompt."""
    if not path:
        return ""
    try:
        rows = spark.read.text(path, wholetext=True).take(1)
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        return ""
    return rows[0].value.strip() if rows else ""


def samples_from_turns(
    turns: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """One row per conversation. The result row holds the whole conversation by definition;
    operators on single turns should use the turn table as it is (see ``evaluate.gold_turns``)."""
    entry = F.struct(F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("content"))
    return turns.groupBy(key).agg(F.sort_array(F.collect_list(entry)).alias("_turns")).select(
        key, F.transform("_turns", lambda t: message(t["role"], t["content"])).alias("messages")
    )


# Turn numbers per block: what is grouped or joined by conversation and block stays bounded,
# however long a conversation is.
TURN_BLOCK = 1024


def clean_turns(turns: DataFrame, key: str, turn: str, role: str, text: str) -> DataFrame:
    """``key, block, turn, role, content, spoken``: one row per turn, no shuffle."""
    clean = turns.select(
        key,
        F.expr(f"`{turn}` div {TURN_BLOCK}").alias("block"),
        turn,
        normalize_role(role).alias("role"),
        pystrip(F.col(text)).alias("content"),
    )
    return clean.withColumn("spoken", F.coalesce("content", F.lit("")) != "")


def valid_blocks(clean: DataFrame, key: str, turn: str) -> DataFrame:
    """``key, block, last_turn`` of the valid conversations.

    Turns are counted into one small row per block before the shuffle; only those rows meet per
    conversation. Joins on (key, block) therefore need no care for a conversation that holds a
    large part of all turns.
    """
    said = lambda role: F.bool_or(F.col("spoken") & (F.col("role") == role))
    blocks = clean.groupBy(key, "block").agg(
        F.bool_and(F.col("role").isNotNull()).alias("_known"),
        said("user").alias("_user"),
        said("assistant").alias("_assistant"),
        F.max(F.when(F.col("spoken"), F.col(turn))).alias("_last"),
    )
    whole = W.partitionBy(key)
    judged = blocks.select(
        key,
        "block",
        (F.bool_and("_known").over(whole) & F.bool_or("_user").over(whole) & F.bool_or("_assistant").over(whole)).alias("_ok"),
        F.max("_last").over(whole).alias("last_turn"),
    )
    return judged.filter("_ok").drop("_ok")


def valid_turns(
    turns: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """``key, turn, role, content``: the clean messages of the valid conversations, as turns.

    No array is built, so a conversation of any length stays spread over tasks.
    """
    clean = clean_turns(turns, key, turn, role, text)
    spoken = clean.filter("spoken").drop("spoken")
    return spoken.join(valid_blocks(clean, key, turn), [key, "block"]).drop("block", "last_turn")
