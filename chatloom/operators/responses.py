"""Request and response logs: reasoning, usage, normal form, streamed chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatloom.functions.records import (
    at,
    bind,
    case,
    describe,
    field,
    first_truthy,
    is_object,
    is_truthy,
    items,
    js_falsy,
    lit,
    py_text,
    strict_json,
)
from chatloom.functions.text import is_blank, pystrip
from chatloom.operators.messages import MESSAGES, message_sql, strip_sql

# The completion budget, the lowest sampling temperature, the reasoning marks.
DEFAULT_MAX_TOKENS = 256
MIN_TEMPERATURE = 0.01
THINK_OPEN, THINK_CLOSE = "<think>", "</think>"
_THINK = rf"(?s){THINK_OPEN}(.*?){THINK_CLOSE}"


def extract_reasoning(content: Column) -> Column:
    """Text of the first reasoning block, stripped; null when there is none."""
    return F.when(content.rlike(_THINK), pystrip(F.regexp_extract(content, _THINK, 1)))


def merge_reasoning(content: Column, reasoning: Column) -> Column:
    """Put stripped reasoning in front of a content that has no reasoning block."""
    text = F.coalesce(content, F.lit(""))
    wanted = ~is_blank(reasoning) & ~F.contains(text, F.lit(THINK_OPEN))
    return F.when(wanted, F.concat(F.lit(THINK_OPEN), pystrip(reasoning), F.lit(THINK_CLOSE), text)).otherwise(text)


def merge_reasoning_raw(content: Column, reasoning: Column) -> Column:
    """The same for drafts: reasoning is taken as it is, and only the empty text counts as none."""
    text, reason = F.coalesce(content, F.lit("")), F.coalesce(reasoning, F.lit(""))
    wanted = (reason != "") & ~F.contains(text, F.lit(THINK_OPEN))
    return F.when(wanted, F.concat(F.lit(THINK_OPEN), reason, F.lit(THINK_CLOSE), text)).otherwise(text)


def strip_specials(text: Column, specials: tuple[str, ...]) -> Column:
    """Remove wrapper tokens, longest first, but none that names reasoning; then strip."""
    out = F.coalesce(text, F.lit(""))
    wrappers = {s for s in specials if s and "think" not in s.lower()}
    for special in sorted(wrappers, key=lambda s: (-len(s), s)):
        out = F.replace(out, F.lit(special), F.lit(""))
    return pystrip(out)


# Texts that count as a whole or as any number.
_INT_TEXT = r"^[+-]?\d+(_\d+)*$"
_FLOAT_TEXT = r"^[+-]?(\d+(_\d+)*\.?(\d+(_\d+)*)?|\.\d+(_\d+)*)([eE][+-]?\d+)?$"
_NUMBER_KIND = "^(BIGINT|DECIMAL|DOUBLE|FLOAT)"


def _as_number(value: str, pattern: str, kind: str, through: str) -> str:
    """A number, a truth value or a number text as ``kind``; anything else is null."""
    plain = f"replace({strip_sql('d.text')}, '_', '')"
    number = case(
        ("d.kind = 'STRING'", case((f"{strip_sql('d.text')} RLIKE {lit(pattern)}", f"try_cast({plain} as {kind})"))),
        ("d.kind = 'BOOLEAN'", f"cast(d.text = 'True' as {kind})"),
        (f"d.kind RLIKE {lit(_NUMBER_KIND)}", f"try_cast(try_cast(d.text as {through}) as {kind})"),
    )
    return bind(describe(value), "d", number)


def _as_int(value: str) -> str:
    return _as_number(value, _INT_TEXT, "bigint", "decimal(38,6)")


def _as_double(value: str) -> str:
    return _as_number(value, _FLOAT_TEXT, "double", "double")


def _given(value: str) -> str:
    """A value that is present and not null."""
    return f"({value} IS NOT NULL AND NOT is_variant_null({value}))"


def normalize_request(
    requests: DataFrame, default_thinking: bool = False, default_model: str = "", payload: str = "payload", chat: str = "chat"
) -> DataFrame:
    """Normal form of logged request bodies.

    ``payload`` is the body text, ``chat`` says whether it went to the chat endpoint. A body that
    is no JSON object has ``ok = false`` and the defaults.
    """
    get = lambda key: field("_v", key)
    budget = case(
        (_given(get("max_tokens")), _as_int(get("max_tokens"))),
        (_given(get("max_completion_tokens")), _as_int(get("max_completion_tokens"))),
    )
    template, usage = at("_v", "$.chat_template_kwargs.enable_thinking"), at("_v", "$.stream_options.include_usage")
    thinking = case(
        (f"{get('enable_thinking')} IS NOT NULL", is_truthy(get("enable_thinking"))),
        (f"{template} IS NOT NULL", is_truthy(template)),
        otherwise=str(default_thinking).lower(),
    )
    listed, prompt = items(get("messages")), f"coalesce({first_truthy(get('prompt'))}, '')"
    asked = message_sql(py_text(field("x", "role"), "None", "user"), py_text(field("x", "content"), "None", ""))
    messages = case(
        (f"size({listed}) > 0", f"transform({listed}, x -> {asked})"), otherwise=f"array({message_sql(lit('user'), prompt)})"
    )
    first = f"get({items(get('prompt'))}, 0)"
    columns = {
        "ok": f"coalesce({is_object('_v')}, false)",
        "max_tokens": f"greatest(1L, coalesce({budget}, {DEFAULT_MAX_TOKENS}L))",
        "temperature": f"coalesce({_as_double(get('temperature'))}, 0.0D)",
        "enable_thinking": thinking,
        "include_usage": case((f"{usage} IS NOT NULL", is_truthy(usage)), otherwise="true"),
        "stream": is_truthy(get("stream")),
        "model": f"coalesce({first_truthy(get('model'))}, {lit(default_model)})",
        "messages": case((f"`{chat}`", f"cast({messages} as {MESSAGES})")),
        "prompt": case((f"NOT `{chat}`", case((f"{first} IS NOT NULL", py_text(first, "None", "")), otherwise=prompt))),
    }
    parsed = requests.withColumn("_v", F.expr(strict_json(f"`{payload}`")))
    staged = parsed.select(*requests.columns, *[F.expr(text).alias(name) for name, text in columns.items()])
    sampled = F.col("temperature") > 0
    return staged.withColumn("do_sample", sampled).withColumn(
        "sampling_temperature", F.when(sampled, F.greatest(F.col("temperature"), F.lit(MIN_TEMPERATURE)))
    )


def usage_rollup(usage: DataFrame, *keys: str) -> DataFrame:
    """Token totals per key; requests that generated nothing are counted apart."""
    total = F.col("prompt_tokens") + F.col("completion_tokens")
    return usage.groupBy(*(keys or ("model",))).agg(
        F.count(F.lit(1)).alias("requests"),
        F.sum("prompt_tokens").alias("prompt_tokens"),
        F.sum("completion_tokens").alias("completion_tokens"),
        F.sum(total).alias("total_tokens"),
        F.count_if(F.col("completion_tokens") == 0).alias("empty_completions"),
    )


def parse_responses(responses: DataFrame, body: str = "body", status: str | None = None) -> DataFrame:
    """Add ``text`` or ``error`` to logged completion responses.

    The text is the first choice's content with its reasoning in front. A failed status gives the
    body's error message, else ``HTTP <status>``; an answer without text is ``empty content``.
    """
    found = responses.withColumn("_v", F.expr(strict_json(f"`{body}`"))).withColumn(
        "_msg", F.expr(at("_v", "$.choices[0].message"))
    )
    read = found.select(
        *responses.columns,
        F.expr(first_truthy(field("_msg", "content"), falsy=js_falsy)).alias("_content"),
        F.expr(first_truthy(field("_msg", "reasoning_content"), field("_msg", "reasoning"), falsy=js_falsy)).alias("_reason"),
        F.expr(first_truthy(at("_v", "$.error.message"), falsy=js_falsy)).alias("_told"),
    )
    failed = F.lit(False) if status is None else ~F.col(status).between(200, 299)
    http = F.lit("HTTP") if status is None else F.concat(F.lit("HTTP "), F.col(status).cast("string"))
    text = merge_reasoning_raw(F.col("_content"), F.col("_reason"))
    merged = F.struct(
        F.when(~failed & (text != ""), text).alias("text"),
        F.when(failed, F.coalesce("_told", http)).when(text == "", "empty content").alias("error"),
    )
    # A one-row generator keeps a later filter on the outcome from repeating the parse.
    return read.withColumn("_outcome", F.explode(F.array(merged))).select(
        *responses.columns, F.col("_outcome.text").alias("text"), F.col("_outcome.error").alias("error")
    )


# Chunks per partial text: long completions are concatenated piece-wise before they meet.
CHUNK_BLOCK = 256


def assemble_chunks(chunks: DataFrame, key: str = "id", seq: str = "seq") -> DataFrame:
    """One row per completion: content in order, the last finish reason and usage.

    A first aggregation joins up to 256 neighbouring chunks, so one completion with very many
    chunks is spread over tasks and only its partial texts meet in one group.
    """
    first = (
        chunks.groupBy(key, F.floor(F.col(seq) / CHUNK_BLOCK).alias("_block"))
        .agg(
            F.sort_array(F.collect_list(F.struct(F.col(seq), F.coalesce("content", F.lit("")).alias("c")))).alias("_p"),
            F.max(F.when(F.col("finish_reason").isNotNull(), F.struct(F.col(seq), F.col("finish_reason").alias("v")))).alias("_f"),
            F.max(F.when(F.col("total_tokens").isNotNull(), F.struct(F.col(seq), F.col("total_tokens").alias("v")))).alias("_u"),
            F.count(F.lit(1)).alias("_n"),
        )
        .withColumn("_p", F.array_join(F.transform("_p", lambda p: p["c"]), ""))
    )
    whole = first.groupBy(key).agg(
        F.sort_array(F.collect_list(F.struct("_block", "_p"))).alias("_p"),
        F.max("_f").alias("_f"), F.max("_u").alias("_u"), F.sum("_n").alias("chunks"),
    )
    return whole.select(
        key,
        F.array_join(F.transform("_p", lambda p: p["_p"]), "").alias("content"),
        F.col("_f.v").alias("finish_reason"),
        F.col("_u.v").alias("total_tokens"),
        "chunks",
    )
