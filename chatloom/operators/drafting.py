"""Synthetic-data drafting: request batches out, drafted samples back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatloom.functions.records import bind, case, describe, field, first_truthy, is_truthy, items, js_falsy, lit, strict_json
from chatloom.functions.text import JS_SPACE, js_blank, jstrim
from chatloom.operators.messages import message

# The drafting instruction and its request parameters. The user text holds a
# backslash and an n where one would expect a line break.
PROMPT_WRITER = (
    "You write user prompts for a ChatML training set. Return ONLY a JSON array of strings. "
    "No markdown. Each item is one user message. Language follows the topic."
)
TOPIC_PREFIX, COUNT_PREFIX = r"Topic:\n", r"\n\nCount: "
DRAFT_TEMPERATURE, DRAFT_MAX_TOKENS = 0.9, 1024


def build_generation_batch(
    prompts: DataFrame,
    candidates: int,
    model: str,
    temperature: float = 0.7,
    max_tokens: int = 256,
    thinking: bool = False,
    prompt: str = "prompt",
) -> DataFrame:
    """``candidates`` request bodies per non-blank prompt: adds ``candidate`` and ``body``."""
    asked = F.array(message(F.lit("user"), jstrim(F.col(prompt))))
    body = F.to_json(
        F.struct(
            F.lit(model).alias("model"),
            asked.alias("messages"),
            F.lit(float(temperature)).alias("temperature"),
            F.lit(max(1, max_tokens)).alias("max_tokens"),
            F.lit(False).alias("stream"),
            F.lit(thinking).alias("enable_thinking"),
            F.struct(F.lit(thinking).alias("enable_thinking")).alias("chat_template_kwargs"),
        )
    )
    numbers = F.explode(F.sequence(F.lit(1), F.lit(max(1, candidates)))).alias("candidate")
    bodies = prompts.filter(~js_blank(F.col(prompt))).withColumn("body", body)
    return bodies.select(*prompts.columns, numbers, "body")


def build_eval_batch(gold: DataFrame, model: str) -> DataFrame:
    """One greedy request per gold turn, from its prompt messages."""
    body = F.to_json(
        F.struct(F.lit(model).alias("model"), F.col("prompt").alias("messages"), F.lit(0).alias("temperature"))
    )
    return gold.withColumn("body", body).drop("prompt", "gold")


def build_prompt_requests(topics: DataFrame, model: str, count: int = 8, topic: str = "topic") -> DataFrame:
    """One prompt-writing request per non-blank topic."""
    user = F.concat(F.lit(TOPIC_PREFIX), jstrim(F.col(topic)), F.lit(f"{COUNT_PREFIX}{max(1, count)}"))
    body = F.to_json(
        F.struct(
            F.lit(model).alias("model"),
            F.array(message(F.lit("system"), F.lit(PROMPT_WRITER)), message(F.lit("user"), user)).alias("messages"),
            F.lit(False).alias("stream"),
            F.lit(DRAFT_TEMPERATURE).alias("temperature"),
            F.lit(DRAFT_MAX_TOKENS).alias("max_tokens"),
        )
    )
    return topics.filter(~js_blank(F.col(topic))).withColumn("body", body)


_FENCE = rf"```(?:json)?[{JS_SPACE}]*([\s\S]*?)```"
_NUMBERING = rf"^[{JS_SPACE}]*[0-9]+[.)][{JS_SPACE}]*"
_BULLET = rf"^[-*][{JS_SPACE}]*"


def _trim(text: str) -> str:
    return f"btrim({text}, {lit(JS_SPACE)})"


def _listed(parsed: str) -> str:
    """Prompts of a parsed JSON answer, or null when it has neither accepted layout."""
    whole, inner = items(parsed), items(field(parsed, "prompts"))
    named = f"coalesce({first_truthy(field('x', 'prompt'), field('x', 'content'), falsy=js_falsy)}, '')"
    entry = bind(describe("x", js=True), "e", case(("e.kind = 'STRING'", "e.text"), otherwise=named))
    kept = f"filter(transform({whole}, x -> {entry}), s -> s <> '')"
    prompts = f"transform(filter({inner}, x -> {is_truthy('x', js_falsy)}), x -> {describe('x', js=True)}.text)"
    no_null = f"NOT exists({whole}, x -> is_variant_null(x))"
    return case((f"{whole} IS NOT NULL", case((no_null, kept))), otherwise=prompts)


def _stringified(parsed: str) -> str:
    text = case(
        ("e.kind = 'VOID'", "'null'"),
        ("startswith(e.kind, 'OBJECT')", "'[object Object]'"),
        otherwise="e.text",
    )
    return f"transform({items(parsed)}, x -> {bind(describe('x', js=True), 'e', text)})"


def _bullets(raw: str) -> str:
    bare = f"regexp_replace(regexp_replace(x, {lit(_NUMBERING)}, ''), {lit(_BULLET)}, '')"
    return f"filter(transform(split({raw}, '\\r?\\n'), x -> {_trim(bare)}), s -> length(s) > 1)"


def parse_prompt_list(text: str) -> Column:
    """Prompts of a model's answer: a JSON array or ``{"prompts": [...]}``, else a fenced JSON
    array, else its lines without numbering and bullets. ``text`` is a column name."""
    fence = f"regexp_extract(raw, {lit(_FENCE)}, 1)"
    fenced = bind(fence, "f", case(("f <> ''", bind(strict_json("f"), "v", _stringified("v")))))
    found = f"coalesce({bind(strict_json('raw'), 'v', _listed('v'))}, {fenced}, {_bullets('raw')})"
    return F.expr(bind(_trim(f"coalesce({text}, '')"), "raw", case(("raw = ''", "cast(array() as array<string>)"), otherwise=found)))


def drafted_prompts(answers: DataFrame, text: str = "text") -> DataFrame:
    keys = [c for c in answers.columns if c != text]
    listed = answers.select(*keys, F.posexplode(parse_prompt_list(text)).alias("n", "prompt"))
    return listed


def candidate_samples(candidates: DataFrame) -> DataFrame:
    """Two-message samples of the candidates (``prompt, text, error``) that succeeded."""
    keys = [c for c in candidates.columns if c not in ("prompt", "text", "error")]
    done = candidates.filter(F.col("error").isNull() & (F.col("text") != ""))
    pair = F.array(message(F.lit("user"), jstrim(F.col("prompt"))), message(F.lit("assistant"), F.col("text")))
    return done.select(*keys, pair.alias("messages"))


def accept_candidates(corpus: DataFrame, candidates: DataFrame) -> DataFrame:
    return corpus.unionByName(candidate_samples(candidates), allowMissingColumns=True)
