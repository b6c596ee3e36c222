"""Format converters: raw records to ``(sample_id, source_path, record_no, messages, reason)``.

A converted frame keeps every input record. ``reason`` is null for a sample; otherwise it names
why the record was skipped or rejected. ``samples``, ``rejects`` and ``FAILFAST`` select from it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatloom.functions.records import (
    bind,
    case,
    describe,
    described_text,
    field,
    first_truthy,
    is_object,
    is_truthy,
    items,
    js_falsy,
    lit,
    py_falsy,
    strict_json,
)
from chatloom.functions.text import JS_SPACE, jstrim, let
from chatloom.operators.lines import content_lines, drop_comment_lines, drop_empty_lines, pair_array, pair_lines
from chatloom.operators.messages import (
    MESSAGES,
    drop_empty_sql,
    message,
    message_sql,
    strip_sql,
    validate_sql,
    with_system_sql,
)
from chatloom.options import DROPMALFORMED, FAILFAST, MODES, PERMISSIVE, DataFormatError, DataOptions

# Records that are passed over with a warning at most; every other reason is an error.
SKIPPED = ("no_messages", "no_conversations", "not_an_object", "empty_pair")

CHATML_MESSAGE = r"<\|im_start\|>(?:system|user|assistant)\n[\s\S]*?<\|im_end\|>"
_CHATML_OPEN, _CHATML_CLOSE = "<|im_start|>", "<|im_end|>"
_NO_MESSAGES = f"cast(null as {MESSAGES})"


def _with_id(df: DataFrame) -> DataFrame:
    if "sample_id" in df.columns:
        return df
    parts = [F.col(c).cast("string") for c in ("source_path", "record_no") if c in df.columns]
    return df.withColumn("sample_id", F.concat_ws("#", *parts))


def _parsed(records: DataFrame) -> DataFrame:
    """Records with a variant ``record``; text records are parsed strictly, once."""
    if "record" in records.columns:
        return records
    return records.withColumn("record", F.expr(strict_json("raw")))


def _finish(records: DataFrame, messages: str, reason: str, options: DataOptions, check: bool = True) -> DataFrame:
    """Apply the system prompt and the validity rules to the found messages.

    The outcome passes through a one-row generator. A later filter on it stays above the
    generator, so the optimizer does not run the whole conversion once more inside that filter.
    """
    keep = [c for c in records.columns if c not in ("record", "_items", "_messages", "_conversations", "_list")]
    found = f"named_struct('messages', cast({messages} as {MESSAGES}), 'reason', cast({reason} as string))"
    rejected = f"named_struct('messages', {_NO_MESSAGES}, 'reason', _found.reason)"
    checked = validate_sql(with_system_sql("_found.messages", options.system_prompt)) if check else "_found"
    staged = records.select(*keep, F.expr(found).alias("_found"))
    settled = staged.select(
        *keep, F.expr(f"explode(array({case(('_found.reason IS NOT NULL', rejected), otherwise=checked)}))").alias("_outcome")
    )
    outcome = settled.select(
        *keep,
        F.expr("CASE WHEN _outcome.reason IS NULL THEN _outcome.messages END").alias("messages"),
        F.col("_outcome.reason").alias("reason"),
    )
    return _with_id(outcome)


# --- JSON record formats -------------------------------------------------------------------


def _listed(elements: str, options: DataOptions, missing_role: str, fill_first: bool) -> str:
    """Messages of ``{role, content}`` elements. With ``fill_first`` the leading system message
    is judged by its raw value, so a 0 or false there counts as missing."""
    described = f"transform({elements}, x -> named_struct('r', {describe(field('x', 'role'))}, 'c', {describe(field('x', 'content'))}))"
    content = described_text("e.c", "None" if options.compat_null else "", "")
    if fill_first and options.system_prompt.strip():
        content = case((f"i = 0 AND e.r.text = 'system' AND {py_falsy('e.c')}", "''"), otherwise=content)
    return f"transform({described}, (e, i) -> {message_sql(described_text('e.r', 'None', missing_role), content)})"


def _shared_turns(elements: str, missing_role: str) -> str:
    """Messages of ``{from|role, value|content}`` elements; a false first key falls through."""
    role = f"coalesce({first_truthy(field('x', 'from'), field('x', 'role'))}, {lit(missing_role)})"
    content = f"coalesce({first_truthy(field('x', 'value'), field('x', 'content'))}, '')"
    return f"transform({elements}, x -> {message_sql(role, content)})"


def _stripped(*keys: str) -> str:
    return strip_sql(f"coalesce({first_truthy(*[field('record', k) for k in keys])}, '')")


def from_messages_jsonl(records: DataFrame, options: DataOptions = DataOptions()) -> DataFrame:
    """``{"messages": [...]}`` or a bare list."""
    wrapped = field("record", "messages")
    elements = case((f"{wrapped} IS NOT NULL", items(wrapped)), otherwise=items("record"))
    reason = case(
        ("record IS NULL", "'invalid_json'"),
        (f"_items IS NULL AND {wrapped} IS NULL", "'no_messages'"),
        ("_items IS NULL", "'bad_messages'"),
    )
    staged = _parsed(records).withColumn("_items", F.expr(elements))
    return _finish(staged, _listed("_items", options, "", True), reason, options)


def from_sharegpt(records: DataFrame, options: DataOptions = DataOptions()) -> DataFrame:
    """``{"conversations": [{from|role, value|content}]}``."""
    listed = field("record", "conversations")
    reason = case(
        ("record IS NULL", "'invalid_json'"),
        (f"size(_items) = 0 OR (_items IS NULL AND NOT {is_truthy(listed)})", "'no_conversations'"),
        ("_items IS NULL", "'bad_messages'"),
        ("_messages IS NULL", "'unsupported_role'"),
    )
    # Roles are checked and blank turns dropped before the system prompt is considered.
    staged = (
        _parsed(records)
        .withColumn("_items", F.expr(items(listed)))
        .withColumn("_messages", F.expr(drop_empty_sql(_shared_turns("_items", ""))))
    )
    return _finish(staged, "_messages", reason, options)


def _instruction(*output_keys: str) -> str:
    return f"named_struct('ask', {_stripped('instruction')}, 'more', {_stripped('input')}, 'reply', {_stripped(*output_keys)})"


_ASKED = "CASE WHEN f.more = '' THEN f.ask ELSE concat(f.ask, '\n', f.more) END"
_NOT_OBJECT = case(("record IS NULL", "'invalid_json'"), (f"NOT {is_object('record')}", "'not_an_object'"))


def _pair(user: str, assistant: str) -> str:
    return f"array({message_sql(lit('user'), user)}, {message_sql(lit('assistant'), assistant)})"


def from_alpaca(records: DataFrame, options: DataOptions = DataOptions()) -> DataFrame:
    """``{"instruction", "input", "output"}``."""
    messages = bind(_instruction("output"), "f", _pair(_ASKED, "f.reply"))
    return _finish(_parsed(records), messages, _NOT_OBJECT, options)


def _custom(options: DataOptions) -> str:
    return (
        f"named_struct('sys', {_stripped(options.custom_system_key)}, 'usr', {_stripped(options.custom_user_key)}, "
        f"'asst', {_stripped(options.custom_assistant_key)})"
    )


_CUSTOM_PAIR = _pair("f.usr", "f.asst")
_CUSTOM_MESSAGES = case(
    ("f.sys = ''", _CUSTOM_PAIR), otherwise=f"concat(array({message_sql(lit('system'), 'f.sys')}), {_CUSTOM_PAIR})"
)


def from_custom(records: DataFrame, options: DataOptions = DataOptions()) -> DataFrame:
    """Flat records whose keys the options name."""
    return _finish(_parsed(records), bind(_custom(options), "f", _CUSTOM_MESSAGES), _NOT_OBJECT, options)


def catalog_columns(options: DataOptions = DataOptions()) -> tuple[str, ...]:
    """The keys of a catalogue row that from_catalog looks at."""
    own = (options.custom_system_key, options.custom_user_key, options.custom_assistant_key)
    return ("messages", "conversations", "instruction", "input", "output", "response", *own)


def from_catalog(records: DataFrame, options: DataOptions = DataOptions()) -> DataFrame:
    """Rows of a dataset catalogue, each row's layout detected on its own."""

    def objects(listed: str) -> str:
        probe = f"{field('o', 'role')} IS NOT NULL OR {field('o', 'from')} IS NOT NULL OR {is_object('o')}"
        return f"filter({listed}, o -> {probe})"

    asked = case(
        (
            "f.ask <> '' OR f.more <> ''",
            f"concat(array({message_sql(lit('user'), strip_sql(_ASKED))}), "
            f"CASE WHEN f.reply <> '' THEN array({message_sql(lit('assistant'), 'f.reply')}) ELSE cast(array() as {MESSAGES}) END)",
        )
    )
    custom = case(("f.usr <> '' AND f.asst <> ''", _CUSTOM_MESSAGES))
    messages = case(
        ("_messages IS NOT NULL", _listed(objects("_messages"), options, "None", False)),
        ("_conversations IS NOT NULL", _shared_turns(objects("_conversations"), "None")),
        otherwise=f"coalesce({bind(_instruction('output', 'response'), 'f', asked)}, {bind(_custom(options), 'f', custom)})",
    )
    staged = (
        _parsed(records)
        .withColumn("_messages", F.expr(items(field("record", "messages"))))
        .withColumn("_conversations", F.expr(items(field("record", "conversations"))))
        .withColumn("_items", F.expr(f"cast({messages} as {MESSAGES})"))
    )
    # Only an object gives messages; whether a record without any is one is asked last, as it copies the record.
    reason = case(
        ("record IS NULL", "'invalid_json'"), ("size(_items) > 0", "null"), (f"NOT {is_object('record')}", "'not_an_object'"), otherwise="'no_messages'"
    )
    return _finish(staged, "_items", reason, options)


def import_editor_json(records: DataFrame) -> DataFrame:
    """Lenient import: any list of turns, odd roles kept, nothing validated."""
    named = [field("record", key) for key in ("messages", "conversations")]
    listed = ", ".join(f"CASE WHEN {is_truthy(v, js_falsy)} THEN {v} END" for v in named)
    truthy = lambda *keys: first_truthy(*[field("x", k) for k in keys], falsy=js_falsy)
    sender = case(("s = 'human'", "'user'"), ("s = 'gpt'", "'assistant'"), otherwise="s")
    role = f"coalesce({truthy('role')}, {bind(truthy('from'), 's', sender)}, 'user')"
    content = f"coalesce({truthy('content', 'value', 'text')}, '')"
    messages = case(
        ("_list IS NULL", f"cast(array() as {MESSAGES})"), otherwise=f"transform(_items, x -> {message_sql(role, content)})"
    )
    reason = case(
        ("record IS NULL", "'invalid_json'"),
        ("is_variant_null(record) OR (_list IS NOT NULL AND _items IS NULL)", "'bad_messages'"),
        ("exists(_items, x -> is_variant_null(x))", "'bad_messages'"),
    )
    staged = (
        _parsed(records)
        .withColumn("_list", F.expr(f"coalesce(CASE WHEN {items('record')} IS NOT NULL THEN record END, {listed})"))
        .withColumn("_items", F.expr(items("_list")))
    )
    return _finish(staged, messages, reason, DataOptions(), check=False)


# --- text formats --------------------------------------------------------------------------


def _pairs_converted(pairs: DataFrame, options: DataOptions) -> DataFrame:
    """Validity of (user, assistant) pairs; both halves are already stripped."""
    reason = case(
        ("user = '' OR assistant = ''", "'empty_pair'"),
        ("NOT utf8_ok", "'bad_encoding'"),
    )
    return _finish(pairs, _pair("user", "assistant"), reason, options).drop("user", "assistant", "utf8_ok")


def from_text(texts: DataFrame, options: DataOptions = DataOptions(), text: str = "text") -> DataFrame:
    """Paired lines of texts held in a column: everything happens inside the row, no shuffle."""
    checked = texts.withColumn("_ok", F.is_valid_utf8(F.col(text)))
    pairs = checked.withColumn("_pair", F.explode(pair_array(content_lines(F.col(text), options))))
    flat = pairs.select(
        *[c for c in texts.columns if c != text],
        F.col("_pair.pair_no").alias("record_no"),
        F.col("_pair.user").alias("user"),
        F.col("_pair.assistant").alias("assistant"),
        F.col("_ok").alias("utf8_ok"),
    )
    return _pairs_converted(flat, options)


def from_txt(lines: DataFrame, options: DataOptions = DataOptions()) -> DataFrame:
    """Paired lines of a file scan (``sources.readers.scan_lines``)."""
    content = drop_comment_lines(drop_empty_lines(lines, options), options)
    pairs = pair_lines(content).filter(F.col("assistant").isNotNull()).withColumnRenamed("pair_no", "record_no")
    return _pairs_converted(pairs, options)


def import_chatml(texts: DataFrame, text: str = "text") -> DataFrame:
    """All marked messages of a text form one sample; texts without any yield no row."""
    marked = F.regexp_extract_all(jstrim(F.col(text)), F.lit(CHATML_MESSAGE), F.lit(0))

    def build(m: Column) -> Column:
        role = F.substring_index(F.substring(m, len(_CHATML_OPEN) + 1, 10), "\n", 1)
        start = F.length(role) + len(_CHATML_OPEN) + 2
        body = F.substring(m, start, F.length(m) - start + 1 - len(_CHATML_CLOSE))
        return message(
            role, F.when(F.endswith(body, F.lit("\n")), F.left(body, F.length(body) - 1)).otherwise(body)
        )

    found = texts.withColumn("messages", F.explode(F.array(F.transform(marked, build))))
    return _with_id(found.filter(F.size("messages") > 0).drop(text))


def import_editor_txt(texts: DataFrame, text: str = "text") -> DataFrame:
    """Trimmed non-blank, non-``#`` lines in pairs; an odd last line is dropped silently."""
    lines = F.filter(
        F.transform(F.split(jstrim(F.col(text)), "\r?\n"), jstrim),
        lambda x: (x != "") & ~F.startswith(x, F.lit("#")),
    )
    pairs = let(
        lines,
        lambda a: F.when(
            F.size(a) >= 2,
            F.transform(
                F.sequence(F.lit(0), F.floor(F.size(a) / 2).cast("int") - 1),
                lambda i: F.struct(
                    i.cast("bigint").alias("record_no"),
                    F.array(
                        message(F.lit("user"), F.get(a, i * 2)), message(F.lit("assistant"), F.get(a, i * 2 + 1))
                    ).alias("messages"),
                ),
            ),
        ),
    )
    rows = texts.withColumn("_pair", F.explode(pairs)).drop(text)
    return _with_id(rows.select(*[c for c in rows.columns if c != "_pair"], "_pair.record_no", "_pair.messages"))


def sniff_format(text: Column, name: Column) -> Column:
    """``json``, ``chatml`` or ``txt``, or null for an empty file."""
    return let(
        F.ltrim(text, F.lit(JS_SPACE)),
        lambda t: F.when(t == "", F.lit(None).cast("string"))
        .when(F.endswith(name, F.lit(".jsonl")) | F.startswith(t, F.lit("{")) | F.startswith(t, F.lit("[")), "json")
        .when(F.contains(t, F.lit(_CHATML_OPEN)), "chatml")
        .otherwise("txt"),
    )


def editor_json_records(texts: DataFrame, text: str = "text") -> DataFrame:
    """Records of a JSON text: the elements of an array, or one record per non-blank line."""
    by_line = f"transform(filter(split(_t, '\\r?\\n'), x -> btrim(x, {lit(JS_SPACE)}) <> ''), x -> {strict_json('x')})"
    listed = f"coalesce({items(strict_json('_t'))}, array(cast(null as variant)))"
    elements = F.expr(case(("startswith(_t, '[')", listed), otherwise=by_line))
    keys = [c for c in texts.columns if c != text]
    rows = texts.select(*keys, jstrim(F.col(text)).alias("_t")).select(*keys, F.posexplode(elements).alias("_i", "record"))
    return rows.select(*keys, F.col("_i").cast("bigint").alias("record_no"), "record")


def import_any(texts: DataFrame, text: str = "text", name: str = "source_path") -> DataFrame:
    """Samples of files of any editor layout: each file is read as what ``sniff_format`` finds.

    Row-local; the texts are scanned once for each of the three layouts.
    """
    sniffed = sniff_format(F.col(text), F.col(name))
    records = samples(import_editor_json(editor_json_records(texts.filter(sniffed == "json"), text)))
    marked = import_chatml(texts.filter(sniffed == "chatml").withColumn("record_no", F.lit(0).cast("bigint")), text)
    return records.unionByName(marked).unionByName(import_editor_txt(texts.filter(sniffed == "txt"), text))


# --- dispatch and outcome ------------------------------------------------------------------

Converter = Callable[[DataFrame, DataOptions], DataFrame]

_FORMATS: dict[str, Converter] = {
    "default": from_txt,
    "txt": from_txt,
    "jsonl": from_messages_jsonl,
    "sharegpt": from_sharegpt,
    "alpaca": from_alpaca,
    "custom": from_custom,
}
LINE_FORMATS = ("default", "txt")


def register_format(name: str, converter: Converter) -> None:
    _FORMATS[name.strip().lower()] = converter


def format_names() -> tuple[str, ...]:
    return tuple(_FORMATS)


def convert(df: DataFrame, data_format: str, options: DataOptions | None = None) -> DataFrame:
    """Converted frame of a registered format; the name is case-insensitive."""
    name = data_format.strip().lower()
    if name not in _FORMATS:
        raise DataFormatError(f"Unsupported data format {data_format!r}; known: {', '.join(_FORMATS)}")
    return _FORMATS[name](df, options or DataOptions())


def rejects(converted: DataFrame) -> DataFrame:
    keep = [c for c in ("source_path", "record_no", "reason", "raw") if c in converted.columns]
    return converted.filter(F.col("reason").isNotNull()).select(*keep)


def is_error() -> Column:
    """Whether a converted record is one that stops a file: what is passed over does not."""
    return F.col("reason").isNotNull() & ~F.col("reason").isin(*SKIPPED)


def first_errors(converted: DataFrame) -> DataFrame:
    """``source_path, record_no, reason``: the first erroneous record of each file that has one, whatever
    order tasks run in. One row per task and file is exchanged."""
    first = F.min(F.struct("record_no", "reason")).alias("_first")
    return converted.filter(is_error()).groupBy("source_path").agg(first).select("source_path", "_first.record_no", "_first.reason")


def sound_files(converted: DataFrame) -> DataFrame:
    """Samples of the files without any erroneous record: an error drops the whole file."""
    return samples(converted).join(first_errors(converted).select("source_path"), "source_path", "left_anti").select(*samples(converted).columns)


def samples(converted: DataFrame, mode: str = DROPMALFORMED) -> DataFrame:
    """Samples of a converted frame.

    ``DROPMALFORMED`` leaves rejects out (``PERMISSIVE`` too: read them with ``rejects``).
    ``FAILFAST`` stops the job at an erroneous record that some task meets. The check is part of the row
    filter, so no column pruning can remove it and no partial output is committed. Which one is the
    first of a file tell ``first_errors`` and, as it writes, ``sinks.write_converted``.
    """
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}")
    good = F.col("reason").isNull()
    if mode == FAILFAST:
        where = F.concat_ws("#", *[F.col(c).cast("string") for c in ("source_path", "record_no") if c in converted.columns])
        failed = F.raise_error(F.concat(F.lit("bad record "), where, F.lit(": "), F.col("reason"))).cast("boolean")
        good = F.when(is_error(), failed).otherwise(good)
    kept = converted.filter(good)
    return kept.drop("reason", "raw") if mode != PERMISSIVE else kept.drop("reason")


def require_samples(found: DataFrame, source: str) -> DataFrame:
    """Refuse an input that yields no sample."""
    if found.isEmpty():
        raise DataFormatError(f"No valid samples parsed from {source}.")
    return found
