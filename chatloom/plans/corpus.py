"""Queries over scans, sinks, line and message operators, converters and renderings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatloom.functions.text import splitlines
from chatloom.operators import formats, lines, messages, render, report
from chatloom.options import PERMISSIVE, DataOptions
from chatloom.plans import fixtures as fx
from chatloom.plans.registry import query
from chatloom.plans.sql import CLEAN_TURNS, JS_SPACE, LF, jstrip, lines as sql_lines, lit, numbered, strip
from chatloom.session import scratch_path
from chatloom.sources import readers, sinks
from chatloom.sources.files import write_files
from chatloom.sources.json_lists import scan_large_json

PROMPT = "You are a helpful assistant."
BLANKS_KEPT = DataOptions(skip_empty_lines=False)


def flat(found: DataFrame, *keys: str) -> DataFrame:
    """One row per message, for comparison."""
    return found.select(*keys, F.posexplode("messages").alias("n", "m")).select(
        *keys, F.col("n").cast("bigint").alias("n"), F.col("m.role").alias("role"), F.col("m.content").alias("content")
    )


def accepted(converted: DataFrame, *keys: str) -> DataFrame:
    return flat(formats.samples(converted), *keys)


# --- scans ---------------------------------------------------------------------------------


@query(
    "a1_scan_lines",
    f"WITH {fx.TXT_DOCUMENTS} SELECT doc_id, n AS line_no, line FROM ({numbered('doc_id', sql_lines('text'))} FROM docs))",
)
def a1_scan_lines(spark, sf_dir):
    texts = fx.spread(fx.txt_documents(spark, sf_dir), "doc_id")
    found = texts.select("doc_id", F.posexplode(splitlines(F.col("text"))).alias("line_no", "line"))
    return found.withColumn("line_no", F.col("line_no").cast("bigint"))


@query(
    "a2_scan_records",
    "SELECT conv_id, count(*) AS turns, sum(length(text))::BIGINT AS chars FROM conversations GROUP BY conv_id",
)
def a2_scan_records(spark, sf_dir):
    path = scratch_path(spark, "records")
    fx.conversations(spark, sf_dir).select(F.to_json(F.struct("conv_id", "messages")).alias("value")).write.text(path)
    record = F.col("record")
    turns = F.try_variant_get(record, "$.messages", "array<struct<content:string>>")
    return readers.scan_records(spark, path).select(
        F.try_variant_get(record, "$.conv_id", "bigint").alias("conv_id"),
        F.size(turns).cast("bigint").alias("turns"),
        F.aggregate(turns, F.lit(0).cast("bigint"), lambda s, t: s + F.length(t["content"])).alias("chars"),
    )


@query("a3_scan_catalog", "SELECT doc_id, lang, source, n_chars, length(text) AS chars FROM documents")
def a3_scan_catalog(spark, sf_dir):
    record = F.col("record")
    get = lambda key, kind: F.try_variant_get(record, f"$.{key}", kind).alias(key)
    return readers.scan_catalog(fx.load(spark, sf_dir, "documents")).select(
        get("doc_id", "bigint"), get("lang", "string"), get("source", "string"), get("n_chars", "bigint"),
        F.length(F.try_variant_get(record, "$.text", "string")).cast("bigint").alias("chars"),
    )


SAMPLES = f"WITH {CLEAN_TURNS} SELECT n, role, content FROM sample_rows"


@query(
    "a2_scan_json_lists",
    """SELECT doc_id, row_number() OVER (PARTITION BY doc_id // 500 ORDER BY doc_id) - 1 AS record_no, length(text) AS chars, md5(text) AS digest
    FROM documents""",
)
def a2_scan_json_lists(spark, sf_dir):
    """Lists of 500 documents a file, cut at their elements as files of any size are."""
    docs = fx.load(spark, sf_dir, "documents").groupBy(F.floor(F.col("doc_id") / 500).alias("block"))
    lists = docs.agg(F.to_json(F.sort_array(F.collect_list(F.struct("doc_id", "text")))).alias("content"))
    root = scratch_path(spark, "lists")
    write_files(lists.select(F.concat(F.col("block").cast("string"), F.lit(".json")).alias("name"), "content"), root)
    found = scan_large_json(spark, root, 0, DataOptions()).withColumn("text", F.expr("variant_get(record, '$.text', 'string')"))
    return found.select(
        F.expr("variant_get(record, '$.doc_id', 'long')").alias("doc_id"), "record_no",
        F.length("text").cast("bigint").alias("chars"), F.md5(F.col("text").cast("binary")).alias("digest"),
    )


@query("a4_load_corpus", SAMPLES)
def a4_load_corpus(spark, sf_dir):
    path = scratch_path(spark, "corpus")
    fx.rec_messages(spark, sf_dir).select(F.col("raw").alias("value")).write.text(path)
    return flat(readers.load_corpus(spark, path, "jsonl"))


CARD_NAMES = ", ".join(lit(f) for f in readers.CARD_FILES)


@query(
    "a5_scan_model_cards",
    f"SELECT doc_id::VARCHAR AS model_id, ([{CARD_NAMES}])[doc_id % 5 + 1] AS file, text || chr(65533) AS text FROM documents",
)
def a5_scan_model_cards(spark, sf_dir):
    names = F.array(*[F.lit(f) for f in readers.CARD_FILES])
    name = F.concat_ws("/", F.col("doc_id").cast("string"), F.element_at(names, (F.col("doc_id") % 5 + 1).cast("int")))
    content = F.concat(F.col("text").cast("binary"), F.unhex(F.lit("FF")))
    root = scratch_path(spark, "models")
    write_files(fx.spread(fx.load(spark, sf_dir, "documents"), "doc_id").select(name.alias("name"), content.alias("content")), root)
    return readers.scan_model_cards(spark, root)


@query("a4_materialise", SAMPLES)
def a4_materialise(spark, sf_dir):
    path = scratch_path(spark, "corpus")
    fx.rec_messages(spark, sf_dir).select(F.col("raw").alias("value")).write.text(path)
    done = readers.materialise(spark, path, "jsonl", scratch_path(spark, "training"))
    return flat(spark.read.schema(f"messages {messages.MESSAGES}").json(done.processed))


@query(
    "a8_scan_listing",
    """SELECT 'brand=' || replace(p_brand, '#', '-') || '/kind=' || (p_size % 4) AS model_id, 'txt' AS suffix,
      sum(coalesce(strlen(p_name), 0) + 1)::BIGINT AS size FROM part GROUP BY ALL""",
)
def a8_scan_listing(spark, sf_dir):
    part = fx.load(spark, sf_dir, "part").select(
        F.replace("p_brand", F.lit("#"), F.lit("-")).alias("brand"), (F.col("p_size") % 4).alias("kind"), F.col("p_name").alias("value")
    )
    root = scratch_path(spark, "models")
    part.write.partitionBy("brand", "kind").text(root)
    # A model has as many files as tasks met it, so the files are summed.
    found = readers.scan_listing(spark, root, depth=2)
    return found.groupBy("model_id", F.substring_index("path", ".", -1).alias("suffix")).agg(F.sum("size").alias("size"))


# --- sinks ---------------------------------------------------------------------------------


@query("b1_write_processed", SAMPLES)
def b1_write_processed(spark, sf_dir):
    path = scratch_path(spark, "processed")
    sinks.write_processed(formats.samples(formats.from_messages_jsonl(fx.rec_messages(spark, sf_dir))), path)
    return flat(spark.read.schema(f"messages {messages.MESSAGES}").json(path))


@query(
    "b2_write_raw",
    "SELECT p_partkey, p_name, p_brand, CASE WHEN p_size % 2 = 0 THEN p_type END AS p_type, p_size, p_retailprice FROM part",
)
def b2_write_raw(spark, sf_dir):
    part = fx.load(spark, sf_dir, "part").withColumn("p_type", F.when(F.col("p_size") % 2 == 0, F.col("p_type")))
    path = sinks.write_raw(part, scratch_path(spark, "raw"), "owner/parts")
    return spark.read.schema(part.schema).json(path)


def editor_samples(spark, sf_dir) -> DataFrame:
    """Conversations with a blank message behind the first one; some open with one more user
    message, which shifts their pairs."""
    conv, talk = F.col("conv_id"), F.col("messages")
    blank = F.array(messages.message(F.lit("assistant"), F.lit(" \u3000\n")))
    again = F.when(conv % 3 == 0, F.array(messages.message(F.lit("user"), F.lit("again")))).otherwise(
        F.array().cast(messages.MESSAGES)
    )
    rest = F.slice(talk, F.lit(2), F.greatest(F.size(talk) - 1, F.lit(0)))
    return fx.conversations(spark, sf_dir).withColumn("messages", F.concat(again, F.slice(talk, 1, 1), blank, rest))


EDITOR = """
spoken AS (
  SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT DISTINCT conv_id, -1, 'user', 'again' FROM conversations WHERE conv_id % 3 = 0
)"""


@query(
    "b3_export_jsonl",
    f"""WITH {EDITOR} SELECT row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS n, role, text AS content FROM spoken""",
)
def b3_export_jsonl(spark, sf_dir):
    exported = sinks.export_jsonl(editor_samples(spark, sf_dir))
    return flat(exported.select(F.from_json("value", f"messages {messages.MESSAGES}").alias("r")).select("r.messages"))


CHATML = "'<|im_start|>' || role || chr(10) || {text} || '<|im_end|>'"


@query(
    "b4_export_chatml",
    f"""WITH {EDITOR}
    SELECT string_agg({CHATML.format(text="text")}, chr(10) ORDER BY turn) || chr(10) AS value FROM spoken GROUP BY conv_id""",
)
def b4_export_chatml(spark, sf_dir):
    return sinks.export_chatml(editor_samples(spark, sf_dir))


@query(
    "b5_export_pairs",
    f"""WITH {EDITOR}, steps AS (
      SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS n FROM spoken WHERE role <> 'system'
    )
    SELECT u.conv_id, u.n // 2 AS pair_no, {jstrip("u.text")} AS user, {jstrip("a.text")} AS assistant
    FROM steps u JOIN steps a ON a.conv_id = u.conv_id AND a.n = u.n + 1
    WHERE u.n % 2 = 0 AND u.role = 'user' AND a.role = 'assistant'""",
)
def b5_export_pairs(spark, sf_dir):
    return sinks.export_pairs(editor_samples(spark, sf_dir))


CONTENT = f"""
raw AS ({numbered("doc_id", sql_lines("text"))} FROM docs)),
content AS (
  SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id ORDER BY n) - 1 AS n FROM raw
  WHERE {strip("line")} <> '' AND NOT starts_with({strip("line")}, '#')
),
line_pairs AS (
  SELECT u.doc_id, u.n // 2 AS record_no, {strip("u.line")} AS user, {strip("a.line")} AS assistant
  FROM content u JOIN content a ON a.doc_id = u.doc_id AND a.n = u.n + 1 WHERE u.n % 2 = 0
)"""


@query(
    "b7_conversion_report",
    f"""WITH {fx.TXT_DOCUMENTS}, {CONTENT}, counted AS (
      SELECT doc_id, count(*) AS raw_lines, count(*) FILTER (WHERE {strip("line")} = '') AS skipped_empty,
        count(*) FILTER (WHERE {strip("line")} <> '' AND starts_with({strip("line")}, '#')) AS skipped_comments
      FROM raw GROUP BY doc_id
    )
    SELECT doc_id, raw_lines, skipped_empty, skipped_comments,
      (raw_lines - skipped_empty - skipped_comments) % 2 AS dropped_unpaired, true AS utf8_ok,
      (SELECT count(*) FROM line_pairs p WHERE p.doc_id = c.doc_id) AS samples,
      (raw_lines - skipped_empty - skipped_comments) % 2 AS warnings
    FROM counted c""",
)
def b7_conversion_report(spark, sf_dir):
    texts = fx.spread(fx.txt_documents(spark, sf_dir), "doc_id")
    return report.text_report(texts, formats.from_text(texts), source="doc_id")


@query(
    "b7_records_report",
    f"""WITH {CLEAN_TURNS}
    SELECT 'm' || conv_id AS source_path,
      1 + (conv_id % 10 >= 6)::BIGINT + (conv_id % 3 = 0)::BIGINT + (conv_id % 4 = 1)::BIGINT AS raw_lines,
      (conv_id % 4 = 1)::BIGINT AS skipped_empty, (conv_id % 3 = 0)::BIGINT AS skipped_comments,
      0::BIGINT AS dropped_unpaired, true AS utf8_ok,
      (conv_id IN (SELECT conv_id FROM valid))::BIGINT AS samples, (conv_id % 10 = 9)::BIGINT AS warnings
    FROM (SELECT DISTINCT conv_id FROM conversations)""",
)
def b7_records_report(spark, sf_dir):
    """One source per conversation; some have a comment or a blank line too."""
    conv = F.floor(F.col("record_no") / 10)
    records = fx.rec_messages(spark, sf_dir).withColumn("source_path", F.concat(F.lit("m"), conv))
    first = F.col("record_no") % 10 == 0
    note, blank = F.when(first & (conv % 3 == 0), "# note"), F.when(first & (conv % 4 == 1), " ")
    scanned = records.select("source_path", F.explode(F.array_compact(F.array("raw", note, blank))).alias("line"))
    lines_ = scanned.withColumn("utf8_ok", F.is_valid_utf8("line"))
    return report.lines_report(lines_, formats.from_messages_jsonl(records), paired=False)


# --- lines ---------------------------------------------------------------------------------


def document_lines(spark, sf_dir) -> DataFrame:
    texts = fx.spread(fx.txt_documents(spark, sf_dir), "doc_id")
    return texts.select("doc_id", F.explode(splitlines(F.col("text"))).alias("line"))


@query(
    "c1_drop_empty_lines",
    f"WITH {fx.TXT_DOCUMENTS}, {CONTENT} SELECT doc_id, line FROM raw WHERE {strip('line')} <> ''",
)
def c1_drop_empty_lines(spark, sf_dir):
    return lines.drop_empty_lines(document_lines(spark, sf_dir))


@query(
    "c2_drop_comment_lines",
    f"WITH {fx.TXT_DOCUMENTS}, {CONTENT} SELECT doc_id, line FROM raw WHERE NOT starts_with({strip('line')}, '#')",
)
def c2_drop_comment_lines(spark, sf_dir):
    return lines.drop_comment_lines(document_lines(spark, sf_dir))


def line_files(spark, sf_dir) -> DataFrame:
    """The documents as line files. Documents with an odd number of content lines get one more, so
    that the pairs of a file do not depend on which documents share it."""
    texts = fx.spread(fx.txt_documents(spark, sf_dir), "doc_id")
    odd = F.size(lines.content_lines(F.col("text"))) % 2 == 1
    padded = F.when(odd, F.concat("text", F.lit("\npad"))).otherwise(F.col("text"))
    path = scratch_path(spark, "lines")
    texts.select(padded.alias("value")).write.text(path)
    return readers.scan_lines(spark, path)


PADDED = f"""
padded AS (
  SELECT doc_id, line, n FROM content
  UNION ALL SELECT doc_id, 'pad', count(*) FROM content GROUP BY doc_id HAVING count(*) % 2 = 1
)"""


@query(
    "c3_pair_lines",
    f"""WITH {fx.TXT_DOCUMENTS}, {CONTENT}, {PADDED}
    SELECT {strip("u.line")} AS user, {strip("a.line")} AS assistant
    FROM padded u JOIN padded a ON a.doc_id = u.doc_id AND a.n = u.n + 1 WHERE u.n % 2 = 0""",
)
def c3_pair_lines(spark, sf_dir):
    content = lines.drop_comment_lines(lines.drop_empty_lines(line_files(spark, sf_dir)))
    return lines.pair_lines(content).select("user", "assistant")


@query(
    "c4_drop_unpaired_tail",
    f"""WITH {fx.TXT_DOCUMENTS}, {CONTENT} SELECT doc_id, record_no AS pair_no, user, assistant FROM line_pairs""",
)
def c4_drop_unpaired_tail(spark, sf_dir):
    texts = fx.spread(fx.txt_documents(spark, sf_dir), "doc_id")
    pairs = texts.select("doc_id", F.explode(lines.pair_array(lines.content_lines(F.col("text")))).alias("p"))
    return lines.drop_unpaired_tail(pairs.select("doc_id", "p.*"))


BLANK_PAIRS = f"""
kept AS (
  SELECT doc_id, {strip("line")} AS line, row_number() OVER (PARTITION BY doc_id ORDER BY n) - 1 AS n FROM raw
  WHERE NOT starts_with({strip("line")}, '#')
),
kept_pairs AS (
  SELECT u.doc_id, u.n // 2 AS pair_no, u.line AS user, a.line AS assistant
  FROM kept u JOIN kept a ON a.doc_id = u.doc_id AND a.n = u.n + 1 WHERE u.n % 2 = 0
)"""


@query(
    "c5_skip_empty_pair",
    f"""WITH {fx.TXT_DOCUMENTS}, {CONTENT}, {BLANK_PAIRS}
    SELECT * FROM kept_pairs WHERE user <> '' AND assistant <> ''""",
)
def c5_skip_empty_pair(spark, sf_dir):
    texts = fx.spread(fx.txt_documents(spark, sf_dir), "doc_id")
    paired = F.explode(lines.pair_array(lines.content_lines(F.col("text"), BLANKS_KEPT)))
    return lines.skip_empty_pair(texts.select("doc_id", paired.alias("p")).select("doc_id", "p.*"))


# --- messages ------------------------------------------------------------------------------


@query("d1_normalize_role", "SELECT conv_id, turn, role FROM conversations")
def d1_normalize_role(spark, sf_dir):
    turns = fx.load(spark, sf_dir, "conversations").select("conv_id", "turn", messages.message(F.col("role"), F.col("text")).alias("m"))
    spelled = F.upper(fx._respelled(F.col("m"), F.col("turn").cast("int"))["role"])
    return turns.withColumn("role", spelled).select("conv_id", "turn", messages.normalize_role("role").alias("role"))


FIRST_SYSTEM = "(SELECT DISTINCT conv_id FROM conversations WHERE turn = 0 AND role = 'system')"


@query(
    "d2_with_system",
    f"""SELECT conv_id, turn + CASE WHEN conv_id IN {FIRST_SYSTEM} THEN 0 ELSE 1 END AS n, role,
      CASE WHEN role = 'system' AND turn = 0 AND conv_id % 2 = 0 THEN {lit(PROMPT)} ELSE text END AS content FROM conversations
    UNION ALL
    SELECT DISTINCT conv_id, 0 AS n, 'system' AS role, {lit(PROMPT)} AS content FROM conversations WHERE conv_id NOT IN {FIRST_SYSTEM}""",
)
def d2_with_system(spark, sf_dir):
    emptied = lambda m: F.when((m["role"] == "system") & (F.col("conv_id") % 2 == 0), F.lit("")).otherwise(m["content"])
    found = fx.conversations(spark, sf_dir).withColumn(
        "messages", F.transform("messages", lambda m: messages.message(m["role"], emptied(m)))
    )
    return flat(found.withColumn("messages", messages.with_system("messages", PROMPT)), "conv_id")


@query(
    "d3_drop_empty_messages",
    f"SELECT conv_id, turn AS n, role, {strip('text')} AS content FROM conversations",
)
def d3_drop_empty_messages(spark, sf_dir):
    blank = messages.message(F.lit(" GPT "), F.lit(" \t\u3000"))
    doubled = F.flatten(F.transform("messages", lambda m: F.array(blank, m)))
    found = fx.conversations(spark, sf_dir).withColumn("messages", doubled)
    return flat(found.withColumn("messages", messages.drop_empty_messages("messages")), "conv_id")


@query(
    "d4_require_user_and_assistant",
    """SELECT conv_id, CASE WHEN NOT bool_or(role = 'user') THEN 'no_user' WHEN NOT bool_or(role = 'assistant') THEN 'no_assistant' END AS reason
    FROM conversations GROUP BY conv_id""",
)
def d4_require_user_and_assistant(spark, sf_dir):
    return fx.conversations(spark, sf_dir).select("conv_id", messages.missing_role("messages").alias("reason"))


@query(
    "d4_valid_turns",
    f"WITH {CLEAN_TURNS} SELECT conv_id, turn, role, content FROM clean JOIN valid USING (conv_id) WHERE content <> ''",
)
def d4_valid_turns(spark, sf_dir):
    return messages.valid_turns(fx.load(spark, sf_dir, "conversations"))


@query("d5_load_system_prompt", f"SELECT conv_id, {lit(PROMPT)} AS prompt FROM conversations GROUP BY conv_id")
def d5_load_system_prompt(spark, sf_dir):
    path = scratch_path(spark, "prompt")
    spark.createDataFrame([(f"\n {PROMPT} \n",)], "value string").coalesce(1).write.text(path)
    prompt = messages.load_system_prompt(spark, path)
    talk = fx.conversations(spark, sf_dir).withColumn("messages", F.filter("messages", lambda m: m["role"] != "system"))
    lead = messages.with_system("messages", prompt)
    return talk.select("conv_id", F.get(lead, F.lit(0))["content"].alias("prompt"))


REJECTED = """SELECT conv_id * 10 AS record_no, CASE WHEN NOT bool_or(role = 'user') THEN 'no_user' ELSE 'no_assistant' END AS reason
      FROM conversations GROUP BY conv_id HAVING NOT (bool_or(role = 'user') AND bool_or(role = 'assistant'))
    UNION ALL SELECT DISTINCT conv_id * 10 + 1, 'no_messages' FROM conversations WHERE conv_id % 10 = 9
    UNION ALL SELECT DISTINCT conv_id * 10 + 2, 'invalid_json' FROM conversations WHERE conv_id % 10 = 8
    UNION ALL SELECT DISTINCT conv_id * 10 + 3, 'invalid_json' FROM conversations WHERE conv_id % 10 = 7
    UNION ALL SELECT DISTINCT conv_id * 10 + 4, 'unsupported_role' FROM conversations WHERE conv_id % 10 = 6"""


@query("d6_validation_mode", REJECTED)
def d6_validation_mode(spark, sf_dir):
    return formats.rejects(formats.from_messages_jsonl(fx.rec_messages(spark, sf_dir))).select("record_no", "reason")


def in_files(spark, sf_dir):
    """The records of every fiftieth conversation in one file."""
    records = fx.rec_messages(spark, sf_dir)
    return formats.from_messages_jsonl(records.withColumn("source_path", F.concat(F.lit("f"), F.expr("record_no div 10 % 50").cast("string"))))


@query(
    "d6_first_errors",
    f"""SELECT 'f' || (record_no // 10 % 50) AS source_path, min(record_no) AS record_no, arg_min(reason, record_no) AS reason
    FROM ({REJECTED}) WHERE reason <> 'no_messages' GROUP BY 1""",
)
def d6_first_errors(spark, sf_dir):
    return formats.first_errors(in_files(spark, sf_dir))


@query(
    "d6_sound_files",
    f"""WITH {CLEAN_TURNS}, broken AS (SELECT DISTINCT record_no // 10 % 50 AS f FROM ({REJECTED}) WHERE reason <> 'no_messages')
    SELECT conv_id * 10 AS record_no, n, role, content FROM sample_rows WHERE conv_id % 50 NOT IN (SELECT f FROM broken)""",
)
def d6_sound_files(spark, sf_dir):
    return flat(formats.sound_files(in_files(spark, sf_dir)), "record_no")


# --- converters ----------------------------------------------------------------------------

PAIR_MESSAGES = """
SELECT doc_id, record_no, 0 AS n, 'user' AS role, user AS content FROM line_pairs
UNION ALL SELECT doc_id, record_no, 1, 'assistant', assistant FROM line_pairs"""


@query("e1_from_txt", f"WITH {fx.TXT_DOCUMENTS}, {CONTENT} {PAIR_MESSAGES}")
def e1_from_txt(spark, sf_dir):
    texts = fx.spread(fx.txt_documents(spark, sf_dir), "doc_id")
    return accepted(formats.from_text(texts), "doc_id", "record_no")


@query(
    "e1_from_txt_files",
    f"""WITH {fx.TXT_DOCUMENTS}, {CONTENT}, {PADDED}, paired AS (
      SELECT {strip("u.line")} AS user, {strip("a.line")} AS assistant
      FROM padded u JOIN padded a ON a.doc_id = u.doc_id AND a.n = u.n + 1 WHERE u.n % 2 = 0
    )
    SELECT 0 AS n, 'system' AS role, {lit(PROMPT)} AS content FROM paired
    UNION ALL SELECT 1, 'user', user FROM paired UNION ALL SELECT 2, 'assistant', assistant FROM paired""",
)
def e1_from_txt_files(spark, sf_dir):
    return accepted(formats.convert(line_files(spark, sf_dir), "txt", DataOptions(system_prompt=PROMPT)))


KEYED_SAMPLES = f"WITH {CLEAN_TURNS} SELECT conv_id * 10 AS record_no, n, role, content FROM sample_rows"


@query("e2_from_messages_jsonl", KEYED_SAMPLES)
def e2_from_messages_jsonl(spark, sf_dir):
    return accepted(formats.from_messages_jsonl(fx.rec_messages(spark, sf_dir)), "record_no")


@query("e3_from_sharegpt", KEYED_SAMPLES)
def e3_from_sharegpt(spark, sf_dir):
    return accepted(formats.from_sharegpt(fx.rec_sharegpt(spark, sf_dir)), "record_no")


ALPACA = f"""
parts AS (SELECT doc_id, string_split(text, {LF}) AS l FROM documents),
asked AS (
  SELECT doc_id, {strip("l[1]")} AS ask, {strip("coalesce(l[2], '')")} AS more, {strip(f"array_to_string(l[3:], {LF})")} AS reply FROM parts
),
alpaca AS (
  SELECT doc_id * 10 AS record_no, {strip(f"CASE WHEN more = '' THEN ask ELSE ask || {LF} || more END")} AS ask, reply FROM asked
)"""
ALPACA_ROWS = """
SELECT record_no, 0 AS n, 'user' AS role, ask AS content FROM alpaca WHERE ask <> '' AND reply <> ''
UNION ALL SELECT record_no, 1, 'assistant', reply FROM alpaca WHERE ask <> '' AND reply <> ''"""


@query("e4_from_alpaca", f"WITH {ALPACA} {ALPACA_ROWS}")
def e4_from_alpaca(spark, sf_dir):
    return accepted(formats.from_alpaca(fx.rec_alpaca(spark, sf_dir)), "record_no")


CUSTOM_ROWS = """
SELECT p_partkey * 10 AS record_no, 0 AS n, 'system' AS role, p_brand AS content FROM part WHERE p_size % 2 = 0
UNION ALL SELECT p_partkey * 10, 1 - p_size % 2, 'user', p_name FROM part
UNION ALL SELECT p_partkey * 10, 2 - p_size % 2, 'assistant', p_type FROM part"""


@query("e5_from_custom", CUSTOM_ROWS)
def e5_from_custom(spark, sf_dir):
    keys = ("the ask", "reply", "it's system")
    options = DataOptions(custom_user_key=keys[0], custom_assistant_key=keys[1], custom_system_key=keys[2])
    return accepted(formats.from_custom(fx.rec_custom(spark, sf_dir, keys), options), "record_no")


@query(
    "e6_from_catalog",
    f"""WITH {CLEAN_TURNS}, {ALPACA}
    SELECT s.source_path, conv_id * 10 AS record_no, n, role, content
    FROM sample_rows, (VALUES ('messages'), ('sharegpt')) s(source_path)
    WHERE NOT (s.source_path = 'messages' AND conv_id % 4 = 0)
    UNION ALL SELECT 'alpaca', * FROM ({ALPACA_ROWS})
    UNION ALL SELECT 'custom', * FROM ({CUSTOM_ROWS})""",
)
def e6_from_catalog(spark, sf_dir):
    # A catalogue row is an object, so the bare lists are passed over here.
    return accepted(formats.from_catalog(fx.rec_mixed(spark, sf_dir)), "source_path", "record_no")


@query("e7_import_editor_json", "SELECT conv_id * 10 AS record_no, turn AS n, role, text AS content FROM conversations")
def e7_import_editor_json(spark, sf_dir):
    return accepted(formats.import_editor_json(fx.rec_sharegpt(spark, sf_dir)), "record_no")


@query(
    "e8_import_chatml",
    """SELECT conv_id, turn AS n, role, CASE WHEN ends_with(text, chr(10)) THEN text[:-2] ELSE text END AS content FROM conversations""",
)
def e8_import_chatml(spark, sf_dir):
    return flat(formats.import_chatml(fx.chatml_texts(spark, sf_dir)), "conv_id")


EDITOR_PAIRS = f"""
cut AS ({numbered("doc_id", f"regexp_split_to_array({jstrip('text')}, {lit(chr(13) + '?' + chr(10))})")} FROM docs)),
content AS (
  SELECT doc_id, {jstrip("line")} AS line, row_number() OVER (PARTITION BY doc_id ORDER BY n) - 1 AS n FROM cut
  WHERE {jstrip("line")} <> '' AND NOT starts_with({jstrip("line")}, '#')
),
line_pairs AS (
  SELECT u.doc_id, u.n // 2 AS record_no, u.line AS user, a.line AS assistant
  FROM content u JOIN content a ON a.doc_id = u.doc_id AND a.n = u.n + 1 WHERE u.n % 2 = 0
)"""


@query("e9_import_editor_txt", f"WITH {fx.TXT_DOCUMENTS}, {EDITOR_PAIRS} {PAIR_MESSAGES}")
def e9_import_editor_txt(spark, sf_dir):
    texts = fx.spread(fx.txt_documents(spark, sf_dir), "doc_id")
    return flat(formats.import_editor_txt(texts), "doc_id", "record_no")


@query(
    "e10_convert",
    f"""WITH {CLEAN_TURNS}, {ALPACA}
    SELECT 'jsonl' AS format, count(*) AS samples FROM valid UNION ALL SELECT 'sharegpt', count(*) FROM valid
    UNION ALL SELECT 'alpaca', count(*) FROM alpaca WHERE ask <> '' AND reply <> ''
    UNION ALL SELECT 'custom', count(*) FROM part""",
)
def e10_convert(spark, sf_dir):
    inputs = {
        "jsonl": fx.rec_messages(spark, sf_dir),
        "sharegpt": fx.rec_sharegpt(spark, sf_dir),
        "alpaca": fx.rec_alpaca(spark, sf_dir),
        "custom": fx.rec_custom(spark, sf_dir),
    }
    total = None
    for name, records in inputs.items():
        found = formats.samples(formats.convert(records, name.upper()), PERMISSIVE).select(F.lit(name).alias("format"))
        total = found if total is None else total.unionByName(found)
    return total.groupBy("format").agg(F.count(F.lit(1)).alias("samples"))


@query(
    "e11_sniff_format",
    """SELECT 'd' || doc_id AS name, 'txt' AS format FROM documents
    UNION ALL SELECT DISTINCT 'c' || conv_id, 'chatml' FROM conversations
    UNION ALL SELECT DISTINCT 'r' || conv_id || CASE WHEN conv_id % 2 = 0 THEN '' ELSE '.jsonl' END, 'json' FROM conversations""",
)
def e11_sniff_format(spark, sf_dir):
    conv = F.col("conv_id")
    docs = fx.load(spark, sf_dir, "documents").select(F.concat(F.lit("d"), "doc_id").alias("name"), "text")
    marked = fx.chatml_texts(spark, sf_dir).select(F.concat(F.lit("c"), conv).alias("name"), "text")
    suffix = F.when(conv % 2 == 0, "").otherwise(".jsonl")
    records = fx.conversations(spark, sf_dir).select(
        F.concat(F.lit("r"), conv, suffix).alias("name"), F.concat(F.lit("\n "), F.to_json("messages")).alias("text")
    )
    texts = docs.unionByName(marked).unionByName(records)
    return texts.select("name", formats.sniff_format(F.col("text"), F.col("name")).alias("format"))


@query(
    "e11_import_any",
    f"""WITH docs AS (SELECT doc_id, text FROM documents), {EDITOR_PAIRS}, lined AS ({PAIR_MESSAGES})
    SELECT 'd' || doc_id AS source_path, record_no, n, role, content FROM lined
    UNION ALL SELECT 'c' || conv_id, 0, turn, role, CASE WHEN ends_with(text, chr(10)) THEN text[:-2] ELSE text END FROM conversations
    UNION ALL SELECT 'r' || conv_id, 0, turn, role, coalesce(text, '') FROM conversations""",
)
def e11_import_any(spark, sf_dir):
    name = lambda letter, key: F.concat(F.lit(letter), key).alias("source_path")
    docs = fx.load(spark, sf_dir, "documents").select(name("d", "doc_id"), "text")
    marked = fx.chatml_texts(spark, sf_dir).select(name("c", "conv_id"), "text")
    records = fx.conversations(spark, sf_dir).select(name("r", "conv_id"), F.to_json(F.struct("messages")).alias("text"))
    return flat(formats.import_any(docs.unionByName(marked).unionByName(records)), "source_path", "record_no")


# --- rendering -----------------------------------------------------------------------------


@query(
    "f1_render_training_text",
    f"""WITH {CLEAN_TURNS}
    SELECT conv_id, max(n) + 1 AS n_messages,
      string_agg({CHATML.format(text="content")}, chr(10) ORDER BY n) || chr(10) || '<|im_start|>assistant' || chr(10) AS text
    FROM sample_rows GROUP BY conv_id""",
)
def f1_render_training_text(spark, sf_dir):
    checked = fx.conversations(spark, sf_dir).withColumn("v", F.explode(F.array(messages.validate("messages"))))
    return checked.filter("v.reason is null").select(
        "conv_id",
        F.size("v.messages").cast("bigint").alias("n_messages"),
        render.render_training_text(F.col("v.messages")).alias("text"),
    )


@query(
    "f1_render_turns",
    f"""WITH {CLEAN_TURNS}
    SELECT conv_id, max(n) + 1 AS n_messages,
      string_agg({CHATML.format(text="content")}, chr(10) ORDER BY n) || chr(10) || '<|im_start|>assistant' || chr(10) AS text
    FROM sample_rows GROUP BY conv_id""",
)
def f1_render_turns(spark, sf_dir):
    return render.render_turns(fx.load(spark, sf_dir, "conversations"))


@query(
    "f2_render_chatml",
    f"SELECT conv_id, string_agg({CHATML.format(text='text')}, chr(10) ORDER BY turn) || chr(10) AS text FROM conversations GROUP BY conv_id",
)
def f2_render_chatml(spark, sf_dir):
    return fx.chatml_texts(spark, sf_dir)


@query(
    "f3_render_prompt",
    """SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) || chr(10) || 'assistant:' AS prompt
    FROM conversations GROUP BY conv_id""",
)
def f3_render_prompt(spark, sf_dir):
    found = fx.conversations(spark, sf_dir)
    roleless = F.transform(
        "messages", lambda m: messages.message(F.when(m["role"] != "user", m["role"]), m["content"])
    )
    return found.select("conv_id", render.render_prompt(roleless).alias("prompt"))


@query(
    "f4_sample_title",
    f"""WITH first AS (SELECT conv_id, arg_min(text, turn) AS text FROM conversations WHERE role = 'user' AND conv_id % 5 <> 0 GROUP BY conv_id),
    cut AS (SELECT conv_id, substring({jstrip(f"regexp_replace(text, {lit('[' + JS_SPACE + ']+')}, ' ', 'g')")}, 1, 36) AS t FROM first)
    SELECT c.conv_id, CASE WHEN t <> '' THEN t ELSE '{render.UNTITLED} ' || (c.conv_id + 1) END AS title
    FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN cut USING (conv_id)""",
)
def f4_sample_title(spark, sf_dir):
    # Some conversations open with a blank user message.
    blank = F.array(messages.message(F.lit("user"), F.lit(" ")))
    opened = F.when(F.col("conv_id") % 5 == 0, F.concat(blank, "messages")).otherwise(F.col("messages"))
    return fx.conversations(spark, sf_dir).select(
        "conv_id", render.sample_title(opened, F.col("conv_id") + 1).alias("title")
    )


@query(
    "f5_sample_stats",
    "SELECT messages, count(*) AS samples FROM (SELECT count(*) AS messages FROM conversations GROUP BY conv_id) GROUP BY messages",
)
def f5_sample_stats(spark, sf_dir):
    return render.sample_stats(fx.conversations(spark, sf_dir))
