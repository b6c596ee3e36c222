"""Queries over request and response logs, drafting, and streams."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from chatloom.operators import drafting, evaluate, responses as rs
from chatloom.operators.governance import redact_literal
from chatloom.operators.secrets import redact_table
from chatloom.plans import fixtures as fx
from chatloom.plans.corpus import flat
from chatloom.plans.registry import query
from chatloom.plans.sql import lit, strip
from chatloom.session import scratch_path
from chatloom.streaming import chunks as cs
from chatloom.streaming import follow as fl
from chatloom.streaming import logs as ls

WRAPPED = "CASE WHEN conv_id % 4 = 0 THEN text WHEN conv_id % 4 = 1 THEN '<think> ' || text || chr(10) || '</think>x' ELSE '<think></think><think>b</think>' || text END"


def wrapped(spark, sf_dir):
    conv, text = F.col("conv_id"), F.col("text")
    content = (
        F.when(conv % 4 == 0, text)
        .when(conv % 4 == 1, F.concat(F.lit("<think> "), text, F.lit("\n</think>x")))
        .otherwise(F.concat(F.lit("<think></think><think>b</think>"), text))
    )
    return fx.load(spark, sf_dir, "conversations").select("conv_id", "turn", "text", content.alias("content"))


@query(
    "i1_extract_reasoning",
    f"""SELECT conv_id, turn, CASE WHEN conv_id % 4 = 0 THEN NULL WHEN conv_id % 4 = 1 THEN {strip("text")} ELSE '' END AS reasoning_content
    FROM conversations""",
)
def i1_extract_reasoning(spark, sf_dir):
    return wrapped(spark, sf_dir).select("conv_id", "turn", rs.extract_reasoning(F.col("content")).alias("reasoning_content"))


@query(
    "i2_merge_reasoning",
    f"""WITH w AS (SELECT *, {WRAPPED} AS content, CASE turn % 3 WHEN 0 THEN ' why ' WHEN 1 THEN '  ' END AS reason FROM conversations)
    SELECT conv_id, turn,
      CASE WHEN turn % 3 = 0 AND NOT contains(content, '<think>') THEN '<think>why</think>' || content ELSE content END AS merged,
      CASE WHEN reason IS NOT NULL AND NOT contains(content, '<think>') THEN '<think>' || reason || '</think>' || content ELSE content END AS merged_raw
    FROM w""",
)
def i2_merge_reasoning(spark, sf_dir):
    reason = F.when(F.col("turn") % 3 == 0, " why ").when(F.col("turn") % 3 == 1, "  ")
    return wrapped(spark, sf_dir).select(
        "conv_id", "turn",
        rs.merge_reasoning(F.col("content"), reason).alias("merged"),
        rs.merge_reasoning_raw(F.col("content"), reason).alias("merged_raw"),
    )


@query(
    "i3_strip_specials",
    f"SELECT conv_id, turn, {strip('text')} || CASE WHEN turn % 2 = 0 THEN '</think>' ELSE '' END AS text FROM conversations",
)
def i3_strip_specials(spark, sf_dir):
    tail = F.when(F.col("turn") % 2 == 0, "</think></s>").otherwise("<|pad|>")
    framed = F.concat(F.lit("<s><s>_x "), F.trim("text"), tail, F.lit(" <unk>"))
    text = rs.strip_specials(framed, ("<s>", "</s>", "<|pad|>", "<unk>", "<s>_x", "</think>"))
    return fx.load(spark, sf_dir, "conversations").select("conv_id", "turn", text.alias("text"))


@query(
    "i4_normalize_request",
    """WITH r AS (
      SELECT *, event_id % 2 = 0 AS chat,
        CASE event_id % 6 WHEN 0 THEN user_id WHEN 1 THEN user_id WHEN 2 THEN 256 WHEN 3 THEN 77 WHEN 4 THEN 0 ELSE 256 END AS budget,
        CASE WHEN event_id % 4 < 2 THEN value ELSE 0.0::DOUBLE END AS heat
      FROM events
    )
    SELECT event_id, true AS ok, greatest(1, budget)::BIGINT AS max_tokens, heat AS temperature, heat > 0 AS do_sample,
      CASE WHEN heat > 0 THEN greatest(heat, 0.01::DOUBLE) END AS sampling_temperature, event_id % 5 IN (0, 2) AS enable_thinking,
      'served' AS model, CASE WHEN chat THEN 'user' END AS role,
      CASE WHEN NOT chat THEN NULL WHEN event_id % 3 = 2 THEN '["' || event_type || '","x"]' ELSE event_type END AS content,
      CASE WHEN chat THEN NULL WHEN event_id % 3 = 0 THEN '' ELSE event_type END AS prompt
    FROM r""",
)
def i4_normalize_request(spark, sf_dir):
    found = rs.normalize_request(fx.spread(fx.requests(spark, sf_dir), "event_id"), default_model="served")
    first = F.get("messages", F.lit(0))
    return found.select(
        "event_id", "ok", "max_tokens", "temperature", "do_sample", "sampling_temperature", "enable_thinking", "model",
        first["role"].alias("role"), first["content"].alias("content"), "prompt",
    )


@query(
    "i5_usage_rollup",
    """SELECT event_type AS model, count(*) AS requests, sum(user_id)::BIGINT AS prompt_tokens, sum(event_id % 5)::BIGINT AS completion_tokens,
      sum(user_id + event_id % 5)::BIGINT AS total_tokens, count(*) FILTER (WHERE event_id % 5 = 0) AS empty_completions
    FROM events GROUP BY event_type""",
)
def i5_usage_rollup(spark, sf_dir):
    usage = fx.load(spark, sf_dir, "events").select(
        F.col("event_type").alias("model"), F.col("user_id").alias("prompt_tokens"), (F.col("event_id") % 5).alias("completion_tokens")
    )
    return rs.usage_rollup(usage)


RESPONSES = """
answered AS (
  SELECT conv_id, turn, CASE WHEN conv_id % 5 = 0 THEN '<think> old </think>' || text ELSE text END AS content, (conv_id + turn) % 2 = 0 AS reasoned
  FROM conversations WHERE role = 'assistant'
),
outcome AS (
  SELECT conv_id, turn, 0 AS attempt,
    CASE WHEN reasoned AND NOT contains(content, '<think>') THEN '<think> plan </think>' || content ELSE content END AS text, NULL AS error
  FROM answered
  UNION ALL SELECT conv_id, turn, 1, NULL, 'empty content' FROM answered WHERE conv_id % 11 = 0
  UNION ALL SELECT conv_id, turn, 2, NULL, 'HTTP 503' FROM answered WHERE conv_id % 13 = 12
  UNION ALL SELECT conv_id, turn, 3, NULL, 'bad request' FROM answered WHERE conv_id % 13 = 11
)"""


@query("i6_parse_responses", f"WITH {RESPONSES} SELECT conv_id, turn, attempt, text, error FROM outcome")
def i6_parse_responses(spark, sf_dir):
    found = rs.parse_responses(fx.responses(spark, sf_dir), status="status")
    return found.select("conv_id", "turn", "attempt", "text", "error")


ASSEMBLED = f"""WITH {fx.CHUNKS}
SELECT id, text AS content, CASE WHEN conv_id % 13 <> 0 THEN 'stop' END AS finish_reason,
  CASE WHEN conv_id % 13 <> 0 THEN pieces END AS total_tokens, pieces AS chunks FROM assistant"""


@query("i7_assemble_chunks", ASSEMBLED)
def i7_assemble_chunks(spark, sf_dir):
    return rs.assemble_chunks(fx.chunks(spark, sf_dir))


# --- drafting ------------------------------------------------------------------------------


@query(
    "j1_build_generation_batch",
    """SELECT p_partkey, candidate, 'm' AS model, p_name AS content, 0.7::DOUBLE AS temperature, 64 AS max_tokens, true AS thinking
    FROM part, (VALUES (1), (2), (3)) c(candidate)""",
)
def j1_build_generation_batch(spark, sf_dir):
    prompts = fx.load(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit(" "), "p_name", F.lit("\n")).alias("prompt"))
    batch = drafting.build_generation_batch(prompts, 3, "m", 0.7, 64, True)
    body = F.from_json(
        "body",
        "model string, messages array<struct<role:string,content:string>>, temperature double, max_tokens int, "
        "chat_template_kwargs struct<enable_thinking:boolean>",
    )
    return batch.select("p_partkey", "candidate", body.alias("b")).select(
        "p_partkey", "candidate", "b.model", F.get("b.messages", F.lit(0))["content"].alias("content"), "b.temperature",
        "b.max_tokens", F.col("b.chat_template_kwargs.enable_thinking").alias("thinking"),
    )


@query(
    "j2_build_eval_batch",
    """SELECT g.conv_id, g.turn AS turn_no, 'm' AS model, 0 AS temperature, count(p.turn) AS messages, coalesce(sum(length(p.text)), 0)::BIGINT AS chars
    FROM conversations g LEFT JOIN conversations p ON p.conv_id = g.conv_id AND p.turn < g.turn
    WHERE g.role = 'assistant' GROUP BY g.conv_id, g.turn""",
)
def j2_build_eval_batch(spark, sf_dir):
    batch = drafting.build_eval_batch(evaluate.assistant_turns(fx.conversations(spark, sf_dir)), "m")
    body = F.from_json("body", "model string, temperature int, messages array<struct<role:string,content:string>>")
    found = batch.select("conv_id", F.col("turn_no").cast("bigint").alias("turn_no"), body.alias("b"))
    return found.select(
        "conv_id", "turn_no", "b.model", "b.temperature", F.size("b.messages").cast("bigint").alias("messages"),
        F.aggregate("b.messages", F.lit(0).cast("bigint"), lambda s, m: s + F.length(m["content"])).alias("chars"),
    )


@query(
    "j3_build_prompt_requests",
    r"""SELECT p_partkey, 'You write user prompts for a ChatML training set. Return ONLY a JSON array of strings. No markdown. Each item is one user message. Language follows the topic.' AS system,
      'Topic:\n' || p_name || '\n\nCount: 8' AS user, 0.9::DOUBLE AS temperature, 1024 AS max_tokens FROM part""",
)
def j3_build_prompt_requests(spark, sf_dir):
    # Every part's name, and a blank topic behind it.
    named = F.array(F.concat(F.col("p_name"), F.lit(" ")), F.lit(" "))
    topics = fx.load(spark, sf_dir, "part").select("p_partkey", F.explode(named).alias("topic"))
    body = F.from_json("body", "messages array<struct<content:string>>, temperature double, max_tokens int")
    found = drafting.build_prompt_requests(topics, "m").select("p_partkey", body.alias("b"))
    return found.select(
        "p_partkey", F.get("b.messages", F.lit(0))["content"].alias("system"), F.get("b.messages", F.lit(1))["content"].alias("user"),
        "b.temperature", "b.max_tokens",
    )


def prompt_answers(spark, sf_dir):
    """All lines of a document as a JSON array, a prompts object, a fenced array or a list."""
    d, lines = F.col("doc_id"), F.split("text", "\n")
    plain = F.to_json(lines)
    objects = F.to_json(F.transform(lines, lambda x: F.struct(F.lit("").alias("prompt"), x.alias("content"))))
    bullet = F.transform(lines, lambda x, i: F.concat(F.when(i % 2 == 0, F.concat((i + 1).cast("string"), F.lit(") "))).otherwise("- "), x))
    text = (
        F.when(d % 5 == 0, plain)
        .when(d % 5 == 1, objects)
        .when(d % 5 == 2, F.to_json(F.struct(lines.alias("prompts"))))
        .when(d % 5 == 3, F.concat(F.lit("Sure:\n```json\n"), plain, F.lit("\n```\nbye")))
        .otherwise(F.array_join(bullet, "\r\n"))
    )
    return fx.spread(fx.load(spark, sf_dir, "documents"), "doc_id").select("doc_id", text.alias("text"))


@query(
    "j4_parse_prompt_list",
    f"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
    cleaned AS (SELECT doc_id, i, CASE WHEN doc_id % 5 = 4 THEN {strip("x")} ELSE x END AS prompt FROM l)
    SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS n, prompt FROM cleaned
    WHERE CASE doc_id % 5 WHEN 3 THEN true WHEN 4 THEN length(prompt) > 1 ELSE prompt <> '' END""",
)
def j4_parse_prompt_list(spark, sf_dir):
    found = drafting.drafted_prompts(prompt_answers(spark, sf_dir))
    return found.withColumn("n", F.col("n").cast("bigint"))


@query(
    "j5_accept_candidates",
    f"""WITH {RESPONSES}, done AS (SELECT conv_id, turn, text FROM outcome WHERE error IS NULL)
    SELECT 'c' || conv_id AS sample_id, turn AS n, role, text AS content FROM conversations
    UNION ALL SELECT 'd' || conv_id || '-' || turn, 0, 'user', 'ask ' || conv_id FROM done
    UNION ALL SELECT 'd' || conv_id || '-' || turn, 1, 'assistant', text FROM done""",
)
def j5_accept_candidates(spark, sf_dir):
    answers = rs.parse_responses(fx.responses(spark, sf_dir), status="status")
    candidates = answers.select(
        F.concat(F.lit("d"), "conv_id", F.lit("-"), "turn").alias("sample_id"),
        F.concat(F.lit(" ask "), "conv_id").alias("prompt"), "text", "error",
    )
    corpus = fx.conversations(spark, sf_dir).select(F.concat(F.lit("c"), "conv_id").alias("sample_id"), "messages")
    return flat(drafting.accept_candidates(corpus, candidates), "sample_id")


# --- streams -------------------------------------------------------------------------------

SECRETS = ("sk-1", "sk-10", "sk-7", "sk-77")
REDACTED = """replace(replace(replace(replace(line, 'sk-10', '***'), 'sk-77', '***'), 'sk-1', '***'), 'sk-7', '***')"""
LINES = "l AS (SELECT event_id, concat('INFO ', event_type, ' api-key sk-', user_id, ' event=', event_id) AS line FROM events)"


def landed_logs(spark, sf_dir):
    path = scratch_path(spark, "logs")
    fx.log_lines(spark, sf_dir).select("line").write.text(path)
    return path


@query("a6_scan_log_stream", f"WITH {LINES} SELECT line FROM l")
def a6_scan_log_stream(spark, sf_dir):
    out = scratch_path(spark, "log-out")
    stream = ls.scan_log_stream(spark, landed_logs(spark, sf_dir)).select("line")
    cs.run_available(stream, out, scratch_path(spark, "log-ckpt"))
    return spark.read.schema("line string").parquet(out)


@query("m1_follow_logs", f"WITH {LINES} SELECT {REDACTED} AS line FROM l")
def m1_follow_logs(spark, sf_dir):
    out = scratch_path(spark, "log-out")
    begun = datetime.now(timezone.utc) - timedelta(seconds=5)
    stream = ls.follow_logs(ls.scan_log_stream(spark, landed_logs(spark, sf_dir), 1), SECRETS, begun)
    cs.run_available(stream, out, scratch_path(spark, "log-ckpt"))
    return spark.read.schema("line string").parquet(out)


def landed_chunks(spark, sf_dir, closing: bool):
    """Chunk events as they were sent, in time order; a last far-off event closes the sessions."""
    found = fx.chunks(spark, sf_dir).drop("conv_id")
    if closing:
        far = spark.createDataFrame([("closing", 0)], "id string, seq long").withColumn("ts", F.timestamp_seconds(F.lit(4_000_000_000)))
        found = found.unionByName(far, allowMissingColumns=True)
    delta = F.struct(F.col("content"))
    choice = F.struct(F.lit(0).alias("index"), delta.alias("delta"), F.col("finish_reason"))
    usage = F.when(F.col("total_tokens").isNotNull(), F.struct("total_tokens"))
    event = F.struct(
        "id", F.lit("chat.completion.chunk").alias("object"), F.array(choice).alias("choices"), usage.alias("usage"), "seq", "ts"
    )
    path = scratch_path(spark, "chunks")
    # Range-partitioned by time: every file holds one span of time, as a rotated log does.
    ordered = found.repartitionByRange(4, "ts").sortWithinPartitions("ts", "id", "seq")
    ordered.select(F.to_json(event).alias("value")).write.text(path)
    return path


@query(
    "a7_scan_chunk_stream",
    f"""WITH {fx.CHUNKS} SELECT id, seq, substring(text, seq * {fx.PIECE} + 1, {fx.PIECE}) AS content,
      CASE WHEN seq = pieces - 1 AND conv_id % 13 <> 0 THEN 'stop' END AS finish_reason
    FROM (SELECT *, unnest(range(0, pieces)) AS seq FROM assistant)""",
)
def a7_scan_chunk_stream(spark, sf_dir):
    out = scratch_path(spark, "chunk-out")
    stream = cs.scan_chunk_stream(spark, landed_chunks(spark, sf_dir, False))
    cs.run_available(stream, out, scratch_path(spark, "chunk-ckpt"))
    return spark.read.parquet(out).select("id", "seq", "content", "finish_reason")


@query("m2_assemble_chunk_stream", ASSEMBLED)
def m2_assemble_chunk_stream(spark, sf_dir):
    out = scratch_path(spark, "session-out")
    stream = cs.assemble_chunk_stream(cs.scan_chunk_stream(spark, landed_chunks(spark, sf_dir, True)))
    cs.run_available(stream, out, scratch_path(spark, "session-ckpt"))
    return spark.read.parquet(out).drop("started")


@query("m1_follow_files", f"WITH {LINES} SELECT {REDACTED} AS line FROM l")
def m1_follow_files(spark, sf_dir):
    out = scratch_path(spark, "log-out")
    stream = fl.follow_files(spark, landed_logs(spark, sf_dir), SECRETS, "earliest").select("line")
    cs.run_available(stream, out, scratch_path(spark, "log-ckpt"))
    return spark.read.schema("line string").parquet(out)


@query("k7_redact_literal", f"WITH {LINES} SELECT event_id, {REDACTED} AS line FROM l")
def k7_redact_literal(spark, sf_dir):
    lines = fx.log_lines(spark, sf_dir)
    return lines.select("event_id", redact_literal(F.col("line"), SECRETS).alias("line"))


# Secrets are the keys of two users in three; the longest that a line's key begins with is covered.
TABLED = f"""WITH {LINES}, s AS (SELECT DISTINCT 'sk-' || user_id AS secret FROM events WHERE user_id % 3 > 0),
  k AS (SELECT DISTINCT user_id, 'sk-' || user_id AS key FROM events),
  cut AS (SELECT user_id, key, unnest(range(4, length(key) + 1)) AS n FROM k),
  longest AS (SELECT user_id, max(n) AS n FROM cut JOIN s ON secret = key[1:n] GROUP BY user_id)
  SELECT e.event_id, concat('INFO ', event_type, ' api-key ', CASE WHEN n IS NULL THEN 'sk-' || e.user_id ELSE '***' || ('sk-' || e.user_id)[n + 1:] END, ' event=', e.event_id) AS line
  FROM events e LEFT JOIN longest USING (user_id)"""


def secret_table(spark, sf_dir):
    users = fx.load(spark, sf_dir, "events").where("user_id % 3 > 0")
    return users.select(F.concat(F.lit("sk-"), "user_id").alias("secret"))


@query("k7_redact_table", TABLED)
def k7_redact_table(spark, sf_dir):
    return redact_table(fx.log_lines(spark, sf_dir), secret_table(spark, sf_dir))


@query("k7_redact_table_joined", TABLED)
def k7_redact_table_joined(spark, sf_dir):
    """The way of tables that are too large to be sent to tasks."""
    return redact_table(fx.log_lines(spark, sf_dir), secret_table(spark, sf_dir), secret_bytes=0)
