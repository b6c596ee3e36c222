"""Inputs the queries derive from the given tables. Every row of a table is used, whole;
remainders of ids only choose the layout in which a row is presented."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chatloom.operators.messages import message, samples_from_turns
from chatloom.operators.render import render_chatml


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Deal a scan out over the cores by a key: the given tables are single files."""
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism, key)


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``conv_id, messages``."""
    return samples_from_turns(load(spark, sf_dir, "conversations"))


def _respelled(m: Column, i: Column) -> Column:
    role = (
        F.when(m["role"] == "user", F.element_at(F.array(F.lit("user"), F.lit(" Human "), F.lit("prompt")), i % 3 + 1))
        .when(
            m["role"] == "assistant",
            F.element_at(F.array(F.lit("assistant"), F.lit("GPT"), F.lit("bot")), i % 3 + 1),
        )
        .otherwise(m["role"])
    )
    return message(role, m["content"])


def _records(frame: DataFrame, source: str, key: str, *raws: Column) -> DataFrame:
    """Records ``key * 10 + variant`` for the non-null variants."""
    variants = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), r.alias("raw")) for i, r in enumerate(raws)]))
    return (
        spread(frame, key)
        .select(key, variants.alias("v"))
        .filter(F.col("v.raw").isNotNull())
        .select(
            F.lit(source).alias("source_path"), (F.col(key) * 10 + F.col("v.i")).alias("record_no"), F.col("v.raw").alias("raw")
        )
    )


def rec_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Role names in several spellings, some blank messages, some bare lists; further records
    that are no sample: a foreign object, broken JSON, an unknown role."""
    blank = F.when(F.col("conv_id") % 6 == 5, F.array(message(F.lit("assistant"), F.lit(" 　")))).otherwise(
        F.array().cast("array<struct<role:string,content:string>>")
    )
    found = conversations(spark, sf_dir).withColumn("messages", F.concat(F.transform("messages", _respelled), blank))
    whole = F.to_json(F.struct("messages"))
    conv = F.col("conv_id")
    return _records(
        found,
        "messages",
        "conv_id",
        F.when(conv % 4 == 0, F.to_json("messages")).otherwise(whole),
        F.when(conv % 10 == 9, F.lit('{"x":1}')),
        F.when(conv % 10 == 8, F.lit('{"messages": [')),
        F.when(conv % 10 == 7, F.concat(whole, F.lit(" x"))),
        F.when(conv % 10 == 6, F.lit('{"messages":[{"role":"tool","content":""},{"role":"user","content":"q"}]}')),
    )


def rec_sharegpt(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv = F.col("conv_id")
    sender = lambda m: F.when(m["role"] == "user", "human").when(m["role"] == "assistant", "gpt").otherwise(m["role"])
    plain = F.transform("messages", lambda m: F.struct(sender(m).alias("from"), m["content"].alias("value")))
    renamed = F.col("messages")
    falling = F.transform(
        "messages",
        lambda m: F.struct(
            F.lit("").alias("from"), m["role"].alias("role"), F.lit(0).alias("value"), m["content"].alias("content")
        ),
    )
    wrap = lambda c: F.to_json(F.struct(c.alias("conversations")))
    return _records(
        conversations(spark, sf_dir),
        "sharegpt",
        "conv_id",
        F.when(conv % 6 == 0, wrap(renamed)).when(conv % 6 == 1, wrap(falling)).otherwise(wrap(plain)),
        F.when(conv % 10 == 9, F.lit('{"conversations":[]}')),
    )


def rec_alpaca(spark: SparkSession, sf_dir: str, output: str = "output") -> DataFrame:
    """First line, second line and the rest of each document."""
    lines = F.split("text", "\n")
    record = F.struct(
        F.get(lines, F.lit(0)).alias("instruction"),
        F.coalesce(F.get(lines, F.lit(1)), F.lit("")).alias("input"),
        F.array_join(F.slice(lines, F.lit(3), F.greatest(F.size(lines) - 2, F.lit(0))), "\n").alias(output),
    )
    return _records(load(spark, sf_dir, "documents").select("doc_id", "text"), "alpaca", "doc_id", F.to_json(record))


def rec_custom(spark: SparkSession, sf_dir: str, keys: tuple[str, str, str] = ("user", "assistant", "system")) -> DataFrame:
    system = F.when(F.col("p_size") % 2 == 0, F.col("p_brand"))
    record = F.struct(F.col("p_name").alias(keys[0]), F.col("p_type").alias(keys[1]), system.alias(keys[2]))
    return _records(load(spark, sf_dir, "part"), "custom", "p_partkey", F.to_json(record))


def rec_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        rec_messages(spark, sf_dir)
        .unionByName(rec_sharegpt(spark, sf_dir))
        .unionByName(rec_alpaca(spark, sf_dir, "response"))
        .unionByName(rec_custom(spark, sf_dir))
    )


def txt_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a comment line in front of some and a blank line behind others."""
    note = F.when(F.col("doc_id") % 5 == 0, F.lit("# note\n")).otherwise(F.lit(""))
    tail = F.when(F.col("doc_id") % 7 == 0, F.lit("\n \n")).otherwise(F.lit(""))
    return load(spark, sf_dir, "documents").select("doc_id", F.concat(note, F.col("text"), tail).alias("text"))


TXT_DOCUMENTS = """
docs AS (
  SELECT doc_id, concat(CASE WHEN doc_id % 5 = 0 THEN '# note' || chr(10) ELSE '' END, text,
                        CASE WHEN doc_id % 7 = 0 THEN chr(10) || ' ' || chr(10) ELSE '' END) AS text
  FROM documents
)"""


def chatml_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations(spark, sf_dir).select("conv_id", render_chatml(F.col("messages")).alias("text"))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``conv_id, turn_no, pred``: the turn before, or the gold text; some are null."""
    turns = load(spark, sf_dir, "conversations")
    gold = turns.filter("role = 'assistant'").select("conv_id", F.col("turn").alias("turn_no"), F.col("text").alias("gold"))
    before = turns.select("conv_id", (F.col("turn") + 1).alias("turn_no"), F.col("text").alias("before"))
    mark = F.col("conv_id") + F.col("turn_no")
    pred = F.when(mark % 7 == 0, F.lit(None).cast("string")).when(mark % 3 == 0, F.col("gold")).otherwise(F.col("before"))
    # An inner join: a turn that has none before it gets no prediction row.
    return gold.join(before, ["conv_id", "turn_no"]).select("conv_id", "turn_no", pred.alias("pred"))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Request bodies with a number, a number text, a bad text, null, zero or nothing as budget."""
    e = F.col("event_id")
    value = F.col("value").cast("string")
    budget = (
        F.when(e % 6 == 0, F.concat(F.lit('"max_tokens":'), F.col("user_id"), F.lit(",")))
        .when(e % 6 == 1, F.concat(F.lit('"max_completion_tokens":" '), F.col("user_id"), F.lit('",')))
        .when(e % 6 == 2, F.lit('"max_tokens":"many","max_completion_tokens":9,'))
        .when(e % 6 == 3, F.lit('"max_tokens":null,"max_completion_tokens":77.9,'))
        .when(e % 6 == 4, F.lit('"max_tokens":0,'))
        .otherwise(F.lit(""))
    )
    heat = F.when(e % 4 == 0, F.concat(F.lit('"temperature":'), value, F.lit(","))).when(
        e % 4 == 1, F.concat(F.lit('"temperature":"'), value, F.lit('",'))
    ).when(e % 4 == 2, F.lit('"temperature":[],')).otherwise(F.lit(""))
    think = F.when(e % 5 == 0, F.lit('"enable_thinking":true,')).when(
        e % 5 == 1, F.lit('"enable_thinking":null,"chat_template_kwargs":{"enable_thinking":true},')
    ).when(e % 5 == 2, F.lit('"chat_template_kwargs":{"enable_thinking":1},')).otherwise(F.lit(""))
    asked = F.when(e % 3 == 0, F.concat(F.lit('"messages":[{"role":"user","content":"'), F.col("event_type"), F.lit('"}]'))).when(
        e % 3 == 1, F.concat(F.lit('"prompt":"'), F.col("event_type"), F.lit('"'))
    ).otherwise(F.concat(F.lit('"prompt":["'), F.col("event_type"), F.lit('","x"]')))
    payload = F.concat(F.lit("{"), budget, heat, think, asked, F.lit("}"))
    return load(spark, sf_dir, "events").select("event_id", payload.alias("payload"), (e % 2 == 0).alias("chat"))


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Completion bodies around assistant texts, some with reasoning: ``conv_id, turn, attempt,
    status, body``. Attempt 0 carries the text; some have further attempts, empty or failed."""
    conv, turn = F.col("conv_id"), F.col("turn")
    content = F.when(conv % 5 == 0, F.concat(F.lit("<think> old </think>"), F.col("text"))).otherwise(F.col("text"))
    reasoning = F.when((conv + turn) % 2 == 0, F.lit(" plan "))

    def body(text: Column, reason: Column) -> Column:
        message = F.struct(F.lit("assistant").alias("role"), text.alias("content"), reason.alias("reasoning_content"))
        return F.to_json(F.struct(F.array(F.struct(message.alias("message"))).alias("choices")))

    attempts = [
        (200, body(content, reasoning)),
        (200, F.when(conv % 11 == 0, body(F.lit(""), F.lit(None).cast("string")))),
        (503, F.when(conv % 13 == 12, F.lit("busy"))),
        (400, F.when(conv % 13 == 11, F.lit('{"error":{"message":"bad request"}}'))),
    ]
    tried = F.array(*[F.struct(F.lit(i).alias("attempt"), F.lit(c).alias("status"), b.alias("body")) for i, (c, b) in enumerate(attempts)])
    return (
        load(spark, sf_dir, "conversations")
        .filter("role = 'assistant'")
        .select("conv_id", "turn", F.explode(tried).alias("a"))
        .filter("a.body is not null")
        .select("conv_id", "turn", "a.attempt", "a.status", "a.body")
    )


PIECE = 40


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assistant texts cut into pieces; the last piece carries finish and usage, except where it
    was lost; some pause for a minute in the middle: ``id, seq, ts, content, finish_reason,
    total_tokens, conv_id``."""
    turns = load(spark, sf_dir, "conversations").filter("role = 'assistant'")
    pieces = F.greatest(F.ceil(F.length("text") / PIECE), F.lit(1)).cast("int")
    cut = turns.select(
        "conv_id", "turn", "text", pieces.alias("pieces"), F.explode(F.sequence(F.lit(0), pieces - 1)).alias("seq")
    )
    last = (F.col("seq") == F.col("pieces") - 1) & (F.col("conv_id") % 13 != 0)
    start = F.lit(1_700_000_000) + F.col("conv_id") * 600 + F.col("turn") * 60
    pause = F.when((F.col("conv_id") % 4 == 1) & (F.col("seq") * 2 >= F.col("pieces")), 60).otherwise(0)
    return cut.select(
        F.concat_ws("-", "conv_id", "turn").alias("id"),
        F.col("seq").cast("bigint").alias("seq"),
        F.timestamp_seconds(start + F.pmod("seq", F.lit(20)) + pause).alias("ts"),
        F.expr(f"substring(text, seq * {PIECE} + 1, {PIECE})").alias("content"),
        F.when(last, "stop").alias("finish_reason"),
        F.when(last, F.col("pieces").cast("bigint")).alias("total_tokens"),
        "conv_id",
    )


CHUNKS = f"""
assistant AS (
  SELECT conv_id, turn, concat_ws('-', conv_id, turn) AS id, text, greatest(ceil(length(text) / {PIECE}.0), 1)::BIGINT AS pieces
  FROM conversations WHERE role = 'assistant'
)"""


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``event_id, line``: log lines that carry a key made of the user id."""
    line = F.concat(
        F.lit("INFO "), F.col("event_type"), F.lit(" api-key sk-"), F.col("user_id"), F.lit(" event="), F.col("event_id")
    )
    return load(spark, sf_dir, "events").select("event_id", line.alias("line"))


def cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``model_id, file, text``: three documents make one model's card files."""
    d = F.col("doc_id")
    model = F.floor(d / 3)
    name = F.element_at(F.array(F.lit("apache-2.0"), F.lit("'MIT'"), F.lit("CC BY NC"), F.lit("")), (model % 4 + 1).cast("int"))
    readme = F.concat(F.lit("---\ntags: a:b\nLicense: other\nlicense : "), name, F.lit("\n---\n"), F.col("text"))
    config = F.when(model % 3 == 0, F.to_json(F.struct(F.lit("llama 3 community").alias("license"), "lang", "text"))).when(
        model % 3 == 1, F.to_json(F.struct(F.lit("").alias("license"), "text"))
    ).otherwise(F.concat(F.lit("{"), F.coalesce("text", F.lit(""))))
    return load(spark, sf_dir, "documents").select(
        model.alias("model_id"),
        F.when(d % 3 == 0, "README.md")
        .when((d % 3 == 1) & (model % 5 < 3), "LICENSE")
        .when(d % 3 == 1, "NOTES.md")
        .otherwise("configuration.json")
        .alias("file"),
        F.when(d % 3 == 0, readme).when(d % 3 == 1, F.col("text")).otherwise(config).alias("text"),
    )


CARDS = """
cards AS (
  SELECT doc_id // 3 AS model_id,
    CASE WHEN doc_id % 3 = 0 THEN 'README.md' WHEN doc_id % 3 = 1 AND (doc_id // 3) % 5 < 3 THEN 'LICENSE'
         WHEN doc_id % 3 = 1 THEN 'NOTES.md' ELSE 'configuration.json' END AS file,
    (['apache-2.0', 'MIT', 'CC BY NC', ''])[(doc_id // 3) % 4 + 1] AS front,
    CASE WHEN (doc_id // 3) % 3 = 0 THEN 'llama 3 community' END AS config,
    text
  FROM documents
)"""

# The files a part stands for in the snapshot listing.
LISTED = (
    "config.json", "tokenizer.json", "vocab.json", "merges.txt", "weights/a-00001.safetensors", "model-00002.BIN",
    "adapter_config.json", "README.md",
)


def listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``model_id, path, size, mtime``: one file per part, below one model per brand and size."""
    p = F.col("p_partkey")
    path = F.element_at(F.array(*[F.lit(x) for x in LISTED]), (p % 8 + 1).cast("int"))
    return load(spark, sf_dir, "part").select(
        F.concat_ws("/", "p_brand", (F.col("p_size") % 4).cast("string")).alias("model_id"),
        F.when(p % 8 == 4, F.concat(F.lit("shard-"), (p % 40).cast("string"), F.lit(".safetensors"))).otherwise(path).alias("path"),
        (F.col("p_size") % 3).cast("bigint").alias("size"),
        p.alias("mtime"),
    )


LISTING = f"""
listing AS (
  SELECT concat_ws('/', p_brand, p_size % 4) AS model_id,
    CASE WHEN p_partkey % 8 = 4 THEN 'shard-' || (p_partkey % 40) || '.safetensors'
         ELSE ([{", ".join(f"'{x}'" for x in LISTED)}])[p_partkey % 8 + 1] END AS path,
    (p_size % 3)::BIGINT AS size, p_partkey AS mtime
  FROM part
)"""


def shard_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``model_id, raw``: each brand's index names the shards 4, 12, 20, 28, 36 and one per type."""
    fixed = [F.lit(f"shard-{n}.safetensors") for n in (4, 12, 20, 28, 36)]
    named = load(spark, sf_dir, "part").groupBy(
        F.concat_ws("/", "p_brand", (F.col("p_size") % 4).cast("string")).alias("model_id")
    ).agg(F.sort_array(F.collect_set(F.concat(F.lower("p_type"), F.lit(".bin")))).alias("types"))
    shards = F.concat(F.array(*fixed), F.col("types"))
    weight_map = F.map_from_entries(F.transform(shards, lambda s, i: F.struct(F.concat(F.lit("layer."), i).alias("k"), s.alias("v"))))
    body = F.to_json(F.struct(weight_map.alias("weight_map")))
    return named.select("model_id", F.when(F.endswith("model_id", F.lit("3")), F.lit("{")).otherwise(body).alias("raw"))


SHARDS = """
named AS (
  SELECT model_id, unnest([concat('shard-', x, '.safetensors') FOR x IN [4, 12, 20, 28, 36]]) AS shard
  FROM (SELECT DISTINCT concat_ws('/', p_brand, p_size % 4) AS model_id FROM part) WHERE NOT ends_with(model_id, '3')
  UNION
  SELECT model_id, shard FROM (
    SELECT concat_ws('/', p_brand, p_size % 4) AS model_id, concat(lower(p_type), '.bin') AS shard FROM part
  ) WHERE NOT ends_with(model_id, '3')
),
missing AS (
  SELECT model_id, shard FROM named
  WHERE NOT EXISTS (SELECT 1 FROM listing l WHERE l.model_id = named.model_id AND l.path = shard AND l.size > 0)
)"""
