"""Queries over splitting and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from chatloom.functions import scoring
from chatloom.operators import evaluate, formats, render, report, split
from chatloom.plans import fixtures as fx
from chatloom.plans.corpus import CONTENT
from chatloom.plans.registry import query
from chatloom.plans.sql import CLEAN_TURNS, PREDICTIONS, f_measure, strip, tokens
from chatloom.session import scratch_path
from chatloom.sources import sinks

SEED, EVAL_SPLIT = 42, 0.1
KEYS = ("conv_id", "turn_no")


def ranked_split(table: str, key: str) -> str:
    return f"""
    SELECT {key}, CASE WHEN row_number() OVER (ORDER BY md5('{SEED}:' || {key}), {key}) <=
      CASE WHEN n < 2 THEN 0 ELSE least(greatest(1, round_even(n * {EVAL_SPLIT}::DOUBLE, 0)), n - 1) END
      THEN 'eval' ELSE 'train' END AS split
    FROM {table}, (SELECT count(*) AS n FROM {table})"""


@query("g1_split_records", ranked_split("orders", "o_orderkey"))
def g1_split_records(spark, sf_dir):
    found = fx.load(spark, sf_dir, "orders").select("o_orderkey")
    return split.split_records(found, EVAL_SPLIT, SEED, "o_orderkey")


@query(
    "g1_split_samples",
    f"WITH {CLEAN_TURNS}, ids AS (SELECT DISTINCT conv_id FROM sample_rows) {ranked_split('ids', 'conv_id')}",
)
def g1_split_samples(spark, sf_dir):
    ids = formats.samples(formats.from_messages_jsonl(fx.rec_messages(spark, sf_dir)))
    found = ids.select((F.col("record_no") / 10).cast("bigint").alias("conv_id"))
    return split.split_records(found, EVAL_SPLIT, SEED, "conv_id", settled=False)


@query(
    "g2_attach_eval_set",
    """SELECT 'train' AS split, count(*) AS samples, sum(n)::BIGINT AS messages FROM (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id)
    UNION ALL SELECT 'eval', count(*), 2 * count(*) FROM part""",
)
def g2_attach_eval_set(spark, sf_dir):
    train = fx.conversations(spark, sf_dir).select(F.concat(F.lit("c"), "conv_id").alias("sample_id"), "messages")
    pair = F.array(
        F.struct(F.lit("user").alias("role"), F.col("p_name").alias("content")),
        F.struct(F.lit("assistant").alias("role"), F.col("p_type").alias("content")),
    )
    held = fx.load(spark, sf_dir, "part").select(F.concat(F.lit("p"), "p_partkey").alias("sample_id"), pair.alias("messages"))
    both = split.attach_eval_set(train, held)
    return both.groupBy("split").agg(
        F.count(F.lit(1)).alias("samples"), F.sum(F.size("messages").cast("bigint")).alias("messages")
    )


@query(
    "g3_limit_samples",
    f"WITH {CLEAN_TURNS} SELECT DISTINCT conv_id * 10 AS record_no FROM sample_rows ORDER BY 1 LIMIT 5",
)
def g3_limit_samples(spark, sf_dir):
    found = formats.samples(formats.from_messages_jsonl(fx.rec_messages(spark, sf_dir)))
    return split.limit_samples(found, 5).select("record_no")


@query(
    "g4_latest_checkpoint",
    """SELECT p_brand AS run_id, arg_max(CASE WHEN p_size % 3 > 0 THEN concat('out/checkpoint-', p_partkey) END,
         CASE WHEN p_size % 3 > 0 THEN (p_size, concat('out/checkpoint-', p_partkey)) END) AS checkpoint
    FROM part GROUP BY p_brand""",
)
def g4_latest_checkpoint(spark, sf_dir):
    name = F.when(F.col("p_size") % 3 > 0, "out/checkpoint-").otherwise("out/final-")
    listing = fx.load(spark, sf_dir, "part").select(
        F.col("p_brand").alias("run_id"), F.concat(name, "p_partkey").alias("path"), F.col("p_size").alias("mtime")
    )
    return split.latest_checkpoint(listing)


@query(
    "h1_assistant_turns",
    """SELECT g.conv_id, g.turn AS turn_no, g.text AS gold,
      coalesce(string_agg(p.role || ': ' || p.text, chr(10) ORDER BY p.turn) || chr(10), '') || 'assistant:' AS prompt
    FROM conversations g LEFT JOIN conversations p ON p.conv_id = g.conv_id AND p.turn < g.turn
    WHERE g.role = 'assistant' GROUP BY g.conv_id, g.turn, g.text""",
)
def h1_assistant_turns(spark, sf_dir):
    gold = evaluate.assistant_turns(fx.conversations(spark, sf_dir))
    return gold.select(
        "conv_id", F.col("turn_no").cast("bigint").alias("turn_no"), "gold", render.render_prompt(F.col("prompt")).alias("prompt")
    )


@query("h1_gold_turns", "SELECT conv_id, turn AS turn_no, text AS gold FROM conversations WHERE role = 'assistant'")
def h1_gold_turns(spark, sf_dir):
    return evaluate.gold_turns(fx.load(spark, sf_dir, "conversations"))


def scored_pairs(spark, sf_dir):
    gold = evaluate.gold_turns(fx.load(spark, sf_dir, "conversations"))
    return evaluate.attach_predictions(gold, fx.predictions(spark, sf_dir), KEYS)


def one_metric(spark, sf_dir, name):
    return evaluate.score(scored_pairs(spark, sf_dir), (name,)).select(*KEYS, name)


@query("h2_attach_predictions", f"WITH {PREDICTIONS} SELECT conv_id, turn_no, gold, pred FROM pairs")
def h2_attach_predictions(spark, sf_dir):
    return scored_pairs(spark, sf_dir)


@query(
    "h3_exact_match",
    f"WITH {PREDICTIONS} SELECT conv_id, turn_no, CASE WHEN {strip('pred')} = {strip('gold')} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS exact_match FROM pairs",
)
def h3_exact_match(spark, sf_dir):
    return one_metric(spark, sf_dir, "exact_match")


LENGTH_RATIO = """CASE WHEN gold = '' THEN 0.0::DOUBLE
  ELSE least(length(pred), length(gold))::DOUBLE / greatest(length(pred), length(gold), 1) END"""


@query("h4_length_ratio", f"WITH {PREDICTIONS} SELECT conv_id, turn_no, {LENGTH_RATIO} AS length_ratio FROM pairs")
def h4_length_ratio(spark, sf_dir):
    return one_metric(spark, sf_dir, "length_ratio")


@query("h5_tokens", f"SELECT conv_id, turn, array_to_string({tokens('text')}, '|') AS tokens FROM conversations")
def h5_tokens(spark, sf_dir):
    turns = fx.load(spark, sf_dir, "conversations")
    return turns.select("conv_id", "turn", F.array_join(scoring.tokens(F.col("text")), "|").alias("tokens"))


TOKENS = f"toks AS (SELECT conv_id, turn_no, pred, gold, {tokens('pred')} AS p, {tokens('gold')} AS g FROM pairs)"
OVERLAP = f"""{TOKENS},
counts AS (
  SELECT conv_id, turn_no, t, count(*) FILTER (WHERE s = 'p') AS np, count(*) FILTER (WHERE s = 'g') AS ng FROM (
    SELECT conv_id, turn_no, 'p' AS s, unnest(p) AS t FROM toks UNION ALL SELECT conv_id, turn_no, 'g', unnest(g) FROM toks
  ) GROUP BY conv_id, turn_no, t
),
overlap AS (SELECT conv_id, turn_no, sum(least(np, ng)) AS hits FROM counts GROUP BY conv_id, turn_no),
f1 AS (
  SELECT conv_id, turn_no, {f_measure("coalesce(hits, 0)", "len(p)", "len(g)")} AS token_f1
  FROM toks LEFT JOIN overlap USING (conv_id, turn_no)
)"""


@query("h6_token_f1", f"WITH {PREDICTIONS}, {OVERLAP} SELECT conv_id, turn_no, token_f1 FROM f1")
def h6_token_f1(spark, sf_dir):
    return one_metric(spark, sf_dir, "token_f1")


# ``ends[k + 1]`` is the smallest gold position at which a common subsequence of length k can end.
# Every prediction token that occurs in gold moves these ends down, all k at once.
LCS = """
places AS (
  SELECT conv_id, turn_no, t, list(j ORDER BY j) AS js
  FROM (SELECT conv_id, turn_no, unnest(g) AS t, generate_subscripts(g, 1) AS j FROM toks) GROUP BY conv_id, turn_no, t
),
moves AS (
  SELECT conv_id, turn_no, js, row_number() OVER (PARTITION BY conv_id, turn_no ORDER BY i) AS step
  FROM (SELECT conv_id, turn_no, unnest(p) AS t, generate_subscripts(p, 1) AS i FROM toks) JOIN places USING (conv_id, turn_no, t)
),
walk AS (
  SELECT conv_id, turn_no, 0::BIGINT AS step, [0::BIGINT] AS ends FROM toks
  UNION ALL
  SELECT w.conv_id, w.turn_no, w.step + 1,
    [e FOR e IN [0::BIGINT] || [
      least(coalesce(ends[k], 1000000000), coalesce(list_min([j FOR j IN js IF j > ends[k - 1]]), 1000000000))
      FOR k IN range(2, len(ends) + 2)
    ] IF e < 1000000000]
  FROM walk w JOIN moves m ON m.conv_id = w.conv_id AND m.turn_no = w.turn_no AND m.step = w.step + 1
),
lcs AS (
  SELECT conv_id, turn_no, p, g, lcs FROM toks
  JOIN (SELECT conv_id, turn_no, max(len(ends)) - 1 AS lcs FROM walk GROUP BY conv_id, turn_no) USING (conv_id, turn_no)
)"""


@query("h7_lcs_len", f"WITH RECURSIVE {PREDICTIONS}, {TOKENS}, {LCS} SELECT conv_id, turn_no, lcs FROM lcs")
def h7_lcs_len(spark, sf_dir):
    pairs = scored_pairs(spark, sf_dir).select(*KEYS, scoring.tokens(F.col("pred")).alias("p"), scoring.tokens(F.col("gold")).alias("g"))
    return pairs.select(*KEYS, scoring.lcs_len(F.col("p"), F.col("g")).alias("lcs"))


@query(
    "h8_rouge_l",
    f"WITH RECURSIVE {PREDICTIONS}, {TOKENS}, {LCS} SELECT conv_id, turn_no, {f_measure('lcs', 'len(p)', 'len(g)')} AS rouge_l FROM lcs",
)
def h8_rouge_l(spark, sf_dir):
    return one_metric(spark, sf_dir, "rouge_l")


@query("h9_bleu", f"WITH {PREDICTIONS}, {OVERLAP} SELECT conv_id, turn_no, token_f1 AS bleu FROM f1")
def h9_bleu(spark, sf_dir):
    return one_metric(spark, sf_dir, "bleu")


SUMMARY = f"""
WITH RECURSIVE {PREDICTIONS}, {OVERLAP}, {LCS},
scored AS (
  SELECT CASE WHEN {strip("pred")} = {strip("gold")} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS exact_match, {LENGTH_RATIO} AS length_ratio,
    token_f1, token_f1 AS bleu, {f_measure("lcs", "len(l.p)", "len(l.g)")} AS rouge_l
  FROM pairs JOIN f1 USING (conv_id, turn_no) JOIN lcs l USING (conv_id, turn_no)
)
SELECT count(*) AS turns, {", ".join(f"round(avg({m}), 6) AS {m}" for m in evaluate.METRICS)} FROM scored"""


def rounded(summary):
    return summary.select("turns", *[F.round(m, 6).alias(m) for m in evaluate.METRICS])


@query("h10_eval_summary", SUMMARY)
def h10_eval_summary(spark, sf_dir):
    return rounded(evaluate.eval_summary(evaluate.score(scored_pairs(spark, sf_dir))))


@query(
    "h11_eval_offline",
    f"""WITH {fx.TXT_DOCUMENTS}, {CONTENT}
    SELECT doc_id, count(*) AS raw_lines, (SELECT count(*) FROM line_pairs p WHERE p.doc_id = raw.doc_id) AS samples, 0::BIGINT AS turns,
      {", ".join(f"NULL::DOUBLE AS {m}" for m in evaluate.METRICS)}
    FROM raw GROUP BY doc_id""",
)
def h11_eval_offline(spark, sf_dir):
    texts = fx.spread(fx.txt_documents(spark, sf_dir), "doc_id")
    counters = report.text_report(texts, formats.from_text(texts), source="doc_id")
    return evaluate.eval_offline(counters).select("doc_id", "raw_lines", "samples", "turns", *evaluate.METRICS)


@query("b6_write_eval_report", SUMMARY)
def b6_write_eval_report(spark, sf_dir):
    summary = evaluate.eval_summary(evaluate.score(scored_pairs(spark, sf_dir)))
    path = sinks.write_eval_report(summary, scratch_path(spark, "reports"))
    return rounded(spark.read.schema(summary.schema).option("multiLine", "true").json(path))
