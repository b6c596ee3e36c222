"""Queries over licenses, secrets and snapshots."""

from __future__ import annotations

from pyspark.sql import functions as F

from chatloom.operators import governance as gv
from chatloom.operators import snapshots as sn
from chatloom.plans import fixtures as fx
from chatloom.plans.registry import query
from chatloom.plans.sql import PY_SPACE, lines, lit, strip

# Fixed values, written out here apart from the operators', so that a wrong one there shows.
RESTRICTED = (
    "non-commercial", "noncommercial", "research only", "research-only", "no commercial", "cc-by-nc", "cc by-nc",
    "llama 2 community", "llama 3 community",
)
PERMITTED = ("apache-2.0", "apache 2.0", "mit", "bsd-2-clause", "bsd-3-clause", "apache2")
TOKENIZER_NAMES = ("tokenizer.json", "tokenizer.model", "vocab.json", "spiece.model", "tokenizer_config.json")
ADAPTER_NAMES = ("adapter_config.json", "adapter_model.safetensors", "adapter_model.bin")
CONFIG_PROBLEM = "missing or empty config.json"
TOKENIZER_PROBLEM = "missing tokenizer files (expected tokenizer.json / tokenizer.model / vocab.json+merges.txt / tokenizer_config.json)"
WEIGHT_PROBLEM = "missing weight files (.safetensors / .bin / .pt / .gguf)"
SHARD_PROBLEM = "safetensors index references missing shards: "
INDEX_PROBLEM = "model.safetensors.index.json is not valid JSON"

HEAD = f"array_to_string({lines('text')}[1:8], ' ')"
NAME = lit(rf"(?i)(apache(?:-|[{PY_SPACE}]*)2\.0|mit|bsd|llama|cc-by[^{PY_SPACE},]*)")
FROM_TEXT = f"""CASE WHEN regexp_matches({HEAD}, {NAME}) THEN regexp_extract({HEAD}, {NAME}, 1)
  WHEN {strip(f"{HEAD}[:80]")} <> '' THEN {strip(f"{HEAD}[:80]")} ELSE 'see LICENSE' END"""


def model_cards(spark, sf_dir):
    return fx.spread(fx.cards(spark, sf_dir), "model_id")


@query(
    "k1_front_matter",
    f"""WITH {fx.CARDS}
    SELECT model_id, 'tags' AS key, 'a:b' AS value FROM cards WHERE file = 'README.md'
    UNION ALL SELECT model_id, 'license', front FROM cards WHERE file = 'README.md'""",
)
def k1_front_matter(spark, sf_dir):
    return gv.front_matter(model_cards(spark, sf_dir).select("model_id", "text"))


SAID = f"""
said AS (
  SELECT model_id, file, CASE file WHEN 'README.md' THEN nullif(front, '') WHEN 'LICENSE' THEN {FROM_TEXT} WHEN 'configuration.json' THEN config END AS license,
    CASE file WHEN 'README.md' THEN 1 WHEN 'LICENSE' THEN 2 ELSE 5 END AS rank
  FROM cards
),
picked AS (
  SELECT model_id, arg_min(license, rank) FILTER (WHERE license IS NOT NULL) AS license, arg_min(file, rank) FILTER (WHERE license IS NOT NULL) AS source_file
  FROM said WHERE file <> 'NOTES.md' GROUP BY model_id
)"""

LOW = "lower(license)"
VERDICT = f"""CASE WHEN license IS NULL THEN NULL
  WHEN {" OR ".join(f"contains({LOW}, {lit(h)})" for h in RESTRICTED)}
    OR list_contains(regexp_split_to_array({LOW}, {lit(f"[{PY_SPACE}]+")}), 'nc') THEN false
  WHEN {LOW} IN ({", ".join(map(lit, PERMITTED))}) OR contains({LOW}, 'apache') THEN true END"""


@query("k2_pick_license_source", f"WITH {fx.CARDS}, {SAID} SELECT * FROM picked")
def k2_pick_license_source(spark, sf_dir):
    return gv.pick_license_source(model_cards(spark, sf_dir))


@query("k3_license_from_text", f"SELECT doc_id, {FROM_TEXT} AS license FROM documents")
def k3_license_from_text(spark, sf_dir):
    docs = fx.spread(fx.load(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    return docs.select("doc_id", gv.license_from_text(F.col("text")).alias("license"))


@query(
    "k4_license_from_config",
    "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN lang WHEN 1 THEN '7' END AS license FROM documents",
)
def k4_license_from_config(spark, sf_dir):
    d, text = F.col("doc_id"), F.col("text")
    config = (
        F.when(d % 4 == 0, F.to_json(F.struct(text, F.col("lang").alias("license"))))
        .when(d % 4 == 1, F.to_json(F.struct(text, F.lit(7).alias("license"))))
        .when(d % 4 == 2, F.to_json(F.struct(text, F.lit("").alias("license"))))
        .otherwise(F.concat(F.to_json(F.struct(text, F.lit("mit").alias("license"))), F.lit(" }")))
    )
    configs = fx.spread(fx.load(spark, sf_dir, "documents"), "doc_id").select("doc_id", config.alias("config"))
    return configs.select("doc_id", gv.license_from_config("config").alias("license"))


@query(
    "k5_classify_license",
    f"""WITH {fx.CARDS}, {SAID}, judged AS (SELECT *, {VERDICT} AS commercial_ok FROM picked)
    SELECT *, CASE WHEN license IS NULL THEN 'No license file or model-card license field was found.'
      WHEN commercial_ok = false THEN 'License `' || license || '` looks non-commercial or restricted. Review before production use.'
      WHEN commercial_ok IS NULL THEN 'License `' || license || '` was found but commercial use is not auto-classified. Read the model card.' END AS warning
    FROM judged""",
)
def k5_classify_license(spark, sf_dir):
    return gv.license_report(model_cards(spark, sf_dir))


@query(
    "k6_license_gate",
    f"""WITH {fx.CARDS}, {SAID}, judged AS (SELECT *, {VERDICT} AS commercial_ok FROM picked)
    SELECT model_id, commercial_ok FROM judged WHERE commercial_ok IS DISTINCT FROM false""",
)
def k6_license_gate(spark, sf_dir):
    return gv.license_gate(gv.license_report(model_cards(spark, sf_dir))).select("model_id", "commercial_ok")


SETTING = "CASE p_partkey % 4 WHEN 0 THEN 'HUB_TOKEN' WHEN 1 THEN 'SERVE_API_KEY' WHEN 2 THEN 'MODEL_ID' ELSE 'PORT' END"


@query(
    "k8_redact_settings",
    f"""SELECT p_partkey, {SETTING} AS key,
      CASE WHEN p_partkey % 4 > 1 THEN p_name WHEN length(p_name) <= 8 THEN '***' ELSE p_name[:4] || '***' END AS value
    FROM part""",
)
def k8_redact_settings(spark, sf_dir):
    names = F.array(*[F.lit(x) for x in ("HUB_TOKEN", "SERVE_API_KEY", "MODEL_ID", "PORT")])
    settings = fx.load(spark, sf_dir, "part").select(
        "p_partkey", F.element_at(names, (F.col("p_partkey") % 4 + 1).cast("int")).alias("key"), F.col("p_name").alias("value")
    )
    return gv.redact_settings(settings)


@query(
    "k9_redact_args",
    """SELECT p_partkey, concat_ws(' ', 'serve', CASE WHEN p_size % 2 = 0 THEN '--api-key' ELSE '--name' END,
      CASE WHEN p_size % 2 = 0 THEN '***' ELSE p_name END, '--token=***', '--model=' || p_type, '--api-key') AS args FROM part""",
)
def k9_redact_args(spark, sf_dir):
    flag = F.when(F.col("p_size") % 2 == 0, "--api-key").otherwise("--name")
    args = F.array(
        F.lit("serve"), flag, F.col("p_name"), F.concat(F.lit("--token="), "p_brand"), F.concat(F.lit("--model="), "p_type"), F.lit("--api-key")
    )
    commands = fx.load(spark, sf_dir, "part").select("p_partkey", args.alias("args"))
    return commands.select("p_partkey", F.array_join(gv.redact_args(F.col("args")), " ").alias("args"))


FLAGS = f"""
named_missing AS (
  SELECT model_id, '{SHARD_PROBLEM}' || array_to_string(list_sort(list(shard))[1:8], ', ') AS problem FROM missing GROUP BY model_id
  UNION ALL SELECT DISTINCT model_id, '{INDEX_PROBLEM}' FROM listing WHERE ends_with(model_id, '3')
),
flags AS (
  SELECT model_id, bool_or(path = 'config.json' AND size > 0) AS config,
    bool_or(path IN ({", ".join(map(lit, TOKENIZER_NAMES))}) AND size > 0) OR (bool_or(path = 'vocab.json') AND bool_or(path = 'merges.txt')) AS tokenizer,
    bool_or(regexp_matches(path, '(?i)[^/][.](safetensors|bin|pt|pth|gguf)$') AND size > 0) AS weights,
    bool_or(path IN ({", ".join(map(lit, ADAPTER_NAMES))})) AS adapter
  FROM listing GROUP BY model_id
),
audited AS (
  SELECT model_id, adapter, concat_ws('; ', CASE WHEN NOT config THEN {lit(CONFIG_PROBLEM)} END, CASE WHEN NOT tokenizer THEN {lit(TOKENIZER_PROBLEM)} END,
    CASE WHEN NOT weights THEN {lit(WEIGHT_PROBLEM)} END, problem) AS problems
  FROM flags LEFT JOIN named_missing USING (model_id)
)"""


def audited(spark, sf_dir):
    return sn.audit_snapshots(fx.listing(spark, sf_dir), fx.shard_index(spark, sf_dir))


@query("l1_audit_snapshots", f"WITH {fx.LISTING}, {fx.SHARDS}, {FLAGS} SELECT model_id, problems FROM audited")
def l1_audit_snapshots(spark, sf_dir):
    return audited(spark, sf_dir).select("model_id", F.array_join("problems", "; ").alias("problems"))


@query("l2_missing_shards", f"WITH {fx.LISTING}, {fx.SHARDS} SELECT model_id, shard FROM missing")
def l2_missing_shards(spark, sf_dir):
    return sn.missing_shards(fx.listing(spark, sf_dir), fx.shard_index(spark, sf_dir))


@query(
    "l3_snapshot_kind",
    f"""WITH {fx.LISTING}, {fx.SHARDS}, {FLAGS}
    SELECT model_id, CASE WHEN adapter THEN 'adapter' WHEN problems = '' THEN 'merged' ELSE 'invalid' END AS kind FROM audited""",
)
def l3_snapshot_kind(spark, sf_dir):
    return audited(spark, sf_dir).select("model_id", "kind")


@query(
    "l4_first_valid_source",
    """WITH tried AS (
      SELECT p_brand AS model_id, p_type AS source, min(p_size) AS priority, CASE WHEN count(*) % 3 > 0 THEN 'count ' || count(*) END AS problem
      FROM part GROUP BY p_brand, p_type
    ),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY model_id ORDER BY priority, source) AS r FROM tried),
    won AS (SELECT model_id, min(r) AS r FROM ranked WHERE problem IS NULL GROUP BY model_id)
    SELECT m.model_id, (SELECT source FROM ranked x WHERE x.model_id = m.model_id AND x.r = won.r) AS source,
      coalesce((SELECT string_agg(x.source || ': ' || x.problem, '; ' ORDER BY x.r) FROM ranked x
        WHERE x.model_id = m.model_id AND (won.r IS NULL OR x.r < won.r)), '') AS failures
    FROM (SELECT DISTINCT model_id FROM ranked) m LEFT JOIN won USING (model_id)""",
)
def l4_first_valid_source(spark, sf_dir):
    counted = fx.load(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("model_id"), F.col("p_type").alias("source"))
    attempts = counted.agg(F.min("p_size").alias("low"), F.count(F.lit(1)).alias("n")).select(
        "model_id", "source", F.struct("low", "source").alias("priority"),
        F.when(F.col("n") % 3 > 0, F.concat(F.lit("count "), "n")).alias("problem"),
    )
    found = sn.first_valid_source(attempts)
    return found.select("model_id", "source", F.array_join("failures", "; ").alias("failures"))
