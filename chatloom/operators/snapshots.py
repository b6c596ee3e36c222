"""Audit of model snapshots from one listing table: ``model_id, path, size``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chatloom.functions.records import at, strict_json

# File names of a snapshot and the problem texts.
TOKENIZER_FILES = ("tokenizer.json", "tokenizer.model", "vocab.json", "spiece.model", "tokenizer_config.json")
WEIGHT_FILE = r"(?i)[^/]\.(safetensors|bin|pt|pth|gguf)$"
ADAPTER_FILES = ("adapter_config.json", "adapter_model.safetensors", "adapter_model.bin")
INDEX_FILE = "model.safetensors.index.json"
NO_CONFIG = "missing or empty config.json"
NO_TOKENIZER = (
    "missing tokenizer files (expected tokenizer.json / tokenizer.model / vocab.json+merges.txt / tokenizer_config.json)"
)
NO_WEIGHTS = "missing weight files (.safetensors / .bin / .pt / .gguf)"
NO_SHARDS = "safetensors index references missing shards: "
BAD_INDEX = f"{INDEX_FILE} is not valid JSON"
NAMED_SHARDS = 8


def _seen(condition: Column) -> Column:
    return F.coalesce(F.bool_or(condition), F.lit(False))


def missing_shards(listing: DataFrame, indexes: DataFrame) -> DataFrame:
    """``model_id, shard``: named in an index (``model_id, raw``) but absent or empty."""
    weight_map = F.expr(at(strict_json("raw"), "$.weight_map", "map<string,string>"))
    named = indexes.select("model_id", F.explode(F.map_values(weight_map)).alias("shard")).distinct()
    present = listing.filter("size > 0").select("model_id", F.col("path").alias("shard"))
    return named.join(present, ["model_id", "shard"], "left_anti")


def index_problems(listing: DataFrame, indexes: DataFrame) -> DataFrame:
    """``model_id, problem``: at most the first 8 missing shards are named, in order."""
    missing = missing_shards(listing, indexes)
    rank = F.row_number().over(W.partitionBy("model_id").orderBy("shard"))
    # A row number limit: Spark keeps the top rows per task before it shuffles.
    named = missing.withColumn("_n", rank).filter(F.col("_n") <= NAMED_SHARDS)
    told = named.groupBy("model_id").agg(
        F.concat(F.lit(NO_SHARDS), F.array_join(F.sort_array(F.collect_list("shard")), ", ")).alias("problem")
    )
    broken = indexes.filter(F.expr(strict_json("raw")).isNull()).select("model_id", F.lit(BAD_INDEX).alias("problem"))
    return told.unionByName(broken)


def audit_snapshots(listing: DataFrame, indexes: DataFrame | None = None) -> DataFrame:
    """``model_id, problems, adapter, kind``; no problems means valid.

    One pre-aggregated pass over the listing; what an index says is joined per model.
    """
    name, filled = F.col("path"), F.col("size") > 0
    flags = listing.groupBy("model_id").agg(
        _seen((name == "config.json") & filled).alias("_config"),
        _seen(name.isin(*TOKENIZER_FILES) & filled).alias("_tokenizer"),
        (_seen(name == "vocab.json") & _seen(name == "merges.txt")).alias("_vocab"),
        _seen(name.rlike(WEIGHT_FILE) & filled).alias("_weights"),
        _seen(name.isin(*ADAPTER_FILES)).alias("adapter"),
    )
    if indexes is None:
        flags = flags.withColumn("problem", F.lit(None).cast("string"))
    else:
        flags = flags.join(index_problems(listing, indexes), "model_id", "left")
    problems = F.array_compact(
        F.array(
            F.when(~F.col("_config"), NO_CONFIG),
            F.when(~F.col("_tokenizer") & ~F.col("_vocab"), NO_TOKENIZER),
            F.when(~F.col("_weights"), NO_WEIGHTS),
            F.col("problem"),
        )
    )
    return flags.select("model_id", problems.alias("problems"), "adapter").withColumn("kind", snapshot_kind())


def snapshot_kind() -> Column:
    """``adapter``, ``merged`` (valid and no adapter) or ``invalid``."""
    return F.when(F.col("adapter"), "adapter").when(F.size("problems") == 0, "merged").otherwise("invalid")


def first_valid_source(attempts: DataFrame, key: str = "model_id") -> DataFrame:
    """``source`` with the lowest priority whose ``problem`` is null, and the failures before it.

    ``attempts`` has ``source, priority, problem``, one row per configured source.
    """
    valid = F.col("problem").isNull()
    failure = F.struct("priority", F.concat_ws(": ", "source", "problem").alias("text"))
    tried = attempts.groupBy(key).agg(
        F.min(F.when(valid, F.struct("priority", "source"))).alias("_w"),
        F.sort_array(F.collect_list(F.when(~valid, failure))).alias("_f"),
    )
    before = F.filter("_f", lambda f: F.col("_w").isNull() | (f["priority"] < F.col("_w.priority")))
    return tried.select(key, F.col("_w.source").alias("source"), F.transform(before, lambda f: f["text"]).alias("failures"))
