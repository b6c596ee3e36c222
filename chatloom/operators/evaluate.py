"""Gold turns, predictions, scores and their summary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatloom.functions import scoring

METRICS = ("exact_match", "length_ratio", "token_f1", "bleu", "rouge_l")


def assistant_turns(samples: DataFrame, with_prompt: bool = True) -> DataFrame:
    """``sample_id, turn_no, gold[, prompt]``: one row per assistant message of a sample.

    The prompt repeats all earlier messages, so its total size is quadratic in the turns: ask for
    it only where it is needed, and join predictions on the keys.
    """
    keys = [c for c in samples.columns if c != "messages"]
    turns = samples.select(*keys, *(["messages"] if with_prompt else []), F.posexplode("messages").alias("turn_no", "m"))
    gold = turns.filter(F.col("m.role") == "assistant").withColumn("gold", F.coalesce("m.content", F.lit("")))
    if with_prompt:
        gold = gold.withColumn("prompt", F.expr("slice(messages, 1, turn_no)"))
    return gold.drop("messages", "m")


def gold_turns(turns: DataFrame, turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Gold turns of a turn table: a filter, with no grouping by conversation at all."""
    rest = [c for c in turns.columns if c not in (turn, role, text)]
    return turns.filter(F.col(role) == "assistant").select(
        *rest, F.col(turn).alias("turn_no"), F.coalesce(F.col(text), F.lit("")).alias("gold")
    )


def attach_predictions(gold: DataFrame, predictions: DataFrame, keys: tuple[str, ...] = ("sample_id", "turn_no")) -> DataFrame:
    """Every gold turn with its prediction; none, or a null one, is the empty text."""
    joined = gold.join(predictions.select(*keys, "pred"), list(keys), "left")
    return joined.withColumn("pred", F.coalesce("pred", F.lit("")))


def score(pairs: DataFrame, metrics: tuple[str, ...] = METRICS, bleu4: bool = False) -> DataFrame:
    """Add the asked metrics for the columns ``pred`` and ``gold``.

    ``bleu`` is the token F1 unless ``bleu4`` asks for BLEU-4. Only ``rouge_l`` leaves the JVM.
    """
    unknown = set(metrics) - set(METRICS)
    if unknown:
        raise ValueError(f"unknown metrics: {sorted(unknown)}")
    pred, gold = F.col("pred"), F.col("gold")
    f1_needed = "token_f1" in metrics or ("bleu" in metrics and not bleu4)
    out = pairs
    if f1_needed or "rouge_l" in metrics:
        out = out.withColumn("_p", scoring.tokens(pred)).withColumn("_g", scoring.tokens(gold))
    if f1_needed:
        out = out.withColumn("_f1", scoring.token_f1_of(F.col("_p"), F.col("_g")))
    if "rouge_l" in metrics:
        out = out.withColumn("_lcs", scoring.lcs_len(F.col("_p"), F.col("_g")))
    columns = {
        "exact_match": lambda: scoring.exact_match(pred, gold),
        "length_ratio": lambda: scoring.length_ratio(pred, gold),
        "token_f1": lambda: F.col("_f1"),
        "bleu": lambda: scoring.bleu4(pred, gold) if bleu4 else F.col("_f1"),
        "rouge_l": lambda: scoring.rouge_l_of(F.col("_lcs"), F.col("_p"), F.col("_g")),
    }
    for name in metrics:
        out = out.withColumn(name, columns[name]())
    return out.drop("_p", "_g", "_f1", "_lcs")


def eval_summary(scores: DataFrame, metrics: tuple[str, ...] = METRICS) -> DataFrame:
    """One row: turn count and the plain mean of each metric over turns, null without turns."""
    return scores.agg(F.count(F.lit(1)).alias("turns"), *[F.avg(m).alias(m) for m in metrics])


def eval_offline(report: DataFrame) -> DataFrame:
    """Conversion counters per source with every score null: no model was asked."""
    nulls = [F.lit(None).cast("double").alias(m) for m in METRICS]
    return report.select("*", F.lit(0).cast("bigint").alias("turns"), *nulls)
