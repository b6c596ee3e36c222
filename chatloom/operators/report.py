"""Conversion counters per source."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatloom.operators.formats import SKIPPED
from chatloom.operators.lines import is_comment, is_empty, line_counts
from chatloom.options import DataOptions


def text_report(texts: DataFrame, converted: DataFrame, options: DataOptions = DataOptions(), text: str = "text", source: str = "source_path") -> DataFrame:
    """Counters of paired-line texts in a column: line counts from the texts, outcomes from the
    converted frame. Both sides are aggregated to one row per source before they meet."""
    counted = texts.withColumn("_c", F.explode(F.array(line_counts(F.col(text), options))))
    lines = counted.groupBy(source).agg(
        *[F.sum(f"_c.{c}").alias(c) for c in ("raw_lines", "skipped_empty", "skipped_comments", "dropped_unpaired")],
        F.bool_and(F.is_valid_utf8(F.col(text))).alias("utf8_ok"),
    )
    return _joined(lines, converted, source)


def lines_report(
    lines: DataFrame, converted: DataFrame, options: DataOptions = DataOptions(), paired: bool = True
) -> DataFrame:
    """Counters of a line-file scan; ``lines`` is the scan before the line filters. Without ``paired``
    a line is a record of its own (JSON Lines) and no tail is left over."""
    empty, comment = is_empty(F.col("line"), options), is_comment(F.col("line"), options)
    counted = lines.groupBy("source_path").agg(
        F.count(F.lit(1)).alias("raw_lines"),
        F.count_if(empty).alias("skipped_empty"),
        F.count_if(~empty & comment).alias("skipped_comments"),
        F.bool_and("utf8_ok").alias("utf8_ok"),
    )
    content = F.col("raw_lines") - F.col("skipped_empty") - F.col("skipped_comments")
    tail = content % 2 if paired else F.lit(0).cast("bigint")
    return _joined(counted.withColumn("dropped_unpaired", tail), converted, "source_path")


def _outcome(converted: DataFrame, source: str) -> DataFrame:
    reason = F.col("reason")
    return converted.groupBy(source).agg(
        F.count_if(reason.isNull()).alias("samples"),
        F.count_if(F.coalesce(reason.isin(*SKIPPED), F.lit(False))).alias("skipped"),
        F.count_if(F.coalesce(~reason.isin(*SKIPPED), F.lit(False))).alias("failed"),
    )


def _joined(counted: DataFrame, converted: DataFrame, source: str) -> DataFrame:
    zero = F.lit(0).cast("bigint")
    joined = counted.join(_outcome(converted, source), source, "left")
    return joined.select(
        source, "raw_lines", "skipped_empty", "skipped_comments", "dropped_unpaired", "utf8_ok",
        F.coalesce("samples", zero).alias("samples"),
        # One warning per odd tail and per skipped pair.
        (F.col("dropped_unpaired") + F.coalesce("skipped", zero)).alias("warnings"),
    )
