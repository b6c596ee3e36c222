"""Sinks: processed and raw JSON Lines, editor exports, reports."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatloom.functions.text import js_blank, jstrim
from chatloom.operators.formats import is_error, samples
from chatloom.operators.render import render_chatml
from chatloom.options import DROPMALFORMED, FAILFAST
from chatloom.sources.files import write_files, write_lines


def processed_lines(found: DataFrame) -> DataFrame:
    """One ``{"messages": [...]}`` text per sample, non-ASCII kept."""
    return found.select(F.to_json(F.struct("messages")).alias("value"))


def write_processed(found: DataFrame, path: str, mode: str = "errorifexists") -> dict[str, int]:
    """Write samples as JSON Lines in one pass; an empty dataset is refused when the rows are counted
    at the commit, and then nothing is written. Gives the counts."""
    return write_lines(processed_lines(found), path, mode, least=1, suffix=".jsonl")


def write_converted(converted: DataFrame, path: str, validation: str = DROPMALFORMED, mode: str = "errorifexists") -> dict[str, int]:
    """Write the samples of a converted frame as JSON Lines in one pass.

    With ``FAILFAST`` the first erroneous record, by path and number, is raised as a DataFormatError when
    all tasks are done, the same one however they ran, and nothing is written.
    """
    if validation != FAILFAST:
        return write_processed(samples(converted, validation), path, mode)
    kept = converted.filter(F.col("reason").isNull() | is_error())
    lines = kept.select(F.to_json(F.struct("messages")).alias("value"), "source_path", "record_no", "reason")
    return write_lines(lines, path, mode, least=1, suffix=".jsonl")


def write_outcome(converted: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write samples and rejects in one pass, partitioned by ``accepted``."""
    converted.withColumn("accepted", F.col("reason").isNull()).write.partitionBy("accepted").mode(mode).parquet(path)


def write_raw(rows: DataFrame, folder: str, dataset_id: str, mode: str = "errorifexists") -> str:
    """Archive catalogue rows as they are, as JSON Lines under a name made of the dataset id."""
    path = f"{folder.rstrip('/')}/{dataset_id.replace('/', '__')}.jsonl"
    raw_lines(rows).write.mode(mode).text(path)
    return path


def raw_lines(rows: DataFrame) -> DataFrame:
    return rows.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("value"))


def _spoken(found: DataFrame) -> DataFrame:
    """Samples cut to their non-blank messages; a sample without any is left out."""
    kept = F.filter("messages", lambda m: ~js_blank(m["content"]))
    return found.withColumn("messages", F.explode(F.array(kept))).filter(F.size("messages") > 0)


def export_jsonl(found: DataFrame) -> DataFrame:
    return processed_lines(_spoken(found))


def export_chatml(found: DataFrame) -> DataFrame:
    """Marked text per sample, to be written with ``write.text``: its own final line break plus the
    line separator make the blank line between samples."""
    return _spoken(found).select(render_chatml(F.col("messages")).alias("value"))


def export_pairs(found: DataFrame) -> DataFrame:
    """``pair_no, user, assistant``: steps of two over the spoken messages without the system ones;
    a step that is not (user, assistant) is skipped and the walk goes on, still in steps of two."""
    talk = _spoken(found).withColumn("messages", F.filter("messages", lambda m: m["role"] != "system"))
    # ``messages`` stays one column read, so that the lambda below does not filter once per step.
    fixed = talk.withColumn("messages", F.explode(F.array("messages")))
    steps = F.when(
        F.size("messages") >= 2,
        F.transform(
            F.sequence(F.lit(0), F.floor(F.size("messages") / 2).cast("int") - 1),
            lambda i: F.struct(
                i.cast("bigint").alias("pair_no"),
                F.get("messages", i * 2).alias("u"),
                F.get("messages", i * 2 + 1).alias("a"),
            ),
        ),
    )
    kept = F.filter(steps, lambda p: (p["u"]["role"] == "user") & (p["a"]["role"] == "assistant"))
    keys = [c for c in found.columns if c != "messages"]
    return fixed.select(*keys, F.explode(kept).alias("p")).select(
        *keys,
        F.col("p.pair_no").alias("pair_no"),
        jstrim(F.col("p.u.content")).alias("user"),
        jstrim(F.col("p.a.content")).alias("assistant"),
    )


def pair_text(pairs: DataFrame) -> DataFrame:
    """Two lines per pair, to be written with ``write.text``."""
    return pairs.select(F.concat_ws("\n", "user", "assistant").alias("value"))


def write_eval_report(summary: DataFrame, folder: str, name: str | None = None, mode: str = "errorifexists") -> str:
    """One file with the indented JSON of a one-row summary; the default name carries the UTC time."""
    stamp = name or f"eval-{datetime.now(timezone.utc):%Y%m%dT%H%M%SZ}.json"
    path = f"{folder.rstrip('/')}/{stamp}"
    text = F.to_json(F.struct(*summary.columns), {"pretty": "true", "ignoreNullFields": "false"})
    report = summary.select(F.lit(stamp).alias("name"), F.concat(text, F.lit("\n")).alias("content"))
    write_files(report, folder, "append", replace=mode == "overwrite", least=1)
    return path
