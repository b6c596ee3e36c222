"""Following log folders."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatloom.operators.governance import redact_literal


def scan_log_stream(spark: SparkSession, folder: str, files_per_batch: int | None = None) -> DataFrame:
    """Whole lines of the files that arrive in a folder: ``line, file_time``.

    A file is taken once, complete, when it appears: rotate the log and move closed files in.
    """
    reader = spark.readStream
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    rows = reader.text(folder)
    return rows.select(F.col("value").alias("line"), F.col("_metadata.file_modification_time").alias("file_time"))


def follow_logs(lines: DataFrame, secrets: tuple[str, ...] = (), since: datetime | None = None) -> DataFrame:
    """Redacted lines, stateless. Files that were there before ``since`` (the time of this call, unless
    given) are left out; a job that is restarted passes the time it first began.
    Whole lines are redacted, so no secret can hide across a read boundary."""
    start = since or datetime.now(timezone.utc)
    return lines.filter(F.col("file_time") > F.lit(start)).select(redact_literal(F.col("line"), secrets).alias("line"))
