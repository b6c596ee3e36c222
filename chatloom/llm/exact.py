"""Exact dedup by a stream whose keyed state holds one entry per digest, on disk and for good.

The stream takes the files of a table, new ones only when it is run again on the same state. Rows
combine per task before they meet their key, so a text that a third of all rows share costs one row
a task. An entry is the digest, the count of its rows, the identifier of the row that stays and the
place of that row's content (file and row). Rows that hit an entry are compared with the content at
that place, byte by byte.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chatloom.llm.common import landed, ready
from chatloom.session import scratch_path

# Keys of repeated digests are sent to all tasks only up to this size; beyond it texts are joined by shuffle.
KEY_BYTES = 8 << 20
_STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    # Many small stores: no disk is set aside in advance for their logs, and a commit writes changes alone.
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def placed(files: DataFrame, digest: Callable[[Column], Column]) -> DataFrame:
    """(doc_id, text, file, row, digest) of table files: the content of a row lies in `row` of `file`."""
    meta = files.metadataColumn("_metadata")
    # Streams and batch reads write the scheme of a path in different ways.
    path = F.regexp_replace(meta["file_path"], "^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?/*", "/")
    rows = files.select(
        F.col("doc_id"), F.coalesce("text", F.lit("")).alias("text"), path.alias("file"), meta["row_index"].alias("row")
    )
    return rows.withColumn("digest", digest(F.col("text")))


def drain(spark: SparkSession, path: str, state: str, digest: Callable[[Column], Column], files_per_batch: int | None) -> None:
    """Take the files of the table that the state has not seen."""
    folder, _, name = path.rstrip("/").rpartition("/")
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    arriving = placed(reader.parquet(f"{folder}/{{{name}}}"), digest)  # a pattern, as a table may be one file
    entries = arriving.groupBy("digest").agg(F.max(F.struct("doc_id", "file", "row")).alias("stays"), F.count(F.lit(1)).alias("n"))
    before = {k: spark.conf.get(k, None) for k in _STATE}
    try:
        for k, v in _STATE.items():
            spark.conf.set(k, v)
        writer = entries.writeStream.outputMode("update").format("noop").option("checkpointLocation", state)
        writer.trigger(availableNow=True).start().awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def entries_of(spark: SparkSession, state: str) -> DataFrame:
    """(digest, stays (doc_id, file, row), n): every entry of the state."""
    found = spark.read.format("statestore").load(state)
    key, value = found.schema["key"].dataType.names, found.schema["value"].dataType.names
    return found.select(
        F.col("key")[key[0]].alias("digest"), F.col("value")[value[0]].alias("stays"), F.col("value")[value[1]].alias("n")
    )


def exact_groups(
    spark: SparkSession,
    path: str,
    state: str | None = None,
    digest: Callable[[Column], Column] = sha256,
    files_per_batch: int | None = None,
) -> DataFrame:
    """(doc_id, file, row, digest, keep_id, group_size, kept): one row per row of a Parquet table.

    Texts are equal when identical; a null text is empty. Of equal texts the row with the largest
    doc_id stays, a null id counting as the smallest; of rows that repeat that id, the one with the
    largest place. Other columns are not read. An empty table gives no rows. With `state`, a folder
    that all executors share, a later run on a grown table takes only its new files into the state.
    Texts that share a digest and differ are grouped by their bytes instead.
    """
    ready(spark)
    if not spark.read.parquet(path).inputFiles():
        empty = placed(spark.read.parquet(path), digest).limit(0)
        return empty.selectExpr("doc_id", "file", "row", "digest", "doc_id AS keep_id", "1L AS group_size", "true AS kept")
    state = state or scratch_path(spark, "dedup-state")
    drain(spark, path, state, digest, files_per_batch)
    repeated = entries_of(spark, state).where("n > 1").select("digest", "stays", "n", F.xxhash64("digest").alias("key"))
    groups = landed(repeated, "repeated")
    rows = placed(spark.read.parquet(path), digest)
    stays = F.struct("doc_id", "file", "row")
    alone = F.col("n").isNull()
    judged = rows.drop("text").join(groups.drop("key"), "digest", "left").select(
        "doc_id", "file", "row", "digest",
        F.when(alone, F.col("doc_id")).otherwise(F.col("stays.doc_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        (alone | stays.eqNullSafe(F.col("stays"))).alias("kept"),
    )

    # The check: hits and the contents at the places their entries name. The join that brings them
    # together is landed, so that the rows of one large group are split over tasks there and below.
    texts = rows
    if 8 * groups.count() <= KEY_BYTES:
        texts = rows.join(F.broadcast(groups.select("key").distinct()), F.xxhash64("digest") == F.col("key"), "left_semi")
    met = landed(
        texts.join(groups.select("digest", "stays"), "digest").select(
            "digest", "doc_id", "file", "row", "text", stays.eqNullSafe(F.col("stays")).alias("stays")
        ),
        "hits",
    )
    content = met.where("stays").select("digest", F.col("text").alias("content"))
    differ = met.where("not stays").join(content, "digest").where("text <> content").select("digest")
    differ = landed(differ, "differ")  # not made distinct before: the join could not be split then
    if differ.isEmpty():
        return judged
    mixed = met.drop("stays").join(differ, "digest", "left_semi")
    alike = landed(mixed.groupBy("digest", "text").agg(F.max(stays).alias("stays"), F.count(F.lit(1)).alias("group_size")), "alike")
    apart = mixed.join(alike, ["digest", "text"]).select(
        "doc_id", "file", "row", "digest", F.col("stays.doc_id").alias("keep_id"), "group_size", stays.eqNullSafe(F.col("stays")).alias("kept")
    )
    return judged.join(differ, "digest", "left_anti").select(*apart.columns).union(apart)


def deduplicated(spark: SparkSession, path: str, state: str | None = None) -> DataFrame:
    """The rows of a Parquet table that stay, with all their columns."""
    gone = landed(exact_groups(spark, path, state).where("not kept").select("file", "row"), "gone")
    files = spark.read.parquet(path)
    meta, columns = files.metadataColumn("_metadata"), files.columns
    place = F.regexp_replace(meta["file_path"], "^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?/*", "/")
    whole = files.select(F.struct(*(files[f"`{c}`"] for c in columns)).alias("whole"), place.alias("file"), meta["row_index"].alias("row"))
    return whole.join(gone, ["file", "row"], "left_anti").select("whole.*")
