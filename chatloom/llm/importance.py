"""Importance resampling towards a target corpus, ranked by parallel sorting by regular sampling.

Documents get a weight from an array of gains, one per hashed feature, and noise from their id; the
highest scores are drawn. Ranks come without a global sort: sorted runs are sampled at regular
places, the samples' regular splitters cut all runs into segments, each segment is merged in one
task, and the counts of the segments before it tell the rank of its first row.
"""

from __future__ import annotations

import hashlib
import math
from bisect import bisect_left
from collections.abc import Iterator
from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chatloom.llm.common import landed, pieces, ready, with_arrow

BUCKETS = 10_000
# Rows of a segment (by regular sampling at most about twice as many) and samples for each segment.
SEGMENT_ROWS, SAMPLES = 4_000_000, 16
_KNOWN = 1 << 18  # words whose bucket a task remembers; only speed depends on it
# Bytes as words see them: A-Z lower-cased, other ASCII than letters and digits a space.
_WORD = bytes(c + 32 if 65 <= c <= 90 else c if c > 127 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


class Buckets(dict):
    """Bucket of a feature's bytes."""

    def __init__(self, buckets: int) -> None:
        super().__init__()
        self.buckets = buckets

    def __missing__(self, feature: bytes) -> int:
        bucket = crc32(feature) % self.buckets
        if len(self) < _KNOWN:
            self[feature] = bucket
        return bucket


def feature_buckets(text: bytes | None, longest: int, known: Buckets) -> Iterator[tuple[int, np.ndarray]]:
    """(words, buckets of the features that end in them) of a text, piece by piece."""
    tail: list[bytes] = []
    for piece in pieces(text or b""):
        words = piece.translate(_WORD).split()
        runs = [words]
        whole = tail + words
        for width in range(2, longest + 1):
            first = max(0, len(tail) - width + 1)
            runs.append([b" ".join(whole[i : i + width]) for i in range(first, len(whole) - width + 1)])
        n = sum(map(len, runs))
        yield len(words), np.fromiter(map(known.__getitem__, chain.from_iterable(runs)), np.int64, n)
        tail = whole[len(whole) - longest + 1 :] if longest > 1 else []


def bucket_counts(docs: DataFrame, longest: int = 1, buckets: int = BUCKETS) -> np.ndarray:
    """Features of all texts by bucket: summed per task, then by bucket, so that no more than
    `buckets` numbers come back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, known = np.zeros(buckets, np.int64), Buckets(buckets)
        for batch in batches:
            for text in batch.column(0):
                for _, found in feature_buckets(text.as_py(), longest, known):
                    counts += np.bincount(found, minlength=buckets)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some])], names=["bucket", "n"])

    summed = docs.select(F.col("text").cast("binary")).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for r in summed.collect():
        out[r.bucket] = r.n
    return out


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the logarithm of how much likelier a feature of each bucket is in the target."""
    n = len(source)
    s, t = float(source.sum()) + n, float(target.sum()) + n
    ratios = ((target + 1.0) * s) / ((source + 1.0) * t)
    return np.array([math.floor(1000 * math.log(x)) for x in ratios.tolist()], np.int64)


def noise(doc_id: int | None, seed: int) -> int:
    """Thousandths of a Gumbel draw from the id."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weighted(docs: DataFrame, gains: np.ndarray, longest: int = 1, seed: int = 2024) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score) of every document."""
    task: dict[str, Buckets] = {}

    def run(ids: list, texts: list) -> tuple:
        known = task.setdefault("known", Buckets(len(gains)))
        out = ([], [], [], [])
        for doc_id, text in zip(ids, texts, strict=True):
            words = features = total = 0
            for n, found in feature_buckets(text, longest, known):
                words, features, total = words + n, features + len(found), total + int(gains[found].sum())
            weight = total // features if features else 0
            for column, value in zip(out, (words, features, weight, weight + noise(doc_id, seed)), strict=True):
                column.append(value)
        return out

    plain = docs.select("doc_id", F.col("text").cast("binary").alias("_bytes"))
    new = "n_words long, n_features long, weight long, score long"
    return with_arrow(plain, ["doc_id", "_bytes"], new, run).drop("_bytes")


def ranked(rows: DataFrame, most: int, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """Append `rank` to `rows` (doc_id, score, ...): 1, 2, 3, ... for the `most` highest scores, ties
    to the smaller doc_id, null ids last, and repeated rows by their place in the runs; null beyond.

    The driver sees the samples (about SAMPLES per segment and one per run) and a count per segment.
    The place in a run, which no two rows share, is the last part of the key, so that any number of
    equal rows is cut into segments too.
    """
    spark, columns = rows.sparkSession, rows.columns
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    runs = landed(rows.sortWithinPartitions(*order), "runs")
    meta = runs.metadataColumn("_metadata")
    runs = runs.select("*", meta["file_name"].alias("_run"), meta["row_index"].alias("_at"))
    total = runs.count()
    segments = max(1, min(total, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // segment_rows))))
    stride = max(1, total // (SAMPLES * segments))
    key = [(-F.col("score")).alias("s"), F.col("doc_id").isNull().alias("z"), F.coalesce("doc_id", F.lit(0)).alias("d"), "_run", "_at"]
    sampled = sorted(tuple(r) for r in runs.where(F.col("_at") % stride == stride // 2).select(*key).collect())
    splitters = [sampled[i * len(sampled) // segments] for i in range(1, segments)] if sampled else []
    heads = np.array([s[0] for s in splitters], np.int64)
    at = [runs.columns.index(c) for c in ("score", "doc_id", "_run", "_at")]
    names = [*runs.columns, "_segment"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = -np.asarray(batch.column(at[0]))
            # Splitters below a row's key; the other parts of the key are read only where scores tie.
            segment, beyond = np.searchsorted(heads, score, "left"), np.searchsorted(heads, score, "right")
            for i in np.flatnonzero(segment < beyond).tolist():
                doc_id = batch.column(at[1])[i].as_py()
                full = (int(score[i]), doc_id is None, doc_id or 0, batch.column(at[2])[i].as_py(), batch.column(at[3])[i].as_py())
                segment[i] = bisect_left(splitters, full, int(segment[i]), int(beyond[i]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(segment, pa.int32())], names=names)

    schema = T.StructType([*runs.schema, T.StructField("_segment", T.IntegerType())])
    cuts = landed(runs.mapInArrow(cut, schema), "segments")
    counts = np.zeros(segments, np.int64)
    for r in cuts.groupBy("_segment").count().collect():
        counts[r["_segment"]] = r["count"]
    before = np.concatenate([[0], np.cumsum(counts)])
    last = int(np.searchsorted(before[:-1], most, "left")) if total else 0  # segments that begin within the draw
    no_rank = F.lit(None).cast("long").alias("rank")
    rest = cuts.where(F.col("_segment") >= last).select(*columns, no_rank)
    if not last:
        return rest
    starts = F.array(*[F.lit(int(x)) for x in before[:last]])
    merged = cuts.where(F.col("_segment") < last).repartitionById(last, F.col("_segment")).sortWithinPartitions(*order, "_run", "_at")
    # Within a partition the ids of this function count up from 0 in their lower 33 bits.
    place = F.expr("monotonically_increasing_id() & 8589934591").alias("_place")
    numbered = merged.select(*columns, "_segment", place)
    rank = F.get(starts, F.col("_segment")) + F.col("_place") + 1
    return numbered.select(*columns, F.when(rank <= most, rank).alias("rank")).unionByName(rest)


def resampled(
    docs: DataFrame, target: DataFrame, share: int = 10, least_words: int = 20, longest: int = 1, buckets: int = BUCKETS, seed: int = 2024
) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) of every row of `docs` (doc_id, text).

    Of the rows with at least `least_words` words, `share` of 100 (rounded down) are drawn by score and
    get ranks; all others have a null rank. A null text has no words, no features and the weight 0.
    Null ids draw their noise as an empty id and rank behind others of their score; rows that repeat an
    id are rows of their own. Without a target the gains are those of an empty one; an empty table gives
    no rows. Other columns are not read. Bytes that are no UTF-8 count as letters.
    """
    ready(docs.sparkSession)
    gains = bucket_gains(bucket_counts(docs, longest, buckets), bucket_counts(target, longest, buckets))
    scored = landed(weighted(docs, gains, longest, seed), "scored")
    able = F.col("n_words") >= least_words
    drawn = ranked(scored.where(able), scored.where(able).count() * share // 100)
    return drawn.unionByName(scored.where(~able).withColumn("rank", F.lit(None).cast("long")))
