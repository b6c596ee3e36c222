"""Small helpers that the operators of this folder share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chatloom.session import configure, scratch_path

# Whole-text batches are cut by bytes too: a thousand very long texts would not fit a worker.
BATCH_BYTES = 8 << 20
# A long text is split into words piece by piece, so that a list of its words is never held whole.
PIECE_BYTES = 1 << 20

_ARROW = {
    T.LongType(): pa.int64(),
    T.IntegerType(): pa.int32(),
    T.DoubleType(): pa.float64(),
    T.BooleanType(): pa.bool_(),
    T.StringType(): pa.string(),
    T.BinaryType(): pa.binary(),
    T.ArrayType(T.LongType()): pa.list_(pa.int64()),
    T.ArrayType(T.IntegerType()): pa.list_(pa.int32()),
}


def ready(spark: SparkSession) -> SparkSession:
    """Settings for operators that send whole texts to Python workers."""
    configure(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ready(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def landed(df: DataFrame, name: str) -> DataFrame:
    """Write a frame that several jobs read to the shared folder and read it back.

    The lineage is cut there, and the planner knows the size of what it reads, so that it
    broadcasts only what its threshold allows.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def arrow_type(kind: T.DataType) -> pa.DataType:
    for known, arrow in _ARROW.items():
        if kind == known or (
            isinstance(kind, T.ArrayType) and isinstance(known, T.ArrayType) and kind.elementType == known.elementType
        ):
            return arrow
    raise TypeError(f"no Arrow type noted for {kind}")


def with_arrow(df: DataFrame, inputs: list[str], schema: str, fn: Callable[..., list | tuple]) -> DataFrame:
    """Append columns that `fn` computes from lists of the inputs; batches stay as they come.

    Columns of the frame with the name of a new one are replaced.
    """
    new = T._parse_datatype_string(schema)
    names, kinds = [f.name for f in new], [arrow_type(f.dataType) for f in new]
    before = df.columns
    keep = [c for c in before if c not in names]
    at = [before.index(c) for c in inputs]
    keep_at = [before.index(c) for c in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = fn(*(batch.column(i).to_pylist() for i in at))
            yield pa.RecordBatch.from_arrays(
                [batch.column(i) for i in keep_at] + [pa.array(v, k) for v, k in zip(made, kinds, strict=True)],
                names=keep + names,
            )

    return df.mapInArrow(run, T.StructType([df.schema[c] for c in keep] + list(new)))


def pieces(data: bytes) -> Iterator[bytes]:
    """A text in pieces of about PIECE_BYTES, cut at white space only."""
    start, end = 0, len(data)
    while end - start > PIECE_BYTES:
        cut = max(data.rfind(b" ", start, start + PIECE_BYTES), data.rfind(b"\n", start, start + PIECE_BYTES))
        if cut <= start:  # one word longer than a piece: up to the next white space
            nexts = [i for i in (data.find(b" ", start + PIECE_BYTES), data.find(b"\n", start + PIECE_BYTES)) if i >= 0]
            if not nexts:
                break
            cut = min(nexts)
        yield data[start:cut]
        start = cut
    yield data[start:]


def word_hashes(text: str | None) -> np.ndarray:
    """64-bit hashes of the words `[^\\x20\\x09-\\x0D]+`, A-Z lower-cased; null: none."""
    from xxhash import xxh3_64_intdigest

    if not text:
        return np.zeros(0, np.uint64)
    parts = []
    for piece in pieces(text.encode("utf-8").lower()):  # both are ASCII rules on bytes
        words = piece.split()
        parts.append(np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words)))
    return parts[0] if len(parts) == 1 else np.concatenate(parts)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (the finisher of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, width: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the runs of `width` words; a shorter text is one run; none: empty."""
    words = word_hashes(text)
    if not len(words):
        return words
    n = max(1, len(words) - width + 1)
    state = np.full(n, min(len(words), width), np.uint64)
    with np.errstate(over="ignore"):
        for i in range(min(width, len(words))):
            state = mixed(state * np.uint64(0x9E3779B97F4A7C15) + words[i : i + n])
    return np.unique(state)


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Smallest id reachable from each id of the links: (id, component).

    Labels travel along the links and along the star of each label, so that chains shorten by
    half or more in a round; every round is landed in the shared folder. What a round joins by label
    is landed first, so that the rows of one large component are split over tasks. Nothing is
    collected but one count a round.
    """
    edges = landed(links.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b").distinct(), "links")
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = landed(both.groupBy(F.col("a").alias("id")).agg(F.min(F.least("a", "b")).alias("component")), "labels")
    while True:
        near = landed(
            both.join(labels, both.b == labels.id)
            .select(F.col("a").alias("id"), "component")
            .union(labels.select("id", "component"))
            .groupBy("id")
            .agg(F.min("component").alias("component")),
            "near",
        )
        # A label's own label: the smallest that any id carrying the old label has now seen.
        seen = landed(
            near.join(labels.withColumnRenamed("component", "old"), "id")
            .groupBy(F.col("old").alias("component"))
            .agg(F.min("component").alias("jump"))
            .where("jump < component"),
            "seen",
        )
        jumped = near.join(seen, "component", "left").select("id", F.least("component", "jump").alias("component"))
        after = landed(jumped, "labels")
        changed = after.join(labels.withColumnRenamed("component", "old"), "id").where("component <> old")
        if changed.isEmpty():
            return after
        labels = after
