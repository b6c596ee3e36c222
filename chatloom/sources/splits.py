"""Work along the splits of files: rows arrive in file order inside a split, and what a split needs to
know of those before it is told by a small table with one row per split."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

KEYS = ["source_path", "block_start"]
# A table of splits is broadcast only up to this many bytes, after they were summed.
FACT_BYTES = 64 << 20
CHANGED = "the file splits changed between two passes over the lines"


def before(*order: str) -> W:
    """The splits of the same file before a split."""
    return W.partitionBy("source_path").orderBy("block_start").rowsBetween(W.unboundedPreceding, -1)


def told(rows: DataFrame, facts: DataFrame) -> DataFrame:
    """Rows of a file scan, in their order, with the facts of their split.

    A table of splits too large to be broadcast is joined by shuffle, and the rows are put in order again.
    Both passes over the files must cut them alike; a row of a split that is not known fails the job.
    """
    marked, known = rows, facts.withColumn("_known", F.lit(True))
    small = few(facts)
    if not small:
        marked = rows.withColumn("_mid", F.monotonically_increasing_id())
    joined = marked.join(F.broadcast(known) if small else known, KEYS, "left")
    checked = joined.withColumn("_known", F.coalesce("_known", F.raise_error(F.lit(CHANGED)).cast("boolean")))
    return checked if small else checked.repartition(*KEYS).sortWithinPartitions(*KEYS, "_mid").drop("_mid")


def few(facts: DataFrame) -> bool:
    """Whether a table of splits may be broadcast, by its bytes."""
    size = facts.agg(F.sum(F.octet_length("source_path") + 8 * len(facts.columns) + 64)).first()[0]
    return (size or 0) <= FACT_BYTES


def runs(batch: pa.RecordBatch) -> Iterator[tuple[str, int, pa.RecordBatch]]:
    """(source_path, block_start, rows) of the stretches of a batch that come from one split each."""
    if not batch.num_rows:
        return
    path, block = (batch.column(batch.schema.names.index(k)) for k in KEYS)
    files, starts = np.asarray(path.dictionary_encode().indices), np.asarray(block)
    cuts = np.flatnonzero((files[1:] != files[:-1]) | (starts[1:] != starts[:-1])) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
        yield path[a].as_py(), int(starts[a]), batch.slice(a, b - a)
