"""Hold-out split, first samples, newest checkpoint."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatloom.session import settle

# Hex digits of the hash that one refinement step looks at: at most 65,536 counts.
_DIGITS = 4
# Rows of the boundary bucket that are few enough to rank at once.
_RANKABLE = 20_000


def eval_size(n: int, eval_split: float) -> int:
    """Size of the hold-out: rounded half to even, at least 1, leaving at least one row."""
    if eval_split <= 0 or n < 2:
        return 0
    return min(max(1, int(round(n * float(eval_split)))), n - 1)


def split_hash(sample_id: Column, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), sample_id.cast("string")))


def split_records(
    samples: DataFrame, eval_split: float, seed: int, key: str = "sample_id", settled: bool = True
) -> DataFrame:
    """Add ``split`` (``train`` or ``eval``): the ``k`` smallest ``(md5, key)`` are held out.

    ``key`` must be unique. The boundary is found from histograms of hash digits, refined inside
    the boundary bucket until that is small; only the key column is read for it, each step counts
    before it shuffles, and at most 65,536 counts come back. The split itself is then one
    comparison per row: no join, sort or shuffle of the samples.

    With ``settled=False`` the samples are costly to compute: their hashes are then written to the
    shared folder first, so that the histograms do not compute them again and again.
    """
    ranked = samples.select(split_hash(F.col(key), seed).alias("h"), F.col(key).alias("k"))
    boundary = _boundary(ranked if settled else settle(ranked), eval_split)
    if boundary is None:
        return samples.withColumn("split", F.lit("train"))
    digest, last_key = boundary
    h = split_hash(F.col(key), seed)
    held = (h < digest) | ((h == digest) & (F.col(key) <= F.lit(last_key)))
    return samples.withColumn("split", F.when(held, "eval").otherwise("train"))


def _boundary(ranked: DataFrame, eval_split: float):
    """The largest (hash, key) that is still held out, or None."""
    prefix, rest = "", None
    while True:
        level = len(prefix) + _DIGITS
        bucket = ranked.filter(F.startswith("h", F.lit(prefix))) if prefix else ranked
        counts = dict(
            bucket.groupBy(F.substring("h", 1, level).alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()
        )
        if rest is None:
            rest = eval_size(sum(counts.values()), eval_split)
            if rest == 0:
                return None
        for digits in sorted(counts):
            if rest <= counts[digits]:
                prefix = digits
                break
            rest -= counts[digits]
        if counts[prefix] <= _RANKABLE or level >= 32:
            break
    held = ranked.filter(F.startswith("h", F.lit(prefix))).orderBy("h", "k").limit(rest)
    last = held.agg(F.max(F.struct("h", "k")).alias("m")).first()["m"]
    return last["h"], last["k"]


def attach_eval_set(train: DataFrame, evaluation: DataFrame) -> DataFrame:
    """A dedicated evaluation set replaces the split; the training set stays whole."""
    return train.withColumn("split", F.lit("train")).unionByName(evaluation.withColumn("split", F.lit("eval")))


def limit_samples(samples: DataFrame, n: int = 5, order: tuple[str, ...] = ("source_path", "record_no")) -> DataFrame:
    """First samples in file order."""
    return samples.orderBy(*order).limit(n)


def latest_checkpoint(listing: DataFrame, run: str = "run_id") -> DataFrame:
    """Newest ``checkpoint-*`` per run by modification time, ties by path; null when none."""
    name = F.element_at(F.split("path", "/"), -1)
    path = F.when(F.startswith(name, F.lit("checkpoint-")), F.col("path"))
    newest = F.max(F.when(path.isNotNull(), F.struct("mtime", "path")))
    return listing.groupBy(run).agg(newest.alias("_m")).select(run, F.col("_m.path").alias("checkpoint"))
