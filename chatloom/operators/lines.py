"""Line filters and pairing, for texts held in a column and for line files."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chatloom.functions.text import let, pystrip, splitlines
from chatloom.options import DataOptions
from chatloom.session import landed, settle
from chatloom.sources.splits import CHANGED, KEYS, before, few, runs, told

# Lines of a split are paired this many at a time.
PAIR_BLOCK = 8192


def is_empty(line: Column, options: DataOptions) -> Column:
    return pystrip(line) == "" if options.skip_empty_lines else F.lit(False)


def is_comment(line: Column, options: DataOptions) -> Column:
    return F.startswith(pystrip(line), F.lit(options.comment_prefix)) if options.skip_comment_lines else F.lit(False)


def drop_empty_lines(lines: DataFrame, options: DataOptions = DataOptions(), line: str = "line") -> DataFrame:
    return lines.filter(~is_empty(F.col(line), options))


def drop_comment_lines(lines: DataFrame, options: DataOptions = DataOptions(), line: str = "line") -> DataFrame:
    """Meant to run after ``drop_empty_lines``: an empty prefix makes every line a comment."""
    return lines.filter(~is_comment(F.col(line), options))


def content_lines(text: Column, options: DataOptions = DataOptions()) -> Column:
    """Lines of a text that are neither blank nor comments, unstripped."""
    return F.filter(splitlines(text), lambda x: ~is_empty(x, options) & ~is_comment(x, options))


def pair_array(lines: Column) -> Column:
    """``array<struct<pair_no, user, assistant>>``; the odd last line is left out."""
    return let(
        lines,
        lambda a: F.when(
            F.size(a) >= 2,
            F.transform(
                F.sequence(F.lit(0), F.floor(F.size(a) / 2).cast("int") - 1),
                lambda i: F.struct(
                    i.cast("bigint").alias("pair_no"),
                    pystrip(F.get(a, i * 2)).alias("user"),
                    pystrip(F.get(a, i * 2 + 1)).alias("assistant"),
                ),
            ),
        ),
    )


def line_counts(text: Column, options: DataOptions = DataOptions()) -> Column:
    """``struct<raw_lines, skipped_empty, skipped_comments, dropped_unpaired>`` of one text."""

    def count(lines: Column, keep) -> Column:
        return F.size(F.filter(lines, keep)).cast("bigint")

    counted = let(
        splitlines(text),
        lambda a: F.struct(
            F.size(a).cast("bigint").alias("raw_lines"),
            count(a, lambda x: is_empty(x, options)).alias("skipped_empty"),
            count(a, lambda x: ~is_empty(x, options) & is_comment(x, options)).alias("skipped_comments"),
        ),
    )
    return let(
        counted,
        lambda c: F.struct(
            c["raw_lines"].alias("raw_lines"),
            c["skipped_empty"].alias("skipped_empty"),
            c["skipped_comments"].alias("skipped_comments"),
            F.pmod(c["raw_lines"] - c["skipped_empty"] - c["skipped_comments"], F.lit(2)).alias("dropped_unpaired"),
        ),
    )


def number_lines(lines: DataFrame, name: str = "line_no") -> DataFrame:
    """Number the rows of a file scan from 0 within each file, in file order, without a sort.

    Rows arrive in order inside a file split, where ``monotonically_increasing_id`` counts them
    up. A first pass over the scan counts rows per split (one small row each); the running total
    of those counts is the number at which a split starts. The counts are written to the shared
    folder, and broadcast only up to a number of bytes; beyond it they are joined by shuffle on the
    split, which no single file can overload.

    Both passes must cut the files alike (``session.configure`` pins what that depends on). A row
    whose place does not fit the counted split fails the job instead of getting a wrong number.
    """
    tagged = lines.withColumn("_mid", F.monotonically_increasing_id())
    splits = settle(tagged.groupBy(*KEYS).agg(F.min("_mid").alias("_first"), F.count(F.lit(1)).alias("_rows")))
    starts = splits.withColumn("_base", F.coalesce(F.sum("_rows").over(before()), F.lit(0)))
    if few(splits):
        starts = F.broadcast(starts)
    place = F.col("_mid") - F.col("_first")
    number = F.when((place >= 0) & (place < F.col("_rows")), F.col("_base") + place).otherwise(F.raise_error(F.lit(CHANGED)).cast("bigint"))
    return tagged.join(starts, KEYS, "left").withColumn(name, number).drop("_mid", "_first", "_rows", "_base")


def split_edges(content: DataFrame) -> DataFrame:
    """``source_path, block_start, n, head, head_ok, tail, tail_ok``: per split the number of its lines, its
    first and its last one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[str, int], list] = {}
        for batch in batches:
            for path, block, part in runs(batch):
                line, ok = part.column(2), part.column(3)
                if (path, block) not in seen:
                    seen[path, block] = [0, line.slice(0, 1), ok.slice(0, 1), None, None]
                edge = seen[path, block]
                edge[0] += part.num_rows
                edge[3:] = line.slice(part.num_rows - 1), ok.slice(part.num_rows - 1)
        if seen:
            keys = [pa.array([k[i] for k in seen], t) for i, t in enumerate((pa.string(), pa.int64()))]
            counts = pa.array([e[0] for e in seen.values()], pa.int64())
            texts = [pa.concat_arrays([e[i] for e in seen.values()]) for i in range(1, 5)]
            yield pa.RecordBatch.from_arrays([*keys, counts, *texts], names=names)

    names = ["source_path", "block_start", "n", "head", "head_ok", "tail", "tail_ok"]
    schema = "source_path string, block_start long, n long, head string, head_ok boolean, tail string, tail_ok boolean"
    return content.mapInArrow(run, schema)


def pairs_inside(content: DataFrame, starts: DataFrame) -> DataFrame:
    """``source_path, pair_no, user, assistant, utf8_ok`` of the pairs that lie in one split, in the task
    that reads it; ``starts`` tells for each split the lines before it and in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, base, told_n, seen, held = None, 0, 0, 0, None  # held: the line that waits for its partner

        def left() -> None:
            if split is not None and seen != told_n:
                raise ValueError(CHANGED)

        for batch in batches:
            at = batch.schema.names.index("base"), batch.schema.names.index("n")
            for path, block, part in runs(batch):
                if (path, block) != split:
                    left()
                    split, seen, held = (path, block), 0, None
                    base, told_n = (part.column(i)[0].as_py() for i in at)
                for cut in range(0, part.num_rows, PAIR_BLOCK):
                    some = part.slice(cut, PAIR_BLOCK)
                    line, ok = some.column(2), some.column(3)
                    first, seen = seen, seen + len(line)
                    if held is not None:
                        line, ok, first = pa.concat_arrays([held[0], line]), pa.concat_arrays([held[1], ok]), first - 1
                    elif (base + first) % 2:  # its partner is the last line of the split before
                        line, ok, first = line.slice(1), ok.slice(1), first + 1
                    many = len(line) // 2
                    held = (line.slice(2 * many), ok.slice(2 * many)) if len(line) % 2 else None
                    if not many:
                        continue
                    user, assistant = pa.array(np.arange(0, 2 * many, 2)), pa.array(np.arange(1, 2 * many, 2))
                    numbers = pa.array((base + first) // 2 + np.arange(many))
                    both = pc.and_(ok.take(user), ok.take(assistant))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([path] * many), numbers, line.take(user), line.take(assistant), both], names=names
                    )
        left()

    names = ["source_path", "pair_no", "user", "assistant", "utf8_ok"]
    schema = "source_path string, pair_no long, user string, assistant string, utf8_ok boolean"
    return told(content, starts).mapInArrow(run, schema)


def pair_lines(content: DataFrame) -> DataFrame:
    """Content lines 2k and 2k+1 of each file side by side.

    ``content`` is a file scan with ``source_path, block_start, line`` after the line filters. Lines are
    paired in the task that reads them. A first pass brings the first and last line of every split and
    their number; only these are exchanged, and pairs over an edge are made of them. The odd last line of
    a file comes out with a null assistant.
    """
    readable = F.col("utf8_ok") if "utf8_ok" in content.columns else F.lit(True)
    rows = content.select(*KEYS, "line", readable.alias("utf8_ok"))
    edges = landed(split_edges(rows), "edges")
    base = F.coalesce(F.sum("n").over(before()), F.lit(0))
    inside = pairs_inside(rows, landed(edges.select(*KEYS, base.alias("base"), "n"), "starts"))
    following = W.partitionBy("source_path").orderBy("block_start")
    over = (
        edges.select("source_path", (base + F.col("n")).alias("end"), "tail", "tail_ok", *(F.lead(c).over(following).alias(c) for c in ("head", "head_ok")))
        .filter("end % 2 = 1")
        .select("source_path", F.expr("end div 2").alias("pair_no"), F.col("tail").alias("user"), F.col("head").alias("assistant"),
                (F.col("tail_ok") & F.coalesce("head_ok", F.lit(True))).alias("utf8_ok"))
    )
    return inside.union(over).withColumns({c: pystrip(F.col(c)) for c in ("user", "assistant")})


def drop_unpaired_tail(pairs: DataFrame) -> DataFrame:
    return pairs.filter(F.col("assistant").isNotNull())


def skip_empty_pair(pairs: DataFrame) -> DataFrame:
    """With blank lines kept as content, a pair with a blank half is no sample."""
    return pairs.filter((F.col("user") != "") & (F.col("assistant") != ""))
