"""Large ``.json`` files, cut at the borders of their records wherever their splits lie.

Spark's line reader cuts a file at closing braces, so that any file splits. Whether a comma there ends
a list element depends on all that stands before: on the strings and brackets that are open. A first
pass works out what every split does to that state, for each state it may begin in; one row per split
then tells the state at its start. A second pass finds the borders. Only the records that reach over a
split's edge are exchanged.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatloom.functions.records import strict_json
from chatloom.functions.text import PY_SPACE, pystrip
from chatloom.operators.lines import is_comment, is_empty
from chatloom.options import DataOptions
from chatloom.session import landed
from chatloom.sources.splits import KEYS, before, runs, told

OUTSIDE, STRING, ESCAPE = 0, 1, 2  # outside strings, in one, behind a backslash in one
_DELTA = np.zeros(256, np.int8)
_DELTA[[ord("["), ord("{")]] = 1
_DELTA[[ord("]"), ord("}")]] = -1
_STRUCTURAL = _DELTA != 0
_STRUCTURAL[ord(",")] = True


class Marks(NamedTuple):
    """Structure of some bytes: places of brackets and commas outside strings, the depth after each, and
    the state at the end."""

    places: np.ndarray
    depths: np.ndarray
    state: int
    depth: int


def structure(data: np.ndarray, state: int, depth: int) -> Marks:
    if not len(data):
        return Marks(np.zeros(0, np.int64), np.zeros(0, np.int64), state, depth)
    slashes = np.flatnonzero(data == 92)
    escaped = [0] if state == ESCAPE and data[0] != 92 else []
    open_end = False
    if len(slashes):
        first = np.flatnonzero(np.diff(slashes, prepend=-2) > 1)
        starts, lengths = slashes[first], np.diff(np.append(first, len(slashes)))
        odd = lengths - ((starts == 0) & (state == ESCAPE)) & 1 == 1
        behind = (starts + lengths)[odd]
        open_end = bool(len(behind)) and int(behind[-1]) == len(data)
        escaped = np.concatenate([np.array(escaped, np.int64), behind[behind < len(data)]])
    quote = data == 34
    if len(escaped):
        quote[np.asarray(escaped, np.int64)] = False
    quotes = np.flatnonzero(quote)
    inside = int(state != OUTSIDE)
    places = np.flatnonzero(_STRUCTURAL[data])
    places = places[(np.searchsorted(quotes, places) + inside) % 2 == 0]
    depths = depth + np.cumsum(_DELTA[data[places]], dtype=np.int64)
    ends_inside = (len(quotes) + inside) % 2 == 1
    end = ESCAPE if open_end and ends_inside else STRING if ends_inside else OUTSIDE
    return Marks(places, depths, end, int(depths[-1]) if len(depths) else depth)


def fragments(spark: SparkSession, path: str, least: int) -> DataFrame:
    """``source_path, block_start, size, value`` of ``.json`` files above `least` bytes, cut behind closing
    braces (left out); in order inside each split."""
    rows = spark.read.text(path, lineSep="}", pathGlobFilter="*.[jJ][sS][oO][nN]", recursiveFileLookup=True)
    return rows.filter(F.col("_metadata.file_size") > least).select(
        F.col("_metadata.file_path").alias("source_path"),
        F.col("_metadata.file_block_start").alias("block_start"),
        F.col("_metadata.file_size").alias("size"),
        F.col("value").cast("binary").alias("value"),
    )


def _bytes(rows: pa.RecordBatch) -> bytes:
    return b"}".join(rows.column(rows.schema.names.index("value")).to_pylist()) + b"}"


def split_effects(found: DataFrame) -> DataFrame:
    """One row per split: what it does to the state, for each state at its start; its bytes; its first
    byte that is not white space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[str, int], list] = {}
        for batch in batches:
            for path, block, rows in runs(batch):
                fact = seen.setdefault((path, block), [rows.column(2)[0].as_py(), 0, None, [(s, 0) for s in range(3)]])
                data = _bytes(rows)
                fact[1] += len(data)
                if fact[2] is None:
                    fact[2] = data.lstrip()[:1].decode("latin-1") or None
                raw = np.frombuffer(data, np.uint8)
                fact[3] = [(m.state, m.depth) for m in (structure(raw, s, d) for s, d in fact[3])]
        columns = [[*k, size, read, first, [s for s, _ in ends], [d for _, d in ends]] for k, (size, read, first, ends) in seen.items()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*columns, strict=True) if columns else [[]] * 7, kinds, strict=True)], names=names)

    names = ["source_path", "block_start", "size", "read", "first", "states", "depths"]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int64())]
    schema = "source_path string, block_start long, size long, read long, first string, states array<int>, depths array<long>"
    return found.mapInArrow(run, schema)


def split_starts(effects: DataFrame) -> DataFrame:
    """One row per split: the file's form (list, object or lines), the state and depth at the start, whether
    it is the last one, and whether the file ends with the brace that the reader took away.

    The rows of a file follow each other in one task, which holds one of them at a time.
    """
    names = [*KEYS, "form", "state", "depth", "last", "brace"]
    kinds = [pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.bool_(), pa.bool_()]
    forms = {"[": "list", "{": "object", None: "object"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, file, state, depth, read, first = None, None, 0, 0, 0, None

        def closed(row: list, last: bool, size: int, total: int) -> list:
            # The reader leaves out a byte order mark of three bytes.
            return [*row, last, last and total in (size, size - 3)]

        for batch in batches:
            out = []
            for r in batch.to_pylist():
                new = r["source_path"] != file
                if held is not None:
                    out.append(closed(held, new, size, read))
                if new:
                    file, state, depth, read, first = r["source_path"], 0, 0, 0, None
                first = first or r["first"]
                held, size = [file, r["block_start"], forms.get(first, "lines"), state, depth], r["size"]
                state, depth = r["states"][state], depth + r["depths"][state]
                read += r["read"]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
        if held is not None:
            row = closed(held, True, size, read)
            yield pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(row, kinds, strict=True)], names=names)

    schema = "source_path string, block_start long, form string, state int, depth long, last boolean, brace boolean"
    return effects.repartition("source_path").sortWithinPartitions(*KEYS).mapInArrow(run, schema)


class Cutter:
    """Cuts the bytes of one split into records; what lies before the first and behind the last border
    stays apart. A border of a list is its opening and closing bracket and the commas between."""

    def __init__(self, form: str, state: int, depth: int, options: DataOptions) -> None:
        self.form, self.state, self.depth, self.options = form, state, depth, options
        self.head: list[bytes] = []
        self.held = self.head
        self.records: list[bytes] = []
        self.bordered = self.bad = False

    def add(self, data: bytes) -> None:
        if self.form == "list":
            raw = np.frombuffer(data, np.uint8)
            marks = structure(raw, self.state, self.depth)
            kinds = raw[marks.places]
            opens, closes = (_DELTA[kinds] > 0) & (marks.depths == 1), (_DELTA[kinds] < 0) & (marks.depths == 0)
            self.bad |= bool(np.any(kinds[opens] != 91) or np.any(kinds[closes] != 93) or np.any(marks.depths < 0))
            borders = marks.places[opens | closes | ((kinds == 44) & (marks.depths == 1))].tolist()
            self.state, self.depth = marks.state, marks.depth
        elif self.form == "lines":
            raw = np.frombuffer(data, np.uint8)
            borders = np.flatnonzero((raw == 10) | ((raw == 13) & (np.append(raw[1:], 0) != 10))).tolist()
        else:
            borders = []
        at = 0
        for border in borders:
            self.held.append(data[at:border])
            if self.bordered:
                self.records.append(b"".join(self.held))
            self.held, self.bordered, at = [], True, border + 1
        self.held.append(data[at:])

    def end(self) -> None:
        self.bad |= self.form == "list" and (self.state, self.depth) != (OUTSIDE, 0)

    def taken(self) -> list[bytes]:
        """Records since the last call; of lines, those that are neither blank nor comments."""
        records, self.records = self.records, []
        return records if self.form == "list" else [r for r in records if self._said(r)]

    def _said(self, line: bytes) -> bool:
        text, how = line.decode("utf-8", "replace").strip(PY_SPACE), self.options
        return not (how.skip_empty_lines and not text) and not (how.skip_comment_lines and text.startswith(how.comment_prefix))


def cut_records(found: DataFrame, starts: DataFrame, options: DataOptions = DataOptions()) -> DataFrame:
    """``source_path, block_start, form, part, i, text``: records inside a split (part `whole`, i from 1), and
    what reaches over its edges: `head`, `tail`, or `through` where no border lies in the split."""
    facts = ["form", "state", "depth", "last", "brace"]
    names = ["source_path", "block_start", "form", "part", "i", "bad", "text"]
    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.bool_(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, cutter, told_of, ended, count = None, None, None, b"", 0

        def rows(key, cut: Cutter, parts: list[tuple[str, int, bytes]]) -> pa.RecordBatch:
            table = [(*key, cut.form, part, i, cut.bad, text) for part, i, text in parts]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*table, strict=True), kinds, strict=True)], names=names)

        def finish() -> pa.RecordBatch:
            # The reader's last brace is none at the end of a file that ends otherwise.
            cutter.add(ended[:-1] if told_of["last"] and not told_of["brace"] else ended)
            if told_of["last"]:
                cutter.end()
            inner = [("whole", count + i + 1, t) for i, t in enumerate(cutter.taken())]
            edges = [("head", 0, b"".join(cutter.head)), ("tail", 0, b"".join(cutter.held))]
            return rows(now, cutter, inner + (edges if cutter.bordered else [("through", 0, b"".join(cutter.head))]))

        for batch in batches:
            at = {f: batch.schema.names.index(f) for f in facts}
            for path, block, part in runs(batch):
                if (path, block) != now:
                    if now is not None:
                        yield finish()
                    now, told_of = (path, block), {f: part.column(at[f])[0].as_py() for f in facts}
                    cutter, ended, count = Cutter(told_of["form"], told_of["state"], told_of["depth"], options), b"", 0
                cutter.add(ended)
                whole = cutter.taken()
                if whole:
                    yield rows(now, cutter, [("whole", count + i + 1, t) for i, t in enumerate(whole)])
                    count += len(whole)
                ended = _bytes(part)
        if now is not None:
            yield finish()

    schema = "source_path string, block_start long, form string, part string, i long, bad boolean, text binary"
    return told(found, starts).mapInArrow(run, schema)


def scan_large_json(spark: SparkSession, path: str, least: int, options: DataOptions) -> DataFrame:
    """``source_path, record_no, record`` of ``.json`` files above `least` bytes; the same rows that reading
    each file as one value would give.

    A file is known as a list, an object or JSON Lines by its first character. A list that is no JSON is one
    null record; a file with bytes that are no UTF-8 has null records only.
    """
    found = fragments(spark, path, least)
    starts = landed(split_starts(landed(split_effects(found), "effects")), "starts")
    pieces = landed(cut_records(found, starts, options), "pieces")
    text = F.col("text").cast("string")

    # A record over edges begins in a split's tail, runs through splits without a border and ends in a head,
    # where it comes before the records inside; the last one of a file has no head.
    edges = pieces.where("part <> 'whole'")
    bordered = edges.groupBy(*KEYS).agg(F.max((F.col("part") == "head").cast("int")).alias("bordered"))
    chains = bordered.select(*KEYS, F.coalesce(F.sum("bordered").over(before()), F.lit(0)).alias("chain"))
    over = (
        edges.join(chains, KEYS)
        .withColumn("chain", F.col("chain") + F.when(F.col("part") == "tail", 1).otherwise(0))
        .groupBy("source_path", "chain")
        .agg(
            F.max("block_start").alias("block_start"),
            F.min("form").alias("form"),
            F.bool_or(F.col("part") == "head").alias("ended"),
            F.array_sort(F.collect_list(F.struct("block_start", "text"))).alias("_parts"),
        )
        .withColumn("text", F.aggregate("_parts", F.lit(b""), lambda a, x: F.concat(a, x["text"])))
    )
    around = (F.col("form") == "list") & (~F.col("ended") | (F.col("chain") == 0))  # outside the list's brackets
    gone = (F.col("form") == "lines") & (is_empty(text, options) | is_comment(text, options) | (~F.col("ended") & (pystrip(text) == "")))
    over = over.where(~gone).select(*KEYS, "form", F.when(around, "around").when(F.col("ended"), "first").otherwise("last").alias("part"), F.lit(0).cast("long").alias("i"), "text")
    records = landed(pieces.where("part = 'whole'").select(*over.columns).union(over), "records")

    value, utf8, blank = F.expr(strict_json("cast(text AS string)")), F.is_valid_utf8(text), pystrip(text) == ""
    inner = F.col("part") != "around"
    judged = records.select("source_path", "form", inner.alias("inner"), blank.alias("blank"), utf8.alias("utf8"), (inner & ~blank & value.isNull()).alias("bad"))
    files = judged.groupBy("source_path").agg(
        F.min("form").alias("_form"),
        F.bool_or(~F.col("utf8")).alias("_bytes"),
        F.bool_or(F.col("bad")).alias("_bad"),
        F.bool_or(~F.col("inner") & ~F.col("blank")).alias("_outside"),
        F.count_if(F.col("inner")).alias("_n"),
        F.count_if(F.col("inner") & F.col("blank")).alias("_blank"),
    )
    shape = pieces.groupBy("source_path").agg(F.bool_or("bad").alias("_shape"))
    damage = F.col("_bad") | F.col("_outside") | F.col("_shape") | ((F.col("_blank") > 0) & (F.col("_n") > 1))
    files = landed(files.join(shape, "source_path").withColumn("_broken", (F.col("_form") == "list") & damage).select("source_path", "_form", "_bytes", "_broken"), "files")

    kept = records.where("part <> 'around'")
    counts = kept.groupBy(*KEYS).agg(F.max("i").alias("_inside"), F.count_if(F.col("part") == "first").alias("_first"), F.count_if(F.col("part") == "last").alias("_last"))
    offset = F.coalesce(F.sum(F.col("_inside") + F.col("_first") + F.col("_last")).over(before()), F.lit(0))
    offsets = landed(counts.select(*KEYS, offset.alias("_offset"), "_inside", "_first"), "offsets")
    place = F.when(F.col("part") == "first", 0).when(F.col("part") == "last", F.col("_first") + F.col("_inside")).otherwise(F.col("_first") + F.col("i") - 1)
    good = kept.join(offsets, KEYS).join(files, "source_path").where("not _broken").where(~((F.col("_form") == "list") & blank))
    return good.select("source_path", (F.col("_offset") + place).alias("record_no"), F.when(~F.col("_bytes"), value).alias("record")).union(
        files.where("_broken").select("source_path", F.lit(0).cast("long"), F.lit(None).cast("variant"))
    )
