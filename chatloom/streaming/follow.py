"""Following growing log files by byte offsets, as a streaming data source."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from chatloom.operators.governance import redact_literal
from chatloom.sources.files import filesystem

HEAD = 256  # bytes at the beginning by which a file is known again
BLOCK = 1 << 20
RANGE_BYTES = 32 << 20  # new bytes of a file that one task reads
BATCH_LINES = 10_000


def complete_bytes(file: pa.NativeFile, size: int) -> int:
    """Place behind the last line break in the first `size` bytes, looked for from the end."""
    end = size
    while end:
        start = max(0, end - BLOCK)
        file.seek(start)
        cut = file.read(end - start).rfind(b"\n")
        if cut >= 0:
            return start + cut + 1
        end = start
    return 0


@dataclass
class LineRange(InputPartition):
    """The lines of a file that begin in `start` to `stop`; the new bytes are `first` to `end`."""

    path: str
    first: int
    start: int
    stop: int
    end: int


class FollowReader(DataSourceStreamReader):
    """Offsets: per file the place behind its last complete line, and the length and checksum of its head.

    A file that became shorter, or has another head, is read from 0. A file that took another's place
    (a rotated log) is known by its head and read on from where that one was.
    """

    def __init__(self, options: dict[str, str]) -> None:
        self.fs, self.root = filesystem(options["path"])
        self.latest = options.get("startingoffsets", "latest") == "latest"
        self.flush = options.get("flush", "false") == "true"
        self.range_bytes = int(options.get("rangebytes", RANGE_BYTES))
        self._seen: dict[str, tuple] = {}

    def _files(self) -> list[pafs.FileInfo]:
        found = self.fs.get_file_info(self.root)
        if found.type == pafs.FileType.Directory:
            inside = self.fs.get_file_info(pafs.FileSelector(self.root))
            return [f for f in inside if f.type == pafs.FileType.File and not f.base_name.startswith((".", "_"))]
        return [found] if found.type == pafs.FileType.File else []

    def _mark(self, info: pafs.FileInfo) -> dict:
        """What is known of a file; one that did not change since the last look is not opened."""
        at = (info.size, info.mtime_ns, self.flush)
        if self._seen.get(info.path, (None,))[0] != at:
            with self.fs.open_input_file(info.path) as file:
                end = info.size if self.flush else complete_bytes(file, info.size)
                n = min(HEAD, end)
                file.seek(0)
                self._seen[info.path] = (at, {"at": end, "n": n, "head": zlib.crc32(file.read(n))})
        return self._seen[info.path][1]

    def _all(self) -> dict:
        return {info.path: self._mark(info) for info in self._files()}

    def initialOffset(self) -> dict:
        return self._all() if self.latest else {}

    def latestOffset(self) -> dict:
        return self._all()

    def _same(self, path: str, mark: dict, now: dict) -> bool:
        """Whether the file at `path` is the one that `mark` was made of, grown or not."""
        if now["at"] < mark["at"]:
            return False
        if now["n"] == mark["n"]:
            return now["head"] == mark["head"]
        with self.fs.open_input_file(path) as file:
            return zlib.crc32(file.read(mark["n"])) == mark["head"]

    def partitions(self, start: dict, end: dict) -> list[LineRange]:
        kept = {p for p, now in end.items() if p in start and self._same(p, start[p], now)}
        gone = [m for p, m in start.items() if p not in kept and m["n"]]
        out = []
        for path, now in sorted(end.items()):
            if path in kept:
                first = start[path]["at"]
            else:
                first = max((m["at"] for m in gone if self._same(path, m, now)), default=0)
            for at in range(first, now["at"], self.range_bytes):
                out.append(LineRange(path, first, at, min(at + self.range_bytes, now["at"]), now["at"]))
        return out

    def read(self, partition: LineRange) -> Iterator[pa.RecordBatch]:
        names = ["path", "offset", "line"]
        with self.fs.open_input_file(partition.path) as file:
            lines: list[tuple[int, bytes]] = []
            for at, line in _lines(file, partition):
                lines.append((at, line))
                if len(lines) == BATCH_LINES:
                    yield _batch(partition.path, lines, names)
                    lines = []
            if lines:
                yield _batch(partition.path, lines, names)


def _batch(path: str, lines: list[tuple[int, bytes]], names: list[str]) -> pa.RecordBatch:
    texts = [line.decode("utf-8", "replace") for _, line in lines]
    return pa.RecordBatch.from_arrays([pa.array([path] * len(lines)), pa.array([at for at, _ in lines], pa.int64()), pa.array(texts)], names=names)


def _lines(file: pa.NativeFile, part: LineRange) -> Iterator[tuple[int, bytes]]:
    """(offset, line) of the lines that begin in the range. What stands before the first line break
    belongs to the range before, except in the first one."""
    at = part.start if part.start == part.first else part.start - 1
    skip = at < part.start
    file.seek(at)
    held, begun = [], at  # parts of the line that is being read, and where it began
    while at < part.end:
        block = file.read(min(BLOCK, part.end - at))
        if not block:
            return  # the file was cut meanwhile; its new state is read in a later batch
        place = 0
        while (cut := block.find(b"\n", place)) >= 0:
            if not skip:
                yield begun, b"".join([*held, block[place:cut]])
            held, skip, place = [], False, cut + 1
            begun = at + place
            if begun >= part.stop:
                return
        if not skip:
            held.append(block[place:])
        at += len(block)
    if not skip and begun < part.stop and any(held):
        yield begun, b"".join(held)


class FollowSource(DataSource):
    """Options: path (a file or a folder), startingOffsets (latest or earliest), flush, rangeBytes."""

    @classmethod
    def name(cls) -> str:
        return "chatloom_follow"

    def schema(self) -> str:
        return "path string, offset long, line string"

    def streamReader(self, schema) -> FollowReader:
        return FollowReader({k.lower(): v for k, v in self.options.items()})


def follow_files(
    spark: SparkSession, path: str, secrets: tuple[str, ...] = (), starting: str = "latest", flush: bool = False
) -> DataFrame:
    """``path, offset, line`` of the lines that come to a log file, or to the files of a folder, redacted.

    With ``starting="latest"`` lines that are there when the query first starts are left out; one that
    is unfinished then comes out whole. Lines end at LF; an unfinished last line is held back until it
    ends, or until a run with ``flush`` (the writer has closed). Bad bytes become U+FFFD.
    """
    spark.dataSource.register(FollowSource)
    reader = spark.readStream.format(FollowSource.name()).option("path", path)
    stream = reader.option("startingOffsets", starting).option("flush", str(flush).lower()).load()
    return stream.withColumn("line", redact_literal(F.col("line"), secrets))
