"""Files of model folders, found and read by tasks.

Spark's file scans keep the status of every file on the driver, a few kilobytes each with what the
planner makes of it. Model folders by the million are listed here by tasks: one streams the names of
the folders in the root, others those of the next levels and the files in the models.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

SCHEME = "^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?"
_KINDS = {T.StringType(): pa.string(), T.BinaryType(): pa.binary(), T.LongType(): pa.int64(), T.TimestampType(): pa.timestamp("us", "UTC")}
# Rows and bytes after which a batch is given out.
_ROWS, _BYTES = 1_000, 8 << 20


def local_folder(spark: SparkSession, root: str) -> str | None:
    """The absolute path of a folder in the file system of the machines, which may be a mounted one; else None."""
    scheme = re.match("[A-Za-z][A-Za-z0-9+.-]*:", root)
    if not scheme:
        default = spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS")
        scheme = re.match("[A-Za-z][A-Za-z0-9+.-]*:", default or "file:")
    path = re.sub(SCHEME, "", root).rstrip("/")
    return path if scheme and scheme[0] == "file:" and path.startswith("/") and os.path.isdir(path) else None


def _hidden(entry: os.DirEntry) -> bool:
    """Whether Spark's file scans pass over a file or folder."""
    name = entry.name
    if name.startswith(("_metadata", "_common_metadata")) and entry.is_dir():
        return False
    return name.startswith(".") or (name.startswith("_") and "=" not in name) or name.endswith("._COPYING_")


def _batches(rows: Iterator[tuple], schema: T.StructType) -> Iterator[pa.RecordBatch]:
    def made() -> pa.RecordBatch:
        columns = zip(*some, strict=True)
        return pa.RecordBatch.from_arrays(
            [pa.array(c, _KINDS[f.dataType]) for c, f in zip(columns, schema, strict=True)], names=schema.names
        )

    some: list[tuple] = []
    size = 0
    for row in rows:
        some.append(row)
        size += sum(len(x) for x in row if isinstance(x, bytes))
        if len(some) >= _ROWS or size >= _BYTES:
            yield made()
            some, size = [], 0
    if some:
        yield made()


def _of_folders(folders: DataFrame, work: Callable[[str], Iterator[tuple]], schema: str) -> DataFrame:
    fields = T._parse_datatype_string(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        paths = (path for batch in batches for path in batch.column(0).to_pylist())
        return _batches((row for path in paths for row in work(path)), fields)

    return folders.mapInArrow(run, fields)


def _entries(folder: str) -> Iterator[os.DirEntry]:
    with os.scandir(folder) as found:
        yield from (e for e in found if not _hidden(e))


def model_folders(spark: SparkSession, root: str, depth: int) -> DataFrame:
    """Paths of the folders `depth` levels below a local folder, dealt out over tasks."""

    def below(folder: str) -> Iterator[tuple]:
        return ((e.path,) for e in _entries(folder) if e.is_dir())

    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    folders = spark.createDataFrame([(root,)], "path string").coalesce(1)
    for _ in range(depth):
        folders = _of_folders(folders, below, "path string").repartition(tasks, "path")
    return folders


def read_files(folders: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """``path, content`` of the files of given names that lie in folders; empty files are left out."""

    def read(folder: str) -> Iterator[tuple]:
        for entry in _entries(folder):
            if entry.name in names and entry.is_file():
                with open(entry.path, "rb") as file:
                    content = file.read()
                if content:
                    yield entry.path, content

    return _of_folders(folders, read, "path string, content binary")


def list_files(folders: DataFrame) -> DataFrame:
    """``path, length, modificationTime`` of the files in folders and all below them; empty files are left out."""

    def walk(folder: str) -> Iterator[tuple]:
        left = [folder]
        while left:
            for entry in _entries(left.pop()):
                if entry.is_dir():
                    left.append(entry.path)
                elif entry.is_file() and (stat := entry.stat()).st_size:
                    yield entry.path, stat.st_size, stat.st_mtime_ns // 1_000_000 * 1_000

    return _of_folders(folders, walk, "path string, length long, modificationTime timestamp")
