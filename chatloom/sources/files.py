"""A sink of named files and of counted line files, with a two-phase commit.

Tasks write to a staging folder below the target. When all are done and their messages tell that there
are rows enough, tasks put the files in place, each those of some staging folders. Otherwise the target
stays as it was. The driver holds one line per task, no names of files.
"""

from __future__ import annotations

import itertools
import json
import re
import uuid
from collections.abc import Callable, Iterator
from contextlib import suppress
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from chatloom.options import DataFormatError

NO_ROWS, BAD_RECORD = "NO_ROWS_TO_COMMIT", "BAD_RECORD_TO_COMMIT"


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a URI; a bare path is local."""
    if path.startswith("file:") and "://" not in path:
        path = path.replace("file:", "file://", 1)
    fs, inner = pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)
    return fs, inner.rstrip("/")


@dataclass
class Written(WriterCommitMessage):
    """What a task wrote: its staging folder, which holds a manifest of its files, and counts; the first bad
    record it met, (path, number, reason)."""

    folder: str
    rows: int
    size: int
    bad: tuple[str, int, str] | None = None


class FilesWriter(DataSourceArrowWriter):
    """Options: path; kind, `named` for (name, content) rows or `lines` for one text column, which
    (source_path, record_no, reason) of the rows that must not be there may follow; least, the rows without
    which nothing is committed; suffix of line files; job, a name of its own for this write."""

    def __init__(self, options: dict[str, str]) -> None:
        self.uri, self.kind, self.job = options["path"], options["kind"], options["job"]
        self.least, self.suffix = int(options.get("least", "0")), options.get("suffix", ".txt")
        self.staging = f"{filesystem(self.uri)[1]}/_staging-{self.job}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, _ = filesystem(self.uri)
        context = TaskContext.get()
        folder = f"{self.staging}/{context.partitionId():05d}-{context.taskAttemptId()}"
        fs.create_dir(folder, recursive=True)
        done = Written(folder, 0, 0)
        with fs.open_output_stream(f"{folder}/manifest") as manifest:
            if self.kind == "named":
                self._named(fs, iterator, manifest, done)
            else:
                self._lines(fs, iterator, manifest, done, f"part-{context.partitionId():05d}-{self.job}{self.suffix}")
        return done

    def _named(self, fs: pafs.FileSystem, batches: Iterator[pa.RecordBatch], manifest, done: Written) -> None:
        for batch in batches:
            names = batch.column(batch.schema.names.index("name")).to_pylist()
            contents = batch.column(batch.schema.names.index("content")).cast(pa.binary())
            for name, content in zip(names, contents, strict=True):
                parts = (name or "").split("/")
                if any(p in ("", ".", "..") for p in parts) or parts[0].startswith(("_", ".")):
                    raise ValueError(f"not a name of a file below the target: {name!r}")
                data = content.as_py() or b""
                with fs.open_output_stream(f"{done.folder}/{done.rows}") as out:
                    out.write(data)
                manifest.write(json.dumps([str(done.rows), name]).encode() + b"\n")
                done.rows, done.size = done.rows + 1, done.size + len(data)

    def _lines(self, fs: pafs.FileSystem, batches: Iterator[pa.RecordBatch], manifest, done: Written, name: str) -> None:
        out = None
        try:
            for batch in batches:
                if batch.num_columns > 1:
                    good = batch.column(3).is_null()
                    for bad in batch.filter(pc.invert(good)).select([1, 2, 3]).to_pylist():
                        first = tuple(bad.values())
                        done.bad = first if done.bad is None else min(done.bad, first)
                    batch = batch.filter(good)
                if not batch.num_rows:
                    continue
                out = out or fs.open_output_stream(f"{done.folder}/0")
                data = b"\n".join(x or b"" for x in batch.column(0).cast(pa.binary()).to_pylist()) + b"\n"
                out.write(data)
                done.rows, done.size = done.rows + batch.num_rows, done.size + len(data)
        finally:
            if out is not None:
                out.close()
        if done.rows:
            manifest.write(json.dumps(["0", name]).encode() + b"\n")

    def commit(self, messages: list[Written | None]) -> None:
        """Note what is to be put in place, if it may be."""
        fs, _ = filesystem(self.uri)
        done = [m for m in messages if m is not None]
        rows = sum(m.rows for m in done)
        bad = [m.bad for m in done if m.bad is not None]
        if bad:
            raise ValueError(f"{BAD_RECORD} {json.dumps(min(bad))} END")
        if rows < self.least:
            raise ValueError(f"{NO_ROWS}: {rows} rows, at least {self.least} are asked for")
        fs.create_dir(self.staging, recursive=True)
        with fs.open_output_stream(f"{self.staging}/tasks") as out:
            noted = {"rows": rows, "bytes": sum(m.size for m in done), "folders": [m.folder for m in done if m.rows]}
            out.write(json.dumps(noted).encode())

    def abort(self, messages: list[Written | None]) -> None:
        _drop_staging(self.uri, self.staging)


def _drop_staging(uri: str, staging: str) -> None:
    """Delete a staging folder, and the target if no file is in it."""
    fs, path = filesystem(uri)
    with suppress(FileNotFoundError):
        fs.delete_dir(staging)
    with suppress(OSError):
        if not fs.get_file_info(pafs.FileSelector(path, recursive=True)):
            fs.delete_dir(path)


class FilesSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "chatloom_files"

    def schema(self) -> str:
        return "name string, content binary"

    def writer(self, schema, overwrite: bool) -> FilesWriter:
        return FilesWriter({k.lower(): v for k, v in self.options.items()})


def _listed(fs: pafs.FileSystem, folder: str) -> Iterator[tuple[str, str]]:
    """Staged path and name of a task's files."""
    with fs.open_input_stream(f"{folder}/manifest") as file:
        rest = b""
        while block := file.read(1 << 20):
            *whole, rest = (rest + block).split(b"\n")
            for line in whole:
                staged, name = json.loads(line)
                yield f"{folder}/{staged}", name


def _by_tasks(folders: DataFrame, uri: str, work: Callable[[pafs.FileSystem, str, str], Iterator[tuple]], schema: str) -> DataFrame:
    """What `work` (file system, target, staging folder) gives for the staging folders."""
    names = [f.name for f in T._parse_datatype_string(schema)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = filesystem(uri)
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                rows = work(fs, path, folder)
                while some := list(itertools.islice(rows, 1000)):
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*some, strict=True)], names=names)

    return folders.mapInArrow(run, schema)


def _put_in_place(spark: SparkSession, uri: str, staging: str, overwrite: bool, replace: bool) -> None:
    """Put the files of a staging folder in place, all or none, by tasks.

    Names given twice and names that are there already are looked for before the first file goes. Tasks
    may run again: a file that has gone to its place is left there.
    """
    fs, path = filesystem(uri)
    with fs.open_input_stream(f"{staging}/tasks") as file:
        noted = json.loads(file.read())
    folders = spark.createDataFrame([(f,) for f in noted["folders"]], "folder string")
    aside = f"{path}/_replaced-{staging.rsplit('-', 1)[1]}"

    def looked_at(fs: pafs.FileSystem, path: str, folder: str) -> Iterator[tuple]:
        for _, name in _listed(fs, folder):
            yield name, not (replace or overwrite) and fs.get_file_info(f"{path}/{name}").type != pafs.FileType.NotFound

    def placed(fs: pafs.FileSystem, path: str, folder: str) -> Iterator[tuple]:
        made = None
        for staged, name in _listed(fs, folder):
            target = f"{path}/{name}"
            above = target.rsplit("/", 1)[0]
            if above != made:
                fs.create_dir(above, recursive=True)
                made = above
            try:
                fs.move(staged, target)
            except OSError:
                if _missing(fs, target) or not _missing(fs, staged):
                    raise
            yield (1,)

    def withdrawn(fs: pafs.FileSystem, path: str, folder: str) -> Iterator[tuple]:
        for staged, name in _listed(fs, folder):
            if _missing(fs, staged) and not _missing(fs, f"{path}/{name}"):
                fs.delete_file(f"{path}/{name}")
                yield (1,)

    names = _by_tasks(folders, uri, looked_at, "name string, there boolean")
    clash = names.groupBy("name").agg(F.count("*").alias("n"), F.bool_or("there").alias("there")).where("there or n > 1").take(1)
    if clash and not replace:
        raise ValueError(f"{clash[0]['name']} is there already, or given twice")
    if clash:  # the last one of a name stays
        folders = folders.coalesce(1)
    before = [f.base_name for f in fs.get_file_info(pafs.FileSelector(path)) if f.path != staging] if overwrite else []
    fs.create_dir(aside)
    try:
        for name in before:
            fs.move(f"{path}/{name}", f"{aside}/{name}")
        files = _by_tasks(folders, uri, placed, "files long").agg(F.count("*").alias("files")).first()["files"]
    except Exception:
        _by_tasks(folders, uri, withdrawn, "files long").agg(F.count("*")).collect()
        for name in before:
            with suppress(FileNotFoundError):
                fs.move(f"{aside}/{name}", f"{path}/{name}")
        fs.delete_dir(aside)
        raise
    fs.delete_dir(staging)
    fs.delete_dir(aside)
    with fs.open_output_stream(f"{path}/_SUCCESS") as out:
        out.write(json.dumps({"rows": noted["rows"], "bytes": noted["bytes"], "files": files}).encode())


def _missing(fs: pafs.FileSystem, path: str) -> bool:
    return fs.get_file_info(path).type == pafs.FileType.NotFound


def committed(path: str) -> dict[str, int]:
    """``rows, bytes, files`` of the last commit to a folder."""
    fs, inner = filesystem(path)
    with fs.open_input_stream(f"{inner}/_SUCCESS") as file:
        return json.loads(file.read())


def _there(path: str) -> bool:
    fs, inner = filesystem(path)
    return fs.get_file_info(inner).type != pafs.FileType.NotFound


def _saved(df: DataFrame, path: str, mode: str, replace: bool = False, **options: object) -> dict[str, int]:
    df.sparkSession.dataSource.register(FilesSource)
    if mode in ("error", "errorifexists", "default", "ignore") and _there(path):
        if mode == "ignore":
            return {"rows": 0, "bytes": 0, "files": 0}
        raise DataFormatError(f"{path} already exists")
    job = uuid.uuid4().hex
    staging = f"{filesystem(path)[1]}/_staging-{job}"
    try:
        df.write.format(FilesSource.name()).mode("append").options(job=job, **{k: str(v) for k, v in options.items()}).save(path)
    except PySparkException as failed:
        told = re.search(rf"{BAD_RECORD} (\[.*\]) END", str(failed))
        if told:
            where, number, reason = json.loads(told[1])
            raise DataFormatError(f"{where}, record {number}: {reason}") from None
        if NO_ROWS in str(failed):
            raise DataFormatError(f"Nothing to write to {path}: fewer rows than asked for.") from None
        raise
    try:
        _put_in_place(df.sparkSession, path, staging, mode == "overwrite", replace)
    except Exception:
        _drop_staging(path, staging)
        raise
    return committed(path)


def write_files(files: DataFrame, path: str, mode: str = "errorifexists", replace: bool = False, least: int = 0) -> dict[str, int]:
    """Write each row (name, content) as one file under its name below `path`, all or none.

    Content is binary or text, null is empty. Names are paths below the target (no ``..``, nothing
    hidden); a name given twice, or one that is there already (unless `replace`), fails the job and
    leaves the target as it was. Gives the counts of the commit.
    """
    rows = files.select(F.col("name"), F.col("content").cast("binary").alias("content"))
    return _saved(rows, path, mode, replace, kind="named", least=least)


def write_lines(lines: DataFrame, path: str, mode: str = "errorifexists", least: int = 0, suffix: str = ".txt") -> dict[str, int]:
    """Write the texts of the first column as lines, one file per task, counted in the same pass; with
    fewer rows than `least` the target stays as it was, also where it was to be overwritten.

    With the columns ``source_path, record_no, reason`` behind it, rows that have a reason are errors: the
    first one, by path and number, is raised at the commit, and nothing is written.
    """
    text = F.col(lines.columns[0]).cast("string").alias("value")
    told = [F.col("source_path").cast("string"), F.col("record_no").cast("long"), F.col("reason")] if "reason" in lines.columns else []
    return _saved(lines.select(text, *told), path, mode, kind="lines", least=least, suffix=suffix)
