"""Scans: line files, JSON records, catalogues, model cards, listings."""

from __future__ import annotations

import re
from collections.abc import Collection
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from chatloom.functions.records import case, items, strict_json
from chatloom.functions.text import INNER_BREAK, PY_SPACE, pystrip
from chatloom.operators import formats
from chatloom.operators.lines import drop_comment_lines, drop_empty_lines, is_comment, is_empty, number_lines
from chatloom.options import DROPMALFORMED, DataFormatError, DataOptions
from chatloom.session import configure
from chatloom.sources import sinks
from chatloom.sources.json_lists import scan_large_json
from chatloom.sources.listing import SCHEME, list_files, local_folder, model_folders, read_files

# Encodings whose files can be cut at LF and CR bytes before decoding.
_LINE_SAFE = {
    "utf-8": None, "utf8": None,
    "ascii": "US-ASCII", "us-ascii": "US-ASCII",
    "latin-1": "ISO-8859-1", "latin1": "ISO-8859-1", "iso-8859-1": "ISO-8859-1",
}
# Encodings Spark can decode only for a whole file.
_WHOLE_FILE = {"utf-16": "UTF-16", "utf-16le": "UTF-16LE", "utf-16be": "UTF-16BE", "utf-32": "UTF-32"}

# A .json file is read as one row up to this size.
WHOLE_BYTES = 8 << 20

# The files a license is looked up in.
CARD_FILES = ("README.md", "LICENSE", "license", "LICENSE.txt", "configuration.json")


def _decoded(raw: Column, encoding: str) -> Column:
    charset = _LINE_SAFE[encoding]
    return raw if charset is None else F.decode(raw.cast("binary"), charset)


def scan_texts(spark: SparkSession, path: str, encoding: str = "utf-8") -> DataFrame:
    """``source_path, text``: one row per file, for formats that a file holds as a whole."""
    name = encoding.strip().lower()
    if name in _LINE_SAFE:
        rows = spark.read.text(path, wholetext=True, recursiveFileLookup=True)
        return rows.select(F.col("_metadata.file_path").alias("source_path"), _decoded(F.col("value"), name).alias("text"))
    if name not in _WHOLE_FILE:
        raise DataFormatError(f"unsupported encoding {encoding!r}")
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return rows.select(F.col("path").alias("source_path"), F.decode("content", _WHOLE_FILE[name]).alias("text"))


def scan_lines(spark: SparkSession, path: str, options: DataOptions = DataOptions(), inner: bool = True) -> DataFrame:
    """``source_path, block_start, line, utf8_ok`` in file order inside each split.

    The line reader cuts at LF, CR and CRLF; with ``inner`` the rarer separators cut too.
    """
    name = options.encoding.strip().lower()
    if name not in _LINE_SAFE:
        raise DataFormatError(f"encoding {options.encoding!r} cannot be read line by line; use scan_texts")
    rows = spark.read.text(path, recursiveFileLookup=True).select(
        F.col("_metadata.file_path").alias("source_path"),
        F.col("_metadata.file_block_start").alias("block_start"),
        F.is_valid_utf8("value").alias("utf8_ok") if _LINE_SAFE[name] is None else F.lit(True).alias("utf8_ok"),
        _decoded(F.col("value"), name).alias("line"),
    )
    return rows.withColumn("line", F.explode(F.split("line", INNER_BREAK))) if inner else rows


def scan_jsonl(spark: SparkSession, path: str, options: DataOptions = DataOptions(), skip: str | None = None) -> DataFrame:
    """``source_path, record_no, raw`` of JSON Lines; blank and comment lines are left out.

    Files whose lower-cased name ends in ``skip`` are not read. A line that is no UTF-8 has a null
    ``raw``, which every converter rejects.
    """
    lines = scan_lines(spark, path, options, inner=False)
    if skip:
        # A predicate on the file path alone: the files are dropped when the scan is planned.
        lines = lines.filter(~F.endswith(F.lower("source_path"), F.lit(skip)))
    content = drop_comment_lines(drop_empty_lines(lines, options), options)
    raw = F.when(F.col("utf8_ok"), pystrip(F.col("line"))).alias("raw")
    return number_lines(content, "record_no").select("source_path", "record_no", raw)


def scan_records(spark: SparkSession, path: str, options: DataOptions = DataOptions()) -> DataFrame:
    """``source_path, record_no, record`` (variant) of ``.json`` and JSON Lines files.

    A ``.json`` file that opens with a bracket is one JSON value; a list gives many records. Up to
    WHOLE_BYTES such a file is read as one row, and above it is cut at its records by as many tasks as it
    has splits, with the same rows. Where the bytes are no UTF-8 (of a ``.json`` file, or of a line) the
    record is null, a reject.
    """
    names = "*.[jJ][sS][oO][nN]"
    files = spark.read.text(path, wholetext=True, pathGlobFilter=names, recursiveFileLookup=True)
    texts = files.where(F.col("_metadata.file_size") <= WHOLE_BYTES).select(
        F.col("_metadata.file_path").alias("source_path"),
        pystrip(F.regexp_replace("value", "^\ufeff", "")).alias("text"),  # the line reader drops the mark too
        F.is_valid_utf8("value").alias("_ok"),
    )
    single = F.col("text").rlike(r"^[\[{]")
    keep = F.filter(F.split("text", "\r\n|[\n\r]"), lambda x: ~(is_empty(x, options) | is_comment(x, options)))
    staged = texts.select(
        "source_path",
        "_ok",
        single.alias("_single"),
        F.when(single, F.expr(strict_json("text"))).alias("_v"),
        F.when(~single, F.transform(keep, pystrip)).alias("_lines"),
    )
    # A list yields its elements, anything else itself; a .json file of lines yields its lines.
    by_line = f"transform(_lines, x -> {strict_json('x')})"
    found = F.expr(case(("_single", f"coalesce({items('_v')}, array(_v))"), otherwise=by_line))
    whole = staged.select("source_path", "_ok", F.posexplode(found).alias("record_no", "record"))
    whole = whole.withColumn("record", F.when(F.col("_ok"), F.col("record")))
    lined = scan_jsonl(spark, path, options, skip=".json")
    found = whole.select("source_path", F.col("record_no").cast("bigint").alias("record_no"), "record").unionByName(
        lined.select("source_path", "record_no", F.expr(strict_json("raw")).alias("record"))
    )
    sized = spark.read.format("binaryFile").option("pathGlobFilter", names).option("recursiveFileLookup", "true").load(path)
    if sized.where(F.col("length") > WHOLE_BYTES).isEmpty():
        return found
    return found.unionByName(scan_large_json(spark, path, WHOLE_BYTES, options))


def scan_catalog(
    df: DataFrame, split: str | None = None, split_column: str = "split", probed: Collection[str] | None = None
) -> DataFrame:
    """Rows of a landed dataset as variant records; ``split`` prunes partitions.

    With ``probed`` only these columns are packed into the records, and so only they are read.
    """
    rows = df
    if split_column in df.columns:
        rows = (df.filter(F.col(split_column) == split) if split is not None else df).drop(split_column)
    keys = [c for c in ("sample_id", "source_path", "record_no") if c in rows.columns]
    fields = [c for c in rows.columns if c not in keys and (probed is None or c in probed)]
    packed = F.to_variant_object(F.struct(*fields)) if fields else F.parse_json(F.lit("{}"))
    return rows.select(*keys, packed.alias("record"))


def looks_like_hub_id(value: str) -> bool:
    """``owner/name``, and neither a relative, absolute nor Windows path."""
    text = value.strip(PY_SPACE)
    return bool(text) and "/" in text and not text.startswith((".", "/")) and "\\" not in text


class Corpus(NamedTuple):
    """A source that was found: its converted records, how they are checked, and its catalogue rows where
    it has any."""

    name: str
    converted: DataFrame
    validation: str
    rows: DataFrame | None


def find_corpus(
    spark: SparkSession,
    spec: str,
    data_format: str,
    options: DataOptions | None = None,
    source: str = "auto",
    split: str = "train",
    catalog_root: str | None = None,
    mode: str = DROPMALFORMED,
) -> Corpus:
    """A corpus that nothing was read of yet: an existing path is parsed by its declared format;
    otherwise an id ``owner/name`` means landed catalogue rows, with the layout detected per row."""
    configure(spark)
    options = options or DataOptions()
    raw = spec.strip(PY_SPACE)
    try:
        spark.read.text(raw)
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
    else:
        scan = scan_lines if data_format.strip().lower() in formats.LINE_FORMATS else scan_records
        converted = formats.convert(scan(spark, raw, options), data_format, options)
        stem = re.sub(r"(?<=.)\.[^.]*$", "", raw.rstrip("/").rsplit("/", 1)[-1])
        return Corpus(stem, converted, mode, None)
    if source == "local" or not looks_like_hub_id(raw):
        raise DataFormatError(f"Training data not found: {raw}")
    if source not in ("auto", "hf", "modelscope"):
        raise DataFormatError(f"Unknown data source {source!r}.")
    if catalog_root is None:
        raise DataFormatError(f"No landed rows for {raw}: catalog_root is not set")
    landed = spark.read.parquet(f"{catalog_root.rstrip('/')}/{raw}")
    plain = landed.filter(F.col("split") == split).drop("split") if "split" in landed.columns else landed
    # A row is known by its file and its place there, however files are cut into tasks.
    if "record_no" not in landed.columns:
        landed = landed.withColumn("record_no", F.col("_metadata.row_index"))
    if "source_path" not in landed.columns:
        landed = landed.withColumn("source_path", F.concat(F.lit(raw + "/"), F.col("_metadata.file_name")))
    rows = scan_catalog(landed, split, probed=formats.catalog_columns(options))
    # Bad catalogue rows are passed over in every mode.
    return Corpus(raw.replace("/", "__"), formats.from_catalog(rows, options), DROPMALFORMED, plain)


def load_corpus(spark: SparkSession, spec: str, data_format: str, *args: object, **how: object) -> DataFrame:
    """Samples of a corpus (see find_corpus); one that yields no sample is refused. ``materialise`` does so
    without reading ahead."""
    corpus = find_corpus(spark, spec, data_format, *args, **how)
    return formats.require_samples(formats.samples(corpus.converted, corpus.validation), spec.strip(PY_SPACE))


class Materialised(NamedTuple):
    processed: str
    raw: str | None
    samples: int


def materialise(
    spark: SparkSession, spec: str, data_format: str, folder: str, *args: object, write_mode: str = "overwrite", **how: object
) -> Materialised:
    """Find a corpus (see find_corpus), write its samples to ``folder/processed/NAME.jsonl`` and archive
    its catalogue rows, if it has any, in ``folder/raw/NAME.jsonl``.

    The source is converted once: samples are counted as they are written, and a corpus without one, or
    with ``mode="FAILFAST"`` one with a bad record, is refused at the commit, before anything is archived;
    what stood there then stays.
    """
    corpus = find_corpus(spark, spec, data_format, *args, **how)
    base = folder.rstrip("/")
    path = f"{base}/processed/{corpus.name}.jsonl"
    counts = sinks.write_converted(corpus.converted, path, corpus.validation, write_mode)
    raw = None if corpus.rows is None else sinks.write_raw(corpus.rows, f"{base}/raw", corpus.name, write_mode)
    return Materialised(path, raw, counts["rows"])


def _below(root: str, depth: int) -> tuple[Column, Column]:
    """``model_id, path`` of the file in column ``path``: the first ``depth`` folders below the root
    name the model, the rest is the path in it. Both are null outside the root and above the models.

    The root is cut off as a prefix, without scheme and host, which Spark may write in other ways.
    """
    bare = re.sub(SCHEME, "", root).rstrip("/") + "/"
    if not bare.startswith("/"):
        raise DataFormatError(f"root must be an absolute path: {root}")
    if depth < 1:
        raise DataFormatError("depth must be 1 or more")
    path = F.regexp_replace("path", SCHEME, "")
    parts = F.split(F.when(F.startswith(path, F.lit(bare)), F.substr(path, F.lit(len(bare) + 1))), "/")
    deep = F.when(F.size(parts) > depth, parts)
    model = F.array_join(F.slice(deep, 1, depth), "/")
    return model, F.array_join(F.slice(deep, depth + 1, F.greatest(F.size(deep), F.lit(1))), "/")


def scan_model_cards(spark: SparkSession, root: str, depth: int = 1) -> DataFrame:
    """``model_id, file, text`` of the card files in the model folders, which lie ``depth`` folders
    below an absolute root; deeper files are no cards. Bad bytes become U+FFFD. Tasks list a local or
    mounted root; one of another file system is listed on the driver, which then holds every file's status."""
    bare = local_folder(spark, root)
    if bare is not None and depth >= 1:
        files = read_files(model_folders(spark, bare, depth), CARD_FILES)
    else:  # listed on the driver
        files = (
            spark.read.format("binaryFile")
            .option("pathGlobFilter", "{" + ",".join(CARD_FILES) + "}")
            .option("recursiveFileLookup", "true")
            .load(root)
        )
    return card_rows(files, root, depth)


def card_rows(files: DataFrame, root: str, depth: int = 1) -> DataFrame:
    """Card rows of binary files (``path, content``)."""
    model, file = _below(root, depth)
    found = files.select(model.alias("model_id"), file.alias("file"), "content")
    return found.filter(F.col("file").isin(*CARD_FILES)).select(
        "model_id", "file", F.make_valid_utf8(F.col("content").cast("string")).alias("text")
    )


def scan_listing(spark: SparkSession, root: str, depth: int = 1) -> DataFrame:
    """``model_id, path, size, mtime`` of the files in model folders, named as by scan_model_cards;
    contents are not read. Tasks list a local or mounted root."""
    bare = local_folder(spark, root)
    if bare is not None and depth >= 1:
        files = list_files(model_folders(spark, bare, depth))
    else:  # listed on the driver
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return listing_rows(files, root, depth)


def listing_rows(files: DataFrame, root: str, depth: int = 1) -> DataFrame:
    """Listing rows of ``path, length, modificationTime``."""
    model, inner = _below(root, depth)
    return files.select(
        model.alias("model_id"),
        inner.alias("path"),
        F.col("length").alias("size"),
        F.col("modificationTime").alias("mtime"),
    ).filter("model_id is not null")
