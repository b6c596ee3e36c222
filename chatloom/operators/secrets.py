"""Redaction by a table of secrets.

A secret is known by its anchor, its last 1, 2, 4, ... or 64 bytes (tokens tend to share their
beginnings). Lines are scanned once with a rolling hash per anchor size; a bit filter of bounded size
drops nearly all places. What is left is compared with the secrets: in the same task while the table is
small enough to be sent there, by a join on the anchors beyond that.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chatloom.operators.governance import MASK
from chatloom.session import landed

# Secrets are sent to the tasks themselves up to this many bytes.
SECRET_BYTES = 8 << 20
# Bits of the filter for each secret, and at most (32 MB): beyond, more places are joined, with the same result.
BITS_EACH, MOST_BITS = 16, 28
LONGEST_ANCHOR = 64
BLOCK = 4 << 20  # bytes scanned at once
_PROBES = 4


def _mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (the finisher of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BASE = 0x9E3779B97F4A7C15
_BYTE = _mixed(np.arange(1, 257, dtype=np.uint64))


def anchors(data: np.ndarray, most: int = LONGEST_ANCHOR) -> Iterator[tuple[int, np.ndarray]]:
    """(size, hashes of all windows of that size) for the sizes 1, 2, 4, ...; each from the one before."""
    h, size = _BYTE[data], 1
    while len(h):
        yield size, _mixed(h + np.uint64(size))
        if size == most:
            return
        h = h[:-size] * np.uint64(pow(_BASE, size, 1 << 64)) + h[size:]
        size *= 2


def anchor_size(length: int) -> int:
    return min(LONGEST_ANCHOR, 1 << (length.bit_length() - 1))


def _bit(keys: np.ndarray, width: int, probe: int) -> np.ndarray:
    """Places of keys in a filter of 2^width bits, for one of its probes."""
    step = keys >> np.uint64(32) | np.uint64(1)
    return ((keys + np.uint64(probe) * step) & np.uint64((1 << width) - 1)).astype(np.int64)


class Filter:
    """Which anchors may be a secret's: `sizes` that occur and a bit table of 2^width bits."""

    def __init__(self, sizes: list[int], table: np.ndarray) -> None:
        self.sizes, self.table = frozenset(sizes), table
        self.width = (len(table) * 8).bit_length() - 1

    def hits(self, data: np.ndarray, starts: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(size, places, lines, keys) of windows of `data` that pass; line i is `starts[i]` to `starts[i + 1]`."""
        if not self.sizes:
            return
        most = max(self.sizes)
        for begin in range(0, len(data), BLOCK):
            for size, keys in anchors(data[begin : begin + BLOCK + most - 1], most):
                if size not in self.sizes:
                    continue
                at = np.arange(min(len(keys), BLOCK))
                for probe in range(_PROBES):
                    bit = _bit(keys[at], self.width, probe)
                    at = at[(self.table[bit >> 3] >> (bit & 7)) & 1 == 1]
                found = at + begin
                line = np.searchsorted(starts, found, "right") - 1
                inside = found + size <= starts[line + 1]
                yield size, found[inside], line[inside], keys[at[inside]]


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a column of texts and where each begins; a null is empty."""
    column = column.cast(pa.large_binary())
    starts = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[starts[0] : starts[-1]], starts - starts[0]


def _keyed(secrets: DataFrame) -> DataFrame:
    """(secret, size, key) of the distinct non-empty secrets of one column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(0).cast(pa.binary()).to_pylist()
            sizes = [anchor_size(len(s)) for s in rows]
            keys = [int(list(anchors(np.frombuffer(s[-n:], np.uint8), n))[-1][1][0]) for s, n in zip(rows, sizes, strict=True)]
            signed = np.array(keys, np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary()), pa.array(sizes, pa.int32()), pa.array(signed)], names=["secret", "size", "key"])

    found = secrets.select(F.col(secrets.columns[0]).cast("binary").alias("secret")).where("octet_length(secret) > 0").distinct()
    return landed(found.mapInArrow(run, "secret binary, size int, key long"), "secrets")


def _filter(keyed: DataFrame, many: int) -> Filter:
    """The filter of a table of secrets: bits are set per task and per 4 KB of the filter, which come back."""
    width = max(15, min(MOST_BITS, (BITS_EACH * max(1, many) - 1).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = np.asarray(batch.column(0)).view(np.uint64)
            bits = np.concatenate([_bit(keys, width, probe) for probe in range(_PROBES)])
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(bits) + 1)], names=["bit"])

    parts = keyed.select("key").mapInArrow(run, "bit long").groupBy(F.bitmap_bucket_number("bit").alias("part"))
    table = np.zeros((1 << width) // 8, np.uint8)
    for r in parts.agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits")).collect():
        table[(r.part - 1) * 4096 : r.part * 4096] = np.frombuffer(r.bits, np.uint8)
    return Filter([r.size for r in keyed.select("size").distinct().collect()], table)


def masked(line: bytes, found: list[tuple[int, int]], mask: bytes) -> bytes:
    """The line with the found (start, length) covered, from left to right, the longest first."""
    out, end = [], 0
    for start, length in sorted(found, key=lambda x: (x[0], -x[1])):
        if start >= end:
            out += [line[end:start], mask]
            end = start + length
    return b"".join([*out, line[end:]])


def _mapped(df: DataFrame, text: str, schema: T.StructType, fn: Callable[[pa.RecordBatch, pa.Array], list[pa.Array]]) -> DataFrame:
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays(fn(batch, batch.column(at)), names=schema.names)

    return df.mapInArrow(run, schema)


def _strings(values: list[bytes | None]) -> pa.Array:
    """Bytes as a string column, valid UTF-8 or not."""
    plain = pa.array(values, pa.binary())
    return pa.Array.from_buffers(pa.string(), len(plain), plain.buffers())


def _in_tasks(lines: DataFrame, text: str, secrets: list[tuple[bytes, int, int]], sieve: Filter, mask: bytes) -> DataFrame:
    by_anchor: dict[tuple[int, int], list[bytes]] = {}
    for secret, size, key in secrets:
        by_anchor.setdefault((size, key), []).append(secret)
    at = lines.columns.index(text)

    def run(batch: pa.RecordBatch, column: pa.Array) -> list[pa.Array]:
        data, starts = _flat(column)
        found: dict[int, list[tuple[int, int]]] = {}
        for size, places, owners, keys in sieve.hits(data, starts):
            for place, line, key in zip(places.tolist(), owners.tolist(), keys.view(np.int64).tolist(), strict=True):
                for secret in by_anchor.get((size, key), ()):
                    start = place + size - len(secret)
                    if start >= starts[line] and data[start : place + size].tobytes() == secret:
                        found.setdefault(line, []).append((start - int(starts[line]), len(secret)))
        if not found:
            return batch.columns
        rows = column.cast(pa.binary()).to_pylist()
        for line, spots in found.items():
            rows[line] = masked(rows[line], spots, mask)
        return [_strings(rows) if i == at else c for i, c in enumerate(batch.columns)]

    return _mapped(lines, text, lines.schema, run)


def _by_join(lines: DataFrame, text: str, keyed: DataFrame, sieve: Filter, mask: bytes) -> DataFrame:
    """Only lines with a place that passes the filter are landed with those places; the places meet the
    secrets by anchor, and what they meet goes back to the line, which is compared and cut there."""
    whole = lines.select(F.struct(*lines.columns).alias("row"), F.col(text).alias("text"))
    spot = "array<struct<end:int,size:int,key:bigint>>"
    schema = T.StructType([*whole.schema, T.StructField("spots", T._parse_datatype_string(spot))])

    def mark(batch: pa.RecordBatch, column: pa.Array) -> list[pa.Array]:
        data, starts = _flat(column)
        spots: list[list[dict]] = [[] for _ in range(len(column))]
        for size, places, owners, keys in sieve.hits(data, starts):
            ends = places + size - starts[owners]
            for line, end, key in zip(owners.tolist(), ends.tolist(), keys.view(np.int64).tolist(), strict=True):
                spots[line].append({"end": end, "size": size, "key": key})
        kind = pa.list_(pa.struct([("end", pa.int32()), ("size", pa.int32()), ("key", pa.int64())]))
        return [*batch.columns, pa.array(spots, kind)]

    marked = landed(_mapped(whole, "text", schema, mark), "marked")
    meta = marked.metadataColumn("_metadata")
    placed = marked.select("*", F.struct(meta["file_name"].alias("f"), meta["row_index"].alias("r")).alias("line"))
    some = placed.where(F.size("spots") > 0)
    met = landed(
        some.select("line", F.explode("spots").alias("s"))
        .select("line", "s.end", "s.size", "s.key")
        .join(keyed, ["size", "key"])
        .select("line", F.struct("end", "secret").alias("hit")),
        "met",
    )
    hits = met.groupBy("line").agg(F.collect_list("hit").alias("hits"))
    joined = some.join(hits, "line").select("row", "text", "hits")

    def cover(batch: pa.RecordBatch, column: pa.Array) -> list[pa.Array]:
        rows = column.cast(pa.binary()).to_pylist()
        for i, hits in enumerate(batch.column(2).to_pylist()):
            line = rows[i]
            spots = [(h["end"] - len(h["secret"]), len(h["secret"])) for h in hits if line.endswith(h["secret"], 0, h["end"])]
            rows[i] = masked(line, spots, mask)
        return [batch.column(0), _strings(rows)]

    covered = _mapped(joined, "text", T.StructType(joined.schema.fields[:2]), cover)
    left = placed.where(F.size("spots") == 0).select("row", "text").union(some.join(hits, "line", "left_anti").select("row", "text"))
    return left.union(covered).select(*(F.col("text").alias(c) if c == text else F.col("row")[c].alias(c) for c in lines.columns))


def redact_table(
    lines: DataFrame, secrets: DataFrame, text: str = "line", mask: str = MASK, secret_bytes: int = SECRET_BYTES
) -> DataFrame:
    """`lines` with every occurrence of a secret (the first column of `secrets`) in the column `text`
    covered by the mask: from left to right, where several begin the longest, as ``redact_literal`` does.

    Null and empty secrets count for nothing, repeated ones once; a null text stays null. The table of
    secrets is read once; up to `secret_bytes` it is sent to the tasks, beyond it is joined.
    """
    keyed = _keyed(secrets)
    size = keyed.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("secret")), F.lit(0)).alias("bytes")).first()
    if not size["n"]:
        return lines
    sieve = _filter(keyed, size["n"])
    if size["bytes"] + 64 * size["n"] <= secret_bytes:
        return _in_tasks(lines, text, [(bytes(r.secret), r.size, r.key) for r in keyed.collect()], sieve, mask.encode())
    return _by_join(lines, text, keyed, sieve, mask.encode())
