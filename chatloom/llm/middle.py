"""Fill-in-middle: texts cut into prefix, middle and suffix at token ends.

A text is cut into chunks where a rolling hash of its bytes says so, so that a passage that many
texts share gives the same chunks in all of them. What is known of a chunk (its boundary summary:
code points, word ends inside, what it begins and ends with) is kept by its content. Summaries
combine to token counts up to each chunk; a cut is looked for in the one chunk that holds it.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from chatloom.llm.common import mixed, ready

WINDOW, MASK, SHIFT = 16, 511, 20  # bytes the hash sees; one place in 512 ends a chunk
LEAST, MOST = 64, 8192  # bytes of a chunk that is not the last
BLOCK = 1 << 20  # bytes hashed at once
CACHE_BYTES = 64 << 20  # of chunks kept per task; only speed depends on it
P, S, M = b"<P>", b"<S>", b"<M>"
SPACE = frozenset(b"\t\n\x0b\x0c\r ")
_GEAR = mixed(np.arange(1, 257, dtype=np.uint64)).astype(np.uint32)
_CONTINUES = bytes(range(0x80, 0xC0))
_END = re.compile(rb"[^\x20\x09-\x0D](?=[\x20\x09-\x0D])")
_MARK = re.compile(rb"<[PSM]>")


def rolling(data: bytes) -> np.ndarray:
    """Hash of the last WINDOW bytes at every place, built by doubling its width."""
    h = _GEAR[np.frombuffer(data, np.uint8)]
    width = 1
    while width < WINDOW:
        wide = h.copy()
        wide[width:] += h[:-width] << np.uint32(width)
        h, width = wide, 2 * width
    return h


def chunk_ends(data: bytes) -> list[int]:
    """Places after the last byte of every chunk; they depend on the content nearby alone."""
    ends, last, size = [], 0, len(data)
    for start in range(0, size, BLOCK):
        before = min(start, WINDOW - 1)
        h = rolling(data[start - before : start + BLOCK])[before:]
        cuts = np.flatnonzero((h >> np.uint32(SHIFT)) & np.uint32(MASK) == 0) + (start + 1)
        stop = min(start + BLOCK, size)
        at = 0
        while True:
            at += int(np.searchsorted(cuts[at:], last + LEAST))
            cut = min(int(cuts[at]) if at < len(cuts) else size, last + MOST)
            if cut > stop or cut >= size:
                break
            ends.append(cut)
            last = cut
    if size:
        ends.append(size)
    return ends


class Summary(NamedTuple):
    chars: int  # code points that begin in the chunk
    word_ends: int  # words that end before its last byte
    opens: bool  # begins with white space: a word of the chunk before ends there
    closes: bool  # ends with a byte of a word


def summary(chunk: bytes) -> Summary:
    closes = chunk[-1] not in SPACE
    return Summary(len(chunk.translate(None, _CONTINUES)), len(chunk.split()) - closes, chunk[0] in SPACE, closes)


class Memo:
    """Summaries by content: a chunk found by its hash is compared byte by byte before it counts."""

    def __init__(self, limit: int = CACHE_BYTES) -> None:
        self.known: dict[bytes, Summary] = {}
        self.bytes, self.limit, self.hits = 0, limit, 0

    def __call__(self, chunk: bytes) -> Summary:
        found = self.known.get(chunk)
        if found is not None:
            self.hits += 1
            return found
        if self.bytes > self.limit:
            self.known.clear()
            self.bytes = 0
        self.bytes += len(chunk) + 150
        found = self.known[chunk] = summary(chunk)
        return found


class Counted:
    """A text's tokens `[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+`, by its chunks."""

    def __init__(self, data: bytes, memo: Memo) -> None:
        self.data, self.ends = data, chunk_ends(data)
        self.starts = [0, *self.ends[:-1]]
        self.words, self.at_start = [], []  # words ended up to each chunk's end; whether one ends at its start
        total, open_word = 0, False
        self.chars = []
        for start, end in zip(self.starts, self.ends, strict=False):
            s = memo(data[start:end])
            self.at_start.append(open_word and s.opens)
            total += s.word_ends + (open_word and s.opens)
            self.words.append(total)
            self.chars.append(s.chars)
            open_word = s.closes
        self.n = total + bool(data)  # the last word, or the white space behind it

    def cut(self, tokens: int) -> int:
        """Bytes of the first `tokens` tokens."""
        if tokens <= 0:
            return 0
        if tokens >= self.n:
            return len(self.data)
        k = bisect_left(self.words, tokens)
        left = tokens - (self.words[k - 1] if k else 0)
        if self.at_start[k]:
            if left == 1:
                return self.starts[k]
            left -= 1
        for found in _END.finditer(self.data, self.starts[k], self.ends[k]):
            left -= 1
            if not left:
                return found.end()
        raise AssertionError("a summary does not fit its chunk")

    def chars_to(self, place: int) -> int:
        """Code points in the first `place` bytes."""
        k = bisect_left(self.ends, place)
        rest = self.data[self.starts[k] : place] if place else b""
        return sum(self.chars[:k]) + len(rest.translate(None, _CONTINUES))


def draws(doc_id: int | None, seed: int) -> tuple[int, int, int, int]:
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return tuple(int(digest[i : i + 8], 16) for i in (0, 8, 16, 24))


def transformed(doc_id: int | None, data: bytes, memo: Memo, seed: int, plain: int, spm: int) -> tuple:
    """(n, form, prefix_chars, middle_chars, output) of one text."""
    text = Counted(data, memo)
    h1, h2, h3, h4 = draws(doc_id, seed)
    if not data or h3 % 100 >= 100 - plain or _MARK.search(data):
        return text.n, "plain", None, None, data
    low, high = sorted((h1 % (text.n + 1), h2 % (text.n + 1)))
    a, b = text.cut(low), text.cut(high)
    prefix, middle, suffix = data[:a], data[a:b], data[b:]
    before = text.chars_to(a)
    counts = (before, text.chars_to(b) - before)
    if h4 % 100 < spm:
        return text.n, "spm", *counts, b"".join((S, suffix, P, prefix, M, middle))
    return text.n, "psm", *counts, b"".join((P, prefix, S, suffix, M, middle))


def restored(output: bytes, form: str) -> bytes:
    """The text of an output. Its parts hold no mark, so each mark is found where it was put."""
    if form == "plain":
        return output
    first, second, middle = _MARK.split(output)[1:]
    prefix, suffix = (first, second) if form == "psm" else (second, first)
    return prefix + middle + suffix


def _appended(df: DataFrame, inputs: list[str], new: str, make) -> DataFrame:
    """Append columns; `make()` gives a task's function from lists of the inputs to columns."""
    fields = T._parse_datatype_string(new)
    names = [f.name for f in fields]
    keep = [c for c in df.columns if c not in names]
    kinds = {"bigint": pa.int64(), "string": pa.string()}
    arrow = [kinds[f.dataType.simpleString()] for f in fields]
    at, keep_at = [df.columns.index(c) for c in inputs], [df.columns.index(c) for c in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            # Texts are handled as bytes, valid UTF-8 or not.
            columns = [c.cast(pa.binary()) if pa.types.is_string(c.type) else c for c in (batch.column(i) for i in at)]
            made = work(*(c.to_pylist() for c in columns))
            out = [
                pa.Array.from_buffers(k, len(v), pa.array(v, pa.binary()).buffers()) if k == pa.string() else pa.array(v, k)
                for v, k in zip(made, arrow, strict=True)
            ]
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in keep_at] + out, names=keep + names)

    return df.mapInArrow(run, T.StructType([df.schema[c] for c in keep] + list(fields)))


def fill_in_middle(docs: DataFrame, seed: int = 42, plain: int = 50, spm: int = 80) -> DataFrame:
    """Append n, form, prefix_chars, middle_chars and output to `docs` (doc_id, text, ...).

    `plain` of 100 texts stay as they are, and so do empty ones and those with a mark in them; `spm`
    of 100 others put the suffix first. Cuts are drawn from the doc_id: rows that repeat an id are cut
    alike where their texts are, and a null id draws as an empty one. A null text is empty: n 0, plain,
    output empty. Bytes that are no UTF-8 are kept. Columns of `docs` that bear a new name are replaced.
    A row needs no other row, so nothing is shuffled and an empty table gives no rows.
    """
    ready(docs.sparkSession)

    def make():
        memo = Memo()

        def work(ids, texts):
            rows = [transformed(i, t or b"", memo, seed, plain, spm) for i, t in zip(ids, texts, strict=True)]
            columns = list(zip(*rows, strict=True)) or [()] * 5
            columns[1] = [f.encode() for f in columns[1]]
            return columns

        return work

    new = "n long, form string, prefix_chars long, middle_chars long, output string"
    return _appended(docs, ["doc_id", "text"], new, make)


def unfilled(df: DataFrame) -> DataFrame:
    """Append `restored`, the text rebuilt from `output` and `form` alone."""

    def make():
        return lambda outputs, forms: [[restored(o, f.decode()) for o, f in zip(outputs, forms, strict=True)]]

    return _appended(df, ["output", "form"], "restored string", make)
