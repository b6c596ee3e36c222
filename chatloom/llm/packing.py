"""Best-fit packing of documents into sequences after Martello-Toth dominance reduction."""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chatloom.llm.common import landed, with_arrow

CAPACITY = 2048
# Words whose ids a worker remembers; others are tokenized anew.
REMEMBERED = 400_000
# White space that is neither a space nor a line feed, and the places of spaces where words don't part plainly.
_ODD = "".join(rf"\x{{{c:x}}}" for c in range(0x3001) if chr(c).isspace() and chr(c) not in " \n")
_NOT_PLAIN = rf"^ | $|  | \n|\n |[{_ODD}]"


class WordTokens:
    """Ids of texts by a byte-level BPE tokenizer that cuts before a space between other characters.

    Such a tokenizer never merges over those spaces, so a text's ids are those of its words in turn,
    each with the space before it. Words come again and again; their ids are remembered, and a batch
    looks up each of its words once.
    """

    def __init__(self, path: str, special: bool = False) -> None:
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.encode_special_tokens = not special
        # Strings in a text that the tokenizer takes as one token of its own, with no regard to spaces.
        added = self.model.get_added_tokens_decoder().values()
        self.special = [token.content for token in added if special or not token.special]
        # The place of each remembered word in `sizes`, its number of ids, which stand in this order in `ids`.
        self.known: dict[bytes, int] = {}
        self.sizes, self.ids = np.zeros(0, np.int64), np.zeros(0, "<u4")
        vocabulary = self.model.get_vocab()
        self.opens = np.zeros(max(vocabulary.values()) + 1, bool)
        for token, number in vocabulary.items():
            self.opens[number] = token.startswith("Ġ")

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.model.encode(text, add_special_tokens=False).ids, "<u4")

    def batch(self, texts: list[str] | pa.Array) -> list[bytes]:
        """Ids of each text as little-endian 32-bit numbers; null: none."""
        column = pc.fill_null(pa.array(texts, pa.large_string()) if isinstance(texts, list) else texts.cast(pa.large_string()), "")
        plain = pc.invert(pc.match_substring_regex(column, _NOT_PLAIN))
        for string in self.special:
            plain = pc.and_not(plain, pc.match_substring(column, string))
        plain = pc.and_(plain, pc.greater(pc.binary_length(column), 0))
        parted = iter(self._parted(column.filter(plain)))
        out = []
        for at, known in enumerate(plain.to_pylist()):
            out.append(next(parted) if known else self.whole(column[at].as_py()).tobytes())
        return out

    def _parted(self, column: pa.LargeStringArray) -> Iterator[bytes]:
        """Ids of texts that are no empty ones, by their words."""
        if not len(column):
            return
        bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        text = column.buffers()[2]
        opens = np.frombuffer(text, np.uint8)[bounds[0] : bounds[-1]] == 32
        opens[bounds[:-1] - bounds[0]] = True
        edges = np.append(np.flatnonzero(opens) + bounds[0], bounds[-1])
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(edges) - 1, [None, pa.py_buffer(edges), text])
        coded = words.dictionary_encode()
        places, sizes, ids = self._looked_up(coded.dictionary.to_pylist())
        places = places[coded.indices.to_numpy()]
        length = sizes[places]
        until = np.append(0, np.cumsum(length))
        first = np.cumsum(sizes) - sizes
        found = ids[np.repeat(first[places] - until[:-1], length) + np.arange(until[-1])]
        cuts = until[np.searchsorted(edges, bounds)].tolist()
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield found[a:b].tobytes()

    def _looked_up(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Place of each word in the sizes, the sizes, and the ids; new words are remembered while there is room."""
        places = np.array([-1 if p is None else p for p in map(self.known.get, words)], np.int64)
        at = np.flatnonzero(places < 0)
        if not len(at):
            return places, self.sizes, self.ids
        # Words behind a space can go together as one text, those that open a text only one by one.
        behind = np.array([words[i][0] == 32 for i in at.tolist()])
        at = np.append(at[behind], at[~behind])
        new = [words[i] for i in at.tolist()]
        places[at] = np.arange(len(self.sizes), len(self.sizes) + len(new))
        found = [(self.sizes, self.ids), *self._words(new[: behind.sum()]), self._each(new[behind.sum() :])]
        sizes, ids = (np.concatenate(some) for some in zip(*found, strict=True))
        if len(self.known) < REMEMBERED:
            self.known.update(zip(new, places[at].tolist(), strict=True))
            self.sizes, self.ids = sizes, ids
        return places, sizes, ids

    def _each(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of ids, and the ids, of words as texts of their own."""
        ids = [self.whole(w.decode()) for w in words]
        return np.fromiter(map(len, ids), np.int64, len(ids)), np.concatenate([np.zeros(0, "<u4"), *ids])

    def _words(self, words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The same of words with a space before each: all in one text, parted at the spaces again."""
        for start in range(0, len(words), 50_000):
            some = words[start : start + 50_000]
            ids = np.array(self.model.encode_batch_fast([b"".join(some).decode()], add_special_tokens=False)[0].ids, "<u4")
            sizes = np.diff(np.flatnonzero(self.opens[ids]), append=len(ids))
            yield (sizes, ids) if len(sizes) == len(some) else self._each(some)


_models: dict[tuple[str, bool], WordTokens] = {}


def _model(path: str, special: bool) -> WordTokens:
    if (path, special) not in _models:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _models[path, special] = WordTokens(path, special)
    return _models[path, special]


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, special: bool = False) -> DataFrame:
    """The pieces of every row of `docs`, with `part` and `place`: the how-manieth of its length in its task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, model = TaskContext.get().partitionId(), _model(tokenizer, special)
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, ids in zip(batch.column(0).to_pylist(), model.batch(batch.column(1)), strict=True):
                ids += b"\0\0\0\0"
                total = len(ids) // 4
                start, length = 0, total % capacity or capacity
                piece = 0
                while start < total:
                    crc = zlib.crc32(ids[4 * start : 4 * (start + length)])
                    rows.append((doc_id, piece, start, length, crc, part, int(seen[length])))
                    seen[length] += 1
                    start, length, piece = start + length, capacity, piece + 1
            columns = list(zip(*rows, strict=True)) or [[]] * 7
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "place"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, place long"
    return docs.select("doc_id", F.make_valid_utf8("text").alias("text")).mapInArrow(run, schema)


def dominance(counts: np.ndarray, capacity: int) -> list[tuple[list[tuple[int, int]], int]]:
    """Permanently fix sets that dominate every other set with their largest item.

    `counts[s]` items of size s; reduced in place. From the largest item a on, with room r beside it:
    nothing fits: a alone; an item of exactly r: the two, since whatever else fits beside a fits
    into that item's place; at most one item fits: a with the largest that does.
    """
    fixed: list[tuple[list[tuple[int, int]], int]] = []

    def fix(a: int, b: int | None, many: int) -> None:
        counts[a] -= many
        if b is None:
            fixed.append(([(a, 1)], many))
        elif a == b:
            counts[a] -= many
            fixed.append(([(a, 2)], many))
        else:
            counts[b] -= many
            fixed.append(([(a, 1), (b, 1)], many))

    for a in range(capacity, 0, -1):
        while counts[a] > 0:
            room = capacity - a
            counts[a] -= 1  # the item itself is no partner
            sizes = np.flatnonzero(counts[: room + 1])
            least, again = (int(sizes[0]), int(counts[sizes[0]])) if len(sizes) else (0, 0)
            counts[a] += 1
            if not len(sizes):
                fix(a, None, int(counts[a]))
                continue
            second = least if again > 1 else (int(sizes[1]) if len(sizes) > 1 else capacity + 1)
            partner = int(sizes[-1])
            if partner != room and least + second <= room:
                break
            many = int(counts[a]) // 2 if partner == a else int(min(counts[a], counts[partner]))
            fix(a, partner, many)
    return fixed


def best_fit(counts: np.ndarray, capacity: int) -> list[tuple[list[tuple[int, int]], int]]:
    """Best fit of all items, largest first; equal bins are one group with a number."""
    rooms: dict[int, list[tuple[list[tuple[int, int]], int]]] = {}
    for size in range(capacity, 0, -1):
        left = int(counts[size])
        counts[size] = 0
        for room in sorted(r for r in rooms if r >= size) if left else ():
            each = room // size
            for pattern, many in rooms.pop(room):
                full = min(many, left // each)
                rest = left - full * each if full < many and left - full * each < each else 0
                if full:
                    rooms.setdefault(room - each * size, []).append((pattern + [(size, each)], full))
                if rest:
                    rooms.setdefault(room - rest * size, []).append((pattern + [(size, rest)], 1))
                same = many - full - (1 if rest else 0)
                if same:
                    rooms.setdefault(room, []).append((pattern, same))
                left -= full * each + rest
        if left:
            each = capacity // size
            full, rest = divmod(left, each)
            if full:
                rooms.setdefault(capacity - each * size, []).append(([(size, each)], full))
            if rest:
                rooms.setdefault(capacity - rest * size, []).append(([(size, rest)], 1))
    return [group for groups in rooms.values() for group in groups]


def plan_runs(counts: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """Where the k-th item of each size goes: rows (size, first k, first sequence, items a sequence, offset).

    The plan knows sizes and numbers only, so it has at most a few groups of equal sequences per
    size, however many documents there are.
    """
    counts = counts.copy()
    groups = dominance(counts, capacity) + best_fit(counts, capacity)
    runs, following, sequence = [], np.zeros(capacity + 1, np.int64), 0
    for pattern, many in groups:
        offset = 0
        for size, each in pattern:
            runs.append((size, int(following[size]), sequence, each, offset))
            following[size] += many * each
            offset += size * each
        sequence += many
    return np.array(sorted(runs), np.int64).reshape(-1, 5)


def packed(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, special: bool = False) -> DataFrame:
    """Pieces of every row of `docs` (columns doc_id, text) with sequence_id and offset.

    With `special` the strings of the tokenizer's special tokens in a text become those tokens, as a
    plain call of it makes them; without, they are ordinary text, so that no text can fake an end.

    Only the histogram of piece lengths, at most `capacity` numbers, reaches the driver, which plans
    groups of equal sequences from it; every piece then finds its place from its rank among the
    pieces of its length. Ranks come from counts per task, so no length, however frequent, meets in
    one task.

    Null or empty text: one piece that holds the end id. Bytes that are no UTF-8 become U+FFFD. A null doc_id is carried. Repeated rows are
    documents of their own. An empty table gives an empty result. Other columns are not read.
    """
    pieces = landed(token_pieces(docs, tokenizer, capacity, special), "pieces")
    counts = landed(pieces.groupBy("length", "part").agg(F.count("*").alias("n")), "lengths")
    histogram = np.zeros(capacity + 1, np.int64)
    for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():
        histogram[r.length] = r.n
    runs = plan_runs(histogram, capacity)
    sent = docs.sparkSession.sparkContext.broadcast((runs[:, 0] << 40 | runs[:, 1], runs))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("length", "part", F.coalesce(before, F.lit(0)).alias("before"))
    ranked = pieces.join(offsets, ["length", "part"]).withColumn("rank", F.col("before") + F.col("place"))

    def place(lengths: list, ranks: list) -> tuple:
        keys, table = sent.value
        size, rank = np.array(lengths, np.int64), np.array(ranks, np.int64)
        run = table[np.searchsorted(keys, size << 40 | rank, side="right") - 1]
        nth = rank - run[:, 1]
        return run[:, 2] + nth // run[:, 3], run[:, 4] + nth % run[:, 3] * size

    return with_arrow(ranked, ["length", "rank"], "sequence_id long, offset long", place).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )
