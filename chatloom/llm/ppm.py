"""Language-model scoring by prediction by partial matching over bytes."""

from __future__ import annotations

from collections.abc import Iterator
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatloom.llm.common import landed, word_hashes

ORDER = 5  # bytes of the longest context
# Bounds of what is sent to workers: bytes with their context, and words, those met most often.
# The model holds all of them: what is not sent meets its value in a join.
GRAMS, WORDS = 1 << 21, 1 << 17
# Bytes that UTF-8 never has: before a text, and after it.
PAD, END = 0xFE, 0xFF
_PADDING = bytes([PAD]) * ORDER
_CHUNK = 1 << 20
_FLUSH = 1 << 21


def _keys(data: np.ndarray) -> np.ndarray:
    """Each byte from the ORDER-th on together with the ORDER before it, as one number."""
    out = np.zeros(max(0, len(data) - ORDER), np.uint64)
    for i in range(ORDER + 1):
        out = out << np.uint64(8) | data[i : len(data) - ORDER + i]
    return out


def _segments(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Padded texts joined to arrays of about _CHUNK bytes, with the number of the text of each byte
    from the ORDER-th on (-1: padding). Long texts are cut with an overlap of ORDER bytes."""
    joined, owners, size = [], [], 0
    for n, text in enumerate(texts):
        whole = np.frombuffer(_PADDING + text + bytes([END]), np.uint8)
        for start in range(0, len(whole) - ORDER, _CHUNK):
            part = whole[start : start + _CHUNK + ORDER]
            joined.append(part)
            owners.append(np.concatenate([np.full(ORDER, -1), np.full(len(part) - ORDER, n)]))
            size += len(part)
            if size > _CHUNK:
                yield np.concatenate(joined), np.concatenate(owners)[ORDER:]
                joined, owners, size = [], [], 0
    if joined:
        yield np.concatenate(joined), np.concatenate(owners)[ORDER:]


def _lower(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").lower()


class _Tally:
    """Counts of 64-bit keys, kept sorted; what grows too large is given out."""

    def __init__(self) -> None:
        self.new: list[np.ndarray] = []
        self.fresh = 0
        self.keys, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def add(self, keys: np.ndarray) -> None:
        self.new.append(keys)
        self.fresh += len(keys)

    def settle(self) -> None:
        if not self.fresh:
            return
        keys, counts = np.unique(np.concatenate(self.new), return_counts=True)
        self.new, self.fresh = [], 0
        every = np.concatenate([self.keys, keys])
        order = np.argsort(every, kind="stable")
        every, all_counts = every[order], np.concatenate([self.counts, counts])[order]
        starts = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]])) if len(every) else np.zeros(0, int)
        self.keys, self.counts = every[starts], np.add.reduceat(all_counts, starts) if len(starts) else all_counts


def corpus_counts(docs: DataFrame) -> DataFrame:
    """(kind, key, n) of `docs` with text and held_out: of the rows trained on, kind 0 word hashes,
    1 bytes with their context, 2 documents; of the rows held out, 3 bytes with their context.

    Every task sums what it reads before the shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tallies, texts = {0: _Tally(), 1: _Tally(), 3: _Tally()}, 0

        def out(kind: int, keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(keys), kind, np.int32)), pa.array(keys.view(np.int64)), pa.array(counts)],
                names=["kind", "key", "n"],
            )

        for batch in batches:
            parts: dict[int, list[bytes]] = {1: [], 3: []}
            for text, held in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                parts[3 if held else 1].append(_lower(text))
                if not held:
                    texts += 1
                    tallies[0].add(word_hashes(text))
            for kind, part in parts.items():
                for data, owner in _segments(part):
                    tallies[kind].add(_keys(data)[owner >= 0])
            for kind, tally in tallies.items():
                if tally.fresh > 4 * _FLUSH:
                    tally.settle()
                if len(tally.keys) > _FLUSH:
                    yield out(kind, tally.keys, tally.counts)
                    tally.keys, tally.counts = tally.keys[:0], tally.counts[:0]
        for kind, tally in tallies.items():
            tally.settle()
            if len(tally.keys):
                yield out(kind, tally.keys, tally.counts)
        yield out(2, np.zeros(1, np.uint64), np.array([texts], np.int64))

    made = docs.select("text", "held_out").mapInArrow(run, "kind int, key long, n long")
    return made.groupBy("kind", "key").agg(F.sum("n").alias("n"))


def _most(counts: DataFrame, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """(key, value) of the rows (key, n, value) met most often: all from the lowest class of counts
    on that leaves at most `limit` rows. A class is a sixteenth of a doubling."""
    classed = counts.withColumn("class", F.floor(F.log2("n") * 16))
    least, total = 1 << 30, 0
    for r in classed.groupBy("class").agg(F.count("*").alias("rows")).orderBy(F.desc("class")).collect():
        total += r.rows
        if total > limit:
            break
        least = r["class"]
    got = classed.where(F.col("class") >= least).select("key", "value").toArrow()
    return got["key"].to_numpy().view(np.uint64), got["value"].to_numpy()


def _tail(n: int) -> Column:
    """The last n bytes of a key."""
    return F.col("key").bitwiseAND(F.lit((1 << 8 * n) - 1))


def _context() -> Column:
    return F.shiftright("key", 8)


def gram_logs(grams: DataFrame) -> DataFrame:
    """(key, n, value) for each row (key, n, asked): how often it is met, and the log10 probability of
    its last byte after the others under the trie of all rows with n > 0.

    Method-D escapes: half a count of each symbol goes to the escape. Symbols of a longer context are
    excluded from shorter ones; as all symbols seen after a context are seen after its shorter ones
    too, what a context excludes from the next shorter one is two sums, taken once per context.
    Keys with n = 0 walk from the longest context to the shortest by joins; the tables of the two
    shortest hold at most 65,536 rows and are broadcast.
    """
    entries = {ORDER: grams.where("n > 0").select("key", "n")}
    for k in range(ORDER - 1, -1, -1):
        shorter = entries[k + 1].groupBy(_tail(k + 1).alias("key")).agg(F.sum("n").alias("n"))
        entries[k] = landed(shorter, f"order-{k}")

    def contexts(k: int) -> DataFrame:
        full = entries[k].withColumn("below", F.lit(0).cast("long"))
        if k:
            below = entries[k - 1].select(F.col("key").alias("suffix"), F.col("n").alias("below"))
            full = entries[k].withColumn("suffix", _tail(k)).join(F.broadcast(below) if k < 3 else below, "suffix")
        sums = F.sum("n").alias("total"), F.count("*").alias("kinds"), F.sum("below").alias("shadow")
        return full.groupBy(_context().alias("context")).agg(*sums)

    longest = landed(contexts(ORDER), "contexts")
    seen = (
        grams.where("n > 0")
        .withColumn("context", _context())
        .join(longest, "context")
        .select("key", F.col("asked").alias("n"), F.log10((F.col("n") - 0.5) / F.col("total")).alias("value"))
    )
    walk = grams.where("n = 0").selectExpr(
        "key", "asked", "0D as value", "true as open", "0L as gone_mass", "0L as gone_kinds"
    )
    for k in range(ORDER, -1, -1):
        at = longest if k == ORDER else contexts(k)
        found = entries[k].select(F.col("key").alias("gram"), F.col("n").alias("found"))
        walk = (
            walk.withColumn("gram", _tail(k + 1))
            .withColumn("context", F.shiftright("gram", 8))
            .join(F.broadcast(at) if k < 2 else at, "context", "left")
            .join(F.broadcast(found) if k < 2 else found, "gram", "left")
        )
        live = F.col("open") & F.col("total").isNotNull()
        hit = live & F.col("found").isNotNull()
        mass, kinds = F.col("total") - F.col("gone_mass"), F.col("kinds") - F.col("gone_kinds")
        step = (
            F.when(hit, F.log10((F.col("found") - 0.5) / mass))
            .when(live & (kinds > 0), F.log10(0.5 * kinds / mass))
            .otherwise(0.0)
        )
        walk = walk.select(
            "key",
            "asked",
            (F.col("value") + step).alias("value"),
            (F.col("open") & ~hit).alias("open"),
            *[
                F.when(live & ~hit, F.col(new)).otherwise(F.col(old)).alias(old)
                for old, new in (("gone_mass", "shadow"), ("gone_kinds", "kinds"))
            ],
        )
    left = F.when(F.col("open"), F.log10(256 - F.col("gone_kinds"))).otherwise(0.0)
    return seen.union(walk.select("key", F.col("asked").alias("n"), F.col("value") - left))


class Lookup:
    """Places of known keys, by hashing; -1 for others."""

    def __init__(self, keys: np.ndarray) -> None:
        bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 2.5))))
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = keys
        self.place = np.full(1 << bits, -1, np.int32)
        self.stored = np.full(1 << bits, np.iinfo(np.uint64).max, np.uint64)
        left, slot = np.arange(len(keys)), self._slot(keys)
        while len(left):
            free = self.place[slot] < 0
            first = np.unique(slot[free], return_index=True)[1]
            put = np.flatnonzero(free)[first]
            self.place[slot[put]] = left[put]
            self.stored[slot[put]] = keys[left[put]]
            rest = np.ones(len(left), bool)
            rest[put] = False
            left, slot = left[rest], (slot[rest] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(keys), -1, np.int32)
        slot = self._slot(keys)
        out = np.where(self.stored[slot] == keys, self.place[slot], -1)
        todo = np.flatnonzero((out < 0) & (self.place[slot] >= 0))
        while len(todo):
            slot_ = slot[todo] = (slot[todo] + 1) & self.mask
            hit = self.stored[slot_] == keys[todo]
            out[todo[hit]] = self.place[slot_[hit]]
            todo = todo[~hit & (self.place[slot_] >= 0)]
        return out


def _lists(owner: np.ndarray, n: int, *values: np.ndarray) -> list[pa.ListArray]:
    """Values as lists per owner from 0 to n - 1; owners come in ascending order."""
    cuts = pa.array(np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n))]), pa.int32())
    return [pa.ListArray.from_arrays(cuts, pa.array(v)) for v in values]


def _text_logs(texts: list[bytes], lookup: Lookup, logs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sum of the known logs of each text; owner, key and number of all other keys, by owner."""
    out, others = np.zeros(len(texts)), []
    for data, owner in _segments(texts):
        keys, owner = _keys(data)[owner >= 0], owner[owner >= 0]
        at = lookup.find(keys)
        met = at >= 0
        out += np.bincount(owner[met], logs[at[met]], len(texts))
        keys, owner = keys[~met], owner[~met]
        order = np.lexsort((keys, owner))
        keys, owner = keys[order], owner[order]
        starts = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])])[: len(keys)])
        others.append((owner[starts], keys[starts], np.diff(np.append(starts, len(keys)))))
    owner, keys, times = (np.concatenate(x) if others else np.zeros(0, np.int64) for x in (zip(*others) if others else ([], [], [])))
    return out, owner.astype(np.int64), keys.astype(np.uint64), times.astype(np.int64)


_held: dict[str, tuple] = {}


def scored(
    docs: DataFrame,
    held_out: str = "crc32(cast(doc_id as string)) % 7 = 2",
    sent_grams: int = GRAMS,
    sent_words: int = WORDS,
) -> DataFrame:
    """Scores of every row of `docs` under a trie and under single words, both counted on the rows
    for which the SQL condition `held_out` is not true.

    A-Z is lower-cased. base_score adds log10((c + 1) / (N + V + 1)) over words and one end. `score` is
    the log10 probability of the whole text, byte by byte, and its end. The trie keeps every context
    of the corpus; the values met most often, at most `sent_grams` bytes with their context and
    `sent_words` words, are sent to workers, all others meet their values in a join. The bounds do
    not change a result.

    Null or empty text: the end alone. A null doc_id is trained on. Repeated rows count as often as
    they stand there. An empty table gives an empty result. Other columns are not read.
    """
    spark = docs.sparkSession
    split = docs.select("doc_id", "text", F.coalesce(F.expr(held_out), F.lit(False)).alias("held_out"))
    counts = landed(corpus_counts(split), "counts")
    words = counts.where("kind = 0").select("key", "n", F.log10(F.col("n") + 1).alias("value"))
    texts = counts.where("kind = 2").agg(F.sum("n")).first()[0] or 0
    known = words.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    total = (known.n or 0) + texts
    distinct = known.v + (1 if texts else 0)
    trained = F.sum(F.when(F.col("kind") == 1, F.col("n")).otherwise(0)).alias("n")
    asked = counts.where("kind in (1, 3)").groupBy("key").agg(trained, F.sum("n").alias("asked"))
    grams = landed(gram_logs(landed(asked, "grams")), "gram-logs")
    sent = spark.sparkContext.broadcast((_most(grams, sent_grams), _most(words, sent_words)))
    tag = uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tag not in _held:
            _held.clear()
            _held[tag] = [(Lookup(keys), values) for keys, values in sent.value]
        (gram_lookup, gram_values), (lookup, logs) = _held[tag]
        row = TaskContext.get().partitionId() << 33
        end = np.log10(texts + 1.0)
        for batch in batches:
            column = batch.column(1).to_pylist()
            size = len(column)
            hashes = [word_hashes(t) for t in column]
            lengths = np.array([len(h) for h in hashes], np.int64)
            owner = np.repeat(np.arange(size), lengths)
            every = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
            at = lookup.find(every)
            common = at >= 0
            base = np.bincount(owner[common], logs[at[common]], size) + end
            many = np.bincount(owner[common], minlength=size) + (1 if texts else 0)
            score, gram_owner, keys, times = _text_logs([_lower(t) for t in column], gram_lookup, gram_values)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.arange(row, row + size)),
                    batch.column(0),
                    batch.column(2),
                    pa.array(lengths + 1),
                    pa.array(many, pa.int64()),
                    pa.array(base, pa.float64()),
                    pa.array(score, pa.float64()),
                    *_lists(owner[~common], size, every[~common].view(np.int64)),
                    *_lists(gram_owner, size, keys.view(np.int64), times),
                ],
                names=["row", "doc_id", "held_out", "n_tokens", "common", "base", "score", "rare", "grams", "times"],
            )
            row += size

    schema = (
        "row long, doc_id long, held_out boolean, n_tokens long, common long, base double, score double,"
        " rare array<long>, grams array<long>, times array<long>"
    )
    made = landed(split.select("doc_id", "text", "held_out").mapInArrow(run, schema), "scores")
    rare_words = (
        made.select("row", F.explode("rare").alias("key"))
        .join(words, "key")
        .select("row", F.lit(1).alias("more"), F.col("value").alias("logs"), F.lit(0.0).alias("bytes"))
    )
    rare_grams = (
        made.select("row", F.inline(F.arrays_zip(F.col("grams").alias("key"), F.col("times").alias("times"))))
        .join(grams.select("key", "value"), "key")
        .select("row", F.lit(0), F.lit(0.0), F.col("times") * F.col("value"))
    )
    rest = rare_words.union(rare_grams).groupBy("row").agg(*[F.sum(c).alias(c) for c in ("more", "logs", "bytes")])
    each = float(np.log10(total + distinct + 1))
    return made.join(rest, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("common") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("logs", F.lit(0.0)) - each * F.col("n_tokens")).alias("base_score"),
        (F.col("score") + F.coalesce("bytes", F.lit(0.0))).alias("score"),
    )
