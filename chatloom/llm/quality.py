"""Quality rules: how far a document's histograms lie from those of its language."""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import count
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chatloom.llm.common import landed, pieces, with_arrow

CLASSES = 8  # lower case, upper case, other letters and marks, digits, white space, punctuation, symbols, rest
SYMBOLS = "#*$%&|<>"
# Bytes of ASCII that end a word of the word histogram.
_CUTS = bytes(32 if not (chr(i).isalnum() or i > 127) else i for i in range(256))


@dataclass(frozen=True)
class Rules:
    """Parameters. Distances are Jensen-Shannon distances (base 2, from 0 to 1).

    A document of n characters may lie `class_slack / sqrt(n)` further from its language's
    character classes than `class_limit`, and `word_slack / sqrt(n_words)` further from its common
    words than `word_limit`: short texts scatter more. A reference from d documents is itself
    uncertain, so that `few_slack / sqrt(d)` is allowed on top. Under `min_chars` or `min_words` the
    histogram is not judged. `common_words` words of at most `word_letters` letters, which are the
    function words of a language, make up its word histogram, with one more place for all others.
    References of up to `max_languages` languages are sent to the workers; those of more are joined.
    """

    class_limit: float = 0.17
    class_slack: float = 2.0
    word_limit: float = 0.24
    word_slack: float = 2.0
    min_chars: int = 200
    min_words: int = 60
    few_slack: float = 1.0
    common_words: int = 64
    word_letters: int = 5
    max_languages: int = 8192


def _class_table() -> np.ndarray:
    """Class of every code point, by its Unicode category."""
    kinds = {"Ll": 0, "Lu": 1, "Lt": 1, "Nd": 3, "Zs": 4, "Zl": 4, "Zp": 4}
    wide = {"L": 2, "M": 2, "N": 3, "P": 5, "S": 6}
    out = np.full(0x110000, 7, np.uint8)
    for code in range(0x110000):
        category = unicodedata.category(chr(code))
        out[code] = kinds.get(category, wide.get(category[0], 7))
    out[9:14] = 4
    for c in SYMBOLS:
        out[ord(c)] = 6
    return out


_table: list[np.ndarray] = []


def class_counts(text: str) -> np.ndarray:
    """Code points of a text by class."""
    if not _table:
        _table.append(_class_table())
    out = np.zeros(CLASSES, np.int64)
    for start in range(0, len(text), 1 << 20):
        codes = np.frombuffer(text[start : start + (1 << 20)].encode("utf-32-le", "surrogatepass"), np.uint32)
        out += np.bincount(_table[0][codes], minlength=CLASSES)
    return out


def word_counts(text: str) -> Counter:
    """Lower-case words between ASCII punctuation and white space, as bytes."""
    out: Counter = Counter()
    for piece in pieces(text.lower().encode("utf-8", "surrogatepass")):
        out.update(piece.translate(_CUTS).split())
    return out


def repeated_words(ids: np.ndarray, width: int = 5) -> int:
    """Positions inside windows of `width` words that occur twice or more. `ids` number the words."""
    n = len(ids) - width + 1
    if n < 2:
        return 0

    def ranked(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        base = np.int64(max(int(right.max()), int(left.max())) + 1)
        return np.unique(left * base + right, return_inverse=True)[1].astype(np.int64)

    two = ranked(ids[:-1], ids[1:])
    four = ranked(two[:-2], two[2:])
    _, place, counts = np.unique(
        four[:-1] * np.int64(len(ids) + 1) + ids[4:], return_inverse=True, return_counts=True
    )
    again = counts[place] > 1
    if not again.any():
        return 0
    cover = np.zeros(len(ids) + 1, np.int64)
    np.add.at(cover, np.flatnonzero(again), 1)
    np.add.at(cover, np.flatnonzero(again) + width, -1)
    return int((np.cumsum(cover)[:-1] > 0).sum())


def base_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of a whole text; null: none."""
    if not text:
        return 0, 0, 0, 0, 0
    seen: dict[bytes, int] = {}
    parts, numbers = [], count()
    for piece in pieces(text.encode("utf-8", "surrogatepass")):
        words = piece.split()  # bytes split at \x20 and \x09-\x0D, and nowhere else
        parts.append(np.fromiter(map(seen.setdefault, words, numbers), np.int64, len(words)))
    ids = parts[0] if len(parts) == 1 else np.concatenate(parts)
    # Numbers are the place of the first occurrence; close the gaps so that pairs of them stay small.
    ids = np.unique(ids, return_inverse=True)[1].astype(np.int64) if len(ids) else ids
    blanks = sum(map(text.count, " \t\n\x0b\x0c\r"))
    lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    return (
        len(ids),
        len(text) - blanks,
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(ids),
    )


def base_fails(n_words: int, n_repeat_words: int) -> bool:
    return n_words < 10 or 100 * n_repeat_words > 20 * n_words


def js_distance(p: np.ndarray, q: np.ndarray) -> float:
    """Jensen-Shannon distance of two histograms, each with a positive sum."""
    p, q = p / p.sum(), q / q.sum()
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        left = np.where(p > 0, p * np.log2(p / m), 0).sum()
        right = np.where(q > 0, q * np.log2(q / m), 0).sum()
    return float(np.sqrt(max(0.0, (left + right) / 2)))


def language_references(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """(lang, kind, item, weight, documents) over all documents: the references of each language.

    kind 0 are character classes, kind 1 the common words (item -1: all others, item k: the word in
    `word`). A document that is long enough to be judged and passes the base rules counts once,
    whatever its length. Each task sums what it reads before anything is shuffled.
    """
    limit = 200_000

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally: dict[tuple, float] = {}

        def flush() -> pa.RecordBatch:
            keys = list(tally)
            out = pa.RecordBatch.from_arrays(
                [
                    pa.array([k[0] for k in keys], pa.string()),
                    pa.array([k[1] for k in keys], pa.int32()),
                    pa.array([k[2] for k in keys], pa.string()),
                    pa.array([tally[k] for k in keys], pa.float64()),
                ],
                names=["lang", "kind", "word", "weight"],
            )
            tally.clear()
            return out

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if lang is None or not text or len(text) < rules.min_chars:
                    continue
                counts = base_counts(text)
                if base_fails(counts[0], counts[4]):
                    continue
                classes = class_counts(text) / len(text)
                for i in range(CLASSES):
                    key = (lang, 0, str(i))
                    tally[key] = tally.get(key, 0.0) + float(classes[i])
                words = word_counts(text)
                total = sum(words.values())
                if total >= rules.min_words:
                    tally[lang, 2, ""] = tally.get((lang, 2, ""), 0.0) + 1.0
                    for word, n in words.items():
                        if len(word) <= 4 * rules.word_letters:
                            name = word.decode("utf-8", "replace")
                            if len(name) <= rules.word_letters and name.isalpha():
                                key = (lang, 1, name)
                                tally[key] = tally.get(key, 0.0) + n / total
                if len(tally) > limit:
                    yield flush()
        yield flush()

    summed = (
        docs.select("lang", "text")
        .mapInArrow(sums, "lang string, kind int, word string, weight double")
        .groupBy("lang", "kind", "word")
        .agg(F.sum("weight").alias("weight"))
    )
    # The heaviest words of a language: first within shares of its words, then among those left.
    order = [F.desc("weight"), F.col("word")]
    share = Window.partitionBy("lang", "kind", F.pmod(F.xxhash64("word"), F.lit(32))).orderBy(*order)
    whole = Window.partitionBy("lang", "kind").orderBy(*order)
    return (
        summed.withColumn("place", F.row_number().over(share))
        .where(F.col("place") <= rules.common_words)
        .withColumn("place", F.row_number().over(whole))
        .where(F.col("place") <= rules.common_words)
    )


class Reference(NamedTuple):
    """What a language looks like: its character classes, its common words and their shares (the last is
    that of all others), and the documents behind the two."""

    classes: np.ndarray
    words: list[bytes]
    shares: np.ndarray | None
    documents: float
    word_documents: float


def reference(items: Iterable[tuple[int, str, float]]) -> Reference:
    """Reference of one language from its (kind, word, weight)."""
    classes, words, many = np.zeros(CLASSES), {}, 0.0
    for kind, word, weight in items:
        if kind == 0:
            classes[int(word)] = weight
        elif kind == 1:
            words[word.encode()] = weight
        else:
            many = weight
    names = sorted(words)
    shares = np.array([words[w] for w in names]) / max(many, 1.0)
    shares = np.append(shares, max(1.0 - shares.sum(), 0.0)) if names else None
    return Reference(classes, names, shares, float(classes.sum()), many)


def verdict(text: str | None, known: Reference | None, rules: Rules) -> tuple:
    """Class and word distance (null where not judged) and whether both are near enough."""
    if not text or known is None or not known.documents or len(text) < rules.min_chars:
        return None, None, True
    by_class = js_distance(class_counts(text), known.classes)
    near = by_class <= rules.class_limit + rules.class_slack / len(text) ** 0.5 + rules.few_slack / known.documents**0.5
    by_word = None
    if known.shares is not None and known.word_documents:
        words = word_counts(text)
        total = sum(words.values())
        if total >= rules.min_words:
            own = np.array([words[w] for w in known.words], np.float64)
            by_word = js_distance(np.append(own, total - own.sum()), known.shares)
            near = near and by_word <= rules.word_limit + rules.word_slack / total**0.5 + rules.few_slack / known.word_documents**0.5
    return by_class, by_word, near


def quality_rules(docs: DataFrame, rules: Rules = Rules(), references: DataFrame | None = None) -> DataFrame:
    """All rows and columns of `docs` with counts, distances and `kept`.

    A document goes if it fails a base rule (under 10 words, or more than a fifth of them in
    repeated 5-word windows) or lies too far from its language (see Rules). References are taken
    over all of `docs` unless given. No text is shuffled: texts are read once for the references
    and once for the verdict.

    Null or empty text: all counts 0, base rule failed. Null language, a language without a document
    behind its reference, or a text under the minimum lengths: base rules only. Repeated rows are judged
    each alike. An empty table gives an empty result. Columns of `docs` named like a result are replaced.
    """
    if references is None:
        references = landed(language_references(docs, rules), "references")
    new = (
        "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
        "base_failed boolean, class_distance double, word_distance double, kept boolean"
    )

    def judged(text: str | None, known: Reference | None) -> tuple:
        counts = base_counts(text)
        failed = base_fails(counts[0], counts[4])
        by_class, by_word, near = verdict(text, known, rules)
        return *counts, failed, by_class, by_word, not failed and near

    def columns(rows: list[tuple]) -> list:
        return list(zip(*rows, strict=True)) if rows else [[] for _ in range(9)]

    packed = references.groupBy("lang").agg(F.collect_list(F.struct("kind", "word", "weight")).alias("_reference"))
    if references.select("lang").distinct().count() <= rules.max_languages:
        found = {r.lang: reference(r["_reference"]) for r in packed.toLocalIterator()}
        sent = docs.sparkSession.sparkContext.broadcast(found)
        return with_arrow(
            docs, ["text", "lang"], new, lambda texts, langs: columns([judged(t, sent.value.get(x)) for t, x in zip(texts, langs, strict=True)])
        )
    met = docs.join(packed.withColumnRenamed("lang", "_language"), F.col("lang") == F.col("_language"), "left").drop("_language")

    def joined(texts: list, items: list) -> list:
        told = (None if x is None else reference(tuple(i.values()) for i in x) for x in items)
        return columns([judged(t, known) for t, known in zip(texts, told, strict=True)])

    return with_arrow(met, ["text", "_reference"], new, joined).drop("_reference")
