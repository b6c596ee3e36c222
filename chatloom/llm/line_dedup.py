"""Line dedup by pairwise alignment: shared long lines and runs find pairs, patience diff aligns them."""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Sequence, Set

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatloom.llm.common import landed, mixed, with_arrow

# A shared line of LINE_WORDS words or more seeds an alignment, and so does a shared run of neighbouring
# lines that add up to RUN_WORDS or more, however many texts have it.
LINE_WORDS, RUN_WORDS = 8, 20
# White space at the ends of a line, which does not tell lines apart.
SPACE = " \t\n\x0b\x0c\r"
# Gaps in gaps that are aligned by anchors of their own.
DEPTH = 64


def chain_of(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of pairs, sorted by their first place, whose second places increase."""
    piles: list[int] = []  # smallest last place of an increasing run of each length
    tops: list[int] = []
    back = [-1] * len(pairs)
    for n, (_, place) in enumerate(pairs):
        at = bisect_left(piles, place)
        back[n] = tops[at - 1] if at else -1
        if at == len(piles):
            piles.append(place)
            tops.append(n)
        else:
            piles[at], tops[at] = place, n
    chain, n = [], tops[-1] if tops else -1
    while n >= 0:
        chain.append(pairs[n])
        n = back[n]
    chain.reverse()
    return chain


def unique_pairs(a: Sequence, b: Sequence) -> list[tuple[int, int]]:
    """Places of the elements that are once in each of two sequences."""
    once, many = {}, set()
    for k, x in enumerate(b):
        if x in once:
            many.add(x)
        once[x] = k
    times = Counter(a)
    return [(k, once[x]) for k, x in enumerate(a) if x in once and x not in many and times[x] == 1]


def anchors(a: Sequence, b: Sequence, blank: Set[int]) -> list[tuple[int, int]]:
    """A chain of places from the elements that are once in both, or else from runs of two, four and more
    elements, not all blank, that are."""
    width, run_a, run_b = 1, list(a), list(b)
    void = set(blank)
    while width <= min(len(a), len(b)):
        pairs = unique_pairs(run_a, run_b)
        if width > 1:
            pairs = [x for x in pairs if run_a[x[0]] not in void]
        if pairs:
            return chain_of(pairs)
        # Runs of twice the width, by numbers that both sequences share.
        number: dict[tuple[int, int], int] = {}
        wide = [[number.setdefault(x, len(number)) for x in zip(run, run[width:])] for run in (run_a, run_b)]  # noqa: B905
        if set(wide[0]).isdisjoint(wide[1]):
            return []
        void = {n for (x, y), n in number.items() if x in void and y in void}
        run_a, run_b = wide
        width *= 2
    return []


def repeats(a: Sequence, b: Sequence, blank: Set[int]) -> list[tuple[int, int]]:
    """A chain of places that pairs the k-th of equal elements in one sequence with the k-th in the other."""
    places: dict[int, list[int]] = {}
    for k, x in enumerate(b):
        if x not in blank:
            places.setdefault(x, []).append(k)
    seen: Counter = Counter()
    pairs = []
    for k, x in enumerate(a):
        if x in places and seen[x] < len(places[x]):
            pairs.append((k, places[x][seen[x]]))
            seen[x] += 1
    return chain_of(pairs)


def patience(a: list[int], b: list[int], blank: Set[int] = frozenset()) -> list[tuple[int, int]]:
    """Matched places (i, j) of two sequences, by patience diff.

    Equal heads and tails match; between them the elements that are unique in both are aligned by
    the longest increasing run of their places, and each gap is treated alike. In a gap without such
    elements runs of elements that are unique in both take their place, and where there are none, or
    gaps lie more than DEPTH deep in gaps, equal elements are paired in their order; `blank` elements match there only
    beside others. The time is near linear in the lengths, whatever repeats.
    """
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b), 0)]
    while todo:
        i, i_end, j, j_end, depth = todo.pop()
        while i < i_end and j < j_end and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < i_end and j < j_end and a[i_end - 1] == b[j_end - 1]:
            i_end, j_end = i_end - 1, j_end - 1
            out.append((i_end, j_end))
        if i == i_end or j == j_end or depth > DEPTH:
            continue
        part, other = a[i:i_end], b[j:j_end]
        chain = anchors(part, other, blank) if depth < DEPTH else []
        after = depth + 1
        if not chain:  # what is beside the pairs is only compared at its ends
            chain, after = repeats(part, other, blank), DEPTH + 1
        if chain:
            chain = [(i + p, j + q) for p, q in chain]
            todo.append((i, chain[0][0], j, chain[0][1], after))
            for (p, q), (p2, q2) in zip(chain, [*chain[1:], (i_end, j_end)], strict=True):
                todo.append((p, p2, q, q2, after))
    return sorted(out)


def common_blocks(later: list[int], earlier: list[int], seeds: Set[int], words: list[int] | None = None) -> list[int]:
    """Places in `later` of the aligned runs of equal lines that hold a seed line or, by the `words` of
    each line, a seed run."""
    blank = {x for x, n in zip(later, words, strict=True) if not n} if words else frozenset()
    out: list[int] = []
    run: list[int] = []
    last = (-2, -2)
    for i, j in [*patience(later, earlier, blank), (-9, -9)]:
        if (i, j) != (last[0] + 1, last[1] + 1):
            if any(later[k] in seeds for k in run) or (words and sum(words[k] for k in run) >= RUN_WORDS):
                out.extend(run)
            run = []
        run.append(i)
        last = (i, j)
    return out


def seed_keys(lines: list[int], words: list[int]) -> np.ndarray:
    """Distinct keys of the lines that may seed, of each with a shorter line beside it, and of the shortest
    run from each line on that may.

    Blank lines are left out of runs, so a run has at most RUN_WORDS lines. Equal passages of RUN_WORDS
    words have the run from their first line in common. A line with its neighbour belongs to another
    document than the line alone where the first that has the line lacks the neighbour.
    """
    n = np.array(words, np.int64)
    full = n > 0
    key, n = np.array(lines, np.int64).view(np.uint64)[full], n[full]
    total = np.concatenate([[0], np.cumsum(n)])
    end = np.searchsorted(total, total[:-1] + RUN_WORDS)  # the run from i on is i .. end[i] - 1
    at = np.flatnonzero((end <= len(n)) & (end > np.arange(len(n)) + 1))
    run = np.full(len(at), RUN_WORDS, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(int((end[at] - at).max(initial=0))):
            inside = at + k < end[at]
            run[inside] = mixed(run[inside] * np.uint64(0x9E3779B97F4A7C15) + key[at[inside] + k])
        near = np.flatnonzero((n[:-1] >= LINE_WORDS) != (n[1:] >= LINE_WORDS))
        pair = mixed(mixed(key[near]) * np.uint64(0x9E3779B97F4A7C15) + key[near + 1])
    return np.unique(np.concatenate([key[n >= LINE_WORDS], run, pair])).view(np.int64)


def removed_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, n_lines, removed, partners) for documents that lose lines.

    Every line or run that seeds belongs to the first document that has it; each later one is paired
    with that document, so a line that a third of all documents share makes one pair for each of them
    and no more. Texts are equal classes first: later copies lose all lines.
    """
    keyed = docs.where("doc_id is not null and text is not null").select("doc_id", F.md5("text").alias("text_key"), "text")
    lines = F.split("text", "\n")
    first = landed(
        keyed.groupBy("text_key").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("last")), "texts"
    )
    # Repeated rows are merged before the join, so that no aggregate keeps the copies of a text together.
    copies = keyed.select("doc_id", "text_key", F.size(lines).alias("n")).distinct().join(first, "text_key")
    copies = copies.where("doc_id <> owner").select(
        "doc_id",
        "text_key",
        F.sequence(F.lit(0), F.col("n") - 1).alias("removed"),
        F.col("owner").alias("partner"),
    )
    owners = first.select(F.col("owner").alias("doc_id"), "text_key")
    stored = (
        keyed.join(owners, ["doc_id", "text_key"], "left_semi")
        .dropDuplicates(["doc_id", "text_key"])
        .select(
            "doc_id",
            "text_key",
            F.transform(lines, lambda l: F.xxhash64(F.btrim(l, F.lit(SPACE)))).alias("lines"),
            F.transform(
                lines, lambda l: F.regexp_count(l, F.lit("[^\\x20\\x09-\\x0D]+")).cast("int")
            ).alias("words"),
        )
    )

    def keys(lines: list, words: list) -> tuple:
        return ([seed_keys(*x) for x in zip(lines, words, strict=True)],)

    stored = landed(with_arrow(stored, ["lines", "words"], "keys array<long>", keys), "lines")
    each = stored.select("doc_id", "text_key", F.explode("keys").alias("line"))
    # Landed, so that the rows of one very common line are split over tasks.
    seeds = landed(
        each.groupBy("line")
        .agg(F.count("*").alias("texts"), F.min(F.struct("doc_id", "text_key")).alias("o"))
        .where("texts > 1")
        .select("line", F.col("o.doc_id").alias("owner"), F.col("o.text_key").alias("owner_key")),
        "seeds",
    )
    pairs = (
        each.join(seeds, "line")
        .where("text_key <> owner_key")
        .groupBy("doc_id", "text_key", "owner", "owner_key")
        .agg(F.collect_set("line").alias("seeds"))
    )
    both = pairs.join(stored.drop("keys"), ["doc_id", "text_key"]).join(
        stored.select(F.col("doc_id").alias("owner"), F.col("text_key").alias("owner_key"), F.col("lines").alias("others")),
        ["owner", "owner_key"],
    )

    def align(later: list, earlier: list, seeds: list, words: list) -> tuple:
        return ([common_blocks(a, b, set(s), n) for a, b, s, n in zip(later, earlier, seeds, words, strict=True)],)

    aligned = (
        with_arrow(both, ["lines", "others", "seeds", "words"], "removed array<int>", align)
        .where(F.size("removed") > 0)
        .select("doc_id", "text_key", "removed", F.col("owner").alias("partner"))
    )
    return (
        aligned.unionByName(copies)
        .groupBy("doc_id", "text_key")
        .agg(
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("removed")))).alias("removed"),
            F.array_sort(F.collect_set("partner")).alias("partners"),
        )
    )


def line_dedup(docs: DataFrame) -> DataFrame:
    """All rows and columns of `docs` with `text` without the lines that earlier documents have.

    Adds n_lines, n_removed (of the whole text) and partners, the ids of the earlier documents.
    Earlier is a smaller doc_id; of every deleted line the first document that has it keeps it.
    Only runs of aligned lines with a seed line or run (see LINE_WORDS) go, so common short lines stay.

    Null text stays null, empty text empty, with nothing removed. A null doc_id: never compared. Rows
    that repeat doc_id and text are one document, treated alike; rows that repeat a doc_id with
    another text are documents of their own. An empty table gives an empty result. Columns named
    like the three new ones are replaced, all others kept. White space at the ends of a line, a CR before its LF
    among it, does not tell lines apart.
    """
    own = {c: f"_line_dedup_{c}" for c in ("doc", "key", "removed", "partners")}
    gone = landed(removed_lines(docs), "removed").select(
        F.col("doc_id").alias(own["doc"]),
        F.col("text_key").alias(own["key"]),
        F.col("removed").alias(own["removed"]),
        F.col("partners").alias(own["partners"]),
    )
    removed = F.col(own["removed"])
    lines = F.split("text", "\n")
    keep = F.array_join(F.filter(lines, lambda _, i: ~F.array_contains(removed, i)), "\n")
    text = F.when(removed.isNull(), F.col("text")).otherwise(keep).alias("text")
    kept = [c for c in docs.columns if c not in ("n_lines", "n_removed", "partners")]
    return (
        docs.select(*(_quoted(c) for c in kept))
        .join(gone, (F.col("doc_id") == F.col(own["doc"])) & (F.md5("text") == F.col(own["key"])), "left")
        .select(
            *[text if c == "text" else F.col(_quoted(c)) for c in kept],
            F.coalesce(F.size(lines), F.lit(0)).cast("long").alias("n_lines"),
            F.when(removed.isNull(), 0).otherwise(F.size(removed)).cast("long").alias("n_removed"),
            F.coalesce(own["partners"], F.array().cast("array<bigint>")).alias("partners"),
        )
    )


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"
