"""MinHash near-duplicates with tensored banding, confirmed on whole shingle sets."""

from __future__ import annotations

import math
from functools import cache, partial

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatloom.llm.common import components, landed, mixed, shingle_set, with_arrow

# Two collections of half keys of ROWS minhashes each; every pair of a left and a right key is the
# key of one table. With 10 keys a collection 2 * 10 * 3 = 60 minhashes serve 100 tables of 6, which
# would take 600. Two documents of similarity s meet in a table with probability
# (1 - (1 - s**3)**halves)**2: 0.9999 at 0.85 with 10 keys. Lower thresholds take more keys, see halves().
ROWS, MISS = 3, (1 - 0.85**3) ** 10


def halves(percent: int) -> int:
    """Keys of a collection with which documents at the threshold meet at least as likely as at 85."""
    return max(1, math.ceil(math.log(MISS) / math.log(1 - (min(percent, 99) / 100) ** ROWS) - 1e-9))


@cache
def _functions(count: int) -> tuple[np.ndarray, np.ndarray]:
    """Factors and masks of the hash functions of 2 * count half keys."""
    random = np.random.default_rng(20_260_101)
    factors = random.integers(0, 1 << 63, 2 * count * ROWS, dtype=np.uint64) | np.uint64(1)
    return factors, random.integers(0, 1 << 63, 2 * count * ROWS, dtype=np.uint64)


def minhashes(shingles: np.ndarray, count: int) -> np.ndarray:
    """Smallest value of each hash function over a set that is not empty."""
    factors, masks = _functions(count)
    out = np.full(len(factors), np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for start in range(0, len(shingles), 4096):
            part = shingles[None, start : start + 4096]
            np.minimum(out, ((part ^ masks[:, None]) * factors[:, None]).min(axis=1), out=out)
    return out


def half_keys(shingles: np.ndarray, count: int) -> np.ndarray:
    """The 2 * count keys: left ones, then right ones."""
    hashes = minhashes(shingles, count).reshape(2 * count, ROWS)
    key = np.arange(2 * count, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for r in range(ROWS):
            key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + hashes[:, r])
    return key.view(np.int64)


def _signatures(texts: list, count: int) -> tuple[list, ...]:
    sizes, first, second, left, right = [], [], [], [], []
    for text in texts:
        shingles = shingle_set(text)
        sizes.append(len(shingles))
        if len(shingles):
            keys = half_keys(shingles, count)
            with np.errstate(over="ignore"):
                sums = [mixed(shingles).sum(), mixed(shingles ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum()]
            a, b = np.array(sums, np.uint64).view(np.int64)
            first.append(int(a)), second.append(int(b)), left.append(keys[:count]), right.append(keys[count:])
        else:
            first.append(0), second.append(0), left.append([]), right.append([])
    return sizes, first, second, left, right


def _meeting(sets: DataFrame, side: str) -> DataFrame:
    """Ids of sets that share a key of one collection with another set."""
    keys = sets.select("id", F.posexplode(side).alias("i", "key"))
    shared = keys.groupBy("i", "key").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo <> hi")
    return keys.join(shared, ["i", "key"], "left_semi").select("id").distinct()


def _confirmed(pairs: DataFrame, shingles: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar enough."""
    left = shingles.select(F.col("id").alias("a"), F.col("shingles").alias("sa"))
    right = shingles.select(F.col("id").alias("b"), F.col("shingles").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    return (
        pairs.join(left, "a")
        .join(right, "b")
        .select("a", "b", both.alias("both"), (F.size("sa") + F.size("sb")).alias("all"))
        .where(100 * F.col("both") >= percent * (F.col("all") - F.col("both")))
        .select("a", "b")
    )


def _rest(unsettled: DataFrame, shingles: DataFrame, percent: int) -> DataFrame:
    """Exact candidates among sets that one comparison per table could not settle.

    Two sets with the similarity share a shingle among the first n - ceil(s * n) + 1 of each, in one
    order of all shingles; the order is rarest first, so groups stay small. Pairs already in one
    component are left out, as are shingles that one component has to itself, and pairs whose first
    shared shingle comes too late: the first one shared has the whole intersection behind it, so
    at that place nothing is lost.
    """
    sets = shingles.join(unsettled, "id").select("id", "component", "shingles", F.size("shingles").alias("n"))
    token = sets.select("id", "component", "n", F.explode("shingles").alias("token"))
    counts = token.groupBy("token").agg(
        F.count("*").alias("many"), F.min("component").alias("lo"), F.max("component").alias("hi")
    )
    ranked = (
        token.join(counts, "token")
        .groupBy("id", "component", "n")
        .agg(F.sort_array(F.collect_list(F.struct("many", "token", (F.col("lo") != F.col("hi")).alias("mixed")))).alias("t"))
    )
    prefix = F.expr(f"slice(t, 1, n - cast(ceil({percent} * n / 100) as int) + 1)")
    first = (
        ranked.select("id", "component", "n", F.posexplode(prefix).alias("at", "t"))
        .where("t.mixed")
        .select("id", "component", "n", "at", F.col("t.token").alias("token"))
    )
    a, b = (
        first.select("token", *[F.col(c).alias(f"{c}_{side}") for c in ("id", "component", "n", "at")]) for side in "ab"
    )
    a, b = a.withColumnRenamed("id_a", "a"), b.withColumnRenamed("id_b", "b")
    # What can still be shared from the places of this shingle on must reach the similarity.
    most = F.least(F.col("n_a") - F.col("at_a"), F.col("n_b") - F.col("at_b"))
    near = (
        (F.col("component_a") < F.col("component_b"))
        & (100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
        & ((100 + percent) * most >= percent * (F.col("n_a") + F.col("n_b")))
    )
    return a.join(b, "token").where(near).select("a", "b").distinct()


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of `docs` (columns doc_id, text).

    Documents are linked where 100 * intersection >= percent * union of their sets of 5-word
    shingles. Equal sets are one class and never compared. Classes meet in tables keyed by pairs of
    half keys; a class without a partner in either collection of half keys is in no table, so only
    the others are spread over the tables. In a table every class is compared with the smallest id
    of its bucket, a star and not all pairs; buckets that this leaves in several components go to
    an exact prefix join, so no link among them is lost, however large the bucket.

    Null or empty text, or text without words: empty set, linked with nothing. A null doc_id: in no
    link, component null, kept. Rows that repeat a doc_id are one document with all their texts. An
    empty table gives an empty result. Other columns are not read.
    """
    signed = landed(
        with_arrow(
            docs.select("doc_id", "text"),
            ["text"],
            "n_shingles long, h1 long, h2 long, lefts array<long>, rights array<long>",
            partial(_signatures, count=halves(percent)),
        ).drop("text"),
        "signatures",
    )
    known = signed.where("doc_id is not null and n_shingles > 0")
    # Landed, so that the rows of one text that many documents have are split over tasks.
    classes = landed(known.groupBy("n_shingles", "h1", "h2").agg(F.min("doc_id").alias("id")), "class-ids")
    copies = known.join(classes, ["n_shingles", "h1", "h2"]).select(F.col("doc_id").alias("a"), F.col("id").alias("b"))
    copies = landed(copies.where("a <> b").distinct(), "copies")
    sets = landed(
        known.join(classes, ["n_shingles", "h1", "h2"]).where("doc_id = id").select("id", "lefts", "rights").dropDuplicates(["id", "lefts", "rights"]),
        "classes",
    )
    meeting = landed(_meeting(sets, "lefts").intersect(_meeting(sets, "rights")), "meeting")
    tables = sets.join(meeting, "id").select(
        "id",
        F.explode(
            F.expr(
                "flatten(transform(lefts, (l, i) -> transform(rights, (r, j) -> xxhash64(i, j, l, r))))"
            )
        ).alias("key"),
    )
    buckets = tables.groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo <> hi")
    members = landed(tables.join(buckets.select("key", "lo"), "key"), "buckets")
    stars = members.where("id <> lo").select(F.col("lo").alias("a"), F.col("id").alias("b")).distinct()
    partners = members.select("id").distinct()
    shingles = landed(
        with_arrow(
            docs.select("doc_id", "text").join(partners, F.col("doc_id") == F.col("id"), "left_semi"),
            ["text"],
            "shingles array<long>",
            lambda texts: ([shingle_set(t).view(np.int64) for t in texts],),
        ).select(F.col("doc_id").alias("id"), "shingles"),
        "shingles",
    )
    links = landed(copies.union(_confirmed(stars, shingles, percent)), "links")
    labels = components(links)
    labelled = members.join(labels, "id", "left").select("key", "id", F.coalesce("component", "id").alias("component"))
    mixed_keys = (
        labelled.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y")
    )
    unsettled = landed(
        labelled.join(mixed_keys, "key", "left_semi").select("id", "component").distinct(), "unsettled"
    )
    more = landed(_confirmed(_rest(unsettled, shingles, percent), shingles, percent), "links")
    if not more.isEmpty():
        labels = components(links.union(more))
    return signed.join(labels.withColumnRenamed("id", "doc_id"), "doc_id", "left").select(
        "doc_id",
        "n_shingles",
        F.coalesce("component", "doc_id").alias("component_id"),
        F.coalesce(F.col("component") == F.col("doc_id"), F.lit(True)).alias("kept"),
    )
