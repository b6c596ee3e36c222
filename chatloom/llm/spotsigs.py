"""SpotSigs fingerprints, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatloom.llm.common import landed

# Common words that anchor a signature: fixed values, articles, prepositions, conjunctions and forms
# of "to be" and "to have" of four languages. Another tuple may be given.
ANCHORS = tuple(
    (
        "the of and to a in is that it was for on are as with his they at be this from have or by had not but what all"
        " were when we there can an your which their said if do will each how them then these so some her would make"
        " le la les de des du un une et en que qui dans pour par sur au aux avec ce il elle est sont pas plus ne se son sa"
        " der die das den dem ein eine einen und zu von mit sich auf für nicht ist im als auch es an er hat aus bei wird"
        " el los las del al una y o por con para su lo como más pero sus era son ha muy sin sobre"
    ).split()
)
CHAIN = 3  # content words of a signature
_MARKS = ".,;:!?\"'()[]{}«»“”…"


def signatures(text: Column, anchors: tuple[str, ...] = ANCHORS, chain: int = CHAIN) -> Column:
    """Sorted distinct 64-bit signatures of a text: the chains of `chain` content words after each
    run of anchors, over further anchors if need be.

    A text with words but no chain has one signature, of all its words; one without words has none.
    """
    words = F.split(F.translate(F.lower(F.coalesce(text, F.lit(""))), _MARKS, ""), r"[\x20\x09-\x0D]+")
    marked = F.array_join(F.transform(words, lambda w: F.when(w.isin(*anchors), F.lit("\n")).otherwise(w)), " ")
    parts = F.transform(F.split(marked, "\n"), lambda s: F.trim(s))
    # What stands before the first anchor follows none.
    runs = F.filter(F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1))), lambda s: s != "")

    def chained(r: Column) -> Column:
        return F.transform(
            r,
            lambda s, i: F.xxhash64(
                F.substring_index(F.concat_ws(" ", s, *[F.get(r, i + k) for k in range(1, chain)]), " ", chain)
            ),
        )

    made = F.transform(F.array(runs), chained)[0]
    every = F.trim(F.array_join(words, " "))
    whole = F.when(every == "", F.array().cast("array<bigint>")).otherwise(F.array(F.xxhash64(every)))
    return F.transform(
        F.array(made), lambda m: F.when(F.size(m) > 0, F.sort_array(F.array_distinct(m))).otherwise(whole)
    )[0]


def printed(sigs: Column) -> Column:
    """A fingerprint as text: its signatures in hexadecimal."""
    return F.array_join(F.transform(sigs, lambda x: F.lower(F.lpad(F.hex(x), 16, "0"))), " ")


def length_class(sigs: Column, threshold: float = 0.8) -> Column:
    """Partition by set length: sets as similar as the threshold are in one class or in two next ones."""
    return F.floor(F.log(F.greatest(F.size(sigs), F.lit(1))) / F.log(F.lit(1 / threshold)) + 1e-9)


def likeness(a: Column, b: Column, floor: float = 0.0) -> Column:
    """Jaccard similarity of two sets; pruned to 0 where their lengths alone keep it under `floor`.
    Two empty sets: 1."""
    both = F.size(F.array_intersect(a, b))
    bound = F.least(F.size(a), F.size(b)) / F.greatest(F.size(a), F.size(b), F.lit(1))
    return (
        F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0))
        .when(bound < floor, F.lit(0.0))
        .otherwise(F.transform(F.array(both), lambda n: n / (F.size(a) + F.size(b) - n))[0])
    )


def similar_fingerprints(prints: DataFrame, threshold: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """Classes (id, class_id) of equal fingerprints, and pairs (a, b, likeness) between class ids.

    `prints` has (id, signatures). Only classes of one or two next partitions by set length meet,
    through a signature among the rarest of each, as many as a set must have so that one is shared;
    copies are never expanded into pairs. Empty sets are in no pair.
    """
    known = prints.where("id is not null").select("id", "signatures", F.md5(printed(F.col("signatures"))).alias("k"))
    first = known.groupBy("k").agg(F.min("id").alias("class_id"))
    members = known.join(first, "k").select("id", "class_id")
    sets = landed(
        known.join(first, "k")
        .where((F.col("id") == F.col("class_id")) & (F.size("signatures") > 0))
        .select("id", "signatures", length_class(F.col("signatures"), threshold).alias("p"))
        .dropDuplicates(["id", "signatures"]),
        "prints",
    )
    each = sets.select("id", "p", F.size("signatures").alias("n"), F.explode("signatures").alias("s"))
    ranked = (
        each.join(each.groupBy("s").agg(F.count("*").alias("many")), "s")
        .groupBy("id", "p", "n")
        .agg(F.sort_array(F.collect_list(F.struct("many", "s"))).alias("t"))
    )
    rare = F.expr(f"slice(t, 1, n - cast(ceil({threshold} * n) as int) + 1)")
    head = ranked.select("id", "p", "n", F.explode(rare).alias("t")).where("t.many > 1")
    a = head.select(F.col("id").alias("a"), F.col("n").alias("na"), F.explode(F.array("p", F.col("p") + 1)).alias("p"), F.col("t.s").alias("s"))
    b = head.select(F.col("id").alias("b"), F.col("n").alias("nb"), "p", F.col("t.s").alias("s"))
    pairs = (
        a.join(b, ["p", "s"])
        .where("a <> b and na <= nb and (na < nb or a < b)")
        .where(F.col("na") >= threshold * F.col("nb"))
        .select("a", "b")
        .distinct()
    )
    near = (
        pairs.join(sets.select(F.col("id").alias("a"), F.col("signatures").alias("sa")), "a")
        .join(sets.select(F.col("id").alias("b"), F.col("signatures").alias("sb")), "b")
        .select("a", "b", likeness(F.col("sa"), F.col("sb"), threshold).alias("likeness"))
        .where(F.col("likeness") >= threshold)
    )
    return members, near


def _nested(bounds: list[int], lo: int, hi: int) -> str:
    """SQL that finds the block of an id among sorted bounds by halving."""
    if hi - lo <= 1:
        return str(lo)
    mid = (lo + hi) // 2
    return f"if(doc_id < {bounds[mid]}L, {_nested(bounds, lo, mid)}, {_nested(bounds, mid, hi)})"


def following(ids: DataFrame, blocks: int) -> DataFrame:
    """(k, n, next_k) for distinct (doc_id, k, n): the next by (doc_id, k); after the last the first.

    Ids are dealt into ranges whose bounds are ids of the table; the rows of each bound stand, as
    guests, at the end of the range before, so no window spans all rows. Null ids come first.
    """
    spread = [i / blocks for i in range(1, blocks)]
    row = ids.agg(F.min("doc_id").alias("lo"), F.percentile_approx("doc_id", spread or [0.5], 100 * blocks).alias("q")).first()
    if row.lo is None:
        bounds = []
    else:
        bounds = sorted({row.lo, *(row.q or [])})
    inner = bounds[1:]
    block = F.expr(f"case when doc_id is null then 0 else {_nested([0, *inner], 0, len(inner) + 1)} end")
    dealt = ids.withColumn("block", block).withColumn("guest", F.lit(False))
    starts = [str(b) for b in inner]
    guests = dealt.where(f"doc_id in ({', '.join(starts)})" if starts else "false").withColumn("block", F.col("block") - 1)
    # The first row of all is the guest of the last range.
    head = ids.where("doc_id is null") if ids.where("doc_id is null").limit(1).count() else ids.where(F.col("doc_id") == F.lit(row.lo))
    wrap = head.withColumn("block", F.lit(len(inner))).withColumn("guest", F.lit(True))
    placed = (
        dealt.withColumn("turn", F.lit(0))
        .unionByName(guests.withColumn("guest", F.lit(True)).withColumn("turn", F.lit(1)))
        .unionByName(wrap.withColumn("turn", F.lit(2)))
    )
    order = Window.partitionBy("block").orderBy("turn", F.col("doc_id").asc_nulls_first(), "k")
    return placed.withColumn("next_k", F.lead("k").over(order)).where("not guest").select("k", "n", "next_k")


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every row's text and of its edited text, and how alike they are.

    The edited text has, in place of its last floor(n / 2) code points, the first as many (or all) of
    the next document by doc_id (after the last: the first). Texts are shuffled once by document,
    and the piece that the previous document takes once more.

    Null text counts as empty: no signatures, fingerprint ''. Rows that repeat doc_id and text are
    one document with equal rows; documents that share a doc_id follow each other in the order of a
    digest. Null ids come first. A lone document is its own next. An empty table gives an empty
    result. Other columns are not read.
    """
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    keyed = docs.select(
        "doc_id",
        text.alias("text"),
        F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.lit(":"), text)).alias("k"),
    )
    ids = landed(
        keyed.select("doc_id", "k", F.length("text").alias("n")).groupBy("doc_id", "k", "n").agg(F.count("*").alias("many")),
        "ids",
    )
    repeated = not ids.where("many > 1").isEmpty()
    blocks = min(1024, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    order = landed(following(ids.drop("many"), blocks), "order")
    giving = order.select(F.col("next_k").alias("k"), F.col("k").alias("to"), F.expr("n div 2").cast("int").alias("need"))
    given = keyed.join(giving, "k").select(
        "to",
        F.col("doc_id").alias("next_doc_id"),  # both sides of the join so read the same shuffled columns
        F.expr("left(text, need)").alias("fill"),
        signatures(F.col("text")).alias("next_sigs"),
    )
    if repeated:
        given = given.dropDuplicates(["to"])
    n = F.length("text")
    edited = F.concat(F.expr("left(text, length(text) - length(text) div 2)"), F.col("fill"))
    return (
        keyed.join(given, F.col("k") == F.col("to"))
        .select(
            keyed.doc_id,
            "next_doc_id",
            n.cast("long").alias("n_chars"),
            signatures(F.col("text")).alias("sigs"),
            edited.alias("edited"),
            "next_sigs",
        )
        .select(
            "doc_id",
            "next_doc_id",
            "n_chars",
            F.sha2("edited", 256).alias("edited_sha256"),
            "sigs",
            signatures(F.col("edited")).alias("edited_sigs"),
            "next_sigs",
        )
        .select(
            "doc_id",
            "n_chars",
            "edited_sha256",
            printed(F.col("sigs")).alias("fingerprint"),
            printed(F.col("edited_sigs")).alias("edited_fingerprint"),
            likeness(F.col("sigs"), F.col("edited_sigs")).alias("near_edited"),
            likeness(F.col("sigs"), F.col("next_sigs")).alias("near_next"),
            length_class(F.col("sigs")).alias("length_class"),
            "next_doc_id",
        )
    )
