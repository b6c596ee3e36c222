"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatloom.llm.common import landed

# Members that one fold takes on average, and how near 0 or 1 counts as integral.
BLOCK = 64
EPS = 1e-9

_FIELDS = ("doc_id", "source", "size", "mark", "many", "whole", "extra", "source_size", "target")
_ITEM = (
    "struct<doc_id:bigint,source:string,size:bigint,mark:bigint,many:bigint,whole:bigint,extra:bigint,"
    "source_size:bigint,target:double,mass:double>"
)


def word_count(text: str | Column) -> Column:
    """Words `[^\\x20\\x09-\\x0D]+` of a text; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(
    sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), budget: float = 1.5, most: float = 2.0
) -> DataFrame:
    """(source, source_size, target) from rows (source, size).

    Sources in order of code points, null last, take the weights in turn and share `budget` times
    all sizes; no target passes `most` times its source's size. With the sources ordered by the
    level at which they reach that limit, the common level of the others has a closed form. The
    windows run over one row per source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    turn = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    ranked = per.withColumn("place", place).withColumn("weight", turn).withColumn("limit", most * F.col("source_size"))
    order = Window.orderBy(F.col("limit") / F.col("weight"), "place")
    full = F.coalesce(F.sum("limit").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    open_ = F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    everything = Window.partitionBy()
    level = (budget * F.sum("source_size").over(everything) - full) / open_
    levelled = ranked.withColumn("level", level).withColumn("step", F.row_number().over(order))
    fits = F.when(F.col("level") * F.col("weight") <= F.col("limit"), F.struct("step", "level"))
    chosen = levelled.withColumn("chosen", F.min(fits).over(everything)["level"])
    target = F.least("limit", F.coalesce(F.col("weight") * F.col("chosen"), F.col("limit")))
    return chosen.select("source", "source_size", target.alias("target"))


def _fold(seed: int, level: int) -> str:
    """SQL of the fold over `items`: a state of the document held, with mass left, and those done.

    Mass is moved in words: what one document gives, in shares times its size, the other takes.
    One of the two becomes integral; which way the mass goes is drawn so that both keep their
    expected shares.
    """
    draw = (
        f"cast(shiftrightunsigned(xxhash64(h.doc_id, h.size, h.mark, x.doc_id, x.size, x.mark, {seed}, {level}), 11) as double)"
        " / 9007199254740992D"
    )
    # up: words that h can take from x; down: words that h can give to x.
    room = (
        "struct(least((1 - h.mass) * h.size, x.mass * x.size) as up,"
        " least(h.mass * h.size, (1 - x.mass) * x.size) as down)"
    )
    moved = f"if(({draw}) * (r.up + r.down) < r.down, r.up, -r.down)"
    after = (
        "struct(h.mass + m / h.size as h, x.mass - m / x.size as x)"
    )

    def with_mass(item: str, mass: str) -> str:
        return "named_struct(" + ", ".join(f"'{f}', {item}.{f}" for f in _FIELDS) + f", 'mass', {mass})"

    integral = f"(a.{{0}} < {EPS} or a.{{0}} > 1 - {EPS})"
    h_done, x_done = integral.format("h"), integral.format("x")
    no_item, no_items = f"cast(null as {_ITEM})", f"cast(array() as array<{_ITEM}>)"
    next_state = f"""named_struct(
        'held', case when not {h_done} then {with_mass('h', 'a.h')} when not {x_done} then {with_mass('x', 'a.x')}
                else {no_item} end,
        'done', concat(s.done,
            if({h_done}, array({with_mass('h', 'round(a.h)')}), {no_items}),
            if({x_done}, array({with_mass('x', 'round(a.x)')}), {no_items})))"""
    bound = f"transform(array({after}), a -> {next_state})[0]"
    bound = f"transform(array({moved}), m -> {bound})[0]"
    bound = f"transform(array({room}), r -> {bound})[0]"
    bound = f"transform(array(s.held), h -> {bound})[0]"
    return f"""aggregate(items, named_struct('held', {no_item}, 'done', {no_items}),
        (s, x) -> if(s.held is null, named_struct('held', x, 'done', s.done), {bound}))"""


def _trimmed(seed: int) -> str:
    """SQL of the end of a source: the document still held is rounded by a draw, and documents of
    this last block, largest first, change their copy where that brings the words taken nearer."""
    draw = (
        f"cast(shiftrightunsigned(xxhash64(h.doc_id, h.size, h.mark, {seed}), 11) as double) / 9007199254740992D < h.mass"
    )
    rounded = f"h.mass - cast({draw} as double)"
    owed = f"coalesce(transform(array(state.held), h -> ({rounded}) * h.size)[0], 0D)"
    last = f"transform(filter(array(state.held), h -> h is not null), h -> h_set(h, cast({draw} as double)))"

    def with_mass(item: str, mass: str) -> str:
        return "named_struct(" + ", ".join(f"'{f}', {item}.{f}" for f in _FIELDS) + f", 'mass', {mass})"

    last = last.replace(f"h_set(h, cast({draw} as double))", with_mass("h", f"cast({draw} as double)"))
    every = (
        f"array_sort(concat(state.done, {last}), (p, q) -> case when p.size > q.size then -1"
        " when p.size < q.size then 1 when p.doc_id < q.doc_id then -1"
        " when p.doc_id > q.doc_id then 1 when p.mark < q.mark then -1 when p.mark > q.mark then 1 else 0 end)"
    )
    change = "(if(x.mass > 0.5, -1D, 1D) * x.size)"
    turn = f"abs(s.owed - {change}) < abs(s.owed)"
    return f"""aggregate({every}, named_struct('owed', {owed}, 'done', cast(array() as array<{_ITEM}>)),
        (s, x) -> if({turn},
            named_struct('owed', s.owed - {change}, 'done', concat(s.done, array({with_mass('x', '1D - x.mass')}))),
            named_struct('owed', s.owed, 'done', concat(s.done, array(x))))).done"""


def mixed_units(docs: DataFrame, seed: int = 7, **shares: object) -> DataFrame:
    """One row per distinct (doc_id, source, size, mark), the mark being a hash of the text: how often it
    repeats (`many`), the source's size and target, and what the mix takes: `whole` copies of each of
    its rows and one more of `extra` of them.

    Every document of a source has the same expected copies, target / size of the source: a whole
    part, and a fraction that is rounded dependently. Of the fractions of rows that repeat, those that
    add up to whole copies are settled at once; the rest is that of one row. Fractions meet in blocks of about BLOCK
    documents, each folded to at most one document with mass left; those left over meet again in
    blocks, a reduction tree of a few levels. The last block per source ends with one draw, and where
    another choice for one of its documents brings the words taken nearer to the target, it is made.
    A source so misses its target by less than one document, as a rule by a small one. Draws are hashes of ids, so
    reruns agree on any cluster.
    """
    sized = landed(docs.select("doc_id", "source", word_count("text").alias("size"), F.xxhash64("text").alias("mark")), "sizes")
    targets = landed(source_targets(sized, **shares), "targets")
    share = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    units = (
        sized.groupBy("doc_id", "source", "size", "mark")
        .agg(F.count("*").alias("many"))
        .join(targets.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
        .drop("s")
        .withColumn("share", share)
        .withColumn("whole", F.floor(F.col("share") + EPS))
        .withColumn("part", F.greatest(F.col("share") - F.col("whole"), F.lit(0.0)) * F.col("many"))
        .withColumn("extra", F.floor(F.col("part") + EPS))
        .withColumn("mass", F.greatest(F.col("part") - F.col("extra"), F.lit(0.0)))
    )
    item = F.struct(*_FIELDS, "mass").cast(_ITEM)
    settled = (F.col("size") == 0) | (F.col("mass") < EPS)
    units = landed(units.select("source", settled.alias("settled"), item.alias("item")), "units")
    # An item with no mass to place keeps its whole copies.
    done = [units.where("settled").select(F.col("item").withField("mass", F.lit(0.0)).alias("item"))]
    open_ = units.where("not settled").select("source", "item")
    counts = landed(open_.groupBy("source").agg(F.count("*").alias("n")), "counts")
    most = counts.agg(F.max("n")).first()[0] or 0
    level = 0
    while most > 0:
        blocks = F.greatest(F.ceil(F.col("n") / BLOCK), F.lit(1))
        dealt = (
            open_.join(counts.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
            .withColumn("block", F.pmod(F.xxhash64("item.doc_id", "item.size", "item.mark", F.lit(seed + level)), blocks))
            .withColumn("last", blocks == 1)
        )
        key = F.struct(F.xxhash64("item.doc_id", "item.size", "item.mark", F.lit(seed)).alias("r"), F.col("item").alias("item"))
        folded = landed(
            dealt.withColumn("k", key)
            .groupBy("source", "block", "last")
            .agg(F.sort_array(F.collect_list("k")).alias("k"))
            .withColumn("items", F.expr("transform(k, k -> k.item)"))
            .select("source", "last", F.expr(_fold(seed, level)).alias("state")),
            "folded",
        )
        done.append(folded.where("not last").select(F.explode("state.done").alias("item")))
        done.append(folded.where("last").select(F.explode(F.expr(_trimmed(seed))).alias("item")))
        open_ = folded.where("not last and state.held is not null").select("source", F.col("state.held").alias("item"))
        counts = landed(open_.groupBy("source").agg(F.count("*").alias("n")), "counts")
        most = counts.agg(F.max("n")).first()[0] or 0
        level += 1
    every = done[0]
    for part in done[1:]:
        every = every.unionByName(part)
    names = ("doc_id", "source", "size", "mark", "many", "source_size", "target", "whole")
    return every.select(*(f"item.{c}" for c in names), (F.col("item.extra") + F.col("item.mass").cast("long")).alias("extra"))


def mixed_sizes(docs: DataFrame, seed: int = 7, **shares: object) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) for every row of `docs`.

    Null or empty text: size 0, nothing taken. A null source is a source of its own, the last. Rows
    that repeat a document share its copies as evenly as can be. A source without words has target 0.
    An empty table gives an empty result. Other columns are not read.
    """
    units = mixed_units(docs, seed, **shares)
    rows = units.withColumn("row", F.explode(F.sequence(F.lit(1), F.col("many"))))
    copies = F.col("whole") + (F.col("row") <= F.col("extra")).cast("long")
    return rows.select("doc_id", "source", "size", "source_size", "target", (copies * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame, seed: int = 7, **shares: object) -> DataFrame:
    """The rows of `docs`, each as often as the mix takes it; columns as in `docs`.

    Empty documents hold no words, so none of their rows is taken.
    """
    keys = ["doc_id", "source", "size", "mark"]
    units = landed(mixed_units(docs, seed, **shares).where("size > 0 and whole + extra > 0").select(*keys, "many", "whole", "extra"), "mix")
    rows = docs.select(
        F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("row"),
        F.col("doc_id"), F.col("source"), word_count("text").alias("size"), F.xxhash64("text").alias("mark"),
    )

    def met(some: DataFrame) -> DataFrame:
        same = [rows[k].eqNullSafe(some[k]) for k in keys]
        return rows.join(some, same[0] & same[1] & same[2] & same[3]).select("row", *(some[c] for c in some.columns))

    # Of rows that repeat, some may take one copy more than the others.
    uneven = (F.col("extra") > 0) & (F.col("extra") < F.col("many"))
    even = met(units.where(~uneven)).select("row", (F.col("whole") + (F.col("extra") > 0).cast("long")).alias("copies"))
    taken = even if units.where(uneven).isEmpty() else even.unionByName(_dealt(landed(met(units.where(uneven)), "uneven"), keys))
    return taken.where("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


def _dealt(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(row, copies) of landed rows that repeat: the first `extra` of a unit, counted along the files, take
    one copy more. No window holds more than a file's rows or a unit's files."""
    meta = rows.metadataColumn("_metadata")
    placed = rows.select("*", meta["file_name"].alias("file"), meta["row_index"].alias("at"))
    along = Window.partitionBy(*keys).orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy(*keys, "file").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(along), F.lit(0)))
    files = counts.select(*(F.col(k).alias(f"_{k}") for k in keys), F.col("file").alias("_file"), "before")
    same = placed["file"] == files["_file"]
    for k in keys:
        same = same & placed[k].eqNullSafe(files[f"_{k}"])
    place = F.col("before") + F.row_number().over(Window.partitionBy(*keys, "file").orderBy("at"))
    return placed.join(files, same).select("row", (F.col("whole") + (place <= F.col("extra")).cast("long")).alias("copies"))
