"""The corpus pipeline: quality rules, line dedup, near-dedup, mixing, packing.

Every stage takes (spark, docs, sf_dir) and gives a DataFrame, which run() writes as Parquet in the
shared folder and rereads as the next stage's documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chatloom.llm.common import landed, ready, table
from chatloom.llm.line_dedup import line_dedup
from chatloom.llm.mixing import mixed_documents
from chatloom.llm.packing import packed
from chatloom.llm.quality import quality_rules
from chatloom.llm.queries import tokenizer_path
from chatloom.llm.tensored import near_duplicates

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def carried(docs: DataFrame, *own: str) -> tuple[DataFrame, list[Column]]:
    """`docs` with all columns but the stage's own under names that clash with no result, and the columns
    that bring the names back."""
    names = [c if c in own else f"_carried_{k}" for k, c in enumerate(docs.columns)]
    return docs.toDF(*names), [F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep. Bytes that are no UTF-8 become U+FFFD."""
    ready(spark)
    valid = docs.withColumn("text", F.make_valid_utf8("text"))
    renamed, columns = carried(valid, "doc_id", "text", "lang", "source")
    return quality_rules(renamed).where("kept").select(*columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that earlier ones have; those with no word left go."""
    ready(spark)
    counted = docs.schema["n_chars"].dataType
    renamed, columns = carried(docs, "doc_id", "text", "n_chars")
    left = line_dedup(renamed).where(r"n_removed = 0 or text rlike '[^\\x20\\x09-\\x0D]'")
    return left.withColumn("n_chars", F.length("text").cast(counted)).select(*columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near-duplicates."""
    ready(spark)
    gone = landed(near_duplicates(docs).where("not kept").select("doc_id").distinct(), "gone")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    ready(spark)
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with the place of each in a training sequence."""
    ready(spark)
    return packed(docs, tokenizer_path())


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", quality),
    ("line dedup", lines),
    ("near-dedup", near_dedup),
    ("mixing", mixing),
    ("packing", packing),
]

# SQL can express neither the alignment nor the tokens; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = landed(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"pipeline": run}
ORACLES: dict[str, str] = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
