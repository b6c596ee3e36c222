"""The registered queries of this folder, each over its whole table, and their comparison SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatloom.llm import (
    exact,
    importance,
    licences,
    line_dedup,
    middle,
    mixing,
    packing,
    ppm,
    quality,
    spotsigs,
    template,
    tensored,
    zipwarc,
)
from chatloom.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer_path() -> str:
    """The byte-level BPE vocabulary of the packing queries."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_pairwise_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What line dedup leaves of every document."""
    return line_dedup.line_dedup(table(spark, sf_dir, "documents")).select(
        "doc_id",
        "n_lines",
        "n_removed",
        F.length("text").cast("long").alias("n_chars_left"),
        F.sha2("text", 256).alias("text_sha256"),
        "partners",
    )


def op2_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SpotSigs fingerprints of every document and of its edited text."""
    return spotsigs.edited_fingerprints(table(spark, sf_dir, "documents"))


def op3_template_deduction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return template.extracted(table(spark, sf_dir, "pages"))


def op4_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence families found in the paragraphs of every document."""
    return licences.licence_scan(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_paragraphs", "family", "probability", "likeness", "families", "unknown_paragraphs"
    )


def op5_tensored_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of near-duplicates over all documents."""
    return tensored.near_duplicates(table(spark, sf_dir, "documents"))


def op6_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every document under a byte trie and under single words."""
    return ppm.scored(table(spark, sf_dir, "documents"))


def op7_zip_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to web archives in ZIP packages and read back."""
    return zipwarc.archived(table(spark, sf_dir, "pages"))


def op8_dominance_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 2048 tokens."""
    return packing.packed(table(spark, sf_dir, "documents"), tokenizer_path(), special=True)


def op9_pivotal_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix of sources takes of every document."""
    return mixing.mixed_sizes(table(spark, sf_dir, "documents"))


def op10_distribution_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and the verdict of the language references for every document."""
    return quality.quality_rules(table(spark, sf_dir, "documents")).select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
        "class_distance",
        "word_distance",
    )


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document cut into prefix, middle and suffix, and put together again."""
    made = middle.unfilled(middle.fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text"))
    return made.select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
        F.sha2(F.col("restored").cast("binary"), 256).alias("restored_sha256"),
    )


def op12_streaming_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal documents by the state of a stream over the table's files."""
    return exact.exact_groups(spark, f"{sf_dir}/documents.parquet").select(
        "doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256")
    )


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents drawn by their likeness to the benchmark's texts."""
    docs, target = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return importance.resampled(docs, target).select("doc_id", "n_features", "weight", "score", "rank")


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_pairwise_alignment,
        op2_spotsigs,
        op3_template_deduction,
        op4_licence_scan,
        op5_tensored_minhash,
        op6_ppm,
        op7_zip_archives,
        op8_dominance_packing,
        op9_pivotal_mixing,
        op10_distribution_divergence,
        op11_fill_in_middle,
        op12_streaming_dedup,
        op13_importance_resampling,
    )
}

# The first ten cannot be said whole in SQL; tests/llm compares each with a brute-force version.
ORACLES: dict[str, str] = {
    "op11_fill_in_middle": r"""WITH cut AS (
      SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h,
        regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u
      FROM documents
    ),
    drawn AS (
      SELECT doc_id, text, u, len(u) AS n, ('0x' || h[1:8])::BIGINT % (len(u) + 1) AS a, ('0x' || h[9:16])::BIGINT % (len(u) + 1) AS b,
        CASE WHEN text = '' OR regexp_matches(text, '<[PSM]>') OR ('0x' || h[17:24])::BIGINT % 100 >= 50 THEN 'plain'
             WHEN ('0x' || h[25:32])::BIGINT % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
      FROM cut
    ),
    parts AS (
      SELECT *, array_to_string(u[1:least(a, b)], '') AS p, array_to_string(u[least(a, b) + 1:greatest(a, b)], '') AS m,
        array_to_string(u[greatest(a, b) + 1:], '') AS s
      FROM drawn
    )
    SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
      sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
      sha256(text) AS restored_sha256
    FROM parts""",
    "op12_streaming_dedup": """SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
      doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
    FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))""",
    # A CRC-32 of every distinct word, by the table of its bytes' remainders.
    "op13_importance_resampling": r"""WITH RECURSIVE bits(i, v, k) AS (
      SELECT range, range::UBIGINT, 0 FROM range(256)
      UNION ALL SELECT i, CASE WHEN v % 2 = 1 THEN xor(v >> 1, 3988292384::UBIGINT) ELSE v >> 1 END, k + 1 FROM bits WHERE k < 8
    ),
    crc AS (SELECT list(v ORDER BY i) AS tab FROM bits WHERE k = 8),
    words AS (
      SELECT 'd' AS side, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM documents
      UNION ALL SELECT 'b', NULL, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) FROM benchmark
    ),
    coded AS (
      SELECT w, xor(list_reduce([('0x' || hex(encode(w))[2 * j - 1:2 * j])::UBIGINT FOR j IN range(1, 1 + octet_length(encode(w)))],
        lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255)::BIGINT + 1]), 4294967295::UBIGINT), 4294967295::UBIGINT) % 10000 AS bucket
      FROM (SELECT DISTINCT w FROM words), crc
    ),
    counted AS (SELECT bucket, count(*) FILTER (WHERE side = 'd') AS s, count(*) FILTER (WHERE side = 'b') AS t FROM words JOIN coded USING (w) GROUP BY bucket),
    gains AS (
      SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * ((SELECT sum(s) FROM counted) + 10000)::DOUBLE / ((s + 1)::DOUBLE * ((SELECT sum(t) FROM counted) + 10000)::DOUBLE)))::BIGINT AS gain
      FROM counted
    ),
    features AS (SELECT doc_id, count(*) AS n, sum(gain)::BIGINT AS total FROM words JOIN coded USING (w) JOIN gains USING (bucket) WHERE side = 'd' GROUP BY doc_id),
    scored AS (
      SELECT d.doc_id, coalesce(n, 0) AS n_features, CASE WHEN n IS NULL THEN 0 ELSE floor(total / n)::BIGINT END AS weight,
        floor(-1000 * ln(-ln((('0x' || sha256('2024:' || d.doc_id)[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS noise
      FROM documents d LEFT JOIN features f USING (doc_id)
    ),
    placed AS (
      SELECT doc_id, n_features, weight, weight + noise AS score, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY weight + noise DESC, doc_id) AS r,
        count(*) FILTER (WHERE n_features >= 20) OVER () AS able
      FROM scored
    )
    SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND r <= 10 * able // 100 THEN r END AS rank FROM placed""",
}
