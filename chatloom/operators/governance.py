"""License audit of model cards, and redaction of secrets."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatloom.functions.records import bind, field, first_truthy, strict_json
from chatloom.functions.text import PY_SPACE, let, pystrip, splitlines
from chatloom.sources.readers import CARD_FILES

# License wording.
RESTRICTIVE_HINTS = (
    "non-commercial",
    "noncommercial",
    "research only",
    "research-only",
    "no commercial",
    "cc-by-nc",
    "cc by-nc",
    "llama 2 community",
    "llama 3 community",
)
PERMISSIVE = ("apache-2.0", "apache 2.0", "mit", "bsd-2-clause", "bsd-3-clause", "apache2")
LICENSE_NAME = rf"(?iu)(apache(?:-|[{PY_SPACE}]*)2\.0|mit|bsd|llama|cc-by[^{PY_SPACE},]*)"
# The same names as whole words only; not the default, since results would differ.
LICENSE_WORD = rf"(?iu)(?<![\p{{L}}\p{{N}}])(apache(?:-|[{PY_SPACE}]*)2\.0|mit|bsd|llama|cc-by[^{PY_SPACE},]*)(?![\p{{L}}\p{{N}}])"
LICENSE_HEAD_LINES, LICENSE_HEAD_CHARS = 8, 80
UNNAMED_LICENSE = "see LICENSE"
MASK, MASK_PREFIX, MASK_MIN = "***", 4, 8
# The warnings, around the license's name.
NO_LICENSE = "No license file or model-card license field was found."
RESTRICTED_LICENSE = ("License `", "` looks non-commercial or restricted. Review before production use.")
UNKNOWN_LICENSE = ("License `", "` was found but commercial use is not auto-classified. Read the model card.")


def _front_lines(text: Column) -> Column:
    """``array<struct<key, value>>`` of the block between a leading ``---`` and the next one."""
    rest = F.substring(text, 4, 2**31 - 1)
    block = F.when(
        F.startswith(text, F.lit("---")) & F.contains(rest, F.lit("---")), F.substring_index(rest, "---", 1)
    )
    pairs = F.filter(splitlines(block), lambda x: F.contains(x, F.lit(":")))
    return F.transform(
        pairs,
        lambda x: let(
            F.substring_index(x, ":", 1),
            lambda k: F.struct(
                F.lower(pystrip(k)).alias("key"),
                F.btrim(pystrip(F.substring(x, F.length(k) + 2, F.length(x))), F.lit("\"'")).alias("value"),
            ),
        ),
    )


def front_matter(cards: DataFrame, text: str = "text") -> DataFrame:
    """``key, value`` rows of each card's front matter; the last of equal keys wins."""
    numbered = F.transform(
        _front_lines(F.col(text)), lambda p, i: F.struct(p["key"].alias("key"), i.alias("i"), p["value"].alias("value"))
    )
    last = let(
        F.sort_array(numbered),
        lambda a: F.filter(a, lambda p, i: F.coalesce(F.get(a, i + 1)["key"] != p["key"], F.lit(True))),
    )
    keys = [c for c in cards.columns if c != text]
    return cards.select(*keys, F.explode(last).alias("p")).select(
        *keys, F.col("p.key").alias("key"), F.col("p.value").alias("value")
    )


def front_matter_value(text: Column, key: str) -> Column:
    """Value of one front matter key, or null."""
    return let(
        F.filter(_front_lines(text), lambda p: p["key"] == key), lambda a: F.try_element_at(a, F.lit(-1))["value"]
    )


def license_from_text(text: Column, whole_words: bool = False) -> Column:
    """License named in the first lines of a license text, else the start of those lines."""
    pattern = LICENSE_WORD if whole_words else LICENSE_NAME
    head = F.array_join(F.slice(splitlines(text), 1, LICENSE_HEAD_LINES), " ")

    def name(h: Column) -> Column:
        start = pystrip(F.left(h, F.lit(LICENSE_HEAD_CHARS)))
        return F.when(h.rlike(pattern), F.regexp_extract(h, pattern, 1)).when(start != "", start).otherwise(
            F.lit(UNNAMED_LICENSE)
        )

    return let(head, name)


def license_from_config(text: str) -> Column:
    """License key of a JSON object; null for bad JSON or no such key. ``text`` is a column name."""
    return F.expr(bind(strict_json(text), "v", first_truthy(field("v", "license"))))


def license_of_file(file: str = "file", text: str = "text") -> Column:
    """What one file says about the license; null lets the next file speak."""
    name = F.lower(file)
    said = F.when(F.startswith(name, F.lit("readme")), front_matter_value(F.col(text), "license")).when(
        F.startswith(name, F.lit("license")), license_from_text(F.col(text))
    ).when(F.col(file) == "configuration.json", license_from_config(text))
    return F.when(said != "", said)


def pick_license_source(cards: DataFrame, key: str = "model_id") -> DataFrame:
    """``license, source_file`` per model from the first file, in fixed order, that names one."""
    order = F.array_position(F.array(*[F.lit(f) for f in CARD_FILES]), F.col("file"))
    spoken = cards.filter(F.col("file").isin(*CARD_FILES)).select(
        key,
        "file",
        order.alias("_order"),
        F.explode(F.array(license_of_file())).alias("license"),
    )
    # The smallest (order, ...) among the files that speak, combined before the shuffle.
    best = F.min(F.when(F.col("license").isNotNull(), F.struct("_order", "license", "file")))
    return spoken.groupBy(key).agg(best.alias("_b")).select(
        key, F.col("_b.license").alias("license"), F.col("_b.file").alias("source_file")
    )


def classify_license(name: Column) -> Column:
    """``commercial_ok``: false if restricted, true if permissive, null if unknown."""
    low = F.lower(name)
    restricted = F.lit(False)
    for hint in RESTRICTIVE_HINTS:
        restricted = restricted | F.contains(low, F.lit(hint))
    restricted = restricted | low.rlike(rf"(?:^|[{PY_SPACE}])nc(?:\z|[{PY_SPACE}])")
    return F.when(restricted, F.lit(False)).when(low.isin(*PERMISSIVE) | F.contains(low, F.lit("apache")), F.lit(True))


def license_warning(name: Column, commercial_ok: Column) -> Column:
    def around(told: tuple[str, str]) -> Column:
        return F.concat(F.lit(told[0]), name, F.lit(told[1]))

    return (
        F.when(name.isNull(), NO_LICENSE)
        .when(~commercial_ok, around(RESTRICTED_LICENSE))
        .when(commercial_ok.isNull(), around(UNKNOWN_LICENSE))
    )


def license_report(cards: DataFrame, key: str = "model_id") -> DataFrame:
    picked = pick_license_source(cards, key)
    judged = picked.withColumn("commercial_ok", classify_license(F.col("license")))
    return judged.withColumn("warning", license_warning(F.col("license"), F.col("commercial_ok")))


def license_gate(reports: DataFrame, strict: bool = True) -> DataFrame:
    """Strict mode drops what is known to be restricted; the unknown passes."""
    return reports.filter(F.coalesce("commercial_ok", F.lit(True))) if strict else reports


def redact_literal(text: Column, secrets: tuple[str, ...]) -> Column:
    """Replace every secret by the mask in one pass; where several begin, the longest counts."""
    literal = [re.escape(s) for s in sorted({s for s in secrets if s}, key=lambda s: (-len(s), s))]
    return F.regexp_replace(text, F.lit("|".join(literal)), F.lit(MASK)) if literal else text


def mask_secret(value: Column) -> Column:
    """A long value keeps a short prefix, a short one nothing."""
    return F.when(F.length(value) <= MASK_MIN, F.lit(MASK)).otherwise(
        F.concat(F.left(value, F.lit(MASK_PREFIX)), F.lit(MASK))
    )


# Parts of a setting's or argument's name that make its value a secret.
_SECRET_NAME = r"(?i)(token|api[_-]?key|secret|password)"
_SECRET_FLAG = r"(?i)^--?[a-z0-9_-]*(token|api[_-]?key|secret|password)$"


def redact_settings(settings: DataFrame, key: str = "key", value: str = "value") -> DataFrame:
    secret = F.col(key).rlike(_SECRET_NAME) & (F.col(value) != "")
    return settings.withColumn(value, F.when(secret, mask_secret(F.col(value))).otherwise(F.col(value)))


def redact_args(args: Column) -> Column:
    """Mask the value after a secret flag, and the value of ``--flag=value``."""

    def one(x: Column, i: Column) -> Column:
        flag = F.substring_index(x, "=", 1)
        before = F.when(i > 0, F.get(args, i - 1))
        return (
            F.when(F.contains(x, F.lit("=")) & flag.rlike(_SECRET_FLAG), F.concat(flag, F.lit("=" + MASK)))
            .when(F.coalesce(before.rlike(_SECRET_FLAG), F.lit(False)), F.lit(MASK))
            .otherwise(x)
        )

    return F.transform(args, one)
