"""Redaction by a table of secrets against one regular expression of all of them."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from chatloom.operators import secrets as sc
from chatloom.operators.governance import redact_literal


def want(text, secrets):
    known = sorted({s for s in secrets if s}, key=lambda s: (-len(s), s))
    return text if text is None or not known else re.sub("|".join(map(re.escape, known)), "***", text)


def draw(rng):
    kind = rng.random()
    if kind < 0.4:
        return "".join(rng.choice("ab*é") for _ in range(rng.randint(1, 5)))
    return "sk-" + "".join(rng.choice("0123456789abcdef") for _ in range(rng.choice([1, 2, 3, 20, 61, 130])))


@pytest.mark.parametrize("most", [sc.SECRET_BYTES, 0])
def test_table_equals_one_expression(spark, most):
    rng = random.Random(most)
    secrets = [draw(rng) for _ in range(150)] + [None, "", "sk-1", "sk-10", "x\ny"]
    lines = [(None, "a"), ("", "b"), ("sk-10 sk-1 x\ny", "c")]
    for _ in range(400):
        words = [rng.choice(secrets) or "" if rng.random() < 0.5 else draw(rng) for _ in range(rng.randint(0, 8))]
        lines.append((rng.choice(["", " ", "é"]).join(words), None))
    df = spark.createDataFrame([(t, x, i) for i, (t, x) in enumerate(lines)], "line string, text string, spots int").repartition(3)
    table = spark.createDataFrame([(s, 1) for s in secrets * 2], "secret string, key int")
    found = sc.redact_table(df, table, secret_bytes=most)
    assert found.columns == df.columns
    assert sorted((r.spots, r.line, r.text) for r in found.collect()) == [(i, want(t, secrets), x) for i, (t, x) in enumerate(lines)]
    small = tuple(s for s in secrets if s)
    plain = df.select("spots", redact_literal(F.col("line"), small).alias("line"))
    assert found.select("spots", "line").exceptAll(plain).count() == 0


def test_no_secret_and_no_line(spark):
    lines = spark.createDataFrame([("a b",)], "line string")
    none = spark.createDataFrame([(None,), ("",)], "s string")
    assert [r.line for r in sc.redact_table(lines, none).collect()] == ["a b"]
    for most in (sc.SECRET_BYTES, 0):
        some = spark.createDataFrame([("a",)], "s string")
        assert sc.redact_table(lines.limit(0), some, secret_bytes=most).count() == 0
        assert [r.line for r in sc.redact_table(lines, some, secret_bytes=most).collect()] == ["*** b"]


def test_large_table_is_joined_on_what_its_filter_lets_through(spark):
    """200,000 secrets, one of which stands in every line: nothing but the filter goes to the tasks."""
    table = spark.range(200_000).select(F.concat(F.lit("tok_"), F.sha1(F.col("id").cast("string"))).alias("s"))
    hot = "tok_" + "5" * 40
    lines = spark.range(4000).select(
        "id", F.concat_ws(" ", F.lit(hot), F.concat(F.lit("tok_"), F.sha1((F.col("id") * 100).cast("string"))), F.sha2(F.col("id").cast("string"), 256)).alias("line")
    )
    found = sc.redact_table(lines, table.union(spark.createDataFrame([(hot,)], "s string")), secret_bytes=1 << 20)
    expected = F.concat_ws(" ", F.lit("***"), F.when(F.col("id") * 100 < 200_000, F.lit("***")).otherwise(F.concat(F.lit("tok_"), F.sha1((F.col("id") * 100).cast("string")))), F.sha2(F.col("id").cast("string"), 256))
    assert found.exceptAll(lines.select("id", expected.alias("line"))).count() == 0 and found.count() == 4000


def test_filter_scans_blocks_and_misses_nothing(monkeypatch):
    rng = np.random.default_rng(1)
    text = bytes(rng.integers(97, 100, 5000, dtype=np.uint8))
    table = np.full(1 << 12, 255, np.uint8)
    whole = [(n, p.tolist(), k.tolist()) for n, p, _, k in sc.Filter([1, 4, 64], table).hits(np.frombuffer(text, np.uint8), np.array([0, 1000, 5000]))]
    assert [len(p) for _, p, _ in whole] == [5000, 5000 - 6, 5000 - 126]
    monkeypatch.setattr(sc, "BLOCK", 700)
    parts = {}
    for n, p, _, k in sc.Filter([1, 4, 64], table).hits(np.frombuffer(text, np.uint8), np.array([0, 1000, 5000])):
        parts.setdefault(n, ([], []))[0].extend(p.tolist())
        parts[n][1].extend(k.tolist())
    assert [(n, *parts[n]) for n in (1, 4, 64)] == whole
