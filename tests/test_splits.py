"""Pairing inside splits: what is exchanged, tables of splits too large to be broadcast, changed splits."""

import random

import pytest

from chatloom.operators import lines
from chatloom.sources import json_lists, readers, splits


@pytest.fixture
def small_splits(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "600")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def made(tmp_path):
    rng = random.Random(2)
    want = {}
    for name in ("a", "b", "c"):
        texts = [f"{name}{i} " + "x" * rng.choice([0, 3, 90, 1500]) for i in range(rng.choice([61, 60]))]
        out = []
        for t in texts:  # blank lines and comments in between, some splits hold nothing else
            out += [t] + ["# c" * 60 if rng.random() < 0.5 else " "] * rng.choice([0, 1, 12])
        (tmp_path / f"{name}.txt").write_text("\n".join(out) + "\n")
        want[name] = texts
    return want


def pairs(spark, path):
    content = lines.drop_comment_lines(lines.drop_empty_lines(readers.scan_lines(spark, str(path))))
    return lines.pair_lines(content)


def check(found, want):
    got = {}
    for r in found.orderBy("source_path", "pair_no").collect():
        got.setdefault(r.source_path[-5], []).append((r.pair_no, r.user, r.assistant))
    strip = [(n, [t.strip() for t in texts] + [None]) for n, texts in want.items()]
    assert got == {n: [(k, t[2 * k], t[2 * k + 1]) for k in range(len(t) // 2)] for n, t in strip}


@pytest.mark.parametrize("most", [splits.FACT_BYTES, 0])
def test_pairs_over_many_splits(spark, tmp_path, monkeypatch, small_splits, most):
    monkeypatch.setattr(splits, "FACT_BYTES", most)
    want = made(tmp_path)
    found = pairs(spark, tmp_path)
    assert readers.scan_lines(spark, str(tmp_path)).rdd.getNumPartitions() > 30
    check(found, want)


def test_only_edge_lines_are_exchanged(spark, tmp_path, small_splits):
    made(tmp_path)
    plan = pairs(spark, tmp_path)._jdf.queryExecution().executedPlan().toString()
    scan = plan[plan.index("MapInArrow") :]
    inside = scan[: scan.index("FileScan text")]
    assert "Exchange hashpartitioning" not in inside and "BroadcastHashJoin" in inside


def test_changed_splits_fail(spark, tmp_path, small_splits):
    made(tmp_path)
    found = pairs(spark, tmp_path)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    with pytest.raises(Exception, match="splits changed"):
        found.collect()


def test_large_lists_without_broadcast(spark, tmp_path, monkeypatch, small_splits):
    (tmp_path / "a.json").write_text("[" + ",".join(f'{{"n":{i},"t":"}}{{"}}' for i in range(200)) + "]")
    monkeypatch.setattr(splits, "FACT_BYTES", 0)
    found = json_lists.scan_large_json(spark, str(tmp_path), 0, readers.DataOptions())
    assert sorted((r.record_no, r.n) for r in found.selectExpr("record_no", "variant_get(record, '$.n', 'long') AS n").collect()) == [(i, i) for i in range(200)]
