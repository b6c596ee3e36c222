"""Every registered query against its SQL on the small tables, and rules on their plans."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from chatloom.plans import ORACLES, QUERIES


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def norm(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    return None if value is None else str(value)


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((v is None, v or "") for v in r))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, sf_dir, duck, name):
    found = QUERIES[name](spark, sf_dir)
    columns = sorted(found.columns)
    rows = [tuple(norm(r[c]) for c in columns) for r in found.collect()]
    assert name in ORACLES
    cursor = duck.execute(ORACLES[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    want = [tuple(norm(r[i]) for i in at) for r in cursor.fetchall()]
    assert ordered(rows) == ordered(want)


def test_entry(spark):
    assert entry.entry(spark).columns == ["conv_id", "n_messages", "text"]
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_plan_gathers_rows_in_one_task(spark, sf_dir, name):
    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    if name not in ("h10_eval_summary",):  # the one global aggregate: a single row of partial sums per task
        assert "SinglePartition" not in plan
