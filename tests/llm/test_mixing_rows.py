"""Mixing of rows that repeat an id, a text or both, and of tables whose columns bear the operator's names."""

from collections import Counter, defaultdict

import pytest

from chatloom.llm import mixing

SCHEMA = "doc_id long, text string, source string, _size long, _copy int, copies string, row string, mark int, n_chars long"


def words(n, k=0):
    return " ".join(f"w{k}x{i}" for i in range(n))


def frame(spark, rows):
    return spark.createDataFrame([(i, t, s, 1, 2, "c", "r", 3, None) for i, t, s in rows], SCHEMA)


TABLES = {
    "other texts": [(None, words(50, k), "a") for k in range(1000)],
    "same rows": [(5, words(50), "a")] * 1000,
    "beside others": [(None, words(50, k), "a") for k in range(500)] + [(3, words(50), "b")] * 300 + [(k, words(40, k), "c") for k in range(400)],
    "null source": [(1, words(30), None)] * 101 + [(2, words(30), "z")] * 77 + [(None, None, "z")] * 5,
}


@pytest.mark.parametrize("name", sorted(TABLES))
def test_repeated_rows_come_near_the_target(spark, name):
    docs = frame(spark, TABLES[name]).repartition(7)
    rows = mixing.mixed_sizes(docs).collect()
    assert len(rows) == len(TABLES[name])
    per = defaultdict(list)
    for r in rows:
        per[r.source].append(r)
        assert r.taken <= 2 * r.size and (r.size == 0 or r.taken % r.size == 0)
    for some in per.values():
        assert abs(sum(r.taken for r in some) - some[0].target) <= max(r.size for r in some)
    assert Counter((r.doc_id, r.source, r.size, r.taken) for r in mixing.mixed_sizes(docs).collect()) == Counter((r.doc_id, r.source, r.size, r.taken) for r in rows)


@pytest.mark.parametrize("name", sorted(TABLES))
def test_documents_come_as_often_as_their_sizes_say(spark, name):
    docs = frame(spark, TABLES[name]).repartition(7)
    want, got = defaultdict(int), defaultdict(int)
    for r in mixing.mixed_sizes(docs).collect():
        want[r.doc_id, r.source] += r.taken
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    for r in mixed.collect():
        got[r.doc_id, r.source] += len(r.text.split())
        assert tuple(r)[3:] == (1, 2, "c", "r", 3, None)
    assert got == {k: n for k, n in want.items() if n}
