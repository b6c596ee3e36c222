"""Fill-in-middle, streaming exact dedup and importance resampling against brute force and SQL."""

import glob
import hashlib
import math
import os
import re
from collections import Counter, defaultdict
from zlib import crc32

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from chatloom.llm import exact, importance, middle
from chatloom.llm.queries import ORACLES, QUERIES

UNITS = re.compile("[\x20\x09-\x0d]*[^\x20\x09-\x0d]+|[\x20\x09-\x0d]+")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    found = QUERIES[name](spark, sf_dir)
    columns = sorted(found.columns)
    cursor = con.execute(ORACLES[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == columns
    want = sorted(tuple(str(r[names.index(c)]) for c in columns) for r in cursor.fetchall())
    assert sorted(tuple(str(r[c]) for c in columns) for r in found.collect()) == want


# --- fill in the middle -----------------------------------------------------------------------


def cut(doc_id, text, seed=42, plain=50, spm=80):
    """The rule on a list of tokens, without chunks."""
    units = UNITS.findall(text)
    h = hashlib.sha256(f"{seed}:{doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= 100 - plain:
        return len(units), "plain", None, None, text
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < spm:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


texts = st.text(alphabet="ab \n\té漢\U0001f600<>PSM\x0b\xa0", max_size=60).flatmap(
    lambda t: st.sampled_from([t, t * 40, " " * 300 + t * 20, t * 5 + "x" * 9000])
)


@settings(max_examples=300, deadline=None)
@given(st.integers(0, 10**6), texts, st.sampled_from([50, 0]))
def test_cuts_equal_those_of_a_token_list(doc_id, text, plain):
    want = cut(doc_id, text, plain=plain)
    got = middle.transformed(doc_id, text.encode(), middle.Memo(), 42, plain, 80)
    assert (*got[:4], got[4].decode()) == want
    assert middle.restored(got[4], got[1]) == text.encode()


def prose(seed, n):
    return " ".join("w%d" % x for x in np.random.default_rng(seed).integers(0, 5000, n)).encode()


def test_chunks_follow_the_content():
    shared = prose(1, 3000)
    a, b = prose(2, 500) + shared + prose(3, 500), prose(4, 90) + shared
    pieces = lambda t: [t[i:j] for i, j in zip([0, *middle.chunk_ends(t)], middle.chunk_ends(t))]
    assert b"".join(pieces(a)) == a
    both = set(pieces(a)) & set(pieces(b))
    assert sum(map(len, both)) > 0.8 * len(shared)
    sizes = [len(x) for x in pieces(a)[:-1]]
    assert min(sizes) >= middle.LEAST and max(sizes) <= middle.MOST
    # Blocks of the hashing do not show.
    long = prose(5, 400_000)
    ends = middle.chunk_ends(long)
    block, middle.BLOCK = middle.BLOCK, 10_000
    try:
        assert middle.chunk_ends(long) == ends
    finally:
        middle.BLOCK = block


def test_memo_only_saves_work():
    data = [prose(i % 7, 2000) for i in range(30)]
    wide, narrow = middle.Memo(), middle.Memo(limit=0)
    a = [middle.transformed(i, t, wide, 42, 50, 80) for i, t in enumerate(data)]
    b = [middle.transformed(i, t, narrow, 42, 50, 80) for i, t in enumerate(data)]
    assert a == b and wide.hits > 15 * 10 and wide.hits > narrow.hits


@pytest.mark.parametrize("data", [b"a" * 3_000_000, b" " * 3_000_000, b"a " * 1_500_000, bytes(range(256)) * 9000])
def test_hostile_texts(data):
    got = middle.transformed(3, data, middle.Memo(), 42, 0, 80)
    assert got[0] == len(data.split()) + (data[-1] in middle.SPACE)
    assert middle.restored(got[4], got[1]) == data


def test_fill_in_middle_edges(spark):
    rows = [(1, "a b c", "x", 9), (1, "a b c", "x", 9), (2, None, None, None), (3, "", "x", 1), (None, "one two three", "x", 1), (4, "has <S> mark", "x", 1), (5, " \n ", "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, form string, n int")
    docs = docs.unionByName(spark.range(1).selectExpr("6L AS doc_id", "cast(X'61FF2062' AS string) AS text", "'x' AS form", "1 AS n"))
    for plain in (50, 0):
        found = middle.unfilled(middle.fill_in_middle(docs, plain=plain))
        assert found.columns == ["doc_id", "text", "n", "form", "prefix_chars", "middle_chars", "output", "restored"]
        assert found.where("coalesce(text, '') <> restored").count() == 0
        got = sorted((str(r.doc_id), r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in found.where("doc_id is null or doc_id < 6").collect())
        want = [(i, *cut("" if i is None else i, t or "", plain=plain)) for i, t, _, _ in rows]
        assert got == sorted((str(w[0]), *w[1:]) for w in want)
    assert middle.fill_in_middle(docs.limit(0)).count() == 0


# --- exact dedup ------------------------------------------------------------------------------


def save(spark, rows, path, schema="doc_id long, text string, digest string, n int, key long", **kw):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def groups(rows):
    same = defaultdict(list)
    for i, text, *_ in rows:
        same[text or ""].append(i)
    largest = {t: max((i for i in ids if i is not None), default=None) for t, ids in same.items()}
    return Counter((i, largest[t or ""], len(same[t or ""])) for i, t, *_ in rows)


ROWS = [(1, "a", "q", 1, 1), (2, "b", "q", 1, 1), (3, "a", "q", 1, 1), (4, None, "q", 1, 1), (5, "", None, None, None), (None, "b", "q", 1, 1), (None, "z", "q", 1, 1), (None, "z", "q", 1, 1), (6, "A", "q", 1, 1), (7, "a ", "q", 1, 1), (8, "x" * 300_000, "q", 1, 1), (9, "x" * 300_000, "q", 1, 1), (9, "x" * 300_000, "q", 1, 1)]


def check(found, rows):
    got = found.collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size) for r in got) == groups(rows)
    kept = Counter((r.keep_id, r.group_size) for r in got if r.kept)
    texts = {}
    for i, t, *_ in rows:
        texts.setdefault(t or "", []).append(i)
    assert sum(kept.values()) == len(texts) and all(r.doc_id == r.keep_id for r in got if r.kept)


def test_streaming_dedup_edges(spark, tmp_path):
    path = str(tmp_path / "docs.parquet")
    save(spark, ROWS, path)
    check(exact.exact_groups(spark, path), ROWS)
    left = exact.deduplicated(spark, path)
    assert left.columns == ["doc_id", "text", "digest", "n", "key"]
    assert Counter(r.text or "" for r in left.collect()) == Counter({t or "" for _, t, *_ in ROWS})
    empty = str(tmp_path / "empty.parquet")
    spark.createDataFrame([], "doc_id long, text string").write.parquet(empty)
    assert exact.exact_groups(spark, empty).count() == 0 and exact.deduplicated(spark, empty).count() == 0


def test_state_lasts_and_takes_new_files_only(spark, tmp_path):
    path, state = str(tmp_path / "docs.parquet"), str(tmp_path / "state")
    save(spark, ROWS, path)
    check(exact.exact_groups(spark, path, state), ROWS)
    more = [(20, "a", "q", 1, 1), (21, "new", "q", 1, 1), (22, "new", "q", 1, 1)]
    save(spark, more, path)
    check(exact.exact_groups(spark, path, state, files_per_batch=1), ROWS + more)
    entries = {r.n for r in exact.entries_of(spark, state).collect()}
    assert entries == {n for _, _, n in groups(ROWS + more)}
    check(exact.exact_groups(spark, path, state), ROWS + more)  # nothing new


def test_texts_that_share_a_digest_are_told_apart(spark, tmp_path):
    path = str(tmp_path / "docs.parquet")
    save(spark, ROWS, path)
    check(exact.exact_groups(spark, path, digest=lambda text: F.substring(exact.sha256(text), 1, 0)), ROWS)
    check(exact.exact_groups(spark, path, digest=lambda text: exact.sha256(F.substring(text, 1, 1))), ROWS)


def test_texts_meet_by_shuffle_where_keys_are_many(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "docs.parquet")
    save(spark, ROWS, path)
    monkeypatch.setattr(exact, "KEY_BYTES", 0)
    check(exact.exact_groups(spark, path), ROWS)


# --- importance resampling --------------------------------------------------------------------


def brute_weights(docs, target, longest, buckets, seed):
    words = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))

    def found(t):
        w = words(t)
        return [crc32(" ".join(w[i : i + k]).encode()) % buckets for k in range(1, longest + 1) for i in range(len(w) - k + 1)]

    s, t = (Counter(b for x in side for b in found(x)) for side in ([x for _, x in docs], target))
    S, T = sum(s.values()) + buckets, sum(t.values()) + buckets
    out = []
    for i, text in docs:
        f = found(text)
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * float(S) / ((s[b] + 1) * float(T)))) for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(words(text)), len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))))
    return out


DOCS = [(i, f"Word{i % 7} über alles! {'the cat-sat on ' * (i % 9)}9 lives") for i in range(60)] + [(None, "the cat " * 15)] * 3 + [(5, "x"), (7, None), (8, ""), (9, " .,; ")]
TARGET = ["the cat sat", None, "", "lives 9"]


@pytest.mark.parametrize("longest", [1, 3])
def test_resampling_equals_brute_force(spark, longest):
    docs = spark.createDataFrame([(i, t, "q", 1) for i, t in DOCS], "doc_id long, text string, score string, rank int").repartition(5)
    target = spark.createDataFrame([(t,) for t in TARGET], "text string")
    got = importance.resampled(docs, target, share=30, least_words=10, longest=longest, buckets=97).collect()
    want = brute_weights(DOCS, TARGET, longest, 97, 2024)
    assert Counter((r.doc_id, r.n_words, r.n_features, r.weight, r.score) for r in got) == Counter(want)
    able = sorted((-s, i is None, i or 0) for i, n, _, _, s in want if n >= 10)
    drawn = sorted((r.rank, -r.score, r.doc_id is None, r.doc_id or 0) for r in got if r.rank is not None)
    assert [d[0] for d in drawn] == list(range(1, len(able) * 30 // 100 + 1))
    assert [d[1:] for d in drawn] == able[: len(drawn)]


def test_pieces_of_long_texts_join_their_runs():
    text = " ".join(f"w{i % 1000}" for i in range(400_000)).encode()
    parts = list(importance.feature_buckets(text, 3, importance.Buckets(997)))
    assert len(parts) > 1 and sum(n for n, _ in parts) == 400_000
    assert sum(len(b) for _, b in parts) == 400_000 + 399_999 + 399_998


def test_resampling_edges(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    none = spark.createDataFrame([], "text string")
    assert importance.resampled(docs.limit(0), none).count() == 0
    assert importance.resampled(docs, none, share=0).where("rank is not null").count() == 0
    whole = importance.resampled(docs, none, share=100, least_words=0)
    assert sorted(r.rank for r in whole.collect()) == list(range(1, len(DOCS) + 1))
    bad = spark.range(3).selectExpr("id AS doc_id", "cast(X'61FF2062' AS string) AS text")
    assert [r.n_words for r in importance.resampled(bad, none).collect()] == [2, 2, 2]


def test_ranks_of_equal_rows(spark):
    """A third of the rows are the same: they are cut into segments by their places, and all get ranks."""
    rows = spark.range(30_000).selectExpr("CASE WHEN id % 3 = 0 THEN 7 ELSE id END AS doc_id", "CASE WHEN id % 3 = 0 THEN 50L ELSE pmod(hash(id), 101) END AS score")
    got = importance.ranked(rows.repartition(6), 20_000, segment_rows=1000).cache()
    ranks = sorted(r.rank for r in got.select("rank").collect() if r.rank is not None)
    assert ranks == list(range(1, 20_001)) and got.count() == 30_000
    keys = [(-r.score, r.doc_id) for r in got.where("rank is not null").orderBy("rank").collect()]
    assert keys == sorted((-r.score, r.doc_id) for r in rows.collect())[:20_000]
    got.unpersist()
