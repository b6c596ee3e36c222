"""Alignment of lines: what pairs find, gaps full of repeats, line ends and columns with clashing names."""

import random
import time

import pytest

from chatloom.llm.line_dedup import common_blocks, line_dedup, patience


def lines_of(seed, n, words):
    draw = random.Random(seed)
    return [" ".join(f"w{draw.randrange(10**6)}" for _ in range(words)) for _ in range(n)]


def left(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return {r.doc_id: r.text for r in line_dedup(docs).collect()}


def test_documents_that_share_more_than_the_first_owner_has(spark):
    """The first document has the long line only; the third shares the short lines around it with the second."""
    own = lines_of(1, 3, 12)
    long, short = lines_of(2, 1, 25)[0], lines_of(3, 3, 3)
    before = lines_of(4, 2, 4)
    rows = [
        (1, "\n".join([own[0], long])),
        (2, "\n".join([own[1], *before, long, *short])),
        (3, "\n".join([own[2], *before, long, "", *short, "end"])),
        (4, "\n".join([long, *short])),
    ]
    got = left(spark, rows)
    assert got[1] == rows[0][1] and got[2] == "\n".join([own[1], *before, *short])
    assert got[3] == "\n".join([own[2], "", *short, "end"])  # the blank line ends the block with the second
    assert got[4] == ""


def test_line_ends_do_not_tell_lines_apart(spark):
    passage = lines_of(5, 6, 10)
    rows = [(1, "\n".join(passage)), (2, "\r\n".join([*passage, "own"])), (3, "\n".join(f"\t{x}  " for x in [*passage, "mine"]))]
    got = left(spark, rows)
    assert got[1] == rows[0][1] and got[2] == "own" and got[3] == "\tmine  "


def test_columns_with_clashing_names(spark):
    passage = "\n".join(lines_of(6, 4, 10))
    docs = spark.createDataFrame(
        [(1, passage, 5, "a", "k", "p", 7), (2, passage + "\nown", 6, "b", "l", "q", 8)],
        "doc_id long, text string, removed int, _doc string, `a.b` string, partners string, _key int",
    )
    rows = {r.doc_id: r.asDict() for r in line_dedup(docs).collect()}
    assert rows[2]["text"] == "own" and rows[2]["removed"] == 6 and rows[2]["_doc"] == "b"
    assert rows[2]["a.b"] == "l" and rows[2]["partners"] == [1] and rows[2]["n_removed"] == 4 and rows[2]["_key"] == 8


def valid(a, b, pairs):
    assert all(a[i] == b[j] for i, j in pairs)
    assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:], strict=False))


@pytest.mark.parametrize("seed", range(40))
def test_alignments_are_common_subsequences(seed):
    draw = random.Random(seed)
    size = draw.choice([2, 3, 8, 50])
    a, b = ([draw.randrange(size) for _ in range(draw.randrange(60))] for _ in range(2))
    valid(a, b, patience(a, b, {0}))


@pytest.mark.parametrize("seed", range(10))
def test_a_planted_passage_is_aligned_among_repeats(seed):
    """A passage of repeated lines only, in texts that are full of the same lines."""
    draw = random.Random(seed)
    noise = lambda n: [draw.randrange(1, 4) for _ in range(n)]
    passage = [draw.randrange(1, 9) for _ in range(40)]
    a, b = noise(50) + passage + noise(30), noise(20) + passage + noise(70)
    pairs = set(patience(a, b))
    assert sum((50 + k, 20 + k) in pairs for k in range(40)) >= 38
    assert {50 + k for k in range(2, 38)} <= set(common_blocks(a, b, set(), [5] * len(a)))


@pytest.mark.parametrize(
    ("a", "b"),
    [
        ([1] * 20_000, [1] * 15_000),
        ([1, 2] * 10_000, [2, 1, 2] * 7_000),
        ([k % 7 for k in range(20_000)], [k * k % 7 for k in range(20_000)]),
        (random.Random(1).choices(range(5), k=20_000), random.Random(2).choices(range(5), k=20_000)),
        (random.Random(3).choices(range(300), k=20_000), random.Random(4).choices(range(300), k=20_000)),
        ([*range(10_000), *range(10_000)], [*range(9_999, -1, -1), *range(10_000)] * 2),
    ],
    ids=["one line", "two lines", "cycles", "five lines", "many lines", "turned"],
)
def test_repeated_lines_take_near_linear_time(a, b):
    begin = time.perf_counter()
    valid(a, b, patience(a, b))
    assert time.perf_counter() - begin < 15
