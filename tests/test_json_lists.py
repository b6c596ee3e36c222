"""Large .json files cut by many tasks against reading each as one value."""

import json
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from chatloom.options import DataOptions
from chatloom.sources import json_lists as jl
from chatloom.sources import readers


def slow_structure(data, state, depth):
    """One byte at a time."""
    out = []
    for i, b in enumerate(data):
        c = chr(b)
        if state == jl.ESCAPE:
            state = jl.STRING
        elif state == jl.STRING:
            state = jl.ESCAPE if c == "\\" else jl.OUTSIDE if c == '"' else jl.STRING
        elif c == '"':
            state = jl.STRING
        elif c in "[]{},":
            depth += {"[": 1, "{": 1, "]": -1, "}": -1}.get(c, 0)
            out.append((i, depth))
    return out, state, depth


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet='"\\[]{},a ', max_size=40), st.integers(0, 2))
def test_structure_equals_a_byte_loop(text, state):
    # A backslash outside strings is no JSON; such texts are rejected later, whatever is marked in them.
    at = state
    for c in text:
        if at == jl.OUTSIDE and c == "\\":
            return
        _, at, _ = slow_structure(c.encode(), at, 0)
    marks = jl.structure(np.frombuffer(text.encode(), np.uint8), state, 2)
    want, end, depth = slow_structure(text.encode(), state, 2)
    assert list(zip(marks.places.tolist(), marks.depths.tolist())) == want and (marks.state, marks.depth) == (end, depth)


def value(rng, deep=0):
    kind = rng.random()
    if deep > 3 or kind < 0.3:
        return rng.choice(["", "a}b", '"', "\\", '\\"}', "é,]", " ", 1, -2.5, True, None, "x" * 200])
    if kind < 0.6:
        return [value(rng, deep + 1) for _ in range(rng.randint(0, 4))]
    return {rng.choice(["k", "}", "[", "q\\"]) + str(i): value(rng, deep + 1) for i in range(rng.randint(0, 4))}


@pytest.fixture
def small_splits(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "1500", "spark.sql.files.openCostInBytes": "1"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def rows(found):
    return sorted((r.source_path.rsplit("/", 1)[-1], r.record_no, r.j) for r in found.selectExpr("source_path", "record_no", "to_json(record) AS j").collect())


def test_same_rows_as_whole_files(spark, tmp_path, monkeypatch, small_splits):
    rng = random.Random(4)
    sample = lambda i: {"messages": [{"role": "user", "content": f"q{i} {'}' * rng.randint(0, 9)}"}, {"role": "assistant", "content": value(rng)}]}
    put = lambda name, text: (tmp_path / name).write_bytes(text if isinstance(text, bytes) else text.encode())
    put("list.json", "\n" + json.dumps([sample(i) for i in range(60)]))
    put("pretty.JSON", json.dumps([sample(i) for i in range(30)], indent=2, ensure_ascii=False) + "\n\n")
    put("mixed.json", json.dumps([value(rng) for _ in range(200)]))
    put("long.json", json.dumps([["y" * 5000, {"a": "}" * 3000}], 7, {"z": "w" * 4000}]))
    put("flat.json", json.dumps(list(range(500))))
    put("bom.json", b"\xef\xbb\xbf" + json.dumps([sample(i) for i in range(20)]).encode())
    put("empty.json", "[" + " " * 900 + "]")
    put("object.json", json.dumps(sample(1) | {"more": "{" * 2000}))
    put("lines.json", "".join(json.dumps(sample(i)) + rng.choice(["\n", "\r\n", "\n\n", "\n # c }\n"]) for i in range(50)))
    good = json.dumps([sample(i) for i in range(30)])
    for name, text in {
        "trailing": good + "}", "second": good + good, "unclosed": good[:-1], "comma": good[:-1] + ",]", "hole": good.replace("}, {", "}, , {", 1),
        "cut": good[:-1] + ",", "crossed": good[:-1] + "}", "garbage": good + " x", "bare": good.replace("}, {", "} {", 1), "string": good[:-2], "twoempty": "[" + " " * 900 + ",]",
        "badline": "".join(json.dumps(sample(i)) + "\n" for i in range(30)) + "{\n",
    }.items():
        put(f"bad-{name}.json", text)
    put("bad-bytes.json", good.encode().replace(b"q7", b"\xff", 1))
    put("bad-lines.json", b"".join(json.dumps(sample(i)).encode() + b"\n" for i in range(30)) + b'{"a":"\xff"}\n')
    put("beside.jsonl", json.dumps(sample(0)) + "\n")
    for options, least in ((DataOptions(), 0), (DataOptions(skip_comment_lines=False), 3000)):
        monkeypatch.setattr(readers, "WHOLE_BYTES", 8 << 20)
        want = rows(readers.scan_records(spark, str(tmp_path), options))
        assert len({r[0] for r in want}) == 23  # an empty list has no record
        monkeypatch.setattr(readers, "WHOLE_BYTES", least)
        assert rows(readers.scan_records(spark, str(tmp_path), options)) == want


def test_one_list_is_read_by_many_tasks(spark, tmp_path, small_splits):
    (tmp_path / "a.json").write_text(json.dumps([{"n": i, "t": "}{" * (i % 50)} for i in range(3000)]))
    found = jl.fragments(spark, str(tmp_path), 0)
    assert found.rdd.getNumPartitions() > 50
    cut = jl.scan_large_json(spark, str(tmp_path), 0, DataOptions())
    got = cut.selectExpr("record_no", "try_variant_get(record, '$.n', 'long') AS n", "try_variant_get(record, '$.t', 'string') AS t").collect()
    assert sorted((r.record_no, r.n, r.t) for r in got) == [(i, i, "}{" * (i % 50)) for i in range(3000)]
