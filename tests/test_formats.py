"""Converters on hand-written records with their results, and properties on random ones."""

import json
import random

import pytest
from pyspark.sql import functions as F

from chatloom.functions.records import strict_json
from chatloom.operators import drafting, formats
from chatloom.operators.messages import samples_from_turns, valid_turns
from chatloom.options import FAILFAST, DataFormatError, DataOptions

PROMPT = "You are helpful."


CONVERTERS = {
    "jsonl": formats.from_messages_jsonl,
    "sharegpt": formats.from_sharegpt,
    "alpaca": formats.from_alpaca,
    "custom": formats.from_custom,
    "catalog": formats.from_catalog,
}

# Format, record, and what must come out: the reason of a reject, or the messages as "u:..." lines.
CASES = [
    ("jsonl", '{"messages":[{"role":"Human ","content":" 2+2? "},{"role":"GPT","content":"4"}]}', ["u:2+2?", "a:4"]),
    ("jsonl", '[{"role":"user","content":"ping"},{"role":"bot","content":"pong"}]', ["u:ping", "a:pong"]),
    ("jsonl", '{"messages":[{"role":"user","content":7},{"role":"assistant","content":{"k":[1]}}]}', ["u:7", 'a:{"k":[1]}']),
    ("jsonl", '{"messages":[{"role":"system","content":"be terse"},{"role":"user","content":"x"},{"role":"assistant","content":"y"}]}',
     ["s:be terse", "u:x", "a:y"]),
    ("jsonl", '{"messages":[{"role":"user","content":"x"},{"role":"user","content":"  "},{"role":"assistant","content":"y"}]}', ["u:x", "a:y"]),
    ("jsonl", '{"messages":[{"role":"user","content":"x"},{"role":"assistant","content":" "}]}', "no_assistant"),
    ("jsonl", '{"messages":[{"role":"assistant","content":"y"}]}', "no_user"),
    ("jsonl", '{"messages":[{"role":"narrator","content":"x"}]}', "unsupported_role"),
    ("jsonl", '{"messages":"x"}', "bad_messages"),
    ("jsonl", '{"turns":[]}', "no_messages"),
    ("jsonl", '{"messages":[', "invalid_json"),
    ("sharegpt", '{"conversations":[{"from":"human","value":"x"},{"from":"gpt","value":"y"}]}', ["u:x", "a:y"]),
    ("sharegpt", '{"conversations":[{"role":"user","content":"x"},{"from":"","role":"bot","value":"","content":"y"}]}', ["u:x", "a:y"]),
    ("sharegpt", '{"conversations":[{"from":"human","value":"x"},{"from":"gpt","value":0}]}', "no_assistant"),
    ("sharegpt", '{"conversations":[]}', "no_conversations"),
    ("sharegpt", '{"conversations":{"a":1}}', "bad_messages"),
    ("sharegpt", '{"messages":[{"role":"user","content":"x"}]}', "no_conversations"),
    ("alpaca", '{"instruction":"sum","input":"1 2","output":"3"}', ["u:sum\n1 2", "a:3"]),
    ("alpaca", '{"instruction":" sum ","input":" ","output":" 3"}', ["u:sum", "a:3"]),
    ("alpaca", '{"instruction":"sum","output":""}', "no_assistant"),
    ("alpaca", '{"output":"3"}', "no_user"),
    ("alpaca", '"sum"', "not_an_object"),
    ("custom", '{"user":"x","assistant":"y","system":" s "}', ["s:s", "u:x", "a:y"]),
    ("custom", '{"user":"x","assistant":2.5,"system":"  "}', ["u:x", "a:2.5"]),
    ("custom", '{"user":"x"}', "no_assistant"),
    ("custom", "[]", "not_an_object"),
    ("catalog", '{"messages":[{"role":"user","content":"x"},"stray",{"role":"assistant","content":"y"}]}', ["u:x", "a:y"]),
    ("catalog", '{"messages":null,"conversations":[{"from":"human","value":"x"},{"from":"gpt","content":"y"}]}', ["u:x", "a:y"]),
    ("catalog", '{"instruction":"","input":"x","response":"y"}', ["u:x", "a:y"]),
    ("catalog", '{"instruction":"x","output":"","response":"y"}', ["u:x", "a:y"]),
    ("catalog", '{"user":"x","assistant":"y"}', ["u:x", "a:y"]),
    ("catalog", '{"user":"x"}', "no_messages"),
    ("catalog", "3", "not_an_object"),
]

# The same with a system prompt: it goes in front unless a system message with content is first.
PROMPTED = [
    ("jsonl", '{"messages":[{"role":"user","content":"x"},{"role":"assistant","content":"y"}]}', [f"s:{PROMPT}", "u:x", "a:y"]),
    ("jsonl", '{"messages":[{"role":"system","content":"mine"},{"role":"user","content":"x"},{"role":"assistant","content":"y"}]}',
     ["s:mine", "u:x", "a:y"]),
    ("jsonl", '{"messages":[{"role":"system","content":""},{"role":"user","content":"x"},{"role":"assistant","content":"y"}]}',
     [f"s:{PROMPT}", "u:x", "a:y"]),
    ("jsonl", '{"messages":[]}', "no_user"),
    ("alpaca", '{"instruction":"x","output":"y"}', [f"s:{PROMPT}", "u:x", "a:y"]),
    ("custom", '{"user":"x","assistant":"y","system":"mine"}', ["s:mine", "u:x", "a:y"]),
]


def outcomes(spark, name, rows, options):
    """Of every row: its reason, or its messages as (role, content)."""
    frame = spark.createDataFrame([("f", i, r) for i, r in enumerate(rows)], "source_path string, record_no long, raw string")
    got = {r.record_no: r for r in CONVERTERS[name](frame, options).collect()}
    assert sorted(got) == list(range(len(rows)))
    return [got[i].reason if got[i].messages is None else [(m.role, m.content) for m in got[i].messages] for i in range(len(rows))]


@pytest.mark.parametrize("name", CONVERTERS)
@pytest.mark.parametrize("prompt,cases", [("", CASES), (PROMPT, PROMPTED)])
def test_hand_written_records(spark, name, prompt, cases):
    mine = [(raw, want) for n, raw, want in cases if n == name]
    if not mine:
        return
    got = outcomes(spark, name, [raw for raw, _ in mine], DataOptions(system_prompt=prompt))
    shown = [g if isinstance(g, str) else [f"{role[0]}:{content}" for role, content in g] for g in got]
    assert shown == [want for _, want in mine]


VALUES = ["hi", " spaced　", "", "  ", "0", 0, 1, 1.5, 2.0, True, False, None, [], {}, ["x"], {"k": 1}, "café\nline"]
ROLES = ["user", "User ", "human", "gpt", "assistant", "ASSISTANT", "system", "System", "bot", "tool", "", None]


def random_record(rng):
    def turn(keys):
        out = {}
        for names, pool in keys:
            for name in names:
                if rng.random() < 0.6:
                    out[name] = rng.choice(pool)
        return out

    def turns(keys):
        good = [
            {keys[0][0][0]: r, keys[1][0][0]: c}
            for r, c in (("user", "q"), ("assistant", rng.choice(VALUES)), ("system", ""), ("user", "x"))
        ]
        return [rng.choice(good) if rng.random() < 0.8 else turn(keys) for _ in range(rng.randint(0, 4))]

    chat, shared = [(["role"], ROLES), (["content"], VALUES)], [(["from", "role"], ROLES), (["value", "content"], VALUES)]
    kind = rng.randrange(8)
    if kind == 0:
        return {"messages": turns(chat)}
    if kind == 1:
        return turns(chat)
    if kind == 2:
        return {"conversations": turns(shared)}
    if kind == 3:
        return turn([(["instruction", "input", "output", "response"], VALUES)])
    if kind == 4:
        return turn([(["user", "assistant", "system"], VALUES)])
    if kind == 5:
        return {"messages": rng.choice([None, "text", {"a": 1}, 3])}
    if kind == 6:
        return {"conversations": rng.choice([None, "text", {"a": 1}, 0, []])}
    return rng.choice(VALUES)


def raw_records():
    rng = random.Random(7)
    rows = [json.dumps(random_record(rng), ensure_ascii=False) for _ in range(1500)]
    return rows + ['{"messages": [', '{"a":1} x', "", "1, 2", '[1],[2]']


@pytest.mark.parametrize("name", CONVERTERS)
def test_properties_on_random_records(spark, name):
    rows = raw_records()
    plain = outcomes(spark, name, rows, DataOptions())
    kept = [x for x in plain if not isinstance(x, str)]
    assert len(kept) > 20 and all(isinstance(x, (str, list)) and x for x in plain)
    for messages in kept:
        roles = {role for role, _ in messages}
        assert {"user", "assistant"} <= roles <= {"user", "assistant", "system"}
        assert all(content and content == content.strip() for _, content in messages)
    # What was accepted is accepted again, unchanged and in its order.
    again = [json.dumps({"messages": [{"role": r, "content": c} for r, c in m]}, ensure_ascii=False) for m in kept]
    assert outcomes(spark, "jsonl", again, DataOptions()) == kept
    # A prompt never changes what follows the first system message, nor which records are accepted.
    for before, after in zip(plain, outcomes(spark, name, rows, DataOptions(system_prompt=PROMPT)), strict=True):
        assert isinstance(before, str) == isinstance(after, str)
        if not isinstance(before, str):
            assert after[0][0] == "system"
            assert after == before or after == [("system", PROMPT), *before]


def test_strict_json(spark):
    rows = ['{"a":1} x', '{"a":1}', '{"a":1,"a":2}', "[1,2]", "1, 2", "1] , [2", " 3 ", "NaN", "", "nul", '"@@chatloom:end@@"',
            '"@@chatloom:end@@"] x', '{"a":"@@chatloom:end@@"}']
    frame = spark.createDataFrame([(r,) for r in rows], "raw string")
    got = {r.raw: r.j for r in frame.select("raw", F.to_json(F.expr(strict_json("raw"))).alias("j")).collect()}
    want = {}
    for raw in rows:
        try:
            want[raw] = None if raw == "NaN" else json.dumps(json.loads(raw), separators=(",", ":"))
        except json.JSONDecodeError:
            want[raw] = None
    assert got == want


def test_null_content_compat(spark):
    raw = '{"messages":[{"role":"user","content":"q"},{"role":"assistant","content":null}]}'
    frame = spark.createDataFrame([("f", 0, raw)], "source_path string, record_no long, raw string")
    assert formats.from_messages_jsonl(frame).first().reason == "no_assistant"
    kept = formats.from_messages_jsonl(frame, DataOptions(compat_null=True)).first()
    assert kept.messages[1].content == "None"


def test_modes(spark):
    rows = ['{"messages":[{"role":"user","content":"q"},{"role":"assistant","content":"a"}]}', '{"x":1}']
    frame = spark.createDataFrame([("f", i, r) for i, r in enumerate(rows)], "source_path string, record_no long, raw string")
    ok = formats.convert(frame, " JSONL ")
    assert formats.samples(ok, FAILFAST).count() == 1  # a skip is no error
    assert [r.reason for r in formats.rejects(ok).collect()] == ["no_messages"]
    bad = formats.convert(frame.unionByName(frame.limit(1).withColumn("raw", F.lit("{"))), "jsonl")
    assert formats.samples(bad).count() == 1
    with pytest.raises(Exception, match="invalid_json"):
        formats.samples(bad, FAILFAST).count()
    with pytest.raises(DataFormatError):
        formats.convert(frame, "nope")
    with pytest.raises(DataFormatError):
        formats.require_samples(formats.samples(bad).limit(0), "f")


def test_editor_imports(spark):
    chatml = "<|im_start|>user\nhi\n<|im_end|>\n<|im_start|>assistant\nyo\n\n<|im_end|>junk<|im_start|>tool\nx<|im_end|>"
    texts = spark.createDataFrame([("a", chatml), ("b", "none here")], "source_path string, text string")
    rows = formats.import_chatml(texts).collect()
    assert [(m.role, m.content) for m in rows[0].messages] == [("user", "hi"), ("assistant", "yo\n")] and len(rows) == 1

    txt = spark.createDataFrame([("a", "﻿ u1 \r\n# c\n\n a1\nu2\n")], "source_path string, text string")
    assert [[m.content for m in r.messages] for r in formats.import_editor_txt(txt).collect()] == [["u1", "a1"]]

    records = ['[{"from":"human","value":"q"},{"from":"gpt","text":"a"},{"from":"x"},"s"]', '{"conversations":[{"role":"tool"}]}',
               '{"y":1}', '{"messages":"text"}', '[null]']
    frame = spark.createDataFrame([("f", i, r) for i, r in enumerate(records)], "source_path string, record_no long, raw string")
    got = {r.record_no: (r.reason, r.messages and [(m.role, m.content) for m in r.messages]) for r in formats.import_editor_json(frame).collect()}
    assert got[0] == (None, [("user", "q"), ("assistant", "a"), ("x", ""), ("user", "")])
    assert got[1] == (None, [("tool", "")])
    assert got[2] == (None, [])
    assert got[3] == ("bad_messages", None) and got[4] == ("bad_messages", None)

    sniffed = spark.createDataFrame(
        [("a.jsonl", "x"), ("a", " {"), ("b", "[1]"), ("c", chatml), ("d", "plain"), ("e", " \n")], "name string, text string"
    ).select("name", formats.sniff_format(F.col("text"), F.col("name")).alias("f"))
    assert {r.name: r.f for r in sniffed.collect()} == {"a.jsonl": "json", "a": "json", "b": "json", "c": "chatml", "d": "txt", "e": None}

    many = spark.createDataFrame([("f", '[[{"role":"user"}],[]]'), ("g", '{"a":1}\n\n{"b":2}')], "source_path string, text string")
    assert formats.editor_json_records(many).groupBy("source_path").count().count() == 2
    assert formats.editor_json_records(many).filter("record is null").count() == 0


def test_turn_table_cleaning_equals_array_cleaning(spark):
    rows = [(1, 0, "human", "q"), (1, 1, "gpt", " a "), (2, 0, "user", "q"), (3, 0, "tool", ""), (3, 1, "user", "q"), (3, 2, "bot", "a"),
            (4, 0, "user", "q"), (4, 1, "bot", " "), (5, 0, "system", " "), (5, 1, "user", "q"), (5, 2, "bot", "a")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    long_form = sorted((r.conv_id, r.role, r.content) for r in valid_turns(turns).collect())
    from chatloom.operators.messages import validate

    arrays = samples_from_turns(turns).select("conv_id", validate("messages").alias("v"))
    array_form = sorted((r.conv_id, m.role, m.content) for r in arrays.collect() if r.v.reason is None for m in r.v.messages)
    assert long_form == array_form and {r[0] for r in array_form} == {1, 5}


def test_registered_format(spark):
    def shouted(records, options):
        return formats.from_alpaca(records.withColumn("raw", F.lower("raw")), options)

    formats.register_format("Shout", shouted)
    raw = '{"INSTRUCTION":"Q","OUTPUT":"A"}'
    frame = spark.createDataFrame([("f", 0, raw)], "source_path string, record_no long, raw string")
    assert [m.content for m in formats.samples(formats.convert(frame, "SHOUT")).first().messages] == ["q", "a"]
    assert "shout" in formats.format_names()


def test_editor_side_scalars(spark):
    raw = '{"messages":[{"role":"user","content":true},{"role":"user","content":1.0},{"role":"user","content":0.5},{"role":"user","content":false}]}'
    record = spark.createDataFrame([("s", 0, raw)], "source_path string, record_no long, raw string")
    found = formats.import_editor_json(record).first().messages
    assert [m.content for m in found] == ["true", "1", "0.5", ""]
    answer = spark.createDataFrame([(1, '{"prompts":[true,1.0,2e3,"x"]}'), (2, "[true]")], "id int, text string")
    found = drafting.drafted_prompts(answer).orderBy("id", "n").collect()
    assert [r.prompt for r in found if r.id == 1] == ["true", "1", "2000", "x"]


def test_lines_report_counts_records(spark):
    from chatloom.operators import report

    lines = [("a", "", True), ("a", "# note", True), ("a", '{"messages":[]}', True), ("a", "{", False)]
    scanned = spark.createDataFrame(lines, "source_path string, line string, utf8_ok boolean")
    records = spark.createDataFrame([("a", 0, '{"messages":[]}'), ("a", 1, None)], "source_path string, record_no long, raw string")
    r = report.lines_report(scanned, formats.from_messages_jsonl(records), paired=False).first()
    assert (r.raw_lines, r.skipped_empty, r.skipped_comments, r.dropped_unpaired, r.utf8_ok, r.samples) == (4, 1, 1, 0, False, 0)


def test_bad_bytes_are_rejected(spark, tmp_path):
    from chatloom.sources import readers

    good = b'{"messages":[{"role":"user","content":"q"},{"role":"assistant","content":"a"}]}'
    (tmp_path / "a.jsonl").write_bytes(good + b"\n" + good.replace(b"q", b"\xff") + b"\n")
    (tmp_path / "b.json").write_bytes(b"[" + good.replace(b"a\"}", b"\xff\"}") + b"]")
    found = formats.from_messages_jsonl(readers.scan_records(spark, str(tmp_path))).collect()
    assert sorted((r.source_path[-6:].strip("/"), r.reason) for r in found if r.reason) == [(".jsonl", "invalid_json"), ("b.json", "invalid_json")]
    assert sum(r.reason is None for r in found) == 1
