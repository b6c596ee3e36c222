"""Streams: the same chunks in 1, 2 and 5 micro-batches give what the batch operator gives."""

import random
import time
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from chatloom.operators import responses as rs
from chatloom.streaming import chunks as cs
from chatloom.streaming import logs as ls

COLUMNS = "id string, seq long, sec long, content string, finish_reason string, total_tokens long"


def events():
    rows = []
    for c in range(12):
        last = 20
        for s in range(last + 1):
            done = s == last and c != 3
            rows.append((f"c{c}", s, 1000 + c * 20 + s, None if s == 0 else f"<{c}.{s}>", "stop" if done else None, 7 if done else None))
    return rows


def land(spark, rows, folder, files):
    """One file per micro-batch in time order, chunks out of order inside; a last event far off."""
    rows = sorted(rows, key=lambda r: r[2])
    size = -(-len(rows) // files)
    for i in range(files):
        part = rows[i * size : (i + 1) * size]
        random.Random(i).shuffle(part)
        write(spark, part, f"{folder}/b{i}")
    write(spark, [("closing", 0, 10**9, None, None, None)], f"{folder}/b{files}")


def write(spark, rows, path):
    frame = spark.createDataFrame(rows, COLUMNS).select(
        "id", "seq", F.timestamp_seconds("sec").alias("ts"),
        F.array(F.struct(F.lit(0).alias("index"), F.struct("content").alias("delta"), "finish_reason")).alias("choices"),
        F.when(F.col("total_tokens").isNotNull(), F.struct("total_tokens")).alias("usage"),
    )
    frame.coalesce(1).write.json(path)


def run(spark, tmp_path, name, files_per_batch=None):
    stream = cs.scan_chunk_stream(spark, str(tmp_path / "in" / "*"), files_per_batch)
    out = str(tmp_path / f"out-{name}")
    cs.run_available(cs.assemble_chunk_stream(stream), out, str(tmp_path / f"ckpt-{name}"))
    return {r.id: (r.content, r.finish_reason, r.total_tokens, r.chunks) for r in spark.read.parquet(out).collect()}


@pytest.mark.parametrize("files", [1, 2, 5])
def test_micro_batches_equal_batch(spark, tmp_path, files):
    land(spark, events(), str(tmp_path / "in"), files)
    flat = spark.createDataFrame(events(), COLUMNS)
    want = {r.id: (r.content, r.finish_reason, r.total_tokens, r.chunks) for r in rs.assemble_chunks(flat).collect()}
    assert want["c3"][1] is None and want["c4"][1:] == ("stop", 7, 21)
    assert run(spark, tmp_path, "a", 1) == want


def test_late_chunk_is_dropped_and_open_session_held(spark, tmp_path):
    write(spark, [("a", 0, 1000, "x", None, None), ("a", 1, 1001, "y", "stop", 2)], str(tmp_path / "in" / "b0"))
    run(spark, tmp_path, "l", 1)
    write(spark, [("b", 0, 2000, "z", None, None)], str(tmp_path / "in" / "b1"))
    assert run(spark, tmp_path, "l", 1) == {"a": ("xy", "stop", 2, 2)}
    write(spark, [("a", 2, 1002, "late", None, None), ("b", 1, 2001, "w", "stop", 2)], str(tmp_path / "in" / "b2"))
    write(spark, [("c", 0, 3000, "c", None, None)], str(tmp_path / "in" / "b3"))
    assert run(spark, tmp_path, "l", 1) == {"a": ("xy", "stop", 2, 2), "b": ("zw", "stop", 2, 2)}


def test_error_event_ends_completion(spark):
    rows = spark.createDataFrame([('{"id":"e","seq":1,"error":{"message":"boom"}}',)], "j string")
    parsed = rows.select(F.from_json("j", cs.CHUNK_SCHEMA).alias("c")).select("c.*")
    assert cs.flatten_chunks(parsed).first().finish_reason == "error"


def test_follow_logs(spark, tmp_path):
    folder = tmp_path / "logs"
    folder.mkdir()
    (folder / "1.log").write_text("old line\n")
    time.sleep(0.1)
    begun = datetime.now(timezone.utc)
    time.sleep(0.1)
    out, ckpt = str(tmp_path / "out"), str(tmp_path / "ckpt")
    follow = lambda: cs.run_available(ls.follow_logs(ls.scan_log_stream(spark, str(folder)), ("sk-secret",), begun), out, ckpt)
    follow()
    (folder / "2.log").write_text("api-key sk-secret boom\npartial")
    follow()
    assert sorted(r.line for r in spark.read.parquet(out).collect()) == ["api-key *** boom", "partial"]
    later = ls.follow_logs(spark.read.text(str(folder)).select(F.col("value").alias("line"), F.col("_metadata.file_modification_time").alias("file_time")))
    assert later.count() == 0


def test_converters_run_on_streams(spark, tmp_path):
    from chatloom.operators import formats

    (tmp_path / "in").mkdir()
    good = '{"messages":[{"role":"human","content":"q"},{"role":"bot","content":"a"}]}'
    (tmp_path / "in" / "1.jsonl").write_text(good + "\n{\n")
    raw = spark.readStream.text(str(tmp_path / "in")).select(F.lit("s").alias("source_path"), F.col("value").alias("raw"))
    converted = formats.from_catalog(raw)
    out = str(tmp_path / "out")
    cs.run_available(converted.drop("raw"), out, str(tmp_path / "ckpt"))
    rows = spark.read.parquet(out).collect()
    assert sorted((r.reason or "", r.messages and [m.role for m in r.messages]) for r in rows) == [("", ["user", "assistant"]), ("invalid_json", None)]


def pausing():
    """Completions with a minute's pause, with a lost chunk, with an error, without an end, and one sent twice."""
    rows = []
    for c in range(8):
        for s in range(6):
            at = 1000 + c + s + (60 if s >= 3 else 0)
            rows.append((f"p{c}", s, at, f"{s};", "stop" if s == 5 and c != 6 else None, 3 if s == 5 else None))
    rows = [r for r in rows if r[:2] != ("p4", 2)]
    rows += [("p7", s, 1008 + s, f"{s};", None, None) for s in range(2)]
    rows += [("e", 0, 1000, "x", None, None), ("e", 1, 1001, None, "error", None)]
    return rows


@pytest.mark.parametrize("files", [1, 2, 5])
def test_pauses_losses_and_repeats(spark, tmp_path, files):
    land(spark, pausing(), str(tmp_path / "in"), files)
    whole = "0;1;2;3;4;5;"
    want = {f"p{c}": (whole, "stop", 3, 6) for c in (0, 1, 2, 3, 5, 7)}
    want |= {"p4": ("0;1;3;4;5;", "stop", 3, 5), "p6": (whole, None, 3, 6), "e": ("x", "error", None, 2)}
    assert run(spark, tmp_path, "a", 1) == want
    assert spark.read.parquet(str(tmp_path / "out-a")).count() == len(want)


def test_completion_comes_out_at_its_end_and_is_remembered(spark, tmp_path):
    write(spark, [("a", 0, 1000, "x", None, None), ("b", 0, 1000, "q", None, None)], str(tmp_path / "in" / "b0"))
    assert run(spark, tmp_path, "s", 1) == {}
    write(spark, [("a", 1, 1060, "y", "stop", 2)], str(tmp_path / "in" / "b1"))
    want = {"a": ("xy", "stop", 2, 2)}
    assert run(spark, tmp_path, "s", 1) == want  # no watermark has passed it
    write(spark, [("a", 1, 1060, "y", "stop", 2), ("a", 0, 1060, "x", None, None)], str(tmp_path / "in" / "b2"))
    assert run(spark, tmp_path, "s", 1) == want
    write(spark, [("closing", 0, 10**6, None, None, None)], str(tmp_path / "in" / "b3"))
    assert run(spark, tmp_path, "s", 1) == want | {"b": ("q", None, None, 1)}
    assert spark.read.parquet(str(tmp_path / "out-s")).count() == 2


def test_pieces_are_appended_and_read_once(spark, tmp_path):
    """The list state grows by what a micro-batch brings; nothing is left of it at the end."""
    for s in range(4):
        write(spark, [("a", s, 1000 + s, "x" * 100, None, None)], str(tmp_path / "in" / f"b{s}"))
        run(spark, tmp_path, "p", 1)
        held = spark.read.format("statestore").option("stateVarName", "pieces").load(str(tmp_path / "ckpt-p"))
        assert held.count() == s + 1
    write(spark, [("a", 4, 1004, "!", "stop", 1)], str(tmp_path / "in" / "b4"))
    assert run(spark, tmp_path, "p", 1)["a"][0] == "x" * 400 + "!"
    assert spark.read.format("statestore").option("stateVarName", "pieces").load(str(tmp_path / "ckpt-p")).count() == 0
