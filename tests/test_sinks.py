"""The sink of named and counted files: all or nothing, one pass over the source."""

import json
import os

import pytest
from pyspark.sql import functions as F

from chatloom.operators import formats
from chatloom.options import FAILFAST, DataFormatError, DataOptions
from chatloom.sources import files, readers, sinks


def tree(path):
    return sorted(os.path.relpath(os.path.join(d, f), path) for d, _, fs in os.walk(path) for f in fs if not f.startswith("."))


def test_named_files(spark, tmp_path):
    rows = [("m1/README.md", b"a"), ("m1/LICENSE", None), ("m2/deep/x é.bin", bytes(range(256)))]
    df = spark.createDataFrame([(n, bytearray(c) if c is not None else None, 1) for n, c in rows], "name string, content binary, other int")
    for spelled in (str(tmp_path / "a"), f"file://{tmp_path}/b", f"file:{tmp_path}/c/"):
        assert files.write_files(df.repartition(3), spelled) == {"rows": 3, "bytes": 257, "files": 3}
    for name in "abc":
        for n, c in rows:
            assert (tmp_path / name / n).read_bytes() == (c or b"")
        assert tree(tmp_path / name) == sorted([n for n, _ in rows] + ["_SUCCESS"])
    cards = {(r.model_id, r.file, r.text) for r in readers.scan_model_cards(spark, str(tmp_path / "a")).collect()}
    assert cards == {("m1", "README.md", "a")}  # Spark does not list empty files


@pytest.mark.parametrize("bad", ["x/../y", "/x", "", None, "_x", "a//b", "m/1"])
def test_a_bad_or_repeated_name_leaves_nothing(spark, tmp_path, bad):
    df = spark.createDataFrame([("m/1", "t"), ("m/2", "t"), (bad, "t")], "name string, content string").repartition(3)
    with pytest.raises(Exception):
        files.write_files(df, str(tmp_path / "out"))
    assert not (tmp_path / "out").exists() or tree(tmp_path / "out") == []


def test_modes(spark, tmp_path):
    out = str(tmp_path / "out")
    one = lambda n, c="x": spark.createDataFrame([(n, c)], "name string, content string")
    files.write_files(one("a"), out)
    with pytest.raises(DataFormatError, match="already exists"):
        files.write_files(one("b"), out)
    assert files.write_files(one("b"), out, "ignore")["rows"] == 0
    files.write_files(one("b"), out, "append")
    assert tree(out) == ["_SUCCESS", "a", "b"]
    with pytest.raises(Exception, match="already"):
        files.write_files(one("a", "new"), out, "append")
    assert tree(out) == ["_SUCCESS", "a", "b"] and (tmp_path / "out" / "a").read_text() == "x"
    files.write_files(one("a", "new"), out, "append", replace=True)
    assert (tmp_path / "out" / "a").read_text() == "new"
    files.write_files(one("c"), out, "overwrite")
    assert tree(out) == ["_SUCCESS", "c"]
    with pytest.raises(Exception):  # a name twice: what was there comes back
        files.write_files(one("d").union(one("d")), out, "overwrite")
    assert tree(out) == ["_SUCCESS", "c"]


def test_too_few_rows_leave_the_target_alone(spark, tmp_path):
    out = str(tmp_path / "out")
    lines = spark.createDataFrame([("é 1",), (None,), ("2",)], "value string").repartition(2)
    assert files.write_lines(lines, out, least=3)["rows"] == 3
    before = tree(out)
    for mode in ("overwrite", "append"):
        with pytest.raises(DataFormatError):
            files.write_lines(lines.filter("false"), out, mode, least=1)
        assert tree(out) == before
    assert sorted(r.value for r in spark.read.text(out).collect()) == ["", "2", "é 1"]
    with pytest.raises(DataFormatError):
        files.write_lines(lines.filter("false"), str(tmp_path / "new"), least=1)
    assert not (tmp_path / "new").exists()


def test_failing_task_leaves_nothing(spark, tmp_path):
    lines = spark.range(100).repartition(4).select(F.when(F.col("id") == 57, F.raise_error(F.lit("boom"))).otherwise(F.col("id").cast("string")))
    with pytest.raises(Exception, match="boom"):
        files.write_lines(lines, str(tmp_path / "out"), least=1)
    assert not (tmp_path / "out").exists()


def counted(spark, seen):
    """Samples whose every evaluation adds to an accumulator."""
    def look(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    text = F.array(F.struct(F.lit("user").alias("role"), F.col("id").cast("string").alias("content")))
    return spark.range(1000).select(text.alias("messages")).mapInArrow(look, "messages array<struct<role:string,content:string>>")


def test_one_pass_over_the_source(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)
    assert sinks.write_processed(counted(spark, seen), str(tmp_path / "p"))["rows"] == 1000
    assert seen.value == 1000
    with pytest.raises(DataFormatError):
        sinks.write_processed(counted(spark, seen).filter("size(messages) > 1"), str(tmp_path / "q"))
    assert seen.value == 2000 and not (tmp_path / "q").exists()


def test_materialise(spark, tmp_path):
    out = str(tmp_path / "training")
    rows = spark.createDataFrame([("train", "do", "", "done", "n"), ("test", "no", "x", "y", "n")], "split string, instruction string, input string, output string, notes string")
    rows.write.parquet(str(tmp_path / "hub" / "owner" / "name"))
    done = readers.materialise(spark, " owner/name ", "auto", out, catalog_root=str(tmp_path / "hub"))
    assert done == (f"{out}/processed/owner__name.jsonl", f"{out}/raw/owner__name.jsonl", 1)
    assert json.loads(spark.read.text(done.processed).first().value)["messages"][1] == {"role": "assistant", "content": "done"}
    assert json.loads(spark.read.text(done.raw).first().value) == {"instruction": "do", "input": "", "output": "done", "notes": "n"}
    (tmp_path / "c.v1.txt").write_text("u\na\n")
    done = readers.materialise(spark, str(tmp_path / "c.v1.txt"), "txt", out, DataOptions(system_prompt="s"))
    assert (done.processed, done.raw, done.samples) == (f"{out}/processed/c.v1.jsonl", None, 1)
    (tmp_path / "c.v1.txt").write_text("# none\n")
    with pytest.raises(DataFormatError):
        readers.materialise(spark, str(tmp_path / "c.v1.txt"), "txt", out)
    assert spark.read.text(done.processed).count() == 1
    empty = rows.filter("false")
    empty.write.parquet(str(tmp_path / "hub" / "owner" / "empty"))
    with pytest.raises(DataFormatError):
        readers.materialise(spark, "owner/empty", "auto", out, catalog_root=str(tmp_path / "hub"))
    assert not (tmp_path / "training" / "raw" / "owner__empty.jsonl").exists()


def test_report_is_one_file(spark, tmp_path):
    summary = spark.createDataFrame([(0, None)], "turns int, bleu double")
    path = sinks.write_eval_report(summary, str(tmp_path / "r"), "a.json")
    assert json.loads((tmp_path / "r" / "a.json").read_text()) == {"turns": 0, "bleu": None} and path.endswith("/r/a.json")
    sinks.write_eval_report(summary, str(tmp_path / "r"), "b.json")
    with pytest.raises(Exception):
        sinks.write_eval_report(summary, str(tmp_path / "r"), "a.json")
    sinks.write_eval_report(summary, str(tmp_path / "r"), "a.json", "overwrite")
    assert tree(tmp_path / "r") == ["_SUCCESS", "a.json", "b.json"]


@pytest.mark.parametrize("parts", [1, 2, 8])
def test_first_error_is_the_same_however_tasks_run(spark, tmp_path, parts):
    good = json.dumps({"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]})
    rows = [(f, i, good) for f in ("b.jsonl", "a.jsonl") for i in range(40)]
    rows[7], rows[55], rows[70] = ("b.jsonl", 7, "{"), ("a.jsonl", 15, '{"messages":[]}'), ("a.jsonl", 30, "{")
    rows += [("a.jsonl", 40, '{"x":1}')]  # passed over, no error
    records = spark.createDataFrame(rows, "source_path string, record_no long, raw string").repartition(parts)
    converted = formats.from_messages_jsonl(records)
    out = str(tmp_path / "out")
    with pytest.raises(DataFormatError, match=r"^a\.jsonl, record 15: empty_messages$"):
        sinks.write_converted(converted, out, FAILFAST)
    assert not (tmp_path / "out").exists()
    assert sinks.write_converted(converted, out)["rows"] == 77
    with pytest.raises(DataFormatError, match="record 15"):
        sinks.write_converted(converted, out, FAILFAST, "overwrite")
    assert spark.read.text(out).count() == 77
    errors = {(r.source_path, r.record_no, r.reason) for r in formats.first_errors(converted).collect()}
    assert errors == {("a.jsonl", 15, "empty_messages"), ("b.jsonl", 7, "invalid_json")}
    assert formats.sound_files(converted).count() == 0
    fine = converted.filter("source_path = 'a.jsonl' and record_no not in (15, 30)")
    assert formats.sound_files(fine).columns == formats.samples(fine).columns and formats.sound_files(fine).count() == 38
    assert sinks.write_converted(fine, str(tmp_path / "fine"), FAILFAST)["rows"] == 38


def test_materialise_stops_at_the_first_bad_record(spark, tmp_path):
    good = json.dumps({"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]})
    (tmp_path / "c.jsonl").write_text(f"{good}\n{{\n{good}\n[1\n")
    with pytest.raises(DataFormatError, match=r"c\.jsonl, record 1: invalid_json"):
        readers.materialise(spark, str(tmp_path / "c.jsonl"), "jsonl", str(tmp_path / "t"), mode=FAILFAST)
    assert readers.materialise(spark, str(tmp_path / "c.jsonl"), "jsonl", str(tmp_path / "t")).samples == 2
