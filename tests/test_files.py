"""File sources: line numbering over many splits, records, catalogues, cards, listings, sinks."""

import json
import random

import pytest
from pyspark.sql import functions as F

from chatloom.operators import formats, lines, report
from chatloom.options import DataFormatError, DataOptions
from chatloom.sources import readers, sinks

# All separators of str.splitlines, and all code points that str.strip removes.
SEPARATORS = [chr(c) for c in (0x0B, 0x0C, 0x1C, 0x1D, 0x1E, 0x85, 0x2028, 0x2029)]
SPACES = [chr(c) for c in range(0x110000) if chr(c).isspace()]


def random_text(rng, n):
    """A text, and what each of its lines was made as: ("blank" | "comment" | "line", content)."""
    made, out, end = [], [], ""
    for i in range(n):
        kind = rng.choice(["blank", "comment", "line", "line"])
        content = {"blank": "", "comment": f"#{i}", "line": rng.choice([f"line {i} é", f"w{i}"])}[kind]
        left, right = rng.choice(["", " ", "\u3000"]), rng.choice(["", " ", "\t", "\xa0", "\x1f"])
        if end == "\r" and not left + content + right:
            left = " "  # a line feed after a carriage return would end no line of its own
        end = rng.choice(["\n", "\n", "\n", "\r\n", "\r"] + SEPARATORS)
        out.append(left + content + right + end)
        made.append((kind, content))
    return "".join(out) + "end\n", [*made, ("line", "end")]


def made_pairs(made, options=DataOptions()):
    """The pairs that a text made by random_text must give, and how many lines stay unpaired."""
    gone = {"blank"} if options.skip_empty_lines else set()
    gone |= {"comment"} if options.skip_comment_lines and options.comment_prefix == "#" else set()
    kept = [content for kind, content in made if kind not in gone]
    return [(u, a) for u, a in zip(kept[::2], kept[1::2]) if u and a], len(kept) % 2


@pytest.fixture()
def small_splits(spark):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    spark.conf.set("spark.sql.files.openCostInBytes", "100")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize(
    "options",
    [DataOptions(), DataOptions(skip_empty_lines=False), DataOptions(skip_comment_lines=False), DataOptions(comment_prefix="  l")],
)
def test_pairing_over_many_splits(spark, tmp_path, small_splits, options):
    rng = random.Random(3)
    texts = {f"f{i}.txt": random_text(rng, n) for i, n in enumerate((900, 301, 2, 50))}
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text[0].encode())
    scan = readers.scan_lines(spark, str(tmp_path), options)
    assert scan.select("source_path", "block_start").distinct().count() >= 10
    converted = formats.convert(scan, "Default", options)
    got = {}
    for r in formats.samples(converted).orderBy("source_path", "record_no").collect():
        got.setdefault(r.source_path.rsplit("/", 1)[-1], []).append(tuple(m.content for m in r.messages))
    for name, (_, made) in texts.items():
        assert got.get(name, []) == made_pairs(made, options)[0], name

    counters = {r.source_path.rsplit("/", 1)[-1]: r for r in report.lines_report(scan, converted, options).collect()}
    for name, (_, made) in texts.items():
        pairs, unpaired = made_pairs(made, options)
        assert counters[name].raw_lines == len(made)
        assert counters[name].dropped_unpaired == unpaired
        assert counters[name].samples == len(pairs)
        if options.skip_empty_lines:
            assert counters[name].skipped_empty == sum(kind == "blank" for kind, _ in made)
        assert counters[name].utf8_ok


def test_pair_blocks_are_bounded_and_complete(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(lines, "PAIR_BLOCK", 4)
    (tmp_path / "a.txt").write_text("".join(f"l{i}\n" for i in range(31)))
    pairs = lines.pair_lines(readers.scan_lines(spark, str(tmp_path))).orderBy("pair_no").collect()
    assert [(p.user, p.assistant) for p in pairs[:-1]] == [(f"l{2 * i}", f"l{2 * i + 1}") for i in range(15)]
    assert (pairs[-1].user, pairs[-1].assistant) == ("l30", None)


def test_changed_splits_fail_instead_of_misnumbering(spark, tmp_path):
    (tmp_path / "a.txt").write_text("".join(f"line number {i}\n" for i in range(2000)))
    numbered = lines.number_lines(readers.scan_lines(spark, str(tmp_path)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    try:
        with pytest.raises(Exception, match="splits changed"):
            numbered.collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_no_single_task_exchange_in_pairing(spark, tmp_path):
    (tmp_path / "a.txt").write_text("u\na\n")
    plan = lines.pair_lines(readers.scan_lines(spark, str(tmp_path)))._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "CartesianProduct" not in plan


def test_text_column_follows_the_same_rules(spark):
    rng = random.Random(5)
    texts = {f"d{i}": random_text(rng, rng.randint(0, 40)) for i in range(200)}
    frame = spark.createDataFrame([(k, t) for k, (t, _) in texts.items()], "source_path string, text string")
    got = {}
    for r in formats.samples(formats.from_text(frame)).orderBy("source_path", "record_no").collect():
        got.setdefault(r.source_path, []).append(tuple(m.content for m in r.messages))
    assert got == {k: made_pairs(made)[0] for k, (_, made) in texts.items() if made_pairs(made)[0]}


def test_strip_and_line_rules(spark):
    from chatloom.functions.text import pystrip, splitlines

    wrapped = [(c + "x" + c,) for c in SPACES]
    assert {r[0] for r in spark.createDataFrame(wrapped, "t string").select(pystrip(F.col("t"))).collect()} == {"x"}
    cases = ["", "a", "a\n", "\n", "a\r\nb", "a\r\rb\n\n", "".join(f"x{s}" for s in SEPARATORS)]
    rows = spark.createDataFrame([(c,) for c in cases], "t string").select("t", splitlines(F.col("t")).alias("l")).collect()
    assert all(r.l == r.t.splitlines() for r in rows)


def test_encodings(spark, tmp_path):
    (tmp_path / "l1.txt").write_bytes("caf\xe9\nth\xe9\n".encode("latin-1"))
    found = formats.samples(formats.convert(readers.scan_lines(spark, str(tmp_path), DataOptions(encoding="latin-1")), "txt", DataOptions()))
    assert [m.content for m in found.first().messages] == ["café", "thé"]
    broken = readers.scan_lines(spark, str(tmp_path))
    assert broken.filter("utf8_ok").count() == 0
    assert [r.reason for r in formats.rejects(formats.convert(broken, "txt")).collect()] == ["bad_encoding"]
    with pytest.raises(DataFormatError):
        readers.scan_lines(spark, str(tmp_path), DataOptions(encoding="utf-16"))
    wide = tmp_path / "w"
    wide.mkdir()
    (wide / "a.txt").write_bytes("u\na\n".encode("utf-16"))
    texts = readers.scan_texts(spark, str(wide), "utf-16")
    assert [m.content for m in formats.samples(formats.from_text(texts)).first().messages] == ["u", "a"]


def sample(q="q", a="a"):
    return {"messages": [{"role": "user", "content": q}, {"role": "assistant", "content": a}]}


def test_records(spark, tmp_path):
    (tmp_path / "list.json").write_text("\n" + json.dumps([sample("1"), sample("2")], indent=1))
    (tmp_path / "one.json").write_text(json.dumps(sample("3")))
    (tmp_path / "lines.jsonl").write_text("# c\n\n" + json.dumps(sample("4 x"), ensure_ascii=False) + "\n" + json.dumps(sample("5")) + "\n")
    records = readers.scan_records(spark, str(tmp_path))
    assert records.count() == 5
    found = formats.samples(formats.from_messages_jsonl(records)).orderBy("source_path", "record_no").collect()
    assert [r.messages[0].content for r in found] == ["4 x", "5", "1", "2", "3"]
    assert [r.record_no for r in found] == [0, 1, 0, 1, 0]


def test_load_corpus(spark, tmp_path):
    (tmp_path / "c.txt").write_text("# n\n\nu1\na1\nu2\na2\nodd\n")
    assert readers.load_corpus(spark, str(tmp_path / "c.txt"), "default").count() == 2
    with pytest.raises(DataFormatError):
        readers.load_corpus(spark, str(tmp_path / "missing"), "txt")
    with pytest.raises(DataFormatError):
        readers.load_corpus(spark, "owner/name", "txt", source="local")
    (tmp_path / "e.txt").write_text("# only\n")
    with pytest.raises(DataFormatError):
        readers.load_corpus(spark, str(tmp_path / "e.txt"), "txt")
    rows = spark.createDataFrame([("train", "do", "", "done"), ("test", "no", "x", "y")], "split string, instruction string, input string, output string")
    rows.write.parquet(str(tmp_path / "hub" / "owner" / "name"))
    found = readers.load_corpus(spark, "owner/name", "txt", catalog_root=str(tmp_path / "hub")).collect()
    assert [[m.content for m in r.messages] for r in found] == [["do", "done"]]
    ids = {"a/b": True, " a/b ": True, "/a/b": False, "./a": False, "a": False, "": False, "a\\b/c": False}
    assert {k: readers.looks_like_hub_id(k) for k in ids} == ids


def test_cards_and_listing(spark, tmp_path):
    (tmp_path / "m1" / "sub").mkdir(parents=True)
    (tmp_path / "m1" / "README.md").write_bytes(b"---\nlicense: mit\n---\n\xff")
    (tmp_path / "m1" / "sub" / "w.bin").write_bytes(b"123")
    cards = readers.scan_model_cards(spark, str(tmp_path)).collect()
    assert [(c.model_id, c.file, c.text) for c in cards] == [("m1", "README.md", "---\nlicense: mit\n---\n�")]
    listing = {(r.model_id, r.path, r.size) for r in readers.scan_listing(spark, str(tmp_path)).collect()}
    assert listing == {("m1", "README.md", 22), ("m1", "sub/w.bin", 3)}


def test_models_of_two_owners_keep_apart(spark, tmp_path):
    root = tmp_path / "models"
    for name in ("org1/m/README.md", "org2/m/README.md", "org2/m/onnx/README.md", "org2/submodels/y.bin", "org2/README.md"):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(name)
    for spelled in (str(root), f"file://{root}/", f"file:{root}"):
        cards = {(c.model_id, c.text) for c in readers.scan_model_cards(spark, spelled, depth=2).collect()}
        assert cards == {("org1/m", "org1/m/README.md"), ("org2/m", "org2/m/README.md")}
        listing = {(r.model_id, r.path) for r in readers.scan_listing(spark, spelled, depth=2).collect()}
        assert listing == {("org1/m", "README.md"), ("org2/m", "README.md"), ("org2/m", "onnx/README.md"), ("org2/submodels", "y.bin")}
    nested = spark.createDataFrame([("file:/models/x/submodels/y.bin", 1, None)], "path string, length long, modificationTime timestamp")
    assert [(r.model_id, r.path) for r in readers.listing_rows(nested, "/models").collect()] == [("x", "submodels/y.bin")]
    with pytest.raises(DataFormatError):
        readers.listing_rows(nested, "models")


def test_catalog_reads_probed_columns_only(spark, tmp_path):
    spark.createDataFrame([("q", "a", "long")], "instruction string, output string, notes string").write.parquet(str(tmp_path / "own" / "c"))
    found = readers.load_corpus(spark, "own/c", "catalog", catalog_root=str(tmp_path))
    assert [[m.content for m in r.messages] for r in found.collect()] == [["q", "a"]]
    schema = next(x for x in found._jdf.queryExecution().executedPlan().toString().splitlines() if "ReadSchema" in x).split("ReadSchema")[1]
    assert "instruction" in schema and "notes" not in schema


def test_sinks(spark, tmp_path):
    records = spark.createDataFrame([("f", 0, json.dumps(sample("é x"))), ("f", 1, "{")], "source_path string, record_no long, raw string")
    converted = formats.from_messages_jsonl(records)
    out = str(tmp_path / "p")
    sinks.write_processed(formats.samples(converted), out)
    text = spark.read.text(out).first().value
    assert json.loads(text) == sample("é x") and "é" in text
    with pytest.raises(DataFormatError):
        sinks.write_processed(formats.samples(converted).filter("false"), str(tmp_path / "q"))
    sinks.write_outcome(converted, str(tmp_path / "o"))
    assert spark.read.parquet(str(tmp_path / "o")).groupBy("accepted").count().count() == 2
    report_path = sinks.write_eval_report(spark.createDataFrame([(0, None)], "turns int, bleu double"), str(tmp_path / "r"))
    lines_written = [r.value for r in spark.read.text(report_path).collect()]
    assert len(lines_written) > 2 and json.loads("\n".join(lines_written)) == {"turns": 0, "bleu": None}
