"""Following log files by byte offsets."""

import random

import pytest

from chatloom.streaming import chunks as cs
from chatloom.streaming import follow as fl


@pytest.fixture
def follow(spark, tmp_path):
    """Run the query on what is there now; gives the lines of that run."""
    out, seen = str(tmp_path / "out"), []

    def run(path, **how):
        cs.run_available(fl.follow_files(spark, str(path), ("sk-secret",), **how), out, str(tmp_path / "ckpt"))
        lines = sorted((r.path.rsplit("/", 1)[-1], r.offset, r.line) for r in spark.read.schema("path string, offset long, line string").parquet(out).collect())
        new = list(lines)
        for line in seen:
            new.remove(line)
        seen[:] = lines
        return [line for _, _, line in new]

    return run


def test_new_lines_only_with_a_held_tail(follow, tmp_path):
    log = tmp_path / "server.log"
    log.write_text("old line\n")
    assert follow(log) == []
    log.write_text("old line\napi-key sk-secret boom\npartial")
    assert follow(log) == ["api-key *** boom"]
    assert follow(log) == []
    with log.open("a") as f:
        f.write(" done\n\nnext sk-")
    assert follow(log) == ["partial done", ""]
    with log.open("a") as f:
        f.write("secret")
    assert follow(log, flush=True) == ["next ***"]


def test_truncated_file_is_read_from_its_beginning(follow, tmp_path):
    log = tmp_path / "server.log"
    log.write_text("a first line\nand a second\n")
    assert follow(log, starting="earliest") == ["a first line", "and a second"]
    log.write_text("cut\n")
    assert follow(log) == ["cut"]
    log.write_text("written anew and longer than it was\n")  # shows by its head alone
    assert follow(log) == ["written anew and longer than it was"]
    log.write_text("")
    assert follow(log) == []
    log.write_text("again\n")
    assert follow(log) == ["again"]


def test_rotated_file_is_not_read_twice(follow, tmp_path):
    logs = tmp_path / "logs"
    logs.mkdir()
    (logs / "app.log").write_text("one\ntwo\n")
    assert follow(logs, starting="earliest") == ["one", "two"]
    with (logs / "app.log").open("a") as f:
        f.write("three\n")
    (logs / "app.log").rename(logs / "app.log.1")
    (logs / "app.log").write_text("four\n")
    (logs / "_hidden").write_text("no\n")
    assert sorted(follow(logs)) == ["four", "three"]


def test_missing_file_appears_later(follow, tmp_path):
    log = tmp_path / "later.log"
    assert follow(log) == []
    log.write_bytes(b"bad \xff byte\r\n")
    assert follow(log) == ["bad � byte\r"]


def test_ranges_of_one_file_cut_no_line(tmp_path):
    rng = random.Random(3)
    lines = ["x" * rng.choice([0, 1, 5, 40, 300]) for _ in range(400)]
    log = tmp_path / "big.log"
    log.write_text("\n".join(lines) + "\n" + "tail")
    whole = log.read_bytes()
    for size in (1, 7, 64, 1000, 10**6):
        for skipped in (0, len(lines[0]) + 1):
            reader = fl.FollowReader({"path": str(log), "startingoffsets": "earliest", "rangebytes": str(size)})
            end = reader.latestOffset()
            assert end[str(log)]["at"] == len(whole) - 4
            start = {str(log): {**end[str(log)], "at": skipped}} if skipped else {}
            parts = reader.partitions(start, end)
            assert len(parts) == -(-(len(whole) - 4 - skipped) // size)
            got = [r for p in parts for b in reader.read(p) for r in zip(*(c.to_pylist() for c in b.columns))]
            assert [r[2] for r in got] == lines[bool(skipped) :]
            assert all(whole[r[1] : r[1] + len(r[2])].decode() == r[2] for r in got)


def test_line_longer_than_a_block(tmp_path, monkeypatch):
    monkeypatch.setattr(fl, "BLOCK", 16)
    log = tmp_path / "long.log"
    log.write_text("a" * 100 + "\n" + "b" * 50)
    reader = fl.FollowReader({"path": str(log), "startingoffsets": "earliest", "rangebytes": "30"})
    end = reader.latestOffset()
    got = [r for p in reader.partitions({}, end) for b in reader.read(p) for r in b.column(2).to_pylist()]
    assert got == ["a" * 100]
