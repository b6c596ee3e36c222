"""Model folders are listed and read by tasks, as Spark's file scan would, and sink files are put in place by tasks."""

import os

import pytest
from pyspark.sql import functions as F

from chatloom.sources import files, listing, readers


@pytest.fixture
def models(tmp_path):
    root = tmp_path / "models"
    for name in (
        "m1/README.md", "m1/LICENSE", "m1/license", "m1/sub/README.md", "m1/w.bin", "m 2 é:%20/LICENSE.txt", "README.md", "_m/README.md", ".m/README.md",
        "_k=v/README.md", "m3/._x", "m3/_tmp/x", "m3/a._COPYING_", "m3/_metadata", "_metadata_of/README.md", "m4/README.md/README.md", "m5/_k=v/x",
    ):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(name.encode() + b"\xff")
    (root / "m1" / "configuration.json").write_bytes(b"")
    (root / "m6").symlink_to(root / "m1")
    (root / "m3" / "README.md").symlink_to(root / "none")
    (root / "empty").mkdir()
    return str(root)


@pytest.mark.parametrize("depth", [1, 2])
def test_same_rows_as_a_file_scan(spark, models, depth):
    scan = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(models)
    for spelled in (models, f"file://{models}/", f"file:{models}"):
        assert sorted(readers.scan_model_cards(spark, spelled, depth).collect()) == sorted(readers.card_rows(scan, models, depth).collect())
        found = readers.scan_listing(spark, spelled, depth)
        assert sorted(found.collect()) == sorted(readers.listing_rows(scan, models, depth).collect()) and found.count()


def test_the_driver_lists_no_files(spark, models):
    for frame in (readers.scan_model_cards(spark, models), readers.scan_listing(spark, models)):
        assert frame.inputFiles() == []


def test_other_roots_are_left_to_spark(spark, tmp_path):
    assert listing.local_folder(spark, "s3a://b/models") is None and listing.local_folder(spark, "models") is None
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        readers.scan_model_cards(spark, str(tmp_path / "none"))


def test_files_are_put_in_place_by_tasks(spark, tmp_path, monkeypatch):
    seen, by_tasks = [], files._by_tasks
    monkeypatch.setattr(files, "_by_tasks", lambda folders, uri, work, schema: seen.append(work.__name__) or by_tasks(folders, uri, work, schema))
    rows = spark.range(300, numPartitions=5).select(F.concat("id", F.lit("/a/README.md")).alias("name"), F.col("id").cast("string").alias("content"))
    files.write_files(rows, str(tmp_path / "out"))
    assert seen == ["looked_at", "placed"]
    assert {(tmp_path / "out" / str(i) / "a" / "README.md").read_text() == str(i) for i in range(300)} == {True}
    assert sorted(os.listdir(tmp_path / "out")) == sorted([*map(str, range(300)), "_SUCCESS"])


@pytest.mark.parametrize("mode", ["append", "overwrite"])
def test_a_file_that_cannot_be_placed_takes_the_others_back(spark, tmp_path, mode):
    out = tmp_path / "out"
    files.write_files(spark.createDataFrame([("old/x", "o")], "name string, content string"), str(out))
    rows = spark.createDataFrame([(f"m{i}/x", "t") for i in range(20)] + [("m3/x/y", "t")], "name string, content string").repartition(4)
    with pytest.raises(Exception):
        files.write_files(rows, str(out), mode)
    left = sorted(os.path.relpath(os.path.join(d, f), out) for d, _, fs in os.walk(out) for f in fs if not f.startswith("."))
    assert left == ["_SUCCESS", "old/x"] and (out / "old" / "x").read_text() == "o"


def test_of_a_name_given_twice_the_last_replaces(spark, tmp_path):
    rows = spark.createDataFrame([("a", str(i)) for i in range(8)], "name string, content string").coalesce(1)
    assert files.write_files(rows, str(tmp_path / "out"), replace=True)["files"] == 8
    assert (tmp_path / "out" / "a").read_text() == "7"
