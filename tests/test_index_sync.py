"""Runs of a sync over real files: first, changed, fresh, broken off; folders that are missing or below, other suffixes."""

import os

import pytest

from palimpsest.sources.files import files, write_files
from palimpsest.streaming.index_sync import IndexSync


@pytest.fixture
def sync(spark, tmp_path):
    return IndexSync(spark, f"file://{tmp_path}/store", ["memory/a", "memory/none", "memory/b"], f"file://{tmp_path}/state")


def put(tmp_path, path, text, ms):
    at = tmp_path / "store" / path
    at.parent.mkdir(parents=True, exist_ok=True)
    at.write_text(text)
    os.utime(at, ns=(ms * 1_000_000, ms * 1_000_000))


def changed(rows):
    return sorted(r.path for r in rows if r.changed)


def test_a_second_run_reads_only_what_changed(sync, tmp_path):
    put(tmp_path, "memory/a/one.md", "## e1\nCategory: x\nbody one\n## e2\nbody two\n", 1000)
    put(tmp_path, "memory/a/two.md", "no entry here", 2000)
    put(tmp_path, "memory/b/three.md", "## e3\nthree", 1500)
    put(tmp_path, "memory/b/below/four.md", "## e4\nfour", 9000)
    put(tmp_path, "memory/b/five.txt", "## e5\nfive", 9000)
    first = sync.sync("start").collect()
    assert changed(first) == ["memory/a/one.md", "memory/a/two.md", "memory/b/three.md"]
    assert {(r.synced, r.reason, r.indexed_before, r.indexed_after) for r in first} == {(True, "start", False, True)}
    assert {r.updated_at for r in first} == {1000, 2000, 1500}
    again = sync.sync().collect()
    assert changed(again) == [] and {(r.synced, r.reason, r.indexed_before) for r in again} == {(False, "fresh", True)}
    put(tmp_path, "memory/a/one.md", "## e1\nbody changed", 3000)
    put(tmp_path, "memory/b/older.md", "## e6\nsix", 100)  # older than the mark: not seen, as the mark is all a run knows
    third = sync.sync().collect()
    assert changed(third) == ["memory/a/one.md"]
    assert {r.path: (r.indexed_before, r.indexed_after) for r in third}["memory/b/older.md"] == (False, False)
    inbox = sync.spark.read.parquet(f"{sync.state}/inbox/run=2")
    assert [r.path for r in inbox.collect()] == ["memory/a/one.md"]  # nothing else was read
    assert sorted((r.path, r.entry_id, r.body) for r in sync.chunks().collect()) == [("memory/a/one.md", "e1", "body changed"), ("memory/b/three.md", "e3", "three")]


def test_a_run_that_breaks_off_is_made_good(sync, tmp_path, monkeypatch):
    put(tmp_path, "memory/a/one.md", "## e1\none", 1000)
    monkeypatch.setattr(IndexSync, "_take", lambda self: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        sync.sync()
    monkeypatch.undo()
    assert changed(sync.sync().collect()) == ["memory/a/one.md"] and sync.chunks().count() == 1
    # Broken off after the index and before the mark: the file comes twice, its entries once.
    for p in (tmp_path / "state" / "runs").rglob("*"):
        if p.is_file():
            p.unlink()
    assert changed(sync.sync().collect()) == ["memory/a/one.md"] and [r.body for r in sync.chunks().collect()] == ["one"]


def test_nothing_to_read(sync, spark, tmp_path):
    assert sync.sync().count() == 0 and sync.chunks().count() == 0
    assert files(spark, "file:///nowhere", ["x"]).count() == 0


def test_metadata_is_read_without_contents(spark, tmp_path):
    put(tmp_path, "memory/a/one.md", "x" * 1000, 1000)
    plan = files(spark, f"file://{tmp_path}/store", ["memory/a"]).select("path", "mtime")._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan


def test_files_are_written_in_the_order_of_places(spark, tmp_path):
    rows = spark.createDataFrame([("d/a.md", 2, "two\n"), ("d/a.md", 1, "one\n"), ("d/b.md", 1, None)], "path string, place long, text string")
    assert write_files(rows, f"file://{tmp_path}/w") == 2
    assert (tmp_path / "w/d/a.md").read_text() == "one\ntwo\n" and (tmp_path / "w/d/b.md").read_text() == ""
