"""Trees followed by a stream: only changed files are read, and totals are those of a full scan."""

from __future__ import annotations

import os
import shutil
import time

import pytest

from tallyscope.config import DEFAULTS
from tallyscope.languages import built_in
from tallyscope.operators import history
from tallyscope.plans import scan
from tallyscope.streaming import growth

LANGUAGES = built_in()
TOTALS = ("files", "lines", "code_lines", "extra_lines", "bytes", "average_bytes")


def write(path, text: str) -> None:
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)


@pytest.fixture
def tree(tmp_path):
    top = tmp_path / "tree"
    for a in range(3):
        for k in range(4):
            write(top / f"d{a}" / "in" / f"f{k}.py", "class A:\n    x = 1\n# note\n" * (k + 1))
    write(top / "d0" / "big.java", "/* x */ int a;\nclass B {\n" * 40)
    write(top / "d1" / "note.unknown", "none")
    (top / "d2" / "bad.py").write_bytes(b"x\n\xff\n")
    return top


class Followed:
    def __init__(self, spark, tree, folder, settle=0.0):
        self.spark, self.tree, self.folder, self.settle, self.changes = spark, tree, folder, settle, []

    def __call__(self):
        """Bring up to date; the rows must be those of a full scan."""
        growth.follow(self.spark, [str(self.tree)], LANGUAGES, DEFAULTS, str(self.folder), f"{self.folder}/log.txt", settle=self.settle, range_bytes=200, on_change=self.changes.append).awaitTermination()
        columns = ["path", "language", "bytes", "error", "lines", "code_lines", "counts"]
        got = sorted(map(repr, growth.current(self.spark, str(self.folder)).select(columns).collect()))
        run = scan.scan(self.spark, [str(self.tree)], LANGUAGES, DEFAULTS)
        assert got == sorted(map(repr, run.files.select(columns).collect()))
        change = self.changes[-1]
        assert change.totals == {c: run.counted[c] for c in TOTALS}
        assert sorted(map(tuple, growth.language_stats(self.spark, str(self.folder)).collect())) == sorted(map(tuple, run.language_stats().collect()))
        return change.read, change.new, change.carried, change.gone

    def logged(self):
        table = history.table_of(f"{self.folder}/log.txt")
        return [r.files for r in (history.read_runs(self.spark, table) or self.spark.createDataFrame([], history.LOGGED)).orderBy("ts").collect()]


def test_only_changed_files_are_read(spark, tree, tmp_path):
    follow = Followed(spark, tree, tmp_path / "kept")
    assert follow() == (14, 14, 0, 0)
    assert follow() == (0, 0, 14, 0) and follow.logged() == [13]
    versions = growth._names(spark, str(follow.folder))
    assert len(versions) == 1  # nothing changed, nothing written
    write(tree / "d0" / "in" / "f1.py", "y = 2\n")
    write(tree / "d3" / "new.py", "z\n")
    os.remove(tree / "d1" / "in" / "f0.py")
    assert follow() == (2, 2, 12, 1) and follow.logged() == [13, 13]
    shutil.move(tree / "d2" / "in" / "f3.py", tree / "d2" / "moved.py")  # an old file under a new name
    shutil.move(tree / "d1", tree / "away")  # a folder under a new name
    assert follow() == (4, 4, 10, 4)
    stat = os.stat(tree / "d3" / "new.py")
    write(tree / "d3" / "new.py", "w\n")
    os.utime(tree / "d3" / "new.py", ns=(stat.st_atime_ns, stat.st_mtime_ns))  # as large and as old as before, yet changed
    assert follow() == (1, 1, 13, 0)
    (tree / "d2" / ".gitignore").write_text("moved.py\n")
    (tree / ".git").mkdir()
    assert follow()[3] == 1  # ignored now
    assert len(growth._names(spark, str(follow.folder))) == 2


def test_a_tree_that_goes_and_comes_back(spark, tree, tmp_path):
    follow = Followed(spark, tree, tmp_path / "kept")
    follow()
    os.rename(tree, tmp_path / "aside")
    growth.follow(spark, [str(tree)], LANGUAGES, DEFAULTS, str(follow.folder), settle=0, on_change=follow.changes.append).awaitTermination()
    assert follow.changes[-1].gone == 14 and growth.current(spark, str(follow.folder)).count() == 0
    assert growth.language_stats(spark, str(follow.folder)).count() == 0 and follow.changes[-1].totals == dict.fromkeys(TOTALS, 0)
    os.rename(tmp_path / "aside", tree)
    assert follow() == (14, 14, 0, 0)


def test_files_that_may_still_change_are_read_again(spark, tree, tmp_path):
    follow = Followed(spark, tree, tmp_path / "kept", settle=3600.0)
    assert follow() == (14, 14, 0, 0)
    assert follow() == (14, 0, 0, 0) and follow.logged() == [13]


def test_a_batch_run_again_changes_nothing(spark, tree, tmp_path):
    follow = Followed(spark, tree, tmp_path / "kept")
    follow()
    write(tree / "d3" / "new.py", "z\n")
    listing = spark.createDataFrame([], growth.SEEN)
    change = growth.absorb(listing, 0, 0, str(follow.folder), LANGUAGES, DEFAULTS)
    assert change.again and change.carried == 14 and change.totals["files"] == 13 and growth.current(spark, str(follow.folder)).count() == 14
    os.makedirs(follow.folder / "_writing-other")  # of a driver that ended
    assert follow() == (1, 1, 14, 0)
    table = history.table_of(f"{follow.folder}/log.txt")
    newest = history.runs(spark, table)[0]
    history.append_entry(spark, table, {"ts": None}, newest.rpartition("-")[2])
    assert follow.logged() == [13, 14]


def test_followed_until_stopped(spark, tree, tmp_path):
    changes = []
    query = growth.follow(spark, [str(tree)], LANGUAGES, DEFAULTS, str(tmp_path / "kept"), every="1 second", settle=0, on_change=changes.append)
    try:
        for added in range(2):
            end = time.time() + 60
            while not any(c.totals["files"] == 13 + added for c in changes) and time.time() < end:
                time.sleep(0.2)
            write(tree / "d0" / f"added{added}.py", "x\n")
    finally:
        query.stop()
    assert query.exception() is None and any(c.new == 1 and c.carried == 14 for c in changes)


def test_rounds_open_no_folder(monkeypatch):
    monkeypatch.setattr(os, "scandir", None)
    reader = growth.RoundsReader({"targets": '["/a", "/b"]'})
    assert reader.initialOffset() == {"at": 0} and reader.latestOffset()["at"] > 0
    assert [r for p in reader.partitions({"at": 0}, {"at": 5}) for r in reader.read(p)] == [("/a", 5), ("/b", 5)]
