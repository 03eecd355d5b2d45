"""Named files through packs and a commit, and pages of documents in ranges."""

import os
import sys

import pyarrow as pa
import pytest
from pyspark import cloudpickle

from leafmill.sources import packs, pages

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers can't import tests


def seen(folder):
    """Files that a user of the folder sees."""
    return {str(p.relative_to(folder)): p.read_bytes() for p in folder.rglob("*") if p.is_file() and not p.relative_to(folder).parts[0].startswith(".")}


def test_files_appear_after_the_commit(spark, tmp_path):
    folder = tmp_path / "out"
    rows = spark.createDataFrame([(f"d{i % 3}/f{i}.md", f"text {i}" * i) for i in range(40)], "filename string, content string").repartition(5)
    packs.stage(rows, str(folder))
    assert seen(folder) == {}
    assert packs.publish(spark, f"file://{folder}").count() == 40
    assert seen(folder) == {f"d{i % 3}/f{i}.md": (f"text {i}" * i).encode() for i in range(40)}
    assert list((folder / packs.COMMITS).iterdir()) == list((folder / packs.PACKS).iterdir()) == []
    packs.stage(rows.withColumn("content", rows.content), str(folder))
    assert packs.publish(spark, str(folder)).count() == 0
    packs.stage(spark.createDataFrame([("d0/f0.md", "b"), ("d0/f0.md", "c"), ("d0/f0.md", "a"), ("new", "")], "filename string, content string").repartition(3), str(folder))
    assert packs.publish(spark, str(folder)).count() == 2 and (folder / "d0/f0.md").read_text() == "c" and (folder / "new").read_bytes() == b""


def test_failed_job_leaves_nothing(spark, tmp_path):
    folder = tmp_path / "out"
    for bad in (None, "../x", "/x", "a/../../x", ".packs/x", ""):
        with pytest.raises(ValueError, match="not a file name"):
            packs.PackWriter(str(folder)).write(iter([pa.RecordBatch.from_pydict({"filename": ["a", bad], "content": [b"1", b"2"]})]))
    rows = spark.createDataFrame([(f"f{i}", "x") for i in range(20)] + [("../x", "y")], "filename string, content string").repartition(4)
    with pytest.raises(Exception, match="not a file name"):
        packs.stage(rows, str(folder))
    with pytest.raises(Exception, match="without content"):
        packs.stage(spark.createDataFrame([("a", None)], "filename string, content string"), str(folder))
    assert packs.publish(spark, str(folder)).count() == 0 and seen(folder) == {}
    packs.sweep(str(folder))  # tasks killed with the job may end after the abort
    assert [p for p in tmp_path.rglob("*") if p.is_file()] == []


def test_task_that_dies_and_publish_that_stops(spark, tmp_path, monkeypatch):
    folder = tmp_path / "out"
    writer = packs.PackWriter(str(folder))

    batch = pa.RecordBatch.from_pydict({"filename": ["a", "b"], "content": [b"1", b"2"]})

    def dies():
        yield batch
        raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        writer.write(dies())
    lost, kept = writer.write(iter([batch])), writer.write(iter([batch]))
    writer.commit([kept, None, writer.write(iter([]))])
    killed = packs.PackWriter(str(folder))
    killed.write(iter([batch]))
    assert lost.pack != kept.pack and seen(folder) == {} and packs.sweep(str(folder)) == 1
    # All files are placed, then the driver dies before the manifest goes: the next run finds nothing to change.
    with monkeypatch.context() as m:
        real = packs.store

        class Stops:
            def __init__(self, fs):
                self.fs = fs

            def __getattr__(self, name):
                return getattr(self.fs, name)

            def delete_file(self, path):
                raise OSError("gone")

        m.setattr(packs, "store", lambda f: (Stops(real(f)[0]), real(f)[1]))
        with pytest.raises(OSError, match="gone"):
            packs.publish(spark, str(folder))
    assert seen(folder) == {"a": b"1", "b": b"2"}
    assert packs.publish(spark, str(folder)).count() == 0 and packs.sweep(str(folder)) == 0
    assert seen(folder) == {"a": b"1", "b": b"2"}


class Lines:
    """Pages are lines; BAD can't be read; each call leaves a line in a log."""

    def __init__(self, log, content):
        if content == b"TORN":
            raise ValueError("torn")
        self.log, self.lines = log, content.decode().split("\n")
        self.told("open")

    def told(self, what):
        with open(self.log, "a") as f:
            f.write(f"{what} {os.getpid()}\n")

    def __len__(self):
        return len(self.lines)

    def text(self, page):
        self.told("text")
        if self.lines[page] == "BAD":
            raise ValueError("bad page")
        return self.lines[page]

    def geometry(self, page):
        self.told("geometry")
        return [("raster", 0.0, 0.0, float(page), 1.0, 612.0, 792.0)], [(0, 0.0, 0.0, 1.0, 1.0, self.lines[page])]


def test_pages_in_ranges(spark, tmp_path):
    folder, log = tmp_path / "in", tmp_path / "log"
    folder.mkdir()
    (folder / "long.pdf").write_text("\n".join(f"page {i}" for i in range(1000)))
    (folder / "one.pdf").write_text("only\nBAD")
    (folder / "torn.pdf").write_text("TORN")
    (folder / "other.txt").write_text("x")
    opener = lambda content: Lines(str(log), content)
    told = lambda what: sum(x.startswith(what) for x in (log.read_text().splitlines() if log.exists() else []))
    rows = pages.pages(spark, str(folder), ("filename",), opener, splitBytes=1000)
    assert rows.rdd.getNumPartitions() == 10 and sorted(r[0] for r in rows.collect()) == ["long.pdf", "one.pdf", "torn.pdf"] and told("open") == 0
    rows = pages.pages(spark, f"file://{folder}", ("filename", "page", "text", "error"), opener, splitBytes=1000).collect()
    assert told("geometry") == 0 and told("text") == 1002 and told("open") == 10
    assert sorted((r.page, r.text) for r in rows if r.filename == "long.pdf") == [(i, f"page {i}") for i in range(1000)]
    assert [(r.filename, r.page, r.text) for r in rows if r.error] == [("one.pdf", 1, None), ("torn.pdf", None, None)]
    found = pages.pages(spark, str(folder), ("page", "prims", "filename"), opener, splitBytes=1000, maxPages=3).where("filename = 'long.pdf'").collect()
    assert sorted((r.page, r.prims[0].x1) for r in found) == [(0, 0.0), (1, 1.0), (2, 2.0)] and told("text") == 1002
    empty = tmp_path / "none"
    empty.mkdir()
    assert pages.pages(spark, str(empty), opener=opener).count() == 0
    with pytest.raises(Exception, match="[Nn]o such|not found|does not exist|Cannot"):
        pages.pages(spark, str(tmp_path / "missing"), opener=opener).count()


def test_shares():
    made = pages.shares([("a", 3), ("b", 4), ("c", 5), ("d", 21), ("e", 0), ("f", 10)], 10)
    assert [s.files for s in made] == [[("a", 0, 1), ("b", 0, 1)], [("d", 0, 3)], [("d", 1, 3)], [("d", 2, 3)], [("c", 0, 1), ("e", 0, 1)], [("f", 0, 1)]]
    assert pages.shares([], 10) == []


def test_a_file_is_looked_up_by_its_link(tmp_path, monkeypatch):
    """A new file takes one step in the folder that tasks share; a known one is compared, a folder made where it lacks."""
    looked = []
    real = packs.held
    monkeypatch.setattr(packs, "held", lambda fs, path, size: looked.append(path) or real(fs, path, size))
    place = packs.LocalPlace(packs.store(str(tmp_path))[0], f"{tmp_path}/.own")
    assert place(f"{tmp_path}/a", b"1") and place(f"{tmp_path}/deep/er/b", b"2") and looked == []
    assert not place(f"{tmp_path}/a", b"1") and place(f"{tmp_path}/a", b"22") and place(f"{tmp_path}/deep/er/b", b"3")
    assert seen(tmp_path) == {"a": b"22", "deep/er/b": b"3"} and not os.listdir(f"{tmp_path}/.own")
    monkeypatch.setattr(os, "link", lambda *a: (_ for _ in ()).throw(PermissionError("no links here")))
    assert place(f"{tmp_path}/c", b"4") and not place(f"{tmp_path}/c", b"4") and seen(tmp_path)["c"] == b"4"
