"""The whole run with a backend that reads made-up files, and new files as a stream."""

import json
import sys

from pyspark import cloudpickle

from leafmill.plans import batch
from leafmill.sources import pdf
from leafmill.streaming import incremental

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers can't import tests


class Made:
    """Files are JSON: text, prims, blocks."""

    def _read(self, content):
        return json.loads(content.split(b"%%", 1)[1])

    def text(self, content, max_pages):
        return self._read(content)["text"]

    def geometry(self, content, max_pages):
        made = self._read(content)
        return [tuple(x) for x in made["prims"]], [tuple(x) for x in made["blocks"]]

    def crops(self, content, wanted, dpi):
        return [b"PNG"] * len(wanted)


def test_run(spark, tmp_path):
    papers = tmp_path / "papers"
    papers.mkdir()

    def put(name, title, text, prims=(), blocks=()):
        (papers / name).write_bytes(f"/Title ({title}) %%".encode() + json.dumps({"text": text, "prims": prims, "blocks": blocks}).encode())

    put("one.pdf", "Paper One", "Some text.\nFigure 1: it\nmore", [[0, "raster", 100, 100, 400, 400, 612, 792]], [[0, 0, 100, 410, 400, 420, "Figure 1: it"]])
    put("two.pdf", "Paper Two", "x 10.1145/9.9 y")
    put("empty.pdf", "Nothing", "")
    o = batch.Options(str(papers), str(tmp_path / "out"), str(tmp_path / "work"), combined=True, backend=Made())
    first = batch.run(spark, o)
    assert first.papers == 3 and first.failures == 0 and first.crops == 1 and first.exit_code == 0
    assert first.written == sorted(["INDEX.md", "PAPERS_SUMMARY.md", "one.md", "two.md", "empty.md", "raw/one.md", "raw/two.md"])
    one = (tmp_path / "out" / "one.md").read_text()
    assert one.startswith("# Paper One\n") and "![Figure 1: it](figures/one/fig_p0_0.png)" in one
    assert "![Figure 1](../figures/one/fig_p0_0.png)" in (tmp_path / "out" / "raw" / "one.md").read_text()
    assert (tmp_path / "out" / "figures" / "one" / "fig_p0_0.png").read_bytes() == b"PNG"
    assert "10.1145/9.9" in (tmp_path / "out" / "two.md").read_text()
    second = batch.run(spark, o)
    assert second.papers == 3 and second.written == []
    put("two.pdf", "Paper Two", "changed text")
    o.paper = "two"
    third = batch.run(spark, o)
    assert third.papers == 1 and "two.md" in third.written and "one.md" not in third.written
    assert "Paper One" in (tmp_path / "out" / "INDEX.md").read_text()


class Counting(Made):
    """Leaves a line for each call; files with BAD have unreadable pages, those with TORN no crops."""

    def __init__(self, log):
        self.log = log

    def _told(self, what):
        with open(self.log, "a") as f:
            f.write(what + "\n")

    def text(self, content, max_pages):
        self._told("text")
        return super().text(content, max_pages)

    def geometry(self, content, max_pages):
        self._told(f"geometry{max_pages or ''}")
        if b"BAD" in content:
            raise ValueError("no such page")
        return super().geometry(content, max_pages)

    def crops(self, content, wanted, dpi):
        self._told(f"crops{len(wanted)}")
        if b"TORN" in content:
            raise ValueError("no such picture")
        return [ValueError("no ink") if b"DRY" in content and k else b"PNG" for k in range(len(wanted))]


def test_each_file_is_parsed_once_and_fails_alone(spark, tmp_path):
    papers = tmp_path / "papers"
    papers.mkdir()
    picture = {"prims": [[0, "raster", 100, 100, 400, 400, 612, 792]], "blocks": [[0, 0, 100, 410, 400, 420, "Figure 1: it"]]}
    for name, text in (("good.pdf", "fine"), ("bad.pdf", "BAD"), ("torn.pdf", "TORN")):
        (papers / name).write_bytes(b"%%" + json.dumps({"text": text, **picture}).encode())
    o = batch.Options(str(papers), str(tmp_path / "out"), str(tmp_path / "work"), backend=Counting(str(tmp_path / "log")))
    done = batch.run(spark, o)
    calls = (tmp_path / "log").read_text().split()
    assert (calls.count("text"), calls.count("geometry"), calls.count("crops1")) == (6, 3, 2)
    assert done.papers == 1 and done.failures == 2 and done.exit_code == 1
    assert done.errors == ["extract failed for bad.pdf: ValueError: no such page", "extract failed for torn.pdf: ValueError: no such picture"]
    assert (tmp_path / "out" / "good.md").exists() and not (tmp_path / "out" / "bad.md").exists()


def test_a_document_is_opened_once_for_all_its_figures(spark, tmp_path):
    """Three figures of a file: one row with its content, one opening; a page limit reaches the parser; a place fails alone."""
    papers = tmp_path / "papers"
    papers.mkdir()
    picture = {"prims": [[p, "raster", 100, 100, 400, 400, 612, 792] for p in range(3)], "blocks": [[p, 0, 100, 410, 400, 420, f"Figure {p + 1}: it"] for p in range(3)]}
    (papers / "three.pdf").write_bytes(b"/Title (Three Pictures) %%" + json.dumps({"text": "fine", **picture}).encode())
    (papers / "dry.pdf").write_bytes(b"%%" + json.dumps({"text": "DRY", **picture}).encode())
    (papers / "plain.pdf").write_bytes(b"%%" + json.dumps({"text": "none", "prims": [], "blocks": []}).encode())
    o = batch.Options(str(papers), str(tmp_path / "out"), str(tmp_path / "work"), max_pages=3, backend=Counting(str(tmp_path / "log")))
    from leafmill.sources import files

    got = {r.filename: r for r in batch.extracted(spark, files.pdf_files(spark, str(papers)), o).collect()}
    assert sorted((tmp_path / "log").read_text().split()) == sorted(["text"] * 6 + ["geometry3"] * 3 + ["crops3"] * 2)
    assert got["three.pdf"].title == "Three Pictures" and [f.page for f in got["three.pdf"].figures] == [0, 1, 2] and got["three.pdf"].error is None
    assert [f.png_path is None for f in got["dry.pdf"].figures] == [False, True, True] and got["dry.pdf"].error == "ValueError: no ink"
    places = spark.createDataFrame([("a", k, 0, k, (1.0, 2.0, 3.0, 4.0)) for k in range(3)], "doc_id string, ord int, page int, fig_idx int, crop_rect struct<x0:double,y0:double,x1:double,y1:double>")
    plan = pdf.write_crops(spark.createDataFrame([("a.pdf", bytearray(b"x"))], "filename string, content binary"), places, o.backend, str(tmp_path / "f"))._jdf.queryExecution().optimizedPlan().toString()
    assert "rightHint=(strategy=broadcast)" in plan and "collect_list" in plan


class Deep(Made):
    def text(self, content, max_pages):
        raise RecursionError("too deep")


def test_a_text_that_cannot_be_read_is_empty(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%%" + json.dumps({"text": "x", "prims": [], "blocks": []}).encode())
    from leafmill.sources import files

    row = pdf.read(files.pdf_files(spark, str(tmp_path)), Deep()).first()
    assert row.raw_text == "" and row.error is None


def test_models_and_client(monkeypatch):
    import types

    from leafmill.operators import model

    made, asked = [], []

    class OpenAI:
        def __init__(self, **kw):
            made.append(kw)
            reply = types.SimpleNamespace(choices=[types.SimpleNamespace(message=types.SimpleNamespace(content="x"))])
            self.chat = types.SimpleNamespace(completions=types.SimpleNamespace(create=lambda **kw: asked.append(kw["model"]) or reply))

    monkeypatch.setitem(sys.modules, "openai", types.SimpleNamespace(OpenAI=OpenAI))
    for name, value in (("OPENAI_API_KEY", "k"), ("OPENAI_MODEL", "words"), ("OPENAI_VISION_MODEL", "pictures")):
        monkeypatch.setenv(name, value)
    chat = model.ChatModel()
    chat.complete(["a"], [None])
    chat.complete(["b"], ["aW1n"])
    monkeypatch.delenv("OPENAI_VISION_MODEL")
    chat.complete(["c"], ["aW1n"])
    assert asked == ["words", "pictures", "words"] and len(made) == 1


def test_missing_library_is_told(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF")
    from leafmill.sources import files

    row = pdf.read(files.pdf_files(spark, str(tmp_path)), pdf.Libraries()).first()
    assert row.raw_text == "" and "not installed" in row.error


def test_stream(spark, tmp_path):
    src = tmp_path / "src"
    src.mkdir()
    seen = []

    def drain():
        incremental.drain(incremental.new_files(spark, str(src)), str(tmp_path / "ck"), lambda df, _: seen.extend(r.filename for r in df.select("filename").collect()))

    (src / "a.pdf").write_bytes(b"1")
    drain()
    (src / "b.pdf").write_bytes(b"2")
    (src / "c.txt").write_bytes(b"3")
    drain()
    assert seen == ["a.pdf", "b.pdf"]
