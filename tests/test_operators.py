"""Operators on small cases: what the text functions, geometry, models, documents and state do."""

import random
import sys
import time

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from leafmill.functions import pdfbytes
from leafmill.functions import strings as S
from leafmill.operators import chunking, layout, model, render, state, titles, weave
from leafmill.schemas import BLOCKS, FIGURES, PAPER, PRIMS, STATE
from leafmill.sources import files, sinks

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers can't import tests

ODD_SPACE = ["", " ", " a ", "\x1ca\x1d", "a ", " x　", "a\nb\n", "\n", "a\r\nb\rc\x0bd\x0ce\x1cf\x85g h i", "a\n\n", "\r\n", "x" + " " * 50 + "y" + " \t" * 20]


def column(spark, values, f, kind="string"):
    rows = spark.createDataFrame(list(enumerate(values)), f"i int, c {kind}").select("i", f(F.col("c")).alias("o")).collect()
    return [r.o for r in sorted(rows, key=lambda r: r.i)]


def test_python_strings(spark):
    assert column(spark, ODD_SPACE, S.py_strip) == [t.strip() for t in ODD_SPACE]
    assert column(spark, ODD_SPACE, S.py_lstrip) == [t.lstrip() for t in ODD_SPACE]
    assert column(spark, ODD_SPACE, S.py_rstrip) == [t.rstrip() for t in ODD_SPACE]
    assert column(spark, ODD_SPACE, S.py_splitlines) == [t.splitlines() for t in ODD_SPACE]


def test_cleaning(spark):
    assert column(spark, ["per-\nsonal a-\nb-\nc-\nd", "3-\n4"], S.dehyphenate) == ["personal ab-\ncd", "3-\n4"]
    assert column(spark, ["a \t\n\n\n\nb\x00 ", None], S.clean_text) == ["a\n\nb", None]
    kept = column(spark, ["Keep\n© 2024 X\n ACM ISBN 9\n* note\n* " + "long " * 30 + "\n  indented\nRecSys '24, x\nthe ACM ISBN\nThis work is licensed under"], S.strip_boilerplate)
    assert kept == ["Keep\n* " + ("long " * 30).strip() + "\n  indented\nthe ACM ISBN"]
    assert column(spark, ["eﬃcient of features Ａ", "plain"], S.clean_pdf_text) == ["efficient of features A", "plain"]
    assert column(spark, ["a\nb  c\n\n\n d\n"], S.normalize_for_sentences) == ["a b c\n\nd"]


def test_content(spark):
    assert column(spark, ["see https://doi.org/10.1145/3292500.3330701.", "none", "(10.1/x)", "10.12345/a_b-C;x)."], S.find_doi) == ["10.1145/3292500.3330701", None, None, "10.12345/a_b-C;x"]
    body = "We study things. " * 30
    assert column(spark, [f"T\nAbstract\n{body}\n1 Introduction\nrest", "no heading " * 50, "Abstract: " + "y" * 3000], S.extract_abstract) == [body.strip(), None, "y" * 1500]
    assert column(spark, ["The C++ Way: it's fine", "Über-Ähn lich", "A  b_c"], S.github_slug) == ["the-c-way-its-fine", "über-ähn-lich", "a--b_c"]


@pytest.mark.parametrize(
    ("data", "title"),
    [
        (b"/Title (a (nested) one)", "a (nested) one"), (rb"/Title(\(x\) \101\60 \q \\)", "(x) A0 q \\"), (b"/Title (a\\\r\nb\\\nc)", "abc"), (b"/Title (open", None), (b"/Title <feff>", None), (b"/Title (x) /Title (y)", "x"), (b"/Title  \r\n(\xfe\xff)", "þÿ"), (b"nothing", None), ("/Title (é)".encode(), "é"), (b"/Title (a\\", None),
    ],
)
def test_literal_strings(data, title):
    assert pdfbytes.literal_after(b"/Title", data) == title


def test_title_cascade(spark):
    xmp = b"<dc:title><rdf:Alt><rdf:li x='y'>From <b>XMP</b>\n title</rdf:li></rdf:Alt></dc:title>"
    page = "arXiv 2020 long enough line\nA title that is wrapped over\ntwo lines of the page\n"
    rows = [("2306.04833v2.pdf", b"", None), ("a.pdf", b"/Title (Good title)", page), ("b.pdf", b"/Title (Untitled)" + xmp, page), ("c.pdf", b"/Title (a b c d)" + xmp, page), ("my_own.v2.pdf", b"", "x"), ("d.pdf", b"/Title ( )", "x@y.org is here and long\nOne Author, Two Author, Three of them\nThe next line is long enough")]
    got = {r.filename: (r.title, r.title_source) for r in titles.with_titles(spark.createDataFrame(rows, "filename string, content binary, first_page string")).collect()}
    assert got == {
        "2306.04833v2.pdf": (titles.OVERRIDES["2306.04833v2.pdf"], "override"),
        "a.pdf": ("Good title", "metadata"),
        "b.pdf": ("From XMP title", "metadata"),
        "c.pdf": ("A title that is wrapped over two lines of the page", "first_page"),
        "my_own.v2.pdf": ("my own.v2", "filename"),
        "d.pdf": ("One Author, Two Author, Three of them", "first_page"),
    }


def test_names_meet_without_case(spark):
    words = ["Straße.pdf", "ﬁrst.pdf", "ΛΟΓΟΣ.pdf", "λόγος.pdf", "İx.pdf", "ABC.PDF", "ŉ.pdf", "ǰ.pdf"]
    assert column(spark, words, files.folded) == [w.casefold() for w in words]
    names = spark.createDataFrame([(w,) for w in words], "filename string")
    assert [r[0] for r in files.selected(names, "STRASSE").collect()] == ["Straße.pdf"] and [r[0] for r in files.selected(names, "First").collect()] == ["ﬁrst.pdf"]


def test_cut_text_equals_the_folds_and_is_linear(spark):
    rnd = random.Random(6)
    texts = ["".join(rnd.choices(["a", "bc", " ", "  ", "\n", "\n\n", "\t", "\u3000", "é\U0001f600", "x" * 30, "\n\n\n"], k=rnd.randint(0, 80))) for _ in range(400)]
    for text, got in zip(texts, column(spark, texts, lambda c: chunking.chunks(c, 40)), strict=True):
        assert list(chunking.cut_text(text, 40)) == got, text
    table = chunking.chunk_table(spark.createDataFrame(list(enumerate(texts)), "filename int, text string"), most=40, limit=None)
    assert "BatchEvalPythonUDTF" in table._jdf.queryExecution().executedPlan().toString() or "ArrowEvalPythonUDTF" in table._jdf.queryExecution().executedPlan().toString()
    found = {}
    for r in table.orderBy("filename", "idx").collect():
        found.setdefault(r.filename, []).append(r.chunk)
    assert found == {i: list(chunking.cut_text(t, 40)) for i, t in enumerate(texts) if list(chunking.cut_text(t, 40))}
    began = time.time()
    long = list(chunking.cut_text("word " * 4_000_000, 12_000))
    assert len(long) == 1667 and sum(map(len, long)) == 4_000_000 * 5 - 1667 and time.time() - began < 5


def test_one_file_written_in_ranges(spark, tmp_path):
    """Pieces of many tasks at their places; equal bytes leave the file alone, others replace it."""
    pieces = [(p, f"f{k:04d}", f"{p}-{k} é\U0001f600\n" * (k % 5)) for p in range(3) for k in range(400)]
    rows = list(pieces)
    random.Random(3).shuffle(rows)
    df = spark.createDataFrame(rows, "part int, filename string, piece string").repartition(7)
    want = "".join(t for _, _, t in sorted(pieces)).encode()
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert sinks.write_pieces(df, str(tmp_path), "all.md") and (tmp_path / "all.md").read_bytes() == want
        before = (tmp_path / "all.md").stat().st_mtime_ns
        assert not sinks.write_pieces(df, str(tmp_path), "all.md") and (tmp_path / "all.md").stat().st_mtime_ns == before
        same_size = df.withColumn("piece", F.when(F.col("filename") == "f0399", F.replace("piece", F.lit("2-"), F.lit("9-"))).otherwise(F.col("piece")))
        assert sinks.write_pieces(same_size, str(tmp_path), "all.md") and (tmp_path / "all.md").read_bytes() == want.replace(b"2-399", b"9-399")
        assert sinks.write_pieces(df.limit(0), str(tmp_path), "all.md") and (tmp_path / "all.md").read_bytes() == b""
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert [p.name for p in tmp_path.iterdir()] == ["all.md"]


def test_chunks(spark):
    rnd = random.Random(1)
    texts = ["", "hello world", "x" * 205, "word " * 90, "\n\n".join("p" * rnd.randint(1, 90) for _ in range(40)), " " * 300, "a " + "b" * 300 + "\n\nc", "é " * 200]
    for text, got in zip(texts, column(spark, texts, lambda c: chunking.chunks(c, 100)), strict=True):
        assert all(len(c) <= 100 for c in got) and ("".join("".join(got).split()) == "".join(text.split()))
    assert column(spark, ["", "hello world", " " * 300], lambda c: chunking.chunks(c, 100)) == [[""], ["hello world"], []]
    papers = spark.createDataFrame([("f", "\n\n".join(["p" * 60] * 5))], "filename string, text string")
    rows = sorted(chunking.chunk_table(papers, most=100, limit=2).collect())
    assert [(r.idx, r.total, len(r.chunk), r.skipped_chars) for r in rows] == [(1, 2, 60, 180), (2, 2, 60, 180)]
    assert chunking.chunk_table(papers, most=100, limit=0).count() == 0
    with pytest.raises(ValueError):
        chunking.chunk_table(papers, limit=-1)


def grown_slowly(boxes, gap=15):
    boxes = [tuple(b) for b in boxes]
    while True:
        for i, a in enumerate(boxes):
            for b in boxes[i + 1 :]:
                if a[2] + gap >= b[0] and b[2] + gap >= a[0] and a[3] + gap >= b[1] and b[3] + gap >= a[1]:
                    boxes = [x for x in boxes if x is not a and x is not b] + [(min(a[0], b[0]), min(a[1], b[1]), max(a[2], b[2]), max(a[3], b[3]))]
                    break
            else:
                continue
            break
        else:
            return sorted(boxes)


def test_boxes_grow_together():
    rng = np.random.default_rng(2)
    for _ in range(150):
        corner, size = rng.integers(0, 400, (rng.integers(1, 14), 2)), rng.integers(1, 90, (1, 2))
        boxes = np.concatenate([corner, corner + size], axis=1).astype(float)
        assert sorted(map(tuple, layout.grown(boxes))) == grown_slowly(boxes)
    assert len(layout.grown(np.array([[0, 0, 1, 1], [16, 0, 17, 1]]))) == 1 and len(layout.grown(np.array([[0, 0, 1, 1], [16.1, 0, 17, 1]]))) == 2


def test_boxes_of_a_crowded_page_and_odd_ones():
    rng = np.random.default_rng(3)
    for k in range(150):
        scale = rng.choice([300, 2000, 100_000])
        corner, size = rng.uniform(-scale / 3, scale, (rng.integers(1, 16), 2)), rng.exponential(rng.choice([5, 30, 4000]), (1, 2))
        if k % 3 == 0:
            corner, size = np.round(corner / 15) * 15, np.round(size / 15) * 15
        boxes = np.concatenate([corner, corner + size], axis=1)
        assert sorted(map(tuple, layout.grown(boxes))) == grown_slowly(boxes)
    corner = rng.uniform(0, 600, (50_000, 2))
    apart = np.array([[900.0, 0, 910, 10]])
    began = time.time()
    got = layout.grown(np.concatenate([corner, corner + rng.uniform(0, 3, corner.shape)], axis=1).tolist() + apart.tolist())
    assert len(got) == 2 and time.time() - began < 5


def page(spark, prims, blocks):
    return spark.createDataFrame([("d", 0, k, *map(float, b), 612.0, 792.0) for k, b in prims], PRIMS), spark.createDataFrame([("d", 0, i, *map(float, b), t) for i, (b, t) in enumerate(blocks)], BLOCKS)


def test_figures_of_a_page(spark):
    prims, blocks = page(
        spark,
        [("vector", (72, 100, 212, 220)), ("vector", (252, 100, 392, 220)), ("vector", (72, 342, 320, 470)), ("vector", (160, 360, 240, 440)), ("vector", (0, 0, 612, 792)), ("vector", (72, 600, 500, 601)), ("raster", (10, 700, 30, 720))],
        [((72, 232, 392, 244), "Figure 1:  two\nplots"), ((72, 325, 300, 336), "Table 2. numbers"), ((72, 500, 500, 560), "Body text that mentions Figure 1")],
    )
    rows = layout.figures(prims, blocks).collect()
    assert [(r.ord, r.page, r.fig_idx, r.label, r.caption, tuple(r.rect)) for r in sorted(rows, key=lambda r: r.ord)] == [(1, 0, 0, "Figure 1:", "Figure 1: two plots", (72, 100, 392, 220)), (2, 0, 1, "Table 2.", "Table 2. numbers", (72, 342, 320, 470))]
    assert tuple(sorted(rows, key=lambda r: r.ord)[0].crop_rect) == (66, 94, 398, 226)
    assert [r.caption for r in layout.figures(prims, blocks, max_figures=1).collect()] == ["Figure 1: two plots"]
    assert layout.figures(prims, blocks, max_pages=0).count() == 0


def fig(page=0, label=None, caption=None, png=None, told=None):
    return (page, (0.0, 0.0, 1.0, 1.0), label, caption, png, told)


def test_weaving(spark):
    text = "intro\nFigure 1: A plot\nmore text about Table 2\nend"
    figs = [fig(0, "Figure 1:", "Figure 1: A plot", told="D1"), fig(1, "Table 2", None, told="D2"), fig(2, None, "lost", told="D3"), fig(3, "Figure 1:", "Figure 1: A plot")]
    rows = spark.createDataFrame([(text, figs), (text, []), (text, None)], f"text string, figures {FIGURES.simpleString()}")
    got = [r[0] for r in rows.select(weave.woven(F.col("text"), F.col("figures"))).collect()]
    assert got == [
        "intro\nFigure 1: A plot\n\n[Figure 1 (page 1)] Figure 1: A plot\nD1\n\n[Figure 1 (page 4)] Figure 1: A plot\nmore text about Table 2\n\n[Table 2 (page 2)]\nD2\nend\n\n[Figure (page 3)] lost\nD3",
        text,
        text,
    ]


class Fails:
    def complete(self, prompts, images):
        if "bad" in prompts[0]:
            raise RuntimeError("no answer")
        return [None if "none" in prompts[0] else f" <{p}|{i}> " for p, i in zip(prompts, images, strict=True)]


def test_models(spark, tmp_path):
    assert model.error_text(ValueError("x")) == "ValueError: x" and model.error_text(ValueError()) == "ValueError"
    papers = [("a.pdf", "/a.pdf", "A", "one\n\ntwo", [fig(0, "L", "C", "/x.png"), fig(0, None, None, "/gone.png")], None), ("b.pdf", "/b.pdf", "bad", "text", [], None), ("c.pdf", "/c.pdf", "C", "", [], None), ("d.pdf", "/d.pdf", "D", "none", None, None)]
    prompts = model.Prompts("{title} {idx}/{total} {chunk}", "{title}: {summaries}", "{title} {label} {caption}", 1000, 8)
    crops = spark.createDataFrame([("/x.png", bytearray(b"P"))], "path string, content binary")
    rows = {r.filename: r for r in model.summarized(spark.createDataFrame(papers, PAPER), crops, Fails, prompts).collect()}
    assert rows["a.pdf"].status == "ok" and [f.description for f in rows["a.pdf"].figures] == ["<A L C|UA==>", model.NO_VISION]
    assert rows["a.pdf"].text == "one\n\ntwo" and "<A L C|UA==>" in rows["a.pdf"].summary_md
    assert rows["b.pdf"].summary_md == "> **Summary generation failed**: RuntimeError: no answer" and rows["b.pdf"].status == "failed"
    assert rows["c.pdf"].summary_md == model.NO_TEXT and rows["d.pdf"].error.startswith("ValueError")
    (tmp_path / "p.json").write_text('{"chunk_prompt": "q", "max_chunks": 3, "other": 1}')
    assert model.Prompts.from_json(f"{tmp_path}/p.json").max_chunks == 3 and model.Prompts.from_json("/nowhere") == model.Prompts()


def test_documents(spark):
    md = "# Title x \n\n### TL;DR (3 bullets)\n\n* **Bold** " + "word " * 40 + "\n```\n# code\n```\n##### Five\n###### Six\n"
    got = spark.createDataFrame([(md,)], "c string").select(render.extract_h1(F.col("c")), render.first_tldr(F.col("c")), render.bump_headings(F.col("c"))).first()
    assert got[0] == "Title x" and got[1].startswith("Bold word") and got[1].endswith("word…") and len(got[1]) <= 138
    assert got[2] == md.replace("# Title", "## Title").replace("### TL", "#### TL").replace("##### Five", "###### Five")
    docs = spark.createDataFrame([("b_x.md", "text"), ("a.md", "# A & B\n\n### TLDR\n- short")], "filename string, content string")
    whole = lambda pieces: "".join(r.piece for r in pieces.orderBy("part", "filename").collect())
    index = whole(render.index_pieces(docs, spark.createDataFrame([("a.md",)], "filename string")))
    assert index == "# Papers Index\n\n- [A & B](a.md) ([raw](raw/a.md)) — short\n- [b x](b_x.md)\n"
    combined = whole(render.combined_pieces(docs))
    none = docs.limit(0)
    assert whole(render.index_pieces(none, none)) == "# Papers Index\n" and whole(render.combined_pieces(none)) == "# Papers Summary\n\n## Index\n\n\n---\n\n\n\n"
    assert combined == "# Papers Summary\n\n## Index\n\n- [A & B](#a--b)\n- [b x](#b-x)\n\n---\n\n\n## A & B\n\n#### TLDR\n- short\n\ntext\n"


def test_state(spark, tmp_path):
    rows = [("a", "h1", "o", "T", "", [fig(png="/c1")]), ("b", "old", "o", "T", "x", []), ("c", "h3", "o", "T", None, []), ("d", "h4", "o", "T", "x", [fig(png="/gone")]), ("e", "h5", "p", "T", "x", [])]
    known = spark.createDataFrame(rows, STATE)
    found = spark.createDataFrame([(n, f"h{i}") for i, n in enumerate("abcdef", 1)], "filename string, hash string")
    hits, misses = state.split(found, known, "o", spark.createDataFrame([("/c1",)], "path string"))
    assert [r.filename for r in hits.collect()] == ["a"] and sorted(r.filename for r in misses.collect()) == list("bcdef")
    folder = f"file://{tmp_path}/state"
    assert state.load(spark, folder).count() == 0
    assert state.append(known, folder)
    assert state.append(spark.createDataFrame([("a", "h9", "o", "N", "t", [])], STATE), folder)
    assert {r.filename: r.hash for r in state.load(spark, folder).collect()} == {"a": "h9", "b": "old", "c": "h3", "d": "h4", "e": "h5"}
    assert all(r.figures == [] for r in state.without_figures(known).collect())


def test_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name, data in (("Wiki Skills.pdf", b"x"), ("wiki.pdf", b"y"), ("other.PDF", b"z"), ("n.txt", b"t")):
        (tmp_path / "in" / name).write_bytes(data)
    folder = f"{tmp_path}/in"
    assert sorted(r.filename for r in files.pdf_files(spark, folder).collect()) == ["Wiki Skills.pdf", "wiki.pdf"]
    assert files.select_paper(spark, folder, "WIKI") == "wiki.pdf" and files.select_paper(spark, folder, "skill") == "Wiki Skills.pdf"
    for wanted in ("zzz", "i"):
        with pytest.raises(ValueError):
            files.select_paper(spark, folder, wanted)
    with pytest.raises(FileNotFoundError):
        files.pdf_files(spark, f"{tmp_path}/none")
    out = tmp_path / "out"
    out.mkdir()
    docs = spark.createDataFrame([("a.md", "v1"), ("raw/a.md", "é")], "filename string, content string")
    assert sorted(tuple(r) for r in sinks.write_if_changed(docs, str(out)).collect()) == [("a.md",), ("raw/a.md",)]
    assert sinks.write_if_changed(docs, str(out)).collect() == []
    (out / "bad.md").write_bytes(b"\xff\xfe")
    (out / "INDEX.md").write_text("i")
    assert [tuple(r) for r in files.written_documents(spark, str(out)).collect()] == [("a.md", "v1")]
    assert (out / "raw" / "a.md").read_text() == "é"
