"""Headings and bullets of texts with many lines, and with odd line ends."""

import time

from pyspark.sql import functions as F

from leafmill.operators import render


def test_parsing_of_odd_lines(spark):
    rows = [("x\r\n# One \x0b# Two\n ```\r# in\n~~~ \n# out",), ("```\n# in\n```\n## b\r",), ("a\n ### TL;D;R x\n\x1f\n\n - **two** \nz",), ("### TLDR",), (None,)]
    c = F.col("content")
    got = spark.createDataFrame(rows, "content string").select(render.extract_h1(c), render.first_tldr(c), render.bump_headings(c)).collect()
    assert [tuple(r) for r in got] == [
        ("One", None, "x\n## One \n## Two\n ```\n# in\n~~~ \n## out"),
        ("in", None, "```\n# in\n```\n### b"),
        (None, "two", "a\n ### TL;D;R x\n\x1f\n\n - **two** \nz"),
        (None, None, "#### TLDR"),
        (None, None, None),
    ]


def test_no_fold_over_lines():
    """Lines aren't looped over by Spark's interpreted lambdas: only the parts between fences are."""
    import inspect

    assert "py_splitlines" not in inspect.getsource(render.extract_h1) + inspect.getsource(render.first_tldr) + inspect.getsource(render.bump_headings)


def test_bullet_is_found_in_one_pass(spark):
    """Whatever is done with the bullet, the text is searched for it once; long lines and odd blanks end where Python's do."""
    head, c = "x\n### TL;DR\x1e\x1f\n", F.col("content")
    lines = ["* " + "a " * 69 + "b", "* " + "a " * 70 + "b", "* " + "é" * 140 + "**\x1f 　", "- " + "𝒳" * 141, "* ****", "*  ", "- \x1d* b", "* one\x1ctwo", "* " + "a" * 140 + " " * 9 + "b"]
    docs = spark.createDataFrame([(i, head + x) for i, x in enumerate(lines)], "i int, content string").select("i", render.first_tldr(c).alias("t"))
    assert [r.t for r in docs.orderBy("i").collect()] == ["a " * 69 + "b", "a " * 67 + "a…", "é" * 140, "𝒳" * 137 + "…", "", None, None, "one", "a" * 137 + "…"]
    assert docs._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract(") == 1


def test_line_ends(spark):
    """The set of line ends is Python's."""
    every = [chr(i) for i in range(1, 0x3000)]
    got = spark.createDataFrame([(x,) for x in every], "x string").where(F.col("x").rlike(rf"(?U)[{render.ENDS}]")).collect()
    assert sorted(r.x for r in got) == [x for x in every if len(f"a{x}b".splitlines()) == 2]


def test_index_joins_no_texts(spark):
    """Links are joined to titles and bullets, not to the texts that these are from."""
    docs = spark.createDataFrame([("a_b.md", "# T\n### TLDR\n- x"), ("c_d.md", None), ("e_f.md", "y")], "filename string, content string")
    index = render.index_pieces(docs, spark.createDataFrame([("c_d.md",), ("c_d.md",)], "filename string"))

    def joined(plan):
        own = [plan.output().mkString(" ")] if plan.nodeName() == "Join" else []
        return own + [x for i in range(plan.children().size()) for x in joined(plan.children().apply(i))]

    carried = joined(index._jdf.queryExecution().optimizedPlan())
    assert any("filename" in x for x in carried) and not any("content" in x for x in carried)
    assert "".join(r.piece for r in index.orderBy("part", "filename").collect()) == "# Papers Index\n\n- [T](a_b.md) — x\n- [c d](c_d.md) ([raw](raw/c_d.md))\n- [e f](e_f.md)\n"


def test_titles_with_many_blanks(spark):
    """Time is in proportion to the blanks behind a mark, in a title and behind it."""
    blanks = " " * 60_000
    rows = [(0, "#" + blanks + "\n# a"), (1, "# a" + blanks + "b" + blanks), (2, "#\t\x1f é \u2028# b"), (3, "# " + "\xa0" * 9), (4, "#")]
    docs = spark.createDataFrame(rows, "i int, content string")
    began = time.monotonic()
    got = docs.select("i", render.extract_h1(F.col("content")).alias("t")).orderBy("i").collect()
    assert [r.t for r in got] == ["a", "a" + blanks + "b", "\x1f é", None, None]
    assert time.monotonic() - began < 30
