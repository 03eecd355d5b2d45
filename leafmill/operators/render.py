"""Markdown of papers, indexes and combined documents, and the parsing they need."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.functions import strings as S
from leafmill.functions.arrays import bound

from .model import NO_VISION
from .weave import extra_caption, figure_label, woven

INDEX, COMBINED = "INDEX.md", "PAPERS_SUMMARY.md"
#: The length of a short summary line, and where a longer one is cut.
TLDR_CHARS, TLDR_CUT = 140, 137


def lines_of(*parts: Column) -> Column:
    """Non-null parts, a line each."""
    return F.array_join(F.filter(F.array(*parts), lambda x: x.isNotNull()), "\n")


def figure_link(fig: Column, stem: Column, has_crop: Column, prefix: str = "") -> Column:
    name = F.element_at(F.split(fig["png_path"], "/"), -1)
    return F.when(has_crop, F.concat(F.lit(f"{prefix}figures/"), stem, F.lit("/"), name))


def paper_markdown(level: int = 1, crops: Column | None = None) -> Column:
    """Of columns filename, pdf_path, title, text, figures, summary_md; crops: array of the png paths that exist."""
    crops = F.array().cast("array<string>") if crops is None else crops
    stem = S.stem(F.col("filename"))
    doi = S.find_doi(F.col("text"))

    def image(fig: Column) -> Column:
        alt = F.translate(F.coalesce(S.found(fig["caption"]), S.found(fig["label"]), F.lit("figure")), "[]", "()")
        link = figure_link(fig, stem, F.coalesce(F.array_contains(crops, fig["png_path"]), F.lit(False)))
        return F.concat(F.lit("!["), alt, F.lit("]("), link, F.lit(")\n\n"))

    images = F.array_join(F.filter(F.transform("figures", image), lambda x: x.isNotNull()), "")
    section = F.when(F.size("figures") > 0, F.concat(F.lit("#" * (level + 1) + " Figures\n\n"), images, F.lit("---\n")))
    head = F.concat(F.lit("#" * level + " "), F.col("title"))
    return lines_of(
        head,
        F.lit(""),
        F.concat(F.lit("- **Source PDF**: `"), F.col("pdf_path"), F.lit("`")),
        F.concat(F.lit("- **DOI**: `https://doi.org/"), doi, F.lit("`")),
        F.lit(""),
        section,
        S.py_strip(S.found(F.col("summary_md"))),
        F.lit(""),
    )


def paper_document(crops: Column | None = None) -> Column:
    return F.concat(S.py_rstrip(paper_markdown(1, crops)), F.lit("\n"))


def raw_figure_block(fig: Column, link: Column) -> Column:
    label = figure_label(fig)
    head = F.concat_ws(" — ", F.concat(F.lit("**"), label, F.lit("** (page "), (fig["page"] + 1).cast("string"), F.lit(")")), extra_caption(fig))
    quote = F.transform(S.py_splitlines(fig["description"]), lambda x: F.when(S.py_strip(x) == "", F.lit(">")).otherwise(F.concat(F.lit("> "), x)))
    told = F.when(~S.found(fig["description"]).eqNullSafe(F.lit(NO_VISION)), F.concat(F.lit("\n"), F.array_join(F.when(fig["description"] != "", quote), "\n")))
    return lines_of(head, F.concat(F.lit("\n!["), label, F.lit("]("), link, F.lit(")")), told)


def raw_document(crops: Column | None = None) -> Column:
    crops = F.array().cast("array<string>") if crops is None else crops
    stem = S.stem(F.col("filename"))

    def block(fig: Column) -> Column:
        return raw_figure_block(fig, figure_link(fig, stem, F.coalesce(F.array_contains(crops, fig["png_path"]), F.lit(False)), "../"))

    head = F.concat(
        F.lit("# "), F.col("title"), F.lit("\n\n> Raw extract of `"), F.col("pdf_path"),
        F.lit("` — full paper text with figure crops and their vision-model descriptions (quoted). Layout is not faithful to the original PDF.\n\n---\n\n"),
    )
    return F.concat(head, S.py_strip(woven(F.coalesce("text", F.lit("")), F.col("figures"), block)), F.lit("\n"))


#: Line ends, for sets of characters; of a set that lists them one by one, Java's test of a character took some twenty times as long.
ENDS = r"\v\x1c-\x1e"


def bump_headings(md: Column, levels: int = 1) -> Column:
    """Headings of levels 1 to 5 sink by `levels`; lines between fences stay."""
    # Parts begin with a fence each, so every other one is inside; the line end in front makes the first line as the others.
    lined = F.concat(F.lit("\n"), F.regexp_replace(md, rf"\r\n|[{ENDS}&&[^\n]]", "\n"))
    parts = F.split(lined, r"(?U)(?<=\n)(?=[\s\x1f&&[^\n]]*+(?:```|~~~))", -1)
    sunk = F.transform(parts, lambda x, i: F.when(i % 2 == 0, F.regexp_replace(x, r"(?U)(?<=\n)(?=#{1,5}[\s&&[^\n]])", "#" * levels)).otherwise(x))
    body = F.substring(F.array_join(sunk, ""), F.lit(2), F.length(md) * (levels + 1) + 1)
    return F.when(F.endswith(md, F.lit("\n")), body).otherwise(F.regexp_replace(body, r"\n\z", ""))


def extract_h1(md: Column) -> Column:
    # No run of blanks is tried in more ways than one: neither behind the mark nor in the title or behind it.
    return S.found(F.regexp_extract(md, rf"(?U)#(?<![^{ENDS}]#)[\s&&[^{ENDS}]]++([\S&&[^{ENDS}]](?:[^{ENDS}]*[\S&&[^{ENDS}]])?+)", 1))


def first_tldr(md: Column) -> Column:
    """The first bullet under the first TL;DR heading, if the first line under it is a bullet."""
    head = ";*".join(["", "#", "#", "#", " ", "t", "l", "d", "r"])
    bullet = rf"[*-] (?=[\s\x1f&&[^{ENDS}]]*+[^\s\x1c-\x1f])([^{ENDS}]*+)"
    found = F.regexp_extract(F.concat(F.lit("\n"), md), rf"(?U)[{ENDS}][\s\x1f&&[^{ENDS}]]*+(?i:{head})[^{ENDS}]*+{S.WS}*+(?:{bullet})?+", 1)

    def short(line: Column) -> Column:
        # What is left of a line's end after TLDR_CHARS only tells whether there is more than white space.
        space = TLDR_CUT - F.locate(" ", F.reverse(F.substring(line, 1, TLDR_CUT)))
        cut = F.when((space > 0) & (space < TLDR_CUT), space).otherwise(F.lit(TLDR_CUT))
        more = F.substring(line, F.lit(TLDR_CHARS + 1), F.length(line)).rlike(r"(?U)[^\s\x1c-\x1f]")
        return F.when(more, F.concat(F.substring(line, F.lit(1), cut), F.lit("…"))).otherwise(S.py_rstrip(F.substring(line, 1, TLDR_CHARS)))

    # A line may be the whole text, so each is made once.
    return bound(found, lambda x: F.when(x != "", bound(S.py_lstrip(F.replace(x, F.lit("**"), F.lit(""))), short)))


def document_title() -> Column:
    return F.coalesce(extract_h1(F.col("content")), F.replace(S.stem(F.col("filename")), F.lit("_"), F.lit(" ")))


PIECES = "part int, filename string, piece string"


def _pieces(docs: DataFrame, *parts: str | tuple[Column, str, str]) -> DataFrame:
    """part, filename, piece: texts of their own, and for each document a Column with what stands before the first and the others.

    The pieces in order of (part, filename) are the whole file; no row holds more than one
    document's share, however many there are.
    """
    first = docs.agg(F.min("filename").alias("__first"))
    rows = docs.join(F.broadcast(first))
    out = docs.sparkSession.createDataFrame([(i, None, p) for i, p in enumerate(parts) if isinstance(p, str)], PIECES)
    for i, p in enumerate(parts):
        if not isinstance(p, str):
            own, lead, between = p
            before = F.when(F.col("filename") == F.col("__first"), F.lit(lead)).otherwise(F.lit(between))
            out = out.union(rows.select(F.lit(i).alias("part"), "filename", F.concat(before, own).alias("piece")))
    return out


def index_pieces(docs: DataFrame, raw: DataFrame) -> DataFrame:
    """Pieces of the index of docs(filename, content), with links to raw(filename)."""
    has_raw = raw.select("filename").distinct().withColumn("__raw", F.lit(True))
    link = F.when(F.col("__raw"), F.concat(F.lit(" ([raw](raw/"), F.col("filename"), F.lit("))")))
    # What a text gives is found where it is read, so that no text is shuffled for the links.
    short = docs.select("filename", document_title().alias("__title"), F.concat(F.lit(" — "), first_tldr(F.col("content"))).alias("__tldr"))
    entry = F.concat(F.lit("- ["), F.col("__title"), F.lit("]("), F.col("filename"), F.lit(")"), F.coalesce(link, F.lit("")), F.coalesce("__tldr", F.lit("")))
    return _pieces(short.join(has_raw, "filename", "left"), "# Papers Index", (entry, "\n\n", "\n"), "\n")


def combined_pieces(docs: DataFrame) -> DataFrame:
    """Pieces of all of docs(filename, content) under one heading."""
    title = document_title()
    entry = F.concat(F.lit("- ["), title, F.lit("](#"), S.github_slug(title), F.lit(")\n"))
    body = S.py_rstrip(bump_headings(F.col("content")))
    return _pieces(docs, "# Papers Summary\n\n## Index\n\n", (entry, "", ""), "\n---\n\n\n", (body, "", "\n\n"), "\n")
