"""Text functions as Columns: cleaning, content patterns, title rules, slugs.

White space, line ends and word characters mean what they mean to Python's str and re,
so the JVM's narrower defaults are widened with (?U) and the separators 1C to 1F.
"""

from __future__ import annotations

import unicodedata

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

WS = r"[\s\x1c-\x1f]"
LINE_END = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"

#: Openings of boilerplate lines, without regard to case.
BOILERPLATE = [
    r"permission to make digital or hard copies\b",
    r"request permissions from\b",
    r"copyrights for components of this work\b",
    r"abstracting with credit is permitted\b",
    r"to copy otherwise\b",
    r"republish, to post on servers\b",
    r"©\s*\d{4}\b",
    r"acm isbn\b",
    r"this work is licensed under\b",
    r"please use nonacm option\b",
    r"recsys\s*'?\s*\d{2}\b",
    r"conference acronym\b",
]
#: Footnote marks at a line's start, and the length from which such a line stays.
FOOTNOTE = rf"(?U)\A{WS}*+[*∗†‡]+\s*\w"
FOOTNOTE_CHARS = 90
#: The DOI pattern and what is taken off its end.
DOI = r"(?iU)\b10\.\d{4,9}/[-._;()/:A-Z0-9]+\b"
DOI_TAIL = ").,;"
#: Where an abstract begins and, in falling preference, how it ends.
ABSTRACT_HEAD = r"(?isU)\babstract\b\s*[:\n]\s*"
ABSTRACT_ENDS = [
    r"(.{200,4500}?)(?:\n\s*\b(?:1\s+(?:introduction|intro)|keywords|ccs concepts|index terms|background|related work)\b)",
    r"(.{200,3000}?)(?:\n\s*1\.?\s+Introduction)",
    r"(.{200,1500})",
]
#: Byte-order marks read as text, and the share of lone letters that spoils a title.
BOM_PREFIX = "(?U)^\\s*(?:\ufeff|þÿ|ÿþ|\ufffe)"
LONE_LETTERS = 0.35


def py_strip(c: Column) -> Column:
    """str.strip()."""
    return F.regexp_replace(F.regexp_replace(c, rf"(?U)\A{WS}+", ""), rf"(?U)(?<!{WS}){WS}++\z", "")


def py_lstrip(c: Column) -> Column:
    return F.regexp_replace(c, rf"(?U)\A{WS}+", "")


def py_rstrip(c: Column) -> Column:
    return F.regexp_replace(c, rf"(?U)(?<!{WS}){WS}++\z", "")


def py_splitlines(c: Column) -> Column:
    """str.splitlines()."""
    parts = F.split(c, LINE_END, -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def collapse(c: Column) -> Column:
    """Each run of white space as one space."""
    return F.regexp_replace(c, rf"(?U){WS}+", " ")


def found(c: Column) -> Column:
    """Null for the empty string by which regexp_extract tells of no match."""
    return F.nullif(c, F.lit(""))


def rstrip_chars(c: Column, chars: str) -> Column:
    return F.rtrim(c, F.lit(chars))


def dehyphenate(c: Column) -> Column:
    """Join words that were broken at a line's end."""
    return F.regexp_replace(c, r"([A-Za-z])-\n([A-Za-z])", "$1$2")


def clean_text(c: Column) -> Column:
    """No NULs, no blanks before line ends, at most one empty line in a row, nothing blank around."""
    c = F.replace(c, F.lit("\x00"), F.lit(""))
    c = F.regexp_replace(c, r"(?<![ \t])[ \t]++\n", "\n")
    return py_strip(F.regexp_replace(c, r"\n{3,}", "\n\n"))


def is_boilerplate(line: Column) -> Column:
    """White space around the line set aside; a blank line is none."""
    listed = line.rlike(rf"(?iU)\A{WS}*+(?:" + "|".join(BOILERPLATE) + ")")
    return F.when(line.rlike(FOOTNOTE), F.length(py_strip(line)) < FOOTNOTE_CHARS).otherwise(False) | listed


def content_lines(c: Column) -> Column:
    """Lines that aren't boilerplate."""
    return F.filter(py_splitlines(c), lambda x: ~is_boilerplate(x))


def strip_boilerplate(c: Column) -> Column:
    return clean_text(F.regexp_replace(F.array_join(content_lines(c), "\n"), r"(?U)(?<![^\n])(?:[^\S\n]|\x1f)++(?![^\n])", ""))


#: Bytes of texts that are Python strings at a time; the others of a batch stay Arrow's.
SLICE_BYTES = 1 << 20


@F.arrow_udf(T.StringType())
def nfkc(texts: pa.Array) -> pa.Array:
    """Compatibility composition; ASCII texts are returned as they are."""
    step = max(1, len(texts) * SLICE_BYTES // max(texts.nbytes, 1))
    out = []
    for at in range(0, len(texts), step):
        own = texts.slice(at, step)
        if not pc.all(pc.string_is_ascii(own)).as_py():  # nulls are passed over
            own = pa.array((t if t is None or t.isascii() else unicodedata.normalize("NFKC", t) for t in own.to_pylist()), texts.type)
        out.append(own)
    folded = pa.concat_arrays(out) if out else texts
    del out
    pa.default_memory_pool().release_unused()  # or a worker keeps what its largest batch took
    return folded


def clean_pdf_text(c: Column) -> Column:
    return nfkc(strip_boilerplate(dehyphenate(c)))


def normalize_for_sentences(c: Column) -> Column:
    """One line for each paragraph."""
    parts = F.filter(F.transform(F.split(c, "\n{2,}", -1), py_strip), lambda p: p != "")
    flat = F.transform(parts, lambda p: py_strip(F.regexp_replace(F.replace(p, F.lit("\n"), F.lit(" ")), rf"(?U){WS}{{2,}}", " ")))
    return F.array_join(flat, "\n\n")


def find_doi(c: Column) -> Column:
    return rstrip_chars(found(F.regexp_extract(c, DOI, 0)), DOI_TAIL)


def extract_abstract(c: Column) -> Column:
    tiers = [found(F.regexp_extract(c, ABSTRACT_HEAD + end, 1)) for end in ABSTRACT_ENDS]
    return strip_boilerplate(F.coalesce(*tiers))


def is_suspicious_title(normal: Column) -> Column:
    """For a title after NFKC: a byte-order mark in front, or many lone letters."""
    tokens = F.split(py_strip(collapse(normal)), " ", -1)
    lone = F.filter(tokens, lambda t: (F.length(t) == 1) & t.rlike(r"^\p{L}$"))
    return normal.rlike(BOM_PREFIX) | (F.size(lone) / F.size(tokens) > LONE_LETTERS)


#: What keeps a first-page line from being a title.
TITLE_LINES, TITLE_CHARS, WRAPPED_CHARS = 40, 18, 80
NOT_IN_TITLE = "arxiv|doi|http|@"
NOT_A_TITLE = ("abstract", "introduction", "contents")


def first_page_title(c: Column) -> Column:
    lines = F.filter(F.transform(py_splitlines(c), lambda x: py_strip(collapse(x))), lambda x: x != "")
    good = F.filter(F.slice(lines, 1, TITLE_LINES), lambda x: ~F.lower(x).rlike(NOT_IN_TITLE) & ~F.lower(x).isin(*NOT_A_TITLE) & (F.length(x) >= TITLE_CHARS))
    one, two = F.get(good, 0), F.get(good, 1)
    both = F.concat(one, F.lit(" "), two)
    wrapped = (F.length(one) < WRAPPED_CHARS) & (F.length(two) < WRAPPED_CHARS) & (F.length(F.regexp_replace(both, "[^,]", "")) <= 1)
    return F.when(wrapped, both).otherwise(one)


def stem(filename: Column) -> Column:
    """File name without its last suffix; a leading dot is no suffix."""
    return F.regexp_replace(filename, r"(?<=.)\.[^.]+$", "")


def title_from_stem(filename: Column) -> Column:
    return py_strip(F.replace(stem(filename), F.lit("_"), F.lit(" ")))


def github_slug(title: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(title), r"(?U)[^\w\s-]", ""), r"(?U)\s", "-")
