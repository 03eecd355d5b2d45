"""Titles by a cascade: override, information dictionary or XMP, first page, file name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.functions import strings as S
from leafmill.functions.pdfbytes import info_title

#: Fixed value: titles that no source yields.
OVERRIDES = {"2306.04833v2.pdf": "Unified Embedding Based Personalized Retrieval in Etsy Search"}
XMP = r"(?is)<dc:title>\s*<rdf:Alt>\s*<rdf:li[^>]*>(.*?)</rdf:li>"
EMPTY_TITLES = ("untitled", "title")


def xmp_title(text):
    return S.found(S.collapse(S.py_strip(F.regexp_replace(S.found(F.regexp_extract(text, XMP, 1)), "<[^>]+>", ""))))


def with_meta(papers: DataFrame) -> DataFrame:
    """papers(content, ...) with __info and __xmp, all that titles need of the contents."""
    return papers.withColumns({"__info": info_title("content"), "__xmp": xmp_title(F.decode("content", "ISO-8859-1"))})


def with_titles(papers: DataFrame, overrides: dict[str, str] | None = None) -> DataFrame:
    """papers(filename, first_page, and content or what with_meta() found in it, ...) with title and title_source.

    A suspicious information or XMP title counts as none, and XMP isn't asked again.
    """
    papers = papers if "__xmp" in papers.columns else with_meta(papers)
    overrides = OVERRIDES if overrides is None else overrides
    pairs = [F.lit(x) for k, v in overrides.items() for x in (k, v)]
    override = S.found(F.create_map(*pairs)[F.col("filename")]) if pairs else F.lit(None).cast("string")
    info = S.found(S.py_strip(F.col("__info")))
    info = F.when(~F.lower(info).isin(*EMPTY_TITLES), info)
    rows = papers.withColumn("__meta", F.coalesce(info, F.col("__xmp")))
    rows = rows.withColumn("__normal", S.nfkc("__meta"))
    meta = F.when(~S.is_suspicious_title(F.col("__normal")), F.col("__meta"))
    page = S.first_page_title(F.col("first_page"))
    rows = rows.withColumns({"__override": override, "__good": meta, "__page": page})
    source = F.when(F.col("__override").isNotNull(), "override").when(F.col("__good").isNotNull(), "metadata").when(F.col("__page").isNotNull(), "first_page").otherwise("filename")
    title = F.coalesce("__override", "__good", "__page", S.title_from_stem(F.col("filename")))
    return rows.withColumn("title", title).withColumn("title_source", source).drop("__info", "__xmp", "__meta", "__normal", "__override", "__good", "__page")
