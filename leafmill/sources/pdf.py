"""PDF backends: text, page geometry and crops behind one protocol; the libraries are optional."""

from __future__ import annotations

import io
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafmill.functions import strings as S
from leafmill.operators.model import error_text
from leafmill.schemas import BLOCKS, PRIMS


class Backend(Protocol):
    def text(self, content: bytes, max_pages: int | None) -> str: ...

    def geometry(self, content: bytes, max_pages: int | None) -> tuple[list[tuple], list[tuple]]:
        """(page, kind, x0, y0, x1, y1, page_w, page_h) of pictures and drawings; (page, ord, x0, y0, x1, y1, text) of text blocks; of the first pages only, if max_pages."""
        ...

    def crops(self, content: bytes, wanted: list[tuple[int, tuple[float, float, float, float]]], dpi: int) -> list[bytes | Exception]:
        """Pictures of (page, rect) places of one document, which is opened once; what fails for a place is its answer."""
        ...


class Missing(RuntimeError):
    """A library that isn't installed."""


class Libraries:
    """pdfminer for text, pymupdf for geometry and crops; a clear error where they aren't installed."""

    def text(self, content: bytes, max_pages: int | None) -> str:
        try:
            from pdfminer.high_level import extract_text
        except ImportError as e:
            raise Missing("pdfminer.six is not installed") from e
        return extract_text(io.BytesIO(content), maxpages=max_pages or 0) or ""

    def _open(self, content: bytes):
        try:
            import pymupdf
        except ImportError as e:
            raise Missing("pymupdf is not installed") from e
        return pymupdf.open(stream=content, filetype="pdf")

    def geometry(self, content: bytes, max_pages: int | None):
        prims, blocks = [], []
        with self._open(content) as doc:
            for n in range(min(len(doc), max_pages or len(doc))):
                page = doc[n]
                size = (float(page.rect.width), float(page.rect.height))
                boxes = [("raster", i["bbox"]) for i in page.get_image_info() if i.get("bbox")] + [("vector", d["rect"]) for d in page.get_drawings()]
                prims += [(n, kind, *map(float, box), *size) for kind, box in boxes]
                blocks += [(n, k, *map(float, b[:4]), b[4]) for k, b in enumerate(page.get_text("blocks"))]
        return prims, blocks

    def crops(self, content: bytes, wanted, dpi: int):
        import pymupdf

        def one(doc, page, rect):
            try:
                return doc[page].get_pixmap(dpi=dpi, clip=pymupdf.Rect(rect)).tobytes("png")
            except Exception as e:  # noqa: BLE001  a place that can't be drawn fails alone
                return e

        with self._open(content) as doc:
            return [one(doc, page, rect) for page, rect in wanted]


FOUND = "first_page string, raw_text string, error string, prims array<struct<{}>>, blocks array<struct<{}>>".format(*(", ".join(x.replace(" ", ": ", 1) for x in ddl.split(", ")[1:]) for ddl in (PRIMS, BLOCKS)))
_NAMES = [[x.split()[0] for x in ddl.split(", ")[1:]] for ddl in (PRIMS, BLOCKS)]


def read(files: DataFrame, backend: Backend, max_pages: int | None = None, figures: bool = True) -> DataFrame:
    """files without their content, and FOUND: each file is parsed once; what fails for one is that row's error.

    A text that can't be read is empty, whatever the reason; a library that isn't there and
    pages that can't be read are errors. Pages past max_pages aren't parsed.
    """
    schema = T.StructType([f for f in files.schema.fields if f.name != "content"] + T._parse_datatype_string(FOUND).fields)

    def text(content, pages):
        try:
            return backend.text(content, pages).strip()
        except Missing:
            raise
        except Exception as e:  # noqa: BLE001  an unreadable file has no text
            error_text(e)
            return ""

    def one(content):
        try:
            first, whole = text(content, 1), text(content, max_pages)
            prims, blocks = backend.geometry(content, max_pages) if figures else ([], [])
            return first, whole, None, *([dict(zip(names, x, strict=True)) for x in rows] for names, rows in zip(_NAMES, (prims, blocks), strict=True))
        except Exception as e:  # noqa: BLE001  any failure becomes the row's error
            return "", "", error_text(e), [], []

    def run(batches):
        for rows in batches:
            out = pd.DataFrame([one(bytes(c)) for c in rows["content"]], columns=["first_page", "raw_text", "error", "prims", "blocks"], index=rows.index)
            yield pd.concat([rows.drop(columns="content"), out], axis=1)

    return files.mapInPandas(run, schema)


def geometry(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tables of PRIMS and BLOCKS of what read() gave, doc_id being the file's stem."""
    rows = found.select(S.stem(F.col("filename")).alias("doc_id"), "prims", "blocks")
    return rows.select("doc_id", F.inline("prims")), rows.select("doc_id", F.inline("blocks"))


#: Files with figures whose places are sent to all tasks: some 12 places of about 100 bytes each.
MOST_SENT = 20_000


def write_crops(files: DataFrame, figures: DataFrame, backend: Backend, folder: str, dpi: int = 150) -> DataFrame:
    """doc_id, ord, png_path, crop_error of the figures' crops, written under folder/<doc_id>/, which all executors share.

    A file with figures is a row with all their places, so its content moves at most once and it
    is opened once; where such files are few enough, the places go to the contents and these stay.
    figures: a written table, read more than once.
    """
    import os

    from leafmill.operators.layout import crop_name

    places = figures.select("doc_id", F.struct("ord", "page", "crop_rect", crop_name().alias("name")).alias("place")).groupBy("doc_id").agg(F.sort_array(F.collect_list("place")).alias("places"))
    few = figures.select("doc_id").distinct().count() <= MOST_SENT
    rows = files.select(S.stem(F.col("filename")).alias("doc_id"), "content").join(F.broadcast(places) if few else places, "doc_id")

    def one(doc_id, content, wanted):
        """(ord, path, error) of each place of a file."""
        try:
            found = backend.crops(content, [(p["page"], tuple(p["crop_rect"][k] for k in ("x0", "y0", "x1", "y1"))) for p in wanted], dpi)
        except Exception as e:  # noqa: BLE001  any failure becomes the rows' error
            found = [e] * len(wanted)
        for p, data in zip(wanted, found, strict=True):
            try:
                if isinstance(data, Exception):
                    raise data
                path = os.path.join(folder, doc_id, p["name"])
                os.makedirs(os.path.dirname(path), exist_ok=True)
                with open(path, "wb") as f:
                    f.write(data)
                yield p["ord"], path, None
            except Exception as e:  # noqa: BLE001
                yield p["ord"], None, error_text(e)

    def run(batches):
        for batch in batches:
            done = [(r.doc_id, *x) for r in batch.itertuples() for x in one(r.doc_id, bytes(r.content), r.places)]
            yield pd.DataFrame(done, columns=["doc_id", "ord", "png_path", "crop_error"])

    return rows.mapInPandas(run, "doc_id string, ord int, png_path string, crop_error string")
