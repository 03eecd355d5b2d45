"""Pages of documents as a Spark source: `leafmill_pages`, planned by file size and page range.

The driver lists names and sizes alone. Small files share a partition of about `splitBytes`; a
larger file is as many partitions as it has splits, each of which opens it and parses its own
share of the pages, as a PDF's table of contents is at its end. Columns are chosen by the
schema that is asked for: no text is extracted for a plan without `text`, no geometry
without `prims` and `blocks`, and no file is opened for a plan of the name alone.

A page that can't be read is a row with its error; a file that can't be opened is one row with
a null page and its error; an empty folder has no rows. A missing folder is an error of the plan.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass
from fnmatch import fnmatchcase
from typing import Protocol

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from leafmill.operators.model import error_text
from leafmill.schemas import BLOCKS, PRIMS

from .packs import store

SPLIT_BYTES = 8 << 20


def _struct(ddl: str) -> str:
    """The columns of a page table without doc_id and page, as an array of structs."""
    return "array<struct<{}>>".format(", ".join(x.replace(" ", ": ", 1) for x in ddl.split(", ")[2:]))


PAGE = f"filename string, page int, text string, prims {_struct(PRIMS)}, blocks {_struct(BLOCKS)}, error string"


class Opened(Protocol):
    """An open document."""

    def __len__(self) -> int: ...

    def text(self, page: int) -> str: ...

    def geometry(self, page: int) -> tuple[list[tuple], list[tuple]]:
        """(kind, x0, y0, x1, y1, page_w, page_h) and (ord, x0, y0, x1, y1, text)."""
        ...


class Pymupdf:
    """A document opened by pymupdf, which is optional."""

    def __init__(self, content: bytes):
        import pymupdf

        self.doc = pymupdf.open(stream=content, filetype="pdf")

    def __len__(self) -> int:
        return len(self.doc)

    def text(self, page: int) -> str:
        return self.doc[page].get_text()

    def geometry(self, page: int):
        p = self.doc[page]
        size = (float(p.rect.width), float(p.rect.height))
        boxes = [("raster", i["bbox"]) for i in p.get_image_info() if i.get("bbox")] + [("vector", d["rect"]) for d in p.get_drawings()]
        return [(kind, *map(float, box), *size) for kind, box in boxes], [(k, *map(float, b[:4]), b[4]) for k, b in enumerate(p.get_text("blocks"))]


class Characters:
    """A text file in pages of so many characters."""

    PAGE = 1000

    def __init__(self, content: bytes):
        self.whole = content.decode()

    def __len__(self) -> int:
        return max(1, -(-len(self.whole) // self.PAGE))

    def text(self, page: int) -> str:
        return self.whole[page * self.PAGE : (page + 1) * self.PAGE]

    def geometry(self, page: int):
        return [], []


@dataclass
class Share(InputPartition):
    """Parts of files: (path, part, parts)."""

    files: list[tuple[str, int, int]]


def shares(sizes: list[tuple[str, int]], split: int) -> list[Share]:
    """Partitions of about `split` bytes: a larger file is cut into parts of its pages, smaller ones are put together."""
    out, now, room = [], [], split
    for path, size in sizes:
        parts = -(-size // split)
        if parts > 1:
            out += [Share([(path, k, parts)]) for k in range(parts)]
            continue
        if now and size > room:
            out.append(Share(now))
            now, room = [], split
        now.append((path, 0, 1))
        room -= size
    return out + ([Share(now)] if now else [])


class PageReader(DataSourceReader):
    def __init__(self, options, schema: T.StructType, opener):
        self.folder, self.glob = options["path"], options.get("glob", "*.pdf")
        self.split, self.most = int(options.get("splitBytes", SPLIT_BYTES)), int(options.get("maxPages", 0))
        self.columns, self.opener = schema.names, opener

    def partitions(self) -> list[Share]:
        fs, root = store(self.folder)
        found = fs.get_file_info(pafs.FileSelector(root))
        return shares(sorted((x.path, x.size) for x in found if x.type == pafs.FileType.File and fnmatchcase(x.base_name, self.glob)), self.split)

    def read(self, partition: Share) -> Iterator[tuple]:
        fs, _ = store(self.folder)
        for path, part, parts in partition.files if partition else []:
            for row in self.pages(fs, path, part, parts):
                yield tuple(row.get(c) for c in self.columns)

    def pages(self, fs, path: str, part: int, parts: int) -> Iterator[dict]:
        name = os.path.basename(path)
        if self.columns == ["filename"]:
            if not part:
                yield {"filename": name}
            return
        try:
            with fs.open_input_stream(path) as f:
                doc = self.opener(f.read())
            n = min(len(doc), self.most or len(doc))
        except Exception as e:  # noqa: BLE001  a file that can't be opened is a row
            if not part:
                yield {"filename": name, "error": error_text(e)}
            return
        for page in range(part * n // parts, (part + 1) * n // parts):
            row = {"filename": name, "page": page}
            try:
                if "text" in self.columns:
                    row["text"] = doc.text(page)
                if {"prims", "blocks"} & set(self.columns):
                    row["prims"], row["blocks"] = doc.geometry(page)
            except Exception as e:  # noqa: BLE001  a page fails alone
                row["error"] = error_text(e)
            yield row


def pages(spark: SparkSession, folder: str, columns: tuple[str, ...] = ("filename", "page", "text", "prims", "blocks", "error"), opener=Pymupdf, **options) -> DataFrame:
    """PAGE rows of a folder's files, of the named columns alone; opener makes an Opened document of a file's bytes."""

    class Pages(DataSource):
        @classmethod
        def name(cls) -> str:
            return "leafmill_pages"

        def schema(self) -> str:
            return PAGE

        def reader(self, schema: T.StructType) -> PageReader:
            return PageReader(self.options, schema, opener)

    spark.dataSource.register(Pages)
    every = {f.name: f for f in T._parse_datatype_string(PAGE).fields}
    return spark.read.format("leafmill_pages").schema(T.StructType([every[c] for c in columns])).options(path=folder, **options).load()
