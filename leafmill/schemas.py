"""Fixed schemas of the engine's tables."""

from __future__ import annotations

from pyspark.sql import types as T

RECT = T.StructType([T.StructField(n, T.DoubleType()) for n in ("x0", "y0", "x1", "y1")])
FIGURE = T.StructType(
    [
        T.StructField("page", T.IntegerType()),
        T.StructField("rect", RECT),
        T.StructField("label", T.StringType()),
        T.StructField("caption", T.StringType()),
        T.StructField("png_path", T.StringType()),
        T.StructField("description", T.StringType()),
    ]
)
FIGURES = T.ArrayType(FIGURE)
PAPER = T.StructType(
    [
        T.StructField("filename", T.StringType()),
        T.StructField("pdf_path", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("figures", FIGURES),
        T.StructField("summary_md", T.StringType()),
    ]
)
STATE = T.StructType(
    [
        T.StructField("filename", T.StringType()),
        T.StructField("hash", T.StringType()),
        T.StructField("options_hash", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("figures", FIGURES),
    ]
)
PRIMS = "doc_id string, page int, kind string, x0 double, y0 double, x1 double, y1 double, page_w double, page_h double"
BLOCKS = "doc_id string, page int, ord int, x0 double, y0 double, x1 double, y1 double, text string"
#: Version of STATE; tables of another version read as empty.
STATE_VERSION = 4
