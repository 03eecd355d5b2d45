"""Files as tables: PDFs, written documents, crops, and the choice of one paper."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafmill.functions import strings as S

BINARY = T.StructType([T.StructField("path", T.StringType()), T.StructField("modificationTime", T.TimestampType()), T.StructField("length", T.LongType()), T.StructField("content", T.BinaryType())])


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def there(spark: SparkSession, folder: str) -> bool:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)


def files(spark: SparkSession, folder: str, glob: str = "*", only: str | None = None) -> DataFrame:
    """path, filename, content of a folder's own files; `only` a file name, kept to at the listing: no other file is read."""
    if not there(spark, folder):
        raise FileNotFoundError(f"no folder {folder}")
    kept = "".join(f"[{c}]" if c in "*?[{" else f"\\{c}" if c in "\\]}" else c for c in only) if only else glob
    found = spark.read.format("binaryFile").option("pathGlobFilter", kept).schema(BINARY).load(folder)
    return found.select("path", basename(F.col("path")).alias("filename"), "content")


def content_hash(content: Column) -> Column:
    return F.sha2(content.cast("binary"), 256)


def pdf_files(spark: SparkSession, folder: str, only: str | None = None) -> DataFrame:
    """path, filename, content, hash."""
    return files(spark, folder, "*.pdf", only).withColumn("hash", content_hash(F.col("content")))


def folded(text: Column) -> Column:
    """Without case, as Unicode folds it: sharp s and ligatures are what they are in capitals, both small sigmas are one."""
    return F.lower(F.replace(F.upper(text), F.lit("Σ"), F.lit("σ")))


def selected(names: DataFrame, wanted: str, column: str = "filename") -> DataFrame:
    """Rows whose name or stem is `wanted`; only if there is none, whose stem contains it; case set aside."""
    key, name = folded(F.lit(wanted)), folded(F.col(column))
    tier = F.when((name == key) | (S.stem(name) == key), 1).when(S.stem(name).contains(key), 2)
    ranked = names.withColumn("__tier", tier).where(F.col("__tier").isNotNull())
    best = ranked.agg(F.min("__tier").alias("__best"))
    return ranked.join(F.broadcast(best), F.col("__tier") == F.col("__best")).drop("__tier", "__best")


def select_paper(spark: SparkSession, folder: str, wanted: str) -> str:
    """The one file name meant, or an error that lists the candidates."""
    names = pdf_files(spark, folder).select("filename")
    found = sorted(r[0] for r in selected(names, wanted).limit(20).collect())
    if len(found) == 1:
        return found[0]
    shown = found or sorted(r[0] for r in names.limit(20).collect())
    raise ValueError(f"{wanted!r} names {len(found)} files: {', '.join(shown) or 'none there'}")


def written_documents(spark: SparkSession, folder: str, exclude: tuple[str, ...] = ("INDEX.md", "PAPERS_SUMMARY.md")) -> DataFrame:
    """filename, content of all markdown files there but the excluded; files that aren't UTF-8 are left out."""
    if not there(spark, folder):
        return spark.createDataFrame([], "filename string, content string")
    rows = files(spark, folder, "*.md").where(~F.col("filename").isin(*exclude))
    return rows.select("filename", F.try_validate_utf8(F.col("content").cast("string")).alias("content")).where(F.col("content").isNotNull())


def crop_files(spark: SparkSession, folder: str) -> DataFrame:
    """path, content of the crops under folder, which may not be there yet."""
    if not there(spark, folder):
        return spark.createDataFrame([], "path string, content binary")
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.png").option("recursiveFileLookup", "true").schema(BINARY).load(folder)
    return found.select(F.regexp_replace("path", "^file:/+", "/").alias("path"), "content")
