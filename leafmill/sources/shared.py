"""Folders and their files through Spark's file systems, so that any store will do."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Tables of files up to this size may be a single file of one row group, which only one task reads.
SMALL_BYTES = 64 << 20


def at(spark: SparkSession, path: str):
    """The path and its file system."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def shared_dir(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir; where that is unset, a temporary one in local mode and an error on a cluster."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        base = spark.conf.get("leafmill.shared.dir", None)
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            base = f"file://{tempfile.mkdtemp(prefix='leafmill-')}"
            spark.conf.set("leafmill.shared.dir", base)
    path = f"{base.rstrip('/')}/leafmill-{uuid.uuid4().hex}"
    target, fs = at(spark, path)
    fs.mkdirs(target)
    fs.deleteOnExit(target)
    return path


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names of what a folder holds; none where it isn't there."""
    target, fs = at(spark, folder)
    return [x.getPath().getName() for x in fs.listStatus(target)] if fs.exists(target) else []


def remove(spark: SparkSession, path: str) -> None:
    target, fs = at(spark, path)
    fs.delete(target, True)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    target, fs = at(spark, path)
    out = fs.create(target, True)
    out.write(bytearray(text.encode()))
    out.close()


def read_text(spark: SparkSession, path: str) -> str:
    """For small files of the driver's own; Spark's readers pass over names that begin with a line."""
    target, fs = at(spark, path)
    held = fs.open(target)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(held, "UTF-8")
    finally:
        held.close()


def spread(table: DataFrame) -> DataFrame:
    """A small table of files dealt out to all cores, as work on texts costs far more than moving them once; a larger one stays as its files are."""
    n = int(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return table.repartition(table.sparkSession.sparkContext.defaultParallelism) if n <= SMALL_BYTES else table
