"""Shared folder, written intermediate tables and small helpers of the training-data operators."""

from __future__ import annotations

import ctypes
import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafmill.sources.shared import shared_dir, spread  # noqa: F401  the operators take shared_dir from here


def written(df: DataFrame, path: str) -> DataFrame:
    """Cut lineage with a table: later reads survive lost executors and see one fixed result."""
    df.write.option("compression", "zstd").mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_table(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A table of rows whose number is bounded by a parameter, built by SQL alone."""
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")))


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """An Arrow function that gives freed memory back at its end, since workers live on to run other tasks."""

    def whole(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
            libc.malloc_trim(0)

    return whole


def mapped(df: DataFrame, run: Callable, added: list[T.StructField]) -> DataFrame:
    """mapInArrow over all columns, which gives them and the added ones; other columns than doc_id and text go through by number, as their names may hold anything."""
    fields = [T.StructField(f.name if f.name in ("doc_id", "text") else f"c{i}", f.dataType) for i, f in enumerate([*df.schema.fields, *added])]
    numbered = df.toDF(*[f.name for f in fields[: len(df.columns)]])
    return numbered.mapInArrow(tidy(run), T.StructType(fields)).toDF(*df.columns, *[f.name for f in added])


def every_column(df: DataFrame) -> list[Column]:
    """The columns in their order, whatever characters their names hold."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def quantile_cuts(ids: DataFrame, column: str, parts: int) -> list:
    """At most parts - 1 sorted values that split a column into ranges of about equal rows."""
    if parts < 2:
        return []
    shares = [i / parts for i in range(1, parts)]
    found = ids.select(F.percentile_approx(column, shares, 10000)).first()[0]
    return sorted(set(found or []))


def range_of(column: Column, cuts: list) -> Column:
    """Index of the range that holds the value: a search tree of comparisons, evaluated on the JVM; null goes to 0."""
    def tree(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(column < F.lit(cuts[mid]), tree(lo, mid)).otherwise(tree(mid + 1, hi))

    return F.when(column.isNull(), F.lit(0)).otherwise(tree(0, len(cuts)))


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
