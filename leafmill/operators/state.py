"""Which files need work: state keyed by file name, content hash and options, kept as a log.

A run appends one segment with the rows of its new files alone, in folders by a hash of the
file name, and then an entry: an empty file whose name says it all, so that it is there
whole or not at all. Versions count up; no clock is asked. Reading merges: of a file's rows
the one of the latest version holds. Segments are of levels by their number of rows; FAN
of a level are merged into one of the next, so a row is written again as often as the
table has levels, not once a run. A merging segment lists those that it stands for, so
one that was appended meanwhile is never lost. What no entry needs any more, or a run left
before its entry, goes after a time of grace, as others may still be reading it.
"""

from __future__ import annotations

import hashlib
import json
import math
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafmill.schemas import STATE, STATE_VERSION
from leafmill.sources import shared

BUCKETS, FAN, GRACE = 32, 8, 3600
ADD, MERGE = "add", "merge"
SEGMENT = T.StructType([*STATE.fields, T.StructField("version", T.LongType()), T.StructField("segment", T.StringType()), T.StructField("bucket", T.IntegerType())])


def options_hash(**options) -> str:
    """Of the options that change what extraction yields; rows made under others are no hits."""
    return hashlib.sha256(json.dumps(options, sort_keys=True).encode()).hexdigest()[:16]


@dataclass(frozen=True, order=True)
class Entry:
    version: int
    segment: str
    rows: int
    kind: str

    @property
    def name(self) -> str:
        return f"{self.version:020d}-{self.rows}-{self.kind}-{self.segment}"

    @classmethod
    def of(cls, name: str) -> Entry:
        version, rows, kind, segment = name.split("-")
        return cls(int(version), segment, int(rows), kind)

    @property
    def level(self) -> int:
        return int(math.log(max(self.rows, 1), FAN) + 1e-9)


def _base(folder: str) -> str:
    return f"{folder}/v={STATE_VERSION}"


def _path(folder: str, segment: str) -> str:
    return f"{_base(folder)}/segments/s={segment}"


def entries(spark: SparkSession, folder: str) -> tuple[list[Entry], list[Entry]]:
    """The entries whose segments hold the state, and those that a merging segment stands for."""
    found = sorted(Entry.of(n) for n in shared.names(spark, f"{_base(folder)}/log"))
    covered = {s for e in found if e.kind == MERGE for s in shared.read_text(spark, f"{_path(folder, e.segment)}/_covers").split()}
    return [e for e in found if e.segment not in covered], [e for e in found if e.segment in covered]


def bucket(name: Column) -> Column:
    return F.pmod(F.xxhash64(name), F.lit(BUCKETS)).cast("int")


def _read(spark: SparkSession, folder: str, live: list[Entry]) -> DataFrame:
    paths = [_path(folder, e.segment) for e in live if e.rows]
    return spark.read.schema(SEGMENT).option("basePath", f"{_base(folder)}/segments").parquet(*paths).select(*SEGMENT.names) if paths else spark.createDataFrame([], SEGMENT)


def merged(rows: DataFrame) -> DataFrame:
    """Of rows (filename, version, segment, ...) the latest of each file. Only files with several rows are joined, so texts stay where they are unless very many changed."""
    place = F.struct("version", "segment")
    again = rows.groupBy("filename").agg(F.max(place).alias("__last"), F.count("*").alias("__n")).where("__n > 1").drop("__n")
    return rows.join(again, "filename", "left").where(F.col("__last").isNull() | (F.col("__last") == place)).drop("__last")


def load(spark: SparkSession, folder: str, only: str | None = None) -> DataFrame:
    """The state of this version of STATE; `only` a file name, for which a single bucket is read."""
    rows = _read(spark, folder, entries(spark, folder)[0])
    if only is not None:
        rows = rows.where((F.col("bucket") == bucket(F.lit(only))) & (F.col("filename") == only))
    return merged(rows).select(*STATE.names)


def _commit(spark: SparkSession, folder: str, entry: Entry) -> None:
    target, fs = shared.at(spark, f"{_base(folder)}/log/{entry.name}")
    fs.create(target, False).close()


def _write(rows: DataFrame, folder: str, segment: str) -> int:
    path = _path(folder, segment)
    # Small segments become a file for each folder that they touch, large ones as many as their size asks for.
    rows.select(*SEGMENT.names).hint("rebalance", F.col("bucket")).write.partitionBy("bucket").parquet(path)
    return rows.sparkSession.read.schema(SEGMENT).parquet(path).count()


def append(new: DataFrame, folder: str) -> bool:
    """Rows of new or changed files; nothing is written where there are none. new: a written table, read more than once."""
    if new.isEmpty():
        return False
    spark, segment = new.sparkSession, uuid.uuid4().hex
    live, gone = entries(spark, folder)
    version = max((e.version for e in live + gone), default=0) + 1
    rows = new.select(*STATE.names).withColumns({"version": F.lit(version).cast("long"), "segment": F.lit(segment), "bucket": bucket(F.col("filename"))})
    _commit(spark, folder, Entry(version, segment, _write(rows, folder, segment), ADD))
    return True


def _stand_for(spark: SparkSession, folder: str, rows: DataFrame, old: list[Entry]) -> None:
    segment, version = uuid.uuid4().hex, max(e.version for e in old)
    n = _write(rows, folder, segment) if any(e.rows for e in old) else 0
    shared.write_text(spark, f"{_path(folder, segment)}/_covers", "\n".join(e.segment for e in old))
    _commit(spark, folder, Entry(version, segment, n, MERGE))


def compact(spark: SparkSession, folder: str, grace: float = GRACE, fan: int = FAN) -> int:
    """Merge levels with `fan` segments or more, lowest first; how many merges. Then what nobody needs goes."""
    done = 0
    while True:
        levels: dict[int, list[Entry]] = {}
        for e in entries(spark, folder)[0]:
            levels.setdefault(e.level, []).append(e)
        full = [own for _, own in sorted(levels.items()) if len(own) >= fan]
        if not full:
            break
        _stand_for(spark, folder, merged(_read(spark, folder, full[0])), full[0])
        done += 1
    vacuum(spark, folder, grace)
    return done


def clear(spark: SparkSession, folder: str) -> None:
    """An empty segment stands for all that there are."""
    if live := entries(spark, folder)[0]:
        _stand_for(spark, folder, spark.createDataFrame([], SEGMENT), [Entry(e.version, e.segment, 0, e.kind) for e in live])


def vacuum(spark: SparkSession, folder: str, grace: float = GRACE) -> list[str]:
    """Remove segments older than the grace in seconds, by the store's own times, that are stood for or have no entry; entries go before their segments."""
    base = _base(folder)
    live, gone = entries(spark, folder)
    target, fs = shared.at(spark, f"{base}/segments")
    if not fs.exists(target):
        return []
    shared.write_text(spark, f"{base}/_now", "")
    now = fs.getFileStatus(shared.at(spark, f"{base}/_now")[0]).getModificationTime()
    needed, out = {e.segment for e in live}, []
    for status in fs.listStatus(target):
        name = status.getPath().getName().removeprefix("s=")
        if name not in needed and now - status.getModificationTime() >= grace * 1000:
            for e in gone:
                if e.segment == name and e.kind == MERGE:
                    # Its own list goes with it, so what that hid must be gone already.
                    hidden = set(shared.read_text(spark, f"{_path(folder, name)}/_covers").split()) & {g.segment for g in gone}
                    if hidden - set(out):
                        break
                if e.segment == name:
                    shared.remove(spark, f"{base}/log/{e.name}")
            else:
                shared.remove(spark, _path(folder, name))
                out.append(name)
    return out


def split(files: DataFrame, state: DataFrame, options: str, crops: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(hits, misses): hits are state rows of unchanged files whose crops are all there; misses are files.

    files(filename, hash, ...); crops(path) are the crop files that exist.
    """
    good = state.where((F.col("options_hash") == options) & F.col("text").isNotNull())
    if crops is not None:
        needed = good.select("filename", "hash", F.explode("figures.png_path").alias("path")).where(F.col("path").isNotNull())
        lost = needed.join(crops.select("path"), "path", "left_anti").select("filename", "hash").distinct()
        good = good.join(lost, ["filename", "hash"], "left_anti")
    hits = good.join(files.select("filename", "hash"), ["filename", "hash"], "left_semi")
    return hits, files.join(good.select("filename", "hash"), ["filename", "hash"], "left_anti")


def upserted(state: DataFrame, new: DataFrame) -> DataFrame:
    return state.join(new.select("filename"), "filename", "left_anti").unionByName(new)


def without_figures(rows: DataFrame) -> DataFrame:
    """For callers that want the texts of a run with figures; the run itself keeps such states apart by their options."""
    return rows.withColumn("figures", F.slice("figures", 1, 0))
