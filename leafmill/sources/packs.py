"""Named files as a Spark sink: tasks write packs, one small file commits them, tasks put the files in place.

`leafmill_files` takes rows (filename, content). Each task attempt streams its rows into a pack
of its own, and tells the driver its place; the driver's commit writes one manifest that lists
the packs, a row for each task. Until then nothing is to be seen, so a failed task or job leaves
no file; no file is renamed on an object store, where a finished upload appears as a whole.
publish() then puts the files of committed packs where they belong, those that differ from
what is there only. It may be broken off and run again: the manifest goes last (names that the
broken run had put in place are not told again). Packs of killed tasks go by sweep().

A folder has one writer at a time. A null name or content is an error of the job, as is a
name that leads out of the folder. Of rows with one name the greatest content stays.
Folders are paths or URIs that pyarrow.fs opens (local, HDFS, S3, GCS).
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from .shared import shared_dir

#: Content in memory of a task before it goes to the pack.
GROUP_BYTES = 16 << 20
PACKS, COMMITS = ".packs", ".commits"
ROWS = pa.schema([("filename", pa.string()), ("content", pa.binary())])


def store(folder: str) -> tuple[pafs.FileSystem, str]:
    """The file system and the path in it."""
    if "://" in folder or folder.startswith("file:"):
        scheme, rest = folder.split(":", 1)
        return pafs.FileSystem.from_uri(f"{scheme}:///{rest.lstrip('/')}" if scheme == "file" else folder)
    return pafs.LocalFileSystem(), os.path.abspath(folder)


def put(fs: pafs.FileSystem, path: str, data: bytes) -> None:
    """A file that is there whole or not at all; only a local disk needs a rename for that."""
    local = isinstance(fs, pafs.LocalFileSystem)
    target = f"{path}.{uuid.uuid4().hex}.part" if local else path
    with fs.open_output_stream(target) as f:
        f.write(data)
    if local:
        os.replace(target, path)


def held(fs: pafs.FileSystem, path: str, size: int) -> bytes | None:
    """The file's bytes, if there is one of that size."""
    info = fs.get_file_info(path)
    if info.type != pafs.FileType.File or info.size != size:
        return None
    with fs.open_input_stream(path) as f:
        return f.read()


class LocalPlace:
    """Places files on a local disk: each is written in a folder of the task's own and linked to its name.

    A folder is locked for each name that is looked up, made or moved in it, so tasks that share
    one wait for each other; a link is one step there, and tells whether the name is taken.
    """

    def __init__(self, fs: pafs.FileSystem, own: str):
        self.fs, self.waiting = fs, f"{own}/{uuid.uuid4().hex}"
        os.makedirs(own, exist_ok=True)

    def __call__(self, path: str, data: bytes) -> bool:
        """Whether the file is new or other than before."""
        with open(self.waiting, "wb") as f:
            f.write(data)
        try:
            for _ in range(2):
                try:
                    os.link(self.waiting, path)
                    return True
                except FileNotFoundError:
                    os.makedirs(os.path.dirname(path), exist_ok=True)
                except OSError:  # the name is taken, or there are no links here
                    break
            if held(self.fs, path, len(data)) == data:
                return False
            os.replace(self.waiting, path)
            return True
        finally:
            if os.path.lexists(self.waiting):
                os.remove(self.waiting)


class StorePlace:
    """Places files in a store, where a finished upload appears as a whole."""

    def __init__(self, fs: pafs.FileSystem):
        self.fs = fs

    def __call__(self, path: str, data: bytes) -> bool:
        if held(self.fs, path, len(data)) == data:
            return False
        self.fs.create_dir(os.path.dirname(path), recursive=True)
        put(self.fs, path, data)
        return True


@dataclass
class Packed(WriterCommitMessage):
    pack: str | None
    rows: int


class PackWriter(DataSourceArrowWriter):
    def __init__(self, folder: str):
        self.folder, self.job = folder, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Packed:
        fs, root = store(self.folder)
        name, rows, out = f"{uuid.uuid4().hex}.parquet", 0, None
        path = f"{root}/{PACKS}/{self.job}/{name}"
        try:
            for batch in iterator:
                if not batch.num_rows:
                    continue
                if out is None:
                    fs.create_dir(os.path.dirname(path), recursive=True)
                    out = pq.ParquetWriter(path, ROWS, filesystem=fs, compression="zstd")
                table = pa.Table.from_batches([batch]).select(ROWS.names).cast(ROWS)
                for x in table.column("filename").to_pylist():
                    if not x or x.startswith("/") or ".." in x.split("/") or x.split("/")[0] in (PACKS, COMMITS):
                        raise ValueError(f"not a file name: {x!r}")
                if table.column("content").null_count:
                    raise ValueError("a file without content")
                step = max(1, batch.num_rows * GROUP_BYTES // max(table.nbytes, 1))
                for a in range(0, batch.num_rows, step):
                    out.write_table(table.slice(a, step))
                rows += batch.num_rows
        except BaseException:
            if out is not None:
                out.close()
                fs.delete_file(path)
            raise
        if out is None:
            return Packed(None, 0)
        out.close()
        return Packed(name, rows)

    def commit(self, messages: list[Packed | None]) -> None:
        packs = sorted(m.pack for m in messages if m is not None and m.pack)
        if not packs:
            return
        fs, root = store(self.folder)
        fs.create_dir(f"{root}/{COMMITS}", recursive=True)
        version = max((int(os.path.basename(p).split("-")[0]) for p in manifests(fs, root)), default=0) + 1
        put(fs, f"{root}/{COMMITS}/{version:012d}-{self.job}.json", json.dumps({"job": self.job, "packs": packs, "rows": sum(m.rows for m in messages if m)}).encode())

    def abort(self, messages: list[Packed | None]) -> None:
        fs, root = store(self.folder)
        if fs.get_file_info(f"{root}/{PACKS}/{self.job}").type == pafs.FileType.Directory:
            fs.delete_dir(f"{root}/{PACKS}/{self.job}")


class NamedFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "leafmill_files"

    def schema(self) -> str:
        return "filename string, content binary"

    def writer(self, schema, overwrite: bool) -> PackWriter:
        if overwrite:
            raise ValueError("files are put beside the others: mode is append")
        return PackWriter(self.options["path"])


def manifests(fs: pafs.FileSystem, root: str) -> list[str]:
    """Committed jobs whose files may not be in place yet, oldest first."""
    found = fs.get_file_info(pafs.FileSelector(f"{root}/{COMMITS}", allow_not_found=True))
    return sorted(x.path for x in found if x.path.endswith(".json"))


def stage(rows: DataFrame, folder: str) -> None:
    """Rows (filename, content) as committed packs of the folder."""
    rows.sparkSession.dataSource.register(NamedFiles)
    rows.select("filename", F.col("content").cast("binary").alias("content")).write.format("leafmill_files").mode("append").option("path", folder).save()


def publish(spark: SparkSession, folder: str) -> DataFrame:
    """Puts the files of all committed packs in place; filename of those that are new or other than before, a written table."""
    fs, root = store(folder)
    told_of = f"{shared_dir(spark)}/published"
    spark.createDataFrame([], "filename string").write.parquet(told_of)

    def placing(job: str):
        def place(batches):
            own, base = store(folder)
            to = LocalPlace(own, f"{base}/{PACKS}/{job}/placing") if isinstance(own, pafs.LocalFileSystem) else StorePlace(own)
            for batch in batches:
                put_here = [name for name, content in zip(batch.column("filename").to_pylist(), batch.column("content"), strict=True) if to(f"{base}/{name}", content.as_py())]
                yield pa.RecordBatch.from_arrays([pa.array(put_here, pa.string())], ["filename"])

        return place

    for path in manifests(fs, root):
        with fs.open_input_stream(path) as f:
            told = json.loads(f.read())
        base = f"{folder.rstrip('/')}/{PACKS}/{told['job']}"
        rows = spark.read.schema("filename string, content binary").parquet(*[f"{base}/{p}" for p in told["packs"]])
        # Names alone are counted; contents move only where a name comes twice.
        again = rows.groupBy("filename").agg(F.count("*").alias("n")).where("n > 1").select("filename")
        if not again.isEmpty():
            twice = rows.join(again, "filename", "left_semi").groupBy("filename").agg(F.max("content").alias("content"))
            rows = rows.join(again, "filename", "left_anti").union(twice)
        rows.mapInArrow(placing(told["job"]), "filename string").write.mode("append").parquet(told_of)
        fs.delete_file(path)
        fs.delete_dir(f"{root}/{PACKS}/{told['job']}")
    return spark.read.schema("filename string").parquet(told_of)


def sweep(folder: str) -> int:
    """Removes packs that no manifest names, which killed jobs left; how many jobs' they were. No job may be running."""
    fs, root = store(folder)
    named = {os.path.basename(p)[:-5].split("-")[1] for p in manifests(fs, root)}
    left = [x.path for x in fs.get_file_info(pafs.FileSelector(f"{root}/{PACKS}", allow_not_found=True)) if os.path.basename(x.path) not in named]
    for path in left:
        fs.delete_dir(path)
    return len(left)
