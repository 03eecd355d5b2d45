"""Named files written where their content changed."""

from __future__ import annotations

import os
import shutil
import uuid

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.sources import files, packs, shared


def changed(new: DataFrame, old: DataFrame) -> DataFrame:
    """Rows (filename, content) that `old` doesn't hold as they are; contents meet as digests."""
    before = old.select("filename", F.sha2(F.col("content").cast("binary"), 256).alias("__old"))
    joined = new.join(before, "filename", "left")
    return joined.where(~F.sha2(F.col("content").cast("binary"), 256).eqNullSafe(F.col("__old"))).drop("__old")


def write_if_changed(new: DataFrame, folder: str, parts: tuple[str, ...] = ("", "raw/")) -> DataFrame:
    """filename of each file of `new` that the folder, which all executors share, doesn't hold as it is; those are written.

    Markdown in the folder's `parts` is compared; names elsewhere count as new. Files are
    put in place whole after all of them are computed and committed; what an earlier run that was broken
    off has committed goes there first.
    """
    packs.publish(new.sparkSession, folder)
    packs.sweep(folder)
    there = new.sparkSession.createDataFrame([], "filename string, content binary")
    for part in parts:
        if files.there(new.sparkSession, f"{folder}/{part}"):
            there = there.union(files.files(new.sparkSession, f"{folder}/{part}", "*.md").select(F.concat(F.lit(part), "filename"), "content"))
    packs.stage(changed(new.select("filename", "content"), there), folder)
    return packs.publish(new.sparkSession, folder)


def write_pieces(pieces: DataFrame, folder: str, name: str) -> bool:
    """Whether folder/name, put together from pieces in order, is another file than before.

    The pieces are put in order and written as a table; the sizes of its partitions, a row
    each, are all that the driver holds. From their sums each task knows where its partition
    begins: where the old file has the same size it compares its range, else, or where any
    range differs, it writes it into the new file, which takes the old one's place when all
    are done. A task that runs again writes the same bytes to the same place.
    """
    spark, path = pieces.sparkSession, os.path.join(folder, name)
    os.makedirs(folder, exist_ok=True)
    stage, target = f"{folder}/.{name}.{uuid.uuid4().hex}", f"{path}.{uuid.uuid4().hex}.part"
    pieces.orderBy("part", "filename").select("part", "filename", F.col("piece").cast("binary").alias("piece"), F.spark_partition_id().alias("at")).write.parquet(stage)
    try:
        staged = spark.read.schema("part int, filename string, piece binary, at int").parquet(stage)
        sizes = {r[0]: r[1] for r in staged.groupBy("at").agg(F.sum(F.octet_length("piece"))).collect()}
        begins, total = {}, 0
        for k in sorted(sizes):
            begins[k], total = total, total + sizes[k]
        ordered = staged.repartition(max(len(sizes), 1), "at").sortWithinPartitions("at", "part", "filename")

        def ranges(mode: str, file: str):
            def run(batches):
                place, before, differ = 0, None, 0
                with open(file, mode) as f:
                    for rows in batches:
                        for at, piece in zip(rows["at"], rows["piece"], strict=True):
                            place, before = (begins[at] if at != before else place), at
                            f.seek(place)
                            if mode == "rb":
                                differ += f.read(len(piece)) != piece
                            else:
                                f.write(piece)
                            place += len(piece)
                    if mode != "rb":
                        f.flush()
                        os.fsync(f.fileno())
                yield pd.DataFrame({"n": [differ]})

            return ordered.select("at", "piece").mapInPandas(run, "n long").agg(F.sum("n")).first()[0] or 0

        if os.path.exists(path) and os.path.getsize(path) == total and not ranges("rb", path):
            return False
        with open(target, "wb") as f:
            f.truncate(total)
        ranges("r+b", target)
        os.replace(target, path)
        return True
    finally:
        shared.remove(spark, stage)
        if os.path.exists(target):
            os.remove(target)


def export_crops(papers: DataFrame, folder: str) -> int:
    """Copies crops that exist to folder/figures/<stem>/; how many."""

    def copy(batches):
        for rows in batches:
            n = []
            for source, stem in zip(rows["png"], rows["stem"], strict=True):
                there = bool(source) and os.path.exists(source)
                if there:
                    target = os.path.join(folder, "figures", stem)
                    os.makedirs(target, exist_ok=True)
                    shutil.copy2(source, os.path.join(target, os.path.basename(source)))
                n.append(int(there))
            yield pd.DataFrame({"n": n})

    from leafmill.functions import strings as S

    rows = papers.select(F.explode("figures.png_path").alias("png"), S.stem(F.col("filename")).alias("stem"))
    return rows.mapInPandas(copy, "n int").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
