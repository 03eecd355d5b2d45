"""Best-fit packing of token sequences, in rounds.

Tasks pack the pieces they read by best-fit decreasing, GROUP at a time. Sequences with
at most SLACK ids to spare are final. The others go as items into further rounds of
best fit over fewer, mixed groups of at most GROUP items, until one group has held them
all or a round saves less than one in a hundred; then the rest is final too.

Null text is the empty text: its end id alone. Every piece of every row is placed once,
whole. Repeated rows are packed as rows of their own. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, shared_dir, tidy, written
from .tokens import TOKEN_BYTES, crc32, default_vocabulary, encoder, slices

CAPACITY = 2048
SLACK = 4
GROUP = 100_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, bin long, offset long"


def best_fit(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item: longest first, each into the fullest bin that takes it."""
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms, n = 0, 0  # rooms: a bit for each room that some bin has
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        fitting = rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
        else:
            room, b, n = capacity, n, n + 1
        bins[i], offsets[i] = b, capacity - room
        if left := room - size:
            by_room[left].append(b)
            rooms |= 1 << left
    return bins, offsets


def packed_locally(docs: DataFrame, vocabulary: str | None = None, end: int = 0, capacity: int = CAPACITY) -> DataFrame:
    path = vocabulary or default_vocabulary()

    def run(batches):
        tool, task, used = encoder(path), TaskContext.get().partitionId(), 0
        held: list[tuple] = []

        def out():
            nonlocal used, held
            table = pd.DataFrame(held, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
            bins, offsets = best_fit(table["length"].to_numpy(), capacity)
            ids = (task << 36) + used + bins
            used += int(bins.max()) + 1
            held = []
            return pa.RecordBatch.from_arrays(
                [pa.array(list(table["doc_id"]) if table["doc_id"].isna().any() else table["doc_id"].to_numpy(), pa.int64(), from_pandas=True), *(pa.array(table[c].to_numpy(), t) for c, t in (("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()))), pa.array(ids), pa.array(offsets)],
                ["doc_id", "piece", "start", "length", "ids_crc32", "bin", "offset"],
            )

        for batch in batches:
            for part in slices(batch, "text", TOKEN_BYTES):
                ids, ends = tool.encode(part.column("text"), end)
                begin = 0
                for key, stop in zip(part.column("doc_id").to_pylist(), ends.tolist(), strict=True):
                    for k, a in enumerate(range(begin, stop, capacity)):
                        b = min(a + capacity, stop)
                        held.append((key, k, a - begin, b - a, crc32(ids[a:b])))
                    begin = stop
                    if len(held) >= GROUP:
                        yield out()
        if held:
            yield out()
        tool.forget()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(tidy(run), PIECES)


def packed(docs: DataFrame, vocabulary: str | None = None, end: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    spark = docs.sparkSession
    folder = shared_dir(spark)
    pieces = written(packed_locally(docs, vocabulary, end, capacity), f"{folder}/pieces")
    fills = pieces.groupBy("bin").agg(F.sum("length").alias("fill"))
    items = written(fills.where(F.col("fill") < capacity - SLACK), f"{folder}/items0")
    n, moves, turn = items.count(), None, 0

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["fill", "bin"], ascending=[False, True], kind="stable").reset_index(drop=True)
        bins, offsets = best_fit(rows["fill"].to_numpy(), capacity)
        head = rows["bin"].to_numpy()[np.unique(bins, return_index=True)[1]]  # a merged bin keeps its first item's number
        return pd.DataFrame({"bin": rows["bin"], "to": head[bins], "by": offsets, "fill": rows["fill"]})

    while n > 1:
        groups = -(-n // GROUP)
        turn += 1
        dealt = items.withColumn("g", F.pmod(F.xxhash64("bin", F.lit(turn)), F.lit(groups)))
        step = written(dealt.groupBy("g").applyInPandas(lambda rows: merge(rows[["bin", "fill"]]), "bin long, to long, by long, fill long"), f"{folder}/moves{turn}")
        link = step.select(F.col("bin").alias("to"), F.col("to").alias("to2"), F.col("by").alias("by2"))
        if moves is None:
            moves = step.select("bin", "to", "by")
        else:
            moves = moves.join(link, "to", "left").select("bin", F.coalesce("to2", "to").alias("to"), (F.col("by") + F.coalesce("by2", F.lit(0))).alias("by"))
            moves = written(moves, f"{folder}/all{turn}")
        merged = step.groupBy("to").agg(F.sum("fill").alias("fill")).select(F.col("to").alias("bin"), "fill")
        items = written(merged.where(F.col("fill") < capacity - SLACK), f"{folder}/items{turn}")
        before, n = n, items.count()
        if groups == 1 or n > 0.99 * before:
            break
    if moves is None:
        return pieces.withColumnRenamed("bin", "sequence_id")
    placed = pieces.join(moves, "bin", "left")
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", F.coalesce("to", "bin").alias("sequence_id"), (F.col("offset") + F.coalesce("by", F.lit(0))).alias("offset"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(documents(spark, sf_dir))
