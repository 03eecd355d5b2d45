"""Token ids as binary shards with a minimal perfect hash index from document key to place.

A shard is one record of a Parquet file: the ids of a run of documents in ascending
doc_id order as one raw little-endian payload, and an index. The index is a cascade of
bit arrays (a key's bit is the first level where it is alone; the rank of that bit is
its number), with a 32-bit fingerprint, the first row and the number of rows for each
key, so a lookup costs a fixed number of steps and a key that isn't there is told apart
but for one in 2^32. Files are written by Spark's committer, so a lost task leaves none.

Null text: the end id alone. Null doc_id: rows without a key, first in order. Rows that
repeat a doc_id are kept, side by side in the order of their texts' hash, and found by the
same key. Ties and one key with very many rows are dealt over several shards. An empty
table gives no shard. Other columns are not read.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, shared_dir, shuffle_parts, tidy
from .tokens import TOKEN_BYTES, crc32, default_vocabulary, encoder, slices

SHARD_BYTES = 4 << 20
SHARD_ROWS = 1 << 16
HEAD = struct.Struct("<4sHHIII")
MAGIC = b"LMI1"


def mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit finaliser of keys, another for each seed."""
    with np.errstate(over="ignore"):
        x = keys.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % (1 << 64))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Numbers 0 to n - 1 for n distinct keys."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels  # of booleans
        self.ranks = [np.cumsum(x) - x for x in levels]
        self.before = np.cumsum([0, *[int(x.sum()) for x in levels]])

    @classmethod
    def of(cls, keys: np.ndarray) -> PerfectHash:
        levels, left = [], keys
        while len(left):
            width = 2 * len(left) + 1
            slot = (mixed(left, len(levels)) % np.uint64(width)).astype(np.int64)
            alone = np.bincount(slot, minlength=width) == 1
            levels.append(alone)
            left = left[~alone[slot]]
        return cls(levels)

    def number(self, keys: np.ndarray) -> np.ndarray:
        """-1 for a key that no level takes; another stranger gets some number."""
        out, open_ = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for k, level in enumerate(self.levels):
            slot = (mixed(keys[open_], k) % np.uint64(len(level))).astype(np.int64)
            hit = level[slot]
            out[open_[hit]] = self.before[k] + self.ranks[k][slot[hit]]
            open_ = open_[~hit]
        return out


def _fingerprint(keys: np.ndarray) -> np.ndarray:
    return (mixed(keys, 1 << 20) >> np.uint64(32)).astype("<u4")


def make_index(keys: np.ndarray, nulls: int, ends: np.ndarray) -> bytes:
    """keys: sorted, with repeats, of all rows but the first `nulls`; ends: where each row's ids end."""
    own, first, count = np.unique(keys, return_index=True, return_counts=True)
    table = PerfectHash.of(own)
    number = table.number(own)
    entry = np.zeros((3, len(own)), "<u4")
    entry[:, number] = _fingerprint(own), first + nulls, count
    head = HEAD.pack(MAGIC, len(table.levels), 0, len(own), nulls, len(ends))
    widths = np.array([len(x) for x in table.levels], "<u4").tobytes()
    bits = b"".join(np.packbits(x).tobytes() for x in table.levels)
    return b"".join([head, widths, bits, entry.tobytes(), ends.astype("<u8").tobytes()])


class Index:
    def __init__(self, blob: bytes):
        magic, levels, _, keys, self.nulls, rows = HEAD.unpack_from(blob)
        if magic != MAGIC:
            raise ValueError("not a shard index")
        at = HEAD.size
        widths = np.frombuffer(blob, "<u4", levels, at)
        at += 4 * levels
        found = []
        for w in widths.tolist():
            n = (w + 7) // 8
            found.append(np.unpackbits(np.frombuffer(blob, np.uint8, n, at), count=w).astype(bool))
            at += n
        self.hash = PerfectHash(found)
        self.entry = np.frombuffer(blob, "<u4", 3 * keys, at).reshape(3, keys)
        self.ends = np.frombuffer(blob, "<u8", rows, at + 12 * keys).astype(np.int64)

    def rows(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First row and number of rows of each key; 0 rows for a key that isn't there."""
        keys = np.asarray(keys, np.int64)
        number = self.hash.number(keys)
        if not self.entry.shape[1]:
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        got = self.entry[:, np.maximum(number, 0)].astype(np.int64)
        there = (number >= 0) & (got[0] == _fingerprint(keys))
        return got[1], np.where(there, got[2], 0)


def encoded(batches, path: str, end: int):
    """(doc_id, number of ids, raw ids, bytes of an id) of each row of Arrow batches."""
    tool = encoder(path)
    wide = tool.dtype.itemsize
    for batch in batches:
        for part in slices(batch, "text", TOKEN_BYTES):
            ids, ends = tool.encode(part.column("text"), end)
            raw, start = ids.astype(tool.dtype).tobytes(), 0
            for key, stop in zip(part.column("doc_id").to_pylist(), ends.tolist(), strict=True):
                yield key, stop - start, raw[start * wide : stop * wide], wide
                start = stop
    tool.forget()


def write_shards(docs: DataFrame, folder: str, vocabulary: str | None = None, end: int = 1, parts: int | None = None) -> str:
    """Shards of the documents' ids under folder/shards, in ascending doc_id order by (part, seq).

    Texts are put in order before they are encoded: the ranges are found by a pass of their
    own over what is dealt out, which encoded rows would have to be encoded twice for.
    """
    parts, path = parts or shuffle_parts(docs.sparkSession), vocabulary or default_vocabulary()

    def run(batches):
        part, seq, keys, ids, sizes, held, wide = TaskContext.get().partitionId(), 0, [], [], [], 0, 2

        def shard():
            nulls = sum(k is None for k in keys)
            own = np.array([k for k in keys if k is not None], np.int64)
            index = make_index(own, nulls, np.cumsum(sizes))
            row = {"part": part, "seq": seq, "first_key": keys[-1] if nulls == len(keys) else int(own[0]), "last_key": keys[-1], "n_docs": len(keys), "n_ids": int(sum(sizes)), "wide": wide, "keys": own.astype("<i8").tobytes(), "index": index, "payload": b"".join(ids)}
            return pa.RecordBatch.from_pylist([row], schema=SHARD)

        for key, n, raw, wide in encoded(batches, path, end):  # noqa: B020
            if keys and (held + len(raw) > SHARD_BYTES or len(keys) >= SHARD_ROWS):
                yield shard()
                seq, keys, ids, sizes, held = seq + 1, [], [], [], 0
            keys.append(key)
            ids.append(raw)
            sizes.append(n)
            held += len(raw)
        if keys:
            yield shard()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("tie"))
    placed = rows.repartitionByRange(parts, F.asc_nulls_first("doc_id"), "tie")
    ordered = placed.sortWithinPartitions(F.asc_nulls_first("doc_id"), "tie")
    ordered.select("doc_id", "text").mapInArrow(tidy(run), SHARD_DDL).write.mode("overwrite").parquet(f"{folder}/shards")
    return f"{folder}/shards"


SHARD = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("first_key", pa.int64()), ("last_key", pa.int64()), ("n_docs", pa.int32()), ("n_ids", pa.int64()), ("wide", pa.int32()), ("keys", pa.binary()), ("index", pa.binary()), ("payload", pa.binary())])
SHARD_DDL = "part int, seq int, first_key long, last_key long, n_docs int, n_ids long, wide int, keys binary, index binary, payload binary"


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every row, looked up by key in the files."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                index, keys = Index(row["index"]), np.frombuffer(row["keys"], "<i8")
                ids = np.frombuffer(row["payload"], f"<u{row['wide']}")
                own = np.unique(keys)
                first, count = index.rows(own)
                if int(count.sum()) != len(keys):
                    raise ValueError("a key of the shard isn't in its index")
                rows = np.concatenate([np.arange(index.nulls), np.repeat(first - np.cumsum(count) + count, count) + np.arange(len(keys))]).astype(np.int64)
                ends = index.ends[rows]
                starts = np.where(rows > 0, index.ends[rows - 1], 0)
                names = [None] * index.nulls + np.repeat(own, count).tolist()
                yield pa.RecordBatch.from_pydict(
                    {
                        "part": pa.array([row["part"]] * len(rows), pa.int32()),
                        "seq": pa.array([row["seq"]] * len(rows), pa.int32()),
                        "doc_id": pa.array(names, pa.int64()),
                        "local": pa.array(starts, pa.int64()),
                        "n_tokens": pa.array(ends - starts, pa.int64()),
                        "ids_crc32": pa.array([crc32(ids[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], pa.int64()),
                    }
                )

    shards = spark.read.schema(SHARD_DDL).parquet(path)
    found = shards.select("part", "seq", "wide", "keys", "index", "payload").mapInArrow(run, "part int, seq int, doc_id long, local long, n_tokens long, ids_crc32 long")
    sizes = shards.select("part", "seq", "n_ids")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each written partition
    totals = sizes.groupBy("part").agg(F.sum("n_ids").alias("own")).select("part", F.coalesce(F.sum("own").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    places = sizes.select("part", "seq", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)).alias("within")).join(totals, "part")
    return found.join(places, ["part", "seq"]).select("doc_id", (F.col("base") + F.col("within") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")


def fetch(spark: SparkSession, path: str, key: int) -> list[np.ndarray]:
    """The ids of each row with this key; only shards whose key range holds it are read."""
    out = []
    shards = spark.read.schema(SHARD_DDL).parquet(path).where((F.col("first_key") <= key) & (F.col("last_key") >= key))
    for row in shards.select("part", "seq", "wide", "index", "payload").orderBy("part", "seq").toLocalIterator():
        index = Index(bytes(row["index"]))
        first, count = (int(x[0]) for x in index.rows(np.array([key])))
        ids = np.frombuffer(row["payload"], f"<u{row['wide']}")
        out += [ids[int(index.ends[r - 1]) if r else 0 : int(index.ends[r])] for r in range(first, first + count)]
    return out


def op5_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = write_shards(documents(spark, sf_dir), shared_dir(spark))
    return read_shards(spark, path)
