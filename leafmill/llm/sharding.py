"""Sharding by fixed virtual slots (DataFrame and SQL functions only).

Records hash into a fixed number of slots; bytes and rows are summed per slot; a
versioned slot-to-shard map places the slots, and rebalancing edits that map only.
A slot above 1/HOT of all bytes or rows (one text that fills a large part of the
corpus, or very many empty ones) is split into sub-slots by record id, so the map
never holds more than SLOTS + 18 * HOT entries, whatever the input.

Null text: no bytes, so size 1. Null ids and repeated rows are ordinary records. An
empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import heapq
import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, shared_dir, small_table, written

SLOTS = 4096
HOT = 128
MAP_SCHEMA = "version: int, slot: int, shard: int, bytes: bigint, rows: bigint, first_place: bigint"


def _hashed(value: Column, n: Column) -> Column:
    """0 to n - 1 by the first 32 bits of a digest, which any SQL engine can compute."""
    return F.pmod(F.conv(F.substring(F.md5(value.cast("binary")), 1, 8), 16, 10).cast("long"), n).cast("int")


def place_slots(stats: list[tuple[int, int, int]], n_shards: int, version: int = 1) -> list[dict]:
    """Version 1 of a map: largest slots first, each to the shard with the fewest bytes."""
    loads = [(0, 0, s) for s in range(n_shards)]
    heapq.heapify(loads)
    shard_of = {}
    for slot, size, rows in sorted(stats, key=lambda x: (-x[1], -x[2], x[0])):
        total, count, shard = heapq.heappop(loads)
        shard_of[slot] = shard
        heapq.heappush(loads, (total + size, count + rows, shard))
    return _numbered([(slot, shard_of[slot], size, rows) for slot, size, rows in stats], version)


def grow_map(entries: list[dict], n_shards: int) -> list[dict]:
    """Next version with one more shard: slots move into the new shard only, from the fullest ones."""
    moved = {e["slot"]: e["shard"] for e in entries}
    held: dict[int, list[dict]] = {s: [] for s in range(n_shards)}
    for e in sorted(entries, key=lambda e: (e["bytes"], e["slot"])):
        held[e["shard"]].append(e)
    load = {s: sum(e["bytes"] for e in v) for s, v in held.items()}
    goal, got = sum(load.values()) / (n_shards + 1), 0
    while n_shards:
        fullest = max(load, key=lambda s: (load[s], -s))
        fitting = [e for e in held[fullest] if got + e["bytes"] <= goal]
        if load[fullest] <= goal or not fitting:
            break
        e = fitting[-1]
        held[fullest].remove(e)
        load[fullest] -= e["bytes"]
        got += e["bytes"]
        moved[e["slot"]] = n_shards
    version = max((e["version"] for e in entries), default=0) + 1
    return _numbered([(e["slot"], moved[e["slot"]], e["bytes"], e["rows"]) for e in entries], version)


def _numbered(placed: list[tuple[int, int, int, int]], version: int) -> list[dict]:
    """Entries with the place in its shard at which each slot begins."""
    out, ends = [], {}
    for slot, shard, size, rows in sorted(placed):
        out.append({"version": version, "slot": slot, "shard": shard, "bytes": size, "rows": rows, "first_place": ends.get(shard, 0)})
        ends[shard] = ends.get(shard, 0) + rows
    return out


def write_map(spark: SparkSession, entries: list[dict], folder: str) -> DataFrame:
    """Store one version beside the earlier ones and read it back."""
    version = entries[0]["version"] if entries else 1
    return written(small_table(spark, entries, MAP_SCHEMA).coalesce(1), f"{folder}/slot_map/v{version}")


def sharded(docs: DataFrame, n_shards: int = 8, folder: str | None = None) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot (place in the shard, gapless from 0), virtual_slot, map_version."""
    spark = docs.sparkSession
    folder = folder or shared_dir(spark)
    text = F.coalesce(F.col("text"), F.lit(""))
    records = written(
        docs.select(
            "doc_id",
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            _hashed(F.coalesce(F.col("text"), F.col("doc_id").cast("string"), F.lit("")), F.lit(SLOTS)).alias("base"),
        ),
        f"{folder}/records",
    )
    totals = [F.sum("size").alias("bytes"), F.count("*").alias("rows")]
    sums = [tuple(r) for r in records.groupBy("base").agg(*totals).collect()]  # SLOTS rows at most
    all_bytes, all_rows = sum(s[1] for s in sums), sum(s[2] for s in sums)
    parts, next_slot = {}, SLOTS
    for slot, size, rows in sorted(sums):
        share = max(size / all_bytes, rows / all_rows)
        if share > 1 / HOT:
            n = math.ceil(share * 8 * HOT)
            parts[slot] = (next_slot, n)
            next_slot += n
    if parts:
        hot = small_table(spark, [{"base": s, "start": a, "parts": n} for s, (a, n) in parts.items()], "base: int, start: int, parts: int")
        slot = F.coalesce(F.col("start") + _hashed(F.concat_ws(":", "doc_id", "size"), F.col("parts")), F.col("base"))
        records = records.join(F.broadcast(hot), "base", "left").withColumn("virtual_slot", slot.cast("int"))
        split = records.where(F.col("start").isNotNull()).groupBy("virtual_slot").agg(*totals).collect()
        sums = [s for s in sums if s[0] not in parts] + [tuple(r) for r in split]
    else:
        records = records.withColumn("virtual_slot", F.col("base"))
    placed = write_map(spark, place_slots(sums, n_shards), folder)
    place = F.row_number().over(Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32"))
    return (
        records.join(F.broadcast(placed.withColumnRenamed("slot", "virtual_slot")), "virtual_slot")
        .select("doc_id", "size", "text_crc32", "shard", (F.col("first_place") + place - 1).alias("slot"), "virtual_slot", F.col("version").alias("map_version"))
    )


def op4_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight shards of near equal bytes; equal texts stay together unless their slot is hot."""
    return sharded(documents(spark, sf_dir), 8).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot"
    )


OP4_SQL = f"""
WITH RECURSIVE crc_steps AS (
  SELECT list_transform(range(256), lambda b: list_reduce(range(8), lambda c, i: CASE WHEN (c & 1) = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b)) AS steps
), texts AS (
  SELECT DISTINCT coalesce(text, '') AS t FROM documents
), crcs AS (
  SELECT t, xor(list_reduce(list_transform(regexp_extract_all(hex(encode(t)), '..'), lambda x: CAST('0x' || x AS BIGINT)), lambda c, b: xor(c >> 8, steps[(xor(c, b) & 255) + 1]), 4294967295::BIGINT), 4294967295) AS text_crc32
  FROM texts, crc_steps
), records AS (
  SELECT doc_id, strlen(coalesce(text, '')) + 1 AS size, text_crc32, CAST('0x' || left(md5(coalesce(text, CAST(doc_id AS VARCHAR), '')), 8) AS BIGINT) % {SLOTS} AS base
  FROM documents JOIN crcs ON coalesce(text, '') = t
), sums AS (
  SELECT base, greatest(sum(size)::DOUBLE / (SELECT sum(size) FROM records), count(*)::DOUBLE / (SELECT count(*) FROM records)) AS share FROM records GROUP BY base
), hot AS (
  SELECT base, ceil(share * {8 * HOT})::BIGINT AS parts FROM sums WHERE share > 1.0::DOUBLE / {HOT}
), dealt AS (
  SELECT base, parts, {SLOTS} + sum(parts) OVER (ORDER BY base) - parts AS start FROM hot
), virtual AS (
  SELECT r.*, CAST(coalesce(start + CAST('0x' || left(md5(concat_ws(':', doc_id, size)), 8) AS BIGINT) % parts, r.base) AS INTEGER) AS virtual_slot FROM records r LEFT JOIN dealt d ON r.base = d.base
), stats AS (
  SELECT virtual_slot, sum(size)::BIGINT AS bytes, count(*) AS n, row_number() OVER (ORDER BY sum(size) DESC, count(*) DESC, virtual_slot) AS i FROM virtual GROUP BY virtual_slot
), placed AS (
  SELECT 0::BIGINT AS i, list_transform(range(8), lambda s: {{'total': 0::BIGINT, 'n': 0::BIGINT, 'shard': s}}) AS loads, 0::BIGINT AS shard
  UNION ALL
  SELECT s.i, list_sort(list_append(p.loads[2:], {{'total': p.loads[1].total + s.bytes, 'n': p.loads[1].n + s.n, 'shard': p.loads[1].shard}})), p.loads[1].shard FROM placed p JOIN stats s ON s.i = p.i + 1
), slot_map AS (
  SELECT virtual_slot, shard, sum(n) OVER (PARTITION BY shard ORDER BY virtual_slot) - n AS first_place FROM stats JOIN placed USING (i)
)
SELECT doc_id, CAST(size AS BIGINT) AS size, text_crc32, 'bytes' AS law, CAST(shard AS INTEGER) AS shard,
  CAST(first_place + row_number() OVER (PARTITION BY virtual_slot ORDER BY doc_id, text_crc32) - 1 AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard, virtual_slot
FROM virtual JOIN slot_map USING (virtual_slot)
"""
