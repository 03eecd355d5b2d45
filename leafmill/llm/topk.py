"""Exact top-k search by inner product with a KD-tree for each shard of vectors.

Space is cut into at most CELLS cells by median splits of the widest dimension, learned
from about SAMPLE_ROWS vectors; the vectors of a cell become shards of SHARD, each with a
KD-tree: median splits down to leaves of LEAF vectors, and tight bounding boxes. A query
goes through a tree best first: a box's bound is the largest inner product that any point
of it can have, and boxes below the k-th score so far stay closed. Each query first looks
into one shard of the cell with the best bound; with the k-th score found there it goes to
the cells whose box can still hold a better one, all shards of them. Queries travel in
blocks of BLOCK, SPREAD blocks to a task at most, once for every GROUP shards of a cell.

Vectors that are null, empty of an id, or hold a null or non-finite component take no
part. A query meets vectors of its own length only. Rows with the query's vec_id are its
own. Equal query rows count once; rows that repeat a vec_id with another vector are
queries of their own. Repeated candidate rows each hold a place. Other columns are
not read.
"""

from __future__ import annotations

import heapq
import io

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shared_dir, tidy, written

SHARD, LEAF, BLOCK, SPREAD = 8192, 256, 512, 64
CELLS, SAMPLE_ROWS, GROUP = 256, 20_000, 16
SCALE = 1024
EXACT = 2.0**53


def usable(rows: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, dim, v (components times scale, rounded down)."""
    x = F.col("embedding")
    good = F.col("vec_id").isNotNull() & x.isNotNull() & ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double")) == float("inf")))
    return rows.where(F.coalesce(good, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), F.size(x).alias("dim"), F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("long")).alias("v"))


def packed(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def small(a: np.ndarray) -> np.ndarray:
    """The same numbers in the narrowest integers."""
    top = max(int(a.max()), -int(a.min())) if a.size else 0
    return a.astype(np.int16 if top < 1 << 15 else np.int32 if top < 1 << 31 else np.int64)


def kd_tree(ids: np.ndarray, points: np.ndarray) -> dict[str, np.ndarray]:
    """Points in leaf order; for each node its rows (first, stop), children (0: a leaf) and box."""
    order = np.arange(len(ids))
    first, stop, child, low, high = [], [], [], [], []

    def add(a: int, b: int) -> int:
        own, me = points[order[a:b]], len(first)
        lo, hi = own.min(axis=0), own.max(axis=0)
        first.append(a)
        stop.append(b)
        child.append((0, 0))
        low.append(lo)
        high.append(hi)
        if b - a > LEAF and points.shape[1] and (hi > lo).any():
            axis, mid = int(np.argmax(hi - lo)), (b - a) // 2
            order[a:b] = order[a:b][np.argpartition(own[:, axis], mid)]
            child[me] = (add(a, a + mid), add(a + mid, b))
        return me

    add(0, len(ids))
    return {"ids": ids[order], "points": small(points[order]), "first": np.array(first), "stop": np.array(stop), "child": np.array(child), "low": small(np.array(low)), "high": small(np.array(high))}


def search(tree: dict[str, np.ndarray], query_ids: np.ndarray, queries: np.ndarray, floor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query index, vec_id, score) of up to k best rows of the tree for each query, none below its floor."""
    top = max((float(np.abs(x).max()) for x in (tree["low"], tree["high"]) if x.size), default=0.0) * (float(np.abs(queries).max()) if queries.size else 0.0) * max(queries.shape[1], 1)
    kind = np.float64 if top < EXACT else np.int64
    points, low, high, queries = (x.astype(kind) for x in (tree["points"], tree["low"], tree["high"], queries))
    bounds = np.maximum(queries, 0) @ high.T + np.minimum(queries, 0) @ low.T
    ids, first, stop, child = tree["ids"], tree["first"].tolist(), tree["stop"].tolist(), tree["child"].tolist()
    out_q, out_id, out_s = [], [], []
    for q in range(len(queries)):
        bound, least = bounds[q].tolist(), floor[q]
        best_s, best_id = np.zeros(0, kind), np.zeros(0, np.int64)
        heap = [(-bound[0], 0)]
        while heap and -heap[0][0] >= least:
            _, node = heapq.heappop(heap)
            left, right = child[node]
            if left:
                for c in (left, right):
                    if bound[c] >= least:
                        heapq.heappush(heap, (-bound[c], c))
                continue
            a, b = first[node], stop[node]
            score = points[a:b] @ queries[q]
            near = (score >= least) & (ids[a:b] != query_ids[q])
            if near.any():
                best_s, best_id = np.concatenate([best_s, score[near]]), np.concatenate([best_id, ids[a:b][near]])
                if len(best_s) >= k:
                    keep = np.lexsort((best_id, -best_s))[:k]
                    best_s, best_id = best_s[keep], best_id[keep]
                    least = max(least, best_s[-1])
        out_q.append(np.full(len(best_s), q))
        out_id.append(best_id)
        out_s.append(best_s.astype(np.int64))
    return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in (out_q, out_id, out_s))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(len(column), dim)


class Cells:
    """Median splits of space: cell numbers of vectors, and how many parts the vectors of each cell are dealt over."""

    def __init__(self, sample: np.ndarray, rows: int):
        want = min(CELLS, -(-rows // SHARD))
        self.axis, self.cut, self.child, self.parts = [], [], [], []
        self._add(sample, want, max(rows / max(len(sample), 1), 1))

    def _add(self, own: np.ndarray, want: int, weight: float) -> int:
        """Node number, or -1 - cell for a leaf."""
        spread = own.max(axis=0) - own.min(axis=0) if own.size else np.zeros(0)
        axis = int(np.argmax(spread)) if spread.size else 0
        cut = float(np.median(own[:, axis])) if spread.size else 0.0
        below = own[:, axis] < cut if spread.size else np.zeros(0, bool)
        if want < 2 or not below.any():
            self.parts.append(max(1, round(len(own) * weight / (SHARD * GROUP))))
            return -len(self.parts)
        me = len(self.axis)
        self.axis.append(axis)
        self.cut.append(cut)
        self.child.append(None)
        self.child[me] = (self._add(own[below], want // 2, weight), self._add(own[~below], want - want // 2, weight))
        return me

    def of(self, points: np.ndarray) -> np.ndarray:
        if not self.axis:
            return np.zeros(len(points), np.int64)
        at, axis, cut, child = np.zeros(len(points), np.int64), np.array(self.axis), np.array(self.cut), np.array(self.child)
        while (open_ := np.nonzero(at >= 0)[0]).size:
            node = at[open_]
            above = points[open_, axis[node]] >= cut[node]
            at[open_] = child[node, above.astype(np.int64)]
        return -1 - at


def cells_of(vectors: DataFrame) -> dict[int, Cells]:
    """Cells for each dimension, from a sample drawn by a hash of vec_id."""
    sizes = {r[0]: r[1] for r in vectors.groupBy("dim").count().collect()}  # a row for each length of vector
    share = min(1.0, SAMPLE_ROWS / max(sum(sizes.values()), 1))
    drawn = vectors.where(F.pmod(F.xxhash64("vec_id", F.lit("cells")), F.lit(1 << 20)) <= int(share * (1 << 20))).select("dim", "v")
    held: dict[int, list] = {}
    for r in drawn.toLocalIterator():
        held.setdefault(r["dim"], []).append(r["v"])
    return {dim: Cells(np.array(held.get(dim, []), float).reshape(len(held.get(dim, [])), dim), n) for dim, n in sizes.items()}


def shards_of(rows: DataFrame, cells: dict[int, Cells]) -> DataFrame:
    """shard, dim, cell, part, bundle (of GROUP shards), low and high corner of its box, tree."""

    def place(batches):
        for batch in batches:
            dims, cell, part = np.asarray(batch.column("dim")), np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows, np.int32)
            for dim in np.unique(dims).tolist():
                own = dims == dim
                cell[own] = cells[dim].of(matrix(batch.filter(pa.array(own)).column("v"), dim))
                part[own] = (np.asarray(batch.column("vec_id"))[own] // 7) % np.array(cells[dim].parts)[cell[own]]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(part)], ["vec_id", "dim", "v", "cell", "part"])

    def run(batches):
        task, n, held, at = TaskContext.get().partitionId(), 0, [], None

        def out():
            nonlocal n, held
            ids, points = (np.concatenate(x) for x in zip(*held, strict=True))
            n, held = n + 1, []
            tree = kd_tree(ids, points)
            corners = [pa.array([tree[x][0].astype(np.int64).tolist()], pa.list_(pa.int64())) for x in ("low", "high")]
            return pa.RecordBatch.from_arrays([pa.array([(task << 32) + n], pa.int64()), *(pa.array([x], pa.int32()) for x in at), pa.array([n // GROUP], pa.int32()), *corners, pa.array([packed(**tree)], pa.binary())], ["shard", "dim", "cell", "part", "bundle", "low", "high", "tree"])

        for batch in batches:
            keys = np.stack([np.asarray(batch.column(c)) for c in ("dim", "cell", "part")], axis=1)
            edges = [0, *(np.nonzero((keys[1:] != keys[:-1]).any(axis=1))[0] + 1).tolist(), len(keys)]
            for x, y in zip(edges, edges[1:], strict=False):
                if y == x:
                    continue
                key = tuple(keys[x].tolist())
                if held and key != at:
                    yield out()
                at = key
                own = batch.slice(x, y - x)
                ids, points = np.asarray(own.column("vec_id")), matrix(own.column("v"), key[0])
                for i in range(0, len(ids), SHARD):
                    held.append((ids[i : i + SHARD], points[i : i + SHARD]))
                    if sum(len(z) for z, _ in held) >= SHARD:
                        yield out()
        if held:
            yield out()

    placed = rows.select("vec_id", "dim", "v").mapInArrow(tidy(place), "vec_id long, dim int, v array<long>, cell int, part int")
    keys = ["dim", "cell", "part"]
    return placed.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(tidy(run), "shard long, dim int, cell int, part int, bundle int, low array<long>, high array<long>, tree binary")


def boxes_of(shards: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each dimension its cells' numbers, low and high corners."""
    flat = shards.select("dim", "cell", F.posexplode(F.arrays_zip("low", "high")).alias("at", "x"))
    rows = flat.groupBy("dim", "cell", "at").agg(F.min("x.low").alias("low"), F.max("x.high").alias("high"))
    listed = rows.groupBy("dim", "cell").agg(F.sort_array(F.collect_list(F.struct("at", "low", "high"))).alias("c")).select("dim", "cell", F.col("c.low").alias("low"), F.col("c.high").alias("high"))
    out: dict[int, list] = {}
    for r in listed.collect():  # CELLS rows for each length of vector
        out.setdefault(r["dim"], []).append((r["cell"], r["low"], r["high"]))
    return {dim: (np.array([c for c, _, _ in x]), np.array([lo for _, lo, _ in x], float).reshape(len(x), dim), np.array([hi for _, _, hi in x], float).reshape(len(x), dim)) for dim, x in out.items()}


def blocks_of(queries: DataFrame, n: int, boxes: dict, best: bool) -> DataFrame:
    """dim, cell, spread, queries: blocks of queries (vec_id, variant, v, floor) for each cell whose box can hold a score of their floor; best: only for the cell of the best bound."""
    blocks = max(1, -(-n // BLOCK))

    def pack(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        dim, block = rows.column("dim")[0].as_py(), rows.column("block")[0].as_py()
        ids, variant, floor, v = np.asarray(rows.column("vec_id")), np.asarray(rows.column("variant")), np.asarray(rows.column("floor")), matrix(rows.column("v").combine_chunks(), dim)
        cells, low, high = boxes.get(dim) or (np.zeros(1, np.int64), *np.zeros((2, 1, dim)))  # vectors of no length have no corners
        bound = np.maximum(v, 0).astype(float) @ high.T + np.minimum(v, 0).astype(float) @ low.T
        # Sums of doubles round; a cell is left out only where that can't matter.
        bound = bound + np.abs(bound) * 1e-9 + 1
        going = np.arange(len(cells)) == bound.argmax(axis=1)[:, None] if best else bound >= floor[:, None]
        out = []
        for k, cell in enumerate(cells.tolist()):
            own = going[:, k]
            if own.any():
                out.append({"dim": dim, "cell": cell, "spread": block // SPREAD, "queries": packed(ids=ids[own], variant=variant[own], v=small(v[own]), floor=floor[own])})
        return pa.Table.from_pylist(out, schema=pa.schema([("dim", pa.int32()), ("cell", pa.int32()), ("spread", pa.int32()), ("queries", pa.binary())]))

    dealt = queries.withColumn("block", F.pmod(F.xxhash64("vec_id", "variant"), F.lit(blocks)).cast("int"))
    return dealt.groupBy("dim", "block").applyInArrow(pack, "dim int, cell int, spread int, queries binary")


def searched(shards: DataFrame, blocks: DataFrame, k: int) -> DataFrame:
    """query_id, variant, vec_id, score: up to k rows for each query and shard that its cells hold."""

    def run(trees: pa.Table, queries: pa.Table) -> pa.Table:
        out = [FOUND.empty_table()]
        for blob in trees.column("tree").to_pylist():
            tree = dict(np.load(io.BytesIO(blob)))
            for one in queries.column("queries").to_pylist():
                block = np.load(io.BytesIO(one))
                q, ids, score = search(tree, block["ids"], block["v"].astype(np.int64), block["floor"], k)
                out.append(pa.table({"query_id": block["ids"][q], "variant": block["variant"][q], "vec_id": ids, "score": score}, schema=FOUND))
        return pa.concat_tables(out)

    home = ["dim", "cell", "part", "bundle"]
    spreads = blocks.select("dim", "cell", "spread").distinct()
    trees = shards.select(*home, "tree").join(spreads, ["dim", "cell"])
    sent = blocks.join(shards.select(*home).distinct(), ["dim", "cell"])
    there = [f"to_{c}" for c in (*home, "spread")]
    sent = sent.select(*home, "spread", "queries").toDF(*there, "queries")
    return trees.groupBy(*home, "spread").cogroup(sent.groupBy(*there)).applyInArrow(run, "query_id long, variant long, vec_id long, score long")


FOUND = pa.schema([("query_id", pa.int64()), ("variant", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def top_k(rows: DataFrame, is_query, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score of the k rows of largest inner product with each query row."""
    folder = shared_dir(rows.sparkSession)
    vectors = usable(rows)
    shards = written(shards_of(vectors, cells_of(vectors)), f"{folder}/shards")
    boxes = boxes_of(shards)
    queries = vectors.where(is_query).withColumn("variant", F.xxhash64("v")).dropDuplicates(["vec_id", "variant"])
    queries = written(queries.withColumn("floor", F.lit(float("-inf"))), f"{folder}/queries")
    n = queries.count()
    leads = shards.groupBy("dim", "cell").agg(F.min("shard").alias("shard"))
    first = searched(shards.join(leads, ["dim", "cell", "shard"]), written(blocks_of(queries, n, boxes, True), f"{folder}/blocks1"), k)
    kth = first.groupBy(F.col("query_id").alias("vec_id"), "variant").agg(F.min("score").cast("double").alias("kth"), F.count("*").alias("found"))
    bounded = queries.drop("floor").join(kth.where(F.col("found") >= k), ["vec_id", "variant"], "left")
    bounded = written(bounded.withColumn("floor", F.coalesce("kth", F.lit(float("-inf")))).drop("kth", "found"), f"{folder}/bounded")
    # The first search only gives the floors; the second one meets every shard, so that no row counts twice.
    every = searched(shards, written(blocks_of(bounded, n, boxes, False), f"{folder}/blocks2"), k)
    order = Window.partitionBy("query_id", "variant").orderBy(F.desc("score"), "vec_id")
    ranked = every.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op1_kd_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 100 == 0)


OP1_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM scored QUALIFY rank <= 10
"""
