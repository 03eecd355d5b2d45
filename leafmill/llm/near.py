"""Near duplicates by an LSH forest over min-wise hashes, links confirmed on full sets.

Each distinct set of shingles gets TREES signatures of DEPTH min-wise hashes; sets that
share a prefix of BASE hashes in some tree form a region there. Regions are counted first.
One of up to REGION sets is dealt to a single task and is a cell. The
rows of denser regions are put in one range-partitioned order, so that a region may be many
tasks' work; they are cut into cells by deeper prefixes, one more hash at a time, and, where
still dense at full depth, every REGION sets. Pairs that one-bit sketches
place far below the threshold (five standard deviations) are not confirmed.

Neighbours in the order (longest common prefix) in the first CHAINED trees are confirmed
first, cells or not, and so are all sets of a dense region with its most central one; that
gives components. Then the sets of a cell meet again and pair where their components
differ; these pairs are confirmed. So a large group of
near copies costs a few comparisons for each member, and its pairs are never made. What these leave open is finished
exactly: dense regions that still hold several components, whatever tasks their rows were in, are joined where they overlap,
and in each such clump the sets outside its largest component meet all the others in
blocks of about BLOCK by BLOCK, by counts of shared shingles. Sets at the threshold share a region in some tree with
probability 1 - (1 - t^BASE)^TREES, 0.99999 at 0.85.

Equal sets are one node, with the smallest doc_id. Null text and text without a word
have no set and no link. A row with null doc_id takes no part: its component is null and
it is kept. Rows that repeat a doc_id are one node. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, shared_dir, shuffle_parts, tidy, written
from .links import MOST_BROADCAST, components, only
from .tokens import slices
from .words import Words, digest, mix, runs

TREES, DEPTH, BASE, CHAINED, REGION = 16, 8, 4, 4, 48
BLOCK, COLUMNS, LEAST_ROWS = 256, 4096, 2048
ROW = 4 * BASE + DEPTH - BASE
_rng = np.random.default_rng(77)
_MUL = _rng.integers(1, 1 << 63, TREES * DEPTH, dtype=np.uint64) | np.uint64(1)
_ADD = _rng.integers(0, 1 << 63, TREES * DEPTH, dtype=np.uint64)
_BITS = np.array([bin(i).count("1") for i in range(256)], np.int64)


def shingle_set(hashes: np.ndarray, width: int) -> np.ndarray:
    """Sorted hashes of the distinct shingles; fewer words than the width count as one."""
    if not len(hashes):
        return np.zeros(0, np.uint64)
    return np.unique(runs(hashes, min(width, len(hashes))))


def min_hashes(shingles: np.ndarray) -> np.ndarray:
    out = np.full(TREES * DEPTH, np.uint32(0xFFFFFFFF))
    with np.errstate(over="ignore"):
        for a in range(0, len(shingles), 2048):
            rows = (shingles[a : a + 2048, None] * _MUL + _ADD) >> np.uint64(32)
            out = np.minimum(out, rows.astype(np.uint32).min(axis=0))
    return out


def signature(shingles: np.ndarray) -> tuple[bytes, bytes]:
    """Keys of all trees (BASE hashes whole, the deeper ones a byte each), and the one-bit sketch."""
    h = min_hashes(shingles).reshape(TREES, DEPTH)
    head = h[:, :BASE].astype(">u4").view(np.uint8).reshape(TREES, 4 * BASE)
    tail = (mix(h[:, BASE:].astype(np.uint64)) & np.uint64(255)).astype(np.uint8)
    bits = (mix(h.reshape(-1).astype(np.uint64) + np.uint64(1 << 40)) & np.uint64(1)).astype(np.uint8)
    return np.concatenate([head, tail], axis=1).tobytes(), np.packbits(bits).tobytes()


def signed(docs: DataFrame, width: int, lower: bool) -> DataFrame:
    """doc_id, n_shingles, digest (d1, d2) of the set, keys, sketch."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                words = Words(part.column("text"), lower)
                rows = []
                for i in range(part.num_rows):
                    own = shingle_set(words.of(i), width)
                    rows.append((len(own), *digest(own), *(signature(own) if len(own) else (None, None))))
                n, d1, d2, keys, sketch = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(keys, pa.binary()), pa.array(sketch, pa.binary())], ["doc_id", "n_shingles", "d1", "d2", "keys", "sketch"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(tidy(run), "doc_id long, n_shingles long, d1 long, d2 long, keys binary, sketch binary")


def _cells(deep: np.ndarray, a: int, b: int, depth: int = 0) -> list[tuple[int, int]]:
    """Runs of at most REGION rows that a region's rows a to b, in key order, are cut into."""
    if b - a <= REGION:
        return [(a, b)]
    if depth == deep.shape[1]:
        return [(x, min(x + REGION, b)) for x in range(a, b, REGION)]
    cuts = [a, *(np.nonzero(np.diff(deep[a:b, depth]))[0] + a + 1).tolist(), b]
    return [cell for x, y in zip(cuts, cuts[1:], strict=False) for cell in _cells(deep, x, y, depth + 1)]


def _central_pairs(sketch: np.ndarray, far: int, a: int, b: int):
    """Index pairs of a dense region's rows with the one nearest to its commonest sketch bits."""
    bits = np.unpackbits(sketch[a:b], axis=1)
    p = a + int((bits != (2 * bits.sum(axis=0, dtype=np.int64) > b - a)).sum(axis=1).argmin())
    i = np.arange(a, b)
    i = i[(i != p) & (_BITS[sketch[a:b] ^ sketch[p]].sum(axis=1) <= far)]
    return np.minimum(i, p), np.maximum(i, p)


def trees_of(reps: DataFrame) -> DataFrame:
    """A row for each set and tree: id, tree, key, sketch, and the region that the key begins with."""
    trees = reps.select(F.col("rep").alias("id"), "sketch", "keys", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree"))
    rows = trees.select("id", F.col("tree").cast("int").alias("tree"), F.expr(f"substring(keys, tree * {ROW} + 1, {ROW})").alias("key"), "sketch")
    return rows.withColumn("region", F.xxhash64("tree", F.substring("key", 1, 4 * BASE)))


def dense_regions(reps: DataFrame, folder: str) -> DataFrame:
    """Regions of more sets than one task pairs all of."""
    return written(trees_of(reps).groupBy("region").agg(F.count("*").alias("n")).where(f"n > {REGION}").select("region"), f"{folder}/dense")


def tasks_for(reps: DataFrame) -> int:
    """As many as the session sets, but no tasks of a few rows; results don't depend on it."""
    return max(min(shuffle_parts(reps.sparkSession), TREES * reps.count() // LEAST_ROWS), 2)


def far_of(at_least: float) -> int:
    """Sketch bits that sets at the threshold differ in at most, but for five standard deviations."""
    agree = (1 + at_least) / 2
    return int(128 * (1 - agree) + 5 * (128 * agree * (1 - agree)) ** 0.5) + 1


def candidates(reps: DataFrame, dense: DataFrame, at_least: float, folder: str) -> tuple[DataFrame, DataFrame]:
    """a, b: pairs of nodes to confirm first; cell, id, sketch: nodes that pair later, where they are still apart."""
    far, rows, parts = far_of(at_least), trees_of(reps), tasks_for(reps)

    def searcher(kind: int):
        def run(batches):
            task, made = TaskContext.get().partitionId(), 0
            held: pa.Table | None = None
            first = True

            def pairs_of(table: pa.Table, last: bool):
                nonlocal held, first, made
                tree, ids, region = (np.asarray(table.column(c)) for c in ("tree", "id", "region"))
                key, sketch = (np.frombuffer(b"".join(table.column(c).to_pylist()), np.uint8).reshape(len(ids), -1) for c in ("key", "sketch"))
                starts = np.concatenate([[0], np.nonzero(region[1:] != region[:-1])[0] + 1])
                stops = np.concatenate([starts[1:], [len(ids)]])
                edges = []
                if first:
                    edges.append((0, "head"))
                    first = False
                if last:
                    edges.append((len(ids) - 1, "tail"))
                else:
                    held = table.slice(int(starts[-1]))
                    starts, stops = starts[:-1], stops[:-1]
                until = int(stops[-1]) if len(stops) else 0
                i = np.nonzero((region[1:until] == region[: max(until - 1, 0)]) & (tree[1:until] < CHAINED))[0]
                i = i[_BITS[sketch[i] ^ sketch[i + 1]].sum(axis=1) <= far]
                left, right, cells = [i], [i + 1], []
                for a, b in zip(starts.tolist(), stops.tolist(), strict=True):
                    if b - a > REGION and tree[a] < CHAINED:
                        x, y = _central_pairs(sketch, far, a, b)
                        left.append(x)
                        right.append(y)
                    # Two alone, in a tree where neighbours are confirmed first, need no second meeting.
                    cells += [c for c in _cells(key[:, 4 * BASE :], a, b) if c[1] - c[0] > (2 if tree[a] < CHAINED else 1)]
                x, y = (ids[np.concatenate(z)] for z in (left, right))
                none = lambda n, t: pa.nulls(n, t)
                n = len(x)
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y)), none(n, pa.int64()), none(n, pa.binary()), none(n, pa.string()), none(n, pa.int32()), none(n, pa.int64())], FOUND)
                size = np.array([b - a for a, b in cells], np.int64)
                at = np.repeat(np.array([a for a, _ in cells], np.int64) - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
                cell = np.repeat(np.arange(made, made + len(cells)), size) * (1 << 24) + (task * 2 + kind)
                made, n = made + len(cells), len(at)
                yield pa.RecordBatch.from_arrays([pa.array(ids[at]), none(n, pa.int64()), pa.array(cell), table.column("sketch").take(pa.array(at)).combine_chunks().cast(pa.binary()), none(n, pa.string()), none(n, pa.int32()), none(n, pa.int64())], FOUND)
                for x, side in edges if kind else []:
                    yield pa.RecordBatch.from_arrays([pa.array(ids[x : x + 1]), none(1, pa.int64()), none(1, pa.int64()), none(1, pa.binary()), pa.array([side]), pa.array([task], pa.int32()), pa.array(region[x : x + 1])], FOUND)

            pending: list[pa.RecordBatch] = []
            for batch in batches:
                if not batch.num_rows:
                    continue
                pending.append(batch)
                if sum(x.num_rows for x in pending) >= 20_000 and (held is None or sum(x.num_rows for x in pending) >= held.num_rows):
                    table = pa.concat_tables([*([held] if held is not None else []), pa.Table.from_batches(pending)])
                    pending, held = [], None
                    yield from pairs_of(table.combine_chunks(), False)
            if held is not None or pending:
                table = pa.concat_tables([*([held] if held is not None else []), *([pa.Table.from_batches(pending)] if pending else [])])
                yield from pairs_of(table.combine_chunks(), True)

        return run

    order = ["region", "key", "id"]
    whole = only(rows, dense, "region", "left_anti").repartition(parts, "region").sortWithinPartitions(*order)
    found = whole.select("id", "tree", "key", "sketch", "region").mapInArrow(tidy(searcher(0)), FOUND_DDL)
    if not dense.isEmpty():
        spread = only(rows, dense, "region").repartitionByRange(parts, *order).sortWithinPartitions(*order)
        found = found.union(spread.select("id", "tree", "key", "sketch", "region").mapInArrow(tidy(searcher(1)), FOUND_DDL))
    found = written(found, f"{folder}/found")
    tails = found.where("side = 'tail'").select(F.col("a").alias("x"), "region", (F.col("task") + 1).alias("task"))
    heads = found.where("side = 'head'").select(F.col("a").alias("y"), "region", "task")
    across = tails.join(heads, ["region", "task"]).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    pairs = written(found.where("b is not null").select("a", "b").union(across).where("a != b").distinct(), f"{folder}/candidates")
    return pairs, found.where("cell is not null").select("cell", F.col("a").alias("id"), "sketch")


FOUND = ["a", "b", "cell", "sketch", "side", "task", "region"]
FOUND_DDL = "a long, b long, cell long, sketch binary, side string, task int, region long"


def still_apart(cells: DataFrame, found: DataFrame, at_least: float, parts: int) -> DataFrame:
    """a, b: pairs of a cell whose components differ; at most REGION sets make a cell."""
    far = far_of(at_least)

    def run(batches):
        held: pa.Table | None = None

        def pairs_of(table: pa.Table, last: bool):
            nonlocal held
            cell, ids, c = (np.asarray(table.column(x)) for x in ("cell", "id", "c"))
            sketch = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(len(ids), -1)
            starts = np.concatenate([[0], np.nonzero(np.diff(cell))[0] + 1])
            stops = np.concatenate([starts[1:], [len(ids)]])
            if not last:
                held = table.slice(int(starts[-1]))
                starts, stops = starts[:-1], stops[:-1]
            out = []
            for a, b in zip(starts.tolist(), stops.tolist(), strict=True):
                if (c[a:b] != c[a]).any():
                    i, j = np.triu_indices(b - a, 1)
                    i, j = a + i, a + j
                    keep = (c[i] != c[j]) & (_BITS[sketch[i] ^ sketch[j]].sum(axis=1) <= far)
                    out.append((ids[i[keep]], ids[j[keep]]))
            x, y = (np.concatenate(z) for z in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 2
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], ["a", "b"])

        for batch in batches:
            if batch.num_rows:
                table = pa.concat_tables([*([held] if held is not None else []), pa.Table.from_batches([batch])]).combine_chunks()
                held = None
                yield from pairs_of(table, False)
        if held is not None:
            yield from pairs_of(held.combine_chunks(), True)

    names = found.toDF("id", "c")
    named = cells.join(F.broadcast(names) if names.count() <= MOST_BROADCAST else names, "id", "left").select("cell", "id", F.coalesce("c", "id").alias("c"), "sketch")
    return named.repartition(parts, "cell").sortWithinPartitions("cell", "id").mapInArrow(tidy(run), "a long, b long").distinct()


def confirmed(pairs: DataFrame, sets: DataFrame, at_least: tuple[int, int]) -> DataFrame:
    """Pairs with at_least[1] * |intersection| >= at_least[0] * |union|, counted on full sets."""
    part, whole = at_least

    def run(batches):
        for batch in batches:
            a, b = batch.column("a"), batch.column("b")
            keep = []
            for x, y in zip(batch.column("sa"), batch.column("sb"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if min(len(x), len(y)) * whole < max(len(x), len(y)) * part:
                    keep.append(False)
                    continue
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(whole * both >= part * (len(x) + len(y) - both))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([a.filter(mask), b.filter(mask)], ["a", "b"])

    left = pairs.select("a", "b").join(sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa")), "a")
    full = left.join(sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sb")), "b")
    return full.select("a", "b", "sa", "sb").mapInArrow(tidy(run), "a long, b long")


def dense_members(reps: DataFrame, dense: DataFrame, folder: str) -> DataFrame:
    """id, region of the sets in dense regions, where candidates() may pass over pairs."""
    return written(only(trees_of(reps).select("id", "region"), dense, "region"), f"{folder}/members")


def block_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all left with all right sets."""
    both = np.zeros((len(left), len(right)), np.float32)
    shared = np.intersect1d(np.unique(np.concatenate(left)), np.unique(np.concatenate(right)), assume_unique=True)
    for k in range(0, len(shared), COLUMNS):
        columns = shared[k : k + COLUMNS]
        sides = []
        for sets in (left, right):
            m = np.zeros((len(sets), len(columns)), np.float32)
            for i, x in enumerate(sets):
                x = x[np.searchsorted(x, columns[0]) : np.searchsorted(x, columns[-1], "right")]
                at = np.searchsorted(columns, x)
                m[i, at[columns[at] == x]] = 1
            sides.append(m)
        both += sides[0] @ sides[1].T
    return both.astype(np.int64)


def finished(members: DataFrame, sets: DataFrame, found: DataFrame, at_least: tuple[int, int], folder: str) -> DataFrame | None:
    """Links between components that share a dense region, of all pairs there; None if there is no such region."""
    part, whole = at_least
    named = members.join(found.toDF("id", "c"), "id", "left").select("id", "region", F.coalesce("c", "id").alias("c"))
    regions = named.groupBy("region").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.min("id").alias("least")).where("low != high").select("region", "least")
    regions = written(regions, f"{folder}/open")
    if regions.isEmpty():
        return None
    inside = written(only(named, regions.select("region"), "region"), f"{folder}/inside")
    clumps = components(inside.join(F.broadcast(regions) if regions.count() <= MOST_BROADCAST else regions, "region").select(F.col("id").alias("a"), F.col("least").alias("b")), f"{folder}/clumps")
    nodes = written(inside.select("id", "c").distinct().join(clumps.toDF("id", "clump"), "id"), f"{folder}/nodes")
    sizes = nodes.groupBy("clump", "c").agg(F.count("*").alias("n"))
    most = sizes.groupBy("clump").agg(F.sum("n").alias("n"), F.max(F.struct("n", "c")).alias("top"))
    most = most.select("clump", F.col("top.c").alias("main"), F.ceil(F.col("n") / BLOCK).cast("int").alias("all"), F.ceil((F.col("n") - F.col("top.n")) / BLOCK).cast("int").alias("rest"))
    most = written(most, f"{folder}/sizes")
    nodes = nodes.join(F.broadcast(most) if most.count() <= MOST_BROADCAST else most, "clump")
    full = written(nodes.join(sets.select(F.col("doc_id").alias("id"), "shingles"), "id"), f"{folder}/full")
    own = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    rest = full.where("c != main").select("id", "c", "shingles", F.lit(0).alias("side"), "clump", own("rest").alias("i"), "all").select("*", every("all").alias("j")).drop("all")
    others = full.select("id", "c", "shingles", F.lit(1).alias("side"), "clump", own("all").alias("j"), "rest").select("*", every("rest").alias("i")).drop("rest")

    def run(table: pa.Table) -> pa.Table:
        sides = [table.filter(pa.array(np.asarray(table.column("side")) == s)) for s in (0, 1)]
        out = []
        if all(t.num_rows for t in sides):
            held = [[np.frombuffer(x.as_buffer(), np.uint64) for c in t.column("shingles").chunks for x in c] for t in sides]
            ids, names = ([np.asarray(t.column(c)) for t in sides] for c in ("id", "c"))
            n, m = (np.array([len(x) for x in sets], np.int64) for sets in held)
            both = block_counts(*held)
            linked = (whole * both >= part * (n[:, None] + m - both)) & (names[0][:, None] != names[1])
            root: dict[int, int] = {}

            def find(x):
                while root.setdefault(x, x) != x:
                    root[x] = root[root[x]]
                    x = root[x]
                return x

            for i, j in np.argwhere(linked).tolist():
                x, y = find(int(names[0][i])), find(int(names[1][j]))
                if x != y:
                    root[x] = y
                    out.append((int(ids[0][i]), int(ids[1][j])))
        return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})

    blocks = rest.select("clump", "i", "j", "side", "id", "c", "shingles").union(others.select("clump", "i", "j", "side", "id", "c", "shingles"))
    return written(blocks.groupBy("clump", "i", "j").applyInArrow(run, "a long, b long"), f"{folder}/links3")


def near_groups(docs: DataFrame, width: int = 5, at_least: tuple[int, int] = (4, 5), lower: bool = True) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row; at_least is a fraction."""
    spark = docs.sparkSession
    folder = shared_dir(spark)
    marks = written(signed(docs, width, lower), f"{folder}/marks")
    real = marks.where("n_shingles > 0 and doc_id is not null")
    reps = written(real.groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"), F.first("keys").alias("keys"), F.first("sketch").alias("sketch")), f"{folder}/reps")
    dense = dense_regions(reps, folder)
    members = None if dense.isEmpty() else dense_members(reps, dense, folder)
    pairs, cells = candidates(reps, dense, at_least[0] / at_least[1], folder)
    ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).union(cells.select("id"))
    ids = written((ids if members is None else ids.union(members.select("id"))).distinct(), f"{folder}/ids")

    def collect(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                words = Words(part.column("text"), lower)
                own = [shingle_set(words.of(i), width).tobytes() for i in range(part.num_rows)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(own, pa.binary())], ["doc_id", "shingles"])

    texts = only(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), ids, "doc_id").where("text is not null")
    sets = written(texts.mapInArrow(tidy(collect), "doc_id long, shingles binary").where(F.length("shingles") > 0), f"{folder}/sets")
    links = written(confirmed(pairs, sets, at_least), f"{folder}/links1")
    first = components(links, f"{folder}/first")
    apart = written(still_apart(cells, first, at_least[0] / at_least[1], tasks_for(reps)), f"{folder}/apart")
    more = written(confirmed(apart, sets, at_least), f"{folder}/links2")
    final = components(first.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more), f"{folder}/second")
    last = None if members is None else finished(members, sets, final, at_least, folder)
    if last is not None:
        final = components(final.select(F.col("node").alias("a"), F.col("component").alias("b")).union(last), f"{folder}/third")
    named = reps.select("d1", "d2", "rep").join(final.withColumnRenamed("node", "rep"), "rep", "left").select("d1", "d2", F.coalesce("component", "rep").alias("c"))
    rows = marks.select("doc_id", "n_shingles", "d1", "d2").join(named, ["d1", "d2"], "left")
    component = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("c")).otherwise(F.col("doc_id"))
    return rows.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def deduplicated(docs: DataFrame, width: int = 5, at_least: tuple[int, int] = (4, 5), lower: bool = True) -> DataFrame:
    """The rows of docs whose document is the first of its group; of rows that repeat a doc_id one stays."""
    folder = shared_dir(docs.sparkSession)
    groups = written(near_groups(docs, width, at_least, lower).select("doc_id", "kept"), f"{folder}/groups")
    gone = written(groups.where("not kept").select("doc_id").distinct(), f"{folder}/gone")
    again = written(groups.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"), f"{folder}/again")
    left = only(docs, gone, "doc_id", "left_anti")
    return only(left, again, "doc_id", "left_anti").union(only(left, again, "doc_id").dropDuplicates(["doc_id"]))


def op6_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(documents(spark, sf_dir), 3, (85, 100))


OP6_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
  FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s
  FROM words
), flat AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets
), linked AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM flat a JOIN flat b ON a.g = b.g AND a.doc_id < b.doc_id
  GROUP BY 1, 2 HAVING 100 * count(*) >= 85 * (any_value(a.n) + any_value(b.n) - count(*))
), both_ways AS (
  SELECT a, b FROM linked UNION ALL SELECT b, a FROM linked
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM sets
  UNION
  SELECT r.a, e.b FROM reach r JOIN both_ways e ON r.b = e.a
)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, c.component_id, s.doc_id = c.component_id AS kept
FROM sets s JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) c ON s.doc_id = c.a
"""
