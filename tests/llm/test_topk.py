"""Operator 1 against all inner products."""

import math

import duckdb
import numpy as np

from leafmill.llm import topk

SMALL = "/root/testdata/sf0.001"
DDL = "vec_id long, embedding array<float>, label int, dim string, v string"


def plain(rows, k=10):
    good = [(i, np.floor(1024 * np.array(x, np.float32).astype(np.float64)).astype(np.int64)) for i, x in rows if i is not None and x is not None and all(c is not None and math.isfinite(c) for c in x)]
    out = set()
    for i, q in good:
        if i % 100 == 0:
            best = sorted((-int(q @ c), j) for j, c in good if j != i and len(c) == len(q))[:k]
            out |= {(i, r, j, -s) for r, (s, j) in enumerate(best, 1)}
    return out


def got(df):
    rows = [(r.query_id, r.rank, r.vec_id, r.score) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_small_table_and_sql(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()]
    found = got(topk.op1_kd_trees(spark, SMALL))
    assert found == plain(rows)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SMALL}/embeddings.parquet'")
    assert found == set(con.sql(topk.OP1_SQL).project("query_id, rank, vec_id, score").fetchall())


def test_many_shards_and_ties(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(topk, "LEAF", 8)
    rng = np.random.default_rng(1)
    rows = [(i, (rng.integers(-3, 4, 5) / 8).tolist()) for i in range(1200)]
    spark.createDataFrame([(i, x, 0, "d", "v") for i, x in rows], DDL).repartition(7).write.parquet(f"{tmp_path}/embeddings.parquet")
    assert got(topk.op1_kd_trees(spark, str(tmp_path))) == plain(rows)


def test_cells_keep_queries_away(spark, tmp_path, monkeypatch):
    """Several cells, parts and shards; vectors apart from each other are not all searched."""
    for name, value in (("SHARD", 40), ("LEAF", 8), ("GROUP", 2), ("BLOCK", 2)):
        monkeypatch.setattr(topk, name, value)
    rng = np.random.default_rng(3)
    centres = rng.integers(-40, 40, (12, 4))
    rows = [(i, ((centres[i % 12] + rng.integers(-2, 3, 4)) / 8).tolist()) for i in range(1500)] + [(5000 + i, [1.0, 1.0, 1.0, 1.0]) for i in range(700)]
    spark.createDataFrame([(i, x, 0, "d", "v") for i, x in rows], DDL).repartition(5).write.parquet(f"{tmp_path}/embeddings.parquet")
    assert got(topk.op1_kd_trees(spark, str(tmp_path))) == plain(rows)
    vectors = topk.usable(spark.read.parquet(f"{tmp_path}/embeddings.parquet"))
    cells = topk.cells_of(vectors)
    shards = topk.shards_of(vectors, cells).cache()
    boxes = topk.boxes_of(shards)
    assert len(boxes[4][0]) > 10 and max(cells[4].parts) > 1
    floors = vectors.where("vec_id % 100 = 0").withColumn("variant", topk.F.lit(0)).withColumn("floor", topk.F.aggregate("v", topk.F.lit(0.0), lambda a, x: a + x * x) * 0.9)
    sent = topk.blocks_of(floors, 22, boxes, False).collect()
    assert 0 < len(sent) < 11 * len(boxes[4][0]) * 0.7


def test_odd_rows(spark, tmp_path):
    rows = [(0, [1.0, 2.0]), (100, [0.5]), (200, None), (300, [1.0, None]), (400, [float("nan"), 1.0]), (500, [float("inf"), 1.0]), (None, [1.0, 1.0]), (7, [-1.0, 0.0009]), (8, [1e6, -1e6]), (9, [3.0]), (600, []), (11, [])]
    spark.createDataFrame([(i, x, 0, "d", "v") for i, x in rows], DDL).write.parquet(f"{tmp_path}/embeddings.parquet")
    assert got(topk.op1_kd_trees(spark, str(tmp_path))) == plain(rows)
    spark.createDataFrame([], DDL).write.mode("overwrite").parquet(f"{tmp_path}/embeddings.parquet")
    assert topk.op1_kd_trees(spark, str(tmp_path)).collect() == []


def test_repeated_rows(spark, tmp_path):
    rows = [(0, [1.0]), (0, [1.0]), (5, [2.0]), (5, [2.0]), (6, [1.0])]
    spark.createDataFrame([(i, x, 0, "d", "v") for i, x in rows], DDL).write.parquet(f"{tmp_path}/embeddings.parquet")
    found = sorted((r.query_id, r.rank, r.vec_id) for r in topk.op1_kd_trees(spark, str(tmp_path)).collect())
    assert found == [(0, 1, 5), (0, 2, 5), (0, 3, 6)]
