"""Clusters of many pages at once; captions of equal boxes."""

import time

import numpy as np

from leafmill.operators import layout


def boxes(rng, n, side, longest):
    low = np.floor(rng.uniform(0, side, (2, n)))
    return np.concatenate([low, low + rng.integers(-3, longest, (2, n))]).astype(float)


def test_pages_at_once_are_as_each_alone():
    rng = np.random.default_rng(1)
    for most in (2, 20, 90):
        counts = rng.integers(0, most, 200)
        own = boxes(rng, counts.sum(), 900, 90)
        found, out = layout.grown_pages(counts, own)
        ends, out_ends = np.cumsum(counts), np.cumsum(found)
        for n, end, m, out_end in zip(counts, ends, found, out_ends, strict=True):
            alone = layout.grown(own[:, end - n : end].T)
            assert sorted(alone.tolist()) == sorted(out[:, out_end - m : out_end].T.tolist())


def test_many_small_pages_take_microseconds_a_box():
    rng = np.random.default_rng(2)
    counts = rng.integers(1, 24, 25_000)
    began = time.process_time()
    layout.grown_pages(counts, boxes(rng, counts.sum(), 600, 150))
    assert time.process_time() - began < 30e-6 * counts.sum()


def test_first_boxes_are_clustered_among_themselves(spark):
    # The two vectors join over a raster that neither reaches by itself only once all are clustered.
    rows = [("a", 0, "vector", 0.0, 0.0, 10.0, 10.0), ("a", 0, "vector", 20.0, 0.0, 30.0, 10.0), ("a", 0, "raster", 40.0, 0.0, 50.0, 10.0), ("b", 0, "raster", 0.0, 0.0, 5.0, 5.0), ("b", 1, "vector", 0.0, 0.0, 5.0, 5.0)]
    from pyspark.sql import functions as F

    frame = spark.createDataFrame(rows, "doc_id string, page int, kind string, x0 double, y0 double, x1 double, y1 double").withColumns({"page_w": F.lit(100.0), "page_h": F.lit(100.0)})
    got = sorted(tuple(r) for r in layout.clustered(frame, first=F.col("kind") == "vector").select("doc_id", "page", "x0", "y0", "x1", "y1").collect())
    assert got == [("a", 0, 0.0, 0.0, 50.0, 10.0), ("b", 0, 0.0, 0.0, 5.0, 5.0), ("b", 1, 0.0, 0.0, 5.0, 5.0)]


def test_equal_boxes_keep_a_row_each(spark):
    regions = spark.createDataFrame([("a", 0, 1, 0.0, 0.0, 10.0, 10.0)] * 2 + [("a", 0, 2, 0.0, 500.0, 10.0, 510.0)], "doc_id string, page int, region int, x0 double, y0 double, x1 double, y1 double")
    blocks = spark.createDataFrame([("a", 0, 1, 0.0, 12.0, 10.0, 20.0, " Figure\n 1:\x1c a plot "), ("a", 0, 2, 0.0, 11.0, 10.0, 20.0, "no figure")], "doc_id string, page int, ord int, x0 double, y0 double, x1 double, y1 double, text string")
    got = sorted((r.region, r.label, r.caption) for r in layout.with_captions(regions, blocks).collect())
    assert got[:2] == [(1, "Figure 1:", "Figure 1: a plot")] * 2 and got[2] == (2, None, None)
