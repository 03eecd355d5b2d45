"""Figure regions from page geometry: filters, clustering, captions, top figures."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions import strings as S
from leafmill.functions.arrays import bound

#: Shares of the page's area, and lengths in points.
MIN_RASTER, MAX_REGION, MIN_FIGURE = 0.01, 0.85, 0.04
GAP, PAD, THIN, FRAME = 15.0, 6.0, 2.0, 1.0
CAPTION_GAP, CAPTION_SLACK, ABOVE = 40.0, 20.0, 100.0
CAPTION = r"(?iU)^(?:Figure|Fig\.|Table)\s*\S+"
MAX_FIGURES = 12


def area() -> Column:
    return F.greatest(F.lit(0.0), F.col("x1") - F.col("x0")) * F.greatest(F.lit(0.0), F.col("y1") - F.col("y0"))


def share() -> Column:
    return area() / F.abs(F.col("page_w") * F.col("page_h"))


def near(a: str, b: str, gap: float = GAP) -> Column:
    """Boxes (structs or aliases) that overlap or lie at most `gap` apart on both axes."""
    x = lambda n, c: F.col(f"{n}.{c}")
    return (x(a, "x1") + gap >= x(b, "x0")) & (x(b, "x1") + gap >= x(a, "x0")) & (x(a, "y1") + gap >= x(b, "y0")) & (x(b, "y1") + gap >= x(a, "y0"))


#: Rows of the grid that a box may cover to be put into it; higher boxes wait for the exact pass.
MOST_ROWS = 256


def _sharing(boxes: np.ndarray, side: float) -> np.ndarray:
    """Bounding boxes of those that share a cell of a grid, again and again, until none do."""
    while len(boxes) > 1:
        low, high = np.floor(boxes[:, :2] / side).astype(np.int64), np.floor(boxes[:, 2:] / side).astype(np.int64)
        fit = (high >= low).all(axis=1) & (high[:, 1] - low[:, 1] < MOST_ROWS)
        own = np.nonzero(fit)[0]
        if len(own) < 2:
            return boxes
        # A row of the grid after the other, boxes by their first column: a run ends where none of it reaches the next.
        count = high[own, 1] - low[own, 1] + 1
        box = np.repeat(own, count)
        row = low[box, 1] + np.arange(len(box)) - np.repeat(np.cumsum(count) - count, count)
        row, left = row - row.min(), low[:, 0] - low[own, 0].min()
        wide = int((high[own, 0] - low[own, 0].min()).max()) + 2
        order = np.argsort(row * wide + left[box], kind="stable")
        box, row = box[order], row[order]
        reach = np.maximum.accumulate(row * wide + left[box] + high[box, 0] - low[box, 0])
        begins = np.concatenate([[0], np.nonzero((row * wide + left[box])[1:] > reach[:-1])[0] + 1])
        run = np.repeat(np.arange(len(begins)), np.diff(begins, append=len(box)))
        label = np.arange(len(boxes))
        while True:
            least = np.minimum.reduceat(label[box], begins)
            new = label.copy()
            np.minimum.at(new, box, least[run])
            new = new[new]
            if (new == label).all():
                break
            label = new
        names, part = np.unique(label, return_inverse=True)
        if len(names) == len(boxes):
            return boxes
        out = np.concatenate([np.full((len(names), 2), np.inf), np.full((len(names), 2), -np.inf)], axis=1)
        np.minimum.at(out[:, :2], part, boxes[:, :2])
        np.maximum.at(out[:, 2:], part, boxes[:, 2:])
        boxes = out
    return boxes


def grown(boxes: np.ndarray, gap: float = GAP) -> np.ndarray:
    """Bounding boxes that no longer reach each other.

    A box takes in whatever it reaches, finished boxes too, until nothing is left to
    reach; the resulting set doesn't depend on the order. Boxes that share a cell as wide
    as the gap reach each other, so a grid joins the many of a crowded page first; at most
    a box a cell is left for the exact pass.
    """
    waiting, done = _sharing(np.asarray(boxes, float).reshape(-1, 4), gap) if gap > 0 else np.asarray(boxes, float).reshape(-1, 4), np.zeros((0, 4))
    while len(waiting):
        box, waiting = waiting[-1], waiting[:-1]
        while True:
            hits = [(box[2] + gap >= pool[:, 0]) & (pool[:, 2] + gap >= box[0]) & (box[3] + gap >= pool[:, 1]) & (pool[:, 3] + gap >= box[1]) for pool in (done, waiting)]
            if not (hits[0].any() or hits[1].any()):
                break
            taken = np.concatenate([done[hits[0]], waiting[hits[1]], box[None]])
            box = np.concatenate([taken[:, :2].min(axis=0), taken[:, 2:].max(axis=0)])
            done, waiting = done[~hits[0]], waiting[~hits[1]]
        done = np.concatenate([done, box[None]])
    return done


#: Boxes of a page from which it is grown by itself, and pairs of boxes that are compared at a time.
CROWDED, PAIRS = 64, 1 << 20


def _joined(page: np.ndarray, boxes: np.ndarray, gap: float) -> tuple[np.ndarray, np.ndarray]:
    """Boxes of many small pages, ordered by page, each page's grown together until none reaches another.

    All pages take a turn at once: components of boxes that reach each other become their bounds;
    pages where nothing was joined are done.
    """
    done = [(page[:0], boxes[:, :0])]
    while len(page):
        begins = np.nonzero(np.diff(page, prepend=page[0] - 1))[0]
        count = np.diff(begins, append=len(page))
        after = np.repeat(begins + count, count) - np.arange(len(page)) - 1
        a = np.repeat(np.arange(len(page)), after)
        b = np.arange(len(a)) - np.repeat(np.cumsum(after) - after, after) + a + 1
        x0, y0, x1, y1 = boxes
        met = (x1[a] + gap >= x0[b]) & (x1[b] + gap >= x0[a])
        a, b = a[met], b[met]
        met = (y1[a] + gap >= y0[b]) & (y1[b] + gap >= y0[a])
        a, b = a[met], b[met]
        label = np.arange(len(page))
        while True:
            least = np.minimum(label[a], label[b])
            new = label.copy()
            np.minimum.at(new, a, least)
            np.minimum.at(new, b, least)
            new = new[new]
            if (new == label).all():
                break
            label = new
        moved = np.zeros(len(begins), bool)
        moved[np.searchsorted(begins, a, "right") - 1] = True
        still = np.repeat(~moved, count)
        done.append((page[still], boxes[:, still]))
        order = np.argsort(label[~still], kind="stable")
        rest, names = np.nonzero(~still)[0][order], label[~still][order]
        if not len(rest):
            break
        first = np.nonzero(np.diff(names, prepend=-1))[0]
        page, boxes = page[names[first]], np.concatenate([np.minimum.reduceat(boxes[:2, rest], first, axis=1), np.maximum.reduceat(boxes[2:, rest], first, axis=1)])
    page, boxes = np.concatenate([p for p, _ in done]), np.concatenate([x for _, x in done], axis=1)
    order = np.argsort(page, kind="stable")
    return page[order], boxes[:, order]


def grown_pages(counts: np.ndarray, boxes: np.ndarray, gap: float = GAP) -> tuple[np.ndarray, np.ndarray]:
    """Of pages with so many boxes each, one after another (4 rows of corners): how many clusters each has, and their corners."""
    ends, found, out = np.cumsum(counts), np.zeros(len(counts), np.int64), []
    pairs, at = np.cumsum(np.where(counts < CROWDED, counts * (counts - 1) // 2 + counts, 0)), 0
    while at < len(counts):
        if counts[at] >= CROWDED:
            own = grown(boxes[:, ends[at] - counts[at] : ends[at]].T, gap).T
            found[at], at = own.shape[1], at + 1
        else:
            to = max(at + 1, int(np.searchsorted(pairs, pairs[at] + PAIRS)))
            crowded = np.nonzero(counts[at:to] >= CROWDED)[0]
            to = at + int(crowded[0]) if len(crowded) else to
            page, own = _joined(np.repeat(np.arange(at, to), counts[at:to]), boxes[:, ends[at] - counts[at] : ends[to - 1]], gap)
            found[at:to], at = np.bincount(page - at, minlength=to - at) if len(page) else 0, to
        out.append(own)
    return found, np.concatenate(out, axis=1) if out else np.zeros((4, 0))


def clustered(boxes: DataFrame, gap: float = GAP, first: Column | None = None) -> DataFrame:
    """Clusters of the boxes of each page (doc_id, page, page_w, page_h); where `first` holds, boxes are clustered among themselves before.

    A page is one array, so a batch of Arrow rows holds many pages and a long document
    isn't one task's. Rows are dealt out before they are listed, as lists don't get smaller by a
    first listing where the rows are.
    """
    kinds, corners = dict(boxes.dtypes), ["x0", "y0", "x1", "y1"]
    keys = ["doc_id", "page", "page_w", "page_h"]
    in_two = first is not None
    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", " + ", ".join(f"{k} double" for k in corners)

    def run(batches):
        for rows in batches:
            listed = rows.column("found")
            page, flat = np.repeat(np.arange(len(listed)), pc.list_value_length(listed).to_numpy()), listed.flatten()
            own = np.stack([flat.field(i).to_numpy(zero_copy_only=False) for i in range(4)])
            if in_two:
                early = flat.field(4).to_numpy(zero_copy_only=False)
                counts, joined = grown_pages(np.bincount(page[early], minlength=len(listed)), own[:, early], gap)
                page, own = np.concatenate([page[~early], np.repeat(np.arange(len(listed)), counts)]), np.concatenate([own[:, ~early], joined], axis=1)
                order = np.argsort(page, kind="stable")
                page, own = page[order], own[:, order]
            counts, own = grown_pages(np.bincount(page, minlength=len(listed)), own, gap)
            of = pa.array(np.repeat(np.arange(len(listed)), counts))
            yield pa.RecordBatch.from_arrays([rows.column(k).take(of) for k in keys] + [pa.array(x) for x in own], keys + corners)

    values = [F.col(c).cast("double").alias(c) for c in corners] + ([first.alias("first")] if in_two else [])
    dealt = boxes.select(*keys, F.struct(*values).alias("box")).repartition("doc_id", "page")
    return dealt.groupBy(*keys).agg(F.collect_list("box").alias("found")).mapInArrow(run, schema)


def is_raster_region() -> Column:
    return (F.col("kind") == "raster") & share().between(MIN_RASTER, MAX_REGION)


def is_vector_box() -> Column:
    """Drawings without rules, backgrounds, page frames and specks."""
    frame = (F.col("x0") <= FRAME) & (F.col("y0") <= FRAME) & (F.col("x1") >= F.col("page_w") - FRAME) & (F.col("y1") >= F.col("page_h") - FRAME)
    solid = (F.col("x1") - F.col("x0") >= THIN) & (F.col("y1") - F.col("y0") >= THIN)
    return (F.col("kind") == "vector") & solid & share().between(MIN_RASTER, MAX_REGION) & ~frame


def raster_regions(prims: DataFrame) -> DataFrame:
    return prims.where(is_raster_region())


def vector_boxes(prims: DataFrame) -> DataFrame:
    return prims.where(is_vector_box())


def with_captions(regions: DataFrame, blocks: DataFrame) -> DataFrame:
    """label and caption of the nearest caption block on the page, null where there is none near.

    Regions of a page with one `region` number share the caption nearest to any of them.
    """
    # White space is single blanks by then, so a trim strips it, and a label ends with its word.
    told = bound(F.trim(S.collapse(F.col("text"))), lambda c: F.struct(c.alias("caption"), F.regexp_extract(c, CAPTION, 0).alias("label")))
    lines = blocks.select("doc_id", "page", "ord", *[F.col(c).alias(f"b{c}") for c in ("x0", "y0", "x1", "y1")], F.explode(F.filter(F.array(told), lambda x: x["label"] != "")).alias("told"))
    gap = F.greatest(F.lit(0.0), F.col("y0") - F.col("by1"), F.col("by0") - F.col("y1"))
    near_by = (gap <= CAPTION_GAP) & (F.col("bx1") >= F.col("x0") - CAPTION_SLACK) & (F.col("bx0") <= F.col("x1") + CAPTION_SLACK)
    score = gap + F.when(F.col("by1") <= F.col("y0") + CAPTION_SLACK, ABOVE).otherwise(0.0)
    met = regions.select("doc_id", "page", "region", "x0", "y0", "x1", "y1").join(lines, ["doc_id", "page"]).where(near_by)
    best = met.groupBy("doc_id", "page", "region").agg(F.min_by("told", F.struct(score.alias("score"), "ord")).alias("best"))
    return regions.join(best, ["doc_id", "page", "region"], "left").select(*regions.columns, F.col("best.label").alias("label"), F.col("best.caption").alias("caption"))


def merged_by_caption(regions: DataFrame) -> DataFrame:
    """Regions of one page with one caption text become their bounding box."""
    keys = ["doc_id", "page", "page_w", "page_h"]
    alone = F.when(F.col("caption").isNull(), F.col("region"))
    boxes = [F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1")]
    return regions.groupBy(*keys, "caption", alone.alias("alone")).agg(*boxes, F.min_by("label", "region").alias("label")).drop("alone")


def figures(prims: DataFrame, blocks: DataFrame, max_pages: int | None = None, max_figures: int = MAX_FIGURES) -> DataFrame:
    """doc_id, ord, page, fig_idx, rect, crop_rect, label, caption in document order.

    fig_idx counts a page's figures from 0, before the largest max_figures are chosen.
    """
    prims = prims.where(F.abs(F.col("page_w") * F.col("page_h")) > 0)
    if max_pages is not None:
        prims = prims.where(F.col("page") < max_pages)
    boxes = prims.where(is_raster_region() | is_vector_box())
    on_page = Window.partitionBy("doc_id", "page").orderBy("y0", "x0", "y1", "x1")
    regions = clustered(boxes, first=F.col("kind") == "vector").withColumn("region", F.row_number().over(on_page))
    kept = largest(merged_by_caption(with_captions(regions, blocks)), max_figures)
    in_doc = Window.partitionBy("doc_id").orderBy("page", "y0", "x0", "fig_idx")
    rect = F.struct("x0", "y0", "x1", "y1").alias("rect")
    return kept.select("doc_id", F.row_number().over(in_doc).alias("ord"), "page", "fig_idx", rect, crop_rect().alias("crop_rect"), "label", "caption")


def largest(regions: DataFrame, max_figures: int = MAX_FIGURES, ties: tuple[str, ...] = ()) -> DataFrame:
    """The max_figures largest of each document's regions above the least size, with fig_idx; `ties` tells equal boxes apart."""
    on_page = Window.partitionBy("doc_id", "page").orderBy("y0", "x0", "y1", "x1", *ties)
    ordered = regions.where(share() >= MIN_FIGURE).withColumn("fig_idx", F.row_number().over(on_page) - 1).withColumn("area", area())
    by_area = Window.partitionBy("doc_id").orderBy(F.desc("area"), "page", "y0", "x0", *ties)
    return ordered.withColumn("rank", F.row_number().over(by_area)).where(F.col("rank") <= max_figures)


def crop_rect() -> Column:
    """The box with room around it, cut at the page's edges."""
    return F.struct(
        F.greatest(F.lit(0.0), F.col("x0") - PAD).alias("x0"), F.greatest(F.lit(0.0), F.col("y0") - PAD).alias("y0"), F.least(F.col("page_w"), F.col("x1") + PAD).alias("x1"), F.least(F.col("page_h"), F.col("y1") + PAD).alias("y1")
    )


def crop_name() -> Column:
    return F.concat(F.lit("fig_p"), F.col("page").cast("string"), F.lit("_"), F.col("fig_idx").cast("string"), F.lit(".png"))
