"""Masks as sparse pixels (view, mask, y, x): areas, borders, overlaps, suppression and morphology."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEY = ["view_id", "mask_id"]


def mask_stats(pix: DataFrame, height: int, width: int) -> DataFrame:
    """Area ratio, number of touched borders (0-4) and border coverage of each mask; corners count for both of their borders."""
    top, bottom, left, right = F.col("y") == 0, F.col("y") == height - 1, F.col("x") == 0, F.col("x") == width - 1
    sides = [c.cast("int") for c in (top, bottom, left, right)]
    return pix.groupBy(*KEY).agg(
        F.count("*").alias("area"),
        (F.count("*") / F.lit(height * width)).alias("ratio"),
        sum((F.max(c) for c in sides[1:]), F.max(sides[0])).cast("bigint").alias("touches"),
        (sum((F.sum(c) for c in sides[1:]), F.sum(sides[0])) / F.lit(2 * height + 2 * width)).alias("coverage"),
    )


def mask_boxes(pix: DataFrame) -> DataFrame:
    """Bounding box of each mask, ends inclusive."""
    return pix.groupBy(*KEY).agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"))


def square_boxes(boxes: DataFrame, pad: float, size: int) -> DataFrame:
    """Square boxes around the given ones, padded by a share of the longer side and moved into the image."""
    side = F.least(F.ceil(F.greatest(F.col("x1") - F.col("x0") + 1, F.col("y1") - F.col("y0") + 1) * (1 + 2 * pad)), F.lit(size))
    out = boxes.withColumn("side", side.cast("bigint"))
    for a in ("x", "y"):
        middle = (F.col(f"{a}0") + F.col(f"{a}1") + 1) / 2
        low = F.floor(middle - F.col("side") / 2)
        out = out.withColumn(f"s{a}", F.greatest(F.lit(0), F.least(low, F.lit(size) - F.col("side"))).cast("bigint"))
    return out.select(*KEY, "sx", "sy", "side")


def mask_pairs(pix: DataFrame) -> DataFrame:
    """Overlapping masks a < b of a view: pixels in common, both areas, IoU. Masks meet on shared pixels only, never all with all."""
    areas = pix.groupBy(*KEY).agg(F.count("*").alias("area"))
    # A list a pixel instead of a join of pixels with pixels: Spark takes exploded pixels for as few bytes as the masks they come from, and
    # would broadcast them. The joins with areas are merges for the same reason.
    each = pix.groupBy("view_id", "y", "x").agg(F.collect_list("mask_id").alias("_masks")).filter(F.size("_masks") > 1)
    both = each.select("view_id", "_masks", F.explode("_masks").alias("a")).select("view_id", "a", F.explode("_masks").alias("b"))
    common = both.filter("a < b").groupBy("view_id", "a", "b").agg(F.count("*").alias("common")).hint("merge")
    sized = common.join(areas.select("view_id", F.col("mask_id").alias("a"), F.col("area").alias("area_a")), ["view_id", "a"]).hint("merge")
    sized = sized.join(areas.select("view_id", F.col("mask_id").alias("b"), F.col("area").alias("area_b")), ["view_id", "b"])
    return sized.withColumn("iou", F.col("common") / (F.col("area_a") + F.col("area_b") - F.col("common")))


def mean_pair_iou(pix: DataFrame) -> DataFrame:
    """Mean over a view's masks of the mean IoU with the view's other masks (0 where they don't touch; 0 for a lone mask)."""
    pairs = mask_pairs(pix).select("view_id", "a", "b", "iou")
    both = pairs.select("view_id", F.col("a").alias("mask_id"), "iou").union(pairs.select("view_id", "b", "iou"))
    counts = pix.select(*KEY).distinct().groupBy("view_id").agg(F.count("*").alias("n"))
    rows = pix.select(*KEY).distinct().join(both.groupBy(*KEY).agg(F.sum("iou").alias("total")), KEY, "left").join(counts, "view_id")
    per = F.when(F.col("n") > 1, F.coalesce("total", F.lit(0.0)) / (F.col("n") - 1)).otherwise(0.0)
    return rows.groupBy("view_id").agg(F.avg(per).alias("mean_iou"))


def best_overlap(pix: DataFrame, labels: DataFrame, label: str = "label") -> DataFrame:
    """For each mask the label of greatest IoU with it (ties: least label), with IoU, precision and recall. ``labels``: view, y, x, label;
    negative labels are background. Masks that meet no label give none."""
    labelled = labels.filter(F.col(label) >= 0)
    areas = pix.groupBy(*KEY).agg(F.count("*").alias("area"))
    sizes = labelled.groupBy("view_id", label).agg(F.count("*").alias("size"))
    # Both sides are pixels, which Spark takes for smaller than they are (see mask_pairs): a merge, never a broadcast.
    common = pix.join(labelled.hint("merge"), ["view_id", "y", "x"]).groupBy(*KEY, label).agg(F.count("*").alias("common"))
    joined = common.join(areas, KEY).join(sizes, ["view_id", label])
    iou = F.col("common") / F.greatest(F.col("area") + F.col("size") - F.col("common"), F.lit(1))
    scored = joined.select(*KEY, label, iou.alias("iou"), (F.col("common") / F.col("size")).alias("precision"), (F.col("common") / F.col("area")).alias("recall"))
    rank = F.row_number().over(Window.partitionBy(*KEY).orderBy(F.desc("iou"), label))
    return scored.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")


def exclusive_claims(pix: DataFrame, order: str) -> DataFrame:
    """Each pixel goes to the mask of greatest ``order`` that has it (ties: greater mask)."""
    return pix.groupBy("view_id", "y", "x").agg(F.max(F.struct(order, "mask_id")).alias("_top")).select("view_id", "y", "x", F.col("_top.mask_id").alias("mask_id"))


def neighbours(pix: DataFrame, reach: int = 1) -> DataFrame:
    """Each pixel once for every place within ``reach`` (a square): the places, with the pixel's mask, and whether it is the pixel's own."""
    steps = F.sequence(F.lit(-reach), F.lit(reach))
    return pix.withColumn("_dy", F.explode(steps)).withColumn("_dx", F.explode(steps)).select(
        *KEY, (F.col("y") + F.col("_dy")).alias("y"), (F.col("x") + F.col("_dx")).alias("x"), ((F.col("_dy") == 0) & (F.col("_dx") == 0)).alias("own")
    )


def counted_neighbours(pix: DataFrame, reach: int = 1) -> DataFrame:
    """``n``: how many pixels of a mask lie within ``reach`` of each place that has any, and whether the place is one (``own``). One exchange,
    of partial counts."""
    return neighbours(pix.distinct(), reach).groupBy(*KEY, "y", "x").agg(F.count("*").alias("n"), F.bool_or("own").alias("own"))


def _in_frame(height: int, width: int):
    return F.col("y").between(0, height - 1) & F.col("x").between(0, width - 1)


def dilate(pix: DataFrame, height: int, width: int, reach: int = 1) -> DataFrame:
    return neighbours(pix, reach).filter(_in_frame(height, width)).drop("own").distinct()


def erode(pix: DataFrame, reach: int = 1) -> DataFrame:
    """Pixels whose whole neighbourhood is in the mask; beyond the frame is outside."""
    full = (2 * reach + 1) ** 2
    return counted_neighbours(pix, reach).filter(F.col("n") == full).drop("n", "own")


def majority(pix: DataFrame, least: int = 5, reach: int = 1) -> DataFrame:
    """Pixels of the mask with at least ``least`` mask pixels in their neighbourhood (itself included)."""
    return counted_neighbours(pix, reach).filter((F.col("n") >= least) & F.col("own")).drop("n", "own")


def boundary_band(pix: DataFrame, height: int, width: int, reach: int = 1) -> DataFrame:
    """Pixels in the dilated mask but not in the eroded one."""
    full = (2 * reach + 1) ** 2
    return counted_neighbours(pix, reach).filter(_in_frame(height, width) & (F.col("n") < full)).drop("n", "own")


def exclusive_growth(pix: DataFrame, height: int, width: int, reach: int = 1) -> DataFrame:
    """Masks grown into free pixels (of no mask of the view) that exactly one mask reaches."""
    free = dilate(pix, height, width, reach).join(pix.select("view_id", "y", "x"), ["view_id", "y", "x"], "left_anti")
    single = free.groupBy("view_id", "y", "x").agg(F.count("*").alias("n"), F.min("mask_id").alias("mask_id")).filter("n = 1")
    return pix.distinct().unionByName(single.select(*KEY, "y", "x"))


def pixel_weights(pix: DataFrame) -> DataFrame:
    """``weight`` of each covered pixel: the inverse of the mean size of its masks, rescaled per view to 1..10 (equal ones: 1)."""
    areas = pix.groupBy(*KEY).agg(F.count("*").alias("area"))
    mean = pix.join(areas, KEY).groupBy("view_id", "y", "x").agg((1 / F.avg("area")).alias("w"))
    span = mean.groupBy("view_id").agg(F.min("w").alias("low"), F.max("w").alias("high"))
    scaled = F.when(F.col("high") - F.col("low") > 1e-12, 1 + 9 * (F.col("w") - F.col("low")) / (F.col("high") - F.col("low"))).otherwise(1.0)
    return mean.join(span, "view_id").select("view_id", "y", "x", scaled.alias("weight"))


def greedy_suppress(masks: DataFrame, pairs: DataFrame, order: list[str], most_iou: float) -> DataFrame:
    """Masks of each view in their order, kept if their IoU with every kept one is at most ``most_iou`` (ties in the order: mask_id).

    Sequential by nature inside a view; views are independent, and of each view only the order and the pairs above the limit are held.
    """
    rivals = pairs.filter(F.col("iou") > most_iou).select("view_id", "a", "b")
    clash = rivals.groupBy("view_id").agg(F.collect_list(F.struct("a", "b")).alias("clash"))
    ranked = masks.groupBy("view_id").agg(F.array_sort(F.collect_list(F.struct(*order, "mask_id"))).mask_id.alias("masks"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            views, kept_all = [], []
            for view, ids, clashes in zip(*(c.to_pylist() for c in batch.columns)):
                beside: dict[int, set[int]] = {}
                for x in clashes or []:
                    beside.setdefault(x["a"], set()).add(x["b"])
                    beside.setdefault(x["b"], set()).add(x["a"])
                kept: set[int] = set()
                for i in ids:
                    if not kept & beside.get(i, set()):
                        kept.add(i)
                views += [view] * len(kept)
                kept_all += sorted(kept)
            yield pa.RecordBatch.from_arrays([pa.array(views, pa.string()), pa.array(kept_all, pa.int64())], ["view_id", "mask_id"])

    return ranked.join(clash, "view_id", "left").mapInArrow(run, "view_id string, mask_id bigint")


def matrix_suppress(scores: DataFrame, pairs: DataFrame, iou_limit: float, inner_limit: float, rescue: int = 3) -> DataFrame:
    """Masks kept by non-maximum suppression against *every* better-ranked mask of the view (kept or not), then by containment.

    Rank: score descending, mask_id. Suppressed: IoU above ``iou_limit`` with a better one; or mostly (``inner_limit``) inside another of
    twice its area. If a view loses all, its ``rescue`` best stay. ``scores``: view_id, mask_id, score.
    """
    rank = F.row_number().over(Window.partitionBy("view_id").orderBy(F.desc("score"), "mask_id"))
    ranked = scores.withColumn("rank", rank)
    ra, rb = (ranked.select("view_id", F.col("mask_id").alias(c), F.col("rank").alias(f"rank_{c}")) for c in "ab")
    known = pairs.join(ra, ["view_id", "a"]).join(rb, ["view_id", "b"])
    worse = F.when(F.col("rank_a") > F.col("rank_b"), F.col("a")).otherwise(F.col("b"))
    beaten = known.filter(F.col("iou") > iou_limit).select("view_id", worse.alias("mask_id"))
    small_a = (F.col("common") > inner_limit * F.col("area_a")) & (F.col("area_b") >= 2 * F.col("area_a"))
    small_b = (F.col("common") > inner_limit * F.col("area_b")) & (F.col("area_a") >= 2 * F.col("area_b"))
    inside = known.filter(small_a).select("view_id", F.col("a").alias("mask_id")).union(known.filter(small_b).select("view_id", F.col("b")))
    lost = beaten.union(inside).distinct().withColumn("lost", F.lit(True))
    marked = ranked.join(lost, KEY, "left").withColumn("lost", F.coalesce("lost", F.lit(False)))
    none = marked.groupBy("view_id").agg(F.bool_and("lost").alias("none"))
    return marked.join(none, "view_id").filter(~F.col("lost") | (F.col("none") & (F.col("rank") <= rescue))).select(*KEY)
