"""Frame, box and sample predicates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annolake.functions.geometry import box_height, box_width, intersects_region


def select_frames(frames: DataFrame, stride: int, start: int = 0, column: str = "frame_index") -> DataFrame:
    """Frames whose absolute index is a multiple of the stride, from ``start`` on."""
    if stride <= 0:
        raise ValueError("stride must be at least 1")
    return frames.filter((F.col(column) >= start) & (F.col(column) % stride == 0))


def passes_score(score: Column, minimum: float) -> Column:
    """A missing score always passes."""
    return score.isNull() | (score >= minimum)


def region_filter(df: DataFrame, box: Column, region: tuple[int, int, int, int] | None) -> DataFrame:
    return df.filter(intersects_region(box, region))


def drop_empty(frames: DataFrame, boxes: Column, keep_empty: bool = False) -> DataFrame:
    return frames if keep_empty else frames.filter(F.size(boxes) > 0)


BOUND_COLUMNS = {"area": "area", "width": "width", "height": "height", "y": "center_y"}


def box_filter(features: Column, bounds: dict[str, float | None]) -> Column:
    """Conjunction of strict bounds such as ``{"area_lt": 900, "y_gt": 360}``; no bounds is true."""
    checks = []
    for name, value in bounds.items():
        if value is None:
            continue
        column, side = name.rsplit("_", 1)
        feature = features[BOUND_COLUMNS[column]]
        checks.append(feature < value if side == "lt" else feature > value)
    return reduce(Column.__and__, checks, F.lit(True))


def label_is_masked(record: Column) -> Column:
    flags = [F.coalesce(record[k], F.lit(False)) for k in ("masked", "deleted", "unreliable", "exclude_from_loss")]
    return reduce(Column.__or__, flags)


def usable_box(box: Column) -> Column:
    return (box_width(box) > 0.5) & (box_height(box) > 0.5)


def review_listing(
    boxes: DataFrame,
    images: DataFrame,
    bounds: dict[str, float | None],
    include_empty: bool = False,
    only_empty: bool = False,
    only_dropped: bool = False,
    show_masked: bool = True,
) -> DataFrame:
    """One row per listed image. ``boxes``: image_id, features, masked; ``images``: image_id, drop_image."""
    shown = F.lit(True) if show_masked else ~F.col("masked")
    matched = shown & box_filter(F.col("features"), bounds)
    per_image = boxes.groupBy("image_id").agg(
        F.count(F.lit(1)).alias("total_boxes"), F.count_if("masked").alias("masked_boxes"),
        F.count_if(shown).alias("shown_boxes"), F.count_if(matched).alias("matched_count"),
    )
    counts = ["total_boxes", "masked_boxes", "shown_boxes", "matched_count"]
    listed = images.join(per_image, "image_id", "left").fillna(0, counts)
    listed = listed.withColumn("empty_label", F.col("total_boxes") == 0)
    keep = F.lit(True)
    if only_dropped:
        keep = keep & F.col("drop_image")
    if only_empty:
        keep = keep & F.col("empty_label")
    if not include_empty:
        keep = keep & (F.col("shown_boxes") > 0)
    if not only_empty and any(v is not None for v in bounds.values()):
        keep = keep & (F.col("matched_count") > 0)
    return listed.filter(keep)


def listing_stats(boxes: DataFrame, images: DataFrame, listing: DataFrame, only_dropped: bool = False) -> DataFrame:
    """Global counters of a listing; boxes of skipped images do not count."""
    seen = images.filter("drop_image") if only_dropped else images
    totals = boxes.join(seen, "image_id", "left_semi").agg(
        F.count(F.lit(1)).alias("total_boxes"), F.count_if("masked").alias("masked_boxes")
    )
    dropped = images.agg(F.count_if("drop_image").alias("n"))
    shown = listing.agg(F.count(F.lit(1)).alias("n"))
    return totals.select("*", dropped.scalar().alias("dropped_images"), shown.scalar().alias("images"))
